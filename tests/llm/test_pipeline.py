"""Each stage of the pipeline on its own input, by what its operator finds, and the whole on the smallest tables."""

import corpus_pipeline
from pericope.llm import decontaminate, jaccard, langid, packing, pii, shared


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{i}")
        new = spark.read.parquet(f"{tmp_path}/{i}")
        before, after = ({r["doc_id"]: r["text"] for r in d.select("doc_id", "text" if "text" in d.columns else "bin").withColumnRenamed("bin", "text").collect()} for d in (docs, new))
        if i < 4:
            assert new.columns == columns
        if i == 0:
            keep = {r["doc_id"] for r in langid.identify(docs, langid.train(docs)).where("keep").collect()}
            assert set(after) == keep and len(keep) > 0.97 * len(before)
        elif i == 1:
            from tests.llm.test_joins import brute_links

            want = brute_links(list(before.items()), jaccard.N, jaccard.THRESHOLD)
            assert set(after) == {d for d in before if want[d][0] == d} and len(after) < len(before)
        elif i == 2:
            from tests.llm.test_joins import held

            items = [r["text"] for r in bench.collect()]
            bad = {d for d, t in before.items() if any(held(t, x, decontaminate.N, decontaminate.THRESHOLD) for x in items)}
            assert bad and set(after) == set(before) - bad
        elif i == 3:
            want = {r["doc_id"]: r["text"] for r in pii.redact(docs, pii.train()).collect()}
            assert after == want and any(before[d] != after[d] for d in before)
            assert new.where("n_chars != length(text)").count() == docs.where("n_chars != length(text)").count()
        else:
            assert set(after) == {d for d, t in before.items() if t} and new.count() == packing.pack(docs).count()
        docs = new


def test_run(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.count() and set(got.columns) >= {"doc_id", "bin", "class", "shard", "slot", "start", "length", "piece"}
    assert corpus_pipeline.ORACLE_SQL is None


LONG = "the long text goes on and on with words of every kind " * 4000
ROWS = [
    (1, "This is a document in plain English with enough words to tell its language by.", "en", "a", 10), (1, "This is a document in plain English with enough words to tell its language by.", "en", "a", 10),
    (2, "This is a document in plain English with enough words to tell its language by.", None, None, None), (None, "A text without any number, but with an address: jane.roe@mail.example.org in it.", "en", "b", 1), (3, None, "en", "a", 0),
    (4, "", "en", "a", 0), (5, "  \n\t ", "en", "a", 5), (6, LONG, "en", "c", None), (7, "%%% ### 12345 &&& 0000 $$$ @@@ 9999 ^^^ === 1234567890 ***", "en", "c", 3), (8, "Ein Text in deutscher Sprache, der nicht doppelt ist und auch sonst nichts enthält.", "de", "c", 83),
]


def awkward(spark, rows=ROWS):
    """Documents with nulls in every column, and with columns whose names clash, also by case alone."""
    return spark.createDataFrame([(*r, "clash", i, None, "x") for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, Text string, __out int, `a.b` int, c0 string").repartition(2)


def test_stages_on_awkward_rows(spark, sf):
    docs = awkward(spark)
    place = lambda d: sorted(r["__out"] for r in d.collect())
    kept = corpus_pipeline.language_id(spark, docs, sf)
    assert kept.columns == docs.columns and set(place(kept)) & {4, 5} == set() and {7, 9} <= set(place(kept))
    one = corpus_pipeline.near_duplicates(spark, docs, sf)
    assert one.columns == docs.columns and place(one) == [0, 1, 3, 4, 5, 6, 7, 8, 9]
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    more = awkward(spark, [*ROWS, (9, f"{LONG} {item} {LONG}", "en", "a", 1), (10, item, None, None, None), (10, "another text of that number", "en", "a", 1), (None, item, "en", "a", 1)])
    clean = corpus_pipeline.decontamination(spark, more, sf)
    assert clean.columns == docs.columns and place(clean) == [*range(10), 13]
    private = {r["__out"]: r for r in corpus_pipeline.private_data(spark, docs, sf).collect()}
    assert private[3]["text"].count("[EMAIL]") == 1 and private[3]["n_chars"] == len(private[3]["text"]) and len(private) == 10
    assert all(private[i][:5] == ROWS[i] and private[i]["Text"] == "clash" for i in range(10) if i != 3)
    packed = corpus_pipeline.bins(spark, docs, sf).collect()
    assert sum(r["length"] for r in packed) == sum(len(t.encode()) for _, t, *_ in ROWS if t) and {r["doc_id"] for r in packed} == {1, 2, None, 5, 6, 7, 8}


def test_stages_on_empty_tables(spark, sf):
    docs = awkward(spark).limit(0)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, docs, sf)
        assert got.count() == 0 and (i == 4 or got.columns == docs.columns)


def test_ids_of_other_types_are_refused(spark):
    import pytest

    d = spark.createDataFrame([("x", "a text")], "doc_id string, text string")
    for f in (lambda: jaccard.linked(d), lambda: packing.pack(d), lambda: decontaminate.remove(d, d), lambda: pii.redact(d, pii.train())):
        with pytest.raises(TypeError, match="whole numbers"):
            f()


def test_tables_are_let_go(spark, sf, tmp_path):
    d = shared.cut(spark.range(5).withColumnRenamed("id", "n"))
    assert d.count() == 5
    path = shared._cut[id(d)]
    shared.release(d)
    import os

    assert not os.path.exists(path.removeprefix("file:"))
    shared.release(spark.range(1))  # no table of cut(): nothing happens

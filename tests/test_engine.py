import copy
import dataclasses
import json
import random
import threading
from http.server import SimpleHTTPRequestHandler, ThreadingHTTPServer

import pytest

import pericope as p
from pericope.functions import text
from pericope.plans.criteria import analyse, valid_limit
from pericope.plans.references import AliasBook, ReferenceParser, expand_verses
from pericope.sources import validate
from pericope.sources.repository import Repository, alias_catalogue, checksum_faults, checksums, translations
from tests import fixture


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("source")
    fixture.put(root)
    limits = p.SearchLimits(deadline_seconds=120.0)
    with p.VerseEngine(spark, str(root), fixture.put_aliases(tmp_path_factory.mktemp("aliases")), str(tmp_path_factory.mktemp("store")), search_limits=limits) as e:
        yield e


def found(engine, query, **criteria):
    r = engine.search(query, "tiny", criteria)
    assert r["query"]["returned"] == len(r["matches"])
    return [m["reference"] for m in r["matches"]]


def test_phrase(engine):
    r = engine.search("  in the beginning ", "TINY", {"words": "phrase"})
    assert r["query"]["text"] == "in the beginning" and r["query"]["total"] == 1 and list(r["results"]) == ["tiny_1_1"]
    assert r["matches"][0] | {"terms": None} == {"reference": "Genesis 1:1", "book_nr": 1, "chapter": 1, "verse": 1, "score": 3, "occurrences": 1, "terms": None}
    assert r["query"]["translation"]["description"] == "Nine verses" and r["query"]["criteria"]["words"] == "phrase"
    assert json.loads(engine.search_json("faith", "tiny"))["query"]["total"] == 3


@pytest.mark.parametrize(
    "query, criteria, expected",
    [
        ("faith hope", {}, 3), ("faith wisdom", {"words": "any"}, 4), ("great", {}, 0), ("great", {"match": "substring"}, 1), ("faith", {"scope": "old_testament"}, 1), ("faith", {"scope": "new_testament"}, 2),
        ("wisdom", {"scope": "deuterocanon"}, 1), ("faith", {"books": ("Genesis",)}, 1), ("faith", {"books": (40,)}, 2), ("faith", {"books": ("Mt",)}, 2), ("cafe", {}, 0), ("cafe", {"diacritics": "insensitive"}, 1),
        ("faith", {"exclude": ("love",)}, 2), ("faith hope", {"proximity": 0}, 1), ("faith", {"books": (1,), "scope": "new_testament"}, 0), ("all was calm.", {"words": "phrase", "match": "substring"}, 1), ("faith", {"exclude": ("...",)}, 3),
    ],
)
def test_totals(engine, query, criteria, expected):
    assert len(found(engine, query, **criteria)) == expected


def test_case_scores_and_pages(engine):
    assert engine.search("Word", "tiny", {"case_sensitive": True})["matches"][0]["occurrences"] == 1
    assert engine.search("word", "tiny")["matches"][0]["occurrences"] == 2
    r = engine.search("faith", "tiny", {"sort": "relevance", "limit": 1, "offset": 1})["query"]
    assert (r["total"], r["returned"], r["has_more"]) == (3, 1, True)
    r = engine.search("faith", "tiny", {"offset": 50})["query"]
    assert (r["total"], r["returned"], r["has_more"]) == (3, 0, False)
    assert found(engine, "faith hope", proximity=0) == ["Genesis 1:3"]
    assert r["cost"]["work_units"] == 9 + 2 * sum(len(v["text"]) for b in fixture.TINY["books"] for v in b["chapters"][0]["verses"]) + 9 + 800


def test_errors(engine):
    for bad in ("", "  ", "!!", 3, "x" * 501):
        with pytest.raises(p.SearchValidationError):
            engine.search(bad, "tiny")
    with pytest.raises(p.SearchValidationError):
        engine.search("ab", "tiny", {"match": "substring"})
    with pytest.raises(p.SearchValidationError):
        engine.search("faith", "tiny", {"books": (2,)})
    with pytest.raises(p.TranslationNotFoundError):
        engine.search("faith", "none")
    with pytest.raises(p.SearchLimitError):
        engine.search("faith", "tiny", {"offset": 10_001})
    with pytest.raises(ValueError):
        engine.search("faith", "../x")
    tight, engine.search_limits = engine.search_limits, dataclasses.replace(engine.search_limits, max_work_units=10)
    try:
        with pytest.raises(p.SearchLimitError):
            engine.search("faith", "tiny")
    finally:
        engine.search_limits = tight


def test_select(engine):
    r = engine.select("Gen 1:2-3,1; Ge 1:2;Matthew 1", "tiny")
    assert [v["verse"] for v in r["tiny_1_1"]["verses"]] == [2, 3, 1] and r["tiny_1_1"]["ref"] == ["Gen 1:2-3,1", "Ge 1:2"]
    assert [v["verse"] for v in r["tiny_40_1"]["verses"]] == [1] and r["tiny_1_1"]["book_name"] == "Genesis" and "description" not in r["tiny_1_1"]
    assert json.loads(engine.scripture("Gen 1", "tiny"))["tiny_1_1"]["verses"][0]["text"].startswith("In the")
    with pytest.raises(FileNotFoundError):
        engine.select("Gen 111:1", "tiny")
    with pytest.raises(p.ReferenceValidationError):
        engine.select("Gen 1:111", "tiny")
    for bad in ("", "Gen 1;;Gen 2", "Nobody 1:1"):
        with pytest.raises(p.ReferenceValidationError):
            engine.select(bad, "tiny")
    with pytest.raises(p.RequestLimitError):
        engine.select(";".join(["Gen 1:1"] * 9), "tiny")


def test_warm_and_info(engine):
    w = engine.warm_translation("tiny", diacritics="insensitive", case_sensitive=True)
    assert w["verses"] == 9 and {"case_sensitive": True, "diacritics": "insensitive"} in w["indexes"]
    assert not engine.valid_translation("none") and not engine.valid_translation(5) and engine.valid_translation("Tiny")
    assert engine.cache_info()["counters"]["negative_hits"] > 0
    assert engine.valid_reference("Gen 1:1", "tiny") and not engine.valid_reference("Gen 1:1!", "tiny")


def test_criteria():
    s = p.SearchSpec.from_value("exactwords-partialmatch-casesensitive-43")
    assert (s.words, s.match, s.case_sensitive, s.books) == ("phrase", "substring", True, (43,))
    assert p.SearchSpec.from_legacy("allwords-exactmatch-caseinsensitive-01").books == (1,) and not valid_limit("allwords-exactmatch-caseinsensitive-01") and valid_limit("allwords-exactmatch-caseinsensitive-1")
    for bad in ("a-b-c-d", "allwords-exactmatch-caseinsensitive-84", "allwords"):
        with pytest.raises(p.SearchValidationError):
            p.SearchSpec.from_value(bad)
    for bad in ({"words": "x"}, {"limit": 0}, {"limit": True}, {"proximity": 3, "words": "any"}, {"proximity": 101}, {"exclude": (" ",)}, {"books": (True,)}, {"odd": 1}, {"offset": -1}, {"words": 3}, {"case_sensitive": 1}):
        with pytest.raises(p.SearchValidationError):
            p.SearchSpec.from_value(bad)
    assert not p.SearchSpec().expensive and not p.SearchSpec(case_sensitive=True, books=(1,), scope="new_testament").expensive
    for costly in ({"match": "substring"}, {"words": "any"}, {"sort": "relevance"}, {"exclude": ("a",)}, {"limit": 101}, {"offset": 1001}, {"proximity": 1}, {"diacritics": "insensitive"}):
        assert p.SearchSpec(**costly).expensive
    assert p.SearchSpec(words="ANY").with_pagination(5, 6).to_dict()["limit"] == 5
    assert p.SearchSpec.from_params({"words": "any", "book": ["1", "Mark"], "books": "40,41", "limit": "5"}).books == (1, "Mark", 40, 41)
    assert analyse("a b a", p.SearchSpec(words="phrase")).terms == ("a", "b", "a") and analyse("a b a", p.SearchSpec()).terms == ("a", "b")
    with pytest.raises(ValueError):
        p.RequestLimits(max_verses_per_reference=201)


def test_normalise(spark):
    from pyspark.sql import functions as F

    cases = ["", "é", "é", "Σος", "ﬁn", "Straße", "İx", "a  b\t\nc", "µ", "ſ", "x̣́", "’tis", "İ", "ŉ", "A B", "ẞ", "ÅŁ", None]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(cases)], "i int, x string")
    for case in (False, True):
        for marks in ("sensitive", "insensitive"):
            got = {r["i"]: r["y"] for r in d.select("i", text.normalised(F.col("x"), case, marks).alias("y")).collect()}
            assert got == {i: None if x is None else text.normalise(x, case, marks) for i, x in enumerate(cases)}
    for s in ("don’t stop", "a-b 3.5 x'y'", "क्ष 中文", ""):
        got = spark.createDataFrame([(s,)], "x string").select(text.tokens(F.col("x")).alias("t")).first()["t"]
        assert got == text.tokenise(s)


def test_phrase_quirks(spark):
    """lord's is a token of its own, but the phrase's boundaries don't see the apostrophe."""
    from pericope.operators import index, match

    v = spark.createDataFrame([("t", 1, 1, 1, "The lord and the lord's"), ("t", 1, 1, 2, "only lord's here"), ("t", 1, 1, 3, "greatgreat great")], "abbreviation string, book_nr int, chapter int, verse int, text string")
    t = index.with_tokens(v)
    rows = lambda q, **k: {r["verse"]: (r["occurrences"], r["score"]) for r in match.hits(t, analyse(q, p.SearchSpec(**k))).collect()}
    assert rows("lord", words="phrase", sort="relevance") == {1: (2, 2)}
    assert rows("lord", words="phrase") == {1: (1, 1)}
    assert rows("great", match="substring") == {3: (2, 2)}
    assert rows("the lord", words="phrase") == {1: (2, 4)}


def test_references():
    r = ReferenceParser(AliasBook(fixture.alias_rows()), max_verses=200)
    get = lambda x, c="kjv": (lambda b: (b.book, b.chapter, b.verses))(r.ref(x, c))
    assert get("Gen 1:2-7") == (1, 1, [2, 3, 4, 5, 6, 7]) and get("First John 3:16,19-21") == (62, 3, [16, 19, 20, 21])
    assert get("1  John 5") == (62, 5, [1]) and get("创记 1:2-", "cns") == (1, 1, [2]) and get("62") == (62, 62, [1]) and get("Gen:-3") == (1, 1, [3]) and get("Gen 2:") == (1, 2, [1])
    assert get("Ge. 1", "cns")[0] == 2 and get("Ge. 1", "unknown")[0] == 1 and get("Jean 1", "fra")[0] == 62 and get("Génèse 2")[0] == 1
    for bad in ("John 1:0", "John 2:1--2", "John 3:16!", "John 4:10-1", "84", "0", "-19", "John 3 :16", "", "John 0:1", "John 1:1:2", "x" * 101, "John 1:,", None, "²"):
        assert not r.valid(bad)
    for huge in ("John 1:1-201", "John 1:1001"):
        with pytest.raises(p.RequestLimitError):
            r.ref(huge)
    r.ref("Gen 1:2").verses.append(99)
    assert r.ref("Gen 1:2").verses == [2] and r.cache_info()["hits"] >= 1
    rng = random.Random(4)
    for _ in range(300):
        assert not r.valid("John 1:1" + "".join(rng.choice("!@#$%^&*()+=[]{}|<>?/~") for _ in range(3)))
    assert expand_verses("3,1-4,4") == [3, 1, 2, 4]
    assert r.aliases.dump("kjv")["gen"] == {"book_number": "1"}
    with pytest.raises(ValueError):
        r.aliases.dump("none")


def test_alias_catalogue(spark, tmp_path):
    a = AliasBook.from_table(alias_catalogue(spark, fixture.put_aliases(tmp_path)))
    assert a.names == AliasBook(fixture.alias_rows()).names


def chapter(doc):
    return doc["books"][0]["chapters"][0]


BREAK = {
    "V2": lambda d: d.update(books={}), "V3": lambda d: d.update(books=[]), "V4": lambda d: d["books"][0].update(nr=True), "V5": lambda d: d["books"][1].update(nr=1), "V6": lambda d: d["books"][0].update(chapters=[]),
    "V7": lambda d: chapter(d).update(chapter=1001), "V8": lambda d: d["books"][0]["chapters"].append(copy.deepcopy(chapter(d))), "V9": lambda d: chapter(d).update(verses=[]),
    "V10": lambda d: chapter(d)["verses"][0].update(verse="1"), "V11": lambda d: chapter(d)["verses"][0].update(chapter=999), "V12": lambda d: chapter(d)["verses"][0].update(verse=2),
    "V16": lambda d: d.update(translation=" "), "V17": lambda d: d["books"][0].update({"k" * 129: 1}), "V18": lambda d: chapter(d)["verses"][0].update(deep=[[[[[[[[[[1]]]]]]]]]]),
}


@pytest.mark.parametrize("rule", sorted(BREAK))
def test_constraints(spark, tmp_path, rule):
    doc = copy.deepcopy(fixture.TINY)
    BREAK[rule](doc)
    (tmp_path / "tiny.json").write_text(json.dumps(doc), "utf-8")
    t = translations(spark, str(tmp_path)).cache()
    rules = {r["rule"] for r in validate.raw_violations(t).collect()} | {r["rule"] for r in validate.nested_violations(t).collect()}
    assert rule in rules
    from pericope.sources.store import check_translation

    with pytest.raises(p.CorpusIntegrityError):
        check_translation(json.dumps(doc).encode(), "tiny")


def test_no_violations(spark, tmp_path):
    (tmp_path / "tiny.json").write_text(json.dumps(fixture.TINY), "utf-8")
    t = translations(spark, str(tmp_path))
    assert not validate.raw_violations(t).count() and not validate.nested_violations(t).count()
    assert checksum_faults(t, checksums(spark, str(tmp_path))).count() == 1
    assert validate.structure_faults("{") == [("V1", "not JSON")] and validate.structure_faults(None)[0][0] == "V1"


def test_repository(tmp_path):
    fixture.put(tmp_path)
    r = Repository(str(tmp_path))
    assert r.fetch_json("tiny/books.json")["1"]["name"] == "Genesis"
    for bad in ("../x", "/etc/passwd", "a/./b", "a b", "", "a//b", "%2e"):
        with pytest.raises(ValueError):
            r.fetch_bytes(bad)
    with pytest.raises(p.RepositoryResourceNotFound):
        r.fetch_bytes("none.json")
    with pytest.raises(p.RepositoryResponseTooLarge):
        Repository(str(tmp_path), max_response_bytes=10).fetch_bytes("tiny.json")
    (tmp_path / "v2" / "bad.json").write_bytes(b"\xff")
    with pytest.raises(p.RepositoryResponseError):
        r.fetch_text("bad.json")


@pytest.fixture
def server(tmp_path):
    fixture.put(tmp_path / "web")

    class Quiet(SimpleHTTPRequestHandler):
        def __init__(self, *a, **k):
            super().__init__(*a, directory=str(tmp_path / "web"), **k)

        def log_message(self, *a):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Quiet)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_http(spark, server, tmp_path):
    local, remote = Repository(str(tmp_path / "web")), Repository(server)
    assert local.fetch_bytes("tiny.json") == remote.fetch_bytes("tiny.json")
    with pytest.raises(p.RepositoryResourceNotFound):
        remote.fetch_bytes("none.json")
    with pytest.raises(p.RepositoryResponseTooLarge):
        Repository(server, max_response_bytes=10).fetch_bytes("tiny.json")
    from pericope.sources.http import HttpFiles

    spark.dataSource.register(HttpFiles)
    rows = {r["path"]: r for r in spark.read.format("httpfiles").option("base", server).option("paths", "tiny.json,none.json").load().collect()}
    assert bytes(rows["tiny.json"]["content"]) == local.fetch_bytes("tiny.json") and "NotFound" in rows["none.json"]["error"]


def test_kept_connections(tmp_path):
    """One connection serves many files; a server that closed it is asked anew; other statuses, moves and faults are told apart."""
    fixture.put(tmp_path)
    opened, failing = [], []

    class Kept(SimpleHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def __init__(self, *a, **k):
            opened.append(1)
            super().__init__(*a, directory=str(tmp_path), **k)

        def log_message(self, *a):
            pass

        def do_GET(self):
            if self.path == "/v2/moved.json":
                self.send_response(302)
                self.send_header("Location", "/v2/tiny.json")
                self.send_header("Content-Length", "0")
                self.end_headers()
            elif self.path == "/v2/busy.json" and len(failing) < 2:
                failing.append(1)
                self.send_error(503)
            elif self.path == "/v2/closed.json":
                self.path = "/v2/tiny.json"
                super().do_GET()
                self.close_connection = True
            else:
                self.path = self.path.replace("busy", "tiny")
                super().do_GET()

    s = ThreadingHTTPServer(("127.0.0.1", 0), Kept)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    try:
        with Repository(f"http://127.0.0.1:{s.server_port}", backoff=0.01) as r:
            whole = r.fetch_bytes("tiny.json")
            for _ in range(5):
                assert r.fetch_bytes("tiny.json") == whole
            assert len(opened) == 1
            assert r.fetch_bytes("closed.json") == whole == r.fetch_bytes("tiny.json") and len(opened) == 2
            assert r.fetch_bytes("moved.json") == whole and r.fetch_bytes("busy.json") == whole and len(failing) == 2
            with pytest.raises(p.RepositoryResourceNotFound):
                r.fetch_bytes("none.json")
    finally:
        s.shutdown()
    with pytest.raises(p.RepositoryError):
        Repository("http://127.0.0.1:9", retries=0).fetch_bytes("tiny.json")


def test_snapshots(spark, tmp_path):
    src, store = tmp_path / "source", str(tmp_path / "store")
    fixture.put(src)
    now = [1000.0]
    limits = p.SearchLimits(deadline_seconds=120.0)
    purged = []
    e = p.VerseEngine(spark, str(src), AliasBook(fixture.alias_rows()), store, search_limits=limits, purge=purged.append)
    e.store.clock = lambda: now[0]
    first = e.search("river", "tiny")["query"]
    assert first["total"] == 1 and not first["cache"]["stale"]
    # a broken source leaves the last known good snapshot in use
    bad = copy.deepcopy(fixture.TINY)
    chapter(bad)["verses"][0]["chapter"] = 999
    fixture.put(src, bad)
    now[0] += 1e6
    r = e.search("river", "tiny")["query"]
    assert r["cache"]["stale"] and r["sha"] == first["sha"]
    e.store.strict = True
    with pytest.raises(p.CorpusIntegrityError):
        e.search("river", "tiny")
    e.store.strict = False
    fixture.put(src, sha="0" * 40)
    assert e.search("river", "tiny")["query"]["cache"]["stale"]
    # a new text is seen after a transition, even while the old one is fresh
    doc = copy.deepcopy(fixture.TINY)
    chapter(doc)["verses"][1]["text"] = "The stream ran."
    chapter(doc)["verses"][1]["note"] = {"kept": [1, 2]}
    fixture.put(src, doc)
    with e.source_operation() as g:
        assert g.generation == 0
        with e.source_operation(), pytest.raises(RuntimeError):
            e.transition_source("two")
    assert e.transition_source("two").generation == 1 and e.transition_source("two").generation == 1 and len(purged) == 1
    r = e.search("stream", "tiny")
    assert r["query"]["total"] == 1 and r["results"]["tiny_1_1"]["verses"][0]["note"] == {"kept": [1, 2]}
    # a failing purge changes nothing
    e.purge = lambda g: 1 / 0
    with pytest.raises(ZeroDivisionError):
        e.transition_source("three")
    assert e.store.generation().revision == "two"
    with pytest.raises(p.CorpusIntegrityError):
        e.transition_source("a\nb")
    # a second engine starts from disk
    other = p.VerseEngine(spark, str(src), store=store, search_limits=limits)
    other.store.clock = lambda: now[0]
    assert other.search("stream", "tiny")["query"]["sha"] == r["query"]["sha"] and other.store.counters["disk_hits"] == 1
    # an index of other books is refused
    index = fixture.index_of(doc)
    index["1"]["name"] = "Another"
    fixture.put(src, doc, index=index)
    with pytest.raises(p.CorpusIntegrityError):
        p.VerseEngine(spark, str(src), store=str(tmp_path / "new"), search_limits=limits).search("river", "tiny")


def test_streaming(spark, tmp_path):
    """Files without a fault are indexed once; the others leave their faults and no verse."""
    from pericope.streaming.ingest import keep_indexed, keep_rejected

    src = tmp_path / "in"
    src.mkdir()
    (src / "tiny.json").write_text(json.dumps(fixture.TINY), "utf-8")
    bad = copy.deepcopy(fixture.TINY)
    chapter(bad)["verses"][0]["chapter"] = 9
    chapter(bad)["verses"].append(copy.deepcopy(chapter(bad)["verses"][1]))
    (src / "bad.json").write_text(json.dumps(bad), "utf-8")
    (src / "worse.json").write_text("{", "utf-8")
    for more in (9, 9, 18):
        if more == 18:
            (src / "other.json").write_text(json.dumps(fixture.TINY | {"abbreviation": "other"}), "utf-8")
        keep_indexed(spark, str(src), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        keep_rejected(spark, str(src), str(tmp_path / "rejects"), str(tmp_path / "check2")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == more
        r = {(x["file"].rsplit("/", 1)[1], x["rule"]) for x in spark.read.parquet(str(tmp_path / "rejects")).collect()}
        assert r == {("bad.json", "V11"), ("bad.json", "V12"), ("worse.json", "V1")}


def test_large_files_fail_the_query(spark, tmp_path):
    from pericope.sources.repository import large_files, raw_files

    (tmp_path / "a.json").write_text("{}")
    (tmp_path / "b.json").write_text("x" * 50)
    assert raw_files(spark, str(tmp_path)).count() == 2
    assert [r["length"] for r in large_files(spark, str(tmp_path), max_bytes=10).collect()] == [50]
    with pytest.raises(Exception, match="is over 10 bytes"):
        raw_files(spark, str(tmp_path), max_bytes=10).collect()


def test_chapter_files(spark, tmp_path):
    """Selections read chapters by their own files, with checksums, checks, open fields and a bounded cache."""
    doc = copy.deepcopy(fixture.TINY)
    chapter(doc)["note"] = {"kept": [1]}
    chapter(doc)["verses"][0]["extra"] = "e"
    fixture.put(tmp_path / "src", doc)
    (tmp_path / "src/v2/tiny.json").unlink()  # the translation's own file isn't needed
    with p.VerseEngine(spark, str(tmp_path / "src"), store=str(tmp_path / "store"), chapter_limit=1) as e:
        got = e.select("Gen 1:1-2;Genesis 1:2", "tiny")
        assert got["tiny_1_1"]["note"] == {"kept": [1]} and [v.get("extra") for v in got["tiny_1_1"]["verses"]] == ["e", None] and got["tiny_1_1"]["ref"] == ["Gen 1:1-2", "Genesis 1:2"]
        got["tiny_1_1"]["note"]["kept"].append(2)
        got["tiny_1_1"]["verses"][0]["text"] = "changed"
        again = e.select("Gen 1:1", "tiny")["tiny_1_1"]
        assert again["note"] == {"kept": [1]} and again["verses"][0]["text"].startswith("In the")
        e.select("Matt 1:1", "tiny")
        info = e.cache_info()["chapters"]
        assert (info["size"], info["limit"], info["evictions"]) == (1, 1, 1) and info["hits"] >= 1
        with pytest.raises(FileNotFoundError):
            e.select("Exodus 1:1", "tiny")
    fixture.put_chapters(tmp_path / "src", doc, sha="0" * 40)
    with pytest.raises(p.CorpusIntegrityError):
        p.VerseEngine(spark, str(tmp_path / "src"), store=str(tmp_path / "store")).select("Gen 1", "tiny")
    for f in (tmp_path / "src/v2/tiny").rglob("*.sha"):
        f.unlink()
    assert p.VerseEngine(spark, str(tmp_path / "src"), store=str(tmp_path / "store"), chapter_limit=0).select("Gen 1", "tiny")
    with pytest.raises(p.RepositoryError):
        p.VerseEngine(spark, str(tmp_path / "src"), store=str(tmp_path / "store"), require_checksum=True).select("Gen 1", "tiny")
    from pericope.sources.repository import chapter_files

    c = chapter_files(spark, str(tmp_path / "src/v2"))
    assert {(r["abbreviation"], r["book_nr"], r["chapter"]) for r in c.collect()} == {("tiny", 1, 1), ("tiny", 40, 1), ("tiny", 67, 1)}
    assert validate.chapter_violations(c).count() == 0 and validate.sound_chapters(c).count() == 3


@pytest.mark.parametrize(
    "change, fault",
    [
        (lambda c: c.update(abbreviation="x"), "abbreviation"), (lambda c: c.update(book_nr=2), "book_nr"), (lambda c: c.update(chapter=True), "chapter"), (lambda c: c.update(book_name=" "), "book_name"), (lambda c: c.update(name=5), "name"),
        (lambda c: c.update(verses=[]), "verses"), (lambda c: c.update(verses={}), "verses"), (lambda c: c.update(lang=1), "lang"), (lambda c: c["verses"][0].update(text=None), "verse"), (lambda c: c["verses"][0].update(chapter=2), "verse of another chapter"),
        (lambda c: c["verses"][1].update(verse=1), "repeated verse"), (lambda c: c.update({"k" * 129: 1}), "key too long or empty"), (lambda c: c["verses"][0].update(x=float("inf")), "number out of range"), (lambda c: None, None),
    ],
)
def test_chapter_fault(change, fault):
    _, c = next(fixture.chapters_of(copy.deepcopy(fixture.TINY)))
    change(c)
    assert validate.chapter_fault(json.dumps(c), "tiny", 1, 1) == fault
    assert validate.chapter_fault("[]", "tiny", 1, 1) == validate.chapter_fault(None, "tiny", 1, 1) == "not JSON"


def test_chapter_limits():
    def fault(limits=validate.ChapterLimits(), verses=((1, "x"),), chapter=1):
        doc = {"abbreviation": "t", "book_nr": 1, "book_name": "B", "chapter": chapter, "name": "B", "verses": [{"chapter": chapter, "verse": v, "name": "B", "text": t} for v, t in verses]}
        return validate.chapter_fault(json.dumps(doc), "t", 1, chapter, limits)

    over = [("chapter", {"chapter": 1001}), ("verse", {"verses": ((2001, "x"),)}), ("verses", {"verses": [(i + 1, "x") for i in range(501)]}), ("verse", {"verses": ((1, "x" * (validate.MAX_TEXT + 1)),)})]
    for name, doc in over:
        assert fault(**doc) == name and fault(validate.NO_LIMITS, **doc) is None
    assert fault(validate.NO_LIMITS, verses=((0, "x"),)) == "verse" and fault(validate.NO_LIMITS, verses=()) == "verses"


def test_default_names(spark, tmp_path):
    a = AliasBook.default()
    r = ReferenceParser(a)
    for name, book in (("Genesis", 1), ("Ps", 19), ("1 John", 62), ("First Samuel", 9), ("song of songs", 22), ("John", 43), ("Rev", 66), ("4 Macc", 83), ("Sirach", 74)):
        assert r.ref(f"{name} 3:16").book == book
    assert len({b for _, _, b in __import__("pericope.plans.names", fromlist=["x"]).english("kjv")}) == 83
    out = a.dump("kjv", tmp_path / "names.json")
    assert json.loads((tmp_path / "names.json").read_text("utf-8")) == out and out["gen"] == {"book_number": "1"}


def test_caches_and_locks():
    from pericope.plans.caches import KeyedLocks, Recent

    gone = []
    c = Recent(2, gone.append)
    for k in "abc":
        c.put(k, k.upper())
    assert gone == ["A"] and c.get("a") is None and c.get("b") == "B" and c.info()["evictions"] == 1
    c.put("d", "D")
    assert gone == ["A", "C"] and c.keys() == ["b", "d"]
    assert not Recent(0).put("x", 1) and Recent(None).put("x", 1)
    with pytest.raises(ValueError):
        Recent(-1)
    locks, order, entered = KeyedLocks(), [], threading.Event()

    def slow():
        with locks.hold("slow"):
            entered.set()
            entered2.wait(10)
            order.append("slow")

    entered2 = threading.Event()
    t = threading.Thread(target=slow)
    t.start()
    entered.wait(10)
    with locks.hold("quick"), locks.hold("quick"):  # isn't kept by the other key, and may nest
        order.append("quick")

    def wait():
        with locks.hold("slow"):
            order.append("second")

    second = threading.Thread(target=wait)
    second.start()
    entered2.set()
    t.join()
    second.join()
    assert order == ["quick", "slow", "second"] and len(locks) == 0


def test_limits_and_unkept_corpora(spark, tmp_path):
    fixture.put(tmp_path / "src")
    e = p.VerseEngine(spark, str(tmp_path / "src"), store=str(tmp_path / "store"), request_limits=p.RequestLimits(max_search_offset=5, max_search_books=1, max_search_exclusions=1), corpus_limit=0, books_limit=0, snapshot_limit=0)
    with pytest.raises(p.SearchLimitError):
        e.search("faith", "tiny", {"offset": 6})
    with pytest.raises(p.SearchLimitError):
        e.search("faith", "tiny", {"books": (1, 40)})
    e.search_limits = dataclasses.replace(e.search_limits, deadline_seconds=120.0)
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    assert e.search("faith", "tiny")["query"]["total"] == 3 and e.search("faith", "tiny", {"books": (40,)})["query"]["total"] == 2
    info = e.cache_info()
    assert info["corpora"]["size"] == info["books"]["size"] == info["translations"]["size"] == 0 and len(spark.sparkContext._jsc.getPersistentRDDs()) <= before
    assert e.search("none of these", "tiny", {"words": "any"})["query"]["total"] == e.search("of", "tiny")["query"]["total"] == 1


@pytest.mark.parametrize("spec", [{}, {"words": "any"}, {"match": "substring"}, {"words": "phrase"}, {"proximity": 1}, {"exclude": ("of the",)}])
def test_plan_of_a_search(spark, spec):
    """Texts are normalised and cut into tokens once, and simple ones don't go through Python."""
    from pericope.operators import match

    v = spark.createDataFrame([("t", 1, 1, 1, "x")], "abbreviation string, book_nr int, chapter int, verse int, text string")
    plan = match.search(v, analyse("and the", p.SearchSpec(**spec)))._jdf.queryExecution().executedPlan().toString()
    body = plan.split("\n")
    # counting a phrase is a pattern of its own
    assert sum(x.count("regexp_extract_all(") for x in body) == 1 + (spec.get("words") == "phrase")
    assert sum("ArrowEvalPython" in x for x in body) == 1
    # the simple branch: from the union's first child to its scan, there is no Python
    first = plan[plan.index("Union") :].split("ArrowEvalPython")[0]
    assert first.count("Scan") >= 1


def test_proximity_by_brute_force(spark):
    from pyspark.sql import functions as F

    from pericope.operators import match

    rng = random.Random(8)
    rows = [(i, [rng.choice("abcdexyz") for _ in range(rng.randrange(0, 14))]) for i in range(150)]
    d = spark.createDataFrame(rows, "i int, tokens array<string>")
    for terms, gap in ((("a",), 0), (("a", "b"), 0), (("b", "a"), 2), (("a", "b", "c"), 1), (("a", "b", "c"), 5)):
        got = {r["i"] for r in d.where(match.near(terms, gap)).select("i").collect()}
        want = {i for i, t in rows if any(set(terms) <= set(t[a : a + n]) for n in range(len(terms), len(terms) + gap + 1) for a in range(len(t)))}
        assert got == want
    assert d.where(F.lit(False)).count() == 0


def test_search_before_tokens(spark):
    """The test before exact normalisation loses nothing, whatever the characters."""
    from pericope.operators import index, match

    texts = ["The CAFÉ", "the café", "THE CAFE", "ΣΟΦΟΣ the", "σοφος The", "the ﬁne cafe", "STRASSE the", "straße The", None, "", "İthe", "the the"]
    v = spark.createDataFrame([("t", 1, 1, i, x) for i, x in enumerate(texts)], "abbreviation string, book_nr int, chapter int, verse int, text string")
    for q, spec in (("the", {}), ("the café", {"words": "any"}), ("CAFE the", {"diacritics": "insensitive"}), ("σοφοσ", {}), ("strasse", {}), ("fine", {}), ("The", {"case_sensitive": True}), ("the cafe", {"words": "phrase"}), ("the", {"match": "substring"}), ("e caf", {"match": "substring", "words": "phrase"})):
        a = analyse(q, p.SearchSpec(**spec))
        key = lambda d: sorted((r["verse"], r["score"]) for r in d.collect())
        assert key(match.search(v, a)) == key(match.hits(index.with_tokens(v, a.spec.case_sensitive, a.spec.diacritics), a))

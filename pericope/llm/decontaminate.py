"""Benchmark decontamination as a prefix-filtered containment join of shingles.

A shingle is a run of `n` words of the lower-cased text (all words of an item
with fewer). A document holds an item if, in some window as long as the item,
at least ceil(threshold * S) of the item's S distinct shingles occur.

1. One scan of the documents keeps the shingles whose fingerprint is in a Bloom
   filter of the items' shingles, of 32 bits for each up to a bound: few rows,
   with their text.
2. Each item's shingles are ordered by how often they occur in the corpus. Any
   window with `need` of S shingles holds one of the rarest S - need + 1: only
   this prefix is joined with the documents' shingles.
3. A candidate stays if the document is long enough (length bound) and enough
   shingles lie within one item length of the hit (positional bound).
4. Exact containment, on the shingles' text, over the item-sized windows that
   begin at a matched shingle; a best window can always be moved to such a one.

Nothing is broadcast by hand but the filter, of 64 MB at most: the joins are
plain joins. Only documents with a candidate go on to the exact step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pericope.llm.shared import CHUNK, cut, ngrams, only, pieces, spans, utf8, without, words

N, THRESHOLD = 5, 0.8
#: Logarithms of how many bits the filter has: enough for few items; for more than 16 million shingles it stays as it is and lets more through, which costs rows but no result.
_LEAST_BITS, _MOST_BITS = 20, 29


def _probes(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << bits) - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(bits)) & mask).astype(np.int64)


def _passes(known: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    """Which fingerprints the filter, packed in bytes, lets through."""
    p, q = _probes(h, bits)
    return (known[p >> 3] >> (p & 7) & known[q >> 3] >> (q & 7) & 1).astype(bool)


def _item_shingles(n: int):
    """(item_id, size, words, spots, h, shingle): one row per distinct shingle of an item; spots: shingle positions in the item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8(b.column(1))
            row, start, end, h = words(data, off)
            ids, out = b.column(0).to_pylist(), []
            lo = np.searchsorted(row, np.arange(len(ids) + 1))
            raw = data.tobytes()
            for i, item in enumerate(ids):
                a, z = int(lo[i]), int(lo[i + 1])
                if a == z or item is None:
                    continue
                k = min(n, z - a)
                toks = [raw[start[j] : end[j]].decode("utf-8", "replace") for j in range(a, z)]
                _, g = ngrams(row[a:z], h[a:z], k)
                seen = {}
                for j in range(z - a - k + 1):
                    seen.setdefault(" ".join(toks[j : j + k]), int(g[j].astype(np.int64)))
                out += [(item, k, z - a - k + 1, x, s) for s, x in seen.items()]
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string()))], ["item_id", "size", "spots", "h", "shingle"]
            )

    return run


def _bitmap(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((1 << bits) // 8, np.uint8)
        for b in batches:
            for p in _probes(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), bits):
                np.bitwise_or.at(out, p >> 3, (1 << (p & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["bits"])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = None
    for b in batches:
        for x in b.column(0):
            own = np.frombuffer(x.as_py(), np.uint8)
            out = own.copy() if out is None else np.bitwise_or(out, own, out=out)
    if out is not None:
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["bits"])


_HITS = "doc_id long, text_key long, size int, spots int, pos int, shingle string"


def _doc_hits(known: bytes, bits: int, sizes: list[int]):
    """The shingles of the documents that pass the filter. text_key tells rows with one id and several texts apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(known, np.uint8)
        for b in pieces(batches, 1):
            data, off = utf8(b.column(1))
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for lo, hi in spans(off, CHUNK):
                o = off[lo : hi + 1] - off[lo]
                text = data[off[lo] : off[hi]]
                row, start, end, h = words(text, o)
                first = np.searchsorted(row, np.arange(hi - lo + 1))
                total = np.zeros(len(h) + 1, np.uint64)
                np.cumsum(h * (np.arange(len(h), dtype=np.uint64) - first[row].astype(np.uint64) + np.uint64(1)), out=total[1:])
                key = (total[first[1:]] - total[first[:-1]]).view(np.int64)
                raw = text.tobytes()
                for k in sizes:
                    at, g = ngrams(row, h, k)
                    hit = at[_passes(table, g, bits)]
                    if not len(hit):
                        continue
                    r = row[hit]
                    a, z = (x[hit[:, None] + np.arange(k)].tolist() for x in (start, end))
                    shingle = [" ".join([raw[i:j].decode("utf-8", "replace") for i, j in zip(x, y)]) for x, y in zip(a, z)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[lo + r], pa.int64()), pa.array(key[r]), pa.array(np.full(len(r), k), pa.int32()), pa.array(first[r + 1] - first[r] - k + 1, pa.int32()), pa.array(hit - first[r], pa.int32()), pa.array(shingle, pa.string())],
                        ["doc_id", "text_key", "size", "spots", "pos", "shingle"],
                    )

    return run


def contained(
    docs: DataFrame, items: DataFrame, n: int = N, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """One row per document and item that it holds: (doc_id, item_id, matched, shingles, containment).

    matched is the largest number of the item's distinct shingles in one
    window, shingles their number, containment the quotient, rounded to 6 places.

    Null or empty texts, and texts without a word, hold nothing and are held
    nowhere; texts of any length are read whole. Rows with a null id can't be
    named and give no result; ids have to be of whole numbers, else a TypeError.
    Of equally good windows it doesn't matter which is taken. Repeated rows count once; rows with one id and different
    texts are looked at separately and give the best of them. Items with equal
    texts are each found. Other columns are ignored. Either table may be empty.
    """
    d = only(docs, doc_id=id_col, text=text_col).where("doc_id is not null and text is not null").select("doc_id", F.lower("text").alias("text"))
    it = only(items, item_id=item_id, text=item_text).where("item_id is not null and text is not null").select("item_id", F.lower("text").alias("text"))
    # an id that several texts share stands for each of them: a copy number tells them apart
    it = it.distinct().withColumn("v", F.row_number().over(W.partitionBy("item_id").orderBy("text")))
    named = it.select(F.struct("item_id", "v").alias("k"), "text").withColumn("n", F.xxhash64("k"))
    s = cut(named.select("n", "text").mapInArrow(_item_shingles(n), "item_id long, size int, spots int, h long, shingle string"))
    sizes = {r["size"]: r["count"] for r in s.groupBy("size").count().collect()}  # n sizes at most
    bits = min(_MOST_BITS, max(_LEAST_BITS, (32 * sum(sizes.values())).bit_length()))
    known = s.select("h").mapInArrow(_bitmap(bits), "bits binary").coalesce(1).mapInArrow(_merge, "bits binary").collect()
    hits = cut(d.mapInArrow(_doc_hits(bytes(known[0]["bits"]) if known else bytes((1 << bits) // 8), bits, sorted(sizes)), _HITS))

    seen = hits.groupBy("shingle").agg(F.count(F.lit(1)).alias("freq"))
    by = W.partitionBy("item_id")
    ranked = (
        s.join(seen, "shingle", "left")
        .withColumn("rank", F.row_number().over(by.orderBy(F.coalesce("freq", F.lit(0)), "shingle")))
        .withColumn("total", F.count(F.lit(1)).over(by))
        .withColumn("need", F.ceil(F.col("total") * F.lit(threshold) - F.lit(1e-9)))
        .select("item_id", "size", F.col("spots").alias("width"), "shingle", "rank", "total", "need")
    )
    prefix = ranked.where("rank <= total - need + 1")
    found = hits.join(prefix, ["shingle", "size"]).where("spots >= need and least(pos + width, spots) - greatest(pos - width + 1, 0) >= need")
    candidates = found.select("doc_id", "text_key", "item_id").distinct()
    # first the hits of documents with a candidate, then only shingles of the candidate item
    m = (
        hits.join(candidates, ["doc_id", "text_key"])
        .join(ranked.drop("rank"), ["item_id", "shingle", "size"])
        .select("doc_id", "text_key", "item_id", "pos", "shingle", "width", "total", "need", F.expr("pos div width").alias("cell"))
    )
    m = cut(m)
    # a window from `pos` lies in the cell of pos and the next one
    at = m.select("doc_id", "text_key", "item_id", F.col("pos").alias("from"), "width", "total", "need", F.explode(F.array("cell", F.col("cell") + 1)).alias("cell")).distinct()
    inside = at.join(m.select("doc_id", "text_key", "item_id", "cell", "pos", "shingle"), ["doc_id", "text_key", "item_id", "cell"]).where("pos >= `from` and pos < `from` + width")
    best = (
        inside.groupBy("doc_id", "text_key", "item_id", "from", "total", "need")
        .agg(F.countDistinct("shingle").alias("matched"))
        .where("matched >= need")
        .select(F.col("item_id").alias("n"), "doc_id", "matched", "total")
    )
    return (
        best.join(named.select("n", F.col("k.item_id").alias("item_id")), "n")
        .groupBy("doc_id", "item_id")
        .agg(F.max_by(F.struct("matched", "total"), F.struct(F.col("matched") / F.col("total"), F.col("matched"))).alias("b"))
        .select("doc_id", "item_id", F.col("b.matched").alias("matched"), F.col("b.total").alias("shingles"), F.round(F.col("b.matched") / F.col("b.total"), 6).alias("containment"))
    )


def remove(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs, all columns, that hold no item.

    Rows with a null id or a null or empty text stay, as nothing is found in
    them. Texts of any length are read whole. Rows are told apart by their id
    alone: repeated rows, and rows of one id with several texts, go together as
    soon as one of them holds an item. Empty tables are allowed: without items
    all rows stay. Other columns keep their names and values.
    """
    return without(docs, contained(docs, items, id_col=id_col, **options).select("doc_id"), id_col)


def sql(n: int = N, threshold: float = THRESHOLD, docs: str = "documents", items: str = "benchmark") -> str:
    """The join without prefixes, for item ids that are unique and items of n words or more."""
    words_of = "regexp_extract_all(lower(text), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
    grams = " || ' ' || ".join(f"w[i + {j}]" for j in range(1, n + 1))
    return f"""
WITH iw AS (SELECT item_id, {words_of} AS w FROM {items}),
ia AS (SELECT item_id, len(w) - {n - 1} AS width, w, unnest(range(0, len(w) - {n - 1})) AS i FROM iw WHERE len(w) >= {n}),
ig AS (SELECT DISTINCT item_id, width, {grams} AS g FROM ia),
it AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS total FROM ig),
dw AS (SELECT DISTINCT doc_id, {words_of} AS w FROM {docs}),
da AS (SELECT doc_id, w, unnest(range(0, len(w) - {n - 1})) AS i FROM dw WHERE len(w) >= {n}),
dg AS (SELECT doc_id, i, {grams} AS g FROM da WHERE {grams} IN (SELECT g FROM ig)),
m AS (SELECT DISTINCT doc_id, item_id, i, g, width, total FROM dg JOIN it USING (g)),
c AS (SELECT a.doc_id, a.item_id, a.i, a.total, count(DISTINCT b.g) AS matched FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND b.i >= a.i AND b.i < a.i + a.width GROUP BY ALL)
SELECT doc_id, item_id, max(matched) AS matched, total AS shingles, round(max(matched) / total, 6) AS containment
FROM c GROUP BY doc_id, item_id, total HAVING max(matched) >= ceil({threshold} * total - 1e-9)"""

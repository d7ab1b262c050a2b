"""Harmonic packing of token sequences into bins of one capacity.

A sequence of length l belongs to reciprocal-capacity class j = min(K, C // l),
that is C/(j+1) < l <= C/j; the last class also takes everything shorter. A bin
of class j holds j sequences, which fit because each is at most C/j long. No
bin depends on another bin's fill, so every shard of the table numbers its own
bins and no step orders the whole corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pericope.llm.shared import only

CAPACITY, CLASSES, SHARD_ROWS = 8192, 64, 50_000


def shards(rows: int, shard_rows: int = SHARD_ROWS) -> int:
    """How many shards a table of so many rows is packed in."""
    return max(1, -(-rows // shard_rows))


def pack(docs: DataFrame, capacity: int = CAPACITY, classes: int = CLASSES, shard_rows: int = SHARD_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, class, shard, bin, slot).

    Lengths are counted in byte-level tokens: one per UTF-8 byte. A text longer
    than the capacity is cut into pieces of exactly the capacity and a rest, so
    no token is lost; piece counts from 0 and start is the piece's first token.
    Within a shard and class, pieces are taken in the order of doc_id and piece;
    (shard, class, bin) names a bin and slot a place in it. Only a shard's last
    bin of a class can be short.

    Null and empty texts have no tokens and give no row. A null doc_id stays
    null; such rows are dealt out to the shards by length and piece. Repeated rows are packed each; equal
    ids tie by length and are then interchangeable. Texts of any length are
    packed whole. An empty table gives an empty result. Other columns are
    ignored, whatever their names. Ids have to be of whole numbers, else a
    TypeError.
    """
    d = only(docs, doc_id=id_col, text=text_col).select("doc_id", F.octet_length("text").cast("long").alias("n")).where("n > 0")
    n_shards = shards(only(docs, doc_id=id_col).count(), shard_rows)
    pieces = d.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.expr(f"int((n - 1) div {capacity}L)"))).alias("piece"))
    pieces = pieces.select(
        "doc_id",
        "piece",
        (F.col("piece").cast("long") * capacity).alias("start"),
        F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("piece").cast("long") * capacity).alias("length"),
    ).withColumns(
        {
            "class": F.least(F.lit(classes).cast("long"), F.expr(f"{capacity}L div length")),
            "shard": F.pmod(F.coalesce("doc_id", F.col("length") + F.col("piece")), F.lit(n_shards)).cast("long"),
        }
    )
    rank = F.row_number().over(W.partitionBy("shard", "class").orderBy("doc_id", "piece", "length")).cast("long") - 1
    return pieces.withColumn("rank", rank).select(
        "doc_id", "piece", "start", "length", "class", "shard", F.expr("rank div class").alias("bin"), F.expr("rank % class").alias("slot")
    )


def sql(capacity: int = CAPACITY, classes: int = CLASSES, shard_rows: int = SHARD_ROWS, table: str = "documents") -> str:
    return f"""
WITH d AS (SELECT doc_id, strlen(text) AS n FROM {table} WHERE strlen(text) > 0),
s AS (SELECT greatest(1, (count(*) + {shard_rows - 1}) // {shard_rows}) AS n_shards FROM {table}),
p AS (SELECT doc_id, n, unnest(range(0, (n - 1) // {capacity} + 1)) AS piece FROM d),
q AS (SELECT doc_id, piece, piece * {capacity} AS start, least({capacity}, n - piece * {capacity}) AS length FROM p),
r AS (SELECT doc_id, piece, start, length, least({classes}, {capacity} // length) AS class, coalesce(doc_id, length + piece) % n_shards AS shard FROM q, s),
t AS (SELECT *, row_number() OVER (PARTITION BY shard, class ORDER BY doc_id NULLS FIRST, piece, length) - 1 AS rank FROM r)
SELECT doc_id, CAST(piece AS INTEGER) AS piece, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(class AS BIGINT) AS class,
  CAST(shard AS BIGINT) AS shard, CAST(rank // class AS BIGINT) AS bin, CAST(rank % class AS BIGINT) AS slot FROM t"""

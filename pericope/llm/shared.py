"""What the operators of this folder share: input guards, cut tables, and numpy text kernels.

The kernels work on the UTF-8 buffers of Arrow string columns, a bounded number
of bytes at a time, so that neither a batch of many documents nor one very long
document decides how much memory a Python worker needs beyond that text itself.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import tempfile
import time
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one kernel call works on, unless one text is longer: few enough for what is made of them to stay in a core's cache.
CHUNK = 1 << 18


# --------------------------------------------------------------------------
# tables


#: Types that an id column may have.
WHOLE = ("tinyint", "smallint", "int", "bigint")


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under internal names, so that no other column can clash, not even one that differs in case alone.

    A column goes by its exact name, or, if there is none, by the only one that
    differs in case. A column that becomes `id` or ends in `_id` has to be of
    whole numbers and becomes a long; other types raise a TypeError.

    >>> only(docs, id="doc_id", text="text")  # doctest: +SKIP
    """
    names, kinds, out = df.columns, [k for _, k in df.dtypes], []
    for ours, theirs in columns.items():
        at = [i for i, x in enumerate(names) if x == theirs] or [i for i, x in enumerate(names) if x.lower() == theirs.lower()]
        if len(at) != 1:
            raise ValueError(f"{len(at)} columns are named {theirs}, of {names}")
        c = F.col(f"c{at[0]}")
        if ours == "id" or ours.endswith("_id"):
            if kinds[at[0]] not in (*WHOLE, "void"):
                raise TypeError(f"{theirs} has to be of whole numbers and is {kinds[at[0]]}")
            c = c.cast("long")
        out.append(c.alias(ours))
    return df.toDF(*[f"c{i}" for i in range(len(names))]).select(*out)


def in_place(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """df with its rows changed or left out by run, whose batches have the columns of df, in order, under other names: several may differ by case alone."""
    d = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return d.mapInArrow(run, d.schema).toDF(*df.columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or where that is unset (tests, local mode) a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "pericope-shared")


_cut: dict[int, str] = {}


def cut(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back.

    The plan that follows starts at files that outlive any executor, and every
    consumer of the result reads the same rows. The table goes with the process,
    or before, by release().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(drop, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    _cut[id(out)] = path
    weakref.finalize(out, _cut.pop, id(out), None)
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables that cut() made and that nothing is going to read any more, and lets Spark clear what the plans before them shuffled."""
    spark = None
    for df in tables:
        spark = df.sparkSession
        path = _cut.pop(id(df), None)
        if path:
            drop(spark, path)
    if spark is not None:
        gc.collect()  # Spark clears a shuffle's files once no plan refers to it
        spark.sparkContext._jvm.System.gc()


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared folder, if the session still runs."""
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    except Exception:  # the session ended before this process did
        pass


#: Ids of a checked number up to which they are broadcast.
BROADCAST_IDS = 500_000


def without(docs: DataFrame, ids: DataFrame, id_col: str, most: int = BROADCAST_IDS) -> DataFrame:
    """The rows of docs, all columns, whose id isn't among ids, a table of one column. Rows with a null id stay; rows of one id stay or go together.

    The ids are written and counted first. Up to `most` of them go to every
    executor, so that the texts stay where they are; beyond that the join
    shuffles.
    """
    out = cut(ids.toDF("__out").where("__out is not null").distinct())
    side = F.broadcast(out) if out.count() <= most else out
    names = docs.columns
    d = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = names.index(id_col) if id_col in names else [x.lower() for x in names].index(id_col.lower())
    return d.join(side, d[f"c{at}"] == out["__out"], "left_anti").toDF(*names)


def low_hash(by: Column, share: Column | float) -> Column:
    """Whether a long of even distribution is among the smallest `share` of all longs."""
    return by.cast("double") < F.lit(-(2.0**63)) + F.lit(2.0**64) * F.least(F.lit(1.0), share if isinstance(share, Column) else F.lit(share))


def sample(df: DataFrame, by: Column, rows: int) -> DataFrame:
    """At most `rows` rows of df: those with the smallest hash `by`, a long.

    A bound on the hash, from the number of rows, leaves about twice as many to
    be ordered, however many partitions there are. df should have few columns.
    """
    total = df.count()
    few = df.where(low_hash(by, 2 * rows / max(1, total)))
    if total > 2 * rows and few.count() < rows:  # the hash isn't even
        few = df
    return few.orderBy(by, *df.columns).limit(rows)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


# --------------------------------------------------------------------------
# memory of Python workers

#: Bytes of a text column that one piece of a batch has, unless one text is longer.
PIECE = 4 << 20
_tidied = [0.0]


def tidy() -> None:
    """Gives memory that is free back to the system, at most once a second: Spark keeps workers for other stages, beside which it would stay taken."""
    if time.monotonic() - _tidied[0] < 1:
        return
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not with every C library
        pass
    _tidied[0] = time.monotonic()


def pieces(batches: Iterator[pa.RecordBatch], column: int, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batches, in slices of about `most` bytes of a text or binary column, so that what is made of a batch needs little memory beside it."""
    for b in batches:
        if not b.num_rows:
            yield b
            continue
        _, off = utf8(b.column(column))
        for lo, hi in spans(off, most):
            yield b.slice(lo, hi - lo)
        tidy()


# --------------------------------------------------------------------------
# Arrow strings as bytes


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        wide = np.dtype(np.int32)
    else:
        wide = np.dtype(np.int64)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, off, data = column.buffers()
    n = len(column)
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(off, wide, n + 1, column.offset * wide.itemsize).astype(np.int64)
    first = int(offsets[0])
    size = int(offsets[-1]) - first
    raw = np.frombuffer(data, np.uint8, size, first) if size else np.zeros(0, np.uint8)
    return raw, offsets - first


def spans(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about `most` bytes: every row in exactly one, a longer row alone."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


# --------------------------------------------------------------------------
# words and their fingerprints

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_Q = np.uint64(0xD6E8FEB86659FD93 | 1)
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)

#: A word is a run of ASCII letters, ASCII digits and bytes beyond ASCII.
WORD = np.zeros(256, bool)
for _c in b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
    WORD[_c] = True
WORD[128:] = True
#: The same class for regular expressions over lower-cased text.
WORD_RE = "[0-9a-z\\x{80}-\\x{10FFFF}]+"

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) <= n:
        m = max(n + 1, CHUNK + 1)
        for i, base in enumerate((_P, _PINV)):
            a = np.full(m, base, np.uint64)
            a[0] = 1
            np.cumprod(a, out=a)
            _powers[i] = a
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the 64 bits."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, fingerprint) of every word, in text order.

    kind says which bytes belong to a word. A word never crosses two rows.
    """
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    w = np.zeros(n + 2, bool)
    w[1:-1] = kind[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    inner = edge & w[:-1] & w[1:]  # a row ends and the next begins inside a run
    change = w[1:] != w[:-1]
    start = np.flatnonzero((change & w[1:]) | inner)
    end = np.flatnonzero((change & w[:-1]) | inner)
    pw, inv = _pow(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * pw[:n], out=total[1:])
    h = mix((total[end] - total[start]) * inv[start] + (end - start).astype(np.uint64))
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets)))
    return row, start, end, h


def ngrams(row: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, fingerprint) of every run of n words within a row."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(row[:m] == row[n - 1 :])
    g = h[at].copy()
    for j in range(1, n):
        g *= _Q
        g += h[at + j]
    return at, mix(g)

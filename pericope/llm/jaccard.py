"""N-gram Jaccard join: which documents have word n-gram sets of Jaccard similarity >= t.

Rare-first prefix filtering with length, positional and suffix filters, joined
on prefix n-grams and verified once per pair. n-grams are 56-bit fingerprints.

1. Every stretch of documents is turned into sets of n-grams and sent, packed by
   fingerprint range, to the range's reducer: one binary row per stretch and
   range instead of one row per n-gram. Ranges are of a fixed size, so their
   number follows the input.
2. The reducer counts in how many documents each n-gram occurs and sends back
   those that occur in two or more, with a rarity class (a function of the
   count alone, so that (class, fingerprint) is one global order).
3. Per stretch the n-grams come together again. An n-gram of one document only
   can't match and precedes all others in the order: a document with fewer than
   ceil(t * size) shared n-grams has no partner and goes no further. Documents
   with equal sets go on as one.
4. Groups of edited copies would give a row for every pair of them, and a group
   may hold a third of the corpus. So sets that agree in the least of some
   hashes are compared with the most central one among them, and those within
   (1 - t) / 2 of it, in Jaccard distance, form its ball. The distance is a
   metric: any two sets of a ball have similarity t or more, and none of these
   pairs is ever listed. A set that is near no other's centre is a ball itself.
5. Balls are joined on the prefix n-grams of their sets, with length and
   positional filters over what a ball holds. Where two prefixes have the same
   n-gram before a match, they have matched already and the match is left out,
   so a pair comes up about once.
6. Pairs of balls are gathered with their sets by neighbourhood, so a set moves
   once per neighbourhood and not once per pair. The suffix filter bounds the
   overlap behind the first match by halving both suffixes again and again; what
   is left is intersected exactly. Two balls of many sets are multiplied as
   matrices, in blocks of sets.

What comes out is linear in the documents: the class and the number of links of
each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pericope.llm.shared import cut, mix, ngrams, only, release, shuffle_partitions, spans, tidy, utf8, without, words

#: Half of all n-grams: copies that were edited throughout share more, documents that quote one passage less.
N, THRESHOLD = 3, 0.5
_BITS = 56
_HASH = np.uint64((1 << _BITS) - 1)
_LOW = np.uint64(64 - _BITS)


def gram_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, fingerprint) of the distinct n-grams, by row; a row of fewer than n words has one gram of all its words."""
    rows, grams = [], []
    most = 1 << (64 - _BITS)
    for lo, hi in spans(offsets):
        while lo < hi:
            mid = min(hi, lo + most)
            o = offsets[lo : mid + 1] - offsets[lo]
            row, _, _, h = words(data[offsets[lo] : offsets[mid]], o)
            at, g = ngrams(row, h, n)
            key = [(row[at].astype(np.uint64) << np.uint64(_BITS)) | (g >> _LOW)]
            counts = np.bincount(row, minlength=mid - lo) if len(row) else np.zeros(mid - lo, np.int64)
            first = np.concatenate([[0], np.cumsum(counts)])
            for k in range(1, n):
                short = np.flatnonzero(counts == k)
                if len(short):
                    s = h[first[short]].copy()
                    for j in range(1, k):
                        s = mix(s * np.uint64(31) + h[first[short] + j])
                    key.append((short.astype(np.uint64) << np.uint64(_BITS)) | (mix(s + np.uint64(k)) >> _LOW))
            u = np.unique(np.concatenate(key))
            rows.append((u >> np.uint64(_BITS)).astype(np.int32) + lo)
            grams.append(u & _HASH)
            lo = mid
    z = np.zeros(0, np.int32)
    return (np.concatenate(rows), np.concatenate(grams)) if rows else (z, z.astype(np.uint64))


#: Bytes of text that one packed row per range is made of, and that one range has the n-grams of.
_STRETCH, _RANGE = 4 << 20, 8 << 20


def _pack(g: np.ndarray) -> bytes:
    """Fingerprints in 7 bytes each."""
    return np.ascontiguousarray(g.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()


def _unpack(x: bytes, n: int | None = None) -> np.ndarray:
    raw = np.frombuffer(x, np.uint8, -1 if n is None else 7 * n).reshape(-1, 7)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :7] = raw
    return out.view("<u8").ravel().astype(np.uint64, copy=False)


def _narrow(x: np.ndarray) -> tuple[int, bytes]:
    width = 1 if x.max(initial=0) < 1 << 8 else 2 if x.max() < 1 << 16 else 4
    return width, x.astype(f"<u{width}").tobytes()


def _pack_rows(row: np.ndarray, docs: int) -> bytes:
    """Ascending rows, 0 .. docs - 1, some often: a count for every row, or only for those that occur, whichever is shorter."""
    n = np.bincount(row, minlength=docs)
    width, all_ = _narrow(n)
    there = np.flatnonzero(n)
    step, steps = _narrow(np.diff(there, prepend=0))
    one, some = _narrow(n[there])
    if len(steps) + len(some) < len(all_):
        return bytes([step, one]) + len(there).to_bytes(4, "little") + steps + some
    return bytes([0, width]) + all_


def _unpack_rows(x: bytes) -> np.ndarray:
    """The rows that _pack_rows() packed."""
    step, width = x[0], x[1]
    if not step:
        n = np.frombuffer(x, f"<u{width}", -1, 2)
        return np.repeat(np.arange(len(n)), n)
    k = int.from_bytes(x[2:6], "little")
    there = np.cumsum(np.frombuffer(x, f"<u{step}", k, 6).astype(np.int64))
    return np.repeat(there, np.frombuffer(x, f"<u{width}", k, 6 + step * k))


_SENT = "part int, src long, rows binary, body binary"


def _batch(schema: str, *columns) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    fields = [x.strip().split() for x in schema.split(",")]
    return pa.Table.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def _send(n: int, parts: int):
    """One row per stretch and fingerprint range, and one with part -1 for what belongs to the documents themselves."""

    def batch(ids: np.ndarray, data: np.ndarray, off: np.ndarray, src: int) -> pa.RecordBatch:
        docs = len(ids)
        row, g = gram_sets(data, off, n)
        size = np.bincount(row, minlength=docs).astype(np.int32)
        start = np.concatenate([[0], np.cumsum(size)])
        total = np.zeros(len(g) + 1, np.uint64)
        np.cumsum(mix(g.copy()), out=total[1:])
        # the key of a set: documents with equal sets have equal keys
        key = mix(total[start[1:]] - total[start[:-1]] + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        del total
        part = ((g >> np.uint64(_BITS - 32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        row, g = row[order], g[order]
        edge = np.searchsorted(part[order], np.arange(parts + 1))
        out = [(-1, src, ids.tobytes(), size.tobytes() + key.tobytes())]
        for r in np.flatnonzero(np.diff(edge)).tolist():
            own = slice(edge[r], edge[r + 1])
            out.append((r, src, _pack_rows(row[own], docs), _pack(g[own])))
        return _batch(_SENT, *zip(*out)).to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        src = TaskContext.get().partitionId() << 32
        for b in batches:
            data, off = utf8(b.column(1))
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            # a bounded stretch of text at a time decides how much memory this takes
            for lo, hi in spans(off, _STRETCH):
                o = off[lo : hi + 1]
                yield batch(ids[lo:hi], data[o[0] : o[-1]], o - o[0], src)
                src += 1
            tidy()

    return run


def _count(table: pa.Table) -> pa.Table:
    """The n-grams of one range that two or more documents have, back to their stretches with their rarity class."""
    part = table["part"][0].as_py()
    table = table.select(["part", "src", "rows", "body"])
    if part < 0:
        return table
    bodies = [_unpack(x) for x in table["body"].to_pylist()]
    g = np.concatenate(bodies)
    order = np.argsort(g, kind="stable")
    s = g[order]
    head = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    runs = np.diff(np.append(head, len(s)))
    cls = np.zeros(len(g), np.uint8)
    cls[order] = np.repeat(np.minimum(255, np.floor(8 * np.log2(runs))).astype(np.uint8), runs)
    del g, s, order
    tidy()
    out, lo = [], 0
    for src, rows, body in zip(table["src"].to_pylist(), table["rows"].to_pylist(), bodies):
        c = cls[lo : lo + len(body)]
        lo += len(body)
        keep = c > 0
        if keep.any():
            row = _unpack_rows(rows)[keep]
            out.append((part, src, _pack_rows(row, int(row[-1]) + 1), _pack(body[keep]) + c[keep].tobytes()))
    return _batch(_SENT, *zip(*out)) if out else table.slice(0, 0)


#: Hashes by whose least values sets look for a centre.
_LEAST = 4
_SALT = np.random.default_rng(8).integers(1, 1 << 62, _LEAST).astype(np.uint64)
_SETS = "id long, src long, row int, k long, size int, shared int, grams binary, " + ", ".join(f"m{i} long" for i in range(_LEAST))


def _gather(t: float):
    """The documents of one stretch that can have a partner: shared n-grams in global order, rarest first."""

    def run(table: pa.Table) -> pa.Table:
        part = table["part"].to_numpy()
        rows_, bodies = table["rows"].to_pylist(), table["body"].to_pylist()
        own = int(np.flatnonzero(part < 0)[0])
        src = table["src"][own].as_py()
        ids = np.frombuffer(rows_[own], np.int64)
        docs = len(ids)
        size = np.frombuffer(bodies[own], np.int32, docs)
        key = np.frombuffer(bodies[own], np.int64, docs, 4 * docs)
        rows, grams, cls = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)]
        for i in np.flatnonzero(part >= 0).tolist():
            row = _unpack_rows(rows_[i])
            rows.append(row)
            grams.append(_unpack(bodies[i], len(row)))
            cls.append(np.frombuffer(bodies[i], np.uint8, len(row), 7 * len(row)))
        row, g, c = np.concatenate(rows), np.concatenate(grams), np.concatenate(cls)
        shared = np.bincount(row, minlength=docs)
        live = (shared >= np.ceil(t * size - 1e-9)) & (shared > 0)
        keep = live[row]
        row, g, c = row[keep], g[keep], c[keep]
        order = np.lexsort((g, c, row))
        row, g = row[order], g[order]
        at = np.flatnonzero(live)
        first = np.searchsorted(row, at)
        last = np.append(first[1:], len(row)) if len(at) else first
        least = [np.minimum.reduceat(mix(g ^ s), first).view(np.int64) if len(at) else [] for s in _SALT]
        tidy()
        return _batch(_SETS, ids[at], np.full(len(at), src), at, key[at], size[at], (last - first), [_pack(g[a:z]) for a, z in zip(first, last)], *least)

    return run


def _near(t: float):
    """(k, ball, ...) of sets against their centre: its ball if they are within (1 - t) / 2 of it, else their own."""

    def run(sets: pa.Table, centre: pa.Table) -> pa.Table:
        out = sets.select(["k", "id", "copies", "size", "shared", "grams"])
        k, hub = sets["k"].to_numpy(), sets["hub"].to_numpy()
        ball, block = k.copy(), sets["block"].to_numpy()
        if len(centre) and len(sets):
            c, n = np.sort(_unpack(centre["of"][0].as_py())), int(centre["n"][0].as_py())
            size = sets["size"].to_numpy()
            for i, x in enumerate(sets["grams"].to_pylist()):
                g = _unpack(x)
                p = np.searchsorted(c, g)
                p[p == len(c)] = 0
                m = int(np.count_nonzero(c[p] == g))
                if 2 * m >= (1 + t) * (int(size[i]) + n - m) + 1e-9:
                    ball[i] = hub[i]
        return out.append_column("ball", pa.array(ball)).append_column("block", pa.array(np.where(ball == k, 0, block)))

    return run


_BALLED = "k long, id long, copies long, size int, shared int, grams binary, ball long, block long"
_TOP = np.int64((1 << 62) - 1)


def _prefixes(t: float):
    """Of every ball in a batch: each shared n-gram among the rarest size - ceil(t * size) + 1 of one of its sets, the sets' least and greatest size, how many n-grams come behind it at most, and which comes before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, ball, size, shared = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4))
            own = size - shared  # n-grams of this document alone: the rarest of all
            take = np.minimum(shared, np.maximum(0, size - np.ceil(t * size - 1e-9).astype(np.int64) + 1 - own))
            gram = np.concatenate([_unpack(x, int(n)).view(np.int64) for x, n in zip(b.column(4).to_pylist(), take)] or [np.zeros(0, np.int64)])
            start = np.cumsum(take) - take
            place = np.arange(len(gram)) - np.repeat(start, take)
            # a number of its own stands for what comes before the first
            before = np.where(place > 0, np.roll(gram, 1), -(np.repeat(k, take) & _TOP) - 1)
            lo = hi = np.repeat(size, take)
            rest = np.repeat(shared - 1, take) - place
            of = np.repeat(ball, take)
            if len(np.unique(ball)) < len(ball):
                order = np.lexsort((of, gram))
                gram, of, before = gram[order], of[order], before[order]
                head = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (of[1:] != of[:-1])]))
                lo, hi, rest = np.minimum.reduceat(lo[order], head), np.maximum.reduceat(hi[order], head), np.maximum.reduceat(rest[order], head)
                least, most = np.minimum.reduceat(before, head), np.maximum.reduceat(before, head)
                gram, of = gram[head], of[head]
                before = np.where(least == most, least, _mixed(of))
            yield from _batch(_PREFIXES, gram, of, lo, hi, rest, before).to_batches()

    return run


def _mixed(ball: np.ndarray) -> np.ndarray:
    """What stands for the n-gram before, where a ball's sets don't agree on it."""
    return -(mix(ball.astype(np.int64).view(np.uint64) ^ np.uint64(0x5BD1E995)).view(np.int64) & _TOP) - 1


_PREFIXES = "gram long, ball long, lo int, hi int, rest int, before long"
_CELLS = 16


def _halves(sets: list[np.ndarray], rest_a: np.ndarray, rest_b: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The suffix filter: how much the suffixes of each pair can overlap at most.

    rest: how many n-grams of set a and of set b lie behind the pair's first match.
    Both suffixes are halved by fingerprint, and the halves again, four times:
    what is common lies in the same part of both. Fingerprints are even, so
    fixed halves are as good as those at a median.
    """
    size = np.array([len(x) for x in sets])
    start = np.concatenate([[0], np.cumsum(size)])
    cell = (np.concatenate(sets) >> np.uint64(_BITS - 4)).astype(np.int64)
    seen = np.zeros((len(cell) + 1, _CELLS), np.int32)
    np.cumsum(cell[:, None] == np.arange(_CELLS), axis=0, out=seen[1:])

    def behind(i: np.ndarray, rest: np.ndarray) -> np.ndarray:
        return seen[start[i + 1]] - seen[start[i + 1] - np.minimum(rest, size[i])]

    return np.minimum(behind(a, rest_a), behind(b, rest_b)).sum(axis=1)


def _verify(t: float):
    """Pairs of units of one bucket against the sets of that bucket: how many documents each set is linked to, and which balls are linked.

    (x, y, n): for a set y is null and n is how many documents the pairs of this
    bucket link it to; for two linked balls x and y, n is null.
    """

    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        if not len(pairs) or not len(sets):
            return _batch("x long, y long, n long", [], [], [])
        unit = sets["unit"].to_numpy()
        order = np.argsort(unit, kind="stable")
        sets, unit = sets.take(pa.array(order)), unit[order]
        k, ball, copies, size = (sets[c].to_numpy().astype(np.int64) for c in ("k", "ball", "copies", "size"))
        grams = [_unpack(x) for x in sets["grams"].to_pylist()]
        sorted_ = [np.sort(g) for g in grams]
        ua, ub, ra, rb = (pairs[c].to_numpy() for c in ("ua", "ub", "ra", "rb"))
        lo_a, hi_a, lo_b, hi_b = np.searchsorted(unit, ua), np.searchsorted(unit, ua, "right"), np.searchsorted(unit, ub), np.searchsorted(unit, ub, "right")
        links = np.zeros(len(k), np.int64)
        edges: set[tuple[int, int]] = set()

        def link(i: int, j: int) -> None:
            edges.add((min(ball[i], ball[j]), max(ball[i], ball[j])))

        single = (hi_a - lo_a == 1) & (hi_b - lo_b == 1)
        i, j = lo_a[single], lo_b[single]
        need = np.ceil(t / (1 + t) * (size[i] + size[j]) - 1e-9)
        fits = np.zeros(len(i), bool)
        for lo in range(0, len(i), 1 << 15):
            s = slice(lo, lo + (1 << 15))
            fits[s] = 1 + _halves(grams, ra[single][s], rb[single][s], i[s], j[s]) >= need[s]
        for x, y, least in zip(i[fits].tolist(), j[fits].tolist(), need[fits].tolist()):
            g, h = sorted_[x], sorted_[y]
            if len(g) > len(h):
                g, h = h, g
            p = np.searchsorted(h, g)
            p[p == len(h)] = 0
            if np.count_nonzero(h[p] == g) >= least:
                links[x] += copies[y]
                links[y] += copies[x]
                link(x, y)
        for a, z, c, e in zip(lo_a[~single].tolist(), hi_a[~single].tolist(), lo_b[~single].tolist(), hi_b[~single].tolist()):
            if a == z or c == e:
                continue
            both = np.intersect1d(np.concatenate(sorted_[a:z]), np.concatenate(sorted_[c:e]))
            if not len(both):
                continue
            m = np.zeros((z - a, e - c), np.float32)
            for lo in range(0, len(both), 4096):
                m += _held(sorted_[a:z], both[lo : lo + 4096]) @ _held(sorted_[c:e], both[lo : lo + 4096]).T
            ok = m >= np.ceil(t / (1 + t) * (size[a:z, None] + size[None, c:e]) - 1e-9)
            links[a:z] += ok @ copies[c:e]
            links[c:e] += copies[a:z] @ ok
            if ok.any():
                link(a, c)
        tidy()
        at = np.flatnonzero(links)
        x, y = (list(v) for v in zip(*edges)) if edges else ([], [])
        return _batch("x long, y long, n long", [*k[at].tolist(), *map(int, x)], [None] * len(at) + [int(v) for v in y], [*links[at].tolist(), *[None] * len(x)])

    return run


def _held(sets: list[np.ndarray], grams: np.ndarray) -> np.ndarray:
    """Which of the sorted grams each sorted set has, as numbers for a matrix product."""
    out = np.zeros((len(sets), len(grams)), np.float32)
    for i, s in enumerate(sets):
        own = s[np.searchsorted(s, grams[0]) : np.searchsorted(s, grams[-1], "right")]
        p = np.searchsorted(grams, own)
        out[i, p[grams[p] == own]] = 1
    return out


#: Sets of a centre, on average, that are compared with it, or with those of another ball, at a time.
_BLOCK = 256


def _sets(docs: DataFrame, n: int, t: float) -> DataFrame:
    """_SETS, stored, of docs (id, text): rows that can have a partner."""
    spark = docs.sparkSession
    d = docs.where("id is not null and text is not null").select("id", F.lower("text").alias("text"))
    volume = d.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = int(max(2 * shuffle_partitions(spark), -(-volume // _RANGE)))
    sent = d.mapInArrow(_send(n, parts), _SENT)
    # the documents' own rows are spread over groups of their own
    counted = sent.withColumn("range", F.when(F.col("part") < 0, -1 - F.col("src")).otherwise(F.col("part").cast("long"))).groupBy("range").applyInArrow(_count, _SENT)
    return cut(counted.groupBy("src").applyInArrow(_gather(t), _SETS))


def _balls(sets: DataFrame, t: float) -> tuple[DataFrame, DataFrame]:
    """_BALLED, stored: every different set once, with its smallest id, how many ids have it, its ball and its block in it; and (ball, blocks) of the balls that may have several."""
    slim = sets.drop("grams").withColumn("uid", F.xxhash64("src", "row"))
    least = [f"m{i}" for i in range(_LEAST)]
    entry = slim.groupBy("k", "id").agg(F.min("uid").alias("uid"), *[F.first(c).alias(c) for c in ("size", "shared", *least)])
    rep = cut(entry.groupBy("k").agg(F.min(F.struct("id", "uid")).alias("rep"), F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("size", "shared", *least)]))
    # the most central set of those with one least hash: the one with the largest share of n-grams that occur elsewhere
    rank = F.struct((F.col("shared") / F.col("size")).alias("share"), "copies", "k")
    by = rep.select("k", rank.alias("rank"), F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("m")) for i, c in enumerate(least)])).alias("by")).select("k", "rank", "by.i", "by.m")
    hub = by.groupBy("i", "m").agg(F.max("rank").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    best = by.join(hub, ["i", "m"]).groupBy("k").agg(F.max("hub").alias("hub")).select("k", F.col("hub.k").alias("hub")).where("hub != k")
    # the sets of a centre go in blocks, told apart before any n-gram moves
    assigned = cut(rep.select("k", "rep", "copies").join(best, "k", "left").withColumn("hub", F.coalesce("hub", "k")))
    blocks = cut(assigned.where("hub != k").groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / _BLOCK).alias("blocks")))
    assigned = assigned.join(blocks, "hub", "left").select("k", F.col("rep.uid").alias("uid"), "copies", "hub", F.when(F.col("hub") == F.col("k"), 0).otherwise(F.pmod(F.xxhash64("k"), F.col("blocks"))).alias("block"))
    placed = cut(sets.withColumn("uid", F.xxhash64("src", "row")).select("k", "uid", "id", "size", "shared", "grams").join(assigned, ["k", "uid"]).drop("uid"))
    # each block beside a copy of the centre
    centres = placed.select(F.col("k").alias("centre"), F.col("size").alias("n"), F.col("grams").alias("of")).join(blocks.withColumnRenamed("hub", "centre"), "centre").select("centre", "n", "of", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("beside"))
    near = placed.where("hub != k").groupBy("hub", "block").cogroup(centres.groupBy("centre", "beside")).applyInArrow(_near(t), _BALLED)
    own = placed.where("hub = k").withColumn("ball", F.col("k")).select(*near.columns)
    out = cut(near.unionByName(own))
    release(rep, placed)
    return out, blocks.select(F.col("hub").alias("ball"), "blocks")


def _pairs(balled: DataFrame, t: float) -> DataFrame:
    """(a, b, ra, rb), stored: pairs of balls that may hold similar sets, and how much lies behind the first match at most."""
    rows = balled.select("k", "ball", "size", "shared", "grams").mapInArrow(_prefixes(t), _PREFIXES)
    mixed = -F.xxhash64("ball", F.lit(1)).bitwiseAND(F.lit(int(_TOP))) - 1
    # rows of one gram are together once for the aggregate and for the join
    g = rows.repartition("gram").groupBy("gram", "ball").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("rest").alias("rest"), F.min("before").alias("b0"), F.max("before").alias("b1"))
    g = g.select("gram", "ball", "lo", "hi", "rest", F.when(F.col("b0") == F.col("b1"), F.col("b0")).otherwise(mixed).alias("before"))
    x, y = (g.select("gram", *[F.col(c).alias(f"{c}_{s}") for c in ("ball", "lo", "hi", "rest", "before")]) for s in "ab")
    c, eps = F.lit(t), F.lit(1e-9)
    met = x.join(y, "gram").where(
        (F.col("ball_a") < F.col("ball_b"))
        & (F.col("before_a") != F.col("before_b"))
        & (F.col("hi_a") >= c * F.col("lo_b") - eps)
        & (F.col("hi_b") >= c * F.col("lo_a") - eps)
        & (1 + F.least("rest_a", "rest_b") >= F.ceil(F.lit(t / (1 + t)) * (F.col("lo_a") + F.col("lo_b")) - eps))
    )
    return cut(met.groupBy(F.col("ball_a").alias("a"), F.col("ball_b").alias("b")).agg(F.max("rest_a").alias("ra"), F.max("rest_b").alias("rb")))


def _checked(balled: DataFrame, blocks: DataFrame, pairs: DataFrame, t: float) -> DataFrame:
    """(x, y, n) as _verify() gives it, stored."""
    unit = lambda ball: F.xxhash64(F.col(ball), F.col("block"))
    p = pairs
    for s in "ab":  # a pair of balls is one of every two blocks
        p = p.join(blocks.withColumnRenamed("ball", s), s, "left").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1)) - 1))).withColumn(f"u{s}", unit(s)).drop("block", "blocks")
    p = cut(p.select("ua", "ub", "ra", "rb"))
    # a pair's neighbourhood: the smallest key that either of its ends meets; large ones are split in blocks
    ends = p.select(F.explode(F.array("ua", "ub")).alias("unit"), F.least("ua", "ub").alias("least"))
    label = cut(ends.groupBy("unit").agg(F.min("least").alias("label")))
    big = label.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / _BLOCK).alias("blocks"))
    home = label.join(big, "label").select("unit", F.xxhash64("label", F.expr("pmod(xxhash64(unit), blocks)")).alias("home"))
    buckets = max(shuffle_partitions(balled.sparkSession), label.count() // (2 * _BLOCK))
    ha, hb = (home.select(F.col("unit").alias(f"u{s}"), F.col("home").alias(f"home_{s}")) for s in "ab")
    placed = cut(p.join(ha, "ua").join(hb, "ub").select("ua", "ub", "ra", "rb", F.pmod(F.xxhash64(F.least("home_a", "home_b"), F.greatest("home_a", "home_b")), F.lit(buckets)).alias("bucket")))
    wanted = placed.select("bucket", F.explode(F.array("ua", "ub")).alias("unit")).distinct()
    members = balled.withColumn("unit", unit("ball")).select("unit", "k", "ball", "copies", "size", "grams")
    sides = wanted.join(members, "unit").withColumnRenamed("bucket", "held_in")
    out = cut(placed.groupBy("bucket").cogroup(sides.groupBy("held_in")).applyInArrow(_verify(t), "x long, y long, n long"))
    release(p, label, placed)
    return out


def linked(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (doc_id, class_id, links).

    links is how many other documents have an n-gram set of Jaccard similarity
    threshold or more with this one's, copies among them, and none is left out.
    class_id is the smallest doc_id that such links lead to, over any number of
    them; the document's own where it has none.

    Words are runs of ASCII letters and digits and of characters beyond ASCII,
    of the lower-cased text; texts of any length are read whole. A text of fewer
    than n words has one gram of all its words. Null and empty texts, and texts
    without a word, have no set and no link. Rows with a null id give no row.
    Repeated rows count once; an id with several texts has one row, with the
    smallest class and the sum of the links of its texts, each of which counts
    as a document. Ties don't matter, as every link is counted. An empty table
    gives an empty result. Other columns are ignored, whatever their names. Ids
    have to be of whole numbers, else a TypeError. docs should be a stored
    table, as it is read more than once.
    """
    t = threshold
    d = only(docs, id=id_col, text=text_col)
    sets = _sets(d, n, t)
    entries = cut(sets.select("id", "k").distinct())
    balled, blocks = _balls(sets, t)
    release(sets)
    pairs = _pairs(balled, t)
    checked = _checked(balled, blocks, pairs, t)
    info = cut(balled.select("k", "id", "copies", "ball"))
    release(balled, pairs)
    # within a ball all are linked
    inside = info.groupBy("ball").agg(F.sum("copies").alias("inside"))
    across = checked.where("y is null").groupBy(F.col("x").alias("k")).agg(F.sum("n").alias("across"))
    root = groups(checked.where("y is not null").select("x", "y"), "x", "y").toDF("ball", "root")
    info = info.join(inside, "ball").join(across, "k", "left").join(root, "ball", "left")
    info = info.select("k", "id", F.coalesce("root", "ball").alias("root"), (F.col("inside") - 1 + F.coalesce("across", F.lit(0))).alias("links"))
    least = info.groupBy("root").agg(F.min("id").alias("class_id"))
    by = info.join(least, "root").select("k", "class_id", "links")
    found = entries.join(by, "k").groupBy("id").agg(F.min("class_id").alias("class_id"), F.sum("links").alias("links"))
    return d.where("id is not null").select("id").distinct().join(found, "id", "left").select(F.col("id").alias("doc_id"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def groups(pairs: DataFrame, a: str = "doc_a", b: str = "doc_b") -> DataFrame:
    """(doc_id, keeper): for every document in a pair, the smallest id that pairs lead to.

    Repeated pairs, and pairs of an id with itself, change nothing; without
    pairs the result is empty. Nulls must not occur.

    Alternating large-star and small-star steps over tables in the shared
    folder, until none changes; no step gathers a group in one place.
    """
    spark = pairs.sparkSession
    e = cut(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct())
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        j = large.join(down, "u")
        small = j.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(down.select("u", F.col("m").alias("v"))).distinct()
        old, e = e, cut(small)
        release(old)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("doc_id")).distinct().select("doc_id", F.col("doc_id").alias("keeper"))
    return e.select(F.col("u").alias("doc_id"), F.col("v").alias("keeper")).union(roots)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs, all columns, without the documents whose class has a smaller id.

    Rows with a null id, and rows without words, stay. Rows are told apart by
    their id alone: repeated rows of one id stay or go together, and so do rows
    of one id with several texts, as soon as one of them is linked to a smaller
    id. Ties can't occur. Any length of text is compared whole. An empty table
    gives an empty result; other columns keep their names and values.
    """
    gone = linked(docs, id_col=id_col, text_col=text_col, **options).where("class_id != doc_id").select("doc_id")
    return without(docs, gone, id_col)


def sql(n: int = N, threshold: float = THRESHOLD, docs: str = "documents") -> str:
    """All links by counting common n-grams, without prefixes or balls, for document ids that are unique."""
    grams = " || ' ' || ".join(f"w[i + {j}]" for j in range(1, n + 1))
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM {docs} WHERE doc_id IS NOT NULL),
i AS (SELECT doc_id, w, unnest(range(0, len(w) - {n - 1})) AS i FROM w WHERE len(w) >= {n}),
g AS (SELECT DISTINCT doc_id, {grams} AS g FROM i UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND {n - 1}),
s AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS overlap FROM g a JOIN g b ON a.g = b.g AND a.doc_id != b.doc_id GROUP BY ALL),
p AS (SELECT a, b FROM o JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE overlap >= ceil({threshold / (1 + threshold)!r} * (x.n + y.n) - 1e-9)),
r AS (SELECT doc_id AS a, doc_id AS b FROM {docs} WHERE doc_id IS NOT NULL UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b),
c AS (SELECT a, min(b) AS class_id FROM r GROUP BY a),
l AS (SELECT a, count(*) AS links FROM p GROUP BY a)
SELECT c.a AS doc_id, c.class_id, coalesce(l.links, 0) AS links FROM c LEFT JOIN l USING (a)"""

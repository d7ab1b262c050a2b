"""Document quality by hierarchical empirical Bayes.

A logistic document classifier gives each document's evidence. Sites have two
levels, host and path. At each level the rate of good documents is a
Beta-binomial posterior: a host is shrunk towards the global rate, a path
towards its host, with strengths that the method of moments takes from the
spread between hosts, and between the paths of a host. A document's posterior
replaces the classifier's prior by that of its path.

Labelled documents count with their label, all others with the classifier's
probability, so the rates are over every document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pericope.llm.shared import cut, mix, only, pieces, release, sample, spans, utf8, words

#: Labelled documents that the classifier is fitted on, at most: those whose id has the smallest hash.
FIT_ROWS = 8000
BUCKETS = 1 << 16
#: Words are read whole and by their first bytes, of so many: languages that compound words show what a text is about there.
PREFIXES = (4, 6)
THRESHOLD = 0.5
_DENSE = 7
_UPPER, _SPACE, _DIGIT = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91] = True
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_DIGIT[48:58] = True
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def vectors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, dense): the distinct hashed words and beginnings of words of each row, and figures on the whole text."""
    n = len(offsets) - 1
    size = np.maximum(1, np.diff(offsets))
    text = _FOLD[data]
    row, start, end, h = words(text, offsets, _WORD)
    keys = [(row << 16) | (h >> np.uint64(48)).astype(np.int64)]
    distinct = np.bincount(np.unique(keys[0]) >> 16, minlength=n)
    if len(row):
        place = np.arange(len(text)) - np.repeat(np.concatenate([[0], start]), np.diff(np.concatenate([[0], start, [len(text)]])))
        for k in PREFIXES:
            long = end - start > k
            first = words(np.where(place < k, text, 32), offsets, _WORD)
            # every word leaves one beginning, at the same place
            at = np.searchsorted(first[1], start[long])
            keys.append((row[long] << 16) | (mix(first[3][at] + np.uint64(k)) >> np.uint64(48)).astype(np.int64))
    u = np.unique(np.concatenate(keys))
    n_words = np.bincount(row, minlength=n)

    def share(kind: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(kind)])[offsets]) / size

    some = np.maximum(1, n_words)
    dense = np.stack(
        [
            share(_UPPER[data]),
            share(_DIGIT[data]),
            share(~_WORD[data] & ~_SPACE[data]),
            np.bincount(row, end - start, n) / some / 10,
            distinct / some,
            np.log1p(n_words) / 10,
            np.minimum(1, 20 / some),
        ],
        axis=1,
    )
    return u >> 16, u & (BUCKETS - 1), dense


class Classifier:
    """Logistic regression on hashed words and dense figures; probability() is of good."""

    def __init__(self, words_: np.ndarray, dense: np.ndarray, bias: float, mean: np.ndarray, scale: np.ndarray):
        self.words, self.dense, self.bias, self.mean, self.scale = words_, dense, bias, mean, scale

    def evidence(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Log-odds of good by row."""
        row, bucket, dense = vectors(data, offsets)
        return np.bincount(row, self.words[bucket], len(offsets) - 1) + ((dense - self.mean) / self.scale) @ self.dense + self.bias

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, steps: int = 80, rate: float = 0.1, decay: float = 1e-4) -> Classifier:
        """rows: (buckets, dense) by document, of the buckets that telling() keeps."""
        if not len(y):
            return cls(np.zeros(BUCKETS), np.zeros(_DENSE), 0.0, np.zeros(_DENSE), np.ones(_DENSE))
        n = len(y)
        at = np.repeat(np.arange(n), [len(b) for b, _ in rows])
        bucket = np.concatenate([b for b, _ in rows])
        d = np.stack([x for _, x in rows])
        mean, scale = d.mean(axis=0), d.std(axis=0) + 1e-6
        d = (d - mean) / scale
        rate_good = (y.sum() + 1) / (n + 2)
        p = [np.zeros(BUCKETS), np.zeros(_DENSE), np.array(np.log(rate_good / (1 - rate_good)))]
        m, v = ([np.zeros_like(x) for x in p] for _ in range(2))
        # both kinds weigh alike in the fit; the bias gets the true odds back below
        w = np.where(y > 0, 0.5 / max(rate_good, 1e-9), 0.5 / max(1 - rate_good, 1e-9)) / n
        p[2] = np.array(0.0)
        for step in range(1, steps + 1):
            s = np.bincount(at, p[0][bucket], n) + d @ p[1] + p[2]
            e = (y - 1 / (1 + np.exp(-np.clip(s, -30, 30)))) * w
            g = [np.bincount(bucket, e[at], BUCKETS) - decay * p[0], d.T @ e - decay * p[1], np.array(e.sum())]
            for i in range(3):
                m[i] += 0.1 * (g[i] - m[i])
                v[i] += 0.01 * (g[i] * g[i] - v[i])
                p[i] = p[i] + rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
        return cls(p[0], p[1], float(p[2]) + float(np.log(rate_good / (1 - rate_good))), mean, scale)


def telling(count: np.ndarray, good: np.ndarray, n: int, n_good: int, least: int = 8, score: float = 4.0) -> np.ndarray:
    """Which buckets get a weight: those of `least` documents or more whose share of good documents is off by `score` standard deviations or more."""
    share = min(max(n_good / max(n, 1), 1 / (n + 2)), 1 - 1 / (n + 2))
    off = np.abs(good - count * share) / np.sqrt(np.maximum(count, 1) * share * (1 - share))
    return (count >= least) & (off >= score)


def _labels(labels: DataFrame, id_col: str) -> DataFrame:
    """(doc_id, good): one row per labelled id. good is 1 for quality 1 that isn't toxic; a null toxic counts as 0, a null quality is no label; of contradicting rows the worst counts."""
    lab = only(labels, doc_id=id_col, quality="quality", toxic="toxic").where("doc_id is not null and quality is not null")
    return lab.groupBy("doc_id").agg(F.min(F.expr("int(quality = 1 and coalesce(toxic, 0) = 0)")).alias("good"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> Classifier:
    """Fits the classifier on at most fit_rows labelled documents, those whose id has the smallest hash. With no such document, or of one kind only, it knows the prior alone.

    Rows with a null id or text are passed over, an empty text has no words;
    repeated rows each count. The driver gets the telling words of each document
    only, however long it is.
    """
    lab = sample(_labels(labels, id_col), F.xxhash64("doc_id"), fit_rows)
    d = only(docs, doc_id=id_col, text=text_col).where("text is not null")
    d = d.join(F.broadcast(lab), "doc_id").select("text", "good")  # fit_rows rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 0):
            data, off = utf8(b.column(0))
            for lo, hi in spans(off):
                o = off[lo : hi + 1]
                row, bucket, x = vectors(data[o[0] : o[-1]], o - o[0])
                edge = np.searchsorted(row, np.arange(hi - lo + 1))
                buckets = [bucket[edge[i] : edge[i + 1]].astype(np.uint16).tobytes() for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.binary()), pa.array([r.tobytes() for r in x], pa.binary()), b.column(1).slice(lo, hi - lo)], ["b", "d", "good"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            for x, y in zip(b.column(0), b.column(1)):
                n[:, np.frombuffer(x.as_py(), np.uint16)] += [[1], [y.as_py()]]
        at = np.flatnonzero(n[0])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[0, at]), pa.array(n[1, at])], ["bucket", "n", "good"])

    fitted = cut(d.mapInArrow(run, "b binary, d binary, good int"))
    total = fitted.agg(F.count(F.lit(1)), F.coalesce(F.sum("good"), F.lit(0))).first()
    n = np.zeros((2, BUCKETS), np.int64)
    for r in fitted.select("b", "good").mapInArrow(count, "bucket int, n long, good long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).collect():  # BUCKETS rows at most
        n[:, r["bucket"]] = r["n"], r["good"]
    keep = telling(n[0], n[1], *total)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [np.frombuffer(x.as_py(), np.uint16) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([x[keep[x]].tobytes() for x in own], pa.binary()), b.column(1), b.column(2)], ["b", "d", "good"])

    got = sorted((bytes(r["b"]), bytes(r["d"]), r["good"]) for r in fitted.mapInArrow(kept, "b binary, d binary, good int").collect())
    release(fitted)
    rows = [(np.frombuffer(b, np.uint16).astype(np.int64), np.frombuffer(x, np.float64)) for b, x, _ in got]
    return Classifier.fit(rows, np.array([y for _, _, y in got], np.float64))


def _strength(n: Column, rate: Column, centre: Column) -> Column:
    """The prior's weight in documents, by moments: with rates spread around the centre by more than sampling explains, small; else large. Aggregates over a level's groups."""
    expected = F.sum(centre * (1 - centre))  # binomial spread, in units of documents
    spread = F.sum(n * (rate - centre) ** 2)
    groups, total = F.count(F.lit(1)), F.sum(n)
    within = expected / groups
    between = F.greatest((spread - groups * within) / F.greatest(total - F.sum(n * n) / total, F.lit(1.0)), within * 1e-4)
    return F.least(F.greatest(within / between - 1, F.lit(1.0)), F.lit(10_000.0))


def rates(scored: DataFrame) -> DataFrame:
    """(host, path, n, host_rate, path_rate) from rows of (host, path, value), value being a label or a probability of good.

    Null hosts and paths are groups of their own; values must not be null.
    Repeated rows each count; a host may hold any share of the rows, as counts
    are combined before they are shuffled. Without rows the result is empty.
    """
    by_path = cut(scored.groupBy("host", "path").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("value").alias("k")))
    by_host = by_path.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("k").alias("hk"))
    total, good = by_path.agg(F.coalesce(F.sum("n"), F.lit(0.0)), F.coalesce(F.sum("k"), F.lit(0.0))).first()
    g = (good + 0.5) / (total + 1)
    strength = by_host.agg(_strength(F.col("hn"), F.col("hk") / F.col("hn"), F.lit(g))).first()[0] or 1.0
    host = by_host.select("host", ((F.col("hk") + strength * g) / (F.col("hn") + strength)).alias("host_rate"))
    p = by_path.alias("p").join(host.alias("h"), F.expr("p.host <=> h.host")).select("p.host", "path", "n", "k", "host_rate")
    strength = p.agg(_strength(F.col("n"), F.col("k") / F.col("n"), F.col("host_rate"))).first()[0] or 1.0
    return p.select("host", "path", "n", "host_rate", ((F.col("k") + strength * F.col("host_rate")) / (F.col("n") + strength)).alias("path_rate"))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def score(
    docs: DataFrame, labels: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", threshold: float = THRESHOLD
) -> DataFrame:
    """One row per row of docs: (doc_id, host, path, evidence, host_rate, path_rate, posterior, keep).

    evidence is the classifier's log-odds of good; posterior the probability of
    good with the path's rate as prior; keep: posterior >= threshold. The driver's
    documents have no address: their source is the host and their language the
    path; for pages use the columns that site() makes.

    A null or empty text has evidence 0, that is none, so its site alone
    decides; texts of any length are read whole. A posterior of exactly the
    threshold is kept. Null hosts and paths are a host and a path of their own. Null ids
    are kept and have no label; repeated rows each give a row and each count.
    Figures are rounded to 6 places. An empty table gives an empty result.
    Other columns are ignored, whatever their names. Ids have to be of whole
    numbers, else a TypeError.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 3):
            data, off = utf8(b.column(3))
            e = np.zeros(b.num_rows)
            for lo, hi in spans(off):
                o = off[lo : hi + 1]
                e[lo:hi] = model.evidence(data[o[0] : o[-1]], o - o[0])
            e[np.diff(off) == 0] = 0
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.clip(e, -30, 30))], ["doc_id", "host", "path", "evidence"])

    d = only(docs, doc_id=id_col, host=host_col, path=path_col, text=text_col)
    d = d.select("doc_id", F.col("host").cast("string").alias("host"), F.col("path").cast("string").alias("path"), "text")
    slim = d.mapInArrow(run, "doc_id long, host string, path string, evidence double")
    slim = cut(slim.join(_labels(labels, id_col), "doc_id", "left"))
    prob = 1 / (1 + F.exp(-F.col("evidence")))
    r = rates(slim.select("host", "path", F.coalesce(F.col("good").cast("double"), prob).alias("value")))
    # every document counts, so this is the rate that the evidence holds already
    base = min(max(slim.agg(F.avg(prob)).first()[0] or 0.5, 1e-6), 1 - 1e-6)
    out = slim.alias("d").join(r.alias("r"), F.expr("d.host <=> r.host and d.path <=> r.path"))
    post = 1 / (1 + F.exp(-(F.col("evidence") - F.lit(math.log(base / (1 - base))) + _logit(F.greatest(F.least(F.col("path_rate"), F.lit(1 - 1e-6)), F.lit(1e-6))))))
    return out.select(
        "doc_id", "d.host", "d.path", F.round("evidence", 6).alias("evidence"), F.round("host_rate", 6).alias("host_rate"), F.round("path_rate", 6).alias("path_rate"), F.round(post, 6).alias("posterior"), (post >= threshold).alias("keep")
    )


def site(url: Column) -> tuple[Column, Column]:
    """(host, path) of an address: the host in lower case without www., and the first part of the path."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#]*)", 1)), r"^www\.", "")
    return host, F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*/([^/?#]*)", 1)

"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes, forwards and backwards, labels every byte and
pools the byte probabilities into a document's. It is trained in numpy by
backpropagation through time. Gates use softsign, x / (1 + |x|), in place of
tanh and the logistic function, because numpy computes it many times faster.

Texts are cut into segments of SEGMENT bytes that are read with CONTEXT bytes on
either side, so that any text length gives arrays of one shape; every byte is
labelled in exactly one segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pericope.llm.shared import in_place, low_hash, only, pieces, spans, utf8

SEGMENT, CONTEXT, HIDDEN = 256, 8, 12
#: Segments that are read at a time: what a worker's memory depends on.
_AT_ONCE = 512
#: Distinct texts of every language that the network is fitted on, at most; and of each so many windows of so many characters, at hashed places of the whole text.
FIT_TEXTS, FIT_WINDOWS, FIT_CHARS = 100, 16, 96
#: A text whose bytes are so likely in no language is rejected.
MOST_NONE = 0.7
#: The class of strings that are in no language, and that of languages and scripts without a label; both are trained on generated strings.
NONE, OTHER = "und", "other"
PAD = 256


def _soft(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


class ByteGRU:
    """Two GRUs, one per direction, and a softmax over their states at every byte."""

    def __init__(self, classes: list[str], hidden: int = HIDDEN, seed: int = 7):
        r, h = np.random.default_rng(seed), hidden
        self.classes = classes
        f = np.float32
        self.p = {
            "E": r.normal(0, 0.3, (2, PAD + 1, 3 * h)).astype(f),  # input part of the gates, by byte; with the biases
            "U": r.normal(0, h**-0.5, (2, h, 3 * h)).astype(f),
            "c": np.zeros((2, 1, h), f),
            "O": r.normal(0, 0.3, (2, h, len(classes))).astype(f),
            "b": np.zeros(len(classes), f),
        }

    def states(self, x: np.ndarray, keep: bool = False):
        """x: (T, N) byte values or PAD. (2, T, N, H) states, aligned with x, and what backpropagation needs if keep."""
        t_n, n = x.shape
        p, h = self.p, self.p["U"].shape[1]
        both = np.stack([x, x[::-1]])
        out = np.empty((2, t_n, n, h), np.float32)
        s = np.zeros((2, n, h), np.float32)
        kept = []
        a = np.empty((2, n, 3 * h), np.float32)
        for t in range(t_n):
            np.take(p["E"][0], both[0, t], axis=0, out=a[0])
            np.take(p["E"][1], both[1, t], axis=0, out=a[1])
            u = np.matmul(s, p["U"])
            g = a[..., : 2 * h] + u[..., : 2 * h]
            d = np.abs(g)
            d += 1
            g /= d
            g *= 0.5
            g += 0.5
            z, r = g[..., :h], g[..., h:]
            un = u[..., 2 * h :]
            un += p["c"]
            m = r * un
            m += a[..., 2 * h :]
            dn = np.abs(m)
            dn += 1
            m /= dn
            if keep:
                kept.append((s, z, r, un, m, d, dn))
            s = s - m
            s *= z
            s += m
            out[0, t] = s[0]
            out[1, t_n - 1 - t] = s[1]
        return (out, kept, both) if keep else out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(T, N, classes). The same numbers as from states(), in fewer and contiguous array operations."""
        t_n, n = x.shape
        h = self.p["U"].shape[1]
        ez, er, em = (np.ascontiguousarray(self.p["E"][..., i * h : (i + 1) * h]) for i in range(3))
        uz, ur, um = (np.ascontiguousarray(self.p["U"][..., i * h : (i + 1) * h]) for i in range(3))
        um, cm = um * np.float32(0.5), self.p["c"] * np.float32(0.5)
        out = np.empty((2, t_n, n, h), np.float32)
        s = np.zeros((2, n, h), np.float32)
        az, ar, am, g, d, u = (np.empty((2, n, h), np.float32) for _ in range(6))
        for t in range(t_n):
            for i, row in ((0, x[t]), (1, x[t_n - 1 - t])):
                np.take(ez[i], row, axis=0, out=az[i], mode="clip")
                np.take(er[i], row, axis=0, out=ar[i], mode="clip")
                np.take(em[i], row, axis=0, out=am[i], mode="clip")
                np.dot(s[i], ur[i], out=g[i])
                np.dot(s[i], um[i], out=u[i])
            g += ar  # 2 r - 1 = softsign(g)
            np.abs(g, out=d)
            d += 1
            g /= d
            g += 1
            u += cm
            u *= g
            u += am
            np.abs(u, out=d)
            d += 1
            u /= d  # the new state's candidate
            for i in range(2):
                np.dot(s[i], uz[i], out=g[i])
            g += az  # 2 z - 1 = softsign(g)
            np.abs(g, out=d)
            d += 1
            g /= d
            g += 1
            s -= u
            s *= g
            s *= 0.5
            s += u
            out[0, t] = s[0]
            out[1, t_n - 1 - t] = s[1]
        return self._softmax(out)

    def _softmax(self, s: np.ndarray) -> np.ndarray:
        y = np.matmul(s[0], self.p["O"][0])
        y += np.matmul(s[1], self.p["O"][1])
        y += self.p["b"]
        np.clip(y, -30, 30, out=y)
        np.exp(y, out=y)
        total = y[..., 0].copy()  # by class: numpy reduces a short last axis slowly
        for c in range(1, y.shape[-1]):
            total += y[..., c]
        y /= total[..., None]
        return y

    def gradients(self, x: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy per byte (pads don't count) and its gradients; label: (N,)."""
        p, h = self.p, self.p["U"].shape[1]
        s, kept, both = self.states(x, keep=True)
        t_n, n = x.shape
        y = self._softmax(s)
        real = (x != PAD).astype(np.float32)[..., None]
        total = max(1.0, float(real.sum()))
        loss = float(-(np.log(y[:, np.arange(n), label] + 1e-9) * real[..., 0]).sum() / total)
        dy = y
        dy[:, np.arange(n), label] -= 1
        dy *= real / total
        flat = dy.reshape(t_n * n, -1)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["b"] = flat.sum(axis=0)
        ds = np.empty_like(s)
        for i in range(2):
            g["O"][i] = s[i].reshape(t_n * n, h).T @ flat
            ds[i] = dy @ p["O"][i].T
        back = np.zeros((2, n, h), np.float32)
        da = np.empty((2, t_n, n, 3 * h), np.float32)
        ut = p["U"].transpose(0, 2, 1)
        for t in reversed(range(t_n)):
            prev, z, r, un, m, d, dn = kept[t]
            back[0] += ds[0, t]
            back[1] += ds[1, t_n - 1 - t]
            dm = back * (1 - z) / (dn * dn)
            du = np.empty((2, n, 3 * h), np.float32)
            du[..., :h] = back * (prev - m) * 0.5 / (d[..., :h] ** 2)
            du[..., h : 2 * h] = dm * un * 0.5 / (d[..., h:] ** 2)
            du[..., 2 * h :] = dm * r
            da[:, t] = du
            da[:, t, :, 2 * h :] = dm
            g["c"] += du[..., 2 * h :].sum(axis=1, keepdims=True)
            g["U"] += np.matmul(prev.transpose(0, 2, 1), du)
            back = back * z + np.matmul(du, ut)
        for i in range(2):
            hot = np.zeros((PAD + 1, t_n * n), np.float32)
            hot[both[i].ravel(), np.arange(t_n * n)] = 1
            g["E"][i] = hot @ da[i].reshape(t_n * n, 3 * h)
        return loss, g

    def fit(self, texts: list[bytes], labels: np.ndarray, steps: int = 260, batch: int = 112, length: int = 48, rate: float = 0.02, seed: int = 11) -> ByteGRU:
        """Adam over windows at random places of texts, every class as often as any other."""
        r = np.random.default_rng(seed)
        by = [np.flatnonzero(labels == c) for c in range(len(self.classes))]
        by = [b for b in by if len(b)]
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            rows = np.array([r.choice(by[i % len(by)]) for i in range((step - 1) * batch, step * batch)])  # in turn, as there may be more classes than rows
            x = np.full((length, batch), PAD, np.int64)
            for j, i in enumerate(rows):
                at = int(r.integers(0, max(1, len(texts[i]) - length + 1)))
                w = np.frombuffer(texts[i][at : at + length], np.uint8)
                x[: len(w), j] = w
            _, g = self.gradients(x, labels[rows])
            norm = float(np.sqrt(sum((q * q).sum() for q in g.values())))
            scale = min(1.0, 1.0 / (norm + 1e-9))
            lr = rate * (1 - 0.9 * step / steps)
            for k, q in g.items():
                q = q * scale
                m[k] += 0.1 * (q - m[k])
                v[k] += 0.01 * (q * q - v[k])
                self.p[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self


#: Alphabets by first and last character: a text in one of them is in a language, labelled or not.
_SCRIPTS = [
    (0x430, 0x44F), (0x3B1, 0x3C9), (0x627, 0x64A), (0x5D0, 0x5EA), (0x905, 0x939), (0x985, 0x9B9), (0xB85, 0xBB9), (0xC05, 0xC39), (0xE01, 0xE2E), (0x10D0, 0x10F0), (0x561, 0x586),
    (0x1200, 0x1248), (0x3041, 0x3096), (0x30A1, 0x30FA), (0xAC00, 0xD7A3), (0x4E00, 0x9FA5), (0x100, 0x17F),
]


def _chars(r: np.random.Generator, lo: int, hi: int, n: int) -> list[str]:
    return [chr(c) for c in r.integers(lo, hi + 1, n)]


def random_strings(n: int, seed: int = 3) -> list[bytes]:
    """Strings in no language: digits, symbols, hexadecimal, random letters, and characters of many scripts without order."""
    r = np.random.default_rng(seed)
    kinds = ["0123456789 .,-", "!#$%&*+-/<=>?@^_|~ ", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"]
    out = []
    for i in range(n):
        k = i % (len(kinds) + 2)
        if k < len(kinds):
            s = "".join(r.choice(list(kinds[k]), 200))
        elif k == len(kinds):  # a letter of any script after one of any other
            s = "".join(_chars(r, *_SCRIPTS[r.integers(0, len(_SCRIPTS))], 1)[0] for _ in range(100))
        else:
            s = "".join(_chars(r, *((0x2190, 0x25FF), (0xA1, 0xBF), (0xFFFD, 0xFFFD))[r.integers(0, 3)], 1)[0] for _ in range(100))
        out.append(s.encode())
    return out


def other_strings(n: int, used: str = "", seed: int = 4) -> list[bytes]:
    """Strings like text of the alphabets that `used`, the labelled texts, doesn't have: words of an alphabet's letters, some far more frequent than others, with spaces and stops where it has them."""
    r = np.random.default_rng(seed)
    seen = np.unique(np.array([ord(c) for c in set(used)] or [0]))
    # letters of Latin Extended-A occur in many languages, so those alone don't decide
    free = [(lo, hi) for lo, hi in _SCRIPTS if np.count_nonzero((seen >= lo) & (seen <= hi)) < (30 if lo == 0x100 else 5)]
    out = []
    for i in range(n if free else 0):
        lo, hi = free[i % len(free)]
        letters = np.array(_chars(r, lo, hi, 40) if hi - lo > 200 else [chr(c) for c in range(lo, hi + 1)])
        p = r.permutation(1 / np.arange(2, len(letters) + 2))
        p /= p.sum()
        if lo == 0x100:  # Latin letters with marks, among plain ones
            plain = list("aeioukmnprstzvldjw")
            words = ["".join(str(r.choice(letters)) if r.integers(0, 4) == 0 else str(r.choice(plain)) for _ in range(r.integers(2, 10))) for _ in range(40)]
        else:
            words = ["".join(r.choice(letters, r.integers(1, 9), p=p)) for _ in range(40)]
        gap, stop = ("", "。") if lo in (0x4E00, 0x3041, 0x30A1) else (" ", ". ")
        out.append("".join(w + (stop if r.integers(0, 8) == 0 else gap) for w in words).encode()[:400])
    return out


def fit_texts(docs: DataFrame, each: int) -> DataFrame:
    """(lang, h, text): of every language in docs, the distinct texts of the `each` smallest hashes, or all if there are fewer.

    docs: (lang, text), without nulls. What is ordered is about 2 * each hashes a
    language, and each copy of a text counts as that text.
    """
    d = docs.withColumn("h", F.xxhash64("text"))
    size = d.groupBy("lang").agg(F.approx_count_distinct("h").alias("size"))  # a row per language
    h = d.select("lang", "h").join(F.broadcast(size), "lang")
    h = h.where((F.col("size") <= 4 * each) | low_hash(F.col("h"), F.lit(2.0 * each) / F.col("size"))).select("lang", "h").distinct()
    h = h.withColumn("nr", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("nr") <= each).drop("nr")
    return d.join(F.broadcast(h), ["lang", "h"]).select("lang", "h", "text")


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", fit_texts_each: int = FIT_TEXTS, windows: int = FIT_WINDOWS, chars: int = FIT_CHARS) -> ByteGRU:
    """Fits the network on at most fit_texts_each distinct texts of every language of the labelled rows, those of the smallest hashes, in at most `windows` windows of `chars` characters of each, at hashed places of the whole text.

    Its classes are all languages of the labelled rows, however rare, OTHER and
    NONE. Rows with a null label or a null or empty text are passed over, and so
    are labels equal to OTHER or NONE. Without any labelled row, OTHER and NONE
    are the only classes. Copies of a text count once; other columns are ignored.
    """
    d = only(docs, text=text_col, lang=lang_col).where("text is not null and lang is not null and text != ''").where(~F.col("lang").isin(NONE, OTHER))
    room = F.greatest(F.lit(1), F.length("text") - chars + 1)
    cuts = F.transform(F.sequence(F.lit(0), F.least(F.lit(windows), F.ceil(F.length("text") / chars).cast("int")) - 1), lambda i: F.substring(F.col("text"), (F.pmod(F.xxhash64("h", i), room) + 1).cast("int"), F.lit(chars)))
    rows = fit_texts(d, fit_texts_each).groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "h", cuts.alias("cuts")).orderBy("lang", "h").collect()
    classes = sorted({x["lang"] for x in rows})
    labelled = [(w.encode(), classes.index(x["lang"])) for x in rows for w in x["cuts"] if w]
    other = other_strings(136, "".join(w for x in rows for w in x["cuts"]))
    noise = random_strings(96)
    texts = [w for w, _ in labelled] + other + noise
    labels = np.array([y for _, y in labelled] + [len(classes)] * len(other) + [len(classes) + 1] * len(noise))
    return ByteGRU([*classes, OTHER, NONE]).fit(texts, labels)


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, row, length): bytes with context as (T, N), each segment's row and how many bytes it labels."""
    size = np.diff(offsets)
    per = -(-size // SEGMENT)
    row = np.repeat(np.arange(len(size)), per)
    place = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    start = offsets[row] + place * SEGMENT
    length = np.minimum(SEGMENT, offsets[row + 1] - start)
    at = start[None, :] + np.arange(-CONTEXT, SEGMENT + CONTEXT)[:, None]
    out = (at < offsets[row][None, :]) | (at >= offsets[row + 1][None, :])
    x = data[np.where(out, 0, at)].astype(np.int64)
    x[out] = PAD
    return x, row, length


_OUT = "doc_id long, lang string, confidence double, agreement double, n_bytes long, keep boolean"


def _label(model: ByteGRU, most_none: float = MOST_NONE):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none, k = len(model.classes) - 1, len(model.classes)
        for b in pieces(batches, 1):
            data, off = utf8(b.column(1))
            size = np.diff(off)
            pooled, votes = np.zeros((b.num_rows, k)), np.zeros((b.num_rows, k))
            for lo, hi in spans(off, 1 << 19):
                o = off[lo : hi + 1]
                x, row, length = segments(data[o[0] : o[-1]], o - o[0])
                for s in range(0, len(row), _AT_ONCE):  # one very long text has many segments
                    q = model.probabilities(x[:, s : s + _AT_ONCE])[CONTEXT : CONTEXT + SEGMENT]
                    real = (np.arange(SEGMENT)[:, None] < length[s : s + _AT_ONCE]).astype(np.float32)
                    top = q.argmax(axis=2)
                    rows = lo + row[s : s + _AT_ONCE]
                    np.add.at(pooled, rows, np.einsum("tnk,tn->nk", q, real))
                    np.add.at(votes, rows, np.stack([((top == c) * real).sum(axis=0) for c in range(k)], axis=1))
            some = np.maximum(size, 1)
            keep = (size > 0) & (pooled[:, none] / some < most_none)
            best = pooled.argmax(axis=1)
            best[size == 0] = none
            i = np.arange(b.num_rows)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([model.classes[c] for c in best], pa.string()),
                    pa.array(np.round(pooled[i, best] / some, 6)),
                    pa.array(np.round(votes[i, best] / some, 6)),
                    pa.array(size),
                    pa.array(keep),
                ],
                ["doc_id", "lang", "confidence", "agreement", "n_bytes", "keep"],
            )

    return run


def identify(docs: DataFrame, model: ByteGRU, id_col: str = "doc_id", text_col: str = "text", most_none: float = MOST_NONE) -> DataFrame:
    """One row per row of docs: (doc_id, lang, confidence, agreement, n_bytes, keep).

    confidence is the mean probability of lang over all bytes of the text,
    agreement the share of bytes that the network labels so. keep is false where
    the mean probability of NONE is most_none or more: a text in a language or
    script without a label is OTHER and is kept.

    Null and empty texts give NONE with confidence and agreement 0 and aren't
    kept: they are in no language. Texts of any length are read whole, a bounded
    number of bytes at a time. Null ids are kept, repeated rows each give a row,
    ties go to the class that sorts first (OTHER and NONE last). An empty table
    gives an empty result. Other columns are ignored, whatever their names. Ids
    have to be of whole numbers, else a TypeError.
    """
    d = only(docs, doc_id=id_col, text=text_col)
    return d.mapInArrow(_label(model, most_none), _OUT)


def accepted(docs: DataFrame, model: ByteGRU, text_col: str = "text", most_none: float = MOST_NONE) -> DataFrame:
    """The rows of docs, all columns, that identify() would keep.

    Every row is judged by its own text, in place, so ids may be null or
    repeated; null and empty texts go, texts of any length are read whole and
    equal texts share their fate. An empty table gives an empty result; other
    columns, whatever their names, keep their values.
    """
    fields = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, at = _label(model, most_none), fields.index(text_col)
        for b in pieces(batches, at):
            own = pa.RecordBatch.from_arrays([pa.array(np.arange(b.num_rows)), b.column(at)], ["doc_id", "text"])
            for r in label(iter([own])):
                yield b.filter(r.column(5))

    return in_place(docs, run)

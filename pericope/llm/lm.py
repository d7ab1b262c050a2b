"""Language-model scores of documents by a causal self-attention model in numpy.

Texts become subword ids of a public tokenizer, whose file is a parameter; they
are stored once, and everything after reads them. The model is one causal
attention layer over token and place embeddings. It predicts the class of the
next subword; the most frequent subwords are classes of their own, and all others
are put in classes by the company they keep: the subwords that stand to their
left and right all over the corpus. Within a class, subwords follow their corpus
counts. Counts are over all documents, and all are trained on. Training is
distributed: the documents are dealt out to a few rounds, so that each is learned
from once; in a round every partition steps through its own documents, and the
weights are averaged, in a tree, by the number of windows. No worker sees more
than its part, and the result depends on how the table is partitioned.

Scoring reads windows of WINDOW subwords, of which the first CONTEXT belong to
the window before, so every subword is scored once, with CONTEXT or more
subwords before it wherever the text has them.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pericope.llm.shared import CHUNK, cut, only, pieces, spans, tidy, utf8, words

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How the tokenizer splits text before it merges bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts where every white space is one space with something after it; without looking ahead it runs faster.
SPACED = PATTERN.replace(r"\s+(?!\S)|", "")
_WIDE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
WINDOW, CONTEXT, DIM, CLASSES, INPUTS = 32, 8, 12, 64, 4096
#: Classes of one subword each, and how many frequent subwords are told apart as neighbours.
ALONE, NEIGHBOURS = 16, 64
#: Rounds that the documents are dealt out to; each document is trained on in one of them.
ROUNDS = 2
_STRIDE = WINDOW - CONTEXT
_BOS = INPUTS
_NOSPACE = np.ones(256, bool)
_NOSPACE[[9, 10, 11, 12, 13, 32]] = False


# --------------------------------------------------------------------------
# subwords


class Subwords:
    """Subword ids of texts whose white space counts as single spaces, looked up per distinct word."""

    def __init__(self, file: str = TOKENIZER, most: int = 250_000):
        import tiktoken

        with open(file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.spaced = tiktoken.Encoding("spaced", pat_str=SPACED, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(self.encoding.n_vocab, np.int64)  # in bytes, by id
        for x, i in ranks.items():
            self.length[i] = len(x)
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.at: dict[int, int] = {}
        self.start = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.int32)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the subwords of all rows."""
        row, start, end, h = words(data, offsets, _NOSPACE)
        if not len(row):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        order = np.argsort(h)
        h = h[order]
        head = np.concatenate([[True], h[1:] != h[:-1]])
        u, first, inv = h[head], order[head], np.empty(len(h), np.int64)  # any occurrence of a word will do
        inv[order] = np.cumsum(head) - 1
        if len(self.at) > self.most:
            self._clear()
        at = self.at
        place = np.array([at.get(x, -1) for x in u.tolist()], np.int64)
        new = np.flatnonzero(place < 0)
        if len(new):
            ids, size = self._words(data, start[first[new]], end[first[new]])
            n = len(self.start) - 1
            at.update(zip(u[new].tolist(), range(n, n + len(new))))
            place[new] = np.arange(n, n + len(new))
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(size)])
            self.ids = np.concatenate([self.ids, ids])
        p = place[inv]
        size = self.start[p + 1] - self.start[p]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.arange(total[-1]) - np.repeat(total[:-1] - self.start[p], size)]
        return ids, total[np.searchsorted(row, np.arange(len(offsets)))]

    def _words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each word) of words with a space before each.

        All in one call: no subword spans a space that has something before it,
        so the words' ends are found again among those of the subwords.
        """
        want = np.cumsum(end - start + 1)
        place = np.arange(want[-1]) - np.repeat(want - (end - start + 1), end - start + 1)
        joined = np.where(place > 0, data[np.repeat(start - 1, end - start + 1) + place], 32).astype(np.uint8).tobytes()
        try:
            text = joined.decode()
            ids = np.array((self.encoding if _WIDE_SPACE.search(text) else self.spaced).encode_ordinary(text), np.int32)
            ends = np.cumsum(self.length[ids])
            at = np.searchsorted(ends, want)
            if at[-1] == len(ids) - 1 and (ends[at] == want).all():
                return ids, np.diff(at, prepend=-1)
        except UnicodeDecodeError:
            pass
        got = [self.encoding.encode_ordinary(joined[a:z].decode("utf-8", "replace")) for a, z in zip([0, *want[:-1].tolist()], want.tolist())]
        return np.array([x for g in got for x in g], np.int32), np.array([len(g) for g in got])


_loaded: dict[str, Subwords] = {}


def subwords(file: str) -> Subwords:
    """One per worker process."""
    if file not in _loaded:
        _loaded[file] = Subwords(file)
    return _loaded[file]


# --------------------------------------------------------------------------
# the model


class Vocabulary:
    """From corpus counts by id: what the model reads (input), what it predicts (cls) and the log share within the class.

    near: by id, how often each of the NEIGHBOURS most frequent subwords, and any
    other, stands to its left and to its right. Without it classes are bands of
    frequency.
    """

    def __init__(self, counts: np.ndarray, near: np.ndarray | None = None):
        order = np.lexsort((np.arange(len(counts)), -counts))
        self.rank = np.empty(len(counts), np.int64)
        self.rank[order] = np.arange(len(counts))
        own = INPUTS - 128
        self.input = np.where(self.rank < own, self.rank, own + self.rank % 128).astype(np.int32)
        soft = (counts + 0.5).astype(np.float64)
        rest, k = order[ALONE:], CLASSES - ALONE
        cls = np.empty(len(counts), np.int64)
        cls[order[:ALONE]] = np.arange(min(ALONE, len(order)))
        if len(rest):
            mass = np.cumsum(soft[rest])
            cls[rest] = ALONE + np.minimum(k - 1, ((mass - soft[rest] / 2) / mass[-1] * k).astype(np.int64))
            seen = rest[counts[rest] > 0]
            if near is not None and len(seen) > k:
                cls[seen] = ALONE + _alike(near[seen], cls[seen] - ALONE, counts[seen], k)
        mass = np.bincount(cls, soft, CLASSES)
        self.cls, self.log_share = cls.astype(np.int32), np.log(soft / mass[cls]).astype(np.float32)
        self.log_class = np.log(np.maximum(mass, 1e-9) / mass.sum()).astype(np.float32)
        self.log_unigram = np.log(soft / soft.sum())


def _alike(near: np.ndarray, first: np.ndarray, counts: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Classes, 0 .. k - 1, of rows of neighbour counts: spherical k-means over the roots of their shares, from the classes given."""
    x = near.astype(np.float32)
    x /= np.maximum(1, x.sum(axis=1))[:, None]
    np.sqrt(x, out=x)
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-9
    weight, cls = np.sqrt(counts).astype(np.float32), first
    for _ in range(rounds):
        hot = np.zeros((k, len(x)), np.float32)
        hot[cls, np.arange(len(x))] = weight
        centre = hot @ x
        centre /= np.linalg.norm(centre, axis=1, keepdims=True) + 1e-9
        cls = (x @ centre.T).argmax(axis=1)
    return cls


def weights(vocabulary: Vocabulary, seed: int = 9) -> dict[str, np.ndarray]:
    r, d, f = np.random.default_rng(seed), DIM, np.float32
    s = d**-0.5
    return {
        "T": r.normal(0, 0.3, (INPUTS + 1, d)).astype(f),
        "P": r.normal(0, 0.1, (WINDOW, d)).astype(f),
        "Q": r.normal(0, s, (d, d)).astype(f),
        "K": r.normal(0, s, (d, d)).astype(f),
        "V": r.normal(0, s, (d, d)).astype(f),
        "O": r.normal(0, s, (d, CLASSES)).astype(f),
        "b": vocabulary.log_class.copy(),
    }


#: place m of the scored ones sees window places 0 .. CONTEXT + m
_SEEN = np.arange(WINDOW)[None, :] <= CONTEXT + np.arange(_STRIDE)[:, None]


def windows(ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, row): places in ids that each window reads (N, WINDOW) and scores (N, stride), and its row. -1: nothing there; -2: the beginning of the text."""
    size = np.diff(offsets)
    per = -(-size // _STRIDE)
    row = np.repeat(np.arange(len(size)), per)
    base = offsets[row] + (np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)) * _STRIDE
    x, y = base[:, None] + np.arange(-1 - CONTEXT, _STRIDE - 1), base[:, None] + np.arange(_STRIDE)
    # only the first and the last window of a text reach beyond it
    at = np.flatnonzero(base == offsets[row])
    x[at, :CONTEXT], x[at, CONTEXT] = -1, -2
    at = np.flatnonzero(base + _STRIDE > offsets[row + 1])
    hi = offsets[row[at] + 1][:, None]
    x[at], y[at] = np.where(x[at] < hi, x[at], -1), np.where(y[at] < hi, y[at], -1)
    return x, y, row


def _softly(z: np.ndarray) -> None:
    """exp in place, of at most exp(60)."""
    if z.max(initial=0) > 60:
        np.minimum(z, 60, out=z)
    np.exp(z, out=z)


def gradients(p: dict[str, np.ndarray], x: np.ndarray, hidden: np.ndarray, y: np.ndarray, live: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy and its gradients. x: (N, WINDOW) inputs, hidden: not to be attended; y: (N, stride) classes, live: to be scored.

    The weights of attention are not divided by their sum: the values mixed with
    them are, which are narrower.
    """
    (n, w), m, d, kind = x.shape, y.shape[1], p["T"].shape[1], p["T"].dtype.type
    scale, classes = kind(d**-0.5), p["O"].shape[1]
    # a one beside every input, which becomes one beside its value; two of them, of the value and of the input, take half the bias along
    table, place = np.ones((len(p["T"]), d + 1), kind), np.zeros((w, d + 1), kind)
    table[:, :d], place[:, :d] = p["T"], p["P"]
    wide, back, out, o_back = np.zeros((d + 1, 3 * d + 1), kind), np.zeros((3 * d, d + 1), kind), np.empty((d + 1, classes), kind), np.zeros((classes, d + 1), kind)
    wide[:d, :d], wide[:d, d : 2 * d], wide[d, 2 * d], wide[:d, 2 * d + 1 :] = p["K"], p["V"], 1, p["Q"] * scale
    back[:d, :d], back[d : 2 * d, :d], back[2 * d :, :d] = p["K"].T, p["V"].T, p["Q"].T * scale
    out[:d], out[d], o_back[:, :d] = p["O"], p["b"] / 2, p["O"].T
    e = np.take(table, x, axis=0)
    e += place
    rows = e.reshape(-1, d + 1)
    kvq = (rows @ wide).reshape(n, w, 3 * d + 1)
    k, v, q = kvq[..., :d], kvq[..., d : 2 * d + 1], kvq[:, CONTEXT:, 2 * d + 1 :]
    a = np.matmul(q, k.transpose(0, 2, 1))
    _softly(a)
    a *= _SEEN.astype(kind)
    odd = np.flatnonzero(hidden.any(axis=1))  # the first and the last window of a text
    if len(odd):
        a[odd] *= ~hidden[odd][:, None, :]
    mixed = np.matmul(a, v)
    over = 1 / mixed[..., d:]
    mixed *= over
    h = (mixed + e[:, CONTEXT:]).reshape(-1, d + 1)
    z = h @ out
    _softly(z)
    total, scored, whole = max(1.0, float(live.sum())), live.ravel().astype(kind), z @ np.ones(classes, kind)
    flat, at = z.reshape(-1), np.arange(0, z.size, classes) + y.ravel()
    got = flat[at]
    loss = float(-(np.log(got / whole + 1e-12) @ scored) / total)
    flat[at] = got - whole
    z *= (scored / whole / kind(total))[:, None]
    slopes = (z.T @ h).T
    g = {"O": slopes[:d], "b": slopes[d] / 2}
    dh = (z @ o_back).reshape(n, m, d + 1)
    # slopes of the mixed values and, in the last column, what is taken off at every place: the sum of the weights times theirs
    turned = dh * over
    turned[..., d] = -np.einsum("nd,nd->n", turned.reshape(-1, d + 1), mixed.reshape(-1, d + 1)).reshape(n, m)
    ds = np.matmul(turned, v.transpose(0, 2, 1))
    ds *= a
    dkvq = np.zeros((n, w, 3 * d), kind)
    np.matmul(ds.transpose(0, 2, 1), q, out=dkvq[..., :d])
    np.matmul(a.transpose(0, 2, 1), turned[..., :d], out=dkvq[..., d : 2 * d])
    np.matmul(ds, k, out=dkvq[:, CONTEXT:, 2 * d :])
    dkvq = dkvq.reshape(-1, 3 * d)
    slopes = (dkvq.T @ rows).T
    g["K"], g["V"], g["Q"] = slopes[:d, :d], slopes[:d, d : 2 * d], slopes[:d, 2 * d :] * scale
    de = (dkvq @ back).reshape(n, w, d + 1)
    de[:, CONTEXT:] += dh
    g["P"] = de.sum(axis=0)[:, :d]
    # the rows of one input together
    cells = (x * np.int64(d + 1))[..., None] + np.arange(d + 1)
    g["T"] = np.bincount(cells.ravel(), de.ravel(), table.size).reshape(table.shape)[:, :d].astype(kind)
    return loss, g


def _adam(p: dict[str, np.ndarray], batches: Iterator[tuple], rate: float) -> tuple[dict[str, np.ndarray], int]:
    names = sorted(p)
    flat = np.concatenate([p[k].ravel() for k in names])
    ends = np.cumsum([p[k].size for k in names])
    p = {k: x.reshape(p[k].shape) for k, x in zip(names, np.split(flat, ends[:-1]))}  # views, which follow the steps
    m, v, q, t = (np.zeros_like(flat) for _ in range(4))
    n = 0
    for step, batch in enumerate(batches, 1):
        _, g = gradients(p, *batch)
        n += len(batch[0])
        np.concatenate([g[k].ravel() for k in names], out=q)
        # m += 0.1 (q - m), v += 0.01 (q q - v)
        np.subtract(q, m, out=t)
        t *= 0.1
        m += t
        q *= q
        q -= v
        q *= 0.01
        v += q
        np.sqrt(v, out=t)
        t *= (1 - 0.99**step) ** -0.5
        t += 1e-7
        np.divide(m, t, out=t)
        t *= rate / (1 - 0.9**step)
        flat -= t
    return p, n


class Model:
    def __init__(self, vocabulary: Vocabulary, p: dict[str, np.ndarray], tokenizer: str, windows: int = 0):
        """windows: how many it was trained on."""
        self.v, self.p, self.tokenizer, self.windows = vocabulary, p, tokenizer, windows

    def known(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The inputs and the classes of ids, with those of places that windows() gives as -2 and -1 at the end."""
        return np.concatenate([np.take(self.v.input, ids), [_BOS, _BOS]]), np.concatenate([np.take(self.v.cls, ids), [0]])

    def batch(self, ids: np.ndarray, x: np.ndarray, y: np.ndarray, known: tuple[np.ndarray, np.ndarray] | None = None):
        """What gradients() takes of windows. known: of the same ids, if there are more batches of them."""
        inputs, classes = known or self.known(ids)
        return np.take(inputs, x), x == -1, np.take(classes, y), y >= 0

    def tables(self):
        """By input and by place, side by side: keys, values, a one, queries, the embedding and a one, so that scoring needs no projection per subword."""
        p, s = self.p, np.float32(DIM**-0.5)

        def of(e: np.ndarray, one: int) -> np.ndarray:
            ones = np.full((len(e), 1), one, np.float32)
            return np.concatenate([e @ p["K"], e @ p["V"], ones, (e @ p["Q"]) * s, e, ones], axis=1)

        return of(p["T"], 1), of(p["P"], 0)

    def log_probs(self, ids: np.ndarray, offsets: np.ndarray, size: int = 256) -> np.ndarray:
        """Natural log-probability of every subword given the ones before it in its window."""
        out = np.zeros(len(ids), np.float32)
        if not len(ids):
            return out
        by_input, by_place = self.tables()
        last, ones, seen = np.concatenate([self.p["O"], self.p["b"][None]]), np.ones(CLASSES, np.float32), _SEEN.astype(np.float32)
        (x, y, _), known = windows(ids, offsets), self.known(ids)
        for lo in range(0, len(x), size):
            xs, ys = x[lo : lo + size], y[lo : lo + size]
            inp, hidden, cls, live = self.batch(ids, xs, ys, known)
            e = np.take(by_input, inp, axis=0)
            e += by_place
            k, v, q, own = e[..., :DIM], e[..., DIM : 2 * DIM + 1], e[:, CONTEXT:, 2 * DIM + 1 : 3 * DIM + 1], e[:, CONTEXT:, 3 * DIM + 1 :]
            s = np.matmul(q, k.transpose(0, 2, 1))
            _softly(s)
            s *= seen
            at = np.flatnonzero(hidden.any(axis=1))
            if len(at):
                s[at] *= ~hidden[at][:, None, :]
            # the one beside the values sums the weights in the same product; a one in its place then takes the bias along
            h = np.matmul(s, v)
            h *= 1 / np.maximum(h[..., DIM:], 1e-30)
            h += own
            h[..., DIM] = 1
            z = h.reshape(-1, DIM + 1) @ last
            if z.max() > 60:
                np.minimum(z, 60, out=z)
            want = z.reshape(-1)[np.arange(0, z.size, CLASSES) + cls.ravel()]
            np.exp(z, out=z)
            got = want - np.log(z @ ones)
            at = ys[live]
            out[at] = got[live.ravel()] + self.v.log_share[ids[at]]
        return out


# --------------------------------------------------------------------------
# over a table


def encoded(docs: DataFrame, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids), stored: the subword ids of every text, 4 bytes each. Null and empty texts, and those of white space alone, have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub = subwords(tokenizer)
        for b in pieces(batches, 1):
            data, off = utf8(b.column(1))
            for lo, hi in spans(off, 4 * CHUNK):
                o = off[lo : hi + 1]
                ids, at = sub.encode(data[o[0] : o[-1]], o - o[0])
                raw = ids.astype("<i4").tobytes()
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([raw[4 * x : 4 * z] for x, z in zip(at, at[1:])], pa.binary())], ["doc_id", "ids"])

    return cut(only(docs, doc_id=id_col, text=text_col).mapInArrow(run, "doc_id long, ids binary"))


def _decoded(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, ids, offsets) of stretches of rows."""
    for b in batches:
        raw, off = utf8(b.column(column))
        for lo, hi in spans(off, 8 * CHUNK):
            yield b.slice(lo, hi - lo), raw[off[lo] : off[hi]].copy().view("<i4"), (off[lo : hi + 1] - off[lo]) // 4
        tidy()


def _counts(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for _, ids, _ in _decoded(batches):
            total += np.bincount(ids, minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["id", "n"])

    return run


def _neighbours(kind: np.ndarray):
    """(id, place, n): how often a subword of a kind stands to the left of an id, and to the right, where places go on."""
    k, size = NEIGHBOURS + 1, len(kind)
    kind = kind.astype(np.int32 if size * 2 * k < 2**31 else np.int64)  # narrow cells sort faster

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * 2 * k, np.int32)
        for _, ids, off in _decoded(batches):
            inner = np.ones(len(ids), bool)
            inner[off[:-1][off[:-1] < len(ids)]] = False
            at = np.flatnonzero(inner)  # not the first of its text
            left, right = ids[at - 1], ids[at]
            cell, n = np.unique(np.concatenate([right * (2 * k) + kind[left], left * (2 * k) + k + kind[right]]), return_counts=True)
            total[cell] += n.astype(np.int32)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((cell // (2 * k)).astype(np.int32)), pa.array((cell % (2 * k)).astype(np.int16)), pa.array(total[cell].astype(np.int64))], ["id", "place", "n"])

    return run


def _steps(model: Model, rate: float, batch: int = 256, first: int = 64):
    """Trains a copy on the documents of one partition; a row per part of the weights, (part, src, n, v), src being the partition.

    The first batches are smaller, so that a partition of few documents takes some steps too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        def data() -> Iterator[tuple]:
            n = 0
            for _, ids, cut_at in _decoded(batches):
                if not len(ids):
                    continue
                (x, y, _), known = windows(ids, cut_at), model.known(ids)
                order = np.random.default_rng(len(ids)).permutation(len(x))
                s = 0
                while s < len(order):
                    own = order[s : s + (batch if n >= first else first)]
                    yield model.batch(ids, x[own], y[own], known)
                    s, n = s + len(own), n + 1

        p, n = _adam(model.p, data(), rate)
        if n:
            names, k = sorted(p), len(p)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([TaskContext.get().partitionId()] * k, pa.int64()), pa.array([n] * k, pa.int64()), pa.array([p[x].astype(np.float32).tobytes() for x in names], pa.binary())], ["part", "src", "n", "v"])

    return run


_PARTS = "part string, src long, n long, v binary"
#: How many sets of weights one task averages.
_FAN = 64


def _average(t: pa.Table) -> pa.Table:
    n = t["n"].to_numpy().astype(np.float64)
    total = sum(np.frombuffer(v.as_py(), np.float32) * w for v, w in zip(t["v"], n))
    return pa.Table.from_arrays([t["part"].slice(0, 1), t["src"].slice(0, 1), pa.array([int(n.sum())], pa.int64()), pa.array([(total / n.sum()).astype(np.float32).tobytes()], pa.binary())], ["part", "src", "n", "v"])


def train(table: DataFrame, tokenizer: str = TOKENIZER, rounds: int = ROUNDS) -> Model:
    """Counts the subwords of all texts of encoded() and trains on all of them, each in one of the rounds, by the hash of its subwords.

    Rows without subwords are passed over; repeated rows each count. Without any
    subword the model holds every one equally likely.
    """
    d = table.where("octet_length(ids) > 0").select("ids")
    size = subwords(tokenizer).encoding.n_vocab
    counts = np.zeros(size, np.int64)
    got = d.mapInArrow(_counts(size), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # a row per id of the vocabulary at most
    for r in got:
        counts[r["id"]] = r["n"]
    kind = np.minimum(Vocabulary(counts).rank, NEIGHBOURS).astype(np.int64)
    near = np.zeros((size, 2 * (NEIGHBOURS + 1)), np.float32)
    cells = d.mapInArrow(_neighbours(kind), "id int, place short, n long").groupBy("id", "place").agg(F.sum("n").alias("n"))
    for r in cells.groupBy("id").agg(F.collect_list(F.struct("place", F.col("n").cast("float").alias("n"))).alias("cells")).toLocalIterator():  # again a row per id, of a fixed number of places
        for place, n in r["cells"]:
            near[r["id"], place] = n
    v = Vocabulary(counts, near)
    model, parts = Model(v, weights(v), tokenizer), d.rdd.getNumPartitions()
    for k in range(rounds):
        new = d.where(F.pmod(F.xxhash64("ids"), F.lit(rounds)) == k).mapInArrow(_steps(model, 0.03 / (1 + k)), _PARTS)
        # averaged where the parts are gathered, a bounded number at a time; the driver gets one set of weights
        n = parts
        while n > 1:
            n = -(-n // _FAN)
            new = new.withColumn("src", F.expr(f"src div {_FAN}L")).groupBy("part", "src").applyInArrow(_average, _PARTS)
        new = new.collect()
        if new:
            model = Model(v, {r["part"]: np.frombuffer(bytes(r["v"]), np.float32).reshape(model.p[r["part"]].shape) for r in new}, tokenizer, model.windows + new[0]["n"])
    return model


def score(table: DataFrame, model: Model) -> DataFrame:
    """One row per row of encoded(): (doc_id, n_tokens, log_prob, perplexity).

    log_prob is the natural logarithm of the text's probability, the sum over
    all its subwords; perplexity is exp(-log_prob / n_tokens).

    Null and empty texts, and texts of white space alone, have no subwords:
    n_tokens 0, log_prob 0 and a null perplexity. Texts of any length are scored
    whole. Null ids are kept, repeated rows each give a row with equal scores,
    ties can't matter. An empty table gives an empty result. encoded() ignores
    other columns, whatever their names; ids have to be of whole numbers, else
    it raises a TypeError.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, ids, at in _decoded(batches, 1):
            lp = np.concatenate([[0.0], np.cumsum(model.log_probs(ids, at), dtype=np.float64)])
            n, total = np.diff(at), lp[at[1:]] - lp[at[:-1]]
            ppl = np.exp(np.minimum(700, -total / np.maximum(n, 1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(np.round(total, 4)), pa.array(np.round(ppl, 4), mask=n == 0)], ["doc_id", "n_tokens", "log_prob", "perplexity"])

    return table.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, log_prob double, perplexity double")

"""Personal data and secrets by a linear-chain conditional random field over word shapes.

Words are runs without white space. What the field sees of a word is its shape
(letters, digits and marks, not the letters themselves) and, for a few cue
words, which cue it is; of its neighbours it sees the same. The field is trained
on a small labelled table and decoded by Viterbi for many sequences at a time.

Shapes repeat far more often than words, so features are looked up per distinct
shape and everything per word is array work.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from pericope.llm.shared import in_place, only, pieces, spans, utf8, words

LABELS = ["O", "B-EMAIL", "B-IP", "B-CARD", "I-CARD", "B-SECRET", "B-PHONE", "I-PHONE", "B-SSN", "B-IBAN", "I-IBAN"]
_STRIP = b"\"'.,;:!?[]{}<>|*#%&$~`^"
_CUES = ["token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "key", "bearer", "tel", "phone", "call", "fax", "card", "visa", "email", "mail", "ip", "host", "=", ":", "version", "page", "isbn", "order", "ssn", "iban", "reset", "is", "must"]

_NOSPACE = np.ones(256, bool)
_NOSPACE[[9, 10, 11, 12, 13, 32]] = False
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("a") : ord("z") + 1] = ord("x")
_CLASS[ord("A") : ord("Z") + 1] = ord("X")
_CLASS[ord("0") : ord("9") + 1] = ord("d")
_CLASS[128:] = ord("x")


# --------------------------------------------------------------------------
# the labelled table


def labelled_table(rows: int = 1500, seed: int = 5) -> list[tuple[list[str], list[str]]]:
    """(words, labels) of invented lines: names of nothing, with personal data in the forms that occur in text, and with look-alikes that are none."""
    r = np.random.default_rng(seed)
    syllables = "an the or ing tion er es ka lo mi ra de quo ba é über ña zu sch eau".split()
    digits = lambda n: "".join(map(str, r.integers(0, 10, n)))
    hexes = lambda n: "".join("0123456789abcdef"[i] for i in r.integers(0, 16, n))
    mixed = lambda n: "".join("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789"[i] for i in r.integers(0, 59, n))

    def word() -> str:
        w = "".join(r.choice(syllables, r.integers(1, 5)))
        k = r.integers(0, 14)
        if k == 0:
            w = w.capitalize()
        elif k == 1:
            w = w.upper()
        w += str(r.choice(["", "", "", "", "", "", ".", ",", ";", "!!", "###", "%%%", "***", "$$$", "&&&", "...", ":", ")", "?"]))
        if r.integers(0, 40) == 0:
            w = w[: max(1, len(w) // 2)] + "-" + w[max(1, len(w) // 2) :]
        return w

    def pick(*x: str) -> str:
        return str(r.choice(x))

    def low(n: int = 4) -> str:
        return "".join(r.choice(syllables[:16], r.integers(1, n)))

    def plain() -> list[str]:
        k = r.integers(0, 24)
        return [
            [digits(r.integers(1, 8))], [digits(4)], ["|"], [digits(1) + "." + digits(2)], [digits(2) + "," + digits(3)], [f"{digits(1)}.{digits(1)}.{digits(1)}"],
            [f"20{digits(2)}-0{r.integers(1, 9)}-1{digits(1)}"], [f"1{digits(1)}:3{digits(1)}"], ["version", digits(1) + "."], ["=", digits(2)], ["(c)", "20" + digits(2)], [f"p.{digits(3)}"],
            [f"https://{word().lower().strip('.,;:!?#%*$&)')}.example.org/{digits(3)}"], ["$" + digits(3)], [f"{digits(3)}-{digits(2)}"],
            [pick("isbn", "ISBN", "ISBN:"), pick(f"978-{digits(1)}-{digits(3)}-{digits(5)}-{digits(1)}", f"978{digits(10)}")], [f"{pick('@', '#')}{low()}"], [pick("password", "token", "key"), pick("is", "reset", "must"), low()], [f"1{digits(1)}:3{digits(1)}:{digits(2)}"],
            [low() + "()"], [f"({low()})"], [f"({digits(4)})"], [f"{low()}.{pick('py', 'com', 'org', 'txt')}"], [f"{low()}-{digits(2)}"],
        ][k]

    def address() -> str:
        name = pick(f"{low(3)}.{digits(2)}", low(3), f"{low(3)}_{digits(1)}", digits(2), f"{low(3)}.{low(3)}", f"{low(3).capitalize()}.{digits(3)}", f"{low(3)}+{low(2)}", "".join(r.choice(list("abcdefgh"), 2)), f"{low(3)}-{low(2)}", pick("a", "b", "c"), low(3).upper())
        host = pick(f"{pick('mail', 'web', 'post')}{pick('', digits(1))}.example", low(3), f"{low(3)}.co", f"{low(2)}.{low(3)}", f"{low(2)}-{low(2)}", f"{low(3)}{digits(1)}", pick("d", "e"))
        return f"{name}@{host}.{pick('com', 'org', 'net', 'uk', 'de', 'io', 'fr', 'info')}"

    def private() -> tuple[list[str], list[str]]:
        k = r.integers(0, 14)
        if k < 2:
            a = address()
            if r.integers(0, 3) == 0:
                a = [f"<{a}>", f"({a})", f"[{a}]", f"{a},{address()}", f"{a};{address()}", f"mailto:{a}", f'"{a}"'][r.integers(0, 7)]
            return [a], ["B-EMAIL"]
        if k == 2:
            return [".".join(str(r.integers(0, r.choice([10, 100, 256]))) for _ in range(4)) + pick("", "", "", f":{digits(4)}")], ["B-IP"]
        if k == 3:
            groups = [hexes(r.integers(1, 5)) for _ in range(8)]
            return [pick(":".join(groups), f"{groups[0]}:{groups[1]}::{groups[2]}", f"fe80::{groups[0]}:{groups[1]}:{groups[2]}:{groups[3]}", f"2001:db8::{groups[4]}", f"2001:0db8:85a3:0000:0000:8a2e:0370:{digits(4)}")], ["B-IP"]
        if k == 4:
            return [pick(digits(16), digits(16), digits(r.integers(13, 20)), digits(15), "-".join(digits(4) for _ in range(4)), f"{digits(4)}-{digits(6)}-{digits(5)}")], ["B-CARD"]
        if k == 5:
            size = [4, 4, 4, 4] if r.integers(0, 3) else [4, 6, 5]
            return [digits(n) for n in size], ["B-CARD"] + ["I-CARD"] * (len(size) - 1)
        if k in (6, 7):
            quote = pick('"', "'", "")
            cue = pick("token", "secret", "api_key", "password", "key", "bearer") if k == 6 else pick("password", "passwd", "pwd", "secret", "Password")
            value = pick(hexes(40), hexes(32), mixed(24), mixed(40), hexes(64), "sk-" + mixed(24)) if k == 6 else pick(low() + digits(r.integers(1, 5)), low(3).capitalize() + digits(2) + pick("!", "#", ""), mixed(r.integers(8, 14)), low(3) + "_" + digits(3), digits(1) + low(3) + digits(1))
            value = quote + value + quote
            return ([cue, "=", value], ["O", "O", "B-SECRET"]) if r.integers(0, 2) else ([cue + ":", value], ["O", "B-SECRET"])
        if k == 8:
            return [f"+{r.integers(1, 99)}", f"({digits(3)})", f"{digits(3)}-{digits(4)}"], ["B-PHONE", "I-PHONE", "I-PHONE"]
        if k == 9:
            return [f"({digits(3)})", f"{digits(3)}-{digits(4)}"], ["B-PHONE", "I-PHONE"]
        if k == 10:
            return ([f"{digits(3)}{(d := pick('-', '.'))}{digits(3)}{d}{digits(4)}"], ["B-PHONE"]) if r.integers(0, 2) else ([f"+{r.integers(1, 99)}", digits(2), digits(4), digits(4)], ["B-PHONE", "I-PHONE", "I-PHONE", "I-PHONE"])
        if k == 11:
            return [f"{digits(3)}-{digits(2)}-{digits(4)}"], ["B-SSN"]
        country = "".join(r.choice(list("ABCDEFGHIKLMNPRST"), 2))
        if k == 12:
            return [country + digits(2) + pick(digits(18), digits(20), "ABCD"[: r.integers(0, 5)] + digits(16))], ["B-IBAN"]
        rest = [digits(4) for _ in range(r.integers(3, 6))] + [digits(2)]
        return [country + digits(2), *rest], ["B-IBAN"] + ["I-IBAN"] * len(rest)

    out = []
    for i in range(rows):
        w, y = [], []
        for _ in range(r.integers(1, 4)):
            for _ in range(r.choice([0, 0, 1, 2, 3, 4])):
                w.append(word())
                y.append("O")
            if i % 3 == 0 or r.integers(0, 4) == 0:
                p = plain()
                w += p
                y += ["O"] * len(p)
            if i % 4:
                p, q = private()
                if r.integers(0, 3) == 0:
                    p[-1] += str(r.choice([".", ",", ";", "!!", "%%%", "***"]))
                w += p
                y += q
        for _ in range(r.integers(1, 4)):
            w.append(word())
            y.append("O")
        out.append((w, y))
    return out


# --------------------------------------------------------------------------
# features


def core(token: bytes) -> tuple[int, int]:
    """(start, end) of a word without the marks around it, brackets too where they hold more than the digits of a phone number's area."""
    left = len(token) - len(token.lstrip(_STRIP))
    right = len(token.rstrip(_STRIP))
    if right <= left:
        return 0, len(token)
    c = token[left:right]
    if b"(" in c[:1] + c[-1:] or b")" in c[:1] + c[-1:]:
        inner = c.strip(b"()")
        if inner and not (inner.isdigit() and len(inner) <= 5):
            left += len(c) - len(c.lstrip(b"()"))
            right -= len(c) - len(c.rstrip(b"()"))
            if left > 0 and right - left > 0:
                more = token[left:right]
                left, right = left + len(more) - len(more.lstrip(_STRIP)), right - (len(more) - len(more.rstrip(_STRIP)))
    return (left, right) if right > left else (0, len(token))


def features(token: bytes, cue: int) -> list[str]:
    a, z = core(token)
    inner = token[a:z]
    shape = _CLASS[np.frombuffer(inner, np.uint8)].tobytes().decode("latin-1")
    short = re.sub(r"(.)\1+", r"\1+", shape)
    n, d = len(inner), shape.count("d")
    flips = sum(a != b for a, b in zip(shape, shape[1:]))
    letters = shape.count("x") + shape.count("X")
    code = d > 0 and letters > 0 and d + letters == n and n >= 16
    hexed = shape.count(":") >= 2 and bool(re.fullmatch(r"[xXd:]*", shape)) and all(len(g) <= 4 for g in shape.split(":"))
    groups = "-".join(str(len(g)) for g in shape.split("-")) if "-" in shape and set(shape) <= {"d", "-"} else ""
    out = [
        "bias",
        "s=" + short[:20],
        "c=" + short.replace("+", "")[:20] if "+" not in shape else "c=" + re.sub(r"(.)\1+", r"\1", shape)[:20],
        "f=" + shape if n <= 16 else "long",
        f"n={min(n, 8) if n < 16 else 16 if n < 20 else 20}",
        f"d={d}" if d <= 19 else "d>19",
        f"k={'d' if d == n else 'x' if letters == n else 'm' if d else 'p' if letters == 0 else 'w'}",
        "@" + str(bool(re.search(r"[^@]@[^@]+\.[xX]{2}", shape))),
        "dots=" + str(min(shape.count("."), 4)),
        "code=" + str(code and flips >= 4),
        "hex=" + str(hexed and d > 0),
        "groups=" + groups,
        "iban=" + ("a" if re.fullmatch(r"XXdd[dX]{11,30}", shape) else "b" if shape == "XXdd" else ""),
        "both=" + str(d > 0 and letters > 0),
        "open=" + token[:1].decode("latin-1") if token[:1] in (b'"', b"'", b"(", b"+") else "open=",
    ]
    if cue:
        out.append("cue=" + _CUES[cue - 1])
    return out


def _cue_prints() -> tuple[np.ndarray, np.ndarray]:
    forms = [(w + end, i + 1) for i, c in enumerate(_CUES) for w in dict.fromkeys((c, c.capitalize(), c.upper())) for end in dict.fromkeys(("", ":") if c not in "=:" else ("",))]
    data = np.frombuffer("".join(f for f, _ in forms).encode(), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(f.encode()) for f, _ in forms])])
    h = words(data, off, _NOSPACE)[3]
    order = np.argsort(h)
    return h[order], np.array([i for _, i in forms])[order]


class Tokens:
    """The words of a buffer, with a key per word that stands for its shape and cue."""

    cues: tuple[np.ndarray, np.ndarray] | None = None

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        if Tokens.cues is None:
            Tokens.cues = _cue_prints()
        prints, ids = Tokens.cues
        self.data = data
        self.row, self.start, self.end, h = words(data, offsets, _NOSPACE)
        if not len(h):
            self.key, self.cue = h, np.zeros(0, np.int64)
            return
        # the class of white space is itself, so the words of the shapes are at the same places
        shape = words(_CLASS[data], offsets, _NOSPACE)[3]
        at = np.minimum(np.searchsorted(prints, h), len(prints) - 1)
        self.cue = np.where(prints[at] == h, ids[at], 0)
        self.key = shape ^ (self.cue.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def token(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


# --------------------------------------------------------------------------
# the field


def forward_backward(e: np.ndarray, trans: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log partition, label marginals (T, N, L), expected transitions (L, L)) of N sequences with scores e: (T, N, L)."""
    t_n, n, k = e.shape
    live = np.arange(t_n)[:, None] < length
    top = e.max(axis=2)
    x, m = np.exp(e - top[..., None]), np.exp(trans)
    # each place's messages are scaled to a sum of 1; the scales make up the partition
    a, b, s = np.empty_like(x), np.ones_like(x), np.ones((t_n, n))
    for t in range(t_n):
        own = x[0] if t == 0 else (a[t - 1] @ m) * x[t]
        total = own.sum(axis=1)
        s[t] = np.where(live[t], total, 1)
        a[t] = np.where(live[t][:, None], own / total[:, None], a[t - 1] if t else own)
    for t in reversed(range(t_n - 1)):
        b[t] = np.where(live[t + 1][:, None], (x[t + 1] * b[t + 1]) @ m.T / s[t + 1][:, None], 1)
    z = ((np.log(s) + top) * live).sum(axis=0)
    marginal = a * b * live[..., None]
    pair = np.zeros((k, k))
    for t in range(1, t_n):
        pair += a[t - 1].T @ (x[t] * b[t] * (live[t] / s[t])[:, None])
    return z, marginal, pair * m


def viterbi(e: np.ndarray, trans: np.ndarray, length: np.ndarray) -> np.ndarray:
    """(T, N) labels of the best paths; of equal ones, the one with the smaller labels from the end. Beyond a sequence's length: 0."""
    t_n, n, k = e.shape
    back = np.zeros((t_n, n, k), np.int8)
    d = e[0].copy()
    for t in range(1, t_n):
        best = d[:, 0, None] + trans[0]
        arg = back[t]
        for p in range(1, k):
            c = d[:, p, None] + trans[p]
            m = c > best
            np.copyto(best, c, where=m)
            arg[m] = p
        best += e[t]
        live = t < length
        if live.all():
            d = best
        else:
            d = np.where(live[:, None], best, d)
            arg[~live] = np.arange(k)
    out = np.zeros((t_n, n), np.int8)
    y = d.argmax(axis=1)
    i = np.arange(n)
    for t in reversed(range(t_n)):
        out[t] = y
        y = back[t, i, y]
    out[np.arange(t_n)[:, None] >= length] = 0
    return out


class Field:
    """Weights of features at the previous, this and the next word, and of label transitions."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, trans: np.ndarray):
        self.index, self.weights, self.trans = index, weights.astype(np.float32), trans.astype(np.float32)
        self._seen: dict[int, int] = {}
        self._rows: list[np.ndarray] = []

    def __getstate__(self):
        return {"index": self.index, "weights": self.weights, "trans": self.trans, "_seen": {}, "_rows": []}

    def scores(self, k: Tokens) -> np.ndarray:
        """(words, L) label scores; of neighbours in the same row only."""
        u, first, inv = np.unique(k.key, return_index=True, return_inverse=True)
        if len(self._seen) > 200_000:
            self._seen, self._rows = {}, []
        for x, i in zip(u.tolist(), first.tolist()):
            if x not in self._seen:
                f = [self.index[s] for s in features(k.token(i), int(k.cue[i])) if s in self.index]
                self._seen[x] = len(self._rows)
                self._rows.append(self.weights[:, f].sum(axis=1))
        table = np.stack([self._rows[self._seen[x]] for x in u.tolist()], axis=1)
        e = table[1][inv]
        if len(e) > 1:
            same = (k.row[1:] == k.row[:-1])[:, None]
            e[1:] += table[0][inv[:-1]] * same
            e[:-1] += table[2][inv[1:]] * same
        return e

    def decode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[Tokens, np.ndarray]:
        """The words of a buffer and their labels: the best path of every whole row.

        A word whose score for O exceeds all others by more than the transitions
        on its two sides could ever make up for is O on the best path, whatever
        its neighbours are. The rows are cut at these words, and only the runs
        between them are left for Viterbi, with the transitions to both ends.
        """
        k = Tokens(data, offsets)
        labels = np.zeros(len(k.row), np.int8)
        n = len(labels)
        if not n:
            return k, labels
        e, tr = self.scores(k), self.trans
        # what another label can gain by the transitions from before, and to what comes behind; none at a row's ends
        gain = np.maximum(0, (tr - tr[:, :1]).max(axis=0)) + np.maximum(0, (tr - tr[:1, :]).max(axis=1))
        open_ = np.flatnonzero((e[:, :1] - e[:, 1:] <= gain[1:] + 1e-3).any(axis=1))
        if not len(open_):
            return k, labels
        new = np.concatenate([[True], (np.diff(open_) > 1) | (k.row[open_[1:]] != k.row[open_[:-1]])])
        lo = open_[new]
        size = np.diff(np.append(np.flatnonzero(new), len(open_)))
        hi = lo + size
        inner = np.flatnonzero((lo > 0) & (k.row[lo] == k.row[lo - 1]))
        e[lo[inner]] += tr[0]
        inner = np.flatnonzero((hi < n) & (k.row[hi - 1] == k.row[np.minimum(hi, n - 1)]))
        e[hi[inner] - 1] += tr[:, 0]
        order = np.argsort(size, kind="stable")
        s = 0
        while s < len(order):
            # runs of like length, so many that they have a bounded number of words with the padding
            most = max(1, _WORDS // int(size[order[min(len(order) - 1, s + 1023)]]))
            q = order[s : s + min(1024, most)]
            s += len(q)
            at = lo[q] + np.arange(size[q].max())[:, None]
            inside = at < hi[q]
            y = viterbi(e[np.where(inside, at, 0)], tr, size[q])
            labels[at[inside]] = y[inside]
        return k, labels


#: Words that Viterbi decodes at a time, unless one run has more.
_WORDS = 1 << 16


@lru_cache(1)
def train() -> Field:
    """The field of labelled_table(), fitted once in a process."""
    return fit(labelled_table())


def fit(table: list[tuple[list[str], list[str]]], steps: int = 70, rate: float = 0.15, decay: float = 2e-3) -> Field:
    """Maximum likelihood with a Gaussian prior, by Adam over the whole table."""
    lines = [" ".join(w).encode() for w, _ in table]
    data = np.frombuffer(b"".join(lines), np.uint8)
    k = Tokens(data, np.concatenate([[0], np.cumsum([len(x) for x in lines])]))
    gold = np.array([LABELS.index(y) for _, ys in table for y in ys])
    u, first, inv = np.unique(k.key, return_index=True, return_inverse=True)
    index: dict[str, int] = {}
    feats = [[index.setdefault(s, len(index)) for s in features(k.token(i), int(k.cue[i]))] for i in first]
    hot = np.zeros((len(u), len(index)), np.float64)
    for i, f in enumerate(feats):
        hot[i, f] = 1
    n, size = len(table), np.bincount(k.row, minlength=len(table))
    pos = np.arange(len(gold)) - np.repeat(np.cumsum(size) - size, size)
    t_n, m = int(size.max()), len(LABELS)
    unit = np.full((t_n + 2, n), -1)
    unit[pos + 1, k.row] = inv
    y = np.zeros((t_n, n), np.int64)
    y[pos, k.row] = gold
    live = np.arange(t_n)[:, None] < size
    # the gold counts
    near = [np.maximum(unit[i : i + t_n], 0) for i in range(3)]
    there = [(unit[i : i + t_n] >= 0) & live for i in range(3)]
    onehot = np.eye(m)[y] * live[..., None]
    pairs = np.zeros((m, m))
    np.add.at(pairs, (y[:-1][live[1:]], y[1:][live[1:]]), 1)
    w, tr = np.zeros((3, len(index), m)), np.zeros((m, m))
    state = [np.zeros_like(x) for x in (w, tr, w, tr)]
    for step in range(1, steps + 1):
        e = np.zeros((t_n, n, m))
        for i in range(3):
            e += (hot @ w[i])[near[i]] * there[i][..., None]
        _, marginal, expected = forward_backward(e, tr, size)
        d = onehot - marginal
        gw = np.empty_like(w)
        for i in range(3):
            at, v = near[i][there[i]], d[there[i]]
            by = np.stack([np.bincount(at, v[:, c], len(u)) for c in range(m)], axis=1)
            gw[i] = hot.T @ by
        for j, (x, g) in enumerate(((w, gw / n - decay * w), (tr, (pairs - expected) / n - decay * tr))):
            state[j] += 0.1 * (g - state[j])
            state[j + 2] += 0.01 * (g * g - state[j + 2])
            x += rate * (state[j] / (1 - 0.9**step)) / (np.sqrt(state[j + 2] / (1 - 0.99**step)) + 1e-8)
    return Field(index, w, tr)


# --------------------------------------------------------------------------
# over a table


def luhn(digits: bytes) -> bool:
    """Whether 13 to 19 digits end in the check digit of a card's number."""
    d = [c - 48 for c in reversed(digits)]
    return 13 <= len(d) <= 19 and (sum(d[::2]) + sum(2 * c - 9 * (c > 4) for c in d[1::2])) % 10 == 0


def spans_of(k: Tokens, labels: np.ndarray) -> list[tuple[int, int, int, str]]:
    """(row, start, end, kind) in bytes; a word's marks on the outside don't belong to it.

    Addresses that commas or semicolons join in one word are spans of their own.
    Digits that the field calls a card count as one only with a right check digit.
    """
    out: list[tuple[int, int, int, str]] = []
    last = -2
    for i in np.flatnonzero(labels).tolist():
        name = LABELS[labels[i]]
        token = k.token(i)
        left, right = core(token)
        a, row, kind = int(k.start[i]), int(k.row[i]), name[2:]
        if name[0] == "I" and out and last == i - 1 and out[-1][0] == row and out[-1][3] == kind:
            out[-1] = (row, out[-1][1], a + right, kind)
        elif kind == "EMAIL":
            at = left
            for piece in re.split(rb"([,;])", token[left:right]):
                x, z = core(piece) if piece else (0, 0)
                if b"@" in piece:
                    x += len(b"mailto:") if piece[x:].startswith(b"mailto:") else 0
                    out.append((row, a + at + x, a + at + z, kind))
                at += len(piece)
        else:
            out.append((row, a + left, a + right, kind))
        last = i
    return [x for x in out if x[3] != "CARD" or luhn(re.sub(rb"\D", b"", k.data[x[1] : x[2]].tobytes()))]


_OUT = "doc_id long, n_spans int, kinds string, spans array<struct<kind:string,start:int,end:int>>, text string"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _found(field: Field, column: pa.Array) -> tuple[list[list[tuple[str, int, int]]], pa.Array]:
    """Each row's spans, in characters, and the column with them replaced."""
    data, off = utf8(column)
    found: list[list[tuple[str, int, int]]] = [[] for _ in range(len(column))]
    new: dict[int, str] = {}
    for lo, hi in spans(off):
        o = off[lo : hi + 1] - off[lo]
        part = data[off[lo] : off[hi]]
        k, labels = field.decode(part, o)
        by: dict[int, list[tuple[int, int, str]]] = {}
        for row, a, z, kind in spans_of(k, labels):
            by.setdefault(row, []).append((a, z, kind))
        for row, got in by.items():
            pieces, at, chars = [], int(o[row]), 0
            for a, z, kind in got:
                before = part[at:a].tobytes().decode("utf-8", "replace")
                inside = part[a:z].tobytes().decode("utf-8", "replace")
                chars += len(before)
                found[lo + row].append((kind, chars, chars + len(inside)))
                chars += len(inside)
                pieces += [before, f"[{kind}]"]
                at = z
            pieces.append(part[at : o[row + 1]].tobytes().decode("utf-8", "replace"))
            new[lo + row] = "".join(pieces)
    if new:
        mask = np.zeros(len(column), bool)
        mask[list(new)] = True
        column = pc.replace_with_mask(column, pa.array(mask), pa.array([new[i] for i in sorted(new)], column.type))
    return found, column


def redact(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (doc_id, n_spans, kinds, spans, text).

    spans: kind, start and end in characters of the original text, in text
    order; kinds: their distinct kinds, sorted, joined by commas; text: the
    whole text with every span replaced by its kind in brackets.

    Kinds are EMAIL, IP, CARD (13 to 19 digits with a right check digit), SECRET,
    PHONE, SSN and IBAN. A null text stays null and an empty one empty, without
    spans. Texts of any length are decoded whole: the labels are the best path
    over all words of a row. Null ids are kept and repeated rows each give a
    row. Of label sequences with equal scores one is taken, always the same. An
    empty table gives an empty result. Other columns are ignored, whatever their
    names. Ids have to be of whole numbers, else a TypeError.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1):
            found, text = _found(field, b.column(1))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(x) for x in found], pa.int32()),
                    pa.array([",".join(sorted({s[0] for s in x})) for x in found], pa.string()),
                    pa.array([[{"kind": s[0], "start": s[1], "end": s[2]} for s in x] for x in found], _SPANS),
                    text,
                ],
                ["doc_id", "n_spans", "kinds", "spans", "text"],
            )

    return only(docs, doc_id=id_col, text=text_col).mapInArrow(run, _OUT)


def redacted(docs: DataFrame, field: Field, text_col: str = "text", n_chars_col: str | None = "n_chars") -> DataFrame:
    """docs, all rows and columns, with the spans in text_col replaced; n_chars_col, if there is one, is the new text's length where the text changed.

    Rows are treated as in redact(): null and empty texts stay as they are, long
    ones are read whole, equal rows stay equal, an empty table stays empty. Other
    columns, whatever their names and values, aren't touched.
    """
    fields = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = fields.index(text_col)
        for b in pieces(batches, at):
            found, text = _found(field, b.column(at))
            cols = [text if i == at else c for i, c in enumerate(b.columns)]
            if n_chars_col in fields:
                i = fields.index(n_chars_col)
                changed = pa.array([bool(x) for x in found], pa.bool_())
                cols[i] = pc.if_else(changed, pc.utf8_length(text).cast(cols[i].type), cols[i])
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return in_place(docs, run)

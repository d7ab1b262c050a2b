"""The trained operators: gradients, held-out accuracy, brute-force decoding, and awkward rows."""

import itertools
import math
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pericope.llm import gif, html, langid, lm, pii, quality
from pericope.llm.shared import CHUNK, ngrams, spans, utf8, words


def slopes(params, loss_and_gradients, tolerance=1e-5, e=1e-5):
    _, g = loss_and_gradients()
    for k, p in params.items():
        f = p.reshape(-1)
        for i in {int(np.abs(g[k]).argmax()), len(f) // 2}:
            old = f[i]
            f[i] = old + e
            a = loss_and_gradients()[0]
            f[i] = old - e
            b = loss_and_gradients()[0]
            f[i] = old
            assert abs((a - b) / (2 * e) - g[k].reshape(-1)[i]) < tolerance, k


def larger(name):
    """Tables of another size beside those of the tests."""
    at = os.path.join(os.path.dirname(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")), name)
    if not os.path.isdir(at):
        pytest.skip(f"no {name}")
    return at


def double(p):
    return {k: v.astype(np.float64) for k, v in p.items()}


# kernels


def test_words():
    import pyarrow as pa
    import re

    texts = ["The cat, the CAT", "", None, "é a-b_c", "x" * 3000, "tail"]
    data, off = utf8(pa.array(texts).slice(0))
    row, start, end, h = words(data, off)
    raw = data.tobytes()
    want = [(i, w) for i, t in enumerate(texts) for w in re.findall("[0-9A-Za-z\x80-\U0010ffff]+", t or "")]
    assert [(int(r), raw[a:z].decode()) for r, a, z in zip(row, start, end)] == want
    by = {}
    for (_, w), x in zip(want, h.tolist()):
        assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by)
    at, g = ngrams(row, h, 2)
    assert [want[i][0] == want[i + 1][0] for i in at] == [True] * len(at) and len(at) == sum(a[0] == b[0] for a, b in zip(want, want[1:]))
    sliced, o = utf8(pa.array(texts).slice(3, 2))
    assert sliced.tobytes().decode() == "é a-b_c" + "x" * 3000 and o.tolist() == [0, 8, 3008]
    o = np.array([0, 10, CHUNK + 20, CHUNK + 30, CHUNK + 30])
    assert [x for lo, hi in spans(o) for x in range(lo, hi)] == [0, 1, 2, 3]


# language


def test_byte_gru_gradients():
    m = langid.ByteGRU(["a", "b", "c"], 4)
    m.p = double(m.p)
    x = np.random.default_rng(0).integers(0, 257, (7, 5))
    slopes(m.p, lambda: m.gradients(x, np.array([0, 1, 2, 0, 1])), 1e-4, 1e-3)  # its states are of single precision
    m = langid.ByteGRU(["a", "b"], 6)
    assert np.abs(m.probabilities(x) - m._softmax(m.states(x))).max() < 1e-5


@pytest.fixture(scope="module")
def lang_model(spark, sf):
    return langid.train(spark.read.parquet(f"{sf}/documents.parquet"))


def test_language_accuracy(spark, lang_model):
    """On documents that the fit didn't see: those of a larger table."""
    d = spark.read.parquet(f"{larger('sf0.01')}/documents.parquet")
    got = langid.identify(d, lang_model).join(d.select("doc_id", d["lang"].alias("gold")), "doc_id").collect()
    assert np.mean([r["lang"] == r["gold"] for r in got if r["n_bytes"] > 100]) > 0.95
    assert np.mean([r["keep"] for r in got]) > 0.97
    r = langid.identify(spark.createDataFrame([(i, x.decode()) for i, x in enumerate(langid.random_strings(48, 77))], "doc_id long, text string"), lang_model)
    assert r.where("keep").count() <= 3


FOREIGN = {
    "zh": "北京是中华人民共和国的首都，位于华北平原的北部。这座城市有三千多年的历史，人口超过两千万。",
    "ru": "Москва — столица России, город федерального значения. Население города составляет более двенадцати миллионов человек.",
    "ar": "القاهرة هي عاصمة جمهورية مصر العربية وأكبر مدنها، وتقع على ضفاف نهر النيل في شمال البلاد.",
    "el": "Η Αθήνα είναι η πρωτεύουσα της Ελλάδας και η μεγαλύτερη πόλη της χώρας, με μακρά ιστορία.",
    "he": "ירושלים היא עיר הבירה של מדינת ישראל והעיר הגדולה ביותר בה, ויש לה היסטוריה ארוכה מאוד.",
    "hi": "दिल्ली भारत की राजधानी है और यह देश के उत्तर में यमुना नदी के किनारे बसा एक बहुत पुराना नगर है।",
    "ja": "東京は日本の首都であり、世界で最も人口の多い都市のひとつです。多くの人々がここで働いています。",
    "ko": "서울은 대한민국의 수도이며 한강을 끼고 있는 아주 오래된 도시이다. 많은 사람들이 이곳에서 살고 있다.",
    "pl": "Warszawa jest stolicą Polski i największym miastem kraju. Leży nad Wisłą, a jej ludność przekracza milion osób.",
    "tr": "İstanbul Türkiye'nin en kalabalık şehridir ve ülkenin ekonomik, tarihi ve kültürel açıdan en önemli yeridir.",
}


def test_other_scripts_are_kept(spark, lang_model):
    rows = list(FOREIGN.items())
    d = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {rows[r["doc_id"]][0]: r for r in langid.identify(d, lang_model).collect()}
    assert {k for k, r in got.items() if not r["keep"]} == set()
    assert sum(r["lang"] == langid.OTHER for k, r in got.items() if k not in ("pl", "tr")) >= 7
    assert langid.accepted(d, lang_model).count() == len(rows)


def test_language_by_brute_force(spark, lang_model):
    """The network in plain loops, over the segments of the docstring."""
    p, k = lang_model.p, len(lang_model.classes)
    h = p["U"].shape[1]
    texts = ["a short one", "Ein längerer Text über etwas, das man nicht weiß. " * 9, "é"]

    def states(x, i):
        s, out = np.zeros(h), []
        for c in x:
            a, u = p["E"][i][c], s @ p["U"][i]
            z, r = np.split(0.5 + 0.5 * (lambda v: v / (1 + abs(v)))(a[: 2 * h] + u[: 2 * h]), 2)
            m = a[2 * h :] + r * (u[2 * h :] + p["c"][i, 0])
            s = z * s + (1 - z) * (m / (1 + abs(m)))
            out.append(s)
        return out

    got = langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), lang_model).collect()
    for r, t in zip(got, texts):
        raw, total, votes = t.encode(), np.zeros(k), np.zeros(k)
        for at in range(0, len(raw), langid.SEGMENT):
            x = [raw[j] if 0 <= j < len(raw) else langid.PAD for j in range(at - langid.CONTEXT, at + langid.SEGMENT + langid.CONTEXT)]
            fwd, bwd = states(x, 0), states(x[::-1], 1)[::-1]
            for j in range(langid.CONTEXT, langid.CONTEXT + min(langid.SEGMENT, len(raw) - at)):
                y = np.exp(fwd[j] @ p["O"][0] + bwd[j] @ p["O"][1] + p["b"])
                total += y / y.sum()
                votes[y.argmax()] += 1
        best = int(total.argmax())
        assert r["lang"] == lang_model.classes[best] and abs(r["confidence"] - total[best] / len(raw)) < 1e-3 and abs(r["agreement"] - votes[best] / len(raw)) < 0.02


def test_language_rows(spark, lang_model):
    rows = [(1, None, "x"), (None, "the of and with this", "y"), (2, "", "z"), (3, "the of and " * 40_000, "w"), (4, "the of", "v"), (4, "the of", "v")]
    d = spark.createDataFrame(rows, "doc_id long, text string, keep string").coalesce(1)
    got = {(r["doc_id"], r["n_bytes"]): r for r in langid.identify(d, lang_model).collect()}
    assert got[1, 0]["lang"] == "und" and not got[1, 0]["keep"] and not got[2, 0]["keep"] and got[3, 440_000]["lang"] == "en" and got[None, 20]["keep"]
    assert langid.identify(d, lang_model).count() == 6
    kept = langid.accepted(d, lang_model)
    assert kept.columns == d.columns and kept.where("text is null or text = ''").count() == 0 and kept.where("doc_id = 3").count() == 1
    assert langid.identify(d.limit(0), lang_model).count() == 0
    assert langid.train(d.limit(0).selectExpr("text", "keep as lang")).classes == ["other", "und"] and langid.accepted(d.limit(0), lang_model).count() == 0


def test_rare_language_among_copies(spark):
    """All languages are classes, however rare; copies of one text count once."""
    rows = [("en", "the cat sat on the mat and looked at the old dog")] * 3000 + [("en", f"a text of words and numbers like {i}") for i in range(3000)]
    rows += [("el", "η γάτα κάθισε στο χαλί και κοίταξε τον γέρο σκύλο")] * 2
    d = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = langid.fit_texts(d, 50).groupBy("lang").agg(F.countDistinct("text").alias("n")).collect()
    assert {r["lang"]: r["n"] for r in got} == {"en": 50, "el": 1}
    m = langid.train(d)
    assert m.classes == ["el", "en", "other", "und"]
    r = langid.identify(spark.createDataFrame([(1, "ο γέρος σκύλος κοίταξε τη γάτα στο χαλί")], "doc_id long, text string"), m).first()
    assert r["lang"] == "el" and r["keep"]


def test_segments():
    """Every byte is labelled once, with its context."""
    rng = np.random.default_rng(1)
    off = np.concatenate([[0], np.cumsum([0, 1, 255, 256, 257, 0, 1000])])
    data = rng.integers(0, 256, off[-1]).astype(np.uint8)
    x, row, length = langid.segments(data, off)
    c = langid.CONTEXT
    for r in range(len(off) - 1):
        own = np.concatenate([x[c : c + n, i] for i, n in enumerate(length) if row[i] == r] or [np.zeros(0, int)])
        assert (own == data[off[r] : off[r + 1]]).all()


# personal data


def test_viterbi_and_marginals():
    rng = np.random.default_rng(2)
    t_n, n, k = 5, 6, 3
    e, tr, length = rng.normal(size=(t_n, n, k)), rng.normal(size=(k, k)), np.array([5, 4, 1, 3, 5, 2])
    y = pii.viterbi(e, tr, length)
    z, marginal, pair = pii.forward_backward(e, tr, length)
    total = np.zeros((k, k))
    for i in range(n):
        paths = list(itertools.product(range(k), repeat=int(length[i])))
        s = np.array([sum(e[t, i, p[t]] for t in range(len(p))) + sum(tr[a, b] for a, b in zip(p, p[1:])) for p in paths])
        assert tuple(y[: length[i], i]) == paths[int(s.argmax())] and not y[length[i] :, i].any()
        w = np.exp(s - s.max())
        assert math.isclose(z[i], s.max() + math.log(w.sum()), rel_tol=1e-9)
        w /= w.sum()
        for q, p in zip(w, paths):
            for a, b in zip(p, p[1:]):
                total[a, b] += q
        for t in range(length[i]):
            assert np.allclose(marginal[t, i], [sum(q for q, p in zip(w, paths) if p[t] == c) for c in range(k)])
    assert np.allclose(total, pair)


@pytest.fixture(scope="module")
def field():
    return pii.train()


def test_field_accuracy(field):
    table = pii.labelled_table(500, 99)
    lines = [" ".join(w).encode() for w, _ in table]
    _, got = field.decode(np.frombuffer(b"".join(lines), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in lines])]))
    gold = np.array([pii.LABELS.index(y) for _, ys in table for y in ys])
    assert (got[gold > 0] == gold[gold > 0]).mean() > 0.96 and (got[gold == 0] > 0).mean() < 0.01


def test_decode_is_the_best_path_of_whole_rows(field):
    """However a row is cut, its labels are those of Viterbi over all of it."""
    table = pii.labelled_table(300, 41)
    lines = [" ".join(w for p in table[i : i + n] for w in p[0]).encode() for i, n in ((0, 1), (1, 3), (4, 100), (104, 190), (3, 0))] + [b"4111 1111 1111 1111 " * 300, b"a@b.com " * 500]
    data, off = np.frombuffer(b"".join(lines), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in lines])])
    k, got = field.decode(data, off)
    e = field.scores(k)
    for r in range(len(lines)):
        own = np.flatnonzero(k.row == r)
        if len(own):
            y = pii.viterbi(e[own][:, None, :], field.trans, np.array([len(own)]))[:, 0]
            score = lambda p: float(e[own, p].sum() + field.trans[p[:-1], p[1:]].sum())  # noqa: E731, B023
            assert (y == got[own]).all() or abs(score(y) - score(got[own])) < 1e-2


@pytest.mark.parametrize(
    "text, want",
    [
        ("write to jane@acme.co.uk today", [("EMAIL", "jane@acme.co.uk")]), ("from <john@doe.org> with", [("EMAIL", "john@doe.org")]), ("mail (me@site.com) or", [("EMAIL", "me@site.com")]),
        ("to a@b.com,c@d.com and", [("EMAIL", "a@b.com"), ("EMAIL", "c@d.com")]), ("number 123-45-6789 of", [("SSN", "123-45-6789")]), ("the password: hunter2 then", [("SECRET", "hunter2")]),
        ("paid with 378282246310005 at", [("CARD", "378282246310005")]), ("paid 4111-1111-1111-1111 in", [("CARD", "4111-1111-1111-1111")]), ("card 4111 1111 1111 1111 in", [("CARD", "4111 1111 1111 1111")]),
        ("to DE89370400440532013000 by", [("IBAN", "DE89370400440532013000")]), ("to GB29NWBK60161331926819 by", [("IBAN", "GB29NWBK60161331926819")]), ("to DE89 3704 0044 0532 0130 00 by", [("IBAN", "DE89 3704 0044 0532 0130 00")]),
        ("at 2001:0db8:85a3:0000:0000:8a2e:0370:7334 it", [("IP", "2001:0db8:85a3:0000:0000:8a2e:0370:7334")]), ("at fe80::1ff:fe23:4567:890a it", [("IP", "fe80::1ff:fe23:4567:890a")]), ("order 4111111111111112 came", []),
        ("ISBN 978-3-16-148410-0 is", []), ("at 12:30:45 on 2024-05-11 we", []), ("the password is reset there", []), ("see example.com and main.py for", []),
    ],
)
def test_forms(field, text, want):
    import pyarrow as pa

    found, new = pii._found(field, pa.array([text]))
    assert [(k, text[a:z]) for k, a, z in found[0]] == want


def test_redact(spark, field):
    secret = "ab12" * 10
    text = f"Öt szó, then Jan.7@mail3.example.com and 10.20.30.40, call +1 (017) 555-7713. Card 4845168114407329!! token = \"{secret}\" end"
    long = "the word and " * 30_000 + "x.9@mail1.example.org " + "of it " * 20_000
    rows = [(1, text, "s"), (1, text, "s"), (2, None, "s"), (None, "", "s"), (3, "plain words only, 1999 and 3.14", "s"), (4, long, "s")]
    d = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, kinds string, n int").coalesce(1)
    got = pii.redact(d, field).collect()
    a = got[0]
    assert [text[s["start"] : s["end"]] for s in a["spans"]] == ["Jan.7@mail3.example.com", "10.20.30.40", "+1 (017) 555-7713", "4845168114407329", secret]
    assert a["text"] == f'Öt szó, then [EMAIL] and [IP], call [PHONE]. Card [CARD]!! token = "[SECRET]" end' and a["kinds"] == "CARD,EMAIL,IP,PHONE,SECRET"
    assert a == got[1] and got[2]["text"] is None and got[3]["text"] == "" and got[4]["text"] == rows[4][1] and not got[4]["spans"]
    assert got[5]["n_spans"] == 1 and got[5]["text"] == long.replace("x.9@mail1.example.org", "[EMAIL]")
    r = pii.redacted(d, field).collect()
    assert [x["text"] for x in r] == [x["text"] for x in got] and [x["n"] for x in r] == list(range(6)) and pii.redact(d.limit(0), field).count() == 0


def test_redacts_the_tables(spark, sf, field):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    left = pii.redacted(d, field)
    for pattern in (r"\S@\S+\.\w", r"(^|\s)\d{1,3}(\.\d{1,3}){3}\b", r"\b[0-9a-f]{40}\b", r"\(\d{3}\) \d{3}-\d{4}"):
        assert left.where(left["text"].rlike(pattern)).count() == 0
    import re

    cards = [m for r in left.where(left["text"].rlike(r"\b[0-9]{16}\b")).collect() for m in re.findall(r"\b[0-9]{16}\b", r["text"])]
    assert not any(pii.luhn(m.encode()) for m in cards)
    assert left.count() == d.count() and left.columns == d.columns


# blocks of pages


def test_block_lstm_gradients():
    m = html.BlockLSTM(3, 5)
    m.p = double(m.p)
    r = np.random.default_rng(0)
    live = np.ones((6, 4))
    live[4:, 1] = 0
    x = r.normal(size=(6, 4, 5)) * live[..., None]
    gold = r.integers(0, 2, (6, 4)).astype(float)
    slopes(m.p, lambda: m.gradients(x, live, gold))


@pytest.fixture(scope="module")
def labeller():
    return html.train()


def test_labeller_accuracy(spark, sf, labeller):
    held = [html.labelled(p) for p in html.generated_pages(150, 77)]
    got = np.concatenate(labeller.label([html.block_vectors(b) for b, _ in held]))
    assert (got == np.concatenate([y for _, y in held])).mean() > 0.97
    pages = [r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    own = [html.blocks(p) for p in pages]
    gold = np.concatenate([["article" in path.path() for _, path, _ in b] for b in own])
    assert (np.concatenate(labeller.label([html.block_vectors(b) for b in own])) == gold).mean() > 0.97


def shown(page):
    return [(t, p.path(), k) for t, p, k in html.blocks(page)]


def test_blocks():
    page = '<html><head><title>T</title><style>p{}</style></head><body><!-- <p>no</p> --><script>var t="</p><p>x";</script><div class="a b">one <b>two</b> &amp; <a href=x>three</a><p>four<p>five<br>six</div>tail <i'
    assert shown(page) == [("one two & three", "html/body/div.a b", 5), ("four", "html/body/div.a b/p", 0), ("five", "html/body/div.a b/p", 0), ("six", "html/body/div.a b/p", 0), ("tail <i", "html/body", 0)]
    for odd in ("", "<", "<>", "</p></p>", "<p" * 50, "plain", "<!--", "<script>never ends", "<a>" * 2000 + "x", "<div>" * 3000 + "y", "<![CDATA[z]]>", '<p class="'):
        html.blocks(odd)
    assert shown("plain") == [("plain", "", 0)] and shown("<![CDATA[z]]>") == [("z", "", 0)]
    assert [t for t, _, _ in shown('<p class="a>b">one</p><p title=\'>\'>two</p><p x="never>three</p><p>four</p>')] == ["one", "two", "three", "four"]
    assert shown("<nav>" + "<div>" * 6 + "deep")[0][1] == "nav" + "/div" * 6


def test_blocks_are_linear():
    """Pages that ask for much backtracking: 1 MB each in a few seconds at most."""
    n = 1 << 20
    for unit in ('<a x="y ', '<a ">"', "<div>", "<p>x", "</p>", "<![CDATA[", "<!", "<title>", "<script>", "<style></style", 'class="', "<a class='x' ", "<", "<!-- ", "<div><b></i></u></ul>", "<head><title>x</title>"):
        for page in (unit * (n // len(unit)), unit * (n // len(unit)) + ">", "<p>" + unit * (n // len(unit)) + "'\">text</p>"):
            began = time.process_time()
            html.blocks(page)
            assert time.process_time() - began < 12, unit


def test_labels_by_brute_force(labeller):
    """The network in plain loops, page by page, against pages of all lengths in padded batches."""
    p, h = labeller.p, labeller.p["U"].shape[1]
    pages = [html.block_vectors(html.blocks(x)) for x in html.generated_pages(12, 5)] + [np.zeros((0, html.DIM), np.float32)]

    def run(x, i):
        s, c, out = np.zeros(h), np.zeros(h), []
        for v in x:
            g = v @ p["W"][i] + s @ p["U"][i] + p["b"][i, 0]
            a, f, o = (1 / (1 + np.exp(-g[j * h : (j + 1) * h])) for j in range(3))
            c = f * c + a * np.tanh(g[3 * h :])
            s = o * np.tanh(c)
            out.append(s)
        return out

    for x, got in zip(pages, labeller.label(pages)):
        y = [float(a @ p["o"][0] + b @ p["o"][1] + p["c"][0]) for a, b in zip(run(x, 0), run(x[::-1], 1)[::-1])]
        assert len(got) == len(y) and all(g == (v > 0) for g, v in zip(got, y) if abs(v) > 1e-3)
    long = np.random.default_rng(0).normal(size=(20_000, html.DIM)).astype(np.float32)
    both = labeller.label([long, pages[0]])
    assert len(both[0]) == 20_000 and (both[1] == labeller.label([pages[0]])[0]).all()


def test_open_head_and_title(labeller):
    """A page without </head>, </title> or both has the blocks of the page that closes them."""
    whole = "<html><head><meta charset=x><title>The title</title><style>p{}</style></head><body><div><p>One two.</p><p>Three.</p></div></body></html>"
    want = [(t, p) for t, p, _ in shown(whole)]
    assert want == [("One two.", "html/body/div/p"), ("Three.", "html/body/div/p")]
    for gone in (["</head>"], ["</title>"], ["</head>", "</title>"]):
        page = whole
        for g in gone:
            page = page.replace(g, "")
        assert [(t, p) for t, p, _ in shown(page)] == want
        assert [t for t, _, _ in html.blocks(page.replace("<body>", ""))] == ["One two.", "Three."]
    assert html.blocks("<head><title>a <b>b</b></title>text")[0][0] == "text" and len(html.blocks("<head><title>a <b>b</b></title>text")) == 1


def test_extract(spark, labeller):
    page = "<html><body><nav><ul><li><a href=/a>home</a></li><li><a href=/b>about</a></li></ul></nav><article><h1>A title of it</h1>" + "<p>Many words stand here, one after another. And then some more of them.</p>" * 3 + "</article><footer>&copy; x.example.com</footer></body></html>"
    rows = [(1, "u", page), (1, "u", page), (None, None, page), (2, "u", None), (3, "u", ""), (4, "u", "<p>" + "word, " * 60_000 + "</p>" * 3)]
    d = spark.createDataFrame([(*r, 5, "t") for r in rows], "page_id long, url string, html string, n_blocks int, text string").coalesce(1)
    got = html.extract(d, labeller).collect()
    assert got[0] == got[1] and got[0]["text"].count("\n") == 3 and got[0]["text"].startswith("A title of it\nMany words") and got[0]["labels"] == "BBCCCCB"
    assert got[2]["page_id"] is None and [(r["n_blocks"], r["text"]) for r in got[3:5]] == [(0, ""), (0, "")] and got[5]["n_blocks"] == 1
    assert html.extract(d.limit(0), labeller).count() == 0


# quality


def test_rates(spark):
    """The grouped aggregation against the same formulas in plain Python."""
    rng = random.Random(5)
    rows = [(h, p, float(rng.random() < q)) for h, q in (("a", 0.9), ("b", 0.2), ("c", 0.5), (None, 0.7)) for p in ("x", "y", None) for _ in range(rng.randrange(1, 60))] + [("d", "x", 1.0)]
    got = {(r["host"], r["path"]): (r["host_rate"], r["path_rate"]) for r in quality.rates(spark.createDataFrame(rows, "host string, path string, value double")).collect()}

    def strength(groups):
        expected = sum(c * (1 - c) for _, _, c in groups)
        spread = sum(n * (r - c) ** 2 for n, r, c in groups)
        total = sum(n for n, _, _ in groups)
        within = expected / len(groups)
        between = max((spread - len(groups) * within) / max(total - sum(n * n for n, _, _ in groups) / total, 1.0), within * 1e-4)
        return min(max(within / between - 1, 1.0), 10_000.0)

    def sums(key):
        out = {}
        for r in rows:
            n, k = out.get(key(r), (0, 0.0))
            out[key(r)] = (n + 1, k + r[2])
        return out

    g = (sum(r[2] for r in rows) + 0.5) / (len(rows) + 1)
    hosts, paths = sums(lambda r: r[0]), sums(lambda r: r[:2])
    s = strength([(n, k / n, g) for n, k in hosts.values()])
    host = {h: (k + s * g) / (n + s) for h, (n, k) in hosts.items()}
    s = strength([(n, k / n, host[h]) for (h, _), (n, k) in paths.items()])
    assert set(got) == set(paths)
    for (h, p), (n, k) in paths.items():
        assert math.isclose(got[h, p][0], host[h], rel_tol=1e-9) and math.isclose(got[h, p][1], (k + s * host[h]) / (n + s), rel_tol=1e-9)


def test_posterior_by_brute_force(spark, sf):
    """The query's rows from the classifier's own evidence, with all sums in plain Python."""
    d, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    m = quality.train(d, lab)
    got = {r["doc_id"]: r for r in quality.score(d, lab, m).collect()}
    rows = d.collect()
    good = {}
    for r in lab.collect():
        good[r["doc_id"]] = min(good.get(r["doc_id"], 1), int(r["quality"] == 1 and not r["toxic"]))
    ev, one = {}, lambda e: 1 / (1 + math.exp(-e))
    for r in rows:
        raw = (r["text"] or "").encode()
        ev[r["doc_id"]] = max(-30.0, min(30.0, float(m.evidence(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]))) if raw else 0.0
    v = spark.createDataFrame([(r["source"], r["lang"], float(good.get(r["doc_id"], one(ev[r["doc_id"]])))) for r in rows], "host string, path string, value double")
    rate = {(r["host"], r["path"]): r["path_rate"] for r in quality.rates(v).collect()}  # itself held against plain Python above
    base = np.mean([one(e) for e in ev.values()])
    logit = lambda p: math.log(p / (1 - p))
    for r in rows:
        g = got[r["doc_id"]]
        assert abs(g["evidence"] - ev[r["doc_id"]]) < 1e-5
        assert abs(g["posterior"] - one(ev[r["doc_id"]] - logit(base) + logit(rate[r["source"], r["lang"]]))) < 1e-5
        assert g["keep"] == (g["posterior"] >= quality.THRESHOLD) or abs(g["posterior"] - quality.THRESHOLD) < 1e-5


def test_evidence_by_brute_force():
    """Hashed words and figures of each text, by regular expressions."""
    import re

    texts = ["Some words, SOME more words 12.", "", "é", "beginning begins " * 3]
    raw = [t.encode() for t in texts]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    row, bucket, dense = quality.vectors(data, off)
    for i, x in enumerate(raw):
        w = re.findall(rb"[0-9a-z\x80-\xff]+", x.lower())
        want = set(w) | {(y[:k], k) for y in w for k in quality.PREFIXES if len(y) > k}
        assert np.count_nonzero(row == i) == len(want)
        n = max(1, len(x))
        assert np.allclose(dense[i][[0, 1]], [sum(65 <= c <= 90 for c in x) / n, sum(48 <= c <= 57 for c in x) / n]) and math.isclose(dense[i][5], math.log1p(len(w)) / 10)


def test_quality_accuracy(spark):
    """Fitted on one half of the labels, held against the other."""
    at = larger("sf0.1")
    d, lab = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    half = lab.where("doc_id % 2 = 0")
    got = quality.score(d, half, quality.train(d, half)).join(lab.where("doc_id % 2 = 1"), "doc_id").collect()
    good = np.array([r["quality"] == 1 and r["toxic"] == 0 for r in got])
    keep = np.array([r["keep"] for r in got])
    assert keep[good].mean() > 0.97 and keep[~good].mean() < 0.15


def test_quality_rows(spark):
    rows = [(1, "fine words of a kind", "h", "p"), (1, "fine words of a kind", "h", "p"), (2, None, "h", "q"), (None, "", None, None), (3, "x" * 300_000, "g", "p"), (4, "YES!! NO!!", "g", None)]
    d = spark.createDataFrame([(*r, 1.0, True) for r in rows], "doc_id long, text string, source string, lang string, evidence double, keep boolean")
    lab = spark.createDataFrame([(1, 1, 0), (1, 1, None), (2, 0, 1), (4, None, 1), (None, 1, 1), (9, 1, 0)], "doc_id long, quality int, toxic int")
    m = quality.train(d, lab)
    got = quality.score(d, lab, m).collect()
    assert len(got) == 6 and all(0 < r["posterior"] < 1 for r in got) and {r["evidence"] for r in got if r["doc_id"] in (2, None)} == {0.0}
    assert len({(r["evidence"], r["posterior"]) for r in got if r["doc_id"] == 1}) == 1
    assert quality.score(d.limit(0), lab, m).count() == 0
    none = quality.train(d, lab.limit(0))
    assert quality.score(d, lab.limit(0), none).count() == 6
    from pyspark.sql import functions as F

    r = spark.createDataFrame([("https://www.A.example.com/en/5?x",), ("nonsense",)], "u string").select(*quality.site(F.col("u"))).collect()
    assert tuple(r[0]) == ("a.example.com", "en") and tuple(r[1]) == ("", "")


# language model


@pytest.fixture(scope="module")
def small_lm(spark, sf):
    return lm.train(lm.encoded(spark.read.parquet(f"{sf}/documents.parquet")))


def test_attention_gradients():
    counts = np.arange(300)[::-1].copy()
    v = lm.Vocabulary(counts)
    p = double(lm.weights(v))
    ids = np.random.default_rng(0).integers(0, 300, 200).astype(np.int32)
    m = lm.Model(v, p, "")
    x, y, _ = lm.windows(ids, np.array([0, 3, 3, 90, 200]))
    batch = m.batch(ids, x, y)
    slopes(p, lambda: lm.gradients(p, *batch))


def test_vocabulary():
    v = lm.Vocabulary(np.random.default_rng(1).integers(0, 50, 5000))
    by = np.bincount(v.cls, np.exp(v.log_share), lm.CLASSES)
    assert np.allclose(by[np.bincount(v.cls, minlength=lm.CLASSES) > 0], 1, atol=1e-4)


def test_classes_by_company():
    """Subwords of one language stand beside each other, so classes by neighbours keep languages apart."""
    r = np.random.default_rng(4)
    size, k = 3000, 2 * (lm.NEIGHBOURS + 1)
    counts = r.integers(1, 50, size)
    near = np.zeros((size, k))
    for i in range(size):
        near[i, (i % 2) * 30 + r.integers(0, 30, 40)] += 1
    v = lm.Vocabulary(counts, near)
    rest = np.flatnonzero(v.cls >= lm.ALONE)
    mixed = [len({i % 2 for i in rest[v.cls[rest] == c]}) for c in set(v.cls[rest])]
    assert max(mixed) == 1 and len(set(v.cls)) > lm.ALONE + 2


def test_neighbours():
    import pyarrow as pa

    kind = np.minimum(np.arange(100), lm.NEIGHBOURS)
    ids, k = [np.array([1, 2, 1, 99], np.int32), np.array([], np.int32), np.array([2], np.int32), np.array([5, 1], np.int32)], lm.NEIGHBOURS + 1
    out = next(iter(lm._neighbours(kind)(iter([pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in ids], pa.binary())], ["ids"])]))))
    got = {(i, p): n for i, p, n in zip(*(c.to_pylist() for c in out.columns))}
    want = {}
    for x in ids:
        for a, b in zip(x.tolist(), x.tolist()[1:]):
            for key in ((b, int(kind[a])), (a, k + int(kind[b]))):
                want[key] = want.get(key, 0) + 1
    assert got == want


def test_subwords_one_by_one():
    """Words in one call are as words alone, also with other white space, marks, apostrophes and bytes that are no UTF-8."""
    sub = lm.Subwords(most=50)
    texts = ["don't stop, it's 12,5% of a\u00a0b \u3000 c…", "", "naïve — “quoted” 東京 x\u2028y \u00a0", " a\tb\n\nc  ", "word " * 300 + "'s 's s' 1st"] * 2
    for extra in ([], [b"\xff\xfe bad \xc3( bytes"]):
        raw = [t.encode() for t in texts] + extra
        ids, off = sub.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
        for i, x in enumerate(raw):
            want = [y for w in x.translate(bytes.maketrans(b"\t\n\r\x0b\x0c", b"     ")).split(b" ") if w for y in sub.encoding.encode_ordinary(" " + w.decode("utf-8", "replace"))]
            assert ids[off[i] : off[i + 1]].tolist() == want


def test_subwords_without_looking_ahead():
    """The faster splitting gives what the tokenizer's own does, and is not asked where white space other than single spaces is left."""
    sub = lm.subwords(lm.TOKENIZER)
    text = " don't it's 'tis 12,5% naïve — “quoted” 東京 ไทย हिन्दी a\u200bb c\u00add …'s 's ½ \x1f\x1c !?"
    assert not lm._WIDE_SPACE.search(text) and sub.spaced.encode_ordinary(text) == sub.encoding.encode_ordinary(text)
    for c in filter(str.isspace, map(chr, range(0x110000))):
        assert lm._WIDE_SPACE.search(c) or c in "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f"  # the last four are no white space to the tokenizer


def test_windows_by_place():
    """Every place of every window, by its definition; what a batch gives for it is looked up once for all windows."""
    off, ids = np.array([0, 0, 1, 24, 48, 73, 73, 200]), np.random.default_rng(3).integers(0, 300, 200).astype(np.int32)
    x, y, row = lm.windows(ids, off)
    stride, k = lm.WINDOW - lm.CONTEXT, 0
    for r in range(len(off) - 1):
        for base in range(off[r], off[r + 1], stride):
            read, scored = range(base - 1 - lm.CONTEXT, base + stride - 1), range(base, base + stride)
            assert row[k] == r and x[k].tolist() == [j if off[r] <= j < off[r + 1] else -2 if j == off[r] - 1 else -1 for j in read]
            assert y[k].tolist() == [j if j < off[r + 1] else -1 for j in scored]
            k += 1
    v = lm.Vocabulary(np.arange(300)[::-1].copy())
    m = lm.Model(v, lm.weights(v), "")
    assert k == len(x) and all((a == b).all() for a, b in zip(m.batch(ids, x, y), m.batch(ids, x, y, m.known(ids))))
    inp, hidden, cls, live = m.batch(ids, x, y)
    assert (inp == np.where(x >= 0, v.input[ids[x]], lm._BOS)).all() and (hidden == (x == -1)).all() and (cls[live] == v.cls[ids[y[live]]]).all()


def test_scores_stay_finite():
    """Weights of attention that all vanish, or are huge, leave a score."""
    v = lm.Vocabulary(np.arange(300)[::-1].copy())
    ids = np.arange(100, dtype=np.int32)
    for sign in (-1, 1):
        p = lm.weights(v)
        p["T"][:], p["P"][:], p["Q"], p["K"] = 3, 0, np.eye(lm.DIM, dtype=np.float32) * sign * 9, np.eye(lm.DIM, dtype=np.float32)
        assert np.isfinite(lm.Model(v, p, "").log_probs(ids, np.array([0, 100]))).all()


def test_scores_by_brute_force(small_lm):
    """Every subword, scored alone with full matrices and its own causal mask."""
    m = small_lm
    sub = lm.subwords(lm.TOKENIZER)
    texts = ["", "one", "The of and this in with a from " * 12, "Word"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    ids, off = sub.encode(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    got = m.log_probs(ids, off)
    p = double(m.p)
    for r in range(len(texts)):
        own = ids[off[r] : off[r + 1]]
        assert own.tolist() == (sub.encoding.encode_ordinary(" " + " ".join(texts[r].split())) if texts[r] else [])
        for i, target in enumerate(own):
            block = i // (lm.WINDOW - lm.CONTEXT) * (lm.WINDOW - lm.CONTEXT)
            places = range(max(-1, block - 1 - lm.CONTEXT), i)
            inp = [lm._BOS if j < 0 else int(m.v.input[own[j]]) for j in places]
            where = [j - (block - 1 - lm.CONTEXT) for j in places]
            e = p["T"][inp] + p["P"][where]
            s = (e @ p["K"]) @ (e[-1] @ p["Q"]) * lm.DIM**-0.5
            a = np.exp(s - s.max())
            h = e[-1] + (a / a.sum()) @ (e @ p["V"])
            z = h @ p["O"] + p["b"]
            want = z[m.v.cls[target]] - z.max() - math.log(np.exp(z - z.max()).sum()) + m.v.log_share[target]
            assert abs(want - got[off[r] + i]) < 1e-3


def test_lm_learns_and_rows(spark, sf, small_lm):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    untrained = lm.Model(small_lm.v, lm.weights(small_lm.v), lm.TOKENIZER)
    e = lm.encoded(d)
    nll = lambda m: (lambda r: -r[0] / r[1])(lm.score(e, m).selectExpr("sum(log_prob)", "sum(n_tokens)").first())
    assert nll(small_lm) < nll(untrained) - 0.2
    rows = [(1, None), (2, ""), (3, " \n "), (None, "some text"), (4, "some text"), (4, "some text"), (5, "the of " * 50_000), (6, "x" * 100_000)]
    got = lm.score(lm.encoded(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_tokens int").coalesce(1)), small_lm).collect()
    assert all(r["n_tokens"] == 0 and r["log_prob"] == 0 and r["perplexity"] is None for r in got[:3]) and got[4][1:] == got[5][1:] == got[3][1:] and got[6]["n_tokens"] >= 100_000 and got[7]["n_tokens"] > 0
    none = lm.encoded(d.limit(0))
    assert lm.score(none, small_lm).count() == 0 and lm.train(none).v is not None


def test_lm_trains_on_all_documents(spark, sf):
    """With the settings of the query: all windows are trained on, and a document alone is learned from."""
    d = spark.read.parquet(f"{sf}/documents.parquet").where("text != ''")
    m = lm.train(lm.encoded(d.repartition(70)))  # averaged in two steps
    texts = [r["text"].encode() for r in d.collect()]
    ids, off = lm.subwords(lm.TOKENIZER).encode(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    assert m.windows == len(lm.windows(ids, off)[0])
    for i in range(3):
        alone = lm.train(lm.encoded(spark.createDataFrame([(i, f"the only document {i} " * 40)], "doc_id long, text string")))
        assert alone.windows > 0 and np.abs(alone.p["O"] - lm.weights(alone.v)["O"]).max() > 0.01


# GIF


def frames_of(data):
    return gif.read(data)["frames"]


def test_lzw_round_trip():
    r = np.random.default_rng(0)
    for root in range(2, 9):
        for n in (0, 1, 2, 5, 4097, 30_000):
            for p in (r.integers(0, 1 << root, n), np.zeros(n, int), np.arange(n) // 7 % (1 << root)):
                p = p.astype(np.uint8)
                assert (gif.lzw_decode(gif.lzw_encode(p.tobytes(), root), root, n) == p).all()
    # by hand, 3 bits each: clear 4, 1, then 6, which is only being made, 1 1; end 5
    assert gif.lzw_decode(bytes([0b10001100, 0b1011]), 2, 3).tolist() == [1, 1, 1]


PALETTE = np.array([[0, 0, 0], [255, 0, 0], [0, 255, 0], [0, 0, 255]], np.uint8)


def test_disposal_and_transparency():
    full = np.full((4, 4), 1)
    spot = np.full((2, 2), 2)
    shown = {}
    for disposal in (0, 1, 2, 3):
        f = frames_of(gif.encode(4, 4, PALETTE, [{"pixels": full, "delay_ms": 50}, {"pixels": spot, "left": 1, "top": 1, "disposal": disposal}, {"pixels": np.array([[3, 0]]), "transparent": 0}]))
        assert (f[0]["canvas"][..., :3] == PALETTE[1]).all() and (f[1]["canvas"][1:3, 1:3, :3] == PALETTE[2]).all()
        shown[disposal] = f[2]["canvas"]
        assert tuple(f[2]["canvas"][0, 0]) == (0, 0, 255, 255) and tuple(f[2]["canvas"][0, 1]) == (255, 0, 0, 255)
    assert tuple(shown[1][1, 1]) == tuple(shown[0][1, 1]) == (0, 255, 0, 255) and tuple(shown[2][1, 1]) == (0, 0, 0, 0) and tuple(shown[3][1, 1]) == (255, 0, 0, 255)


def test_interlace_palettes_and_edges():
    r = np.random.default_rng(3)
    for h in (1, 2, 3, 7, 16):
        p = r.integers(0, 4, (h, 5))
        a, b = (frames_of(gif.encode(5, h, PALETTE, [{"pixels": p, "interlaced": x}]))[0]["canvas"] for x in (False, True))
        assert (a == b).all() and (a[..., :3] == PALETTE[p]).all()
    own = PALETTE[::-1]
    assert (frames_of(gif.encode(5, 1, PALETTE, [{"pixels": p[:1], "palette": own}]))[0]["canvas"][..., :3] == own[p[:1]]).all()
    out = frames_of(gif.encode(3, 3, PALETTE, [{"pixels": np.full((4, 4), 1), "left": 2, "top": 2}, {"pixels": np.full((2, 2), 1), "left": 9, "top": 9}]))
    assert out[0]["canvas"][2, 2, 0] == 255 and out[0]["canvas"][..., 3].sum() == 255
    big = r.integers(0, 256, (300, 300))
    pal = r.integers(0, 256, (256, 3)).astype(np.uint8)
    assert (frames_of(gif.encode(300, 300, pal, [{"pixels": big}]))[0]["canvas"][..., :3] == pal[big]).all()


def test_histogram():
    c = np.zeros((2, 2, 4), np.uint8)
    c[0, 0] = [255, 0, 64, 255]
    c[0, 1] = [255, 0, 127, 255]
    h = gif.histogram(c)
    assert h.sum() == 4 and h[-1] == 2 and h[(3 * 4 + 0) * 4 + 1] == 2


def test_decode_rows(spark):
    good = gif.vector_gif(5, np.arange(64.0))
    rows = [(1, good), (1, good), (None, good), (2, None), (3, b""), (4, b"PNG...not"), (5, good[: len(good) // 2]), (6, good[:20]), (7, good[:13] + b"\x00" * 60), (8, b"GIF89a\0\0\0\0\0\0\0,\0\0\0\0\0\0\0\0\0\x02\0;")]
    d = spark.createDataFrame([(i, x if x is None else bytearray(x), 1, "e", 2) for i, x in rows], "media_id long, data binary, width int, error string, ID int").coalesce(1)
    got = gif.decode(d).collect()
    by = {k: [r for r in got if r["media_id"] == k] for k in (1, None, *range(2, 9))}
    assert len(by[1]) == 6 and by[1][:3] == by[1][3:] and [r[1:] for r in by[None]] == [r[1:] for r in by[1][:3]]
    a = by[1]
    assert [r["frame"] for r in a[:3]] == [0, 1, 2] and all(r["n_frames"] == 3 and r["error"] is None and r["valid"] for r in a)
    assert a[0]["duration_ms"] == sum(r["delay_ms"] for r in a[:3]) and a[1]["start_ms"] == a[0]["delay_ms"]
    assert all(sum(r["histogram"]) == r["canvas_width"] * r["canvas_height"] and len(r["pixels"]) == 4 * r["canvas_width"] * r["canvas_height"] for r in a)
    assert [(by[i][0]["error"], by[i][0]["valid"], by[i][0]["frame"]) for i in (2, 3, 4)] == [("no data", False, None)] * 2 + [("no GIF header", False, None)]
    assert by[5][0]["error"] and by[5][0]["valid"] and by[5][0]["n_frames"] < 3 and by[8][0]["complete"] and by[8][0]["pixels"] == b""
    assert gif.decode(d.limit(0)).count() == 0


def test_bands(spark, monkeypatch):
    """A canvas in bands of rows is the canvas as one, with all that disposal and interlacing do."""
    r = np.random.default_rng(6)
    frames = [{"pixels": r.integers(0, 4, (r.integers(1, 30), r.integers(1, 25))), "left": int(r.integers(0, 9)), "top": int(r.integers(0, 12)), "disposal": int(i % 4), "interlaced": i % 2 == 0, "transparent": i % 5} for i in range(12)]
    data = gif.encode(20, 31, PALETTE, frames)
    whole = np.stack([f["canvas"] for f in frames_of(data)])
    monkeypatch.setattr(gif, "BAND_PIXELS", 100)
    rows = list(gif._file_rows(1, data, True, 4))
    assert len(rows) == 12 * 7
    for i in range(12):
        own = [np.frombuffer(x["pixels"], np.uint8).reshape(-1, 20, 4) for x in rows if x["frame"] == i]
        assert (np.concatenate(own) == whole[i]).all()
    # the largest canvas that there is, of which 4 pixels are drawn: 65535 bands would be 17 GB, so one band is looked at
    g = gif.parse(gif.encode(65535, 65535, PALETTE, [{"pixels": np.full((2, 2), 1), "left": 65533, "top": 65533}]))
    canvas, complete = next(gif.render(g, 65500, 35))
    assert complete and canvas.shape == (35, 65535, 4) and np.count_nonzero(canvas[..., 3]) == 4


def test_streams_of_other_encoders():
    """Files that weren't made by encode(): from a published walk-through, the usual one-pixel file, and two encoders of another kind."""
    made = bytes.fromhex("4749463839610a000a00910000ffffffff00000000ff00000021f90400000000002c000000000a000a000002168c2d99872a1cdc33a00275ec95faa8de608c04914c01003b")
    index = np.array([[1] * 5 + [2] * 5] * 3 + [[1] * 3 + [0] * 4 + [2] * 3] * 2 + [[2] * 3 + [0] * 4 + [1] * 3] * 2 + [[2] * 5 + [1] * 5] * 3)
    colours = np.array([[255, 255, 255], [255, 0, 0], [0, 0, 255], [0, 0, 0]])
    assert (frames_of(made)[0]["canvas"][..., :3] == colours[index]).all() and frames_of(made)[0]["complete"]
    import base64

    dot = frames_of(base64.b64decode("R0lGODlhAQABAIAAAAAAAP///yH5BAEAAAAALAAAAAABAAEAAAIBRAA7"))
    assert len(dot) == 1 and dot[0]["canvas"].tolist() == [[[0, 0, 0, 0]]] and dot[0]["complete"]

    def stream(codes):
        """(code, width) pairs as bytes, the lowest bits first."""
        total = have = 0
        for code, width in codes:
            total |= code << have
            have += width
        return total.to_bytes(-(-have // 8), "little")

    r = np.random.default_rng(7)
    for root in (2, 4, 8):
        p = r.integers(0, 1 << root, 9000)
        # no compression: the table is cleared before codes would widen
        codes = []
        for i, x in enumerate(p.tolist()):
            if i % ((1 << root) - 2) == 0:
                codes.append((1 << root, root + 1))
            codes.append((x, root + 1))
        assert (gif.lzw_decode(stream([*codes, ((1 << root) + 1, root + 1)]), root, len(p)) == p).all()
        # the table is never cleared, also when it is full
        table, width, size, codes, word = {(i,): i for i in range(1 << root)}, root + 1, (1 << root) + 2, [(1 << root, root + 1)], ()
        for x in p.tolist():
            if (*word, x) in table:
                word = (*word, x)
                continue
            codes.append((table[word], width))
            if size < 4096:
                table[*word, x] = size
                if size == 1 << width and width < 12:
                    width += 1
                size += 1
            word = (x,)
        codes.append((table[word], width))
        assert (gif.lzw_decode(stream(codes), root, len(p)) == p).all()


def test_every_vector_round_trips(spark, sf):
    """Against a second reading of what was drawn: the first frame's pixels are the vector's shades."""
    v = spark.read.parquet(f"{sf}/embeddings.parquet").limit(40)
    from pericope.llm import queries

    assert gif.decode(gif.from_vectors(v), id_col="vec_id").where("valid and error is null and n_frames = 3 and complete").count() == 120
    for r in v.collect():
        x = np.array(r["embedding"])
        side = max(4, math.ceil(math.sqrt(len(x))))
        flat = np.zeros(side * side)
        flat[: len(x)] = x
        shade = np.minimum(15, ((flat - flat.min()) / (flat.max() - flat.min() + 1e-9) * 16).astype(int)).reshape(side, side)
        k = r["vec_id"]
        ramp = np.arange(16)
        pal = np.stack([ramp * 17, (ramp * (3 + k % 5) * 17) % 256, 255 - ramp * 16], axis=1)
        assert (frames_of(gif.vector_gif(k, x))[0]["canvas"][..., :3] == pal[shade]).all()
    assert "op10_gif_media" in queries.queries()

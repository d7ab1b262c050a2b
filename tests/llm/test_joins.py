"""Decontamination, Jaccard join, packing and URL rules: against DuckDB on the tables and against brute force on awkward rows."""

import itertools
import math
import random
import re

import pytest

from pericope.llm import decontaminate, jaccard, packing, queries, urlrules
from tests.oracle import connect, duck_rows, spark_rows

WORDS = re.compile("[0-9a-z\x80-\U0010ffff]+")


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf, con, name):
    assert spark_rows(queries.queries()[name](spark, sf)) == duck_rows(con, queries.oracle_sql()[name])


def toks(t):
    return WORDS.findall((t or "").lower())


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", None, 7, "clash") for i, t in rows], "doc_id long, text string, item_id string, gram string, pos int, `a.b` string")


def text(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


AWKWARD = [(None, "some text that has no id at all"), (1, None), (2, ""), (3, "   \n\t"), (4, "!!! ---"), (5, "one"), (6, "one"), (7, "two words"), (8, "Two  WORDS!")]


# decontamination


def held(doc, item, n, threshold):
    d, w = toks(doc), toks(item)
    if not w:
        return None
    k = min(n, len(w))
    grams = lambda x: [tuple(x[i : i + k]) for i in range(len(x) - k + 1)]
    s, dg = set(grams(w)), grams(d)
    width = len(w) - k + 1
    best = max((len(s & set(dg[i : i + width])) for i in range(max(1, len(dg)))), default=0)
    return (best, len(s)) if best >= math.ceil(threshold * len(s) - 1e-9) else None


def test_contained(spark):
    rng = random.Random(1)
    items = [(i, text(rng, rng.randrange(6, 30))) for i in range(12)] + [(20, "three short words"), (21, None), (22, "..."), (None, text(rng, 12)), (23, "ha ha ha ha ha ha ha ha"), (0, "another text under item zero once more with words")]
    rows = list(AWKWARD)
    for i in range(100, 160):
        parts = [text(rng, rng.randrange(0, 40))]
        for _ in range(rng.randrange(0, 3)):
            w = (rng.choice([t for _, t in items if t and t != "..."])).split()
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = "changed"
            parts += [" ".join(w[rng.randrange(0, 2) :]), text(rng, rng.randrange(0, 20))]
        rows.append((i, " ".join(parts)))
    rows += [(200, items[0][1]), (200, items[0][1]), (201, items[1][1]), (201, "ha " * 50), (202, "x" * 200_000 + " " + items[2][1]), (203, "three short words")]
    items_df = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, doc_id string")
    for threshold in (0.8, 0.5, 1.0):
        want = {}
        for (d, t), (i, x) in itertools.product(rows, items):
            if d is not None and i is not None and (h := held(t, x, 5, threshold)):
                want[d, i] = max(want.get((d, i), (0, 1)), h, key=lambda p: (p[0] / p[1], p[0]))
        got = {(r["doc_id"], r["item_id"]): (r["matched"], r["shingles"]) for r in decontaminate.contained(docs_of(spark, rows), items_df, threshold=threshold).collect()}
        assert got == want and (200, 0) in got and (203, 20) in got
    left = decontaminate.remove(docs_of(spark, rows), items_df)
    bad = {d for d, _ in {(d, i) for (d, t), (i, x) in itertools.product(rows, items) if d is not None and i is not None and held(t, x, 5, 0.8)}}
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in left.collect()) == sorted((d is None, d or 0) for d, _ in rows if d not in bad) and left.columns == docs_of(spark, rows).columns


def test_contained_empty(spark):
    some = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    docs = docs_of(spark, [(1, "a b c d e f g")])
    assert decontaminate.contained(docs.limit(0), some).count() == 0
    assert decontaminate.contained(docs, some.limit(0)).count() == 0
    assert decontaminate.contained(docs, some).count() == 1


# Jaccard


def gram_set(t, n):
    w = toks(t)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_links(rows, n, t):
    """{doc: (class, links)} by comparing all texts with all."""
    sets = sorted({(d, gram_set(x, n)) for d, x in rows if d is not None and x is not None and gram_set(x, n)}, key=lambda p: p[0])
    links, root = [0] * len(sets), list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(sets)), 2):
        (_, a), (_, b) = sets[i], sets[j]
        if len(a & b) >= math.ceil(t / (1 + t) * (len(a) + len(b)) - 1e-9):
            links[i] += 1
            links[j] += 1
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    out = {d: (d, 0) for d, _ in rows if d is not None}
    seen = set()
    for i, (d, _) in enumerate(sets):
        c = sets[find(i)][0]
        out[d] = (min(out[d][0], c) if d in seen else c, out[d][1] + links[i])
        seen.add(d)
    return out


@pytest.mark.parametrize("n, threshold", [(3, 0.7), (2, 0.5), (1, 0.9), (3, 0.5)])
def test_linked(spark, n, threshold, monkeypatch):
    monkeypatch.setattr(jaccard, "_BLOCK", 5)  # balls of several blocks
    rng = random.Random(n)
    rows = list(AWKWARD)
    for g in range(14):
        base = text(rng, rng.randrange(3, 60)).split()
        for k in range(rng.randrange(1, 8)):
            w = list(base)
            for _ in range(rng.randrange(0, 6)):
                w[rng.randrange(len(w))] = f"c{rng.randrange(9)}"
            rows.append((1000 + 10 * g + k, " ".join(w)))
    passage = text(rng, 50)
    rows += [(2000 + i, f"{text(rng, 8)} {passage} {text(rng, 40)}") for i in range(20)]
    rows += [(3000, "Same TEXT here, again"), (3001, "same text here again"), (3001, "same text here again"), (3002, text(rng, 30)), (3002, rows[20][1]), (3003, "long " * 30_000), (3004, "long " * 30_001)]
    base = text(rng, 80).split()  # a large group, from close to far copies
    for k in range(60):
        w = list(base)
        for _ in range(rng.randrange(0, 20)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(999)}"
        rows += [(4000 + 2 * k, " ".join(w))] + [(4001 + 2 * k, " ".join(w))] * (k % 5 == 0)
    got = {r["doc_id"]: (r["class_id"], r["links"]) for r in jaccard.linked(docs_of(spark, rows), n, threshold).collect()}
    want = brute_links(rows, n, threshold)
    assert {d: x for d, x in got.items() if want[d] != x} == {} and set(got) == set(want)
    assert got[3000] == (3000, 1) == (got[3001][0], got[3001][1])


def test_balls_hold_a_large_group(spark):
    """Most of a group of edited copies is in one ball, so its pairs are not listed."""
    rng = random.Random(9)
    base = text(rng, 200, 5000).split()
    rows = [(0, " ".join(base)), (1, " ".join(base))]
    for k in range(2, 200):
        w = list(base)
        for _ in range(3):
            w[rng.randrange(len(w))] = f"e{rng.randrange(9999)}"
        rows.append((k, " ".join(w)))
    sets = jaccard._sets(spark.createDataFrame(rows, "id long, text string"), 3, 0.5)
    b, _ = jaccard._balls(sets, 0.5)
    assert b.count() == 199 and b.groupBy("ball").count().agg({"count": "max"}).first()[0] > 190
    assert jaccard._pairs(b, 0.5).count() < 50


def test_groups(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(40, 60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(45)] + [(5, 5), (7, 6)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(pairs, "doc_a long, doc_b long")
    assert {(r["doc_id"], r["keeper"]) for r in jaccard.groups(df).collect()} == {(x, find(x)) for x in parent}
    assert jaccard.groups(df.limit(0)).count() == 0


def test_keep_one(spark):
    a, b = "alpha beta gamma delta epsilon zeta", "one two three four five six"
    rows = [(9, a), (3, a), (5, a + " eta"), (7, b), (None, a), (None, a), (4, None), (6, None)]
    d = docs_of(spark, rows)
    kept = jaccard.keep_one(d)
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 0, 3, 4, 6, 7] and kept.columns == d.columns
    assert jaccard.linked(d.limit(0)).count() == 0 and jaccard.keep_one(d.limit(0)).count() == 0


# packing


def test_pack(spark):
    rng = random.Random(2)
    rows = [(i, "é" * rng.choice([1, 3, 8, 30, 49, 50, 51, 64])) for i in range(300)] + [(None, "abc"), (7, "abc"), (7, "abc"), (8, None), (9, ""), (10, "z" * 1001)]
    d = spark.createDataFrame([(i, t, 1, "s", 2) for i, t in rows], "doc_id long, text string, shard int, class string, bin int")
    for shard_rows in (50_000, 40):
        got = packing.pack(d, capacity=100, classes=8, shard_rows=shard_rows).collect()
        n = sum(len(t.encode()) for _, t in rows if t)
        assert sum(r["length"] for r in got) == n
        bins = {}
        for r in got:
            bins.setdefault((r["shard"], r["class"], r["bin"]), []).append(r)
            assert r["class"] == min(8, 100 // r["length"])
        assert all(sum(r["length"] for r in b) <= 100 and sorted(r["slot"] for r in b) == list(range(len(b))) for b in bins.values())
        short = [k for k, b in bins.items() if len(b) < k[1]]
        assert len(short) == len({k[:2] for k in short})
        big = sorted((r["piece"], r["start"], r["length"]) for r in got if r["doc_id"] == 10 and r["length"] != 16)
        assert big[0] == (0, 0, 100) and big[-1] == (10, 1000, 1)
    assert packing.pack(d.limit(0)).count() == 0


# URL rules


def test_rules(spark):
    hosts = ["cheap-pills.example.com", "www.spam-farm.example.org", "a.b.net", "xcheap-pills.example.com", "casino.example.com", "casinos.net", "m.a.org", "10.0.0.1:80"]
    tails = ["/", "/en/5.html", "/x?ref=x", "/x?ref=xy", "?page=3#top", "/wp-admin/a", "/login", "/file.exe", "/tag/q/page/4", "/en/7/", "?utm_source=feed", "#top"]
    urls = [f"{s}://{h}{t}" for s in ("http", "https") for h in hosts for t in tails] + [None, "", "HTTPS://WWW.SPAM-FARM.example.org/en/1.html", "https://x.example.org/en/12.html?" + "q" * 100_000]
    rows = [(i, u, 1, "block") for i, u in enumerate(urls)] + [(0, urls[0], 1, ""), (None, urls[1], 2, ""), (3, None, 1, "")]
    df = spark.createDataFrame(rows, "page_id long, url string, rule_id int, action string")
    rules = urlrules.RULES + [(90, "block", None, ["x"]), (91, "tag", "b\\.net", None), (92, "tag", "^$", []), (93, "tag", "casinos?\\.", ["casino|casinos"])]
    got = {(r["page_id"], r["rule_id"], r["action"]) for r in urlrules.match_rules(df, spark.createDataFrame(rules, urlrules.SCHEMA)).collect()}
    urlrules.MOST_RULES, most = 0, urlrules.MOST_RULES
    assert got == {(r["page_id"], r["rule_id"], r["action"]) for r in urlrules.match_rules(df, spark.createDataFrame(rules, urlrules.SCHEMA)).collect()}
    urlrules.MOST_RULES = most
    want = {(i, k, a) for i, u, *_ in rows for k, a, p, _ in rules if p and re.search(p, (u or "").lower())}
    assert got == want
    v = {r["page_id"]: r for r in urlrules.verdicts(df, urlrules.rules_table(spark)).collect()}
    for i in {r[0] for r in rows}:
        m = {(k, a) for j, k, a in want if j == i and k < 90}
        assert v[i]["n_rules"] == len(m) and v[i]["blocked"] == (any(a == "block" for _, a in m) and not any(a == "allow" for _, a in m))
    assert urlrules.verdicts(df.limit(0), urlrules.rules_table(spark)).count() == 0
    assert urlrules.verdicts(df, urlrules.rules_table(spark).limit(0)).where("n_rules > 0").count() == 0


@pytest.mark.parametrize("rule", [r for r in urlrules.RULES if r[3]], ids=lambda r: str(r[0]))
def test_literals_are_in_every_match(rule):
    """A wrong literal would hide matches: URLs made from the pattern itself have all of them as whole tokens."""
    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    @settings(max_examples=150, deadline=None, derandomize=True, database=None, suppress_health_check=list(HealthCheck))
    @given(st.from_regex(re.compile(rule[2], re.ASCII), fullmatch=False, alphabet=st.characters(min_codepoint=33, max_codepoint=126, exclude_categories=["Lu"])))
    def check(u):
        if not re.search(rule[2], u):
            return
        tokens = re.findall("[a-z0-9]+", u)
        for literal in rule[3]:
            assert any(x in tokens or x == urlrules.NUMBER and any(y.isdigit() for y in tokens) for x in literal.split("|")), (u, literal)

    check()


def test_without(spark):
    """Broadcast or shuffled, with nulls, repeated ids and a clashing column."""
    from pericope.llm.shared import without

    d = spark.createDataFrame([(None, 1), (1, 1), (1, 2), (2, 3), (3, None)], "doc_id long, __out int")
    ids = spark.createDataFrame([(1,), (1,), (None,), (9,)], "x long")
    for most in (0, 10):
        assert sorted((r[0] or 0, r[1] or 0) for r in without(d, ids, "doc_id", most).collect()) == [(0, 1), (2, 3), (3, 0)]
    assert without(d, ids.limit(0), "doc_id").count() == 5

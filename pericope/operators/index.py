"""Tokens, postings and vocabulary, and what a search over them costs."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pericope.functions.text import computed, tokens, with_normalised
from pericope.plans.criteria import Analysed

KEY = ["abbreviation", "book_nr", "chapter", "verse"]


def with_tokens(verses: DataFrame, case_sensitive: bool = False, diacritics: str = "sensitive", exact: bool = True, keep: Callable[[Column], Column] | None = None, spaced: bool = True) -> DataFrame:
    """verses with norm, the normalised text, and tokens. keep: a test of norm that comes before tokens are made. spaced=False leaves white space in norm as it is, which tokens don't depend on."""
    return computed(with_normalised(verses, "text", "norm", case_sensitive, diacritics, exact, keep, spaced), tokens=tokens(F.col("norm")))


def postings(tokenised: DataFrame, key: list[str] | None = None, words: Sequence[str] | None = None) -> DataFrame:
    """(abbreviation, token, key..., tf). words: of these tokens only.

    Verses are shuffled by their key, each as one text of its sorted tokens. A
    token without an equal neighbour, in a verse that has its key to itself,
    occurs once; so only the others are counted, and without another shuffle.
    """
    key = key or KEY[1:]
    verse, out = ["abbreviation", *key], ["abbreviation", "token", *key, "tf"]
    if words is not None:
        return _counted(tokenised.select(*verse, F.explode("tokens").alias("token")).where(F.col("token").isin(list(words))), verse).select(*out)
    packed = tokenised.where(F.size("tokens") > 0).select(*verse, F.array_join(F.sort_array("tokens"), " ").alias("packed_"))
    packed = packed.withColumn("copies_", F.count(F.lit(1)).over(W.partitionBy(*verse)))
    each = packed.select(*verse, "copies_", F.split("packed_", " ").alias("s_")).select("*", F.posexplode("s_").alias("i_", "token"))
    alone = (F.col("copies_") == 1) & ~F.expr("token <=> get(s_, i_ - 1)") & ~F.expr("token <=> get(s_, i_ + 1)")
    once = each.where(alone).withColumn("tf", F.lit(1).cast("long"))
    more = _counted(each.where(~alone), verse)
    return once.select(*out).unionByName(more.select(*out))


def _counted(each: DataFrame, verse: list[str]) -> DataFrame:
    return each.groupBy("token", *verse).agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(tokenised: DataFrame) -> DataFrame:
    """(abbreviation, token, df, cf): verses with the token, and occurrences.

    A verse's tokens are sorted in place, where the first of equal ones counts
    for the verse; so one shuffle, with counts combined before it, is enough.
    """
    t = tokenised.select("abbreviation", F.array_sort("tokens").alias("s"))
    each = t.select("abbreviation", F.explode(F.expr("transform(s, (x, i) -> struct(x as token, int(i = 0 or get(s, i - 1) != x) as first))")).alias("t"))
    return each.groupBy("abbreviation", F.col("t.token").alias("token")).agg(F.sum("t.first").alias("df"), F.count(F.lit(1)).alias("cf"))


def build_units(verses: DataFrame) -> DataFrame:
    """(abbreviation, n, chars, units): what building the index of each translation is reckoned at."""
    return verses.groupBy("abbreviation").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).cast("long").alias("chars")).withColumn("units", F.col("n") + 2 * F.col("chars"))


def part_units(q: Analysed) -> Column:
    """What looking for parts of words in a vocabulary (token, cf) is reckoned at, to be summed over its rows."""
    each = [F.least(F.length("token"), F.lit(len(t))) + 1 + F.when(F.col("token").contains(t), F.col("cf")).otherwise(0) for t in (*q.terms, *q.excluded)]
    return sum(each[1:], each[0])


def word_units(q: Analysed) -> Column:
    """The same for whole words: their occurrences, once for each time a word is named; of phrases, again to test the order."""
    named = [*q.terms, *q.excluded, *(q.terms if q.spec.words == "phrase" else ())]
    return F.col("cf") * sum([F.when(F.col("token") == t, n).otherwise(0) for t, n in Counter(named).items()], F.lit(0))


def match_units(vocabulary_: DataFrame, q: Analysed) -> DataFrame:
    """(abbreviation, units): what the terms of a search cost in each translation's vocabulary."""
    units = part_units(q) if q.spec.match == "substring" else word_units(q)
    d = vocabulary_ if q.spec.match == "substring" else vocabulary_.where(F.col("token").isin([*q.terms, *q.excluded]))
    return d.groupBy("abbreviation").agg(F.sum(units).cast("long").alias("units"))


def search_units(n: int, build: int, vocabulary_: DataFrame, norm_chars: int, q: Analysed, strict_subset: bool) -> tuple[int, int]:
    """The two reservations of a search over one translation: before the index is there, and with its vocabulary (abbreviation, token, cf)."""
    spec = q.spec
    first = build + n + 8 * spec.limit
    units = match_units(vocabulary_, q).first()
    m = (units["units"] if units else 0) + (norm_chars if spec.words == "phrase" and spec.match == "substring" else 0)
    second = build + (n if strict_subset else 0) + m + 8 * spec.limit
    if spec.proximity is not None:
        second += n * max(1, len(q.terms))
    if spec.sort == "relevance":
        second += n * max(1, n.bit_length())
    return first, int(second)

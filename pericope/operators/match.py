"""A search compiled to DataFrame expressions over tokenised verses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pericope.functions.text import WORD_CLASS, computed, holds
from pericope.operators.index import with_tokens
from pericope.plans.criteria import SCOPES, Analysed


def _hit(spec_match: str, term: str):
    return (lambda x: x == F.lit(term)) if spec_match == "whole_word" else (lambda x: F.contains(x, F.lit(term)))


def term_count(match: str, term: str, tokens: Column | str = "tokens") -> Column:
    """How many of a verse's tokens are the term, or contain it. A token that holds it twice counts once."""
    return F.size(F.filter(tokens, _hit(match, term))).cast("long")


def in_scope(scope: str, book: str = "book_nr") -> Column:
    lo, hi = SCOPES[scope]
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (F.col(book) >= lo)
    if hi is not None:
        cond = cond & (F.col(book) <= hi)
    return cond


def phrase_pattern(terms: tuple[str, ...]) -> str:
    body = f"[^{WORD_CLASS}]+".join("\\Q" + t + "\\E" for t in terms)
    return f"(?<![{WORD_CLASS}]){body}(?![{WORD_CLASS}])"


def near(terms: tuple[str, ...], gap: int, tokens: Column | str = "tokens") -> Column:
    """Whether some stretch of tokens with all terms, as whole tokens, has at most `gap` more tokens than there are terms."""
    t, span = F.col(tokens) if isinstance(tokens, str) else tokens, len(terms) + gap
    wanted = F.array(*[F.lit(x) for x in terms])
    here = lambda i: F.forall(wanted, lambda x: F.array_contains(F.slice(t, i, F.lit(span)), x))
    # a stretch can always be made to begin with a term
    begins = F.filter(F.sequence(F.lit(1), F.size(t)), lambda i: F.array_contains(wanted, F.get(t, i - 1)))
    return F.when(F.size(t) > 0, F.exists(begins, here)).otherwise(F.lit(False))


def hits(tokenised: DataFrame, q: Analysed, books: list[int] | None = None) -> DataFrame:
    """The verses that match, with score, occurrences and terms; no order.

    tokenised has norm and tokens in the query's mode, computed or stored, so that
    naming them costs nothing. Scope and books come first, where the scan can use
    them; cheap token tests precede regular expressions. books: None for all.
    """
    s = q.spec
    d = tokenised.where(in_scope(s.scope))
    if books is not None:
        d = d.where(F.col("book_nr").isin([int(b) for b in books]) if books else F.lit(False))
    one = len(q.terms) == 1 and s.match == "whole_word" and not s.exclude and s.proximity is None and s.sort == "canonical"
    if s.words == "phrase" and not one:
        if s.match == "substring":
            quote = F.lit(q.normalised)
            count = ((F.length("norm") - F.length(F.replace(F.col("norm"), quote, F.lit("")))) / len(q.normalised)).cast("long")
            d = d.where(F.contains("norm", quote))
        else:
            d = d.where(F.forall(F.array(*[F.lit(x) for x in dict.fromkeys(q.terms)]), lambda x: F.array_contains("tokens", x)))
            count = F.regexp_count("norm", F.lit(phrase_pattern(q.terms))).cast("long")
        d = computed(d, occurrences=count).where("occurrences > 0").withColumns({"score": F.col("occurrences") * len(q.terms), "terms": F.array(*[F.lit(t) for t in q.terms])})
    else:
        each = F.array(*[F.struct(F.lit(x).alias("t"), term_count(s.match, x).alias("n")) for x in q.terms])
        d = computed(d, found=F.filter(each, lambda x: x["n"] > 0)).where(F.size("found") >= (1 if s.words == "any" else len(q.terms)))
        occ = F.aggregate("found", F.lit(0).cast("long"), lambda a, x: a + x["n"])
        d = d.withColumns({"occurrences": occ, "score": occ, "terms": F.transform("found", lambda x: x["t"])}).drop("found")
    if q.excluded:
        bad = F.array(*[F.lit(x) for x in dict.fromkeys(q.excluded)])
        t = F.col("tokens")
        d = d.where(~(F.arrays_overlap(t, bad) if s.match == "whole_word" else F.exists(bad, lambda e: F.exists(t, lambda x: F.contains(x, e)))))
    if s.proximity is not None:
        d = d.where(near(q.terms, s.proximity))
    return d


def search(verses: DataFrame, q: Analysed, books: list[int] | None = None, exact: bool = True) -> DataFrame:
    """hits() from verses without tokens. Every text is normalised once, what can't match is left out, and the rest is cut into tokens once."""
    s = q.spec
    d = verses.where(in_scope(s.scope))
    if books is not None:
        d = d.where(F.col("book_nr").isin([int(b) for b in books]) if books else F.lit(False))
    parts = [q.normalised] if s.words == "phrase" and s.match == "substring" else list(dict.fromkeys(q.terms))
    return hits(with_tokens(d, s.case_sensitive, s.diacritics, exact, lambda norm: holds(norm, parts, s.words != "any")), q)


def order(sort: str) -> list[Column]:
    """Canonical order, which is by book, chapter and verse, or by falling score first."""
    canonical = [F.col("book_nr"), F.col("chapter"), F.col("verse")]
    return [F.col("score").desc(), *canonical] if sort == "relevance" else canonical


def page(matched: DataFrame, sort: str, offset: int, limit: int) -> DataFrame:
    """One page, as a top-k of offset + limit rows and no full sort."""
    return matched.orderBy(*order(sort)).offset(offset).limit(limit)


def totals(matched: DataFrame, offset: int, limit: int) -> DataFrame:
    """(total, returned, has_more), by one aggregate and no window."""
    t = matched.agg(F.count(F.lit(1)).alias("total"))
    returned = F.greatest(F.lit(0), F.least(F.lit(limit).cast("long"), F.col("total") - offset))
    return t.select("total", returned.alias("returned"), (F.lit(offset) + returned < F.col("total")).alias("has_more"))


def counted_by_vocabulary(q: Analysed) -> bool:
    """Whether a search's total over a whole translation is in its vocabulary."""
    return len(q.terms) == 1 and q.spec.match == "whole_word" and not q.excluded and q.spec.proximity is None


def vocabulary_total(vocabulary: DataFrame, q: Analysed) -> int:
    """In how many verses the one word is, without looking at any."""
    row = vocabulary.where(F.col("token") == q.terms[0]).select("df").first()
    return int(row["df"]) if row else 0


def by_postings(postings: DataFrame, q: Analysed, key: list[str]) -> DataFrame:
    """(abbreviation, key..., score) for all/any whole-word queries from a stored index: an equality filter on token, which prunes a table laid out by token, and one aggregate."""
    by = postings.where(F.col("token").isin(list(q.terms))).groupBy("abbreviation", *key).agg(F.count(F.lit(1)).alias("k"), F.sum("tf").alias("score"))
    return (by.where(F.col("k") == len(q.terms)) if q.spec.words == "all" else by).drop("k")


def substring_terms(vocabulary: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, token, ...): which vocabulary entries contain which term; the vocabulary is scanned, not the texts."""
    return vocabulary.join(terms, F.contains(vocabulary["token"], terms["term"]))

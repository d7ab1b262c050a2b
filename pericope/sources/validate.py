"""Constraints of a corpus, as queries for the rows that break them.

Types and open metadata are checked on the raw text, because a JSON reader with
a schema would coerce them; all that counts or compares rows is DataFrame work.
"""

from __future__ import annotations

import json
import math
import re
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from pericope.functions.text import computed
from pericope.operators.verses import CHAPTER_FILE, METADATA

MAX_BOOKS, MAX_CHAPTERS, MAX_VERSES, MAX_TOTAL = 256, 500, 500, 100_000
MAX_NAME, MAX_TEXT, MAX_DEPTH, MAX_ITEMS, MAX_KEY = 4096, 1 << 20, 8, 10_000, 128
CODE = re.compile(r"[a-z0-9][a-z0-9_-]{0,29}")
SHA = re.compile(r"[0-9a-f]{40}")


class ChapterLimits(NamedTuple):
    """How large the number of a chapter file, the numbers and the texts of its verses and their count may be."""

    chapter: float = 1000
    verse: float = 2000
    verses: float = MAX_VERSES
    text: float = MAX_TEXT


#: Of chapters that aren't a published corpus's and may be of any size.
NO_LIMITS = ChapterLimits(math.inf, math.inf, math.inf, math.inf)


def code_of(abbreviation: Any) -> str:
    """A translation's code, or an error."""
    if not isinstance(abbreviation, str):
        raise TypeError("A translation's code has to be text.")
    if not CODE.fullmatch(abbreviation.casefold()):
        raise ValueError(f"{abbreviation!r} is no translation's code.")
    return abbreviation.casefold()


def valid_code(name: Column) -> Column:
    """code_of() as a test of a column."""
    return F.lower(name).rlike(f"^(?:{CODE.pattern})$")


def valid_sha(x: str) -> bool:
    return bool(SHA.fullmatch(x.lower()))


def _number(x: Any, most: float) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and 1 <= x <= most


def _text(x: Any, most: float, blank: bool = False) -> bool:
    return isinstance(x, str) and len(x) <= most and (blank or bool(x.strip()))


def open_value_fault(x: Any, depth: int = 0) -> str | None:
    """What is wrong with a value of open metadata, which may nest."""
    if depth > MAX_DEPTH:
        return "too deep"
    if x is None or isinstance(x, bool):
        return None
    if isinstance(x, (int, float)):
        return None if math.isfinite(x) and abs(x) <= 2**63 - 1 else "number out of range"
    if isinstance(x, str):
        return None if len(x) <= MAX_TEXT else "text too long"
    if len(x) > MAX_ITEMS:
        return "too many items"
    for k, v in x.items() if isinstance(x, dict) else enumerate(x):
        if isinstance(k, str) and not 1 <= len(k) <= MAX_KEY:
            return "key too long or empty"
        if fault := open_value_fault(v, depth + 1):
            return fault
    return None


def _open_fields(x: dict, known: tuple[str, ...]) -> str | None:
    return open_value_fault({k: v for k, v in x.items() if k not in known}, 0)


def structure_faults(raw: str | None, expected: str | None = None) -> list[tuple[str, str]]:
    """(rule, where) for what is wrong with a translation's raw text: V1, V2, V4, V7, V10, V16 to V18. An empty list: nothing."""
    try:
        doc = json.loads(raw or "", parse_constant=lambda x: math.inf)
    except ValueError:
        return [("V1", "not JSON")]
    if not isinstance(doc, dict) or not isinstance(doc.get("books"), list):
        return [("V2", "no object with a list of books")]
    out: list[tuple[str, str]] = []
    if not _text(doc.get("abbreviation"), 30) or not _text(doc.get("translation"), MAX_NAME):
        out.append(("V16", "translation and abbreviation"))
    elif expected is not None and doc["abbreviation"].casefold() != expected:
        out.append(("V2", f"abbreviation {doc['abbreviation']}"))
    top = {k: v for k, v in doc.items() if k != "books"}
    if fault := open_value_fault(top):
        out.append(("V16", fault))
    for k in METADATA:
        if k in doc and not _text(doc[k], MAX_NAME, True):
            out.append(("V16", k))
    for b in doc["books"]:
        if not isinstance(b, dict) or not _number(b.get("nr"), 1000) or not _text(b.get("name"), MAX_NAME) or not isinstance(b.get("chapters"), list):
            out.append(("V4", f"book {b.get('nr') if isinstance(b, dict) else b}"))
            continue
        if fault := _open_fields(b, ("nr", "name", "chapters")):
            out.append(("V17", f"book {b['nr']}: {fault}"))
        for c in b["chapters"]:
            if not isinstance(c, dict) or not _number(c.get("chapter"), 1000) or not _text(c.get("name"), MAX_NAME) or not isinstance(c.get("verses"), list):
                out.append(("V7", f"book {b['nr']}"))
                continue
            if fault := _open_fields(c, ("chapter", "name", "verses")):
                out.append(("V17", f"chapter {b['nr']}:{c['chapter']}: {fault}"))
            for v in c["verses"]:
                if not isinstance(v, dict) or not _number(v.get("verse"), 2000) or not _number(v.get("chapter"), 1000) or not _text(v.get("name"), MAX_NAME) or not _text(v.get("text"), MAX_TEXT, True):
                    out.append(("V10", f"chapter {b['nr']}:{c['chapter']}"))
                elif fault := _open_fields(v, ("verse", "chapter", "name", "text")):
                    out.append(("V18", f"verse {b['nr']}:{c['chapter']}:{v['verse']}: {fault}"))
    return out


def count_faults(doc: dict) -> list[tuple[str, str]]:
    """(rule, where) for what is wrong with the numbers of a translation without structure_faults(): V3, V5, V6, V8, V9 and V11 to V13."""
    out: list[tuple[str, str]] = []
    books, total = [b["nr"] for b in doc["books"]], 0
    if not 1 <= len(books) <= MAX_BOOKS:
        out.append(("V3", f"{len(books)} books"))
    if len(set(books)) < len(books):
        out.append(("V5", "a book's number twice"))
    for b in doc["books"]:
        chapters = [c["chapter"] for c in b["chapters"]]
        if not 1 <= len(chapters) <= MAX_CHAPTERS:
            out.append(("V6", f"book {b['nr']}"))
        if len(set(chapters)) < len(chapters):
            out.append(("V8", f"book {b['nr']}"))
        for c in b["chapters"]:
            verses, where = [v["verse"] for v in c["verses"]], f"chapter {b['nr']}:{c['chapter']}"
            total += len(verses)
            if not 1 <= len(verses) <= MAX_VERSES:
                out.append(("V9", where))
            if any(v["chapter"] != c["chapter"] for v in c["verses"]):
                out.append(("V11", where))
            if len(set(verses)) < len(verses):
                out.append(("V12", where))
    if total > MAX_TOTAL:
        out.append(("V13", f"{total} verses"))
    return out


def document_faults(raw: str | None, expected: str | None = None) -> list[tuple[str, str]]:
    """All of structure_faults(), and of count_faults() where there are none."""
    return structure_faults(raw, expected) or count_faults(json.loads(raw or ""))


def chapter_fault(raw: str | None, abbreviation: str, book: int, chapter: int, limits: ChapterLimits = ChapterLimits()) -> str | None:
    """V19: what is wrong with the raw text of a chapter file, None if nothing."""
    try:
        doc = json.loads(raw or "", parse_constant=lambda x: math.inf)
    except ValueError:
        return "not JSON"
    if not isinstance(doc, dict):
        return "not JSON"
    if doc.get("abbreviation") != abbreviation:
        return "abbreviation"
    for name, value, most in (("book_nr", book, 1000), ("chapter", chapter, limits.chapter)):
        if not _number(doc.get(name), most) or doc[name] != value:
            return name
    for name in ("book_name", "name"):
        if not _text(doc.get(name), MAX_NAME):
            return name
    if fault := _open_fields(doc, ("verses",)):
        return fault
    for name in METADATA:
        if name in doc and not _text(doc[name], MAX_NAME, True):
            return name
    verses = doc.get("verses")
    if not isinstance(verses, list) or not 1 <= len(verses) <= limits.verses:
        return "verses"
    seen = set()
    for v in verses:
        if not isinstance(v, dict) or not _number(v.get("verse"), limits.verse) or not _number(v.get("chapter"), limits.chapter) or not _text(v.get("name"), MAX_NAME) or not _text(v.get("text"), limits.text, True):
            return "verse"
        if v["chapter"] != chapter:
            return "verse of another chapter"
        if fault := _open_fields(v, ("verse", "chapter", "name", "text")):
            return fault
        if v["verse"] in seen:
            return "repeated verse"
        seen.add(v["verse"])
    return None


def _chapter(limits: ChapterLimits):
    @pandas_udf(T.StringType())
    def fault(raw: pd.Series, abbreviation: pd.Series, book: pd.Series, chapter: pd.Series) -> pd.Series:
        return pd.Series([chapter_fault(*x, limits) for x in zip(raw, abbreviation, book.tolist(), chapter.tolist())], dtype=object)

    return fault


def chapter_violations(chapters: DataFrame, limits: ChapterLimits = ChapterLimits()) -> DataFrame:
    """(abbreviation, book_nr, chapter, rule, fault): V19, of chapter files (abbreviation, book_nr, chapter, raw) that are kept under these numbers."""
    return computed(chapters.withColumn("fault_", _chapter(limits)("raw", "abbreviation", "book_nr", "chapter")), fault=F.col("fault_")).where("fault is not null").select("abbreviation", "book_nr", "chapter", F.lit("V19").alias("rule"), "fault")


def sound_chapters(chapters: DataFrame, limits: ChapterLimits = ChapterLimits()) -> DataFrame:
    """Chapter files without a fault as nested rows."""
    d = computed(chapters.withColumn("fault_", _chapter(limits)("raw", "abbreviation", "book_nr", "chapter")), fault=F.col("fault_")).where("fault is null")
    return d.select(F.from_json("raw", CHAPTER_FILE).alias("c")).select("c.*")


_FAULTS = T.ArrayType(T.StructType([T.StructField("rule", T.StringType()), T.StructField("place", T.StringType())]))


@pandas_udf(_FAULTS)
def _structure(raw: pd.Series) -> pd.Series:
    return raw.map(lambda x: [{"rule": r, "place": p} for r, p in structure_faults(x)])


@pandas_udf(_FAULTS)
def all_faults(raw: pd.Series) -> pd.Series:
    """document_faults() of a column of raw texts."""
    return raw.map(lambda x: [{"rule": r, "place": p} for r, p in document_faults(x)])


def raw_violations(translations: DataFrame) -> DataFrame:
    """(abbreviation, rule, place) from the raw texts of sources.repository.translations()."""
    return translations.select("abbreviation", F.explode(_structure("raw")).alias("f")).select("abbreviation", "f.rule", "f.place")


def counting_violations(verses: DataFrame, max_books: int = MAX_BOOKS, max_chapters: int = MAX_CHAPTERS, max_verses: int = MAX_VERSES, max_total: int = MAX_TOTAL) -> DataFrame:
    """(abbreviation, rule, book_nr, chapter, verse, n) from verses with one row each: V3, V6, V9, V12 and V13.

    One aggregate by verse; those above it are over its result.
    """
    by_verse = verses.groupBy("abbreviation", "book_nr", "chapter", "verse").agg(F.count(F.lit(1)).alias("n"))
    by_chapter = by_verse.groupBy("abbreviation", "book_nr", "chapter").agg(F.sum("n").alias("n"))
    by_book = by_chapter.groupBy("abbreviation", "book_nr").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("verses"))
    by_all = by_book.groupBy("abbreviation").agg(F.count(F.lit(1)).alias("n"), F.sum("verses").alias("verses"))
    none = F.lit(None).cast("int")

    def rows(d: DataFrame, rule: str, where: str, book=none, chapter=none, verse=none, n="n") -> DataFrame:
        return d.where(where).select("abbreviation", F.lit(rule).alias("rule"), book.alias("book_nr"), chapter.alias("chapter"), verse.alias("verse"), F.col(n).cast("long").alias("n"))

    b, c, v = F.col("book_nr"), F.col("chapter"), F.col("verse")
    out = rows(by_verse, "V12", "n > 1", b, c, v)
    for more in (rows(by_chapter, "V9", f"n > {max_verses}", b, c), rows(by_book, "V6", f"n > {max_chapters}", b), rows(by_all, "V3", f"n > {max_books}"), rows(by_all, "V13", f"verses > {max_total}", n="verses")):
        out = out.unionByName(more)
    return out


def nested_violations(translations: DataFrame) -> DataFrame:
    """(abbreviation, rule, book_nr, chapter) from nested rows: V3 and V5 to V11, where a count can be of nothing or numbers repeat."""
    b = translations.select("abbreviation", F.explode("books").alias("b"))
    none = F.lit(None).cast("int")
    nr, chapters = F.col("b.nr"), F.col("b.chapters")
    c = b.select("abbreviation", nr.alias("nr"), F.explode("b.chapters").alias("c"))
    number, verses = F.col("c.chapter"), F.col("c.verses")
    name = F.coalesce(F.trim("b.name"), F.lit(""))
    found = [
        translations.where("books is null or size(books) not between 1 and 256").select("abbreviation", F.lit("V3").alias("rule"), none.alias("book_nr"), none.alias("chapter")),
        b.where(nr.isNull() | ~nr.between(1, 1000) | (name == "")).select("abbreviation", F.lit("V4").alias("rule"), nr.alias("book_nr"), none.alias("chapter")),
        b.groupBy("abbreviation", nr.alias("book_nr")).count().where("count > 1").select("abbreviation", F.lit("V5").alias("rule"), "book_nr", none.alias("chapter")),
        b.where(chapters.isNull() | ~F.size(chapters).between(1, MAX_CHAPTERS)).select("abbreviation", F.lit("V6").alias("rule"), nr.alias("book_nr"), none.alias("chapter")),
        c.where(number.isNull() | ~number.between(1, 1000)).select("abbreviation", F.lit("V7").alias("rule"), F.col("nr").alias("book_nr"), number.alias("chapter")),
        b.where(F.size(F.array_distinct(F.transform(chapters, lambda x: x["chapter"]))) < F.size(chapters)).select("abbreviation", F.lit("V8").alias("rule"), nr.alias("book_nr"), none.alias("chapter")),
        c.where(verses.isNull() | ~F.size(verses).between(1, MAX_VERSES)).select("abbreviation", F.lit("V9").alias("rule"), F.col("nr").alias("book_nr"), number.alias("chapter")),
        c.where(F.exists(verses, lambda v: v["verse"].isNull() | ~v["verse"].between(1, 2000))).select("abbreviation", F.lit("V10").alias("rule"), F.col("nr").alias("book_nr"), number.alias("chapter")),
        c.where(F.exists(verses, lambda v: ~v["chapter"].eqNullSafe(number))).select("abbreviation", F.lit("V11").alias("rule"), F.col("nr").alias("book_nr"), number.alias("chapter")),
        c.where(F.size(F.array_distinct(F.transform(verses, lambda v: v["verse"]))) < F.size(verses)).select("abbreviation", F.lit("V12").alias("rule"), F.col("nr").alias("book_nr"), number.alias("chapter")),
    ]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def index_faults(index: DataFrame, abbreviation: str | None = None) -> DataFrame:
    """(key, rule): V15, of sources.repository.books_indexes()."""
    bad = ~F.col("key").rlike("^[0-9]+$") | ~F.expr("try_cast(key as int)").eqNullSafe(F.col("nr")) | ~F.coalesce(F.col("nr").between(1, 1000), F.lit(False))
    if abbreviation is not None:
        bad = bad | ~F.lower("abbreviation").eqNullSafe(F.lit(abbreviation))
    return index.where(bad).select("key", F.lit("V15").alias("rule"))


def book_differences(corpus: DataFrame, index: DataFrame, columns: list[str]) -> DataFrame:
    """(side, columns...): V14, rows of either that the other doesn't have; nulls are equal."""
    a, b = corpus.select(*columns).distinct(), index.select(*columns).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("corpus")).unionByName(b.exceptAll(a).withColumn("side", F.lit("index")))

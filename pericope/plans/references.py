"""Human references: grammar, bounded verse lists, and aliases of books."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections import OrderedDict
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pericope.errors import ReferenceValidationError, RequestLimitError
from pericope.functions.text import alias_form, normalise_alias
from pericope.plans.names import english

_MARKS = frozenset(" ,:-.'’")
DEFAULT_CODE = "kjv"


@dataclass(frozen=True)
class BookReference:
    book: int
    chapter: int
    verses: list[int] = field(default_factory=list)
    reference: str = ""


class AliasBook:
    """Names of books by catalogue code; a code's names first, then the default's, then all others' in the order of their codes."""

    def __init__(self, rows: Iterable[tuple[str, str, int]] = ()):
        """rows: (code, name, book number); of equal names in one catalogue the last counts."""
        self.names: dict[str, dict[str, int]] = {}
        for code, name, book in rows:
            self.names.setdefault(code, {})[normalise_alias(name)] = int(book)
        self.names = dict(sorted(self.names.items(), key=lambda x: f"{x[0]}.json"))

    @classmethod
    def from_table(cls, aliases: DataFrame) -> AliasBook:
        """From sources.repository.alias_catalogue(); small, as the number of books and languages bounds it."""
        return cls((r["code"], r["alias"], r["book_nr"]) for r in aliases.orderBy("code", "position").collect())

    @classmethod
    def default(cls) -> AliasBook:
        """English names under the default code."""
        return cls(english(DEFAULT_CODE))

    def number(self, name: str, code: str | None = None, fallback: Iterable[str] | None = None) -> int | None:
        if name.isdigit():
            try:
                return int(name) if 1 <= int(name) <= 83 else None
            except ValueError:  # superscript digits
                return None
        own = code if code in self.names else DEFAULT_CODE
        key = normalise_alias(name)
        for c in dict.fromkeys([own, DEFAULT_CODE, *(self.names if fallback is None else fallback)]):
            if (found := self.names.get(c, {}).get(key)) is not None:
                return found
        return None

    def dump(self, code: str, path: str | os.PathLike | None = None) -> dict[str, dict[str, str]]:
        """A catalogue as it is looked up; as a JSON file too, if there is a path for it."""
        if code not in self.names:
            raise ValueError(f"No catalogue {code!r}.")
        out = {k: {"book_number": str(v)} for k, v in self.names[code].items()}
        if path is not None:
            Path(path).write_text(json.dumps(out, ensure_ascii=False, indent=1), "utf-8")
        return out


def resolve_aliases(names: DataFrame, aliases: DataFrame, default: str = DEFAULT_CODE) -> DataFrame:
    """names (code, name) with book_nr, from aliases (code, alias, position, book_nr), by AliasBook's order; null if none has it.

    The same lookup as a join: one row per name and catalogue that has it, of
    which the first in order is taken by an aggregate.
    """
    a = aliases.withColumn("key", alias_form("alias"))
    a = a.groupBy("code", "key").agg(F.max_by("book_nr", "position").alias("book_nr"))
    known = a.select("code").distinct()
    n = names.select("code", "name").distinct().withColumn("key", alias_form("name"))
    n = n.join(known.withColumnRenamed("code", "known"), F.col("code") == F.col("known"), "left").withColumn("own", F.coalesce("known", F.lit(default))).drop("known")
    a = a.select(F.col("code").alias("from"), "key", "book_nr")
    rank = F.when(F.col("from") == F.col("own"), F.lit("0")).when(F.col("from") == default, F.lit("1")).otherwise(F.concat(F.lit("2"), F.col("from"), F.lit(".json")))
    found = n.join(a, "key", "left").groupBy("code", "name").agg(F.min_by("book_nr", rank).alias("book_nr"))
    digits = F.col("name").rlike("^[0-9]+$")
    number = F.expr("try_cast(name as int)")
    return found.select("code", "name", F.when(digits, F.when(number.between(1, 83), number)).otherwise(F.col("book_nr")).alias("book_nr"))


def expand_verses(text: str, most: int = 200, highest: int = 1000) -> list[int] | None:
    """Verse numbers of a list of numbers and ranges, each once, in order. None: not such a list. A range with one end is that verse."""
    if not text:
        return [1]
    got: dict[int, None] = {}
    for part in text.split(","):
        m = re.fullmatch(r"(\d*)(-?)(\d*)", part.strip())
        ends = [x for x in (m.group(1), m.group(3)) if x] if m else []
        if not ends:
            return None
        first, last = int(ends[0]), int(ends[-1])
        if not 1 <= first <= last:
            return None
        if last > highest:
            raise RequestLimitError(f"There are no verses beyond {highest}.")
        # the size is known before anything is made of it
        if last - first + 1 > most or (last > first and len(got) + last - first + 1 > most) or (last == first and first not in got and len(got) >= most):
            raise RequestLimitError(f"One reference can't take more than {most} verses.")
        got.update(dict.fromkeys(range(first, last + 1)))
    return list(got)


class ReferenceParser:
    """References such as "1 John 3:16,19-21" to books, chapters and verses; remembers what it has parsed."""

    def __init__(self, aliases: AliasBook, cache_limit: int | None = 5000, max_length: int = 100, max_verses: int = 200, max_verse: int = 1000):
        self.aliases, self.cache_limit = aliases, cache_limit
        self.max_length, self.max_verses, self.max_verse = max_length, max_verses, max_verse
        self._seen: OrderedDict[tuple[str, str], tuple | None] = OrderedDict()
        self.hits = self.misses = self.evictions = 0

    def book_number(self, name: str, code: str | None = None) -> int | None:
        return self.aliases.number(name, code)

    def _parse(self, text: str, code: str | None) -> tuple | None:
        if not text or len(text) > self.max_length or text.count(":") > 1:
            return None
        if any(unicodedata.category(c)[0] not in "LMN" and c not in _MARKS for c in text):
            return None
        head, colon, tail = text.partition(":")
        verses = tail if colon else "1"
        number = re.search(r"\d*$", head).group()
        name = head if number == head else head[: len(head) - len(number)]
        book = self.aliases.number(name.strip(), code)
        if book is None or (number and int(number) < 1):
            return None
        listed = expand_verses(verses, self.max_verses, self.max_verse)
        return None if listed is None else (book, int(number) if number else 1, tuple(listed))

    def ref(self, reference: str, code: str | None = None) -> BookReference:
        """Raises ReferenceValidationError, or RequestLimitError for too many verses. Never returns a list that a caller could change."""
        if not isinstance(reference, str):
            raise ReferenceValidationError("A reference has to be text.")
        key = ((code or DEFAULT_CODE).casefold(), reference.casefold())
        if key in self._seen:
            self.hits += 1
            self._seen.move_to_end(key)
            got = self._seen[key]
        else:
            self.misses += 1
            got = self._parse(unicodedata.normalize("NFC", reference.strip()), code)
            if self.cache_limit != 0:
                self._seen[key] = got
                while self.cache_limit is not None and len(self._seen) > self.cache_limit:
                    self._seen.popitem(last=False)
                    self.evictions += 1
        if got is None:
            raise ReferenceValidationError(f"Invalid reference {reference!r}.")
        return BookReference(got[0], got[1], list(got[2]), reference)

    def valid(self, reference: str, code: str | None = None) -> bool:
        try:
            self.ref(reference, code)
        except ReferenceValidationError:
            return False
        return True

    def cache_info(self) -> dict[str, int | None]:
        return {
            "size": len(self._seen), "limit": self.cache_limit, "hits": self.hits, "misses": self.misses, "evictions": self.evictions,
            "max_reference_length": self.max_length, "max_verses": self.max_verses, "max_verse_number": self.max_verse,
        }


def reference_rows(spark: SparkSession, refs: list[BookReference]) -> DataFrame:
    """(ref_ix, pos, reference, book_nr, chapter, verse); bounded by the request limits."""
    rows = [(i, j, r.reference, r.book, r.chapter, v) for i, r in enumerate(refs) for j, v in enumerate(r.verses)]
    return spark.createDataFrame(rows, "ref_ix int, pos int, reference string, book_nr int, chapter int, verse int")


def select_verses(verses: DataFrame, refs: DataFrame) -> DataFrame:
    """Each requested verse once, at its first request, with text null where there is none: (rank, ref_ix, reference, book_nr, chapter, verse, name, text).

    The verses are cut down by a semi-filter to the requested chapters before
    the join; the requested side is small by its limits.
    """
    first = W.partitionBy("book_nr", "chapter", "verse").orderBy("ref_ix", "pos")
    want = refs.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    v = verses.select("book_nr", "chapter", "verse", F.col("reference").alias("name"), "text")
    return want.join(v, ["book_nr", "chapter", "verse"], "left").select("ref_ix", "pos", "reference", "book_nr", "chapter", "verse", "name", "text")

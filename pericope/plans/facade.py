"""The library's front door: searches and selections over one source."""

from __future__ import annotations

import copy
import json
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pericope.errors import CorpusIntegrityError, ReferenceValidationError, RepositoryResourceNotFound, RequestLimitError, SearchDeadlineExceeded, SearchLimitError, SearchValidationError, TranslationNotFoundError
from pericope.functions.text import normalise_name
from pericope.operators import group, index, match
from pericope.plans.caches import KeyedLocks, Recent
from pericope.plans.criteria import SCOPES, Analysed, RequestLimits, SearchLimits, SearchSpec, analyse, valid_limit
from pericope.plans.references import DEFAULT_CODE, AliasBook, BookReference, ReferenceParser
from pericope.sources.repository import Repository, alias_catalogue
from pericope.sources.store import ChapterStore, Snapshot, SnapshotStore, SourceGeneration, books_index
from pericope.sources.validate import code_of


Code = str | None


def _as_text(document: dict) -> str:
    return json.dumps(document, ensure_ascii=False)


class _Corpus:
    """A snapshot's persisted tables; indexes are made when first asked for."""

    def __init__(self, snapshot: Snapshot):
        self.snapshot = snapshot
        self.verses = snapshot.verses.persist()
        row = index.build_units(self.verses).first()
        self.n, self.build = int(row["n"]), int(row["units"])
        names = self.verses.groupBy("book_nr").agg(F.max("book_name").alias("name")).orderBy("book_nr").collect()
        self.books = [r["book_nr"] for r in names]
        self.names = {normalise_name(r["name"]): r["book_nr"] for r in names}
        self.indexes: dict[tuple[bool, str], tuple[DataFrame, DataFrame, int]] = {}
        self.lock = threading.RLock()

    def index(self, case_sensitive: bool, diacritics: str) -> tuple[DataFrame, DataFrame, int]:
        """(tokenised verses, vocabulary, characters of the normalised texts)."""
        with self.lock:
            key = (case_sensitive, diacritics)
            if key not in self.indexes:
                t = index.with_tokens(self.verses, *key).persist()
                v = index.vocabulary(t).persist()
                v.count()  # fills both tables
                self.indexes[key] = (t, v, t.agg(F.coalesce(F.sum(F.length("norm")), F.lit(0))).first()[0])
            return self.indexes[key]

    def unpersist(self) -> None:
        for t, v, _ in self.indexes.values():
            v.unpersist()
            t.unpersist()
        self.verses.unpersist()


class VerseEngine:
    """Searches and selects verses of translations in a repository.

    aliases: an AliasBook, or the path of a folder of catalogues; English names if
    there is none. Limits of caches: None for no limit, 0 to keep nothing.
    """

    def __init__(
        self, spark: SparkSession, repository: str | Repository, aliases: AliasBook | str | None = None, store: str | None = None, *, search_limits: SearchLimits | None = None,
        request_limits: RequestLimits | None = None, corpus_limit: int | None = 4, reference_limit: int | None = 5000, snapshot_ttl: float = 86_400.0, negative_ttl: float = 300.0,
        negative_limit: int = 64, books_limit: int | None = 64, chapter_limit: int | None = 2048, snapshot_limit: int | None = 4, strict_freshness: bool = False, require_checksum: bool | None = None, purge: Callable[[SourceGeneration], None] | None = None,
    ):
        self.spark = spark
        self.repository = Repository(repository) if isinstance(repository, str) else repository
        m = self.request_limits = request_limits or RequestLimits()
        self.search_limits = search_limits or SearchLimits(max_offset=m.max_search_offset, max_books=m.max_search_books, max_exclusions=m.max_search_exclusions)
        book = AliasBook.from_table(alias_catalogue(spark, aliases)) if isinstance(aliases, str) else aliases or AliasBook.default()
        self.references = ReferenceParser(book, reference_limit)
        self.store = SnapshotStore(spark, store, self.repository, snapshot_ttl, strict_freshness, require_checksum, limit=snapshot_limit)
        self.chapters = ChapterStore(self.store, chapter_limit)
        self.negative_ttl, self.purge = negative_ttl, purge
        self._corpora = Recent(corpus_limit, _Corpus.unpersist)
        self._books = Recent(books_limit)
        self._missing = Recent(negative_limit)
        self._locks = KeyedLocks()

    def __enter__(self) -> VerseEngine:
        return self

    def __exit__(self, *how) -> None:
        self.close()

    def close(self) -> None:
        for c in (self._corpora, self._missing, self._books, self.chapters.kept):
            c.clear()
        self.repository.close()

    # what there is

    def valid_limit(self, limit: Any) -> bool:
        return valid_limit(limit)

    def valid_reference(self, reference: Any, abbreviation: Code = DEFAULT_CODE) -> bool:
        ok = isinstance(reference, str) and len(reference) <= self.request_limits.max_input_length
        return ok and self.references.valid(reference.strip(), abbreviation)

    def valid_translation(self, abbreviation: Any) -> bool:
        try:
            code = code_of(abbreviation)
        except (TypeError, ValueError):
            return False
        with self._locks.hold(f"books:{code}"):
            now = time.time()
            until = self._missing.get(code)
            if until is not None and until > now:
                self._missing.hit(True)
                return False
            known = self._books.get(code)
            self._books.hit(bool(known and self.store.fresh(code, known[0], now)))
            if known and self.store.fresh(code, known[0], now):
                return True
            try:
                self._books.put(code, (now, books_index(self.repository, code)))
                return True
            except RepositoryResourceNotFound:
                self._missing.hit(False)
                if self.negative_ttl > 0:
                    self._missing.put(code, now + self.negative_ttl)
                return False

    def _code(self, abbreviation: Any) -> str:
        return self._existing(code_of(abbreviation))

    def _existing(self, code: str) -> str:
        if self.valid_translation(code):
            return code
        raise TranslationNotFoundError(f"There is no translation {code}.")

    @contextmanager
    def _corpus(self, code: str) -> Iterator[_Corpus]:
        """The corpus, for as long as it is used; where none are kept, its tables are let go at the end."""
        snapshot = self.store.load(code)
        key = (code, snapshot.sha)
        with self._locks.hold(f"corpus:{code}"):
            got = self._corpora.get(key)
            self._corpora.hit(got is not None)
            if got is not None:
                got.snapshot = snapshot
                kept = True
            else:
                for old in [k for k in self._corpora.keys() if k[0] == code]:
                    if gone := self._corpora.pop(old):
                        gone.unpersist()
                got = _Corpus(snapshot)
                kept = self._corpora.put(key, got)
        try:
            yield got
        finally:
            if not kept:
                got.unpersist()

    # search

    def search(self, query: str, abbreviation: Code = DEFAULT_CODE, criteria: Any = None) -> dict[str, Any]:
        """A page of matching verses by chapter, with exact total, scores and cost. Everything that needs no corpus is checked first."""
        q = analyse(query, SearchSpec.from_value(criteria), self.search_limits)
        code = self._code(abbreviation)
        with self.source_operation():
            return self._search(q, code)

    def search_json(self, query: str, abbreviation: Code = DEFAULT_CODE, criteria: Any = None) -> str:
        return _as_text(self.search(query, abbreviation, criteria))

    def resolve_books(self, corpus: _Corpus, books: tuple[int | str, ...]) -> set[int]:
        out = set()
        for b in books:
            if isinstance(b, str):
                number = int(b.strip()) if b.strip().isdecimal() else corpus.names.get(normalise_name(b)) or self.references.book_number(b, corpus.snapshot.abbreviation)
            else:
                number = b
            if number not in corpus.books:
                raise SearchValidationError(f"This translation has no book {b!r}.")
            out.add(number)
        return out

    def _search(self, q: Analysed, code: str) -> dict[str, Any]:
        spec, limits = q.spec, self.search_limits
        with self._corpus(code) as corpus:
            lo, hi = SCOPES[spec.scope]
            books = {b for b in corpus.books if (lo is None or b >= lo) and (hi is None or b <= hi)}
            if spec.books:
                books &= self.resolve_books(corpus, spec.books)
            narrow = books != set(corpus.books)
            first = corpus.build + corpus.n + 8 * spec.limit
            self._reserve(first)
            # a translation's index is made once, as warm_translation() does it, and doesn't count towards a search's time
            tokenised, vocabulary, chars = corpus.index(spec.case_sensitive, spec.diacritics)
            with self._deadline():
                _, second = index.search_units(corpus.n, corpus.build, vocabulary, chars, q, narrow)
                self._reserve(second)
                found = match.hits(tokenised, q, sorted(books) if narrow else None)
                if match.counted_by_vocabulary(q) and not narrow:
                    total = match.vocabulary_total(vocabulary, q)
                else:
                    total = found.count()
                rows = match.page(found, spec.sort, spec.offset, spec.limit).collect() if total > spec.offset else []
            s = corpus.snapshot
            return group.search_document(rows, q, s.metadata, s.chapter_fields, code, s.sha, s.checked_at, s.stale, total, max(first, second), limits.deadline_seconds, limits.max_response_bytes)

    def _reserve(self, units: int) -> None:
        if units > self.search_limits.max_work_units:
            raise SearchLimitError(f"The search needs {units} work units, {self.search_limits.max_work_units} are allowed.")

    @contextmanager
    def _deadline(self) -> Iterator[None]:
        """Interrupts this thread's Spark jobs when time is up; that may take a moment longer."""
        tag, late = f"search-{uuid.uuid4().hex}", threading.Event()

        def stop() -> None:
            late.set()
            self.spark.interruptTag(tag)

        timer = threading.Timer(self.search_limits.deadline_seconds, stop)
        timer.daemon = True
        self.spark.addTag(tag)
        timer.start()
        try:
            yield
        except Exception as e:
            if late.is_set():
                raise SearchDeadlineExceeded(f"The search took over {self.search_limits.deadline_seconds} seconds.") from e
            raise
        finally:
            timer.cancel()
            self.spark.removeTag(tag)
        if late.is_set():
            raise SearchDeadlineExceeded(f"The search took over {self.search_limits.deadline_seconds} seconds.")

    # selection

    def select(self, reference: str, abbreviation: Code = DEFAULT_CODE) -> dict[str, Any]:
        """Verses of references that semicolons separate, by chapter, in the order of the request."""
        code = code_of(abbreviation)
        refs = self._references(reference, code)
        self._existing(code)
        with self.source_operation():
            return self._select(refs, code)

    def scripture(self, reference: str, abbreviation: Code = DEFAULT_CODE) -> str:
        return _as_text(self.select(reference, abbreviation))

    def _references(self, reference: Any, code: str) -> list[BookReference]:
        m = self.request_limits
        if not isinstance(reference, str):
            raise ReferenceValidationError("A reference has to be text.")
        if len(reference) > m.max_input_length:
            raise RequestLimitError(f"References can't be longer than {m.max_input_length} characters.")
        parts = reference.split(";")
        if len(parts) > m.max_references:
            raise RequestLimitError(f"A request can't have over {m.max_references} references.")
        out, total = [], 0
        for p in parts:
            if not p.strip():
                raise ReferenceValidationError("A reference is empty.")
            r = self.references.ref(p.strip(), code)
            total += len(r.verses)
            if len(r.verses) > m.max_verses_per_reference or total > m.max_total_verses:
                raise RequestLimitError(f"A reference can take {m.max_verses_per_reference} verses and a request {m.max_total_verses}.")
            out.append(r)
        return out

    def _select(self, refs: list[BookReference], code: str) -> dict[str, Any]:
        """By the chapters' own files: a request names few, so no translation is loaded for it. For many references at once there is references.select_verses()."""
        out: dict[str, Any] = {}
        seen: dict[str, set[int]] = {}
        for r in refs:
            key = f"{code}_{r.book}_{r.chapter}"
            doc = self.chapters.load(code, r.book, r.chapter)
            for n in r.verses:
                if n not in doc["verses"]:
                    raise ReferenceValidationError(f"Verse {n} not found in book {r.book}, chapter {r.chapter}.")
                if key not in out:
                    out[key] = {k: copy.deepcopy(v) for k, v in doc.items() if k != "verses"} | {"ref": [], "verses": []}
                if n not in seen.setdefault(key, set()):
                    seen[key].add(n)
                    out[key]["verses"].append(copy.deepcopy(doc["verses"][n]))
            if r.reference not in out[key]["ref"]:
                out[key]["ref"].append(r.reference)
        return out

    # state

    def warm_translation(self, abbreviation: Code = DEFAULT_CODE, *, case_sensitive: bool = False, diacritics: str = "sensitive") -> dict[str, Any]:
        """Loads a translation and makes one of its indexes."""
        SearchSpec(case_sensitive=case_sensitive, diacritics=diacritics)
        code = self._code(abbreviation)
        with self.source_operation():
            with self._corpus(code) as c:
                c.index(case_sensitive, diacritics)
                s = c.snapshot
                return {"abbreviation": code, "sha": s.sha, "verses": c.n, "checked_at": s.checked_at, "stale": s.stale, "indexes": [{"case_sensitive": a, "diacritics": b} for a, b in c.indexes]}

    @contextmanager
    def source_operation(self) -> Iterator[Any]:
        """Holds the source's generation still; may nest."""
        with self.store.barrier.shared():
            yield self.store.generation()

    def transition_source(self, revision: str) -> SourceGeneration:
        new = self.store.transition(revision, self.purge)
        for c in (self._missing, self._books, self.chapters.kept):
            c.clear()
        return new

    def cache_info(self) -> dict[str, Any]:
        corpora, missing = self._corpora.info(), self._missing.info()
        counters = {"corpus_hits": corpora["hits"], "corpus_misses": corpora["misses"], "corpus_evictions": corpora["evictions"], "negative_hits": missing["hits"], "negative_misses": missing["misses"], "negative_evictions": missing["evictions"]}
        return {
            "corpora": corpora | {"indexes": {k[0]: len(c.indexes) for k, c in self._corpora.items()}}, "books": self._books.info(), "chapters": self.chapters.kept.info(), "translations": self.store.info(),
            "references": self.references.cache_info(), "snapshots": dict(self.store.counters), "generation": asdict(self.store.generation()),
            "negative_translations": missing | {"ttl_seconds": self.negative_ttl}, "counters": counters,
            "request_limits": asdict(self.request_limits), "search_limits": self.search_limits.to_dict(), "repository_max_response_bytes": self.repository.max_response_bytes,
        }

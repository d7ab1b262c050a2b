"""Snapshots of translations, addressed by checksum, and generations of their source.

A snapshot is the raw text and a Parquet folder of its verses, both under the
text's SHA-1; they never change once written. A small JSON file per translation
points at the current one and is replaced atomically, last. Whatever doesn't
hold together when read counts as absent.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pericope.errors import CorpusIntegrityError, RepositoryError, RepositoryResourceNotFound, RepositoryResponseError
from pericope.operators.verses import METADATA, TRANSLATION, flatten
from pericope.sources.repository import Repository
from pericope.plans.caches import KeyedLocks, Recent
from pericope.sources.validate import chapter_fault, document_faults, valid_sha

RULES_VERSION = 1


@dataclass(frozen=True, slots=True)
class SourceGeneration:
    namespace: str
    generation: int = 0
    revision: str = "initial"
    updated_at: float = 0.0

    def __post_init__(self) -> None:
        if isinstance(self.generation, bool) or not isinstance(self.generation, int) or self.generation < 0:
            raise CorpusIntegrityError("A generation is a number from 0.")
        check_revision(self.revision)
        if isinstance(self.updated_at, bool) or not isinstance(self.updated_at, (int, float)) or not math.isfinite(self.updated_at) or self.updated_at < 0:
            raise CorpusIntegrityError("updated_at is a time.")


def check_revision(revision: Any) -> str:
    """1 to 256 characters, none of them a control character."""
    if not isinstance(revision, str) or not 1 <= len(revision) <= 256 or any(ord(c) < 32 or ord(c) == 127 for c in revision):
        raise CorpusIntegrityError("A revision has 1 to 256 characters and no control characters.")
    return revision


@dataclass(frozen=True, slots=True)
class Snapshot:
    abbreviation: str
    sha: str
    checked_at: float
    metadata: dict
    chapter_fields: dict
    verses: DataFrame
    stale: bool = False


def _canonical(x: dict) -> bytes:
    return json.dumps(x, separators=(",", ":"), sort_keys=True).encode()


def write_atomically(at: Path, body: bytes) -> None:
    at.parent.mkdir(parents=True, exist_ok=True)
    tmp = at.with_name(f".{at.name}.{os.getpid()}.{threading.get_ident()}")
    with open(tmp, "wb") as f:
        f.write(body)
        f.flush()
        os.fsync(f.fileno())
    os.replace(tmp, at)
    fd = os.open(at.parent, os.O_RDONLY)
    try:
        os.fsync(fd)
    finally:
        os.close(fd)


class Barrier:
    """Many operations or one transition; a waiting transition goes before new operations. Operations may nest within a thread."""

    def __init__(self) -> None:
        self.free = threading.Condition()
        self.inside: dict[int, int] = {}
        self.waiting, self.writer = 0, 0

    @contextmanager
    def shared(self) -> Iterator[None]:
        me = threading.get_ident()
        with self.free:
            while me not in self.inside and me != self.writer and (self.waiting or self.writer):
                self.free.wait()
            self.inside[me] = self.inside.get(me, 0) + 1
        try:
            yield
        finally:
            with self.free:
                self.inside[me] -= 1
                if not self.inside[me]:
                    del self.inside[me]
                self.free.notify_all()

    @contextmanager
    def alone(self) -> Iterator[None]:
        me = threading.get_ident()
        with self.free:
            if me in self.inside:
                raise RuntimeError("A transition can't begin within an operation.")
            self.waiting += 1
            try:
                while self.inside or self.writer:
                    self.free.wait()
                self.writer = me
            finally:
                self.waiting -= 1
        try:
            yield
        finally:
            with self.free:
                self.writer = 0
                self.free.notify_all()


def _root(spark: SparkSession, root: str | os.PathLike | None) -> str:
    """The folder given, or set in the environment; else, on a cluster, one in spark.checkpoint.dir, and in local mode the user's cache."""
    base = root or os.environ.get("PERICOPE_CACHE_DIR")
    if not base and not spark.sparkContext.master.startswith("local["):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            raise ValueError("On a cluster, a store needs a folder that driver and executors share.")
        base = f"{base}/pericope"
    base = str(base or os.path.join(os.environ.get("XDG_CACHE_HOME") or os.path.expanduser("~/.cache"), "pericope"))
    base = base.removeprefix("file://")
    if "://" in base:
        raise ValueError(f"{base} isn't a mounted folder, which a store needs.")
    return base


class SnapshotStore:
    """Current snapshots of one source. root is a mounted folder that driver and executors share."""

    def __init__(
        self, spark: SparkSession, root: str | os.PathLike | None, repository: Repository, ttl: float = 86_400.0, strict: bool = False, require_checksum: bool | None = None, clock: Callable[[], float] = time.time,
        limit: int | None = 4,
    ):
        self.spark, self.repository, self.ttl, self.strict, self.clock = spark, repository, ttl, strict, clock
        self.require_checksum = repository.remote if require_checksum is None else require_checksum
        self.namespace = hashlib.sha256(f"{repository.path}|{repository.version}".encode()).hexdigest()[:16]
        self.root = Path(_root(spark, root)) / self.namespace
        self.barrier = Barrier()
        self._memory = Recent(limit)
        self.counters = dict.fromkeys(("memory_hits", "disk_hits", "refreshes", "stale"), 0)
        self._locks = KeyedLocks()

    # generations

    def generation(self) -> SourceGeneration:
        at = self.root / "generation.json"
        if not at.exists():
            return SourceGeneration(self.namespace)
        try:
            got = json.loads(at.read_text("utf-8"))
            g = SourceGeneration(**got)
        except (ValueError, TypeError) as e:
            raise CorpusIntegrityError("The generation manifest can't be read.") from e
        if g.namespace != self.namespace:
            raise CorpusIntegrityError("The generation manifest is another source's.")
        return g

    def transition(self, revision: str, purge: Callable[[SourceGeneration], None] | None = None) -> SourceGeneration:
        """Makes revision the current one. If purge fails, nothing has changed; the current revision again is no transition."""
        check_revision(revision)
        with self.barrier.alone():
            old = self.generation()
            if old.revision == revision:
                return old
            new = SourceGeneration(self.namespace, old.generation + 1, revision, self.clock())
            if purge:
                purge(new)
            write_atomically(self.root / "generation.json", _canonical(asdict(new)))
            self.invalidate()
            return new

    # snapshots

    def info(self) -> dict[str, int | None]:
        return self._memory.info()

    def invalidate(self, abbreviation: str = "") -> None:
        for key in [abbreviation] if abbreviation else self._memory.keys():
            self._memory.pop(key)

    def fresh(self, name: str, checked_at: float, now: float) -> bool:
        """The time to live, shortened by up to a tenth, always the same tenth for one source and name."""
        part = int.from_bytes(hashlib.blake2b(f"{self.namespace}:{name}".encode(), digest_size=4).digest(), "big") / 2**32
        return self.ttl > 0 and 0 <= now - checked_at < self.ttl * (1 - part / 10)

    def _fresh(self, s: Snapshot, now: float) -> bool:
        return self.fresh(s.abbreviation, s.checked_at, now)

    def load(self, abbreviation: str) -> Snapshot:
        """From memory, disk or source, the first that is fresh; if the source fails, the last known good one, marked stale, unless strict."""
        with self.barrier.shared(), self._locks.hold(abbreviation):
            now, generation = self.clock(), self.generation().generation
            known = self._memory.get(abbreviation)
            if known and known[0] == generation and self._fresh(known[1], now):
                self.counters["memory_hits"] += 1
                return known[1]
            old = self._read(abbreviation, generation)
            if old and self._fresh(old, now):
                self.counters["disk_hits"] += 1
                self._memory.put(abbreviation, (generation, old))
                return old
            try:
                new = self._refresh(abbreviation, old, generation)
                self.counters["refreshes"] += 1
            except (CorpusIntegrityError, RepositoryError):
                if old is None or self.strict:
                    raise
                self.counters["stale"] += 1
                return Snapshot(old.abbreviation, old.sha, old.checked_at, old.metadata, old.chapter_fields, old.verses, True)
            self._memory.put(abbreviation, (generation, new))
            return new

    def _pointer(self, abbreviation: str) -> Path:
        return self.root / "current" / f"{abbreviation}.json"

    def _read(self, abbreviation: str, generation: int) -> Snapshot | None:
        try:
            p = json.loads(self._pointer(abbreviation).read_text("utf-8"))
            raw = (self.root / "objects" / f"{p['sha']}.json").read_bytes()
            ok = p["rules"] == RULES_VERSION and p["abbreviation"] == abbreviation and p["source"] == self.namespace and valid_sha(p["sha"]) and hashlib.sha1(raw).hexdigest() == p["sha"]
            checked = float(p["checked_at"])
            if not ok or not math.isfinite(checked) or checked < 0 or not (self._parquet(p["sha"]) / "_SUCCESS").exists():
                return None
            # what an older generation checked has to be checked again
            return self._snapshot(abbreviation, raw, p["sha"], checked if p["generation"] == generation else 0.0)
        except (OSError, ValueError, KeyError, TypeError):
            return None

    def _parquet(self, sha: str) -> Path:
        return self.root / "verses" / f"sha={sha}"

    def _snapshot(self, abbreviation: str, raw: bytes, sha: str, checked: float) -> Snapshot:
        doc = json.loads(raw)
        meta = {k: v for k, v in doc.items() if k != "books"}
        verses = self.spark.read.parquet(str(self._parquet(sha)))
        return Snapshot(abbreviation, sha, checked, meta, {k: meta[k] for k in METADATA if k in meta}, verses)

    def published_or_none(self, relative: str) -> str:
        try:
            sha = self.repository.fetch_text(relative).strip().lower()
        except RepositoryResourceNotFound:
            return ""
        if not valid_sha(sha):
            raise CorpusIntegrityError(f"{relative} holds no checksum.")
        return sha

    def published(self, relative: str) -> str:
        sha = self.published_or_none(relative)
        if not sha and self.require_checksum:
            raise CorpusIntegrityError(f"{relative} is required.")
        return sha

    def _refresh(self, abbreviation: str, old: Snapshot | None, generation: int) -> Snapshot:
        published = self.published(f"{abbreviation}.sha")
        index = books_index(self.repository, abbreviation)
        now = self.clock()
        if old and published and published == old.sha:
            check_books(json.loads((self.root / "objects" / f"{old.sha}.json").read_bytes()), index)
            self._point(abbreviation, old.sha, now, generation)
            return Snapshot(abbreviation, old.sha, now, old.metadata, old.chapter_fields, old.verses)
        raw = self.repository.fetch_bytes(f"{abbreviation}.json")
        sha = hashlib.sha1(raw).hexdigest()
        if published and sha != published:
            raise CorpusIntegrityError(f"{abbreviation}: the checksum is {sha}, {published} was published.")
        doc = check_translation(raw, abbreviation)
        check_books(doc, index)
        self._write(raw, sha)
        self._point(abbreviation, sha, now, generation)
        return self._snapshot(abbreviation, raw, sha, now)

    def _write(self, raw: bytes, sha: str) -> None:
        at = self.root / "objects" / f"{sha}.json"
        if not at.exists() or hashlib.sha1(at.read_bytes()).hexdigest() != sha:
            write_atomically(at, raw)
        if not (self._parquet(sha) / "_SUCCESS").exists():
            one = self.spark.createDataFrame([(raw.decode("utf-8"),)], "raw string").withColumn("t", F.from_json("raw", TRANSLATION)).select("t.*")
            verses = flatten(one)
            open_fields = _open_fields(self.spark, json.loads(raw))
            verses = verses.join(open_fields, ["book_nr", "chapter", "verse"], "left") if open_fields is not None else verses.withColumn("extra_json", F.lit(None).cast("string"))
            verses.coalesce(1).sortWithinPartitions("book_nr", "chapter", "verse").write.mode("overwrite").parquet(str(self._parquet(sha)))

    def _point(self, abbreviation: str, sha: str, now: float, generation: int) -> None:
        p = {"rules": RULES_VERSION, "abbreviation": abbreviation, "sha": sha, "checked_at": now, "generation": generation, "source": self.namespace}
        write_atomically(self._pointer(abbreviation), _canonical(p))


def _open_fields(spark: SparkSession, doc: dict) -> DataFrame | None:
    """What verses carry besides the fixed fields, as JSON text; None if nothing."""
    known = {"chapter", "verse", "name", "text"}
    rows = [
        (b["nr"], c["chapter"], v["verse"], json.dumps({k: x for k, x in v.items() if k not in known}, ensure_ascii=False))
        for b in doc["books"] for c in b["chapters"] for v in c["verses"] if set(v) - known
    ]
    return spark.createDataFrame(rows, "book_nr int, chapter int, verse int, extra_json string") if rows else None


def books_index(repository: Repository, abbreviation: str) -> dict[int, dict]:
    """A translation's books.json by number, checked."""
    out: dict[int, dict] = {}
    got = repository.fetch_json(f"{abbreviation}/books.json")
    if not 1 <= len(got) <= 256:
        raise CorpusIntegrityError("An index has 1 to 256 books.")
    for key, b in got.items():
        ok = key.isascii() and key.isdigit() and isinstance(b, dict) and not isinstance(b.get("nr"), bool) and b.get("nr") == int(key)
        if not ok or int(key) in out or not isinstance(b.get("name"), str) or not b["name"].strip() or str(b.get("abbreviation", "")).casefold() != abbreviation:
            raise CorpusIntegrityError(f"Index entry {key!r} is wrong.")
        out[int(key)] = b
    return out


def check_translation(raw: bytes, abbreviation: str) -> dict:
    """A translation's raw bytes, decoded, if they break no constraint."""
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError as e:
        raise CorpusIntegrityError(f"{abbreviation} isn't UTF-8.") from e
    if faults := document_faults(text, abbreviation):
        raise CorpusIntegrityError(f"{abbreviation}: {faults[0][0]}, {faults[0][1]}")
    return json.loads(text)


class ChapterStore:
    """Chapters by their own files, checked as they come and kept while they are fresh; the most recent ones only."""

    def __init__(self, store: SnapshotStore, limit: int | None = 2048):
        self.store, self.kept, self._locks = store, Recent(limit), KeyedLocks()

    def load(self, abbreviation: str, book: int, chapter: int) -> dict:
        """The chapter with its verses by number. Not to be changed by the caller."""
        name = f"{abbreviation}/{book}/{chapter}"
        with self._locks.hold(name):
            now = self.store.clock()
            known = self.kept.get(name)
            if known and self.store.fresh(name, known[0], now):
                self.kept.hit(True)
                return known[2]
            self.kept.hit(False)
            published = self.store.published_or_none(f"{name}.sha")
            if known and published and published == known[1]:
                self.kept.put(name, (now, *known[1:]))
                return known[2]
            try:
                raw = self.store.repository.fetch_bytes(f"{name}.json")
            except RepositoryResourceNotFound as e:
                raise FileNotFoundError(f"Chapter:{chapter} in book:{book} for {abbreviation} not found.") from e
            if not published and self.store.require_checksum:
                raise RepositoryResponseError(f"{name}.sha, a required checksum, is missing.")
            sha = hashlib.sha1(raw).hexdigest()
            if published and sha != published:
                raise CorpusIntegrityError(f"{name}: the checksum is {sha}, {published} was published.")
            try:
                text = raw.decode("utf-8")
            except UnicodeDecodeError as e:
                raise CorpusIntegrityError(f"{name} isn't UTF-8.") from e
            if fault := chapter_fault(text, abbreviation, book, chapter):
                raise CorpusIntegrityError(f"{name}: V19, {fault}")
            doc = json.loads(text)
            doc["verses"] = {v["verse"]: v for v in doc["verses"]}
            self.kept.put(name, (now, sha, doc))
            return doc


def check_books(doc: dict, index: dict[int, dict]) -> None:
    def entry(nr: int, name: str, meta: dict) -> tuple:
        return (nr, name, *(meta.get(k) for k in METADATA))

    if {entry(b["nr"], b["name"], doc) for b in doc["books"]} != {entry(n, b["name"], b) for n, b in index.items()}:
        raise CorpusIntegrityError("V14, the books aren't those of the index.")

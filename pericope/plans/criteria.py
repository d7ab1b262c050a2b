"""What a search asks for and what it may cost, checked before any Spark job."""

from __future__ import annotations

import dataclasses
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pericope.errors import SearchLimitError, SearchValidationError
from pericope.functions.text import normalise, tokenise

_CHOICES = {
    "words": ("all", "any", "phrase"),
    "match": ("whole_word", "substring"),
    "scope": ("bible", "old_testament", "new_testament", "deuterocanon"),
    "diacritics": ("sensitive", "insensitive"),
    "sort": ("canonical", "relevance"),
}
SCOPES = {"bible": (None, None), "old_testament": (1, 39), "new_testament": (40, 66), "deuterocanon": (67, None)}
_LEGACY = (
    {"allwords": {"words": "all"}, "anywords": {"words": "any"}, "exactwords": {"words": "phrase"}},
    {"exactmatch": {"match": "whole_word"}, "partialmatch": {"match": "substring"}},
    {"caseinsensitive": {"case_sensitive": False}, "casesensitive": {"case_sensitive": True}},
    {"allbooks": {}, "oldtestament": {"scope": "old_testament"}, "newtestament": {"scope": "new_testament"}, "deuterocanon": {"scope": "deuterocanon"}},
)
#: The legacy targets that valid_limit() knows.
_LEGACY_BOOKS = {str(n): n for n in range(1, 84)}


def _whole(x: Any) -> bool:
    return isinstance(x, int) and not isinstance(x, bool)


#: The name of one of _CHOICES, a number of extra words, and what lists may hold.
Mode, Gap, Books, Texts, Size = str, int | None, tuple[int | str, ...], tuple[str, ...], int


@dataclass(frozen=True, slots=True)
class SearchSpec:
    """A validated search. Mode names are compared without regard to case."""

    words: Mode = "all"
    match: Mode = "whole_word"
    case_sensitive: bool = False
    scope: Mode = "bible"
    books: Books = ()
    diacritics: Mode = "sensitive"
    exclude: Texts = ()
    proximity: Gap = None
    sort: Mode = "canonical"
    limit: Size = 100
    offset: Size = 0

    def __post_init__(self) -> None:
        def put(name: str, value: Any) -> None:
            object.__setattr__(self, name, value)

        for name, known in _CHOICES.items():
            value = getattr(self, name)
            if not isinstance(value, str):
                raise SearchValidationError(f"{name} has to be text.")
            put(name, value.casefold())
            if getattr(self, name) not in known:
                raise SearchValidationError(f"{name}: {value!r} is none of {', '.join(known)}.")
        for name, single in (("books", (int, str)), ("exclude", (str,))):
            given = getattr(self, name)
            put(name, (given,) if isinstance(given, single) else tuple(given))
        if self.case_sensitive not in (True, False) or _whole(self.case_sensitive):
            raise SearchValidationError("case_sensitive has to be true or false.")
        if not all(_whole(b) or isinstance(b, str) for b in self.books):
            raise SearchValidationError("books may hold names and numbers only.")
        if not all(isinstance(x, str) and x.strip() for x in self.exclude):
            raise SearchValidationError("exclude may hold texts only, none of them blank.")
        if self.proximity is not None:
            if not _whole(self.proximity) or not 0 <= self.proximity <= 100:
                raise SearchValidationError("proximity has to be a whole number from 0 to 100, or null.")
            if "all" != self.words:
                raise SearchValidationError("proximity needs words='all'.")
        if not _whole(self.limit) or not 1 <= self.limit <= 1000:
            raise SearchValidationError("limit has to be a whole number from 1 to 1000.")
        if not _whole(self.offset) or self.offset < 0:
            raise SearchValidationError("offset has to be a whole number from 0.")

    @classmethod
    def from_value(cls, value: SearchSpec | Mapping[str, Any] | str | None) -> SearchSpec:
        """From nothing, a spec, a mapping or a legacy text."""
        if isinstance(value, (cls, str)):
            return value if isinstance(value, cls) else cls.from_legacy(value)
        if value is not None and not isinstance(value, Mapping):
            raise SearchValidationError("A search is described by a SearchSpec, a mapping, or a legacy text.")
        given = dict(value or {})
        odd = sorted(str(k) for k in given if k not in {f.name for f in dataclasses.fields(cls)})
        if odd:
            raise SearchValidationError(f"Not part of a search: {', '.join(odd)}.")
        try:
            return cls(**given)
        except TypeError as e:
            raise SearchValidationError(str(e)) from e

    @classmethod
    def from_legacy(cls, value: str) -> SearchSpec:
        """From words-match-case-target, the last a scope or a book number from 1 to 83."""
        parts = value.split("-")
        given: dict[str, Any] = {}
        ok = len(parts) == 4
        for part, known in zip(parts, _LEGACY):
            if part in known:
                given |= known[part]
            elif known is _LEGACY[3] and part.isdigit() and 1 <= int(part) <= 83:
                given["books"] = (int(part),)
            else:
                ok = False
        if not ok:
            raise SearchValidationError(f"{value!r} is no legacy search.")
        return cls(**given)

    @classmethod
    def from_params(cls, params: Mapping[str, Any]) -> SearchSpec:
        """From the parameters of an address: texts, book and exclude repeated or, for books, with commas."""

        def many(x: Any) -> list[str]:
            return [x] if isinstance(x, str) else list(x)

        given: dict[str, Any] = {k: v for k, v in params.items() if k in _CHOICES}
        books = many(params.get("book", [])) + [b for x in many(params.get("books", [])) for b in x.split(",")]
        given["books"] = tuple(int(b) if b.strip().isdigit() else b.strip() for b in books if b.strip())
        given["exclude"] = tuple(many(params.get("exclude", [])))
        if "case_sensitive" in params:
            flags = {"true": True, "1": True, "false": False, "0": False}
            if str(params["case_sensitive"]).casefold() not in flags:
                raise SearchValidationError("case_sensitive has to be true or false.")
            given["case_sensitive"] = flags[str(params["case_sensitive"]).casefold()]
        for name in ("proximity", "limit", "offset"):
            if name in params:
                try:
                    given[name] = int(params[name])
                except ValueError as e:
                    raise SearchValidationError(f"{name} has to be a whole number.") from e
        return cls(**given)

    def with_pagination(self, limit: Size, offset: Size) -> SearchSpec:
        """The same search, another page."""
        return dataclasses.replace(self, offset=offset, limit=limit)

    @property
    def expensive(self) -> bool:
        """Whether this belongs in the stricter class of request rates; known without any corpus."""
        cheap = SearchSpec(case_sensitive=self.case_sensitive, scope=self.scope, books=self.books, limit=min(self.limit, 100), offset=min(self.offset, 1000))
        return self != cheap

    def to_dict(self) -> dict:
        return {f.name: list(v) if isinstance(v := getattr(self, f.name), tuple) else v for f in dataclasses.fields(self)}


def valid_limit(limit: Any) -> bool:
    """Whether a legacy search text has only the documented parts; unlike from_legacy(), not 01 for 1."""
    parts = limit.split("-") if isinstance(limit, str) else []
    return len(parts) == 4 and all(p in k for p, k in zip(parts, (*_LEGACY[:3], {**_LEGACY[3], **_LEGACY_BOOKS})))


@dataclass(frozen=True, slots=True)
class SearchLimits:
    max_work_units: Size = 50_000_000
    max_response_bytes: Size = 4 << 20
    max_query_length: Size = 500
    max_query_terms: Size = 64
    min_substring_length: Size = 3
    max_books: Size = 83
    max_exclusions: Size = 32
    max_exclusion_terms: Size = 64
    max_offset: Size = 10_000
    max_limit: Size = 1_000
    deadline_seconds: float = 5.0
    checkpoint_interval: Size = 256

    def __post_init__(self) -> None:
        for f in dataclasses.fields(self):
            value = getattr(self, f.name)
            if f.name == "deadline_seconds":
                if isinstance(value, bool) or not isinstance(value, (int, float)) or not 0 < value < float("inf"):
                    raise ValueError("deadline_seconds has to be a positive number.")
            elif not _whole(value) or value < (0 if f.name == "max_offset" else 1):
                raise ValueError(f"{f.name} has to be a positive whole number.")

    def to_dict(self) -> dict:
        return dataclasses.asdict(self)


@dataclass(frozen=True, slots=True)
class RequestLimits:
    max_input_length: Size = 1024
    max_references: Size = 8
    max_verses_per_reference: Size = 200
    max_total_verses: Size = 200
    max_search_offset: Size = 10_000
    max_search_books: Size = 83
    max_search_exclusions: Size = 32

    def __post_init__(self) -> None:
        for f in dataclasses.fields(self):
            if not _whole(getattr(self, f.name)) or getattr(self, f.name) < (0 if f.name == "max_search_offset" else 1):
                raise ValueError(f"{f.name} has to be a positive whole number.")
        if self.max_verses_per_reference > 200:
            raise ValueError("max_verses_per_reference can't be over 200.")


@dataclass(frozen=True, slots=True)
class Analysed:
    """A query in the terms in which it is matched."""

    text: str
    normalised: str
    terms: tuple[str, ...]
    excluded: tuple[str, ...]
    spec: SearchSpec


def analyse(query: Any, spec: SearchSpec, limits: SearchLimits | None = None) -> Analysed:
    """Checks everything about a query that needs no corpus. excluded keeps repeated terms, as they count towards the limits and the work."""
    m = limits or SearchLimits()
    if not isinstance(query, str):
        raise SearchValidationError("A query has to be text.")
    text = query.strip()
    if not text:
        raise SearchValidationError("A query can't be empty.")
    if len(text) > m.max_query_length:
        raise SearchValidationError(f"A query can't be longer than {m.max_query_length} characters.")
    for what, n, most in (("limit", spec.limit, m.max_limit), ("offset", spec.offset, m.max_offset), ("number of books", len(spec.books), m.max_books), ("number of exclusions", len(spec.exclude), m.max_exclusions)):
        if n > most:
            raise SearchLimitError(f"The {what} of a search can't exceed {most}.")
    norm = normalise(text, spec.case_sensitive, spec.diacritics)
    terms = tokenise(norm)
    if not terms:
        raise SearchValidationError("A query has to hold letters or digits.")
    if len(terms) > m.max_query_terms:
        raise SearchValidationError(f"A query can't have over {m.max_query_terms} terms.")
    if spec.words != "phrase":
        terms = list(dict.fromkeys(terms))
    excluded = [t for x in spec.exclude for t in tokenise(normalise(x, spec.case_sensitive, spec.diacritics))]
    if len(excluded) > m.max_exclusion_terms:
        raise SearchLimitError(f"Exclusions can't have over {m.max_exclusion_terms} terms.")
    if spec.match == "substring":
        looked_for = [norm] if spec.words == "phrase" else terms
        if min(map(len, [*looked_for, *excluded])) < m.min_substring_length:
            raise SearchValidationError(f"Parts of words need {m.min_substring_length} characters or more.")
    return Analysed(text, norm, tuple(terms), tuple(excluded), spec)

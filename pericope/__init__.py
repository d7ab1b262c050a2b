"""Verse search and reference lookup over versioned, hierarchical text, on Spark DataFrames."""

from importlib import import_module

_WHERE = {
    "pericope.errors": (
        "VerseError TranslationNotFoundError CorpusIntegrityError ReferenceValidationError RequestLimitError SearchValidationError SearchLimitError SearchDeadlineExceeded "
        "RepositoryError RepositoryTimeoutError RepositoryResourceNotFound RepositoryResponseError RepositoryResponseTooLarge"
    ).split(),
    "pericope.plans.criteria": ("RequestLimits", "SearchLimits", "SearchSpec"),
    "pericope.plans.facade": ("VerseEngine",),
    "pericope.plans.references": ("AliasBook", "BookReference", "ReferenceParser"),
    "pericope.sources.store": ("SourceGeneration",),
}
__all__ = sorted(name for names in _WHERE.values() for name in names)


def __getattr__(name: str):
    # loaded when asked for, so that Python workers import only what they run
    for module, names in _WHERE.items():
        if name in names:
            return getattr(import_module(module), name)
    raise AttributeError(name)

"""What can go wrong, as one family of exceptions."""


class VerseError(Exception):
    """Any error of this library."""


class ReferenceValidationError(VerseError, ValueError):
    """A reference that can't be read or resolved."""


class RequestLimitError(ReferenceValidationError):
    """A request for more than is allowed."""


class TranslationNotFoundError(VerseError, FileNotFoundError):
    """No such translation."""


class RepositoryError(VerseError):
    """The source can't be read."""


class RepositoryTimeoutError(RepositoryError):
    """The source took too long."""


class RepositoryResourceNotFound(RepositoryError):
    """The source has no such file."""


class RepositoryResponseError(RepositoryError):
    """The source's answer isn't what it should be."""


class RepositoryResponseTooLarge(RepositoryResponseError):
    """The source's answer is over the size limit."""


class CorpusIntegrityError(VerseError):
    """A corpus breaks a constraint or doesn't match its checksum."""


class SearchValidationError(VerseError, ValueError):
    """A search that makes no sense."""


class SearchLimitError(SearchValidationError, RequestLimitError):
    """A search for more than is allowed."""


class SearchDeadlineExceeded(SearchLimitError, TimeoutError):
    """A search that took too long."""

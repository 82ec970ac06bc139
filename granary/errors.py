"""Failures, by kind. A failure never turns into an empty result."""


class ConnectorError(RuntimeError):
    """Something went wrong at the boundary to a backend."""


class ConnectorOperationalError(ConnectorError):
    """The backend failed."""


class UnsupportedCapability(ConnectorError):
    """The backend does not offer an optional operation."""


class ConnectorContractError(ConnectorError):
    """The backend returned data that break the contract."""


class ConnectorRegistrationError(ConnectorError, ValueError):
    """A connector cannot be registered under this name."""


class InvalidFilterError(ConnectorError, ValueError):
    """A filter is malformed; the message names the path."""


class UnsupportedFilterError(UnsupportedCapability):
    """A filter uses operators or fields the backend does not know."""

    def __init__(self, message: str, operators: tuple = (), fields: tuple = ()):
        super().__init__(message)
        self.operators, self.fields = tuple(operators), tuple(fields)


class SearchIndexError(ValueError):
    """A request the search index cannot answer."""


class SearchIndexMissing(SearchIndexError, FileNotFoundError):
    """There is no index."""


class StaleSearchIndex(SearchIndexError):
    """The index was built from other data."""


class AmbiguousIdError(SearchIndexError):
    """An id prefix fits several ids."""


class OutOfScopeError(SearchIndexError):
    """An id exists, but outside the scope of this handle."""


class DatasetIntegrityError(ValueError):
    """A dataset's recomputed identity differs from the recorded one."""


class RetrievalModeError(ValueError):
    """An override or threshold that the retrieval mode does not allow."""


class PromptTemplateError(ConnectorContractError):
    """A prompt template breaks the rules."""

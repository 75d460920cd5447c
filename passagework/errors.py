"""One exception class for each kind of failure."""


class EngineError(Exception):
    """Base of all errors of this library."""


class InvalidConfig(EngineError):
    """A chunking, parsing or paging configuration that breaks its rules."""


class InvalidInput(EngineError):
    """Malformed arguments of a service call."""


class NotFound(EngineError):
    """No such document, collection, configuration or embedding."""


class AlreadyExists(EngineError):
    """A uniqueness rule would be broken."""


class InvalidProvider(EngineError):
    """No provider is registered under this id."""


class UnsupportedFileType(EngineError):
    """The file's extension is none of the supported ones."""


class InvalidModel(EngineError):
    """The embedder doesn't know this model, or its dimension isn't the collection's."""


class EmptyResult(EngineError):
    """Parsing or chunking produced nothing."""

"""Errors a caller can tell apart."""


class EngineError(Exception):
    """Base of all errors raised by the engine."""


class InvalidQuery(EngineError):
    """A search query that cannot match anything by its form."""


class CollectionNotFound(EngineError):
    """No collection of that name is registered."""


class CollectionExists(EngineError):
    """A collection of that name is registered already."""


class InvalidName(EngineError):
    """Not usable as the name of a collection."""


class Conflict(EngineError):
    """Another writer has changed the index since it was read."""

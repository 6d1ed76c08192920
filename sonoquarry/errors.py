"""Typed errors of the eager guards."""


class DataError(ValueError):
    """Input that would silently give wrong results."""


class StaleEmbeddings(DataError):
    """Vectors of another model or version in one store."""


class DegenerateVectors(DataError):
    """Zero, ragged or collapsed vectors."""


class NothingToDo(DataError):
    """An empty input where rows are needed."""

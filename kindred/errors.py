"""Errors of the engine; all derive from ``KindredError``."""


class KindredError(Exception):
    """Base of all errors."""


class ConfigurationError(KindredError, ValueError):
    """A parameter is outside its range."""


class CompatibilityError(KindredError, ValueError):
    """Sketches or indexes of different width, seed or length were combined."""


class DuplicateKeyError(KindredError, KeyError):
    """A batch holds a key twice or one that the index has."""


class StorageError(KindredError, OSError):
    """A stored index is missing, in the way or damaged."""


class ClosedIndexError(KindredError, RuntimeError):
    """An index was used after it was closed."""


class DedupeError(KindredError, RuntimeError):
    """Deduplication failed."""


class InvalidRepresentativeError(DedupeError):
    """A representative is not a member of its group."""


class ProgressCancelledError(DedupeError):
    """A progress callback asked to stop; ``completed`` records are committed."""

    def __init__(self, completed: int) -> None:
        super().__init__(f"cancelled after {completed} records")
        self.completed = completed

"""What can go wrong, by the statement's author or by another writer."""


class EngineError(RuntimeError):
    """Base of all errors that the engine raises itself."""


class BadSyntaxError(EngineError):
    """A statement that isn't in the dialect."""


class UnknownNameError(EngineError):
    """A table, view or field that doesn't exist."""


class DuplicateNameError(EngineError):
    """A table, view or index that exists already."""


class BadValueError(EngineError):
    """A value that its field can't hold."""


class NotAnExpressionKindError(EngineError):
    """An expression unwrapped as what it isn't."""


class LockAbortError(Exception):
    """Another writer held the database, or changed it since this transaction first read it."""

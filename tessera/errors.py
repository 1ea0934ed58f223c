"""Exceptions of the library."""


class EngineError(Exception):
    """Root of all exceptions raised here."""


class InvalidOperationError(EngineError):
    """An operation that has no meaning for its operands."""


class CastError(EngineError):
    """A cast between types that don't convert, or of a value that doesn't."""


class IncompatibleFrameError(EngineError):
    """A frame whose column names are empty, repeated or not text."""

"""Errors of the frame API."""


class TypeNameError(ValueError):
    """A type that isn't known."""


class OperationError(ValueError):
    """An operation that can't apply to the frame."""

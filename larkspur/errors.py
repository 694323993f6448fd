"""Errors that callers can tell apart."""


class ColumnNotFound(KeyError):
    """A column that an operator was given by name isn't there."""


class SchemaMismatch(ValueError):
    """Two tables that must have the same columns and types don't."""


class UnsupportedCRS(ValueError):
    """A coordinate system that is unknown, or of the wrong kind for an operation."""


class InvalidGeometry(ValueError):
    """Bytes or text that aren't a geometry, or a geometry that an operation can't take."""

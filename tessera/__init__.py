"""A relational engine for Spark: a small typed SQL dialect compiled to lazy DataFrames."""

from .api import Database, IsolationLevel, open  # noqa: A004
from .errors import (
    AmbiguousColumnError,
    BareTableNameError,
    ConstraintViolation,
    EngineError,
    NestedTransactionError,
    NotNullViolation,
    ParseError,
    TypeMismatchError,
    UnknownAliasError,
    UnknownColumnError,
    UnknownTableError,
)

__all__ = [
    "AmbiguousColumnError", "BareTableNameError", "ConstraintViolation", "Database", "EngineError", "IsolationLevel", "NestedTransactionError", "NotNullViolation",
    "ParseError", "TypeMismatchError", "UnknownAliasError", "UnknownColumnError", "UnknownTableError", "open",
]

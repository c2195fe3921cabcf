"""Errors, each with the SQLSTATE a client would see."""

from __future__ import annotations


class EngineError(Exception):
    sqlstate = "HY000"


class ParseError(EngineError):
    sqlstate = "42000"

    def __init__(self, message: str, line: int = 1, col: int = 1, source: str = ""):
        super().__init__(f"{message} at line {line}, column {col}")
        self.message, self.line, self.col, self.source = message, line, col, source

    def snippet(self) -> str:
        """The line in question with a mark under the place."""
        lines = self.source.split("\n")
        return f"{lines[self.line - 1]}\n{' ' * (self.col - 1)}^" if self.line <= len(lines) else ""


class ConstraintViolation(EngineError):
    sqlstate = "22000"


class NotNullViolation(ConstraintViolation):
    pass


class TypeMismatchError(EngineError):
    sqlstate = "22000"


class UnknownTableError(EngineError):
    pass


class UnknownColumnError(EngineError):
    pass


class UnknownAliasError(UnknownColumnError):
    pass


class BareTableNameError(UnknownAliasError):
    """A table is named although the statement gives it an alias."""


class AmbiguousColumnError(EngineError):
    pass


class NestedTransactionError(EngineError):
    sqlstate = "25000"


class TransactionError(EngineError):
    sqlstate = "25000"

"""Typed errors of the CSV engine; each has a stable code and subclasses the nearest builtin."""

from __future__ import annotations


class CsvError(Exception):
    """code: one of CODES. record: 1-based number of no meaning beyond messages; offset: byte offset in the file, if known."""

    code = "INTERNAL"

    def __init__(self, message: str, file: str | None = None, offset: int | None = None):
        where = f" (at byte {offset} of {file})" if offset is not None else ""
        super().__init__(f"{self.code}: {message}{where}")
        self.file, self.offset = file, offset


def _make(code: str, builtin: type[Exception], name: str) -> type[CsvError]:
    return type(name, (CsvError, builtin), {"code": code, "__doc__": f"Error code {code}."})


UnknownColumn = _make("UNKNOWN_COLUMN", LookupError, "UnknownColumn")
DuplicateColumn = _make("DUPLICATE_COLUMN", ValueError, "DuplicateColumn")
EmptyInput = _make("EMPTY_INPUT", ValueError, "EmptyInput")
FieldCount = _make("FIELD_COUNT", ValueError, "FieldCount")
BadValue = _make("BAD_VALUE", ValueError, "BadValue")
UnterminatedQuote = _make("UNTERMINATED_QUOTE", ValueError, "UnterminatedQuote")
BareQuote = _make("BARE_QUOTE", ValueError, "BareQuote")
RecordTooLarge = _make("RECORD_TOO_LARGE", ValueError, "RecordTooLarge")
InvalidOptions = _make("INVALID_OPTIONS", ValueError, "InvalidOptions")
BadHeader = _make("BAD_HEADER", ValueError, "BadHeader")
InvalidUtf8 = _make("INVALID_UTF8", ValueError, "InvalidUtf8")
TooManyCategories = _make("TOO_MANY_CATEGORIES", ValueError, "TooManyCategories")
MissingFile = _make("FILE_NOT_FOUND", FileNotFoundError, "MissingFile")
Cancelled = _make("CANCELLED", RuntimeError, "Cancelled")

CODES: dict[str, type[CsvError]] = {
    e.code: e
    for e in (UnknownColumn, DuplicateColumn, EmptyInput, FieldCount, BadValue, UnterminatedQuote, BareQuote, RecordTooLarge, InvalidOptions, BadHeader, InvalidUtf8, TooManyCategories, MissingFile, Cancelled)
}

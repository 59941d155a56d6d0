"""Options of a strict read and the requested schema."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from quillframe.errors import DuplicateColumn, InvalidOptions, UnknownColumn

KINDS = ("int", "float", "str", "u64", "u32", "cents", "name")


@dataclass(frozen=True)
class ReadOptions:
    """chunk_bytes: size of a file split (the session's if None). workers: tasks at most that read the input (Spark's choice if None).

    max_record_bytes: limit of every record and of the header, without line ending.
    blank_lines: skip or error. validate: check all records before returning, so that the first
    error in file order is raised; without it the result is lazy: bad cells are null, a record that is none
    (wrong number of fields, bad quotes, too long) has null in every column, and a file whose header differs
    from the first file's fails when its rows are read.
    """

    chunk_bytes: int | None = None
    workers: int | None = None
    max_record_bytes: int = 16 << 20
    blank_lines: str = "skip"
    validate: bool = True

    def __post_init__(self) -> None:
        if self.chunk_bytes is not None and self.chunk_bytes < 4096:
            raise InvalidOptions(f"chunk_bytes is {self.chunk_bytes}; it must be 4096 or more")
        if self.workers is not None and self.workers < 1:
            raise InvalidOptions(f"workers is {self.workers}; it must be 1 or more")
        if self.max_record_bytes < 1:
            raise InvalidOptions("max_record_bytes must be positive")
        if self.blank_lines not in ("skip", "error"):
            raise InvalidOptions("blank_lines is skip or error")


Schema = Mapping[str, str] | Iterable[tuple[str, str]] | str


def requested(schema: Schema) -> list[tuple[str, str]]:
    """(name, kind) in the caller's order, from a mapping, pairs, or text like "id:int, amount:float"."""
    if isinstance(schema, str):
        pairs = [tuple(p.strip() for p in part.rsplit(":", 1)) for part in schema.split(",") if part.strip()]
        if any(len(p) != 2 for p in pairs):
            raise InvalidOptions(f"not a schema: {schema!r}")
    else:
        pairs = list(schema.items() if isinstance(schema, Mapping) else schema)
    if not pairs:
        raise InvalidOptions("no columns are requested")
    seen = set()
    for name, kind in pairs:
        if name in seen:
            raise DuplicateColumn(f"column {name!r} is requested twice")
        if kind not in KINDS:
            raise InvalidOptions(f"column {name!r} has unknown kind {kind!r}")
        seen.add(name)
    return pairs


def positions(header: list[str], columns: list[tuple[str, str]]) -> list[int]:
    """Position of each requested column in the file; of repeated header names the first counts."""
    for name, _ in columns:
        if name not in header:
            raise UnknownColumn(f"no column {name!r} in the header")
    return [header.index(name) for name, _ in columns]

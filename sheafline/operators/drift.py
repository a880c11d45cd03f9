"""Fingerprints of input sheets, and how a live file differs from one."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from typing import Literal

from pydantic import BaseModel

from ..sources.xlsx import Sheet, cell_kind, column_number, text_of

#: Rows below the header that types are read from.
SAMPLE_ROWS = 20


class HeaderColumn(BaseModel):
    name: str
    type: Literal["string", "integer", "float", "date", "boolean"]
    strictness: Literal["strict", "position_only", "optional"] = "strict"


class Fingerprint(BaseModel):
    sheet: str
    sheet_is_regex: bool = False
    sheet_index: int | None = None
    header_row: int
    columns: list[HeaderColumn]
    max_rows_from_header_to_data: int = 5


@dataclass(frozen=True)
class Difference:
    kind: str
    sheet: str
    expected: str
    found: str
    column_position: int | None = None

    def message(self) -> str:
        where = "" if self.column_position is None else f" col {self.column_position}"
        return f"sheet {self.sheet!r}{where}: expected `{self.expected}`, found `{self.found}`"


@dataclass
class FingerprintCheck:
    ok: bool
    differences: list[Difference] = field(default_factory=list)
    matched_sheet: str | None = None


class FingerprintDrift(Exception):
    """The file isn't what its fingerprint says; carries the differences."""

    def __init__(self, check: FingerprintCheck) -> None:
        super().__init__("; ".join(d.message() for d in check.differences))
        self.differences = check.differences


def dominant(kinds: list[str]) -> str | None:
    """The commonest kind; of equally common ones, the first in the alphabet."""
    return min(((-n, k) for k, n in Counter(kinds).items()), default=(0, None))[1]


def _match(fp: Fingerprint, names: list[str]) -> tuple[str | None, list[Difference]]:
    found = [n for n in names if (re.fullmatch(fp.sheet, n) if fp.sheet_is_regex else n == fp.sheet)]
    if len(found) != 1:
        kind = "sheet_ambiguous" if found else "sheet_missing"
        return None, [Difference(kind, fp.sheet, fp.sheet, str(found or names))]
    at = names.index(found[0])
    moved = fp.sheet_index is not None and at != fp.sheet_index
    return found[0], [
        Difference("sheet_position_mismatch", found[0], f"position {fp.sheet_index}", f"position {at}")
    ] if moved else []


def _kinds(sheet: Sheet, header: int, column: int) -> list[str]:
    values = (sheet.value(r, column) for r in range(header + 1, header + 1 + SAMPLE_ROWS))
    return [cell_kind(v) for v in values if v is not None]


def check_fingerprint(fp: Fingerprint, sheets: list[Sheet]) -> FingerprintCheck:
    """All differences; without the sheet there is nothing more to compare."""
    name, out = _match(fp, [s.name for s in sheets])
    if name is None:
        return FingerprintCheck(False, out)
    sheet = next(s for s in sheets if s.name == name)
    for i, c in enumerate(fp.columns, 1):
        value = sheet.value(fp.header_row, i)
        if c.strictness == "strict" and value != c.name:
            out.append(
                Difference("header_text_mismatch", name, c.name, "(blank)" if value is None else text_of(value), i)
            )
    span = range(fp.header_row + 1, fp.header_row + 1 + fp.max_rows_from_header_to_data)
    if not any(sheet.value(r, c) is not None for r in span for c in range(1, len(fp.columns) + 1)):
        out.append(
            Difference(
                "data_start_too_far", name,
                f"non-blank data within {fp.max_rows_from_header_to_data} row(s) of header",
                "no non-blank row found in that range"
            )
        )
    for i, c in enumerate(fp.columns, 1):
        kind = dominant(_kinds(sheet, fp.header_row, i)) if c.strictness != "optional" else None
        if kind is not None and kind != c.type:
            out.append(Difference("column_type_mismatch", name, c.type, kind, i))
    return FingerprintCheck(not out, out, name)


def generate_fingerprint(
    sheets: list[Sheet], sheet: str, header_row: int, max_rows_from_header_to_data: int = 5
) -> Fingerprint:
    """What a file looks like now. Columns below a merged header are known by position only."""
    at = next(i for i, s in enumerate(sheets) if s.name == sheet)
    merged: set[int] = set()
    for ref in sheets[at].merges:
        a, r1, b, r2 = re.fullmatch(r"([A-Z]+)(\d+):([A-Z]+)(\d+)", ref).groups()
        if int(r1) <= header_row <= int(r2):
            merged.update(range(column_number(a), column_number(b) + 1))
    columns = [
        HeaderColumn(
            name=text_of(sheets[at].value(header_row, c)) or f"column_{c}",
            type=dominant(_kinds(sheets[at], header_row, c)) or "string",
            strictness="position_only" if c in merged else "strict"
        )
        for c in range(1, sheets[at].max_column + 1)
    ]
    return Fingerprint(
        sheet=sheet, sheet_index=at, header_row=header_row, columns=columns,
        max_rows_from_header_to_data=max_rows_from_header_to_data
    )

"""Mirroring a foreign file into a warehouse table or workbook through an approved crosswalk."""

from __future__ import annotations

import datetime as dt
import shutil
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pydantic import BaseModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import ops
from ..operators.checks import exact_sums
from ..operators.crosswalk import Mapping, crosswalk, load_mapping_for_execution
from ..operators.drift import Fingerprint, FingerprintDrift, check_fingerprint
from ..operators.versions import Store, check_identifier, columns_of
from ..sources.xlsx import Sheet, append_rows, grid, read_workbook, text_of
from .artifact import load_fingerprint, load_schema


class MirrorError(Exception):
    """A file that can't be mirrored."""


class MirrorDuplicateKeyError(MirrorError):
    """Keys that are in the target already, or twice in the file."""

    def __init__(self, existing: tuple[list[tuple], int], within: tuple[list[tuple], int]) -> None:
        found = ((*existing, "already in target"), (*within, "duplicated within this file"))
        parts = [f"{n} {what}: {ops.listed(keys, n)}" for keys, n, what in found if n]
        super().__init__("on_duplicate: fail -- " + "; ".join(parts))
        self.existing, self.within = existing[0], within[0]


@dataclass(frozen=True)
class NumericCheck:
    source_column: str
    target_column: str
    source_sum: float
    target_sum: float


@dataclass(frozen=True)
class Summary:
    source_file: str
    target: str
    dry_run: bool
    rows_in: int
    rows_out: int
    numeric_checks: list[NumericCheck]
    unmapped_source_columns: list[str]
    unmapped_source_columns_action: str
    target_columns_not_populated: list[str]

    def render(self) -> str:
        wide = [
            max((len(getattr(c, f"{side}_column")) for c in self.numeric_checks), default=0)
            for side in ("source", "target")
        ]
        sums = [
            f"  {c.source_column.ljust(wide[0])} -> {c.target_column.ljust(wide[1])} : {c.source_sum:>14,.4f}  ->  "
            f"{c.target_sum:>14,.4f}"
            for c in self.numeric_checks
        ]
        facts = {
            "Source file": self.source_file, "Target": self.target,
            "Mode": "DRY RUN -- nothing written" if self.dry_run else "COMMITTED", "Rows in file": self.rows_in,
            "Rows written": self.rows_out
        }
        sections = {
            "Numeric column checks (sum of source values -> sum of target values)": sums or [
                "  (no numeric target columns in this mapping)"
            ],
            f"Unmapped source columns (policy: {self.unmapped_source_columns_action})": [
                f'  - "{n}" -- present in the file, not in the mapping'
                for n in self.unmapped_source_columns
            ] or ["  (none -- every source column is mapped)"],
            "Target columns not populated by this mapping": [
                f"  - {n}"
                for n in self.target_columns_not_populated
            ] or ["  (none -- every target column is populated)"],
        }
        head = ["Mirror reconciliation summary", "=" * 30, "", *(f"{k.ljust(15)}: {v}" for k, v in facts.items())]
        return "\n".join(head + [x for title, lines in sections.items() for x in ("", title, *lines)])


@dataclass(frozen=True)
class MirrorResult:
    dry_run: bool
    run_id: int | None
    row_ids: range
    summary: Summary
    backup_path: Path | None = None


@dataclass(frozen=True)
class MappingArtifact:
    root: Path
    mapping: Mapping
    fingerprint: Fingerprint
    target_row: type[BaseModel]
    warehouse: Fingerprint | None = field(default=None)


def load_mapping_artifact(root: str | Path) -> MappingArtifact:
    root = Path(root)
    mapping = load_mapping_for_execution(root / "mapping.yaml")
    warehouse = None
    if mapping.excel_target:
        warehouse = load_fingerprint(root / "warehouse_fingerprint.json")
        if len(warehouse.columns) != len(mapping.excel_target.column_order):
            raise MirrorError(f"{root}: warehouse fingerprint and region differ in width")
    return MappingArtifact(
        root, mapping, load_fingerprint(root / "fingerprint.json"), load_schema(root / "schema.py", ("TargetRow",)),
        warehouse
    )


def collisions(new: DataFrame, existing: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Keys of ``new`` that ``existing`` has, and those that ``new`` has twice; nulls equal each other."""
    old = existing.select(*[F.col(k).alias(f"_{k}") for k in key])
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return new.select(*key).distinct().join(old, same, "left_semi"), ops.duplicate_keys(new, key)


def numeric_sums(before: DataFrame, after: DataFrame, mapping: Mapping) -> list[NumericCheck]:
    """Sums of the columns that became numbers, before and after their transform."""
    from ..functions.tokens import number

    kinds = dict(after.dtypes)
    pairs = [(c.source, c.target) for c in mapping.columns if kinds[c.target] in ("double", "bigint", "int", "float")]
    if not pairs:
        return []
    first = exact_sums(before, [number(ops._col(before, s)) for s, _ in pairs])
    second = exact_sums(after, [F.col(f"`{t}`") for _, t in pairs])
    return [NumericCheck(s, t, x.value, y.value) for (s, t), x, y in zip(pairs, first, second, strict=True)]


def table_of(target: str) -> str:
    return check_identifier(target.replace(".", "_"))


def _checked(frame: DataFrame, schema: T.StructType, targets: list[str]) -> DataFrame:
    fields = {f.name: f.dataType for f in schema.fields}
    unknown = [t for t in targets if t not in fields]
    if unknown:
        raise MirrorError(f"the target has no columns {unknown}")
    lost = frame.agg(
        *[F.count_if(F.col(t).isNotNull() & F.col(t).try_cast(fields[t]).isNull()).alias(t) for t in targets]
    ).first().asDict()
    if any(lost.values()):
        raise MirrorError(
            f"values that don't fit the target's types, by column: { {k: v for k, v in lost.items() if v} }"
        )
    return frame.select(*[F.col(t).try_cast(fields[t]).alias(t) for t in targets], ops.MARKER)


def mirror(
    spark: SparkSession, artifact_path: str | Path, source_file: str | Path, store: Store, dry_run: bool = True,
    now: dt.datetime | None = None
) -> MirrorResult:
    """Checks a file, reports what would be written and, unless ``dry_run``, writes it."""
    artifact = load_mapping_artifact(artifact_path)
    mapping = artifact.mapping
    data = Path(source_file).read_bytes()
    sheets = read_workbook(data)
    check = check_fingerprint(artifact.fingerprint, sheets)
    if not check.ok:
        raise FingerprintDrift(check)
    sheet = next(s for s in sheets if s.name == check.matched_sheet)
    header = artifact.fingerprint.header_row
    names = [text_of(sheet.value(header, c)) or f"column_{c}" for c in range(1, sheet.max_column + 1)]
    before = ops.promote_header(grid(spark, sheet), header, names).cache()
    missing = [c.source for c in mapping.columns if c.source not in names]
    if missing:
        raise MirrorError(f"the file has no columns {missing}")
    unmapped = [n for n in names if n not in {c.source for c in mapping.columns}]
    if unmapped and mapping.unmapped_source_columns == "fail":
        raise MirrorError(f"unmapped source columns: {unmapped}")
    after = crosswalk(before, mapping.columns).cache()
    fields = columns_of(artifact.target_row)
    targets = [c.target for c in mapping.columns]
    n = before.count()
    summary = dict(
        source_file=str(source_file), dry_run=dry_run, rows_in=n, rows_out=0 if dry_run else n,
        numeric_checks=numeric_sums(before, after, mapping), unmapped_source_columns=unmapped,
        unmapped_source_columns_action=mapping.unmapped_source_columns,
        target_columns_not_populated=[f for f in fields.names if f not in targets]
    )
    if mapping.excel_target:
        return _to_workbook(spark, artifact, after, dry_run, summary, now)
    table = table_of(mapping.target)
    rows = _checked(after, fields, targets)
    _refuse(*collisions(rows, store.mirrored(table, fields), mapping.key))
    if dry_run:
        return MirrorResult(True, None, range(0), Summary(target=table, **summary))
    run_id = store.register_run(mapping.target, "mirror")
    digest = store.register_raw_file(data, Path(source_file).name, run_id)
    ids = store.load_mirror_rows(table, fields, rows, run_id, digest, sheet.name, "mirror")
    return MirrorResult(False, run_id, ids, Summary(target=table, **summary))


def _refuse(existing: DataFrame, within: DataFrame) -> None:
    found = [ops.some_of(keys) for keys in (existing, within)]
    if any(n for _, n in found):
        raise MirrorDuplicateKeyError(*found)


def _same(value: Any) -> str | None:
    """Keys of a workbook and of a file are compared as text, whole floats as integers."""
    return None if value is None else str(int(value)) if isinstance(value, float) and value.is_integer() else text_of(value)


def _to_workbook(
    spark: SparkSession, artifact: MappingArtifact, after: DataFrame, dry_run: bool, summary: dict,
    now: dt.datetime | None
) -> MirrorResult:
    """Appends below the last filled row of the region. A workbook is one file, so its rows are written by the driver."""
    region, key = artifact.mapping.excel_target, artifact.mapping.key
    path = Path(region.path) if Path(region.path).is_absolute() else artifact.root / region.path
    book = read_workbook(str(path))
    check = check_fingerprint(artifact.warehouse, book)
    if not check.ok:
        raise FingerprintDrift(check)
    sheet: Sheet = next(s for s in book if s.name == check.matched_sheet)
    width, header = len(region.column_order), artifact.warehouse.header_row
    filled = [r for (r, c), v in sheet.cells.items() if c <= width and v is not None and r > header]
    last = max(filled, default=header)
    places = [region.column_order.index(k) + 1 for k in key]
    old = [tuple(_same(sheet.value(r, c)) for c in places) for r in range(header + 1, last + 1)]
    existing = spark.createDataFrame(old, ", ".join(f"{k} string" for k in key))
    _refuse(*collisions(after.select(*[F.col(k).cast("string").alias(k) for k in key]), existing, key))
    said = Summary(target=str(path), **summary)
    if dry_run:
        return MirrorResult(True, None, range(0), said)
    stamp = (now or dt.datetime.now(dt.UTC)).strftime("%Y%m%dT%H%M%SZ")
    backup = path.with_name(f"{path.stem}.{stamp}.bak{path.suffix}")
    shutil.copy2(path, backup)
    have = set(after.columns)
    rows = [[r[c] if c in have else None for c in region.column_order] for r in after.orderBy(ops.MARKER).collect()]
    append_rows(str(path), sheet, last + 1, 1, rows)
    return MirrorResult(False, None, range(0), said, backup)

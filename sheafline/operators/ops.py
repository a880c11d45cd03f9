"""The frame operators that transforms are written in.

Each takes and returns a DataFrame and keeps the row marker. A check of values runs
when its operator is called, as one job. Within ``deferred`` it becomes part of the
plan instead, so that any number of operators read their input once: a bad value
then ends the job that first computes the frame.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tokens import iso_date, number

MARKER = "_src_row"
VERIFICATIONS = ("VERIFIED", "TO_VERIFY", "DERIVED")
#: Offenders that an error names, at most; their number is exact.
NAMED = 100
#: Pairs of a mapping that become part of the plan; a larger mapping is joined.
LITERAL_PAIRS = 1_000

_deferred: ContextVar[bool] = ContextVar("deferred", default=False)


@contextmanager
def deferred() -> Iterator[None]:
    """In the block, checks of values are part of the plan and run with the first job that computes it."""
    token = _deferred.set(True)
    try:
        yield
    finally:
        _deferred.reset(token)


def listed(found: list, n: int) -> str:
    """Offenders as text; ``n`` of them, of which ``found`` are named."""
    return f"{found}" + (f" and {n - len(found)} more, {n} in all" if n > len(found) else "")


def some_of(df: DataFrame) -> tuple[list[tuple], int]:
    """Up to NAMED rows, sorted, and the number of all. A second job only counts where there are more."""
    rows = sorted((tuple(x) for x in df.limit(NAMED + 1).collect()), key=str)
    return rows[:NAMED], len(rows) if len(rows) <= NAMED else df.count()


def _name(df: DataFrame, column: str | int) -> str:
    return f"_c{column}" if isinstance(column, int) else column


def _col(df: DataFrame, column: str | int) -> Column:
    return df["`" + _name(df, column).replace("`", "``") + "`"]


def _checked(df: DataFrame, name: str, value: Column, bad: Column, what: str, source: Column, marker: str) -> DataFrame:
    """``df`` with the column ``name``; ``bad`` values are an error that shows one, the first in order of the marker unless deferred."""
    if not _deferred.get():
        found = df.where(bad).orderBy(marker).select(marker, source.cast("string")).limit(1).collect()
        if found:
            raise ValueError(f"column {name!r}: {what} {found[0][1]!r} at {marker}={found[0][0]}")
        return df.withColumn(name, value)
    shown = F.concat(
        F.lit("'"), F.coalesce(source.cast("string"), F.lit("null")), F.lit(f"' at {marker}="),
        F.col(marker).cast("string")
    )
    kind = df.select(value.alias("x")).schema[0].dataType
    error = F.raise_error(F.concat(F.lit(f"column {name!r}: {what} "), shown)).cast(kind)
    out = df.withColumn(name, F.when(bad, error).otherwise(value))
    # Later filters stay above the observation, so that rows they drop are checked, too, as without deferral.
    return out.observe(f"checked-{uuid.uuid4().hex}", F.count(_col(out, name)).alias("n"))


def promote_header(df: DataFrame, header_row: int, column_names: list[str], row_marker: str = MARKER) -> DataFrame:
    """Rows below ``header_row``, with names given by position."""
    columns = [c for c in df.columns if c != row_marker]
    if len(columns) != len(column_names):
        raise ValueError(f"{len(column_names)} column names for {len(columns)} columns")
    if len(set(column_names)) < len(column_names):
        raise ValueError(f"column names repeat: {sorted({c for c in column_names if column_names.count(c) > 1})}")
    names = iter(column_names)
    return df.where(F.col(row_marker) > header_row).toDF(*[c if c == row_marker else next(names) for c in df.columns])


def drop_empty(df: DataFrame, row_marker: str = MARKER) -> DataFrame:
    """Without rows in which all but the marker is null."""
    return df.dropna(how="all", subset=[c for c in df.columns if c != row_marker])


def coerce_numeric(
    df: DataFrame, column: str | int, allow_null: bool = False, scale: float = 1.0, row_marker: str = MARKER
) -> DataFrame:
    """Messy numbers become doubles, times ``scale``; what can't be read is null, or an error that names the first row."""
    source = _col(df, column)
    parsed = number(source)
    value = F.when(F.isnan(parsed), None).otherwise(parsed) * F.lit(float(scale))
    if allow_null:
        return df.withColumn(_name(df, column), value)
    return _checked(df, _name(df, column), value, parsed.isNull(), "unparseable value", source, row_marker)


def coerce_date(df: DataFrame, column: str | int, fmt: str | None = None, row_marker: str = MARKER) -> DataFrame:
    """Dates become ISO text; nulls stay, and a value that can't be read is an error."""
    source = _col(df, column)
    value = iso_date(source, fmt)
    return _checked(
        df, _name(df, column), value, value.isNull() & source.isNotNull(), "unparseable value", source, row_marker
    )


def select_sheet(sheets: dict[str, DataFrame], name: str) -> DataFrame:
    if name not in sheets:
        raise KeyError(f"no sheet {name!r}; available sheets: {sorted(sheets)}")
    return sheets[name]


def unpivot(
    df: DataFrame, id_vars: list[str], value_vars: list[str], var_name: str, value_name: str, row_marker: str = MARKER
) -> DataFrame:
    """A row for each row and value column; values of unlike types become text."""
    ids = [*id_vars, *([] if row_marker in id_vars else [row_marker])]
    types = {df.schema[c].dataType.simpleString() for c in value_vars}
    if len(types) > 1:
        df = df.withColumns({c: F.col(f"`{c}`").cast("string") for c in value_vars})
    return df.unpivot([F.col(f"`{c}`") for c in ids], [F.col(f"`{c}`") for c in value_vars], var_name, value_name)


def _plain_groups(pattern: str) -> bool:
    """Whether every group takes part in every match, and Java reads the pattern as Python does."""
    bare = re.sub(r"\[\^?\]?[^\]]*\]", "", re.sub(r"\\.", "", pattern))
    return "|" not in bare and not re.search(r"\)(\?|\*|\{0?,)", bare) and not re.search(r"\(\?(?!P<|:)", bare)


def split_column(df: DataFrame, column: str, into: list[str], pattern: str, row_marker: str = MARKER) -> DataFrame:
    """The groups of ``pattern``, searched in a column, take its place; a group that takes no part in a match is null.

    Patterns with alternatives or groups that may be left out are matched in Python, in
    Arrow batches, as Spark's own functions give an empty text for such a group.
    """
    compiled = re.compile(pattern)
    if compiled.groups != len(into):
        raise ValueError(f"pattern has {compiled.groups} capture groups for {len(into)} columns")
    source = _col(df, column).cast("string")
    if _plain_groups(pattern):
        java = re.sub(r"\(\?P<(\w+)>", r"(?<\1>", pattern)
        matched = F.coalesce(source.rlike(java), F.lit(False))
        parts = [F.regexp_extract(source, java, i + 1) for i in range(len(into))]
    else:

        def groups(texts: pd.Series) -> pd.Series:
            found = ((compiled.search(x) if x is not None else None) for x in texts)
            return pd.Series([None if m is None else list(m.groups()) for m in found], dtype=object)

        df = df.withColumn("__groups", F.pandas_udf(groups, T.ArrayType(T.StringType()))(source))
        matched, parts = F.col("__groups").isNotNull(), [F.col("__groups")[i] for i in range(len(into))]
    rows, n = some_of(df.where(~matched).select(row_marker).orderBy(row_marker))
    if rows:
        raise ValueError(
            f"column {column!r}: pattern did not match rows with {row_marker}={listed([x[0] for x in sorted(rows)], n)}"
        )
    named = [x.alias(name) for x, name in zip(parts, into, strict=True)]
    return df.select(*[x for c in df.columns if c != "__groups" for x in (named if c == column else [_col(df, c)])])


def map_values(df: DataFrame, column: str, mapping: dict, on_missing: str = "fail") -> DataFrame:
    """Values replaced through ``mapping``; others are kept, or are an error that lists them.

    A small mapping is part of the plan. A larger one is a table that is joined, and
    broadcast only as far as Spark knows it to be small.
    """
    if on_missing not in ("fail", "keep"):
        raise ValueError(f"on_missing is 'fail' or 'keep', not {on_missing!r}")
    source, name = _col(df, column), _name(df, column)
    if len(mapping) <= LITERAL_PAIRS:
        known = F.coalesce(source.isin(list(mapping)), F.lit(False)) if mapping else F.lit(False)
        pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]) if mapping else None
        mapped = F.element_at(pairs, source) if mapping else F.lit(None)
    else:
        table = df.sparkSession.createDataFrame(
            pd.DataFrame({"__from": list(mapping), "__to": list(mapping.values())})
        ).withColumn("__known", F.lit(True))
        df = df.join(table, source == table["__from"], "left").drop("__from")
        source, known, mapped = F.col(f"`{name}`"), F.coalesce("__known", F.lit(False)), F.col("__to")
    if on_missing == "fail":
        missing, n = some_of(df.where(~known).select(source).distinct())
        if missing:
            values = sorted((x[0] for x in missing), key=lambda x: (x is not None, str(x)))
            raise ValueError(f"column {column!r}: no mapping: {listed(values, n)}")
    if not mapping:
        return df
    return df.withColumn(
        name,
        mapped if on_missing == "fail" else F.when(known, mapped).otherwise(source)
    ).drop("__to", "__known")


def _typed(c: Column, kind: str, value: Any) -> Column:
    """Text is compared with a number as a number."""
    sample = value[0] if isinstance(value, (list, tuple)) and value else value
    return c.try_cast("double") if kind == "string" and isinstance(sample, (int, float)) and not isinstance(sample, bool) else c


def filter_rows(df: DataFrame, column: str, op: str, value: Any = None) -> DataFrame:
    """Rows for which the comparison holds. ``ne`` keeps nulls, all others but ``isna`` drop them."""
    source = _col(df, column)
    c = _typed(source, dict(df.dtypes)[_name(df, column)], value)
    tests = {
        "eq": lambda: c == value, "ne": lambda: ~c.eqNullSafe(F.lit(value)), "gt": lambda: c > value, "gte": lambda: c >= value, "lt": lambda: c < value, "lte": lambda: c <= value,
        "isin": lambda: c.isin(list(value)), "notna": source.isNotNull, "isna": source.isNull,
    }
    if op not in tests:
        raise ValueError(f"unknown op {op!r}; known: {sorted(tests)}")
    return df.where(tests[op]())


def duplicate_keys(df: DataFrame, columns: list[str]) -> DataFrame:
    """The keys that stand more than once; nulls equal each other."""
    return df.groupBy(*[_col(df, c) for c in columns]).count().where("count > 1").drop("count")


def assert_unique(df: DataFrame, columns: list[str]) -> DataFrame:
    keys, n = some_of(duplicate_keys(df, columns))
    if keys:
        raise ValueError(f"columns {columns} are not unique; duplicate keys: {listed(keys, n)}")
    return df


def tag_verification(df: DataFrame, value: str, column: str = "_verification") -> DataFrame:
    if value not in VERIFICATIONS:
        raise ValueError(f"verification {value!r} is none of {VERIFICATIONS}")
    return df.withColumn(column, F.lit(value))


def derive(df: DataFrame, column: str, expression: str) -> DataFrame:
    """Reserved: there is no expression grammar yet."""
    raise NotImplementedError("derive has no expression grammar yet")

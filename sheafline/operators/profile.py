"""Profiles of workbooks: header rows, column types, null rates, samples and smells.

Both aggregations run over the cell table, a row for each filled cell; only their
results, a row for each sheet row or column, come to the driver.
"""

from __future__ import annotations

import json
from itertools import combinations
from pathlib import Path

from pydantic import BaseModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tokens import smells
from ..sources.xlsx import Sheet, cell_table, read_workbook, text_of

SAMPLES = 5


class HeaderCandidate(BaseModel):
    row: int
    confidence: float


class ColumnProfile(BaseModel):
    position: int
    header_text: str | None
    inferred_type: str
    null_rate: float
    cardinality: int
    samples: list[str]
    smells: list[str]


class SheetProfile(BaseModel):
    name: str
    dimensions: str
    n_rows: int
    n_cols: int
    merged_cells: list[str]
    header_candidates: list[HeaderCandidate]
    columns: list[ColumnProfile]


class Profile(BaseModel):
    source_file: str
    sheets: list[SheetProfile]
    duplicate_headers: list[tuple[str, str]]


def row_counts(cells: DataFrame) -> DataFrame:
    """sheet, _src_row, filled, strings: how many cells of a row have a value, and text."""
    return cells.groupBy("sheet", "_src_row").agg(
        F.count(F.lit(1)).alias("filled"), F.count_if(F.col("kind") == "string").alias("strings")
    )


def header_scores(cells: DataFrame, width: int, height: int, density: float = 0.5, text: float = 0.5) -> DataFrame:
    """sheet, header_row, filled, below_filled, below_strings: the first row that is dense and mostly text.

    The row below scores it; a row without cells has none. The last row can't be a header.
    """
    counts = row_counts(cells)
    first = counts.where(
        (F.col("filled") >= density * width) & (F.col("strings") >= text * F.col("filled"))
        & (F.col("_src_row") < height)
    )
    first = first.groupBy("sheet").agg(F.min(F.struct("_src_row", "filled")).alias("at")).select(
        "sheet", F.col("at._src_row").alias("header_row"), F.col("at.filled").alias("filled")
    )
    below = counts.select(
        F.col("sheet").alias("_s"), (F.col("_src_row") - 1).alias("_r"), F.col("filled").alias("below_filled"),
        F.col("strings").alias("below_strings")
    )
    joined = first.join(below, (F.col("sheet") == F.col("_s")) & (F.col("header_row") == F.col("_r")), "left")
    return joined.select(
        "sheet", "header_row", "filled", F.coalesce("below_filled", F.lit(0)).alias("below_filled"),
        F.coalesce("below_strings", F.lit(0)).alias("below_strings")
    )


def column_stats(cells: DataFrame) -> DataFrame:
    """sheet, col, filled, kinds, cardinality, samples, smells of all cells of a column.

    Numbers and booleans that are equal count as one value; samples are the first
    distinct values in order of appearance.
    """
    same = F.when(F.col("kind") == "boolean", (F.lower("text") == "true").cast("double")).when(
        F.col("kind").isin("integer", "float"), F.col("text").try_cast("double")
    )
    value = F.when(
        same.isNotNull(), F.concat(F.lit("n"), same.cast("string"))
    ).otherwise(F.concat(F.substring("kind", 1, 1), F.col("text")))
    cells = cells.withColumn("_value", value).withColumn("_smells", smells(F.col("text"), F.col("kind")))
    values = cells.groupBy("sheet", "col", "_value").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("_src_row", "text")).alias("first"),
        F.collect_set("kind").alias("kinds"), F.flatten(F.collect_set("_smells")).alias("_smells")
    )
    place = F.row_number().over(Window.partitionBy("sheet", "col").orderBy("first"))
    return values.withColumn("_place", place).groupBy("sheet", "col").agg(
        F.sum("n").alias("filled"),
        F.array_distinct(F.flatten(F.collect_set("kinds"))).alias("kinds"),
        F.count(F.lit(1)).alias("cardinality"),
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("_place") <= SAMPLES, F.col("first")))), lambda x: x["text"]
        ).alias("samples"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("_smells")))).alias("smells"),
    )


def inferred_type(kinds: list[str]) -> str:
    return "empty" if not kinds else kinds[0] if len(kinds) == 1 else "mixed"


def duplicate_headers(headers: dict[str, list[str | None]]) -> list[tuple[str, str]]:
    """Pairs of sheets, by name, whose headers are the same."""
    return [(a, b) for a, b in combinations(sorted(headers), 2) if headers[a] == headers[b]]


def null_rate(rows: int, filled: int) -> float:
    """The share of a column's cells that are empty; 0 without rows."""
    return round((rows - filled) / rows, 4) if rows else 0.0


def confidence(filled: int, width: int, below_filled: int, below_strings: int) -> float:
    """How sure a header is: half by how much of the width it fills, half by how little of the row below is text."""
    below = (below_filled - below_strings) / below_filled if below_filled else 0.0
    return round(0.5 * filled / width + 0.5 * below, 4)


def detect_header(cells: DataFrame, width: int, height: int) -> list[HeaderCandidate]:
    """The header of the one sheet that ``cells`` has, if there is one."""
    found = header_scores(cells, width, height).first() if height > 1 else None
    if found is None:
        return []
    return [
        HeaderCandidate(
            row=found.header_row,
            confidence=confidence(found.filled, width, found.below_filled, found.below_strings)
        )
    ]


def column_profiles(cells: DataFrame, headers: dict[int, str | None], rows: int) -> list[ColumnProfile]:
    """A profile of each column in ``headers`` from the cells of the ``rows`` below the header."""
    stats = {x.col: x for x in column_stats(cells).collect()}
    out = []
    for position, text in headers.items():
        s = stats.get(position)
        if s is None:
            out.append(
                ColumnProfile(
                    position=position, header_text=text, inferred_type="empty", null_rate=null_rate(rows, 0),
                    cardinality=0, samples=[], smells=[]
                )
            )
            continue
        out.append(
            ColumnProfile(
                position=position, header_text=text, inferred_type=inferred_type(s.kinds), null_rate=null_rate(rows, s.filled),
                cardinality=s.cardinality, samples=s.samples, smells=s.smells,
            )
        )
    return out


def profile(spark: SparkSession, source: str | Path) -> Profile:
    """The profile of a workbook."""
    sheets = read_workbook(str(source))
    all_cells = cell_table(spark, sheets)
    out, headers = [], {}
    for sheet in sheets:
        cells = all_cells.where(F.col("sheet") == sheet.name)
        candidates = detect_header(cells, sheet.max_column, sheet.max_row)
        columns = []
        if candidates:
            header = candidates[0].row
            names = {c: text_of(sheet.value(header, c)) for c in range(1, sheet.max_column + 1)}
            columns = column_profiles(cells.where(F.col("_src_row") > header), names, sheet.max_row - header)
            headers[sheet.name] = [c.header_text for c in columns]
        out.append(
            SheetProfile(
                name=sheet.name, dimensions=sheet.dimensions, n_rows=sheet.max_row, n_cols=sheet.max_column,
                merged_cells=sheet.merges, header_candidates=candidates, columns=columns,
            )
        )
    return Profile(source_file=Path(source).name, sheets=out, duplicate_headers=duplicate_headers(headers))


def to_json(p: Profile) -> str:
    return json.dumps(p.model_dump(mode="json"), sort_keys=True, indent=2)

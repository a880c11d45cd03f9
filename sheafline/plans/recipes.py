"""Saved SQL recipes: typed parameters, a query, and the columns it promises."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from pathlib import Path
from typing import Any, Literal

import yaml
from pydantic import BaseModel, ValidationError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession


class RecipeLoadError(Exception):
    """A recipe file that can't be read, or isn't there."""


class QueryError(Exception):
    """A recipe that can't be run."""


class QueryParamError(QueryError):
    """Parameters that are missing, unknown or of the wrong type."""


class QueryShapeError(QueryError):
    """A result with other columns than the recipe promises."""


class RecipeParam(BaseModel):
    type: Literal["string", "integer", "float", "date", "boolean"]


class Recipe(BaseModel):
    name: str
    description: str = ""
    params: dict[str, RecipeParam] = {}
    expected_columns: list[str]
    sql: str


@dataclass(frozen=True)
class QueryResult:
    columns: list[str]
    rows: list[dict[str, Any]]


def load_recipe(path: str | Path) -> Recipe:
    """A file of YAML between lines of three dashes, then SQL."""
    try:
        text = Path(path).read_text()
    except OSError as e:
        raise RecipeLoadError(f"{path}: {e.strerror or e}") from None
    lines = text.splitlines(keepends=True)
    marks = [i for i, x in enumerate(lines) if x.strip() == "---"]
    if len(marks) < 2 or marks[0] != 0:
        raise RecipeLoadError(f"{path}: front matter must stand between two lines of '---' at the top")
    try:
        head = yaml.safe_load("".join(lines[1 : marks[1]])) or {}
        return Recipe.model_validate({**head, "sql": "".join(lines[marks[1] + 1 :])})
    except (yaml.YAMLError, ValidationError, TypeError) as e:
        raise RecipeLoadError(f"{path}: {e}") from None


def list_recipes(folder: str | Path) -> list[Recipe]:
    return [load_recipe(p) for p in sorted(Path(folder).rglob("*.sql"))]


def find_recipe(folder: str | Path, name: str) -> Recipe:
    found = next((r for r in list_recipes(folder) if r.name == name), None)
    if found is None:
        raise RecipeLoadError(f"no recipe named {name!r} in {folder}")
    return found


def _boolean(text: str) -> bool:
    known = {"true": True, "1": True, "false": False, "0": False}
    if text.strip().lower() not in known:
        raise ValueError(f"{text!r} is not a boolean; use true, false, 1 or 0")
    return known[text.strip().lower()]


def _date(text: str) -> str:
    dt.date.fromisoformat(text)
    return text


_READERS = {"string": str, "integer": int, "float": float, "boolean": _boolean, "date": _date}


def coerce_params(recipe: Recipe, given: dict[str, str]) -> dict[str, Any]:
    missing, extra = sorted(recipe.params.keys() - given), sorted(given.keys() - recipe.params.keys())
    if missing or extra:
        raise QueryParamError(
            f"recipe {recipe.name!r}: "
            + "; ".join(f"{what}: {names}" for what, names in (("missing", missing), ("unexpected", extra)) if names)
        )
    out = {}
    for name, text in given.items():
        try:
            out[name] = _READERS[recipe.params[name].type](text)
        except ValueError as e:
            raise QueryParamError(f"recipe {recipe.name!r}, param {name!r}: {e}") from None
    return out


def recipe_frame(spark: SparkSession, recipe: Recipe, given: dict[str, str] | None = None) -> DataFrame:
    """The recipe as a DataFrame. Parameters are bound, never spliced into the text; only queries run."""
    args = coerce_params(recipe, given or {})
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(recipe.sql)
        if "Command" in plan.getClass().getSimpleName() or plan.getClass().getSimpleName().startswith(
            ("Create", "Insert", "Drop", "Delete", "Update", "Merge", "Set", "Alter", "Truncate")
        ):
            raise QueryError(f"recipe {recipe.name!r} is not a query")
        frame = spark.sql(recipe.sql, args=args)
    except QueryError:
        raise
    except Exception as e:  # py4j wraps the parser's errors
        if isinstance(e, PySparkException) or "ParseException" in str(e):
            raise QueryError(f"recipe {recipe.name!r} failed: {e}") from None
        raise
    if frame.columns != recipe.expected_columns:
        raise QueryShapeError(
            f"recipe {recipe.name!r}: expected columns {recipe.expected_columns}, got {frame.columns}"
        )
    return frame


def run_recipe(spark: SparkSession, recipe: Recipe, given: dict[str, str] | None = None) -> QueryResult:
    frame = recipe_frame(spark, recipe, given)
    return QueryResult(frame.columns, [x.asDict() for x in frame.collect()])


def render_rows(result: QueryResult) -> str:
    if not result.rows:
        return "(no rows)"
    table = [result.columns, *([str(r[c]) for c in result.columns] for r in result.rows)]
    widths = [max(map(len, column)) for column in zip(*table, strict=True)]
    table.insert(1, ["-" * w for w in widths])
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(row, widths, strict=True)) for row in table)

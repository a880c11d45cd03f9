"""Rules that a transformed table has to meet.

All counts come from one aggregation, and sums from one of each side; the rows that
break a rule are fetched only if it is broken.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

from pydantic import BaseModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import number
from .ops import NAMED, duplicate_keys, listed, some_of


class RowCount(BaseModel):
    min: int | None = None
    max: int | None = None


class KeyUniqueness(BaseModel):
    columns: list[str]


class NullPolicy(BaseModel):
    column: str
    nulls_allowed: bool


class ValueRange(BaseModel):
    column: str
    min: float | None = None
    max: float | None = None


class SumPreservation(BaseModel):
    source_column: int
    target_column: str
    tolerance: float = 0.0


class Validations(BaseModel):
    row_count: RowCount | None = None
    key_uniqueness: list[KeyUniqueness] = []
    null_policy: list[NullPolicy] = []
    value_ranges: list[ValueRange] = []
    sum_preservation: list[SumPreservation] = []


@dataclass(frozen=True)
class Outcome:
    check_name: str
    status: str
    detail: str


@dataclass(frozen=True)
class Sum:
    """An exact sum of the finite values, and how many infinite ones there are of either sign."""

    finite: Fraction
    high: int = 0
    low: int = 0

    @property
    def value(self) -> float:
        if self.high or self.low:
            return float("nan") if self.high and self.low else float("inf") if self.high else float("-inf")
        try:
            return float(self.finite)
        except OverflowError:
            return float("inf") if self.finite > 0 else float("-inf")

    def apart(self, other: Sum) -> float:
        """The difference; infinite if the two don't have the same infinities."""
        if (self.high, self.low) != (other.high, other.low):
            return float("inf")
        return Sum(abs(self.finite - other.finite)).value


#: Powers of two that one bucket of a sum spans.
_SPAN = 32


def exact_sums(df: DataFrame, columns: list[Column]) -> list[Sum]:
    """The sum of each column as a double, exactly, in one aggregation; null and NaN count for nothing.

    A value is cut into whole numbers of a bucket of its magnitude, which Spark sums as
    decimals; the few buckets of a column are added up as fractions here.
    """
    if not columns:
        return []
    values = [F.struct(F.lit(i).alias("i"), c.cast("double").alias("x")) for i, c in enumerate(columns)]
    rows = df.select(F.explode(F.array(*values)).alias("v")).select("v.i", "v.x").where(
        "x IS NOT NULL AND NOT isnan(x) AND x <> 0"
    )
    infinite = F.abs("x") == float("inf")
    bucket = F.when(infinite, F.lit(1 << 20)).otherwise(F.floor(F.log2(F.abs("x")) / _SPAN)).cast("int")
    # Two factors, as one power of two alone may be beyond a double.
    half = F.pow(F.lit(2.0), -(_SPAN // 2) * F.col("b"))
    scaled = F.col("x") * half * half * float(1 << 20)
    whole = F.floor(scaled)
    rows = rows.withColumn("b", bucket).select(
        "i", "b",
        F.when(infinite, F.signum("x")).otherwise(whole).cast("bigint").alias("hi"),
        F.when(infinite, 0).otherwise((scaled - whole) * float(1 << 36)).cast("bigint").alias("lo")
    )
    found = rows.groupBy("i", "b", F.signum("hi").alias("sign")).agg(
        F.sum(F.col("hi").cast("decimal(38,0)")).alias("hi"), F.sum(F.col("lo").cast("decimal(38,0)")).alias("lo")
    )
    out = [Sum(Fraction(0))] * len(columns)
    for x in found.collect():
        old = out[x.i]
        if x.b == 1 << 20:
            out[x.i] = Sum(old.finite, old.high + max(0, int(x.hi)), old.low + max(0, -int(x.hi)))
        else:
            out[x.i] = Sum(
                old.finite + Fraction((int(x.hi) << 36) + int(x.lo)) * Fraction(2) ** (_SPAN * x.b - 56), old.high,
                old.low
            )
    return out


def _outside(rule: ValueRange):
    c = F.col(f"`{rule.column}`")
    return F.coalesce(
        (
            c < rule.min if rule.min is not None else F.lit(False)
        ) | (c > rule.max if rule.max is not None else F.lit(False)),
        F.lit(False)
    )


def run_validations(rules: Validations, raw: DataFrame, transformed: DataFrame) -> list[Outcome]:
    """An outcome for each rule: row count, keys, nulls, ranges, sums."""
    measures = [F.count(F.lit(1)).alias("rows")]
    measures += [F.count_if(F.col(f"`{r.column}`").isNull()).alias(f"null{i}") for i, r in enumerate(rules.null_policy)]
    measures += [F.count_if(_outside(r)).alias(f"out{i}") for i, r in enumerate(rules.value_ranges)]
    got = transformed.agg(*measures).first().asDict()
    out: list[Outcome] = []

    def say(name: str, good: bool, detail: str) -> None:
        out.append(Outcome(name, "PASS" if good else "FAIL", detail))

    n, bounds = got["rows"], rules.row_count or RowCount()
    if bounds.min is not None and n < bounds.min:
        say("row_count", False, f"{n} rows < minimum {bounds.min}")
    elif bounds.max is not None and n > bounds.max:
        say("row_count", False, f"{n} rows > maximum {bounds.max}")
    else:
        say("row_count", True, f"{n} rows within bounds")
    for rule in rules.key_uniqueness:
        keys, count = some_of(duplicate_keys(transformed, rule.columns))
        say(
            f"key_uniqueness:{','.join(rule.columns)}", not keys,
            f"duplicate keys: {listed(keys, count)}" if keys else "all keys unique"
        )
    for i, rule in enumerate(rules.null_policy):
        nulls = got[f"null{i}"]
        good = rule.nulls_allowed or not nulls
        say(f"null_policy:{rule.column}", good, f"{nulls} null value(s) found" + ("" if good else ", none allowed"))
    for i, rule in enumerate(rules.value_ranges):
        values = []
        if got[f"out{i}"]:
            bad = transformed.where(_outside(rule))
            if "_src_row" in transformed.columns:
                bad = bad.sort("_src_row")
            values = [x[0] for x in bad.select(f"`{rule.column}`").limit(NAMED).collect()]
        span = f"[{rule.min}, {rule.max}]"
        detail = f"out-of-range values (expected {span}): {listed(values, got[f'out{i}'])}" if values else f"all values within {span}"
        say(f"value_range:{rule.column}", not values, detail)
    sources = exact_sums(raw, [number(F.col(f"_c{r.source_column}")) for r in rules.sum_preservation])
    targets = exact_sums(transformed, [F.col(f"`{r.target_column}`") for r in rules.sum_preservation])
    for rule, source, target in zip(rules.sum_preservation, sources, targets, strict=True):
        diff = source.apart(target)
        good = diff <= rule.tolerance
        detail = f"source sum {source.value} matches target sum {target.value}"
        if not good:
            detail = f"source sum {source.value} vs target sum {target.value} (diff {diff} > tolerance {rule.tolerance})"
        if source.high or source.low or target.high or target.low:
            detail += f"; infinite values: {source.high + source.low} in the source, {target.high + target.low} in the target"
        say(f"sum_preservation:{rule.source_column}->{rule.target_column}", good, detail)
    return out

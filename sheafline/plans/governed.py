"""Queries over the driver's tables, one or more for each operator, and the same in SQL."""

from __future__ import annotations

import datetime as dt
import tempfile
from collections.abc import Callable
from pathlib import Path

from pydantic import create_model
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import normalized_name
from ..operators import ops
from ..operators.checks import KeyUniqueness, NullPolicy, Outcome, RowCount, SumPreservation, Validations, ValueRange, run_validations
from ..operators.crosswalk import ColumnMapping, Mapping, crosswalk, suggest
from ..operators.drift import SAMPLE_ROWS, Fingerprint, HeaderColumn, check_fingerprint, generate_fingerprint
from ..operators.profile import ColumnProfile, SheetProfile, column_profiles, column_stats, detect_header, header_scores
from ..operators.profile import duplicate_headers as same_headers
from ..operators.versions import Store, active_rows, columns_of, register_views, rows_as_of, sequenced, superseded
from ..sources.shared import new_path
from ..sources.xlsx import Sheet, append_rows, cell_table, grid, read_workbook, workbook_cells, write_workbook
from .artifact import value_differences
from .mirror import collisions, numeric_sums
from .recipes import Recipe, recipe_frame

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None, name: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _marked(df: DataFrame, key: str) -> DataFrame:
    """The table's own key is the source row."""
    return df.withColumn("_src_row", F.col(key).cast("bigint"))


# A messy text column, made from integers alike in both dialects.
_K = "CAST(o_orderkey % 1000 AS {s})"
_MESSY = "CASE o_orderkey % 6 WHEN 0 THEN concat('1,', lpad({k}, 3, '0')) WHEN 1 THEN concat('(', {k}, ')') WHEN 2 THEN concat({k}, '%') WHEN 3 THEN concat('(', {k}, '%)') WHEN 4 THEN concat('  ', {k}, ' ') ELSE {last} END"
_VALUE = "CASE o_orderkey % 6 WHEN 0 THEN 1000.0 + o_orderkey % 1000 WHEN 1 THEN -1.0 * (o_orderkey % 1000) WHEN 2 THEN CAST(o_orderkey % 1000 AS DOUBLE) / 100 WHEN 3 THEN -(CAST(o_orderkey % 1000 AS DOUBLE) / 100) WHEN 4 THEN CAST(o_orderkey % 1000 AS DOUBLE) ELSE {last} END"


def _messy(spark: SparkSession, sf_dir: str, last: str) -> DataFrame:
    text = _MESSY.format(k=_K.format(s="STRING"), last=last)
    return _marked(_t(spark, sf_dir, "orders"), "o_orderkey").select(
        "o_orderkey", F.expr(text).alias("amount"), "_src_row"
    )


@query(
    "SELECT o_orderkey AS order_key, o_custkey AS customer, o_orderkey AS _src_row FROM orders WHERE o_orderkey > 100"
)
def promote_header(spark, sf_dir):
    df = _marked(_t(spark, sf_dir, "orders"), "o_orderkey").select(
        F.col("o_orderkey").alias("_c0"), F.col("o_custkey").alias("_c1"), "_src_row"
    )
    return ops.promote_header(df, 100, ["order_key", "customer"])


@query(
    "SELECT * FROM (SELECT nullif(c_mktsegment, 'BUILDING') AS segment, CASE WHEN c_nationkey > 12 THEN c_nationkey "
    "END AS nation, c_custkey AS _src_row FROM customer) WHERE NOT (segment IS NULL AND nation IS NULL)"
)
def drop_empty(spark, sf_dir):
    df = _marked(_t(spark, sf_dir, "customer"), "c_custkey")
    return ops.drop_empty(
        df.select(
            F.expr("nullif(c_mktsegment, 'BUILDING')").alias("segment"),
            F.expr("CASE WHEN c_nationkey > 12 THEN c_nationkey END").alias("nation"), "_src_row"
        )
    )


@query("SELECT * FROM nation")
def select_sheet(spark, sf_dir):
    return ops.select_sheet({n: _t(spark, sf_dir, n) for n in ("region", "nation")}, "nation")


@query("SELECT *, 'DERIVED' AS _verification FROM region")
def tag_verification(spark, sf_dir):
    return ops.tag_verification(_t(spark, sf_dir, "region"), "DERIVED")


@query(
    f"SELECT o_orderkey, CAST({_VALUE.format(last='CAST(o_orderkey % 1000 AS DOUBLE)')} AS DOUBLE) AS amount, "
    f"o_orderkey AS _src_row FROM orders"
)
def coerce_numeric(spark, sf_dir):
    with ops.deferred():
        return ops.coerce_numeric(_messy(spark, sf_dir, _K.format(s="STRING")), "amount")


@query(f"SELECT o_orderkey, CAST({_VALUE.format(last='NULL')} AS DOUBLE) AS amount, o_orderkey AS _src_row FROM orders")
def coerce_numeric_allow_null(spark, sf_dir):
    return ops.coerce_numeric(_messy(spark, sf_dir, "'n/a'"), "amount", allow_null=True)


@query(
    f"SELECT o_orderkey, CAST({_VALUE.format(last='CAST(o_orderkey % 1000 AS DOUBLE)')} AS DOUBLE) * CAST(0.01 AS "
    f"DOUBLE) AS amount, o_orderkey AS _src_row FROM orders"
)
def coerce_numeric_scale(spark, sf_dir):
    with ops.deferred():
        return ops.coerce_numeric(_messy(spark, sf_dir, _K.format(s="STRING")), "amount", scale=0.01)


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderkey AS _src_row FROM orders")
def coerce_date_fmt(spark, sf_dir):
    df = _marked(_t(spark, sf_dir, "orders"), "o_orderkey").select(
        "o_orderkey", F.date_format("o_orderdate", "M/d/yyyy").alias("day"), "_src_row"
    )
    with ops.deferred():
        return ops.coerce_date(df, "day", fmt="%m/%d/%Y")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderkey AS _src_row FROM orders")
def coerce_date_serial(spark, sf_dir):
    df = _marked(_t(spark, sf_dir, "orders"), "o_orderkey").select(
        "o_orderkey",
        F.datediff(F.to_date("o_orderdate"), F.lit("1899-12-30").cast("date")).alias("day"), "_src_row"
    )
    with ops.deferred():
        return ops.coerce_date(df, "day")


@query(
    "SELECT p_brand, p_partkey AS _src_row, 'p_size' AS field, CAST(p_size AS BIGINT) AS v FROM part UNION ALL SELECT "
    "p_brand, p_partkey, 'twice', CAST(2 * p_size AS BIGINT) FROM part"
)
def unpivot(spark, sf_dir):
    df = _marked(_t(spark, sf_dir, "part"), "p_partkey").select(
        "p_brand", "_src_row", F.col("p_size").cast("bigint").alias("p_size"),
        (2 * F.col("p_size")).cast("bigint").alias("twice")
    )
    return ops.unpivot(df, ["p_brand"], ["p_size", "twice"], "field", "v")


@query(
    "SELECT regexp_extract(c_name, '(Customer)#(\\d+)', 1) AS kind, regexp_extract(c_name, '(Customer)#(\\d+)', 2) AS "
    "digits, c_custkey AS _src_row FROM customer"
)
def split_column(spark, sf_dir):
    return ops.split_column(
        _marked(_t(spark, sf_dir, "customer"), "c_custkey").select("c_name", "_src_row"), "c_name", ["kind", "digits"],
        r"(?P<kind>Customer)#(?P<digits>\d+)"
    )


@query(
    "SELECT CASE WHEN e_kind = 'buy' THEN 'buy' END AS buys, CASE WHEN e_kind <> 'buy' THEN e_kind END AS other, "
    "event_id AS _src_row FROM (SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'buy' ELSE 'see' END AS "
    "e_kind FROM events)"
)
def split_column_alternatives(spark, sf_dir):
    kind = F.when(F.col("event_type") == "purchase", "buy").otherwise("see")
    df = _marked(_t(spark, sf_dir, "events"), "event_id").select(kind.alias("kind"), "_src_row")
    return ops.split_column(df, "kind", ["buys", "other"], r"(buy)|(see)")


@query(
    "SELECT s_suppkey, CASE WHEN s_suppkey <= 5000 THEN concat('number ', s_suppkey) ELSE CAST(s_suppkey AS VARCHAR) "
    "END AS key FROM supplier"
)
def map_values_join(spark, sf_dir):
    """A mapping too large for the plan is a table that is joined."""
    mapping = {str(i): f"number {i}" for i in range(5_001)}
    df = _t(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_suppkey").cast("string").alias("key"))
    return ops.map_values(df, "key", mapping, on_missing="keep")


@query(
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE 'partial' END AS "
    "o_orderstatus FROM orders"
)
def map_values_fail(spark, sf_dir):
    return ops.map_values(
        _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus",
        {"O": "open", "F": "filled", "P": "partial"}
    )


@query(
    "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'B' ELSE c_mktsegment END AS c_mktsegment FROM customer"
)
def map_values_keep(spark, sf_dir):
    return ops.map_values(
        _t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", {"BUILDING": "B"},
        on_missing="keep"
    )


_SIZES = "(SELECT p_partkey, nullif(p_size, 7) AS size FROM part)"
for _op, _arg, _test in (
    ("eq", 5, "size = 5"), ("ne", 5, "size IS DISTINCT FROM 5"), ("gt", 40, "size > 40"), ("gte", 40, "size >= 40"),
    ("lt", 9, "size < 9"), ("lte", 9, "size <= 9"), ("isin", [1, 2, 3], "size IN (1, 2, 3)"),
    ("notna", None, "size IS NOT NULL"), ("isna", None, "size IS NULL")
):
    query(f"SELECT * FROM {_SIZES} WHERE {_test}", f"filter_{_op}")(
        lambda spark, sf_dir, op=_op, arg=_arg: ops.filter_rows(
            _t(spark, sf_dir, "part").select("p_partkey", F.expr("nullif(p_size, 7)").alias("size")), "size", op, arg
        )
    )


@query("SELECT o_orderkey, o_custkey FROM orders")
def assert_unique(spark, sf_dir):
    return ops.assert_unique(_t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return ops.duplicate_keys(_t(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


_RULES = {
    "row_count": (
        Validations(row_count=RowCount(min=1, max=10)),
        "CASE WHEN count(*) BETWEEN 1 AND 10 THEN 'PASS' ELSE 'FAIL' END"
    ),
    "key": (
        Validations(key_uniqueness=[KeyUniqueness(columns=["o_orderkey"])]),
        "CASE WHEN count(*) = count(DISTINCT o_orderkey) THEN 'PASS' ELSE 'FAIL' END"
    ),
    "null": (
        Validations(null_policy=[NullPolicy(column="open_only", nulls_allowed=False)]),
        "CASE WHEN count(*) FILTER (o_orderstatus <> 'O') = 0 THEN 'PASS' ELSE 'FAIL' END"
    ),
    "range": (
        Validations(value_ranges=[ValueRange(column="o_totalprice", min=0)]),
        "CASE WHEN min(o_totalprice) >= 0 THEN 'PASS' ELSE 'FAIL' END"
    ),
    "sum": (
        Validations(sum_preservation=[SumPreservation(source_column=0, target_column="o_orderkey")]),
        "CASE WHEN sum(CAST(CAST(o_orderkey AS VARCHAR) AS DOUBLE)) = sum(o_orderkey) THEN 'PASS' ELSE 'FAIL' END"
    ),
}
_CHECKED = {
    "row_count": "row_count", "key": "key_uniqueness:o_orderkey", "null": "null_policy:open_only",
    "range": "value_range:o_totalprice", "sum": "sum_preservation:0->o_orderkey"
}
for _name, (_rules, _sql) in _RULES.items():

    def _validation(spark, sf_dir, rules=_rules, name=_name):
        orders = _t(spark, sf_dir, "orders").withColumn("open_only", F.when(F.col("o_orderstatus") == "O", "O"))
        out = run_validations(rules, orders.select(F.col("o_orderkey").cast("string").alias("_c0")), orders)
        return spark.createDataFrame(
            [(o.check_name, o.status) for o in out if o.check_name == _CHECKED[name]],
            "check_name string, status string"
        )

    query(f"SELECT '{_CHECKED[_name]}' AS check_name, {_sql} AS status FROM orders", f"validation_{_name}")(_validation)


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer table as a sheet: a text header above rows by key."""
    c = _t(spark, sf_dir, "customer")
    at = (F.col("c_custkey") + 10).cast("int")
    cols = [
        (1, "integer", F.col("c_custkey")), (2, "string", F.col("c_name")),
        (3, "integer", F.expr("nullif(c_nationkey, 3)")),
        (4, "string", F.expr("concat(CAST(c_custkey % 7 AS STRING), '%')"))
    ]
    body = c.select(
        at.alias("_src_row"),
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(i).alias("col"), F.lit(k).alias("kind"), v.cast("string").alias("text"))
                    for i, k, v in cols
                ]
            )
        ).alias("x")
    ).select("_src_row", "x.*").where("text IS NOT NULL")
    head = spark.createDataFrame(
        [(5, i, "string", n) for i, n in enumerate(("key", "name", "nation", "share"), 1)],
        "_src_row int, col int, kind string, text string"
    )
    banner = spark.createDataFrame([(1, 1, "string", "Customers")], head.schema)
    return body.unionByName(head).unionByName(banner).select(
        F.lit("customer").alias("sheet"), "_src_row", "col", "kind", "text"
    )


_CELLS_SQL = """WITH body AS (
  SELECT c_custkey + 10 AS r, 1 AS col, 'integer' AS kind, CAST(c_custkey AS VARCHAR) AS t FROM customer
  UNION ALL SELECT c_custkey + 10, 2, 'string', c_name FROM customer
  UNION ALL SELECT c_custkey + 10, 3, 'integer', CAST(nullif(c_nationkey, 3) AS VARCHAR) FROM customer
  UNION ALL SELECT c_custkey + 10, 4, 'string', concat(CAST(c_custkey % 7 AS VARCHAR), '%') FROM customer), cells AS (SELECT * FROM body WHERE t IS NOT NULL)"""


@query(
    _CELLS_SQL
    + " SELECT CAST(col AS INTEGER) AS col, count(*) AS filled, CASE WHEN count(DISTINCT kind) = 1 THEN min(kind) ELSE 'mixed' END AS inferred_type, count(DISTINCT t) AS cardinality FROM cells GROUP BY col"
)
def profile_columns(spark, sf_dir):
    stats = column_stats(_cells(spark, sf_dir).where("_src_row > 5"))
    return stats.select(
        "col", "filled",
        F.when(F.size("kinds") == 1, F.col("kinds")[0]).otherwise("mixed").alias("inferred_type"), "cardinality"
    )


@query(
    _CELLS_SQL
    + ", d AS (SELECT col, t, min(r) AS r FROM cells GROUP BY col, t), o AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY r, t) AS n FROM d) SELECT CAST(col AS INTEGER) AS col, CAST(n AS INTEGER) AS place, t AS sample FROM o WHERE n <= 5"
)
def profile_samples(spark, sf_dir):
    stats = column_stats(_cells(spark, sf_dir).where("_src_row > 5"))
    return stats.select(
        "col", F.posexplode("samples").alias("at", "sample")
    ).select("col", (F.col("at") + 1).alias("place"), "sample")


@query(
    "SELECT CAST(3 AS INTEGER) AS col, 'date_serial_suspect' AS smell WHERE false UNION ALL SELECT 4, "
    "'percent_string' UNION ALL SELECT 1, 'date_serial_suspect' FROM customer WHERE c_custkey BETWEEN 20000 AND 60000 "
    "GROUP BY 1, 2 ORDER BY 1"
)
def column_smells(spark, sf_dir):
    return column_stats(_cells(spark, sf_dir).where("_src_row > 5")).select("col", F.explode("smells").alias("smell"))


@query(
    "SELECT 'customer' AS sheet, CAST(5 AS INTEGER) AS header_row, CAST(4 AS BIGINT) AS filled, CAST(0 AS BIGINT) AS "
    "below_filled, CAST(0 AS BIGINT) AS below_strings"
)
def header_score(spark, sf_dir):
    return header_scores(_cells(spark, sf_dir), 4, 1 << 20).select(
        "sheet", "header_row",
        *[F.col(c).cast("bigint").alias(c) for c in ("filled", "below_filled", "below_strings")]
    )


@query("SELECT 5 AS header_row, CAST(round(0.5 * 4 / 4.0 + 0.5 * 0.0, 4) AS DOUBLE) AS confidence")
def header_confidence(spark, sf_dir):
    found = detect_header(_cells(spark, sf_dir), 4, 1 << 20)
    return spark.createDataFrame([(x.row, x.confidence) for x in found], "header_row int, confidence double")


@query(
    "SELECT 'nation' AS header, round(count(*) FILTER (c_nationkey = 3) / count(*), 4) AS null_rate FROM customer "
    "UNION ALL SELECT 'key', 0.0 UNION ALL SELECT 'nothing', 1.0"
)
def null_rates(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer").count()
    found = column_profiles(_cells(spark, sf_dir).where("_src_row > 5"), {1: "key", 3: "nation", 9: "nothing"}, rows)
    return spark.createDataFrame([(c.header_text, c.null_rate) for c in found], "header string, null_rate double")


def _sheet(name: str, header: list[str], rows: list[tuple]) -> Sheet:
    cells = {(1, c): text for c, text in enumerate(header, 1)}
    cells |= {(r, c): v for r, row in enumerate(rows, 2) for c, v in enumerate(row, 1)}
    return Sheet(name, cells)


# The first parts as a sheet: sizes above 25 are numbers, the others text. A fingerprint samples 20 rows; that is its feature.
_SAMPLED = f"SELECT *, CASE WHEN p_size > 25 THEN 'integer' ELSE 'string' END AS kind FROM part ORDER BY p_partkey LIMIT {SAMPLE_ROWS}"
_DOMINANT = f"(SELECT kind FROM ({_SAMPLED}) GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 1)"


def _parts_sheet(spark: SparkSession, sf_dir: str) -> Sheet:
    rows = _t(spark, sf_dir, "part").orderBy("p_partkey").select("p_partkey", "p_size").limit(SAMPLE_ROWS).collect()
    return _sheet(
        "parts", ["key", "size"],
        [(x.p_partkey, x.p_size if x.p_size > 25 else f"size {x.p_size}") for x in rows]
    )


@query(f"SELECT 'key' AS col, 'integer' AS kind UNION ALL SELECT 'size', {_DOMINANT}")
def fingerprint_types(spark, sf_dir):
    found = generate_fingerprint([_parts_sheet(spark, sf_dir)], "parts", 1)
    return spark.createDataFrame([(c.name, c.type) for c in found.columns], "col string, kind string")


@query(
    f"SELECT 'header_text_mismatch' AS kind, 1 AS col, 'number' AS expected, 'key' AS found UNION ALL SELECT "
    f"'column_type_mismatch', 2, 'float', {_DOMINANT} UNION ALL SELECT 'sheet_position_mismatch', NULL, 'position 0', "
    f"'position 1'"
)
def drift_differences(spark, sf_dir):
    columns = [HeaderColumn(name="number", type="integer"), HeaderColumn(name="size", type="float")]
    wanted = Fingerprint(sheet="par.*", sheet_is_regex=True, sheet_index=0, header_row=1, columns=columns)
    found = check_fingerprint(wanted, [_sheet("cover", ["x"], []), _parts_sheet(spark, sf_dir)])
    return spark.createDataFrame(
        [(d.kind, d.column_position, d.expected, d.found) for d in found.differences],
        "kind string, col int, expected string, found string"
    )


@query(
    "WITH h(sheet, header) AS (SELECT 'nation', list(n_name ORDER BY n_nationkey) FROM nation UNION ALL SELECT "
    "'copy', list(n_name ORDER BY n_nationkey) FROM nation UNION ALL SELECT 'region', list(r_name ORDER BY "
    "r_regionkey) FROM region) SELECT a.sheet AS first_sheet, b.sheet AS second_sheet FROM h a JOIN h b ON a.header = "
    "b.header AND a.sheet < b.sheet"
)
def duplicate_headers(spark, sf_dir):
    nations = [x.n_name for x in _t(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]
    regions = [x.r_name for x in _t(spark, sf_dir, "region").orderBy("r_regionkey").collect()]
    return spark.createDataFrame(
        same_headers({"nation": nations, "copy": list(nations), "region": regions}),
        "first_sheet string, second_sheet string"
    )


# The nations as a workbook: written, read back, appended to.
_NATIONS = ["n_nationkey", "n_name", "n_regionkey"]


def _workbook(spark: SparkSession, sf_dir: str, folder: str) -> str:
    """A workbook is one file on the driver, as users hand it over."""
    rows = [list(x) for x in _t(spark, sf_dir, "nation").select(*_NATIONS).orderBy("n_nationkey").collect()]
    path = str(Path(folder) / "nations.xlsx")
    write_workbook(path, {"Nations": [_NATIONS, *rows], "Notes": [["kept"]]}, {"Nations": ["E1:F1"]})
    return path


@query(
    "SELECT 'n_nationkey' AS _c0, 'n_name' AS _c1, 'n_regionkey' AS _c2, CAST(1 AS INTEGER) AS _src_row UNION ALL "
    "SELECT CAST(n_nationkey AS VARCHAR), n_name, CAST(n_regionkey AS VARCHAR), CAST(n_nationkey + 2 AS INTEGER) FROM "
    "nation"
)
def workbook_grid(spark, sf_dir):
    with tempfile.TemporaryDirectory() as folder:
        return grid(spark, read_workbook(_workbook(spark, sf_dir, folder))[0])


@query(
    "SELECT 'Nations' AS sheet, CAST(1 AS INTEGER) AS col, 'integer' AS kind, count(*) AS n FROM nation UNION ALL "
    "SELECT 'Nations', 2, 'string', count(*) FROM nation UNION ALL SELECT 'Nations', 3, 'integer', count(*) FROM "
    "nation UNION ALL SELECT 'Nations', unnest([1, 2, 3]), 'string', 1 UNION ALL SELECT 'Notes', 1, 'string', 1"
)
def workbook_cells_by_kind(spark, sf_dir):
    with tempfile.TemporaryDirectory() as folder:
        cells = cell_table(spark, read_workbook(_workbook(spark, sf_dir, folder)))
    header = F.when(F.col("_src_row") == 1, "header").otherwise("body")
    return cells.groupBy("sheet", "col", "kind", header.alias("part")).count().select(
        "sheet", "col", "kind", F.col("count").alias("n")
    )


@query(
    "SELECT 'nations' AS book, 'Nations' AS sheet, 3 * (count(*) + 1) AS cells FROM nation UNION ALL SELECT "
    "'nations', 'Notes', 1 UNION ALL SELECT 'regions', 'Regions', 2 * count(*) FROM region"
)
def workbook_scan(spark, sf_dir):
    """Many workbooks, each read by a task of its own."""
    folder = new_path(spark, "books")
    with tempfile.TemporaryDirectory() as here:
        books = {"nations": _workbook(spark, sf_dir, here), "regions": str(Path(here) / "regions.xlsx")}
        rows = [list(x) for x in _t(spark, sf_dir, "region").select("r_regionkey", "r_name").collect()]
        write_workbook(books["regions"], {"Regions": rows})
        store = Store(spark, folder)
        named = {store.register_raw_file(Path(path).read_bytes(), name, 1): name for name, path in books.items()}
    cells = workbook_cells(spark, f"{folder}/raw/*")
    names = spark.createDataFrame(list(named.items()), "sha256 string, book string")
    digest = F.element_at(F.split("path", "/"), -1)
    return cells.join(
        F.broadcast(names), digest == names["sha256"]
    ).groupBy("book", "sheet").agg(F.count("*").alias("cells"))


@query(
    "SELECT CAST(n_nationkey AS VARCHAR) AS _c0, n_name AS _c1, CAST(n_nationkey + 2 AS INTEGER) AS _src_row FROM "
    "nation UNION ALL SELECT CAST(100 + r_regionkey AS VARCHAR), r_name, CAST(r_regionkey + 2 + (SELECT count(*) FROM "
    "nation) AS INTEGER) FROM region"
)
def workbook_append(spark, sf_dir):
    with tempfile.TemporaryDirectory() as folder:
        path = _workbook(spark, sf_dir, folder)
        sheet = read_workbook(path)[0]
        rows = [[100 + x.r_regionkey, x.r_name] for x in _t(spark, sf_dir, "region").orderBy("r_regionkey").collect()]
        append_rows(path, sheet, sheet.max_row + 1, 1, rows)
        return grid(spark, read_workbook(path)[0]).where("_src_row > 1").select("_c0", "_c1", "_src_row")


# Orders as three runs: the version of a customer's row that comes next supersedes it.
_LOG = "(SELECT o_orderkey AS row_id, o_custkey, o_totalprice, o_orderkey % 3 + 1 AS _run_id, lead(o_orderkey % 3 + 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS _superseded_by_run_id FROM orders)"


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _t(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"), "o_custkey", "o_totalprice", (F.col("o_orderkey") % 3 + 1).alias("_run_id")
    )
    return superseded(log, ["o_custkey"])


@query(f"SELECT * FROM {_LOG} WHERE _superseded_by_run_id IS NULL")
def scd_active(spark, sf_dir):
    return active_rows(_versions(spark, sf_dir))


@query(f"SELECT * FROM {_LOG}")
def scd_superseded(spark, sf_dir):
    return _versions(spark, sf_dir)


@query(f"SELECT * FROM {_LOG} WHERE _run_id <= 2 AND (_superseded_by_run_id IS NULL OR _superseded_by_run_id > 2)")
def scd_as_of(spark, sf_dir):
    return rows_as_of(_versions(spark, sf_dir), 2)


# Customers are loaded whole, and those of one segment again with twice the balance.
_Account = create_model(
    "Account", key=(int, ...), segment=(str, ...), balance=(float | None, None), opened=(dt.date | None, None)
)
_ACCOUNTS = """
WITH first AS (SELECT row_number() OVER (ORDER BY c_custkey) AS row_id, c_custkey AS key, c_mktsegment AS segment, c_acctbal AS balance, 1 AS run FROM customer),
     again AS (SELECT (SELECT count(*) FROM customer) + row_number() OVER (ORDER BY c_custkey) AS row_id, c_custkey AS key, c_mktsegment AS segment, 2 * c_acctbal AS balance, 2 AS run FROM customer WHERE c_mktsegment = 'BUILDING'),
     log AS (SELECT * FROM first UNION ALL SELECT * FROM again),
     versions AS (SELECT row_id, key, segment, balance, CAST(NULL AS VARCHAR) AS opened, 'TO_VERIFY' AS _verification, CAST(run AS BIGINT) AS _run_id, CAST(lead(run) OVER (PARTITION BY key ORDER BY row_id) AS BIGINT) AS _superseded_by_run_id FROM log)
"""


def _loaded(spark: SparkSession, sf_dir: str, final: bool = True) -> Store:
    """A store with two runs of accounts, as versions of their keys or as plain rows."""
    store, columns = Store(spark, new_path(spark, "store")), columns_of(_Account)
    rows = _marked(_t(spark, sf_dir, "customer"), "c_custkey").select(
        F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"),
        F.lit(None).cast("string").alias("opened"), "_src_row"
    )
    for n, part in enumerate((rows, rows.where("segment = 'BUILDING'").withColumn("balance", 2 * F.col("balance"))), 1):
        run = store.register_run("accounts", f"v{n}", dt.date(2024, 1, n))
        digest = store.register_raw_file(f"file {n}".encode(), f"accounts{n}.xlsx", run)
        if final:
            store.load_final_rows("accounts", columns, ["key"], part, run, digest, "Accounts", f"v{n}")
        else:
            store.load_mirror_rows("accounts", columns, part.drop("opened"), run, digest, "Accounts", f"v{n}")
        store.record_validation_results(run, [Outcome("row_count", "PASS", f"run {n}")])
    return store


@query(_ACCOUNTS + "SELECT * FROM versions")
def store_final_rows(spark, sf_dir):
    return _loaded(spark, sf_dir).final("accounts", columns_of(_Account), ["key"])


@query(_ACCOUNTS + "SELECT row_id, key, segment, balance, opened, _run_id FROM versions")
def store_mirror_rows(spark, sf_dir):
    return _loaded(spark, sf_dir, final=False).mirrored("accounts", columns_of(_Account))


@query(
    _ACCOUNTS
    + "SELECT row_id, key, sha256('file ' || _run_id) AS file_sha256, 'Accounts' AS sheet, CAST(key AS INTEGER) AS start_row, CAST(key AS INTEGER) AS end_row, 'v' || _run_id AS pipeline_version FROM versions WHERE _superseded_by_run_id IS NULL"
)
def lineage_join(spark, sf_dir):
    store = _loaded(spark, sf_dir)
    rows = store.with_lineage(active_rows(store.final("accounts", columns_of(_Account), ["key"])), "accounts")
    return rows.select("row_id", "key", "file_sha256", "sheet", "start_row", "end_row", "pipeline_version")


@query(
    "SELECT CAST(r AS BIGINT) AS run_id, 'accounts' AS name, 'v' || r AS version, '2024-01-0' || r AS as_of, "
    "sha256('file ' || r) AS sha256, 'accounts' || r || '.xlsx' AS original_name, 'PASS' AS status, 'run ' || r AS "
    "detail FROM (VALUES (1), (2)) v(r)"
)
def store_registers(spark, sf_dir):
    store = _loaded(spark, sf_dir)
    files = store.raw_files().select("run_id", "sha256", "original_name")
    checks = store.meta("validation_results").select("run_id", "status", "detail")
    return store.meta("runs").join(files, "run_id").join(checks, "run_id")


@query(
    _ACCOUNTS
    + "SELECT segment, count(*) AS n, count(*) FILTER (_superseded_by_run_id IS NULL) AS active FROM versions GROUP BY segment"
)
def store_views(spark, sf_dir):
    register_views(_loaded(spark, sf_dir))
    sql = "SELECT segment, count(*) AS n, count_if(_superseded_by_run_id IS NULL) AS active FROM accounts GROUP BY segment"
    return recipe_frame(spark, Recipe(name="views", expected_columns=["segment", "n", "active"], sql=sql))


@query("SELECT 100 + row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS id, o_orderkey, o_orderdate FROM orders")
def sequence_ids(spark, sf_dir):
    return sequenced(
        _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 100, "id",
        new_path(spark, "ids")
    )


@query(
    "SELECT * FROM (VALUES ('key', 'bigint'), ('segment', 'string'), ('balance', 'double'), ('opened', 'string')) "
    "v(name, type)"
)
def schema_columns(spark, sf_dir):
    return spark.createDataFrame(
        [(f.name, f.dataType.simpleString()) for f in columns_of(_Account).fields], "name string, type string"
    )


_MAPPING = Mapping(
    target="port.lots", key=["lot_no"],
    columns=[
        ColumnMapping(source="c_name", target="lot_no", basis="exact"),
        ColumnMapping(source="share", target="rate", transform="coerce_numeric(scale=0.01)", basis="synonym")
    ]
)


def _lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(_t(spark, sf_dir, "customer"), "c_custkey").select(
        "c_name", F.expr("CAST(c_custkey % 9 AS STRING)").alias("share"), "c_mktsegment", "_src_row"
    )


@query(
    "SELECT c_name AS lot_no, CAST(c_custkey % 9 AS DOUBLE) * CAST(0.01 AS DOUBLE) AS rate, c_custkey AS _src_row "
    "FROM customer"
)
def mirror_crosswalk(spark, sf_dir):
    return crosswalk(_lots(spark, sf_dir), _MAPPING.columns)


@query(
    "SELECT 'share' AS source_column, 'rate' AS target_column, CAST(sum(c_custkey % 9) AS DOUBLE) AS source_sum, "
    "round(CAST(sum(c_custkey % 9) AS DOUBLE) / 100, 6) AS target_sum FROM customer"
)
def mirror_sums(spark, sf_dir):
    before = _lots(spark, sf_dir)
    found = numeric_sums(before, crosswalk(before, _MAPPING.columns), _MAPPING)
    return spark.createDataFrame(
        [(c.source_column, c.target_column, c.source_sum, round(c.target_sum, 6)) for c in found],
        "source_column string, target_column string, source_sum double, target_sum double"
    )


@query(
    "SELECT DISTINCT nullif(o_custkey, 7) AS k FROM orders INTERSECT SELECT DISTINCT nullif(c_custkey, 7) FROM customer"
)
def mirror_collisions_existing(spark, sf_dir):
    """All keys of both tables; nulls, made of one key, equal each other."""
    new = _t(spark, sf_dir, "orders").select(F.expr("nullif(o_custkey, 7)").alias("k"))
    old = _t(spark, sf_dir, "customer").select(F.expr("nullif(c_custkey, 7)").alias("k"))
    return collisions(new, old, ["k"])[0]


@query("SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1")
def mirror_collisions_batch(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders")
    return collisions(orders, orders.limit(0), ["o_custkey"])[1]


_HEADERS = ["Lot No.", "Duty (%)", "Landed-On", "Carrier", "Remarks"]
_FIELDS = ["lot_no", "duty_rate", "landed_on", "haulier"]


def _suggested(spark: SparkSession, synonyms: dict[str, str]) -> DataFrame:
    columns = [
        ColumnProfile(
            position=i, header_text=h, inferred_type="string", null_rate=0, cardinality=0, samples=[], smells=[]
        )
        for i, h in enumerate(_HEADERS, 1)
    ]
    sheet = SheetProfile(
        name="s", dimensions="A1:E1", n_rows=1, n_cols=5, merged_cells=[], header_candidates=[], columns=columns
    )
    draft, _ = suggest(sheet, _FIELDS, target="t", key=["lot_no"], synonyms=synonyms)
    return spark.createDataFrame(
        [(c.source, c.target, c.basis) for c in draft.columns], "source string, target string, basis string"
    )


_VALUES = "(VALUES " + ", ".join(f"('{h}')" for h in _HEADERS) + ") h(source)"
_FIELD_VALUES = "(VALUES " + ", ".join(f"('{f}')" for f in _FIELDS) + ") f(target)"
_NORMAL = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@query(
    f"SELECT source, target, 'exact' AS basis FROM {_VALUES} JOIN {_FIELD_VALUES} ON {_NORMAL.format('source')} = "
    f"{_NORMAL.format('target')}"
)
def suggest_exact(spark, sf_dir):
    return _suggested(spark, {})


@query(
    f"SELECT source, target, 'exact' AS basis FROM {_VALUES} JOIN {_FIELD_VALUES} ON {_NORMAL.format('source')} = "
    f"{_NORMAL.format('target')} UNION ALL SELECT 'Duty (%)', 'duty_rate', 'synonym' UNION ALL SELECT 'Carrier', "
    f"'haulier', 'synonym'"
)
def suggest_synonym(spark, sf_dir):
    return _suggested(spark, {"duty": "duty_rate", "carrier": "haulier", "remarks": "nothing"})


@query(f"SELECT p_partkey, {_NORMAL.format('p_type')} AS plain FROM part")
def normalize_names(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", normalized_name(F.col("p_type")).alias("plain"))


@query(
    "WITH a AS (SELECT n_nationkey, nullif(n_name, 'FRANCE') AS n_name, CASE WHEN n_nationkey % 5 = 0 THEN 99 ELSE "
    "n_regionkey END AS n_regionkey FROM nation) SELECT g.n_nationkey, 'n_name' AS column_name, g.n_name AS golden, "
    "a.n_name AS actual FROM nation g JOIN a USING (n_nationkey) WHERE g.n_name IS DISTINCT FROM a.n_name UNION ALL "
    "SELECT g.n_nationkey, 'n_regionkey', CAST(g.n_regionkey AS VARCHAR), CAST(a.n_regionkey AS VARCHAR) FROM nation "
    "g JOIN a USING (n_nationkey) WHERE g.n_regionkey IS DISTINCT FROM a.n_regionkey"
)
def golden_value_diff(spark, sf_dir):
    golden = _t(spark, sf_dir, "nation")
    actual = golden.select(
        "n_nationkey", F.expr("nullif(n_name, 'FRANCE')").alias("n_name"),
        F.expr("CASE WHEN n_nationkey % 5 = 0 THEN 99 ELSE n_regionkey END").alias("n_regionkey")
    )
    return value_differences(actual, golden, "n_nationkey")


def _recipe(
    name: str, sql: str, columns: list[str], params: dict[str, tuple[str, str]] | None = None, oracle: str | None = None
):
    """A recipe over views of the driver's tables, run with the given parameters."""
    recipe = Recipe(
        name=name,
        params={k: {"type": kind} for k, (kind, _) in (params or {}).items()}, expected_columns=columns, sql=sql
    )

    def run(spark, sf_dir):
        for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
            _t(spark, sf_dir, t).createOrReplaceTempView(t)
        return recipe_frame(spark, recipe, {k: v for k, (_, v) in (params or {}).items()})

    bound = oracle or sql
    for k, (kind, v) in (params or {}).items():
        bound = bound.replace(f":{k}", v if kind in ("integer", "float", "boolean") else f"'{v}'")
    query(bound, name)(run)


_recipe(
    "recipe_tail",
    "SELECT event_id, user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS change FROM events "
    "WHERE event_type = :type ORDER BY event_id",
    ["event_id", "user_id", "change"], {"type": ("string", "purchase")}
)
_recipe(
    "recipe_threshold",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice <= :most AND o_orderstatus = 'O' ORDER BY "
    "o_totalprice DESC, o_orderkey",
    ["o_orderkey", "o_totalprice"], {"most": ("float", "100000.5")}
)
_recipe(
    "recipe_by_key", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = :segment ORDER BY c_custkey",
    ["c_custkey", "c_name"], {"segment": ("string", "BUILDING")}
)
_recipe(
    "recipe_join",
    "SELECT o.o_orderkey, c.c_name, n.n_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n "
    "ON c.c_nationkey = n.n_nationkey",
    ["o_orderkey", "c_name", "n_name"]
)
_recipe(
    "recipe_group",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS "
    "quantity FROM lineitem GROUP BY l_returnflag, l_linestatus",
    ["l_returnflag", "l_linestatus", "n", "quantity"]
)
_recipe(
    "recipe_window",
    "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) "
    "AS place FROM orders",
    ["o_orderkey", "place"]
)
_recipe("recipe_union", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region", ["k"])
_recipe("recipe_intersect", "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders", ["k"])
_recipe("recipe_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders", ["k"])
_recipe(
    "recipe_cte",
    "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT o_custkey, n FROM big WHERE "
    "n > 10",
    ["o_custkey", "n"]
)
_recipe(
    "recipe_outer_join",
    "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND "
    "o.o_orderstatus = 'P'",
    ["c_custkey", "o_orderkey"]
)
_recipe(
    "recipe_full_join",
    "SELECT c.c_custkey, s.s_suppkey FROM customer c FULL JOIN supplier s ON c.c_custkey = s.s_suppkey * 3",
    ["c_custkey", "s_suppkey"]
)
_recipe(
    "recipe_theta_join",
    "SELECT a.n_name AS low, b.n_name AS high FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND "
    "a.n_nationkey < b.n_nationkey",
    ["low", "high"]
)
_recipe(
    "recipe_semi_join",
    "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND "
    "o.o_totalprice > 100000)",
    ["c_custkey"]
)
_recipe(
    "recipe_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50",
    ["o_orderkey", "o_totalprice"]
)
_recipe(
    "recipe_date_param",
    "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) >= CAST(:day AS DATE)", ["o_orderkey"],
    {"day": ("date", "1996-06-01")}
)
_recipe(
    "recipe_boolean_param", "SELECT p_partkey FROM part WHERE (p_size > 25) = :large", ["p_partkey"],
    {"large": ("boolean", "true")}
)
_recipe(
    "recipe_distinct",
    "SELECT count(DISTINCT o_custkey) AS customers, avg(DISTINCT o_custkey) AS mean FROM orders", ["customers", "mean"]
)
_recipe(
    "recipe_running_sum",
    "SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY "
    "o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS total FROM orders",
    ["o_orderkey", "total"]
)
_recipe(
    "recipe_subquery",
    "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > (SELECT avg(s_acctbal) FROM supplier)",
    ["s_suppkey", "s_acctbal"]
)


@query(
    f"WITH v AS (SELECT o_orderkey, o_custkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS day, "
    f"CAST({_VALUE.format(last='CAST(o_orderkey % 1000 AS DOUBLE)')} AS DOUBLE) AS amount, lead(o_orderkey % 3 + 1) "
    f"OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS s FROM orders) SELECT o_orderkey AS row_id, "
    f"o_custkey AS customer, o_orderstatus AS status, day, amount, amount - lag(amount) OVER (PARTITION BY o_custkey "
    f"ORDER BY day, o_orderkey) AS change FROM v WHERE s IS NULL"
)
def flagship(spark, sf_dir):
    """Messy orders: coerced, versioned by customer and status, the active rows of all read through a recipe."""
    o = _marked(_t(spark, sf_dir, "orders"), "o_orderkey")
    text = _MESSY.format(k=_K.format(s="STRING"), last=_K.format(s="STRING"))
    df = o.select(
        F.col("o_custkey").alias("_c0"), F.col("o_orderstatus").alias("_c1"),
        F.date_format("o_orderdate", "M/d/yyyy").alias("_c2"), F.expr(text).alias("_c3"), "_src_row"
    )
    with ops.deferred():
        df = ops.drop_empty(ops.promote_header(df, -1, ["customer", "status", "day", "amount"]))
        df = ops.coerce_date(ops.coerce_numeric(df, "amount"), "day", fmt="%m/%d/%Y")
    log = df.select(
        F.col("_src_row").alias("row_id"), "customer", "status", "day", "amount",
        (F.col("_src_row") % 3 + 1).alias("_run_id")
    )
    superseded(log, ["customer", "status"]).createOrReplaceTempView("final_orders")
    sql = "SELECT row_id, customer, status, day, amount, amount - lag(amount) OVER (PARTITION BY customer ORDER BY day, row_id) AS change FROM final_orders WHERE _superseded_by_run_id IS NULL"
    return recipe_frame(
        spark,
        Recipe(name="tail", expected_columns=["row_id", "customer", "status", "day", "amount", "change"], sql=sql)
    )

"""Queries that take a file all the way: artifacts, mirroring, profiles, lint and recipes, and the same in SQL.

Files are made from the nation table in a folder of the driver, as users hand them
over; tables are written to the shared folder.
"""

from __future__ import annotations

import json
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.crosswalk import learn, load_mapping, load_synonyms, suggest
from ..operators.drift import FingerprintDrift, generate_fingerprint
from ..operators.profile import profile
from ..operators.versions import Store, columns_of, register_views
from ..sources.shared import new_path
from ..sources.xlsx import read_workbook, write_workbook
from . import artifact, mirror, recipes
from .governed import query

_HEADER = ["Nation", "Total", "Share", "Code"]
_TRANSFORM = """
def transform(raw_grid):
    df = ops.promote_header(raw_grid, header_row=2, column_names=["nation", "total", "share", "code"])
    df = ops.drop_empty(df)
    for name in ("total", "share", "code"):
        df = ops.coerce_numeric(df, name)
    return df
"""
_SCHEMA = """
from pydantic import BaseModel

class SourceRow(BaseModel):
    nation: str

class TargetRow(BaseModel):
    nation: str
    total: float
    share: float
    code: int
"""
_RULES = """
row_count: {min: 1}
key_uniqueness: [{columns: [nation]}]
null_policy: [{column: code, nulls_allowed: false}]
value_ranges: [{column: share, min: 0, max: 1}]
sum_preservation: [{source_column: 1, target_column: total}]
"""
_ROWS = "SELECT n_name AS nation, CAST(1000 + n_nationkey AS DOUBLE) AS total, CAST(n_nationkey AS DOUBLE) / 100 AS share, n_nationkey AS code FROM nation"


def _rows(spark: SparkSession, sf_dir: str) -> list[list]:
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect()
    return [[x.n_name, f"{1000 + x.n_nationkey:,}", f"{x.n_nationkey}%", x.n_nationkey] for x in nations]


def _artifact(spark: SparkSession, sf_dir: str, folder: str) -> tuple[Path, Path]:
    """An artifact's folder, and an input file for it."""
    root, book = Path(folder) / "nations", Path(folder) / "nations.xlsx"
    (root / "golden").mkdir(parents=True)
    write_workbook(str(book), {"Nations": [["All nations"], _HEADER, *_rows(spark, sf_dir), [None] * 4]})
    (root / "golden" / artifact.GOLDEN[0]).write_bytes(book.read_bytes())
    (root / "golden" / artifact.GOLDEN[1]).mkdir()
    (root / "manifest.yaml").write_text(
        "name: nations\nversion: v1\nsheet: Nations\ntarget_table: nations\nkey: [nation]\n"
    )
    (root / "schema.py").write_text(_SCHEMA)
    (root / "transform.py").write_text(_TRANSFORM)
    (root / "validations.yaml").write_text(_RULES)
    (root / "CHANGELOG.md").write_text("v1: first\n")
    fingerprint = generate_fingerprint(read_workbook(str(book)), "Nations", 2)
    (root / "fingerprint.json").write_text(json.dumps(fingerprint.model_dump()))
    return root, book


@query(
    f"WITH n AS ({_ROWS}) "
    "SELECT r * (SELECT count(*) FROM n) + row_number() OVER (PARTITION BY r ORDER BY code) AS row_id, "
    "nation, total, share, CAST(code AS BIGINT) AS code, CAST(r + 1 AS BIGINT) AS _run_id, "
    "CASE WHEN r = 0 THEN CAST(2 AS BIGINT) END AS _superseded_by_run_id, CAST(code + 3 AS INTEGER) AS start_row "
    "FROM (SELECT n.*, r FROM n, (VALUES (0), (1)) v(r))"
)
def artifact_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file loaded twice through its artifact: rows by run, which one superseded which, and their source rows."""
    store = Store(spark, new_path(spark, "store"))
    with tempfile.TemporaryDirectory() as folder:
        root, book = _artifact(spark, sf_dir, folder)
        for _ in range(2):
            artifact.run(spark, root, book, store)
        columns = columns_of(artifact.load_schema(root / "schema.py"))
    rows = store.with_lineage(store.final("nations", columns, ["nation"]), "nations")
    names = ["row_id", "nation", "total", "share", "code", "_run_id", "_superseded_by_run_id", "start_row"]
    return rows.select(*[rows[c] for c in names[:5]], F.col("_run_id"), "_superseded_by_run_id", "start_row")


@query(
    "SELECT * FROM (VALUES ('row_count', 'PASS'), ('key_uniqueness:nation', 'PASS'), ('null_policy:code', 'PASS'), "
    "('value_range:share', 'PASS'), ('sum_preservation:1->total', 'PASS')) v(check_name, status)"
)
def artifact_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, new_path(spark, "store"))
    with tempfile.TemporaryDirectory() as folder:
        artifact.run(spark, *_artifact(spark, sf_dir, folder), store)
    return store.meta("validation_results").select("check_name", "status")


@query("SELECT 'header_text_mismatch' AS kind, 2 AS col, 'Total' AS expected, 'Sum' AS found")
def artifact_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A renamed header stops a run before anything is written."""
    store = Store(spark, new_path(spark, "store"))
    with tempfile.TemporaryDirectory() as folder:
        root, book = _artifact(spark, sf_dir, folder)
        write_workbook(
            str(book),
            {"Nations": [["All nations"], ["Nation", "Sum", *_HEADER[2:]], *_rows(spark, sf_dir)]}
        )
        try:
            artifact.run(spark, root, book, store)
            found = []
        except FingerprintDrift as e:
            found = [(d.kind, d.column_position, d.expected, d.found) for d in e.differences]
    return spark.createDataFrame(found, "kind string, col int, expected string, found string")


@query("SELECT * FROM (VALUES (2, 'import'), (3, 'ops.drop'), (4, 'collect')) v(line, what)")
def artifact_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    with tempfile.TemporaryDirectory() as folder:
        root, _ = _artifact(spark, sf_dir, folder)
        (root / "transform.py").write_text(
            "def transform(df):\n    import os\n    df = ops.drop(df)\n    return df.collect()\n"
        )
        found = [(x.line, x.message) for x in artifact.lint_artifact(root)]
    words = ("import", "ops.drop", "collect")
    rows = [(line, next(w for w in words if w in text)) for line, text in found]
    return spark.createDataFrame(rows, "line int, what string")


_MAPPING = """
target: atlas.nations
key: [name]
columns:
- {source: Nation, target: name, basis: exact, approved: true}
- {source: Share, target: part, transform: coerce_numeric(scale=2), basis: synonym, approved: true}
- {source: Code, target: code, basis: llm, evidence: a number, approved: true}
"""
_TARGET = """
from pydantic import BaseModel

class TargetRow(BaseModel):
    name: str
    part: float
    code: int
    remark: str | None = None
"""


def _crosswalk(spark: SparkSession, sf_dir: str, folder: str) -> tuple[Path, Path]:
    root, book = Path(folder) / "atlas", Path(folder) / "nations.xlsx"
    root.mkdir()
    write_workbook(str(book), {"Nations": [_HEADER, *_rows(spark, sf_dir)]})
    fingerprint = generate_fingerprint(read_workbook(str(book)), "Nations", 1)
    (root / "fingerprint.json").write_text(json.dumps(fingerprint.model_dump()))
    (root / "mapping.yaml").write_text(_MAPPING)
    (root / "schema.py").write_text(_TARGET)
    return root, book


@query(
    f"SELECT row_number() OVER (ORDER BY code) AS row_id, nation AS name, 2 * share AS part, CAST(code AS BIGINT) AS code, "
    f"CAST(NULL AS VARCHAR) AS remark, CAST(1 AS BIGINT) AS _run_id FROM ({_ROWS})"
)
def mirror_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A foreign file mirrored into a table: a dry run first, then for good."""
    store = Store(spark, new_path(spark, "store"))
    with tempfile.TemporaryDirectory() as folder:
        root, book = _crosswalk(spark, sf_dir, folder)
        mirror.mirror(spark, root, book, store)
        mirror.mirror(spark, root, book, store, dry_run=False)
        columns = columns_of(artifact.load_schema(root / "schema.py", ("TargetRow",)))
    return store.mirrored("atlas_nations", columns)


@query(
    "SELECT 'Share' AS source, 'part' AS target, (SELECT count(*) FROM nation) AS rows_in, 0 AS rows_out, "
    "'Total' AS unmapped, 'remark' AS unfilled"
)
def mirror_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    with tempfile.TemporaryDirectory() as folder:
        s = mirror.mirror(spark, *_crosswalk(spark, sf_dir, folder), Store(spark, new_path(spark, "store"))).summary
    check = next(c for c in s.numeric_checks if c.target_column == "part")
    row = (
        check.source_column, check.target_column, s.rows_in, s.rows_out,
        *s.unmapped_source_columns, *s.target_columns_not_populated,
    )
    kinds = "source string, target string, rows_in bigint, rows_out int, unmapped string, unfilled string"
    return spark.createDataFrame([row], kinds)


@query("SELECT (SELECT count(*) FROM nation) AS already, 0 AS within")
def mirror_refusal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same file a second time: every key is in the target already."""
    store = Store(spark, new_path(spark, "store"))
    with tempfile.TemporaryDirectory() as folder:
        root, book = _crosswalk(spark, sf_dir, folder)
        mirror.mirror(spark, root, book, store, dry_run=False)
        try:
            mirror.mirror(spark, root, book, store, dry_run=False)
            found = (0, 0)
        except mirror.MirrorDuplicateKeyError as e:
            found = (len(e.existing), len(e.within))
    return spark.createDataFrame([found], "already bigint, within int")


@query("SELECT * FROM (VALUES ('code', 'code'), ('share', 'part')) v(name, target)")
def mapping_learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What approved matches teach, and a later suggestion draws on."""
    with tempfile.TemporaryDirectory() as folder:
        (Path(folder) / "m.yaml").write_text(_MAPPING)
        learn(load_mapping(Path(folder) / "m.yaml"), Path(folder) / "synonyms.yaml")
        known = load_synonyms(Path(folder) / "synonyms.yaml")
    return spark.createDataFrame(list(known.items()), "name string, target string")


@query(
    "SELECT header, inferred_type, CAST(null_rate AS DOUBLE) AS null_rate, cardinality, smells "
    "FROM (VALUES ('Nation', 'string', 0.0, (SELECT count(DISTINCT n_name) FROM nation), ''), "
    "('Total', 'string', 0.0, (SELECT count(*) FROM nation), 'thousands_separator'), "
    "('Share', 'string', 0.0, (SELECT count(*) FROM nation), 'percent_string'), "
    "('Code', 'integer', 0.0, (SELECT count(*) FROM nation), '')) v(header, inferred_type, null_rate, cardinality, smells)"
)
def profile_workbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    with tempfile.TemporaryDirectory() as folder:
        sheet = profile(spark, _crosswalk(spark, sf_dir, folder)[1]).sheets[0]
    rows = [(c.header_text, c.inferred_type, c.null_rate, c.cardinality, ",".join(c.smells)) for c in sheet.columns]
    kinds = "header string, inferred_type string, null_rate double, cardinality bigint, smells string"
    return spark.createDataFrame(rows, kinds)


@query("SELECT * FROM (VALUES ('Nation', 'name', 'synonym'), ('Code', 'code', 'exact')) v(source, target, basis)")
def suggest_from_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    with tempfile.TemporaryDirectory() as folder:
        sheet = profile(spark, _crosswalk(spark, sf_dir, folder)[1]).sheets[0]
    draft, _ = suggest(
        sheet, ["name", "part", "code"], target="atlas.nations", key=["name"], synonyms={"nation": "name"}
    )
    return spark.createDataFrame(
        [(c.source, c.target, c.basis) for c in draft.columns], "source string, target string, basis string"
    )


@query(f"SELECT nation, share FROM ({_ROWS}) WHERE share >= 0.1")
def recipe_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recipe found by name in a folder, over the views of a store."""
    store = Store(spark, new_path(spark, "store"))
    with tempfile.TemporaryDirectory() as folder:
        artifact.run(spark, *_artifact(spark, sf_dir, folder), store)
        head = "---\nname: large\nparams:\n  least: {type: float}\nexpected_columns: [nation, share]\n---\n"
        (Path(folder) / "large.sql").write_text(head + "SELECT nation, share FROM nations WHERE share >= :least\n")
        recipe = recipes.find_recipe(folder, "large")
    register_views(store)
    return recipes.recipe_frame(spark, recipe, {"least": "0.1"})

import json

import books
import pytest
from sheafline.cli import main
from sheafline.operators.checks import Sum, Validations, exact_sums, run_validations
from sheafline.operators.crosswalk import ExcelTarget, MappingLoadError, load_mapping_for_execution, parse_transform
from sheafline.operators.drift import FingerprintDrift, check_fingerprint, generate_fingerprint
from sheafline.operators.profile import profile, to_json
from sheafline.operators.versions import Store, active_rows, columns_of, register_views, rows_as_of, superseded
from sheafline.plans import artifact as A
from sheafline.plans.mirror import MirrorDuplicateKeyError, mirror
from sheafline.plans.recipes import QueryError, QueryParamError, QueryShapeError, Recipe, find_recipe, render_rows, run_recipe
from sheafline.sources.xlsx import read_workbook, write_workbook


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    return books.artifact(tmp_path_factory.mktemp("a") / "deliveries", spark)


def test_run_twice_supersedes_and_keeps_lineage(spark, built, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    book, n = built / "golden" / "input_sample.xlsx", books.ROWS
    first, second = A.run(spark, built, book, store), A.run(spark, built, book, store)
    assert (first.run_id, second.run_id) == (1, 2)
    assert first.row_ids == range(1, n + 1) and second.row_ids == range(n + 1, 2 * n + 1)
    model = A.load_schema(built / "schema.py")
    final = store.final("final_deliveries", columns_of(model), ["crate"])
    assert (
        final.count(), active_rows(final).count(), final.where("_superseded_by_run_id = 2").count(),
        rows_as_of(final, 1).count()
    ) == (2 * n, n, n, n)
    one = store.with_lineage(active_rows(final), "final_deliveries").orderBy("row_id").first()
    assert (
        one.start_row, one.end_row, one.picked, one.pressed, one._verification
    ) == (6, 6, "2022-08-01", "2022-08-05", "TO_VERIFY")
    assert store.meta("validation_results").count() == 2 * 5
    assert store.raw_files().count() == 1
    assert set(register_views(store)) == {
        "final_deliveries", "meta_runs", "meta_lineage", "meta_validation_results", "raw_files"
    }
    sql = "SELECT picked, moisture, moisture - lag(moisture) OVER (ORDER BY picked) AS change FROM final_deliveries WHERE orchard = :orchard AND _superseded_by_run_id IS NULL ORDER BY picked"
    recipe = Recipe(
        name="tail", params={"orchard": {"type": "string"}}, expected_columns=["picked", "moisture", "change"], sql=sql
    )
    rows = run_recipe(spark, recipe, {"orchard": "Old wall"}).rows
    assert len(rows) == sum(r[1] == "Old wall" for r in books.delivery_rows()) > 1 and rows[0]["change"] is None
    assert run_recipe(spark, recipe, {"orchard": "'; DROP TABLE x"}).rows == []
    with pytest.raises(ValueError, match="has the key"):
        store.load_final_rows("final_deliveries", columns_of(model), ["picked"], final, 9, "d", "s", "v")


def test_broken_rule_leaves_the_table_alone(spark, built, tmp_path):
    rows = books.delivery_rows()
    rows[1][2] = rows[0][2]
    book = books.deliveries(tmp_path / "twice.xlsx", rows)
    store = Store(spark, f"file://{tmp_path}/store")
    with pytest.raises(A.RuntimeCheckError, match="key_uniqueness:crate"):
        A.run(spark, built, book, store)
    assert store.meta("commits").count() == 0 and store.meta("runs").count() == 1
    assert store.meta("validation_results").where("status = 'FAIL'").count() == 1


def test_a_bad_value_is_named_by_its_first_row(spark, built, tmp_path):
    rows = books.delivery_rows()
    rows[9][4], rows[4][4] = "heavy", "n/a"
    with pytest.raises(ValueError, match="column 'weight': unparseable value 'n/a' at _src_row=10"):
        A.run(spark, built, books.deliveries(tmp_path / "bad.xlsx", rows), Store(spark, f"file://{tmp_path}/store"))


@pytest.mark.parametrize(
    ("change", "kind"),
    [
        ({"header": ["Picked", "Field", *books.HEADER[2:]]}, "header_text_mismatch"),
        ({"before": {"Cover": [["x"]]}}, "sheet_position_mismatch")
    ]
)
def test_drift(built, tmp_path, change, kind):
    fp = A.load_fingerprint(built / "fingerprint.json")
    check = check_fingerprint(fp, read_workbook(str(books.deliveries(tmp_path / "b.xlsx", **change))))
    assert not check.ok and kind in [d.kind for d in check.differences]
    if kind == "header_text_mismatch":
        assert check.differences[0].message() == "sheet 'Deliveries' col 2: expected `Orchard`, found `Field`"


def test_fingerprint_of_a_file_accepts_it(built):
    sheets = read_workbook(str(built / "golden" / "input_sample.xlsx"))
    fp = generate_fingerprint(sheets, "Deliveries", books.ABOVE)
    assert [c.strictness for c in fp.columns] == ["strict"] * 5 + ["position_only"] * 2
    assert check_fingerprint(fp, sheets).ok and check_fingerprint(
        fp.model_copy(update={"sheet": "No"}), sheets
    ).differences[0].kind == "sheet_missing"


def test_profile(spark, built):
    p = profile(spark, built / "golden" / "input_sample.xlsx")
    s = p.sheets[0]
    assert (s.dimensions, s.n_rows, s.n_cols, s.merged_cells) == ("A1:G37", 37, 7, ["F5:G5"])
    assert (s.header_candidates[0].row, s.header_candidates[0].confidence) == (5, 0.5714)
    assert [c.inferred_type for c in s.columns] == ["string"] * 5 + ["float", "integer"]
    assert {c.null_rate for c in s.columns} == {0.0625}
    assert [c.smells for c in s.columns[3:]] == [
        ["percent_string"], ["thousands_separator"], [], ["date_serial_suspect"]
    ]
    assert s.columns[0].samples[0] == "01.08.2022" and s.columns[0].cardinality == books.ROWS
    assert json.loads(to_json(p))["source_file"] == "input_sample.xlsx"


#: Layouts that profiles have to cope with: rows of a sheet; header row, confidence; type, null rate and smells by column.
LAYOUTS = {
    "a row of group titles above the header": (
        [
            ["", "Terms", None, "Size", None], ["Day", "Rate (%)", "Kind", "Amount", "Unit"],
            *[[f"0{i}/03", i + 0.25, "ab"[i % 2], i * 0.5 if i % 2 else i, "kg"] for i in range(1, 9)]
        ],
        ["B1:C1", "D1:E1"], (2, 0.7), [
            ("string", 0.0, []), ("float", 0.0, []), ("string", 0.0, []), ("mixed", 0.0, []), ("string", 0.0, [])
        ],
    ),
    "two tables in one sheet": (
        [
            ["Code", "Count", "Price"], *[[f"a{i}", i, i + 0.5] for i in range(1, 5)], [None] * 3,
            ["Code", "Name", "Note"], *[[f"b{i}", "n", "x"] for i in range(3)]
        ],
        [], (1, 0.8333), [("string", 0.1111, []), ("mixed", 0.1111, []), ("mixed", 0.1111, [])],
    ),
    "dates as serials and as text in one column": (
        [["Day", "Amount"], [45000, 10], ["03/04/2023", 20], ["25/12/2023", 30000], [45003, 40]],
        [], (1, 1.0), [("mixed", 0.0, ["date_serial_suspect"]), ("integer", 0.0, ["date_serial_suspect"])],
    ),
    "units only in the header": (
        [
            ["Day", "Party", "Notional ($mm)", "Px (32nds)"],
            *[["2023-01-02", f"p{i % 3}", 1.5 * i + 0.1, i] for i in range(1, 7)]
        ],
        [], (1, 0.75), [("string", 0.0, []), ("string", 0.0, []), ("float", 0.0, []), ("integer", 0.0, [])],
    ),
    "a header below banners and footnotes below the data": (
        [
            ["Desk report"], ["as of today"], [None], ["Id", "Desk", "Value"],
            *[[f"i{i}", "d", f"({i}.5)"] for i in range(1, 8)], ["* preliminary"]
        ],
        [], (4, 0.5), [("string", 0.0, []), ("string", 0.125, []), ("string", 0.125, ["parens_negative"])],
    ),
    "amounts as percentages and with commas": (
        [["Share", "Total"], ["10%", "1,000"], ["2.5 %", "12,345.5"], ["(3%)", "900"]],
        [], (1, 0.5), [
            ("string", 0.0, ["parens_negative", "percent_string"]), ("string", 0.0, ["thousands_separator"])
        ],
    ),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_profiles_of_awkward_layouts(spark, tmp_path, name):
    rows, merges, header, columns = LAYOUTS[name]
    write_workbook(str(tmp_path / "b.xlsx"), {"S": rows}, {"S": merges})
    sheet = profile(spark, tmp_path / "b.xlsx").sheets[0]
    assert [(c.row, c.confidence) for c in sheet.header_candidates] == [header] and sheet.merged_cells == merges
    assert [(c.inferred_type, c.null_rate, c.smells) for c in sheet.columns] == columns
    assert [c.header_text for c in sheet.columns] == rows[header[0] - 1]


def test_golden_and_lint(spark, built, tmp_path):
    assert A.run_golden_test(spark, built).ok
    assert A.lint_artifact(built) == []
    other = books.copy(built, tmp_path / "other")
    (other / "transform.py").write_text("import os\n" + books.TRANSFORM.replace("ops.drop_empty", "ops.drop_some"))
    messages = [f.render() for f in A.lint_artifact(other)]
    assert len(messages) == 2 and "import" in messages[0]
    with pytest.raises(A.ArtifactLoadError):
        A.load_artifact(other)
    (other / "transform.py").write_text(
        books.TRANSFORM.replace("coerce_numeric(df, name)", "coerce_numeric(df, name, scale=2.0)")
    )
    found = A.run_golden_test(spark, other)
    assert not found.ok and len(found.value_differences) == 3 * books.ROWS
    with pytest.raises(A.LintError):
        A.lint_artifact(tmp_path)
    for name in ("take", "toLocalIterator", "toArrow", "collect", "first"):
        (other / "transform.py").write_text(f"def transform(df):\n    df.{name}\n    return df\n")
        assert [f.line for f in A.lint_artifact(other)] == [2]
    (other / "transform.py").write_text(
        "def transform(df):\n    try:\n        raise StopIteration\n    except (StopIteration, RuntimeError, ZeroDivisionError):\n        return df if issubclass(int, int) and NotImplemented is not Ellipsis else None\n"
    )
    assert A.load_artifact(other).transform("x") == "x"


def test_refreezing_needs_a_word_in_the_change_log(spark, built, tmp_path):
    import subprocess

    other = books.copy(built, tmp_path / "other")
    with pytest.raises(A.RefreezeRefused, match="CHANGELOG.md"):
        A.freeze(spark, other)
    git = lambda *a: subprocess.run(
        ["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@example.org", *a], check=True,
        capture_output=True
    )
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "first")
    (other / "transform.py").write_text(books.TRANSFORM + "# other\n")
    with pytest.raises(A.RefreezeRefused):
        A.freeze(spark, other)
    (other / "CHANGELOG.md").write_text("v1: first\nv2: a comment\n")
    assert A.freeze(spark, other).exists() and A.run_golden_test(spark, other).ok


def test_mirror_to_a_table(spark, tmp_path):
    root = books.crosswalk(tmp_path / "m")
    store = Store(spark, f"file://{tmp_path}/store")
    dry = mirror(spark, root, root / "lots.xlsx", store)
    assert dry.dry_run and dry.summary.rows_in == 6 and dry.summary.unmapped_source_columns == ["Remarks"] and dry.summary.target_columns_not_populated == ["inspector"]
    check = dry.summary.numeric_checks[0]
    assert (
        check.source_sum, check.target_sum
    ) == (47.25, pytest.approx(0.4725)) and "DRY RUN -- nothing written" in dry.summary.render()
    done = mirror(spark, root, root / "lots.xlsx", store, dry_run=False)
    assert done.row_ids == range(1, 7)
    with pytest.raises(MirrorDuplicateKeyError, match="on_duplicate: fail -- 6 already in target"):
        mirror(spark, root, root / "lots.xlsx", store)
    write_workbook(str(root / "lots.xlsx"), {"Lots": [books.LOTS[0], books.LOTS[1], books.LOTS[1]]})
    with pytest.raises(MirrorDuplicateKeyError, match="1 duplicated within this file"):
        mirror(spark, root, root / "lots.xlsx", Store(spark, f"file://{tmp_path}/other"))
    many = [[f"L{i % 500}", 1.0, "2023-05-09", "Gull Line", ""] for i in range(1_000)]
    write_workbook(str(root / "lots.xlsx"), {"Lots": [books.LOTS[0], *many]})
    with pytest.raises(MirrorDuplicateKeyError, match="500 duplicated within this file.* and 400 more, 500 in all"):
        mirror(spark, root, root / "lots.xlsx", Store(spark, f"file://{tmp_path}/other"))


def test_mirror_to_a_workbook(spark, tmp_path):
    import datetime as dt

    root = books.crosswalk(tmp_path / "m", excel=True)
    before = read_workbook(str(root / "register.xlsx"))
    done = mirror(
        spark, root, root / "lots.xlsx", Store(spark, f"file://{tmp_path}/s"), dry_run=False,
        now=dt.datetime(2024, 2, 1, 3, 4, 5)
    )
    assert done.backup_path.name == "register.20240201T030405Z.bak.xlsx"
    sheet = read_workbook(str(root / "register.xlsx"))[0]
    assert [sheet.value(3, c) for c in range(1, 6)] == ["L7", 0.0225, "2023-05-09", "Gull Line", 3]
    assert sheet.value(8, 1) == "L42" and read_workbook(str(done.backup_path))[0].cells == before[0].cells
    assert read_workbook(str(root / "register.xlsx"))[1].cells == before[1].cells


@pytest.mark.parametrize(
    "text",
    [
        "", "coerce_numeric", "coerce_numeric(2)", "coerce_numeric(scale=x)", "coerce_numeric(scale='1')",
        "drop_empty()", "coerce_date(form='%Y')", "a.coerce_date()", "coerce_date(**{})", "coerce_date() + 1",
        "coerce_date(fmt='%Y')()"
    ]
)
def test_transforms_that_a_mapping_may_not_make(text):
    with pytest.raises(MappingLoadError):
        parse_transform(text)


def test_transforms_of_a_mapping(tmp_path):
    assert parse_transform(" coerce_numeric(scale = 0.5, allow_null=True) ") == (
        "coerce_numeric", {"scale": 0.5, "allow_null": True}
    )
    assert parse_transform("map_values(mapping={'a': '(b)'})") == ("map_values", {"mapping": {"a": "(b)"}})
    (tmp_path / "m.yaml").write_text(
        books.MAPPING.replace("basis: exact, approved: true", "basis: exact", 1).replace("scale=0.01", "0.01")
    )
    with pytest.raises(MappingLoadError, match=r"'Lot No.' -> 'lot_no': not approved; 'Duty \(%\)' -> 'duty_rate': "):
        load_mapping_for_execution(tmp_path / "m.yaml")
    with pytest.raises(ValueError, match="2 columns fill A to B"):
        ExcelTarget(path="x", first_data_col="A", last_data_col="C", column_order=["p", "q"])


def test_supersede_against_one_by_one(spark):
    import random

    r = random.Random(5)
    rows = [(i, r.choice(["a", "b", None]), r.choice([1, None]), 1 + i // 4) for i in range(1, 60)]
    got = {
        x.row_id: x._superseded_by_run_id
        for x in superseded(
            spark.createDataFrame(rows, "row_id bigint, k string, n int, _run_id bigint"), ["k", "n"]
        ).collect()
    }
    want: dict = {}
    for i, k, n, run in rows:
        for j, k2, n2, _ in rows:
            if j < i and k == k2 and n == n2 and k is not None and n is not None and want.get(j) is None:
                want[j] = run
        want[i] = None
    assert got == want


def test_validations_at_their_bounds(spark):
    rules = Validations.model_validate(
        {
            "row_count": {"min": 3}, "value_ranges": [{"column": "x", "min": 1, "max": 2}],
            "null_policy": [{"column": "x", "nulls_allowed": True}],
            "sum_preservation": [{"source_column": 0, "target_column": "x"}]
        }
    )
    df = spark.createDataFrame([(1.0, 1), (2.0, 2), (None, 3)], "x double, _src_row int")
    raw = spark.createDataFrame([("head",), ("1",), ("2.00",)], "_c0 string")
    assert [o.status for o in run_validations(rules, raw, df)] == ["PASS"] * 4
    rules.row_count.min, rules.value_ranges[0].max = 4, 1.5
    got = {o.check_name: o.detail for o in run_validations(rules, raw, df) if o.status == "FAIL"}
    assert got == {
        "row_count": "3 rows < minimum 4",
        "value_range:x": "out-of-range values (expected [1.0, 1.5]): [2.0]"
    }


def test_sums_are_exact(spark):
    import random
    from fractions import Fraction

    from pyspark.sql import functions as F

    r = random.Random(3)
    values = [
        r.uniform(-1, 1) * 10.0 ** r.randint(-320, 307)
        for _ in range(400)
    ] + [1e30, -1e30, 1e-12, 5e-324, -0.0, 1.7e308, 0.1]
    df = spark.createDataFrame([(x,) for x in values] + [(None,), (float("nan"),)], "x double")
    got = exact_sums(
        df,
        [
            F.col("x"), F.lit(1.0),
            F.when(
                (F.col("x") > 1e300) & ~F.isnan("x"), float("inf")
            ).otherwise(F.when(F.col("x") < -1e300, float("-inf")))
        ]
    )
    assert got[0] == Sum(sum(map(Fraction, values)))
    assert got[1] == Sum(Fraction(len(values) + 2)) and got[2] == Sum(
        Fraction(0), sum(x > 1e300 for x in values), sum(x < -1e300 for x in values)
    )
    assert exact_sums(df.limit(0), [F.col("x")]) == [Sum(Fraction(0))]


@pytest.mark.parametrize(("source", "target", "good", "said"), [
    (
        ["1e-12"], [0.0], False, "1e-12 vs target sum 0.0"
    ), (["1e-12"], [1e-12], True, "1e-12 matches"), (["1e30", "1"], [1e30, 1.0], True, "1e+30 matches"), (["1e30"], [2e30], False, "diff 1e+30"),
    (
        ["inf", "1"], [1.0], False, "infinite values: 1 in the source, 0 in the target"
    ), (["inf", "1"], [float("inf"), 1.0], True, "infinite values: 1"), (["inf", "1"], [float("inf"), 2.0], False, "diff 1.0"), (["inf"], [float("-inf")], False, "diff inf"),
])
def test_sum_rule(spark, source, target, good, said):
    rules = Validations.model_validate({"sum_preservation": [{"source_column": 0, "target_column": "x"}]})
    raw, done = spark.createDataFrame(
        [(x,) for x in source], "_c0 string"
    ), spark.createDataFrame([(x,) for x in target], "x double")
    found = run_validations(rules, raw, done)[-1]
    assert (found.status == "PASS") is good and said in found.detail


def test_rules_count_all_offenders(spark):
    df = spark.range(1_000).selectExpr("id % 500 AS k", "CAST(id AS DOUBLE) AS x")
    rules = Validations.model_validate(
        {"key_uniqueness": [{"columns": ["k"]}], "value_ranges": [{"column": "x", "max": 499}]}
    )
    found = {o.check_name: o.detail for o in run_validations(rules, df, df)}
    assert found["key_uniqueness:k"].endswith("and 400 more, 500 in all") and found["value_range:x"].endswith("and 400 more, 500 in all")


def test_recipes(spark, tmp_path):
    (tmp_path / "r.sql").write_text(
        "---\nname: one\nparams:\n  n: {type: integer}\nexpected_columns: [v]\n---\nSELECT :n + 1 AS v\n"
    )
    recipe = find_recipe(tmp_path, "one")
    assert render_rows(run_recipe(spark, recipe, {"n": "4"})) == "v\n-\n5"
    for given in ({}, {"n": "x"}, {"n": "1", "m": "2"}):
        with pytest.raises(QueryParamError):
            run_recipe(spark, recipe, given)
    with pytest.raises(QueryShapeError):
        run_recipe(spark, recipe.model_copy(update={"expected_columns": ["w"]}), {"n": "4"})
    with pytest.raises(QueryError):
        run_recipe(spark, recipe.model_copy(update={"params": {}, "sql": "DROP VIEW nothing"}))


def test_command_line(spark, built, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    book = str(built / "golden" / "input_sample.xlsx")
    store = ["--store", f"file://{tmp_path}/store"]
    assert main(["profile", book, "--out", "p.json"]) == 0
    assert main(["run", str(built), book, *store]) == 0 and "run_id=1 rows_loaded=30" in capsys.readouterr().out
    assert main(["test", str(built)]) == 0 and main(["lint", str(built)]) == 0
    drifted = books.deliveries(tmp_path / "d.xlsx", header=["Day", *books.HEADER[1:]])
    assert main(["run", str(built), str(drifted), *store]) == 3
    assert json.loads((tmp_path / "drift_report.json").read_text())["differences"][0]["kind"] == "header_text_mismatch"
    (tmp_path / "r.sql").write_text(
        "---\nname: n\nexpected_columns: [n]\n---\nSELECT count(*) AS n FROM final_deliveries\n"
    )
    capsys.readouterr()
    assert main(["query", "n", "--recipes-dir", ".", *store]) == 0 and "30" in capsys.readouterr().out
    assert main(["query", "m", "--recipes-dir", ".", *store]) == 1
    (tmp_path / "schema.py").write_text("from pydantic import BaseModel\nclass TargetRow(BaseModel):\n    crate: str\n")
    assert main(["map", "suggest", "p.json", "schema.py", "--target", "t", "--key", "crate", "--out", "m.yaml"]) == 0
    assert main(["lint", str(tmp_path)]) == 1 and main(["nonsense"]) == 1
    root = books.crosswalk(tmp_path / "m")
    assert main(["map", "learn", str(root / "mapping.yaml"), "--synonyms-path", "syn.yaml"]) == 0
    assert "carrier: haulier" in (tmp_path / "syn.yaml").read_text()
    assert main(["mirror", str(root), str(root / "lots.xlsx"), *store]) == 0


def test_drift_is_raised(spark, built, tmp_path):
    with pytest.raises(FingerprintDrift):
        A.run(
            spark, built,
            books.deliveries(tmp_path / "x.xlsx", header=["?", *books.HEADER[1:]]), Store(spark, f"file://{tmp_path}/s")
        )

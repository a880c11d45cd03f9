import datetime as dt
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from sheafline.functions.tokens import normalize_name, normalized_name, number
from sheafline.operators import ops


def frame(spark, values, kind="string"):
    return spark.createDataFrame([(v, i) for i, v in enumerate(values, 1)], f"x {kind}, _src_row int")


def column(df, name="x"):
    return [r[name] for r in df.orderBy("_src_row").collect()]


def written(value: float, brackets: bool, percent: bool, commas: bool, spaces: str) -> str:
    """A number as a spreadsheet may show it."""
    text = f"{abs(value):,}" if commas else f"{abs(value)}"
    text += "%" if percent else ""
    text = f"({text})" if brackets else f"-{text}" if value < 0 else text
    return f"{spaces}{text}{spaces}"


@pytest.mark.parametrize("brackets", [False, True])
def test_numbers_in_every_dress(spark, brackets):
    cases = [
        (v, p, c, w)
        for v in (0.0, 7.0, 0.125, 98765.5, -31.0, 12_345_678.0)
        for p in (False, True)
        for c in (False, True)
        for w in ("", " ", "\t")
        if not (brackets and v < 0)
    ]
    rows = [(written(v, brackets, p, c, w), -v if brackets else v, p) for v, p, c, w in cases]
    got = column(frame(spark, [t for t, _, _ in rows]).withColumn("x", number(F.col("x"))))
    assert got == pytest.approx([v / 100 if p else v for _, v, p in rows])


@pytest.mark.parametrize(
    "text",
    ["", " ", None, "about 3", "3 4", "4%%", "(8)%", "((2))", "1..2", "7e", "_1", "0x1F", "--5", "1d", "()"]
)
def test_texts_that_are_no_numbers(spark, text):
    assert frame(spark, [text]).select(number(F.col("x"))).first()[0] is None


def test_coerce_numeric_names_the_first_bad_row(spark):
    bad = frame(spark, ["5", "five", "V"])
    with pytest.raises(ValueError, match="unparseable value 'five' at _src_row=2"):
        ops.coerce_numeric(bad, "x")
    assert column(
        ops.coerce_numeric(frame(spark, ["6", "six", "NaN"]), "x", allow_null=True, scale=0.5)
    ) == [3.0, None, None]


def test_dates(spark):
    days = [dt.date(1900, 1, 1), dt.date(1900, 2, 28), dt.date(1900, 3, 1), dt.date(2000, 2, 29), dt.date(2031, 12, 9)]
    texts = [f"{d.day}.{d.month}.{d.year}" for d in days]
    assert column(ops.coerce_date(frame(spark, [*texts, None]), "x", fmt="%d.%m.%Y")) == [*map(str, days), None]
    serials = [(d - dt.date(1899, 12, 31)).days + (d > dt.date(1900, 2, 28)) for d in days]  # a day in February 1900 that never was
    assert column(ops.coerce_date(frame(spark, [*map(str, serials), None]), "x")) == [*map(str, days), None]
    with pytest.raises(ValueError, match="unparseable value 'tomorrow' at _src_row=1"):
        ops.coerce_date(frame(spark, ["tomorrow"]), "x", fmt="%d.%m.%Y")


def jobs_of(spark, run) -> int:
    spark.sparkContext.setJobGroup(name := f"jobs-{id(run)}", "")
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_deferred_checks_read_their_input_once(spark):
    df = frame(spark, ["1", "2", "3"]).withColumn("d", F.lit("2.3.2020"))

    def coerce():
        with ops.deferred():
            out = ops.coerce_date(ops.coerce_numeric(df, "x"), "d", fmt="%d.%m.%Y")
        out.collect()

    assert jobs_of(spark, coerce) == 1
    with ops.deferred():
        late = ops.filter_rows(ops.coerce_numeric(frame(spark, ["1", "b"]), "x"), "_src_row", "lt", 2)
    with pytest.raises(PySparkException, match="column 'x': unparseable value 'b' at _src_row=2"):  # although a filter drops the row
        late.count()
    with pytest.raises(ValueError):
        ops.coerce_numeric(frame(spark, ["b"]), "x")


def test_header_and_empty_rows(spark):
    df = spark.createDataFrame([("a", None, 1), ("1", "", 2), (None, None, 3)], "_c0 string, _c1 string, _src_row int")
    got = ops.drop_empty(ops.promote_header(df, 1, ["p", "q"]))
    assert [tuple(r) for r in got.collect()] == [("1", "", 2)]
    with pytest.raises(ValueError):
        ops.promote_header(df, 1, ["p"])
    with pytest.raises(ValueError):
        ops.promote_header(df, 1, ["p", "p"])


@pytest.mark.parametrize(
    ("op", "value", "kept"),
    [
        ("eq", 2, [2]), ("ne", 2, [1, None]), ("gt", 1, [2]), ("gte", 1, [1, 2]), ("lt", 2, [1]), ("lte", 2, [1, 2]),
        ("isin", [1], [1]), ("notna", None, [1, 2]), ("isna", None, [None])
    ]
)
def test_filter_rows(spark, op, value, kept):
    assert column(ops.filter_rows(frame(spark, [1, 2, None], "int"), "x", op, value)) == kept
    assert column(
        ops.filter_rows(frame(spark, ["1", "2", None]), "x", op, value)
    ) == [k if k is None else str(k) for k in kept]


def test_filter_rows_refuses_unknown_ops(spark):
    with pytest.raises(ValueError, match="unknown op"):
        ops.filter_rows(frame(spark, ["a"]), "x", "like", "a")


def test_split(spark):
    df = ops.split_column(frame(spark, ["k:7", "m:8 kg"]), "x", ["key", "size"], r"(?P<key>[a-z]):(\d)")
    assert df.columns == ["key", "size", "_src_row"] and column(df, "key") == ["k", "m"] and column(df, "size") == ["7", "8"]
    with pytest.raises(ValueError, match=r"did not match rows with _src_row=\[2\]"):
        ops.split_column(frame(spark, ["k:7", "seven"]), "x", ["key", "size"], r"([a-z]):(\d)")
    with pytest.raises(ValueError, match="did not match rows with .* and 400 more, 500 in all"):
        ops.split_column(frame(spark, ["-"] * 500), "x", ["key"], r"([a-z])")
    with pytest.raises(ValueError, match="has 1 capture groups"):
        ops.split_column(frame(spark, ["a"]), "x", ["l", "d"], r"(\w)")


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        (r"([ab|]+)(\d?)", [("ab", "1"), ("|", ""), ("b", "")]),
        (r"(a)|(b|\|)", [("a", None), (None, "|"), (None, "b")]),
        (r"([ab|])(\d)?", [("a", None), ("|", None), ("b", None)]),
        (r"(?:x)?(\S)(?=(.?))", [("a", "b"), ("|", ""), ("b", "")])
    ]
)
def test_split_by_alternatives_and_optional_groups(spark, pattern, want):
    df = ops.split_column(frame(spark, ["ab1", "|", "b"]), "x", ["p", "q"], pattern)
    assert list(zip(column(df, "p"), column(df, "q"), strict=True)) == want
    if "|" in pattern.replace("[ab|]", "") or "?=" in pattern:
        with pytest.raises(ValueError, match=r"_src_row=\[1, 2\]"):
            ops.split_column(frame(spark, [None, "  "]), "x", ["p", "q"], pattern)


@pytest.mark.parametrize("n", [1, 5_000])
def test_map_values(spark, n):
    mapping = {f"k{i}": f"v{i}" for i in range(n)}
    df = frame(spark, ["k0", "other", None, "k0"])
    assert column(ops.map_values(df, "x", mapping, on_missing="keep")) == ["v0", "other", None, "v0"]
    assert column(
        ops.map_values(frame(spark, ["k0"]), "x", mapping)
    ) == ["v0"] and ops.map_values(df, "x", mapping, "keep").columns == df.columns
    with pytest.raises(ValueError, match=r"no mapping: \[None, 'other'\]"):
        ops.map_values(df, "x", mapping)
    with pytest.raises(ValueError, match="and 400 more, 500 in all"):
        ops.map_values(frame(spark, [f"n{i}" for i in range(500)]), "x", mapping)


def test_unpivot_unique_tags_and_sheets(spark):
    df = spark.createDataFrame([("k", 1, "x", 7)], "id string, q1 int, q2 string, _src_row int")
    assert [
        tuple(r)
        for r in ops.unpivot(df, ["id"], ["q1", "q2"], "q", "v").collect()
    ] == [("k", 7, "q1", "1"), ("k", 7, "q2", "x")]
    with pytest.raises(ValueError, match="are not unique; duplicate keys"):
        ops.assert_unique(frame(spark, [None, None]), ["x"])
    with pytest.raises(ValueError, match="and 400 more, 500 in all"):
        ops.assert_unique(frame(spark, [f"{i % 500}" for i in range(1_000)]), ["x"])
    assert ops.tag_verification(df, "DERIVED").first()._verification == "DERIVED"
    with pytest.raises(ValueError):
        ops.tag_verification(df, "SURE")
    with pytest.raises(KeyError, match="available sheets"):
        ops.select_sheet({"a": df}, "b")
    with pytest.raises(NotImplementedError):
        ops.derive(df, "x", "1")


def test_names(spark):
    for text in ("Lot No.", "Duty (%)", " landed-on__day ", ""):
        assert frame(spark, [text]).select(normalized_name(F.col("x"))).first()[0] == normalize_name(text)

"""Workbooks and artifacts for tests: an orchard's deliveries, and a carrier's list of lots."""

import datetime as dt
import json
import random
import shutil
from pathlib import Path

from sheafline.sources.xlsx import write_workbook

ORCHARDS = ["North slope", "Old wall", "River bend", "Chapel"]
HEADER = ["Picked", "Orchard", "Crate", "Moisture", "Weight (kg)", "Grade and pressing", None]
NAMES = ["picked", "orchard", "crate", "moisture", "weight", "grade", "pressed"]
#: Rows above the first delivery.
ABOVE = 5
ROWS = 30


def delivery_rows(n: int = ROWS, seed: int = 7) -> list[list]:
    """Dates as text and as serial numbers, percentages, grouped digits."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        day = dt.date(2022, 8, 1) + dt.timedelta(days=3 * i)
        pressed = (day - dt.date(1899, 12, 30)).days + 4
        orchard = ORCHARDS[i * i % len(ORCHARDS)]
        out.append(
            [
                f"{day:%d.%m.%Y}", orchard, f"C-{i:03d}", f"{r.randint(80, 210) / 10}%", f"{r.randint(1000, 9999):,}",
                r.randint(10, 49) / 10 + 0.05, pressed
            ]
        )
    return out


def deliveries(
    path: Path, rows: list[list] | None = None, header: list | None = None, before: dict | None = None
) -> Path:
    banner = [["Orchard book"], ["Season 2022"], [None], ["Weights as delivered"]]
    body = [*banner, header or HEADER, *(rows or delivery_rows()), *[[""] * 7] * 2]
    write_workbook(str(path), {**(before or {}), "Deliveries": body}, {"Deliveries": ["F5:G5"]})
    return path


TRANSFORM = f"""
def transform(raw_grid):
    df = ops.drop_empty(ops.promote_header(raw_grid, header_row={ABOVE}, column_names={NAMES!r}))
    for name in ("moisture", "weight", "grade"):
        df = ops.coerce_numeric(df, name)
    df = ops.coerce_date(df, "picked", fmt="%d.%m.%Y")
    return ops.coerce_date(df, "pressed")
"""

SCHEMA = """
import datetime as dt
from pydantic import BaseModel

class SourceRow(BaseModel):
    picked: str

class TargetRow(BaseModel):
    picked: dt.date
    orchard: str
    crate: str
    moisture: float
    weight: float
    grade: float
    pressed: dt.date
"""

RULES = """
row_count: {min: 1}
key_uniqueness: [{columns: [crate]}]
null_policy: [{column: picked, nulls_allowed: false}]
value_ranges: [{column: moisture, min: 0.0, max: 0.5}]
sum_preservation: [{source_column: 4, target_column: weight}]
"""


def artifact(root: Path, spark) -> Path:
    from sheafline.operators.drift import generate_fingerprint
    from sheafline.plans.artifact import freeze
    from sheafline.sources.xlsx import read_workbook

    (root / "golden").mkdir(parents=True)
    (root / "manifest.yaml").write_text(
        "name: deliveries\nversion: v1\nsheet: Deliveries\ntarget_table: final_deliveries\nkey: [crate]\n"
    )
    (root / "schema.py").write_text(SCHEMA)
    (root / "transform.py").write_text(TRANSFORM)
    (root / "validations.yaml").write_text(RULES)
    (root / "CHANGELOG.md").write_text("v1: first\n")
    book = deliveries(root / "golden" / "input_sample.xlsx")
    fp = generate_fingerprint(read_workbook(str(book)), "Deliveries", ABOVE)
    (root / "fingerprint.json").write_text(json.dumps(fp.model_dump()))
    freeze(spark, root)
    return root


LOTS = [
    ["Lot No.", "Duty (%)", "Landed", "Carrier", "Remarks"],
    *[[f"L{7 * i}", 2.25 * i, "2023-05-09", "Gull Line", f"hold {i}"] for i in range(1, 7)]
]
MAPPING = """
target: port.lots
key: [lot_no, landed]
columns:
- {source: Lot No., target: lot_no, basis: exact, approved: true}
- {source: Duty (%), target: duty_rate, transform: coerce_numeric(scale=0.01), basis: synonym, approved: true}
- {source: Landed, target: landed, basis: exact, approved: true}
- {source: Carrier, target: haulier, basis: llm, evidence: names who brought it, approved: true}
unmapped_source_columns: warn
"""
LOT = "from pydantic import BaseModel\n\nclass TargetRow(BaseModel):\n    lot_no: str\n    duty_rate: float\n    landed: str\n    haulier: str\n    inspector: str | None = None\n"


def crosswalk(root: Path, excel: bool = False) -> Path:
    from sheafline.operators.drift import generate_fingerprint
    from sheafline.sources.xlsx import read_workbook

    root.mkdir(parents=True)
    write_workbook(str(root / "lots.xlsx"), {"Lots": LOTS})
    dump = lambda path, sheet: json.dumps(generate_fingerprint(read_workbook(str(path)), sheet, 1).model_dump())
    (root / "fingerprint.json").write_text(dump(root / "lots.xlsx", "Lots"))
    (root / "schema.py").write_text(LOT)
    text = MAPPING
    if excel:
        rows = [
            ["Lot No.", "Duty", "Landed", "Haulier", "Pallets"], ["A1", 0.04, "2023-05-01", "Gull Line", 12],
            [None, None, None, None, 3]
        ]
        write_workbook(str(root / "register.xlsx"), {"Register": rows, "Hints": [["stays"]]})
        fp = json.loads(dump(root / "register.xlsx", "Register"))
        fp["columns"] = fp["columns"][:4]
        (root / "warehouse_fingerprint.json").write_text(json.dumps(fp))
        text += "excel_target: {path: register.xlsx, first_data_col: A, last_data_col: D, column_order: [lot_no, duty_rate, landed, haulier]}\n"
    (root / "mapping.yaml").write_text(text)
    return root


def copy(root: Path, to: Path) -> Path:
    return Path(shutil.copytree(root, to))

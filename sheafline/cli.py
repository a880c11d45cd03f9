"""Command line. Exit codes: 0 done, 1 setup or usage, 2 a rule was broken, 3 drift, 4 lint."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys
from pathlib import Path

from pydantic import ValidationError
from pyspark.sql import SparkSession

from . import __version__
from .operators import crosswalk
from .operators.drift import FingerprintDrift
from .operators.profile import Profile, profile, to_json
from .operators.versions import Store, register_views
from .plans import artifact, mirror, recipes

STORE = "sheafline_store"


class Stop(Exception):
    def __init__(self, code: int, message: str) -> None:
        super().__init__(message)
        self.code = code


def session() -> SparkSession:
    spark = SparkSession.builder.appName("sheafline").config("spark.ui.enabled", "false").config(
        "spark.sql.session.timeZone", "UTC"
    ).config("spark.sql.caseSensitive", "true").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _emit(text: str, out: str | None) -> None:
    if out:
        Path(out).write_text(text + "\n")
    else:
        print(text)


def _profile(a: argparse.Namespace) -> None:
    try:
        _emit(to_json(profile(session(), a.source)), a.out)
    except (OSError, KeyError) as e:
        raise Stop(1, f"could not profile {a.source}: {e}") from None


def _drifted(e: FingerprintDrift) -> Stop:
    found = [
        {
            "kind": d.kind, "sheet": d.sheet, "column_position": d.column_position, "expected": d.expected,
            "found": d.found, "message": d.message()
        }
        for d in e.differences
    ]
    Path("drift_report.json").write_text(json.dumps({"differences": found}, indent=2, sort_keys=True) + "\n")
    return Stop(3, "\n".join(["DRIFT", *(d["message"] for d in found)]))


def _run(a: argparse.Namespace) -> None:
    spark = session()
    try:
        done = artifact.run(
            spark, a.artifact, a.input_file, Store(spark, a.store), a.as_of and dt.date.fromisoformat(a.as_of)
        )
    except FingerprintDrift as e:
        raise _drifted(e) from None
    except artifact.RuntimeCheckError as e:
        raise Stop(2, f"validation failed: {e}") from None
    print(f"run_id={done.run_id} rows_loaded={len(done.row_ids)}")


def _test(a: argparse.Namespace) -> None:
    found = artifact.run_golden_test(session(), a.artifact)
    if not found.ok:
        raise Stop(
            2,
            "\n".join(
                [
                    f"GOLDEN MISMATCH: {a.artifact}",
                    *(f"  {d}" for d in found.schema_differences + found.value_differences)
                ]
            )
        )
    print(f"golden test passed: {a.artifact}")


def _lint(a: argparse.Namespace) -> None:
    try:
        found = artifact.lint_artifact(a.artifact)
    except artifact.LintError as e:
        raise Stop(1, str(e)) from None
    if found:
        raise Stop(4, "\n".join([f"LINT FAILED: {a.artifact}", *(f"  {f.render()}" for f in found)]))
    print(f"lint passed: {a.artifact}")


def _suggest(a: argparse.Namespace) -> None:
    try:
        whole = Profile.model_validate_json(Path(a.client_profile).read_text())
        row = artifact.load_schema(Path(a.warehouse_schema), ("TargetRow",))
    except (OSError, ValidationError, artifact.ArtifactLoadError) as e:
        raise Stop(1, f"could not load inputs: {e}") from None
    named = [s for s in whole.sheets if a.sheet in (None, s.name)]
    if len(named) != 1:
        raise Stop(
            1,
            f"no sheet named {a.sheet!r} in {a.client_profile}" if a.sheet else f"{a.client_profile} has {len(named)} sheets; pass --sheet"
        )
    draft, rest = crosswalk.suggest(
        named[0], list(row.model_fields), target=a.target, key=a.key, unmapped_source_columns=a.unmapped_source_columns,
        synonyms=crosswalk.load_synonyms(a.synonyms_path)
    )
    _emit(crosswalk.to_yaml(draft), a.out)
    for p in rest:
        print(f"# still unmapped: {p.source!r} ({p.basis})", file=sys.stderr)


def _learn(a: argparse.Namespace) -> None:
    try:
        added, conflicts = crosswalk.learn(crosswalk.load_mapping(a.mapping_yaml), a.synonyms_path, a.force)
    except crosswalk.MappingLoadError as e:
        raise Stop(1, str(e)) from None
    print(f"added: {added}\nskipped_conflicts: {conflicts}")


def _mirror(a: argparse.Namespace) -> None:
    spark = session()
    try:
        done = mirror.mirror(spark, a.mapping_artifact, a.source_file, Store(spark, a.store), dry_run=not a.commit)
    except FingerprintDrift as e:
        raise _drifted(e) from None
    except mirror.MirrorError as e:
        raise Stop(2, str(e)) from None
    except crosswalk.MappingLoadError as e:
        raise Stop(1, str(e)) from None
    print(done.summary.render())
    if done.backup_path:
        print(f"backup: {done.backup_path}")


def _query(a: argparse.Namespace) -> None:
    try:
        recipe = recipes.find_recipe(a.recipes_dir, a.name)
        params = dict(p.split("=", 1) for p in a.param)
    except recipes.RecipeLoadError as e:
        raise Stop(1, str(e)) from None
    except ValueError as e:
        raise Stop(1, f"--param must be k=v: {e}") from None
    spark = session()
    register_views(Store(spark, a.store))
    try:
        print(recipes.render_rows(recipes.run_recipe(spark, recipe, params)))
    except recipes.QueryParamError as e:
        raise Stop(1, str(e)) from None
    except recipes.QueryShapeError as e:
        raise Stop(2, str(e)) from None


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sheafline", description="Governed file-to-table pipelines on Spark")
    p.add_argument("--version", action="version", version=__version__)
    commands = p.add_subparsers(dest="command", required=True)

    def command(name: str, run, *names: str, under=commands, **options: dict) -> argparse.ArgumentParser:
        c = under.add_parser(name)
        for n in names:
            c.add_argument(n)
        for n, o in options.items():
            c.add_argument("--" + n.replace("_", "-"), **o)
        c.set_defaults(run=run)
        return c

    store = {"default": STORE, "help": "folder of the tables"}
    command("profile", _profile, "source", out={})
    command("run", _run, "artifact", "input_file", as_of={"help": "ISO date, stored as given"}, store=store)
    command("test", _test, "artifact")
    command("lint", _lint, "artifact")
    maps = commands.add_parser("map").add_subparsers(dest="map_command", required=True)
    command(
        "suggest", _suggest, "client_profile", "warehouse_schema", under=maps, target={"required": True},
        key={"action": "append", "required": True}, sheet={},
        unmapped_source_columns={"choices": ("warn", "fail"), "default": "warn"}, synonyms_path={}, out={}
    )
    command("learn", _learn, "mapping_yaml", under=maps, synonyms_path={}, force={"action": "store_true"})
    command("mirror", _mirror, "mapping_artifact", "source_file", commit={"action": "store_true"}, store=store)
    command(
        "query", _query, "name", recipes_dir={"default": "recipes"}, store=store,
        param={"action": "append", "default": []}
    )
    return p


def main(argv: list[str] | None = None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return 1 if e.code else 0
    try:
        a.run(a)
    except Stop as e:
        print(e, file=sys.stderr)
        return e.code
    except Exception as e:  # noqa: BLE001  the contract gives everything else code 1
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0

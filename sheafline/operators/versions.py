"""Versioned tables as append-only Parquet logs.

A load appends rows; nothing is updated. Which run superseded a row is a window
over the log. A run is visible once its commit is written, so a load that breaks
off shows nothing.
"""

from __future__ import annotations

import datetime as dt
import re
import types
import typing
import uuid
from hashlib import sha256

from pydantic import BaseModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_TYPES = {
    str: T.StringType(), int: T.LongType(), float: T.DoubleType(), bool: T.BooleanType(), dt.date: T.StringType(),
    dt.datetime: T.StringType()
}
_META = {
    "runs": "run_id bigint, name string, version string, as_of string",
    "raw_files": "sha256 string, original_name string, run_id bigint",
    "lineage": "table_name string, row_id bigint, file_sha256 string, sheet string, start_row int, end_row int, pipeline_version string, run_id bigint",
    "validation_results": "run_id bigint, check_name string, status string, detail string",
    "commits": "run_id bigint, table_name string",
    "keys": "table_name string, key_columns array<string>",
}


def check_identifier(name: str) -> str:
    if not _IDENTIFIER.fullmatch(name):
        raise ValueError(f"not an identifier: {name!r}")
    return name


def columns_of(model: type[BaseModel]) -> T.StructType:
    """The stored columns of a row model. Dates are ISO text, so that text order is date order."""
    out = T.StructType()
    for name, field in model.model_fields.items():
        kinds = [field.annotation]
        if typing.get_origin(field.annotation) in (typing.Union, types.UnionType):
            kinds = [k for k in typing.get_args(field.annotation) if k is not type(None)]
        if len(kinds) != 1 or kinds[0] not in _TYPES:
            raise ValueError(f"unsupported type for column {name!r}: {field.annotation!r}")
        out.add(check_identifier(name), _TYPES[kinds[0]])
    return out


def sequenced(df: DataFrame, order: list[str], base: int, name: str, folder: str) -> DataFrame:
    """``df`` with ids base + 1, base + 2, ... in ``order``, without bringing the rows into one task.

    The rows are sorted once into ``folder``, which the result reads and its user may delete.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(
        "_at", F.monotonically_increasing_id()
    )
    placed.write.parquet(folder)
    placed = df.sparkSession.read.schema(placed.schema).parquet(folder).withColumn("_part", F.shiftright("_at", 33))
    offset, starts = base, []
    for part, rows in placed.groupBy("_part").count().orderBy("_part").collect():  # a row for each partition
        starts.append((part, offset))
        offset += rows
    known = df.sparkSession.createDataFrame(starts, "_part bigint, _start bigint")
    ids = (F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias(name)
    return placed.join(F.broadcast(known), "_part").select(ids, *df.columns)


class Store:
    """Tables, runs, lineage and raw files below one folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _read(self, path: str, schema: T.StructType | str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(path) if self._exists(path) else self.spark.createDataFrame([], schema)

    def meta(self, name: str) -> DataFrame:
        return self._read(f"{self.root}/meta/{name}", _META[name])

    def _note(self, name: str, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, _META[name]).coalesce(1).write.mode("append").parquet(f"{self.root}/meta/{name}")

    def register_run(self, name: str, version: str, as_of: dt.date | None = None) -> int:
        """A new run; ``as_of`` is stored as given and never taken from the clock."""
        run_id = (self.meta("runs").agg(F.max("run_id")).first()[0] or 0) + 1
        self._note("runs", [(run_id, name, version, as_of and as_of.isoformat())])
        return run_id

    def register_raw_file(self, data: bytes, original_name: str, run_id: int) -> str:
        """Keeps a file under its digest; of a file that comes twice, the last name counts."""
        digest = sha256(data).hexdigest()
        path = f"{self.root}/raw/{digest}"
        if not self._exists(path):
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            out = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(at, True)
            out.write(bytearray(data), 0, len(data))
            out.close()
        self._note("raw_files", [(digest, original_name, run_id)])
        return digest

    def raw_files(self) -> DataFrame:
        last = Window.partitionBy("sha256").orderBy(F.desc("run_id"))
        return self.meta("raw_files").withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")

    def record_validation_results(self, run_id: int, outcomes: list) -> None:
        if outcomes:
            self._note("validation_results", [(run_id, o.check_name, o.status, o.detail) for o in outcomes])

    def _log(self, table: str, columns: T.StructType, final: bool) -> DataFrame:
        schema = T.StructType(
            [
                T.StructField("row_id", T.LongType()), *columns.fields,
                *([T.StructField("_verification", T.StringType())] if final else []),
                T.StructField("_run_id", T.LongType())
            ]
        )
        done = self.meta("commits").where(F.col("table_name") == table).select(
            F.col("run_id").alias("_run_id")
        ).distinct()
        return self._read(
            f"{self.root}/tables/{check_identifier(table)}", schema
        ).join(F.broadcast(done), "_run_id", "left_semi")

    def _append(
        self, table: str, rows: DataFrame, log: DataFrame, run_id: int, order: list[str], digest: str, sheet: str,
        version: str
    ) -> range:
        base = log.agg(F.coalesce(F.max("row_id"), F.lit(0))).first()[0]
        work = f"{self.root}/_work/{uuid.uuid4().hex}"
        numbered = sequenced(rows, order, base, "row_id", work)
        numbered.drop("_src_row").write.mode("append").parquet(f"{self.root}/tables/{table}")
        where = F.col("_src_row").cast("int")
        lineage = numbered.select(
            F.lit(table).alias("table_name"),
            "row_id",
            F.lit(digest).alias("file_sha256"),
            F.lit(sheet).alias("sheet"),
            where.alias("start_row"),
            where.alias("end_row"),
            F.lit(version).alias("pipeline_version"),
            F.lit(run_id).cast("bigint").alias("run_id"),
        )
        lineage.write.mode("append").parquet(f"{self.root}/meta/lineage")
        count = numbered.count()
        self._note("commits", [(run_id, table)])
        at = self.spark._jvm.org.apache.hadoop.fs.Path(work)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        return range(base + 1, base + 1 + count)

    def load_final_rows(
        self, table: str, columns: T.StructType, key: list[str], rows: DataFrame, run_id: int, digest: str, sheet: str,
        version: str, verification: str = "TO_VERIFY", order: list[str] | None = None
    ) -> range:
        """Appends ``rows`` (the columns and _src_row) as new versions of their keys; returns the row ids."""
        check_identifier(table)
        known = self.meta("keys").where(F.col("table_name") == table).first()
        if known is None:
            self._note("keys", [(table, key)])
        elif list(known.key_columns) != list(key):
            raise ValueError(f"{table} has the key {known.key_columns}, not {key}")
        ready = rows.select(
            *[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in columns.fields],
            F.lit(verification).alias("_verification"), F.lit(run_id).cast("bigint").alias("_run_id"), "_src_row"
        )
        return self._append(
            table, ready, self._log(table, columns, True), run_id, order or ["_src_row", *columns.names], digest, sheet,
            version
        )

    def load_mirror_rows(
        self, table: str, columns: T.StructType, rows: DataFrame, run_id: int, digest: str, sheet: str, version: str
    ) -> range:
        """Appends rows; columns that are left out are null."""
        have = set(rows.columns)
        ready = rows.select(
            *[
                (F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in columns.fields
            ],
            F.lit(run_id).cast("bigint").alias("_run_id"), "_src_row"
        )
        return self._append(
            table, ready, self._log(table, columns, False), run_id, ["_src_row", *columns.names], digest, sheet, version
        )

    def final(self, table: str, columns: T.StructType, key: list[str]) -> DataFrame:
        """All versions, each with the run that superseded it."""
        return superseded(self._log(table, columns, True), key)

    def mirrored(self, table: str, columns: T.StructType) -> DataFrame:
        return self._log(table, columns, False)

    def with_lineage(self, rows: DataFrame, table: str) -> DataFrame:
        lineage = self.meta("lineage").where(F.col("table_name") == table).drop("table_name")
        return rows.join(
            lineage,
            (rows["row_id"] == lineage["row_id"]) & (rows["_run_id"] == lineage["run_id"])
        ).drop(lineage["row_id"])


def superseded(log: DataFrame, key: list[str]) -> DataFrame:
    """``log`` with _superseded_by_run_id: the run of the next row with the same key; a key with a null never matches."""
    after = F.lead("_run_id").over(Window.partitionBy(*key).orderBy("row_id"))
    whole = F.lit(True)
    for c in key:
        whole = whole & F.col(c).isNotNull()
    # Keys with a null stay out of the window, where they would meet in one task.
    alone = log.where(~whole).withColumn("_superseded_by_run_id", F.lit(None).cast("bigint"))
    return log.where(whole).withColumn("_superseded_by_run_id", after).unionByName(alone)


def active_rows(final: DataFrame) -> DataFrame:
    return final.where("_superseded_by_run_id IS NULL")


def rows_as_of(final: DataFrame, run_id: int) -> DataFrame:
    return final.where(
        (F.col("_run_id") <= run_id)
        & (F.col("_superseded_by_run_id").isNull() | (F.col("_superseded_by_run_id") > run_id))
    )


def register_views(store: Store) -> list[str]:
    """Temp views of all tables and of the meta tables, for recipes; returns their names."""
    keys = {x.table_name: x.key_columns for x in store.meta("keys").collect()}
    names = []
    for (table,) in store.meta("commits").select("table_name").distinct().collect():
        done = store.meta("commits").where(F.col("table_name") == table).select(
            F.col("run_id").alias("_run_id")
        ).distinct()
        log = store.spark.read.parquet(f"{store.root}/tables/{table}").join(F.broadcast(done), "_run_id", "left_semi")
        (superseded(log, keys[table]) if table in keys else log).createOrReplaceTempView(table)
        names.append(table)
    for view, frame in {
        "meta_runs": store.meta("runs"), "meta_lineage": store.meta("lineage"),
        "meta_validation_results": store.meta("validation_results"), "raw_files": store.raw_files()
    }.items():
        frame.createOrReplaceTempView(view)
        names.append(view)
    return sorted(names)

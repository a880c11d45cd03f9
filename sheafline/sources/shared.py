"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


#: Folders of sessions in one process that name none; the setting itself can't be changed once a session runs.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names.

    A session in one process that names none, as in tests, gets a temporary folder
    for its lifetime; on a cluster the setting has to be there.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        path = _own[app] = _own.get(app) or tempfile.mkdtemp(prefix="sheafline-")
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

"""Session defaults shared by the tests, the bench and the command line."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class NoSharedFolderError(RuntimeError):
    pass


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session, or the context's checkpoint folder. Only a local
    session may do without: it gets a folder of its own. On a cluster a missing folder is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise NoSharedFolderError("spark.checkpoint.dir is not set, and executors share no other folder")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='textlab-')}")
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """`df` written once to the shared folder and read back: for tables that a job reads more than once. They stay until the
    folder is cleaned, as checkpoints do."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/textlab/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def get_session(app: str = "textlab", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and Arrow; `conf` entries win over the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**defaults, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

"""Tables between the stages of an operator, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..sources.records import small_batches  # noqa: F401 - the operators take it from here


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only where it is unset and all tasks run on this machine, as in tests, is a temporary one set."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="llm-"))
    return context.getCheckpointDir().rstrip("/")


FREES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(frame: DataFrame, name: str, frees: bool = False) -> DataFrame:
    """The rows written as Parquet to the shared folder and read again: a lost executor costs no earlier stage. frees: what this write alone has shuffled goes as soon as it is done, not when the driver
    happens to collect its garbage."""
    path = f"{shared_folder(frame.sparkSession)}/{name}-{uuid.uuid4().hex}"
    conf = frame.sparkSession.conf
    before = conf.get(FREES, None)
    if frees:
        conf.set(FREES, "true")
    try:
        frame.write.parquet(path)
    finally:
        if frees:
            conf.unset(FREES) if before is None else conf.set(FREES, before)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def plain_columns(frame: DataFrame, *names: str) -> list[str]:
    """The columns of the input that stay; one that has the name of a result column is replaced by the result."""
    return [c for c in frame.columns if c not in names]

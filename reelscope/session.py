"""Session-level helpers: table access, size checks, durable intermediates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_STAGES: list[str] = []


#: Rows and bytes of an Arrow batch at most. A worker holds a batch several times over, as Arrow, as text and as result.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Python stages over it get small batches: their memory then depends neither on its rows nor on their length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def few(df: DataFrame, rows: int = 10_000) -> bool:
    """True if the table has no more than so many rows: then it may be broadcast."""
    return df.limit(rows + 1).count() <= rows


def settled(df: DataFrame) -> DataFrame:
    """The same rows, behind a step that expressions are not moved across.

    The optimizer copies an expression over a Python stage to every place that uses it; behind this step it is a column.
    """
    return df.withColumn("_settled", F.explode(F.array(F.lit(0)))).drop("_settled")


def work_dir(spark: SparkSession) -> str:
    """Shared folder for durable intermediates: ``spark.checkpoint.dir`` of the session."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Write an intermediate once and read it back: cuts lineage, survives lost executors, stays prunable."""
    spark = df.sparkSession
    path = f"{work_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGES.append(path)
    return spark.read.parquet(path)


def stages_made() -> list[str]:
    """Folders of the intermediates of this process that are not deleted yet, oldest first."""
    return list(_STAGES)


def stage_of(df: DataFrame) -> list[str]:
    """The folder of an intermediate that was just read back, whatever other threads have written meanwhile."""
    files = df.inputFiles()[:1]
    return [p for p in stages_made() if any(f"{p.rsplit('/', 1)[-1]}/" in f for f in files)]


def drop_stages(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete intermediates of this process, all by default. Call it once the results built on them are written."""
    for name in stages_made() if paths is None else [p for p in paths if p in _STAGES]:
        _STAGES.remove(name)
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

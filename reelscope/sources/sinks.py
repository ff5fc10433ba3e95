"""Durable outputs."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelscope.functions.text import text


def write_dataset(df: DataFrame, path: str, *, partition_by=(), fmt: str = "parquet") -> None:
    """Processed training table; partitioned on request."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_contract_json(df: DataFrame, path: str) -> None:
    """Nested result rows, one JSON object per line, nulls kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def chat_messages(df: DataFrame, system: str) -> DataFrame:
    """Adds ``messages`` (system, user, assistant) from input/output columns or their aliases."""
    have = set(df.columns)

    def first_of(names) -> Column:
        present = [F.nullif(text(n), F.lit("")) for n in names if n in have]
        return F.coalesce(*present, F.lit(""))

    user = first_of(("input", "prompt", "entrada"))
    answer = first_of(("output", "response", "respuesta"))

    def turn(role, content):
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return df.withColumn(
        "messages", F.array(turn("system", F.lit(system)), turn("user", user), turn("assistant", answer))
    )


def blank_pairs(df: DataFrame) -> DataFrame:
    """Rows whose user or assistant text is blank."""
    m = F.col("messages")
    return df.where((F.trim(m[1]["content"]) == "") | (F.trim(m[2]["content"]) == ""))


def write_chat_jsonl(df: DataFrame, path: str, is_val: str = "is_val") -> None:
    """Two folders of JSON lines, ``train`` and ``val``, holding the messages only."""
    for part, condition in (("train", ~F.col(is_val)), ("val", F.col(is_val))):
        df.where(condition).select("messages").write.mode("overwrite").json(f"{path}/{part}")


def save_model(model: PipelineModel, path: str, metadata: DataFrame | None = None) -> None:
    model.write().overwrite().save(f"{path}/model")
    if metadata is not None:
        metadata.write.mode("overwrite").json(f"{path}/metadata")


def load_model(spark: SparkSession, path: str, *, required: bool = False) -> PipelineModel | None:
    """The stored model, or None where none was stored (callers fall back to the heuristic).

    A model that is there and cannot be read is an error, as is a missing one if it is ``required``.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/model")
    if not required and not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return PipelineModel.load(f"{path}/model")


def write_metrics(df: DataFrame, path: str) -> None:
    """Small result tables as one CSV file with header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)

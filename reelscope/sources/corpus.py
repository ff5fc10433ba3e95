"""Catalogue CSVs, plain tables and transcript files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelscope.functions import text as T
from reelscope.functions.numeric import let
from reelscope.operators.dedup import union_by_name

#: Without ``multi_line`` a file is split among tasks; with it, quoted line breaks are read and a file is one task.
CSV_OPTIONS = {"header": True, "mode": "PERMISSIVE", "quote": '"', "escape": '"'}


def _csv_headers(spark: SparkSession, folder: str) -> dict[str, list[str]]:
    """Header line -> files of one folder in name order; only first lines are read, unreadable files are skipped."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = sorted((s.getPath() for s in fs.listStatus(path) if s.isFile()), key=lambda p: p.getName())
    headers: dict[str, list[str]] = {}
    for f in files:
        if not f.getName().lower().endswith(".csv"):
            continue
        try:
            stream = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(fs.open(f), "UTF-8"))
            header = (stream.readLine() or "").lstrip("\ufeff").strip()
            stream.close()
        except Exception:
            continue
        if header:
            headers.setdefault(header, []).append(f.toString())
    return headers


def read_corpus(spark: SparkSession, folder: str, multi_line: bool = False) -> DataFrame:
    """All CSV files of a folder in name order, outer-united by column name, with ``source_file``.

    Files that share a header are read by one scan.  Everything stays text:
    types are settled by the normalisation, not guessed per file.
    """
    by_header = _csv_headers(spark, folder)
    if not by_header:
        raise FileNotFoundError(f"no readable CSV file in {folder}")
    frames = [
        spark.read.options(**CSV_OPTIONS, multiLine=multi_line).csv(paths).select("*", F.col("_metadata.file_name").alias("source_file"))
        for paths in by_header.values()
    ]
    return union_by_name(frames)


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Single table scan; CSV needs a schema or stays text."""
    if path.rstrip("/").lower().endswith(".csv"):
        reader = spark.read.options(**CSV_OPTIONS)
        return (reader.schema(schema) if schema else reader).csv(path)
    return spark.read.parquet(path)


def parse_transcript(value: Column) -> Column:
    """Text of one transcript document in any of the accepted JSON shapes; blank when unreadable."""
    raw = F.trim(value)
    as_objects = F.from_json(raw, "array<struct<text:string>>")
    as_scalars = F.from_json(raw, "array<string>")
    doc = F.from_json(raw, "transcript string, text string, segments array<struct<text:string>>")
    keys = F.json_object_keys(raw)

    def has(k):
        return F.coalesce(F.array_contains(keys, k), F.lit(False))

    # An array element is an object with a text, or a plain scalar.
    both = F.struct(as_scalars.alias("plain"), as_objects.alias("objects"))
    joined = let(
        both,
        lambda b: F.array_join(
            F.transform(
                b["plain"],
                lambda x, i: F.when(
                    x.startswith("{"), F.coalesce(F.get(b["objects"], i)["text"], F.lit(""))
                ).otherwise(F.coalesce(x, F.lit("None"))),
            ),
            " ",
        ),
    )
    segments = F.array_join(F.transform(doc["segments"], lambda s: F.coalesce(s["text"], F.lit(""))), " ")
    text = (
        F.when(raw.startswith("["), joined)
        .when(has("transcript"), doc["transcript"])
        .when(has("text"), doc["text"])
        .when(has("segments"), segments)
    )
    valid = F.try_parse_json(raw).isNotNull()
    return F.when(valid, T.clean(text)).otherwise(F.lit(""))


def read_transcripts(spark: SparkSession, folder: str, lines: bool = False) -> DataFrame:
    """JSON transcripts of a folder: (video_id, transcript); empty and unreadable documents are dropped.

    One document a file: the id is the file's stem, or the folder's where files lie in folders ``video_id=...``, as a
    partitioned write leaves them. With ``lines`` a file holds any number of documents, an object with a ``video_id`` on
    each line, and is split among tasks: millions of documents then cost no file each to create, list and open.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    if lines:
        docs = files.text(folder).select(F.get_json_object("value", "$.video_id").alias("video_id"), "value")
    else:
        path = F.col("_metadata.file_path")
        dealt = F.url_decode(F.regexp_extract(path, r"/video_id=([^/]*)/[^/]*$", 1))
        stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
        name = F.when(dealt != "", dealt).otherwise(stem)
        docs = files.option("wholetext", True).text(folder).select(name.alias("video_id"), "value")
    return docs.select("video_id", parse_transcript(F.trim("value")).alias("transcript")).where(F.col("transcript") != "")

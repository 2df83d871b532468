"""Prompt folders, pattern libraries, price lists and benchmark records (S1-S3,
S7, S8, S11), by Spark's own readers, so any path that Spark can open will do."""

from __future__ import annotations

import functools
import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.text_ops import PROMPT_EXTENSIONS, detect_format

# Further extensions that the pattern-mining scan picks up.
MINING_EXTENSIONS = (*PROMPT_EXTENSIONS, "markdown", "hieratic", "hrt")
PATTERN_SCHEMA = "id string, content string, frequency long, avg_tokens long, category string"
#: Quotes are doubled, so that texts with quotes, commas and line breaks come back; an
#: empty text is written as "" and null as nothing.
CSV = {"header": "true", "escape": '"', "quote": '"'}
PRICE_SCHEMA = "provider string, model string, input_per_1k double, output_per_1k double"


def scan_files(spark: SparkSession, folder: str, extensions: Iterable[str] = PROMPT_EXTENSIONS) -> DataFrame:
    """(path, id, format, text) of every file below ``folder`` with one of
    the extensions in either case; ``id`` is the file's stem.  ``text`` is null
    for a file that isn't valid UTF-8 (see :func:`readable`); Spark's reader
    leaves out files of no bytes."""
    anywhere = ",".join("*." + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions)
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", "{" + anywhere + "}").load(folder).select("path", "content"))
    name = F.element_at(F.split("path", "/"), -1)
    wanted = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).isin(*extensions)
    rows = files.where(wanted).select("path", F.regexp_replace(name, r"(?<=.)\.[^.]*$", "").alias("id"),
                                      F.try_validate_utf8(F.col("content").cast("string")).alias("text"))
    return rows.select("path", "id", detect_format("text", "path").alias("format"), "text")


def readable(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readable files, paths of the unreadable ones to warn about)."""
    return files.where("text IS NOT NULL"), files.where("text IS NULL").select("path")


def scan_for_patterns(spark: SparkSession, folder: str) -> DataFrame:
    """The readable files for pattern mining; an empty folder is an error."""
    files, _ = readable(scan_files(spark, folder, MINING_EXTENSIONS))
    if files.isEmpty():
        raise ValueError(f"no prompt files in {folder}")
    return files


def read_prompt(spark: SparkSession, path: str) -> DataFrame:
    """S3: one file (or all files of a folder) as whole texts, (text)."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))


def json_layouts(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """(files of JSON lines, files that are one JSON document each).  A file holds JSON
    lines when its first line that isn't blank is a JSON value by itself."""
    lines = spark.read.text(path).where(F.trim("value") != "").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),  # grows within a block as the file does
        F.try_parse_json("value").isNotNull().alias("whole"))
    first = lines.groupBy("file").agg(F.min_by("whole", F.struct("block", "at")).alias("whole")).collect()
    return [r["file"] for r in first if r["whole"]], [r["file"] for r in first if not r["whole"]]


def _reader(spark: SparkSession, path: str, schema: str | None, fmt: str | None) -> DataFrame:
    """A file or folder, by the format or else the extension (Parquet without one).
    JSON is told apart file by file; fields that only some files have are null in the rest."""
    kind = fmt or (path.rstrip("/").rpartition(".")[2].lower() if "." in os.path.basename(path.rstrip("/")) else "parquet")

    def reader():
        return spark.read.schema(schema) if schema else spark.read

    if kind == "json":
        by_line, whole = json_layouts(spark, path)
        parts = [reader().json(by_line)] if by_line or not whole else []
        parts += [reader().option("multiLine", "true").json(whole)] if whole else []
        return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if kind == "csv":
        return reader().options(**CSV, multiLine="true", nullValue="\0null\0").csv(path)  # read in place of nothing
    return reader().parquet(path)


def load_patterns(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """A pattern library saved as Parquet, JSON or CSV (by extension)."""
    return _reader(spark, path, PATTERN_SCHEMA, fmt)


def save_patterns(lib: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Ids must be unique, or a later load could not tell patterns apart."""
    twice = lib.groupBy("id").count().where("count > 1")
    if not twice.isEmpty():
        raise ValueError(f"repeated pattern ids: {[r['id'] for r in twice.limit(5).collect()]}")
    write(lib.select(*[c.split()[0] for c in PATTERN_SCHEMA.split(", ")]), path, fmt)


def load_prices(spark: SparkSession, path: str | None = None, env: str | None = None,
                fmt: str | None = None) -> DataFrame:
    """Price overrides from a file, or from the file that the environment
    variable ``env`` names; neither given means no overrides."""
    path = path or (os.environ.get(env) if env else None)
    return _reader(spark, path, PRICE_SCHEMA, fmt) if path else spark.createDataFrame([], PRICE_SCHEMA)


def load_results(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Benchmark records, one row per run, from JSON documents with a ``results``
    array, or from what :func:`write` saved in any format."""
    df = _reader(spark, path, None, fmt)
    return df.select(F.explode("results").alias("r")).select("r.*") if "results" in df.columns else df


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """A result as Parquet, JSON lines or CSV (nested columns become JSON
    text in CSV)."""
    if fmt == "csv":
        flat = [F.to_json(c).alias(c) if t.startswith(("struct", "array", "map")) else F.col(c) for c, t in df.dtypes]
        df.select(*flat).write.mode(mode).options(**CSV, emptyValue='""', nullValue="", ignoreLeadingWhiteSpace="false",
                                                  ignoreTrailingWhiteSpace="false").csv(path)
    elif fmt == "json":
        df.write.mode(mode).option("ignoreNullFields", "false").json(path)
    elif fmt == "parquet":
        df.write.mode(mode).parquet(path)
    else:
        raise ValueError(f"unknown format {fmt}")

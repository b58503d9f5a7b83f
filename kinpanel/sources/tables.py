"""Reading and writing tables: projected scans, folders of delimited files, column dictionaries."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan(spark: SparkSession, path: str, columns: Sequence[str], fmt: str = "parquet",
         schema: T.StructType | str | None = None, **options: str) -> DataFrame:
    """Read only the named columns; for parquet the projection reaches the file reader."""
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path).select(*[F.col(f"`{c}`") for c in columns])


def scan_folder(spark: SparkSession, folder: str, schema: T.StructType | str, sep: str = ";",
                pattern: str = "*.csv", header: bool = True) -> DataFrame:
    """All delimited files of a folder as one scan with one schema."""
    return (
        spark.read.schema(schema).option("sep", sep).option("header", header)
        .option("pathGlobFilter", pattern).csv(folder)
    )


def write_delimited(df: DataFrame, folder: str, sep: str = ";") -> str:
    df.write.mode("overwrite").option("sep", sep).option("header", True).csv(folder)
    return folder


def save(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    """Persist a result as parquet, optionally in one folder per value so later filters skip folders."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return path


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def with_labels(df: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """Attach label texts to columns as schema metadata."""
    return df.select(*[
        F.col(f"`{c}`").alias(c, metadata={"label": labels[c]}) if c in labels else F.col(f"`{c}`")
        for c in df.columns])


def label_dictionary(df: DataFrame) -> DataFrame:
    """Dictionary (name, code) of a table: label text and column name, from the schema's metadata."""
    rows = [(f.metadata.get("label", f.name), f.name) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "name string, code string")


def ingest_labelled(df: DataFrame, folder: str) -> tuple[str, str]:
    """Store a labelled table as columnar data plus its dictionary; returns both paths."""
    data = save(df, f"{folder}/data")
    dictionary = save(label_dictionary(df).coalesce(1), f"{folder}/dictionary")
    return data, dictionary


def _signature(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of the files of a table, as one text; empty if there is none."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(conf)
    if not files.exists(root):
        return ""
    found, listed = [], files.listFiles(root, True)
    while listed.hasNext():
        status = listed.next()
        found.append(f"{status.getPath().getName()}:{status.getLen()}:{status.getModificationTime()}")
    return ",".join(sorted(found))


def ingest_folder(spark: SparkSession, folder: str, target: str, labels: Mapping[str, Mapping[str, str]],
                  fmt: str = "parquet", suffix: str = ".parquet", **options: str) -> DataFrame:
    """Store every table of a folder as columnar data with a dictionary of its own; returns the manifest.

    ``labels`` names the tables and the labels of their columns. The manifest (table, data, dictionary, signature, taken) is
    written last, so a folder without one, or whose manifest lacks a table, is half done. A rerun takes only the tables whose
    files changed since, each to a new folder, so what the old manifest names stays whole until the new one is there.
    """
    path = f"{target}/manifest"
    known = {}
    if _signature(spark, path):
        # one row per table
        known = {r["table"]: r for r in load(spark, path).collect()}
    rows = []
    for name in labels:
        source = f"{folder}/{name}{suffix}"
        signature = _signature(spark, source)
        old = known.get(name)
        if old is not None and old["signature"] == signature:
            rows.append((name, old["data"], old["dictionary"], signature, False))
            continue
        df = with_labels(spark.read.format(fmt).options(**options).load(source), labels[name])
        data, dictionary = ingest_labelled(df, f"{target}/{name}-{uuid.uuid4().hex}")
        rows.append((name, data, dictionary, signature, True))
    manifest = spark.createDataFrame(rows, "table string, data string, dictionary string, signature string, taken boolean").coalesce(1)
    save(manifest, path)
    return load(spark, path)


def columns_by_label(dictionary: DataFrame, pattern: str, present: Sequence[str] | None = None) -> list[str]:
    """Column names whose label matches ``pattern``; with ``present``, absent columns are left out.

    A dictionary has one row per column of a table, so collecting it is safe.
    """
    found = [r["code"] for r in dictionary.filter(F.col("name").rlike(pattern)).select("code").collect()]
    return [c for c in found if present is None or c in present]

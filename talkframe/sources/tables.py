"""JSON lines, JSON documents and report tables on shared storage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from talkframe.session import settle


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(line_no, line, file_id): all lines, numbered from 0 through all files in order of their names, as one reader would meet them.

    Files are read in splits. Each task numbers the lines of its splits while they pass; what earlier splits hold is summed on a table
    with one row per split and joined back, so no file is read by one task or shuffled.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, met = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            f, b = batch.column("f").dictionary_encode(), batch.column("b").to_numpy()
            code = f.indices.to_numpy()
            cut = np.flatnonzero((code[1:] != code[:-1]) | (b[1:] != b[:-1])) + 1
            at = np.empty(batch.num_rows, np.int64)
            for low, high in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows]):
                split = (f.dictionary[int(code[low])].as_py(), int(b[low]))
                met = met if split == last else 0
                at[low:high] = np.arange(met, met + high - low)
                last, met = split, met + high - low
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], names=["value", "f", "b", "at"])

    placed = lines.mapInArrow(number, "value string, f string, b long, at long")
    per = placed.groupBy("f", "b").agg((F.max("at") + 1).alias("n"))
    before = Window.orderBy("f", "b").rowsBetween(Window.unboundedPreceding, -1)  # one row per split
    starts = per.select("f", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return placed.join(starts, ["f", "b"]).select((F.col("start") + F.col("at")).alias("line_no"), F.col("value").alias("line"), F.col("f").alias("file_id"))


def numbered_jsonl(spark: SparkSession, path: str | list[str], schema: StructType | str) -> DataFrame:
    """One object per line with its ``line_no``; blank lines count but give no row, a malformed line raises."""
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    lines = read_lines(spark, path).filter(F.trim(F.regexp_replace("line", r"\s+", " ")) != "")
    return lines.select("line_no", F.from_json("line", kind, {"mode": "FAILFAST"}).alias("row")).select("line_no", "row.*")


def read_aligned(spark: SparkSession, paths: dict[str, str | list[str]]) -> DataFrame:
    """(line_no, one column per name) of files whose lines belong together; the shortest one ends the reading."""
    out = None
    for name, path in paths.items():
        lines = read_lines(spark, path).select("line_no", F.col("line").alias(name))
        out = lines if out is None else out.join(lines, "line_no")
    return out


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One object per line; blank lines are skipped, a malformed line raises."""
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.from_json("value", kind, {"mode": "FAILFAST"}).alias("row")).select("row.*")


def write_jsonl(df: DataFrame, path: str) -> str:
    """Committed as a whole: readers never see half a write."""
    df.write.mode("overwrite").json(path)
    return path


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def write_json(df: DataFrame, path: str) -> str:
    """One JSON array of all rows in one file, for small results; replaced as a whole."""
    body = df.select(F.to_json(F.struct("*")).alias("item")).agg(F.concat(F.lit("["), F.array_join(F.collect_list("item"), ",\n"), F.lit("]")).alias("value"))
    body.coalesce(1).write.mode("overwrite").text(path)
    return path


def write_report(tables: dict[str, DataFrame], path: str) -> str:
    """One parquet table per report section."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    return path


def read_report(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def write_bucketed(df: DataFrame, path: str, key: Column, buckets: int) -> str:
    """A message table in ``buckets`` partitions by ``key`` (a whole number or hash of the conversation), the layout ``erase_in_place`` needs."""
    df.withColumn(BUCKET, F.pmod(key, F.lit(buckets)).cast("int")).write.mode("overwrite").partitionBy(BUCKET).parquet(path)
    return path


BUCKET = "bucket"


def erase_in_place(spark: SparkSession, path: str, gone: DataFrame, key: Column, buckets: int, conversation: str = "conversation_id") -> list[int]:
    """Erase the conversations of ``gone`` from a bucketed table; returns the buckets that were rewritten.

    Only partitions that hold one of them are read and written again, all others keep their files. What stays is settled first, since a path
    can't be read and overwritten at once. A partition left empty is removed: dynamic overwriting alone would keep its old rows. At most
    ``buckets`` numbers pass the driver.
    """
    table = spark.read.parquet(path)
    listed = gone.select(conversation).distinct().withColumn(BUCKET, F.pmod(key, F.lit(buckets)).cast("int"))
    touched = table.join(listed, [BUCKET, conversation], "left_semi").select(BUCKET).distinct()
    touched = sorted(r[BUCKET] for r in touched.collect())
    if not touched:
        return []
    kept = settle(table.filter(F.col(BUCKET).isin(touched)).join(listed.select(conversation), conversation, "left_anti"), "kept")
    full = {r[BUCKET] for r in kept.select(BUCKET).distinct().collect()}
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    for b in set(touched) - full:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{BUCKET}={b}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return touched


def purge(spark: SparkSession, path: str) -> None:
    """Empty a table; its columns stay."""
    spark.createDataFrame([], spark.read.parquet(path).schema).write.mode("overwrite").parquet(path)

"""Tables on storage: reading the data folder, cutting lineage through the shared folder, sinks."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a temporary folder only if it has none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="faultlens-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_once(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Parquet at path; an error if something is there. The commit protocol makes it all or nothing."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, compressed: bool = False) -> None:
    writer = df.write.mode("errorifexists").option("header", True)
    (writer.option("compression", "gzip") if compressed else writer).csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def content_hash(df: DataFrame) -> str:
    """An order-free digest of a table's rows, to compare a table with its copy."""
    line = F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    n, total = df.select(F.conv(F.substring(F.sha2(line, 256), 1, 15), 16, 10).cast("decimal(38,0)").alias("h")).agg(F.count("h"), F.sum("h")).first()
    return f"{n}:{total or 0}"


def write_verified(df: DataFrame, path: str) -> DataFrame:
    """Write once, read back, and fail unless both hold the same rows."""
    write_once(df, path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    if content_hash(df) != content_hash(back):
        raise ValueError(f"{path} differs from what was written")
    return back


def publish_json(document: dict, path: str) -> None:
    """A JSON document on the driver, written once."""
    target = Path(path)
    with target.open("x") as f:
        json.dump(document, f, indent=2, sort_keys=True)


def report(title: str, rows: Sequence[dict]) -> str:
    """A Markdown table of a few rows."""
    if not rows:
        return f"# {title}\n\nNo rows.\n"
    names = list(rows[0])
    lines = [f"# {title}", "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    return "\n".join(lines + ["| " + " | ".join(str(r[n]) for n in names) + " |" for r in rows]) + "\n"

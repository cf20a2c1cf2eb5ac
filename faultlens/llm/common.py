"""Helpers the training-data operators share: tables, shared storage, words, ranges."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Java regular expression of the white space that parts words.
SPACE = r"[\x20\x09-\x0D]+"
#: Bytes of A-Z to a-z, all else unchanged.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's spark.checkpoint.dir; only a session without one (tests) gets a temporary
    folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="faultlens-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    This cuts the lineage: a lost executor costs a reread, not a recomputation, and a value that
    depends on row positions is computed once. options: of the Parquet writer.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.options(**{"compression": "zstd"} | options).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete stored() tables that nothing reads any more."""
    spark = tables[0].sparkSession
    for df in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    release(spark)


def release(spark: SparkSession) -> None:
    """Let the driver see which finished steps are out of use: only then does Spark delete their shuffle files."""
    gc.collect()
    spark._jvm.System.gc()


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


def ranged(df: DataFrame, *order: str) -> DataFrame:
    """df dealt by range and sorted, with its place: _part and _pos, the row's place within _part.

    Rows of one key spread over as many parts as they need, so that a hot key costs no long task.
    The result is stored, since places must not change between two uses.
    """
    keys = [F.col(c).asc_nulls_last() for c in order]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = placed.withColumn("_part", F.spark_partition_id()).withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    return stored(placed, "ranged")


def running(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """For each part of a ranged() table and each key in it: where the key's rows begin, and what earlier parts hold.

    Columns: _part, the keys, _first (least _pos), _before (the key's rows in earlier parts), and
    for each value v its sum over all parts as v_total. It has a row for each part and key in it,
    however many rows a key has.
    """
    per = df.groupBy("_part", *keys).agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n"), *[F.sum(v).alias(f"_{v}") for v in values])
    whole = Window.partitionBy(*keys)
    return per.select("_part", *keys, "_first", F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), *[F.sum(f"_{v}").over(whole).alias(f"{v}_total") for v in values])


def portions(column: pa.Array, most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges (from, to) of rows whose values have at most that many bytes together, or are one row: bounds what a worker holds by size, not by rows."""
    lo = total = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        if total and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(column):
        yield lo, len(column)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads each input bit over the whole word."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """64-bit digests of words, kept for as many words as MOST."""

    MOST = 150_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.MOST:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))

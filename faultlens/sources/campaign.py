"""Campaign, netlist, vector, observation and log sources with fixed schemas that fail on any deviation."""

from __future__ import annotations

import json
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultlens.functions.scalar import bit_kind, is_canonical_int
from faultlens.operators.rows import canonical

RAW = ["batch_id", "run_type", "site_selection", "selector", "site_id", "stuck_value", "vector_slot", "vector_id", "fault_enable", "cycles", "baseline_cycles", "timed_out", "activity", "detected", "unknown", "expected_digest", "actual_digest"]
#: The second schema version names each vector's partition.
RAW_2 = [RAW[0], "vector_partition", *RAW[1:]]
TEXT = {"run_type", "site_id", "expected_digest", "actual_digest", "vector_partition"}
CANONICAL = ["record_id", "vector_split", "batch_id", "run_type", "site_selection", "selector", "site_id", "stuck_value", "vector_slot", "vector_id", "fault_enable", "cycles", "baseline_cycles", "latency_delta", "timed_out", "activity", "detected", "unknown", "digest_hamming_distance", "expected_digest", "actual_digest"]
OBSERVATION = ["vector_slot", "vector_id", "actual_digest", "cycles", "timed_out"]


def schema(columns: Iterable[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType() if c in TEXT else T.LongType() if c == "record_id" else T.IntegerType()) for c in columns])


def read_strict(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV with this very header; a header, a number or a row of another form fails the query."""
    return spark.read.schema(schema(columns)).option("header", True).option("enforceSchema", False).option("columnPruning", False).option("mode", "FAILFAST").csv(path)


def non_canonical(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """(column, broken): texts in number columns that are not canonical integers, in one pass."""
    text = spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns])).option("header", True).option("enforceSchema", False).csv(path)
    numbers = [c for c in columns if c not in TEXT]
    counts = text.agg(*[F.count_if(~is_canonical_int(F.col(c))).alias(c) for c in numbers])
    return counts.selectExpr(f"stack({len(numbers)}, " + ", ".join(f"'{c}', {c}" for c in numbers) + ") as (column, broken)")


def read_campaign(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    return read_strict(spark, path, RAW if version == 1 else RAW_2)


def consolidate(raw: DataFrame) -> DataFrame:
    """Canonical rows with a record id in (batch, run type, site, fault, slot) order."""
    from faultlens.operators.relational import record_ids

    return record_ids(canonical(raw), "batch_id", ["run_type", "selector", "stuck_value", "vector_slot"]).select(*CANONICAL)


def read_canonical(spark: SparkSession, path: str) -> DataFrame:
    """Canonical rows from CSV (plain or gzip) or, for any size worth splitting, Parquet."""
    return spark.read.schema(schema(CANONICAL)).parquet(path) if path.endswith(".parquet") else read_strict(spark, path, CANONICAL)


def campaign_check(raw: DataFrame) -> DataFrame:
    """Per batch: rows, baselines, unknown values, detections without activity."""
    return raw.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("run_type") == "BASELINE").alias("n_baseline"), F.count_if(F.col("unknown") != 0).alias("n_unknown"), F.count_if((F.col("detected") == 1) & (F.col("activity") == 0)).alias("n_silent"))


def reference_suite(canonical_rows: DataFrame, steps: int = 64) -> DataFrame:
    """The fault-free run of the first batch in slot order: the golden observations."""
    first = canonical_rows.filter((F.col("batch_id") == 0) & (F.col("run_type") == "BASELINE"))
    return first.orderBy("vector_slot").limit(steps).select("vector_slot", "vector_id", "timed_out", "cycles", F.col("actual_digest").alias("digest"))


def load_json(path: str) -> dict:
    """A JSON object on the driver; a repeated key is an error."""

    def unique(pairs: list[tuple]) -> dict:
        out = dict(pairs)
        if len(out) != len(pairs):
            raise ValueError(f"{path} repeats a key")
        return out

    found = json.loads(Path(path).read_text(), object_pairs_hook=unique)
    if not isinstance(found, dict):
        raise ValueError(f"{path} is no object")
    return found


def find_rows(value: object, keys: set[str]) -> list[dict] | None:
    """The first list, depth first, whose first element is an object with all keys."""
    if isinstance(value, list) and value and isinstance(value[0], dict) and keys <= set(value[0]):
        return value
    for child in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
        if (found := find_rows(child, keys)) is not None:
            return found
    return None


NETLIST = "modules map<string, struct<ports: map<string, struct<direction: string, bits: array<string>>>, cells: map<string, struct<type: string, port_directions: map<string, string>, connections: map<string, array<string>>>>, netnames: map<string, struct<bits: array<string>>>>>"


def read_netlist(spark: SparkSession, path: str, module: str) -> dict[str, DataFrame]:
    """A synthesized module as tables: pins, drivers, inputs, outputs, nets.

    pins: (cell, cell_type, port, pin, kind, raw, bit); drivers: (bit, cell) and it is an error if a
    bit has two drivers or a cell two outputs; inputs, outputs: (bit, source_name, source_pin); nets:
    (bit, names), sorted. Bits keep their JSON form ('"x"' is a constant, 12 a wire).
    """
    text = spark.read.option("wholetext", True).text(path)
    # strings inside bit arrays keep their quotes, so that "1" and 1 differ
    marked = F.regexp_replace("value", r'"([01xz])"(?=\s*[,\]])', r'"\\"$1\\""')
    m = text.select(F.from_json(marked, NETLIST).alias("j")).select(F.col("j.modules")[module].alias("m"))
    cells = m.select(F.explode("m.cells").alias("cell", "c")).select("cell", F.col("c.type").alias("cell_type"), F.col("c.port_directions").alias("d"), F.explode("c.connections").alias("port", "bits")).select("cell", "cell_type", "port", F.col("d")[F.col("port")].alias("direction"), F.posexplode("bits").alias("pin", "raw"))
    cells = cells.withColumn("kind", bit_kind(F.col("raw"))).withColumn("bit", F.when(F.col("kind") == "wire", F.col("raw").cast("long")))
    pins = cells.filter("direction = 'input'").drop("direction")
    drivers = cells.filter("direction = 'output' and kind = 'wire'").groupBy("bit").agg(F.min("cell").alias("cell"), F.count(F.lit(1)).alias("n")).withColumn("bit", F.when(F.col("n") == 1, F.col("bit")).otherwise(F.raise_error(F.lit("a bit has two drivers")).cast("long"))).drop("n")
    ports = m.select(F.explode("m.ports").alias("source_name", "p")).select("source_name", "p.direction", F.posexplode("p.bits").alias("source_pin", "raw")).filter(bit_kind(F.col("raw")) == "wire").select(F.col("raw").cast("long").alias("bit"), "source_name", "source_pin", "direction")
    nets = m.select(F.explode("m.netnames").alias("name", "x")).select("name", F.explode("x.bits").alias("raw")).filter(bit_kind(F.col("raw")) == "wire").groupBy(F.col("raw").cast("long").alias("bit")).agg(F.array_sort(F.collect_set("name")).alias("names"))
    return {"pins": pins, "drivers": drivers, "inputs": ports.filter("direction = 'input'").drop("direction"), "outputs": ports.filter("direction = 'output'").drop("direction"), "nets": nets}


def read_vectors(spark: SparkSession, pool_path: str, selected: list[int], split: str) -> DataFrame:
    """The selected vectors of one split with their slots, in the order of selection; a foreign or unknown id fails."""
    pool = spark.read.option("multiLine", True).json(pool_path)
    if "vectors" in pool.columns:
        pool = pool.select(F.explode("vectors").alias("v")).select("v.*")
    slots = spark.createDataFrame(list(enumerate(selected)), "vector_slot int, vector_id int")
    met = slots.join(pool.filter(F.col("split") == split), "vector_id", "left")
    return met.withColumn("split", F.coalesce("split", F.raise_error(F.lit(f"a vector is not of split {split}")).cast("string")))


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of profile groups."""
    return spark.read.schema("profile_sha256 string, matches_no_fault boolean, fault_instances array<string>").json(path)


#: An observation file is read whole up to this size.
OBSERVATION_BYTES = 256 * 1024


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """One case's observations: a small file with this very header."""
    file = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
    if file > OBSERVATION_BYTES:
        raise ValueError(f"{path} has {file} bytes")
    fields = T.StructType([T.StructField(c, T.StringType() if c == "actual_digest" else T.IntegerType()) for c in OBSERVATION])
    return spark.read.schema(fields).option("header", True).option("enforceSchema", False).option("columnPruning", False).option("mode", "FAILFAST").csv(path)


def read_log(spark: SparkSession, path: str, patterns: dict[str, str]) -> DataFrame:
    """(path, field, value): the first group of each pattern, line by line."""
    lines = spark.read.text(path).withColumn("path", F.input_file_name())
    found = [lines.select("path", F.lit(k).alias("field"), F.regexp_extract("value", p, 1).alias("value")).filter("value <> ''") for k, p in patterns.items()]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of every file: the ledger that later reads are checked against."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))

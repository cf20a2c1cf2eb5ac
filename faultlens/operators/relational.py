"""Checked joins, coverage, roll-ups, set comparisons, ranks and splits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultlens.operators.ranks import positions

SPLIT_SEED = "group-split-v1"


def reference_mismatch(facts: DataFrame, reference: DataFrame, keys: Sequence[str], agree: Sequence[str]) -> DataFrame:
    """One row: facts without a reference row, and facts that differ from theirs in any `agree` column."""
    right = reference.select(*keys, *[F.col(c).alias(f"_{c}") for c in agree], F.lit(1).alias("_found"))
    met = facts.join(right, list(keys), "left")
    differs = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in agree], F.lit(False))
    found = F.col("_found").isNotNull()
    return met.agg(F.count(F.lit(1)).alias("n_facts"), F.sum((~found).cast("long")).alias("n_unmatched"), F.sum((found & differs).cast("long")).alias("n_different"))


def both_ways(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys on both sides, only left, only right."""
    a, b = left.select(key).distinct().withColumn("_l", F.lit(1)), right.select(key).distinct().withColumn("_r", F.lit(1))
    met = a.join(b, key, "full_outer")
    return met.agg(F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("n_both"), F.count_if(F.col("_r").isNull()).alias("n_left_only"), F.count_if(F.col("_l").isNull()).alias("n_right_only"))


def unmatched(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right.select(*keys).distinct(), list(keys), "left_anti")


def overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on both sides: empty if the sides are disjoint."""
    return left.select(key).intersect(right.select(key))


def set_difference_sizes(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: rows of left not in right and the reverse, as multisets; equal tables give 0 and 0."""
    n = F.count(F.lit(1))
    return left.exceptAll(right).agg(n.alias("left_only")).crossJoin(F.broadcast(right.exceptAll(left).agg(n.alias("right_only"))))


def expected_cases(*dimensions: DataFrame) -> DataFrame:
    """The Cartesian product of dimensions (small by their nature: a fixed plan of cases)."""
    return reduce(lambda a, b: a.crossJoin(b), dimensions)


def coverage_gaps(facts: DataFrame, cases: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected cases that no fact has."""
    return cases.join(facts.select(*keys).distinct(), list(keys), "left_anti")


def repeated_keys(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    return facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def incomplete_groups(facts: DataFrame, group: Sequence[str], case: Sequence[str], expected: Column | int) -> DataFrame:
    """Groups whose distinct cases are not as many as expected, or whose cases repeat."""
    g = facts.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(*case).alias("cases"))
    want = F.lit(expected) if isinstance(expected, int) else expected
    return g.filter((F.col("cases") != want) | (F.col("n") != F.col("cases")))


def closure(facts: DataFrame, levels: Sequence[str], measures: dict[str, Column]) -> DataFrame:
    """Totals at every level from detail to whole, with the level's number (grouping_id)."""
    return facts.rollup(*levels).agg(F.grouping_id().alias("level"), *[m.alias(n) for n, m in measures.items()])


def ranked_split(groups: DataFrame, key: str, parts: dict[str, int], seed: str = SPLIT_SEED) -> DataFrame:
    """Distinct groups ranked by sha256(seed|key), then key, and cut into exact slices.

    parts: name to number of groups, in order; groups beyond all slices are an error of the caller
    and get a null partition. Result: key, partition, partition_rank (from 1, in hash order),
    split_hash. Slices are ranges of the rank, so ranks inside them need no further sort.
    """
    hashed = groups.select(key).distinct().withColumn("split_hash", F.sha2(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")), 256))
    ranked = positions(hashed, [F.col("split_hash").asc(), F.col(key).asc()], "_place")
    case = first = None
    below = 0
    for name, size in parts.items():
        inside = F.col("_place") < below + size
        case = F.when(inside, name) if case is None else case.when(inside, name)
        first = F.when(inside, below) if first is None else first.when(inside, below)
        below += size
    return ranked.select(key, case.alias("partition"), (F.col("_place") - F.coalesce(first, F.lit(below)) + 1).cast("int").alias("partition_rank"), "split_hash")


def partition_statistics(facts: DataFrame, split: DataFrame, key: str, target: Column) -> DataFrame:
    """Per partition: groups, rows, positives, prevalence to six places (rounded as millionths, as SQL engines do: 41/640 is 0.064062)."""
    met = facts.join(split.select(key, "partition"), key)
    return met.groupBy("partition").agg(F.countDistinct(key).alias("n_groups"), F.count(F.lit(1)).alias("n_rows"), F.sum(target.cast("long")).alias("n_positive")).withColumn("prevalence", F.round(F.col("n_positive") / F.col("n_rows") * 1e6) / 1e6)


def record_ids(df: DataFrame, batch: str, order: Sequence[str], name: str = "record_id") -> DataFrame:
    """Zero-based ids that run on over batches in (batch, order): numbered inside a batch, then shifted.

    No task sees more than one batch; the shifts have a row per batch.
    """
    sizes = df.groupBy(batch).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(F.col(batch).alias("_batch"), F.coalesce(F.sum("_n").over(Window.orderBy(batch).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    inside = F.row_number().over(Window.partitionBy(batch).orderBy(*order))
    return df.withColumn("_in", inside).join(before, F.col(batch).eqNullSafe(F.col("_batch"))).withColumn(name, F.col("_in") - 1 + F.col("_off")).drop("_in", "_off", "_batch")


def is_contiguous(df: DataFrame, column: str) -> DataFrame:
    """One row: whether the column holds each number from 0 to n - 1 once."""
    return df.agg(F.coalesce((F.min(column) == 0) & (F.max(column) - F.min(column) + 1 == F.count(F.lit(1))) & (F.countDistinct(column) == F.count(F.lit(1))), F.lit(True)).alias("contiguous"), F.count(F.lit(1)).alias("n"))


def commitment(df: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """SHA-256 over the ordered lines of a bounded table (a manifest, a catalogue): one row."""
    line = F.concat_ws("|", *[F.col(c).cast("string") for c in columns])
    rows = df.agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))).alias("rows"))
    return rows.select(F.sha2(F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), 256).alias("commitment"))


def row_set_hash(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """An order-free commitment of a table of any size: the count and the sum of row digests."""
    digest = F.conv(F.substring(F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(digest).alias("digest_sum"))


def best_row(df: DataFrame, order: Sequence[Column], limit: int = 1) -> DataFrame:
    """The first rows of a total order: only the best of each part meet."""
    return df.orderBy(*order).limit(limit)


def least_member(df: DataFrame, group: str, member: str, rank: Sequence[Column] | None = None, k: int = 1) -> DataFrame:
    """The k first members of each group."""
    w = Window.partitionBy(group).orderBy(*(rank or [F.col(member)]))
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def even_probes(df: DataFrame, position: str, count: int, total: int) -> DataFrame:
    """Rows at `count` evenly spaced positions from 0 to total - 1."""
    wanted = df.sparkSession.range(count).select(F.floor(F.col("id") * F.lit((total - 1) / max(1, count - 1))).cast("long").alias(position)).distinct()
    return df.join(F.broadcast(wanted), position, "left_semi")


def vocabulary(df: DataFrame, column: str) -> DataFrame:
    """Distinct values with codes from 0 in value order."""
    return df.select(column).distinct().withColumn("code", F.row_number().over(Window.orderBy(column)) - 1)


def batch_plan(n_sites: int, batch_size: int) -> list[dict]:
    """Batches of consecutive sites; the last one may be smaller."""
    return [{"batch_id": b, "first_site": b * batch_size + 1, "sites": min(batch_size, n_sites - b * batch_size)} for b in range(-(-n_sites // batch_size))]

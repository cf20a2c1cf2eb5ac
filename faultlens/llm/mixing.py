"""Mixing sources to target weights by systematic sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultlens.llm.common import ranged, running, stored

#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: A source is taken at most so many times.
REPEATS = 3
SEED = "mix-1"
#: Offsets tried for a source, equally spaced from its random one.
OFFSETS = 32


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def offset(source: Column, seed: str = SEED) -> Column:
    """The source's random offset in [0, 1): the same in every run."""
    digest = F.sha2(F.concat(F.lit(f"{seed}|"), F.coalesce(F.concat(F.lit("="), source), F.lit(""))), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def targets(sources: DataFrame) -> DataFrame:
    """Adds target: each source's share of all sizes by weight, at most REPEATS times its own size.

    sources: source_size and weight. What a source cannot take goes to the others by weight, until
    none is above. Sharing by weight keeps all open sources at one level (words a unit of weight),
    so that a round needs one row on the driver: the level of the sources still open. Each round
    closes those that the level overfills.
    """
    cap, closed, level = F.col("source_size") * REPEATS, None, -1.0
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    while True:
        shut = F.lit(False) if closed is None else closed
        full, open_weight = sources.agg(F.sum(F.when(shut, cap)), F.sum(F.when(~shut, F.col("weight")))).first()
        if not open_weight or (now := (total - (full or 0)) / open_weight) <= level:
            break
        level = now
        closed = F.lit(level) * F.col("weight") > cap
    return sources.withColumn("target", F.least(cap.cast("double"), F.lit(max(level, 0.0)) * F.col("weight")))


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """How often a mix of sources to target weights takes each document.

    docs: doc_id, text, source. Result, a row per row of docs: doc_id, source, size (words),
    source_size, target (its source's), copies, taken (copies * size).
    A document is expected target / source_size times. In each source, documents stand by size, then
    doc_id; the expected copies are summed up along that order from one random offset, and a
    document is emitted once for each integer the sum passes. Order by size keeps a source's words
    within the largest document of its target; of OFFSETS turns of the random offset, the one that
    comes nearest is used. A null source is one source, after all others; a null
    or empty text has size 0; a source of no words has target 0 and copies 0; rows that repeat a
    doc_id are documents of their own; no rows give no rows; other columns are ignored.

    Documents are ranked by range parts: no source meets in one task. What is gathered has a row for
    each part and source.
    """
    sized = docs.select(F.col("doc_id"), F.col("source"), size_of(F.col("text")).alias("size"))
    placed = ranged(sized, "source", "size", "doc_id")
    parts = stored(running(placed, ["source"], ["size"]), "parts")
    sources = parts.groupBy("source").agg(F.first("size_total").alias("source_size"), F.min("_part").alias("_part"))
    # code point rank: parts hold ranges of sources, so ranks add up part by part
    inside = sources.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())))
    before = inside.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    rank = inside.join(before, "_part").withColumn("_rank", F.col("_in") + F.col("_off") - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("_rank") % len(WEIGHTS) + 1).cast("int"))
    shares = targets(stored(rank.select("source", "source_size", weight.alias("weight")), "sources")).withColumnRenamed("source", "_source")
    parts = parts.drop("size_total").join(shares, F.col("source").eqNullSafe(F.col("_source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    parts = parts.select(F.col("_part").alias("_p"), "_source", "_first", "_before", "source_size", "target", rate.alias("_rate"), offset(F.col("_source"), seed).alias("_u"))
    placed_in = lambda p: placed.join(p, (F.col("_part") == F.col("_p")) & F.col("source").eqNullSafe(F.col("_source")))
    n = (F.col("_pos") - F.col("_first") + F.col("_before") + 1).cast("double")
    whole, part = F.floor("_rate"), F.col("_rate") - F.floor("_rate")
    copies = lambda u: (whole + F.floor(u + part * n) - F.floor(u + part * (n - 1))).cast("long")
    # the offset is drawn from OFFSETS equally spaced ones: the one whose words come nearest to the target
    turn = lambda k: F.col("_u") + F.lit(k / OFFSETS)
    parts = stored(parts, "parts")
    trial = placed_in(parts).groupBy("_source").agg(F.first("target").alias("t"), *[F.sum(copies(turn(k)) * F.col("size")).cast("double").alias(f"w{k}") for k in range(OFFSETS)])
    errors = F.array(*[F.struct(F.abs(F.col(f"w{k}") - F.col("t")).alias("e"), F.lit(k).alias("k")) for k in range(OFFSETS)])
    best = trial.select(F.col("_source").alias("_s"), F.array_min(errors)["k"].alias("_k"))
    chosen = parts.join(best, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("_u", F.col("_u") + F.col("_k") / F.lit(float(OFFSETS)))
    out = placed_in(chosen).withColumn("copies", copies(F.col("_u")))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mix itself: a row for each emitted copy, with copy (from 1)."""
    return mix(docs, seed).filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))

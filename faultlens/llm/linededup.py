"""Line de-duplication by an exact set-similarity join, in DataFrame operations only.

Tokens are ordered by rarity, and lines meet by adjacent pairs of their rarest tokens: prefix
filtering with keys of two tokens, where no single frequent token gathers lines that are unlike.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.llm import common
from faultlens.llm.common import discard, ranged, release, running

#: The token count table has a bucket for each BUCKET_WORDS words, within these bounds, as a power of two. It goes to every task, one byte a bucket.
BUCKET_WORDS, LEAST_BUCKETS, MOST_BUCKETS = 4, 1 << 12, 1 << 21
#: Bits of the filter that spares lines of no candidate pair the shuffle; false positives do no harm.
FILTER_BITS = 1 << 23
#: Jaccard threshold, as a fraction, so that all bounds are whole numbers.
NUM, DEN = 4, 5
#: Bits of 64 that an odd number of a line's words fall on: of all words, and of those whose digest has its sign bit. A shift takes the low six bits of its count.
EVERY, SIGNED = "aggregate(hs, 0L, (acc, h) -> acc ^ shiftleft(1L, h))", "aggregate(hs, 0L, (acc, h) -> acc ^ shiftleft(cast(shiftrightunsigned(h, 31) as long), h))"
PARITY = f"{EVERY} as m0, {SIGNED} as m1"
MAP = [f"m{k}" for k in range(2)]
#: Words above which a line has both maps: on fewer, the first alone tells nearly all unlike lines apart.
LONG = 64
#: Whether a line has words: most begin with one, which needs no regular expression.
WORDED = r"({0} >= '!' or {0} rlike r'[^\x20\x09-\x0D]')"
#: Bits of the parity map in a key row, and the largest number of words beside it.
MAP_BITS = 52
MAP_MASK, MOST_N = (1 << MAP_BITS) - 1, (1 << 63 - MAP_BITS) - 1
#: Key rows of a task.
KEY_ROWS = 250_000
#: Bits of a code below the rarity level.
CODE_BITS = 24
ADDED = ("removed", "kept_text", "n_lines")


def stored(df: DataFrame, name: str) -> DataFrame:
    """common.stored, with the step's shuffle files deleted when it ends, not when the driver happens to collect its garbage.

    Without dictionaries, which the many digests outgrow: columns that begin with one cost more to write and to read.
    Arrays have no group around each element, as in the older of Parquet's forms, which costs half as much to write.
    """
    conf = df.sparkSession.conf
    before = {key: conf.get(key, None) for key in ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.parquet.writeLegacyFormat")}
    for key in before:
        conf.set(key, "true")
    try:
        return common.stored(df, name, **{"parquet.enable.dictionary": "false"})
    finally:
        for key, value in before.items():
            conf.unset(key) if value is None else conf.set(key, value)


def words(text: str) -> str:
    """SQL of the words of a text without line feeds; splitting by a single space needs no regular expression, and most texts no removal of empty words."""
    other = " or ".join(f"contains({text}, '{c}')" for c in (r"\t", r"\u000B", r"\f", r"\r"))
    empty = f"{text} = '' or startswith({text}, ' ') or endswith({text}, ' ') or contains({text}, '  ')"
    return rf"if({other} or {empty}, array_remove(split(regexp_replace({text}, '[\\t\\x0B\\f\\r]', ' '), ' '), ''), split({text}, ' '))"


def token_lines(texts: DataFrame, bits: int) -> DataFrame:
    """(rank, k1, k2, hs): every line with words, two digests of it, and a digest of each distinct word."""
    # not by the size of hs: a filter below the projection would make all digests twice
    worded = line_rows(texts, bits).filter(WORDED.format("line"))
    return worded.select("rank", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), F.col("line")).alias("k2"), F.expr(f"transform(array_distinct({words('line')}), w -> hash(w))").alias("hs"))


def token_levels(lines: DataFrame, buckets: int) -> DataFrame:
    """One row: for each bucket of the words' digests how frequent its words are, as an array of bytes.

    0 means in one line only; above, four levels to each doubling of the count over all lines.
    """
    # a row more for each bucket, so that none is missing and none need be joined
    every = lines.sparkSession.range(0, buckets).select(F.col("id").cast("int").alias("b"))
    counts = lines.select(F.explode("hs").alias("h")).select(F.expr(f"h & {buckets - 1}").alias("b")).unionAll(every).groupBy("b").agg((F.count(F.lit(1)) - 1).alias("n"))
    level = F.when(F.col("n") < 2, 0).otherwise(F.least(F.lit(127), F.floor(4 * F.log2("n"))))
    full = counts.select(F.shiftright("b", 10).alias("hi"), (F.shiftleft("b", 7) + level.cast("int")).alias("x"))
    rows = full.groupBy("hi").agg(F.expr("transform(sort_array(collect_list(x)), x -> cast(x & 127 as tinyint))").alias("part"))
    return rows.agg(F.expr("flatten(transform(array_sort(collect_list(struct(hi, part))), x -> x.part))").alias("levels"))


def prefixed(lines: DataFrame, levels: DataFrame, buckets: int) -> DataFrame:
    """(k1, k2, rank, n, tokens, m0, m1): distinct words, the rarest of them in order, and parity bit maps.

    A token's code is its level before bits of its digest: codes ascend with frequency, and any fixed
    order of all tokens keeps prefix filtering exact, as does one code for two tokens.

    Of two lines at the threshold, with n and m words, at least o = ceil(4/9 (n + m)) are shared and u =
    n + m - 2 o are not. In the common order the u part the shared ones into u + 1 runs at most, and
    o > u + 1, so two shared tokens follow each other directly, in both lines. Before the first such
    pair each shared token is followed by one that isn't: the pair begins at place 2 (n - o) + (m - o)
    at most, which is no more than 2/5 n. So the pairs of neighbours that begin by there are keys that any
    two such lines have in common. A line of one word has that word twice.
    """
    view = f"levels_{uuid.uuid4().hex}"
    levels.createOrReplaceTempView(view)
    lines.createOrReplaceTempView(view + "_lines")
    # the scalar subquery brings the table to the tasks once, as a value of bounded size, and is read in place; a generator above it would copy it into each row
    # coalesce: an array that can't hold null is sorted as one of primitive values
    code = f"coalesce(shiftleft(cast(levels[h & {buckets - 1}] as int), {CODE_BITS}) | shiftrightunsigned(h, {32 - CODE_BITS}), 0)"
    maps = f"{EVERY} as m0, if(size(hs) > {LONG}, {SIGNED}, 0L) as m1"
    coded = lines.sparkSession.sql(f"select k1, k2, rank, size(hs) as n, {maps}, sort_array(transform(hs, h -> {code})) as codes from (select *, (select levels from {view}) as levels from {view}_lines)")
    return coded.select("k1", "k2", "rank", "n", *MAP, F.expr("if(n = 1, concat(codes, codes), slice(codes, 1, 2 * n div 5 + 2))").alias("tokens"))


def numbered(docs: DataFrame) -> tuple[DataFrame, int]:
    """docs with _num, which ascends with doc_id, and the bits that a line number needs beside it.

    _num is doc_id less the smallest one; if that leaves no room for line numbers in a long, it is the
    place of doc_id among all.
    """
    bits = 31
    lo, hi = docs.filter("doc_id is not null").agg(F.min("doc_id"), F.max("doc_id")).first()
    if lo is None or hi - lo < 1 << 32:
        return docs.withColumn("_num", F.expr(f"doc_id - {lo or 0}L").cast("long")), bits
    bits = ((docs.agg(F.max(F.octet_length("text"))).first()[0] or 0) + 1).bit_length()
    if hi - lo < 1 << (61 - bits):
        return docs.withColumn("_num", F.expr(f"doc_id - {lo}L").cast("long")), bits
    ids = ranged(docs.filter("doc_id is not null").select("doc_id").distinct(), "doc_id")
    dense = ids.join(running(ids, [], []), "_part").select(F.col("doc_id").alias("_doc"), (F.col("_pos") - F.col("_first") + F.col("_before")).alias("_num"))
    return docs.join(dense, F.col("doc_id") == F.col("_doc"), "left").drop("_doc"), bits


def _tests(a: str, b: str) -> str:
    """The tests that no pair at the threshold fails: length and bit maps, of which two long lines have both."""
    total = f"({a}.n + {b}.n)"
    least = f"cast(({NUM} * {total} + {NUM + DEN - 1}) div {NUM + DEN} as int)"
    return f"{DEN} * least({a}.n, {b}.n) >= {NUM} * greatest({a}.n, {b}.n) and bit_count({a}.m0 ^ {b}.m0) <= {total} - 2 * {least} and (least({a}.n, {b}.n) <= {LONG} or bit_count({a}.m0 ^ {a}.m1 ^ {b}.m0 ^ {b}.m1) + bit_count({a}.m1 ^ {b}.m1) <= {total} - 2 * {least})"


def keys_of(classes: DataFrame, *columns: str) -> DataFrame:
    """(key, columns) for each key of each line; keys of a token counted once are in one line only and left out."""
    pairs = classes.selectExpr(*columns, "tokens", "posexplode(slice(tokens, 1, size(tokens) - 1)) as (i, x)").filter(f"x >= {1 << CODE_BITS}")
    return pairs.select(F.expr("shiftleft(cast(x as long), 32) | tokens[i + 1]").alias("key"), *columns)


def shared_keys(classes: DataFrame, tokens: int) -> DataFrame:
    """(key): keys of two lines or more that may match.

    A row carries its line's number of words, up to MOST_N, above a parity map of all its words. Of a
    key with just two rows, which most chance meetings are, the least and greatest are both of them, and
    lines that can't match go. tokens: words of all lines, from which the
    number of tasks follows.
    """
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    folded = f"m0 & {MAP_MASK}L ^ shiftrightunsigned(m0, {MAP_BITS})"
    rows = keys_of(classes.withColumn("w", F.expr(f"shiftleft(cast(least(n, {MOST_N}) as long), {MAP_BITS}) | ({folded})")), "w")
    rows = rows.repartition(max(parts, 2 * tokens // (5 * KEY_ROWS)), "key")
    per = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("w").alias("a"), F.max("w").alias("b"))
    per = per.selectExpr("key", "c", f"shiftrightunsigned(a, {MAP_BITS}) as lo", f"shiftrightunsigned(b, {MAP_BITS}) as hi", f"(a ^ b) & {MAP_MASK}L as d")
    alike = f"{DEN} * lo >= {NUM} * hi and bit_count(d) <= lo + hi - 2 * (({NUM} * (lo + hi) + {NUM + DEN - 1}) div {NUM + DEN})"
    return per.filter(f"c > 2 or c = 2 and (hi = {MOST_N} or {alike})").select("key")


def met(a: DataFrame, b: DataFrame, key: str, test: str) -> DataFrame:
    """Rows of a that pass the test with a row of b of the same key: each at most once, whatever it meets."""
    return a.alias("a").join(b.alias("b"), F.expr(f"a.{key} = b.{key} and {test}"), "left_semi")


def members(classes: DataFrame, tokens: int) -> DataFrame:
    """(cls, head, n, m0, m1): a line that passes the tests with another of the same key, and a name of each group of such lines.

    A bit table of fixed size, of the keys that lines may share, spares most key rows the shuffle; then
    each meets the others of its key until one passes. A group is named by its first line, so that the
    many keys of one set of near copies are one group.
    """
    bits = stored(bit_table(shared_keys(classes, tokens).select(F.xxhash64("key").alias("_key")), "_key"), "bits")
    release(classes.sparkSession)
    rows = with_bit(keys_of(classes, "cls", "n", *MAP).withColumn("_key", F.xxhash64("key")), bits, "_key").filter("_bit").select("key", "cls", "n", *MAP)
    near = stored(met(rows, rows, "key", f"a.cls <> b.cls and {_tests('a', 'b')}"), "near")
    heads = near.groupBy("key").agg(F.min("cls").alias("head"))
    return near.join(heads, "key").select("cls", "head", "n", *MAP).distinct()


def bit_table(keys: DataFrame, key: str) -> DataFrame:
    """One row: a bit for each key's low bits, as an array of FILTER_BITS / 64 longs."""
    words = keys.select(F.col(key).bitwiseAND(F.lit(FILTER_BITS - 1)).alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("bits"))
    full = keys.sparkSession.range(0, FILTER_BITS // 64).select(F.col("id").alias("word")).join(words, "word", "left")
    return full.agg(F.expr("transform(array_sort(collect_list(struct(word, coalesce(bits, 0L) as bits))), x -> x.bits)").alias("bits"))


def with_bit(rows: DataFrame, bits: DataFrame, key: str) -> DataFrame:
    """rows with _bit: whether the table, read once as a scalar subquery, has the key's bit."""
    view = f"bits_{uuid.uuid4().hex}"
    bits.createOrReplaceTempView(view)
    rows.createOrReplaceTempView(view + "_rows")
    return rows.sparkSession.sql(f"select *, shiftrightunsigned((select bits from {view})[cast(shiftright({key} & {FILTER_BITS - 1}, 6) as int)], cast({key} & 63 as int)) & 1 = 1 as _bit from {view}_rows")


def line_rows(texts: DataFrame, bits: int) -> DataFrame:
    """(rank, line) of every line; rank ascends with the document's number, then the line's."""
    split = texts.select("_num", F.posexplode(F.split(F.lower("text"), "\n")).alias("no", "line"))
    return split.select((F.shiftleft("_num", bits) + F.col("no")).alias("rank"), "line")


def matched(texts: DataFrame, classes: DataFrame, bits: int, tokens: int) -> DataFrame:
    """(cls): the lines that reach the threshold with an earlier one.

    Lines that pass the tests with none of their keys' lines go first, without their words. Words are
    read again for the rest, whose documents a bit table of fixed size picks out, and the exact
    similarity is a condition of the second join. Neither join puts out pairs.
    """
    near = stored(members(classes, tokens), "members")
    needed = near.select("cls").distinct()
    owners = stored(bit_table(needed.select(F.shiftright("cls", bits).alias("_num")).distinct(), "_num"), "bits")
    # ranks are no digests: their low bits would crowd a few words of the table
    key = F.xxhash64("rank")
    own = stored(bit_table(needed.select(F.xxhash64("cls").alias("_key")), "_key"), "bits")
    lines = line_rows(with_bit(texts, owners, "_num").filter("_bit"), bits).withColumn("_key", key)
    lines = with_bit(lines, own, "_key").filter("_bit").select("rank", "line").join(needed, F.col("rank") == F.col("cls"), "left_semi")
    # rows that repeat a doc_id may repeat a rank
    sets = lines.groupBy("rank").agg(F.min("line").alias("line")).select(F.col("rank").alias("cls"), F.expr(f"array_distinct({words('line')})").alias("words"))
    full = stored(near.join(sets, "cls"), "sets")
    same = f"{NUM + DEN} * size(array_intersect(a.words, b.words)) >= {NUM} * (a.n + b.n)"
    discard(near, owners, own)
    found = stored(met(full, full, "head", f"b.cls < a.cls and {_tests('a', 'b')} and {same}").select("cls").distinct(), "matched")
    discard(full)
    return found


def dedup_lines(docs: DataFrame) -> DataFrame:
    """Every document without the lines that an earlier line matches.

    docs: doc_id, text, and any other columns, which are kept. Adds n_lines, removed (numbers of the
    removed lines, from 0) and kept_text (the rest, joined by line feeds; null for a null text);
    columns of these names are replaced. Lines are parted by line feeds; a line's tokens are its
    distinct lower-cased words; lines match at Jaccard 0.8. A line is removed if a line that matches
    it stands earlier, by doc_id, then line number, whether or not that one is removed itself. Lines
    without words stay. Texts with a null doc_id have no rank and stay whole; rows that repeat a
    doc_id are one document given twice: each keeps the lines that the document keeps. An empty table
    gives no rows.

    Equal lines are grouped first, so that a line's number of copies never meets in one task. Then
    lines meet in groups of a common key (see prefixed, members), where joins keep each line at most once.
    """
    names = [c for c in docs.columns if c not in ADDED]
    # no name of the caller's meets one of these functions'
    held = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*[F.col(c) for c in names]).alias("_row"))
    held, bits = numbered(held)
    low = held.filter("_num is not null and text is not null").select("_num", "text")
    lines = stored(token_lines(low, bits), "lines")
    total = lines.agg(F.sum(F.size("hs"))).first()[0] or 0
    buckets = min(max(1 << (total // BUCKET_WORDS).bit_length(), LEAST_BUCKETS), MOST_BUCKETS)
    levels = stored(token_levels(lines, buckets), "levels")
    classes = prefixed(lines, levels, buckets).groupBy("k1", "k2").agg(F.min("rank").alias("cls"), F.first(F.struct("n", "tokens", *MAP)).alias("x")).select("cls", "x.*")
    classes = stored(classes, "classes")
    had = stored(lines.groupBy(F.shiftright("rank", bits).alias("_num")).agg(F.count(F.lit(1)).alias("n")), "had")
    discard(lines, levels)
    kept = classes.select("cls").join(matched(low, classes, bits, total), "cls", "left_anti")
    # documents that own each of their lines stay as they are: only the others meet what they own
    owned = stored(kept.groupBy(F.shiftright("cls", bits).alias("_own")).agg(F.collect_list(F.expr(f"cast(cls & {(1 << bits) - 1} as int)")).alias("_kept")), "owned")
    discard(classes)
    short = had.join(owned.select("_own", F.size("_kept").alias("m")), F.col("_num") == F.col("_own"), "left").filter("n > coalesce(m, 0)").select("_num")
    marked = with_bit(held, stored(bit_table(short, "_num"), "bits"), "_num")
    inside = "_num is not null and text is not null and _bit"
    whole = marked.filter(f"not coalesce({inside}, false)").select("_row", "text", F.expr("cast(array() as array<int>)").alias("removed"))
    part = marked.filter(inside).join(owned, F.col("_num") == F.col("_own"), "left").withColumn("_lines", F.split("text", "\n"))
    gone = f"filter(sequence(0, size(_lines) - 1), i -> not array_contains(coalesce(_kept, array()), i) and {WORDED.format('_lines[i]')})"
    out = whole.unionByName(part.select("_row", "text", F.expr(f"explode(array({gone}))").alias("removed")))
    rest_of = F.expr("concat_ws('\n', filter(split(text, '\n'), (l, i) -> not array_contains(removed, i)))")
    kept_text = F.when(F.size("removed") == 0, F.col("text")).otherwise(rest_of)
    return out.select(*[F.col("_row")[c].alias(c) for c in names], "removed", kept_text.alias("kept_text"), F.expr(r"coalesce(octet_length(text) - octet_length(replace(text, '\n', '')) + 1, 0)").alias("n_lines"))

"""Repeated passages by line or paragraph hashing, and by exact windows of words: the earliest occurrence stays, the rest go."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import LOWER, WordHashes, discard, mixed, portions, stored

#: A unit of fewer words is left alone. With 1, all but wordless units count.
MIN_WORDS = 1
#: Words of a window: a passage of over 50 words holds one. Words of the grams that stand for windows.
WIDTH, GRAM = 51, 16
PARTS = {"line": re.compile(r"\n"), "paragraph": re.compile(r"\n[ \t]*\n[\n\t ]*")}


def units(text: str, unit: str) -> list[tuple[int, int]]:
    """Code point offsets (from, to) of the units; the separators lie between."""
    at, found = 0, []
    for m in PARTS[unit].finditer(text):
        found.append((at, m.start()))
        at = m.end()
    found.append((at, len(text)))
    return found


def digest(unit: str, least: int) -> tuple[int, int] | None:
    """128-bit digest of the normalised unit: A-Z lower-cased, runs of white space one space, trimmed."""
    import xxhash

    words = unit.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if len(words) < least:
        return None
    value = xxhash.xxh3_128_intdigest(b" ".join(words))
    return (value >> 64) - (1 << 63), (value & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


def _digests(unit: str, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, k1, k2 = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for d in {digest(text[a:b], least) for a, b in units(text, unit)} - {None}:
                    ids.append(i)
                    k1.append(d[0])
                    k2.append(d[1])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64())], ["doc_id", "k1", "k2"])

    return run


def _strip(unit: str, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, text, owned in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                if text is None or i is None:
                    out.append((i, text, len(units(text, unit)) if text is not None else 0, 0, 0, []))
                    continue
                free = {(o["k1"], o["k2"]) for o in owned or ()}
                kept, spans, cut = [], [], units(text, unit)
                for a, b in cut:
                    d = digest(text[a:b], least)
                    if d is None or d in free:
                        free.discard(d)  # only its first occurrence here
                        kept.append((a, b))
                    else:
                        spans.append((a, b))
                rest = text
                if spans:
                    join = "\n" if unit == "line" else "\n\n"
                    rest = join.join(text[a:b] for a, b in kept)
                out.append((i, rest, len(cut), len(spans), sum(b - a for a, b in spans), [x for s in spans for x in s]))
            kinds = pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], [c.split()[0] for c in STRIPPED.split(", ")])

    return run


STRIPPED = "doc_id long, text string, n_units long, n_removed long, removed_chars long, spans array<long>"


def dedup_passages(docs: DataFrame, unit: str = "line", min_words: int = MIN_WORDS) -> DataFrame:
    """Every document without the units that occur earlier.

    docs: doc_id, text. unit: 'line' or 'paragraph' (parted by blank lines). Result, a row per row:
    doc_id, text (what is left, joined as it was parted), n_units, n_removed, removed_chars, spans
    (code point offsets from, to of each removed unit in the original text, flat). Occurrences rank
    by doc_id, then place. Units of fewer than min_words words are never removed. A null text stays
    null; texts with a null doc_id have no rank and stay whole; rows that repeat a doc_id are one
    document given twice: each keeps what the document keeps. No rows give no rows; other columns
    are ignored.

    Each digest keeps its smallest doc_id (partial aggregation first, so a passage's number of copies
    costs nothing), and each document gets the digests it owns.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    seen = rows.filter("doc_id is not null and text is not null").mapInArrow(_digests(unit, min_words), "doc_id long, k1 long, k2 long")
    owners = seen.groupBy("k1", "k2").agg(F.min("doc_id").alias("owner")).groupBy("owner").agg(F.collect_list(F.struct("k1", "k2")).alias("owned"))
    out = rows.join(owners, F.col("doc_id") == F.col("owner"), "left").select("doc_id", "text", "owned")
    return out.mapInArrow(_strip(unit, min_words), STRIPPED)


WORD = re.compile(r"[^\x20\x09-\x0D]+")
CUT = "doc_id long, n_passages long, n_removed long, n_units long, removed_chars long, spans array<long>, text string"
SEEN = "doc_id long, k1 long, k2 long, n long"


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Digest of every n consecutive words, from the words' digests, by doubling."""
    many = len(h) - n + 1
    if many < 1:
        return h[:0]
    size, done, power, out = 1, 0, h, None
    odd = np.uint64(0x9E3779B97F4A7C15)
    while True:
        if n & size:
            part = power[done : done + many]
            out = part if out is None else mixed(out * odd + part)
            done += size
        if 2 * size > n:
            return out
        power = mixed(power[:-size] * odd + power[size:])
        size *= 2


def least_of(g: np.ndarray, n: int) -> np.ndarray:
    """Least of every n consecutive values."""
    size = 1
    while 2 * size <= n:
        g = np.minimum(g[:-size], g[size:])
        size *= 2
    return np.minimum(g[: len(g) - n + size], g[n - size :]) if n > size else g


class Words:
    """A text's lines of words; on demand, digests of the words and the representative gram of every window.

    The representative is the least of the window's gram digests: windows of equal words have equal ones.
    """

    def __init__(self, text: str) -> None:
        self.lines = [x.split() for x in text.encode("utf-8", "surrogatepass").translate(LOWER).split(b"\n")]
        self.sizes = np.fromiter(map(len, self.lines), np.int64, len(self.lines))
        self.line = np.repeat(np.arange(len(self.lines)), self.sizes)

    def line_digests(self, least: int) -> Iterator[tuple[int, tuple[int, int]]]:
        """(line, digest) of the lines of `least` words or more."""
        import xxhash

        for k, x in enumerate(self.lines):
            if len(x) >= max(least, 1):
                value = xxhash.xxh3_128_intdigest(b" ".join(x))
                yield k, ((value >> 64) - (1 << 63), (value & 0xFFFFFFFFFFFFFFFF) - (1 << 63))

    def hashed(self, code: WordHashes) -> np.ndarray:
        """The representatives of all windows; none in a text of fewer words than a window."""
        if len(self.line) < WIDTH:
            return np.empty(0, np.uint64)
        self.h = code.array([w for x in self.lines for w in x])
        return least_of(grams(self.h, GRAM), WIDTH - GRAM + 1)

    def gone_lines(self, owned: set, least: int) -> np.ndarray:
        """Lines that stand earlier, here or in another document."""
        gone = np.zeros(len(self.lines), bool)
        for k, d in self.line_digests(least):
            gone[k] = d not in owned
            owned.discard(d)
        return gone

    def open_windows(self, again: list, gone: np.ndarray, code: WordHashes) -> tuple[np.ndarray, np.ndarray]:
        """(places, digests) of windows that may stand elsewhere: those of representatives that stand twice or more.

        Left out are those inside a line that goes: the line's earlier copy has them all.
        """
        least = self.hashed(code)
        open_ = np.isin(least.view(np.int64), np.asarray(again, np.int64))
        if gone.any() and len(least):
            first, last = self.line[: len(least)], self.line[WIDTH - 1 :]
            open_ &= ~((first == last) & gone[first])
        at = np.flatnonzero(open_)
        if not len(at):
            return at, np.empty(0, np.uint64)
        return at, grams(self.h[at[0] : at[-1] + WIDTH], WIDTH)[at - at[0]]


def _owned(found: list | None) -> set[tuple[int, int]]:
    return {(o["k1"], o["k2"]) for o in found or ()}


def _seen(least: int):
    """A row for each distinct line (n is null) and for each representative gram (k2 is null), with how often it may stand there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = WordHashes()
        for batch in batches:
            for lo, hi in portions(batch.column(1)):
                ids, k1, k2, times = [], [], [], []
                for i, text in zip(*[batch.column(k).slice(lo, hi - lo).to_pylist() for k in range(2)], strict=True):
                    w = Words(text)
                    lines = {d for _, d in w.line_digests(least)}
                    reps = w.hashed(code).view(np.int64)
                    # one gram stands for WIDTH - GRAM + 1 windows in a row at most: a longer run has it twice
                    starts = np.flatnonzero(np.concatenate([[True], reps[1:] != reps[:-1]])) if len(reps) else np.empty(0, np.int64)
                    runs = np.diff(starts, append=len(reps))
                    keys, back, n = np.unique(reps[starts], return_inverse=True, return_counts=True)
                    long = np.zeros(len(keys), np.int64)
                    np.maximum.at(long, back, runs)
                    ids.append(np.full(len(lines) + len(keys), i, np.int64))
                    k1 += [d[0] for d in lines] + keys.tolist()
                    k2 += [d[1] for d in lines] + [None] * len(keys)
                    times += [None] * len(lines) + np.where((n > 1) | (long > WIDTH - GRAM + 1), 2, 1).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(times, pa.int64())], ["doc_id", "k1", "k2", "n"])

    return run


def _windows(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = WordHashes()
        for batch in batches:
            for lo, hi in portions(batch.column(1)):
                ids, keys = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                for i, text, owned, again in zip(*[batch.column(k).slice(lo, hi - lo).to_pylist() for k in range(4)], strict=True):
                    w = Words(text)
                    keys.append(np.unique(w.open_windows(again, w.gone_lines(_owned(owned), least), code)[1]).view(np.int64))
                    ids.append(np.full(len(keys[-1]), i, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (ids, keys)], ["doc_id", "k"])

    return run


def _cut(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = WordHashes()
        kinds = pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string()
        for batch in batches:
            for lo, hi in portions(batch.column(1)):
                out = []
                for i, text, owned, again, first in zip(*[batch.column(k).slice(lo, hi - lo).to_pylist() for k in range(5)], strict=True):
                    if text is None or i is None:
                        out.append((i, 0, 0, len(units(text, "line")) if text is not None else 0, 0, [], text))
                        continue
                    w = Words(text)
                    gone = w.gone_lines(_owned(owned), least)
                    covered = np.zeros(len(w.line), bool)
                    at, digests = w.open_windows(again, gone, code) if again else (np.empty(0, np.int64), None)
                    if len(at):
                        u, index, back = np.unique(digests, return_index=True, return_inverse=True)
                        later = at[~np.isin(u, np.asarray(first or (), np.int64).view(np.uint64))[back] | (at >= at[index][back] + WIDTH)]
                        cover = np.bincount(later, minlength=len(w.line) + 1) - np.bincount(later + WIDTH, minlength=len(w.line) + 1)
                        covered = np.cumsum(cover)[:-1] > 0
                    out.append((i, *_without(text, w, gone, covered)))
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], [c.split()[0] for c in CUT.split(", ")])

    return run


def _without(text: str, w: Words, gone: np.ndarray, covered: np.ndarray) -> tuple:
    """n_passages, n_removed, n_units, removed_chars, spans and text without the lines and words that go."""
    lines = units(text, "line")
    spans: list[tuple[int, int]] = []
    kept: list[str] = []
    removed = 0
    if not covered.any() and not gone.any():
        return 0, 0, len(lines), 0, [], text
    words = [(m.start(), m.end()) for m in WORD.finditer(text)] if covered.any() else []
    ends = np.cumsum(w.sizes)
    for k, (a, b) in enumerate(lines):
        lo, hi = int(ends[k] - w.sizes[k]), int(ends[k])
        if gone[k] or (hi > lo and covered[lo:hi].all()):
            spans.append((a, b))
            removed += 1
            continue
        part, now = [], a
        p = lo
        while words and p < hi:
            q = p
            while q < hi and covered[q]:
                q += 1
            if q > p:  # with the space up to the next word
                cut = words[p][0], words[q][0] if q < hi else words[q - 1][1]
                spans.append(cut)
                part.append(text[now : cut[0]])
                now = cut[1]
            p = q + 1
        kept.append("".join(part) + text[now:b])
    edges = np.diff((covered | gone[w.line]).astype(np.int8), prepend=0, append=0)
    passages = int((np.flatnonzero(edges < 0) - np.flatnonzero(edges > 0) >= WIDTH).sum())
    return passages, removed, len(lines), sum(b - a for a, b in spans), [x for s in spans for x in s], "\n".join(kept)


def dedup_windows(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Every document without the lines, and without the passages of over 50 words at any word offset, that occur earlier.

    docs: doc_id, text. Lines go as in dedup_passages. A window of WIDTH words goes if the same words
    stand in a document of smaller doc_id, or in this one before it and clear of their first
    occurrence here; a passage may begin and end in mid-line and run over line feeds. Result, a row
    per row: doc_id, n_passages (runs of over 50 words that go, in lines or windows), n_removed (lines
    of which nothing is left), n_units (lines), removed_chars, spans (code point offsets), text.
    Null texts, null ids, repeated ids, no rows and other columns: as in dedup_passages.

    Exact but for 64-bit digests: equal windows have the same least gram digest, so only windows whose
    representative stands twice or more in the corpus are looked at again, and only the documents that
    have some; of those each digest keeps its smallest doc_id. Documents get what they own, so a
    passage's number of copies costs nothing.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    seen = stored(rows.filter("doc_id is not null and text is not null").mapInArrow(_seen(min_words), SEEN), "seen")
    lines = seen.filter("n is null").groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id")).groupBy("doc_id").agg(F.collect_list(F.struct("k1", "k2")).alias("owned"))
    grams_ = seen.filter("n is not null").select("doc_id", "k1", "n")
    twice = grams_.groupBy("k1").agg(F.sum("n").alias("n")).filter("n > 1").select("k1")
    again = grams_.join(twice, "k1").groupBy("doc_id").agg(F.collect_list("k1").alias("again"))
    held = stored(lines.join(again, "doc_id", "full").select(F.col("doc_id").alias("_id"), "owned", "again"), "held")
    discard(seen)
    some = rows.join(held.filter("again is not null"), F.col("doc_id") == F.col("_id")).filter("text is not null").select("doc_id", "text", "owned", "again")
    first = some.mapInArrow(_windows(min_words), "doc_id long, k long").groupBy("k").agg(F.min("doc_id").alias("_first")).groupBy("_first").agg(F.collect_list("k").alias("first"))
    both = stored(held.join(first, F.col("_id") == F.col("_first"), "left").select("_id", "owned", "again", "first"), "held")
    discard(held)
    return rows.join(both, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "text", "owned", "again", "first").mapInArrow(_cut(min_words), CUT)

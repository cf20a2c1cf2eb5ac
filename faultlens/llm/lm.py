"""Language-model scoring with a weighted backoff automaton over smoothed bigrams.

Texts become blocks of tokens. A block asks for the corpus counts of just the n-grams it holds,
builds the part of the automaton that its texts can reach, and walks each text through it once. So
no task and no driver ever holds the model, however large the corpus makes it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import WordHashes, mixed, stored, words_of

#: Tokens in a block, about.
BLOCK = 700_000
#: N-grams in a counting group, about.
GROUP = 2_000_000
#: Additive smoothing of the unigrams.
ADD = 0.1
#: Bounds of the bigram weights.
LOWEST, HIGHEST = 0.01, 0.99
#: End of text and its beginning; no word holds a line feed.
END, BEGIN = b"\n.", b"\n^"
DECADES = 10.0 ** np.arange(1, 19)
BASE = np.uint64(0x9E3779B97F4A7C15)


def packed(a: np.ndarray) -> bytes:
    """An array of unsigned integers, byte plane by byte plane, compressed."""
    head = struct.pack("<QB", len(a), a.itemsize)
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes()
    return head + (pa.compress(planes, codec="zstd", asbytes=True) if len(a) else b"")


def unpacked(data: bytes) -> np.ndarray:
    n, size = struct.unpack("<QB", data[:9])
    if not n:
        return np.empty(0, f"<u{size}")
    raw = np.frombuffer(pa.decompress(data[9:], n * size, codec="zstd"), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).view(f"<u{size}").ravel()


def ascending(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys, packed as differences."""
    return packed(np.diff(keys, prepend=np.uint64(0)))


def held_out(doc_id: Column) -> Column:
    """True for the tenth that is not learned from; a null id counts as an empty one."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, part, made = WordHashes(), TaskContext.get().partitionId(), 0
    ids, held, lengths, tokens = [], [], [], []
    local: dict[bytes, int] = {BEGIN: 0, END: 1}

    def block() -> pa.RecordBatch:
        # frequent words get small numbers: their high bytes are zeros
        t = np.array(tokens, np.uint32)
        order = np.concatenate([[0, 1], 2 + np.argsort(-np.bincount(t, minlength=len(local))[2:], kind="stable")])
        rank = np.empty(len(local), np.uint32)
        rank[order] = np.arange(len(local), dtype=np.uint32)
        row = [[(part << 33) + made]], [ids], [held], [lengths], [packed(rank[t])], [packed(hashes.array(list(local))[order])]
        kinds = pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary()
        return pa.RecordBatch.from_arrays([pa.array(x[0] if i == 0 else x, k) for i, (x, k) in enumerate(zip(row, kinds, strict=True))], ["block", "ids", "held", "lengths", "tokens", "words"])

    for batch in batches:
        for i, h, text in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
            words = words_of(text)
            tokens += [local.setdefault(w, len(local)) for w in words]
            tokens.append(1)
            ids.append(i)
            held.append(h)
            lengths.append(len(words) + 1)
            if len(tokens) >= BLOCK:
                yield block()
                made += 1
                ids, held, lengths, tokens, local = [], [], [], [], {BEGIN: 0, END: 1}
    if ids:
        yield block()


BLOCKS = "block long, ids array<long>, held array<boolean>, lengths array<int>, tokens binary, words binary"


class Block:
    """N-grams of one block. Unigrams are its local words but BEGIN; bigrams its distinct (previous, word)."""

    def __init__(self, ids: list, held: list, lengths: list, tokens: bytes, words: bytes) -> None:
        self.ids, self.held, self.lengths = ids, np.array(held, bool), np.array(lengths, np.int64)
        self.t = unpacked(tokens).astype(np.int64)
        self.h = unpacked(words)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        before = np.empty_like(self.t)
        before[1:] = self.t[:-1]
        before[self.starts] = 0
        self.train = np.repeat(~self.held, self.lengths)
        self.codes, self.which = np.unique(before * len(self.h) + self.t, return_inverse=True)
        with np.errstate(over="ignore"):
            self.key1 = mixed(self.h[1:] + np.uint64(1))
            self.key2 = mixed(mixed(self.h)[self.codes // len(self.h)] * BASE + self.h[self.codes % len(self.h)])

    def asked(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Order of the n-grams by key, and the training count of each here."""
        if n == 1:
            return np.argsort(self.key1), np.bincount(self.t[self.train], minlength=len(self.h))[1:]
        return np.argsort(self.key2), np.bincount(self.which[self.train], minlength=len(self.codes))

    def answered(self, parts: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        """Corpus counts of local words (BEGIN has the count of END: both stand once in a text) and of bigrams."""
        got = []
        for n, key in ((1, self.key1), (2, self.key2)):
            own = sorted((p for p in parts if p["n"] == n), key=lambda p: p["bucket"])
            flat = np.concatenate([unpacked(p["counts"]).astype(np.int64) for p in own])
            counts = np.empty(len(key), np.int64)
            counts[np.argsort(key)] = flat
            got.append(counts)
        return np.concatenate([got[0][:1], got[0]]), got[1]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):  # one row at a time: blocks are large
            yield {k: batch.column(k)[i].as_py() for k in batch.schema.names}


def _block(row: dict) -> Block:
    return Block(row["ids"], row["held"], row["lengths"], row["tokens"], row["words"])


def _ask(bits: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            b = _block(row)
            for n, key in ((1, b.key1), (2, b.key2)):
                order, counts = b.asked(n)
                key, counts = key[order], counts[order].astype(np.uint32)
                ends = np.searchsorted(key, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist() + [len(key)] if bits else [len(key)]
                out = [(n, k, row["block"], ascending(key[lo:hi]), packed(counts[lo:hi])) for k, (lo, hi) in enumerate(zip([0, *ends], ends, strict=False)) if hi > lo]
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["n", "bucket", "block", "keys", "counts"])

    return ask


def _count(group: pa.Table) -> pa.Table:
    """Corpus counts for all blocks that ask for n-grams of one key range."""
    keys = [np.cumsum(unpacked(x.as_py())) for x in group.column("keys")]
    flat, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, np.concatenate([unpacked(x.as_py()) for x in group.column("counts")]), len(flat)).astype(np.int64)
    width = next(w for w in (1, 2, 4, 8) if w == 8 or total.max(initial=0) < 1 << (8 * w))
    ends = np.cumsum([len(k) for k in keys])
    answer = total.astype(f"u{width}")[at]
    rows = len(keys)
    blobs = [packed(answer[e - len(k) : e]) for k, e in zip(keys, ends, strict=True)]
    first = np.arange(rows) == 0
    cols = [group.column("n").combine_chunks(), group.column("bucket").combine_chunks(), group.column("block").combine_chunks(), pa.array(blobs, pa.binary()), pa.array(np.where(first, (total > 0).sum(), 0)), pa.array(np.where(first, total.sum(), 0))]
    return pa.Table.from_arrays([pa.chunked_array([c]) if not isinstance(c, pa.ChunkedArray) else c for c in cols], ["n", "bucket", "block", "counts", "kinds", "total"])


ANSWERS = "n int, bucket int, block long, counts binary, kinds long, total long"


def _weigh(total: int):
    """Deleted interpolation: per decade of the context's count, occurrences better told by the bigram, and all."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        won, all_ = np.zeros(20, np.int64), np.zeros(20, np.int64)
        for row in _rows(batches):
            b = _block(row)
            c1, c2 = b.answered(row["parts"])
            n = np.bincount(b.which[b.train], minlength=len(b.codes))
            context, word = c1[b.codes // len(b.h)], c1[b.codes % len(b.h)]
            better = (c2 - 1.0) * (total - 1.0) > (word - 1.0) * (context - 1.0)
            decade = np.searchsorted(DECADES, context, "right")
            won += np.bincount(decade, n * (better & (context > 1)), 20).astype(np.int64)
            all_ += np.bincount(decade, n, 20).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(20), pa.int32()), pa.array(won), pa.array(all_)], ["decade", "won", "seen"])

    return weigh


def _score(total: int, kinds: int, weights: list[float]):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = total + ADD * (kinds + 1)
        for row in _rows(batches):
            b = _block(row)
            c1, c2 = b.answered(row["parts"])
            size = len(b.h)
            low = (c1 + ADD) / whole
            base = np.add.reduceat(np.log10(low)[b.t], b.starts)
            known = np.add.reduceat((c1 > 0)[b.t].astype(np.int64), b.starts)
            # the automaton: a state for each word seen in training (and BEGIN), the root for all else
            weight = np.array(weights)[np.searchsorted(DECADES, c1, "right")]
            root = np.log10(low).tolist()
            goes = np.where(c1 > 0, np.arange(size), -1).tolist()
            fails = np.log10(1 - weight).tolist()
            seen = np.flatnonzero(c2 > 0)
            v, w = b.codes[seen] // size, b.codes[seen] % size
            arcs = dict(zip(b.codes[seen].tolist(), np.log10(weight[v] * c2[seen] / c1[v] + (1 - weight[v]) * low[w]).tolist(), strict=True))
            scores, tokens, at = [], b.t.tolist(), 0
            start = 0 if c1[0] > 0 else -1
            for n in b.lengths.tolist():
                state, sum_ = start, 0.0
                for w in tokens[at : at + n]:
                    if state >= 0:
                        arc = arcs.get(state * size + w)
                        sum_ += fails[state] + root[w] if arc is None else arc
                    else:
                        sum_ += root[w]
                    state = goes[w]
                scores.append(sum_)
                at += n
            cols = [pa.array(b.ids, pa.int64()), pa.array(b.held), pa.array(b.lengths), pa.array(known), pa.array(np.full(len(b.ids), total, np.int64)), pa.array(base), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return score


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame) -> DataFrame:
    """Every document's log10 probability under bigrams learned from nine tenths of them.

    docs: doc_id, text. Result, a row per row: doc_id, held_out, n_tokens (words and one end),
    n_known (tokens that training has), train_tokens, base_score (additive unigrams), score.
    Model: P(w | v) = k * c(vw) / c(v) + (1 - k) * P1(w), P1 the additive unigram; k is set per decade
    of c(v) by deleted interpolation over all training bigrams and lies in [LOWEST, HIGHEST]. After a
    word that training lacks, P1 alone. A state is a word (or the beginning), an arc a bigram seen in
    training, a failure arc leads to the root with weight 1 - k.
    Null or empty texts are one end token; a null doc_id is held out; rows that repeat a doc_id count
    each; with nothing to learn from, all weights are those of counts of 0; no rows give no rows;
    other columns are ignored. Counts are over 64-bit digests of words and pairs of words.
    """
    source = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held"), F.col("text").cast("string"))
    blocks = stored(source.mapInArrow(_encode, BLOCKS), "blocks")
    size = blocks.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(size, 1) / GROUP))))
    asked = blocks.mapInArrow(_ask(bits), "n int, bucket int, block long, keys binary, counts binary")
    answers = stored(asked.groupBy("n", "bucket").applyInArrow(_count, ANSWERS), "answers")
    kinds, total = (x or 0 for x in answers.filter("n = 1").agg(F.sum("kinds"), F.sum("total")).first())
    full = blocks.join(answers.groupBy("block").agg(F.collect_list(F.struct("n", "bucket", "counts")).alias("parts")), "block")
    won = full.mapInArrow(_weigh(total), "decade int, won long, seen long").groupBy("decade").agg(F.sum("won").alias("won"), F.sum("seen").alias("seen")).collect()  # a row per decade
    weights = [LOWEST] * 20
    for r in won:
        if r.seen:
            weights[r.decade] = min(HIGHEST, max(LOWEST, r.won / r.seen))
    return full.mapInArrow(_score(total, kinds, weights), SCORES)

"""Benchmark decontamination by a distributed positional inverted index.

The index has one row per segment of documents: its terms, sorted, each with the ascending
positions at which it stands. A phrase is found by taking the position lists of its terms from the
rarest on, shifting each by the term's offset, and intersecting.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import stored

#: A-Z to a-z, every other ASCII byte but 0-9 and a-z to a space; bytes of longer characters stay.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Words in a segment, about: the memory of a task is bounded by this and by its longest document.
SEGMENT_WORDS = 500_000
#: Bytes of benchmark text searched for in one pass over the index; a larger benchmark takes more passes.
PASS_BYTES = 32_000_000
INDEX = "doc_ids array<long>, n_words array<int>, starts binary, terms binary, term_ends binary, post_ends binary, positions binary"
FOUND = "segment long, ordinal int, doc_id long, n_words long, spans array<int>, items array<long>"


def index_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORDS).split() if text else []


def _segment(ids: list, lengths: list[int], words: list[bytes]) -> pa.RecordBatch:
    """Between two documents lies one position without a word, so that no phrase runs over."""
    code: dict[bytes, int] = {}
    codes = np.fromiter((code.setdefault(w, len(code)) for w in words), np.int64, len(words))
    n = np.array(lengths, np.int64)
    starts = np.concatenate([[0], np.cumsum(n + 1)]).astype(np.uint32)
    positions = np.arange(len(words)) + np.repeat(np.arange(len(n)), n)
    terms = sorted(code)
    rank = np.empty(len(terms), np.int64)
    rank[[code[t] for t in terms]] = np.arange(len(terms))
    codes = rank[codes]
    order = np.argsort(codes, kind="stable")
    ends = np.cumsum(np.bincount(codes, minlength=len(terms))).astype(np.uint32)
    term_ends = np.cumsum(np.fromiter(map(len, terms), np.int64, len(terms))).astype(np.uint32)
    row = [ids], [lengths], [starts.tobytes()], [b"".join(terms)], [term_ends.tobytes()], [ends.tobytes()], [positions[order].astype(np.uint32).tobytes()]
    kinds = pa.list_(pa.int64()), pa.list_(pa.int32()), *[pa.binary()] * 5
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], [c.split()[0] for c in INDEX.split(", ")])


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, lengths, words = [], [], []
    for batch in batches:
        for i, text in zip(batch.column(0), batch.column(1), strict=True):
            got = index_words(text.as_py())
            ids.append(i.as_py())
            lengths.append(len(got))
            words += got
            if len(words) + len(ids) >= SEGMENT_WORDS:
                yield _segment(ids, lengths, words)
                ids, lengths, words = [], [], []
    if ids:
        yield _segment(ids, lengths, words)


def build_index(docs: DataFrame) -> DataFrame:
    """The positional index of all words of all documents, stored in the shared folder, a row per segment.

    docs: doc_id and text; other columns are ignored. A null or empty text is a document without words.
    """
    built = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_build, INDEX)
    return stored(built.withColumn("segment", F.monotonically_increasing_id()), "postings")


class Segment:
    """Reader of one row of the index."""

    def __init__(self, row: dict) -> None:
        self.doc_ids, self.n_words = row["doc_ids"], row["n_words"]
        self.starts = np.frombuffer(row["starts"], np.uint32).astype(np.int64)
        text, ends = row["terms"], np.frombuffer(row["term_ends"], np.uint32).tolist()
        self.terms = {text[a:b]: k for k, (a, b) in enumerate(zip([0, *ends], ends, strict=False))}
        self.ends = np.frombuffer(row["post_ends"], np.uint32)
        self.positions = np.frombuffer(row["positions"], np.uint32)

    def postings(self, term: bytes) -> np.ndarray | None:
        k = self.terms.get(term)
        return None if k is None else self.positions[self.ends[k - 1] if k else 0 : self.ends[k]]

    def phrase(self, words: list[bytes]) -> np.ndarray:
        """Positions at which the words stand one after the other."""
        lists = []
        for offset, w in enumerate(words):
            got = self.postings(w)
            if got is None:
                return np.empty(0, np.int64)
            lists.append((len(got), offset, got))
        lists.sort(key=lambda x: x[0])
        _, offset, got = lists[0]
        at = got.astype(np.int64) - offset
        for _, offset, got in lists[1:]:
            k = np.searchsorted(got, at + offset)
            k[k == len(got)] = 0
            at = at[got[k] == at + offset]
            if not len(at):
                break
        return at

    def near(self, words: list[bytes], slop: int) -> np.ndarray:
        """Documents (ordinals) with all words inside slop + len(words) consecutive positions, in any order."""
        lists = [self.postings(w) for w in set(words)]
        if not lists or any(x is None for x in lists):
            return np.empty(0, np.int64)
        lists.sort(key=len)
        reach, found = slop + len(words) - 1, []
        for first in lists:  # each word in turn as the one that stands first
            at = first.astype(np.int64)
            for got in lists:
                k = np.searchsorted(got, at)
                at = at[(k < len(got)) & (got[np.minimum(k, len(got) - 1)] <= at + reach)]
            found.append(at)
        at = np.unique(np.concatenate(found))
        doc = np.searchsorted(self.starts, at, "right") - 1
        # a span may not run into the next document
        whole = [d for d, p in zip(doc, at, strict=True) if all(((x := lists[i])[np.searchsorted(x, p)]) < self.starts[d + 1] for i in range(len(lists)))]
        return np.unique(np.array(whole, np.int64))


def windows(words: list[bytes], width: int) -> list[list[bytes]]:
    return [words[i : i + width] for i in range(max(1, len(words) - width + 1))] if words else []


def _search(items: list[tuple[int | None, str]], width: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted: dict[tuple[bytes, ...], list[int | None]] = {}
        for item, text in items:
            for w in windows(index_words(text), width):
                wanted.setdefault(tuple(w), []).append(item)
        for batch in batches:
            for row in batch.to_pylist():
                seg = Segment(row)
                spans: dict[int, list[int]] = {}
                hits: dict[int, set[int | None]] = {}
                for w, owners in wanted.items():
                    at = seg.phrase(list(w))
                    if len(at):
                        docs = np.searchsorted(seg.starts, at, "right") - 1
                        for d, p in zip(docs.tolist(), (at - seg.starts[docs]).tolist(), strict=True):
                            spans.setdefault(d, []).extend((p, p + len(w)))
                            hits.setdefault(d, set()).update(owners)
                out = [(row["segment"], d, i, n, spans.get(d, []), sorted(hits.get(d, ()), key=lambda x: (x is None, x or 0))) for d, (i, n) in enumerate(zip(seg.doc_ids, seg.n_words, strict=True))]
                kinds = pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], [c.split()[0] for c in FOUND.split(", ")])

    return search


def _verdict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge a document's spans and count the words inside."""
    for batch in batches:
        n_hit, n_items, sha, merged, listed = [], [], [], [], []
        for spans, items in zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True):
            got: list[list[int]] = []
            for a, b in sorted(zip(spans[::2], spans[1::2], strict=True)):
                if got and a <= got[-1][1]:
                    got[-1][1] = max(got[-1][1], b)
                else:
                    got.append([a, b])
            ids = sorted({str(x) for x in items if x is not None})
            merged.append([x for s in got for x in s])
            n_hit.append(sum(b - a for a, b in got))
            n_items.append(len(set(items)))
            listed.append([x for x in items if x is not None])
            sha.append(hashlib.sha256(",".join(ids).encode()).hexdigest())
        n_words = batch.column("n_words")
        bad = [h > 0 and 20 * h >= n for h, n in zip(n_hit, n_words.to_pylist(), strict=True)]
        cols = [batch.column("doc_id"), n_words, pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(sha, pa.string()), pa.array(bad, pa.bool_()), pa.array(merged, pa.list_(pa.int32())), pa.array(listed, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "items"])


VERDICT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<int>, items array<long>"


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 13, index: DataFrame | None = None) -> DataFrame:
    """Exact phrase matches of every benchmark window in every document.

    docs: doc_id, text. benchmark: item_id, text. A window is `width` consecutive words of an item,
    or all words of a shorter one. Result, a row per document: n_words, n_hit (words inside any
    window's occurrence), n_items, items_sha256, contaminated (n_hit > 0 and at least a twentieth
    of the words), spans (word offsets from, to of the merged hits, flat) and items.

    The benchmark is the query set. It is sent to the tasks in passes of at most PASS_BYTES of text,
    so that its size is bounded whatever it holds; the hits of several passes are merged by document.
    Null texts have no words; items without an id are searched for and together count as one item, but
    are not listed or hashed; rows that repeat a doc_id are
    judged each on its own; an empty benchmark matches nothing; other columns are ignored.
    """
    index = build_index(docs) if index is None else index
    passes: list[list[tuple[int | None, str]]] = [[]]
    size = 0
    # the query set, read through the driver pass by pass; documents never are
    for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text is not null").toLocalIterator():
        if size + len(r.text) > PASS_BYTES and passes[-1]:
            passes.append([])
            size = 0
        passes[-1].append((r.item_id, r.text))
        size += len(r.text)
    found = [index.mapInArrow(_search(p, width), FOUND) for p in passes]
    hits = found[0]
    if len(found) > 1:
        for more in found[1:]:
            hits = hits.unionByName(more)
        hits = hits.groupBy("segment", "ordinal", "doc_id", "n_words").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return hits.mapInArrow(_verdict, VERDICT)


def proximity(index: DataFrame, phrases: list[str], slop: int) -> DataFrame:
    """Documents in which all words of a phrase stand within slop extra positions, in any order: (phrase, doc_id).

    phrases: the query set, short and given by the caller.
    """
    wanted = [(p, index_words(p)) for p in phrases]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                seg = Segment(row)
                out = [(p, seg.doc_ids[d]) for p, w in wanted if w for d in seg.near(w, slop)]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64())], ["phrase", "doc_id"])

    return index.mapInArrow(search, "phrase string, doc_id long")

"""Language identification by Bayesian fusion of text, declared language, address suffix and host."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import stored
from faultlens.llm.html import extract

LANGUAGES = ("de", "en", "es", "fr")
#: Labelled documents the text model is fitted on, at most, and the longest one in code points.
SAMPLE, SAMPLE_CHARS = 2000, 20_000
#: Cells of the byte trigram table.
CELLS = 1 << 16
#: Trigrams a text's likelihood weighs as, at most: neighbouring trigrams tell much the same.
EVIDENCE = 60.0
#: Trigrams spread evenly over a language's model, beside a language's mean sample: an unseen trigram costs the same in each.
SPREAD = CELLS / 2
#: A text of no modelled language is taken to be as likely as evenly spread trigrams, times e^OTHER each; fewer trigrams than OTHER_LEAST don't speak for it.
OTHER, OTHER_LEAST = 0.3, 20
UNKNOWN = "und"
#: Weight of a host's (or suffix's) parent, in documents.
HOST_PRIOR, SUFFIX_PRIOR = 4.0, 20.0
#: A text with a smaller share of letters has no language.
LETTERS = 0.3
#: A text is rejected below this posterior.
CONFIDENCE = 0.5
#: ASCII letters to lower case, all other ASCII to spaces.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 97 and b <= 122 or b >= 128 else 32 for b in range(256))
SPACES = re.compile(rb" +")
DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]+)", re.I)
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
EVIDENCED = "id long, declared string, host string, suffix string, letters double, ll array<double>"


def cells(text: str) -> np.ndarray:
    """Cells of the trigrams of UTF-8 bytes; runs of other than letters are one space."""
    raw = np.frombuffer(b" " + SPACES.sub(b" ", text.lower().encode("utf-8", "surrogatepass").translate(FOLD)).strip() + b" ", np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.empty(0, np.uint32)
    return ((raw[:-2] * np.uint32(65599) + raw[1:-1]) * np.uint32(65599) + raw[2:]) * np.uint32(2654435761) >> np.uint32(16)


def tag() -> Column:
    return F.lower(F.substring_index("lang", "-", 1))


def labels(docs: DataFrame) -> tuple[str, ...]:
    """The languages that documents are labelled with."""
    found = docs.select(tag().alias("lang")).filter(f"lang rlike '^[a-z]{{2,8}}$' and lang <> '{UNKNOWN}'").distinct().collect()  # a row per language
    return tuple(sorted(r.lang for r in found))


def fit(docs: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> np.ndarray:
    """Log-probabilities (cell; language, and at last any other) from at most SAMPLE labelled documents, those of least digest."""
    labelled = docs.withColumn("lang", tag()).filter(F.col("lang").isin(*languages))
    # a digest below this share leaves about twice the sample, whatever the number of parts
    share = min(1.0, 2 * SAMPLE / max(1, labelled.count()))
    fair = labelled.withColumn("_h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31))).filter((F.col("_h") < share * (1 << 31)) & F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS))
    rows = fair.select("lang", "text", "_h").orderBy("_h", "text").limit(SAMPLE).collect()
    counts = np.zeros((CELLS, len(languages)))
    for r in rows:
        counts[:, languages.index(r.lang)] += np.bincount(cells(r.text), minlength=CELLS)
    floor = SPREAD / (counts.sum() / max(1, len(languages)) + SPREAD)
    model = np.log((1 - floor) * counts / np.maximum(1, counts.sum(axis=0)) + floor / CELLS)
    return np.hstack([model, np.full((CELLS, 1), OTHER - np.log(CELLS))]).astype(np.float32)


def _evidence(model: np.ndarray, is_html: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            declared, letters, ll = [], [], []
            for text, said in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if is_html:
                    m = DECLARED.search(text or "")
                    said = m[1] if m else None
                    text = extract(text)
                text = text or ""
                declared.append((said or "").lower().partition("-")[0])
                letters.append(sum(map(str.isalpha, text)) / max(1, len(text) - text.count(" ") - text.count("\n")))
                at = cells(text)
                said = (model[at].sum(axis=0, dtype=np.float64) * min(1.0, EVIDENCE / len(at))).tolist() if len(at) else [0.0] * model.shape[1]
                if len(at) < OTHER_LEAST:
                    said[-1] = min(said[-1], max(said[:-1], default=0.0))
                ll.append(said)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(declared, pa.string()), batch.column(3), batch.column(4), pa.array(letters, pa.float64()), pa.array(ll, pa.list_(pa.float64()))], [c.split()[0] for c in EVIDENCED.split(", ")])

    return run


def _softmax(values: str) -> Column:
    """The softmax of a column that is stored: were it an expression, each entry would make it again."""
    top = f"array_max({values})"
    return F.expr(f"transform({values}, v -> exp(v - {top}) / aggregate({values}, 0D, (a, x) -> a + exp(x - {top})))")


def identify(rows: DataFrame, model: np.ndarray, is_html: bool, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """(id, lang, confidence, text_lang, declared, host, kept) for each row.

    rows: id, text (html if is_html), declared, host, suffix. The posterior of a language is the
    product of its text likelihood, the probability of the declared language under it, and the
    host's prior. The last is learned from the text alone: sums of text posteriors by host, smoothed
    towards its address suffix, and that towards all rows; a row's own part is left out. How often
    each language is declared how is learned alike; unknown declarations count as one.
    One more hypothesis, with host prior and declarations of its own, is that the text is in none of
    the languages. lang is 'und' (and the row not kept) where that wins, or if the text is null, empty
    or has too few letters; a row of lower confidence than CONFIDENCE is not kept. Null hosts, suffixes and declarations are values of
    their own; repeated rows count each.
    A host's rows are summed by partial aggregation; hosts never meet in one task.
    """
    n = len(languages) + 1
    listed = "array(" + ", ".join(f"'{x}'" for x in (*languages, UNKNOWN)) + ")"
    known = F.when(F.col("declared").isin(*languages), F.col("declared")).otherwise(F.lit("?"))
    seen = rows.select("id", "text", "declared", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("suffix", F.lit("")).alias("suffix")).mapInArrow(_evidence(model, is_html), EVIDENCED)
    seen = seen.withColumn("declared", known).withColumn("p", _softmax("ll")).withColumn("texty", F.col("letters") >= LETTERS)
    seen = stored(seen, "evidence")
    sums = [F.sum(F.when(F.col("texty"), F.col("p")[i]).otherwise(0.0)).alias(f"s{i}") for i in range(n)]
    again = [F.sum(f"s{i}").alias(f"s{i}") for i in range(n)]
    hosts = stored(seen.groupBy("host", "suffix").agg(*sums), "hosts")
    suffixes = hosts.groupBy("suffix").agg(*again).withColumnsRenamed({f"s{i}": f"t{i}" for i in range(n)})
    whole = [x or 0.0 for x in hosts.agg(*again).first()]
    overall = [(w + 1.0) / (sum(whole) + n) for w in whole]
    said = {r.declared: [r[f"s{i}"] for i in range(n)] for r in seen.groupBy("declared").agg(*sums).collect()}  # a row per language
    kinds = [*languages, "?"]  # "?" is what a text in another language declares
    # probability of a declaration under a language: counts and a mild belief that it is true
    belief = [[(said.get(k, [0.0] * n)[i] + (2.0 if k == kinds[i] else 0.5)) / (sum(v[i] for v in said.values()) + 2.0 + 0.5 * n) for i in range(n)] for k in kinds]
    declared = "element_at(map(" + ", ".join(f"'{k}', array({', '.join(repr(float(x)) + 'D' for x in row)})" for k, row in zip(kinds, belief, strict=True)) + "), declared)"
    total = lambda s: "(" + " + ".join(f"{s}{i}" for i in range(n)) + ")"
    parents = hosts.join(suffixes, "suffix").select("host", "suffix", *[F.col(f"s{i}") for i in range(n)], *[F.expr(f"(t{i} + {SUFFIX_PRIOR}D * {overall[i]!r}D) / ({total('t')} + {SUFFIX_PRIOR}D)").alias(f"u{i}") for i in range(n)])
    met = seen.join(parents, ["host", "suffix"])
    own = lambda i: f"if(texty, p[{i}], 0D)"
    prior = lambda i: f"(greatest(s{i} - {own(i)}, 0D) + {HOST_PRIOR}D * u{i}) / ({total('s')} - if(texty, 1D, 0D) + {HOST_PRIOR}D)"
    met = met.withColumn("_said", F.expr(declared)).withColumn("fused", F.array(*[F.expr(f"ll[{i}] + ln(_said[{i}]) + ln({prior(i)})") for i in range(n)]))
    met = stored(met.select("id", "declared", "host", "texty", "p", "fused"), "fused")
    met = stored(met.withColumn("q", _softmax("fused")), "posterior")
    best = lambda c: F.expr(f"if(texty, element_at({listed}, cast(array_position({c}, array_max({c})) as int)), '{UNKNOWN}')")
    confidence = F.when(F.col("texty"), F.array_max("q")).otherwise(0.0)
    return met.select("id", best("q").alias("lang"), confidence.alias("confidence"), best("p").alias("text_lang"), "declared", "host", (F.col("texty") & (confidence >= CONFIDENCE) & (best("q") != UNKNOWN)).alias("kept"))


def page_rows(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1))
    return pages.select(F.col("page_id").cast("long").alias("id"), F.col("html").alias("text"), F.lit(None).cast("string").alias("declared"), host.alias("host"), F.substring_index(host, ".", -1).alias("suffix"))


def document_rows(docs: DataFrame) -> DataFrame:
    """A document's source stands for its host; the language it comes with is what it declares."""
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("declared"), F.col("source").cast("string").alias("host"), F.lit("").alias("suffix"))

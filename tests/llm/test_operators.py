import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from brute import components, lowered, near_links, prose, shingles, words
from pyspark.sql import functions as F

from faultlens.llm import decontam, embed, html, langid, linededup, lm, minhash, mixing, substring, warc
from faultlens.operators import components as cc
from faultlens.llm.common import words_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def texts_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_words():
    text = "A  b\tC\x0bD\x0cé\x85f G\x1cH"
    assert [w.decode() for w in words_of(text)] == words(text)
    assert words_of(None) == [] and words_of("") == []


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 300) if i % 50] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    want = components(sorted({x for e in links for x in e}), links)
    for local in (0, 100, cc.LOCAL_EDGES):
        got = {r.u: r.component for r in cc.components(spark.createDataFrame(links, "u long, v long").repartition(7), local_edges=local).collect()}
        assert {n: got.get(n, n) for n in want} == want
    assert cc.components(spark.createDataFrame([], "u long, v long")).count() == 0


# op 1


def check_mix(rows):
    sources = defaultdict(lambda: [0, 0, 0, 0])
    for r in rows:
        s = sources[r.source]
        s[0] += r.size
        s[1] += r.taken
        s[2] = r.target
        s[3] = max(s[3], r.size)
        assert r.taken <= 3 * r.size and r.taken % max(1, r.size) == 0
    names = sorted(sources, key=lambda x: (x is None, (x or "").encode()))
    left = sum(s[0] for s in sources.values())
    want, open_ = dict.fromkeys(names, 0.0), {n: (1, 2, 3)[i % 3] for i, n in enumerate(names)}
    total = left
    while open_ and left > 1e-9:  # share what is left by weight, cap, share the excess again
        part = left / sum(open_.values())
        left = 0.0
        for n, w in list(open_.items()):
            want[n] += part * w
            if want[n] >= 3 * sources[n][0]:
                left += want[n] - 3 * sources[n][0]
                want[n] = 3.0 * sources[n][0]
                del open_[n]
    for n in names:
        assert sources[n][2] == pytest.approx(want[n], abs=1e-6 * max(1, total))
        assert abs(sources[n][1] - want[n]) <= sources[n][3] + 1e-6
    return want


def test_mix(spark, corpus):
    rows = mixing.mix(corpus).collect()
    assert len(rows) == corpus.count() and {r.doc_id: r.size for r in rows} == {i: len(words(t)) for i, t in texts_of(corpus).items()}
    check_mix(rows)
    again = mixing.mix(corpus.repartition(7)).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)


def test_mix_caps_and_edges(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, 10), "", "a" if i < 2 else "b" if i < 5 else "c" if i < 9 else None, 0) for i in range(400)]
    want = check_mix(mixing.mix(spark.createDataFrame(rows, DOCS)).collect())
    assert want["a"] == 60.0 and want["b"] == 90.0
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    (r,) = mixing.mix(spark.createDataFrame([(1, None, "", None, 0)], DOCS)).collect()
    assert (r.size, r.target, r.taken) == (0, 0.0, 0)
    twice = spark.createDataFrame([(1, "a b", "", "s", 0)] * 4, DOCS)
    assert sum(r.taken for r in mixing.mix(twice).collect()) == 8
    assert mixing.mixed_rows(twice).count() == 4


# op 2


def test_warc_round_trip(spark):
    rng = random.Random(3)
    long = "".join(rng.choice("abc <>é\r\n") for _ in range(300_000))
    rows = [(5, "http://a/ü?q=1 2", "<p>x</p>"), (3, "http://b\r\nX: y", "<p>x</p>"), (9, None, "<p>x</p>"), (1, "u", None), (2, "u", ""), (7, "u", long), (8, "u", "Content-Length: 5\r\n\r\n"), (None, "u", "solo"), (None, "u", "<p>x</p>")]
    pages = spark.createDataFrame(rows * 1, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("first", F.lit("z"))
    manifest, folder = warc.write_archives(pages)
    assert manifest.agg(F.sum("records")).first()[0] == len(rows)
    got = warc.read_archives(manifest, folder).collect()
    payload = {(r[0], (r[2] or "")): (r[2] or "").encode() for r in rows}
    assert len(got) == len(rows)
    import base64

    for r in got:
        if r.record_type == "response":
            assert (r.page_id, bytes(r.payload).decode()) in payload and r.refers_to is None
            assert r.payload_digest == base64.b32encode(hashlib.sha1(bytes(r.payload)).digest()).decode() and r.payload_bytes == len(r.payload)
    by = {r.page_id: r for r in got if r.page_id is not None}
    assert (by[3].record_type, by[5].record_type, by[5].refers_to, by[9].refers_to) == ("response", "revisit", 3, 3)
    assert (by[1].record_type, by[2].record_type, by[2].refers_to, by[2].payload_bytes) == ("response", "revisit", 1, 0)
    assert sorted((r.record_type, r.refers_to) for r in got if r.page_id is None) == [("response", None), ("revisit", 3)]
    few = {r.page_id: r.record_type for r in warc.round_trip(pages, min_bytes=1).collect() if r.page_id in (1, 2)}
    assert few == {1: "response", 2: "response"}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_dictionary_leads_the_archive(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<html><body><p>the same frame around number {i}</p></body></html>" * 3) for i in range(400)], "page_id long, url string, html string").coalesce(1)
    manifest, folder = warc.write_archives(pages)
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    (m,) = manifest.collect()
    raw = store.open_input_stream(f"{root}/{m.path}").read()
    assert int.from_bytes(raw[:4], "little") == warc.SKIPPABLE and len(raw) == m.bytes
    assert m.bytes - 8 - int.from_bytes(raw[4:8], "little") < 400 * 250
    assert warc.read_archives(manifest, folder).filter("record_type = 'response'").count() == 400


def test_damaged_record():
    r = bytearray(warc.record(1, "u", b"hello", None, False))
    assert warc.parse(bytes(r))["payload"] == b"hello"
    r[-6] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        warc.parse(bytes(r))


# op 3


def lm_brute(texts):
    docs = {i: [*words(t), "\n."] for i, t in texts.items()}
    train = {i for i in docs if zlib.crc32(str(i).encode()) % 10}
    c1, c2 = Counter(), Counter()
    for i in train:
        c1.update(docs[i])
        c2.update(zip(["\n^", *docs[i]], docs[i]))
    n, v = sum(c1.values()), len(c1)
    ctx = dict(c1) | {"\n^": c1["\n."]}
    won, seen = Counter(), Counter()
    for (a, b), c in c2.items():
        d = len(str(ctx[a])) - 1
        seen[d] += c
        won[d] += c * (ctx[a] > 1 and (c - 1) * (n - 1) > (c1[b] - 1) * (ctx[a] - 1))
    k = {d: min(lm.HIGHEST, max(lm.LOWEST, won[d] / seen[d])) for d in seen}
    out = {}
    for i, d in docs.items():
        base = score = 0.0
        last = "\n^"
        for w in d:
            p1 = (c1[w] + 0.1) / (n + 0.1 * (v + 1))
            base += math.log10(p1)
            if ctx.get(last, 0):
                kk = k[len(str(ctx[last])) - 1]
                p1 = kk * c2[last, w] / ctx[last] + (1 - kk) * p1
            score += math.log10(p1)
            last = w
        out[i] = (i not in train, len(d), sum(c1[w] > 0 for w in d), n, base, score)
    return out


def test_lm(spark, corpus):
    got = {r.doc_id: r for r in lm.score(corpus.repartition(5)).collect()}
    want = lm_brute(texts_of(corpus))
    assert got.keys() == want.keys()
    for i, (held, n, known, total, base, score) in want.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score)


def test_lm_is_a_distribution(spark):
    rows = [(i, t, "", "", 0) for i, t in enumerate(["a b a", "b a", "a a b c", "c"] * 5)]
    probe = spark.createDataFrame(rows, DOCS)
    want = lm_brute({r[0]: r[1] for r in rows})
    assert {r.doc_id: round(r.score, 9) for r in lm.score(probe).collect()} == {i: round(w[5], 9) for i, w in want.items()}
    # probabilities of all next words after 'a', with one unknown word, sum to one
    c1 = Counter(w for i, t in ((r[0], r[1]) for r in rows) if zlib.crc32(str(i).encode()) % 10 for w in [*t.split(), "\n."])
    n, v = sum(c1.values()), len(c1)
    assert sum((c + 0.1) / (n + 0.1 * (v + 1)) for c in [*c1.values(), 0]) == pytest.approx(1.0)


def test_lm_edges(spark):
    assert lm.score(spark.createDataFrame([], DOCS)).count() == 0
    (r,) = lm.score(spark.createDataFrame([(None, None, "", "", 0)], DOCS)).collect()
    assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (None, True, 1, 0, 0)


# op 4


def passages_brute(texts, least):
    seen, out = set(), {}
    for i in sorted(texts):
        t = texts[i]
        if t is None:
            out[i] = (None, [])
            continue
        kept, spans, at = [], [], 0
        for line in t.split("\n"):
            key = tuple(words(line))
            if len(key) >= least and key in seen:
                spans += [at, at + len(line)]
            else:
                kept.append(line)
            if len(key) >= least:
                seen.add(key)
            at += len(line) + 1
        out[i] = ("\n".join(kept), spans)
    return out


def test_passages(spark, corpus):
    rng = random.Random(4)
    shared = [prose(rng, 60) for _ in range(3)]
    extra = [(100 + i, f"{prose(rng, 5)}\n{shared[i % 3]}\n{prose(rng, 12)}\n{shared[i % 3].upper()}", "", "s", 0) for i in range(9)]
    docs = corpus.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(extra, DOCS)).repartition(6)
    for least in (10, 1):
        want = passages_brute(texts_of(docs), least)
        got = {r.doc_id: (r.text, r.spans) for r in substring.dedup_passages(docs, min_words=least).collect()}
        assert got == want
    original = texts_of(docs)
    for i, (text, spans) in got.items():
        if text is not None:
            assert len(original[i]) == len(text) + sum(b - a for a, b in zip(spans[::2], spans[1::2])) + (len(spans) // 2 if text or not spans else len(spans) // 2 - 1)


def test_paragraphs_and_edges(spark):
    rows = [(2, "one two\n\nthree four\n \nfive", "", "", 0), (1, "THREE  four\n\n\nsix", "", "", 0), (None, "three four", "", "", 0), (2, "one two\n\nthree four\n \nfive", "", "", 0)]
    got = sorted(((r.doc_id, r.text, r.spans) for r in substring.dedup_passages(spark.createDataFrame(rows, DOCS), "paragraph", 1).collect()), key=str)
    assert got == sorted([(1, "THREE  four\n\n\nsix", []), (2, "one two\n\nfive", [9, 19]), (2, "one two\n\nfive", [9, 19]), (None, "three four", [])], key=str)
    assert substring.dedup_passages(spark.createDataFrame([], DOCS)).count() == 0


def windows_brute(texts, least, width=51):
    """Words left of each document, by the definition."""
    owner, seen, out = {}, set(), {}
    for i in sorted(k for k in texts if texts[k] is not None):
        w = words(texts[i])
        cover, here = set(), {}
        for p in range(len(w) - width + 1):
            x = tuple(w[p : p + width])
            here.setdefault(x, p)
            if owner.setdefault(x, i) != i or p >= here[x] + width:
                cover.update(range(p, p + width))
        left, at = [], 0
        for line in texts[i].split("\n"):
            key = tuple(words(line))
            if not (len(key) >= least and key in seen):
                left += [x for k, x in enumerate(key, at) if k not in cover]
            if len(key) >= least:
                seen.add(key)
            at += len(key)
        out[i] = left
    return out


@pytest.mark.parametrize("least", [1, 10])
def test_passages_at_any_offset(spark, corpus, least):
    rng = random.Random(8)
    passages = [prose(rng, n) for n in (51, 60, 54, 120)]
    extra = []
    for i in range(40):
        w = passages[i % 4].split()
        cut = rng.randrange(1, len(w))
        body = " ".join(w[:cut]) + rng.choice(["\n", "  ", " \n "]) + " ".join(w[cut:])
        if i % 4 == 2:
            body = "\n".join(" ".join(w[k : k + 4]) for k in range(0, len(w), 4))  # set in short lines
        extra.append((200 + i, f"{prose(rng, rng.randrange(1, 30))} {body.upper() if i % 3 else body} {prose(rng, rng.randrange(1, 30))}", "", "s", 0))
    extra += [(300, "a " * 200, "", "", 0), (301, f"{prose(rng, 50)} {passages[0][:-1]}", "", "", 0), (302, f"x {passages[3]} y {passages[3]} z", "", "", 0), (None, passages[0], "", "", 0)]
    docs = corpus.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(extra, DOCS)).repartition(5)
    found = substring.dedup_windows(docs, least).collect()
    got = {r.doc_id: r for r in found if r.doc_id is not None}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    assert {i: words(r.text) for i, r in got.items() if r.text is not None} == windows_brute(texts, least)
    assert [r.text for r in found if r.doc_id is None] == [passages[0]] and got[60].text is None
    assert all(got[200 + i].n_passages for i in range(4, 40))
    for i, r in got.items():
        gone = sum(b - a for a, b in zip(r.spans[::2], r.spans[1::2]))
        assert gone == r.removed_chars and (r.text is None or words("".join(texts[i][a:b] + "\n" for a, b in zip([0, *r.spans[1::2]], [*r.spans[::2], len(texts[i])]))) == words(r.text))


def test_passages_query_takes_short_lines(spark, tmp_path):
    from faultlens.llm import queries

    rows = [(1, "Read more\nfirst text\n\n!", "", "", 0), (2, "read  MORE\nsecond text\n\nend", "", "", 0), (3, "end\nthird", "", "", 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.text, r.n_removed) for r in queries.QUERIES["op4_line_hashing"](spark, str(tmp_path)).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("second text\n\nend", 1), 3: ("third", 1)}


# op 5

PAGE = """<!doctype html><html lang=en><head><title>T</title><style>p{}</style><script>var a='<p>no</p>';</script></head><body class="has-sidebar">
<header><h1>Site</h1><a href=/>Home</a></header><nav><ul><li><a href="/a">Menu item one</a><li><a>Menu two</a></ul></nav>
<div class="cookie-notice">We use cookies, really. Accept them all.</div>%s
<aside class="sidebar"><p>Popular: a long, long sidebar text. It has, indeed, several sentences, and commas.</p></aside>
<form><label>Mail</label><input><button>Go</button></form><div class="ad">Buy, buy, buy. Now!</div>
<section id="comments"><article class="comment"><p>First! A comment, as long as you like; it goes on, and on, and on.</p></article></section><footer>&copy; us, 2024. All rights.</footer></body></html>"""
ARTICLE = "<h2>The  title</h2><p>First <b>bold</b>   text &amp; more,\nwith a line.<p>Second&nbsp;one: short.</p><ul><li>item a<li>item b</ul><!-- <p>hidden</p> --><p>Third, with <a href=x>a link</a>.<br>And a break.</p>"
TEXT = "The title\nFirst bold text & more, with a line.\nSecond one: short.\nitem a\nitem b\nThird, with a link. And a break."


@pytest.mark.parametrize("frame", ["<article>%s</article>", "<main><div>%s</div></main>", '<div id="content"><div class="post">%s</div></div>', '<div class="page-with-sidebar"><article><div>%s</div></article></div>'])
def test_extract(frame):
    assert html.extract(PAGE % (frame % ARTICLE)) == TEXT


def test_extract_edges(spark):
    assert html.extract(None) == html.extract("") == html.extract("<p></p>") == html.extract("<script>x") == ""
    assert html.extract("just text &lt;here&gt;") == "just text <here>"
    assert html.extract("<article><p>a<p>b") == "a\nb"
    assert html.extract("<p>one</div></p></b><p>two, <i>three") == "one\ntwo, three"
    deep = "<div>" * 3000 + "<p>deep text, here.</p>"
    assert html.extract(deep) == "deep text, here."
    long = "<article>" + "".join(f"<p>Paragraph {i}, of many.</p>" for i in range(5000)) + "</article>"
    assert html.extract(long).count("\n") == 4999
    pages = spark.createDataFrame([(1, None, None), (None, "u", "<article><p>x, y.</p></article>")], "page_id long, url string, html string").withColumn("text", F.lit(3))
    assert sorted([tuple(r) for r in html.main_text(pages).collect()], key=str) == sorted([(1, None, "", 0), (None, "u", "x, y.", 5)], key=str)


@pytest.mark.parametrize("wrapper", ['class="post comments-open"', 'class="content has-sidebar"', 'id="social-science"', 'class="article-share-enabled"'])
def test_extract_wrappers_named_like_asides(wrapper):
    paragraphs = ["The first paragraph has a sentence, and it goes on for a while.", "The second one, too, is made of words: as many as it takes."]
    body = f"<div {wrapper}>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</div>"
    assert html.extract(f"<html><body><nav><a href=/>Home</a></nav>{body}</body></html>") == "\n".join(paragraphs)
    assert html.extract(f"<article><p>{paragraphs[0]}</p></article><div id=comments><p>{paragraphs[1] * 40}</p></div>") == paragraphs[0]


def test_extract_deep_and_stray_tags():
    import time

    began = time.time()
    assert html.extract("<div>" * 100_000 + "<p>deep text, here.</p>") == "deep text, here."
    assert html.extract("<div>" * 3000 + "</b>" * 100_000 + "<p>deep text, here.</p>") == "deep text, here."
    assert time.time() - began < 20


def test_extract_articles_side_by_side():
    parts = [" ".join(f"Sentence {k} of part {p}, which goes on, and on." for k in range(n)) for p, n in enumerate((8, 6, 6))]
    assert html.extract(PAGE % "".join(f"<article><p>{x}</p></article>" for x in parts)) == "\n".join(parts)


@pytest.mark.parametrize("frame", ["<article>%s</article>", "<div><p>%s</p></div>"])
def test_extract_page_in_a_form(frame):
    text = " ".join(f"Sentence {k}, which goes on, and on." for k in range(9))
    page = PAGE % (frame % text)
    page = page.replace('<body class="has-sidebar">', '<body><form action="/">').replace("</body>", "</form></body>")
    assert html.extract(page) == text
    assert html.extract("<form><h1>Join</h1><p>Sign up, now.</p></form><form style='display:none'><article><p>x, y.</p></article></form><p>%s</p>" % text) == text


def test_extract_recovers_planted_articles(spark, data):
    """Pages of the test tables wrap a text in p elements of an article."""
    import re

    pages = [r for r in spark.read.parquet(f"{data}/pages.parquet").collect() if r.html]
    for r in pages:
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)
        plain = " ".join(__import__("html").unescape(re.sub(r"<[^>]+>", " ", body[1])).split())
        assert " ".join(html.extract(r.html).split()) == plain


# op 6


def lines_brute(texts):
    rows = [(i, k, frozenset(lowered_words(line))) for i in sorted(x for x in texts if texts[x] is not None) for k, line in enumerate(texts[i].split("\n"))]
    gone, seen = set(), []
    for i, k, s in rows:
        if not s:
            continue
        if any(len(s & t) * 5 >= 4 * len(s | t) for t in seen):
            gone.add((i, k))
        seen.append(s)
    return gone


def lowered_words(line):
    return [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", line.lower()) if w]


def test_lines(spark, corpus):
    rng = random.Random(6)
    base = [prose(rng, n).split() for n in (4, 5, 9, 10, 11, 25, 60) for _ in range(4)]
    rows = []
    for i in range(60):
        lines = []
        for w in rng.sample(base, 3):
            w = list(w)
            for _ in range(rng.randrange(0, max(1, len(w) // 4))):
                w[rng.randrange(len(w))] = f"n{rng.randrange(50)}"
            rng.shuffle(w)
            lines.append("  ".join(w))
        rows.append((200 + i, "\n".join([*lines, "", lines[0]]), "", "s", 0))
    docs = corpus.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(rows, DOCS))
    for clash in ("removed", "kept_text", "n_lines", "_own", "_lines", "_num", "_row", "k2", "cls", "rank"):
        docs = docs.withColumn(clash, F.lit("x"))
    want = lines_brute(texts_of(docs))
    got = linededup.dedup_lines(docs).collect()
    assert {(r.doc_id, k) for r in got for k in r.removed} == want
    assert all(r["_own"] == r["_lines"] == r["_num"] == r["_row"] == r["cls"] == "x" for r in got)
    for r in got:
        if r.text is None:
            assert r.kept_text is None and r.n_lines == 0
        else:
            assert r.kept_text == "\n".join(x for k, x in enumerate(r.text.split("\n")) if k not in r.removed)


def test_lines_that_hardly_match(spark):
    """Pairs right at the threshold, of every length, with the changed words among the rarest or the most frequent."""
    rng = random.Random(11)
    lines = []
    for n in [*range(1, 31), 45, 90]:
        for _ in range(4):
            w = [f"v{rng.randrange(60)}" if rng.random() < 0.7 else f"r{rng.randrange(4000)}" for _ in range(n)]
            lines.append(w)
            for change in (n // 9, n // 9 + 1, n // 5):
                v = list(w)
                for k in rng.sample(range(n), min(change, n)):
                    v[k] = f"r{rng.randrange(4000)}" if rng.random() < 0.5 else f"v{rng.randrange(60)}"
                lines.append(v[: n - rng.randrange(0, 1 + n // 6)])
    rng.shuffle(lines)
    rows = [(i, "\n".join(" ".join(w) for w in lines[i : i + 4]), "", "", 0) for i in range(0, len(lines), 4)]
    docs = spark.createDataFrame(rows, DOCS)
    assert {(r.doc_id, k) for r in linededup.dedup_lines(docs).collect() for k in r.removed} == lines_brute(texts_of(docs))


def test_lines_edges(spark):
    assert linededup.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(None, "a b c", "", "", 0), (1, "a b c", "", "", 0), (1, "a b c", "", "", 0), (2, "c b a\nz", "", "", 0), (3, None, "", "", 0)]
    got = sorted(((r.doc_id, r.kept_text) for r in linededup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert got == sorted([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "z"), (3, None)], key=str)


def test_lines_with_ids_of_any_size(spark):
    rows = [(-(1 << 63), "a b c d\nq", "", "", 0), ((1 << 63) - 1, "d c b a\nz", "", "", 0), (0, "q\nr", "", "", 0)]
    got = {r.doc_id: r.kept_text for r in linededup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {-(1 << 63): "a b c d\nq", 0: "r", (1 << 63) - 1: "z"}


# op 7


def test_language_held_out_accuracy(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = langid.fit(docs.filter("doc_id % 2 = 0"))
    rows = langid.document_rows(docs.filter("doc_id % 2 = 1")).withColumn("declared", F.lit(None).cast("string"))
    met = langid.identify(rows, model, is_html=False).join(docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("truth")), "id")
    r = met.agg(F.avg((F.col("lang") == F.col("truth")).cast("double")), F.avg(F.col("kept").cast("double"))).first()
    assert r[0] > 0.95 and r[1] > 0.97


def test_language_evidence(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = langid.fit(docs)
    german = [r.text for r in docs.filter("lang = 'de'").limit(30).collect()]
    rows = [(i, f"<html lang=de><article><p>{t}</p></article>", f"http://www.beispiel.de/{i}") for i, t in enumerate(german)]
    rows += [(100, "<html lang='DE-at'><article><p>xq</p></article>", "http://www.beispiel.de/x"), (101, None, None), (102, "<p>12345 !!! ... 999</p>", "http://a.com/"), (103, "<p></p>", "nonsense"), (None, rows[0][1], "http://b.de/")]
    got = {r.id: r for r in langid.identify(langid.page_rows(spark.createDataFrame(rows, "page_id long, html string, url string")), model, is_html=True).collect()}
    assert len(got) == len(rows)
    assert sum(got[i].lang == "de" for i in range(len(german))) >= 0.9 * len(german)
    assert got[100].lang == "de" and got[100].declared == "de" and got[100].host == "www.beispiel.de"
    assert [got[k].lang for k in (101, 102, 103)] == ["und"] * 3 and not any(got[k].kept for k in (101, 102, 103))
    assert langid.identify(langid.page_rows(spark.createDataFrame([], "page_id long, html string, url string")), model, is_html=True).count() == 0


FOREIGN = [
    "Съешь ещё этих мягких французских булок да выпей же чаю. Вчера вечером мы долго гуляли по набережной и говорили о книгах.",
    "昨天晚上我们沿着河边走了很久，一边走一边谈论最近读过的书和看过的电影，天气很好。",
    "Wczoraj wieczorem długo spacerowaliśmy po nabrzeżu i rozmawialiśmy o książkach, które ostatnio przeczytaliśmy w domu.",
    "مشينا مساء أمس طويلا على الكورنيش وتحدثنا عن الكتب التي قرأناها مؤخرا",
]


def test_languages_without_a_model(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = langid.fit(docs)
    rows = spark.createDataFrame([(i, t, "en", "web") for i, t in enumerate(FOREIGN)], "doc_id long, text string, lang string, source string")
    both = langid.document_rows(rows).unionByName(langid.document_rows(docs).withColumn("id", F.col("id") + 1000))
    got = {r.id: r for r in langid.identify(both, model, is_html=False).collect()}
    assert [(got[i].lang, got[i].text_lang, got[i].kept) for i in range(4)] == [("und", "und", False)] * 4
    assert sum(r.kept for i, r in got.items() if i >= 1000) > 0.97 * (len(got) - 4)


def test_languages_come_from_the_labels(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang")
    polish = spark.createDataFrame([(10**6 + i, FOREIGN[2] * 5, "pl-PL") for i in range(30)], "doc_id long, text string, lang string")
    known = docs.unionByName(polish)
    assert langid.labels(known) == ("de", "en", "es", "fr", "pl")
    rows = spark.createDataFrame([(0, FOREIGN[2], None, "h")], "doc_id long, text string, lang string, source string")
    (r,) = langid.identify(langid.document_rows(rows), langid.fit(known, langid.labels(known)), is_html=False, languages=langid.labels(known)).collect()
    assert (r.lang, r.kept) == ("pl", True)


# op 8


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates(spark, corpus, percent):
    texts = texts_of(corpus)
    want = components(texts, near_links(texts, percent))
    got = {r.doc_id: r for r in minhash.near_duplicates(corpus, percent).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(shingles(t)) for i, t in texts.items()}
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def test_large_near_group(spark):
    """Hundreds of near copies with borderline pairs: links of components that neighbours alone don't join."""
    rng = random.Random(8)
    base = prose(rng, 100, 10**6).split()
    rows = []
    for i in range(300):
        w = list(base)
        for k in rng.sample(range(len(w)), rng.randrange(0, 4)):
            w[k] = f"y{i}_{k}"
        rows.append((i, " ".join(w), "", "", 0))
    texts = {r[0]: r[1] for r in rows}
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(4)).collect()}
    assert got == components(texts, near_links(texts, 85))


def test_near_edges(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(None, "a b c d e f", "", "", 0), (7, "a b c d e f", "", "", 0), (7, "g h i j k l", "", "", 0), (9, "G h i j k l", "", "", 0), (8, None, "", "", 0)]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert got == sorted([(None, 7, False), (7, 7, True), (7, 7, True), (9, 7, False), (8, 8, True)], key=str)


# op 9


def test_near_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 16))
    x[100:160] = x[0] + rng.normal(size=(60, 16)) * 0.25
    x[160:180] = x[7]
    x[180:190] = x[8] * rng.uniform(0.1, 1e6, (10, 1))
    x = x.astype(np.float32)
    rows = [(i, [float(c) for c in v], None) for i, v in enumerate(x)]
    bad = [(400, None, 1), (401, [], 1), (402, [0.0] * 16, 1), (403, [float("nan")] * 16, 1), (404, [float("inf")] + [1.0] * 15, 1), (405, [None] + [1.0] * 15, 1), (406, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit("x")).repartition(5)
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    want = components(range(300), [(i, j) for i, j in zip(*np.nonzero(near))])
    got = {r.vec_id: r for r in embed.near_vectors(df).collect()}
    assert {i: got[i].component_id for i in want} == want
    assert [got[i].n_links for i in range(300)] == near.sum(axis=1).tolist()
    assert all(got[b[0]].n_links == 0 and got[b[0]].component_id == b[0] and got[b[0]].kept for b in bad)


def test_near_vectors_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=8) + rng.normal(size=(200, 8)) * 0.3
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    monkeypatch.setattr(embed, "BLOCK", 40)
    got = {r.vec_id: r.n_links for r in embed.near_vectors(df).collect()}
    assert [got[i] for i in range(200)] == near.sum(axis=1).tolist()


def test_near_vectors_edges(spark):
    kind = "vec_id long, embedding array<float>"
    assert embed.near_vectors(spark.createDataFrame([], kind)).count() == 0
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embed.near_vectors(spark.createDataFrame([(None, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [0.0, 1.0]), (5, [0.0, 2.0])], kind)).collect()), key=str)
    assert got == sorted([(None, 1, 3, False), (3, 1, 3, True), (3, 1, 3, True), (5, 1, 3, False)], key=str)


# op 10


def alnum(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def decontam_brute(docs, items):
    out = {}
    for i, text in docs.items():
        w, hit, found = alnum(text), set(), set()
        for item, t in items.items():
            v = alnum(t)
            for k in range(max(1, len(v) - 12)) if v else ():
                win = v[k : k + 13]
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit.update(range(p, p + len(win)))
                        found.add(str(item))
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def planted(rng):
    items = {1: prose(rng, 30), 2: "short item!", 10: prose(rng, 13), 3: None, 4: "", 5: "a a a a"}
    docs = {0: None, 1: "", 2: f"x {items[1]} y", 3: prose(rng, 5) + " Short, ITEM " + prose(rng, 5), 4: prose(rng, 400) + " " + items[10], 5: "a a a a a a", 6: " ".join(items[1].split()[:12]), 7: " ".join(items[1].split()[5:18]).upper() + " " + prose(rng, 300), 8: prose(rng, 50)}
    return docs, items


@pytest.mark.parametrize("one_pass", [True, False])
def test_decontamination(spark, monkeypatch, one_pass):
    docs, items = planted(random.Random(9))
    if not one_pass:
        monkeypatch.setattr(decontam, "PASS_BYTES", 20)
    df = spark.createDataFrame([(i, t, "b") for i, t in docs.items()], "doc_id long, text string, spans string").repartition(3)
    bench = spark.createDataFrame([(i, t, 1) for i, t in items.items()], "item_id long, text string, doc_id int")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.decontaminate(df, bench).collect()}
    assert got == decontam_brute(docs, items)


@pytest.mark.parametrize("one_pass", [True, False])
def test_decontamination_by_items_without_an_id(spark, monkeypatch, tmp_path, one_pass):
    import duckdb
    from compare import rows_of, rows_sql

    from faultlens.llm import queries

    if not one_pass:
        monkeypatch.setattr(decontam, "PASS_BYTES", 20)
    docs, items = planted(random.Random(9))
    bench = [(i, t) for i, t in items.items() if i != 1] + [(None, items[1]), (None, "no id here")]
    docs[20] = "there is no id here"
    spark.createDataFrame([(i, t) for i, t in docs.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = queries.QUERIES["op10_decontamination"](spark, str(tmp_path))
    assert rows_of(got) == rows_sql(con, queries.ORACLE_SQL["op10_decontamination"])
    assert {r.doc_id for r in got.filter("contaminated").collect()} >= {2, 20}


def test_decontamination_edges(spark):
    kind = "doc_id long, text string"
    bench = spark.createDataFrame([], "item_id long, text string")
    (r,) = decontam.decontaminate(spark.createDataFrame([(None, "a b")], kind), bench).collect()
    assert (r.doc_id, r.n_words, r.n_hit, r.contaminated) == (None, 2, 0, False)
    assert decontam.decontaminate(spark.createDataFrame([], kind), bench).count() == 0


def test_proximity(spark):
    df = spark.createDataFrame([(1, "alpha x beta"), (2, "beta alpha"), (3, "alpha x y z beta"), (4, "alpha"), (5, "beta end")], "doc_id long, text string").coalesce(1)
    index = decontam.build_index(df)
    got = sorted(r.doc_id for r in decontam.proximity(index, ["Alpha beta"], slop=1).collect())
    assert got == [1, 2]


def test_line_words_and_maps_equal_plain_ones(spark):
    rows = ["", " ", "a", " a", "a ", "a  b", "a\tb c", "\x0b\x0ca\rb", "a b a", "\u00a0 x"]
    got = spark.createDataFrame([(r,) for r in rows], "t string").selectExpr("t", f"{linededup.words('t')} as w").collect()
    assert [(r.t, r.w) for r in got] == [(t, [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]) for t in rows]
    hs = [1, -1, 64, 70, -70, 2**31 - 1, -(2**31)]
    m = spark.createDataFrame([(hs,)], "hs array<int>").selectExpr(*linededup.PARITY.split(", aggregate")[:1], "aggregate" + linededup.PARITY.split(", aggregate")[1]).first()
    every = signed = 0
    for h in hs:
        every ^= 1 << h % 64
        signed ^= (h < 0) << h % 64
    assert (m.m0 % 2**64, m.m1 % 2**64) == (every, signed)


def test_line_steps_leave_no_shuffle_files(spark):
    def files():
        store = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return {p for d in store.localDirs() for p in Path(d.getPath()).rglob("shuffle_*")}

    before = files()
    linededup.stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "x")
    for _ in range(50):
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left


def test_line_tables_are_plain(spark):
    """Arrays are sorted as primitive values, one map for short lines, no join for the levels, and tables with neither dictionaries nor a group around each element."""
    texts = spark.createDataFrame([(1, "a b c\n x\n\n \t"), (2, " ".join(f"w{i}" for i in range(linededup.LONG + 1)))], "_num long, text string")
    lines = linededup.stored(linededup.token_lines(texts, 31), "lines")
    assert sorted((r["rank"], len(r.hs)) for r in lines.collect()) == [(1 << 31, 3), ((1 << 31) + 1, 1), (2 << 31, linededup.LONG + 1)]
    file = next(f for f in Path(lines.stored_at.removeprefix("file:")).glob("*.parquet") if pq.ParquetFile(f).metadata.num_rows)
    columns = [pq.ParquetFile(file).metadata.row_group(0).column(k) for k in range(4)]
    assert [c.path_in_schema for c in columns] == ["rank", "k1", "k2", "hs.array"] and not any(c.has_dictionary_page for c in columns)
    levels = linededup.token_levels(lines, 1 << 12)
    assert "Join" not in levels._jdf.queryExecution().optimizedPlan().toString()
    got = linededup.prefixed(lines, linededup.stored(levels, "levels"), 1 << 12)
    assert not got.schema["tokens"].dataType.containsNull
    assert [bool(r.m1) for r in got.orderBy("rank").collect()] == [False, False, True]

"""The pipeline's stages, each against brute force on its own input, and the registered queries against their SQL."""

import random

import pytest
from compare import duck, rows_of, rows_sql
from brute import prose
from test_operators import DOCS, check_mix, decontam_brute, lines_brute

import corpus_pipeline
from faultlens.llm import queries


@pytest.fixture(scope="module")
def folder(spark, data, tmp_path_factory):
    """The test tables with fewer documents and planted cases."""
    out = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(1)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    bench = spark.read.parquet(f"{data}/benchmark.parquet")
    item = bench.filter("text is not null").orderBy("item_id").first().text
    some = [r.text for r in docs.orderBy("doc_id").limit(40).collect()]
    new = [(9001, None, "en", "src0", 0), (9002, "", "en", "src0", 0), (9003, "12 34 !! 56", "en", "src0", 0), (9004, some[0], "en", "src1", 0), (9005, item + " " + some[3][:200], "en", "src1", 0), (None, some[1], "en", "src1", 0), (9006, prose(rng, 50), "en", None, 0)]
    w = some[5].split()
    if len(w) > 60:
        new.append((9007, " ".join([*w[:-2], "zz", "yy"]), "en", "src2", 0))
    docs.limit(80).unionByName(spark.createDataFrame(new, DOCS)).write.parquet(f"{out}/documents.parquet")
    bench.write.parquet(f"{out}/benchmark.parquet")
    return out


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        after = stage(spark, docs, folder)
        after.write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        rows = {r.doc_id: r for r in after.collect()}
        if name != "mix":
            assert after.columns == corpus_pipeline.COLUMNS
        if name == "language":
            assert not {None, 9001, 9002, 9003} & set(rows) and len(rows) >= 0.95 * (len(before) - 4)
        if name == "lines":
            gone = lines_brute(before)
            for i, text in before.items():
                left = [x for k, x in enumerate(text.split("\n")) if (i, k) not in gone]
                if any(x.split() for x in left):
                    assert rows[i].text == "\n".join(left)
                else:
                    assert i not in rows
        if name == "near":
            from brute import components, near_links

            assert set(rows) == {i for i, c in components(before, near_links(before, 80)).items() if i == c}
        if name == "clean":
            items = {r.item_id: r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
            assert set(rows) == {i for i, v in decontam_brute(before, items).items() if not v[4]}
        if name == "mix":
            from faultlens.llm.mixing import mix

            check_mix(mix(docs).collect())
            assert all(r.copies > 0 for r in rows.values())
        docs = after
    names, got = rows_of(corpus_pipeline.run(spark, folder))
    assert (names, got) == rows_of(docs)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, data, name):
    names, rows = rows_of(queries.QUERIES[name](spark, data))
    if name in queries.ORACLE_SQL:
        assert (names, rows) == rows_sql(duck(data), queries.ORACLE_SQL[name])
    else:
        assert rows

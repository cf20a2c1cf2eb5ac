"""Queries over every case, against brute force on a small fixture."""

import hashlib
from collections import Counter, defaultdict

import pytest
from compare import rows_of, rows_sql
from pyspark.sql import functions as F

from faultlens.plans import catalogue

LINES = [(k, n, f, s, t, q) for k in (1, 2, 3, 4, 50, 51, 100, 101, 150) for n, f, s, t, q in [(1, "N", "O", 0.02, 25.0), (2, "R", "F", 0.08, 10.0), (5, "N", "O", 0.01, 3.0), (7, "A", "F", 0.05, 25.0)][: 1 + k % 4]]
ORDERS = [(k, k % 13, "OFP"[k % 3]) for k in range(1, 41)]
CUSTOMERS = range(1, 31)


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(LINES, "l_orderkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_tax double, l_quantity double").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame(ORDERS, "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame([(k,) for k in CUSTOMERS], "c_custkey long").write.parquet(f"{d}/customer.parquet")
    return d


def rows(spark, d, name):
    return sorted(tuple(r) for r in catalogue.QUERIES[name](spark, d).collect())


def test_every_order_is_a_case(spark, small):
    tokens, late = defaultdict(list), defaultdict(list)
    for k, n, f, s, t, q in LINES:
        tokens[k].append(f"{f}{s}{n}")
        first = "TIMEOUT" if t > 0.07 else "DIGEST_MISMATCH" if f != "N" else ""
        if why := "+".join(x for x in (first, "LATENCY_MISMATCH" if q != 25 else "") if x):
            late[k].append(why)
    profile = {k: ";".join(sorted(v)) for k, v in tokens.items()}
    looked, said = [], []
    for k in profile:
        members = [m for m in profile if profile[m] == profile[k]] if k % 100 else []
        sites = {m // 2 for m in members}
        looked.append((k, len(members), len(sites), sum(sites)))
        result = "NO_OBSERVED_ANOMALY" if not late[k] else "NO_CATALOG_MATCH" if not members else "UNIQUE_SITE_IN_CATALOG" if len(sites) == 1 else "AMBIGUOUS_SITES_IN_CATALOG"
        said.append((k, len(late[k]), len(members), len(sites), result))
    assert rows(spark, small, "catalogue_lookup") == sorted(looked)
    assert rows(spark, small, "diagnose_observations") == sorted(said)
    assert rows(spark, small, "deviation_reasons") == sorted(Counter(x for v in late.values() for x in v).items())
    assert rows(spark, small, "catalogue_self_check") == [(0,)]


def test_self_check_sees_every_profile(spark, small, monkeypatch):
    from faultlens.operators import diagnosis

    whole = diagnosis.lookup
    monkeypatch.setattr(diagnosis, "lookup", lambda *a: whole(*a).withColumn("candidate_sites", F.expr("filter(candidate_sites, x -> x <> 50)")))
    assert rows(spark, small, "catalogue_self_check") == [(2,)]  # orders 100 and 101


def test_every_order_is_scored(spark, small):
    t = [(s != "O", k % 3, k % 4 != 0, k % 5 == 0) for k, _, s in ORDERS]
    got = {m: (n, o) for m, n, o in rows(spark, small, "blinded_score")}
    present = [x for x in t if x[0]]
    assert got["false_alarms"] == (sum(not f and a for f, _, a, _ in t), len(t) - len(present))
    assert got["all_detected"] == (sum(a for _, _, a, _ in present), len(present))
    assert got["exact_site_all"] == (sum(a and e for _, _, a, e in present), len(present))


def test_every_customer_has_an_arc(spark, small):
    top = max(CUSTOMERS)
    to = {k: 1 + int(hashlib.sha256(f"arc{k}".encode()).hexdigest()[:8], 16) % top for k in CUSTOMERS}

    def ahead(k):
        seen = []
        while k not in seen:
            seen.append(k)
            k = to[k]
        return set(seen)

    reach = {k: ahead(k) for k in CUSTOMERS}
    strong = sorted((k, max(j for j in CUSTOMERS if j in reach[k] and k in reach[j])) for k in CUSTOMERS)
    label = {k: k for k in CUSTOMERS}
    for _ in CUSTOMERS:
        for k, j in to.items():
            label[k] = label[j] = min(label[k], label[j])
    assert rows(spark, small, "strong_components") == strong
    assert rows(spark, small, "weak_components") == sorted(label.items())
    assert rows(spark, small, "component_sizes") == sorted(Counter(label.values()).items())


def test_bootstraps_take_the_references_replicates(spark, data):
    import numpy as np

    reps = rows(spark, data, "bootstrap_replicates")
    assert [r[0] for r in reps] == list(range(1000))
    low, high, n = rows(spark, data, "bootstrap_interval")[0]
    assert n == 1000 and np.allclose([low, high], np.percentile([m for _, m in reps], [2.5, 97.5]), atol=2e-6)
    assert [r[2] for r in rows(spark, data, "seeded_bootstrap")] == [1000]


def duckdb_of(d, *tables):
    import duckdb

    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from read_parquet('{d}/{t}.parquet/*.parquet')")
    return con


@pytest.fixture(scope="module")
def split_tables(spark, tmp_path_factory):
    """90 customers, of which 0.70 falls short of 63 in floating point, each with an order or more."""
    d = str(tmp_path_factory.mktemp("split"))
    spark.createDataFrame([(k,) for k in range(90)], "c_custkey long").write.parquet(f"{d}/customer.parquet")
    spark.createDataFrame([(k, k % 90, "OFP"[k % 7 % 3]) for k in range(200)], "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(f"{d}/orders.parquet")
    return d


def test_split_takes_exact_shares(spark, split_tables):
    sizes = Counter(r["partition"] for r in catalogue.QUERIES["group_split"](spark, split_tables).collect())
    assert sizes == {"DEV_TRAIN": 63, "DEV_CALIBRATION": 13, "DEV_SITE_TEST": 14}
    assert rows_of(catalogue.QUERIES["group_split"](spark, split_tables)) == rows_sql(duckdb_of(split_tables, "customer"), catalogue.ORACLE_SQL["group_split"])


def test_partition_statistics_equals_sql(spark, split_tables, tmp_path):
    def same(d):
        got = rows_of(catalogue.QUERIES["partition_statistics"](spark, d))
        assert got == rows_sql(duckdb_of(d, "customer", "orders"), catalogue.ORACLE_SQL["partition_statistics"])
        return got[1]

    assert len(same(split_tables)) == 3
    # 41/640 = 0.0640625, a tie at the sixth place
    d = str(tmp_path)
    spark.createDataFrame([(k,) for k in range(90)], "c_custkey long").write.parquet(f"{d}/customer.parquet")
    spark.createDataFrame([(k, 7, "F" if k < 41 else "O") for k in range(640)], "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(f"{d}/orders.parquet")
    assert same(d)[0][-1] == "0.064062"


def test_k_hop_features_broadcasts_no_table_of_nodes(spark, data, monkeypatch):
    from faultlens.operators import graph

    plans = []

    def stored(df, name, keep=graph.stored):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, name)

    monkeypatch.setattr(graph, "stored", stored)
    plans.append(catalogue.QUERIES["k_hop_features"](spark, data)._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == 9  # two of weights, six hops, the result
    assert not [p for p in plans if "Broadcast" in p]

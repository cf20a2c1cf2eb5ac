"""A synthetic mini campaign: 2 batches of 4 and 3 sites, 2 faults, 4 vectors, with its netlist."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from faultlens.operators import diagnosis, graph, integrity, relational, rows
from faultlens.sources import campaign, tables
from faultlens.streaming.ingest import ingest

BATCHES = {0: 4, 1: 3}
VECTORS = 4


def digest(x):
    return hashlib.sha256(str(x).encode()).hexdigest()


def row(batch, site, selector, stuck, slot, vector, effect):
    good = digest(f"v{slot}")
    base = {"batch_id": batch, "run_type": "ENABLED", "site_selection": selector, "selector": selector, "site_id": site, "stuck_value": stuck, "vector_slot": slot, "vector_id": vector, "fault_enable": 1, "cycles": 343, "baseline_cycles": 343, "timed_out": 0, "activity": 0, "detected": 0, "unknown": 0, "expected_digest": good, "actual_digest": good}
    if effect == "active":
        base |= {"activity": 1}
    if effect and effect.startswith("digest"):
        base |= {"activity": 1, "detected": 1, "actual_digest": digest(f"{effect}{slot}")}
    if effect == "late":
        base |= {"activity": 1, "detected": 1, "cycles": 350}
    if effect == "timeout":
        base |= {"activity": 1, "detected": 1, "cycles": 2000, "timed_out": 1, "actual_digest": digest(f"hang{slot}{site}")}
    return base


#: (site number, stuck value) to effect: sites 2 and 3 share a profile; both faults of site 4 do.
EFFECTS = {(1, 0): None, (1, 1): "active", (2, 0): "digest-a", (2, 1): "late", (3, 0): "digest-a", (3, 1): "timeout", (4, 0): "digest-b", (4, 1): "digest-b", (5, 0): "digest-c", (5, 1): None, (6, 0): None, (6, 1): "digest-d", (7, 0): "active", (7, 1): "timeout"}


def mini():
    out, number = [], 0
    for batch, size in BATCHES.items():
        for slot in range(VECTORS):
            out.append(row(batch, "BASELINE", -1, -1, slot, 100 + slot, None) | {"run_type": "BASELINE", "fault_enable": 0})
        for selector in range(size):
            number += 1
            for stuck in (0, 1):
                out += [row(batch, f"SITE-{number:06d}", selector, stuck, slot, 100 + slot, EFFECTS[number, stuck]) for slot in range(VECTORS)]
    return out


def write(folder, rows_, name="batch_{}.csv", columns=campaign.RAW):
    folder.mkdir(exist_ok=True)
    for b in BATCHES:
        lines = [",".join(columns)] + [",".join(str(r[c]) for c in columns) for r in rows_ if r["batch_id"] == b]
        (folder / name.format(b)).write_text("\n".join(lines) + "\n")
    return str(folder)


@pytest.fixture
def raw(spark, tmp_path):
    return campaign.read_campaign(spark, write(tmp_path / "csv", mini()))


@pytest.fixture
def canonical(raw):
    return campaign.consolidate(raw)


def test_sizes_and_rules(canonical):
    assert canonical.count() == 64 and rows.enabled(canonical).count() == 56
    assert {r.rule: r.broken for r in rows.violations(canonical, rows.campaign_rules()).collect()} == dict.fromkeys(rows.campaign_rules(), 0)
    assert relational.is_contiguous(canonical, "record_id").first().contiguous


def test_rules_find_a_broken_row(spark, tmp_path):
    bad = mini()
    bad[9] |= {"detected": 1, "activity": 0}
    df = campaign.consolidate(campaign.read_campaign(spark, write(tmp_path / "csv", bad)))
    found = {r.rule: r.broken for r in rows.violations(df, rows.campaign_rules()).collect()}
    assert found["detected_means_activity"] == 1 and found["label_follows"] == 1


def test_wrong_header_and_bad_numbers_fail(spark, tmp_path):
    folder = write(tmp_path / "csv", mini(), columns=[*campaign.RAW[1:], campaign.RAW[0]])
    with pytest.raises(Exception):  # noqa: B017
        campaign.read_campaign(spark, folder).count()
    broken = mini()
    broken[3] |= {"cycles": "x"}
    with pytest.raises(Exception):  # noqa: B017
        campaign.read_campaign(spark, write(tmp_path / "bad", broken)).agg(F.sum("cycles")).collect()
    odd = mini()
    odd[3] |= {"cycles": "0343"}
    found = {r["column"]: r.broken for r in campaign.non_canonical(spark, write(tmp_path / "odd", odd), campaign.RAW).collect()}
    assert found["cycles"] == 1 and sum(found.values()) == 1


def test_second_schema_version(spark, tmp_path):
    rows_ = [r | {"vector_partition": "VALIDATION"} for r in mini()]
    df = rows.canonical(campaign.read_campaign(spark, write(tmp_path / "csv", rows_, columns=campaign.RAW_2), version=2))
    assert [r[0] for r in df.select("vector_split").distinct().collect()] == ["VALIDATION"]


def test_campaign_check_and_coverage(spark, raw):
    found = {r.batch_id: (r.n_rows, r.n_baseline, r.n_unknown, r.n_silent) for r in campaign.campaign_check(raw).collect()}
    assert found == {0: (36, 4, 0, 0), 1: (28, 4, 0, 0)}
    enabled = rows.enabled(raw)
    assert relational.incomplete_groups(enabled, ["site_id", "stuck_value"], ["vector_slot"], VECTORS).count() == 0
    fewer = enabled.filter("not (site_id = 'SITE-000002' and vector_slot = 3 and stuck_value = 0)")
    assert relational.incomplete_groups(fewer, ["site_id", "stuck_value"], ["vector_slot"], VECTORS).count() == 1


def test_diagnosis(spark, canonical):
    token = F.concat_ws("-", "timed_out", "cycles", F.when(F.col("timed_out") == 1, "").otherwise(F.col("actual_digest")))
    enabled = rows.enabled(canonical).withColumn("instance", F.concat_ws(":", "site_id", F.col("stuck_value").cast("string")))
    by = diagnosis.profiles(enabled, "instance", "vector_slot", token)
    site = F.split_part("instance", F.lit(":"), F.lit(1))
    suite = campaign.reference_suite(canonical, VECTORS)
    normal = ";".join(f"0-343-{digest(f'v{s}')}" for s in range(VECTORS))
    s = diagnosis.distinguishability(diagnosis.groups(by, "instance", site), normal).first()
    # no effect or activity only: 1:0, 1:1, 5:1, 6:0, 7:0; shared by sites: 2:0 with 3:0, 3:1 with 7:1
    assert (s.indistinguishable_instances, s.unique_site_instances, s.ambiguous_instances, s.largest_site_set) == (5, 5, 4, 2)
    ids, faults = diagnosis.catalogue(by, "instance")
    observed = by.filter(site.isin("SITE-000001", "SITE-000002", "SITE-000004")).withColumnRenamed("instance", "case_id")
    observed = observed.unionByName(spark.createDataFrame([("unknown", "x")], "case_id string, profile string"))
    found = diagnosis.lookup(observed, ids, faults, "case_id", "instance", site)
    seen = enabled.select(F.col("instance").alias("case_id"), "vector_slot", "timed_out", "cycles", F.col("actual_digest").alias("digest")).unionByName(spark.createDataFrame([("unknown", 0, 0, 343, "x")], "case_id string, vector_slot int, timed_out int, cycles int, digest string"))
    dev = diagnosis.deviations(seen, suite, "vector_slot")
    got = {r.case_id: r.result for r in diagnosis.diagnose(observed, found, dev, "case_id").collect()}
    assert got == {"SITE-000001:0": "NO_OBSERVED_ANOMALY", "SITE-000001:1": "NO_OBSERVED_ANOMALY", "SITE-000002:0": "AMBIGUOUS_SITES_IN_CATALOG", "SITE-000002:1": "UNIQUE_SITE_IN_CATALOG", "SITE-000004:0": "UNIQUE_SITE_IN_CATALOG", "SITE-000004:1": "UNIQUE_SITE_IN_CATALOG", "unknown": "NO_CATALOG_MATCH"}
    assert diagnosis.self_check(found, observed.filter("case_id <> 'unknown'").withColumn("site", F.split_part("case_id", F.lit(":"), F.lit(1))), "case_id", "site").count() == 0


BAD_OBSERVATIONS = {
    "missing row": lambda o: o[:-1], "extra row": lambda o: [*o, {**o[0], "vector_slot": 64, "vector_id": 164}], "duplicate": lambda o: [*o[:-1], o[0]], "vector id": lambda o: [{**o[0], "vector_id": 7}, *o[1:]], "not hex": lambda o: [{**o[0], "actual_digest": "z" * 64}, *o[1:]],
    "empty digest": lambda o: [{**o[0], "actual_digest": None}, *o[1:]], "negative cycles": lambda o: [{**o[0], "cycles": -1}, *o[1:]], "too many cycles": lambda o: [{**o[0], "cycles": 2001}, *o[1:]], "timeout 2": lambda o: [{**o[0], "timed_out": 2}, *o[1:]], "timeout cycles": lambda o: [{**o[0], "timed_out": 1}, *o[1:]],
}


@pytest.mark.parametrize("kind", [None, *BAD_OBSERVATIONS])
def test_intake(spark, tmp_path, kind):
    good = [{"vector_slot": s, "vector_id": 100 + s, "actual_digest": digest(s), "cycles": 343, "timed_out": 0} for s in range(8)]
    good[3] |= {"timed_out": 1, "cycles": 2000, "actual_digest": None}
    suite = spark.createDataFrame([(s, 100 + s) for s in range(8)], "vector_slot int, vector_id int")
    o = BAD_OBSERVATIONS[kind](good) if kind else good
    path = tmp_path / "o.csv"
    path.write_text("\n".join([",".join(campaign.OBSERVATION)] + [",".join("" if r[c] is None else str(r[c]) for c in campaign.OBSERVATION) for r in o]))
    errors = diagnosis.intake_errors(campaign.read_observations(spark, str(path)), suite, 8)
    assert (errors.agg(F.sum("broken")).first()[0] > 0) == bool(kind)


def test_observation_header_and_size(spark, tmp_path):
    path = tmp_path / "o.csv"
    path.write_text("vector_slot,vector_id,actual_digest,cycles,timed_out,extra\n0,1,,2000,1,5\n")
    with pytest.raises(Exception):  # noqa: B017
        campaign.read_observations(spark, str(path)).collect()
    path.write_text("x" * (campaign.OBSERVATION_BYTES + 1))
    with pytest.raises(ValueError, match="bytes"):
        campaign.read_observations(spark, str(path))


def test_streaming_ingest_resumes(spark, tmp_path):
    folder = write(tmp_path / "csv", mini())
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    assert ingest(spark, folder, out, progress).count() == 64
    assert ingest(spark, folder, out, progress).count() == 64
    extra = [r | {"batch_id": 2} for r in mini() if r["batch_id"] == 0]
    (tmp_path / "csv" / "batch_2.csv").write_text("\n".join([",".join(campaign.RAW)] + [",".join(str(r[c]) for c in campaign.RAW) for r in extra]) + "\n")
    assert ingest(spark, folder, out, progress).count() == 100


def cell(kind, inputs, output):
    return {"type": kind, "port_directions": {**dict.fromkeys(inputs, "input"), "Y": "output"}, "connections": {**{k: [v] for k, v in inputs.items()}, "Y": [output]}}


NET = {
    "modules": {
        "top": {
            "ports": {"clk": {"direction": "input", "bits": [2]}, "also_clk": {"direction": "input", "bits": [2]}, "q": {"direction": "output", "bits": [16]}},
            "cells": {
                "c1": cell("AND", {"A": 12, "B": "1"}, 11), "c2": cell("DFF", {"D": 11, "CLK": 2}, 12), "c3": cell("OR", {"A": 12, "B": 12}, 13),
                "c4": cell("MUX", {"A": 13, "S0": 15}, 14), "c5": cell("BUF", {"A": 14}, 15), "c6": cell("XOR", {"A": 16, "B": 15}, 16), "c7": cell("BUF", {"A": 11}, 17),
            },
            "netnames": {"n": {"bits": [11, 12]}, "alias": {"bits": [11]}},
        }
    }
}


def netlist(spark, tmp_path, doc):
    path = tmp_path / "net.json"
    path.write_text(json.dumps(doc))
    return campaign.read_netlist(spark, str(path), "top")


def test_netlist_to_graph(spark, tmp_path):
    n = netlist(spark, tmp_path, NET)
    names = {"c%d" % i: i - 1 for i in range(1, 8)}
    index = spark.createDataFrame(list(names.items()), "cell string, node int")
    pins = n["pins"].join(index.withColumnRenamed("node", "dst"), "cell")
    drivers = n["drivers"].join(index, "cell").select("bit", F.col("node").alias("src"))
    branches = graph.classify_branches(pins, drivers, n["inputs"])
    a = graph.branch_accounting(branches).first()
    assert (a.internal, a.top_input, a.constant, a.undriven) == (10, 2, 1, 0)
    edges = graph.collapse(branches.filter("source_kind = 'INTERNAL'"))
    got = {(r.src, r.dst): (r.multiplicity, r.is_self_loop, r.select_branches) for r in edges.collect()}
    assert got[1, 2] == (2, 0, 0) and got[5, 5] == (1, 1, 0) and got[4, 3] == (1, 0, 1)
    nodes = index.select("node")
    weak = {r.node: r.component for r in graph.weak_components(edges, nodes).collect()}
    assert set(weak.values()) == {0}
    strong = {r.node: r.component for r in graph.strong_components(edges, nodes).collect()}
    assert strong[0] == strong[1] == 1 and strong[3] == strong[4] == 4 and len({strong[k] for k in (2, 5, 6)}) == 3
    d = {r.node: (r.in_degree_branches, r.out_neighbor_count) for r in graph.degrees(edges, nodes).collect()}
    assert d[2] == (2, 1) and d[6] == (1, 0)
    assert {r.bit: r.names for r in n["nets"].collect()} == {11: ["alias", "n"], 12: ["n"]}
    assert [r.bit for r in n["outputs"].collect()] == [16]


def test_two_drivers_fail(spark, tmp_path):
    doc = json.loads(json.dumps(NET))
    doc["modules"]["top"]["cells"]["c7"]["connections"]["Y"] = [11]
    with pytest.raises(Exception, match="two drivers"):
        netlist(spark, tmp_path, doc)["drivers"].collect()


def test_propagation_against_numpy(spark):
    import numpy as np

    e = [(0, 1, 2), (1, 2, 1), (2, 0, 1), (2, 2, 3)]
    edges = spark.createDataFrame(e, "src int, dst int, multiplicity int")
    nodes = spark.createDataFrame([(i,) for i in range(4)], "node int")
    base = spark.createDataFrame([(i, float(i), float(i * i)) for i in range(4)], "node int, x double, y double")
    got = {r.node: r.features for r in graph.graph_features(edges, nodes, base, ["x", "y"], 2).collect()}
    x = np.array([[i, i * i] for i in range(4)], float)
    want = [x]
    for t in (True, False):
        a = np.eye(4)
        for s, d, m in e:
            a[(d, s) if t else (s, d)] += m
        a /= a.sum(axis=1, keepdims=True)
        want += [a @ x, a @ a @ x]
    assert np.allclose(np.array([got[i] for i in range(4)]), np.concatenate(want, axis=1))
    z = {r.node: r.features for r in graph.scaled(graph.graph_features(edges, nodes, base, ["x", "y"], 1), nodes.filter("node < 3"), 6).collect()}
    full = np.array([got[i] for i in range(4)])[:, [0, 1, 2, 3, 6, 7]]
    mean, dev = full[:3].mean(axis=0), full[:3].std(axis=0)
    assert np.allclose(np.array([z[i] for i in range(4)]), (full - mean) / np.where(dev == 0, 1, dev), atol=1e-5)


def test_sinks_and_ledger(spark, tmp_path, canonical):
    back = tables.write_verified(canonical, str(tmp_path / "t.parquet"))
    assert back.count() == 64
    with pytest.raises(Exception):  # noqa: B017
        tables.write_once(canonical, str(tmp_path / "t.parquet"))
    tables.write_csv(canonical, str(tmp_path / "c.csv"), compressed=True)
    assert campaign.read_canonical(spark, str(tmp_path / "c.csv")).count() == 64
    one = campaign.manifest(spark, str(tmp_path / "c.csv"))
    kept = spark.createDataFrame(one.collect(), one.schema)
    assert integrity.ledger_changes(kept, one).count() == 0
    (tmp_path / "c.csv" / "extra.txt").write_text("x")
    assert [r.change for r in integrity.ledger_changes(kept, campaign.manifest(spark, str(tmp_path / "c.csv"))).collect()] == ["ADDED"]
    tables.publish_json({"a": 1}, str(tmp_path / "d.json"))
    with pytest.raises(FileExistsError):
        tables.publish_json({"a": 2}, str(tmp_path / "d.json"))
    assert "| a |" in tables.report("t", [{"a": 1}])


def test_documents_and_evidence(tmp_path):
    p = tmp_path / "x.json"
    p.write_text('{"a": {"sites": [{"id": 1, "k": 2}]}, "path": "/home/me/x"}')
    doc = campaign.load_json(str(p))
    assert campaign.find_rows(doc, {"id", "k"}) == [{"id": 1, "k": 2}] and campaign.find_rows(doc, {"none"}) is None
    assert integrity.redacted(doc)["path"] == "<redacted>/x"
    assert ("a.sites[0].id", 1) in integrity.scalar_values(doc)
    integrity.verify_file(str(p), integrity.file_sha256(str(p)))
    with pytest.raises(ValueError):
        integrity.verify_file(str(p), "0")
    with pytest.raises(ValueError):
        integrity.fields_agree({"a": True}, {"a": 1})
    p.write_text('{"a": 1, "a": 2}')
    with pytest.raises(ValueError, match="repeats"):
        campaign.load_json(str(p))


def test_vectors_logs_and_plan(spark, tmp_path):
    pool = tmp_path / "pool.json"
    pool.write_text(json.dumps([{"vector_id": i, "split": "TRAIN" if i < 5 else "HOLDOUT_TEST", "key": digest(i)} for i in range(8)]))
    assert [(r.vector_slot, r.vector_id) for r in campaign.read_vectors(spark, str(pool), [3, 1], "TRAIN").orderBy("vector_slot").collect()] == [(0, 3), (1, 1)]
    with pytest.raises(Exception, match="not of split"):
        campaign.read_vectors(spark, str(pool), [6], "TRAIN").collect()
    (tmp_path / "run.log").write_text("start\nelapsed: 12 s\nrows=64\n")
    assert {r.field: r.value for r in campaign.read_log(spark, str(tmp_path / "run.log"), {"s": r"elapsed: (\d+)", "n": r"rows=(\d+)"}).collect()} == {"s": "12", "n": "64"}
    assert relational.batch_plan(22839, 512)[-1] == {"batch_id": 44, "first_site": 22529, "sites": 311}
    plan = spark.createDataFrame([(0, 36), (1, 28)], "batch_id int, n_rows int")
    assert [r.batch_id for r in integrity.pending_batches(plan, plan.filter("batch_id = 0")).collect()] == [1]

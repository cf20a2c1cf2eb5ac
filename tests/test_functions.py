import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from faultlens.functions import scalar
from faultlens.operators import rows


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first()[0]


def test_strict_int(spark):
    assert one(spark, scalar.strict_int(F.lit("-12"))) == -12
    for bad in ("+1", "01", "-0", " 1", "1.0", ""):
        with pytest.raises(Exception, match="canonical"):
            one(spark, scalar.strict_int(F.lit(bad)))
        assert one(spark, scalar.is_canonical_int(F.lit(bad))) is False


def test_strict_bit(spark):
    assert [one(spark, scalar.strict_bit(F.lit(b))) for b in ("0", "1", "true", "false")] == [0, 1, 1, 0]
    with pytest.raises(Exception, match="bit"):
        one(spark, scalar.strict_bit(F.lit("2")))


def test_bit_kind(spark):
    assert one(spark, scalar.bit_kind(F.lit("12"))) == "wire"
    assert one(spark, scalar.bit_kind(F.lit('"x"'))) == "constant"
    for bad in ("true", '"q"', "-1"):
        with pytest.raises(Exception, match="bit"):
            one(spark, scalar.bit_kind(F.lit(bad)))


def test_hamming(spark):
    a, b = "0" * 64, "f" * 64
    assert one(spark, scalar.hamming(F.lit(a), F.lit(b))) == 256
    x, y = hashlib.sha256(b"1").hexdigest(), hashlib.sha256(b"2").hexdigest()
    assert one(spark, scalar.hamming(F.lit(x), F.lit(y))) == (int(x, 16) ^ int(y, 16)).bit_count()


def test_bits_round_trip(spark):
    h = hashlib.sha256(b"k").hexdigest()
    bits = scalar.bits_of(F.lit(h), 64)
    assert one(spark, F.array_join(F.transform(bits, lambda b: b.cast("string")), "")) == bin(int(h, 16))[2:].zfill(256)
    assert one(spark, scalar.packed(bits)) == h


def test_hmac_known_answer(spark):
    assert one(spark, scalar.hmac_sha256(F.lit("0" * 64), F.lit("0" * 64))) == "33ad0a1c607ec03b09e6cd9893680ce210adf300aa1f2660e1b22e10f170f92a"
    for k in range(3):
        key, message = hashlib.sha256(b"k%d" % k).digest(), hashlib.sha256(b"m%d" % k).digest()
        assert one(spark, scalar.hmac_sha256(F.lit(key.hex()), F.lit(message.hex()))) == hmac.new(key, message, "sha256").hexdigest()


def test_timeout_hides_digest(spark):
    a = one(spark, scalar.observation_bytes(F.lit(1), F.lit(2000), F.lit("a" * 64)))
    b = one(spark, scalar.observation_bytes(F.lit(1), F.lit(2000), F.lit("b" * 64)))
    assert a == b and len(a) == 70


def test_one_hot(spark):
    v = scalar.one_hot(F.lit("b"), ["a", "b"])
    assert one(spark, v) == [0.0, 1.0]
    assert one(spark, scalar.sums_to_one(v)) is True
    assert one(spark, scalar.sums_to_one(scalar.one_hot(F.lit(None).cast("string"), ["a"]))) is False


def test_guards():
    assert rows.without_results(["site", "vector"]) == ["site", "vector"]
    with pytest.raises(ValueError, match="cycles"):
        rows.without_results(["site", "cycles"])


def test_ratios(spark):
    assert one(spark, scalar.safe_ratio(F.lit(1), F.lit(0))) == 0.0
    assert one(spark, scalar.null_ratio(F.lit(1), F.lit(0))) is None
    assert one(spark, scalar.close(F.lit(1.0), F.lit(1.0 + 1e-14))) is True


@pytest.mark.parametrize("name", "target target_detected detected activity cycles baseline_cycles latency_delta timed_out unknown expected_digest actual_digest digest_hamming_distance activated_vectors detected_vectors timeout_vectors final_classification run_type".split())
def test_no_result_is_a_feature(name):
    with pytest.raises(ValueError, match=name):
        rows.without_results(["site", name, "vector"])


SECRETS = {
    "private_key": "-----BEGIN " + "RSA PRIVATE KEY-----",
    "github_token": "github" + "_pat_" + "a1" * 12,
    "openai_key": "s" + "k-" + "a1_-" * 6,
    "hugging_face_token": "h" + "f_" + "Zz9" * 8,
    "aws_access_key": "AK" + "IA" + "0AZ9" * 4,
}


def test_release_scan(spark):
    from faultlens.operators import integrity

    files = [(f"docs/{k}.md", 10, f"x {v} y") for k, v in SECRETS.items()] + [(".git/config", 5, ""), ("big.bin", (50 << 20) + 1, None), ("more.bin", 50 << 20, None), ("a/home.md", 3, "/ho" + "me/someone/x")]
    got = {r.rule: r.broken for r in integrity.release_errors(spark.createDataFrame(files, "path string, size long, text string")).collect()}
    assert got == {"blocked_path": 1, "file_too_large": 1, "home_path": 1, "release_too_large": 1, "empty": 0} | dict.fromkeys(SECRETS, 1)
    clean = integrity.release_errors(spark.createDataFrame([("a.md", 3, "x")], "path string, size long, text string"))
    assert not clean.filter("broken > 0").count()
    assert [r.rule for r in integrity.release_errors(spark.createDataFrame([], "path string, size long, text string")).filter("broken > 0").collect()] == ["empty"]


def test_strong_components_in_one_task_and_in_rounds(spark):
    import random

    from faultlens.operators import graph

    rng = random.Random(3)
    arcs = [(rng.randrange(60), rng.randrange(60)) for _ in range(80)] + [(100 + k, 100 + (k + 1) % 5) for k in range(5)] + [(7, 7)]
    nodes = sorted({x for a in arcs for x in a} | {999})
    to = {n: {b for a, b in arcs if a == n} for n in nodes}

    def reach(n):
        seen, todo = {n}, [n]
        while todo:
            for m in to[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        return seen

    ahead = {n: reach(n) for n in nodes}
    want = {n: max(m for m in ahead[n] if n in ahead[m]) for n in nodes}
    e, v = spark.createDataFrame(arcs, "src long, dst long"), spark.createDataFrame([(n,) for n in nodes], "node long")
    for local in (0, 30, graph.LOCAL_ARCS):
        got = graph.strong_components(e, v, local).collect()
        assert len(got) == len(nodes) and {r.node: r.component for r in got} == want


def test_constant_column_is_not_scaled(spark):
    from faultlens.operators import models

    df = spark.createDataFrame([(1.0, 1), (1.0, 1), (2.0, 0)], "x double, fit int")
    with pytest.raises(Exception, match="constant"):
        models.z_scored(df, "x", F.col("fit") == 1, "z").collect()

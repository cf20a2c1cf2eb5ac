"""Evidence: hashes, field agreement, text scans, resumable batches."""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The secrets a release is searched for, as the public formats of such keys.
SECRETS = {
    "private_key": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    "github_token": r"(?:ghp_|github_pat_)[A-Za-z0-9_]{20,}",
    "openai_key": r"sk-[A-Za-z0-9_-]{20,}",
    "hugging_face_token": r"hf_[A-Za-z0-9]{20,}",
    "aws_access_key": r"AKIA[0-9A-Z]{16}",
}
# Bytes of a release's largest file, and of all its files.
MOST_FILE, MOST_RELEASE = 50 * 1024 * 1024, 100 * 1024 * 1024
# Parts of a path that a release may not have.
PRIVATE_PARTS = frozenset({".env", "entropy.json", "truth.json", "capture_plan.json", ".git", ".venv", "__pycache__", "private"})
#: What a release must not hold: the secrets, and further patterns of this library.
PATTERNS = SECRETS | {
    "home_path": r"/(?:home|Users)/[A-Za-z0-9._-]+",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}",
    "token_assignment": r"(?i)(?:api[_-]?key|secret|token|password)\s*[:=]\s*\S{8,}",
}


def file_sha256(path: str) -> str:
    digest = hashlib.sha256()
    with Path(path).open("rb") as f:
        while chunk := f.read(1 << 20):
            digest.update(chunk)
    return digest.hexdigest()


def verify_file(path: str, expected: str) -> None:
    if (found := file_sha256(path)) != expected:
        raise ValueError(f"{path} has digest {found}, not {expected}")


def fields_agree(found: dict, expected: dict) -> None:
    """Every expected field is there and equal, of the same type."""
    for k, v in expected.items():
        if k not in found or type(found[k]) is not type(v) or found[k] != v:
            raise ValueError(f"{k} is {found.get(k)!r}, not {v!r}")


def scalar_values(value: object, at: str = "") -> list[tuple[str, object]]:
    """(path, scalar) of everything in a nested document."""
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in scalar_values(v, f"{at}.{k}" if at else str(k))]
    if isinstance(value, list):
        return [x for i, v in enumerate(value) for x in scalar_values(v, f"{at}[{i}]")]
    return [(at, value)]


def redacted(value: object, pattern: str = PATTERNS["home_path"]) -> object:
    import re

    if isinstance(value, dict):
        return {k: redacted(v, pattern) for k, v in value.items()}
    if isinstance(value, list):
        return [redacted(v, pattern) for v in value]
    return re.sub(pattern, "<redacted>", value) if isinstance(value, str) else value


def ledger_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) between two manifests: ADDED, REMOVED or CHANGED."""
    met = before.select("path", F.col("sha256").alias("a")).join(after.select("path", F.col("sha256").alias("b")), "path", "full_outer")
    change = F.when(F.col("a").isNull(), "ADDED").when(F.col("b").isNull(), "REMOVED").when(F.col("a") != F.col("b"), "CHANGED")
    return met.select("path", change.alias("change")).filter("change is not null")


def scan_text(df: DataFrame, text: str, patterns: dict[str, str] | None = None) -> DataFrame:
    """(pattern, n_rows): rows that hold each pattern, in one pass."""
    patterns = patterns or PATTERNS
    counts = df.agg(*[F.count_if(F.coalesce(F.col(text).rlike(p), F.lit(False))).alias(k) for k, p in patterns.items()])
    return counts.selectExpr(f"stack({len(patterns)}, " + ", ".join(f"'{k}', {k}" for k in patterns) + ") as (pattern, n_rows)")


def release_errors(files: DataFrame) -> DataFrame:
    """(rule, broken) of a release's files (path, size, text): blocked parts of paths, sizes, home paths and secrets; all zero if it may go out."""
    parts = F.split("path", "/")
    rules = {"blocked_path": F.arrays_overlap(parts, F.array(*[F.lit(p) for p in sorted(PRIVATE_PARTS)])), "file_too_large": F.col("size") > MOST_FILE}
    rules |= {name: F.coalesce(F.col("text").rlike(p), F.lit(False)) for name, p in (SECRETS | {"home_path": PATTERNS["home_path"]}).items()}
    counts = files.agg(*[F.count_if(c).alias(k) for k, c in rules.items()], F.when(F.coalesce(F.sum("size"), F.lit(0)) > MOST_RELEASE, 1).otherwise(0).alias("release_too_large"), F.when(F.count(F.lit(1)) == 0, 1).otherwise(0).alias("empty"))
    names = [*rules, "release_too_large", "empty"]
    return counts.selectExpr(f"stack({len(names)}, " + ", ".join(f"'{k}', cast({k} as long)" for k in names) + ") as (rule, broken)")


def pending_batches(plan: DataFrame, done: DataFrame) -> DataFrame:
    """Batches of the plan that no finished batch covers with the same number of rows."""
    return plan.join(done.select("batch_id", F.col("n_rows").alias("_n")), "batch_id", "left").filter("_n is null or _n <> n_rows").drop("_n")

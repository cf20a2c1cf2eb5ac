import random

import pytest
from brute import prose


@pytest.fixture
def corpus(spark):
    """Documents with nulls, empty and long texts, repeats, ties, copies, near copies and clashing extra columns."""
    rng = random.Random(5)
    rows = []
    base = [prose(rng, 120) for _ in range(6)]
    for i in range(40):
        w = base[i % 6].split()
        for _ in range(i // 6):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
        rows.append((i, " ".join(w), "en", f"s{i % 4}"))
    for i in range(40, 60):
        rows.append((i, "\n".join(prose(rng, rng.randrange(3, 40)) for _ in range(5)), "de", "s1"))
    rows += [(60, None, None, None), (61, "", "fr", "s0"), (62, " \n\t ", "fr", None), (63, "two words", "fr", "s9"), (64, "Two  words", "fr", "s9"), (65, prose(rng, 20000), "es", "s2"), (66, base[0], "en", "s1"), (67, base[0], "en", "s1"), (68, base[1].upper(), "en", None)]
    return spark.createDataFrame([(*r, len(r[1] or ""), i, "x", "y") for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, h1 int, component string, k1 string")

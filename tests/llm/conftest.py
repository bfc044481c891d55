"""Documents that try every operator: nulls, empty and long texts, repeated rows, extra columns with clashing names."""

import random

import pytest

CLASHES = ["size", "draw", "taken", "copy", "key", "node", "n", "shard", "slot", "bytes", "kept", "removed", "row", "ids",
           "k_id", "k_sum", "k_text", "gone", "score", "label", "first", "span", "target", "b", "s"]


def edge_rows():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    prose = [" ".join(rng.choice(words) for _ in range(rng.randint(20, 120))) for _ in range(12)]
    lines = "\n".join(prose[:5])
    near = prose[0].split()
    near[3] = "changed"
    rows = [(i, p, f"s{i % 3}") for i, p in enumerate(prose)]
    rows += [(20, prose[0], "s1"), (21, " ".join(near), None), (22, lines, "s2"), (23, "intro\n" + lines + "\nend", "s2")]
    rows += [(30, None, "s0"), (31, "", None), (32, " \n\t ", "s0"), (None, prose[1], "s1"), (None, None, None), (None, "", "s0")]
    rows += [(40, "x" * 5000, "s1"), (41, "word " * 3000, "s1"), (42, "日本語 é 𝄞\x00 ▁ tab\tcr\r\nend", "s2")]
    rows += [(1, prose[1], "s1"), (1, prose[1], "s1"), (22, lines, "s2"), (5, prose[6], "s0")]       # repeated rows, an id with two texts
    return rows


@pytest.fixture(scope="session")
def edge(spark):
    extra = ", ".join(f"`{c}` string" for c in CLASHES)
    rows = [(*r, *[None] * len(CLASHES)) for r in edge_rows()]
    return spark.createDataFrame(rows, f"doc_id long, text string, source string, {extra}").cache()


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(0, 1, 0), (1, 0, 1), (1, None, 0), (None, 1, 1), (3, None, None), (20, 1, 1), (22, 1, 0), (40, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.limit(0).cache()

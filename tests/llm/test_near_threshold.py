"""Pairs at the threshold are found although most links are much closer."""

import random

from lexatlas.llm import near_join


def _jaccard(a: str, b: str) -> float:
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def test_pairs_at_the_threshold_beside_many_close_ones(spark):
    rng = random.Random(5)
    rows, hard = [], []
    for i in range(800):  # links at about 0.97: one word of 200 at the end differs
        words = [f"c{i}w{rng.randrange(10**6)}" for _ in range(200)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:-1], "z"]))]
    for i in range(800, 1400):  # links just above 0.8: 104 shingles in common of 116 and 118
        words = [f"h{i}w{rng.randrange(10**6)}" for _ in range(120)]
        a, b = " ".join(words), " ".join([*words[:108], *(f"n{i}x{j}" for j in range(14))])
        assert 0.8 <= _jaccard(a, b) < 0.81
        rows += [(2 * i, a), (2 * i + 1, b)]
        hard.append(2 * i)
    got = {r["doc_id"]: r["n_links"] for r in near_join.jaccard_links(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[d] for d in hard) >= len(hard) - 2
    assert all(got[2 * i] == 1 for i in range(800))

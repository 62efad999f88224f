"""The audit against one that applies the filters document by document, in every order."""

import re
from collections import Counter
from itertools import permutations

import numpy as np

from lexatlas.llm.filter_audit import RankTable, audit_filters, prefix_intervals

DOCS = "doc_id long, text string, source string"
LABELS = "doc_id long, quality int, toxic int"


def brute(docs, labels):
    texts = [(i, t or "", s or "") for i, t, s in docs]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, t, s in texts:
        words = re.findall(r"[^\x20\x09-\x0d]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t))}
        fails["E"] = i is not None and any(j is not None and j < i and u == t for j, u, _ in texts)
        rows.append((s, {f for f, x in fails.items() if x}, i in good, i in toxic))
    out, by_filter = {}, Counter()
    for part in {r[0] for r in rows}:
        for order in map("".join, permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            every = left
            for k, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                by_filter[part, f] += len(gone)
                before = set(order[: k - 1])
                out[part, order, k] = (len(left), len(gone), sum(f in r[1] and bool(before & r[1]) for r in every), sum(r[1] == {f} for r in every), sum(r[2] for r in gone), sum(r[3] for r in gone))
    return {k: (*v, by_filter[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def found(spark, docs, labels):
    rows = audit_filters(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    return {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in rows}


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(40):
        n = int(rng.integers(1, 300))
        words = [f"w{x}" for x in rng.integers(0, int(rng.integers(2, 400)), n)]
        texts.append(" ".join(words) + rng.choice(["", " #", " AAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA", " |"]))
    docs = [(int(i), texts[int(rng.integers(0, 40))], str(rng.choice(["a", "b", "c"]))) for i in range(90)]
    labels = [(int(i), int(rng.integers(0, 2)), int(rng.integers(0, 2))) for i in range(0, 90, 2)]
    assert found(spark, docs, labels) == brute(docs, labels)


def test_odd_rows(spark):
    long = "word " * 400_000
    docs = [(1, None, None), (2, "", ""), (2, "", ""), (3, long, "a"), (3, long, "a"), (None, long, "a"), (4, long, "b"), (5, "é" * 50 + "A", "b"), (6, "\x1fx\x85y", None), (6, "other", None)]
    labels = [(1, 1, 0), (1, 0, 1), (None, 1, 1), (4, None, None), (4, 1, None), (99, 1, 1)]
    assert found(spark, docs, labels) == brute(docs, labels)


def test_empty_and_clashing(spark):
    assert audit_filters(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0
    wide = "doc_id long, text string, source string, words string, digest string, part string, mask int, good int, marked long, found int"
    rows = [(1, "one two", "s", "x", "y", "z", 3, 4, 5, 6)]
    out = audit_filters(spark.createDataFrame(rows, wide), spark.createDataFrame([(1, 1, 1)], LABELS).withColumnRenamed("nothing", "x")).collect()
    assert len(out) == 600 and {r["part"] for r in out} == {"s"} and {r["documents"] for r in out} == {1}


def test_intervals_are_lexicographic():
    orders = list(permutations(range(4)))
    for prefix, start, end in prefix_intervals(4):
        assert [o[: len(prefix)] == prefix for o in orders] == [start <= i < end for i in range(24)]


def test_every_mask_is_removed_once_in_every_order():
    table = RankTable(5)
    masks = np.eye(32, dtype=np.int64)
    assert (table.steps(masks, table.removed).sum(2) == (np.arange(32) > 0)[:, None]).all()

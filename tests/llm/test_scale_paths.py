"""Recall and exactness of the search structures at their production parameters."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from lexatlas.llm import chat, embedding_links, mixing, near_join, quality

from .test_operators import docs, near_pairs, words


def test_near_join_finds_pairs_at_the_threshold(spark):
    rng, rows = random.Random(21), []
    for _ in range(150):  # 44 shingles; one changed word at the edge of 5 windows leaves 39 of 49: just below; at the end: 43 of 45
        base = words(rng, 104).split()
        near = base[:]
        for at in rng.sample(range(3, 100), 2):
            near[at] = "changed"
        rows += [(len(rows), " ".join(base), "s"), (len(rows) + 1, " ".join(near), "s")]
    pairs = near_pairs(rows)
    assert len(pairs) > 100
    got = {r["doc_id"]: r for r in near_join.jaccard_links(docs(spark, rows)).collect()}
    found = sum(r["n_links"] for r in got.values()) / 2
    assert 0.995 * len(pairs) <= found <= len(pairs)


def test_sorted_tries_match_longest_prefixes(spark):
    rng = np.random.default_rng(22)
    trees, least = 3, 2
    lanes = rng.integers(0, 2, (300, trees, near_join.DEPTH)) * rng.integers(0, 3, (300, trees, 1))  # many shared prefixes, in all partitions
    longs = (lanes.reshape(300, trees * 2, 4).astype(np.uint64) << np.array([48, 32, 16, 0], np.uint64)).sum(2).view(np.int64)
    classes = spark.createDataFrame([(i, list(map(int, v))) for i, v in enumerate(longs)], "node long, labels array<long>")
    got = {(r["tree"], r["node"]): r for r in near_join.sorted_tries(classes, trees, least).collect()}
    equal = (lanes[:, None] == lanes[None]).cumprod(3).sum(3)
    for i in range(300):
        for t in range(trees):
            best = max(equal[i, j, t] for j in range(300) if j != i)
            assert (got[t, i]["match"] if (t, i) in got else 0) == (best if best >= least else 0)
            if (t, i) in got and got[t, i]["before"] >= 0:
                assert equal[i, got[t, i]["before"], t] >= least


def test_embeddings_at_the_threshold(spark):
    rng = np.random.default_rng(23)
    x = rng.standard_normal((5000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u = rng.standard_normal(x.shape)
    u -= (u * x).sum(1, keepdims=True) * x
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    c = rng.uniform(0.901, 0.93, (5000, 1))
    rows = np.float32(np.concatenate([x, c * x + np.sqrt(1 - c * c) * u]))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<float>").repartition(4)
    got = {r["vec_id"]: r for r in embedding_links.link_embeddings(df).collect()}
    y = rows.astype(float) / np.linalg.norm(rows.astype(float), axis=1, keepdims=True)
    true = np.array([int((y @ v >= 0.9).sum()) - 1 for v in y])
    found = np.array([got[i]["n_links"] for i in range(len(y))])
    assert (found <= true).all() and found.sum() >= 0.999 * true.sum()
    assert np.mean([got[i + 5000]["component_id"] == i for i in range(5000)]) > 0.999


def test_embeddings_repeated_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 2.0])]
    got = embedding_links.link_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == [(1, 1, 1, True)] * 3 + [(2, 1, 1, False)]


def test_mix_is_the_cut_of_the_word_order(spark):
    rng = random.Random(24)
    rows = [(i, words(rng, rng.choice([0, 3, 30, 900])), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(120)]
    got = sorted(mixing.mix_sources(docs(spark, rows)).collect(), key=lambda r: r["doc_id"])
    ends = {r["doc_id"]: round(r["finish"] * r["target"]) for r in got if r["target"]}
    ranks = {s: i for i, s in enumerate(["a", "b", "c", None])}
    order = sorted(((end + p * r["source_size"] - k) / r["target"], ranks[r["source"]], r["doc_id"]) for r in got if r["target"] for end in [ends[r["doc_id"]]] for p in (0, 1) for k in range(r["size"]))
    taken = {}
    for _, _, doc in order[: int(1.5 * sum(r["size"] for r in got))]:
        taken[doc] = taken.get(doc, 0) + 1
    assert {r["doc_id"]: r["taken"] for r in got} == {r["doc_id"]: taken.get(r["doc_id"], 0) for r in got}


def test_another_order_takes_other_words(spark):
    rows = [(i, 0, 0, 10, 10 * (i + 1), 100.0) for i in range(20)]
    names = "row long, rank long, tie int, size long, end long, target double"
    sources = spark.createDataFrame([(100.0, 200)], "target double, most long")
    cut = lambda r: {x["row"]: x["n"] for x in mixing.cut_queue(spark.createDataFrame(r, names), sources, 105)[0].groupBy("row").agg(F.sum("words").alias("n")).collect()}
    assert cut(rows) == dict.fromkeys(range(10), 10) | {10: 5}
    assert cut([(i, a, b, c, 210 - e, t) for i, a, b, c, e, t in rows]) == dict.fromkeys(range(10, 20), 10) | {9: 5}


def test_quality_draws_by_weight(spark, monkeypatch):
    """Inclusion rates of many seeds equal those of drawing one by one without replacement in proportion to the weights."""
    weights = [0.0, 0.0, 0.7, -1.0, -0.5, 1.5, -2.0]
    table = docs(spark, [(i, f"t{i}", "s") for i in range(len(weights))])
    score = F.udf(lambda t: weights[int(t[1:])], "double")
    monkeypatch.setattr(quality, "quality_scorer", lambda *a, **k: score)
    k = round(sum(1 / (1 + np.exp(-w)) for w in weights))
    rng, brute, seen, rounds = np.random.default_rng(25), np.zeros(len(weights)), np.zeros(len(weights)), 60
    p = np.exp(weights) / np.exp(weights).sum()
    for _ in range(4000):
        brute[rng.choice(len(weights), k, replace=False, p=p)] += 1 / 4000
    for seed in range(rounds):
        kept = [r["doc_id"] for r in quality.select_quality(table, None, seed).collect() if r["kept"]]
        assert len(kept) == k
        seen[kept] += 1 / rounds
    assert np.abs(seen - brute).max() < 4 * 0.5 / rounds**0.5 and 0 < seen.min() and seen[6] < seen[5]


def test_repeated_rows_are_drawn_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(quality, "quality_scorer", lambda *a, **k: F.udf(lambda t: 0.0, "double"))
    got = quality.select_quality(docs(spark, [(1, "same", "s")] * 40 + [(None, None, None)] * 40), None).collect()
    assert sum(r["kept"] for r in got) == 40 and len({r["gumbel_key"] for r in got}) == 80
    kept = quality.keep_quality(docs(spark, [(1, "same", "s")] * 40), None)
    assert kept.count() == 20 and kept.columns == docs(spark, []).columns


def test_plans_of_long_and_short_conversations():
    fix = chat.Repair()
    for roles in itertools.product(range(4), repeat=3):
        whole = fix.extend(fix.extend(None, list(roles) * 7), list(roles) * 13)
        assert whole == fix.matrix(list(roles) * 20)


def test_large_conversation_ids(spark):
    big = 2**62 + 1
    rows = [(big, 1, "user", "a"), (big + 1, 1, "user", "b"), (None, None, "user", "c"), (big, 2**60 + 1, "assistant", "d")]
    got = chat.repair_roles(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r["conv_id"] or 0, r["turn"] or 0) for r in got) == sorted((c or 0, t or 0) for c, t, _, _ in rows)


def test_a_long_word_is_counted_in_small_memory():
    import tracemalloc

    from lexatlas.llm import tokens

    counter = tokens.UnigramCounter([("<unk>", -9.0), ("a", -1.0), ("aa", -1.5), ("b", -2.0)])
    word = "aab" * 200_000
    tracemalloc.start()
    assert counter.search(word) == (400_000, -3.5 * 200_000)
    assert tracemalloc.get_traced_memory()[1] < 6 * len(word)  # the automaton's copy of the word takes four bytes a character
    tracemalloc.stop()
    assert counter.search("") == (0, 0.0) and counter.search("zz") == (1, 2 * counter.unknown)

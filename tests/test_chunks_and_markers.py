"""The native chunk fold against plain Python; marker tables of any size against contains."""

import random

from lexatlas.operators import risk, sampling
from tests import chunk_reference


def test_chunks_equal_the_plain_fold(spark):
    rng = random.Random(9)
    parts = ["word ", "a. ", "\n\n", "x" * 150, "! ", "Sentence one here. ", "\n", "é ", "。", "long " * 60, "\n\n\n", "б" * 90 + " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(300)] + [None, "", " \n\n ", "y" * 30_000, "s. " * 9000, "p\n\n" * 4000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sizes = {r["doc_id"]: r["chunk_size"] for r in sampling.chunk_sizes(rows).collect()}
    for limit in (48, None):
        got: dict = {}
        for r in sampling.chunk_documents(rows, limit).collect():
            got.setdefault(r["doc_id"], {})[r["chunk_no"]] = (r["chunk"], r["n_chunks"])
        for i, text in enumerate(texts):
            want = [c if c not in "\n" else c for c in chunk_reference.split_chunks(text, sizes[i])]
            mine = [got.get(i, {})[k][0] for k in sorted(got.get(i, {}))]
            assert [c.strip() for c in mine] == [c.strip() for c in want[:limit]]
            assert all(n == len(want) for _, n in got.get(i, {}).values())


def test_marker_tables_equal_contains(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcü ") for _ in range(rng.randrange(1, 5)))
    markers = [word() for _ in range(400)] + ["", None, "ABC", "never there"]
    docs = [(i, "".join(word() for _ in range(rng.randrange(12))).upper()) for i in range(120)] + [(500, None), (501, "")]
    df, table = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(m,) for m in markers], "marker string")
    want = {(i, m) for i, t in docs if t is not None for m in set(markers) if m is not None and m in t.lower()}
    for block in (100_000, 97):
        got = [tuple(r) for r in risk.match_rule_table(df, table, block).collect()]
        assert set(got) == want and len(got) == len(want)
    assert risk.match_rule_table(df, table.where("false")).count() == 0


def test_hundred_thousand_markers(spark):
    table = spark.range(100_001).selectExpr("concat('m', id, '.') AS marker")
    docs = spark.createDataFrame([(1, "see M77. and m100000. m5 m"), (2, "none")], "doc_id long, text string")
    assert sorted(map(tuple, risk.match_rule_table(docs, table).collect())) == [(1, "m100000."), (1, "m77.")]

"""Leaks in tables of few documents, and in heavy paraphrases."""

import random

from lexatlas.llm import decontaminate

WORDS = [a + b + c for a in "ba ce di fo gu ka".split() for b in "ra se ti vo nu".split() for c in ["lor", "min", "tas", "quel", "zed"]]


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_tables_that_all_hold_the_passage(spark):
    rng = random.Random(1)
    item = " ".join(rng.choice(WORDS) for _ in range(40)) + ". " + " ".join(rng.choice(WORDS) for _ in range(8)) + "."
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    for n in (1, 2, 5):
        for text in (item, "before " * 9 + item + " behind" * 9):
            got = decontaminate.find_leaks(docs(spark, [(i, text) for i in range(n)]), bench).collect()
            assert [(r["item_id"], r["lcs"]) for r in got] == [(7, 1.0)] * n


def test_paraphrases_of_two_words_in_five(spark):
    rng = random.Random(2)
    items = [[rng.choice(WORDS) for _ in range(rng.randrange(25, 60))] for _ in range(80)]
    rows = []
    for i, words in enumerate(items):
        text = words[:]
        for at in rng.sample(range(len(words) - 8), min(len(words) - 8, int(0.4 * len(words)))):  # the last eight words are the answer
            text[at] = "other%d" % rng.randrange(999)
        pad = [rng.choice(WORDS) for _ in range(60)]
        rows.append((i, " ".join(pad[:30] + text + pad[30:])))
    bench = spark.createDataFrame([(i, " ".join(w[:-8]) + ". " + " ".join(w[-8:])) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs(spark, rows), bench).collect()}
    assert len({(i, i) for i in range(80)} & got) >= 72

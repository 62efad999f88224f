"""The training-data operators against brute force, round trips and odd inputs."""

import gzip
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexatlas.llm import chat, common, decontaminate, embedding_links, html_text, mixing, near_join, quality, tokens, toxicity, warc

DOCS = "doc_id long, text string, source string, lang string, row int, node int"
WORDS = [a + b for a in "ba ce di fo gu ka le mi no pu".split() for b in "ra se ti vo nu zed lor min tas quel".split()]


def words(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def docs(spark, rows):
    """Rows of (doc_id, text, source), with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, s, "en", 1, 2) for i, t, s in rows], DOCS)


ODD = [(None, None, None), (1, "", "a"), (1, "", "a"), (2, "  \n\t ", "b"), (3, "one two", "a"), (3, "one two", "a"), (4, "x" * 20000, None), (5, "word " * 30000, "b")]


def near_pairs(rows, n=5, least=0.8):
    sets = []
    for _, t, _ in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    return {(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])}


def components(n, pairs):
    root = list(range(n))
    for _ in range(n):
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
    return root


def test_near_join_equals_brute_force(spark, monkeypatch):
    rng, rows = random.Random(1), []
    for k in range(25):
        base = words(rng, rng.choice([4, 8, 40, 120])).split()
        for c in range(rng.choice([1, 2, 3, 12])):
            text = base[:]
            for _ in range(c % 4):
                text[rng.randrange(len(text))] = rng.choice(WORDS)
            rows.append((1000 - len(rows), " ".join(text), "s"))
    monkeypatch.setattr(near_join, "UNIT_DOCS", 5)  # several blocks to a node
    pairs = near_pairs(rows)
    got = {r["doc_id"]: r for r in near_join.jaccard_links(docs(spark, rows), trees=40).collect()}
    links = np.zeros(len(rows), int)
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
    root = components(len(rows), pairs)
    for i, (doc, _, _) in enumerate(rows):
        members = [rows[j][0] for j in range(len(rows)) if root[j] == root[i]]
        assert (got[doc]["n_links"], got[doc]["class_id"], got[doc]["kept"]) == (links[i], min(members), doc == min(members))


def test_near_join_odd_rows(spark):
    got = near_join.jaccard_links(docs(spark, ODD)).collect()
    assert len(got) == len(ODD)
    assert sorted((r["doc_id"], r["n_links"], r["kept"]) for r in got if r["doc_id"] == 3) == [(3, 1, False), (3, 1, True)]
    assert all(r["kept"] and r["n_links"] == 0 for r in got if r["doc_id"] in (1, 2, None))
    assert near_join.jaccard_links(docs(spark, [])).count() == 0


def test_forest_depth():
    assert near_join.forest_depth(0.8, 20, 0.995) == 6
    assert near_join.forest_depth(0.8, 20, 0.9995) == 5
    assert near_join.forest_depth(0.8, 1, 0.9999) == 1
    close, far = {0.97: 10_000}, {0.97: 100, 0.81: 100}
    assert near_join.forest_depth(0.8, 20, 0.9995, close) == 8  # close links need no short prefixes
    assert near_join.forest_depth(0.8, 20, 0.9995, far) < 7 and near_join.forest_depth(0.8, 20, 0.9995, {}) == 5


def test_connected_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 6000 + i) for i in range(200)]
    nodes = sorted({x for e in edges for x in e})
    at = {x: i for i, x in enumerate(nodes)}
    root = components(len(nodes), [(at[a], at[b]) for a, b in edges])
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {x: got.get(x, x) for x in nodes} == {x: nodes[root[at[x]]] for x in nodes}
    assert common.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_prefix_sum(spark):
    rows = [(i, i % 7) for i in range(1000)]
    got = common.prefix_sum(spark.createDataFrame(rows, "k long, v long"), [F.col("k").desc()], "v", "s").collect()
    want, run = {}, 0
    for k, v in reversed(rows):
        run += v
        want[k] = run
    assert {r["k"]: r["s"] for r in got} == want


def test_embeddings_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((150, 24))
    rows = [base[i % 150] + 0.11 * (i // 150) * rng.standard_normal(24) for i in range(600)] + [base[0]] * 30
    rows = [list(map(float, np.float32(v))) for v in rows]
    monkeypatch.setattr(embedding_links, "UNIT_ROWS", 40)
    extra = [(9000, None), (9001, [0.0] * 24), (9002, [None] + [1.0] * 23), (9003, [float("nan")] * 24), (9004, [float("inf")] * 24), (None, [1.0, 2.0]), (9005, [2.0, 4.0])]
    df = spark.createDataFrame([*((i, v) for i, v in enumerate(rows)), *extra], "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).withColumn("row", F.lit(5))
    got = {r["vec_id"]: r for r in embedding_links.link_embeddings(df).collect()}
    x = np.array(rows)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = x @ x.T >= 0.9
    np.fill_diagonal(true, False)
    found = sum(got[i]["n_links"] for i in range(len(rows)))
    assert 0.98 * true.sum() <= found <= true.sum()
    assert all(got[i]["n_links"] <= true[i].sum() for i in range(len(rows)))
    for i in range(9000, 9005):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert got[9005]["n_links"] == 1 and got[None]["component_id"] == 9005 and got[None]["kept"] is False
    root = components(len(rows), list(zip(*np.nonzero(np.triu(true)), strict=True)))
    assert np.mean([got[i]["component_id"] == root[i] for i in range(len(rows))]) > 0.97
    assert embedding_links.link_embeddings(df.limit(0)).count() == 0


def page_rows():
    big = "<p>" + "hällo " * 40 + "</p>"
    return [(1, "http://a/x y", big), (2, None, big), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", big + "WARC/1.1\r\n\r\n\x1f"), (None, "u", big), (7, "u", big + "WARC/1.1\r\n\r\n\x1f")]


@pytest.mark.parametrize("compress", [True, False])
def test_warc_round_trip(spark, compress):
    pages = spark.createDataFrame(page_rows(), "page_id long, url string, html string").withColumn("size", F.lit(1)).withColumn("first_id", F.lit(2))
    path = common.new_shared_path(spark)
    got = warc.archive_pages(pages, path, compress).collect()
    assert sorted((str(r["page_id"]), r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got) == sorted(
        (str(i), "revisit" if i in (2, None) else "response", 1 if i in (2, None) else None, len((h or "").encode())) for i, _, h in page_rows()
    )
    full = warc.read_archives(spark, path).where("warc_type = 'response'").collect()
    assert sorted(bytes(r["payload"]).decode() for r in full) == sorted(h or "" for i, _, h in page_rows() if i not in (2, None))
    assert warc.archive_pages(pages.limit(0), common.new_shared_path(spark)).count() == 0


def record(i, payload):
    import hashlib

    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}\r\nContent-Length: {len(payload)}\r\n\r\n"
    return head.encode() + payload + b"\r\n\r\n"


def test_salvage():
    parts = [record(i, f"payload {i} ".encode() * 20) for i in range(5)]
    for plain in (True, False):
        whole = parts if plain else [gzip.compress(p) for p in parts]
        hurt = bytearray(whole[1])
        hurt[len(hurt) // 2] ^= 0x55
        data = whole[0] + bytes(hurt) + whole[2] + b"garbage" + whole[3] + whole[4][:-9]
        seen = list(warc.scan(data))
        assert [r["page_id"] for r in seen if r["kind"] == "record"] == [0, 2, 3]
        gaps = [(r["offset"], r["length"]) for r in seen if r["kind"] == "gap"]
        a, b, c, d = len(whole[0]), len(whole[1]), len(whole[2]), len(whole[3])
        assert gaps == [(a, b), (a + b + c, 7), (a + b + c + 7 + d, len(whole[4]) - 9)]
        assert sum(r["length"] for r in seen) == len(data)
    assert list(warc.scan(b"")) == []


def test_token_counts_equal_tokenizer(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    rng = random.Random(4)
    letters = "ab e\n▁☃é漢😀<>0xAF thein "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(400)]
    texts += [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    pieces = tokens.load_pieces()
    for vocabulary in (pieces, [p for p in pieces if not p[0].startswith("<0x")], [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0), ("ba", -2.0)]):
        t = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=any(p[0] == "<0x00>" for p in vocabulary)))
        t.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always")
        counter = tokens.UnigramCounter(vocabulary)
        assert [counter.text(x)[1] for x in texts] == [len(e.tokens) for e in t.encode_batch(texts, add_special_tokens=False)]
    got = tokens.count_tokens(docs(spark, ODD)).collect()
    assert len(got) == len(ODD) and {r["n_tokens"] for r in got if r["doc_id"] in (None, 1)} == {0}
    assert tokens.count_tokens(docs(spark, [])).count() == 0


def cheapest(fix, roles):
    """By trying all state sequences."""
    best = None
    for states in itertools.product(range(4), repeat=len(roles)):
        cost, s = 0, chat.START
        for r, t in zip(roles, states, strict=True):
            cost, s = cost + fix.choices[r][s][t][0], t
        cost += fix.closing[s][0]
        best = cost if best is None else min(best, cost)
    return best


def test_chat_repair_is_cheapest_and_legal(spark):
    rng, fix = random.Random(5), chat.Repair()
    names = ["nobody", "System", "human", "assistant"]
    rows, want = [], {}
    for c in range(40):
        roles = [rng.randrange(4) for _ in range(rng.randrange(1, 6))]
        want[c] = cheapest(fix, roles)
        rows += [(c, t, names[r], f"t{c}.{t}") for t, r in enumerate(roles)]
    long = [rng.randrange(4) for _ in range(900)]
    rows += [(99, t, names[r], f"long {t}") for t, r in enumerate(long)]
    want[99] = sum(x[1] for x in fix.path(long, 0, None))
    want[99] += fix.closing[fix.path(long, 0, None)[-1][0]][0]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit(0)).withColumn("pid", F.lit(9))
    got = chat.repair_roles(df).collect()
    assert len(got) == len(rows)
    for c, cost in want.items():
        own = sorted((r for r in got if r["conv_id"] == c), key=lambda r: r["place"])
        ends = 2 * len([x for x in own[-1]["closing"].split(",") if x])
        assert sum(r["cost"] for r in own) + ends == cost
        text = "".join(r["rendered"] for r in own)
        assert all(f"t{c}.{r['turn']}" in text for r in own) or c == 99
        roles = [line[12:] for line in text.split("\n") if line.startswith("<|im_start|>")]
        assert text.count("<|im_end|>") == len(roles)
        roles = roles[1:] if roles[0] == "system" else roles
        assert roles == ["user", "assistant"] * (len(roles) // 2)


def test_chat_odd_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", "x"), (1, 0, "user", None), (1, 0, "user", None), (2, 5, "assistant", "y" * 50000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert chat.repair_roles(df).count() == len(rows)
    assert chat.repair_roles(df.limit(0)).count() == 0


HTML = [
    ("<p>a<p>b", "a\n\nb"),
    ("<ul><li>x<li>y<ol><li>1<li>2</ol></ul>z", "- x\n- y\n  1. 1\n  2. 2\n\nz"),
    ("<table><tr><th>N<th>Value<tr><td>long name<td>1</table>", "N         | Value\nlong name | 1"),
    ("<style>.h{display:none}</style><div class=h>no</div><div style='display: none'>no</div>yes<span hidden>no</span>", "yes"),
    ("a<script>if (1 < 2) '<p>x</p>'</script>b<!-- <p> -->c", "abc"),
    ("one  two\n three<br>four<pre> k\n  l</pre>", "one two three\nfour\n\n k\n  l"),
    ("<b>x<p>y</b>z</p>", "x\n\nyz"),
    ("&lt;tag&gt; &amp; &eacute;&nbsp;x", "<tag> & é x"),
    ("<details><summary>more</summary>gone</details><select><option>a<option>b</select>", "more\na\nb"),
    ("<a href='x>y'>link</a> <a title=\"un>ended>q", 'link ended>q'),
    ("", ""),
    (None, ""),
]


def test_html(spark):
    for source, text in HTML:
        assert html_text.render(source) == text
    deep = "<div>" * 5000 + "in" + "</div>" * 5000
    rows = [(1, None), (2, ""), (3, "<p>x"), (3, "<p>x"), (4, deep), (5, "<p>" + "long " * 100000), (6, "<" * 3000 + '"')]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit("clash"))
    got = html_text.extract_text(df).collect()
    assert len(got) == len(rows) and {r["text"] for r in got if r["page_id"] in (3, 4)} == {"x", "in"}
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_mixing_targets(spark):
    rng = random.Random(6)
    rows = [(i, words(rng, rng.randrange(1, 60)), rng.choice(["a", "b", "c", "d", None])) for i in range(600)]
    got = mixing.mix_sources(docs(spark, rows)).collect()
    total = sum(r["size"] for r in got)
    assert len(got) == 600 and total == sum(len(t.split()) for _, t, _ in rows)
    for s in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1
        assert own[0]["target"] <= 2 * own[0]["source_size"] == 2 * sum(r["size"] for r in own)
    assert abs(sum({r["source"]: r["target"] for r in got}.values()) - 1.5 * total) < 1
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    again = mixing.mix_sources(docs(spark, rows).repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    odd = mixing.mix_sources(docs(spark, ODD)).collect()
    assert len(odd) == len(ODD) and mixing.mix_sources(docs(spark, [])).count() == 0


def labelled(spark, n=400):
    rng, rows, labels = random.Random(7), [], []
    for i in range(n):
        kind = rng.choice(["good", "good", "good", "junk", "toxic"])
        text = words(rng, 60)
        if kind == "junk":
            text = " ".join(w + "###" for w in text.split())
        if kind == "toxic":
            text += " you " + rng.choice(["idiot", "scum", "moron trash"])
        rows.append((i, text, "s"))
        labels.append((i, 0 if kind == "junk" else 1, int(kind == "toxic")))
    return rows, spark.createDataFrame([x for x in labels if x[0] % 2] + [(None, 1, 1), (3, None, None), (10**9, 1, 1)], "doc_id long, quality int, toxic int"), {x[0]: x for x in labels}


def test_toxicity_and_quality_held_out(spark):
    rows, labels, truth = labelled(spark)
    got = {r["doc_id"]: r["toxic"] for r in toxicity.score_toxicity(docs(spark, rows), labels).collect()}
    held = [i for i in truth if i % 2 == 0]
    assert np.mean([got[i] == bool(truth[i][2]) for i in held]) > 0.97
    kept = {r["doc_id"]: r["kept"] for r in quality.select_quality(docs(spark, rows), labels).collect()}
    assert np.mean([kept[i] for i in held if truth[i][1]]) > 0.97
    assert np.mean([kept[i] for i in held if not truth[i][1]]) < 0.05
    for odd in (ODD, []):
        assert toxicity.score_toxicity(docs(spark, odd), labels).count() == len(odd)
        assert quality.select_quality(docs(spark, odd), labels).count() == len(odd)
    none = labels.limit(0)
    assert not any(r["toxic"] for r in toxicity.score_toxicity(docs(spark, rows[:9]), none).collect())
    assert all(r["kept"] for r in quality.select_quality(docs(spark, rows[:9]), none).collect())


def test_decontamination(spark):
    rng = random.Random(8)
    items = [(i, words(rng, rng.randrange(18, 60)) + ". " + words(rng, 8) + ".") for i in range(60)]
    rows, want = [], set()
    for i in range(200):
        text = words(rng, rng.randrange(30, 300)).split()
        if i % 4 == 0:
            item = items[i % 60][1].split()
            if i % 8 == 0:  # a paraphrase
                for _ in range(len(item) // 8):
                    item[rng.randrange(len(item))] = "other"
            at = rng.randrange(len(text))
            text[at:at] = item
            want.add((i, i % 60))
        rows.append((i, " ".join(text), "s"))
    bench = spark.createDataFrame([*items, (100, None), (101, ""), (0, items[0][1])], "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs(spark, rows), bench, block=50).collect()}
    assert want <= got and len(got - want) <= 2
    assert decontaminate.find_leaks(docs(spark, ODD), bench).count() == 0
    assert decontaminate.find_leaks(docs(spark, rows[:5]), bench.limit(0)).count() == 0
    assert decontaminate.find_leaks(docs(spark, []), bench).count() == 0


def test_longest_common_subsequence():
    rng = random.Random(9)
    for _ in range(200):
        a, b = [rng.randrange(5) for _ in range(rng.randrange(1, 12))], [rng.randrange(5) for _ in range(rng.randrange(12))]
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        masks = decontaminate._masks(a)
        assert decontaminate._lcs([masks[w] for w in b if w in masks], len(a)) == table[-1, -1]

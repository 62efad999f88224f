"""N-gram Jaccard join by a MinHash LSH forest (sorted prefix tries of signatures) with exact verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize, shuffle_partitions, small_or_shuffled, stream_groups
from .text import blank_words, mix, ngrams

#: A verification unit holds at most about so many documents and shingles of each side.
UNIT_DOCS, UNIT_SHINGLES = 384, 1_000_000
#: A label has so many MinHash values of 16 bits, in two longs, first value highest.
DEPTH = 8


def found_share(similarity: float, trees: int, depth: int) -> float:
    """Chance that two documents share a prefix of ``depth`` values in one of the trees."""
    return 1 - (1 - similarity**depth) ** trees


def forest_depth(threshold: float, trees: int, target_recall: float, links: dict[float, int] | None = None) -> int:
    """Length to which matched prefixes are shortened: the longest at which the recall reaches the target.

    links: how many links of which similarity have been seen at the length that suits the threshold alone; each
    stands for as many as were there to be seen (1 / its chance), beside one more pair at the threshold itself. Without
    links that pair decides.
    """
    depth = DEPTH
    least = next((d for d in range(DEPTH, 1, -1) if found_share(threshold, trees, d) >= target_recall), 1)
    weights = {threshold: 1.0}
    for s, n in (links or {}).items():
        weights[s] = weights.get(s, 0.0) + n / found_share(s, trees, least)
    while depth > least and sum(w * found_share(s, trees, depth) for s, w in weights.items()) < target_recall * sum(weights.values()):
        depth -= 1
    return depth


def shingles(words: list[bytes], n: int) -> np.ndarray:
    """64-bit hashes of the runs of n words; a shorter text is one run."""
    if not words:
        return np.zeros(0, np.uint64)
    return ngrams(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), min(n, len(words)))


def _key(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _signer(trees: int, seed: int = 1):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 31, trees * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 1 << 32, trees * DEPTH, dtype=np.uint32)
    place = np.array([48, 32, 16, 0], np.uint64)

    def sign(x: np.ndarray) -> np.ndarray:
        x = (x >> np.uint64(32)).astype(np.uint32)
        low = np.full(trees * DEPTH, np.iinfo(np.uint32).max, np.uint32)
        for i in range(0, len(x), 512):
            np.minimum(low, (x[i : i + 512, None] * a + b).min(0), out=low)
        values = (mix(low) & np.uint64(0xFFFF)).reshape(-1, 4)
        return (values << place).sum(1).view(np.int64)

    return sign


def sign_documents(docs: DataFrame, n: int, trees: int) -> DataFrame:
    """(row, doc_id, text_hash, kh, kl, n_shingles, labels): text identity in two longs, and the label of each tree in two
    longs. Texts without words have null labels."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sign = _signer(trees)
        for pdf in batches:
            keys, sizes, found = [], [], []
            for text in pdf["text"]:
                words = blank_words(text)
                x = shingles(words, n)
                keys.append(np.frombuffer(_key(words), np.int64))
                sizes.append(len(x))
                found.append(sign(x) if len(x) else None)
            yield pd.DataFrame({"row": pdf["row"], "doc_id": pdf["doc_id"], "text_hash": pdf["text_hash"], "kh": [k[0] for k in keys], "kl": [k[1] for k in keys], "n_shingles": sizes, "labels": found})

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return materialize(rows.mapInPandas(run, "row long, doc_id long, text_hash long, kh long, kl long, n_shingles int, labels array<long>"))


def _common(a1, a2, b1, b2) -> np.ndarray:
    """Length of the common prefixes of labels in two longs each."""
    x, y = np.asarray(a1 ^ b1).view(np.uint64), np.asarray(a2 ^ b2).view(np.uint64)
    same = [(x >> np.uint64(48 - 16 * i)) == 0 for i in range(4)] + [(x == 0) & ((y >> np.uint64(48 - 16 * i)) == 0) for i in range(4)]
    return np.sum(same, axis=0)


def sorted_tries(classes: DataFrame, trees: int, least: int) -> DataFrame:
    """(tree, l1, l2, node, before, match) of the labels that share a prefix of at least ``least`` values with a
    neighbour in their tree's sorted order: the longest such prefix, and the node before if that one shares it.

    The labels of all trees are range-sorted together, so a prefix of any number of documents may lie in several
    partitions; only the first and last label of each partition go to the driver, to be compared across the border.
    """
    order = ["tree", "l1", "l2", "node"]
    pair = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(F.element_at("labels", 2 * t + 1).alias("l1"), F.element_at("labels", 2 * t + 2).alias("l2")))
    placed = classes.select("node", F.posexplode(pair).alias("tree", "label")).select("tree", "label.l1", "label.l2", "node")
    ranged = placed.repartitionByRange(shuffle_partitions(classes.sparkSession), *order).sortWithinPartitions(*order)

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid, held, edge = TaskContext.get().partitionId(), None, 1
        for pdf in batches:
            if not len(pdf):
                continue
            if held is not None:
                pdf = pd.concat([held, pdf[order]], ignore_index=True)
            t, l1, l2, node = (pdf[c].to_numpy() for c in order)
            after = np.where(t[1:] == t[:-1], _common(l1[1:], l2[1:], l1[:-1], l2[:-1]), 0)
            up = np.concatenate([[0 if held is None else held_up], after])
            prev = np.concatenate([[-1 if held is None else held_before], node[:-1]])
            rows = pd.DataFrame({"tree": t[:-1], "l1": l1[:-1], "l2": l2[:-1], "node": node[:-1], "before": np.where(up[:-1] >= least, prev[:-1], -1), "match": np.maximum(up[:-1], after), "pid": pid, "edge": 0})
            if len(rows) and edge:
                rows.loc[0, "edge"], edge = 1, 0
            yield rows[(rows["match"] >= least) | (rows["edge"] > 0)]
            held, held_up, held_before = pdf[order].iloc[-1:], up[-1], prev[-1]
        if held is not None:
            yield held.assign(before=held_before if held_up >= least else -1, match=held_up, pid=pid, edge=2 + edge)

    found = materialize(ranged.mapInPandas(match, "tree int, l1 long, l2 long, node long, before long, match int, pid int, edge int"))
    edges = [r.asDict() for r in found.where("edge > 0").collect()]
    edges.sort(key=lambda r: (r["pid"], r["edge"]))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if a["pid"] < b["pid"] and a["tree"] == b["tree"]:
            n = int(_common(*(np.array([r[c]]) for r in (a, b) for c in ("l1", "l2")))[0])
            a["match"] = max(a["match"], n)
            if n >= least:
                b["match"], b["before"] = max(b["match"], n), a["node"]
    names = [*order, "before", "match"]
    mended = [tuple(r[c] for c in names) for r in edges if r["match"] >= least]
    return found.where("edge = 0").select(*names).unionByName(classes.sparkSession.createDataFrame(mended, "tree int, l1 long, l2 long, node long, before long, match int"))


def neighbour_links(tries: DataFrame, classes: DataFrame, threshold: float) -> dict[float, int]:
    """How many distinct pairs of neighbours in the sorted tries have which similarity, of those near or above the
    threshold, by the share of equal values in their labels (a few hundred numbers come to the driver)."""
    pairs = materialize(tries.where("before >= 0").select(F.least("node", "before").alias("u"), F.greatest("node", "before").alias("v")).distinct())
    side = lambda c: classes.select(F.col("node").alias(c), F.col("labels").alias(f"{c}_labels"))
    both = pairs.join(side("u"), "u").join(side("v"), "v")
    x = F.zip_with("u_labels", "v_labels", lambda a, b: a.bitwiseXOR(b))
    lane = lambda v, i: F.when(F.shiftright(v, 16 * i).bitwiseAND(F.lit(0xFFFF)) == 0, 1).otherwise(0)
    equal = F.aggregate(x, F.lit(0), lambda n, v: n + sum((lane(v, i) for i in range(1, 4)), lane(v, 0)))
    share = F.greatest(F.lit(threshold), F.round(equal / (4 * F.size("u_labels")), 2))
    near = both.where(equal >= (threshold - 0.02) * 4 * F.size("u_labels"))
    return {float(s): n for s, n in near.groupBy(share.alias("s")).agg(F.count("*")).collect()}


def prefix_of(l1: Column, l2: Column, depth: int) -> Column:
    """Hash of the first ``depth`` values of a label."""
    keep = lambda k: F.lit(-1 if k >= 4 else -(1 << (64 - 16 * k)) if k > 0 else 0).cast("long")
    return F.xxhash64(l1.bitwiseAND(keep(depth)), l2.bitwiseAND(keep(depth - 4)))


def _shingle_rows(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(node, shingles) of the class representatives in ``wanted`` (node, w_id, kh, kl)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            nodes, sets = [], []
            for node, kh, kl, text in zip(pdf["node"], pdf["kh"], pdf["kl"], pdf["text"], strict=True):
                words = blank_words(text)
                if _key(words) == np.array([kh, kl], np.int64).tobytes():
                    nodes.append(node)
                    sets.append(np.unique(shingles(words, n)).view(np.int64))
            yield pd.DataFrame({"node": nodes, "shingles": sets})

    texts = docs.select("doc_id", "text").join(small_or_shuffled(wanted), F.col("doc_id").eqNullSafe(F.col("w_id")))
    found = texts.select("node", "kh", "kl", "text").mapInPandas(run, "node long, shingles array<long>")
    return materialize(found.dropDuplicates(["node"]))


def _pairs(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of Jaccard >= threshold, within ``left`` or between ``left`` and ``right``, by counting common
    shingles with a 0/1 matrix of those that several sets hold, some columns at a time."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    use = shared[column]
    owner, column = owner[use], place[column[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    a, b = left, left if right is None else right
    common = np.zeros((len(a), len(b)), np.float32)
    n_shared = int(shared.sum())
    width = max(1, min(n_shared, max(256, 8_000_000 // max(1, len(sets)))))
    for lo in range(0, n_shared, width):
        i, j = np.searchsorted(column, [lo, lo + width])
        m = np.zeros((len(sets), width), np.float32)
        m[owner[i:j], column[i:j] - lo] = 1
        common += m[a] @ m[b].T
    union = sizes[a][:, None] + sizes[b][None, :] - common
    ok = (common >= threshold * union - 1e-6) & (common > 0)
    if right is None:
        ok = np.triu(ok, 1)
    i, j = np.nonzero(ok)
    return a[i], b[j]


def verify_units(units: DataFrame, threshold: float) -> DataFrame:
    """(node, links, root) of each unit: documents linked to the node by pairs whose first common tree is the unit's,
    and the smallest node that those links reach within the unit."""

    def verify(g: dict[str, np.ndarray]) -> pd.DataFrame | None:
        sets, prefixes = [np.asarray(s).view(np.uint64) for s in g["shingles"]], np.stack(g["prefixes"])
        inner = g["ca"][0] == g["cb"][0]
        side = g["side"].astype(int)
        left = np.flatnonzero(side == 0)
        i, j = _pairs(sets, left, None if inner else np.flatnonzero(side == 1), threshold)
        first = (prefixes[i] == prefixes[j]).argmax(1) if len(i) else i
        own = first == g["tree"][0]
        i, j = i[own], j[own]
        if not len(i):
            return None
        links = np.zeros(len(sets), np.int64)
        np.add.at(links, i, g["copies"][j])
        np.add.at(links, j, g["copies"][i])
        root = g["node"].astype(np.int64).copy()
        while True:
            new = root.copy()
            np.minimum.at(new, i, root[j])
            np.minimum.at(new, j, root[i])
            if (new == root).all():
                break
            root = new
        hit = np.flatnonzero(links)
        return pd.DataFrame({"node": g["node"][hit], "links": links[hit], "root": root[hit]})

    return stream_groups(units, ["tree", "prefix", "ca", "cb"], verify, "node long, links long, root long")


def jaccard_links(docs: DataFrame, n: int = 5, threshold: float = 0.8, trees: int = 20, target_recall: float = 0.9995, weigh_links: bool = False) -> DataFrame:
    """Similarity join of ``docs`` (doc_id, text, ...) with itself on sets of ``n``-word shingles.

    Every document has a label of DEPTH MinHash values in each of ``trees`` prefix tries. The labels are sorted, and
    the prefixes that sorted neighbours share are the matched prefixes; they are shortened, all alike, until pairs at
    the threshold itself, the hardest to find, are found with ``target_recall`` (``forest_depth``). ``weigh_links`` asks for that
    recall on average over the similarities of matched neighbours instead: prefixes stay longer, and candidates fewer, where
    the links seen are closer, but pairs near the threshold are then found less often. Documents of an equal
    shortened prefix share a node and are candidates, and their Jaccard similarity is computed exactly. Copies are one
    class and are verified once;
    nodes whose members meet in an earlier tree are skipped; the members of a large node are dealt into blocks, and
    pairs of blocks are separate units, so that pairs are counted where they are verified and never become rows.

    Returns one row per input row: doc_id, text_hash (xxhash64 of the text), copy_id (smallest doc_id with the same words), n_copies, n_links (other
    documents of similarity >= threshold, copies included), class_id (smallest doc_id reachable by links), kept (the
    row that stands for its class; of repeated doc_ids, one). Words are runs of non-blanks in lower case; a text of fewer than
    ``n`` words is one shingle; null and wordless texts link with nothing and are kept. A null doc_id counts as larger
    than any other. Rows that repeat a doc_id with other words are documents of their own. An empty table gives an
    empty result; other columns are ignored.
    """
    signed = sign_documents(docs, n, trees)
    known = signed.where("n_shingles > 0")
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    classes = materialize(
        known.groupBy("kh", "kl").agg(lead.alias("lead"), F.count("*").alias("copies"), F.first("labels").alias("labels"), F.first("n_shingles").alias("n_shingles"))
        .select("kh", "kl", F.col("lead.row").alias("node"), F.col("lead.doc_id").alias("copy_id"), "copies", "labels", "n_shingles")
    )
    depth = forest_depth(threshold, trees, target_recall)
    tries = materialize(sorted_tries(classes, trees, depth))
    cand = materialize(classes.join(small_or_shuffled(materialize(tries.select("node").distinct())), "node", "left_semi"))
    if weigh_links:
        depth = forest_depth(threshold, trees, target_recall, neighbour_links(tries, cand, threshold))
    met = materialize(tries.where(F.col("match") >= depth).select("node", "tree", prefix_of(F.col("l1"), F.col("l2"), depth).alias("prefix")))
    own = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: prefix_of(F.element_at("labels", 2 * t + 1), F.element_at("labels", 2 * t + 2), depth))
    cand = materialize(cand.withColumn("prefixes", own).drop("labels"))
    sized = met.join(small_or_shuffled(cand), "node")
    covered = sized.groupBy("tree", "prefix").agg(
        F.count("*").alias("members"), F.sum("n_shingles").alias("size"), *(F.min(F.col("prefixes")[t]).alias(f"l{t}") for t in range(trees)), *(F.max(F.col("prefixes")[t]).alias(f"h{t}") for t in range(trees))
    )
    same = F.lit(False)
    for t in range(trees):
        same = same | ((F.col("tree") > t) & (F.col(f"l{t}") == F.col(f"h{t}")))
    blocks = F.ceil(F.greatest(F.col("members") / UNIT_DOCS, F.col("size") / UNIT_SHINGLES)).cast("int")
    fresh = materialize(covered.where(~same).select("tree", "prefix", blocks.alias("blocks")))
    rows = met.join(small_or_shuffled(fresh), ["tree", "prefix"])
    mine = F.expr("cast(pmod(xxhash64(node), blocks) as int)").alias("block")
    dealt = rows.select("node", "tree", "prefix", mine, F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    dealt = materialize(dealt.select("node", "tree", "prefix", F.least("block", "other").alias("ca"), F.greatest("block", "other").alias("cb"), F.expr("cast(block > other as int)").alias("side")))
    wanted = materialize(cand.join(small_or_shuffled(materialize(dealt.select("node").distinct())), "node", "left_semi").select("node", F.col("copy_id").alias("w_id"), "kh", "kl"))
    sets = _shingle_rows(docs, wanted, n)
    units = dealt.join(sets, "node").join(small_or_shuffled(cand.select("node", "copies", "prefixes")), "node")
    checked = materialize(verify_units(units, threshold))
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(checked.select(F.col("node").alias("u"), F.col("root").alias("v")))
    linked = materialize(classes.select("kh", "kl", "node", "copy_id", "copies").join(links, "node", "left").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")))
    heads = linked.where("links > 0").groupBy("component").agg(F.min(F.struct(F.col("copy_id").isNull().alias("none"), "copy_id", "node")).alias("head"))
    heads = materialize(heads.select("component", F.col("head.copy_id").alias("class_id"), F.col("head.node").alias("head")))
    full = materialize(
        linked.join(heads, "component", "left").select(
            "kh", "kl", "copy_id", F.col("copies").alias("n_copies"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.when(F.col("head").isNull(), F.col("copy_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("head", "node").alias("head"),
        )
    )
    out = signed.select("row", "doc_id", "text_hash", "kh", "kl", "n_shingles").join(full, ["kh", "kl"], "left")
    alone = F.col("n_shingles") == 0
    return out.select(
        "doc_id", "text_hash", F.when(alone, F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"), F.when(alone, 1).otherwise(F.col("n_copies")).cast("long").alias("n_copies"),
        F.when(alone, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"), F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        (alone | (F.col("row") == F.col("head"))).alias("kept"),
    )

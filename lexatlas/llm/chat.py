"""Chat formatting with minimum-cost role repair."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, shuffle_partitions

#: States of the automaton: nothing yet, or the role of the last turn.
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = (None, "system", "user", "assistant")
#: Legal next turns; a conversation may end where nothing has been said or after the assistant.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
FINAL = (START, ASSISTANT)
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}
#: Costs: a turn joined to one of its own role, of an unknown role, or of another role; a turn of an unknown or of another role
#: renamed; an empty turn put in.
COSTS = {"merge": 1, "merge_unknown": 2, "merge_other": 4, "relabel_unknown": 1, "relabel": 3, "insert": 2}
INF = 1 << 40


def _insertions() -> dict[tuple[int, int], tuple[int, ...]]:
    """Shortest runs of empty turns from state to state."""
    paths = {(s, s): () for s in NEXT}
    for _ in NEXT:
        for (s, t), path in list(paths.items()):
            for u in NEXT[t]:
                if (s, u) not in paths or len(paths[s, u]) > len(path) + 1:
                    paths[s, u] = (*path, u)
    return paths


def _choices(costs: dict[str, int]) -> list[list[list[tuple[int, str, tuple[int, ...]]]]]:
    """[role][from][to] -> (cost, action, inserted); role 0 is unknown."""
    paths, out = _insertions(), []
    for role in range(4):
        table = [[(INF, "", ()) for _ in NEXT] for _ in NEXT]
        for s in NEXT:
            def offer(t: int, cost: int, action: str, inserted: tuple[int, ...] = ()) -> None:
                if cost < table[s][t][0]:  # noqa: B023
                    table[s][t] = (cost, action, inserted)  # noqa: B023

            if s != START:
                offer(s, costs["merge"] if s == role else costs["merge_other"] if role else costs["merge_unknown"], "merge")
            for via in sorted(NEXT, key=lambda v: len(paths.get((s, v), range(9)))):
                if (s, via) in paths:
                    for t in NEXT[via]:
                        own = 0 if t == role else costs["relabel"] if role else costs["relabel_unknown"]
                        offer(t, own + costs["insert"] * len(paths[s, via]), "keep" if t == role else "relabel", paths[s, via])
        out.append(table)
    return out


def _closing(costs: dict[str, int]) -> list[tuple[int, tuple[int, ...]]]:
    """By last state: cost and turns of the cheapest legal ending."""
    paths = _insertions()
    return [min((costs["insert"] * len(paths[s, f]), paths[s, f]) for f in FINAL if (s, f) in paths) for s in NEXT]


def role_of(role: str | None) -> int:
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return NAMES.index(name) if name in NAMES[1:] else 0


class Repair:
    def __init__(self, costs: dict[str, int] | None = None):
        costs = COSTS | (costs or {})
        self.choices, self.closing = _choices(costs), _closing(costs)
        self.run = lru_cache(1 << 14)(self.matrix)

    def forward(self, roles: list[int], start: list[int]) -> list[list[int]]:
        """Least cost of each state before and after each turn."""
        rows = [start]
        for r in roles:
            table, last = self.choices[r], rows[-1]
            rows.append([min(last[s] + table[s][t][0] for s in range(4)) for t in range(4)])
        return rows

    def matrix(self, roles: list[int]) -> list[list[int]]:
        """Least cost of a run of turns from each state to each."""
        return [self.forward(roles, [0 if s == t else INF for t in range(4)])[-1] for s in range(4)]

    def end_state(self, costs: list[int]) -> int:
        return min(range(4), key=lambda s: (costs[s] + self.closing[s][0], s))

    def extend(self, matrix: list[list[int]] | None, roles: list[int]) -> list[list[int]]:
        """Matrix of a run of turns behind those of ``matrix``, sixteen turns at a time."""
        for i in range(0, len(roles), 16):
            more = self.run(tuple(roles[i : i + 16]))
            matrix = more if matrix is None else [[min(row[u] + more[u][t] for u in range(4)) for t in range(4)] for row in matrix]
        return matrix

    def path(self, roles: list[int], entry: int, exit: int | None) -> list[tuple[int, int, str, tuple[int, ...]]]:
        """(new state, cost, action, inserted before) of each turn, from ``entry`` to ``exit`` (None: a cheapest ending)."""
        rows = self.forward(roles, [0 if s == entry else INF for s in range(4)])
        t = self.end_state(rows[-1]) if exit is None else exit
        out = []
        for i in range(len(roles) - 1, -1, -1):
            table = self.choices[roles[i]]
            s = min(range(4), key=lambda s: (rows[i][s] + table[s][t][0], s))  # noqa: B023
            out.append((t, *table[s][t]))
            t = s
        return out[::-1]


class Plans:
    """What is done to the turns of a conversation, by its roles alone; those of short ones are remembered.

    A plan is (new roles, actions, costs, inserted, closing, texts put before, texts put after), a list each."""

    def __init__(self, fix: Repair, open_mark: str, close_mark: str):
        self.fix, self.open, self.close = fix, open_mark, close_mark
        self.known = lru_cache(1 << 14)(self.make)

    def __call__(self, roles: tuple[int, ...], *ends) -> tuple[list, ...]:
        return self.known(roles, *ends) if len(roles) <= 32 else self.make(roles, *ends)

    def make(self, roles: tuple[int, ...], entry: int, exit: int | None, goes_on: bool) -> tuple[list, ...]:
        out: tuple[list, ...] = tuple([] for _ in range(7))
        state, turn = entry, lambda t: f"{self.open}{NAMES[t]}\n"
        for new, cost, action, inserted in self.fix.path(list(roles), entry, exit):
            before = "\n\n" if action == "merge" else f"{self.close}\n" * (state != START) + "".join(f"{turn(t)}{self.close}\n" for t in inserted) + turn(new)
            for column, value in zip(out, (NAMES[new], action, cost, ",".join(NAMES[t] for t in inserted), "", before, ""), strict=True):
                column.append(value)
            state = new
        if not goes_on:
            after = self.fix.closing[state][1]
            out[4][-1], out[6][-1] = ",".join(NAMES[t] for t in after), f"{self.close}\n" + "".join(f"{turn(t)}{self.close}\n" for t in after)
        return out


def role_codes(roles: pd.Series) -> list[int]:
    place, names = pd.factorize(roles, use_na_sentinel=False)
    return np.array([role_of(None if pd.isna(r) else r) for r in names], int)[place].tolist()


def _conversation(pdf: pd.DataFrame, i: int) -> tuple[int, bool]:
    return int(pdf["conv_id"].iloc[i]), bool(pdf["no_conv_id"].iloc[i])


def _segments(pdf: pd.DataFrame) -> list[tuple[int, int]]:
    """Bounds of the runs of rows of one conversation."""
    ids, none = pdf["conv_id"].to_numpy(), pdf["no_conv_id"].to_numpy()
    cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]) | (none[1:] != none[:-1])) + 1).tolist(), len(pdf)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def repair_roles(turns: DataFrame, costs: dict[str, int] | None = None, open_mark: str = "<|im_start|>", close_mark: str = "<|im_end|>") -> DataFrame:
    """Repair the roles of conversations (conv_id, turn, role, text) at least cost and render them.

    A legal conversation is an optional system turn and then user and assistant turns in alternation, ending with the
    assistant. For each turn dynamic programming over the automaton's states chooses to keep it, to merge it into the
    turn before, to give it another role, or to put empty turns before it (COSTS; of equal costs the earlier state and
    the earlier of these choices win).

    Rows are range-sorted by conversation and turn, so a conversation of any length is spread over several tasks: of
    conversations that cross a task's border only a 4 x 4 cost matrix per task goes to the driver, which joins them and
    returns each part's first and last state.

    Returns one row per turn: conv_id, place (the order of rows), turn, role, new_role, action (keep, merge, relabel),
    cost, inserted (empty turns put before it), closing (empty turns put after a conversation's last), rendered. The
    rendered pieces of a conversation, joined in order of place, are its text. Roles are compared without case, common
    aliases are known, other and null roles are unknown; null text is empty; rows with a null conv_id are one
    conversation; null turns come last; equal turns go by role and a hash of the text; an empty table gives an empty result; other columns are ignored.
    """
    spark = turns.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(spark))
    order = ["conv_id", F.col("turn").asc_nulls_last(), "role", F.xxhash64("text")]
    spread = turns.select("conv_id", "turn", "role", "text").repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    held = spread.withColumn("pid", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()).checkpoint()
    whole = lambda c: [F.coalesce(c, F.lit(0).cast("long")).alias(c), F.col(c).isNull().alias(f"no_{c}")]

    def borders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fix, first, last, pid = Repair(costs), None, None, None
        for pdf in batches:
            if not len(pdf):
                continue
            pid, codes = pdf["pid"].iloc[0], role_codes(pdf["role"])
            for i, (a, b) in enumerate(segments := _segments(pdf)):
                conv = _conversation(pdf, a)
                if last is not None and last[0] == conv:
                    last = (conv, fix.extend(last[1], codes[a:b]))
                elif first is None or i == len(segments) - 1:  # those between a task's first and last do not matter
                    first = first or last
                    last = (conv, fix.extend(None, codes[a:b]))
        if last is not None:
            parts = [last] if first is None else [first, last]
            yield pd.DataFrame({"pid": pid, "conv_id": pd.array([None if p[0][1] else p[0][0] for p in parts], "Int64"), "matrix": [sum(p[1], []) for p in parts]})

    found = held.select("pid", *whole("conv_id"), "role").mapInPandas(borders, "pid int, conv_id long, matrix array<long>").collect()
    found.sort(key=lambda r: r["pid"])  # stable: the first conversation of a partition stays before its last
    known = _join_borders(found, Repair(costs))

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plan = Plans(Repair(costs), open_mark, close_mark)
        rest: list[pd.DataFrame] = []  # the rows so far of the conversation that goes on
        opened = False

        def finish(pdf: pd.DataFrame, cuts: list[tuple[int, int]], final: bool) -> pd.DataFrame:
            """Repair the conversations of whole ``cuts``; ``final``: the last is the last of its task."""
            nonlocal opened
            codes, texts, pid = role_codes(pdf["role"]), pdf["text"].tolist(), int(pdf["pid"].iloc[0])
            columns: list[list] = [[] for _ in range(6)]
            for a, b in cuts:
                steps = plan(tuple(codes[a:b]), *known.get((pid, not opened, final and b == len(pdf)), (START, None, False)))
                opened = True
                for column, own in zip(columns[:5], steps[:5], strict=True):
                    column += own
                columns[5] += [x + (t or "") + y for x, t, y in zip(steps[5], texts[a:b], steps[6], strict=True)]
            out = dict(zip(("new_role", "action", "cost", "inserted", "closing", "rendered"), columns, strict=True))
            ids = {c: pdf[c].astype("Int64").mask(pdf[f"no_{c}"]).reset_index(drop=True) for c in ("conv_id", "turn")}
            return pd.DataFrame(ids | {"place": pdf["place"].to_numpy(), "role": pdf["role"].to_numpy()} | out)

        for pdf in batches:
            if not len(pdf):
                continue
            if rest and _conversation(rest[-1], 0) == _conversation(pdf, 0):
                a, b = _segments(pdf)[0]
                rest.append(pdf[:b])
                pdf = pdf[b:].reset_index(drop=True)
                if not len(pdf):
                    continue
            if rest:
                own = pd.concat(rest, ignore_index=True)
                yield finish(own, [(0, len(own))], False)
            *cuts, (a, b) = _segments(pdf)
            if cuts:
                yield finish(pdf[:a], cuts, False)
            rest = [pdf[a:].reset_index(drop=True)]
        if rest:
            own = pd.concat(rest, ignore_index=True)
            yield finish(own, [(0, len(own))], True)

    schema = "conv_id long, place long, turn long, role string, new_role string, action string, cost int, inserted string, closing string, rendered string"
    names = [f.split()[0] for f in schema.split(", ")]
    return held.select("pid", *whole("conv_id"), *whole("turn"), "role", "text", "place").mapInPandas(lambda x: (f[names] for f in render(x)), schema)


def _join_borders(found: list, fix: Repair) -> dict[tuple[int, bool, bool], tuple[int, int | None, bool]]:
    """(task, is the task's first conversation, is its last) -> (entry, exit, goes on in the next task) of the parts of
    conversations that cross task borders. found: at most two rows per task."""
    tasks: dict[int, list] = {}
    for r in found:
        tasks.setdefault(r["pid"], []).append(r)
    chains, chain = [], []
    for pid in sorted(tasks):
        own = tasks[pid]
        only = len(own) == 1
        if chain and chain[-1][3] == own[0]["conv_id"]:
            chain.append((pid, True, only, own[0]["conv_id"], own[0]["matrix"]))
        elif chain:
            chains.append(chain)
            chain = []
        if not chain or not only:
            if len(chain) > 1 or chain:
                chains.append(chain)
            chain = [(pid, only, True, own[-1]["conv_id"], own[-1]["matrix"])]
    chains.append(chain)
    out: dict[tuple[int, bool, bool], tuple[int, int | None, bool]] = {}
    for chain in chains:
        if len(chain) < 2:
            continue
        costs = [[0, INF, INF, INF]]
        for *_, m in chain:
            costs.append([min(costs[-1][s] + m[4 * s + t] for s in range(4)) for t in range(4)])
        state = fix.end_state(costs[-1])
        for i in range(len(chain) - 1, -1, -1):
            pid, first, final, _, m = chain[i]
            entry = min(range(4), key=lambda s: (costs[i][s] + m[4 * s + state], s))  # noqa: B023
            out[pid, first, final] = (entry, state, i < len(chain) - 1)
            state = entry
    return out

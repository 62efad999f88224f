"""Keyed folds of streams in event order, whatever order the files come in."""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Buckets that the keys are dealt into. A stream that goes on from a checkpoint must keep their number.
BUCKETS = 2048
#: Rows and characters of a bucket that are taken from the batch at once, and those that a leaf of waiting rows may have.
CHUNK = 131_072
CHUNK_CHARS = 1 << 24
LEAF_ROWS = 16_384
LEAF_CHARS = 1 << 20
#: Entries that a slice of a bucket's map has on average, at most.
SLICE = 256

Event = tuple  # microseconds, value, and the key's columns
Fold = Callable[[tuple, tuple | None, int, str | None], tuple[list[tuple], tuple]]


def use_rocksdb(spark: SparkSession) -> None:
    """Set the session's state store to RocksDB, which keeps states on disk and which keyed streams need. For programs that
    own their session; the jobs do not call it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def event_order(events: Iterable[Event]) -> list[Event]:
    """By time, equal times by null first and value."""
    return sorted(events, key=lambda e: (e[0], e[1] is not None, e[1] or ""))


def _ms(us: int) -> int:
    return -(-us // 1000)


def _size(event: Event) -> int:
    return sum([len(text) for text in event[1:] if text])


def _chars(events: list[Event]) -> int:
    return sum(map(_size, events))


def _chunks(frames: Iterator[pd.DataFrame]) -> Iterator[list[Event]]:
    """Rows (bucket, ts, us, value, key's columns) in lists of at most CHUNK of them, or CHUNK_CHARS characters and a row."""
    events, chars = [], 0
    for pdf in frames:
        us, *texts = (pdf.iloc[:, i] for i in range(2, pdf.shape[1]))
        for event in zip(us.tolist(), *([v if isinstance(v, str) else None for v in t] for t in texts), strict=True):
            events.append(event)
            chars += _size(event)
            if len(events) >= CHUNK or chars >= CHUNK_CHARS:
                yield events
                events, chars = [], 0
    if events:
        yield events


def _split(events: list[Event]) -> list[list[Event]]:
    """Ordered events in pieces, half full where there are several; a millisecond is not divided."""
    if len(events) <= LEAF_ROWS and _chars(events) <= LEAF_CHARS:
        return [events]
    leaves: list[list[Event]] = []
    chars = 0
    for event in events:
        n = _size(event)
        full = not leaves or 2 * len(leaves[-1]) >= LEAF_ROWS or 2 * (chars + n) > LEAF_CHARS
        if full and (not leaves or _ms(event[0]) != _ms(leaves[-1][-1][0])):
            leaves.append([])
            chars = 0
        leaves[-1].append(event)
        chars += n
    return leaves


class Leaf(NamedTuple):
    """A line of the directory: a start that orders the leaves, the first row's time, parts, rows and characters."""

    start: int
    first: int
    parts: int
    rows: int
    chars: int


class Slices:
    """A map of a bucket from keys (tuples of strings) to tuples. It lies in slices by a hash of the key, whose number doubles as
    the map grows; between ``load`` and ``flush`` the slices that are needed are read once, and those that changed are written."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, width: int, fields: str):
        columns = [*(f"k{i} string" for i in range(width)), *fields.split(", ")]
        self.width, self.blank = width, tuple([] for _ in columns)
        self.slices = handle.getMapState(name, "slice long", ", ".join("{} array<{}>".format(*c.split()) for c in columns))
        self.numbers = handle.getValueState(f"{name}_numbers", "entries long, slices long")

    def load(self) -> None:
        """What is read is forgotten, as for another bucket."""
        self.entries, self.read, self.changed = {}, set(), set()
        self.known, self.parts = self.numbers.get() or (0, 0)

    def _of(self, key: tuple, parts: int) -> int:
        return zlib.crc32("\0".join(k or "" for k in key).encode("utf-8", "replace")) % max(1, parts)

    def _slice(self, i: int) -> dict[tuple, tuple]:
        lines = zip(*self.slices.getValue((i,)), strict=True) if i < self.parts else ()
        return {line[: self.width]: line[self.width :] for line in lines}

    def _write(self, i: int, entries: dict[tuple, tuple]) -> None:
        lines = [(*k, *v) for k, v in entries.items()]
        self.slices.updateValue((i,), tuple(map(list, zip(*lines, strict=True))) if lines else self.blank)

    def get(self, key: tuple) -> tuple | None:
        if key not in self.entries and (i := self._of(key, self.parts)) not in self.read:
            self.read.add(i)
            self.entries |= self._slice(i)
        return self.entries.get(key)

    def put(self, key: tuple, value: tuple | None) -> None:
        """Set an entry; None removes it."""
        self.known += (value is not None) - (self.get(key) is not None)
        self.changed.add(key)
        if value is None:
            self.entries.pop(key, None)
        else:
            self.entries[key] = value

    def flush(self) -> None:
        if self.parts:
            dealt = {self._of(key, self.parts): {} for key in self.changed}
        else:
            self.parts = 1 << max(0, -(-self.known // SLICE) - 1).bit_length()
            dealt = {i: {} for i in range(self.parts)}
        for key, value in self.entries.items():
            if (i := self._of(key, self.parts)) in dealt:
                dealt[i][key] = value
        for i, entries in dealt.items():
            self._write(i, entries)
        while self.known > SLICE * self.parts:
            for i in range(self.parts):  # one slice at a time
                entries = self._slice(i)
                for at in (i, i + self.parts):
                    self._write(at, {k: v for k, v in entries.items() if self._of(k, 2 * self.parts) == at})
            self.parts *= 2
        self.numbers.update((self.known, self.parts))
        self.load()

    def retain(self, keep: Callable[[tuple, tuple], bool]) -> int:
        """Remove the other entries; how many stay."""
        self.load()
        for i in range(self.parts):
            entries = self._slice(i)
            kept = {k: v for k, v in entries.items() if keep(k, v)}
            if len(kept) < len(entries):
                self._write(i, kept)
                self.known -= len(entries) - len(kept)
        if self.known:
            self.numbers.update((self.known, self.parts))
        else:
            self.slices.clear()
            self.numbers.clear()
        return self.known


class InEventOrder(StatefulProcessor):
    """Holds rows back until the watermark has passed them, then folds those of each key by time.

    Keys are dealt into buckets, and the state is a bucket's: state is read and written by calls that cost far more than a row
    does, and a bucket takes as many as a key would. Waiting rows lie in map state as leaves of a sorted list: each holds the
    bucket's rows of a span of time, in as many parts as came to it, at most LEAF_ROWS rows and LEAF_CHARS characters; a fuller
    leaf is split (but no millisecond). A timer stands at the first row of each leaf. Timers fire in order of time, so a task
    folds leaf after leaf and holds one of them, whatever a bucket or a key has; besides them a bucket has a directory
    with a line per leaf, and the states of its keys in ``Slices``. A key's state starts anew behind a row-free span of
    ``ttl_ms``; the watermark removes such states once in ``ttl_ms``, so that none stays for twice that.
    """

    keys: list[str]  # set by in_event_order

    def __init__(self, names: list[str], state: str, fold: Fold | None, ttl_ms: int):
        self.names, self.schema, self.fold, self.ttl_ms = names, state, fold, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "start long, part long", ", ".join(["times array<long>", "vals array<string>", *(f"k{i} array<string>" for i in range(len(self.keys)))]))
        self.directory = handle.getValueState("leaves", ", ".join(f"{f} array<long>" for f in Leaf._fields))
        self.sweeps = handle.getValueState("sweeps", "next long")
        self.states = Slices(handle, "states", len(self.keys), f"folded long, {self.schema}")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        leaves, newest = self._leaves(), 0
        self.states.load()
        for some in _chunks(rows):
            events = self.lighten(event_order(some))
            newest = max(newest, _ms(events[-1][0]))
            of: dict[int, list[Event]] = {}
            for e in events:
                of.setdefault(max(0, bisect_right(leaves, e[0], key=lambda leaf: leaf.start) - 1), []).append(e)
            for i in sorted(of, reverse=True):  # from the last, so that splits move no leaf that is still to come
                leaves[i : i + 1] = self._add(leaves[i] if leaves else None, of[i])
        self._save(leaves)
        if self.sweeps.get() is None:
            self._sweep_at(newest + self.ttl_ms)
        return iter(())

    def _sweep_at(self, ms: int) -> None:
        self.handle.registerTimer(ms)
        self.sweeps.update((ms,))

    def _leaves(self) -> list[Leaf]:
        found = self.directory.get()
        return [Leaf(*line) for line in zip(*found, strict=True)] if found else []

    def _save(self, leaves: list[Leaf]) -> None:
        self.directory.update(tuple(map(list, zip(*leaves, strict=True)))) if leaves else self.directory.clear()

    def _write(self, start: int, part: int, events: list[Event]) -> None:
        self.waiting.updateValue((start, part), tuple(map(list, zip(*events, strict=True))))

    def _take(self, leaf: Leaf) -> list[Event]:
        """The leaf's rows in order; its parts go."""
        events = []
        for part in range(leaf.parts):
            events += zip(*self.waiting.getValue((leaf.start, part)), strict=True)
            self.waiting.removeKey((leaf.start, part))
        return event_order(events)

    def _new(self, start: int, events: list[Event]) -> Leaf:
        self._write(start, 0, events)
        self.handle.registerTimer(_ms(events[0][0]))
        return Leaf(start, events[0][0], 1, len(events), _chars(events))

    def _add(self, leaf: Leaf | None, events: list[Event]) -> list[Leaf]:
        """The leaves that come of adding events to one."""
        if leaf and leaf.rows + len(events) <= LEAF_ROWS and leaf.chars + (chars := _chars(events)) <= LEAF_CHARS:
            self._write(leaf.start, leaf.parts, events)
            if events[0][0] < leaf.first:
                self.handle.registerTimer(_ms(events[0][0]))
            return [Leaf(leaf.start, min(leaf.first, events[0][0]), leaf.parts + 1, leaf.rows + len(events), leaf.chars + chars)]
        pieces = _split(event_order([*self._take(leaf), *events]) if leaf else events)
        first = pieces[0][0][0]
        return [self._new(start, piece) for start, piece in zip([min(leaf.start, first) if leaf else first, *(p[0][0] for p in pieces[1:])], pieces, strict=True)]

    def lighten(self, events: list[Event]) -> list[Event]:
        """Events as they are to wait: those whose value cannot matter any more may lose it."""
        return events

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, passed, leaves = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() * 1000, self._leaves()
        i = max(0, bisect_right(leaves, now * 1000, key=lambda leaf: leaf.start) - 1)
        if leaves and leaves[i].first <= passed:
            events = self._take(leaves[i])
            cut = bisect_right(events, passed, key=lambda e: e[0])
            leaves[i : i + 1] = [self._new(leaves[i].start, events[cut:])] if cut < len(events) else []
            self._save(leaves)
            if out := list(self.step(events[:cut])):
                yield pd.DataFrame(out, columns=self.names)
        if self.sweeps.get() == (now,):
            if self.sweep(now * 1000 - self.ttl_ms * 1000) or leaves:
                self._sweep_at(now + self.ttl_ms)
            else:
                self.sweeps.clear()

    def step(self, events: list[Event]) -> Iterator[tuple]:
        self.states.load()
        for us, value, *of in events:
            key = tuple(of)
            folded, *held = self.states.get(key) or (None,)
            state = tuple(held) if folded is not None and us - folded < self.ttl_ms * 1000 else None
            out, state = self.fold(key, state, us, value)
            self.states.put(key, (us, *state))
            yield from out
        self.states.flush()

    def sweep(self, before: int) -> int:
        """Remove the states whose last row is not after ``before``; how many stay."""
        return self.states.retain(lambda _, state: state[0] > before)


class Histories(InEventOrder):
    """T2's decisions. A page's rows are kept as the number of rows per hash and what is needed of two of them: the newest
    (``hash``, ``at``) and the first; so that a decision touches few entries, however many hashes a page has had. A number
    counts as long as the page's rows go on since the time that it was written with."""

    def __init__(self, names: list[str], gap_seconds: int, ttl_ms: int):
        super().__init__(names, "since long, first string, hash string, at long, newest_is_first boolean", None, ttl_ms)
        self.gap = gap_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.rows = Slices(handle, "rows", len(self.keys) + 1, "since long, n long")

    def step(self, events: list[Event]) -> Iterator[tuple]:
        self.states.load()
        self.rows.load()
        for us, h, *of in events:
            key = tuple(of)
            folded, since, first, newest, at, is_first = self.states.get(key) or (None,) * 6
            if folded is not None and us - folded >= self.ttl_ms * 1000:
                folded = None
            if folded is None:
                since = us
            if folded is not None and us - at <= self.gap and h != newest:
                self._count(key, since, newest, -1)
                self._count(key, since, h, 1)
                first, newest, at, action = (h if is_first else first), h, us, "overwrite"
            elif folded is not None and self._number(key, since, h):
                newest, at, is_first, action = first, us, True, "bump"
            else:
                self._count(key, since, h, 1)
                first, is_first = (h, True) if folded is None else (first, False)
                newest, at, action = h, us, "insert"
            self.states.put(key, (us, since, first, newest, at, is_first))
            yield (*key, h, us, action)
        self.rows.flush()
        self.states.flush()

    def _number(self, key: tuple, since: int, h: str | None) -> int:
        then, n = self.rows.get((*key, h or "")) or (since, 0)
        return n if then == since else 0

    def _count(self, key: tuple, since: int, h: str | None, by: int) -> None:
        n = self._number(key, since, h) + by
        self.rows.put((*key, h or ""), (since, n) if n else None)

    def sweep(self, before: int) -> int:
        left = super().sweep(before)
        self.states.load()
        self.rows.retain(lambda key, row: (self.states.get(key[:-1]) or (None, None))[1] == row[0])
        return left


class Longest(InEventOrder):
    """T5: of the rows that arrive together, only those longer than all before them keep their text while they wait."""

    def lighten(self, events: list[Event]) -> list[Event]:
        out, last = [], {}
        for us, text, *of in events:
            key = tuple(of)
            folded, most = last.get(key) or self.states.get(key) or (None, 0)
            if folded is None or us - folded >= self.ttl_ms * 1000:
                most = 0
            n = len(text or "")
            out.append((us, text if n > most else None, *of))
            last[key] = us, max(most, n)
        return out


def in_event_order(stream: DataFrame, keys: list[str], value: str, processor: InEventOrder, out: str, late: str, buckets: int = BUCKETS) -> DataFrame:
    """The rows that ``processor`` gives for each key's rows (ts, value) in event order; ``ts`` in ``out`` comes back as a
    timestamp.

    A row is folded once the watermark, ``late`` behind the newest row of the stream, has passed it; then no earlier row
    can follow (the stream drops such). So the last rows of a stream stay open until newer ones come. Rows without a
    time are dropped. Keys are strings. The session's state store must be RocksDB (``use_rocksdb``).
    """
    if stream.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass") != ROCKSDB:
        raise ValueError("keyed streams need the RocksDB state store: call use_rocksdb on the session")
    processor.keys = keys
    dealt, us = F.pmod(F.xxhash64(*keys), F.lit(buckets)), F.unix_micros(F.col("ts").cast("timestamp"))
    rows = stream.where("ts is not null").select(dealt.alias("bucket"), "ts", us.alias("us"), F.col(value).cast("string").alias("value"), *(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)))
    done = rows.withWatermark("ts", late).groupBy("bucket").transformWithStateInPandas(processor, out.replace("ts timestamp", "ts long"), "Append", "EventTime")
    return done.withColumn("ts", F.timestamp_micros("ts"))

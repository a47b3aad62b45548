"""Filling containers of a fixed capacity, best-fit decreasing.

Best-fit decreasing puts items in order of falling size, each into the open bin with the least
room that still takes it. Which of several items of one size comes first changes no bin's load, so
the loads follow from the number of items of each size alone. Sizes go from 1 to the capacity: the
histogram has at most ``capacity`` rows however many documents there are, and one driver-side pass
over it (:func:`plan`) fixes the whole packing. A segment tree over the remaining capacities finds
the tightest open bin in logarithmic time, for a whole run of equal items at once. Items are then
numbered within their size and looked up in the plan, without moving their text.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axiomill.session import checkpointed

#: Items of one size are numbered in parts of about this many, so that a size shared by a third of all
#: items (the pieces that fill a container alone, say) is no single task.
PART = 100_000


class Run(NamedTuple):
    """Items ``first .. first + n - 1`` of a size go to bins from ``bin``, ``each`` to a bin."""

    size: int
    first: int
    n: int
    bin: int
    each: int


class Remaining:
    """A segment tree over 0..capacity: the least remaining capacity >= x that any open bin has."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.used = [0] * (2 * self.width)

    def add(self, remaining: int, change: int) -> None:
        i = remaining + self.width
        while i:
            self.used[i] += change
            i >>= 1

    def tightest(self, least: int) -> int | None:
        i = least + self.width
        if self.used[i]:
            return least
        while i > 1:
            if not i & 1 and self.used[i + 1]:
                i += 1
                while i < self.width:
                    i = 2 * i if self.used[2 * i] else 2 * i + 1
                return i - self.width
            i >>= 1
        return None


def plan(histogram: dict[int, int], capacity: int, first_bin: int = 0) -> list[Run]:
    """The best-fit-decreasing packing of ``histogram[size]`` items of every size (1..capacity).

    Bins are kept as intervals of consecutive numbers with the same room. Putting k equal items
    into an interval splits it into full takers, one partial taker and the untouched rest, so each
    size adds at most three intervals and the plan has a row for each interval a size touches.
    """
    tree, rooms = Remaining(capacity), {}
    runs: list[Run] = []
    next_bin = first_bin

    def put(room: int, start: int, n: int) -> None:
        if n:
            rooms.setdefault(room, []).append((start, n))
            tree.add(room, 1)

    for size in sorted(histogram, reverse=True):
        if not 1 <= size <= capacity:
            raise ValueError(f"size {size} doesn't fit a container of {capacity}")
        left, done = histogram[size], 0
        while left:
            room = tree.tightest(size)
            if room is None:
                each = capacity // size
                room, start, n = capacity, next_bin, -(-left // each)
                next_bin += n
            else:
                start, n = rooms[room].pop()
                tree.add(room, -1)
            each = room // size
            full = min(n, left // each)
            if full:
                runs.append(Run(size, done, full * each, start, each))
                put(room - each * size, start, full)
                done, left, start, n = done + full * each, left - full * each, start + full, n - full
            if n and left and left < each:
                runs.append(Run(size, done, left, start, each))
                put(room - left * size, start, 1)
                done, left, start, n = done + left, 0, start + 1, n - 1
            put(room, start, n)
    return runs


def pieces(sizes: DataFrame, capacity: int, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """``key, piece, n_tokens``: items cut to at most ``capacity``.

    Only an item above the capacity is cut, into full containers and one rest. An item of size 0
    (an empty or null text) is one piece of size 0.
    """
    n = F.coalesce(F.col(size), F.lit(0)).cast("bigint")
    cuts = F.greatest(F.lit(1), F.ceil(n / capacity).cast("bigint"))
    return sizes.select(F.col(key), n.alias("_n"), F.explode(F.sequence(F.lit(0).cast("bigint"), cuts - 1)).alias("piece")).select(
        key, F.col("piece").cast("int").alias("piece"), F.least(F.col("_n") - F.col("piece") * capacity, F.lit(capacity)).cast("int").alias("n_tokens")
    )


def packed(sizes: DataFrame, capacity: int, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """``key, piece, n_tokens, bin``: every item in a container of ``capacity``, best-fit decreasing.

    ``sizes`` (``key`` unique and orderable) should be stored, as it is read three times. Pieces of
    size 0 take no room and get bin 0; equal items are placed in the order of ``key``'s hash part,
    then of ``key``, so the result depends on the rows alone. An empty table gives no rows.
    Extra columns are ignored.
    """
    items = pieces(sizes, capacity, key, size)
    # One row for each size, at most ``capacity``, whatever the number of items.
    counts = items.where("n_tokens > 0").groupBy("n_tokens").count().collect()
    histogram = {row["n_tokens"]: row["count"] for row in counts}
    parts = max(1, -(-max(histogram.values(), default=0) // PART))
    items = items.withColumn("_part", F.pmod(F.xxhash64(key, "piece"), F.lit(parts)).cast("int"))
    # Where the numbers of a part begin among those of its size.
    before = Window.partitionBy("n_tokens").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = items.groupBy("n_tokens", "_part").agg(F.count("*").alias("_n")).select("n_tokens", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    by_size: dict[int, tuple[list[int], list[Run]]] = {}
    for run in plan(histogram, capacity):
        firsts, runs = by_size.setdefault(run.size, ([], []))
        firsts.append(run.first)
        runs.append(run)
    shared = sizes.sparkSession.sparkContext.broadcast(by_size)  # bounded by the capacity alone
    rank = F.row_number().over(Window.partitionBy("n_tokens", "_part").orderBy(key, "piece")) - 1
    numbered = items.withColumn("_rank", rank).join(offsets, ["n_tokens", "_part"]).withColumn("_at", F.col("_rank") + F.col("_offset"))
    kind = dict(sizes.dtypes)[key]

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        by_size = shared.value
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            bins = []
            for n, at in zip(columns["n_tokens"].to_pylist(), columns["_at"].to_pylist(), strict=True):
                if not n:
                    bins.append(0)
                    continue
                firsts, runs = by_size[n]
                run = runs[bisect_right(firsts, at) - 1]
                bins.append(run.bin + (at - run.first) // run.each)
            yield pa.RecordBatch.from_arrays([columns[key], columns["piece"], columns["n_tokens"], pa.array(bins, pa.int64())], [key, "piece", "n_tokens", "bin"])

    return numbered.select(key, "piece", "n_tokens", "_at").mapInArrow(place, f"`{key}` {kind}, piece int, n_tokens int, bin bigint")


def packed_all(sizes: DataFrame, capacities: list[tuple[str, int]], key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """``pack_name, capacity`` and the columns of :func:`packed` for each of a few named capacities.

    The sizes are written once to the checkpoint folder, so no text is tokenized again.
    """
    stored = checkpointed(sizes.select(key, size))
    out = None
    for name, capacity in capacities:
        one = packed(stored, capacity, key, size).select(F.lit(name).alias("pack_name"), F.lit(capacity).alias("capacity"), "*")
        out = one if out is None else out.unionAll(one)
    return out

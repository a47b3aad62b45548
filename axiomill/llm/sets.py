"""Pairs of similar sets: weighted min-wise bands, then verification on the full sets.

Each set (a row's distinct words or ids, as 64-bit values) is a *fingerprint*; rows with equal sets
share it, so any number of exact copies is one entry from the first shuffle on. A band is a random
order of all values; its key are the first values of the set in that order, i.e. rows of MinHash
without replacement. Orders are weighted: a value of frequency f comes early in proportion to 1 / f,
as two sets that share only what everybody has are not worth verifying; the rarest fifth of all
occurrences (slips of the pen among them, which nobody shares) weigh the same. The frequencies come
from a table of fixed size (values hashed to 2**18 counters), so what is broadcast doesn't grow with
the data; counters that are shared only change weights.

* *How many rows* a key has follows from the frequencies: as few as leave a set at most PARTNERS
  chance partners in a band (:func:`rows_for`). *How many bands* follows from the rows and the target
  recall (:func:`bands_for`), and is checked on the result: the pairs that met in one band and in two
  tell how many met in none (Chao's estimator), and bands are added until that share is small enough.
* What is shuffled is the band number, the whole 64-bit key, the fingerprint, and a sketch of 128 bits
  with one bit set for each value. The values of A that aren't in B number at least the bits of A that
  B's sketch lacks; a pair that can't reach the similarity by this bound leaves no row.
* A key with more than HOT sets is banded again: its sets get the keys of further bands on their other
  values. Keys with a large share of all sets are known from a sample before anything is shuffled;
  the others pass through their task as a stream. What is hot even then is split in blocks, and each
  pair of blocks is a group of its own.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axiomill.session import checkpointed

COUNTER_BITS = 18
#: Chance partners of a set in one band that the number of rows is chosen for, and the most rows.
PARTNERS, MOST_ROWS = 64, 4
#: Sets of one band key beyond this are banded again; sets of a block where even that leaves too many.
HOT, BLOCK = 4096, 1024
#: Sets that hot keys are looked for in: of one task, and of all. They decide how sets meet, not whether.
TASK_SAMPLE, SAMPLE = 1000, 20_000
#: Fingerprints remembered in a task, to send each once; forgetting one only repeats a row.
REMEMBERED = 500_000
#: Pairs looked at at a time.
AT_ONCE = 1 << 20
#: Rounds of bands at most.
ROUNDS = 4
#: The band number of keys on pairs of values, and what further bands are numbered from.
PAIRED, FURTHER = -1, 1 << 16


@dataclass(frozen=True)
class Similarity:
    """``column``: the similarity as an expression of shared, size_a, size_b, null below the limit.
    ``possible``: whether sets of these sizes that share so many values reach the limit (numpy arrays)."""

    column: Column
    possible: Callable


def bands_for(similarity: float, recall: float, rows: int = 2) -> int:
    """Bands of ``rows`` rows so that sets of this (weighted) similarity meet with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def rows_for(table, n_sets: int) -> int:
    """The least number of rows that leaves a set at most PARTNERS chance partners in a band."""
    import numpy as np

    first = np.asarray(table) * weights_of(table)
    if not first.sum():
        return 1
    chance = float(((first / first.sum()) ** 2).sum())  # that two sets have the same first value
    return next((r for r in range(1, MOST_ROWS) if n_sets * chance**r <= PARTNERS), MOST_ROWS)


def as_sets(rows: DataFrame, key: str, values: str) -> DataFrame:
    """``key, fp, items``: the set of a text's words, or of an id list's ids, as 64-bit values.

    A text's words are the longest runs of a-z and 0-9 of its lower-cased form. Rows with a null
    key, null values or an empty set are left out; null ids are ignored.
    """
    kinds = dict(rows.dtypes)
    if kinds[values] != "string":
        ids = F.array_distinct(F.transform(F.filter(values, lambda x: x.isNotNull()), lambda x: x.cast("bigint")))
        some = rows.where(F.col(key).isNotNull() & F.exists(values, lambda x: x.isNotNull()))
        return some.select(F.col(key), F.array_sort(ids).alias("items")).select(key, F.xxhash64("items").alias("fp"), "items")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        number = _Numbers().__getitem__
        for batch in batches:
            flat, ends = [], [0]
            for text in batch.column(1).to_pylist():
                flat.extend(map(number, set(words(text))))
                ends.append(len(flat))
            ends = np.array(ends)
            full = np.flatnonzero(np.diff(ends))
            items = np.array(flat, "int64")
            # The fingerprint is a hash of the sum of the values' hashes: the order doesn't matter.
            with np.errstate(over="ignore"):
                fps = mixed(np.add.reduceat(mixed(items.view("uint64"), 0), ends[full]), 1).view("int64") if len(full) else np.empty(0, "int64")
            lists = pa.ListArray.from_arrays(pa.array(np.append(ends[full], len(flat)).astype("int32")), pa.array(items))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(full)), pa.array(fps), lists], [key, "fp", "items"])

    some = rows.where(F.col(key).isNotNull() & F.col(values).isNotNull())
    return some.select(key, values).mapInArrow(run, f"`{key}` {kinds[key]}, fp bigint, items array<bigint>")


#: All bytes but a-z and 0-9 become blanks.
WORD_BYTES = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    """The longest runs of a-z and 0-9 of the lower-cased text."""
    return text.lower().encode("ascii", "replace").translate(WORD_BYTES).split()


class _Numbers(dict):
    """Word -> 64-bit value; starts afresh when it holds REMEMBERED words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= REMEMBERED:
            self.clear()
        n = xxhash.xxh64_intdigest(word)
        self[word] = n = n - (1 << 64) if n >> 63 else n
        return n


@dataclass(frozen=True)
class Survey:
    """What one pass over the sets tells: ``members`` (``key, fp``, stored), how many sets hold each
    hashed value, the number of sets, and a bounded sample of them (values, starts)."""

    members: DataFrame
    table: object
    n_sets: int
    sample: tuple


def surveyed(sets: DataFrame, key: str) -> Survey:
    import numpy as np

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own, kind, n_sets = np.zeros(1 << COUNTER_BITS, "int64"), None, 0
        names = [key, "fp", "slot", "n", "items"]
        lists_of = pa.list_(pa.int64())
        kept: list[tuple[int, object]] = []  # the sets with the least hashes
        least = np.uint64(2**64 - 1)
        for batch in batches:
            kind, n = batch.schema.field(0).type, batch.num_rows
            n_sets += n
            own += np.bincount(own_slots(batch.column(2).flatten().to_numpy()), minlength=1 << COUNTER_BITS)
            hashes = mixed(batch.column(1).to_numpy(zero_copy_only=False).view("uint64"), 11)
            for i in np.flatnonzero(hashes < least).tolist():
                kept.append((int(hashes[i]), batch.column(2)[i].as_py()))
            if len(kept) > 2 * TASK_SAMPLE:
                kept = sorted(kept, key=lambda x: x[0])[:TASK_SAMPLE]
                least = np.uint64(kept[-1][0])
            nothing = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), nothing, nothing, pa.nulls(n, lists_of)], names)
        used = np.flatnonzero(own)
        if len(used):
            slots, counts = np.append(used, -1), np.append(own[used], n_sets)
            n = len(slots)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, kind), pa.nulls(n, pa.int64()), pa.array(slots), pa.array(counts), pa.nulls(n, lists_of)], names)
            kept = sorted(kept, key=lambda x: x[0])[:TASK_SAMPLE]
            n = len(kept)
            # Slot -2: the sample, with its hashes (one bit less, to stay positive) in place of counts.
            yield pa.RecordBatch.from_arrays([pa.nulls(n, kind), pa.nulls(n, pa.int64()), pa.array([-2] * n, pa.int64()), pa.array([h >> 1 for h, _ in kept], pa.int64()), pa.array([x for _, x in kept], lists_of)], names)

    kind = dict(sets.dtypes)[key]
    found = checkpointed(sets.select(key, "fp", "items").mapInArrow(run, f"`{key}` {kind}, fp bigint, slot bigint, n bigint, items array<bigint>"))
    table = np.zeros(1 << COUNTER_BITS, "int64")
    sums = found.where("slot >= -1").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most 2**COUNTER_BITS + 1 rows
    slots, counts = sums["slot"].to_numpy(), sums["n"].to_numpy()
    table[slots[slots >= 0]] = counts[slots >= 0]
    few = found.where("slot = -2").groupBy("n").agg(F.first("items").alias("items")).orderBy("n").limit(SAMPLE).select("items").toArrow()["items"].to_pylist()
    sample = np.array([x for items in few for x in items], "int64"), np.cumsum([0, *map(len, few)])
    return Survey(found.where("fp is not null").select(key, "fp").distinct(), table, int(counts[slots == -1].sum()), sample)


def weights_of(table, power: float = 1.0, share: float = 0.2):
    """Weights of the counters: all alike up to the frequency that ``share`` of occurrences don't pass."""
    import numpy as np

    used = np.sort(table[table > 0]).astype("float64")
    if not len(used):
        return np.ones(len(table))
    least = used[np.searchsorted(np.cumsum(used), share * used.sum())]
    return np.maximum(table, least) ** -power


def mixed(x, seed: int):
    """splitmix64 of ``x + seed``, vectorised."""
    import numpy as np

    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def combined(keys, values):
    """Hashes of keys and a value of each."""
    import numpy as np

    with np.errstate(over="ignore"):
        return mixed(keys * np.uint64(3) + values, 1)


def own_slots(values):
    """The counter of each value."""
    import numpy as np

    return (mixed(values.view("uint64"), 7) & np.uint64((1 << COUNTER_BITS) - 1)).astype("int64")


class Sets:
    """Sets ``values[starts[i]:starts[i + 1]]``, and their first values in the orders of bands."""

    def __init__(self, values, starts, weights):
        import numpy as np

        self.values, self.starts, self.weights = values, np.asarray(starts), weights
        self.unique, self.at = np.unique(values, return_inverse=True)
        self.own = self.unique.view("uint64")
        self.rate = weights[own_slots(self.unique)]

    def sizes(self):
        import numpy as np

        return np.diff(self.starts)

    def ranks(self, band: int):
        """(rank of each occurrence in the order of ``band``, the unique values in that order)."""
        import numpy as np

        u = ((mixed(self.own, band) >> np.uint64(11)).astype("float64") + 0.5) * 2.0**-53
        order = np.argsort(-np.log(u) / self.rate, kind="stable")
        rank = np.empty(len(order), "int32")
        rank[order] = np.arange(len(order), dtype="int32")
        return rank[self.at], order

    def keys(self, band: int, rows: int):
        """(the key of each set in ``band``; which occurrences it was made of)."""
        import numpy as np

        ranks, order = self.ranks(band)
        begins, sizes = self.starts[:-1], self.sizes()
        labels = np.append(self.own[order], np.uint64(0))  # the last stands for a value that a short set doesn't have
        nothing = np.int32(len(order))
        key = np.full(len(begins), band, "uint64")
        taken = np.zeros(len(ranks), bool)
        for row in range(rows):
            first = np.minimum.reduceat(ranks, begins)
            key = combined(key, labels[first])
            now = ranks == np.repeat(first, sizes)
            taken |= now
            if row < rows - 1:
                ranks = np.where(now, nothing, ranks)
        return key, taken

    def without(self, taken, which):
        """(the sets ``which`` without the ``taken`` occurrences; those of ``which`` that have others)."""
        import numpy as np

        left = ~taken & np.repeat(which, self.sizes())
        sizes = np.add.reduceat(left, self.starts[:-1])
        some = np.flatnonzero(sizes)
        return Sets(self.values[left], np.concatenate([[0], np.cumsum(sizes[some])]), self.weights), some

    def sketches(self):
        """Two 64-bit words for each set, with the bits of its values."""
        import numpy as np

        bit = mixed(self.own, 5) & np.uint64(127)
        one = np.left_shift(np.uint64(1), bit & np.uint64(63))
        out = []
        for half in (0, 1):
            word = np.where((bit >> np.uint64(6)) == half, one, np.uint64(0))
            out.append(np.bitwise_or.reduceat(word[self.at], self.starts[:-1]).view("int64"))
        return out


def further_keys(sets: Sets, band: int, rows: int, keys, which, bands: int):
    """(key, set) of sets ``which`` whose keys of ``band`` are hot: further bands on their other values."""
    import numpy as np

    taken = sets.keys(band, rows)[1]
    rest, some = sets.without(taken, which)
    out = [], []
    if len(some):
        for further in range(bands):
            out[0].append(combined(keys[some], rest.keys(FURTHER + band * 256 + further, 1)[0]))
            out[1].append(some)
    return tuple(np.concatenate(x) if x else np.empty(0, "int64") for x in out)


BAND_ROWS = "band int, key bigint, fp bigint, s0 bigint, s1 bigint, size int"


def _rows_of(bands, keys, fps, sketches, sizes, at):
    """A batch of BAND_ROWS for the sets ``at``."""
    import pyarrow as pa

    columns = [bands, keys.view("int64"), fps[at], sketches[0][at], sketches[1][at], sizes[at].astype("int32")]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["band", "key", "fp", "s0", "s1", "size"])


def hot_keys(survey: Survey, bands: range, rows: int):
    """The band keys that more than HOT sets are expected to have, by the sample; sorted."""
    import numpy as np

    values, starts = survey.sample
    n = len(starts) - 1
    if not n:
        return np.empty(0, "uint64")
    sets, out = Sets(values, starts, weights_of(survey.table)), []
    for band in bands:
        keys, counts = np.unique(sets.keys(band, rows)[0], return_counts=True)
        out.append(keys[(counts >= 20) & (counts * (survey.n_sets / n) > HOT)])
    return np.sort(np.concatenate(out))


def band_rows(sets: DataFrame, survey: Survey, bands: range, rows: int, small: int = 0) -> DataFrame:
    """BAND_ROWS: the keys of every set, each fingerprint once for each task.

    Sets of at most ``small`` values also get a key for each pair of their values: what they share of
    two or more values isn't left to chance.
    """
    shared = sets.sparkSession.sparkContext.broadcast((survey.table, hot_keys(survey, bands, rows)))  # 2 MB, and at most SAMPLE / 20 keys for each band

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        table, hot = shared.value
        weights = weights_of(table)
        seen: set[int] = set()
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            starts = lists.offsets.to_numpy().astype("int64")
            values = lists.values.to_numpy(zero_copy_only=False)
            new = []
            for i, fp in enumerate(fps.tolist()):
                if fp not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(fp)
                    new.append(i)
            if not new:
                continue
            own = Sets(np.concatenate([values[starts[i] : starts[i + 1]] for i in new]), np.concatenate([[0], np.cumsum(np.diff(starts)[new])]), weights)
            fps, sizes, sketches, every = fps[new], own.sizes(), own.sketches(), np.arange(len(new))
            for band in bands:
                keys = own.keys(band, rows)[0]
                is_hot = np.isin(keys, hot) if len(hot) else np.zeros(len(keys), bool)
                at = every[~is_hot]
                yield _rows_of(np.full(len(at), band, "int32"), keys[at], fps, sketches, sizes, at)
                if is_hot.any():
                    more, at = further_keys(own, band, rows, keys, is_hot, len(bands))
                    yield _rows_of(np.full(len(at), FURTHER + band, "int32"), more, fps, sketches, sizes, at)
            few = np.flatnonzero(sizes <= small)
            if len(few):
                extra, owner = [], []
                for i in few:
                    v = own.values[own.starts[i] : own.starts[i + 1]].view("uint64")
                    a, b = np.triu_indices(len(v), 1)
                    extra.append(combined(mixed(np.minimum(v[a], v[b]), 1 << 20), np.maximum(v[a], v[b])))
                    owner.append(np.full(len(a), i))
                at = np.concatenate(owner)
                yield _rows_of(np.full(len(at), PAIRED, "int32"), np.concatenate(extra), fps, sketches, sizes, at)

    return sets.select("fp", "items").mapInArrow(run, BAND_ROWS)


def near(rows, i, j, possible):
    """Which of the pairs (i, j) of ``rows`` (fp, s0, s1, size) can be similar by their sketches."""
    import numpy as np

    s0, s1, size = rows[1].view("uint64"), rows[2].view("uint64"), rows[3]
    a0, a1, b0, b1, na, nb = s0[i], s1[i], s0[j], s1[j], size[i], size[j]
    lacks = lambda x0, x1, y0, y1: np.bitwise_count(x0 & ~y0).astype("int32") + np.bitwise_count(x1 & ~y1)
    most = np.minimum(na - lacks(a0, a1, b0, b1), nb - lacks(b0, b1, a0, a1))
    return possible(most, na, nb)


def pairs_within(rows, begins, sizes, possible):
    """(a, b) arrays of the pairs in groups of ``rows`` sorted by group and fp."""
    import numpy as np

    fps = rows[0]

    def kept(i, j):
        ok = near(rows, i, j, possible)
        return fps[i[ok]], fps[j[ok]]

    for size in np.unique(sizes[sizes > 1]):
        own = begins[sizes == size]
        if size <= 256:
            x, y = np.triu_indices(size, 1)
            step = max(1, AT_ONCE // len(x))
            for s in range(0, len(own), step):
                part = own[s : s + step, None]
                yield kept((part + x).ravel(), (part + y).ravel())
        else:
            step = max(1, AT_ONCE // int(size))
            for b in own:
                for s in range(0, size, step):
                    i, j = np.meshgrid(np.arange(s, min(s + step, size)), np.arange(s + 1, size), indexing="ij")
                    ok = j > i
                    yield kept(b + i[ok], b + j[ok])


def _streamed(possible, columns: list[str]):
    """The function over rows sorted by ``columns``: pairs of a group; rows of groups of more than HOT pass on."""
    most = HOT

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        names = ["a", "b", "band", "key", "fp", "s0", "s1", "size"]

        def found(left, right):
            n = len(left)
            return pa.RecordBatch.from_arrays([pa.array(left), pa.array(right), pa.nulls(n, pa.int32()), *(pa.nulls(n, pa.int64()) for _ in range(4)), pa.nulls(n, pa.int32())], names)

        def passed(t, at):
            n = len(at)
            nothing = pa.nulls(n, pa.int64())
            return pa.RecordBatch.from_arrays([nothing, nothing, *(pa.array(t[c][at]) for c in names[2:])], names)

        def groups(t, hot):
            same = np.ones(len(t["fp"]), bool)
            same[0] = False
            for c in columns:
                same[1:] &= t[c][1:] == t[c][:-1]
            fresh = ~same | np.concatenate([[True], t["fp"][1:] != t["fp"][:-1]])
            starts = np.flatnonzero(~same)
            t, group = {c: x[fresh] for c, x in t.items()}, (np.cumsum(~same) - 1)[fresh]
            sizes = np.bincount(group, minlength=len(starts))
            begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            large = sizes > most
            if hot:
                large[0] = True
            if large.any():
                yield passed(t, np.flatnonzero(large[group]))
            for left, right in pairs_within([t[c] for c in names[4:]], begins[~large], sizes[~large], possible):
                if len(left):
                    yield found(left, right)

        waiting: list[dict] = []
        hot_group = None  # the group that rows were passed on of, as far as it has come
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append({c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names[2:]})
            last = tuple(waiting[-1][c][-1] for c in columns)
            first = tuple(waiting[0][c][0] for c in columns)
            if first != last:
                t = {c: np.concatenate([w[c] for w in waiting]) for c in names[2:]}
                other = np.zeros(len(t["fp"]), bool)
                for c, v in zip(columns, last, strict=True):
                    other |= t[c] != v
                whole = int(np.flatnonzero(other)[-1]) + 1  # the last group may go on in the next batch
                yield from groups({c: x[:whole] for c, x in t.items()}, first == hot_group)
                waiting = [{c: x[whole:] for c, x in t.items()}]
            if last == hot_group or sum(len(w["fp"]) for w in waiting) > 2 * most:
                for w in waiting:
                    yield passed(w, np.arange(len(w["fp"])))
                waiting, hot_group = [], last
        if waiting:
            t = {c: np.concatenate([w[c] for w in waiting]) for c in names[2:]}
            yield from groups(t, tuple(t[c][0] for c in columns) == hot_group)

    return run


FOUND = "a bigint, b bigint, " + BAND_ROWS


def candidates(rows: DataFrame, sets: DataFrame, survey: Survey, bands: range, n_rows: int, possible) -> DataFrame:
    """``a, b, met``: the pairs of fingerprints (a < b) that share a band key and can be similar by
    their sketches, and how many keys they share.

    Rows are sorted within the partitions of the key, groups are read as a stream: see the module.
    """
    def met(of, columns):
        return checkpointed(of.repartition(*columns).sortWithinPartitions(*columns, "fp").mapInArrow(_streamed(possible, columns), FOUND))

    level = met(rows, ["band", "key"])
    found, hot = level.where("b is not null"), level.where("b is null")
    if not hot.isEmpty():
        again = met(banded_again(hot, sets, survey, bands, n_rows), ["band", "key"])
        found, hot = found.unionAll(again.where("b is not null")), again.where("b is null")
        if not hot.isEmpty():
            found = found.unionAll(block_pairs(hot, possible))
    return found.groupBy("a", "b").agg(F.count("*").alias("met"))


def banded_again(hot: DataFrame, sets: DataFrame, survey: Survey, bands: range, n_rows: int) -> DataFrame:
    """BAND_ROWS of hot rows on their sets' other values; rows that were banded again already, and keys
    of pairs of values, stay as they are."""
    shared = sets.sparkSession.sparkContext.broadcast(survey.table)
    own = BAND_ROWS.replace("band int, ", "band int, items array<bigint>, ")

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        weights = weights_of(shared.value)
        for batch in batches:
            band, keys, fps, s0, s1, size = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("band", "key", "fp", "s0", "s1", "size"))
            lists = batch.column(batch.schema.get_field_index("items"))
            done = (band >= FURTHER) | (band == PAIRED)
            at = np.flatnonzero(done)
            if len(at):
                yield _rows_of(band[at], keys[at], fps, (s0, s1), size, at)
            if not done.all():
                offsets = lists.offsets.to_numpy().astype("int64")
                some = Sets(lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0], weights)
                for b in np.unique(band[~done]).tolist():
                    more, at = further_keys(some, b, n_rows, keys.view("uint64"), band == b, len(bands))
                    yield _rows_of(np.full(len(at), FURTHER + b, "int32"), more, fps, (s0, s1), size, at)

    wanted = sets.join(hot.select("fp").distinct(), "fp", "left_semi").groupBy("fp").agg(F.first("items").alias("items"))
    return hot.drop("a", "b").join(wanted, "fp").select(*(x.split()[0] for x in own.split(", "))).mapInArrow(run, BAND_ROWS)


def block_pairs(hot: DataFrame, possible) -> DataFrame:
    """As FOUND: all pairs of hot keys, as pairs of blocks of about BLOCK sets, each a group of its own."""
    n = hot.groupBy("band", "key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), "blocks").cast("int")
    each = hot.drop("a", "b").join(n, ["band", "key"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = each.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other"))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for frame in batches:
            rows = [frame[c].to_numpy() for c in ("fp", "s0", "s1", "size")]
            order = np.argsort(rows[0], kind="stable")
            rows, own = [r[order] for r in rows], frame["own"].to_numpy()[order]
            one, two = frame["x"].iloc[0], frame["y"].iloc[0]
            i, j = np.meshgrid(np.flatnonzero(own == one), np.flatnonzero(own == two), indexing="ij")
            i, j = i.ravel(), j.ravel()
            if one == two:
                ok = rows[0][i] < rows[0][j]
                i, j = i[ok], j[ok]
            ok = near(rows, i, j, possible)
            a, b = rows[0][i[ok]], rows[0][j[ok]]
            ok = a != b
            yield pd.DataFrame({"a": np.minimum(a, b)[ok], "b": np.maximum(a, b)[ok]})

    met = placed.groupBy("band", "key", "x", "y").applyInPandas(lambda frame: next(run(iter([frame]))), "a bigint, b bigint")
    nothing = [F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in BAND_ROWS.split(", ")]
    return met.select("a", "b", *nothing)


def verified(pairs: DataFrame, sets: DataFrame, similarity: Column) -> DataFrame:
    """The pairs for which ``similarity`` (an expression of shared, size_a, size_b) is not null, with it
    as ``sim``, on the full sets of both sides."""
    # Sorted by fp, as the joins want it too; copies are dropped in each task before the shuffle.
    unique = sets.groupBy("fp").agg(F.first("items").alias("items"))
    left = pairs.join(unique.select(F.col("fp").alias("a"), F.col("items").alias("items_a")), "a")
    both = left.join(unique.select(F.col("fp").alias("b"), F.col("items").alias("items_b")), "b")
    shared = both.select(
        *pairs.columns, F.size(F.array_intersect("items_a", "items_b")).alias("shared"), F.size("items_a").alias("size_a"), F.size("items_b").alias("size_b")
    )
    return shared.select(*pairs.columns, similarity.alias("sim")).where("sim is not null")


def missed_share(pairs: DataFrame) -> float:
    """The share of pairs that met in no band, estimated from those that met in one and in two."""
    one, two, n = pairs.agg(F.count_if(F.col("met") == 1), F.count_if(F.col("met") == 2), F.count("*")).first()
    missed = one * (one - 1) / (2 * (two + 1))
    return missed / (n + missed) if n else 0.0


def similar_classes(sets: DataFrame, key: str, similarity: Similarity, weighted: float, recall: float, small: int = 0) -> tuple[DataFrame, DataFrame]:
    """(``key, fp``: the class of each row; ``a, b, sim``: the similar pairs of classes), both stored.

    ``weighted``: the weighted similarity that the first round's bands are made for. Rounds of as many
    bands follow until the estimated share of missed pairs is at most 1 - ``recall``.
    """
    survey = surveyed(sets, key)
    n_rows = rows_for(survey.table, survey.n_sets)
    n_bands = bands_for(weighted, recall, n_rows)
    found = None
    for i in range(ROUNDS):
        bands = range(i * n_bands, (i + 1) * n_bands)
        met = candidates(band_rows(sets, survey, bands, n_rows, 0 if i else small), sets, survey, bands, n_rows, similarity.possible)
        now = checkpointed(verified(met, sets, similarity.column))
        found = now if found is None else checkpointed(found.unionAll(now).groupBy("a", "b").agg(F.sum("met").alias("met"), F.first("sim").alias("sim")))
        if missed_share(found) <= 1 - recall:
            break
    return survey.members, found.select("a", "b", "sim")

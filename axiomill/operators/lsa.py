"""Latent semantic vectors: training, projection, nearest neighbours and distance thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axiomill.operators.search import SMALL, looked_up
from axiomill.session import checkpointed

#: Singular values kept, weight and floor of term correlations.
RANK, CORRELATION_WEIGHT, CORRELATION_FLOOR = 35, 0.05, 0.5
#: Vectors shorter than this are left out; factor of the mean distance.
NEAR_ZERO, THRESHOLD_FACTOR = 1e-4, 1.5
#: Queries of a block and vectors of a chunk.
BLOCK, CHUNK = 512, 4096
#: Products of pairs that are added up at a time; parts of a matrix whose sums go straight to the driver, and entries of a part.
PAIRS, PARTS, PART = 1 << 22, 5, 1 << 22
#: Statements that are worked on at a time.
SLICE = 1024


def distance2(a: Column, b: Column) -> Column:
    """The squared Euclidean distance of two arrays of numbers."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def norm2(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x)


def blocks(vectors: DataFrame, key: str, size: int, name: str) -> DataFrame:
    """``name``: about ``size`` vectors in each row, by a hash of the key."""
    n = max(1, -(-vectors.count() // size))
    part = F.pmod(F.xxhash64(key), F.lit(n))
    return vectors.groupBy(part.alias("_part")).agg(F.collect_list(F.struct(F.col(key).cast("bigint").alias("id"), F.col("embedding").cast("array<double>").alias("v"))).alias(name)).drop("_part")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, vec_id, dist2, rn``: the k nearest vectors of each query (Euclidean), ties to the
    smaller id. ``vectors(vec_id, embedding)``, ``queries(query_id, embedding)``.

    Exact, for a stated set of queries: blocks of queries meet chunks of vectors, each pair is one
    matrix product and passes on k rows for each query.
    """
    kept = vectors.where(norm2(F.col("embedding")) > NEAR_ZERO**2).select("vec_id", "embedding")
    pairs = blocks(queries, "query_id", BLOCK, "q").crossJoin(blocks(kept, "vec_id", CHUNK, "c"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def matrix(rows):
            return rows.field(0).to_numpy(zero_copy_only=False), rows.field(1).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)

        for batch in batches:
            for left, right in zip(batch.column(0), batch.column(1), strict=True):
                (ids, q), (keys, v) = matrix(left.values), matrix(right.values)
                # One matrix product tells which may be nearest; their distances are then exact.
                rough = (v * v).sum(axis=1) - 2 * (q @ v.T)
                n = min(k, len(keys))
                slack = 1e-9 * (1 + np.abs(rough).max(initial=0.0))
                bound = np.partition(rough, n - 1, axis=1)[:, n - 1] + slack
                out = []
                for i in range(len(ids)):
                    some = np.flatnonzero(rough[i] <= bound[i])
                    d = ((v[some] - q[i]) ** 2).sum(axis=1)
                    best = np.lexsort((keys[some], d))[:k]
                    near = some[best]
                    out.append((np.full(len(near), ids[i]), keys[near], d[best]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[n] for o in out])) for n in range(3)], ["query_id", "vec_id", "dist2"])

    found = pairs.mapInArrow(run, "query_id bigint, vec_id bigint, dist2 double")
    order = Window.partitionBy("query_id").orderBy("dist2", "vec_id")
    return found.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k)


def threshold(pairs: DataFrame) -> DataFrame:
    """``threshold``: 1.5 times the mean distance of sample pairs (``a``, ``b`` arrays)."""
    return pairs.agg((F.avg(F.sqrt(distance2(F.col("a"), F.col("b")))) * THRESHOLD_FACTOR).alias("threshold"))


def listed(entries: DataFrame) -> DataFrame:
    """``thm_id, indices, weights``: the entries of each statement by rising ``word_idx``, as two lists."""
    rows = entries.groupBy("thm_id").agg(F.array_sort(F.collect_list(F.struct(F.col("word_idx").cast("int").alias("i"), F.col("weight").cast("double").alias("w")))).alias("e"))
    return rows.select("thm_id", F.col("e.i").alias("indices"), F.col("e.w").alias("weights"))


def unlisted(lists: DataFrame) -> DataFrame:
    """``thm_id, word_idx, weight``."""
    each = lists.select("thm_id", F.explode(F.arrays_zip("indices", "weights")).alias("e"))
    return each.select("thm_id", F.col("e.indices").alias("word_idx"), F.col("e.weights").alias("weight"))


def weighted(lists: DataFrame, weights: DataFrame) -> DataFrame:
    """``thm_id, indices, weights`` of ``lists(thm_id, indices)``, by ``weights(word_idx, weight)``, which the driver holds as it holds V."""
    import numpy as np

    known = weights.select("word_idx", "weight").toPandas()
    of = np.zeros(int(known["word_idx"].max()) + 1 if len(known) else 0)
    of[known["word_idx"]] = known["weight"]
    shared = lists.sparkSession.sparkContext.broadcast(of)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            indices = batch.column("indices")
            found = shared.value[indices.flatten().to_numpy(zero_copy_only=False)]
            offsets = indices.offsets.to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("thm_id"), indices, pa.ListArray.from_arrays(pa.array(offsets - offsets[0]), pa.array(found))], ["thm_id", "indices", "weights"])

    return lists.select(F.col("thm_id").cast("bigint").alias("thm_id"), F.col("indices").cast("array<int>").alias("indices")).mapInArrow(run, "thm_id bigint, indices array<int>, weights array<double>")


def correlated(entries: DataFrame, n_rows: int) -> DataFrame:
    """``i, j, c``: correlations of different terms of at least 0.5, from sparse sums. A term of the
    same weight everywhere has none. ``entries`` as they are, or listed.

    Products of pairs are added up in the task; a pair whose terms' own sums bound its correlation
    below 0.5 is left out before that. The sums of each term are on the driver, as V is.
    """
    import numpy as np

    lists = entries if "indices" in entries.columns else listed(entries)
    w = F.col("weight")
    sums = unlisted(lists).groupBy("word_idx").agg(F.sum("weight").alias("s"), F.sum(w * w).alias("ss"), F.max(F.abs(w)).alias("m"), F.count("*").alias("n")).toPandas()
    n_terms = int(sums["word_idx"].max()) + 1 if len(sums) else 0
    s, ss, m, n = (np.zeros(n_terms) for _ in range(4))
    for to, name in ((s, "s"), (ss, "ss"), (m, "m"), (n, "n")):
        to[sums["word_idx"]] = sums[name]
    v = ss - s**2 / n_rows
    # Below this share of the sum of squares the variance is a rounding error.
    varied = v > ss * 1e-12
    deviation = np.sqrt(np.where(varied, v, 1.0))
    # The product sum of i and j is at most sqrt(ss of i) * sqrt(n of i) * m of j.
    share = np.array([np.sqrt(ss * n) / deviation, m / deviation, s / deviation / np.sqrt(n_rows)])
    shared = lists.sparkSession.sparkContext.broadcast((share, varied))

    def run(batches):
        import pyarrow as pa

        (a, b, mean), able = shared.value
        keys, products, waiting = [], [], 0

        def added():
            key, product = np.concatenate(keys), np.concatenate(products)
            order = np.argsort(key, kind="stable")
            key, product = key[order], product[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            return key[first], np.add.reduceat(product, first)

        def sent(key, product):
            return pa.RecordBatch.from_arrays([pa.array((key // n_terms).astype(np.int32)), pa.array((key % n_terms).astype(np.int32)), pa.array(product)], ["i", "j", "p"])

        for batch in (whole.slice(at, SLICE) for whole in batches for at in range(0, len(whole), SLICE)):
            idx, weight = (batch.column(x).flatten().to_numpy(zero_copy_only=False) for x in ("indices", "weights"))
            size = np.diff(batch.column("indices").offsets.to_numpy())
            end = np.repeat(np.cumsum(size), size)
            ea, eb, em = a[idx], b[idx], mean[idx]
            at, d = np.flatnonzero(able[idx]), 1
            while len(at := at[at + d < end[at]]):
                to = at + d
                most = np.minimum(ea[at] * eb[to], ea[to] * eb[at]) - em[at] * em[to]
                x = np.flatnonzero((most >= CORRELATION_FLOOR - 1e-9) & able[idx[to]])
                i, j = at[x], to[x]
                keys.append(idx[i].astype(np.int64) * n_terms + idx[j])
                products.append(weight[i] * weight[j])
                waiting, d = waiting + len(x), d + 1
            if waiting > PAIRS:
                key, product = added()
                if len(key) > PAIRS // 2:
                    yield sent(key, product)
                    keys, products, waiting = [], [], 0
                else:
                    keys, products, waiting = [key], [product], len(key)
        if waiting:
            yield sent(*added())

    products = lists.select("indices", "weights").mapInArrow(run, "i int, j int, p double").groupBy("i", "j").agg(F.sum("p").alias("p"))

    def scored(batches):
        import pyarrow as pa

        for batch in batches:
            i, j, p = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("i", "j", "p"))
            c = (p - s[i] * s[j] / n_rows) / np.sqrt(v[i] * v[j])
            kept = np.flatnonzero(c >= CORRELATION_FLOOR)
            yield pa.RecordBatch.from_arrays([pa.array(i[kept]), pa.array(j[kept]), pa.array(c[kept])], ["i", "j", "c"])

    return products.mapInArrow(scored, "i int, j int, c double")


def spread(entries: DataFrame, correlations: DataFrame) -> DataFrame:
    """Entries m + 0.05 C m."""
    sym = looked_up(correlations.select("i", "j", "c").unionAll(correlations.select(F.col("j").alias("i"), F.col("i").alias("j"), "c")))
    more = entries.withColumnRenamed("word_idx", "j").join(sym, "j").select("thm_id", F.col("i").alias("word_idx"), (F.col("weight") * F.col("c") * CORRELATION_WEIGHT).alias("weight"))
    return entries.select("thm_id", "word_idx", "weight").unionByName(more).repartition("thm_id").groupBy("thm_id", "word_idx").agg(F.sum("weight").alias("weight"))


def spread_lists(lists: DataFrame, correlations: DataFrame) -> DataFrame:
    """As :func:`spread`, of listed entries; up to ``SMALL`` correlations meet each row where it is."""
    import numpy as np

    if correlations.count() > SMALL:
        return listed(spread(unlisted(lists), correlations))
    one = correlations.toPandas()
    i, j = (np.r_[one[a], one[b]].astype(np.int64) for a, b in ("ij", "ji"))
    order = np.argsort(i, kind="stable")
    shared = lists.sparkSession.sparkContext.broadcast((i[order], j[order], np.r_[one["c"], one["c"]][order] * CORRELATION_WEIGHT))

    def run(batches):
        import pyarrow as pa

        of, to, c = shared.value
        for batch in batches:
            idx, weight = (batch.column(x).flatten().to_numpy(zero_copy_only=False) for x in ("indices", "weights"))
            row = np.repeat(np.arange(len(batch)), np.diff(batch.column("indices").offsets.to_numpy()))
            first = np.searchsorted(of, idx)
            n = np.searchsorted(of, idx, "right") - first
            at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
            row, idx, weight = np.r_[row, np.repeat(row, n)], np.r_[idx, to[at]], np.r_[weight, np.repeat(weight, n) * c[at]]
            order = np.lexsort((idx, row))
            row, idx, weight = row[order], idx[order], weight[order]
            heads = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (idx[1:] != idx[:-1])][: len(row)])
            offsets = pa.array(np.searchsorted(row[heads], np.arange(len(batch) + 1)).astype(np.int32))
            summed = np.add.reduceat(weight, heads) if len(heads) else weight
            yield pa.RecordBatch.from_arrays([batch.column("thm_id"), pa.ListArray.from_arrays(offsets, pa.array(idx[heads].astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(summed))], ["thm_id", "indices", "weights"])

    return lists.mapInArrow(run, "thm_id bigint, indices array<int>, weights array<double>")


def trained(entries: DataFrame, n_terms: int, rank: int = RANK):
    """(U as ``thm_id, vector``; singular values; V): a truncated SVD by distributed Lanczos steps.

    V has ``n_terms`` x ``rank`` numbers and lives on the driver; ``n_terms`` is the vocabulary. Every
    step reads all rows, so they are kept as vectors in the executors. ``entries`` as they are, or listed.
    """
    import numpy as np
    from pyspark import StorageLevel
    from pyspark.mllib.linalg import VectorUDT
    from pyspark.mllib.linalg.distributed import IndexedRowMatrix
    from pyspark.sql.types import StructField, StructType

    lists = entries if "indices" in entries.columns else checkpointed(listed(entries))
    n = lists.agg(F.coalesce(F.sum(F.size("indices")), F.lit(0))).first()[0]
    # Sums of so few parts go to the driver without a shuffle in each step.
    parts = max(PARTS, -(-n // PART))
    # A vector's fields as JSON are read as one, so that no row passes through Python.
    vector = F.struct(F.lit(0).alias("type"), F.lit(n_terms).alias("size"), "indices", F.col("weights").alias("values"))
    made = F.from_json(F.to_json(F.struct(vector.alias("vector"))), StructType([StructField("vector", VectorUDT())]))
    matrix = IndexedRowMatrix(lists.coalesce(parts).select(F.col("thm_id").cast("bigint").alias("index"), made["vector"].alias("vector")), numCols=n_terms)
    sc = entries.sparkSession.sparkContext
    kept = matrix._java_matrix_wrapper._java_model.rows().persist(sc._getJavaStorageLevel(StorageLevel.MEMORY_AND_DISK))
    svd = matrix.computeSVD(min(rank, n_terms), computeU=False)
    kept.unpersist(False)
    s, v = np.array(svd.s.toArray()), np.array(svd.V.toArray())
    return projected(lists, s, v), s, v


def projected(entries: DataFrame, singular, v) -> DataFrame:
    """``thm_id, vector``: new statements in the space of a model, D^-1 V^T m. ``entries`` as they are, or listed."""
    import numpy as np

    shared = entries.sparkSession.sparkContext.broadcast(np.asarray(v) / np.asarray(singular))

    def run(batches):
        import pyarrow as pa

        w = np.ascontiguousarray(shared.value)
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                some = batch.slice(at, SLICE)
                idx, weight = (some.column(x).flatten().to_numpy(zero_copy_only=False) for x in ("indices", "weights"))
                sizes = np.diff(some.column("indices").offsets.to_numpy())
                out = np.add.reduceat(w[idx] * weight[:, None], np.cumsum(sizes) - sizes, axis=0)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * w.shape[1]), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([some.column("thm_id"), lists], ["thm_id", "vector"])

    rows = entries if "indices" in entries.columns else listed(entries)
    return rows.select(F.col("thm_id").cast("bigint").alias("thm_id"), "indices", "weights").mapInArrow(run, "thm_id bigint, vector array<double>")

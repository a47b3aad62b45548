import random
import re
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from axiomill.llm import near_duplicates, neighbours
from axiomill.llm import sets as S
from axiomill.llm.components import components


def texts(n=900, seed=2):
    rng = random.Random(seed)
    rare = [f"w{i}" for i in range(1200)]
    out = []
    for i in range(n):
        if out and rng.random() < 0.4:
            words = rng.choice(out).split()
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(rare)
            rng.shuffle(words)
        else:
            words = ["the", "of", "a", "is"] + rng.sample(rare, rng.randint(6, 14))
        out.append(" ".join(words))
    return out


def jaccard_pairs(values, tenths):
    sets = [set(re.findall("[a-z0-9]+", v.lower())) if v else set() for v in values]
    return {(i, j) for i, j in combinations(range(len(values)), 2) if sets[i] and sets[j] and len(sets[i] & sets[j]) * 10 >= len(sets[i] | sets[j]) * tenths}


def test_pairs_equal_brute_force(spark):
    values = texts() + ["The OF, a-is w1 w2", "the of a is W2 w1!", None, "", "...", None]
    rows = spark.createDataFrame([(i, v, "x", 1) for i, v in enumerate(values)], "id int, thm string, fp string, sim int")
    rows = rows.unionAll(rows.limit(50))  # repeated rows
    got = {(r["a"], r["b"]) for r in near_duplicates.pairs(rows, "id", "thm").collect()}
    want = jaccard_pairs(values, 7)
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) > 400


def test_groups(spark):
    values = ["a b c d e", "a b c d e", "a b c d e f", "x y z", None, "b c d e f"]
    rows = spark.createDataFrame(list(enumerate(values)), "id int, thm string")
    got = {r["id"]: (r["group_id"], r["n_links"]) for r in near_duplicates.groups(rows, "id", "thm").collect()}
    assert got == {0: (0, 1), 1: (0, 1), 2: (0, 2), 3: (3, 0), 5: (0, 1)}


def band(spark, sets):
    """BAND_ROWS of one band in which all ``sets`` (fp -> values) have one key, the sets, and their survey."""
    rows = spark.createDataFrame([(fp, fp, v) for fp, v in sets.items()], "id bigint, fp bigint, items array<bigint>")
    survey = S.surveyed(rows, "id")
    own = S.Sets(np.array([x for v in sets.values() for x in v], "int64"), np.cumsum([0, *map(len, sets.values())]), S.weights_of(survey.table))
    s0, s1 = own.sketches()
    out = [(0, 77, fp, int(a), int(b), len(v)) for (fp, v), a, b in zip(sets.items(), s0, s1, strict=True)]
    return spark.createDataFrame(out, S.BAND_ROWS), rows, survey


def anything():
    return near_duplicates.jaccard_at_least(0).possible


def test_a_band_loses_no_pair(spark):
    sets = {fp: [1, 2, 1000 + fp] for fp in range(-200, 137)}
    rows, of, survey = band(spark, sets)
    got = {(r["a"], r["b"]): r["met"] for r in S.candidates(rows.unionAll(rows.limit(9)), of, survey, range(1), 1, anything()).collect()}
    assert got == dict.fromkeys(combinations(sets, 2), 1)


def test_hot_bands_are_banded_again_and_then_split_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT", 100)
    monkeypatch.setattr(S, "BLOCK", 50)
    rng = random.Random(6)
    families = [rng.sample(range(100, 2000), 9) for _ in range(60)]
    sets = {i: [1, *rng.choice(families), 5000 + i] for i in range(700)}
    rows, of, survey = band(spark, sets)
    similar = near_duplicates.jaccard_at_least(7).possible
    want = {(i, j) for i, j in combinations(sets, 2) if len(set(sets[i]) & set(sets[j])) * 10 >= len(set(sets[i]) | set(sets[j])) * 7}
    got = {(r["a"], r["b"]) for r in S.candidates(rows, of, survey, range(12), 1, similar).collect()}
    assert len(want) > 1000 and len(got & want) >= 0.99 * len(want)
    alike = {i: [1, 2, 3, 4 + i % 2] for i in range(330)}  # sets that no band can tell apart
    rows, of, survey = band(spark, alike)
    hot = rows.withColumn("band", F.lit(S.FURTHER)).select(F.lit(None).cast("bigint").alias("a"), F.lit(None).cast("bigint").alias("b"), *rows.columns)
    assert {(r["a"], r["b"]) for r in S.block_pairs(hot, anything()).collect()} == set(combinations(alike, 2))


def test_a_band_of_very_many_sets_runs_in_several_tasks(spark):
    """10**5 sets have one value in common, which comes first in a tenth of them: 50,000 pairs."""
    family = F.pmod("id", F.lit(50_000))
    rows = spark.range(100_000).select("id", F.xxhash64("id").alias("fp"), F.array(F.lit(1).cast("bigint"), *((family * 31 + i * 7_000_003).cast("bigint") for i in range(8)), F.col("id") + 10**12).alias("items"))
    survey = S.surveyed(rows, "id")
    assert survey.n_sets == 100_000 and len(survey.sample[1]) == 4 * S.TASK_SAMPLE + 1
    survey.table[:] = 1  # all orders alike
    plain = S.band_rows(rows, survey, range(8), 1)
    assert len(S.hot_keys(survey, range(8), 1)) and plain.where(F.col("band") >= S.FURTHER).count()
    found = S.candidates(plain, rows, survey, range(8), 1, near_duplicates.jaccard_at_least(7).possible)
    assert found.count() >= 0.99 * 50_000
    assert found.rdd.getNumPartitions() > 1


def test_sketches_never_dismiss_a_similar_pair(spark):
    rng = np.random.default_rng(1)
    sets = [rng.choice(300, rng.integers(1, 200), replace=False).astype("int64") for _ in range(120)]
    own = S.Sets(np.concatenate(sets), np.cumsum([0, *map(len, sets)]), np.ones(1 << S.COUNTER_BITS))
    rows = [np.arange(120), *own.sketches(), own.sizes()]
    i, j = np.triu_indices(120, 1)
    shared = np.array([len(set(sets[x]) & set(sets[y])) for x, y in zip(i, j)])
    for limit in (near_duplicates.jaccard_at_least(7).possible, near_duplicates.jaccard_at_least(3).possible, neighbours.squared_cosine().possible):
        is_similar = limit(shared, own.sizes()[i], own.sizes()[j])
        assert not (is_similar & ~S.near(rows, i, j, limit)).any()


def test_more_bands_follow_where_too_many_pairs_met_once(spark):
    values = texts()
    rows = spark.createDataFrame(list(enumerate(values)), "id int, thm string")
    sets = S.as_sets(rows, "id", "thm")
    _, few = S.similar_classes(sets, "id", near_duplicates.jaccard_at_least(7), 0.999, 0.99)  # bands far too few for the limit
    want = {p for p in jaccard_pairs(values, 7) if set(values[p[0]].split()) != set(values[p[1]].split())}
    assert few.count() >= 0.97 * len({frozenset((frozenset(values[a].split()), frozenset(values[b].split()))) for a, b in want})


def nearest(lists, k):
    sets = {i: set(v) - {None} for i, v in lists.items() if v}
    out = set()
    for i, a in sets.items():
        best = sorted((-(len(a & b) ** 2) / (len(a) * len(b)), j) for j, b in sets.items() if j != i and a and b and 4 * len(a & b) ** 2 >= len(a) * len(b))
        out |= {(min(i, j), max(i, j)) for _, j in best[:k]}
    return out


def test_neighbours_equal_brute_force(spark):
    rng = random.Random(4)
    lists = {}
    for i in range(250):
        base = list(lists[rng.randrange(i)] or []) if i and rng.random() < 0.5 else rng.sample(range(500), rng.randint(1, 15))
        for _ in range(rng.randint(0, 4)):
            if base and rng.random() < 0.5:
                base.pop()
            else:
                base.append(rng.randrange(500))
        lists[i] = base
    lists |= {900: None, 901: [], 902: [None], 903: [7, 7, None], 904: [7], 905: [7]} | {910 + i: [1, 2, 3] for i in range(12)}
    rows = spark.createDataFrame([(i, v, "x") for i, v in lists.items()], "id int, ids array<int>, other string")
    rows = rows.unionAll(rows.limit(40))
    got = {(r["a"], r["b"]) for r in neighbours.neighbour_pairs(rows, "id", "ids").collect()}
    want = nearest(lists, 5)
    assert len(got & want) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(want)


def test_empty_tables(spark):
    assert near_duplicates.pairs(spark.createDataFrame([], "id int, thm string"), "id", "thm").count() == 0
    assert near_duplicates.groups(spark.createDataFrame([], "id int, thm string"), "id", "thm").count() == 0
    assert neighbours.neighbours(spark.createDataFrame([], "id int, ids array<int>"), "id", "ids").count() == 0
    only = spark.createDataFrame([(1, None), (None, "a b")], "id int, thm string")
    assert near_duplicates.pairs(only, "id", "thm").count() == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame([*edges, (None, 3)], "a int, b int")).collect()}
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_bands_depend_on_the_set_alone():
    weights = np.ones(1 << S.COUNTER_BITS)
    values = np.array([5, 9, 12, 5, 9, 12, 40, 3], "int64")
    many, alone = S.Sets(values, np.array([0, 3, 6, 8]), weights), S.Sets(values[3:6], np.array([0, 3]), weights)
    for b in range(6):
        keys, taken = many.keys(b, 2)
        assert keys[0] == keys[1] == alone.keys(b, 2)[0][0] != keys[2]
        assert taken.reshape(-1)[:3].sum() == 2 and (taken[:3] == taken[3:6]).all()
    assert S.bands_for(0.5, 0.99) == 17
    assert S.rows_for(np.full(1000, 10), 1000) == 1 and S.rows_for(np.full(1000, 10), 10**6) == 2


def test_lists_that_share_one_frequent_id(spark):
    lists = {i: [1, 100 + i] for i in range(300)} | {1000 + i: [1] for i in range(3)} | {2000 + i: [1, 2, 3, 3000 + i] for i in range(20)}
    rows = spark.createDataFrame(list(lists.items()), "id int, ids array<int>")
    got = {(r["a"], r["b"]) for r in neighbours.neighbour_pairs(rows, "id", "ids").collect()}
    assert got == nearest(lists, 5)


def test_measuring_projections():
    from axiomill.llm import projections as P

    assert abs(P.chi_square_cdf(3.841459, 1) - 0.95) < 1e-6 and abs(P.chi_square_quantile(0.9, 16) - 23.5418) < 1e-3
    rng = random.Random(3)
    lists = [set(rng.sample(range(400), 12)) for _ in range(300)]
    lists += [set(list(s)[:10]) | {1000 + i} for i, s in enumerate(lists[:100])] + [set()]
    queries = list(range(0, 401, 4))
    sure = P.measured(lists, queries, 16, 0.999999)
    assert sure.recall == 1.0 and 0 < sure.share_without < 1
    loose = P.measured(lists, queries, 32, 0.9)
    assert loose.recall > 0.8 and loose.with_neighbour < sure.with_neighbour


def test_possible_similarity_of_long_lists(spark):
    # shared² · 4 and size_a · size_b are beyond 32 bits.
    shared, size = np.array([23_171, 30_000, 24_999], "int32"), np.array([24_000, 60_000, 50_000], "int32")
    assert neighbours.squared_cosine().possible(shared, size, size).tolist() == [True, True, False]


def test_neighbours_of_long_lists(spark):
    base = list(range(24_000))
    rows = spark.createDataFrame([(1, base), (2, base[:20_000] + list(range(90_000, 94_000)))], "id int, ids array<int>")
    assert [tuple(r) for r in neighbours.neighbour_pairs(rows, "id", "ids").collect()] == [(1, 2)]

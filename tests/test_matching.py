"""Pairs of queries and statements in arrays against the same as rows."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from axiomill.operators import index, matching, ngrams, search, vocabulary
from axiomill.plans import searching

DATA = "/root/testdata/sf0.001"
TOKENS = "query_id string, word string, pos int, n int, score bigint, rank int"
POSTINGS = "word string, thm_id int, part string, positions array<int>"


def same(a, b):
    return sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(a.columns).collect()))


@pytest.fixture(scope="module")
def given(spark):
    rng = random.Random(5)
    words = ["ring", "field", "flat", "ring map", "flat ring map", "a b"]
    tokens = [(f"q{q}", w, rng.randrange(4), len(w.split()), rng.randint(1, 9), r + 1) for q in range(40) for r, w in enumerate(rng.sample(words, rng.randint(1, 6)))]
    postings = [(w, d, rng.choice("TH"), sorted(rng.sample(range(12), rng.randrange(4)))) for d in range(90) for w in words if rng.random() < 0.5]
    return spark.createDataFrame(tokens, TOKENS), spark.createDataFrame(postings, POSTINGS)


def test_scores_of_all_pairs(given):
    assert same(matching.scores(*given), search.intersection(search.hits(*given)))


def test_distances_of_all_pairs(given):
    assert same(matching.word_distances(*given), search.word_distance(search.hits(*given)))


@pytest.mark.parametrize(("make", "rows"), [(matching.scores, search.intersection), (matching.word_distances, search.word_distance)])
def test_all_pairs_of_chunks_and_blocks(given, monkeypatch, make, rows):
    """All pairs are the same in one task and shared among several by queries and statements; a query's leave it in one row."""
    n = given[1].count()
    for name, value in (("SENT", 4), ("BLOCK", n // 2), ("TASKS", 9), ("LEAST", 4)):
        monkeypatch.setattr(matching, name, value, raising=False)
    found = make(*given)
    assert same(found, rows(search.hits(*given)))
    assert "posexplode" in found._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]


def test_the_best_by_both_stages(given):
    hits = search.hits(*given)
    assert same(search.ranked(*given, nearest=7, cap=20), search.two_stage(search.intersection(hits), hits, 7, 20))


def test_the_best_by_distance(given):
    want = {}
    for r in search.word_distance(search.hits(*given)).collect():
        want.setdefault(r["query_id"], []).append((-r["dist"], r["thm_id"]))
    got = {(r["query_id"], r["rn"]): (-r["dist"], r["thm_id"]) for r in matching.best_distances(*given, 5).collect()}
    assert got == {(q, i + 1): v for q, found in want.items() for i, v in enumerate(sorted(found)[:5])}


def test_blocks_are_put_together(given, monkeypatch):
    """Of several blocks of statements, as of one."""
    import pyarrow as pa

    rows = {}
    for size in (1, 1 << 19):
        monkeypatch.setattr(matching, "BLOCK", size)
        run = matching.meeting(matching.RANKED, *matching.first_stage(6, 6))
        asked = [[{"query_id": "q", "tokens": [{"w": k, "pos": k, "n": 1, "score": 5 - k, "rank": k, "blanks": 0, "generic": False} for k in range(3)]}]]
        held = [[{"thm_id": d, "w": k, "t": True, "positions": [k]} for d in range(p, 40, 4) for k in range(3) if (d >> k) & 1] for p in range(4)]
        kind = pa.list_(pa.struct([("thm_id", pa.int32()), ("w", pa.int32()), ("t", pa.bool_()), ("positions", pa.list_(pa.int32()))]))
        batch = pa.RecordBatch.from_arrays([pa.array([0] + [1] * 4), pa.array([*asked, *[None] * 4]), pa.array([None, *held], kind)], ["kind", "asked", "held"])
        rows[size] = [tuple(r.values()) for b in run([batch]) for r in b.to_pylist()]
    assert rows[1] == rows[1 << 19] and [r[1] for r in rows[1]] == [7, 15, 23, 31, 39, 3]


def test_only_asked_grams_are_counted(spark):
    rng = random.Random(7)
    line = lambda k: [rng.choice(["ring", "maps", "flat", "fields", "module", "of"]) for _ in range(k)]
    own = spark.createDataFrame([(d, "T", line(12)) for d in range(60)], "thm_id int, part string, words array<string>")
    texts = spark.createDataFrame([("p", "Q", ["flat", "ring", "maps"]), ("p", "Q", ["module", "of", "fields"])], "thm_id string, part string, words array<string>")
    words = vocabulary.word_frequency(index.placed(own))
    two = ngrams.two_grams(own)
    every = ngrams.chosen_two_grams(two, words).unionByName(ngrams.chosen_three_grams(ngrams.three_grams(own), two))
    wanted = {"flat ring", "flat ring map", "ring map", "module of", "module of field", "of field"}
    want = sorted(tuple(r) for r in every.collect() if r["ngram"] in wanted)
    got = search.asked_grams(search.asked_runs(own, texts), words, texts)
    assert sorted(map(tuple, got.collect())) == want and want
    assert same(index.unpacked(index.packed(own)), own)


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["rank_fusion", "topk_two_stage", "tuple_rerank", "relation_hamming", "hyp_penalty", "intersection_singletons"])
def test_pairs_never_become_hits(spark, monkeypatch, name):
    monkeypatch.setattr(search, "hits", None)
    assert entry.queries()[name](spark, DATA).count() > 0


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_single_words_need_no_ngrams(spark, monkeypatch):
    tokens, postings = searching.prepared(spark, DATA)
    want = search.intersection(search.hits(tokens.where("n = 1"), postings)).collect()
    monkeypatch.setattr(search, "asked_runs", None)
    assert sorted(map(tuple, entry.queries()["intersection_singletons"](spark, DATA).collect())) == sorted(map(tuple, want)) and want


def test_a_statement_contains_a_word_once(spark):
    lists = spark.createDataFrame([(1, "T", ["rings", "ring", "map"]), (1, "H", ["ring"]), (2, "H", ["rings"])], "thm_id int, part string, words array<string>")
    terms = spark.createDataFrame([("ring", "ring"), ("rings", "ring")], "raw string, word string")
    assert sorted(map(tuple, index.containing(lists, terms).collect())) == [("ring", 1, "T", []), ("ring", 2, "T", [])]


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_ranked_results_arent_shuffled(spark):
    """A query's results are in one task, so their order and windows are made there, as the relational steps make them."""
    tokens, postings = searching.prepared(spark, DATA)
    hits = search.hits(tokens, postings)
    want = search.two_stage(search.intersection(hits), hits, 5, 40)
    got = search.ranked(tokens, postings, 5, 40)
    assert same(got.select(sorted(got.columns)), want.select(sorted(want.columns)))
    again = search.reranked(tokens, postings, 10, 5, 40)
    assert same(again, search.windowed_rerank(want, [F.desc("dist")]).select("query_id", "thm_id", "rn"))
    for result in (got, again):
        plan = result._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan.split("MapInArrow")[0]


def test_counted_runs_give_the_same_grams(spark):
    rows = [("flat", "ring", "maps")] * 3 + [("flat", "rings", None)] * 2
    runs = spark.createDataFrame(rows, "w0 string, w1 string, w2 string")
    counted = runs.groupBy("w0", "w1", "w2").agg(F.count("*").alias("n"))
    assert {tuple(r) for r in ngrams.counted_two(counted).collect()} == {tuple(r) for r in ngrams.counted_two(runs).collect()} == {("flat", "ring", 5)}
    assert same(ngrams.counted_three(counted.where("w2 is not null")), ngrams.counted_three(runs.where("w2 is not null")))

from pathlib import Path

import pytest

import __spark_entry__ as entry
from axiomill.operators import classes, lsa, matrix
from axiomill.plans import corpus

DATA = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@tables
def test_latent_vectors_are_those_of_the_spread_matrix(spark):
    import numpy as np

    got = {r["thm_id"]: r["vector"] for r in entry.queries()["lsa_svd"](spark, DATA).collect()}
    assert {len(v) for v in got.values()} == {lsa.RANK}
    cells = matrix.entries(corpus.terms(spark, DATA), corpus.vocab(spark, DATA)).collect()
    ids = sorted(r["thm_id"] for r in corpus.statements(spark, DATA).select("thm_id").collect())
    m = np.zeros((len(ids), corpus.vocab(spark, DATA).count()))
    for r in cells:
        m[ids.index(r["thm_id"]), r["word_idx"]] = r["weight"]
    c = np.nan_to_num(np.corrcoef(m.T))
    np.fill_diagonal(c, 0)
    c[c < lsa.CORRELATION_FLOOR - 1e-12] = 0
    u, s, _ = np.linalg.svd(m + lsa.CORRELATION_WEIGHT * m @ c)
    raw = np.linalg.svd(m)[0]
    first = np.abs([got[i][0] if i in got else 0.0 for i in ids])
    assert np.abs(first - np.abs(u[:, 0])).max() < 1e-6
    assert np.abs(first - np.abs(raw[:, 0])).max() > 1e-4


def test_a_term_of_one_weight_everywhere_has_no_correlation(spark):
    entries = spark.createDataFrame([(t, w, 0.3) for t in range(10) for w in ((0, 1, 2, 3) if t < 5 else (0, 1))], "thm_id bigint, word_idx int, weight double")
    assert [(r["i"], r["j"], round(r["c"], 6)) for r in lsa.correlated(entries, 10).collect()] == [(2, 3, 1.0)]


@tables
def test_predictions_use_the_classifier_as_it_is(spark, monkeypatch):
    asked, real = [], classes.classifier
    monkeypatch.setattr(classes, "classifier", lambda *a, **k: asked.append((len(a), k)) or real(*a, **k))
    assert entry.queries()["class_predictions"](spark, DATA).count() > 0
    assert asked == [(1, {}), (1, {})]  # one model for each half, trained on the other


@tables
def test_latent_vectors_need_no_n_grams_and_no_rows_in_python_at_each_step(spark, monkeypatch):
    from pyspark.sql import DataFrame

    def refused(*_):
        raise AssertionError("n-grams are no entries; rows of a matrix are read in each step")

    monkeypatch.setattr(corpus, "grams", refused)
    monkeypatch.setattr(type(spark.range(1)), "rdd", property(refused))
    assert isinstance(found := entry.queries()["lsa_svd"](spark, DATA), DataFrame)
    assert found.count() > 0
    few = spark.createDataFrame([(1, 0, 2.0), (1, 3, 1.5), (2, 3, 1.0)], "thm_id bigint, word_idx int, weight double")
    lists = lsa.listed(few)
    assert {r["thm_id"]: (r["indices"], r["weights"]) for r in lists.collect()} == {1: ([0, 3], [2.0, 1.5]), 2: ([3], [1.0])}
    assert {tuple(r) for r in lsa.unlisted(lists).collect()} == {tuple(r) for r in few.collect()}


def test_listed_entries_are_spread_as_entries_are(spark):
    rows = [(1, 0, 2.0), (1, 3, 1.5), (2, 3, 1.0), (3, 1, 4.0)]
    entries = spark.createDataFrame(rows, "thm_id bigint, word_idx int, weight double")
    correlations = spark.createDataFrame([(0, 3, 0.5), (0, 2, 0.75)], "i int, j int, c double")
    for some in (correlations, correlations.limit(0)):
        want = {(r["thm_id"], r["word_idx"], round(r["weight"], 9)) for r in lsa.spread(entries, some).collect()}
        got = {(r["thm_id"], r["word_idx"], round(r["weight"], 9)) for r in lsa.unlisted(lsa.spread_lists(lsa.listed(entries), some)).collect()}
        assert got == want and len(got) == (6 if some is correlations else 4)
    given = spark.createDataFrame([(0, 2.0), (1, 4.0), (3, 1.5)], "word_idx int, weight double")
    found = lsa.weighted(lsa.listed(entries).select("thm_id", "indices"), given).orderBy("thm_id").collect()
    assert [(r["indices"], r["weights"]) for r in found] == [([0, 3], [2.0, 1.5]), ([3], [1.5]), ([1], [4.0])]

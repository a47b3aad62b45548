"""Search operators against the loops they stand for."""

import random

from axiomill.operators import authors, classes, concepts, lsa, search, similar


def imperative(tokens, docs):
    """Tokens by rank; a token scores for a document if it covers a place that none before it covered."""
    scores, spans = {}, {}
    for word, pos, n, score, _ in sorted(tokens, key=lambda t: t[4]):
        for doc, words in docs.items():
            if word in words:
                covered = set(range(pos, pos + n))
                if covered - spans.setdefault(doc, set()):
                    scores[doc] = scores.get(doc, 0) + score
                spans[doc] |= covered
    return {d: (scores[d], len(spans[d])) for d in scores}


def test_owner_rule(spark):
    rng = random.Random(1)
    queries, want, docs = [], {}, {d: {f"w{rng.randrange(8)}" for _ in range(rng.randint(1, 6))} for d in range(40)}
    for q in range(30):
        tokens = [(f"w{w}", rng.randrange(5), rng.randint(1, 3), rng.randint(1, 9), r + 1) for r, w in enumerate(rng.sample(range(8), rng.randint(1, 6)))]
        queries += [(f"q{q}", *t) for t in tokens]
        want |= {(f"q{q}", d): v for d, v in imperative(tokens, docs).items()}
    tokens = spark.createDataFrame([(q, w, p, n, s, r) for q, w, p, n, s, r in queries], "query_id string, word string, pos int, n int, score bigint, rank int")
    postings = spark.createDataFrame([(w, d, "T", [0]) for d, words in docs.items() for w in words], "word string, thm_id int, part string, positions array<int>")
    got = {(r["query_id"], r["thm_id"]): (r["score"], r["span"]) for r in search.intersection(search.hits(tokens, postings)).collect()}
    assert got == want


def test_related_words_stand_in(spark):
    tokens = spark.createDataFrame([("q", "ring", 0, 1, 10, 1), ("q", "flat", 1, 1, 1, 2)], "query_id string, word string, pos int, n int, score bigint, rank int")
    related = spark.createDataFrame([("ring", i, f"r{i}") for i in range(1, 7)] + [("flat", 1, "even")], "word string, rank int, related_word string")
    got = {(r["word"], r["term"]): r["weight"] for r in search.expanded(tokens, related).collect()}
    assert got == {("ring", "ring"): 10, ("flat", "flat"): 1, ("flat", "even"): 1} | {("ring", f"r{i}"): 7 for i in range(1, 5)}
    postings = spark.createDataFrame([("ring", 1, "T", [0]), ("r1", 1, "T", [3]), ("r2", 2, "H", [1])], "word string, thm_id int, part string, positions array<int>")
    hits = {(r["thm_id"], r["score"]) for r in search.hits(search.expanded(tokens, related), postings).collect()}
    assert hits == {(1, 10), (2, 7)}


def test_word_distance_by_hand(spark):
    rows = [("q", 1, "T", "flat", 1, [2, 9]), ("q", 1, "T", "ring map", 2, [3]), ("q", 1, "H", "field", 3, [0]), ("q", 2, "T", "ring", 1, [4, 5]), ("q", 3, "H", "a", 1, [0]), ("q", 3, "H", "b", 2, [3])]
    hits = spark.createDataFrame(rows, "query_id string, thm_id int, part string, word string, rank int, positions array<int>")
    got = {r["thm_id"]: (r["dist"], r["first_pos"]) for r in search.word_distance(hits).collect()}
    # 1: flat 2, ring map 3 (gap 1: 2, a blank: 2), flat 9 (0); 2: one generic word; 3: gap 3, no place in the statement
    assert got == {1: (4, 2), 2: (0, 4), 3: (1, 127)}
    after = {r["thm_id"]: r["dist"] for r in search.hyp_penalty(search.word_distance(hits)).collect()}
    assert after == {1: 4, 2: 0, 3: 0}


def test_two_stages_and_pruning(spark):
    rows = [("q", i, 100 - i, 3 if i < 2 else 1) for i in range(10)] + [("q", 20, 10, 1)]
    scores = spark.createDataFrame(rows, "query_id string, thm_id int, score bigint, span bigint")
    none = spark.createDataFrame([], "query_id string, thm_id int, word string, pos int, n int, rank int, score bigint, part string, positions array<int>")
    n_words = spark.createDataFrame([("q", 4)], "query_id string, n_words int")
    ranked = search.two_stage(scores, none, nearest=5, cap=8)
    assert [r["thm_id"] for r in ranked.orderBy("rn").collect()] == [0, 1, 2, 3, 4]
    kept = search.pruned(search.two_stage(scores, none), n_words)
    assert {r["thm_id"] for r in kept.collect()} == set(range(10))


def test_fusion(spark):
    first = spark.createDataFrame([("q", 1, 3, 9, 1), ("q", 2, 1, 5, 2), ("q", 3, 1, 4, 3)], "query_id string, thm_id int, span int, score bigint, rn int")
    second = spark.createDataFrame([("q", 9, 1), ("q", 2, 2)], "query_id string, thm_id int, rn int")
    n = spark.createDataFrame([("q", 3)], "query_id string, n_words int")
    got = {r["thm_id"]: r["score"] for r in search.fused(first, second, n).collect()}
    assert got == {1: 0, 2: 2, 3: 4, 9: 3}


def test_the_first_lists_top_leads(spark):
    """Of a fused top of less span and less score than the first list's own top."""
    first = spark.createDataFrame([("q", 1, 3, 9, 1), ("q", 2, 2, 5, 2)], "query_id string, thm_id int, span int, score bigint, rn int")
    second = spark.createDataFrame([("q", 2, 1)], "query_id string, thm_id int, rn int")
    n = spark.createDataFrame([("q", 9)], "query_id string, n_words int")
    got = [r["thm_id"] for r in search.fused(first, second, n).orderBy("rn").collect()]
    assert got == [1, 2]


def test_author_expressions():
    assert authors.parse("tao and (A1 d1 j or A2") == authors.Both("and", (authors.Name("", "", "tao"), authors.Both("or", (authors.Name("a1", "d1", "j"), authors.Name("", "", "a2")))))
    assert authors.parse("(A1) or A3)") == authors.Both("or", (authors.Name("", "", "a1"), authors.Name("", "", "a3")))
    assert authors.parse("F1 L1 and (and ( F2)") == authors.Both("and", (authors.Name("f1", "", "l1"), authors.Name("", "", "f2")))
    assert authors.parse("") is None
    assert authors.split_query("compact operators by author A and B") == ("compact operators", "A and B")
    assert authors.split_query("compact operators") == ("compact operators", None)


def test_author_search(spark):
    rows = [(1, "terence", "c", "tao"), (1, "yehuda", "", "shalom"), (2, "terence", "", "tao"), (3, "ben", "", "green"), (3, "terence", "", "tao"), (3, "yehuda", "", "shalom")]
    table = spark.createDataFrame(rows, "thm_id int, first_name string, middle_name string, last_name string")

    def found(text):
        return {(r["thm_id"], r["level"]) for r in authors.search(table, text).collect()}

    assert found("T. Tao and Y. Shalom and Green") == {(3, 0)}
    assert found("Terence Tao and (Green or Shalom)") == {(1, 0), (3, 0)}
    assert found("Tom Tao") == {(1, 1), (2, 1), (3, 1)}
    assert found("Terence Tai") == {(1, 2), (2, 2), (3, 2)}
    assert found("") == set()


def test_neighbours_and_votes(spark):
    rng = random.Random(2)
    data = [(i, [rng.random() for _ in range(4)]) for i in range(60)] + [(99, [0.0] * 4)]
    vectors = spark.createDataFrame(data, "vec_id bigint, embedding array<float>")
    queries = vectors.where("vec_id % 20 = 0").selectExpr("vec_id as query_id", "embedding")
    got = {(r["query_id"], r["rn"]): r["vec_id"] for r in lsa.nearest(vectors, queries, 3).collect()}
    for q, v in data[:60:20]:
        near = sorted((sum((a - b) ** 2 for a, b in zip(v, w)), i) for i, w in data[:60])[:3]
        assert [got[q, r] for r in (1, 2, 3)] == [i for _, i in near]
    near = spark.createDataFrame([("q", 1, 0.0, 1), ("q", 2, 0.0, 2)], "query_id string, vec_id int, dist2 double, rn int")
    labels = spark.createDataFrame([(1, "05C15"), (2, "05D40")], "vec_id int, label string")
    votes = {r["prefix"]: r["votes"] for r in classes.vote(near, labels).collect()}
    assert abs(votes["05"] - votes["05C15"] - votes["05D40"]) < 2e-6 and votes["05C15"] > votes["05D40"]
    assert lsa.nearest(vectors.limit(0), queries, 3).count() == 0


def test_similar_lists_of_two_runs(spark):
    old = spark.createDataFrame([(1, [2]), (3, [4])], "thm_id int, l array<int>")
    new = spark.createDataFrame([(1, [9])], "thm_id int, l array<int>")
    assert {(r["thm_id"], tuple(r["l"])) for r in similar.combined(old, new).collect()} == {(1, (9,)), (3, (4,))}


def test_latent_vectors(spark):
    import numpy as np

    from axiomill.operators import lsa

    rng = np.random.default_rng(3)
    dense = rng.random((12, 5)) * (rng.random((12, 5)) < 0.7)
    entries = spark.createDataFrame([(i, j, float(dense[i, j])) for i in range(12) for j in range(5) if dense[i, j]], "thm_id bigint, word_idx int, weight double")
    vectors, s, v = lsa.trained(entries, 5, 3)
    assert np.allclose(s, np.linalg.svd(dense)[1][:3])
    again = {r["thm_id"]: r["vector"] for r in lsa.projected(entries, s, v).collect()}
    assert all(np.allclose(r["vector"], again[r["thm_id"]]) for r in vectors.collect())
    got = {(r["i"], r["j"]): r["c"] for r in lsa.correlated(entries, 12).collect()}
    full = np.corrcoef(dense.T)
    assert all(np.isclose(full[i, j], c) for (i, j), c in got.items()) and len(got) == sum(full[i, j] >= 0.5 for i in range(5) for j in range(i + 1, 5))


def test_all_words_looks_up_the_rarest_word_first(spark):
    rows = [("ring", t, "T") for t in range(50)] + [("flat", t, "H") for t in range(0, 50, 10)] + [("rare", 7, "T"), ("rare", 20, "T")]
    postings = spark.createDataFrame(rows, "word string, thm_id int, part string")
    asked = spark.createDataFrame([(1, "ring"), (1, "flat"), (2, "ring"), (2, "rare"), (3, "ring"), (3, "absent"), (4, "flat"), (4, "rare"), (4, "ring")], "query_id int, word string")
    possible = {(r["query_id"], r["thm_id"]) for r in concepts.holding_rarest(postings, asked).collect()}
    assert possible == {(1, t) for t in range(0, 50, 10)} | {(q, t) for q in (2, 4) for t in (7, 20)}
    found = {(r["query_id"], r["thm_id"], r["n_statement"], r["rn"]) for r in concepts.all_words(postings, asked).collect()}
    assert found == {(1, t, 1, i + 1) for i, t in enumerate(range(0, 50, 10))} | {(2, 7, 2, 1), (2, 20, 2, 2), (4, 20, 2, 1)}

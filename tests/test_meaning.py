"""Commands, relations, and the mends of index, extraction and search."""

from datetime import datetime

from axiomill.operators import extraction, index, search, semantics
from axiomill.plans import meaning
from axiomill.sources import sinks


def test_golden_results():
    assert [meaning.golden(kind, text) for kind, text, _ in meaning.GOLDEN] == [r for *_, r in meaning.GOLDEN]


def test_codes_and_slots():
    name, said, units, relations, code = semantics.command(semantics.items_of("there exists an ideal such that $R$ is flat"))
    assert name == "exists" and code == semantics.EXISTS and ("ideal", semantics.EXISTENCE) in relations and units == 7
    pairs = semantics.adjusted([("flat", "ideal")], relations, code)
    assert ("ideal", semantics.EXISTS) in pairs
    assert semantics.command([]) is None


def test_expressions_of_enumerations_nulls_and_bits(spark, tmp_path):
    rows = spark.createDataFrame([(1, "Let $f$ be a map. \\begin{enumerate} \\item $f$ is a ring \\item $g$ has an ideal \\end{enumerate}"), (2, None), (3, ""), (4, "...")], "id int, text string")
    found = semantics.expressions(rows, "id")
    assert [(r["id"], r["command"]) for r in found.orderBy("id", "at").collect()] == [(1, "let"), (1, "is_a"), (1, "has")]
    vocab = spark.createDataFrame([("map", 0), ("ring", 1), ("ideal", 2)], "word string, word_idx bigint")
    bits = semantics.relation_bits(found, "id", vocab).collect()
    assert [(r["id"], r["bits"]) for r in bits] == [(1, [3, 4, 5, 6])]
    assert sinks.write_expressions(found, str(tmp_path / "out")) == 3


def statement(i, thm):
    return (i, thm, None, "f", "Lemma", "s", datetime(2020, 1, 1))


def test_words_past_the_last_place_keep_their_posting(spark):
    text = " ".join(["ring"] * 150 + ["ideal"])
    rows = spark.createDataFrame([statement(1, text)], "thm_id int, thm string, hyp string, file_name string, thm_type string, source string, loaded_at timestamp")
    texts = index.parts(index.statements(rows))
    none = spark.createDataFrame([], "ngram string")
    got = {r["word"]: r["positions"] for r in index.postings(index.index_terms(index.token_lists(texts), none)).collect()}
    assert got["ideal"] == [] and got["ring"] == list(range(127))
    assert {r["word"]: r["positions"] for r in index.literal_postings(texts).collect()} == {"ring": [0, 1], "ideal": [150]}


def test_an_open_environment_loses_no_others():
    text = "\\begin{document}\\begin{lemma} first one \\end{lemma} \\begin{theorem} open \\begin{lemma} second one \\end{lemma} \\begin{lemma} never closed"
    assert [s for _, _, s, _ in extraction.extract(text)] == ["first one", "second one"]


def test_typed_queries(spark):
    rows = [(1, "12 Compact Operators"), (2, "context locally convex"), (3, "relation  7 rings"), (4, "  "), (5, None), (6, "context")]
    got = {r["query_id"]: (r["text"].strip(), r["mode"], r["most"]) for r in search.read_queries(spark.createDataFrame(rows, "query_id int, text string")).collect()}
    assert got == {1: ("compact operators", "", 12), 2: ("locally convex", "context", 60), 3: ("rings", "relation", 7), 4: ("", "", 60), 6: ("context", "", 60)}


def test_a_whole_search(spark):
    """Each phrase is found first; without a word in common, the vectors stand in."""
    texts = {1: "locally convex space is a vector space", 2: "localization of a catenary ring is catenary", 3: "every compact operator has a trace", 4: "a space"}
    rows = spark.createDataFrame([statement(i, t) for i, t in texts.items()], "thm_id int, thm string, hyp string, file_name string, thm_type string, source string, loaded_at timestamp")
    parts = index.parts(index.statements(rows))
    lists = index.token_lists(parts)
    none = spark.createDataFrame([], "ngram string, freq bigint")
    words = spark.createDataFrame([(w, 5) for w in "locally convex space vector localization catenary ring compact operator trace".split()], "word string, freq bigint")
    postings = index.postings(index.index_terms(lists, none))
    queries = spark.createDataFrame([(1, "locally convex spaces"), (2, "localization of catenary rings"), (3, "1 compact space"), (4, "zzz yyy"), (5, " ")], "query_id int, text string")
    nearest = spark.createDataFrame([(4, 3, 1), (1, 3, 1)], "query_id int, thm_id int, rn int")
    found = search.combined(queries, words, none, postings, index.literal_postings(parts), nearest=nearest).orderBy("query_id", "rn").collect()
    first = {}
    for r in found:
        first.setdefault(r["query_id"], (r["thm_id"], r["origin"]))
    assert first[1] == (1, "words") and first[2] == (2, "words") and first[4] == (3, "vectors") and 5 not in first
    assert sum(r["query_id"] == 3 for r in found) == 1


def test_pairs_to_add_and_to_leave_out(spark):
    from axiomill.operators import ngrams

    two = spark.createDataFrame([("flat", "field", 9), ("flat", "split", 9), ("flat", "module", 1), ("flat", "map", 9), ("flat", "ideal", 2)], "w0 string, w1 string, freq bigint")
    words = spark.createDataFrame([("flat", 30), ("field", 50), ("split", 50), ("module", 50), ("map", 50)], "word string, freq bigint")
    pos = spark.createDataFrame([("flat", "adj"), ("split", "verb")], "word string, pos string")
    added, removed = (spark.createDataFrame([(x,)], "ngram string") for x in ("flat module", "flat map"))
    got = {r["ngram"] for r in ngrams.chosen_two_grams(two, words, pos, [("adj", "verb")], added, removed).collect()}
    assert got == {"flat field", "flat module"}
    assert "flat split" in {r["ngram"] for r in ngrams.chosen_two_grams(two, words).collect()}


def test_a_lexicon_and_phrases_from_files(spark, tmp_path):
    from axiomill.operators import parsing

    table = spark.createDataFrame([("prime number", "ent"), ("Acts", "verb"), (None, "ent")], "word string, pos string")
    lexicon = parsing.lexicon_of(table)
    assert parsing.tagged("the prime number acts freely", lexicon) == [("the", "det"), ("prime number", "ent"), ("acts", "verb"), ("freely", "adverb")]
    texts = spark.createDataFrame([(1, "The prime number acts freely."), (2, None)], "id int, text string")
    assert [r["expression"] for r in parsing.parsed(texts, "id", lexicon).collect()] == ['Math["Name"->"prime number"] acts freely']


def test_nearest_with_ties_and_few_vectors(spark):
    from axiomill.operators import lsa

    vectors = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(9)] + [(99, [0.0, 0.0])], "vec_id int, embedding array<double>")
    queries = spark.createDataFrame([(7, [1.0, 1.0]), (8, [50.0, 1.0])], "query_id int, embedding array<double>")
    got = {(r["query_id"], r["rn"]): r["vec_id"] for r in lsa.nearest(vectors, queries, 4).collect()}
    assert got == {(7, 1): 1, (7, 2): 4, (7, 3): 7, (7, 4): 0, (8, 1): 2, (8, 2): 5, (8, 3): 8, (8, 4): 1}
    assert lsa.nearest(vectors.limit(0), queries, 4).count() == 0


def test_commands_of_sentences_without_fluff_to_parse(spark):
    texts = spark.createDataFrame([(1, "all then also. if $R$ is a field then $S$ is a ring. let $f$ be a map"), (2, "the"), (3, None), (4, "\\begin{enumerate} \\item $f$ is flat \\end{enumerate}")], "id int, text string")
    found = semantics.expressions(texts, "id").collect()
    want = [(1, 0, None), (1, 1, "implies"), (1, 2, "let"), (4, 0, "is_a")]
    assert sorted(((r["id"], r["at"], r["command"]) for r in found), key=lambda r: r[:2]) == want
    assert sorted(map(tuple, semantics.command_names(texts, "id").collect()), key=lambda r: r[:2]) == want
    # Without contexts, fewer sentences are parsed; relations are the same.
    bare = semantics.expressions(texts, "id", context=False).collect()
    assert sorted((r["id"], r["at"], r["relations"]) for r in bare) == sorted((r["id"], r["at"], r["relations"]) for r in found)
    assert any(w["slot"] == semantics.CONDITION for r in bare for w in r["relations"])

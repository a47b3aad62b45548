from pyspark.sql import functions as F

from axiomill.functions import codec, markup
from axiomill.functions import words as W


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column.alias("x")).collect()]


def test_word_scores_at_their_edges(spark):
    got = values(spark, W.word_score(F.col("f")), [(f,) for f in (0, 39, 40, 131, 132, 139, 140, 179, 180, 349, 350, 450)], "f int")
    assert got == [20, 7, 25, 3, 2, 1, 3, 3, 4, 4, 3, 3]


def test_singular_forms(spark):
    pairs = {
        "rings": "ring", "matrices": "matrix", "series": "series", "varieties": "variety", "classes": "class", "agrees": "agree", "catches": "catch", "boxes": "box",
        "basis": "basis", "torus": "torus", "class": "class", "has": "has", "gas": "gas", "kindness": "kindness", "continuous": "continuous", "field": "field",
    }
    assert values(spark, W.singular(F.col("w")), [(w,) for w in pairs], "w string") == list(pairs.values())


def test_splitting(spark):
    rows = [("Let f's (ring) be [a]; B_n-module: \"x\"!",), ("schr\\\"{o}dinger",), ("  ",), (None,)]
    got = values(spark, W.split_words(F.col("t")), rows, "t string")
    assert got == [["let", "f", "ring", "be", "a", "b", "n", "module", "x"], ['schr\\"', "o", "dinger"], [], None]
    assert W.quoted_sections('compact "Locally Convex" space') == ["compact", "locally convex", "space"]


def test_algebra_spellings(spark):
    rows = [("a c^*-algebra b",), ("c* algebra",), ("the $c^*$ algebra",), ("$\\mathrm{c}^*$-algebra",)]
    assert values(spark, W.starred_algebra(F.col("t")), rows, "t string") == ["a c-algebra b", "c-algebra", "the c-algebra", "c-algebra"]


def test_small_word_functions(spark):
    assert values(spark, W.strip_umlaut(F.col("w")), [('k\\"{a}hler',)], "w string") == ["kahler"]
    assert values(spark, W.is_quantity(F.col("w")), [("three",), ("twenty-one",), ("3/4",), ("12",), ("ring",)], "w string") == [True, True, True, True, False]
    assert values(spark, W.is_greek(F.col("w")), [("alpha",), ("aleph",)], "w string") == [True, False]
    assert values(spark, W.part_of_speech(F.col("w")), [("NNS",), ("??",)], "w string") == ["ent", None]
    assert values(spark, W.escaped_at(F.col("t"), F.lit(3)), [("a\\$",), ("\\\\$",)], "t string") == [True, False]
    assert values(spark, W.names_alike(F.col("a"), F.col("b")), [("noether", "noethe"), ("emmy noether", "noether"), ("hilbert", "noether")], "a string, b string") == [True, True, False]
    assert values(spark, W.tex_alike(F.col("a"), F.col("b")), [("$x$", "$y_1$"), ("$x$", "y")], "a string, b string") == [True, False]
    assert values(spark, W.ngram_score(F.col("a"), F.col("b")), [(3, 9), (20, 9)], "a int, b int") == [10, 20]
    got = values(spark, W.name_parts(F.col("n")), [("W. N. Kang",), ("Tao",), ("Yehuda Shalom",), ("",)], "n string")
    assert [tuple(x) for x in got] == [("w", "n", "kang"), ("", "", "tao"), ("yehuda", "", "shalom"), ("", "", "")]


def test_markup(spark):
    text = "\\begin{theorem} \\emph{Every} ring<field \\index{a!b}% \\item{x} \\cite{q} \\textbf{is} flat.\\end{theorem}"
    assert values(spark, markup.cleaned(F.col("t")), [(text,)], "t string") == ["{Every} ring < field -{x} {is} flat."]
    assert values(spark, markup.kind(F.col("t")), [("thm",), (" LEMMA ",), ("proposition",), ("remark",), (None,)], "t string") == ["Theorem", "Lemma", "Proposition", None, None]
    assert values(spark, markup.is_hypothesis(F.col("t")), [("Let X be",), ("X is flat",), ("if",)], "t string") == [True, False, False]
    assert values(spark, markup.balanced(F.col("t")), [("a $x",), ("\\[ y",), ("$x$",)], "t string") == ["a $x$", "\\[ y\\]", "$x$"]
    assert values(spark, markup.is_wordy(F.col("t")), [("$x$ $y$",), ("every flat ring is $x$",), ("a b c d " + "$x$ " * 13,)], "t string") == [False, True, False]
    assert values(spark, markup.function_names(F.col("t")), [("The Riemann zeta function and the map of number",)], "t string") == [["riemann zeta"]]
    assert values(spark, markup.source_url(F.col("t")), [("math0001088.tex",), ("1203.4567",), ("x",)], "t string") == ["https://arxiv.org/abs/math/0001088", "https://arxiv.org/abs/1203.4567", None]
    html = '<meta charset="utf-8"><title>' + "t" * 40 + '</title><a title="short"/>'
    assert values(spark, markup.html_titles(F.col("t")), [(html,)], "t string") == [["t" * 40]]
    assert values(spark, markup.html_charset(F.col("t")), [(html,), ("",)], "t string") == ["utf-8", None]


def test_packed_lists(spark):
    import random

    rng = random.Random(1)
    lists = [[rng.randrange(1 << 21) for _ in range(n)] for n in (0, 1, 7, 100)]
    for values_ in lists:
        assert codec.unpack(codec.pack(values_))[: len(values_)] == values_
    rows = spark.createDataFrame([(i, v) for i, v in enumerate([*lists[1:], None])], "id int, v array<int>")
    back = {r["id"]: r["v"] for r in codec.unpacked(codec.packed(rows, "v"), "v").collect()}
    assert all(back[i][: len(v)] == v for i, v in enumerate(lists[1:])) and back[3] is None
    assert len(codec.pack(list(range(150)))) == 100 * 21 // 8 + 1
    assert values(spark, codec.width(F.col("n")), [(5337,), (1024,)], "n int") == [13, 11]

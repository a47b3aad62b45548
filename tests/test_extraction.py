from axiomill.operators import extraction as X
from axiomill.operators import parsing as P
from axiomill.operators import recipes as R


def test_macros():
    cases = [
        ({"\\wh": ("\\widehat{#1}", 1, None)}, "a \\wh {b}", "a \\widehat{b}"),
        ({"\\In": ("\\mathrm{in}", 0, None)}, "hi \\In{content} there", "hi \\mathrm{in}{content} there"),
        ({"\\Xb": ("\\textbf{\\upshape X}", 0, None)}, "this is \\Xb", "this is \\textbf{\\upshape X}"),
        ({"\\ol": ("\\overline{#1}", 1, None)}, "hi \\ol{3} ", "hi \\overline{3} "),
        ({"\\spc": ("sp", 0, None), "\\ess": ("ess", 0, None), "\\spes": ("\\spc_{\\ess}", 0, None)}, "\\spes", "sp_{ess}"),
        ({"\\a": ("x", 0, None)}, "\\ab \\a", "\\ab x"),
        ({"\\v": ("#1^#2", 2, "n")}, "\\v{k} \\v[m]{k}", "n^k m^k"),
        ({}, "\\a", "\\a"),
    ]
    for known, text, want in cases:
        assert X.expand(text, known) == want
    found = X.macros("\\newcommand{\\wh}[1]{\\widehat{#1}} \\def\\G{{\\cal G}} \\DeclareMathOperator{\\spec}{Spec} \\renewcommand\\q[2][z]{#1#2}")
    assert found == {"\\wh": ("\\widehat{#1}", 1, None), "\\G": ("{\\cal G}", 0, None), "\\spec": ("\\operatorname{Spec}", 0, None), "\\q": ("#1#2", 2, "z")}


TEX = r"""\documentclass{article}
\newtheorem{satz}[theorem]{Theorem}
\newcommand{\R}{\mathbb{R}}
\begin{document}
Let $\alpha$ be a point in $X$. % remark
\begin{theorem}\label{one} $\alpha$ is closed in \R.\footnote{See {x}.} \end{theorem}
\begin{proof} \begin{lemma} hidden \end{lemma} \end{proof}
Fix a ring.
\begin{satz}[Name] By \ref{one}, it holds. \end{satz}
\begin{lemma} """ + "x" * 1900 + r""" \end{lemma}
\begin{remark} no \end{remark}
\begin{lemma} open
\end{document}"""


def test_statements():
    got = X.extract(TEX)
    assert [(k, t) for _, k, t, _ in got] == [("Theorem", "\\label{one} $\\alpha$ is closed in \\mathbb{R}."), ("Theorem", "By \\ref{one}, it holds.")]
    assert got[0][3] == "Let $\\alpha$ be a point in $X$." and got[1][3] == "Fix a ring."
    assert X.extract("") == []


def test_statements_table_and_references(spark):
    rows = spark.createDataFrame([("p", TEX), ("q", None), ("r", "no statements")], "paper_id string, text string")
    found = X.statements(rows)
    assert {(r["paper_id"], r["at"]) for r in found.collect()} == {("p", 0), ("p", 1)}
    texts = {r["at"]: r["thm"] for r in X.resolved(found).collect()}
    assert texts[1] == "By [1], it holds. [1] $\\alpha$ is closed in \\mathbb{R}."


def test_variables():
    cases = {"S_{A}": ["S_{A}", "A", "S"], "x \\oplus y": ["x", "y"], "x\\nmid y": ["x", "y"], "f[\\alpha] = y": ["f", "alpha", "y"], "\\mathbb{Z}": ["Z"], "12": []}
    for tex, want in cases.items():
        assert X.variables(tex) == want


def test_last_definition_before_a_use(spark):
    texts = spark.createDataFrame([("p", 1, "Let $X$ be a space. Fix a point $x$ of $X$."), ("p", 3, "Suppose $X$ is compact.")], "paper_id string, at int, text string")
    uses = spark.createDataFrame([("p", 0, "X"), ("p", 2, "X"), ("p", 3, "X"), ("p", 2, "Y")], "paper_id string, at int, variable string")
    got = {(r["at"], r["variable"]): r["sentence"] for r in X.attached(uses, X.definitions(texts)).collect()}
    assert got == {(0, "X"): None, (2, "X"): "Fix a point $x$ of $X$", (3, "X"): "Suppose $X$ is compact", (2, "Y"): None}


def test_sentences_and_substitution():
    assert X.sentences("Let $X, Y$ be (nice) spaces, with $f$, $g$ maps. Then it Holds!") == ["let $X, Y$ be spaces with $f$ and $g$ maps", "then it holds"]
    assert X.substituted("Then $X$ maps to $Y$ and $X$ is flat", {"X": "a space"}) == "Then $X$ (a space) maps to $Y$ and $X$ is flat"


def test_context_pairs():
    assert set(P.context("field is global ring over group")) == {("is", "field"), ("ring", "is"), ("global", "ring"), ("group", "ring")}


def test_expressions():
    cases = {
        "let f be g": ("HYP", "f \\[Element] Math[g]"),
        "quotient over ring is quotient": ("STM", 'Math["Name"->"quotient", "Qualifiers" -> {"over", Math["Name"->"ring"]}] \\[Element] Math["Name"->"quotient"]'),
    }
    for text, want in cases.items():
        node = P.parse(text)[0]
        assert (P.section(node, text), P.expression(node)) == want
    assert P.section(P.parse("x is flat if and only if y is")[0], "x is flat if and only if y is") == "HYP_iff"
    assert P.parse("") == []


def test_parsing_a_table(spark):
    rows = spark.createDataFrame([(1, "Let f be g. Every flat ring is local."), (2, None), (3, "")], "thm_id int, text string")
    got = P.parsed(rows, "thm_id").collect()
    assert [(r["thm_id"], r["at"], r["section"]) for r in sorted(got, key=lambda r: r["at"])] == [(1, 0, "HYP"), (1, 1, "STM")]
    assert P.parse_share(P.parsed(rows, "thm_id")).first()["share"] == 1.0


INGREDIENTS = ["flour", "soda", "salt", "egg", "banana", "oil", "onion"]
RECIPES = [
    ("combine flour and salt, add banana, pour batter in bowl, Combine banana mixture and egg", INGREDIENTS, 7),
    ("combine flour and salt, wait 10 minutes", INGREDIENTS, 3),
    ("soak cashew overnight, place potato and carrot in steamer for 20 minutes, combine soaked cashew and steamed vegetable", ["potato", "cashew", "carrot"], 5),
    ("warm tortillas on pan or directly over fire, add garlic and mix until smooth", ["tortilla", "garlic"], 3),
    ("bring a large pot of water to boil, add corn. cook until tender. Cook corn on preheated grill.", ["water", "corn"], 6),
    ("cut kernels off the cob with a sharp knife.", ["kernel"], 1),
    ("cook sausage, ground beef, onion, and garlic over medium heat until well browned.", [], 4),
    ("Spread with one half of the ricotta cheese mixture. Top with a third of mozzarella cheese slices.", [], 2),
    ("soak cashew overnight, place potato and carrot in steamer for 20 minutes, combine with soaked cashew", ["potato", "cashew", "carrot"], 5),
]


def test_recipes(spark):
    for text, foods, n in RECIPES:
        assert len(R.graph(text, foods)) == n, text
    rows = spark.createDataFrame([(1, RECIPES[0][0]), (2, None), (3, "")], "doc_id int, text string")
    assert R.edges(rows, "doc_id", INGREDIENTS).groupBy("doc_id").count().collect()[0]["count"] == 7

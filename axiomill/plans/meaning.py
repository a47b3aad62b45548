"""Queries on commands and relations of sentences, and on lists of words and bundles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from axiomill.functions import markup
from axiomill.functions import words as W
from axiomill.operators import authors, extraction, index, parsing, semantics, similar, vocabulary
from axiomill.plans import corpus, searching
from axiomill.plans import sql as Q
from axiomill.session import checkpointed, table

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# Inputs and results that the parser must have.
GOLDEN = (
    ("expression", "let f be g", "f \\[Element] Math[g]"),
    ("expression", "quotient over ring is quotient", 'Math["Name"->"quotient", "Qualifiers" -> {"over", Math["Name"->"ring"]}] \\[Element] Math["Name"->"quotient"]'),
    ("context", "field is global ring over group", "global<ring group<ring is<field ring<is"),
    ("variables", "S_{A}", "A S S_{A}"),
    ("variables", "x \\oplus y", "x y"),
    ("command", "let f be g", "let: Math[f] \\[Element] Math[g]"),
    ("command", "if $R$ is a field then there exists an ideal", "implies: Implies[$R$ \\[Element] Math[field], \\[Exists][Math[ideal]]]"),
    ("command", "every ideal is principal if and only if $R$ is noetherian", "iff: HasProperty[Math[ideal], principal] \\[DoubleLeftRightArrow] HasProperty[$R$, noetherian]"),
    ("command", "$f$ maps $X$ to $Y$", "maps: $f$: $X$ -> $Y$"),
    ("tex", "$\\frac{a}{b} \\oplus C^{2}$", "a over b direct sum C to the 2"),
    ("tex", "$x_1 \\leq \\sqrt{y}$", "x sub 1 at most root of y"),
    ("enumerate", "Then \\begin{enumerate} \\item $f$ is flat \\item[b] $g$ is finite \\end{enumerate} holds", "$f$ is flat | $g$ is finite"),
    ("long form", "ring is field", "s[np[ring], vp[be[is], np[field]]]"),
    ("superimposed", "if $R$ is a field / and $S$ a ring", "if $S$ is ring"),
    ("reparsed", "ring therefore is clearly field", "s"),
    ("section", "let f be g", "HYP"),
    ("section", "ring is field", "STM"),
    ("section", "ring is field if and only if ring is flat", "HYP_iff"),
    ("section", "the global ring", "OBJ"),
    ("tags", "the global ring acts freely", "det adj ent verb adverb"),
    ("macro", "\\newcommand{\\wh}[1]{\\widehat{#1}} / a \\wh {b}", "a \\widehat{b}"),
    ("macro", "\\def\\R{\\mathbb{R}} / $\\R^n$ and \\Rest", "$\\mathbb{R}^n$ and \\Rest"),
    ("sentences", "Let $a$, $b$ be (two) rings, in $X$. Then $a$ is flat!", "let $a$ and $b$ be rings in $X$ | then $a$ is flat"),
    ("environment", "\\newtheorem{main}{Main Theorem}\\begin{document}\\begin{main} all rings are flat \\end{main}", "Theorem: all rings are flat"),
    ("substituted", "$f$ maps to $X$, and $f$ is flat / f = function", "$f$ (function) maps to $X$, and $f$ is flat"),
    ("by author", "compact operators by author A and B", "compact operators | A and B"),
    ("quoted", 'flat "finite ring" module', "flat, finite ring, module"),
)


def golden(kind: str, text: str) -> str:
    if kind == "expression":
        return " ; ".join(map(parsing.expression, parsing.parse(text)))
    if kind == "context":
        return " ".join(sorted("<".join(p) for p in parsing.context(text)))
    if kind == "variables":
        return " ".join(sorted(extraction.variables(text)))
    if kind == "command":
        name, said, *_ = semantics.command(semantics.items_of(text))
        return f"{name}: {said}"
    if kind == "tex":
        return semantics.tex_words(text)
    if kind == "enumerate":
        return " | ".join(semantics.enumerated(text))
    if kind == "long form":
        return semantics.long_form(parsing.parse(text)[0])
    if kind == "superimposed":
        return " ".join(n.text for n in semantics.superimposed(*map(semantics.items_of, text.split(" / "))))
    if kind == "section":
        return parsing.section(parsing.parse(text)[0], text)
    if kind == "tags":
        return " ".join(tag for _, tag in parsing.tagged(text))
    if kind == "macro":
        defined, used = text.split(" / ")
        return extraction.expand(used, extraction.macros(defined))
    if kind == "sentences":
        return " | ".join(extraction.sentences(text))
    if kind == "environment":
        return " | ".join(f"{k}: {t}" for _, k, t, _ in extraction.extract(text))
    if kind == "substituted":
        used, noun = text.split(" / ")
        return extraction.substituted(used, dict([noun.split(" = ")]))
    if kind == "by author":
        return " | ".join(x or "" for x in authors.split_query(text))
    if kind == "quoted":
        return ", ".join(W.quoted_sections(text))
    return " ".join(n.category for n in parsing.parse(text))


@query("SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in row) + ")" for row in GOLDEN) + ") AS g(kind, input, result)")
def parse_golden(spark, sf_dir):
    rows = spark.createDataFrame([(kind, text) for kind, text, _ in GOLDEN], "kind string, input string")
    return rows.select("kind", "input", F.udf(golden, "string", useArrow=True)("kind", "input").alias("result"))


# Functions of words and texts, their inputs, and what they must give.
FUNCTIONS = (
    ("tex_alike", "$a$", "$b_1$", "true"), ("tex_alike", "$a$", "$b_{1,2}$ is long", "false"), ("tex_alike", "a", "$b$", "false"),
    ("escaped_at", "a\\\\\\{", "5", "true"), ("escaped_at", "a\\\\{", "4", "false"),
    ("is_greek", "omega", "", "true"), ("is_greek", "zeta", "", "false"),
    ("part_of_speech", "NNS", "", "ent"), ("part_of_speech", "VBN", "", "parti"), ("part_of_speech", "XX", "", None),
    ("strip_umlaut", "poincar\\'{e}", "", "poincare"), ("strip_umlaut", "erd\\\"os", "", "erdos"),
    ("strip_blanks", "  a b\t", "", "a b"), ("escape_blanks", "a  b c", "", "a\\ b\\ c"),
    ("is_alphabetic", "flat ring", "", "true"), ("is_alphabetic", "c4", "", "false"),
    ("without_lists", "\\begin{itemize} a \\end{enumerate}", "", " a "),
    ("is_quantity", "twenty-one", "", "true"), ("is_quantity", "3/4", "", "true"), ("is_quantity", "many", "", "false"),
)


def quoted(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


@query("SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(quoted, row)) + ")" for row in FUNCTIONS) + ") AS g(name, a, b, result)")
def function_golden(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    results = {
        "tex_alike": W.tex_alike(a, b), "escaped_at": W.escaped_at(a, b.try_cast("int")), "is_greek": W.is_greek(a), "part_of_speech": W.part_of_speech(a), "strip_umlaut": W.strip_umlaut(a),
        "strip_blanks": W.strip_blanks(a), "escape_blanks": W.escape_blanks(a), "is_alphabetic": W.is_alphabetic(a), "without_lists": markup.without_lists(a), "is_quantity": W.is_quantity(a),
    }
    chosen = F.coalesce(*(F.when(F.col("name") == name, value.cast("string")) for name, value in results.items()))
    rows = spark.createDataFrame([row[:3] for row in FUNCTIONS], "name string, a string, b string")
    return rows.select("name", "a", "b", chosen.alias("result"))


@query("SELECT thm_id, thmconcepts AS ids FROM thmconceptstb UNION ALL SELECT thm_id, similarthms FROM similarthmstb WHERE thm_id NOT IN (SELECT thm_id FROM thmconceptstb)")
def lists_combined(spark, sf_dir):
    """The lists of an earlier run, and those of a later one that stand in their place."""
    old, new = (table(spark, sf_dir, t).select("thm_id", F.col(c).alias("ids")) for t, c in (("similarthmstb", "similarthms"), ("thmconceptstb", "thmconcepts")))
    return similar.combined(old, new)


@query(
    """WITH a AS (SELECT thm_id, unnest(thmconcepts) AS x FROM thmconceptstb UNION SELECT thm_id, unnest(similarthms) FROM similarthmstb)
       SELECT thm_id, list_sort(list(x)) AS bits FROM a WHERE x IS NOT NULL GROUP BY 1"""
)
def vectors_united(spark, sf_dir):
    """The union of several sparse vectors of a statement."""
    each = table(spark, sf_dir, "thmconceptstb").select("thm_id", F.col("thmconcepts").alias("bits")).unionAll(table(spark, sf_dir, "similarthmstb").select("thm_id", "similarthms"))
    return semantics.united(each, "thm_id")


def keyed_parts(spark, sf_dir):
    """``key, text``: the statements' parts, each under its own key."""
    return corpus.parts(spark, sf_dir).select(F.concat_ws("/", "thm_id", "part").alias("key"), "text")


@query()
def semantic_expressions(spark, sf_dir):
    """Commands of the statements and of their hypotheses, each part under its own key."""
    return semantics.expressions(keyed_parts(spark, sf_dir), "key")


def both_parts(spark, sf_dir):
    found = semantics.expressions(keyed_parts(spark, sf_dir), "key", context=False)
    condition = F.transform("relations", lambda r: F.struct(r["word"].alias("word"), F.lit(semantics.CONDITION).alias("slot")))
    # What is said in the hypotheses is a condition too.
    relations = F.when(F.col("key").endswith("/H"), F.array_distinct(F.concat("relations", condition))).otherwise(F.col("relations"))
    return found.select(F.split("key", "/")[0].cast("int").alias("thm_id"), "command", relations.alias("relations"))


@query()
def relation_vectors(spark, sf_dir):
    return semantics.relation_bits(both_parts(spark, sf_dir), "thm_id", checkpointed(corpus.vocab(spark, sf_dir)))


@query()
def command_counts(spark, sf_dir):
    """How often each command was found; sentences without one count for null."""
    return semantics.command_names(keyed_parts(spark, sf_dir), "key").groupBy("command").agg(F.count("*").alias("n"))


@query(Q.q(Q.ALL, "SELECT word, row_number() OVER (ORDER BY length(word) DESC, word) AS rn FROM (SELECT DISTINCT word FROM tok)"))
def length_order(spark, sf_dir):
    return W.longest_first(corpus.tokens(spark, sf_dir).select("word").distinct(), "word")


@query(Q.q(f"{Q.ALL}, {Q.FREQ}", "SELECT word, freq, row_number() OVER (ORDER BY freq DESC, word) - 1 AS word_idx FROM fr"))
def count_order(spark, sf_dir):
    return vocabulary.numbered(vocabulary.word_frequency(corpus.tokens(spark, sf_dir)))


@query(
    Q.q(
        f"{Q.ALL}, {Q.FREQ}, {Q.NEAR}, {Q.VOCAB}",
        "SELECT thm_id, b.word_idx AS child, max(coalesce(a.word_idx, -10)) AS parent FROM nr JOIN vo AS b ON b.word = nr.w1 LEFT JOIN vo AS a ON a.word = nr.w0 WHERE w1 IS NOT NULL GROUP BY 1, 2",
    )
)
def context_merge(spark, sf_dir):
    """The words before each vocabulary word of a statement as one map; words without a number weigh less."""
    vocab = checkpointed(corpus.vocab(spark, sf_dir)).select("word", "word_idx")
    near = index.runs(corpus.lists(spark, sf_dir), 2).where("w1 is not null").select("thm_id", "w0", F.col("w1").alias("word"))
    child = near.join(vocab, "word").select("thm_id", "w0", F.col("word_idx").alias("child"))
    before = child.join(vocab.select(F.col("word").alias("w0"), F.col("word_idx").alias("parent")), "w0", "left")
    return semantics.merged_context(before.select("thm_id", "child", F.coalesce("parent", F.lit(semantics.DEFAULT)).alias("parent")), ["thm_id"])


@query(
    Q.q(
        f"""{corpus.STEMS}, {Q.VOCAB}, {searching.REL},
        sy AS (SELECT word, related_word || CASE WHEN rank % 2 = 0 THEN 's' ELSE '' END AS related_word FROM rw),
        fo AS (SELECT word AS raw, CASE WHEN word IN (SELECT word FROM vo) THEN word WHEN {Q.singular('word')} IN (SELECT word FROM vo) THEN {Q.singular('word')} END AS form
               FROM (SELECT word FROM sy UNION SELECT related_word FROM sy))""",
        "SELECT DISTINCT a.form AS word, b.form AS related_word FROM sy JOIN fo AS a ON a.raw = sy.word JOIN fo AS b ON b.raw = sy.related_word WHERE a.form IS NOT NULL AND b.form IS NOT NULL AND a.form <> b.form",
    )
)
def synonym_pruning(spark, sf_dir):
    """Words of one stem as synonyms, every second in the plural, as far as the vocabulary has them."""
    related = searching.related(spark, sf_dir)
    listed = related.select("word", F.concat("related_word", F.when(F.col("rank") % 2 == 0, F.lit("s")).otherwise(F.lit(""))).alias("related_word"))
    return vocabulary.pruned_synonyms(listed, checkpointed(corpus.vocab(spark, sf_dir)))


@query(
    """WITH b AS (SELECT label AS bundle, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS local_id, embedding FROM embeddings),
            s AS (SELECT bundle, count(*) AS n FROM b GROUP BY 1),
            o AS (SELECT bundle, coalesce(sum(n) OVER (ORDER BY bundle ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM s)
       SELECT CAST(local_id + off AS BIGINT) AS thm_id, embedding FROM b JOIN o USING (bundle)"""
)
def bundle_concat(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("bundle"), "vec_id", "embedding")
    local = (F.row_number().over(Window.partitionBy("bundle").orderBy("vec_id")) - 1).cast("bigint")
    return index.concatenated(rows.select("bundle", local.alias("local_id"), "embedding")).drop("bundle", "local_id")

"""Queries on extraction from TeX, parsing, recipes, sources and windows of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from axiomill.functions import markup
from axiomill.operators import extraction, parsing, recipes
from axiomill.plans import corpus
from axiomill.plans import sql as Q
from axiomill.session import table
from axiomill.sources import readers, sinks
from axiomill.streaming import incremental

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


@query(
    """SELECT paper_id, CASE WHEN regexp_matches(created, '^\\s*\\d{4}[-/]?\\d{1,2}[-/]?\\d{1,2}\\s*$')
              THEN regexp_extract(created, '^\\s*(\\d{4})[-/]?(\\d{1,2})[-/]?(\\d{1,2})\\s*$', 1) || '-' || lpad(regexp_extract(created, '^\\s*(\\d{4})[-/]?(\\d{1,2})[-/]?(\\d{1,2})\\s*$', 2), 2, '0')
                   || '-' || lpad(regexp_extract(created, '^\\s*(\\d{4})[-/]?(\\d{1,2})[-/]?(\\d{1,2})\\s*$', 3), 2, '0') END AS created,
              trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title, regexp_replace(authors, '[,;\\s]+$', '') AS authors
       FROM (SELECT replace(paper_id, '/', '') AS paper_id, created, title, authors FROM papers)"""
)
def paper_metadata(spark, sf_dir):
    return readers.tidy_papers(table(spark, sf_dir, "papers"))


@query("SELECT DISTINCT a.thm_id, a.paper_id, p.authors FROM authortb AS a JOIN papers AS p USING (paper_id)")
def author_csv_rows(spark, sf_dir):
    return sinks.name_rows(table(spark, sf_dir, "authortb"), table(spark, sf_dir, "papers"))


@query("SELECT DISTINCT file_name FROM thmhyptb WHERE regexp_matches(file_name, '(^|/)math[^/]*$') OR regexp_extract(file_name, '([^/]+?)(?:\\.tex)?(?:\\.gz)?$', 1) IN (SELECT paper_id FROM papers)")
def math_paper_filter(spark, sf_dir):
    files = table(spark, sf_dir, "thmhyptb").where("file_name is not null").select(F.col("file_name").alias("name")).distinct()
    return readers.mathematical(files, table(spark, sf_dir, "papers")).select(F.col("name").alias("file_name"))


def tex_papers(spark, sf_dir):
    """One TeX text for each file: the statements with their hypotheses before them, in the order of ids."""
    rows = corpus.statements(spark, sf_dir).where("file_name is not null and thm is not null")
    env = F.coalesce(F.nullif(F.substring(F.lower(F.trim(markup.kind(F.col("thm_type")))), 1, 4), F.lit("")), F.lit("theo"))
    each = F.concat(F.coalesce("hyp", F.lit("")), F.lit("\n\\begin{"), env, F.lit("}\n"), F.col("thm"), F.lit("\n\\end{"), env, F.lit("}\n"))
    parts = rows.select("file_name", F.struct("thm_id", each.alias("t")).alias("x"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "")  # one paper's statements
    return parts.groupBy(F.col("file_name").alias("paper_id")).agg(F.concat(F.lit("\\begin{document}\n"), text, F.lit("\\end{document}")).alias("text"))


EXTRACTED = f"""WITH {Q.ST}, r AS (SELECT file_name, thm_id, thm, hyp, row_number() OVER (PARTITION BY file_name ORDER BY thm_id) - 1 AS n FROM st WHERE file_name IS NOT NULL AND thm IS NOT NULL)
    SELECT file_name AS paper_id, CAST(n AS INTEGER) AS at, regexp_replace(thm, '^\\s+|\\s+$', '', 'g') AS thm, regexp_replace(coalesce(hyp, ''), '^\\s+|\\s+$', '', 'g') AS hyp FROM r WHERE length(thm) <= 1800 AND trim(thm) <> ''"""


@query(EXTRACTED)
def statement_extraction(spark, sf_dir):
    return extraction.statements(tex_papers(spark, sf_dir)).drop("kind")


DEFS = f"""{Q.ST}, {Q.PARTS},
    hs AS (SELECT file_name AS paper_id, thm_id, list_filter(list_transform(regexp_split_to_array(hyp, '[.!?;:]\\s+|\\.$|\\n+'), lambda s: trim(s)), lambda s: s <> '') AS l FROM st WHERE hyp IS NOT NULL AND file_name IS NOT NULL),
    hx AS (SELECT paper_id, CAST(thm_id AS BIGINT) * 1000 + i - 1 AS t, l[i] AS sentence FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM hs)),
    df AS (SELECT paper_id, t, sentence, unnest(list_distinct(regexp_extract_all(sentence, '\\$([A-Za-z])\\$', 1))) AS variable FROM hx
           WHERE regexp_matches(sentence, '^(?i:let|fix|denote|suppose|write|we write|throughout|here|consider)\\b') AND length(sentence) <= 270),
    us AS (SELECT file_name AS paper_id, thm_id AS at_, CAST(thm_id AS BIGINT) * 1000 + 999 AS t, unnest(list_distinct(regexp_extract_all(thm, '\\$([A-Za-z])\\$', 1))) AS variable FROM st WHERE thm IS NOT NULL AND file_name IS NOT NULL),
    lt AS (SELECT file_name AS paper_id, thm_id AS at_, unnest(list_filter(list_transform(regexp_split_to_array(thm, '[.!?;:]\\s+|\\.$|\\n+'), lambda s: trim(s)), lambda s: s <> '')) AS sentence FROM st WHERE thm IS NOT NULL AND file_name IS NOT NULL),
    ld AS (SELECT DISTINCT paper_id, at_, unnest(regexp_extract_all(sentence, '\\$([A-Za-z])\\$', 1)) AS variable FROM lt
           WHERE regexp_matches(sentence, '^(?i:let|fix|denote|suppose|write|we write|throughout|here|consider)\\b') AND length(sentence) <= 270),
    uo AS (SELECT us.* FROM us ANTI JOIN ld ON ld.paper_id = us.paper_id AND ld.at_ = us.at_ AND ld.variable = us.variable)"""


@query(f"WITH {DEFS} SELECT uo.paper_id, uo.at_ AS at, uo.variable, df.sentence FROM uo ASOF LEFT JOIN df ON uo.paper_id = df.paper_id AND uo.variable = df.variable AND uo.t >= df.t")
def definition_asof(spark, sf_dir):
    rows = corpus.statements(spark, sf_dir).where("file_name is not null").withColumnRenamed("file_name", "paper_id")
    defined = extraction.definitions(rows.where("hyp is not null").select("paper_id", F.col("thm_id").alias("at"), F.col("hyp").alias("text")))
    uses = rows.where("thm is not null").select("paper_id", F.col("thm_id").alias("at"), F.explode(F.array_distinct(F.regexp_extract_all("thm", F.lit(r"\$([A-Za-z])\$"), F.lit(1)))).alias("variable"))
    local = extraction.definitions(rows.where("thm is not null").select("paper_id", F.col("thm_id").alias("at"), F.col("thm").alias("text")))
    return extraction.attached(uses, defined, local)


@query(
    """SELECT name, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '((?:[a-z-]+ ){0,6}(?:theorem|lemma|conjecture)(?: [a-z-]+){0,7})')) AS name FROM documents)
       WHERE NOT regexp_matches(name, '\\b(?:from|proof|prove\\w*|next)\\b') GROUP BY 1"""
)
def theorem_name_scrape(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select(F.explode(extraction.theorem_names(F.col("text"))).alias("name"))
    return found.groupBy("name").agg(F.count("*").alias("n"))


@query(f"WITH {Q.ST}, b AS (SELECT i AS bundle, i * 500 + 3 AS start FROM (SELECT unnest(range(0, 12)) AS i)) SELECT st.thm_id, CAST(b.bundle AS INTEGER) AS bundle FROM st ASOF LEFT JOIN b ON st.thm_id >= b.start")
def bundle_lookup(spark, sf_dir):
    bundles = spark.range(12).select(F.col("id").cast("int").alias("bundle"), (F.col("id") * 500 + 3).cast("int").alias("start"))
    return readers.bundle_of(table(spark, sf_dir, "thmhyptb").select("thm_id").distinct(), bundles)


@query()
def parse_sections(spark, sf_dir):
    texts = corpus.parts(spark, sf_dir).select(F.concat_ws("/", "thm_id", "part").alias("key"), "text")
    found = parsing.parsed(texts, "key")
    return found.select(F.split("key", "/")[0].cast("int").alias("thm_id"), F.split("key", "/")[1].alias("part"), *found.columns[1:])


@query()
def parse_statistics(spark, sf_dir):
    return parsing.parse_share(parse_sections(spark, sf_dir))


@query()
def recipe_edges(spark, sf_dir):
    return recipes.edges(table(spark, sf_dir, "documents").where("source = 'recipe_notes'"), "doc_id")


@query()
def tex_variables(spark, sf_dir):
    of = F.udf(extraction.variables, "array<string>", useArrow=True)
    formulas = corpus.parts(spark, sf_dir).select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\$([^$]+)\$"), F.lit(1)))).alias("tex")).distinct()
    return formulas.select("tex", of("tex").alias("variables"))


@query(
    """SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"""
)
def event_windows(spark, sf_dir):
    counted = incremental.counted_windows(table(spark, sf_dir, "events"), "ts", "event_type", "value", "1 hour")
    return counted.select("event_type", "start", "n", F.round("total", 4).alias("total"))

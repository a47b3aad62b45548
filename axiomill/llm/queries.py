"""Queries of the training-data operators, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from axiomill.llm import encoding, frequency, names, near_duplicates, neighbours, packing, tokenizer, truncation
from axiomill.session import table


def p1_found(spark, sf_dir):
    pairs = names.variants(table(spark, sf_dir, "authortb"), "author", table(spark, sf_dir, "shortnames"))
    return pairs.select(F.col("a").alias("author_a"), F.col("b").alias("author_b"))


def p1_entities(spark, sf_dir):
    return names.entities(table(spark, sf_dir, "authortb"), "author", table(spark, sf_dir, "shortnames"))


def p2_found(spark, sf_dir):
    return truncation.cut(table(spark, sf_dir, "thmhyptb"), "thm_id", ["thm", "hyp"]).select("thm_id", "field").distinct()


def p2_report(spark, sf_dir):
    return truncation.report(table(spark, sf_dir, "thmhyptb"), "thm_id", ["thm", "hyp"])


def p3_sides(spark, sf_dir):
    """(field, rows) of the two fields."""
    yield "thm", table(spark, sf_dir, "thmhyptb")
    yield "similarthms", table(spark, sf_dir, "similarthmstb")


def p3_found(spark, sf_dir):
    return union(
        near_duplicates.pairs(rows, "thm_id", field).select(F.lit(field).alias("field"), F.col("a").alias("thm_id_a"), F.col("b").alias("thm_id_b"))
        for field, rows in p3_sides(spark, sf_dir)
    )


def p3_groups(spark, sf_dir):
    return union(near_duplicates.groups(rows, "thm_id", field).select(F.lit(field).alias("field"), "*") for field, rows in p3_sides(spark, sf_dir))


def p4_sides(spark, sf_dir):
    yield "thmconcepts", table(spark, sf_dir, "thmconceptstb")
    yield "similarthms", table(spark, sf_dir, "similarthmstb")


def p4_found(spark, sf_dir):
    return union(
        neighbours.neighbour_pairs(rows, "thm_id", field).select(F.lit(field).alias("field"), F.col("a").alias("thm_id_a"), F.col("b").alias("thm_id_b"))
        for field, rows in p4_sides(spark, sf_dir)
    )


def union(parts):
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    return out


def p5_found(spark, sf_dir):
    return p5_counts(spark, sf_dir).where("mark is not null").select("word", "mark")


def p5_counts(spark, sf_dir):
    counts = frequency.word_counts(table(spark, sf_dir, "literalsearchtb"))
    return frequency.marked(counts, table(spark, sf_dir, "thmhyptb"))


def p6_ids(spark, sf_dir):
    return tokenizer.encoded(table(spark, sf_dir, "documents"))


def p7_containers(spark, sf_dir):
    sizes = tokenizer.token_counts(table(spark, sf_dir, "documents"))
    capacities = [(r["pack_name"], r["capacity"]) for r in table(spark, sf_dir, "packsizes").orderBy("capacity", "pack_name").collect()]  # a fixed table of a few rows
    return packing.packed_all(sizes, capacities)


def p8_found(spark, sf_dir):
    return encoding.garbled(table(spark, sf_dir, "documents")).select("doc_id")


def p8_restored(spark, sf_dir):
    return encoding.restored(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_entities, p2_found, p2_report, p3_found, p3_groups, p4_found, p5_found, p5_counts, p6_ids, p7_containers, p8_found, p8_restored)}

#: All pairs of sets that share a value, and what they share; ``v`` holds (field, thm_id, x).
SHARED = """
        z AS (SELECT field, thm_id, count(*) AS n FROM v GROUP BY ALL),
        o AS (SELECT l.field, l.thm_id AS a, r.thm_id AS b, count(*) AS shared
              FROM v AS l JOIN v AS r ON l.field = r.field AND l.x = r.x AND l.thm_id < r.thm_id GROUP BY ALL),
        s AS (SELECT o.field, a, b, shared, za.n AS na, zb.n AS nb FROM o
              JOIN z AS za ON za.field = o.field AND za.thm_id = a JOIN z AS zb ON zb.field = o.field AND zb.thm_id = b)"""

ORACLES = {
    "p3_found": f"""
        WITH v AS (SELECT DISTINCT 'thm' AS field, thm_id, unnest(regexp_extract_all(lower(thm), '[a-z0-9]+')) AS x FROM thmhyptb
                   UNION ALL SELECT DISTINCT 'similarthms', thm_id, CAST(unnest(similarthms) AS VARCHAR) FROM similarthmstb),
        {SHARED}
        SELECT field, a AS thm_id_a, b AS thm_id_b FROM s WHERE shared * 10 >= (na + nb - shared) * 7""",
    "p4_found": f"""
        WITH v AS (SELECT DISTINCT 'thmconcepts' AS field, thm_id, unnest(thmconcepts) AS x FROM thmconceptstb
                   UNION ALL SELECT DISTINCT 'similarthms', thm_id, unnest(similarthms) FROM similarthmstb),
        {SHARED},
        e AS (SELECT field, a, b, shared * shared / (na * nb) AS sim FROM s WHERE shared * shared * 4 >= na * nb),
        d AS (SELECT field, a, b, sim FROM e UNION ALL SELECT field, b, a, sim FROM e),
        k AS (SELECT field, a, b FROM d QUALIFY row_number() OVER (PARTITION BY field, a ORDER BY sim DESC, b) <= 5)
        SELECT DISTINCT field, least(a, b) AS thm_id_a, greatest(a, b) AS thm_id_b FROM k""",
    "p5_found": """
        WITH n AS (SELECT lower(trim(word)) AS word, count(DISTINCT thm_id) AS n
                   FROM (SELECT word, unnest(CASE WHEN len(thm_indices) > 0 THEN thm_indices ELSE [NULL] END) AS thm_id FROM literalsearchtb)
                   WHERE word IS NOT NULL GROUP BY 1),
             a AS (SELECT count(DISTINCT thm_id) AS n_all FROM thmhyptb)
        SELECT word, CASE WHEN n BETWEEN 1 AND 2 THEN 'rare' ELSE 'common' END AS mark
        FROM n, a WHERE n BETWEEN 1 AND 2 OR n * 20 > n_all""",
    "p5_counts": """
        WITH r AS (SELECT lower(trim(word)) AS word, thm_indices AS t, word_indices AS w FROM literalsearchtb WHERE word IS NOT NULL),
             e AS (SELECT word, t, w, unnest(CASE WHEN len(t) > 0 THEN range(1, len(t) + 1) ELSE [NULL] END) AS i FROM r),
             p AS (SELECT word, t[i] AS thm_id, unnest([w[2 * i - 1], w[2 * i]]) AS place FROM e),
             n AS (SELECT word, count(DISTINCT CASE WHEN place >= 0 THEN struct_pack(t := coalesce(thm_id, -1), p := place) END) AS n_occurrences,
                          count(DISTINCT thm_id) AS n_statements FROM p GROUP BY 1),
             a AS (SELECT count(DISTINCT thm_id) AS n_all FROM thmhyptb)
        SELECT word, n_occurrences, n_statements,
               CASE WHEN n_statements BETWEEN 1 AND 2 THEN 'rare' WHEN n_statements * 20 > n_all THEN 'common' END AS mark
        FROM n, a""",
}

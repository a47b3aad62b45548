"""Queries on words, indexes, vocabularies and n-grams of the statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from axiomill.functions import words as W
from axiomill.operators import index, ngrams, vocabulary
from axiomill.plans import sql as Q
from axiomill.session import checkpointed, table

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    """Registers a query, and the SQL that it is checked with."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def statements(spark, sf_dir):
    return index.statements(table(spark, sf_dir, "thmhyptb"))


def parts(spark, sf_dir):
    return index.parts(statements(spark, sf_dir))


def tokens(spark, sf_dir):
    return index.tokens(parts(spark, sf_dir))


def lists(spark, sf_dir):
    return index.token_lists(parts(spark, sf_dir))


def grams(spark, sf_dir):
    """(lists of tokens, words, chosen pairs, chosen triples); the lists are stored, as several counts
    read them."""
    own = checkpointed(lists(spark, sf_dir))
    words = vocabulary.word_frequency(index.placed(own))
    two = ngrams.two_grams(own)
    return own, words, ngrams.chosen_two_grams(two, words), ngrams.chosen_three_grams(ngrams.three_grams(own), two)


def terms(spark, sf_dir):
    own, _, two, three = grams(spark, sf_dir)
    return index.index_terms(own, two.select("ngram").unionByName(three.select("ngram")))


def vocab(spark, sf_dir):
    return vocabulary.scored(vocabulary.numbered(vocabulary.pruned(vocabulary.word_frequency(tokens(spark, sf_dir)))))


@query(Q.q(Q.ST, "SELECT thm_id, thm, hyp, file_name, thm_type, source FROM st"))
def statements_latest(spark, sf_dir):
    return statements(spark, sf_dir).drop("loaded_at")


@query(Q.q(Q.ALL, "SELECT part, count(*) AS n_tokens, count(DISTINCT word) AS n_words, sum(length(word)) AS n_chars, sum(pos) AS sum_pos FROM tok GROUP BY part"))
def tokens_count(spark, sf_dir):
    return tokens(spark, sf_dir).groupBy("part").agg(
        F.count("*").alias("n_tokens"), F.count_distinct("word").alias("n_words"), F.sum(F.length("word")).alias("n_chars"), F.sum("pos").alias("sum_pos")
    )


@query(Q.q(Q.ALL, "SELECT thm_id, part, pos, word FROM tok"))
def token_positions(spark, sf_dir):
    return tokens(spark, sf_dir)


@query(Q.q(f"{Q.ST}, {Q.PARTS}", f"SELECT thm_id, part, list_sort(list_distinct({Q.split_words('text')})) AS words FROM pt"))
def distinct_words(spark, sf_dir):
    return parts(spark, sf_dir).select("thm_id", "part", F.array_sort(W.distinct_words(F.col("text"))).alias("words"))


@query(Q.q(Q.ALL, f"SELECT DISTINCT word, {Q.singular('word')} AS singular FROM tok"))
def singular_forms(spark, sf_dir):
    return tokens(spark, sf_dir).select("word").distinct().select("word", W.singular(F.col("word")).alias("singular"))


@query(Q.q(Q.ALL, f"SELECT word, count(DISTINCT thm_id) AS df FROM tok WHERE {Q.valid('word')} GROUP BY word"))
def stop_filtered_df(spark, sf_dir):
    return tokens(spark, sf_dir).where(ngrams.valid(F.col("word"))).groupBy("word").agg(F.count_distinct("thm_id").alias("df"))


@query(Q.q(f"{Q.ALL}, {Q.FREQ}", "SELECT word, freq FROM fr"))
def word_frequency(spark, sf_dir):
    return vocabulary.word_frequency(tokens(spark, sf_dir))


@query(Q.q(Q.ALL, f"SELECT word, freq, sum(freq) OVER () AS total FROM (SELECT {Q.singular('word')} AS word, count(*) AS freq FROM tok WHERE length(word) >= 3 GROUP BY 1)"))
def corpus_word_frequency(spark, sf_dir):
    return vocabulary.corpus_frequency(tokens(spark, sf_dir))


@query(Q.q(f"{Q.ALL}, {Q.FREQ}", f"SELECT word, freq, {Q.score('freq')} AS score FROM fr"))
def word_score(spark, sf_dir):
    return vocabulary.scored(vocabulary.word_frequency(tokens(spark, sf_dir)))


@query("SELECT f, " + Q.score("f") + " AS score FROM (SELECT unnest(range(0, 500)) AS f)")
def score_steps(spark, sf_dir):
    return spark.range(500).select(F.col("id").alias("f"), W.word_score(F.col("id")).alias("score"))


@query(Q.q(f"{Q.ALL}, {Q.FREQ}, {Q.VOCAB}", "SELECT word, freq, word_idx, score FROM vo"))
def vocab_index(spark, sf_dir):
    return vocab(spark, sf_dir)


@query(Q.q(f"{Q.ALL}, {Q.FREQ}, {Q.VOCAB}", "SELECT word, word_idx, CAST(word_idx // 5000 AS INTEGER) AS shard FROM vo"))
def vocab_shards(spark, sf_dir):
    return vocabulary.shards(vocab(spark, sf_dir)).select("word", "word_idx", "shard")


@query(Q.q(f"{Q.ALL}, {Q.FREQ}", "SELECT CAST(coalesce(floor(sum(freq) / count(*)), 1) AS BIGINT) AS average FROM fr WHERE freq >= 2"))
def average_word_frequency(spark, sf_dir):
    return vocabulary.average_frequency(vocabulary.word_frequency(tokens(spark, sf_dir)))


@query(
    Q.q(
        f"{Q.ALL}, {Q.FREQ}, av AS (SELECT CAST(coalesce(floor(sum(freq) / count(*)), 1) AS BIGINT) AS average FROM fr WHERE freq >= 2)",
        "SELECT word, freq FROM fr UNION ALL SELECT DISTINCT term, average FROM concepts, av WHERE term IS NOT NULL AND term NOT IN (SELECT word FROM fr)",
    )
)
def vocab_completion(spark, sf_dir):
    return vocabulary.completed(vocabulary.word_frequency(tokens(spark, sf_dir)), table(spark, sf_dir, "concepts").select(F.col("term").alias("word")))


@query(
    Q.q(
        f"{Q.ALL}, {Q.FREQ}, av AS (SELECT CAST(coalesce(floor(sum(freq) / count(*)), 1) AS BIGINT) AS average FROM fr WHERE freq >= 2)",
        "SELECT c.term AS word, coalesce(fr.freq, average) AS freq FROM (SELECT DISTINCT term FROM concepts) AS c LEFT JOIN fr ON fr.word = c.term CROSS JOIN av",
    )
)
def vocab_curation(spark, sf_dir):
    return vocabulary.curated(table(spark, sf_dir, "concepts").select(F.col("term").alias("word")), vocabulary.word_frequency(tokens(spark, sf_dir)))


@query(
    Q.q(
        f"""{Q.ALL}, {Q.FREQ}, ow AS (SELECT word, freq, {Q.singular('word')} AS base FROM fr),
        pl AS (SELECT ow.base, sum(ow.freq) AS extra FROM ow JOIN fr AS b ON b.word = ow.base WHERE ow.word <> ow.base GROUP BY 1)""",
        """SELECT fr.word, CAST(CASE WHEN pl.extra IS NOT NULL THEN floor((fr.freq + pl.extra) * 3 / 4) ELSE fr.freq END AS BIGINT) AS freq
           FROM fr LEFT JOIN pl ON pl.base = fr.word
           WHERE fr.word NOT IN (SELECT ow.word FROM ow JOIN fr AS b ON b.word = ow.base WHERE ow.word <> ow.base)""",
    )
)
def plural_merge(spark, sf_dir):
    return vocabulary.merged_plurals(vocabulary.word_frequency(tokens(spark, sf_dir)))


STEMS = f"""{Q.ALL}, {Q.FREQ},
    sp AS (SELECT word, freq, unnest(range(greatest(5, length(word) - 6), length(word) + 1)) AS n FROM fr),
    sx AS (SELECT substr(word, 1, n) AS prefix, substr(word, n + 1, 1) AS next, count(*) AS w, sum(freq) AS f FROM sp GROUP BY 1, 2),
    sc AS (SELECT prefix, CAST(sum(w) AS BIGINT) AS words, count(*) FILTER (next <> '') AS children FROM sx GROUP BY 1
           HAVING count(*) FILTER (next <> '') >= 3 AND coalesce(sum(f) FILTER (next = ''), 0) < floor(sum(f) * 3 / 4) AND max(f) FILTER (next <> '') > floor(sum(f) / 5)),
    sm AS (SELECT f.word, max_by(sc.prefix, length(sc.prefix)) AS stem FROM (SELECT word, unnest(range(5, greatest(5, length(word)) + 1)) AS n FROM fr) AS f
           JOIN sc ON sc.prefix = substr(f.word, 1, f.n) AND f.n <= length(f.word) GROUP BY 1)"""


@query(Q.q(STEMS, "SELECT prefix, words, children FROM sc"))
def stem_prefix_counts(spark, sf_dir):
    return vocabulary.stem_candidates(vocabulary.word_frequency(tokens(spark, sf_dir)))


def stems(spark, sf_dir):
    words = vocabulary.word_frequency(tokens(spark, sf_dir))
    return words, vocabulary.stems(words, vocabulary.stem_candidates(words))


@query(Q.q(STEMS, "SELECT word, stem FROM sm"))
def word_stems(spark, sf_dir):
    return stems(spark, sf_dir)[1]


@query(Q.q(STEMS, "SELECT stem, arg_min(word, (-length(word), word)) AS word FROM sm GROUP BY stem"))
def stem_representatives(spark, sf_dir):
    return vocabulary.stem_representatives(stems(spark, sf_dir)[1])


@query(
    Q.q(
        f"{STEMS}, fm AS (SELECT stem, count(*) AS forms FROM sm GROUP BY stem)",
        """SELECT fr.word, CAST(CASE WHEN floor(forms * 0.75) >= 2 THEN greatest(1, floor(fr.freq / floor(forms * 0.75))) ELSE fr.freq END AS BIGINT) AS freq
           FROM fr LEFT JOIN fm ON fm.stem = fr.word""",
    )
)
def stem_multiplicity(spark, sf_dir):
    words, own = stems(spark, sf_dir)
    return vocabulary.stem_adjusted(words, own)


@query(
    Q.q(
        f"""{Q.ALL}, cf AS (SELECT {Q.singular('word')} AS word, count(*) AS freq FROM tok WHERE length(word) >= 3 GROUP BY 1),
        sf AS (SELECT {Q.singular('w')} AS word, count(*) AS freq FROM (SELECT unnest({Q.split_words('text')}) AS w FROM documents) WHERE regexp_matches(w, '^[a-z]{{3,}}$') GROUP BY 1)""",
        """SELECT sf.word FROM sf LEFT JOIN cf ON cf.word = sf.word CROSS JOIN (SELECT sum(freq) AS total FROM cf) AS c CROSS JOIN (SELECT sum(freq) AS stock FROM sf) AS s
           WHERE cf.freq IS NULL OR cf.freq / total < 2 * sf.freq / stock""",
    )
)
def true_fluff(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select(F.explode(W.split_words(F.col("text"))).alias("w")).where(F.col("w").rlike(r"^[a-z]{3,}\z"))
    stock = own.groupBy(W.singular(F.col("w")).alias("word")).agg(F.count("*").alias("freq"))
    total = stock.agg(F.sum("freq")).first()[0]
    return vocabulary.fluff(vocabulary.corpus_frequency(tokens(spark, sf_dir)), stock, total or 1)


@query(Q.q(f"{Q.ALL}, {Q.NEAR}, {Q.TWO}", "SELECT w0, w1, freq FROM two"))
def bigram_counts(spark, sf_dir):
    return ngrams.two_grams(lists(spark, sf_dir))


@query(
    Q.q(f"{Q.ALL}, {Q.NEAR}, {Q.TWO}", "SELECT w0, count(*) AS n_next, CAST(sum(freq) AS BIGINT) AS total, CAST(floor(sum(freq) / count(*) + 0.5) AS BIGINT) AS average FROM two GROUP BY w0")
)
def bigram_average_follow(spark, sf_dir):
    return ngrams.average_follow(ngrams.two_grams(lists(spark, sf_dir)))


@query(Q.q(Q.GRAMS, "SELECT ngram, freq FROM tc"))
def bigram_selection(spark, sf_dir):
    return grams(spark, sf_dir)[2]


@query(Q.q(f"{Q.ALL}, {Q.NEAR}, {Q.THREE}", "SELECT w0, w1, w2, freq FROM three"))
def trigram_counts(spark, sf_dir):
    return ngrams.three_grams(lists(spark, sf_dir))


@query(Q.q(Q.GRAMS, "SELECT ngram, freq FROM hc"))
def trigram_selection(spark, sf_dir):
    return grams(spark, sf_dir)[3]


@query(
    Q.q(
        f"{Q.ALL}, {Q.NEAR}",
        f"""SELECT w0 || ' ' || w1 || ' ' || w2 || ' ' || w3 AS ngram, count(*) AS freq FROM nr WHERE w3 IS NOT NULL AND {Q.valid('w0')} AND {Q.valid('w3')}
            AND regexp_matches(w1, '^[a-z]+$') AND regexp_matches(w2, '^[a-z]+$') AND NOT regexp_matches(w0, '(ed|ing)$') AND NOT regexp_matches(w3, '(ed|ing|ly)$')
            GROUP BY 1 HAVING count(*) >= 2""",
    )
)
def ngram4_mining(spark, sf_dir):
    return ngrams.entity_ngrams(lists(spark, sf_dir))


@query(
    Q.q(
        Q.GRAMS,
        """SELECT word, freq FROM fr UNION ALL SELECT ngram, CAST(floor(freq * (2.3e0 / 3)) AS BIGINT) AS freq FROM tc WHERE floor(freq * (2.3e0 / 3)) >= 2
           UNION ALL SELECT ngram, CAST(floor(freq * (3.8e0 / 5)) AS BIGINT) FROM hc WHERE floor(freq * (3.8e0 / 5)) >= 2""",
    )
)
def ngram_frequency_injection(spark, sf_dir):
    _, words, two, three = grams(spark, sf_dir)
    return vocabulary.with_ngrams(words, two, three)


@query(Q.q(Q.GRAMS, "SELECT DISTINCT string_split(ngram, ' ')[1] AS word FROM tc"))
def ngram_first_words(spark, sf_dir):
    return ngrams.first_words(grams(spark, sf_dir)[2])


@query(
    Q.q(
        f"""{Q.GRAMS}, ph AS (SELECT regexp_split_to_array(lower(trim(title)), '\\s+') AS w FROM papers WHERE title IS NOT NULL),
        ad AS (SELECT DISTINCT array_to_string(w[-2:], ' ') AS ngram FROM ph WHERE len(w) >= 2)""",
        "SELECT ngram, max(freq) AS freq FROM (SELECT ngram, freq FROM tc UNION ALL SELECT ngram, (SELECT CAST(floor(avg(freq)) AS BIGINT) FROM tc) FROM ad) GROUP BY 1",
    )
)
def ngram_augmentation(spark, sf_dir):
    titles = table(spark, sf_dir, "papers").select(F.col("title").alias("ngram"))
    return ngrams.augmented(grams(spark, sf_dir)[2], titles, 2)


@query(Q.q(f"{Q.GRAMS}, {Q.TERMS}, {Q.POSTINGS}", "SELECT word, thm_id, part, positions FROM pe"))
def inverted_index(spark, sf_dir):
    return index.all_postings(terms(spark, sf_dir))


@query(Q.q(f"{Q.GRAMS}, {Q.TERMS}, {Q.POSTINGS}", "SELECT word, thm_id, part, positions FROM ps"))
def posting_dedupe_stm_over_hyp(spark, sf_dir):
    return index.postings(terms(spark, sf_dir))


@query(Q.q(f"{Q.ST}, {Q.PARTS}, {Q.LITERAL}", "SELECT word, thm_id, positions FROM li"))
def literal_postings_top2(spark, sf_dir):
    return index.literal_postings(parts(spark, sf_dir))


@query(Q.q(f"{Q.ST}, {Q.PARTS}, {Q.LITERAL}", "SELECT word, list_sort(list(thm_id))[1:300] AS thm_indices FROM li GROUP BY word"))
def literal_cap300(spark, sf_dir):
    return index.folded_lists(index.capped(index.literal_postings(parts(spark, sf_dir))))


@query("SELECT thm_id, CAST(floor(thm_id / 100000) AS INTEGER) AS bundle FROM (SELECT DISTINCT thm_id FROM thmhyptb)")
def vector_bundles(spark, sf_dir):
    return index.rebundled(table(spark, sf_dir, "thmhyptb").select("thm_id").distinct())


@query(
    """WITH b AS (SELECT source AS bundle, row_number() OVER (PARTITION BY source ORDER BY thm_id) - 1 AS local_id FROM (SELECT DISTINCT source, thm_id FROM thmhyptb)),
            s AS (SELECT bundle, max(local_id) + 1 AS n FROM b GROUP BY 1),
            o AS (SELECT bundle, coalesce(sum(n) OVER (ORDER BY bundle ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM s)
       SELECT b.bundle, local_id, CAST(local_id + off AS BIGINT) AS thm_id FROM b JOIN o USING (bundle)"""
)
def bundle_reindex(spark, sf_dir):
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "thmhyptb").select(F.col("source").alias("bundle"), "thm_id").distinct()
    local = (F.row_number().over(Window.partitionBy("bundle").orderBy("thm_id")) - 1).cast("bigint")
    return index.reindexed(rows.select("bundle", local.alias("local_id")))

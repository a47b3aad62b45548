"""Ranked search for a batch of queries.

Queries are a table, so a thousand queries are one join with the postings and not a loop. A token
covers one to three places of its query; for a statement, each place belongs to the rarest token
that covers it and matches, and a token scores if it owns a place. That makes the score one ranking
window and two sums (no fold over tokens).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axiomill.functions import words as W
from axiomill.operators import index, matching
from axiomill.operators import ngrams as grams
from axiomill.session import checkpointed

#: Fixed values of the ranking.
NEAREST, CAP, RELATED, NO_POSITION = 60, 400, 4, 127
#: Rows of a lookup that is broadcast.
SMALL = 100_000
#: The share of a token's score that a related word has.
RELATED_SHARE = 0.62


def query_tokens(queries: DataFrame, ngrams: DataFrame) -> DataFrame:
    """``query_id, word, pos, n``: tokens of each query text with their first place and length.

    A repeated token counts at its first place. Leading "theorem" or "lemma" is left out.
    """
    text = F.regexp_replace(F.lower("text"), r"^\s*(?:theorem|lemma)", "")
    texts = queries.select(F.col("query_id").alias("thm_id"), F.lit("Q").alias("part"), text.alias("text")).where("text is not null")
    terms = index.index_terms(index.token_lists(texts), ngrams)
    first = terms.groupBy(F.col("thm_id").alias("query_id"), "word").agg(F.min("pos").alias("pos"))
    return first.withColumn("n", F.size(F.split("word", " ")))


def asked_runs(own: DataFrame, texts: DataFrame) -> DataFrame:
    """``thm_id, part, pos, w0, w1, w2``: runs of the lists ``own`` from words that another word
    follows in ``texts``."""
    starts = index.runs(texts, 2).where("w1 is not null").select("w0").distinct()
    return index.runs(own, 3).where("w1 is not null").join(looked_up(starts), "w0", "left_semi")


def asked_grams(runs: DataFrame, words: DataFrame, texts: DataFrame) -> DataFrame:
    """``ngram, freq``: of the pairs and triples that are chosen, those of ``texts``.

    Whether one is chosen follows from the runs with its first word and, of a triple, from those with
    its middle word; each of them is followed by a word in ``texts`` too, so :func:`asked_runs` will do.
    """
    phrases = index.runs(texts, 3).select(F.explode(F.array(*(F.when(F.col(f"w{n}").isNotNull(), F.concat_ws(" ", *(f"w{i}" for i in range(n + 1)))) for n in (1, 2)))).alias("phrase"))
    wanted = phrases.where("phrase is not null").select(W.singular_last(F.col("phrase")).alias("ngram")).distinct()
    runs = checkpointed(runs.groupBy("w0", "w1", "w2").agg(F.count("*").alias("n")))
    two = checkpointed(grams.counted_two(runs))
    chosen = grams.chosen_two_grams(two, words).unionByName(grams.chosen_three_grams(grams.counted_three(runs.where("w2 is not null")), two))
    return chosen.join(wanted, "ngram", "left_semi")


def looked_up(rows: DataFrame, most: int = SMALL) -> DataFrame:
    """``rows``, stored; a join with them moves nothing else if they are counted to be few."""
    stored = checkpointed(rows)
    return F.broadcast(stored) if stored.count() <= most else stored


def scored_tokens(tokens: DataFrame, words: DataFrame, ngrams: DataFrame, postings: DataFrame) -> DataFrame:
    """``query_id, word, pos, n, score, rank``: rank 1 is the token with the fewest statements.

    Words without a frequency get the least score; an n-gram at least one more than its words.
    """
    parts = tokens.select("query_id", "word", F.posexplode(F.split("word", " ")).alias("i", "w"))
    single = words.select(F.col("word").alias("w"), W.word_score(F.col("freq")).alias("s"))
    sums = parts.select("query_id", "word", W.singular(F.col("w")).alias("w")).join(single, "w", "left").groupBy("query_id", "word").agg(F.sum(F.coalesce("s", F.lit(3))).alias("total"))
    own = ngrams.select(F.col("ngram").alias("word"), W.word_score(F.col("freq")).alias("g"))
    df = postings.groupBy("word").agg(F.count("*").alias("df"))
    both = tokens.join(sums, ["query_id", "word"]).join(own, "word", "left").join(df, "word", "left")
    score = F.when(F.col("n") == 1, F.col("total")).otherwise(W.ngram_score(F.coalesce("g", F.lit(3)), F.col("total")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.coalesce("df", F.lit(0)), "word"))
    return both.select("query_id", "word", "pos", "n", score.cast("bigint").alias("score"), rank.alias("rank"))


def expanded(tokens: DataFrame, related: DataFrame) -> DataFrame:
    """Tokens with up to four related words each: ``term`` is what is looked up, ``weight`` its score.

    ``related(word, rank, related_word)``; a related word weighs 0.62 of its token, rounded up, and
    at least one less than it, but never less than 1.
    """
    own = tokens.select("*", F.col("word").alias("term"), F.col("score").alias("weight"))
    few = related.where(F.col("rank") <= RELATED).select("word", F.col("related_word").alias("term"))
    less = F.ceil(F.col("score") * RELATED_SHARE)
    weight = F.greatest(F.lit(1), F.when(less == F.col("score"), less - 1).otherwise(less)).cast("bigint")
    return own.unionByName(tokens.join(few, "word").where("term <> word").select(*tokens.columns, "term", weight.alias("weight")))


def hits(tokens: DataFrame, postings: DataFrame) -> DataFrame:
    """``query_id, thm_id, word, pos, n, rank, score, part, positions``: one row for each query token
    and statement; the token's own posting goes before those of related words.

    Without a ``term`` column tokens are looked up as they are. Rows are partitioned by query and
    statement, which is all that the scores and distances group by: none of them shuffles again.
    """
    own = ["query_id", "thm_id", "word", "pos", "n", "rank"]
    if "term" not in tokens.columns:
        return tokens.join(postings, "word").select(*own, "score", "part", "positions").repartition("query_id", "thm_id")
    met = tokens.join(postings.withColumnRenamed("word", "term"), "term").repartition("query_id", "thm_id")
    best = F.max(F.struct("weight", F.col("term").alias("term"), "part", "positions"))
    return met.groupBy(*own).agg(best.alias("b")).select(*own, F.col("b.weight").alias("score"), "b.part", "b.positions")


def intersection(hits_: DataFrame) -> DataFrame:
    """``query_id, thm_id, score, span``: see the module."""
    covered = hits_.select("query_id", "thm_id", "word", "rank", "score", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("n") - 1)).alias("p"))
    owner = F.row_number().over(Window.partitionBy("query_id", "thm_id", "p").orderBy("rank"))
    owned = covered.withColumn("r", owner).where("r = 1").groupBy("query_id", "thm_id", "word").agg(F.max("score").alias("score"), F.count("*").alias("span"))
    return owned.groupBy("query_id", "thm_id").agg(F.sum("score").alias("score"), F.sum("span").alias("span"))


def span_statistics(scores: DataFrame) -> DataFrame:
    return scores.groupBy("query_id").agg(F.max("span").alias("max_span"), F.count("*").alias("n_statements"))


def span_bonus(scores: DataFrame) -> DataFrame:
    return scores.select("query_id", "thm_id", (F.col("score") + 2 * F.col("span")).alias("score"))


def distance_points(word: Column, gap: Column) -> Column:
    """2 for the next place, 1 for the two after it, and 2 more for each blank in the word."""
    near = F.when(gap == 1, 2).when(gap.isin(2, 3), 1).otherwise(0)
    return near + 2 * (F.length(word) - F.length(F.replace(word, F.lit(" "), F.lit(""))))


def word_distance(hits_: DataFrame) -> DataFrame:
    """``query_id, thm_id, dist, first_pos``: how near matched words stand to each other.

    Places of a part are ordered; each word counts its best gap to the place before it. A part needs
    two places; one generic word alone gives 0. ``first_pos`` is the first place in the statement.
    """
    spots = hits_.select("query_id", "thm_id", "part", "word", "rank", F.explode("positions").alias("at"))
    one = spots.groupBy("query_id", "thm_id", "part", "at").agg(F.max(F.struct("rank", "word")).alias("w")).select("query_id", "thm_id", "part", "at", "w.word")
    window = Window.partitionBy("query_id", "thm_id", "part").orderBy("at")
    gaps = one.select("*", (F.col("at") - F.lag("at").over(window)).alias("gap"))
    points = gaps.withColumn("points", F.when(F.col("gap").isNull(), 0).otherwise(distance_points(F.col("word"), F.col("gap"))))
    words = points.groupBy("query_id", "thm_id", "part", "word").agg(F.max("points").alias("points"), F.count("*").alias("n"), F.min("at").alias("at"))
    generic = (F.count("*") == 1) & F.min("word").isin(*W.GENERIC_TERMS)
    parts = words.groupBy("query_id", "thm_id", "part").agg(
        F.when((F.sum("n") < 2) | generic, 0).otherwise(F.sum("points")).alias("dist"), F.when(F.sum("n") >= 2, F.min("at")).otherwise(NO_POSITION).alias("first_pos")
    )
    return parts.groupBy("query_id", "thm_id").agg(
        F.sum("dist").cast("bigint").alias("dist"), F.coalesce(F.min(F.when(F.col("part") == "T", F.col("first_pos"))), F.lit(NO_POSITION)).cast("int").alias("first_pos")
    )


def hyp_penalty(distances: DataFrame) -> DataFrame:
    """Matches in the hypotheses alone lose a quarter of more than 7 points, else one."""
    less = F.when(F.col("dist") > 7, F.floor(F.col("dist") / 4)).otherwise(F.lit(1))
    return distances.withColumn("dist", F.when(F.col("first_pos") == NO_POSITION, F.col("dist") - less).otherwise(F.col("dist")).cast("bigint"))


def two_stage(scores: DataFrame, hits_: DataFrame, nearest: int = NEAREST, cap: int = CAP) -> DataFrame:
    """``query_id, thm_id, score, span, dist, first_pos, generic, rn``: the best statements of each query.

    Stage 1 keeps ``nearest`` by span, and up to ``cap`` with the first one's score; stage 2 orders them
    by score, span, distance points, first place and id. Distances are found for what stage 1 kept
    only; matches in the hypotheses alone lose some. ``generic``: one generic word is all that matched.
    """
    one = Window.partitionBy("query_id").orderBy(F.desc("span"), F.desc("score"), "thm_id")
    # Two ranking filters: the outer bound is applied to each task's rows before the shuffle.
    ranked = scores.withColumn("r1", F.row_number().over(one)).where(F.col("r1") <= cap)
    first = F.max(F.when(F.col("r1") == 1, F.col("score"))).over(Window.partitionBy("query_id"))
    kept = ranked.withColumn("top", first).where((F.col("r1") <= nearest) | (F.col("score") == F.col("top"))).drop("r1", "top")
    near = hits_.join(kept.select("query_id", "thm_id"), ["query_id", "thm_id"], "left_semi")
    alone = near.groupBy("query_id", "thm_id").agg(((F.min("word") == F.max("word")) & F.min("word").isin(*W.GENERIC_TERMS)).alias("generic"))
    full = kept.join(hyp_penalty(word_distance(near)), ["query_id", "thm_id"], "left").join(alone, ["query_id", "thm_id"], "left")
    full = full.select("query_id", "thm_id", "score", "span", F.coalesce("dist", F.lit(0)).alias("dist"), F.coalesce("first_pos", F.lit(NO_POSITION)).alias("first_pos"), "generic")
    return second_stage(full)


def second_stage(full: DataFrame) -> DataFrame:
    two = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("span"), F.desc("dist"), "first_pos", "thm_id")
    return full.withColumn("rn", F.row_number().over(two))


def ranked(tokens: DataFrame, postings: DataFrame, nearest: int = NEAREST, cap: int = CAP) -> DataFrame:
    """As :func:`two_stage` of all hits, of which only the best leave the task that finds them."""
    return matching.best_scores(tokens, postings, nearest, cap)


def reranked(tokens: DataFrame, postings: DataFrame, size: int = 10, nearest: int = NEAREST, cap: int = CAP) -> DataFrame:
    """``query_id, thm_id, rn``: :func:`ranked`, by :func:`windowed_rerank` of distance points."""
    return matching.best_reordered(tokens, postings, nearest, cap, size)


def pruned(ranked: DataFrame, n_words: DataFrame, most: int = NEAREST) -> DataFrame:
    """At most ``most`` results before the first bad one.

    A result of less span than the top is bad if it has less than half the top's score (in whole
    numbers), or if one generic word is all that matched; one of the same span is bad if that span is
    1, the query has several words and the one that matched is generic. ``n_words(query_id, n_words)``.
    """
    window = Window.partitionBy("query_id")
    top = ranked.select("*", F.max(F.when(F.col("rn") == 1, F.col("span"))).over(window).alias("ts"), F.max(F.when(F.col("rn") == 1, F.col("score"))).over(window).alias("tc"))
    less = (F.col("span") < F.col("ts")) & ((F.col("score") < F.floor(F.col("tc") / 2)) | ((F.col("span") == 1) & F.col("generic")))
    same = (F.col("span") >= F.col("ts")) & (F.col("ts") == 1) & (F.coalesce("n_words", F.lit(0)) > 1) & F.col("generic")
    cut = top.join(n_words, "query_id", "left").withColumn("cut", F.min(F.when(less | same, F.col("rn"))).over(window))
    return cut.where((F.col("rn") <= most) & (F.col("cut").isNull() | (F.col("rn") < F.col("cut")))).select(*ranked.columns)


def words_of(queries: DataFrame) -> DataFrame:
    """``query_id, n_words``: the different words of a query."""
    return queries.where("text is not null").select("query_id", F.size(W.distinct_words(F.col("text"))).alias("n_words"))


def early_pruned(hits_: DataFrame, tokens: DataFrame, selected: int = NEAREST) -> DataFrame:
    """Hits without statements that first match after tokens of half the total score, where at least
    ``selected`` statements match before."""
    order = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spent = tokens.select("query_id", "rank", F.sum("score").over(order).alias("spent"), F.sum("score").over(Window.partitionBy("query_id")).alias("total"))
    late = spent.select("query_id", "rank", (F.col("spent") - 0 > F.col("total") / 2).alias("late"))
    marked = hits_.join(late, ["query_id", "rank"])
    early = marked.where("not late").select("query_id", "thm_id").distinct()
    enough = early.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= selected).select("query_id", F.lit(True).alias("enough"))
    both = marked.join(early.withColumn("early", F.lit(True)), ["query_id", "thm_id"], "left").join(enough, "query_id", "left")
    return both.where(F.col("enough").isNull() | F.col("early").isNotNull()).select(*hits_.columns)


def restricted(hits_: DataFrame, statements: DataFrame) -> DataFrame:
    """Only the hits, or the postings before they are looked up, of a set of statements, e.g. an author's."""
    return hits_.join(statements.select("thm_id").distinct(), "thm_id", "left_semi")


def literal_search(queries: DataFrame, literal: DataFrame, least: int = 1) -> DataFrame:
    """``query_id, thm_id, score``: distance points of the valid words plus their number of places."""
    found = queries.where("text is not null").select("query_id", F.posexplode(W.split_words(F.col("text"))).alias("rank", "raw"))
    words = found.where(W.is_literal_word(F.col("raw"))).groupBy("query_id", W.singular(F.col("raw")).alias("word")).agg(F.min("rank").alias("rank"))
    met = words.join(literal, "word").select("query_id", "thm_id", F.lit("T").alias("part"), "word", "rank", "positions")
    points = word_distance(met)
    places = met.groupBy("query_id", "thm_id").agg(F.sum(F.size("positions")).alias("places"))
    return points.join(places, ["query_id", "thm_id"]).select("query_id", "thm_id", (F.col("dist") + F.col("places")).alias("score")).where(F.col("score") >= least)


def literal_wanted(span: Column, n_words: Column) -> Column:
    """Whether the intersection covers too little of a query and the literal index is to be asked."""
    return F.when(n_words == 2, span < 2).when(n_words > 7, F.try_divide(span, n_words) < 0.4).otherwise(F.try_divide(span, n_words) < 0.5)


def context_rerank(ranked: DataFrame, query_pairs: DataFrame, pairs: DataFrame, weight: float = 0.95) -> DataFrame:
    """``query_id, thm_id, context, rn``: two points for each pair (child word, parent word) with a
    parent that query and statement share, then by context + ``weight`` * score."""
    shared = query_pairs.where("parent > 0").join(pairs, ["child", "parent"]).groupBy("query_id", "thm_id").agg((2 * F.count("*")).alias("context"))
    both = ranked.join(shared, ["query_id", "thm_id"], "left").withColumn("context", F.coalesce("context", F.lit(0)).cast("bigint"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round(F.col("context") + weight * F.col("score"), 6)), "thm_id")
    return both.select("query_id", "thm_id", "context", F.row_number().over(order).alias("rn"))


def relation_rerank(ranked: DataFrame, query_bits: DataFrame, bits: DataFrame) -> DataFrame:
    """``query_id, thm_id, missing, rn``: by how many of the query's relation bits a statement lacks."""
    both = ranked.join(query_bits.withColumnRenamed("bits", "query_bits"), "query_id").join(bits, "thm_id", "left")
    missing = F.size(F.array_except("query_bits", F.coalesce("bits", F.array().cast("array<bigint>")))).cast("bigint")
    order = Window.partitionBy("query_id").orderBy("missing", "thm_id")
    return both.select("query_id", "thm_id", missing.alias("missing")).withColumn("rn", F.row_number().over(order))


def windowed_rerank(ranked: DataFrame, by: list[Column], size: int = 10) -> DataFrame:
    """Reranks within consecutive windows of ``size`` results; places of windows don't change."""
    window = F.floor((F.col("rn") - 1) / size)
    order = Window.partitionBy("query_id", window).orderBy(*by, "thm_id")
    return ranked.withColumn("rn", (window * size + F.row_number().over(order)).cast("int"))


def fused(first: DataFrame, second: DataFrame, n_words: DataFrame, most: int = NEAREST) -> DataFrame:
    """``query_id, thm_id, score, rn``: two ranked lists as one.

    A result of the first list keeps its place i if its span reaches the query's threshold (all
    words of two, all but one of five, else two thirds); otherwise the places in both lists add up,
    or the other list's length is added. Results of the second list alone follow the first's length.
    The first list's top leads if the fused top isn't in that list, or of less than four fifths of its
    span, and has less score.
    """
    a = first.select("query_id", "thm_id", "span", F.col("score").alias("weight"), (F.col("rn") - 1).alias("i"))
    b = second.select("query_id", "thm_id", (F.col("rn") - 1).alias("j"))
    len_a, len_b = (x.groupBy("query_id").agg(F.count("*").alias(n)) for x, n in ((a, "len_a"), (b, "len_b")))
    n = F.col("n_words")
    threshold = F.when(n < 3, n).when(n < 6, n - 1).otherwise(n - F.floor(n / 3))
    both = a.join(b, ["query_id", "thm_id"], "full_outer").join(n_words, "query_id").join(len_a, "query_id", "left").join(len_b, "query_id", "left")
    score = (
        F.when(F.col("i").isNull(), F.col("j") + F.coalesce("len_a", F.lit(0)))
        .when(F.col("span") >= threshold, F.col("i"))
        .when(F.col("j").isNotNull(), F.col("i") + F.col("j"))
        .otherwise(F.col("i") + F.coalesce("len_b", F.lit(0)))
    )
    window = Window.partitionBy("query_id")
    placed = both.withColumn("fused", score.cast("bigint"))
    top = F.first(F.struct("i", "span", "weight")).over(window.orderBy("fused", "thm_id"))
    best = F.max(F.when(F.col("i") == 0, F.struct("span", "weight"))).over(window)
    met = placed.withColumn("top", top).withColumn("best", best)
    weak = F.col("top.i").isNull() | (F.col("top.span") < F.col("best.span") * 0.8)
    lighter = F.col("top.weight").isNull() | (F.col("top.weight") < F.col("best.weight"))
    promoted = F.coalesce((F.col("i") == 0) & weak & lighter, F.lit(False))
    order = window.orderBy(F.desc(promoted), "fused", "thm_id")
    return met.select("query_id", "thm_id", F.col("fused").alias("score"), F.row_number().over(order).alias("rn")).where(F.col("rn") <= most)


def read_queries(queries: DataFrame) -> DataFrame:
    """``query_id, text, mode, most``: a leading "context" or "relation" is the mode of reranking, a
    leading number how many results are wanted; the rest, in lower case, is what is searched for."""
    low = queries.where("text is not null").withColumn("text", F.lower("text"))
    mode = F.regexp_extract("text", r"^\s*(context|relation)\s+\S", 1)
    rest = F.regexp_replace("text", r"^\s*(?:context|relation)\s+(?=\S)", "")
    split = low.withColumn("mode", mode).withColumn("text", rest)
    most = F.regexp_extract("text", r"^\s*(\d{1,6})\s+\S", 1)
    return split.select("query_id", F.regexp_replace("text", r"^\s*\d{1,6}\s+(?=\S)", "").alias("text"), "mode", F.when(most == "", NEAREST).otherwise(most.try_cast("int")).alias("most"))


def combined(
    queries: DataFrame, words: DataFrame, ngrams: DataFrame, postings: DataFrame, literal: DataFrame, nearest: DataFrame | None = None,
    pairs: tuple[DataFrame, DataFrame] | None = None, bits: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """``query_id, thm_id, origin, rn``: a whole search for each of a batch of queries as typed.

    1. Words and n-grams are intersected, ranked in two stages and pruned (origin 'words').
    2. In the modes "context" and "relation" these results are reranked, by ``pairs`` (of queries and of
       statements) or ``bits``; without them, or for one word, the order stays.
    3. Where the intersection covers too little of a query, literal hits follow ('literal').
    4. Where nothing was found, ``nearest(query_id, thm_id, rn)``, if given, stands in ('vectors').

    Blank queries have no results.
    """
    asked = read_queries(queries)
    # Stored: both are bounded by the queries, and several of the following steps read them.
    tokens = checkpointed(scored_tokens(query_tokens(asked, ngrams), words, ngrams, postings))
    met = hits(tokens, postings)
    counted = words_of(asked)
    found = checkpointed(pruned(two_stage(intersection(met), met), counted))
    for mode, rerank, given in (("context", context_rerank, pairs), ("relation", relation_rerank, bits)):
        if given is not None:
            several = asked.where(F.col("mode") == mode).join(counted.where("n_words > 1"), "query_id", "left_semi").select("query_id")
            again = rerank(found.join(several, "query_id", "left_semi"), *given).select("query_id", "thm_id", F.col("rn").alias("again"))
            found = found.join(again, ["query_id", "thm_id"], "left").withColumn("rn", F.coalesce("again", "rn")).drop("again")
    covered = found.groupBy("query_id").agg(F.max("span").alias("span"))
    wanting = counted.join(covered, "query_id", "left").where(literal_wanted(F.coalesce("span", F.lit(0)), F.col("n_words"))).select("query_id")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "thm_id"))
    literally = literal_search(asked.join(wanting, "query_id", "left_semi"), literal).withColumn("rn", order)
    parts = [found.select("query_id", "thm_id", F.lit("words").alias("origin"), "rn"), literally.select("query_id", "thm_id", F.lit("literal").alias("origin"), "rn")]
    if nearest is not None:
        parts.append(nearest.join(parts[0].unionByName(parts[1]).select("query_id"), "query_id", "left_anti").select("query_id", "thm_id", F.lit("vectors").alias("origin"), "rn"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    place = F.when(F.col("origin") == "words", 0).when(F.col("origin") == "literal", 1).otherwise(2)
    once = every.groupBy("query_id", "thm_id").agg(F.min(F.struct(place.alias("p"), "rn", "origin")).alias("b")).select("query_id", "thm_id", "b.*")
    last = F.row_number().over(Window.partitionBy("query_id").orderBy("p", "rn", "thm_id"))
    return once.withColumn("rn", last).join(asked.select("query_id", "most"), "query_id").where("rn <= most").select("query_id", "thm_id", "origin", "rn")


def in_given_order(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of listed ids (``thm_id, rank``), in the list's order."""
    return rows.join(ids, "thm_id").orderBy("rank")


def tagged_words(queries: DataFrame) -> DataFrame:
    """``query_id, pos, word, part, extra``: words of a query as of a hypothesis (H) or statement (T).

    A trigger word (assume, let, if ..) starts a hypothesis, punctuation ends it; trigger words aren't
    kept. Of a clause after where, if or when with a concluding verb (is, are, has, have) the words
    count for the statement, with one extra point. Clauses are the parts between punctuation, so a
    clause's rows are one window.
    """
    clauses = queries.where("text is not null").select("query_id", F.posexplode(F.split(F.lower("text"), r"[.,;:!?]")).alias("clause", "c"))
    each = clauses.select("query_id", "clause", F.posexplode(F.filter(F.split("c", r"\s+"), lambda w: w != "")).alias("at", "word"))
    trigger = F.col("word").isin("assume", "denote", "define", "let", "suppose", "where", "if", "when", "given")
    window = Window.partitionBy("query_id", "clause").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(trigger, F.col("word")), True).over(window)
    marked = each.withColumn("trigger", last).where(~trigger)
    concluding = F.max((F.col("word").isin("is", "are", "has", "have") & F.col("trigger").isin("where", "if", "when")).cast("int")).over(Window.partitionBy("query_id", "clause", "trigger"))
    out = marked.withColumn("conclusion", F.coalesce(concluding, F.lit(0)))
    part = F.when(F.col("trigger").isNull() | (F.col("conclusion") == 1), "T").otherwise("H")
    return out.select("query_id", (F.col("clause") * 1000 + F.col("at")).alias("pos"), "word", part.alias("part"), F.when(F.col("trigger").isNotNull(), F.col("conclusion")).otherwise(0).alias("extra"))

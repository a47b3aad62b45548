"""Queries on texts, matrices, similar statements, vectors and classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from axiomill.functions import codec, markup
from axiomill.functions import words as W
from axiomill.operators import classes, index, lsa, matrix, search, similar, vocabulary
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


PT = f"{Q.ST}, {Q.PARTS}"


# What a look-ahead or look-behind keeps is put aside first, as DuckDB's patterns have neither.
KEPT = "replace(replace(replace({}, '\\dfrac', chr(3)), '\\ite', chr(4)), '\\%', chr(5))"
RESTORED = "replace(replace(replace({}, chr(3), '\\dfrac'), chr(4), '\\ite'), chr(5), '\\%')"
FORMATTING = (
    r"(?i)\\df|\\emph|\\em|\\rm |\\cat|\\it|\\eqref|\\subsection|\\section|\\bf|\\vspace|\\ensuremath|\\(?:textbf|textsl|textsc|textnormal)|\\linebreak|%"
    r"|\\fml|\\ofml|\\(?:begin|end)\{enumerate\}|\\(?:begin|end)\{(?:sub)*section\**\}|\\begin\{slogan\}|\\end\{slogan\}|\\sbsb|\\cat|\\bs|\\maketitle|\\textup"
    r"|\\section\**\{(?:[^}]*)\}\s*|\\noindent|\\(?:small|big)skip|\\cite\{[^}]+\}|\\cite\[[^\]]+\]|\\par\s|\\(?:begin|end)\{displaymath\}"
)
STATEMENT_ENDS = r"(?i)\\(?:begin|end)\{(?:def|lem|th|pr|co|re)[^}]*\}\s*"
HYPOTHESIS = "(?:assume|denote|define|let|is said|suppose|where|is called|if|given)."
KINDS = (("def", "Definition"), ("conj", "Conjecture"), ("cor", "Corollary"), ("proclaim", "Claim"), ("lem", "Lemma"), ("prop", "Proposition"), ("theo", "Theorem"), ("thm", "Theorem"))


@query(
    f"""WITH {PT}, a AS (SELECT thm_id, part, {RESTORED.format(f"regexp_replace({KEPT.format('c')}, '{FORMATTING}', '', 'g')")} AS f FROM (SELECT thm_id, part, regexp_replace(text, '\\\\index\\{{[^}}]*\\}}%*', '', 'g') AS c FROM pt))
        SELECT thm_id, part, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(f, '{STATEMENT_ENDS}', '', 'g'), '\\\\item\\b', ' -', 'g'), '([<>])', ' \\1 ', 'g'), '\\s+', ' ', 'g')) AS cleaned FROM a"""
)
def text_cleanup(spark, sf_dir):
    return corpus.parts(spark, sf_dir).select("thm_id", "part", markup.cleaned(F.col("text")).alias("cleaned"))


@query(f"WITH {Q.ST} SELECT thm_id, CASE {' '.join(f'''WHEN lower(trim(thm_type)) LIKE '{k}%' THEN '{v}' ''' for k, v in KINDS)} END AS kind FROM st")
def statement_kind(spark, sf_dir):
    return corpus.statements(spark, sf_dir).select("thm_id", markup.kind(F.col("thm_type")).alias("kind"))


@query(f"WITH {PT} SELECT thm_id, part, regexp_matches(lower(text), '{HYPOTHESIS}') AS is_hypothesis FROM pt")
def hypothesis_flag(spark, sf_dir):
    return corpus.parts(spark, sf_dir).select("thm_id", "part", markup.is_hypothesis(F.col("text")).alias("is_hypothesis"))


@query(
    f"""WITH {PT} SELECT thm_id, part, CASE WHEN (length(text) - length(replace(text, '$', ''))) % 2 = 1 THEN text || '$'
        WHEN (length(text) - length(replace(text, '\\[', ''))) - (length(text) - length(replace(text, '\\]', ''))) > 0 THEN text || '\\]' ELSE text END AS balanced FROM pt"""
)
def math_delimiter_balance(spark, sf_dir):
    return corpus.parts(spark, sf_dir).select("thm_id", "part", markup.balanced(F.col("text")).alias("balanced"))


@query(
    f"""WITH {PT}, w AS (SELECT thm_id, part, text, len(list_filter(regexp_split_to_array(regexp_replace(text, '\\$[^$]*\\$', ' ', 'g'), '\\s+'), lambda x: regexp_matches(x, '[A-Za-z]'))) AS words,
             length(array_to_string(regexp_extract_all(text, '\\$[^$]*\\$'), '')) AS chars, len(regexp_extract_all(text, '\\$[^$]*\\$')) AS n FROM pt)
        SELECT thm_id, part, words >= 4 AND NOT (chars > 102 OR (chars > length(text) * 0.9e0 AND chars > 55) OR n > 12) AS wordy FROM w"""
)
def quality_filter(spark, sf_dir):
    return corpus.parts(spark, sf_dir).select("thm_id", "part", markup.is_wordy(F.col("text")).alias("wordy"))


@query(f"WITH {PT} SELECT thm_id, part, array_to_string(list_filter(regexp_split_to_array(text, '[\\s\"''{{}}\\-]+'), lambda x: length(x) >= 2 AND regexp_matches(x, '^[A-Za-z]+$')), ' ') AS plain FROM pt")
def plain_text(spark, sf_dir):
    return corpus.parts(spark, sf_dir).select("thm_id", "part", markup.plain_text(F.col("text")).alias("plain"))


@query(
    """SELECT name, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '\\bthe ([a-z][a-z ]{2,21}[a-z]) (?:function|polynomial|number)\\b', 1)) AS name FROM documents)
       WHERE NOT regexp_matches(name, '\\b(?:the|in|of|as|on|is)\\b') GROUP BY name"""
)
def function_names(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select(F.explode(markup.function_names(F.col("text"))).alias("name"))
    return found.groupBy("name").agg(F.count("*").alias("n"))


@query(
    f"""WITH {Q.ST} SELECT DISTINCT file_name, CASE WHEN regexp_extract(file_name, '\\d+\\.\\d+') <> '' THEN 'https://arxiv.org/abs/' || regexp_extract(file_name, '\\d+\\.\\d+')
        WHEN regexp_extract(file_name, '([a-z]{{4}})(\\d{{7}})') <> '' THEN 'https://arxiv.org/abs/' || left(regexp_extract(file_name, '([a-z]{{4}})(\\d{{7}})'), 4) || '/' || substr(regexp_extract(file_name, '([a-z]{{4}})(\\d{{7}})'), 5, 7) END AS url
        FROM st WHERE file_name IS NOT NULL"""
)
def source_urls(spark, sf_dir):
    return corpus.statements(spark, sf_dir).where("file_name is not null").select("file_name", markup.source_url(F.col("file_name")).alias("url")).distinct()


SENT = "list_filter(list_transform(regexp_split_to_array(lower(text), '[.!?;:]\\s+|\\.$|\\n+'), lambda s: trim(s)), lambda s: s <> '')"


@query(
    f"""WITH {PT}, s AS (SELECT thm_id, part, {SENT} AS l FROM pt), e AS (SELECT thm_id, part, i - 1 AS at_, l[i] AS sentence FROM (SELECT thm_id, part, l, unnest(range(1, len(l) + 1)) AS i FROM s)),
        v AS (SELECT thm_id, part, at_, list_transform(list_filter(regexp_split_to_array(sentence, '\\s+'), lambda w: regexp_matches(w, '^[a-z]{{3,}}$') AND w NOT IN ('let', 'then', 'and', 'have')), lambda w: {Q.singular('w')}) AS words FROM e)
        SELECT thm_id, part, CAST(at_ AS INTEGER) AS at, words FROM v WHERE len(words) > 4"""
)
def skipgram_corpus(spark, sf_dir):
    return matrix.skipgram_sentences(corpus.parts(spark, sf_dir), ["thm_id", "part"])


@query("SELECT doc_id, count(*) AS n_quantities FROM (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS w FROM documents) WHERE regexp_matches(w, '^(?:one|two|three|four|five|six|seven|eight|nine|ten|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand|million|billion)(?:-(?:one|two|three|four|five|six|seven|eight|nine))?$|^\\d+(?:/\\d+)?$') GROUP BY 1")
def quantity_words(spark, sf_dir):
    each = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.lower("text"), " ")).alias("w"))
    return each.where(W.is_quantity(F.col("w"))).groupBy("doc_id").agg(F.count("*").alias("n_quantities"))


@query("SELECT doc_id, translate(text, 'áéíóöőúüűŷśøěè', 'aeiooouuuysoee') AS folded FROM documents")
def diacritics(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", W.remove_diacritics(F.col("text")).alias("folded"))


@query(
    """WITH a AS (SELECT DISTINCT last_name FROM authortb WHERE last_name <> ''),
            p AS (SELECT x.last_name AS a, y.last_name AS b FROM a AS x JOIN a AS y ON left(x.last_name, 2) = left(y.last_name, 2) AND x.last_name < y.last_name),
            s AS (SELECT a, b, CASE WHEN abs(length(a) - length(b)) > 2 THEN regexp_split_to_array(trim(a), '\\s+')[-1] ELSE a END AS x, CASE WHEN abs(length(a) - length(b)) > 2 THEN regexp_split_to_array(trim(b), '\\s+')[-1] ELSE b END AS y FROM p)
       SELECT a, b FROM s WHERE left(x, greatest(least(length(x), length(y)) - 1, 1)) = left(y, greatest(least(length(x), length(y)) - 1, 1))"""
)
def similar_names(spark, sf_dir):
    names = table(spark, sf_dir, "authortb").select("last_name").where("last_name <> ''").distinct().withColumn("start", F.substring("last_name", 1, 2))
    pairs = names.select("start", F.col("last_name").alias("a")).join(names.select("start", F.col("last_name").alias("b")), "start").where("a < b")
    return pairs.where(W.names_alike(F.col("a"), F.col("b"))).select("a", "b")


@query(f"WITH {Q.ALL}, u AS (SELECT DISTINCT word FROM tok) SELECT word, CASE WHEN regexp_matches(word, '.ly$') THEN 'adverb' WHEN regexp_matches(word, '.ing$') THEN 'gerund' WHEN regexp_matches(word, '.(?:tive|wise|ary|ble|ous|ent|like|nal|lar|nian|cal|ed)$') THEN 'adj' WHEN regexp_matches(word, '.(?:tion|son|ace|ty|sor|ser|ture)$') THEN 'ent' END AS pos FROM u")
def suffix_pos(spark, sf_dir):
    return corpus.tokens(spark, sf_dir).select("word").distinct().select("word", W.suffix_part_of_speech(F.col("word")).alias("pos"))


TD = f"{Q.GRAMS}, {Q.TERMS}, {Q.VOCAB}, td AS (SELECT DISTINCT thm_id, word_idx, CAST(CASE WHEN score = 0 THEN 0.3 ELSE score END AS DOUBLE) AS weight FROM tm JOIN vo USING (word))"


@query(Q.q(TD, "SELECT thm_id, word_idx, weight FROM td"))
def td_entries(spark, sf_dir):
    return matrix.entries(corpus.terms(spark, sf_dir), corpus.vocab(spark, sf_dir))


@query(Q.q(TD, "SELECT thm_id, array_to_string(list('{' || word_idx || ',' || weight || '}' ORDER BY word_idx), ';') AS literal FROM td GROUP BY 1"))
def td_literal(spark, sf_dir):
    return codec.sparse_literal(matrix.entries(corpus.terms(spark, sf_dir), corpus.vocab(spark, sf_dir)), "thm_id", "word_idx")


@query(
    Q.q(
        f"""{Q.ALL}, pa AS (SELECT DISTINCT thm_id, paper_id FROM authortb WHERE paper_id IS NOT NULL),
        pc AS (SELECT paper_id, {Q.singular('word')} AS word, count(*) AS n FROM tok JOIN pa USING (thm_id) WHERE regexp_matches(word, '^[a-z]{{3,}}$') GROUP BY 1, 2)""",
        "SELECT paper_id, array_to_string(list(word || ',' || n ORDER BY word), ';') AS words FROM pc GROUP BY 1",
    )
)
def paper_word_string(spark, sf_dir):
    papers = table(spark, sf_dir, "authortb").select("thm_id", "paper_id").where("paper_id is not null").distinct()
    return matrix.paper_words(corpus.tokens(spark, sf_dir), papers)


def similar_sql(column: str, x: str = "") -> str:
    """``li{x}``: the list of each statement by its ``column``."""
    order = "PARTITION BY thm_id ORDER BY low, score DESC, span DESC, other"
    return f"""
        sn{x} AS (SELECT thm_id, list_filter(list_transform(regexp_split_to_array({column}, '[.!?;:]\\s+|\\.$|\\n+'), lambda s: trim(s)), lambda s: s <> '') AS l FROM st WHERE {column} IS NOT NULL),
        pi{x} AS (SELECT thm_id, i - 1 AS piece, l[i] AS text FROM (SELECT thm_id, l, unnest(range(1, len(l) + 1)) AS i FROM sn{x}) WHERE length(l[i]) >= 9),
        pj{x} AS (SELECT thm_id, piece, text, length(text) < 26 OR (length(text) < 40 AND regexp_matches(lower(text), '{HYPOTHESIS}') AND NOT contains(lower(text), 'then')) AS low FROM pi{x}),
        px{x} AS (SELECT thm_id, piece, low, unnest({Q.split_words('text')}) AS raw FROM pj{x}),
        pt2{x} AS (SELECT DISTINCT thm_id, piece, low, {Q.singular('raw')} AS word FROM px{x} WHERE {Q.literal_word('raw')} AND NOT regexp_matches(raw, '{Q.SPECIAL}')),
        kn{x} AS (SELECT DISTINCT thm_id AS other, word FROM pt2{x}), dk{x} AS (SELECT word, count(*) AS df FROM kn{x} GROUP BY 1),
        ra{x} AS (SELECT dk{x}.word, {Q.score('fr.freq')} AS score FROM dk{x} JOIN fr USING (word) WHERE df <= greatest(2, (SELECT count(DISTINCT thm_id) FROM pj{x}) * 0.02e0)),
        mt{x} AS (SELECT pt2{x}.thm_id, piece, low, other, sum(score) AS score, count(*) AS span FROM pt2{x} JOIN ra{x} USING (word) JOIN kn{x} USING (word) WHERE pt2{x}.thm_id <> other GROUP BY 1, 2, 3, 4),
        kp{x} AS (SELECT * FROM mt{x} QUALIFY row_number() OVER (PARTITION BY thm_id, piece ORDER BY span DESC, score DESC, other) <= 51),
        sg{x} AS (SELECT thm_id, other, CAST(sum(score) AS BIGINT) AS score, CAST(sum(span) AS BIGINT) AS span, min(low) AS low FROM kp{x} GROUP BY 1, 2),
        li{x} AS (SELECT thm_id, other, score, span, row_number() OVER ({order}) AS rn FROM sg{x} QUALIFY row_number() OVER ({order}) <= 100)"""


@query(Q.q(f"{Q.ALL}, {Q.FREQ}, {similar_sql('thm')}", "SELECT thm_id, other, score, span, rn FROM li"))
def similar_statements(spark, sf_dir):
    words = vocabulary.word_frequency(corpus.tokens(spark, sf_dir))
    return similar.similar(similar.pieces(corpus.statements(spark, sf_dir)), words, about=table(spark, sf_dir, "thmhyptb").count())


@query(
    Q.q(
        f"""{Q.ALL}, {Q.FREQ}, {similar_sql('thm')}, {similar_sql('hyp', 'h')},
        nn AS (SELECT thm_id, count(*) AS n FROM li GROUP BY 1),
        bo AS (SELECT thm_id, other, rn, 0 AS p FROM li UNION ALL SELECT lih.thm_id, lih.other, lih.rn, 1 FROM lih LEFT JOIN nn USING (thm_id)
               WHERE coalesce(n, 0) < 50 AND NOT EXISTS (SELECT 1 FROM li WHERE li.thm_id = lih.thm_id AND li.other = lih.other))""",
        "SELECT thm_id, other, row_number() OVER (PARTITION BY thm_id ORDER BY p, rn) AS rn FROM bo QUALIFY row_number() OVER (PARTITION BY thm_id ORDER BY p, rn) <= 100",
    )
)
def similar_with_hypotheses(spark, sf_dir):
    words = checkpointed(vocabulary.word_frequency(corpus.tokens(spark, sf_dir)))
    rows, about = corpus.statements(spark, sf_dir), table(spark, sf_dir, "thmhyptb").count()
    own, more = (checkpointed(similar.similar(similar.pieces(rows, c), words, about=about)) for c in ("thm", "hyp"))
    return similar.with_hypotheses(own, more)


@query(
    """SELECT q.vec_id AS query_id, v.vec_id, round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda z: (CAST(z[1] AS DOUBLE) - z[2]) * (CAST(z[1] AS DOUBLE) - z[2]))), 6) AS dist2,
              row_number() OVER (PARTITION BY q.vec_id ORDER BY list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda z: (CAST(z[1] AS DOUBLE) - z[2]) * (CAST(z[1] AS DOUBLE) - z[2]))), v.vec_id) AS rn
       FROM embeddings AS q, embeddings AS v WHERE q.vec_id % 20 = 0 QUALIFY rn <= 10"""
)
def lsa_knn(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")  # the stated queries of a search
    return lsa.nearest(vectors, queries).withColumn("dist2", F.round("dist2", 6))


@query(
    """SELECT round(1.5 * avg(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (CAST(z[1] AS DOUBLE) - z[2]) * (CAST(z[1] AS DOUBLE) - z[2]))))), 6) AS threshold
       FROM embeddings AS a JOIN embeddings AS b ON b.vec_id = a.vec_id + 1 AND a.label = b.label"""
)
def lsa_threshold(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    pairs = vectors.select((F.col("vec_id") + 1).alias("vec_id"), "label", F.col("embedding").alias("a")).join(vectors.select("vec_id", "label", F.col("embedding").alias("b")), ["vec_id", "label"])
    return lsa.threshold(pairs).withColumn("threshold", F.round("threshold", 6))


VOTES = """WITH d AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda z: (CAST(z[1] AS DOUBLE) - z[2]) * (CAST(z[1] AS DOUBLE) - z[2]))) AS dist2
                     FROM embeddings AS q, embeddings AS v WHERE q.vec_id % 20 = 0),
            n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist2, vec_id) AS rn FROM d QUALIFY rn <= 20),
            w AS (SELECT query_id, 1 / (4 + exp(dist2 / 12)) / (2.5 + exp(rn / 8)) AS w, 'C' || label || 'xx' || label % 3 AS label FROM n),
            p AS (SELECT query_id, w, unnest(list_distinct([left(label, 5), left(label, 3), left(label, 2)])) AS prefix FROM w),
            s AS (SELECT query_id, prefix, round(sum(w), 6) AS votes FROM p GROUP BY 1, 2)
       SELECT query_id, prefix, votes FROM s"""


@query(VOTES)
def knn_label_vote(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")  # the stated queries of a search
    label = F.concat(F.lit("C"), F.col("label"), F.lit("xx"), F.col("label") % 3)
    return classes.vote(lsa.nearest(vectors, queries, 20), vectors.select("vec_id", label.alias("label"))).drop("rn")


@query()
def lsa_svd(spark, sf_dir):
    own, counts = searching.stored(spark, sf_dir)
    vocab = search.looked_up(vocabulary.scored(vocabulary.numbered(vocabulary.pruned(vocabulary.frequency_of(counts)))))
    # The vocabulary has single words only, so no n-gram is an entry.
    single = search.looked_up(index.single_terms(counts).join(vocab, "word").select(F.col("raw").alias("word"), "word_idx"))
    found = index.placed(own).join(single, "word").groupBy("thm_id").agg(F.array_sort(F.collect_set("word_idx")).alias("indices"))
    lists = lsa.weighted(checkpointed(found), vocab.select("word_idx", matrix.weight(F.col("score")).alias("weight")))
    correlations = checkpointed(lsa.correlated(lists, corpus.statements(spark, sf_dir).count()))
    vectors, _, _ = lsa.trained(lsa.spread_lists(lists, correlations), vocab.count())
    return vectors


@query("SELECT thm_id, similarthms FROM (SELECT DISTINCT thm_id, similarthms FROM similarthmstb)")
def bitpack_roundtrip(spark, sf_dir):
    rows = table(spark, sf_dir, "similarthmstb").select("thm_id", "similarthms").distinct()
    return codec.unpacked(codec.packed(rows, "similarthms"), "similarthms")


@query("SELECT n, CAST(floor(log2(n)) + 1 AS INTEGER) AS width FROM (SELECT count(*) AS n FROM concepts)")
def concept_width(spark, sf_dir):
    return table(spark, sf_dir, "concepts").agg(F.count("*").alias("n")).select("n", codec.width(F.col("n")).alias("width"))


@query(Q.q(f"{searching.QTOKENS}, kw AS (SELECT DISTINCT term AS word, left(term, 4) AS object FROM concepts)", "SELECT query_id, object, count(*) AS n FROM (SELECT DISTINCT query_id, word FROM tk) JOIN kw USING (word) GROUP BY 1, 2"))
def keyword_objects(spark, sf_dir):
    keywords = table(spark, sf_dir, "concepts").select(F.col("term").alias("word"), F.substring("term", 1, 4).alias("object")).distinct()
    return classes.matched_objects(searching.prepared(spark, sf_dir)[0], keywords).drop("rn")


@query(Q.q(f"{searching.QTOKENS}, {Q.VOCAB}", "SELECT DISTINCT query_id, word_idx, CAST(score AS DOUBLE) AS weight FROM (SELECT query_id, word FROM tk) JOIN vo USING (word)"))
def query_vector(spark, sf_dir):
    return matrix.query_vector(searching.prepared(spark, sf_dir)[0], corpus.vocab(spark, sf_dir))


@query(Q.q(f"{Q.ALL}, {Q.FREQ}, {Q.VOCAB}", "SELECT word, score FROM vo"))
def score_json_roundtrip(spark, sf_dir):
    """The exported JSON object of scores, read again."""
    text = matrix.literal_json(corpus.vocab(spark, sf_dir))
    return text.select(F.explode(F.from_json("json", "map<string,int>")).alias("word", "score"))

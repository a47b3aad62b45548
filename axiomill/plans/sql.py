"""Pieces of the DuckDB SQL that queries are checked with."""

from __future__ import annotations

# Written out here once more, so that the SQL doesn't agree with the engine by sharing its constants.
STOP_WORDS = """
    a an and any are as assume at be been being between both but by can defined denote each every exist exists following for from
    furthermore given has have here if in is it its itself just let may moreover more no not of on one only or other over same
    satisfies satisfy satisfying show so some such suppose than that the their then there these they this thus to two under unless
    via was we when whenever where whereas which whose with whole
""".split()
GENERIC_TERMS = "sum equation polynomial function basis group ring field module series coefficient decomposition resolution problem example space".split()
STOP = "(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"
GENERIC = "(" + ", ".join(f"'{w}'" for w in GENERIC_TERMS) + ")"
SPECIAL = r"[-\\=$\{\}\[\]()^_+%&\./,:;!~\"\d@><*|`\x{FFFD}]"
SEPARATORS = r"(\s+|''s|''|\"|\(|\)|\{|\}|\[|\]|\.|;|,|:|-|_|~|!|\+)"
ACCENT = r"\\[\"''`]"


def singular(w: str) -> str:
    cut = f"left({w}, length({w}) - 2)"
    return (
        f"CASE WHEN length({w}) < 4 THEN {w} WHEN right({w}, 2) IN ('is', 'us', 'ss') THEN {w} WHEN {w} = 'matrices' THEN 'matrix' WHEN {w} = 'series' THEN 'series' "
        f"WHEN {w} LIKE '%ies' THEN left({w}, length({w}) - 3) || 'y' "
        f"WHEN {w} LIKE '%es' THEN CASE WHEN right({cut}, 1) IN ('s', 'h', 'x', 'o') THEN {cut} ELSE {cut} || 'e' END "
        f"WHEN {w} LIKE '%s' AND NOT regexp_matches({w}, '(us|is|ness|has)$') THEN left({w}, length({w}) - 1) ELSE {w} END"
    )


def literal_word(w: str) -> str:
    special = r"[-\{\[)(\}\]$%/|?@*.;,:_~!+^&<>=#\\\"''`]"
    return f"(length({w}) BETWEEN 3 AND 15 AND NOT regexp_matches(regexp_replace({w}, '{ACCENT}', '', 'g'), '{special}') AND NOT regexp_matches({w}, '[\\d\\x{{FFFD}}]') AND {w} NOT IN {STOP})"


def unaccented(w: str) -> str:
    return f"regexp_replace(regexp_replace({w}, '{ACCENT}', '', 'g'), '\\{{([A-Za-z])\\}}', '\\1', 'g')"


def index_words(text: str) -> str:
    return f"list_filter(list_transform({split_words(starred(f'lower({text})'))}, lambda x: {unaccented('x')}), lambda x: NOT regexp_matches(x, '{SPECIAL}'))"


def valid(w: str, least: int = 3) -> str:
    return f"(length({w}) >= {least} AND regexp_matches({w}, '^[a-z]+$') AND {w} NOT IN {STOP})"


def score(f: str) -> str:
    s = f"CASE WHEN {f} < 40 THEN 20 - {f} // 3 WHEN {f} < 180 THEN 35 - {f} // 4 WHEN {f} < 350 THEN 4 ELSE 3 END"
    return f"CAST(CASE WHEN {s} <= 0 THEN 3 ELSE {s} END AS INTEGER)"


def split_words(text: str) -> str:
    kept = f"replace(replace(lower({text}), '\\''', chr(1)), '\\\"', chr(2))"
    return f"list_transform(list_filter(regexp_split_to_array({kept}, '{SEPARATORS}'), lambda x: trim(x) <> ''), lambda x: replace(replace(x, chr(1), '\\'''), chr(2), '\\\"'))"


def starred(text: str) -> str:
    return f"regexp_replace({text}, '(^|\\s)(?:\\$\\\\mathrm\\{{c\\}}\\^\\*\\$|\\$*c\\^*\\*\\$*)[-\\s]algebra', '\\1c-algebra', 'g')"


ST = """
    st AS (SELECT thm_id, thm, hyp, file_name, thm_type, source, loaded_at FROM thmhyptb
           QUALIFY row_number() OVER (PARTITION BY thm_id ORDER BY loaded_at DESC NULLS LAST, thm DESC NULLS LAST, hyp DESC NULLS LAST,
                                      file_name DESC NULLS LAST, thm_type DESC NULLS LAST, source DESC NULLS LAST) = 1)"""
PARTS = """
    pt AS (SELECT thm_id, 'T' AS part, thm AS text FROM st WHERE thm IS NOT NULL UNION ALL SELECT thm_id, 'H', hyp FROM st WHERE hyp IS NOT NULL)"""
TOKENS = f"""
    tl AS (SELECT thm_id, part, {index_words('text')} AS w FROM pt),
    tok AS (SELECT thm_id, part, CAST(i - 1 AS INTEGER) AS pos, w[i] AS word FROM (SELECT thm_id, part, w, unnest(range(1, len(w) + 1)) AS i FROM tl))"""
ALL = f"{ST}, {PARTS}, {TOKENS}"
FREQ = f"""
    fr AS (SELECT {singular('word')} AS word, count(*) AS freq FROM tok WHERE regexp_matches(word, '^[a-z]{{3,}}$') AND {singular('word')} NOT IN {STOP} GROUP BY 1)"""
NEAR = """
    nr AS (SELECT thm_id, part, pos, word AS w0, lead(word, 1) OVER w AS w1, lead(word, 2) OVER w AS w2, lead(word, 3) OVER w AS w3
           FROM tok WINDOW w AS (PARTITION BY thm_id, part ORDER BY pos))"""
TWO = f"""
    two AS (SELECT w0, {singular('w1')} AS w1, count(*) AS freq FROM nr WHERE w1 IS NOT NULL AND {valid('w0')} AND {valid('w1')} GROUP BY ALL)"""
THREE = f"""
    three AS (SELECT w0, w1, {singular('w2')} AS w2, count(*) AS freq FROM nr WHERE w2 IS NOT NULL AND {valid('w0')} AND regexp_matches(w1, '^[a-z]{{2,}}$')
              AND {valid('w2', 4)} AND NOT regexp_matches(w2, 'ed$') GROUP BY ALL)"""
TWO_CHOSEN = """
    av AS (SELECT w0, CAST(floor(sum(freq) / count(*) + 0.5) AS BIGINT) AS average FROM two GROUP BY w0),
    tc AS (SELECT two.w0 || ' ' || two.w1 AS ngram, two.freq FROM two JOIN av USING (w0) LEFT JOIN fr AS a ON a.word = two.w0 LEFT JOIN fr AS b ON b.word = two.w1
           CROSS JOIN (SELECT sum(freq) AS total FROM fr) AS t
           WHERE (two.freq > average OR coalesce(two.freq / a.freq > 2.5 * b.freq / total AND two.freq > 1, FALSE)) AND NOT regexp_matches(two.w1, 'ing$'))"""
THREE_CHOSEN = """
    hr AS (SELECT *, row_number() OVER (PARTITION BY w0 ORDER BY freq DESC, w1, w2) AS r, count(*) OVER (PARTITION BY w0) AS n FROM three),
    hc AS (SELECT hr.w0 || ' ' || hr.w1 || ' ' || hr.w2 AS ngram, hr.freq FROM hr LEFT JOIN two AS a ON a.w0 = hr.w0 AND a.w1 = hr.w1 LEFT JOIN two AS b ON b.w0 = hr.w1 AND b.w1 = hr.w2
           WHERE r <= floor(n * 2 / 3) OR coalesce(hr.freq > a.freq / 2, FALSE) OR coalesce(hr.freq > b.freq / 2, FALSE))"""
GRAMS = f"{ALL}, {FREQ}, {NEAR}, {TWO}, {THREE}, {TWO_CHOSEN}, {THREE_CHOSEN}"
TERMS = f"""
    ng AS (SELECT ngram FROM tc UNION SELECT ngram FROM hc),
    sw AS (SELECT * FROM nr WHERE length(w0) >= 3 AND {singular('w0')} NOT IN {STOP}),
    tm AS (SELECT thm_id, part, pos, {singular('w0')} AS word FROM sw WHERE {literal_word(singular('w0'))}
           UNION ALL SELECT thm_id, part, pos, {singular("(w0 || ' ' || w1)")} AS word FROM sw WHERE {singular("(w0 || ' ' || w1)")} IN (SELECT ngram FROM ng)
           UNION ALL SELECT thm_id, part, pos, {singular("(w0 || ' ' || w1 || ' ' || w2)")} AS word FROM sw WHERE {singular("(w0 || ' ' || w1 || ' ' || w2)")} IN (SELECT ngram FROM ng))"""
POSTINGS = """
    pe AS (SELECT word, thm_id, part, list_sort(coalesce(list(DISTINCT pos) FILTER (pos < 127), [])) AS positions FROM tm GROUP BY ALL),
    ps AS (SELECT word, thm_id, part, positions FROM pe QUALIFY row_number() OVER (PARTITION BY word, thm_id ORDER BY part DESC) = 1)"""
LITERAL = f"""
    hl AS (SELECT thm_id, concat_ws(' ', max(CASE WHEN part = 'H' THEN text END), max(CASE WHEN part = 'T' THEN text END)) AS text FROM pt GROUP BY thm_id),
    lw AS (SELECT thm_id, list_filter(list_transform(list_filter({split_words('text')}, lambda x: {literal_word('x')}), lambda x: {singular('x')}), lambda x: x NOT IN {STOP}) AS w FROM hl),
    lp AS (SELECT thm_id, i - 1 AS pos, w[i] AS word FROM (SELECT thm_id, w, unnest(range(1, len(w) + 1)) AS i FROM lw)),
    li AS (SELECT word, thm_id, list_sort(list(DISTINCT pos))[1:2] AS positions FROM lp WHERE pos < 256 GROUP BY ALL)"""
VOCAB = f"""
    pr AS (SELECT * FROM fr WHERE freq >= 3),
    vo AS (SELECT word, freq, row_number() OVER (ORDER BY freq DESC, word) - 1 AS word_idx, {score('freq')} AS score FROM pr)"""


def q(ctes: str, select: str) -> str:
    return f"WITH {ctes} {select}"

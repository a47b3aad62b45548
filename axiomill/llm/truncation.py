"""Text cut off by field limits or in transfer.

Two signs are joined:

* *Hidden limits.* Every text's length is recomputed as it may have been stored: in characters,
  UTF-8 bytes, UTF-16 units, with HTML entities, as a JSON string, with CR LF line ends. Lengths are
  grouped by source and field in each measure; a limit is a length at which texts pile up: the
  greatest one, or one below it that stands out clearly, as where a limit was raised later.
* *Endings.* A text without a closing mark is compared with how sentences of the corpus end: its
  last word must occur elsewhere as a whole word, and the longest known run of words before the end
  must be one after which sentences do end. Rare words and formulas are wildcards in such runs, so
  the model is a table of phrase patterns and not of the texts themselves.

A text that ends as sentences do but lacks the mark is complete, unless it sits on a limit. On a
limit a full stop closes no text if white space follows it or an abbreviation precedes it; after a
number the endings decide.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axiomill.llm.pairs import looked_up
from axiomill.session import checkpointed

#: Words in at least this share of the texts stand for themselves in patterns: at most
#: (words of a text) / FREQUENT of them exist.
FREQUENT = 0.02
#: Longest run of words before the end, and how often a run must occur to be believed.
RUN, SUPPORT = 9, 8
#: A pile-up: texts on the limit, and how many times the usual number of each length below it.
PILE, TIMES = 5, 6
#: Below the greatest length: texts on the limit; times the usual number, and the number of each length
#: up to NEAR away on both sides, as sentences of one pattern are of about the same length; the share that
#: no closing mark ends; and different endings (of 63 told apart), as one text may be often repeated.
INNER_PILE, INNER_TIMES, NEAR, INNER_OPEN, ENDINGS = 20, 6, 5, 0.75, 10
#: Limits of up to this many sources and fields are sent to every task (a few hundred bytes each).
SOURCES = 20_000
#: Marks of omission.
MARK = re.compile(r"(?:…|\.\.\.|\[(?:…|\.\.\.|more|truncated|cut)\]|\((?:…|\.\.\.|more|truncated|cut|continued)\))\s*$", re.I)

#: What a full stop ends without ending the sentence.
_STOPPED = re.compile(r"\b(?:al|cf|ch|cor|def|defs|e\.g|eq|eqs|esp|etc|fig|figs|i\.e|lem|no|nos|p|pp|prop|ref|refs|resp|sec|st|thm|viz|vol|vs|w\.r\.t)\.$", re.I)
_NUMBERED = re.compile(r"(?<![^\W\d_])\d\.$")

_TOKEN = re.compile(r"\$[^$]*\$|\d+\.\d+|[^\W_]+|[^\s\w]|_")


#: The ways a text may have been stored in.
MEASURES = ("chars", "utf8", "utf16", "html", "html_quotes", "json", "json_ascii", "crlf", "html_utf8", "json_utf8")


def measures(text: str) -> tuple[int, ...]:
    """The length of ``text`` in each of MEASURES."""
    count = text.count
    chars = len(text)
    octets = chars if text.isascii() else len(text.encode("utf-8", "surrogatepass"))
    wide = 0 if octets == chars else sum(c > "\uffff" for c in text)
    html = count("&") * 4 + (count("<") + count(">")) * 3 + count('"') * 5
    lines = count("\n")
    json = count("\\") + count('"') + lines + count("\r") + count("\t")
    beyond = 0 if octets == chars else sum(c > "\x7f" for c in text)
    return (
        chars, octets, chars + wide, chars + html, chars + html + count("'") * 4, chars + json, chars + json + beyond * 5 + wide * 6,
        chars + lines - count("\r\n"), octets + html, octets + json,
    )


def fields(rows: DataFrame, key: str, columns: list[str], source: str = "source") -> DataFrame:
    """``key, source, field, text``: one row for each non-empty text."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in columns)))
    long = rows.select(F.col(key), F.coalesce(source, F.lit("")).alias("source"), pairs.alias("f")).select(key, "source", "f.field", "f.text")
    return long.where("text is not null and trim(text) <> ''")


def limits(counts: DataFrame) -> DataFrame:
    """``source, field, measure, limit, n_at``: the lengths at which a source's texts pile up.

    ``counts``: ``source, field, measure, length, n, n_open, endings``. The greatest length of a source and
    field in a measure is a limit if at least ``PILE`` texts have it, and ``TIMES`` as many as have each
    of the 40 lengths below it on average; a smaller length by the stricter INNER bounds. Of several
    measures those with the largest pile count.
    """
    group = Window.partitionBy("source", "field", "measure")
    below = F.coalesce(F.sum("n").over(group.orderBy("length").rangeBetween(-40, -1)), F.lit(0)) / 40
    beside = F.greatest(*(F.coalesce(F.max("n").over(group.orderBy("length").rangeBetween(*r)), F.lit(0)) for r in ((-NEAR, -1), (1, NEAR))))
    each = counts.withColumn("top", F.max("length").over(group)).withColumn("usual", below).withColumn("beside", beside)
    at_top = (F.col("length") == F.col("top")) & (F.col("n") >= PILE) & (F.col("n") >= F.col("usual") * TIMES)
    inner = (
        (F.col("n") >= INNER_PILE) & (F.col("n") >= F.col("usual") * INNER_TIMES) & (F.col("n") >= F.col("beside") * INNER_TIMES)
        & (F.col("n_open") >= F.col("n") * INNER_OPEN) & (F.bit_count("endings") >= ENDINGS)
    )
    piled = each.where(at_top | inner)
    held = piled.withColumn("held", F.max("n").over(group)).withColumn("best", F.max("n").over(Window.partitionBy("source", "field")))
    return held.where("held = best").select("source", "field", "measure", F.col("length").alias("limit"), F.col("n").alias("n_at"))


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text)


def is_word(token: str) -> bool:
    return token[0].isalnum()


def sentences(found: list[str]) -> tuple[list[list[str]], list[str]]:
    """Closed sentences, and the tokens after the last closing mark."""
    out, now = [], []
    for token in found:
        if token == ".":
            if now:
                out.append(now)
            now = []
        else:
            now.append(token)
    return out, now


def pattern(sentence: list[str], frequent: set[str]) -> list[str]:
    """Formulas as M, rare words as R, all else in lower case."""
    out = ["^"]
    for token in sentence:
        low = token.lower()
        if token[0] == "$" and len(token) > 1:
            out.append("M")
        elif is_word(token) and low not in frequent:
            out.append("R" if not token[0].isdigit() else "9")
        else:
            out.append(low)
    return out


def surveyed(texts: DataFrame) -> DataFrame:
    """``source, field, measure, length, word, n, n_open, endings``: in one pass, how many texts have
    each length in each measure (``word`` null; ``n_open`` of them without a closing mark, ``endings``
    has a bit for each of their endings), and each
    word as a whole one (``measure`` null); the last word of an open text isn't counted. A row with
    neither holds the number of texts. Stored."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def rows(lengths, words, n):
            many, none = len(lengths), len(words) + 1
            keys = list(lengths)
            columns = [
                pa.array([k[0] for k in keys] + [None] * none, pa.string()),
                pa.array([k[1] for k in keys] + [None] * none, pa.string()),
                pa.array([k[2] for k in keys] + [None] * none, pa.int32()),
                pa.array([k[3] for k in keys] + [None] * none, pa.int64()),
                pa.array([None] * many + list(words) + [None], pa.string()),
                pa.array([*(v[0] for v in lengths.values()), *words.values(), n], pa.int64()),
                *(pa.array([*(v[i] for v in lengths.values()), *[0] * none], pa.int64()) for i in (1, 2)),
            ]
            return pa.RecordBatch.from_arrays(columns, ["source", "field", "measure", "length", "word", "n", "n_open", "endings"])

        lengths, words, n = {}, Counter(), 0
        for batch in batches:
            for source, field, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n += 1
                ending = 1 << zlib.crc32(text[-48:].encode("utf-8", "surrogatepass")) % 63
                is_open = text.rstrip()[-1:] not in (".", "!", "?", ":", "")
                for i, length in enumerate(measures(text)):
                    known = lengths.get((source, field, i, length), (0, 0, 0))
                    lengths[source, field, i, length] = known[0] + 1, known[1] + is_open, known[2] | ending
                found = tokens(text)
                if found and is_word(found[-1]):
                    found.pop()
                words.update({t.lower() for t in found if is_word(t)})
            if len(words) + len(lengths) > 300_000:
                yield rows(lengths, words, n)
                lengths, words, n = {}, Counter(), 0
        yield rows(lengths, words, n)

    found = texts.select("source", "field", "text").mapInArrow(run, "source string, field string, measure int, length bigint, word string, n bigint, n_open bigint, endings bigint")
    return checkpointed(found.groupBy("source", "field", "measure", "length", "word").agg(F.sum("n").alias("n"), F.sum("n_open").alias("n_open"), F.bit_or("endings").alias("endings")))


def judged_texts(texts: DataFrame, bounds: DataFrame, key: str, shared) -> DataFrame:
    """In one pass, two kinds of rows, stored. With ``pattern``: ``n`` closed sentences have it.
    Without: the texts that no full stop closes, that a mark of omission ends, or that sit on a limit
    with a full stop that needn't close them, with ``key, source, field, marked, on_limit, tail,
    last, broken``. After a number ``on_limit`` is false there, so that the endings decide.
    ``tail``: the last RUN tokens' pattern. ``bounds(source, field, bounds)``: the limits.

    ``broken``: the formula or bracket it ends in is open. ``last``: the word it ends in, if any.
    """
    kind = dict(texts.dtypes)[key]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        frequent = shared.value
        known: dict[tuple[str, str], set] = {}  # the limits, read from a row when first met
        names = [key, "source", "field", "marked", "on_limit", "tail", "last", "broken", "pattern", "n"]
        types = [None, pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.int64()]

        def rows(tails, patterns, key_type):
            n = len(patterns)
            columns = [pa.array([t[i] for t in tails] + [None] * n, types[i] or key_type) for i in range(8)]
            columns += [pa.array([None] * len(tails) + list(patterns), pa.string()), pa.array([0] * len(tails) + list(patterns.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names)

        found, key_type = Counter(), None
        for batch in batches:
            out, key_type = [], batch.schema.field(0).type
            for row, (k, source, field, text) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True)):
                if (source, field) not in known:
                    known[source, field] = {(b["measure"], b["limit"]) for b in batch.column(4)[row].as_py() or ()}
                limits_, on_limit = known[source, field], None
                closed, tail = sentences(tokens(text))
                for sentence in closed:
                    found[" ".join(pattern(sentence, frequent))] += 1
                marked = MARK.search(text) is not None
                if not tail and not marked:
                    if not limits_:
                        continue
                    end = text[-12:]
                    open_ = end[-1].isspace() or _STOPPED.search(end) is not None
                    if not (open_ or _NUMBERED.search(end)) or limits_.isdisjoint(enumerate(measures(text))):
                        continue
                    tail, on_limit = list(closed[-1]) if closed else [], open_
                while tail and tail[-1] == ":":
                    tail.pop()
                last = tail[-1].lower() if tail and is_word(tail[-1]) else None
                broken = text.count("$") % 2 == 1 or sum(t in "([{" for t in tail) != sum(t in ")]}" for t in tail)
                if on_limit is None:
                    on_limit = bool(limits_) and not limits_.isdisjoint(enumerate(measures(text)))
                out.append((k, source, field, marked, on_limit, " ".join(pattern(tail, frequent)[-RUN:]) if tail else "", last, broken))
            if out:
                yield rows(out, {}, key_type)
            if len(found) > 300_000:
                yield rows([], found, key_type)
                found = Counter()
        if found:
            yield rows([], found, key_type)

    schema = f"`{key}` {kind}, source string, field string, marked boolean, on_limit boolean, tail string, last string, broken boolean, pattern string, n bigint"
    return checkpointed(looked_up(texts, bounds, ["source", "field"], SOURCES).select(key, "source", "field", "text", "bounds").mapInArrow(run, schema))


def runs(found: list[str]) -> list[str]:
    """The runs of 1..RUN tokens that end the list."""
    return [" ".join(found[-k:]) for k in range(1, min(RUN, len(found)) + 1)]


def run_counts(patterns: DataFrame) -> DataFrame:
    """``run, n_end, n_all``: how often a run of pattern tokens occurs, and ends a sentence."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for frame in batches:
            ends, every = Counter(), Counter()
            for text, n in zip(frame["pattern"], frame["n"], strict=True):
                found = text.split(" ")
                for i in range(2, len(found) + 1):
                    for one in runs(found[:i][-RUN:]):
                        every[one] += n
                        if i == len(found):
                            ends[one] += n
            yield pd.DataFrame({"run": list(every), "n_end": [ends[r] for r in every], "n_all": list(every.values())})

    return patterns.mapInPandas(run, "run string, n_end bigint, n_all bigint").groupBy("run").agg(F.sum("n_end").alias("n_end"), F.sum("n_all").alias("n_all"))


def cut(rows: DataFrame, key: str, columns: list[str], source: str = "source") -> DataFrame:
    """``key, source, field, reason``: the texts that are only the beginning of a longer one.

    ``reason`` is 'mark' (a mark of omission ends it), 'limit' (open, and on a limit of its source;
    also after a full stop with white space behind or an abbreviation before it),
    'word' (it ends in a word that is nowhere whole, or in an open formula or bracket) or 'sentence'
    (sentences don't end there).

    Null, empty and blank texts are never cut; repeated rows give one result; a null source is a
    source of its own; a text of any length is read whole. An empty table gives no rows.
    """
    texts = fields(rows, key, columns, source)
    counts = surveyed(texts)
    words = counts.where("word is not null").select("word", "n")
    n_texts = counts.where("word is null and measure is null").agg(F.sum("n")).first()[0] or 0
    # At most (words of a text) / FREQUENT entries, see FREQUENT.
    frequent = {r["word"] for r in words.where(F.col("n") >= max(2, n_texts * FREQUENT)).select("word").collect()}
    bounds = checkpointed(limits(counts.where("measure is not null")).groupBy("source", "field").agg(F.collect_list(F.struct("measure", "limit")).alias("bounds")))
    judged = judged_texts(texts, bounds, key, rows.sparkSession.sparkContext.broadcast(frequent))

    tails = judged.where("pattern is null").drop("pattern", "n").distinct()
    patterns = judged.where("pattern is not null").groupBy("pattern").agg(F.sum("n").alias("n"))
    # Texts that end alike ask alike: each different end is looked up once.
    ends = tails.where("not marked and not on_limit and tail <> ''").select("tail").distinct().select("tail", F.split("tail", " ").alias("t"))
    asked = ends.select("tail", F.explode(F.sequence(F.lit(1), F.size("t"))).alias("k"), "t").select("tail", "k", F.array_join(F.slice("t", -F.col("k"), F.col("k")), " ").alias("run"))
    known = run_counts(patterns).join(asked.select("run").distinct(), "run")
    enough = asked.join(known, "run").where(F.col("n_all") >= SUPPORT)
    longest = enough.groupBy("tail").agg(F.max(F.struct("k", (F.col("n_end") / F.col("n_all")).alias("p"))).alias("best")).select("tail", F.col("best.p").alias("p_end"))
    whole = words.select(F.col("word").alias("last"), F.lit(True).alias("known"))
    facts = tails.join(whole, "last", "left").join(longest, "tail", "left")
    reason = (
        F.when(F.col("marked"), "mark")
        .when(F.col("on_limit"), "limit")
        .when(F.col("broken") | (F.col("last").isNotNull() & F.col("known").isNull()), "word")
        .when(F.coalesce("p_end", F.lit(0.0)) < 0.5, "sentence")
    )
    return facts.select(key, "source", "field", reason.alias("reason")).where("reason is not null").distinct()


def report(rows: DataFrame, key: str, columns: list[str], source: str = "source") -> DataFrame:
    """``source, field, n_texts, n_cut, share`` over distinct texts of each key."""
    texts = fields(rows, key, columns, source).select(key, "source", "field").distinct()
    found = cut(rows, key, columns, source).select(key, "source", "field").distinct().withColumn("is_cut", F.lit(1))
    both = texts.join(found, [key, "source", "field"], "left")
    return both.groupBy("source", "field").agg(F.count("*").alias("n_texts"), F.count("is_cut").alias("n_cut")).withColumn("share", F.col("n_cut") / F.col("n_texts"))

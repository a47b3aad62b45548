"""Similar statements for every statement, through the postings.

A statement is asked for by its pieces (sentences). Words in more than ``share`` of the statements
aren't looked up. The rest grows with the square of the collection, so pairs of pieces and
statements never become rows: chunks of statements meet all postings, block by block, and add up the
shared words in an array; of each piece only the best so far are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axiomill.functions import markup
from axiomill.functions import words as W

#: Least length of a piece, results of a piece and of a statement.
PIECE, PER_PIECE, RESULTS = 9, 51, 100
#: Statements whose pieces are asked for in one task, and whose postings are met at a time.
CHUNK, BLOCK = 1 << 16, 1 << 19
#: Statements whose lists are put in order at a time.
LISTS = 1 << 12
#: A sum of shared words is the span, then the score, then the place in the block, in these bits.
SPAN, SCORE = 44, 20
PLACES = (1 << SCORE) - 1


def pieces(statements: DataFrame, column: str = "thm") -> DataFrame:
    """``thm_id, piece, text, low``: sentences of at least nine characters; ``low`` marks short ones
    and hypotheses, which weigh less."""
    each = statements.where(F.col(column).isNotNull()).select("thm_id", F.posexplode(markup.sentences(F.col(column))).alias("piece", "text"))
    n = F.length("text")
    low = (n < 26) | ((n < 40) & markup.is_hypothesis(F.col("text")) & ~F.lower("text").contains("then"))
    return each.where(n >= PIECE).withColumn("low", low)


def piece_terms(pieces_: DataFrame) -> DataFrame:
    """``thm_id, piece, low, word``"""
    found = pieces_.select("thm_id", "piece", "low", F.explode(W.distinct_words(F.col("text"))).alias("raw"))
    return found.where(W.is_literal_word(F.col("raw")) & W.is_index_word(F.col("raw"))).select("thm_id", "piece", "low", W.singular(F.col("raw")).alias("word")).distinct()


def ranked(n: int, block: int):
    """The function over the rows of a chunk: first the statements asked for, then all statements."""

    def postings(words, ids, entries):
        """The ids in order, and of each word the places of its statements among them."""
        import numpy as np

        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        row, word = entries
        at = np.minimum(np.searchsorted(words, word), len(words) - 1)
        met = words[at] == word
        at, places = at[met], place[row[met]]
        by = np.argsort(at, kind="stable")
        ends = np.cumsum(np.bincount(at, minlength=len(words)))
        return ids[order], np.split(places[by], ends[:-1])

    def meet(asked, found, best):
        """``best`` of each piece, after the statements of a block were met."""
        import numpy as np

        ids, posted = found
        total = np.zeros(len(ids), np.int64)
        own = np.minimum(np.searchsorted(ids, asked["thm"]), len(ids) - 1)
        starts, word, value = asked["starts"].tolist(), asked["word"].tolist(), asked["value"].tolist()
        for p, (thm, self_) in enumerate(zip(asked["thm"], own, strict=True)):
            near = []
            for k in range(starts[p], starts[p + 1]):
                post = posted[word[k]]
                now = total[post]
                near.append(post[now == 0] if near else post)
                total[post] = now + value[k]
            near = near[0] if len(near) == 1 else np.concatenate(near)
            if ids[self_] == thm:
                total[self_] = 0
            key = total[near] | (PLACES - near)
            total[near] = 0
            if len(key) > n:
                key = np.partition(key, len(key) - n)[len(key) - n :]
            key = key[key > PLACES]
            sums, others = key >> SCORE, ids[PLACES - (key & PLACES)]
            if best[p] is not None:
                sums, others = np.concatenate([best[p][0], sums]), np.concatenate([best[p][1], others])
                kept = np.lexsort((others, -sums))[:n]
                sums, others = sums[kept], others[kept]
            best[p] = sums, others

    def lists(thm, low, best):
        """The lists of some statements; one row of ``thm, low, best`` for each piece."""
        import numpy as np

        sizes = [len(s) for s, _ in best]
        sums, other = (np.concatenate([b[i] for b in best]) for i in (0, 1))
        thm, low = np.repeat(thm, sizes), np.repeat(low, sizes)
        order = np.lexsort((other, thm))
        thm, other, low, sums = thm[order], other[order], low[order], sums[order]
        first = np.flatnonzero(np.r_[True, (thm[1:] != thm[:-1]) | (other[1:] != other[:-1])][: len(thm)])
        if not len(first):
            return None
        thm, other, low, sums = thm[first], other[first], np.minimum.reduceat(low, first), np.add.reduceat(sums, first)
        span, score = sums >> (SPAN - SCORE), sums & ((1 << (SPAN - SCORE)) - 1)
        order = np.lexsort((other, -span, -score, low, thm))
        thm = thm[order]
        start = np.flatnonzero(np.r_[True, thm[1:] != thm[:-1]])
        rn = np.arange(len(thm)) - np.repeat(start, np.diff(np.r_[start, len(thm)])) + 1
        kept = rn <= RESULTS
        order = order[kept]
        return thm[kept], other[order], score[order], span[order], rn[kept]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def flat(table, name):
            column = table.column(name).combine_chunks()
            lengths = np.diff(column.offsets.to_numpy())
            return np.repeat(np.arange(len(lengths)), lengths), column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)

        def pieces_of(table):
            row, word = flat(table, "words")
            thm, score, code = table.column("thm_id").to_numpy()[row], flat(table, "scores")[1], flat(table, "codes")[1]
            piece, low = code >> 2, code >> 1 & 1
            words, word = np.unique(word, return_inverse=True)
            order = np.lexsort((piece, thm))
            thm, piece, low, word, score = thm[order], piece[order], low[order], word[order], score[order]
            first = np.flatnonzero(np.r_[True, (thm[1:] != thm[:-1]) | (piece[1:] != piece[:-1])])
            asked = {"thm": thm[first], "low": low[first], "starts": np.r_[first, len(thm)], "word": word, "value": (1 << SPAN) + (score << SCORE)}
            return words, asked

        words, asked, best = None, None, []
        kind, waiting, n_waiting = 0, [], 0

        def ended():
            nonlocal words, asked, best, waiting, n_waiting
            if waiting:
                table = pa.Table.from_batches(waiting)
                if kind == 0:
                    words, asked = pieces_of(table)
                    best = [None] * len(asked["thm"])
                elif asked is not None:
                    meet(asked, postings(words, table.column("thm_id").to_numpy(), flat(table, "words")), best)
            waiting, n_waiting = [], 0

        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            split = int(np.searchsorted(kinds, 1))
            for part, now in ((batch.slice(0, split), 0), (batch.slice(split), 1)):
                for one in (part.slice(i, block) for i in range(0, part.num_rows, block)):
                    if now != kind or (now and n_waiting + one.num_rows > block):
                        ended()
                    kind = now
                    waiting.append(one)
                    n_waiting += one.num_rows
        ended()
        if asked is None:
            return
        edges = np.flatnonzero(np.r_[True, asked["thm"][1:] != asked["thm"][:-1]])[::LISTS].tolist() + [len(best)]
        for a, b in zip(edges, edges[1:]):
            found = lists(asked["thm"][a:b], asked["low"][a:b], best[a:b])
            best[a:b] = [None] * (b - a)
            for i in range(0, len(found[0]) if found else 0, 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 16)], t) for c, t in zip(found, [pa.int64()] * 4 + [pa.int32()], strict=True)], ["thm_id", "other", "score", "span", "rn"])

    return run


def similar(pieces_: DataFrame, words: DataFrame, share: float = 0.02, about: int | None = None) -> DataFrame:
    """``thm_id, other, score, span, rn``: at most 100 statements for each, those of full weight
    first, by the scores and numbers of words shared with its pieces (51 of each piece).

    ``about``: roughly how many statements there are, for the number of tasks; else they are counted.
    """
    chunks = max(1, -(-(pieces_.select("thm_id").distinct().count() if about is None else about) // CHUNK))
    total = pieces_.agg(F.count_distinct("thm_id").alias("total"))
    first = F.row_number().over(Window.partitionBy("thm_id", "word").orderBy("piece")) == 1
    # All columns are used by both readers of the terms, so they are found and shuffled once.
    code = F.col("piece") * 4 + F.col("low").cast("int") * 2 + first.cast("int")
    terms = piece_terms(pieces_).select("word", "thm_id", code.alias("code")).repartition("word")
    df = terms.groupBy("word").agg(F.sum(F.when(F.col("thm_id").isNotNull(), F.col("code").bitwiseAND(1))).alias("df"))
    part = F.pmod(F.xxhash64("word"), F.lit(64)).cast("int")
    numbered = F.row_number().over(Window.partitionBy("part").orderBy("word")) * 64 + F.col("part")
    # One row is broadcast; the rare words are joined by the word.
    rare = df.crossJoin(F.broadcast(total)).where(F.col("df") <= F.greatest(F.lit(2), F.col("total") * share)).join(words, "word").select("word", W.word_score(F.col("freq")).alias("score"), part.alias("part")).select("word", "score", numbered.alias("w"))
    held = terms.join(rare, "word").groupBy("thm_id").agg(F.collect_list(F.struct("w", "score", "code")).alias("e"))
    own = F.struct(F.pmod(F.xxhash64("thm_id"), F.lit(chunks)).cast("int").alias("chunk"), F.lit(0).alias("kind"))
    every = F.transform(F.sequence(F.lit(0), F.lit(chunks - 1)), lambda i: F.struct(i.alias("chunk"), F.lit(1).alias("kind")))
    sent = held.select("thm_id", "e", F.explode(F.concat(F.array(own), every)).alias("to")).select("to.*", "thm_id", "e")
    asked = F.col("kind") == 0
    row = sent.select("chunk", "kind", "thm_id", F.when(asked, F.col("e.w")).otherwise(F.array_distinct("e.w")).alias("words"), F.when(asked, F.col("e.score")).alias("scores"), F.when(asked, F.col("e.code")).alias("codes"))
    met = row.repartitionById(chunks, F.col("chunk")).sortWithinPartitions("kind")
    return met.drop("chunk").mapInArrow(ranked(PER_PIECE, BLOCK), "thm_id bigint, other bigint, score bigint, span bigint, rn int")


def with_hypotheses(own: DataFrame, by_hypotheses: DataFrame, enough: int = RESULTS // 2, most: int = RESULTS) -> DataFrame:
    """``thm_id, other, rn``: the lists of ``own``, and behind those of fewer than ``enough`` entries what
    the hypotheses alone are similar to, at most ``most`` in all. Statements of one list only have that."""
    sizes = own.groupBy("thm_id").agg(F.count("*").alias("n"))
    short = by_hypotheses.select("thm_id", "other", "rn").join(sizes, "thm_id", "left").where(F.coalesce("n", F.lit(0)) < enough)
    more = short.join(own.select("thm_id", "other"), ["thm_id", "other"], "left_anti")
    both = own.select("thm_id", "other", "rn", F.lit(0).alias("p")).unionByName(more.select("thm_id", "other", "rn", F.lit(1).alias("p")))
    place = F.row_number().over(Window.partitionBy("thm_id").orderBy("p", "rn"))
    return both.select("thm_id", "other", place.alias("rn")).where(F.col("rn") <= most)


def combined(old: DataFrame, new: DataFrame) -> DataFrame:
    """Lists of two runs; the later one's list of a statement stands."""
    return new.unionByName(old.join(new.select("thm_id"), "thm_id", "left_anti"))

from pathlib import Path

import oracle
import pytest

import __spark_entry__ as entry
from axiomill.operators import similar

DATA = "/root/testdata/sf0.001"


def lists(spark, statements, freq):
    rows = spark.createDataFrame(statements, "thm_id bigint, thm string")
    words = spark.createDataFrame(list(freq.items()), "word string, freq bigint")
    return sorted((r["thm_id"], r["other"], r["score"], r["span"], r["rn"]) for r in similar.similar(similar.pieces(rows), words).collect())


def test_a_word_is_looked_up_by_its_share_alone(spark):
    """310 of 16,000 statements share a word: less than 2 %, so unrelated statements don't matter."""
    shared = [(i, "the nilpotent thing") for i in range(310)]
    others = [(i, f"a thing numbered{chr(97 + i % 26)}") for i in range(310, 16_000)]
    got = lists(spark, shared + others, {"nilpotent": 310})
    assert len(got) == 310 * similar.PER_PIECE
    assert got[:2] == [(0, 1, 4, 1, 1), (0, 2, 4, 1, 2)]
    assert got[-1] == (309, 50, 4, 1, 51)


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_chunks_and_blocks_give_the_same_lists(spark, monkeypatch):
    monkeypatch.setattr(similar, "CHUNK", 70)
    monkeypatch.setattr(similar, "BLOCK", 50)
    assert oracle.spark_rows(entry.queries()["similar_statements"](spark, DATA)) == oracle.duck_rows(DATA, entry.oracle_sql()["similar_statements"])

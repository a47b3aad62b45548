import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from axiomill.llm import frequency, packing, tokenizer

SCHEMA = "word string, thm_indices array<int>, word_indices array<int>, n int, mark string"


def test_frequency_cases(spark):
    rows = [
        (" Ring ", [1, 2, 2], [0, 4, 7, -1, 7, -1], 1, "x"),
        ("ring", [2, 3], [7, -1, 1, -1], 1, "x"),
        ("ring", [2, 3], [7, -1, 1, -1], 1, "x"),
        ("field", None, None, 1, "x"),
        ("ideal", [], [], 1, "x"),
        (None, [1], [1, -1], 1, "x"),
        ("short", [4, 5], [9], 1, "x"),
    ]
    index = spark.createDataFrame(rows, SCHEMA)
    got = {r["word"]: (r["n_occurrences"], r["n_statements"]) for r in frequency.word_counts(index).collect()}
    assert got == {"ring": (4, 3), "field": (0, 0), "ideal": (0, 0), "short": (1, 2)}
    statements = spark.createDataFrame([(i,) for i in range(59)] + [(1,), (None,)], "thm_id int")
    marks = {r["word"]: r["mark"] for r in frequency.marked(frequency.word_counts(index), statements).collect()}
    assert marks == {"ring": "common", "field": None, "ideal": None, "short": "rare"}
    exact = spark.createDataFrame([(i,) for i in range(60)], "thm_id int")
    assert {r["word"]: r["mark"] for r in frequency.marked(frequency.word_counts(index), exact).collect()}["ring"] is None
    of_100 = spark.createDataFrame([(i,) for i in range(100)], "thm_id int")
    assert [{r["word"]: r["mark"] for r in frequency.marked(frequency.word_counts(index), of_100, 1, share).collect()}["ring"] for share in (0.03, 0.029)] == [None, "common"]
    empty = spark.createDataFrame([], SCHEMA)
    assert frequency.marked(frequency.word_counts(empty), statements).count() == 0


@pytest.fixture(scope="module")
def public():
    tokenizers = pytest.importorskip("tokenizers")
    found = tokenizers.Tokenizer.from_file(f"{tokenizer.DEFAULT_FOLDER}/byte_bpe_50k.json")
    found.encode_special_tokens = True
    return found


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aabbe  \n\t'st0é日🙂<|>-=$\\"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_the_automaton_equals_the_public_tokenizer(public, text):
    ids = tokenizer.encode_text(text)
    assert ids == public.encode(text, add_special_tokens=False).ids
    assert tokenizer.decode_ids(ids) == text


def test_encoding_a_table(spark, public):
    texts = ["Let $f$ be holomorphic.", None, "", "  \r\n ", "<|endoftext|>", "ab" * 30_000, "x" * 200_000, "Let $f$ be holomorphic."]
    rows = spark.createDataFrame([(i, t, [1], 5) for i, t in enumerate(texts)] + [(None, "a", [1], 5)], "doc_id bigint, text string, ids array<int>, n_tokens int")
    got = {r["doc_id"]: r["ids"] for r in tokenizer.encoded(rows).collect()}
    want = {i: public.encode(t, add_special_tokens=False).ids if t else [] for i, t in enumerate(texts)}
    assert got == want | {None: tokenizer.encode_text("a")}
    counts = {r["doc_id"]: r["n_tokens"] for r in tokenizer.token_counts(rows).collect()}
    assert counts == {k: len(v) for k, v in got.items()}
    assert tokenizer.encoded(rows.limit(0)).count() == 0


def best_fit_decreasing(sizes, capacity):
    """One item at a time: the loads of all bins."""
    bins = []
    for size in sorted(sizes, reverse=True):
        room = [(capacity - b, i) for i, b in enumerate(bins) if capacity - b >= size]
        if room:
            bins[min(room)[1]] += size
        else:
            bins.append(size)
    return Counter(bins)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80), st.integers(40, 60))
def test_the_plan_equals_item_by_item_packing(sizes, capacity):
    loads: Counter = Counter()
    seen: Counter = Counter()
    for run in packing.plan(dict(Counter(sizes)), capacity):
        assert run.first == seen[run.size]
        seen[run.size] += run.n
        for i in range(run.n):
            loads[run.bin + i // run.each] += run.size
    assert seen == Counter(sizes)
    assert Counter(loads.values()) == best_fit_decreasing(sizes, capacity)


def test_packing_a_table(spark):
    rng = random.Random(1)
    sizes = [(i, rng.choice([0, 5, 5, 5, 30, 64, 200, None]) if i % 3 else 17, "x", 3) for i in range(600)] + [(-1, 100_000, "x", 3)]
    rows = spark.createDataFrame(sizes, "doc_id bigint, n_tokens bigint, bin string, piece int")
    got = packing.packed(rows, 64).collect()
    total, loads, pieces = Counter(), Counter(), Counter()
    for r in got:
        total[r["doc_id"]] += r["n_tokens"]
        pieces[r["doc_id"]] += 1
        loads[r["bin"]] += r["n_tokens"]
    assert total == Counter({i: n or 0 for i, n, *_ in sizes}) and set(total) == {i for i, *_ in sizes}
    assert max(loads.values()) <= 64
    assert all(pieces[i] == max(1, -(-(n or 0) // 64)) for i, n, *_ in sizes)
    items = [r["n_tokens"] for r in got if r["n_tokens"]]
    assert Counter(v for v in loads.values() if v) == best_fit_decreasing(items, 64)
    assert packing.packed(rows.limit(0), 64).count() == 0
    assert {tuple(r) for r in packing.packed(rows.orderBy("doc_id"), 64).collect()} == {tuple(r) for r in got}
    both = packing.packed_all(rows, [("small", 64), ("large", 500)])
    assert {(r["pack_name"], r["capacity"]) for r in both.collect()} == {("small", 64), ("large", 500)}

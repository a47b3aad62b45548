import random

from axiomill.llm import truncation as T


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    nouns = [f"{a}{b}oid" for a in ("mono", "poly", "semi", "ultra", "hyper", "meta") for b in ("lat", "ver", "cyc", "dens", "gon", "rad")]
    for _ in range(n):
        a, b, c = rng.sample(nouns, 3)
        yield f"Every {a} of $X_{{{rng.randint(1, 99)}}}$ admits a {b} refinement. The kernel of $f$ is spanned by a {c} of order {rng.randint(1, 9)}."


def rows(spark, items):
    return spark.createDataFrame(items, "id int, source string, thm string, hyp string, reason string, run string")


def test_limits_marks_words_and_sentences(spark):
    texts = list(corpus())
    items = [(i, "whole", t, None, "x", "x") for i, t in enumerate(texts)]
    items += [(1000 + i, "form", t[:90], None, "x", "x") for i, t in enumerate(texts[:60])]
    items += [
        (2000, "wire", texts[0][:40] + "…", None, "x", "x"),
        (2001, "wire", "Every monolatoid of $X_{3}$ admits a polyveroid refin", None, "x", "x"),
        (2002, "wire", "Every monolatoid of $X_{3}$ admits a", None, "x", "x"),
        (2003, "wire", "Every monolatoid of $X_{3}$ admits a polyveroid refinement", None, "x", "x"),
        (2004, "wire", "Every monolatoid of $X_{3", None, "x", "x"),
        (2005, None, None, "", "x", "x"),
        (2006, "wire", "   ", None, "x", "x"),
        (2001, "wire", "Every monolatoid of $X_{3}$ admits a polyveroid refin", None, "x", "x"),
    ]
    got = {(r["id"], r["reason"]) for r in T.cut(rows(spark, items), "id", ["thm", "hyp"]).collect()}
    assert {x for x in got if x[0] < 1000} == set()
    assert {i for i, _ in got if 1000 <= i < 2000} == {1000 + i for i, t in enumerate(texts[:60]) if not t[:90].endswith(".")}
    assert {x for x in got if x[0] >= 2000} == {(2000, "mark"), (2001, "word"), (2002, "sentence"), (2004, "word")}
    report = {(r["source"], r["field"]): (r["n_texts"], r["n_cut"]) for r in T.report(rows(spark, items), "id", ["thm", "hyp"]).collect()}
    assert report["wire", "thm"] == (5, 4)
    assert report["whole", "thm"] == (400, 0)


def test_a_limit_in_escaped_length(spark):
    def cut(text, most):
        while T.measures(text)[T.MEASURES.index("html")] > most:
            text = text[:-1]
        return text

    texts = [t.replace("admits a", "& admits" + " <" * (i % 4) + " a") for i, t in enumerate(corpus(400, 3))]
    items = [(i, "escaped", cut(t, 88), None, "x", "x") for i, t in enumerate(texts)]
    counts = T.surveyed(T.fields(rows(spark, items), "id", ["thm"]))
    measures = {T.MEASURES[r["measure"]] for r in T.limits(counts.where("measure is not null")).collect()}
    assert "html" in measures and "chars" not in measures


def test_measures():
    assert T.measures('a<b&"é\\\n') == (8, 9, 8, 20, 20, 11, 16, 9, 21, 12)
    assert T.measures("") == (0,) * len(T.MEASURES)


def test_empty_table(spark):
    assert T.cut(rows(spark, []), "id", ["thm", "hyp"]).count() == 0
    assert T.report(rows(spark, []), "id", ["thm", "hyp"]).count() == 0


def test_a_long_text_is_read_whole(spark):
    text = "The kernel of $f$ is spanned by a monolatoid. " * 3000
    items = [(1, "a", text + "The kernel of $f$ is spa", None, "x", "x"), (2, "a", text, None, "x", "x")]
    assert [r["id"] for r in T.cut(rows(spark, items), "id", ["thm", "hyp"]).collect()] == [1]


def test_a_full_stop_on_a_limit(spark):
    texts = [t + (f" It is bounded by {i}.{i} times its rank." if i % 4 == 0 else "") for i, t in enumerate(corpus())]
    items = [(i, "whole", t, None, "x", "x") for i, t in enumerate(texts)]
    items += [(1000 + i, "form", t[:60], None, "x", "x") for i, t in enumerate(texts[:60])]

    def ended(end, most=60):
        return "Every monolatoid of $X_{3}$ admits a polyveroid refinement of the kernel"[: most - len(end)] + end

    items += [(2000 + i, "form", ended(e), None, "x", "x") for i, e in enumerate((". ", " cf.", " resp.", " bounded by 5701.", " a monolatoid of order 3.", " mono."))]
    items += [(3000 + i, "form", ended(e, 50), None, "x", "x") for i, e in enumerate((". ", " cf.", " bounded by 5701."))]
    items += [(4000, "whole", texts[0] + " ", None, "x", "x")]
    got = {(r["id"], r["reason"]) for r in T.cut(rows(spark, items), "id", ["thm", "hyp"]).collect() if r["id"] >= 2000}
    assert got == {(2000, "limit"), (2001, "limit"), (2002, "limit"), (2003, "sentence")}


def test_a_limit_below_longer_texts(spark):
    """Forty texts cut at 70 characters, one longer text since, and a source with two limits."""
    texts = list(corpus(200, 7))
    items = [(i, "whole", t, None, "x", "x") for i, t in enumerate(texts)]
    raised = [t[:70] for t in texts[:40]]
    items += [(1000 + i, "raised", t, None, "x", "x") for i, t in enumerate(raised)] + [(1999, "raised", texts[50] + texts[51], None, "x", "x")]
    items += [(2000 + i, "two", t[: 60 if i % 2 else 75], None, "x", "x") for i, t in enumerate(texts[:80])]
    items += [(3000 + i, "same", texts[3], None, "x", "x") for i in range(50)] + [(3999, "same", texts[4] + texts[5], None, "x", "x")]
    got = {(r["id"], r["reason"]) for r in T.cut(rows(spark, items), "id", ["thm", "hyp"]).collect()}
    assert {i for i, _ in got} == {i for i, s, t, *_ in items if s in ("raised", "two") and not t.endswith(".")}
    assert {r for _, r in got} == {"limit"}

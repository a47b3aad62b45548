import random

from axiomill.llm import encoding as E

RU = "Лемма показывает что каждый элемент обладает свойством которое следует из работы и теоремы Пусть является пространством для решения уравнения".split()
FR = "le théorème reste vrai même si la démonstration grâce à un procédé très général possède une propriété évidente d’après l’espace associé".split()


def documents(spark, garble):
    """Sixty clean records of each language, and garbled ones with ids from 1000."""
    rng = random.Random(3)
    rows = []
    for lang, words in (("ru", RU), ("fr", FR)):
        for i in range(60):
            rows.append((len(rows), " ".join(rng.choices(words, k=60)), lang if i % 9 else None, "abc"[i % 3], "x", 1.0))
    truth = {}
    for i, (lang, f) in enumerate(garble):
        text = " ".join(rng.choices(RU if lang == "ru" else FR, k=60))
        truth[1000 + i] = text
        rows.append((1000 + i, f(text), lang.upper(), "b", "x", 1.0))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, place string, odds double"), truth


def sloppy(text, written, shown):
    return "".join({**{b: chr(b) for b in range(256)}, **{ord(v): k for k, v in {c: chr(n) for n, c in ((n, bytes([n]).decode(shown, "ignore")) for n in range(256)) if c}.items()}}[b] for b in text.encode(written))


def test_swaps_are_found_and_undone(spark):
    garble = [
        ("fr", lambda t: t.encode("utf-8").decode("latin-1")),
        ("fr", lambda t: sloppy(t, "utf-8", "cp1252")),
        ("fr", lambda t: t.encode("utf-8").decode("mac-roman")),
        ("fr", lambda t: sloppy(sloppy(t, "utf-8", "cp1252"), "utf-8", "cp1252")),
        ("ru", lambda t: t.encode("cp1251").decode("latin-1")),
        ("ru", lambda t: t.encode("koi8-r").decode("cp1251")),
        ("fr", lambda t: t[:200] + t[200:].encode("utf-8").decode("latin-1")),
    ]
    rows, truth = documents(spark, garble)
    got = {r["doc_id"]: r for r in E.restored(rows).collect()}
    assert set(got) == set(truth)
    assert {k: r["restored"] for k, r in got.items()} == truth
    assert {r["doc_id"] for r in E.garbled(rows).collect()} == set(truth)


def test_lost_characters_and_clean_texts(spark):
    rows, _ = documents(spark, [("fr", lambda t: t.encode("cp1252").decode("utf-8", "replace"))])
    more = spark.createDataFrame(
        [(2000, None, "fr", "a"), (2001, "", None, None), (2002, "plain", "en", "a"), (2003, "ÂGE DU MODÈLE à l’été", "fr", "a"), (2004, "naïve “ℝ → ℂ” soft\xadhyphen", "en", "a"), (2005, "é" * 100_000, "fr", "a")],
        "doc_id bigint, text string, lang string, source string",
    )
    all_rows = rows.select("doc_id", "text", "lang", "source").unionByName(more)
    got = {r["doc_id"]: r["recoverable"] for r in E.garbled(all_rows).collect()}
    assert got == {1000: False}
    restored = {r["doc_id"]: r["restored"] for r in E.restored(all_rows).collect()}
    assert "�" in restored[1000]


def test_empty_table(spark):
    rows = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string")
    assert E.garbled(rows).count() == 0 and E.restored(rows).count() == 0


def test_candidates_undo_each_page():
    for page in E.SHOWN:
        for text in ("é", "ß", "что", "’"):
            shown = "".join(chr(b) if not bytes([b]).decode(page, "ignore") else bytes([b]).decode(page, "replace") for b in text.encode("utf-8"))
            assert text in {plain for _, plain in E.candidates(shown)}


GR = (
    "το θεώρημα ισχύει για κάθε συνεχή συνάρτηση που ορίζεται στον χώρο και έχει την ιδιότητα αυτή επειδή η απόδειξη του λήμματος είναι προφανής "
    "έστω ότι το σύνολο των λύσεων της εξίσωσης δεν είναι κενό τότε υπάρχει μία ακολουθία σημείων που συγκλίνει ψηφίο ζεύγος ξένα βάθος"
).split()


def greek(spark, garble):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(GR, k=60)), "el", "abc"[i % 3]) for i in range(90)] + [(100 + i, " ".join(rng.choices(FR, k=60)), "fr", "abc"[i % 3]) for i in range(60)]
    truth = {1000 + i: " ".join(rng.choices(GR, k=60)) for i in range(10)}
    rows += [(k, garble(t), "EL", "b") for k, t in truth.items()]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"), truth


def test_pages_that_no_table_has_are_learned(spark):
    for garble in (lambda t: t.encode("iso8859-7").decode("latin-1"), lambda t: sloppy(t, "cp1253", "cp1252")):
        rows, truth = greek(spark, garble)
        assert {r["doc_id"]: r["restored"] for r in E.restored(rows).collect()} == truth


def test_a_cipher_of_no_page_is_learned(spark):
    """Letters of a font of its own: nothing but the language's bigrams tells what they stand for."""
    letters = sorted(set("".join(GR)))
    rng = random.Random(2)
    signs = rng.sample([chr(c) for c in range(0x1400, 0x1500)], len(letters))
    rows, truth = greek(spark, lambda t: t.translate(str.maketrans("".join(letters), "".join(signs))))
    got = {r["doc_id"]: r["restored"] for r in E.restored(rows).collect()}
    assert set(got) == set(truth)
    same = sum(a == b for k in truth for a, b in zip(truth[k], got[k], strict=True)) / sum(map(len, truth.values()))
    assert same > 0.9


def test_signs_and_foreign_words_of_one_source_are_no_ciphers(spark):
    rng = random.Random(9)
    rows, _ = greek(spark, lambda t: t)
    polish = "każda liczba całkowita jest sumą czterech kwadratów więc twierdzenie zachodzi również dla pierścieni łącznych".split()
    more = [(2000 + i, " ".join(rng.choices([*FR, "∈", "ℝ", "→", "≤", "⊂", "∀"], k=60)), "fr", "c") for i in range(20)]
    more += [(3000 + i, " ".join(rng.choices(FR, k=30) + rng.choices(polish, k=30)), "fr", "a") for i in range(20)]
    more += [(4000 + i, " ".join(rng.choices(RU, k=40)), "el", "b") for i in range(20)]
    all_rows = rows.unionByName(spark.createDataFrame(more, "doc_id bigint, text string, lang string, source string"))
    assert E.garbled(all_rows).count() == 0


def test_places_of_very_many_sources(spark):
    rows = [(i, "prix – à voir", "fr", f"s{i}") for i in range(400)]
    table = E._counted(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"))
    assert table.count() == 800 and {r["n"] for r in table.collect()} == {1}
    assert "uses" not in table.columns


def test_counters_are_where_they_are_looked_up(spark):
    pairs = spark.createDataFrame([("fr", "é ", 3.0), ("fr", "aé", 2.0), ("", "éa", 5.0), ("el", "🙂α", 1.5)], "lang string, pair string, n double")
    counts = dict(E.counters(pairs).collect())
    model = E.Model([counts.get(i, 0.0) for i in range(2 * E.WIDTH)], True)
    assert [model.count(*k) for k in (("fr", "é", " "), ("*", "é", " "), ("fr", "", ""), ("*", "", ""), ("", "é", "a"), ("el", "🙂", "α"), ("fr", "x", "y"))] == [3, 3, 5, 11.5, 5, 1.5, 0]

import gzip
import io
import json
import tarfile
from datetime import datetime

from axiomill.operators import index, ngrams, vocabulary
from axiomill.sources import readers, sinks
from axiomill.streaming import incremental


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_text_readers(spark, tmp_path):
    assert rows(readers.path_list(spark, write(tmp_path / "a", " x.tar \n\n y.tar\n"))) == [("x.tar",), ("y.tar",)]
    assert rows(readers.lines(spark, write(tmp_path / "b", "é,a\nb", "latin-1"), "ISO-8859-1")) == [("b",), ("é,a",)]
    assert rows(readers.lexicon(spark, write(tmp_path / "c", "CW complex ent\nflat adj\nso fluff\nof pre_comp\n\n"))) == [("CW complex", "ent", "word"), ("flat", "adj", "word"), ("of", "pre_comp", "compound"), ("so", "fluff", "fluff")]
    assert rows(readers.fixed_phrases(spark, write(tmp_path / "d", "all but | all but finitely many | adj\nbad\n"))) == [("all but", "all but finitely many", "adj")]
    stock = readers.stock_frequencies(spark, write(tmp_path / "e", "1 the at 900\n2 Be v 700 x\nbad\n200 ring n 3\n"))
    assert rows(stock) == [(1, "the", "at", 900, True), (2, "be", "v", 700, True), (200, "ring", "n", 3, False)]
    assert rows(readers.frequent_words(stock, 1)) == [("the", "at", 1)]
    assert rows(readers.ngram_list(spark, write(tmp_path / "f", "Spaces, Metric\nring\nprime ideals\n"))) == [("metric space", 2), ("prime ideal", 2)]
    related = readers.related_words(spark, write(tmp_path / "g", "flat | even, level | steep | smooth\n"))
    assert rows(related) == [("flat", "antonym", 3, "steep"), ("flat", "related", 4, "smooth"), ("flat", "synonym", 1, "even"), ("flat", "synonym", 2, "level")]
    assert rows(readers.synonyms(spark, write(tmp_path / "h", "map, function , arrow\nalone\n"))) == [("map", "arrow"), ("map", "function")]
    assert rows(readers.synonyms_json(spark, write(tmp_path / "i", json.dumps({"ring": ["field", "algebra"]})))) == [("ring", 1, "field"), ("ring", 2, "algebra")]
    authors = readers.authors_csv(spark, write(tmp_path / "j", "0,'math0001088','alexander','','brudnyi'\n1,'x','o\\'neil','b','c'\n"))
    assert [tuple(r) for r in authors.orderBy("thm_id").collect()] == [(0, "math0001088", "alexander", None, "brudnyi"), (1, "x", "o'neil", "b", "c")]


def test_paper_records(spark, tmp_path):
    text = "math/0001\n2017-7-26\nA  title\nA B, C D, \nx1\nbad\nT\nE F\n"
    assert rows(readers.paper_records(spark, write(tmp_path / "m", text))) == [("math0001", "2017-07-26", "A title", "A B, C D"), ("x1", None, "T", "E F")]


def test_archives(spark, tmp_path):
    def add(archive, name, data):
        info = tarfile.TarInfo(name)
        info.size = len(data)
        archive.addfile(info, io.BytesIO(data))

    with tarfile.open(tmp_path / "a.tar", "w") as archive:
        add(archive, "d/math0001.gz", gzip.compress(b"\\documentclass{article} \\begin{document}"))
        add(archive, "d/p.tex", "\\begin{x} é".encode("latin-1"))
        add(archive, "d/p.pdf", b"\\begin{x}")
        add(archive, "d/n.tex", b"nothing")
        add(archive, "d/broken.gz", b"\x1f\x8bxx")
    (tmp_path / "b.tar").write_bytes(b"broken")
    got = readers.tar_members(spark, [str(tmp_path / "a.tar"), str(tmp_path / "b.tar")])
    assert {(r["name"], r["paper_id"], r["text"]) for r in got.collect()} == {("d/math0001.gz", "math0001", "\\documentclass{article} \\begin{document}"), ("d/p.tex", "p", "\\begin{x} é")}
    (tmp_path / "z.tex.gz").write_bytes(gzip.compress(b"\\begin{a}"))
    assert [r["text"] for r in readers.gzipped_tex(spark, str(tmp_path / "z.tex.gz")).collect()] == ["\\begin{a}"]


def test_votes_titles_and_bundles(spark):
    tagged = spark.createDataFrame([("rings", "ent")] * 3 + [("flat", "verb")] * 3 + [("abc", "ent")] * 9, "word string, pos string")
    assert rows(readers.tagged_votes(tagged, 4)) == [("ring", "ent", 3)]
    page = '<meta charset="%s"><title>' + "t" * 50 + "</title>"
    pages = spark.createDataFrame([(page % "utf-8",)] * 3 + [(page % "koi8-r",)], "html string")
    assert {r["charset"] for r in readers.page_titles(pages).collect()} == {"utf-8"}
    ids = spark.createDataFrame([(0,), (5,), (1_500_000,), (3_000_001,)], "thm_id int")
    bundles = spark.createDataFrame([(1, 3), (2, 1_400_000)], "bundle int, start int")
    assert rows(readers.bundle_of(ids, bundles).fillna(-1)) == [(0, -1), (5, 1), (1_500_000, 2), (3_000_001, 2)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, kind string")
    sinks.write_partitioned(df, str(tmp_path / "p"), ["kind"])
    assert (tmp_path / "p" / "kind=a").exists() and spark.read.parquet(str(tmp_path / "p")).count() == 2
    target = str(tmp_path / "t")
    sinks.publish(df, target)
    sinks.publish(df.limit(1), target)
    assert spark.read.parquet(target).count() == 1
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith("t.")] == []
    sinks.write_text(df.selectExpr("kind"), str(tmp_path / "x"))
    sinks.write_text(df.selectExpr("kind"), str(tmp_path / "x"), append=True)
    assert spark.read.text(str(tmp_path / "x")).count() == 4
    assert rows(sinks.as_json(df, "id", "kind")) == [('{"id":1,"kind":"a"}',), ('{"id":2,"kind":"b"}',)]


def statement(i, thm, hyp=None):
    return (i, thm, hyp, "f", "Lemma", "s", datetime(2020, 1, 1))


def test_streaming_index(spark, tmp_path):
    source, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    for batch in ([statement(1, "flat rings"), statement(2, "ideal")], [statement(1, "flat modules")]):
        spark.createDataFrame(batch, incremental.SCHEMA).write.mode("append").parquet(source)
        incremental.follow(incremental.arriving(spark, source), out, state, once=True).awaitTermination()
    got = {(r["word"], r["thm_id"]) for r in incremental.latest(spark, out).collect()}
    assert got == {("flat", 1), ("module", 1), ("ideal", 2)}


def test_an_index_of_nothing(spark):
    empty = spark.createDataFrame([], incremental.SCHEMA)
    texts = index.parts(index.statements(empty))
    lists = index.token_lists(texts)
    words = vocabulary.word_frequency(index.placed(lists))
    two = ngrams.two_grams(lists)
    assert ngrams.chosen_two_grams(two, words).count() == 0
    assert index.postings(index.index_terms(lists, ngrams.chosen_two_grams(two, words))).count() == 0
    assert index.literal_postings(texts).count() == 0
    assert vocabulary.scored(vocabulary.numbered(words)).count() == 0


def test_latest_delivery_counts(spark):
    early, late = datetime(2020, 1, 1), datetime(2021, 1, 1)
    table = spark.createDataFrame([(1, "old", None, "f", "x", "s", early), (1, "new", "h", "f", "x", "s", late), (1, "new", "h", "f", "x", "s", late), (2, None, None, None, None, None, None)], incremental.SCHEMA)
    assert {(r["thm_id"], r["thm"]) for r in index.statements(table).collect()} == {(1, "new"), (2, None)}
    assert {(r["thm_id"], r["part"]) for r in index.parts(index.statements(table)).collect()} == {(1, "T"), (1, "H")}

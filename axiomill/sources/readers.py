"""Readers of the corpus' input files. Each returns a lazily read DataFrame."""

from __future__ import annotations

import gzip
import io
import tarfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from axiomill.functions import markup
from axiomill.functions import words as W

#: Extensions of archive members that are no TeX, though they may look like it.
NOT_TEX = ("pdf", "ps", "eps", "png", "jpg", "jpeg", "gif", "bbl", "bst", "cls", "sty", "bib", "txt")


def path_list(spark: SparkSession, path: str) -> DataFrame:
    """``path``: non-blank lines, trimmed."""
    return spark.read.text(path).select(F.trim("value").alias("path")).where("path <> ''")


def lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """``line`` of text files in any character encoding that Java knows."""
    if encoding.upper().replace("-", "") == "UTF8":
        return spark.read.text(path).withColumnRenamed("value", "line")
    return spark.read.option("encoding", encoding).option("sep", "\x01").option("quote", "").csv(path).select(F.col("_c0").alias("line"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, at, line``: the place of each line in its file."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", "\r?\n")).alias("at", "line"))


def tar_members(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``archive, name, paper_id, text``: TeX members of tar files (gzipped members are unpacked).

    An archive is read whole (at most 2 GB, the bound of Spark's binary files); a member is TeX by what it holds, unless its extension
    says otherwise. A broken archive or member gives no rows.
    """
    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            out = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    with tarfile.open(fileobj=io.BytesIO(content)) as archive:
                        for member in archive:
                            if member.isfile() and (text := tex_of(member.name, archive.extractfile(member).read())) is not None:
                                stem = member.name.rsplit("/", 1)[-1].split(".gz")[0]
                                out.append((path, member.name, stem.rsplit(".tex", 1)[0], text))
                except (tarfile.TarError, OSError, EOFError):
                    continue
            yield pd.DataFrame(out, columns=["archive", "name", "paper_id", "text"])

    return files.mapInPandas(run, "archive string, name string, paper_id string, text string")


def tex_of(name: str, content: bytes) -> str | None:
    """The text of a TeX file, unpacked if it is gzipped; None for anything else."""
    if content[:2] == b"\x1f\x8b":
        try:
            content = gzip.decompress(content)
        except (OSError, EOFError):
            return None
    if name.lower().removesuffix(".gz").rsplit(".", 1)[-1] in NOT_TEX:
        return None
    if b"\\begin" not in content and b"\\documentclass" not in content and b"\\documentstyle" not in content:
        return None
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        return content.decode("latin-1")


def gzipped_tex(spark: SparkSession, path: str) -> DataFrame:
    """``name, text`` of gzipped TeX files."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            out = [(p, t) for p, c in zip(frame["path"], frame["content"], strict=True) if (t := tex_of(p, c)) is not None]
            yield pd.DataFrame(out, columns=["name", "text"])

    return files.mapInPandas(run, "name string, text string")


def mathematical(files: DataFrame, metadata: DataFrame) -> DataFrame:
    """Files (``name``) whose stem starts with ``math`` or is a known paper, and all .mx files."""
    stem = F.regexp_extract("name", r"([^/]+?)(?:\.tex)?(?:\.gz)?$", 1)
    keyed = files.withColumn("paper_id", stem)
    known = metadata.select("paper_id").distinct().withColumn("known", F.lit(True))
    return keyed.join(known, "paper_id", "left").where(F.col("known") | F.col("paper_id").startswith("math") | F.col("name").endswith(".mx")).drop("known")


def authors_csv(spark: SparkSession, path: str) -> DataFrame:
    """Author rows in the loader's CSV form: quoted by ' and escaped by a backslash."""
    schema = "thm_id int, paper_id string, first_name string, middle_name string, last_name string"
    return spark.read.schema(schema).option("quote", "'").option("escape", "\\").csv(path)


def paper_records(spark: SparkSession, path: str) -> DataFrame:
    """``paper_id, created, title, authors`` of files with four lines for each paper."""
    each = numbered_lines(spark, path).withColumn("record", F.floor(F.col("at") / 4)).withColumn("field", F.col("at") % 4)
    pivoted = each.groupBy("file", "record").agg(*(F.max(F.when(F.col("field") == i, F.trim("line"))).alias(n) for i, n in enumerate(("paper_id", "created", "title", "authors"))))
    return tidy_papers(pivoted.where("paper_id <> ''").drop("file", "record"))


def tidy_papers(papers: DataFrame) -> DataFrame:
    """Ids without a slash, authors without separators at the end, titles with single blanks."""
    return papers.select(
        F.regexp_replace("paper_id", "/", "").alias("paper_id"),
        normal_date(F.col("created")).alias("created"),
        F.trim(F.regexp_replace("title", r"\s+", " ")).alias("title"),
        F.regexp_replace("authors", r"[,;\s]+$", "").alias("authors"),
    )


def normal_date(text):
    """yyyy-MM-dd of 2017-07-26, 2017/7/26 and 20170726; null for anything else."""
    parts = [F.regexp_extract(text, r"^\s*(\d{4})[-/]?(\d{1,2})[-/]?(\d{1,2})\s*$", i) for i in (1, 2, 3)]
    return F.when(parts[0] != "", F.concat_ws("-", parts[0], F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0")))


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """``word, pos, kind``: lines of a word (of any number of parts) and its part of speech."""
    row = F.trim("line")
    parts = lines(spark, path).select(F.regexp_extract(row, r"^(.*\S)\s+(\S+)$", 1).alias("word"), F.regexp_extract(row, r"^(.*\S)\s+(\S+)$", 2).alias("pos"))
    return parts.where("word <> ''").withColumn("kind", F.when(F.col("pos") == "fluff", "fluff").when(F.col("pos").endswith("_comp"), "compound").otherwise("word"))


def fixed_phrases(spark: SparkSession, path: str) -> DataFrame:
    """``trigger, phrase, pos``"""
    p = F.split("line", r"\|")
    return lines(spark, path).where(F.size(p) == 3).select(*(F.trim(p[i]).alias(n) for i, n in enumerate(("trigger", "phrase", "pos"))))


def stock_frequencies(spark: SparkSession, path: str, top: int = 109) -> DataFrame:
    """``rank, word, pos, freq, frequent``: lines of at least four columns; the first ``top`` are
    frequent English."""
    p = F.split(F.trim("line"), r"\s+")
    rows = lines(spark, path).where(F.size(p) >= 4).select(p[0].cast("int").alias("rank"), F.lower(p[1]).alias("word"), p[2].alias("pos"), p[3].cast("bigint").alias("freq"))
    return rows.where("rank is not null").withColumn("frequent", F.col("rank") <= top)


def frequent_words(stock: DataFrame, k: int) -> DataFrame:
    return stock.orderBy("rank").limit(k).select("word", "pos", "rank")


def tagged_votes(tagged: DataFrame, least: int) -> DataFrame:
    """``word, pos, n`` of tags (``word, pos``) that are frequent enough: adjectives and entities at
    two thirds of the threshold; plural entities and verbs in the singular."""
    own = F.when(F.col("pos").isin("ent", "verb"), W.singular(F.col("word"))).otherwise(F.col("word"))
    votes = tagged.where(F.length("word") >= 4).groupBy(own.alias("word"), "pos").agg(F.count("*").alias("n"))
    return votes.where(F.when(F.col("pos").isin("adj", "ent"), F.col("n") * 3 > 2 * least).otherwise(F.col("n") > least))


def ngram_list(spark: SparkSession, path: str) -> DataFrame:
    """``ngram, n``: listed terms in lower case and the singular, ``X, y`` as ``y x``; two or three words."""
    low = F.lower(F.trim("line"))
    turned = F.regexp_replace(F.regexp_replace(low, r"^([^,]+),\s*(.+)$", "$2 $1"), r"^(\S+-adic) l-", "$1 l-")
    rows = lines(spark, path).select(W.singular_last(turned).alias("ngram")).withColumn("n", F.size(F.split("ngram", r"\s+")))
    return rows.where("n in (2, 3)").distinct()


def related_words(spark: SparkSession, path: str) -> DataFrame:
    """``word, kind, rank, related_word`` of lines ``word | synonyms | antonyms | related`` (comma lists);
    ranks go through the three kinds in this order."""
    p = F.split("line", r"\|")
    rows = lines(spark, path).where(F.size(p) >= 2).select(F.trim(p[0]).alias("word"), p.alias("p"))
    kinds = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(k).alias("kind"), F.coalesce(F.get("p", F.lit(i + 1)), F.lit("")).alias("list")) for i, k in enumerate(("synonym", "antonym", "related"))))
    each = rows.select("word", F.explode(kinds).alias("k")).select("word", "k.i", "k.kind", F.posexplode(F.split("k.list", ",")).alias("at", "related_word"))
    kept = each.withColumn("related_word", F.trim("related_word")).where("related_word <> ''")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("word").orderBy("i", "at"))).select("word", "kind", "rank", "related_word")


def synonyms(spark: SparkSession, path: str) -> DataFrame:
    """``representative, word``: the first word of a line stands for the others."""
    p = F.filter(F.transform(F.split("line", ","), lambda w: F.trim(w)), lambda w: w != "")
    return lines(spark, path).select(p.alias("p")).where(F.size("p") > 1).select(F.col("p")[0].alias("representative"), F.explode(F.slice("p", F.lit(2), F.size("p"))).alias("word"))


def synonyms_json(spark: SparkSession, path: str) -> DataFrame:
    """``word, rank, related_word`` of a JSON object of lists."""
    whole = spark.read.text(path, wholetext=True)
    each = whole.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("word", "list"))
    return each.select("word", F.posexplode("list").alias("at", "related_word")).select("word", (F.col("at") + 1).alias("rank"), "related_word")


def page_titles(pages: DataFrame, least: int = 3) -> DataFrame:
    """``charset, title`` of pages (``html``); encodings with fewer than ``least`` titles are left out."""
    each = pages.select(F.coalesce(markup.html_charset(F.col("html")), F.lit("unknown")).alias("charset"), F.explode(markup.html_titles(F.col("html"))).alias("title"))
    enough = each.groupBy("charset").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return each.join(enough.select("charset"), "charset", "left_semi")


def bundle_of(ids: DataFrame, bundles: DataFrame) -> DataFrame:
    """``thm_id, bundle``: the bundle (``bundle, start``) with the greatest start not above the id.

    An as-of lookup by one sort of ids and starts together, not a range join.
    """
    both = ids.select("thm_id", F.lit(None).cast("int").alias("bundle"), F.lit(1).alias("kind")).unionByName(bundles.select(F.col("start").alias("thm_id"), F.col("bundle").cast("int"), F.lit(0).alias("kind")))
    size = F.floor(F.col("thm_id") / 1_000_000)  # ids sort within ranges; a range's first bundle is carried over
    part = both.withColumn("range", size)
    last = part.groupBy("range").agg(F.max_by("bundle", F.when(F.col("kind") == 0, F.col("thm_id"))).alias("last"))
    carried = last.withColumn("carried", F.last("last", True).over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))).select("range", "carried")
    own = F.last("bundle", True).over(Window.partitionBy("range").orderBy("thm_id", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return part.withColumn("own", own).join(carried, "range").where("kind = 1").select("thm_id", F.coalesce("own", "carried").alias("bundle"))

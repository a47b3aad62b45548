"""Words of a statement: splitting, singular forms, validity, scores. All are Column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that separate words (an escaped quote doesn't), and that no index word has.
SEPARATORS = r"(\s+|'s|'|\"|\(|\)|\{|\}|\[|\]|\.|;|,|:|-|_|~|!|\+)"
SPECIAL = r"[-\\=$\{\}\[\]()^_+%&\./,:;!~\"\d@><*|`�]"
SPECIAL_LITERAL = r"[-\{\[\)\(\}\]$%/|?@*.;,:_~!+^&<>=#\\\"'`]"
# Fixed value: a letter's accent in TeX, which belongs to the word.
ACCENT = r"\\[\"'`]"
# Words too common to be searched for.
STOP_WORDS = (
    "a an and any are as assume at be been being between both but by can defined denote each every exist exists following for from "
    "furthermore given has have here if in is it its itself just let may moreover more no not of on one only or other over same "
    "satisfies satisfy satisfying show so some such suppose than that the their then there these they this thus to two under unless "
    "via was we when whenever where whereas which whose with whole"
).split()
# Generic terms, of little weight when alone.
GENERIC_TERMS = "sum equation polynomial function basis group ring field module series coefficient decomposition resolution problem example space".split()
# Plurals without a rule.
IRREGULAR = {"matrices": "matrix", "series": "series"}
# Letters with diacritics, and what they become.
DIACRITICS = ("áéíóöőúüűŷśøěè", "aeiooouuuysoee")
GREEK = "alpha beta gamma delta epsilon omega iota theta phi".split()
# Endings of adjectives and of nouns.
ADJECTIVE_ENDINGS = "tive wise ary ble ous ent like nal lar nian cal ed".split()
NOUN_ENDINGS = "tion son ace ty sor ser ty ture".split()
# Tags of the Penn treebank and the parts of speech used here.
TAGS = {
    "NN": "ent", "NNS": "ent", "NNP": "ent", "NNPS": "ent", "JJ": "adj", "JJR": "adj", "JJS": "adj", "RB": "adverb", "RBR": "adverb",
    "VB": "verb", "VBZ": "verb", "VBP": "verb", "VBD": "verbpast", "VBN": "parti", "VBG": "gerund", "IN": "pre", "TO": "pre",
    "DT": "det", "CC": "conj", "CD": "num", "PRP": "pro", "PRP$": "poss", "WDT": "rpro", "WP": "rpro", "MD": "vbs",
}


def starred_algebra(text: Column) -> Column:
    r"""C*-algebra in its spellings (c^*-algebra, $\mathrm{c}^*$ algebra) to ``c-algebra``."""
    return F.regexp_replace(text, r"(^|\s)(?:\$\\mathrm\{c\}\^\*\$|\$*c\^*\*\$*)[-\s]algebra", "$1c-algebra")


def split_words(text: Column) -> Column:
    """Lower-cased words in order; null gives null, text without words the empty list."""
    kept = F.regexp_replace(F.regexp_replace(F.lower(text), r"\\'", "\x01"), r"\\\"", "\x02")
    found = F.filter(F.split(kept, SEPARATORS), lambda w: F.trim(w) != "")
    return F.transform(found, lambda w: F.replace(F.replace(w, F.lit("\x01"), F.lit("\\'")), F.lit("\x02"), F.lit('\\"')))


def distinct_words(text: Column) -> Column:
    return F.array_distinct(split_words(text))


def quoted_sections(query: str) -> list[str]:
    """Words of a query; a quoted span is one token."""
    import re

    out = []
    for quoted, plain in re.findall(r'"([^"]+)"|([^"]+)', query.lower()):
        out += [quoted.strip()] if quoted else [w for w in re.split(SEPARATORS, plain) if w and not re.fullmatch(SEPARATORS, w)]
    return [w for w in out if w.strip()]


def strip_umlaut(word: Column) -> Column:
    # Most words have neither, and a search costs less than two patterns.
    marked = F.contains(word, F.lit("\\")) | F.contains(word, F.lit("{"))
    return F.when(marked, F.regexp_replace(F.regexp_replace(word, ACCENT, ""), r"\{([A-Za-z])\}", "$1")).otherwise(word)


def remove_diacritics(text: Column) -> Column:
    return F.translate(text, *DIACRITICS)


def singular(word: Column, kept: Iterable[str] = ()) -> Column:
    """The singular form: -ies to -y, -es dropped (its e kept unless after s, h, x, o), -s dropped.
    ``kept``: frequent words that stay as they are."""
    kept = list(kept)
    cut = F.substring(word, F.lit(1), F.length(word) - 2)
    return (
        F.when((F.length(word) < 4) | (word.isin(*kept) if kept else F.lit(False)), word)
        .when(F.substring(word, -2, 2).isin("is", "us", "ss"), word)
        .when(word.isin(*IRREGULAR), F.create_map(*(F.lit(x) for kv in IRREGULAR.items() for x in kv))[word])
        .when(word.endswith("ies"), F.concat(F.substring(word, F.lit(1), F.length(word) - 3), F.lit("y")))
        .when(word.endswith("es"), F.when(F.substring(cut, -1, 1).isin("s", "h", "x", "o"), cut).otherwise(F.concat(cut, F.lit("e"))))
        .when(word.endswith("s") & ~word.rlike("(?:us|is|ness|has)$"), F.substring(word, F.lit(1), F.length(word) - 1))
        .otherwise(word)
    )


def singular_last(phrase: Column) -> Column:
    """An n-gram with its last word in the singular (:func:`singular` looks at endings only)."""
    return singular(phrase)


def is_index_word(word: Column) -> Column:
    return ~word.rlike(SPECIAL)


def index_words(text: Column) -> Column:
    """The index words of a text in order: C*-algebras in one spelling, accents of TeX taken off their
    letters, words with special characters or digits left out."""
    return F.filter(F.transform(split_words(starred_algebra(F.lower(text))), strip_umlaut), is_index_word)


def is_literal_word(word: Column, stop_words: Iterable[str] = STOP_WORDS) -> Column:
    """Valid in the literal index: 3 to 15 characters, no special characters (but accents of TeX) or
    digits, no stop word."""
    plain = ~F.regexp_replace(word, ACCENT, "").rlike(SPECIAL_LITERAL) & ~word.rlike(r"[\d�]")
    return F.length(word).between(3, 15) & plain & ~word.isin(*stop_words)


def is_alphabetic(word: Column) -> Column:
    return word.rlike(r"^[a-z\s]+\z")


def escaped_at(text: Column, position: Column) -> Column:
    """Whether the character at the 1-based position follows an odd run of backslashes."""
    before = F.substring(text, F.lit(1), position - 1)
    return F.length(F.regexp_extract(before, r"(\\*)$", 1)) % 2 == 1


def names_alike(a: Column, b: Column) -> Column:
    """Names of which one is the other cut by at most its last letter; where lengths differ by more
    than two, their last words are compared."""
    last_a, last_b = (F.element_at(F.split(F.trim(x), r"\s+"), -1) for x in (a, b))
    far = F.abs(F.length(a) - F.length(b)) > 2
    x, y = F.when(far, last_a).otherwise(a), F.when(far, last_b).otherwise(b)
    n = F.greatest(F.least(F.length(x), F.length(y)) - 1, F.lit(1))
    return F.substring(x, F.lit(1), n) == F.substring(y, F.lit(1), n)


def tex_alike(a: Column, b: Column) -> Column:
    """Both hold a formula, the first is shorter than 15 characters and their lengths differ by less than 4."""
    return a.rlike(r"\$[^$]+\$") & b.rlike(r"\$[^$]+\$") & (F.length(a) < 15) & (F.abs(F.length(a) - F.length(b)) < 4)


def is_quantity(word: Column) -> Column:
    """A number word, a fraction or a plain number."""
    return word.rlike(
        r"^(?:one|two|three|four|five|six|seven|eight|nine|ten|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand|million|billion)"
        r"(?:-(?:one|two|three|four|five|six|seven|eight|nine))?$|^\d+(?:/\d+)?$"
    )


def is_greek(word: Column) -> Column:
    return word.isin(*GREEK)


def part_of_speech(tag: Column) -> Column:
    """Null for tags that stand for nothing."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in TAGS.items() for x in kv)), tag)


def suffix_part_of_speech(word: Column) -> Column:
    """A guess by the ending: adverbs and gerunds, then adjectives, then nouns; null if none fits."""
    return (
        F.when(word.rlike(".ly$"), "adverb")
        .when(word.rlike(".ing$"), "gerund")
        .when(word.rlike(f".(?:{'|'.join(ADJECTIVE_ENDINGS)})$"), "adj")
        .when(word.rlike(f".(?:{'|'.join(NOUN_ENDINGS)})$"), "ent")
    )


def strip_blanks(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def escape_blanks(text: Column) -> Column:
    """Each run of white space as one escaped blank, as file names in shell commands have it."""
    return F.regexp_replace(text, r"\s+", r"\\ ")


def longest_first(rows, column: str):
    """``rows`` with ``rn``, their place by falling length of ``column``, ties in its order.

    The lengths are counted first, so that no task sorts more than the values of one length.
    """
    from pyspark.sql import Window

    sizes = rows.groupBy(F.length(column).alias("_n")).agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.orderBy(F.desc("_n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("_n").orderBy(column))
    return rows.withColumn("_n", F.length(column)).withColumn("_w", within).join(sizes.select("_n", before.alias("_b")), "_n").select(*rows.columns, (F.col("_w") + F.col("_b")).cast("bigint").alias("rn"))


def word_score(frequency: Column) -> Column:
    """The weight of a word of this frequency, in whole numbers; it falls in steps and is at least 3."""
    f = frequency
    score = F.when(f < 40, F.lit(20) - (f - f % 3) / 3).when(f < 180, F.lit(35) - (f - f % 4) / 4).when(f < 350, F.lit(4)).otherwise(F.lit(3))
    whole = score.cast("int")
    return F.when(whole <= 0, F.lit(3)).otherwise(whole)


def ngram_score(own: Column, words: Column) -> Column:
    """An n-gram weighs at least one more than its words together."""
    return F.greatest(own, words + 1)


def name_parts(author: Column) -> Column:
    """``first, middle, last`` of a lower-cased name as typed, split at dots and blanks."""
    parts = F.filter(F.split(F.lower(F.trim(author)), r"[.\s]+"), lambda p: p != "")
    n = F.size(parts)
    return F.struct(
        F.when(n >= 2, F.element_at(parts, 1)).otherwise(F.lit("")).alias("first"),
        F.when(n >= 3, F.element_at(parts, 2)).otherwise(F.lit("")).alias("middle"),
        F.when(n >= 1, F.element_at(parts, -1)).otherwise(F.lit("")).alias("last"),
    )

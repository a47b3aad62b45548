"""Markup of statements: cleaning TeX, kinds of statements, formulas, and what may be left out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Environment names and the kinds of statement they start.
KINDS = {"thm": "Theorem", "theo": "Theorem", "prop": "Proposition", "lem": "Lemma", "proclaim": "Claim", "cor": "Corollary", "conj": "Conjecture", "def": "Definition"}
# Words that introduce a hypothesis.
HYPOTHESIS = r"(?:assume|denote|define|let|is said|suppose|where|is called|if|given)."
# Formatting commands without content of their own, in the order in which they are tried.
FORMATTING = "(?i)" + "|".join((
    r"\\df(?!rac)", r"\\emph", r"\\em", r"\\rm ", r"\\cat", r"\\it(?!e)", r"\\eqref", r"\\subsection", r"\\section", r"\\bf", r"\\vspace",
    r"\\ensuremath", r"\\(?:textbf|textsl|textsc|textnormal)", r"\\linebreak", r"(?<!\\)%",
    r"\\fml", r"\\ofml", r"\\(?:begin|end)\{enumerate\}", r"\\(?:begin|end)\{(?:sub)*section\**\}",
    r"\\begin\{slogan\}", r"\\end\{slogan\}", r"\\sbsb", r"\\cat", r"\\bs", r"\\maketitle", r"\\textup",
    r"\\section\**\{(?:[^}]*)\}\s*", r"\\noindent", r"\\(?:small|big)skip",
    r"\\cite\{[^}]+\}", r"\\cite\[[^\]]+\]", r"\\par\s", r"\\(?:begin|end)\{displaymath\}",
))
STATEMENT_ENDS = r"(?i)\\(?:begin|end)\{(?:def|lem|th|pr|co|re)[^}]*\}\s*"
FORMULA = r"\$[^$]*\$"


def cleaned(text: Column) -> Column:
    """Without formatting commands and statement environments; \\item becomes a dash, < and > stand
    free, \\index{a!b} goes."""
    out = F.regexp_replace(text, r"\\index\{[^}]*\}%*", "")
    out = F.regexp_replace(out, FORMATTING, "")
    out = F.regexp_replace(out, STATEMENT_ENDS, "")
    out = F.regexp_replace(out, r"\\item\b", " -")
    out = F.regexp_replace(out, r"([<>])", " $1 ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def without_lists(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(?:begin|end)\{(?:enumerate|itemize)\}", "")


def kind(name: Column) -> Column:
    """The kind of statement of an environment or label, by its first letters; null if none fits."""
    low = F.lower(F.trim(name))
    out = F.lit(None).cast("string")
    for start, value in KINDS.items():
        out = F.when(low.startswith(start), value).otherwise(out)
    return out


def is_hypothesis(text: Column) -> Column:
    return F.lower(text).rlike(HYPOTHESIS)


def balanced(text: Column) -> Column:
    """An odd number of $ gets one more at the end; an open \\[ is closed."""
    dollars = F.length(text) - F.length(F.replace(text, F.lit("$"), F.lit("")))
    opened = (F.length(text) - F.length(F.replace(text, F.lit("\\["), F.lit("")))) - (F.length(text) - F.length(F.replace(text, F.lit("\\]"), F.lit(""))))
    return F.when(dollars % 2 == 1, F.concat(text, F.lit("$"))).when(opened > 0, F.concat(text, F.lit("\\]"))).otherwise(text)


def plain_words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(text, FORMULA, " "), r"\s+"), lambda w: w.rlike("[A-Za-z]"))


def is_wordy(text: Column) -> Column:
    """At least four words outside formulas, and not mostly formula: formulas may have at most 102
    characters, and not above nine tenths of more than 55 in all; at most 12 of them."""
    words = F.size(plain_words(text))
    formulas = F.regexp_extract_all(text, F.lit(f"({FORMULA})"), F.lit(1))
    chars = F.length(F.array_join(formulas, ""))
    heavy = (chars > 102) | ((chars > F.length(text) * 0.9) & (chars > 55)) | (F.size(formulas) > 12)
    return (words >= 4) & ~heavy


def plain_text(text: Column) -> Column:
    """Words of two letters or more without special characters, joined by blanks."""
    parts = F.filter(F.split(text, r"[\s\"'{}\-]+"), lambda w: (F.length(w) >= 2) & w.rlike(r"^[A-Za-z]+\z"))
    return F.array_join(parts, " ")


def function_names(text: Column) -> Column:
    """Names in ``the ... function | polynomial | number``."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"\bthe ([a-z][a-z ]{2,21}[a-z]) (?:function|polynomial|number)\b"), F.lit(1))
    return F.filter(found, lambda n: ~n.rlike(r"\b(?:the|in|of|as|on|is)\b"))


def source_url(file_name: Column) -> Column:
    """The address of the archive entry a file belongs to, for names such as math0001001 or 1203.4567."""
    old = F.regexp_extract(file_name, r"([a-z]{4})(\d{7})", 0)
    new = F.regexp_extract(file_name, r"\d+\.\d+", 0)
    base = "https://arxiv.org/abs/"
    return F.when(new != "", F.concat(F.lit(base), new)).when(old != "", F.concat(F.lit(base), F.substring(old, 1, 4), F.lit("/"), F.substring(old, 5, 7)))


def sentences(text: Column) -> Column:
    """Parts between closing marks followed by a blank, trimmed."""
    return F.filter(F.transform(F.split(text, r"[.!?;:]\s+|\.$|\n+"), lambda s: F.trim(s)), lambda s: s != "")


def html_titles(html: Column) -> Column:
    """Contents of <title> and title="..." of at least 40 characters."""
    inside = F.regexp_extract_all(html, F.lit(r"(?is)<title[^>]*>([^<]+)</title>"), F.lit(1))
    attributes = F.regexp_extract_all(html, F.lit(r'(?i)\btitle="([^"]+)"'), F.lit(1))
    return F.filter(F.transform(F.concat(inside, attributes), lambda t: F.trim(t)), lambda t: F.length(t) >= 40)


def html_charset(html: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(html, r"(?i)<meta[^>]*charset=[\"']?([\w-]+)", 1)), F.lit(""))

"""From TeX sources to statements: environments, macros, labels, variables and their definitions.

The per-text parts are plain functions of a string, applied in Arrow batches; lookups across a
paper (labels, definitions) are joins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axiomill.functions import markup

#: Longest statement, context before it, definition, and definitions of one statement.
STATEMENT, CONTEXT, DEFINITION, DEFINITIONS, LABEL_BLOCK = 1800, 15000, 270, 3, 250
STARTS = "def|lem|theo|thm|prop|cor|conj|proclaim"
SKIPPED = re.compile(r"\\begin\{(proof|exam\w*|thebib\w*)\}.*?\\end\{\1\}", re.S)
NEW_THEOREM = re.compile(r"\\newtheorem\*?\s*\{([^}]+)\}(?:\[[^\]]*\])?\s*\{([^}]+)\}")
DEFINERS = re.compile(r"\\(?:re|provide)?(?:new)?command\*?\s*\{?(\\[A-Za-z]+)\}?\s*(?:\[(\d)\])?(?:\[([^\]]*)\])?\s*(?=\{)|\\def\s*(\\[A-Za-z]+)((?:#\d)*)\s*(?=\{)|\\DeclareMathOperator\*?\s*\{?(\\[A-Za-z]+)\}?\s*(?=\{)")


def group(text: str, at: int) -> int:
    """The place after the brace group that opens at ``at``; -1 if it isn't closed."""
    depth = 0
    while at < len(text):
        c = text[at]
        if c == "\\":
            at += 2
            continue
        depth += (c == "{") - (c == "}")
        at += 1
        if not depth:
            return at
    return -1


def macros(text: str) -> dict[str, tuple[str, int, str | None]]:
    """command -> (replacement, slots, default of the first slot)"""
    found = {}
    for m in DEFINERS.finditer(text):
        end = group(text, m.end())
        if end < 0:
            continue
        body = text[m.end() + 1 : end - 1]
        if m.group(1):
            found[m.group(1)] = (body, int(m.group(2) or 0), m.group(3))
        elif m.group(4):
            found[m.group(4)] = (body, m.group(5).count("#"), None)
        else:
            found[m.group(6)] = (rf"\operatorname{{{body}}}" if body else body, 0, None)
    return found


def expand(text: str, known: dict[str, tuple[str, int, str | None]], depth: int = 2) -> str:
    """``text`` with macros replaced: the longest command that isn't followed by a letter, its
    arguments in braces or single characters, nested up to ``depth`` times."""
    if not known or depth == 0:
        return text
    names = re.compile("|".join(re.escape(k) + (r"(?![A-Za-z])" if k[-1].isalpha() else "") for k in sorted(known, key=len, reverse=True)))
    out, at = [], 0
    while m := names.search(text, at):
        out.append(text[at : m.start()])
        body, slots, default = known[m.group()]
        at, args = m.end(), []
        if default is not None:
            option = re.compile(r"\s*\[([^\]]*)\]").match(text, at)
            args.append(option.group(1) if option else default)
            at = option.end() if option else at
        while len(args) < slots:
            start = at + len(text[at:]) - len(text[at:].lstrip())
            if start >= len(text):
                break
            end = group(text, start) if text[start] == "{" else start + 1
            if end < 0:
                break
            args.append(text[start + 1 : end - 1] if text[start] == "{" else text[start])
            at = end
        for i, arg in enumerate(args, 1):
            body = body.replace(f"#{i}", arg)
        out.append(expand(body, known, depth - 1))
    return "".join(out) + text[at:]


def without_footnotes(text: str) -> str:
    out, at = [], 0
    for m in re.finditer(r"\\footnote\s*(?=\{)", text):
        if m.start() >= at and (end := group(text, m.end())) > 0:
            out.append(text[at : m.start()])
            at = end
    return "".join(out) + text[at:]


def extract(text: str) -> list[tuple[int, str, str, str]]:
    """(place, kind, statement, context) of a paper, in order.

    Environments are those with the usual beginnings and those that \\newtheorem declares; proofs,
    examples and the bibliography are skipped, comments dropped, macros expanded. The context is the
    text since the last statement (its last 15000 characters). Too long statements are left out. An
    environment that isn't closed before the next one begins is left out, and so is its text.
    """
    own = {m.group(1): m.group(2) for m in NEW_THEOREM.finditer(text)}
    known = macros(text)
    body = text.split("\\begin{document}", 1)[-1]
    body = re.sub(r"(?m)^%.*\n?|(?<!\\)%.*$", "", body)
    body = SKIPPED.sub("", body)
    names = "|".join(sorted(map(re.escape, own), key=len, reverse=True))
    start = re.compile(rf"\\begin\s*\{{((?:{STARTS})\w*\*?{'|' + names if names else ''})\}}(?:\[[^\]]*\])?")
    out, at = [], 0
    while m := start.search(body, at):
        end = re.compile(rf"\\end\s*\{{{re.escape(m.group(1))}\}}").search(body, m.end())
        following = start.search(body, m.end())
        if not end or (following and following.start() < end.start()):
            at = m.end()
            continue
        statement = expand(without_footnotes(body[m.end() : end.start()]).strip(), known)
        if 0 < len(statement) <= STATEMENT:
            out.append((len(out), kind_of(m.group(1), own), statement, expand(body[at : m.start()].strip()[-CONTEXT:], known)))
        at = end.end()
    return out


def kind_of(name: str, own: dict[str, str]) -> str:
    for text in (own.get(name, ""), name):
        for start, value in markup.KINDS.items():
            if text.lower().startswith(start) or value.lower() in text.lower():
                return value
    return "Theorem"


def statements(papers: DataFrame) -> DataFrame:
    """``paper_id, at, kind, thm, hyp`` of papers (``paper_id, text``); null texts give no rows."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            out = [(p, *s) for p, t in zip(frame["paper_id"], frame["text"], strict=True) for s in extract(t)]
            yield pd.DataFrame(out, columns=["paper_id", "at", "kind", "thm", "hyp"])

    return papers.where("text is not null").select("paper_id", "text").mapInPandas(run, "paper_id string, at int, kind string, thm string, hyp string")


def resolved(statements_: DataFrame) -> DataFrame:
    """Statements with \\label removed and each \\ref replaced by ``[k]``, the k-th label it names;
    the labelled statements' beginnings follow."""
    label, ref = r"\\label\{([^}$]*)\}", r"\\ref\{([^}$]*)\}"
    bare = statements_.withColumn("bare", F.trim(F.regexp_replace("thm", label, "")))
    labels = bare.select("paper_id", F.explode(F.regexp_extract_all("thm", F.lit(label), F.lit(1))).alias("label"), F.substring("bare", 1, LABEL_BLOCK).alias("target"))
    labels = labels.groupBy("paper_id", "label").agg(F.min("target").alias("target"))
    refs = bare.select("paper_id", "at", F.posexplode(F.array_distinct(F.regexp_extract_all("bare", F.lit(ref), F.lit(1)))).alias("k", "label"))
    met = refs.join(labels, ["paper_id", "label"]).groupBy("paper_id", "at").agg(F.array_sort(F.collect_list(F.struct("k", "label", "target"))).alias("met"))
    joined = bare.join(met, ["paper_id", "at"], "left")
    replaced = F.aggregate(F.coalesce("met", F.array().cast("array<struct<k:int,label:string,target:string>>")), F.col("bare"), lambda s, m: F.replace(s, F.concat(F.lit("\\ref{"), m["label"], F.lit("}")), F.concat(F.lit("["), (m["k"] + 1).cast("string"), F.lit("]"))))
    appended = F.concat_ws(" ", replaced, F.array_join(F.transform("met", lambda m: F.concat(F.lit("["), (m["k"] + 1).cast("string"), F.lit("] "), m["target"])), " "))
    return joined.withColumn("thm", appended).drop("bare", "met")


def variables(tex: str) -> list[str]:
    r"""Variables of a formula: letters, Greek names, \mathbb{X}, and subscripted ones with their parts."""
    out: dict[str, None] = {}
    for m in re.finditer(r"\\(?:math\w+)\s*\{\s*(\w)\s*\}|\\([A-Za-z]+)|([A-Za-z])(?:_(\{[^{}]*\}|\w))?", tex):
        styled, command, letter, sub = m.groups()
        if styled:
            out[styled] = None
        elif command:
            if command in GREEK:
                out[command] = None
        else:
            if sub:
                out[f"{letter}_{sub}"] = None
                for inner in variables(sub.strip("{}")):
                    out[inner] = None
            out[letter] = None
    return list(out)


#: Names of Greek letters.
GREEK = frozenset("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau upsilon phi chi psi omega".split())


def definitions(texts: DataFrame) -> DataFrame:
    """``paper_id, at, variable, sentence``: sentences that introduce a variable (let, fix, denote ..),
    of at most 270 characters. ``texts(paper_id, at, text)``, ``at`` ordering a paper's texts."""
    each = texts.select("paper_id", "at", F.posexplode(markup.sentences(F.col("text"))).alias("i", "sentence"))
    introducing = each.where(F.col("sentence").rlike(r"^(?i)(?:let|fix|denote|suppose|write|we write|throughout|here|consider)\b") & (F.length("sentence") <= DEFINITION))
    return introducing.select("paper_id", (F.col("at").cast("bigint") * 1000 + F.col("i")).alias("at"), F.explode(F.array_distinct(F.regexp_extract_all("sentence", F.lit(r"\$([A-Za-z])\$"), F.lit(1)))).alias("variable"), "sentence")


def attached(uses: DataFrame, defined: DataFrame, local: DataFrame | None = None) -> DataFrame:
    """``paper_id, at, variable, sentence``: for each use the last definition before it. A definition
    in the statement itself (``local``, as :func:`definitions` has them) shadows it: none is attached.

    An as-of join by one sort of uses and definitions of a paper's variable together; null if the
    variable isn't defined before.
    """
    keys = ["paper_id", "variable"]
    if local is not None:
        own = local.select("paper_id", "variable", F.floor(F.col("at") / 1000).cast(dict(uses.dtypes)["at"]).alias("at")).distinct()
        uses = uses.join(own, ["paper_id", "at", "variable"], "left_anti")
    both = uses.select(*keys, (F.col("at").cast("bigint") * 1000 + 999).alias("t"), F.col("at"), F.lit(None).cast("string").alias("sentence"), F.lit(1).alias("use")).unionByName(
        defined.select(*keys, F.col("at").alias("t"), F.lit(None).cast("int").alias("at"), "sentence", F.lit(0).alias("use"))
    )
    last = F.last("sentence", True).over(Window.partitionBy(*keys).orderBy("t", "use").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return both.withColumn("sentence", last).where("use = 1").select("paper_id", "at", "variable", "sentence")


def theorem_names(text):
    """Up to six words before and seven after theorem, lemma or conjecture, unless punctuation ends them."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"((?:[a-z-]+ ){0,6}(?:theorem|lemma|conjecture)(?: [a-z-]+){0,7})"), F.lit(1))
    return F.filter(found, lambda n: ~n.rlike(r"\b(?:from|proof|prove\w*|next)\b"))


def substituted(text: str, nouns: dict[str, str]) -> str:
    """Each formula of one variable with its defining noun after it."""
    return re.sub(r"\$([A-Za-z])\$(?! +(?:is|be)\b)", lambda m: m.group() + (f" ({nouns[m.group(1)]})" if m.group(1) in nouns else ""), text)


def sentences(text: str) -> list[str]:
    """Sentences for the parser: closed by . ! : ; or a comma outside formulas, bracketed remarks left
    out, words in lower case. A comma before a preposition falls away; one between formulas is an and."""
    formulas = re.findall(r"\$[^$]*\$", text)
    bare = re.sub(r"\$[^$]*\$", "\x00", text)
    bare = re.sub(r"\([^()]*\)|\[[^\[\]]*\]", " ", bare).lower()
    bare = re.sub(r"\x00\s*,\s*\x00", "\x00 and \x00", bare)
    bare = re.sub(r",\s*(?=(?:in|on|of|with|for|to|by|from|over|under|at)\b)", " ", bare)
    numbers = iter(range(len(formulas)))
    kept = re.sub(r"\x00", lambda m: f"\x01{next(numbers)}\x02", bare)
    out = [re.sub(r"\x01(\d+)\x02", lambda m: formulas[int(m.group(1))], s).strip() for s in re.split(r"[.!:;,]+(?:\s+|$)", kept)]
    return [re.sub(r"\s+", " ", s) for s in out if s]

"""From parsed sentences to meaning: commands, relations of words, and what TeX says in words.

A *command* is a template over the parts of a sentence ("there exists X such that Y"). Commands are
looked up by their trigger word, matched in order with optional parts, and the match that takes up
most words wins. Its terms tell which relation a word stands in: what something is (slot 1), what is
something (slot 0), a condition (2), an existence (3).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axiomill.operators import parsing
from axiomill.operators.extraction import sentences
from axiomill.operators.parsing import Node

#: The slots of relation bits, and the codes of words that head a relation.
SUBJECT, PREDICATE, CONDITION, EXISTENCE = 0, 1, 2, 3
EXISTS, HAS_PROPERTY, FOR_ALL, ELEMENT, DEFAULT = -8, -8, -8, -7, -10


@dataclass(frozen=True)
class Part:
    """A part of a command: a word of ``words``, or a constituent of ``kinds`` with a ``name`` and the
    ``slots`` of its words. ``many``: as many items as the rest of the command leaves."""

    words: tuple = ()
    kinds: tuple = ()
    name: str = ""
    slots: tuple = ()
    optional: bool = False
    many: bool = False


def word(*words: str, optional: bool = False) -> Part:
    return Part(words=words, optional=optional)


def thing(name: str, *slots: int, kinds: tuple = ("np", "pro")) -> Part:
    return Part(kinds=kinds, name=name, slots=slots)


def clause(name: str, *slots: int) -> Part:
    return Part(name=name, slots=slots, many=True)


BE = ("is", "are", "be", "was", "were")
#: name -> (parts, template, code of the head). The first part with words holds the triggers.
COMMANDS: dict[str, tuple[tuple[Part, ...], str, int]] = {
    "iff": ((clause("a", CONDITION), word("iff"), clause("b", CONDITION)), "{a} \\[DoubleLeftRightArrow] {b}", DEFAULT),
    "implies": ((word("if", "when", "whenever", "suppose", "assume"), clause("a", CONDITION), word("then"), clause("b")), "Implies[{a}, {b}]", DEFAULT),
    "condition": ((word("if", "when", "whenever", "unless", "suppose", "assume"), clause("a", CONDITION)), "If[{a}]", DEFAULT),
    "exists": ((word("there"), word("exists", "exist", *BE), thing("a", EXISTENCE), word("such", optional=True), word("that", optional=True), clause("b")), "\\[Exists][{a}, {b}]", EXISTS),
    "exists_alone": ((word("there"), word("exists", "exist", *BE), thing("a", EXISTENCE)), "\\[Exists][{a}]", EXISTS),
    "for_all": ((word("for"), thing("a", CONDITION), clause("b")), "\\[ForAll][{a}, {b}]", FOR_ALL),
    "let": ((word("let", "fix", "consider", "denote"), thing("a", SUBJECT), word("be", "by"), thing("b", PREDICATE)), "{a} \\[Element] {b}", ELEMENT),
    "given": ((word("let", "fix", "consider", "given"), thing("a", SUBJECT)), "Given[{a}]", DEFAULT),
    "element_of": ((thing("a", SUBJECT), word(*BE), word("in"), thing("b", PREDICATE)), "{a} \\[Element] {b}", ELEMENT),
    "belongs": ((thing("a", SUBJECT), word("belongs", "belong"), word("to"), thing("b", PREDICATE)), "{a} \\[Element] {b}", ELEMENT),
    "is_a": ((thing("a", SUBJECT), word(*BE), thing("b", PREDICATE)), "{a} \\[Element] {b}", ELEMENT),
    "has_property": ((thing("a", SUBJECT), word(*BE), thing("b", PREDICATE, kinds=("adj",))), "HasProperty[{a}, {b}]", HAS_PROPERTY),
    "has": ((thing("a", SUBJECT), word("has", "have", "contains", "contain", "admits", "admit"), thing("b", PREDICATE)), "HasProperty[{a}, {b}]", HAS_PROPERTY),
    "maps": ((thing("a", SUBJECT), word("maps", "sends", "send", "takes"), thing("b", SUBJECT), word("to", "into"), thing("c", PREDICATE)), "{a}: {b} -> {c}", DEFAULT),
    "derivative": ((word("derivative"), word("of"), thing("a"), word("with"), word("respect"), word("to"), thing("b")), "D[{a}, {b}]", DEFAULT),
    "integral": ((word("integral"), word("of"), thing("a"), word("over", "on", "along"), thing("b")), "Integrate[{a}, {b}]", DEFAULT),
    "verb": ((thing("a", SUBJECT), Part(kinds=("verb",), name="v"), thing("b", PREDICATE)), "{a} ~{v}~ {b}", DEFAULT),
}


def items_of(sentence: str) -> list[Node]:
    """The noun phrases and words of a sentence, triggers of commands being words of their own."""
    text = re.sub(r"\bif and only if\b", "iff", sentence)
    tagged = [(w, "word" if w in TRIGGERS else tag) for w, tag in parsing.tagged(text)]
    return parsing.items(tagged)


TRIGGERS = frozenset(w for parts, _, _ in COMMANDS.values() for p in parts for w in p.words if w in ("iff", "derivative", "integral", "respect", "maps", "takes", "belongs"))


#: What the items of a sentence must have for a command: one of each of these words, one of each of these kinds.
NEEDED = {
    name: ([frozenset(p.words) for p in parts if p.words and not p.optional], [frozenset(p.kinds) for p in parts if p.kinds and not p.words and not p.optional])
    for name, (parts, _, _) in COMMANDS.items()
}


def matched(parts: tuple[Part, ...], items: list[Node], at: int) -> tuple[int, dict[str, list[Node]]] | None:
    """(the place after the match, the items of each name) of ``parts`` from ``at`` on."""
    if not parts:
        return at, {}
    first, rest = parts[0], parts[1:]
    if first.many:
        for end in range(len(items), at, -1):
            if (found := matched(rest, items, end)) is not None:
                return found[0], {first.name: items[at:end]} | found[1]
        return None
    if at < len(items):
        item = items[at]
        fits = item.text in first.words if first.words else item.category in first.kinds
        if fits and (found := matched(rest, items, at + 1)) is not None:
            return found[0], ({first.name: [item]} if first.name else {}) | found[1]
    return matched(rest, items, at) if first.optional else None


def spoken(nodes: list[Node]) -> str:
    """A term of a command: a command again where one fits its items, else each item."""
    if len(nodes) == 1:
        node = nodes[0]
        return f"Math[{node.text}]" if node.category == "np" and not node.text.startswith("$") else node.text
    inner = command(nodes)
    return inner[1] if inner else " ".join(parsing.thing(n) if n.category == "np" and " " in n.text else n.text for n in nodes)


def best_match(items: list[Node]) -> tuple[int, str, dict[str, list[Node]]] | None:
    """(words taken up, name, terms) of the command that takes up most words; of several the first in
    COMMANDS."""
    best = None
    texts, kinds = {n.text for n in items}, {n.category for n in items}
    for name, (parts, _, _) in COMMANDS.items():
        words, of_kinds = NEEDED[name]
        if any(texts.isdisjoint(w) for w in words) or any(kinds.isdisjoint(k) for k in of_kinds):
            continue
        first = parts[0]
        for at, item in enumerate(items):
            if not first.many and not (item.text in first.words if first.words else item.category in first.kinds):  # no first part is optional
                continue
            found = matched(parts, items, at)
            if found is None:
                continue
            end, terms = found
            units = sum(len(n.text.split()) for n in items[at:end])
            if best is None or units > best[0]:
                best = (units, name, terms)
            break
    return best


def command(items: list[Node]) -> tuple[str, str, int, list[tuple[str, int]], int] | None:
    """(name, expression, words taken up, (word, slot) pairs, code) of :func:`best_match`."""
    best = best_match(items)
    if best is None:
        return None
    units, name, terms = best
    parts, template, code = COMMANDS[name]
    relations = [(w, slot) for p in parts for slot in p.slots for n in terms.get(p.name, ()) for w in n.text.split()]
    return name, template.format(**{k: spoken(v) for k, v in terms.items()}), units, relations, code


def adjusted(pairs: list[tuple[str, str]], relations: list[tuple[str, int]], code: int) -> list[tuple[str, str | int]]:
    """(child, parent) with the command's code as the parent of the words that head it and have none."""
    children = {c for c, _ in pairs}
    heads = dict.fromkeys(w for w, slot in relations if slot in (SUBJECT, EXISTENCE, CONDITION) and w not in children)
    return [*pairs, *((h, code) for h in heads)]


def superimposed(before: list[Node], now: list[Node]) -> list[Node]:
    """The items of ``before`` with their noun phrases replaced by those of ``now``, in order: what
    "and $S$ a ring" says after "if $R$ is a field"."""
    now = now[1:] if now and now[0].text in ("and", "or") else now
    fresh = iter([n for n in now if n.category == "np"])
    return [next(fresh, n) if n.category == "np" else n for n in before]


def enumerated(text: str) -> list[str]:
    """The \\item parts of the enumerations of a text, without the marks; none without an enumeration."""
    out = []
    for body in re.findall(r"\\begin\{enumerate\}(.*?)(?:\\end\{enumerate\}|\Z)", text, re.S):
        out += [p.strip() for p in re.split(r"\\item\b(?:\[[^\]]*\])?", body)[1:] if p.strip()]
    return out


def long_form(node: Node) -> str:
    """A derivation as nested brackets: category[part, part]."""
    return f"{node.category}[{', '.join(map(long_form, node.children[0][1:]))}]" if node.children else f"{node.category}[{node.text}]"


# TeX commands that are read out, and what is said.
TEX_WORDS = {
    "oplus": "direct sum", "otimes": "tensor product", "times": "times", "cdot": "times", "cup": "union", "cap": "intersection", "subset": "subset of", "subseteq": "subset of",
    "in": "in", "le": "at most", "leq": "at most", "ge": "at least", "geq": "at least", "to": "to", "rightarrow": "to", "mapsto": "maps to", "sum": "sum", "prod": "product",
    "int": "integral", "infty": "infinity", "partial": "partial", "nabla": "gradient", "forall": "for all", "exists": "there exists", "cong": "isomorphic to", "simeq": "equivalent to", "neq": "not equal to",
}


def tex_words(tex: str) -> str:
    """A formula in words: fractions, roots, powers and the commands of TEX_WORDS; letters stay."""
    text = tex.strip().strip("$")
    for _ in range(20):
        changed = re.sub(r"\\frac\s*\{([^{}]*)\}\s*\{([^{}]*)\}", r" \1 over \2 ", text)
        changed = re.sub(r"\\sqrt\s*\{([^{}]*)\}", r" root of \1 ", changed)
        changed = re.sub(r"\\(?:math\w+|operatorname|text)\s*\{([^{}]*)\}", r" \1 ", changed)
        changed = re.sub(r"\^\s*(?:\{([^{}]*)\}|(\w))", lambda m: f" to the {m.group(1) or m.group(2)} ", changed)
        changed = re.sub(r"_\s*(?:\{([^{}]*)\}|(\w))", lambda m: f" sub {m.group(1) or m.group(2)} ", changed)
        if changed == text:
            break
        text = changed
    text = re.sub(r"\\([A-Za-z]+)", lambda m: f" {TEX_WORDS.get(m.group(1), m.group(1))} ", text)
    for sign, said in (("=", "equals"), ("<", "less than"), (">", "greater than"), ("+", "plus")):
        text = text.replace(sign, f" {said} ")
    return re.sub(r"\s+", " ", re.sub(r"[{}\\]", " ", text)).strip()


def all_sentences(text: str) -> list[str]:
    """The sentences of a text; items of enumerations are sentences too, after the others."""
    listed = [s for item in enumerated(text) for s in sentences(item)]
    return [*sentences(re.sub(r"\\begin\{enumerate\}.*?(?:\\end\{enumerate\}|\Z)", " ", text, flags=re.S)), *listed]


def command_names(texts: DataFrame, key: str) -> DataFrame:
    """``key, at, command`` of :func:`expressions`, without parsing and what only the others need."""
    kind = dict(texts.dtypes)[key]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            of, places, names = [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                for at, sentence in enumerate(all_sentences(text)):
                    if items := items_of(sentence):
                        best = best_match(items)
                        of.append(row)
                        places.append(at)
                        names.append(best and best[1])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, "int64")), pa.array(places, "int32"), pa.array(names, "string")], [key, "at", "command"])

    return texts.where("text is not null").select(key, "text").mapInArrow(run, f"`{key}` {kind}, at int, command string")


def expressions(texts: DataFrame, key: str, context: bool = True) -> DataFrame:
    """``key, at, command, expression, units, code, relations, context``: one row for each sentence of
    ``text``, items of enumerations being sentences too.

    ``relations``: (word, slot); words of hypotheses have the slot of conditions as well. ``context``:
    (child, parent) words, with the command's code in place of the parent of its heads. A sentence
    without a command has its items as they are. Null texts give no rows. Without ``context`` that
    column is empty, and only sentences are parsed that can turn out to be hypotheses.
    """
    kind = dict(texts.dtypes)[key]

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            out = []
            for k, text in zip(frame[key], frame["text"], strict=True):
                for at, sentence in enumerate(all_sentences(text)):
                    items = items_of(sentence)
                    if not items:
                        continue
                    name, said, units, relations, code = command(items) or (None, spoken(items), 0, [], DEFAULT)
                    # Only words of these two kinds make a hypothesis.
                    wanted = context or bool(relations) and ("if and only if" in sentence or any(n.category in ("hyp", "if") for n in items))
                    nodes = parsing.parse(sentence) if wanted else []
                    pairs = parsing.pairs_of(nodes)
                    if nodes and parsing.section(nodes[0], sentence).startswith("HYP"):
                        relations = [*relations, *((w, CONDITION) for w, _ in relations)]
                    whole = [] if not context else adjusted(pairs, relations, code) if name else pairs
                    out.append((k, at, name, said, units, code, [{"word": w, "slot": s} for w, s in dict.fromkeys(relations)], [{"child": c, "parent": str(p)} for c, p in whole]))
            yield pd.DataFrame(out, columns=[key, "at", "command", "expression", "units", "code", "relations", "context"])

    schema = f"`{key}` {kind}, at int, command string, expression string, units int, code int, relations array<struct<word:string,slot:int>>, context array<struct<child:string,parent:string>>"
    return texts.where("text is not null").select(key, "text").mapInPandas(run, schema)


def relation_bits(found: DataFrame, key: str, vocab: DataFrame) -> DataFrame:
    """``key, bits``: |V| · slot + word number of all relations of a statement, each once."""
    size = vocab.agg(F.count("*").alias("size"))
    each = found.select(key, F.explode("relations").alias("r")).select(key, "r.word", "r.slot")
    met = each.join(vocab.select("word", "word_idx"), "word").crossJoin(F.broadcast(size))  # one row
    return met.groupBy(key).agg(F.array_sort(F.collect_set(F.col("slot") * F.col("size") + F.col("word_idx"))).alias("bits"))


def merged_context(pairs: DataFrame, key: list[str]) -> DataFrame:
    """``key, child, parent`` of several context maps as one: of a child's parents the largest, so that
    a word (a positive number) goes before a relation's code."""
    return pairs.groupBy(*key, "child").agg(F.max("parent").alias("parent"))


def united(vectors: DataFrame, key: str) -> DataFrame:
    """``key, bits``: the union of the sparse vectors (``bits``) of each key, in order, without nulls.
    Bits are made distinct in each task before they are shuffled; keys without any have no row."""
    each = vectors.select(key, F.explode("bits").alias("bit")).where("bit is not null").distinct()
    return each.groupBy(key).agg(F.array_sort(F.collect_list("bit")).alias("bits"))

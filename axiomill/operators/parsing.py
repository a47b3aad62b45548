"""A small chart parser for statements: parts of speech, phrases, kinds of clauses, word relations.

Adjectives, nouns and formulas are first joined into noun phrases, so the chart sees about ten
items of a sentence and not forty. Its cells hold the best derivation of each category; a derivation
weighs the product of its rules' weights. Everything is a function of one string and runs in Arrow
batches; results are flat rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame

from axiomill.operators.extraction import sentences

# Words of closed classes and frequent words of statements.
LEXICON = {
    **dict.fromkeys("a an the some every each any all no this that these those its their".split(), "det"),
    **dict.fromkeys("of over in on with for to from by under at into between of as up along through".split(), "pre"),
    **dict.fromkeys("is are be was were becomes stays remains".split(), "be"),
    **dict.fromkeys("let fix consider suppose assume denote given keep take".split(), "hyp"),
    **dict.fromkeys("if when whenever where unless since because".split(), "if"),
    **dict.fromkeys("then".split(), "then"),
    **dict.fromkeys("and or but".split(), "conj"),
    **dict.fromkeys("we one it there such which who whose here throughout".split(), "pro"),
    **dict.fromkeys("has have contains contain admits admit satisfies satisfy bounds bound gives give carries carry extends extend sends send fixes fix meets meet reduces reduce "
                    "converges converge decomposes decompose coincides coincide fails fail acts act holds hold exists exist obtains obtain vanishes vanish denotes refers stands call recovers".split(), "verb"),
    **dict.fromkeys("quotient element component gradient exponent complement coefficient argument segment moment integral interval ideal radical".split(), "ent"),
    **dict.fromkeys("not also again only always freely uniquely surely almost otherwise".split(), "adverb"),
}
# Endings of adjectives and adverbs.
ADJECTIVE = re.compile(r"(?:al|ic|ous|able|ible|ive|ary|ular|ent|ian|ine|ate|ar|less|ful|ed)$")
# Likelihood of a part of speech after another, for words that may be several; '^' and '$'
# stand for the ends of a sentence.
AFTER = {
    ("ent", "verb"): 0.8, ("ent", "pre"): 0.85, ("symb", "verb"): 0.8, ("symb", "pre"): 0.6, ("pre", "adj"): 0.6, ("pre", "ent"): 0.65,
    ("verb", "ent"): 0.75, ("verb", "adj"): 0.75, ("be", "ent"): 0.6, ("be", "adj"): 0.75, ("adj", "ent"): 0.9, ("adj", "pre"): 0.7, ("adj", "adj"): 0.45,
    ("adj", "if"): 0.7, ("adj", "hyp"): 0.7, ("adverb", "adj"): 0.9, ("det", "ent"): 0.9,
}
AT_ENDS, OTHERWISE = 0.7, 0.2
# Fixed values: (left, right) -> (whole, head: 0 left or 1 right, relation of the other to the head, weight).
RULES = {
    ("np", "pp"): ("np", 0, "qualifier", 1.0),
    ("pre", "np"): ("pp", 1, "preposition", 1.0),
    ("be", "np"): ("vp", 0, "object", 1.0),
    ("be", "adj"): ("vp", 0, "object", 1.0),
    ("be", "pp"): ("vp", 0, "object", 0.9),
    ("verb", "np"): ("vp", 0, "object", 1.0),
    ("verb", "pp"): ("vp", 0, "object", 0.9),
    ("vp", "pp"): ("vp", 0, "qualifier", 0.8),
    ("vp", "np"): ("vp", 0, "object", 0.5),
    ("vp", "adverb"): ("vp", 0, "adverb", 0.9),
    ("adverb", "vp"): ("vp", 1, "adverb", 0.9),
    ("verb", "adverb"): ("verb", 0, "adverb", 0.9),
    ("adverb", "adj"): ("adj", 1, "adverb", 0.9),
    ("np", "vp"): ("s", 1, "subject", 1.0),
    ("np", "verb"): ("s", 1, "subject", 0.9),
    ("hyp", "s"): ("hypo", 1, "hypothesis", 1.0),
    ("hyp", "np"): ("hypo", 1, "hypothesis", 0.9),
    ("if", "s"): ("hypo", 1, "condition", 1.0),
    ("hypo", "s"): ("s", 1, "condition", 0.9),
    ("s", "hypo"): ("s", 0, "condition", 0.9),
    ("then", "s"): ("s", 1, "then", 1.0),
    ("conj", "np"): ("cnp", 1, "conjunct", 1.0),
    ("np", "cnp"): ("np", 0, "conjunct", 0.9),
    ("conj", "s"): ("cs", 1, "conjunct", 1.0),
    ("s", "cs"): ("s", 0, "conjunct", 1.0),
    ("conj", "vp"): ("cvp", 1, "conjunct", 1.0),
    ("vp", "cvp"): ("vp", 0, "conjunct", 0.9),
}
MOST_ITEMS = 50
#: left -> right -> rule.
BY_LEFT: dict[str, dict[str, tuple]] = {left: {b: rule for (a, b), rule in RULES.items() if a == left} for left, _ in RULES}


@dataclass(frozen=True)
class Node:
    category: str
    head: str
    weight: float
    text: str
    pairs: tuple = ()
    children: tuple = ()


_PHRASES: dict[int, frozenset[str]] = {}


def _phrases(lexicon: dict[str, str]) -> frozenset[str]:
    """The entries of several words; found once for each lexicon."""
    if id(lexicon) not in _PHRASES:
        _PHRASES.clear()
        _PHRASES[id(lexicon)] = frozenset(w for w in lexicon if " " in w)
    return _PHRASES[id(lexicon)]


def tokens(sentence: str) -> list[str]:
    return re.findall(r"\$[^$]*\$|[^\s,;()]+", sentence)


def candidates(word: str, lexicon: dict[str, str] = LEXICON) -> list[str]:
    if word.startswith("$") or re.fullmatch(r"[a-z]", word) and word != "a":
        return ["ent"]
    if word in lexicon or " " in word:
        return [lexicon[word]]
    if word.endswith("ly"):
        return ["adverb"]
    if ADJECTIVE.search(word):
        return ["adj", "ent"]
    return ["ent", "verb"] if word.endswith("s") and not word.endswith(("us", "is", "ss")) else ["ent"]


@lru_cache(1 << 16)
def usual(word: str) -> list[str]:
    """The candidates by the fixed words."""
    return candidates(word)


def likely(a: str, b: str) -> float:
    return AT_ENDS if a == "^" or b == "$" else AFTER.get((a, b), OTHERWISE)


def with_phrases(words: list[str], phrases: frozenset[str]) -> list[str]:
    """Words, with runs that are a phrase of the lexicon as one; the longest first."""
    longest = max((p.count(" ") + 1 for p in phrases), default=1)
    out, i = [], 0
    while i < len(words):
        n = next((n for n in range(min(longest, len(words) - i), 1, -1) if " ".join(words[i : i + n]) in phrases), 1)
        out.append(" ".join(words[i : i + n]))
        i += n
    return out


def lexicon_of(*tables: DataFrame) -> dict[str, str]:
    """The fixed words with those of ``word, pos`` tables (a lexicon, fixed phrases), later ones first.
    It goes to every task, as a lexicon is some thousands of words."""
    return LEXICON | {r["word"].lower(): r["pos"] for t in tables for r in t.select("word", "pos").where("word is not null and pos is not null").collect()}


def tagged(sentence: str, lexicon: dict[str, str] = LEXICON) -> list[tuple[str, str]]:
    """(word, part of speech): for words that may be several, the one likeliest between its neighbours."""
    words = tokens(sentence)
    if len(lexicon) > len(LEXICON):
        words = with_phrases(words, _phrases(lexicon))
    of = usual if lexicon is LEXICON else lambda w: candidates(w, lexicon)
    out: list[tuple[str, str]] = []
    for i, word in enumerate(words):
        options = of(word)
        if len(options) > 1:
            before = out[-1][1] if out else "^"
            following = of(words[i + 1])[0] if i + 1 < len(words) else "$"
            options = sorted(options, key=lambda p: -likely(before, p) * likely(p, following))
        out.append((word, options[0]))
    return out


def items(words: list[tuple[str, str]]) -> list[Node]:
    """Noun phrases (determiner, adjectives, nouns) and single words. Each adjective belongs to the noun."""
    out, i = [], 0
    while i < len(words):
        j = i
        while j < len(words) and words[j][1] == "det":
            j += 1
        adjectives = []
        while j < len(words) and words[j][1] == "adj":
            adjectives.append(words[j][0])
            j += 1
        nouns = []
        while j < len(words) and words[j][1] == "ent":
            nouns.append(words[j][0])
            j += 1
        if nouns:
            head = nouns[-1]
            pairs = tuple((x, head) for x in (*adjectives, *nouns[:-1]))
            out.append(Node("np", head, 1.0, " ".join((*adjectives, *nouns)), pairs))
        elif adjectives:
            out.append(Node("adj", adjectives[-1], 1.0, " ".join(adjectives)))
        elif j > i:
            pass
        else:
            out.append(Node(words[i][1], words[i][0], 1.0, words[i][0]))
            j = i + 1
        i = j
    return out


def joined(left: Node, right: Node) -> Node | None:
    rule = RULES.get((left.category, right.category))
    if rule is None:
        return None
    whole, side, relation, weight = rule
    head, other = (right, left) if side else (left, right)
    child = (other.head, head.head)
    if relation == "preposition":
        child = None
    if relation == "subject":
        child = (head.head, other.head)  # the verb belongs to its subject
    pairs = left.pairs + right.pairs + ((child,) if child else ())
    return Node(whole, head.head, left.weight * right.weight * weight, f"{left.text} {right.text}", pairs, ((relation, left, right),))


def chart(nodes: list[Node]) -> dict[tuple[int, int], dict[str, tuple]]:
    """(begin, end) -> category -> (weight, seam, left category, right category) of the best derivation;
    spans without any are left out. :func:`node_at` makes the node of one."""
    cells: dict[tuple[int, int], dict[str, tuple]] = {}
    ends: list[list[int]] = [[] for _ in nodes]  # where the derivations that begin at a place end
    for end in range(1, len(nodes) + 1):
        for begin in range(end - 1, -1, -1):
            cell: dict[str, tuple] = {}
            if begin == end - 1:
                cell[nodes[begin].category] = (nodes[begin].weight, 0, None, None)
            for k in ends[begin]:
                right_cell = cells.get((k, end))
                if right_cell is None:
                    continue
                for left, (left_weight, *_) in cells[begin, k].items():
                    rules = BY_LEFT.get(left)
                    if rules is None:
                        continue
                    for right, (right_weight, *_) in right_cell.items():
                        rule = rules.get(right)
                        if rule is None:
                            continue
                        weight, before = left_weight * right_weight * rule[3], cell.get(rule[0])
                        if before is None or weight > before[0]:
                            cell[rule[0]] = (weight, k, left, right)
            if cell:
                cells[begin, end] = cell
                ends[begin].append(end)
    return cells


def node_at(nodes: list[Node], cells: dict, begin: int, end: int, category: str) -> Node:
    _, k, left, right = cells[begin, end][category]
    return joined(node_at(nodes, cells, begin, k, left), node_at(nodes, cells, k, end, right)) if k else nodes[begin]


#: Which category stands for a sentence, the better first.
WHOLE = ("s", "hypo", "vp", "np", "pp", "adj")


#: Words that a sentence can be parsed again without.
FLUFF = frozenset("then there also again moreover furthermore hence thus therefore so now clearly obviously indeed just only even".split())


def parse(sentence: str, lexicon: dict[str, str] = LEXICON) -> list[Node]:
    """The best derivation of the sentence, or of the fewest pieces that cover it.

    If it takes several pieces, the sentence is parsed again without fluff and adverbs, and that stands
    if it takes fewer (without fluff, there may be nothing left to parse). More than MOST_ITEMS are parsed in consecutive parts, so that no derivation spans
    such a sentence.
    """
    words = tagged(sentence, lexicon)
    first = pieces(items(words))
    bare = [(w, tag) for w, tag in words if tag != "adverb" and w not in FLUFF]
    if len(first) < 2 or len(bare) == len(words) or not bare:
        return first
    again = pieces(items(bare))
    return again if 0 < len(again) < len(first) else first


def pieces(nodes: list[Node]) -> list[Node]:
    return [piece for i in range(0, len(nodes), MOST_ITEMS) for piece in derived(nodes[i : i + MOST_ITEMS])]


def derived(nodes: list[Node]) -> list[Node]:
    """The fewest pieces that cover the items, of the greatest weight."""
    cells, n = chart(nodes), len(nodes)
    best: list[tuple[int, float, int, str]] = [(0, 0.0, 0, "")]  # pieces, weight, begin and category of the last
    for j in range(1, n + 1):
        options = []
        for i in range(j):
            if cell := cells.get((i, j)):
                category = next((c for c in WHOLE if c in cell), None) or next(iter(cell))
                options.append((best[i][0] + 1, best[i][1] - cell[category][0], i, category))
        best.append(min(options, key=lambda o: o[:2]))
    out: list[Node] = []
    while n:
        _, _, i, category = best[n]
        out.append(node_at(nodes, cells, i, n, category))
        n = i
    return out[::-1]


def section(node: Node, sentence: str) -> str:
    """STM, HYP, HYP_iff, OBJ or NONE."""
    if "if and only if" in sentence:
        return "HYP_iff"
    if node.category == "hypo":
        return "HYP"
    return {"s": "STM", "vp": "STM", "np": "OBJ"}.get(node.category, "NONE")


def thing(node: Node) -> str:
    """A noun phrase as an expression: Math[name], with what follows it as qualifiers."""
    if node.children and node.children[0][0] == "qualifier":
        _, left, right = node.children[0]
        preposition, inner = right.children[0][1], right.children[0][2]
        return f'Math["Name"->"{left.text}", "Qualifiers" -> {{"{preposition.text}", {thing(inner)}}}]'
    return f"Math[{node.text}]" if is_symbol(node) else f'Math["Name"->"{node.text}"]'


def is_symbol(node: Node) -> bool:
    return len(node.text) == 1 or node.text.startswith("$") and node.text.count("$") == 2 and node.text.endswith("$")


def expression(node: Node) -> str:
    """`x \\[Element] y` for is and be, `x verb y` for other verbs; the words themselves otherwise."""
    if node.category == "hypo" and node.children:
        return expression(node.children[0][2])
    if node.category == "s" and node.children and node.children[0][0] == "subject":
        _, subject, verb = node.children[0]
        name = subject.text if is_symbol(subject) else thing(subject)
        if verb.children and verb.children[0][0] == "object" and verb.children[0][2].category == "np":
            link = "\\[Element]" if verb.children[0][1].category == "be" else verb.head
            return f"{name} {link} {thing(verb.children[0][2])}"
        return f"{name} {verb.text}"
    return thing(node) if node.category == "np" else node.text


def pairs_of(nodes: list[Node]) -> list[tuple[str, str]]:
    """(child, parent) pairs of words, each once."""
    return list(dict.fromkeys(p for node in nodes for p in node.pairs))


def context(sentence: str) -> list[tuple[str, str]]:
    """(child, parent) pairs of words."""
    return pairs_of(parse(sentence))


def parsed(texts: DataFrame, key: str, lexicon: dict[str, str] = LEXICON) -> DataFrame:
    """``key, at, section, expression, weight, spans, pairs``: one row for each sentence of ``text``.

    ``spans``: one derivation covers the sentence. Null texts give no rows.
    """
    kind = dict(texts.dtypes)[key]

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            out = []
            for k, text in zip(frame[key], frame["text"], strict=True):
                for at, sentence in enumerate(sentences(text)):
                    nodes = parse(sentence, lexicon)
                    if nodes:
                        pairs = [{"child": c, "parent": p} for node in nodes for c, p in dict.fromkeys(node.pairs)]
                        out.append((k, at, section(nodes[0], sentence), " ; ".join(map(expression, nodes)), round(min(n.weight for n in nodes), 6), len(nodes) == 1, pairs))
            yield pd.DataFrame(out, columns=[key, "at", "section", "expression", "weight", "spans", "pairs"])

    schema = f"`{key}` {kind}, at int, section string, expression string, weight double, spans boolean, pairs array<struct<child:string,parent:string>>"
    return texts.where("text is not null").select(key, "text").mapInPandas(run, schema)


def parse_share(rows: DataFrame) -> DataFrame:
    """``n_sentences, share``: how many sentences one derivation covers."""
    from pyspark.sql import functions as F

    return rows.agg(F.count("*").alias("n_sentences"), F.avg(F.col("spans").cast("int")).alias("share"))

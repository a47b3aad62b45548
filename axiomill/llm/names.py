"""Variant spellings of names typed by people.

1. Each distinct spelling is read once: accents (typed or in TeX), case, hyphens, order and titles
   fall away, and every token becomes a full word, an initial or an abbreviation.
2. Tokens are compared through a symmetric-delete index: two tokens within one edit share a form
   with one character deleted. A token is taken for a slip of its most frequent neighbour.
3. Spellings that read the same are one *form*. Forms that share a full token, and another one that
   is the same or the beginning of the other's, are aligned: an optimal assignment of tokens in which
   an initial, an abbreviation or a short name may stand for a full one.
4. A less specific form (E. Weber) is linked to more specific ones (Emil Weber) only if those name
   one person: if Emil and Erika Weber both occur, it is left alone.

Rows are reduced to distinct spellings before anything else, so an author with a third of all rows
is one row from the first shuffle on.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axiomill.llm.components import components
from axiomill.llm.pairs import met as joined
from axiomill.llm.pairs import within
from axiomill.session import checkpointed

#: Tokens that name nobody.
TITLES = frozenset("dr prof professor mr mrs ms miss sir dame phd md jr sr ii iii iv".split())
LINKING = frozenset("the for of and in at on to a an de la le du des der die das und et y fur".split())
#: Letters that Unicode doesn't decompose.
LETTERS = str.maketrans({"ł": "l", "Ł": "L", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "þ": "th"})
#: Tokens of one letter are never slips; in those shorter than LEAST an edit leaves little to go by.
LEAST = 4
#: A token is a slip of a neighbour if at most RARE spellings have it and the neighbour has as many,
#: or if the neighbour has TIMES as many; a token shorter than LEAST if at most RARE spellings have it,
#: the neighbour has SHORT_TIMES as many and begins alike.
RARE, TIMES, SHORT_TIMES = 3, 4, 16

_TEX = re.compile(r"""\\["'`^~=.]\s*(?:\{\s*\\?([A-Za-z])\s*\}|\\?([A-Za-z]))|\\[vcuHkrdbt]\s*\{\s*\\?([A-Za-z])\s*\}""")
_SPLIT = re.compile(r"[\s,;/&()]+")


def folded(text: str) -> str:
    """Without accents, TeX accents and hyphens; the case is kept."""
    text = _TEX.sub(lambda m: m.group(1) or m.group(2) or m.group(3), text).translate(LETTERS)
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return re.sub(r"[-‐‑–'’\"`{}\\]", "", text)


def read(name: str) -> list[tuple[str, str]]:
    """(token, kind) in order; kind is 'full', 'short' (an abbreviation) or 'initial'.

    Two to four capitals are initials in a row unless the whole name is in capitals.
    """
    parts = [p for p in _SPLIT.split(folded(name)) if p.strip(".")]
    capitals = sum(p.isupper() and len(p) > 4 for p in parts) > 0
    out: list[tuple[str, str]] = []
    for part in parts:
        pieces = [x for x in part.split(".") if x]
        dotted = part.endswith(".")
        if part.strip(".").lower() in TITLES and len(parts) > 1:
            continue
        for i, piece in enumerate(pieces):
            low = piece.lower()
            if len(piece) == 1:
                out.append((low, "initial"))
            elif low in LINKING:
                continue
            elif piece.isupper() and 2 <= len(piece) <= 4 and not capitals and len(parts) > 1 and not dotted:
                out += [(c, "initial") for c in low]
            elif i < len(pieces) - 1 or dotted:
                out.append((low, "short"))
            else:
                out.append((low, "full"))
    return out


def one_edit(a: str, b: str) -> bool:
    """Whether a != b differ by one insertion, deletion, substitution or swap of neighbours."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    if len(x) == len(y):
        return x[1:] == y[1:] or (len(x) > 1 and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:])
    return x[1:] == y if len(x) > len(y) else x == y[1:]


def deletions(token: str) -> set[str]:
    return {token, *(token[:i] + token[i + 1 :] for i in range(len(token)))}


def spellings(rows: DataFrame, author: str) -> DataFrame:
    """``name, tokens, kinds`` of each distinct non-null spelling, stored."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for frame in batches:
            found = [read(n) for n in frame["name"]]
            yield pd.DataFrame({"name": frame["name"], "tokens": [[t for t, _ in f] for f in found], "kinds": [[k for _, k in f] for f in found]})

    names = rows.select(F.col(author).alias("name")).where("name is not null").distinct()
    return checkpointed(names.mapInPandas(run, "name string, tokens array<string>, kinds array<string>"))


def corrections(names: DataFrame, given: DataFrame) -> DataFrame:
    """``token, right``: tokens taken for slips of another, by the symmetric-delete index.

    ``given`` (``given_name, short_name``) holds known names, which are never slips.
    """
    full = names.select(F.explode(F.arrays_zip("tokens", "kinds")).alias("t")).where("t.kinds = 'full'")
    counts = full.groupBy(F.col("t.tokens").alias("token")).count().where("length(token) >= 2")
    known = given.select(F.explode(F.array(F.lower("given_name"), F.lower("short_name"))).alias("token")).distinct()
    counts = checkpointed(counts.join(known.withColumn("known", F.lit(True)), "token", "left").select("token", "count", F.coalesce("known", F.lit(False)).alias("known")))

    def delete(batches: Iterator) -> Iterator:
        import pandas as pd

        for frame in batches:
            out = [(d, t, n, k) for t, n, k in zip(frame["token"], frame["count"], frame["known"], strict=True) for d in deletions(t)]
            yield pd.DataFrame(out, columns=["key", "token", "n", "known"])

    index = counts.mapInPandas(delete, "key string, token string, n bigint, known boolean")
    # A deleted form of a slip is looked up among all tokens' forms; frequent tokens aren't slips, so
    # only the rare side is on the left.
    slips = index.where(~F.col("known")).select("key", "token", "n")
    right = index.select("key", F.col("token").alias("right"), F.col("n").alias("m"), F.col("known").alias("right_known"))
    met = slips.join(right, "key").where("token <> right and (m > n or (m = n and right < token))")
    short = F.least(F.length("token"), F.length("right")) < LEAST
    clear = (F.col("n") <= RARE) & (F.col("m") >= F.col("n") * SHORT_TIMES) & (F.substring("token", 1, 1) == F.substring("right", 1, 1))
    rare = F.when(short, clear).otherwise((F.col("n") <= RARE) | (F.col("m") >= F.col("n") * TIMES))
    pairs = met.where(rare).select("token", "right", "n", "m", "right_known").distinct()

    @F.pandas_udf("boolean")
    def near(a, b):  # noqa: ANN001
        return a.combine(b, one_edit)

    best = pairs.where(near("token", "right")).groupBy("token").agg(F.max_by("right", F.struct("right_known", "m", "right")).alias("right"))
    # A slip of a slip leads on to the right form.
    for _ in range(2):
        step = best.select(F.col("token").alias("right"), F.col("right").alias("further"))
        best = best.join(step, "right", "left").select("token", F.coalesce("further", "right").alias("right"))
    return checkpointed(best)


def forms(names: DataFrame, right: DataFrame, given: DataFrame) -> DataFrame:
    """``name, form``: the canonical reading of each spelling, as ``token/kind`` in a fixed order.

    Slips are corrected and short names replaced by the given names they stand for.
    """
    tokens = names.select("name", F.posexplode(F.arrays_zip("tokens", "kinds")).alias("at", "t")).select("name", "at", F.col("t.tokens").alias("token"), F.col("t.kinds").alias("kind"))
    long = given.select(F.lower("short_name").alias("right"), F.lower("given_name").alias("long")).groupBy("right").agg(F.min("long").alias("long"))
    full = tokens.where("kind = 'full'").join(right, "token", "left").withColumn("right", F.coalesce("right", "token")).join(long, "right", "left")
    # A short name may be typed with a dot, as an abbreviation is.
    dotted = tokens.where("kind <> 'full'").withColumn("right", F.col("token")).join(long, "right", "left").withColumn("long", F.when(F.col("kind") == "short", F.col("long")))
    dotted = dotted.withColumn("kind", F.when(F.col("long").isNotNull(), "full").otherwise(F.col("kind")))
    each = full.select("name", "at", "kind", F.coalesce("long", "right").alias("token")).unionByName(dotted.select("name", "at", "kind", F.coalesce("long", "token").alias("token")))
    # Full tokens in alphabetical order, then the others in the order typed: A B. C and C, A B. agree.
    order = F.when(F.col("kind") == "full", F.struct(F.lit(0).alias("a"), F.col("token").alias("b"), F.lit(0).alias("c"))).otherwise(F.struct(F.lit(1).alias("a"), F.lit("").alias("b"), F.col("at").alias("c")))
    text = F.concat_ws("/", "token", "kind")
    return each.groupBy("name").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))).alias("all")).select("name", F.concat_ws(" ", F.transform("all", lambda x: x["t"])).alias("form"))


def parsed(form: str) -> list[tuple[str, str]]:
    return [tuple(t.rsplit("/", 1)) for t in form.split(" ")] if form else []


def stands_for(a: tuple[str, str], b: tuple[str, str]) -> int | None:
    """The cost of taking two tokens for one: 0 alike, 1 an abbreviation, 2 an initial; None if they differ."""
    if a[0] == b[0]:
        return 0
    less, more = (a, b) if len(a[0]) < len(b[0]) else (b, a)
    if less[1] == "initial":
        return 2 if more[0].startswith(less[0]) else None
    stem = less[0][:-1] if less[0].endswith("s") and len(less[0]) > 4 else less[0]
    if less[1] == "short" or (more[1] == "full" and len(stem) >= 4 and 2 * len(stem) < len(more[0])):
        return 1 if more[0].startswith(stem) else None
    return None


def assignment(costs: list[list[float]]) -> list[int]:
    """The column of each row in an assignment of least cost (shortest augmenting paths, O(n³)); no more
    rows than columns."""
    n, m = len(costs), len(costs[0])
    u, v, row_of, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        row_of[0], j = i, 0
        least, seen = [float("inf")] * (m + 1), [False] * (m + 1)
        while row_of[j]:
            seen[j] = True
            here, step, following = row_of[j], float("inf"), 0
            for k in range(1, m + 1):
                if not seen[k]:
                    now = costs[here - 1][k - 1] - u[here] - v[k]
                    if now < least[k]:
                        least[k], way[k] = now, j
                    if least[k] < step:
                        step, following = least[k], k
            for k in range(m + 1):
                if seen[k]:
                    u[row_of[k]] += step
                    v[k] -= step
                else:
                    least[k] -= step
            j = following
        while j:
            row_of[j] = row_of[way[j]]
            j = way[j]
    out = [0] * n
    for k in range(1, m + 1):
        if row_of[k]:
            out[row_of[k] - 1] = k - 1
    return out


def rest(tokens: list[tuple[str, str]], alike: Counter) -> list[tuple[str, str]]:
    """``tokens`` without those of ``alike``, as often as it has them."""
    left, out = Counter(alike), []
    for t in tokens:
        if left[t]:
            left[t] -= 1
        else:
            out.append(t)
    return out


#: The cost of tokens that can't stand for each other, and of a unit against the order of tokens.
NEVER, UNIT = 1e12, 1e4


def aligned(one: str, two: str) -> tuple[int, int] | None:
    """(what ``one`` lacks, what ``two`` lacks) in the best assignment of tokens, or None.

    All tokens of the form with fewer must be assigned and one of them alike in full; only initials
    may be left over in the other. What a form lacks counts its initials and abbreviations that
    stand for full words, and the initials it doesn't have. Of equally good assignments the one that
    keeps the order counts: D. S. isn't S. D. Forms may have any number of tokens.
    """
    a, b = parsed(one), parsed(two)
    swapped = len(a) > len(b)
    if swapped:
        a, b = b, a
    # Full tokens that are alike are assigned to each other; the rest are assigned at the least cost.
    alike = Counter(t for t in a if t[1] == "full") & Counter(t for t in b if t[1] == "full")
    if not alike:
        return None
    rest_a, rest_b = rest(a, alike), rest(b, alike)
    if len(rest_a) > len(rest_b) or Counter(t[0] for t, _ in rest_a) - Counter(t[0] for t, _ in rest_b):
        return None
    if sum(kind != "initial" for _, kind in rest_b) > len(rest_a):
        return None
    lack_a = lack_b = 0
    if rest_b:
        costs = [[NEVER if (c := stands_for(x, y)) is None else c * UNIT + abs(i - j) for j, y in enumerate(rest_b)] for i, x in enumerate(rest_a)]
        spare = [UNIT if kind == "initial" else NEVER for _, kind in rest_b]
        costs += [spare] * (len(rest_b) - len(rest_a))
        chosen = assignment(costs)
        if any(costs[i][j] >= NEVER for i, j in enumerate(chosen)):
            return None
        lack_a = len(rest_b) - len(rest_a)
        for x, j in zip(rest_a, chosen):
            if stands_for(x, rest_b[j]):
                if len(x[0]) < len(rest_b[j][0]):
                    lack_a += 1
                else:
                    lack_b += 1
    return (lack_b, lack_a) if swapped else (lack_a, lack_b)


def stem_of(token: str) -> str:
    return token[:-1] if token.endswith("s") and len(token) > 4 else token


def keys(found: list[tuple[str, str, bool]]) -> set[tuple[str, str]]:
    """(side, key) of a form's tokens (token, kind, known given name).

    Each full token that isn't a known given name is an anchor (if there is none, the given names
    are), and each other token of the form makes keys with it: '=' the token itself; 's' what it may
    stand for, if it is an initial, an abbreviation or long enough for one; 'p' its beginnings. Forms
    that align share an anchor and '=' with '=' or 's' with 'p'.
    """
    full = [(t, known) for t, kind, known in found if kind == "full"]
    anchors = {t for t, known in full if not known} or {t for t, _ in full}
    out = set()
    for anchor in anchors:
        for token, kind, _ in found:
            if token == anchor:
                continue
            out.add(("=", f"{anchor} {token}"))
            if kind != "full" or len(stem_of(token)) >= 4:
                out.add(("s", f"{anchor} {stem_of(token) if kind != 'initial' else token}"))
            out |= {("p", f"{anchor} {token[:n]}") for n in range(1, len(token))}
    return out


def links(known_forms: DataFrame, given: DataFrame) -> DataFrame:
    """``a, b``: forms (a <> b) that name the same person or organisation."""
    known = given.select(F.explode(F.array(F.lower("given_name"), F.lower("short_name"))).alias("token")).where("token is not null").distinct().withColumn("known", F.lit(True))
    each = known_forms.select("form", F.posexplode(F.split("form", " ")).alias("at", "t")).select("form", "at", F.regexp_extract("t", "^(.*)/", 1).alias("token"), F.regexp_extract("t", "/([a-z]+)$", 1).alias("kind"))
    tokens = each.join(known, "token", "left").groupBy("form").agg(F.array_sort(F.collect_list(F.struct("at", "token", "kind", F.coalesce("known", F.lit(False)).alias("known")))).alias("found"))

    def block(batches: Iterator) -> Iterator:
        import pandas as pd

        for frame in batches:
            out = [(side, k, f) for f, found in zip(frame["form"], frame["found"], strict=True) for side, k in keys([(t["token"], t["kind"], t["known"]) for t in found])]
            yield pd.DataFrame(out, columns=["side", "key", "form"])

    blocks = checkpointed(tokens.mapInPandas(block, "side string, key string, form string"))

    def side(of: str, name: str) -> DataFrame:
        return blocks.where(F.col("side") == of).select("key", F.col("form").alias(name))

    # Forms with a token alike, and forms of which one stands for the other's: a name's initial meets
    # its full names, but full names don't meet each other.
    pairs = within(blocks.where("side = '='").select("key", "form"), "key", "form").unionAll(joined(side("s", "a"), side("p", "b"), "key"))
    pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def align(batches: Iterator) -> Iterator:
        import pandas as pd

        for frame in batches:
            out = []
            for a, b in zip(frame["a"], frame["b"], strict=True):
                lacks = aligned(a, b)
                if lacks is not None:
                    out.append((a, b, *lacks))
            yield pd.DataFrame(out, columns=["a", "b", "lack_a", "lack_b"])

    met = checkpointed(pairs.mapInPandas(align, "a string, b string, lack_a int, lack_b int"))
    # Each link from the less specific form to the more specific one; alike forms both ways.
    both = met.unionByName(met.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("lack_b").alias("lack_a"), F.col("lack_a").alias("lack_b")))
    above = checkpointed(both.where("lack_a >= lack_b and not (lack_a = lack_b and lack_a > 0)").select("a", "b"))
    # A form is tied to those above it if they are tied to one another: as many pairs of them are
    # aligned as there are. Counted from the aligned pairs down to what stands below both, so that an
    # initial with very many full names above it doesn't pair them.
    below = met.select(F.col("a").alias("b"), F.col("b").alias("c")).join(above, "b").join(above.select("a", F.col("b").alias("c")), ["a", "c"])
    mutual = below.groupBy("a").agg(F.count("*").alias("n_mutual"))
    n_above = above.groupBy("a").agg(F.count("*").alias("n"))
    clear = n_above.join(mutual, "a", "left").where(F.coalesce("n_mutual", F.lit(0)) * 2 == F.col("n") * (F.col("n") - 1)).select("a")
    return above.join(clear, "a").select("a", "b")


def entities(rows: DataFrame, author: str, given: DataFrame) -> DataFrame:
    """``name, entity``: each distinct non-null spelling and the form its entity goes by.

    Names without any readable token (blanks, dots) are entities of their own. Spellings are
    compared as stored: blanks, case and accents make two of them, never two entities.
    """
    names = spellings(rows, author)
    read_forms = forms(names, corrections(names, given), given)
    named = checkpointed(names.select("name").join(read_forms, "name", "left").withColumn("form", F.coalesce("form", F.concat(F.lit("?"), "name"))))
    known_forms = named.where(~F.col("form").startswith("?")).select("form").distinct()
    group = components(links(known_forms, given)).select(F.col("node").alias("form"), "component")
    return named.join(group, "form", "left").select("name", F.coalesce("component", "form").alias("entity"))


def variants(rows: DataFrame, author: str, given: DataFrame) -> DataFrame:
    """``a, b`` (a < b, binary order): all pairs of different spellings of one entity.

    Null authors are left out, repeated rows count once, ``given`` may be empty. An empty table
    gives no rows; extra columns are ignored.
    """
    return within(checkpointed(entities(rows, author, given)), "entity", "name")

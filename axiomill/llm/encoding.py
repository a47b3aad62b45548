"""Garbled text from wrong character encodings: which records have it, and what they said.

An unknown swap of code pages is treated as a substitution cipher. Nothing says which source used
which pages, how often, or in which language. It is solved in two steps, both by
expectation-maximization against the language's own letter bigrams:

* *Known pages.* The key is a pair (page the text was shown in, page it was written in). Text written
  in a single-byte page turns each letter into another; UTF-8 shown in such a page turns each letter
  into a fixed sequence. The rate of every swap in every source, and the letter bigrams of each
  language as they are without the garbled text, are learned at once.
* *Any other page* (:func:`ciphers`). What no known pair explains is looked at by language and source:
  characters that a source has far more often than the language's other sources are taken for
  ciphers. Their mapping to letters is learned from their bigrams, which are all that a substitution
  cipher shows of itself against a bigram model. It stands only if the deciphered text looks like the
  language: in its bigrams, in the frequencies of its letters, and one letter to one character.

Restoring is then a table lookup per place (a translation). The unit is a *place*: a run of non-ASCII
characters with the ASCII character before and after it. Places are counted once for each language and
source, so the iterations run on that small table.

Bigrams are counted in a table of fixed size (a count-min sketch), so what is broadcast doesn't grow
with the data and no count is left out; the rates of swaps stay a table and are joined.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axiomill.llm.pairs import looked_up
from axiomill.session import checkpointed

#: Code pages that texts are shown in, and written in.
SHOWN = ("latin-1", "cp1252", "cp1250", "cp1251", "iso8859-2", "mac-roman", "cp437", "cp850", "cp866", "koi8-r")
WRITTEN = ("cp1252", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "mac-roman", "cp850")
#: Further single-byte pages that ciphers are tried with first.
FURTHER = (
    "cp1253", "cp1254", "cp1255", "cp1256", "cp1257", "cp1258", "cp437", "cp737", "cp775", "cp852", "cp855", "cp857", "cp862", "cp864", "cp869",
    "iso8859-3", "iso8859-4", "iso8859-5", "iso8859-6", "iso8859-7", "iso8859-8", "iso8859-9", "iso8859-10", "iso8859-13", "iso8859-14", "iso8859-15", "iso8859-16",
    "koi8-u", "mac-cyrillic", "mac-greek", "mac-latin2", "mac-turkish",
)
#: Counters of each of the two rows of the bigram table, and places that a task goes through.
WIDTH, PLACES = 1 << 20, 8192
#: Rates of up to this many sources are sent to every task (a few thousand bytes each).
SOURCES = 4000
ROUNDS = 6
#: Ciphers: how much more often than elsewhere a source has a character, how many of them and of their
#: bigrams are enough to learn from, letters of an alphabet, steps of a solution, and how far the
#: deciphered text may be from the language (nats of a bigram, divergence of the letters, share of
#: bigrams whose letter has one character).
LIFT, SYMBOLS, EVIDENT, ALPHABET, STEPS = 4.0, 4, 200, 400, 80
MARGIN, DIVERGENCE, ONE_TO_ONE = 0.6, 0.08, 0.95
RARE_BIGRAM = 1e-6
#: Before anything is learned: what share of places a given swap is thought to have garbled.
FIRST_RATE = 0.02
#: A record is garbled if its places say so with this log-odds together: enough that among many
#: millions of records with a hundred swaps each hardly one gets there by chance.
EVIDENCE = 24.0
LOST = "�"
#: The share of a language's own bigrams against those of all languages.
OWN, ALL = 0.97, 0.03
UNSEEN = 1e-12

_UTF8 = re.compile("[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
_PLACE = re.compile("[^\x00-\x7f]+")


@lru_cache(maxsize=None)
def to_bytes(page: str) -> dict[int, str]:
    """translate() table: a character of ``page`` to its byte, as a latin-1 character; characters
    that the page lacks become U+FFFF. Bytes without a character are shown as control characters."""
    table = {}
    for b in range(128, 256):
        try:
            table[ord(bytes([b]).decode(page))] = chr(b)
        except UnicodeDecodeError:
            table[b] = chr(b)
    return defaultdict(lambda: "￿", table)


@lru_cache(maxsize=None)
def from_bytes(page: str) -> dict[int, str]:
    return {ord(b): chr(c) for c, b in to_bytes(page).items()}


def un_utf8(run: str, page: str) -> str | None:
    """``run`` with every UTF-8 sequence shown in ``page`` put right; None if there is none."""
    raw = run.translate(to_bytes(page))
    out, at = [], 0
    for m in _UTF8.finditer(raw):
        try:
            letter = m.group().encode("latin-1").decode("utf-8")
        except UnicodeDecodeError:
            continue
        out += [run[at : m.start()], letter]
        at = m.end()
    return "".join(out) + run[at:] if at else None


@lru_cache(maxsize=100_000)
def candidates(run: str) -> tuple[tuple[str, str], ...]:
    """(swap, what the run was) for every swap that can have produced ``run``."""
    found: dict[str, str] = {}
    fresh = [("", run)]
    for _ in range(3):  # texts are garbled up to three times over
        following = []
        for name, text in fresh:
            for page in SHOWN:
                plain = un_utf8(text, page)
                if plain is not None and plain not in found:
                    found[plain] = f"{name}{page}<utf-8 "
                    following.append((found[plain], plain))
        fresh = following
    if LOST not in run:
        for page in SHOWN:
            raw = run.translate(to_bytes(page))
            if "￿" in raw:
                continue
            for own in WRITTEN:
                plain = raw.translate(from_bytes(own))
                if plain != run and plain not in found and not any("\x80" <= c <= "\xa0" for c in plain):
                    found[plain] = f"{page}<{own} "
    return tuple((swap.strip(), plain) for plain, swap in found.items())


def places(text: str) -> Counter:
    """(before + run + after) -> count; ASCII letters in lower case, anything else and the ends as a blank."""
    found: Counter = Counter()
    for m in _PLACE.finditer(text):
        i, j = m.span()
        before = text[i - 1].lower() if i and text[i - 1].isalpha() else " "
        after = text[j].lower() if j < len(text) and text[j].isalpha() else " "
        found[before + m.group() + after] += 1
    return found


def counters(pairs: DataFrame) -> DataFrame:
    """``slot, n``: the counters of ``pairs(lang, pair, n)``, where :meth:`Model.count` looks for them, for
    each language and for all; the pair '' counts all of a language's."""
    each = pairs.select(F.explode(F.array(F.col("lang"), F.lit("*"))).alias("name"), "pair", "n")
    totals = each.groupBy("name").agg(F.sum("n").alias("n")).select("name", F.lit("").alias("pair"), "n")
    key = F.concat("name", F.lit("\x00"), "pair")
    places = [F.pmod(F.crc32(key), F.lit(WIDTH)), F.lit(WIDTH) + F.pmod(F.crc32(F.concat(key, F.lit("\x01"))), F.lit(WIDTH))]
    return each.unionByName(totals).select(F.explode(F.array(*places)).alias("slot"), "n").groupBy("slot").agg(F.sum("n").alias("n"))


class Model:
    """Bigrams of each language and of all ('*'), in an array of 2 · WIDTH expected counts."""

    def __init__(self, counts, rated: bool):
        self.counts, self.rated = counts, rated
        self.known: dict[tuple[str, str, str], float] = {}
        self.every: dict[tuple[str, str], float] = {}
        self.totals: dict[str, float] = {}
        self.last: tuple = ((None, None), [])

    def count(self, lang: str, a: str, b: str) -> float:
        key = f"{lang}\x00{a}{b}".encode("utf-8", "surrogatepass")
        one = self.counts[zlib.crc32(key) % WIDTH]
        return float(min(one, self.counts[WIDTH + zlib.crc32(key + b"\x01") % WIDTH])) if one else 0.0

    def share(self, lang: str, a: str, b: str) -> float:
        total = self.totals.get(lang)
        if total is None:
            total = self.totals[lang] = self.count(lang, "", "") + 1
        return self.count(lang, a, b) / total

    def log_p(self, lang: str, text: str) -> float:
        """Of the bigrams of ``text``, each drawn from those of its language. (Conditional
        probabilities wouldn't do: garbled text follows itself as regularly as plain text does.)"""
        total, known = 0.0, self.known
        for a, b in zip(text, text[1:]):
            p = known.get((lang, a, b))
            if p is None:
                every = self.every.get((a, b))
                if every is None:
                    every = self.every[a, b] = self.share("*", a, b)
                # What no language has, this one hasn't.
                own = self.share(lang, a, b) if every else 0.0
                p = known[lang, a, b] = math.log(OWN * own + ALL * every + UNSEEN)
            total += p
        return total

    def ways(self, place: str, lang: str) -> list[tuple[float, str, str]]:
        """(log-probability of the text, swap, text) for the place as it stands (swap '') and for
        each way to put it right. Kept for the place's other sources."""
        if self.last[0] != (place, lang):
            before, run, after = place[0], place[1:-1], place[-1]
            texts = [("", place), *((swap, before + plain + after) for swap, plain in candidates(run))]
            self.last = ((place, lang), [(self.log_p(lang, text), swap, text) for swap, text in texts])
        return self.last[1]

    def posteriors(self, place: str, lang: str, rates: dict[str, float], total: float) -> list[tuple[float, str, str]]:
        """(share, swap, text) of the :meth:`ways`, by the counts of swaps in the place's source."""
        ways = self.ways(place, lang)
        if self.rated:
            scores = [p + math.log((rates.get(swap, 0.0) + 0.05) / (total + 5)) for p, swap, _ in ways]
        else:
            scores = [p + (math.log(FIRST_RATE) if swap else 0.0) for p, swap, _ in ways]
        top = max(scores)
        shares = [math.exp(s - top) for s in scores]
        whole = sum(shares)
        return [(s / whole, swap, text) for s, (_, swap, text) in zip(shares, ways, strict=True)]


def _strings(lang, source) -> tuple[str, str]:
    return (lang or "").strip().lower(), source or ""


def _counted(documents: DataFrame) -> DataFrame:
    """``lang, source, place, n``, stored: rows of one place lie together, but those of a place that
    very many sources have in up to 16 tasks."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def rows(found):
            keys = list(found)
            return pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], pa.string()) for i in range(3)] + [pa.array([found[k] for k in keys], pa.int64())], ["lang", "source", "place", "n"])

        found: Counter = Counter()
        for batch in batches:
            for text, lang, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lang, source = _strings(lang, source)
                for place, n in places(text).items():
                    found[lang, source, place] += n
            if len(found) > 200_000:
                yield rows(found)
                found.clear()
        yield rows(found)

    some = documents.where(F.col("text").rlike("[^\\x00-\\x7F]")).select("text", "lang", "source")
    counted = checkpointed(some.mapInArrow(run, "lang string, source string, place string, n bigint").groupBy("lang", "source", "place").agg(F.sum("n").alias("n")))
    # The table is small in bytes but long to go through: the number of tasks follows from its rows.
    tasks = max(1, -(-counted.count() // PLACES))
    return checkpointed(counted.repartition(tasks, "place", F.pmod(F.xxhash64("source"), F.lit(16))).sortWithinPartitions("place", "lang"))


class _Rates(dict):
    """(lang, source) -> (counts of swaps, their sum), read from a row when first met."""

    def of(self, row: int, lang: str, source: str, column) -> tuple[dict[str, float], float]:
        if (lang, source) not in self:
            own = dict(column[row].as_py() or ())
            self[lang, source] = own, sum(own.values())
        return self[lang, source]


def _expected(table: DataFrame, model: Model | None, rates: DataFrame | None) -> tuple[Model, DataFrame]:
    """One round: the bigrams and swaps that model and rates expect; without them, those of the texts
    as they stand."""
    import numpy as np

    # 2 · WIDTH numbers. A worker process keeps it, with what it looked up, from task to task.
    shared = table.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own, known = shared.value, _Rates()

        def rows(pairs, swaps):
            many, few = len(pairs), len(swaps)
            columns = [
                pa.array([*(k[0] for k in pairs), *(k[0] for k in swaps)], pa.string()),
                *(pa.array([*[None] * many, *(k[i] for k in swaps)], pa.string()) for i in (1, 2)),
                pa.array([*(k[1] for k in pairs), *[None] * few], pa.string()),
                pa.array([*pairs.values(), *swaps.values()], pa.float64()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["lang", "source", "swap", "pair", "n"])

        pairs: dict[tuple[str, str], float] = defaultdict(float)
        swaps: dict[tuple[str, str, str], float] = defaultdict(float)
        for batch in batches:
            langs, sources, all_places, counts = (batch.column(i).to_pylist() for i in range(4))
            for i, (lang, source, place, n) in enumerate(zip(langs, sources, all_places, counts, strict=True)):
                if LOST in place:
                    continue
                for share, swap, text in own.posteriors(place, lang, *known.of(i, lang, source, batch.column(4))) if own else [(1.0, "", place)]:
                    if share > 1e-6:
                        swaps[lang, source, swap] += share * n
                        for pair in zip(text, text[1:]):
                            pairs[lang, "".join(pair)] += share * n
            if len(pairs) > 500_000:
                yield rows(pairs, swaps)
                pairs.clear()
                swaps.clear()
        yield rows(pairs, swaps)

    both = _rated(table, rates).mapInArrow(run, "lang string, source string, swap string, pair string, n double")
    summed = checkpointed(both.groupBy("lang", "source", "swap", "pair").agg(F.sum("n").alias("n")))
    counts = np.zeros(2 * WIDTH, "float32")
    sums = counters(summed.where("pair is not null")).toArrow()  # at most 2 · WIDTH rows
    counts[sums["slot"].to_numpy()] = sums["n"].to_numpy()
    swaps = checkpointed(summed.where("pair is null").groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("swap", "n"))).alias("rates")))
    return Model(counts, model is not None), swaps


def _rated(table: DataFrame, rates: DataFrame | None) -> DataFrame:
    """The table with the ``rates`` of each row's language and source."""
    if rates is None:
        return table.select("lang", "source", "place", "n", F.lit(None).cast("map<string,double>").alias("rates"))
    return looked_up(table, rates, ["lang", "source"], SOURCES).select("lang", "source", "place", "n", "rates")


def learned(documents: DataFrame) -> tuple[DataFrame, Model, DataFrame]:
    table = _counted(documents)
    model, rates = _expected(table, None, None)
    for _ in range(ROUNDS):
        model, rates = _expected(table, model, rates)
    return table, model, rates


def garbled_places(documents: DataFrame) -> DataFrame:
    """``lang, source, place, swap, plain, odds``: places more likely garbled than not, stored.

    ``plain`` is the run as it was (null where characters are lost), ``odds`` the log-odds.
    """
    table, model, rates = learned(documents)
    shared = table.sparkSession.sparkContext.broadcast(model)  # 2 · WIDTH numbers

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own, known = shared.value, _Rates()
        names, types = ["lang", "source", "place", "n", "swap", "plain", "odds"], [pa.string()] * 3 + [pa.int64()] + [pa.string()] * 2 + [pa.float64()]
        for batch in batches:
            out = []
            for i, (lang, source, place, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)):
                if LOST in place:
                    out.append((lang, source, place, n, "lost", None, 100.0))
                    continue
                ways = own.posteriors(place, lang, *known.of(i, lang, source, batch.column(4)))
                stands = ways[0][0]
                _, swap, text = max(ways[1:], default=(0.0, "", ""))
                if stands < 0.5:
                    out.append((lang, source, place, n, swap, text[1:-1], math.log(max(1 - stands, 1e-12) / max(stands, 1e-40))))
                else:
                    out.append((lang, source, place, n, None, None, None))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names)

    judged = checkpointed(_rated(table, rates).mapInArrow(run, "lang string, source string, place string, n bigint, swap string, plain string, odds double"))
    known = judged.where("swap is not null").drop("n")
    solved = checkpointed(ciphers(judged.where("swap is null")))
    if solved.isEmpty():
        return known
    return known.unionByName(checkpointed(deciphered(judged.where("swap is null"), solved)))


def ciphers(plain: DataFrame) -> DataFrame:
    """``lang, source, shown, letters, gain``: for sources with characters that no known swap explains,
    the letters that they stand for in a language, as the two strings of a translation, and what a
    deciphered bigram gains in log-probability.

    ``plain(lang, source, place, n)``: the places as they stand. All of it are counts of characters and
    of bigrams: what one group of the solution holds is bounded by the alphabets.
    """
    pairs = plain.select("lang", "source", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("place") - 1), lambda i: F.substring("place", i, F.lit(2)))).alias("pair"))
    pairs = checkpointed(pairs.groupBy("lang", "source", "pair").agg(F.sum("n").alias("n")))
    wide = "[^\\x00-\\x7F]"
    chars = pairs.select("lang", "source", F.substring("pair", 1, 1).alias("c"), "n").where(F.col("c").rlike(wide)).groupBy("lang", "source", "c").agg(F.sum("n").alias("n"))
    own, of_char, all_ = (chars.groupBy(*by).agg(F.sum("n").alias(name)) for by, name in ((["lang", "source"], "own"), (["lang", "c"], "of_char"), (["lang"], "total")))
    each = chars.join(own, ["lang", "source"]).join(of_char, ["lang", "c"]).join(all_, "lang")
    elsewhere = (F.col("of_char") - F.col("n")) / F.greatest(F.col("total") - F.col("own"), F.lit(1))
    suspect = (F.col("n") >= 5) & (F.col("total") - F.col("own") >= EVIDENT) & (F.col("n") / F.col("own") >= LIFT * elsewhere)
    suspects = each.where(suspect).select("lang", "source", F.col("c").alias("s"))
    group = suspects.groupBy("lang", "source").agg(F.collect_set("s").alias("suspects")).where(F.size("suspects").between(SYMBOLS, 256))
    # Bigrams of the language without the suspects of their sources, and those with suspects.
    marked = pairs.join(group, ["lang", "source"], "left")
    has = F.coalesce(F.exists("suspects", lambda s: F.col("pair").contains(s)), F.lit(False))
    reference = marked.where(~has).groupBy("lang", "pair").agg(F.sum("n").alias("n"))
    shown = marked.where(has).select("lang", "source", "pair", "n", "suspects")
    enough = shown.groupBy("lang", "source").agg(F.sum("n").alias("m")).where(F.col("m") >= EVIDENT).select("lang", "source")
    shown = shown.join(enough, ["lang", "source"], "left_semi")
    shown, against = (df.select(*(F.col(c).alias(c) for c in df.columns)) for df in (shown, enough.join(reference, "lang").select("lang", "source", "pair", "n")))

    def run(left, right):
        import pandas as pd

        found = None
        if len(left) and len(right):
            found = solution(dict(zip(left["pair"], left["n"], strict=True)), dict(zip(right["pair"], right["n"], strict=True)), set(left["suspects"].iloc[0]))
        rows = [] if found is None else [(left["lang"].iloc[0], left["source"].iloc[0], "".join(found[0]), "".join(found[0].values()), found[1])]
        return pd.DataFrame(rows, columns=["lang", "source", "shown", "letters", "gain"])

    return shown.groupBy("lang", "source").cogroup(against.groupBy("lang", "source")).applyInPandas(run, "lang string, source string, shown string, letters string, gain double")


@lru_cache(maxsize=1)
def _hints() -> dict[str, Counter]:
    """character -> the letters that pairs of pages make it stand for."""
    found: dict[str, Counter] = defaultdict(Counter)
    for page in (*SHOWN, *FURTHER):
        raw = to_bytes(page)
        for own in (*WRITTEN, *FURTHER):
            plain = from_bytes(own)
            for code, byte in list(raw.items()):
                letter = plain.get(ord(byte))
                if letter and letter != chr(code):
                    found[chr(code)][letter] += 1
    return found


def solution(shown: dict[str, int], reference: dict[str, int], suspects: set[str]) -> tuple[dict[str, str], float] | None:
    """(character -> letter, gain) of the cipher with the bigrams ``shown`` in the language with the
    bigrams ``reference``; None if nothing deciphers it to text of the language.

    Expectation-maximization: a shown bigram comes from a letter bigram of the language, each suspect
    character from a letter with the probability that is learned; other characters stand for themselves.
    """
    import numpy as np

    total = sum(reference.values())
    counts = Counter()
    for pair, n in reference.items():
        counts[pair[0]] += n
        counts[pair[1]] += n
    letters = sorted({c for c, n in counts.items() if n >= 1e-4 * total} - suspects)
    wide = [i for i, a in enumerate(letters) if a > "\x7f"]
    if not wide or len(wide) > ALPHABET:
        return None
    at = {a: i for i, a in enumerate(letters)}
    language = np.zeros((len(letters), len(letters)))
    for pair, n in reference.items():
        if pair[0] in at and pair[1] in at:
            language[at[pair[0]], at[pair[1]]] += n
    language /= language.sum()
    used = {p: n for p, n in shown.items() if all(c in suspects or c in at for c in p)}
    symbols = sorted(suspects & {c for p in used for c in p})
    if len(symbols) < SYMBOLS or sum(used.values()) < EVIDENT:
        return None
    every = [*symbols, *letters]
    of = {c: i for i, c in enumerate(every)}
    bigrams = np.zeros((len(every), len(every)))
    for pair, n in used.items():
        bigrams[of[pair[0]], of[pair[1]]] += n
    fixed = np.vstack([np.zeros((len(symbols), len(letters))), np.eye(len(letters))])
    smooth = language + RARE_BIGRAM / len(letters) ** 2

    def learn(theta):
        for _ in range(STEPS):
            emit = fixed.copy()
            emit[: len(symbols)][:, wide] = theta
            ratio = bigrams / np.maximum(emit @ smooth @ emit.T, 1e-300)
            expected = (emit * (ratio @ emit @ smooth.T + ratio.T @ emit @ smooth))[: len(symbols)][:, wide]
            theta = (expected + 1e-9) / (expected.sum(axis=0) + 1e-9 * len(symbols))
        return expected, float((bigrams * np.log(np.maximum(emit @ smooth @ emit.T, 1e-300))).sum())

    rng, hints = np.random.default_rng(5), _hints()
    starts = [np.array([[0.05 + hints[s][letters[a]] for a in wide] for s in symbols])]
    starts += [rng.random((len(symbols), len(wide))) + 0.5 for _ in range(4)]
    expected, _ = max((learn(x / x.sum(axis=0)) for x in starts), key=lambda r: r[1])
    best = expected.argmax(axis=1)
    mapping = {s: letters[wide[i]] for s, i in zip(symbols, best, strict=True)}

    # Does it read like the language?
    mass, plain, log_p = 0.0, Counter(), 0.0
    for pair, n in used.items():
        one, two = (mapping.get(c, c) for c in pair)
        log_p += n * math.log(language[at[one], at[two]] + RARE_BIGRAM)
        mass += n
        for c in pair:
            if c in mapping:
                plain[c] += n
    clean = language[wide].sum() + language[:, wide].sum() - language[np.ix_(wide, wide)].sum()
    touched = np.zeros(len(letters), bool)
    touched[wide] = True
    own = np.where(touched[:, None] | touched[None, :], language, 0) / clean
    usual = float((own[own > 0] * np.log(language[own > 0] + RARE_BIGRAM)).sum())
    first = {}
    for s, n in sorted(plain.items(), key=lambda x: -x[1]):
        first.setdefault(mapping[s], s)
    single = sum(n for s, n in plain.items() if first[mapping[s]] == s) / sum(plain.values())
    p, q = np.zeros(len(letters)), np.zeros(len(letters))
    for s, n in plain.items():
        p[at[mapping[s]]] += n
    q[wide] = (language.sum(axis=0) + language.sum(axis=1))[wide]
    p, q = p / p.sum(), q / q.sum()
    mean = (p + q) / 2
    divergence = sum(float((x[x > 0] * np.log(x[x > 0] / mean[x > 0])).sum()) for x in (p, q)) / 2
    if log_p / mass < usual - MARGIN or divergence > DIVERGENCE or single < ONE_TO_ONE:
        return None
    # Only letters may be read out of it: signs between blanks are alike in every language.
    if sum(n for s, n in plain.items() if unicodedata.category(mapping[s])[0] == "L") < 0.8 * sum(plain.values()):
        return None
    return mapping, log_p / mass - math.log(RARE_BIGRAM)


def deciphered(plain: DataFrame, solved: DataFrame) -> DataFrame:
    """``lang, source, place, swap, plain, odds`` of the places whose characters are all ciphers."""
    run = F.expr("substring(place, 2, length(place) - 2)")
    met = plain.join(solved, ["lang", "source"]).withColumn("run", run).where("translate(run, shown, '') = ''")
    odds = F.col("gain") / 2 * (F.length("place") - 1)
    return met.select("lang", "source", "place", F.lit("learned").alias("swap"), F.expr("translate(run, shown, letters)").alias("plain"), odds.alias("odds"))


def bit(*parts: str) -> int:
    return zlib.crc32("\x00".join(parts).encode("utf-8", "surrogatepass")) % (1 << 20)


def found(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, place, swap, plain, odds``: the garbled places of each record with any.

    ``documents`` has ``key`` (unique), ``text``, ``lang`` and ``source``. Null, empty and plain
    ASCII texts are never garbled; null ``lang`` or ``source`` count as a language or source of
    their own. An empty table gives no rows; extra columns are ignored.
    """
    garbled = garbled_places(documents)
    bits = garbled.select(F.pmod(F.crc32(F.concat_ws("\x00", "lang", "source", "place")), F.lit(1 << 20)).cast("int").alias("slot")).distinct().toArrow()["slot"].to_numpy()
    shared = documents.sparkSession.sparkContext.broadcast(bits)  # at most 2**20 entries
    kind = dict(documents.dtypes)[key]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        maybe = np.zeros(1 << 20, bool)
        maybe[shared.value] = True
        for batch in batches:
            out = []
            for k, text, lang, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lang, source = _strings(lang, source)
                out += [(k, lang, source, place) for place in places(text) if maybe[bit(lang, source, place)]]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((batch.schema.field(0).type, pa.string(), pa.string(), pa.string()))], [key, "lang", "source", "place"])

    some = documents.where(F.col("text").rlike("[^\\x00-\\x7F]")).select(key, "text", "lang", "source")
    seen = some.mapInArrow(run, f"`{key}` {kind}, lang string, source string, place string")
    return seen.join(garbled, ["lang", "source", "place"]).select(key, "place", "swap", "plain", "odds")


def garbled(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, odds, swaps, recoverable``: the records whose places together pass ``EVIDENCE``."""
    per = found(documents, key).groupBy(key).agg(
        F.sum("odds").alias("odds"), F.array_sort(F.collect_set("swap")).alias("swaps"), F.every(F.col("plain").isNotNull()).alias("recoverable")
    )
    return per.where(F.col("odds") >= EVIDENCE)


def restored(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, restored, recoverable``: the text of each garbled record put right where it can be.

    Places whose characters are lost stay as they are (``recoverable`` is false then).
    """
    places_of = found(documents, key).groupBy(key).agg(
        F.sum("odds").alias("odds"), F.collect_list(F.struct("place", "plain")).alias("_places"), F.every(F.col("plain").isNotNull()).alias("recoverable")
    ).where(F.col("odds") >= EVIDENCE)
    kind = dict(documents.dtypes)[key]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            keys, texts, lists, whole = (c.to_pylist() for c in batch.columns)
            out = []
            for text, entries in zip(texts, lists, strict=True):
                plain = {e["place"]: e["plain"] for e in entries if e["plain"] is not None}

                def put_right(m, text=text, plain=plain):
                    i, j = m.span()
                    before = text[i - 1].lower() if i and text[i - 1].isalpha() else " "
                    after = text[j].lower() if j < len(text) and text[j].isalpha() else " "
                    return plain.get(before + m.group() + after, m.group())

                out.append(_PLACE.sub(put_right, text))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), batch.column(3)], [key, "restored", "recoverable"])

    both = documents.select(key, "text").join(places_of, key).select(key, "text", "_places", "recoverable")
    return both.mapInArrow(run, f"`{key}` {kind}, restored string, recoverable boolean")

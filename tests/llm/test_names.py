from collections import Counter
from itertools import combinations, permutations

from hypothesis import given, settings
from hypothesis import strategies as st

from axiomill.llm import names as N

GIVEN = [("Alexander", "Sasha"), ("Eleonora", "Nora"), ("Theodore", "Theo"), ("Dorothea", "Dora")]


def found(spark, authors, extra=False):
    rows = spark.createDataFrame([(a, "x") for a in authors], "author string, form string")
    given_names = spark.createDataFrame(GIVEN, "given_name string, short_name string")
    return {(r["a"], r["b"]) for r in N.variants(rows, "author", given_names).collect()}


def linked(spark, *groups):
    got = found(spark, [a for g in groups for a in g])
    want = {tuple(sorted(p, key=lambda x: x.encode())) for g in groups for p in combinations(dict.fromkeys(x for x in g if x is not None), 2)}
    assert got == want


def test_one_person_in_many_spellings(spark):
    linked(
        spark,
        ["Alexander P. Trovimont", "TROVIMONT, Alexander", "A. Trovimont", "Sasha Trovimont", "alexander p. trovimont", "Alexander Trovimnot", "Trovimont AP", "Alex\\'ander Trovimont", "Dr Alexander  Trovimont "],
        ["Eleonora Trovimont", "Nora Trovimont", "Trovimont, E."],
        ["Fandisk Institute for Applied Mathematics", "Inst. Applied Maths Fandisk", "Fandisk IAM", "FANDISK INSTITUTE FOR APPLIED MATHEMATICS"],
        ["Fandisk Institute for Discrete Mathematics"],
    )


def test_an_initial_of_two_persons_is_left_alone(spark):
    got = found(spark, ["Eduard Molnir", "Emilia Molnir", "E. Molnir"])
    assert got == set()


def test_known_short_names_are_not_slips_of_each_other(spark):
    assert found(spark, ["Dora Kelmin", "Nora Kelmin"]) == set()


def test_nulls_repeats_blanks_and_empty_tables(spark):
    linked(spark, [None, None], ["Zeno Artuval", "Zeno Artuval", "zeno artuval"], [""], ["  "], ["..."], ["x" * 5000])
    assert found(spark, []) == set()


def edits(a, b):
    """Damerau-Levenshtein distance (optimal string alignment), by the book."""
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=1, max_size=6), st.text("abc", min_size=1, max_size=6))
def test_the_index_finds_every_pair_within_one_edit(a, b):
    near = a != b and edits(a, b) == 1
    assert N.one_edit(a, b) == near
    if near:
        assert N.deletions(a) & N.deletions(b)


def by_permutations(one, two):
    """The least cost of an assignment by trying all, or None: as N.aligned says, without the order."""
    a, b = sorted((N.parsed(one), N.parsed(two)), key=len)
    alike = Counter(t for t in a if t[1] == "full") & Counter(t for t in b if t[1] == "full")
    if not alike:
        return None
    a, b = (list((Counter(x) - alike).elements()) for x in (a, b))
    best = None
    for chosen in permutations(range(len(b)), len(a)):
        costs = [N.stands_for(x, b[j]) for x, j in zip(a, chosen)]
        left = [t for j, t in enumerate(b) if j not in chosen]
        if None not in costs and all(t[1] == "initial" for t in left):
            best = min(best if best is not None else 99, sum(costs) + len(left))
    return best


TOKENS = st.sampled_from("weber/full emil/full e/initial em/short erika/full k/initial institute/full inst/short instit/full".split())


@settings(max_examples=400, deadline=None)
@given(st.lists(TOKENS, min_size=1, max_size=5), st.lists(TOKENS, min_size=1, max_size=5))
def test_the_assignment_equals_trying_all(a, b):
    got = N.aligned(" ".join(a), " ".join(b))
    assert (got is None) == (by_permutations(" ".join(a), " ".join(b)) is None)
    assert N.aligned(" ".join(b), " ".join(a)) == (got and got[::-1])


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 5).flatmap(lambda n: st.lists(st.lists(st.integers(0, 9), min_size=5, max_size=5), min_size=n, max_size=n)))
def test_assignments_are_of_least_cost(costs):
    chosen = N.assignment([list(map(float, row)) for row in costs])
    assert len(set(chosen)) == len(costs)
    assert sum(row[j] for row, j in zip(costs, chosen)) == min(sum(row[j] for row, j in zip(costs, c)) for c in permutations(range(5), len(costs)))


def test_long_names_and_short_slips(spark):
    long = "Fandisk Royal Institute for Pure Applied Discrete Numerical Computational Statistical Theoretical Mathematics"
    linked(spark, [long, long.replace("Mathematics", "Math."), long.replace("Institute", "Inst.").replace("Numerical", "Num.")], [long.replace("Pure", "Modern")])
    many = [f"{g} Kim" for g in ("Ana", "Bela", "Cleo", "Dario", "Elin", "Fadi", "Gita", "Hugo", "Iman", "Jana", "Kaja", "Liev", "Mona", "Nils", "Olga", "Pia", "Quin", "Rosa")]
    assert found(spark, [*many, "Hugo Kin"]) == {("Hugo Kim", "Hugo Kin")}
    assert found(spark, [*many[:6], "Elin Kin"]) == set()  # too few to tell


def test_an_initial_below_very_many_full_names(spark):
    """A surname with thousands of forms: the initial of all of them is tied to none."""
    full = [f"Jo{a}{b}{c} Molnir" for a in "abcdefghij" for b in "abcdefghij" for c in "abcdefghij"]
    assert found(spark, [*full[::3], "J. Molnir"]) - found(spark, full[::3]) == set()

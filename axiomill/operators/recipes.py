"""Recipes as graphs of states: each step takes ingredients and earlier states to a new state."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

# Verbs that start a step.
VERBS = frozenset(
    "add bake beat blend boil bring brown chop combine cook cool cover cut drain fold fry grate grill heat knead marinate mix peel place pour preheat press roast roll "
    "rinse season serve simmer slice soak spread sprinkle stir strain toast top toss turn wait warm wash whisk melt chill let line drop remove repeat".split()
)
# Words that end a step's objects.
ENDS = frozenset("in on into onto over until for with to at off from under directly overnight well about aside".split())
# Verbs that go on from the last state besides what they name.
JOINING = ("add", "combine with", "mix with", "stir in", "fold in", "toss with")
NOT_FOOD = frozenset("a an the of and or half third one two large small".split())


def singular(word: str) -> str:
    return word[:-3] + "y" if word.endswith("ies") else word[:-1] if word.endswith("s") and not word.endswith(("ss", "us")) else word


def steps(text: str) -> list[str]:
    """Sentences, and parts after commas that start with a verb."""
    out: list[str] = []
    for sentence in re.split(r"[.;!]\s*", text.lower().strip()):
        for i, part in enumerate(re.split(r",\s*", sentence)):
            part = re.sub(r"^(?:and|then)\s+", "", part.strip())
            if not part:
                continue
            if i and part.split()[0] not in VERBS and out:
                out[-1] += " and " + part  # a list of foods goes on
            else:
                out.append(part)
    return out


def graph(text: str, ingredients: list[str] = ()) -> list[tuple[str, str, str, str]]:
    """(source, action, target, qualifiers) edges; states are s1, s2, ..

    An ingredient that was used before stands for the last state that holds it. A step without
    objects, with unknown ones, or with a joining verb takes the last state too.
    """
    known = {" ".join(map(singular, i.split())) for i in ingredients}
    edges, holds, last = [], {}, None

    def state_of(food: str) -> str | None:
        return next((s for s, foods in reversed(holds.items()) if any(f == food or food in f.split() for f in foods)), None)

    for number, step in enumerate(steps(text), 1):
        words = step.split()
        verb = words[0]
        action = f"{verb} with" if words[1:2] == ["with"] else verb
        rest = words[2:] if words[1:2] == ["with"] else words[1:]
        stop = next((i for i, w in enumerate(rest) if w in ENDS), len(rest))
        objects, qualifiers = [" ".join(x.split()) for x in re.split(r"\band\b|,", " ".join(rest[:stop]))], " ".join(rest[stop:])
        sources, foods, unknown = [], set(), False
        listed = len([o for o in objects if o]) > 1
        for phrase in objects:
            core = [singular(w) for w in phrase.split() if w not in NOT_FOOD]
            if not core or core[0].isdigit() or core[0] in VERBS:
                continue
            name = " ".join(core)
            food = next((k for n in range(len(core), 0, -1) for i in range(len(core) - n + 1) if (k := " ".join(core[i : i + n])) in known), None)
            mixture = core[-1] in ("mixture", "batter", "dough", "sauce") or core[0].endswith("ed")
            earlier = state_of(food or core[-1])
            if earlier and earlier not in sources:
                sources.append(earlier)
                foods |= holds[earlier]
            elif food or (not known and not mixture) or (mixture and last is None) or (not mixture and (listed or last is None)) or action.endswith("with"):
                sources.append(name if not food else food)
                foods.add(name)
            elif mixture and (loose := [s for s in reversed(holds) if s not in sources and s not in {e[0] for e in edges}]):
                sources.append(loose[0])
                foods |= holds[loose[0]]
            else:
                unknown = True
        # a thing prepared before, such as a preheated grill, takes part in the step
        if prepared := re.search(r"\bon (?:a |the )?(\w+ed \w+)", qualifiers):
            sources.append(prepared.group(1))
        target = f"s{number}"
        if last and last not in sources and (not sources or unknown or action in JOINING):
            if action not in ("top with", "spread with") or not sources:
                sources.append(last)
                foods |= holds[last]
        for source in sources:
            edges.append((source, action, target, qualifiers))
        if sources:
            holds[target], last = foods, target
    return edges


def edges(recipes: DataFrame, key: str, ingredients: list[str] = ()) -> DataFrame:
    """``key, source, action, target, qualifiers`` of recipes (``text``); null texts give no rows."""
    kind, foods = dict(recipes.dtypes)[key], list(ingredients)

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            out = [(k, *e) for k, t in zip(frame[key], frame["text"], strict=True) for e in graph(t, foods)]
            yield pd.DataFrame(out, columns=[key, "source", "action", "target", "qualifiers"])

    return recipes.where("text is not null").select(key, "text").mapInPandas(run, f"`{key}` {kind}, source string, action string, target string, qualifiers string")

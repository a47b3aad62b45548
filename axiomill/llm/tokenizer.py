"""Byte-level BPE as a deterministic automaton over tokens.

A merge list defines which token sequences are encodings: a sequence is the encoding of its bytes
exactly if each pair of neighbouring tokens is one. The automaton has one state for each token
(the label of the arc last taken); the gadget of a merge (u, v) cuts the arc labelled v out of
every state in which the merge would have fired across the boundary. Those cuts are resolved from
the merge gadgets when an arc is first asked for and then kept in the transition table, as the
table for all pairs of 50,000 tokens would have 2.5e9 entries.

A word (a piece of the public splitting pattern) is encoded by running the automaton over its
bytes; for each prefix exactly one last arc leads to acceptance. Words are encoded once per worker
process and then looked up. Decoding emits the arcs' byte labels.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

from pyspark.sql import DataFrame

#: The public splitting pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words and arcs kept in a worker's tables; beyond it a table starts afresh. It never changes a result.
WORDS_KEPT, ARCS_KEPT = 400_000, 2_000_000
DEFAULT_FOLDER = "/opt/tokenizers"


def byte_letters() -> dict[str, int]:
    """The printable stand-in of every byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


class Automaton:
    """Transitions of a merge list; ``encode`` and ``decode`` work on bytes."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[int, int, int]]):
        """``merges``: (left, right, result) in order of priority."""
        self.ids = vocab
        self.labels = {i: b for b, i in vocab.items()}
        # The tokens read from their ends, as a tree: at None the token that is complete there.
        self.endings: dict = {}
        for token, i in vocab.items():
            node = self.endings
            for byte in reversed(token):
                node = node.setdefault(byte, {})
            node[None] = i
        self.gadgets = {(u, v): rank for rank, (u, v, _) in enumerate(merges)}
        never = len(merges)
        made = {w: (rank, u, v) for rank, (u, v, w) in reversed(list(enumerate(merges)))}
        self.right: dict[int, list[tuple[int, int, int]]] = {}
        self.left: dict[int, list[tuple[int, int, int]]] = {}
        for side, spines in ((2, self.right), (1, self.left)):
            for token in vocab.values():
                spine, ends, x = [], never, token
                while x in made:
                    rank = made[x][0]
                    spine.append((x, rank, ends))
                    ends, x = rank, made[x][side]
                spine.append((x, -1, ends))
                spines[token] = spine
        self.arcs: dict[tuple[int, int], bool] = {}
        self.words = _Words(self.encode)

    def arc(self, state: int, token: int) -> bool:
        """Whether the arc ``token`` leaves ``state``, i.e. no merge gadget cuts it there.

        A gadget (x, y) cuts it if both are whole at its rank: x on the right spine of ``state``,
        y on the left spine of ``token``. Equal ranks overlap only in runs such as aaa, where the
        leftmost pair is merged first.
        """
        known = self.arcs.get((state, token))
        if known is None:
            gadgets, known = self.gadgets, True
            for x, x_from, x_to in self.right[state]:
                for y, y_from, y_to in self.left[token]:
                    rank = gadgets.get((x, y))
                    if rank is not None and x_from < rank < x_to and y_from < rank <= y_to:
                        known = False
                        break
                if not known:
                    break
            if len(self.arcs) >= ARCS_KEPT:
                self.arcs.clear()
            self.arcs[state, token] = known
        return known

    def encode(self, word: bytes) -> list[int]:
        whole, arc, endings = self.ids.get(word), self.arc, self.endings
        if len(word) == 1:
            return [whole]
        last: list[int] = []
        for end in range(1, len(word) + 1):
            # Back from the end as far as tokens go; exactly one of them leads on from its start.
            node, start = endings, end
            while start:
                start -= 1
                node = node.get(word[start])
                if node is None:
                    raise ValueError("a byte without a token")
                token = node.get(None)
                if token is not None and (not start or arc(last[start - 1], token)):
                    last.append(token)
                    break
        out, end = [], len(word)
        while end:
            out.append(last[end - 1])
            end -= len(self.labels[out[-1]])
        return out[::-1]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.labels.__getitem__, ids))


class _Words(dict):
    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> list[int]:
        if len(self) >= WORDS_KEPT:
            self.clear()
        found = self.encode(word.encode("utf-8", "surrogatepass"))
        self[word] = found
        return found


@lru_cache(maxsize=4)
def automaton(name: str = "byte_bpe_50k", folder: str = DEFAULT_FOLDER) -> Automaton:
    """The automaton of ``folder/name.json`` (vocabulary and merge list), once per process."""
    model = json.loads(Path(folder, f"{name}.json").read_text())["model"]
    letters = byte_letters()
    raw = {token: bytes(map(letters.__getitem__, token)) for token in model["vocab"] if all(c in letters for c in token)}
    special = "<|endoftext|>"
    ids = {token: model["vocab"][token] for token in raw if token != special}
    pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
    return Automaton({raw[t]: i for t, i in ids.items()}, [(ids[a], ids[b], ids[a + b]) for a, b in pairs])


@lru_cache(maxsize=1)
def _pieces():
    import regex

    return regex.compile(PATTERN).findall


def encode_text(text: str | None, name: str = "byte_bpe_50k", folder: str = DEFAULT_FOLDER) -> list[int]:
    """Token ids of one text; the empty list for null and empty texts."""
    return [] if not text else list(chain.from_iterable(map(automaton(name, folder).words.__getitem__, _pieces()(text))))


def decode_ids(ids: list[int], name: str = "byte_bpe_50k", folder: str = DEFAULT_FOLDER) -> str:
    return automaton(name, folder).decode(ids).decode("utf-8", "replace")


def encoded(documents: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = DEFAULT_FOLDER) -> DataFrame:
    """``key, ids array<int>``: one row per input row, in one pass without a shuffle.

    Null and empty texts give the empty list, blanks are tokens as any other text, a null key stays
    null and repeated rows stay repeated. Texts are encoded whole, whatever their length.
    """
    kind = dict(documents.dtypes)[key]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        words, pieces = automaton(name, folder).words.__getitem__, _pieces()
        for batch in batches:
            # Bounded steps: the ids of many long texts never lie in memory at once.
            texts, start, n = batch.column(1), 0, batch.num_rows
            while start < n:
                flat, ends, stop = [], [0], start
                while stop < n and (len(flat) < 2_000_000):
                    text = texts[stop].as_py()
                    if text:
                        flat.extend(chain.from_iterable(map(words, pieces(text))))
                    ends.append(len(flat))
                    stop += 1
                lists = pa.ListArray.from_arrays(pa.array(np.array(ends, dtype="int32")), pa.array(np.array(flat, dtype="int32")))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), lists], [key, "ids"])
                start = stop

    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_counts(documents: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = DEFAULT_FOLDER) -> DataFrame:
    """``key, n_tokens bigint``: as :func:`encoded`, without keeping the ids."""
    kind = dict(documents.dtypes)[key]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        words, pieces = automaton(name, folder).words.__getitem__, _pieces()
        count = _Words(lambda word: len(words(word.decode("utf-8", "surrogatepass")))).__getitem__
        for batch in batches:
            n = [sum(map(count, pieces(text.as_py()))) if text.is_valid else 0 for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], [key, "n_tokens"])

    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint")

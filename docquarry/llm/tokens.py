"""Ids of whole texts by a byte-level tokenizer, with each distinct piece of a task encoded once.

A byte-level tokenizer splits text before it merges, and no piece runs from a non-blank into a following space. A
space that a non-blank follows therefore always starts a new piece, and what stands between two such spaces can be encoded alone.
"""

from __future__ import annotations

import base64
import json
import re
from array import array
from collections.abc import Callable, Iterable
from functools import lru_cache

import tiktoken

#: Pieces remembered by a task at most; then it starts afresh. This bounds memory, not results.
REMEMBERED = 150_000
#: A space before another blank or at the end: such a text is encoded in one go.
AWKWARD = re.compile(r" (?:\s|$)")

Encode = Callable[[list[str]], list[bytes]]


class Pieces:
    """Texts to ids, as little-endian unsigned 32-bit bytes. ``encode`` gives such bytes for strings."""

    def __init__(self, encode: Encode):
        self.encode, self.after_space = encode, {}

    def learn(self, texts: Iterable[str]) -> None:
        if len(self.after_space) > REMEMBERED:
            self.after_space = {}
        new: set[str] = set()
        for text in texts:
            new.update(text.split(" ")[1:])
        new.difference_update(self.after_space)
        fresh = list(new)
        self.after_space.update(zip(fresh, self.encode([f" {x}" for x in fresh])))

    def ids(self, texts: list[str]) -> list[bytes]:
        awkward = [i for i, text in enumerate(texts) if AWKWARD.search(text)]
        whole = dict(zip(awkward, self.encode([texts[i] for i in awkward])))
        plain = [i for i in range(len(texts)) if i not in whole]
        self.learn(texts[i] for i in plain)
        heads = dict(zip(plain, self.encode([texts[i].partition(" ")[0] for i in plain])))
        known = self.after_space.__getitem__
        return [whole[i] if i in whole else heads[i] + b"".join(map(known, text.split(" ")[1:])) for i, text in enumerate(texts)]


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable ones for themselves, the others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def ranks_of(definition: bytes) -> dict[bytes, int]:
    """Ranks from the content of a rank file, or of a byte-level BPE definition whose merges stand in the order of their ids."""
    if not definition.lstrip().startswith(b"{"):
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, definition.splitlines())}
    parsed, letters = json.loads(definition), byte_alphabet()
    vocabulary, special = parsed["model"]["vocab"], {x["content"] for x in parsed["added_tokens"]}
    merged = [vocabulary["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in parsed["model"]["merges"]]
    if any(a >= b for a, b in zip(merged, merged[1:])):
        raise ValueError("the merges of this definition do not stand in the order of their ids")
    return {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if token not in special}


def added_ids(definition: bytes) -> dict[str, int]:
    """Strings that a definition takes whole, before it splits text, with their ids; a rank file has none."""
    if not definition.lstrip().startswith(b"{"):
        return {}
    added = json.loads(definition)["added_tokens"]
    if any(x[flag] for x in added for flag in ("single_word", "lstrip", "rstrip")):
        raise ValueError("an added token of this definition is matched by more than its text")
    return {x["content"]: x["id"] for x in added}


class WithAdded(Pieces):
    """As Pieces, but strings in ``added`` get their own ids, and what stands between them is encoded alone."""

    def __init__(self, encode: Encode, added: dict[str, int]):
        super().__init__(encode)
        self.own = {x: array("I", [i]).tobytes() for x, i in added.items()}
        self.border = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")

    def ids(self, texts: list[str]) -> list[bytes]:
        cut = {i: self.border.split(text) for i, text in enumerate(texts) if any(x in text for x in self.own)}
        between = iter(super().ids([x for parts in cut.values() for x in parts[::2]]))
        rest = iter(super().ids([text for i, text in enumerate(texts) if i not in cut]))
        return [b"".join(self.own[x] if k % 2 else next(between) for k, x in enumerate(cut[i])) if i in cut else next(rest) for i in range(len(texts))]


def ranked_pieces(definition: bytes, pattern: str) -> Pieces:
    """For a vocabulary given by the content of its file and the pattern that splits text; added tokens of the definition get their ids."""
    coder = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks_of(definition), special_tokens={})
    one = coder.encode_ordinary
    encode, added = lambda texts: [array("I", one(text)).tobytes() for text in texts], added_ids(definition)
    return WithAdded(encode, added) if added else Pieces(encode)


@lru_cache(maxsize=2)
def shared_pieces(definition: bytes, pattern: str) -> Pieces:
    """One for all tasks of a worker process, so that what one task has encoded serves the next."""
    return ranked_pieces(definition, pattern)

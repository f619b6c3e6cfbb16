"""Public rank vocabularies: loading them on an executor and encoding with bounded memory."""

from __future__ import annotations

import base64
import json
import re
import struct
from functools import lru_cache

import numpy as np

#: Spaces before a character that is no white space always start a pre-token.
_CUT = re.compile(r" (?=\S)")
_ODD = re.compile(r" (?=\s|\Z)")


def rank_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def token_bytes(path: str) -> list[bytes]:
    table = ranks(path)
    out = [b""] * (max(table.values()) + 1)
    for token, i in table.items():
        out[i] = token
    return out


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding(path.rsplit("/", 1)[-1], pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


class Memo(dict):
    """Function results by key; emptied when it holds ``limit`` entries, which changes no result."""

    def __init__(self, make, limit: int = 400_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self.make(key)
        if len(key) < 200:
            self[key] = value
        return value


def _cut(text: str) -> list[str]:
    return _CUT.split(text) if _ODD.search(text) else text.split(" ")


def cut_pieces(text: str) -> list[str]:
    """Pieces of a text that each start where a pre-token is known to start; they join to the text."""
    if not text:
        return []
    parts = _cut(text)
    return [parts[0], *[" " + p for p in parts[1:]]] if parts[0] else [" " + p for p in parts[1:]]


@lru_cache(maxsize=4)
def _packed(path: str, pattern: str) -> tuple[Memo, Memo]:
    """Ids of pieces, and of pieces named without the space they start with."""
    enc = encoding(path, pattern)

    def ids(piece: str) -> bytes:
        got = enc.encode_ordinary(piece)
        return struct.pack(f"<{len(got)}I", *got)

    return Memo(ids), Memo(lambda rest: ids(" " + rest))


def packed_ids(text: str, path: str, pattern: str) -> bytes:
    """All ids of ``text`` as little-endian 32-bit words.  The text is cut where a pre-token is
    known to start, and what lies between is encoded once and remembered."""
    if not text:
        return b""
    whole, spaced = _packed(path, pattern)
    first, *rest = _cut(text)
    out = [spaced[p] for p in rest]
    return b"".join([whole[first], *out] if first else out)


@lru_cache(maxsize=4)
def added_tokens(json_path: str) -> dict[str, int]:
    """Tokens that a tokenizer file adds to its ranks (content -> id): each occurrence in a text is that one
    id, before anything else is split.  Only plain ones are known here (no stripping, no whole words)."""
    with open(json_path, encoding="utf-8") as f:
        added = json.load(f).get("added_tokens", [])
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        raise ValueError(f"{json_path}: added tokens with stripping or word rules are not supported")
    return {t["content"]: int(t["id"]) for t in added}


def packed_ids_with_added(text: str, path: str, pattern: str, added: dict[str, int]) -> bytes:
    """``packed_ids`` of a text whose added tokens (leftmost first, of several the longest) are cut out first."""
    if not any(a in text for a in added):
        return packed_ids(text, path, pattern)
    cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")
    return b"".join([np.array([added[p]], "<u4").tobytes() if i % 2 else packed_ids(p, path, pattern)
                     for i, p in enumerate(cut.split(text))])

"""Byte-level BPE ids of texts, fast for text of common words.

The ids are those of the ``tokenizers`` library with the vocabulary's JSON file and
``add_special_tokens=False``; a special token's string in a text is that token. What the file
says chooses the way: if it describes plain byte-level BPE whose ids rise in merge order, its
merges are given to ``tiktoken``, which is faster, and common pieces come from a bounded memo;
any other vocabulary, and any text with a special token's string, goes to the library whole.

The memo: a boundary of the tokenizer's first split lies before every single space between two
non-space characters, so a text without other blanks before a space can be cut there and each
piece looked up.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from collections.abc import Callable
from functools import cache

import numpy as np

#: Pieces that a worker remembers at most; the memo then starts anew.
MEMO = 700_000
#: How byte-level BPE splits a text before its merges (a fixed value of that format).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_BLANK_BEFORE_SPACE = re.compile(r"\s ")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def _library(path: str) -> Callable[[str], list[int]]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    return lambda text: whole.encode(text, add_special_tokens=False).ids


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else one from 256 on."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(others)}


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """The vocabulary as ranks of byte strings, or None if it isn't plain byte-level BPE in merge order."""
    model, first = spec["model"], spec.get("pre_tokenizer") or {}
    plain = not spec.get("normalizer") and not spec.get("post_processor") and first.get("type") == "ByteLevel" and not first.get("add_prefix_space") and first.get("use_regex", True)
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    if not plain or model.get("type") != "BPE" or any(model.get(k) for k in odd):
        return None
    letters, special = _byte_letters(), {t["content"] for t in spec.get("added_tokens", [])}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"].get(a + b, -1) for a, b in pairs]
    words = {w: i for w, i in model["vocab"].items() if w not in special}
    if made != sorted(made) or len(words) != 256 + len(made) or any(c not in letters for w in words for c in w):
        return None
    return {bytes(letters[c] for c in w): i for w, i in words.items()}


@cache
def _encoder(path: str) -> tuple[Callable[[str], list[int]] | None, re.Pattern | None]:
    """The fast encoder, if the vocabulary allows one, and a pattern of the special tokens' strings."""
    with open(path, encoding="utf-8") as lines:
        spec = json.load(lines)
    special = [re.escape(t["content"]) for t in spec.get("added_tokens", [])]
    ranks = _ranks(spec)
    if ranks is None:
        return None, None
    import tiktoken

    fast = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return fast, re.compile("|".join(special)) if special else None


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


class _Memo(dict):
    """Packed ids by piece; the piece's leading space is left off, and its full stops and commas are its own entry."""

    def __init__(self, encode):
        self.encode = encode
        self.ends: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        stem = piece.rstrip(".,")
        end = piece[len(stem) :]
        if end and stem.isalpha():  # letters end where punctuation starts, so the two are split anyway
            if end not in self.ends:
                if len(self.ends) >= 1000:
                    self.ends.clear()
                self.ends[end] = _packed(self.encode(end))
            ids = self[stem] + self.ends[end]
        else:
            ids = _packed(self.encode(" " + piece))
        if len(piece) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = ids
        return ids


@cache
def _memo(path: str) -> _Memo:
    return _Memo(_encoder(path)[0])


def encoded(text: str, path: str) -> bytes:
    """The token ids of a text as little-endian 32-bit numbers."""
    fast, special = _encoder(path)
    if fast is None or (special and special.search(text)):
        return _packed(_library(path)(text))
    if _BLANK_BEFORE_SPACE.search(text) or text[:1] == " " or text[-1:] == " ":
        return _packed(fast(text))
    head, *rest = text.split(" ")
    return _packed(fast(head)) + b"".join(map(_memo(path).__getitem__, rest))


def ids(text: str, path: str) -> list[int]:
    return np.frombuffer(encoded(text, path), "<u4").tolist()

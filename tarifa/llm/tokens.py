"""Byte-level BPE ids from a published vocabulary file."""

from __future__ import annotations

import json
import os
import re
from array import array

import public_tokenizers
import tiktoken


def _byte_of() -> dict[str, int]:
    """Byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


#: A long run of white space but for its last character, which the next piece may take; all of it at the end. By the pattern it is one
#: piece of the text; the regular expression library needs a stack frame for each of its characters, so it is cut out first.
_SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_LONG_RUN = re.compile(rf"{_SPACE}{{10000,}}(?:\Z|(?={_SPACE}))")


class Encoder:
    """Ids as the ``tokenizers`` library gives them for the same file with ``add_special_tokens=False``.

    The file is a byte-level BPE of that library (``.json``). Its added tokens (such as ``<|endoftext|>``) in a text are split
    off first and get their own id, as there; the text between goes through a faster implementation of the same merges.
    """

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, byte = spec["model"], _byte_of()
        if model["type"] != "BPE" or spec["normalizer"] is not None or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path} is not a byte-level BPE without normaliser")
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} has added tokens that take white space")
        ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in added}
        if max([*ranks.values(), *added.values()]) >= 1 << 16:
            raise ValueError(f"{path} has ids beyond 16 bits")
        encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
        self._plain, self._piece, self._ids = encoding.encode_ordinary, encoding._encode_single_piece, added
        self._added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None

    @classmethod
    def at(cls, path: str) -> Encoder:
        """One per process; ``path`` is a file, or the name of one of the installed vocabularies."""
        if path not in cls._made:
            cls._made[path] = cls(path if os.sep in path else public_tokenizers.path(path))
        return cls._made[path]

    def encode(self, text: str | None) -> bytes:
        """16-bit ids in the machine's (little-endian) order."""
        if not text:
            return b""
        if self._added is None or not self._added.search(text):
            return array("H", self._between(text)).tobytes()
        out, at = array("H"), 0
        for m in self._added.finditer(text):
            out.extend(self._between(text[at : m.start()]))
            out.append(self._ids[m[0]])
            at = m.end()
        out.extend(self._between(text[at:]))
        return out.tobytes()

    def _between(self, text: str) -> list[int]:
        """Ids of a text without added tokens."""
        out, at = [], 0
        for m in _LONG_RUN.finditer(text):
            out += self._plain(text[at : m.start()])
            out += self._piece(m[0])
            at = m.end()
        return out + self._plain(text[at:]) if at else self._plain(text)

"""Byte-level BPE: splitting whole texts into pre-tokens, and whole texts into ids."""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import regex

#: The split pattern of byte-level BPE (public GPT-2 pattern). \s is Unicode white space.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: The same for texts of ASCII alone, in which Python's faster matcher has the same classes.
ASCII_PATTERN = PATTERN.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9").replace(" ?A-Za-z+", " ?[A-Za-z]+").replace(" ?0-9+", " ?[0-9]+")

VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where a public vocabulary file lies; any path may be given instead."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class PreTokens:
    """Splits whole texts into pre-tokens, and special strings, exactly as the tokenizer's file says.

    Only for files with a ByteLevel pre-tokenizer without prefix space and without normalizer: there a pre-token's pieces
    do not depend on what stands beside it.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or pre.get("use_regex") is False:
            raise ValueError(f"{path}: not a plain byte-level file")
        added = spec.get("added_tokens") or []
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added):
            raise ValueError(f"{path}: special strings that take in their surroundings")
        self.special = {t["content"] for t in added}
        self._split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if added else None
        wide, narrow = regex.compile(PATTERN).findall, re.compile(ASCII_PATTERN, re.ASCII).findall
        self._find = lambda text: narrow(text) if text.isascii() else wide(text)

    def __call__(self, text: str) -> list[str]:
        if self._split is None or not any(s in text for s in self.special):
            return self._find(text)
        out: list[str] = []
        for part in self._split.split(text):
            out += [part] if part in self.special else self._find(part)
        return out


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level file: printable Latin-1 for itself, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Pieces(dict):
    """Ids of pre-tokens as bytes, by the library's own byte-pair model; what is looked up first is encoded then."""

    #: Pre-tokens that are kept, and the longest that are worth it.
    ROOM, LENGTH = 1_000_000, 64

    def __init__(self, tokenizer, special: set[str]):
        super().__init__()
        self._whole, self._model, self._special = tokenizer.encode, tokenizer.model.tokenize, special
        of = {b: c for c, b in byte_alphabet().items()}
        self._table = "".join(of[b] for b in range(256))

    def __missing__(self, pre: str) -> bytes:
        if pre in self._special:
            ids = self._whole(pre, add_special_tokens=False).ids
        else:
            ids = [t.id for t in self._model(pre.encode("utf-8").decode("latin-1").translate(self._table))]
        out = np.array(ids, dtype="<u4").tobytes()
        if len(pre) <= self.LENGTH:
            if len(self) >= self.ROOM:
                self.clear()
            self[pre] = out
        return out


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes, equal to the library's encode without added special tokens.

    In a byte-level file a pre-token's pieces don't depend on what stands beside it, so each distinct pre-token goes through
    the library's model once; texts are joined from them. Files of another kind go through the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        self._exact = whole.encode
        try:
            self._split = PreTokens(path)
        except ValueError:
            self._split = None
        else:
            self._piece = _Pieces(whole, self._split.special).__getitem__

    def __call__(self, text: str) -> bytes:
        if self._split is None:
            return np.array(self._exact(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(map(self._piece, self._split(text)))

    def pieces(self, pre: str) -> int:
        """How many ids a pre-token has."""
        return len(self(pre) if self._split is None else self._piece(pre)) // 4


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for all tasks of a worker process."""
    return Encoder(path)

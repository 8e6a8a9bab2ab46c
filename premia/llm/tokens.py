"""Token ids of whole texts by the tokenizers library, with the ids of frequent pieces kept per worker."""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Callable

import numpy as np

from premia.llm.shared import held

#: Pieces of at most PIECE_CHARS characters are kept, about KEPT_PIECES of them, which bounds a worker's memory.
PIECE_CHARS, KEPT_PIECES = 48, 800_000
#: What no rule joins to a following space, letters that no rule changes but by case, and signs that no rule joins to them.
_BLANK = r"[\s\x1c-\x1f\x85\u180e\u200b\ufeff]"
_LETTERS, _SIGNS = "A-Za-zÀ-ÖØ-öø-ÿ", r".,;:!?|&%$#*"
#: Pieces of a text: a word of letters before a space, a line's end or signs; signs before a space or a line's end; a single
#: line's end; else all up to the next space that doesn't follow white space.
_WITH_SPACE = re.compile(rf" ?[{_LETTERS}]+(?=[ \n{_SIGNS}]|\Z)| ?[{_SIGNS}]+(?=[ \n]|\Z)|\n(?!{_BLANK})(?!\Z)| ?(?:[^ ]|(?<={_BLANK}) )+| ")
_BETWEEN_BLANKS = re.compile(rf"[{_LETTERS}]+(?=[ \n{_SIGNS}]|\Z)|[{_SIGNS}]+(?=[ \n]|\Z)|[^ \n]+")
_WORD = re.compile(rf" ?[{_LETTERS}]+")


def public_path(name: str) -> str:
    """Where the public vocabulary file of that name is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, int]:
    """The letter that byte-level vocabularies write for each byte: itself where it can be seen, else one from 256 on."""
    seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in seen]
    return {b: b for b in seen} | {b: 256 + i for i, b in enumerate(hidden)}


class _Kept(dict):
    """Ids by piece, in two generations: the older one goes when the younger is full, so that pieces in use stay."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        self.make, self.older = make, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece) or self.make(piece)
        if len(piece) <= PIECE_CHARS:
            self[piece] = ids
        return ids

    def turn(self) -> None:
        if len(self) > KEPT_PIECES // 2:
            self.older = dict(self)
            self.clear()


class Encoder:
    """Encodes texts with a tokenizers file, without special tokens of its own.

    Where the file's rules never join what stands on both sides of a space, a text's ids are those of its pieces,
    one after the other, so that each piece is encoded once: with byte-level pre-tokenization a piece starts at a
    space that doesn't follow white space; with rules that drop white space it is what stands between blanks. Within
    such a piece, a word of letters, the signs that end it and a single line's end are pieces of their own, as both
    kinds of rules cut there. Other files encode whole texts.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.rule = self._rule(json.load(f))
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.kept = _Kept(self._ids)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.spaced = self.rule is _WITH_SPACE
        self.code = "H" if self.dtype.itemsize == 2 else "I"

    @staticmethod
    def _rule(file: dict) -> re.Pattern | None:
        before, norm = file.get("pre_tokenizer") or {}, file.get("normalizer") or {}
        spaced = any(" " in t["content"] or t["lstrip"] or t["rstrip"] for t in file.get("added_tokens", []))
        if spaced:
            return None
        if before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not norm:
            return _WITH_SPACE
        steps = before.get("pretokenizers", [])
        if not steps or steps[-1].get("type") != "ByteLevel" or steps[-1].get("use_regex"):
            return None
        replaced = [n for n in norm.get("normalizers", []) if n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"}]
        split = steps[0]["type"] == "Split" and steps[0]["behavior"] == "Removed" and steps[0]["invert"]
        if split and replaced and {n["type"] for n in norm["normalizers"]} <= {"NFC", "Replace", "Lowercase"}:
            return _BETWEEN_BLANKS
        return None

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _ids(self, piece: str) -> bytes:
        """Ids of a piece; a word of letters is asked of the library's model itself, which takes its bytes as letters."""
        if not _WORD.fullmatch(piece):
            return self._plain(piece)
        text = piece if self.spaced else piece.lower()
        if not piece.isascii():
            text = text.encode().decode("latin-1")
        found = self.model.tokenize(text.translate(self.letters) if text[0] == " " or not piece.isascii() else text)
        return struct.pack(f"<{len(found)}{self.code}", *[t.id for t in found])

    def encode(self, texts: list[str], end: int) -> list[np.ndarray]:
        """Ids of each text, with the id `end` appended."""
        last = np.array([end], self.dtype).tobytes()
        if self.rule is None:
            return [np.frombuffer(self._plain(x) + last, self.dtype) for x in texts]
        pieces, get = self.rule.findall, self.kept.__getitem__
        found = []
        for text in texts:
            found.append(np.frombuffer(b"".join([*map(get, pieces(text)), last]), self.dtype))
            self.kept.turn()
        return found


def encoder(path: str) -> Encoder:
    """The worker's encoder for that file; later tasks of the worker find its pieces."""
    return held(("encoder", path), lambda: Encoder(path))

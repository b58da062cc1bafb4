"""Normalisation and pre-tokens of the lower-casing word BPE: NFC, white space to one space, lower case, then words.

Texts made only of characters whose NFC, case and class need no tables (Latin, Cyrillic, Han, kana, Hangul, common
punctuation) are split by one regular expression; any other text goes through the library's own normalizer first.
"""

from __future__ import annotations

import functools
import os
import re
import unicodedata

# Characters that NFC leaves alone beside one another, whose lower case is one character, and that are white space
# for every engine or for none.
_SAFE = (
    (0x00, 0x1B), (0x20, 0x7F), (0xA1, 0x12F), (0x131, 0x17F), (0x410, 0x44F), (0x2010, 0x2027), (0x2030, 0x205E),
    (0x20AC, 0x20AC), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3),
)
# Fixed value: the contractions that the tokenizer splits off.
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
SPECIALS = re.compile(r"(<\|startoftext\|>|<\|endoftext\|>)")


def _ranges(first_letter: str) -> str:
    """Character class body of the safe characters whose general category starts with ``first_letter``."""
    out, run = [], None
    for low, high in _SAFE:
        for c in range(low, high + 2):
            inside = c <= high and unicodedata.category(chr(c))[0] == first_letter
            if inside and run is None:
                run = c
            elif not inside and run is not None:
                out.append(f"\\U{run:08x}-\\U{c - 1:08x}")
                run = None
    return "".join(out)


_LETTER, _DIGIT = _ranges("L"), _ranges("N")
_UNSAFE = re.compile("[^" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in _SAFE) + "]")
_WORDS = re.compile(f"{_CONTRACTIONS}|[{_LETTER}]+|[{_DIGIT}]|[^\\t-\\r {_LETTER}{_DIGIT}]+")


@functools.lru_cache(maxsize=4)
def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _decode_table() -> dict[str, int]:
    """Printable stand-in of each byte, by the byte-level rule: printable bytes stand for themselves, others follow 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


BYTE_OF = _decode_table()


def words(text: str, path: str) -> list[str]:
    """Pre-tokens of a text without special strings, as normalised text."""
    if text.isascii() or not _UNSAFE.search(text):
        if not re.search("[\x1c-\x1f]", text):
            return _WORDS.findall(text.lower())
    tok = library(path)
    pieces = tok.pre_tokenizer.pre_tokenize_str(tok.normalizer.normalize_str(text))
    return [bytes(BYTE_OF[c] for c in piece).decode("utf-8", "surrogateescape") for piece, _ in pieces]


def segments(text: str, path: str) -> tuple[list[str], int]:
    """Pre-tokens of a whole text, and how many special strings stand in it (each is one token)."""
    if "<|" not in text:
        return words(text, path), 0
    out: list[str] = []
    parts = SPECIALS.split(text)
    for part in parts[::2]:
        out += words(part, path)
    return out, len(parts) // 2

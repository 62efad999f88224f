"""Word and n-gram hashing for use inside Arrow batches."""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np

_BREAKS = bytes(c for c in range(128) if not chr(c).isalnum())
_TO_BLANK = bytes.maketrans(_BREAKS, b" " * len(_BREAKS))
_RUNS = re.compile(rb"[A-Za-z0-9\x80-\xff]+|[^\sA-Za-z0-9\x80-\xff]+")


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(crc32, words), np.uint32, len(words))


def plain_words(text: str | None) -> list[bytes]:
    """Lower-case words in UTF-8, cut at blanks and ASCII punctuation."""
    return (text or "").lower().encode("utf-8", "replace").translate(_TO_BLANK).split()


def blank_words(text: str | None) -> list[bytes]:
    """Lower-case words in UTF-8, cut at blanks only."""
    return " ".join((text or "").lower().split()).encode("utf-8", "replace").split(b" ") if text and not text.isspace() else []


def runs(text: str | None) -> list[bytes]:
    """Lower-case runs of word characters and runs of symbols, in UTF-8."""
    return _RUNS.findall((text or "").lower().encode("utf-8", "replace"))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit mixing hash, elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def ngrams(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all runs of n words."""
    w = word_hashes.astype(np.uint64)
    out = np.zeros(max(0, len(w) - n + 1), np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + w[i : i + len(out)]
    return mix(out)

"""Hashed character n-grams as numpy arrays."""

from __future__ import annotations

import re

import numpy as np

from tessera.llm.common import by_value

by_value(__name__)

_NOT_LETTERS = re.compile(r"[\W\d_]+")
_MULTIPLIERS = (2654435761, 2246822519, 3266489917, 668265263)


def letters_only(text: str) -> str:
    """Lower case, with every run of other characters as one space; empty if there is no letter."""
    bare = _NOT_LETTERS.sub(" ", text.lower()).strip()
    return f" {bare} " if any(c.isalpha() for c in bare) else ""


def ngram_slots(text: str, longest: int, bits: int) -> np.ndarray:
    """Slots below ``2 ** bits`` of all n-grams of 1 to ``longest`` code points, with repeats."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    found, shift = [], np.uint32(32 - bits)
    for n in range(1, min(longest, len(codes)) + 1):
        size = len(codes) - n + 1
        mixed = np.full(size, 0x9E3779B1 * n & 0xFFFFFFFF, dtype=np.uint32)
        for j in range(n):
            mixed = (mixed ^ codes[j : j + size]) * np.uint32(_MULTIPLIERS[j])
            mixed ^= mixed >> np.uint32(15)
        found.append((mixed * np.uint32(2654435769)) >> shift)
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint32)

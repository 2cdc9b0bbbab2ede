"""Anchors of a covering code for pieces of fingerprints.

The binary Golay code of length 23 is perfect: every 23-bit word lies within 3 bits of
exactly one of its 4,096 code words. Two words that differ in ``slack`` bits or fewer
therefore meet at the first one's anchor, if each word is put to every anchor within
``3 + slack`` bits.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

LENGTH, RADIUS = 23, 3
#: Fixed value: the code's generator polynomial, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def remainder(word: int) -> int:
    """The word's syndrome: its polynomial's remainder by the generator."""
    while word.bit_length() > 11:
        word ^= GENERATOR << (word.bit_length() - 12)
    return word


@cache
def _tables(slack: int) -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of byte values at each byte place, and the error words of each
    syndrome up to the weight ``RADIUS + slack``, lightest first, filled up with -1."""
    places = np.array([[remainder(byte << shift) for byte in range(256)] for shift in (0, 8, 16)])
    errors: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(RADIUS + slack + 1):
        for bits in combinations(range(LENGTH), weight):
            word = sum(1 << bit for bit in bits)
            errors[remainder(word)].append(word)
    width = max(map(len, errors))
    return places, np.array([e + [-1] * (width - len(e)) for e in errors], np.int64)


def anchors(words: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(index, anchor, home)`` of every word's anchors within ``RADIUS + slack``.

    ``home`` marks the word's nearest anchor, of which there is one.
    """
    places, errors = _tables(slack)
    words = words.astype(np.int64)
    syndrome = places[0][words & 255] ^ places[1][(words >> 8) & 255] ^ places[2][(words >> 16) & 255]
    found = errors[syndrome]
    index, place = np.nonzero(found >= 0)
    return index, words[index] ^ found[index, place], place == 0

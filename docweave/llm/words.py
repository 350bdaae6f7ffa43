"""Words of many texts at once, as 64-bit hashes.

Both word rules here are decided by single ASCII bytes, so they hold on the UTF-8 bytes as they do
on code points. A word's hash is a polynomial over its bytes modulo 2**64, taken from running sums
over a whole run of texts, then mixed; there is no Python step per word.
"""

from __future__ import annotations

import numpy as np

from docweave.llm.common import spans_of_rows

_P = 0x9E3779B97F4A7C55 | 1
_P_INV = pow(_P, -1, 1 << 64)
#: Bytes worked on at once, unless one word is longer.
STEP = 1 << 19
_powers: dict[int, np.ndarray] = {}


def _rule(separators) -> tuple[np.ndarray, np.ndarray]:
    word = np.ones(256, bool)
    word[list(separators)] = False
    value = np.arange(256, dtype=np.uint64)
    value[65:91] += np.uint64(32)  # A-Z
    return word, value + np.uint64(1)


#: `[^\x20\x09-\x0D]+` of the text with A-Z lower-cased.
SPACED = _rule([0x20, *range(0x09, 0x0E)])
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of the text with A-Z lower-cased (so A-Z are word bytes).
ALNUM = _rule([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finisher."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, STEP), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def _piece(data: np.ndarray, breaks: np.ndarray, rule) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word; breaks: places where a text begins."""
    word, value = rule
    inside = word[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[breaks] = False
    starts = np.flatnonzero(inside & ~before)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[breaks[breaks > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value[data] * _power(_P, len(data)), out=sums[1:])
    h = (sums[ends + 1] - sums[starts]) * _power(_P_INV, len(data))[starts]
    return mix(h + (ends - starts + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), starts


def word_hashes(data: np.ndarray, offsets: np.ndarray, rule) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows, in order, and the row offsets among them."""
    hashes, counts = [], np.zeros(len(offsets) - 1, np.int64)
    for first, end in spans_of_rows(offsets, STEP):
        low, high = int(offsets[first]), int(offsets[end])
        if high - low <= STEP or end - first > 1:
            if high == low:
                continue
            own = offsets[first:end] - low
            h, starts = _piece(data[low:high], own[own < high - low], rule)
            hashes.append(h)
            counts[first:end] = np.diff(np.searchsorted(starts, offsets[first : end + 1] - low))
            continue
        while low < high:  # one long text: pieces that end after a separator
            stop = min(low + STEP, high)
            while stop < high and rule[0][data[stop - 1]]:
                gaps = np.flatnonzero(~rule[0][data[low:stop]])
                if len(gaps):
                    stop = low + int(gaps[-1]) + 1
                else:
                    stop = min(stop + STEP, high)
            h, _ = _piece(data[low:stop], np.zeros(1, np.int64), rule)
            hashes.append(h)
            counts[first] += len(h)
            low = stop
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(counts)])

"""Word shingles of whole texts, and their ProbMinHash sketches, a slice of texts at a time."""

from __future__ import annotations

import numpy as np

from adjudica.llm import textbatch
from adjudica.llm.textbatch import mixed

WORDS = 5
#: A shingle's id has 56 bits: the upper 8 of the sort key number the text within its slice.
ID_BITS = np.uint64(56)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def distinct_shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle id, count), sorted: the distinct shingles of each text.

    Words are runs of letters and digits in lower case. A text of one to four words has one shingle
    of all its words; a text without words has none.
    """
    points, owner = textbatch.code_points([t.lower() for t in texts])
    starts, ends = textbatch.runs_of(textbatch.table_of("isalnum")[points])
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes, of_word = textbatch.run_hashes(points, starts, ends), owner[starts]
    words = np.bincount(of_word, minlength=len(texts))
    ends_at = np.cumsum(words)
    place = np.arange(len(hashes)) - (ends_at - words)[of_word]
    first = np.flatnonzero(place <= np.maximum(words[of_word] - WORDS, 0))
    with np.errstate(over="ignore"):
        total = np.zeros(len(first), np.uint64)
        for k in range(WORDS):
            at = first + k
            inside = at < ends_at[of_word[first]]
            part = mixed(hashes[np.minimum(at, len(hashes) - 1)] + _STEP * np.uint64(k + 1))
            total += np.where(inside, part, np.uint64(0))
        ids = mixed(total) >> (np.uint64(64) - ID_BITS)
    key = (of_word[first].astype(np.uint64) << ID_BITS) | ids
    key.sort()
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    counts = np.diff(np.append(at, len(key)))
    key = key[at]
    return (key >> ID_BITS).astype(np.int64), key & ((np.uint64(1) << ID_BITS) - np.uint64(1)), counts


def prob_min_hash(
    n_texts: int, owner: np.ndarray, ids: np.ndarray, weights: np.ndarray, registers: int
) -> np.ndarray:
    """ProbMinHash sketches: for each text and register, the shingle that arrives there first.

    Every shingle has its own stream of arrivals, a Poisson process whose rate is its weight; each
    arrival falls on a random register. Two texts agree on a register with the probability Jaccard
    similarity of their weighted shingles. A shingle's stream ends when its next arrival is later
    than the last of the first arrivals of its text. Later rounds draw more arrivals at a time, so
    that texts with few shingles fill their registers in few rounds.
    """
    first = np.full(n_texts * registers, np.inf)
    winner = np.zeros(n_texts * registers, np.uint64)
    active = np.arange(len(ids))
    clock = np.zeros(len(ids))
    drawn, width = 0, 1
    with np.errstate(over="ignore"):
        streams = mixed(ids * _STEP + np.uint64(1))
        while len(active):
            draws = np.arange(drawn + 1, drawn + width + 1, dtype=np.uint64) * _STEP
            bits = mixed(streams[active][:, None] + draws[None, :])
            gaps = -np.log1p(-((bits >> np.uint64(11)).astype(float) * 2.0**-53))
            times = clock[:, None] + np.cumsum(gaps, axis=1) / weights[active][:, None]
            place = (mixed(bits) >> np.uint64(32)).astype(np.int64) * registers >> 32
            cell = (owner[active][:, None] * registers + place).ravel()
            when = times.ravel()
            np.minimum.at(first, cell, when)
            won = first[cell] == when
            winner[cell[won]] = np.repeat(ids[active], width)[won]
            last = first.reshape(n_texts, registers).max(axis=1)
            on = times[:, -1] < last[owner[active]]
            active, clock = active[on], times[on, -1]
            drawn += width
            width = min(2 * width if drawn > 1 else 1, 64)
    return winner.reshape(n_texts, registers)


def band_keys(sketches: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per text and band: equal where all of the band's registers agree."""
    rows = sketches.shape[1] // bands
    parts = sketches[:, : bands * rows].reshape(len(sketches), bands, rows)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=np.uint64)), parts.shape[:2])
        for r in range(rows):
            key = mixed(key * _STEP + parts[:, :, r])
    return key.view(np.int64)


def set_digests(n_texts: int, owner: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """128 bits per text that tell its set of shingles, as two 64-bit numbers."""
    out = np.zeros((n_texts, 2), np.uint64)
    if len(ids):
        at = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        with np.errstate(over="ignore"):
            out[owner[at], 0] = np.add.reduceat(mixed(ids + np.uint64(1)), at)
            out[owner[at], 1] = np.add.reduceat(mixed(ids ^ _STEP), at)
    return out.view(np.int64)


def odd_sketches(n_texts: int, owner: np.ndarray, ids: np.ndarray, bits: int) -> np.ndarray:
    """Per text, ``bits`` bits that tell whether an odd number of its shingles falls on each.

    The bits in which two texts differ are at most as many as the shingles in which they differ.
    """
    at = owner * bits + (ids % np.uint64(bits)).astype(np.int64)
    odd = (np.bincount(at, minlength=n_texts * bits) & 1).astype(np.uint8).reshape(n_texts, bits)
    return np.packbits(odd, axis=1).view(np.int64)

"""Hashes of words and of word runs for many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_RANDOM = np.random.Generator(np.random.PCG64(11))
_BYTE = _RANDOM.integers(0, 1 << 64, 256, dtype=np.uint64)
_PLACE = _RANDOM.integers(0, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _RANDOM.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\v\f\r")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = _BYTE[_LOWER]  # A-Z hash like a-z
BLOCK_BYTES = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit integers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_blocks(texts: Iterable[bytes]) -> Iterator[list[bytes]]:
    """Consecutive texts in blocks of about a megabyte; a longer text is a block of its own."""
    block, held = [], 0
    for data in texts:
        if block and held + len(data) > BLOCK_BYTES:
            yield block
            block, held = [], 0
        block.append(data)
        held += len(data)
    if block:
        yield block


def text_blocks(texts: Iterable[str]) -> Iterator[list[bytes]]:
    return byte_blocks(text.encode() for text in texts)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (run of bytes without white space, A-Z as a-z), and the number of words of each text."""
    raw = np.frombuffer(b"\n".join(texts), np.uint8)
    ink = ~_SPACE[raw]
    starts = np.flatnonzero(ink & np.concatenate(([True], ~ink[:-1])))
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, offsets))
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    inked = raw[ink]
    first = (np.cumsum(ink) - 1)[starts]  # the word's place among inked bytes
    lengths = np.diff(first, append=len(inked))
    place = np.arange(len(inked)) - np.repeat(first, lengths)
    sums = np.add.reduceat(_BYTE[inked] * _PLACE[place & 4095], first)
    return mixed(sums + lengths.astype(np.uint64) * _STEP[0]), counts


def run_hashes(words: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``n`` words inside a text, and the runs of each text."""
    made = np.maximum(counts - (n - 1), 0)
    total = len(words) - (n - 1)
    if total <= 0:
        return np.zeros(0, np.uint64), made
    out = np.zeros(total, np.uint64)
    for k in range(n):
        out += words[k:k + total] * _STEP[k + 1]
    ends = np.cumsum(counts)
    at = np.arange(total)
    text = np.searchsorted(ends, at, side="right")
    return mixed(out[at + n <= ends[text]] + np.uint64(n)), made


def shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ``n``-word shingles of each text: sorted hashes, how often each occurs, and how many there are.

    A text of fewer words has one shingle, all its words; a text without words has none.
    """
    words, counts = word_hashes(texts)
    runs, made = run_hashes(words, counts, n)
    short = np.flatnonzero((counts > 0) & (counts < n))
    owner = np.repeat(np.arange(len(texts)), made)
    if len(short):
        starts = np.cumsum(counts) - counts
        whole = [mixed((words[starts[i]:starts[i] + counts[i]] * _STEP[1:counts[i] + 1]).sum(keepdims=True) + np.uint64(counts[i]))
                 for i in short]
        runs, owner = np.concatenate([runs, *whole]), np.concatenate([owner, short])
    order = np.lexsort((runs, owner))
    runs, owner = runs[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], (runs[1:] != runs[:-1]) | (owner[1:] != owner[:-1])))) if len(runs) else order
    return runs[first], np.diff(first, append=len(runs)), np.bincount(owner[first], minlength=len(texts))

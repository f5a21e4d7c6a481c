"""First 32 bits of the MD5 of texts put together from two parts, for many pairs of parts at a time.

A message is a head and a tail. What depends on the head alone is computed once for each head: the state after its whole blocks, and the
steps of the next block up to the first word that the tail touches. What is left for a pair are the steps of the blocks with the tail in
them; where there are several, the first of them is shared by neighbouring pairs of the same head whose tails begin alike. All of it runs step by
step over arrays, one message a lane.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

#: Messages that run at a time: enough to make the calls cheap, few enough to stay in a core's cache.
LANES = 32768
BLOCK = 64
U = np.uint32
MASK = 2**32 - 1
SINES = [int(abs(math.sin(i + 1)) * 2**32) & MASK for i in range(64)]
TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
PLACES = [*range(16), *((5 * i + 1) % 16 for i in range(16, 32)), *((3 * i + 5) % 16 for i in range(32, 48)), *((7 * i) % 16 for i in range(48, 64))]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: After this step the first register has its last value.
LAST = 61


def _steps(registers: list[np.ndarray], words: list, first: int, last: int) -> list[np.ndarray]:
    """Steps ``first`` to ``last - 1`` of a block, in place. A word is an array, or a number that all messages share."""
    a, b, c, d = registers
    t, s = np.empty_like(a), np.empty_like(a)
    for i in range(first, last):
        if i < 16:
            np.bitwise_xor(c, d, out=t)
            np.bitwise_and(t, b, out=t)
            np.bitwise_xor(t, d, out=t)
        elif i < 32:
            np.bitwise_xor(b, c, out=t)
            np.bitwise_and(t, d, out=t)
            np.bitwise_xor(t, c, out=t)
        elif i < 48:
            if i % 2 == 0:
                np.bitwise_xor(b, c, out=s)  # the next step's c ^ d
                np.bitwise_xor(s, d, out=t)
            else:
                np.bitwise_xor(s, b, out=t)
        else:
            np.invert(d, out=t)
            np.bitwise_or(t, b, out=t)
            np.bitwise_xor(t, c, out=t)
        np.add(a, t, out=a)
        word, added = words[PLACES[i]], SINES[i]
        if isinstance(word, int):
            added = (added + word) & MASK
        else:
            np.add(a, word, out=a)
        np.add(a, np.array(added, U), out=a)
        np.left_shift(a, np.array(TURNS[i], U), out=t)
        np.right_shift(a, np.array(32 - TURNS[i], U), out=a)
        np.bitwise_or(a, t, out=a)
        np.add(a, b, out=a)
        a, b, c, d = d, a, b, c
    return [a, b, c, d]


def _columns(matrix: np.ndarray) -> list:
    """The words of rows of bytes, column by column; a number where all rows have the same."""
    words = np.ascontiguousarray(matrix).view("<u4")
    return [int(w[0]) if (w == w[0]).all() else np.ascontiguousarray(w, dtype=U) for w in words.T] if len(words) else []


def _at(word, rows: np.ndarray):
    return word if isinstance(word, int) else word.take(rows)


class Heads:
    """Beginnings of messages, all of one length: rows of bytes."""

    def __init__(self, rows: np.ndarray):
        count, self.length = rows.shape
        self.rest = self.length % BLOCK  # bytes in the block that the tail goes on in
        self.state: list = list(START)
        for k in range(self.length // BLOCK):
            words = _columns(rows[:, k * BLOCK : (k + 1) * BLOCK])
            before = [np.full(count, x, U) if isinstance(x, int) else x for x in self.state]
            self.state = [x + y for x, y in zip(before, _steps([x.copy() for x in before], words, 0, 64))]
        last = np.zeros((count, BLOCK), np.uint8)
        last[:, : self.rest] = rows[:, self.length - self.rest :]
        self.words = _columns(last)
        self.done = self.rest // 4  # steps that no tail takes part in
        begun = [np.full(count, x, U) if isinstance(x, int) else x.copy() for x in self.state]
        self.begun = _steps(begun, self.words, 0, self.done)


class Tails:
    """Ends of messages that fill ``blocks`` blocks behind heads with ``heads.rest`` bytes in the first of them."""

    def __init__(self, heads: Heads, rows: np.ndarray, lengths: np.ndarray, blocks: int):
        count, widest = len(rows), min(rows.shape[1], blocks * BLOCK - heads.rest)
        matrix = np.zeros((count, blocks * BLOCK), np.uint8)
        matrix[:, heads.rest : heads.rest + widest] = rows[:, :widest]
        matrix[np.arange(count), heads.rest + lengths] = 0x80
        bits = ((heads.length + lengths) * 8).astype("<u8")
        matrix[:, -8:] = bits.view(np.uint8).reshape(count, 8)
        self.blocks = blocks
        self.words = _columns(matrix)
        self.begin = None
        if blocks > 1:
            first = matrix[:, :BLOCK]
            self.begin = np.concatenate(([0], np.cumsum((first[1:] != first[:-1]).any(axis=1))))


def blocks_of(heads: Heads, lengths: np.ndarray) -> np.ndarray:
    """How many blocks the ends of these lengths fill."""
    return (heads.rest + lengths + 8) // BLOCK + 1


def digests(heads: Heads, tails: Tails, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each pair of a head i and a tail j, the first 32 bits of the message's MD5 as a number. At most LANES pairs."""

    def mixed(i: np.ndarray, j: np.ndarray, last: int) -> list[np.ndarray]:
        words = []
        for k in range(16):
            if k < heads.done:
                words.append(_at(heads.words[k], i))
            elif k == heads.done and heads.rest % 4:
                words.append(_at(heads.words[k], i) | _at(tails.words[k], j))
            else:
                words.append(_at(tails.words[k], j))
        return _steps([x.take(i) for x in heads.begun], words, heads.done, last)

    if tails.blocks == 1:
        first, own = mixed(i, j, LAST)[1], _at(heads.state[0], i)
    else:
        begin = tails.begin.take(j)
        new = np.concatenate(([True], (i[1:] != i[:-1]) | (begin[1:] != begin[:-1])))
        at, run = np.flatnonzero(new), np.cumsum(new) - 1
        ended = mixed(i[at], j[at], 64)
        state = [(x + np.array(y, U) if isinstance(y, int) else x + y.take(i[at])).take(run) for x, y in zip(ended, (heads.state))]
        for block in range(1, tails.blocks):
            words = [_at(w, j) for w in tails.words[16 * block : 16 * block + 16]]
            if block == tails.blocks - 1:
                first, own = _steps([x.copy() for x in state], words, 0, LAST)[1], state[0]
            else:
                state = [x + y for x, y in zip(state, _steps([x.copy() for x in state], words, 0, 64))]
    return (first + (np.array(own, U) if isinstance(own, int) else own)).byteswap()


def padded(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts, given one after the other, as rows of bytes that end in zeros, and their lengths."""
    lengths = np.diff(offsets).astype(np.int64)
    rows = np.zeros((len(lengths), int(lengths.max(initial=0))), np.uint8)
    rows[np.arange(rows.shape[1]) < lengths[:, None]] = data[offsets[0] : offsets[-1]]
    return rows, lengths


def in_lanes(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same pairs, LANES at a time."""
    waiting, count = [], 0
    for pair in pairs:
        waiting.append(pair)
        count += len(pair[0])
        if count >= LANES:
            i, j = (np.concatenate(x) for x in zip(*waiting))
            whole = count - count % LANES
            for k in range(0, whole, LANES):
                yield i[k : k + LANES], j[k : k + LANES]
            waiting, count = [(i[whole:], j[whole:])], count - whole
    if count:
        yield tuple(np.concatenate(x) for x in zip(*waiting))

"""Static range asymmetric numeral system (rANS) over numpy arrays: many interleaved states at once.

A segment is one byte string: header, one frequency table, documents, a checkpoint per block, and the
coded words. All blocks share the table but start from their own states, so any block can be decoded
without the others. Within a block, token i belongs to state i mod `LANES`; all states of all blocks
advance together, one numpy operation per step.

Layout, little-endian: MAGIC; u32 symbols, documents, blocks, steps; u64 tokens; u32 crc of all else;
then u32 symbol[symbols], u32 frequency[symbols]; i64 document id, u8 id is null, u32 length, each
[documents]; u64 state[blocks][LANES]; u32 words up to the end of each block; u32 crc of each block's
ids; u32 words.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

MAGIC = b"rANS\x01\x00\x00\x00"
HEADER = struct.Struct("<8sIIIIQ")
CHECK = struct.Struct("<I")
SCALE = 20
LANES = 128
BLOCK_TOKENS = 1 << 16
LOW = np.uint64(1 << 31)

_SCALE = np.uint64(SCALE)
_WORD = np.uint64(32)
_SLOT = np.uint64((1 << SCALE) - 1)


class CorruptSegment(ValueError):
    """A segment whose checksums, sizes or final states do not agree."""


@dataclass(frozen=True)
class Documents:
    ids: np.ndarray
    null: np.ndarray
    lengths: np.ndarray


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of 2**SCALE, none of them 0."""
    if len(counts) > 1 << SCALE:
        raise ValueError(f"more than {1 << SCALE} different ids in one segment")
    spare = (1 << SCALE) - len(counts)
    scaled = 1 + counts * spare // counts.sum()
    scaled[np.argmax(counts)] += (1 << SCALE) - scaled.sum()
    return scaled.astype(np.uint64)


def _count(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different ids in order, the place of each id among them, and their counts."""
    if int(ids.max()) > 1 << 22:
        return np.unique(ids, return_inverse=True, return_counts=True)
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    place = np.zeros(len(counts), np.int32)
    place[symbols] = np.arange(len(symbols))
    return symbols, place[ids], counts[symbols]


def encode(ids: np.ndarray, documents: Documents) -> bytes:
    """One segment with the ids (uint32, at least one) of some documents."""
    symbols, which, counts = _count(ids)
    freq = frequencies(counts)
    cum = np.cumsum(freq) - freq
    blocks = -(-len(ids) // BLOCK_TOKENS)
    steps = -(-len(ids) // (blocks * LANES))
    # The last places of the last block repeat the most frequent id; the token count leaves them out.
    grid = np.full(blocks * steps * LANES, np.argmax(counts), np.int32)
    grid[: len(ids)] = which
    crcs = [zlib.crc32(x.astype("<u4").tobytes()) for x in _blocks(ids, steps)]
    crcs += [0] * (blocks - len(crcs))
    grid = grid.reshape(blocks, steps, LANES)
    state = np.full((blocks, LANES), LOW, np.uint64)
    words = np.empty((blocks, steps, LANES), np.uint32)
    emitted = np.empty((blocks, steps, LANES), bool)
    top = np.uint64(63 - SCALE)
    for t in range(steps - 1, -1, -1):
        f = freq[grid[:, t]]
        full = state >= f << top
        words[:, t] = state  # the low 32 bits
        emitted[:, t] = full
        state = np.where(full, state >> _WORD, state)
        whole, rest = np.divmod(state, f)
        state = (whole << _SCALE) + rest + cum[grid[:, t]]
    body = b"".join(
        [
            symbols.astype("<u4").tobytes(),
            freq.astype("<u4").tobytes(),
            documents.ids.astype("<i8").tobytes(),
            documents.null.astype("u1").tobytes(),
            documents.lengths.astype("<u4").tobytes(),
            state.astype("<u8").tobytes(),
            np.cumsum(emitted.sum(axis=(1, 2))).astype("<u4").tobytes(),
            np.array(crcs, "<u4").tobytes(),
            words[emitted].astype("<u4").tobytes(),
        ]
    )
    head = HEADER.pack(MAGIC, len(symbols), len(documents.ids), blocks, steps, len(ids))
    return head + CHECK.pack(zlib.crc32(body, zlib.crc32(head))) + body


def _blocks(ids: np.ndarray, steps: int) -> list[np.ndarray]:
    size = steps * LANES
    return [ids[i : i + size] for i in range(0, len(ids), size)]


class Segment:
    """A segment read back; `tokens(a, b)` decodes only the blocks that hold tokens a to b."""

    def __init__(self, data: bytes):
        at = HEADER.size + CHECK.size
        if len(data) < at:
            raise CorruptSegment("shorter than its header")
        magic, symbols, documents, blocks, steps, self.n_tokens = HEADER.unpack_from(data)
        (crc,) = CHECK.unpack_from(data, HEADER.size)
        head = zlib.crc32(memoryview(data)[: HEADER.size])
        if magic != MAGIC or zlib.crc32(memoryview(data)[at:], head) != crc:
            raise CorruptSegment("not a segment, or changed since it was written")

        def read(kind: str, n: int) -> np.ndarray:
            nonlocal at
            values = np.frombuffer(data, kind, n, at)
            at += values.nbytes
            return values

        self.steps = steps
        self.symbols = read("<u4", symbols)
        self.freq = read("<u4", symbols).astype(np.uint64)
        self.cum = np.cumsum(self.freq) - self.freq
        self.documents = Documents(
            read("<i8", documents), read("u1", documents).astype(bool), read("<u4", documents)
        )
        self.states = read("<u8", blocks * LANES).reshape(blocks, LANES)
        self.ends = np.concatenate([[0], read("<u4", blocks)]).astype(np.int64)
        self.crcs = read("<u4", blocks)
        self.words = read("<u4", int(self.ends[-1]))

    def tokens(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """Tokens `first` to `last` (not included)."""
        last = self.n_tokens if last is None else min(last, self.n_tokens)
        if first >= last:
            return np.empty(0, np.uint32)
        size = self.steps * LANES
        a, b = first // size, -(-last // size)
        kind = np.uint16 if len(self.symbols) <= 1 << 16 else np.uint32
        slots = np.repeat(np.arange(len(self.symbols), dtype=kind), self.freq.astype(np.int64))
        state = self.states[a:b].astype(np.uint64)
        at = self.ends[a:b, None].copy()
        out = np.empty((b - a, self.steps, LANES), np.uint32)
        for t in range(self.steps):
            slot = state & _SLOT
            which = slots[slot]
            out[:, t] = which
            state = self.freq[which] * (state >> _SCALE) + slot - self.cum[which]
            need = state < LOW
            place = at + np.cumsum(need, axis=1) - 1
            more = self.words[np.where(need, place, 0)] if len(self.words) else np.uint64(0)
            state = np.where(need, state << _WORD | more, state)
            at = at + need.sum(axis=1, keepdims=True)
        if (state != LOW).any() or (at[:, 0] != self.ends[a + 1 : b + 1]).any():
            raise CorruptSegment("a block does not end in its first state")
        ids = self.symbols[out.reshape(-1)][: self.n_tokens - a * size]
        for block, crc in zip(_blocks(ids, self.steps), self.crcs[a:b], strict=False):
            if zlib.crc32(block.astype("<u4").tobytes()) != crc:
                raise CorruptSegment("ids of a block do not match their checksum")
        return ids[first - a * size : last - a * size]

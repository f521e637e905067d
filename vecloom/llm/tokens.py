"""Token ids of texts by the `tokenizers` library, with a bounded memo of text chunks.

A text is cut before each run of plain white space that follows other characters. No token of the
supported tokenizers reaches over such a place, so chunks can be encoded on their own, and a chunk met
before needs no second encoding. Texts with other white space are encoded whole.

For a tokenizer that lower-cases text and drops white space, chunks are lower-cased words, so that a
word is encoded once for all its spellings and places. Added tokens that the library finds in the text
as it is are told apart from other spellings: a text with such a spelling is encoded whole.
"""

from __future__ import annotations

import gc
import json
import os
import re
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from tokenizers import Tokenizer  # noqa: E402

#: Chunks that a worker remembers; later ones are encoded anew in each batch.
MEMO_CHUNKS = 1_000_000

#: Longer chunks are not remembered.
MEMO_CHARS = 64

#: Characters of text that are encoded together.
BATCH_CHARS = 3_000_000

_CHUNK = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+\Z")

#: Characters that this module's cuts and the tokenizers' rules might take for white space differently,
#: and the mark that keys use.
_ODD = "\x00\x0b\x0c\x1c\x1d\x1e\x1f"
_ODD_WIDE = "".join(
    map(chr, [0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200E), 0x2028, 0x2029, 0x202F, 0x205F])
) + "\u2060\u3000\ufeff"

#: Pairs and characters of white space that are not one space or new line between other characters.
_LOOSE = ("  ", "\n\n", " \n", "\n ", "\t", "\r")


#: Marks that are tokens apart from a letter or digit before them, if that is Latin. Normal forms of other
#: letters, and the lower case of the dotted capital I, can end in an accent, which joins the marks.
_MARKS = ".,;:!?"
_ENDS_IN_MARK = "[.,;:!?]$"


def _is_latin(letter: str) -> bool:
    return letter.isalnum() and letter < "\u0180" and letter != "\u0130"


def _has(text: str, characters: str) -> bool:
    return any(c in text for c in characters)


def _is_odd(text: str) -> bool:
    return _has(text, _ODD) or (not text.isascii() and _has(text, _ODD_WIDE))


#: Latin letters, without the two signs among them.
_LATIN = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]"
_LATIN_WORD = re.compile(f"{_LATIN}+")


def _byte_chars() -> dict[int, str]:
    """The printable character that byte-level tokenizers write for each byte: itself if it is printable in
    Latin-1, else the next one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_BYTE_CHARS = _byte_chars()


def _is_byte_level(rules: dict) -> bool:
    """Whether a tokenizer cuts text by the byte-level rules alone, which keep a space and the letters after
    it together, before its byte-pair model."""
    cuts = rules["pre_tokenizer"] or {}
    plain = cuts.get("type") == "ByteLevel" and cuts.get("use_regex", True) and not cuts["add_prefix_space"]
    return plain and rules["normalizer"] is None and rules["model"]["type"] == "BPE"


def _is_loose(text: str) -> bool:
    return text[0] in " \n" or text[-1] in " \n" or any(x in text for x in _LOOSE)


def _room(array: np.ndarray, size: int) -> np.ndarray:
    """`array`, made longer if it has no room for `size` values."""
    if size <= len(array):
        return array
    return np.concatenate([array, np.zeros(max(size - len(array), len(array)), array.dtype)])


@contextmanager
def _no_collection():
    """Encoding makes very many small objects and no cycles, so looking for cycles meanwhile is lost work."""
    enabled = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if enabled:
            gc.enable()


class Encoder:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        self.folds = "Lowercase" in json.dumps(rules["normalizer"]) and all(
            self._ids(f"{space}a{space}B") == self._ids("a b") for space in " \t\n\r"
        )
        self.exact = [t["content"] for t in rules["added_tokens"] if not t["normalized"]]
        self.model = self.tokenizer.model if _is_byte_level(rules) else None
        self.memo: dict[str, int] = {}
        self.used = 0
        self.flat = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 14, np.int64)
        self.count = np.zeros(1 << 14, np.int64)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _keys(self, text: str) -> list[str]:
        """The chunks of a text as keys of the memo.

        Most chunks follow one space, and their key leaves it out; a chunk that begins with a new line
        is its own key; any other has a mark before it. A tokenizer that folds takes words as keys.
        """
        if _is_odd(text):
            return ["\0" + text]
        if self.folds:
            folded = text.lower() if text.isascii() else text.encode().lower().decode()
            if any(folded.count(t) != text.count(t) for t in self.exact):
                return ["\0" + text]
            return folded.split()
        if not text or _is_loose(text):
            return [self._key(chunk) for chunk in _CHUNK.findall(text)]
        keys = text.replace("\n", " \n").split(" ")
        keys[0] = "\0" + keys[0]
        return keys

    @staticmethod
    def _key(chunk: str) -> str:
        if chunk[0] == "\n":
            return chunk
        one_space = chunk[0] == " " and chunk[1:2] not in ("", " ", "\n", "\t", "\r")
        return chunk[1:] if one_space else "\0" + chunk

    def _chunk(self, key: str) -> str:
        if key[:1] == "\0":
            return key[1:]
        return key if self.folds or key[:1] == "\n" else " " + key

    def _add(self, keys: list[str], rows: list[list[int]]) -> None:
        """Number new keys in the memo, with their ids."""
        counts = np.fromiter(map(len, rows), np.int64, len(rows))
        ids = np.fromiter(chain.from_iterable(rows), np.uint32, int(counts.sum()))
        self._append(keys, ids, counts)

    def _add_words(self, words: list[str]) -> None:
        """Number new words of letters only, which follow a space. Each is one piece to the library's rules,
        so its byte-pair model gets it straight away."""
        tokenize = self.model.tokenize
        found = [tokenize(f" {w}".encode().decode("latin-1").translate(_BYTE_CHARS)) for w in words]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter((t.id for tokens in found for t in tokens), np.uint32, int(counts.sum()))
        self._append(words, ids, counts)

    def _append(self, keys: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        known, new = len(self.memo), len(keys)
        end = self.used + len(ids)
        self.start = _room(self.start, known + new)
        self.count = _room(self.count, known + new)
        self.flat = _room(self.flat, end)
        self.start[known : known + new] = self.used + np.cumsum(counts) - counts
        self.count[known : known + new] = counts
        self.flat[self.used : end] = ids
        self.memo.update(zip(keys, range(known, known + new), strict=True))
        self.used = end

    def _learn(self, keys: list[str], may_end: list[str]) -> None:
        """Encode new keys, both those of `keys` and of `may_end`. Sentence marks that end a word are tokens
        of their own, so a key of the latter that is a word with such marks is put together from both."""
        ended = {}
        for key in may_end:
            word = key.rstrip(_MARKS)
            if len(word) < len(key) and word and _is_latin(word[-1]):
                ended[key] = word, key[len(word) :] if self.folds else "\0" + key[len(word) :]
        needed = set(keys).union(may_end).difference(ended)
        needed.update(chain.from_iterable(ended.values()))
        needed.difference_update(self.memo)
        if self.model:
            words = list(filter(_LATIN_WORD.fullmatch, needed))
            self._add_words(words)
            needed.difference_update(words)
        others = list(needed)
        encoded = self.tokenizer.encode_batch_fast(list(map(self._chunk, others)), add_special_tokens=False)
        self._add(others, [x.ids for x in encoded])
        if ended:
            self._join(ended)

    def _join(self, ended: dict[str, tuple[str, str]]) -> None:
        """Number keys whose ids are those of two other keys, one after the other."""
        joined = list(ended)
        both = chain.from_iterable(map(ended.__getitem__, joined))
        parts = np.fromiter(map(self.memo.__getitem__, both), np.int64, 2 * len(joined))
        ids = self._gather(parts)[0]
        counts = self.count[parts].reshape(-1, 2).sum(axis=1)
        self._append(joined, ids, counts)

    def _gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the keys with these numbers, one after the other, and where each ends."""
        counts = self.count[which]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        places = np.repeat(self.start[which] - (ends - counts), counts)
        places += np.arange(total)
        return self.flat[places], ends

    def _forget(self, known: int, used: int) -> None:
        """Drop the keys that were added last, down to `known` of them."""
        while len(self.memo) > known:
            self.memo.popitem()
        self.used = used

    def _group(self, texts: list[str]) -> list[np.ndarray]:
        if self.folds:
            return self._group_by_keys(texts)
        plain = [bool(text) and not _is_odd(text) and not _is_loose(text) for text in texts]
        with _no_collection():
            split = iter(self._group_by_arrow([t for t, is_plain in zip(texts, plain, strict=True) if is_plain]))
        rest = iter(self._group_by_keys([t for t, is_plain in zip(texts, plain, strict=True) if not is_plain]))
        return [next(split if is_plain else rest) for is_plain in plain]

    def _group_by_arrow(self, texts: list[str]) -> list[np.ndarray]:
        """Texts with single white space only. Arrow splits them and numbers their distinct chunks, so
        that Python looks up each of those once."""
        if not texts:
            return []
        pieces = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " \n"), " ")
        begins = pieces.offsets.to_numpy()
        coded = pieces.flatten().dictionary_encode()
        keys, which = coded.dictionary, coded.indices.to_numpy()
        first = ["\0" + text.partition(" ")[0].partition("\n")[0] for text in texts]
        names = keys.to_numpy(zero_copy_only=False).tolist()
        known, used = len(self.memo), self.used
        numbers = np.fromiter(map(self.memo.get, names, repeat(-1)), np.int64, len(names))
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            new = keys.take(pa.array(missing))
            long = pc.utf8_length(new).to_numpy() > MEMO_CHARS
            ends = self._matches(new, _ENDS_IN_MARK) & ~long
            word = self._matches(new, f"^{_LATIN}+$") & ~long if self.model else np.zeros(len(new), bool)
            pick = lambda mask: [names[i] for i in missing[mask].tolist()]
            if word.any():
                self._add_words(pick(word))
            self._learn(pick(~(word | ends | long)), pick(ends))
            if len(self.memo) <= MEMO_CHUNKS:
                known, used = len(self.memo), self.used
            if long.any():
                self._learn(pick(long), [])
            learned = map(self.memo.__getitem__, (names[i] for i in missing.tolist()))
            numbers[missing] = np.fromiter(learned, np.int64, len(missing))
        new_first = list(set(first).difference(self.memo))
        if new_first:
            self._learn(new_first, [])
        which = numbers[which]
        which[begins[:-1]] = np.fromiter(map(self.memo.__getitem__, first), np.int64, len(first))
        out, ends_at = self._gather(which)
        self._forget(known, used)
        edges = np.concatenate([[0], ends_at])[begins]
        return [out[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]

    @staticmethod
    def _matches(keys: pa.Array, pattern: str) -> np.ndarray:
        return pc.match_substring_regex(keys, pattern).to_numpy(zero_copy_only=False)

    def _group_by_keys(self, texts: list[str]) -> list[np.ndarray]:
        chunks: list[str] = []
        sizes = [0]
        for text in texts:
            own = self._keys(text)
            sizes.append(len(own))
            chunks += own
        known, used = len(self.memo), self.used
        which = np.fromiter(map(self.memo.get, chunks, repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(which < 0).tolist()
        if missing:
            new = {chunks[i] for i in missing}
            short = [k for k in new if len(k) <= MEMO_CHARS]
            self._learn([], short)
            if len(self.memo) <= MEMO_CHUNKS:
                known, used = len(self.memo), self.used
            long = [k for k in new if len(k) > MEMO_CHARS]
            if long:
                self._learn([], long)
            learned = (self.memo[chunks[i]] for i in missing)
            which[missing] = np.fromiter(learned, np.int64, len(missing))
        out, ends = self._gather(which)
        self._forget(known, used)
        edges = np.concatenate([[0], ends])[np.cumsum(sizes)]
        return [out[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def batch(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids (uint32) of each text, in order."""
        group: list[str] = []
        size = 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= BATCH_CHARS:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of a worker, kept between tasks."""
    return Encoder(path)


def crc_of(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())

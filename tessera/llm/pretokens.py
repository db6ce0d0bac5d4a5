"""Vectorised pre-tokenisation for byte-level BPE, and a table of the words encoded so far."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from tessera.llm.common import prefix_sums, ranges, span_hashes

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: The code points with the Unicode property White_Space.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_CLASSES: list[np.ndarray] = []


def char_classes() -> np.ndarray:
    """Class of each code point."""
    if not _CLASSES:
        import regex

        every = "".join(map(chr, [*range(0xD800), *([0] * 0x800), *range(0xE000, 0x110000)]))
        out = np.full(0x110000, OTHER, np.uint8)
        for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
            for m in regex.finditer(pattern, every):
                out[m.start() : m.end()] = kind
        out[WHITE_SPACE] = SPACE
        _CLASSES.append(out)
    return _CLASSES[0]


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[str, np.ndarray, np.ndarray]:
    """UTF-8 texts -> one string, its code points, and the texts' offsets in them."""
    text = data.tobytes().decode("utf-8", "replace")
    if len(text) == len(data):
        return text, data, offsets
    at = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return text, np.frombuffer(text.encode("utf-32-le"), np.uint32), at[offsets]


def token_starts(cp: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pattern of byte-level BPE starts a token: contractions, letters, numbers or others with one space before, white space."""
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    kind = char_classes()[cp]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    run = first.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    run[n] = True
    mark = run.copy()
    # White space before another token of its text: the last one stands alone or, if a plain space, joins that token.
    after = np.flatnonzero(run[1:n] & ~first[1:n] & (kind[:-1] == SPACE)) + 1
    mark[after - 1] = True
    mark[after[cp[after - 1] == 32]] = False
    at = np.flatnonzero((cp[: n - 1] == 39) & mark[: n - 1] & run[: n - 1] & run[1:n] & ~first[1:n]) if n > 1 else np.zeros(0, np.int64)
    if len(at):
        padded = np.concatenate((cp[:], np.zeros(2, cp.dtype)))
        a, b = padded[at + 1], padded[at + 2]
        inside = ~first[np.minimum(at + 2, n)]
        two = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        three = inside & (((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108)))
        for found, length in ((at[two], 2), (at[three], 3)):
            mark[found + 1] = False
            mark[found + length] = True
    return np.flatnonzero(mark[:n])


class WordTable:
    """Ids of the words seen by this worker, by the words' 64-bit hashes; over `most` words it starts anew. Texts with one of `added` are no series of words."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], most: int = 2_000_000, added: list[bytes] | None = None):
        self.encode, self.most, self.added = encode, most, added or []
        self.clear()

    def clear(self) -> None:
        self.keys, self.start, self.length = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0

    def add(self, keys: np.ndarray, ids: list[list[int]]) -> None:
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(length.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.flat[self.used : self.used + total] = np.fromiter((x for each in ids for x in each), np.int32, total)
        start = self.used + np.cumsum(length) - length
        self.used += total
        keys = np.concatenate((self.keys, keys))
        order = np.argsort(keys, kind="stable")
        self.keys, self.start, self.length = keys[order], np.concatenate((self.start, start))[order], np.concatenate((self.length, length))[order]

    def look_up(self, text: str, cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each word's ids stand in `flat`, and how many they are."""
        unique, index, inverse = np.unique(span_hashes(prefix_sums(cp), start, end), return_index=True, return_inverse=True)
        if len(self.keys) + len(unique) > self.most:
            self.clear()
        at = np.searchsorted(self.keys, unique)
        new = np.ones(len(unique), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != unique[inside]
        if new.any():
            self.add(unique[new], self.encode([text[a:b] for a, b in zip(start[index[new]].tolist(), end[index[new]].tolist())]))
            at = np.searchsorted(self.keys, unique)
        return self.start[at][inverse], self.length[at][inverse]


def texts_with(strings: list[bytes], data: np.ndarray, offsets: np.ndarray) -> list[int]:
    """Which texts hold one of the strings."""
    raw, out = data.tobytes(), set()
    for s in strings:
        at = raw.find(s)
        while at >= 0:
            k = int(np.searchsorted(offsets, at, side="right")) - 1
            whole = at + len(s) <= offsets[k + 1]
            if whole:
                out.add(k)
            at = raw.find(s, int(offsets[k + 1]) if whole else at + 1)
    return sorted(out)


def encode_texts(table: WordTable, data: np.ndarray, offsets: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 texts -> all their ids one after another, and each text's number of ids; end_id closes each text."""
    special = texts_with(table.added, data, offsets)
    if not special:
        return encode_plain(table, data, offsets, end_id)
    ids, counts, a = [], [], 0
    for k in [*special, len(offsets) - 1]:
        if a < k:
            part, n = encode_plain(table, data[offsets[a] : offsets[k]], offsets[a : k + 1] - offsets[a], end_id)
            ids.append(part)
            counts.append(n)
        if k < len(offsets) - 1:
            own = table.encode([data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace")])[0] + ([] if end_id is None else [end_id])
            ids.append(np.array(own, np.int32))
            counts.append(np.array([len(own)], np.int64))
        a = k + 1
    return np.concatenate(ids), np.concatenate(counts)


def encode_plain(table: WordTable, data: np.ndarray, offsets: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """encode_texts() of texts without added tokens: cut into words, each looked up."""
    text, cp, at = code_points(data, offsets)
    begin = token_starts(cp, at)
    start, length = table.look_up(text, cp, begin, np.append(begin[1:], len(cp))) if len(begin) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    ids = table.flat[ranges(start, length)]
    before = np.concatenate(([0], np.cumsum(length)))
    ends = before[np.searchsorted(begin, at[1:])]
    counts = np.diff(np.concatenate(([0], ends)))
    if end_id is not None:
        ids, counts = np.insert(ids, ends, end_id), counts + 1
    return ids, counts

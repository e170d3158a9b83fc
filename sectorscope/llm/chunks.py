"""Encoding texts by chunks, each distinct chunk once.

The byte-level pattern starts a new match at places that can be told from two
or three bytes: at the last blank of a run of white space before a visible
character, and where ASCII letters, digits, punctuation and single line ends meet (not
between an apostrophe and a letter, which may be one match). Texts fall into
chunks at these places that can be encoded alone, and equal chunks, which make
up most of any corpus, are encoded once per worker.

Chunks are found, told apart and looked up in numpy over a buffer of texts: by
a hash, then byte by byte, so a hash collision cannot pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from sectorscope.llm.word_hashes import span_hashes

#: Bytes that start a visible character for certain: ASCII, and lead bytes under which no white space is coded.
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_VISIBLE[0xC3:0xE1] = True
_VISIBLE[0xE4:0xF5] = True

_OTHER, _LETTER, _DIGIT, _MARK, _APOSTROPHE, _BREAK = range(6)
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = _MARK
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x27] = _APOSTROPHE
_KIND[[9, 10, 13]] = _BREAK
#: Whether a match starts between a byte of the first and a byte of the second kind.
_MEET = np.zeros((6, 6), bool)
for _a, _next in ((_LETTER, (_DIGIT, _MARK, _APOSTROPHE, _BREAK)), (_DIGIT, (_LETTER, _MARK, _APOSTROPHE, _BREAK)),
                  (_MARK, (_LETTER, _DIGIT, _BREAK)), (_APOSTROPHE, (_DIGIT, _BREAK)),
                  (_BREAK, (_LETTER, _DIGIT, _MARK, _APOSTROPHE))):
    _MEET[_a, list(_next)] = True
_MEET = _MEET.reshape(-1)
_GROUP = 1 << 21
#: Ranges up to so many bytes are compared in steps, all at once.
_STEPS = 256


def chunk_spans(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The texts in one buffer, and per chunk its first byte, end and text number."""
    buffer = b"\n".join(texts) + b"\n"
    data = np.frombuffer(buffer, np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes + 1) - 1
    begins = ends - sizes
    kind = _KIND[data]
    starts = np.append((data[:-1] == 32) & _VISIBLE[data[1:]], False)
    meet = _MEET[kind[:-1] * np.uint8(6) + kind[1:]]
    # behind a longer run of white space the match depends on what follows
    meet[1:] &= (kind[1:-1] != _BREAK) | ((kind[:-2] != _OTHER) & (kind[:-2] != _BREAK))
    starts[1:] |= meet
    starts[ends] = False  # the line end after a text is not part of it
    starts[begins[sizes > 0]] = True
    start = np.flatnonzero(starts)
    doc = np.searchsorted(ends, start, side="right")
    end = np.append(start[1:], len(buffer))
    return buffer, start, np.minimum(end, ends[doc]), doc


class ChunkCache:
    """Texts to packed token ids (little-endian unsigned 32-bit), with the ids of known chunks kept in arrays.

    ``encode`` gets a list of new chunks (text) and returns their packed ids. At most ``limit`` chunks are kept; when
    they are too many, those not used since the last time go. Chunks over ``long`` bytes are encoded but not kept.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = 2_000_000, long: int = 200):
        self.encode, self.limit, self.long = encode, limit, long
        self._clear()

    def _clear(self) -> None:
        self.hash = np.zeros(0, np.uint64)     # sorted
        self.entry = np.zeros(0, np.int32)     # of each hash
        self.used = np.zeros(0, bool)          # by entry, as all that follow
        self.text, self.text_at, self.text_size = _Store(np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids, self.ids_at, self.ids_size = _Store(np.dtype("<u4")), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def __len__(self) -> int:
        return len(self.hash)

    def pack(self, texts: list[bytes | None]) -> list[bytes]:
        """The packed ids of each text (UTF-8); null counts as empty."""
        return [ids for group in _groups(texts) for ids in self._pack(group)]

    def _pack(self, texts: list[bytes]) -> list[bytes]:
        buffer, start, end, doc = chunk_spans(texts)
        if not len(start):
            return [b""] * len(texts)
        data = np.frombuffer(buffer + bytes(8), np.uint8)
        key, first, which = _distinct(data, start, end)
        ids, offset, size = self._ids(buffer, data, key, start[first], end[first])
        n = size[which]
        before = np.cumsum(n) - n
        out = ids[_ranges(offset[which], n)]
        at = np.append(before, len(out))[np.searchsorted(doc, np.arange(len(texts) + 1))].tolist()
        return [out[a:b].tobytes() for a, b in zip(at, at[1:])]

    def _ids(self, buffer: bytes, data: np.ndarray, key: np.ndarray, start: np.ndarray, end: np.ndarray):
        """All ids of some distinct chunks (ordered by ``key``) in one array, and where each one's start and how many they are."""
        place = np.searchsorted(self.hash, key)
        known = np.zeros(len(key), bool)
        inside = place < len(self.hash)
        known[inside] = self.hash[place[inside]] == key[inside]
        have = self.entry[place[known]]
        taken = known.copy()  # a hash of another chunk is not used again
        known[known] = _same(self.text.room, self.text_at[have], self.text_size[have], data, start[known], (end - start)[known])
        have = self.entry[place[known]]
        self.used[have] = True
        offset, size = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        offset[known], size[known] = self.ids_at[have], self.ids_size[have]
        new = np.flatnonzero(~known)
        if not len(new):
            return self.ids.data, offset, size
        packed = self.encode([buffer[a:b].decode("utf-8", "replace") for a, b in zip(start[new].tolist(), end[new].tolist())])
        made = np.frombuffer(b"".join(packed), "<u4")
        count = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        # ids of known and new chunks side by side
        ids = np.concatenate((self.ids.data[_ranges(offset[known], size[known])], made))
        offset[known] = np.cumsum(size[known]) - size[known]
        offset[new], size[new] = len(ids) - len(made) + np.cumsum(count) - count, count
        length = end[new] - start[new]
        fits = ~taken[new] & (length <= self.long) & (np.append(key[new][1:], 0) != key[new]) & (np.append(0, key[new][:-1]) != key[new])
        fits &= np.cumsum(fits) <= self.limit // 2
        self._add(data, key[new][fits], start[new][fits], length[fits], made[_ranges((np.cumsum(count) - count)[fits], count[fits])],
                  count[fits])
        return ids, offset, size

    def _add(self, data: np.ndarray, key: np.ndarray, start: np.ndarray, length: np.ndarray, ids: np.ndarray,
             count: np.ndarray) -> None:
        if len(self.hash) + len(key) > self.limit:
            self._drop_unused()
        row = len(self.text_at) + np.arange(len(key), dtype=np.int32)
        self.text_at = np.append(self.text_at, self.text.size + np.cumsum(length) - length)
        self.ids_at = np.append(self.ids_at, self.ids.size + np.cumsum(count) - count)
        self.text_size = np.append(self.text_size, length.astype(np.int32))
        self.ids_size = np.append(self.ids_size, count.astype(np.int32))
        self.used = np.append(self.used, np.zeros(len(key), bool))
        self.text.add(data[_ranges(start, length)])
        self.ids.add(ids)
        place = np.searchsorted(self.hash, key)
        self.hash, self.entry = np.insert(self.hash, place, key), np.insert(self.entry, place, row)

    def _drop_unused(self) -> None:
        kept = self.used[self.entry]
        hashes, rows = self.hash[kept], self.entry[kept]
        if len(rows) > self.limit // 2:
            return self._clear()
        text = self.text.data[_ranges(self.text_at[rows], self.text_size[rows])]
        ids = self.ids.data[_ranges(self.ids_at[rows], self.ids_size[rows])]
        text_size, ids_size = self.text_size[rows], self.ids_size[rows]
        self._clear()
        self.hash, self.entry, self.used = hashes, np.arange(len(rows), dtype=np.int32), np.zeros(len(rows), bool)
        self.text.add(text)
        self.ids.add(ids)
        self.text_size, self.text_at = text_size, np.cumsum(text_size, dtype=np.int64) - text_size
        self.ids_size, self.ids_at = ids_size, np.cumsum(ids_size, dtype=np.int64) - ids_size


class _Store:
    """An array that grows at its end; eight places at least stay free."""

    def __init__(self, dtype: np.dtype | type):
        self.room, self.size = np.zeros(1 << 12, dtype), 0

    @property
    def data(self) -> np.ndarray:
        return self.room[:self.size]

    def add(self, more: np.ndarray) -> None:
        need = self.size + len(more)
        if need + 8 > len(self.room):
            room = np.zeros(max(need + 8, len(self.room) * 3 // 2), self.room.dtype)
            room[:self.size] = self.data
            self.room = room
        self.room[self.size:need] = more
        self.size = need


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after another."""
    before = np.cumsum(size, dtype=np.int64) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of a byte array, as one number."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))


def _same(a: np.ndarray, a_at: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_at: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Which byte ranges of two arrays are equal, pair by pair; eight bytes must follow the last range of either."""
    equal = a_size == b_size
    live = np.flatnonzero(equal)
    left, right = _eights(a), _eights(b)
    for done in range(0, _STEPS, 8):
        if not len(live):
            return equal
        size = b_size[live] - done
        differ = (left[a_at[live] + done] ^ right[b_at[live] + done]) & _KEEP[np.minimum(size, 8)] != 0
        equal[live[differ]] = False
        live = live[~differ & (size > 8)]
    for i in live.tolist():
        equal[i] = np.array_equal(a[a_at[i]:a_at[i] + a_size[i]], b[b_at[i]:b_at[i] + b_size[i]])
    return equal


def _distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys (sorted) and numbers of the distinct chunks' first occurrences, and for each chunk the place of its own among them."""
    hashes = span_hashes(data, start, end)
    key, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    like, length = first[which], end - start
    if _same(data, start[like], length[like], data, start, length).all():
        return key, first, which
    order = np.argsort(hashes, kind="stable")  # two chunks of one hash: every chunk by itself
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return hashes[order], order, back


def _groups(texts: list[bytes | None]) -> Iterator[list[bytes]]:
    """The texts in groups of about two million bytes; a longer text is a group by itself."""
    group: list[bytes] = []
    size = 0
    for text in texts:
        text = text or b""
        if group and size + len(text) > _GROUP:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group

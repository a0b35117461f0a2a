"""Vectorised text primitives over Arrow string arrays.

Everything here works on whole batches of UTF-8 bytes: words are found with byte tables, hashed eight bytes at a time
and grouped with sorted runs, so no Python loop runs per word. Where equality of words decides a result,
``Words.distinct`` compares the bytes behind equal hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Lower case of ASCII letters, and of the second bytes of Latin-1 letters.
_LATIN = _LOWER.copy()
_LATIN[0x80:0x9F] += 0x20
_GRAM = U64(0xD1342543DE82EF95)
_STEP = U64(0x9E3779B97F4A7C15)
_LENGTH = U64(0xA0761D6478BD642F)
#: What of eight bytes belongs to a word of 0 to 8 more bytes.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U64)
#: Words longer than this are hashed by xxh3 and compared as byte strings, one at a time.
LONG_WORD = 64


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (xor-shift and odd multiplications)."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def flat(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets (rows + 1, starting at 0) of a string or binary array; nulls count as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks() if arr.num_chunks != 1 else arr.chunk(0)
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offs, data = arr.buffers()
    if not len(arr) or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    at = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Join and split batches into runs of rows with about ``most`` bytes of text each (one row at least)."""
    held: list[pa.RecordBatch] = []
    size = 0

    def joined() -> Iterator[pa.RecordBatch]:
        whole = held[0] if len(held) == 1 else pa.concat_batches(held)
        _, at = flat(whole.column(whole.schema.get_field_index(column)))
        row = 0
        while row < whole.num_rows:
            end = max(row + 1, int(np.searchsorted(at, at[row] + most, side="right")) - 1)
            yield whole.slice(row, end - row)
            row = end

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += int(flat(batch.column(batch.schema.get_field_index(column)))[1][-1])
            if size >= most:
                yield from joined()
                held, size = [], 0
    if held:
        yield from joined()


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indexes starts[0] .. starts[0]+lens[0]-1, starts[1] .. and so on, concatenated."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lens), lens) + np.arange(total)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal neighbours."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return starts, np.diff(np.append(starts, len(values)))


def _eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on, as one little-endian number (zeros beyond the end)."""
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    return np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))


def span_hashes(raw: np.ndarray, starts: np.ndarray, lens: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans with the given first eight bytes."""
    eights = _eights(raw)
    h = mix(heads ^ mix(lens.astype(U64) * _LENGTH))
    todo, at = np.flatnonzero((lens > 8) & (lens <= LONG_WORD)), 8
    while len(todo):
        h[todo] = mix(h[todo] * _STEP + (eights[starts[todo] + at] & _MASK[np.minimum(lens[todo] - at, 8)]))
        at += 8
        todo = todo[lens[todo] > at]
    for k in np.flatnonzero(lens > LONG_WORD):
        h[k] = xxhash.xxh3_64_intdigest(raw[starts[k] : starts[k] + lens[k]].tobytes())
    return h


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each row: byte spans, row numbers and 64-bit hashes."""

    def __init__(self, arr: pa.Array, fold: bool, leading_space: bool = False):
        """fold: A-Z count as a-z. leading_space: a span also holds the white space before the word (and a text's
        trailing white space is a span of its own), so the spans cover every byte."""
        raw, at = flat(arr)
        n = len(raw)
        self.raw, self.at, self.rows = raw, at, len(at) - 1
        first = np.zeros(n + 1, dtype=bool)
        first[at] = True
        space = SPACE[raw]
        if leading_space:
            begins = first[:n].copy()
            begins[1:] |= space[1:] & ~space[:-1]
            self.starts = np.flatnonzero(begins)
            self.ends = np.append(self.starts[1:], n)[: len(self.starts)]
        else:
            before = np.ones(n, dtype=bool)
            before[1:] = space[:-1]
            self.starts = np.flatnonzero(~space & (before | first[:n]))
            after = np.ones(n, dtype=bool)
            after[:-1] = space[1:]
            self.ends = np.flatnonzero(~space & (after | first[1:])) + 1
        self._hashed(_LOWER[raw] if fold else raw)

    def _hashed(self, canon: np.ndarray) -> None:
        """canon: the bytes that words are equal by."""
        self.canon, self.lens = canon, self.ends - self.starts
        self.row = np.searchsorted(self.at, self.starts, side="right") - 1
        self.heads = _eights(canon)[self.starts] & _MASK[np.minimum(self.lens, 8)]
        self.hash = span_hashes(canon, self.starts, self.lens, self.heads)
        self.counts = np.bincount(self.row, minlength=self.rows)
        self.first = np.cumsum(self.counts) - self.counts

    def key(self, k: int) -> bytes:
        return self.canon[self.starts[k] : self.ends[k]].tobytes()

    def _same_rest(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether words a[k] and b[k], of the same length and first eight bytes, are the same."""
        out = np.ones(len(a), dtype=bool)
        eights, at = _eights(self.canon), 8
        todo = np.flatnonzero((self.lens[a] > 8) & (self.lens[a] <= LONG_WORD))
        while len(todo):
            x, y = a[todo], b[todo]
            equal = (eights[self.starts[x] + at] ^ eights[self.starts[y] + at]) & _MASK[np.minimum(self.lens[x] - at, 8)] == 0
            out[todo[~equal]] = False
            at += 8
            todo = todo[equal & (self.lens[x] > at)]
        for k in np.flatnonzero(self.lens[a] > LONG_WORD):
            out[k] = self.key(a[k]) == self.key(b[k])
        return out

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """A number for each word, the same for equal words and no others, and one word of each number."""
        order = np.argsort(self.hash)
        hashes, lens, heads = self.hash[order], self.lens[order], self.heads[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = hashes[1:] != hashes[:-1]
        same = np.zeros(len(order), dtype=bool)
        same[1:] = (lens[1:] == lens[:-1]) & (heads[1:] == heads[:-1])
        k = np.flatnonzero(~new & same & (lens > 8))
        same[k] = self._same_rest(order[k - 1], order[k])
        bad = np.flatnonzero(~new & ~same)
        if len(bad):  # equal hashes of different words: their run is told apart by the bytes
            start = np.append(np.flatnonzero(new), len(order))
            for r in np.unique(np.searchsorted(start, bad, side="right") - 1):
                run = sorted(order[start[r] : start[r + 1]].tolist(), key=self.key)
                order[start[r] : start[r + 1]] = run
                new[start[r] + 1 : start[r + 1]] = [self.key(x) != self.key(y) for x, y in zip(run, run[1:])]
        number = np.empty(len(order), dtype=np.int64)
        number[order] = np.cumsum(new) - 1
        return number, order[new]


class Pieces(Words):
    """Words of ASCII and Latin-1 letters cut further into runs of letters, single digits and runs of others, with
    letters of both cases alike; words with an apostrophe or any other character stay whole."""

    def __init__(self, arr: pa.Array):
        raw, at = flat(arr)
        n = len(raw)
        self.raw, self.at, self.rows = raw, at, len(at) - 1
        kind = _KIND[raw]
        kind[np.flatnonzero((raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7)))] = 4  # signs, not letters
        first = np.zeros(n + 1, dtype=bool)
        first[at] = True
        begins = kind != 0
        begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 2) | first[1:n]
        odd = np.flatnonzero(kind == 4)
        canon = _LATIN[raw]
        if len(odd):
            inside = np.diff(np.concatenate(([False], kind != 0, [False])).astype(np.int8))
            starts = np.union1d(np.flatnonzero(inside == 1), at[:-1])
            stops = np.append(np.flatnonzero(inside == -1), n)
            whole = np.unique(starts[np.searchsorted(starts, odd, side="right") - 1])
            ends = np.minimum(stops[np.searchsorted(stops, whole, side="right")], np.append(at, n)[np.searchsorted(at, whole, side="right")])
            covered = ragged(whole, ends - whole)
            begins[covered] = False
            begins[whole] = True
            canon[covered] = raw[covered]
        stops = kind != 0
        stops[:-1] &= (kind[1:] == 0) | begins[1:] | first[1:n]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self._hashed(canon)


#: 0 space, 1 bytes of letters, 2 digit, 3 other, 4 what makes a word stay whole.
_KIND = np.full(256, 4, dtype=np.uint8)
_KIND[33:127] = 3
_KIND[39] = 4
_KIND[48:58] = 2
_KIND[[*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)]] = 1
_KIND[SPACE] = 0


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n values from each position on (the last n-1 positions hold no full window)."""
    if len(hashes) < n:
        return np.zeros(0, U64)
    total = np.zeros(len(hashes) - n + 1, dtype=U64)
    power = U64(1)
    with np.errstate(over="ignore"):
        for j in range(n):
            total += hashes[j : len(hashes) - n + 1 + j] * power
            power = power * _GRAM
    return mix(total)


class Shingles:
    """Distinct word n-gram hashes of each row; a row of fewer words has its whole sequence as one shingle."""

    def __init__(self, words: Words, n: int):
        g = grams(words.hash, n)
        full = np.maximum(words.counts - n + 1, 0)
        short = np.flatnonzero((words.counts > 0) & (words.counts < n))
        sets: list[np.ndarray] = [np.zeros(0, U64)] * words.rows
        for r in np.flatnonzero(full):
            h = np.sort(g[words.first[r] : words.first[r] + full[r]])
            sets[r] = h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) > 1 else h
        for r in short:
            w, total, power = words.hash[words.first[r] : words.first[r] + words.counts[r]], 0, 1
            for x in w.tolist():
                total, power = (total + x * power) % 2**64, power * int(_GRAM) % 2**64
            sets[r] = mix(np.array([total], dtype=U64))
        self.sets = sets
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        self.all = np.concatenate(sets) if sets else np.zeros(0, U64)
        self.first = np.cumsum(self.sizes) - self.sizes


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int(np.count_nonzero(b[at] == a))


class Memo:
    """Token arrays of words, found by hash and then compared by their bytes; grown batch by batch and emptied when
    full, so its memory is bounded."""

    def __init__(self, encode, most: int = 500_000, most_bytes: int = 1 << 24):
        self.encode, self.most, self.most_bytes = encode, most, most_bytes
        self.clear()

    def clear(self) -> None:
        self.keys, self.off, self.len = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0
        self.text, self.filled = np.zeros(1 << 16, np.uint8), 0

    def _known(self, words: Words, first: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which words are those at the given entries, by their bytes."""
        out = np.zeros(len(first), dtype=bool)
        k = np.flatnonzero(at < len(self.keys))
        out[k] = (self.keys[at[k]] == words.hash[first[k]]) & (self.size[at[k]] == words.lens[first[k]])
        mine, theirs, done, todo = _eights(words.canon), _eights(self.text), 0, np.flatnonzero(out)
        while len(todo):
            w, k = first[todo], at[todo]
            equal = (mine[words.starts[w] + done] ^ theirs[self.at[k] + done]) & _MASK[np.minimum(words.lens[w] - done, 8)] == 0
            out[todo[~equal]] = False
            done += 8
            todo = todo[equal & (words.lens[w] > done)]
        return out

    def tokens(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in order, and their number for each row."""
        if not len(words.hash):
            return np.zeros(0, np.int32), np.zeros(words.rows, np.int64)
        if len(self.keys) > self.most or max(self.filled, self.used) > self.most_bytes:
            self.clear()
        number, first = words.distinct()
        hashes = words.hash[first]
        at = np.searchsorted(self.keys, hashes)
        known = self._known(words, first, at)
        off, lens = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        off[known], lens[known] = self.off[at[known]], self.len[at[known]]
        pool, new = self.pool, np.flatnonzero(~known)
        if len(new):
            raw, starts, ends = words.raw.tobytes(), words.starts[first[new]], words.ends[first[new]]
            ids, lens[new] = self.encode([raw[s:e].decode("utf-8", "replace") for s, e in zip(starts.tolist(), ends.tolist())])
            off[new] = self.used + np.cumsum(lens[new]) - lens[new]
            self.pool, self.used = _extended(self.pool, self.used, ids), self.used + len(ids)
            pool = self.pool
            # Kept are words of LONG_WORD bytes at most, whose hash no other word has here.
            alone = np.ones(len(new), dtype=bool)
            alone[1:] &= hashes[new][1:] != hashes[new][:-1]
            taken = np.zeros(len(new), dtype=bool)
            k = np.flatnonzero(at[new] < len(self.keys))
            taken[k] = self.keys[at[new[k]]] == hashes[new[k]]
            kept = alone & ~taken & (words.lens[first[new]] <= LONG_WORD)
            add, size = new[kept], words.lens[first[new[kept]]]
            text = words.canon[ragged(words.starts[first[add]], size)]
            place = self.filled + np.cumsum(size) - size
            self.text, self.filled = _extended(self.text, self.filled, text), self.filled + len(text)
            where = at[add]
            self.keys, self.off, self.len, self.at, self.size = (np.insert(x, where, y) for x, y in ((self.keys, hashes[add]), (self.off, off[add]), (self.len, lens[add]), (self.at, place), (self.size, size)))
        lens = lens[number]
        return pool[ragged(off[number], lens)], np.bincount(words.row, weights=lens, minlength=words.rows).astype(np.int64)


def _extended(pool: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """The pool with more values behind those in use, in a larger array where they do not fit."""
    if used + len(more) > len(pool):
        return np.concatenate((pool[:used], more, np.zeros(used + len(more), pool.dtype)))
    pool[used : used + len(more)] = more
    return pool

"""Byte-level BPE over length-bucketed padded numpy matrices.

Pretokens of about the same length are the rows of one matrix of token ids, of a bounded number of cells. In each
round every row merges its leftmost pair of least rank; ranks come from a hashed table of pairs, each round shortens
the rows, and rows without a pair left are taken out (compaction). Rows of more than ``WIDE`` bytes merge all pairs
of their least rank that do not overlap in one round, from the left and up to the first merge that makes a pair of
lower rank, so the outcome is that of as many rounds of one merge each.

Texts are cut at white space into words that the pattern treats alone, and the ids of words met before are reused,
by their bytes.

Nulls and empty texts have no tokens; a very long text is encoded whole, in a batch of its own; repeated rows, equal
ids and ties need nothing special, and an empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidefold.llm.columnar import Memo, Words, blocks, flat, ragged
from tidefold.llm.shared import lean

#: Longer rows merge several pairs in a round; cells of one matrix.
WIDE, CELLS = 64, 1 << 21
NONE = np.uint32(0xFFFFFFFF)
#: White space beyond ASCII and control characters on which engines differ; with these a text is not cut first.
ODD_SPACE = regex.compile("[\x1c-\x1f\x85\xa0 ᠎ -‏    　﻿]")


class ByteBPE:
    """Encoder and decoder of one rank file (lines of base64 bytes and rank)."""

    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.uint32)
        size = max(ranks.values()) + 1
        lens, parts = np.zeros(size, np.int64), [b""] * size
        for t, i in ranks.items():
            parts[i], lens[i] = t, len(t)
        self.token_len, self.token_at = lens, np.cumsum(lens) - lens
        self.token_bytes = np.frombuffer(b"".join(parts), dtype=np.uint8)
        pairs = [(ranks[a] << 32 | ranks[b], i) for t, i in ranks.items() for k in range(1, len(t)) if (a := t[:k]) in ranks and (b := t[k:]) in ranks]
        keys, merged = np.array([p[0] for p in pairs], dtype=np.uint64), np.array([p[1] for p in pairs], dtype=np.uint32)
        #: Tokens that are part of a merge of lower rank than their own.
        self.fertile = np.zeros(size, dtype=bool)
        for part in (keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)):
            self.fertile[part[merged < part].astype(np.int64)] = True
        self._table(keys, merged)
        self.pretokens: dict[str, bytes] = {}
        self.memo = Memo(self._encode_words)

    def _table(self, keys: np.ndarray, values: np.ndarray) -> None:
        """An open-addressing table of pairs with linear probing."""
        bits = max(4, int(np.ceil(np.log2(len(keys) * 4 + 1))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots, self.values = np.full(1 << bits, np.uint64(2**64 - 1)), np.full(1 << bits, NONE)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            at = slot[todo]
            _, winners = np.unique(np.where(self.slots[at] == np.uint64(2**64 - 1), at, -1 - np.arange(len(at))), return_index=True)
            winners = winners[self.slots[at[winners]] == np.uint64(2**64 - 1)]
            self.slots[at[winners]], self.values[at[winners]] = keys[todo[winners]], values[todo[winners]]
            todo = np.delete(todo, winners)
            slot[todo] = np.where(self.slots[slot[todo]] != np.uint64(2**64 - 1), (slot[todo] + 1) & self.mask, slot[todo])

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where the pair does not merge."""
        keys = (left.astype(np.uint64) << np.uint64(32) | right).ravel()
        slot, out = self._slot(keys), np.full(len(keys), NONE)
        got = self.slots[slot]
        hit = got == keys
        out[hit] = self.values[slot[hit]]
        todo = np.flatnonzero(~hit & (got != np.uint64(2**64 - 1)))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            got = self.slots[slot[todo]]
            hit = got == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (got != np.uint64(2**64 - 1))]
        return out.reshape(left.shape)

    def merge(self, parts: list[bytes]) -> list[np.ndarray]:
        """Token ids of each pretoken."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(parts)
        lens = np.array([len(p) for p in parts], dtype=np.int64)
        width = np.where(lens <= 24, lens, (2 ** (np.ceil(np.log2(np.maximum(lens, 1)) * 2) / 2)).astype(np.int64) + 1)
        for w in np.unique(width[lens > 0]):
            rows, most = np.flatnonzero(width == w), max(1, min(1 << 16, CELLS // int(w)))
            for at in range(0, len(rows), most):
                some = rows[at : at + most]
                (self._bucket if w <= WIDE else self._wide)([parts[r] for r in some], int(lens[some].max()), some, lens, out)
        return out

    def _bucket(self, parts: list[bytes], w: int, rows: np.ndarray, lens: np.ndarray, out: list[np.ndarray]) -> None:
        padded = np.frombuffer(b"".join(p.ljust(w, b"\0") for p in parts), dtype=np.uint8).reshape(len(parts), w)
        ids, left = self.byte_id[padded], lens[rows].copy()
        rank = self.rank(ids[:, :-1], ids[:, 1:]) if w > 1 else np.full((len(parts), 0), NONE)
        rank[np.arange(1, w)[None, :] >= left[:, None]] = NONE  # no pair reaches into the padding
        while True:
            if ids.shape[1] > 1:
                j = rank.argmin(axis=1)
                best = rank[np.arange(len(rows)), j]
                live = best != NONE
            else:
                live = np.zeros(len(rows), dtype=bool)
            if not live.all():
                done = ~live
                for r, line, n in zip(rows[done].tolist(), ids[done], left[done].tolist()):
                    out[r] = line[:n]
                if not live.any():
                    return
                ids, rank, rows, left, j, best = ids[live], rank[live], rows[live], left[live], j[live], best[live]
            n = np.arange(len(rows))
            ids[n, j] = best
            w = ids.shape[1] - 1
            keep = np.arange(w)[None, :]
            ids = np.take_along_axis(ids, keep + (keep > j[:, None]), axis=1)
            keep = keep[:, : w - 1]
            rank = np.take_along_axis(rank, keep + (keep >= j[:, None]), axis=1)
            left -= 1
            for at, ok in ((j, j + 1 < left), (j - 1, j > 0)):
                k = np.flatnonzero(ok)
                rank[k, at[k]] = self.rank(ids[k, at[k]], ids[k, at[k] + 1])

    def _wide(self, parts: list[bytes], w: int, rows: np.ndarray, lens: np.ndarray, out: list[np.ndarray]) -> None:
        """Merged tokens keep their place and know their neighbours; once half of all places are empty, rows are
        moved together."""
        padded = np.frombuffer(b"".join(p.ljust(w, b"\0") for p in parts), dtype=np.uint8).reshape(len(parts), w)
        ids, left = self.byte_id[padded], lens[rows].copy()
        there = np.arange(w)[None, :] < left[:, None]
        rank = np.full(ids.shape, NONE)
        rank[:, :-1] = np.where(there[:, 1:], self.rank(ids[:, :-1], ids[:, 1:]), NONE)
        to, back = self._neighbours(left, w)
        while len(rows):
            best = rank.min(axis=1)
            live = best != NONE
            if not live.all():
                for k in np.flatnonzero(~live).tolist():
                    out[rows[k]] = ids[k, there[k]]
                ids, rank, to, back, there, rows, left, best = (x[live] for x in (ids, rank, to, back, there, rows, left, best))
                if not len(rows):
                    return
            r, j = np.nonzero(rank == best[:, None])
            # Of pairs that overlap, every second one from the left.
            start = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (j[1:] != to[r[:-1], j[:-1]]))))
            take = (np.arange(len(r)) - np.repeat(start, np.diff(np.append(start, len(r))))) % 2 == 0
            r, j = r[take], j[take]
            if self.fertile[best].any():
                take = self._in_order(ids, to, back, best, r, j)
                r, j = r[take], j[take]
            second = to[r, j]
            third = to[r, second]
            ids[r, j], rank[r, second], there[r, second], to[r, j] = best[r], NONE, False, third
            more = third < w
            back[r[more], third[more]] = j[more]
            rank[r, j] = np.where(more, self.rank(best[r], ids[r, np.where(more, third, 0)]), NONE)
            first = back[r, j]
            some = first >= 0
            x, y = r[some], first[some]
            rank[x, y] = self.rank(ids[x, y], ids[x, j[some]])
            left = left - np.bincount(r, minlength=len(rows))
            if 2 * int(left.max()) <= w:
                x, y = np.nonzero(there)
                place, w = (np.cumsum(there, axis=1) - 1)[x, y], int(left.max())
                moved, ranks = np.zeros((len(rows), w), np.uint32), np.full((len(rows), w), NONE)
                moved[x, place], ranks[x, place] = ids[x, y], rank[x, y]
                ids, rank, there = moved, ranks, np.arange(w)[None, :] < left[:, None]
                to, back = self._neighbours(left, w)

    @staticmethod
    def _neighbours(left: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
        """The next and the last place of each place; the width and -1 where there is none."""
        place = np.arange(w, dtype=np.int64)[None, :]
        return np.where(place + 1 < left[:, None], place + 1, w), np.repeat(place - 1, len(left), axis=0)

    def _in_order(self, ids: np.ndarray, to: np.ndarray, back: np.ndarray, best: np.ndarray, r: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The merges of a round up to the first one of each row that makes a pair of lower rank than its own."""
        w = ids.shape[1]
        third = to[r, to[r, j]]
        after = np.concatenate(([False], (r[1:] == r[:-1]) & (j[1:] == third[:-1])))  # right behind another merge
        before = np.where(after, best[r], ids[r, back[r, j]])
        lower = (back[r, j] >= 0) & (self.rank(before, best[r]) < best[r])
        lower |= (third < w) & (self.rank(best[r], ids[r, np.minimum(third, w - 1)]) < best[r])
        n = np.cumsum(lower) - lower  # such merges before each one
        begins = np.concatenate(([True], r[1:] != r[:-1]))
        return n == np.repeat(n[begins], np.diff(np.append(np.flatnonzero(begins), len(r))))

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        split = [self.pattern.findall(w) for w in words]
        known = self.pretokens
        if len(known) > 200_000:
            known.clear()
        new = list(dict.fromkeys(p for ps in split for p in ps if p not in known))
        fresh = dict(zip(new, (x.astype("<i4").tobytes() for x in self.merge([p.encode() for p in new]))))
        local = {**fresh} if any(len(p) > 64 for p in new) else fresh
        known.update((p, b) for p, b in fresh.items() if len(p) <= 64)
        found = [b"".join([known[p] if p in known else local[p] for p in ps]) for ps in split]
        return np.frombuffer(b"".join(found), dtype="<i4"), np.array([len(b) // 4 for b in found], dtype=np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and how many each text has."""
        odd = [k for k, t in enumerate(texts.to_pylist()) if t and ODD_SPACE.search(t)]
        if not odd:
            return self.memo.tokens(Words(texts, fold=False, leading_space=True))
        mask = np.zeros(len(texts), dtype=bool)
        mask[odd] = True
        plain = pa.array([None if m else t for m, t in zip(mask, texts.to_pylist())], texts.type)
        ids, counts = self.memo.tokens(Words(plain, fold=False, leading_space=True))
        whole_ids, whole_counts = self._encode_words([texts[k].as_py() for k in odd])
        pool, at = np.concatenate((ids, whole_ids)), np.cumsum(counts) - counts
        at[odd], counts[odd] = len(ids) + np.cumsum(whole_counts) - whole_counts, whole_counts
        return pool[ragged(at, counts)], counts

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows in order, and how many each row has."""
        lens = self.token_len[ids]
        total = np.concatenate(([0], np.cumsum(lens)))
        ends = np.cumsum(counts)
        return self.token_bytes[ragged(self.token_at[ids], lens)], total[ends] - total[ends - counts]


@functools.lru_cache(maxsize=2)
def encoder(rank_file: str, pattern: str) -> ByteBPE:
    """One encoder for each Python worker."""
    return ByteBPE(rank_file, pattern)


def encode_decode(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """Encode each text and decode the ids again, without any shuffle.

    Returns id_col (cast to long), n_tokens, ids_sha256 and decoded_sha256; with_ids adds ``token_ids`` (array of
    int), with_text adds ``decoded`` (string). Null texts count as empty; other columns are not read.
    """
    schema = f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids + ", decoded string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(rank_file, pattern)
        for b in blocks(batches, "_t"):
            ids, counts = bpe.encode(b.column(1))
            raw, sizes = bpe.decode(ids, counts)
            wire, text = ids.astype("<u4").tobytes(), raw.tobytes()
            ends, stops = np.cumsum(counts).tolist(), np.cumsum(sizes).tolist()
            cols = [b.column(0), pa.array(counts), pa.array([hashlib.sha256(wire[4 * (e - n) : 4 * e]).hexdigest() for e, n in zip(ends, counts.tolist())]), pa.array([hashlib.sha256(text[e - n : e]).hexdigest() for e, n in zip(stops, sizes.tolist())])]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(ids.astype(np.int32))))
                names.append("token_ids")
            if with_text:
                cols.append(pa.array([text[e - n : e].decode("utf-8", "replace") for e, n in zip(stops, sizes.tolist())], pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(cols, names)

    df = lean(df)
    return df.select(df[id_col].cast("long").alias("_i"), df[text_col].alias("_t")).mapInArrow(run, schema)


__all__ = ["ByteBPE", "encode_decode", "encoder", "flat"]

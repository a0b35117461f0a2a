"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Test items are put into classes by their number of shingles (8, 16, 32, ... at most). For each class a document is
seen as overlapping windows of twice the class's size, one quarter of a window apart, so that an item's passage
lies within one window, and the Jaccard similarity of item and window stays above 0.19 where the containment is
0.8 or more, however long the document is. With ``HASHES`` single-row bands such a pair is missed with a
probability of 2e-9. Minima of windows are merged from minima of blocks of ``BASE`` shingles. The least class is
that of items so small (up to four shingles) that the containment asks for all of them: its windows hold one shingle,
and the item's minimum under one hash is enough, as its shingle must be there. Items shorter than a shingle are in that class
with the one shingle that all their words make, and windows of as many words.

Every document is one map step without any shuffle. Items of equal text are one item in the index, and are told apart
in the result; the index goes to the tasks in blocks of ``BLOCK_ITEMS`` items and ``BLOCK_BYTES`` of text at most, and
the documents are scanned once for each block. Null texts and items hold nothing and match nothing; very long
documents are searched whole; repeated rows give repeated results, and items of equal ids and ties stay apart; empty
tables give no rows (``remove_leaks``: the documents). Other columns of the documents pass through ``remove_leaks``,
whatever their names, and are not read by ``find_leaks``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.llm.columnar import U64, Shingles, Words, blocks, grams, overlap
from tidefold.llm.shared import lean

HASHES, BASE, TINY, BLOCK_BYTES, BLOCK_ITEMS = 96, 8, 4, 16 << 20, 1 << 16
_rng = np.random.default_rng(96)
_XOR = _rng.integers(0, 2**63, HASHES, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_MUL = _rng.integers(0, 2**63, HASHES, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_LOW = U64(0xFFFF)


class Items:
    """MinHash index of one block of test items, of which those with fewer words than least_words match nothing."""

    def __init__(self, ids: list[str], texts: list[str], shingle: int, containment: float = 0.8, least_words: int = 1):
        words = Words(pa.array(texts, pa.string()), fold=True)
        s = Shingles(words, shingle)
        self.ids, self.sets, self.shingle = ids, s.sets, shingle
        sizes, long_enough = s.sizes, words.counts >= least_words
        # So few shingles that the containment asks for all of them.
        most = TINY if containment > 1 - 1 / (TINY + 1) else next((n for n in range(TINY, 1, -1) if containment * n > n - 1), 1)
        #: Minima of the least class under the first hash, and whose they are, by words of a shingle.
        self.small: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.n_words: dict[int, int] = {}
        for n in np.unique(words.counts[(words.counts > 0) & (words.counts < shingle) & long_enough]).tolist():
            of = np.flatnonzero(words.counts == n)
            for k in of:
                self.sets[k] = grams(words.hash[words.first[k] : words.first[k] + n], n)
                self.n_words[int(k)] = n
            self.small[n] = self._least(of), of
        full = (words.counts >= shingle) & long_enough
        tiny = np.flatnonzero(full & (sizes <= most))
        if len(tiny):
            self.small[shingle] = self._least(tiny), tiny
        big = np.flatnonzero(full & (sizes > most))
        self.size = np.maximum(BASE, 2 ** np.ceil(np.log2(np.maximum(sizes, 1)))).astype(np.int64)
        starts = np.cumsum(sizes[big]) - sizes[big]
        whole = np.concatenate([s.sets[k] for k in big]) if len(big) else np.zeros(0, U64)
        self.minima = [np.minimum.reduceat(_hashed(whole, j), starts) for j in range(HASHES)] if len(big) else []
        self.big, self.maps, self.order = big, [], []
        for v in self.minima:
            seen = np.zeros(1 << 16, dtype=bool)
            seen[v & _LOW] = True
            self.maps.append(seen)
            self.order.append(np.argsort(v))


    def _least(self, of: np.ndarray) -> np.ndarray:
        return np.array([_hashed(self.sets[k], 0).min() for k in of], dtype=U64)


def _hashed(shingles: np.ndarray, j: int) -> np.ndarray:
    return (shingles ^ _XOR[j]) * _MUL[j]


def _candidates(items: Items, words: Words) -> set[tuple[int, int]]:
    """(row, item) pairs that share a band."""
    out: set[tuple[int, int]] = set()

    def lookup(values: np.ndarray, rows: np.ndarray, keys: np.ndarray, of: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        lo, hi = np.searchsorted(keys[order], values, "left"), np.searchsorted(keys[order], values, "right")
        for k in np.flatnonzero(hi > lo):
            out.update((int(rows[k]), int(of[j])) for j in order[lo[k] : hi[k]])

    for n, (keys, of) in items.small.items():
        g = grams(words.hash, n)
        inside = words.row[: len(g)] == words.row[n - 1 :] if len(g) else np.zeros(0, bool)
        lookup(_hashed(g[inside], 0), words.row[: len(g)][inside], keys, of)
    g = grams(words.hash, items.shingle)
    if not len(g):
        return out
    row = words.row[: len(g)]
    inside = row == words.row[items.shingle - 1 :]
    g, row = g[inside], row[inside]
    if not len(g):
        return out
    if not len(items.big):
        return out
    counts = np.bincount(row, minlength=words.rows)
    first, n_blocks = np.cumsum(counts) - counts, -(-counts // BASE)
    block_row = np.repeat(np.arange(words.rows), n_blocks)
    block_first = np.cumsum(n_blocks) - n_blocks
    at = np.repeat(first, n_blocks) + (np.arange(len(block_row)) - np.repeat(block_first, n_blocks)) * BASE
    for j in range(HASHES):
        minima = np.minimum.reduceat(_hashed(g, j), at)
        hits = np.flatnonzero(items.maps[j][minima & _LOW])
        if not len(hits):
            continue
        keys = items.minima[j][items.order[j]]
        lo, hi = np.searchsorted(keys, minima[hits], "left"), np.searchsorted(keys, minima[hits], "right")
        for b, x, y in zip(hits[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
            r = int(block_row[b])
            start, n = int(block_first[r]), int(n_blocks[r])
            for k in items.order[j][x:y].tolist():
                item = int(items.big[k])
                if (r, item) in out:
                    continue
                size = int(items.size[item])
                length, step = 2 * size // BASE, max(1, size // 2 // BASE)
                last = (b - start) // step * step
                for w in range(last, max(-1, b - start - length), -step):
                    if minima[start + w : start + min(n, w + length)].min() == minima[b]:
                        out.add((r, item))
                        break
    return out


def _matches(items: Items, texts: pa.Array, containment: float) -> list[tuple[int, int, int]]:
    """(row, item, shared shingles), verified."""
    words, found = Words(texts, fold=True), []
    sets: dict[tuple[int, int], np.ndarray] = {}
    for r, k in sorted(_candidates(items, words)):
        n = items.n_words.get(k, items.shingle)
        if (r, n) not in sets:
            sets[r, n] = np.unique(grams(words.hash[words.first[r] : words.first[r] + words.counts[r]], n))
        shared = overlap(items.sets[k], sets[r, n])
        if shared >= containment * len(items.sets[k]) - 1e-9:
            found.append((r, k, shared))
    return found


def _known(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """Items with a text: id, text and the text's digest."""
    known = items.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("t is not null")
    return known.withColumn("k", F.sha2(F.col("t"), 256))


def _item_blocks(known: DataFrame, shingle: int, containment: float, least_words: int) -> Iterator[Items]:
    """The distinct texts, some BLOCK_ITEMS and BLOCK_BYTES at a time."""
    texts = known.select("k", "t").dropDuplicates(["k"])
    total, count = texts.agg(F.sum(F.octet_length("t")), F.count("*")).first()
    n = max(-(-(total or 0) // BLOCK_BYTES), -(-count // BLOCK_ITEMS))
    for b in range(n):
        rows = texts.where(F.pmod(F.xxhash64("k"), F.lit(n)) == b).collect()
        if rows:
            rows.sort(key=lambda r: r.k)
            yield Items([r.k for r in rows], [r.t for r in rows], shingle, containment, least_words)


def find_leaks(docs: DataFrame, benchmark: DataFrame, containment: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least_words: int = 1) -> DataFrame:
    """(id_col, item_col, item_shingles, shared_shingles) of each document and item of least_words or more it contains."""
    docs = lean(docs)
    thin = docs.select(docs[id_col].cast("long").alias("_i"), docs[text_col].alias("_t"))
    schema = f"{id_col} long, k string, item_shingles long, shared_shingles long"

    def search(items: Items):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in blocks(batches, "_t"):
                found = _matches(items, b.column(1), containment)
                ids = b.column(0).take(pa.array([r for r, _, _ in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([items.ids[k] for _, k, _ in found], pa.string()), pa.array([len(items.sets[k]) for _, k, _ in found], pa.int64()), pa.array([s for _, _, s in found], pa.int64())], [id_col, "k", "item_shingles", "shared_shingles"])

        return thin.mapInArrow(run, schema)

    known, out = _known(benchmark, item_col, item_text_col), None
    for items in _item_blocks(known, shingle, containment, least_words):
        found = search(items)
        out = found if out is None else out.union(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], f"{id_col} long, {item_col} long, item_shingles long, shared_shingles long")
    return out.join(known.select("k", F.col("i").alias(item_col)), "k").select(id_col, item_col, "item_shingles", "shared_shingles")


def remove_leaks(docs: DataFrame, benchmark: DataFrame, containment: float = 0.8, shingle: int = 5, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least_words: int = 5) -> DataFrame:
    """The documents that contain no item of least_words or more, with all their columns. Shorter items would take
    every document that has a common word."""
    docs = lean(docs)
    for items in _item_blocks(_known(benchmark, item_col, item_text_col), shingle, containment, least_words):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for b in blocks(batches, text_col):
                clean = np.ones(b.num_rows, dtype=bool)
                clean[[r for r, _, _ in _matches(items, b.column(b.schema.get_field_index(text_col)), containment)]] = False
                yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs

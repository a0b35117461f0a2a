"""Token-id files: canonical length-limited Huffman codes from global counts, decoded by table in independent blocks.

A file set is a folder of three Parquet tables. ``code`` has one row: the format's version, the limit, the end id
and one code length for each id (canonical codes follow from the lengths). ``segments`` has one row for about a
million ids: ``part`` and ``offset`` place it (ids of the same part before it), and ``payload`` is the segment:
magic ``TFH1``, counts, document index, bit offsets of every block of ``BLOCK`` ids, then the bits. Each block can
be decoded alone from its checkpoint. ``parts`` has the number of ids of each part and before it.

The ids are the library's for the whole text, its added tokens included (``specials_as_text``: their strings are then
ordinary text). Null texts count as empty (the end id alone); a very long text is encoded whole and may fill a segment
of its own. Null document ids come first; equal document ids keep one order, by a hash of their ids, and repeated rows
are written as often as they occur; an empty table gives an empty file set. Other columns are not read, whatever
their names.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidefold.llm.columnar import Memo, Pieces, blocks, flat, ragged
from tidefold.llm.shared import dropped, fresh_dir, lean

MAGIC, VERSION, BLOCK, SEGMENT = b"TFH1", 1, 1024, 1 << 20
#: Pieces of these characters alone are what the tokenizer's split leaves; others go to the library as they are.
PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+")


class WordEncoder:
    """The tokenizers library over whole texts, with ids of white-space separated words reused.

    The tokenizer drops white space and treats what lies between alone, so a text's ids are those of its words.
    """

    def __init__(self, path: str, specials_as_text: bool = False):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = specials_as_text
        spec = json.loads(self.whole.to_str())
        suffix = spec["model"].get("end_of_word_suffix") or ""
        vocab = self.whole.get_vocab()
        self.size = max(vocab.values()) + 1
        self.ends = np.zeros(self.size, dtype=bool)
        self.ends[[i for t, i in vocab.items() if suffix and t.endswith(suffix)]] = True
        split = next((p["pattern"]["Regex"] for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "Split"), "")
        added = spec.get("added_tokens") or []
        #: Strings that the library looks for in a text as it is; texts that have one go to the library whole.
        self.added = [t["content"].encode() for t in added if not (specials_as_text and t["special"])]
        #: The short cut holds for this pattern and word ends only, and for added tokens that are sought before anything else.
        self.cut = bool(suffix) and split == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" and '"Lowercase"' in json.dumps(spec["normalizer"]) and not any(t["normalized"] for t in added)
        self.bare = Tokenizer(self.whole.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.memo = Memo(self._words)

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<i4") for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words: pieces that the tokenizer's split leaves whole go to its model in groups, others alone."""
        plain = np.array([PLAIN.fullmatch(w) is not None for w in words], dtype=bool)
        pieces, ids, lens = [w.lower() for w, p in zip(words, plain.tolist()) if p], [], np.zeros(len(words), dtype=np.int64)
        found = []
        for at in range(0, len(pieces), 256):
            some = pieces[at : at + 256]
            got = np.array(self.bare.encode("\n".join(some), add_special_tokens=False).ids, dtype="<i4")
            stops = np.flatnonzero(self.ends[got]) + 1
            if len(stops) == len(some) and stops[-1] == len(got):
                ids.append(got)
                found.append(np.diff(stops, prepend=0))
            else:
                ids += (alone := self._plain(some))
                found.append(np.array([len(x) for x in alone]))
        if found:
            lens[plain] = np.concatenate(found)
        if plain.all():
            return np.concatenate(ids), lens
        odd = self._plain([w for w, p in zip(words, plain.tolist()) if not p])
        lens[~plain] = [len(x) for x in odd]
        pool, n = np.concatenate([*ids, *odd]), len(words)
        at = np.empty(n, dtype=np.int64)
        for mask, base in ((plain, 0), (~plain, sum(map(len, ids)))):
            at[mask] = base + np.cumsum(lens[mask]) - lens[mask]
        return pool[ragged(at, lens)], lens

    def _marked(self, texts: pa.Array) -> np.ndarray:
        """Rows that have an added token's string."""
        raw, at = flat(texts)
        whole, rows = raw.tobytes(), set()
        for token in self.added:
            k = whole.find(token)
            while k >= 0:
                r = int(np.searchsorted(at, k, side="right")) - 1
                if k + len(token) <= at[r + 1]:
                    rows.add(r)
                k = whole.find(token, k + 1)
        return np.array(sorted(rows), dtype=np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and how many each has."""
        if not self.cut:
            ids = self._plain([t or "" for t in texts.to_pylist()])
            return np.concatenate(ids) if ids else np.zeros(0, np.int32), np.array([len(x) for x in ids], dtype=np.int64)
        marked = self._marked(texts)
        if not len(marked):
            return self.memo.tokens(Pieces(texts))
        kept = np.ones(len(texts), dtype=bool)
        kept[marked] = False
        ids, counts = self.memo.tokens(Pieces(pc.if_else(pa.array(kept), texts, pa.scalar(None, texts.type))))
        own = self._plain(texts.take(pa.array(marked)).to_pylist())
        at, counts[marked] = np.cumsum(counts) - counts, [len(x) for x in own]
        at[marked] = len(ids) + np.cumsum(counts[marked]) - counts[marked]
        return np.concatenate((ids, *own))[ragged(at, counts)], counts


@functools.lru_cache(maxsize=2)
def word_encoder(path: str, specials_as_text: bool = False) -> WordEncoder:
    return WordEncoder(path, specials_as_text)


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``limit`` bits (package-merge); 0 for ids that never occur."""
    used = np.flatnonzero(counts)
    lens = np.zeros(len(counts), dtype=np.uint8)
    n = len(used)
    if n <= 1:
        lens[used] = 1
        return lens
    if n > 1 << limit:
        raise ValueError(f"{n} ids do not fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        both = np.concatenate((weights, packages))
        at = np.argsort(both, kind="stable")
        levels.append(at < n)
        merged = both[at]
        packages = merged[0 : len(merged) // 2 * 2 : 2] + merged[1::2]
    take = 2 * (n - 1)
    for is_id in reversed(levels):
        ids = int(np.count_nonzero(is_id[:take]))
        lens[order[:ids]] += 1
        take = 2 * (take - ids)
    return lens


class Code:
    """Canonical codes from lengths, and the decoding table."""

    def __init__(self, lens: np.ndarray):
        self.lens = lens.astype(np.uint8)
        used = np.flatnonzero(lens)
        self.limit = int(lens.max()) if len(used) else 1
        order = used[np.lexsort((used, lens[used]))]
        width = np.int64(1) << (self.limit - lens[order].astype(np.int64))
        first = np.cumsum(width) - width
        self.codes = np.zeros(len(lens), dtype=np.uint64)
        self.codes[order] = (first >> (self.limit - lens[order].astype(np.int64))).astype(np.uint64)
        self.symbol = np.zeros(1 << self.limit, dtype=np.int32)
        filled = np.repeat(order, width)
        self.symbol[: len(filled)] = filled
        self.length = self.lens[self.symbol].astype(np.int64)

    def pack(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits of all ids, and the bit offset of every BLOCK-th id."""
        n = self.lens[ids].astype(np.int64)
        ends = np.cumsum(n)
        starts = ends - n
        words = (int(ends[-1]) + 31) // 32 + 1 if len(ids) else 1
        at = starts >> 5
        wide = self.codes[ids] << (64 - (starts & 31) - n).astype(np.uint64)
        bits = np.bincount(at, weights=(wide >> np.uint64(32)).astype(np.float64), minlength=words + 1) + np.bincount(at + 1, weights=(wide & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=words + 1)
        return bits[:words].astype(">u4").tobytes(), starts[::BLOCK].astype("<u4")

    def unpack(self, raw: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """All ids: one step decodes one id of every block."""
        bits = np.append(np.frombuffer(raw, dtype=">u4").astype(np.uint64), np.zeros(2, np.uint64))
        wide = bits[:-1] << np.uint64(32) | bits[1:]
        pos, out = checkpoints.astype(np.int64), np.zeros((min(BLOCK, n), len(checkpoints)), dtype=np.int32)
        shift = np.uint64(64 - self.limit)
        for k in range(len(out)):
            if k == n % BLOCK and n > BLOCK:
                pos = pos[:-1]  # the last block is shorter
            v = (wide[pos >> 5] << (pos & 31).astype(np.uint64)) >> shift
            out[k, : len(pos)] = self.symbol[v]
            pos = pos + self.length[v]
        return out.T.ravel()[:n]


def pack_segment(code: Code, doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    bits, marks = code.pack(ids)
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    index = zlib.compress(np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes() + known.tobytes() + counts.astype("<u4").tobytes(), 1)
    return MAGIC + struct.pack("<IIIII", len(doc_ids), len(ids), len(index), len(marks), len(bits)) + index + marks.tobytes() + bits


def unpack_segment(code: Code, raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, counts and ids of a segment."""
    if raw[:4] != MAGIC:
        raise ValueError("not a segment")
    docs, n, index, marks, bits = struct.unpack("<IIIII", raw[4:24])
    at = zlib.decompress(raw[24 : 24 + index])
    keys, known = np.frombuffer(at, "<i8", docs).tolist(), np.frombuffer(at, "u1", docs, 8 * docs).tolist()
    counts = np.frombuffer(at, "<u4", docs, 9 * docs).astype(np.int64)
    ids = code.unpack(raw[24 + index + 4 * marks : 24 + index + 4 * marks + bits], np.frombuffer(raw, "<u4", marks, 24 + index), n)
    return [k if there else None for k, there in zip(keys, known)], counts, ids


def write(df: DataFrame, path: str, tokenizer: str, end_id: int = 2, limit: int = 18, id_col: str = "doc_id", text_col: str = "text", specials_as_text: bool = False) -> None:
    """Encode each text with the tokenizer, append ``end_id`` and write the file set in ascending id_col order.

    The texts are tokenised once, into a table of packed ids that also holds every task's counts of ids (so a task
    that runs again counts once); the global counts give the code; the packed ids alone are shuffled into order.
    """
    df = lean(df)
    spark = df.sparkSession
    tokens = fresh_dir(spark, "tokens")

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, zip_ = word_encoder(tokenizer, specials_as_text), zstandard.ZstdCompressor(3)
        total = np.zeros(max(encoder.size, end_id + 1), dtype=np.int64)
        for b in blocks(batches, "_t"):
            ids, counts = encoder.encode(b.column(1))
            ends = np.cumsum(counts)
            out = np.insert(ids, ends, end_id)
            total += np.bincount(out, minlength=len(total))
            wire, stops = out.astype("<u4" if len(total) > 65536 else "<u2").tobytes(), (ends + np.arange(1, len(ends) + 1)).tolist()
            w = 4 if len(total) > 65536 else 2
            packed = [zip_.compress(wire[w * (e - n - 1) : w * e]) for e, n in zip(stops, counts.tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts + 1), pa.array(packed, pa.binary()), pa.array([False] * len(packed))], ["doc_id", "n", "ids", "is_count"])
        used = np.flatnonzero(total)
        blob = zstandard.compress(used.astype("<u4").tobytes() + total[used].astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([len(used)], pa.int64()), pa.array([blob], pa.binary()), pa.array([True])], ["doc_id", "n", "ids", "is_count"])

    df.select(df[id_col].cast("long").alias("_i"), df[text_col].alias("_t")).mapInArrow(tokenise, "doc_id long, n long, ids binary, is_count boolean").write.option("compression", "none").parquet(tokens)
    packed = spark.read.parquet(tokens)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(0).to_pylist():
                raw = zstandard.decompress(blob)
                n = len(raw) // 12
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(raw, "<u4", n).astype(np.int64)), pa.array(np.frombuffer(raw, "<i8", n, 4 * n))], ["id", "n"])

    # At most one row for each id of the vocabulary comes to the driver.
    rows = packed.where("is_count").select("ids").mapInArrow(counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    totals = np.zeros(max((r.id for r in rows), default=0) + 1, dtype=np.int64)
    for r in rows:
        totals[r.id] = r.n
    lens = code_lengths(totals, limit)
    spark.range(1, numPartitions=1).select(F.lit(VERSION).alias("version"), F.lit(limit).alias("max_bits"), F.lit(end_id).alias("end_id"), F.lit(lens.tobytes()).alias("lengths")).write.parquet(f"{path}/code")
    wide = len(totals) > 65536 or end_id > 65535
    lengths = lens.tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, unzip, part = Code(np.frombuffer(lengths, np.uint8)), zstandard.ZstdDecompressor(), TaskContext.get().partitionId()
        offset, held, docs, counts, n = 0, [], [], [], 0
        names = ["part", "offset", "n_tokens", "n_docs", "payload"]

        def segment() -> pa.RecordBatch:
            raw = pack_segment(code, docs, np.array(counts), np.frombuffer(b"".join(held), "<u4" if wide else "<u2"))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([offset]), pa.array([n]), pa.array([len(docs)]), pa.array([raw], pa.binary())], names)

        for b in batches:
            for d, k, blob in zip(*(b.column(i).to_pylist() for i in range(3))):
                docs.append(d)
                counts.append(k)
                held.append(unzip.decompress(blob))
                n += k
                if n >= SEGMENT:
                    yield segment()
                    offset, held, docs, counts, n = offset + n, [], [], [], 0
        if docs:
            yield segment()

    ordered = packed.where("not is_count").select("doc_id", "n", "ids").withColumn("tie", F.xxhash64("ids"))
    ordered = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    ordered.mapInArrow(pack, "part int, offset long, n_tokens long, n_docs long, payload binary").write.option("compression", "none").parquet(f"{path}/segments")
    dropped(spark, tokens)
    parts = spark.read.parquet(f"{path}/segments").groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"))
    # One row for each task of the shuffle above.
    parts.withColumn("before", F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).write.parquet(f"{path}/parts")


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Decode a file set: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as
    little-endian unsigned 32-bit integers), and the ids themselves if asked for."""
    lengths = bytes(spark.read.parquet(f"{path}/code").first()["lengths"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(np.frombuffer(lengths, np.uint8))
        for b in batches:
            for part, offset, raw in zip(*(b.column(i).to_pylist() for i in range(3))):
                docs, counts, ids = unpack_segment(code, raw)
                wire, ends = ids.astype("<u4").tobytes(), np.cumsum(counts)
                crc = [zlib.crc32(wire[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist())]
                cols = [pa.array([part] * len(docs), pa.int32()), pa.array(docs, pa.int64()), pa.array(offset + ends - counts), pa.array(counts), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids)))
                yield pa.RecordBatch.from_arrays(cols, ["part", "doc_id", "at", "n_tokens", "ids_crc32", *["token_ids"] * with_ids])

    rows = spark.read.parquet(f"{path}/segments").select("part", "offset", "payload").mapInArrow(unpack, "part int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", token_ids array<int>" * with_ids)
    parts = spark.read.parquet(f"{path}/parts").select("part", "before")
    return rows.join(F.broadcast(parts), "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["token_ids"] * with_ids)

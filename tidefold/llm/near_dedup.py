"""Near-duplicates by SetSketch registers: banding, joint likelihood, exact verification, components.

A sketch has ``registers`` values: exponentially spaced truncated minima of hashes of a text's shingles (base
``BASE``, rate ``RATE``), which merge by maximum and agree in a register with about the probability of the
Jaccard similarity. Bands of ``band_rows`` equal register values propose candidates; the likelihood of the counts
of greater, smaller and equal registers, given both set sizes, drops a pair only if similarity at the threshold is
``exp(CERTAIN)`` times less likely than the best estimate; what is left is decided on the full shingle sets.

Texts of equal sets are one node, so exact copies cost nothing. No bucket's pairs are all listed. First its least
node, the pivot, is compared with all other members, and components are formed. What is left are buckets whose
members, the pivot aside, lie in several components: there every member outside the largest component is compared
with all members of other components. In buckets of up to ``SMALL`` nodes these pairs are listed, each once for all
buckets; in larger ones such members and all members are dealt out to blocks of bounded size. In a block too the
registers are compared first, the likelihood of their counts decides which pairs are in question, and these alone
are decided on the full sets. Up to ``LISTED`` for each member they are listed, each once for all buckets; where a block
has more, its members are dealt out again with their sets, and one matrix product decides. So of a block's pairs few or
only links come out, no link that shares a bucket is lost, whatever the bucket's size, and no task holds more than two
blocks. The work in a large bucket still grows with the product of its members and of those outside its largest
component.

Shingles are read from the texts only for pairs in question: first two bytes of each, which share at least as much as
the sets do and end most pairs, then the whole sets of the pairs that are left.

What is joined with an aggregate of itself is joined with that aggregate as a written table, so adaptive execution can
split the joins of hot keys. Tables are removed once nothing reads them; the result reads two of them.

Null and empty texts have the empty set: no links, their own component. Very long texts are sketched and compared
whole, in batches of their own. Documents of equal ids are judged by their texts, so repeated rows are copies of each
other; null ids link as others do, and a component's id is its least id that is not null. An empty table gives no
rows. Other columns are unread, whatever their names, and pass through ``deduplicated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.llm.columnar import U64, Shingles, Words, blocks, mix, overlap, runs
from tidefold.llm.components import components
from tidefold.llm.shared import forget, lean, unused, written

BASE, RATE, TOP, CERTAIN = 1.001, 20.0, 65535, 20.0
#: Nodes of a small bucket; nodes and shingles of a block; tasks that a large bucket's members are spread over; pairs
#: in question for each member of a block, up to which they are listed.
SMALL, BLOCK_NODES, BLOCK_SHINGLES, SALTS, LISTED = 32, 512, 1 << 20, 16, 4
#: Large tables are sifted by a Bloom filter of the keys that they are joined with, where those are few.
SIFTED = {"spark.sql.optimizer.runtime.bloomFilter.enabled": "true", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "32m", "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1g"}
_rng = np.random.default_rng(1511)
_XOR = _rng.integers(0, 2**63, 1024, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_MUL = _rng.integers(0, 2**63, 1024, dtype=np.int64).astype(U64) * U64(2) + U64(1)


def sketches(s: Shingles, registers: int) -> np.ndarray:
    """Registers (uint16) of every row; rows without shingles are 0."""
    out = np.zeros((len(s.sizes), registers), dtype=np.uint16)
    some = np.flatnonzero(s.sizes)
    if len(some):
        least = np.empty((len(some), registers))
        for j in range(registers):
            least[:, j] = np.minimum.reduceat((s.all ^ _XOR[j]) * _MUL[j], s.first[some])
        x = -np.log1p(-(least + 0.5) / 2.0**64) / RATE
        out[some] = np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / np.log(BASE)), 0, TOP)
    return out


def likely(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, least: float) -> np.ndarray:
    """Whether a similarity of ``least`` is still in question for pairs of sketches of sets of known sizes."""
    above, below = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - above - below
    u = n_a / (n_a + n_b)
    v = 1 - u

    def log_likelihood(j: np.ndarray) -> np.ndarray:
        q, r = _differs(u - v * j), _differs(v - u * j)
        return above * np.log(np.maximum(q, 1e-12)) + below * np.log(np.maximum(r, 1e-12)) + equal * np.log(np.maximum(1 - q - r, 1e-12))

    top = np.minimum(u / v, v / u)
    lo, hi = np.zeros_like(top), top.copy()
    for _ in range(40):  # the likelihood has one maximum
        x, y = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        left = log_likelihood(x) > log_likelihood(y)
        hi, lo = np.where(left, y, hi), np.where(left, lo, x)
    best = (lo + hi) / 2
    return (best >= least) | (log_likelihood(best) - log_likelihood(np.minimum(least, top)) < CERTAIN)


def in_question(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Which of all pairs of two blocks of sketches may reach the similarity: those that ``likely`` keeps, after a
    bound that drops most others. The bound is the best likelihood that any probabilities could have."""
    above = np.zeros((len(a), len(b)), dtype=np.int16)
    below = np.zeros_like(above)
    for k in range(a.shape[1]):
        x, y = a[:, k, None], b[None, :, k]
        above += x > y
        below += x < y
    n = a.shape[1]
    shares = np.log(np.maximum(np.arange(n + 1), 1) / n) * np.arange(n + 1)
    size_a, size_b = np.broadcast_to(n_a[:, None], above.shape), np.broadcast_to(n_b[None, :], above.shape)
    out = np.minimum(size_a, size_b) * 100 >= np.maximum(size_a, size_b) * percent
    i, j = np.nonzero(out)
    more, less, least = above[i, j].astype(np.int64), below[i, j].astype(np.int64), percent / 100
    u = size_a[i, j] / (size_a[i, j] + size_b[i, j])
    q, r = _differs(u - (1 - u) * least), _differs(1 - u - u * least)
    at_least = more * np.log(np.maximum(q, 1e-12)) + less * np.log(np.maximum(r, 1e-12)) + (n - more - less) * np.log(np.maximum(1 - q - r, 1e-12))
    bound = shares[more] + shares[less] + shares[n - more - less]
    # Fewer differences than expected at the least similarity: the estimate is above it.
    out[i, j] = (more + less <= n * (q + r)) | (bound - at_least < CERTAIN)
    i, j = np.nonzero(out)
    for at in range(0, len(i), 1 << 14):
        x, y = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
        out[x, y] = likely(a[x], b[y], n_a[x].astype(np.float64), n_b[y].astype(np.float64), least)
    return out


def _differs(x: np.ndarray) -> np.ndarray:
    """Probability that a register is greater on one side, from that side's share of its own elements."""
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


def _node(s: Shingles) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell a set: two sums of its hashes."""
    out = np.zeros((len(s.sizes), 2), dtype=U64)
    some = np.flatnonzero(s.sizes)
    if len(some):
        out[some, 0] = np.add.reduceat(mix(s.all), s.first[some])
        out[some, 1] = np.add.reduceat(mix(s.all ^ U64(0x5851F42D4C957F2D)), s.first[some])
    return out.astype("<u8"), some


def _binary(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows).tobytes())]).cast(pa.binary())


def shared_counts(a: list[np.ndarray], b: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of every set of a with every set of b."""
    both = [*a, *b]
    values = np.concatenate(both)
    row = np.repeat(np.arange(len(both)), [len(x) for x in both])
    order = np.argsort(values)
    starts, lens = runs(values[order])
    column = np.repeat(np.cumsum(lens > 1) - 1, lens)
    keep = np.repeat(lens > 1, lens)  # what one set alone has is in no intersection
    row, column = row[order][keep], column[keep]
    out = np.zeros((len(a), len(b)), dtype=np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, (at, at + width))
        m = np.zeros((len(both), width), dtype=np.float32)
        m[row[lo:hi], column[lo:hi] - at] = 1
        out += m[: len(a)] @ m[len(a) :].T
    return out


def marks(own: np.ndarray) -> np.ndarray:
    """Two bytes of every shingle, sorted: what two sets share, their marks share too."""
    return np.sort(own.astype("<u2"))


def shared_marks(a: np.ndarray, b: np.ndarray) -> int:
    """Marks that both have, each as often as in the one that has it less often; never less than the shingles shared."""

    def told_apart(x: np.ndarray) -> np.ndarray:
        starts, lens = runs(x)
        return (x.astype(np.int64) << 32) + np.arange(len(x)) - np.repeat(starts, lens)

    return overlap(told_apart(a), told_apart(b))


def _keyed(df: DataFrame, id_col: str, text_col: str, row: str = "_row", hash_: str = "_hash") -> DataFrame:
    return df.withColumn(hash_, F.xxhash64(text_col)).withColumn(row, F.coalesce(F.col(id_col).cast("long"), F.col(hash_)))


def grouped(df: DataFrame, shingle: int, percent: int, registers: int = 128, band_rows: int = 4, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, row, hash, n, node) of all documents, and (node, comp, component_id, n_copies) of all nodes."""
    df = lean(df, SIFTED)
    keyed = _keyed(df.select(df[id_col], df[text_col]), id_col, text_col)
    thin = keyed.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col("_row").alias("row"), F.col("_hash").alias("hash"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            s = Shingles(Words(b.column(3), fold=True), shingle)
            node, _ = _node(s)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(s.sizes), _binary(node), _binary(sketches(s, registers))], ["doc_id", "row", "hash", "n", "node", "sketch"])

    sketched = written(thin.select("doc_id", "row", "hash", "text").mapInArrow(sketch, "doc_id long, row long, hash long, n long, node binary, sketch binary"), "sketches")
    # A node's number stands for it in buckets, pairs and components: half the bytes of its 128 bits.
    nodes = sketched.where("n > 0").groupBy("node").agg(F.min("row").alias("row"), F.min("n").alias("n"), F.min("sketch").alias("sketch"), F.min("doc_id").alias("least"), F.count("*").alias("n_copies"))
    nodes = written(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    rows = written(sketched.drop("sketch"), "rows")
    forget(sketched)
    bands = registers // band_rows

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                regs = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.uint16).reshape(b.num_rows, bands, band_rows).astype(U64)
                key = np.zeros(regs.shape[:2], dtype=U64) + np.arange(1, bands + 1, dtype=U64)
                for k in range(band_rows):
                    key = mix(key * U64(0x9E3779B97F4A7C15) + regs[:, :, k])
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), bands)))], ["key", "id"])

    banded = nodes.select("id", "sketch").mapInArrow(band, "key long, id long")
    shared = written(banded.groupBy("key").agg(F.count("*").alias("c"), F.min("id").alias("pivot")).where("c > 1").select("key", "pivot"), "buckets")
    members = written(banded.join(shared, "key"), "members")

    def ends(prefix: str, *columns: str) -> DataFrame:
        return nodes.select(F.col("id").alias(prefix), *(F.col(c).alias(c + prefix) for c in columns))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                n_u, n_v = (b.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in (2, 3))
                k_u, k_v = (np.frombuffer(b"".join(b.column(c).to_pylist()), dtype=np.uint16).reshape(b.num_rows, -1) for c in (4, 5))
                keep = pa.array(likely(k_u, k_v, n_u, n_v, percent / 100))
                yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["u", "v"])

    def sifted(pairs: DataFrame) -> DataFrame:
        """Those of the pairs whose sizes and registers leave a link in question; no shingle is moved for the others."""
        sized = pairs.join(ends("u", "n"), "u").join(ends("v", "n"), "v").where(F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * percent)
        return sized.join(ends("u", "sketch"), "u").join(ends("v", "sketch"), "v").select("u", "v", "nu", "nv", "sketchu", "sketchv").mapInArrow(sift, "u long, v long")

    def both_ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("u").alias("id")).union(pairs.select("v"))

    def by_texts(ids: DataFrame, name: str, value) -> DataFrame:
        """(id, own) of the nodes: a value of the shingles of their texts."""

        def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in blocks(batches, "text"):
                s = Shingles(Words(b.column(0), fold=True), shingle)
                node, _ = _node(s)
                yield pa.RecordBatch.from_arrays([_binary(node), pa.array([value(x).tobytes() for x in s.sets], pa.binary())], ["node", "own"])

        wanted = written(nodes.select("id", "node", "row").join(ids.distinct(), "id", "left_semi"), "wanted")
        # The condition holds for all numbers; beside one, Spark sifts the texts by a Bloom filter before it deals them out.
        texts = thin.join(wanted.where("id >= 0").select("row"), "row", "left_semi").select("text")
        out = written(texts.mapInArrow(full, "node binary, own binary").dropDuplicates(["node"]).join(wanted, "node").select("id", "own"), name, "lz4")
        forget(wanted)
        return out

    def reach(pairs: DataFrame, values: DataFrame, dtype: str, common) -> DataFrame:
        """Pairs whose values have enough in common for a link."""

        def enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    keep = []
                    for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                        x, y = np.frombuffer(x, dtype=dtype), np.frombuffer(y, dtype=dtype)
                        same = common(x, y)
                        keep.append(100 * same >= percent * (len(x) + len(y) - same))
                    yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep)), b.column(1).filter(pa.array(keep))], ["u", "v"])

        left = values.select(F.col("id").alias("u"), F.col("own").alias("su"))
        right = values.select(F.col("id").alias("v"), F.col("own").alias("sv"))
        return pairs.join(left, "u").join(right, "v").select("u", "v", "su", "sv").mapInArrow(enough, "u long, v long")

    def marked(pairs: DataFrame) -> DataFrame:
        """The pairs whose marks do not rule out a link. Marks are a quarter of the shingles' bytes, and most pairs in
        question end here; what is left is decided on the full sets."""
        own = by_texts(both_ends(pairs), "marks", marks)
        out = written(reach(pairs, own, "<u2", shared_marks), "close")
        forget(own)
        return out

    def sets_of(ids: DataFrame) -> DataFrame:
        return by_texts(ids, "sets", lambda x: x)

    def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        return reach(pairs, sets, "<u8", overlap)

    def pair(x: str, y: str) -> list:
        return [F.greatest(x, y).alias("u"), F.least(x, y).alias("v")]

    aimed = members.where("id != pivot")
    asked = written(sifted(aimed.select(*pair("id", "pivot")).distinct()), "asked")
    forget(shared)
    close = marked(asked)
    sets = sets_of(both_ends(close))
    stars = components(linked(close, sets))
    forget(asked, close, sets)
    label = written(stars.select(F.col("node").alias("id"), F.col("component").alias("comp")), "labels")
    forget(stars)

    now = aimed.select("key", "id").join(label, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    parts = now.groupBy("key", "comp").agg(F.count("*").alias("c"))
    open_ = parts.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("size"), F.count("*").alias("n_comps")).where("n_comps > 1")
    open_ = written(open_.select("key", "size", (F.col("size") - F.col("top.c")).alias("n_alone"), F.col("top.comp").alias("main")), "open-buckets")
    rest = written(now.join(open_, "key").withColumn("alone", F.col("comp") != F.col("main")), "open")
    forget(members, open_)
    few = rest.where(F.col("size") <= SMALL)
    alone = few.where("alone").select("key", F.col("id").alias("other"), F.col("comp").alias("to"))
    listed = written(sifted(few.join(alone, "key").where("comp != to").select(*pair("id", "other")).distinct()), "asked")

    of = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n))
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1)

    def dealt(members: DataFrame, *columns: str) -> DataFrame:
        """Both sides of all blocks (key, x, y) of large buckets, cut into ``a`` and ``m`` parts."""
        in_first = F.transform(every("m"), lambda y: F.struct(of("a", 1).alias("x"), y.alias("y")))
        in_second = F.transform(every("a"), lambda x: F.struct(x.alias("x"), of("m", 2).alias("y")))
        return members.withColumn("cell", F.explode(F.when(F.col("first"), in_first).otherwise(in_second))).select("key", "cell.x", "cell.y", "first", "id", "comp", *columns)

    def asked_in(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of both sides of a block, and which of their pairs are in question."""
        first, comp, n = (t.column(c).to_numpy() for c in ("first", "comp", "n"))
        regs = np.frombuffer(b"".join(t.column("sketch").to_pylist()), dtype=np.uint16).reshape(t.num_rows, -1)
        a, b = np.flatnonzero(first), np.flatnonzero(~first)
        if not len(a) or not len(b):
            return a[:0], b[:0], np.zeros((0, 0), dtype=bool)
        asked = in_question(regs[a], regs[b], n[a], n[b], percent) & (comp[a][:, None] != comp[b][None, :])
        return a[asked.any(axis=1)], b[asked.any(axis=0)], asked[asked.any(axis=1)][:, asked.any(axis=0)]

    def ask(t: pa.Table) -> pa.Table:
        """The pairs in question of a block, or their members where the pairs are many."""
        a, b, asked = asked_in(t)
        if asked.sum() <= LISTED * (len(a) + len(b)):
            i, j = np.nonzero(asked)
            ids = t.column("id").to_numpy()
            x, y = ids[a[i]], ids[b[j]]
            a = b = a[:0]
        else:
            x = y = np.zeros(0, dtype=np.int64)
        out = t.select(["key", "id", "comp", "first", "n"]).take(pa.array(np.concatenate((a, b))))
        pairs = pa.table({"u": pa.array(np.maximum(x, y)), "v": pa.array(np.minimum(x, y))})
        return pa.concat_tables([out, pairs], promote_options="default").select(["key", "id", "comp", "first", "n", "u", "v"])

    def block(t: pa.Table) -> pa.Table:
        comp = t.column("comp").to_numpy()
        a, b, asked = asked_in(t)
        found = np.zeros((0, 2), dtype=np.int64)
        if len(a):
            own, n = t.column("own"), t.column("n").to_numpy()
            same = shared_counts(*([np.frombuffer(own[int(k)].as_py(), dtype=U64) for k in side] for side in (a, b))).astype(np.int64)
            i, j = np.nonzero(asked & (100 * same >= percent * (n[a][:, None] + n[b][None, :] - same)))
            found = np.unique(np.sort(np.stack((comp[a[i]], comp[b[j]]), axis=1), axis=1), axis=0)
        return pa.table({"u": pa.array(found[:, 1]), "v": pa.array(found[:, 0])})

    # Large buckets: first the registers alone are dealt out. Pairs in question join those of small buckets; where a
    # block has many, its members that have one are dealt out again, with their sets.
    many = rest.where(F.col("size") > SMALL).withColumn("a", F.ceil(F.col("n_alone") / BLOCK_NODES)).withColumn("m", F.ceil(F.col("size") / BLOCK_NODES)).join(nodes.select("id", "n", "sketch"), "id")
    sides = many.withColumn("first", F.explode(F.when(F.col("alone"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))))
    dense = written(dealt(sides, "n", "sketch").groupBy("key", "x", "y").applyInArrow(ask, "key long, id long, comp long, first boolean, n long, u long, v long").distinct(), "dense")
    asked = written(listed.union(dense.where("u is not null").select("u", "v")).distinct(), "asked")
    forget(rest, listed)
    close = marked(asked)
    many = dense.where("id is not null").drop("u", "v")
    sets = sets_of(both_ends(close).union(many.select("id")))
    span = many.groupBy("key").agg(*(F.greatest(F.lit(1), F.ceil(F.sum(F.when(x, 1)) / BLOCK_NODES), F.ceil(F.sum(F.when(x, F.col("n"))) / BLOCK_SHINGLES)).cast("int").alias(n) for x, n in ((F.col("first"), "a"), (~F.col("first"), "m"))))
    # A key's members are spread over SALTS tasks to meet its counts: one bucket may hold a large share of all nodes.
    span = span.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    many = many.join(sets.join(nodes.select("id", "sketch"), "id"), "id").withColumn("salt", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(SALTS))).join(span, ["key", "salt"])
    late = linked(close, sets).union(dealt(many, "n", "own", "sketch").groupBy("key", "x", "y").applyInArrow(block, "u long, v long").distinct())
    of_u = label.select(F.col("id").alias("u"), F.col("comp").alias("cu"))
    of_v = label.select(F.col("id").alias("v"), F.col("comp").alias("cv"))
    joined = late.join(of_u, "u", "left").join(of_v, "v", "left").select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"))
    both = components(joined)
    more = written(both.select(F.col("node").alias("comp"), F.col("component").alias("least")), "merged")
    forget(asked, close, dense, sets, both)
    old = label.join(more, "comp", "left").select("id", F.coalesce("least", "comp").alias("comp"))
    new = more.join(label.select(F.col("id").alias("comp")), "comp", "left_anti").select(F.col("comp").alias("id"), F.col("least").alias("comp"))
    last = written(old.union(new), "labels")
    forget(label, more)
    found = nodes.select("node", "id", "least", "n_copies").join(last, "id", "left").select("node", F.coalesce("comp", "id").alias("comp"), "least", "n_copies")
    found = written(found, "found")
    forget(last, nodes)
    firsts = written(found.groupBy("comp").agg(F.min("least").alias("component_id")), "components")
    back = written(found.join(firsts, "comp").select("node", "comp", "component_id", "n_copies"), "nodes")
    forget(found, firsts)
    return rows, back


def near_duplicates(df: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id (long), n_shingles, component_id, kept (id = component_id), n_copies of its
    very shingle set.

    Texts are linked when 100 * intersection >= percent * union of their sets of word n-grams. At 80 percent, 32
    bands of 4 registers miss a link with a probability of 5e-8.
    """
    rows, found = grouped(df, shingle, percent, id_col=id_col, text_col=text_col)
    out = rows.where("n > 0").select("doc_id", "n", "node").join(found, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_copies")
    out = out.union(rows.where("n = 0").select("doc_id", F.lit(0).cast("long"), "doc_id", F.lit(1).cast("long")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def deduplicated(df: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The frame with one document of each group: the one of least id, null ids last. Texts without words stay."""
    df = lean(df)
    rows, found = grouped(df, shingle, percent, id_col=id_col, text_col=text_col)
    first = rows.where("n > 0").join(found.select("node", "comp"), "node").groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("a"), "row", "hash")).alias("m"))
    row, hash_ = unused(df, "row"), unused(df, "hash")
    keep = first.select(F.col("m.row").alias(row), F.col("m.hash").alias(hash_))
    wordless = F.coalesce(~F.col(text_col).rlike("[^\\x20\\x09-\\x0D]"), F.lit(True))
    chosen = _keyed(df.where(~wordless), id_col, text_col, row, hash_).join(keep, [row, hash_], "left_semi").dropDuplicates([row, hash_])
    return chosen.drop(row, hash_).union(df.where(wordless))

"""Language ID by rank-order profiles.

A text's letters (lower case; all else is one boundary) give n-grams of one to three characters. A language's
profile is the ``TOP`` most frequent n-grams of all its training texts; a text's own most frequent n-grams are
compared with each profile by out-of-place distance: the sum of differences of ranks, ``TOP`` for an n-gram that
the profile lacks. The nearest profile wins, the lesser name on ties. The score is one minus the distance's share
of the greatest possible one. Equal counts rank by the n-gram's code.

Null texts and texts without a letter are ``und`` with score 0, as is everything if nothing could be learned.
``keep`` asks for more than the nearest profile: foreign and gibberish texts have one too. ``calibrate`` takes the
least score that a text of a language and length may have from the training rows' own scores: ``SHARE`` of their
quantile ``LOW``, or ``HALF`` of their median where that is more (so a few wrongly labelled rows do not open it).

Whole texts count, in training (every row with a text and a language; counts are added up in the tasks before any
shuffle) and in prediction (no shuffle); a very long text is one task's work, in a batch of its own. Texts are
predicted one by one, so repeated rows and equal ids need nothing special; empty tables give no rows. Other columns
pass through ``keep``, whatever their names, and are not read by ``predict``.
"""

from __future__ import annotations

import functools
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidefold.llm.columnar import blocks, runs
from tidefold.llm.shared import lean

TOP, UNKNOWN = 300, "und"
#: Least scores: a share of the low quantile and one of the median, from at least so many rows of near lengths, in bins.
#: The shares lie between clean texts (of sf0.1: 0.74 and 0.56 at least) and foreign ones (Dutch: 0.55 and 0.42).
LOW, SHARE, HALF, LEAST_ROWS, BINS = 0.01, 0.65, 0.5, 20, 1000


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(k).isalpha() for k in range(0x110000)], dtype=bool)


def ngrams(text: str) -> np.ndarray:
    """Codes of all n-grams of one to three characters; a boundary is 0 and stands only at either end."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    c[~_letters()[c]] = 0
    c = np.concatenate(([0], c, [0]))
    c = c[np.concatenate(([True], (c[1:] != 0) | (c[:-1] != 0)))]
    if len(c) < 3:
        return np.zeros(0, np.int64)
    two = (c[:-1] << 21 | c[1:]) + (1 << 42)
    three = (c[:-2] << 42 | c[1:-1] << 21 | c[2:])[c[1:-1] != 0] + np.int64(0)
    return np.concatenate((c[c != 0], two, three | np.int64(-(2**63))))


def ranked(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and their counts."""
    codes = np.sort(codes)
    begins, lens = runs(codes)
    return codes[begins], lens


class Profiles:
    """Profiles of all languages, as one sorted table of n-grams with a rank for each language."""

    def __init__(self, tops: dict[str, list[int]]):
        self.names = sorted(tops)
        self.codes = np.unique(np.array([c for t in tops.values() for c in t], dtype=np.int64))
        self.rank = np.full((len(self.codes) + 1, len(self.names)), -1, dtype=np.int64)
        for k, name in enumerate(self.names):
            self.rank[np.searchsorted(self.codes, np.array(tops[name], dtype=np.int64)), k] = np.arange(len(tops[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.measured(text)[:2]

    def measured(self, text: str | None) -> tuple[str, float, int]:
        """Language, score, and the length class: the bits of the number of distinct n-grams."""
        codes = ngrams(text) if text else np.zeros(0, np.int64)
        if not len(codes) or not self.names:
            return UNKNOWN, 0.0, 0
        codes, counts = ranked(codes)
        top = codes[np.argsort(-counts, kind="stable")[:TOP]]
        at = np.searchsorted(self.codes, top)
        at[at == len(self.codes)] = 0
        at[self.codes[at] != top] = len(self.codes)
        rank = self.rank[at]
        distance = np.where(rank < 0, TOP, np.abs(rank - np.arange(len(top))[:, None])).sum(axis=0)
        best = int(distance.argmin())
        return self.names[best], float(1 - distance[best] / (TOP * len(top))), len(codes).bit_length()


class LeastScores:
    """The least score of a language and length class, from counts of training rows by (language, class, bin of score)."""

    def __init__(self, counts: dict[tuple[str, int, int], int]):
        self.bins: dict[str, np.ndarray] = {}
        for (lang, length, b), n in counts.items():
            self.bins.setdefault(lang, np.zeros((64, BINS + 1), dtype=np.int64))[length, b] += n
        self.found: dict[tuple[str, int], float] = {}

    def least(self, lang: str, length: int) -> float:
        """Rows of the class and its neighbours count, of ever more of them until there are LEAST_ROWS (or all)."""
        if lang not in self.bins:
            return 0.0
        if (lang, length) not in self.found:
            table, reach = self.bins[lang], 1
            while (seen := table[max(0, length - reach) : length + reach + 1].sum(axis=0)).sum() < LEAST_ROWS and reach < len(table):
                reach += 1
            below = np.cumsum(seen)
            low, median = (int(np.searchsorted(below, below[-1] * q, side="right")) / BINS for q in (LOW, 0.5))
            self.found[lang, length] = max(SHARE * low, HALF * median)
        return self.found[lang, length]


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Learn from all rows with a text and a language. At most TOP n-grams of each language reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for b in blocks(batches, "t"):
            texts = defaultdict(list)
            for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                texts[lang].append(ngrams(t))
            for lang, codes in texts.items():
                got = ranked(np.concatenate(codes))
                if lang in total:
                    both, n = np.concatenate((total[lang][0], got[0])), np.concatenate((total[lang][1], got[1]))
                    order = np.argsort(both, kind="stable")
                    begins, _ = runs(both[order])
                    got = both[order][begins], np.add.reduceat(n[order], begins) if len(begins) else n
                total[lang] = got
        for lang, (codes, n) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n.astype(np.int64))], ["lang", "code", "n"])

    known = lean(rows).where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("t"))
    counts = known.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    tops = defaultdict(list)
    for r in counts.withColumn("k", F.row_number().over(order)).where(F.col("k") <= TOP).orderBy("lang", "k").collect():
        tops[r.lang].append(r.code)
    return Profiles(dict(tops))


def calibrate(rows: DataFrame, profiles: Profiles, text_col: str = "text", lang_col: str = "lang") -> LeastScores:
    """Least scores from all rows that are predicted as labelled. Only counts of bins reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[tuple[str, int, int]] = Counter()
        for b in blocks(batches, "t"):
            for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                best, score, length = profiles.measured(t)
                if best == lang and length:
                    total[lang, length, int(score * BINS)] += 1
        if total:
            keys = list(zip(*total))
            yield pa.RecordBatch.from_arrays([pa.array(keys[0], pa.string()), *(pa.array(v, pa.int32()) for v in keys[1:]), pa.array(list(total.values()), pa.int64())], ["lang", "length", "bin", "n"])

    known = lean(rows).where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("t"))
    counts = known.mapInArrow(count, "lang string, length int, bin int, n long").groupBy("lang", "length", "bin").agg(F.sum("n").alias("n"))
    return LeastScores({(r.lang, r.length, r.bin): r.n for r in counts.collect()})


def held_out(id_col: str | Column = "doc_id") -> Column:
    """Rows kept from training: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predict(df: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, lang_pred and score of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "_t"):
            got = [profiles.predict(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [id_col, "held_out", "lang_pred", "score"])

    df = lean(df)
    return df.select(df[id_col].cast("long").alias("_i"), held_out(id_col).alias("_h"), df[text_col].alias("_t")).mapInArrow(run, f"{id_col} long, held_out boolean, lang_pred string, score double")


def keep(df: DataFrame, profiles: Profiles, least_score: float = 0.05, text_col: str = "text", least: LeastScores | None = None) -> DataFrame:
    """The rows whose language is known with at least that score, and with the least one of its language and length
    if those are given (see calibrate), with all their columns."""

    def known(text: str | None) -> bool:
        lang, score, length = profiles.measured(text)
        return lang != UNKNOWN and score >= max(least_score, least.least(lang, length) if least else 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, text_col):
            yield b.filter(pa.array([known(t) for t in b.column(b.schema.get_field_index(text_col)).to_pylist()], pa.bool_()))

    return lean(df).mapInArrow(run, df.schema)

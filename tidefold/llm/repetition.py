"""Quality rules with suffix-array repetition.

The suffix array of each text's words is built by prefix doubling for a whole batch of texts at once, where only
groups that are not yet told apart are sorted again. Words are numbers that only equal words share, so nothing here
rests on a hash. Longest common prefixes of neighbours are counted word by word where they cannot be derived: if the
words before two neighbours are equal too, theirs is one less than the one before (Kärkkäinen, Manzini and Puglisi,
Permuted Longest-Common-Prefix Array, 2009), and the others add up to n log n words at most. Prefixes of
``min_words`` or more are the intervals of maximal repeated substrings. The union of all their spans, first
occurrences included, gives the covered fraction of the words' bytes, and the longest of them the longest repeat.
A text is rejected if it has few words, if words of repeated 3-word windows prevail, if the covered fraction is
over ``max_covered``, or if the longest repeat is over ``max_repeat`` of its words or over ``most_repeat`` words.

All words of a repeat are words of repeated 3-word windows, so at most half of a text's words are covered where the
base rule holds; the limits of ``Rules`` act below that.

Null and empty texts have no words and fail the base rules; a very long text is judged whole, in a batch of its own.
Texts are judged one by one, so repeated rows, ids and ties need nothing special, and an empty table gives no rows.
There is no shuffle; other columns pass through ``keep`` unchanged, whatever their names, and ``judge`` does not read
them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidefold.llm.columnar import SPACE, Words, blocks, runs
from tidefold.llm.shared import lean

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Rules:
    """Of the texts in sf0.1 that pass the base rules, those labelled good have 0.276 covered at most, and a longest
    repeat of 0.141 of their words and of 13 words."""

    least_words: int = 50
    repeat_percent: int = 50
    min_words: int = 8
    max_covered: float = 0.3
    max_repeat: float = 0.15
    most_repeat: int = 100


def suffix_array(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Positions ordered by (row, values from there to the row's end); values are numbers below 2 ** 31."""
    n = len(row)
    key = row.astype(np.int64) << 32 | value
    sa = np.argsort(key, kind="stable")
    begins, lens = runs(key[sa])
    rank = np.empty(n, dtype=np.int64)
    rank[sa] = np.repeat(begins, lens)
    step = 1
    todo = np.flatnonzero(np.repeat(lens > 1, lens))  # places in sa whose suffix is not told apart yet
    while len(todo):
        at = sa[todo]
        far = at + step
        inside = far < n
        inside[inside] &= row[far[inside]] == row[at[inside]]
        nxt = np.zeros(len(at), dtype=np.int64)
        nxt[inside] = rank[far[inside]] + 1
        key = rank[at] * (n + 1) + nxt
        o = np.argsort(key, kind="stable")
        sa[todo] = at = at[o]
        key = key[o]
        begins, lens = runs(key)
        rank[at] = np.repeat(todo[begins], lens)
        todo = todo[np.repeat(lens > 1, lens)]
        step *= 2
    return sa


def repeats(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each position, how many values from it on are found elsewhere in its row too."""
    n = len(row)
    if n < 2:
        return np.zeros(n, dtype=np.int64)
    sa = suffix_array(row, value)
    before = np.full(n, -1, dtype=np.int64)  # the suffix before each one in order, of the same row
    before[sa[1:]] = np.where(row[sa[1:]] == row[sa[:-1]], sa[:-1], -1)
    stop = np.searchsorted(row, row, side="right")
    at = np.flatnonzero(before > 0)
    at = at[at > 0]
    derived = np.zeros(n, dtype=bool)
    derived[at] = (value[at - 1] == value[before[at] - 1]) & (row[at - 1] == row[at]) & (row[before[at] - 1] == row[at])
    common = np.zeros(n, dtype=np.int64)
    todo, width = np.flatnonzero((before >= 0) & ~derived), 1
    while len(todo):
        kept = []
        for some in np.array_split(todo, -(-len(todo) * width // (1 << 21))):
            x = some + common[some]
            y = before[some] + common[some]
            span = np.arange(width)
            room = np.minimum(stop[some] - x, stop[before[some]] - y)
            same = (value[np.minimum(x[:, None] + span, n - 1)] == value[np.minimum(y[:, None] + span, n - 1)]) & (span < room[:, None])
            k = np.where(same.all(axis=1), width, same.argmin(axis=1))
            common[some] += k
            kept.append(some[k == width])
        todo, width = np.concatenate(kept), min(64, 2 * width)
    place = np.arange(n)
    source = np.maximum.accumulate(np.where(derived, 0, place))
    common = np.where(derived, common[source] - (place - source), common)
    out = common.copy()
    known = np.flatnonzero(before >= 0)
    out[before[known]] = np.maximum(out[before[known]], common[known])
    return out


def measure(texts: pa.Array, rules: Rules) -> dict[str, np.ndarray]:
    """All measures and verdicts of a batch of texts."""
    w = Words(texts, fold=False)
    rows, raw, at = w.rows, w.raw, w.at

    def per_row(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flags)))
        return (sums[at[1:]] - sums[at[:-1]]).astype(np.int64)

    found = repeats(w.row, w.distinct()[0])

    def inside(least: int, length: np.ndarray | int) -> np.ndarray:
        """Words within spans of that length from positions with a repeat of so many words."""
        marked = np.zeros(len(found) + 1, dtype=np.int64)
        k = np.flatnonzero(found >= least)
        marked[k] += 1
        np.add.at(marked, k + (length if isinstance(length, int) else length[k]), -1)
        return np.cumsum(marked[:-1]) > 0

    n_words, space = w.counts.astype(np.int64), SPACE[raw]
    n_repeat = np.bincount(w.row[inside(3, 3)], minlength=rows).astype(np.int64)
    whole, n_dup = raw.tobytes(), np.zeros(rows, dtype=np.int64)
    for r, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        lines = [x for x in whole[a:b].split(b"\n") if x.strip()]  # bytes are stripped of the white space of words
        n_dup[r] = len(lines) - len(set(lines))
    covered = np.bincount(w.row, weights=w.lens * inside(rules.min_words, found), minlength=rows)
    total = np.bincount(w.row, weights=w.lens, minlength=rows)
    longest = np.zeros(rows, dtype=np.int64)
    np.maximum.at(longest, w.row, np.where(found >= rules.min_words, found, 0))
    fraction = covered / np.maximum(total, 1)
    failed = (n_words < rules.least_words) | (100 * n_repeat > rules.repeat_percent * n_words)
    kept = ~failed & (fraction <= rules.max_covered) & (longest <= rules.max_repeat * n_words) & (longest <= rules.most_repeat)
    return {"n_words": n_words, "word_chars": per_row(~space & ((raw & 0xC0) != 0x80)), "n_symbols": per_row(_SYMBOL[raw]), "n_dup_lines": n_dup, "n_repeat_words": n_repeat, "base_failed": failed, "kept": kept, "covered_fraction": fraction, "longest_repeat": longest}


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_fraction double, longest_repeat long"


def judge(df: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and all measures and verdicts of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "_t"):
            m = measure(b.column(1), rules)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v) for v in m.values())], [id_col, *m])

    df = lean(df)
    return df.select(df[id_col].cast("long").alias("_i"), df[text_col].alias("_t")).mapInArrow(run, f"{id_col} long, {SCHEMA}")


def keep(df: DataFrame, rules: Rules = Rules(), text_col: str = "text") -> DataFrame:
    """The rows whose text passes all rules, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, text_col):
            yield b.filter(pa.array(measure(b.column(b.schema.get_field_index(text_col)), rules)["kept"]))

    return lean(df).mapInArrow(run, df.schema)

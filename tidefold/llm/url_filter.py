"""URL filter: host and path rules, then gradient-boosted trees on lexical features.

Rules fit a host and its subdomains if the url's path starts with the rule's path; the longest fitting rule wins.
Urls that no rule fits are judged by boosted trees with features of the url alone: length, depth, digit ratio,
entropy of its bytes, parameter count, the host's shape, and statistics of its suffixes (smoothed rates and counts of
labelled urls under the last label and the last two). The statistics count all labelled rows: they are added up for each
suffix and fold, stay a table, and are joined to the urls. The trees are fitted on the driver on at most
``most_labelled`` distinct labelled urls, those of least hash, each weighted by its rows, and travel as small arrays.

A null url, or one without ``://``, has empty host and path, fits no rule and is judged as the empty string (null)
or by its whole text; very long urls are judged whole. Urls are judged one by one, so repeated rows, equal ids and
ties need nothing special; rules of equal length and host are the same rule. An empty table gives no rows; without
labels of both kinds all scores are the share of bad labels (0 without labels). Scoring is a map step after the
joins; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.llm.columnar import flat
from tidefold.llm.shared import forget, lean, written

FOLDS = 5
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _cut(text: str, stops: str) -> str:
    return text[: min((k for s in stops if (k := text.find(s)) >= 0), default=len(text))]


def host_path(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    if not url or "://" not in url:
        return "", ""
    rest = url.partition("://")[2]
    host = _cut(rest, "/?#")
    return host.translate(_LOWER), _cut(rest[len(host) :], "?#")


class Rules:
    """(host/path, allow or block) rules."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for rule, verdict in rules:
            host, _, path = rule.partition("/")
            self.by_host.setdefault(host, []).append(("/" + path, rule, verdict))

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        labels = host.split(".")
        found = [(len(rule), rule, verdict) for k in range(len(labels)) for p, rule, verdict in self.by_host.get(".".join(labels[k:]), ()) if path.startswith(p)]
        return max(found)[1:] if found else (None, None)


def suffixes(host: str) -> list[str]:
    """The last label and the last two."""
    labels = host.split(".")
    return [labels[-1], ".".join(labels[-2:])]


def parts_of(url: str) -> Column:
    """Struct of host, path and query (after the first question mark, up to a number sign) in SQL functions."""
    u = F.coalesce(url, F.lit(""))
    cut = lambda pattern, k: F.regexp_extract(u, pattern, k)
    place = "(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(cut(place, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.struct(host.alias("host"), cut(place, 2).alias("path"), cut("(?s)^[^?]*[?]([^#]*)", 1).alias("query"))


@dataclass(frozen=True)
class Labelled:
    """How many labelled rows there are, and the share of bad ones; suffixes' rates are smoothed towards it."""

    total: int = 0
    prior: float = 0.0
    weight: float = 20.0


def entropy(urls: pa.Array) -> np.ndarray:
    raw, at = flat(urls)
    n, lens = len(urls), np.diff(at)
    counts = np.zeros((n, 256), dtype=np.float64)
    np.add.at(counts, (np.repeat(np.arange(n), lens), raw), 1)
    share = counts / np.maximum(lens, 1)[:, None]
    return -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)


def features(urls: pa.Array, hosts: pa.Array, paths: pa.Array, queries: pa.Array, counts: list[tuple[np.ndarray, np.ndarray]], known: Labelled) -> np.ndarray:
    """One row for each url; counts: bad and all labelled rows under each url's last label, and under its last two."""
    number = lambda x: x.to_numpy(zero_copy_only=False).astype(np.float64)
    size, many = lambda x: number(pc.utf8_length(x)), lambda x, sign: number(pc.count_substring(x, sign))
    digits = lambda x: number(pc.count_substring_regex(x, "[0-9]"))
    length = size(urls)
    columns = [length, many(paths, "/"), digits(urls) / np.maximum(length, 1), entropy(urls), number(pc.count_substring_regex(queries, "[^&]+")), size(hosts), many(hosts, "."), many(hosts, "-"), size(paths), digits(hosts)]
    for bad, n in counts:
        columns += [(bad + known.weight * known.prior) / (n + known.weight), n / max(1, known.total)]
    return np.stack(columns, axis=1)


class BoostedTrees:
    """Logistic boosting of depth-limited trees over histograms of at most 32 bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.15, least: int = 20, ridge: float = 5.0, w: np.ndarray | None = None):
        w = np.ones(len(y)) if w is None else w
        share = min(max(float((w * y).sum() / w.sum()), 1e-6), 1 - 1e-6) if len(y) else 1e-6
        self.base, self.rate, self.depth, self.trees = math.log(share / (1 - share)), rate, depth, []
        if len(np.unique(y)) < 2:
            return
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 33)[1:-1])) for f in range(x.shape[1])]
        bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
        score = np.full(len(y), self.base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            tree, step = self._grow(bins, w * (p - y), w * p * (1 - p), w, edges, least, ridge)
            score += rate * step
            self.trees.append(tree)

    def _grow(self, bins: np.ndarray, g: np.ndarray, h: np.ndarray, w: np.ndarray, edges: list[np.ndarray], least: int, ridge: float):  # noqa: ANN202
        """A complete tree as (feature, threshold) of inner nodes in level order and leaf values."""
        n = 2**self.depth - 1
        feature, threshold, node = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros(len(g), np.int64)
        for k in range(n):
            rows = np.flatnonzero(node == k)
            best = (1e-9, None)
            G, H, W = g[rows].sum(), h[rows].sum(), w[rows].sum()
            for f, e in enumerate(edges) if W >= 2 * least else ():
                gs = np.cumsum(np.bincount(bins[rows, f], weights=g[rows], minlength=len(e) + 1))[:-1]
                hs = np.cumsum(np.bincount(bins[rows, f], weights=h[rows], minlength=len(e) + 1))[:-1]
                c = np.cumsum(np.bincount(bins[rows, f], weights=w[rows], minlength=len(e) + 1))[:-1]
                gain = np.where((c >= least) & (W - c >= least), gs**2 / (hs + ridge) + (G - gs) ** 2 / (H - hs + ridge) - G**2 / (H + ridge), 0)
                if len(gain) and gain.max() > best[0]:
                    best = float(gain.max()), (f, int(gain.argmax()))
            right = np.zeros(len(rows), dtype=bool)
            if best[1]:
                f, b = best[1]
                feature[k], threshold[k] = f, edges[f][b]
                right = bins[rows, f] > b
            node[rows] = 2 * k + 1 + right
        leaf = node - n
        value = -np.bincount(leaf, weights=g, minlength=n + 1) / (np.bincount(leaf, weights=h, minlength=n + 1) + ridge)
        return (feature, threshold, value), value[leaf]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of a bad url."""
        score = np.full(len(x), self.base)
        for feature, threshold, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > threshold[node])
            score += self.rate * value[node - len(feature)]
        return 1 / (1 + np.exp(-score))


@dataclass
class UrlModel:
    known: Labelled
    trees: BoostedTrees
    #: Every suffix of a labelled url with its bad and all rows.
    table: DataFrame


def fit(labelled: DataFrame, most_labelled: int = 20_000) -> UrlModel:
    """Fit on rows (url string, bad int): the statistics on all, the trees on at most that many distinct urls."""
    labelled = lean(labelled)
    given = labelled.where("url is not null and bad is not null").select("url", F.col("bad").cast("int").alias("bad"), parts_of("url").alias("p"))
    urls = written(given.groupBy("url", F.col("p.host").alias("host")).agg(F.count("*").alias("n"), F.sum("bad").alias("bad")).withColumns({"h": F.shiftrightunsigned(F.xxhash64("url"), 1), "fold": F.pmod(F.xxhash64("url", F.lit(5)), F.lit(FOLDS)).cast("int")}), "labelled-urls")
    # A null suffix stands for all rows of the fold.
    each = urls.select("fold", "bad", "n", F.explode(F.array(F.lit(None).cast("string"), F.substring_index("host", ".", -1), F.substring_index("host", ".", -2))).alias("suffix"))
    counts = written(each.groupBy("suffix", "fold").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")), "suffix-counts")
    folds = {r.fold: (r.n, r.bad) for r in counts.where("suffix is null").collect()}
    total, bad = (sum(v[k] for v in folds.values()) for k in (0, 1))
    # Those of least hash: only hashes below a bound reach the driver, where a fifth more than wanted are to be expected.
    bound = min((1 << 63) - 1, int((1 << 63) * (1.2 * most_labelled + 200) / max(1, urls.count())))
    rows = sorted(urls.where(F.col("h") <= bound).select("url", "host", "n", "bad", "h", "fold").collect(), key=lambda r: (r.h, r.url))[:most_labelled]
    forget(urls)
    known = Labelled(total, bad / total if total else 0.0)
    # Written, so adaptive execution can split the joins of suffixes that many urls share.
    table = written(counts.where("suffix is not null").groupBy("suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")), "suffixes")
    if not rows:
        forget(counts)
        return UrlModel(known, BoostedTrees(np.zeros((0, 14)), np.zeros(0)), table)
    # A training url's suffix statistics come from the other folds, so its own label is not among its features.
    needed = sorted({s for r in rows for s in suffixes(r.host)})  # two for each of the urls at most
    place = {s: k for k, s in enumerate(needed)}
    by_fold = np.zeros((2, len(needed), FOLDS))
    for r in counts.join(F.broadcast(labelled.sparkSession.createDataFrame([(s,) for s in needed], "suffix string")), "suffix", "left_semi").collect():
        by_fold[:, place[r.suffix], r.fold] = r.bad, r.n
    forget(counts)
    others = by_fold.sum(axis=2, keepdims=True) - by_fold
    fold = np.array([r.fold for r in rows])
    at = np.array([[place[s] for s in suffixes(r.host)] for r in rows])
    cut = [(r.host, *parts(r.url)) for r in rows]
    x = np.zeros((len(rows), 14))
    for k in range(FOLDS):
        of = np.flatnonzero(fold == k)
        if len(of):
            n, b = (v - folds.get(k, (0, 0))[i] for i, v in enumerate((total, bad)))
            text = lambda i: pa.array([cut[j][i] for j in of], pa.string())  # noqa: B023, E731
            x[of] = features(pa.array([rows[j].url for j in of], pa.string()), text(0), text(1), text(2), [(others[0, at[of, i], k], others[1, at[of, i], k]) for i in (0, 1)], Labelled(n, b / n if n else 0.0))
    # A url with labels of both kinds is two rows.
    n, y = np.array([r.n for r in rows], dtype=np.float64), np.array([r.bad for r in rows], dtype=np.float64)
    w = np.concatenate((n - y, y))
    return UrlModel(known, BoostedTrees(np.concatenate((x, x))[w > 0], np.repeat([0.0, 1.0], len(n))[w > 0], w=w[w > 0]), table)


def parts(url: str) -> tuple[str, str]:
    """Path and query."""
    return host_path(url)[1], _cut(url.partition("?")[2], "#")


def judge(pages: DataFrame, rules: list[tuple[str, str]], model: UrlModel, block_at: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id_col, host, path, rule, verdict and score (probability of a bad url) of each url."""
    table, known, trees = Rules(rules), model.known, model.trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, urls, hosts, paths, queries, *counts = b.columns
            bad_and_all = [tuple(c.to_numpy(zero_copy_only=False).astype(np.float64) for c in counts[k : k + 2]) for k in (0, 2)]
            score = trees.predict(features(urls, hosts, paths, queries, bad_and_all, known))
            found = [table.find(h, p) for h, p in zip(hosts.to_pylist(), paths.to_pylist())]
            verdict = np.where(score >= block_at, "block", "allow").tolist()
            yield pa.RecordBatch.from_arrays([ids, hosts, paths, pa.array([r for r, _ in found], pa.string()), pa.array([v or m for (_, v), m in zip(found, verdict)], pa.string()), pa.array(score, pa.float64())], [id_col, "host", "path", "rule", "verdict", "score"])

    urls = lean(pages).select(F.col(id_col).cast("long").alias("_i"), F.coalesce(url_col, F.lit("")).alias("_u"), parts_of(url_col).alias("p"))
    urls = urls.select("_i", "_u", F.col("p.host").alias("_h"), F.col("p.path").alias("_p"), F.col("p.query").alias("_q"))
    for k, labels in (("_s", 1), ("_t", 2)):
        counted = model.table.select(F.col("suffix").alias(k), F.col("bad").alias(f"{k}b"), F.col("n").alias(f"{k}n"))
        urls = urls.withColumn(k, F.substring_index("_h", ".", -labels)).join(counted, k, "left")
    urls = urls.select("_i", "_u", "_h", "_p", "_q", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("_sb", "_sn", "_tb", "_tn")))
    return urls.mapInArrow(run, f"{id_col} long, host string, path string, rule string, verdict string, score double")

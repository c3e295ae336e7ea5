"""Quality rules: boosted trees over document statistics.

The statistics of every whole text come from numpy over Arrow batches.  Trees
are grown on histograms with monotonic constraints, flattened into node arrays
and scored for whole columns at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.llm.textarrays import BASE, TextArrays, mix
from murmura.scratch import materialize, small_batches

#: The labelled rows that trees are grown on, at most; chosen by a hash of their ids.
TRAIN_ROWS = 20_000
MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_punct", "n_distinct"]
#: Model inputs and their direction: -1 if quality may only fall as they rise.
FEATURES = {"repeat_share": -1, "symbol_share": -1, "dup_line_share": -1, "upper_share": -1, "punct_share": -1, "mean_word": 0, "distinct_share": 1, "words_per_line": 0, "log_words": 0}


def chunk_counts(arrays: TextArrays, data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """``COUNTS`` of each row of a chunk, as int64 arrays."""
    n = len(off) - 1

    def per_row(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return total[off[1:]] - total[off[:-1]]

    starts, ends, row = arrays.words(data, off)
    solid = ~arrays.white[data]
    symbol, punct, upper = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    punct[list(b"!?.,;:'\"()-")] = True
    upper[65:91] = True
    out = {
        "n_words": np.bincount(row, minlength=n),
        "word_chars": per_row(solid & ((data & 0xC0) != 0x80)),
        "n_symbols": per_row(symbol[data]),
        "n_upper": per_row(upper[data]),
        "n_punct": per_row(punct[data]),
    }
    h = arrays.span_hashes(data, starts, ends)
    tag = mix(row.astype(np.uint64) * np.uint64(BASE) + np.uint64(1))
    _, first = np.unique(mix(h ^ tag), return_index=True)
    out["n_distinct"] = np.bincount(row[first], minlength=n)
    # words in three-word windows that occur twice or more in their row
    hit = np.zeros(len(h), bool)
    if len(h) > 2:
        at = np.flatnonzero(row[2:] == row[:-2])
        key = mix(mix(mix(h[at] ^ tag[at]) + h[at + 1]) + h[at + 2])
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        again = at[count[inverse] > 1]
        for j in range(3):
            hit[again + j] = True
    out["n_repeat_words"] = np.bincount(row[hit], minlength=n)
    # lines, by their first bytes
    newline = np.flatnonzero(data == 10)
    filled = np.flatnonzero(off[1:] > off[:-1])
    line_row = np.concatenate([filled, np.searchsorted(off, newline, "right") - 1])
    start = np.concatenate([off[filled], newline + 1])
    by = np.lexsort((start, line_row))
    line_row, start = line_row[by], start[by]
    end = off[line_row + 1].copy()
    same = line_row[1:] == line_row[:-1]
    end[:-1][same] = start[1:][same] - 1
    total = np.concatenate([[0], np.cumsum(solid, dtype=np.int64)])
    worded = total[end] > total[np.minimum(start, end)]
    start, end, line_row = start[worded], end[worded], line_row[worded]
    key = mix(arrays.span_hashes(data, start, end) ^ mix(line_row.astype(np.uint64) * np.uint64(BASE) + np.uint64(2)))
    _, first = np.unique(key, return_index=True)
    out["n_lines"] = np.bincount(line_row, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(line_row[first], minlength=n)
    return out


def statistics(docs: DataFrame, keep: list[str] = ()) -> DataFrame:
    """doc_id, the columns of ``keep`` and ``COUNTS`` of every row's whole text.

    Null and empty texts have zeros.  Null ids, repeated rows and ties pass
    through, an empty table gives an empty result, other columns are ignored.
    """
    names = ["doc_id", *keep]

    def run(batches):
        arrays = TextArrays()
        for b in batches:
            for first, n, data, off in arrays.batches(b.column(len(names))):
                counts = chunk_counts(arrays, data, off)
                part = b.slice(first, n)
                yield pa.record_batch([*[part.column(i) for i in range(len(names))], *[pa.array(counts[c].astype(np.int64)) for c in COUNTS]], [*names, *COUNTS])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(*names, "text").transform(small_batches).mapInArrow(run, f"{fields}, " + ", ".join(f"{c} long" for c in COUNTS))


def features(pdf: pd.DataFrame) -> np.ndarray:
    """The model's inputs from ``COUNTS``."""
    words, chars = np.maximum(pdf["n_words"], 1), np.maximum(pdf["word_chars"], 1)
    cols = {
        "repeat_share": pdf["n_repeat_words"] / words,
        "symbol_share": pdf["n_symbols"] / chars,
        "dup_line_share": pdf["n_dup_lines"] / np.maximum(pdf["n_lines"], 1),
        "upper_share": pdf["n_upper"] / chars,
        "punct_share": pdf["n_punct"] / chars,
        "mean_word": chars / words,
        "distinct_share": pdf["n_distinct"] / words,
        "words_per_line": words / np.maximum(pdf["n_lines"], 1),
        "log_words": np.log1p(pdf["n_words"]),
    }
    return np.column_stack([np.asarray(cols[c], float) for c in FEATURES]).reshape(len(pdf), len(FEATURES))


@dataclass
class Forest:
    """All trees in flat arrays; ``left == -1`` marks a leaf.  Scores are log-odds."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        every = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            while (inner := self.left[node] >= 0).any():
                low = x[every, self.feature[node]] <= self.threshold[node]
                node = np.where(inner, np.where(low, self.left[node], self.right[node]), node)
            total += self.value[node]
        return total


def grow_forest(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 48, ridge: float = 1.0, leaf_rows: int = 10, directions: tuple[int, ...] = tuple(FEATURES.values())) -> Forest:
    """Boosted trees for the log-odds of ``y``, monotone along ``directions``.

    A split on a constrained feature must order its sides' values; each side's
    leaves are then held on their side of the middle.
    """
    good = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = float(np.log(good / (1 - good)))
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots = []
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    code = [np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)]
    score = np.full(len(y), base)
    # one class or too few rows leave the base rate alone
    for _ in range(trees if len(y) and 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)

        def value(a: float, b: float, lo: float, hi: float) -> float:
            return float(np.clip(a / (b + ridge), lo, hi))

        def split(rows: np.ndarray, level: int, lo: float, hi: float) -> int:
            me = len(nodes)
            sum_g, sum_h = g[rows].sum(), h[rows].sum()
            nodes.append([0, 0.0, -1, -1, rate * value(sum_g, sum_h, lo, hi)])
            best = None
            for j, e in enumerate(edges) if level < depth and len(rows) >= 2 * leaf_rows else ():
                c = code[j][rows]
                part = [np.cumsum(np.bincount(c, w, len(e) + 1))[:-1] for w in (g[rows], h[rows], None)]
                for k in range(len(e)):
                    n = part[2][k]
                    if n < leaf_rows or len(rows) - n < leaf_rows:
                        continue
                    a, b = part[0][k], part[1][k]
                    v, w = value(a, b, lo, hi), value(sum_g - a, sum_h - b, lo, hi)
                    if directions[j] * (w - v) < 0:
                        continue
                    gain = a * v - 0.5 * (b + ridge) * v * v + (sum_g - a) * w - 0.5 * (sum_h - b + ridge) * w * w
                    if best is None or gain > best[0]:
                        best = gain, j, k, v, w
            whole = value(sum_g, sum_h, lo, hi)
            if best and best[0] > sum_g * whole - 0.5 * (sum_h + ridge) * whole * whole + 1e-9:
                _, j, k, v, w = best
                low = code[j][rows] <= k
                middle = (v + w) / 2
                sides = {0: ((lo, hi), (lo, hi)), 1: ((lo, middle), (middle, hi)), -1: ((middle, hi), (lo, middle))}[directions[j]]
                nodes[me][:2] = j, float(edges[j][k])
                nodes[me][2] = split(rows[low], level + 1, *sides[0])
                nodes[me][3] = split(rows[~low], level + 1, *sides[1])
            return me

        roots.append(split(np.arange(len(y)), 0, -np.inf, np.inf))
        flat = flatten(0.0, roots[-1:], nodes)
        score = score + flat.score(x)
    return flatten(base, roots, nodes)


def flatten(base: float, roots: list[int], nodes: list[list]) -> Forest:
    cols = list(zip(*nodes, strict=True)) if nodes else [()] * 5
    return Forest(base, np.array(roots, np.int64), *(np.array(c, k) for c, k in zip(cols, (np.int64, float, np.int64, np.int64, float), strict=True)))


def training_rows(stats: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> pd.DataFrame:
    """At most ``limit`` statistics with ``quality``, those first by a hash of the id.

    Rows without a label of 0 or 1 teach nothing; a document with several labels
    takes their smallest.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    rows = stats.select("doc_id", *COUNTS).join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", *COUNTS).limit(limit)
    return rows.toPandas()


def judge(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, ``COUNTS``, base_failed, score (probability of quality) and kept.

    ``base_failed``: fewer than 50 words, or over half of the words in repeated
    windows.  ``kept`` is false for those and else whether the trees give
    quality at least even odds.  Without usable labels of both kinds all other
    documents are kept.  Null and empty texts fail the base rules.
    """
    stats = materialize(statistics(docs), "quality-statistics")
    sample = training_rows(stats, labels, train_rows)
    y = sample["_quality"].to_numpy(float)
    forest = grow_forest(features(sample), y)
    if not len(forest.roots):
        forest.base = 1.0

    def run(batches):
        for pdf in batches:
            odds = forest.score(features(pdf))
            failed = (pdf["n_words"] < MIN_WORDS) | (100 * pdf["n_repeat_words"] > 50 * pdf["n_words"])
            yield pdf.assign(base_failed=failed, score=1 / (1 + np.exp(-np.clip(odds, -500, 500))), kept=~failed & (odds >= 0))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return stats.mapInPandas(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, score double, kept boolean")

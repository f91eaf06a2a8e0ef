"""Quality classifier: histogram gradient-boosted trees over document statistics.

Each whole text is reduced to ``FEATURES`` (numpy over Arrow buffers, one pass, no shuffle). The
trees are trained on a bounded sample of labelled rows (``MAX_TRAIN_ROWS``, the rows of smallest
hash, test fold left out): features are cut into quantile bins, each level of each tree sums
gradients and hessians per (node, feature, bin), and the best cut of each node is taken. The trained
trees are flattened into heap-ordered arrays (a few KB, shipped with the task) and all documents are
scored by vectorised traversal.

Inputs of a score are the text's statistics alone; labels, language, source and id are not used.

Defined results: null and empty texts have all-zero statistics and the score the trees give those;
labels null or absent train nothing; without any labelled training row every score is 0.5; repeated
rows get equal scores; several labels of one doc_id count as the lowest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import textops as T
from logloom.llm.shared import TEST_FOLD, fold

MAX_TRAIN_ROWS = 20_000
PREDICT_FROM = 0.3

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper_rate", "digit_rate", "symbol_rate", "stop_rate", "shout_rate", "high_byte_rate",
    "line_rate", "distinct_word_rate", "top_word_rate", "same_as_before_rate", "distinct_pair_rate", "repeated_triple_rate", "distinct_line_rate",
)

_CLASSES = np.zeros(256, np.uint8)
_CLASSES[65:91] = 1
_CLASSES[48:58] = 2
_CLASSES[list(b"#*$%&|<>")] = 3
_CLASSES[list(b".,;:")] = 4
_CLASSES[list(b"!?")] = 5
_CLASSES[128:] = 6
_CLASSES[10] = 7
_CODES = T.fold_table(lower=True)
_NOT_NEWLINE = np.zeros(256, bool)
_NOT_NEWLINE[10] = True


def _group_stats(keys: np.ndarray, group: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per group: distinct keys, largest count of one key, items whose key occurs twice or more."""
    distinct, top, repeated = (np.zeros(n) for _ in range(3))
    if len(keys):
        salted = T.mix(keys ^ (group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        _, first, counts = np.unique(salted, return_index=True, return_counts=True)
        of = group[first]
        distinct = np.bincount(of, minlength=n).astype(float)
        np.maximum.at(top, of, counts)
        repeated = np.bincount(of, weights=np.where(counts > 1, counts, 0), minlength=n)
    return distinct, top, repeated


def _chunk_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    size = np.diff(offsets)
    starts, ends, bounds = T.word_spans(data, offsets)
    words = np.diff(bounds)
    of_word = np.repeat(np.arange(n), words)
    classes = _CLASSES[data]
    per_class = []
    for c in range(1, 8):
        found = np.flatnonzero(classes == c)
        per_class.append(np.diff(np.searchsorted(found, offsets)))
    upper, digit, symbol, stop, shout, high, newline = per_class
    hashes = T.span_hashes(data, starts, ends, _CODES)
    distinct, top, _ = _group_stats(hashes, of_word, n)
    # Pairs and triples of one text: those whose last word belongs to the same text as the first.
    k1, k2 = np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)
    inside2 = of_word[:-1] == of_word[1:] if len(of_word) > 1 else np.zeros(0, bool)
    pairs = (hashes[:-1] * k1 + hashes[1:])[inside2] if len(hashes) > 1 else hashes[:0]
    distinct_pairs, _, _ = _group_stats(pairs, of_word[:-1][inside2] if len(of_word) > 1 else of_word[:0], n)
    same = np.bincount(of_word[1:][inside2 & (hashes[:-1] == hashes[1:])], minlength=n) if len(hashes) > 1 else np.zeros(n)
    inside3 = of_word[:-2] == of_word[2:] if len(of_word) > 2 else np.zeros(0, bool)
    triples = (hashes[:-2] * k1 + hashes[1:-1] * k2 + hashes[2:])[inside3] if len(hashes) > 2 else hashes[:0]
    _, _, repeated = _group_stats(triples, of_word[:-2][inside3] if len(of_word) > 2 else of_word[:0], n)
    l_starts, l_ends, l_bounds = T.word_spans(data, offsets, _NOT_NEWLINE)
    lines = np.diff(l_bounds)
    distinct_lines, _, _ = _group_stats(T.span_hashes(data, l_starts, l_ends, _CODES), np.repeat(np.arange(n), lines), n)
    b, w, p = np.maximum(size, 1), np.maximum(words, 1), np.maximum(words - 1, 1)
    return np.column_stack([
        np.log1p(size), np.log1p(words), (size - newline) / w, upper / b, digit / b, symbol / b, stop / w, shout / w, high / b,
        newline / w, distinct / w, top / w, same / w, distinct_pairs / p, repeated / w, distinct_lines / np.maximum(lines, 1),
    ])


def features(texts: pa.Array) -> np.ndarray:
    """``FEATURES`` of each text (null: empty), as rows."""
    data, offsets = T.string_buffers(texts)
    parts = [_chunk_features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in T.chunks(offsets)]
    found = np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))
    found[np.diff(offsets) == 0] = 0
    return found


@dataclass(frozen=True)
class Trees:
    """Boosted trees of one depth, heap-ordered: node k of a tree has children 2k + 1 and 2k + 2."""

    base: float
    feature: np.ndarray  # (trees, inner nodes)
    cut: np.ndarray  # (trees, inner nodes): right if the value is above
    leaf: np.ndarray  # (trees, leaves)

    def margins(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while inner and node[0:1].size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - inner]
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margins(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 1.0, least: float = 2.0) -> Trees:
    """Histogram gradient boosting of the logistic loss on at most a bounded sample of rows."""
    inner, leaves = 2**depth - 1, 2**depth
    if not len(y) or y.min() == y.max():
        base = 0.0 if not len(y) else float(np.clip(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)), -6, 6))
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    n, f = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
    binned = np.column_stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(f)])  # bin b: edges[b-1] < x <= edges[b]
    base = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(n, base)
    all_feature, all_cut, all_leaf = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            place = node - first
            best, kept = np.full(width, 1e-6), {}
            for j in range(f):
                slots = place * bins + binned[:, j]
                gs = np.bincount(slots, g, width * bins).reshape(width, bins).cumsum(1)
                hs = np.bincount(slots, h, width * bins).reshape(width, bins).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
                gain[(hs < least) | (ht - hs < least)] = 0
                gain[:, len(edges[j]) :] = 0
                at = gain.argmax(1)
                value = gain[np.arange(width), at]
                for k in np.flatnonzero(value > best):
                    best[k], kept[k] = value[k], (j, at[k])
            threshold = np.full(inner, bins, np.int64)
            for k, (j, b) in kept.items():
                feature[first + k], cut[first + k], threshold[first + k] = j, edges[j][b], b
            node = 2 * node + 1 + (binned[np.arange(n), feature[node]] > threshold[node])
        place = node - inner
        leaf = -rate * np.bincount(place, g, leaves) / (np.bincount(place, h, leaves) + l2)
        margin += leaf[place]
        all_feature.append(feature), all_cut.append(cut), all_leaf.append(leaf)
    return Trees(base, np.array(all_feature), np.array(all_cut), np.array(all_leaf))


def training_rows(docs: DataFrame, labels: DataFrame, column: str, limit: int) -> DataFrame:
    """(doc_id, text, label) of at most ``limit`` labelled rows outside the test fold: those of the
    smallest hash. The chosen ids (16 bytes each, at most ``limit``) are broadcast."""
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & (fold() != TEST_FOLD))
        .groupBy("doc_id")
        .agg(F.min(column).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def train(docs: DataFrame, labels: DataFrame, *, column: str = "quality", max_rows: int = MAX_TRAIN_ROWS, **options) -> Trees:
    """Trees for ``labels.<column>``; the driver receives the statistics of the sample only."""
    names = [f"f{i}" for i in range(len(FEATURES))]

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column("text"))
            columns = [batch.column("doc_id").cast(pa.int64()), batch.column("label").cast(pa.float64()), *[pa.array(x[:, i]) for i in range(x.shape[1])]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "label", *names])

    rows = training_rows(docs, labels, column, max_rows).mapInArrow(sample, ", ".join(["doc_id long", "label double", *[f"{c} double" for c in names]]))
    table = rows.toArrow().to_pandas().sort_values(["doc_id", *names], kind="stable")
    return fit(table[names].to_numpy(float), (table["label"].to_numpy(float) > 0).astype(float), **options)


def scorer(trees: Trees, columns: list[str] | None = None) -> Callable:
    """For mapInArrow: each batch's ``columns`` with its ``score``."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.select(columns)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(trees.scores(features(batch.column("text"))))], [*columns, "score"])

    return score


def score_documents(docs: DataFrame, trees: Trees) -> DataFrame:
    """``doc_id``, ``score`` of every row (map only)."""
    return docs.select("doc_id", "text").mapInArrow(scorer(trees, ["doc_id"]), "doc_id long, score double")


def filter_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, at_least: float = PREDICT_FROM, **options) -> DataFrame:
    """The documents whose score is at least ``at_least``, with their own columns (map only)."""
    trees = train(docs, labels, **options)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(trees.scores(features(batch.column("text"))) >= at_least))

    return docs.mapInArrow(keep, docs.schema)

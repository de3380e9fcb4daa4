"""Quality by a generalised additive model with pairwise interactions.

Every feature of a text is cut into bins; cyclic boosting of shallow trees, one feature at a time, learns a table of one number per bin, then
tables of pairs of features for what single ones leave over. A score is the sum of the looked-up numbers.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from operator import eq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pollwarden.llm.common import documents, fold_of, map_text, table, whole_text

#: Most labelled rows of each class that the model is fitted on.
SAMPLE_ROWS = 6000
BINS, PAIR_BINS, PAIRS = 32, 8, 8
THRESHOLD = 0.7
NAMES = ["log_bytes", "log_words", "word_length", "distinct_words", "equal_neighbours", "upper", "digits", "stops", "marks", "signs",
         "bars", "line_breaks", "line_length", "other_bytes", "distinct_bytes", "breaks_per_word"]


def _classes() -> np.ndarray:
    """For each byte value the groups that it belongs to."""
    groups = [range(65, 91), range(48, 58), map(ord, ".,;:"), map(ord, "!?"), map(ord, "#$%&*@^~<>{}[]\\/=+_"), map(ord, "|"), [10], range(128, 256)]
    out = np.zeros((256, len(groups)))
    for k, g in enumerate(groups):
        out[list(g), k] = 1
    return out


CLASSES = _classes()


def features(text: str) -> list[float]:
    """Numbers of one whole text; an empty text has zeros."""
    data = text.encode()
    if not data:
        return [0.0] * len(NAMES)
    seen = np.zeros(256, np.int64)
    for at in range(0, len(data), 1 << 20):
        seen += np.bincount(np.frombuffer(data[at:at + (1 << 20)], np.uint8), minlength=256)
    upper, digits, stops, marks, signs, bars, breaks, other = (seen @ CLASSES).tolist()
    n = len(data)
    words = text.split()
    w = max(1, len(words))
    letters = sum(map(len, words))
    return [float(np.log1p(n)), float(np.log1p(len(words))), letters / w, len(set(words)) / w, sum(map(eq, words, words[1:])) / w,
            upper / n, digits / n, stops / n, marks / n, signs / n, bars / n, breaks / n, float(np.log1p(n / (1 + breaks))), other / n,
            float((seen > 0).sum()), breaks / w]


@dataclass
class AdditiveModel:
    """cuts: bin borders by feature; tables: one number per bin; pairs: (i, j, coarse borders of i and of j, table)."""

    start: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of features, by vectorised lookups and additions."""
        total = np.full(len(x), self.start)
        for k, (cut, t) in enumerate(zip(self.cuts, self.tables)):
            total += t[np.searchsorted(cut, x[:, k], "right")]
        for i, j, ci, cj, t in self.pairs:
            total += t[np.searchsorted(ci, x[:, i], "right"), np.searchsorted(cj, x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def borders(values: np.ndarray, bins: int) -> np.ndarray:
    """Borders between bins of about equal size; values that many rows share have a bin of their own."""
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def tree(g: np.ndarray, h: np.ndarray, leaves: int = 4, penalty: float = 1.0) -> np.ndarray:
    """A shallow tree over ordered bins: greedy splits of sums of gradients g and curvatures h; a number per bin."""
    parts = [(0, len(g))]
    worth = lambda a, b: a * a / (b + penalty)
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    while len(parts) < leaves:
        best = (1e-6, None, None)
        for k, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            c = np.arange(a + 1, b)
            gain = worth(cg[c] - cg[a], ch[c] - ch[a]) + worth(cg[b] - cg[c], ch[b] - ch[c]) - worth(cg[b] - cg[a], ch[b] - ch[a])
            gain[(ch[c] - ch[a] < 1) | (ch[b] - ch[c] < 1)] = 0
            m = int(gain.argmax())
            if gain[m] > best[0]:
                best = (gain[m], k, int(c[m]))
        if best[1] is None:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + penalty)
    return out


def quadrants(g: np.ndarray, h: np.ndarray, penalty: float = 1.0) -> tuple[np.ndarray, float]:
    """Best pair of cuts of a table, one each way, with a number for each of the four parts, and its gain."""
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    n, m = g.shape
    best, where = 0.0, None
    parts = lambda c, i, j: (c[i, j], c[i, m] - c[i, j], c[n, j] - c[i, j], c[n, m] - c[i, m] - c[n, j] + c[i, j])
    for i in range(1, n):
        for j in range(1, m):
            gain = sum(a * a / (b + penalty) for a, b in zip(parts(cg, i, j), parts(ch, i, j)))
            if gain > best:
                best, where = gain, (i, j)
    out = np.zeros_like(g)
    if where:
        i, j = where
        v = [a / (b + penalty) for a, b in zip(parts(cg, i, j), parts(ch, i, j))]
        out[:i, :j], out[:i, j:], out[i:, :j], out[i:, j:] = v
    return out, best


def fit_additive(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 80, pair_rounds: int = 25, rate: float = 0.15) -> AdditiveModel:
    """Cyclic boosting; repeatable for the same rows. Without both classes the model says the share of label 1, or 0.5."""
    if not len(y) or y.min() == y.max():
        p = 0.5 if not len(y) else (0.9 if y[0] else 0.1)
        return AdditiveModel(float(np.log(p / (1 - p))), [np.zeros(0)] * len(NAMES), [np.zeros(1)] * len(NAMES), [])
    cuts = [borders(x[:, k], BINS) for k in range(x.shape[1])]
    bins = [np.searchsorted(c, x[:, k], "right") for k, c in enumerate(cuts)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    rate_1 = (weight * y).sum() / weight.sum()
    total = np.full(len(y), np.log(rate_1 / (1 - rate_1)))
    start = float(total[0])

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return weight * (y - p), weight * p * (1 - p)

    for _ in range(rounds):
        for b, t in zip(bins, tables):
            g, h = slopes()
            step = rate * tree(np.bincount(b, g, len(t)), np.bincount(b, h, len(t)))
            t += step
            total += step[b]
    coarse = [borders(x[:, k], PAIR_BINS) for k in range(x.shape[1])]
    wide = [np.searchsorted(c, x[:, k], "right") for k, c in enumerate(coarse)]
    g, h = slopes()

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        return np.bincount(wide[i] * shape[1] + wide[j], v, shape[0] * shape[1]).reshape(shape)

    gains = sorted(((-quadrants(grid(i, j, g), grid(i, j, h))[1], i, j) for i, j in combinations(range(x.shape[1]), 2)))
    pairs = [(i, j, coarse[i], coarse[j], np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for _, i, j in gains[:PAIRS]]
    for _ in range(pair_rounds):
        for i, j, _, _, t in pairs:
            g, h = slopes()
            step = rate * quadrants(grid(i, j, g), grid(i, j, h))[0]
            t += step
            total += step[wide[i], wide[j]]
    return AdditiveModel(start, cuts, tables, pairs)


def with_features(docs: DataFrame, columns: list[str]) -> DataFrame:
    return map_text(docs, columns, "text", "x array<double>", lambda texts: [(features(t),) for t in texts])


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> AdditiveModel:
    """Fit on rows whose crc32(doc_id) mod 4 is not 2: at most `rows` of each class, those of the smallest seeded hashes, weighted back
    to the classes' shares. Null labels are passed over; a document labelled twice counts by its larger label."""
    one = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("y"))
    ranked = one.where(fold_of("doc_id", 4) != 2).withColumn("h", F.xxhash64("doc_id", F.lit(5)))
    sizes = dict(ranked.groupBy("y").count().collect())
    chosen = ranked.where("y = 0").orderBy("h", "doc_id").limit(rows).union(ranked.where("y = 1").orderBy("h", "doc_id").limit(rows))
    picked = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(chosen), "doc_id")  # 2 x rows ids
    got = sorted(with_features(picked, ["h", "doc_id", "y"]).collect(), key=lambda r: (r["h"], r["doc_id"], r["x"]))
    x = np.array([r["x"] for r in got], float).reshape(len(got), len(NAMES))
    y = np.array([r["y"] for r in got], float)
    weight = np.array([sizes[r["y"]] / max(1, min(rows, sizes[r["y"]])) for r in got])
    return fit_additive(x, y, weight / max(weight.mean(), 1e-9) if len(weight) else weight)


def with_quality(docs: DataFrame, columns: list[str], model: AdditiveModel) -> DataFrame:
    """columns of docs and quality_score. Null counts as empty; every row is scored by itself; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def rows(texts: list[str]) -> list[tuple]:
        return [(float(s),) for s in shared.value.score(np.array([features(t) for t in texts]))]

    return map_text(docs, columns, "text", "quality_score double", rows)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = documents(spark, sf_dir)
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return with_quality(docs, ["doc_id"], model).select(
        "doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), F.col("quality_score").alias("score"),
        (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))

"""Toxic spans by a linear-chain conditional random field.

Two states: outside and toxic. Tokens of a bounded sample of labelled documents are labelled first: a token is toxic if
its document is and its word, prefix or suffix is proven (log-likelihood against the number of types tried) to stand in toxic documents.
The field learns weights of hashed word, prefix and suffix features and of the four transitions. Scoring runs exact forward and backward
recursions over whole documents; marginals sum to a score, and runs of likely tokens are the spans.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pollwarden.llm.common import documents, fold_of, map_text, table, whole_text

TOKEN = re.compile(r"[^\W\d_]+")
BITS = 18
#: Most labelled documents of each class that the field is fitted on.
SAMPLE_ROWS = 1500
WINDOW = 24
WIDTH = 256
#: Times that windows of clean documents which mislead the field are added to what it learns from.
MINED = 3
THRESHOLD = 0.7


def types_of(word: str) -> list[str]:
    """What a token is known by: the word, prefixes of 3 to 6 and suffixes of 3 and 4 letters."""
    n = len(word)
    return [f"w{word}", *(f"p{word[:k]}" for k in (3, 4, 5, 6) if n > k), *(f"s{word[-k:]}" for k in (3, 4) if n > k)]


def slots(word: str) -> list[int]:
    """Hashed features of a lower-cased word, eight of them; slot 0 is unused and weighs nothing."""
    got = [1 + zlib.crc32(t.encode()) % ((1 << BITS) - 1) for t in types_of(word)]
    return (got + [0] * 8)[:8]


@dataclass
class ChainModel:
    """weights: of the toxic state by slot; step[i][j]: factor of going from state i to j; first: odds of a toxic first token."""

    weights: dict[int, float]
    bias: float
    step: tuple[tuple[float, float], tuple[float, float]]
    first: float
    level: tuple[float, float, float]

    def emission(self, word: str) -> float:
        w = self.weights
        return self.bias + sum(w.get(s, 0.0) for s in slots(word.lower()))

    def warm_up(self) -> int:
        """Tokens after which a recursion has forgotten where it began, to 1e-9: the maps contract log odds by a fixed factor."""
        (oo, ot), (to, tt) = self.step
        shrink = math.tanh(abs(math.log(oo * tt / (ot * to))) / 4)
        return 1 if shrink < 1e-9 else min(100_000, math.ceil(math.log(1e-11) / math.log(shrink)))


def chain_marginals(model: ChainModel, emissions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Probability of the toxic state for every token; documents lie one after another in `emissions`.

    Documents are cut in columns of WIDTH tokens, each with as much warm-up as the model needs, so that one numpy step
    moves all columns at once whatever the documents' lengths.
    """
    total = int(lengths.sum())
    if not total:
        return np.zeros(0)
    (oo, ot), (to, tt) = model.step
    odds = np.exp(np.clip(emissions, -60, 60))
    begin = np.repeat(np.cumsum(lengths) - lengths, -(-lengths // WIDTH))
    first = np.concatenate([np.arange(0, n, WIDTH) for n in lengths.tolist() if n]) + begin
    last = np.minimum(first + WIDTH, begin + np.repeat(lengths, -(-lengths // WIDTH))) - 1
    end = begin + np.repeat(lengths, -(-lengths // WIDTH)) - 1
    warm = model.warm_up()
    forward, backward = np.ones(total), np.ones(total)
    lead = int(min(warm, (first - begin).max(initial=0)))
    r = np.full(len(first), np.nan)
    for k in range(-lead, WIDTH):
        at = first + k
        ok = (at >= begin) & (at <= last)
        if not ok.any():
            continue
        i = at[ok]
        old = r[ok]
        new = odds[i] * np.where(np.isnan(old) | (i == begin[ok]), model.first, (ot + tt * old) / (oo + to * old))
        r[ok] = np.clip(new, 1e-60, 1e60)
        if k >= 0:
            forward[i] = r[ok]
    lead = int(min(warm, (end - last).max(initial=0)))
    b = np.ones(len(first))
    for k in range(-lead, WIDTH):
        at = last - k
        ok = (at <= end) & (at >= first)
        if not ok.any():
            continue
        i = at[ok]
        nxt = np.minimum(i + 1, total - 1)
        go = odds[nxt] * b[ok]
        new = np.where(i == end[ok], 1.0, (to + tt * go) / (oo + ot * go))
        b[ok] = np.clip(new, 1e-60, 1e60)
        if k >= 0:
            backward[i] = b[ok]
    both = forward * backward
    return both / (1 + both)


def token_labels(docs: list[list[str]], toxic: np.ndarray) -> tuple[set[str], float]:
    """Types proven to stand in toxic documents."""
    bad, good = Counter(), Counter()
    for words, y in zip(docs, toxic):
        (bad if y else good).update({t for w in set(words) for t in types_of(w)})
    n_bad, n_good = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    need = math.log(len(bad) + len(good) + 1) + 2
    found = set()
    for t, k in bad.items():
        g = good.get(t, 0)
        rate, base = (k + 0.1) / (k + g + 0.2), n_bad / (n_bad + n_good)
        gain = k * math.log(rate / base) + (g * math.log((1 - rate) / (1 - base)) if g else 0)
        if k >= 3 and rate > base and gain >= need and rate / (1 - rate) >= 12 * base / (1 - base):
            found.add(t)
    return found, need


def spread(windows: set[int], most: int) -> list[int]:
    """At most `most` of the windows, evenly spaced over all of them, the first and the last included."""
    ordered = sorted(windows)
    if len(ordered) <= most:
        return ordered
    return [ordered[j * (len(ordered) - 1) // (most - 1)] for j in range(most)]


def fit_chain(docs: list[list[str]], toxic: np.ndarray, rounds: int = 12, rate: float = 0.3, penalty: float = 1e-5,
              windows_per_text: int = 12) -> ChainModel:
    """Fit on windows of the sample's documents; repeatable for the same rows.

    A toxic document gives up to windows_per_text (2 at least) of its windows with marked tokens, spread over its whole length.
    A clean document gives three windows at first. Those where the field then sees toxic tokens in a clean document are added and the field is
    learned anew, MINED times: they hold the rare words whose prefixes and suffixes mislead it.
    """
    types, _ = token_labels(docs, toxic)
    known: dict[str, tuple[list[int], bool]] = {}
    xs, ys = [], []
    used: set[tuple[int, int]] = set()
    for d, (words, y) in enumerate(zip(docs, toxic)):
        marks = []
        for w in words:
            if w not in known:
                known[w] = (slots(w), any(t in types for t in types_of(w)))
            marks.append(bool(y) and known[w][1])
        hot = {i // WINDOW for i, m in enumerate(marks) if m}
        blocks = -(-len(words) // WINDOW)
        take = spread(hot, windows_per_text) + [k for k in sorted({0, blocks // 2, blocks - 1}) if 0 <= k < blocks and k not in hot]
        for k in take:
            part = words[k * WINDOW:(k + 1) * WINDOW]
            xs.append([known[w][0] for w in part] + [[0] * 8] * (WINDOW - len(part)))
            ys.append(marks[k * WINDOW:(k + 1) * WINDOW] + [False] * (WINDOW - len(part)))
            used.add((d, k))
    model = learn_field(xs, ys, rounds, rate, penalty)
    clean = [d for d, y in enumerate(toxic) if not y and docs[d]]
    for _ in range(MINED if clean else 0):
        found = mistaken_windows(model, [docs[d] for d in clean])
        new = [(clean[i], k) for i, k in found if (clean[i], k) not in used]
        if not new:
            break
        used.update(new)
        for d, k in new:
            part = docs[d][k * WINDOW:(k + 1) * WINDOW]
            xs.append([known[w][0] for w in part] + [[0] * 8] * (WINDOW - len(part)))
            ys.append([False] * WINDOW)
        model = learn_field(xs, ys, rounds, rate, penalty)
    model.level = fit_level(toxic_mass(model, docs), np.array([len(d) for d in docs]), toxic)
    return model


def mistaken_windows(model: ChainModel, docs: list[list[str]]) -> list[tuple[int, int]]:
    """(document, window) of clean documents where a token's marginal is not negligible."""
    lengths = np.array([len(d) for d in docs], np.int64)
    at = np.nonzero(token_marginals(model, docs) >= 0.05)[0]
    d = np.searchsorted(np.cumsum(lengths), at, "right")
    return sorted({(int(i), int(k)) for i, k in zip(d, (at - (np.cumsum(lengths) - lengths)[d]) // WINDOW)})


def learn_field(xs: list, ys: list, rounds: int, rate: float, penalty: float) -> ChainModel:
    """Weights by AdaGrad on the field's log likelihood over windows."""
    weights = np.zeros(1 << BITS)
    move = np.zeros((2, 2))
    bias, start = -2.0, 0.0
    if xs and any(map(any, ys)):
        x, y = np.array(xs, np.int32), np.array(ys, np.int8)
        order = np.random.default_rng(1).permutation(len(x))
        seen, seen_move, seen_bias, seen_start = np.full(1 << BITS, 1e-3), np.full((2, 2), 1e-3), 1e-3, 1e-3
        for _ in range(rounds):
            for at in range(0, len(order), 256):
                pick = order[at:at + 256]
                xb, yb = x[pick], y[pick]
                score = weights[xb].sum(axis=2) + bias
                p, pair = _expect(score, move, start)
                wrong = (yb - p) / len(pick)
                g = np.bincount(xb.ravel(), np.repeat(wrong.ravel(), 8), 1 << BITS)
                g[0] = 0
                g -= penalty * weights
                seen += g * g
                weights += rate * g / np.sqrt(seen)
                true = np.array([[((yb[:, :-1] == i) & (yb[:, 1:] == j)).sum() for j in (0, 1)] for i in (0, 1)])
                gm = (true - pair) / len(pick) - 1e-3 * move
                seen_move += gm * gm
                move += rate * gm / np.sqrt(seen_move)
                gb, gs = wrong.sum(), wrong[:, 0].sum()
                seen_bias, seen_start = seen_bias + gb * gb, seen_start + gs * gs
                bias += rate * gb / math.sqrt(seen_bias)
                start += rate * gs / math.sqrt(seen_start)
    move = np.clip(move - move[0, 0], -3, 3)
    step = tuple(tuple(float(math.exp(v)) for v in row) for row in move)
    some = {int(i): float(weights[i]) for i in np.nonzero(np.abs(weights) > 1e-3)[0]}
    return ChainModel(some, float(bias), step, float(math.exp(np.clip(start, -3, 3))), (0.0, 1.0, 0.0))


def _expect(score: np.ndarray, move: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the toxic state and expected transitions of windows, in log space."""
    n, length = score.shape
    emit = np.stack([np.zeros_like(score), score], axis=2)
    alpha, beta = np.zeros((n, length, 2)), np.zeros((n, length, 2))
    alpha[:, 0] = emit[:, 0] + np.array([0.0, start])
    for t in range(1, length):
        alpha[:, t] = emit[:, t] + np.logaddexp(alpha[:, t - 1, :1] + move[0], alpha[:, t - 1, 1:] + move[1])
    for t in range(length - 2, -1, -1):
        nxt = emit[:, t + 1] + beta[:, t + 1]
        beta[:, t] = np.logaddexp(nxt[:, :1] + move[:, 0], nxt[:, 1:] + move[:, 1])
    whole = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])[:, None]
    p = np.exp(alpha[:, :, 1] + beta[:, :, 1] - whole)
    pair = np.array([[np.exp(alpha[:, :-1, i] + move[i, j] + emit[:, 1:, j] + beta[:, 1:, j] - whole).sum() for j in (0, 1)] for i in (0, 1)])
    return p, pair


def token_marginals(model: ChainModel, docs: list[list[str]]) -> np.ndarray:
    """Marginals of all tokens, documents one after another."""
    cache: dict[str, float] = {}
    flat = []
    for words in docs:
        for w in words:
            if w not in cache:
                cache[w] = model.emission(w)
            flat.append(cache[w])
    return chain_marginals(model, np.array(flat), np.array([len(d) for d in docs], np.int64))


def toxic_mass(model: ChainModel, docs: list[list[str]]) -> np.ndarray:
    """Expected toxic tokens of each document, of those that are not negligible (a marginal of 0.05 or more)."""
    p, lengths = token_marginals(model, docs), np.array([len(d) for d in docs], np.int64)
    return per_document(np.where(p >= 0.05, p, 0), lengths)


def per_document(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(values)])
    ends = np.cumsum(lengths)
    return sums[ends] - sums[ends - lengths]


def evidence(mass: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """What a document is judged by: a constant, its toxic mass and the mass's share of the tokens, both on a log scale."""
    return np.stack([np.ones(len(mass)), np.log1p(4 * mass), np.log1p(400 * mass / np.maximum(tokens, 50))], axis=1)


def fit_level(mass: np.ndarray, tokens: np.ndarray, toxic: np.ndarray) -> tuple[float, float, float]:
    """Numbers that turn a document's evidence into a probability: logistic regression by Newton steps."""
    prior = np.array([-3.0, 0.7, 0.7])
    if not len(mass) or toxic.min() == toxic.max():
        return tuple(prior.tolist())
    x = evidence(mass, tokens)
    w = prior.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + np.eye(3) * 0.5
        w = w + np.linalg.solve(h, x.T @ (toxic - p) - 0.5 * (w - prior))
    return (float(w[0]), float(max(w[1], 1e-3)), float(max(w[2], 0.0)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed, rows: int) -> list[tuple[str, int]]:
    """At most `rows` labelled texts of each class, those of the smallest seeded hashes, in a fixed order.

    A null or repeated label is passed over; a document labelled twice counts by its larger label. Only ids and labels are ranked;
    texts are fetched for the rows chosen.
    """
    one = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    ranked = one.where(allowed).withColumn("h", F.xxhash64("doc_id", F.lit(11)))
    chosen = None
    for y in (0, 1):
        part = ranked.where(F.col("y") == y).orderBy("h", "doc_id").limit(rows)
        chosen = part if chosen is None else chosen.union(part)
    picked = docs.select("doc_id", whole_text().alias("t")).join(F.broadcast(chosen), "doc_id")  # 2 x rows ids
    got = picked.select("h", "doc_id", "t", "y").collect()
    return [(r["t"], int(r["y"])) for r in sorted(got, key=lambda r: (r["h"], r["doc_id"], r["t"]))]


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> ChainModel:
    """Fit on rows whose crc32(doc_id) mod 3 is not 1. Without a labelled row of either class every text scores low."""
    got = labelled_sample(docs, labels, "toxic", fold_of("doc_id", 3) != 1, rows)
    return fit_chain([TOKEN.findall(t.lower()) for t, _ in got], np.array([y for _, y in got], float))


def scorer(model: ChainModel, limit: int = 400_000):
    """Function over texts that gives (score, expected toxic tokens, spans, first offset, end of the last, tokens) for each."""
    cache: dict[str, float] = {}
    level = np.array(model.level)

    def emit(word: str) -> float:
        got = cache.get(word)
        if got is None:
            if len(cache) >= limit:
                cache.clear()
            got = cache[word] = model.emission(word)
        return got

    def score(texts: list[str]) -> list[tuple]:
        tokens = [TOKEN.findall(t) for t in texts]
        lengths = np.array([len(x) for x in tokens], np.int64)
        flat = np.fromiter((emit(w) for words in tokens for w in words), float, int(lengths.sum()))
        p = chain_marginals(model, flat, lengths)
        mass = per_document(np.where(p >= 0.05, p, 0), lengths)
        value = 1 / (1 + np.exp(-evidence(mass, lengths) @ level))
        ends = np.cumsum(lengths)
        out = []
        for k, text in enumerate(texts):
            spans = []
            if mass[k] >= 0.5:
                own = p[ends[k] - lengths[k]: ends[k]]
                hot = np.nonzero(own >= 0.5)[0]
                if len(hot):
                    places = [m.span() for m in TOKEN.finditer(text)]
                    cuts = np.nonzero(np.diff(hot) > 1)[0]
                    for s, e in zip([0, *(cuts + 1).tolist()], [*cuts.tolist(), len(hot) - 1]):
                        spans.append((places[hot[s]][0], places[hot[e]][1], float(own[hot[s]:hot[e] + 1].mean())))
            out.append((float(value[k]), float(mass[k]), spans, int(lengths[k])))
        return out

    return score


SPANS = "array<struct<start:int,stop:int,probability:double>>"


def with_toxicity(docs: DataFrame, columns: list[str], model: ChainModel) -> DataFrame:
    """columns of docs and (tox_score, tox_mass, tox_spans, tox_tokens); spans are character offsets into the text.

    Null, empty and wordless texts have no token and get the score of a toxic mass of zero. Every row is scored by itself, so repeated rows score alike; an
    empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2^18 weights
    return map_text(docs, columns, "text", f"tox_score double, tox_mass double, tox_spans {SPANS}, tox_tokens long",
                    None, setup=lambda: scorer(shared.value))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document and a digest of its offending spans."""
    docs = documents(spark, sf_dir)
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    spans = F.col("tox_spans")
    return with_toxicity(docs, ["doc_id"], model).select(
        "doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), F.col("tox_score").alias("score"),
        (F.col("tox_score") >= THRESHOLD).cast("int").alias("predicted"), F.col("tox_mass").alias("toxic_mass"),
        F.size(spans).cast("long").alias("n_spans"), F.get(spans, F.lit(0))["start"].alias("first_start"),
        F.when(F.size(spans) > 0, F.element_at(spans, -1)["stop"]).alias("last_stop"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs whose score stays under the threshold, with all their columns."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names).withColumn("text", F.col(names[docs.columns.index("text")]))
    scored = with_toxicity(plain, names, fit_toxicity(docs, labels))
    return scored.where(F.col("tox_score") < THRESHOLD).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])

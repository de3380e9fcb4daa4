"""URL filter, whitening and hard negatives against plain loops and exact arithmetic, with awkward rows."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pollwarden.llm import exact_spectrum, op11_url_filter, op12_whitening, op13_hard_negatives

RULES = op11_url_filter.RULES
URLS = [None, "", "no scheme", "http://", "http://com", "http://com/", "http://Example.COM/en/1", "http://x.example.com/en", "http://www.example.com/en/1?x#y",
        "http://w.www.example.com/en/q", "http://a.net/es/", "http://a.net/esp", "http://net/fr/1", "ftp://u@h.org:80/a/b#c?d", "http://a.org?q=/en/", "http://a.b://c/d",
        "http://notcom/", "http://xcom/", "http://é日😀.org/ß\u0002\u0003/", "http://long.org/" + "ab/" * 60_000]
MANY = [f"http://{h}.example.{t}/{p}/{i}" for i, (h, t, p) in enumerate(
    (h, t, p) for h in ("www", "m", "blog", "x1", "x2", "shop", "news", "q") for t in ("com", "net", "org") for p in ("en", "es", "fr", "de"))]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3:]
    end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:end], rest[end:]
    end = min([rest.index(c) for c in "?#" if c in rest], default=len(rest))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[:end]


def ruled(host, path):
    fit = [r for r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fit, key=len, default=None)


def model_of(texts, share):
    """ln p of a text by interpolated Witten-Bell, straight from its definition."""
    counts = Counter()
    for t in texts:
        t = "\u0002" + t + "\u0003"
        counts.update(t[i:i + k] for i in range(len(t)) for k in range(1, 7) if i + k <= len(t))
    total = sum(c for s, c in counts.items() if len(s) == 1 and s != "\u0002")
    kept = {s: c for s, c in counts.items() if c * share >= total}
    after = {}
    for s, c in kept.items():
        if s != "\u0002":
            held, kinds = after.get(s[:-1], (0, 0))
            after[s[:-1]] = held + c, kinds + 1

    def p(context, c):
        low = p(context[1:], c) if context else 1 / 1_114_112
        if context not in after:
            return low
        held, kinds = after[context]
        n = kept[context] if context else total
        return kept.get(context + c, 0) / (n + kinds) + (n - held + kinds) / (n + kinds) * low

    def score(t):
        t = "\u0002" + t + "\u0003"
        return sum(math.log(p(t[max(0, i - 5):i], t[i])) for i in range(1, len(t)))
    return score


@pytest.mark.parametrize("share", [10_000, 60])
def test_url_filter(spark, share):
    rows = [(i, u, "clash", "x") for i, u in enumerate(URLS + MANY + MANY[:3])] + [(None, MANY[0], None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string, w string").repartition(3)
    got = op11_url_filter.judge_urls(pages, RULES, share=share).collect()
    assert len(got) == len(rows) and sorted(got[0].asDict()) == ["host", "page_id", "path", "rule", "score", "threshold", "url", "verdict", "w"]
    import zlib
    train = {"allow": [], "block": []}
    for _, u, _, _ in rows:
        host, path = split(u)
        if ruled(host, path) and zlib.crc32(host.encode()) % op11_url_filter.FOLDS:
            train[RULES[ruled(host, path)]].append(host + path)
    good, bad = (model_of(train[s], share) for s in ("allow", "block"))
    for r in got:
        host, path = split(r.url)
        assert (r.host, r.path, r.rule) == (host, path, ruled(host, path))
        text = (host + path).replace("\u0002", "").replace("\u0003", "")
        if len(text) < 500:
            assert r.score == pytest.approx((good(text) - bad(text)) / (len(text) + 1), abs=1e-7)
        assert r.verdict == (RULES[r.rule] if r.rule else "block" if r.score < r.threshold else "allow")


def test_url_filter_without_models(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert not op11_url_filter.judge_urls(none, RULES).collect()
    one = spark.createDataFrame([(1, "http://a.com/"), (2, "http://a.org/")], "page_id long, url string")
    assert {(r.page_id, r.verdict, r.score) for r in op11_url_filter.judge_urls(one, RULES).collect()} == {(1, "allow", None), (2, "allow", None)}
    assert {r.verdict for r in op11_url_filter.judge_urls(one, {}).collect()} == {"allow"}


def test_url_threshold(spark):
    rows = [("allow", 0.5), ("allow", 0.4), ("allow", -0.9), ("block", -1.0), ("block", 0.1), ("block", -5.0)]
    cut = op11_url_filter.threshold(spark.createDataFrame(rows, "side string, score double"))
    assert 0.1 < cut <= 0.4
    assert op11_url_filter.threshold(spark.createDataFrame(rows[:2], "side string, score double")) == 0.0


def test_url_model_is_a_distribution():
    score = model_of(["ab", "abc", "ba"], 4)
    p = sum(math.exp(score(t)) for t in [""] + [a + b for a in "abc" for b in ("", *"abc")])
    assert 0.2 < p < 1


def as_ints(rows):
    return np.array([[int(v) for v in r] for r in rows], dtype=object)


def polynomial(m):
    primes = exact_spectrum.primes_for(m)
    return exact_spectrum.from_residues(primes, [exact_spectrum.residue_polynomial(m, p) for p in primes])


def test_exact_spectrum():
    assert polynomial(as_ints([[2, 1], [1, 2]])) == [1, -4, 3]
    h = as_ints([[1, 1, 1, 1], [1, -1, 1, -1], [1, 1, -1, -1], [1, -1, -1, 1]])
    m = h.dot(as_ints(np.diag([5, 5, 2, 0]))).dot(h.T)  # a double root and a zero
    f = polynomial(m)
    assert f == [1, -48, 720, -3200, 0]
    roots = exact_spectrum.largest_roots(f, 4)
    assert [(n / 2**s, many) for n, s, many in roots] == [(20.0, 2), (8.0, 1)]
    v = np.hstack([exact_spectrum.eigenvectors(m, *r) for r in roots])
    assert np.allclose(v.T @ v, np.eye(3), atol=1e-15) and np.allclose(v.T @ m.astype(float) @ v, np.diag([20, 20, 8]), atol=1e-12)
    near = as_ints([[10**12, 1], [1, 10**12]])  # roots that differ in the last of 40 bits
    found = exact_spectrum.largest_roots(polynomial(near), 2)
    assert [n >> s if n % 2**s < 2**(s - 1) else (n >> s) + 1 for n, s, _ in found] == [10**12 + 1, 10**12 - 1]
    assert np.allclose(abs(exact_spectrum.eigenvectors(near, *found[0])), 0.5**0.5, atol=1e-15)


VECTORS = [(1, [0.5, -0.25, 0.125], "k"), (1, [0.5, -0.25, 0.125], "k"), (2, [1.5, 0.3, -2.0], None), (3, [0.0, 0.0, 0.0], "k"), (None, [0.1, 0.9, 0.7], "k"),
           (5, None, "k"), (6, [1.0, None, 2.0], "k"), (7, [1.0, float("nan"), 2.0], "k"), (8, [float("inf"), 0.0, 0.0], "k"), (9, [1.0], "k"), (10, [], "k"),
           (11, [-3.0, 2.0, 1.0], "k"), (12, [0.501, -0.25, 0.125], "k")]


def test_whitening(spark):
    rows = spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>, component string").repartition(3)
    got = op12_whitening.whiten(rows).collect()
    used = [(i, [math.floor(64 * x) + 1_000_000 for x in np.array(v, np.float32).astype(float)]) for i, v, _ in VECTORS
            if v and len(v) == 3 and all(x is not None and math.isfinite(x) for x in v)]
    fit = sorted({tuple(x) for _, x in used})
    n, x = len(fit), np.array(fit, float)
    v = (x - x.mean(0)).T @ (x - x.mean(0)) / n
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values)
    assert len(got) == 3 * len(used) and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-12
    sums = [sum(c) for c in zip(*fit)]
    want = sorted(((i is None, i or 0), [round(abs(float(w)), 9) for w in (np.array(one) - x.mean(0)) @ vectors[:, order] / np.sqrt(values[order])],
                   sum((n * a - s) ** 2 for a, s in zip(one, sums))) for i, one in used)
    have = {}
    for r in got:
        have.setdefault((r.vec_id is None, r.vec_id or 0), []).append((r.component, round(abs(r.whitened), 9), r.deviation))
        assert r.explained == pytest.approx(values[order][r.component - 1] / values.sum(), rel=1e-9)
    for key, rows_of in have.items():
        mine = [w for w in want if w[0] == key]
        assert len(rows_of) == 3 * len(mine) and {d for _, _, d in rows_of} == {w[2] for w in mine}
        for c, w, _ in rows_of:
            assert any(w == pytest.approx(m[1][c - 1], abs=1e-8) for m in mine)


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    assert op12_whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert op12_whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect() == []
    line = op12_whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(9)], schema)).collect()
    assert {r.component for r in line} == {1} and all(r.explained == pytest.approx(1) for r in line)
    huge = op12_whitening.whiten(spark.createDataFrame([(i, [1e13 * i, 1e12 * (i % 3)]) for i in range(9)], schema)).collect()
    assert len(huge) == 18 and max(r.identity_error for r in huge) < 1e-6 and None in {r.deviation for r in huge}


def test_whitening_products_of_any_size():
    for top in (100, 2**29, 2**40):
        y = np.random.default_rng(1).integers(-top, top, (50, 4))
        want = [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j])) for j in range(4)] for i in range(4)]
        assert op12_whitening.products(y).tolist() == want


def brute_negatives(rows, want=5):
    good = [(i, lab, [math.floor(256 * float(np.float32(x))) for x in v]) for i, lab, v in rows if lab is not None and v and len(v) == 6
            and all(x is not None and math.isfinite(x) for x in v)]
    out, key = [], lambda e: (-e[0], e[1] is None, e[1] or 0)
    for a, (i, lab, v) in enumerate(good):
        if i is None or i % 100:
            continue
        scores = [(sum(x * y for x, y in zip(v, w)), j, m, b) for b, (j, m, w) in enumerate(good)]
        same = sorted((s for s in scores if s[2] == lab and s[3] != a), key=key)[:want]
        for p, j, _, _ in same:
            fit = sorted((s for s in scores if s[2] != lab and 80 * p <= 100 * s[0] <= 100 * p), key=key)[:want]
            out += [(i, j, k + 1, s[1], p, s[0]) for k, s in enumerate(fit)]
    return sorted(out, key=str)


def test_hard_negatives(spark):
    r = np.random.default_rng(5)
    rows = [(int(i), int(r.integers(0, 4)), r.normal(size=6).tolist()) for i in range(1, 701)]
    rows += [(1000 + i, i % 2, rows[3][2]) for i in range(40)]  # copies under two labels, ties of score
    rows += [(200, 1, rows[3][2]), (200, 1, rows[3][2]), (None, 1, rows[5][2]), (None, None, rows[5][2]), (300, None, rows[5][2]), (400, 9, rows[6][2]),
             (801, 1, None), (802, 1, []), (803, 1, [1.0]), (804, 1, [float("nan")] * 6), (805, 1, [None] * 6), (806, 1, [0.0] * 6), (900, 2, [0.0] * 6)]
    table = spark.createDataFrame([(*x, "x") for x in rows], "vec_id long, label int, embedding array<float>, uid string").repartition(3)
    for block in (32_768, 16):
        got = op13_hard_negatives.mine_hard_negatives(table, block=block)
        have = sorted((tuple(x[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for x in got.collect()), key=str)
        assert have == brute_negatives(rows)
    assert not op13_hard_negatives.mine_hard_negatives(table.limit(0)).collect()
    assert not op13_hard_negatives.mine_hard_negatives(table.where(F.col("vec_id") % 100 != 0)).collect()


@pytest.mark.parametrize("least", [-math.inf, 0.0, 500.0, 5000.0])
def test_index_loses_no_pair(least):
    r = np.random.default_rng(2)
    q, a = r.integers(-60, 60, (400, 20)), r.integers(-60, 60, (30, 20)).astype(float)
    index = op13_hard_negatives.Index(q, np.zeros(400, np.int64))
    i, row, score = index.search(a, op13_hard_negatives.suffix_norms(a), np.full(30, least))
    want = {(x, y) for x, y in zip(*np.nonzero(a @ q.T >= least))}
    assert {(x, index.order[y]) for x, y in zip(i, row)} == want and (score == (a @ q.T)[i, index.order[row]]).all()

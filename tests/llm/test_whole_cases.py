"""Short items, scripts without spaces, long templates, late passages: cases that a cap or a prefix would lose."""

import re

import numpy as np
import pytest
from pyspark.errors import PySparkException

from pollwarden.llm import op01_decontaminate, op04_toxicity, op08_licenses
from tests.llm.test_operators import LONG, TEXTS, docs, fold  # noqa: F401


def test_items_of_few_words_and_without_spaces(spark):
    long_item = "why do seven green lamps hum at night near the old mill answer: because wind turns them"
    japanese = "\u65e5\u672c\u306e\u9996\u90fd\u306f\u3069\u3053\u3067\u3059\u304b\u6771\u4eac\u3067\u3059"
    items = spark.createDataFrame([(1, "zebra quantum drift"), (2, japanese), (3, long_item), (4, "!!"), (5, None), (6, "kumquat")],
                                  "item_id long, text string")
    filler = " ".join(f"w{i}" for i in range(3000))
    texts = {10: f"{filler} zebra quantum drift {filler}", 11: "quantum zebra drift", 12: "zebra quantum", 13: f"\u3042\u3042{japanese}\u3042\u3042",
             14: japanese[::-1], 15: f"{filler} {long_item}", 16: "a KUMQUAT, ripe", 17: "kumquats", 18: "", 19: None}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = {(10, 1), (13, 2), (15, 3), (16, 6)}
    for size in (1, op01_decontaminate.SHARD_BYTES):
        assert {(r.doc_id, r.item_id) for r in op01_decontaminate.contaminated(rows, items, size).collect()} == want
    assert {r.doc_id for r in op01_decontaminate.without_leaks(rows, items).collect()} == set(texts) - {d for d, _ in want}


def test_words_of_mixed_scripts():
    for text in ("Plain Words_here 7", "\u00c4rger \u00e9t\u00e9", "ab\u6771\u4eac cd\u3067", "\ud55c\uad6d\uc5b4 \ub2e8\uc5b4", ""):
        want = [w for part in re.findall(r"[^\W_]+", text.lower())
                for w in re.sub(f"({op01_decontaminate.UNSPACED.pattern})", r" \1 ", part).split()]
        assert op01_decontaminate.words_of(text) == want


def test_toxic_windows_are_spread_over_the_text():
    assert op04_toxicity.spread({5, 1, 9}, 12) == [1, 5, 9]
    assert op04_toxicity.spread(set(range(1000)), 3) == [0, 499, 999]
    assert len(op04_toxicity.spread(set(range(13)), 12)) == len(set(op04_toxicity.spread(set(range(13)), 12))) == 12
    clean = [["calm", "green", "river", f"n{i}"] * 40 for i in range(40)]
    marked = [["grok", "grok", "vile"] * 200 + ["plain"] * 2000 + ["snarl", "fiend"] * 12 for _ in range(20)]
    model = op04_toxicity.fit_chain(clean + marked, np.array([0] * 40 + [1] * 20))
    late = op04_toxicity.token_marginals(model, [["calm", "green"] * 3000 + ["snarl", "fiend"] * 12])
    assert late[-24:].mean() > 0.5 > late[:6000].max()


def test_licence_labels_equal_a_plain_scan(docs):  # noqa: F811
    body = [f"clause{i}" if i % 7 else "the" for i in range(1500)]
    templates = [*op08_licenses.TEMPLATES, ("long", " ".join(body), "clause1 clause2 clause3"), ("short", "clause3 clause4", "clause3")]
    spark = docs.sparkSession
    broken = [w if i % 6 else "x" for i, w in enumerate(body)]
    more = [(100, "pre " + " ".join(body) + " post"), (101, " ".join(broken)), (102, " ".join(body[:700])), (103, "licensed under CC BY SA 4.0!"), (104, LONG)]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    looked = set(op08_licenses.lookup_words(op08_licenses.word_idf(rows, templates), templates))
    got = op08_licenses.scan(rows, ["doc_id", "text"], templates).collect()
    assert len(got) == len(TEXTS) + len(more)
    for r in got:
        words = [w for w in re.split(op08_licenses.GAP, fold(r.text)) if w]
        want = set()
        for label, text, key in templates:
            t = text.split()
            at = {i - p for i, w in enumerate(words) for p, x in enumerate(t) if w == x and w in looked}
            for b in at:
                same = sum(words[b + j] == w for j, w in enumerate(t) if b + j < len(words)) / len(t) if b >= 0 else 0
                if same >= op08_licenses.AGREE and f" {key} " in f" {' '.join(words[b:b + len(t)])} ":
                    want.add((label, b, round(same, 9)))
        assert {(m.label, m.start, round(m.score, 9)) for m in r.matches or []} == want
    labels = {r.doc_id: {m.label for m in r.matches or []} for r in got}
    assert "long" in labels[100] and "long" in labels[101] and "long" not in labels[102] and "cc-by-sa" in labels[103]


def test_a_template_without_words_is_refused(docs):  # noqa: F811
    with pytest.raises((ValueError, PySparkException)):
        op08_licenses.scan(docs, ["doc_id"], [("x", "", "")])

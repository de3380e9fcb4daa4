"""Every training-data operator against brute force, a library or held-out labels, on small inputs with awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pollwarden.llm import (byte_bpe, op01_decontaminate, op02_exact_dedup, op03_long_repeats, op04_toxicity, op05_quality, op06_byte_bpe,
                            op07_simhash, op08_licenses, op09_token_counts, op10_lattice_lm)
from pollwarden.llm.components import components
from pollwarden.llm.queries import ORACLES, QUERIES
from tests.oracle import compare, connect

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, t string"
R = random.Random(3)
LONG = " ".join(R.choice(["alpha", "beta", "gamma", "delta", "éta", "the", "of"]) for _ in range(4000))
TEXTS = [(1, None), (2, ""), (3, "   "), (4, "Hello World again"), (5, "hello world AGAIN"), (6, LONG), (7, LONG), (8, LONG[:3000] + "x" + LONG[3001:]),
         (9, "a" * 5000), (9, "a" * 5000), (None, "hello world again"), (11, "licensed under the MIT license, and CC-BY-NC 4.0"), (12, "日本語 <s> \x00 ÄÖ\n\n  x  "),
         (13, "idiot scum " * 30), (14, "one two"), (15, "under the mit license apache license version 2")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None, None, None, None, "clash") for i, t in TEXTS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf, name):
    ok, note, _ = compare(spark, name, QUERIES[name], ORACLES[name], sf, connect(sf))
    assert ok, note


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_dedup(docs, none, keep):
    got = op02_exact_dedup.tree_dedup(docs, keep, fan_in=2).collect()
    assert len(got) == len(TEXTS) and not op02_exact_dedup.tree_dedup(none).collect()
    groups = {}
    for i, t in TEXTS:
        groups.setdefault(fold(t), []).append(i)
    texts = {hashlib.sha256(t.encode()).digest(): ids for t, ids in groups.items()}
    for r in got:
        ids = [i for i in texts[bytes(r.digest)] if i is not None]
        assert r.group_size == len(texts[bytes(r.digest)]) and r.keep_id == (max(ids) if keep == "largest" else min(ids))
    assert sum(r.row == r.keep_row for r in got) == len(groups)
    assert sorted(fold(r.text) for r in op02_exact_dedup.first_of_each(docs).collect()) == sorted(groups)


def test_long_repeats(docs, none):
    span = 40
    got = op03_long_repeats.without_repeats(docs, span, 16).collect()
    seen = Counter()
    for _, t in TEXTS:
        b = (t or "").encode()
        seen.update(b[i:i + span] for i in range(len(b) - span + 1))
    want = []
    for i, t in TEXTS:
        b = (t or "").encode()
        cover = np.zeros(len(b), bool)
        for k in range(len(b) - span + 1):
            if seen[b[k:k + span]] > 1:
                cover[k:k + span] = True
        n = int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum())
        want.append((i, len(b), int(cover.sum()), n, hashlib.sha256(np.frombuffer(b, np.uint8)[~cover].tobytes()).hexdigest()))
    assert sorted(map(repr, (tuple(r)[:5] for r in got))) == sorted(map(repr, want))
    assert not op03_long_repeats.without_repeats(none).collect()


def test_long_repeats_by_counted_windows(docs):
    one = op03_long_repeats.repeated_spans(docs, 40, 16).collect()
    other = op03_long_repeats.repeated_spans(docs, 40, 16, block_pieces=1).collect()

    def covered(rows):
        return {(r.d, r.t): {x for s in r.spans for x in range(s.start, s.stop)} for r in rows}

    assert covered(one) == covered(other)


def test_run_index_finds_the_longest_matches():
    data = "".join(R.choice("ab") for _ in range(300)).encode() + b"\xff"
    got = op03_long_repeats.RunIndex(np.frombuffer(data, np.uint8)).statistics()
    for i in range(len(data)):
        k = 0
        while i + k < len(data) and any(data[j:j + k + 1] == data[i:i + k + 1] for j in range(len(data) - k) if j != i):
            k += 1
        assert got[i] == k


def test_simhash(docs, none):
    import xxhash

    def by_hand(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", fold(text))
        h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    got = op07_simhash.near_groups(docs, tile=2).collect()
    assert len(got) == len(TEXTS) and not op07_simhash.near_groups(none).collect()
    prints = {by_hand(t) for _, t in TEXTS}
    assert {r.fp % (1 << 64) for r in got} == prints
    group = {p: {p} for p in prints}
    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= 2 and group[a] is not group[b]:
                group[a] |= group[b]
                for p in group[b]:
                    group[p] = group[a]
    for r in got:
        ids = [i for i, t in TEXTS if by_hand(t) in group[r.fp % (1 << 64)] and i is not None]
        assert r.component_id == min(ids)


def test_simhash_keeps_one_row_of_each_group(spark, docs):
    found = op07_simhash.near_groups(docs).collect()
    kept = op07_simhash.one_of_each(docs).collect()
    assert len(kept) == len({r.label for r in found}) and kept[0].t == "clash"
    # an id that stands for two texts, a repeated row, and texts without ids
    rows = [(3, "one two three"), (5, "one two three"), (5, "quite another text"), (5, "quite another text"), (None, "no id at all"), (None, "no id at all"),
            (None, "one two three"), (None, None)]
    left = op07_simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(repr, map(tuple, left))) == sorted(map(repr, [rows[0], rows[2], rows[4], rows[7]]))


def test_components(spark):
    pairs = [(R.randrange(60), R.randrange(60)) for _ in range(45)]
    got = dict(components(spark.createDataFrame(pairs, "a long, b long")).collect())
    label = {x: x for p in pairs if p[0] != p[1] for x in p}
    for _ in range(60):
        for a, b in pairs:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label


def test_toxicity_on_held_out_rows(spark, docs, none):
    words = ["plain", "words", "about", "nothing", "much", "that", "matters", "here"]
    rows, labels = [], []
    for i in range(900):
        text = [R.choice(words) for _ in range(60)]
        bad = i % 4 == 0
        if bad:
            text[R.randrange(60)] = "scum"
            text[R.randrange(60)] = f"vile{R.choice(words)}"
        rows.append((i, " ".join(text)))
        labels.append((i, None, int(bad)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    model = op04_toxicity.fit_toxicity(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = op04_toxicity.with_toxicity(table, ["doc_id", "text"], model).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([(r.tox_score >= 0.7) == (r.doc_id % 4 == 0) for r in held]) > 0.97
    assert any("scum" in r.text[s.start:s.stop] for r in held for s in r.tox_spans)
    awkward = op04_toxicity.with_toxicity(docs, ["doc_id"], model).collect()
    assert len(awkward) == len(TEXTS) and all(0 <= r.tox_score <= 1 for r in awkward)
    assert not op04_toxicity.without_toxic(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()


def test_chain_marginals_equal_enumeration():
    model = op04_toxicity.ChainModel({}, 0.0, ((1.0, 0.4), (0.7, 2.0)), 0.8, (0.0, 1.0))
    e = np.random.default_rng(1).normal(size=9)
    mass = np.zeros((9, 2))
    for code in range(1 << 9):
        s = [code >> k & 1 for k in range(9)]
        p = (0.8 if s[0] else 1.0) * math.prod(model.step[a][b] for a, b in zip(s, s[1:])) * math.exp(sum(x for x, y in zip(e, s) if y))
        for k in range(9):
            mass[k, s[k]] += p
    got = op04_toxicity.chain_marginals(model, np.concatenate([e, e]), np.array([9, 0, 9]))
    assert np.allclose(got, np.tile(mass[:, 1] / mass.sum(axis=1), 2))


def test_quality_on_held_out_rows(spark, sf, docs, none):
    got = {r.doc_id: r for r in QUERIES["op5_quality"](spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    held = [(got[x.doc_id].predicted, x.quality) for x in labels if got[x.doc_id].held_out]
    assert np.mean([a == b for a, b in held]) > 0.93
    model = op05_quality.fit_additive(np.zeros((0, 16)), np.zeros(0), np.zeros(0))
    assert {r.quality_score for r in op05_quality.with_quality(docs, ["doc_id"], model).collect()} == {0.5}
    assert not op05_quality.with_quality(none, ["doc_id"], model).collect()


def test_byte_bpe_equals_the_library(docs, none):
    from tokenizers import Tokenizer

    path = op06_byte_bpe.vocabulary_path("byte_bpe_50k.json")
    library, merges = Tokenizer.from_file(path), byte_bpe.load_merges(path)
    code = op06_byte_bpe.coder(merges)
    letters = "".join(R.choice("theandofinger") for _ in range(20_000))
    texts = [t or "" for _, t in TEXTS] + [letters, " " * 3000 + "x", "x<|endoftext|> y", "a \t\n\x85 b's 12 34!?"]
    texts += ["".join(f"a{chr(c)}b {chr(c)} {chr(c)}\n" for c in range(a, a + 64)) for a in range(0, 0x3000, 64)]
    for text, got in zip(texts, code(texts)):
        ids = library.encode(text, add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert got == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    for text in ("7" * 200_000, "日本語のてがみ" * 15_000, "ab" * 50_000, "".join(R.choice("あいうえお漢字") for _ in range(60_000))):  # pre-tokens without an end in sight
        ids = library.encode(text, add_special_tokens=False).ids
        assert code([text])[0][:2] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    stream, held, out = byte_bpe.StreamEncoder(byte_bpe.Transducer(merges)), 0, []
    for k in range(0, len(letters), 100):
        out += stream.feed(letters[k:k + 100].encode())
        held = max(held, len(stream.data))
    assert out + stream.finish() == library.encode(letters, add_special_tokens=False).ids and held <= 4 * stream.keep
    assert not op06_byte_bpe.with_tokens(none, ["doc_id"], path).collect()
    assert op06_byte_bpe.with_tokens(docs, ["doc_id"], path).count() == len(TEXTS)


def test_licenses(docs, none):
    got = op08_licenses.scan(docs, ["doc_id", "text"]).collect()
    assert len(got) == len(TEXTS) and not op08_licenses.scan(none, ["doc_id"]).collect()
    for r in got:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(r.text))
        want = sorted((i, label) for p, label in op08_licenses.BASE for i in range(len(words)) if words[i:i + len(p.split())] == p.split())
        assert r.n_words == len(words) and sorted((b.place, b.label) for b in r.base) == want
    assert {m.label for r in got if r.doc_id == 11 for m in r.matches} >= {"mit"}


def test_token_counts_equal_the_library(docs, none):
    import sentencepiece

    path = op09_token_counts.vocabulary_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    count = op09_token_counts.counter(op09_token_counts.load_pieces(path))
    texts = [t or "" for _, t in TEXTS] + [" ", "  ", "   a  b", "a ", "a  ", "\n", "\n\n a", "a\n  b\n", "▁a▁▁b", "<s> </s> <unk> <0x0A>", "a\tb", "12345", "x" + " " * 70 + "y"]
    assert [n for n, in count(texts)] == [len(library.encode(t)) for t in texts]
    assert not op09_token_counts.with_counts(none, ["doc_id"], path).collect()


def test_lattice_scores(docs, none):
    path = op10_lattice_lm.vocabulary_path("piece_bpe_32k.model")
    lattice = op10_lattice_lm.load_lattice(path)

    def by_hand(s):
        return 1.0 if not s else sum(10 ** w * by_hand(s[len(p):]) for p, w in lattice.piece.items() if s.startswith(p))

    assert abs(lattice.log10("them") - math.log10(by_hand("▁them"))) < 1e-9
    words = {i: fold(t).encode().split() for i, t in enumerate(t for _, t in TEXTS)}
    train = [i for i, (d, _) in enumerate(TEXTS) if zlib.crc32(b"" if d is None else str(d).encode()) % 7 != 2]
    c = Counter(w for i in train for w in words[i])
    n, v = sum(c.values()) + len(train), len(c) + 1
    want = sorted((len(w) + 1, sum(c[x] > 0 for x in w) + 1, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((len(train) + 1) / (n + v + 1)), 6))
                  for w in words.values())
    for common in (1, 1_000_000):  # almost all words by the join, and almost all held by the tasks
        got = op10_lattice_lm.text_scores(docs, path, common).collect()
        assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want and {r.train_tokens for r in got} == {n}
    assert not op10_lattice_lm.text_scores(none, path).collect()


def test_decontamination(spark, none):
    words = [f"w{k}" for k in range(3000)] + ["the", "of", "and"] * 50
    items = [(k, " ".join(R.choice(words) for _ in range(R.randrange(12, 60)))) for k in range(60)] + [(None, None), (99, ""), (98, "too short")]
    rows, want = [], set()
    for i in range(120):
        text = [R.choice(words) for _ in range(R.randrange(0, 400))]
        if i % 3 == 0:
            k = R.randrange(60)
            at = R.randrange(len(text) + 1)
            text[at:at] = items[k][1].upper().split()
            want.add((i, k))
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame([*rows, (500, None), (501, "")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (4_000_000, 3_000):
        assert {(r.doc_id, r.item_id) for r in op01_decontaminate.contaminated(docs, bench, size).collect()} == want
    leaking = {i for i, _ in want}
    assert {r.doc_id for r in op01_decontaminate.without_leaks(docs, bench).collect()} == {i for i, _ in rows if i not in leaking} | {500, 501}
    assert not op01_decontaminate.contaminated(none, bench).collect()
    assert not op01_decontaminate.contaminated(docs, bench.where("false")).collect()


def test_block_max_wand_equals_full_scoring():
    items = [(k, " ".join(R.choice("abcdefghijklmnopqrst") for _ in range(12))) for k in range(80)]
    df = Counter(w for _, t in items for w in set(t.split()))
    index = op01_decontaminate.build_index(items, df, len(items), 12.0)
    for _ in range(50):
        terms = sorted(R.sample(range(len(index.vocabulary)), 12))
        score = Counter()
        for t in terms:
            for k, x in zip(*index.postings[t]):
                score[k] += x
        got = op01_decontaminate.block_max_wand(index, terms)
        assert sorted(k for k, _ in got) == sorted(k for k, s in score.items() if s >= 0.6 - 1e-9)


def test_byte_bpe_gives_up_places_and_agrees_with_the_transducer():
    """op6: short pre-tokens are coded longest token first with places given up; the tokens are those of the pass over all prefixes."""
    import random

    ready = byte_bpe.Transducer(byte_bpe.load_merges(op06_byte_bpe.vocabulary_path("byte_bpe_50k.json")))
    draw, tokens = random.Random(7), list(ready.merges.ids)
    cases = [b"".join(draw.choices(tokens, k=3)) for _ in range(1500)] + [bytes(draw.choices(b"aeinrst", k=12)) for _ in range(1500)] + [b"0" * 90, bytes(range(256))]
    for data in (c.decode("latin-1") for c in cases if len(c) <= ready.keep):
        ends = [-1]
        ready.extend(data, ends, 0)
        assert ready.longest_first(data) == ready.chain(ends, len(data))

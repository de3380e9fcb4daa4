"""Benchmark decontamination: BM25 over an inverted index of test items, searched with block-max WAND.

Test items are the indexed side; every passage of every document is a query. Impacts are BM25 weights divided by the item's own score, so
that a passage holding a whole item scores 1 and the threshold means the same for every item. A passage is first bounded
by its essential terms (those rare among the items) for each block of items; only where a block can still
reach the threshold does the WAND search run, and what it retrieves is verified by the overlap of question and answer.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import defaultdict
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pollwarden.llm.common import documents, map_text, table

WORD = re.compile(r"[^\W_]+")
#: Letters of scripts that write no spaces: each is a word.
UNSPACED = re.compile(r"[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3041-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF]")
MIXED_WORD = re.compile(UNSPACED.pattern + "|" + r"[^\W_" + UNSPACED.pattern[1:] + "+")
K1, B = 1.2, 0.75
#: Share of an item's own BM25 score that a passage must reach.
THRESHOLD = 0.6
#: Share of the question's and of the answer's shingles that the passage must hold.
OVERLAP = 0.8
SHINGLE = 5
BLOCK = 8
#: Text of test items that one broadcast index may hold; more items make more shards, each a pass over the documents.
SHARD_BYTES = 4_000_000
ANSWER = re.compile(r"\n\s*(?:answer|a)\s*:", re.I)


def words_of(text: str) -> list[str]:
    """Lower-case words; letters of scripts without spaces count one by one."""
    text = text.lower()
    return (WORD if text.isascii() or not UNSPACED.search(text) else MIXED_WORD).findall(text)


def split_item(text: str) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer: at a line that begins with 'answer:', else after two thirds of the words."""
    mark = None
    for mark in ANSWER.finditer(text):
        pass
    if mark:
        q, a = words_of(text[: mark.start()]), words_of(text[mark.end():])
        if q and a:
            return q, a
    words = words_of(text)
    cut = max(1, -(-2 * len(words) // 3))
    return words[:cut], words[cut:]


def shingles(words: list[str]) -> set[str]:
    n = min(SHINGLE, len(words))
    return {" ".join(words[i:i + n]) for i in range(len(words) - n + 1)} if n else set()


@dataclass
class ItemIndex:
    """Inverted index of one shard of items; item numbers follow the order of `ids`."""

    ids: list
    vocabulary: dict[str, int]
    postings: list[tuple[list[int], list[float]]]
    block_max: list[dict[int, float]]
    upper: list[float]
    question: list[set[str]]
    answer: list[set[str]]
    longest: int
    essential: np.ndarray  # by term
    need: np.ndarray  # by block: what essential terms must bring
    starts: np.ndarray = field(default=None)  # essential block maxima, by term
    blocks: np.ndarray = field(default=None)
    maxima: np.ndarray = field(default=None)


def build_index(items: list[tuple[int | None, str]], df: dict[str, int], n_items: int, mean_length: float,
                threshold: float = THRESHOLD) -> ItemIndex | None:
    """Index of a shard with the corpus statistics of all items.

    An item of fewer words than a shingle is held as one run of words, which a passage must hold as it stands; one without a word is left out.
    """
    parsed = []
    for item_id, text in items:
        q, a = split_item(text or "")
        if len(q) + len(a) < SHINGLE:
            q, a = q + a, []
        if q:
            parsed.append((item_id, q, a))
    if not parsed:
        return None
    parsed.sort(key=lambda p: (len(p[1]) + len(p[2]), str(p[0])))
    vocabulary: dict[str, int] = {}
    lists: list[tuple[list[int], list[float]]] = []
    for k, (_, q, a) in enumerate(parsed):
        tf: dict[str, int] = defaultdict(int)
        for w in [*q, *a]:
            tf[w] += 1
        norm = K1 * (1 - B + B * (len(q) + len(a)) / max(mean_length, 1e-9))
        weight = {w: math.log(1 + (n_items - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + norm) for w, c in tf.items()}
        own = sum(weight.values())
        for w, x in weight.items():
            t = vocabulary.setdefault(w, len(vocabulary))
            if t == len(lists):
                lists.append(([], []))
            lists[t][0].append(k)
            lists[t][1].append(x / own)
    maxima = []
    for places, impacts in lists:
        top: dict[int, float] = {}
        for k, x in zip(places, impacts):
            top[k // BLOCK] = max(top.get(k // BLOCK, 0.0), x)
        maxima.append(top)
    words = list(vocabulary)
    essential = np.array([df[w] <= max(1, n_items // 10) for w in words])
    common = np.zeros(len(parsed))
    for t, (places, impacts) in enumerate(lists):
        if not essential[t]:
            common[places] += impacts
    n_blocks = -(-len(parsed) // BLOCK)
    need = np.array([threshold - common[b * BLOCK:(b + 1) * BLOCK].max() for b in range(n_blocks)])
    index = ItemIndex([p[0] for p in parsed], vocabulary, lists, maxima, [max(x) for _, x in lists], [shingles(p[1]) for p in parsed],
                      [shingles(p[2]) for p in parsed], max(len(p[1]) + len(p[2]) for p in parsed), essential, need)
    sizes = [len(m) if e else 0 for m, e in zip(maxima, essential)]
    index.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    index.blocks = np.array([b for m, e in zip(maxima, essential) if e for b in m], np.int64)
    index.maxima = np.array([x for m, e in zip(maxima, essential) if e for x in m.values()], float)
    return index


def block_max_wand(index: ItemIndex, terms: list[int], threshold: float = THRESHOLD) -> list[tuple[int, float]]:
    """Every item whose score for these distinct terms reaches the threshold, item by item with block-max skipping."""
    lists = [[index.postings[t][0], index.postings[t][1], 0, index.upper[t], index.block_max[t]] for t in terms]
    found = []
    slack = threshold - 1e-9
    while lists:
        lists.sort(key=lambda c: c[0][c[2]])
        bound, pivot = 0.0, -1
        for k, c in enumerate(lists):
            bound += c[3]
            if bound >= slack:
                pivot = k
                break
        if pivot < 0:
            break
        item = lists[pivot][0][lists[pivot][2]]
        while pivot + 1 < len(lists) and lists[pivot + 1][0][lists[pivot + 1][2]] == item:
            pivot += 1
        block = item // BLOCK
        if sum(c[4].get(block, 0.0) for c in lists[: pivot + 1]) >= slack:
            go = item
            if lists[0][0][lists[0][2]] == item:
                score = sum(c[1][c[2]] for c in lists[: pivot + 1])
                if score >= slack:
                    found.append((item, score))
                go = item + 1
        else:
            go = (block + 1) * BLOCK
            if pivot + 1 < len(lists):
                go = min(go, lists[pivot + 1][0][lists[pivot + 1][2]])
            go = max(go, item + 1)
        for c in lists[: pivot + 1]:
            c[2] = bisect_left(c[0], go, c[2])
        lists = [c for c in lists if c[2] < len(c[0])]
    return found


def matcher(index: ItemIndex, threshold: float = THRESHOLD, overlap: float = OVERLAP):
    """Function over texts: for each, the verified items as (item_id, score, question overlap, answer overlap, first word, passages).

    A passage is a window of twice the longest item, moved by the longest item: an item's words lie whole in at least one.
    """
    step, size = index.longest, len(index.vocabulary)
    n_blocks = len(index.need)

    def one_batch(texts: list[str]) -> list[tuple]:
        words = [words_of(t) for t in texts]
        lengths = np.array([len(w) for w in words], np.int64)
        ids = np.fromiter((t for w in words for t in map(index.vocabulary.get, w, repeat(-1))), np.int64, int(lengths.sum()))
        ends = np.cumsum(lengths)
        n_windows = np.maximum(1, -(-lengths // step) - 1)
        base = np.cumsum(n_windows) - n_windows
        at = np.nonzero(ids >= 0)[0]
        doc = np.searchsorted(ends, at, "right")
        local = (at - (ends - lengths)[doc]) // step
        first = base[doc] + np.minimum(local, n_windows[doc] - 1)
        second = (local >= 1) & (local <= n_windows[doc] - 1)
        window = np.concatenate([first, first[second] - 1])
        term = np.concatenate([ids[at], ids[at][second]])
        rare = index.essential[term]
        key = np.unique(window[rare] * size + term[rare])
        w, t = key // size, key % size
        count = index.starts[t + 1] - index.starts[t]
        place = np.repeat(index.starts[t] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        cell = np.repeat(w, count) * n_blocks + index.blocks[place]
        cells, inverse = np.unique(cell, return_inverse=True)
        bound = np.bincount(inverse, index.maxima[place], len(cells)) if len(cells) else np.zeros(0)
        alive = np.unique(cells[bound >= index.need[cells % n_blocks] - 1e-9] // n_blocks)
        if (index.need <= 0).any():  # an item of common terms only: nothing can be bounded away
            alive = np.arange(int(n_windows.sum()))
        found: dict[int, dict[int, list]] = defaultdict(dict)
        if len(alive):
            order = np.argsort(window, kind="stable")
            ws, ts = window[order], term[order]
            lo, hi = np.searchsorted(ws, alive, "left"), np.searchsorted(ws, alive, "right")
            owner = np.searchsorted(base, alive, "right") - 1
            for win, a, b, d in zip(alive.tolist(), lo.tolist(), hi.tolist(), owner.tolist()):
                hits = block_max_wand(index, np.unique(ts[a:b]).tolist(), threshold)
                if not hits:
                    continue
                start = (win - int(base[d])) * step
                held = shingles_of(words[d][start:start + 2 * step])
                for item, score in hits:
                    q, n = share(index.question[item], held), share(index.answer[item], held)
                    if q >= overlap and n >= overlap:
                        old = found[d].get(item)
                        if old is None:
                            found[d][item] = [index.ids[item], score, q, n, start, 1]
                        else:
                            found[d][item] = [old[0], max(old[1], score), max(old[2], q), max(old[3], n), old[4], old[5] + 1]
        return [([tuple(found[d][k]) for k in sorted(found[d])] if d in found else [],) for d in range(len(texts))]

    return one_batch


class shingles_of:
    """Shingles of a passage, of each length that a question or answer asks for."""

    def __init__(self, words: list[str]):
        self.words, self.by_length = words, {}

    def of(self, n: int) -> set[str]:
        if n not in self.by_length:
            w = self.words
            self.by_length[n] = {" ".join(w[i:i + n]) for i in range(len(w) - n + 1)}
        return self.by_length[n]


def share(wanted: set[str], held: shingles_of) -> float:
    """Share of shingles found; nothing wanted counts as found."""
    if not wanted:
        return 1.0
    own = held.of(next(iter(wanted)).count(" ") + 1)
    return sum(s in own for s in wanted) / len(wanted)


HITS = "hits array<struct<item_id:long,score:double,question_overlap:double,answer_overlap:double,first_word:int,n_passages:int>>"


def item_shards(items: DataFrame, shard_bytes: int = SHARD_BYTES):
    """Indexes of all items, shard by shard; statistics are those of all items. Null texts are passed over."""
    known = items.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    words = map_text(known, ["item_id", "text"], "text", "words array<string>", lambda texts: [(words_of(t),) for t in texts])
    words = words.where(F.size("words") > 0)
    n, mean = words.agg(F.count("*"), F.avg(F.size("words"))).first()
    shard = F.pmod(F.xxhash64("item_id", "text"), F.lit(shards))
    terms = words.select(shard.alias("shard"), F.explode(F.array_distinct("words")).alias("term"))
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    for k in range(shards):
        own = [(r[0], r[1]) for r in known.where(shard == k).collect()]  # about shard_bytes of text
        counts = dict(terms.where(F.col("shard") == k).select("term").distinct().join(df, "term").select("term", "df").collect())
        index = build_index(own, counts, n, mean or 1.0)
        if index is not None:
            yield index


def with_hits(docs: DataFrame, columns: list[str], index: ItemIndex) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)  # of SHARD_BYTES of item text
    return map_text(docs, columns, "text", HITS, None, setup=lambda: matcher(shared.value))


def contaminated(docs: DataFrame, items: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, first_word, n_passages) for each verified pair.

    Null and empty texts match nothing; a repeated document or item has its own rows; a null id is carried along. No items: no rows.
    """
    out = None
    for index in item_shards(items, shard_bytes):
        part = with_hits(docs, ["doc_id"], index).select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")
        out = part if out is None else out.union(part)
    if out is None:
        empty = docs.sparkSession.createDataFrame([], HITS)
        out = empty.select(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.explode("hits").alias("h")).select("doc_id", "h.*")
    return out


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item and how it was verified."""
    return contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs that hold no item, with all their columns."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    rest = docs.toDF(*names)
    for index in item_shards(items):
        plain = rest.withColumn("text", F.col(names[docs.columns.index("text")]))
        rest = with_hits(plain, names, index).where(F.size("hits") == 0).select(*names)
    return rest.toDF(*docs.columns)

"""Token counts under a sentence-piece BPE vocabulary with the whole-token shortcut.

The vocabulary shows where texts can be cut: no piece spans two characters that stand side by side in no piece, nor the space mark after
another character. What lies between cuts is a pre-token. Strings proven once to encode alone as one token are counted directly; only
other pre-tokens are merged, and each distinct one only once in a task.
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pollwarden.llm.common import documents, map_text
from pollwarden.llm.op06_byte_bpe import vocabulary_path

MARK = "▁"
LIMIT = 4096


@dataclass
class PieceTable:
    """score: of pieces that merging can make; whole: those that encode alone as one token; joins: pairs of characters side by side in a piece."""

    score: dict[str, float]
    whole: set[str]
    joins: set[str]


def load_pieces(path: str) -> PieceTable:
    """Read a vocabulary file with its library and prove the whole tokens; runs on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    score = {model.id_to_piece(i): model.get_score(i) for i in range(model.vocab_size())
             if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
    joins = {p[k:k + 2] for p in score for k in range(len(p) - 1)}
    whole = {p for p in score if merged(p, score) == 1}
    return PieceTable(score, whole, joins)


def merged(text: str, score: dict[str, float]) -> int:
    """Tokens that merging leaves: best score first, leftmost of equals; characters outside the vocabulary fall back to bytes."""
    symbols: list[str | None] = list(text)
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []

    def offer(i: int, j: int) -> None:
        both = symbols[i] + symbols[j]
        s = score.get(both)
        if s is not None:
            heapq.heappush(heap, (-s, i, both))

    for i in range(n - 1):
        offer(i, i + 1)
    while heap:
        _, i, both = heapq.heappop(heap)
        j = after[i] if symbols[i] is not None else n
        if j >= n or symbols[j] is None or symbols[i] + symbols[j] != both:
            continue
        symbols[i], symbols[j] = both, None
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        if before[i] >= 0:
            offer(before[i], i)
        if after[i] < n:
            offer(i, after[i])
    return sum(1 if s in score else len(s.encode()) for s in symbols if s is not None)


class Counts(dict):
    """Tokens of a pre-token, with a prefix that stands before it; forgotten altogether when full."""

    def __init__(self, table: PieceTable, prefix: str, limit: int = 400_000):
        super().__init__()
        self.table, self.prefix, self.limit = table, prefix, limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        n = count_between(self.prefix + word, self.table)
        if len(word) <= 64:
            self[word] = n
        return n


def count_between(text: str, table: PieceTable) -> int:
    """Tokens of a string without inner cuts at the space mark: cut where no piece joins two characters, then whole or merged."""
    if text in table.whole:
        return 1
    total, at = 0, 0
    joins = table.joins
    for k in range(1, len(text) + 1):
        if k == len(text) or text[k - 1:k + 1] not in joins:
            part = text[at:k]
            total += 1 if part in table.whole else merged(part, table.score)
            at = k
    return total


def counter(table: PieceTable):
    """Function over texts that gives (tokens,) for each."""
    marked, bare = Counts(table, MARK), Counts(table, "")
    parts = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall
    line_break = count_between("\n", table)
    cuts_lines = not any("\n" in pair for pair in table.joins)

    def slow(text: str) -> int:
        return sum(map(bare.__getitem__, parts(text)))

    def one(text: str) -> tuple[int]:
        if not text:
            return (0,)
        if "  " in text or MARK in text or text[0] == " " or not cuts_lines:
            lines = text.replace(" ", MARK).split("\n") if cuts_lines else [text.replace(" ", MARK)]
            return (slow(MARK + lines[0]) + sum(map(slow, lines[1:])) + line_break * (len(lines) - 1),)
        lines = text.split("\n")
        total = line_break * (len(lines) - 1)
        for k, line in enumerate(lines):
            words = line.split(" ")
            total += sum(map(marked.__getitem__, words[1:]))
            if k == 0:
                total += marked[words[0]]
            elif words[0]:
                total += bare[words[0]]
        return (total,)

    return lambda texts: [one(t) for t in texts]


def with_counts(docs: DataFrame, columns: list[str], path: str) -> DataFrame:
    """columns of docs, n_bytes and n_tokens; null counts as empty, which has no token. Rows are counted one by one; no rows give none."""
    shared = docs.sparkSession.sparkContext.broadcast(load_pieces(path))  # a file of fixed size
    return map_text(docs, columns, "text", "n_tokens long", None, setup=lambda: counter(shared.value))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return with_counts(docs, ["doc_id", "n_bytes"], vocabulary_path("piece_bpe_32k.model")).withColumn("over_limit", F.col("n_tokens") > LIMIT)

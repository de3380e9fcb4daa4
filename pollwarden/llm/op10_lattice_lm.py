"""Language-model scores by the likelihood of subword lattices.

The scores of an existing piece vocabulary are ranks; a piece weighs by Zipf's law of its rank. A word's likelihood adds up all its segmentations
by a forward recursion in log space. Word counts of the training texts are mixed in by how often training meets a new word
(Witten and Bell): P(w) = a count(w)/N + (1 - a) lattice(w), a = N / (N + V). Spaces end words, so a text's lattice is the
product of its words' lattices, and its log probability the sum over its tokens.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pollwarden.llm.common import FOLD_BYTES, documents, fold_of, map_text, slices, whole_text
from pollwarden.llm.op06_byte_bpe import vocabulary_path
from pollwarden.session import cut_lineage

MARK = "▁"
PARTS, OUT = 7, 2
#: Every task holds the words that make up at least one in so many training tokens, which are at most so many; all others are looked up by a join.
COMMON = 1_000_000
#: Distinct words that a task gathers before it hands on its counts.
GATHERED = 400_000


@dataclass
class Lattice:
    """log10 weights of pieces, of a byte of a character outside the vocabulary, and of the end of a text."""

    piece: dict[str, float]
    byte: float
    end: float
    longest: int

    def log10(self, word: str) -> float:
        """Marginal log10 probability of a word over all its segmentations."""
        text = MARK + word
        n, get, ln = len(text), self.piece.get, math.log(10)
        total = [0.0] + [0.0] * n
        for j in range(1, n + 1):
            terms = []
            for i in range(max(0, j - self.longest), j):
                w = get(text[i:j])
                if w is not None:
                    terms.append(total[i] + w)
            if len(terms) == 1:
                total[j] = terms[0]
            elif terms:
                top = max(terms)
                total[j] = top + math.log(sum([math.exp((t - top) * ln) for t in terms])) / ln
            else:
                total[j] = total[j - 1] + self.byte * len(text[j - 1].encode())
        return total[n]


def load_lattice(path: str) -> Lattice:
    """Weights from a vocabulary file: pieces by rank, the end of a text like the first piece, bytes like the last; they sum to 1."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [i for i in range(model.vocab_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    rank = {model.id_to_piece(i): min(-model.get_score(i), float(len(names))) for i in names}
    weight = {p: 1 / (2.0 + max(0.0, r)) for p, r in rank.items()}
    end, byte = 0.5, 1 / (2.0 + len(names))
    whole = math.log10(sum(weight.values()) + end + 256 * byte)
    return Lattice({p: math.log10(w) - whole for p, w in weight.items()}, math.log10(byte) - whole, math.log10(end) - whole, max(map(len, weight)))


def words_in(text: str) -> list[bytes]:
    return text.encode().translate(FOLD_BYTES).split()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c, texts): every word of every text with its count in training texts; counts are gathered in each task first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        other: set = set()

        def out():
            words = [*count, *(w for w in other if w not in count)]
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in words], pa.string()), pa.array([count.get(w, 0) for w in words], pa.int64())], ["word", "c"])

        for batch in batches:
            for part in slices(batch, 4_000_000):
                for held, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    (other if held else count).update(words_in(text))
                if len(count) + len(other) >= GATHERED:
                    yield out()
                    count, other = Counter(), set()
        yield out()

    rows = docs.select((fold_of("doc_id", PARTS) == OUT).alias("held"), whole_text().alias("text"))
    return rows.mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def scored_words(counts: DataFrame, lattice: Lattice) -> DataFrame:
    """(word, c, lattice) for every distinct word."""
    shared = counts.sparkSession.sparkContext.broadcast(lattice)  # one number for each piece of the vocabulary
    return map_text(counts, ["word", "c"], "word", "lattice double", lambda words: [(shared.value.log10(w),) for w in words])


@dataclass
class Totals:
    n: int
    v: int
    ends: int
    end: float

    def base(self, c):
        return math.log10((c + 1) / (self.n + self.v + 1))

    def mixed(self, c: int, lattice: float) -> float:
        a = self.n / (self.n + self.v) if self.n else 0.0
        return math.log10(a * c / max(1, self.n) + (1 - a) * 10 ** max(lattice, -290)) if c else math.log10(1 - a) + lattice


def head_scores(common: dict[bytes, tuple[int, float]], totals: Totals):
    """Function over texts: sums over the end and the common words of each, and the other words with their counts."""
    value = {w: (totals.base(c), totals.mixed(c, x), c > 0) for w, (c, x) in common.items()}
    first = (totals.base(totals.ends), totals.mixed(totals.ends, totals.end), totals.ends > 0)

    def one(text: str) -> tuple:
        words = words_in(text)
        base, mixed, known = first
        known = int(known)
        rest = []
        for w, k in Counter(words).items():
            got = value.get(w)
            if got is None:
                rest.append((w.decode(), k))
            else:
                base += k * got[0]
                mixed += k * got[1]
                known += k * got[2]
        return len(words) + 1, base, mixed, known, rest

    return lambda texts: [one(t) for t in texts]


def text_scores(docs: DataFrame, path: str, common: int = COMMON) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Null and empty texts hold the end alone. Held-out texts are scored, not learned from; a null id counts as empty text in the fold. Without training
    texts every probability comes from the lattice. Repeated rows are scored each. An empty table gives no rows.
    """
    spark, lattice = docs.sparkSession, load_lattice(path)
    words = cut_lineage(scored_words(word_counts(docs), lattice))
    n, v = words.agg(F.sum("c"), F.count(F.when(F.col("c") > 0, 1))).first()
    ends = docs.where(fold_of("doc_id", PARTS) != OUT).count()
    totals = Totals((n or 0) + ends, v + (ends > 0), ends, lattice.end)
    top = words.where(F.col("c") >= F.lit(max(1, -(-totals.n // common)))).collect()  # no more than `common`, for their counts add up to n
    shared = spark.sparkContext.broadcast({r["word"].encode(): (r["c"], r["lattice"]) for r in top})
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    heads = map_text(rows, ["doc_id", "row"], "text",
                     "n_tokens long, head_base double, head_mixed double, head_known long, rest array<struct<word:string,k:long>>",
                     None, setup=lambda: head_scores(shared.value, totals))
    # one row for each other word of a text, and one that carries what is known of the text under a word that no text has
    head = F.struct(F.concat(F.lit(" "), F.col("row").cast("string")).alias("word"), F.lit(0).cast("long").alias("k"))
    each = heads.select("doc_id", "row", "n_tokens", "head_base", "head_mixed", "head_known", F.posexplode(F.concat(F.array(head), F.col("rest"))).alias("p", "r"))
    only = [F.when(F.col("p") == 0, F.col(c)).alias(c) for c in ("doc_id", "n_tokens", "head_base", "head_mixed", "head_known")]
    each = each.select("row", F.col("r.word").alias("word"), F.col("r.k").alias("k"), *only)
    share = totals.n / (totals.n + totals.v) if totals.n else 0.0
    base = F.log10((F.col("c") + 1) / float(totals.n + totals.v + 1))
    mixed = F.when(F.col("c") > 0, F.log10(F.col("c") * (share / max(1, totals.n)) + (1 - share) * F.pow(F.lit(10.0), F.greatest("lattice", F.lit(-290.0))))) \
        .otherwise(F.col("lattice") + math.log10(max(1 - share, 1e-300)))
    value = words.select("word", base.alias("b"), mixed.alias("m"), (F.col("c") > 0).cast("long").alias("known"))
    own = each.join(value, "word", "left")
    got = own.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"),
        (F.sum("head_known") + F.coalesce(F.sum(F.col("k") * F.col("known")), F.lit(0))).alias("n_known"),
        (F.sum("head_base") + F.coalesce(F.sum(F.col("k") * F.col("b")), F.lit(0.0))).alias("base_score"),
        (F.sum("head_mixed") + F.coalesce(F.sum(F.col("k") * F.col("m")), F.lit(0.0))).alias("score"))
    return got.select("doc_id", (fold_of("doc_id", PARTS) == OUT).alias("held_out"), "n_tokens", "n_known",
                      F.lit(totals.n).cast("long").alias("train_tokens"), "base_score", "score")


def op10_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and lattice scores of every document."""
    return text_scores(documents(spark, sf_dir), vocabulary_path("piece_bpe_32k.model"))

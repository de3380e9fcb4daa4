"""Removal of long repeated passages with a run-length compressed index.

Every window of `span` bytes is dealt to its anchor: the smallest hash among its `key`-byte strings. Equal windows have equal anchors at equal
places, so places that share no anchor with another share no window. Consecutive windows with one anchor are one piece of text. Pieces whose
anchor is alone end there; copies of one piece repeat as a whole; different pieces of one anchor are indexed together. A block of such pieces is made into a Burrows-Wheeler
transform whose runs alone are kept, with the text positions sampled at run ends. Lengths of the longest match with any
other place are computed at run ends and streamed along the text, one byte less with each step, until the next run end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pollwarden.llm.common import documents, map_text, slices, whole_text
from pollwarden.session import cut_lineage

SPAN, KEY = 400, 128
#: Bytes hashed at a time; positions in a slice must fit 24 bits.
SLICE = 2_000_000
#: Text of pieces that one index holds (or one anchor's pieces), and pieces of one anchor beyond which windows are counted instead.
BLOCK_BYTES, BLOCK_PIECES = 1_000_000, 4096
BASE = np.uint64(0x9E3779B97F4A7C15)


class Hasher:
    """Hashes of all `key`-byte strings of a buffer, by prefix sums of a polynomial modulo 2^64."""

    def __init__(self, key: int):
        self.key, self.size = key, 0
        self.letters = np.random.default_rng(400).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def _grow(self, n: int) -> None:
        if n <= self.size:
            return
        back = pow(int(BASE), -1, 1 << 64)
        self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, BASE, np.uint64)]), dtype=np.uint64)
        self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(back))]), dtype=np.uint64)
        self.size = n

    def __call__(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        if n < self.key:
            return np.zeros(0, np.uint64)
        self._grow(max(n, 1 << 16))
        total = np.concatenate([[np.uint64(0)], np.cumsum(self.letters[data] * self.up[:n], dtype=np.uint64)])
        h = (total[self.key:] - total[: n - self.key + 1]) * self.down[: n - self.key + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        return h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values, from running minima inside blocks of that width."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    padded = np.concatenate([x, np.full(-len(x) % width, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1: width - 1 + n])


def cut_pieces(data: bytes, hasher: Hasher, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor hash) of every piece of a buffer."""
    width = span - hasher.key + 1
    h = hasher(np.frombuffer(data, np.uint8))
    low = np.uint64(24)
    best = sliding_min((h >> low << low) | np.arange(len(h), dtype=np.uint64), width)
    if not len(best):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = (best & np.uint64((1 << 24) - 1)).astype(np.int64)
    first = np.concatenate([[0], np.nonzero(np.diff(at))[0] + 1])
    return first, np.diff(np.concatenate([first, [len(at)]])), h[at[first]]


def document_pieces(data: bytes, hasher: Hasher, span: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of a whole document, slice by slice; slices overlap so that each window lies in exactly one."""
    for at in range(0, max(1, len(data) - span + 1), SLICE):
        first, count, anchor = cut_pieces(data[at:at + SLICE + span - 1], hasher, span)
        if len(first):
            yield first + at, count, anchor


PIECES = "first int, windows int, anchor long, content long"


def pieces(docs: DataFrame, span: int, key: int) -> DataFrame:
    """(d, t, first, windows, anchor, content): every piece of every text; content is a hash of its bytes."""
    import pyspark.sql.types as T

    schema = T.StructType([*docs.select("d", "t").schema.fields, *T.StructType.fromDDL(PIECES).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hasher, h = Hasher(key), xxhash.xxh3_64_intdigest
        for batch in batches:
            for part in slices(batch, 4_000_000):
                who, cols = [], [[], [], [], []]
                for row, text in enumerate(part.column(2).to_pylist()):
                    data = text.encode()
                    if len(data) < span:
                        continue
                    for first, count, anchor in document_pieces(data, hasher, span):
                        content = np.fromiter((h(data[a:a + n + span - 1]) for a, n in zip(first.tolist(), count.tolist())), np.uint64)
                        who.append(np.full(len(first), row))
                        for c, v in zip(cols, (first, count, anchor, content)):
                            c.append(v)
                if who:
                    rows = pa.array(np.concatenate(who))
                    first, count, anchor, content = (np.concatenate(c) for c in cols)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(rows), part.column(1).take(rows), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32)),
                         pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64))],
                        ["d", "t", "first", "windows", "anchor", "content"])

    return docs.select("d", "t", "text").mapInArrow(run, schema)


def suffix_order(data: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling, from eight bytes on, until all suffixes differ."""
    n = len(data)
    wide = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    first = np.zeros(n, np.uint64)
    for k in range(8):
        first = (first << np.uint64(8)) | wide[k:k + n]
    order = np.argsort(first, kind="stable")
    new = np.concatenate([[False], np.diff(first[order]) != 0])
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(new)
    step = 8
    while rank[order[-1]] < n - 1 and step < 2 * n:
        nxt = np.zeros(n, np.int64)
        nxt[: max(0, n - step)] = rank[step:] + 1
        code = rank * (n + 1) + nxt
        order = np.argsort(code, kind="stable")
        new = np.concatenate([[False], np.diff(code[order]) != 0])
        rank[order] = np.cumsum(new)
        step *= 2
    return order


def common_prefix(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of the suffixes at a and b."""
    n = len(data)
    wide = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(16, np.uint8)]), 8)
    length = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    room = n - np.maximum(a, b)
    while len(live):
        same = wide[a[live] + length[live]] == wide[b[live] + length[live]]
        got = np.where(same.all(axis=1), 8, same.argmin(axis=1))
        length[live] = np.minimum(length[live] + got, room[live])
        live = live[(got == 8) & (length[live] < room[live])]
        live = live[a[live] + length[live] + 8 <= n + 8]
    return length


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of a text, with positions sampled at both ends of every run."""

    def __init__(self, data: np.ndarray):
        order = suffix_order(data)
        before = data[order - 1]  # the first suffix is preceded by the last byte, a separator
        cut = (before[1:] != before[:-1]) | (order[1:] == 0) | (order[:-1] == 0)  # the text's first place has none to its left
        edge = np.nonzero(cut)[0]
        self.data = data
        self.symbols = before[np.concatenate([[0], edge + 1])]
        self.ends, self.starts = order[edge], order[edge + 1]  # text positions of last row of a run and first row of the next
        self.bounds = (int(order[0]), int(order[-1]))
        self.match = common_prefix(data, self.ends, self.starts)

    def statistics(self) -> np.ndarray:
        """For every place of the text the longest match with any other place.

        Along a run the neighbour above (or below) moves with the text, so its match is one byte shorter at each step: only run ends
        are compared, the rest is streamed.
        """
        n = len(self.data)
        longest = np.zeros(n, np.int64)
        for sample, edge in ((self.starts, self.bounds[0]), (self.ends, self.bounds[1])):
            at = np.full(n, -1, np.int64)
            value = np.zeros(n, np.int64)
            at[sample], value[sample] = sample, self.match
            at[edge] = edge
            last = np.maximum.accumulate(at)
            longest = np.maximum(longest, value[last] - (np.arange(n) - last))
        return longest


def repeated_windows(texts: list[bytes], span: int) -> list[np.ndarray]:
    """For each text, which of its windows also start at another place of the block. 0xFF, which UTF-8 never holds, separates texts."""
    data = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8)
    long = RunIndex(data).statistics() >= span
    out, at = [], 0
    for t in texts:
        out.append(long[at:at + len(t) - span + 1])
        at += len(t) + 1
    return out


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, length) of the runs of true values."""
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    first = np.nonzero(edges == 1)[0]
    return list(zip(first.tolist(), (np.nonzero(edges == -1)[0] - first).tolist()))


RUNS = "anchor long, content long, runs array<struct<at:int,n:int>>"


def index_blocks(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """Pieces come sorted by anchor; whole anchors are gathered into blocks and indexed."""
    run_type = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())]))
    held: list[tuple] = []
    size = 0

    def done():
        found = repeated_windows([h[3] for h in held], span)
        out = [runs(np.ones_like(f) if h[2] > 1 else f) for h, f in zip(held, found)]
        return pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.int64()),
                                           pa.array(out, run_type)], ["anchor", "content", "runs"])

    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if held and row[0] != held[-1][0] and size >= BLOCK_BYTES:
                yield done()
                held, size = [], 0
            held.append(row)
            size += len(row[3])
    if held:
        yield done()


def counted_windows(texts: DataFrame, span: int) -> DataFrame:
    """The same answer for anchors with very many different pieces: every window is hashed, and counted by Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for anchor, content, n, data in zip(*(batch.column(k).to_pylist() for k in range(4))):
                m = len(data) - span + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([anchor] * m, pa.int64()), pa.array([content] * m, pa.int64()), pa.array(range(m), pa.int32()), pa.array([n] * m, pa.int64()),
                     pa.array([xxhash.xxh3_128_digest(data[j:j + span]) for j in range(m)], pa.binary())],
                    ["anchor", "content", "at", "n", "window"])

    rows = texts.mapInArrow(run, "anchor long, content long, at int, n long, window binary")
    often = rows.groupBy("window").agg(F.sum("n").alias("places")).where("places > 1").select("window")
    hit = rows.join(often, "window", "left_semi")
    one = F.transform(F.array_sort(F.collect_list("at")), lambda a: F.struct(a.alias("at"), F.lit(1).alias("n")))
    return hit.groupBy("anchor", "content").agg(one.alias("runs"))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and (d, t), which tells rows apart: the id and a hash of the text."""
    text = whole_text()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("d"),
                       F.xxhash64(text).alias("t"), text.alias("text"))


def repeated_spans(docs: DataFrame, span: int = SPAN, key: int = KEY, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """(d, t, spans): for each text with repeats, the byte ranges that repeated windows cover, as unmerged (start, stop) pairs."""
    if not 0 < key <= span:
        raise ValueError("key is at most span")
    rows = keyed(docs)
    all_pieces = pieces(rows, span, key)
    # kept as a table, so that the join deals out both of its sides and Spark can split a hot anchor
    shared = cut_lineage(all_pieces.groupBy("anchor").agg(F.count("*").alias("places"), (F.min("content") != F.max("content")).alias("mixed"))
                         .where("places > 1").select("anchor", "mixed"))
    found = cut_lineage(all_pieces.join(shared, "anchor"))
    classes = found.where("mixed").groupBy("anchor", "content").agg(
        F.count("*").alias("n"), F.min(F.struct("d", "t", "first", "windows")).alias("at"))
    classes = cut_lineage(classes)
    many = cut_lineage(classes.groupBy("anchor").agg(F.count("*").alias("pieces")))
    places = classes.join(many, "anchor").select("at.d", "at.t", F.struct("anchor", "content", "n", "pieces", "at.first", "at.windows").alias("p")) \
        .groupBy("d", "t").agg(F.collect_list("p").alias("ps"))
    texts = cut_lineage(rows.select("d", "t", "text").join(places, ["d", "t"]).dropDuplicates(["d", "t"])
                        .select(F.col("text").cast("binary").alias("b"), F.explode("ps").alias("p"))
                        .select("p.anchor", "p.content", "p.n", F.expr(f"substring(b, p.first + 1, p.windows + {span - 1})").alias("bytes"), "p.pieces"))
    columns = ["anchor", "content", "n", "bytes"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = texts.where(F.col("pieces") <= block_pieces).select(*columns).repartition(parts, "anchor").sortWithinPartitions("anchor")
    answers = few.mapInArrow(lambda b: index_blocks(b, span), RUNS).union(
        counted_windows(texts.where(F.col("pieces") > block_pieces).select(*columns), span))
    answers = cut_lineage(answers.where(F.size("runs") > 0))
    whole = found.where("NOT mixed").select("d", "t", F.col("first").alias("start"), (F.col("first") + F.col("windows") + (span - 1)).alias("stop"))
    part = found.where("mixed").join(answers, ["anchor", "content"]).select("d", "t", "first", F.explode("runs").alias("r")).select(
        "d", "t", (F.col("first") + F.col("r.at")).alias("start"), (F.col("first") + F.col("r.at") + F.col("r.n") + (span - 1)).alias("stop"))
    return whole.union(part).groupBy("d", "t").agg(F.array_distinct(F.collect_list(F.struct("start", "stop"))).alias("spans"))


def keep_rest(data: bytes, spans: list[dict] | None) -> tuple[int, int, int, bytes]:
    """(bytes, removed, maximal removed runs, what is left)."""
    left, at, removed, count = [], 0, 0, 0
    end = -1
    for s in sorted((s["start"], s["stop"]) for s in spans or ()):
        if s[0] > end:
            left.append(data[at if end < 0 else end:s[0]])
            count += 1
            removed += s[1] - s[0]
            end = s[1]
        elif s[1] > end:
            removed += s[1] - end
            end = s[1]
    left.append(data[max(end, 0):])
    return len(data), removed, count, b"".join(left)


def without_repeats(docs: DataFrame, span: int = SPAN, key: int = KEY) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row; kept holds the remaining bytes.

    Null counts as empty; texts shorter than the span lose nothing. A row that repeats another loses every byte if it is long enough, like
    any two equal texts. An empty table gives no rows; other columns are not read.
    """
    spans = repeated_spans(docs, span, key)
    joined = keyed(docs).join(spans, ["d", "t"], "left").select("doc_id", "text", "spans")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 8_000_000, 1):
                rows = [keep_rest(t.encode(), s) for t, s in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                n, removed, count, kept = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()),
                     pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array(kept, pa.binary())],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return joined.mapInArrow(run, schema)


def op3_long_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that 400-byte repeats cover, and what is left without them."""
    return without_repeats(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")

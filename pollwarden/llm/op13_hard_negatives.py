"""Hard negatives by a threshold join in the manner of L2AP (Anastasiu and Karypis 2014).

Rows are dealt into blocks and every anchor visits every block. A block keeps its rows as an inverted index over slices of dimensions: under a
threshold t a row stands in the list of a slice only while its suffix norm from that slice on, times the anchor's norm, can still reach t.
Anchors accumulate partial scores list by list; a row goes as soon as its partial score plus the product of the remaining norms stays below t, and what is left is scored in full.

Thresholds go down until windows fill. Each anchor first meets one block only, lowering its threshold there step by step until the block alone
fills its window: the score found is a bound that the whole table can only raise. With this bound it then meets all blocks, once for the positives and once
for the negatives. Results are exact: a bound never exceeds the score of the last row that belongs into the window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pollwarden.llm.common import table
from pollwarden.llm.vectors import matrix, scaled, usable
from pollwarden.session import cut_lineage

SCALE, POSITIVES, NEGATIVES = 256, 5, 5
#: Rows of a block and anchors compared with it at a time: 32,768 x 64 doubles are 17 MB, partial scores 17 MB.
BLOCK, STEP = 32_768, 64
#: Dimensions of one slice of the index.
SLICE = 8
#: The threshold goes down by this factor until a window fills.
LOWER = 0.8
#: Bounds are computed in doubles; this much relative slack keeps rounding from dropping a row.
SLACK = 1e-9


def suffix_norms(q: np.ndarray) -> np.ndarray:
    """Norm of every row from each slice on; the last column is zero."""
    edges = range(0, q.shape[1], SLICE)
    parts = np.stack([(q[:, s:s + SLICE] ** 2).sum(axis=1) for s in edges], axis=1)
    sums = np.cumsum(parts[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.hstack([sums, np.zeros((len(q), 1))])) * (1 + SLACK)


class Index:
    """One block of rows: vectors as doubles, ordered by norm, and their suffix norms."""

    def __init__(self, exact: np.ndarray, label: np.ndarray):
        q = exact.astype(np.float64)
        norms = suffix_norms(q)
        self.order = np.argsort(-norms[:, 0], kind="stable")
        self.q, self.norms, self.label = q[self.order], norms[self.order], label[self.order]
        self.exact = exact[self.order]

    def search(self, a: np.ndarray, a_norms: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (anchor, row) whose score may reach least[anchor], with their scores in doubles."""
        size = np.maximum(a_norms[:, 0], 1e-300)
        floor = float((least / size).min())  # a row whose suffix norm is below this is omitted from the rest of the index
        rows = np.arange(np.searchsorted(-self.norms[:, 0], -floor, "right") if floor > 0 else len(self.q))
        acc = np.zeros((len(a), len(rows)))
        done = []
        for k, s in enumerate(range(0, self.q.shape[1], SLICE)):
            if not len(rows):
                break
            if floor > 0:
                listed = self.norms[rows, k] >= floor
                if not listed.all():  # the rows that this list omits keep what they have, if that and the rest can reach t
                    done.append(self._left(rows[~listed], acc[:, ~listed], k, a_norms, least))
                    rows, acc = rows[listed], acc[:, listed]
            acc += a[:, s:s + SLICE] @ self.q[rows, s:s + SLICE].T
            if k + 2 < self.norms.shape[1]:
                alive = (acc + a_norms[:, k + 1, None] * self.norms[rows, k + 1] >= least[:, None]).any(axis=0)
                if alive.sum() < 0.8 * len(rows):  # moving the rest pays only if many rows go
                    rows, acc = rows[alive], acc[:, alive]
        done.append(self._left(rows, acc, self.norms.shape[1] - 1, a_norms, least))
        anchor, row = (np.concatenate(x) for x in zip(*done))
        score = np.einsum("ij,ij->i", a[anchor], self.q[row])
        keep = score >= least[anchor] - SLACK * a_norms[anchor, 0] * self.norms[row, 0]
        return anchor[keep], row[keep], score[keep]

    def _left(self, rows, acc, k, a_norms, least):
        i, j = np.nonzero(acc + a_norms[:, k, None] * self.norms[rows, k] >= least[:, None])
        return i, rows[j]


def exact_scores(a: np.ndarray, anchor: np.ndarray, index: Index, row: np.ndarray, score: np.ndarray) -> np.ndarray:
    """The doubles as whole numbers where they are exact, else sums of Python integers."""
    top = float(abs(a).max(initial=0)) * float(abs(index.q).max(initial=0)) * a.shape[1]
    if top < 2**53:
        return score.astype(np.int64)
    return np.array([int(np.dot(x.astype(object), y.astype(object))) for x, y in zip(a[anchor], index.exact[row])], dtype=np.int64)


def by_score(entry: tuple) -> tuple:
    return -entry[0], entry[1] is None, entry[1] or 0, entry[2]


def best_of(score: np.ndarray, ids: list, want: int) -> list[tuple]:
    """The first `want` + 1 entries (score, vec_id, uid): one of them may be the anchor itself."""
    found = []
    for at in np.argsort(-score, kind="stable"):
        if len(found) > want and score[at] < found[want][0]:
            break
        found += [(int(score[at]), *e) for e in ids[at]]
    return sorted(found, key=by_score)[:want + 1]


def run_blocks(batches: Iterator[pa.RecordBatch], schema: pa.Schema, answer) -> Iterator[pa.RecordBatch]:
    """Rows come by block, its own rows (kind 0) before its anchors (kind 1). answer(index, ids, anchors) gives result columns."""
    block, own, index, ids = None, [], None, []
    for batch in batches:
        blocks, kinds = np.asarray(batch.column("block")), np.asarray(batch.column("kind"))
        mark = blocks * 2 + kinds
        cuts = [0, *(np.nonzero(np.diff(mark))[0] + 1).tolist(), len(mark)]
        for s, e in zip(cuts, cuts[1:]):
            if s == e:
                continue
            if blocks[s] != block:
                block, own, index, ids = blocks[s], [], None, []
            part = batch.slice(s, e - s)
            if kinds[s] == 0:
                own.append((matrix(part.column("q")), np.asarray(part.column("label"))))
                ids += [[(x["vec_id"], x["uid"]) for x in one] for one in part.column("ids").to_pylist()]
                continue
            if own:
                index = Index(np.concatenate([x[0] for x in own]), np.concatenate([x[1] for x in own]))
                ids, own = [ids[i] for i in index.order], []
            if index is None:
                continue
            for at in range(0, part.num_rows, STEP):
                rows = answer(index, ids, part.slice(at, STEP))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def positives_in_block(index: Index, ids: list, part: pa.RecordBatch, want: int, seed: bool) -> list[tuple]:
    """(anchor uid, score, vec_id, uid) of the best rows of the anchors' labels in this block that can be among the first of all.

    With `seed` the thresholds start at the top and go down until this block fills every window or holds no more rows; without, the anchors bring theirs.
    """
    exact = matrix(part.column("q"))
    a, label = exact.astype(np.float64), np.asarray(part.column("label"))
    uid, norms = np.asarray(part.column("uid")), suffix_norms(a)
    out, open_ = [], np.arange(len(a))
    top = index.norms[0, 0] * norms[:, 0]
    least = LOWER * top if seed else np.array([-np.inf if x is None else float(x) for x in part.column("least").to_pylist()])
    while len(open_):
        order = open_[np.argsort(least[open_])]
        i, row, score = index.search(a[order], norms[order], least[order])
        score = exact_scores(a[order], i, index, row, score)
        still, by = [], np.argsort(i, kind="stable")
        ends = np.searchsorted(i[by], np.arange(len(order) + 1))
        for k, at in enumerate(order):
            mine = by[ends[k]:ends[k + 1]]
            mine = mine[index.label[row[mine]] == label[at]]
            found = best_of(score[mine], [ids[r] for r in row[mine]], want)
            found = [f for f in found if f[2] != uid[at]][:want]
            if seed and len(found) < want and least[at] > -np.inf:
                still.append(at)
            else:
                out += [(int(uid[at]), *f) for f in found]
        if not seed:
            break
        open_ = np.array(still, dtype=np.int64)
        # an inner product is at least the negative product of the norms, so far down nothing is left out
        least = np.where(least > 0.1 * top, least * LOWER, -np.inf)
    return out


def negatives_in_block(index: Index, ids: list, part: pa.RecordBatch, want: int, low: int, high: int, seed: bool) -> list[tuple]:
    """(anchor uid, positive score, score, vec_id, uid): the best rows of other labels in each window of the anchors in this block."""
    exact = matrix(part.column("q"))
    a, label = exact.astype(np.float64), np.asarray(part.column("label"))
    uid, norms = np.asarray(part.column("uid")), suffix_norms(a)
    tops, leasts = part.column("tops").to_pylist(), part.column("leasts").to_pylist()
    # whole-number limits of each window: low * p <= high * score <= high * p
    floors = [[-(-low * p // high) for p in x] for x in tops]
    if seed:
        leasts = [[max(f, int(LOWER ** 0.25 * p)) if p > 0 else f for p, f in zip(x, y)] for x, y in zip(tops, floors)]
    else:  # a window without a bound is searched down to its lower end
        leasts = [[f if t is None else max(f, t) for f, t in zip(y, z)] for y, z in zip(floors, leasts)]
    out, open_ = [], np.arange(len(a))
    while len(open_):
        least = np.array([float(min(x)) for x in leasts])
        order = open_[np.argsort(least[open_])]
        i, row, score = index.search(a[order], norms[order], least[order])
        score = exact_scores(a[order], i, index, row, score)
        by = np.argsort(i, kind="stable")
        ends = np.searchsorted(i[by], np.arange(len(order) + 1))
        still = []
        for k, at in enumerate(order):
            mine = by[ends[k]:ends[k + 1]]
            mine = mine[index.label[row[mine]] != label[at]]
            mine = mine[np.argsort(-score[mine], kind="stable")]
            falling, done = -score[mine], True
            rows_out = []
            for p, f, t in zip(tops[at], floors[at], leasts[at]):
                inside = mine[np.searchsorted(falling, -p, "left"):np.searchsorted(falling, -t, "right")]
                found = best_of(score[inside], [ids[r] for r in row[inside]], want)[:want]
                done = done and (len(found) >= want or t <= f)
                rows_out += [(int(uid[at]), p, *e) for e in found]
            if seed and not done:
                still.append(at)
                leasts[at] = [max(f, int(t * LOWER ** 0.25)) if t > 0 else f for f, t in zip(floors[at], leasts[at])]
            else:
                out += rows_out
        if not seed:
            break
        open_ = np.array(still, dtype=np.int64)
    return out


def visit(nodes: DataFrame, anchors: DataFrame, answer, schema: str) -> DataFrame:
    """Bring anchors (block already named) to the blocks of nodes and answer them there."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T.StructType.fromDDL(schema))
    rest = [c for c in anchors.columns if c not in nodes.columns]
    types = dict((f.name, f.dataType) for f in anchors.schema)
    own = nodes.select(F.lit(0).alias("kind"), "block", "q", "label", "ids", *[F.lit(None).cast(types[c]).alias(c) for c in rest])
    come = anchors.select(F.lit(1).alias("kind"), "block", "q", "label", F.lit(None).cast(nodes.schema["ids"].dataType).alias("ids"), *rest)
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = own.union(come).repartition(parts, "block").sortWithinPartitions("block", "kind")
    return dealt.mapInArrow(lambda batches: run_blocks(batches, arrow, answer), schema)


def first(rows: DataFrame, keys: list[str], many: int) -> DataFrame:
    """The first `many` rows of each key by score, then smaller vec_id; Spark limits them per map task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), F.col("uid"))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= many)


def mine_hard_negatives(rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = (80, 100),
                        scale: int = SCALE, column: str = "embedding", every: int = 100, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), for anchors: rows whose vec_id is divisible by `every`.

    rows: vec_id, label and the vector. Rows without a label, without a vector, with null or non-finite entries or with another length than most
    take no part. Scores are inner products of floor(scale * entry). Equal scores go by smaller vec_id; a null vec_id comes last and is no anchor.
    Repeated rows stand for themselves: each is a candidate, and each repeated anchor brings its own rows. Copies of a vector with one label are scored once and
    their smallest ids entered, as only so many can be among the first. An empty table gives no rows; other columns are not read.
    Scores that do not fit a long end the job with an error.
    """
    spark = rows.sparkSession
    good = usable(rows.select("vec_id", "label", column).where("label is not null"), column)
    good = cut_lineage(good.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                                   scaled(column, scale).alias("q"), F.monotonically_increasing_id().alias("uid")))
    keep = max(positives, negatives) + 1
    salt = max(1, int(int(spark.conf.get("spark.sql.shuffle.partitions")) ** 0.5))
    few = good.withColumn("salt", F.spark_partition_id() % salt)
    for keys in (["q", "label", "salt"], ["q", "label"]):  # copies meet in two steps
        w = Window.partitionBy(*keys).orderBy(F.col("vec_id").asc_nulls_last(), "uid")
        few = few.withColumn("n", F.row_number().over(w)).where(F.col("n") <= keep)
    nodes = few.groupBy("q", "label").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "uid"))).alias("ids"))  # at most `keep` each
    nodes = cut_lineage(nodes.select("q", "label", F.transform("ids", lambda x: F.struct(x["vec_id"].alias("vec_id"), x["uid"].alias("uid"))).alias("ids")))
    blocks = max(-(-nodes.count() // block), int(spark.conf.get("spark.sql.shuffle.partitions")))
    nodes = cut_lineage(nodes.withColumn("block", F.pmod(F.xxhash64("q", "label"), F.lit(blocks)).cast("int")))
    anchors = good.where(F.col("vec_id") % every == 0)
    one = F.pmod(F.xxhash64("uid", F.lit(3)), F.lit(blocks)).cast("int")
    all_blocks = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    none = F.lit(None).cast("long")

    found = "anchor long, score long, vec_id long, uid long"
    sown = visit(nodes, anchors.select("q", "label", "uid", none.alias("least"), one.alias("block")),
                 lambda *x: positives_in_block(*x, positives, True), found)
    bound = sown.groupBy("anchor").agg(F.min("score").alias("low"), F.count("*").alias("n")).where(F.col("n") >= positives)
    asked = cut_lineage(anchors.join(bound.select(F.col("anchor").alias("uid"), F.col("low").alias("least")), "uid", "left"))
    near = visit(nodes, asked.select("q", "label", "uid", "least", all_blocks.alias("block")),
                 lambda *x: positives_in_block(*x, positives, False), found)
    pairs = cut_lineage(first(near, ["anchor"], positives).select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))

    low, high = window
    tops = pairs.groupBy("anchor").agg(F.sort_array(F.collect_set("positive_score")).alias("tops"))  # at most `positives` numbers
    asked = cut_lineage(anchors.join(tops.withColumnRenamed("anchor", "uid"), "uid"))
    found = "anchor long, positive_score long, score long, vec_id long, uid long"
    sown = visit(nodes, asked.select("q", "label", "uid", "tops", F.lit(None).cast("array<long>").alias("leasts"), one.alias("block")),
                 lambda *x: negatives_in_block(*x, negatives, low, high, True), found)
    full = sown.groupBy("anchor", "positive_score").agg(F.min("score").alias("low"), F.count("*").alias("n")).where(F.col("n") >= negatives)
    limits = full.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("positive_score", "low"))).alias("limits"))
    # a window that one block fills needs nothing below what it found there
    asked = asked.join(limits.withColumnRenamed("anchor", "uid"), "uid", "left").withColumn(
        "leasts", F.transform("tops", lambda p: F.try_element_at("limits", p)))
    near = visit(nodes, asked.select("q", "label", "uid", "tops", "leasts", all_blocks.alias("block")),
                 lambda *x: negatives_in_block(*x, negatives, low, high, False), found)
    best = first(near, ["anchor", "positive_score"], negatives).select(
        "anchor", "positive_score", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    ids = anchors.select(F.col("uid").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return pairs.join(best, ["anchor", "positive_score"]).join(ids, "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor; where vec_id is divisible by 7 the label is the next one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label")))


#: The same rows from scores of all anchors against all rows.
SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL),
v AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS k, CAST(unnest(embedding) AS DOUBLE) AS x FROM e),
ok AS (SELECT vec_id FROM v GROUP BY vec_id HAVING bool_and(x IS NOT NULL AND isfinite(x))),
q AS (SELECT vec_id, label, k, CAST(floor(256 * x) AS BIGINT) AS x FROM v JOIN ok USING (vec_id)),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id AS other_id, b.label AS label, CAST(sum(a.x * b.x) AS BIGINT) AS score
      FROM q a JOIN q b ON a.k = b.k AND a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id GROUP BY ALL),
p AS (SELECT anchor_id, own, other_id AS positive_id, score AS positive_score FROM s WHERE label = own
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> p.own AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER w <= 5
"""

"""SimHash near-duplicates by exact comparison of tiles.

Distinct fingerprints are dealt into tiles by the population counts of their four 16-bit quarters. Two
fingerprints within the radius differ by at most the radius in the sum of those counts' differences, so a tile meets only the tiles
whose counts lie that close; all other tile pairs are skipped. Inside a tile pair numpy compares every
fingerprint with every other by exclusive-or and bit count. A tile pair gives back a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pollwarden.llm.common import FOLD_BYTES, documents, map_text, whole_text
from pollwarden.llm.components import components
from pollwarden.session import cut_lineage

RADIUS = 2
#: Fingerprints of one side of a tile pair: 8,192 x 8,192 comparisons need blocks of a few MB.
TILE = 8192
SEED = 42


def fingerprint(text: str, shingle: int = 3) -> int:
    """64 majority bits of the hashes of a text's word shingles, as a signed long; no words: 0."""
    import xxhash

    words = text.encode().translate(FOLD_BYTES).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    if len(words) <= shingle:
        starts, stops = [0], [len(line)]
    else:
        starts = [0, *(ends[: len(words) - shingle] + 1).tolist()]
        stops = ends[shingle - 1:].tolist()
    h = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    step = 65_536  # so many hashes are held at a time
    for at in range(0, len(starts), step):
        got = np.fromiter((h(line[a:b], SEED) for a, b in zip(starts[at:at + step], stops[at:at + step])), np.uint64)
        ones += np.unpackbits(got.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(starts))
    return int(bits.view(">i8")[0])


def text_hash() -> Column:
    return F.xxhash64(whole_text())


def with_fingerprints(docs: DataFrame, columns: list[str]) -> DataFrame:
    return map_text(docs, columns, "text", "fp long", lambda texts: [(fingerprint(t),) for t in texts])


def quarters(fp: str):
    """Population counts of the four 16-bit quarters, packed in base 32."""
    code = F.lit(0)
    for k in range(4):
        code = code * 32 + F.bit_count(F.shiftrightunsigned(F.col(fp), 48 - 16 * k).bitwiseAND(F.lit(0xFFFF)))
    return code.cast("int")


def neighbours(radius: int) -> list[int]:
    """Differences of packed counts of tiles that can hold a link, one of each opposite pair, the tile itself included."""
    found = []
    for d in product(range(-radius, radius + 1), repeat=4):
        if sum(map(abs, d)) <= radius and d >= (0, 0, 0, 0):
            found.append(((d[0] * 32 + d[1]) * 32 + d[2]) * 32 + d[3])
    return found


def forest(home: np.ndarray, other: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of a spanning forest over what `home` and `other` hold, compared block by block."""
    nodes, back = np.unique(np.concatenate([home, other]), return_inverse=True)
    h, o = back[: len(home)], back[len(home):]
    label = np.arange(len(nodes))
    rows = max(1, 1_000_000 // max(1, len(other)))
    for at in range(0, len(home), rows):
        near = np.bitwise_count(home[at:at + rows, None] ^ other[None, :]) <= radius
        i, j = np.nonzero(near)
        a, b = h[at + i], o[j]
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
        while len(a):  # labels go down along the links until both ends agree
            low = np.minimum(label[a], label[b])
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
            keep = label[a] != label[b]
            a, b = a[keep], b[keep]
    part = np.nonzero(label != np.arange(len(nodes)))[0]
    values = nodes.view(np.int64)
    return [(int(values[x]), int(values[label[x]])) for x in part]


def compare_tiles(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by tile pair; one tile pair is held at a time."""
    key, home, other = None, [], []

    def done():
        if home and other:
            got = forest(np.concatenate(home).view(np.uint64), np.concatenate(other).view(np.uint64), radius)
            if got:
                a, b = zip(*got)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        keys = np.asarray(batch.column(0))
        kinds, fps = np.asarray(batch.column(1)), np.asarray(batch.column(2))
        cuts = [0, *(np.nonzero(np.diff(keys))[0] + 1).tolist(), len(keys)]
        for s, e in zip(cuts, cuts[1:]):
            if s == e:
                continue
            if keys[s] != key:
                yield from done()
                key, home, other = keys[s], [], []
            own = kinds[s:e] == 0
            home.append(fps[s:e][own])
            other.append(fps[s:e][~own])
    yield from done()


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) that span every component of fingerprints within the radius; `distinct` holds each fingerprint once."""
    spark = distinct.sparkSession
    coded = distinct.select("fp", quarters("fp").alias("home"))
    counts = dict(coded.groupBy("home").count().collect())  # at most 17^4 quarter counts, whatever the input
    near = neighbours(radius)
    meets = {c: sum(counts.get(c - d, 0) for d in near) for c in counts}
    wide = [(c, -(-counts[c] // tile), -(-meets[c] // tile)) for c in counts if counts[c] > tile or meets[c] > tile]
    shape = spark.createDataFrame(wide, "cell int, na int, nb int")
    own = coded.select(F.lit(0).alias("kind"), "fp", F.col("home").alias("cell"))
    out = coded.select(F.lit(1).alias("kind"), "fp", F.explode(F.array(*[F.col("home") + d for d in near])).alias("cell"))
    rows = own.union(out)
    if wide:
        salt = F.xxhash64("fp", F.lit(7))
        rows = rows.join(F.broadcast(shape), "cell", "left").na.fill(1, ["na", "nb"])  # at most 17^4 rows
        mine = F.when(F.col("kind") == 0, F.pmod(salt, "na")).otherwise(F.pmod(salt, "nb"))
        rows = rows.select("kind", "fp", "cell", "nb", mine.alias("mine"), F.explode(
            F.sequence(F.lit(0), F.when(F.col("kind") == 0, F.col("nb")).otherwise(F.col("na")) - 1)).alias("all"))
        pair = F.when(F.col("kind") == 0, F.col("mine") * F.col("nb") + F.col("all")).otherwise(F.col("all") * F.col("nb") + F.col("mine"))
        rows = rows.select(F.xxhash64("cell", pair.cast("long")).alias("key"), "kind", "fp")
    else:
        rows = rows.select(F.xxhash64("cell", F.lit(0).cast("long")).alias("key"), "kind", "fp")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(lambda batches: compare_tiles(batches, radius), "a long, b long")


def near_groups(docs: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(doc_id, t, fp, label, component_id) for every document; component_id is the smallest doc_id that links reach.

    t is a hash of the text, label the group's smallest fingerprint. Null and empty texts have fingerprint zero and are linked like any other. Repeated rows share their group; a null doc_id is
    never a component_id unless its group has no other. An empty table gives no rows.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("t"), "text")
    rows = cut_lineage(with_fingerprints(keyed, ["doc_id", "t"]))
    distinct = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("low")))
    label = components(links(distinct.select("fp"), radius, tile))
    member = distinct.join(label, distinct["fp"] == label["node"], "left").select(
        "fp", "low", F.coalesce("label", "fp").alias("label"))
    lowest = member.groupBy("label").agg(F.min("low").alias("component_id"))
    groups = member.join(lowest, "label").select("fp", "label", "component_id")
    return rows.join(groups, "fp").select("doc_id", "t", "fp", "label", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    return near_groups(documents(spark, sf_dir)).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS, groups: DataFrame | None = None) -> DataFrame:
    """docs with one row of every near-duplicate group, with all its columns; `groups` (doc_id, t, label) replaces near_groups.

    The smallest doc_id stays, one that is null only if its group has no other; among rows that share this id the smallest text hash decides, and
    of rows that repeat both one stays.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("__id"), F.col("t").alias("__t")))
    groups = near_groups(docs, radius) if groups is None else groups
    stay = groups.groupBy("label").agg(first.alias("s")).select("s.__id", "s.__t")
    own = docs.withColumn("__own", text_hash())
    kept = own.join(stay, own["doc_id"].eqNullSafe(stay["__id"]) & (own["__own"] == stay["__t"]), "left_semi")
    # Spark limits the rows of one id and text per map task before the shuffle
    repeats = F.row_number().over(Window.partitionBy("doc_id", "__own").orderBy("__own"))
    return kept.withColumn("__n", repeats).where("__n = 1").select(*docs.columns)

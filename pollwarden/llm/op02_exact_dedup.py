"""Exact deduplication by a tree merge of sorted digest runs, in DataFrame operations only.

Every input partition is one run: its rows' digests, sorted. Runs meet in rounds: in each round `fan_in` neighbouring
runs are merged into one, digest by digest, and of equal digests the verified identifier that stays is retained.
Because a run holds a digest once, a merge never sees more than `fan_in` rows of one digest, however many
copies a text has. Decisions then go down the same tree, so that no join meets all copies of a text in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pollwarden.llm.common import documents, folded
from pollwarden.session import cut_lineage

#: Digest, and what verifies it: length in bytes and an independent 64-bit hash of the same text.
SAME = ["digest", "n_bytes", "check"]


def digest_runs(docs: DataFrame, text: Column) -> DataFrame:
    """One sorted run of digests for each partition, kept as a table: (run, row, doc_id, digest, n_bytes, check)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t")).select(
        F.spark_partition_id().alias("run"), F.monotonically_increasing_id().alias("row"), "doc_id",
        F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("digest"), F.octet_length("t").alias("n_bytes"),
        F.xxhash64("t").alias("check"))
    return cut_lineage(rows.sortWithinPartitions("digest"))


def merge(level: DataFrame, group: Column, keep: str) -> DataFrame:
    """One round: neighbouring runs become one; equal digests retain one identifier and the sum of their sizes."""
    best = F.max("best") if keep == "largest" else F.min("best")
    return level.groupBy(group.alias("run"), *SAME).agg(best.alias("best"), F.sum("size").alias("size"))


def tree_dedup(docs: DataFrame, keep: str = "largest", fan_in: int = 16, text: Column | None = None) -> DataFrame:
    """(row, doc_id, digest, keep_id, keep_row, group_size) for every row of docs.

    keep: "largest" or "smallest" doc_id stays; of rows that repeat an id and a text, the first row stays. Null text
    counts as empty. A null doc_id ranks below every other for "largest" and for "smallest" is
    kept only if no row of the group has an id. An empty table gives no rows. Columns other than doc_id and text are not read.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    if fan_in < 2:
        raise ValueError("fan_in is at least 2")
    rows = digest_runs(docs, folded() if text is None else text)
    known = F.col("doc_id").isNotNull()
    rank = F.struct(known.alias("known"), "doc_id", (-F.col("row")).alias("row")) if keep == "largest" else \
        F.struct((~known).alias("known"), "doc_id", F.col("row").alias("row"))
    levels = [merge(rows.select("run", *SAME, rank.alias("best"), F.lit(1).cast("long").alias("size")), F.col("run"), keep)]
    runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    while runs > 1:
        runs = -(-runs // fan_in)
        levels.append(merge(levels[-1], F.floor(F.col("run") / fan_in).cast("int"), keep))
    decided = levels.pop()
    for level in reversed(levels):
        parent = decided.select(F.col("run").alias("up"), *SAME, "best", "size")
        child = level.select("run", *SAME, F.floor(F.col("run") / fan_in).cast("int").alias("up"))
        decided = child.join(parent, ["up", *SAME]).drop("up")
    return rows.join(decided, ["run", *SAME]).select(
        "row", "doc_id", "digest", F.col("best.doc_id").alias("keep_id"), F.abs("best.row").alias("keep_row"),
        F.col("size").alias("group_size"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal folded texts the row with the largest doc_id stays; one row for every document."""
    return tree_dedup(documents(spark, sf_dir)).select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def first_of_each(docs: DataFrame, fan_in: int = 16) -> DataFrame:
    """docs without the copies: the row that stays of each group of equal texts, with all its columns."""
    found = tree_dedup(docs, fan_in=fan_in)
    stay = found.where(F.col("row") == F.col("keep_row")).select(
        F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"))
    own = docs.withColumn("__digest", F.unhex(F.sha2(folded().cast("binary"), 256)))
    kept = own.join(stay, F.col("doc_id").eqNullSafe(F.col("__id")) & (own["__digest"] == stay["__digest"]), "left_semi")
    # rows that repeat both id and text are told apart here, on the partitioning that the join has left
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy("__digest").orderBy(F.col("doc_id").desc_nulls_last()))
    return kept.withColumn("__n", first).where("__n = 1").select(*docs.columns)


SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
           FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

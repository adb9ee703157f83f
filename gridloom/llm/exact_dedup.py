"""Exact deduplication with an extendible-hash index kept as shared files.

Every document has a 64-bit key, the hash of its text with A-Z in lower case.
1. A directory over the leading bits of the keys is doubled until each bucket holds at most `capacity` distinct keys;
   its size is bounded by MAX_DEPTH whatever the input. A bucket is a range of keys.
2. The index is a table in the shared folder, dealt out by bucket and sorted by key: the entries of a bucket are in the
   files of its owner. Keys with a large share of all rows are salted over several files.
3. Rows that share a key go with their texts to the owner task of their bucket, which resolves the chain of each key by
   comparing bytes, so two texts whose keys collide stay apart. Rows of keys with a large share are counted before.
4. Entries join the chains of their bucket. DataFrame operations only.

Null and empty texts are equal. Repeated rows are copies of each other, also where they have the same id; then each
of these rows says kept. A null id is smaller than any other. Empty input gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, ascii_lower, documents, materialize, skew_safe_left_join, small

#: Bound of the directory, in leading bits of the key.
MAX_DEPTH = 14
#: Distinct keys of a bucket; more where the directory is as deep as it gets.
CAPACITY = 512


def build_directory(counts: dict[int, int], depth: int, capacity: int) -> list[tuple[int, int, int]]:
    """(prefix at full depth, bucket, local depth) for each slot of the directory.

    Starts with one bucket; a bucket with over `capacity` keys is split by its next bit, which doubles the directory
    where the bucket was already as deep as it. counts: distinct keys by their leading `depth` bits.
    """
    sums = [[0] * (1 << d) for d in range(depth + 1)]
    for prefix, n in counts.items():
        for d in range(depth + 1):
            sums[d][prefix >> (depth - d)] += n
    full, open_, done = 0, [(0, 0)], []
    while open_:
        d, prefix = open_.pop()
        if sums[d][prefix] > capacity and d < depth:
            full = max(full, d + 1)
            open_ += [(d + 1, 2 * prefix), (d + 1, 2 * prefix + 1)]
        else:
            done.append((d, prefix))
    slots = []
    for bucket, (d, prefix) in enumerate(sorted(done, key=lambda x: x[1] << (full - x[0]))):
        first = prefix << (full - d)
        slots += [(slot, bucket, d) for slot in range(first, first + (1 << (full - d)))]
    return slots


def leading_bits(key, depth: int):
    return F.shiftrightunsigned(key, 64 - depth).cast("int") if depth else F.lit(0)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, key_bits: int = 64) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id (largest id among equal texts), group_size, kept, text_sha256.

    key_bits < 64 shortens the keys, for tests of collisions.
    """
    norm = ascii_lower(F.col(text_col))
    key = F.xxhash64("norm")
    key = F.shiftleft(F.shiftrightunsigned(key, 64 - key_bits), 64 - key_bits) if key_bits < 64 else key
    keyed = docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm")).withColumn("key", key)
    rows = materialize(keyed.select("doc_id", "key", F.sha2("norm", 256).alias("text_sha256")), "exact-rows")
    slots = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "exact-slots")
    total = rows.count()
    directory, depth = _directory(slots, capacity)
    bar = max(1000, total // HOT_SHARE)
    hot = F.broadcast(slots.where(F.col("n") > bar).select("key", F.ceil(F.col("n") / bar).cast("int").alias("shares")))  # at most HOT_SHARE keys

    def placed(df: DataFrame) -> DataFrame:
        """df with the bucket of each row, and shares where its key is hot."""
        return df.withColumn("slot", leading_bits(F.col("key"), depth)).join(F.broadcast(directory), "slot").drop("slot").join(hot, "key", "left")

    salt = F.coalesce(F.pmod(F.xxhash64("doc_id"), "shares"), F.lit(0)).cast("int")
    entries = placed(rows).withColumn("salt", salt).repartition(F.col("bucket"), F.col("salt")).sortWithinPartitions("bucket", "key")
    entries = materialize(entries.select("bucket", "key", "doc_id", "text_sha256"), "exact-index")

    shared = small(materialize(slots.where("n > 1").select("key"), "exact-shared"))
    rows = placed(keyed.join(shared, "key", "left_semi"))
    owner = ["bucket", "key", "norm"]
    single = rows.where("shares IS NULL").select(*owner, F.col("doc_id").alias("most"), F.lit(1).cast("bigint").alias("n"))
    counted = rows.where("shares IS NOT NULL").groupBy(*owner).agg(F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("n"))
    # The owner of a bucket has all of its rows, so it groups them without another exchange.
    chains = single.union(counted).repartition(F.col("bucket")).groupBy(*owner).agg(F.max("most").alias("keep_id"), F.sum("n").alias("group_size"))
    chains = materialize(chains.select("bucket", "key", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size"), "exact-chains")

    found = skew_safe_left_join(entries, chains, ["bucket", "key", "text_sha256"], "group_size", total)
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256")


def _directory(slots: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """slot, bucket for each slot, and the leading bits that make a slot. slots: the distinct keys."""
    counts = {r[0]: r[1] for r in slots.groupBy(leading_bits(F.col("key"), MAX_DEPTH).alias("p")).count().collect()}
    layout = build_directory(counts, MAX_DEPTH, max(capacity, 2 * sum(counts.values()) >> MAX_DEPTH))
    return slots.sparkSession.createDataFrame([(s, b) for s, b, _ in layout], "slot int, bucket int"), len(layout).bit_length() - 1


def query(spark, sf_dir):
    return exact_dedup(documents(spark, sf_dir))


SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g USING (t)
"""

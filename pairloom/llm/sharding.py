"""Sharding by balanced label propagation.

Documents are linked if their texts are equal (a hub per text stands for the links, so a group of
any size has as many links as members). Every document starts in the shard of its id's hash. In
each round a text's hub counts its members by shard and prefers the shard with most of them that
has room; members move there as far as the shard's quota (an equal share of all rows) goes. Whole
groups move or stay, by the group's hash; only groups above the quota are divided row by row.
Documents without links have no wish and fill what is left.

The law is `rows`: at the end the counts of two shards differ by one at most. Rows are ranked within
their shard, linked ones first; those beyond the shard's share go to the shards below theirs. Ranks
come from counts per bucket and a row number within each bucket, so no task sees a whole shard,
and give the slots too (gapless from 0).

A null text is a text of its own with size 1 and crc32 0. A null doc_id is a value like others;
repeated rows are linked and each gets a slot. Extra columns are not read. An empty table gives no
rows. The same rows get the same shards at any partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Store, table

SHARDS = 8
ROUNDS = 3
#: Rows per ranking bucket, about; groups above BIG are dealt to buckets row by row.
BUCKET, BIG = 10_000, 1000


def _pick(numbers, at):
    return F.element_at(F.array(*[F.lit(x) for x in numbers]), at + 1)


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    store = Store(spark)
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.xxhash64(text, text.isNull()).alias("g"),
    )
    rows = store.write(rows.withColumn("h", F.xxhash64("doc_id", F.lit(5))))
    key = ["g", "text_crc32", "size"]
    groups = store.write(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("m")).filter("m > 1"))
    n = rows.count()
    quota = -(-n // shards)
    state = rows.join(groups, key, "left").withColumn("m", F.coalesce("m", F.lit(1)).cast("long")).withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))
    singles, linked = store.write(state.filter("m = 1")), store.write(state.filter("m > 1"))
    room = [quota] * shards
    for turn in range(rounds):
        tally = store.write(linked.groupBy(*key, "m", "shard").agg(F.count(F.lit(1)).alias("c")))
        free = _pick(room, F.col("shard"))
        merit = F.col("c") * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (free + F.col("c")) / F.col("m")))
        wish = tally.groupBy(*key).agg(F.max(F.struct(merit.alias("merit"), F.xxhash64("g", "shard").alias("tie"), "shard")).alias("best")).select(*key, F.col("best.shard").alias("wish"))
        wish = store.write(wish)
        met = tally.join(wish, key)
        stay, want = [0] * shards, [0] * shards
        for a, stays, c in met.groupBy("wish", (F.col("shard") == F.col("wish")).alias("stays")).agg(F.sum("c")).collect():
            (stay if stays else want)[a] += c
        left = met.filter("shard != wish").groupBy("shard").agg(F.sum("c").alias("c")).collect()
        if not left:
            break
        open_ = [max(0, quota - s) for s in stay]
        share = [min(1.0, o / w) if w else 1.0 for o, w in zip(open_, want, strict=True)]
        whole = F.pmod(F.xxhash64("g", F.lit(turn)), F.lit(1 << 30)) / float(1 << 30)
        single = F.pmod(F.xxhash64("h", F.lit(turn)), F.lit(1 << 30)) / float(1 << 30)
        goes = F.when(F.col("m") > quota, single).otherwise(whole) < _pick(share, F.col("wish"))
        moved = linked.join(wish, key).withColumn("shard", F.when(goes, F.col("wish")).otherwise(F.col("shard"))).drop("wish")
        now = store.write(moved.select(*linked.columns))
        store.drop(linked, tally, wish)
        linked = now
        held = {s: c for s, c in linked.groupBy("shard").count().collect()}
        room = [max(0, quota - held.get(s, 0)) for s in range(shards)]
    return _even(store, linked.unionByName(singles), n, shards).select("doc_id", "size", "text_crc32", "shard", "slot")


def _even(store: Store, state: DataFrame, n: int, shards: int) -> DataFrame:
    """Ranks within shards, and moves of the last ranks, so that counts differ by one at most."""
    buckets = max(1, n // (BUCKET * shards))
    by = F.when((F.col("m") == 1) | (F.col("m") > BIG), F.col("h")).otherwise(F.col("g"))
    state = state.withColumn("bucket", (F.when(F.col("m") == 1, buckets).otherwise(0) + F.pmod(F.xxhash64(by), F.lit(buckets))).cast("int"))
    counts = state.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("c"))
    before = F.coalesce(F.sum("c").over(W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = store.write(counts.withColumn("before", before))
    held = {s: c for s, c in counts.groupBy("shard").agg(F.sum("c")).collect()}
    have = [int(held.get(s, 0)) for s in range(shards)]
    goal = [n // shards + (s < n % shards) for s in range(shards)]
    over, passed = [], 0
    for h, g in zip(have, goal, strict=True):
        over.append(passed)
        passed += max(0, h - g)
    rank = F.col("before") + F.row_number().over(W.partitionBy("shard", "bucket").orderBy("g", "text_crc32", "size", "h", "doc_id")) - 1
    ranked = state.join(counts.select("shard", "bucket", "before"), ["shard", "bucket"]).withColumn("rank", rank)
    index = _pick(over, F.col("shard")) + F.col("rank") - _pick(goal, F.col("shard"))
    to, slot, passed = F.lit(None).cast("int"), F.lit(None).cast("long"), 0
    for s in reversed(range(shards)):  # the gaps in order; the first that ends behind the index takes the row
        ends = sum(max(0, g - h) for g, h in zip(goal[: s + 1], have[: s + 1], strict=True))
        starts = ends - max(0, goal[s] - have[s])
        to = F.when(F.col("index") < ends, F.lit(s)).otherwise(to)
        slot = F.when(F.col("index") < ends, F.col("index") - starts + have[s]).otherwise(slot)
    ranked = ranked.withColumn("moves", F.col("rank") >= _pick(goal, F.col("shard"))).withColumn("index", index)
    return ranked.select("doc_id", "size", "text_crc32", F.when(F.col("moves"), to).otherwise(F.col("shard")).alias("shard"), F.when(F.col("moves"), slot).otherwise(F.col("rank")).cast("long").alias("slot"))


def assign(docs: DataFrame) -> DataFrame:
    out = shard(docs)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op5_sharding": op5_sharding}
ORACLES: dict[str, str] = {}

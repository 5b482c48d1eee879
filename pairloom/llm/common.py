"""What the operators share: the shared folder, written tables and the names of working columns."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a folder of this machine if the master is local, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="pairloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Store:
    """Tables written for one call of an operator; drop() removes those that are no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark, self.at = spark, f"{shared_dir(spark)}/pairloom-{uuid.uuid4().hex}"
        self.n = 0

    def write(self, df: DataFrame) -> DataFrame:
        """Write and reread: cuts the lineage, and gives the planner the true size."""
        self.n += 1
        path = f"{self.at}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._pairloom_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._pairloom_path)
            path.getFileSystem(conf).delete(path, True)

    def release(self) -> None:
        """Let Spark's cleaner remove the shuffle files of finished steps now."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


ROWS = 2000


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of ROWS rows at most from now on in this session: whole texts go to workers, and a batch is held whole."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ROWS:
        spark.conf.set(key, str(ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def by_key(batches, keys: list[str]):
    """(key, table) for each run of equal keys, from batches sorted by them. Holds one group and one batch."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held, now = [], None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        differs = None
        for k in keys:
            col = pc.fill_null(t[k].combine_chunks(), -1)
            d = pc.not_equal(col[1:], col[:-1])
            differs = d if differs is None else pc.or_(differs, d)
        cuts = [0, *[int(i) + 1 for i in pc.indices_nonzero(differs).to_pylist()], t.num_rows] if t.num_rows > 1 else [0, t.num_rows]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            part = t.slice(a, z - a)
            key = tuple(part[k][0].as_py() for k in keys)
            if held and key != now:
                yield now, pa.concat_tables(held)
                held = []
            now = key
            held.append(part)
    if held:
        yield now, pa.concat_tables(held)


def components(store: Store, edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node of edges (a, b: long).

    Alternating large-star and small-star joins; every round is written to the shared folder. Ends
    when a round changes nothing, after about the logarithm of the longest path.
    """
    now = store.write(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        large = store.write(large.unionByName(least.filter("a <> m").select("a", F.col("m").alias("b"))).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        new = store.write(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        mark = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        store.drop(large, now)
        now = new
        if mark == last or not mark[0]:
            break
        last = mark
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

"""Readers and sinks. Every path is read and written by Spark (or Hadoop's file system), so any store will do."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import file_stem, is_none_label


def counts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """cell, feature, count, source of one or more Parquet tables stacked; two files of one name are refused."""
    names = [p.rstrip("/").rsplit("/", 1)[-1] for p in paths]
    if len(set(names)) < len(names):
        raise ValueError("two data files have one name")
    out = None
    for p in paths:
        one = spark.read.parquet(p).select("cell", "feature", F.col("count").cast("double").alias("count"), file_stem(F.lit(p)).alias("source"))
        one = one if len(paths) == 1 else one.withColumn("cell", F.concat_ws("@", F.col("cell").cast("string"), "source"))
        out = one if out is None else out.unionByName(one)
    return out


def shared_features(counts_: DataFrame) -> DataFrame:
    """Counts of the features that every source has."""
    n = counts_.select("source").distinct().count()
    keep = counts_.groupBy("feature").agg(F.countDistinct("source").alias("n")).filter(F.col("n") == n)
    return counts_.join(keep.select("feature"), "feature", "left_semi")


def coverage(counts_: DataFrame) -> DataFrame:
    """source, feature: what each source measured."""
    return counts_.select("source", "feature").distinct()


def measured_mass(cells: DataFrame, cover: DataFrame) -> DataFrame:
    """feature, mass: the cells whose source measured the feature. cells: cell, source."""
    n = cells.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return cover.join(n, "source").groupBy("feature").agg(F.sum("n").alias("mass"))


def _delimited(spark: SparkSession, path: str) -> DataFrame:
    """A text file's lines as arrays; tab, comma or blanks by what the line holds. Empty lines are left out."""
    line = F.trim("value")
    cut = F.when(line.contains("\t"), F.split(line, "\t")).when(line.contains(","), F.split(line, ",")).otherwise(F.split(line, r"\s+"))
    return spark.read.text(path).filter(line != "").select(F.transform(cut, lambda x: F.trim(x)).alias("f"))


def coordinates(spark: SparkSession, path: str, columns: list[str] | list[int], cell: str | int = 0) -> DataFrame:
    """cell, x, y. Parquet by column names; text by header names or, for numbers, by position. Fewer than two columns are an error."""
    if len(columns) < 2:
        raise ValueError("coordinates need two columns")
    if path.rstrip("/").endswith(".parquet"):
        t = spark.read.parquet(path)
        names = [t.columns[c] if isinstance(c, int) else c for c in (cell, *columns[:2])]
        return t.select(F.col(names[0]).cast("string").alias("cell"), *[F.col(n).cast("double").alias(k) for n, k in zip(names[1:], "xy", strict=True)])
    rows = _delimited(spark, path)
    head = rows.first()
    if head is None:
        return spark.createDataFrame([], "cell string, x double, y double")
    names = list(head["f"])
    at = [names.index(c) if isinstance(c, str) else c for c in (cell, *columns[:2])]
    out = rows.select(F.get("f", F.lit(at[0])).alias("cell"), *[F.expr(f"try_cast(get(f, {a}) AS double)").alias(k) for a, k in zip(at[1:], "xy", strict=True)])
    return out.filter("x IS NOT NULL AND y IS NOT NULL")  # a header is no number


def batches(spark: SparkSession, path: str | None, cells: DataFrame) -> DataFrame:
    """cell, batch: of a two-column file, or the cell's source where there is none. A cell without a batch is an error."""
    if path is None:
        return cells.select("cell", F.col("source").alias("batch"))
    rows = _delimited(spark, path).filter(F.size("f") >= 2).select(F.get("f", F.lit(0)).alias("cell"), F.get("f", F.lit(1)).alias("batch"))
    met = cells.select("cell").join(rows, "cell", "left")
    if not met.filter("batch IS NULL").isEmpty():
        raise ValueError("cells without a batch label")
    return met


def pairs(spark: SparkSession, path: str) -> DataFrame:
    """ligand, receptor of a two-column list; a header of known names and short lines are skipped."""
    rows = _delimited(spark, path).filter(F.size("f") >= 2).select(F.get("f", F.lit(0)).alias("ligand"), F.get("f", F.lit(1)).alias("receptor"))
    head = F.lower("ligand").isin("ligand", "source") & F.lower("receptor").isin("receptor", "target")
    return rows.filter(~head & (F.col("ligand") != "") & (F.col("receptor") != "")).distinct()


def programs(spark: SparkSession, path: str) -> DataFrame:
    """receptor, target, weight of a table (receptor, target[, weight]) or a GMT file (name, note, targets...)."""
    rows = _delimited(spark, path)
    if path.endswith(".gmt"):
        return rows.filter(F.size("f") >= 3).select(F.get("f", F.lit(0)).alias("receptor"), F.explode(F.slice("f", 3, 1_000_000)).alias("target"), F.lit(1.0).alias("weight")).filter("target <> ''")
    rows = rows.filter(F.size("f") >= 2).filter(F.lower(F.get("f", F.lit(1))) != "target")
    return rows.select(F.get("f", F.lit(0)).alias("receptor"), F.get("f", F.lit(1)).alias("target"), F.coalesce(F.expr("try_cast(get(f, 2) AS double)"), F.lit(1.0)).alias("weight"))


def labels(spark: SparkSession, path: str) -> DataFrame:
    """cell, label; none-labels are null. A cell that is named twice is an error."""
    if path.rstrip("/").endswith(".parquet"):
        t = spark.read.parquet(path)
        t = t.select(F.col(t.columns[0]).cast("string").alias("cell"), F.col(t.columns[1]).cast("string").alias("label"))
    else:
        t = _delimited(spark, path).filter(F.size("f") >= 2).select(F.get("f", F.lit(0)).alias("cell"), F.get("f", F.lit(1)).alias("label")).filter("lower(label) <> 'label'")
    if not t.groupBy("cell").count().filter("count > 1").isEmpty():
        raise ValueError("a cell is labelled twice")
    return t.withColumn("label", F.when(~is_none_label(F.col("label")), F.col("label")))


def keyed_columns(spark: SparkSession, path: str, key: str, columns: list[str]) -> DataFrame:
    """The key and the named numeric columns alone."""
    return spark.read.parquet(path).select(F.col(key).cast("string").alias(key), *[F.col(c).cast("double").alias(c) for c in columns])


def labelled_matrix(spark: SparkSession, path: str, key: str) -> DataFrame:
    """row, column, value: a wide table melted."""
    t = spark.read.parquet(path)
    wide = [c for c in t.columns if c != key]
    return t.select(F.col(key).cast("string").alias("row"), *[F.col(c).cast("double").alias(c) for c in wide]).unpivot("row", wide, "column", "value")


def memberships(spark: SparkSession, path: str) -> DataFrame:
    """cell, community, share of a wide table with columns C0, C1, ...; other columns but the known ones are an error."""
    t = spark.read.parquet(path)
    known = {"cell", "cluster", "entropy", "x", "y"}
    wide = [c for c in t.columns if c[:1] == "C" and c[1:].isdigit()]
    if odd := [c for c in t.columns if c not in known and c not in wide]:
        raise ValueError(f"unknown columns {odd}")
    flat = t.unpivot("cell", wide, "c", "share")
    return flat.select("cell", F.substring("c", 2, 9).cast("int").alias("community"), "share")


#: Names that stand for all batches and for pooled ones in results.
RESERVED = ("all", "pooled")


def _refuse_reserved(batches: DataFrame) -> None:
    either = F.col("left_batch").isin(*RESERVED) | F.col("right_batch").isin(*RESERVED)
    if not batches.filter(either).isEmpty():
        raise ValueError(f"a batch has one of the reserved names {RESERVED}")


def contacts(spark: SparkSession, path: str, community: bool = True) -> DataFrame:
    """left_cell, right_cell, community, spatial, left_batch, right_batch, batch of a table of contacts.

    A negative community reads as 0, and so does every one of a table that is read without them. Batches of reserved names are refused. A contact is spatial if
    its edge_kind is 0 or the table has none. batch is the ends' own one where they share it, else null; null where the table
    has no left_batch and right_batch. See with_batches() for tables that keep these apart.
    """
    t = spark.read.parquet(path)
    has = set(t.columns)
    named = [F.col(c).cast("string").alias(c) for c in ("left_cell", "right_cell")]
    kind = (F.col("edge_kind") == 0) if "edge_kind" in has else F.lit(True)
    group = F.greatest(F.col("community").cast("long"), F.lit(0)) if community else F.lit(0).cast("long")
    sides = [F.col(c).cast("string") if {"left_batch", "right_batch"} <= has else F.lit(None).cast("string") for c in ("left_batch", "right_batch")]
    out = t.select(*named, group.alias("community"), kind.alias("spatial"), sides[0].alias("left_batch"), sides[1].alias("right_batch"))
    _refuse_reserved(out)
    return out.withColumn("batch", F.when(F.col("left_batch") == F.col("right_batch"), F.col("left_batch")))


def with_batches(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """edges with left_batch, right_batch and batch of the table pairs (left_cell, right_cell, left_batch, right_batch), joined
    by both cells as ordered there; batch only where both ends share it. Contacts that pairs doesn't list get null, and repeated
    rows of pairs count once; a pair with two different batches is an error. pairs without batch columns changes nothing."""
    if not {"left_batch", "right_batch"} <= set(pairs.columns):
        return edges
    key = ["left_cell", "right_cell"]
    told = pairs.select(*[F.col(c).cast("string").alias(c) for c in (*key, "left_batch", "right_batch")]).distinct()
    _refuse_reserved(told)
    if not told.groupBy(*key).count().filter("count > 1").isEmpty():
        raise ValueError("a pair has two batches")
    out = edges.drop("left_batch", "right_batch", "batch").join(told, key, "left")
    return out.withColumn("batch", F.when(F.col("left_batch") == F.col("right_batch"), F.col("left_batch")))


def regions(spark: SparkSession, path: str) -> dict[str, list[list[tuple[float, float]]]]:
    """Rings by region of a GeoJSON feature collection (one small document, read whole)."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    out: dict[str, list] = {}
    for k, f in enumerate(json.loads(text)["features"]):
        shape = f["geometry"]
        rings = shape["coordinates"] if shape["type"] == "Polygon" else [r for p in shape["coordinates"] for r in p]
        out.setdefault(str(f.get("properties", {}).get("name", k)), []).extend([[(float(x), float(y)) for x, y, *_ in r] for r in rings])
    return out


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


@contextmanager
def locked(spark: SparkSession, path: str, wait: float = 60.0) -> Iterator[None]:
    """Holds the lock beside path: the file system's own on local disks, which ends with its process; elsewhere a lock file
    that only one can create. TimeoutError after `wait` seconds."""
    fs, p = _fs(spark, path)
    lock = fs.makeQualified(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}.lock"))
    until = time.monotonic() + wait
    if fs.getUri().getScheme() == "file":
        import fcntl

        local = lock.toUri().getPath()
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(local, "a") as f:
            while True:
                try:
                    fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
                    break
                except OSError:
                    if time.monotonic() > until:
                        raise TimeoutError(f"{local} is held") from None
                    time.sleep(0.02)
            yield
        return
    while True:
        try:
            fs.create(lock, False).close()
            break
        except Exception:
            if not fs.exists(lock):
                raise
            if time.monotonic() > until:
                raise TimeoutError(f"{lock} is held; remove it if no run is at work") from None
            time.sleep(0.5)
    try:
        yield
    finally:
        fs.delete(lock, False)


@dataclass
class Manifest:
    """The root of a run: what was written, by name, relative to the manifest, and the settings."""

    command: str
    outputs: dict[str, str] = field(default_factory=dict)
    settings: dict = field(default_factory=dict)

    def write(self, spark: SparkSession, path: str) -> None:
        """Under the lock and whole: a reader sees the old manifest or the new one, and never none."""
        with locked(spark, path):
            self._replace(spark, path)

    def _replace(self, spark: SparkSession, path: str) -> None:
        fs, p = _fs(spark, path)
        aside = p.suffix(f".{uuid.uuid4().hex}")
        out = fs.create(aside, True)
        out.write(bytearray(json.dumps(asdict(self), indent=1, sort_keys=True).encode()))
        out.close()
        jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        how = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        qualified = fs.makeQualified(p)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(aside), qualified, how)

    @classmethod
    def update(cls, spark: SparkSession, path: str, change: Callable[[Manifest], None]) -> Manifest:
        """Read, change and write the manifest as one step: runs that update one manifest at once lose nothing of each other."""
        with locked(spark, path):
            now = cls.open(spark, path)
            change(now)
            now._replace(spark, path)
        return now

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Manifest:
        """By its path, or by the prefix of its run."""
        fs, p = _fs(spark, path)
        if not fs.exists(p) or fs.getFileStatus(p).isDirectory():
            path = f"{path.rstrip('/')}/manifest.json"
        text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
        return cls(**json.loads(text))

    def resolve(self, path: str, name: str) -> str:
        """The place of an output beside the manifest."""
        out = self.outputs[name]
        return out if out.startswith("/") or "://" in out else f"{path.rsplit('/', 1)[0]}/{out}"


class Staging:
    """Tables written under a hidden folder; commit() moves them into place and writes the manifest last."""

    def __init__(self, spark: SparkSession, target: str, command: str = "run"):
        self.spark, self.target = spark, target.rstrip("/")
        self.hidden = f"{self.target}/.staging-{uuid.uuid4().hex}"
        self.manifest = Manifest(command)

    def write(self, df: DataFrame, name: str) -> None:
        df.write.parquet(f"{self.hidden}/{name}.parquet")
        self.manifest.outputs[name] = f"{name}.parquet"

    def commit(self) -> str:
        moved = []
        try:
            for rel in self.manifest.outputs.values():
                fs, new = _fs(self.spark, f"{self.target}/{rel}")
                old = new.suffix(".old")
                if fs.exists(new):
                    fs.rename(new, old)
                moved.append((fs, new, old))
                if not fs.rename(_fs(self.spark, f"{self.hidden}/{rel}")[1], new):
                    raise OSError(f"{rel} could not be put in place")
        except Exception:
            for fs, new, old in moved:  # what stood there before comes back
                if fs.exists(old):
                    fs.delete(new, True)
                    fs.rename(old, new)
            raise
        path = f"{self.target}/manifest.json"
        self.manifest.write(self.spark, path)
        for fs, _, old in moved:
            fs.delete(old, True)
        fs, hidden = _fs(self.spark, self.hidden)
        fs.delete(hidden, True)
        return path

"""Cutting lineage in iterative operators, and sending this package to executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_sent: set[str] = set()


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() in the folder the session names; where none is named, one of this machine if the master is local, as in tests, and an error on a cluster."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="pairloom-"))
    return df.checkpoint()


def settled(df: DataFrame) -> DataFrame:
    """cut(), and the planner's guess of the size is forgotten too.

    A checkpoint keeps the estimate of its plan, a product over joins; where a loop's state enters its own next round
    several times, these estimates get several times as many digits each round, until planning takes longer than running.
    """
    done = cut(df)
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(done._jdf.rdd(), done._jdf.schema()), spark)


def ship(spark: SparkSession) -> None:
    """Send the package's source to the Python workers, once an application, so that they need no path to it.

    Not needed where the workers are started on this machine with the driver's path.
    """
    sc = spark.sparkContext
    root = Path(__file__).resolve().parent
    paths = {Path(p).resolve() for p in ["", *os.environ.get("PYTHONPATH", "").split(os.pathsep)]}
    if sc.applicationId in _sent or sc.master.startswith("local") and root.parent in paths:
        return
    folder = tempfile.mkdtemp(prefix="pairloom-")  # served to executors as long as the driver lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = f"{folder}/pairloom-source.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"pairloom/{p.relative_to(root)}")
    sc.addPyFile(path)
    _sent.add(sc.applicationId)

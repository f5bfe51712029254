"""Session helpers shared by operators that cut lineage."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for each application: they need not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).parent
    made = Path(tempfile.mkdtemp(prefix="lociforge-package-"))
    shutil.copytree(package, made / "tree" / package.name, ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(str(made / package.name), "zip", made / "tree"))
    _SHIPPED.add(sc.applicationId)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    The session's own folder (``spark.checkpoint.dir`` or one set before) always wins.  A temporary folder is
    made only for a local master, where every executor is this machine; on a cluster without a folder this raises.
    """
    sc = spark.sparkContext
    if set_before := sc.getCheckpointDir():
        return set_before
    if configured := spark.conf.get("spark.checkpoint.dir", None):
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="lociforge-checkpoint-")
    sc.setCheckpointDir(made)
    return made


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back: later reads neither recompute nor can lose it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

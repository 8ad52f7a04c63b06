"""Session helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def show_workers_the_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it. A cluster without
    that folder gets the package in the usual way (``--py-files``, an image)."""
    environment = spark.sparkContext.environment
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = environment.get("PYTHONPATH", "")
    if root not in path.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (path, root) if x)


def for_workers(f: Callable) -> Callable:
    """An operator whose Python parts run in workers: they get to know the package before the
    operator's plan takes the workers' environment down."""

    @wraps(f)
    def called(*args, **kwargs):
        for a in (*args, *kwargs.values()):
            if isinstance(a, DataFrame):
                show_workers_the_package(a.sparkSession)
                break
        return f(*args, **kwargs)

    return called


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point checkpoints at the cluster's shared folder.

    The folder named in ``spark.checkpoint.dir`` is used where it is set. Only a session
    without that setting (tests, a laptop) gets a folder of its own, and only when it runs
    in local mode; a cluster without a shared folder is an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = sc.getConf().get(CHECKPOINT_SETTING) or spark.conf.get(CHECKPOINT_SETTING, None)
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lodestone-checkpoint-")
    sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and forget its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    show_workers_the_package(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table written into the shared checkpoint folder. Unlike a checkpoint, the
    table carries no constraints of the plan it came from; those double with every round of a
    loop that filters its own result."""
    ensure_checkpoint_dir(df.sparkSession)
    show_workers_the_package(df.sparkSession)
    path = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder of Parquet files or directories."""
    show_workers_the_package(spark)
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def key_of(c: Column | str) -> Column:
    """The comparable form of an id: trimmed, lower case; blank counts as null."""
    trimmed = F.lower(F.trim(F.col(c) if isinstance(c, str) else c))
    return F.when(trimmed != "", trimmed)


def half_up(c: Column, digits: int = 4) -> Column:
    """Rounding that gives the same double on every engine: floor(x * 10^d + 0.5) / 10^d."""
    scale = float(10**digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """Column names that no column of ``df`` has, whatever its letter case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out

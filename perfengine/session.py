"""Session helpers: a local session for tests/bench and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import threading
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

import perfengine


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "perfengine") -> SparkSession:
    """A local session configured the way the library expects a cluster session to be.

    On a cluster the caller builds the session; the library only relies on
    ANSI mode, AQE and a UTC session time zone.
    """
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there; only when it is unset (local runs,
    tests) do we set one of our own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = os.environ.get("PERFENGINE_CHECKPOINT_DIR", "/tmp/perfengine-checkpoints")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SHIPPED: set[str] = set()
_SHIPPING = threading.Lock()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, which need not have it installed."""
    app = spark.sparkContext.applicationId
    with _SHIPPING:
        if app not in _SHIPPED:
            home = Path(perfengine.__file__).parent
            path = f"{tempfile.mkdtemp()}/perfengine.zip"
            with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
                for file in sorted(home.rglob("*.py")):
                    out.write(file, file.relative_to(home.parent))
            spark.sparkContext.addPyFile(path)
            _SHIPPED.add(app)

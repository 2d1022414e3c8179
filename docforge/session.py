"""Sessions: what executors need, and settings for large runs."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Runtime settings that suit large inputs; AQE splits skewed joins and sizes partitions.
SETTINGS = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true", "spark.sql.session.timeZone": "UTC"}


def tune(spark: SparkSession) -> SparkSession:
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir), as a new name in it.

    Only where the session names none and runs on one machine, as in tests, a
    temporary one is made and set; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not named and held.isDefined():
        named = held.get()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="docforge-"))
        named = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{named.rstrip('/')}/docforge-{uuid.uuid4().hex}"


def forget(spark: SparkSession, path: str) -> None:
    """Remove a folder of ``shared_dir`` when the process ends."""

    def remove() -> None:
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may have ended before the process
            pass

    atexit.register(remove)


def ship(spark: SparkSession) -> None:
    """Give executors this package, once a context: they may not share the driver's folders."""
    context = spark.sparkContext
    if getattr(context, "_docforge_shipped", False):
        return
    home = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp(prefix="docforge-ship-"))
    with zipfile.ZipFile(to / "docforge_package.zip", "w") as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, p.relative_to(home.parent))
    context.addPyFile(str(to / "docforge_package.zip"))
    atexit.register(shutil.rmtree, to, ignore_errors=True)
    context._docforge_shipped = True

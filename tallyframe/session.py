"""A Spark session with the settings that the library expects."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))


def ready(spark: SparkSession) -> SparkSession:
    """Ships this package to the Python workers, once for each application."""
    sc = spark.sparkContext
    if getattr(sc, "_tallyframe", None) != sc.applicationId:
        folder = tempfile.mkdtemp(prefix="tallyframe-")  # on the driver, whose file server hands it out
        path = os.path.join(folder, "tallyframe.zip")
        with zipfile.ZipFile(path, "w") as out:
            for base, _, files in os.walk(PACKAGE):
                for name in sorted(files):
                    if name.endswith(".py"):
                        full = os.path.join(base, name)
                        out.write(full, os.path.join("tallyframe", os.path.relpath(full, PACKAGE)))
        sc.addPyFile(path)
        sc._tallyframe = sc.applicationId
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode, where it may be unset, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"{tempfile.gettempdir()}/tallyframe-{spark.sparkContext.applicationId}"
    return folder.rstrip("/")


def for_session(spark: SparkSession, path: str) -> str:
    """Has a written path deleted when the session's driver ends, by the path's own file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def session(master: str = "local[8]", partitions: int = 8, memory: str = "8g") -> SparkSession:
    conf = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return SparkSession.builder.master(master).appName("tallyframe").config(map=conf).getOrCreate()

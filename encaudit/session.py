"""Session helpers: where to cut lineage, and code for the executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and stage tables, as the cluster names it.

    Only a local session without the setting gets a temporary folder of its own;
    on a cluster every executor has to reach the folder, so it must be named.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder all executors can reach")
        named = tempfile.mkdtemp(prefix="encaudit-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Compute a DataFrame once into a table in the shared folder, and read that.

    The table survives the loss of executors, keeps later plans from computing
    its rows again, and lets them read just the columns and rows they need. Row
    order is not kept.
    """
    table = f"{shared_dir(df.sparkSession)}/settled/{uuid.uuid4().hex}"
    df.write.parquet(table)
    return df.sparkSession.read.schema(df.schema).parquet(table)


def clear_settled(spark: SparkSession) -> None:
    """Delete all tables this application has settled, once no DataFrame reads them any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/settled")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors with their tasks, once per application.

    Functions that run in Python there need it where it is not installed. Spark
    serves the archive; executors read nothing from the driver's folder.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = f"{tempfile.mkdtemp(prefix='encaudit-code-')}/{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as held:
        for file in sorted(package.rglob("*.py")):
            held.write(file, file.relative_to(package.parent))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)

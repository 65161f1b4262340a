"""What a session needs before Python code of this package runs on executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to the executors, once for each application, so that workers can import it wherever they start."""
    context = spark.sparkContext
    if getattr(context, "_scriptorium_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="scriptorium-")) / "scriptorium.zip"  # the driver's own copy, which Spark serves
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, Path(root.name) / path.relative_to(root))
    context.addPyFile(str(archive))
    context._scriptorium_shipped = True


def spread(df: DataFrame, pieces: int = 1) -> DataFrame:
    """Rows of a table in too few pieces for all cores (a small file is one piece) dealt out evenly; a table in enough pieces as it is.

    ``pieces``: for each core; with more than one, a table in fewer is dealt out, as splits of a file with one row group are empty but one.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    least = cores // 2 if pieces == 1 else cores * pieces
    return df.repartition(cores * pieces) if df._jdf.queryExecution().toRdd().getNumPartitions() < least else df


def for_arrow(spark: SparkSession) -> None:
    """Sends the package, and bounds the rows and bytes of a batch that a Python worker holds at once."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))

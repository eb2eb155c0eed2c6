"""Makes this package importable in Python workers, wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent


#: Rows of an Arrow batch at most. Documents are long: Spark's 10,000 would hold tens of MB in the JVM and again in each Python worker.
BATCH_ROWS = 1000


def ship(spark: SparkSession, batch_rows: int = BATCH_ROWS) -> SparkSession:
    """Send the package's sources to the executors once for each Spark application (spark-submit --py-files does the same), and keep batches small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_rows))
    sc = spark.sparkContext
    if getattr(sc, "_sparkloom_shipped", None) != sc.applicationId:
        path = os.path.join(tempfile.mkdtemp(prefix="sparkloom-"), "sparkloom_src.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(_PACKAGE.rglob("*.py")):
                z.write(p, str(p.relative_to(_PACKAGE.parent)))
        sc.addPyFile(path)
        sc._sparkloom_shipped = sc.applicationId
    return spark

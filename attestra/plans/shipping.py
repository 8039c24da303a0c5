"""Sends the package to the executors of a session, so that it need not be installed there."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch: Spark's own default lets ten thousand texts wait in a Python worker at once.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
_SENT: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """The session, with the package sent once and Arrow batches of a bounded size unless the session sets one."""
    context = spark.sparkContext
    if context.applicationId not in _SENT:
        root = Path(__file__).resolve().parents[1]
        path = Path(tempfile.mkdtemp(prefix="attestra-"), "attestra.zip")
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        context.addPyFile(str(path))
        _SENT.add(context.applicationId)
    if not context.getConf().contains(BATCH):
        spark.conf.set(BATCH, str(BATCH_BYTES))
    return spark

"""Arrow batches of a bounded size, for whatever reads texts or vectors in tasks."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: What an Arrow batch holds, unless the session has set it: the JVM keeps each batch twice outside its heap, whatever a row weighs.
BATCH_BYTES = 4 << 20


def _release() -> None:
    """Give what a task has freed back to the system: Python workers outlive their tasks, and their memory is the executor's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def in_arrow(df: DataFrame, function, schema) -> DataFrame:
    """df.mapInArrow() over batches of a few megabytes instead of 10,000 rows of any size, in tasks that leave little memory behind."""

    def run(batches):
        yield from function(batches)
        _release()

    conf = df.sparkSession.conf
    if _BATCH not in conf.getAll:  # Spark's own default: the session has chosen nothing
        conf.set(_BATCH, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)

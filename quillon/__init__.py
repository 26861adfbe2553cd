"""Analysis of document-extraction output, and preparation of training data, on Spark."""

from __future__ import annotations

import os


#: Rows that go to a Python worker at a time; documents are long, so the default of 10,000 is much memory.
BATCH_ROWS = 1000


def prepare(spark) -> None:
    """Session settings for the registered queries.

    Python workers import this package from where the driver has it, whatever the working directory (on a cluster whose
    executors do not see that folder, submit the package with --py-files), and get BATCH_ROWS rows at a time, unless the
    session has a limit of its own."""
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = [x for x in spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep) if x]
    if here not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([here, *paths])
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, BATCH_ROWS)

"""Session helpers shared by all operators: shared scratch space and lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``.  Only where that setting
    is absent (tests, local runs) a temporary folder is chosen and remembered
    as the session's checkpoint folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir() or named
    return named.rstrip("/")


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:
        pass  # the session is gone; the folder is the cluster's to clean


@atexit.register
def drop_scratch() -> None:
    """Delete the scratch tables this process wrote."""
    while _written:
        _forget(*_written.pop())


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Cuts the lineage, survives the loss of executors, and lets several readers
    use one computation.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/millrace-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that no plan reads any more, as those of an earlier round."""
    for df in tables:
        path = getattr(df, "_scratch_path", None)
        if path is not None:
            _written[:] = [(s, p) for s, p in _written if p != path]
            _forget(df.sparkSession, path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: What a Python operator works on at once: rows and bytes of Arrow data.
SLICE_ROWS, SLICE_BYTES = 2000, 4 << 20


def sliced(run):
    """``run`` over small slices of its Arrow batches.

    A batch holds a fixed number of rows whatever their length; slices keep the
    Python objects and temporary arrays of an operator small for long texts too.
    """

    def slices(batches):
        for b in batches:
            step = max(1, min(SLICE_ROWS, int(b.num_rows * SLICE_BYTES / max(1, b.nbytes))))
            for k in range(0, b.num_rows, step):
                yield b.slice(k, step)

    def over(batches):
        return run(slices(batches))

    return over

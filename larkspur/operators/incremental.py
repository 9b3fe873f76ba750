"""Processing only new or changed records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut


def reread_from(runs: DataFrame) -> DataFrame:
    """One row ``(reread_from)``: the start of the oldest run still open when the last successful one began.

    A run without ``finished_at`` never closed: what it read may be unwritten.  Null means from the beginning,
    which also holds when no run ever succeeded.
    """
    good = (F.col("status") == "ok") & F.col("finished_at").isNotNull()
    last = runs.where(good).agg(F.max("started_at")).scalar()
    open_then = runs.where((F.col("started_at") <= last) & (F.col("finished_at").isNull() | (F.col("finished_at") > last)))
    return open_then.agg(F.min("started_at").alias("reread_from"))


def ledger(vectors: DataFrame, written: DataFrame | None = None) -> DataFrame:
    """Distinct versions that are processed: hashes with a finished write, and those that runs have marked.

    A version is a content hash, whatever record has it, so ``(doc_id, hash)`` is processed when its hash is.
    """
    done = vectors.where("hash is not null and embedded_at is not null").select("hash")
    return (done if written is None else done.unionByName(written.where("hash is not null").select("hash"))).distinct()


def pending(documents: DataFrame, vectors: DataFrame, runs: DataFrame, written: DataFrame | None = None, sweep: bool = True) -> DataFrame:
    """``(doc_id, hash, modified_at, reread)``: the active documents whose version is not processed yet.

    Records are reread from the start of the oldest transaction open at the last run; the bound reaches the scan as a filter
    on ``modified_at``.  Their key-and-version pairs are joined against the ledger, which removes what
    the overlap repeats, so a repeated or failed run neither skips nor repeats one.

    ``modified_at`` can't be trusted where clocks are wrong or files are restored with old times.  The ``sweep`` looks through
    the records before the bound in the same way, with ``reread`` false; a run without it costs only what is new, and leaves such
    records to the next run with it.

    written: what runs have marked (``marked``).  Defined cases: inactive rows, rows with null ``active`` or null hash are not
    pending; null ``modified_at`` counts as reread; repeated document rows come out once; with an empty ledger everything
    active is pending.
    """
    since = reread_from(runs).select(F.unix_micros("reread_from")).first()[0]
    bound = F.timestamp_micros(F.lit(since)) if since is not None else None
    recent: Column = F.lit(True) if bound is None else F.col("modified_at").isNull() | (F.col("modified_at") >= bound)
    done = ledger(vectors, written)

    def left(within: Column, reread: bool) -> DataFrame:
        rows = documents.where("active = 1 and hash is not null").where(within).select("doc_id", "hash", "modified_at")
        return rows.join(done, "hash", "left_anti").select("doc_id", "hash", "modified_at", F.lit(reread).alias("reread"))

    found = left(recent, True)
    if sweep and bound is not None:
        found = found.unionByName(left(F.col("modified_at") < bound, False))
    return found.distinct()


def marked(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, hash, run_id)`` of all runs that ended; empty where there was none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], "doc_id long, hash string, run_id string")
    return spark.read.schema("doc_id long, hash string, run_id string").parquet(path)


def mark_processed(batch: DataFrame, path: str, run_id: str) -> None:
    """Add a batch's versions to the ledger under its own run folder.

    The folder is replaced as a whole, so repeating a failed run leaves no version twice.
    """
    batch.select("doc_id", "hash").distinct().write.mode("overwrite").parquet(f"{path}/run_id={run_id}")


def run_once(documents: DataFrame, vectors: DataFrame, runs: DataFrame, path: str, run_id: str, process: Callable[[DataFrame], None], sweep: bool = True) -> int:
    """Process what is pending and mark it; the number of records.

    The batch is fixed before it is processed and marked only after that: a run that fails marks nothing, and its records come
    again; records of a run that ended don't.
    """
    batch = cut(pending(documents, vectors, runs, marked(documents.sparkSession, path), sweep))
    process(batch)
    mark_processed(batch, path, run_id)
    return batch.count()

"""Tables written between the phases of a job, in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = 8 << 20
#: Tables of at most so many bytes, by the sizes of their rows, are broadcast; larger ones are shuffled.
BROADCAST = 24 << 20
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, one of our own if the session is local, else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = held.get() if held.isDefined() else None
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that the whole cluster shares")
        at = _own.setdefault("dir", tempfile.mkdtemp(prefix="textloom-"))
    return at.rstrip("/")


def drop_table(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


class Scratch:
    """Written tables of one job. What a result reads lazily outlives the call and goes at exit; the rest is dropped by the job."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        bound_batches(spark)
        self.root = f"{shared_dir(spark)}/textloom-{uuid.uuid4().hex}"
        self.names: set[str] = set()
        atexit.register(self._clean)

    def _clean(self) -> None:
        try:
            drop_table(self.spark, self.root)
        except Exception:  # the session may already be gone
            pass

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back: lineage ends here, and a lost executor costs no recomputation."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            drop_table(self.spark, f"{self.root}/{name}")
            self.names.discard(name)

    def collect(self) -> None:
        """Lets the driver look for garbage, upon which Spark removes the shuffle files of finished phases."""
        self.spark.sparkContext._jvm.System.gc()

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df``, the job's result, and drop every other table of the job."""
        out = self.write(df, name)
        self.drop(*(self.names - {name}))
        return out


def sized(df: DataFrame, row_bytes: int | Column) -> DataFrame:
    """A written table, marked for broadcast if its rows, of about that many bytes each, come to at most BROADCAST; otherwise as it is."""
    total = df.agg(F.sum(F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes)).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST else df


def free_name(name: str, taken: list[str]) -> str:
    """The name, lengthened until no column has it."""
    held = {c.lower() for c in taken}
    while name.lower() in held:
        name += "_"
    return name


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on the bytes of an Arrow batch to BATCH, if it is unset, off or greater; it is never raised.

    Spark's own bound of 64 MB is held several times over by each worker that reads and returns texts or
    images. The setting is read when a plan runs, so it can only be made in the session.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    bytes_now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) if now else 0
    if not 0 < bytes_now <= BATCH:
        spark.conf.set(key, f"{BATCH}b")


def whole_text(col: str | Column = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))

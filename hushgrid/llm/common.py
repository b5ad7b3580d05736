"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only where the session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        base = tempfile.mkdtemp(prefix="spark-hushgrid-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/hushgrid-{what}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, what: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends here."""
    path = scratch(df.sparkSession, what)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of an Arrow batch that hold whole texts: batches are what bounds a worker's memory.
BATCH = 1000


def small_batches(spark: SparkSession) -> SparkSession:
    """A session of the same application with the settings of ``spark`` but Arrow batches of ``BATCH`` rows at most; ``spark`` stays as it is.

    A query's shuffle files go when it ends, not when the driver's collector comes by: with one table written after another they would add up.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if k.startswith("spark.sql.") and spark.conf.isModifiable(k):
            own.conf.set(k, v)
    rows = int(own.conf.get(name))
    own.conf.set(name, str(min(rows, BATCH) if rows > 0 else BATCH))
    own.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return own


def written(df: DataFrame, what: str) -> str:
    """The path of ``df`` as a table in the shared folder, for any session to read; whole texts take least disk as zstd."""
    path = scratch(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def lower_ascii(text: str) -> str:
    """A-Z in lower case, every other character as it is (bytes of UTF-8 beyond ASCII are no letters)."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def fold_of(doc_id: Column, mod: int) -> Column:
    """crc32(id as text) mod ``mod``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(mod)).cast("int")


def free_names(columns: list[str], taken: list[str]) -> list[str]:
    """Names for ``columns`` of which none, whatever its case, is one of ``taken`` or of another: clashing ones get underscores."""
    used, out = {t.lower() for t in taken} | {c.lower() for c in columns}, []
    reserved = {t.lower() for t in taken}
    for c in columns:
        own = c
        while own.lower() in reserved or own != c and own.lower() in used:
            own += "_"
        used.add(own.lower())
        out.append(own)
    return out

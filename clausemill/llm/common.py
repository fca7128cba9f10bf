"""What the training-data operators share: the shared folder, ranks, word rules."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

_OWN: dict[str, str] = {}
#: Where the tables are that stored() has made, by the identity of the DataFrame.
_PATHS: dict[int, str] = {}

#: Bytes: A-Z to lower case, everything else as it is.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is spark.checkpoint.dir of the session. Where that is unset and driver
    and executors are one process, as in tests, one temporary folder per
    application is made and removed at exit; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        folder = tempfile.mkdtemp(prefix="clausemill-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _OWN[app] = f"file://{folder}"
    return _OWN[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own for a table, below a folder of the application."""
    return f"{shared_dir(spark)}/clausemill/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df as a table of its own in the shared folder and reads it again.

    This cuts the lineage with files that outlive any executor, runs what led to
    df once only, and gives the planner the true size of the table.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = path
    weakref.finalize(out, _PATHS.pop, id(out), None)
    return out


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Removes tables made by stored() that nothing reads any more."""
    for df in tables:
        if path := _PATHS.pop(id(df), None):
            remove(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Removes all tables that this application has stored, once the results that were made from them are written."""
    remove(spark, f"{shared_dir(spark)}/clausemill/{spark.sparkContext.applicationId}")


def whole_rows(df: DataFrame) -> Column:
    """All columns of a row as one struct (doc): whatever they are called, they meet no other names, and doc.* gives them back."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc")


def numbered_rows(df: DataFrame) -> DataFrame:
    """doc (the whole row) and row (a unique number), as a stored table: two scans of one input need not split it alike."""
    return stored(df.select(whole_rows(df), F.monotonically_increasing_id().alias("row")), "rows")


def spread_rank(df: DataFrame, keys: list[str], order: list[Column], name: str, buckets: int = 1024) -> DataFrame:
    """df with the rank (long, from 0) of each row among those of equal keys.

    The order within equal keys is by a hash of `order`, then by `order`. A key
    that holds a large part of all rows is never brought together: rows are
    ranked within (key, hash bucket), and the ranks of a bucket start after the
    counts of the lower buckets, of which a key has at most `buckets`.
    Null keys are equal to each other. Rows that are equal in `order` as well
    are interchangeable and get consecutive ranks.
    """
    ks = [F.col(k) for k in keys]
    hashed = df.withColumn("_rh", F.xxhash64(*order)).withColumn("_rb", F.pmod(F.col("_rh"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(*ks).orderBy("_rb").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        hashed.groupBy(*ks, "_rb").agg(F.count(F.lit(1)).alias("_rn"))
        .withColumn("_rs", F.coalesce(F.sum("_rn").over(before), F.lit(0)))
        .select(*[k.alias(f"_rk{i}") for i, k in enumerate(ks)], F.col("_rb").alias("_rbb"), "_rs")
    )
    own = Window.partitionBy(*ks, "_rb").orderBy("_rh", *order)
    ranked = hashed.withColumn("_ro", F.row_number().over(own))
    same = F.col("_rb") == F.col("_rbb")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_rk{i}"))
    out = ranked.join(starts, same, "inner").withColumn(name, (F.col("_rs") + F.col("_ro") - 1).cast("long"))
    return out.select(*df.columns, name)


def fold(name: str, of: int) -> Column:
    """crc32 of an id's decimal text, modulo `of`; null ids fall in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(name).cast("string").cast("binary")), F.lit(of)).cast("int"), F.lit(0))


def in_fold(value: object, of: int) -> int:
    """As fold(), for one Python value."""
    return 0 if value is None else zlib.crc32(str(value).encode()) % of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LONG, INT, STR, DBL, BOOL, BIN = T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType(), T.BooleanType(), T.BinaryType()

"""What several operators share: written tables that cut lineage, and gapless ranks without one big task."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

#: The white space of the text contracts: space and U+0009 to U+000D.
SPACE = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one is set only where the session names none."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quarry-"))
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


#: Rows of an Arrow batch. The JVM and its Python worker each hold a batch of whole texts more than once.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Sets BATCH_ROWS for the session, unless it names a number of its own. It stays set: what operators return is
    run later."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) in (None, "10000"):
        spark.conf.set(key, str(BATCH_ROWS))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lost executors recompute from files, not from the start."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Names of the columns that tell rows apart, for tables that don't have them (else see ``row_names``).
ROW = ("_row_file", "_row_place")


def row_names(df: DataFrame) -> tuple[str, str]:
    """ROW, or with as many underscores after both names as make them new to ``df``."""
    taken, names = {c.lower() for c in df.columns}, ROW
    while taken & set(names):
        names = tuple(f"{n}_" for n in names)
    return names


def numbered(df: DataFrame, names: tuple[str, str] = ROW) -> DataFrame:
    """``df`` with the columns ``names``, by which each row is told from all others: the file that it is read from and its
    place there, so that a row keeps its number however often, and by however many executors, the files are read.
    A table that is not read from files is written first."""
    try:
        where = df.metadataColumn("_metadata")
        out = df.select("*", F.xxhash64(where["file_path"]).alias(names[0]), where["row_index"].alias(names[1]))
        out.schema  # noqa: B018  (resolves the columns)
        return out
    except AnalysisException:
        return numbered(written(df, "numbered"), names)


def forget(df: DataFrame) -> None:
    """Deletes the files of a ``written`` table that no later step reads."""
    jvm = df.sparkSession.sparkContext._jvm
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ranked(df: DataFrame, group: list[str], order: list[str], out: str, rows: int | None = None) -> DataFrame:
    """Adds ``out``: 0, 1, 2 ... within each group, in an order that depends on the rows' values only.

    Rows are dealt to about sqrt(rows) hash buckets; a row's rank is its rank in (group, bucket) plus the sizes
    of the group's earlier buckets. So no task holds a whole group, however hot. ``df`` is read more than once.
    """
    n = df.count() if rows is None else rows
    buckets = max(1, math.isqrt(n))
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    before = W.partitionBy(*group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = dealt.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = W.partitionBy(*group, "_bucket").orderBy(*order)
    local = dealt.withColumn("_rank", F.row_number().over(inside) - 1)
    return local.join(offsets, [*group, "_bucket"]).withColumn(out, (F.col("_before") + F.col("_rank")).cast("long")).drop("_bucket", "_before", "_rank")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def most_frequent(counts: DataFrame, value: str, limit: int) -> DataFrame:
    """Rows of (value, n) with n at least as large as keeps them to ``limit`` rows: all or none of those with the same
    n. The cut comes from the histogram of n, so no task sends its own top rows."""
    kinds = counts.groupBy("n").agg(F.count(F.lit(1)).alias("rows"))
    running = kinds.where("n >= 64").withColumn("upto", F.sum("rows").over(W.orderBy(F.desc("n")).rangeBetween(W.unboundedPreceding, 0)))
    low = kinds.where("n < 64").groupBy("n").agg(F.sum("rows").alias("rows")).collect()
    least = running.where(F.col("upto") <= limit).agg(F.min("n"), F.max("upto")).first()
    over = running.where(F.col("upto") > limit).limit(1).count()
    cut, upto = (least[0], least[1]) if least[0] is not None else (1 << 62, 0)
    if not over:  # all counts from 64 on fit: go on below
        for r in sorted(low, key=lambda r: -r["n"]):
            if upto + r["rows"] > limit:
                break
            cut, upto = r["n"], upto + r["rows"]
    return counts.where(F.col("n") >= cut).select(value, "n")

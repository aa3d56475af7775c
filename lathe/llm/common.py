"""What the corpus operators share: reading tables, cutting lineage, ordering rows."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word pattern `[^\x20\x09-\x0D]+`, as a Java character class.
SPACE = r"[\x20\x09-\x0D]"

#: Bytes of the Arrow batches that carry texts to Python workers and back. Spark's own limit is 64 MB, which a worker and
#: its executor hold several times over.
BATCH_BYTES = 4_000_000

_written: list[tuple[SparkSession, str]] = []
_own_dir: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares (spark.checkpoint.dir). Only where that is unset, as in
    local tests, a folder of this machine is used instead."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="corpus-"))
    return f"file://{_own_dir[0]}"


def durable(df: DataFrame, label: str, files: int | None = None) -> DataFrame:
    """df written as a Parquet table to the shared folder and read back. files: for tables of a known,
    small size, how many files to gather it in first (else each task writes one).

    This cuts the lineage: later stages read files that outlive any executor, and what made them
    is computed once. The table goes when the driver's session ends (or with `release`)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpus-{label}-{uuid.uuid4().hex}"
    (df.repartition(files) if files else df).write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """From here on the session's Arrow batches have at most BATCH_BYTES, or what it allows if that is less. Batches are
    cut when a query runs, so this outlasts the call; rows that are small come 10,000 at a time as before."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def release() -> None:
    """Deletes the tables that `durable` has written."""
    while _written:
        spark, path = _written.pop()
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001 - the session may have ended before the driver
            return


atexit.register(release)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words_of(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text as an array; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def spread_join(left: DataFrame, right: DataFrame, key: str, rows: int) -> DataFrame:
    """left joined with right, which has one row for each key. rows: how many left has, about. Keys with more
    than an even task's share of rows are split by salts, and their row of right is repeated for each;
    there are at most as many such keys as tasks, so their list is broadcast."""
    limit = max(256, rows // partitions(left.sparkSession))
    hot = left.groupBy(F.col(key).alias("_spread_hot")).agg(F.ceil(F.count("*") / limit).cast("int").alias("_spread_ways")).where("_spread_ways > 1")
    ways = F.coalesce("_spread_ways", F.lit(1))
    one = left.join(F.broadcast(hot), left[key] == F.col("_spread_hot"), "left").withColumn("_spread_salt", F.pmod(F.xxhash64(*left.columns), ways).cast("int"))
    two = right.join(F.broadcast(hot), right[key] == F.col("_spread_hot"), "left").withColumn("_spread_salt", F.explode(F.sequence(F.lit(0), ways - 1)))
    return one.drop("_spread_hot", "_spread_ways").join(two.drop("_spread_hot", "_spread_ways"), [key, "_spread_salt"]).drop("_spread_salt")


def running_offsets(counts: DataFrame, keys: list[str], part: str, count: str, out: str) -> DataFrame:
    """For each (keys, part) of a table of partial counts: how many rows the key has in lower parts.

    counts holds a row for each key and part (a fixed number of parts), never the rows themselves."""
    from pyspark.sql import Window

    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(out, F.coalesce(F.sum(count).over(before), F.lit(0)))


def ranked(df: DataFrame, keys: list[str], order: list[Column], out: str) -> DataFrame:
    """df with a column `out`: the place (from 0) of each row among those with equal keys, by `order`.

    Rows are sorted over range partitions of (keys, order), so a key with very many rows lies in many
    of them. A place is the row's place in its partition plus how many rows of its key lower
    partitions have; only these counts (a row for each key and partition) are summed up by key."""
    spark = df.sparkSession
    tie = F.monotonically_increasing_id()  # spreads equal rows, too
    named = df.withColumn("_tie", tie).withColumns({f"_o{k}": c for k, c in enumerate(order)})
    by = [F.col(c) for c in (*keys, *(f"_o{k}" for k in range(len(order))), "_tie")]
    rows = named.repartitionByRange(partitions(spark), *by).sortWithinPartitions(*by).select(*df.columns, F.monotonically_increasing_id().alias("_at"))
    rows = durable(rows, "sorted").withColumn("_part", F.shiftright("_at", 33))
    runs = rows.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    runs = running_offsets(runs, keys, "_part", "_n", "_before").withColumnsRenamed({k: f"_k_{k}" for k in keys} | {"_part": "_p"})
    same = F.col("_part") == F.col("_p")
    for k in keys:
        same = same & rows[k].eqNullSafe(runs[f"_k_{k}"])
    return rows.join(runs, same).withColumn(out, F.col("_before") + F.col("_at") - F.col("_first")).select(*df.columns, out)

"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What counts as a word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_own_dir: str | None = None
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only a local session may leave it unset; then one temporary folder per process serves."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="quaywave-")
        atexit.register(shutil.rmtree, _own_dir, True)
    return _own_dir


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts the lineage and survives lost executors.

    The table goes when the driver's JVM ends, or before that by discard() or sweep()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._quaywave_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the table of a materialize() result that nothing reads any more."""
    spark, path = df.sparkSession, df._quaywave_path
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _written.remove(path)


def sweep(spark: SparkSession) -> int:
    """Deletes the tables that this process wrote with materialize(); call it once no result that reads them is needed."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    count = len(_written)
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)
    return count


def spread_join(many: DataFrame, one: DataFrame, keys: list[str], salt: list[str], how: str = "inner", sizes: DataFrame | None = None) -> DataFrame:
    """many.join(one, keys, how), "inner" or "left", where any key of `many` may be hot and `one` holds a key once at most.

    Keys with over 1 / parts of the rows of `many` are fewer than `parts`: so many rows at most are broadcast.
    Their rows are dealt by the hash of the columns `salt`, and their row of `one` is repeated for each
    share; so no task gets much over 1 / parts of the rows on account of a key. `many` should be a table at hand:
    its rows are counted and grouped first; sizes (keys, _n: rows of `many`) spares the grouping. Null keys match nothing."""
    total = many.count()
    parts = max(256, min(1 << 16, total // 50_000))
    limit = max(1, total // parts)
    if sizes is None:
        sizes = many.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = sizes.where(F.col("_n") > limit)
    hot = F.broadcast(hot.select(*keys, F.ceil(F.col("_n") / F.lit(limit)).cast("int").alias("_shares")))  # fewer than `parts` rows
    share = F.pmod(F.xxhash64(F.lit(17), *salt), F.coalesce("_shares", F.lit(1))).cast("int")
    left = many.join(hot, keys, "left").withColumn("_share", share).drop("_shares")
    right = one.join(hot, keys, "left").withColumn("_share", F.explode(F.sequence(F.lit(0), F.coalesce("_shares", F.lit(1)) - 1))).drop("_shares")
    return left.join(right.hint("merge"), [*keys, "_share"], how).drop("_share")


def member_test(members: DataFrame, column: str, most: int = 1 << 19):
    """A test for columns that every value of members.column passes and few others do, at no exchange of what is tested.

    It looks into a bitmap of at least 16 bits a value and of at most `most` longs (4 MB): a scalar subquery, of
    a size that doesn't grow with the members. Beyond two million of these more others pass; a join tells them."""
    spark = members.sparkSession
    size = 1 << min(most.bit_length() - 1, max(10, (members.count() // 4).bit_length()))
    spot = members.select(F.pmod(F.xxhash64(column), F.lit(size * 64)).alias("spot"))
    marks = spot.groupBy(F.floor(F.col("spot") / 64).alias("id")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("spot") % 64).cast("int"))).alias("bits"))
    whole = spark.range(size).join(marks, "id", "left").select(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")).alias("x"))
    bitmap = materialize(whole.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["bits"]).alias("bitmap")), "marks")

    def test(value: Column) -> Column:
        at = F.pmod(F.xxhash64(value), F.lit(size * 64))
        bits = F.get(bitmap.scalar(), F.floor(at / 64).cast("int"))
        return value.isNotNull() & (F.call_function("shiftright", bits, (at % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)

    return test


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def word_count(column: Column) -> Column:
    return F.regexp_count(column, F.lit(WORD)).cast("long")


def rank_within(df: DataFrame, keys: list[str], order: list[Column], spread: int | None = None, name: str = "rank", counted: DataFrame | None = None, ties: list[Column] | None = None, beside: DataFrame | None = None) -> DataFrame:
    """Adds a gapless 0-based rank of each row within its keys (which may not be null).

    A group is dealt into `spread` parts by the hash of its ordering columns; parts are counted first
    (a partial aggregation), their offsets are running sums over at most `spread` rows a key, and only
    the rows of one part are sorted together. So no task ever holds a whole hot group. Unless given,
    spread follows the rows of df (a table at hand: counting reads its footers), some 50000 a part.
    The order is the hash's, not the columns' own: deterministic, and evenly mixed. `counted` is a slimmer
    table with the same keys and ordering columns, row for row, to count on; `ties` order rows that `order` can't.
    The columns of `beside` (one row a key) join the offsets, and so the rows, without another exchange of these."""
    counted = df if counted is None else counted
    if spread is None:
        spread = min(1 << 16, max(64, counted.count() // 50_000))
    part = F.pmod(F.xxhash64(F.lit(7), *order), F.lit(spread)).cast("int")
    rows = df.withColumn("_part", part)
    sizes = counted.withColumn("_part", part).groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    if beside is not None:  # at most `spread` rows of offsets a key
        offsets = offsets.join(beside.hint("merge"), keys)
    inside = Window.partitionBy(*keys, "_part").orderBy(F.xxhash64(F.lit(11), *order), *order, *(ties or []))
    return (
        rows.join(offsets.hint("merge"), [*keys, "_part"])
        .withColumn(name, (F.col("_before") + F.row_number().over(inside) - 1).cast("long"))
        .drop("_part", "_before")
    )

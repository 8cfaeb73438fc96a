"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import shared_folder

#: White space as the operators' contracts define it; ``bytes.split()`` uses the same set.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows that a Python worker gets at once: documents are long, and a batch is held several times over.
BATCH_ROWS = 500


def _small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches of this session, unless its user has set another size than Spark's default."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def remainder(column: str, modulus: int) -> Column:
    """crc32 of an id's text modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


#: Rows that a file of a written table takes where their number is known.
FILE_ROWS = 500_000


def written(df: DataFrame, name: str, rows: int | None = None, shuffled: bool = True) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage and survives lost executors.

    Where about so many ``rows`` come, it takes as many files as they need, three at least: merged
    from the partitions of a light last stage (``shuffled``), else by a shuffle behind a heavy one.
    """
    spark = df.sparkSession
    _small_batches(spark)
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if rows is not None:
        files = max(3, -(-rows // FILE_ROWS))
        df = df.coalesce(files) if shuffled else df.repartition(files)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A row's place within its task, below the task's number, in ``monotonically_increasing_id``.
PLACE_BITS = 33


def range_sorted(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` dealt out by ranges of ``order`` and sorted, as a written table with ``_p``, a range's number, and ``_r``,
    a row's place in its range from 0; ranges ascend.

    Ranges are cut between rows of a different key only: end ``order`` with a unique column where a key may be hot.
    Behind it stands a sample of ``df``, which so runs twice: pass a written table.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    place = F.col("_m").bitwiseAND((1 << PLACE_BITS) - 1)
    return written(rows.select(*df.columns, F.shiftright("_m", PLACE_BITS).alias("_p"), place.alias("_r")), name)


def numbered(ranged: DataFrame, number: str, group: str | None = None, size: str | None = None) -> DataFrame:
    """Rows of ``range_sorted`` with ``number``, their place from 0 in the whole order (within ``group``, by which the
    order begins, if given), and, as ``size``, the rows of their group.

    Only counts of ranges meet; no task holds a group.
    """
    keys = ["_p"] + ([group] if group else [])
    counts = ranged.groupBy(*keys).agg(F.count("*").alias("_c"), F.min("_r").alias("_first"))
    every = Window.partitionBy(*([group] if group else []))
    below = F.coalesce(F.sum("_c").over(every.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*keys, (below - F.col("_first")).alias("_shift"), *([F.sum("_c").over(every).alias(size)] if size else []))
    return ranged.join(counts, keys).withColumn(number, F.col("_r") + F.col("_shift")).drop("_p", "_r", "_shift")


#: A key with more than this share of a table's rows is hot: it meets its partner without a shuffle. There are at most
#: so many hot keys as the share goes into one, whatever the table's size.
HOT_SHARE = 1 / 1000


def joined(many: DataFrame, one: DataFrame, hot: DataFrame, key: str, how: str = "inner", keys: list | None = None) -> DataFrame:
    """``many`` joined with ``one`` (one row a key; the same join as by key alone).

    ``hot``: rows of ``one`` whose keys hold a large share of ``many``, at most ``1 / HOT_SHARE`` of them. They are
    sent to all tasks, so no task gets all rows of a hot key; the rest meet by key. ``keys``: the keys of ``hot``,
    where they are known and ``many`` has no null key; then a filter tells the rest.
    """
    near = many.join(F.broadcast(hot), key)
    rest = many.join(F.broadcast(hot.select(key)), key, "left_anti") if keys is None else many.where(~F.col(key).isin(keys))
    return near.unionByName(rest.join(one, key, how), allowMissingColumns=True)


#: Tables of so many links or fewer have their nodes' neighbours sent to all tasks; beyond, they are joined by key.
SENT_LINKS = 100_000


def _starred(pairs: DataFrame, rows: int, node: str, lows: DataFrame) -> DataFrame:
    """``pairs`` with ``low``, the smallest neighbour of ``node``, from ``lows(node, low, c)``; hubs without a shuffle."""
    if rows <= SENT_LINKS:
        return pairs.join(F.broadcast(lows.select(node, "low")), node)
    hubs = lows.where(F.col("c") > F.lit(max(HOT_SHARE * rows, 8.0))).select(node, "low")
    return joined(pairs, lows.select(node, "low"), hubs, node)


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """Connected components of ``edges(u, v)`` (longs) as ``(id, component)``, component = smallest id.

    Alternates large-star and small-star rounds, each a partially aggregated minimum per node and an
    equi-join back, until the edges stop changing (after about as many rounds as the logarithm of the longest
    path). Nodes without an edge are not returned. ``rows``: about how many edges there are, if known.
    """
    pairs = edges.where("u <> v").select(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi")).distinct()
    pairs = written(pairs, "edges", rows)
    before, rows = None, rows if rows is not None else pairs.count()
    while True:
        both = pairs.select(F.col("lo").alias("n"), F.col("hi").alias("m")).union(pairs.select(F.col("hi"), F.col("lo")))
        low = F.least(F.min("m"), F.first("n")).alias("low")
        lowest = both.groupBy("n").agg(low, F.count("*").alias("c")).withColumnRenamed("n", "lo")
        large = _starred(pairs, rows, "lo", lowest).select(F.col("low").alias("lo"), "hi").where("lo <> hi").distinct()
        lowest = large.groupBy("hi").agg(F.min("lo").alias("low"), F.count("*").alias("c"))
        small = _starred(large, rows, "hi", lowest)
        small = small.select(F.col("low").alias("lo"), F.explode(F.array("lo", "hi")).alias("hi"))
        small = small.where("lo <> hi").distinct()
        pairs = written(small, "edges", rows)
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first())
        if now == before:
            lone = pairs.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct()
            return pairs.select(F.col("hi").alias("id"), F.col("lo").alias("component")).union(lone)
        before, rows = now, now[0]

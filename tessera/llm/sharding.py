"""A uniform shuffle into shards of exact sizes.

How many rows each part of the input sends to each shard is drawn first: the matrix of a uniform shuffle, whose rows sum
to the parts' sizes and whose columns sum to the shards' sizes, is multivariate hypergeometric. Within a part, a random
permutation says which row goes where; rows are exchanged once; and in its shard each takes its place in a second random
order. So every arrangement of all rows is equally likely, and shards differ by one row at most.

The matrix is drawn in two steps, first for groups of parts, on the driver, then within each group, in tasks: neither
holds more than a bounded number of parts. Parts are runs of at most ``PART_ROWS`` rows of a written table, so a lost
executor's rows come back with the same numbers.

Edge cases: nulls in any column, empty texts and rows repeated in full are rows like others; with fewer rows than
shards, the last shards stay empty; an empty table gives an empty result. Further columns, whatever their names but
``shard``, ``slot``, ``_part`` and ``_at``, come through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

SHARDS = 8
SEED = 42
#: Rows of a part at most, as a power of two; parts of a group at most, about.
PART_BITS = 16
GROUP_PARTS = 1024
#: Rows of a shard that one task puts in order, about; ranges of a shard at least.
RANGE_ROWS, LEAST_RANGES = 1 << 16, 64


def hypergeometric(rng: np.random.Generator, good: int, bad: int, take: int) -> int:
    """How many of ``take`` rows, drawn from ``good`` and ``bad`` ones without replacement, are good.

    By inversion from the likeliest number outwards; unlike numpy's, it takes any sizes.
    """
    low, high = max(0, take - bad), min(take, good)
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    mode = min(max((take + 1) * (good + 1) // (good + bad + 2), low), high)
    p = q = math.exp(choose(good, mode) + choose(bad, take - mode) - choose(good + bad, take))
    left, up, down = rng.random() - p, mode, mode
    while left > 0 and (up < high or down > low):
        if up < high:
            p *= (good - up) * (take - up) / ((up + 1) * (bad - take + up + 1))
            up, left = up + 1, left - p
            if left <= 0:
                return up
        if down > low:
            q *= down * (bad - take + down) / ((good - down + 1) * (take - down + 1))
            down, left = down - 1, left - q
            if left <= 0:
                return down
    return mode


def matrix(rng: np.random.Generator, sizes: list[int], room: list[int]) -> list[list[int]]:
    """For each of the parts, how many rows it sends to each shard; ``room`` sums to the parts' sizes."""
    room, out = list(room), []
    for size in sizes:
        row, rest = [], sum(room)
        for free in room:
            rest -= free
            row.append(hypergeometric(rng, free, rest, size - sum(row)))
        room = [a - b for a, b in zip(room, row)]
        out.append(row)
    return out


def _matrix(rows: DataFrame, shards: int, seed: int) -> tuple[DataFrame, int]:
    """``_part, _to``: rows that each part sends to each shard; and the number of all rows."""
    spark = rows.sparkSession
    parts = written(rows.groupBy("_part").agg(F.count("*").alias("_n")), "parts", 1)
    groups = -(-parts.count() // GROUP_PARTS)
    parts = parts.withColumn("_group", F.pmod(F.xxhash64("_part"), F.lit(max(groups, 1))))
    sums = sorted(tuple(r) for r in parts.groupBy("_group").agg(F.sum("_n")).collect())
    total = sum(n for _, n in sums)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    drawn = matrix(np.random.default_rng([seed, 0]), [n for _, n in sums], room)
    above = spark.createDataFrame([(g, to) for (g, _), to in zip(sums, drawn)], "_group long, _room array<long>")

    def within(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_part")
        rng = np.random.default_rng([seed, 1, int(group["_group"].iloc[0])])
        to = matrix(rng, group["_n"].tolist(), [int(x) for x in group["_room"].iloc[0]])
        return pd.DataFrame({"_part": group["_part"].to_numpy(), "_to": to})

    table = parts.join(above, "_group").groupBy("_group").applyInPandas(within, "_part long, _to array<long>")
    return written(table, "matrix", 1), total


def _dealt(seed: int):
    @F.pandas_udf("int")
    def shard(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        last, order = None, None
        for part, at, to in batches:
            part, at, out = part.to_numpy(), at.to_numpy(), np.zeros(len(part), np.int32)
            starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else []
            for a, b in zip(starts, [*starts[1:], len(part)]):
                if part[a] != last:
                    last = part[a]
                    labels = np.repeat(np.arange(len(to.iloc[a]), dtype=np.int32), np.asarray(to.iloc[a], np.int64))
                    order = np.random.default_rng([seed, 2, int(last)]).permutation(labels)
                out[a:b] = order[at[a:b]]
            yield pd.Series(out)

    return shard


def shuffled(df: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``df`` with ``shard`` (0 to shards - 1) and ``slot``, a row's place in its shard, from 0 without gaps."""
    at = F.monotonically_increasing_id()
    rows = df.withColumn("_at", at).withColumns({"_part": F.shiftright("_at", PART_BITS), "_at": F.col("_at").bitwiseAND((1 << PART_BITS) - 1)})
    rows = written(rows, "parts")
    to, total = _matrix(rows, shards, seed)
    rows = rows.join(to, "_part").withColumn("shard", _dealt(seed)("_part", "_at", "_to")).drop("_to")
    # ranges of a random number come in order, and rows in the order of that number: a random order of each shard
    ranges = max(LEAST_RANGES, -(-total // (shards * RANGE_ROWS)))
    rows = rows.withColumn("_key", F.xxhash64(F.lit(seed), "_part", "_at")).withColumn("_range", F.pmod("_key", F.lit(ranges)))
    below = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "_range").agg(F.count("*").alias("_c"))
    counts = counts.select("shard", "_range", F.coalesce(F.sum("_c").over(below), F.lit(0)).alias("_below"))
    place = F.row_number().over(Window.partitionBy("shard", "_range").orderBy("_key", "_part", "_at"))
    out = rows.join(counts, ["shard", "_range"]).withColumn("slot", (F.col("_below") + place - 1).cast("long"))
    return out.select(*df.columns, "shard", "slot")


def sharded_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``: counts of the shards are one apart at most."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shuffled(rows, shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

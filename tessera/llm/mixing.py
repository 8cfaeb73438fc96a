"""Mixing overlapping sources to target weights by min-cost flow.

Documents are added up by membership pattern (the set of sources that hold them), a flow routes the
patterns' tokens to the sources' quotas with a cost that rises with every repetition, and each pattern's
share is then taken from its documents in a seeded order. Only one row a pattern reaches the driver.

Edge cases: a null text has size 0, so no words of it are taken (``mixed_copies`` keeps such rows once); null
sources form a source of their own, last in order; a row in no source at all (empty array) is not taken; repeated
rows are separate documents, any of which may be taken first, as they are equal; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, written

#: More membership patterns than this are refused: the flow is solved on the driver.
MAX_PATTERNS = 100_000
#: Documents are put in order by this many bits of their seeded hash at a time.
BITS = 12


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], share: float, most: float) -> list[float]:
    """Splits ``share`` of all sizes by weight; what exceeds ``most`` sizes of a source is shared anew."""
    out, left, free = [0.0] * len(sizes), share * sum(sizes), set(range(len(sizes)))
    while free and left > 0:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in over)
        free -= set(over)
    return out


def min_cost_flow(patterns: dict[tuple[int, ...], int], quotas: Sequence[int], repeats: int) -> dict[tuple[tuple[int, ...], int], int]:
    """Tokens from each pattern to each of its sources, at the least total cost.

    A pattern's k-th repetition costs k - 1 a token. All tokens of one repetition cost the same, so
    augmenting along cheapest paths first fills first copies everywhere, then second ones; a path
    may take tokens back from one source to give them to another (residual arcs).
    """
    flow: dict[tuple[tuple[int, ...], int], int] = {}
    used = dict.fromkeys(patterns, 0)
    need = list(quotas)
    holders: dict[int, list[tuple[int, ...]]] = {}
    for p in patterns:
        for s in p:
            holders.setdefault(s, []).append(p)
    for copy in range(1, repeats + 1):
        for target in sorted(holders):
            while need[target] > 0:
                # breadth-first from the target's shortage back to a pattern with room at this copy
                before: dict = {("s", target): None}
                queue, found = [("s", target)], None
                for node in queue:
                    if node[0] == "s":
                        steps = [("p", p) for p in holders[node[1]]]
                    else:
                        if used[node[1]] < copy * patterns[node[1]]:
                            found = node
                            break
                        steps = [("s", s) for s in node[1] if flow.get((node[1], s), 0) > 0]
                    for step in steps:
                        if step not in before:
                            before[step] = node
                            queue.append(step)
                if found is None:
                    break
                path, node = [], found
                while node is not None:
                    path.append(node)
                    node = before[node]
                amount = min(need[target], copy * patterns[found[1]] - used[found[1]])
                for (_, s), (_, p) in zip(path[1::2], path[2::2], strict=False):
                    amount = min(amount, flow[p, s])
                for (_, p), (_, s) in zip(path[::2], path[1::2], strict=True):
                    flow[p, s] = flow.get((p, s), 0) + amount
                for (_, s), (_, p) in zip(path[1::2], path[2::2], strict=False):
                    flow[p, s] -= amount
                used[found[1]] += amount
                need[target] -= amount
    return flow


def mix(
    docs: DataFrame, members: Column, size: Column, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, repeats: int = 2, seed: int = 42
) -> DataFrame:
    """``docs`` with ``_sources``, ``_size``, ``_source_size``, ``_target`` (both of the first source) and ``_taken`` (tokens).

    ``members`` is an array of source names. Each source's share goes by ``weights``, repeated over the
    sources in code-point order, nulls last. In the seeded order, a pattern's first documents get one copy
    more than the others; the one on the border gives the rest of the words, so sums match exactly.
    """
    spark = docs.sparkSession
    kept = docs.withColumns({"_sources": F.array_sort(F.array_distinct(members)), "_size": size})
    kept = kept.withColumn("_order", F.xxhash64(F.lit(seed), *[c for c in docs.columns]))
    kept = written(kept, "sizes")
    rows = kept.groupBy("_sources").agg(F.sum("_size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    names = sorted({s for r in rows for s in r["_sources"]}, key=lambda s: (s is None, s or ""))
    at = {s: i for i, s in enumerate(names)}
    patterns = {tuple(sorted(at[s] for s in r["_sources"])): r["size"] for r in rows if len(r["_sources"])}
    sizes = [sum(v for p, v in patterns.items() if i in p) for i in range(len(names))]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], share, repeats)
    flow = min_cost_flow(patterns, [round(x) for x in wanted], repeats)

    taken = dict.fromkeys(patterns, 0)
    for (p, _), amount in flow.items():
        taken[p] += amount
    plan = spark.createDataFrame(
        [
            ([names[i] for i in p], taken[p] // v if v else 0, taken[p] % v if v else 0, sizes[p[0]], wanted[p[0]])
            for p, v in patterns.items()
        ],
        "_p array<string>, _copies long, _extra long, _source_size long, _target double",
    ).withColumn("_p", F.array_sort("_p"))
    same = F.to_json(F.struct("_sources"))
    plan = plan.withColumn("_k", F.to_json(F.struct(F.col("_p").alias("_sources")))).drop("_p")
    out = kept.withColumn("_k", same).join(F.broadcast(plan), "_k", "left")

    # the border of each pattern: two steps of BITS bits, by sums of sizes; then document by document
    first = F.shiftrightunsigned(F.col("_order"), 64 - BITS)
    second = F.shiftrightunsigned(F.col("_order"), 64 - 2 * BITS).bitwiseAND((1 << BITS) - 1)
    out = out.withColumns({"_b1": first, "_b2": second})
    step1 = _border(out.where("_extra > 0").select("_k", "_b1", "_size", "_extra"), ["_k"], "_b1", "_extra").withColumnsRenamed({"_at": "_at1", "_left": "_left1"})
    out = out.join(F.broadcast(step1), "_k", "left")
    on1 = out.where("_b1 = _at1")
    step2 = _border(on1.select("_k", "_b2", "_size", "_left1"), ["_k"], "_b2", "_left1").withColumnsRenamed({"_at": "_at2", "_left": "_left2"})
    out = out.join(F.broadcast(step2), "_k", "left")
    ahead = F.when(F.col("_b1") < F.col("_at1"), True).when((F.col("_b1") == F.col("_at1")) & (F.col("_b2") < F.col("_at2")), True).otherwise(False)
    border = F.coalesce((F.col("_b1") == F.col("_at1")) & (F.col("_b2") == F.col("_at2")), F.lit(False))
    whole = out.where(~border).withColumn("_more", F.when(ahead, F.col("_size")).otherwise(F.lit(0)))
    before = F.sum("_size").over(Window.partitionBy("_k").orderBy("_order", *[c for c in docs.columns]).rowsBetween(Window.unboundedPreceding, -1))
    edge = out.where(border).withColumn("_before", F.coalesce(before, F.lit(0)))
    edge = edge.withColumn("_more", F.least(F.greatest(F.col("_left2") - F.col("_before"), F.lit(0)), F.col("_size"))).drop("_before")
    out = whole.unionByName(edge)
    out = out.withColumn("_taken", (F.coalesce("_copies", F.lit(0)) * F.col("_size") + F.coalesce("_more", F.lit(0))).cast("long"))
    return out.drop("_k", "_copies", "_extra", "_b1", "_b2", "_at1", "_left1", "_at2", "_left2", "_more", "_order")


def _border(rows: DataFrame, keys: list[str], bucket: str, amount: str) -> DataFrame:
    """For each key: the bucket in which ``amount`` is reached (``_at``) and what is left to take in it (``_left``)."""
    sums = rows.groupBy(*keys, bucket).agg(F.sum("_size").alias("s"), F.first(amount).alias("a"))
    upto = F.sum("s").over(Window.partitionBy(*keys).orderBy(bucket))
    return (
        sums.withColumn("upto", upto)
        .where("upto >= a and upto - s < a")
        .select(*keys, F.col(bucket).alias("_at"), (F.col("a") - F.col("upto") + F.col("s")).alias("_left"))
    )


def mix_documents(docs: DataFrame, seed: int = 42) -> DataFrame:
    """The mix of ``documents``, each in the one source that its row names."""
    slim = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"))
    out = mix(slim, F.array("source"), F.col("size"), seed=seed)
    return out.select(
        "doc_id", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken")
    )


def mixed_copies(docs: DataFrame, seed: int = 42) -> DataFrame:
    """``docs`` as mixed: each row as often as the mix takes it, the border row to the nearest whole copy."""
    columns = docs.columns
    slim = docs.select(F.struct(*columns).alias("_row"), F.xxhash64(*columns).alias("_h"), F.col("source").alias("_s"), size_of(F.col("text")).alias("_words"))
    out = mix(slim, F.array("_s"), F.col("_words"), seed=seed)
    times = F.when(F.col("_size") > 0, F.round(F.col("_taken") / F.col("_size"))).otherwise(F.lit(1)).cast("int")
    return out.withColumn("_times", times).where("_times > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_c")).select("_row.*")

"""Ladders of units: ever wider stretches of the axis, the means of their features, and a ridge for each width.

All widths, fold schemes and shuffled targets are served by one pass over the units: shuffled targets share the features'
products and add a column each to the right-hand side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import summed
from ..functions.digests import Digests
from ..functions.ranks import shuffled_number, value_ranks
from ..sources.shared import stored
from .bootstrap import RANGE_ROWS as STRIP, _first_mix, _taken, draw_arrays
from .models import ALPHAS

#: Units that a fold's training set needs; units from which a ladder's step can be read.
LEAST, READABLE = 5, 100
#: Shuffled targets of a null, and draws of units.
NULLS, DRAWS = 20, 2_000
#: Positions whose units are made in one task; units whose shuffled targets are; units of a range that is sorted in one task.
STRETCH, PLACES, SORTED = 1 << 12, 1 << 14, 1 << 16
#: Ranges of a width's targets or predictions, at most.
CUTS = 64
#: Groups that a width's draws are dealt to, at most; picks that are worth a group.
GROUPS, GROUP_PICKS = 24, 1 << 26


def unit_vectors(df: DataFrame, windows: Sequence[int], target: str, features: Sequence[str], pos: str = "pos") -> DataFrame:
    """``window_size, unit, n, y, x``: the means of the target and of each feature over the rows of each unit.

    Rows are summed to positions, positions are dealt to stretches of the axis, and a stretch gives the units of all widths
    that begin there, so a position moves once (twice near a stretch's start), whatever the number of widths. Nulls and NaN of
    a feature are left out of its mean, which is null where nothing is left; rows without a target are left out.
    """
    value = [F.col(c).cast("double") for c in features]
    known = [v.isNotNull() & ~F.isnan(v) for v in value]
    parts = [F.col(target).cast("double"), *[F.when(k, v).otherwise(0.0) for k, v in zip(known, value)], *[F.when(k, 1.0).otherwise(0.0) for k in known]]
    names, d = [f"_s{i}" for i in range(len(parts))], len(features)
    rows = df.where(F.col(target).isNotNull()).select(F.col(pos).alias("_p"), *[p.alias(n) for n, p in zip(names, parts)])
    per = rows.groupBy("_p").agg(F.count("*").alias("n"), *[F.sum(n).alias(n) for n in names])
    # the unit around position 1 has up to twice its width, as division goes towards 0
    reach = 2 * max(windows)
    stretch = max(STRETCH, reach)
    at = F.col("_p").cast("long") - 1
    here = F.floor(at / stretch)
    near = F.when(F.pmod(at, F.lit(stretch)) < reach, here - 1).otherwise(here)
    dealt = per.select(at.alias("_at"), "n", *names, F.explode(F.array_distinct(F.array(here, near))).alias("_stretch"))

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at")
        sums, n, out = pdf[names].to_numpy(float), pdf["n"].to_numpy(), []
        for w in windows:
            if pdf["_at"].isna().any():  # rows without a position are a group of their own
                unit, starts, mine = [None], [0], slice(None)
            else:
                at = pdf["_at"].to_numpy(np.int64)
                unit = np.where(at < 0, -(-at // w), at // w)
                mine = np.where(unit > 0, unit * w, unit * w - w + 1) // stretch == pdf["_stretch"].iloc[0]
                unit, starts = np.unique(unit[mine], return_index=True)
            if not len(unit):
                continue
            s, count = np.add.reduceat(sums[mine], starts), np.add.reduceat(n[mine], starts)
            k = s[:, 1 + d :]
            x = s[:, 1 : 1 + d] / np.where(k > 0, k, 1)
            if (k == 0).any():
                x = np.where(k > 0, x.astype(object), None)
            out.append(pd.DataFrame({"window_size": w, "unit": unit, "n": count, "y": s[:, 0] / count, "x": list(x)}))
        return pd.concat(out) if out else pd.DataFrame(columns=["window_size", "unit", "n", "y", "x"], dtype=object)

    return dealt.groupBy("_stretch").applyInPandas(gather, "window_size int, unit int, n long, y double, x array<double>")


def with_unit_folds(units: DataFrame, folds: int = 10) -> DataFrame:
    """Adds ``fold_block``, stretches of the axis, and ``fold_random``; a width of few units has fewer folds, at least two."""
    # one row a width
    size = F.broadcast(units.groupBy("window_size").agg(F.count("*").alias("_n"), F.min("unit").alias("_lo"), F.max("unit").alias("_hi")))
    k = F.least(F.lit(folds).cast("long"), F.greatest(F.lit(2).cast("long"), F.expr("_n div 3")))
    block = F.least(F.floor((F.col("unit") - F.col("_lo") + 0.5) * k / (F.col("_hi") - F.col("_lo") + 1)), k - 1).cast("int")
    # vectors stay where they are while units are numbered
    keys = units.select("window_size", "unit")
    number = shuffled_number(keys, F.md5(F.concat_ws(":", F.lit("f"), "window_size", "unit")), "unit", by=["window_size"])
    dealt = units.join(number, ["window_size", "unit"], "left").join(size, "window_size")
    return dealt.withColumns({"fold_block": block, "fold_random": (F.col("number") % k).cast("int")}).drop("number", "_n", "_lo", "_hi")


_DEALT = np.dtype([("digest", "<u4"), ("unit", "<i4"), ("y", "<f8")])


def _by_digest(cells: np.ndarray, head: str) -> np.ndarray:
    """Cells in the order of their units' md5, of which they have the first digits."""
    cells = cells[np.argsort(cells["digest"], kind="stable")]
    same = np.append(False, cells["digest"][1:] == cells["digest"][:-1])
    for first in np.flatnonzero(np.append(same[1:], False) & ~same):
        last = first + 1
        while last < len(cells) and same[last]:
            last += 1
        tied = cells[first:last]
        cells[first:last] = tied[sorted(range(len(tied)), key=lambda i: (hashlib.md5(f"{head}:{tied['unit'][i]}".encode()).digest(), tied["unit"][i]))]
    return cells


def with_shuffled_targets(units: DataFrame, reps: int = NULLS) -> DataFrame:
    """Adds ``ys``: the unit's target, and those of the units that ``reps`` shuffles of its width put in its place.

    A shuffle's order is that of a md5. Targets go packed, by ranges of digests that are sorted each by itself, and from
    there to blocks of places.
    """
    if not reps:
        return units.withColumn("ys", F.array("y"))
    place = value_ranks(units, "unit", ["window_size"], "i").select("window_size", "unit", (F.col("i_min") - 1).cast("long").alias("_i"))
    placed = stored(units.select("window_size", "unit", "y").join(place, ["window_size", "unit"]), "places").withColumn("block", F.expr(f"cast(_i div {PLACES} as int)"))
    ranges = {r["window_size"]: -(-r["count"] // SORTED) for r in placed.groupBy("window_size").count().collect()}  # one row a width

    def digits(w: int, unit: pd.Series) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """The first digits of each unit's digest in each shuffle, and their range."""
        digests = Digests([f":{w}:{u}".encode() for u in unit])
        for rep in range(reps):
            first = digests.of(f"q:{rep}".encode())[0] >> np.uint64(32)
            yield rep, first, (first * np.uint64(ranges[w]) >> np.uint64(32)).astype(np.int64)

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, np.ndarray]]:
        for batch in batches:
            for w, unit in batch.groupby("window_size")["unit"]:
                for rep, _, to in digits(w, unit):
                    yield f"{w}:{rep}", np.bincount(to, minlength=ranges[w])

    below = {key: n.cumsum() - n for key, n in summed(placed.select("window_size", "unit"), counts, np.int64).items()}

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        w, out = int(pdf["window_size"].iloc[0]), []
        cells = np.empty(len(pdf), _DEALT)
        cells["unit"], cells["y"] = pdf["unit"], pdf["y"]
        for rep, first, to in digits(w, pdf["unit"]):
            cells["digest"] = first
            order = np.argsort(to, kind="stable")
            found, starts = np.unique(to[order], return_index=True)
            out += [(w, rep, r, c.tobytes()) for r, c in zip(found, np.split(cells[order], starts[1:]))]
        return pd.DataFrame(out, columns=["window_size", "rep", "range", "cells"])

    def sort(pdf: pd.DataFrame) -> pd.DataFrame:
        w, rep, r = (int(pdf[c].iloc[0]) for c in ("window_size", "rep", "range"))
        y = np.ascontiguousarray(_by_digest(np.frombuffer(b"".join(pdf["cells"]), _DEALT), f"q:{rep}:{w}")["y"])
        at, end, out = int(below[f"{w}:{rep}"][r]), int(below[f"{w}:{rep}"][r]) + len(y), []
        first = at
        while at < end:
            to = min(end, (at // PLACES + 1) * PLACES)
            out.append((w, at // PLACES, rep, at % PLACES, y[at - first : to - first].tobytes()))
            at = to
        return pd.DataFrame(out, columns=["window_size", "block", "rep", "at", "ys"])

    def give(mine: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        mine = mine.sort_values("_i")
        ys = np.empty((len(mine), 1 + reps))
        ys[:, 0] = mine["y"]
        for rep, at, part in zip(given["rep"], given["at"], given["ys"]):
            y = np.frombuffer(part)
            ys[at : at + len(y), 1 + rep] = y
        return mine[["window_size", "unit"]].assign(ys=list(ys))

    tasks = min(2 * sum(ranges.values()) * -(-SORTED // PLACES), 512) or 1
    blocks = placed.repartition(tasks, "window_size", "block").groupBy("window_size", "block")
    sorted_ = blocks.applyInPandas(deal, "window_size int, rep int, range int, cells binary").groupBy("window_size", "rep", "range")
    parts = sorted_.applyInPandas(sort, "window_size int, block int, rep int, at int, ys binary").groupBy("window_size", "block")
    given = placed.groupBy("window_size", "block").cogroup(parts).applyInPandas(give, "window_size int, unit int, ys array<double>")
    return units.join(given, ["window_size", "unit"])


def _paths(m: np.ndarray, d: int, alphas: np.ndarray) -> np.ndarray:
    """Coefficients (penalty, intercept and features, target) from the moments of (1, features) with (1, features, targets)."""
    n, mean = m[0, 0], m[0] / m[0, 0]
    spread = m[1:] - n * np.outer(mean[1 : d + 1], mean)
    sd = np.sqrt(np.maximum(np.diag(spread[:, 1 : d + 1]) / n, 0))
    # what rounding leaves of a feature that is constant here, such as the flag of a stretch that is left out, is no spread
    live = sd > np.maximum(1e-12, 1e-6 * np.sqrt(np.diag(m[1:, 1 : d + 1]) / n))
    scale = np.where(live, sd, np.inf)
    lam, v = np.linalg.eigh(spread[:, 1 : d + 1] / np.outer(scale, scale))
    turned = v.T @ (spread[:, d + 1 :] / scale[:, None])
    w = np.stack([v @ (turned / (np.maximum(lam, 0) + a)[:, None]) for a in alphas]) / scale[:, None]
    return np.concatenate([(mean[d + 1 :] - np.einsum("d,adt->at", mean[1 : d + 1], w))[:, None], w], axis=1)


def _fold_weights(parts: dict[int, tuple[np.ndarray, np.ndarray]], d: int, alphas: np.ndarray) -> dict[int, np.ndarray]:
    """For each fold, coefficients (target, intercept and features) from all others; a target's penalty is that of the least
    error when each of the others is left out in turn. Folds with too few units to learn from have none."""
    out = {}
    for f in parts:
        rest = [g for g in parts if g != f]
        if sum(parts[g][0][0, 0] for g in rest) < LEAST:
            continue
        total = sum(parts[g][0] for g in rest)
        best = np.zeros(total.shape[1] - d - 1, dtype=int)
        if len(rest) > 1:
            errors = 0.0
            for g in rest:
                m, yy = parts[g]
                w = _paths(total - m, d, alphas)
                errors = errors + yy - 2 * (w * m[:, d + 1 :]).sum(1) + np.einsum("adt,de,aet->at", w, m[:, : d + 1], w)
            best = errors.argmin(0)
        out[f] = np.take_along_axis(_paths(total, d, alphas), best[None, None], axis=0)[0].T
    return out


def ridge_ladder(units: DataFrame, alphas: Sequence[float] = ALPHAS) -> DataFrame:
    """Adds ``preds``, out-of-fold predictions of each of ``ys`` by blocks, and ``pred_random``, of the target by random folds.

    ``units``: of `unit_vectors` with folds and ``ys``, stored. A null feature counts as its mean over all units.
    """
    head = units.select(F.size("x").alias("d"), F.size("ys").alias("t")).first()
    if head is None:
        return units.withColumns({"preds": F.lit(None).cast("array<double>"), "pred_random": F.lit(None).cast("double")})
    d, t, a = head["d"], head["t"], np.asarray(alphas, dtype=float)
    means = units.agg(*[F.avg(F.col("x")[i]) for i in range(d)], F.avg("y")).first()
    shift, level = np.array([m or 0.0 for m in means[:d]]), means[d]
    schemes = {"fold_block": t, "fold_random": 1}

    def centred(x: pd.Series) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), np.nan_to_num(np.array([np.asarray(v, dtype=float) for v in x]).reshape(len(x), d) - shift)])

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, np.ndarray]]:
        for batch in batches:
            z = centred(batch["x"])
            y = np.array(batch["ys"].tolist(), dtype=float) - level
            for scheme, n in schemes.items():
                for (w, f), at in batch.groupby(["window_size", scheme]).indices.items():
                    m = z[at].T @ np.column_stack([z[at], y[at, :n]])
                    yield f"{scheme}:{w}:{f}", np.concatenate([m.ravel(), (y[at, :n] ** 2).sum(0)])

    parts: dict[tuple[str, int], dict[int, tuple[np.ndarray, np.ndarray]]] = {}
    for key, flat in summed(units.select("window_size", "x", "ys", *schemes), products).items():
        scheme, w, f = key.split(":")
        n = schemes[scheme]
        parts.setdefault((scheme, int(w)), {})[int(f)] = (flat[:-n].reshape(d + 1, -1), flat[-n:])
    weights = {(scheme, w, f): c for (scheme, w), by_fold in parts.items() for f, c in _fold_weights(by_fold, d, a).items()}

    @F.pandas_udf("preds array<double>, pred_random double")
    def predict(keys: pd.DataFrame, x: pd.Series) -> pd.DataFrame:
        z, out = centred(x), {"preds": np.full(len(x), None, object), "pred_random": np.full(len(x), np.nan)}
        for (scheme, n), (name, made) in zip(schemes.items(), out.items()):
            for (w, f), at in keys.groupby(["window_size", scheme]).indices.items():
                if (scheme, w, f) in weights:
                    p = z[at] @ weights[scheme, w, f].T + level
                    for i, v in zip(at, p if name == "preds" else p[:, 0]):
                        made[i] = v
        return pd.DataFrame({"preds": pd.Series(list(out["preds"]), dtype=object), "pred_random": out["pred_random"]})

    made = predict(F.struct("window_size", *schemes), F.col("x"))
    return units.withColumn("_made", made).withColumns({c: F.col("_made")[c] for c in ("preds", "pred_random")}).drop("_made")


_PAIRS, _RANKED = np.dtype([("y", "<f8"), ("p", "<f8")]), np.dtype([("p", "<f8"), ("r", "<i4")])
#: What a range of targets has of its pairs.
_MOMENTS = ("n", "my", "mp", "yy", "pp", "yp", "y_lo", "y_hi", "p_lo", "p_hi", "r", "rr")


def _twice_ranks(v: np.ndarray) -> np.ndarray:
    """Twice the average ranks, which are whole numbers."""
    _, at, n = np.unique(v, return_inverse=True, return_counts=True)
    return (2 * n.cumsum() - n + 1)[at]


def _correlations(pdf: pd.DataFrame) -> tuple[float | None, float | None]:
    """Spearman's and Pearson's correlation from sums over ranges of targets, and over cells of those with ranges of predictions."""
    mine = pdf["range"] < 0
    m = pd.DataFrame(pdf["sums"][mine].tolist(), columns=_MOMENTS, index=pdf["of"][mine]).sort_index()
    if m["y_lo"].min() == m["y_hi"].max() or m["p_lo"].min() == m["p_hi"].max():
        return None, None
    n = m["n"].sum()
    dy, dp = (m[c] - (m["n"] * m[c]).sum() / n for c in ("my", "mp"))
    total = lambda c, a, b: (m[c] + m["n"] * a * b).sum()
    with np.errstate(invalid="ignore", divide="ignore"):
        r = total("yp", dy, dp) / (np.sqrt(total("yy", dy, dy)) * np.sqrt(total("pp", dp, dp)))
    c = pd.DataFrame(pdf["sums"][~mine].tolist(), columns=["n", "ry", "rp", "both", "rpp"])
    c["range"], c["of"] = pdf["range"][~mine].to_numpy(), pdf["of"][~mine].to_numpy()
    wide = c.groupby("range")["n"].sum().sort_index()
    # what is added to a range's own ranks, from the mean rank
    by, bp = m["n"].cumsum() - m["n"] - (n + 1) / 2, wide.cumsum() - wide - (n + 1) / 2
    yy = (m["rr"] + 2 * by * m["r"] + m["n"] * by * by).sum()
    by, bp = c["of"].map(by), c["range"].map(bp)
    pp = (c["rpp"] + 2 * bp * c["rp"] + c["n"] * bp * bp).sum()
    yp = (c["both"] + by * c["rp"] + bp * c["ry"] + c["n"] * by * bp).sum()
    return tuple(float(v) if np.isfinite(v) else None for v in (yp / np.sqrt(yy * pp), r))


def ladder_correlations(fitted: DataFrame, sizes: Mapping[int, int]) -> DataFrame:
    """``window_size, k, s, r``: rank and plain correlations of each of ``ys`` with its prediction; of ``y`` with ``pred_random`` as -1.

    Pairs go packed to ranges of the target, where they get its ranks, and on to ranges of the prediction; both give sums alone,
    as a range's ranks need not know how many are below it. ``sizes``: units of each width. A width's ranges are cut at
    approximate quantiles; a range holds more where more units are equal.
    """
    t = (fitted.select(F.size("ys")).first() or [1])[0]
    ranges = {w: min(-(-n // SORTED), CUTS) for w, n in sizes.items()}
    shares = [i / CUTS for i in range(1, CUTS)]
    columns = {"y": F.col("y"), -1: F.col("pred_random"), **{k: F.col("preds")[k] for k in range(t)}}
    cuts: dict[int, dict] = {}
    if wide := [w for w, n in ranges.items() if n > 1]:
        # a row a width, of so many numbers
        found = fitted.where(F.col("window_size").isin(wide)).groupBy("window_size").agg(*[F.percentile_approx(c, shares, 1000).alias(str(k)) for k, c in columns.items()])
        for row in found.collect():
            at = [i * CUTS // ranges[row["window_size"]] - 1 for i in range(1, ranges[row["window_size"]])]
            cuts[row["window_size"]] = {k: np.array(row[str(k)])[at] for k in columns if row[str(k)]}

    def split(w: int, k: int | str, v: np.ndarray, cells: np.ndarray) -> Iterator[tuple[int, bytes]]:
        to = np.searchsorted(cuts[w][k], v) if k in cuts.get(w, ()) else np.zeros(len(v), int)
        order = np.argsort(to, kind="stable")
        found, starts = np.unique(to[order], return_index=True)
        return zip(found.tolist(), (c.tobytes() for c in np.split(cells[order], starts[1:])))

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def packed(kept: list[tuple[np.ndarray, ...]]) -> pd.DataFrame:
            widths, ys, preds = (np.concatenate(a) for a in zip(*kept))
            out = []
            for w in np.unique(widths).tolist():
                mine = widths == w
                for i in range(t + 1):
                    y, p = ys[mine, i], preds[mine, i]
                    cells = np.empty(len(y), _PAIRS)
                    cells["y"], cells["p"] = y, p
                    cells = cells[~np.isnan(p)]
                    out += [(w, i - 1, r, c) for r, c in split(w, "y", cells["y"], cells)] if len(cells) else []
            return pd.DataFrame(out, columns=["window_size", "k", "range", "cells"])

        kept, none = [], np.full(t, np.nan)
        for b in batches:
            ys, preds = np.array(b["ys"].tolist(), dtype=float), np.array([none if p is None else p for p in b["preds"]], dtype=float)
            kept.append((b["window_size"].to_numpy(), np.column_stack([b["y"], ys]), np.column_stack([b["pred_random"].to_numpy(float), preds])))
            if sum(len(k[0]) for k in kept) >= SORTED:
                yield packed(kept)
                kept = []
        if kept:
            yield packed(kept)

    def by_target(pdf: pd.DataFrame) -> pd.DataFrame:
        w, k, r = (int(pdf[c].iloc[0]) for c in ("window_size", "k", "range"))
        cells = np.frombuffer(b"".join(pdf["cells"]), _PAIRS)
        y, p, ranks = cells["y"], cells["p"], _twice_ranks(cells["y"])
        dy, dp, half = y - y.mean(), p - p.mean(), ranks / 2
        sums = (len(y), y.mean(), p.mean(), dy @ dy, dp @ dp, dy @ dp, y.min(), y.max(), p.min(), p.max(), half.sum(), half @ half)
        ranked = np.empty(len(y), _RANKED)
        ranked["p"], ranked["r"] = p, ranks
        out = [(w, k, -1, r, None, np.array(sums)), *[(w, k, to, r, c, None) for to, c in split(w, k, p, ranked)]]
        return pd.DataFrame(out, columns=["window_size", "k", "range", "of", "cells", "sums"])

    def by_prediction(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["range"].iloc[0] >= 0:
            parts = [np.frombuffer(c, _RANKED) for c in pdf["cells"]]
            ends = np.cumsum([len(c) for c in parts])
            rp = _twice_ranks(np.concatenate([c["p"] for c in parts])) / 2
            pdf["sums"] = [np.array([len(c), ry.sum(), r.sum(), r @ ry, r @ r]) for c, r in zip(parts, np.split(rp, ends[:-1])) for ry in [c["r"] / 2]]
        return pdf[["window_size", "k", "range", "of", "sums"]]

    def correlate(pdf: pd.DataFrame) -> pd.DataFrame:
        s, r = _correlations(pdf)
        return pdf[["window_size", "k"]].iloc[:1].assign(s=s, r=r)

    long = fitted.select("window_size", "y", "ys", "preds", "pred_random").mapInPandas(pairs, "window_size int, k int, range int, cells binary")
    ranked = long.groupBy("window_size", "k", "range").applyInPandas(by_target, "window_size int, k int, range int, of int, cells binary, sums array<double>")
    sums = ranked.groupBy("window_size", "k", "range").applyInPandas(by_prediction, "window_size int, k int, range int, of int, sums array<double>")
    return sums.groupBy("window_size", "k").applyInPandas(correlate, "window_size int, k int, s double, r double")


def ladder_metrics(fitted: DataFrame) -> DataFrame:
    """A row for each width: correlations of targets and predictions, their null over shuffled targets, and those of random folds."""
    n = fitted.groupBy("window_size").agg(F.count("*").alias("n_units"), F.avg("n").alias("mean_rows_a_unit"))
    r = ladder_correlations(fitted, {x["window_size"]: x["n_units"] for x in n.collect()})  # one row a width
    at = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    null = F.when(F.col("k") > 0, F.col("s"))
    r = r.groupBy("window_size").agg(
        at(0, "s").alias("spearman"), at(0, "r").alias("pearson"), F.avg(null).alias("null_mean"), F.stddev_samp(null).alias("null_sd"), at(-1, "s").alias("spearman_random_units")
    )
    out = n.join(r, "window_size", "left").withColumn("above_null", F.col("spearman") - F.col("null_mean"))
    return out.withColumn("interpretable", F.col("n_units") >= READABLE)


def with_ceiling(metrics: DataFrame, reliability: DataFrame) -> DataFrame:
    """Adds the reliability of each width, its root as the ceiling of a correlation, and what is left to it."""
    ceiling = F.when(F.col("reliability") > 0, F.sqrt("reliability"))
    return metrics.join(F.broadcast(reliability), "window_size", "left").withColumns({"ceiling": ceiling, "headroom": ceiling - F.col("pearson")})


def paired_unit_draws(units: DataFrame, y: str, a: str, b: str, reps: int = DRAWS, cluster: str = "unit", seed: int | str = 1) -> np.ndarray:
    """Differences of the correlations of ``y`` with ``a`` and with ``b``, over draws of units with replacement; NaN where one is constant.

    A unit carries how often each draw takes it; weighted sums of nine products give all draws in one pass.
    """
    rows = units.select(cluster, *[F.col(c).cast("double").alias(f"_{n}") for n, c in (("y", y), ("a", a), ("b", b))]).dropna()
    m = rows.agg(F.avg("_y"), F.avg("_a"), F.avg("_b")).first()
    if m[0] is None:
        return np.zeros(0)
    shift = np.array(m, dtype=float)

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, np.ndarray]]:
        for batch in batches:
            y, a, b = (batch[["_y", "_a", "_b"]].to_numpy(float) - shift).T
            taken = np.frombuffer(b"".join(batch["_w"]), np.uint16).reshape(len(batch), -1).astype(float)
            yield "all", (taken.T @ np.column_stack([np.ones(len(y)), y, a, b, y * y, a * a, b * b, y * a, y * b])).ravel()

    return _differences(summed(rows.join(draw_arrays(rows, cluster, reps, seed), cluster), products)["all"].reshape(reps, 9))


def _differences(sums: np.ndarray) -> np.ndarray:
    """A draw's correlation of y and a, less that of y and b, from its weighted sums of 1, y, a, b, yy, aa, bb, ya, yb."""
    n, sy, sa, sb, yy, aa, bb, ya, yb = sums.T
    with np.errstate(invalid="ignore", divide="ignore"):
        spread = lambda q, s: np.where(n * q - s * s > 1e-12 * np.maximum(n * q, 1e-300), n * q - s * s, np.nan)
        r = lambda p, q, s: (n * p - sy * s) / np.sqrt(spread(yy, sy) * spread(q, s))
        return r(ya, aa, sa) - r(yb, bb, sb)


def window_unit_draws(units: DataFrame, y: str, a: str, b: str, reps: int = DRAWS, seed: int = 1) -> dict[int, np.ndarray]:
    """`paired_unit_draws` of the units of each width, by the same picks, for all widths at once.

    A draw's picks are made where its sums are, so no picks or weights are moved: units go packed to at most `GROUPS` groups of
    draws, in strips of a bounded number of units.
    """
    columns = [F.col(c).cast("double").alias(f"_{n}") for n, c in (("y", y), ("a", a), ("b", b))]
    rows = stored(units.select("window_size", "unit", *columns).dropna(), "pairs")
    # a row a width
    widths = {r["window_size"]: (r["n"], np.array(r[2:])) for r in rows.groupBy("window_size").agg(F.count("*").alias("n"), F.avg("_y"), F.avg("_a"), F.avg("_b")).collect()}
    if not widths:
        return {}
    groups = {w: min(GROUPS, reps, -(-n * reps // GROUP_PICKS)) for w, (n, _) in widths.items()}
    place = value_ranks(rows, "unit", ["window_size"], "i").select("window_size", "unit", (F.col("i_min") - 1).alias("_i"))
    placed = rows.join(place, ["window_size", "unit"]).withColumns({"block": F.expr(f"_i div {PLACES}"), "strip": F.expr(f"_i div {STRIP}")})

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        cells = pdf[["_y", "_a", "_b"]].to_numpy(float) - widths[int(pdf["window_size"].iloc[0])][1]
        return pdf[["window_size", "strip", "block"]].iloc[:1].assign(cells=cells.tobytes())

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        w, g = int(pdf["window_size"].iloc[0]), int(pdf["g"].iloc[0])
        n, sums = widths[w][0], np.zeros((reps, 9))
        first, mine = _first_mix(n, seed), np.arange(g, reps, groups[w])
        blocks = [(int(i) * PLACES, np.frombuffer(c).reshape(-1, 3).T) for i, c in zip(pdf["block"], pdf["cells"])]
        for at in range(0, len(mine), 16):
            some = mine[at : at + 16]
            taken = [_taken(first, int(d), n) for d in some]
            for start, (y, a, b) in blocks:
                weights = np.stack([t[start : start + len(y)] for t in taken]).astype(float)
                sums[some] += weights @ np.column_stack([np.ones(len(y)), y, a, b, y * y, a * a, b * b, y * a, y * b])
        return pd.DataFrame({"window_size": [w], "sums": [sums.tobytes()]})

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, np.ndarray]]:
        for batch in batches:
            for w, s in zip(batch["window_size"], batch["sums"]):
                yield str(w), np.frombuffer(s)

    packed = placed.groupBy("window_size", "strip", "block").applyInPandas(pack, "window_size int, strip long, block long, cells binary")
    # at most GROUPS rows a width
    dealt = packed.join(F.broadcast(units.sparkSession.createDataFrame([(w, g) for w, n in groups.items() for g in range(n)], "window_size int, g int")), "window_size")
    made = dealt.repartition(4 * sum(groups.values()), "window_size", "strip", "g").groupBy("window_size", "strip", "g").applyInPandas(draw, "window_size int, sums binary")
    return {int(w): _differences(s.reshape(reps, 9)) for w, s in summed(made, each).items()}


def interval(draws: np.ndarray, alpha: float = 0.05) -> tuple[int, float | None, float | None, float | None]:
    """Draws that have a value, the percentile interval and the two-sided share of chance."""
    d = draws[np.isfinite(draws)]
    if not len(d):
        return 0, None, None, None
    lo, hi = np.quantile(d, [alpha / 2, 1 - alpha / 2])
    return len(d), float(lo), float(hi), float(min(2 * min((d <= 0).mean(), (d >= 0).mean()), 1.0))

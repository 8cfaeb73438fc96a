"""Features of each position from the atoms of a structure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import stored
from .geometry import accessible_areas, contact_counts, nearest_distance

# The one-letter codes of residues; the largest area of a residue in square angstroms (Tien and others,
# 2013, theoretical values); van der Waals radii in angstroms (Bondi).
LETTER = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
}
LARGEST_AREA = {
    "A": 129.0, "R": 274.0, "N": 195.0, "D": 193.0, "C": 167.0, "Q": 225.0, "E": 223.0, "G": 104.0, "H": 224.0, "I": 197.0,
    "L": 201.0, "K": 236.0, "M": 224.0, "F": 240.0, "P": 159.0, "S": 155.0, "T": 172.0, "W": 285.0, "Y": 263.0, "V": 174.0,
}
RADII = {"H": 1.2, "C": 1.7, "N": 1.55, "O": 1.52, "P": 1.8, "S": 1.8}
WINDOWS = (5, 11, 25)


def looked_up(table: dict[str, str | float], key: str) -> Column:
    """The entry of a fixed table for column ``key``; null where it has none."""
    return F.element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), F.col(key))


def position_features(
    atoms: DataFrame, reference: DataFrame, chain: str, partners: Sequence[str], centres: dict[str, Sequence[int]], probe: float = 1.4
) -> DataFrame:
    """One row for each ``file, pos`` of ``reference(file, pos, ref)``, with measures of ``chain`` beside ``partners``.

    ``area`` alone, ``rel_area`` (of the reference symbol's largest), ``d_area`` that the partners hide, ``interface``
    (more than 1), ``n8, n12`` contacts of representative atoms (CB, else CA), ``min_dist`` to a partner's atom,
    ``dist_<centre>`` from CA to the mean CA of the centre's positions, ``dist_centroid``, ``b`` and ``has_coords``.
    Positions that are not modelled, or have no such atom, hold nulls; elements without a radius count as carbon.
    """
    sized = atoms.where("not hetero").withColumn("radius", F.coalesce(looked_up(RADII, "element"), F.lit(RADII["C"])))
    sized = stored(sized.where(F.col("chain").isin(chain, *partners)), "atoms")
    own = sized.where((F.col("chain") == chain) & F.col("residue").isin(list(LETTER)))
    other = sized.where(F.col("chain") != chain)
    # own atoms, beside one another and in the whole complex
    areas = accessible_areas(own, sized, {"_alone": (F.col("chain") == chain) & F.col("residue").isin(list(LETTER)), "_bound": F.lit(True)}, probe, by=["file"])
    near = nearest_distance(own, other, "atom_id", ["file"], 8.0)
    each = own.join(areas, ["file", "atom_id"]).join(near, ["file", "atom_id"])
    place = F.struct("x", "y", "z")
    rows = each.groupBy("file", "pos").agg(
        F.sum("_alone").alias("area"),
        (F.sum("_alone") - F.sum("_bound")).alias("d_area"),
        F.min("distance").alias("min_dist"),
        F.avg("b").alias("b"),
        F.max(F.when(F.col("atom") == "CA", place)).alias("_ca"),
        F.coalesce(F.max(F.when(F.col("atom") == "CB", place)), F.max(F.when(F.col("atom") == "CA", place))).alias("_rep"),
    )
    rows = stored(rows, "positions")
    reps = rows.where("_rep is not null").select("file", "pos", "_rep.*")
    mean = lambda c, when: F.struct(*[F.avg(F.when(when, F.col(f"{c}.{a}"))).alias(a) for a in "xyz"])
    spots = rows.groupBy("file").agg(
        mean("_rep", F.lit(True)).alias("_centroid"), *[mean("_ca", F.col("pos").isin(list(p))).alias(f"_{n}") for n, p in centres.items()]
    )
    out = reference.join(rows, ["file", "pos"], "left").join(contact_counts(reps, "pos", {"n8": 8.0, "n12": 12.0}, by=["file"]), ["file", "pos"], "left")
    out = out.join(spots, "file", "left")
    away = lambda a, b: F.sqrt(sum((F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) * (F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) for c in "xyz"))
    return out.select(
        "file",
        "pos",
        (F.col("area") / looked_up(LARGEST_AREA, "ref")).alias("rel_area"),
        "area",
        "d_area",
        (F.col("d_area") > 1.0).cast("double").alias("interface"),
        "n8",
        "n12",
        "min_dist",
        *[away("_ca", f"_{n}").alias(f"dist_{n}") for n in centres],
        away("_rep", "_centroid").alias("dist_centroid"),
        "b",
        F.col("area").isNotNull().cast("int").alias("has_coords"),
    )


def with_windows(features: DataFrame, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """Centred rolling means of every feature; positions without coordinates are skipped. One structure's axis is one window group."""
    base = [c for c in features.columns if c not in ("file", "pos", "has_coords")]
    axis = Window.partitionBy("file").orderBy("pos")
    return features.select("*", *[F.avg(c).over(axis.rowsBetween(-(w // 2), w // 2)).alias(f"{c}_w{w}") for w in windows for c in base])


def reference_check(atoms: DataFrame, reference: DataFrame, chain: str) -> DataFrame:
    """For each file: modelled positions and their share, those with another symbol than ``ref``, runs that are missing.

    Lists of positions are text; an axis is as long as one sequence.
    """
    seen = atoms.where((F.col("chain") == chain) & ~F.col("hetero") & F.col("residue").isin(list(LETTER)))
    seen = seen.groupBy("file", "pos").agg(F.max(looked_up(LETTER, "residue")).alias("_s"))
    rows = reference.join(seen, ["file", "pos"], "left")
    order = Window.partitionBy("file", F.col("_s").isNull()).orderBy("pos")
    other = F.col("_s") != F.col("ref")
    joined = lambda c: F.array_join(F.transform(F.array_sort(c), lambda p: p.cast("string")), ",")
    counts = rows.groupBy("file").agg(
        F.count("_s").alias("n_modelled"),
        (F.count("_s") / F.count("*")).alias("coverage"),
        F.count_if(other).alias("n_mismatch"),
        joined(F.collect_list(F.when(other, F.col("pos")))).alias("mismatches"),
    )
    gaps = rows.withColumn("_g", F.col("pos") - F.row_number().over(order)).where("_s is null")
    runs = gaps.groupBy("file", "_g").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi")).groupBy("file").agg(
        F.count("*").alias("n_runs"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lo", "hi"))), lambda r: F.concat_ws("-", r["lo"].cast("string"), r["hi"].cast("string"))), ",").alias("missing"),
    )
    return counts.join(runs, "file", "left").fillna(0, ["n_runs"]).fillna("", ["missing"])

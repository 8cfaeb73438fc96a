"""Structure measures over atoms that the parts stand for: text lines, atoms, features of each position, their windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.structure import LARGEST_AREA, LETTER, RADII, WINDOWS, position_features, reference_check, with_windows
from ..sources.assay import draw, table
from ..sources.text import LETTERS, parse_atoms
from .registry import query

#: Positions of one structure, and atoms of one position.
LENGTH, ATOMS = 400, ["N", "CA", "CB", "O"]
CENTRES = {"core": [10, 21, 33], "rim": [38, 47]}


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    # a part is a few bytes, its line costs much more: small files would leave the lines to few tasks
    return table(spark, sf_dir, "part").select("p_partkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey").select(
        (p / (LENGTH * 4)).cast("long").cast("string").alias("file"), (p % (LENGTH * 4) / 4 + 1).cast("int").alias("pos"), (p % 4).cast("int").alias("a"), p.alias("id")
    )


def structure_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file, value``: a fixed-width line of each atom; some residues, atoms and chains are missing or of other kinds."""
    rows = _keyed(spark, sf_dir).where("NOT (pos % 11 = 3 OR (a = 2 AND pos % 4 = 1) OR (a = 1 AND pos % 17 = 2))")
    partner = F.col("pos") % 5 == 0
    kinds = F.array(*[F.lit(k) for k in sorted(LETTER, key=LETTER.get)])
    kind = F.get(kinds, F.when(F.col("pos") % 50 == 7, 0).otherwise(F.col("pos") % 20))
    cell = [F.col("pos") % 8, F.floor(F.col("pos") / 8) % 8, F.floor(F.col("pos") / 64)]
    xyz = [(3800 * c + draw(n, F.col("id")) % 3000) / 1000.0 for n, c in zip("xyz", cell)]
    line = F.format_string(
        "%-6s%5d  %-3s %3s %1s%4d    %8.3f%8.3f%8.3f%6.2f%6.2f          %2s",
        F.when(F.col("pos") % 13 == 6, "HETATM").otherwise("ATOM"),
        (F.col("id") % (LENGTH * 4)).cast("long"),
        F.get(F.array(*[F.lit(a) for a in ATOMS]), F.col("a")),
        F.when(partner, "DA").otherwise(kind),
        F.when(partner, "A").otherwise("B"),
        "pos",
        *[c.cast("double") for c in xyz],
        F.lit(1.0),
        (F.col("id") % 90 + 10.0).cast("double"),
        F.substring(F.get(F.array(*[F.lit(a) for a in ATOMS]), F.col("a")), 1, 1),
    )
    # an exploded line is made once; else each filter on it would make it anew, before rows are dealt to tasks
    return rows.select("file", F.explode(F.array(line)).alias("value"))


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file, pos, ref``: every position of every structure."""
    files = _keyed(spark, sf_dir).select("file").distinct()
    return files.withColumn("pos", F.explode(F.sequence(F.lit(1), F.lit(LENGTH)))).withColumn("ref", F.substring(F.lit(LETTERS), 1 + F.col("pos") % 20, F.lit(1)))


_CASE = lambda key, t, other: f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in t.items()) + f" {other} END"
_DRAW = lambda n: f"('0x' || substr(md5('{n}:' || id), 1, 8))::BIGINT % 3000"
_ATOMS = f"""raw AS (SELECT CAST(p_partkey // {LENGTH * 4} AS VARCHAR) AS file, CAST(p_partkey % {LENGTH * 4} // 4 + 1 AS INTEGER) AS pos,
  CAST(p_partkey % 4 AS INTEGER) AS a, p_partkey AS id FROM part),
atoms AS (SELECT file, pos, id % {LENGTH * 4} AS atom_id, ['N', 'CA', 'CB', 'O'][a + 1] AS atom, pos % 13 = 6 AS hetero, CASE WHEN pos % 5 = 0 THEN 'A' ELSE 'B' END AS chain,
  (3800 * (pos % 8) + {_DRAW('x')}) / 1000.0::DOUBLE AS x, (3800 * (pos // 8 % 8) + {_DRAW('y')}) / 1000.0::DOUBLE AS y,
  (3800 * (pos // 64) + {_DRAW('z')}) / 1000.0::DOUBLE AS z, CAST(id % 90 + 10 AS DOUBLE) AS b
  FROM raw WHERE NOT (pos % 11 = 3 OR (a = 2 AND pos % 4 = 1) OR (a = 1 AND pos % 17 = 2)))"""
_CENTRES = ", ".join(f"avg(ca[{i}]) FILTER (pos IN ({', '.join(map(str, p))})) AS {n}{i}" for n, p in CENTRES.items() for i in (1, 2, 3))
_AWAY = lambda a, n: f"sqrt(({a}[1] - {n}1) ** 2 + ({a}[2] - {n}2) ** 2 + ({a}[3] - {n}3) ** 2)"
# By brute force: every atom, dot and neighbour.
_FEATURES = f"""{_ATOMS},
s AS MATERIALIZED (SELECT *, 1.4::DOUBLE + {_CASE('atom[1]', RADII, 'ELSE 1.7')} AS r FROM atoms WHERE NOT hetero),
dots AS MATERIALIZED (SELECT k, cos(t) * rr AS dx, sin(t) * rr AS dy, dz FROM (SELECT k, dz, sqrt(1 - dz * dz) AS rr, k * pi() * (3 - sqrt(5::DOUBLE)) AS t FROM (SELECT k, 1 - (2 * k + 1) / 100::DOUBLE AS dz FROM range(0, 100) q(k)))),
near AS MATERIALIZED (SELECT p.file, p.atom_id, p.x, p.y, p.z, p.r, q.x AS qx, q.y AS qy, q.z AS qz, q.r AS qr, q.chain = 'B' AS own FROM s p JOIN s q ON p.file = q.file AND p.atom_id <> q.atom_id
  AND (p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2 < (p.r + q.r) ** 2 WHERE p.chain = 'B'),
hid AS (SELECT file, atom_id, count(DISTINCT k) FILTER (own) AS h_own, count(DISTINCT k) AS h_all FROM near, dots
  WHERE (x + r * dx - qx) ** 2 + (y + r * dy - qy) ** 2 + (z + r * dz - qz) ** 2 < qr ** 2 GROUP BY ALL),
md AS (SELECT p.file, p.atom_id, min(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2)) AS d FROM s p JOIN s q ON p.file = q.file AND q.chain = 'A' WHERE p.chain = 'B' GROUP BY ALL),
rs AS MATERIALIZED (SELECT file, pos, sum(4 * pi() * r * r * (100 - coalesce(h_own, 0)) / 100) AS area, sum(4 * pi() * r * r * (100 - coalesce(h_all, 0)) / 100) AS bound, min(d) AS min_dist, avg(b) AS b,
  max([x, y, z]) FILTER (atom = 'CA') AS ca, coalesce(max([x, y, z]) FILTER (atom = 'CB'), max([x, y, z]) FILTER (atom = 'CA')) AS rep
  FROM s LEFT JOIN hid USING (file, atom_id) LEFT JOIN md USING (file, atom_id) WHERE chain = 'B' GROUP BY file, pos),
cn AS (SELECT p.file, p.pos, count(*) FILTER (d > 0 AND d < 8) AS n8, count(*) FILTER (d > 0 AND d < 12) AS n12 FROM (SELECT a.file, a.pos, sqrt((a.rep[1] - c.rep[1]) ** 2 + (a.rep[2] - c.rep[2]) ** 2 + (a.rep[3] - c.rep[3]) ** 2) AS d
  FROM rs a JOIN rs c USING (file) WHERE a.rep IS NOT NULL AND c.rep IS NOT NULL) p GROUP BY ALL),
sp AS (SELECT file, avg(rep[1]) AS mid1, avg(rep[2]) AS mid2, avg(rep[3]) AS mid3, {_CENTRES} FROM rs GROUP BY file),
ref AS (SELECT file, CAST(i AS INTEGER) AS pos, substr('{LETTERS}', CAST(1 + i % 20 AS INTEGER), 1) AS ref FROM (SELECT DISTINCT file FROM raw), range(1, {LENGTH + 1}) t(i)),
ft AS MATERIALIZED (SELECT file, pos, area / {_CASE('ref', LARGEST_AREA, '')} AS rel_area, area, area - bound AS d_area, CAST(area - bound > 1.0 AS DOUBLE) AS interface, n8, n12, min_dist,
  {', '.join(f'{_AWAY("ca", n)} AS dist_{n}' for n in CENTRES)}, {_AWAY('rep', 'mid')} AS dist_centroid, b, CAST(area IS NOT NULL AS INTEGER) AS has_coords
  FROM ref LEFT JOIN rs USING (file, pos) LEFT JOIN cn USING (file, pos) LEFT JOIN sp USING (file))"""
_BASE = ["rel_area", "area", "d_area", "interface", "n8", "n12", "min_dist", *[f"dist_{n}" for n in CENTRES], "dist_centroid", "b"]
_ROLLED = ", ".join(f"avg({c}) OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN {w // 2} PRECEDING AND {w // 2} FOLLOWING) AS {c}_w{w}" for w in WINDOWS for c in _BASE)


@query(f"WITH {_ATOMS} SELECT * FROM atoms")
def scan_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms read from fixed-width lines."""
    return parse_atoms(structure_lines(spark, sf_dir)).select("file", "pos", "atom_id", "atom", "hetero", "chain", "x", "y", "z", "b")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    atoms = parse_atoms(structure_lines(spark, sf_dir))
    return position_features(atoms, reference(spark, sf_dir), "B", ["A"], CENTRES)


@query(f"WITH {_FEATURES} SELECT * FROM ft")
def geom_position_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas, contacts, distances and attributes of every position; nulls where it is not modelled."""
    return features(spark, sf_dir)


@query(f"WITH {_FEATURES} SELECT *, {_ROLLED} FROM ft")
def geom_structure_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features and their centred means."""
    return with_windows(features(spark, sf_dir))


_REPORT = f"""present AS (SELECT DISTINCT file, pos FROM atoms WHERE chain = 'B' AND NOT hetero),
ref AS (SELECT file, CAST(i AS INTEGER) AS pos FROM (SELECT DISTINCT file FROM raw), range(1, {LENGTH + 1}) t(i)),
miss AS (SELECT file, pos, pos - row_number() OVER (PARTITION BY file ORDER BY pos) AS g FROM ref ANTI JOIN present USING (file, pos)),
runs AS (SELECT file, min(pos) AS lo, max(pos) AS hi FROM miss GROUP BY file, g),
r AS (SELECT file, count(*) AS n_runs, string_agg(lo || '-' || hi, ',' ORDER BY lo) AS missing FROM runs GROUP BY file),
c AS (SELECT file, count(*) AS n_modelled, count(*) / {LENGTH}::DOUBLE AS coverage, count(*) FILTER (pos % 50 = 7) AS n_mismatch,
  string_agg(pos::VARCHAR, ',' ORDER BY pos) FILTER (pos % 50 = 7) AS mismatches FROM present GROUP BY file)"""


@query(f"WITH {_ATOMS}, {_REPORT} SELECT file, n_modelled, coverage, n_mismatch, coalesce(mismatches, '') AS mismatches, n_runs, missing FROM c JOIN r USING (file)")
def geom_reference_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far structures agree with their references: modelled positions, other symbols, runs without coordinates."""
    atoms = parse_atoms(structure_lines(spark, sf_dir))
    return reference_check(atoms, reference(spark, sf_dir), "B").select("file", "n_modelled", "coverage", "n_mismatch", "mismatches", "n_runs", "missing")

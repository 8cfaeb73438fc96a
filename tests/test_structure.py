"""Structure files, distances in a grid, optional sources, and models of units."""

import numpy as np
import pytest

from tessera.operators.geometry import accessible_area, nearest_distance, sphere
from tessera.plans.units import linear_out_of_fold
from tessera.sources import shared, text


def _atom(serial, atom, alt, residue, chain, pos, icode, x, occupancy, kind="ATOM"):
    return f"{kind:<6}{serial:5d}  {atom:<3}{alt}{residue:>3} {chain}{pos:4d}{icode}   {x:8.3f}{0:8.3f}{-1.5:8.3f}{occupancy:6.2f}{20:6.2f}          {atom[0]:>2}"


def test_first_model_best_place_no_inserted_residue(spark, tmp_path):
    lines = [
        "HEADER    TEST",
        "MODEL        1",
        _atom(1, "N", " ", "GLY", "B", 1, " ", 1.25, 1.0),
        _atom(2, "CA", "A", "GLY", "B", 1, " ", 2.0, 0.4),
        _atom(3, "CA", "B", "GLY", "B", 1, " ", 3.0, 0.6),
        _atom(4, "CA", " ", "ALA", "B", 1, "A", 9.0, 1.0),
        _atom(5, "O", " ", "HOH", "B", 9, " ", 4.0, 1.0, "HETATM"),
        "ENDMDL",
        "MODEL        2",
        _atom(6, "N", " ", "TRP", "B", 2, " ", 5.0, 1.0),
        "ENDMDL",
    ]
    (tmp_path / "a.pdb").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.pdb").write_text(_atom(1, "N", " ", "ALA", "A", -3, " ", -0.5, 1.0))
    got = text.parse_atoms(text.read_structures(spark, str(tmp_path))).collect()
    rows = {(r.file[-5:], r.atom_id): r for r in got}
    assert set(rows) == {("a.pdb", 1), ("a.pdb", 3), ("a.pdb", 5), ("b.pdb", 1)}
    assert rows["a.pdb", 5].hetero and rows["a.pdb", 3].x == 3.0 and rows["a.pdb", 1].z == -1.5
    assert rows["b.pdb", 1].pos == -3 and rows["b.pdb", 1].element == "N"


def test_nearest_far_near_and_none(spark):
    rng = np.random.default_rng(3)
    schema = "g string, k long, x double, y double, z double"
    points = [("a", i, *map(float, p)) for i, p in enumerate(rng.uniform(0, 300, (60, 3)))] + [("b", 99, 0.0, 0.0, 0.0)]
    others = [("a", i, *map(float, p)) for i, p in enumerate(rng.uniform(0, 40, (30, 3)))]
    got = nearest_distance(spark.createDataFrame(points, schema), spark.createDataFrame(others, schema), "k", ["g"], 5.0).collect()
    assert len(got) == len(points)
    at = np.array([o[2:] for o in others])
    for r in got:
        want = None if r.g == "b" else np.linalg.norm(at - np.array(points[r.k][2:]), axis=1).min()
        assert r.distance == (want if want is None else pytest.approx(want))
    empty = spark.createDataFrame([], schema)
    assert nearest_distance(empty, empty, "k", ["g"], 5.0).count() == 0


def test_area_against_dots_and_neighbours(spark):
    rng = np.random.default_rng(5)
    xyz, radius = rng.uniform(0, 7, (40, 3)), rng.choice([1.2, 1.7], 40)
    rows = [("a", i, *map(float, p), float(r)) for i, (p, r) in enumerate(zip(xyz, radius))] + [("b", 0, 0.0, 0.0, 0.0, 1.7)]
    atoms = spark.createDataFrame(rows, "chain string, atom_id long, x double, y double, z double, radius double")
    got = {(r.chain, r.atom_id): r.area for r in accessible_area(atoms, n=130).collect()}
    for i in range(40):
        r = radius + 1.4
        dots = xyz[i] + sphere(130) * r[i]
        hidden = (np.linalg.norm(dots[:, None] - xyz[None], axis=2) < r)[:, np.arange(40) != i].any(axis=1)
        assert got["a", i] == pytest.approx(4 * np.pi * r[i] ** 2 * (~hidden).mean())
    assert got["b", 0] == pytest.approx(4 * np.pi * 3.1**2) and len(got) == 41


def test_optional_and_made_once(spark, tmp_path):
    path, calls = str(tmp_path / "t"), []
    assert text.read_optional(spark, path) is None
    make = lambda: calls.append(1) or spark.range(3)
    assert shared.loaded_or_made(spark, path, make).count() == shared.loaded_or_made(spark, path, make).count() == 3
    assert len(calls) == 1 and text.read_optional(spark, path).count() == 3
    spark.conf.set("tessera.skip.t", "1")
    assert text.read_optional(spark, path, "tessera.skip.t") is None
    spark.conf.unset("tessera.skip.t")


def test_line_needs_five_units_and_some_variance(spark):
    rows = [("few", f, float(f), 2.0 * f) for f in range(5)] + [("line", f % 3, float(f), 2.0 * f + 1) for f in range(12)]
    rows += [("flat", f % 3, 1.0, float(f)) for f in range(12)]
    got = linear_out_of_fold(spark.createDataFrame(rows, "by string, fold int, x double, y double"), "x", "y", "fold", "by").collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.pred is None) == (r.by != "line") and (r.pred is None or r.pred == pytest.approx(r.y))


def test_areas_beside_two_sets_of_neighbours_from_one_test_of_dots(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tessera.operators import geometry

    rng = np.random.default_rng(8)
    rows = [("f", i, "AB"[i % 2], *map(float, rng.uniform(0, 8, 3)), float(rng.choice([1.2, 1.7]))) for i in range(60)]
    atoms = spark.createDataFrame(rows, "file string, atom_id long, chain string, x double, y double, z double, radius double")
    own, tested, make = atoms.where("chain = 'B'"), [], geometry._hidden_dots
    monkeypatch.setattr(geometry, "_hidden_dots", lambda n: tested.append(n) or make(n))
    got = geometry.accessible_areas(own, atoms, {"alone": F.col("chain") == "B", "bound": F.lit(True)}, by=["file"])
    assert tested == [100] and {r.atom_id: r.alone for r in got.collect()} == {r.atom_id: r.area for r in accessible_area(own, by=["file"]).collect()}
    whole = {r.atom_id: r.area for r in accessible_area(atoms, by=["file"]).collect()}
    assert all(r.bound == whole[r.atom_id] <= r.alone for r in got.collect()) and any(r.bound < r.alone for r in got.collect())

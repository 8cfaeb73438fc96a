"""A Merkle tree over the documents of each language, and over the languages.

Leaves are numbered by row within their language, and a level's nodes are grouped by their number divided by the
fanout; sorted arrays of children are hashed into parents, level by level, until one node is left of each language, its
subroot, and then of all subroots, the root. A level is a written table of half the rows of the one below. Proofs come
down the levels: each join hands a parent's siblings to its children, who add their own, so all joins together move
twice the leaves.

Edge cases: null fields are marked as such in a leaf; null languages are a language of their own, null ids come first
in it; rows that repeat an id are leaves of their own in the order of their digests; the one language of a table is its
own root; an empty table has no row and no root. Further columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, range_sorted, remainder, written

FANOUT = 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels whose joins one job runs on the way down.
STRIDE = 8

_PROOF = "array<struct<l: binary, r: binary>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**changed: Column) -> Column:
    """The digest of a row's fields, each with its length; ``changed`` stands for columns of the same name."""
    return digest(*[_field(changed.get(c, F.col(c))) for c in FIELDS])


def _depth(nodes: int, fanout: int) -> int:
    """Levels above so many nodes."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // fanout), levels + 1
    return levels


def _levels(nodes: DataFrame, total: int, depth: int, fanout: int) -> list[DataFrame]:
    """Tables of the levels above ``nodes(_g, _i, _n, _h, _x)``: nodes with their children ``_c`` in order.

    ``_g`` is a node's group, ``_i`` its number there, ``_n`` the group's nodes on that level, ``_h`` its digest; groups
    with one node have no level above. ``_x``, what a leaf carries along, stays with the lowest level.
    """
    levels: list[DataFrame] = []
    for _ in range(depth):
        child = F.struct("_i", "_h", *(["_x"] if not levels else []))
        parents = nodes.where("_n > 1").groupBy("_g", F.expr(f"_i div {fanout}").alias("_j"))
        parents = parents.agg(F.array_sort(F.collect_list(child)).alias("_c"), F.max("_n").alias("_n"))
        total = -(-total // fanout)
        parents = parents.select(
            "_g", F.col("_j").alias("_i"), F.ceil(F.col("_n") / fanout).alias("_n"), digest(F.array_join("_c._h", "")).alias("_h"), "_c"
        )
        levels.append(written(parents, "level", total))
        nodes = levels[-1]
    return levels


def _down(levels: list[DataFrame], tops: DataFrame, keep: list[str]) -> DataFrame:
    """``_g, _i, _h, _x, _proof`` and ``keep`` of all lowest nodes below ``tops(_g, _k, _proof)``, level ``_k`` > 0."""
    down = None
    for k in range(len(levels), 0, -1):
        known = tops.where(F.col("_k") == k).select("_g", F.lit(0).cast("long").alias("_i"), "_proof", *keep)
        known = known if down is None else known.unionByName(down)
        rows = levels[k - 1].select("_g", "_i", "_c").join(known, ["_g", "_i"])
        rows = rows.select("_g", F.posexplode("_c").alias("_at", "_child"), F.col("_c._h").alias("_all"), "_proof", *keep)
        side = lambda part: F.unhex(F.array_join(part, ""))
        left = side(F.slice("_all", F.lit(1), F.col("_at")))
        right = side(F.slice("_all", F.col("_at") + 2, F.size("_all")))
        proof = F.concat(F.array(F.struct(left.alias("l"), right.alias("r"))), F.col("_proof")).alias("_proof")
        down = rows.select("_g", F.col("_child._i").alias("_i"), proof, *(["_child"] if k == 1 else []), *keep)
        if k > 1 and k % STRIDE == 1:
            down = written(down, "proofs")
    return down.select("_g", "_i", F.col("_child._h").alias("_h"), F.col("_child._x").alias("_x"), "_proof", *keep)


def _hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def folded(leaf_: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(proof, leaf_, lambda h, s: F.sha2(F.concat(_hex(s["l"]), h, _hex(s["r"])).cast("binary"), 256))


def manifest(docs: DataFrame, changed: Column, fanout: int = FANOUT) -> DataFrame:
    """``doc_id, leaf, subroot, root``, the proof's digest, and whether the row with ``changed`` for its leaf still gives the root.

    ``changed``: the digest of a row as it is checked, null where it is as the manifest has it.
    """
    rows = docs.select("doc_id", F.when(F.col("lang").isNull(), "0").otherwise(F.concat(F.lit("1"), "lang")).alias("_g"), leaf().alias("_h"), changed.alias("_changed"))
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "leaves")
    order = [F.col("_g"), F.col("doc_id").asc_nulls_first(), F.col("_h"), F.col("_row")]
    nodes = numbered(range_sorted(rows, order, "leaves"), "_i", "_g", "_n")
    nodes = nodes.select("_g", "_i", "_n", "_h", F.struct("doc_id", "_changed").alias("_x"))
    largest, total = rows.groupBy("_g").agg(F.count("*").alias("c")).agg(F.max("c"), F.sum("c")).first()
    levels = _levels(nodes, total or 0, _depth(largest or 0, fanout), fanout)

    # a language's last level has one node
    subroots = nodes.where("_n = 1").select("_g", "_h", F.lit(0).alias("_k"))
    for k, level in enumerate(levels, 1):
        subroots = subroots.unionByName(level.where("_n = 1").select("_g", "_h", F.lit(k).alias("_k")))
    subroots = written(subroots, "subroots", 1)
    tops = numbered(range_sorted(subroots, [F.col("_g")], "subroots"), "_i").select(F.lit("").alias("_g"), "_i", "_h", F.struct("_g", "_k").alias("_x"))
    many = subroots.count()
    tops = tops.withColumn("_n", F.lit(many).cast("long"))
    above = _levels(tops, many, _depth(many, fanout), fanout)
    root = (above[-1] if above else tops).select("_h").first()
    root = F.lit(root[0] if root else None).cast("string")
    none = F.array().cast(_PROOF)
    if above:
        start = above[-1].select("_g", F.lit(len(above)).alias("_k"), none.alias("_proof"))
        tops = _down(above, start, [])
    else:
        tops = tops.withColumn("_proof", none)
    tops = written(tops.select("_x._g", "_x._k", F.unhex("_h").alias("_sub"), "_proof"), "tops", 1)

    columns = ["_h", "_x", "_proof", "_sub"]
    out = nodes.where("_n = 1").join(tops.where("_k = 0"), "_g").select(*columns)
    if levels:
        out = out.unionByName(_down(levels, tops, ["_sub"]).select(*columns))
    proof = F.array_join(F.transform("_proof", lambda s: F.concat(_hex(s["l"]), _hex(s["r"]))), "")
    out = out.select(
        F.col("_x.doc_id").alias("doc_id"), F.col("_h").alias("leaf"), _hex(F.col("_sub")).alias("subroot"), root.alias("root"),
        digest(proof).alias("proof_sha256"), folded(F.coalesce("_x._changed", "_h"), F.col("_proof")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered() -> Column:
    """The leaf of a row with one character more in its count, where 7 divides its id's checksum; else null."""
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    hit = F.col("doc_id").isNotNull() & (remainder("doc_id", 7) == 0) & F.col("n_chars").isNotNull()
    return F.when(hit, leaf(n_chars=more))


#: Levels that the SQL spells out below subroots and below the root; groups of one node pass through the rest.
SQL_DEPTH, SQL_ABOVE = 24, 12


def _sql_levels(name: str, depth: int) -> str:
    """Levels above ``{name}0(g, i, n, h)``: pairs are hashed, and what is alone in its group stays as it is."""
    return ", ".join(
        f"{name}{k + 1} AS MATERIALIZED (SELECT g, i // 2 AS i, (max(n) + 1) // 2 AS n, "
        f"CASE WHEN max(n) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {name}{k} GROUP BY g, i // 2)"
        for k in range(depth)
    )


def _sql_climb(rows: str, name: str, depth: int) -> str:
    """Tables that take ``{rows}0(id, g, i, n, f, proof)`` up the levels: siblings are added, ``f`` is hashed with them."""
    return ", ".join(
        f"{rows}{k + 1} AS MATERIALIZED (SELECT r.id, r.g, r.i // 2 AS i, (r.n + 1) // 2 AS n, r.proof || coalesce(s.h, '') AS proof, "
        f"CASE WHEN r.n = 1 THEN f ELSE sha256(CASE WHEN r.i % 2 = 1 THEN s.h || f ELSE f || coalesce(s.h, '') END) END AS f "
        f"FROM {rows}{k} r LEFT JOIN {name}{k} s ON s.g = r.g AND s.i = xor(r.i, 1))"
        for k in range(depth)
    )


def oracle_sql() -> str:
    """The query in DuckDB SQL, which has no checksum function: it is spelled out bit by bit."""
    field = lambda c, v: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({v}) || ':' || {v} END"
    fields = lambda more: " || ".join(field(c, f"CAST({c}{more if c == 'n_chars' else ''} AS VARCHAR)") for c in FIELDS)
    bit = "lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END"
    byte = f"lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], {bit})"
    codes = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))"
    checksum = f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), {byte}), 4294967295)"
    return f"""WITH d AS MATERIALIZED (SELECT doc_id, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS g, sha256({fields('')}) AS leaf,
  CASE WHEN n_chars IS NOT NULL AND {checksum} % 7 = 0 THEN sha256({fields(' + 1')}) END AS changed FROM documents),
x AS MATERIALIZED (SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d),
a0 AS (SELECT g, i, n, leaf AS h FROM x), {_sql_levels('a', SQL_DEPTH)},
t AS MATERIALIZED (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM a{SQL_DEPTH}),
b0 AS (SELECT '' AS g, i, n, h FROM t), {_sql_levels('b', SQL_ABOVE)},
r0 AS (SELECT id, g, i, n, coalesce(changed, leaf) AS f, '' AS proof FROM x), {_sql_climb('r', 'a', SQL_DEPTH)},
u0 AS (SELECT r.id, '' AS g, t.i, t.n, f, proof FROM r{SQL_DEPTH} r JOIN t USING (g)), {_sql_climb('u', 'b', SQL_ABOVE)}
SELECT doc_id, leaf, t.h AS subroot, b.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = b.h AS verified
FROM x JOIN u{SQL_ABOVE} u USING (id) JOIN t ON t.g = x.g, b{SQL_ABOVE} b"""

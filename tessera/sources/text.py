"""Readers and writers of text formats, and checks of what is read."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

LETTERS = "ACDEFGHIKLMNPQRSTVWY"
#: Lines that are numbered in one task.
BLOCK_LINES = 65_536


def read_csv(spark: SparkSession, path: str, schema: str | StructType, required: list[str] | None = None) -> DataFrame:
    """A CSV file with a header; malformed rows fail the read, missing columns raise. Quotes are doubled inside quotes;
    an empty text is read as null."""
    df = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("escape", '"').csv(path)
    return require_columns(df, required or [])


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; blanks around a text stay."""
    keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("overwrite").options(header=True, escape='"', **keep).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """JSON, one object a line; malformed lines fail the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json_map(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object a file as ``MAP<STRING, STRING>``."""
    return spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("entries"))


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def parse_fasta(lines: DataFrame, line: str = "value", number: str = "n") -> DataFrame:
    """``header, sequence``, one row a record, from numbered lines; blank lines are skipped.

    Records are numbered by a running count of headers within the file, so ``lines`` may hold a ``file`` column
    to keep files apart. Headers are counted in blocks of lines first, so no task holds the lines of a whole file: a
    ``block`` column names them (in their order), otherwise they are runs of `BLOCK_LINES` numbers.
    """
    by = ["file"] if "file" in lines.columns else []
    block = F.col("block") if "block" in lines.columns else F.floor(F.col(number) / BLOCK_LINES)
    text = lines.where(F.trim(line) != "").withColumns({"_block": block, "is_header": F.trim(line).startswith(">")})
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    # one row a block
    heads = text.groupBy(*by, "_block").agg(F.sum(F.col("is_header").cast("int")).alias("_h"))
    heads = heads.select(*by, "_block", F.coalesce(F.sum("_h").over(before), F.lit(0)).alias("_before"))
    inside = F.sum(F.col("is_header").cast("int")).over(Window.partitionBy(*by, "_block").orderBy(number))
    text = text.withColumn("_inside", inside).join(heads, [*by, "_block"]).withColumn("record", F.col("_inside") + F.col("_before"))
    parts = F.array_sort(F.collect_list(F.when(~F.col("is_header"), F.struct("_block", number, F.upper(F.trim(line)).alias("s")))))
    return text.groupBy(*by, "record").agg(
        F.max(F.when(F.col("is_header"), F.expr(f"substring(trim({line}), 2)"))).alias("header"),
        F.array_join(F.transform(parts, lambda p: p["s"]), "").alias("sequence"),
    )


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``file, record, header, sequence`` of all records of the files at ``path``; blocks are the parts in which files are read."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return parse_fasta(lines.withColumn("n", F.monotonically_increasing_id()))


def write_fasta(records: DataFrame, path: str, width: int = 60) -> None:
    """``header, sequence`` of each record, in lines of ``width`` letters."""
    lines = F.regexp_replace("sequence", f"(.{{{width}}})(?=.)", "$1\n")
    records.select(F.concat(F.lit(">"), F.coalesce("header", F.lit("")), F.lit("\n"), F.coalesce(lines, F.lit(""))).alias("value")).write.mode("overwrite").text(path)


def read_reference(spark: SparkSession, path: str) -> str:
    """The sequence of a file that must hold one record, of the twenty standard letters; anything else raises."""
    records = read_fasta(spark, path).select("record", "sequence").limit(2).collect()
    if len(records) != 1 or records[0]["record"] != 1:
        raise ValueError(f"expected one record in {path}, found {'none' if not records else 'text outside of it or more'}")
    sequence = records[0]["sequence"]
    if bad := sorted(set(sequence) - set(LETTERS)):
        raise ValueError(f"other than the standard letters in {path}: {bad}")
    return sequence


def bad_sequences(records: DataFrame) -> DataFrame:
    """Records with other than the twenty standard letters."""
    return records.where(~F.col("sequence").rlike(f"^[{LETTERS}]+$"))


def read_structures(spark: SparkSession, path: str) -> DataFrame:
    """``file, n, value``: the numbered lines of the first model of each structure file.

    A file is one row at first; its format bounds it to 99,999 atoms a model.
    """
    lines = F.split("value", "\r?\n")
    end = F.array_position(F.transform(lines, F.rtrim), "ENDMDL")
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.when(end > 0, F.slice(lines, F.lit(1), end)).otherwise(lines).alias("l"))
    return files.select("file", F.posexplode("l").alias("n", "value"))


def parse_atoms(lines: DataFrame) -> DataFrame:
    """``file, atom_id, atom, residue, chain, pos, hetero, element, x, y, z, b`` from fixed-width atom lines (``file, value``).

    Of several places of one atom the one with the highest occupancy stays (ties: the first by its letter). Residues
    with an insertion code are left out, as they share a number with another.
    """
    cut = lambda start, n: F.trim(F.substring("value", start, n))
    rows = lines.where(F.substring("value", 1, 6).isin("ATOM  ", "HETATM") & (F.substring("value", 27, 1) == " "))
    rows = rows.select(
        "file",
        cut(7, 5).cast("long").alias("atom_id"),
        cut(13, 4).alias("atom"),
        cut(18, 3).alias("residue"),
        cut(22, 1).alias("chain"),
        cut(23, 4).cast("int").alias("pos"),
        F.col("value").startswith("HETATM").alias("hetero"),
        cut(77, 2).alias("element"),
        *[cut(31 + 8 * i, 8).cast("double").alias(a) for i, a in enumerate("xyz")],
        cut(61, 6).cast("double").alias("b"),
        F.struct(-F.coalesce(cut(55, 6).cast("double"), F.lit(0.0)), cut(17, 1), cut(7, 5).cast("long")).alias("_order"),
    )
    keys = ["file", "chain", "pos", "hetero", "residue", "atom"]
    rest = [c for c in rows.columns if c not in (*keys, "_order")]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), "_order").alias("_v"))
    return best.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in rest])


def read_optional(spark: SparkSession, path: str, switch: str | None = None) -> DataFrame | None:
    """The Parquet table at ``path``; None where it is missing, or where the setting ``switch`` turns this source off."""
    if switch and spark.conf.get(switch, "").lower() in ("1", "true"):
        return None
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def positions(records: DataFrame) -> DataFrame:
    """``pos`` (from 1) and ``ref`` of each letter."""
    return records.select(F.posexplode(F.split("sequence", "")).alias("p", "ref")).where("ref <> ''").select((F.col("p") + 1).alias("pos"), "ref")

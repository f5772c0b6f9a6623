"""Readers of text formats.  A file is one row at first, so that its lines keep their order; files are read in parallel.

Each reader takes a path or glob and gives ``file`` beside its columns, so that many files are one table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_FLOAT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, line), n from 0."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value"))
    return whole.select("file", F.posexplode(F.split(F.regexp_replace("value", "\r", ""), "\n")).alias("n", "line"))


def _part(first: int, last: int, kind: str = "string") -> Column:
    """Columns of the line, from 1, inclusive; blank: null."""
    c = F.trim(F.substring("line", first, last - first + 1))
    return F.when(c != "", c).cast(kind) if kind == "string" else F.when(c != "", c).try_cast(kind)


def read_pdb(spark: SparkSession, path: str) -> DataFrame:
    """ATOM and HETATM records of all models, which count from 1 where there are MODEL records, else 0."""
    w = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    kept = lines(spark, path).filter(F.col("line").rlike("^(ATOM  |HETATM|MODEL)")).withColumn("model", F.sum(F.col("line").startswith("MODEL").cast("int")).over(w))
    return kept.filter(~F.col("line").startswith("MODEL")).select(
        "file", "model", _part(7, 11, "int").alias("serial"), _part(13, 16).alias("name"), _part(17, 17).alias("alt_loc"), _part(18, 20).alias("res_name"), _part(22, 22).alias("chain_id"),
        _part(23, 26, "int").alias("res_seq"), _part(27, 27).alias("icode"), _part(31, 38, "double").alias("x"), _part(39, 46, "double").alias("y"), _part(47, 54, "double").alias("z"),
        _part(55, 60, "double").alias("occupancy"), _part(61, 66, "double").alias("temp_factor"), _part(77, 78).alias("element"), F.col("line").startswith("HETATM").alias("is_hetatm"))


def read_pdb_cell(spark: SparkSession, path: str) -> DataFrame:
    """(file, a, b, c, alpha, beta, gamma) of CRYST1 records."""
    places = {"a": (7, 15), "b": (16, 24), "c": (25, 33), "alpha": (34, 40), "beta": (41, 47), "gamma": (48, 54)}
    return lines(spark, path).filter(F.col("line").startswith("CRYST1")).select("file", *[_part(*p, "double").alias(c) for c, p in places.items()])


def read_gro(spark: SparkSession, path: str) -> DataFrame:
    """Atoms of the first frame; coordinates in angstrom, ten times those in the file."""
    rows = lines(spark, path)
    count = rows.filter("n = 1").select("file", F.trim("line").try_cast("int").alias("atoms"))
    rows = rows.join(count, "file").filter("n >= 2 AND n < atoms + 2")
    return rows.select("file", (F.col("n") - 1).alias("atom_idx"), _part(1, 5, "int").alias("res_id"), _part(6, 10).alias("res_name"), _part(11, 15).alias("atom_name"),
                       *[(_part(21 + 8 * i, 28 + 8 * i, "double") * 10).alias(c) for i, c in enumerate("xyz")])


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    """Element (or its number, as text) and coordinates of each model; all models of a file have as many atoms as the first."""
    rows = lines(spark, path)
    count = rows.filter("n = 0").select("file", F.trim("line").try_cast("int").alias("atoms"))
    rows = rows.join(count, "file").withColumns({"model": F.expr("n div (atoms + 2)").cast("int"), "at": F.expr("n % (atoms + 2) - 1").cast("int")})
    rows = rows.filter("at >= 1").withColumn("f", F.split(F.trim("line"), r"\s+")).filter(F.size("f") >= 4)
    return rows.select("file", "model", F.col("at").alias("atom_idx"), F.col("f")[0].alias("element"), *[F.col("f")[i + 1].try_cast("double").alias(c) for i, c in enumerate("xyz")])


def read_xvg(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, values): the columns of each row; lines of comments and of headers are left out."""
    rows = lines(spark, path).filter(~F.trim("line").rlike("^[#@&]") & (F.trim("line") != ""))
    row = F.row_number().over(Window.partitionBy("file").orderBy("n")) - 1
    return rows.select("file", row.alias("row"), F.transform(F.split(F.trim("line"), r"\s+"), lambda x: x.cast("double")).alias("values"))


def read_xvg_legends(spark: SparkSession, path: str) -> DataFrame:
    """(file, column, legend); column 0 is the axis that has no legend."""
    rows = lines(spark, path).filter(F.col("line").rlike(r'^@ s\d+ legend'))
    return rows.select("file", (F.regexp_extract("line", r"^@ s(\d+)", 1).cast("int") + 1).alias("column"), F.regexp_extract("line", r'legend "(.*)"', 1).alias("legend"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, name, value) of comma-separated numbers; the first row is a header if it holds no number."""
    rows = lines(spark, path).filter(F.trim("line") != "").select("file", "n", F.transform(F.split("line", ","), lambda x: F.trim(x)).alias("f"))
    head = rows.filter("n = 0").select("file", F.when(~F.exists("f", lambda x: x.rlike(_FLOAT)), F.col("f")).alias("names"))
    cells = rows.join(head, "file").filter("n > 0 OR names IS NULL").select("file", (F.col("n") - F.when(F.col("names").isNull(), 0).otherwise(1)).alias("row"), "names", F.posexplode("f").alias("k", "value"))
    return cells.select("file", "row", F.coalesce(F.get("names", F.col("k")), F.col("k").cast("string")).alias("name"), F.col("value").cast("double").alias("value"))

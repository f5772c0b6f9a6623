"""Writers of text formats: lines are made by columns and written in parallel, in order within each file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pdb_lines(atoms: DataFrame) -> DataFrame:
    """(value) in order of model and serial; serials and residue numbers beyond their columns count on from 0."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    line = F.format_string("%-6s%5d %-4s%1s%3s %1s%4d%1s   %8.3f%8.3f%8.3f%6.2f%6.2f          %2s", F.when(F.col("is_hetatm"), "HETATM").otherwise("ATOM"), F.col("serial") % 100_000,
                           F.when(F.length("name") < 4, F.concat(F.lit(" "), F.col("name"))).otherwise(F.col("name")), text("alt_loc"), text("res_name"), text("chain_id"), F.col("res_seq") % 10_000, text("icode"),
                           "x", "y", "z", F.coalesce("occupancy", F.lit(1.0)), F.coalesce("temp_factor", F.lit(0.0)), text("element"))
    return atoms.select("model", "serial", line.alias("value"))


def write_pdb(atoms: DataFrame, path: str) -> None:
    """A folder ``model=N`` for each model."""
    pdb_lines(atoms).repartition("model").sortWithinPartitions("model", "serial").drop("serial").write.partitionBy("model").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True)


def xvg_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(F.format_string(" ".join(["%12.6f"] * len(columns)), *columns).alias("value"))

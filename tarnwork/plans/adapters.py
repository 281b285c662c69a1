"""The driver's tables read as sites, frames, graphs and sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = ("N", "O", "OG", "ND1")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def sites(spark: SparkSession, sf_dir: str, roles: bool = False) -> DataFrame:
    """Embeddings as sites: ten times the first three components; with ``roles`` every fourth is a protein atom."""
    e = _read(spark, sf_dir, "embeddings")
    protein = (F.col("vec_id") % 4 == 0) if roles else F.lit(False)
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.floor(F.col("vec_id") / 4) % 4 + 1).cast("int"))
    return e.select(
        F.col("label").alias("structure_id"), F.lit(0).alias("frame_idx"), F.col("vec_id").alias("atom_index"), F.col("vec_id").alias("mol_id"), F.when(protein, "PROT").otherwise("O").alias("role"),
        F.when(protein, "PROTEIN").otherwise("WAT").alias("category"), F.when(protein, name).otherwise("O").alias("name"), F.floor(F.col("vec_id") / 8).cast("long").alias("resid"), F.lit(None).cast("int").alias("msa_resid"),
        *((F.get("embedding", F.lit(i)).cast("double") * 10).alias(a) for i, a in enumerate("xyz")),
    )


def with_hydrogens(s: DataFrame) -> DataFrame:
    """Each water's two hydrogens at fixed offsets, numbered beyond the oxygens."""
    o = s.where("category = 'WAT'")
    h = [o.withColumn("role", F.lit(f"H{k}")).withColumn("name", F.lit(f"H{k}")).withColumn("atom_index", F.col("atom_index") * 10 + 1_000_000_000 + k).withColumn(a, F.col(a) + 0.3) for k, a in ((1, "x"), (2, "y"))]
    return s.unionByName(h[0]).unionByName(h[1])


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames: a day's distinct (user, type) pairs."""
    return _read(spark, sf_dir, "events").select(F.dayofmonth("ts").alias("frame_idx"), "user_id", "event_type").distinct()


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types as aligned sequences, blanks as gaps."""
    return _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("structure_id"), F.regexp_replace("p_type", " ", "-").alias("sequence"))


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as CA atoms: an order is a structure, a part number gives the residue name."""
    codes = ("ALA", "ARG", "ASN", "ASP", "CYS", "GLN", "GLU", "GLY", "HIS", "ILE")
    return _read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("structure_id"), F.col("l_linenumber").alias("resid"), F.col("l_linenumber").alias("atom_index"), F.lit("CA").alias("name"), F.lit("ATOM").alias("record"),
        F.element_at(F.array(*map(F.lit, codes)), (F.col("l_partkey") % 10 + 1).cast("int")).alias("resname"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100).alias("z"),
    )

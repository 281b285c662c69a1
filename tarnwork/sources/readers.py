"""Readers: structures, trajectories of models, sequences, alignments, density grids, tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ANGLES = "structure_id string, resid int, msa_resid int, index_1 int, index_2 int, protein_atom string, classification string, protein_coords string, water_coords string, angle_1 double, angle_2 double"


def _field(start: int, end: int, line: str = "value") -> Column:
    return F.trim(F.substring(line, start, end - start + 1))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, structure_id, line, value) of every line; a file is read whole, so that lines keep their order; files are the partitions.

    A structure is named by its file without the last extension; tables are keyed by that name, so files in several folders
    need names of their own.  Within a reader, what belongs to one file is told by its whole path.
    """
    name = F.element_at(F.split("file", "/"), -1)
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value").where("file not like '%swp%'")
    return files.select("file", F.regexp_replace(name, r"\.[^.]*$", "").alias("structure_id"), F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))


def _in_frames(atoms: DataFrame, residue: tuple[str, ...]) -> DataFrame:
    """Adds atom_index and mol_id.

    atom_index is the serial number where serials ascend throughout a frame, else (more atoms than the field has digits, or
    numbers given anew) the place in the frame, from 1.  mol_id numbers the frame's residues, runs of lines alike in
    ``residue``: two chains may share a residue number, and numbers may start again.
    """
    frame = Window.partitionBy("file", "frame_idx")
    order = frame.orderBy("line")
    here, last = F.struct(*residue), F.lag(F.struct(*residue)).over(order)
    rows = atoms.withColumn("_new", F.when(here.eqNullSafe(last), 0).otherwise(1)).withColumn("_up", F.coalesce(F.col("serial") > F.lag("serial").over(order), F.col("serial").isNotNull() & F.lag("line").over(order).isNull()))
    rows = rows.withColumn("mol_id", F.sum("_new").over(order).cast("long")).withColumn("_place", F.row_number().over(order))
    return rows.withColumn("atom_index", F.when(F.min("_up").over(frame), F.col("serial")).otherwise(F.col("_place"))).drop("_new", "_up", "_place", "file", "line")


def pdb(spark: SparkSession, path: str) -> DataFrame:
    """Atoms of PDB files at ``path`` (a file, folder or glob), swap files left out; MODEL records number frames from 0."""
    rows = _lines(spark, path)
    model = F.sum((_field(1, 6) == "MODEL").cast("int")).over(Window.partitionBy("file").orderBy("line"))
    rows = rows.withColumn("frame_idx", F.greatest(model - 1, F.lit(0)).cast("int"))
    atoms = rows.where(_field(1, 6).isin("ATOM", "HETATM")).where(_field(31, 38).try_cast("double").isNotNull())
    number = lambda a, b, kind: _field(a, b).try_cast(kind)
    name = _field(13, 16)
    element = F.coalesce(F.nullif(_field(77, 78), F.lit("")), F.regexp_extract(name, "^[0-9]*([A-Z])", 1))
    # Four-letter residue names take the column beside.
    atoms = atoms.select(
        "file", "line", "structure_id", "frame_idx", number(7, 11, "int").alias("serial"), name.alias("name"), element.alias("element"), _field(18, 21).alias("resname"), number(23, 26, "int").alias("resid"),
        _field(27, 27).alias("icode"), _field(22, 22).alias("chain"), _field(17, 17).alias("altloc"), number(31, 38, "double").alias("x"), number(39, 46, "double").alias("y"), number(47, 54, "double").alias("z"), number(55, 60, "double").alias("occupancy"),
        number(61, 66, "double").alias("b_factor"), _field(1, 6).alias("record"),
    )
    return _in_frames(atoms, ("chain", "resid", "icode", "resname"))


def gro(spark: SparkSession, path: str) -> DataFrame:
    """Atoms of GRO files; lengths become angstrom; each line that is a count of atoms starts a frame."""
    frame = F.sum(F.col("value").rlike(r"^\s*[0-9]+\s*$").cast("int")).over(Window.partitionBy("file").orderBy("line")) - 1
    lines = _lines(spark, path).withColumn("frame_idx", F.greatest(frame, F.lit(0)).cast("int"))
    atoms = lines.where(F.col("value").rlike(r"^.{20}\s*-?[0-9]+\.[0-9]+\s*-?[0-9]+\.[0-9]+\s*-?[0-9]+\.[0-9]+"))
    xyz = [(_field(a, a + 7).try_cast("double") * 10).alias(c) for a, c in ((21, "x"), (29, "y"), (37, "z"))]
    atoms = atoms.select("file", "line", "structure_id", "frame_idx", _field(16, 20).try_cast("int").alias("serial"), _field(11, 15).alias("name"), _field(6, 10).alias("resname"), _field(1, 5).try_cast("int").alias("resid"), *xyz)
    return _in_frames(atoms, ("resid", "resname"))


def xyz(spark: SparkSession, path: str) -> DataFrame:
    """Points of XYZ files: a count, a title, then 'name x y z' lines, frame after frame."""
    files = _lines(spark, path)
    parts = F.split(F.trim("value"), r"\s+")
    frame = F.sum(F.col("value").rlike(r"^\s*[0-9]+\s*$").cast("int")).over(Window.partitionBy("file").orderBy("line")) - 1
    rows = files.withColumn("frame_idx", frame.cast("int")).withColumn("p", parts).where((F.size("p") == 4) & F.get("p", F.lit(1)).try_cast("double").isNotNull())
    order = F.row_number().over(Window.partitionBy("file", "frame_idx").orderBy("line"))
    return rows.select("structure_id", "frame_idx", order.alias("atom_index"), F.get("p", F.lit(0)).alias("name"), *(F.get("p", F.lit(i)).try_cast("double").alias(c) for i, c in enumerate("xyz", 1)))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, sequence) of all records."""
    records = spark.read.text(path, lineSep=">").where("trim(value) <> ''")
    lines = F.split("value", "\r?\n")
    return records.select(F.trim(F.get(lines, F.lit(0))).alias("name"), F.regexp_replace(F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(1))), ""), r"\s", "").alias("sequence"))


def pir(spark: SparkSession, path: str) -> DataFrame:
    """(name, sequence) of PIR alignments: a name line, a description, then the sequence to '*'."""
    records = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", ">P1;")).alias("value")).where("value like '%*%'")
    lines = F.split("value", "\r?\n")
    body = F.split_part(F.array_join(F.slice(lines, F.lit(3), F.greatest(F.size(lines), F.lit(1))), ""), F.lit("*"), F.lit(1))
    return records.select(F.trim(F.get(lines, F.lit(0))).alias("name"), F.regexp_replace(body, r"\s", "").alias("sequence"))


def dx(spark: SparkSession, path: str) -> DataFrame:
    """(ix, iy, iz, density, x, y, z) of the non-zero voxels of an OpenDX grid."""
    text = spark.read.text(path, wholetext=True).select("value")
    number = r"(-?[0-9.]+(?:[eE][+-]?[0-9]+)?)"
    shape = [F.regexp_extract("value", r"counts\s+([0-9]+)\s+([0-9]+)\s+([0-9]+)", k).cast("long").alias(f"n{a}") for k, a in enumerate("xyz", 1)]
    origin = [F.regexp_extract("value", rf"origin\s+{number}\s+{number}\s+{number}", k).cast("double").alias(f"o{a}") for k, a in enumerate("xyz", 1)]
    delta = [F.regexp_extract_all("value", F.lit(rf"delta\s+{number}\s+{number}\s+{number}"), F.lit(k)) for k in (1, 2, 3)]
    steps = [F.get(d, F.lit(k)).cast("double").alias(f"d{a}") for k, (d, a) in enumerate(zip(delta, "xyz", strict=True))]
    data = F.regexp_extract("value", r"(?s)data follows\s*(.*?)(?:attribute|object|component|$)", 1)
    rows = text.select(*shape, *origin, *steps, F.posexplode(F.split(F.trim(data), r"\s+")).alias("i", "v")).withColumn("density", F.col("v").try_cast("double")).where("density <> 0")
    ix, iy, iz = F.floor(F.col("i") / (F.col("ny") * F.col("nz"))), F.floor(F.col("i") / F.col("nz")) % F.col("ny"), F.col("i") % F.col("nz")
    return rows.select(*(c.cast("long").alias(f"i{a}") for c, a in zip((ix, iy, iz), "xyz", strict=True)), "density", *((F.col(f"o{a}") + c * F.col(f"d{a}")).alias(a) for c, a in zip((ix, iy, iz), "xyz", strict=True)))


def angle_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=ANGLES)


def secondary_structure(spark: SparkSession, path: str) -> DataFrame:
    """(resname, resid, ss) from 'RES NUM SS' lines."""
    p = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.size(p) == 3).select(F.get(p, F.lit(0)).alias("resname"), F.get(p, F.lit(1)).try_cast("int").alias("resid"), F.get(p, F.lit(2)).alias("ss")).where("resid is not null")


def results(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A result table of earlier runs, partitioned by run_name."""
    return spark.read.parquet(f"{path.rstrip('/')}/{table}")


def packed(column: Column | str) -> Column:
    """Coordinates that a table holds as one string of numbers between blanks, as array<double>."""
    text = F.col(column) if isinstance(column, str) else column
    return F.transform(F.regexp_extract_all(text, F.lit(r"[-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?"), F.lit(0)), lambda v: v.try_cast("double"))

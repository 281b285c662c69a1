"""Binary trajectories: DCD and XTC files, joined to the atoms of a topology."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import readers

FRAMES = "structure_id string, frame_idx int, place int, x double, y double, z double, lx double, ly double, lz double"


def _records(data: bytes, order: str) -> Iterator[memoryview]:
    """The records of a Fortran file: each between two equal counts of its bytes.  A last one that is cut short is left out."""
    view, at = memoryview(data), 0
    while at + 4 <= len(view):
        (size,) = struct.unpack_from(order + "i", view, at)
        if size < 0:
            raise ValueError(f"a record of {size} bytes")
        if at + 8 + size > len(view):
            return
        if struct.unpack_from(order + "i", view, at + 4 + size)[0] != size:
            raise ValueError("a record's two sizes differ")
        yield view[at + 4 : at + 4 + size]
        at += 8 + size


def dcd_frames(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """(positions, an atom a row; box lengths or None) of each frame, in angstrom, of either byte order.

    Atoms that are said to be fixed stand in the first frame only and keep their places.  A frame that is cut short, as a
    run that was stopped leaves it, ends the file.
    """
    if len(data) < 4:
        raise ValueError("not a DCD file")
    order = next((o for o in "<>" if struct.unpack_from(o + "i", data)[0] == 84), None)
    if order is None or bytes(data[4:8]) != b"CORD":
        raise ValueError("not a DCD file")
    records = _records(data, order)
    flags = np.frombuffer(next(records)[4:], order + "i4")
    fixed, cell, fourth = int(flags[8]), bool(flags[10]), bool(flags[11])
    next(records, None)  # titles
    count = next(records, None)
    if count is None:
        return
    n = struct.unpack_from(order + "i", count)[0]
    free = np.frombuffer(next(records), order + "i4").astype(np.int64) - 1 if fixed else np.arange(n)
    first = None
    while True:
        box = None
        if cell:
            sides = next(records, None)
            if sides is None:
                return
            # A, gamma, B, beta, alpha, C
            box = np.frombuffer(sides, order + "f8")[[0, 2, 5]].astype(float)
        axes = [next(records, None) for _ in range(4 if fourth else 3)][:3]
        if any(a is None for a in axes):
            return
        some = np.stack([np.frombuffer(a, order + "f4").astype(float) for a in axes], 1)
        if first is None:
            if len(some) != n:
                raise ValueError("the first frame lacks atoms")
            first = some
        whole = some if len(some) == n else first.copy()
        if len(some) != n:
            whole[free] = some
        yield whole, box


#: Fixed values of the XTC format: the sides of the cubes that hold small differences, by index.
SIDES = (
    0, 0, 0, 0, 0, 0, 0, 0, 0, 8, 10, 12, 16, 20, 25, 32, 40, 50, 64, 80, 101, 128, 161, 203, 256, 322, 406, 512, 645, 812, 1024, 1290, 1625, 2048, 2580, 3250, 4096,
    5060, 6501, 8192, 10321, 13003, 16384, 20642, 26007, 32768, 41285, 52015, 65536, 82570, 104031, 131072, 165140, 208063, 262144, 330280, 416127, 524287, 660561,
    832255, 1048576, 1321122, 1664510, 2097152, 2642245, 3329021, 4194304, 5284491, 6658042, 8388607, 10568983, 13316085, 16777216,
)
_LEAST_SIDE = 9


class _Bits:
    """Numbers of any count of bits, from the highest bit of the first byte on."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> int:
        begin, end = self.at >> 3, (self.at + n + 7) >> 3
        if end > len(self.data):
            raise ValueError("a frame is damaged")
        whole = int.from_bytes(self.data[begin:end], "big")
        self.at += n
        return whole >> (8 * end - self.at) & ((1 << n) - 1)

    def triple(self, n: int, sizes: tuple[int, int, int]) -> tuple[int, int, int]:
        """Three numbers in one of mixed radix, whose bytes come lowest first."""
        value = sum(self.take(min(8, n - k)) << k for k in range(0, n, 8))
        value, z = divmod(value, sizes[2])
        x, y = divmod(value, sizes[1])
        return x, y, z


def _unpacked(data: bytes, n: int, low: tuple[int, ...], high: tuple[int, ...], index: int) -> np.ndarray:
    """The integer positions of a frame: atoms alone within the frame's bounds, each with a run of near ones behind it."""
    bits, sizes = _Bits(data), tuple(h - a + 1 for a, h in zip(low, high, strict=True))
    apart = max(sizes) > 0xFFFFFF
    width = (sizes[0] * sizes[1] * sizes[2]).bit_length()
    out: list[tuple[int, ...]] = []
    run = 0
    while len(out) < n:
        if not _LEAST_SIDE <= index < len(SIDES):
            raise ValueError("a frame is damaged")
        some = tuple(bits.take(k.bit_length()) for k in sizes) if apart else bits.triple(width, sizes)
        here = tuple(a + b for a, b in zip(some, low, strict=True))
        change = 0
        if bits.take(1):
            told = bits.take(5)
            run, change = told // 3, told % 3 - 1
        side = SIDES[index]
        near = []
        last = here
        for _ in range(run):
            last = tuple(a + b - side // 2 for a, b in zip(bits.triple(index, (side,) * 3), last, strict=True))
            near.append(last)
            if len(near) == 1:
                last = here  # the first two atoms have changed places, and the third follows the second
        out += [near[0], here, *near[1:]] if near else [here]
        index += change
    if len(out) != n:
        raise ValueError("a frame is damaged")
    return np.array(out, np.int64)


def xtc_frames(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """(positions, an atom a row; box lengths) of each frame of an XTC file, in angstrom.  A frame cut short ends the file."""
    at, view = 0, bytes(data)

    def take(form: str) -> tuple:
        nonlocal at
        found = struct.unpack_from(">" + form, view, at)
        at += struct.calcsize(">" + form)
        return found

    while at < len(view):
        try:
            magic, n, _, _ = take("iiif")
            if magic not in (1995, 2023):
                raise ValueError("not an XTC file")
            sides = np.array(take("9f")).reshape(3, 3)
            box = np.sqrt((sides**2).sum(1)) * 10
            (n,) = take("i")
            if n <= 9:
                yield np.array(take(f"{3 * n}f")).reshape(n, 3) * 10, box
                continue
            (precision,) = take("f")
            low, high = take("3i"), take("3i")
            (index,) = take("i")
            (size,) = take("q" if magic == 2023 else "i")
        except struct.error:
            return
        if at + size > len(view):
            return
        yield _unpacked(view[at : at + size], n, low, high, index) / (precision / 10), box
        at += -(-size // 4) * 4


def frames(spark: SparkSession, path: str) -> DataFrame:
    """(structure_id, frame_idx, place, x, y, z, lx, ly, lz) of DCD and XTC files at ``path``; a structure is named by its file.

    ``place`` counts a frame's atoms from 1; frames count from 0; box lengths are null where the file has none.  A file is
    one task's work and at most 2 GB (Spark's binary files); long runs are written as several files.  A frame at a time
    leaves the task.
    """
    import pyarrow as pa

    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    files = spark.read.format("binaryFile").load(path).select(name.alias("structure_id"), "content", F.lower("path").endswith(".xtc").alias("xtc"))

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                which, content = batch.column(0)[k].as_py(), batch.column(1)[k].as_buffer()
                for frame, (at, box) in enumerate((xtc_frames if batch.column(2)[k].as_py() else dcd_frames)(memoryview(content))):
                    n = len(at)
                    sides = [pa.nulls(n, pa.float64()) if box is None else pa.array(np.full(n, side)) for side in (box if box is not None else "xyz")]
                    columns = [pa.array([which] * n, pa.string()), pa.array(np.full(n, frame, np.int32)), pa.array(np.arange(1, n + 1, dtype=np.int32)), *(pa.array(at[:, a].copy()) for a in range(3)), *sides]
                    yield pa.RecordBatch.from_arrays(columns, names=["structure_id", "frame_idx", "place", "x", "y", "z", "lx", "ly", "lz"])

    return files.mapInArrow(run, FRAMES)


def topology(spark: SparkSession, path: str) -> DataFrame:
    """The atoms of a PDB or GRO file's first frame, by its name."""
    atoms = readers.gro(spark, path) if path.lower().endswith(".gro") else readers.pdb(spark, path)
    return atoms.where("frame_idx = 0")


def trajectory(spark: SparkSession, topology_path: str, path: str) -> DataFrame:
    """The topology's atoms at their positions in every frame of the trajectories at ``path``.

    Atoms are matched by their place in the file.  Raises where the topology has several files, or where a frame has
    more atoms than it.
    """
    atoms = topology(spark, topology_path)
    size = atoms.agg(F.count("*").alias("n"), F.count_distinct("structure_id").alias("files")).first()
    if size["files"] != 1:
        raise ValueError(f"a trajectory needs one topology, not {size['files']}")
    order = F.row_number().over(Window.partitionBy("structure_id").orderBy("atom_index"))
    atoms = atoms.withColumn("place", order.cast("int")).drop("structure_id", "frame_idx", "x", "y", "z")
    moved = frames(spark, path)
    joined = moved.join(atoms, "place", "left")
    wrong = F.raise_error(F.concat(F.lit("the topology has no atom "), F.col("place").cast("string"), F.lit(" of "), F.col("structure_id")))
    return joined.withColumn("atom_index", F.when(F.col("atom_index").isNull(), wrong.cast("int")).otherwise(F.col("atom_index"))).drop("place")

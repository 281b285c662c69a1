"""Binary trajectories, from bytes that the tests lay out by themselves, and the valleys of OPTICS plots."""

import struct

import numpy as np
import pytest

from tarnwork.operators import cluster
from tarnwork.plans import cli
from tarnwork.plans.config import parse_inputs
from tarnwork.sources import trajectories


def record(data, order="<"):
    return struct.pack(order + "i", len(data)) + data + struct.pack(order + "i", len(data))


def dcd_bytes(xyz, box=None, order="<", fixed=()):
    n = xyz.shape[1]
    flags = np.zeros(20, order + "i4")
    flags[0], flags[8], flags[10] = len(xyz), len(fixed), box is not None
    free = np.array([k for k in range(n) if k not in fixed])
    out = record(b"CORD" + flags.tobytes(), order) + record(struct.pack(order + "i", 1) + b" " * 80, order) + record(struct.pack(order + "i", n), order)
    if len(fixed):
        out += record((free + 1).astype(order + "i4").tobytes(), order)
    for k, frame in enumerate(xyz):
        if box is not None:
            out += record(np.array([box[0], 90, box[1], 90, 90, box[2]], order + "f8").tobytes(), order)
        for axis in range(3):
            out += record(frame[free if k and len(fixed) else slice(None), axis].astype(order + "f4").tobytes(), order)
    return out


class Writer:
    """Bits from the highest on; a triple is one number of mixed radix, its bytes lowest first."""

    def __init__(self):
        self.text = ""

    def put(self, n, value):
        self.text += format(value, f"0{n}b") if n else ""

    def triple(self, n, sizes, values):
        value = (values[0] * sizes[1] + values[1]) * sizes[2] + values[2]
        for k in range(0, n, 8):
            width = min(8, n - k)
            self.put(width, value >> k & (1 << width) - 1)

    def bytes(self):
        text = self.text + "0" * (-len(self.text) % 8)
        return bytes(int(text[k : k + 8], 2) for k in range(0, len(text), 8))


def xtc_bytes(frames, precision=1000.0, index=24, grouped=False, wide=False):
    """Integer positions in units of 1 / precision nanometres; ``grouped`` writes waters of three atoms as one and a run of two."""
    out = b""
    for frame in frames:
        low, high = frame.min(0), frame.max(0) + (1 << 24 if wide else 0)
        sizes = [int(v) for v in high - low + 1]
        side, w = trajectories.SIDES[index], Writer()
        for k in range(0, len(frame), 3 if grouped else 1):
            first, second = (frame[k + 1], frame[k]) if grouped else (frame[k], None)
            if wide:
                for size, v in zip(sizes, first - low, strict=True):
                    w.put(size.bit_length(), int(v))
            else:
                w.triple((sizes[0] * sizes[1] * sizes[2]).bit_length(), sizes, [int(v) for v in first - low])
            if not grouped:
                w.put(1, 0)
                continue
            # The run stays as it was told by the first water.
            w.put(1, int(k == 0))
            if k == 0:
                w.put(5, 2 * 3 + 1)
            for moved, base in ((second, first), (frame[k + 2], first)):
                w.triple(index, [side] * 3, [int(v) for v in moved - base + side // 2])
        body = w.bytes()
        out += struct.pack(">iiif9fi", 1995, len(frame), 0, 0.0, 3, 0, 0, 0, 4, 0, 0, 0, 5, len(frame)) + struct.pack(">f3i3i", precision, *map(int, low), *map(int, high))
        out += struct.pack(">ii", index, len(body)) + body + b"\0" * (-len(body) % 4)
    return out


def test_dcd_frames():
    xyz = np.random.default_rng(0).normal(0, 9, (3, 5, 3)).astype("f4")
    for order in "<>":
        got = list(trajectories.dcd_frames(dcd_bytes(xyz, (10, 11, 12), order)))
        assert all((at == want).all() and box.tolist() == [10, 11, 12] for (at, box), want in zip(got, xyz, strict=True))
    still = xyz.copy()
    still[1:, 2] = still[0, 2]
    assert all((at == want).all() and box is None for (at, box), want in zip(trajectories.dcd_frames(dcd_bytes(still, fixed=(2,))), still, strict=True))
    assert len(list(trajectories.dcd_frames(dcd_bytes(xyz)[:-30]))) == 2
    assert list(trajectories.dcd_frames(dcd_bytes(xyz[:0]))) == []
    for bad in (b"", b"no trajectory at all"):
        with pytest.raises(ValueError):
            list(trajectories.dcd_frames(bad))


@pytest.mark.parametrize("grouped, wide", [(False, False), (True, False), (False, True), (True, True)])
def test_xtc_frames(grouped, wide):
    rng = np.random.default_rng(1)
    frames = rng.integers(-4000, 9000, (2, 12, 1, 3)) + rng.integers(-60, 60, (2, 12, 3, 3))
    frames = frames.reshape(2, 36, 3)
    data = xtc_bytes(frames, grouped=grouped, wide=wide)
    got = list(trajectories.xtc_frames(data))
    assert all(np.allclose(at, want / 100) and np.allclose(box, (30, 40, 50)) for (at, box), want in zip(got, frames, strict=True))
    assert len(list(trajectories.xtc_frames(data[:-9]))) == 1
    with pytest.raises(ValueError):
        list(trajectories.xtc_frames(b"\0" * 100))


def test_xtc_of_few_atoms():
    data = struct.pack(">iiif9fi6f", 1995, 2, 0, 0.0, *([0.0] * 9), 2, *(0.5 * k for k in range(6)))
    ((at, box),) = trajectories.xtc_frames(data)
    assert np.allclose(at.ravel(), np.arange(6) * 5) and box.tolist() == [0, 0, 0]


def test_run_of_a_trajectory(spark, tmp_path):
    """Three waters in a row come apart in the second frame."""
    (tmp_path / "top.gro").write_text("t\n    3\n" + "".join(f"    {k}SOL     OW    {k}   0.000   0.000   0.000\n" for k in (1, 2, 3)) + "   1.0   1.0   1.0\n")
    xyz = np.array([[[0, 0, 0], [2.5, 0, 0], [5, 0, 0]], [[0, 0, 0], [2.5, 0, 0], [9, 0, 0]]], "f4")
    (tmp_path / "run.dcd").write_bytes(dcd_bytes(xyz))
    text = f"structure_type: dynamic\nstructure_directory: {tmp_path}\ntopology_file: top.gro\ntrajectory_file: run.dcd\nnetwork_type: water-water\nmax_distance: 3.0\ninteraction_counts: on\n"
    out = cli.run_inputs(spark, text, "r", str(tmp_path / "out"))
    assert {(r["structure_id"], r["frame_idx"], r["water_water"]) for r in out["interaction_counts"].collect()} == {("run", 0, 2), ("run", 1, 1)}
    (tmp_path / "more.dcd").write_bytes(dcd_bytes(np.zeros((1, 4, 3), "f4")))
    with pytest.raises(Exception, match="no atom"):
        trajectories.trajectory(spark, str(tmp_path / "top.gro"), str(tmp_path / "more.dcd")).collect()
    with pytest.raises(ValueError):
        parse_inputs("structure_type: dynamic\ntrajectory_file: run.dcd\n")


def test_valleys_of_a_plot():
    """Two valleys in one, inner ones first.  The second ends at the first place above the 5 from which it falls, place 8,
    unless that was reached from outside."""
    none = np.full(12, -1)
    source = np.maximum(np.arange(12) - 1, 0)
    plot = np.array([np.inf, 1, 1, 1, 5, 1, 1, 1, 9, 20, 30, 40])
    assert cluster._valleys(plot, source, 0.3, 2, 3) == [(0, 3), (4, 8), (0, 11)]
    source[8] = 2
    assert cluster._valleys(plot, source, 0.3, 2, 3) == [(0, 3), (4, 7), (0, 11)]
    assert cluster._valleys(np.full(12, np.inf), none, 0.05, 3, 3) == []
    x = np.concatenate([np.arange(12) * 0.1, 50 + np.arange(12) * 0.1, [900.0]])[:, None] * [[1, 0, 0]]
    labels = cluster.optics_labels(x, 3, 20.0, xi=0.05)  # without a bound the last point would end the second valley
    assert set(labels[:12]) == {0} and set(labels[12:24]) == {1} and labels[-1] == -1
    for bad in (0, 1, 2):
        with pytest.raises(ValueError):
            cluster.optics_labels(x, 3, xi=bad)


def test_optics_of_few_points(spark):
    assert cluster.optics_labels(np.zeros((0, 3)), 5, xi=0.05).tolist() == []
    assert cluster.optics_labels(np.zeros((2, 3)), 5, xi=0.05).tolist() == [-1, -1]
    points = spark.createDataFrame([(k, 0.1 * k + 50 * (k // 12), 0.0, 0.0) for k in range(24)], "id long, x double, y double, z double")
    got = {r["id"]: r["label"] for r in cluster.cluster(points, "optics", min_samples=3).collect()}
    assert [got[k] for k in range(24)] == [0] * 12 + [1] * 12

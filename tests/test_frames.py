"""Trajectory files written here byte by byte, read whole and in splits smaller than a frame."""

from __future__ import annotations

import struct

import numpy as np
import pytest

from orrery.sources import frames


@pytest.fixture(autouse=True, scope="module")
def registered(spark):
    frames.register(spark)


def _positions(n_frames: int, n: int) -> np.ndarray:
    return np.random.default_rng(5).uniform(-40, 40, (n_frames, n, 3)).round(2)


def _read(spark, path, kind, split=frames.SPLIT):
    rows = frames.trajectory(spark, str(path), kind, split).orderBy("frame", "atom_idx").collect()
    n = max(r.frame for r in rows) + 1
    assert [r.atom_idx for r in rows] == [i + 1 for _ in range(n) for i in range(len(rows) // n)]
    return np.array([(r.x, r.y, r.z) for r in rows]).reshape(n, -1, 3)


def _record(body: bytes, order: str = "<") -> bytes:
    return struct.pack(order + "i", len(body)) + body + struct.pack(order + "i", len(body))


def _dcd(xyz, order: str, cell: bool, free=None) -> bytes:
    n = xyz.shape[1]
    c = [len(xyz), 100, 10, 0, 0, 0, 0, 0, n - len(free) if free is not None else 0]
    head = b"CORD" + struct.pack(order + "9if10i", *c, 0.5, int(cell), *[0] * 8, 24)
    out = _record(head, order) + _record(struct.pack(order + "i", 1) + b" " * 80, order) + _record(struct.pack(order + "i", n), order)
    if free is not None:
        out += _record(np.array(free, order + "i4").tobytes(), order)
    for k, p in enumerate(xyz):
        if cell:
            out += _record(struct.pack(order + "6d", 30, 90, 40, 90, 90, 50), order)
        p = p if free is None or not k else p[np.array(free) - 1]
        for a in range(3):
            out += _record(p[:, a].astype(order + "f4").tobytes(), order)
    return out


@pytest.mark.parametrize(("order", "cell", "split"), [("<", True, 1 << 20), (">", False, 100), ("<", True, 64)])
def test_dcd(spark, tmp_path, order, cell, split):
    xyz = _positions(7, 20)
    (tmp_path / "a.dcd").write_bytes(_dcd(xyz, order, cell))
    assert np.allclose(_read(spark, tmp_path / "a.dcd", "dcd", split), xyz, atol=1e-5)
    i = frames.index(spark, str(tmp_path / "a.dcd"), "dcd", split).orderBy("frame").collect()
    assert [(r.step, r.time, r.atoms) for r in i] == [(100 + 10 * k, 50.0 + 5 * k, 20) for k in range(7)]
    assert i[0].cell == pytest.approx([30, 0, 0, 0, 40, 0, 0, 0, 50] if cell else [0] * 9, abs=1e-9)


def test_dcd_fixed_atoms(spark, tmp_path):
    xyz, free = _positions(5, 8), [2, 3, 7]
    (tmp_path / "a.dcd").write_bytes(_dcd(xyz, "<", False, free))
    xyz[1:, [i for i in range(8) if i + 1 not in free]] = xyz[0, [i for i in range(8) if i + 1 not in free]]
    assert np.allclose(_read(spark, tmp_path / "a.dcd", "dcd", 200), xyz, atol=1e-5)


@pytest.mark.parametrize(("kind", "split"), [("f", 1 << 20), ("d", 100)])
def test_trr(spark, tmp_path, kind, split):
    xyz, w = _positions(6, 11), struct.calcsize(">" + kind)
    out = b""
    for k, p in enumerate(xyz):
        out += frames.Trr.MARKER + struct.pack(">13i", 0, 0, 9 * w, 0, 0, 0, 0, 33 * w, 33 * w if k % 2 else 0, 0, 11, k * 5, 0) + struct.pack(f">2{kind}", k / 2, 0)
        out += struct.pack(f">9{kind}", 3, 0, 0, 0, 4, 0, 0, 0, 5) + (p / 10).astype(f">f{w}").tobytes() + (b"\1" * 33 * w if k % 2 else b"")
    (tmp_path / "a.trr").write_bytes(out)
    assert np.allclose(_read(spark, tmp_path / "a.trr", "trr", split), xyz, atol=1e-4)
    i = frames.index(spark, str(tmp_path / "a.trr"), "trr", split).orderBy("frame").collect()
    assert [(r.step, r.time, r.cell[4]) for r in i] == [(5 * k, k / 2, 40.0) for k in range(6)]


class _Writer:
    def __init__(self):
        self.bits = ""

    def number(self, value: int, n: int) -> None:
        self.bits += format(value, f"0{n}b")

    def triple(self, values, n: int, y: int, z: int) -> None:
        value, rest = (values[0] * y + values[1]) * z + values[2], n & 7
        low = value & ((1 << (n - rest)) - 1)
        self.bits += "".join(format(b, "08b") for b in low.to_bytes(n >> 3, "little")) + (format(value >> (n - rest), f"0{rest}b") if rest else "")

    def data(self) -> bytes:
        return int(self.bits.ljust((len(self.bits) + 7) // 8 * 8, "0"), 2).to_bytes((len(self.bits) + 7) // 8, "big")


def _xtc(xyz, index: int = 20, magic: int = 1995) -> bytes:
    """Frames where each third atom, from the second on, is whole, and both around it are small steps."""
    out = b""
    for k, p in enumerate(xyz):
        n = len(p)
        out += struct.pack(">iiif9fi", magic, n, k, k * 2.0, 9, 0, 0, 0, 9, 0, 0, 0, 9, n)
        if n <= 9:
            out += (p / 10).astype(">f4").tobytes()
            continue
        q = np.rint(p * 100).astype(int)
        low, high = q.min(0), q.max(0)
        span, w, at = high - low + 1, _Writer(), index
        whole, half = int(np.prod(span.astype(object))).bit_length(), frames.XTC_SIZES[index] // 2
        i, first = 0, True
        while i < n:
            group = q[i:i + 3]
            small = len(group) == 3 and all((abs(a - b) < half).all() for a, b in ((group[0], group[1]), (group[2], group[0])))
            base = group[1] if small else group[0]
            w.triple([int(v) for v in base - low], whole, int(span[1]), int(span[2]))
            w.number(1, 1)
            w.number(2 * 3 + 1 if small else 1, 5)
            if small:
                for d in (group[0] - group[1], group[2] - group[0]):
                    w.triple([int(v) + half for v in d], at, frames.XTC_SIZES[at], frames.XTC_SIZES[at])
            i, first = i + (3 if small else 1), False
        data = w.data()
        out += struct.pack(">f7i", 1000.0, *map(int, low), *map(int, high), index) + struct.pack(">q" if magic == 2023 else ">i", len(data)) + data + b"\0" * (-len(data) % 4)
    return out


@pytest.mark.parametrize(("n", "split", "magic"), [(30, 1 << 20, 1995), (30, 90, 1995), (9, 70, 1995), (31, 1 << 20, 2023)])
def test_xtc(spark, tmp_path, n, split, magic):
    xyz = _positions(6, n)
    for k in range(0, n - 2, 6):  # waters among strangers
        xyz[:, k + 1] = xyz[:, k] + 0.3
        xyz[:, k + 2] = xyz[:, k] - 0.2
    xyz = xyz.round(2)
    (tmp_path / "a.xtc").write_bytes(_xtc(xyz, magic=magic))
    assert np.allclose(_read(spark, tmp_path / "a.xtc", "xtc", split), xyz, atol=1e-4)
    i = frames.index(spark, str(tmp_path / "a.xtc"), "xtc", split).orderBy("frame").collect()
    assert [(r.step, r.time, r.atoms, r.cell[0]) for r in i] == [(k, 2.0 * k, n, 90.0) for k in range(6)]


def test_dump(spark, tmp_path):
    text, order = "", [3, 1, 2]
    for step in (0, 50, 100):
        text += f"ITEM: TIMESTEP\n{step}\nITEM: NUMBER OF ATOMS\n3\nITEM: BOX BOUNDS xy xz yz pp pp pp\n0 12 2\n1 11 0\n-5 5 0\nITEM: ATOMS id type xs ys zs ix iy iz\n"
        text += "".join(f"{i} 1 {0.1 * i} 0.5 {step / 1000} {i - 1} 1 0\n" for i in order)
    (tmp_path / "a.lammpstrj").write_text(text)
    for split in (1 << 20, 50):
        got = _read(spark, tmp_path / "a.lammpstrj", "lammpstrj", split)
        # lengths 10, 10, 10, tilted by 2 along y
        want = [[(i + (i - 1) * 10 + 1 + 2, 15, step / 100) for i in (1, 2, 3)] for step in (0, 50, 100)]
        assert np.allclose(got, want)
    assert [r.step for r in frames.index(spark, str(tmp_path / "a.lammpstrj"), "lammpstrj", 50).orderBy("frame").collect()] == [0, 50, 100]


def test_folder_and_cut_file(spark, tmp_path):
    xyz = _positions(3, 12)
    for name in ("a", "b"):
        (tmp_path / f"{name}.dcd").write_bytes(_dcd(xyz, "<", True))
    assert frames.trajectory(spark, str(tmp_path), "dcd").groupBy("file").count().collect()[1]["count"] == 36
    (tmp_path / "a.dcd").write_bytes(_dcd(xyz, "<", True)[:-8])
    with pytest.raises(Exception, match="ends within"):
        frames.read(spark, str(tmp_path / "a.dcd"), "dcd").count()

"""Trajectories of binary formats and LAMMPS dumps, read by byte ranges.

A file is cut into splits of equal size; a task finds the first frame that begins in its split and reads on to the last one
that does, so that no index is needed beforehand and a long file is read by many tasks.  Paths are those of pyarrow's file
systems: local, or with a scheme.  Lengths are in angstrom.

``register(spark)`` once; then ``read(spark, path, kind)`` gives (file, offset, step, time, cell, atom_idx, x, y, z), and
``index(spark, path, kind)`` (file, frame, offset, step, time, cell, atoms), for which only headers are read.  ``trajectory`` joins the two
into (file, frame, atom_idx, x, y, z).  ``cell`` holds nine numbers: the lattice vectors as rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from orrery.functions.geometry import cell_from_angles

SPLIT = 128 << 20
_CHUNK = 1 << 20


@dataclass
class Frame:
    """One frame: where the next begins, and its coordinates if they are asked for."""

    following: int
    step: int
    time: float
    cell: list[float]
    atoms: int
    xyz: np.ndarray | None = None
    ids: np.ndarray | None = None


def _find(f, marker: bytes, start: int, end: int, holds=lambda at: True) -> int:
    """The first place of a marker that begins in [start, end); ``end`` if there is none."""
    at = start
    while at < end:
        f.seek(at)
        chunk = f.read(min(_CHUNK, end - at) + len(marker) - 1)
        k = chunk.find(marker)
        while k >= 0:
            if at + k >= end:
                return end
            if holds(at + k):
                return at + k
            k = chunk.find(marker, k + 1)
        at += _CHUNK
    return end


class Dcd:
    """CHARMM and X-PLOR records of either byte order, with a cell, a fourth coordinate and fixed atoms if the header says so."""

    def __init__(self, f):
        raw = f.read(92)
        self.order = "<" if struct.unpack("<i", raw[:4])[0] == 84 else ">"
        if struct.unpack(self.order + "i", raw[:4])[0] != 84 or raw[4:8] != b"CORD":
            raise ValueError("no DCD file")
        c = struct.unpack(self.order + "20i", raw[8:88])
        charmm = c[19] != 0
        self.first, self.every = c[1], c[2] or 1
        self.delta = struct.unpack(self.order + ("f" if charmm else "d"), raw[44:48] if charmm else raw[44:52])[0]
        self.has_cell, self.planes = charmm and c[10] == 1, 4 if charmm and c[11] == 1 else 3
        self._record(f)
        self.atoms = struct.unpack(self.order + "i", self._record(f))[0]
        self.free = np.frombuffer(self._record(f), self.order + "i4").astype("int64") - 1 if c[8] else None
        self.begin = f.tell()
        extra = 56 if self.has_cell else 0
        self.first_size = extra + self.planes * (self.atoms * 4 + 8)
        self.size = extra + self.planes * ((self.atoms if self.free is None else len(self.free)) * 4 + 8)
        self.fixed = self._coordinates(f, self.begin, self.atoms) if self.free is not None else None

    def _record(self, f) -> bytes:
        n = struct.unpack(self.order + "i", f.read(4))[0]
        body = f.read(n)
        if struct.unpack(self.order + "i", f.read(4))[0] != n:
            raise ValueError("a DCD record's lengths differ")
        return body

    def _coordinates(self, f, at: int, n: int) -> np.ndarray:
        f.seek(at + (56 if self.has_cell else 0))
        return np.stack([np.frombuffer(self._record(f), self.order + "f4", n) for _ in range(3)], axis=1).astype("float64")

    def find(self, f, start: int, end: int) -> int:
        if start <= self.begin:
            return self.begin
        second = self.begin + self.first_size
        return max(second, second - (second - start) // self.size * self.size)

    def frame(self, f, at: int, coordinates: bool) -> Frame:
        number = 0 if at == self.begin else 1 + (at - self.begin - self.first_size) // self.size
        cell = [0.0] * 9
        if self.has_cell:
            f.seek(at)
            a, gamma, b, beta, alpha, c = struct.unpack(self.order + "6d", self._record(f))
            # angles are written in degrees, or as their cosines
            alpha, beta, gamma = (float(np.degrees(np.arccos(v))) if -1 <= v <= 1 else v for v in (alpha, beta, gamma))
            cell = [v for row in cell_from_angles(a, b, c, alpha, beta, gamma) for v in row] if a and b and c else cell
        step = self.first + number * self.every
        out = Frame(at + (self.size if number else self.first_size), step, step * self.delta, cell, self.atoms)
        if coordinates and (self.free is None or not number):
            out.xyz = self._coordinates(f, at, self.atoms)
        elif coordinates:
            out.xyz = self.fixed.copy()
            out.xyz[self.free] = self._coordinates(f, at, len(self.free))
        return out


class Trr:
    """GROMACS frames of full precision, single or double; frames without coordinates have no rows."""

    MARKER = struct.pack(">iii", 1993, 13, 12) + b"GMX_trn_file"

    def __init__(self, f):
        pass

    def find(self, f, start: int, end: int) -> int:
        return _find(f, self.MARKER, start, end)

    def frame(self, f, at: int, coordinates: bool) -> Frame:
        f.seek(at + len(self.MARKER))
        sizes = struct.unpack(">10i", f.read(40))
        atoms, step, _ = struct.unpack(">3i", f.read(12))
        box, x = sizes[2], sizes[7]
        width = box // 9 if box else max(sizes[7:]) // (3 * atoms) if atoms and max(sizes[7:]) else 4
        kind = ">f8" if width == 8 else ">f4"
        time = float(np.frombuffer(f.read(2 * width), kind)[0])
        body = f.tell()
        cell = list(map(float, np.frombuffer(f.read(box), kind) * 10.0)) if box else [0.0] * 9
        out = Frame(body + sum(sizes), step, time, cell, atoms if x else 0)
        if coordinates and x:
            f.seek(body + sum(sizes[:7]))
            out.xyz = np.frombuffer(f.read(x), kind).astype("float64").reshape(-1, 3) * 10.0
        return out


# fixed values: the sizes of small differences in XTC, about the third roots of powers of two
XTC_SIZES = (0, 0, 0, 0, 0, 0, 0, 0, 0, 8, 10, 12, 16, 20, 25, 32, 40, 50, 64, 80, 101, 128, 161, 203, 256, 322, 406, 512, 645, 812, 1024, 1290, 1625, 2048, 2580, 3250, 4096, 5060, 6501, 8192, 10321, 13003, 16384, 20642, 26007,
             32768, 41285, 52015, 65536, 82570, 104031, 131072, 165140, 208063, 262144, 330280, 416127, 524287, 660561, 832255, 1048576, 1321122, 1664510, 2097152, 2642245, 3329021, 4194304, 5284491, 6658042, 8388607, 10568983,
             13316085, 16777216)


class Bits:
    """Numbers from a stream of bits, the highest first."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def number(self, n: int) -> int:
        a, self.at = self.at, self.at + n
        b = self.at
        return (int.from_bytes(self.data[a >> 3:(b + 7) >> 3], "big") >> (-b & 7)) & ((1 << n) - 1)

    def triple(self, n: int, y: int, z: int) -> tuple[int, int, int]:
        """Three numbers in one of mixed base, whose bytes come lowest first and whose last bits come as they are."""
        rest = n & 7
        raw = self.number(n)
        value = int.from_bytes((raw >> rest).to_bytes(n >> 3, "big"), "little") | (raw & ((1 << rest) - 1)) << (n - rest)
        value, c = divmod(value, z)
        a, b = divmod(value, y)
        return a, b, c


class Xtc:
    """GROMACS frames of compressed coordinates."""

    HEAD = 56  # magic, atoms, step, time, nine of the box, atoms again

    def __init__(self, f):
        self.marker = f.read(8)
        self.atoms = struct.unpack(">i", self.marker[4:])[0]

    def find(self, f, start: int, end: int) -> int:
        def holds(at: int) -> bool:
            f.seek(at + 52)
            return f.read(4) == self.marker[4:]

        return _find(f, self.marker, start, end, holds)

    def frame(self, f, at: int, coordinates: bool) -> Frame:
        f.seek(at)
        magic, atoms, step, time = struct.unpack(">iiif", f.read(16))
        if magic not in (1995, 2023):
            raise ValueError(f"no XTC frame at byte {at}")
        cell = [v * 10.0 for v in struct.unpack(">9f", f.read(36))]
        f.seek(at + self.HEAD)
        if atoms <= 9:
            body = f.read(12 * atoms)
            out = Frame(at + self.HEAD + 12 * atoms, step, time, cell, atoms)
            out.xyz = np.frombuffer(body, ">f4").astype("float64").reshape(-1, 3) * 10.0 if coordinates else None
            return out
        precision, *head = struct.unpack(">f7i", f.read(32))
        size = struct.unpack(">q", f.read(8))[0] if magic == 2023 else struct.unpack(">i", f.read(4))[0]
        out = Frame(f.tell() + (size + 3) // 4 * 4, step, time, cell, atoms)
        if coordinates:
            out.xyz = self._unpack(f.read(size), atoms, head[:3], head[3:6], head[6]) * (10.0 / precision)
        return out

    @staticmethod
    def _unpack(data: bytes, atoms: int, low: list[int], high: list[int], index: int) -> np.ndarray:
        """Groups of one whole position and a run of small steps; the first step of a run leads back to the atom before the whole one."""
        bits, out = Bits(data), []
        span = [b - a + 1 for a, b in zip(low, high, strict=True)]
        apart = any(n > 0xFFFFFF for n in span)
        whole = (span[0] * span[1] * span[2]).bit_length()
        run = 0
        while len(out) < atoms:
            p = tuple(bits.number(n.bit_length()) for n in span) if apart else bits.triple(whole, span[1], span[2])
            p = (p[0] + low[0], p[1] + low[1], p[2] + low[2])
            change = 0
            if bits.number(1):
                run, change = divmod(bits.number(5), 3)
                change -= 1
            base, half = XTC_SIZES[index], XTC_SIZES[index] // 2
            last = p
            for k in range(run):
                d = bits.triple(index, base, base)
                last = (last[0] + d[0] - half, last[1] + d[1] - half, last[2] + d[2] - half)
                out.append(last)
                if not k:
                    out.append(p)
            if not run:
                out.append(p)
            index += change
        return np.array(out, dtype="float64")


class Dump:
    """LAMMPS text frames: the first of x, xs, xu, xsu that has all three axes, images if given, and tilted boxes."""

    MARKER = b"ITEM: TIMESTEP"

    def __init__(self, f):
        self.place, self.lines = -1, iter(())

    def find(self, f, start: int, end: int) -> int:
        return _find(f, self.MARKER, start, end)

    def frame(self, f, at: int, coordinates: bool) -> Frame:
        if self.place != at:  # frames that follow each other share what is read ahead
            f.seek(at)
            self.lines = _lines(f)
        lines = self.lines
        next(lines)
        step, atoms, box = int(next(lines)[0]), 0, np.zeros((3, 3))
        low = np.zeros(3)
        used = 0
        for line, end in lines:
            if line.startswith(b"ITEM: NUMBER OF ATOMS"):
                atoms = int(next(lines)[0])
            elif line.startswith(b"ITEM: BOX BOUNDS"):
                rows = [list(map(float, next(lines)[0].split())) for _ in range(3)]
                xy, xz, yz = (r[2] if len(r) > 2 else 0.0 for r in rows)
                lo = [rows[0][0] - min(0.0, xy, xz, xy + xz), rows[1][0] - min(0.0, yz), rows[2][0]]
                hi = [rows[0][1] - max(0.0, xy, xz, xy + xz), rows[1][1] - max(0.0, yz), rows[2][1]]
                low = np.array(lo)
                box = np.array([[hi[0] - lo[0], 0, 0], [xy, hi[1] - lo[1], 0], [xz, yz, hi[2] - lo[2]]])
            elif line.startswith(b"ITEM: ATOMS"):
                names, used = line.decode().split()[2:], end
                break
        out = Frame(used, step, float(step), [float(v) for v in box.ravel()], atoms)
        rows = [next(lines) for _ in range(atoms)]
        out.following = self.place = rows[-1][1] if rows else used
        if coordinates and rows:
            t = dict(zip(names, zip(*[r[0].split() for r in rows], strict=True), strict=False))
            kind = next(k for k in ("", "s", "u", "su") if all(f"{a}{k}" in t for a in "xyz"))
            p = np.array([t[f"{a}{kind}"] for a in "xyz"], dtype="float64").T
            p = p @ box if "s" in kind else p - low
            if all(f"i{a}" in t for a in "xyz") and "u" not in kind:
                p = p + np.array([t[f"i{a}"] for a in "xyz"], dtype="float64").T @ box
            ids = np.array(t["id"], dtype="int64") if "id" in t else np.arange(1, atoms + 1)
            order = np.argsort(ids, kind="stable")
            out.xyz, out.ids = p[order], ids[order]
        return out


def _lines(f) -> Iterator[tuple[bytes, int]]:
    """(line, where the next begins) from the present place on."""
    at, rest = f.tell(), b""
    while chunk := f.read(_CHUNK):
        *whole, rest = (rest + chunk).split(b"\n")
        for line in whole:
            at += len(line) + 1
            yield line.rstrip(b"\r"), at
    if rest:
        yield rest, at + len(rest)


KINDS = {"dcd": Dcd, "trr": Trr, "xtc": Xtc, "lammpstrj": Dump}


@dataclass
class Split(InputPartition):
    file: str
    start: int
    end: int


def _resolve(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


class FrameReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.kind = options["path"], options["kind"]
        self.split, self.coordinates = int(options.get("split", SPLIT)), options.get("coordinates", "true") == "true"

    def partitions(self) -> list[Split]:
        system, path = _resolve(self.path)
        info = system.get_file_info(path)
        files = [info] if info.type == fs.FileType.File else [i for i in system.get_file_info(fs.FileSelector(path)) if i.type == fs.FileType.File]
        return [Split(i.path, a, min(i.size, a + self.split)) for i in sorted(files, key=lambda i: i.path) for a in range(0, i.size, self.split)]

    def read(self, part: Split) -> Iterator[pa.RecordBatch]:
        system, _ = _resolve(self.path)
        with system.open_input_file(part.file) as f:
            size, form = f.size(), KINDS[self.kind](f)
            at = form.find(f, part.start, part.end)
            while at < part.end and at < size:
                try:
                    frame = form.frame(f, at, self.coordinates)
                except (struct.error, ValueError, StopIteration) as e:
                    raise ValueError(f"{part.file} ends within the frame at byte {at}, or is damaged there: {e!r}") from e
                if frame.following > size:
                    raise ValueError(f"{part.file} ends within the frame at byte {at}")
                n = (0 if frame.xyz is None else len(frame.xyz)) if self.coordinates else 1
                if n:
                    cell = pa.array([frame.cell], pa.list_(pa.float64()))
                    columns = [pa.array([part.file] * n), pa.array(np.full(n, at)), pa.array(np.full(n, frame.step, "int64")), pa.array(np.full(n, frame.time, "float64")), cell.take(pa.array(np.zeros(n, "int64")))]
                    names = ["file", "offset", "step", "time", "cell"]
                    if self.coordinates:
                        columns += [pa.array(np.arange(1, n + 1) if frame.ids is None else frame.ids), *[pa.array(np.ascontiguousarray(frame.xyz[:, k])) for k in range(3)]]
                        names += ["atom_idx", "x", "y", "z"]
                    else:
                        columns.append(pa.array([frame.atoms], pa.int64()))
                        names.append("atoms")
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                at = frame.following


class FrameSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "orrery_frames"

    def schema(self) -> str:
        head = "file string, offset bigint, step bigint, time double, cell array<double>, "
        return head + ("atom_idx bigint, x double, y double, z double" if self.options.get("coordinates", "true") == "true" else "atoms bigint")

    def reader(self, schema) -> FrameReader:
        return FrameReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FrameSource)


def read(spark: SparkSession, path: str, kind: str, split: int = SPLIT) -> DataFrame:
    """Rows of atoms; a file without frames gives none, one that ends within a frame is refused."""
    return spark.read.format("orrery_frames").options(path=path, kind=kind, split=str(split)).load()


def index(spark: SparkSession, path: str, kind: str, split: int = SPLIT) -> DataFrame:
    """One row for each frame, numbered from 0 within its file."""
    found = spark.read.format("orrery_frames").options(path=path, kind=kind, split=str(split), coordinates="false").load()
    return found.withColumn("frame", (F.row_number().over(Window.partitionBy("file").orderBy("offset")) - 1).cast("int"))


def trajectory(spark: SparkSession, path: str, kind: str, split: int = SPLIT) -> DataFrame:
    """(file, frame, atom_idx, x, y, z)."""
    return read(spark, path, kind, split).join(index(spark, path, kind, split).select("file", "offset", "frame"), ["file", "offset"]).select("file", "frame", "atom_idx", "x", "y", "z")

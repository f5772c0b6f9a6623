"""The data model: flags, element data and the bundle of tables that a system is."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

POLYMER, BACKBONE, AMINO_ACID, SIDE_CHAIN = 0x2, 0x4, 0x200, 0x400
NUCLEIC_ACID, NUCLEOTIDE, NUCLEOSIDE, NUCLEOBASE = 0x800, 0x1000, 0x2000, 0x4000
HETERO, WATER, ION = 0x10000, 0x20000, 0x40000


@dataclass(frozen=True)
class System:
    """Topology and coordinates as DataFrames.

    atoms(atom_idx from 1, type, element, z, mass, radius, flags, comp_idx), components(comp_idx, name, seq_id, flags, inst_idx),
    instances(inst_idx, id, auth_id, flags), bonds(i, j), trajectory(frame, atom_idx, x, y, z), frames(frame, time) if known; ``cell`` holds the lengths of an
    orthorhombic cell, 0 for an axis without a period.
    """

    atoms: DataFrame
    components: DataFrame
    instances: DataFrame
    bonds: DataFrame
    trajectory: DataFrame
    cell: tuple[float, float, float] = (0.0, 0.0, 0.0)
    frames: DataFrame | None = None

"""Names of residues, elements and chains, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: residue names of each class
AMINO_ACIDS = ("ACE", "ALA", "ARG", "ASC", "ASN", "ASP", "ASX", "CYS", "CYX", "FOR", "GLN", "GLU", "GLX", "GLY", "HIS", "HYP", "HISE", "ILE", "LEU", "LYS", "MET", "PHE", "PRO", "PCA", "PYL",
               "SER", "THR", "TRP", "TYR", "VAL", "SEC", "XLE", "UNK", "MSE", "SEP", "TPO", "PTR", "HSD", "HSP", "LSN", "ASPP", "GLUP", "HID", "HIE", "HIP", "LYN", "ASH", "GLH")
RNA = ("A", "C", "T", "G", "I", "U", "N")
DNA = ("DA", "DC", "DT", "DG", "DI", "DU", "DN")
ACIDIC = ("ASP", "GLU")
BASIC = ("ARG", "HIS", "LYS")
NEUTRAL = ("VAL", "PHE", "GLN", "TYR", "HIS", "CYS", "MET", "TRP", "ASX", "GLX", "PCA", "HYP")
WATER = ("H2O", "HHO", "OHH", "HOH", "OH2", "SOL", "WAT", "TIP", "TIP2", "TIP3", "TIP4", "TIP5", "W", "DOD", "D30", "SPC")
HYDROPHOBIC = ("ALA", "VAL", "ILE", "LEU", "MET", "PHE", "TYR", "TRP", "CYX")
IONS = ("NA", "K", "CA", "MG", "ZN", "CL", "F", "MN", "FE", "CU", "CO", "NI", "CD", "BR", "I", "CS", "SR")
CLASSES = {"amino_acid": AMINO_ACIDS, "rna": RNA, "dna": DNA, "nucleotide": RNA + DNA, "acidic": ACIDIC, "basic": BASIC, "neutral": NEUTRAL, "water": WATER, "hydrophobic": HYDROPHOBIC, "ion": IONS}

# fixed values: the elements by atomic number, from 1
SYMBOLS = ("H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb "
           "Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og").split()
# fixed values: standard atomic masses, in the same order as far as uranium
MASSES = (1.008, 4.002602, 6.94, 9.0121831, 10.81, 12.011, 14.007, 15.999, 18.998403163, 20.1797, 22.98976928, 24.305, 26.9815385, 28.085, 30.973761998, 32.06, 35.45, 39.948, 39.0983, 40.078, 44.955908, 47.867, 50.9415,
          51.9961, 54.938044, 55.845, 58.933194, 58.6934, 63.546, 65.38, 69.723, 72.630, 74.921595, 78.971, 79.904, 83.798, 85.4678, 87.62, 88.90584, 91.224, 92.90637, 95.95, 98.0, 101.07, 102.90550, 106.42, 107.8682,
          112.414, 114.818, 118.710, 121.760, 127.60, 126.90447, 131.293, 132.90545196, 137.327, 138.90547, 140.116, 140.90766, 144.242, 145.0, 150.36, 151.964, 157.25, 158.92535, 162.500, 164.93033, 167.259, 168.93422,
          173.045, 174.9668, 178.49, 180.94788, 183.84, 186.207, 190.23, 192.217, 195.084, 196.966569, 200.592, 204.38, 207.2, 208.98040, 209.0, 210.0, 222.0, 223.0, 226.0, 227.0, 232.0377, 231.03588, 238.02891)


def in_class(name: Column, kind: str) -> Column:
    """Whether a residue name belongs to a class; null: false."""
    return F.coalesce(F.upper(name).isin(*CLASSES[kind]), F.lit(False))


def z_of_symbol(symbol: Column, ignore_case: bool = True) -> Column:
    """The atomic number; 0 for an unknown symbol or null."""
    at = F.create_map(*[x for i, s in enumerate(SYMBOLS, 1) for x in (F.lit(s.upper() if ignore_case else s), F.lit(i))])
    return F.coalesce(F.try_element_at(at, F.upper(symbol) if ignore_case else symbol), F.lit(0))


def symbol_of_z(z: Column) -> Column:
    """The symbol; null outside the table."""
    return F.get(F.array(*map(F.lit, SYMBOLS)), (z - 1).cast("int"))


def mass_of_z(z: Column) -> Column:
    """The standard mass; null outside the table."""
    return F.get(F.array(*map(F.lit, MASSES)), (z - 1).cast("int"))


def z_of_mass(mass: Column) -> Column:
    """The first element whose mass is nearer than 0.001, or a hundred-thousandth of the mass where that is more; 0 if none.

    A mass of exactly 1 stands for no element, as coarse models use it.
    """
    near = F.greatest(F.lit(1.0), mass / 100) * 0.001
    at = F.array_position(F.transform(F.array(*map(F.lit, MASSES)), lambda m: F.abs(m - mass) < near), True)
    return F.when(mass.isNull() | (mass == 1.0), 0).otherwise(at).cast("int")


def z_of_label(label: Column, residue: Column, size: Column) -> Column:
    """The atomic number that an atom's label tells, given its residue's name and number of atoms; 0 if none.

    A label's leading digit does not count.  No label: the residue's name, as ions are named.  In water, amino acids and
    nucleotides the first letter tells; a label equal to its residue's name is that element; in larger residues two letters
    count only in the element's own case, elsewhere in any.
    """
    label = F.regexp_replace(F.coalesce(label, F.lit("")), r"^\d", "")
    residue = F.coalesce(residue, F.lit(""))
    one, two = F.substring(label, 1, 1), F.substring(label, 1, 2)
    known = lambda z: F.when(z > 0, z)
    polymer = in_class(residue, "water") | in_class(residue, "amino_acid") | in_class(residue, "nucleotide")
    return F.when(label == "", z_of_symbol(residue)).otherwise(F.coalesce(
        F.when(polymer, known(z_of_symbol(one))), F.when(F.upper(label) == F.upper(residue), known(z_of_symbol(residue))),
        F.when(size > 2, F.coalesce(known(z_of_symbol(two, False)), known(z_of_symbol(one)))), F.when(F.length(label) >= 2, known(z_of_symbol(two))), z_of_symbol(one)))


def chain_id(index: Column) -> Column:
    """0: A, 25: Z, 26: AA, and so on."""
    n, letters = index.cast("long") + 1, []
    for _ in range(7):  # enough for any 32-bit index
        letters.insert(0, F.when(n > 0, F.char((n - 1) % 26 + 65)).otherwise(""))
        n = F.floor((n - 1) / 26)
    return F.concat(*letters)

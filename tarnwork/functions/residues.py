"""Residue and atom name rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Three-letter codes of residues, with common protonation and modification variants.
ONE_LETTER = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
    "HID": "H", "HIE": "H", "HIP": "H", "HSD": "H", "HSE": "H", "HSP": "H", "CYX": "C", "CYM": "C", "ASH": "D", "GLH": "E",
    "LYN": "K", "MSE": "M", "SEP": "S", "TPO": "T", "PTR": "Y", "SEC": "U", "PYL": "O", "HISD": "H", "HISE": "H", "HISP": "H",
    "AS4": "D", "GL4": "E", "ARN": "R", "CSP": "C", "ASX": "D",
}
#: Groups that cap a chain, and counted to it.
CAPS = ("ACE", "NME", "NMA", "NH2")
#: Residue names of water.
WATER = ("HOH", "WAT", "SOL", "H2O", "TIP3")


def one_letter(resname: Column, custom: dict[str, str] | None = None) -> Column:
    """One-letter code; X for an unknown residue."""
    table = F.create_map(*[F.lit(x) for pair in (ONE_LETTER | (custom or {})).items() for x in pair])
    return F.coalesce(F.element_at(table, F.upper(resname)), F.lit("X"))


def is_water(resname: Column, name: str | None = None) -> Column:
    return resname == name if name else resname.isin(*WATER)


def is_protein(resname: Column) -> Column:
    return resname.isin(*ONE_LETTER, *CAPS)


def is_polar(name: Column) -> Column:
    return name.rlike("^[NOPS]")


def is_heavy(name: Column) -> Column:
    """Heavy if the name contains P, O, N or S, else a hydrogen if it contains H."""
    return name.rlike("[PONS]")


def backbone(name: Column) -> Column:
    return F.when(name.isin("O", "N"), F.lit("backbone")).otherwise(F.lit("side-chain"))


def backbone_donor(name: Column) -> Column:
    return F.when(name.isin("H", "HA"), F.lit("backbone")).otherwise(F.lit("side-chain"))

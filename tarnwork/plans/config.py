"""Run configuration: ``key: value ; comment`` files and their checks."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, fields

METRICS = ("density", "connected_components", "interaction_counts", "per_residue_interactions", "characteristic_path_length", "graph_entropy", "clustering_coefficient", "save_coordinates")
_ALIASES = {"concatemate": "concatenate", "multi_model": "multi_model_pdb"}


@dataclass
class Config:
    structure_type: str = "static"
    structure_directory: str = "."
    topology_file: str | None = None
    trajectory_file: str | None = None
    network_type: str = "water-protein"
    include_hydrogens: bool = False
    water_name: str | None = None
    custom_selection: str | None = None
    max_distance: float = 3.3
    max_neighbors: int = 10
    angle_criteria: float | None = None
    directed: bool = False
    active_region_reference: str | None = None
    active_region_radius: float = 8.0
    active_region_only: bool = False
    active_region_com: bool = False
    multi_model_pdb: bool = False
    msa_indexing: bool = False
    fasta: str | None = None
    alignment_file: str | None = None
    classify_water: bool = False
    classification_reference1: tuple[float, ...] = (0.0, 10.0, 0.0)
    classification_reference2: tuple[float, ...] = (10.0, 0.0, 10.0)
    cluster_coordinates: bool = False
    clustering_method: str = "hdbscan"
    eps: float | None = None
    min_cluster_samples: int = 15
    selection: str = "all"
    analysis_conditions: dict = field(default_factory=lambda: {"all": True})

    def wants(self, metric: str) -> bool:
        return bool(self.analysis_conditions.get(metric, self.analysis_conditions.get("all", False)))

    def check(self) -> Config:
        if self.max_neighbors < 2:
            raise ValueError("max_neighbors must be at least 2")
        if self.network_type not in ("water-protein", "water-water"):
            raise ValueError("network_type is water-protein or water-water")
        if self.structure_type not in ("static", "dynamic"):
            raise ValueError("structure_type is static or dynamic")
        if self.structure_type == "static" and self.multi_model_pdb:
            raise ValueError("multi-model files are dynamic")
        if self.structure_type == "dynamic" and self.trajectory_file and not self.topology_file:
            raise ValueError("a trajectory needs a topology")
        if self.clustering_method not in ("hdbscan", "dbscan", "optics"):
            raise ValueError("clustering_method is hdbscan, dbscan or optics")
        if self.clustering_method == "dbscan" and self.cluster_coordinates and not self.eps:
            raise ValueError("dbscan needs eps")
        if tuple(self.classification_reference1) == tuple(self.classification_reference2):
            raise ValueError("the two classification references must differ")
        return self


def _value(text: str):
    low = text.lower()
    if low in ("on", "true", "yes"):
        return True
    if low in ("off", "false", "no"):
        return False
    if low in ("none", ""):
        return None
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text.replace("#", " ")


def read_pairs(text: str) -> list[tuple[str, str]]:
    """(key, raw value) of every line; what follows ';' is comment, and lines without ':' say nothing."""
    out = []
    for line in text.splitlines():
        key, colon, value = line.split(";")[0].partition(":")
        if colon and key.strip():
            out.append((key.strip(), value.strip()))
    return out


def parse_inputs(text: str) -> Config:
    """A configuration; keys that are metrics go to analysis_conditions, active_site_* means active_region_*."""
    known = {f.name: f for f in fields(Config)}
    config, conditions = Config(), {}
    for key, raw in read_pairs(text):
        key = _ALIASES.get(key, key).replace("active_site_", "active_region_")
        if key in METRICS or key == "all" or key == "shortest_path":
            conditions[key] = bool(_value(raw))
        elif key.startswith("classification_reference"):
            setattr(config, key, tuple(float(v) for v in raw.replace(",", " ").split()))
        elif key in known:
            value = _value(raw)
            if isinstance(known[key].default, float) and isinstance(value, int) and not isinstance(value, bool):
                value = float(value)
            setattr(config, key, value)
        else:
            warnings.warn(f"unknown key {key!r} is left out", stacklevel=2)
    if conditions:
        config.analysis_conditions = conditions
    return config.check()


def parse_analysis(text: str) -> dict:
    """Flags of the post-analysis; comma lists become lists."""
    out = {}
    for key, raw in read_pairs(text):
        key = _ALIASES.get(key, key)
        out[key] = [_value(v.strip()) for v in raw.split(",")] if "," in raw else _value(raw)
    return out

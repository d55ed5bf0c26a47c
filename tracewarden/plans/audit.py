"""The audit of many skills at once."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame

from tracewarden.operators import findings as fs
from tracewarden.operators import line_rules, manifests, skill_rules
from tracewarden.operators.corpus import skills

Detector = Callable[[DataFrame], DataFrame]

#: Detectors by name; add one with ``register``.
REGISTRY: dict[str, Detector] = {
    "credential_detector": line_rules.credentials,
    "obfuscation_detector": line_rules.obfuscation,
    "permission_scanner": skill_rules.permissions,
    "typosquat_checker": skill_rules.names,
    "dependency_scanner": manifests.dependencies,
    "network_destination_analyzer": line_rules.network,
    "exfiltration_detector": line_rules.exfiltration,
    "prompt_injection_detector": line_rules.injection,
    "runner": skill_rules.pre_flight,
}


def register(name: str, detector: Detector) -> None:
    """Adds a detector: a function from files to findings."""
    REGISTRY[name] = detector


#: What detectors find beside their line rules, which share one pass.
BESIDE: dict[str, list[Detector]] = {
    "credential_detector": [],
    "obfuscation_detector": [line_rules.ast_calls],
    "network_destination_analyzer": [],
    "prompt_injection_detector": [line_rules.injection_files],
}


def findings(files: DataFrame) -> DataFrame:
    """All findings of all detectors.

    The detectors that judge lines by themselves share one pass over the files; each other one has its own.
    Persist or stage ``files`` where reading it is expensive.
    """
    parts = [line_rules.by_line(files)]
    for name, detector in REGISTRY.items():
        parts += [d(files) for d in BESIDE.get(name, [detector])]
    return reduce(DataFrame.unionByName, parts)


def audit(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings, reports)."""
    found = findings(files)
    return found, fs.reports(skills(files), found)

"""Typed settings: code defaults, then a TOML experiment, then environment variables. Nothing is global or mutable."""

from __future__ import annotations

import logging
import os
import re
import tomllib
from dataclasses import dataclass, fields, replace

PREFIX = "HELIXFRAME"


@dataclass(frozen=True)
class EngineConfig:
    target_gene: str = "PRODUCT-TG"
    methods: tuple[str, ...] = ("pearson", "spearman", "kendall", "regression")
    min_correlation: float = 0.5
    max_p_value: float = 0.05
    top_n: int = 50
    run_bootstrap: bool = True
    bootstrap_iterations: int = 1000
    confidence_level: float = 0.95
    panel_sizes: tuple[int, ...] = (3, 5, 10)
    panel_types: tuple[str, ...] = ("minimal_redundancy", "max_score")
    panel_candidates: int = 100
    trigger_pct: float = 20.0
    advanced_alpha: float = 0.01
    constant_expression_cv_threshold: float = 0.3
    kmer_size: int = 6
    correct_batches: bool = True
    selection: str = "statistical"
    max_features: int = 15

    def with_values(self, values: dict[str, object]) -> EngineConfig:
        """Text is read by the default's type; a value that cannot be read raises."""
        known = {f.name: getattr(self, f.name) for f in fields(self)}
        return replace(self, **{k: _read(v, known[k]) for k, v in values.items() if k in known})

    def from_env(self) -> EngineConfig:
        return self.with_values({f.name: v for f in fields(self) if (v := os.environ.get(f"{PREFIX}_{f.name.upper()}")) is not None})

    def from_toml(self, path: str, number: int) -> EngineConfig:
        return self.with_values({k.lower(): v for k, v in experiments(path)[number].items()})


def experiments(path: str) -> dict[int, dict]:
    """The [experiment.N] tables by N."""
    with open(path, "rb") as f:
        return {int(k): v for k, v in tomllib.load(f).get("experiment", {}).items()}


#: What a truth value may be written as.
TRUE, FALSE = frozenset("1 t true y yes".split()), frozenset("0 f false n no".split())


def _read(value: object, default: object) -> object:
    if isinstance(default, bool):
        text = str(value).strip().lower()
        if text in TRUE or text in FALSE:
            return text in TRUE
        raise ValueError(f"not a truth value: {value!r}")
    if isinstance(default, tuple):
        parts = value if isinstance(value, (list, tuple)) else [x.strip() for x in str(value).split(",") if x.strip()]
        return tuple(type(default[0])(x) for x in parts)
    return type(default)(value)


@dataclass(frozen=True)
class Layout:
    """Where files are: folders by name under the data and results folders, and data files by name."""

    data: str = "data"
    results: str = "results"
    folders: tuple[tuple[str, str], ...] = (("raw", "{data}/raw"), ("preprocessed", "{data}/preprocessed"), ("figures", "{results}/figures"), ("tables", "{results}/tables"), ("logs", "{results}/logs"))
    files: tuple[tuple[str, str], ...] = (("expression", "expression.tsv"), ("manifest", "manifest.tsv"), ("cds", "cds.fa"), ("utr5", "utr5.fa"), ("utr3", "utr3.fa"))

    def folder(self, name: str) -> str:
        """The folder ``name``; raises KeyError for one that is not in the layout."""
        known = {"data": self.data, "results": self.results} | {k: v.format(data=self.data, results=self.results) for k, v in self.folders}
        return known[name]

    def file(self, name: str) -> str:
        """A file of the raw folder by name; raises KeyError for one that is not in the layout."""
        return f"{self.folder('raw')}/{dict(self.files)[name]}"


def patterns(defaults: dict[str, str], values: dict[str, str]) -> dict[str, str]:
    """``defaults`` with the patterns of ``values`` (or of environment variables HELIXFRAME_PATTERN_NAME); one that is no
    regular expression is reported and its default stays."""
    out = dict(defaults)
    for name in defaults:
        given = values.get(name) or os.environ.get(f"{PREFIX}_PATTERN_{name.upper()}")
        if not given:
            continue
        try:
            re.compile(given)
            out[name] = given
        except re.error as e:
            logging.getLogger("helixframe").warning("pattern %s: %s; the default stays", name, e)
    return out

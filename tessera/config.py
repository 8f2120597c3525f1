"""Settings: defaults, overridden by a YAML or JSON file, then by the environment."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields, replace
from pathlib import Path

PREFIX = "TESSERA_"


@dataclass(frozen=True)
class Settings:
    corpus_version: str = "v1"
    embedding_model: str = "stub-hash-64"
    reranker_version: str = "none"
    fusion: str = "rrf"
    k1: float = 1.5
    b: float = 0.75
    rrf_k: int = 60
    candidates_per_arm: int = 30
    candidate_k: int = 20
    top_k: int = 5
    writer_top_k: int = 5
    deadline_seconds: float = 10.0  # 0: none
    chunk_target: int = 350
    chunk_overlap: int = 60
    chunk_least: int = 80
    chunk_most: int = 700

    def stamps(self) -> dict[str, str]:
        return {"corpus_version": self.corpus_version, "embedding_model": self.embedding_model, "reranker_version": self.reranker_version}


def load(path: str | None = None, env: dict[str, str] | None = None) -> Settings:
    """Unknown names in the file are an error; so are values of another kind."""
    values: dict = {}
    if path:
        text = Path(path).read_text()
        if path.endswith((".yaml", ".yml")):
            import yaml

            values = yaml.safe_load(text) or {}
        else:
            values = json.loads(text)
    env = os.environ if env is None else env
    kinds = {f.name: type(f.default) for f in fields(Settings)}
    unknown = set(values) - set(kinds)
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    for name in kinds:
        if PREFIX + name.upper() in env:
            values[name] = env[PREFIX + name.upper()]
    return replace(Settings(), **{k: kinds[k](v) for k, v in values.items()})

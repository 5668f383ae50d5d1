"""Settings: strict, from a mapping, JSON or YAML; unknown keys are errors."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields, is_dataclass
from functools import lru_cache
from urllib.parse import urlparse


@dataclass(frozen=True)
class Parsing:
    min_unit_chars: int = 30
    separator: str = "\n\n"
    retries: int = 3
    backoff_seconds: float = 1.0


@dataclass(frozen=True)
class Chunking:
    max_tokens: int = 400
    overlap_tokens: int = 60
    min_chunk_tokens: int = 50
    min_indexed_tokens: int = 15
    tokenizer: str = "words"

    def __post_init__(self):
        if self.overlap_tokens >= self.max_tokens:
            raise ValueError("overlap_tokens must be smaller than max_tokens")


@dataclass(frozen=True)
class Retrieval:
    prefetch: int = 100
    rrf_k: float = 2
    limit: int = 10
    model: str = "words"
    k1: float = 1.2
    b: float = 0.75


@dataclass(frozen=True)
class Evaluation:
    relevance: float = 0.5
    success_at: tuple[int, ...] = (1, 3, 5, 10)
    resamples: int = 10_000
    seed: int = 42


@dataclass(frozen=True)
class Services:
    parser_url: str = "http://localhost:8070"
    llm_url: str = "http://localhost:11434/v1"
    contact: str = "nobody@example.org"

    def __post_init__(self):
        for url in (self.parser_url, self.llm_url):
            if urlparse(url).scheme not in ("http", "https") or not urlparse(url).netloc:
                raise ValueError(f"not an address: {url}")
        if self.contact.count("@") != 1 or "." not in self.contact.split("@")[1]:
            raise ValueError(f"not an e-mail address: {self.contact}")


@dataclass(frozen=True)
class Config:
    parsing: Parsing = field(default_factory=Parsing)
    chunking: Chunking = field(default_factory=Chunking)
    retrieval: Retrieval = field(default_factory=Retrieval)
    evaluation: Evaluation = field(default_factory=Evaluation)
    services: Services = field(default_factory=Services)

    def __post_init__(self):
        if self.chunking.tokenizer != self.retrieval.model:
            raise ValueError("chunks must be counted by the retrieval model's tokenizer")


def build(kind, values: dict):
    known = {f.name: f for f in fields(kind)}
    if extra := set(values) - set(known):
        raise ValueError(f"unknown settings: {', '.join(sorted(extra))}")
    made = {}
    for name, value in values.items():
        default = known[name].default_factory() if callable(known[name].default_factory) else None  # type: ignore[misc]
        made[name] = build(type(default), value) if is_dataclass(default) else tuple(value) if isinstance(value, list) else value
    return kind(**made)


def load(path: str | None = None) -> Config:
    """From a file (.json, .yaml), then SPARLEX_<SECTION>_<NAME> in the environment."""
    values: dict = {}
    if path:
        with open(path, encoding="utf-8") as f:
            if path.endswith(".json"):
                values = json.load(f)
            else:
                import yaml

                values = yaml.safe_load(f) or {}
    for section in fields(Config):
        kind = type(section.default_factory())  # type: ignore[misc]
        for item in fields(kind):
            if (raw := os.environ.get(f"SPARLEX_{section.name}_{item.name}".upper())) is not None:
                values.setdefault(section.name, {})[item.name] = raw if isinstance(item.default, str) else json.loads(raw)
    return build(Config, values)


@lru_cache(maxsize=1)
def current() -> Config:
    return load(os.environ.get("SPARLEX_CONFIG"))

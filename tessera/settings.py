"""Settings: defaults, overlaid by a JSON file, the environment and the command line, in that order; checked once."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, fields, replace

PREFIX = "TESSERA_"


@dataclass(frozen=True)
class Settings:
    target_tokens: int = 500
    preferred_max_tokens: int = 600
    hard_max_tokens: int = 768
    overlap_tokens: int = 50
    dense_top: int = 10
    sparse_top: int = 10
    candidate_top: int = 10
    top_k: int = 5
    relevance_threshold: float | None = None
    max_question_chars: int = 2000
    max_answer_chars: int = 4000
    memory_turns: int = 6
    memory_chars: int = 6000
    allow_egress: bool = False

    def __post_init__(self):
        if not 0 <= self.overlap_tokens < self.target_tokens <= self.preferred_max_tokens <= self.hard_max_tokens:
            raise ValueError("token budgets must rise from overlap to hard maximum")
        for name in ("dense_top", "sparse_top", "candidate_top", "top_k", "max_question_chars", "max_answer_chars", "memory_turns", "memory_chars"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        if self.relevance_threshold is not None and not -1 <= self.relevance_threshold <= 1:
            raise ValueError("relevance_threshold is a cosine")


def _typed(name: str, value):
    """A value from text, by the field's default type; unknown names are an error."""
    kinds = {f.name: f.type for f in fields(Settings)}
    if name not in kinds:
        raise ValueError(f"unknown setting {name}")
    if not isinstance(value, str):
        return value
    kind = kinds[name]
    if kind == "bool":
        return value.strip().lower() in ("1", "true", "yes")
    if "float" in kind:
        return None if value.strip().lower() in ("", "none", "null") else float(value)
    return int(value)


def load(path: str | None = None, environ: dict[str, str] | None = None, **given) -> Settings:
    """Command line (``given``, None: not given) over environment over file over defaults."""
    layers: dict = {}
    if path:
        with open(path) as file:
            layers.update(json.load(file))
    env = os.environ if environ is None else environ
    layers.update({k[len(PREFIX) :].lower(): v for k, v in env.items() if k.startswith(PREFIX)})
    layers.update({k: v for k, v in given.items() if v is not None})
    return replace(Settings(), **{k: _typed(k, v) for k, v in layers.items()})


def require_egress(settings: Settings, destination: str) -> None:
    """Refuses to send document content anywhere unless that has been allowed."""
    if not settings.allow_egress:
        raise PermissionError(f"sending content to {destination} is not allowed; set allow_egress")


def shown(settings: Settings) -> dict:
    return asdict(settings)

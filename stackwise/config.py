"""Configuration that changes results: defaults, clamps and merging."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, fields, replace
from typing import Any

PROVIDERS = ("openai", "ollama", "local", "none")
MODES = ("auto", "hybrid", "vector", "lexical")
SOURCE_TYPES = ("text", "file", "url", "directory")
ERROR_CODES = ("interrupted", "dimension_mismatch", "parse_failed", "embedding_provider")
STATUSES = ("pending", "processing", "completed", "failed")
CONFLICTS = ("rename", "replace", "keep", "detect")


def clamp_int(value: Any, low: int, high: int, default: int) -> int:
    """Truncated and clamped; what is no finite number gives the default."""
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        return default
    return max(low, min(high, math.trunc(value)))


def clamp_number(value: Any, low: float, high: float, default: float) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        return default
    return max(low, min(high, float(value)))


@dataclass(frozen=True)
class Config:
    embedding_provider: str = "none"
    embedding_model: str = ""
    chunk_size: int = 1024
    chunk_overlap: int = 200
    top_k: int = 6
    search_mode: str = "auto"
    similarity_threshold: float = 0.0
    mmr_lambda: float = 0.0
    rrf_vector_weight: float = 1.0
    embedding_batch: int = 32
    sibling_chunks: int = 1
    smart_chunk: bool = True
    separator: str = ""
    semantic_chunk: bool = False
    semantic_threshold: float = 0.75
    chunk_token_limit: int = 0
    conflict: str = "rename"
    url_refresh_hours: int = 0
    rerank_model: str = ""

    @property
    def model_tag(self) -> str | None:
        """provider:model, the name under which vectors are stored."""
        return f"{self.embedding_provider}:{self.embedding_model}" if self.embedding_provider != "none" and self.embedding_model else None


# name: (low, high) of the clamped numbers
_INTS = {"chunk_size": (64, 100_000), "top_k": (1, 50), "embedding_batch": (1, 512), "sibling_chunks": (0, 3), "chunk_token_limit": (0, 100_000), "url_refresh_hours": (0, 8760)}
_NUMBERS = {"similarity_threshold": (0.0, 1.0), "mmr_lambda": (0.0, 1.0), "semantic_threshold": (0.0, 1.0), "rrf_vector_weight": (0.1, 5.0)}
_CHOICES = {"embedding_provider": PROVIDERS, "search_mode": MODES, "conflict": CONFLICTS}


def compact(values: dict[str, Any]) -> dict[str, Any]:
    """Without blanks and absent values."""
    return {k: v for k, v in values.items() if v is not None and not (isinstance(v, str) and not v.strip())}


def merge_base(existing: dict[str, Any], patch: dict[str, Any]) -> dict[str, Any]:
    """A patch over a base's overrides; a blank string clears an override, an absent value leaves it."""
    out = dict(existing)
    for k, v in patch.items():
        if v is None:
            continue
        if isinstance(v, str) and not v.strip():
            out.pop(k, None)
        else:
            out[k] = v
    return out


def resolve(*layers: dict[str, Any] | None) -> Config:
    """Defaults under the layers, the last one strongest; numbers clamped, unknown keys and values left out."""
    known = {f.name for f in fields(Config)}
    default = asdict(Config())
    values = dict(default)
    for layer in layers:
        values.update({k: v for k, v in compact(layer or {}).items() if k in known})
    for k, (low, high) in _INTS.items():
        values[k] = clamp_int(values[k], low, high, default[k])
    values["chunk_overlap"] = clamp_int(values["chunk_overlap"], 0, values["chunk_size"] - 1, min(default["chunk_overlap"], values["chunk_size"] - 1))
    for k, (low, high) in _NUMBERS.items():
        values[k] = clamp_number(values[k], low, high, default[k])
    for k, allowed in _CHOICES.items():
        if values[k] not in allowed:
            values[k] = default[k]
    return replace(Config(), **values)


# Parts of model names, and how such a family's token vectors become one.
POOLING = (("qwen3", "last_token"), ("bge", "cls"), ("bce", "cls"))


def pooling(model: str) -> str:
    name = model.lower()
    return next((how for part, how in POOLING if part in name), "mean")

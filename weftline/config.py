"""Defaults of the engine. Fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    # fixed chunks and retrieval
    chunk_words: int = 256
    chunk_overlap: int = 32
    token_budget: int = 4096
    top_k: int = 20
    hops: int = 2
    rrf_k: int = 60
    # adaptive chunks
    window: int = 16
    threshold: float = 0.35
    min_chunk: int = 16
    max_chunk: int = 512
    # prefix alignment
    block: int = 16
    block_by_backend: dict[str, int] = field(default_factory=lambda: {"ollama": 32, "vllm": 16, "sglang": 16})
    # zones
    total_tokens: int = 4096
    tail_tokens: int = 1024
    retention: int = 3
    # selection and graph
    alpha: float = 0.5
    beta: float = 0.5
    max_hops: int = 3
    transitive_weight: float = 0.5
    # memory
    decay: float = 0.05
    depth_bonus: float = 0.5
    memory_share: float = 0.15
    # facts
    fact_weight: float = 0.8
    fact_in_degree: int = 2
    facts_per_session: int = 50
    facts_loaded: int = 1000
    facts_shown: int = 5
    # tool output
    tool_tokens: int = 512
    list_items: int = 3
    dict_keys: int = 20
    string_chars: int = 200
    skeleton_keys: int = 15
    # telemetry
    ring: int = 500
    replay: int = 30
    persist_every: int = 5
    tuples_persisted: int = 200

    def block_of(self, backend: str | None) -> int:
        """Tokens in a block of a backend's prefix cache."""
        return self.block_by_backend.get((backend or "").lower(), self.block)

    def __post_init__(self) -> None:
        if self.total_tokens < 1 or self.tail_tokens > self.total_tokens:
            raise ConfigError("the tail must fit into a positive total")
        if abs(self.alpha + self.beta - 1) > 1e-6:
            raise ConfigError("alpha and beta must add up to 1")
        if self.block not in (16, 32):
            raise ConfigError("a block has 16 or 32 tokens")


class EngineError(Exception):
    """Base of errors raised on the driver."""


class ConfigError(EngineError):
    """A setting that can't be used."""


class InputError(EngineError):
    """An input that can't be read."""


DEFAULT = Config()

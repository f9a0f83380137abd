"""Configuration: defaults, overrides, validation and a masked summary."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace


@dataclass(frozen=True)
class Search:
    vector_weight: float = 0.6
    text_weight: float = 0.4
    limit: int = 8
    rerank: bool = True


@dataclass(frozen=True)
class Chunking:
    max_chunk_size: int = 1500
    parser_limit: int = 32_768
    embed_limit: int = 20_000
    context_margin: int = 100
    window_lines: int = 100


@dataclass(frozen=True)
class Config:
    search: Search = field(default_factory=Search)
    chunking: Chunking = field(default_factory=Chunking)
    api_key: str = ""
    dim: int = 64

    def override(self, **parts: dict) -> Config:
        """A copy with single fields of single parts replaced; the rest of a part stays."""
        made = {k: replace(getattr(self, k), **v) if isinstance(v, dict) else v for k, v in parts.items()}
        return replace(self, **made)

    @classmethod
    def from_environment(cls, values: dict[str, str]) -> Config:
        """The defaults with what the environment's variables set; an empty value sets nothing."""
        def chosen(part, names: dict[str, tuple[str, Callable]]):
            return replace(part, **{field_: kind(values[name]) for name, (field_, kind) in names.items() if values.get(name)})

        truth = lambda x: x.strip().lower() in ("1", "true", "yes")
        search = chosen(Search(), {"LOAM_VECTOR_WEIGHT": ("vector_weight", float), "LOAM_TEXT_WEIGHT": ("text_weight", float), "LOAM_LIMIT": ("limit", int), "LOAM_RERANK": ("rerank", truth)})
        chunking = chosen(Chunking(), {"LOAM_MAX_CHUNK": ("max_chunk_size", int), "LOAM_EMBED_LIMIT": ("embed_limit", int)})
        return chosen(cls(search, chunking), {"LOAM_API_KEY": ("api_key", str), "LOAM_DIM": ("dim", int)})

    @property
    def has_key(self) -> bool:
        """Whether a key is set that isn't a stand-in."""
        return bool(self.api_key) and self.api_key != "test"

    def problems(self) -> list[str]:
        out = []
        if self.search.limit < 0:
            out.append("search.limit is negative")
        if min(self.search.vector_weight, self.search.text_weight) < 0:
            out.append("a search weight is negative")
        if self.chunking.max_chunk_size <= self.chunking.context_margin:
            out.append("chunking.max_chunk_size leaves no room beside context_margin")
        return out

    def summary(self) -> dict:
        key = self.api_key
        shown = "*" * len(key) if len(key) <= 8 else key[:4] + "*" * (len(key) - 8) + key[-4:]
        return asdict(self) | {"api_key": shown}

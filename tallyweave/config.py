"""The engine's settings in one place, read from a mapping such as the environment and checked at once."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tallyweave.sources import embedding

#: Providers, their models and vector lengths when none are set, and where their keys are looked up: fixed values.
DEFAULTS = {"mock": ("mock", 512), "openai": ("text-embedding-3-small", 1536), "voyage": ("voyage-3.5-lite", 512)}
KEYS = {"openai": "OPENAI_API_KEY", "voyage": "VOYAGE_API_KEY"}


@dataclass(frozen=True)
class EngineConfig:
    """home: the folder that holds docs, graph and manifest, on any file system."""

    home: str
    provider: str = "mock"
    model: str | None = None
    dimensions: int | None = None
    api_key: str | None = field(default=None, repr=False)

    def __post_init__(self) -> None:
        if self.provider not in DEFAULTS:
            raise ValueError(f"unknown embedding provider: {self.provider}")
        if self.dimensions is not None and self.dimensions < 1:
            raise ValueError("dimensions must be a positive number")
        if not self.home:
            raise ValueError("home must not be empty")

    @staticmethod
    def load(home: str, env: Mapping[str, str] | None = None) -> EngineConfig:
        env = os.environ if env is None else env
        provider = env.get("EMBEDDING_PROVIDER") or "mock"
        size = env.get("EMBEDDING_DIMENSIONS")
        if size is not None and not size.isdigit():
            raise ValueError("EMBEDDING_DIMENSIONS must be a positive number")
        return EngineConfig(home, provider, env.get("EMBEDDING_MODEL"), int(size) if size else None, env.get(KEYS.get(provider, "")))

    @property
    def dim(self) -> int:
        return self.dimensions or DEFAULTS[self.provider][1]

    def path(self, what: str) -> str:
        """docs, graph or manifest below home."""
        if what not in ("docs", "graph", "manifest"):
            raise ValueError(f"no such path: {what}")
        return f"{self.home.rstrip('/')}/{what}"

    def embed(self, kind: str = "document") -> Callable[[DataFrame], DataFrame]:
        """The provider for documents or for queries; a service needs its key."""
        if self.provider == "mock":
            return embedding.mock(self.dim)
        if not self.api_key:
            raise ValueError(f"{KEYS[self.provider]} is not set")
        return embedding.http(self.provider, self.api_key, self.model or DEFAULTS[self.provider][0], kind=kind)


@dataclass(frozen=True)
class SyncOptions:
    """What a sync may be asked for; combinations that would surprise are refused."""

    paths: tuple[str, ...] = ()
    force: bool = False
    dry_run: bool = False
    watch: bool = False

    def __post_init__(self) -> None:
        if self.watch and self.dry_run:
            raise ValueError("watch cannot be combined with dry_run")
        if self.watch and self.force:
            raise ValueError("watch cannot be combined with force")
        if self.force and not self.paths:
            raise ValueError("force needs paths")

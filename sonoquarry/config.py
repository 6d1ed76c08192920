"""Parameters that change answers, each overridable by an environment variable of the same name in capitals."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

_TRUE = {"1", "true", "yes", "on"}


@dataclass(frozen=True)
class Config:
    embed_model: str = "m-a-p/MERT-v1-95M"
    target_sr: int = 24000
    chunk_seconds: int = 30
    n_chunks: int = 3
    chunk_stride: int = 30
    embed_layer: int = 6
    embed_flush_every: int = 50
    page_size: int = 100
    metadata_rate: float = 3.0
    download_workers: int = 8
    http_timeout: float = 60.0
    recommend_mode: str = "discovery"
    recommend_k: int = 20
    w_anime: float = 0.1
    w_artist: float = 0.3
    w_era: float = 0.05
    era_window_years: int = 2
    alpha_genre: float = 0.3
    alpha_blend: float = 0.3
    max_per_anime: int = 5
    whiten_components: int = 256
    whiten_alpha: float = 1.0
    whiten_eps: float = 1e-5
    keep_audio: bool = False

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> "Config":
        """Defaults, with what the environment sets. An unset variable keeps the default; an empty number is an error."""
        env = os.environ if env is None else env
        found = {}
        for f in fields(cls):
            raw = env.get(f.name.upper())
            if raw is None:
                continue
            kind = type(f.default)
            found[f.name] = raw.strip().lower() in _TRUE if kind is bool else kind(raw)
        return cls(**found)

    @property
    def embed_version(self) -> str:
        """The version that vectors of these settings carry."""
        layer = f"-L{self.embed_layer}" if self.embed_layer >= 0 else ""
        return f"sr{self.target_sr}-c{self.chunk_seconds}x{self.n_chunks}s{self.chunk_stride}{layer}"

    @property
    def w_max(self) -> float:
        """Largest metadata weight before normalisation."""
        return self.w_anime + self.w_artist + self.w_era + self.alpha_genre

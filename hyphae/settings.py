"""Settings from the environment, and logging."""

from __future__ import annotations

import logging
import os
from dataclasses import dataclass, fields
from functools import cache

PREFIX = "HYPHAE_"


@dataclass(frozen=True)
class Settings:
    environment: str = "development"
    log_level: str = "INFO"
    storage_path: str = "./storage"
    embedding_dimension: int = 384
    default_top_k: int = 10
    embedding_model_name: str = "all-MiniLM-L6-v2"
    nlp_model_name: str = "en_core_web_sm"
    max_graph_depth: int = 3

    @classmethod
    def from_environment(cls, prefix: str = PREFIX) -> Settings:
        """Defaults under variables like HYPHAE_LOG_LEVEL."""
        given = {f.name: os.environ[prefix + f.name.upper()] for f in fields(cls) if prefix + f.name.upper() in os.environ}
        return cls(**{k: int(v) if isinstance(getattr(cls, k), int) else v for k, v in given.items()})


@cache
def settings() -> Settings:
    return Settings.from_environment()


def logger(name: str, level: str | None = None) -> logging.Logger:
    """A logger with one handler, however often it is asked for."""
    log = logging.getLogger(name)
    if not log.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        log.addHandler(handler)
        log.propagate = False
    log.setLevel((level or settings().log_level).upper())
    return log

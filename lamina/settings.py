"""Typed settings from the session and the environment; no secret is needed by the local providers."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    """Values from ``spark.lamina.<name>``, else the environment variable ``LAMINA_<NAME>``, else the default."""

    contact_email: str | None = None
    articles_api_key: str | None = None
    labels_api_key: str | None = None
    embedding_api_key: str | None = None
    embedding_model: str = "hashed-256"
    data_root: str = "data"

    @staticmethod
    def load(spark: SparkSession | None = None, require: tuple[str, ...] = ()) -> Settings:
        """Settings; a missing one of ``require`` raises ``ValueError``. Unknown keys are ignored."""
        found = {}
        for f in fields(Settings):
            value = spark.conf.get(f"spark.lamina.{f.name}", None) if spark is not None else None
            value = value or os.environ.get(f"LAMINA_{f.name.upper()}")
            if value:
                found[f.name] = value
        settings = Settings(**found)
        lacking = [name for name in require if not getattr(settings, name)]
        if lacking:
            raise ValueError(f"settings missing: {', '.join(lacking)}")
        return settings


def request_delay(has_key: bool = True) -> float:
    """Seconds between two requests to the article provider: 0.11 with a key, 0.35 without."""
    return 0.11 if has_key else 0.35

"""Settings of a library: stored values first, then the environment, then a default."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import functions as F

from archivist.sources.store import Store

PROVIDERS, LIBRARIES = ("local", "ollama", "openai", "voyage"), ("saves", "likes")
TABLE, SHAPE = "settings", "key string, value string, updated_at timestamp"
#: Milliseconds that a provider may take.
TIMEOUT_MS = 30_000


class Settings:
    """A table of (key, value, updated_at) of a store; it has a few rows."""

    def __init__(self, store: Store, env: Mapping[str, str] | None = None):
        self.store, self.env = store, os.environ if env is None else env

    def stored(self) -> dict[str, str]:
        if self.store.version(TABLE) is None:
            return {}
        return {r["key"]: r["value"] for r in self.store.read(TABLE).collect()}

    def update(self, values: Mapping[str, str | None]) -> None:
        """Set values, trimmed; a blank one is taken out."""
        clean = [(k, (v or "").strip()) for k, v in values.items()]
        new = self.store.spark.createDataFrame(clean, "key string, value string").filter("value <> ''").withColumn("updated_at", F.current_timestamp())
        old = self.store.read(TABLE) if self.store.version(TABLE) is not None else None
        self.store.write(TABLE, new if old is None else old.filter(~F.col("key").isin([k for k, _ in clean])).unionByName(new))

    def get(self, key: str, *names: str, default: str | None = None) -> str | None:
        """The stored value, else the first of the environment's names that isn't blank, else the default."""
        found = [self.stored().get(key), *(self.env.get(n) for n in names)]
        return next((f.strip() for f in found if f and f.strip()), default)

    def migrate(self) -> None:
        """A provider's flag for both libraries, as older versions kept it, becomes one for each that has none; then it goes."""
        have, new = self.stored(), {}
        for p in PROVIDERS:
            old = have.get(f"{p}_enabled")
            if old in ("0", "1"):
                new |= {f"{lib}_{p}_enabled": old for lib in LIBRARIES if have.get(f"{lib}_{p}_enabled") not in ("0", "1")} | {f"{p}_enabled": None}
        if new:
            self.update(new)

    def enabled(self, provider: str, library: str) -> bool:
        """Whether a provider may be used for a library; without a word about it only the offline one may."""
        stored = self.stored().get(f"{library}_{provider}_enabled")
        told = [stored if stored in ("0", "1") else None, self.env.get(f"{library}_{provider}_enabled".upper()), self.env.get(f"{provider}_enabled".upper())]
        flag = next((t.strip().lower() for t in told if t and t.strip()), None)
        return provider == "local" if flag is None else flag in ("1", "true", "yes", "on")

    def preferred(self) -> str | None:
        found = (self.get("embedding_provider", "EMBEDDING_PROVIDER") or "").lower()
        return found if found in PROVIDERS else None

    def timeout_ms(self) -> float:
        text = self.get("embedding_timeout_ms", "EMBEDDING_TIMEOUT_MS", default=str(TIMEOUT_MS))
        try:
            number = float(text)
        except ValueError:
            number = 0
        if not 0 < number < float("inf"):
            raise ValueError("the timeout has to be a positive number of milliseconds")
        return number

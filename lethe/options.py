"""Job options."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

DEFAULT_SHARDS = 4
DEFAULT_DIMENSION = 384


@dataclass(frozen=True)
class EngineOptions:
    """Options every job shares.

    ``num_shards`` is the logical shard count an entity hashes into. ``buckets`` splits each
    shard into physical cells, the unit a purge rewrites, so its cost follows the cells that
    hold purged entities and not the size of the shard. ``input_partitions`` deals the requests
    of a batch out to so many tasks, if their files are not split as evenly already; unset, they
    stay as their files are split, which is right for anything larger than a few splits. ``encode_batch`` is the number of texts an encoder gets
    at a time.
    """

    num_shards: int = DEFAULT_SHARDS
    dimension: int = DEFAULT_DIMENSION
    buckets: int = 16
    encode_batch: int = 32
    input_partitions: int | None = None

    def __post_init__(self) -> None:
        # A shard count of zero acts as one shard.
        object.__setattr__(self, "num_shards", max(int(self.num_shards), 1))
        object.__setattr__(self, "buckets", max(int(self.buckets), 1))

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, **overrides) -> EngineOptions:
        """Read ``NUM_SISA_SHARDS``; a missing, zero or unreadable value means the default."""
        env = os.environ if env is None else env
        raw = env.get("NUM_SISA_SHARDS", "")
        digits = raw[1:] if raw.startswith("+") else raw
        shards = int(digits) if digits.isascii() and digits.isdigit() else 0
        if not 0 < shards < 2**32:
            shards = DEFAULT_SHARDS
        return cls(**{"num_shards": shards, **overrides})

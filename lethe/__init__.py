"""Entity erasure with proof, as Spark jobs over tables and streams of requests."""

from lethe.options import EngineOptions

__all__ = ["EngineOptions"]

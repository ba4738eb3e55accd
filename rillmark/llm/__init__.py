"""Text-corpus operators for training-data pipelines.

Nothing outside this subpackage imports it.  ``QUERIES`` and ``ORACLES`` are
what the entry module registers.
"""

from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

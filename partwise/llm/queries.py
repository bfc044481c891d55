"""Importing this module registers the queries of the subpackage."""

from . import align, counts, encoding, jaccard, lines, mixing, near, neighbours, phrases, repeats, sharding, topk, toxicity  # noqa: F401
from .common import ORACLES, QUERIES  # noqa: F401

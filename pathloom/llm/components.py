"""Connected components of an edge table, with stage tables as recovery points."""
from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import network
from .common import discard, staged


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b: long): label is the least node reachable."""
    return network.components(edges, checkpoint=staged, drop=discard)

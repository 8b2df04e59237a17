"""What of a change log may settle: whole committed transactions, or the prefix before the last boundary.

Markers are rows of the log: ``begin`` and ``terminal``; change rows have none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def committed_transactions(log: DataFrame, transaction: str, marker: str = "marker") -> tuple[DataFrame, DataFrame]:
    """(changes of transactions whose terminal marker is there, changes that wait for theirs)."""
    done = log.where(F.col(marker) == "terminal").select(transaction).distinct()
    changes = log.where(F.col(marker).isNull()).drop(marker)
    return changes.join(done, transaction, "left_semi"), changes.join(done, transaction, "left_anti")


def event_prefix(log: DataFrame, position: str, marker: str = "marker") -> tuple[DataFrame, DataFrame, object]:
    """(changes up to the last terminal marker, the rest, that marker's position or None)."""
    last = log.where(F.col(marker) == "terminal").agg(F.max(position).alias("p")).first()["p"]
    changes = log.where(F.col(marker).isNull()).drop(marker)
    if last is None:
        return changes.where(F.lit(False)), changes, None
    return changes.where(F.col(position) <= F.lit(last)), changes.where(F.col(position) > F.lit(last)), last

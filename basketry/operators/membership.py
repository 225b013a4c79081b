"""Set-membership filters as semi joins (P5/J2 broadcast, P6/J3 shuffled).

The reference checks each pair against sets collected to the driver and
broadcast (or, in store mode, with three point queries per pair). Here the
same test is a ``left_semi`` join, so no key set passes through the driver
and no per-row lookup happens.

Strategies:

* ``auto``: a filter side with a proven row bound (e.g. at most ``num_buckets``
  buckets) under ``max_broadcast_rows`` is broadcast; any other is a plain
  semi join, which AQE turns into a broadcast join only when the side's
  measured size is under ``spark.sql.adaptive.autoBroadcastJoinThreshold``.
* ``broadcast``: replicate the filter side, but only behind a size check: a
  proven static bound (e.g. the bucket count) or the row count of the side
  written once to shared scratch; above
  ``max_broadcast_rows`` it falls back to the shuffled join.
* ``shuffle``: shuffled hash join on both sides, for filter sides too big to
  replicate.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.session import materialized, tasks_of

STRATEGIES = ("auto", "broadcast", "shuffle")
#: Keys that a filter side may have to be replicated, by default (``max_broadcast_rows``).
MAX_BROADCAST_ROWS = 4_000_000

log = logging.getLogger(__name__)


def check_strategy(strategy: str) -> str:
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}, got {strategy!r}")
    return strategy


def side_strategy(strategy: str, df: DataFrame) -> str:
    """``auto`` for written rows ``df`` that take many tasks: hash the filter side, so that ``df`` isn't sorted
    by the key (a sort merge join's tasks would sort more of it the more rows there are)."""
    return "shuffle" if strategy == "auto" and tasks_of(df.sparkSession, df.count()) else strategy


def prepare_side(keys: DataFrame, key_col: str, strategy: str, bound_rows: int | None = None,
                 max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """The key column as ``_member``, with the join strategy applied on top."""
    check_strategy(strategy)
    keys = keys.select(F.col(key_col).alias("_member"))
    if strategy == "shuffle":
        return keys.hint("shuffle_hash")
    if bound_rows is not None and bound_rows <= max_broadcast_rows:
        return F.broadcast(keys)
    if strategy == "auto":
        return keys
    # No static bound: write it once to shared scratch (a lost executor does not
    # recompute it) and count the written rows.
    keys = materialized(keys, "filter-side")
    n = keys.count()
    if n <= max_broadcast_rows:
        return F.broadcast(keys)
    log.warning("filter side has %d rows (> %d): using a shuffled join", n, max_broadcast_rows)
    return keys.hint("shuffle_hash")


def keep_members(df: DataFrame, col: str, side: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``col`` occurs in ``side._member`` (left semi join).

    ``side`` comes from ``prepare_side``.
    """
    return df.join(side, df[col] == side["_member"], "left_semi")

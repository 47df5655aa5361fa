"""From changed keys to the rules that they wake, in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _keys(dirty: DataFrame, watchers: DataFrame) -> list[str]:
    """What a dirty row is known by: source and component, or the component alone where only one source is watched."""
    if "source" not in watchers.columns:
        return ["component"]
    if "source" in dirty.columns:
        return ["source", "component"]
    if watchers.select("source").distinct().count() > 1:
        raise ValueError("dirty rows need a source: components of several sources are watched")
    return ["component"]


def agenda(dirty: DataFrame, watchers: DataFrame, rules: DataFrame) -> DataFrame:
    """A row for each rule that a dirty row wakes, with its place: higher priority first, then lower rule_id.

    ``watchers`` (source, component, rule_id) and ``rules`` (rule_id, name, priority) are the
    declared graph, a few rows each whatever the data, so they are broadcast.
    """
    keys = _keys(dirty, watchers)
    woken = dirty.join(F.broadcast(watchers.select(*keys, "rule_id")), keys).join(F.broadcast(rules), "rule_id")
    order = Window.partitionBy("dirty_id").orderBy(F.desc("priority"), "rule_id")
    return woken.withColumn("place", F.row_number().over(order))


def unwatched(dirty: DataFrame, watchers: DataFrame) -> DataFrame:
    """Dirty rows that wake nothing; they are acknowledged all the same."""
    keys = _keys(dirty, watchers)
    return dirty.join(F.broadcast(watchers.select(*keys).distinct()), keys, "left_anti")


def coalesced(woken: DataFrame) -> DataFrame:
    """One firing for each rule and entity: what is left of several changes when they are taken together."""
    return woken.select("rule_id", "entity").distinct()

"""Running rules until nothing changes.

A change is a row (source, entity, component, value, ...).  Rules watch components of a source,
so changes of another source that has a component of the same name do not wake them.
"""

from __future__ import annotations

import inspect
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import Registry, Rule


class MaxDepthExceeded(RuntimeError):
    pass


class RuleContext:
    """What a rule may read besides its changes: the facts as its cascade has left them so far, and the time.

    ``facts`` has source, entity, component and value.
    """

    def __init__(self, facts: DataFrame, now: Column):
        self.facts, self.now = facts, now

    def get(self, rows: DataFrame, name: str, alias: str, default=None) -> DataFrame:
        """``rows`` with the value of the component ``name`` ("Source::component") of their entity."""
        source, _, component = name.partition("::")
        own = self.facts.where((F.col("source") == source) & (F.col("component") == component)).select("entity", F.col("value").alias(alias))
        found = rows.join(own, "entity", "left")
        return found if default is None else found.withColumn(alias, F.coalesce(alias, F.lit(default)))


def _sourced(changes: DataFrame, registry: Registry) -> DataFrame:
    if "source" in changes.columns:
        return changes
    if len(registry.sources) != 1:
        raise ValueError("changes need a source: several are declared")
    return changes.withColumn("source", F.lit(next(iter(registry.sources))))


def _watched(changes: DataFrame, watch: list[str]) -> DataFrame:
    return changes.where(F.concat_ws("::", "source", "component").isin(watch))


def _fire(rule: Rule, woken: DataFrame, context: RuleContext | None) -> DataFrame:
    """What a rule makes of the changes that wake it, addressed to the components that it declares to write."""
    given = woken.drop("rule", "place")
    out = rule.body(given, context) if len(inspect.signature(rule.body).parameters) > 1 else rule.body(given)
    source = F.col("source")
    for name in rule.writes:
        target, _, component = name.partition("::")
        source = F.when(F.col("component") == component, F.lit(target)).otherwise(source)
    return out.withColumns({"source": source, "rule": F.lit(rule.name), "depth": F.col("depth") + 1})


def unrolled(changes: DataFrame, registry: Registry) -> DataFrame:
    """All that the rules of an acyclic graph derive from ``changes`` (entity, component, value, ...): one plan, no loop.

    Every change is taken on its own value.  Rows have ``rule`` and ``depth``.
    """
    first = _sourced(changes, registry).withColumns({"rule": F.lit(None).cast("string"), "depth": F.lit(0)})
    made: list[tuple[set[str], DataFrame]] = [({f"{s.name}::{c}" for s in registry.sources.values() for c in s.components}, first)]
    derived = []
    for rule in registry.order():
        sources = [df for writes, df in made if writes & set(rule.watch)]
        out = _fire(rule, reduce(DataFrame.unionByName, (_watched(df, rule.watch) for df in sources)), None)
        made.append((set(rule.writes), out))
        derived.append(out)
    return reduce(DataFrame.unionByName, derived) if derived else first.limit(0)


def to_fixpoint(changes: DataFrame, registry: Registry, *, max_depth: int = 10, state: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """The same by rounds, for graphs with cycles: MaxDepthExceeded if changes are left after ``max_depth`` rounds.

    Rules of a round run in the order of the agenda (``place``: higher priority first, then lower
    id).  Rules with a second parameter get a RuleContext: ``state`` (source, entity, component,
    value) overlaid with the changes and with all that earlier rounds have written.  Each round's
    changes are checkpointed, so lineage stays short; the driver only learns whether there are any.
    """
    front = _sourced(changes, registry).withColumns({"rule": F.lit(None).cast("string"), "depth": F.lit(0), "place": F.lit(0)}).checkpoint()
    total, seen = [], [front]
    for _ in range(max_depth):
        context = RuleContext(settled(reduce(DataFrame.unionByName, seen), state), F.current_timestamp() if now is None else now)
        outs = [_fire(r, _watched(front, r.watch), context).withColumn("place", F.lit(k)) for k, r in enumerate(registry.ranked(), 1)]
        if not outs:
            break
        front = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), outs).checkpoint()
        if front.isEmpty():
            break
        total.append(front)
        seen.append(front.select(*seen[0].columns))
    else:
        watched = {w for r in registry.rules for w in r.watch}
        if not _watched(front, sorted(watched)).isEmpty():
            raise MaxDepthExceeded(f"changes are left after {max_depth} rounds")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), total) if total else front.limit(0)


def settled(written: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """source, entity, component, value after all writes: of a fact the last write stays, by depth and place; ``state`` is what was there before."""
    keys = ["source", "entity", "component"]
    rows = written.select(*keys, F.col("value").cast("string").alias("value"), "depth", "place")
    if state is not None:
        rows = rows.unionByName(state.select(*keys, F.col("value").cast("string").alias("value"), F.lit(-1).alias("depth"), F.lit(0).alias("place")))
    return rows.groupBy(*keys).agg(F.max_by("value", F.struct("depth", "place", "value")).alias("value"))


def atomic(changes: DataFrame, registry: Registry, *, cause: str = "cause_id", max_depth: int = 10, queue: int = 8, max_entries: int = 10) -> DataFrame:
    """All outcomes of each change's cascade in one table, to be committed by one write: outputs and acknowledgement, or a failure.

    kind is ``put`` (what a rule wrote), ``ack`` (the change is done) or ``failed`` with a reason.
    A rule may give ``trap`` (boolean): then nothing of that change's cascade is kept, and it is
    not acknowledged.  A rule's ``status`` other than 0 is only kept with its output.  A cascade
    fails as well if more than ``queue`` changes wait at once, or if it takes more than
    ``max_entries`` changes.
    """
    derived = to_fixpoint(changes, registry, max_depth=max_depth)
    trap = F.coalesce(F.col("trap"), F.lit(False)) if "trap" in derived.columns else F.lit(False)
    status = F.coalesce(F.col("status").cast("int"), F.lit(0)) if "status" in derived.columns else F.lit(0)
    watched = sorted({w for r in registry.rules for w in r.watch})
    waits = F.concat_ws("::", "source", "component").isin(watched)
    rows = derived.withColumns({"trap": trap, "status": status, "waits": waits})
    levels = rows.groupBy(cause, "depth").agg(F.bool_or("trap").alias("trap"), F.count_if("waits").alias("n"))
    whole = levels.groupBy(cause).agg(F.bool_or("trap").alias("trap"), F.max("n").alias("most"), (F.sum("n") + 1).alias("entries"))
    reason = F.when(F.col("trap"), "trap").when(F.col("most") > queue, "queue full").when(F.col("entries") > max_entries, "max depth exceeded")
    ends = _sourced(changes, registry).select(cause, "source", "entity", "component").join(whole.select(cause, reason.alias("reason")), cause, "left")
    empty = {"value": F.lit(None).cast("string"), "rule": F.lit(None).cast("string"), "depth": F.lit(0), "status": F.lit(0)}
    columns = ["kind", cause, "source", "entity", "component", "value", "rule", "depth", "status", "reason"]
    last = ends.withColumns({**empty, "kind": F.when(F.col("reason").isNull(), "ack").otherwise("failed")}).select(*columns)
    failed = ends.where("reason IS NOT NULL").select(cause).distinct()
    puts = rows.join(failed, cause, "left_anti").withColumns({"kind": F.lit("put"), "value": F.col("value").cast("string"), "reason": F.lit(None).cast("string")}).select(*columns)
    return puts.unionByName(last)


def trace(derived: DataFrame, cause: Column, key: str = "cause_id") -> DataFrame:
    """How a change led to what was derived from it: its rows in causal order (depth, then place)."""
    return derived.where(F.col(key) == cause).orderBy("depth", *(["place"] if "place" in derived.columns else []), "component")

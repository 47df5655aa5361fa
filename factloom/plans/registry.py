"""Declared sources, components and rules, and the tables that stand for their watch graph."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession


@dataclass
class Source:
    name: str
    components: dict[str, str]  # component -> DDL of its fields
    kind: str = "table"
    options: dict[str, str] = field(default_factory=dict)
    mappers: dict[str, Column] = field(default_factory=dict)
    dynamic: bool = False


@dataclass
class Rule:
    name: str
    watch: list[str]  # "Source::component"
    priority: int
    writes: list[str]
    body: Callable[[DataFrame], DataFrame]
    rule_id: int = -1


class Registry:
    """Collects declarations (also as decorators), resolves what rules watch, and checks for cycles."""

    def __init__(self, *, lenient: bool = False):
        self.sources: dict[str, Source] = {}
        self.rules: list[Rule] = []
        self.lenient = lenient

    def source(self, name: str, components: dict[str, str], **options) -> Source:
        if name in self.sources:
            raise ValueError(f"source {name} declared twice")
        self.sources[name] = Source(name, components, **options)
        return self.sources[name]

    def rule(self, watch: list[str], *, priority: int = 0, writes: list[str] = ()) -> Callable:
        """Declare a function from the changed rows (entity, value, ...) to rows (entity, component, value)."""
        if not 0 <= priority <= 255:
            raise ValueError("priority must be from 0 to 255")

        def declare(body):
            known = []
            for name in watch:
                source, _, component = name.partition("::")
                if component in getattr(self.sources.get(source), "components", {}):
                    known.append(name)
                elif not self.lenient:
                    raise KeyError(f"rule {body.__name__} watches unknown {name}")
            self.rules.append(Rule(body.__name__, known, priority, list(writes), body, 1 + max((r.rule_id for r in self.rules), default=-1)))
            return body

        return declare

    def component_ids(self) -> dict[str, int]:
        """Ids from 0 in the order of declaration."""
        names = [f"{s.name}::{c}" for s in self.sources.values() for c in s.components]
        return {name: k for k, name in enumerate(names)}

    def watchers(self, spark: SparkSession) -> DataFrame:
        ids = self.component_ids()
        rows = [(ids[w], *w.split("::"), r.rule_id) for r in self.rules for w in r.watch]
        return spark.createDataFrame(rows, "component_id long, source string, component string, rule_id long")

    def rule_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(r.rule_id, r.name, r.priority) for r in self.rules], "rule_id long, name string, priority int")

    def watches(self, name: str) -> list[str]:
        """What a rule watches, as resolved."""
        return next(list(r.watch) for r in self.rules if r.name == name)

    def unload(self, name: str) -> Rule:
        """Take a rule out of the graph; the ids of the others stay."""
        rule = next(r for r in self.rules if r.name == name)
        self.rules.remove(rule)
        return rule

    def of_type(self, type_name: str) -> list[str]:
        """All components, of any source, whose declared type is ``type_name``."""
        return [f"{s.name}::{c}" for s in self.sources.values() for c, ddl in s.components.items() if ddl == type_name]

    def ranked(self) -> list[Rule]:
        """Rules in the order of the agenda: higher priority first, then lower id."""
        return sorted(self.rules, key=lambda r: (-r.priority, r.rule_id))

    def edges(self) -> list[tuple[str, str]]:
        """Which component leads to which, through a rule."""
        return sorted({(w, t) for r in self.rules for w in r.watch for t in r.writes})

    def order(self) -> list[Rule]:
        """Rules after all those that write what they watch; ValueError if the graph has a cycle."""
        after = {r.rule_id: {s.rule_id for s in self.rules if set(s.writes) & set(r.watch)} for r in self.rules}
        out: list[Rule] = []
        while rest := [r for r in self.rules if r not in out]:
            done = {r.rule_id for r in out}
            ready = [r for r in rest if after[r.rule_id] <= done]
            if not ready:
                raise ValueError("rules form a cycle: " + ", ".join(sorted(r.name for r in rest)))
            out += sorted(ready, key=lambda r: (-r.priority, r.rule_id))
        return out

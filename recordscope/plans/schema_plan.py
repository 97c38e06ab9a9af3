"""A JSON Schema with evaluation rules, compiled once into the rules that the scorer turns into Columns."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

MAX_REFS = 50


@dataclass(frozen=True)
class Rule:
    metric: str
    params: tuple[tuple[str, object], ...] = ()


@dataclass
class Node:
    """A value of a record: its own rule, the members of an object or the items of an array."""

    rule: Rule | None = None
    members: dict[str, Node] = field(default_factory=dict)
    items: Node | None = None
    is_array: bool = False

    def item_paths(self, prefix: str = "") -> list[tuple[str, Rule]]:
        """(path, rule) of every rule under the node, with ``[]`` for items."""
        out = [(prefix, self.rule)] if self.rule and prefix else []
        for name, node in self.members.items():
            out += node.item_paths(f"{prefix}.{name}" if prefix else name)
        if self.items is not None:
            out += self.items.item_paths(f"{prefix}[]")
        return out


def resolve(schema: object, root: dict | None = None, depth: int = 0) -> object:
    """The schema with ``#/$defs`` references put in; members beside a reference override the definition."""
    root = schema if root is None else root
    if depth > MAX_REFS:
        return schema
    if isinstance(schema, list):
        return [resolve(x, root, depth) for x in schema]
    if not isinstance(schema, dict):
        return schema
    if isinstance(ref := schema.get("$ref"), str):
        target = (root.get("$defs") or {}).get(ref.rsplit("/", 1)[-1]) if ref.startswith("#/$defs/") else None
        if target is not None:
            return resolve({**target, **{k: v for k, v in schema.items() if k != "$ref"}}, root, depth + 1)
    return {k: resolve(v, root, depth) for k, v in schema.items() if k != "$defs"}


def parse_rule(raw: object) -> Rule | None:
    """A rule is a metric's name, an object with its id and parameters, or a list of those of which the first counts."""
    if isinstance(raw, str):
        return Rule(raw)
    if isinstance(raw, dict):
        if isinstance(many := raw.get("metrics"), list) and many:
            return parse_rule(many[0])
        if isinstance(name := raw.get("metric_id"), str):
            return Rule(name, tuple(sorted((raw.get("params") or {}).items())))
    return None


def _node(schema: dict) -> Node:
    node = Node(parse_rule(schema.get("evaluation_config")))
    for kind in ("anyOf", "oneOf"):
        for option in schema.get(kind) or []:
            if isinstance(option, dict) and ("properties" in option or "items" in option):
                inner = _node(option)
                inner.rule = inner.rule or node.rule
                return inner
            if isinstance(option, dict) and (rule := parse_rule(option.get("evaluation_config"))):
                node.rule = rule
    node.members = {k: _node(v) for k, v in (schema.get("properties") or {}).items() if isinstance(v, dict)}
    if isinstance(schema.get("items"), dict):
        node.items, node.is_array = _node(schema["items"]), True
    return node


def compile_schema(text: str | dict) -> Node:
    """The plan of a schema given as JSON text or as a dict; a ``schema_definition`` wrapper is taken off."""
    schema = resolve(json.loads(text) if isinstance(text, str) else text)
    return _node(schema.get("schema_definition", schema))


def eval_configs(plan: Node) -> list[tuple[str, str, dict[str, str]]]:
    """(path, metric_id, params) of all rules, as rows."""
    return [(path, rule.metric, {k: str(v) for k, v in rule.params}) for path, rule in plan.item_paths()]


def without_rules(schema: object) -> object:
    """The schema as a model is shown it, without evaluation rules."""
    if isinstance(schema, dict):
        return {k: without_rules(v) for k, v in schema.items() if k != "evaluation_config"}
    return [without_rules(x) for x in schema] if isinstance(schema, list) else schema

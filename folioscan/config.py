"""Settings of a run: merged from dataset, model and overrides, checked; grids of runs; JSON that people read."""

from __future__ import annotations

import json
import re
from typing import Any

# The ways to choose evidence, and those that hierarchical models have.
RETRIEVAL = ("oracle", "concat", "logits", "maxconf", "anyconf", "maxconfpage", "anyconfpage", "majorpage", "weightmajorpage", "anyconforacle", "custom", "none")
HIERARCHICAL = ("oracle", "custom")
SEED = 42


def merge(*layers: dict[str, Any]) -> dict[str, Any]:
    """The later layers' values, where they have one that isn't null, over the earlier ones', with defaults for the seed and the retrieval."""
    out: dict[str, Any] = {}
    for layer in layers:
        out |= {k: v for k, v in layer.items() if v is not None or k not in out}
    return {"seed": SEED, "page_retrieval": "concat"} | {k: v for k, v in out.items() if v is not None or k not in ("seed", "page_retrieval")}


def check(config: dict[str, Any]) -> list[str]:
    """Warnings about a configuration; raises where it can't run. `hierarchical` says so of its model, `single_page` of its dataset."""
    mode, hierarchical = str(config.get("page_retrieval", "none")).lower(), bool(config.get("hierarchical"))
    if mode not in RETRIEVAL:
        raise ValueError(f"no such retrieval: {mode}")
    if mode == "custom" and not hierarchical:
        raise ValueError("custom retrieval is for hierarchical models")
    if hierarchical and mode not in (*HIERARCHICAL, "none"):
        raise ValueError(f"a hierarchical model can't run with {mode} retrieval")
    said = []
    if mode not in (*HIERARCHICAL, "none") and config.get("max_pages") is not None:
        said.append(f"max_pages is ignored with {mode} retrieval")
    if mode == "none" and not config.get("single_page"):
        said.append("retrieval none is for datasets of single pages")
    return said


def flatten(nested: dict[str, Any]) -> dict[str, Any]:
    """One level: every value under its own key, whatever it is nested in; of equal keys the last one counts."""
    out: dict[str, Any] = {}
    for k, v in nested.items():
        out |= flatten(v) if isinstance(v, dict) else {k: v}
    return out


def overridden(config: dict[str, Any], arguments: list[str]) -> dict[str, Any]:
    """config with `key=value` arguments: true and false are booleans, digits are numbers, other arguments don't matter."""
    out = dict(config)
    for key, sign, value in (a.partition("=") for a in arguments):
        if sign:
            out[key] = value.lower() == "true" if value.lower() in ("true", "false") else int(value) if value.isdigit() else value
    return out


def runs(nested: dict[str, Any], devices: str = "visible_devices") -> list[dict[str, Any]]:
    """A configuration for each run: lists give their values one after the other, and must be of one length; devices stay a list."""
    flat = flatten(nested)
    lists = {k: v for k, v in flat.items() if isinstance(v, list) and k != devices}
    if len({len(v) for v in lists.values()}) > 1:
        raise ValueError("lists of runs must be of one length: " + ", ".join(f"{k} {len(v)}" for k, v in lists.items()))
    n = len(next(iter(lists.values()))) if lists else 1
    return [flat | {k: v[i] for k, v in lists.items()} for i in range(n)]


def numbers(argument: str | None) -> list[int] | None:
    """The numbers that an argument names: "[a-b]" a range without b, "[1, 2]" a list, "3" one; null for null."""
    if argument is None:
        return None
    if span := re.fullmatch(r"\s*\[\s*(\d+)\s*-\s*(\d+)\s*\]\s*", argument):
        return list(range(int(span[1]), int(span[2])))
    found = json.loads(argument)
    return found if isinstance(found, list) else [found]


def simple(value: Any) -> bool:
    """Whether a value holds nothing but plain values, lists and mappings with text keys."""
    if isinstance(value, list):
        return all(map(simple, value))
    if isinstance(value, dict):
        return all(isinstance(k, str) and simple(v) for k, v in value.items())
    return value is None or isinstance(value, str | int | float | bool)


def readable(value: Any, indent: int = 2, width: int = 80, from_level: int = 0, level: int = 0) -> str:
    """JSON in lines; from a level on, simple values that fit the width stay in one line."""
    inline = json.dumps(value, ensure_ascii=False) if simple(value) else None
    if not isinstance(value, list | dict) or not value or (level >= from_level and inline is not None and len(inline) <= width):
        return inline if inline is not None else json.dumps(value, ensure_ascii=False)
    inner = lambda v: readable(v, indent, width, from_level, level + 1)
    parts = [inner(v) for v in value] if isinstance(value, list) else [f"{json.dumps(str(k), ensure_ascii=False)}: {inner(v)}" for k, v in value.items()]
    begin, end = "[]" if isinstance(value, list) else "{}"
    pad = " " * indent * (level + 1)
    return f"{begin}\n" + ",\n".join(pad + p for p in parts) + "\n" + " " * indent * level + end

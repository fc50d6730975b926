"""Configuration trees from YAML: interpolation, inheritance, agents; small dimension tables from them."""

from __future__ import annotations

import os
import re
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: Fixed value: the syntax of variables.
VARIABLE = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_]*)(?::-([^}]*))?\}")


def interpolated(value: Any, env: dict[str, str] | None = None) -> Any:
    """${NAME} and ${NAME:-default} in all strings; a variable that is set to nothing counts as set, and what has neither value nor default stays as it is."""
    env = os.environ if env is None else env
    if isinstance(value, str):
        return VARIABLE.sub(lambda m: next(x for x in (env.get(m[1]), m[2], m[0]) if x is not None), value)
    if isinstance(value, dict):
        return {k: interpolated(v, env) for k, v in value.items()}
    return [interpolated(v, env) for v in value] if isinstance(value, list) else value


def merged(base: dict, over: dict) -> dict:
    """over on base: maps are merged at every depth, all else is replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


#: Keys of agents that are named one by one, and the list they make up.
NAMED = {"participant_": "participants", "debater_": "debaters"}


def unwrapped(tree: dict, kind: str) -> dict:
    """What stands under the file's one key (variant, task, model), or the whole of a file without it."""
    return tree.get(kind, tree)


def inherited(trees: dict[str, dict], parent_key: str = "extends") -> dict[str, dict]:
    """Each tree on the one it names, which is a key of trees (a file's name); what that one extends itself does not count."""
    out = {}
    for name, tree in trees.items():
        own = {k: v for k, v in tree.items() if k != parent_key}
        if (parent := tree.get(parent_key)) is not None:
            if parent not in trees:
                raise FileNotFoundError(f"{name} extends {parent}, which is not there")
            own = merged({k: v for k, v in trees[parent].items() if k != parent_key}, own)
        out[name] = own
    return out


def grouped_agents(tree: dict) -> dict:
    """The tree with agents named participant_1, debater_2 and so on as lists, in the order of their names; a list that is there already stays."""
    agents = tree.get("agents")
    if not isinstance(agents, dict):
        return tree
    agents = dict(agents)
    for prefix, plural in NAMED.items():
        names = sorted(k for k in agents if k.startswith(prefix)) if plural not in agents else []
        if names:
            agents[plural] = [{"id": k, **agents.pop(k)} for k in names]
    return {**tree, "agents": agents}


def named_agents(agents: Any) -> list[dict]:
    """Agents as a list of records with an id, whether they were listed or named; a name that stands for a list gives one for each."""
    if isinstance(agents, dict):
        out = []
        for name, value in agents.items():
            out += [{"id": f"{name}_{i}", **a} for i, a in enumerate(value)] if isinstance(value, list) else [{"id": name, **(value or {})}]
        return out
    return [{"id": a.get("id", f"agent_{i}"), **a} for i, a in enumerate(agents or [])]


def load_variants(folder: str, env: dict[str, str] | None = None) -> dict[str, dict]:
    """Variants of the files *.yaml of a folder by id: interpolated, on what they extend, with agents grouped."""
    import yaml

    files = {p.name: unwrapped(interpolated(yaml.safe_load(p.read_text()) or {}, env), "variant") for p in sorted(Path(folder).glob("*.yaml"))}
    return {tree.get("id", Path(name).stem): grouped_agents(tree) for name, tree in inherited(files).items()}


def load_tree(folder: str, env: dict[str, str] | None = None, kind: str = "") -> dict[str, dict]:
    """Files *.yaml of a folder, not of folders below it, by their id or name. kind: the key that may wrap a file's content."""
    import yaml

    out = {}
    for p in sorted(Path(folder).glob("*.yaml")):
        tree = unwrapped(interpolated(yaml.safe_load(p.read_text()) or {}, env), kind)
        out[tree.get("id", p.stem)] = tree
    return out


def dimension(spark: SparkSession, trees: dict[str, dict], columns: dict[str, str]) -> DataFrame:
    """A table of one row per tree; columns: name -> dotted path. Values are strings."""

    def at(tree: Any, path: str) -> str | None:
        for k in path.split("."):
            tree = tree.get(k) if isinstance(tree, dict) else None
        return None if tree is None else str(tree)

    rows = [(name, *(at(t, p) for p in columns.values())) for name, t in trees.items()]
    return spark.createDataFrame(rows, ", ".join(["id string", *(f"{c} string" for c in columns)]))

"""Predicates over JSON trees of any depth and ignore rules over paths.

No expression says 'at any depth', so one Arrow pass parses each tree and yields what
it names; what is asked of that are expressions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys under which a tree names a conversation or an index, and typed links.
CONVERSATION, INDEX = "conversation", "index"
ONE = {
    CONVERSATION: frozenset(("conversation_id", "owner_conversation_id", "created_by_conversation_id")),
    INDEX: frozenset(("index", "index_id", "source_index", "source_index_id", "created_by_index_id", "source_fingerprint_index")),
}
MANY = {
    CONVERSATION: frozenset(("conversation_ids", "source_conversation_ids")),
    INDEX: frozenset(("indexes", "index_ids", "source_indexes", "source_index_ids")),
}
RECORDS = {CONVERSATION: ("source_conversations", None), INDEX: ("context_items", "index")}
LINK_KINDS = ("index", "topic", "dossier")
LINK_ONE = {
    "index": ("index", "index_id", "source_index", "source_index_id", "created_by_index_id"),
    "topic": ("topic", "topic_id", "source_topic"),
    "dossier": ("dossier", "dossier_id", "source_dossier"),
}
LINK_MANY = {"index": ("indexes", "index_ids", "source_indexes", "source_index_ids"), "topic": ("topics", "topic_ids"), "dossier": ("dossiers", "dossier_ids")}
_LINK_ONE = {key: kind for kind, keys in LINK_ONE.items() for key in keys}
_LINK_MANY = {key: kind for kind, keys in LINK_MANY.items() for key in keys}
_ITEM = pa.list_(pa.struct([("role", pa.string()), ("value", pa.string())]))
ITEMS = "array<struct<role:string,value:string>>"


def _nodes(tree: object) -> Iterator[object]:
    """Every node of a parsed tree, without recursion."""
    waiting = [tree]
    while waiting:
        node = waiting.pop()
        yield node
        waiting += node.values() if isinstance(node, dict) else node if isinstance(node, list) else ()


def _spelled(value: object) -> str | None:
    """A scalar as text; nothing for objects and lists."""
    return None if isinstance(value, (dict, list)) else str(value)


def _ids(value: object) -> list[object]:
    return [value["id"]] if isinstance(value, dict) and "id" in value else []


def named(tree: object) -> set[tuple[str, str]]:
    """(role, value): conversations and indexes that a tree names, and `link-` kinds of typed links."""
    out: set[tuple[str, str | None]] = set()
    for node in _nodes(tree):
        if not isinstance(node, dict):
            continue
        if node.get("kind") in LINK_KINDS and isinstance(node.get("id"), str):
            out.add((f"link-{node['kind']}", node["id"]))
        for key, value in node.items():
            rows = value if isinstance(value, list) else []
            for role in (CONVERSATION, INDEX):
                if key in ONE[role]:
                    out.update((role, _spelled(x)) for x in [value, *(_ids(value) if role == INDEX else [])])
                elif key in MANY[role]:
                    out.update((role, _spelled(x)) for row in rows for x in [row, *(_ids(row) if role == INDEX else [])])
                elif key == RECORDS[role][0]:
                    out.update((role, _spelled(x)) for row in rows for x in _ids(row) if RECORDS[role][1] in (None, row.get("kind")))
            if key in _LINK_ONE:
                out.update((f"link-{_LINK_ONE[key]}", x) for x in (_ids(value) if isinstance(value, dict) else [value]) if isinstance(x, str))
            elif key in _LINK_MANY:
                out.update((f"link-{_LINK_MANY[key]}", x) for row in rows for x in (_ids(row) if isinstance(row, dict) else [row]) if isinstance(x, str))
    return {(role, value) for role, value in out if value}


def _parsed(text: str | None) -> object:
    try:
        return json.loads(text) if text else None
    except ValueError:
        return None


def _named(tree: Column) -> Column:
    @F.arrow_udf(ITEMS)
    def run(trees: pa.Array) -> pa.Array:
        return pa.array([[{"role": r, "value": v} for r, v in sorted(named(_parsed(t)))] for t in trees.to_pylist()], _ITEM)

    return run(tree)


def _strings(tree: Column) -> Column:
    @F.arrow_udf("array<string>")
    def run(trees: pa.Array) -> pa.Array:
        return pa.array([list(dict.fromkeys(n for n in _nodes(_parsed(t)) if isinstance(n, str))) for t in trees.to_pylist()], pa.list_(pa.string()))

    return run(tree)


def references(tree: Column, role: str, value: str) -> Column:
    """Whether a JSON tree names a conversation or an index; nothing names the empty id."""
    if not value:
        return F.lit(False)
    return F.exists(_named(tree), lambda n: (n["role"] == role) & (n["value"] == value))


def artifact_links(tree: Column) -> Column:
    """(kind, id) of every typed link of a JSON tree."""
    links = F.filter(_named(tree), lambda n: n["role"].startswith("link-"))
    return F.transform(links, lambda n: F.struct(F.substring(n["role"], 6, 20).alias("kind"), n["value"].alias("id")))


def paths_mentioned(paths: Column) -> Column:
    """Of an array of paths those that occur in one of _strings (see with_strings)."""
    return F.filter(paths, lambda p: (p != "") & F.exists(F.col("_strings"), lambda s: F.contains(s, p)))


def with_strings(rows: DataFrame, tree: str) -> DataFrame:
    """Rows with _strings, the string values of a tree: paths_mentioned() reads them."""
    return rows.withColumn("_strings", _strings(F.col(tree)))


@dataclass(frozen=True)
class IgnoreRule:
    pattern: str
    anchored: bool
    directory_only: bool
    line: int


class NegatedRule(ValueError):
    """A rule begins with '!', which would bring back files; such a list is refused as a whole."""


def parse_ignore(text: str) -> list[IgnoreRule]:
    """Rules of a list: one pattern a line, comments and blank lines aside; '/' first anchors, '/' last means directories."""
    rules = []
    for n, raw in enumerate(text.splitlines(), 1):
        line = raw.strip()
        if not line or line.startswith("#"):
            continue
        if line.startswith("!"):
            raise NegatedRule(f"line {n}")
        body = line.strip("/")
        if body:
            rules.append(IgnoreRule(body, line.startswith("/") or "/" in body, line.endswith("/"), n))
    return rules


def _regex(rule: IgnoreRule) -> str:
    glob = re.escape(rule.pattern).replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    head = "^" if rule.anchored else "(?:^|/)"
    return f"{head}{glob}" + ("/" if rule.directory_only else "(?:/|$)")


def ignored_by(path: Column, rules: list[IgnoreRule]) -> Column:
    """The line of the first rule that a relative path, or a directory above it, matches; null if none does."""
    out = F.lit(None).cast("int")
    for rule in reversed(rules):
        out = F.when(path.rlike(_regex(rule)), rule.line).otherwise(out)
    return out


def under(path: Column, root: str) -> Column:
    return (path == root) | path.startswith(root.rstrip("/") + "/")


def allowed(path: Column, roots: list[str]) -> Column:
    return F.greatest(F.lit(False), *(under(path, r) for r in roots)) if roots else F.lit(False)

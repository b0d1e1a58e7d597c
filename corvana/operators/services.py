"""Answers of model services as columns, routes of a model catalog, arguments against a schema."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvana.functions import text as T
from corvana.operators.vectors import dense_normalize

EMBEDDINGS = "struct<embedding:array<double>,data:array<struct<index:int,embedding:array<double>>>>"
RERANK = "struct<scores:array<double>,results:array<struct<index:int,document_index:int,relevance_score:double,score:double,rank_score:double,logit:double>>,data:array<struct<index:int,document_index:int,relevance_score:double,score:double,rank_score:double,logit:double>>>"


def embeddings(payload: Column, expected: int) -> Column:
    """Unit vectors of an embedding answer in the order of their indexes; null if their number is not the expected one."""
    got = F.from_json(payload, EMBEDDINGS)
    single = F.array(dense_normalize(got["embedding"]))
    rows = F.transform(got["data"], lambda r, k: F.struct(F.coalesce(r["index"], k).alias("index"), dense_normalize(r["embedding"]).alias("v")))
    many = F.transform(F.array_sort(F.filter(rows, lambda r: F.size(r["v"]) > 0)), lambda r: r["v"])
    out = F.when(got["embedding"].isNotNull(), single).otherwise(many)
    return F.when(F.size(out) == expected, out)


def rerank_scores(payload: Column, expected: int) -> Column:
    """Scores by document of a rerank answer in any of its shapes, 0 where one is missing; null without any."""
    got = F.coalesce(F.from_json(payload, RERANK), F.from_json(F.concat(F.lit('{"results": '), payload, F.lit("}")), RERANK))
    rows = F.coalesce(got["results"], got["data"], F.from_json(F.concat(F.lit('{"results": '), payload, F.lit("}")), RERANK)["results"])
    keyed = F.transform(rows, lambda r, k: F.struct(F.coalesce(r["index"], r["document_index"], k).alias("k"), F.coalesce(r["relevance_score"], r["score"], r["rank_score"], r["logit"], F.lit(0.0)).alias("s")))
    kept = F.filter(keyed, lambda x: (x["k"] >= 0) & (x["k"] < expected))
    by_index = F.transform(F.sequence(F.lit(0), F.lit(expected - 1)), lambda k: F.coalesce(F.try_element_at(F.transform(F.filter(kept, lambda x: x["k"] == k), lambda x: x["s"]), F.lit(-1)), F.lit(0.0)))
    direct = F.transform(got["scores"], lambda x: F.coalesce(x, F.lit(0.0)))
    return F.when(F.size(direct) >= expected, F.slice(direct, 1, expected)).when(F.size(kept) > 0, by_index)


def embedding_text(header: Column, body: Column, limit: int) -> Column:
    """Header and content under a limit; the content gets what the header leaves."""
    short = F.when((F.length(header) >= limit) & (T.strip(body) != ""), T.compact(header, max(120, int(limit * 0.45)))).when(F.length(header) >= limit, T.compact(header, limit)).otherwise(header)
    room = F.greatest(F.lit(0), limit - F.length(short) - len("\ncontent: "))
    flat = T.collapse(body)
    side = F.greatest(F.lit(1), F.floor((room - 5) / 2).cast("int"))
    tail = F.greatest(F.lit(1), room - 5 - side)
    cut = F.when(F.length(flat) <= room, flat).when(room <= 12, T.rstrip(F.substring(flat, F.lit(1), room))).otherwise(F.concat(T.rstrip(F.substring(flat, F.lit(1), side)), F.lit(" ... "), T.lstrip(F.substring(flat, F.length(flat) - tail + 1, tail))))
    return F.when((flat == "") | (room == 0), short).otherwise(F.concat(short, F.lit("\ncontent: "), cut))


def progress_id(key: Mapping[str, object]) -> str:
    """The name of a checkpoint: a digest of everything that its rows depend on."""
    return "embedding-" + hashlib.sha256(json.dumps(dict(key), sort_keys=True).encode()).hexdigest()[:16]


def progress_matches(rows: DataFrame, key: Mapping[str, object]) -> Column:
    """Whether a stored checkpoint agrees with a key in every part."""
    out = F.lit(True)
    for name, value in key.items():
        out = out & F.col(name).eqNullSafe(F.lit(value))
    return out


def routes_for_tasks(routes: DataFrame, tasks: list[str]) -> DataFrame:
    """Routes (route, tasks, kind, endpoints, priority) that serve one of some tasks."""
    return routes.filter(F.arrays_overlap("tasks", F.array(*map(F.lit, tasks))))


def routes_for_capability(routes: DataFrame, kind: str, tasks: list[str], endpoint: str) -> DataFrame:
    """Routes of a kind, for one of the tasks or with an endpoint, by priority and name."""
    hit = (F.col("kind") == kind) | F.arrays_overlap("tasks", F.array(*map(F.lit, tasks))) | F.array_contains("endpoints", endpoint)
    return routes.filter(hit).orderBy(F.desc((F.col("kind") == kind).cast("int")), F.desc("priority"), "route")


def route_for_task(routes: DataFrame, task: str) -> DataFrame:
    """The route of a task: the default one, else the highest priority."""
    return routes_for_tasks(routes, [task]).orderBy(F.desc(F.coalesce("is_default", F.lit(False))), F.desc("priority"), "route").limit(1)


class SchemaError(ValueError):
    """Arguments, or a schema, that are not valid."""


_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}


def check_schema(schema: dict) -> dict:
    """A subset of JSON schema: six types, required, additionalProperties, properties, items and enum."""
    if not isinstance(schema, dict) or schema.get("type") not in _TYPES:
        raise SchemaError("a schema needs one of the six types")
    if set(schema) - {"type", "required", "additionalProperties", "properties", "items", "enum", "description"}:
        raise SchemaError("a schema has an unknown key")
    for part in [*schema.get("properties", {}).values(), *([schema["items"]] if "items" in schema else [])]:
        check_schema(part)
    return schema


def check_arguments(value: object, schema: dict, at: str = "arguments") -> None:
    kind = schema["type"]
    if not isinstance(value, _TYPES[kind]) or (isinstance(value, bool) and kind in ("integer", "number")):
        raise SchemaError(f"{at} is no {kind}")
    if "enum" in schema and value not in schema["enum"]:
        raise SchemaError(f"{at} is none of the values allowed")
    if kind == "object":
        parts = schema.get("properties", {})
        if missing := [k for k in schema.get("required", []) if k not in value]:
            raise SchemaError(f"{at} lacks {missing[0]}")
        if schema.get("additionalProperties") is False and (extra := [k for k in value if k not in parts]):
            raise SchemaError(f"{at} has an unknown {extra[0]}")
        for k, v in value.items():
            if k in parts:
                check_arguments(v, parts[k], f"{at}.{k}")
    elif kind == "array" and "items" in schema:
        for k, v in enumerate(value):
            check_arguments(v, schema["items"], f"{at}[{k}]")

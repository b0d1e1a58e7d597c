"""Code intelligence: symbols, imports, calls, constants and commands of Python sources, and what joins make of them.

Syntax trees need Python; one Arrow pass over the files yields rows of one shape, and
call edges, hotspots, helper paths and boundaries are joins and aggregations on them.
"""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvana.functions import text as T
from corvana.operators import skills

ROW = "path string, kind string, name string, qualname string, line int, end_line int, detail string"
_NAMES = [x.split(" ")[0] for x in ROW.split(", ")]


def call_name(node: ast.AST) -> str:
    """Dotted name of what is called; nothing for other expressions."""
    parts: list[str] = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else ""


def artifact_families(constant: str, value: ast.AST) -> list[dict]:
    """Families that a literal list of dictionaries in a constant *ARTIFACT_FAMILIES* declares, with the kind and storage that its name tells."""
    if "ARTIFACT_FAMILIES" not in constant.upper():
        return []
    try:
        listed = ast.literal_eval(value)
    except (ValueError, TypeError, SyntaxError, MemoryError, RecursionError):
        return []
    low = constant.lower()
    storage = "jsonl-ledger" if "jsonl" in low else "json-file" if "json_file" in low or "file_artifact" in low else "json-dir"
    owner = "derived" if "derived" in low else "manual" if "manual" in low else "artifact"
    told = lambda d, *keys: next((str(d[k]) for k in keys if d.get(k)), "")
    return [
        {"family_kind": f"{owner}-{storage}", "storage": storage, "path_key": told(d, "path_key"), "artifact_kind": told(d, "artifact_kind", "artifact_id"), "cleanup_policy": told(d, "cleanup_policy"), "report_label": told(d, "report_label")}
        for d in (listed if isinstance(listed, (list, tuple)) else ())
        if isinstance(d, dict)
    ]


class _Visitor(ast.NodeVisitor):
    def __init__(self) -> None:
        self.rows: list[tuple[str, str, str, int, int, str]] = []
        self.scope: list[str] = []

    def add(self, kind: str, name: str, node: ast.AST, detail: str = "") -> None:
        line = getattr(node, "lineno", 0)
        self.rows.append((kind, name, ".".join([*self.scope, name]) if kind in ("function", "class") else ".".join(self.scope), line, getattr(node, "end_lineno", line) or line, detail))

    def _nested(self, kind: str, node: ast.AST) -> None:
        self.add(kind, node.name, node, (ast.get_docstring(node) or "").split("\n", 1)[0])
        self.scope.append(node.name)
        self.generic_visit(node)
        self.scope.pop()

    def visit_FunctionDef(self, node: ast.FunctionDef) -> None:
        self._nested("function", node)

    def visit_AsyncFunctionDef(self, node: ast.AsyncFunctionDef) -> None:
        self._nested("function", node)

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self._nested("class", node)

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.add("import", a.name, node, a.asname or "")

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        for a in node.names:
            self.add("import", f"{'.' * node.level}{node.module or ''}", node, a.name)

    def visit_Call(self, node: ast.Call) -> None:
        name = call_name(node.func)
        if name:
            first = node.args[0].value if node.args and isinstance(node.args[0], ast.Constant) and isinstance(node.args[0].value, str) else ""
            self.add("command" if name.endswith("add_parser") and first else "call", first if name.endswith("add_parser") and first else name, node, first)
        self.generic_visit(node)

    def visit_Assign(self, node: ast.Assign) -> None:
        if not self.scope:
            for target in node.targets:
                if isinstance(target, ast.Name) and target.id.isupper():
                    self.add("constant", target.id, node, ast.unparse(node.value)[:160])
                    for family in artifact_families(target.id, node.value):
                        self.add("family", family["path_key"], node, json.dumps(family, sort_keys=True))
        self.generic_visit(node)


def source_rows(path: str, source: str | None) -> list[tuple]:
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError) as error:
        return [(path, "error", type(error).__name__, "", getattr(error, "lineno", 0) or 0, 0, str(error)[:160])]
    visitor = _Visitor()
    visitor.visit(tree)
    return [(path, "module", path.rsplit("/", 1)[-1].removesuffix(".py"), "", 1, len((source or "").splitlines()), (ast.get_docstring(tree) or "").split("\n", 1)[0]), *((path, *r) for r in visitor.rows)]


def code_rows(files: DataFrame) -> DataFrame:
    """Rows (path, kind, name, qualname, line, end_line, detail) of files with path and content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for path, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in source_rows(path, source)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n.endswith("line") else pa.string()) for n, c in zip(_NAMES, zip(*rows, strict=True), strict=True)], _NAMES)

    return files.select("path", "content").mapInArrow(run, ROW)


def code_map(files: DataFrame, uri: str) -> DataFrame:
    """The rows of files as a stored relation: edges, hotspots, boundaries and search sets read it, and no source is parsed again."""
    code_rows(files).write.parquet(uri)
    return files.sparkSession.read.schema(ROW).parquet(uri)


def summary(rows: DataFrame) -> DataFrame:
    """path, kind, n, first_line: rows of each kind in each file, of each kind, of each file, and of all, from one pass."""
    sets = [[F.col("path"), F.col("kind")], [F.col("kind")], [F.col("path")], []]
    return rows.groupingSets(sets, "path", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first_line"))


def call_edges(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """caller_path, caller, callee_path, callee, line: calls resolved to a qualified name, else to the one symbol of that name."""
    symbols = rows.filter("kind IN ('function', 'class')")
    by_qual = symbols.groupBy("qualname").agg(F.max_by(F.struct("path", "qualname"), F.struct("path", "line")).alias("q"))
    by_name = symbols.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.first(F.struct("path", "qualname")).alias("s")).filter("n = 1").select(F.col("name").alias("tail"), "s")
    calls = rows.filter("kind = 'call'").select("path", F.col("qualname").alias("caller"), "name", "line", T.base_name(F.replace("name", F.lit("."), F.lit("/"))).alias("tail"))
    both = calls.join(by_qual.withColumnRenamed("qualname", "name"), "name", "left").join(by_name, "tail", "left").withColumn("t", F.coalesce("q", "s")).filter("t IS NOT NULL")
    edges = both.select(F.col("path").alias("caller_path"), "caller", F.col("t.path").alias("callee_path"), F.col("t.qualname").alias("callee"), "line").distinct()
    return edges if limit is None else edges.orderBy("caller_path", "line", "callee").limit(limit)


def hotspots(rows: DataFrame, limit: int = 15) -> DataFrame:
    """The longest functions with the number of their calls."""
    calls = rows.filter("kind = 'call'").groupBy("path", F.col("qualname")).agg(F.count(F.lit(1)).alias("calls"))
    functions = rows.filter("kind = 'function'").select("path", "qualname", "line", (F.col("end_line") - F.col("line") + 1).alias("lines"))
    return functions.join(calls, ["path", "qualname"], "left").select("path", "qualname", "line", "lines", F.coalesce("calls", F.lit(0)).alias("calls")).orderBy(F.desc("lines"), F.desc("calls"), "path", "qualname").limit(limit)


def helper_paths(rows: DataFrame, helpers: list[str], limit: int = 200) -> DataFrame:
    """Callers of any of some helpers: the helpers they use and how often."""
    tail = T.base_name(F.replace("name", F.lit("."), F.lit("/")))
    used = rows.filter((F.col("kind") == "call") & tail.isin(helpers)).groupBy("path", F.col("qualname").alias("caller")).agg(F.sort_array(F.collect_set(tail)).alias("helpers"), F.count(F.lit(1)).alias("checks"))
    return used.orderBy(F.desc("checks"), F.desc(F.size("helpers")), "path", "caller").limit(limit)


def boundaries(rows: DataFrame) -> DataFrame:
    """path, public_symbols, imports, incoming of each module."""
    per = rows.groupBy("path").agg(F.count_if(F.col("kind").isin("function", "class") & ~F.col("name").startswith("_") & (F.col("qualname") == F.col("name"))).alias("public_symbols"), F.count_if(F.col("kind") == "import").alias("imports"))
    into = call_edges(rows).filter("caller_path != callee_path").groupBy(F.col("callee_path").alias("path")).agg(F.count(F.lit(1)).alias("incoming"))
    return per.join(into, "path", "left").fillna(0, ["incoming"])


#: Functions of this engine whose callers take part in stopping work, in choosing models, in cleaning up.
HELPERS = {
    "cancellation": ["raise_if_cancelled", "request_stop", "request_stop_by_kind", "request_pause"],
    "model_route": ["route_for_task", "routes_for_tasks", "routes_for_capability", "embed", "rerank"],
    "artifact_lifecycle": ["collect", "cleanup_plans", "apply_plan", "delete_files", "cleanup_superseded", "delete_conversation", "cascade"],
}
#: How this repository is checked, in order.
GATES = [
    (10, "syntax", "python -m compileall -q corvana", "after edits of Python"),
    (20, "tests", "python -m pytest tests/ -x -q", "after changes of behaviour"),
    (30, "oracle", "python -m pytest tests/test_catalogue.py -q", "after changes of queries or their SQL"),
    (40, "bench", "python bench.py", "after changes of plans"),
    (50, "whitespace", "git diff --check", "before a commit"),
]


def role_paths(rows: DataFrame, helpers: dict[str, list[str]] = HELPERS, limit: int = 200) -> DataFrame:
    """role, path, caller, helpers, checks of the functions that call a helper of each role."""
    return reduce(DataFrame.unionByName, (helper_paths(rows, names, limit).withColumn("role", F.lit(role)) for role, names in helpers.items()))


def validation_gates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GATES, "ord int, name string, command string, moment string")


def test_rows(rows: DataFrame, files: DataFrame) -> DataFrame:
    """path, name, qualname, line, tokens of every test (a function test_*): tokens of its names and its own source lines."""
    tests = rows.filter("kind = 'function' AND name LIKE 'test\\_%'").select("path", "name", "qualname", "line", "end_line", F.col("detail").alias("doc"))
    both = tests.join(files.select("path", F.split("content", "\n").alias("_l")), "path")
    source = F.array_join(F.slice("_l", F.col("line"), F.greatest(F.lit(1), F.col("end_line") - F.col("line") + 1)), "\n")
    return both.select("path", "name", "qualname", "line", T.locator_tokens(F.concat_ws(" ", "name", "qualname", "path", "doc", source)).alias("tokens"))


def search_sets(rows: DataFrame) -> DataFrame:
    """set, name, path, line, haystack of everything that a question about code may find, one set beside the other."""
    item = lambda found, name, title, *hay: found.select(F.lit(name).alias("set"), title.alias("name"), "path", "line", F.concat_ws(" ", *hay).alias("haystack"))
    c, kind = F.col, lambda *k: rows.filter(F.col("kind").isin(*k))
    joined = lambda x: F.array_join(x, " ")
    line = lambda found: found.withColumn("line", F.lit(0))
    edges = call_edges(rows)
    parts = [
        item(kind("function", "class"), "symbols", c("name"), "name", "qualname", "path", "detail"),
        item(kind("constant"), "constants", c("name"), "name", "detail", "path"),
        item(kind("family"), "artifact_families", c("name"), "name", "detail", "path"),
        item(kind("command"), "commands", c("name"), "name", "path"),
        item(edges.select(c("caller_path").alias("path"), "caller", "callee", "callee_path", "line"), "call_edges", c("callee"), "caller", "callee", "path", "callee_path"),
        item(line(boundaries(rows)), "service_boundaries", c("path"), "path"),
        item(line(hotspots(rows).drop("line")), "hotspots", c("qualname"), "qualname", "path"),
        item(kind("function").filter(c("name").startswith("test_")), "tests", c("name"), "name", "qualname", "path", "detail"),
        item(kind("module"), "files", c("path"), "path"),
        item(line(validation_gates(rows.sparkSession).withColumn("path", F.lit(""))), "validation_gates", c("name"), "name", "command", "moment"),
    ]
    parts += [item(line(helper_paths(rows, names)), f"{role}_paths", c("caller"), "caller", "path", joined("helpers"), F.lit(role)) for role, names in HELPERS.items()]
    return reduce(DataFrame.unionByName, parts)


def query(sets: DataFrame, text: str, limit: int) -> DataFrame:
    """The best rows of each set: 20 a shared token, 40 for one in the name and 20 for one in the path."""
    asked = T.locator_tokens(F.lit(text))
    shared = F.array_intersect(asked, T.locator_tokens("haystack"))
    hit = lambda name: F.arrays_overlap(asked, T.locator_tokens(name))
    scored = sets.withColumn("score", F.size(shared) * 20 + F.when(hit("name"), 40).otherwise(0) + F.when(hit("path"), 20).otherwise(0)).filter(F.size(shared) > 0)
    w = Window.partitionBy("set").orderBy(F.desc("score"), "line", "path", "name")
    return scored.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit).drop("haystack")


# Imports and calls that a review looks at, with their rules.
RISKY_IMPORTS = {"subprocess": "subprocess_import", "socket": "network_import", "urllib": "network_import", "http": "network_import", "requests": "network_import", "aiohttp": "network_import", "shutil": "filesystem_mutation_import", "pty": "terminal_import"}
RISKY_CALLS = {"os.system": "subprocess_call", "subprocess.Popen": "subprocess_call", "subprocess.run": "subprocess_call", "subprocess.call": "subprocess_call", "shutil.rmtree": "destructive_call", "Path.home": "broad_path_call"}


def _looked_up(key: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def python_findings(files: DataFrame) -> DataFrame:
    """path, line, rule, severity of a script's text, its imports and calls, and its syntax error."""
    rows = code_rows(files)
    imported = _looked_up(F.substring_index(F.regexp_replace("name", r"^\.+", ""), ".", 1), RISKY_IMPORTS)
    rule = F.when(F.col("kind") == "import", imported).when(F.col("kind") == "call", _looked_up(F.col("name"), RISKY_CALLS)).when(F.col("kind") == "error", "python_syntax_error")
    found = rows.withColumn("rule", rule).filter("rule IS NOT NULL").groupBy("path", "kind", "line", "rule", "name").agg(F.count(F.lit(1)).cast("int").alias("n"))
    # One statement may import several names of a module; calls count one by one.
    each = found.withColumn("_", F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == "import", 1).otherwise(F.col("n")))))
    severe = F.col("rule").isin("destructive_call", "python_syntax_error")
    risky = each.select("path", "line", "rule", F.when(severe, "block").otherwise("warn").alias("severity"))
    return risky.union(skills.rule_findings(files, "path", F.col("content")).select("path", F.col("line").cast("int"), "rule", "severity"))

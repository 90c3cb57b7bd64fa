"""Code-index queries over a small tree of its own that comes with the package; ``sf_dir`` is not read."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import semantic
from ..index import SCHEMAS, CodeIndex

TREE = Path(__file__).resolve().parents[1] / "trees/mini"
_INDEX: dict = {}


def index(spark, tree: str | None = None) -> CodeIndex:
    key = (spark.sparkContext.applicationId, str(tree or TREE))
    if key not in _INDEX:
        _INDEX[key] = CodeIndex.scan(spark, key[1])
    return _INDEX[key]


_ASKED = {
    "files": lambda i: i.files().drop("mtime"),
    "summary": lambda i: i.summary(),
    "summary_values": lambda i: i.summary_values(),
    "callers": lambda i: i.callers("load"),
    "callees": lambda i: i.callees("main"),
    "file_calls": lambda i: i.file_calls("users.py"),
    "resolved_calls": lambda i: i.resolved_calls(),
    "roles": lambda i: i.roles(),
    "central": lambda i: i.central(),
    "caller_samples": lambda i: i.caller_samples(),
    "importance": lambda i: i.importance(),
    "flows": lambda i: i.flows(),
    "flow_metrics": lambda i: i.flow_metrics(),
    "duplicates": lambda i: i.duplicates(),
    "entry_points": lambda i: i.entry_points(),
    "impact": lambda i: i.impact("src/app/services/user_service.py"),
    "find_file": lambda i: i.find_file("user_service.py").drop("mtime"),
    "test_files": lambda i: i.test_files(),
    "tests_for": lambda i: i.tests_for("UserService.load"),
    "test_coverage": lambda i: i.test_coverage(),
    "complexity": lambda i: i.complexity(10, 3, 1),
    "orphans": lambda i: i.orphans(),
    "orphan_summary": lambda i: i.orphan_summary(),
    "dependencies": lambda i: i.dependencies(),
    "dependency_problems": lambda i: i.dependency_problems(),
    "import_statistics": lambda i: i.import_statistics(),
    "endpoints": lambda i: i.endpoints(),
    "http_calls": lambda i: i.http_calls(),
    "http_summary": lambda i: i.http_summary(),
    "latest_migration": lambda i: i.latest_migration(),
    "lookup": lambda i: i.lookup("user"),
    "symbol_texts": lambda i: semantic.symbol_texts(i),
    "document": lambda i: i.document(),
}


def plain(df: DataFrame) -> DataFrame:
    """Arrays of strings joined by ' | ', other nested columns as JSON: what any engine can compare."""
    made = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        made.append((F.array_join(c, " | ", "null") if kind == "array<string>" else F.to_json(c) if kind.startswith(("array", "struct", "map")) else c).alias(name))
    return df.select(*made)


def _query(f):
    return lambda spark, sf_dir: plain(f(index(spark)))


QUERIES = {f"code_{k}": _query(f) for k, f in _ASKED.items()}
QUERIES |= {f"code_table_{k}": _query(lambda i, k=k: i.table(k)) for k in SCHEMAS}
QUERIES["code_diff"] = lambda spark, sf_dir: index(spark, f"{TREE}_v2").diff(index(spark))


def _literal(value, kind: str) -> str:
    if value is None:
        return f"cast(null as {kind})"
    if kind == "varchar":
        return "'" + value.replace("'", "''") + "'"
    return f"cast({str(value).lower()} as {kind})"


def _values(columns: list[list[str]], rows: list[list]) -> str:
    """SQL of a table of known rows."""
    names = ", ".join(f'"{n}"' for n, _ in columns)
    empty = ", ".join(f'cast(null as {k}) as "{n}"' for n, k in columns)
    if not rows:
        return f"select {empty} where false"
    return f"select * from (values {', '.join('(' + ', '.join(_literal(v, k) for v, (_, k) in zip(r, columns)) + ')' for r in rows)}) t({names})"


def _oracles() -> dict[str, str]:
    """Known answers, kept beside this module and checked by hand against the tree; see the README."""
    known = Path(__file__).with_name("known.json")
    return {name: _values(x["columns"], x["rows"]) for name, x in json.loads(known.read_text()).items()} if known.is_file() else {}


ORACLE_SQL = _oracles()

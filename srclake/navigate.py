"""The index as one JSON document, and paths into it."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

#: Sections of the document: (name, table of the index).
SECTIONS = {
    "files": lambda i: i.files().drop("mtime"),
    "symbols": lambda i: i.table("symbol"),
    "imports": lambda i: i.import_statistics(),
    "api_endpoints": lambda i: i.endpoints(),
    "schemas": lambda i: i.table("schema"),
    "models": lambda i: i.table("model"),
    "database": lambda i: i.table("ddl"),
    "services": lambda i: i.table("service"),
    "dependencies": lambda i: i.dependencies(),
    "dependency_problems": lambda i: i.dependency_problems(),
    "todos": lambda i: i.table("todo"),
    "environment_variables": lambda i: i.table("env").distinct(),
    "external_http_calls": lambda i: i.http_calls(),
    "middleware": lambda i: i.table("middleware"),
    "websockets": lambda i: i.table("websocket"),
    "migrations": lambda i: i.table("migration"),
    "test_coverage": lambda i: i.test_coverage(),
    "complexity_warnings": lambda i: i.complexity(),
    "orphaned_files": lambda i: i.orphans(),
    "potential_duplicates": lambda i: i.duplicates(),
    "execution_flow": lambda i: i.flow_metrics(),
    "centrality": lambda i: i.central(),
    "call_graph": lambda i: i.calls().groupBy("caller").agg(F.array_sort(F.collect_set("callee")).alias("calls")),
}


def overview(index, meta: dict | None = None) -> dict:
    """Meta, summary and badges alone."""
    from .analyses import badges

    summary = {r.name: r.value for r in index.summary_values().collect()}
    return {"meta": meta or {}, "summary": summary, "badges": badges(summary)}


def document(index, meta: dict | None = None) -> dict:
    """All sections of an index of one project in a dict; ``CodeIndex.save`` is the form for larger ones."""
    out = overview(index, meta)
    for name, table in SECTIONS.items():
        rows = [json.loads(r[0]) for r in table(index).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]
        out[name] = sorted(rows, key=lambda r: json.dumps(r, sort_keys=True))
    return out


def load(path: str) -> dict:
    """A document that was written as JSON."""
    try:
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
    except json.JSONDecodeError as e:
        raise ValueError(f"{path} is no JSON: {e}") from None
    if not isinstance(made, dict):
        raise ValueError(f"{path} holds no document")
    return made


def schema(index) -> dict[str, str]:
    """The Spark schema of each section."""
    return {name: table(index).schema.simpleString() for name, table in SECTIONS.items()}


def shorten(value, most: int = 50) -> str:
    text = str(value)
    return text[:most] + "..." if len(text) > most else text


def _walk(data, path: str):
    """(value, None), or (None, error) with the part of the path that leads nowhere."""
    parts = path.split(".") if path else []
    for n, part in enumerate(parts, 1):
        here = ".".join(parts[:n])
        if isinstance(data, dict):
            if part not in data:
                return None, {"error": f"no key '{part}'", "path": here, "available_keys": list(data)[:10]}
            data = data[part]
        elif isinstance(data, list):
            if not part.isdigit():
                return None, {"error": f"'{part}' is no place in an array", "path": here, "available_keys": None}
            if int(part) >= len(data):
                return None, {"error": f"no place {part} in an array of {len(data)}", "path": here, "available_keys": None}
            data = data[int(part)]
        else:
            return None, {"error": f"'{part}' leads into a plain value", "path": here, "available_keys": None}
    return data, None


def keys(data, path: str = "", limit: int | None = None) -> dict:
    """What lies at a path: keys with type and size, or an array's size with a sample of 5. No limit or 0 is all keys."""
    value, error = _walk(data, path)
    if error:
        return error
    kind = lambda v: "object" if isinstance(v, dict) else "array" if isinstance(v, list) else type(v).__name__
    if isinstance(value, dict):
        rows = [{"key": k, "type": kind(v), **({"count": len(v)} if isinstance(v, (dict, list)) else {"value": shorten(v)})} for k, v in value.items()]
        return {"path": path or "(root)", "keys": rows[: limit or None]}
    if isinstance(value, list):
        return {"path": path, "type": "array", "count": len(value), "sample": value[: limit or 5]}
    return {"path": path, "type": kind(value), "value": value}


def extract(data, path: str, limit: int | None = None) -> dict:
    """The data at a path; an array is cut to the limit, and says so."""
    value, error = _walk(data, path)
    if error:
        return error
    if isinstance(value, list) and limit:
        return {"path": path, "total": len(value), "limited_to": limit, "data": value[:limit]}
    return {"path": path, "data": value}

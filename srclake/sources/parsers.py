"""Parsers of source files: each yields (kind, record) facts. New languages register with ``parser``."""

from __future__ import annotations

import ast
import hashlib
import json
import re
import sys
import tomllib

from ..config import DEFAULTS

Fact = tuple[str, dict]
_REGISTRY: list[tuple[str, tuple[str, ...], object]] = []


def parser(language: str, *endings: str):
    """Register ``f(path, text, rules) -> iterable of facts`` for file endings; the last registration wins."""

    def add(f):
        _REGISTRY.insert(0, (language, endings, f))
        return f

    return add


def parse_file(path: str, content: bytes | None, rules: dict) -> tuple[str, list[Fact], str | None]:
    """(language, facts, error) of one file; undecodable bytes are replaced and no input fails the job."""
    text = (content or b"").decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")
    rules = {**DEFAULTS, **(rules or {})}
    facts, language, error = [], "other", None
    low = path.lower()
    compose = low.endswith((".yml", ".yaml")) and "docker" in low.split("/")[-1]
    for name, endings, f in _REGISTRY:
        if low.endswith(endings) or (compose and name == "compose"):
            language = name
            try:
                facts += list(f(path, text, rules))
            except Exception as e:  # noqa: BLE001 - one broken file is a row, not a failure
                error = f"{type(e).__name__}: {e}"
            break
    facts += list(line_facts(path, text, language))
    if language == "dependencies" and path.endswith(".txt") and not path.split("/")[-1].startswith("requirements"):
        language = "other"
    return language, facts, error


def _first(text: str | None, most: int = 200) -> str | None:
    line = (text or "").strip().split("\n")[0].strip()
    return (line[:most] + "..." if len(line) > most else line) or None


def _dotted(node) -> str:
    """The source text of a called or decorating expression; arguments and subscripts are left out."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        return f"{_dotted(node.value)}.{node.attr}"
    if isinstance(node, ast.Call):
        return _dotted(node.func)
    if isinstance(node, ast.Subscript):
        return f"{_dotted(node.value)}[...]"
    return "?"


def signature(f) -> dict:
    a = f.args
    named = [*a.posonlyargs, *a.args]
    defaults = len(named) - len(a.defaults)
    params = [{"name": x.arg, "type": ast.unparse(x.annotation) if x.annotation else None, "has_default": i >= defaults} for i, x in enumerate(named)]
    if a.vararg:
        params.append({"name": "*" + a.vararg.arg, "type": ast.unparse(a.vararg.annotation) if a.vararg.annotation else None, "has_default": False})
    params += [{"name": x.arg, "type": ast.unparse(x.annotation) if x.annotation else None, "has_default": d is not None} for x, d in zip(a.kwonlyargs, a.kw_defaults)]
    if a.kwarg:
        params.append({"name": "**" + a.kwarg.arg, "type": ast.unparse(a.kwarg.annotation) if a.kwarg.annotation else None, "has_default": False})
    result = ast.unparse(f.returns) if f.returns else None
    text = ", ".join(p["name"] + (f": {p['type']}" if p["type"] else "") + (" = ..." if p["has_default"] else "") for p in params)
    return {"params": params, "return_type": result, "formatted": f"({text})" + (f" -> {result}" if result else "")}


def body_hash(f) -> str:
    body = f.body[1:] if f.body and isinstance(f.body[0], ast.Expr) and isinstance(f.body[0].value, ast.Constant) else f.body
    return hashlib.md5("".join(ast.dump(x) for x in body).encode()).hexdigest()[:12]


class _Facts(list):
    """Facts of a file, with its lines at hand."""

    lines: list[str]


def code_slice(lines: list[str], first: int, most: int = 50) -> str:
    """The code from a line on: at most so many lines, up to the next definition or decorator that is not deeper."""
    part = lines[first - 1 : first - 1 + most]
    if not part:
        return ""
    depth = len(part[0]) - len(part[0].lstrip())
    for n, line in enumerate(part[1:], 1):
        body = line.lstrip()
        if body and len(line) - len(body) <= depth and re.match(r"@|(?:async\s|def\s|class\s)", body):
            return "\n".join(part[:n]).strip()
    return "\n".join(part).strip()


def base_matches(base: str, rule: str) -> bool:
    """A base class is the rule's, is it under some module, or has an undotted rule as its last part."""
    return base == rule or base.endswith("." + rule) or ("." not in rule and base.split(".")[-1] == rule)


def auth_of(signature_text: str, decorators: str, rules: dict) -> str | None:
    """What requires a login: a parameter first, then a decorator."""
    for text, kind in ((signature_text, "parameters"), (decorators, "decorators")):
        for pattern in rules["auth"].get(kind, ()):
            if m := re.search(pattern, text, re.I):
                return m[1] if m.lastindex else m[0]
    return None


def _function(path, f, owner, facts, rules):
    name = f"{owner}.{f.name}" if owner else f.name
    decorators = [_dotted(d) for d in f.decorator_list]
    sig = signature(f)
    record = {"kind": "method" if owner else "function", "class": owner, "name": f.name, "line": f.lineno, "end_line": f.end_lineno, "is_async": isinstance(f, ast.AsyncFunctionDef), "bases": [], "decorators": decorators, "signature": sig, "docstring": ast.get_docstring(f), "body_hash": body_hash(f)}
    facts.append(("symbol", record))
    record["code"] = code_slice(facts.lines, f.lineno)
    seen = set()
    for node in ast.walk(f):
        if isinstance(node, ast.Call):
            callee = _dotted(node.func)
            if callee not in seen:
                seen.add(callee)
                facts.append(("call", {"class": owner, "func": f.name, "line": f.lineno, "pos": len(seen), "callee": callee}))
            pattern = None
            if callee in ("getattr", "setattr") and len(node.args) > 1 and not isinstance(node.args[1], ast.Constant):
                pattern = callee
            elif callee in ("eval", "exec", "globals", "locals"):
                pattern = callee
            elif callee.split(".")[-1] in ("import_module", "__import__"):
                pattern = "import"
            elif isinstance(node.func, ast.Subscript):
                pattern = "subscript"
            if pattern:
                facts.append(("dynamic", {"symbol": name, "line": node.lineno, "pattern": pattern, "severity": "high" if pattern in ("eval", "exec") else "medium"}))
    sig_text, names = ast.unparse(f.args), " ".join(ast.unparse(d) for d in f.decorator_list)
    sockets = False
    for d in f.decorator_list:
        target = _dotted(d)
        verb = target.split(".")[-1].lower()
        args, kw = (d.args, {k.arg: k.value for k in d.keywords}) if isinstance(d, ast.Call) else ([], {})
        constant = lambda x: x.value if isinstance(x, ast.Constant) else None
        if isinstance(d, ast.Call) and "." in target and verb == "websocket":
            sockets = True
            facts.append(("websocket", {"line": f.lineno, "path": constant(args[0]) if args else None, "handler": f.name}))
        elif isinstance(d, ast.Call) and verb == "middleware":
            facts.append(("middleware", {"line": f.lineno, "name": f.name, "type": "custom"}))
        elif isinstance(d, ast.Call) and (rule := next(((r, m) for r in rules["routes"] if (m := re.match(r["pattern"], target))), None)):
            rule, m = rule
            listed = kw.get("methods") or (args[0] if args and isinstance(args[0], (ast.List, ast.Tuple)) else None)
            methods = [m[1].upper()] if m.lastindex else [str(constant(x)).upper() for x in getattr(listed, "elts", [])] or ["GET"]
            auth = auth_of(sig_text, names, rules)
            for method in methods:
                facts.append(("route", {"line": f.lineno, "method": method, "path": constant(args[0]) if args else None, "handler": f.name, "framework": rule["framework"], "summary": constant(kw.get("summary")), "description": constant(kw.get("description")), "docstring": _first(ast.get_docstring(f)), "auth_required": auth is not None, "auth_type": auth}))
    if not sockets and any(a.annotation is not None and _dotted(a.annotation).split(".")[-1] == "WebSocket" for a in f.args.args):
        facts.append(("websocket", {"line": f.lineno, "path": None, "handler": f.name}))


def _class(path, c, facts, rules):
    bases, decorators = [_dotted(b) for b in c.bases], [_dotted(d) for d in c.decorator_list]
    facts.append(("symbol", {"kind": "class", "class": None, "name": c.name, "line": c.lineno, "end_line": c.end_lineno, "is_async": False, "bases": bases, "decorators": decorators, "signature": None, "docstring": ast.get_docstring(c), "body_hash": None, "code": code_slice(facts.lines, c.lineno)}))
    assigned = {t.id: x.value for x in c.body if isinstance(x, ast.Assign) for t in x.targets if isinstance(t, ast.Name)}
    by_base = lambda kind: next(((b, r["type"]) for r in rules[kind] if "base" in r for b in bases if base_matches(b, r["base"])), None)
    marker = next((r for r in rules["models"] if r.get("marker") in assigned), None)
    if found := by_base("schemas"):
        facts.append(("schema", {"name": c.name, "line": c.lineno, "type": found[1], "base": found[0]}))
    elif marker or (found := by_base("models")):
        table = assigned[marker["marker"]].value if marker and isinstance(assigned[marker["marker"]], ast.Constant) else None
        facts.append(("model", {"name": c.name, "line": c.lineno, "type": marker["type"] if marker else found[1], "table": table}))
    for x in c.body:
        if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
            _function(path, x, c.name, facts, rules)
        elif isinstance(x, ast.ClassDef):
            _class(path, x, facts, rules)


def _is_alias(name: str, x) -> bool:
    """A type alias: annotated as one, or a capitalised name for a type expression."""
    if isinstance(x, ast.AnnAssign):
        return _dotted(x.annotation).split(".")[-1] == "TypeAlias"
    generic = isinstance(x.value, ast.Subscript) or (isinstance(x.value, ast.BinOp) and isinstance(x.value.op, ast.BitOr))
    return name[:1].isupper() and not name.isupper() and generic


def _by_lines(text: str, rules: dict) -> list[Fact]:
    """What the lines of a broken file show: functions, classes and their methods with their ends, routes and imports."""
    facts, open_, waiting = [], [], []
    lines = text.split("\n")

    def close(indent: int, line: int) -> None:
        while open_ and open_[-1][0] >= indent:
            open_.pop()[1]["end_line"] = line

    last = 0
    for n, line in enumerate(lines, 1):
        body = line.lstrip()
        if not body or body[0] == "#":
            continue
        indent = len(line) - len(body)
        words = body.replace("(", " ( ").replace(":", " : ").split()
        word = words[1] if words[0] == "async" and len(words) > 1 else words[0]
        if word in ("def", "class") and len(words) > words.index(word) + 1:
            close(indent, last)
            name, owner = words[words.index(word) + 1], open_[-1][1]["name"] if open_ and open_[-1][1]["kind"] == "class" else None
            if indent == 0 or word == "class" or owner:
                record = {"kind": "class" if word == "class" else "method" if owner else "function", "class": owner if word == "def" else None, "name": name, "line": n, "is_async": words[0] == "async", "decorators": [d for d, _ in waiting]}
                facts.append(("symbol", record))
                open_.append((indent, record))
                for d, where in waiting:
                    if word == "def" and (r := next(((r, m) for r in rules["routes"] if (m := re.match(r["pattern"], d))), None)):
                        facts.append(("route", {"line": n, "method": r[1][1].upper() if r[1].lastindex else "GET", "path": where, "handler": name, "framework": r[0]["framework"], "auth_required": False}))
            waiting = []
        elif body[0] == "@":
            close(indent, last)
            quoted = re.search("[\"']([^\"']*)[\"']", body)
            waiting.append((body[1:].partition("(")[0].strip(), quoted[1] if quoted else None))
        elif indent == 0 and words[0] in ("import", "from") and len(words) > 1:
            facts.append(_import(words[1].rstrip(","), [], rules))
        elif indent == 0:
            close(0, last)
        last = n
    close(0, last)
    return facts


@parser("python", ".py", ".pyw")
def python(path, text, rules):
    facts = _Facts()
    facts.lines = text.split("\n")
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        facts += _by_lines(text, rules)
        facts.append(("mode", {"value": "regex"}))
        return facts
    for x in tree.body:
        if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
            _function(path, x, None, facts, rules)
        elif isinstance(x, ast.ClassDef):
            _class(path, x, facts, rules)
        elif isinstance(x, (ast.Assign, ast.AnnAssign)) and x.value is not None:
            for t in x.targets if isinstance(x, ast.Assign) else [x.target]:
                if isinstance(t, ast.Name):
                    value = ast.unparse(x.value)
                    facts.append(("assignment", {"kind": "alias" if _is_alias(t.id, x) else "constant" if t.id.isupper() else "variable", "name": t.id, "line": x.lineno, "annotation": ast.unparse(x.annotation) if isinstance(x, ast.AnnAssign) else None, "value_preview": value[:200], "inferred_type": type(x.value.value).__name__ if isinstance(x.value, ast.Constant) else type(x.value).__name__.lower(), "initializer": _dotted(x.value.func) if isinstance(x.value, ast.Call) else None}))
    for x in ast.walk(tree):
        if isinstance(x, ast.Import):
            facts += [_import(a.name, [], rules) for a in x.names]
        elif isinstance(x, ast.ImportFrom):
            package = path.split("/")[: -x.level or None][: len(path.split("/")) - x.level] if x.level else []
            module = ".".join([*package, *([x.module] if x.module else [])])
            facts.append(_import(module, [a.name for a in x.names], rules, bool(x.level)))
        elif isinstance(x, ast.Call) and _dotted(x.func).endswith("include_router") and x.args and path.split("/")[-1] in ("main.py", "app.py"):
            prefix = next((k.value.value for k in x.keywords if k.arg == "prefix" and isinstance(k.value, ast.Constant)), None)
            if prefix:
                parts = _dotted(x.args[0]).split(".")
                facts.append(("router_prefix", {"router": parts[-2] if len(parts) > 1 and parts[-1] == "router" else re.sub("_router$", "", parts[-1]), "prefix": prefix}))
        elif isinstance(x, ast.Call) and path.split("/")[-1] == "urls.py" and _dotted(x.func) in ("path", "re_path", "url") and len(x.args) > 1 and isinstance(x.args[0], ast.Constant):
            facts.append(("route", {"line": x.lineno, "method": "ANY", "path": x.args[0].value, "handler": _dotted(x.args[1]), "framework": "django", "auth_required": False}))
        elif isinstance(x, ast.Call) and _dotted(x.func).endswith("add_middleware") and x.args:
            facts.append(("middleware", {"line": x.lineno, "name": _dotted(x.args[0]), "type": "known" if _dotted(x.args[0]).split(".")[-1] in rules["middleware"] else "custom"}))
    if "/versions/" in "/" + path and re.search(r"^down_revision\b", text, re.M):
        got = lambda n: m[1] if (m := re.search(rf"^{n}\b[^=\n]*=\s*[\"']([^\"']*)", text, re.M)) else None
        facts.append(("migration", {"filename": path.split("/")[-1], "revision": got("revision"), "down_revision": got("down_revision"), "message": _first(ast.get_docstring(tree)), "create_date": m[1].strip() if (m := re.search(r"Create Date:\s*(.+)", text)) else None, "operations": [o for o in ("create_table", "drop_table", "add_column", "drop_column", "alter_column", "create_index", "drop_index", "execute") if f"op.{o}(" in text]}))
    return facts


def _import(module, names, rules, relative=False) -> Fact:
    root = module.split(".")[0]
    internal = relative or any(module == p or module.startswith(p + ".") for p in rules.get("internal", ("src", "app")))
    return "import", {"scope": "internal" if internal else "stdlib" if root in sys.stdlib_module_names else "external", "module": module, "root": root, "names": names}


_QUOTED = re.compile("[`'\"]([^`'\"]+)[`'\"]")
_SKIP = {"default", "declare", "async", "abstract"}


def _called(line: str, owner: str, verbs: tuple[str, ...]) -> tuple[str, str] | None:
    """(verb, quoted first argument) of a call owner.verb("...") in a line."""
    before, found, after = line.partition(owner + ".")
    if not found or (before and (before[-1].isalnum() or before[-1] in "_.")):
        return None
    verb, found, rest = after.partition("(")
    rest = rest.lstrip()
    m = _QUOTED.match(rest)
    return (verb, m[1]) if found and m and (not verbs or verb in verbs) and verb.isalpha() else None


@parser("typescript", ".ts", ".tsx", ".js", ".jsx")
def typescript(path, text, rules):
    """The first thing that each line shows: an exported name, an import, a route or a request."""
    verbs = ("get", "post", "put", "patch", "delete")
    for n, raw in enumerate(text.split("\n"), 1):
        line = raw.strip()
        words = re.findall(r"[\w$]+", line)
        if words[:1] == ["export"]:
            rest = [w for w in words[1:] if w not in _SKIP]
            if len(rest) > 1 and rest[0] in ("function", "const", "type", "interface", "class"):
                name = rest[1]
                kind = rest[0] if rest[0] in ("type", "interface", "class") else "hook" if name[:3] == "use" and name[3:4].isupper() else "component" if name[0].isupper() else "function"
                yield "ts_symbol", {"kind": kind, "name": name, "line": n}
        elif words[:1] == ["import"] and (quoted := _QUOTED.findall(line)):
            target = quoted[-1]
            internal = target.startswith((".", "@/", "~/"))
            yield "import", {"scope": "internal" if internal else "external", "module": target if internal else "/".join(target.split("/")[: 2 if target.startswith("@") else 1]), "root": target.split("/")[0], "names": []}
        elif found := _called(line, "app", verbs) or _called(line, "router", verbs):
            yield "ts_route", {"line": n, "method": found[0].upper(), "path": found[1]}
        elif (m := re.search(r"(?<![\w.])fetch\s*\(\s*", line)) and (q := _QUOTED.match(line[m.end() :])):
            yield "api_call", {"line": n, "library": "fetch", "method": "GET", "url": q[1]}
        else:
            for library in ("axios", "ky", "superagent"):
                if found := _called(line, library, ()):
                    yield "api_call", {"line": n, "library": library, "method": found[0].upper(), "url": found[1]}
                    break


@parser("sql", ".sql")
def sql(path, text, rules):
    for kind, p in (("table", r"create\s+table\s+(?:if\s+not\s+exists\s+)?[\"`]?([\w.]+)"), ("view", r"create\s+(?:or\s+replace\s+)?(?:materialized\s+)?view\s+(?:if\s+not\s+exists\s+)?[\"`]?([\w.]+)")):
        for m in re.finditer(p, text, re.I):
            yield "ddl", {"kind": kind, "name": m[1], "on_table": None}
    for m in re.finditer(r"create\s+(?:unique\s+)?index\s+(?:concurrently\s+)?(?:if\s+not\s+exists\s+)?[\"`]?(\w+)[\"`]?\s+on\s+[\"`]?([\w.]+)", text, re.I):
        yield "ddl", {"kind": "index", "name": m[1], "on_table": m[2]}


@parser("compose", "docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml")
def compose(path, text, rules):
    try:
        import yaml

        loaded = yaml.safe_load(text) or {}
    except Exception:  # noqa: BLE001 - PyYAML is optional, and broken files still name their services
        block = re.search(r"^services:\s*\n((?:[ \t]+.*\n?|\n)*)", text, re.M)
        for m in re.finditer(r"^ {2}([\w.-]+):", block[1] if block else "", re.M):
            yield "service", {"name": m[1]}
        return
    for name, s in (loaded.get("services") or {}).items():
        env = s.get("environment") or []
        yield "service", {"name": name, "image": s.get("image"), "build": json.dumps(s["build"]) if "build" in s else None, "ports": [str(p) for p in s.get("ports") or []], "depends_on": list(s.get("depends_on") or []), "environment": list(env) if isinstance(env, dict) else [str(e).split("=")[0] for e in env]}
    for kind in ("networks", "volumes"):
        for name in loaded.get(kind) or {}:
            yield "compose_" + kind[:-1], {"name": name}


@parser("dependencies", ".txt", "pyproject.toml", "package.json")
def dependencies(path, text, rules):
    out = lambda eco, section, name: ("dep", {"ecosystem": eco, "section": section, "name": name.lower()})
    token = lambda s: m[0] if (m := re.match(r"[A-Za-z0-9][A-Za-z0-9._-]*", s.strip())) else None
    name = path.split("/")[-1]
    if path.endswith(".txt"):
        if name.startswith("requirements"):
            yield from (out("python", "main", t) for line in text.split("\n") if line.strip()[:1] not in ("", "#", "-") and (t := token(line)))
    elif path.endswith(".toml"):
        t = tomllib.loads(text)
        own = t.get("project", {}).get("name", "").lower()
        groups = {"main": t.get("project", {}).get("dependencies", [])} | t.get("project", {}).get("optional-dependencies", {})
        poetry = t.get("tool", {}).get("poetry", {})
        groups["poetry"] = list(poetry.get("dependencies", {})) + [x for g in poetry.get("group", {}).values() for x in g.get("dependencies", {})]
        yield from (out("python", g, n) for g, xs in groups.items() for x in xs if (n := token(x)) and n.lower() not in (own, "python"))
    else:
        loaded = json.loads(text)
        yield from (out("node", s, n) for s in ("dependencies", "devDependencies") for n in loaded.get(s, {}))


_TODO = re.compile(r"(?:#|//|/\*)\s*(TODO|FIXME|HACK|XXX)\b[:\s]*(.*?)(?:\*/)?\s*$", re.I)
_ENV = {"python": re.compile(r"os\.(?:environ(?:\.get\(|\[)|getenv\()\s*[\"'](\w+)"), "typescript": re.compile(r"(?:process\.env|import\.meta\.env)\.(\w+)")}
_HTTP = re.compile(r"\b(requests|httpx|aiohttp|session|client|http|urllib3|treq)\.(get|post|put|patch|delete|head|options|request|urlopen)\(\s*(?:[\"'](GET|POST|PUT|PATCH|DELETE|HEAD)[\"']\s*,\s*)?f?[\"']([^\"']+)", re.I)


def line_facts(path, text, language):
    """TODO comments, environment names and HTTP calls, line by line."""
    if path.split("/")[-1].startswith(".env"):
        yield from (("env", {"source": "dotenv", "name": m[1]}) for m in re.finditer(r"^\s*(?:export\s+)?(\w+)\s*=", text, re.M))
        return
    for n, line in enumerate(text.split("\n"), 1):
        if language in ("python", "typescript", "sql") and (m := _TODO.search(line)):
            yield "todo", {"type": m[1].upper(), "message": m[2].strip(), "line": n}
        if language in _ENV:
            yield from (("env", {"source": language, "name": m[1]}) for m in _ENV[language].finditer(line))
        if language == "python":
            for m in _HTTP.finditer(line):
                if not m[4].startswith("/"):
                    yield "http", {"line": n, "library": m[1].lower(), "method": (m[3] or m[2]).upper(), "url": m[4]}

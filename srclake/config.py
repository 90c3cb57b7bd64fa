"""Settings of a code index: defaults, loading, merging and validation."""

from __future__ import annotations

import json
import re
import warnings
from pathlib import Path

#: Each section may be replaced as a whole (`merge` is one level deep).
DEFAULTS: dict = {
    "exclude": [".git", "__pycache__", "node_modules", "dist", "build", ".venv", "venv", ".mypy_cache", ".pytest_cache", "*.pyc", "*.min.js"],
    "exclude_ext": [],
    "internal": ["src", "app"],
    "categories": [
        ["(^|/)tests?/|(^|/)test_[^/]*$|_test\\.py$", "test"],
        ["(^|/)routers?/", "router"],
        ["(^|/)models?/", "model"],
        ["(^|/)services?/", "service"],
        ["(^|/)alembic/", "migration"],
        ["(^|/)docs?/", "docs"],
    ],
    "models": [
        {"marker": "__tablename__", "type": "sqlalchemy"},
        {"marker": "__table__", "type": "sqlalchemy"},
        {"base": "Base", "type": "sqlalchemy"},
        {"base": "DeclarativeBase", "type": "sqlalchemy"},
        {"base": "models.Model", "type": "django"},
        {"base": "Model", "type": "django"},
        {"base": "Document", "type": "mongo"},
    ],
    "schemas": [
        {"base": "BaseModel", "type": "pydantic"},
        {"base": "Schema", "type": "marshmallow"},
        {"base": "TypedDict", "type": "typeddict"},
        {"base": "Struct", "type": "msgspec"},
    ],
    # a group of the pattern names the method; without one the decorator's own arguments do
    "routes": [
        {"pattern": "(?:\\w+\\.)+(get|post|put|patch|delete|head|options)$", "framework": "fastapi"},
        {"pattern": "(?:\\w+\\.)+route$", "framework": "flask"},
        {"pattern": "(?:\\w+\\.)*api_view$", "framework": "django"},
    ],
    "auth": {
        "parameters": ["Depends\\((?:\\w+\\.)*(\\w*(?:current_user|auth|login|token|permission)\\w*)", "Security\\((?:\\w+\\.)*(\\w+)"],
        "decorators": ["(\\w*(?:login_required|requires_auth|permission_required|jwt_required|authenticated)\\w*)"],
    },
    "middleware": ["CORSMiddleware", "GZipMiddleware", "HTTPSRedirectMiddleware", "TrustedHostMiddleware", "SessionMiddleware", "AuthenticationMiddleware", "ProxyHeadersMiddleware"],
    "aliases": {"pyyaml": "yaml", "pillow": "pil", "beautifulsoup4": "bs4", "python-dotenv": "dotenv", "scikit-learn": "sklearn", "opencv-python": "cv2", "python-dateutil": "dateutil", "pyjwt": "jwt"},
    "umbrella": {"django": ["djangorestframework"], "google": ["google_cloud_storage"]},
    "complexity": {"file_lines": 500, "function_lines": 50, "class_methods": 15},
}

_WORDS = {
    "exclude": "names of folders or, after *, endings of paths that are not read",
    "exclude_ext": "file endings that are not read",
    "internal": "prefixes of modules that are this project's own",
    "categories": "[regex, label] pairs; the first that is found in a path names its category",
    "models": "base classes or class attributes that make a class a database model",
    "schemas": "base classes that make a class a data schema; schemas go before models",
    "routes": "regexes from the start of a decorator's name; the first that fits makes a route",
    "auth": "regexes that find authentication in a handler's signature, then in its decorators",
    "middleware": "known middleware classes; others are custom",
    "aliases": "distribution names whose module has another name",
    "umbrella": "modules that several distributions provide",
    "complexity": "sizes above which a file, function or class is reported",
}


def merge(given: dict | None) -> dict:
    """The defaults with the given sections; a mapping replaces keys of its section, anything else the whole section."""
    out = {k: dict(v) if isinstance(v, dict) else v for k, v in DEFAULTS.items()}
    for k, v in (given or {}).items():
        out[k] = {**out[k], **v} if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return validate(out)


def validate(rules: dict) -> dict:
    """Without rules whose regex does not compile; each is reported as a warning. A plain list under ``auth`` counts as parameter rules."""

    def good(pattern) -> bool:
        try:
            re.compile(pattern)
            return True
        except (re.error, TypeError) as e:
            warnings.warn(f"bad pattern {pattern!r} is left out: {e}", stacklevel=2)
            return False

    if isinstance(rules["auth"], list):  # the older form
        rules["auth"] = {"parameters": rules["auth"], "decorators": DEFAULTS["auth"]["decorators"]}
    rules["auth"] = {k: [p for p in v if good(p)] for k, v in rules["auth"].items()}
    rules["routes"] = [r for r in rules["routes"] if good(r.get("pattern"))]
    rules["categories"] = [tuple(c) for c in (rules["categories"].items() if isinstance(rules["categories"], dict) else rules["categories"]) if good(c[0])]
    return rules


def load(path: str | None) -> dict:
    """Settings of a JSON or, where PyYAML is installed, YAML file over the defaults; no path gives the defaults."""
    if path is None:
        return merge({})
    file = Path(path)
    if not file.is_file():
        raise FileNotFoundError(f"no settings file at {path}")
    text = file.read_text(encoding="utf-8")
    try:
        given = json.loads(text)
    except json.JSONDecodeError:
        try:
            import yaml
        except ImportError:
            raise ValueError(f"{path} is not JSON, and YAML needs PyYAML") from None
        given = yaml.safe_load(text) or {}
    if not isinstance(given, dict):
        raise ValueError(f"{path} holds no mapping")
    return merge(given)


def template() -> str:
    """A settings file to start from: JSON, with a word on each section under ``_help``."""
    return json.dumps({"_help": _WORDS, **DEFAULTS}, indent=2)


def matches(text: str, rules: list[dict]) -> dict | None:
    """The first rule whose pattern fits from the start of the text."""
    return next((r for r in rules if re.match(r["pattern"], text)), None)

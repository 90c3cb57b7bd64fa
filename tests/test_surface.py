"""Settings, navigation, update, staleness, semantic search and the command line, on the small tree."""

import json
import re
import shutil
import subprocess

import numpy as np
import pytest
from pyspark.sql import functions as F

from srclake import cli, config, navigate, semantic, staleness
from srclake.analyses import badges, is_builtin
from srclake.index import CodeIndex
from srclake.operators import kernels as K
from srclake.plans.code import TREE, index
from srclake.sources.parsers import auth_of, code_slice, parse_file


@pytest.fixture(scope="module")
def i(spark):
    return index(spark)


def facts(path, text, rules=None):
    out = {}
    for kind, record in parse_file(path, text.encode(), config.merge(rules))[1]:
        out.setdefault(kind, []).append(record)
    return out


def test_settings(tmp_path):
    assert config.load(None)["complexity"]["file_lines"] == 500
    (tmp_path / "c.json").write_text(json.dumps({"complexity": {"file_lines": 9}, "internal": ["lib"], "auth": ["Need\\((\\w+)"]}))
    made = config.load(str(tmp_path / "c.json"))
    assert made["complexity"] == {"file_lines": 9, "function_lines": 50, "class_methods": 15} and made["internal"] == ["lib"]
    assert made["auth"]["parameters"] == ["Need\\((\\w+)"] and made["auth"]["decorators"]
    with pytest.warns(UserWarning, match="left out"):
        assert config.merge({"routes": [{"pattern": "(", "framework": "x"}]})["routes"] == []
    for bad in ("missing.json", "list.json"):
        (tmp_path / "list.json").write_text("[1]")
        with pytest.raises((FileNotFoundError, ValueError)):
            config.load(str(tmp_path / bad))
    assert config.merge({k: v for k, v in json.loads(config.template()).items() if k != "_help"}) == config.merge({})
    assert config.matches("app.get", made["routes"])["framework"] == "fastapi" and config.matches("x", made["routes"]) is None


def test_rules_alone_extend_the_parser():
    rules = {"models": [{"base": "Row", "type": "own"}], "schemas": [{"base": "pkg.Shape", "type": "shape"}], "routes": [{"pattern": "bus\\.on_(\\w+)", "framework": "bus"}]}
    got = facts("a.py", "class A(lib.Row): pass\nclass B(pkg.Shape): pass\nclass C(other.Shape): pass\n@bus.on_put('/x')\ndef f(): pass\n", rules)
    assert [(m["name"], m["type"]) for m in got["model"]] == [("A", "own")] and [s["name"] for s in got["schema"]] == ["B"]
    assert [(r["method"], r["path"], r["framework"]) for r in got["route"]] == [("PUT", "/x", "bus")]


def test_routes_of_three_frameworks():
    got = facts("x/urls.py", "@api_view(['GET', 'POST'])\ndef a(r): pass\n@app.route('/f', methods=['PUT'])\ndef b(): pass\nurlpatterns = [path('d/', views.show)]\n")
    assert {(r["method"], r["path"], r["framework"]) for r in got["route"]} >= {("PUT", "/f", "flask"), ("ANY", "d/", "django")}
    assert {r["method"] for r in got["route"] if r["handler"] == "a"} == {"GET", "POST"}


def test_auth_check():
    rules = config.merge({})
    assert auth_of("u=Depends(get_current_user)", "", rules) == "get_current_user" and auth_of("", "login_required", rules) == "login_required"
    assert auth_of("x: int", "cache", rules) is None


def test_sockets_by_type_and_known_middleware():
    got = facts("m.py", "@app.websocket('/ws')\nasync def a(s: WebSocket): pass\nasync def b(s: WebSocket): pass\napp.add_middleware(CORSMiddleware)\napp.add_middleware(Mine)\n")
    assert [(w["handler"], w["path"]) for w in got["websocket"]] == [("a", "/ws"), ("b", None)]
    assert [(m["name"], m["type"]) for m in got["middleware"]] == [("CORSMiddleware", "known"), ("Mine", "custom")]


def test_broken_file_has_methods_ends_and_routes():
    got = facts("b.py", "class A:\n  def m(self):\n    pass\n\n@app.get('/q')\nasync def f(:\n  pass\nX = 1\n")
    assert [(s["kind"], s["name"], s["line"], s["end_line"]) for s in got["symbol"]] == [("class", "A", 1, 3), ("method", "m", 2, 3), ("function", "f", 6, 7)]
    assert [(r["method"], r["path"]) for r in got["route"]] == [("GET", "/q")]


def test_aliases_among_assignments():
    got = facts("a.py", "from typing import TypeAlias\nIds = list[int]\nY: TypeAlias = int\nMAX = 3\nx = 1\n")
    assert {a["name"]: a["kind"] for a in got["assignment"]} == {"Ids": "alias", "Y": "alias", "MAX": "constant", "x": "variable"}


def test_q08_builtins_by_whole_name_unless_compat(spark):
    df = spark.createDataFrame([(x,) for x in ("print", "setup", "interval", "os.path.join", "json", "osx.run")], "c string")
    assert [r[0] for r in df.where(is_builtin(F.col("c"))).collect()] == ["print", "os.path.join"]
    assert {"setup", "interval"} <= {r[0] for r in df.where(is_builtin(F.col("c"), True)).collect()}


def test_q07_methods_resolve_and_q04_one_definition_each(i):
    r = i.resolved_calls()
    assert r.groupBy("caller", "pos", "callee").count().where("count > 1").count() == 0
    assert r.where("key like '%:%.%'").count() > 0  # methods


def test_flow_metrics_and_tree(i):
    m = {r.root: r for r in i.flow_metrics().collect()}
    root = next(k for k in m if k.endswith("main.py:main"))
    tree = i.flow_tree(root).split("\n")
    assert tree[0] == root and len(tree) == m[root].calls + 1 and tree[-1].endswith("(again)")


def test_find_file_and_lookup(i):
    assert i.find_file("user_service.py").first()["file"] == "src/app/services/user_service.py"
    assert i.find_file("/root/x/src/app/main.py").first()["file"] == "src/app/main.py" and i.find_file("nope.py").first() is None
    rows = {(r.kind, r.name): r for r in i.lookup("UserService").collect()}
    assert "load" in rows["class", "UserService"].methods
    assert [r.name for r in i.lookup("UserService.load").collect()] == ["load"]


def test_symbol_document(i):
    text = i.symbol_document("UserService.load")
    assert text.startswith("# UserService.load") and "## Called by" in text and "routers/users.py:me" in text and "tests/test_user_service.py" in text
    assert i.symbol_document("nowhere") is None


def test_summary_and_badges(i):
    s = {r.name: r.value for r in i.summary_values().collect()}
    assert len(s) == 30 and s["total_classes"] == i.table("symbol").where("kind = 'class'").count() and s["todos_count"] == i.table("todo").count()
    assert s["orphaned_files_count"] == i.orphans().count() and s["max_call_depth"] >= 2
    assert badges(s)["files"].startswith("![files](https://") and badges({"total_lines": 12345})["lines"].count("12.3k") == 1


def test_statistics(i):
    assert all(len(r.first_users) == min(5, r.files) and r.first_users == sorted(r.first_users) for r in i.import_statistics().collect())
    assert {r.role for r in i.central().collect()} <= {"core", "hub", "utility", "isolated"}
    assert i.http_summary().first()["domains"] == sorted({r.domain for r in i.http_calls().collect() if r.domain})
    assert [r.revision for r in i.latest_migration().collect()] == ["002"]
    assert {r.ecosystem for r in i.dependencies().collect()} == {"python", "node"}


def test_q16_compat_orphans(i):
    assert {r.file for r in i.orphans(True).collect()} <= {r.file for r in i.orphans().collect()}


def test_missing_by_prefix_against_loop(spark):
    used, declared = ["a", "a_b", "b", "c_d_e", "x", "d"], ["a_b_c", "c_d", "x", "dd"]
    want = {u for u in used if not any(u == d or d.startswith(u + "_") or u.startswith(d + "_") for d in declared)}
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "n string")
    assert {r.n for r in K.missing_by_prefix(frame(used), frame(declared), "n").collect()} == want


def test_save_load_update(spark, i, tmp_path):
    root, saved = str(tmp_path / "tree"), str(tmp_path / "saved")
    shutil.copytree(TREE, root)
    CodeIndex.scan(spark, root).save(saved)
    loaded = CodeIndex.load(spark, saved)
    assert sorted(map(str, loaded.facts.collect())) == sorted(map(str, i.facts.collect()))
    assert CodeIndex.update(spark, root, saved)[1].where("status <> 'unchanged'").count() == 0  # Q1: nothing changed, nothing is updated
    (tmp_path / "tree/src/app/orphan.py").write_text("def fresh():\n    return helper()\n")
    (tmp_path / "tree/src/app/added.py").write_text("def helper(): pass\n")
    (tmp_path / "tree/src/app/latest.py").unlink()
    new, changes = CodeIndex.update(spark, root, saved)
    whole = CodeIndex.scan(spark, root)
    assert {r.status: r.files for r in staleness.change_counts(changes).where("status <> 'unchanged'").collect()} == {"added": 1, "updated": 1, "deleted": 1}
    assert sorted(map(str, new.facts.collect())) == sorted(map(str, whole.facts.collect()))
    assert sorted(map(str, new.roles().collect())) == sorted(map(str, whole.roles().collect()))  # Q3: nothing derived is stale
    vectors = semantic.embed(semantic.symbol_texts(loaded))
    seen = []

    def embedder(texts):
        seen.append(len(texts))
        return semantic.hashing_embedder(texts)

    key = lambda df: sorted((r.name, r.file, r.line, r.text) for r in df.collect())
    after = semantic.update_embeddings(vectors, new, changes)
    assert key(after) == key(semantic.symbol_texts(whole))
    assert semantic.update_embeddings(vectors, new, changes, model="other").where("model = 'other'").count() == semantic.symbol_texts(whole).count()


def test_semantic_texts_and_search(i):
    t = {r.name: r for r in semantic.symbol_texts(i).collect()}
    assert len(t["UserService.load"].tags) <= semantic.TAGS and t["UserService.load"].text.startswith("UserService.load")
    vectors = semantic.embed(semantic.symbol_texts(i)).persist()
    found = semantic.search(vectors, t["UserService.load"].text, k=3).collect()
    assert (found[0].name, found[0].score) == ("UserService.load", 1.0) and [r.score for r in found] == sorted((r.score for r in found), reverse=True)
    assert semantic.search(vectors, "zzzz qqqq", least=0.99).count() == 0
    assert np.allclose((semantic.hashing_embedder(["a b", ""]) ** 2).sum(axis=1), [1, 0])


def test_code_slice():
    lines = "def a():\n    x = 1\n\n    y = 2\n\ndef b(): pass".split("\n")
    assert code_slice(lines, 1) == "def a():\n    x = 1\n\n    y = 2" and code_slice(lines, 9) == "" and len(code_slice(["def a():"] + ["    x"] * 80, 1).split("\n")) == 50


def test_navigation(i, monkeypatch):
    monkeypatch.setattr(navigate, "SECTIONS", {k: navigate.SECTIONS[k] for k in ("files", "symbols", "models", "schemas", "todos", "websockets", "migrations", "services")})
    doc = navigate.document(i)
    assert navigate.keys(doc)["path"] == "(root)" and len(navigate.keys(doc, "", 3)["keys"]) == 3
    assert len(navigate.keys(doc, "symbols")["sample"]) == 5 and navigate.keys(doc, "symbols.0.name")["type"] == "str"
    assert navigate.extract(doc, "symbols", 2)["limited_to"] == 2 and navigate.extract(doc, "summary.total_files")["data"] > 10
    for path, here in (("nope.x", "nope"), ("symbols.9999", "symbols.9999"), ("symbols.x", "symbols.x"), ("summary.total_files.y", "summary.total_files.y")):
        assert navigate.extract(doc, path)["path"] == here and "error" in navigate.keys(doc, path)
    assert len(navigate.extract(doc, "nope")["available_keys"]) == 10
    assert set(navigate.schema(i)) == set(navigate.SECTIONS)


def test_json_keys(spark):
    d = spark.createDataFrame([(1, '{"a": {"b": [1, 2]}, "c": "x", "n": null}'), (2, '{"a": 3}'), (3, "broken"), (4, None)], "id int, j string")
    assert {tuple(r) for r in K.json_keys(d, ["id"], "j").where("id = 1").collect()} == {(1, "a", "object", 1, None), (1, "c", "string", None, "x"), (1, "n", "null", None, None)}
    assert {(r.id, r.key, r.type) for r in K.json_keys(d, ["id"], "j", "$.a").collect()} == {(1, "b", "array"), (2, None, "bigint"), (3, None, "missing"), (4, None, "missing")}


def test_staleness(spark, tmp_path):
    root = str(tmp_path)
    git = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=x", "-c", "user.email=x@y.z", *a], check=True, capture_output=True)
    (tmp_path / "a b.py").write_text("x")
    assert staleness.git_info(spark, root).count() == 0  # no work tree
    stored = spark.createDataFrame([("a b.py",), ("gone.py",)], "file string")
    row = staleness.check(spark, stored, root, "2020-01-01T00:00:00Z").first()
    assert row.is_stale and row.changed == ["a b.py"] and row.deleted == ["gone.py"]
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "first")
    row = staleness.check(spark, stored, root, "2020-01-01T00:00:00+00:00").first()
    assert row.new == ["a b.py"] and not row.changed
    (tmp_path / "a b.py").write_text("y")  # Q21: the first line of a status keeps its first character
    (tmp_path / "index.json").write_text("{}")
    (tmp_path / "new.py").write_text("")
    row = staleness.check(spark, stored, root, "2999-01-01T00:00:00Z").first()
    assert row.changed == ["a b.py"] and row.new == ["new.py"] and row.total == 2 and staleness.git_info(spark, root).first().dirty
    assert staleness.check(spark, stored, root, None).first().is_stale and staleness.check(spark, stored, root, "soon").first().is_stale


def test_command_line(spark, tmp_path, capsys):
    def run(*arguments):
        code = None
        try:
            found = cli.answer(spark, cli.parser().parse_args(list(arguments)))
            code = found
        except (ValueError, FileNotFoundError) as e:
            code = e
        return code

    saved = str(tmp_path / "saved")
    assert set(run(str(TREE), "--summary", "--save", saved)) == {"meta", "summary", "badges"}
    assert run("--load", saved, "--callers", "load") and run("--load", saved, "--impact", "user_service.py") and run("--load", saved, "--tests", "load")
    assert run("--load", saved, "--doc", "load").startswith("# ") and run("--load", saved, "--search", "user load", "--search-threshold", "0.1")
    assert run("--load", saved, "--get", "load", "--limit", "1")
    assert run(str(TREE), "--load", saved, "--update")["changes"].keys() == {"unchanged"} and "is_stale" in run(str(TREE), "--load", saved, "--check")
    assert isinstance(run(), ValueError) and isinstance(run("/no/such"), FileNotFoundError) and isinstance(run("--load", saved, "--check"), ValueError)
    assert isinstance(run("--load", saved, "--doc", "nope"), ValueError) and "_help" in run("--init-config") and "symbols" in run("--load", saved, "--schema")
    assert re.match(r"\{", run("--init-config"))
    file = str(tmp_path / "made.json")
    with open(file, "w") as f:
        json.dump(run("--load", saved), f, default=str)
    assert run("--load", file, "--at", "symbols", "--limit", "2")["limited_to"] == 2 and run("--load", file, "--keys")["path"] == "(root)" and "error" in run("--load", file, "--at", "a.b") and set(run("--load", file, "--summary")) == {"meta", "summary", "badges"}
    (tmp_path / "bad.json").write_text("[")
    assert isinstance(run("--load", str(tmp_path / "bad.json")), ValueError) and isinstance(run("--load", str(tmp_path / "none.json")), FileNotFoundError)

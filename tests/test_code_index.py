import pytest
from pyspark.sql import functions as F

from srclake.operators import kernels as K
from srclake.plans.code import TREE, index


@pytest.fixture(scope="module")
def i(spark):
    return index(spark)


def rows(df, *cols):
    return {tuple(r) if len(cols) > 1 else r[0] for r in df.select(*cols).collect()}


def test_underscore_and_dot_files_are_read_and_exclusions_hold(i):
    files = rows(i.files(), "file")
    assert {"src/app/__init__.py", "src/app/_private.py", ".env"} <= files
    assert not any(f.startswith("node_modules") for f in files)


def test_undecodable_and_broken_files_are_rows(i):
    got = {r.file: r for r in i.files().collect()}
    assert got["src/app/latin1.py"].lines == 2 and got["src/app/broken.py"].parse_mode == "regex"
    assert ("Half", "class") in rows(i.table("symbol"), "name", "kind")


def test_callers_roles_and_flow(i):
    assert {"src/app/routers/users.py:me", "tests/test_user_service.py:test_load", "src/app/services/user_service.py:UserService.save"} == rows(i.callers("load"), "caller")
    assert {r.truncated for r in i.flows().where(F.col("depth") == 3).collect()} == {True}  # main, start_server, helper, start_server
    assert i.roles().count() == i.definitions().select("key").distinct().count()


def test_duplicates(i):
    assert [r.members for r in i.duplicates().where("n = 2").collect() if "twice" in r.members[1]] == [["src/app/services/user_service.py:double", "src/app/services/user_service.py:twice"]]


def test_routes_models_and_tables(i):
    assert ("/users/me", "GET", True) in rows(i.endpoints(), "full_path", "method", "auth_required")
    assert ("/users/", "POST", False) in rows(i.endpoints(), "full_path", "method", "auth_required")
    assert rows(i.table("model"), "name", "table") >= {("User", "users")} and rows(i.table("schema"), "name") == {"UserIn"}
    assert rows(i.table("ddl"), "kind", "name") == {("table", "users"), ("index", "users_id"), ("view", "v_users")}
    assert rows(i.table("service"), "name") == {"web", "db"}
    assert rows(i.table("migration"), "revision", "down_revision") == {("001", None), ("002", "001")}  # annotated ones too


def test_findings(i):
    assert rows(i.orphans(), "file") >= {"src/app/orphan.py"} and "src/app/services/user_service.py" not in rows(i.orphans(), "file")
    assert ("unused", "yaml") in rows(i.dependency_problems(), "problem", "name") and ("missing", "requests") in rows(i.dependency_problems(), "problem", "name")
    assert ("PUT", "put.example.org") in rows(i.http_calls(), "method", "domain") and "hooks.example.org" in rows(i.http_calls(), "domain")
    assert rows(i.table("dynamic"), "pattern") == {"getattr", "subscript", "eval", "import"}
    assert rows(i.table("todo"), "type") == {"TODO", "FIXME", "HACK"}
    assert {"PORT", "BASE_URL", "WEB_KEY", "DATABASE_URL", "API_KEY"} == rows(i.table("env"), "name")


def test_impact_and_tests(i):
    got = rows(i.impact("src/app/services/user_service.py"), "kind", "item")
    assert ("test", "tests/test_user_service.py") in got and ("endpoint", "GET /me") in got and ("direct", "src/app/routers/users.py:me") in got
    assert rows(i.tests_for("UserService.load"), "file", "called") >= {("tests/test_user_service.py", True)}
    assert ("src/app/services/user_service.py", "tests/test_user_service.py") in rows(i.test_coverage(), "file", "test")


def test_latest_is_testable(i):
    assert "src/app/latest.py" in rows(i.test_coverage(), "file")  # a path that merely contains "test"


def test_diff(spark, i):
    got = dict((r.file, r.status) for r in index(spark, f"{TREE}_v2").diff(i).collect())
    assert (got["src/app/fresh.py"], got["src/app/latest.py"], got["src/app/orphan.py"], got["src/app/main.py"]) == ("added", "updated", "unchanged", "deleted")


def test_suffix_join_is_endswith(spark):
    calls, names = ["a.b.c", "c", "bc", "a.c.b", ""], ["c", "b.c", "a.b.c", "b"]
    got = K.suffix_join(spark.createDataFrame([(x,) for x in calls], "callee string"), spark.createDataFrame([(x,) for x in names], "name string"), "callee", "name")
    assert rows(got, "callee", "name") == {(x, y) for x in calls for y in names if x == y or x.endswith("." + y)}


def test_roles_cover_all(spark):
    e = [(s, "hub") for s in range(8)] + [("h2", d) for d in range(100, 110)]
    d = K.degrees(spark.createDataFrame([(str(a), str(b)) for a, b in e], "src string, dst string"), nodes=spark.createDataFrame([("lone",)], "n string"))
    got = dict((r.node, r.role) for r in K.roles(d).collect())
    assert got["lone"] == "isolated" and got["h2"] == "hub"


def test_lines_and_counts(spark):
    d = spark.createDataFrame([("a\nb\n",), ("a\r\nb",), ("",), (None,), ("\n",)], "t string")
    assert [r[0] for r in d.select(K.line_count(F.col("t"))).collect()] == [2, 2, 0, 0, 1]


def test_known_files_by_plain_reading():
    """Sizes, lines and hashes of the known answers, read without the engine."""
    import hashlib
    import json
    import os

    known = json.loads((TREE.parents[1] / "plans/known.json").read_text())["code_files"]["rows"]
    want = []
    for folder, dirs, names in os.walk(TREE):
        dirs[:] = [d for d in dirs if d != "node_modules"]
        for name in names:
            data = open(os.path.join(folder, name), "rb").read()
            want.append([os.path.relpath(os.path.join(folder, name), TREE), len(data), len(data.decode("latin-1").splitlines()), "sha256:" + hashlib.sha256(data).hexdigest()[:16]])
    assert sorted(r[:4] for r in known) == sorted(want)

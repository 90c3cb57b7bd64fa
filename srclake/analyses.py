"""Findings over the tables of a code index: what depends, runs, is central, documented, orphaned or missing."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .operators import kernels as K

ENTRY_NAMES = ("main", "cli", "run", "start", "app", "execute")
_COMMAND = r"(?i)(^|\.)((click|typer)\.(command|group)|(app|router)\.(route|get|post|put|patch|delete|command|websocket)|task)$"
_BUILTINS = "print len str int float bool list dict set open range enumerate zip map filter sorted isinstance hasattr getattr setattr".split()
_MODULES = "os sys json re pathlib typing logging hashlib datetime collections".split()
_NODE_FOLDERS = ("", "frontend/", "src/frontend/", "client/", "web/")
_NO_ORPHANS = r"(^|/)(__init__|__main__|main|app|manage|setup|conftest|wsgi|asgi|cli)\.py$"
_NO_ORPHAN_FOLDERS = r"(^|/)(scripts|migrations|alembic|bin|tools)/"


def is_builtin(callee: Column, compat: bool = False) -> Column:
    """A call of the standard library by its name; ``compat`` takes any name that merely begins like one."""
    if compat:
        return F.lower(callee).rlike("^(" + "|".join(_BUILTINS + [m + r"\." for m in _MODULES]) + ")")
    return callee.isin(*_BUILTINS) | F.substring_index(callee, ".", 1).isin(*_MODULES) & (F.instr(callee, ".") > 0)


class Analyses:
    """Needs ``table(kind)``, ``files()``, ``calls()``, ``definitions()`` and the settings ``rules``."""

    # -- dependencies
    def dependencies(self) -> DataFrame:
        """Declared dependencies: Python ones of the root folder, Node ones of the first folder with a package.json."""
        d = self.table("dep")
        folder = F.regexp_replace("file", "[^/]*$", "")
        rank = F.array_position(F.array(*map(F.lit, _NODE_FOLDERS)), folder)
        node = d.where("ecosystem = 'node'").withColumn("rank", rank).where("rank > 0")
        first = node.agg(F.min("rank").alias("first"))
        return d.where((F.col("ecosystem") == "python") & (folder == "")).unionByName(node.join(F.broadcast(first), F.col("rank") == F.col("first")).drop("rank", "first"))

    def dependency_problems(self) -> DataFrame:
        """(problem, name): imported but undeclared, declared but unused.

        Names are compared after aliases; one that goes on after an underscore
        stands for the shorter one too, and an umbrella module for each of its
        distributions.
        """
        pairs = [F.lit(x) for kv in self.rules["aliases"].items() for x in kv]
        alias = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
        norm = lambda c: F.translate(F.lower(F.coalesce(alias[F.lower(c)], c)), "-.", "__")
        python = self.files().where("language = 'python'").select("file")
        used = self.table("import").where("scope = 'external'").join(python, "file", "left_semi").select(norm(F.col("root")).alias("name")).distinct()
        declared = self.dependencies().where("ecosystem = 'python'").select(norm(F.col("name")).alias("name")).distinct()
        rows = [(m, d.replace("-", "_")) for m, ds in self.rules["umbrella"].items() for d in ds]
        umbrella = self.spark.createDataFrame(rows, "module string, name string")
        provided = declared.join(umbrella, "name").select(F.col("module").alias("name"))
        needed = used.join(umbrella, used.name == umbrella.module).select(umbrella.name)
        missing = K.missing_by_prefix(used, declared.union(provided), "name")
        unused = K.missing_by_prefix(declared, used.union(needed), "name")
        return missing.select(F.lit("missing").alias("problem"), "name").union(unused.select(F.lit("unused"), "name"))

    def import_statistics(self, users: int = 5) -> DataFrame:
        """(root, scope, files, first_users): how many files import a package, and the first of them by name."""
        i = self.table("import").select("root", "scope", "file").distinct()
        w = Window.partitionBy("root", "scope").orderBy("file")
        ranked = i.withColumn("at", F.row_number().over(w))
        return ranked.groupBy("root", "scope").agg(F.count("*").alias("files"), F.array_sort(F.collect_list(F.when(F.col("at") <= users, F.col("file")))).alias("first_users"))

    def orphans(self, compat: bool = False) -> DataFrame:
        """Python files that no module imports, entry points and tests aside. ``compat`` takes an import of a package for one of all beneath it."""
        from .index import TEST

        f = self.files().where("language = 'python'").select("file", "lines")
        f = f.where(~F.col("file").rlike(TEST) & ~F.col("file").rlike(_NO_ORPHANS) & ~F.col("file").rlike(_NO_ORPHAN_FOLDERS))
        module = F.regexp_replace(F.regexp_replace("file", "\\.pyw?$", ""), "/", ".")
        imported = self.table("import").select(F.explode(F.concat(F.array("module"), F.transform("names", lambda n: F.concat_ws(".", "module", n)))).alias("module")).distinct()
        if compat:
            parts = F.split("_m", r"\.")
            prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
            hit = f.withColumn("_m", module).select("file", F.explode(prefixes).alias("module")).join(imported, "module", "left_semi").select("file").distinct()
        else:
            hit = K.suffix_join(f.withColumn("_m", module), imported, "_m", "module").select("file").distinct()
        return f.join(hit, "file", "left_anti")

    def orphan_summary(self) -> DataFrame:
        return self.orphans().agg(F.count("*").alias("orphaned_count"), F.coalesce(F.sum("lines"), F.lit(0)).cast("bigint").alias("orphaned_lines"))

    def http_summary(self) -> DataFrame:
        c = self.http_calls()
        return c.agg(F.count("*").alias("total_external_calls"), F.array_sort(F.collect_set("domain")).alias("domains"))

    def latest_migration(self) -> DataFrame:
        """Migrations that no other revises: the ends of the chain, whatever their file names."""
        m = self.table("migration")
        return m.join(m.select(F.col("down_revision").alias("revision")).where("revision is not null").distinct(), "revision", "left_anti")

    # -- calls
    def resolved_calls(self, builtins: bool = True, compat: bool = False) -> DataFrame:
        """(caller, pos, callee, key, def_file): each call with one definition of its last segment.

        A definition in the caller's file goes first, then the first by file and
        line. Both choices are made before the join, one row a name and one a
        name and file, so a name that is defined everywhere multiplies nothing.
        """
        c = self.calls().withColumn("name", K.last_segment("callee"))
        if not builtins:
            c = c.where(~is_builtin(F.col("callee"), compat))
        d = self.definitions()
        place = F.struct("def_file", "line", "key")
        anywhere = d.groupBy("name").agg(F.min(place).alias("p")).select("name", F.col("p").alias("any"))
        here = d.groupBy("name", F.col("def_file").alias("file")).agg(F.min(F.struct("line", "key", "def_file")).alias("own"))
        joined = c.join(here, ["name", "file"], "left").join(anywhere, "name", "left")
        return joined.select("caller", "pos", "callee", F.coalesce("own.key", "any.key").alias("key"), F.coalesce("own.def_file", "any.def_file").alias("def_file")).where("key is not null")

    def entry_points(self) -> DataFrame:
        """(key, reason): functions that start something, by name, place or decorator; then methods of such names that make calls."""
        s = self.table("symbol").where("kind = 'function'")
        low = F.lower("name")
        reason = (
            F.when(F.exists("decorators", lambda d: d.rlike(_COMMAND)), "decorator")
            .when(F.col("file").endswith("__main__.py"), "module")
            .when(low.isin(*ENTRY_NAMES), "name")
            .when(low.rlike("^(main|setup_)"), "prefix")
        )
        found = s.select(F.concat_ws(":", "file", "name").alias("key"), reason.alias("reason")).where("reason is not null").distinct()
        called = self.calls().where(F.lower("func").isin(*ENTRY_NAMES)).select(F.col("caller").alias("key"), F.lit("call graph").alias("reason")).distinct()
        return found.unionByName(called.join(found.select("key"), "key", "left_anti"))

    def flows(self, depth: int = 6, compat: bool = False) -> DataFrame:
        """(path, depth, truncated) from the entry points, along resolved calls that are not of the standard library."""
        edges = self.resolved_calls(builtins=False, compat=compat).select(F.col("caller").alias("src"), F.col("key").alias("dst"))
        return K.trace_paths(edges, self.entry_points().select("key"), depth)

    def flow_metrics(self, depth: int = 6) -> DataFrame:
        """(root, max_depth, calls, functions) of each entry point that calls something, most calls first to be sorted by the caller."""
        f = self.flows(depth).withColumn("root", F.element_at("path", 1))
        return f.groupBy("root").agg(F.max("depth").alias("max_depth"), F.count_if(F.col("depth") > 0).alias("calls"), F.countDistinct(F.element_at("path", -1)).alias("functions")).where("calls > 0")

    def flow_tree(self, root: str, depth: int = 6) -> str:
        """One entry point's flow as indented text."""
        rows = self.flows(depth).where(F.element_at("path", 1) == root).orderBy("path").collect()  # paths of one root
        return "\n".join("  " * r.depth + ("- " if r.depth else "") + r.path[-1] + (" (again)" if r.truncated else "") for r in rows)

    def central(self, top: int = 15, isolated: int = 10) -> DataFrame:
        """The first nodes of each role, by degree and then name; isolated ones by name."""
        r = self.roles()
        w = Window.partitionBy("role").orderBy(F.desc(F.col("in_degree") + F.col("out_degree")), "node")
        ranked = r.where("role <> 'standard'").withColumn("rank", F.row_number().over(w))
        return ranked.where(F.col("rank") <= F.when(F.col("role") == "isolated", isolated).otherwise(top))

    def caller_samples(self, most: int = 10) -> DataFrame:
        """(node, in_degree, callers): up to ``most`` callers of each function, by name."""
        return K.sampled(self.edges(), "dst", "src", most).select(F.col("dst").alias("node"), F.col("n").alias("in_degree"), F.col("sample").alias("callers"))

    # -- lookups
    def test_files(self) -> DataFrame:
        """Files that are tests by their place or name, each once."""
        from .index import TEST

        return self.files().where(F.col("file").rlike(TEST)).select("file", "language").distinct()

    def find_file(self, name: str) -> DataFrame:
        """The file of that path, or else the first by path of which one path ends with the other."""
        path = F.col("file")
        rank = F.when(path == name, 0).when(path.endswith("/" + name) | F.lit(name).endswith(F.concat(F.lit("/"), path)), 1)
        return self.files().withColumn("rank", rank).where("rank is not null").orderBy("rank", "file").limit(1).drop("rank")

    def lookup(self, symbol: str) -> DataFrame:
        """Symbols whose name, or Class.method, contains the text, with what they call; classes with their methods."""
        s = self.table("symbol")
        full = F.concat_ws(".", "class", "name")
        hit = s.where((F.lower(full) == symbol.lower()) if "." in symbol else F.instr(F.lower(full), symbol.lower()) > 0)
        c = self.calls().groupBy("file", "class", F.col("func").alias("name")).agg(F.sort_array(F.collect_set("callee")).alias("calls"))
        m = s.where("kind = 'method'").groupBy("file", F.col("class").alias("name")).agg(F.sort_array(F.collect_set("name")).alias("methods"))
        same = (hit.file == c.file) & hit["class"].eqNullSafe(c["class"]) & (hit.name == c.name)
        with_calls = hit.join(c, same, "left").select(hit["*"], "calls")
        return with_calls.join(m, (with_calls.file == m.file) & (with_calls.name == m.name) & (with_calls.kind == "class"), "left").select(with_calls["*"], "methods")

    def symbol_document(self, symbol: str, callers: int = 20, callees: int = 20, tests: int = 10) -> str | None:
        """A symbol in Markdown: the first by kind, file and line that matches; None if none does."""
        order = F.when(F.lower("name") == symbol.split(".")[-1].lower(), 0).otherwise(1)
        found = self.lookup(symbol).withColumn("o", order).orderBy("o", "kind", "file", "line").limit(1).collect()
        if not found:
            return None
        s = found[0]
        name = f"{s['class']}.{s['name']}" if s["class"] else s["name"]
        out = [f"# {name}", f"{s['kind']} in `{s['file']}:{s['line']}`"]
        if s["docstring"]:
            out += ["## Description", s["docstring"]]
        if s["signature"]:
            out += ["## Signature", f"```python\n{s['name']}{s['signature']['formatted']}\n```"]
            if s["signature"]["params"]:
                table = "\n".join(f"| `{p['name']}` | {p['type'] or ''} | {'yes' if p['has_default'] else ''} |" for p in s["signature"]["params"])
                out += [f"| parameter | type | default |\n|-|-|-|\n{table}"]
        if s["methods"]:
            out += ["## Methods", "\n".join(f"- `{m}`" for m in s["methods"])]

        def listed(title: str, df: DataFrame, most: int, line) -> None:
            rows = df.limit(most + 1).collect()
            if rows:
                out.extend([title, "\n".join([*map(line, rows[:most]), *(["- and more"] if len(rows) > most else [])])])

        listed("## Calls", self.calls().where((F.col("file") == s["file"]) & F.col("class").eqNullSafe(s["class"]) & (F.col("func") == s["name"])).orderBy("pos"), callees, lambda r: f"- `{r.callee}`")
        leaf = F.col("callee") == s["name"]
        listed("## Called by", self.calls().where(leaf | F.col("callee").endswith("." + s["name"])).select("caller", "line").distinct().orderBy("caller"), callers, lambda r: f"- `{r.caller}` (line {r.line})")
        listed("## Tests", self.tests_for(name).orderBy("file"), tests, lambda r: f"- `{r.file}`")
        if s["code"]:
            out += ["## Code", f"```python\n{s['code']}\n```"]
        return "\n\n".join(out) + "\n"

    # -- summary
    def summary_values(self) -> DataFrame:
        """(name, value): the counts of a scan, one row each."""

        def values(df: DataFrame, **found: Column) -> DataFrame:
            """(name, value) rows of aggregates over one pass of a table."""
            row = df.agg(*(F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in found.items()))
            return row.select(F.expr(f"stack({len(found)}, {', '.join(f"'{n}', {n}" for n in found)}) as (name, value)"))

        n, is_ = F.count("*"), lambda kind: F.col("kind") == kind
        documented = F.coalesce(F.col("docstring") != "", F.lit(False))
        parts = [
            values(self.files(), total_files=n, total_lines=F.sum("lines")),
            values(self.table("todo"), todos_count=n),
            values(self.table("env").where("source <> 'dotenv'"), env_vars_count=F.countDistinct("source", "name")),
            values(self.endpoints(), api_endpoints_count=n, auth_required_endpoints=F.count_if("auth_required")),
            values(self.table("schema"), schemas_count=n),
            values(self.table("model"), database_tables_count=n),
            values(self.test_coverage(), test_coverage_percent=F.round(100.0 * F.count("test") / F.greatest(n, F.lit(1)), 1)),
            values(self.table("http"), external_http_calls=n),
            values(self.complexity(), complexity_issues=n),
            values(self.table("middleware"), middleware_count=n),
            values(self.table("websocket"), websocket_endpoints=n),
            values(self.table("migration"), migrations_count=n),
            values(self.orphan_summary(), orphaned_files_count=F.max("orphaned_count"), orphaned_lines=F.max("orphaned_lines")),
            values(
                self.table("symbol"),
                total_functions=F.count_if(is_("function")),
                total_classes=F.count_if(is_("class")),
                total_methods=F.count_if(is_("method")),
                documented_functions=F.count_if(is_("function") & documented),
                documented_classes=F.count_if(is_("class") & documented),
            ),
            values(self.calls(), call_graph_entries=F.countDistinct("caller")),
            values(self.duplicates(), potential_duplicate_groups=n, total_duplicated_functions=F.sum("n")),
            values(self.entry_points(), entry_points_count=n),
            values(self.flows(), max_call_depth=F.max("depth")),
            values(self.roles(), **{f"{role}_functions": F.count_if(F.col("role") == role) for role in ("core", "hub", "utility", "isolated")}),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def badges(summary: dict[str, float]) -> dict[str, str]:
    """Badge pictures in Markdown, by name, of the values of ``summary_values``."""
    get = lambda k: summary.get(k) or 0
    short = lambda n: f"{n / 1000:.1f}k" if n >= 1000 else f"{n:.0f}"
    shade = lambda p: "brightgreen" if p >= 80 else "yellow" if p >= 50 else "red"
    documented = round(100 * get("documented_functions") / get("total_functions")) if get("total_functions") else 0
    shown = {
        "files": (short(get("total_files")), "blue"),
        "lines": (short(get("total_lines")), "blue"),
        "functions": (short(get("total_functions")), "blue"),
        "classes": (short(get("total_classes")), "blue"),
        "documented": (f"{documented}%", shade(documented)),
        "tested": (f"{get('test_coverage_percent'):g}%", shade(get("test_coverage_percent"))),
        "endpoints": (short(get("api_endpoints_count")), "green"),
        "todos": (short(get("todos_count")), "orange"),
    }
    return {k: f"![{k}](https://img.shields.io/badge/{quote(k)}-{quote(v, safe='')}-{color})" for k, (v, color) in shown.items()}

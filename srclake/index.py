"""A code index as a catalogue of DataFrames, and the questions about its graph and files."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config
from .analyses import Analyses
from .operators import kernels as K
from .sources.parsers import parse_file
from .sources.srctree import read_tree

SCHEMAS = {
    "symbol": "kind string, class string, name string, line int, end_line int, is_async boolean, bases array<string>, decorators array<string>, signature struct<params:array<struct<name:string,type:string,has_default:boolean>>,return_type:string,formatted:string>, docstring string, body_hash string, code string",
    "call": "class string, func string, line int, pos int, callee string",
    "dynamic": "symbol string, line int, pattern string, severity string",
    "import": "scope string, module string, root string, names array<string>",
    "route": "line int, method string, path string, handler string, framework string, summary string, description string, docstring string, auth_required boolean, auth_type string",
    "model": "name string, line int, type string, table string",
    "schema": "name string, line int, type string, base string",
    "assignment": "kind string, name string, line int, annotation string, value_preview string, inferred_type string, initializer string",
    "todo": "type string, message string, line int",
    "http": "line int, library string, method string, url string",
    "env": "source string, name string",
    "middleware": "line int, name string, type string",
    "websocket": "line int, path string, handler string",
    "migration": "filename string, revision string, down_revision string, message string, create_date string, operations array<string>",
    "compose_network": "name string",
    "compose_volume": "name string",
    "service": "name string, image string, build string, ports array<string>, depends_on array<string>, environment array<string>",
    "ddl": "kind string, name string, on_table string",
    "dep": "ecosystem string, section string, name string",
    "ts_symbol": "kind string, name string, line int",
    "ts_route": "line int, method string, path string",
    "api_call": "line int, library string, method string, url string",
    "router_prefix": "router string, prefix string",
    "mode": "value string",
}
#: What counts as a test file: for impact, for mapping symbols to tests (a leading tests/ too), for callers (Python only).
TESTS = {
    "impact": "(^|/)test_[^/]*$|_test\\.[a-z]+$|/tests?/|\\.(test|spec)\\.[a-z]+$",
    "mapper": "(^|/)(tests?/|test_[^/]*$)|_test\\.[a-z]+$|\\.(test|spec)\\.[a-z]+$",
    "callers": "((^|/)(tests?/|test_)[^/]*|(^|/)tests?/.*|_test)\\.py$",
}
TEST = TESTS["mapper"]


def _parsed(files: DataFrame, rules: dict) -> DataFrame:
    def parse(batches):
        for batch in batches:
            out = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                language, facts, error = parse_file(path, content, rules)
                out.append((path, "file", json.dumps({"language": language, "parse_error": error})))
                out += [(path, kind, json.dumps(record, default=str)) for kind, record in facts]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)] if out else [pa.array([], pa.string())] * 3, names=["file", "kind", "data"])

    return files.select("path", "content").mapInArrow(parse, "file string, kind string, data string")


def _file_rows(files: DataFrame) -> DataFrame:
    text = F.decode("content", "ISO-8859-1")  # line ends are the same bytes, and nothing is malformed
    return files.select(F.col("path").alias("file"), F.length("content").alias("size_bytes"), K.line_count(text).alias("lines"), F.concat(F.lit("sha256:"), F.substring(F.sha2("content", 256), 1, 16)).alias("hash"), "mtime")


class CodeIndex(Analyses):
    """Typed tables over one parse of a tree; every query is an ordinary DataFrame.

    ``facts`` has a row (file, kind, data) for each thing found, ``stored`` a row
    for each file.
    """

    def __init__(self, facts: DataFrame, stored: DataFrame, rules: dict | None = None):
        self.spark, self.facts, self.stored, self.rules = facts.sparkSession, facts, stored, config.merge(rules)

    @classmethod
    def of(cls, files: DataFrame, rules: dict | None = None) -> CodeIndex:
        """Parse rows of (path, content, mtime)."""
        return cls(_parsed(files, config.merge(rules)).persist(), _file_rows(files), rules)

    @classmethod
    def scan(cls, spark: SparkSession, root: str, rules: dict | None = None, **options) -> CodeIndex:
        merged = config.merge(rules)
        options = {"exclude": merged["exclude"], "exclude_ext": merged["exclude_ext"], **options}
        return cls.of(read_tree(spark, root, **options), rules)

    @classmethod
    def load(cls, spark: SparkSession, folder: str, rules: dict | None = None) -> CodeIndex:
        """The index that ``save`` wrote."""
        return cls(spark.read.parquet(f"{folder}/facts"), spark.read.parquet(f"{folder}/stored"), rules)

    @classmethod
    def update(cls, spark: SparkSession, root: str, folder: str, rules: dict | None = None, **options) -> tuple[CodeIndex, DataFrame]:
        """(index, changes): a saved index brought up to date. Only added and updated files are parsed; facts of unchanged ones are kept.

        Whatever is derived (call graph, roles, flows, duplicates, ...) is computed from the facts, so nothing of it goes stale.
        """
        merged = config.merge(rules)
        options = {"exclude": merged["exclude"], "exclude_ext": merged["exclude_ext"], **options}
        older, raw = cls.load(spark, folder, rules), read_tree(spark, root, **options)
        stored = _file_rows(raw)
        changes = K.snapshot_diff(older.stored.select("file", "hash"), stored.select("file", "hash"), "file", "hash").persist()
        changed = raw.join(changes.where("status in ('added', 'updated')").select(F.col("file").alias("path")), "path", "left_semi")
        facts = K.retain(older.facts, _parsed(changed, merged), changes, "file").persist()
        return cls(facts, stored, rules), changes

    def table(self, kind: str) -> DataFrame:
        return self.facts.where(F.col("kind") == kind).select("file", F.from_json("data", SCHEMAS[kind]).alias("r")).select("file", "r.*")

    def files(self) -> DataFrame:
        parsed = self.facts.where("kind = 'file'").select("file", F.from_json("data", "language string, parse_error string").alias("r")).select("file", "r.*")
        mode = self.table("mode").withColumnRenamed("value", "parse_mode")
        return self.stored.join(parsed, "file").join(mode, "file", "left").withColumn("category", K.first_rule(F.col("file"), self.rules["categories"]))

    def summary(self) -> DataFrame:
        return K.inventory(self.files(), ["language", "category"], "lines")

    # -- call graph
    def calls(self) -> DataFrame:
        key = F.concat_ws(":", "file", F.concat_ws(".", "class", "func"))
        return self.table("call").select(key.alias("caller"), "file", "class", "func", "line", "pos", "callee")

    def definitions(self) -> DataFrame:
        key = F.concat_ws(":", "file", F.concat_ws(".", "class", "name"))
        return self.table("symbol").where("kind in ('function', 'method')").select(key.alias("key"), F.col("file").alias("def_file"), "name", F.col("class").alias("def_class"), "line")

    def callers(self, symbol: str) -> DataFrame:
        return self.calls().where(K.contains_ci("callee", symbol)).groupBy("caller", "file", "line").agg(F.sort_array(F.collect_set("callee")).alias("matching"))

    def callees(self, function: str) -> DataFrame:
        return self.calls().where(K.contains_ci("caller", function)).select("caller", "pos", "callee")

    def file_calls(self, name: str) -> DataFrame:
        return self.calls().where(K.contains_ci("file", name)).select("file", "caller", "pos", "callee")

    def edges(self) -> DataFrame:
        """Resolved calls: the last segment of the callee equals a defined name. Each call has one definition: of its own file if there is one, else the first."""
        return self.resolved_calls().select(F.col("caller").alias("src"), F.col("key").alias("dst")).distinct()

    def roles(self) -> DataFrame:
        return K.roles(K.degrees(self.edges(), nodes=self.definitions().select("key")))

    def importance(self) -> DataFrame:
        return K.importance(K.degrees(self.edges(), nodes=self.definitions().select("key")))

    def duplicates(self) -> DataFrame:
        s = self.table("symbol").where("kind <> 'class'").withColumn("member", F.concat_ws(":", "file", F.concat_ws(".", "class", "name")))
        return K.duplicate_groups(s, "body_hash", "member")

    # -- change impact and tests
    def impact(self, path: str, depth: int = 2) -> DataFrame:
        """(kind, item, depth): direct and transitive callers, tests and endpoints that a file's change touches."""
        mine = self.definitions().where(F.col("def_file") == path)
        direct = K.suffix_join(self.calls().where(F.col("file") != path), mine.select("name").distinct(), "callee", "name").select(F.col("caller").alias("node"), "file").distinct()
        later = K.transitive(self.edges(), direct.select("node"), depth)
        module = path.rsplit(".", 1)[0].replace("/", ".")
        imports = self.table("import").where(F.col("module").isin(module, module.split(".", 1)[-1]) | F.col("module").endswith("." + module.split(".")[-1]))
        is_test = F.col("file").rlike(TESTS["mapper"])  # with a leading tests/, which the impact predicate lacks
        tests = direct.where(is_test).select("file").union(imports.where(is_test).select("file")).distinct()
        routes = self.table("route")
        touched = routes.where(F.col("file") == path).select("file", "method", "path").union(routes.join(direct.select("file").distinct(), "file", "left_semi").select("file", "method", "path")).distinct()
        return (
            direct.select(F.lit("direct").alias("kind"), F.col("node").alias("item"), F.lit(0).alias("depth"))
            .union(later.select(F.lit("transitive"), "node", "depth"))
            .union(tests.select(F.lit("test"), "file", F.lit(0)))
            .union(touched.select(F.lit("endpoint"), F.concat_ws(" ", "method", "path"), F.lit(0)))
        )

    def tests_for(self, symbol: str) -> DataFrame:
        """Test files by import, call or name of a symbol, with the three reasons."""
        leaf = symbol.split(".")[-1]
        flag = lambda df, name: df.where(F.col("file").rlike(TEST)).select("file").distinct().withColumn(name, F.lit(True))
        by_import = flag(self.table("import").where(F.arrays_overlap("names", F.array(*map(F.lit, symbol.split("."))))), "imported")  # of the symbol or its class
        by_call = flag(self.calls().where(F.col("callee").isin(leaf, symbol) | F.col("callee").endswith("." + leaf)), "called")
        by_name = flag(self.table("symbol").where(F.lower("name").rlike(f"test_?.*{leaf.lower()}")), "named")
        joined = by_import.join(by_call, "file", "full_outer").join(by_name, "file", "full_outer")
        return joined.select("file", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("imported", "called", "named")))

    def test_coverage(self) -> DataFrame:
        """(file, test): source files with the test file that names them, null where there is none."""
        f = self.files().where("language = 'python'").select("file", F.regexp_extract("file", "([^/]+)\\.[^./]+$", 1).alias("stem"))
        tests = f.where(F.col("file").rlike(TEST)).select(F.col("file").alias("test"), F.col("stem").alias("test_stem"))
        source = f.where(~F.col("file").rlike(TEST) & (F.col("stem") != "__init__"))
        wanted = F.array(F.concat(F.lit("test_"), "stem"), F.concat("stem", F.lit("_test")), F.concat(F.lit("test_"), F.substring_index("stem", "_", 1)))
        names = source.select("file", F.posexplode(wanted).alias("rank", "want"))
        return names.join(tests, names.want == tests.test_stem, "left").groupBy("file").agg(F.min_by("test", F.when(F.col("test").isNotNull(), F.struct("rank", "test"))).alias("test"))

    # -- findings
    def complexity(self, file_lines: int | None = None, function_lines: int | None = None, methods: int | None = None) -> DataFrame:
        limits = self.rules["complexity"]
        file_lines, function_lines, methods = file_lines or limits["file_lines"], function_lines or limits["function_lines"], methods or limits["class_methods"]
        s = self.table("symbol")
        big = self.files().select(F.lit("file").alias("kind"), F.col("file").alias("item"), F.col("lines").cast("bigint").alias("size"), K.severity(F.col("lines"), file_lines, 2 * file_lines).alias("severity"))
        span = (F.col("end_line") - F.col("line") + 1).cast("bigint")
        long = s.where("kind <> 'class'").select(F.lit("function"), F.concat_ws(":", "file", F.concat_ws(".", "class", "name")), span, K.severity(span, function_lines, 2 * function_lines))
        wide = s.where("kind = 'method'").groupBy("file", "class").agg(F.count("*").alias("n")).select(F.lit("class"), F.concat_ws(":", "file", "class"), "n", K.severity(F.col("n"), methods, methods + 10))
        return big.union(long).union(wide).where("severity <> 'ok'")

    def endpoints(self) -> DataFrame:
        """Routes with the prefix under which their file's router is included."""
        r = self.table("route").withColumn("stem", F.regexp_extract("file", "([^/]+)\\.py$", 1))
        p = K.pick_latest(self.table("router_prefix"), ["router"], ["file"]).select("router", "prefix")
        return r.join(p, r.stem == p.router, "left").withColumn("full_path", F.concat(F.coalesce("prefix", F.lit("")), F.coalesce("path", F.lit("")))).drop("stem", "router", "prefix")

    def http_calls(self) -> DataFrame:
        return self.table("http").withColumn("domain", K.domain(F.col("url")))

    def diff(self, older: CodeIndex) -> DataFrame:
        return K.snapshot_diff(older.files().select("file", "hash"), self.files().select("file", "hash"), "file", "hash")

    def save(self, folder: str) -> None:
        """The index as Parquet (facts and stored are what ``load`` reads), with one typed folder per table."""
        self.facts.write.mode("overwrite").parquet(f"{folder}/facts")
        self.stored.write.mode("overwrite").parquet(f"{folder}/stored")
        self.files().write.mode("overwrite").parquet(f"{folder}/files")
        for kind in SCHEMAS:
            self.table(kind).write.mode("overwrite").parquet(f"{folder}/{kind}")
        self.spark.range(1).select(F.current_timestamp().alias("generated_at")).write.mode("overwrite").parquet(f"{folder}/meta")

    def document(self) -> DataFrame:
        """One JSON row per file with all its facts."""
        return self.facts.groupBy("file").agg(F.to_json(F.sort_array(F.collect_list(F.struct("kind", "data")))).alias("json"))

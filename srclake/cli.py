"""Command line: ``python -m srclake.cli PATH``, or ``--load FOLDER`` for a saved index."""

from __future__ import annotations

import argparse
import json
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="srclake", description="Index a source tree and ask about it.")
    p.add_argument("path", nargs="?", help="root of the source tree")
    p.add_argument("--load", metavar="FOLDER", help="a saved index, or a document written as FILE.json for --keys, --at and --summary")
    p.add_argument("--save", metavar="FOLDER", help="save the index as Parquet")
    p.add_argument("-o", "--output", metavar="FILE", help="write JSON to a file instead of the screen")
    p.add_argument("--summary", action="store_true", help="only meta, summary and badges")
    p.add_argument("--config", metavar="FILE", help="settings")
    p.add_argument("--init-config", action="store_true", help="print settings to start from")
    p.add_argument("--exclude", metavar="NAMES", help="more names or *endings to leave out, by commas")
    p.add_argument("--exclude-ext", metavar="ENDINGS", help="file endings to leave out, by commas")
    p.add_argument("--update", action="store_true", help="bring the loaded index up to date with PATH")
    p.add_argument("--check", action="store_true", help="is the loaded index out of date?")
    p.add_argument("--schema", action="store_true", help="schemas of the sections")
    p.add_argument("--keys", nargs="?", const="", metavar="PATH", help="keys at a path of the document")
    p.add_argument("--get", metavar="SYMBOL", help="symbols of a name")
    p.add_argument("--at", metavar="PATH", help="data at a path of the document")
    p.add_argument("--limit", type=int, help="most entries to show")
    for name in ("tests", "impact", "doc", "callers", "callees", "search"):
        p.add_argument(f"--{name}", metavar="NAME")
    p.add_argument("--search-threshold", type=float, default=0.3)
    return p


def _rows(df, limit=None):
    from pyspark.sql import functions as F

    found = df.limit(limit) if limit else df
    return [json.loads(r[0]) for r in found.select(F.to_json(F.struct("*"))).collect()]


def answer(spark, a: argparse.Namespace):
    """What the flags ask for, as data or text; ValueError and FileNotFoundError tell what is wrong with them."""
    from . import config, navigate, semantic, staleness
    from .index import CodeIndex

    if a.init_config:
        return config.template()
    rules = config.load(a.config)
    rules["exclude"] = [*rules["exclude"], *(x for x in (a.exclude or "").split(",") if x)]
    rules["exclude_ext"] = [*rules["exclude_ext"], *(x for x in (a.exclude_ext or "").split(",") if x)]
    if (a.update or a.check) and not (a.load and a.path):
        raise ValueError("--update and --check need a path and --load")
    if a.load and a.load.endswith(".json"):
        return _shown(navigate.load(a.load), a)
    if a.update:
        index, changes = CodeIndex.update(spark, a.path, a.load, rules)
        return {"changes": {r.status: r.files for r in staleness.change_counts(changes).collect()}, **({"saved": a.save} if a.save and index.save(a.save) is None else {})}
    if a.load:
        index = CodeIndex.load(spark, a.load, rules)
    elif a.path:
        import os

        if not os.path.isdir(a.path):
            raise FileNotFoundError(f"no folder {a.path}")
        index = CodeIndex.scan(spark, a.path, rules)
    else:
        raise ValueError("give a path or --load")
    if a.check:
        when = spark.read.parquet(f"{a.load}/meta").first()
        return _rows(staleness.check(spark, index.stored, a.path, when[0].astimezone() if when else None))[0]
    if a.schema:
        return navigate.schema(index)
    if a.get:
        return _rows(index.lookup(a.get), a.limit)
    if a.tests:
        return _rows(index.tests_for(a.tests), a.limit)
    if a.impact:
        file = index.find_file(a.impact).first()
        if file is None:
            raise ValueError(f"no file {a.impact} in the index")
        return _rows(index.impact(file["file"]), a.limit)
    if a.doc:
        text = index.symbol_document(a.doc)
        if text is None:
            raise ValueError(f"no symbol {a.doc} in the index")
        return text
    if a.search:
        return _rows(semantic.search(semantic.embed(semantic.symbol_texts(index)), a.search, k=a.limit or 10, least=a.search_threshold))
    if a.callers:
        return _rows(index.callers(a.callers), a.limit)
    if a.callees:
        return _rows(index.callees(a.callees), a.limit)
    if a.save:
        index.save(a.save)
    git = _rows(staleness.git_info(spark, a.path)) if a.path else []
    meta = {"root": a.path, "git": git[0] if git else None}
    if a.summary and a.keys is None and not a.at:
        return navigate.overview(index, meta)
    return _shown(navigate.document(index, meta), a)


def _shown(made: dict, a: argparse.Namespace):
    """The document, or the part of it that the flags name."""
    from . import navigate

    if a.keys is not None:
        return navigate.keys(made, a.keys, a.limit)
    if a.at:
        return navigate.extract(made, a.at, a.limit)
    return {k: made.get(k) for k in ("meta", "summary", "badges")} if a.summary else made


def main(arguments: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    a = parser().parse_args(arguments)
    spark = SparkSession.builder.appName("srclake").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        found = answer(spark, a)
    except (ValueError, FileNotFoundError) as e:
        print(e, file=sys.stderr)
        return 1
    text = found if isinstance(found, str) else json.dumps(found, indent=2, default=str)
    if a.output:
        with open(a.output, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        print(text)
    return 1 if isinstance(found, dict) and "error" in found else 0


if __name__ == "__main__":
    sys.exit(main())

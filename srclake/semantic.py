"""Semantic search over code: a text for each symbol, pluggable embeddings, cosine top-k, and incremental rebuilds."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import kernels as K

#: (regex over the code, tag): what a symbol seems to do.
CONTENT = [
    (r"\b(SELECT|INSERT INTO|UPDATE|DELETE FROM)\b|\.execute\(|\.query\(", "database"),
    (r"\bsession\.(add|commit|flush|rollback)|\.save\(\)", "persistence"),
    (r"requests\.|httpx\.|aiohttp|urlopen|fetch\(", "http client"),
    (r"@\w*(app|router)\.(get|post|put|patch|delete|route)", "endpoint"),
    (r"open\(|Path\(|read_text|write_text|os\.path", "files"),
    (r"json\.(loads?|dumps?)|\.json\(\)", "json"),
    (r"csv\.|read_csv|to_csv", "csv"),
    (r"yaml\.", "yaml"),
    (r"\bre\.(compile|match|search|sub|findall|finditer)", "pattern matching"),
    (r"hashlib|hmac|sha256|md5", "hashing"),
    (r"encrypt|decrypt|cipher|Fernet", "encryption"),
    (r"password|token|jwt|oauth|login", "authentication"),
    (r"permission|authoriz|role", "authorisation"),
    (r"valid(ate|ator)|is_valid|ValidationError", "validation"),
    (r"\bcache|lru_cache|redis", "caching"),
    (r"logg(er|ing)\.", "logging"),
    (r"\btry:|\bexcept\b|raise \w+", "error handling"),
    (r"async def|await |asyncio", "asynchronous"),
    (r"Thread|multiprocessing|concurrent\.futures|Lock\(", "concurrency"),
    (r"subprocess|os\.system", "processes"),
    (r"celery|\.delay\(|schedule|cron", "background work"),
    (r"smtp|send_mail|email", "email"),
    (r"datetime|timedelta|timezone", "dates"),
    (r"os\.environ|getenv|settings\.|config", "configuration"),
    (r"\bassert\b|pytest|unittest|mock", "testing"),
    (r"numpy|pandas|DataFrame|spark", "data processing"),
    (r"sort(ed)?\(|key=lambda", "sorting"),
    (r"render|template|html", "rendering"),
]
DECORATORS = [(r"(?i)(property|cached_property)$", "property"), (r"(?i)(static|class)method$", "utility"), (r"(?i)dataclass$", "data class"), (r"(?i)fixture$", "fixture"), (r"(?i)\.(get|post|put|patch|delete|route)$", "endpoint"), (r"(?i)(command|group)$", "command line")]
NAMES = [(r"(?i)^(get|fetch|load|read|find)_", "reading"), (r"(?i)^(set|save|write|store|update)_", "writing"), (r"(?i)^(create|make|build|new)_", "creation"), (r"(?i)^(delete|remove|drop)_", "deletion"), (r"(?i)^(is|has|can)_", "check"), (r"(?i)^(parse|decode)_", "parsing"), (r"(?i)^(to|as|format|render)_", "conversion"), (r"(?i)^test_", "testing"), (r"(?i)^(handle|on)_", "handler")]
TAGS = 10
TOKENS = 512
DIMENSIONS = 256
HASHING = "hashing-256"


def symbol_texts(index, tokens: int = TOKENS) -> DataFrame:
    """(name, type, file, line, tags, text, docstring, code_preview): what is embedded of each symbol, in at most four characters a token."""
    s = index.table("symbol")
    code = F.coalesce("code", F.lit(""))
    by_decorator = F.flatten(F.transform(F.coalesce("decorators", F.array().cast("array<string>")), lambda d: F.array(*[F.when(d.rlike(p), t) for p, t in DECORATORS])))
    rules = F.concat(F.array(*[F.when(code.rlike(p), t) for p, t in CONTENT]), by_decorator, F.array(*[F.when(F.col("name").rlike(p), t) for p, t in NAMES]))
    tags = F.slice(F.array_distinct(F.array_compact(rules)), 1, TAGS)
    params = F.array_join(F.transform("signature.params", lambda p: F.concat(p["name"], F.lit(": "), F.coalesce(p["type"], F.lit("")))), ", ")
    name = F.concat_ws(".", "class", "name")
    text = F.concat_ws(" ", name, F.when(F.size(tags) > 0, F.array_join(tags, " ")), F.left("docstring", F.lit(500)), F.when(params != "", F.concat(F.lit("("), params, F.lit(")"))), F.concat(F.lit("-> "), F.col("signature.return_type")), F.when(code != "", code))
    return s.select(name.alias("name"), F.col("kind").alias("type"), "file", "line", tags.alias("tags"), F.left(text, F.lit(4 * tokens)).alias("text"), F.left("docstring", F.lit(200)).alias("docstring"), F.left(code, F.lit(200)).alias("code_preview"))


def hashing_embedder(texts: list[str]) -> np.ndarray:
    """A stand-in for a model where none is installed: signed hashing of words and their trigrams, with length 1. It knows no meaning."""
    from zlib import crc32

    out = np.zeros((len(texts), DIMENSIONS), dtype=np.float64)
    for i, text in enumerate(texts):
        for word in "".join(c.lower() if c.isalnum() else " " for c in text or "").split():
            for gram, weight in [(word, 1.0), *((f" {word} "[k : k + 3], 0.3) for k in range(len(word)))]:
                h = crc32(gram.encode())
                out[i, h % DIMENSIONS] += weight if h >> 31 else -weight
    return out / np.maximum(np.sqrt((out * out).sum(axis=1)), 1e-12)[:, None]


def embed(symbols: DataFrame, embedder: Callable[[list[str]], np.ndarray] = hashing_embedder, model: str = HASHING) -> DataFrame:
    """The symbols with ``embedding`` and ``model``; the embedder gets the texts of an Arrow batch at once."""
    names = symbols.columns

    def run(batches):
        for batch in batches:
            made = np.asarray(embedder(batch.column(names.index("text")).to_pylist()), dtype=np.float32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(made), pa.list_(pa.float32())), pa.array([model] * batch.num_rows, pa.string())], names=[*batch.schema.names, "embedding", "model"])

    schema = ", ".join(f"`{n}` {t}" for n, t in symbols.dtypes)
    return symbols.mapInArrow(run, f"{schema}, embedding array<float>, model string")


def update_embeddings(older: DataFrame, index, changes: DataFrame, embedder: Callable[[list[str]], np.ndarray] = hashing_embedder, model: str = HASHING) -> DataFrame:
    """Embeddings after an update: those of unchanged files stay, changed files are embedded anew. Another model rebuilds all."""
    symbols = symbol_texts(index)
    if older.where(F.col("model") != model).limit(1).count():
        return embed(symbols, embedder, model)
    same, changed = changes.where("status = 'unchanged'").select("file"), changes.where("status in ('added', 'updated')").select("file")
    return older.join(same, "file", "left_semi").unionByName(embed(symbols.join(changed, "file", "left_semi"), embedder, model))


def search(vectors: DataFrame, query: str, embedder: Callable[[list[str]], np.ndarray] = hashing_embedder, k: int = 10, least: float = 0.3) -> DataFrame:
    """The k symbols most similar to the query, without those below ``least``; ties by name, file and line."""
    q = [float(x) for x in np.asarray(embedder([query]))[0]]
    score = K.cosine(F.col("embedding"), F.array(*map(F.lit, q)))
    top = vectors.withColumn("_s", score).where("_s is not null").orderBy(F.desc("_s"), "name", "file", "line").limit(k)
    return top.where(F.col("_s") >= least).select("name", "type", "file", "line", F.round("_s", 3).alias("score"), "docstring", "code_preview")

"""Main-text extraction with wrappers induced from the pages of each host.

Induction: DOM skeletons of a host's pages (tags, classes, text hashes; no
text; captures of one page count once) are merged into one wrapper tree, in small batches by hash and then the
batches' trees in turn. Two trees are aligned by simple tree matching; nodes
without a partner are added, so each layout of a host finds its place. A node
knows on how many pages it occurred, with text and without, and the range of
its text hashes: text that never varies belongs to the template, text that
varies is a content slot. Extraction aligns each page with its host's tree and
takes the article, or without such markup the varying slots, and leaves out
page furniture.
"""

from __future__ import annotations

import html as entities
import pickle
import re
import sys
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

_SALTS = 64
_AGREE = 1 << 16  # weight of a pair with one constant text; any other pair weighs 1
BATCH = 32  # trees merged in one go
LEAST_PAGES = 4  # a node must recur on so many distinct pages to be template,
LEAST_SHARE = 0.01  # and on this share of its host's

#: Quotes count after an equals sign only; what is never closed goes on to the end.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?)*+)(?:>|\Z)", re.S)
_END: dict[str, re.Pattern] = {}
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template xmp iframe noembed noframes".split())
_BLOCK = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table caption tbody td tfoot th thead tr ul".split())
_FURNITURE = frozenset("head nav footer aside form button select option menu dialog script style textarea noscript template iframe object embed svg canvas audio video input label datalist noembed noframes title".split())
#: In an article only these are dropped as template: prose that repeats is content.
_BOXES = frozenset("div section small figure figcaption time address".split())
_WORDS = re.compile(r"[^a-z0-9]+")
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup share sharing social comment comments discussion disqus replies related recommended pagination pager toolbar widget skip".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
#: A start tag of the key closes an open element of the value, up to a boundary.
_P_CLOSERS = _BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "dd", "dt", "li", "legend", "summary", "figcaption"}
_SAME = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


class Node:
    __slots__ = ("tag", "names", "children", "furniture", "path")

    def __init__(self, tag: str, names: str, furniture: bool):
        self.tag, self.names, self.children, self.furniture, self.path = tag, names, [], furniture, None


def _element(tag: str, attributes: str) -> Node:
    names, furniture = "", tag in _FURNITURE
    if attributes and ("=" in attributes):
        for kind, a, b, c in _ATTR.findall(attributes):
            value = (a or b or c).lower()
            words = set(_WORDS.split(value))
            if kind.lower() == "role":
                furniture |= bool(words & _ROLES)
            elif tag not in ("html", "body", "article", "main"):
                furniture |= bool(words & _NAMES)
            names += "." + value
    return Node(tag, names, furniture)


def parse(text: str) -> Node:
    """A forgiving DOM of any depth: text children are strings with character references decoded.

    Linear in the text: open elements are found by name, not by walking up.
    """
    root = Node("#", "", False)
    stack = [root]
    where: dict[str, list[int]] = {}  # places in the stack of the open elements of a name
    blocks: list[int] = []  # of open blocks and buttons

    def close(i: int) -> None:
        for x in stack[i:]:
            where[x.tag].pop()
        del stack[i:]
        while blocks and blocks[-1] >= i:
            blocks.pop()

    last = lambda names: max((where[t][-1] for t in names if where.get(t)), default=0)
    at, n = 0, len(text)
    while at < n:
        m = _TOKEN.search(text, at)
        if m is None:
            stack[-1].children.append(entities.unescape(text[at:]))
            break
        if m.start() > at:
            stack[-1].children.append(entities.unescape(text[at : m.start()]))
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):
            if where.get(tag):
                close(where[tag][-1])
            continue
        if tag in _P_CLOSERS and blocks and stack[blocks[-1]].tag == "p":
            close(blocks[-1])
        if tag in _SAME:
            closes, edge = _SAME[tag]
            if (i := last(closes)) > last(edge):
                close(i)
        node = _element(tag, m.group(3))
        stack[-1].children.append(node)
        if tag in _RAW:
            end = _END.setdefault(tag, re.compile(rf"</{tag}(?=[\s/>])[^>]*>?|\Z", re.I)).search(text, at)
            at = end.end()
        elif tag not in _VOID and not m.group(3).rstrip().endswith("/" if tag not in _BLOCK else "\0"):
            where.setdefault(tag, []).append(len(stack))
            if tag in _BLOCK or tag == "button":
                blocks.append(len(stack))
            stack.append(node)
    return root


def _label(node: Node) -> str:
    return node.tag + node.names


def number(root: Node) -> Node:
    """Give nodes the numbers of their paths. Consecutive siblings with one label share a path; furniture has none."""
    state: dict[int, list] = {}
    ids: dict[tuple, int] = {}
    root.path, stack = 0, [(root, False)]
    while stack:
        x, inside = stack.pop()
        now, below = state.setdefault(x.path, [{}, None]), []
        for c in x.children:
            if isinstance(c, str) or c.furniture or (c.tag == "header" and not inside):
                continue
            label = _label(c)
            if label != now[1]:
                now[0][label] = now[0].get(label, 0) + 1
                now[1] = label
            c.path = ids.setdefault((x.path, label, now[0][label]), len(ids) + 1)
            below.append((c, inside or c.tag in ("article", "main")))
        stack += below[::-1]
    return root


def skeleton(root: Node) -> tuple:
    """A tree of (label, pages, pages with own text, children, least and greatest text hash, path), one node a path, without text."""
    own: dict[int, list[str]] = {}
    kids: dict[int, dict[int, str]] = {}
    stack = [root]
    while stack:
        x = stack.pop()
        mine, below, next_ = own.setdefault(x.path, []), kids.setdefault(x.path, {}), []
        for c in x.children:
            if isinstance(c, str):
                if c.strip():
                    mine.append(c)
            elif c.path is not None:
                below[c.path] = _label(c)
                next_.append(c)
        stack += next_[::-1]

    def node(path: int, label: str) -> tuple:
        t = " ".join(" ".join(own[path]).split())
        h = int.from_bytes(blake2b(t.encode("utf-8", "replace"), digest_size=7).digest(), "little") if t else 0
        return label, 1, int(h > 0), [], h, h, path

    top = node(root.path, root.tag)
    trees = [top]
    while trees:
        t = trees.pop()
        t[3].extend(node(p, k) for p, k in kids[t[6]].items())
        trees += t[3]
    return top


def pack(tree: tuple) -> bytes:
    """A tree in bytes, its nodes in a row: depth is no matter."""
    rows, stack = [], [(0, tree)]
    while stack:
        depth, t = stack.pop()
        rows.append((depth, *t[:3], *t[4:6]))
        stack += [(depth + 1, c) for c in reversed(t[3])]
    return pickle.dumps(rows)


def unpack(data: bytes) -> tuple:
    above: list[tuple] = []
    for depth, label, pages, texts, low, high in pickle.loads(data):
        t = (label, pages, texts, [], low, high, None)
        del above[depth:]
        if above:
            above[-1][3].append(t)
        above.append(t)
    return above[0]


def _constant(a: tuple) -> bool:
    return a[2] > 0 and a[4] == a[5]


def match(a: tuple, b: tuple) -> tuple[int, list]:
    """Simple tree matching of nodes with one label: the weight of the heaviest order-keeping match, and (i, j, the
    same below) for its pairs of children. Equal constant texts count first, then the number of pairs."""
    labels = {c[0] for c in a[3]} & {c[0] for c in b[3]}
    p, q = [i for i, c in enumerate(a[3]) if c[0] in labels], [j for j, c in enumerate(b[3]) if c[0] in labels]
    m, n = len(p), len(q)
    best = [[0] * (n + 1) for _ in range(m + 1)]
    pairs = [[(0, [])] * n for _ in range(m)]
    for i in range(m):
        for j in range(n):
            x, y = a[3][p[i]], b[3][q[j]]
            if x[0] == y[0]:
                pairs[i][j] = match(x, y)
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + pairs[i][j][0])
    out, i, j = [], m, n
    while i and j:
        w, inner = pairs[i - 1][j - 1]
        if w and best[i][j] == best[i - 1][j - 1] + w:
            i, j = i - 1, j - 1
            out.append((p[i], q[j], inner))
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return best[m][n] + (_AGREE if _constant(a) and _constant(b) and a[4] == b[4] else 1), out[::-1]


def merge(a: tuple, b: tuple, pairs: list) -> tuple:
    """Both trees in one: matched nodes once, the others of ``b`` between their matched neighbours."""
    kids, i, j = [], 0, 0
    for x, y, inner in pairs:
        kids += a[3][i:x] + b[3][j:y]
        kids.append(merge(a[3][x], b[3][y], inner))
        i, j = x + 1, y + 1
    kids += a[3][i:] + b[3][j:]
    texts = [c for c in (a, b) if c[2]] or [a]
    return a[0], a[1] + b[1], a[2] + b[2], kids, min(c[4] for c in texts), max(c[5] for c in texts), ""


def least_pages(wrapper: tuple) -> float:
    """A host's template shows on so many of its distinct pages at least."""
    return max(LEAST_PAGES, LEAST_SHARE * wrapper[1])


def is_template(a: tuple, least: float) -> bool:
    """One text, on enough distinct pages and on most of those that have the node."""
    return _constant(a) and a[2] >= least and 2 * a[2] >= a[1]


def prune(wrapper: tuple) -> tuple | None:
    """Without what is on too few pages to hold template; None if nothing is template."""
    least = least_pages(wrapper)
    top, found, stack = (*wrapper[:3], [], *wrapper[4:]), False, []
    stack.append((wrapper, top))
    while stack:
        old, new = stack.pop()
        found |= is_template(old, least)
        for c in old[3]:
            if c[1] >= least:
                new[3].append((*c[:3], [], *c[4:]))
                stack.append((c, new[3][-1]))
    return top if found else None


def template_paths(wrapper: tuple, page: tuple) -> frozenset:
    """Paths of the page's nodes that are template: matched with a template node, and with its text."""
    _deep()
    found, least = set(), least_pages(wrapper)
    stack = [(wrapper, page, match(wrapper, page)[1])]
    while stack:
        a, b, pairs = stack.pop()
        if b[2] and a[4] == b[4] and is_template(a, least):
            found.add(b[6])
        stack += [(a[3][i], b[3][j], inner) for i, j, inner in pairs]
    return frozenset(found)


def _deep() -> None:
    """Calls may nest as deep as two pages agree; such frames are on the heap."""
    if sys.getrecursionlimit() < 1_000_000:
        sys.setrecursionlimit(1_000_000)


def host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def _by_host(many: DataFrame, few: DataFrame, spread, how: str) -> DataFrame:
    """Join a row per host to the rows of hosts, with each host cut into _SALTS parts so a hot one is no hot task."""
    salted = few.withColumn("cut", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return many.withColumn("cut", F.pmod(spread, F.lit(_SALTS)).cast("int")).join(salted, ["host", "cut"], how).drop("cut")


def _distinct(captures: DataFrame) -> DataFrame:
    """(host, salt, shape): one capture of each page. Captures with one url (but for its fragment) or payload are one page."""
    first = captures.groupBy("host", "payload").agg(F.min("page").alias("first"))
    by_url = captures.join(first, ["host", "payload"]).groupBy("host", "page").agg(F.min(F.struct("first", "payload", "shape")).alias("one"))
    by_payload = by_url.groupBy("host", F.col("one.first").alias("first")).agg(F.min("one").alias("one"))
    return materialize(by_payload.select("host", F.xxhash64("first").alias("salt"), "one.shape"), "pages")


def induce(pages: DataFrame) -> DataFrame:
    """(host, shape): the wrapper tree of each host that has template nodes."""
    def skeletons(batches):
        for batch in batches:
            rows = [(h, page, payload, pack(skeleton(number(parse(text))))) for h, page, payload, text in zip(*(c.to_pylist() for c in batch.columns)) if text]
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.binary()))], names=["host", "page", "payload", "shape"])

    def merged(batches):
        _deep()
        now, salt, tree = None, 0, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.string()), pa.array([salt], pa.int64()), pa.array([pack(tree)], pa.binary())], names=["host", "salt", "shape"])

        for batch in batches:
            for h, part, p, shape in zip(*(c.to_pylist() for c in batch.columns)):
                new = unpack(shape)
                if (h, part) == now:
                    tree = merge(tree, new, match(tree, new)[1])
                    continue
                if now is not None:
                    yield done()
                now, salt, tree = (h, part), p, new
        if now is not None:
            yield done()

    def wrappers(batches):
        for batch in batches:
            kept = []
            for h, shape in zip(*(c.to_pylist() for c in batch.columns)):
                if (tree := prune(unpack(shape))) is not None:
                    kept.append((h, pack(tree)))
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in kept], pa.string()), pa.array([s for _, s in kept], pa.binary())], names=["host", "shape"])

    kind = "host string, salt long, shape binary"
    payload = F.sha2("html", 256)
    captures = pages.select(host("url").alias("host"), F.coalesce(F.regexp_replace("url", "#.*", ""), payload).alias("page"), payload.alias("payload"), "html")
    captures = captures.where("host <> ''")
    trees = _distinct(materialize(captures.mapInArrow(skeletons, "host string, page string, payload string, shape binary"), "skeletons"))
    level = 0
    while True:
        sizes = trees.groupBy("host").agg(F.count("*").alias("c"))
        if (sizes.agg(F.max("c")).first()[0] or 0) <= 1:
            return materialize(trees.select("host", "shape").mapInArrow(wrappers, "host string, shape binary"), "wrappers")
        level += 1
        part = F.pmod(F.xxhash64("salt", F.lit(level)), F.ceil(F.col("c") / BATCH).cast("long"))
        grouped = _by_host(trees, sizes, F.col("salt"), "inner").select("host", part.alias("part"), "salt", "shape")
        trees = materialize(grouped.repartition("host", "part").sortWithinPartitions("host", "part", "salt").mapInArrow(merged, kind), "trees")


def _articles(node: Node) -> list[Node]:
    """Outermost articles, or else mains, in page order; none inside furniture."""
    found: dict[str, list] = {"article": [], "main": []}
    stack = [(node, frozenset())]
    while stack:
        x, inside = stack.pop()
        if x.tag in found and x.tag not in inside:
            found[x.tag].append(x)
            inside = inside | {x.tag}
        stack += [(c, inside) for c in reversed(x.children) if not isinstance(c, str) and c.path is not None]
    return found["article"] or found["main"]


def main_text(text: str | None, wrapper: tuple | None = None) -> str:
    """The page's blocks, joined by empty lines."""
    if not text:
        return ""
    root = number(parse(text))
    template = template_paths(wrapper, skeleton(root)) if wrapper else frozenset()
    roots = _articles(root)
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        t = " ".join("".join(run).split())
        if t:
            blocks.append(t)
        run.clear()

    def entered(x: Node) -> tuple:
        if x.tag in _BLOCK:
            flush()
        return x, iter(x.children), x.path in template and (not roots or x.tag in _BOXES)

    for r in roots or [root]:
        open_ = [entered(r)]
        while open_:
            x, rest, constant = open_[-1]
            for c in rest:
                if isinstance(c, str):
                    if not constant:
                        run.append(c)
                elif c.tag == "br":
                    run.append(" ")
                elif c.path is not None:
                    open_.append(entered(c))
                    break
            else:
                open_.pop()
                if x.tag in _BLOCK:
                    flush()
        flush()
    if not blocks and template:
        return main_text(text)  # a host whose pages are all alike: nothing varies
    return "\n\n".join(blocks)


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars.

    Null and empty html gives an empty text; pages may be as long and as deep
    as they like. A page whose host has fewer than four distinct pages, or
    whose url is null or names no host, is read without a template: tag and
    class names alone then tell its furniture. Repeated rows give equal results
    and count once as evidence. No rows give no rows. Only page_id, url and
    html are read, so other columns may have any names.
    """
    wrappers = induce(pages).withColumn("cut", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    hosted = pages.select(host("url").alias("host"), F.pmod(F.xxhash64("page_id", "url"), F.lit(_SALTS)).cast("int").alias("cut"), F.lit(1).alias("kind"), F.col("page_id").cast("long").alias("page_id"), "url", "html")
    # a wrapper goes before its pages as a row of its own: joined, it would be repeated in each page's row
    rows = hosted.withColumn("shape", F.lit(None).cast("binary")).unionByName(wrappers.withColumn("kind", F.lit(0)), allowMissingColumns=True)

    def run(batches):
        at, wrapper = None, None
        for batch in batches:
            ids, urls, texts = [], [], []
            for h, cut, kind, page_id, url, text, shape in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    at, wrapper = (h, cut), unpack(shape)
                    continue
                ids.append(page_id), urls.append(url), texts.append(main_text(text, wrapper if (h, cut) == at else None))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.repartition("host", "cut").sortWithinPartitions("host", "cut", "kind").mapInArrow(run, "page_id long, url string, text string, n_chars long")

"""Main text of HTML pages by wrappers inferred for each host.

Every page is read into a light tree of its block elements. Its wrapper is a
union-free regular expression over element tokens: an element with its
children in order, where neighbours that repeat (one element, or a short run)
become a repeated group. The wrappers of a host are aligned with each other:
equal elements are aligned into one, what only one side has becomes optional,
runs become repeated groups, and texts that differ become slots while texts
that are the same everywhere stay constants. Pages of a batch are folded where
they are read, then the partial wrappers of a host block by block in a
reduction tree, so a host with a third of all pages is never in one task.

A host's wrapper counts pages, text and link text of every element, and names
the element that holds the articles: outside menus, page headers, footers,
sidebars, notices, adverts, forms and reader comments (known by element, role
or class), an ``article``, else ``main``, else what classes call content, else
the element reached by following most of the text. A text inside it that
nearly all pages of the host carry at the same place is page furniture: blocks
at its path with this very text are left out, other blocks there stay. Where
such texts are half of the main element or more, the pages are copies of each
other and all of it stays. A page without the named element is read by its own
wrapper.

Defined results. Null or empty html: empty text. No main text: empty. Null
URL: the pages share one host without a name. Broken markup: unclosed
elements end with their parent, unknown ones are inline. Repeated rows each
get their text. Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

import difflib
import html as entities
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

#: Wrappers folded by one task step.
BLOCK = 64
#: Pages on which a text has to be the same to count as furniture, and their share of the host's pages.
CONSTANT_PAGES = 8
CONSTANT_SHARE = 0.9

#: Elements of HTML by what they mean here.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "html body address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption "
    "head title button label option".split()
)
ENDS_P = BLOCKS - {"button", "label", "option"}
DROPPED = set("head title nav footer aside form fieldset dialog menu button label option search".split())
ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar".split())
WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs footer cookie cookies consent notice notices notification banner newsletter subscribe subscription "
    "signup login comment comments commentlist disqus respond reply replies share sharing social related recommended popup modal "
    "overlay widget pagination pager toolbar masthead topbar hidden skip".split()
)
#: Words that say nothing about furniture; a class such as ``share-buttons`` is furniture, ``no-sidebar`` is not.
PLAIN_WORDS = set(
    "box block wrap wrapper container inner outer bar list links link item items posts post article articles story entry button buttons "
    "icon icons area section panel site page global primary secondary left right top bottom form unit slot text header body js".split()
)
CONTENT_WORDS = set("content post entry article story articlebody maincontent main".split())
SAME_KIND = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|select|math|object)\b[^>]*+>.*?(?:</\1\s*>|\Z)"
    r"|</?[a-zA-Z](?:\"[^\"]*\"|'[^']*'|[^'\">])*+>|</?[a-zA-Z][^>]*+>|<[!?][^>]*+>",
    re.S | re.I,
)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_SPACE = re.compile(r"\s+")


class Node:
    """A block element: ``parts`` are texts, (text, True) for link text, and nodes in order."""

    __slots__ = ("name", "label", "parts", "dropped", "content", "inline")

    def __init__(self, name: str, label: str, dropped: bool, content: bool, inline: bool = False):
        self.name, self.label, self.dropped, self.content, self.inline = name, label, dropped, content, inline
        self.parts: list = []


def _says(tokens: list[set[str]], words: set[str]) -> bool:
    """Whether one whole class or id is made of the given words, and plain ones beside them."""
    return any(t & words and t <= words | PLAIN_WORDS for t in tokens)


def _element(name: str, tag: str, inside_article: bool) -> Node | None:
    """The node of an opening tag; None for inline elements that mean nothing here."""
    attrs = {}
    if "=" in tag:
        for k, a, b, c in _ATTR.findall(tag):
            attrs.setdefault(k.lower(), a or b or c)
    classes = f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split() if attrs else []
    tokens = [{w for w in re.split(r"[^a-z]+", c) if w} for c in classes]
    words = set().union(*tokens)
    dropped = (
        name in DROPPED or (name == "header" and not inside_article) or attrs.get("role", "").lower() in ROLES
        or _says(tokens, WORDS) or attrs.get("aria-hidden") == "true" or bool(re.search(r"\shidden(?:[\s=>]|$)", tag))
    ) and name not in ("html", "body", "article", "main") or (name == "article" and _says(tokens, {"comment", "comments", "reply", "advert", "ad", "related", "sponsored"}))
    if name not in BLOCKS and not dropped:
        return None
    content = name == "main" or attrs.get("role") == "main" or attrs.get("itemprop") == "articleBody" or any(t & CONTENT_WORDS and not t & WORDS for t in tokens)
    return Node(name, ".".join([name, *sorted(words)[:3]]), bool(dropped), content, name not in BLOCKS)


def parse(html: str | None) -> Node:
    """The tree of block elements of a page."""
    root = Node("#", "#", False, False)
    stack, at, link, article = [root], 0, 0, 0
    text = html or ""

    def close(to: int) -> None:
        nonlocal article
        for node in stack[to:]:
            article -= node.name == "article"
        del stack[to:]

    def add(raw: str) -> None:
        if raw:
            stack[-1].parts.append((entities.unescape(raw), link > 0))

    for m in _TOKEN.finditer(text):
        add(text[at:m.start()])
        at = m.end()
        tag = m.group()
        found = _NAME.match(tag)
        if not found or m.group(1):
            continue
        name = found.group(1).lower()
        if name == "a":
            link = 0 if tag[1] == "/" else 1
        if tag[1] == "/":
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    close(i)
                    break
                if stack[i].name in ("td", "th", "article", "main") and name in ("p", "li", "div", "span"):
                    break
            continue
        if name == "br":
            add(" ")
        if name in VOID and name != "hr":
            continue
        if name in ENDS_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == "p":
                    close(i)
                    break
                if not stack[i].inline:
                    break
        if name in SAME_KIND:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in SAME_KIND[name]:
                    close(i)
                    break
                if stack[i].name in FENCE[name]:
                    break
        node = _element(name, tag, article > 0)
        if node is None:
            continue
        stack[-1].parts.append(node)
        if name not in VOID and not tag.endswith("/>"):
            stack.append(node)
            article += name == "article"
    add(text[at:])
    return root


# ------------------------------------------------------------------ wrappers
# An item is [label, pages, optional, repeated, constant, text, links, flags, children].

LABEL, PAGES, OPTIONAL, REPEATED, CONSTANT, TEXT, LINKS, FLAGS, CHILDREN = range(9)


def own_text(node: Node) -> str:
    """The text of an element without that of the elements in it."""
    return _SPACE.sub(" ", "".join(p[0] for p in node.parts if type(p) is tuple)).strip()


def item_of(node: Node) -> list:
    """The wrapper of one page's element."""
    text = own_text(node)
    links = sum(len(p[0]) for p in node.parts if type(p) is tuple and p[1])
    kids = [item_of(p) for p in node.parts if type(p) is Node]
    flags = ("d" if node.dropped else "") + ("c" if node.content else "")
    constant = f"{hash_of(text):x}" if text else ""
    return [node.label, 1, False, False, constant, len(text), links, flags, folded(kids)]


def hash_of(text: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def same(a: list, b: list, again: bool) -> list:
    """Two items of one label as one; ``again``: they follow each other on one page."""
    constant = a[CONSTANT] if a[CONSTANT] == b[CONSTANT] else None
    return [
        a[LABEL], max(a[PAGES], b[PAGES]) if again else a[PAGES] + b[PAGES], a[OPTIONAL] or b[OPTIONAL],
        a[REPEATED] or b[REPEATED] or again, constant, a[TEXT] + b[TEXT], a[LINKS] + b[LINKS],
        a[FLAGS] if len(a[FLAGS]) >= len(b[FLAGS]) else b[FLAGS],
        [same(x, y, again) for x, y in zip(a[CHILDREN], b[CHILDREN])] if a[LABEL].startswith("(") else aligned(a[CHILDREN], b[CHILDREN]),
    ]


def folded(items: list) -> list:
    """Runs of one to four items that repeat become repeated groups."""
    out = items
    for size in (1, 2, 3, 4):
        made, i = [], 0
        while i < len(out):
            run = out[i:i + size]
            labels = [x[LABEL] for x in run]
            j = i + size
            group = None
            while len(run) == size and [x[LABEL] for x in out[j:j + size]] == labels:
                if size == 1:
                    run = [same(run[0], out[j], True)]
                else:
                    if group is None:
                        group = ["(" + " ".join(labels) + ")", 1, False, True, "", 0, 0, "", run]
                    group[CHILDREN] = [same(x, y, True) for x, y in zip(group[CHILDREN], out[j:j + size])]
                j += size
            if group is not None:
                made.append(group)
                i = j
            else:
                made.append(run[0])
                i = j if size == 1 else i + 1
        out = made
    return out


def _lone(items: list) -> list:
    return [[*x[:OPTIONAL], True, *x[OPTIONAL + 1:]] for x in items]


def aligned(a: list, b: list) -> list:
    """Two child sequences as one: the common labels in order, the rest optional, runs repeated."""
    if len(a) == len(b) and all(x[LABEL] == y[LABEL] for x, y in zip(a, b)):
        return [same(x, y, False) for x, y in zip(a, b)]
    match = difflib.SequenceMatcher(None, [x[LABEL] for x in a], [x[LABEL] for x in b], autojunk=False)
    out = []
    for kind, i, j, u, v in match.get_opcodes():
        if kind == "equal":
            out += [same(x, y, False) for x, y in zip(a[i:j], b[u:v])]
        else:
            out += _lone(a[i:j]) + _lone(b[u:v])
    return folded(out)


def wrapper_of(pages: list[str]) -> str:
    """Fold serialised wrappers, in a fixed order, into one."""
    items = [json.loads(p) for p in sorted(pages)]
    first = items[0]
    for other in items[1:]:
        first = same(first, other, False)
    return json.dumps(first, separators=(",", ":"))


def expression(item: list) -> str:
    """The wrapper as a regular expression over element tokens, for people to read."""
    slot = "" if item[CONSTANT] == "" else "#text" if item[CONSTANT] is None else "#constant"
    inner = " ".join(x for x in [slot, *map(expression, item[CHILDREN])] if x)
    body = f"({inner})" if item[LABEL].startswith("(") else f"<{item[LABEL]}>{inner}</>"
    return body + ("+" if item[REPEATED] else "") + ("?" if item[OPTIONAL] else "")


# -------------------------------------------------------------- the main element

def _content(item: list) -> int:
    """Characters outside links and dropped elements."""
    if "d" in item[FLAGS]:
        return 0
    return max(0, item[TEXT] - item[LINKS]) + sum(map(_content, item[CHILDREN]))


def _elements(item: list, path: tuple = ()) -> Iterator[tuple[tuple, list]]:
    if "d" in item[FLAGS]:
        return
    here = path if item[LABEL].startswith("(") else (*path, item[LABEL])
    if here != path:
        yield here, item
    for kid in item[CHILDREN]:
        yield from _elements(kid, here)


def rule_of(wrapper: str) -> str:
    """The path of the main element and (path, text hash) of its constants, as JSON."""
    top = json.loads(wrapper)
    elements = [(p, x, _content(x)) for p, x in _elements(top)]
    root: tuple = ()
    for fits in (lambda x: x[LABEL].split(".")[0] == "article", lambda x: "c" in x[FLAGS]):
        held = [(c, -len(p), p) for p, x, c in elements if fits(x) and c > 0]
        if held:
            root = max(held)[2]
            break
    else:
        at = top
        root = (top[LABEL],)
        while True:
            kids = [k for x in at[CHILDREN] for k in (x[CHILDREN] if x[LABEL].startswith("(") else [x]) if "d" not in k[FLAGS]]
            best = max(kids, key=_content, default=None)
            if best is None or best[REPEATED] or _content(best) < 0.6 * max(1, _content(at)):
                break
            at, root = best, (*root, best[LABEL])
    inside = [(p, x) for p, x, _ in elements if p[:len(root)] == root and x[TEXT]]
    least = max(CONSTANT_PAGES, CONSTANT_SHARE * top[PAGES])
    held = [(p, x) for p, x in inside if x[CONSTANT] and x[PAGES] >= least and not x[REPEATED]]
    copies = 2 * sum(x[TEXT] for _, x in held) >= sum(x[TEXT] for _, x in inside)
    return json.dumps({"root": root, "fixed": [] if copies else [(p, x[CONSTANT]) for p, x in held]})


def _blocks(node: Node, path: tuple, fixed: dict[tuple, set[str]], out: list[str]) -> None:
    """Texts of the blocks of an element in page order; inline dropped elements leave nothing."""
    line: list[str] = []
    furniture = path in fixed and f"{hash_of(own_text(node)):x}" in fixed[path]

    def flush() -> None:
        text = _SPACE.sub(" ", "".join(line)).strip()
        line.clear()
        if text and not furniture:
            out.append(text)

    for part in node.parts:
        if type(part) is tuple:
            line.append(part[0])
        elif part.inline:
            continue
        else:
            flush()
            if not part.dropped:
                _blocks(part, (*path, part.label), fixed, out)
    flush()


def _at(node: Node, path: tuple, root: tuple) -> Iterator[Node]:
    """Outermost elements at the path, in page order."""
    if path == root:
        yield node
        return
    for part in node.parts:
        if type(part) is Node and not part.dropped and len(path) < len(root) and part.label == root[len(path)]:
            yield from _at(part, (*path, part.label), root)


def text_by(page: Node, rule: str | None) -> str | None:
    """The main text of a page by a rule; None if the page has no such element."""
    said = json.loads(rule) if rule else {"root": [], "fixed": []}
    root = tuple(said["root"])
    found = list(_at(page, (page.label,), root)) if root else []
    if not found:
        return None
    fixed: dict[tuple, set[str]] = {}
    for path, text in said["fixed"]:
        fixed.setdefault(tuple(path), set()).add(text)
    out: list[str] = []
    for node in found:
        _blocks(node, root, fixed, out)
    return "\n".join(out)


def main_text(html: str | None, rule: str | None = None) -> str:
    """The main text of one page, by the rule of its host or else by its own wrapper."""
    if not html:
        return ""
    page = parse(html)
    text = text_by(page, rule)
    if text is None:
        text = text_by(page, rule_of(json.dumps(item_of(page))))
    return text or ""


# ------------------------------------------------------------------- in Spark

def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def wrappers(pages: DataFrame, url: str = "url", html: str = "html", block: int = BLOCK) -> DataFrame:
    """(host, wrapper) of every host, from all its pages."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            made = [json.dumps(item_of(parse(h)), separators=(",", ":")) for h in part["html"]]
            by = pd.Series(made).groupby(part["host"].to_numpy()).agg(list)
            yield pd.DataFrame({"host": by.index, "wrapper": [wrapper_of(w) for w in by]})

    def fold(key, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [key[0]], "wrapper": [wrapper_of(part["wrapper"].tolist())]})

    level = materialise(
        pages.where(F.length(html) > 0).select(host_of(F.col(url)).alias("host"), F.col(html).alias("html"))
        .mapInPandas(read, "host string, wrapper string"), "wrappers",
    )
    while True:
        counts = level.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
        if (counts.agg(F.max("n")).first()[0] or 0) <= 1:
            return level
        blocks = counts.select("host", F.ceil(F.col("n") / block).cast("bigint").alias("blocks"))
        level = materialise(
            level.join(blocks, "host").withColumn("block", F.pmod(F.xxhash64("wrapper"), F.col("blocks")))
            .select("host", "block", "wrapper").groupBy("host", "block").applyInPandas(fold, "host string, wrapper string"), "wrappers",
        )


def extract(pages: DataFrame, url: str = "url", html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text of every page."""

    @F.pandas_udf("string")
    def ruled(wrapper: pd.Series) -> pd.Series:
        return pd.Series([rule_of(w) for w in wrapper], dtype=object)

    @F.pandas_udf("string")
    def texts(html: pd.Series, rule: pd.Series) -> pd.Series:
        return pd.Series([main_text(h, r) for h, r in zip(html, rule)], dtype=object)

    rules = materialise(wrappers(pages, url, html).select(F.col("host").alias("_w_host"), ruled("wrapper").alias("_w_rule")), "rules")
    joined = pages.withColumn("_w_key", host_of(F.col(url))).join(rules, F.col("_w_key") == F.col("_w_host"), "left")
    return joined.withColumn("_w_text", texts(F.col(html), F.col("_w_rule"))).select(
        *[F.col(c) for c in pages.columns if c != out], F.col("_w_text").alias(out)
    )


def op2_main_text(spark, sf_dir: str) -> DataFrame:
    """Contract query: the main text of every page."""
    found = extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))

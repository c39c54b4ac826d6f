"""Operator 2: main text of web pages, with the recurring parts of a site removed.

Pages are read as a light element tree. Every element outside text blocks has a digest of its subtree (tags,
classes and text). Spark counts, per host, on how many pages each digest occurs, and subtrees that recur on
many pages of the host are deleted as template. What HTML itself names as not being the article (head,
navigation, header and footer outside an article, asides, forms, scripts, styles, adverts, notices, reader
comments by tag, role, class or id) is deleted as well. If a page marks an article or a main part, the text is
taken from there only. Text blocks of an article are never taken for template: an article's sentence may be
quoted on many pages.

Template means: on at least ``MANY`` different pages of the host, however large the host is. The digests of
each different page are written once; those that recur are found by a join on host and digest and gathered
per page, so that a page carries only what it holds itself.

Text: character references are decoded, white space inside a block becomes one space, blocks are trimmed and
joined in page order by an empty line.

Defined results: null or empty html gives the empty text; unclosed and stray tags are tolerated; broken
references stay as they are; pages without url form a host of their own; equal pages of a host count as one
page; an empty table gives no rows; only ``page_id``, ``url`` and ``html`` are read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundscope.llm.common import shelve, stable, table
from groundscope.llm.registry import query

MANY = 8
#: Comments, declarations, elements of raw text (to the end of the page if they have no end), and tags.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"|<(?P<raw>script|textarea|(?:style|title)(?!\b[^>]*/>))(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th "
    "thead title tr ul".split()
)
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li td th dt dd pre blockquote figcaption caption".split())
#: Elements that leave no trace in the text, not even the end of a block. Without an end tag of their own, drawings
#: and choices end before the next tag that cannot be theirs, and of the others only the tag goes.
SILENT = frozenset("svg select noscript template iframe".split())
SILENT_TAG = re.compile(r"<(?:svg|select|noscript|template|iframe)\b", re.I)
NESTING = frozenset(["svg", "template"])
#: Start tags of text that end a drawing, unless they stand in its own text.
LEAVES = BLOCK - {"title", "option"} | frozenset("b big br code em font i img s small span strong sub sup u".split())
#: Elements that an open paragraph or item ends at.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
DROPPED = frozenset("head nav aside form button footer menu dialog label fieldset".split())
HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side-bar|footer|masthead"
    r"|cookies?|consent|gdpr|notice\w*|alert|popup|modal|newsletter|subscribe|signup|sign-up|login|search|share|sharing|social\w*"
    r"|related|recommended|comments?|commentlist|disqus|replies|reply|widget\w*|toolbar|pagination|pager|tags|hidden|sr-only|skip\w*"
    r"|copyright|legal|disclaimer)(?=$|[\s_-])",
    re.I,
)
#: Text of an article, which goes only if a whole class name is of the kind above.
TEXT = LEAF | {"section"}
HEADER = re.compile(r"(?:^|[\s_-])header(?=$|[\s_-])", re.I)
ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
ARTICLE = frozenset(["article", "main"])


class Node:
    __slots__ = ("tag", "mark", "items", "dropped", "inside", "partly")

    def __init__(self, tag: str, mark: str = "", dropped: bool = False):
        self.tag, self.mark, self.items, self.dropped, self.inside = tag, mark, [], dropped, False
        self.partly = False  # dropped for a part of a longer class name or id only


def _opened(tag: str, rest: str, inside: bool) -> Node:
    """A node of a start tag; ``inside``: within an article, where a header belongs to the text."""
    mark, classes, partly, dropped = "", "", False, tag in DROPPED or (tag == "header" and not inside)
    if rest and tag not in ("html", "body"):
        names = []
        for name, a, b, c in ATTRIBUTE.findall(rest):
            name, value = name.lower(), a or b or c
            if name == "role":
                dropped |= value.lower() in ROLE
            elif name in ("class", "id"):
                names.append(value)
                classes += f" {value}" if name == "class" or "comment" in value.lower() else ""
            else:
                dropped |= value.lower() in ("", "true", "hidden")
        mark = " ".join(names)
        if mark and tag not in ARTICLE:
            whole = any(HINT.fullmatch(name) for name in classes.split()) if inside and tag in TEXT else HINT.search(mark)
            if whole or not inside and HEADER.search(mark):
                partly = not dropped and not any(HINT.fullmatch(name) or HEADER.fullmatch(name) for name in mark.split())
                dropped = True
    node = Node(tag, mark, dropped)
    node.partly = partly
    return node


def _ends(tokens: list[re.Match]) -> dict[int, int]:
    """For silent elements that have an end tag of their own: the numbers of their start and end tokens."""
    ends: dict[int, int] = {}
    waiting: dict[str, list[int]] = {tag: [] for tag in SILENT}
    for i, m in enumerate(tokens):
        tag = (m.group("tag") or "").lower()
        if tag not in SILENT:
            continue
        if m.group("end"):
            if waiting[tag]:
                ends[waiting[tag].pop()] = i
        elif not m.group("rest").endswith("/"):
            if tag not in NESTING:
                waiting[tag].clear()
            waiting[tag].append(i)
    return ends


def _behind(tokens: list[re.Match], i: int, tag: str, end: int | None, size: int) -> tuple[int, int]:
    """Where the page goes on behind a silent element that starts at token ``i``: the next token and the place."""
    if tag not in ("svg", "select") or tag == "select" and end is not None:
        last = i if end is None else end
        return last + 1, tokens[last].end()
    own = 0  # open elements of a drawing that hold text of the page's kind
    for j in range(i + 1, len(tokens) if end is None else end):
        name, closing = (tokens[j].group("tag") or "").lower(), bool(tokens[j].group("end"))
        if end is not None and name in ("foreignobject", "desc"):
            own = max(0, own - 1) if closing else own + (not tokens[j].group("rest").endswith("/"))
        elif end is None and name in BLOCK and name != "option" or tag == "svg" and name in LEAVES and not closing and not own:
            return j, tokens[j].start()
    return (len(tokens), size) if end is None else (end + 1, tokens[end].end())


def parse(source: str) -> Node:
    return parsed(source)[0]


def parsed(source: str) -> tuple[Node, list[Node]]:
    """The tree of a page, and its nodes in page order, the root first. Every step takes bounded time at any depth."""
    root = Node("#root")
    stack, nodes, articles, at = [root], [root], 0, 0
    near: list[int] = [0]  # for each open element, the place of the innermost open block
    opened: dict[str, list[int]] = {}  # the places of the open elements of a tag

    def close(i: int) -> int:
        for n in stack[i:]:
            opened[n.tag].pop()
        gone = sum(n.tag in ARTICLE for n in stack[i:])
        del stack[i:], near[i:]
        return gone

    tokens = list(TOKEN.finditer(source))
    ends = _ends(tokens) if SILENT_TAG.search(source) else {}
    skipped = 0
    for i, m in enumerate(tokens):
        if i < skipped:
            continue
        if m.start() > at:
            stack[-1].items.append(source[at : m.start()])
        at = m.end()
        tag = m.group("tag")
        if tag is None:
            continue
        tag = tag.lower()
        if tag in SILENT:
            if not m.group("end") and not m.group("rest").endswith("/"):
                skipped, at = _behind(tokens, i, tag, ends.get(i), len(source))
            continue
        if m.group("end"):
            # An inline end does not close blocks.
            if opened.get(tag) and (tag in BLOCK or near[-1] <= opened[tag][-1]):
                articles -= close(opened[tag][-1])
            continue
        if tag in BLOCK and near[-1] and (stack[near[-1]].tag == "p" or stack[near[-1]].tag in CLOSES.get(tag, ())):
            articles -= close(near[-1])
        node = _opened(tag, m.group("rest"), articles > 0)
        node.inside = articles > 0 or tag in ARTICLE
        stack[-1].items.append(node)
        nodes.append(node)
        if tag not in VOID and not m.group("rest").endswith("/"):
            opened.setdefault(tag, []).append(len(stack))
            near.append(len(stack) if tag in BLOCK else near[-1])
            stack.append(node)
            articles += tag in ARTICLE
    if at < len(source):
        stack[-1].items.append(source[at:])
    return root, nodes


def digests(nodes: list[Node]) -> dict[int, tuple[int, Node]]:
    """Digests of the subtrees that may be template; the nodes are those of a page in page order."""
    found: dict[int, tuple[int, Node]] = {}
    values: dict[int, int] = {}
    for node in reversed(nodes):  # what an element holds comes after it
        parts = [node.tag, node.mark]
        for item in node.items:
            if isinstance(item, str):
                if item.strip():
                    parts.append("t" + " ".join(item.split()))
            else:
                parts.append(str(values.pop(id(item))))
        value = values[id(node)] = stable("\x00".join(parts)) >> 1
        if len(parts) > 2 and not node.dropped and node.tag in BLOCK and node.tag not in ("html", "body", "article", "main", "#root"):
            if not (node.inside and node.tag in LEAF):
                found[id(node)] = (value, node)
    return found


def blocks(node: Node, out: list[list[str]]) -> None:
    """Text blocks in page order; the last list is the open block."""
    todo = [(iter(node.items), False)]
    while todo:
        items, block = todo[-1]
        for item in items:
            if isinstance(item, str):
                out[-1].append(item)
            elif item.dropped:
                out.append([])
            elif item.tag == "br":
                out[-1].append(" ")
            else:
                if item.tag in BLOCK:
                    out.append([])
                todo.append((iter(item.items), item.tag in BLOCK))
                break
        else:
            todo.pop()
            if block:
                out.append([])


def articles(node: Node, partly: bool = False) -> list[Node]:
    """The outermost articles and main parts in page order, with ``partly`` also those in elements of such names."""
    out, todo = [], [node]
    while todo:
        top = todo.pop()
        if top.tag in ARTICLE and top is not node:
            out.append(top)
        else:
            todo += [i for i in reversed(top.items) if isinstance(i, Node) and (not i.dropped or partly and i.partly)]
    return out


def has_text(node: Node) -> bool:
    todo = [node]
    while todo:
        for item in todo.pop().items:
            if isinstance(item, Node):
                if not item.dropped:
                    todo.append(item)
            elif item.strip():
                return True
    return False


def text_of(root: Node) -> str:
    # A layout class such as "with-sidebar" does not hide the only article of a page.
    chosen = [c for c in articles(root) if has_text(c)] or [c for c in articles(root, True) if has_text(c)] or [root]
    out: list[list[str]] = [[]]
    for node in chosen:
        blocks(node, out)
        out.append([])
    done = (" ".join(html.unescape("".join(b)).split()) for b in out if b)
    return "\n\n".join(b for b in done if b)


def subtrees(source: str) -> tuple[Node, dict[int, tuple[int, Node]]]:
    root, nodes = parsed(source)
    return root, digests(nodes)


def extract(source: str, templates: frozenset[int] = frozenset()) -> str:
    """Main text of a page without the subtrees whose digest is a template of its host."""
    if not templates:
        return text_of(parse(source))
    root, found = subtrees(source)
    for value, node in found.values():
        if value in templates:
            node.dropped = True
    return text_of(root)


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [sorted({value for value, _ in subtrees(source.as_py() or "")[1].values()}) for source in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(values, pa.list_(pa.int64()))], ["site", "page", "digests"]
        )


def keyed(pages: DataFrame) -> DataFrame:
    """The pages with ``site`` and ``page``, digests of the host and of the source; equal pages of a host share both."""
    return pages.select("page_id", "url", "html", F.xxhash64(host(F.col("url"))).alias("site"), F.xxhash64("html").alias("page"))


def templates(rows: DataFrame, many: int = MANY) -> DataFrame:
    """(site, page, templates): the digests of a page's own subtrees that recur on many different pages of its host."""
    every = rows.select("site", "page", "html").mapInArrow(_digests, "site long, page long, digests array<long>")
    own = shelve(every.dropDuplicates(["site", "page"])).select("site", "page", F.explode("digests").alias("digest"))
    # Written first, so that a very frequent digest on the other side of the join can be split.
    often = shelve(own.groupBy("site", "digest").agg(F.count("*").alias("n")).filter(F.col("n") >= many).select("site", "digest"))
    return own.join(often, ["site", "digest"], "left_semi").groupBy("site", "page").agg(F.collect_list("digest").alias("templates"))


def main_text(pages: DataFrame, many: int = MANY) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    rows = keyed(pages)
    # Written first: its measured size decides on the join, and a frequent page on the other side can be split.
    known = shelve(templates(rows, many))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                extract(source.as_py() or "", frozenset(listed.as_py() or ()))
                for source, listed in zip(batch.column(2), batch.column(3))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.join(known, ["site", "page"], "left").select("page_id", "url", "html", "templates").mapInArrow(
        run, f"page_id {kind}, url string, text string, n_chars long"
    )


@query("op2_html_text")
def op2_html_text(spark, sf_dir):
    return main_text(table(spark, sf_dir, "pages"))

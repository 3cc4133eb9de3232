"""Pages as arrays of nodes: a tag tokenizer with a stack of open elements, and selections over its result.

`with_nodes` adds an array of nodes in the order of the page.  A node is an element
or a piece of text; `size` counts the nodes inside it, so an element's content is a
slice of the array and every selection is a column expression.  Cells of tables
know their place in the grid that row and column spans leave.

How broken pages are read: tags and attributes have any case, any quotes or none;
list items, table parts, options, terms and paragraphs end where the next one
begins; end tags without a beginning are left out; what is open at the end is
closed there; comments are dropped and scripts and styles kept as raw text that
`text_of` leaves out.  Null and empty pages have no nodes.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style"))
#: What a beginning tag ends, and which open elements keep it from reaching further out.
ENDS = {
    "li": ({"li", "p"}, {"ul", "ol", "menu", "table", "td", "th"}), "dt": ({"dt", "dd", "p"}, {"dl", "table"}), "dd": ({"dt", "dd", "p"}, {"dl", "table"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th", "p", "li"}, {"tr", "table"}), "th": ({"td", "th", "p", "li"}, {"tr", "table"}), "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    **{part: ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}) for part in ("thead", "tbody", "tfoot")},
}
BLOCKS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
P_KEEPS = frozenset(("div", "section", "article", "li", "td", "th", "button", "table", "dd", "body", "nav", "ul", "ol", "aside", "header", "footer", "main", "form", "blockquote"))
TABLE_PARTS = frozenset("table thead tbody tfoot tr td th caption html body".split())
MOST_SPAN = 1000

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"']++|"[^"]*"|'[^']*')*+|[^>]*)>|(?P<text>[^<]+|<)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NODES = T.ArrayType(T.StructType([T.StructField("tag", T.StringType()), T.StructField("attrs", T.MapType(T.StringType(), T.StringType())), T.StructField("text", T.StringType()), T.StructField("size", T.IntegerType()), T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType()), T.StructField("rows", T.IntegerType())]))


def _span(value: str | None) -> int:
    """A span as browsers read it: digits, 1 at least, bounded."""
    found = re.match(r"\s*(\d{1,6})", value or "")
    return min(max(int(found.group(1)), 1), MOST_SPAN) if found else 1


class Reader:
    """One page's nodes as [tag, attributes, text, size, row, column, rows]; tag is empty for text and '#raw' for scripts.

    unescape turns the references of texts into letters; those of attributes are read as browsers do.
    """

    def __init__(self, unescape: Callable[[str], str] = html.unescape) -> None:
        self.unescape = unescape
        self.nodes: list[list] = []
        self.open: list[int] = []
        self.counts: dict[str, int] = {}
        self.grids: list[dict] = []
        self.saying = False

    def close(self, depth: int) -> None:
        """Closes all elements from that depth of the stack on."""
        for at in reversed(self.open[depth:]):
            node = self.nodes[at]
            node[3] = len(self.nodes) - at - 1
            self.counts[node[0]] -= 1
            if node[0] == "table":
                self.grids.pop()
        del self.open[depth:]

    def close_upto(self, names: frozenset | set, keep: frozenset | set) -> None:
        """Closes the outermost open element of those names that is reached without passing one of keep."""
        if not any(self.counts.get(n) for n in names):
            return
        found = None
        for depth in range(len(self.open) - 1, -1, -1):
            tag = self.nodes[self.open[depth]][0]
            if tag in names:
                found = depth
            elif tag in keep:
                break
        if found is not None:
            self.close(found)

    def begin(self, tag: str, rest: str) -> None:
        self.saying = False
        if tag in ENDS:
            self.close_upto(*ENDS[tag])
        elif tag in BLOCKS:
            self.close_upto({"p"}, P_KEEPS)
        attrs: dict[str, str] = {}
        for name, value in ATTRIBUTE.findall(rest):
            if value[:1] in ('"', "'") and value[-1:] == value[:1] and len(value) > 1:
                value = value[1:-1]
            attrs.setdefault(name.lower(), html.unescape(value))
        node = [tag, attrs, None, 0, None, None, None]
        if self.grids and tag in ("tr", "td", "th"):
            self.place(tag, attrs, node)
        self.nodes.append(node)
        if tag not in VOID:
            self.open.append(len(self.nodes) - 1)
            self.counts[tag] = self.counts.get(tag, 0) + 1
            if tag == "table":
                self.grids.append({"row": -1, "col": 0, "until": {}})

    def place(self, tag: str, attrs: dict, node: list) -> None:
        """A row's number, or a cell's row and first free column; spans take columns of later rows."""
        grid = self.grids[-1]
        if tag == "tr" or grid["row"] < 0:
            grid["row"] += 1
            grid["col"] = 0
        if tag == "tr":
            node[4] = grid["row"]
            return
        until, col, row = grid["until"], grid["col"], grid["row"]
        while until.get(col, 0) > row:
            col += 1
        rows, cols = _span(attrs.get("rowspan")), _span(attrs.get("colspan"))
        for k in range(col, col + cols):
            until[k] = max(until.get(k, 0), row + rows)
        grid["col"] = col + cols
        node[4], node[5], node[6] = row, col, rows

    def end(self, tag: str) -> None:
        self.saying = False
        if not self.counts.get(tag):
            return
        for depth in range(len(self.open) - 1, -1, -1):
            at = self.nodes[self.open[depth]][0]
            if at == tag:
                self.close(depth)
                return
            # Cells and tables hold back end tags of what lies outside them.
            if at in ("td", "th", "caption", "table") and tag not in TABLE_PARTS:
                return

    def read(self, page: str) -> list[list]:
        at, end = 0, len(page)
        while at < end:
            m = TOKEN.match(page, at)
            if m is None:  # a tag that never ends
                self.say(page[at:])
                break
            at = m.end()
            tag = m.group("tag")
            if m.group("text") is not None:
                self.say(m.group("text"))
            elif tag is not None:
                tag = tag.lower()
                if m.group("end"):
                    self.end(tag)
                    continue
                self.begin(tag, m.group("rest"))
                if tag in RAW:
                    stop = re.compile(f"</{tag}", re.I).search(page, at)
                    raw = page[at : stop.start() if stop else end]
                    if raw:
                        self.nodes.append(["#raw", {}, raw, 0, None, None, None])
                    at += len(raw)
        self.close(0)
        return self.nodes

    def say(self, text: str) -> None:
        """Text goes on where only comments lie between."""
        if self.saying:
            self.nodes[-1][2] += self.unescape(text)
        else:
            self.nodes.append(["", {}, self.unescape(text), 0, None, None, None])
            self.saying = True


def _as_array(pages: list[list[list]]) -> pa.Array:
    flat = [n for p in pages for n in p]
    keys, values, ends = [], [], [0]
    for n in flat:
        keys += n[1].keys()
        values += n[1].values()
        ends.append(len(keys))
    attrs = pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys, pa.string()), pa.array(values, pa.string()))
    one = lambda k, t: pa.array([n[k] for n in flat], t)
    kinds = [pa.string(), attrs, pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
    fields = [attrs if k == 1 else one(k, t) for k, t in enumerate(kinds)]
    nodes = pa.StructArray.from_arrays(fields, names=["tag", "attrs", "text", "size", "row", "col", "rows"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, pages)]), pa.int32()), nodes)


def with_nodes(df: DataFrame, html_col: str = "html", into: str = "nodes", at_once: int = 64, unescape: Callable[[str], str] = html.unescape) -> DataFrame:
    """The rows with their page's nodes in place of the page."""
    shown = [c for c in df.columns if c != html_col]
    shape = T.StructType([*[df.schema[c] for c in shown], T.StructField(into, NODES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, at_once):
                b = whole.slice(k, at_once)
                nodes = _as_array([Reader(unescape).read(p or "") for p in b.column(b.num_columns - 1).to_pylist()])
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], nodes], names=[*shown, into])

    return df.select(*shown, html_col).mapInArrow(run, shape)


# Selections: a subtree is an array of nodes that begins with its element.

Test = Callable[[Column], Column]


def attr(node: Column, name: str) -> Column:
    """An attribute, or null."""
    return F.try_element_at(node["attrs"], F.lit(name))


def tag(*names: str) -> Test:
    return lambda n: n["tag"].isin(*names)


def has_class(name: str) -> Test:
    return lambda n: F.coalesce(F.array_contains(F.split(F.trim(attr(n, "class")), "\\s+"), name), F.lit(False))


def attr_has(name: str, part: str) -> Test:
    """Elements with such a part in an attribute, as [name*='part'] selects."""
    return lambda n: F.coalesce(attr(n, name).contains(part), F.lit(False))


def has_attr(name: str) -> Test:
    return lambda n: attr(n, name).isNotNull()


def both(*tests: Test) -> Test:
    def all_of(n: Column) -> Column:
        out = tests[0](n)
        for t in tests[1:]:
            out = out & t(n)
        return out

    return all_of


def either(*tests: Test) -> Test:
    def any_of(n: Column) -> Column:
        out = tests[0](n)
        for t in tests[1:]:
            out = out | t(n)
        return out

    return any_of


def subtrees(nodes: Column, test: Test) -> Column:
    """The subtrees of all elements that pass, in the order of the page; nested ones as well."""
    placed = F.transform(nodes, lambda n, i: F.struct(i.alias("i"), n["size"].alias("size"), test(n).alias("ok")))
    return F.transform(F.filter(placed, lambda x: x["ok"]), lambda x: F.slice(nodes, x["i"] + 1, x["size"] + 1))


def inside(subtree: Column) -> Column:
    """All nodes of a subtree but its own element."""
    return F.slice(subtree, 2, F.greatest(F.size(subtree) - 1, F.lit(0)))


def first(nodes: Column, test: Test) -> Column:
    """The first such subtree, or null."""
    return F.try_element_at(subtrees(nodes, test), F.lit(1))


def under(nodes: Column, outer: Test, inner: Test) -> Column:
    """Subtrees of inner elements that lie in outer ones, as the selector `outer inner`; each once."""
    placed = F.transform(nodes, lambda n, i: F.struct(i.alias("i"), n["size"].alias("size"), outer(n).alias("around"), inner(n).alias("ok")))
    around = F.filter(placed, lambda x: x["around"])
    inside_one = lambda x: x["ok"] & F.exists(around, lambda o: (o["i"] < x["i"]) & (x["i"] <= o["i"] + o["size"]))
    return F.transform(F.filter(placed, inside_one), lambda x: F.slice(nodes, x["i"] + 1, x["size"] + 1))


def text_of(subtree: Column, between: str = "") -> Column:
    """The text inside, scripts and styles left out."""
    return F.array_join(F.transform(F.filter(subtree, lambda n: n["tag"] == ""), lambda n: n["text"]), between)


def own(subtree: Column) -> Column:
    """The element of a subtree."""
    return F.try_element_at(subtree, F.lit(1))


def grid_rows(table: Column) -> Column:
    """A table's rows as arrays of cells' subtrees, by column; a cell that spans rows is in each of them.

    Rows and cells of tables inside its cells are not its own.
    """
    placed = F.transform(table, lambda n, i: F.struct(i.alias("i"), n.alias("n")))
    nested = F.transform(F.filter(placed, lambda x: (x["n"]["tag"] == "table") & (x["i"] > 0)), lambda x: F.struct(x["i"].alias("lo"), (x["i"] + x["n"]["size"]).alias("hi")))
    mine = lambda i: ~F.exists(nested, lambda t: (t["lo"] < i) & (i <= t["hi"]))
    cells = F.filter(placed, lambda x: x["n"]["tag"].isin("td", "th") & mine(x["i"]))
    last = F.coalesce(F.array_max(F.transform(F.filter(placed, lambda x: x["n"]["tag"].isin("tr", "td", "th") & mine(x["i"])), lambda x: x["n"]["row"])), F.lit(-1))

    def row(r: Column) -> Column:
        here = F.filter(cells, lambda c: (c["n"]["row"] <= r) & (r < c["n"]["row"] + c["n"]["rows"]))
        ordered = F.array_sort(F.transform(here, lambda c: F.struct(c["n"]["col"].alias("col"), c["i"].alias("i"), c["n"]["size"].alias("size"))))
        return F.transform(ordered, lambda c: F.slice(table, c["i"] + 1, c["size"] + 1))

    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), row)).otherwise(F.expr("array()").cast(T.ArrayType(T.ArrayType(NODES))))

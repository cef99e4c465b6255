"""Pages as elements: a tag stack over the markup, so that nested elements keep their ends."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from forecourt.session import send_code

# FIXED VALUES: elements without content, with raw text, and whose start or end closes others.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
HIDDEN = frozenset("script style template title".split())
BLOCK = frozenset(
    "address article aside blockquote body center details dialog div dl dd dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th"
    " thead tr ul".split())
CLOSES = {  # a start tag, what it ends, and where the search for that stops
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
}
INSIDE_P = BLOCK - frozenset("body dd dt html li tbody td tfoot th thead tr".split())  # these end an open p
CELLS = frozenset("td th button table".split())

ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
MARK = re.compile(
    r"""<!--(?:>|->|.*?(?:-->|\Z))|</([a-z][^\s/>]*)[^>]*(?:>|\Z)|"""
    r"""<([a-z][^\s/>]*+)((?:[\s/]++(?:[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*+))?+)?+)*+)>|"""
    r"""<[a-z][^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S | re.I)

ELEMENT = T.StructType([
    T.StructField("tag", T.StringType()), T.StructField("first", T.IntegerType()),
    T.StructField("last", T.IntegerType()), T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()), T.StructField("attributes", T.MapType(T.StringType(), T.StringType()))])


def parse(page: str, wanted: frozenset[str]) -> tuple[str, list[tuple]]:
    """(visible text, elements in the order of their start tags) of a page.

    An element is its tag, its own number, the number after its last descendant, where its
    text starts and ends in the visible text, and those of the ``wanted`` attributes that
    it has.  An end tag closes the nearest open element of its name and all inside it, but an
    inline one does not reach beyond a block; without such an element it does nothing.  Line
    breaks are ``\\n``; scripts, styles and comments are not visible; a tag that the page's end
    cuts off is no element.
    """
    out: list[list] = []
    pieces: list[str] = []
    open_: list[int] = []
    count: Counter[str] = Counter()  # open elements by tag: most searches end here
    length = at = 0

    def add(text: str) -> None:
        nonlocal length
        if text:
            text = html.unescape(text) if "&" in text else text
            pieces.append(text)
            length += len(text)

    def close(to: int) -> None:
        for k in open_[to:]:
            out[k][2], out[k][4] = len(out), length
            count[out[k][0]] -= 1
        del open_[to:]

    def find(names, stop) -> int | None:
        if not any(count[n] for n in names):
            return None
        for place in range(len(open_) - 1, -1, -1):
            tag = out[open_[place]][0]
            if tag in names:
                return place
            if tag in stop:
                return None
        return None

    while mark := MARK.search(page, at):
        add(page[at:mark.start()])
        at = mark.end()
        end, tag = (x.lower() if x else x for x in mark.group(1, 2))
        if end:
            place = find({end}, () if end in BLOCK else BLOCK)
            if place is not None:
                close(place)
        elif tag:
            if tag in INSIDE_P and (place := find({"p"}, CELLS)) is not None:
                close(place)
            if tag in CLOSES and (place := find(*CLOSES[tag])) is not None:
                close(place)
            found: dict[str, str] = {}
            for name, a, b, c in ATTRIBUTE.findall(mark.group(3)) if wanted else ():
                if name.lower() in wanted:
                    found.setdefault(name.lower(), html.unescape(a or b or c))
            out.append([tag, len(out), len(out) + 1, length, length, found])
            if tag == "br":
                add("\n")
            elif tag in RAW:
                stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                inside = page[at:stop.start() if stop else len(page)]
                if tag not in HIDDEN:
                    add(inside)
                out[-1][4], at = length, stop.end() if stop else len(page)
            elif tag not in VOID:
                open_.append(len(out) - 1)
                count[tag] += 1
    add(page[at:])
    close(0)
    return "".join(pieces), [tuple(e) for e in out]


def with_elements(pages: DataFrame, column: str, keys: list[str], wanted: frozenset[str]) -> DataFrame:
    """``keys``, ``visible`` and ``elements`` of every page; a null page has neither text nor elements.

    Works page by page without a shuffle, a few pages at a time.
    """
    send_code(pages.sparkSession)
    rows = pages.select(*keys, column)
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("visible", T.StringType()),
                           T.StructField("elements", T.ArrayType(ELEMENT))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch], size: int = 32) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), size):
                part = batch.slice(i, size)
                texts, elements = zip(*(parse(p.as_py() or "", wanted) for p in part.column(len(keys))), strict=True)
                flat = [e for page in elements for e in page]
                columns = list(zip(*flat, strict=True)) or [()] * len(ELEMENT)
                columns[-1] = [list(a.items()) for a in columns[-1]]
                structs = pa.StructArray.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, arrow.field(len(keys) + 1).type.value_type, strict=True)],
                    fields=list(arrow.field(len(keys) + 1).type.value_type))
                ends = [0]
                for page in elements:
                    ends.append(ends[-1] + len(page))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs).cast(arrow.field(len(keys) + 1).type)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(texts, arrow.field(len(keys)).type), lists], schema=arrow)
    return rows.mapInArrow(run, schema)

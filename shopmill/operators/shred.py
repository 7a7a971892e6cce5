"""Page HTML to an array of elements, one row per page.

Each page stays one row, so everything that compares elements of a page (ancestors, first match, ranking)
runs inside the row and needs no shuffle. Subtree texts are not copied into the elements: an element holds
offsets into the two page texts, so the texts stay linear in the page however deep it nests. Elements refer to each
other by index in the array; ``up`` lists the kept ancestors, the outermost first.
"""

from __future__ import annotations

import gc
import html as entities
import re
import sys
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Send this module's functions with the tasks, so that executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ELEMENT_DDL = (
    "struct<up:array<int>,pos:int,end_pos:int,parent_pos:int,depth:int,tag:string,nth:int,child:int,last_child:boolean,"
    "id:string,classes:array<string>,attrs:map<string,string>,text_at:int,text_len:int,shown_at:int,"
    "shown_len:int,own_at:int,own_len:int,visible:boolean>"
)
ELEMENT_ARROW = pa.struct(
    [
        ("up", pa.list_(pa.int32())), ("pos", pa.int32()), ("end_pos", pa.int32()), ("parent_pos", pa.int32()), ("depth", pa.int32()),
        ("tag", pa.string()), ("nth", pa.int32()), ("child", pa.int32()), ("last_child", pa.bool_()),
        ("id", pa.string()), ("classes", pa.list_(pa.string())), ("attrs", pa.map_(pa.string(), pa.string())),
        ("text_at", pa.int32()), ("text_len", pa.int32()), ("shown_at", pa.int32()), ("shown_len", pa.int32()),
        ("own_at", pa.int32()), ("own_len", pa.int32()),
        ("visible", pa.bool_()),
    ]
)
PAGES_PER_BATCH = 128
#: Tags that a task remembers by their text, and characters of the longest.
KNOWN_TAGS, LONGEST_KNOWN = 4096, 200

# An attribute has a name, which may hold quotes, and maybe a value; a quote opens a value only where the value begins
# and then runs to the next such quote, whatever stands between. Every form takes in all that it has looked at: one that
# is not closed runs to the end of the page and is dropped there. So no character is read more than twice, and the time is linear.
_VALUE = r"(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s\"'>][^\s>]*+)"
_ATTRIBUTES = rf"(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+{_VALUE}?)?)*+"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    rf"|<(?P<ended>/)?(?P<tag>[a-zA-Z][^\s/>]*+)(?P<source>{_ATTRIBUTES})(?:(?P<closed>>)|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(
    r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>][^\s>]*+))?)?"
)
HIDING = re.compile(r"display\s*:\s*none", re.I)
MAY_HIDE = re.compile("hidden|display", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
UNSHOWN = frozenset("script style noscript iframe template textarea".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul "
    "title option".split()
)
CELL = frozenset(["td", "th"])
SCOPE = frozenset("table td th caption html".split())
PARAGRAPH_ENDERS = BLOCK - frozenset("body dd dt html li option tbody tfoot thead title tr".split())
# What an end tag may not reach across, by kind of tag.
TABLE_PARTS = frozenset("tbody thead tfoot tr td th caption body html".split())
INLINE_LIMITS = BLOCK | SCOPE
_LIST, _TABLE = frozenset("ul ol menu table td th".split()), frozenset(["table"])
# tag -> (open elements that it ends, elements that protect what lies outside them)
IMPLIED_ENDS = {
    **{tag: (frozenset(["p"]), SCOPE | {"button"}) for tag in PARAGRAPH_ENDERS},
    "li": (frozenset(["li"]), _LIST),
    **{tag: (frozenset(["dt", "dd"]), frozenset(["dl"])) for tag in ("dt", "dd")},
    **{tag: (CELL, frozenset(["tr", "table"])) for tag in CELL},
    "tr": (CELL | {"tr"}, _TABLE),
    **{tag: (CELL | {"tr", "tbody", "thead", "tfoot"}, _TABLE) for tag in ("tbody", "thead", "tfoot")},
    "option": (frozenset(["option"]), frozenset(["select"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
}


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, double, single, bare in ATTRIBUTE.findall(source):
        value = double or single or bare
        found.setdefault(name.lower(), entities.unescape(value) if "&" in value else value)
    return found


def _hides(tag: str, source: str, attrs: dict[str, str]) -> bool:
    return MAY_HIDE.search(source) is not None and (
        "hidden" in attrs
        or (tag == "input" and attrs.get("type") == "hidden")
        or HIDING.search(attrs.get("style", "")) is not None
    )


class _Tag:
    """What the text of a tag says by itself, worked out once for all tags that are written alike."""

    __slots__ = ("attrs", "block", "breaks", "ended", "hides", "implied", "keep", "name", "raw", "tab", "unshown", "void")

    def __init__(self, name: str, ended: bool, keep, attrs: dict[str, str] | None, hides: bool) -> None:
        self.name, self.ended, self.keep, self.attrs, self.hides = name, ended, keep, attrs, hides
        self.block, self.tab, self.breaks = name in BLOCK, name in CELL and name not in BLOCK, name == "br"
        self.unshown, self.void, self.raw, self.implied = name in UNSHOWN, name in VOID, name in RAW, name in IMPLIED_ENDS


#: A tag that the end of the page cuts off.
_CUT_OFF = _Tag("", False, None, None, False)


class _Open:
    """An element whose end tag has not been seen."""

    __slots__ = ("child", "children", "counts", "hidden", "keep", "last", "nth", "own_at", "own_children", "own_len", "pos",
                 "shown_at", "tag", "text_at", "unshown")


class _Page:
    """Texts, finished elements and open elements of one page while its tokens are read."""

    __slots__ = ("places", "root", "rows", "shown", "shown_len", "stack", "tail", "text", "text_len")

    def __init__(self) -> None:
        self.root = _Open()
        self.root.counts, self.root.children, self.root.last, self.root.keep, self.root.pos = {}, 0, None, None, None
        self.root.hidden = self.root.unshown = False
        self.root.own_at, self.root.own_children, self.root.own_len = None, 0, 0
        self.stack: list[_Open] = []
        self.places: dict[str, list[int]] = {}  # by tag, where in the stack it is open
        self.rows: list[list | None] = []
        self.text: list[str] = []
        self.shown: list[str] = []
        self.text_len = self.shown_len = 0
        self.tail = "\n"

    def show(self, text: str) -> None:
        self.shown.append(text)
        self.shown_len += len(text)
        self.tail = text[-1]

    def add_text(self, parent: _Open, text: str) -> None:
        self.text.append(text)
        if parent.own_at is None:
            parent.own_at, parent.own_children, parent.own_len = self.text_len, parent.children, len(text)
        elif parent.own_children == parent.children:
            parent.own_len += len(text)
        self.text_len += len(text)
        if parent.unshown or parent.hidden:
            return
        words = text.split()
        if words:
            line = " ".join(words)
            if text[-1].isspace():
                line += " "
            if text[0].isspace() and self.tail not in " \n\t":
                line = " " + line
            self.show(line)
        elif text and self.tail not in " \n\t":
            self.show(" ")

    def open(self, parent: _Open, tag: _Tag, levels: int) -> _Open:
        rows, name = self.rows, tag.name
        item = _Open()
        item.tag = tag
        item.pos = parent.last = len(rows)
        rows.append(None)
        item.counts, item.children, item.last = None, 0, None
        counts = parent.counts
        if counts is None:
            counts = parent.counts = {}
        item.nth = counts[name] = counts.get(name, 0) + 1
        item.child = parent.children = parent.children + 1
        item.keep = tag.keep
        if levels and item.keep is not None:
            for ancestor in self.stack[-levels:]:
                if ancestor.keep is None:
                    ancestor.keep = ()
        hidden = item.hidden = parent.hidden or tag.hides
        unshown = item.unshown = parent.unshown or tag.unshown
        if not (hidden or unshown):
            if tag.block:
                if self.tail != "\n":
                    self.show("\n")
            elif tag.tab:
                if self.tail not in "\n\t":
                    self.show("\t")
            elif tag.breaks:
                self.show("\n")
        item.text_at, item.shown_at = self.text_len, self.shown_len
        item.own_at, item.own_children, item.own_len = None, 0, None
        return item

    def close(self, item: _Open, depth: int, parent: _Open) -> None:
        """Finish an element: its subtree is complete. The first cell is filled when the page is complete."""
        rows, tag = self.rows, item.tag
        if item.last is not None and rows[item.last]:
            rows[item.last][8] = True
        if item.keep is not None:
            attrs = tag.attrs
            rows[item.pos] = [
                None, item.pos, len(rows) - 1, parent.pos, depth, tag.name, item.nth, item.child, False,
                attrs.get("id"), attrs["class"].split() if "class" in attrs else (), attrs,
                item.text_at, self.text_len - item.text_at, item.shown_at, self.shown_len - item.shown_at,
                item.own_at, item.own_len, not item.hidden, item.keep,
            ]
        if tag.block and self.tail != "\n" and not (item.hidden or item.unshown):
            self.show("\n")

    def pop_to(self, size: int) -> None:
        stack = self.stack
        while len(stack) > size:
            item = stack.pop()
            self.places[item.tag.name].pop()
            self.close(item, len(stack), stack[-1] if stack else self.root)

    def imply_ends(self, tag: str) -> None:
        """End the open elements that a start tag ends without saying so."""
        ended, protected = IMPLIED_ENDS[tag]
        places = self.places
        open_now = [places[name] for name in ended & places.keys() if places[name]]
        if not open_now:
            return
        floor = self.innermost(protected)
        in_reach = [places[bisect_right(places, floor)] for places in open_now if places[-1] > floor]
        if in_reach:
            self.pop_to(min(in_reach))

    def innermost(self, tags: Iterable[str]) -> int:
        """Place of the innermost open element with one of the tags, -1 without any."""
        return max((places[-1] for places in map(self.places.get, tags) if places), default=-1)

    def end(self, tag: str) -> None:
        """Apply an end tag; one without a start tag in reach is ignored."""
        places = self.places.get(tag)
        if not places:
            return
        place = places[-1]
        limits = (
            () if tag == "table" else ("table",) if tag in TABLE_PARTS else SCOPE if tag in BLOCK else INLINE_LIMITS
        )
        if place == len(self.stack) - 1 or self.innermost(limits) <= place:
            self.pop_to(place)


def _read(html: str, inspect, levels: int) -> _Page:
    """Take a page apart; ``inspect`` is what ``_inspector`` gives."""
    page = _Page()
    stack, places, root, known = page.stack, page.places, page.root, inspect.known
    parent, at = root, 0
    while (start := html.find("<", at)) >= 0:
        # a tag that is known by its text up to the first > ends there, as only quotes could hide one and all are closed
        stop = html.find(">", start) + 1
        tag = known.get(html[start:stop]) if 0 < stop - start < LONGEST_KNOWN else None
        if tag is None:
            token = TOKEN.search(html, at)
            if token is None:
                break
            start, stop = token.span()
            tag = inspect(token)
        if start > at:
            text = html[at:start]
            page.add_text(parent, entities.unescape(text) if "&" in text else text)
        at = stop
        if tag is None:
            # a comment ends the run of text before it
            parent.own_children = None if parent.own_at is not None else 0
            continue
        if tag is _CUT_OFF:
            break
        name = tag.name
        if tag.ended:
            if stack and parent.tag.name == name:
                stack.pop()
                places[name].pop()
                item, parent = parent, stack[-1] if stack else root
                page.close(item, len(stack), parent)
            else:
                page.end(name)
                parent = stack[-1] if stack else root
            continue
        if tag.implied and stack:
            page.imply_ends(name)
            parent = stack[-1] if stack else root
        item = page.open(parent, tag, levels)
        if tag.void:
            page.close(item, len(stack), parent)
            continue
        if name in places:
            places[name].append(len(stack))
        else:
            places[name] = [len(stack)]
        stack.append(item)
        if tag.raw:
            end = re.compile(rf"</{name}[^>]*+(?:>|\Z)", re.I).search(html, at)
            raw, at = html[at : end.start() if end else len(html)], end.end() if end else len(html)
            page.add_text(item, entities.unescape(raw) if name in ("title", "textarea") else raw)
            page.pop_to(len(stack) - 1)
        else:
            parent = item
    if at < len(html):
        page.add_text(parent, entities.unescape(html[at:]))
    page.pop_to(0)
    if root.last is not None and page.rows[root.last]:
        page.rows[root.last][8] = True
    return page


def _shred(html: str, inspect, levels: int, probes: int = 0) -> tuple[str, str, list[list], list[list[int]]]:
    """Texts and kept elements of a page, and for each probe the indexes of the elements that have it."""
    page = _read(html, inspect, levels)
    elements: list[list] = []
    having: list[list[int]] = [[] for _ in range(probes)]
    around: list[tuple[int, int]] = []  # last position and index of the kept elements around the current one
    for row in filter(None, page.rows):
        while around and around[-1][0] < row[1]:
            around.pop()
        row[0] = [index for _, index in around]
        around.append((row[2], len(elements)))
        for probe in row.pop():
            having[probe].append(len(elements))
        elements.append(row)
    return "".join(page.text), "".join(page.shown), elements, having


def _lists(values: Iterable, kind: pa.DataType, lengths: Iterable[int]) -> pa.ListArray:
    """Lists of the given lengths, cut from one long run of values."""
    offsets = np.concatenate([[0], np.cumsum(np.fromiter(lengths, np.int64))]).astype(np.int32)
    flat = values if isinstance(values, pa.Array) else pa.array(list(values), kind)
    return pa.ListArray.from_arrays(pa.array(offsets), flat)


def _element_array(pages: list[list[tuple]]) -> pa.ListArray:
    """Element lists of pages, built column by column."""
    columns = list(zip(*chain.from_iterable(pages))) or [()] * len(ELEMENT_ARROW)
    arrays = []
    for field, column in zip(ELEMENT_ARROW, columns):
        if pa.types.is_list(field.type):
            arrays.append(_lists(chain.from_iterable(column), field.type.value_type, map(len, column)))
        elif pa.types.is_map(field.type):
            keys = _lists(chain.from_iterable(column), pa.string(), map(len, column))
            items = pa.array(list(chain.from_iterable(map(dict.values, column))), pa.string())
            arrays.append(pa.MapArray.from_arrays(keys.offsets, keys.values, items))
        else:
            arrays.append(pa.array(column, field.type))
    elements = pa.StructArray.from_arrays(arrays, fields=list(ELEMENT_ARROW))
    return _lists(elements, ELEMENT_ARROW, map(len, pages))


def _inspector(probes: list[str] | None, levels: int = 0):
    """What to know of a tag: the probes that it has (None: leave the element out), attributes, if it hides; None for a comment.

    The probe ``<td`` asks for the tag, ``<`` for any element, ``@href`` for the name of an attribute in any case, other
    texts for a literal. A literal counts wherever it
    stands in the start tag, so a probe may report too many elements, never too few. Without probes all are kept.
    """
    tags = {text[1:]: i for i, text in enumerate(probes or ()) if text.startswith("<")}
    names = [(i, text[1:]) for i, text in enumerate(probes or ()) if text.startswith("@")]
    literals = [(i, text) for i, text in enumerate(probes or ()) if text[0] not in "<@"]
    anything = re.compile("|".join(re.escape(text) for _, text in literals)) if literals else None
    always = () if probes is None else (tags.pop(""),) if "" in tags else None
    known: dict[str, _Tag] = {}

    def look(tag: str, source: str) -> tuple:
        plain = entities.unescape(source) if "&" in source else source
        found = always or ()
        if anything is not None and anything.search(plain):
            found += tuple([i for i, text in literals if text in plain])
        if names and source:
            lower = source.lower()
            found += tuple([i for i, name in names if name in lower])
        if tag in tags:
            found += (tags[tag],)
        if not found and always is None and not levels and not MAY_HIDE.search(source):
            return None, None, False
        attrs = _attributes(source) if source else {}
        return found if found or always is not None else None, attrs, _hides(tag, source, attrs)

    def inspect(token: re.Match) -> _Tag | None:
        ended, name, source, closed = token.groups()
        if name is None:
            return None
        if not closed:
            return _CUT_OFF
        name = name.lower()
        answer = _Tag(name, True, None, None, False) if ended else _Tag(name, False, *look(name, source))
        if token.end() - token.start() < LONGEST_KNOWN:
            if len(known) >= KNOWN_TAGS:  # tags that stand once fill it; the frequent ones are soon back
                known.clear()
            known[token.group()] = answer
        return answer

    inspect.known = known
    return inspect


@contextmanager
def _no_collections() -> Iterator[None]:
    """Without searches for garbage in cycles: the many small lists of a batch of pages hold none, and are searched in vain."""
    enabled = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if enabled:
            gc.enable()


def shred(pages: DataFrame, probes: list[str] | None = None, levels: int = 0) -> DataFrame:
    """Replace ``html`` by ``text``, ``shown`` (rendered text) and ``elements``; other columns pass through.

    With ``probes`` only elements that have a probe (and ``levels`` ancestors of each) are kept, which makes the
    arrays of a real page short, and ``having`` lists, for each probe, the indexes of its elements.
    """
    others = [field for field in pages.schema.fields if field.name != "html"]
    names = [field.name for field in others]
    asked = list(probes or ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inspect = _inspector(probes, levels)
        for batch in batches:
            for start in range(0, batch.num_rows, PAGES_PER_BATCH):
                part = batch.slice(start, PAGES_PER_BATCH)
                with _no_collections():
                    found = [_shred(h or "", inspect, levels, len(asked)) for h in part.column("html").to_pylist()]
                made = [
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.string()),
                    _element_array([f[2] for f in found]),
                    _lists(
                        _lists(chain.from_iterable(chain.from_iterable(f[3] for f in found)), pa.int32(),
                               [len(indexes) for f in found for indexes in f[3]]),
                        pa.list_(pa.int32()), [len(asked)] * len(found),
                    ),
                ]
                arrays = [part.column(name) for name in names] + made
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, "text", "shown", "elements", "having"])

    carried = [f"`{field.name}` {field.dataType.simpleString()}" for field in others]
    made = ["text string", "shown string", f"elements array<{ELEMENT_DDL}>", "having array<array<int>>"]
    shredded = pages.select(*names, "html").mapInArrow(run, ", ".join([*carried, *made]))
    return shredded.drop("having") if probes is None else shredded


def slice_text(page_text: Column, element: Column, what: str = "text") -> Column:
    """Subtree text of an element: ``what`` is ``text`` or ``shown``. NULL without an element."""
    return F.substring(page_text, element[f"{what}_at"] + 1, element[f"{what}_len"])


def elements_table(shredded: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per element of each page, for analysis by element."""
    rows = shredded.select(key, "text", F.explode("elements").alias("e"))
    return rows.select(key, F.col("e").dropFields("up").alias("e"), "text").select(key, "e.*", slice_text(F.col("text"), F.col("e")).alias("text"))

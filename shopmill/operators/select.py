"""Selectors as data, matched against the element array of a page by one expression.

A selector is a pair ``(method, text)`` with method ``ID``, ``CSS_SELECTOR`` or ``XPATH``; the small vocabulary
that product pages are read with is understood, anything else raises ``ValueError``. Selectors become a constant
array of steps and tests, and one higher-order expression applies all of them, so the query plan stays small
however many selectors a job has. Nothing leaves the page's row: a descendant step compares positions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from shopmill.functions.columns import blank_to_null, strip
from shopmill.operators.shred import slice_text

Selector = tuple[str, str]
Test = tuple[str, str | None, str | None, bool]  # kind, attribute name, value, negated
Step = tuple[str, list[Test]]  # relation to the step before it, tests

CSS_PART = re.compile(
    r"#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[(?P<attr>[\w-]+)(?:(?P<op>\*?=)(?P<q>[\"'])(?P<value>.*?)(?P=q))?\]"
    r"|:(?P<place>first-child|last-child)|:not\((?P<no>[^()]+)\)|(?P<tag>[\w*-]+)"
)
#: Steps that go on from the elements found before.
NO_PROBE = ("parent", "place", "self")
XPATH_STEP = re.compile(r"(//?)(\.\.|\*|[\w-]+)((?:\[[^\]]*\])*)")
XPATH_TEST = re.compile(
    r"\[(?:@(?P<attr>[\w-]+)=(?P<q>[\"'])(?P<value>.*?)(?P=q)"
    r"|contains\((?:@(?P<part>[\w-]+)|(?P<scope>\.|text\(\))),\s*(?P<p>[\"'])(?P<text>.*?)(?P=p)\)|(?P<nth>\d+))\]"
)



def _css_tests(part: str, negated: bool = False) -> list[Test]:
    tests: list[Test] = []
    at = 0
    for m in CSS_PART.finditer(part):
        if m.start() != at:
            break
        at = m.end()
        if m["id"]:
            tests.append(("id", None, m["id"], negated))
        elif m["cls"]:
            tests.append(("class", None, m["cls"], negated))
        elif m["attr"]:
            kind = {"=": "equals", "*=": "part"}.get(m["op"], "has")
            tests.append((kind, m["attr"].lower(), m["value"], negated))
        elif m["place"]:
            tests.append((m["place"], None, None, negated))
        elif m["no"]:
            tests += _css_tests(m["no"], True)
        elif m["tag"] != "*":
            tests.append(("tag", None, m["tag"].lower(), negated))
    if at != len(part) or (negated and len(tests) != 1):
        raise ValueError(f"selector not understood: {part}")
    return tests


def _xpath_tests(tag: str, tests: str) -> list[Test]:
    found: list[Test] = [] if tag == "*" else [("tag", None, tag.lower(), False)]
    if XPATH_TEST.sub("", tests):
        raise ValueError(f"path test not understood: {tests}")
    for m in XPATH_TEST.finditer(tests):
        if m["attr"]:
            found.append(("equals", m["attr"].lower(), m["value"], False))
        elif m["part"]:
            found.append(("part", m["part"].lower(), m["text"], False))
        elif m["scope"]:
            found.append(("text" if m["scope"] == "." else "own", None, m["text"], False))
        else:
            found.append(("nth", None, m["nth"], False))
    return found


def _placed(relation: str, tests: list[Test]) -> list[Step]:
    """A step of a path; a position after another test counts the elements that are left, so it is a step of its own."""
    steps: list[Step] = []
    now: list[Test] = []
    for test in tests:
        if test[0] != "nth" or not (steps or now):
            # the first test of any element's position counts all children
            now.append(("child-nth", *test[1:]) if test[0] == "nth" else test)
        elif not steps and [kind for kind, *_ in now] == ["tag"]:
            now.append(test)
        else:
            steps += [(relation, now)] if now else []
            steps.append(("place", [test]))
            relation, now = "self", []
    return steps + ([(relation, now)] if now or not steps else [])


def steps_of(selector: Selector) -> list[list[Step]]:
    """Alternatives of a selector, each a chain of steps from the outermost element to the wanted one."""
    method, text = selector
    if method == "ID":
        return [[("first", [("id", None, text, False)])]]
    if method == "CSS_SELECTOR":
        # blanks and commas inside brackets belong to a value
        alternatives = re.split(r",\s*(?![^\[]*\])", text.strip())
        chains = [[_css_tests(part) for part in re.split(r"\s+(?![^\[]*\])", one)] for one in alternatives]
        return [[("first" if i == 0 else "inside", tests) for i, tests in enumerate(chain)] for chain in chains]
    if method == "XPATH":
        if XPATH_STEP.sub("", text):
            raise ValueError(f"path not understood: {text}")
        chain: list[Step] = []
        for slashes, tag, tests in XPATH_STEP.findall(text):
            if tag == "..":
                chain.append(("parent", []))
            else:
                relation = "first" if not chain else "inside" if slashes == "//" else "child"
                chain += _placed(relation, _xpath_tests(tag, tests))
        return [chain]
    raise ValueError(f"unknown selector method: {method}")


def _quote(value: str | None) -> str:
    if value is None:
        return "cast(null as string)"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _probe(tests: list[Test]) -> str:
    """What a start tag must hold to pass the tests: the first that applies of id, class, attribute and tag.

    A value is looked for as it is, the name of an attribute, after ``@``, in any case.
    """
    for kinds in (["id"], ["class"], ["equals", "part", "has"]):
        for kind, name, value, negated in tests:
            if kind in kinds and not negated and value and value[0] not in "<@":
                return value
            if kind in kinds and not negated and name:
                return f"@{name}"
    return "<" + next((value for kind, _, value, negated in tests if kind == "tag" and not negated), "")


def _literal(selector: Selector, probes: list[str]) -> str:
    """A selector as a constant: array of alternatives, each an array of steps."""
    chains = []
    for chain in steps_of(selector):
        steps = []
        for relation, tests in chain:
            items = ", ".join(
                f"named_struct('kind', {_quote(kind)}, 'name', {_quote(name)}, 'value', {_quote(value)}, "
                f"'negated', {str(negated).lower()})"
                for kind, name, value, negated in tests or [("any", None, None, False)]
            )
            probe = -1 if relation in NO_PROBE else probes.index(_probe(tests))
            steps.append(f"named_struct('relation', {_quote(relation)}, 'probe', {probe}, 'tests', array({items}))")
        chains.append(f"array({', '.join(steps)})")
    return f"array({', '.join(chains)})"


# i is the index of an element, t a test. A test on something that the element lacks is false.
_E = "get(elements, i)"
_TEST = f"""coalesce(case t.kind
    when 'class' then array_contains({_E}.classes, t.value)
    when 'id' then {_E}.id = t.value
    when 'tag' then {_E}.tag = t.value
    when 'equals' then try_element_at({_E}.attrs, t.name) = t.value
    when 'part' then contains(try_element_at({_E}.attrs, t.name), t.value)
    when 'has' then map_contains_key({_E}.attrs, t.name)
    when 'text' then contains(substring(text, {_E}.text_at + 1, {_E}.text_len), t.value)
    when 'own' then contains(substring(text, {_E}.own_at + 1, {_E}.own_len), t.value)
    when 'nth' then {_E}.nth = cast(t.value as int)
    when 'child-nth' then {_E}.child = cast(t.value as int)
    when 'first-child' then {_E}.child = 1
    when 'last-child' then {_E}.last_child
    else true end, false) != t.negated"""

# The elements that the step before found are in before; a step back to the parents starts from them. For a place they
# are sorted by parent, so that the first of a parent and the place looked for stand as far apart as the place says.
_PLACED = """get(transform(array(array_sort(transform(before, b ->
        struct(coalesce(get(elements, b).parent_pos, -1) as parent, b as at)))), sorted ->
    transform(filter(sorted, (s, n) -> n + 2 - array_position(sorted.parent, s.parent) = cast(get(step.tests, 0).value as int)),
        s -> s.at)), 0)"""
_CANDIDATES = f"""case step.relation
    when 'parent' then filter(transform(before, b -> try_element_at(get(elements, b).up, -1)), a -> a is not null)
    when 'place' then {_PLACED}
    when 'self' then before
    else get(having, step.probe) end"""
_RELATED = f"""case step.relation
    when 'inside' then exists({_E}.up, a -> array_contains(before, a))
    when 'child' then exists({_E}.up, a -> array_contains(before, a) and get(elements, a).pos = {_E}.parent_pos)
    else true end"""

_HITS = f"""transform(%s, selector -> array_sort(array_distinct(flatten(transform(selector, chain ->
    aggregate(chain, cast(array() as array<int>), (before, step) -> filter(
        {_CANDIDATES}, i -> step.relation = 'place' or forall(step.tests, t -> {_TEST}) and {_RELATED})))))))"""


class SelectorSet:
    """The selectors of one job. ``hits`` fills a column that the other methods read."""

    def __init__(self, *groups: list[Selector]) -> None:
        self.selectors = list(dict.fromkeys(selector for group in groups for selector in group))

        steps = [step for selector in self.selectors for chain in steps_of(selector) for step in chain]
        self.probes = sorted({_probe(tests) for relation, tests in steps if relation not in NO_PROBE})

    def hits(self) -> Column:
        """For each selector the indexes, in document order, of the elements that it matches."""
        return F.expr(_HITS % f"array({', '.join(_literal(selector, self.probes) for selector in self.selectors)})")

    def _places(self, selectors: list[Selector]) -> str:
        return ", ".join(str(self.selectors.index(selector)) for selector in selectors)

    def indexes(self, selector: Selector) -> Column:
        """Indexes of the elements of one selector in document order."""
        return F.expr(f"get(hits, {self._places([selector])})")

    def contained(self, selector: Selector) -> Column:
        """Pairs of an element around (``outer``) and an element of the selector (``inner``), as two arrays."""
        found, up = f"get(hits, {self._places([selector])})", "get(elements, i).up"
        return F.expr(
            f"named_struct('outer', flatten(transform({found}, i -> {up})), "
            f"'inner', flatten(transform({found}, i -> transform({up}, a -> i))))"
        )

    def _first(self, selectors: list[Selector], visible: bool) -> str:
        firsts = f"transform(array({self._places(selectors)}), n -> get(elements, get(get(hits, n), 0)))"
        return f"get(filter({firsts}, e -> {'e.visible' if visible else 'e is not null'}), 0)"

    def first(self, selectors: list[Selector], visible: bool = False) -> Column:
        """Chain: the first selector whose first element exists (and, on request, is visible) gives the element."""
        return F.expr(self._first(selectors, visible))

    def first_text(self, selectors: list[Selector], what: str = "text", visible: bool = False) -> Column:
        """Text of the element that a chain finds: its ``text`` content, or as ``shown``; NULL without an element."""
        piece = f"substring({what}, e.{what}_at + 1, e.{what}_len)"
        return F.expr(f"get(transform(array({self._first(selectors, visible)}), e -> {piece}), 0)")

    def first_attribute(self, selectors: list[Selector], name: str, visible: bool = False) -> Column:
        found = self._first(selectors, visible)
        return F.expr(f"get(transform(array({found}), e -> try_element_at(e.attrs, {_quote(name)})), 0)")

    def first_filled(self, selectors: list[Selector]) -> Column:
        """Chain: all elements of the first selector that has any; an empty array when none has."""
        filled = f"filter(array({self._places(selectors)}), n -> size(get(hits, n)) > 0)"
        indexes = f"coalesce(get(hits, get({filled}, 0)), cast(array() as array<int>))"
        return F.expr(f"transform({indexes}, i -> get(elements, i))")


def element(index: Column) -> Column:
    return F.get("elements", index)


def first_inside(pairs: Column, outer: Column) -> Column:
    """Index of the first element of ``contained`` pairs that lies inside the element with index ``outer``."""
    return F.get(pairs["inner"], (F.array_position(pairs["outer"], outer) - 1).cast("int"))


def safe_text(page_text: Column, element: Column) -> Column:
    """Text content of an element without white space at its ends, NULL when empty."""
    return blank_to_null(strip(slice_text(page_text, element)))


def attribute(element: Column, name: str) -> Column:
    return F.try_element_at(element["attrs"], F.lit(name))

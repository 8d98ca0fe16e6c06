"""Elements of a page as intervals, and selectors on them by interval containment."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Elements without content, and elements that end where one of the same group starts.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
GROUPS = [{"p"}, {"li"}, {"dt", "dd"}, {"tr"}, {"td", "th"}, {"option"}]

TAG = re.compile(r"(?is)<!--.*?-->|<(script|style)\b(?P<raw>[^>]*)>.*?</\1\s*>|<(?P<end>/?)(?P<tag>[a-z][\w:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>")
ATTR = re.compile(r"([\w:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
STEP = re.compile(r"\s*([>,])\s*|\s+|([\w-]+|\*)|#([\w-]+)|\.([\w-]+)|\[\s*([\w:-]+)\s*(?:([*^$]?=)\s*[\"']?([^\"'\]]*)[\"']?\s*)?\]")


def elements(html: str) -> list[tuple]:
    """(start, end, inner start, inner end, tag, attributes) of all elements in page order.

    An element that is never closed ends with the one around it; a closing tag without its opening one is passed over.
    """
    found, stack = [], []

    def close(k: int, inner_end: int, end: int) -> None:
        for i in stack[k:]:
            found[i][3], found[i][1] = inner_end, end if i == stack[k] else inner_end
        del stack[k:]

    for m in TAG.finditer(html):
        if m["raw"] is not None:
            found.append([m.start(), m.end(), m.end(), m.end(), m[1].lower(), _attributes(m["raw"])])
            continue
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            at = next((k for k in range(len(stack) - 1, -1, -1) if found[stack[k]][4] == tag), None)
            if at is not None:
                close(at, m.start(), m.end())
            continue
        group = next((g for g in GROUPS if tag in g), set())
        if stack and found[stack[-1]][4] in group:
            close(len(stack) - 1, m.start(), m.start())
        found.append([m.start(), m.end(), m.end(), m.end(), tag, _attributes(m["attrs"])])
        if tag not in VOID and not m["attrs"].rstrip().endswith("/"):
            stack.append(len(found) - 1)
    if stack:
        close(0, len(html), len(html))
    return [tuple(e) for e in found]


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTR.finditer(text)}


@lru_cache(maxsize=4096)
def parse_selector(selector: str) -> tuple:
    """Alternatives, each a tuple of (direct child?, tests); a test is (kind, name, value). Unknown syntax gives no alternative."""
    out, chain, tests, child, at = [], [], [], False, 0
    text = selector.strip()
    while at < len(text):
        m = STEP.match(text, at)
        if not m or m.end() == at:
            return ()
        at, (mark, tag, ident, name, attr, op, value) = m.end(), m.groups()
        if tag or ident or name or attr:
            tests.append(("tag", tag.lower(), "") if tag else ("id", ident, "") if ident else ("class", name, "") if name else ("attr" + (op or ""), attr.lower(), value or ""))
            continue
        if tests:
            chain.append((child, tuple(tests)))
            tests, child = [], False
        if mark == ">":
            child = True
        elif mark == ",":
            out.append(tuple(chain))
            chain = []
    if tests:
        chain.append((child, tuple(tests)))
    return tuple(c for c in (*out, tuple(chain)) if c)


def _passes(element: tuple, tests: tuple) -> bool:
    tag, attrs = element[4], element[5]
    for kind, name, value in tests:
        given = attrs.get(name)
        ok = {"tag": name in ("*", tag), "id": attrs.get("id") == name, "class": name in attrs.get("class", "").split(), "attr": given is not None, "attr=": given == value,
              "attr*=": given is not None and value in given, "attr^=": given is not None and given.startswith(value), "attr$=": given is not None and given.endswith(value)}[kind]
        if not ok:
            return False
    return True


def _holds(page: list[tuple], at: int, chain: tuple) -> bool:
    """Whether the element at place ``at`` ends ``chain``: each earlier step is an element around it, the nearest one for >."""
    if not _passes(page[at], chain[-1][1]):
        return False
    if len(chain) == 1:
        return not chain[0][0]
    around = [k for k in range(at - 1, -1, -1) if page[k][0] < page[at][0] and page[at][1] <= page[k][3]]
    return any(_holds(page, k, chain[:-1]) for k in (around[:1] if chain[-1][0] else around))


def first_match(page: list[tuple], selectors) -> tuple | None:
    """The first element in page order of the first selector that has any."""
    for selector in selectors or ():
        chains = parse_selector(selector or "")
        for at in range(len(page)):
            if any(_holds(page, at, chain) for chain in chains):
                return page[at]
    return None


@F.arrow_udf(StringType())
def _inner_html(html: pa.Array, selectors: pa.Array) -> pa.Array:
    out = []
    for page, wanted in zip(html, selectors):
        found = first_match(elements(page.as_py()), wanted.as_py()) if page.is_valid and wanted.is_valid else None
        out.append(None if found is None else page.as_py()[found[2]:found[3]])
    return pa.array(out, pa.string())


def select_first(html, selectors) -> Column:
    """Inner HTML of the first element that a page's own list of selectors finds; null without one.

    Tags, ids, classes, attributes (=, *=, ^=, $=), descendants, children and commas. Pages without selectors are not sent to Python.
    """
    html, selectors = (F.col(c) if isinstance(c, str) else c for c in (html, selectors))
    wanted = F.filter(F.coalesce(selectors, F.array().cast("array<string>")), lambda s: F.coalesce(F.trim(s), F.lit("")) != "")
    return _inner_html(F.when(F.size(wanted) > 0, html), F.when(F.size(wanted) > 0, wanted))

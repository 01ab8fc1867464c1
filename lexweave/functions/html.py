"""HTML fragments: what stands between the tags."""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

#: A tag, comment or declaration. An attribute value in quotes may hold "<" and ">"; a "<" that starts no complete tag is
#: text. Outside quotes no tag reaches over another "<", so the search is linear.
TAG = re.compile(r"<!--.*?-->|<(/?)([a-zA-Z][^ \t\n\x0b\f\r/<>]*)((?:\"[^\"]*\"|'[^']*'|[^'\"<>])*)>|<[!?][^<>]*>", re.S)
#: The same for Java, without groups that could nest on the stack: what follows the name is taken without going back,
#: which changes nothing, since each of its parts starts with a character that none of the others starts with.
TAG_JAVA = r"(?s)<!--.*?-->|</?[a-zA-Z][^\s/<>]*(?:\"[^\"]*\"|'[^']*'|[^'\"<>]++)*+>|<[!?][^<>]*>"
#: Elements that limit a block of text.
BLOCKS = frozenset(
    "p br li tr td th ul ol dl dt dd div table thead tbody tfoot caption h1 h2 h3 h4 h5 h6 hr section article header footer blockquote pre figure address form fieldset".split()
)


def segments(fragment: str, tables: bool = True) -> Iterator[tuple[str, str]]:
    """Pairs (kind, text) in order: "text" with character references read, "block" or "inline" for each tag.

    With tables=False what lies in a table, nested ones included, is left out; an end tag without a table is ignored and
    a table that isn't closed runs to the end.
    """
    at = depth = 0
    for m in TAG.finditer(fragment):
        if m.start() > at and not depth:
            yield "text", _html.unescape(fragment[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not tables and name == "table":
            if m[1]:
                depth = max(0, depth - 1)
            elif not m[3].rstrip().endswith("/"):
                depth += 1
        yield ("block" if name in BLOCKS else "inline"), ""
    if at < len(fragment) and not depth:
        yield "text", _html.unescape(fragment[at:])

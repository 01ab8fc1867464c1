"""One pass over an XML document with expat: labelled nodes, header fields and texts.

expat knows the encodings a declaration or byte order mark may name and decides what is well-formed; elements are told
apart by local name, so prefixes don't matter. No recursion: depth is bounded by memory only.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from xml.parsers import expat

DC = "http://purl.org/dc/elements/1.1/"


@dataclass
class Node:
    """An element that is kept: its Dewey label (ordinals among kept siblings, from the root) and its own content."""

    label: tuple[int, ...]
    tag: str
    schema: str
    attributes: dict[str, str]
    title: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    children: int = 0


@dataclass
class Document:
    """What `parse` found. `headers` maps the local names of the root's children in the DC namespace to their texts."""

    nodes: list[Node] = field(default_factory=list)
    headers: dict[str, list[str]] = field(default_factory=dict)
    body: list[tuple[str, str]] = field(default_factory=list)
    root: dict[str, str] = field(default_factory=dict)


def parse(xml: bytes, keep: Iterable[str] = (), within: Iterable[str] = (), body: Iterable[str] = (), inline: Iterable[str] = (), content: bool = True) -> Document | None:
    """Reads a document; None if it isn't well-formed or null.

    keep: names of the elements that become nodes, where they are, or lie inside, a direct child of the root named in
    `within` (empty: anywhere below the root). A node's text is what lies in it outside deeper nodes and outside its
    own `Titre`, which gives its title; content=False leaves both out. body: names of direct children of the root whose
    whole text is collected as pairs (kind, text): "text", and "block" or "inline" for the tags between; elements named
    in `inline` don't limit a block. Comments and processing instructions give nothing, CDATA counts as text.
    """
    if xml is None:
        return None
    doc = Document()
    keep, within, body, inline = frozenset(keep), frozenset(within), frozenset(body), frozenset(inline)
    parser = expat.ParserCreate(namespace_separator=" ")
    parser.buffer_text = True
    depth, inside, taking, header = 0, False, False, None
    stack: list[Node | None] = []  # one entry per open element, None if it isn't kept
    open_nodes: list[Node] = []
    title_at, counter = 0, [0]

    def start(name: str, attributes: dict[str, str]) -> None:
        nonlocal depth, inside, taking, header, title_at
        depth += 1
        uri, _, local = name.rpartition(" ")
        if depth == 1:
            doc.root = dict(attributes)
        elif depth == 2:
            inside = uri != DC and (not within or local in within)
            taking = uri != DC and local in body
            if uri == DC:
                header = doc.headers.setdefault(local, [])
                header.append("")
        if taking:
            doc.body.append(("inline" if local in inline else "block", ""))
        node = None
        if inside and local in keep and uri != DC:
            if open_nodes:
                parent = open_nodes[-1]
                parent.children += 1
                node = Node((*parent.label, parent.children), local, f"{parent.schema}/{local}", attributes)
            else:
                counter[0] += 1
                node = Node((counter[0],), local, local, attributes)
            open_nodes.append(node)
            doc.nodes.append(node)
        elif content and not title_at and local == "Titre" and stack and stack[-1] is not None:
            title_at = depth
        stack.append(node)

    def end(_: str) -> None:
        nonlocal depth, inside, taking, header, title_at
        if stack.pop() is not None:
            open_nodes.pop()
        if taking:
            doc.body.append(("inline" if _.rpartition(" ")[2] in inline else "block", ""))
        if depth == title_at:
            title_at = 0
        if depth == 2:
            inside, taking, header = False, False, None
        depth -= 1

    def data(text: str) -> None:
        if header is not None:
            header[-1] += text
        if taking:
            doc.body.append(("text", text))
        if content and open_nodes:
            (open_nodes[-1].title if title_at else open_nodes[-1].text).append(text)

    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = data
    try:
        parser.Parse(bytes(xml), True)
    except (expat.ExpatError, ValueError, LookupError):
        return None
    return doc

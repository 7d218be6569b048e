"""Rules that cut one text into chunks. Plain functions of strings, used inside Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np

BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0              　﻿"


def trim(text: str) -> str:
    return text.strip(BLANKS)


# Separators -----------------------------------------------------------------

#: The separators of each language, strongest first.
SEPARATORS: dict[str, list[str]] = {
    "cpp": ["\nclass ", "\nvoid ", "\nint ", "\nfloat ", "\ndouble ", "\nif ", "\nfor ", "\nwhile ", "\nswitch ", "\ncase ", "\n\n", "\n", " ", ""],
    "go": ["\nfunc ", "\nvar ", "\nconst ", "\ntype ", "\nif ", "\nfor ", "\nswitch ", "\ncase ", "\n\n", "\n", " ", ""],
    "java": ["\nclass ", "\npublic ", "\nprotected ", "\nprivate ", "\nstatic ", "\nif ", "\nfor ", "\nwhile ", "\nswitch ", "\ncase ", "\n\n", "\n", " ", ""],
    "js": ["\nfunction ", "\nconst ", "\nlet ", "\nvar ", "\nclass ", "\nif ", "\nfor ", "\nwhile ", "\nswitch ", "\ncase ", "\ndefault ", "\n\n", "\n", " ", ""],
    "php": ["\nfunction ", "\nclass ", "\nif ", "\nforeach ", "\nwhile ", "\ndo ", "\nswitch ", "\ncase ", "\n\n", "\n", " ", ""],
    "proto": ["\nmessage ", "\nservice ", "\nenum ", "\noption ", "\nimport ", "\nsyntax ", "\n\n", "\n", " ", ""],
    "python": ["\nclass ", "\ndef ", "\n\tdef ", "\n\n", "\n", " ", ""],
    "rst": ["\n===\n", "\n---\n", "\n***\n", "\n.. ", "\n\n", "\n", " ", ""],
    "ruby": ["\ndef ", "\nclass ", "\nif ", "\nunless ", "\nwhile ", "\nfor ", "\ndo ", "\nbegin ", "\nrescue ", "\n\n", "\n", " ", ""],
    "rust": ["\nfn ", "\nconst ", "\nlet ", "\nif ", "\nwhile ", "\nfor ", "\nloop ", "\nmatch ", "\n\n", "\n", " ", ""],
    "scala": ["\nclass ", "\nobject ", "\ndef ", "\nval ", "\nvar ", "\nif ", "\nfor ", "\nwhile ", "\nmatch ", "\ncase ", "\n\n", "\n", " ", ""],
    "swift": ["\nfunc ", "\nclass ", "\nstruct ", "\nenum ", "\nif ", "\nfor ", "\nwhile ", "\ndo ", "\nswitch ", "\ncase ", "\n\n", "\n", " ", ""],
    "markdown": ["\n## ", "\n### ", "\n#### ", "\n##### ", "\n###### ", "```\n\n", "\n\n***\n\n", "\n\n---\n\n", "\n\n___\n\n", "\n\n", "\n", " ", ""],
    "latex": ["\n\\chapter{", "\n\\section{", "\n\\subsection{", "\n\\subsubsection{", "\n\\begin{enumerate}", "\n\\begin{itemize}", "\n\\begin{description}", "\n\\begin{list}", "\n\\begin{quote}", "\n\\begin{quotation}", "\n\\begin{verse}", "\n\\begin{verbatim}", "\n\\begin{align}", "$$", "$", "\n\n", "\n", " ", ""],
    "html": ["<body>", "<div>", "<p>", "<br>", "<li>", "<h1>", "<h2>", "<h3>", "<h4>", "<h5>", "<h6>", "<span>", "<table>", "<tr>", "<td>", "<th>", "<ul>", "<ol>", "<header>", "<footer>", "<nav>", "<head>", "<style>", "<script>", "<meta>", "<title>", " ", ""],
    "sol": ["\npragma ", "\nusing ", "\ncontract ", "\ninterface ", "\nlibrary ", "\nconstructor ", "\ntype ", "\nfunction ", "\nevent ", "\nmodifier ", "\nerror ", "\nstruct ", "\nenum ", "\nif ", "\nfor ", "\nwhile ", "\ndo while ", "\nassembly ", "\n\n", "\n", " ", ""],
}
LANGUAGES = sorted(SEPARATORS)
#: Separators of text in no particular language.
_TAIL = ["\n\n", "\n", " ", ""]


def separators_for(language: str) -> list[str]:
    """Separators of a programming or markup language, strongest first."""
    if language not in SEPARATORS:
        raise ValueError(f"unknown language: {language}")
    return list(SEPARATORS[language])


# Character splitting ----------------------------------------------------------


@dataclass(frozen=True)
class CharacterRules:
    """Chunks of about ``size`` with ``overlap``, cut at one separator."""

    size: int = 1000
    overlap: int = 200
    separator: str = "\n\n"
    keep_separator: bool = False
    length: Callable[[str], int] = len

    def __post_init__(self):
        if self.overlap >= self.size:
            raise ValueError("the overlap must be smaller than the chunk size")

    def split(self, text: str) -> list[str]:
        return self.merge(self.pieces(text, self.separator), "" if self.keep_separator else self.separator)

    def pieces(self, text: str, separator: str) -> Sequence[str]:
        """The text cut at a separator, which leads its piece if it is kept; no empty pieces. Without a separator the text itself stands for its characters."""
        if not separator:
            return text
        cut = text.split(separator)
        if self.keep_separator:
            cut = [cut[0], *(separator + x for x in cut[1:])]
        return [x for x in cut if x]

    def merge(self, pieces: Sequence[str], separator: str) -> list[str]:
        """Pieces joined greedily up to the size; each chunk begins with the last pieces of the one before it.

        The overlap is measured without separators, and a piece longer than a chunk stays whole.
        Sums of lengths rise from piece to piece, so the end of a chunk and the start of the next one
        are searched for in them: a step for each chunk, not for each piece.
        """
        count, gap = len(pieces), len(separator)
        if not count:
            return []
        each = np.ones(count, np.int64) if isinstance(pieces, str) and self.length is len else np.fromiter(map(self.length, pieces), np.int64, count)
        upto = np.concatenate(([0], np.cumsum(each)))
        spaced = upto + gap * np.arange(count + 1)  # the length before a piece with all separators before it
        full = spaced[1:] - gap  # the length with a piece, by the separators before it
        chunks: list[str] = []
        start = end = 0
        while True:
            end = max(end + 1, int(np.searchsorted(full, self.size + spaced[start], "right")))
            part = pieces[start:end]
            chunks.append(trim(part if isinstance(part, str) and not separator else separator.join(part)))
            if end >= count:
                return [c for c in chunks if c]
            small = np.searchsorted(upto, upto[end] - self.overlap)
            fitting = min(np.searchsorted(spaced, full[end] - self.size), np.searchsorted(upto, upto[end]))
            start = max(start, int(small), int(fitting))

@dataclass(frozen=True)
class RecursiveRules(CharacterRules):
    """Chunks cut at the strongest separator that a text has, and at weaker ones where a piece is still too long."""

    separators: tuple[str, ...] = tuple(_TAIL)
    keep_separator: bool = True

    @classmethod
    def from_language(cls, language: str, **options) -> RecursiveRules:
        return cls(separators=tuple(separators_for(language)), **options)

    def split(self, text: str) -> list[str]:
        return self._split(text, list(self.separators))

    def _split(self, text: str, separators: list[str]) -> list[str]:
        at = next((k for k, s in enumerate(separators) if s in text), len(separators) - 1)
        separator, weaker = separators[at], separators[at + 1 :] if separators[at] else []
        joint = "" if self.keep_separator else separator
        if not separator and self.length is len and self.size > 1:  # every character fits
            return self.merge(text, "")
        chunks: list[str] = []
        fitting: list[str] = []
        for piece in self.pieces(text, separator):
            if self.length(piece) < self.size:
                fitting.append(piece)
                continue
            chunks += self.merge(fitting, joint) if fitting else []
            fitting = []
            chunks += self._split(piece, weaker) if weaker else [piece]
        return chunks + (self.merge(fitting, joint) if fitting else [])


def token_windows(n: int, size: int, overlap: int) -> int:
    """How many windows of ``size`` with ``overlap`` cover n characters."""
    return 0 if n == 0 else 1 if n <= size else 1 + -(-(n - size) // (size - overlap))


# Markdown headings --------------------------------------------------------------

_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
HEADINGS = (("#", "Header 1"), ("##", "Header 2"), ("###", "Header 3"))


@dataclass(frozen=True)
class MarkdownRules:
    """Paragraphs by the headings above them, joined where the headings are the same."""

    headings: tuple[tuple[str, str], ...] = HEADINGS
    each_line: bool = False
    strip_headings: bool = True

    def split(self, text: str) -> list[tuple[str, dict[str, str]]]:
        markers = sorted(self.headings, key=lambda h: -len(h[0]))
        blocks: list[tuple[str, dict[str, str]]] = []
        lines: list[str] = []
        scope: list[tuple[int, str, str]] = []
        above: dict[str, str] = {}
        fence = ""

        def close() -> None:
            if lines:
                blocks.append(("\n".join(lines), dict(above)))
                lines.clear()

        for raw in text.split("\n"):
            line = _CONTROL.sub("", trim(raw))
            if not fence:
                fence = next((f for f in ("```", "~~~") if line.startswith(f) and line.count(f) == 1), "")
                opened = bool(fence)
            else:
                opened = False
                if line == fence:
                    fence = ""
                    lines.append(line)
                    continue
            if fence or opened:
                lines.append(line)
                continue
            found = next((h for h in markers if line.startswith(h[0]) and (len(line) == len(h[0]) or line[len(h[0])] == " ")), None)
            if found:
                marker, name = found
                level, title = marker.count("#"), trim(line[len(marker) :])
                close()
                while scope and scope[-1][0] >= level:
                    scope.pop()
                scope.append((level, name, title))
                above = {n: t for _, n, t in scope}
                if not self.strip_headings:
                    lines.append(line)
            elif line:
                lines.append(line)
            else:
                close()
        close()
        return blocks if self.each_line else self._joined(blocks)

    def _joined(self, blocks: list[tuple[str, dict[str, str]]]) -> list[tuple[str, dict[str, str]]]:
        out: list[tuple[str, dict[str, str]]] = []
        for content, above in blocks:
            if out and out[-1][1] == above:
                out[-1] = (out[-1][0] + "  \n" + content, above)
            elif out and not self.strip_headings and len(out[-1][1]) < len(above) and out[-1][0].split("\n")[-1].startswith("#"):
                out[-1] = (out[-1][0] + "  \n" + content, above)
            else:
                out.append((content, above))
        return out


# HTML headings ------------------------------------------------------------------

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


@dataclass
class Node:
    tag: str
    depth: int
    texts: list[str] = field(default_factory=list)
    children: list[Node] = field(default_factory=list)


class _Tree(HTMLParser):
    """A forgiving tree: void elements have no content, a block closes an open paragraph, stray end tags are ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", 0)
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in _CLOSES_P and any(n.tag == "p" for n in self.open):
            self.handle_endtag("p")
        if tag in ("li", "td", "th", "tr", "option") and self.open[-1].tag == tag:
            self.open.pop()
        node = Node(tag, len(self.open))
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and self.open[-1].tag == tag:
            self.open.pop()

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.open[-1].texts.append(data)


def parse_html(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def _walk(node: Node):
    """Elements in document order, without recursion."""
    todo = [node]
    while todo:
        node = todo.pop()
        yield node
        todo += reversed(node.children)


@dataclass(frozen=True)
class HtmlRules:
    """Texts of elements by the headings above them; every heading is a chunk of its own."""

    headings: tuple[tuple[str, str], ...] = tuple((f"h{k}", f"Header {k}") for k in range(1, 7))
    each_element: bool = False

    def split(self, html: str) -> list[tuple[str, dict[str, str]]]:
        names = dict(self.headings)
        root = parse_html(html)
        body = next((n for n in _walk(root) if n.tag == "body"), root)
        out: list[tuple[str, dict[str, str]]] = []
        lines: list[str] = []
        active: dict[str, tuple[str, int, int]] = {}  # name: (text, level, depth)

        def close() -> None:
            text = "  \n".join(x for x in lines if trim(x))
            if text:
                out.append((text, {n: t for n, (t, _, _) in active.items()}))
            lines.clear()

        for node in _walk(body):
            text = " ".join(x for x in (trim(t) for t in node.texts) if x)
            if not text:
                continue
            if node.tag in names:
                close()
                level = int(node.tag[1:]) if node.tag[1:].isdigit() else 9999
                active = {n: x for n, x in active.items() if x[1] < level}
                active[names[node.tag]] = (text, level, node.depth)
                out.append((text, {n: t for n, (t, _, _) in active.items()}))
                continue
            active = {n: x for n, x in active.items() if x[2] <= node.depth}
            if self.each_element:
                out.append((text, {n: t for n, (t, _, _) in active.items()}))
            else:
                lines.append(text)
        close()
        return out


# JSON -----------------------------------------------------------------------------


def _ordered(value):
    """Objects with the keys that are array indexes first, in their order; whole floats as integers."""
    if isinstance(value, dict):
        index = [k for k in value if k == "0" or k.isascii() and k.isdigit() and k[0] != "0" and int(k) < 2**32 - 1]
        return {k: _ordered(value[k]) for k in [*sorted(index, key=int), *(k for k in value if k not in set(index))]}
    if isinstance(value, list):
        return [_ordered(x) for x in value]
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        return int(value)
    return value


def to_json(value, indent: int | None = None) -> str:
    """JSON text as a browser writes it."""
    if isinstance(value, dict | list) and not value:
        return "{}" if isinstance(value, dict) else "[]"
    return json.dumps(_ordered(value), ensure_ascii=False, indent=indent, separators=(",", ": " if indent else ":"))


def _arrays_as_objects(value):
    if isinstance(value, list):
        return {str(k): _arrays_as_objects(x) for k, x in enumerate(value)}
    if isinstance(value, dict):
        return {k: _arrays_as_objects(x) for k, x in value.items()}
    return value


@dataclass(frozen=True)
class JsonRules:
    """Objects of about ``most`` characters that keep each value at its path."""

    most: int = 2000
    least: int | None = None

    def split(self, text: str) -> list[str]:
        try:
            value = json.loads(text)
        except ValueError as e:
            raise ValueError(f"Invalid JSON: {e}") from e
        return [to_json(x, 2) for x in self.split_value(value)]

    def split_value(self, value) -> list[dict]:
        least = self.least if self.least is not None else max(self.most - 200, 50)
        chunks: list[dict] = [{}]
        size = 2  # of the last chunk as text, kept while it grows

        def put(path: list[str], x) -> None:
            nonlocal size
            at, (*above, name) = chunks[-1], path or ["undefined"]
            for key in above:
                if key not in at:
                    size += len(to_json(key)) + 3 + bool(at)
                    at[key] = {}
                at = at[key]
            size += len(to_json(name)) + 1 + bool(at) + len(to_json(x))
            at[name] = x

        def place(x, path: list[str]) -> None:
            nonlocal size
            if not isinstance(x, dict):
                put(path, x)
                return
            for key, child in _ordered(x).items():
                if len(to_json({key: child})) < self.most - size:
                    put([*path, key], child)
                else:
                    if size > least:
                        chunks.append({})
                        size = 2
                    place(child, [*path, key])

        place(_arrays_as_objects(value), [])
        return chunks

"""Parsers of one file's content, used inside Arrow batches: bytes or text in, (content, metadata) rows out."""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Callable
from dataclasses import dataclass
from html.parser import HTMLParser
from xml.etree import ElementTree

from scriptorium.operators.splitting import to_json, trim

Parsed = list[tuple[str, dict[str, str]]]


# CSV ---------------------------------------------------------------------------


def read_csv(text: str, separator: str = ",") -> tuple[list[str], list[list[str]]]:
    """Header and rows, all text; lines without anything are skipped."""
    rows = [r for r in csv.reader(io.StringIO(text), delimiter=separator) if r]
    return (rows[0], rows[1:]) if rows else ([], [])


def csv_rows(text: str, separator: str = ",", source_column: str | None = None, metadata_columns: tuple[str, ...] = ()) -> Parsed:
    """A document for each row as wide as the header, ``header: value`` by line; rows of another width only take a number."""
    header, rows = read_csv(text, separator)
    out: Parsed = []
    for number, row in enumerate(rows, 1):
        if len(row) != len(header):
            continue
        record = dict(zip(header, row, strict=True))
        content = "\n".join(f"{h}: {record[h]}" for h in header if h not in metadata_columns and h != source_column)
        meta = {c: record[c] for c in metadata_columns if c in record}
        if source_column and record.get(source_column):
            meta["source"] = record[source_column]
        out.append((content, meta | {"row": str(number), "format": "csv"}))
    return out


def markdown_table(header: list[str], rows: list[list[str]]) -> str:
    """A table whose columns are as wide as their longest cell."""
    widths = [max(len(h), *(len(r[k]) if k < len(r) else 0 for r in rows)) if rows else len(h) for k, h in enumerate(header)]
    line = lambda cells: "| " + " | ".join(c.ljust(widths[k]) if k < len(widths) else c for k, c in enumerate(cells)) + " |"
    return "\n".join([line(header), "| " + " | ".join("-" * w for w in widths) + " |", *(line(r) for r in rows)])


def csv_table(text: str, separator: str = ",") -> Parsed:
    header, rows = read_csv(text, separator)
    return [(markdown_table(header, rows), {"format": "csv", "rows": str(len(rows)), "columns": str(len(header))})] if header else []


# JSON --------------------------------------------------------------------------


def _as_text(value) -> str:
    if isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    return "null" if value is None else to_json(value)


def json_at(value, path: str):
    """The value at a dotted path; ``name[]`` says that it is an array there."""
    for part in path.removeprefix(".").split("."):
        name, is_array = (part[:-2], True) if part.endswith("[]") else (part, False)
        if name:
            if isinstance(value, dict) and name in value:
                value = value[name]
            elif isinstance(value, list) and name.isdigit() and int(name) < len(value):
                value = value[int(name)]
            else:
                raise ValueError(f"Path not found: {path}")
        if is_array and not isinstance(value, list):
            raise ValueError(f"Not an array: {part}")
    return value


def json_documents(text: str, path: str | None = None, content_key: str | None = None, metadata_keys: tuple[str, ...] = (), pretty: bool = True) -> Parsed:
    """One document for the whole value, or one for each element of the array at ``path``."""
    value = json.loads(text)
    indent = 2 if pretty else None
    if path is None:
        return [(_as_text(value) if isinstance(value, str) else to_json(value, indent), {"format": "json"})]
    found = json_at(value, path)
    out: Parsed = []
    for k, item in enumerate(found if isinstance(found, list) else [found]):
        meta: dict[str, str] = {}
        if isinstance(item, dict | list):
            item = item if isinstance(item, dict) else {str(i): x for i, x in enumerate(item)}
            meta = {m: _as_text(item[m]) for m in metadata_keys if m in item}
            rest = {x: y for x, y in item.items() if x not in metadata_keys}
            content = (_as_text(rest[content_key]) if content_key in rest else "") if content_key else to_json(rest, indent)
        else:
            content = _as_text(item)
        out.append((content, meta | ({"format": "json"} if not isinstance(found, list) else {"format": "json", "index": str(k)})))
    return out


# HTML to Markdown -----------------------------------------------------------------

_SILENT = frozenset("script style nav footer header aside noscript template head title".split())
_BLOCK = frozenset("p div section article main body html ul ol table thead tbody tr blockquote pre h1 h2 h3 h4 h5 h6 li form figure dl dt dd hr".split())


class _Markdown(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.silent = 0
        self.lists: list[list] = []
        self.pre = 0
        self.links: list[str] = []
        self.cells: list[str] | None = None
        self.rows: list[list[str]] = []

    def _put(self, text: str) -> None:
        if self.cells is not None and self.cells:
            self.cells[-1] += text
        else:
            self.out.append(text)

    def handle_starttag(self, tag, attrs):
        if tag in _SILENT:
            self.silent += 1
        if self.silent:
            return
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self._put("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self._put("\n\n" if len(self.lists) == 1 else "")
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self._put("\n" + "    " * (len(self.lists) - 1) + ("- " if kind[0] == "ul" else f"{kind[1]}. "))
        elif tag in ("b", "strong"):
            self._put("**")
        elif tag in ("i", "em"):
            self._put("*")
        elif tag == "pre":
            self.pre += 1
            self._put("\n\n```\n")
        elif tag == "code" and not self.pre:
            self._put("`")
        elif tag == "br":
            self._put("  \n")
        elif tag == "hr":
            self._put("\n\n* * *\n\n")
        elif tag == "a":
            self.links.append(dict(attrs).get("href") or "")
            self._put("[")
        elif tag == "img":
            a = dict(attrs)
            self._put(f"![{a.get('alt') or ''}]({a.get('src') or ''})")
        elif tag == "table":
            self.rows = []
        elif tag == "tr":
            self.cells = []
        elif tag in ("td", "th") and self.cells is not None:
            self.cells.append("")
        elif tag in _BLOCK:
            self._put("\n\n")

    def handle_endtag(self, tag):
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
            return
        if self.silent:
            return
        if tag in ("b", "strong"):
            self._put("**")
        elif tag in ("i", "em"):
            self._put("*")
        elif tag == "pre":
            self.pre = max(0, self.pre - 1)
            self._put("\n```\n\n")
        elif tag == "code" and not self.pre:
            self._put("`")
        elif tag == "a" and self.links:
            self._put(f"]({self.links.pop()})")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self._put("\n\n" if not self.lists else "")
        elif tag == "tr" and self.cells is not None:
            self.rows.append([trim(re.sub(r"\s+", " ", c)) for c in self.cells])
            self.cells = None
        elif tag == "table" and self.rows:
            head, *rest = self.rows
            lines = ["| " + " | ".join(head) + " |", "| " + " | ".join("---" for _ in head) + " |", *("| " + " | ".join(r) + " |" for r in rest)]
            self.out.append("\n\n" + "\n".join(lines) + "\n\n")
        elif tag in _BLOCK and tag != "li":
            self._put("\n\n")

    def handle_data(self, data):
        if not self.silent:
            self._put(data if self.pre else re.sub(r"\s+", " ", data))


def html_to_markdown(html: str) -> str:
    """Markdown of a page: ATX headings, fenced code, ``-`` lists, ``*`` emphasis, tables; no scripts, styles or page furniture."""
    parser = _Markdown()
    parser.feed(html)
    parser.close()
    text = re.sub(r"[ \t]+\n(?! )", lambda m: m.group() if m.group() == "  \n" else "\n", "".join(parser.out))
    return trim(re.sub(r"\n[ ]*\n\s*\n", "\n\n", re.sub(r"(?m)^ (?=\S)", "", text)))


HTML_TAGS = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "article", "section")


def elements(page: str, tags: tuple[str, ...] = HTML_TAGS) -> list[dict]:
    """(tag, position, inner) of the elements, tag by tag; an element reaches to the first end tag of its name.

    Tags of all names are found in one pass.
    """
    found: dict[str, list[dict]] = {t: [] for t in tags}
    opened: dict[str, tuple[int, int]] = {}
    for m in re.finditer(rf"(?i)<(/?)({'|'.join(tags)})\b", page):
        tag = m[2].lower()
        if not m[1]:
            end = page.find(">", m.end())
            if tag not in opened and end >= 0:
                opened[tag] = m.start(), end + 1
        elif tag in opened and m.start() >= opened[tag][1] and page[m.end() : m.end() + 1] == ">":
            start, inner = opened.pop(tag)
            found[tag].append({"tag": tag, "position": start, "inner": page[inner : m.start()]})
    return [e for t in tags for e in found[t]]


# Office -------------------------------------------------------------------------

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def docx_text(content: bytes) -> Parsed:
    """The paragraphs of a DOCX file, headings as Markdown; no document if there is no text."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    paragraphs = []
    for p in body.iter(f"{_W}p"):
        text = "".join({"t": n.text or "", "tab": "\t", "br": "\n"}.get(n.tag.removeprefix(_W), "") for n in p.iter())
        style = p.find(f"{_W}pPr/{_W}pStyle")
        level = re.fullmatch(r"[Hh]eading\s?([1-6])", style.get(f"{_W}val", "")) if style is not None else None
        paragraphs.append("#" * int(level[1]) + " " + text if level and text else text)
    whole = "\n\n".join(x for x in paragraphs if x)
    return [(whole, {"format": "docx", "convertedBy": "docx-xml"})] if trim(whole) else []


def xlsx_sheets(content: bytes) -> list[tuple[str, list[list[str]]]]:
    """(name, rows of cell texts) of each sheet, empty rows left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_S}si")]
        targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
            path = targets[sheet.get(f"{_R}id")]
            root = ElementTree.fromstring(z.read(path.lstrip("/") if path.startswith("/") else f"xl/{path}"))
            rows = []
            for row in root.iter(f"{_S}row"):
                cells: dict[int, str] = {}
                for k, c in enumerate(row.findall(f"{_S}c")):
                    letters = re.match(r"[A-Z]*", c.get("r", ""))[0]
                    at = k
                    if letters:
                        at = 0
                        for x in letters:
                            at = at * 26 + ord(x) - 64
                        at -= 1
                    v = c.find(f"{_S}v")
                    if c.get("t") == "inlineStr":
                        text = "".join(t.text or "" for t in c.iter(f"{_S}t"))
                    elif v is None or v.text is None:
                        continue
                    else:
                        text = shared[int(v.text)] if c.get("t") == "s" else {"1": "TRUE", "0": "FALSE"}[v.text] if c.get("t") == "b" else v.text
                    cells[at] = text
                if cells:
                    rows.append([cells.get(k, "") for k in range(max(cells) + 1)])
            out.append((sheet.get("name", ""), rows))
    return out


def xlsx_documents(content: bytes, split_rows: bool = False, sheet: str | None = None, source_column: str | None = None, metadata_columns: tuple[str, ...] = ()) -> Parsed:
    """CSV of each sheet, or a document for each row under the first one."""
    out: Parsed = []
    for name, rows in xlsx_sheets(content):
        if sheet is not None and name != sheet or not rows:
            continue
        if not split_rows:
            buffer = io.StringIO()
            csv.writer(buffer, lineterminator="\n").writerows(rows)
            out.append((buffer.getvalue().rstrip("\n"), {"format": "xlsx", "sheet": name, "convertedBy": "xlsx-xml"}))
            continue
        header = rows[0]
        for k, row in enumerate(rows[1:]):
            record = dict(zip(header, [*row, *["undefined"] * len(header)], strict=False))
            text = "\n".join(f"{h}: {record[h]}" for h in header if h not in metadata_columns and h != source_column)
            meta = {c: record[c] for c in metadata_columns if c in record}
            if source_column and record.get(source_column):
                meta["source"] = record[source_column]
            out.append((text, meta | {"format": "xlsx", "sheet": name, "row": str(k + 2)}))
    return out


# Formats that need a service -----------------------------------------------------


@dataclass(frozen=True)
class Providers:
    """Callers' own converters for formats without a parser here: bytes in, (content, metadata) rows out."""

    pdf: Callable[[bytes], Parsed] | None = None
    doc: Callable[[bytes], Parsed] | None = None
    xls: Callable[[bytes], Parsed] | None = None
    #: Pages of images: bytes in, (page, status, text) rows out.
    ocr: Callable[[bytes], list[tuple[int, str, str | None]]] | None = None

    def scanned(self, content: bytes) -> Parsed:
        """A document for each page that was read and isn't empty, in order."""
        if self.ocr is None:
            raise ValueError("reading scanned pages needs an OCR provider")
        pages = [(n, text) for n, status, text in self.ocr(content) if status == "success" and text]
        return [(text, {"format": "scanned-pdf", "pageNumber": str(n), "totalPages": str(len(pages))}) for n, text in sorted(pages)]

"""Word-processor, slide, sheet and e-book files: ZIP archives of XML."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as E

from quernstone.sources import pixels

MOST_ROWS, MOST_COLUMNS, PREVIEW = 10_000, 500, 20
PICTURES = ("png", "jpeg", "jpg", "gif", "bmp", "tiff", "tif", "webp", "emf", "wmf")
WEB = re.compile(r"(?:ftp|https?)://")


def tag(e: E.Element) -> str:
    return e.tag.rpartition("}")[2]


def attribute(e: E.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def inside(e: E.Element, name: str) -> list[E.Element]:
    return [x for x in e.iter() if tag(x) == name]


def text_of(e: E.Element, name: str = "t") -> str:
    return "".join(x.text or "" for x in inside(e, name))


def unique(values: list) -> list:
    return list(dict.fromkeys(values))


class Archive:
    """A ZIP archive's XML parts and the relationships between them."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.names = set(self.zip.namelist())

    def xml(self, name: str) -> E.Element | None:
        return E.fromstring(self.zip.read(name)) if name in self.names else None

    def relations(self, part: str) -> dict[str, tuple[str, str, bool]]:
        """Identifier -> (target, kind, outside)."""
        folder, name = posixpath.split(part)
        root = self.xml(f"{folder}/_rels/{name}.rels")
        out = {}
        for r in [] if root is None else root:
            target, outer = r.get("Target", ""), r.get("TargetMode") == "External"
            if not outer:
                target = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
            out[r.get("Id")] = (target, r.get("Type", "").rpartition("/")[2], outer)
        return out

    def core(self) -> dict[str, str]:
        """Author, dates, title and the like."""
        root = self.xml("docProps/core.xml")
        names = {"creator": "author", "created": "created", "modified": "modified", "lastModifiedBy": "last_modified_by", "title": "title", "subject": "subject"}
        return {} if root is None else {names[tag(x)]: x.text for x in root if tag(x) in names and x.text}


def picture(archive: Archive, name: str, page: int, number: int, base: str) -> dict | None:
    data = archive.zip.read(name) if name in archive.names else b""
    ext = posixpath.splitext(name)[1].lower().lstrip(".")
    ext = pixels.kind_of(data) or ext  # names may be wrong
    if not data or ext not in PICTURES:
        return None
    return {"image_id": f"{base}__p{page}_img{number}", "pg_num": page, "img_idx": number, "image_bytes": data, "ext": {"jpg": "jpeg", "tif": "tiff"}.get(ext, ext)}


def page(number: int, kind: str | None, text: str, **more) -> dict:
    return {"pg_num": number, "kind": kind, "title": None, "txt": text, "tables": [], "elements": None, "hyperlinks": None} | more


def word(data: bytes, base: str) -> tuple[dict, list[dict], list[dict]]:
    a = Archive(data)
    part = "word/document.xml"
    root, relations = a.xml(part), a.relations(part)
    body = next(x for x in root if tag(x) == "body")
    pages: list[dict] = []
    lines: list[str] = []
    tables: list[list[list[str]]] = []
    links: list[str] = []
    shown: dict[str, int] = {}
    paragraphs, repeats = 0, [0]

    def close() -> None:
        nonlocal lines, tables, links
        if lines or tables:
            pages.append(page(len(pages) + 1, "page", "\n".join(lines), tables=tables, hyperlinks=unique(links)))
        lines, tables, links = [], [], []

    def mention(x: E.Element) -> None:
        target = relations.get(attribute(x, "embed") or attribute(x, "id") or "")
        if target and tag(x) in ("blip", "imagedata"):
            repeats[0] += target[0] in shown
            shown[target[0]] = len(pages) + 1
        elif target and tag(x) == "hyperlink" and WEB.match(target[0]):
            links.append(target[0])

    def blocks(e: E.Element) -> Iterator[E.Element]:
        """Paragraphs and tables, those inside content controls too."""
        for x in e:
            if tag(x) in ("sdt", "sdtContent", "customXml", "ins"):
                yield from blocks(x)
            else:
                yield x

    for block in blocks(body):
        if tag(block) == "p":
            paragraphs += 1
            held = ""
            for x in block.iter():
                mention(x)
                name = tag(x)
                if name == "t":
                    held += x.text or ""
                elif name == "tab":
                    held += "\t"
                elif name == "lastRenderedPageBreak" or (name == "br" and attribute(x, "type") == "page"):
                    if held.strip():
                        lines.append(held.strip())
                    held = ""
                    close()
            if held.strip():
                lines.append(held.strip())
        elif tag(block) == "tbl":
            rows = [[text_of(c).strip() for c in inside(r, "tc")] for r in inside(block, "tr")]
            for x in block.iter():
                mention(x)
            if any(any(r) for r in rows):
                tables.append(rows)
    close()
    if not pages:
        pages.append(page(1, "page", "", hyperlinks=[]))
    numbers: dict[int, int] = {}
    pictures = []
    for name in sorted(n for n in a.names if n.startswith("word/media/")):
        at = shown.get(name, 1)
        if one := picture(a, name, at, numbers.get(at, 0), base):
            pictures.append(one)
            numbers[at] = numbers.get(at, 0) + 1
    meta = a.core() | {"paragraph_count": paragraphs, "table_count": sum(len(p["tables"]) for p in pages), "page_count": len(pages), "duplicate_images": repeats[0]}
    return meta, pages, pictures


def slides(data: bytes, base: str) -> tuple[dict, list[dict], list[dict]]:
    a = Archive(data)
    part = "ppt/presentation.xml"
    root, relations = a.xml(part), a.relations(part)
    ids = [next((v for k, v in x.attrib.items() if k.endswith("}id")), None) for x in inside(root, "sldId")] if root is not None else []
    order = [relations[i][0] for i in ids if i in relations]
    order = [n for n in order if n in a.names] or sorted((n for n in a.names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
    pages, pictures, seen = [], [], set()
    for number, name in enumerate(order, 1):
        slide, own = a.xml(name), a.relations(name)
        texts, tables, title, links, media = [], [], None, [], []
        for shape in slide.iter():
            kind = tag(shape)
            if kind == "sp":
                t = "\n".join(x for x in (text_of(p).strip() for p in inside(shape, "p")) if x)
                holder = next(iter(inside(shape, "ph")), None)
                if holder is not None and title is None and holder.get("type", "") in ("title", "ctrTitle"):
                    title = t
                if t:
                    texts.append(t)
            elif kind == "tbl":
                tables.append([["\n".join(text_of(p) for p in inside(c, "p")).strip() for c in inside(r, "tc")] for r in inside(shape, "tr")])
            elif kind == "hlinkClick" and (target := own.get(attribute(shape, "id") or "")):
                links.append(target[0])
            elif kind == "relIds" and (target := own.get(attribute(shape, "dm") or "")):
                points = [text_of(p).strip() for p in inside(a.xml(target[0]) or E.Element("x"), "pt")]
                if any(points):
                    texts.append("[SmartArt] " + " | ".join(p for p in points if p))
            elif kind == "blip" and (target := own.get(attribute(shape, "embed") or "")):
                media.append(target[0])
        n = 0
        for m in media:
            if m not in seen and (one := picture(a, m, number, n, base)):
                pictures.append(one)
                n += 1
            seen.add(m)
        pages.append(page(number, "slide", "\n".join(texts), title=title or "", tables=tables, hyperlinks=unique(links)))
    size = next(iter(inside(root, "sldSz")), None) if root is not None else None
    meta = a.core() | {"slide_count": len(pages)} | ({} if size is None else {"slide_width": size.get("cx"), "slide_height": size.get("cy")})
    return meta, pages or [page(1, "slide", "", title="", hyperlinks=[])], pictures


def filled(c) -> bool:
    return c is not None and str(c).strip() != ""


def sheet_text(name: str, rows: list[list], truncated: bool = False) -> str:
    """As quernstone.functions.text.sheet_text, for rows at hand."""
    start = next((i for i, r in enumerate(rows) if any(map(filled, r)) and not any(str(c).strip().endswith(":") for c in r if filled(c))), None)
    if start is None:
        return ""
    heads = [f"col_{j}" if c is None or c == "" else str(c) for j, c in enumerate(rows[start])]
    more = f", ... ({len(heads)} columns total)" if len(heads) > PREVIEW else ""
    data = rows[start + 1 :]
    blocks = [f"Sheet: {name}\nColumns: {', '.join(heads[:PREVIEW])}{more}\nTotal rows: {len(data)}" + f" (truncated to {MOST_ROWS})" * truncated]
    for r in data:
        line = " | ".join(f"{h}: {c}" for h, c in zip(heads, r, strict=False) if filled(c))
        if line:
            blocks.append(line)
    return "\n\n".join(blocks)


def column_number(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def sheets(data: bytes, base: str) -> tuple[dict, list[dict], list[dict]]:
    a = Archive(data)
    part = "xl/workbook.xml"
    book, relations = a.xml(part), a.relations(part)
    strings = a.xml("xl/sharedStrings.xml")
    shared = [] if strings is None else [text_of(s) for s in strings if tag(s) == "si"]
    listed = inside(book, "sheet")
    names = [s.get("name") for s in listed]
    pages, pictures, seen = [], [], set()
    for s in listed:
        if s.get("state") in ("hidden", "veryHidden"):
            continue
        target = relations[attribute(s, "id")][0]
        root, own = a.xml(target), a.relations(target)
        hidden = {i for c in inside(root, "col") if c.get("hidden") in ("1", "true") for i in range(int(c.get("min")) - 1, min(int(c.get("max")), MOST_COLUMNS))}
        rows: list[list] = []
        found = inside(root, "row")
        for r in found[:MOST_ROWS]:
            at = int(r.get("r", len(rows) + 1)) - 1
            while len(rows) < min(at, MOST_ROWS):
                rows.append([])
            cells: dict[int, str] = {}
            for j, c in enumerate(x for x in r if tag(x) == "c"):
                value = next((x.text for x in c if tag(x) == "v"), None)
                if c.get("t") == "s" and value is not None:
                    value = shared[int(value)]
                elif c.get("t") == "inlineStr":
                    value = text_of(c)
                k = column_number(c.get("r")) if c.get("r") else j
                if value is not None and k < MOST_COLUMNS and k not in hidden:
                    cells[k] = value
            rows.append([cells.get(k) for k in range(max(cells, default=-1) + 1) if k not in hidden])
        rows = rows[:MOST_ROWS]
        width = max((max((j + 1 for j, c in enumerate(r) if filled(c)), default=0) for r in rows), default=0)
        rows = [(r + [None] * width)[:width] for r in rows]
        number = len(pages) + 1
        links = unique([own[i][0] for x in inside(root, "hyperlink") if (i := attribute(x, "id")) in own])
        text = sheet_text(s.get("name"), rows, len(found) > MOST_ROWS)
        if number == 1 and (ranges := [f"{x.get('name')}: {x.text}" for x in inside(book, "definedName") if x.get("name") and not x.get("name").startswith("_xlnm")]):
            text = "\n\n".join(x for x in (text, "Named Ranges:\n" + "\n".join(ranges)) if x)
        pages.append(page(number, "sheet", text, title=s.get("name"), hyperlinks=links))
        n = 0
        for drawing, kind, _ in own.values():
            for media, what, _ in a.relations(drawing).values() if kind == "drawing" else ():
                if what == "image" and media not in seen:
                    seen.add(media)
                    if one := picture(a, media, number, n, base):
                        pictures.append(one)
                        n += 1
    meta = {"sheet_count": len(pages), "sheet_names": ", ".join(p["title"] for p in pages), "hidden_sheet_count": len(names) - len(pages), "has_named_ranges": bool(inside(book, "definedName"))}
    return meta, pages or [page(1, "sheet", "", title="", hyperlinks=[])], pictures

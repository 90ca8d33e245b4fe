"""Readers by extension, and the files -> documents operator.

A reader takes (content, base name, extension) and returns the document's metadata, its pages and its pictures.
"""

from __future__ import annotations

import codecs
import csv
import email
import email.utils
import io
import posixpath
import re
import shutil
import subprocess
import tempfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.functions import text as X
from quernstone.operators.images import MIN_SIDE, filter_reason
from quernstone.sources import office, pdf, pixels
from quernstone.sources.office import page

Read = tuple[dict, list[dict], list[dict]]
Reader = Callable[[bytes, str, str], Read]
READERS: dict[str, Reader] = {}
_CELLS = pa.list_(pa.list_(pa.string()))
_PAGE = pa.struct([("pg_num", pa.int32()), ("kind", pa.string()), ("title", pa.string()), ("txt", pa.string()), ("tables", pa.list_(_CELLS)), ("elements", pa.list_(pa.struct([("type", pa.string()), ("content", pa.string()), ("rows", _CELLS)]))), ("hyperlinks", pa.list_(pa.string()))])
_IMAGE = pa.struct([("image_id", pa.string()), ("pg_num", pa.int32()), ("img_idx", pa.int32()), ("image_bytes", pa.binary()), ("ext", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("decoded", pa.bool_()), ("colour_range", pa.int32()), ("colours", pa.int32()), ("phash", pa.list_(pa.int64()))])
ROW = pa.schema([("path", pa.string()), ("base_name", pa.string()), ("file_name", pa.string()), ("file_type", pa.string()), ("metadata", pa.map_(pa.string(), pa.string())), ("pages", pa.list_(_PAGE)), ("images", pa.list_(_IMAGE)), ("error", pa.string())])
DOCUMENT = "path string, base_name string, file_name string, file_type string, metadata map<string,string>, pages array<struct<pg_num:int,kind:string,title:string,txt:string,tables:array<array<array<string>>>,elements:array<struct<type:string,content:string,rows:array<array<string>>>>,hyperlinks:array<string>>>, images array<struct<image_id:string,pg_num:int,img_idx:int,image_bytes:binary,ext:string,width:int,height:int,decoded:boolean,colour_range:int,colours:int,phash:array<bigint>>>, error string"


def register(reader: Reader, *extensions: str, into: dict[str, Reader] = READERS) -> None:
    """The last reader registered for an extension counts."""
    for e in extensions:
        into["." + e.strip().lower().lstrip(".")] = reader


def reader_for(extension: str, readers: dict[str, Reader] = READERS) -> Reader:
    e = "." + extension.strip().lower().lstrip(".")
    if e not in readers:
        raise ValueError(f"no reader for {e}; there are {', '.join(sorted(readers))}")
    return readers[e]


def plain(data: bytes, base: str, ext: str) -> Read:
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        text = data.decode("latin-1")
    return {"page_count": 1, "format": ext, "char_count": len(text)}, [page(1, "page", text)], []


def markdown(data: bytes, base: str, ext: str) -> Read:
    text = data.decode("utf-8", "replace")
    parts = [p for p in re.split(r"^(?=# .)", text, flags=re.M) if p.strip()] or [text]
    pages = []
    for n, part in enumerate(parts, 1):
        tables, now = [], []
        for line in [*map(str.strip, part.splitlines()), ""]:
            if len(line) > 2 and line[0] == line[-1] == "|":
                if not re.fullmatch(r"[|:\s-]+", line):
                    now.append([c.strip() for c in line.strip("|").split("|")])
            elif now:
                tables.append(now)
                now = []
        pages.append(page(n, "section", part.strip(), tables=tables))
    heads = [len(re.findall(rf"^{'#' * k} .+", text, flags=re.M)) for k in (1, 2)]
    return {"page_count": len(pages), "format": ext, "h1_count": heads[0], "h2_count": heads[1]}, pages, []


def sheet(data: bytes, base: str, ext: str) -> Read:
    text = data.decode("utf-8", "replace")
    try:
        dialect = csv.Sniffer().sniff(text[:8192], delimiters=",;\t|")
    except csv.Error:
        dialect = csv.excel
    rows = []
    for r in csv.reader(io.StringIO(text, newline=""), dialect):
        if len(rows) >= office.MOST_ROWS:
            break
        rows.append(r)
    return {"sheet_count": 1, "row_count": max(0, len(rows) - 1)}, [page(1, "sheet", office.sheet_text(base, rows, len(rows) >= office.MOST_ROWS), title=base, hyperlinks=[])], []


class _Html(HTMLParser):
    """Texts in document order, cut before each h1 that is a direct child of body; tables of each part."""

    SKIP = frozenset(("script", "style", "nav", "header", "footer"))
    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title = ""
        self.parts: list[tuple[list[str], list]] = [([], [])]
        self.open: list[str] = []
        self.rows: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, name, attrs):
        if name in self.VOID:
            return
        if name == "h1" and (not self.open or self.open[-1] in ("body", "html")):
            self.parts.append(([], []))
        if name == "table":
            self.rows.append([])
        elif name == "tr" and self.rows:
            self.rows[-1].append([])
        elif name in ("td", "th") and self.rows and self.rows[-1]:
            self.cell = []
            self.rows[-1][-1].append("")
        self.open.append(name)

    def handle_endtag(self, name):
        if name not in self.open:
            return
        while self.open.pop() != name:
            pass
        if name in ("td", "th") and self.cell is not None and self.rows and self.rows[-1] and self.rows[-1][-1]:
            self.rows[-1][-1][-1] = " ".join(self.cell)
            self.cell = None
        elif name == "table" and self.rows:
            rows = [r for r in self.rows.pop() if r]
            if rows:
                self.parts[-1][1].append(rows)

    def handle_data(self, data):
        text = data.strip()
        if not text or self.SKIP.intersection(self.open):
            return
        if "title" in self.open:
            self.title += text
            return
        if "head" in self.open and "body" not in self.open:
            return
        self.parts[-1][0].append(text)
        if self.cell is not None:
            self.cell.append(text)


def _charset(data: bytes) -> str:
    m = re.search(rb"charset\s*=\s*[\"']?\s*([\w-]+)", data[:4096], re.I)
    try:
        return codecs.lookup(m[1].decode()).name if m else "utf-8"
    except LookupError:
        return "utf-8"


def web(data: bytes, base: str, ext: str) -> Read:
    h = _Html()
    h.feed(data.decode(_charset(data), "replace"))
    h.close()
    kept = [(t, tables) for t, tables in h.parts if t or tables] or [([], [])]
    return {"page_count": len(kept), "format": ext, "title": h.title}, [page(n, "section", "\n".join(t), tables=tables) for n, (t, tables) in enumerate(kept, 1)], []


def rich(data: bytes, base: str, ext: str) -> Read:
    """RTF without its groups for fonts, colours, styles and pictures."""
    text, out, stack, skip, wide = data.decode("utf-8", "replace"), [], [], False, 1
    skips = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer", "generator", "listtable", "themedata"}
    signs = {"par": "\n", "line": "\n", "tab": "\t", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•", "cell": "|", "row": "\n", "sect": "\n", "page": "\n"}
    drop = 0
    for m in re.finditer(r"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-f]{2})|\\([^a-z])|([{}])|([^\\{}\r\n]+)", text, re.I):
        word, number, code, sign, brace, run = m.groups()
        if brace == "{":
            stack.append((skip, wide))
        elif brace:
            skip, wide = stack.pop() if stack else (False, 1)
        elif sign == "*" or word in skips:
            skip = True
        elif skip:
            continue
        elif word == "uc":
            wide = int(number or 1)
        elif word == "u":
            out.append(chr(int(number or 63) % 65536))
            drop = wide
        elif word:
            out.append(signs.get(word, ""))
        elif code:
            if drop:
                drop -= 1
            else:
                out.append(bytes.fromhex(code).decode("cp1252", "replace"))
        elif sign:
            out.append({"~": "\xa0", "_": "-", "-": ""}.get(sign, sign))
        elif run:
            out.append(run[drop:])
            drop = 0
    clean = "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace").strip()
    return {"page_count": 1, "format": ext, "char_count": len(clean)}, [page(1, "page", clean)], []


def mail(data: bytes, base: str, ext: str) -> Read:
    m = email.message_from_bytes(data)
    body: dict[str, str] = {}
    attached, pictures = [], []
    for part in m.walk():
        name, kind = part.get_filename(), part.get_content_type()
        payload = part.get_payload(decode=True) or b""
        if name:
            attached.append(name)
        if kind.startswith("image/") and payload:
            pictures.append({"image_id": f"{base}__p1_img{len(pictures)}", "pg_num": 1, "img_idx": len(pictures), "image_bytes": payload, "ext": kind.split("/")[1]})
        elif kind in ("text/plain", "text/html") and part.get_content_disposition() != "attachment":
            try:
                body.setdefault(kind, payload.decode(part.get_content_charset() or "utf-8", "replace"))
            except LookupError:
                body.setdefault(kind, payload.decode("utf-8", "replace"))
    text = body.get("text/plain") or re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", body.get("text/html", "")))
    head = {k: str(email.header.make_header(email.header.decode_header(m.get(k, "")))) for k in ("Subject", "From", "To", "Date")}
    try:
        date = email.utils.parsedate_to_datetime(head["Date"]).replace(tzinfo=None).isoformat()
    except (TypeError, ValueError):
        date = head["Date"]
    lines = "\n".join(f"{k}: {date if k == 'Date' else v}" for k, v in head.items() if v)
    meta = {"page_count": 1, "format": ext, "subject": head["Subject"], "from": head["From"], "to": head["To"], "date": date, "attachment_count": len(attached), "attachments": ", ".join(attached)}
    return meta, [page(1, "page", f"{lines}\n\n{text.strip()}".strip())], pictures


def book(data: bytes, base: str, ext: str) -> Read:
    a = office.Archive(data)
    container = a.xml("META-INF/container.xml")
    package = office.inside(container, "rootfile")[0].get("full-path")
    root, folder = a.xml(package), posixpath.dirname(package)
    items = {x.get("id"): x for x in office.inside(root, "item")}
    pages, pictures = [], []
    for x in items.values():
        name = posixpath.normpath(posixpath.join(folder, x.get("href", "")))
        kind = x.get("media-type", "")
        if kind.startswith("image/") and (one := office.picture(a, name, 1, len(pictures), base)):
            pictures.append(one)
        if kind != "application/xhtml+xml" or name not in a.names or re.search("nav|toc", posixpath.basename(name), re.I):
            continue
        _, parts, _ = web(a.zip.read(name), base, ext)
        text = "\n".join(p["txt"] for p in parts).strip()
        if text:
            pages.append(page(len(pages) + 1, "section", text, tables=[t for p in parts for t in p["tables"]]))
    said = {office.tag(x): x.text for x in root.iter() if office.tag(x) in ("title", "creator", "language") and x.text}
    meta = {"page_count": len(pages) or 1, "format": ext, "title": said.get("title", ""), "author": said.get("creator", ""), "language": said.get("language", "")}
    return meta, pages or [page(1, "section", "")], pictures


def image(data: bytes, base: str, ext: str) -> Read:
    """One page and picture; of a TIFF of several frames one of each for every frame. What a picture is its bytes say, whatever its name."""
    kind = pixels.kind_of(data) or {"jpg": "jpeg", "tif": "tiff"}.get(ext, ext)
    frames = (pixels.tiff_frames(data) if kind == "tiff" else []) or [data]
    pictures = [{"image_id": f"{base}__p{n}_img0", "pg_num": n, "img_idx": 0, "image_bytes": f, "ext": kind} for n, f in enumerate(frames, 1)]
    return {"page_count": len(frames), "format": kind}, [page(n, None if len(frames) == 1 else "page", "") for n in range(1, len(frames) + 1)], pictures


def converted(*targets: str, seconds: int = 120) -> Reader:
    """A reader that lets LibreOffice turn a file into the first of ``targets`` that it can; RuntimeError where it isn't installed."""

    def run(data: bytes, base: str, ext: str) -> Read:
        program = shutil.which("soffice") or shutil.which("libreoffice")
        if not program:
            raise RuntimeError(f"LibreOffice is needed to read .{ext}")
        for target in targets:
            with tempfile.TemporaryDirectory() as folder:
                source = Path(folder, f"in.{ext}")
                source.write_bytes(data)
                out = Path(folder, "out")
                subprocess.run([program, "--headless", "--convert-to", target, "--outdir", str(out), str(source)], timeout=seconds, check=False, capture_output=True)
                made = sorted(out.glob(f"*.{target}"))
                if made:
                    meta, pages, pictures = reader_for(target)(made[0].read_bytes(), base, target)
                    return meta | {"converted_from": "." + ext}, pages, pictures
        raise RuntimeError(f"LibreOffice made nothing of .{ext}")

    return run


register(plain, "txt", "log", "conf", "ini")
register(markdown, "md")
register(sheet, "csv")
register(web, "html", "htm")
register(rich, "rtf")
register(mail, "eml")
register(book, "epub")
register(image, "png", "jpg", "jpeg", "tiff", "tif", "webp", "bmp")
register(lambda d, b, e: office.word(d, b), "docx")
register(lambda d, b, e: office.slides(d, b), "pptx")
register(lambda d, b, e: office.sheets(d, b), "xlsx", "xlsm")
register(lambda d, b, e: pdf.read(d, b), "pdf")
register(converted("docx", "pdf"), "doc", "odt")
register(converted("pptx", "pdf"), "ppt", "odp")
register(converted("xlsx", "pdf"), "xls", "ods")


def documents(files: DataFrame, readers: dict[str, Reader] | None = None, strict: bool = False) -> DataFrame:
    """files (path, content) -> one row of DOCUMENT for each. What a reader raises is the row's ``error``, beside one empty page; with ``strict`` it
    ends the job. A NULL content is an error too."""
    table = dict(READERS if readers is None else readers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = posixpath.basename(path or "")
                base, dot = posixpath.splitext(name)
                ext = dot.lower().lstrip(".")
                row = {"path": path, "base_name": base, "file_name": name, "file_type": ext, "metadata": [], "pages": [page(1, "page", "")], "images": [], "error": None}
                try:
                    if content is None:
                        raise ValueError("no content")
                    meta, pages, pictures = reader_for(ext, table)(content, base, ext)
                    row |= {"metadata": [(k, v if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)) for k, v in meta.items() if v is not None], "pages": pages, "images": [p | pixels.features(p["image_bytes"]) for p in pictures]}
                except Exception as e:  # any reader's failure is its document's
                    if strict:
                        raise
                    row["error"] = f"{type(e).__name__}: {e}"
                yield from pa.Table.from_pylist([row], schema=ROW).to_batches()

    return files.select("path", "content").mapInArrow(run, DOCUMENT)


def pages_of(docs: DataFrame) -> DataFrame:
    """One row for each page, as chunk_pages() takes them; doc_id is the path."""
    return docs.select(F.col("path").alias("doc_id"), "base_name", F.explode("pages").alias("p")).select("doc_id", "base_name", "p.*")


def images_of(docs: DataFrame, references: list[tuple[str, list[int]]] | None = None, min_side: int = MIN_SIDE) -> DataFrame:
    """One row for each picture with its filter_reason. references: (name, hash) of logos, held as a literal."""
    rows = docs.select(F.col("path").alias("doc_id"), F.explode("images").alias("i")).select("doc_id", "i.*")
    distance = F.lit(None).cast("int")
    if references:
        known = F.array(*[F.array(*[F.lit(w).cast("long") for w in h]) for _, h in references])
        apart = F.transform(known, lambda r: F.aggregate(F.zip_with("phash", r, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x))
        distance = F.array_min(apart)
    reason = filter_reason(F.coalesce("width", F.lit(1 << 20)), F.coalesce("height", F.lit(1 << 20)), F.col("decoded"), distance, F.col("colour_range"), F.col("colours"), min_side)
    image_type = X.image_type(F.col("ext"))
    return rows.withColumns({"filter_reason": reason, "size_bytes": F.length("image_bytes"), "img_path": F.concat("image_id", F.lit("."), image_type)})

"""A limited PDF reader: uncompressed and Flate streams, simple encodings and ToUnicode maps, JPEG and plain pictures.

Encrypted files are refused with ValueError, and files of which no page's filters are known. Tables aren't detected: a page is one text element. A picture belongs to
the first page that names it.
"""

from __future__ import annotations

import re
import zlib

from quernstone.sources import pixels

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_OPERAND = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]*|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_INFO = {"Author": "author", "Creator": "creator", "Producer": "producer", "Title": "title", "Subject": "subject", "Keywords": "keywords", "CreationDate": "created", "ModDate": "modified"}


def _literal(raw: bytes) -> bytes:
    if raw[:1] == b"<":
        h = re.sub(rb"\s", b"", raw[1:-1])
        return bytes.fromhex((h + b"0" * (len(h) % 2)).decode())
    return re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() and m[1][:1] < b"8" else b"" if m[1][-1:] == b"\n" else _ESCAPES.get(m[1], m[1]), raw[1:-1], flags=re.S)


def _decoded(raw: bytes) -> str:
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")


def _date(value: str) -> str:
    m = re.match(r"D:(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)", value)
    return "{}-{}-{}T{}:{}:{}".format(*m.groups()) if m else value


class Document:
    def __init__(self, data: bytes):
        if b"/Encrypt" in data:
            raise ValueError("encrypted PDF files aren't supported")
        self.objects = {int(n): body for n, body in _OBJECT.findall(data)}
        for body in list(self.objects.values()):
            if b"/ObjStm" in body[:400]:
                head, packed = body.partition(b"stream")[0], self.stream(body)
                n, first = (int(re.search(rb"/%s\s+(\d+)" % k, head)[1]) for k in (b"N", b"First"))
                table = list(map(int, packed[:first].split()))[: 2 * n]
                for i in range(0, len(table), 2):
                    end = table[i + 3] if i + 3 < len(table) else len(packed) - first
                    self.objects.setdefault(table[i], packed[first + table[i + 1] : first + end])
        self.trailer = b" ".join(re.findall(rb"trailer(.*?)startxref", data, re.S)) + b" ".join(b for b in self.objects.values() if b"/XRef" in b[:300])

    def stream(self, body: bytes) -> bytes:
        found = _STREAM.search(body)
        if not found:
            return b""
        head = body[: found.start()]
        filters = re.findall(rb"/(\w+Decode)\b", head)
        if any(f != b"FlateDecode" for f in filters):
            raise ValueError(f"filter {filters[0].decode()} isn't supported")
        return zlib.decompressobj().decompress(found[1]) if filters else found[1]

    def follow(self, body: bytes, key: bytes) -> bytes:
        """A value of a dictionary, through one reference."""
        m = re.search(rb"/%s\s+(\d+)\s+\d+\s+R" % key, body)
        if m:
            return self.objects.get(int(m[1]), b"")
        m = re.search(rb"/%s\s*(<<.*?>>|\[.*?\]|\(.*?\))" % key, body, re.S)
        return m[1] if m else b""

    def pages(self) -> list[bytes]:
        root = next((b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog\b", b)), b"")
        out: list[bytes] = []
        todo = [self.follow(root, b"Pages")]
        seen = 0
        while todo and seen < 1_000_000:
            node, seen = todo.pop(0), seen + 1
            if re.search(rb"/Type\s*/Pages\b", node) or b"/Kids" in node:
                todo = [self.objects.get(int(k), b"") for k in re.findall(rb"(\d+)\s+\d+\s+R", self.follow(node, b"Kids"))] + todo
            elif node:
                out.append(node)
        return out or [b for b in self.objects.values() if re.search(rb"/Type\s*/Page\b", b)]

    def unicode_maps(self, page: bytes) -> dict[bytes, tuple[int, dict[int, str]]]:
        """Of each font with a map the bytes of a code, and the map. Composite fonts have codes of two bytes, or as the map's code space says; all others of one."""
        resources = self.follow(page, b"Resources") or page
        fonts = self.follow(resources, b"Font") or resources
        out = {}
        for name, n in re.findall(rb"/(\w+)\s+(\d+)\s+\d+\s+R", fonts):
            body = self.objects.get(int(n), b"")
            if b"/ToUnicode" not in body:
                continue
            table, cmap = {}, self.stream(self.follow(body, b"ToUnicode"))
            for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
                for a, b in re.findall(rb"<(\w+)>\s*<(\w+)>", block):
                    table[int(a, 16)] = bytes.fromhex(b.decode()).decode("utf-16-be", "replace")
            for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
                for a, b, c in re.findall(rb"<(\w+)>\s*<(\w+)>\s*<(\w+)>", block):
                    for k in range(int(a, 16), int(b, 16) + 1):
                        table[k] = chr(min(0x10FFFF, int(c, 16) + k - int(a, 16)))
            space = re.search(rb"begincodespacerange\s*<(\w+)>", cmap)
            width = (len(space[1]) // 2 if space else 2) if re.search(rb"/Subtype\s*/Type0\b", body) else 1
            out[name] = (max(1, width), table)
        return out

    def text(self, page: bytes) -> str:
        contents = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", page, re.S)
        numbers = re.findall(rb"(\d+)\s+\d+\s+R", contents[1]) if contents else []
        code = b"\n".join(self.stream(self.objects.get(int(n), b"")) for n in numbers)
        maps, now, out, stack, y = self.unicode_maps(page), None, [], [], None

        def show(raw: bytes) -> str:
            s = _literal(raw)
            if now is None:
                return _decoded(s)
            width, table = now
            # a code of a simple font that its map leaves out stands for itself
            return "".join(table.get(code, "" if width > 1 else chr(code)) for i in range(0, len(s), width) for code in [int.from_bytes(s[i : i + width])])

        for t in _OPERAND.findall(code):
            if t[:1] in b"(<[]/+-.0123456789":
                stack.append(t)
                continue
            if t == b"Tf" and len(stack) > 1:
                now = maps.get(stack[-2][1:])
            elif t in (b"Tj", b"'", b'"') and stack:
                out.append(("\n" if t != b"Tj" else "") + show(stack[-1]))
            elif t == b"TJ":
                for x in stack:
                    if x[:1] in b"(<":
                        out.append(show(x))
                    elif x[:1] in b"-0123456789." and float(x) < -200:
                        out.append(" ")
            elif t in (b"T*", b"ET"):
                out.append("\n")
            elif t in (b"Td", b"TD") and len(stack) > 1:
                out.append("\n" if float(stack[-1]) else " ")
            elif t == b"Tm" and len(stack) > 5:
                out.append("\n" if stack[-1] != y else " ")
                y = stack[-1]
            stack = []
        return re.sub(r"[ \t]*\n\s*", "\n", "".join(out)).strip()

    def links(self, page: bytes) -> list[str]:
        found = []
        annotations = self.follow(page, b"Annots")
        bodies = [self.objects.get(int(n), b"") for n in re.findall(rb"(\d+)\s+\d+\s+R", annotations)]
        for body in [annotations, *bodies]:
            found += [_decoded(_literal(u)) for u in re.findall(rb"/URI\s*(\((?:\\.|[^\\()])*\))", body)]
        return [u for u in dict.fromkeys(found) if re.match(r"(ftp|https?)://", u)]

    def info(self) -> dict[str, str]:
        body = self.follow(self.trailer, b"Info")
        out = {}
        for key, raw in re.findall(rb"/(\w+)\s*(\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]+>)", body):
            if (name := _INFO.get(key.decode())) and name not in out and (value := _decoded(_literal(raw))):
                out[name] = _date(value) if name in ("created", "modified") else value
        return out


    def number(self, body: bytes, key: bytes) -> int:
        m = re.search(rb"/%s\s+(\d+)(?:\s+\d+\s+(R)\b)?" % key, body)
        if m and m[2]:
            m = re.match(rb"\s*(\d+)", self.objects.get(int(m[1]), b""))
        return int(m[1]) if m else 0

    def picture(self, body: bytes) -> tuple[str, bytes] | None:
        """Type and bytes of an image object: JPEG and JPEG 2000 as they are, 8-bit grey and RGB pixels as PNG; None for any other."""
        found = _STREAM.search(body)
        if not found or not re.search(rb"/Subtype\s*/Image\b", body[: found.start()]):
            return None
        head = body[: found.start()]
        filters = re.findall(rb"/(\w+Decode)\b", head)
        if filters in ([b"DCTDecode"], [b"JPXDecode"]):
            return ("jpeg" if filters[0] == b"DCTDecode" else "jpx"), found[1]
        width, height = self.number(head, b"Width"), self.number(head, b"Height")
        space = re.search(rb"/ColorSpace\s*(/\w+|\d+\s+\d+\s+R|\[[^\]]*\])", head)
        name = space[1] if space else b""
        if ref := re.match(rb"(\d+)\s+\d+\s+R", name):
            name = self.objects.get(int(ref[1]), b"")
        if icc := re.search(rb"/ICCBased\s+(\d+)\s+\d+\s+R", name):
            channels = self.number(self.objects.get(int(icc[1]), b""), b"N")
        else:
            channels = 3 if b"RGB" in name else 1 if b"Gray" in name else 0
        if filters not in ([], [b"FlateDecode"]) or self.number(head, b"BitsPerComponent") != 8 or channels not in (1, 3) or not width * height:
            return None
        if self.number(head, b"Predictor") >= 10:
            return "png", pixels.png_of(found[1], width, height, channels)
        raw, row = self.stream(body), width * channels
        if len(raw) < row * height:
            return None
        lines = b"".join(b"\0" + raw[y * row : (y + 1) * row] for y in range(height))
        return "png", pixels.png_of(zlib.compress(lines), width, height, channels)

    def image_numbers(self, page: bytes) -> list[int]:
        """The objects that a page's resources name as outside objects."""
        resources = self.follow(page, b"Resources") or page
        inside = self.follow(resources, b"XObject")
        return [int(n) for n in re.findall(rb"/[^\s/<>\[\]]+\s+(\d+)\s+\d+\s+R", inside)]


def read(data: bytes, base: str) -> tuple[dict, list[dict], list[dict]]:
    d = Document(data)
    pages = []
    unread, why = 0, None
    pictures, seen, repeats = [], set(), 0
    for number, body in enumerate(d.pages(), 1):
        try:
            text = d.text(body)
        except ValueError as e:  # a filter that isn't supported costs this page only
            text, unread = "", unread + 1
            why = e
        own = 0
        for n in d.image_numbers(body):
            if n in seen:
                repeats += 1
            elif (made := d.picture(d.objects.get(n, b""))) is not None:
                pictures.append({"image_id": f"{base}__p{number}_img{own}", "pg_num": number, "img_idx": own, "image_bytes": made[1], "ext": made[0]})
                own += 1
            seen.add(n)
        elements = [{"type": "text", "content": text, "rows": None}] if text else []
        pages.append({"pg_num": number, "kind": "page", "title": "", "txt": text, "tables": [], "elements": elements, "hyperlinks": d.links(body)})
    if unread and unread == len(pages):
        raise why
    pages = pages or [{"pg_num": 1, "kind": "page", "title": "", "txt": "", "tables": [], "elements": [], "hyperlinks": []}]
    return d.info() | {"page_count": len(pages), "table_count": 0} | ({"unread_pages": unread} if unread else {}) | ({"duplicate_images": repeats} if repeats else {}), pages, pictures

"""Readers on files made here; discovery; a whole run; the stream."""

import io
import json
import struct
import warnings
import zipfile
import zlib

import numpy as np
import pytest

from quernstone import providers, streaming
from quernstone.plans import pipeline
from quernstone.sources import discovery, formats, pixels


def png(pixels_):
    h, w = pixels_.shape[:2]
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    raw = b"".join(b"\0" + row.tobytes() for row in pixels_)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def noise(w=200, h=150, seed=1):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 3), dtype=np.uint8)


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
REL = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'


def rel(i, kind, target, outer=False):
    return f'<Relationship Id="{i}" Type="http://x/{kind}" Target="{target}"{" TargetMode=\"External\"" if outer else ""}/>'


def docx():
    W = 'xmlns:w="http://w"'
    body = '<w:p><w:r><w:t>First </w:t></w:r><w:r><w:t>line</w:t></w:r></w:p><w:p><w:r><w:t>before</w:t><w:br w:type="page"/><w:t>after</w:t></w:r><w:hyperlink r:id="r2"><w:r><w:t>link</w:t></w:r></w:hyperlink></w:p>'
    body += '<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl><w:p><w:r><a:blip xmlns:a="http://a" r:embed="r1"/></w:r></w:p>'
    return zipped({"word/document.xml": f"<w:document {W} {R}><w:body>{body}</w:body></w:document>", "word/_rels/document.xml.rels": REL.format(rel("r1", "image", "media/image1.png") + rel("r2", "hyperlink", "https://e.x/", True)), "word/media/image1.png": png(noise()), "docProps/core.xml": '<c xmlns:d="http://d"><d:creator>Ann</d:creator></c>'})


def pptx():
    A = 'xmlns:a="http://a" xmlns:p="http://p"'
    slide = f'<p:sld {A} {R}><p:sp><p:nvPr><p:ph type="title"/></p:nvPr><a:p><a:r><a:t>The title</a:t></a:r></a:p></p:sp><p:sp><a:p><a:r><a:t>Body text</a:t></a:r></a:p></p:sp><a:tbl><a:tr><a:tc><a:p><a:r><a:t>x</a:t></a:r></a:p></a:tc></a:tr></a:tbl><a:blip r:embed="i1"/></p:sld>'
    parts = {"ppt/presentation.xml": f'<p:presentation {A} {R}><p:sldId id="5" r:id="r2"/><p:sldId id="6" r:id="r1"/><p:sldSz cx="9" cy="6"/></p:presentation>', "ppt/_rels/presentation.xml.rels": REL.format(rel("r1", "slide", "slides/slide1.xml") + rel("r2", "slide", "slides/slide2.xml")), "ppt/media/m.png": png(noise())}
    for n in (1, 2):
        parts |= {f"ppt/slides/slide{n}.xml": slide.replace("Body", f"Body{n}"), f"ppt/slides/_rels/slide{n}.xml.rels": REL.format(rel("i1", "image", "../media/m.png"))}
    return zipped(parts)


def xlsx():
    cells = lambda n, *v: f'<row r="{n}">' + "".join(f'<c r="{c}{n}" t="{t}"><v>{x}</v></c>' for c, t, x in v) + "</row>"
    sheet = f'<worksheet {R}><cols><col min="2" max="2" hidden="1"/></cols><sheetData>' + cells(1, ("A", "s", 0), ("B", "s", 1), ("C", "s", 1)) + cells(3, ("A", "n", 5), ("B", "n", 6), ("C", "n", 7)) + "</sheetData></worksheet>"
    return zipped({"xl/workbook.xml": f'<workbook {R}><sheets><sheet name="Data" r:id="r1"/><sheet name="Off" state="hidden" r:id="r2"/></sheets><definedNames><definedName name="N">Data!A1</definedName></definedNames></workbook>', "xl/_rels/workbook.xml.rels": REL.format(rel("r1", "worksheet", "worksheets/sheet1.xml") + rel("r2", "worksheet", "worksheets/sheet1.xml")), "xl/worksheets/sheet1.xml": sheet, "xl/sharedStrings.xml": "<sst><si><t>Load</t></si><si><r><t>Dis</t></r><r><t>p</t></r></si></sst>"})


def epub():
    opf = '<package><metadata><title>Book</title><creator>Ann</creator><language>en</language></metadata><manifest><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="n" href="nav.xhtml" media-type="application/xhtml+xml"/></manifest></package>'
    return zipped({"META-INF/container.xml": '<c><rootfile full-path="OPS/p.opf"/></c>', "OPS/p.opf": opf, "OPS/a.xhtml": "<html><body><h1>One</h1><p>Chapter text</p></body></html>", "OPS/nav.xhtml": "<html><body>contents</body></html>"})


def pdf():
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", "<< /Type /Pages /Kids [3 0 R] /Count 1 >>", "<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Annots [5 0 R] >>"]
    code = zlib.compress(b"BT /F1 12 Tf 10 700 Td (Hello \\(PDF\\) world.) Tj 0 -14 Td [(Se) -20 (cond) -300 (line)] TJ ET")
    out = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o.encode()) for i, o in enumerate(objects, 1))
    out += b"4 0 obj\n<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(code) + code + b"\nendstream\nendobj\n"
    return out + b"5 0 obj\n<< /A << /URI (https://e.x/a) >> >>\nendobj\n6 0 obj\n<< /Title (T) /CreationDate (D:20240131120000Z) >>\nendobj\ntrailer << /Root 1 0 R /Info 6 0 R >>\nstartxref\n0\n%%EOF"


def mail():
    return b'Subject: =?utf-8?q?H=C3=A9?=\nFrom: a@x\nTo: b@x\nDate: Tue, 02 Jan 2024 03:04:05 +0100\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary="b"\n\n--b\nContent-Type: text/html\n\n<p>html</p>\n--b\nContent-Type: text/plain\n\nThe body\n--b\nContent-Type: text/plain\nContent-Disposition: attachment; filename="f.txt"\n\nno\n--b--\n'


FILES = {
    "t.txt": "héllo wörld".encode("latin-1"), "e.log": b"", "m.md": b"pre\n# A\n|x|y|\n|-|-|\n|1|2|\n# B\nend", "c.csv": b"a;b\n1;2\n;3\n", "x.rtf": rb"{\rtf1{\fonttbl{\f0 Arial;}}Hello \b bold\b0\par \'e9\u8364? end}", "w.html": b'<html><head><title>T</title><meta charset="utf-8"></head><body><nav>no</nav>pre<h1>A</h1><p>a &amp; b</p><table><tr><th>h</th></tr><tr><td>v</td></tr></table><h1>B</h1><script>x</script></body></html>',
    "n.eml": mail(), "d.docx": docx(), "p.pptx": pptx(), "s.xlsx": xlsx(), "b.epub": epub(), "q.pdf": pdf(), "i.png": png(noise()), "old.doc": b"x", "bad.docx": b"not a zip", "z.zzz": b"",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("in")
    (root / "sub").mkdir()
    for k, (name, data) in enumerate(FILES.items()):
        (root / ("sub" if k % 2 else "") / name).write_bytes(data)
    return root


@pytest.fixture(scope="module")
def read(spark, folder):
    return {r["file_name"]: r for r in formats.documents(discovery.listed(spark, [str(folder)])).collect()}


def test_discovery(spark, folder):
    assert len(discovery.EXTENSIONS) == 29 == len(formats.READERS)
    found = {p.name for p in discovery.walk([str(folder)])}
    assert found == FILES.keys() - {"z.zzz"}
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        assert not list(discovery.walk([str(folder / "none.txt"), str(folder / "none"), str(folder / "sub" / "z.zzz")]))
    assert len(said) == 3
    one = str(folder / "t.txt")
    assert [p.name for p in discovery.walk([one, one])] == ["t.txt"] * 2
    assert {r["path"].rpartition("/")[2] for r in discovery.scanned(spark, str(folder)).select("path").collect()} == found - {"e.log"}


def test_texts(read):
    page = lambda n, i=0: read[n]["pages"][i]
    assert page("t.txt")["txt"] == "héllo wörld" and page("e.log")["txt"] == "" and read["e.log"]["error"] is None
    assert [p["txt"] for p in read["m.md"]["pages"]] == ["pre", "# A\n|x|y|\n|-|-|\n|1|2|", "# B\nend"] and page("m.md", 1)["tables"] == [[["x", "y"], ["1", "2"]]] and read["m.md"]["metadata"]["h1_count"] == "2"
    assert page("c.csv")["txt"] == "Sheet: c\nColumns: a, b\nTotal rows: 2\n\na: 1 | b: 2\n\nb: 3" and read["c.csv"]["metadata"]["row_count"] == "2"
    assert page("x.rtf")["txt"] == "Hello bold\né€ end"
    assert [p["txt"] for p in read["w.html"]["pages"]] == ["pre", "A\na & b\nh\nv", "B"] and page("w.html", 1)["tables"] == [[["h"], ["v"]]] and read["w.html"]["metadata"]["title"] == "T"
    assert page("n.eml")["txt"] == "Subject: Hé\nFrom: a@x\nTo: b@x\nDate: 2024-01-02T03:04:05\n\nThe body" and read["n.eml"]["metadata"]["attachments"] == "f.txt"


def test_archives(read):
    d = read["d.docx"]
    assert [p["txt"] for p in d["pages"]] == ["First line\nbefore", "afterlink"] and d["pages"][1]["tables"] == [[["a", ""]]] and d["pages"][1]["hyperlinks"] == ["https://e.x/"]
    assert d["metadata"]["author"] == "Ann" and [(i["image_id"], i["width"]) for i in d["images"]] == [("d__p2_img0", 200)]
    p = read["p.pptx"]
    assert [(x["title"], x["txt"]) for x in p["pages"]] == [("The title", "The title\nBody2 text"), ("The title", "The title\nBody1 text")] and len(p["images"]) == 1
    s = read["s.xlsx"]
    assert [x["title"] for x in s["pages"]] == ["Data"] and s["pages"][0]["txt"] == "Sheet: Data\nColumns: Load, Disp\nTotal rows: 2\n\nLoad: 5 | Disp: 7\n\nNamed Ranges:\nN: Data!A1" and s["metadata"]["hidden_sheet_count"] == "1"
    assert [x["txt"] for x in read["b.epub"]["pages"]] == ["One\nChapter text"] and read["b.epub"]["metadata"]["author"] == "Ann"
    q = read["q.pdf"]
    assert q["pages"][0]["txt"] == "Hello (PDF) world.\nSecond line" and q["pages"][0]["hyperlinks"] == ["https://e.x/a"] and q["metadata"]["created"] == "2024-01-31T12:00:00"
    assert q["pages"][0]["elements"][0]["type"] == "text" and d["pages"][0]["elements"] is None


def test_failures_stay_apart(spark, folder, read):
    assert "BadZipFile" in read["bad.docx"]["error"] and "LibreOffice" in read["old.doc"]["error"] and len(read["bad.docx"]["pages"]) == 1
    with pytest.raises(Exception, match="BadZipFile|not a zip"):
        formats.documents(discovery.listed(spark, [str(next(folder.rglob("bad.docx")))]), strict=True).collect()
    with pytest.raises(ValueError, match="no reader"):
        formats.reader_for("nope")
    own = {}
    formats.register(formats.plain, "TXT", into=own)
    formats.register(formats.markdown, ".txt", into=own)
    assert formats.reader_for(".Txt", own) is formats.markdown


def test_pixels():
    x = noise(90, 40)
    assert (pixels.png_pixels(png(x)) == x).all()
    f = pixels.features(png(np.full((120, 160, 3), 200, np.uint8)))
    assert (f["width"], f["height"], f["colour_range"], f["colours"]) == (160, 120, 0, 1)
    a, b = (pixels.features(png(v))["phash"] for v in (noise(seed=1), noise(seed=2)))
    apart = lambda p, q: sum(((u ^ v) & (2**64 - 1)).bit_count() for u, v in zip(p, q, strict=True))
    assert apart(a, a) == 0 and apart(a, b) > 60
    assert not pixels.features(b"junk")["decoded"] and pixels.size_of(b"\xff\xd8\xff\xc0\x00\x11\x08\x00\x10\x00\x20\x03") == (32, 16)


def test_a_whole_run_and_its_resumption(spark, folder, tmp_path):
    config = pipeline.Config.from_env({"QUERNSTONE_TARGET_TOKENS": "x", "QUERNSTONE_OVERLAP_TOKENS": "20", "QUERNSTONE_TIMESTAMP": "2024-01-01T00:00:00Z"})
    assert config.target_tokens == 500 and config.overlap_tokens == 20
    p = pipeline.Pipeline(spark, config, vision=providers.OfflineVision, embedder=providers.OfflineEmbedder, store=str(tmp_path / "out"))
    result = p.process_batch(str(folder))
    s = result.summary().first()
    assert (s["failed"], s["total"]) == (2, len(FILES) - 1)
    chunks = {r["chunk_id"]: r for r in result.chunks.collect()}
    assert chunks["i__p1_image_0"]["content"].startswith("Caption: png image") and len(chunks["i__p1_image_0"]["embedding"]) == 64
    assert "d__p2_table_0" in chunks and chunks["p__p1_text_0"]["content"].startswith("Slide: The title\n\n")
    assert result.degradations.count() == 0
    index = result.index_documents("2024-01-01T00:00:00Z")
    assert index.select("id").distinct().count() == index.count() == len(chunks)
    lines = [json.loads(x) for f in (tmp_path / "out" / "individual_chunks").rglob("part-*") for x in f.read_text().splitlines()]
    assert {x["id"] for x in lines} == chunks.keys() and all("content_vector" in x for x in lines)
    assert p.process_batch(str(folder)).documents.count() == 0


def test_failed_models_are_degradations(spark, folder):
    class Broken:
        dim = 4

        def embed(self, texts):
            raise RuntimeError("down")

        def analyze(self, *_):
            raise RuntimeError("down")

    r = pipeline.Pipeline(spark, vision=Broken, embedder=Broken).process(str(folder / "i.png") if (folder / "i.png").exists() else str(folder / "sub" / "i.png"))
    assert [tuple(x) for x in r.degradations.select("stage", "error").orderBy("stage").collect()] == [("embed_image", "no vector"), ("vision", "RuntimeError: down")]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    for n in range(3):
        (tmp_path / "in" / f"f{n}.txt").write_text(f"Some words of file number {n}.")
        streaming.ingest(spark, str(tmp_path / "in"), out, mark, files_per_batch=1).awaitTermination(120)
    got = sorted(r["chunk_id"] for r in spark.read.parquet(out).collect())
    assert got == [f"f{n}__p1_text_0" for n in range(3)]

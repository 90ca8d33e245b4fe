"""Pictures of PDF files, frames, wrong names; fonts of one byte; models called once; uploads; what a store keeps."""

import base64
import logging
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone import providers, sinks
from quernstone.operators import chunking
from quernstone.plans import pipeline
from quernstone.sources import formats, office, pdf, pixels
from tests.test_chunking import pages
from tests.test_sources import R, REL, noise, png, rel, zipped

STAMP = "2024-01-01T00:00:00Z"


def pdf_of(objects):
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj%s\nendobj\n" % (n, body) for n, body in objects.items()) + b"trailer<</Root 1 0 R>>\nstartxref\n0\n%%EOF"


def stream(head, data):
    return b"<<%s/Length %d>>stream\n%s\nendstream" % (head, len(data), data)


def book(content, fonts=b"", outside=b"", more=None):
    return pdf_of({1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[3 0 R 4 0 R]/Count 2>>", 3: b"<</Type/Page/Contents 5 0 R/Resources 6 0 R>>", 4: b"<</Type/Page/Contents 5 0 R/Resources 6 0 R>>", 5: stream(b"", content), 6: b"<</Font<<%s>>/XObject<<%s>>>>" % (fonts, outside)} | (more or {}))


def test_fonts_of_one_byte_with_a_map():
    cmap = b"1 begincodespacerange <00> <FF> endcodespacerange 2 beginbfchar <48> <0048> <01> <00E9> endbfchar 1 beginbfrange <61> <7A> <0061> endbfrange"
    simple = {7: b"<</Type/Font/Subtype/TrueType/ToUnicode 8 0 R>>", 8: stream(b"", cmap)}
    _, found, _ = pdf.read(book(b"BT /F1 9 Tf (Hello simple font \\001) Tj ET", b"/F1 7 0 R", more=simple), "b")
    assert [p["txt"] for p in found] == ["Hello simple font é"] * 2
    wide = {7: b"<</Type/Font/Subtype/Type0/ToUnicode 8 0 R>>", 8: stream(b"", b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0102> <4F60> endbfchar")}
    assert pdf.read(book(b"BT /F1 9 Tf <01020102> Tj ET", b"/F1 7 0 R", more=wide), "b")[1][0]["txt"] == "你你"


def test_a_page_of_an_unknown_filter_costs_that_page_only():
    odd = {4: b"<</Type/Page/Contents 9 0 R/Resources 6 0 R>>", 9: stream(b"/Filter/LZWDecode", b"xx")}
    meta, found, _ = pdf.read(book(b"BT (fine) Tj ET", more=odd), "b")
    assert [p["txt"] for p in found] == ["fine", ""] and meta["unread_pages"] == 1
    with pytest.raises(ValueError, match="LZW"):
        pdf.read(book(b"", more=odd | {3: odd[4]}), "b")


def test_pictures_of_a_pdf():
    grey, rgb = np.arange(12, dtype=np.uint8).reshape(3, 4), noise(4, 3)
    jpeg = b"\xff\xd8\xff\xe0 not really"
    predicted = zlib.compress(b"".join(b"\0" + r.tobytes() for r in rgb))
    size = b"/Subtype/Image/Width 4/Height 3/BitsPerComponent 8"
    more = {
        10: stream(size + b"/ColorSpace/DeviceGray", grey.tobytes()),
        11: stream(size + b"/ColorSpace/DeviceRGB/Filter/FlateDecode", zlib.compress(rgb.tobytes())),
        12: stream(size + b"/ColorSpace/DeviceRGB/Filter/DCTDecode", jpeg),
        13: stream(size + b"/ColorSpace[/ICCBased 20 0 R]/Filter/FlateDecode/DecodeParms<</Predictor 15/Colors 3/Columns 4>>", predicted),
        14: stream(size + b"/ColorSpace/DeviceCMYK", b"x" * 48),
        15: stream(b"/Subtype/Form", b""),
        20: b"<</N 3>>",
    }
    meta, _, found = pdf.read(book(b"", outside=b"".join(b"/X%d %d 0 R" % (n, n) for n in range(10, 16)), more=more), "b")
    assert [(p["image_id"], p["pg_num"], p["img_idx"], p["ext"]) for p in found] == [(f"b__p1_img{n}", 1, n, e) for n, e in enumerate(["png", "png", "jpeg", "png"])]
    assert (pixels.png_pixels(found[0]["image_bytes"])[..., 0] == grey).all()
    assert all((pixels.png_pixels(found[n]["image_bytes"])[..., :3] == rgb).all() for n in (1, 3)) and found[2]["image_bytes"] == jpeg
    assert meta["duplicate_images"] == 6


def tiff(sizes):
    out, at = b"II*\0", 8
    out += struct.pack("<I", at)
    for n, (w, h) in enumerate(sizes):
        follow = at + 2 + 24 + 4
        out += struct.pack("<H", 2) + struct.pack("<HHII", 256, 4, 1, w) + struct.pack("<HHII", 257, 4, 1, h) + struct.pack("<I", follow if n + 1 < len(sizes) else 0)
        at = follow
    return out


def test_frames_of_a_tiff_and_wrong_names():
    meta, found, pictures = formats.image(tiff([(30, 20), (50, 40), (7, 9)]), "t", "tif")
    assert meta["page_count"] == len(found) == 3 and [p["image_id"] for p in pictures] == ["t__p1_img0", "t__p2_img0", "t__p3_img0"]
    assert [pixels.size_of(p["image_bytes"]) for p in pictures] == [(30, 20), (50, 40), (7, 9)]
    loop = bytearray(tiff([(1, 2)]))
    loop[-4:] = struct.pack("<I", 8)
    assert len(pixels.tiff_frames(bytes(loop))) == 1 and len(formats.image(b"II*\0", "t", "tiff")[2]) == 1
    assert formats.image(png(noise()), "x", "jpg")[2][0]["ext"] == "png"


def test_text_in_content_controls_and_the_page_of_a_picture():
    W = 'xmlns:w="http://w"'
    p = "<w:p><w:r><w:t>{}</w:t></w:r></w:p>"
    image = '<w:r><a:blip xmlns:a="http://a" r:embed="r1"/></w:r>'
    body = p.format("out") + f"<w:sdt><w:sdtContent>{p.format('inside')}</w:sdtContent></w:sdt><w:p>{image}<w:r><w:br w:type=\"page\"/><w:t>next</w:t></w:r></w:p>"
    data = zipped({"word/document.xml": f"<w:document {W} {R}><w:body>{body}</w:body></w:document>", "word/_rels/document.xml.rels": REL.format(rel("r1", "image", "media/image1.emf")), "word/media/image1.emf": png(noise())})
    meta, found, pictures = office.word(data, "d")
    assert [x["txt"] for x in found] == ["out\ninside", "next"] and [(i["pg_num"], i["ext"]) for i in pictures] == [(1, "png")] and meta["duplicate_images"] == 0


def test_pictures_of_one_name_in_two_folders_keep_their_vectors(spark):
    one = [{"img_id": "x__p1_img0", "img_idx": 0, "img_path": "p", "ocr_text": "", "caption": "c", "description": "d"}]
    two = pages(spark, doc_id="/a/x.png", imgs=one).union(pages(spark, doc_id="/b/x.png", imgs=one))
    vectors = spark.createDataFrame([("/a/x.png", "x__p1_img0", [1.0]), ("/b/x.png", "x__p1_img0", [2.0])], "doc_id string, img_id string, embedding array<float>")
    assert sorted((r["doc_id"], r["embedding"]) for r in chunking.chunk_pages(two, image_embeddings=vectors).collect()) == [("/a/x.png", [1.0]), ("/b/x.png", [2.0])]


@pytest.mark.parametrize("stored", [True, False])
def test_each_model_is_called_once_a_row(spark, tmp_path, stored):
    (tmp_path / "in").mkdir()
    for n in range(3):
        (tmp_path / "in" / f"i{n}.png").write_bytes(png(noise(seed=n)))
    (tmp_path / "in" / "t.txt").write_text("Some words in a text file.")
    seen, told = str(tmp_path / "seen"), str(tmp_path / "told")

    class Vision:
        def analyze(self, image, ext, width, height):
            with open(seen, "a") as f:
                f.write("x\n")
            return "a caption", "", f"of {len(image)} bytes"

    class Embedder:
        dim = 2

        def embed(self, texts):
            with open(told, "a") as f:
                f.write("".join("x\n" for _ in texts))
            return [[1.0, 2.0] for _ in texts]

    p = pipeline.Pipeline(spark, pipeline.Config(timestamp=STAMP), vision=Vision, embedder=Embedder, store=str(tmp_path / "out") if stored else None)
    result = p.process_batch(str(tmp_path / "in"))
    for _ in range(2):
        assert result.images.count() == 3 and result.chunks.count() == 4 and result.degradations.count() == 0
        assert result.summary().first()["succeeded"] == 4 and result.index_documents(STAMP).count() == 4
    calls = [len(open(f).read().split()) for f in (seen, told)]
    assert calls == [3, 3 + 1]
    if stored:
        kept = {r["image_id"]: bytes(r["image_bytes"]) for r in spark.read.parquet(str(tmp_path / "out" / "images")).collect()}
        assert kept == {f"i{n}__p1_img0": png(noise(seed=n)) for n in range(3)}
        assert p.process_batch(str(tmp_path / "in")).documents.count() == 0


def test_settings_have_an_effect(spark, tmp_path):
    (tmp_path / "s.png").write_bytes(png(noise(60, 50)))
    (tmp_path / "l.png").write_bytes(png(noise(90, 80)))
    count = lambda **c: pipeline.Pipeline(spark, pipeline.Config(**c)).process_batch(str(tmp_path)).images.count()
    assert (count(), count(min_side=80), count(min_side=40, workers=2)) == (0, 1, 2)
    r = pipeline.Pipeline(spark, pipeline.Config(workers=2)).process_batch(f"file://{tmp_path}")
    assert sorted(x["base_name"] for x in r.documents.collect()) == ["l", "s"]


def test_adapters(caplog):
    sent = []

    def post(url, body, headers):
        sent.append((url, body, headers))
        if "input" in body:
            return {"data": [{"index": 1, "embedding": [1.0]}]}
        return {"choices": [{"message": {"content": "CAPTION: a cat\nOCR_TEXT: none\nmore\nDESCRIPTION: sits\nCaption: again"}}]}

    assert providers.ChatVision("http://u", "m", "k", post=post).analyze(b"abc", "jpg", 1, 2) == ("a cat", "none\nmore", "sits")
    url, body, headers = sent[0]
    assert (url, headers, body["model"]) == ("http://u", {"Authorization": "Bearer k"}, "m")
    assert body["messages"][0]["content"][1]["image_url"]["url"] == "data:image/jpeg;base64," + base64.b64encode(b"abc").decode()
    with pytest.raises(ValueError):
        providers.ChatVision("http://u", "m", post=post).analyze(b"", "png", None, None)
    assert providers.reply_parts(" no labels ") == ("", "", "no labels")
    with caplog.at_level(logging.WARNING):
        assert providers.RestEmbedder("http://e", "m", 1, post=post).embed(["a", "b", "c"]) == [None, [1.0], None]
    assert "2 of 3" in caplog.text


def test_uploads(spark):
    headers = spark.createDataFrame([("d", "d.txt", "/d", 1)], "doc_id string, file_name string, file_path string, total_pgs int")
    docs = chunking.index_documents(chunking.chunk_pages(pages(spark, txt="Some words to keep here.", tables=[[["h"], ["v"]]])), headers, STAMP)

    def picky():
        return lambda rows: [r["chunk_type"] == "text" for r in rows]

    def broken():
        def send(rows):
            raise OSError("closed")

        return send

    status = lambda make: sorted((r["id"], r["status"], r["error"]) for r in sinks.upload(docs, make, 1).collect())
    assert [s for _, s, _ in status(picky)] == ["failed", "uploaded"]
    assert {(s, e) for _, s, e in status(broken)} == {("failed", "OSError: closed")}
    assert {s for _, s, _ in status(lambda: lambda rows: None)} == {"uploaded"}


def test_an_exact_token_count(spark):
    got = chunking.chunk_pages(pages(spark, txt="Some words to keep here."), count=lambda c: F.length(c)).first()
    assert got["token_cnt"] == len("Some words to keep here.")

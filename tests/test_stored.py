"""Chunk files, splitting to single documents, logos, the data source, the command line's pieces."""

import json

from pyspark.sql import functions as F

from quernstone.operators import chunking
from quernstone.plans import pipeline
from quernstone.sinks import Store
from quernstone.sources import stored
from tests.test_chunking import pages
from tests.test_sources import noise, png

STAMP = "2024-01-01T00:00:00Z"


def chunk(i, **more):
    return {"chunk_id": f"doc__p1_text_{i}", "chunk_type": "text", "pg_num": 1, "chunk_idx": i, "content": f"words of {i}", "token_cnt": 3, "metadata": {"total_txt_chunks_on_pg": 2}, "embedding": None} | more


def test_chunk_files(spark, tmp_path):
    echo = "Slide: t\n\nCaption: c\n\nDescription: CAPTION: c\nOCR_TEXT: x\nDESCRIPTION: new"
    image = chunk(0, chunk_id="doc__p1_image_0", chunk_type="image", content=echo, metadata={"img_id": "i", "img_path": "p"}, embedding=[1.0, 2.0])
    path = tmp_path / "a_chunks.json"
    path.write_text(json.dumps({"_header": {"file_path": "/in/a.PDF", "file_name": "a.PDF", "total_pgs": 3}, "chunks": [chunk(0), chunk(1, content="  "), image]}, indent=1))
    rows = {r["id"]: r for r in stored.index_chunk_files(spark, str(path), timestamp=STAMP).collect()}
    assert sorted(rows) == ["doc__p1_image_0", "doc__p1_text_0"]
    assert rows["doc__p1_image_0"]["content"].endswith("Description: new") and rows["doc__p1_image_0"]["content_vector"] == [1.0, 2.0]
    assert (rows["doc__p1_text_0"]["total_pgs"], rows["doc__p1_text_0"]["file_type"], rows["doc__p1_text_0"]["img_id"]) == (3, "pdf", None)
    assert stored.index_chunk_files(spark, str(path), timestamp=STAMP, skip_empty=False).count() == 3
    assert [r["chunk_type"] for r in stored.shrunk(stored.chunk_files(spark, str(path))).where("shrunk").collect()] == ["image"]


def test_both_ways_to_index_documents_agree(spark, tmp_path):
    chunks = chunking.chunk_pages(pages(spark, txt="Some words to keep here.", tables=[[["h"], ["v"]]]))
    headers = spark.createDataFrame([("d", "d.txt", "/in/d.txt", 1)], "doc_id string, file_name string, file_path string, total_pgs int")
    own = chunking.index_documents(chunks, headers, STAMP)
    rows = [r.asDict(recursive=True) for r in chunks.collect()]
    (tmp_path / "c.json").write_text(json.dumps({"_header": {"file_path": "/in/d.txt", "file_name": "d.txt", "total_pgs": 1}, "chunks": [{k: v for k, v in r.items() if k not in ("doc_id", "ord")} for r in rows]}))
    other = stored.index_chunk_files(spark, str(tmp_path / "c.json"), timestamp=STAMP)
    assert sorted(map(tuple, own.collect()), key=repr) == sorted(map(tuple, other.select(own.columns).collect()), key=repr)


def test_splitting_skips_what_is_there(spark, tmp_path):
    docs = chunking.index_documents(chunking.chunk_pages(pages(spark, txt="Some words to keep here.", tables=[[["h"], ["v"]]])), spark.createDataFrame([("d", "d.txt", "/d", 1)], "doc_id string, file_name string, file_path string, total_pgs int"), STAMP)
    store = Store(spark, str(tmp_path))
    first = store.split("single", docs.withColumn("shrunk", F.col("chunk_type") == "table")).first()
    assert (first["created"], first["skipped"], first["failed"], first["deduped"]) == (2, 0, 0, 1)
    again = store.split("single", docs).first()
    assert (again["created"], again["skipped"]) == (0, 2)
    lines = [json.loads(r["value"]) for r in spark.read.text(store.path("single")).collect()]
    assert len(lines) == 2 and all(x["content_vector"] is None for x in lines) and {"num_rows" in x for x in lines} == {True, False}


def test_logos_and_their_rejection(spark, tmp_path):
    (tmp_path / "refs").mkdir()
    (tmp_path / "refs" / "logo.png").write_bytes(png(noise(seed=7)))
    (tmp_path / "refs" / "broken.png").write_bytes(b"x")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "same.png").write_bytes(png(noise(seed=7)))
    (tmp_path / "in" / "other.png").write_bytes(png(noise(seed=8)))
    refs = stored.logos(str(tmp_path / "refs"))
    assert [n for n, _ in refs] == ["logo.png"] and stored.logos(str(tmp_path / "none")) == []
    p = pipeline.Pipeline(spark, references=refs)
    result = p.process_batch(str(tmp_path / "in"))
    assert [r["image_id"] for r in result.images.collect()] == ["other__p1_img0"]
    seen = []

    def tell(path, error):
        seen.append((path.rpartition("/")[2], error))
        raise RuntimeError("ignored")

    p.report(result, tell)
    assert sorted(seen) == [("other.png", None), ("same.png", None)]


def test_data_source(spark, tmp_path):
    (tmp_path / ".hidden.txt").write_text("a")
    (tmp_path / "empty.txt").write_text("")
    stored.register(spark)
    rows = spark.read.format("quernstone_files").load(str(tmp_path)).collect()
    assert sorted((r["path"].rpartition("/")[2], bytes(r["content"])) for r in rows) == [(".hidden.txt", b"a"), ("empty.txt", b"")]

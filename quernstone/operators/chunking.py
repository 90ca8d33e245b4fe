"""From pages to chunks and from chunks to index documents.

A page becomes its chunks without a shuffle: only the window splitter runs in Python, on Arrow batches of the page's text blocks;
what is counted, numbered and named is native and looks at one row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.batches import lean, small_batches
from quernstone.functions import text as X

TARGET, OVERLAP = 500, 50
PAGE = "doc_id string, base_name string, pg_num int, kind string, title string, txt string, tables array<array<array<string>>>, elements array<struct<type:string,content:string,rows:array<array<string>>>>, hyperlinks array<string>, imgs array<struct<img_id:string,img_idx:int,img_path:string,ocr_text:string,caption:string,description:string>>"
CHUNK = "struct<chunk_type:string,chunk_idx:int,content:string,total_txt_chunks_on_pg:int,num_rows:int,num_col:int,img_id:string,img_path:string>"
_BOUNDARY = re.compile(r"\n(?=[0-9A-Z])|\n\n+|(?<=[!.?])\s+")


def split_sentences(text: str) -> list[str]:
    return [s for s in map(str.strip, _BOUNDARY.split(text.strip())) if s]


def estimate(text: str) -> int:
    return max(1, len(text.split()) * 13 // 10) if text else 0


def split_windows(text: str, target: int = TARGET, overlap: int = OVERLAP) -> list[str]:
    """Windows of whole sentences of at most ``target`` estimated tokens that share about ``overlap`` with the one before.

    A sentence that alone reaches the target is a window of its own, and its last words open the next one; these alone are never
    a window, and go if the next sentence doesn't fit behind them.
    """
    out: list[str] = []
    held: list[tuple[str, int]] = []
    total, bare = 0, False
    for s in split_sentences(text):
        size = estimate(s)
        if size >= target:
            if held and not bare:
                out.append(" ".join(x for x, _ in held))
            out.append(s)
            tail = s.split()[-max(1, overlap) :]
            # as words the tail counts one token each, as a sentence it would count more
            held, total, bare = [(" ".join(tail), estimate(" ".join(tail)))], len(tail), True
            continue
        if held and total + size > target:
            if bare:
                held, total = [], 0
            else:
                out.append(" ".join(x for x, _ in held))
                first, total = len(held) - 1, held[-1][1]
                while first and total + held[first - 1][1] <= overlap:
                    first -= 1
                    total += held[first][1]
                held = held[first:]
        held.append((s, size))
        total, bare = total + size, False
    if held and not bare:
        out.append(" ".join(x for x, _ in held))
    return out


def windows(text: Column, target: int = TARGET, overlap: int = OVERLAP) -> Column:
    """split_windows() of a column; NULL gives none."""

    @F.pandas_udf("array<string>")
    @lean
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([split_windows(t or "", target, overlap) for t in texts], dtype=object)

    return run(text)


def _block_windows(blocks: Column, target: int, overlap: int) -> Column:
    """For each text of an array its windows of at least LEAST_TOKENS tokens."""

    @F.pandas_udf("array<array<string>>")
    @lean
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in parts:
            yield pd.Series([[[w for w in split_windows(t or "", target, overlap) if estimate(w) >= X.LEAST_TOKENS] for t in (() if row is None else row)] for row in rows], dtype=object)

    return run(blocks)


def _blocks(elements: Column) -> Column:
    """Neighbouring texts of a page's elements as one, a table between them apart."""
    kind = "struct<type:string,content:string,rows:array<array<string>>>"

    def fold(acc: Column, e: Column) -> Column:
        last = F.element_at(acc, -1)
        merged = F.struct(F.lit("text").alias("type"), F.concat_ws("\n\n", last["content"], X.filled(e["content"])).alias("content"), F.lit(None).cast("array<array<string>>").alias("rows")).cast(kind)
        own = F.struct(e["type"].alias("type"), X.filled(e["content"]).alias("content"), e["rows"].alias("rows")).cast(kind)
        return F.when((e["type"] == "text") & (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["type"] == "text"), F.concat(F.slice(acc, F.lit(1), F.greatest(F.lit(0), F.size(acc) - 1)), F.array(merged))).when(e["type"].isin("text", "table"), F.concat(acc, F.array(own))).otherwise(acc)

    return F.aggregate(elements, F.array().cast(f"array<{kind}>"), fold)


def chunk_pages(pages: DataFrame, target: int = TARGET, overlap: int = OVERLAP, image_embeddings: DataFrame | None = None, count: Callable[[Column], Column] = X.estimate_tokens) -> DataFrame:
    """Chunks of pages (PAGE, of which absent columns count as NULL): text windows, tables as Markdown, image descriptions.

    A page with ``elements`` gives texts and tables in their order; any other one its text with links, then its tables, all behind the
    line that names the slide or sheet. Texts of fewer than LEAST_TOKENS tokens are dropped before numbering, blank
    tables after. ``ord`` is the place in the page. image_embeddings: (doc_id, img_id, embedding) to reuse; identifiers of images are made of file names, so two documents may have the same. count: a chunk's token_cnt from its text, by default the estimate; a tokenizer's exact count is a pandas UDF here.
    """
    small_batches(pages.sparkSession)
    p = pages
    for field in PAGE.split(", ", 1)[1].split(", "):
        name, kind = field.split(" ", 1)
        if name not in p.columns:
            p = p.withColumn(name, F.lit(None).cast(kind))
    p = p.withColumn("context", X.page_context(F.col("kind"), F.col("title")))
    element = "struct<type:string,content:string,rows:array<array<string>>>"
    as_element = lambda kind, content, rows: F.struct(F.lit(kind).alias("type"), content.alias("content"), rows.alias("rows")).cast(element)
    plain = F.concat(F.array(as_element("text", X.with_links(F.col("txt"), F.col("hyperlinks")), F.lit(None))), F.transform(F.coalesce("tables", F.array().cast("array<array<array<string>>>")), lambda t: as_element("table", F.lit(None), t)))
    p = p.withColumn("blocks", F.when(F.col("elements").isNotNull(), _blocks(F.col("elements"))).otherwise(plain))
    p = p.withColumn("split", _block_windows(F.transform("blocks", lambda b: F.when(b["type"] == "text", b["content"])), target, overlap))
    prefix = F.when(F.col("elements").isNull() & (F.col("context") != ""), F.concat("context", F.lit("\n\n"))).otherwise(F.lit(""))
    total = F.size(F.flatten("split"))

    def chunk(kind: str, idx: Column, content: Column, **more: Column) -> Column:
        names = ("total_txt_chunks_on_pg", "num_rows", "num_col", "img_id", "img_path")
        return F.struct(F.lit(kind).alias("chunk_type"), idx.cast("int").alias("chunk_idx"), content.alias("content"), *[more.get(n, F.lit(None)).alias(n) for n in names]).cast(CHUNK)

    def block(b: Column, i: Column) -> Column:
        before = F.size(F.flatten(F.slice("split", F.lit(1), i)))
        texts = F.transform(F.get("split", i), lambda w, j: chunk("text", before + j, F.concat(prefix, w), total_txt_chunks_on_pg=total))
        earlier = F.size(F.filter(F.slice("blocks", F.lit(1), i), lambda x: x["type"] == "table"))
        table = F.array(chunk("table", earlier, X.table_markdown(b["rows"]), num_rows=F.size(b["rows"]), num_col=F.size(F.get(b["rows"], F.lit(0)))))
        return F.when(b["type"] == "text", texts).otherwise(F.transform(F.filter(table, lambda c: X.filled(c["content"]) != ""), lambda c: c.withField("content", F.concat(prefix, c["content"]))))

    body = F.flatten(F.transform("blocks", block))
    images = F.transform(F.coalesce("imgs", F.array().cast(dict(x.split(" ", 1) for x in PAGE.split(", "))["imgs"])), lambda m: chunk("image", F.coalesce(m["img_idx"], F.lit(0)), X.image_content(m["caption"], m["ocr_text"], m["description"], F.col("context")), img_id=X.filled(m["img_id"]), img_path=X.filled(m["img_path"])))
    images = F.filter(images, lambda c: c["content"] != "")
    out = p.select("doc_id", "base_name", "pg_num", F.posexplode(F.concat(body, images)).alias("ord", "c"))
    key = X.safe_key(F.concat("base_name", F.lit("__p"), F.col("pg_num").cast("string"), F.lit("_"), F.col("c.chunk_type"), F.lit("_"), F.col("c.chunk_idx").cast("string")))
    meta = F.struct(*[F.col(f"c.{n}") for n in ("total_txt_chunks_on_pg", "num_rows", "num_col", "img_id", "img_path")])
    out = out.select("doc_id", key.alias("chunk_id"), F.col("c.chunk_type").alias("chunk_type"), "pg_num", F.col("c.chunk_idx").alias("chunk_idx"), F.col("c.content").alias("content"), count(F.col("c.content")).alias("token_cnt"), meta.alias("metadata"), "ord")
    if image_embeddings is None:
        return out.withColumn("embedding", F.lit(None).cast("array<float>"))
    known = image_embeddings.select(F.col("doc_id").alias("known_doc"), F.col("img_id").alias("known_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    same = (F.col("chunk_type") == "image") & (F.col("doc_id") == F.col("known_doc")) & (F.col("metadata.img_id") == F.col("known_id"))
    return out.join(known, same, "left").drop("known_doc", "known_id")


def index_documents(chunks: DataFrame, headers: DataFrame, timestamp: str, skip_empty: bool = True) -> DataFrame:
    """Flat index documents of chunks; headers: (doc_id, file_name, file_path, total_pgs). ``doc_id`` becomes what precedes the
    first double underscore of the chunk's identifier. With ``skip_empty`` those without text go."""
    h = headers.select(F.col("doc_id").alias("header_id"), "file_name", "file_path", "total_pgs")
    rows = chunks.join(h, F.col("doc_id") == F.col("header_id"), "left")
    content = F.when(F.col("chunk_type") == "image", X.drop_echo(X.filled(F.col("content")))).otherwise(X.filled(F.col("content")))
    own = lambda kind, name: F.when(F.col("chunk_type") == kind, F.col(f"metadata.{name}")).alias(name)
    out = rows.select(
        X.safe_key(X.filled(F.col("chunk_id"))).alias("id"), F.substring_index(X.filled(F.col("chunk_id")), "__", 1).alias("doc_id"), X.filled(F.col("file_name")).alias("file_name"), X.filled(F.col("file_path")).alias("file_path"),
        X.file_type(X.filled(F.col("file_name"))).alias("file_type"), F.coalesce("total_pgs", F.lit(0)).cast("int").alias("total_pgs"), F.coalesce("chunk_type", F.lit("unknown")).alias("chunk_type"),
        F.coalesce("pg_num", F.lit(0)).alias("pg_num"), F.coalesce("chunk_idx", F.lit(0)).alias("chunk_idx"), F.coalesce("token_cnt", F.lit(0)).alias("token_cnt"), content.alias("content"),
        F.col("embedding").alias("content_vector"), F.lit(timestamp).alias("last_updated"),
        own("text", "total_txt_chunks_on_pg"), own("table", "num_rows"), own("table", "num_col"), own("image", "img_id"), own("image", "img_path"),
    )
    return out.where(F.col("content").rlike(X.NOT_WS)) if skip_empty else out


INDEX_FIELDS = (
    ("id", "String", True), ("doc_id", "String", False), ("file_name", "String", False), ("file_path", "String", False), ("file_type", "String", False), ("total_pgs", "Int32", False),
    ("chunk_type", "String", False), ("pg_num", "Int32", False), ("chunk_idx", "Int32", False), ("token_cnt", "Int32", False), ("content", "String", False), ("content_vector", "Collection(Single)", False),
    ("last_updated", "String", False), ("total_txt_chunks_on_pg", "Int32", False), ("num_rows", "Int32", False), ("num_col", "Int32", False), ("img_id", "String", False), ("img_path", "String", False),
)


def index_schema(name: str, dimensions: int = 1024) -> dict:
    """A search index's description: its fields with types, the key, and the profile of the vector field."""
    fields = []
    for field, kind, key in INDEX_FIELDS:
        one = {"name": field, "type": kind, "key": key}
        if kind.startswith("Collection"):
            one |= {"dimensions": dimensions, "vectorSearchProfile": "hnsw-profile"}
        fields.append(one)
    return {"name": name, "fields": fields, "vectorSearch": {"algorithms": [{"name": "hnsw", "kind": "hnsw"}], "profiles": [{"name": "hnsw-profile", "algorithm": "hnsw"}]}}

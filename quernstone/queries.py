"""The engine's own queries over the driver tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import text as X
from quernstone.operators import chunking, images, runs
from quernstone.sinks import json_line

STAMP = "2024-01-01T00:00:00Z"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# SQL fragments
_WS = "' ' || chr(10) || chr(9) || chr(13)"
_EST = "CASE WHEN coalesce({0}, '') = '' THEN 0 ELSE greatest(1, len(regexp_extract_all({0}, '\\S+')) * 13 // 10) END::INT"
_SENTENCES = f"list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(trim(coalesce(text, ''), {_WS}), '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\n{{2,}}', chr(1), 'g'), '\\n([A-Z0-9])', chr(1) || '\\1', 'g'), chr(1)), lambda x: trim(x, {_WS})), lambda x: x <> '')"


def _windows_sql(target: int, overlap: int, texts: str = "documents") -> str:
    """The window splitter as a recursive query over (doc_id, text): (doc_id, idx, content, token_cnt)."""
    return f"""RECURSIVE l AS MATERIALIZED (SELECT doc_id, s, list_transform(s, lambda x: {_EST.format('x')}) AS e FROM (SELECT doc_id, {_SENTENCES} AS s FROM {texts})),
    p AS MATERIALIZED (SELECT doc_id, e, list_prepend(0, list_transform(range(1, len(e) + 1), lambda k: list_sum(e[1:k])::INT)) AS acc FROM l WHERE len(e) > 0),
    walk AS (
      SELECT doc_id, 0 AS i, 1 AS a, 0 AS tok, NULL::INT AS tail, false AS bare, false AS cut, NULL::INT AS ct, 0 AS ca, false AS big FROM p
      UNION ALL
      SELECT doc_id, i + 1,
        CASE WHEN bigger THEN i + 2 WHEN over AND bare THEN i + 1 WHEN over THEN j ELSE a END,
        CASE WHEN bigger THEN least(nw, greatest(1, {overlap})) WHEN over AND bare THEN size WHEN over THEN acc[i + 1] - acc[j] + size ELSE tok + size END,
        CASE WHEN bigger THEN i + 1 WHEN over THEN NULL ELSE tail END, bigger,
        (bigger AND held AND NOT bare) OR (over AND NOT bare), tail, a, bigger
      FROM (SELECT *, NOT bigger AND held AND tok + size > {target} AS over,
              CASE WHEN i >= a THEN a + len(list_filter(range(a, i), lambda k: acc[i + 1] - acc[k] > {overlap})) ELSE a END AS j
            FROM (SELECT w.*, p.acc, p.e[w.i + 1] AS size, p.e[w.i + 1] >= {target} AS bigger, (w.tail IS NOT NULL OR w.i >= w.a) AS held, len(regexp_extract_all(l.s[w.i + 1], '\\S+')) AS nw
                  FROM walk w JOIN p USING (doc_id) JOIN l USING (doc_id) WHERE w.i < len(p.e))))
    , parts AS (
      SELECT doc_id, i, 1 AS o, ct AS tail, ca AS a, i - 1 AS b FROM walk WHERE cut
      UNION ALL SELECT doc_id, i, 2, NULL, i, i FROM walk WHERE big
      UNION ALL SELECT w.doc_id, w.i, 3, w.tail, w.a, w.i FROM walk w JOIN p USING (doc_id) WHERE w.i = len(p.e) AND NOT w.bare),
    said AS (SELECT doc_id, i, o, concat_ws(' ', CASE WHEN tail IS NOT NULL THEN array_to_string(regexp_extract_all(s[tail], '\\S+')[-{max(1, overlap)}:], ' ') END, nullif(array_to_string(s[a:b], ' '), '')) AS content FROM parts JOIN l USING (doc_id)),
    chunks AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i, o) - 1)::INT AS chunk_idx, content, {_EST.format('content')} AS token_cnt FROM said WHERE {_EST.format('content')} >= 3)"""


def _doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as the one page of a text file."""
    return _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("base_name"), F.lit(1).alias("pg_num"), F.col("text").alias("txt"))


@query(f"SELECT doc_id, (n - 1)::INT AS n, s[n] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS n FROM (SELECT doc_id, {_SENTENCES} AS s FROM documents))")
def sentence_split(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("n", "sentence"))


@query(f"SELECT doc_id, {_EST.format('text')} AS n_tokens FROM documents")
def token_estimate(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", X.estimate_tokens(F.col("text")).alias("n_tokens"))


_CHUNKS = "SELECT doc_id::VARCHAR AS doc_id, 'doc_' || doc_id || '__p1_text_' || chunk_idx AS chunk_id, chunk_idx, content, token_cnt, (count(*) OVER (PARTITION BY doc_id))::INT AS on_page FROM chunks"


def _chunked(spark, sf_dir, target, overlap):
    out = chunking.chunk_pages(_doc_pages(spark, sf_dir), target, overlap)
    return out.select("doc_id", "chunk_id", "chunk_idx", "content", "token_cnt", F.col("metadata.total_txt_chunks_on_pg").alias("on_page"))


@query(f"WITH {_windows_sql(500, 50)} {_CHUNKS}")
def chunk_text(spark, sf_dir):
    return _chunked(spark, sf_dir, 500, 50)


@query(f"WITH {_windows_sql(200, 20)} {_CHUNKS}")
def chunk_text_small(spark, sf_dir):
    return _chunked(spark, sf_dir, 200, 20)


@query(f"WITH {_windows_sql(500, 50)} SELECT doc_id::VARCHAR AS doc_id, count(*) AS chunks, sum(token_cnt)::BIGINT AS tokens, max(token_cnt) AS longest FROM chunks GROUP BY doc_id")
def chunk_page_stats(spark, sf_dir):
    return _chunked(spark, sf_dir, 500, 50).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("token_cnt").alias("tokens"), F.max("token_cnt").alias("longest"))


_INDEX = f"""SELECT 'doc_' || doc_id || '__p1_text_' || chunk_idx AS id, 'doc_' || doc_id AS doc_id, 'doc_' || doc_id || '.txt' AS file_name, '/in/doc_' || doc_id || '.txt' AS file_path, 'txt' AS file_type, 1 AS total_pgs, 'text' AS chunk_type, 1 AS pg_num,
 chunk_idx, token_cnt, content, '{STAMP}' AS last_updated, (count(*) OVER (PARTITION BY doc_id))::INT AS total_txt_chunks_on_pg FROM chunks"""


@query(f"WITH {_windows_sql(500, 50)} {_INDEX}")
def index_docs(spark, sf_dir):
    pages = _doc_pages(spark, sf_dir)
    name = F.concat("base_name", F.lit(".txt"))
    headers = pages.select("doc_id", name.alias("file_name"), F.concat(F.lit("/in/"), name).alias("file_path"), F.lit(1).alias("total_pgs"))
    return chunking.index_documents(chunking.chunk_pages(pages), headers, STAMP).drop("content_vector", "num_rows", "num_col", "img_id", "img_path")


@query("SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_=-]', '_', 'g') AS key FROM pages")
def safe_key(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", X.safe_key(F.col("url")).alias("key"))


def _region_tables(spark, sf_dir):
    n = _read(spark, sf_dir, "nation")
    row = F.struct("n_nationkey", F.array(F.col("n_nationkey").cast("string"), F.concat("n_name", F.lit(" | "), F.col("n_regionkey").cast("string"))).alias("r"))
    t = n.groupBy("n_regionkey").agg(F.sort_array(F.collect_list(row)).alias("g"))
    return t.select("n_regionkey", F.concat(F.array(F.array(F.lit("key"), F.lit("name"), F.lit("note"))), F.transform("g", lambda x: x["r"])).alias("t"))


@query("""SELECT n_regionkey, '| key | name | note |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' \\| ' || n_regionkey || ' |  |', chr(10) ORDER BY n_nationkey) AS markdown,
 (count(*) + 1)::INT AS num_rows, 3 AS num_col FROM nation GROUP BY n_regionkey""")
def table_markdown(spark, sf_dir):
    t = F.col("t")
    return _region_tables(spark, sf_dir).select("n_regionkey", X.table_markdown(t).alias("markdown"), F.size(t).alias("num_rows"), F.size(F.get(t, F.lit(0))).alias("num_col"))


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 <> 0")
def table_blank_filter(spark, sf_dir):
    s = _read(spark, sf_dir, "supplier")
    t = F.array(F.array(F.lit(" "), F.lit(None).cast("string")), F.array(F.lit("\n"), F.when(F.col("s_suppkey") % 3 == 0, F.lit("\t")).otherwise(F.col("s_name"))))
    return s.where(~X.is_blank_table(t)).select("s_suppkey")


@query("""SELECT p_brand, 'Sheet: ' || p_brand || chr(10) || 'Columns: Part, col_1, Size' || chr(10) || 'Total rows: ' || count(*) || chr(10) || chr(10) || string_agg('Part: ' || p_name || CASE WHEN p_size % 2 = 0 THEN ' | col_1: ' || p_type ELSE '' END || ' | Size: ' || p_size, chr(10) || chr(10) ORDER BY p_partkey) AS sheet FROM part GROUP BY p_brand""")
def sheet_text(spark, sf_dir):
    p = _read(spark, sf_dir, "part")
    row = F.array("p_name", F.when(F.col("p_size") % 2 == 0, F.col("p_type")), F.col("p_size").cast("string"))
    g = p.groupBy("p_brand").agg(F.sort_array(F.collect_list(F.struct("p_partkey", row.alias("r")))).alias("g"))
    rows = F.concat(F.array(F.array(F.lit(""), F.lit(None).cast("string"), F.lit(" ")), F.array(F.lit("Report:"), F.lit("parts"), F.lit("")), F.array(F.lit("Part"), F.lit(""), F.lit("Size"))), F.transform("g", lambda x: x["r"]))
    return g.select("p_brand", X.sheet_text(F.col("p_brand"), rows).alias("sheet"))


@query("SELECT p_partkey, p_size % 3 = 0 OR p_size % 5 = 0 AS label FROM part")
def sheet_label_rows(spark, sf_dir):
    p = _read(spark, sf_dir, "part")
    row = F.array(F.when(F.col("p_size") % 3 == 0, F.lit("Date: ")).otherwise(F.col("p_name")), F.when(F.col("p_size") % 5 == 0, F.lit("Filter:")), F.lit("a:b"))
    return p.select("p_partkey", X.is_label_row(row).alias("label"))


_CAPTION, _OCR, _SAID = "CASE WHEN doc_id % 3 <> 0 THEN substr(lang, 1, 2) END", "CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END", "CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'CAPTION: x OCR_TEXT: y DESCRIPTION:  kept' WHEN 2 THEN 'Caption: x ocr_text: y' ELSE 'prose' END"


def _image_meta(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.expr(_CAPTION).alias("caption"), F.expr(_OCR).alias("ocr"), F.expr(_SAID).alias("said"), F.when(F.col("doc_id") % 7 == 0, F.lit("Slide: t")).otherwise(F.lit("")).alias("context"))


@query(f"""SELECT doc_id, CASE WHEN (CASE WHEN context <> '' THEN 1 ELSE 0 END + CASE WHEN coalesce(caption, '') <> '' THEN 1 ELSE 0 END + CASE WHEN coalesce(ocr, '') <> '' THEN 1 ELSE 0 END) >= 2 AND doc_id % 5 IN (1, 2)
  THEN concat_ws(chr(10) || chr(10), nullif(context, ''), 'Caption: ' || nullif(caption, ''), 'OCR Text: ' || nullif(ocr, ''), CASE WHEN doc_id % 5 = 1 THEN 'Description: kept' END)
  ELSE concat_ws(chr(10) || chr(10), nullif(context, ''), 'Caption: ' || nullif(caption, ''), 'OCR Text: ' || nullif(ocr, ''), 'Description: ' || nullif(said, '')) END AS content
  FROM (SELECT doc_id, {_CAPTION} AS caption, {_OCR} AS ocr, {_SAID} AS said, CASE WHEN doc_id % 7 = 0 THEN 'Slide: t' ELSE '' END AS context FROM documents)""")
def image_content(spark, sf_dir):
    return _image_meta(spark, sf_dir).select("doc_id", X.image_content(F.col("caption"), F.col("ocr"), F.col("said"), F.col("context")).alias("content"))


@query("SELECT doc_id, coalesce(lang, '') AS caption, CASE WHEN doc_id % 2 = 0 THEN '' ELSE coalesce(source, '') || ' more' END AS ocr_text, 'd1 d2: ' || doc_id AS description FROM documents")
def vision_parse(spark, sf_dir):
    d = _read(spark, sf_dir, "documents")
    reply = F.concat(F.lit("noise\n caption: "), X.filled(F.col("lang")), F.lit("\r\nOCR_TEXT: "), F.when(F.col("doc_id") % 2 == 0, F.lit("n/a")).otherwise(F.concat(X.filled(F.col("source")), F.lit("\n\n more"))), F.lit("\nDESCRIPTION: d1\n d2: "), F.col("doc_id").cast("string"), F.lit("\n"))
    return d.select("doc_id", X.vision_reply(reply).alias("v")).select("doc_id", "v.*")


@query(f"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'), {_WS}) AS text FROM pages")
def strip_html(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", X.strip_tags(F.col("html")).alias("text"))


def _markdown(spark, sf_dir):
    """Each document as Markdown: a preamble, two headings and a pipe table."""
    d = _read(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    one = F.replace(F.replace(F.col("text"), F.lit("#"), F.lit("")), F.lit("|"), F.lit(""))
    md = F.concat(F.when(F.col("doc_id") % 2 == 0, F.lit("intro\n")).otherwise(F.lit("")), F.lit("# One\n"), one, F.lit("\n## Sub\n| a | b |\n|---|:-:|\n| "), F.col("doc_id").cast("string"), F.lit(" | x  |\n\n# Two\nend"))
    return d.select("doc_id", md.alias("md"))


@query("""SELECT doc_id, n, section FROM (SELECT doc_id, unnest([0, 1, 2][1:len(s)]) AS n, unnest(s) AS section FROM (SELECT doc_id, list_concat(CASE WHEN doc_id % 2 = 0 THEN ['intro' || chr(10)] ELSE [] END,
 ['# One' || chr(10) || replace(replace(text, '#', ''), '|', '') || chr(10) || '## Sub' || chr(10) || '| a | b |' || chr(10) || '|---|:-:|' || chr(10) || '| ' || doc_id || ' | x  |' || chr(10) || chr(10), '# Two' || chr(10) || 'end']) AS s FROM documents WHERE text IS NOT NULL))""")
def md_sections(spark, sf_dir):
    return _markdown(spark, sf_dir).select("doc_id", F.posexplode(X.markdown_sections(F.col("md"))).alias("n", "section"))


@query("SELECT doc_id, 1 AS tables, 'a,b;' || doc_id || ',x' AS cells, 2 AS h1, 1 AS h2 FROM documents WHERE text IS NOT NULL")
def md_tables(spark, sf_dir):
    t = F.get(F.col("t"), F.lit(0))
    out = _markdown(spark, sf_dir).select("doc_id", X.markdown_tables(F.col("md")).alias("t"), X.heading_count(F.col("md"), 1).alias("h1"), X.heading_count(F.col("md"), 2).alias("h2"))
    return out.select("doc_id", F.size("t").alias("tables"), F.array_join(F.transform(t, lambda r: F.array_join(r, ",")), ";").alias("cells"), "h1", "h2")


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_nationkey % 3 = 0 THEN 'Slide: ' || c_name WHEN c_nationkey % 3 = 1 THEN 'Sheet: ' || c_name ELSE '' END AS context FROM customer")
def page_context(spark, sf_dir):
    kind = F.when(F.col("c_nationkey") % 3 == 0, "slide").when(F.col("c_nationkey") % 3 == 1, "sheet").otherwise("page")
    return _read(spark, sf_dir, "customer").select("c_custkey", X.page_context(kind, F.when(F.col("c_custkey") % 4 != 0, F.col("c_name"))).alias("context"))


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN s_name WHEN 1 THEN 'Links: http://a | ' || s_name ELSE s_name || chr(10) || chr(10) || 'Links: http://a | ' || s_name END AS text FROM supplier")
def links_line(spark, sf_dir):
    k = F.col("s_suppkey") % 3
    return _read(spark, sf_dir, "supplier").select("s_suppkey", X.with_links(F.when(k != 1, F.col("s_name")), F.when(k != 0, F.array(F.lit("http://a"), F.col("s_name")))).alias("text"))


@query("""SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY place) - 1)::INT AS n, link FROM (SELECT page_id, link, min(place) AS place FROM (SELECT page_id, unnest(l) AS link, unnest(range(len(l))) AS place FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages)) GROUP BY page_id, link)""")
def link_distinct(spark, sf_dir):
    links = F.regexp_extract_all(F.col("html"), F.lit('href="([^"]*)"'), F.lit(1))
    return _read(spark, sf_dir, "pages").select("page_id", F.posexplode(X.distinct_links(links, schemes=False)).alias("n", "link"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti(spark, sf_dir):
    return runs.pending(_read(spark, sf_dir, "documents").select("doc_id", "lang"), _read(spark, sf_dir, "labels"), "doc_id")


@query("SELECT event_type AS doc_name, user_id AS id, count(*) AS rows FROM events e WHERE NOT EXISTS (SELECT 1 FROM events f WHERE f.value > 150 AND f.event_type = e.event_type AND f.user_id = e.user_id) GROUP BY ALL")
def split_anti(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select(F.col("event_type").alias("doc_name"), F.col("user_id").alias("id"), "value")
    return runs.unwritten(e, e.where("value > 150")).groupBy("doc_name", "id").agg(F.count(F.lit(1)).alias("rows"))


_FEATURES = "SELECT l_orderkey AS doc_id, (l_partkey % 400)::INT AS width, (l_suppkey * 7 % 300)::INT AS height, l_linenumber <> 7 AS decoded, (l_partkey * 13 % 257)::INT AS dist, (l_suppkey % 100)::INT AS spread, (l_partkey % 30)::INT AS colours FROM lineitem"


@query(f"""SELECT doc_id, filter_reason, count(*) AS images FROM (SELECT doc_id, CASE WHEN greatest(width, height) < 20 THEN 'dimension' WHEN NOT decoded THEN 'decode_error' WHEN width / greatest(height, 1) BETWEEN 0.2 AND 5.0 AND dist <= 60 THEN 'ref_logo'
 WHEN greatest(width, height) < 100 OR least(width, height) < 75 THEN 'dimension' WHEN spread < 35 THEN 'solid_color' WHEN greatest(width, height) < 200 AND colours <= 8 THEN 'tiny_icon' ELSE 'kept' END AS filter_reason FROM ({_FEATURES})) GROUP BY ALL""")
def filter_stats(spark, sf_dir):
    f = _read(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS doc_id", "int(l_partkey % 400) AS width", "int(l_suppkey * 7 % 300) AS height", "l_linenumber <> 7 AS decoded", "int(l_partkey * 13 % 257) AS dist", "int(l_suppkey % 100) AS spread", "int(l_partkey % 30) AS colours")
    reason = images.filter_reason(*[F.col(c) for c in ("width", "height", "decoded", "dist", "spread", "colours")])
    return images.filter_stats(f.withColumn("filter_reason", reason))


@query("""SELECT o_orderkey AS image_id, ref_name, d AS logo_distance FROM (SELECT o_orderkey, n_name AS ref_name, (bit_count(xor(o_orderkey * 7919, n_nationkey * 104729)) + bit_count(xor(o_custkey * 31, n_nationkey * 17)))::INT AS d FROM orders, nation) QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY d, ref_name) = 1""")
def logo_match(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"), F.array(F.col("o_orderkey") * 7919, F.col("o_custkey") * 31).alias("phash"))
    n = _read(spark, sf_dir, "nation").select(F.col("n_name").alias("ref_name"), F.array(F.col("n_nationkey").cast("long") * 104729, F.col("n_nationkey").cast("long") * 17).alias("phash"))
    return images.nearest_reference(o, n)


def _image_rows(spark, sf_dir):
    c = _read(spark, sf_dir, "customer")
    rows = c.select(F.col("c_nationkey").alias("doc_id"), F.col("c_custkey").alias("image_id"))
    vision = c.where("c_custkey % 2 = 0").select(F.col("c_nationkey").alias("doc_id"), F.col("c_custkey").alias("image_id"), F.col("c_name").alias("caption"), F.lit(None).cast("string").alias("ocr_text"), F.col("c_mktsegment").alias("description"), F.when(F.col("c_custkey") % 10 == 0, F.lit("timeout")).alias("error"))
    vectors = c.where("c_custkey % 3 <> 0").select(F.col("c_nationkey").alias("doc_id"), F.col("c_custkey").alias("image_id"), F.array(F.col("c_acctbal").cast("float")).alias("embedding"))
    return images.with_vision(rows, vision, vectors)


@query("SELECT c_nationkey AS doc_id, c_custkey AS image_id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END AS caption, '' AS ocr_text, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END AS description, c_custkey % 3 <> 0 AS has_vector FROM customer")
def image_left_join(spark, sf_dir):
    return _image_rows(spark, sf_dir).select("doc_id", "image_id", "caption", "ocr_text", "description", F.col("embedding").isNotNull().alias("has_vector"))


@query("""SELECT c_nationkey AS doc_id, 'vision' AS stage, c_custkey::VARCHAR AS id, 'timeout' AS error FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT c_nationkey, 'embed_image', c_custkey::VARCHAR, 'no vector' FROM customer WHERE c_custkey % 3 = 0
 UNION ALL SELECT s_nationkey, 'embed_chunk', s_suppkey::VARCHAR, 'no vector' FROM supplier WHERE s_acctbal < 0""")
def degradations(spark, sf_dir):
    chunks = _read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("doc_id"), F.col("s_suppkey").cast("string").alias("chunk_id"), F.when(F.col("s_acctbal") >= 0, F.array(F.lit(1.0).cast("float"))).alias("embedding"))
    return runs.degradations(_image_rows(spark, sf_dir).withColumn("image_id", F.col("image_id").cast("string")), chunks)


@query("SELECT count(*) FILTER (o_orderstatus = 'F') AS succeeded, count(*) FILTER (o_orderstatus = 'P') AS failed, count(*) FILTER (o_orderstatus = 'O') AS skipped, count(*) AS total FROM orders")
def batch_summary(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "P", "failed").when(F.col("o_orderstatus") == "O", "skipped")
    return runs.batch_summary(_read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("path"), status.alias("status"), F.lit(None).cast("string").alias("error")))


@query("SELECT count(*) FILTER (event_type = 'click') AS created, count(*) FILTER (event_type = 'view') AS skipped, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'click' AND value > 100) AS deduped FROM events")
def split_stats(spark, sf_dir):
    status = F.when(F.col("event_type") == "click", "created").when(F.col("event_type") == "view", "skipped").when(F.col("event_type") == "error", "failed")
    return runs.split_stats(_read(spark, sf_dir, "events").select(status.alias("status"), (F.col("value") > 100).alias("shrunk")))


@query("SELECT page_id, string_split(url, '/')[-1] AS name, lower(regexp_extract(url, '[^/](\\.[^./]+)$', 1)) AS ext, CASE WHEN contains(string_split(url, '/')[-1], '.') THEN lower(string_split(string_split(url, '/')[-1], '.')[-1]) ELSE '' END AS file_type FROM pages")
def path_parts(spark, sf_dir):
    url = F.col("url")
    return _read(spark, sf_dir, "pages").select("page_id", X.file_name(url).alias("name"), X.extension(url).alias("ext"), X.file_type(X.file_name(url)).alias("file_type"))


@query("""SELECT vec_id, round(s, 6) AS score FROM (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))::DOUBLE[]) AS s FROM embeddings) ORDER BY s DESC, vec_id LIMIT 5""")
def cosine_topk(spark, sf_dir):
    e = _read(spark, sf_dir, "embeddings")
    first = e.orderBy("vec_id").select("embedding").first()
    return runs.top_similar(e, list(first[0]) if first else []).select("vec_id", F.round("score", 6).alias("score"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS created, CASE WHEN o_orderkey % 2 = 0 THEN 'around 2024' END AS modified FROM orders")
def pdf_date(spark, sf_dir):
    o = _read(spark, sf_dir, "orders")
    return o.select("o_orderkey", X.pdf_date(F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMddHHmmss"), F.lit("+01'00'"))).alias("created"), X.pdf_date(F.when(F.col("o_orderkey") % 2 == 0, F.lit("around 2024")).otherwise(F.lit(""))).alias("modified"))


@query("SELECT user_id AS doc_id, event_type AS key, arg_max(p, (p, event_id)) AS pg_num, count(*) - 1 AS duplicates FROM (SELECT user_id, event_type, (event_id % 50)::INT AS p, event_id FROM events) GROUP BY ALL")
def media_page_last(spark, sf_dir):
    return images.last_page(_read(spark, sf_dir, "events").selectExpr("user_id AS doc_id", "event_type AS key", "int(event_id % 50) AS pg_num", "event_id AS pos"))


@query("""SELECT doc_id, key, pg_num, pos, duplicate, CASE WHEN NOT duplicate THEN (row_number() OVER (PARTITION BY doc_id, pg_num, duplicate ORDER BY pos, key) - 1)::INT END AS img_idx FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY pg_num, pos, key) > 1 AS duplicate
 FROM (SELECT l_orderkey AS doc_id, l_suppkey AS key, (l_linenumber // 3)::INT AS pg_num, l_linenumber AS pos FROM lineitem))""")
def media_dedup(spark, sf_dir):
    return images.drop_repeats(_read(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS doc_id", "l_suppkey AS key", "int(l_linenumber div 3) AS pg_num", "l_linenumber AS pos"))


# neighbouring texts of a conversation are one block, a table is one of its own
_MARKED = """(SELECT *, sum(CASE WHEN role = 'user' AND before = 'user' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations))"""
_USER_BLOCKS = f"(SELECT conv_id * 10000 + b AS doc_id, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS text FROM {_MARKED} WHERE role = 'user' GROUP BY conv_id, b)"
_TABLE = "list_transform(string_split(text, chr(10)), lambda x: '| ' || replace(trim(x, ' ' || chr(9) || chr(13)), '|', '\\|') || ' |  |')"


@query(f"""WITH {_windows_sql(500, 50, _USER_BLOCKS)},
 kept AS (SELECT (doc_id // 10000)::BIGINT AS conv_id, (doc_id % 10000)::BIGINT AS b, chunk_idx AS k, 'text' AS chunk_type, content, NULL::INT AS num_rows, NULL::INT AS num_col FROM chunks
  UNION ALL SELECT conv_id, b, 0, 'table', array_to_string(list_concat([t[1]], ['| --- | --- |'], t[2:]), chr(10)), len(t)::INT, 2 FROM (SELECT conv_id, b::BIGINT AS b, {_TABLE} AS t FROM {_MARKED} WHERE role <> 'user' AND trim(text, {_WS}) <> '')),
 numbered AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, chunk_type ORDER BY b, k) - 1)::INT AS chunk_idx, (row_number() OVER (PARTITION BY conv_id ORDER BY b, k) - 1)::INT AS ord FROM kept)
 SELECT conv_id::VARCHAR AS doc_id, 'conv_' || conv_id || '__p1_' || chunk_type || '_' || chunk_idx AS chunk_id, chunk_type, chunk_idx, content, {_EST.format('content')} AS token_cnt, ord, num_rows, num_col FROM numbered""")
def elements_interleave(spark, sf_dir):
    """Conversations as pages of a document: what a user says is text, an answer a table of its lines."""
    c = _read(spark, sf_dir, "conversations")
    element = F.struct(F.when(F.col("role") == "user", "text").otherwise("table").alias("type"), F.when(F.col("role") == "user", F.col("text")).alias("content"), F.when(F.col("role") != "user", F.transform(F.split("text", "\n"), lambda x: F.array(x, F.lit(None).cast("string")))).alias("rows"))
    pages = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", element.alias("e")))).alias("g"))
    pages = pages.select(F.col("conv_id").cast("string").alias("doc_id"), F.concat(F.lit("conv_"), F.col("conv_id").cast("string")).alias("base_name"), F.lit(1).alias("pg_num"), F.transform("g", lambda x: x["e"]).alias("elements"))
    return chunking.chunk_pages(pages).select("doc_id", "chunk_id", "chunk_type", "chunk_idx", "content", "token_cnt", "ord", "metadata.num_rows", "metadata.num_col")


@query("""SELECT '/' || f || '/' || n_name || '.png' AS doc_id, regexp_replace(n_name, '[^A-Za-z0-9_=-]', '_', 'g') || '__p1_image_0' AS chunk_id, 'Description: region ' || n_regionkey || ' of ' || n_name AS content, n_name || '__p1_img0' AS img_id,
 CASE WHEN (n_nationkey + (f = 'b')::INT) % 3 <> 0 THEN (n_nationkey + CASE f WHEN 'b' THEN 100 ELSE 0 END)::DOUBLE END AS first FROM nation, (VALUES ('a'), ('b')) v(f)""")
def image_chunks(spark, sf_dir):
    """Two files of the same name in different folders, each with its own picture and vector or none."""
    n = _read(spark, sf_dir, "nation").withColumn("f", F.explode(F.array(F.lit("a"), F.lit("b"))))
    doc, img = F.concat(F.lit("/"), "f", F.lit("/"), "n_name", F.lit(".png")), F.concat("n_name", F.lit("__p1_img0"))
    one = F.struct(img.alias("img_id"), F.lit(0).alias("img_idx"), F.concat(img, F.lit(".png")).alias("img_path"), F.lit("").alias("ocr_text"), F.lit(None).cast("string").alias("caption"), F.concat(F.lit("region "), F.col("n_regionkey").cast("string"), F.lit(" of "), F.col("n_name")).alias("description"))
    pages = n.select(doc.alias("doc_id"), F.col("n_name").alias("base_name"), F.lit(1).alias("pg_num"), F.array(one).alias("imgs"))
    vectors = n.where((F.col("n_nationkey") + (F.col("f") == "b").cast("int")) % 3 != 0)
    vectors = vectors.select(doc.alias("doc_id"), img.alias("img_id"), F.array((F.col("n_nationkey") + F.when(F.col("f") == "b", 100).otherwise(0)).cast("float")).alias("embedding"))
    out = chunking.chunk_pages(pages, image_embeddings=vectors)
    return out.select("doc_id", "chunk_id", "content", F.col("metadata.img_id").alias("img_id"), F.get("embedding", F.lit(0)).cast("double").alias("first"))


@query("SELECT DISTINCT page_id, CASE WHEN url LIKE '%a%' THEN 'https://' || page_id || '/' ELSE 'ftp://' || page_id END AS link FROM pages")
def link_schemes(spark, sf_dir):
    """Links of a page but those of other schemes, each once."""
    found = F.array(F.lit("mailto:x@y"), F.when(F.col("url").contains("a"), F.concat(F.lit("https://"), F.col("page_id").cast("string"), F.lit("/"))).otherwise(F.concat(F.lit("ftp://"), F.col("page_id").cast("string"))), F.lit("javascript:0"), F.lit("#top"))
    return _read(spark, sf_dir, "pages").select("page_id", F.explode(X.distinct_links(F.concat(found, found))).alias("link"))


@query("""SELECT o_orderkey AS doc_id, o_orderkey % 3 AS pg_num, coalesce(list(c.l_linenumber::INT ORDER BY c.l_linenumber) FILTER (c.l_linenumber IS NOT NULL), []) AS images FROM orders LEFT JOIN lineitem c ON l_orderkey = o_orderkey AND l_linenumber % 4 = o_orderkey % 3 GROUP BY ALL""")
def images_on_pages(spark, sf_dir):
    """Pictures to the pages they are on; those of other pages are in none."""
    pages = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 3).alias("pg_num"))
    rows = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 4).alias("pg_num"), F.col("l_linenumber").cast("int").alias("img_idx"), *[F.lit("").alias(c) for c in ("image_id", "img_path", "ocr_text", "caption", "description")])
    on = images.attach_to_pages(pages, rows)
    return on.select("doc_id", "pg_num", F.coalesce(F.transform("imgs", lambda m: m["img_idx"]), F.array().cast("array<int>")).alias("images"))


@query("""SELECT doc_id, CASE WHEN duplicate THEN 'duplicate' WHEN big THEN 'kept' ELSE 'dimension' END AS filter_reason, count(*) AS images
 FROM (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber * 1000 + l_quantity::BIGINT) > 1 AS duplicate, l_quantity >= 10 AS big FROM lineitem) GROUP BY ALL""")
def duplicate_stats(spark, sf_dir):
    media = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_suppkey").alias("key"), F.lit(1).alias("pg_num"), (F.col("l_linenumber") * 1000 + F.col("l_quantity").cast("long")).alias("pos"), F.when(F.col("l_quantity") >= 10, "kept").otherwise("dimension").alias("filter_reason"))
    return images.filter_stats(images.drop_repeats(media))


@query("""SELECT s_suppkey, '{"id":"' || s_suppkey || '"' || CASE WHEN s_acctbal > 0 THEN ',"content":"' || s_name || '\\n\\"é\\""' ELSE '' END || ',"page":' || s_nationkey || ',"content_vector":' || CASE WHEN s_suppkey % 2 = 0 THEN '[0.5,' || s_nationkey || '.0]' ELSE 'null' END || '}' AS line FROM supplier""")
def json_lines(spark, sf_dir):
    """Index documents as JSON lines, NULLs left out but the vector's."""
    s = _read(spark, sf_dir, "supplier")
    vector = F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit(0.5).cast("float"), F.col("s_nationkey").cast("float")))
    docs = s.select("s_suppkey", F.col("s_suppkey").cast("string").alias("id"), vector.alias("content_vector"), F.when(F.col("s_acctbal") > 0, F.concat("s_name", F.lit('\n"é"'))).alias("content"), F.col("s_nationkey").alias("page"))
    return docs.select("s_suppkey", json_line(["id", "content_vector", "content", "page"]).alias("line"))


@query("""SELECT 'd' || n_regionkey AS doc_id, 'd' || n_regionkey || '__p1_table_0' AS chunk_id, 'Slide: Nations' || chr(10) || chr(10) || '| key | name | note |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' \\| ' || n_regionkey || ' |  |', chr(10) ORDER BY n_nationkey) AS content,
 (count(*) + 1)::INT AS num_rows, 3 AS num_col FROM nation GROUP BY n_regionkey""")
def slide_tables(spark, sf_dir):
    """Tables of slides, behind the line that names the slide."""
    doc = F.concat(F.lit("d"), F.col("n_regionkey").cast("string"))
    pages = _region_tables(spark, sf_dir).select(doc.alias("doc_id"), doc.alias("base_name"), F.lit(1).alias("pg_num"), F.lit("slide").alias("kind"), F.lit("Nations").alias("title"), F.array("t", F.array(F.array(F.lit(" ")))).alias("tables"))
    return chunking.chunk_pages(pages).select("doc_id", "chunk_id", "content", "metadata.num_rows", "metadata.num_col")

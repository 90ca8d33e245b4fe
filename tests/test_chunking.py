"""Chunk rules against exact small cases and an independent model."""

import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quernstone.functions import text as X
from quernstone.operators import chunking

PAGE = chunking.PAGE


def naive(text, target, overlap):
    """The window rule written with copied lists of (sentence, tokens)."""
    emit, cur, tok, tail_only = [], [], 0, False
    for s in chunking.split_sentences(text):
        e = chunking.estimate(s)
        if e >= target:
            if cur and not tail_only:
                emit.append(cur)
            emit.append([s])
            words = s.split()
            keep = words[max(0, len(words) - max(1, overlap)) :]
            cur, tok, tail_only = [" ".join(keep)], len(keep), True
        else:
            if cur and tok + e > target:
                if tail_only:
                    cur, tok = [], 0
                else:
                    emit.append(cur)
                    best = next(k for k in range(len(cur)) if k == len(cur) - 1 or sum(map(chunking.estimate, cur[k:])) <= overlap)
                    cur = cur[best:]
                    tok = sum(map(chunking.estimate, cur))
            cur, tok, tail_only = [*cur, s], tok + e, False
    if cur and not tail_only:
        emit.append(cur)
    return [" ".join(c) for c in emit]


@pytest.mark.parametrize("target,overlap", [(500, 50), (40, 10), (20, 5), (13, 10)])
def test_windows_equal_the_model(target, overlap):
    rng = random.Random(target)
    for _ in range(400):
        text = "".join(" ".join("w" * rng.randint(1, 3) for _ in range(rng.choice([1, 3, 9, 30, 60]))) + rng.choice([". ", "! ", "\n\n", "\nA", "\nb", " "]) for _ in range(rng.randint(0, 25)))
        assert chunking.split_windows(text, target, overlap) == naive(text, target, overlap)


def test_small_cases():
    assert chunking.split_windows("") == chunking.split_windows("   ") == []
    many = " ".join(f"Sentence number {i}." for i in range(400))
    assert len(chunking.split_windows(many, 100, 20)) > 1
    long = "word " * 600 + ". " + " ".join(f"Short one {i}." for i in range(10))
    out = chunking.split_windows(long)
    assert len(out) == 2 and all(f"Short one {i}." in out[1] for i in range(10))
    assert chunking.split_sentences("One. two\nThree\nfour\n\nfive") == ["One.", "two", "Three\nfour", "five"]


def value(spark, column, kind="string", **given):
    schema = ", ".join(f"{k} {v[0]}" for k, v in given.items())
    return spark.createDataFrame([tuple(v[1] for v in given.values())], schema).select(column.alias("x")).first()["x"]


def test_native_text_rules_equal_python(spark):
    rng = random.Random(2)
    texts = ["", " ", "a b c\x1cd\x85e", "word", None, *("".join(rng.choice("ab .!?\n\nA\t \x1c1é") for _ in range(rng.randint(1, 80))) for _ in range(300))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", X.estimate_tokens(F.col("t")).alias("n"), X.sentences(F.col("t")).alias("s"), X.trim_ws(F.col("t")).alias("w")).collect():
        t = texts[r["i"]]
        assert r["n"] == chunking.estimate(t or "")
        assert r["s"] == chunking.split_sentences(t or "")
        assert r["w"] == (None if t is None else t.strip())


def test_tables(spark):
    kind = "array<array<string>>"
    md = lambda t: value(spark, X.table_markdown(F.col("t")), t=(kind, t))
    assert md([["Param", "Value", "Unit"], ["Torque", "450"]]) == "| Param | Value | Unit |\n| --- | --- | --- |\n| Torque | 450 |  |"
    assert md([["a", "b"], ["1", "2", "3"]]).splitlines()[2] == "| 1 | 2 |"
    assert md([["a|b"], ["x\ny"], [None]]) == "| a\\|b |\n| --- |\n| x y |\n|  |"
    assert md([["", " "], [None, "   "]]) == md([]) == md([[]]) == "" and md(None) == ""


def test_images_and_echoes(spark):
    text = {k: ("string", v) for k, v in {"c": "cap", "o": "", "d": "CAPTION: cap\nOCR_TEXT: x\nDescription: a new\nview", "p": "Slide: t"}.items()}
    build = X.image_content(F.col("c"), F.col("o"), F.col("d"), F.col("p"))
    assert value(spark, build, **text) == "Slide: t\n\nCaption: cap\n\nDescription: a new\nview"
    assert value(spark, build, **(text | {"d": ("string", "CAPTION: c OCR_TEXT: none")})) == "Slide: t\n\nCaption: cap"
    assert value(spark, build, **(text | {"d": ("string", "prose")})).endswith("Description: prose")
    assert value(spark, build, c=("string", None), o=("string", None), d=("string", ""), p=("string", "")) == ""


def test_vision_replies(spark):
    say = lambda t: tuple(value(spark, X.vision_reply(F.col("t")), t=("string", t)))
    assert say("x\nCAPTION: a\n b \nocr_text: N/A\nDescription: d\nCAPTION: again") == ("a b", "", "d CAPTION: again")
    assert say("free text") == ("", "", "free text") and say("") == say(None) == ("", "", "")
    assert say("CAPTION: only") == ("only", "", "CAPTION: only")


def test_sheets_and_markdown(spark):
    kind = "array<array<string>>"
    sheet = lambda r: value(spark, X.sheet_text(F.lit("S"), F.col("r")), r=(kind, r))
    assert sheet([["Report:", ""], ["A", ""], ["1", "2"], [None, " "], ["3", "4", "5"]]) == "Sheet: S\nColumns: A, col_1\nTotal rows: 3\n\nA: 1 | col_1: 2\n\nA: 3 | col_1: 4"
    assert sheet([["x:"]]) == sheet([]) == ""
    assert "h19, ... (25 columns total)" in sheet([[f"h{i}" for i in range(25)]])
    assert value(spark, X.markdown_sections(F.col("t")), t=("string", "pre\n# A\nx\n## b\n# C\n")) == ["pre\n", "# A\nx\n## b\n", "# C\n"]
    assert value(spark, X.markdown_sections(F.col("t")), t=("string", "")) == [""]
    assert value(spark, X.markdown_tables(F.col("t")), t=("string", "|a|b|\n|--|:-:|\n| 1 | |\ntext\n|c|")) == [[["a", "b"], ["1", ""]], [["c"]]]


def test_a_long_sheet_takes_time_in_proportion_to_its_rows(spark):
    n = 3000
    rows = F.transform(F.sequence(F.lit(1), (F.col("id") + n).cast("int")), lambda i: F.array(i.cast("string"), F.lit("x")))
    df = spark.range(1).select(F.concat(F.array(F.array(F.lit("A"), F.lit(""))), rows).alias("r")).cache()
    df.count()
    began = time.time()
    (got,) = df.select(X.sheet_text(F.lit("S"), F.col("r"))).first()
    assert got == f"Sheet: S\nColumns: A, col_1\nTotal rows: {n}\n\n" + "\n\n".join(f"A: {i} | col_1: x" for i in range(1, n + 1))
    assert time.time() - began < 20


def test_names(spark):
    cases = {"/d/A.Tar.GZ": ("A.Tar", ".gz", "gz"), "/d/.hidden": (".hidden", "", "hidden"), "noext": ("noext", "", ""), "/x.y/z": ("z", "", "")}
    for path, want in cases.items():
        got = value(spark, F.struct(X.base_name(F.col("p")), X.extension(F.col("p")), X.file_type(X.file_name(F.col("p")))), p=("string", path))
        assert tuple(got) == want
    assert value(spark, X.safe_key(F.col("p")), p=("string", "a b/ü\U0001f600=-_")) == "a_b___=-_"


def pages(spark, **page):
    names = [x.split(" ", 1)[0] for x in PAGE.split(", ")]
    row = {"doc_id": "d", "base_name": "doc", "pg_num": 1} | page
    return spark.createDataFrame([tuple(row.get(n) for n in names)], PAGE)


def test_a_page_with_text_table_and_image(spark):
    image = ("i0", 0, "p.png", "", "a cap", "")
    out = chunking.chunk_pages(pages(spark, txt="Some words to keep here.", tables=[[[None]], [["h"], ["v"]]], imgs=[image, ("i1", 3, "q", "", "", "")], kind="slide", title="T", hyperlinks=["http://x"]), image_embeddings=spark.createDataFrame([("d", "i0", [0.5]), ("other", "i0", [0.7])], "doc_id string, img_id string, embedding array<float>")).orderBy("ord").collect()
    assert [r["chunk_id"] for r in out] == ["doc__p1_text_0", "doc__p1_table_1", "doc__p1_image_0", "doc__p1_image_3"]
    assert out[0]["content"] == "Slide: T\n\nSome words to keep here. Links: http://x" and out[0]["metadata"]["total_txt_chunks_on_pg"] == 1
    assert out[1]["content"].startswith("Slide: T\n\n| h |") and (out[1]["metadata"]["num_rows"], out[1]["metadata"]["num_col"]) == (2, 1)
    assert out[2]["content"] == "Slide: T\n\nCaption: a cap" and out[2]["embedding"] == [0.5]
    assert out[3]["content"] == "Slide: T" and out[3]["embedding"] is None


def test_elements_keep_their_order(spark):
    t = lambda s: ("text", s, None)
    table = ("table", None, [["a"], ["b"]])
    out = chunking.chunk_pages(pages(spark, kind="slide", title="T", hyperlinks=["http://x"], elements=[t("One two three."), t("Four five six."), table, t("a b"), ("table", None, [[" "]]), table, t("Seven eight nine.")]))
    got = [(r["chunk_type"], r["chunk_idx"], r["content"].replace("\n", "~")) for r in out.orderBy("ord").collect()]
    assert got == [("text", 0, "One two three. Four five six."), ("table", 0, "| a |~| --- |~| b |"), ("table", 2, "| a |~| --- |~| b |"), ("text", 1, "Seven eight nine.")]
    assert {r["metadata"]["total_txt_chunks_on_pg"] for r in out.where("chunk_type = 'text'").collect()} == {2}
    assert chunking.chunk_pages(pages(spark, elements=[], txt="not used at all")).count() == 0
    assert chunking.chunk_pages(pages(spark)).count() == 0


def test_workers_get_small_batches(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")

    @F.pandas_udf("int")
    def batch_bytes(texts: pd.Series) -> pd.Series:
        return pd.Series([int(texts.str.len().sum())] * len(texts), dtype="int32")

    text = F.concat(F.col("id").cast("string"), F.repeat(F.lit(" word word word"), 2000))
    docs = spark.range(0, 500, 1, 1).select(F.col("id").cast("string").alias("doc_id"), F.lit("d").alias("base_name"), F.lit(1).alias("pg_num"), text.alias("txt"))
    got = chunking.chunk_pages(docs, count=batch_bytes).select("doc_id", "content", "token_cnt").collect()
    assert sorted((r.doc_id, r.content) for r in got) == sorted((str(i), f"{i}" + " word word word" * 2000) for i in range(500))
    assert max(r.token_cnt for r in got) < 3 << 20


def test_index_documents(spark):
    chunks = chunking.chunk_pages(pages(spark, txt="Some words to keep here."))
    headers = spark.createDataFrame([("d", "My.Doc.PDF", "/in/My.Doc.PDF", 4)], "doc_id string, file_name string, file_path string, total_pgs int")
    r = chunking.index_documents(chunks, headers, "2024-01-01T00:00:00Z").first().asDict()
    assert (r["id"], r["doc_id"], r["file_type"], r["total_pgs"], r["total_txt_chunks_on_pg"], r["num_rows"], r["content_vector"]) == ("doc__p1_text_0", "doc", "pdf", 4, 1, None, None)
    schema = chunking.index_schema("ix", 8)
    assert [f["name"] for f in schema["fields"] if f["key"]] == ["id"] and len(schema["fields"]) == len(r) == 18

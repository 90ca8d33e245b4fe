"""Text rules as native column expressions.

White space is the Unicode class that also holds U+001C to U+001F and U+0085, wherever a rule trims, counts or splits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\x1c-\x1f\x85\p{Z}]"
NOT_WS = r"[^\s\x1c-\x1f\x85\p{Z}]"
#: Where one sentence ends and the next begins.
BOUNDARY = rf"\n(?=[0-9A-Z])|\n\n+|(?<=[!.?]){WS}+"
LEAST_TOKENS = 3
IMAGE_TYPES = {"jpg": "jpeg", "tif": "tiff"}


def trim_ws(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{WS}+|{WS}+\z", "")


def filled(c: Column) -> Column:
    """NULL as ''."""
    return F.coalesce(c, F.lit(""))


def given(c: Column) -> Column:
    """'' as NULL."""
    return F.when(c != "", c)


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(NOT_WS + "+"))


def estimate_tokens(c: Column) -> Column:
    """1.3 for each word, rounded down, 1 at least; 0 for '' and NULL."""
    n = word_count(c)
    return F.when(filled(c) == "", F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n * 13 / F.lit(10)).cast("int"))).cast("int")


def sentences(c: Column) -> Column:
    """The sentences of a text in order; none for NULL."""
    return F.filter(F.transform(F.split(trim_ws(filled(c)), BOUNDARY), trim_ws), lambda x: x != "")


def safe_key(c: Column) -> Column:
    """Every character that an index key can't hold becomes an underscore."""
    return F.regexp_replace(c, r"[^\w=-]", "_")


def strip_tags(c: Column) -> Column:
    return trim_ws(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), WS + "+", " "))


def cell(c: Column) -> Column:
    """A table's cell on one line of Markdown."""
    return trim_ws(F.replace(F.replace(filled(c), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))


def is_blank_table(t: Column) -> Column:
    """No cell has more than white space; true for NULL and no rows."""
    return F.coalesce(F.forall(F.flatten(F.filter(t, lambda r: r.isNotNull())), lambda x: ~filled(x).rlike(NOT_WS)), F.lit(True))


def table_markdown(t: Column) -> Column:
    """Header, rule and rows, each as wide as the header; '' for a blank table or one whose first row is empty."""
    width = F.size(F.get(t, F.lit(0)))

    def line(r: Column) -> Column:
        short = F.slice(F.coalesce(r, F.array().cast("array<string>")), F.lit(1), width)
        full = F.concat(F.transform(short, cell), F.array_repeat(F.lit(""), F.greatest(F.lit(0), width - F.size(short))))
        return F.concat(F.lit("| "), F.array_join(full, " | "), F.lit(" |"))

    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    lines = F.concat(F.array(line(F.get(t, F.lit(0))), rule), F.transform(F.slice(t, F.lit(2), F.greatest(F.lit(0), F.size(t) - 1)), line))
    return F.when(F.coalesce(width, F.lit(0)) < 1, F.lit("")).when(is_blank_table(t), F.lit("")).otherwise(F.array_join(lines, "\n"))


def page_context(kind: Column, title: Column) -> Column:
    """The line that precedes what a slide or sheet holds; '' for other pages and without a title."""
    name = F.when(kind == "slide", "Slide: ").when(kind == "sheet", "Sheet: ")
    return F.when(filled(title) == "", F.lit("")).otherwise(filled(F.concat(name, title)))


def with_links(text: Column, links: Column) -> Column:
    """A page's text followed by its links on one line."""
    line = F.when(F.size(F.coalesce(links, F.array().cast("array<string>"))) > 0, F.concat(F.lit("Links: "), F.array_join(links, " | ")))
    return F.concat_ws("\n\n", given(filled(text)), line)


def drop_echo(c: Column) -> Column:
    """Where the description repeats the caption and the recognised text, only what it adds."""
    parts = F.split(c, "\n\n")
    last = F.element_at(parts, -1)
    body = trim_ws(F.substring(last, F.lit(13), F.length(last)))
    upper = F.upper(body)
    echo = (F.size(parts) >= 3) & last.startswith("Description:") & upper.startswith("CAPTION:") & upper.contains("OCR_TEXT:")
    rest = trim_ws(F.regexp_extract(body, r"(?is)DESCRIPTION:\s*(.+)", 1))
    head = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.when(echo, F.concat_ws("\n\n", head, F.when(rest != "", F.concat(F.lit("Description: "), rest)))).otherwise(c)


def image_content(caption: Column, ocr: Column, description: Column, context: Column) -> Column:
    """What an image's chunk says, behind its page's context; '' if there is neither."""
    sections = [F.concat(F.lit(label), given(filled(value))) for label, value in (("Caption: ", caption), ("OCR Text: ", ocr), ("Description: ", description))]
    return drop_echo(F.concat_ws("\n\n", given(filled(context)), *sections))


def best_text(description: Column, caption: Column) -> Column:
    return F.coalesce(given(description), given(caption), F.lit(""))


def distinct_links(links: Column, schemes: bool = True) -> Column:
    """Each link once, where it came first; with ``schemes`` only those of http, https and ftp."""
    kept = F.filter(links, lambda x: x.rlike(r"\A(?:ftp|https?)://")) if schemes else links
    return F.array_distinct(kept)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """The suffix in lower case with its dot; '' for none. A name's leading dot isn't one's beginning."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)\z", 1))


def base_name(path: Column) -> Column:
    name = file_name(path)
    return F.when(extension(path) == "", name).otherwise(F.substring(name, F.lit(1), F.length(name) - F.length(extension(path))))


def file_type(name: Column) -> Column:
    """What follows the last dot, in lower case; '' without one."""
    return F.when(F.instr(name, ".") > 0, F.lower(F.substring_index(name, ".", -1))).otherwise(F.lit(""))


def image_type(ext: Column) -> Column:
    """The type's usual name: jpeg for jpg, tiff for tif."""
    bare = F.regexp_replace(F.lower(ext), r"\A\.", "")
    out = bare
    for short, full in IMAGE_TYPES.items():
        out = F.when(bare == short, full).otherwise(out)
    return out


def data_url(content: Column, ext: Column) -> Column:
    return F.concat(F.lit("data:image/"), image_type(ext), F.lit(";base64,"), F.regexp_replace(F.base64(content), r"[\r\n]", ""))


def pdf_date(c: Column) -> Column:
    """D:20240131120000 as 2024-01-31T12:00:00; what has no such form stays; '' is NULL."""
    rx = r"D:(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})"
    g = [F.regexp_extract(c, rx, i) for i in range(1, 7)]
    whole = F.concat(g[0], F.lit("-"), g[1], F.lit("-"), g[2], F.lit("T"), g[3], F.lit(":"), g[4], F.lit(":"), g[5])
    return F.when(g[0] != "", whole).otherwise(given(c))


def is_label_row(row: Column) -> Column:
    """A cell ends with a colon: a row of a label and its value, not of headings."""
    return F.exists(row, lambda c: trim_ws(filled(c)).endswith(":"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once a row; named in a lambda, an expression is made again for each of its elements."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sheet_text(name: Column, rows: Column, truncated: Column | None = None, preview: int = 20, most: int = 10_000) -> Column:
    """A sheet as text: name, headings, number of rows, then each row as ``heading: value`` pairs."""

    def first(at: Column, x: Column) -> Column:
        return F.when((at < 0) & F.exists(x["r"], lambda c: filled(c).rlike(NOT_WS)) & ~is_label_row(x["r"]), x["i"]).otherwise(at)

    def headed(rows: Column) -> Column:
        at = F.aggregate(F.transform(rows, lambda r, i: F.struct(i.alias("i"), r.alias("r"))), F.lit(-1), first)
        return bound(at, lambda at: F.when(F.coalesce(at, F.lit(-1)) < 0, F.lit("")).otherwise(bound(heads(rows, at), lambda h: whole(rows, at, h))))

    def heads(rows: Column, at: Column) -> Column:
        return F.transform(F.get(rows, at), lambda c, j: F.coalesce(given(c), F.concat(F.lit("col_"), j.cast("string"))))

    def whole(rows: Column, at: Column, heads: Column) -> Column:
        data = F.slice(rows, at + 2, F.size(rows) - at - 1)
        columns = F.concat(F.array_join(F.slice(heads, 1, preview), ", "), F.when(F.size(heads) > preview, F.concat(F.lit(", ... ("), F.size(heads).cast("string"), F.lit(" columns total)"))).otherwise(F.lit("")))
        note = F.when(truncated, F.lit(f" (truncated to {most})")).otherwise(F.lit("")) if truncated is not None else F.lit("")
        top = F.concat(F.lit("Sheet: "), name, F.lit("\nColumns: "), columns, F.lit("\nTotal rows: "), (F.size(rows) - at - 1).cast("string"), note)

        def pairs(r: Column) -> Column:
            cells = F.zip_with(F.slice(r, F.lit(1), F.size(heads)), F.slice(heads, F.lit(1), F.size(r)), lambda v, h: F.when(filled(v).rlike(NOT_WS), F.concat(h, F.lit(": "), v)))
            return F.array_join(cells, " | ")

        body = F.filter(F.transform(data, pairs), lambda x: x != "")
        return F.array_join(F.concat(F.array(top), body), "\n\n")

    return bound(rows, headed)


def markdown_sections(c: Column) -> Column:
    """A text cut before each heading of the first level; blank parts go, but a text without a heading stays whole."""
    parts = F.split(c, r"(?md)(?=^# .)")
    return F.when(F.size(parts) <= 1, F.array(c)).otherwise(F.filter(parts, lambda x: x.rlike(NOT_WS)))


def markdown_tables(c: Column) -> Column:
    """Pipe tables, as rows of cells: neighbouring lines between pipes, without the rules."""
    lines = F.transform(F.split(c, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), trim_ws)
    none = F.array().cast("array<array<array<string>>>")

    def cells(x: Column) -> Column:
        return F.transform(F.split(F.regexp_replace(x, r"\A\|+|\|+\z", ""), r"\|"), trim_ws)

    def fold(state: Column, x: Column) -> Column:
        done, now = state["done"], state["now"]
        row = x.rlike(r"\A\|.+\|\z")
        rule = x.rlike(r"\A[|:\s-]+\z")
        ended = F.when(F.size(now) > 0, F.concat(done, F.array(now))).otherwise(done)
        return F.when(row & rule, state).when(row, F.struct(done.alias("done"), F.concat(now, F.array(cells(x))).alias("now"))).otherwise(F.struct(ended.alias("done"), F.array().cast("array<array<string>>").alias("now")))

    start = F.struct(none.alias("done"), F.array().cast("array<array<string>>").alias("now"))
    return F.aggregate(lines, start, fold, lambda s: F.when(F.size(s["now"]) > 0, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]))


def heading_count(c: Column, level: int) -> Column:
    return F.regexp_count(c, F.lit(rf"(?md)^{'#' * level} .+"))


def vision_reply(c: Column) -> Column:
    """struct(caption, ocr_text, description) of a labelled reply.

    A label counts once; what follows belongs to it up to the next; what precedes the first is dropped. NONE and N/A are
    no text; without a description the whole reply is one.
    """
    whole = trim_ws(filled(c))
    lines = F.transform(F.split(whole, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), trim_ws)
    labels = ("caption", "ocr_text", "description")

    def fold(s: Column, x: Column) -> Column:
        upper = F.upper(x)
        at = F.lit(-1)
        for i, name in reversed(list(enumerate(labels))):
            at = F.when(upper.startswith(name.upper() + ":") & s[name].isNull(), F.lit(i)).otherwise(at)
        marker = at >= 0
        now = F.when(marker, at).otherwise(s["now"])
        value = F.when(marker, trim_ws(F.regexp_replace(x, r"\A[^:]*:", ""))).otherwise(x)
        joined = [F.when(now == i, F.when(s[n].isNull() | (s[n] == ""), value).when(value == "", s[n]).otherwise(F.concat(s[n], F.lit(" "), value))).otherwise(s[n]).alias(n) for i, n in enumerate(labels)]
        return F.struct(now.alias("now"), *joined)

    text = F.lit(None).cast("string")
    state = F.aggregate(lines, F.struct(F.lit(-1).alias("now"), *[text.alias(n) for n in labels]), fold)

    def close(s: Column) -> Column:
        ocr = filled(s["ocr_text"])
        return F.struct(
            trim_ws(filled(s["caption"])).alias("caption"),
            F.when(F.upper(trim_ws(ocr)).isin("NONE", "N/A"), F.lit("")).otherwise(trim_ws(ocr)).alias("ocr_text"),
            F.coalesce(given(trim_ws(filled(s["description"]))), whole).alias("description"),
        )

    return F.get(F.transform(F.array(state), close), F.lit(0))

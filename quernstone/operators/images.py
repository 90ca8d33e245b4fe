"""Image rows: which are kept and why the others aren't, logos, joins with what models said of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions import text as X

LOGO_DISTANCE, FLAT_RANGE, ICON_SIDE, ICON_COLOURS, MIN_SIDE = 60, 35, 200, 8, 100
#: Reference hashes are broadcast up to this many rows, and cross-joined by Spark's own choice beyond.
BROADCAST_REFERENCES = 10_000


def filter_reason(width: Column, height: Column, decoded: Column, logo_distance: Column, colour_range: Column, colours: Column, min_side: int = MIN_SIDE) -> Column:
    """The first stage that rejects an image, or 'kept': tiny, undecodable, a logo, small (its longer side under ``min_side`` or the other under three quarters of it), of one colour, an icon."""
    long, short = F.greatest(width, height), F.least(width, height)
    aspect = width / F.greatest(height, F.lit(1))
    return (
        F.when(long < 20, "dimension")
        .when(~F.coalesce(decoded, F.lit(False)), "decode_error")
        .when(aspect.between(0.2, 5.0) & (logo_distance <= LOGO_DISTANCE), "ref_logo")
        .when((long < min_side) | (short < min_side * 0.75), "dimension")
        .when(colour_range < FLAT_RANGE, "solid_color")
        .when((long < ICON_SIDE) & (colours <= ICON_COLOURS), "tiny_icon")
        .otherwise("kept")
    )


def filter_stats(images: DataFrame) -> DataFrame:
    """(doc_id, filter_reason, images): how many images of a document each stage decided on; where there is a column ``duplicate``, those it is true for count as that."""
    if "duplicate" in images.columns:
        images = images.withColumn("filter_reason", F.when(F.col("duplicate"), "duplicate").otherwise(F.col("filter_reason")))
    return images.groupBy("doc_id", "filter_reason").agg(F.count(F.lit(1)).alias("images"))


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two hashes, arrays of 64-bit words, differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def nearest_reference(images: DataFrame, references: DataFrame) -> DataFrame:
    """``images`` (image_id, phash) with ref_name and logo_distance of the nearest reference (ref_name, phash); of equals the first name.

    Their number is checked first: up to BROADCAST_REFERENCES are one array that is broadcast, so that no image is moved; beyond, images and references are joined and
    grouped by Spark. Without references there are no rows.
    """
    r = references.select("ref_name", F.col("phash").alias("ref_phash"))
    own = images.select("image_id", "phash")
    if r.limit(BROADCAST_REFERENCES + 1).count() <= BROADCAST_REFERENCES:
        known = r.agg(F.collect_list(F.struct("ref_name", "ref_phash")).alias("known")).where(F.size("known") > 0)
        apart = F.transform("known", lambda x: F.struct(hamming(F.col("phash"), x["ref_phash"]).alias("logo_distance"), x["ref_name"].alias("ref_name")))
        return own.crossJoin(F.broadcast(known)).select("image_id", F.array_min(apart).alias("b")).select("image_id", "b.ref_name", "b.logo_distance")
    best = F.min(F.struct(hamming(F.col("phash"), F.col("ref_phash")).alias("logo_distance"), "ref_name")).alias("b")
    return own.crossJoin(r).groupBy("image_id").agg(best).select("image_id", "b.ref_name", "b.logo_distance")


def drop_repeats(media: DataFrame, order: tuple[str, ...] = ("pg_num", "pos", "key")) -> DataFrame:
    """media (doc_id, key, pg_num, pos): each key of a document where it comes first, numbered on its page from 0 as img_idx; ``duplicate`` is true for the
    others, whose img_idx is NULL."""
    first = Window.partitionBy("doc_id", "key").orderBy(*order)
    page = Window.partitionBy("doc_id", "pg_num", "duplicate").orderBy(*order)
    out = media.withColumn("duplicate", F.row_number().over(first) > 1)
    return out.withColumn("img_idx", F.when(~F.col("duplicate"), F.row_number().over(page) - 1))


def last_page(references: DataFrame) -> DataFrame:
    """references (doc_id, key, pg_num, pos) -> (doc_id, key, pg_num, duplicates): the page of a medium's last mention, and how often it is mentioned besides."""
    return references.groupBy("doc_id", "key").agg(F.max_by("pg_num", F.struct("pg_num", "pos")).alias("pg_num"), (F.count(F.lit(1)) - 1).alias("duplicates"))


def with_vision(images: DataFrame, vision: DataFrame, embeddings: DataFrame | None = None) -> DataFrame:
    """Every image with its caption, recognised text and description, '' where a model gave none, and its vector or NULL."""
    said = vision.select("doc_id", "image_id", "caption", "ocr_text", "description", "error")
    out = images.join(said, ["doc_id", "image_id"], "left").withColumns({c: X.filled(F.col(c)) for c in ("caption", "ocr_text", "description")})
    if embeddings is None:
        return out.withColumn("embedding", F.lit(None).cast("array<float>"))
    return out.join(embeddings.select("doc_id", "image_id", "embedding"), ["doc_id", "image_id"], "left")


def attach_to_pages(pages: DataFrame, images: DataFrame) -> DataFrame:
    """``pages`` with ``imgs``; an image whose page doesn't exist is in no page. Only the images are shuffled by page beside the pages' keys."""
    meta = F.struct(F.col("image_id").alias("img_id"), "img_idx", "img_path", "ocr_text", "caption", "description")
    grouped = images.groupBy("doc_id", "pg_num").agg(F.sort_array(F.collect_list(F.struct("img_idx", meta.alias("m")))).alias("g")).select("doc_id", "pg_num", F.transform("g", lambda x: x["m"]).alias("imgs"))
    return pages.drop("imgs").join(grouped, ["doc_id", "pg_num"], "left")

"""Landing files, shaping extracted records into spans, and storing results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from inkwitness import fixed_values as V
from inkwitness.functions.colour import normalise_color
from inkwitness.schemas import BOX


def list_files(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """Paths and sizes only: the content column is pruned, so no file is opened.

    Spark's file source does not list files of 0 bytes; those have to come from the uploader's own list.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(folder).select("path", "length", "modificationTime")


def read_files(spark: SparkSession, folder: str, pattern: str | None = None, limit: int = V.MAX_FILE_BYTES) -> DataFrame:
    """Every file with path and length; content up to ``limit`` bytes, null beyond, as those files are never opened."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(folder)
    large = files.filter(F.col("length") > limit)
    named = large.select(*(F.lit(None).cast("binary").alias(c) if c == "content" else c for c in files.columns))
    return files.filter(F.col("length") <= limit).unionByName(named)


def land_files(files: DataFrame) -> DataFrame:
    """``files(path, content[, length], ...)`` -> adds filename, sha256 and byte length, of unread files as listed."""
    size = F.octet_length("content")
    if "length" in files.columns:
        size = F.coalesce(size, F.col("length"))
    return (
        files.withColumn("filename", F.element_at(F.split("path", "/"), -1))
        .withColumn("sha256", F.sha2("content", 256))
        .withColumn("byte_length", size.cast("long"))
    )


def admit_files(files: DataFrame) -> DataFrame:
    """Adds ``error``: null where the file is accepted.  ``files(filename, content_type, byte_length)``."""
    accepted = F.lower(F.col("filename")).endswith(".pdf") | F.coalesce(F.col("content_type").isin(*V.ACCEPTED_TYPES), F.lit(False))
    return files.withColumn(
        "error",
        F.when(~accepted, V.ERROR_TYPE).when(F.col("byte_length") == 0, V.ERROR_EMPTY)
        .when(F.col("byte_length") > V.MAX_FILE_BYTES, V.ERROR_SIZE),
    )


def batch_accounting(results: DataFrame) -> DataFrame:
    """Submitted, processed and failed per batch."""
    return results.groupBy("batch_id").agg(
        F.count("*").alias("total_submitted"), F.count_if(F.col("error").isNull()).alias("total_processed"),
        F.count_if(F.col("error").isNotNull()).alias("total_failed"))


def dedupe_by_content(documents: DataFrame) -> DataFrame:
    """One document per content and owner, the first uploaded.

    An aggregate, not a window: a content that fills a third of the table is reduced to one row per
    task before anything is shuffled.
    """
    others = [c for c in documents.columns if c not in ("sha256", "owner_id")]
    return documents.groupBy("sha256", "owner_id").agg(
        F.min_by(F.struct(*others), F.struct("uploaded_at", "doc_id")).alias("d")).select("sha256", "owner_id", "d.*").select(documents.columns)


def replace_scan_rows(stored: DataFrame, fresh: DataFrame, rescanned: DataFrame) -> DataFrame:
    """Stored rows of ``rescanned(doc_id)`` give way to the fresh ones; a document without fresh rows has none left."""
    return stored.join(rescanned.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(fresh)


def _packed_fields() -> list[str]:
    return ["span_no", "text", "font_name", "font_size", "font_color", "bold", "italic", "bbox", "block_no", "origin"]


def pack_span_pages(spans: DataFrame) -> DataFrame:
    """One JSON array of spans per page."""
    return spans.groupBy("doc_id", "page").agg(
        F.to_json(F.array_sort(F.collect_list(F.struct(*_packed_fields()))), {"ignoreNullFields": "false"}).alias("spans_json"))


def unpack_span_pages(pages: DataFrame) -> DataFrame:
    """The spans back from ``pack_span_pages``."""
    schema = (
        "array<struct<span_no:int,text:string,font_name:string,font_size:double,font_color:struct<r:int,g:int,b:int>,"
        "bold:boolean,italic:boolean,bbox:struct<x0:double,y0:double,x1:double,y1:double>,block_no:int,origin:string>>"
    )
    return pages.select("doc_id", "page", F.inline(F.from_json("spans_json", schema)))


def fill_empty_pages(page_dims: DataFrame, spans: DataFrame, fallback: DataFrame) -> DataFrame:
    """Pages without spans take theirs from the fallback source, numbered after the document's own."""
    empty = page_dims.select("doc_id", "page").join(spans.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti")
    used = spans.groupBy("doc_id").agg((F.max("span_no") + 1).alias("_base"))
    added = (
        fallback.join(empty, ["doc_id", "page"], "left_semi").join(used, "doc_id", "left")
        .withColumn("span_no", (F.col("span_no") + F.coalesce("_base", F.lit(0))).cast("int"))
    )
    return spans.unionByName(added.select(spans.columns))


def coalesce_char_runs(chars: DataFrame) -> DataFrame:
    """Neighbouring characters of one style become one span.

    ``chars(doc_id, page, char_no, text, size, fontname, color ARRAY<DOUBLE>, x0, top, x1, bottom)``.
    The box runs from the first character's corner to the last one's; it is not their union.
    """
    page = Window.partitionBy("doc_id", "page").orderBy("char_no")
    r3 = lambda c: F.bround(F.coalesce(F.col(c), F.lit(0.0)), 3)
    styled = chars.select(
        "doc_id", "page", "char_no", "text", F.col("fontname").alias("font_name"), r3("size").alias("font_size"),
        normalise_color(F.col("color")).alias("font_color"),
        F.struct(r3("x0").alias("x0"), r3("top").alias("y0"), r3("x1").alias("x1"), r3("bottom").alias("y1")).alias("box"),
    )
    style = F.struct("font_name", "font_size", "font_color")
    changed = (~F.lag(style).over(page).eqNullSafe(style)).cast("int")
    runs = styled.withColumn("_new", F.coalesce(changed, F.lit(1))).withColumn("run", F.sum("_new").over(page))
    spans = runs.groupBy("doc_id", "page", "run", "font_name", "font_size", "font_color").agg(
        F.array_sort(F.collect_list(F.struct("char_no", "text"))).alias("c"),
        F.min_by("box", "char_no").alias("first"), F.max_by("box", "char_no").alias("last"))
    return spans.select(
        "doc_id", "page", (F.col("run") - 1).cast("int").alias("run_no"), F.array_join(F.col("c.text"), "").alias("text"),
        "font_name", "font_size", "font_color", F.lit(False).alias("bold"), F.lit(False).alias("italic"),
        F.struct(F.col("first.x0").alias("x0"), F.col("first.y0").alias("y0"), F.col("last.x1").alias("x1"),
                 F.col("last.y1").alias("y1")).cast(BOX).alias("bbox"),
        F.lit(0).alias("block_no"), F.lit("fallback").alias("origin"))


def merge_metadata(primary: Column, secondary: Column, xmp: Column) -> Column:
    """Primary keys without empty values, then the secondary ones under their prefixes.

    A null ``secondary`` means that source was not there, which is recorded under a marker key.
    """
    kept = F.map_filter(primary, lambda k, v: F.coalesce(v, F.lit("")) != "")
    prefixed = lambda m, p: F.transform_keys(m, lambda k, v: F.concat(F.lit(p), k))
    empty = F.create_map().cast("map<string,string>")
    marker = F.create_map(F.lit(V.NO_SECONDARY_KEY), F.lit(V.NO_SECONDARY_VALUE))
    return F.map_concat(
        F.coalesce(kept, empty),
        F.when(secondary.isNull(), marker).otherwise(
            F.map_concat(prefixed(secondary, V.SECONDARY_PREFIX), F.coalesce(prefixed(xmp, V.XMP_PREFIX), empty))))


def read_evolving(spark: SparkSession, *folders: str) -> DataFrame:
    """Tables written over time with a growing set of columns; what an old one lacks is null."""
    return spark.read.option("mergeSchema", "true").parquet(*folders)


def store_results(tables: dict[str, DataFrame], folder: str, buckets: int = 0, writers: int = 8) -> None:
    """Write result tables under one folder.

    With ``buckets`` a table is split by a hash of the document into that many folders, so a reader
    of one document prunes all but one of them.  ``writers`` tasks write each folder.
    """
    for name, df in tables.items():
        path = f"{folder.rstrip('/')}/{name}"
        if buckets and "doc_id" in df.columns:
            placed = df.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
            placed.repartition("bucket", F.pmod(F.spark_partition_id(), F.lit(writers))).write.mode("overwrite").partitionBy("bucket").parquet(path)
        else:
            df.write.mode("overwrite").parquet(path)

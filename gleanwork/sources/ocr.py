"""Reading pictures of pages: engines are registered, what they read is kept by the pictures' sha256."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanwork.sources.pdf import sparse_images

#: Engines in the order in which `auto` takes them.
PREFERRED = ["paddle", "tesseract"]
ENGINES: dict[str, Callable[[bytes], str]] = {}


def register_ocr(name: str, engine: Callable[[bytes], str]) -> None:
    ENGINES[name] = engine


def ocr_engine(choice: str = "auto") -> Callable[[bytes], str] | None:
    """By name, tesseract in its place if it isn't there; `auto`: the first that is. None if there is none."""
    names = [*PREFERRED, *ENGINES] if choice == "auto" else [choice, "tesseract"]
    return next((ENGINES[n] for n in names if n in ENGINES), None)


def page_images(files: DataFrame) -> DataFrame:
    """path, page (from 0), n, image, image_hash of the pictures on PDF pages of hardly any text. files: path, content."""

    def run(batches):
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                content = bytes(content or b"")
                if content.startswith(b"%PDF"):
                    rows += [(path, page, n, image) for n, (page, image) in enumerate(sparse_images(content))]
            yield pd.DataFrame(rows, columns=["path", "page", "n", "image"])

    found = files.select("path", "content").mapInPandas(run, "path string, page int, n int, image binary")
    return found.withColumn("image_hash", F.sha2("image", 256))


def read_images(images: DataFrame, cache: DataFrame, engine: Callable[[bytes], str]) -> DataFrame:
    """image_hash, text of the pictures that the cache (image_hash, text) hasn't: each picture once. Append it to the
    cache; empty texts count, too, so that nothing is read twice. A picture that the engine can't read is left out."""

    def run(batches):
        for pdf in batches:
            rows = []
            for h, image in zip(pdf["image_hash"], pdf["image"]):
                try:
                    rows.append((h, engine(bytes(image))))
                except Exception:  # the next run tries again
                    continue
            yield pd.DataFrame(rows, columns=["image_hash", "text"])

    new = images.select("image_hash", "image").join(cache.select("image_hash"), "image_hash", "left_anti")
    return new.groupBy("image_hash").agg(F.first("image").alias("image")).mapInPandas(run, "image_hash string, text string")


def with_ocr(documents: DataFrame, images: DataFrame, cache: DataFrame) -> DataFrame:
    """Documents (see files.parse_files) whose empty pages have what was read from their pictures. Pages with a text layer
    keep it."""
    read = images.select("path", "page", "n", "image_hash").join(cache.filter("trim(text) <> ''").dropDuplicates(["image_hash"]), "image_hash")
    page = read.groupBy("path", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: F.trim(x["text"])), "\n").alias("text"))
    pages = page.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("page", "text"))).alias("__read"))
    is_pdf = (F.col("file_type") == "pdf") & F.col("__read").isNotNull()
    filled = F.transform("pages", lambda t, i: F.when(F.trim(t) == "", F.coalesce(F.try_element_at("__read", i), F.lit(""))).otherwise(t))
    joined = documents.join(pages, "path", "left").withColumn("__pages", F.when(is_pdf, filled).otherwise(F.col("pages")))
    joined = joined.withColumn("__n", F.size(F.filter(F.zip_with("pages", "__pages", lambda a, b: a != b), lambda x: x)))
    said = F.create_map(F.lit("is_ocr"), (F.col("__n") > 0).cast("string"), F.lit("ocr_pages"), F.col("__n").cast("string"))
    other = F.map_filter("meta", lambda k, v: ~k.isin("is_ocr", "ocr_pages") & ~((k == "scan_pdf") & (F.col("__n") > 0)))
    changed = joined.withColumns({"meta": F.when(is_pdf, F.map_concat(other, said)).otherwise(F.col("meta")), "pages": F.col("__pages")})
    return changed.drop("__read", "__pages", "__n")

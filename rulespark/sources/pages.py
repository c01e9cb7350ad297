"""Paged documents: text blocks, tables and images of each page, OCR, their merge, and chunks.

Reading a format needs a library on the executors. A *reader* turns a file's bytes into page dicts with
``page``, ``blocks`` (list of (y, x, text)), ``tables`` (list of rows of cells) and ``images`` (list of
bytes); an *engine* turns an image's bytes into text. Both are plain functions given by the caller; the
default reader uses PyMuPDF or pypdf, whichever is installed, and the default engine pytesseract.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rulespark.functions import text as X

Reader = Callable[[bytes], Iterable[dict]]
Engine = Callable[[bytes], str]

PAGES = "source string, page int, total int, blocks array<struct<y:double,x:double,text:string>>, tables array<array<array<string>>>, images array<binary>, error string"


def pdf_reader(data: bytes, dpi: int | None = 300) -> Iterable[dict]:
    """Pages of a PDF. PyMuPDF gives blocks, tables, embedded images and, with ``dpi``, a rendering; pypdf text alone."""
    try:
        import fitz
    except ImportError:
        from pypdf import PdfReader

        for i, p in enumerate(PdfReader(io.BytesIO(data)).pages, 1):
            yield {"page": i, "blocks": [(0.0, 0.0, p.extract_text() or "")], "tables": [], "images": []}
        return
    with fitz.open(stream=data, filetype="pdf") as doc:
        for n in range(1, len(doc) + 1):
            yield _pdf_page(doc, n, dpi)


def ocr_engine(data: bytes, language: str = "eng", psm: int = 6, oem: int = 3) -> str:
    """Text of a grey-scale image."""
    import pytesseract
    from PIL import Image, ImageOps

    with Image.open(io.BytesIO(data)) as img:
        return pytesseract.image_to_string(ImageOps.grayscale(img), lang=language, config=f"--oem {oem} --psm {psm}")


def pages(spark: SparkSession, path: str, reader: Reader = pdf_reader, pattern: str = "*.pdf") -> DataFrame:
    """One row a page of each file under a folder; a file that cannot be read gives one row with its error."""

    def run(frames):
        for f in frames:
            rows = []
            for source, data in zip(f["path"], f["content"], strict=True):
                try:
                    found = list(reader(bytes(data)))
                    rows += [_row(source, p, len(found)) for p in found]
                except Exception as e:  # a library's errors for damaged files have no common base
                    rows.append(_failed(source, e))
            yield _frame(rows)

    return _files(spark, path, pattern).select("path", "content").mapInPandas(run, PAGES)


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)


def _row(source: str, p: dict, total: int) -> tuple:
    return source, p["page"], total, [tuple(b) for b in p["blocks"]], [[[None if c is None else str(c) for c in r] for r in t] for t in p["tables"]], list(p["images"]), None


def _failed(source: str, e: Exception) -> tuple:
    return source, None, 0, [], [], [], f"{type(e).__name__}: {e}"


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["source", "page", "total", "blocks", "tables", "images", "error"]).astype({"page": "Int32", "total": "int32"})


@dataclass(frozen=True)
class Paged:
    """A format whose pages can be read one by one: ``count(bytes)`` and ``read(bytes, numbers)``, which yields those page dicts."""

    count: Callable[[bytes], int]
    read: Callable[[bytes, list[int]], Iterable[dict]]


def pdf_count(data: bytes) -> int:
    try:
        import fitz
    except ImportError:
        from pypdf import PdfReader

        return len(PdfReader(io.BytesIO(data)).pages)
    with fitz.open(stream=data, filetype="pdf") as doc:
        return len(doc)


def pdf_pages(data: bytes, numbers: list[int], dpi: int | None = 300) -> Iterable[dict]:
    """The pages of those numbers, as ``pdf_reader`` gives them; the others are not decoded."""
    try:
        import fitz
    except ImportError:
        from pypdf import PdfReader

        doc = PdfReader(io.BytesIO(data))
        for n in numbers:
            yield {"page": n, "blocks": [(0.0, 0.0, doc.pages[n - 1].extract_text() or "")], "tables": [], "images": []}
        return
    with fitz.open(stream=data, filetype="pdf") as doc:
        for n in numbers:
            yield _pdf_page(doc, n, dpi)


def _pdf_page(doc, n: int, dpi: int | None) -> dict:
    p = doc[n - 1]
    images = [doc.extract_image(x[0])["image"] for x in p.get_images(full=True)]
    if dpi:
        images.append(p.get_pixmap(dpi=dpi, alpha=False).tobytes("png"))
    tables = [t.extract() for t in p.find_tables().tables]
    return {"page": n, "blocks": [(b[1], b[0], b[4]) for b in p.get_text("blocks")], "tables": tables, "images": images}


PDF = Paged(pdf_count, pdf_pages)


def page_ranges(spark: SparkSession, path: str, selector: list[int] | None = None, kind: Paged = PDF, pattern: str = "*.pdf", size: int = 32) -> DataFrame:
    """The pages of ``pages`` in ranges of ``size``, each a task's work of its own; of a selector only those pages are decoded.

    As in ``selected``, a file that has none of the selected pages gives all of its pages. A file is read
    once to count its pages, and again for each range; pages go out one at a time, so that a task holds
    one file's bytes and one page's images. A file that cannot be read, and a page that cannot be decoded,
    give a row with the error; the page's has its number.
    """
    wanted = sorted(set(selector or []))

    def counted(frames):
        for f in frames:
            rows = []
            for source, data in zip(f["path"], f["content"], strict=True):
                try:
                    rows.append((source, int(kind.count(bytes(data))), None))
                except Exception as e:  # as above
                    rows.append((source, 0, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "total", "error"])

    def run(frames):
        for f in frames:
            for source, data, total, numbers in zip(f["path"], f["content"], f["total"], f["numbers"], strict=True):
                data = bytes(data)
                for n in map(int, numbers):
                    try:
                        yield _frame([_row(source, p, int(total)) for p in kind.read(data, [n])])
                    except Exception as e:  # as above
                        yield _frame([(source, n, int(total), [], [], [], f"{type(e).__name__}: {e}")])

    files = _files(spark, path, pattern).select("path", "content")
    known = files.mapInPandas(counted, "path string, total int, error string")
    every = F.when(F.col("total") > 0, F.sequence(F.lit(1), F.col("total"))).otherwise(F.array().cast("array<int>"))
    some = F.filter(F.array(*[F.lit(p) for p in wanted]).cast("array<int>"), lambda p: (p >= 1) & (p <= F.col("total")))
    numbers = F.when(F.size(some) > 0, some).otherwise(every) if wanted else every
    starts = lambda c: F.sequence(F.lit(1), F.size(c), F.lit(size))
    ranges = known.filter("total > 0").withColumn("all", numbers).select("path", "total", F.explode(F.transform(starts(F.col("all")), lambda i: F.slice("all", i, F.lit(size)))).alias("numbers"))
    # the bytes of a file meet each of its ranges and are dealt out with it. The number is given, as ranges are
    # small in bytes and long in work, and Spark would put them together again
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = files.join(ranges, "path").repartition(tasks, F.col("path"), F.element_at("numbers", 1))
    failed = known.filter("error is not null").select(F.col("path").alias("source"), F.lit(None).cast("int").alias("page"), F.lit(0).alias("total"), *[F.array().cast(t).alias(n) for n, t in (("blocks", "array<struct<y:double,x:double,text:string>>"), ("tables", "array<array<array<string>>>"), ("images", "array<binary>"))], "error")
    return dealt.mapInPandas(run, PAGES).union(failed)


def selected(rows: DataFrame, selector: list[int] | None, page: str = "page", total: str = "total") -> DataFrame:
    """The selected pages that exist; all pages of a document if none of them does or none are selected."""
    if not selector:
        return rows
    wanted = F.array(*[F.lit(p) for p in selector])
    some = F.exists(wanted, lambda p: (p >= 1) & (p <= F.col(total)))
    return rows.filter(F.array_contains(wanted, F.col(page)) | ~some)


def block_text(blocks: Column) -> Column:
    """The blocks from top to bottom and left to right, without trailing white space and empty ones, joined by blank lines."""
    texts = F.transform(F.array_sort(blocks), lambda b: F.regexp_replace(X.present(b["text"]), r"\s+$", ""))
    return F.regexp_replace(F.array_join(F.filter(texts, lambda t: t != ""), "\n\n"), r"^\s+|\s+$", "")


def text_pages(rows: DataFrame, with_tables: bool = True) -> DataFrame:
    """(source, page, text) of the pages that have any: blocks, then tables as Markdown."""
    tables = F.array_join(F.filter(F.transform("tables", lambda t, i: X.markdown_table(t, i + 1)), lambda t: t != ""), "\n")
    parts = F.array(block_text(F.col("blocks")), tables) if with_tables else F.array(block_text(F.col("blocks")))
    text = F.array_join(F.filter(parts, lambda t: t != ""), "\n\n")
    return rows.filter("page is not null").select("source", "page", text.alias("text")).filter("text <> ''")


def image_rows(rows: DataFrame) -> DataFrame:
    """(source, page, number, image), numbers from 1."""
    return rows.select("source", "page", F.posexplode("images").alias("at", "image")).select("source", "page", (F.col("at") + 1).alias("number"), "image")


def ocr_pages(images: DataFrame, engine: Engine = ocr_engine) -> DataFrame:
    """(source, page, ocr_text): the texts of a page's images in order, a line apart; an image that fails is left out."""

    def run(frames):
        for f in frames:
            texts = []
            for data in f["image"]:
                try:
                    texts.append((engine(bytes(data)) or "").strip())
                except Exception:  # as above: one image that cannot be read does not stop the job
                    texts.append("")
            yield f[["source", "page", "number"]].assign(text=texts)

    read = images.mapInPandas(run, "source string, page int, number int, text string").filter("text <> ''")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("number", "text"))), lambda t: t["text"])
    return read.groupBy("source", "page").agg(F.array_join(ordered, "\n").alias("ocr_text"))


def merged_pages(texts: DataFrame, ocr: DataFrame) -> DataFrame:
    """(source, page, text, ocr_text, merged) of every page that has text or images, the missing side blank."""
    both = texts.join(ocr, ["source", "page"], "full_outer").select("source", "page", *[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "ocr_text")])
    return both.withColumn("merged", X.merged_lines(F.col("text"), F.col("ocr_text")))


#: Pages whose chunks are counted together before they are numbered.
PAGE_BLOCK = 1024


def page_chunks(merged: DataFrame, size: int = 400, text: str = "merged") -> DataFrame:
    """(source, chunk_id, page, text, tokens): chunks of each page, numbered from 0 through a document in page order.

    Chunks are counted by page and by block of ``PAGE_BLOCK`` pages, so that no task numbers a long document
    alone. Rows of one page follow each other.
    """
    page, block = Window.partitionBy("source", "page"), F.floor(F.col("page") / PAGE_BLOCK)
    before = lambda w, n: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = merged.select("source", "page", X.char_chunks(F.col(text), size).alias("parts")).withColumn("many", F.size("parts").cast("long"))
    sizes = parts.groupBy("source", "page").agg(F.sum("many").alias("n")).withColumn("block", block)
    blocks = sizes.groupBy("source", "block").agg(F.sum("n").alias("n")).select(F.col("source").alias("_s"), F.col("block").alias("_b"), before(Window.partitionBy("source").orderBy("block"), "n").alias("outer"))
    inner = sizes.select("source", "page", "block", before(Window.partitionBy("source", "block").orderBy("page"), "n").alias("inner"))
    starts = inner.join(blocks, F.col("source").eqNullSafe(F.col("_s")) & F.col("block").eqNullSafe(F.col("_b"))).select(F.col("source").alias("_source"), F.col("page").alias("_page"), (F.col("outer") + F.col("inner")).alias("start"))
    own = parts.withColumn("prior", before(page.orderBy("many", F.xxhash64("parts")), "many"))
    placed = own.join(starts, F.col("source").eqNullSafe(F.col("_source")) & F.col("page").eqNullSafe(F.col("_page"))).select("source", "page", (F.col("start") + F.col("prior")).alias("start"), F.posexplode("parts").alias("at", "text"))
    return placed.select("source", (F.col("start") + F.col("at")).alias("chunk_id"), "page", "text", X.token_count(F.col("text")).alias("tokens"))


def statistics(merged: DataFrame) -> DataFrame:
    """(source, page, and the counts of ``text.page_statistics``) of merged pages."""
    made = X.page_statistics(F.col("text"), F.col("ocr_text"), F.col("merged"))
    return merged.select("source", "page", made.alias("made")).select("source", "page", "made.*")


def listed_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page): numbers of the ``page_<n>_merged.txt`` files of a folder, in order; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "page_*_merged.txt").load(path)
    return files.select(F.regexp_extract("path", r"page_(\d+)_merged\.txt$", 1).try_cast("int").alias("page")).filter("page is not null").distinct().orderBy("page")

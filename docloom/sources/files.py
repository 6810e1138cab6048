"""Reading and writing files: catalogs, labelled CSV, JSON lines, zipped XML, markup, previews, summaries."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.text import collapse, is_garbled, normalize_pdf_text, select_analysis_text, slashes
from docloom.lexicon import EXTENSIONS, PLAIN_KINDS

#: Where the text of zipped formats lies.
PARTS = {"docx": ("word/document.xml",), "pptx": ("ppt/slides/slide",), "hwpx": ("Contents/section",)}

LABELLED = T.StructType([T.StructField(n, T.StringType()) for n in "index current_path current_name extension size_bytes modified_at sha256 first_page_text extraction_status doc_type course subject topic_title semester true_category ideal_filename search_keywords".split()])
EVAL_QUERY = "query string, topic_title string, course string, difficulty string"


def any_case(extension: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in extension)


def glob(extensions: tuple[str, ...] = EXTENSIONS) -> str:
    return "*.{" + ",".join(map(any_case, extensions)) + "}"


def scan(spark: SparkSession, path: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob(extensions)).load(path)


def described(files: DataFrame, root: str) -> DataFrame:
    """(path, name, extension, folder, size_bytes, modified_at) from path, length and modificationTime."""
    path = F.regexp_replace("path", "^file:(//)?", "")
    top = slashes(F.lit(root))
    folder = F.regexp_replace(F.substring(path, F.length(top) + 2, F.length(path)), "/?[^/]*$", "")
    name = F.element_at(F.split(path, "/"), -1)
    return files.select(path.alias("path"), name.alias("name"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("extension"), folder.alias("folder"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"))


def catalog_scan(spark: SparkSession, root: str) -> DataFrame:
    """All supported files below root; contents are not read."""
    return described(scan(spark, root), root)


def listing(catalog: DataFrame, most: int = 2000) -> DataFrame:
    """Newest first, at most so many, with the total of all."""
    total = catalog.agg(F.count("*").alias("total"))
    return catalog.orderBy(F.desc("modified_at"), "path").limit(most).join(F.broadcast(total))


def catalog_fingerprint(spark: SparkSession, root: str) -> DataFrame:
    files = scan(spark, root)
    return described(files, root).join(files.select(F.regexp_replace("path", "^file:(//)?", "").alias("path"), F.sha2("content", 256).alias("sha256")), "path")


def read_labelled_csv(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Successful rows of a CSV with a header, maybe a byte order mark, and quoted line breaks; keywords as an array."""
    rows = spark.read.schema(LABELLED).option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(path)
    rows = rows.where("extraction_status = 'success'").withColumn("index", F.expr("try_cast(replace(index, '﻿', '') as int)")).withColumn("search_keywords", F.split("search_keywords", r"\|"))
    return rows.orderBy("index").limit(most) if most else rows


def read_eval_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Blank lines are skipped."""
    return spark.read.schema(EVAL_QUERY).json(path).where("query is not null")


def write_results_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def summary_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(dim, value, n) over several columns in one pass."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("dim"), F.col(c).cast("string").alias("value")) for c in columns))).alias("p")
    return rows.select(pairs).groupBy("p.dim", "p.value").agg(F.count("*").alias("n"))


def write_summary_json(rows: DataFrame, columns: list[str], path: str) -> None:
    """Counts by each column as JSON lines, one a column and value."""
    summary_counts(rows, columns).write.mode("overwrite").json(path)


def xml_text(data: bytes) -> str:
    """Text of all nodes; broken XML is an error (ParseError), not an empty text."""
    return " ".join(e.text.strip() for e in ElementTree.fromstring(data).iter() if e.text and e.text.strip())


#: Files that a task has unpacked at once; Arrow's batches hold thousands.
ROWS_AT_ONCE = 64


def container_text(files: DataFrame) -> DataFrame:
    """files(path, content) of zipped XML documents to (path, text, error).  A broken file becomes an error row.

    If some parts of a file can't be read, text is that of the others and error names them; a file without a text part is an error.
    """

    def text_of(path: str, content: bytes) -> tuple[str, str]:
        texts, errors, file = [], [], path.rsplit("/", 1)[-1]
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                starts = PARTS.get(path.rsplit(".", 1)[-1].lower(), ())
                names = sorted(n for n in archive.namelist() if n.startswith(starts or ("\0",)) and n.lower().endswith(".xml"))
                if not names:
                    errors.append(f"NoTextPart: {file}")
                for name in names:
                    try:
                        texts.append(xml_text(archive.read(name)))
                    except Exception as error:  # the other parts still have their texts
                        errors.append(f"{type(error).__name__}: {file}/{name}")
        except Exception as error:  # any broken file is a row, not the end of the job
            errors.append(f"{type(error).__name__}: {file}")
        return " ".join(texts).strip(), "; ".join(errors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                texts = [text_of(p, c) for p, c in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([t for t, _ in texts], pa.string()), pa.array([e for _, e in texts], pa.string())], ["path", "text", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, text string, error string")


def markup_text(c: Column) -> Column:
    """Text between tags, trimmed, joined by one space.  Lenient: broken markup yields what text there is."""
    c = F.regexp_replace(c, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", " ")
    return collapse(F.regexp_replace(c, r"(?s)<[^>]*>", " "))


def notebook_text(text: Column, n: int = 4000) -> Column:
    """Sources of a notebook's cells, one below the other; cells after the n-th character are not read."""
    cells = F.from_json(text, "cells array<struct<source: array<string>>>")["cells"]
    flat = F.from_json(text, "cells array<struct<source: string>>")["cells"]
    both = F.arrays_zip(cells.alias("a"), flat.alias("b"))
    source = lambda x: F.coalesce(F.array_join(x["a"]["source"], ""), x["b"]["source"], F.lit(""))
    longer = lambda t, x: F.when(F.length(t) >= n, t).otherwise(F.concat(F.coalesce(F.concat(t, F.lit("\n")), F.lit("")), source(x)))
    return F.coalesce(F.aggregate(both, F.lit(None).cast("string"), longer), F.lit(""))


def preview_text(kind: Column, text: Column, n: int = 4000) -> Column:
    """Preview of a whole file: the first 30 lines of CSV, the cells of a notebook, the start of any other text."""
    lines = F.array_join(F.slice(F.split(text, "\n"), 1, 30), "\n")
    chosen = F.when(kind == "csv", lines).when(kind == "ipynb", notebook_text(text, n)).otherwise(text)
    return F.substring(collapse(F.translate(chosen, "\x00", " ")), 1, n)


def preview(kind: Column, text: Column, n: int = 4000) -> Column:
    """(preview, status): success, ipynb_error for what is no JSON object, unsupported_extension for kinds without a reader.

    A null text is an empty file.  Where the status is not success the preview is empty.
    """
    text = F.coalesce(text, F.lit(""))
    broken = (kind == "ipynb") & (F.try_parse_json(text).isNull() | ~text.rlike(r"\A\s*\{"))
    status = F.when(F.coalesce(~kind.isin("csv", "ipynb", *PLAIN_KINDS), F.lit(True)), "unsupported_extension").when(broken, "ipynb_error").otherwise("success")
    return F.struct(F.when(status == "success", preview_text(kind, text, n)).otherwise("").alias("preview"), status.alias("status"))


def extract_batch(docs: DataFrame, n: int = 1000, compose: bool = True) -> DataFrame:
    """docs(path, name, extension, raw_text, error) with normalised and sampled texts; garbled texts become errors."""
    normal = normalize_pdf_text(F.coalesce("raw_text", F.lit("")), compose)
    rows = docs.withColumn("__n", normal).withColumn("error", F.when(F.coalesce("error", F.lit("")) != "", F.col("error")).when(is_garbled(F.col("__n")), "garbled_text").otherwise(""))
    sample = lambda c: F.when(F.col("error") == "", select_analysis_text(c, n)).otherwise("")
    return rows.select("path", "name", "extension", sample(F.coalesce("raw_text", F.lit(""))).alias("raw_text"), sample(F.col("__n")).alias("normalized_text"), sample(F.col("__n")).alias("preview_text"), "error")

"""Work that grows with the input and no faster: what a row costs."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from docloom.registry import QUERIES


def test_a_file_name_reads_its_evidence_a_few_times(spark, tmp_path):
    """A name from a long text costs no more than some tens of passes over it."""
    text = F.concat(F.lit("alpha "), F.repeat(F.lit("some-words, here. "), 20_000))
    place = f"{tmp_path}/documents.parquet"
    spark.range(0, 64, 2, 4).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("src1").alias("source")).write.parquet(place)

    def seconds(df):
        at = time.time()
        df.agg(F.bit_xor(F.xxhash64(*df.columns))).collect()
        return time.time() - at

    flat = spark.read.parquet(place).select(F.lower(F.regexp_replace("text", "[^0-9A-Za-z가-힣]", "")).alias("t"))
    seconds(flat)
    once = seconds(flat)
    assert seconds(QUERIES["g5_build_filename"](spark, str(tmp_path))) < 30 * once + 5


def test_files_are_unpacked_a_few_at_a_time(spark):
    import io
    import zipfile

    from docloom.sources import files

    def packed(k):
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            z.writestr("word/document.xml", f"<d><p>text {k}</p></d>")
        return held.getvalue() if k % 50 else b"broken"

    rows = spark.createDataFrame([(f"/{k}.docx", packed(k)) for k in range(3 * files.ROWS_AT_ONCE + 7)], "path string, content binary").coalesce(1)
    out = {r["path"]: (r["text"], r["error"]) for r in files.container_text(rows).collect()}
    assert len(out) == 3 * files.ROWS_AT_ONCE + 7 and out["/101.docx"] == ("text 101", "")
    assert out["/100.docx"] == ("", "BadZipFile: 100.docx")


def test_a_part_that_cannot_be_read_is_an_error(spark):
    """Broken XML is told apart from an empty text, and the other parts keep theirs."""
    import io
    import zipfile

    from docloom.sources import files

    def packed(**parts):
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            for name, text in parts.items():
                z.writestr(name.replace("__", "/") + ".xml", text)
        return held.getvalue()

    slides = packed(ppt__slides__slide1="<d>one</d>", ppt__slides__slide2="<d>two", ppt__slides__slide3="<d>three</d>")
    rows = [("/a/empty.docx", packed(word__document="<d/>")), ("/a/broken.docx", packed(word__document="<d>\x01</d>")), ("/a/none.docx", packed(word__styles="<d>x</d>")), ("/a/s.pptx", slides)]
    out = {r["path"]: (r["text"], r["error"]) for r in files.container_text(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert out == {
        "/a/empty.docx": ("", ""),
        "/a/broken.docx": ("", "ParseError: broken.docx/word/document.xml"),
        "/a/none.docx": ("", "NoTextPart: none.docx"),
        "/a/s.pptx": ("one three", "ParseError: s.pptx/ppt/slides/slide2.xml"),
    }


def test_letters_become_rows_in_compiled_code(spark):
    """Only what is done once a vector may go through lambdas."""
    from docloom.operators.vectors import hashed_vectors

    docs = spark.range(40).select("id", F.col("id").cast("string").alias("t"))
    plan = hashed_vectors(docs, "id", "t")._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" in plan and "lambda" not in plan[plan.index("Generate") :]

"""Queries over texts, names and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom import lexicon as lx
from docloom.functions import text as t
from docloom.operators import index, suggest
from docloom.registry.tables import DOCS, docs, read, scratch
from docloom.sources import files

QUERIES, ORACLES = {}, {}


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(column: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({column}, {q(pattern)}, {q(to)}, 'g')"


def strip(c: str) -> str:
    return rx(c, r"^\s+|\s+$")


def collapse(c: str) -> str:
    return strip(rx(c, r"\s+", " "))


def squash(c: str) -> str:
    return f"lower({rx(c, r'[-_.()\[\]{}·,~]|\s')})"


NORMAL = strip(rx(rx(rx("body", r"([A-Za-z])-+\s*\n\s*([A-Za-z])", r"\1\2"), r"\s*\n\s*", " "), r"[ \t]+", " "))
MARK = "chr(10) || '… [중간 생략] …' || chr(10)"


def sampled(c: str, n: int) -> str:
    m = len(lx.ELISION)
    b = n - 2 * m
    head, middle = b // 2, b // 4
    tail = b - head - middle
    start = f"greatest(0, length({c}) // 2 - {middle // 2})"
    return f"case when length({c}) <= {n} then {c} else {rx(f'substring({c}, 1, {head})', r'\s+$')} || {MARK} || {strip(f'substring({c}, {start} + 1, {middle})')} || {MARK} || {rx(f'substring({c}, length({c}) - {tail} + 1, {tail})', r'^\s+')} end"


RATIO = f"case when length(X) = 0 then 0.0 else length({rx('X', r'[^가-힣\x00-\x7F·※…—–「」『』()%,.]')}) / length(X)::double end"


def ratio(c: str) -> str:
    return RATIO.replace("X", f"({c})")


def cleaned(c: str) -> str:
    return f"replace({rx(rx(rx(c, r'[\\/:*?"<>|\x00-\x1f]', ' '), r'\s+', ' '), r'^[ ._]+|[ ._]+$')}, ' ', '_')"


def named(c: str, n: int | None) -> str:
    inner = rx(strip(rx(c, lx.ILLEGAL, "_")), r"\s+", "_")
    inner = rx(f"substring({inner}, 1, {n})" if n else inner, r"^[._]+|[._]+$")
    return f"case when {inner} = '' then 'untitled' else {inner} end"


def ligatures(c: str) -> str:
    for a, b in lx.LIGATURES.items():
        c = f"replace({c}, '{a}', '{b}')"
    return c


HEAD = "substring(body, 1, 200)"
LAST = f"(length({HEAD}) - position(' ' in reverse({HEAD})))"
SEMESTER = r"(20\d{2})\s*(?:[-./년]\s*)?([12])\s*(?:학기)?"

#: name: (column, SQL) over documents as files.
COLUMNS = {
    "b1_normalize_ligatures": (lambda b, p: t.normalize_ligatures(b), ligatures("body")),
    "b2_normalize_pdf_text": (lambda b, p: t.normalize_pdf_text(b), NORMAL),
    "b3_truncate_text": (lambda b, p: t.truncate_text(b, 200), f"case when length(body) <= 200 then body else {rx(f'case when contains({HEAD}, chr(32)) and {LAST} > 160 then substring({HEAD}, 1, {LAST}) else {HEAD} end', r'\s+$')} end"),
    "b4_select_analysis_text": (lambda b, p: t.select_analysis_text(b, 1000), sampled("body", 1000)),
    "b5_readable_ratio": (lambda b, p: F.round(t.readable_ratio(b), 6), f"round({ratio('body')}, 6)"),
    "b6_clean_control": (lambda b, p: t.clean_control(b), rx("translate(body, chr(13) || chr(11), chr(10) || chr(10))", r"[\x00-\x08\x0c\x0e-\x1f]+", " ")),
    "b7_salvage_tokens": (lambda b, p: t.salvage_tokens(b), f"array_to_string(regexp_extract_all(body, {q(r'[가-힣]{2,}|[A-Za-z]{2,}|[0-9][0-9.,\-:~년월일종호]*')}), ' ')"),
    "b8_printable_runs": (lambda b, p: t.printable_runs(b), f"array_to_string(list_transform(regexp_extract_all(body, {q(r'[가-힣A-Za-z0-9][가-힣A-Za-z0-9 .,()\-_:%/·]{7,}')}), lambda x: trim(x)), ' ')"),
    "b9_normalize_text": (lambda b, p: t.normalize_text(b), f"substring({strip(rx(rx('body', r'[ \t]+', ' '), r'\n{3,}', chr(10) * 2))}, 1, 2000)"),
    "b10_safe_filename": (lambda b, p: t.safe_filename(b), named("body", 90)),
    "b10_sanitize": (lambda b, p: t.sanitize(b), named("body", None)),
    "b11_squash": (lambda b, p: t.squash(b), squash("body")),
    "b12_clean_component": (lambda b, p: t.clean_component(b), cleaned("body")),
    "b13_flat_evidence": (lambda b, p: t.flat_evidence(b), f"lower({rx('body', '[^0-9A-Za-z가-힣]')})"),
    "b14_document_semester": (lambda b, p: t.document_semester(b), f"case when regexp_matches(body, {q(SEMESTER)}) then regexp_extract(body, {q(SEMESTER)}, 1) || '-' || regexp_extract(body, {q(SEMESTER)}, 2) else '' end"),
    "b15_is_under": (lambda b, p: t.is_under(p, F.lit("/src1/")), "path = '/src1' or starts_with(path, '/src1/')"),
    "b16_parent_folder": (lambda b, p: t.parent_folder(p), "source || '/' || lang"),
    "b16_relative_folder": (lambda b, p: t.relative_folder(F.lit("/src1"), F.regexp_replace(p, "/[^/]*$", "")), "case when source = 'src1' then lang else '.' end"),
    "b17_filename_tokens": (lambda b, p: F.array_join(F.array_sort(t.filename_tokens(F.concat_ws(" ", "name", "lang"))), ","), "array_to_string(list_sort(list_distinct(list_filter(string_split_regex(name || ' ' || lang, '[_\\s\\-()]+'), lambda x: x <> ''))), ',')"),
    "b18_short_reason": (lambda b, p: t.short_reason(b), f"substring({collapse('body')}, 1, 180)"),
    "b20_index_text": (lambda b, p: t.index_text(p, b), "substring('doc ' || id || chr(10) || lang || chr(10) || body, 1, 800)"),
    "b22_category_label": (lambda b, p: suggest.category_label(F.element_at(F.array(*map(F.lit, (*lx.CATEGORIES, "other"))), (F.col("id") % 11 + 1).cast("int"))), f"list_extract([{', '.join(map(q, (*lx.CATEGORIES.values(), 'other')))}], (id % 11 + 1)::int)"),
}


def over_documents(name: str):
    def run(spark, sf_dir):
        return docs(spark, sf_dir).select("id", COLUMNS[name][0](F.col("body"), F.col("path")).alias("value"))

    return run


for _name, (_, _sql) in COLUMNS.items():
    QUERIES[_name] = over_documents(_name)
    ORACLES[_name] = f"select id, {_sql} as value from {DOCS}"


def query(sql: str | None = None):
    """Register a function under its name."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


@query("select l_orderkey, l_linenumber, floor(l_discount * 100 + 0.5)::bigint || '%' as share from lineitem")
def b19_confidence_percent(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", t.confidence_percent(F.col("l_discount")).alias("share"))


@query(f"""select id, name as title, 'PDF' as kind, floor(((id % 101) / 100.0) * 100 + 0.5)::bigint || '%' as match_score, '/' || source || '/' || lang as folder, strftime(modified_at, '%Y-%m-%d') as date from {DOCS}""")
def b21_search_row_view(spark, sf_dir):
    d = docs(spark, sf_dir)
    return d.select("id", F.col("name").alias("title"), F.upper(F.regexp_extract("name", r"\.([^.]+)$", 1)).alias("kind"), t.confidence_percent((F.col("id") % 101) / 100.0).alias("match_score"), F.regexp_replace("path", r"[/\\][^/\\]*$", "").alias("folder"), F.date_format("modified_at", "yyyy-MM-dd").alias("date"))


@query(f"select path, name, octet_length(encode(body)) as size_bytes, modified_at, total from {DOCS}, (select count(*) as total from documents) order by modified_at desc, path limit 2000")
def a1_catalog_listing(spark, sf_dir):
    d = docs(spark, sf_dir).select("path", "name", F.octet_length("body").cast("long").alias("size_bytes"), "modified_at")
    return files.listing(d)


@query(f"select path, sha256(body) as sha256, length(body) as n_chars, case when trim(body) = '' then 'empty' else 'success' end as status from {DOCS}")
def a2_catalog_fingerprint(spark, sf_dir):
    return docs(spark, sf_dir).select("path", F.sha2(F.col("body").cast("binary"), 256).alias("sha256"), F.length("body").alias("n_chars"), F.when(F.trim("body") == "", "empty").otherwise("success").alias("status"))


def labelled(spark, sf_dir):
    """documents in the layout of a labelled corpus."""
    d = docs(spark, sf_dir)
    own = {"index": F.col("id"), "current_path": F.col("path"), "current_name": F.col("name"), "extension": F.lit("pdf"), "first_page_text": F.col("body"), "extraction_status": F.when(F.col("id") % 7 == 0, "pdf_error: x").otherwise("success"), "true_category": F.col("lang"), "course": F.col("source"), "search_keywords": F.concat_ws("|", "lang", "source")}
    return d.select(*(F.coalesce(own[c].cast("string"), F.lit("")).alias(c) if c in own else F.lit("").alias(c) for c in files.LABELLED.names))


@query("select doc_id::int as index, text as first_page_text, lang || ',' || source as keywords from documents where doc_id % 7 <> 0")
def a3_read_labelled_csv(spark, sf_dir):
    place = scratch(spark)
    labelled(spark, sf_dir).write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(place)
    return files.read_labelled_csv(spark, place).select("index", "first_page_text", F.array_join("search_keywords", ",").alias("keywords"))


@query("select text as query, item_id::varchar as topic_title, case when item_id % 2 = 0 then 'keyword' else 'paraphrase' end as difficulty from benchmark")
def a4_read_eval_jsonl(spark, sf_dir):
    place = scratch(spark)
    b = read(spark, sf_dir, "benchmark")
    b.select(F.col("text").alias("query"), F.col("item_id").cast("string").alias("topic_title"), F.lit("c").alias("course"), F.when(F.col("item_id") % 2 == 0, "keyword").otherwise("paraphrase").alias("difficulty")).write.json(place)
    return files.read_eval_jsonl(spark, place).drop("course")


@query("select o_orderkey, o_orderstatus, o_orderpriority from orders")
def a5_write_results_csv(spark, sf_dir):
    place = scratch(spark)
    files.write_results_csv(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), place)
    return spark.read.schema("o_orderkey long, o_orderstatus string, o_orderpriority string").option("header", True).csv(place)


@query("select 'lang' as dim, lang as value, count(*) as n from documents group by lang union all select 'source', source, count(*) from documents group by source")
def a6_summary_counts(spark, sf_dir):
    return files.summary_counts(read(spark, sf_dir, "documents"), ["lang", "source"])


@query("select user_id, max_by(event_id, (ts, event_id)) as event_id from events group by user_id")
def a7_upsert_collection(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    half = e.agg(F.percentile_approx("event_id", 0.5).alias("m"))
    cut = e.join(F.broadcast(half))
    order = [F.desc("ts"), F.desc("event_id")]
    first = index.latest(cut.where("event_id <= m").drop("m"), "user_id", order)
    return index.upsert(first, cut.where("event_id > m").drop("m"), "user_id", order).select("user_id", "event_id")


@query()
def a8_container_text(spark, sf_dir):
    """Each document is packed into a zipped XML file in a task, and its text read back."""

    def pack(batches):
        import io
        import zipfile
        from xml.sax.saxutils import escape

        import pyarrow as pa

        def packed(body):
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("word/document.xml", "<d>" + "".join(f"<p>{escape(line)}</p>" for line in (body or "").split("\n")) + "</d>")
            return held.getvalue()

        for batch in batches:
            for at in range(0, batch.num_rows, files.ROWS_AT_ONCE):
                part = batch.slice(at, files.ROWS_AT_ONCE)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([packed(b) for b in part.column(1).to_pylist()], pa.binary())], ["path", "content"])

    d = docs(spark, sf_dir).select(F.regexp_replace("path", "pdf$", "docx").alias("path"), "body")
    return files.container_text(d.mapInArrow(pack, "path string, content binary"))


@query(f"select page_id, {collapse(rx(rx('html', r'(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' '), r'(?s)<[^>]*>', ' '))} as text from pages")
def a9_markup_text(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", files.markup_text(F.col("html")).alias("text"))


@query(f"select id, substring({collapse('case when id % 2 = 0 then array_to_string(list_slice(string_split(body, chr(10)), 1, 30), chr(10)) else body end')}, 1, 4000) as preview from {DOCS}")
def a10_preview_text(spark, sf_dir):
    return docs(spark, sf_dir).select("id", files.preview_text(F.when(F.col("id") % 2 == 0, "csv").otherwise("txt"), F.col("body")).alias("preview"))


LINES = "string_split(coalesce(body, ''), chr(10))"
#: The cells that begin before the 4000th character: the lines up to there, a line a cell.
CELLS = f"(select string_agg(l, chr(10) order by i) from (select l, i, coalesce(sum(length(l) + 1) over (order by i rows between unbounded preceding and 1 preceding), 0) as before from (select unnest({LINES}) as l, unnest(range(1, len({LINES}) + 1)) as i)) where before = 0 or before - 1 < 4000)"


@query(f"""select id, case when id % 4 = 2 then 'unsupported_extension' when id % 4 = 3 and id % 5 = 0 then 'ipynb_error' else 'success' end as status,
 case when id % 4 = 2 or (id % 4 = 3 and id % 5 = 0) then '' when id % 4 = 3 then substring({collapse(CELLS)}, 1, 4000) else substring({collapse("coalesce(body, '')")}, 1, 4000) end as preview from {DOCS}""")
def a10_preview_status(spark, sf_dir):
    """Texts, kinds without a reader, notebooks with a cell a line in both layouts, and cut ones."""
    d = docs(spark, sf_dir)
    lines = F.split(F.coalesce("body", F.lit("")), "\n")
    listed = F.to_json(F.struct(F.transform(lines, lambda x: F.struct(F.array(x).alias("source"))).alias("cells")))
    flat = F.to_json(F.struct(F.transform(lines, lambda x: F.struct(x.alias("source"))).alias("cells")))
    notebook = F.when(F.col("id") % 5 == 0, F.substring(listed, 1, 20)).when(F.col("id") % 3 == 0, flat).otherwise(listed)
    kind = F.element_at(F.array(*map(F.lit, ("txt", "md", "mp4", "ipynb"))), (F.col("id") % 4 + 1).cast("int"))
    return d.select("id", files.preview(kind, F.when(kind == "ipynb", notebook).otherwise(F.col("body"))).alias("p")).select("id", "p.status", "p.preview")


_bad = f"(length({strip(NORMAL)}) > 0 and {ratio(NORMAL)} < 0.5)"


@query(f"select path, case when {_bad} then '' else {sampled('body', 1000)} end as raw_text, case when {_bad} then '' else {sampled(f'({NORMAL})', 1000)} end as normalized_text, case when {_bad} then 'garbled_text' else '' end as error from {DOCS}")
def a11_extract_batch(spark, sf_dir):
    d = docs(spark, sf_dir).select("path", "name", F.lit("pdf").alias("extension"), F.col("body").alias("raw_text"), F.lit("").alias("error"))
    return files.extract_batch(d).select("path", "raw_text", "normalized_text", "error")

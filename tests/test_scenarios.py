"""Small cases with results worked out by hand."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as t
from docloom.lexicon import ELISION
from docloom.operators import evaluate, index, quality, retrieve, suggest, vectors
from docloom.operators import query as qy
from docloom.plans import moves as mv
from docloom.streaming import changes



def now():
    return F.to_timestamp(F.lit("2026-01-31 00:00:00"))


def value(spark, column, **given):
    """The column's value on one row of text columns."""
    schema = ", ".join(f"{k} string" for k in given) or "x string"
    return spark.createDataFrame([tuple(given.values()) or ("",)], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("query", "tokens", "half_life", "cleaned"),
    [
        ("공모전 자료 찾아줘", ["공모전"], None, "공모전 자료 찾아줘"),
        ("공모전에서 받은 파일", ["공모전", "받은"], None, "공모전에서 받은 파일"),
        ("회의 요약", ["회의", "요약"], None, "회의 요약"),
        ("어제 최근 보고서", ["보고서"], 3.0, "보고서"),
        ("지난 주 과제.docx", ["과제"], 10.0, "과제.docx"),
        ("", [], None, ""),
    ],
)
def test_query_parsing(spark, query, tokens, half_life, cleaned):
    row = qy.parse_queries(spark.createDataFrame([(1, query)], "query_id long, query string")).first()
    assert (row["tokens"], row["half_life"], row["cleaned"]) == (tokens, half_life, cleaned)


def library(spark, rows):
    """(id, name, body, days old)"""
    made = [(i, f"/root/{n}", n, b, dt.datetime(2026, 1, 31) - dt.timedelta(days=d)) for i, n, b, d in rows]
    return spark.createDataFrame(made, "id long, path string, name string, body string, modified_at timestamp")


def search(spark, docs, query, sims=None, **more):
    queries = qy.parse_queries(spark.createDataFrame([(1, query)], "query_id long, query string"))
    if sims:
        qv = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, qv array<double>")
        dv = spark.createDataFrame([(i, [s, (1 - s * s) ** 0.5]) for i, s in sims.items()], "id long, v array<double>")
        more |= {"query_vectors": qv, "doc_vectors": dv}
    return retrieve.hybrid_search(queries, docs, now(), **more).orderBy("rank").collect()


def test_word_in_body_is_found(spark):
    docs = library(spark, [(1, "무제.pdf", "이 문서는 공모전 안내", 1), (2, "다른.pdf", "요리", 1)])
    assert [r["id"] for r in search(spark, docs, "공모전 찾아줘", {1: 0.2, 2: 0.2})] == [1]


def test_pasted_name_scores_one(spark):
    docs = library(spark, [(1, "기말_보고서.pdf", "x", 1), (2, "기말.pdf", "y", 1)])
    assert search(spark, docs, "기말 보고서 이거 찾아줘")[0]["score"] == 1.0


def test_time_phrase_prefers_new_files(spark):
    docs = library(spark, [(1, "a.pdf", "회의록 본문", 300), (2, "b.pdf", "회의록 본문", 1)])
    assert [r["id"] for r in search(spark, docs, "최근 회의록")] == [2, 1]


def test_second_gate_drops_bunched_rows(spark):
    docs = library(spark, [(1, "공모전.pdf", "공모전", 1), (2, "b.pdf", "x", 400), (3, "c.pdf", "y", 400)])
    assert [r["id"] for r in search(spark, docs, "공모전", {1: 0.86, 2: 0.85, 3: 0.84})] == [1]


def test_scope_and_degraded_mode(spark):
    docs = library(spark, [(1, "a/x.pdf", "공모전", 1), (2, "ab/x.pdf", "공모전", 1), (3, "a/x.exe", "공모전", 1)])
    assert [r["id"] for r in search(spark, docs, "공모전", root="/root/a")] == [1]


def test_excerpt_starts_before_the_word(spark):
    text = "a" * 200 + " needle " + "b" * 600
    got = value(spark, retrieve.excerpt(F.col("x"), F.array(F.lit("absent"), F.lit("needle")), F.lit("n")), x=text)
    assert got == text[141 : 141 + 500].strip()
    assert value(spark, retrieve.excerpt(F.col("x"), F.array(F.lit("w")), F.lit("n")), x=" ") == "n"


def test_too_many_queries_are_refused(spark):
    with pytest.raises(ValueError, match="split the queries"):
        retrieve.checked(spark.range(11).toDF("x"), 10)


@pytest.mark.parametrize(
    ("column", "given", "wanted"),
    [
        (lambda x: t.normalize_pdf_text(x), "en-\nables ﬁne  ½ \n\n b\t c", "enables fine 1⁄2 b c"),
        (lambda x: t.normalize_ligatures(x), "oﬃce ﬂow", "office flow"),
        (lambda x: t.truncate_text(x, 10), "abcdefghi jklm", "abcdefghi"),
        (lambda x: t.truncate_text(x, 10), "ab cdefghijklm", "ab cdefghi"),
        (lambda x: t.select_analysis_text(x, 5), "abcdefgh", "abcde"),
        (lambda x: t.select_analysis_text(x, 50), "short", "short"),
        (lambda x: t.readable_ratio(x), "", 0.0),
        (lambda x: t.readable_ratio(x), "ab가一", 0.75),
        (lambda x: t.clean_control(x), "a\rb\x0bc\x01\x02d", "a\nb\nc d"),
        (lambda x: t.salvage_tokens(x), "밼 한글 a ab 12.5 x", "한글 ab 12.5"),
        (lambda x: t.printable_runs(x), "abc\x00hello world\x00", "hello world"),
        (lambda x: t.sanitize(x), " a:b  c?. ", "a_b_c"),
        (lambda x: t.sanitize(x), "._", "untitled"),
        (lambda x: t.squash(x), "기말_보고서 (최종).PDF", "기말보고서최종pdf"),
        (lambda x: t.clean_component(x), " ._운영 체제/1 ", "운영_체제_1"),
        (lambda x: t.document_semester(x), "강의 2025년 2학기", "2025-2"),
        (lambda x: t.document_semester(x), "none", ""),
        (lambda x: t.is_under(x, F.lit("/a/b/")), "/a/bc/x", False),
        (lambda x: t.is_under(x, F.lit("/a/b")), "\\a\\b\\x", True),
        (lambda x: t.parent_folder(x), "a\\b/c.pdf", "a/b"),
        (lambda x: t.relative_folder(F.lit("/r"), x), "/r/a/b", "a/b"),
        (lambda x: t.relative_folder(F.lit("/r"), x), "/rx", "."),
        (lambda x: t.stem(x), "a.b.pdf", "a.b"),
        (lambda x: t.confidence_percent(x.cast("double")), "0.876", "88%"),
        (lambda x: t.confidence_percent(x.cast("double")), "87", "87%"),
        (lambda x: t.index_text(x, F.lit("t")), "/a/b/my_file-x.pdf", "my file x\nb\nt"),
        (lambda x: evaluate.token_f1(x, F.lit("a_b.pdf")), "a_c.pdf", 0.5),
        (lambda x: mv.resolve(x), "/a/./b/../../c", "/c"),
    ],
)
def test_text_functions(spark, column, given, wanted):
    assert value(spark, column(F.col("x")), x=given) == wanted


def test_sample_of_a_long_text_keeps_its_parts(spark):
    text = "H" * 500 + "M" * 500 + "T" * 500
    got = value(spark, t.select_analysis_text(F.col("x"), 200), x=text)
    assert got.count(ELISION) == 2 and got.startswith("H") and got.endswith("T") and "M" in got and len(got) <= 200


def one_hot(k, n=9):
    return [1.0 if i == k else 0.0 for i in range(n)]


def test_classification_cascade(spark):
    names = ["lecture", "assignment", "report", "reference", "project", "exam_prep", "career", "admin", "personal"]
    labels = spark.createDataFrame([(n, one_hot(k)) for k, n in enumerate(names)], "label string, lv array<double>")
    docs = spark.createDataFrame([(1, one_hot(2)), (2, [1 / 3] * 9), (3, one_hot(4))], "id long, v array<double>")
    examples = spark.createDataFrame([(1, one_hot(4), "career"), (2, one_hot(8), "admin")], "eid long, ev array<double>, category string")
    got = {r["id"]: (r["category"], r["method"]) for r in vectors.classify_cascade(docs, labels, examples).collect()}
    assert got == {1: ("report", "label_zeroshot"), 2: ("etc", "etc_fallback"), 3: ("career", "user_knn")}


def test_retrieve_context(spark):
    rows = [(1, "a", "lecture", 0.90), (2, "b", "lecture", 0.85), (3, "c", "assignment", 0.80), (4, "d", "report", 0.70), (5, "me", "report", 0.99), (6, "x", "nonsense", 0.95)]
    examples = spark.createDataFrame([(i, n, c, f"ideal_{n}.pdf", "text", [s, (1 - s * s) ** 0.5]) for i, n, c, s in rows], "eid long, name string, category string, ideal_filename string, document string, ev array<double>")
    docs = spark.createDataFrame([(1, "me", [1.0, 0.0])], "id long, name string, v array<double>")
    row = vectors.retrieve_context(docs, examples).first()
    assert (row["knn_category"], round(row["vote_ratio"], 3)) == ("lecture", 0.667)
    assert [e["file_name"] for e in row["examples"]] == ["ideal_a.pdf", "ideal_b.pdf", "ideal_c.pdf"]
    assert round(row["examples"][0]["score"], 6) == 0.90


def test_second_index_run_skips_all(spark):
    catalog = spark.createDataFrame([(1, 10), (2, 20)], "id long, mtime_us long")
    assert {r["state"] for r in index.index_diff(catalog, catalog).collect()} == {"skipped"}
    assert index.work_list(catalog, catalog).count() == 0


VALID = '{"category":"report","recommended_folder":"report/a","recommended_filename":"a.pdf","confidence":0.9,"reason":"r"}'


@pytest.mark.parametrize(
    ("response", "found"),
    [
        (VALID, []),
        (VALID.replace("0.9", '"0.9"'), []),
        (VALID.replace("0.9", "-0.1"), [("confidence", "out_of_range")]),
        (VALID.replace("0.9", "true"), None),
        (VALID.replace('"report/a"', "5"), [("recommended_folder", "not_text")]),
        (VALID.replace("report/a", "C:x"), [("recommended_folder", "absolute")]),
        (VALID.replace("a.pdf", "a.pdf."), [("recommended_filename", "bad_ending")]),
        (VALID.replace('"reason":"r"', '"reason":""'), [("reason", "empty")]),
        ("[1]", [("", "not_object")]),
        ("oops", [("", "not_json")]),
    ],
)
def test_suggestion_rules(spark, response, found):
    got = [(x["field"], x["rule"]) for x in value(spark, suggest.violations(F.col("x")), x=response)]
    assert got == found if found is not None else isinstance(got, list)


def test_all_broken_rules_are_told_at_once(spark):
    bad = VALID.replace("report", "x", 1).replace("0.9", "2").replace("a.pdf", "a")
    assert len(value(spark, suggest.violations(F.col("x")), x=bad)) == 3


EX = "array<struct<file_name:string,category:string>>"


@pytest.mark.parametrize(
    ("subject", "topic", "evidence", "category", "examples", "wanted"),
    [
        ("운영체제", "스케줄링", "운영체제 스케줄링 2025년 1학기", "report", None, "운영체제_스케줄링_보고서_2025-1.pdf"),
        ("없는과목", "스케줄링", "스케줄링 설명", "report", None, "스케줄링_보고서.pdf"),
        ("인공지능 트랜스포머", "", "트랜스포머 모델", "lecture", None, "트랜스포머_강의자료.pdf"),
        ("인공지능", "x1", "인공지능 x1", "lecture", [("AI-중간-x.pdf", "lecture")], "AI-x1-강의자료.pdf"),
    ],
)
def test_filenames(spark, subject, topic, evidence, category, examples, wanted):
    schema = f"subject string, topic string, document_type string, semester string, extension string, category string, evidence string, examples {EX}, legacy string"
    row = spark.createDataFrame([(subject, topic, None, None, ".PDF", category, evidence, examples, None)], schema)
    assert suggest.build_filename(row).first()["filename"] == wanted


@pytest.mark.parametrize(("legacy", "wanted"), [("a.PDF", "a.PDF"), ("a.txt", "a.pdf"), ("CON.txt", "문서_CON.pdf"), ("", ""), ("x" * 200, "x" * 146 + ".pdf")])
def test_old_filenames(spark, legacy, wanted):
    schema = f"subject string, topic string, document_type string, semester string, extension string, category string, evidence string, examples {EX}, legacy string"
    row = spark.createDataFrame([(None, None, None, None, "pdf", None, None, None, legacy)], schema)
    assert suggest.build_filename(row).first()["filename"] == wanted


def plan(spark, rows, files):
    moves = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq long, source_path string, target_folder string, target_filename string")
    catalog = spark.createDataFrame([(f, not f.endswith("/d")) for f in files], "path string, is_file boolean")
    done = mv.assign_targets(mv.validate_moves(moves, catalog, "/r"), catalog)
    return catalog, done, [(r["status"], r["target"], r["reason"]) for r in done.orderBy("seq").collect()]


def test_moves_find_free_names(spark):
    _, _, got = plan(spark, [("/r/1.pdf", "x", "a.pdf"), ("/r/2.pdf", "x", "a.pdf"), ("/r/3.pdf", "x", "a (1).pdf")], ["/r/1.pdf", "/r/2.pdf", "/r/3.pdf", "/r/x/a.pdf"])
    assert [g[1] for g in got] == ["/r/x/a (1).pdf", "/r/x/a (2).pdf", "/r/x/a (1) (1).pdf"]


def test_moves_that_are_refused(spark):
    _, _, got = plan(spark, [("/r/gone.pdf", "x", "a.pdf"), ("/r/d", "x", "d"), ("/o/1.pdf", "x", "1.pdf"), ("/r/1.pdf", "../o", "1.pdf"), ("/r/1.pdf", "x", "1.txt"), ("/r/1.pdf", ".", "1.pdf")], ["/r/1.pdf", "/r/d", "/o/1.pdf"])
    assert [g[2].split(":")[0] for g in got] == ["source_missing", "not_a_file", "unsafe_path", "unsafe_path", "extension_mismatch", "already_in_place"]


def test_long_names_stay_within_the_limit(spark):
    name = "n" * 146 + ".pdf"
    _, _, got = plan(spark, [("/r/1.pdf", "x", name), ("/r/2.pdf", "x", name)], ["/r/1.pdf", "/r/2.pdf"])
    assert got[0][1] == f"/r/x/{name}" and len(got[1][1].rsplit("/", 1)[-1]) == 150 and got[1][1].endswith(" (1).pdf")


def test_apply_then_undo_restores_the_catalog(spark):
    catalog, done, _ = plan(spark, [("/r/1.pdf", "x", "a.pdf"), ("/r/2.pdf", "x", "a.pdf")], ["/r/1.pdf", "/r/2.pdf", "/r/3.pdf"])
    after = mv.catalog_after_apply(catalog, done)
    history = mv.record_history(done, "r1", "/r", now())
    undo = mv.undo_plan(history, after.select("path", "is_file"))
    assert {r["status"] for r in undo.collect()} == {"restored"}
    back = mv.catalog_after_apply(after.select("path", "is_file"), undo.select(F.col("from").alias("source"), F.col("to").alias("target"), F.lit("moved").alias("status")))
    assert {r["path"] for r in back.collect()} == {r["path"] for r in catalog.collect()}
    assert mv.undo_plan(mv.mark_undone(history, "r1"), after.select("path", "is_file")).count() == 0


def test_undo_of_a_chain_runs_backwards(spark):
    schema = "id string, root string, applied_at timestamp, seq long, `from` string, `to` string, undone boolean"
    when = dt.datetime(2026, 1, 1)
    history = spark.createDataFrame([("r", "/", when, k, a, b, False) for k, (a, b) in enumerate([("/a", "/b"), ("/b", "/c"), ("/x", "/y"), ("/p", "/q"), ("/m", "/n")])], schema)
    there = spark.createDataFrame([("/c", True), ("/y", True), ("/x", True), ("/n", True)], "path string, is_file boolean")
    got = [(r["from"], r["to"], r["status"], r["reason"]) for r in mv.undo_plan(history, there).orderBy(F.desc("seq")).collect()]
    assert got == [("/n", "/m", "restored", ""), ("/q", "/p", "skipped", "moved_file_missing"), ("/y", "/x", "skipped", "original_slot_occupied"), ("/c", "/b", "restored", ""), ("/b", "/a", "restored", "")]


def test_many_moves_to_one_name(spark):
    """A hot name is numbered by a window; names that only look alike after their numbers are resolved beside it."""
    rows = [(f"/r/{i}.pdf", "x", "hot.pdf") for i in range(300)] + [("/r/a.pdf", "x", "b..pdf"), ("/r/b.pdf", "x", "b..pdf"), ("/r/c.pdf", "x", "b.pdf"), ("/r/d.pdf", "x", "b.pdf")]
    _, _, got = plan(spark, rows, [r[0] for r in rows] + ["/r/x/hot.pdf"])
    assert [g[1] for g in got[:300]] == [f"/r/x/hot ({i + 1}).pdf" for i in range(300)]
    assert [g[1] for g in got[300:]] == ["/r/x/b..pdf", "/r/x/b (1).pdf", "/r/x/b.pdf", "/r/x/b (2).pdf"]


def test_label_gain(spark):
    rules = [(d, w, c) for (d, w), c in __import__("docloom.lexicon", fromlist=["x"]).CATEGORY_RULES.items()]
    rows = spark.createDataFrame(rules * 3, "document_type string, work_mode string, category string")
    both = quality.information_gain(rows, "category", ["document_type", "work_mode"]).first()
    one = quality.information_gain(rows, "category", ["document_type"]).first()
    assert round(both["gain"], 6) == round(both["h_label"], 6) and both["ceiling"] == 1.0 and one["ceiling"] == 0.6875
    assert quality.cross_tab_purity(rows, "document_type", "work_mode", "category").where("impure").count() == 0


def test_stream_and_batch_agree(spark, sf, tmp_path):
    from docloom.registry.organising import SCHEMA, change_events

    events = change_events(spark, sf)
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    last = changes.follow(spark, f"{tmp_path}/in", SCHEMA, f"{tmp_path}/t", f"{tmp_path}/c", files_per_batch=1)
    batch = changes.apply_changes(changes.version(spark, "", -1), events)
    assert last == 2
    assert sorted(map(tuple, changes.version(spark, f"{tmp_path}/t", last).collect())) == sorted(map(tuple, batch.collect()))


def test_late_events_and_own_moves(spark, tmp_path):
    """Two runs: the second brings an event hours before the first's, one of a path that was deleted later, and a repeated one."""
    at = lambda h: dt.datetime(2026, 1, 1, h)
    schema = "event_id long, ts timestamp, path string, kind string, new_path string, mtime_us long"
    first = [(1, at(10), "/a", "create", None, 1), (2, at(11), "/gone", "delete", None, None), (3, at(12), "/own", "create", None, 3)]
    second = [(4, at(2), "/b", "create", None, 2), (5, at(3), "/gone", "create", None, 5), (1, at(10), "/a", "create", None, 1), (6, at(1), "/a", "modify", None, 0)]
    own = spark.createDataFrame([("/own", at(12))], "path string, applied_at timestamp")
    for rows in (first, second):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        last = changes.follow(spark, f"{tmp_path}/in", schema, f"{tmp_path}/t", f"{tmp_path}/c", own_moves=own)
    got = {r["path"]: r["event_id"] for r in changes.version(spark, f"{tmp_path}/t", last).collect()}
    assert got == {"/a": 1, "/b": 4}
    whole = changes.apply_changes(changes.version(spark, "", -1), changes.without_own(spark.createDataFrame(first + second, schema), own))
    assert {r["path"]: r["event_id"] for r in whole.collect()} == got


def test_same_answer_with_any_number_of_partitions(spark, sf):
    from docloom.registry import QUERIES

    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    for n in ("1", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(sorted(map(repr, QUERIES["d13_hybrid_search"](spark, sf).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1]


def test_file_sources(spark, tmp_path):
    from docloom.sources import files

    (tmp_path / "sub").mkdir()
    (tmp_path / "A.PDF").write_bytes(b"x")
    (tmp_path / "sub" / "b.docx").write_bytes(b"not a zip")
    (tmp_path / "c.exe").write_bytes(b"x")
    rows = {r["name"]: r["folder"] for r in files.catalog_scan(spark, str(tmp_path)).collect()}
    assert rows == {"A.PDF": "", "b.docx": "sub"}
    assert files.listing(files.catalog_scan(spark, str(tmp_path)), 1).first()["total"] == 2
    assert files.catalog_fingerprint(spark, str(tmp_path)).count() == 2
    bad = files.container_text(spark.read.format("binaryFile").load(f"{tmp_path}/sub/b.docx")).first()
    assert bad["text"] == "" and bad["error"].startswith("BadZipFile")
    files.write_summary_json(spark.createDataFrame([("a",), ("b",), ("a",)], "k string"), ["k"], f"{tmp_path}/s")
    assert {(r["dim"], r["value"], r["n"]) for r in spark.read.json(f"{tmp_path}/s").collect()} == {("k", "a", 2), ("k", "b", 1)}
    notebook = '{"cells":[{"source":["a","b"]},{"source":["c"]}]}'
    assert value(spark, files.preview_text(F.lit("ipynb"), F.col("x")), x=notebook) == "ab c"

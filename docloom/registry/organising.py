"""Queries over index maintenance, change streams, suggestions and move plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom import lexicon as lx
from docloom.operators import index
from docloom.operators import suggest as sg
from docloom.operators import vectors
from docloom.plans import moves as mv
from docloom.registry.tables import DOCS, docs, read, scratch
from docloom.registry.texts import q
from docloom.streaming import changes, own_moves

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = " ".join(sql.split("\n"))
        return f

    return put


# --- index maintenance: events as file states, one file a user


def store_and_catalog(spark, sf_dir):
    """The first event of each user is what is stored, the last what is on disk; every third user never changed."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    by = e.groupBy("id").agg(F.min("us").alias("a"), F.max("us").alias("b"))
    return by.where("id % 5 <> 0").select("id", F.col("a").alias("mtime_us")), by.select("id", F.when(F.col("id") % 3 == 0, F.col("a")).otherwise(F.col("b")).alias("mtime_us"))


STATES = """by_user as (select user_id as id, min(epoch_us(ts)) as a, max(epoch_us(ts)) as b from events group by user_id),
 ds as (select id, case when id % 3 = 0 then a else b end as mtime_us, case when id % 5 = 0 then 'new' when id % 3 = 0 or a = b then 'skipped' else 'changed' end as state from by_user)"""


@query(f"with {STATES} select id, mtime_us, state from ds")
def f1_index_diff(spark, sf_dir):
    store, catalog = store_and_catalog(spark, sf_dir)
    return index.index_diff(catalog, store)


@query(f"with {STATES} select id, mtime_us from ds where state <> 'skipped'")
def f1_work_list(spark, sf_dir):
    store, catalog = store_and_catalog(spark, sf_dir)
    return index.work_list(catalog, store)


@query(f"with {STATES} select id, mtime_us from ds order by mtime_us desc, id limit 500")
def f2_newest_first_cap(spark, sf_dir):
    return index.newest(store_and_catalog(spark, sf_dir)[1], 500)


@query(f"select id, case when id % 9 = 0 or id % 10 = 0 then 'failed' else 'done' end as status, case when id % 9 = 0 then 'broken' when id % 10 = 0 then 'empty_text' else '' end as reason from {DOCS}")
def f3_failures(spark, sf_dir):
    d = docs(spark, sf_dir).select("id", F.when(F.col("id") % 9 == 0, "broken").otherwise("").alias("error"), F.when(F.col("id") % 10 == 0, " ").otherwise(F.col("body")).alias("normalized_text"))
    return index.with_failures(d).select("id", "status", "reason")


def sized(texts):
    """An embedder that fails on a batch with a text that it cannot read."""
    if texts.eq("poison").any():
        raise ValueError("bad bytes")
    return texts.map(lambda t: [float(len(t or "")), 1.0])


@query(f"select id, case when id % 97 = 0 or length(trim(coalesce(body, ''))) = 0 then 'failed' else 'done' end as status, case when id % 97 = 0 then 'ValueError: bad bytes' when length(trim(coalesce(body, ''))) = 0 then 'empty_text' else '' end as reason, case when id % 97 <> 0 then length(coalesce(body, ''))::double end as size from {DOCS}")
def f3_fault_isolation(spark, sf_dir):
    """Texts that the embedder fails on are failed rows; the others of their batches are done."""
    d = docs(spark, sf_dir).select("id", F.when(F.col("id") % 97 == 0, "poison").otherwise(F.col("body")).alias("normalized_text"))
    return index.with_failures(vectors.embed(d, "normalized_text", sized)).select("id", "status", "reason", F.col("v")[0].cast("double").alias("size"))


@query(f"with {STATES}, c as (select count(*) as total, count_if(state = 'changed') as done, count_if(state = 'skipped') as skipped, count_if(state = 'new') as failed from ds) select *, done + skipped as processed, round(case when done + skipped > 0 and total > done + skipped then (total - done - skipped) * 60.0 / (done + skipped) end, 6) as eta_sec from c")
def f4_index_report(spark, sf_dir):
    store, catalog = store_and_catalog(spark, sf_dir)
    state = F.when(F.col("state") == "changed", "done").when(F.col("state") == "new", "failed").otherwise(F.col("state"))
    return index.index_report(index.index_diff(catalog, store).select(state.alias("status")), 60.0).withColumn("eta_sec", F.round("eta_sec", 6))


@query("select vec_id from embeddings where label % 2 = 0")
def f5_model_guard(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").withColumn("embed_model", F.when(F.col("label") % 2 == 0, "m1").otherwise("m2"))
    return index.model_guard(e, "m1").select("vec_id")


def change_events(spark, sf_dir):
    """events as file changes of one path a user: purchases delete, clicks move to a second path, the rest write."""
    e = read(spark, sf_dir, "events")
    path = F.concat(F.lit("/u"), F.col("user_id").cast("string"))
    kind = F.when(F.col("event_type") == "purchase", "delete").when(F.col("event_type") == "click", "move").when(F.col("event_type") == "signup", "create").otherwise("modify")
    ts = F.col("ts").cast("timestamp")
    return e.select("event_id", ts.alias("ts"), path.alias("path"), kind.alias("kind"), F.when(kind == "move", F.concat(path, F.lit("/moved"))).alias("new_path"), F.unix_micros(ts).alias("mtime_us"))


LATEST = """st as (select event_id, ts, '/u' || user_id as path, event_type in ('purchase', 'click') as gone from events union all select event_id, ts, '/u' || user_id || '/moved', false from events where event_type = 'click'),
 la as (select * from (select *, row_number() over (partition by path order by ts desc, event_id desc, gone desc) as r from st) where r = 1)"""
SCHEMA = "event_id long, ts timestamp, path string, kind string, new_path string, mtime_us long"


@query(f"with {LATEST} select path, gone, event_id from la")
def f6_latest_state(spark, sf_dir):
    return changes.latest_state(change_events(spark, sf_dir)).select("path", "gone", "event_id")


@query(f"with {LATEST} select path, event_id from la where not gone")
def f6_change_stream(spark, sf_dir):
    """The events as a stream of files out of order, followed one file a batch into table versions; the last version is the result."""
    place = scratch(spark)
    parts = change_events(spark, sf_dir).withColumn("part", F.pmod("event_id", F.lit(3)))
    for k in range(3):
        parts.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(f"{place}/in")
    last = changes.follow(spark, f"{place}/in", SCHEMA, f"{place}/table", f"{place}/checkpoint", files_per_batch=1)
    return changes.version(spark, f"{place}/table", last).select("path", "event_id")


@query("select e.event_id from events e where not exists (select 1 from events m where m.event_type = 'click' and m.user_id = e.user_id and m.event_id % 2 = 0 and abs(epoch_us(e.ts) - epoch_us(m.ts)) <= 600000000)")
def f7_self_change_suppression(spark, sf_dir):
    e = change_events(spark, sf_dir)
    own = e.where("kind = 'move' and event_id % 2 = 0").select("path", F.col("ts").alias("applied_at"))
    return changes.without_own(e, own, 600).select("event_id")


OWN = """own as (select '/u' || user_id as path, epoch_us(ts) as at from events where event_type = 'click' and event_id % 2 = 0 union all select '/u' || user_id || '/moved', epoch_us(ts) from events where event_type = 'click' and event_id % 2 = 0),
 un as (select * from st where not exists (select 1 from own where own.path = st.path and abs(own.at - epoch_us(st.ts)) <= 600000000)),
 lu as (select * from (select *, row_number() over (partition by path order by ts desc, event_id desc, gone desc) as r from un) where r = 1)"""


@query(f"with {LATEST}, {OWN} select path, event_id from lu where not gone")
def f7_late_move_records(spark, sf_dir):
    """Changes in two batches, and records of own moves for both of their paths: half of the records come in another batch than their change."""
    place, e = scratch(spark), change_events(spark, sf_dir)
    moved = e.where("kind = 'move' and event_id % 2 = 0").select("event_id", F.explode(F.array("path", "new_path")).alias("path"), F.col("ts").alias("applied_at"))
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))  # of either batch, so that no task writes or reads all of it
    for k in range(2):
        e.where(F.col("event_id") % 4 >= 2 if k else F.col("event_id") % 4 < 2).repartition(files).write.mode("append").parquet(f"{place}/in")
        moved.where(F.col("event_id") % 8 >= 4 if k else F.col("event_id") % 8 < 4).drop("event_id").repartition(files).write.mode("append").parquet(f"{place}/own")
    last = own_moves.follow(spark, f"{place}/in", SCHEMA, f"{place}/own", f"{place}/table", f"{place}/checkpoint", seconds=600, files_per_batch=files)
    return own_moves.version(spark, f"{place}/table", last).select("path", "event_id")


# --- suggestions


def prompted(spark, sf_dir):
    d = docs(spark, sf_dir)
    ex = F.when(F.col("id") % 2 == 0, F.array(F.struct(F.concat(F.col("source"), F.lit(".pdf")).alias("file_name"), F.lit("report").alias("category"))))
    return d.select("id", F.col("name").alias("current_name"), F.col("path").alias("current_path"), F.lit("pdf").alias("extension"), F.col("body").alias("text"), ex.alias("examples"), F.when(F.col("id") % 3 == 0, "report").alias("category"))


NL = "chr(10)"


@query(f"""select id, '현재 파일명: ' || name || {NL} || '현재 위치: ' || path || {NL} || '확장자: pdf' || {NL} || {NL} || '문서 분석 표본 (앞·중간·뒤, 최대 6000자):' || {NL} || '---' || {NL} || substring(body, 1, 6000) || {NL} || '---' ||
 case when id % 2 = 0 then {NL} || {NL} || '참고: 비슷한 문서들은 다음 표기 관례로 정리됐습니다. 현재 문서 본문에 없는 과목·주제를 복사하지 마십시오.' || {NL} || '  - ' || source || '.pdf  ->  report 폴더' else '' end || {NL} || {NL} || '이 파일을 분석해 JSON 한 개만 출력하십시오.' ||
 case when id % 3 = 0 then {NL} || {NL} || '참고: 이 문서의 분류는 ''report''로 확정되어 있다. recommended_folder는 report/ 아래로 잡으십시오.' else '' end as prompt,
 '파일: ' || name || ' (pdf)' || {NL} || '본문:' || {NL} || substring(body, 1, 6000) || case when id % 2 = 0 then {NL} || '표기 예시: ' || source || '.pdf' || {NL} || '예시의 주제는 복사하지 마십시오.' else '' end as slim_prompt from {DOCS}""")
def g1_build_prompts(spark, sf_dir):
    return sg.build_prompts(prompted(spark, sf_dir)).select("id", "prompt", "slim_prompt")


def responses(spark, sf_dir):
    """A response for each document, broken in one way or another by its id."""
    i, n = F.col("id"), lambda k: F.col("id") % 12 == k
    name = F.when(n(1), "bad:name.pdf").when(n(2), "CON.pdf").when(n(3), "noext").when(n(4), "").otherwise(F.col("name"))
    folder = F.when(n(5), "/abs").when(n(6), "a/../b").otherwise(F.col("source"))
    conf = F.when(n(7), F.lit(1.5)).otherwise(F.lit(0.5))
    made = F.to_json(F.struct(F.when(n(8), "nonsense").otherwise("report").alias("category"), folder.alias("recommended_folder"), name.alias("recommended_filename"), conf.alias("confidence"), F.when(n(9), F.repeat(F.lit("r"), 201)).otherwise("ok").alias("reason")))
    return docs(spark, sf_dir).select("id", F.when(n(10), "not json").when(n(11), F.regexp_replace(made, r"\}$", ',"more":1}')).otherwise(made).alias("response"), (i % 12).alias("kind"))


RULES = "['', 'recommended_filename:illegal_characters', 'recommended_filename:reserved', 'recommended_filename:no_extension', 'recommended_filename:empty', 'recommended_folder:absolute', 'recommended_folder:climbs', 'confidence:out_of_range', 'category:unknown', 'reason:too_long', ':not_json', 'more:extra']"


@query(f"select id, list_extract({RULES}, (id % 12 + 1)::int) as found, id % 12 = 0 as valid from {DOCS}")
def g2_validate_suggestions(spark, sf_dir):
    out = sg.validate_suggestions(responses(spark, sf_dir))
    return out.select("id", F.array_join(F.transform("violations", lambda x: F.concat_ws(":", x["field"], x["rule"])), ",").alias("found"), "valid")


@query(f"select id, replace(case when id % 12 = 0 then '' else '- ' || replace(list_extract({RULES}, (id % 12 + 1)::int), ':', ': ') end, '- : ', '- (전체): ') as text from {DOCS}")
def g3_violation_text(spark, sf_dir):
    out = sg.validate_suggestions(responses(spark, sf_dir))
    return out.select("id", sg.violation_text(F.col("violations")).alias("text"))


def attempts(spark, sf_dir):
    first = sg.validate_suggestions(responses(spark, sf_dir)).where("kind <> 11")
    fixed = responses(spark, sf_dir).where("kind between 1 and 10").withColumn("response", F.when(F.col("kind") <= 4, F.lit('{"category":"etc","recommended_folder":"x","recommended_filename":"a.pdf","confidence":1,"reason":"r"}')).otherwise(F.col("response")))
    return first, sg.validate_suggestions(fixed)


@query(f"select id, case when id % 12 <= 4 then 'success' else 'failed' end as status, id % 12 > 0 as retried from {DOCS} where id % 12 <> 11")
def g4_merge_retry(spark, sf_dir):
    return sg.merge_retry(*attempts(spark, sf_dir)).select("id", "status", "retried")


@query(f"select count(*) as n, count_if(id % 12 > 0) as retried, count_if(id % 12 between 1 and 4) as rescued, round(count_if(id % 12 between 1 and 4)::double / count_if(id % 12 > 0), 6) as rescue_rate, round(count_if(id % 12 <= 4)::double / count(*), 6) as valid_rate from {DOCS} where id % 12 <> 11")
def g4_retry_stats(spark, sf_dir):
    out = sg.retry_stats(sg.merge_retry(*attempts(spark, sf_dir)))
    return out.withColumns({c: F.round(c, 6) for c in ("rescue_rate", "valid_rate")})


EXAMPLE = "array<struct<file_name:string,category:string>>"


def parts(spark, sf_dir):
    """documents as name parts: the first word and the source are proposed, the text is the evidence."""
    d = docs(spark, sf_dir)
    first = F.regexp_extract("body", r"^([A-Za-z]+)", 1)
    ex = F.array(F.struct(F.concat(F.upper(F.col("lang")), F.lit("-x-y.pdf")).alias("file_name"), F.lit("report").alias("category")))
    return d.select(
        "id", first.alias("subject"), F.col("source").alias("topic"), F.lit("memo").alias("document_type"), F.lit("2025-1").alias("semester"), F.lit("PDF").alias("extension"),
        F.element_at(F.array(*map(F.lit, lx.CATEGORIES)), (F.col("id") % 10 + 1).cast("int")).alias("category"), F.when(F.col("id") % 2 == 0, F.col("body")).otherwise("").alias("evidence"),
        F.when(F.col("id") % 4 == 1, ex).alias("examples"), F.lit(None).cast("string").alias("legacy"), "lang", "body",
    )


_first = "regexp_extract(body, '^([A-Za-z]+)', 1)"
_type = f"list_extract([{', '.join(map(q, lx.DOCUMENT_TYPES.values()))}], (id % 10 + 1)::int)"
_sep = "case when id % 4 = 1 then '-' else '_' end"
_even = f"case when length({_first}) >= 2 then {_first} else '' end"
_sup = f"list_filter([{_even}, case when contains(lower(regexp_replace(body, '[^0-9A-Za-z가-힣]', '', 'g')), source) then source else '' end, {_type}, case when regexp_matches(body, '(20\\d{{2}})\\s*(?:[-./년]\\s*)?([12])\\s*(?:학기)?') then regexp_extract(body, '(20\\d{{2}})\\s*(?:[-./년]\\s*)?([12])\\s*(?:학기)?', 1) || '-' || regexp_extract(body, '(20\\d{{2}})\\s*(?:[-./년]\\s*)?([12])\\s*(?:학기)?', 2) else '' end], lambda x: x <> '')"
_spelled = f"case when id % 4 = 1 and lower({_first}) in (lang, 'x', 'y', 'pdf') then case when lower({_first}) = lang then upper(lang) else lower({_first}) end else {_first} end"
_odd = f"list_filter([{_spelled}, source, {_type}, '2025-1'], lambda x: x <> '')"


@query(f"select id, case when id % 4 = 1 then array_to_string({_odd}, '-') when id % 2 = 0 then array_to_string({_sup}, '_') else array_to_string({_odd}, '_') end || '.pdf' as filename from {DOCS}")
def g5_build_filename(spark, sf_dir):
    return sg.build_filename(parts(spark, sf_dir)).select("id", "filename")


@query(f"select id, {_even} as subject from {DOCS}")
def g6_supported_component(spark, sf_dir):
    p = parts(spark, sf_dir)
    return p.select("id", sg.supported_component(F.col("subject"), sg.flat_evidence(F.col("body"))).alias("subject"))


@query(f"select id, case when id % 4 = 1 then upper(lang) else lang end as spelled from {DOCS}")
def g7_preferred_spelling(spark, sf_dir):
    return parts(spark, sf_dir).select("id", sg.preferred_spelling(F.col("lang"), F.col("examples")).alias("spelled"))


@query(f"select id, {_sep} as separator from {DOCS}")
def g8_preferred_separator(spark, sf_dir):
    return parts(spark, sf_dir).select("id", sg.preferred_separator(F.col("examples")).alias("separator"))


@query(f"select id, case when length({_first}) >= 2 then 'AI' when {_first} = '' then 'ai' else 'ai_' || {_first} end as subject, {_even} as topic from {DOCS}")
def g9_split_known_subject(spark, sf_dir):
    p = parts(spark, sf_dir)
    out = sg.split_known_subject(F.concat(F.lit("ai "), F.col("subject")), sg.flat_evidence(F.col("body")))
    return p.select("id", out.alias("s")).select("id", "s.subject", "s.topic")


@query(f"""select id, case when id % 3 = 0 then 'report' else 'etc' end as category, case when id % 3 = 0 then 'x/' || lang when id % 2 = 0 then 'etc' else 'etc' end as recommended_folder,
 case when id % 3 = 0 then 'why' else 'why (분류: 라벨 정의문 유사도 40%)' end as reason, case when id % 3 = 0 then 0.9 else 0.4 end as confidence from {DOCS}""")
def g10_override_category(spark, sf_dir):
    d = docs(spark, sf_dir).select("id", F.lit("report").alias("category"), F.concat(F.lit("x/"), F.col("lang")).alias("recommended_folder"), F.lit("why").alias("reason"), F.lit(0.9).alias("confidence"), F.when(F.col("id") % 3 == 0, "report").otherwise("etc").alias("own_category"), F.lit(0.4).alias("own_confidence"), F.lit("label_zeroshot").alias("method"))
    return sg.override_category(d).select("id", "category", "recommended_folder", "reason", "confidence")


@query(f"select id, 'report' as category, 'report' as recommended_folder, name as recommended_filename, 0.75 as confidence, 'k-NN 다수결 분류 (신뢰도 75%), 파일명은 소형 LLM 생성 (slim 모드)' as reason from {DOCS}")
def g11_assemble_slim(spark, sf_dir):
    d = docs(spark, sf_dir).select("id", F.col("name").alias("filename"), F.lit("report").alias("category"), F.lit(0.75).alias("confidence"), F.lit("knn").alias("method"))
    return sg.assemble_slim(d).select("id", "suggestion.*")


@query(f"select path, status, total from (select path, case when id % 9 = 0 then 'failed' else 'success' end as status, row_number() over (order by path) as r, count(*) over () as total from {DOCS}) where r between 21 and 50")
def g12_organize_page(spark, sf_dir):
    d = docs(spark, sf_dir).select("path", F.when(F.col("id") % 9 == 0, "broken").otherwise("").alias("error"), F.lit("text").alias("normalized_text"))
    return sg.organize_page(d, 20, 30).select("path", "status", "total")


_kinds = list(dict.fromkeys(a for a, _ in lx.CATEGORY_RULES)) + ["unknown"]
_rules = " ".join(f"when k = {q(a)} and w = {q(b)} then {q(c)}" for (a, b), c in lx.CATEGORY_RULES.items())


@query(f"select o_orderkey, case {_rules} end as category, k <> 'unknown' as known from (select o_orderkey, list_extract([{', '.join(map(q, _kinds))}], (o_orderkey % {len(_kinds)} + 1)::int) as k, case when o_orderkey % 2 = 0 then '개인' else '팀' end as w from orders)")
def g13_rule_category(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.element_at(F.array(*map(F.lit, _kinds)), (F.col("o_orderkey") % len(_kinds) + 1).cast("int")).alias("document_type"), F.when(F.col("o_orderkey") % 2 == 0, "개인").otherwise("팀").alias("work_mode"))
    return sg.rule_category(o).select("o_orderkey", "category", "known")


@query("select p_partkey, regexp_replace(replace(p_brand || '_' || p_name || '_' || p_type || '_2025-1', ' ', '_'), '^[._]+|[._]+$', '', 'g') || '.pdf' as filename, 'report/' || replace(p_brand, ' ', '_') || '/2025-1/x.pdf' as path from part")
def g14_ideal_filename(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", sg.ideal_filename(F.col("p_brand"), F.col("p_name"), F.col("p_type"), F.lit("2025-1"), F.lit(".pdf")).alias("filename"), sg.ideal_path(F.lit("report"), F.col("p_brand"), F.lit("2025-1"), F.lit("x.pdf")).alias("path"))


def qa_sql() -> str:
    drawn = lambda seed, n: f"(('0x' || substring(md5(id || ':{seed}'), 1, 8))::bigint % {n} + 1)"
    listed = lambda values, seed: f"list_extract([{', '.join(map(q, values))}], {drawn(seed, len(values))})"
    filled = lambda k: f"replace(replace(replace({listed([t[k] for t in sg.QUESTION_TEMPLATES], 1)}, '{{title}}', '문서' || id), '{{topic}}', {listed(sg.TOPICS, 2)}), '{{summary}}', summary)"
    summary = r"case when length(body) > 0 then substring(string_split(regexp_replace(body, '^\s+', ''), chr(10))[1], 1, 120) || '...' else '요약 없음' end"
    return f"select id, {filled(0)} as question, substring(body, 1, 2000) as context, {filled(1)} as answer from (select *, {summary} as summary from {DOCS})"


@query(qa_sql())
def g15_qa_pairs(spark, sf_dir):
    return sg.qa_pairs(docs(spark, sf_dir).select("id", F.col("body").alias("text")))


@query("select id, current_name, recommended_name, target_folder, confidence from (select o_orderkey as id, o_orderstatus as current_name, o_orderpriority as recommended_name, case when o_orderkey % 2 = 0 then 'a' else 'b' end as target_folder, case when o_orderkey % 2 = 0 then 0.75 else 0.5 end as confidence from orders)")
def g16_harmonise_fields(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    old = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("old"), F.col("o_orderpriority").alias("next"), F.lit("a").alias("to"), F.lit(75.0).alias("score"))
    new = o.where("o_orderkey % 2 = 1").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("current"), F.col("o_orderpriority").alias("recommended"), F.lit("b").alias("target"), F.lit(0.5).alias("score"))
    return sg.harmonise_fields(old, new)


# --- moves: documents aimed at few names


def wanted(spark, sf_dir):
    d = docs(spark, sf_dir)
    folder = F.when(F.col("id") % 13 == 0, "../out").when(F.col("id") % 17 == 0, F.concat_ws("/", "source", "lang")).otherwise(F.concat(F.lit("done/"), F.col("lang")))
    name = F.when(F.col("id") % 11 == 0, "x.txt").when(F.col("id") % 17 == 0, F.col("name")).otherwise(F.concat(F.lit("paper_"), (F.col("id") % 7).cast("string"), F.lit(".pdf")))
    return d.select(F.col("id").alias("seq"), F.when(F.col("id") % 19 == 0, "/gone.pdf").otherwise(F.concat(F.lit("/root"), F.col("path"))).alias("source_path"), folder.alias("target_folder"), name.alias("target_filename"))


def standing(spark, sf_dir):
    return docs(spark, sf_dir).select(F.concat(F.lit("/root"), F.col("path")).alias("path"), F.lit(True).alias("is_file"))


CHECKED = f"""va as (select *, case when id % 19 = 0 then 'failed' when id % 13 = 0 then 'failed' when id % 11 = 0 then 'failed' when id % 17 = 0 then 'skipped' else 'open' end as status,
 case when id % 19 = 0 then 'source_missing' when id % 13 = 0 then 'unsafe_path: target' when id % 11 = 0 then 'extension_mismatch' when id % 17 = 0 then 'already_in_place' else '' end as reason from {DOCS}),
 pl as (select id as seq, '/root' || path as source, case when status = 'open' and n <= {mv.MOST_NUMBER + 1} then '/root/done/' || lang || '/paper_' || (id % 7) || case when n = 1 then '' else ' (' || (n - 1) || ')' end || '.pdf' when status = 'skipped' then '/root' || path end as target,
 case when status = 'open' then case when n <= {mv.MOST_NUMBER + 1} then 'valid' else 'failed' end else status end as status, case when status <> 'open' then reason when n > {mv.MOST_NUMBER + 1} then 'conflict_exhausted' when n > 1 then 'conflict_renamed' else '' end as reason
 from (select *, row_number() over (partition by status, lang, case when status = 'open' then id % 7 end order by id) as n from va))"""


@query(f"with {CHECKED} select id as seq, status, reason from va")
def h1_validate_moves(spark, sf_dir):
    return mv.validate_moves(wanted(spark, sf_dir), standing(spark, sf_dir), "/root").select("seq", "status", "reason")


def planned(spark, sf_dir):
    catalog = standing(spark, sf_dir)
    return mv.assign_targets(mv.validate_moves(wanted(spark, sf_dir), catalog, "/root"), catalog)


@query(f"with {CHECKED} select seq, target, status, reason from pl")
def h2_assign_targets(spark, sf_dir):
    return planned(spark, sf_dir).select("seq", "target", "status", "reason")


@query(f"with {CHECKED} select seq, target from pl where status = 'valid'")
def h2_window_targets(spark, sf_dir):
    return mv.window_targets(mv.validate_moves(wanted(spark, sf_dir), standing(spark, sf_dir), "/root")).where("status = 'valid'").select("seq", "target")


@query(f"with {CHECKED} select count(*) as total, count_if(status = 'valid') as moved, count_if(status = 'failed') as failed, count_if(reason = 'conflict_renamed') as renamed from pl")
def h3_plan_summary(spark, sf_dir):
    return mv.plan_summary(planned(spark, sf_dir))


def history(spark, sf_dir):
    """A run for each user: their orders as moves between two folders."""
    o = read(spark, sf_dir, "orders")
    p = lambda a: F.concat(F.lit(a), F.col("o_orderkey").cast("string"))
    last = o.groupBy("o_custkey").agg(F.max("o_orderdate").cast("timestamp").alias("applied_at"))
    rows = o.join(last.hint("merge"), "o_custkey")
    return rows.select(F.concat(F.lit("run"), F.col("o_custkey").cast("string")).alias("id"), F.lit("/").alias("root"), "applied_at", F.col("o_orderkey").cast("long").alias("seq"), p("/a/").alias("from"), p("/b/").alias("to"), (F.col("o_custkey") % 3 == 0).alias("undone"))


@query(f"with {CHECKED} select 'r1' as id, seq, source as \"from\", target as \"to\", false as undone from pl where status = 'valid'")
def h4_record_history(spark, sf_dir):
    return mv.record_history(planned(spark, sf_dir), "r1", "/root", F.to_timestamp(F.lit("2024-03-01"))).select("id", "seq", "from", "to", "undone")


HISTORY = "hi as (select 'run' || o_custkey as id, count(*) as moves, max(o_orderdate) as applied_at, o_custkey % 3 = 0 as undone from orders group by o_custkey)"


@query(f"""with {HISTORY}, la as (select id from hi where not undone order by applied_at desc, id desc limit 1)
 select la.id, o_orderkey as seq, '/b/' || o_orderkey as "from", '/a/' || o_orderkey as "to", case when o_orderkey % 5 = 0 then 'skipped' else 'restored' end as status, case when o_orderkey % 5 = 0 then 'moved_file_missing' else '' end as reason
 from la join orders on 'run' || o_custkey = la.id""")
def h5_undo_plan(spark, sf_dir):
    there = read(spark, sf_dir, "orders").where("o_orderkey % 5 <> 0").select(F.concat(F.lit("/b/"), F.col("o_orderkey").cast("string")).alias("path"), F.lit(True).alias("is_file"))
    return mv.undo_plan(history(spark, sf_dir), there)


@query(f"with {HISTORY} select id, moves as count, undone from hi order by applied_at desc, id desc limit 20")
def h6_list_history(spark, sf_dir):
    return mv.list_history(history(spark, sf_dir), 20).select("id", F.col("count").cast("long").alias("count"), "undone")


@query("""with p as (select r_name || '/' || n_name || '/' || c_mktsegment as path from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)
 select '' as folder, 0 as depth, count(*) as file_count from p union all select split_part(path, '/', 1), 1, count(*) from p group by 1 union all select split_part(path, '/', 1) || '/' || split_part(path, '/', 2), 2, count(*) from p group by 1 union all select path, 3, count(*) from p group by 1""")
def h7_folder_rollup(spark, sf_dir):
    c, n, r = (read(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    p = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.concat_ws("/", F.lit("Documents"), "r_name", "n_name", "c_mktsegment").alias("path"))
    return mv.folder_rollup(p, "path")


@query(f"select count(distinct folder) as target_folders from (select case when id % 13 = 0 then '../out' when id % 17 = 0 then source || '/' || lang else 'done/' || lang end as folder from {DOCS})")
def h8_distinct_targets(spark, sf_dir):
    return mv.distinct_targets(wanted(spark, sf_dir))


@query("select user_id as id, case when user_id % 4 = 0 then 'edited' else arg_max(event_type, (ts, event_id)) end as recommended_name from events group by user_id")
def h9_merge_pages(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.struct("ts", "event_id").alias("page"), F.col("event_type").alias("recommended_name"))
    edits = read(spark, sf_dir, "events").where("user_id % 4 = 0").select(F.col("user_id").alias("id"), F.lit("edited").alias("edited_name")).distinct()
    return mv.merge_pages(e, edits).select("id", "recommended_name")


@query(f"with {CHECKED} select case when pl.status = 'valid' then target else '/root' || path end as path from va join pl on va.id = pl.seq")
def h10_catalog_after_apply(spark, sf_dir):
    return mv.catalog_after_apply(standing(spark, sf_dir), planned(spark, sf_dir)).select("path")


@query(f"with {CHECKED} select seq from pl where status = 'failed'")
def h10_pending_after_apply(spark, sf_dir):
    return mv.pending_after_apply(wanted(spark, sf_dir), planned(spark, sf_dir)).select("seq")


@query("select doc_id as id from documents where doc_id in (select doc_id from labels where quality = 1)")
def h11_approved_items(spark, sf_dir):
    approved = read(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return mv.approved_items(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), approved)

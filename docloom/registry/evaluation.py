"""Queries over evaluation and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.operators import evaluate as ev
from docloom.operators import quality as ql
from docloom.operators import vectors as vx
from docloom.registry.search import LABEL, LV, label_name, label_vectors
from docloom.registry.tables import DOCS, VECTORS, docs, read, scratch, vectors

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = " ".join(sql.split("\n"))
        return f

    return put


def ranked(spark, sf_dir):
    """Every vector asks; its first five neighbours, without itself, are its hits; topics are labels."""
    v = vectors(spark, sf_dir)
    ex = v.select(F.col("id").alias("eid"), F.col("v").alias("ev"))
    near = vx.nearest(v.select("id", "v"), ex, 6).where("id <> eid")
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("place")))
    topic = v.select(F.col("id").alias("eid"), F.col("label").cast("string").alias("topic"))
    hits = near.join(topic.hint("merge"), "eid").select(F.col("id").alias("query_id"), F.col("place").alias("rank"), "topic")
    queries = v.select(F.col("id").alias("query_id"), F.col("label").cast("string").alias("topic_title"), F.when(F.col("id") % 4 == 0, "keyword").otherwise("paraphrase").alias("difficulty"), F.col("topic").cast("double").alias("elapsed_ms"))
    return hits, queries


RANKED = f"""a as (select * from {VECTORS}), hi as (select * from (select x.id as query_id, y.label::varchar as topic, row_number() over (partition by x.id order by list_inner_product(x.v, y.v) desc, y.id) as rank from a x, a y where x.id <> y.id) where rank <= 5),
 me as (select x.id as query_id, x.label::varchar as topic_title, case when x.id % 4 = 0 then 'keyword' else 'paraphrase' end as difficulty, any_value(x.topic)::double as elapsed_ms, min(case when h.topic = x.label::varchar then rank end) as first_rank, count_if(h.topic = x.label::varchar) as relevant from a x left join hi h on h.query_id = x.id group by x.id, x.label)"""


@query(f"with {RANKED} select query_id, first_rank, relevant, case when first_rank = 1 then 1 else 0 end as hit_at_1, case when first_rank is null then 0 else 1 end as hit_at_k, round(coalesce(1.0 / first_rank, 0), 6) as reciprocal_rank from me")
def i1_retrieval_metrics(spark, sf_dir):
    out = ev.retrieval_metrics(*ranked(spark, sf_dir), 5)
    return out.select("query_id", "first_rank", "relevant", "hit_at_1", "hit_at_k", F.round("reciprocal_rank", 6).alias("reciprocal_rank"))


@query(f"with {RANKED} select difficulty, count(*) as n, round(avg(case when first_rank = 1 then 1.0 else 0 end), 6) as top1, round(avg(case when first_rank is null then 0.0 else 1 end), 6) as recall, round(avg(coalesce(1.0 / first_rank, 0)), 6) as mrr, round(avg(relevant / 5.0), 6) as precision, median(elapsed_ms) as median_ms from me group by rollup(difficulty)")
def i2_metrics_by_difficulty(spark, sf_dir):
    out = ev.metrics_by_difficulty(ev.retrieval_metrics(*ranked(spark, sf_dir), 5), 5)
    return out.select("difficulty", "n", *(F.round(c, 6).alias(c) for c in ("top1", "recall", "mrr", "precision")), "median_ms")


def judged(spark, sf_dir):
    """Labels and what zero-shot classification says of every vector."""
    v = vectors(spark, sf_dir)
    z = vx.zero_shot(v.select("id", "v"), label_vectors(spark, sf_dir))
    return v.select("id", label_name(F.col("label")).alias("truth")).join(z.select("id", F.col("category").alias("predicted"), F.col("confidence").alias("sim")), "id")


JUDGED = f"""{LV}, zs as (select x.id, {LABEL.replace('label', 'x.label')} as truth, lv.label, list_inner_product(x.v, lv.lv) as sim from {VECTORS} x, lv),
 ju as (select id, truth, case when max(sim) >= 0.35 then arg_max(label, (sim, label)) else 'etc' end as predicted, max(sim) as sim from zs group by id, truth)"""


@query(f"with {JUDGED} select truth, count_if(truth = predicted) as correct, count(*) as total, round(count_if(truth = predicted)::double / count(*), 6) as accuracy from ju group by rollup(truth)")
def i3_accuracy_report(spark, sf_dir):
    return ev.accuracy_report(judged(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 6))


@query(f"with {JUDGED} select truth, predicted, count(*) as n from ju where truth <> predicted group by truth, predicted order by n desc, truth, predicted limit 5")
def i4_confusions(spark, sf_dir):
    return ev.confusions(judged(spark, sf_dir), 5)


def _decile(p: float) -> str:
    at = f"({p} * (n + 1))"
    low = f"least(greatest(floor({at}), 1), n - 1)::int"
    return f"round(l[{low}] + (l[{low} + 1] - l[{low}]) * ({at} - {low}), 6)"


@query(f"with {JUDGED}, ls as (select case when truth = 'etc' then 'etc' else 'in' end as kind, list_sort(list(round(sim, 9))) as l, count(*) as n from ju group by 1) select kind, n, {_decile(0.1)} as low_decile, {_decile(0.5)} as median, {_decile(0.9)} as high_decile from ls")
def i5_threshold_deciles(spark, sf_dir):
    sims = judged(spark, sf_dir).select(F.when(F.col("truth") == "etc", "etc").otherwise("in").alias("kind"), "sim")
    return ev.threshold_deciles(sims).select("kind", "n", *(F.round(c, 6).alias(c) for c in ("low_decile", "median", "high_decile")))


def predicted_names(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    made = F.concat_ws("_", F.when(F.col("p_partkey") % 3 == 0, "x").otherwise(F.col("p_brand")), F.element_at(F.split("p_name", " "), 1), F.replace("p_type", F.lit(" "), F.lit("")), F.when(F.col("p_partkey") % 2 == 0, "2025-1").otherwise("2024-2"))
    return p.select("p_partkey", F.concat(made, F.lit(".pdf")).alias("predicted"), F.col("p_brand").alias("course"), F.col("p_name").alias("topic_title"), F.col("p_type").alias("doc_type"), F.lit("2025-1").alias("semester"), F.lit("pdf").alias("extension"), F.concat(F.concat_ws("_", "p_brand", F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("2025-1")), F.lit(".pdf")).alias("ideal"))


NAMES = """nm as (select p_partkey, case when p_partkey % 3 = 0 then 'x' else p_brand end || '_' || split_part(p_name, ' ', 1) || '_' || replace(p_type, ' ', '') || '_' || case when p_partkey % 2 = 0 then '2025-1' else '2024-2' end || '.pdf' as predicted, p_brand, p_name, p_type, p_brand || '_' || replace(p_name, ' ', '_') || '_2025-1.pdf' as ideal from part),
 ck as (select *, contains(predicted, p_brand) as a, len(list_filter(string_split_regex(p_name, '\\s+'), lambda w: length(w) > 1 and contains(predicted, w))) > 0 as b, contains(replace(replace(predicted, ' ', ''), '_', ''), replace(p_type, ' ', '')) as c, contains(predicted, '2025-1') as d from nm)"""


@query(f"with {NAMES} select p_partkey, a as has_course, b as has_topic, c as has_doc_type, d as has_semester, true as has_extension, round((a::int + b::int + c::int + d::int + 1) / 5.0, 6) as filename_score from ck")
def i6_filename_components(spark, sf_dir):
    return ev.filename_components(predicted_names(spark, sf_dir)).select("p_partkey", "has_course", "has_topic", "has_doc_type", "has_semester", "has_extension", F.round("filename_score", 6).alias("filename_score"))


def _tokens(c: str) -> str:
    return f"list_distinct(list_filter(string_split_regex(regexp_replace({c}, '\\.pdf$', ''), '[_\\s\\-()]+'), lambda x: x <> ''))"


@query(f"with {NAMES}, tk as (select p_partkey, {_tokens('predicted')} as p, {_tokens('ideal')} as g from nm) select p_partkey, round(2.0 * len(list_intersect(p, g)) / (len(p) + len(g)), 6) as f1 from tk")
def i7_token_f1(spark, sf_dir):
    return predicted_names(spark, sf_dir).select("p_partkey", F.round(ev.token_f1(F.col("predicted"), F.col("ideal")), 6).alias("f1"))


def model_runs(spark, sf_dir):
    """Turns of conversations as runs of two models, by their length."""
    c = read(spark, sf_dir, "conversations")
    n = F.length("text")
    return c.select(F.concat(F.lit("m"), (F.col("conv_id") % 2).cast("string")).alias("model"), F.col("role").alias("run"), (n % 2).alias("category_correct"), F.when(n % 3 == 0, 0).otherwise(1).alias("json_valid"), (n / 100.0).alias("elapsed_sec"), F.when(n % 5 != 0, (n % 7) / 7.0).alias("filename_score"), ((n % 11) / 11.0).alias("filename_token_f1"), (n % 2).alias("is_correct"), F.concat(F.lit("p"), (n % 6).cast("string")).alias("predicted"), F.when(n % 4 == 0, F.concat(F.lit("e"), (n % 3).cast("string"))).otherwise("").alias("error"))


RUNS = "ru as (select 'm' || (conv_id % 2) as model, role as run, length(text) as n from conversations)"
SUMMARY = f"""{RUNS}, su as (select model, count(*) as n, sum(n % 2)::double / count(*) as category_accuracy, coalesce(avg(case when n % 5 <> 0 then (n % 7) / 7.0 end), 0) as filename_score, avg((n % 11) / 11.0) as filename_token_f1, sum(case when n % 3 = 0 then 0 else 1 end)::double / count(*) as json_valid_rate, avg(n / 100.0) as avg_sec from ru group by model)"""


@query(f"with {SUMMARY} select model, n, round(category_accuracy, 6) as category_accuracy, round(filename_score, 6) as filename_score, round(filename_token_f1, 6) as filename_token_f1, round(json_valid_rate, 6) as json_valid_rate, round(avg_sec, 6) as avg_sec from su")
def i8_model_summary(spark, sf_dir):
    out = ev.model_summary(model_runs(spark, sf_dir))
    return out.select("model", "n", *(F.round(c, 6).alias(c) for c in out.columns[2:]))


@query(f"with {SUMMARY} select model as best from su order by category_accuracy + filename_score desc, json_valid_rate desc, avg_sec, model desc limit 1")
def i8_pick_best(spark, sf_dir):
    return ev.pick_best(ev.model_summary(model_runs(spark, sf_dir)))


@query(f"""with {RUNS}, ba as (select run, model, count(*) as n, sum(n % 2) as correct, sum(case when n % 3 = 0 then 0 else 1 end) as valid, round(avg(n / 100.0), 6) as avg_sec from ru group by run, model),
 pr as (select run, model, 'p' || (n % 6) as p, count(*) as c from ru group by run, model, p), pt as (select run, model, string_agg(p || '=' || c, ', ' order by c desc, p) as top_predictions from (select *, row_number() over (partition by run, model order by c desc, p) as r from pr) where r <= 4 group by run, model),
 er as (select run, model, 'e' || (n % 3) as p, count(*) as c from ru where n % 4 = 0 group by run, model, p), et as (select run, model, string_agg(p || '=' || c, ', ' order by c desc, p) as errors from er group by run, model)
 select ba.*, top_predictions, errors from ba left join pt using (run, model) left join et using (run, model)""")
def i9_run_summary(spark, sf_dir):
    return ev.run_summary(model_runs(spark, sf_dir)).withColumn("avg_sec", F.round("avg_sec", 6))


@query("with c as (select label, count(*) as c from embeddings group by label) select round(max(c)::double / sum(c), 6) as majority, round(1.0 / count(*), 6) as random, count(*) as classes from c")
def i10_baselines(spark, sf_dir):
    return ev.baselines(read(spark, sf_dir, "embeddings"), "label").select(F.round("majority", 6).alias("majority"), F.round("random", 6).alias("random"), "classes")


_folders = ["Report", "과제", "시험", "misc"]


@query(f"select id, list_extract(['report', 'assignment', 'exam_prep', null], (id % 4 + 1)::int) as truth from {DOCS}")
def i11_folder_truth(spark, sf_dir):
    d = docs(spark, sf_dir).select("id", F.concat(F.lit("/root/"), F.element_at(F.array(*map(F.lit, _folders)), (F.col("id") % 4 + 1).cast("int")), F.lit("/"), F.col("name")).alias("path"))
    return ev.folder_truth(d).select("id", "truth")


@query(f"with {RANKED} select x.id as query_id, case when h.topic in ((x.label)::varchar, ((x.label + 1) % 10)::varchar) then 1 else 0 end as hit from a x left join (select * from hi where rank = 1) h on h.query_id = x.id")
def i12_acceptable_top1(spark, sf_dir):
    hits, _ = ranked(spark, sf_dir)
    asked = vectors(spark, sf_dir).select(F.col("id").alias("query_id"), F.array(F.col("label").cast("string"), ((F.col("label") + 1) % 10).cast("string")).alias("acceptable"))
    return ev.acceptable_top1(hits.withColumnRenamed("topic", "category"), asked).select("query_id", "hit")


@query("select lang as value, count(*) as n, round(count(*)::double / (select count(*) from documents), 6) as ratio, count(*)::double / (select count(*) from documents) > 0.3 as skewed from documents group by lang")
def j1_distribution(spark, sf_dir):
    return ql.distribution(read(spark, sf_dir, "documents"), "lang").withColumn("ratio", F.round("ratio", 6))


@query("select o_orderkey as value, 'missing' as problem from orders where o_orderkey not in (select l_partkey from lineitem) union all select l_partkey, 'unknown' from lineitem where l_partkey not in (select o_orderkey from orders) group by l_partkey")
def j2_domain_check(spark, sf_dir):
    """Order keys stand for the expected values, part keys for the ones that occur."""
    return ql.domain_check(read(spark, sf_dir, "lineitem"), "l_partkey", read(spark, sf_dir, "orders").select("o_orderkey"))


@query("select doc_id, contains(text, chr(65533)) as mojibake, regexp_replace(text, '\\s+', '', 'g') = '' as empty_text, regexp_matches(text, '[가-힣]') as has_hangul, length(text) as text_length from documents")
def j3_text_health(spark, sf_dir):
    return ql.text_health(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


@query("select split_part(case when doc_id % 4 = 0 then 'error: ' || lang else 'success' end, ':', 1) as status, count(*) as n from documents group by 1")
def j4_status_counts(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("error: "), F.col("lang"))).otherwise("success").alias("status"))
    return ql.status_counts(d)


def gain_sql(table: str, label: str, keys: list[str]) -> str:
    k = ", ".join(keys)
    return f"""with pa as (select {k}, {label} as l, count(*) as c from {table} group by {k}, {label}), gr as (select {k}, sum(c) as g, max(c) as top, sum(c * log2(c)) as clogc from pa group by {k}),
 ins as (select sum(g * log2(g) - clogc) / sum(g) as h_given, sum(top)::double / sum(g) as ceiling, count(*) as groups from gr), la as (select -sum(p * log2(p)) as h from (select sum(c)::double / (select sum(c) from pa) as p from pa group by l))
 select '{'+'.join(keys)}' as signal, round(h, 6) as h_label, round(h_given, 6) as h_given, round(h - h_given, 6) as gain, round((h - h_given) / h, 6) as gain_share, round(ceiling, 6) as ceiling, groups from ins, la"""


@query("select round(-sum(p * log2(p)), 6) as entropy from (select count(*)::double / (select count(*) from events) as p from events group by event_type)")
def j5_entropy(spark, sf_dir):
    return ql.entropy(read(spark, sf_dir, "events"), "event_type").select(F.round("entropy", 6).alias("entropy"))


@query(gain_sql("events", "event_type", ["user_id"]))
def j5_information_gain(spark, sf_dir):
    out = ql.information_gain(read(spark, sf_dir, "events"), "event_type", ["user_id"])
    return out.select("signal", *(F.round(c, 6).alias(c) for c in ("h_label", "h_given", "gain", "gain_share", "ceiling")), "groups")


@query(gain_sql("orders", "o_orderpriority", ["o_orderstatus", "o_custkey"]))
def j5_information_gain_of_two(spark, sf_dir):
    out = ql.information_gain(read(spark, sf_dir, "orders"), "o_orderpriority", ["o_orderstatus", "o_custkey"])
    return out.select("signal", *(F.round(c, 6).alias(c) for c in ("h_label", "h_given", "gain", "gain_share", "ceiling")), "groups")


LATTICE = [["o_orderstatus"], ["o_orderdate"], ["o_custkey"], ["o_orderstatus", "o_custkey"], ["o_orderstatus", "o_orderdate"]]


@query(" union all ".join(f"select * from ({gain_sql('orders', 'o_orderpriority', keys)})" for keys in LATTICE))
def j5_information_gain_lattice(spark, sf_dir):
    """Five sets of keys from one reading."""
    out = ql.information_gains(read(spark, sf_dir, "orders"), "o_orderpriority", LATTICE)
    return out.select("signal", *(F.round(c, 6).alias(c) for c in ("h_label", "h_given", "gain", "gain_share", "ceiling")), "groups")


@query("select l_returnflag, l_linestatus, count(*) as n, string_agg(distinct l_linenumber::varchar, ',' order by l_linenumber::varchar) as labels, count(distinct l_linenumber) > 1 as impure from lineitem group by l_returnflag, l_linestatus")
def j6_cross_tab_purity(spark, sf_dir):
    return ql.cross_tab_purity(read(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", "l_linenumber")


@query("select count(*) as n, count_if(doc_id % 4 <> 0) as success, count_if(doc_id % 8 = 0) as odd, 'row_count,unexpected_status' as failures, false as passed from documents")
def j7_dataset_gate(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 8 == 0, "ok").when(F.col("doc_id") % 4 == 0, "error").otherwise("success").alias("extraction_status"))
    return ql.dataset_gate(d, 7).withColumn("failures", F.array_join("failures", ",")).drop("mojibake")


GATED = {"category": ["en", "de", "fr", "tlh"], "extension": ["src0", "src1", "src2"]}
OTHERS = {"category": "lang", "extension": "source"}


def gate_sql() -> str:
    """The rules of the gate over documents, with every failure as a case."""
    held = lambda c, v: f"count_if({OTHERS[c]} = '{v}')" if v != "other" else f"count_if({OTHERS[c]} is null or {OTHERS[c]} not in ({', '.join(repr(x) for x in GATED[c])}))"
    rules = [("count(*) <> 7", "row_count"), ("count_if(doc_id % 4 <> 0) = 0", "no_success"), ("count_if(doc_id % 8 = 0) > 0", "unexpected_status")]
    for c in GATED:
        if c == "category":
            rules += [(f"{held(c, v)} = 0", f"missing_{c}:{v}") for v in GATED[c]] + [(f"{held(c, 'other')} > 0", f"unknown_{c}")]
        rules += [(f"{held(c, v)} > 0.3 * count(*)", f"skew_{c}:{v}") for v in [*GATED[c], "other"]]
    rules.append(("count_if(doc_id % 50 = 0) > 0", "replacement_characters"))
    failed = ", ".join(f"case when {when} then '{name}' end" for when, name in rules)
    return f"select count(*) as n, count_if(doc_id % 4 <> 0) as success, count_if(doc_id % 8 = 0) as odd, count_if(doc_id % 50 = 0) as mojibake, concat_ws(',', {failed}) as failures, false as passed from documents"


@query(gate_sql())
def j7_gated_write(spark, sf_dir):
    """The documents are written, and what the gate judges is observed on the way."""
    status = F.when(F.col("doc_id") % 8 == 0, "ok").when(F.col("doc_id") % 4 == 0, "error").otherwise("success")
    text = F.when(F.col("doc_id") % 50 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("\ufffd"))).otherwise(F.replace("text", F.lit("\ufffd"), F.lit("")))
    d = read(spark, sf_dir, "documents").select("doc_id", status.alias("extraction_status"), text.alias("first_page_text"), F.col("lang").alias("category"), F.col("source").alias("extension"))
    return ql.write_gated(d, f"{scratch(spark)}/gated", 7, text_col="first_page_text", domains=GATED).withColumn("failures", F.array_join("failures", ","))


@query("select user_id, max(event_id) as event_id from events group by user_id order by md5(user_id::varchar || ':42'), user_id limit 40")
def j8_stable_sample(spark, sf_dir):
    return ql.stable_sample(read(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", 40, order="event_id")

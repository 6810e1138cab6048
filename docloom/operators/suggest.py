"""Preparing prompts and checking model suggestions as tables: prompts out, responses in, validated rows out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import S, clean_component, cut, document_semester, flat_evidence, let, sanitize, short_reason
from docloom.lexicon import CATEGORIES, CATEGORY_RULES, DOCUMENT_TYPES, METHOD_LABELS, RESERVED, TERM_GROUPS, WEAK_WORDS

FIELDS = ("category", "recommended_folder", "recommended_filename", "confidence", "reason")
SAMPLE = 6000
QUESTION_TEMPLATES = (
    ("{title}은 무엇에 관한 문서인가요?", "{title}은(는) {topic}에 관한 문서입니다. {summary}"),
    ("{title}의 핵심 내용은 무엇인가요?", "{topic} 문서인 {title}의 핵심은 다음과 같습니다. {summary}"),
    ("{title}을 요약해 주세요.", "{summary} ({title}, {topic})"),
)
TOPICS = ("계약", "보고서", "설명서", "회의록", "정책")


def lookup(mapping: dict[str, str], key: Column) -> Column:
    """A small fixed table as an expression."""
    return F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))[key]


def category_label(value: Column) -> Column:
    return F.coalesce(lookup(CATEGORIES, value), value)


def build_prompts(docs: DataFrame) -> DataFrame:
    """docs(id, current_name, current_path, extension, text, examples, category) with prompt and slim_prompt.

    examples is an array of structs with file_name and category, null or empty for none; category may be null.
    """
    text = cut(F.col("text"), SAMPLE)
    some = F.coalesce(F.size("examples"), F.lit(0)) > 0
    lines = F.array_join(F.transform("examples", lambda e: F.concat(F.lit("\n  - "), e["file_name"], F.lit("  ->  "), e["category"], F.lit(" 폴더"))), "")
    shown = F.when(some, F.concat(F.lit("\n\n참고: 비슷한 문서들은 다음 표기 관례로 정리됐습니다. 현재 문서 본문에 없는 과목·주제를 복사하지 마십시오."), lines)).otherwise("")
    hint = F.coalesce(F.concat(F.lit("\n\n참고: 이 문서의 분류는 '"), F.col("category"), F.lit("'로 확정되어 있다. recommended_folder는 "), F.col("category"), F.lit("/ 아래로 잡으십시오.")), F.lit(""))
    full = F.concat(
        F.lit("현재 파일명: "), F.col("current_name"), F.lit("\n현재 위치: "), F.col("current_path"), F.lit("\n확장자: "), F.col("extension"),
        F.lit(f"\n\n문서 분석 표본 (앞·중간·뒤, 최대 {SAMPLE}자):\n---\n"), text, F.lit("\n---"), shown, F.lit("\n\n이 파일을 분석해 JSON 한 개만 출력하십시오."), hint,
    )
    names = F.array_join(F.transform("examples", lambda e: e["file_name"]), ", ")
    slim = F.concat(F.lit("파일: "), F.col("current_name"), F.lit(" ("), F.col("extension"), F.lit(")\n본문:\n"), text, F.when(some, F.concat(F.lit("\n표기 예시: "), names, F.lit("\n예시의 주제는 복사하지 마십시오."))).otherwise(""))
    return docs.withColumns({"prompt": full, "slim_prompt": slim})


def violations(response: Column) -> Column:
    """All broken rules of a JSON response, as an array of (field, rule) structs.

    The kind of each value is taken from the parsed JSON: a number where text is due is a violation, a text that reads
    as a number is good enough for confidence.
    """
    v = F.try_parse_json(response)

    def rules(v: Column) -> Column:
        kind = lambda f: F.schema_of_variant(F.try_variant_get(v, f"$.{f}", "variant"))
        text = lambda f: F.try_variant_get(v, f"$.{f}", "string")
        keys = F.json_object_keys(response)
        broken = lambda f, rule, when: F.when(when, F.struct(F.lit(f).alias("field"), F.lit(rule).alias("rule")))
        out = [F.when(F.size(F.filter(keys, lambda k: ~k.isin(*FIELDS))) > 0, F.struct(F.array_join(F.array_sort(F.array_distinct(F.filter(keys, lambda k: ~k.isin(*FIELDS)))), ",").alias("field"), F.lit("extra").alias("rule")))]
        for f in FIELDS:
            missing = ~F.array_contains(keys, f)
            out.append(broken(f, "missing", missing))
            if f != "confidence":
                out.append(broken(f, "not_text", ~missing & (F.coalesce(kind(f), F.lit("VOID")) != "STRING")))
        is_text = lambda f: F.coalesce(kind(f) == "STRING", F.lit(False))
        out.append(broken("category", "unknown", is_text("category") & ~text("category").isin(*CATEGORIES)))
        for f, most in (("recommended_folder", 200), ("recommended_filename", 150), ("reason", 200)):
            out.append(broken(f, "empty", is_text(f) & (F.length(text(f)) == 0)))
            out.append(broken(f, "too_long", is_text(f) & (F.length(text(f)) > most)))
        name, folder = text("recommended_filename"), text("recommended_folder")
        filled = is_text("recommended_filename") & F.length(name).between(1, 150)
        illegal, ending = name.rlike(r'[\\/:*?"<>|\x00-\x1f]'), name.rlike(r"[ .]\z")
        out.append(broken("recommended_filename", "illegal_characters", filled & illegal))
        out.append(broken("recommended_filename", "bad_ending", filled & ~illegal & ending))
        out.append(broken("recommended_filename", "no_extension", filled & ~illegal & ~ending & ~F.contains(name, F.lit("."))))
        stem = F.upper(F.regexp_replace(name, r"(?s)\.[^.]*\z", ""))
        out.append(broken("recommended_filename", "reserved", filled & ~illegal & ~ending & F.contains(name, F.lit(".")) & stem.isin(*RESERVED)))
        placed = is_text("recommended_folder") & F.length(folder).between(1, 200)
        absolute = folder.rlike(r"\A[/\\]") | F.contains(folder, F.lit(":"))
        out.append(broken("recommended_folder", "absolute", placed & absolute))
        out.append(broken("recommended_folder", "climbs", placed & ~absolute & F.array_contains(F.split(folder, "/"), "..")))
        number = F.try_variant_get(v, "$.confidence", "double")
        has = F.array_contains(keys, "confidence")
        out.append(broken("confidence", "not_number", has & number.isNull()))
        out.append(broken("confidence", "out_of_range", number.isNotNull() & ~number.between(0.0, 1.0)))
        return F.filter(F.array(*out), lambda x: x.isNotNull())

    not_json = F.array(F.struct(F.lit("").alias("field"), F.lit("not_json").alias("rule")))
    not_object = F.array(F.struct(F.lit("").alias("field"), F.lit("not_object").alias("rule")))
    is_object = F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))
    return F.when(v.isNull(), not_json).when(~is_object, not_object).otherwise(rules(v))


def validate_suggestions(responses: DataFrame, response_col: str = "response") -> DataFrame:
    """responses with violations and valid."""
    return responses.withColumn("violations", violations(F.col(response_col))).withColumn("valid", F.size("violations") == 0)


def violation_text(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat(F.lit("- "), F.when(x["field"] == "", "(전체)").otherwise(x["field"]), F.lit(": "), x["rule"])), "\n")


def retry_prompt(prompt: Column, response: Column, text: Column) -> Column:
    return F.concat(
        prompt, F.lit("\n\n[재시도] 방금 출력한 JSON이 아래 규칙을 위반해 거부되었습니다.\n이전 출력:\n"), response,
        F.lit("\n\n위반 내역:\n"), text, F.lit("\n\n위반된 항목을 모두 고쳐, 같은 파일에 대한 JSON 객체 하나만 다시 출력하십시오."),
    )


def merge_retry(first: DataFrame, second: DataFrame) -> DataFrame:
    """(id, response, violations, valid) of both attempts to (id, response, status, retried, reason): one retry at most."""
    again = second.select("id", F.col("response").alias("r2"), F.col("valid").alias("v2"), F.col("violations").alias("x2"))
    both = first.join(again, "id", "left")
    rescued = ~F.col("valid") & F.coalesce("v2", F.lit(False))
    reason = short_reason(F.concat(F.lit("llm_invalid_json: "), violation_text(F.coalesce("x2", "violations"))))
    return both.select(
        "id",
        F.when(F.col("valid"), F.col("response")).when(rescued, F.col("r2")).alias("response"),
        F.when(F.col("valid") | rescued, "success").otherwise("failed").alias("status"),
        (~F.col("valid") & F.col("v2").isNotNull()).alias("retried"),
        F.when(F.col("valid") | rescued, "").otherwise(reason).alias("reason"),
    )


def retry_stats(merged: DataFrame) -> DataFrame:
    retried, saved = F.count_if("retried"), F.count_if(F.col("retried") & (F.col("status") == "success"))
    return merged.agg(F.count("*").alias("n"), retried.alias("retried"), saved.alias("rescued"), F.when(retried > 0, saved / retried).alias("rescue_rate"), (F.count_if(F.col("status") == "success") / F.count("*")).alias("valid_rate"))


def supported_component(value: Column, evidence: Column) -> Column:
    """The cleaned value if each of its telling words stands in the flat evidence, else empty."""

    def judged(cleaned: Column, flat: Column) -> Column:
        words = F.filter(F.split(cleaned, "_"), lambda x: (F.length(x) >= 2) & ~x.isin(*WEAK_WORDS))
        return F.when((F.size(words) > 0) & F.forall(words, lambda x: F.contains(flat, flat_evidence(x))), cleaned).otherwise("")

    return let(evidence, lambda flat: let(clean_component(value), lambda cleaned: judged(cleaned, flat)))


def _name_parts(examples: Column) -> Column:
    return F.flatten(F.transform(examples, lambda e: F.split(e["file_name"], r"(?U)[_\s.()\-]+")))


def preferred_spelling(value: Column, examples: Column) -> Column:
    """As the examples spell it: the same word in their case, else another word of its group."""

    def spelled(value: Column, parts: Column) -> Column:
        same = F.get(F.filter(parts, lambda x: F.lower(x) == F.lower(value)), F.lit(0))

        def other_spelling(group: tuple[str, ...]) -> Column:
            words = [t.lower() for t in group]
            return F.when(F.lower(value).isin(*words), F.get(F.filter(parts, lambda x: F.lower(x).isin(*words)), F.lit(0)))

        by_group = [other_spelling(g) for g in TERM_GROUPS]
        return F.when(value == "", value).otherwise(F.coalesce(same, *by_group, value))

    parts = _name_parts(F.coalesce(examples, F.array().cast("array<struct<file_name:string,category:string>>")))
    return let(value, lambda v: let(parts, lambda p: spelled(v, p)))


def preferred_separator(examples: Column) -> Column:
    """"-" if the examples' names hold more hyphens than underscores, else "_"."""
    count = lambda c, x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))
    total = lambda f: F.aggregate(F.coalesce(examples, F.array().cast("array<struct<file_name:string,category:string>>")), F.lit(0), lambda s, e: s + f(e["file_name"]))
    hyphens = total(lambda n: count(F.regexp_replace(n, r"(?s)\.[^.]*\z", ""), "-"))
    return F.when(hyphens > total(lambda n: count(n, "_")), "-").otherwise("_")


def split_known_subject(value: Column, evidence: Column) -> Column:
    """(subject, topic): a known term and what follows it, if the evidence supports that; else the value and nothing."""

    def split(cleaned: Column, flat: Column) -> Column:
        cases = []
        for term in (t for g in TERM_GROUPS for t in g):
            topic = F.substring(cleaned, F.lit(len(term) + 2), F.length(cleaned))
            cases.append(F.when(F.startswith(F.lower(cleaned), F.lit(term.lower() + "_")) & (supported_component(topic, flat) != ""), F.struct(F.lit(term).alias("subject"), topic.alias("topic"))))
        return F.coalesce(*cases, F.struct(cleaned.alias("subject"), F.lit("").alias("topic")))

    return let(evidence, lambda flat: let(clean_component(value), lambda cleaned: split(cleaned, flat)))


def finish_filename(stem: Column, extension: Column) -> Column:
    """Keep clear of reserved names and of 150 characters with the extension; no stem gives no name."""
    ext = F.regexp_replace(F.lower(extension), r"^\.+", "")
    safe = F.when(F.upper(stem).isin(*RESERVED), F.concat(F.lit("문서_"), stem)).otherwise(stem)
    fitted = F.regexp_replace(F.substring(safe, F.lit(1), F.greatest(F.lit(1), F.lit(149) - F.length(ext))), r"[ ._]+\z", "")
    return F.when(stem == "", "").otherwise(F.concat(fitted, F.lit("."), ext))


def build_filename(rows: DataFrame, out: str = "filename") -> DataFrame:
    """rows(subject, topic, document_type, semester, extension, category, evidence, examples, legacy) with a name.

    If none of the four parts is given (all null), the legacy name gets the right extension instead.  Without evidence parts
    are only cleaned; with it, subject and topic must stand there and the semester is read from it.
    """
    ev = F.coalesce("evidence", F.lit(""))
    has = ev != ""
    ext = F.regexp_replace(F.lower("extension"), r"^\.+", "")
    kind = F.coalesce(lookup(DOCUMENT_TYPES, F.col("category")), clean_component(F.col("document_type")))
    semester = F.when(has, document_semester(ev)).otherwise(clean_component(F.col("semester")))

    # each step is computed once a row: written out as one expression they would read the evidence hundreds of times
    def found(flat: Column) -> Column:
        own = F.when(has, split_known_subject(F.col("subject"), flat)).otherwise(F.struct(clean_component(F.col("subject")).alias("subject"), F.lit("").alias("topic")))
        return let(own, lambda known: placed(flat, known))

    def placed(flat: Column, known: Column) -> Column:
        subject = F.when(has, supported_component(known["subject"], flat)).otherwise(known["subject"])
        topic = F.when(has, supported_component(F.col("topic"), flat)).otherwise(clean_component(F.col("topic")))
        topic = let(topic, lambda t: F.when(has & (t == ""), known["topic"]).otherwise(t))
        return F.filter(F.array(preferred_spelling(subject, F.col("examples")), preferred_spelling(topic, F.col("examples")), kind, semester), lambda x: x != "")

    parts = let(F.when(has, flat_evidence(ev)).otherwise(""), found)
    joined = let(preferred_separator(F.col("examples")), lambda sep: F.aggregate(parts, F.lit(""), lambda s, x: F.when(s == "", x).otherwise(F.concat(s, sep, x))))
    legacy = F.coalesce("legacy", F.lit(""))
    old = F.when(F.endswith(F.lower(legacy), F.concat(F.lit("."), ext)), legacy).otherwise(finish_filename(F.regexp_replace(legacy, r"(?s)\.[^.]*\z", ""), F.col("extension")))
    any_part = F.coalesce("subject", "topic", "document_type", "semester").isNotNull()
    return rows.withColumn(out, F.when(any_part, let(joined, lambda stem: finish_filename(stem, F.col("extension")))).otherwise(old))


def percent(x: Column) -> Column:
    return F.concat(F.bround(x * 100, 0).cast("int").cast("string"), F.lit("%"))


def override_category(rows: DataFrame) -> DataFrame:
    """rows(category, recommended_folder, reason, confidence, own_category, own_confidence, method): the classifier wins.

    The first folder is replaced and the rest kept, but for etc; a note goes to the reason, within 200 characters.
    """
    differs = F.col("category") != F.col("own_category")
    parts = F.split("recommended_folder", "/")
    rest = F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), "/")
    folder = F.when((F.col("own_category") == "etc") | (rest == ""), F.col("own_category")).otherwise(F.concat_ws("/", "own_category", rest))
    note = F.concat(F.lit(" (분류: "), F.coalesce(lookup(METHOD_LABELS, F.col("method")), F.col("method")), F.lit(" "), percent(F.col("own_confidence")), F.lit(")"))
    return rows.withColumns({
        "recommended_folder": F.when(differs, folder).otherwise(F.col("recommended_folder")),
        "reason": F.when(differs, F.concat(F.substring("reason", F.lit(1), F.lit(200) - F.length(note)), note)).otherwise(F.col("reason")),
        "confidence": F.when(differs, F.greatest(F.lit(0.0), F.least(F.lit(1.0), "own_confidence"))).otherwise(F.col("confidence")),
        "category": F.coalesce("own_category", "category"),
    })


def assemble_slim(rows: DataFrame, model: str = "소형 LLM") -> DataFrame:
    """rows(id, filename, category, confidence, method) to a whole suggestion: the folder is the category."""
    reason = F.concat(F.coalesce(lookup(METHOD_LABELS, F.col("method")), F.col("method")), F.lit(" 분류 (신뢰도 "), percent(F.col("confidence")), F.lit(f"), 파일명은 {model} 생성 (slim 모드)"))
    return rows.select("id", F.struct("category", F.col("category").alias("recommended_folder"), F.col("filename").alias("recommended_filename"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), "confidence")).alias("confidence"), reason.alias("reason")).alias("suggestion"))


def organize_page(rows: DataFrame, offset: int = 0, most: int = 50) -> DataFrame:
    """rows(path, error, normalized_text) of one page in path order, with status and the total of all pages."""
    total = rows.agg(F.count("*").alias("total"))
    page = rows.orderBy("path").offset(offset).limit(most)
    failed = (F.coalesce("error", F.lit("")) != "") | (F.length(F.trim(F.coalesce("normalized_text", F.lit("")))) == 0)
    return page.withColumn("status", F.when(failed, "failed").otherwise("success")).join(F.broadcast(total))


def rule_category(rows: DataFrame) -> DataFrame:
    """rows(document_type, work_mode) with category, and known: whether the pair has a rule."""
    table = {f"{a}\x1f{b}": c for (a, b), c in CATEGORY_RULES.items()}
    found = lookup(table, F.concat_ws("\x1f", "document_type", "work_mode"))
    return rows.withColumn("category", found).withColumn("known", found.isNotNull())


def ideal_filename(course: Column, title: Column, kind: Column, semester: Column, extension: Column) -> Column:
    return F.concat(sanitize(F.concat_ws("_", course, title, kind, semester)), extension)


def ideal_path(category: Column, course: Column, semester: Column, name: Column) -> Column:
    return F.concat_ws("/", category, sanitize(course), semester, name)


def qa_pairs(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, question, context, answer): template and topic are drawn by the first eight digits of the md5 of "id:1" and "id:2"."""
    drawn = lambda seed, n: (F.conv(F.substring(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("long") % n + 1).cast("int")
    pick = lambda values, seed: F.element_at(F.array(*map(F.lit, values)), drawn(seed, len(values)))
    at = drawn(1, len(QUESTION_TEMPLATES))
    title = F.concat(F.lit("문서"), F.col(id_col).cast("string"))
    summary = F.when(F.length(F.col(text_col)) > 0, F.concat(F.substring(F.get(F.split(F.regexp_replace(F.col(text_col), rf"\A{S}+", ""), "\n"), F.lit(0)), 1, 120), F.lit("..."))).otherwise("요약 없음")
    fill = lambda c: reduce(lambda c, kv: F.replace(c, F.lit("{" + kv[0] + "}"), kv[1]), (("title", title), ("topic", pick(TOPICS, 2)), ("summary", summary)), c)
    template = lambda k: F.element_at(F.array(*(F.lit(t[k]) for t in QUESTION_TEMPLATES)), at)
    return docs.select(F.col(id_col), fill(template(0)).alias("question"), F.substring(F.col(text_col), 1, 2000).alias("context"), fill(template(1)).alias("answer"))


def harmonise_fields(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two record layouts, (id, old, next, to, score 0 to 100) and (id, current, recommended, target, score 0 to 1), as one."""
    both = old.unionByName(new, allowMissingColumns=True)
    score = F.when(F.col("score") > 1, F.col("score") / 100).otherwise(F.col("score"))
    return both.select("id", F.coalesce("old", "current", F.lit("이름 없음")).alias("current_name"), F.coalesce("next", "recommended", F.lit("추천 이름 없음")).alias("recommended_name"), F.coalesce("to", "target", F.lit("추천 폴더")).alias("target_folder"), score.alias("confidence"))



"""Hybrid retrieval: many queries against many documents in one plan.

Documents: id, path, name, body and optionally modified_at, mtime_us, embed_model.  Queries: query_id, query and, from
parse_queries, tokens and half_life.  The queries are the small side: their number is checked before they are broadcast.
A word matches if it is a substring of the squashed name or of the lower-cased body.  Matches come from one pass over the texts or, for
few words, from the tables of a word index that is kept beside the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.text import SEPARATORS, S, is_under, let, squash, stem, strip
from docloom.lexicon import BODY_WEIGHT, COMBINED_CUT, EXTENSIONS, HALF_LIFE, NAME_THRESHOLD, RELATIVE_CUT, VECTOR_FLOOR, WEIGHTS, WEIGHTS_WITH_TIME
from docloom.operators.nearest import clamped, nearest
from docloom.operators.postings import WordIndex, parts_of, scanned
from docloom.session import bounded, checked, settle

def lexical_matches(queries: DataFrame, docs: DataFrame, index: WordIndex | None = None) -> DataFrame:
    """(token, id, in_name) for every distinct query word and every document that holds it.

    An index answers without the texts, which is for few words.  Without one all words are looked for in one pass over docs(id, name, body).
    """
    tokens = queries.select(F.explode("tokens").alias("token"))
    return scanned(tokens, docs) if index is None else index.matches(tokens)


def token_idf(matches: DataFrame, docs: DataFrame) -> DataFrame:
    """(token, weight): ln((N + 1) / (df + 1)) + 1 over all documents."""
    total = docs.agg(F.count("*").alias("n"))
    return matches.groupBy("token").agg(F.count("*").alias("df")).join(F.broadcast(total)).select("token", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1.0).alias("weight"))


def name_parts(name: Column) -> tuple[Column, Column]:
    """What a name is compared by: its squashed stem, and the stem's words of two letters and more."""
    words = F.filter(F.split(F.lower(F.regexp_replace(stem(name), SEPARATORS, " ")), rf"{S}+"), lambda x: F.length(x) >= 2)
    return squash(stem(name)), words


def name_share(flat_stem: Column, words: Column, flat_query: Column) -> Column:
    """1 if the squashed stem stands in the squashed query, else the share of its words that do."""
    share = F.when(F.size(words) == 0, 0.0).otherwise(F.size(F.filter(words, lambda x: F.contains(flat_query, x))) / F.size(words))
    return F.when((flat_stem == "") | (flat_query == ""), 0.0).when(F.contains(flat_query, flat_stem), 1.0).otherwise(share)


def name_score(name: Column, query: Column) -> Column:
    return name_share(*name_parts(name), squash(query))


def keyword_scores(queries: DataFrame, docs: DataFrame, matches: DataFrame | None = None, index: WordIndex | None = None) -> DataFrame:
    """(query_id, id, keyword): weighted share of the query's words in the name (1) or only in the body (0.7).

    A name that the query spells out in part raises it to that part, from one half on.  Only scores over 0.
    """
    queries, parts = settle(queries.select("query_id", "query", "tokens")), parts_of(docs)
    matches = lexical_matches(queries, docs, index) if matches is None else matches
    # a word that no document holds still counts in the sum; there are at most MOST_WORDS different ones
    words = queries.select("query_id", F.explode("tokens").alias("token"))
    numbers = settle(words.select("token").distinct().select("token", F.row_number().over(Window.orderBy("token")).alias("n")))
    # what a document holds is kept as one row of numbers, odd ones for words in the name
    code = (F.col("n") * 2 + F.col("in_name").cast("int")).alias("code")
    held = settle(matches.join(F.broadcast(numbers), "token").select("id", code).groupBy("id").agg(F.collect_list("code").alias("codes")))
    df = held.select(F.explode("codes").alias("code")).groupBy(F.shiftright("code", 1).alias("n")).agg(F.count("*").alias("df"))
    weights = numbers.join(df.hint("merge"), "n", "left").select("n", "token", (F.log((F.lit(docs.count()) + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1.0).alias("weight"))
    # each query's words and weights in one row, then the queries of each word in one row, so that a match meets one row;
    # documents are dealt by id once, and all their pairs with queries are formed and summed there
    weighed = words.join(F.broadcast(settle(weights)), "token").groupBy("query_id").agg(F.collect_list(F.struct("n", "weight")).alias("t"), F.sum("weight").alias("weight_sum"))
    asked = weighed.select("query_id", "weight_sum", F.explode("t").alias("t")).groupBy("t.n").agg(F.collect_list(F.struct("query_id", (F.col("t.weight") / F.col("weight_sum")).alias("w"))).alias("asked"))
    met = held.repartition(parts, "id").select("id", F.explode_outer("codes").alias("code")).select("id", F.shiftright("code", 1).alias("n"), F.when(F.col("code") % 2 == 1, 1.0).otherwise(BODY_WEIGHT).alias("by"))
    met = met.join(F.broadcast(settle(asked)), "n").select("id", "by", F.explode_outer("asked").alias("a")).select("a.query_id", "id", (F.col("a.w") * F.col("by")).alias("part"), F.lit(None).cast("double").alias("pasted"))
    pasted = named(queries, docs).where(F.col("part") >= NAME_THRESHOLD).repartition(parts, "id").select("query_id", "id", F.lit(None).cast("double").alias("part"), F.col("part").alias("pasted"))
    scored = met.unionByName(pasted).groupBy("query_id", "id").agg(F.least(F.lit(1.0), F.greatest(F.sum("part"), F.max("pasted"))).alias("keyword"))
    return scored.where("keyword > 0")


def named(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, id, part) where the query spells out some of the name.

    A name's different words and stems meet the queries by their first letters, and what matches goes back to the names.
    """
    flat_stem, words = name_parts(F.col("name"))
    names = docs.select("id", flat_stem.alias("flat_stem"), words.alias("words")).where("flat_stem <> ''")
    names = names.repartition(parts_of(docs), "id")
    pieces = names.select("id", F.size("words").alias("of"), F.explode(F.concat(F.transform("words", lambda w: F.struct(w.alias("piece"), F.lit(False).alias("whole"))), F.array(F.struct(F.col("flat_stem").alias("piece"), F.lit(True).alias("whole"))))).alias("p")).select("id", "of", "p.*")
    flat = queries.select("query_id", squash(F.col("query")).alias("flat_query")).where("flat_query <> ''")
    places = F.sequence(F.lit(1), F.length("flat_query"))
    grams = F.array_distinct(F.flatten(F.transform(places, lambda i: F.transform(F.array(*map(F.lit, (1, 2, 3))), lambda n: F.substring(F.col("flat_query"), i, n)))))
    asked = flat.select("query_id", "flat_query", F.explode(grams).alias("gram"))
    different = pieces.select("piece").distinct().withColumn("gram", F.substring("piece", 1, 3))
    hits = settle(different.join(asked.hint("shuffle_hash"), "gram").where(F.contains("flat_query", F.col("piece"))).select("query_id", "piece"))
    few = hits.limit(MOST_TOP + 1).count() <= MOST_TOP
    found = pieces.join(F.broadcast(hits) if few else hits.hint("merge"), "piece")
    share = F.greatest(F.max(F.when(F.col("whole"), 1.0).otherwise(0.0)), F.count_if(~F.col("whole")) / F.greatest(F.max("of"), F.lit(1)))
    return found.groupBy("query_id", "id").agg(share.alias("part")).where("part > 0")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_topn(query_vectors: DataFrame, doc_vectors: DataFrame, n: int = 50) -> DataFrame:
    """(query_id, id, vector, place): exact nearest by cosine, n a query; vector is clamped to 0 to 1.

    Vectors are unit rows: query_vectors(query_id, qv), doc_vectors(id, v).
    """
    found = nearest(query_vectors.select(F.col("query_id").alias("id"), F.col("qv").alias("v")), doc_vectors.select(F.col("id").alias("eid"), F.col("v").alias("ev")), n)
    return found.select(F.col("id").alias("query_id"), F.col("eid").alias("id"), clamped(F.col("sim")).alias("vector"), "place")


def neighbours_wanted(top_k: Column) -> Column:
    return F.least(F.greatest(top_k * 5, F.lit(50)), F.lit(200))


def recency(modified: Column, now: Column, half_life: Column) -> Column:
    """1 / (1 + age in days / half-life); the future counts as now, an unknown time as 0."""
    age = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(modified)) / 86_400_000_000.0)
    return F.coalesce(1.0 / (1.0 + age / half_life), F.lit(0.0))


def combine(vector: Column, keyword: Column, fresh: Column, timed: Column, pasted: Column) -> Column:
    w, t = WEIGHTS, WEIGHTS_WITH_TIME
    usual = w[0] * vector + w[1] * keyword + w[2] * fresh
    return F.when(pasted >= 1.0, 1.0).when(timed, t[0] * vector + t[1] * keyword + t[2] * fresh).otherwise(usual)


def excerpt(body: Column, tokens: Column, name: Column, n: int = 500) -> Column:
    """n characters from 60 before the first of the words, in their order, that occurs; the name if there is no text."""

    def found(text: Column) -> Column:
        places = let(F.lower(text), lambda low: F.filter(F.transform(tokens, lambda t: F.position(t, low)), lambda p: p > 0))
        start = F.greatest(F.lit(1), F.coalesce(F.get(places, F.lit(0)), F.lit(1)) - 60)
        return strip(F.substring(text, start, F.lit(n)))

    return let(let(strip(body), found), lambda x: F.when(F.coalesce(x, F.lit("")) == "", name).otherwise(x))


def candidates(keyword: DataFrame, vector: DataFrame, parts: int | None = None) -> DataFrame:
    """(query_id, id, keyword, vector, best_vector): found by either side; the other side counts 0.

    vector holds a few rows a query.  If keyword is dealt by id to that many parts, vector's rows go to them and keyword's stay.
    """
    vector = settle(vector.select("query_id", "id", "vector"))
    best = vector.groupBy("query_id").agg(F.max("vector").alias("best_vector"))
    v = (vector.repartition(parts, "id") if parts else vector).select("query_id", "id", F.lit(None).cast("double").alias("keyword"), "vector")
    both = keyword.select("query_id", "id", "keyword", F.lit(None).cast("double").alias("vector")).unionByName(v)
    both = both.groupBy("query_id", "id").agg(F.max("keyword").alias("keyword"), F.max("vector").alias("vector")).join(F.broadcast(best), "query_id", "left")
    return both.select("query_id", "id", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("keyword", "vector", "best_vector")))


def first_gate(rows: DataFrame) -> DataFrame:
    """Without a key word a document must be near enough, both as such and beside the best."""
    return rows.where((F.col("keyword") > 0) | ((F.col("vector") >= VECTOR_FLOOR) & (F.col("vector") >= F.col("best_vector") * RELATIVE_CUT)))


def second_gate(rows: DataFrame) -> DataFrame:
    """If key words back some rows, others need a good part of the best such row's score."""
    best = F.max(F.when(F.col("keyword") > 0, F.col("score"))).over(Window.partitionBy("query_id"))
    return rows.withColumn("__best", best).where(F.col("__best").isNull() | (F.col("keyword") > 0) | (F.col("score") >= F.col("__best") * COMBINED_CUT)).drop("__best")


def in_scope(rows: DataFrame, root: str = "") -> DataFrame:
    kind = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    rows = rows.where(kind.isin(*EXTENSIONS))
    return rows.where(is_under(F.col("path"), F.lit(root))) if root else rows


def hybrid_search(queries: DataFrame, docs: DataFrame, now: Column, query_vectors: DataFrame | None = None, doc_vectors: DataFrame | None = None, root: str = "", top_k: int = 20, index: WordIndex | None = None) -> DataFrame:
    """(query_id, rank, id, path, score, matched_text): ranks from 1, best first, ties by path.  Scores are told apart to 9 digits.

    Without vectors key words alone answer.  Texts are left behind until the last rows are known.  Documents whose kind
    or folder is out of scope take no place but count in word weights.
    """
    spark, queries = docs.sparkSession, settle(bounded(queries.select("query_id", "query", "tokens", "half_life")))
    keyword = keyword_scores(queries, docs, index=index)
    wanted = 0 if query_vectors is None or doc_vectors is None else min(max(top_k * 5, 50), 200)
    if not wanted:
        vector = spark.createDataFrame([], "query_id long, id long, vector double")
    else:
        vector = vector_topn(query_vectors, doc_vectors, wanted).select("query_id", "id", "vector")
    rows = first_gate(candidates(keyword, vector, parts_of(docs)))
    flat_stem, words = name_parts(F.col("name"))
    slim = in_scope(docs.drop("body"), root).withColumns({"flat_stem": flat_stem, "words": words})
    rows = rows.join(slim.hint("shuffle_hash"), "id").join(F.broadcast(queries.select("query_id", squash(F.col("query")).alias("flat_query"), "half_life")), "query_id")
    modified = F.coalesce(F.col("modified_at"), F.timestamp_micros("mtime_us")) if "mtime_us" in docs.columns else F.col("modified_at")
    fresh = recency(modified, now, F.coalesce("half_life", F.lit(HALF_LIFE)))
    # a name that the query spells out has raised the key word score
    pasted = F.when(F.col("keyword") >= NAME_THRESHOLD / 2, name_share(F.col("flat_stem"), F.col("words"), F.col("flat_query"))).otherwise(0.0)
    rows = rows.withColumn("score", combine(F.col("vector"), F.col("keyword"), fresh, F.col("half_life").isNotNull(), pasted))
    told = F.round("score", 9)  # sums of the same parts in another order differ in their last digits
    # at most wanted rows of a query have no key word and may fall at the second gate; so the first top_k + wanted paths are enough, and
    # they are among as many times the most rows that share a path: these are told in each task, before rows are dealt by query
    most = (top_k + wanted) * (slim.groupBy("path").count().agg(F.max("count")).first()[0] or 1)
    if most <= MOST_RANKED:
        rows = rows.withColumn("__r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(told), "path", "id"))).where(F.col("__r") <= most).drop("__r")
    best = Window.partitionBy("query_id", "path").orderBy(F.desc(told), "id")
    rows = second_gate(rows.withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__r"))
    place = Window.partitionBy("query_id").orderBy(F.desc(told), "path")
    top = rows.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top_k)
    top = top.select("query_id", "rank", "id", "path", "name", F.least(F.lit(1.0), "score").alias("score"))
    with_text = beside_texts(top, docs.select("id", "body"), queries.count() * top_k).join(F.broadcast(queries.select("query_id", "tokens")), "query_id")
    return with_text.select("query_id", "rank", "id", "path", "score", excerpt(F.col("body"), F.col("tokens"), F.col("name")).alias("matched_text"))


#: Result rows that go to the texts by broadcast at most; beyond that texts and rows meet by a shuffle of both.
MOST_TOP = 200_000
#: First rows of a group that Spark tells in each task before it shuffles (spark.sql.optimizer.windowGroupLimitThreshold).
MOST_RANKED = 1000


def beside_texts(top: DataFrame, texts: DataFrame, most: int) -> DataFrame:
    """top, which has at most that many rows, with the texts of its ids; no text is shuffled for a few rows."""
    return texts.join(F.broadcast(top) if most <= MOST_TOP else top.hint("merge"), "id")


def keyword_topk(queries: DataFrame, docs: DataFrame, top_k: int = 20, index: WordIndex | None = None) -> DataFrame:
    """(query_id, rank, id, keyword, matched_text): the key word side alone."""
    queries = settle(bounded(queries.select("query_id", "query", "tokens")))
    scores = keyword_scores(queries, docs, index=index)
    place = Window.partitionBy("query_id").orderBy(F.desc(F.round("keyword", 9)), "id")
    top = scores.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top_k)
    out = beside_texts(top, docs.select("id", "name", "body"), queries.count() * top_k).join(F.broadcast(queries.select("query_id", "tokens")), "query_id")
    return out.select("query_id", "rank", "id", "keyword", excerpt(F.col("body"), F.col("tokens"), F.col("name")).alias("matched_text"))


def query_instruction(cleaned: Column, query: Column, instruction: str = "Instruct: find documents that answer the query\nQuery: ") -> Column:
    """What an asymmetric embedder gets for a query; documents get none."""
    return F.concat(F.lit(instruction), F.when(cleaned == "", query).otherwise(cleaned))

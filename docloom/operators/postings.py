"""An inverted index for substring search: written tables, kept up to date, from which word matches follow without the texts.

A query word holds neither white space nor separators, so it occurs in a text just where it occurs in one of the text's words.
Hence two tables:

* words(gram, word): the different words of all texts by their runs of three letters, and runs(gram, words): how many there
  are of each.  A query word meets the words that hold its rarest run and is looked for in them;
* postings(bucket, word, id, in_name): which document has which word, in its name (squashed, as one word) or in its text.

Both are cut into segments.  An update writes one more segment with the documents of its work list; what older segments say
of those documents, or of removed ones, does not count any more.  compact() writes what counts into a single segment.  A manifest
names the segments that count; it is written last, so a reader sees an update as a whole or not at all.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.text import SEPARATORS, squash
from docloom.session import bounded, settle

#: Words that query words occur in, broadcast at most, and folders that postings are cut into.
MOST_MET, BUCKETS = 200_000, 16
#: For one pass over texts: letters of a run, documents a part, and common words whose tokens are told once, at most.
RUN, A_PART, MOST_COMMON = 4, 1024, 50_000
PAD = "\x00"
BETWEEN = rf"(?U)[\s{SEPARATORS[1:]}+"
#: Texts may be cut at any letters that no token holds; plain white space is told faster.
CUTS = BETWEEN.removeprefix("(?U)")


def runs(word: Column) -> Column:
    """Different runs of three letters of a word that is padded at its end, so that each shorter run begins one of them."""
    padded = F.concat(word, F.lit(PAD * 2))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(word)), lambda at: F.substring(padded, at, F.lit(3))))


def whole_runs(token: Column, n: int = 3) -> Column:
    """Different runs of n letters of a token; a shorter token itself."""
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.length(token) - (n - 1), F.lit(1))), lambda at: F.substring(token, at, F.lit(n)))
    return F.array_distinct(every)


def bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def words_of(docs: DataFrame) -> DataFrame:
    """docs(id, name, body) to (word, id, in_name): once for each document and word."""
    parts = F.array_remove(F.array_distinct(F.split(F.lower(F.coalesce("body", F.lit(""))), BETWEEN)), "")
    name = F.filter(F.array(squash(F.col("name"))), lambda x: x != "")
    pairs = F.concat(F.transform(name, lambda x: F.struct(x.alias("word"), F.lit(True).alias("in_name"))), F.transform(parts, lambda x: F.struct(x.alias("word"), F.lit(False).alias("in_name"))))
    return docs.select("id", F.explode(pairs).alias("p")).select("p.word", "id", "p.in_name")


def parts_of(docs: DataFrame) -> int:
    """Parts that documents are dealt to by id, so that what a part's documents hold, and their pairs with queries, stay in one task."""
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // A_PART))


def scanned(tokens: DataFrame, docs: DataFrame, tried: int = 1000) -> DataFrame:
    """(token, id, in_name) for every token and every document that holds it, by one pass over docs(id, name, body) without an index.

    This is for many tokens at once, which most words of the texts meet: then an index saves nothing.  A word is looked at for a token only
    if it has the token's rarest run of four letters (or the token itself, if that is shorter); for common words that is done once.  Which
    runs are rare and which words common is told by the first tried documents; that decides what is looked at, not what is found.  Documents are dealt by id, so what they hold is put together where they
    are, and all steps over words and runs are compiled ones.  tokens(token) must hold neither white space nor separators, and are the
    small side, counted first.
    """
    tokens = bounded(settle(tokens.select("token").where("token <> ''").distinct()))
    sizes = sorted(r[0] for r in tokens.select(F.least(F.length("token"), F.lit(RUN))).distinct().collect())
    words = F.concat(F.array(squash(F.coalesce("name", F.lit("")))), F.array_distinct(F.split(F.lower(F.coalesce("body", F.lit(""))), CUTS)))
    places = F.sequence(F.lit(1), F.greatest(F.length("word") - (min(sizes, default=1) - 1), F.lit(1)))
    cut = F.array(*(F.substring(F.col("word"), F.col("place"), F.lit(n)) for n in sizes)) if sizes else F.array().cast("array<string>")

    def each(rows: DataFrame) -> DataFrame:
        # outer, here and below, as an inner explode would first be computed for a filter on its size; empty runs meet no token
        return rows.select("id", words.alias("words")).select("id", F.posexplode_outer("words").alias("at", "word")).select("id", (F.col("at") == 0).alias("in_name"), "word")

    seen = settle(each(docs.limit(tried)).groupBy("word").agg(F.count("*").alias("words")))
    grams = seen.select("*", F.explode_outer(places).alias("place")).select("word", "words", F.explode_outer(cut).alias("gram"))
    asked = tokens.select("token", F.explode(whole_runs(F.col("token"), RUN)).alias("gram"))
    frequent = grams.groupBy("gram").agg(F.sum("words").alias("words"))
    rarest = asked.join(frequent.hint("merge"), "gram", "left").groupBy("token").agg(F.min(F.struct(F.coalesce("words", F.lit(0)).alias("words"), F.col("gram"))).alias("m"))
    rarest = settle(rarest.select(F.row_number().over(Window.orderBy("token")).alias("n"), "token", "m.gram"))
    holds = F.contains(F.col("word"), F.col("token"))
    common = seen.where("words > 1").orderBy(F.desc("words"), "word").limit(MOST_COMMON).select("word")
    known = common.join(grams.join(F.broadcast(rarest), "gram").where(holds).select("word", "n").hint("merge"), "word", "left").groupBy("word").agg(F.collect_set("n").alias("ns"))
    # a common word brings its tokens along, any other one is cut into runs
    dealt = each(docs.select("id", "name", "body").repartition(parts_of(docs), "id")).join(F.broadcast(settle(known)), "word", "left")
    dealt = dealt.select("*", F.explode_outer(F.when(F.col("ns").isNull(), places).otherwise(F.array(F.lit(0)))).alias("place"))
    dealt = dealt.select("id", "in_name", "word", "ns", F.explode_outer(F.when(F.col("ns").isNull(), cut).otherwise(F.array(F.lit(None).cast("string")))).alias("gram"))
    met = dealt.join(F.broadcast(rarest), "gram", "left").where(F.col("ns").isNotNull() | holds)
    met = met.select("id", "in_name", F.explode_outer(F.coalesce("ns", F.array("n"))).alias("n")).where("n is not null")
    return met.groupBy("n", "id").agg(F.max("in_name").alias("in_name")).join(F.broadcast(rarest.select("n", "token")), "n").select("token", "id", "in_name")


class WordIndex:
    """The index below a folder that all executors see."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def segments(self) -> list[int]:
        """Numbers of the segments that count, oldest first."""
        rows = self.spark.read.schema("v int, segment int").parquet(f"{self.root}/manifest")
        newest = rows.agg(F.max("v")).first()[0]
        return sorted(r["segment"] for r in rows.where(F.col("v") == newest).select("segment").collect())

    def _commit(self, v: int, segments: list[int]) -> None:
        self.spark.createDataFrame([(s,) for s in segments], "segment int").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/v={v}")

    def _write(self, number: int, postings: DataFrame, ids: DataFrame) -> None:
        """Postings by bucket and word, the different words by run of letters, and the documents that the segment speaks of."""
        at = f"segment={number}"
        # a word of every text fills several tasks, as a bucket's rows are dealt by document too; inside a file words stand together
        slices = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // BUCKETS)
        dealt = postings.withColumn("bucket", bucket(F.col("word"))).repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(slices))).sortWithinPartitions("bucket", "word", "id")
        dealt.write.partitionBy("bucket").mode("overwrite").parquet(f"{self.root}/postings/{at}")
        written = self.spark.read.schema("word string, bucket int").parquet(f"{self.root}/postings/{at}")
        written.select("word").distinct().select(F.explode(runs(F.col("word"))).alias("gram"), "word").write.mode("overwrite").parquet(f"{self.root}/words/{at}")
        pairs = self.spark.read.schema("gram string, word string").parquet(f"{self.root}/words/{at}")
        pairs.groupBy("gram").agg(F.count("*").alias("words")).write.mode("overwrite").parquet(f"{self.root}/runs/{at}")
        ids.write.mode("overwrite").parquet(f"{self.root}/docs/{at}")

    def build(self, docs: DataFrame) -> WordIndex:
        """Index docs(id, name, body[, mtime_us]) afresh."""
        self._write(0, words_of(docs), self._ids(docs, False))
        self._commit(0, [0])
        return self

    def _ids(self, docs: DataFrame, gone: bool) -> DataFrame:
        time = F.col("mtime_us") if "mtime_us" in docs.columns else F.lit(None)
        return docs.select("id", time.cast("long").alias("mtime_us"), F.lit(gone).alias("gone"))

    def stored(self) -> DataFrame:
        """(id, mtime_us) of the documents that the index holds now: what index.work_list compares a catalog with."""
        rows = [self.spark.read.parquet(f"{self.root}/docs/segment={s}").withColumn("segment", F.lit(s)) for s in self.segments()]
        if len(rows) == 1:
            return rows[0].where(~F.col("gone")).select("id", "mtime_us")
        last = functools.reduce(DataFrame.unionByName, rows).groupBy("id").agg(F.max(F.struct("segment", "gone", "mtime_us")).alias("l"))
        return last.where(~F.col("l.gone")).select("id", "l.mtime_us")

    def update(self, docs: DataFrame) -> int:
        """Follow docs(id, name, body, mtime_us), the whole catalog as it is now; the number of documents that were written or removed.

        Only texts of the work list are read: ids that are new or have another time (a null time is a time).  Ids that are no more in the
        catalog are removed.
        """
        held = self.stored().select("id", F.col("mtime_us").alias("held"), F.lit(True).alias("known"))
        both = docs.select("id", "mtime_us", F.lit(True).alias("there")).join(held.hint("merge"), "id", "full_outer")
        news = settle(both.where(F.col("known").isNull() | F.col("there").isNull() | ~F.col("mtime_us").eqNullSafe(F.col("held"))))
        n = news.count()
        if n:
            changed = docs.join(news.where("there").select("id").hint("merge"), "id", "left_semi")
            gone = news.where("there is null").select("id", F.col("held").alias("mtime_us"))
            live = self.segments()
            number = live[-1] + 1
            self._write(number, words_of(changed), self._ids(changed, False).unionByName(self._ids(gone, True)))
            self._commit(number, [*live, number])
        return n

    def compact(self) -> None:
        """Write what counts into one new segment."""
        live = self.segments()
        number = live[-1] + 1
        rows = functools.reduce(DataFrame.unionByName, [self._live(self._postings(s), s, live) for s in live])
        held = settle(self.stored())
        self._write(number, rows.select("word", "id", "in_name"), self._ids(held, False))
        self._commit(number, [number])

    def _postings(self, segment: int) -> DataFrame:
        kind = self.spark.read.parquet(f"{self.root}/docs/segment={segment}").schema["id"].dataType.simpleString()
        return self.spark.read.schema(f"word string, id {kind}, in_name boolean, bucket int").parquet(f"{self.root}/postings/segment={segment}")

    def _live(self, rows: DataFrame, segment: int, segments: list[int]) -> DataFrame:
        """rows of a segment but for documents that later segments speak of."""
        for later in (s for s in segments if s > segment):
            rows = rows.join(self.spark.read.parquet(f"{self.root}/docs/segment={later}").select("id").hint("shuffle_hash"), "id", "left_anti")
        return rows

    def words_with(self, tokens: DataFrame) -> DataFrame:
        """(token, word): every word of the index that holds the token.  tokens(token) are the small side, counted first."""
        live, tokens = self.segments(), bounded(tokens)
        dictionary = self._union("words", "gram string, word string", live)
        asked = tokens.where(F.length("token") >= 3).select("token", F.explode(whole_runs(F.col("token"))).alias("gram"))
        # by its rarest run a token meets fewest words; a run that no word has rules it out
        frequent = self._union("runs", "gram string, words long", live).join(F.broadcast(asked.select("gram").distinct()), "gram", "left_semi").groupBy("gram").agg(F.sum("words").alias("words"))
        rarest = asked.join(frequent.hint("shuffle_hash"), "gram", "left").groupBy("token").agg(F.min(F.struct(F.coalesce("words", F.lit(0)).alias("words"), F.col("gram"))).alias("m")).select("token", "m.gram")
        met = dictionary.join(F.broadcast(rarest), "gram").where(F.contains("word", F.col("token")))
        for n in (1, 2):
            short = tokens.where(F.length("token") == n).select("token", F.col("token").alias("begin"))
            met = met.unionByName(dictionary.withColumn("begin", F.substring("gram", 1, n)).join(F.broadcast(short), "begin").drop("begin"))
        return met.select("token", "word").distinct()

    def _union(self, table: str, schema: str, segments: list[int]) -> DataFrame:
        return functools.reduce(DataFrame.unionByName, [self.spark.read.schema(schema).parquet(f"{self.root}/{table}/segment={s}") for s in segments])

    def matches(self, tokens: DataFrame) -> DataFrame:
        """(token, id, in_name) for every token and every document that holds it, in its name or text; each pair once.

        tokens(token) must hold neither white space nor separators, as parse_queries gives them.  Postings stay where they
        are if the tokens occur in no more than MOST_MET different words; else both sides are shuffled.
        """
        tokens = settle(tokens.select("token").where("token <> ''").distinct())
        met = settle(self.words_with(tokens).withColumn("bucket", bucket(F.col("word"))))
        met = F.broadcast(met) if met.limit(MOST_MET + 1).count() <= MOST_MET else met.hint("merge")
        live = self.segments()
        found = [self._live(self._postings(s).join(met, ["bucket", "word"]).select("token", "id", "in_name"), s, live) for s in live]
        return functools.reduce(DataFrame.unionByName, found).groupBy("token", "id").agg(F.max("in_name").alias("in_name"))

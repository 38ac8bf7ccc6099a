"""A pruned inverted index: top-k by summed term impacts without reading the whole corpus.

Layout (Parquet in the index folder, ``bucket`` = hash of the term as partition column, sorted by term):

* ``rows``   (term, block, top, low, docs, a, b): the postings of a term in one block of documents, and
  their bounds; a block is a hash of the document id, about ``BLOCK_DOCS`` documents
* ``terms``  (term, df, top, low): the same bounds for the whole term

A posting's impact is a function of two numbers, growing in ``a`` and falling in ``b`` (BM25: term frequency
and document length; sparse vectors: the weight alone), so ``top = max(a)`` and ``low = min(b)`` bound a block
whatever the corpus statistics are at search time.

A search takes all questions at once:

1. rare terms of each question give seed documents, whose whole scores give a threshold: the k-th best;
2. terms that together cannot reach the threshold need not be searched; of the others only the block
   bounds are read, and blocks that cannot reach it are skipped;
3. the postings of the question's terms in the blocks left are scored.  They are dealt out by block, so that
   a document's score is summed where its block is: what is shuffled are postings, once for all
   questions, and never the hits of a question, which are many times as many.

Only the asked terms are read in every step: their buckets as partition filter, the terms as pushed filter
or join.  Nothing is dropped that could enter the k best after rounding (``RANK_MARGIN``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.ordering import global_positions
from quarry.functions.sizing import bounded_broadcast
from quarry.operators import lexical as lx
from quarry.session import index_dir, is_complete, mark_complete, materialize

BLOCK_DOCS = 128
BUCKET_POSTINGS, MOST_BUCKETS = 50_000, 4096
#: Terms that go into a filter as literals; more are joined.
LITERALS = 2000
#: Postings of rare terms that a question's seeds come from; seeds for each of the k results.
SEED_POSTINGS, SEEDS = 2000, 2
RANK_MARGIN = 2e-6
BROADCAST_ROWS = 500_000

Impact = Callable[[Column, Column], Column]


@dataclass
class InvertedIndex:
    rows: DataFrame
    terms: DataFrame
    buckets: int

    def of_terms(self, asked: DataFrame, *columns: str) -> DataFrame:
        """The rows of the terms in ``asked`` (column ``term``), read from their buckets only."""
        terms = asked.select(F.col("term").alias("t_term"), bucket_of("term", self.buckets).alias("t_bucket")).distinct()
        few = terms.limit(LITERALS + 1).collect()
        if len(few) <= LITERALS:
            return self.of_listed(few, *columns)
        rows = self.rows.select("bucket", *columns)
        hit = (F.col("bucket") == F.col("t_bucket")) & (F.col("term") == F.col("t_term"))
        return rows.join(bounded_broadcast(terms, BROADCAST_ROWS), hit, "left_semi").drop("bucket")

    def of_listed(self, few: list, *columns: str) -> DataFrame:
        """The same for a few collected (t_term, t_bucket)."""
        return self.rows.select("bucket", *columns).where(
            F.col("bucket").isin(sorted({r["t_bucket"] for r in few})) & F.col("term").isin([r["t_term"] for r in few])).drop("bucket")


def bucket_of(term: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def build_inverted(postings: DataFrame, n_docs: int, path: str) -> InvertedIndex:
    """From (term, doc_id, a, b) rows; ``n_docs`` documents make the number of blocks."""
    spark = postings.sparkSession
    if not is_complete(spark, path):
        blocks = max(-(-n_docs // BLOCK_DOCS), 1)
        block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block")
        n_postings = postings.count()
        buckets = min(max(n_postings // BUCKET_POSTINGS, 1), MOST_BUCKETS)
        # one shuffle: postings are dealt out in the order of the files, and grouped where they arrive
        dealt = postings.select(bucket_of("term", buckets).alias("bucket"), "term", block, "doc_id", "a", "b")
        dealt = dealt.repartitionByRange("bucket", "term", "block")
        # a group holds a block's documents with the term: BLOCK_DOCS or so
        grouped = dealt.groupBy("bucket", "term", "block").agg(
            F.max("a").alias("top"), F.min("b").alias("low"), F.sort_array(F.collect_list(F.struct("doc_id", "a", "b"))).alias("p"))
        grouped = grouped.select("bucket", "term", "block", "top", "low", F.col("p.doc_id").alias("docs"),
                                 F.col("p.a").alias("a"), F.col("p.b").alias("b"))
        (grouped.sortWithinPartitions("bucket", "term", "block")
                .write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows"))
        written = spark.read.schema("term string, top double, low double, docs array<long>, bucket int").parquet(f"{path}/rows") \
            if n_postings else grouped
        (written.groupBy("term").agg(F.sum(F.size("docs").cast("long")).alias("df"), F.max("top").alias("top"),
                                     F.min("low").alias("low"))
                .withColumn("buckets", F.lit(buckets)).write.mode("overwrite").parquet(f"{path}/terms"))
        mark_complete(spark, path)
    schema = ("term string, block long, top double, low double, docs array<long>, a array<double>, b array<double>, "
              "bucket int")
    terms = spark.read.schema("term string, df long, top double, low double, buckets long").parquet(f"{path}/terms")
    first = terms.select("buckets").first()
    if first is None:       # no postings: no bucket was written
        return InvertedIndex(spark.createDataFrame([], schema), terms, 1)
    return InvertedIndex(spark.read.schema(schema).parquet(f"{path}/rows"), terms, int(first[0]))


def bm25_impact(index: lx.BM25Index) -> Impact:
    avgdl = float(index.stats.first()["avgdl"] or 0.0) or 1.0
    k1, b = index.k1, index.b
    return lambda tf, dl: tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.lit(avgdl)))


def weight_impact(a: Column, b: Column) -> Column:
    return a


def _bound(impact: Impact) -> Column:
    """The most that a question's term can add: nothing, where its weight is negative."""
    return F.greatest(F.col("w") * impact(F.col("top"), F.col("low")), F.lit(0.0))


def _small(side: DataFrame, most_rows: int) -> DataFrame:
    """A side of a join whose rows are known to be ``most_rows`` at most."""
    return F.broadcast(side) if most_rows <= BROADCAST_ROWS else side


def threshold(index: InvertedIndex, asked: DataFrame, n_asked: int, impact: Impact, k: int) -> DataFrame:
    """(qid, theta): a score that k documents reach, from seeds; no row where there are fewer."""
    rare = Window.partitionBy("qid").orderBy("df", "term")
    before = F.sum("df").over(rare.rowsBetween(Window.unboundedPreceding, -1))
    first = asked.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") <= SEED_POSTINGS)
    rows = index.of_terms(first, "term", "block", "docs", "a", "b")
    hits = rows.join(_small(first.select("qid", "term", "w"), n_asked), "term").select(
        "qid", "block", "w", F.explode(F.arrays_zip("docs", "a", "b")).alias("p"))
    part = hits.groupBy("qid", "block", F.col("p.docs").alias("doc_id")).agg(
        F.sum(F.col("w") * impact(F.col("p.a"), F.col("p.b"))).alias("part"))
    seeds = lx.rank_within(part, "qid", [F.desc("part"), F.asc("doc_id")], SEEDS * k)
    wanted = seeds.select("qid", "block", "doc_id").join(_small(asked.select("qid", "term", "w"), n_asked), "qid")
    rows = index.of_terms(asked, "term", "block", "docs", "a", "b")
    own = rows.join(_small(wanted, n_asked * SEEDS * k), ["term", "block"]).withColumn(
        "at", F.array_position("docs", F.col("doc_id"))).where("at > 0")
    score = F.sum(F.col("w") * impact(F.element_at("a", F.col("at").cast("int")),
                                      F.element_at("b", F.col("at").cast("int"))))
    whole = own.groupBy("qid", "doc_id").agg(score.alias("score"))
    best = lx.rank_within(whole, "qid", [F.desc("score")], k)
    return best.where(F.col("rk") == k).select("qid", F.col("score").alias("theta"))


def top_scores(index: InvertedIndex, questions: DataFrame, impact: Impact, k: int) -> DataFrame:
    """(qid, doc_id, score) with every document that can be among a question's k best and shares a term with it.

    ``questions``: (qid, term, w), a row for each of a question's terms."""
    asked = materialize(questions.join(index.terms, "term").select(
        "qid", "term", "w", "df", _bound(impact).alias("most")), "inverted-asked")
    n_asked = asked.count()
    theta = threshold(index, asked, n_asked, impact, k)
    # the terms whose bounds, smallest first, add up to less than the threshold
    order = Window.partitionBy("qid").orderBy("most", "term")
    upto = F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    known = asked.join(theta, "qid", "left").withColumn("need", F.col("theta") - RANK_MARGIN)
    known = materialize(known.withColumn("idle", F.coalesce(upto < F.col("need"), F.lit(False))), "inverted-terms")
    rest = known.where("idle").groupBy("qid").agg(F.sum("most").alias("rest"))
    needed = known.where("not idle").select("qid", "term", "w", "need")
    bounds = index.of_terms(needed, "term", "block", "top", "low")
    each = bounds.join(_small(needed, n_asked), "term").groupBy("qid", "block").agg(
        F.sum(_bound(impact)).alias("most"), F.first("need").alias("need"))
    reach = F.col("most") + F.coalesce("rest", F.lit(0.0)) >= F.col("need")
    live = each.join(_small(rest, n_asked), "qid", "left").where(F.col("need").isNull() | reach).select("qid", "block")
    # a row per block: the questions that may have it, at most all of them
    wanted = materialize(live.groupBy("block").agg(F.collect_set("qid").alias("qids")), "inverted-live")
    rows = index.of_terms(asked, "term", "block", "docs", "a", "b").join(wanted.hint("merge"), "block")
    hits = (rows.join(_small(asked.select("qid", "term", "w"), n_asked), "term").where(F.array_contains("qids", F.col("qid")))
            .select("qid", "block", "w", F.explode(F.arrays_zip("docs", "a", "b")).alias("p")))
    return hits.groupBy("qid", "block", F.col("p.docs").alias("doc_id")).agg(
        F.sum(F.col("w") * impact(F.col("p.a"), F.col("p.b"))).alias("score")).drop("block")


def ranked(scores: DataFrame, k: int) -> DataFrame:
    """(qid, rk, doc_id, score): by the score rounded to 6 digits, ties by id."""
    scored = scores.select("qid", "doc_id", F.round("score", 6).alias("score"))
    return lx.rank_within(scored, "qid", [F.desc("score"), F.asc("doc_id")], k).select("qid", "rk", "doc_id", "score")


def stored_bm25_inverted(docs: DataFrame, index: lx.BM25Index | None = None) -> tuple[InvertedIndex, lx.BM25Index]:
    """The pruned index of (doc_id, text), beside its BM25 index; built when there is none for this content."""
    index = index or lx.stored_bm25_index(docs)
    n, fp = lx.corpus_fingerprint(docs)
    path = f"{index_dir(docs.sparkSession)}/inverted/{n}-{fp & (2**64 - 1):016x}-{BLOCK_DOCS}"
    postings = index.postings.select("term", "doc_id", F.col("tf").cast("double").alias("a"),
                                     F.col("dl").cast("double").alias("b"))
    return build_inverted(postings, n, path), index


def bm25_top_k(docs: DataFrame, questions: DataFrame, k: int = 5) -> DataFrame:
    """(qid, rk, doc_id, score): the k best documents of the whole corpus by rounded BM25 score, ties
    by id; documents without a hit score 0 and are ranked too."""
    inverted, index = stored_bm25_inverted(docs.select("doc_id", "text"))
    asked = lx.question_terms(questions).join(index.idf.select("term", "idf"), "term").select(
        "qid", "term", (F.col("qtf") * F.col("idf")).alias("w"))
    hits = materialize(top_scores(inverted, asked, bm25_impact(index), k).select(
        "qid", "doc_id", F.round("score", 6).alias("score")), "inverted-hits")
    # a question without k positive scores has no threshold above 0, so all its hits are known here
    full = hits.where("score > 0").groupBy("qid").count().where(F.col("count") >= k).select("qid")
    short = questions.select("qid").distinct().join(full, "qid", "left_anti")
    if short.first() is None:
        return ranked(hits, k)
    short = materialize(short, "inverted-short")
    # documents without a hit score 0 like those whose hits do: the smallest ids that score nothing else
    other = hits.where("score <> 0").join(short, "qid")
    asks = short.join(other.groupBy("qid").count(), "qid", "left").select(
        "qid", F.explode(F.sequence(F.lit(0), F.coalesce("count", F.lit(0)).cast("int") + k - 1)).alias("pos"))
    numbered = global_positions(docs.select("doc_id"), ["doc_id"])
    zeros = (asks.join(numbered, "pos").join(other.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti")
             .select("qid", "doc_id", F.lit(0.0).alias("score")))
    zeros = lx.rank_within(zeros, "qid", [F.asc("doc_id")], k).select("qid", "doc_id", "score")
    return ranked(hits.where("score <> 0").unionByName(zeros).unionByName(hits.join(short, "qid", "left_anti").where("score = 0")), k)


def sparse_top_k(index: InvertedIndex, q_w: DataFrame, questions: DataFrame, k: int = 5) -> DataFrame:
    """(qid, rk, doc_id, score, no_match): top-k positive dot products per question (rank by score rounded to 6
    digits, then doc_id); a question without any gets one row with ``no_match`` true.

    ``index``: of (term, doc_id, weight) rows; ``q_w``: (qid, term, weight), weights above 0."""
    hits = top_scores(index, q_w.select("qid", "term", F.col("weight").alias("w")), weight_impact, k)
    top = materialize(ranked(hits.where("score > 0"), k), "sparse-top")
    none = questions.select("qid").join(top.select("qid").distinct(), "qid", "left_anti").select(
        "qid", F.lit(None).cast("bigint").alias("rk"), F.lit(None).cast("bigint").alias("doc_id"),
        F.lit(None).cast("double").alias("score"), F.lit(True).alias("no_match"))
    return top.withColumn("no_match", F.lit(False)).unionByName(none)

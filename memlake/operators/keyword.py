"""Keyword search: postings, corpus statistics, BM25, phrases, prefixes.

Queries come as a DataFrame (query_id, text); one query and a million queries are
the same plan. All terms of a query must match (``require="all"``): the rarest
term gives the candidates, the other terms are then looked up by (turn_id, term),
so a hot term is never expanded for every query that contains it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.functions.text import fold, search_terms, tokenize_cjk
from memlake.operators.ranking import skewed_join, top_k
from memlake.session import durable, settled, together

# BM25 parameters and the least weight of a term.
K1 = 1.2
B = 0.75
LEAST_IDF = 1e-6

SCORE_DIGITS = 6
TERM_BUCKETS = 16

# Query terms up to this number are put into the plan as literal rows.
LITERAL_TERMS = 5_000
# Up to this number of distinct terms the scan itself is told which ones are wanted.
FILTER_TERMS = 200
# Candidates are sent to the postings only up to this number of (query, turn, term) rows, their turns only up to
# this number of (query, turn) pairs.
BROADCAST_CANDIDATES = 500_000
# Query terms are sent to the postings, which then stay where they are, only up to this number.
BROADCAST_TERMS = 100_000


@dataclass(frozen=True)
class KeywordIndex:
    """postings(bucket, term, turn_id, tf, dl, positions, ...), term_stats(bucket, term, df), corpus(n, avgdl).

    The statistics are those of one ``profile``, or of all (None). ``sizes`` has the number
    of indexed turns of every profile, and of all under a null ``profile_id``.

    A stored index consists of segments. The first one holds the turns it was built from; each later one the postings
    of the turns that came with a save, the ids of those that went, and by how much the document
    frequencies, sizes and lengths changed. Nothing written is touched again: what is in force is the sum of the segments'
    figures, and the postings of a turn that no later segment deletes. ``term_parts`` has
    the frequencies as they are stored, for joins that few terms take part in.
    """

    postings: DataFrame
    term_stats: DataFrame
    corpus: DataFrame
    buckets: int
    sizes: DataFrame | None = None
    profile: str | None = None
    term_parts: DataFrame | None = None

    def write(self, path: str) -> None:
        """Store the index as the first segment below ``path``. Rows are in folders by term bucket, sorted by term. The
        statistics are taken from the written postings, so texts are split into
        terms once. Where postings carry the profile, every profile has its own."""
        if self.sizes is None or self.profile is not None:
            raise ValueError("only an index of all profiles can be stored")
        _write_segment(path, 0, 0, self.postings, self.sizes, self.buckets)

    @staticmethod
    def read(spark: SparkSession, path: str, profile: str | None = None) -> KeywordIndex:
        """The index as one profile sees it: its own postings, N, df and average length."""
        heads = _segments(spark, path)
        live = [head["segment"] for head in heads]
        in_force = F.col("segment").isin(live)
        postings, parts, corpus = (spark.read.parquet(f"{path}/{t}").where(in_force) for t in ("postings", "term_stats", "corpus"))
        own = F.col("profile_id").eqNullSafe(F.lit(profile).cast("string"))
        if profile is not None:
            if "profile_id" not in postings.columns:
                raise ValueError("the postings don't carry the profile")
            postings = postings.where(own)
        deleting = [f"{path}/deleted/segment={head['segment']}" for head in heads if head["deletes"]]
        if deleting:
            deleted = spark.read.option("basePath", f"{path}/deleted").parquet(*deleting)
            until = deleted.groupBy(F.col("turn_id").alias("_gone")).agg(F.max("segment").alias("_until"))
            postings = postings.join(until, (F.col("turn_id") == F.col("_gone")) & (F.col("segment") < F.col("_until")), "left_anti")
        parts = parts.where(own).select("bucket", "term", "df")
        several = len(live) > 1
        term_stats = parts.groupBy("bucket", "term").agg(F.sum("df").alias("df")).where("df > 0") if several else parts
        figures = corpus.groupBy("profile_id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        figures = figures.where((F.col("n") > 0) | F.col("profile_id").isNull())
        return KeywordIndex(
            postings.drop("segment"),
            term_stats,
            figures.where(own).select("n", F.try_divide("total", "n").alias("avgdl")),
            heads[0]["buckets"],
            figures.select(F.col("profile_id").alias("size_profile"), "n") if profile is None else None,
            profile,
            parts if several else None,
        )


def _segments(spark: SparkSession, path: str) -> list:
    """(segment, buckets, deletes) of the segments in force, oldest first; the figures of a segment are written last."""
    heads = spark.read.parquet(f"{path}/corpus").where(F.col("profile_id").isNull()).select("segment", "base", "buckets", "deletes").collect()
    base = max(head["base"] for head in heads)
    return sorted((head for head in heads if head["segment"] >= base), key=lambda head: head["segment"])


def next_segment(spark: SparkSession, path: str) -> int:
    return _segments(spark, path)[-1]["segment"] + 1


def _write_segment(
    path: str, segment: int, base: int, postings: DataFrame, sizes: DataFrame, buckets: int, gone: DataFrame | None = None
) -> None:
    """One segment: postings, the ids of the turns of ``gone`` (postings that leave), and changes of all figures.
    Segments before ``base`` are no longer in force. Writing it again replaces it."""
    spark = postings.sparkSession
    own = f"segment={segment}"
    _write_bucketed(postings, f"{path}/postings/{own}")
    postings = spark.read.schema(postings.schema).parquet(f"{path}/postings/{own}")
    stats = term_statistics_by_profile(postings)
    total = lambda rows: _by_profile(rows, F.coalesce(F.sum("tf"), F.lit(0)).alias("total"), F.sum("total").alias("total"))
    totals, deleted = total(postings), None
    if gone is not None:
        deleted = gone.select("turn_id").distinct()
        lost = term_statistics_by_profile(gone).withColumn("df", -F.col("df"))
        stats = stats.unionByName(lost).groupBy("bucket", "term", "profile_id").agg(F.sum("df").alias("df")).where("df <> 0")
        totals = totals.unionByName(total(gone).withColumn("total", -F.col("total"))).groupBy("profile_id").agg(F.sum("total").alias("total"))
    corpus = sizes.join(totals, F.col("size_profile").eqNullSafe(F.col("profile_id")), "left").select(
        F.col("size_profile").alias("profile_id"),
        "n",
        F.coalesce("total", F.lit(0)).alias("total"),
        F.lit(buckets).alias("buckets"),
        F.lit(base).alias("base"),
        F.lit(gone is not None).alias("deletes"),
    )
    _, figures, _ = together(
        lambda: _write_bucketed(stats, f"{path}/term_stats/{own}"),
        lambda: durable(corpus, "corpus"),
        lambda: deleted is not None and deleted.write.mode("overwrite").parquet(f"{path}/deleted/{own}"),
    )
    figures.coalesce(1).write.mode("overwrite").parquet(f"{path}/corpus/{own}")


def append_segment(path: str, segment: int, old_turns: DataFrame, new_turns: DataFrame, text: str = "content") -> None:
    """Store a change of an index as a new segment: ``old_turns`` leave, ``new_turns`` enter. An update is both.

    Written bytes and work go with the change, not with the index. Search reads all segments: ``merge_segments`` joins them.
    """
    spark = new_turns.sparkSession
    buckets = _segments(spark, path)[0]["buckets"]
    carry = _carried(spark.read.parquet(f"{path}/postings"))
    gone = durable(build_postings(old_turns, text, carry, buckets), "gone-postings")
    sizes = [index_sizes(old_turns, text, carry).withColumn("n", -F.col("n")), index_sizes(new_turns, text, carry)]
    change = sizes[0].unionByName(sizes[1]).groupBy("size_profile").agg(F.sum("n").alias("n"))
    base = spark.read.parquet(f"{path}/corpus").agg(F.max("base").alias("base")).first()["base"]
    _write_segment(path, segment, base, build_postings(new_turns, text, carry, buckets), change, buckets, gone)


def merge_segments(spark: SparkSession, path: str) -> None:
    """Write what is in force as one new segment. The segments before it stay on disk for those who read them."""
    index, segment = KeywordIndex.read(spark, path), next_segment(spark, path)
    _write_segment(path, segment, segment, index.postings, durable(index.sizes, "sizes"), index.buckets)


def _carried(postings: DataFrame) -> tuple[str, ...]:
    """The turn columns that postings carry."""
    return tuple(c for c in postings.columns if c not in ("segment", "bucket", "term", "turn_id", "tf", "dl", "positions"))


def _by_profile(rows: DataFrame, measure: Column, total: Column, *keys: str) -> DataFrame:
    """A measure per profile (if the rows have one) and, with a null profile, of all."""
    if "profile_id" not in rows.columns:
        return rows.groupBy(*keys).agg(measure).withColumn("profile_id", F.lit(None).cast("string"))
    own = rows.groupBy(*keys, "profile_id").agg(measure)
    whole = own.groupBy(*keys).agg(total).withColumn("profile_id", F.lit(None).cast("string"))
    return own.where(F.col("profile_id").isNotNull()).unionByName(whole)


def _write_bucketed(df: DataFrame, path: str) -> None:
    """One folder per bucket. Rebalancing splits a bucket, whatever its size, into
    tasks of even size, and joins small ones."""
    placed = df.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term")
    placed.write.partitionBy("bucket").mode("overwrite").parquet(path)


def build_index(
    turns: DataFrame, text: str = "content", carry: tuple[str, ...] = (), buckets: int = TERM_BUCKETS
) -> KeywordIndex:
    """Index the whole of ``text``; rows without text are not indexed.

    ``carry`` names turn columns kept in the postings (time, role, profile), so
    that filters on them need no join. ``buckets`` should grow with the corpus: a
    query reads the buckets of its terms only.
    """
    postings = build_postings(turns, text, carry, buckets)
    return _index_of(postings, index_sizes(turns, text, carry), buckets)


def _index_of(postings: DataFrame, sizes: DataFrame, buckets: int) -> KeywordIndex:
    n = sizes.where(F.col("size_profile").isNull()).select("n")
    return KeywordIndex(postings, term_statistics(postings), corpus_statistics(postings, n), buckets, sizes)


def index_sizes(turns: DataFrame, text: str, carry: tuple[str, ...]) -> DataFrame:
    """(size_profile, n): turns with text of every profile, and of all."""
    worded = turns.where(F.col(text).isNotNull()).select(*[c for c in ("profile_id",) if c in carry], F.lit(1).alias("one"))
    counted = _by_profile(worded, F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return counted.select(F.col("profile_id").alias("size_profile"), "n")


def term_bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def build_postings(
    turns: DataFrame, text: str = "content", carry: tuple[str, ...] = (), buckets: int = TERM_BUCKETS
) -> DataFrame:
    """One row per (term, turn).

    The texts are shuffled by turn_id, which is much less than the postings made
    from them. A turn's words are sorted within its row, so no task sorts or holds more than
    texts; rows that share id, length and carried columns are one turn.
    """
    texts = turns.where(F.col(text).isNotNull()).select("turn_id", *carry, F.col(text).alias("text")).repartition("turn_id")
    tokens = texts.select("turn_id", *carry, search_terms(F.col("text")).alias("tokens"))
    worded = tokens.select("turn_id", *carry, F.size("tokens").cast("long").alias("dl"), F.array_join("tokens", " ").alias("words"))
    whole = worded.groupBy("turn_id", *carry, "dl").agg(F.collect_list("words").alias("texts"))
    # Each list is a column of its own: an expression inside a lambda is computed once per element.
    words = whole.select("turn_id", *carry, "dl", F.sort_array(F.flatten(F.transform("texts", _placed_words))).alias("words"))
    firsts = words.select("*", F.filter(F.sequence(F.lit(0), F.size("words") - 1), _is_first).alias("firsts"))
    runs = firsts.select("turn_id", *carry, "dl", F.transform("firsts", _run).alias("runs"))
    # The outer form: the plain one makes the optimizer split the texts a second
    # time, to drop those without tokens beforehand.
    rows = runs.where(F.col("dl") > 0).select("turn_id", *carry, "dl", F.explode_outer("runs").alias("run"))
    return rows.select(
        term_bucket(F.col("run.term"), buckets).alias("bucket"),
        "turn_id",
        "run.term",
        "dl",
        *carry,
        F.size("run.positions").cast("long").alias("tf"),
        "run.positions",
    )


def _placed_words(text: Column) -> Column:
    return F.transform(F.split(text, " "), lambda term, position: F.struct(term.alias("term"), position.alias("position")))


def _is_first(i: Column) -> Column:
    """Whether the sorted ``words`` have a new term at ``i``."""
    words = F.col("words")
    return (i == 0) | (words[i]["term"] != words[F.greatest(i - 1, F.lit(0))]["term"])


def _run(start: Column, i: Column) -> Column:
    """The places of the term that begins at ``start`` in the sorted ``words``; the next one begins at ``firsts[i + 1]``."""
    end = F.coalesce(F.get("firsts", i + 1), F.size("words"))
    places = F.transform(F.slice("words", start + 1, end - start), lambda word: word["position"])
    return F.struct(F.col("words")[start]["term"].alias("term"), places.alias("positions"))


def term_statistics(postings: DataFrame) -> DataFrame:
    return postings.groupBy("bucket", "term").agg(F.count("*").alias("df"))


def term_statistics_by_profile(postings: DataFrame) -> DataFrame:
    return _by_profile(postings, F.count("*").alias("df"), F.sum("df").alias("df"), "bucket", "term")


def corpus_statistics(postings: DataFrame, n: DataFrame) -> DataFrame:
    """n and the average length; the term frequencies add up to all lengths."""
    total = postings.agg(F.coalesce(F.sum("tf"), F.lit(0))).scalar()
    return n.select("n", (total / F.col("n")).alias("avgdl"))


def refresh_index(index: KeywordIndex, old_turns: DataFrame, new_turns: DataFrame, text: str = "content") -> KeywordIndex:
    """The index after inserts, deletes and updates: ``old_turns`` leave it, ``new_turns`` enter it.

    An update is both: the turn as it was and as it is. Statistics and sizes follow.
    """
    if index.sizes is None:
        raise ValueError("only an index of all profiles can be refreshed")
    kept = index.postings.join(old_turns.select("turn_id").distinct(), "turn_id", "left_anti")
    carry = _carried(index.postings)
    postings = kept.unionByName(build_postings(new_turns, text, carry, index.buckets))
    changes = [
        index.sizes,
        index_sizes(old_turns, text, carry).withColumn("n", -F.col("n")),
        index_sizes(new_turns, text, carry),
    ]
    sizes = changes[0].unionByName(changes[1]).unionByName(changes[2]).groupBy("size_profile").agg(F.sum("n").alias("n"))
    return _index_of(postings, sizes.where((F.col("n") > 0) | F.col("size_profile").isNull()), index.buckets)


def explain_terms(queries: DataFrame, text: str = "text") -> DataFrame:
    """What a query is turned into before it meets the index."""
    spaced = tokenize_cjk(F.col(text))
    return queries.select("*", spaced.alias("spaced"), fold(spaced).alias("folded"), search_terms(F.col(text)).alias("terms"))


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, weight (times the term occurs), n_terms (distinct terms)."""
    terms = search_terms(F.col("text"))
    exploded = queries.select("query_id", F.size(F.array_distinct(terms)).alias("n_terms"), F.explode(terms).alias("term"))
    return exploded.groupBy("query_id", "n_terms", "term").agg(F.count("*").alias("weight"))


def idf(n: Column, df: Column) -> Column:
    value = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(value > 0, value).otherwise(LEAST_IDF)


def bm25(n: Column, df: Column, tf: Column, dl: Column, avgdl: Column) -> Column:
    return idf(n, df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def _with_corpus(df: DataFrame, index: KeywordIndex) -> DataFrame:
    """The corpus figures are one row, read once as a scalar."""
    figures = index.corpus.select(F.struct("n", "avgdl")).scalar()
    return df.withColumn("_corpus", figures).select(*df.columns, "_corpus.n", "_corpus.avgdl")


@dataclass(frozen=True)
class QueryTerms:
    """Query terms with their statistics, computed once; the postings they need; whether the terms are
    few enough for every task; and how many candidate (query, turn) pairs and (query, turn, term) rows they give at most."""

    terms: DataFrame
    postings: DataFrame
    few: bool
    pairs: int
    candidates: int

    def sent(self, terms: DataFrame) -> DataFrame:
        """Some of the terms, for a join with the postings."""
        return F.broadcast(terms) if self.few else terms


def _resolve(index: KeywordIndex, terms: DataFrame, postings: DataFrame, require_all: bool) -> QueryTerms:
    """Add bucket, df, corpus figures and (for ``require_all``) which term is the rarest.

    With ``require_all``, queries with an unknown term cannot match; they leave here,
    before any posting is read.
    """
    bucketed = terms.withColumn("bucket", term_bucket(F.col("term"), index.buckets))
    if index.term_parts is None:
        known = bucketed.join(index.term_stats, ["bucket", "term"])
    else:
        parts = bucketed.join(index.term_parts, ["bucket", "term"])
        known = parts.groupBy(*bucketed.columns).agg(F.sum("df").alias("df")).where("df > 0")
    if require_all:
        of_query = Window.partitionBy("query_id")
        known = known.select(
            "*",
            F.count("*").over(of_query).alias("n_known"),
            (F.row_number().over(of_query.orderBy("df", "term")) == 1).alias("rarest"),
        )
        known = known.where(F.col("n_known") == F.col("n_terms")).drop("n_known")
    terms, rows = settled(_with_corpus(known, index), LITERAL_TERMS, "query-terms")
    if rows is None:
        drivers = F.col("rarest") & (F.col("n_terms") > 1) if require_all else F.lit(False)
        figures = terms.agg(
            F.count("*").alias("n"),
            F.coalesce(F.sum(F.when(drivers, F.col("df"))), F.lit(0)).alias("pairs"),
            F.coalesce(F.sum(F.when(drivers, F.col("df") * F.col("n_terms"))), F.lit(0)).alias("most"),
        ).first()
        return QueryTerms(terms, postings, figures["n"] <= BROADCAST_TERMS, figures["pairs"], figures["most"])
    wanted = sorted({row["term"] for row in rows})
    postings = postings.where(F.col("bucket").isin(sorted({row["bucket"] for row in rows})))
    if len(wanted) <= FILTER_TERMS:
        postings = postings.where(F.col("term").isin(wanted))
    # A turn is a candidate if it holds the rarest term, so df counts the candidates.
    drivers = [row for row in rows if row.get("rarest") and row["n_terms"] > 1]
    pairs, most = sum(row["df"] for row in drivers), sum(row["df"] * row["n_terms"] for row in drivers)
    return QueryTerms(terms, postings, True, pairs, most)


def _matches_of_all(index: KeywordIndex, terms: DataFrame, postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings of the (query, turn) pairs that can hold all terms of the query:
    those of one-term queries, and those of longer ones.

    ``terms``: query_id, n_terms, term and any further columns, one row per
    distinct term of a query.
    """
    resolved = _resolve(index, terms, postings, True)
    terms, postings = resolved.terms, resolved.postings
    columns = [*postings.columns, *[c for c in terms.columns if c not in ("bucket", "term", "rarest")]]

    alone, longer = terms.where(F.col("n_terms") == 1), terms.where(F.col("n_terms") > 1)
    single = skewed_join(postings, resolved.sent(alone), ["bucket", "term"], "inner")

    drivers = resolved.sent(longer.where("rarest").select("query_id", "bucket", "term"))
    candidates = skewed_join(postings, drivers, ["bucket", "term"], "inner").select("query_id", "turn_id")
    wanted = candidates.join(resolved.sent(longer), "query_id")
    if resolved.candidates <= BROADCAST_CANDIDATES:
        probed = postings.join(F.broadcast(wanted), ["turn_id", "bucket", "term"])
    else:
        if resolved.pairs <= BROADCAST_CANDIDATES:
            # Of the postings only those of candidate turns are shuffled.
            postings = postings.join(F.broadcast(candidates.select("turn_id").distinct()), "turn_id", "left_semi")
        of_queries = resolved.sent(longer.select("bucket", "term").distinct())
        relevant = skewed_join(postings, of_queries, ["bucket", "term"], "left_semi")
        probed = relevant.join(wanted, ["turn_id", "bucket", "term"])
    return single.select(*columns), probed.select(*columns)


def matches_of_any(index: KeywordIndex, terms: DataFrame, postings: DataFrame) -> DataFrame:
    resolved = _resolve(index, terms, postings, False)
    return skewed_join(resolved.postings, resolved.sent(resolved.terms), ["bucket", "term"], "inner")


def _term_score() -> Column:
    return F.col("weight") * bm25(F.col("n"), F.col("df"), F.col("tf"), F.col("dl"), F.col("avgdl"))


def _sum_scores(matches: DataFrame) -> DataFrame:
    return matches.groupBy("query_id", "turn_id").agg(
        F.sum(_term_score()).alias("score"), F.count("*").alias("n_matched"), F.max("n_terms").alias("n_terms")
    )


def scores_of_all(index: KeywordIndex, terms: DataFrame, postings: DataFrame) -> DataFrame:
    """One-term queries are scored where their postings are read, without a shuffle."""
    single, longer = _matches_of_all(index, terms, postings)
    summed = _sum_scores(longer).where(F.col("n_matched") == F.col("n_terms"))
    return single.select("query_id", "turn_id", _term_score().alias("score")).unionByName(
        summed.select("query_id", "turn_id", "score")
    )


def scores_of_any(index: KeywordIndex, terms: DataFrame, postings: DataFrame) -> DataFrame:
    return _sum_scores(matches_of_any(index, terms, postings)).select("query_id", "turn_id", "score")


def keyword_scores(
    index: KeywordIndex,
    queries: DataFrame,
    require: str = "all",
    exclude: DataFrame | None = None,
    condition: Column | None = None,
) -> DataFrame:
    """All matches (query_id, turn_id, score), not yet cut to k.

    ``exclude`` (query_id, text): turns with any of these terms are left out.
    ``condition`` filters on columns carried in the postings; the statistics stay
    those of the whole corpus.
    """
    postings = index.postings if condition is None else index.postings.where(condition)
    if require not in ("all", "any"):
        raise ValueError(f"unknown requirement: {require}")
    score = scores_of_all if require == "all" else scores_of_any
    scores = score(index, query_terms(queries), postings)
    scores = scores.withColumn("score", F.round("score", SCORE_DIGITS))
    if exclude is not None:
        # Resolved like the query's own terms, so that only their buckets and rows are read.
        banned = _resolve(index, query_terms(exclude), postings, False)
        named = banned.sent(banned.terms.select("query_id", "bucket", "term"))
        hit = skewed_join(banned.postings, named, ["bucket", "term"], "inner")
        scores = scores.join(hit.select("query_id", "turn_id"), ["query_id", "turn_id"], "left_anti")
    return scores


def best_hits(scores: DataFrame, k: int) -> DataFrame:
    return top_k(scores, ["query_id"], [F.col("score").desc(), F.col("turn_id").asc()], k)


def keyword_search(
    index: KeywordIndex,
    queries: DataFrame,
    k: int,
    require: str = "all",
    exclude: DataFrame | None = None,
    condition: Column | None = None,
) -> DataFrame:
    """The best ``k`` turns of every query: query_id, turn_id, score, rank."""
    return best_hits(keyword_scores(index, queries, require, exclude, condition), k)


def phrase_terms(phrases: DataFrame) -> DataFrame:
    """query_id, term, offsets (places of the term in the phrase), n_terms, n_offsets."""
    terms = search_terms(F.col("text"))
    exploded = phrases.select(
        "query_id",
        F.size(F.array_distinct(terms)).alias("n_terms"),
        F.size(terms).alias("n_offsets"),
        F.posexplode(terms).alias("offset", "term"),
    )
    return exploded.groupBy("query_id", "n_terms", "n_offsets", "term").agg(F.sort_array(F.collect_list("offset")).alias("offsets"))


def _positions_by_turn(index: KeywordIndex, terms: DataFrame, condition: Column | None) -> DataFrame:
    """Per (query, turn) with all terms: the position lists, one per term, and the
    places where the text would have to start, one list per word."""
    postings = index.postings.withColumn("allowed", F.lit(True) if condition is None else condition)
    single, longer = _matches_of_all(index, terms, postings)
    matches = single.unionByName(longer)
    shifted = F.transform("offsets", lambda offset: F.transform("positions", lambda p: p - offset))
    return (
        matches.groupBy("query_id", "turn_id", "dl", "n", "avgdl", "n_terms", "allowed")
        .agg(
            F.flatten(F.collect_list(shifted)).alias("starts"),
            F.collect_list("positions").alias("places"),
            F.count("*").alias("n_matched"),
        )
        .where(F.col("n_matched") == F.col("n_terms"))
    )


def phrase_search(index: KeywordIndex, phrases: DataFrame, k: int, condition: Column | None = None) -> DataFrame:
    """Turns in which the words stand next to each other in this order.

    A phrase counts as one unit: tf is the number of places, df the number of turns.
    """
    found = _positions_by_turn(index, phrase_terms(phrases), condition)
    return best_hits(_score_units(found.withColumn("tf", F.size(_common(F.col("starts"))).cast("long"))), k)


def near_search(index: KeywordIndex, queries: DataFrame, distance: int, k: int, condition: Column | None = None) -> DataFrame:
    """Turns in which all words stand with at most ``distance`` words between the
    first and the last. tf is the number of places where such a window starts."""
    found = _positions_by_turn(index, phrase_terms(queries), condition)
    # From place p a word is in reach if it stands at p, p + 1, ... p + distance + 1:
    # the places from which every word is in reach are an intersection of lists.
    steps = F.sequence(F.lit(0), F.lit(distance + 1))
    reached = F.transform("places", lambda own: F.flatten(F.transform(steps, lambda d: F.transform(own, lambda p: p - d))))
    starts = F.reduce(reached, F.array_distinct(F.flatten("places")), lambda kept, more: F.array_intersect(kept, more))
    return best_hits(_score_units(found.withColumn("tf", F.size(starts).cast("long"))), k)


def _prefix_queries(queries: DataFrame) -> DataFrame:
    """query_id, rest (the text before its last word), lead (terms of the last word but the last), prefix."""
    text = F.col("text")
    cut = F.regexp_extract(text, r"(?s)^(.*?)(\S*)\s*$", 1)
    word = search_terms(F.regexp_extract(text, r"(?s)^(.*?)(\S*)\s*$", 2))
    split = queries.select("query_id", cut.alias("rest"), word.alias("word"))
    return split.where(F.size("word") > 0).select(
        "query_id",
        "rest",
        F.slice("word", F.lit(1), F.size("word") - 1).alias("lead"),
        F.element_at("word", -1).alias("prefix"),
    )


def _begin_with(asked: DataFrame, rows: list[dict] | None, words: DataFrame) -> DataFrame:
    """Rows of ``words`` (term, ...) whose term begins with the prefix of a query, with its query_id.

    Terms are compared at the lengths that occur among the prefixes only; few prefixes are also
    told to the scan of the (sorted) rows.
    """
    asked = asked.select("query_id", "prefix", F.char_length("prefix").alias("size"))
    sizes = asked.select("size").distinct().collect() if rows is None else asked.collect()
    sizes = sorted({row["size"] for row in sizes})
    columns = ["query_id", *words.columns]
    if not sizes:
        return asked.join(words, F.lit(False)).select(*columns)
    if rows is not None and len(prefixes := sorted({row["prefix"] for row in rows})) <= FILTER_TERMS:
        wanted = F.lit(False)
        for prefix in prefixes:
            wanted = wanted | F.col("term").startswith(prefix)
        words = words.where(wanted)
    heads = words.select("*", F.explode(F.array(*[F.lit(n) for n in sizes])).alias("size"))
    heads = heads.where(F.char_length("term") >= F.col("size")).withColumn("prefix", F.expr("substring(term, 1, size)"))
    return heads.join(asked if rows is None else F.broadcast(asked), ["size", "prefix"]).select(*columns)


def _terms_with_prefix(index: KeywordIndex, asked: DataFrame) -> DataFrame:
    """query_id, bucket, term: all words that begin with the query's prefix."""
    asked, rows = settled(asked.select("query_id", "prefix"), LITERAL_TERMS, "prefixes")
    return _begin_with(asked, rows, index.term_stats).select("query_id", "bucket", "term")


def _posted(index: KeywordIndex, terms: DataFrame, postings: DataFrame) -> DataFrame:
    """Postings of (query_id, bucket, term), few terms being told to the scan."""
    terms, rows = settled(terms, LITERAL_TERMS, "terms")
    if rows is not None:
        postings = postings.where(F.col("bucket").isin(sorted({row["bucket"] for row in rows})))
        wanted = sorted({row["term"] for row in rows})
        if len(wanted) <= FILTER_TERMS:
            postings = postings.where(F.col("term").isin(wanted))
    return skewed_join(postings, terms, ["bucket", "term"], "inner")


def prefix_search(index: KeywordIndex, queries: DataFrame, k: int, condition: Column | None = None) -> DataFrame:
    """Turns with all words of the query, of which the last may be the beginning of a longer one.

    The last word is one unit: tf counts the places of all words it stands for, df their turns.
    If it is several terms (Han characters, say), these stand next to each other, and the
    last of them may be longer. The words before it count as in ``keyword_search``.
    """
    asked, rows = settled(_prefix_queries(queries), LITERAL_TERMS, "prefix-queries")
    postings = index.postings.withColumn("allowed", F.lit(True) if condition is None else condition)
    if rows is not None and len({row["prefix"] for row in rows}) <= FILTER_TERMS:
        # The scan knows the prefixes: how many words begin with them does not matter, and no posting is shuffled to meet them.
        found = _begin_with(asked, rows, postings)
    else:
        found = _posted(index, _terms_with_prefix(index, asked), postings)
    leads = asked.where(F.size("lead") > 0).select("query_id", F.size("lead").alias("n_lead"), "lead")
    led_queries = not leads.isEmpty()
    alone = found.join(F.broadcast(leads.select("query_id")), "query_id", "left_anti") if led_queries else found
    units = _with_corpus(alone.groupBy("query_id", "turn_id", "dl", "allowed").agg(F.sum("tf").alias("tf")), index)
    units = units.select("query_id", "turn_id", "dl", "tf", "allowed", "n", "avgdl")
    if led_queries:
        # Places are gathered for the queries that need them only.
        led = found.join(F.broadcast(leads.select("query_id").distinct()), "query_id", "left_semi")
        ends = led.groupBy("query_id", "turn_id").agg(F.flatten(F.collect_list("positions")).alias("ends"))
        words = leads.select("query_id", F.posexplode("lead").alias("offset", "term"))
        sizes = leads.select("query_id", F.size(F.array_distinct("lead")).alias("n_terms"), F.col("n_lead").alias("n_offsets"))
        terms = words.groupBy("query_id", "term").agg(F.sort_array(F.collect_list("offset")).alias("offsets")).join(sizes, "query_id")
        led = _positions_by_turn(index, terms, condition).join(ends, ["query_id", "turn_id"])
        led = led.join(leads.select("query_id", "n_lead"), "query_id")
        shifted = F.array(F.transform("ends", lambda p: p - F.col("n_lead")))
        starts = _common(F.concat("starts", shifted))
        units = units.unionByName(led.select("query_id", "turn_id", "dl", F.size(starts).cast("long").alias("tf"), "allowed", "n", "avgdl"))
    scores = _unit_scores(units)

    before = asked.select("query_id", F.col("rest").alias("text"))
    rest = query_terms(before)
    if not rest.isEmpty():
        own = index.postings if condition is None else index.postings.where(condition)
        matched = scores_of_all(index, rest, own).withColumnRenamed("score", "rest_score")
        with_rest = scores.join(rest.select("query_id").distinct(), "query_id", "left_semi").join(matched, ["query_id", "turn_id"])
        plain = scores.join(rest.select("query_id").distinct(), "query_id", "left_anti")
        scores = plain.unionByName(with_rest.select("query_id", "turn_id", (F.col("score") + F.col("rest_score")).alias("score")))
    return best_hits(scores.withColumn("score", F.round("score", SCORE_DIGITS)), k)


def _common(lists: Column) -> Column:
    """The values that all lists share."""
    return F.reduce(F.slice(lists, F.lit(2), F.size(lists)), F.element_at(lists, 1), lambda kept, more: F.array_intersect(kept, more))


def _unit_scores(units: DataFrame) -> DataFrame:
    """Score units (query_id, turn_id, dl, tf, n, avgdl, allowed); df counts all
    matching turns of a query, allowed or not. The units are computed once."""
    units = units.where(F.col("tf") > 0).select("query_id", "turn_id", "dl", "tf", "n", "avgdl", "allowed")
    units = durable(units, "units")
    df = units.groupBy("query_id").agg(F.count("*").alias("df"))
    score = bm25(F.col("n"), F.col("df"), F.col("tf"), F.col("dl"), F.col("avgdl"))
    return units.where("allowed").join(df, "query_id").select("query_id", "turn_id", score.alias("score"))


def _score_units(units: DataFrame) -> DataFrame:
    return _unit_scores(units).withColumn("score", F.round("score", SCORE_DIGITS))

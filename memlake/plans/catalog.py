"""All queries of the library over the given tables, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.functions import text as text_fn
from memlake.functions import times
from memlake.functions.guard import scan_issues
from memlake.functions.ids import random_id
from memlake.functions.sql import register
from memlake.functions.vectors import l2_normalize, quantize_int8
from memlake.operators import content, filters, hybrid, ingest, keyword, memory, provenance, reports, vector
from memlake.plans import fixtures as fx
from memlake.plans.rebuild import Store, newest, rebuild_index, save_sessions
from memlake.plans.search import SearchFilter, search, semantic_hits
from memlake.session import durable, fresh_path
from memlake.sources.archive import list_archive, parse_lines, read_archive, write_archive
from memlake.sources.payload import sessions_from_payload
from memlake.sources.tables import read_profile, write_by_profile
from memlake.sources.tables import read_table as stored_table
from memlake.streaming import ingest as stream_ingest
from memlake.streaming import memory as stream_memory

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

K = 10
AFTER_MS = fx.BASE_MS + 10 * fx.HOUR_MS
BEFORE_MS = fx.BASE_MS + 60 * fx.HOUR_MS


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _queries(spark: SparkSession, *texts: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts, 1)), "query_id long, text string")


def _ranked(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "turn_id", "score", F.col("rank").cast("long").alias("rank"))


def _near(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "turn_id", "distance", F.col("rank").cast("long").alias("rank"))


# --- ingest ----------------------------------------------------------------------

TURN_COLUMNS = ["session_id", "profile_id", "seq", "timestamp_ms", "role", "preview", "char_count", "n_chars"]
SESSION_COLUMNS = [
    "session_id", "start_ts", "end_ts", "title", "profile_id", "source", "turn_count", "total_tokens", "tags",
]


@query
def build_turns(spark, sf):
    return fx.turns(spark, sf).select("turn_id", "content", *TURN_COLUMNS)


@query
def build_sessions_lenient(spark, sf):
    return fx.sessions(spark, sf).select(*SESSION_COLUMNS)


@query
def build_sessions_strict(spark, sf):
    return fx.sessions(spark, sf, "strict", True).select(*SESSION_COLUMNS)


@query
def assign_turn_ids(spark, sf):
    numbered = ingest.assign_turn_ids(fx.turns(spark, sf))
    return numbered.select("turn_id", "session_id", "seq")


def _payloads(spark, sf):
    """Every message as the payload of a small session: its lines are the turns.
    Some roles, texts and times are missing."""
    rows = fx.load(spark, sf, "conversations")
    start = F.lit(fx.BASE_MS) + F.col("conv_id") * fx.HOUR_MS + F.col("turn") * fx.MINUTE_MS

    def turn(line, i):
        return F.struct(
            F.when(i % 4 != 3, times.to_iso(start + i * 1000)).alias("timestamp"),
            F.when(i % 3 != 1, F.col("role")).alias("role"),
            F.when(i % 5 != 4, line).alias("content"),
            F.lit(None).cast("string").alias("metadata"),
        )

    return rows.select(
        F.concat_ws("-", F.lit("conv"), "conv_id", "turn").alias("session_id"),
        F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("p"), F.col("conv_id") % 3)).alias("profile"),
        F.transform(F.split("text", "\n"), turn).alias("turns"),
        F.array(F.col("role"), F.when(F.col("turn") > 1, "late")).alias("tags"),
    )


@query
def sessions_from_payload_turns(spark, sf):
    _, turns = sessions_from_payload(_payloads(spark, sf))
    return turns.select("session_id", "profile_id", "start_time", "pos", "ts", "seq", "role", "content")


@query
def sessions_from_payload_headers(spark, sf):
    headers, _ = sessions_from_payload(_payloads(spark, sf))
    return headers.select("session_id", "start_time", "profile_id", F.array_join("tags", ",").alias("tags"))


@query
def malformed_records(spark, sf):
    """Events as archive lines, one block per event type and user; lines with k > 90 are cut short."""
    rows = fx.load(spark, sf, "events").select(
        "event_id", "user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k")
    )
    key = F.concat_ws("-", "event_type", "user_id")
    header = F.to_json(
        F.struct(
            F.lit(1).alias("v"), F.lit("session_header").alias("type"), key.alias("session_id"),
            F.when(F.col("user_id") % 10 == 9, "soon").otherwise("2024-01-01T00:00:00Z").alias("start_time"),
            F.lit("p0").alias("profile_id"),
        )
    )
    turn = F.to_json(
        F.struct(
            F.lit("2024-01-01T00:00:00Z").alias("ts"), F.col("event_id").alias("seq"),
            F.lit("user").alias("role"), F.lit("x").alias("content"),
        )
    )
    broken = F.when(F.col("k") > 90, F.substring(turn, 1, 20)).otherwise(turn)
    unknown = F.lit(None).cast("boolean").alias("block_ok")
    shared = [key.alias("file_path"), F.lit(0).cast("long").alias("modified_at"), F.lit(0).cast("long").alias("block")]
    turn_rows = rows.select(*shared, (F.col("event_id") + 1).alias("pos"), broken.alias("line"), header.alias("header_line"), unknown)
    head_rows = rows.select("user_id", "event_type").distinct().select(
        *shared, F.lit(0).cast("long").alias("pos"), header.alias("line"), header.alias("header_line"), unknown
    )
    archive = parse_lines(turn_rows.unionByName(head_rows))
    good = archive.turns.select(F.col("session_id").alias("file_path"), F.col("seq").alias("place"), F.lit("good").alias("outcome"))
    bad = archive.errors.select("file_path", (F.col("pos") - 1).alias("place"), F.col("reason").alias("outcome"))
    return good.unionByName(bad)


def _written_archive(spark, sf):
    path = fresh_path(spark, "archive")
    write_archive(fx.headers(spark, sf), fx.archive_turns(spark, sf), path, version=1)
    return path


@query
def archive_round_trip(spark, sf):
    archive = read_archive(spark, _written_archive(spark, sf))
    return archive.turns.select("session_id", "profile_id", "start_time", "pos", "ts", "seq", "role", "content", "metadata")


@query
def archive_rewrite(spark, sf):
    """Read, write in small blocks, read, write again, read: the same turns."""
    archive = read_archive(spark, _written_archive(spark, sf))
    for version in (2, 3):
        path = fresh_path(spark, "rewritten")
        write_archive(archive.headers, archive.turns, path, version, block_turns=version)
        archive = read_archive(spark, path)
    return archive.turns.select("session_id", "profile_id", "start_time", "pos", "ts", "seq", "role", "content", "metadata")


@query
def list_archive_days(spark, sf):
    files = list_archive(spark, _written_archive(spark, sf))
    parts = [F.regexp_extract("file_path", f"{name}=([0-9]+)/", 1) for name in ("year", "month", "day")]
    return files.where(F.col("file_size") > 0).select(F.concat_ws("-", *parts).alias("day")).distinct()


@query
def import_archive(spark, sf):
    """The newer of two archived versions is imported; it leaves out the system turns."""
    path = _written_archive(spark, sf)
    turns = fx.archive_turns(spark, sf)
    spoken = turns.where(F.col("role") != "system")
    changed = fx.headers(spark, sf).join(turns.where(F.col("role") == "system").select("session_id"), "session_id", "left_semi")
    again = spoken.join(changed.select("session_id"), "session_id", "left_semi")
    write_archive(changed, again, path, version=2)
    archive = newest(read_archive(spark, path))
    return ingest.build_sessions(archive.headers, archive.turns, fx.NOW_MS).select(*SESSION_COLUMNS)


@query
def upsert_sessions(spark, sf):
    """Conversations with a system turn are saved again without it."""
    stored = fx.turns(spark, sf)
    resaved = stored.where(F.col("role") == "system").select("profile_id", "session_id").distinct()
    incoming = stored.where(F.col("role") != "system").join(resaved, "session_id", "left_semi")
    replaced = ingest.upsert_sessions(stored, incoming, resaved)
    return replaced.select("turn_id", "session_id", "seq", "role", "char_count")


@query
def latest_version(spark, sf):
    """Two versions of every conversation that has a system turn; the newer one stays."""
    stored = fx.turns(spark, sf).withColumn("version", F.lit(1))
    resaved = stored.where(F.col("role") == "system").select("session_id").distinct()
    newer = stored.where(F.col("role") == "user").join(resaved, "session_id", "left_semi").withColumn("version", F.lit(2))
    kept = ingest.latest_version(stored.unionByName(newer), ["session_id"], ["version"])
    return kept.select("turn_id", "session_id", F.col("version").cast("long").alias("version"))


@query
def purge_orphans(spark, sf):
    """Vectors stay where a document with their id has a label."""
    labelled = fx.load(spark, sf, "labels").select(F.col("doc_id").alias("turn_id"))
    return ingest.purge_orphans(fx.vectors(spark, sf), labelled).select("turn_id", F.col("label").cast("long").alias("label"))


@query
def refresh_postings(spark, sf):
    """Assistant turns are edited, system turns deleted; the postings follow."""
    turns = fx.turns(spark, sf)
    index = fx.stored_index(spark, sf, "conversations")
    changed = turns.where(F.col("role") != "user")
    edited = turns.where(F.col("role") == "assistant").withColumn("content", F.concat(F.lit("edited "), "content"))
    postings = keyword.refresh_index(index, changed, edited).postings
    return postings.select("term", "turn_id", "tf", "dl")


@query
def vector_maintenance(spark, sf):
    """Vectors of even labels are deleted, then added again under new ids."""
    stored = fx.vectors(spark, sf)
    even = stored.where(F.col("label") % 2 == 0)
    added = even.withColumn("turn_id", F.col("turn_id") + 1_000_000)
    left = ingest.append_vectors(ingest.delete_vectors(stored, even), added)
    return left.select("turn_id", F.col("label").cast("long").alias("label"))


@query
def count_vectors(spark, sf):
    stored = fx.vectors(spark, sf)
    cleared = ingest.count_vectors(ingest.clear_vectors(stored)).select(F.lit("cleared").alias("state"), "n_vectors")
    return ingest.count_vectors(stored).select(F.lit("stored").alias("state"), "n_vectors").unionByName(cleared)


# --- rebuild and reports -----------------------------------------------------------


@query
def rebuild_stats(spark, sf):
    return rebuild_index(spark, _written_archive(spark, sf), fresh_path(spark, "store"), fx.NOW_MS)


@query
def rebuilt_sessions(spark, sf):
    path = fresh_path(spark, "store")
    rebuild_index(spark, _written_archive(spark, sf), path, fx.NOW_MS, with_vectors=False)
    return Store(path).sessions(spark).select(*SESSION_COLUMNS)


@query
def rebuild_two_profiles(spark, sf):
    """Two profiles with the same session ids, one without system turns; both survive."""
    archive, path = _written_archive(spark, sf), fresh_path(spark, "store")
    other = F.lit("other").alias("profile_id")
    headers, turns = (t(spark, sf).withColumn("profile_id", other) for t in (fx.headers, fx.archive_turns))
    write_archive(headers, turns.where(F.col("role") != "system"), archive, version=1)
    rebuild_index(spark, archive, path, fx.NOW_MS, with_vectors=False)
    store = Store(path)
    counts = store.sessions(spark).select("profile_id", "session_id", "turn_count")
    return store.turns(spark).select("profile_id", "session_id", "seq", "role").join(counts, ["profile_id", "session_id"])


def _saved_store(spark, sf):
    """A rebuilt store into which sessions with system turns are saved again without them."""
    store = Store(fresh_path(spark, "store"))
    rebuild_index(spark, _written_archive(spark, sf), store.path, fx.NOW_MS, buckets=4)
    turns = fx.archive_turns(spark, sf)
    system = turns.where(F.col("role") == "system").select("session_id").distinct()
    spoken = turns.where(F.col("role") != "system").join(system, "session_id", "left_semi")
    again = fresh_path(spark, "archive")
    write_archive(fx.headers(spark, sf).join(system, "session_id", "left_semi"), spoken, again, version=2)
    return save_sessions(spark, store, read_archive(spark, again), fx.NOW_MS + 1)


@query
def save_then_search(spark, sf):
    store = _saved_store(spark, sf)
    hits = keyword.keyword_search(store.index(spark), _queries(spark, "the of", "and"), K)
    one = keyword.keyword_search(store.index(spark, "p1"), _queries(spark, "the of", "and"), K)
    found = [h.select(F.lit(p).alias("profile"), "query_id", "score", F.col("rank").cast("long").alias("rank")) for p, h in (("all", hits), ("p1", one))]
    return found[0].unionByName(found[1])


@query
def save_then_stats(spark, sf):
    """Document frequencies, and the counters of all tables, after a save."""
    store = _saved_store(spark, sf)
    sessions = store.sessions(spark)
    counted = reports.index_stats(sessions, store.turns(spark), store.vectors(spark))
    kinds = [F.struct(F.lit(f"({c})").alias("term"), F.col(c).alias("df")) for c in counted.columns]
    counters = counted.select(F.explode(F.array(*kinds)).alias("x")).select("x.term", "x.df")
    first_seen = sessions.agg(F.min("created_at").alias("a"), F.max("created_at").alias("df"))
    first_seen = first_seen.where("a = df").select(F.lit("(created_at)").alias("term"), "df")
    return store.index(spark).term_stats.select("term", "df").unionByName(counters).unionByName(first_seen)


@query
def index_stats(spark, sf):
    return reports.index_stats(fx.sessions(spark, sf), fx.turns(spark, sf), fx.vectors(spark, sf))


@query
def index_parity(spark, sf):
    """Conversation turns against the document vectors and their own postings."""
    postings = fx.stored_index(spark, sf, "conversations").postings
    return reports.index_parity(fx.turns(spark, sf), postings, fx.vectors(spark, sf))


@query
def check_consistency(spark, sf):
    """Archive: all conversations. Table: those with a system turn, and the sources of documents."""
    stored = fx.turns(spark, sf).where(F.col("role") == "system").select("profile_id", "session_id")
    others = fx.document_turns(spark, sf).select("profile_id", "session_id")
    return reports.check_consistency(fx.headers(spark, sf), stored.unionByName(others))


def _altered(spark, sf):
    """Turns as archived (some come late), and as a store holds them: some changed, lost or in another profile."""
    number, seq = F.substring("session_id", 6, 20).cast("long") % 10, F.col("seq")
    turns = fx.turns(spark, sf).withColumn("day", times.day_of(F.col("timestamp_ms")))
    stored = turns.where(~((number == 2) & (seq == 1)))
    changed = F.when((number == 1) & (seq == 2), F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    profile = F.when(number == 3, "elsewhere").otherwise(F.col("profile_id"))
    return turns.where(~((number == 4) & (seq == 3))), stored.withColumn("content", changed).withColumn("profile_id", profile)


@query
def unequal_groups(spark, sf):
    return content.unequal_groups(*_altered(spark, sf), by=("profile_id",))


@query
def content_differences(spark, sf):
    return content.content_differences(*_altered(spark, sf))


@query
def consistency_of_profiles(spark, sf):
    """The archive has every session in two profiles; the table lacks the odd ones of the second."""
    odd = F.substring("session_id", 6, 20).cast("long") % 2 == 1
    archived = fx.shared_ids(fx.headers(spark, sf), F.lit(False))
    return reports.check_consistency(archived, fx.shared_ids(fx.sessions(spark, sf), odd))


@query
def list_sessions(spark, sf):
    return reports.list_sessions(fx.sessions(spark, sf), 20, 28, fx.NOW_MS)


@query
def export_sessions(spark, sf):
    sessions, turns = fx.sessions(spark, sf), fx.turns(spark, sf)
    return reports.export_sessions(sessions, turns, turns.where(F.col("role") == "system").select("profile_id", "session_id"))


@query
def export_shared_sessions(spark, sf):
    """Two profiles with the same session ids, one without system turns: its export holds its own turns only."""
    turns = fx.shared_ids(fx.turns(spark, sf), F.col("role") == "system")
    chosen = turns.where(F.col("role") == "system").select("session_id").distinct()
    return reports.export_sessions(fx.shared_ids(fx.sessions(spark, sf), F.lit(False)), turns, chosen, profile="other")


@query
def list_profiles(spark, sf):
    return reports.list_profiles(fx.sessions(spark, sf))


@query
def by_profile_counts(spark, sf):
    return reports.profile_counts(fx.sessions(spark, sf), fx.turns(spark, sf))


@query
def by_profile(spark, sf):
    """One profile of a table that is stored with a folder per profile."""
    path = fresh_path(spark, "by-profile")
    write_by_profile(fx.turns(spark, sf), path, ["timestamp_ms"])
    return read_profile(spark, path, "p1").select("turn_id", "profile_id", "timestamp_ms")


@query
def read_table(spark, sf):
    """Two columns of a stored table; profiles that look like numbers stay texts."""
    path = fresh_path(spark, "table")
    numbered = fx.turns(spark, sf).withColumn("profile_id", F.concat(F.lit("0"), F.substring("profile_id", 2, 9)))
    write_by_profile(numbered, path, ["timestamp_ms"])
    return stored_table(spark, path, ["turn_id", "profile_id"])


# --- filters -----------------------------------------------------------------------


@query
def time_range(spark, sf):
    return filters.time_range(fx.turns(spark, sf), AFTER_MS, BEFORE_MS).select("turn_id", "timestamp_ms")


@query
def last_days(spark, sf):
    return filters.last_days(fx.turns(spark, sf), 28, fx.NOW_MS).select("turn_id", "timestamp_ms")


@query
def role_filter(spark, sf):
    return filters.role_filter(fx.turns(spark, sf), "assistant").select("turn_id", "role")


@query
def by_session(spark, sf):
    turns = fx.turns(spark, sf)
    chosen = turns.where(F.col("role") == "system").select("profile_id", "session_id")
    return filters.by_session(turns, chosen).select("turn_id", "session_id")


@query
def by_session_of_profile(spark, sf):
    """Two profiles with the same session ids; sessions are chosen in both, by what they hold there."""
    turns = fx.shared_ids(fx.turns(spark, sf), F.col("role") == "system")
    chosen = turns.where(F.col("role") == "system").select("profile_id", "session_id")
    late = turns.where((F.col("seq") > 5) & (F.col("profile_id") == "other")).select("profile_id", "session_id")
    return filters.by_session(turns, chosen.unionByName(late)).select("profile_id", "session_id", "seq")


@query
def non_null_preview(spark, sf):
    blanked = fx.turns(spark, sf).withColumn("preview", F.when(F.col("role") != "system", F.col("preview")))
    return filters.non_null_preview(blanked).select("turn_id", "preview")


@query
def containing_text(spark, sf):
    return filters.containing(fx.document_turns(spark, sf), "the ").select("turn_id", "session_id")


@query
def hit_context(spark, sf):
    """Vectors as hits; those without a turn are dropped."""
    hits = fx.vectors(spark, sf).select("turn_id", F.col("label").cast("long").alias("label"))
    return filters.hit_context(hits, fx.turns(spark, sf)).select("turn_id", "label", "preview", "session_id", "timestamp_ms", "role")


# --- text and index ------------------------------------------------------------------


def _han_texts(spark, sf):
    slot = F.col("turn_id") % 1000 % 4
    mixed = (
        F.when(slot == 0, F.concat(F.lit(fx.HAN_PREFIX), "content"))
        .when(slot == 1, F.concat("content", F.lit(fx.HAN_PREFIX)))
        .when(slot == 2, F.concat(F.lit("a据b"), "content"))
        .otherwise(F.col("content"))
    )
    return fx.turns(spark, sf).select("turn_id", mixed.alias("text"))


@query
def tokenize_cjk(spark, sf):
    return _han_texts(spark, sf).select("turn_id", text_fn.tokenize_cjk(F.col("text")).alias("spaced"))


@query
def sql_tokenize(spark, sf):
    """The same in a SQL statement."""
    register(spark)
    _han_texts(spark, sf).createOrReplaceTempView("han_texts")
    return spark.sql("SELECT turn_id, tokenize_cjk(text) AS spaced FROM han_texts")


@query
def fold_terms(spark, sf):
    rows = fx.documents(spark, sf)
    return rows.select("doc_id", F.array_join(text_fn.fold_terms(F.col("text")), " ").alias("terms"))


@query
def explain_terms(spark, sf):
    explained = keyword.explain_terms(_han_texts(spark, sf))
    return explained.select("turn_id", "spaced", F.array_join("terms", "|").alias("terms"))


@query
def build_postings(spark, sf):
    postings = keyword.build_postings(fx.document_turns(spark, sf))
    return postings.select("term", "turn_id", "tf", "dl", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@query
def term_stats(spark, sf):
    return fx.stored_index(spark, sf, "documents").term_stats.select("term", "df")


@query
def corpus_stats(spark, sf):
    return keyword.build_index(fx.document_turns(spark, sf)).corpus.select("n", F.round("avgdl", 6).alias("avgdl"))


# --- keyword search --------------------------------------------------------------------


@query
def keyword_topk(spark, sf):
    index = fx.stored_index(spark, sf, "conversations")
    return _ranked(keyword.keyword_search(index, _queries(spark, "the of"), K))


@query
def keyword_topk_documents(spark, sf):
    index = fx.stored_index(spark, sf, "documents")
    return _ranked(keyword.keyword_search(index, _queries(spark, "the of", "que la", "with from this", "der", "the zzzz"), K))


@query
def keyword_batch(spark, sf):
    """Every benchmark item is a query: documents with all of its words."""
    index = fx.stored_index(spark, sf, "documents")
    return _ranked(keyword.keyword_search(index, fx.benchmark_queries(spark, sf), K))


@query
def keyword_by_profile(spark, sf):
    """One profile's search sees and counts its own documents only."""
    index = fx.stored_index(spark, sf, "documents", "p1")
    return _ranked(keyword.keyword_search(index, _queries(spark, "the of", "que la", "der"), K))


@query
def keyword_time(spark, sf):
    index = fx.stored_index(spark, sf, "conversations")
    condition = filters.time_condition(AFTER_MS, BEFORE_MS)
    return _ranked(keyword.keyword_search(index, _queries(spark, "the of", "and"), K, condition=condition))


def _search_rows(hits):
    return hits.select(
        "query_id", "turn_id", "score", F.col("rank").cast("long").alias("rank"), "preview", "session_id", "timestamp_ms", "role"
    )


@query
def keyword_role_pre(spark, sf):
    index, turns = fx.stored_index(spark, sf, "conversations"), fx.turns(spark, sf)
    wanted = SearchFilter(after_ms=AFTER_MS, role="assistant")
    return _search_rows(search(turns, _queries(spark, "the of", "and"), index, mode="keyword", k=K, filters=wanted))


@query
def keyword_role_post(spark, sf):
    index, turns = fx.stored_index(spark, sf, "conversations"), fx.turns(spark, sf)
    wanted = SearchFilter(after_ms=AFTER_MS, role="assistant")
    found = search(turns, _queries(spark, "the of", "and"), index, mode="keyword", k=K, filters=wanted, filter_order="post")
    return _search_rows(found)


@query
def keyword_any(spark, sf):
    index = fx.stored_index(spark, sf, "documents")
    return _ranked(keyword.keyword_search(index, _queries(spark, "the of", "que der", "zzzz with"), K, require="any"))


@query
def keyword_none(spark, sf):
    index = fx.stored_index(spark, sf, "documents")
    banned = _queries(spark, "with", "les der")
    return _ranked(keyword.keyword_search(index, _queries(spark, "the of", "en"), K, exclude=banned))


@query
def keyword_phrase(spark, sf):
    index = fx.stored_index(spark, sf, "documents")
    return _ranked(keyword.phrase_search(index, _queries(spark, "of the", "in the", "that is the"), K))


@query
def keyword_phrase_batch(spark, sf):
    """Every benchmark item as a phrase: documents that hold the whole passage."""
    index = fx.stored_index(spark, sf, "documents")
    return _ranked(keyword.phrase_search(index, fx.benchmark_queries(spark, sf), K))


@query
def keyword_near(spark, sf):
    index = fx.stored_index(spark, sf, "documents")
    return _ranked(keyword.near_search(index, _queries(spark, "with from", "the and of"), 3, K))


@query
def keyword_prefix(spark, sf):
    index = fx.stored_index(spark, sf, "documents")
    return _ranked(keyword.prefix_search(index, _queries(spark, "wit", "th", "quee", "the of wit", "que la mi"), K))


@query
def keyword_prefix_han(spark, sf):
    """A prefix of several Han characters is a phrase whose last part may be longer."""
    texts = _han_texts(spark, sf).withColumnRenamed("text", "content")
    index = keyword.build_index(durable(texts, "han-texts"))
    return _ranked(keyword.prefix_search(index, _queries(spark, "数据", "the 数据湖", "b据", "据"), K))


# --- vectors -------------------------------------------------------------------------------


def _joined(column):
    return F.array_join(F.col(column).cast("array<string>"), ",")


@query
def mean_pool(spark, sf):
    """Vectors as token vectors of their label; some are masked."""
    rows = fx.load(spark, sf, "embeddings")
    masked = rows.select(F.col("label").cast("long").alias("label"), "embedding", F.when(F.element_at("embedding", 1) > 0, 1).otherwise(0).alias("mask"))
    pooled = vector.mean_pool(masked, ["label"], "embedding", "mask")
    return pooled.select("label", F.posexplode("embedding").alias("i", "x")).select(
        "label", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x")
    )


@query
def l2_normalize_vectors(spark, sf):
    rows = fx.load(spark, sf, "embeddings")
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 2))
    return rows.select("vec_id", F.posexplode(l2_normalize(scaled)).alias("i", "x")).select(
        "vec_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x")
    )


@query
def quantize_int8_vectors(spark, sf):
    rows = fx.load(spark, sf, "embeddings")
    return rows.select(F.col("vec_id").alias("turn_id"), quantize_int8(F.transform("embedding", lambda x: x * 8)).alias("q8")).select(
        "turn_id", _joined("q8").alias("q8")
    )


@query
def knn_l2(spark, sf):
    return _near(vector.knn(fx.vectors(spark, sf), fx.label_queries(spark, sf), 5))


@query
def knn_cosine(spark, sf):
    return _near(vector.knn(fx.vectors(spark, sf), fx.label_queries(spark, sf), 5, metric="cosine"))


@query
def knn_join(spark, sf):
    """The nearest vectors of every vector."""
    stored = fx.vectors(spark, sf)
    return _near(vector.knn(stored, stored.select(F.col("turn_id").alias("query_id"), "q8"), 5))


def _embedded_documents(spark, sf):
    """Documents and the vectors that share their ids."""
    return fx.document_turns(spark, sf), fx.vectors(spark, sf)


@query
def semantic_filtered(spark, sf):
    turns, stored = _embedded_documents(spark, sf)
    wanted = SearchFilter(after_ms=AFTER_MS - 8 * fx.HOUR_MS, role="en")
    return _search_rows(search(turns, fx.label_queries(spark, sf), vectors=stored, mode="semantic", filters=wanted))


@query
def semantic_post_filtered(spark, sf):
    turns, stored = _embedded_documents(spark, sf)
    wanted = SearchFilter(after_ms=AFTER_MS - 8 * fx.HOUR_MS, role="en")
    hits = semantic_hits(turns, stored, fx.label_queries(spark, sf), K, wanted, "post")
    return _ranked(hits)


@query
def embed_texts(spark, sf):
    rows = fx.document_turns(spark, sf).select("turn_id", "content")
    return vector.quantized(vector.embed_texts(rows)).select("turn_id", _joined("q8").alias("q8"))


@query
def semantic_text_search(spark, sf):
    """Benchmark items as questions to the documents, both encoded from their texts."""
    turns = fx.document_turns(spark, sf)
    stored = vector.quantized(vector.embed_texts(turns.select("turn_id", "content"))).select("turn_id", "q8")
    return _search_rows(search(turns, fx.benchmark_queries(spark, sf), vectors=stored, mode="semantic"))


# --- hybrid --------------------------------------------------------------------------------


def _label_words(spark):
    return _queries(spark, "the of", "and with", "que", "in this", "der")


@query
def rrf_fuse(spark, sf):
    index = fx.stored_index(spark, sf, "documents")
    words = keyword.keyword_search(index, _label_words(spark), K)
    near = vector.knn(fx.vectors(spark, sf), fx.label_queries(spark, sf), K)
    return _ranked(hybrid.rrf_fuse([near, words], K))


@query
def hybrid_keyword_only(spark, sf):
    index, turns = fx.stored_index(spark, sf, "documents"), fx.document_turns(spark, sf)
    return _search_rows(search(turns, _label_words(spark), index, mode="hybrid", k=K))


@query
def search_hybrid(spark, sf):
    index = fx.stored_index(spark, sf, "documents")
    turns, stored = _embedded_documents(spark, sf)
    queries = fx.label_queries(spark, sf).join(_label_words(spark), "query_id")
    return _search_rows(search(turns, queries, index, stored, mode="hybrid", k=K, filters=SearchFilter(role="en")))


@query
def search_by_profile(spark, sf):
    """A hybrid search in one profile: its documents, vectors and statistics only."""
    index = fx.stored_index(spark, sf, "documents", "p1")
    turns, stored = _embedded_documents(spark, sf)
    queries = fx.label_queries(spark, sf).join(_label_words(spark), "query_id")
    return _search_rows(search(turns, queries, index, stored, mode="hybrid", k=K, filters=SearchFilter(profile="p1")))


# --- memory --------------------------------------------------------------------------------


@query
def scan_content(spark, sf):
    issues = scan_issues(F.col("content"))
    rows = fx.scan_texts(spark, sf).select("doc_id", issues.alias("issues"))
    return rows.select("doc_id", F.array_join("issues", "; ").alias("issues"), (F.size("issues") == 0).alias("is_safe"))


@query
def scan_summary(spark, sf):
    rows = fx.scan_texts(spark, sf).select(F.explode(scan_issues(F.col("content"))).alias("issue"))
    return rows.groupBy("issue").agg(F.count("*").alias("n"))


VERDICT_COLUMNS = ["profile_id", "target", "ts", "entry_id", "n_chars", "verdict"]


def _entries(spark, sf):
    return memory.accepted_entries(fx.memory_candidates(spark, sf))


@query
def admit_entries(spark, sf):
    return memory.admit_entries(fx.memory_candidates(spark, sf)).select(*VERDICT_COLUMNS)


@query
def rejected_entries(spark, sf):
    rejected = memory.rejected_entries(memory.admit_entries(fx.memory_candidates(spark, sf)))
    return rejected.select("profile_id", "target", "entry_id", "verdict", "reason")


@query
def memory_usage(spark, sf):
    return memory.memory_usage(_entries(spark, sf))


@query
def render_memory(spark, sf):
    return memory.render_memory(_entries(spark, sf), fx.NOW_MS).select("profile_id", "target", "document")


@query
def parse_memory(spark, sf):
    documents = memory.render_memory(_entries(spark, sf), fx.NOW_MS)
    return memory.parse_memory(documents).select("profile_id", "target", F.col("piece").cast("long").alias("piece"), "content")


@query
def list_entries(spark, sf):
    listed = memory.list_entries(_entries(spark, sf).withColumn("created_at", F.col("ts")), "memory")
    return listed.select("profile_id", "target", "content", "created_at")


@query
def user_profile(spark, sf):
    candidates = fx.memory_candidates(spark, sf).where(F.col("target") == memory.USER_TARGET)
    return memory.render_memory(memory.accepted_entries(candidates), fx.NOW_MS).select("profile_id", "body")


@query
def user_profile_edits(spark, sf):
    """User profiles after writes, updates and removals."""
    snapshot, _ = memory.apply_memory_events(fx.memory_events(spark, sf))
    # The place of an entry is its order.
    placed = snapshot.where(F.col("target") == memory.USER_TARGET).withColumns({"ts": F.lit(0), "entry_id": F.lit(0)})
    return memory.render_memory(placed, fx.NOW_MS).select("profile_id", "body")


@query
def apply_memory_events(spark, sf):
    _, verdicts = memory.apply_memory_events(fx.memory_events(spark, sf))
    return verdicts.select("profile_id", "target", "event_id", "pos", "op", "verdict")


@query
def memory_snapshot(spark, sf):
    snapshot, _ = memory.apply_memory_events(fx.memory_events(spark, sf))
    return snapshot.select("profile_id", "target", F.col("piece").cast("long").alias("piece"), "content")


# --- provenance and audit ---------------------------------------------------------------------


@query
def trace_sources(spark, sf):
    entries = fx.memory_candidates(spark, sf)
    traced = provenance.trace_sources(entries, fx.source_sessions(spark, sf))
    return traced.select("entry_id", "target", "confidence", "source_session", "session_exists", "session_file_path")


@query
def provenance_report(spark, sf):
    traced = provenance.trace_sources(fx.memory_candidates(spark, sf), fx.source_sessions(spark, sf))
    return provenance.provenance_report(traced, ["profile_id", "target"])


@query
def memory_provenance(spark, sf):
    """Sources of what the memories hold after all edits."""
    snapshot, _ = memory.apply_memory_events(fx.memory_events(spark, sf))
    traced = provenance.trace_sources(snapshot.withColumnRenamed("event_id", "entry_id"), fx.source_sessions(spark, sf))
    return traced.select("profile_id", "target", "piece", "content", "ts", "created_at", "confidence", "source_session", "session_exists", "session_file_path")


@query
def audit_edits(spark, sf):
    """The whole detail of every accepted write, update and removal, read from a stored log."""
    _, verdicts = memory.apply_memory_events(fx.memory_events(spark, sf))
    path = fresh_path(spark, "audit-log")
    provenance.write_audit(provenance.audit_events(provenance.event_actions(verdicts)), path)
    return provenance.read_audit(spark, path, after_ms=0)


@query
def audit_events(spark, sf):
    verdicts = memory.admit_entries(fx.memory_candidates(spark, sf))
    actions = verdicts.select(
        F.col("ts").alias("timestamp_ms"), F.lit("write").alias("op"), "target",
        F.lit(None).cast("string").alias("old_text"), F.col("content").alias("new_text"),
        F.col("source_session").alias("session_id"), "verdict", "entry_id",
    )
    log = provenance.audit_events(actions)
    return log.select("timestamp_ms", "action", "target", F.get_json_object("detail", "$.content_preview").alias("detail"), "session_id")


@query
def audit_range(spark, sf):
    day = 24 * fx.HOUR_MS
    return provenance.audit_range(fx.audit_log(spark, sf), fx.BASE_MS + 3 * day, fx.BASE_MS + 9 * day)


# --- functions ------------------------------------------------------------------------------------


@query
def time_parse(spark, sf):
    """The times of the audit log written in the four accepted forms, and in one that is not."""
    ms, slot = F.col("timestamp_ms"), F.col("event_id") % 5
    log = fx.audit_log(spark, sf).withColumn("event_id", F.col("timestamp_ms"))
    iso = times.to_iso(ms)
    text = (
        F.when(slot == 0, iso)
        .when(slot == 1, F.regexp_replace(iso, "Z$", ""))
        .when(slot == 2, times.compact_time(ms))
        .when(slot == 3, F.regexp_replace(iso, "Z$", "+08:00"))
        .otherwise(F.substring(iso, 1, 10))
    )
    return log.select("timestamp_ms", "session_id", text.alias("text")).select(
        "timestamp_ms", "session_id", "text", times.to_millis(F.col("text")).alias("parsed")
    )


@query
def time_format(spark, sf):
    log = fx.audit_log(spark, sf)
    ms = F.col("timestamp_ms")
    return log.select("timestamp_ms", "session_id", times.to_iso(ms).alias("iso"), times.day_of(ms).alias("day"), times.compact_time(ms).alias("compact"))


@query
def json_path(spark, sf):
    tokens = fx.archive_turns(spark, sf)
    return tokens.select(
        "turn_id",
        ingest.turn_tokens(F.col("metadata"), "strict").alias("strict"),
        ingest.turn_tokens(F.col("metadata"), "lenient").alias("lenient"),
        F.get_json_object("metadata", "$.usage.output_tokens").cast("long").alias("output_tokens"),
    )


@query
def random_ids(spark, sf):
    """Ids of documents: as many as rows, all of one form."""
    ids = durable(fx.documents(spark, sf).select(random_id().alias("id")), "random-ids")
    form = F.col("id").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
    return ids.agg(F.countDistinct("id").alias("n_ids"), F.count_if(form).alias("n_well_formed"))


# --- streams ----------------------------------------------------------------------------------------


def _file_stream(spark: SparkSession, sf: str, df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back as a stream."""
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


@query
def stream_ingest_sessions(spark, sf):
    store = fresh_path(spark, "stream-store")
    run = stream_ingest.stream_ingest(spark, _written_archive(spark, sf), store, fresh_path(spark, "checkpoint"), fx.NOW_MS, 20)
    run.awaitTermination()
    return stream_ingest.current(spark, store, "sessions").select(*SESSION_COLUMNS)


@query
def stream_ingest_versions(spark, sf):
    """Two versions in the first batch, a third for even conversations in a later one; then the log is compacted."""
    path, turns, headers = _written_archive(spark, sf), fx.archive_turns(spark, sf), fx.headers(spark, sf)
    write_archive(headers, turns.where(F.col("role") != "system"), path, version=2)
    store, checkpoint = fresh_path(spark, "stream-store"), fresh_path(spark, "checkpoint")
    stream_ingest.stream_ingest(spark, path, store, checkpoint, fx.NOW_MS).awaitTermination()
    even = F.substring("session_id", 6, 20).cast("long") % 2 == 0
    write_archive(headers.where(even), turns.where(even & (F.col("role") == "user")), path, version=3)
    stream_ingest.stream_ingest(spark, path, store, checkpoint, fx.NOW_MS).awaitTermination()
    compacted = fresh_path(spark, "stream-store")
    stream_ingest.compact(spark, store, compacted)
    counted = stream_ingest.current(spark, compacted, "turns").groupBy("session_id").agg(F.count("*").alias("n_turns"), F.sum("seq").alias("seqs"))
    return stream_ingest.current(spark, store, "sessions").select("session_id", "turn_count").join(counted, "session_id", "left")


@query
def stream_merged_sessions(spark, sf):
    """Many small batches that merge while the stream runs, then newer versions of even conversations: what is current."""
    path, turns, headers = fresh_path(spark, "archive"), fx.archive_turns(spark, sf), fx.headers(spark, sf)
    number = F.substring("session_id", 6, 20).cast("long")
    for part in range(2):
        chosen = number % 2 == part
        write_archive(headers.where(chosen), turns.where(chosen), path, version=part + 1)
    store, checkpoint = fresh_path(spark, "stream-store"), fresh_path(spark, "checkpoint")
    per_batch = -(-len(list_archive(spark, path).collect()) // 5)
    stream_ingest.stream_ingest(spark, path, store, checkpoint, fx.NOW_MS, per_batch, merge_every=2).awaitTermination()
    write_archive(headers.where(number % 2 == 0), turns.where((number % 2 == 0) & (F.col("role") == "user")), path, version=3)
    stream_ingest.stream_ingest(spark, path, store, checkpoint, fx.NOW_MS, 10 * per_batch, merge_every=2).awaitTermination()
    counted = stream_ingest.current(spark, store, "turns").groupBy("session_id").agg(F.count("*").alias("n_turns"), F.sum("seq").alias("seqs"))
    return stream_ingest.current(spark, store, "sessions").select("session_id", "turn_count").join(counted, "session_id", "left")


@query
def stream_scan(spark, sf):
    out = fresh_path(spark, "stream-scan")
    texts = _file_stream(spark, sf, fx.scan_texts(spark, sf), "texts")
    stream_memory.stream_scan(texts, "content", out, fresh_path(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(out).select("doc_id", F.array_join("issues", "; ").alias("issues"), "is_safe")


def _streamed_admission(spark, sf):
    """Candidates arrive in order, in three parts, one micro-batch each."""
    out, source = fresh_path(spark, "stream-admit"), fresh_path(spark, "candidates")
    candidates = durable(fx.memory_candidates(spark, sf), "candidates")
    last = candidates.agg(F.max("ts")).scalar()
    candidates.withColumn("arrival", F.floor(F.col("ts") * 3 / (last + 1))).write.partitionBy("arrival").parquet(source)
    schema = spark.read.parquet(source).schema
    for arrival in range(3):
        # Every run of the same query continues from its checkpoint with the new files.
        files = spark.readStream.schema(schema).option("basePath", source).parquet(f"{source}/arrival=[0-{arrival}]")
        stream_memory.stream_admit(files.drop("arrival"), out, f"{out}/checkpoint").awaitTermination()
    return out


@query
def stream_admit(spark, sf):
    out = _streamed_admission(spark, sf)
    return spark.read.parquet(f"{out}/verdicts").select(*VERDICT_COLUMNS)


def _streamed_replay(spark, sf):
    """Events arrive in order, in three parts."""
    out, source = fresh_path(spark, "stream-replay"), fresh_path(spark, "events")
    events = durable(fx.memory_events(spark, sf), "events")
    last = events.agg(F.max("ts")).scalar()
    events.withColumn("arrival", F.floor(F.col("ts") * 3 / (last + 1))).write.partitionBy("arrival").parquet(source)
    schema = spark.read.parquet(source).schema
    for arrival in range(3):
        files = spark.readStream.schema(schema).option("basePath", source).parquet(f"{source}/arrival=[0-{arrival}]")
        stream_memory.stream_replay(files.drop("arrival"), out, f"{out}/checkpoint").awaitTermination()
    return out


@query
def stream_replay(spark, sf):
    """The memories are those of one replay of all."""
    kept = stream_memory.current_memories(spark, f"{_streamed_replay(spark, sf)}/checkpoint")
    return kept.select("profile_id", "target", F.col("piece").cast("long").alias("piece"), "content")


@query
def stream_replay_verdicts(spark, sf):
    verdicts = spark.read.parquet(f"{_streamed_replay(spark, sf)}/verdicts")
    return verdicts.select("profile_id", "target", "event_id", "op", "verdict")


@query
def stream_audit_edits(spark, sf):
    """The log of streamed writes, updates and removals, with the whole detail."""
    out, log = _streamed_replay(spark, sf), fresh_path(spark, "stream-audit")
    stream_memory.stream_audit(spark, f"{out}/verdicts", log, fresh_path(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(log)


@query
def stream_audit(spark, sf):
    out = _streamed_admission(spark, sf)
    log = fresh_path(spark, "stream-audit")
    stream_memory.stream_audit(spark, f"{out}/accepted", log, fresh_path(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(log).select(
        "timestamp_ms", "action", "target", F.get_json_object("detail", "$.content_preview").alias("detail"), "session_id"
    )

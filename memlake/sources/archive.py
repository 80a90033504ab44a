"""Session archives: JSON lines, one header line followed by turn lines.

A file may hold one session (the usual layout) or several blocks written by
``write_archive``. Small files are read whole; files above ``WHOLE_FILE_BYTES``
are read line by line and split over tasks, so no file has to fit in memory.
"""

from __future__ import annotations

import functools
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.functions.text import trim_text
from memlake.functions.times import day_of, to_millis

WHOLE_FILE_BYTES = 32 * 1024 * 1024
# A block ends at this many turns or, before, at this many bytes of turn lines.
BLOCK_TURNS = 10_000
BLOCK_BYTES = 64 * 1024 * 1024

# Foreign archives end in .jsonl; Spark's text writer gives .txt.
ARCHIVE_FILES = "*.{jsonl,txt}"

# The header and turn fields of the archive format.
HEADER_SCHEMA = (
    "v int, type string, session_id string, start_time string, profile_id string, "
    "source string, agent_model string, title string, tags array<string>, part long, first long, version long, write_id string"
)
HEADER_TYPE = "session_header"
TURN_SCHEMA = "ts string, seq long, role string, content string"
TURN_FIELDS = ["ts", "seq", "role", "content"]

FILE_COLUMNS = ["file_path", "modified_at"]


@dataclass(frozen=True)
class Archive:
    """``headers`` one row per block, ``turns`` one row per turn, ``errors`` one row per bad line.

    A turn carries its header's profile and start, so that building the tables
    needs no join. ``part`` is the number of turns before the block.
    """

    headers: DataFrame
    turns: DataFrame
    errors: DataFrame


def list_archive(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The archive files below ``paths``, without reading their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", ARCHIVE_FILES)
    return files.load(paths).select(
        F.col("path").alias("file_path"),
        F.col("length").alias("file_size"),
        F.unix_millis("modificationTime").alias("modified_at"),
    )


def read_archive(spark: SparkSession, paths: str | list[str], whole_file_bytes: int = WHOLE_FILE_BYTES) -> Archive:
    return parse_lines(read_lines(spark, paths, whole_file_bytes))


def read_lines(spark: SparkSession, paths: str | list[str], whole_file_bytes: int = WHOLE_FILE_BYTES, all_small: bool = False) -> DataFrame:
    """Every non-blank line with its file, block and position in the block.

    Columns: file_path, modified_at, block (position of the header line in the
    file), pos (0 for the header), line, header_line, block_ok (NULL: not known).
    ``all_small``: the caller has seen the sizes; every file is read whole, also one that grew since.
    """
    if all_small:
        return _lines_of_whole_files(spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", ARCHIVE_FILES).text(paths, wholetext=True))
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", ARCHIVE_FILES)
    small = reader.text(paths, wholetext=True).where(F.col("_metadata.file_size") <= whole_file_bytes)
    lines = _lines_of_whole_files(small)
    if list_archive(spark, paths).where(F.col("file_size") > whole_file_bytes).isEmpty():
        return lines
    large = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", ARCHIVE_FILES).option("lineSep", "\n")
    large = large.text(paths).where(F.col("_metadata.file_size") > whole_file_bytes)
    return lines.unionByName(_lines_of_large_files(large))


def _file_columns() -> list[Column]:
    return [
        F.col("_metadata.file_path").alias("file_path"),
        F.unix_millis("_metadata.file_modification_time").alias("modified_at"),
    ]


@functools.cache
def _whole_file_columns() -> tuple[Column, ...]:
    """numbered lines, block starts, blocks, a block's own lines, whether they are good; made once, as a stream reads
    thousands of small batches."""
    lines = F.filter(F.transform(F.split("value", r"\n"), _line), lambda line: trim_text(line) != "")
    numbered = F.transform(lines, lambda line, i: F.struct(i.cast("long").alias("n"), line.alias("line")))
    starts = F.filter("lines", lambda x: _starts_block(x["line"], x["n"] == 0))
    blocks = F.transform(
        "starts",
        lambda start, i: F.struct(
            start["n"].alias("block"),
            start["line"].alias("header_line"),
            F.coalesce(F.get("starts", i + 1)["n"], F.size("lines").cast("long")).alias("stop"),
        ),
    )
    own = F.slice("lines", F.col("b.block").cast("int") + 1, (F.col("b.stop") - F.col("b.block")).cast("int"))
    bad = F.exists("own", lambda x: _bad_line(x["line"], x["n"] == F.col("block")).isNotNull())
    return numbered.alias("lines"), starts, F.explode_outer(blocks).alias("b"), own.alias("own"), ~bad


def _lines_of_whole_files(files: DataFrame) -> DataFrame:
    """``files`` holds one whole file per row in ``value``; nothing is shuffled."""
    numbered, starts, blocks, own, good = _whole_file_columns()
    per_block = (
        files.select(*_file_columns(), numbered)
        .withColumn("starts", starts)
        .select(*FILE_COLUMNS, "lines", blocks)
        .where(F.col("b").isNotNull())
        .select(*FILE_COLUMNS, "b.block", "b.header_line", own)
    )
    # Judged before the block is taken apart: beside the generator it would be judged once per line.
    judged = per_block.withColumn("block_ok", good)
    exploded = judged.select(*FILE_COLUMNS, "block", "header_line", "block_ok", F.explode_outer("own").alias("x"))
    return exploded.select(
        *FILE_COLUMNS,
        "block",
        (F.col("x.n") - F.col("block")).alias("pos"),
        F.col("x.line").alias("line"),
        "header_line",
        "block_ok",
    )


def _line(value: Column) -> Column:
    """Lines end with a line feed; one carriage return before it belongs to the end."""
    return F.regexp_replace(value, r"\r\z", "")


def _starts_block(line: Column, first_in_file: Column) -> Column:
    """The header is the first line; later blocks announce themselves by their type."""
    looks_like_header = line.contains(f'"{HEADER_TYPE}"') & (F.get_json_object(line, "$.type") == HEADER_TYPE)
    return first_in_file | F.coalesce(looks_like_header, F.lit(False))


def _lines_of_large_files(files: DataFrame) -> DataFrame:
    """Line-wise reading of files of any size.

    Within one split the order of lines is the order of ``line_id``; a split that
    starts inside a block takes the last header of the splits before it.
    """
    lines = files.select(
        *_file_columns(),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("line_id"),
        _line(F.col("value")).alias("line"),
    ).where(trim_text(F.col("line")) != "")
    split = Window.partitionBy("file_path", "split").orderBy("line_id")
    lines = lines.withColumn("n", F.row_number().over(split).cast("long"))
    # The first line of a file may lie behind splits of blank lines only.
    first = lines.groupBy("file_path").agg(F.min("split").alias("first_split"))
    lines = lines.join(first, "file_path")
    lines = lines.withColumn("head", _starts_block(F.col("line"), (F.col("split") == F.col("first_split")) & (F.col("n") == 1)))

    here = F.when(F.col("head"), F.struct(F.col("n"), F.col("line")))
    within = split.rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("own_head", F.last(here, ignorenulls=True).over(within))

    splits = lines.groupBy("file_path", "split").agg(
        F.count("*").alias("n_lines"), F.max_by(here, F.when(F.col("head"), F.col("n"))).alias("last_head")
    )
    earlier = Window.partitionBy("file_path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("offset", F.coalesce(F.sum("n_lines").over(earlier), F.lit(0)))
    last_head = F.when(
        F.col("last_head").isNotNull(),
        F.struct((F.col("offset") + F.col("last_head.n") - 1).alias("block"), F.col("last_head.line").alias("line")),
    )
    splits = splits.withColumn("carried", F.last(last_head, ignorenulls=True).over(earlier))

    joined = lines.join(splits.select("file_path", "split", "offset", "carried"), ["file_path", "split"])
    block = F.coalesce(F.col("offset") + F.col("own_head.n") - 1, F.col("carried.block"))
    return joined.select(
        *FILE_COLUMNS,
        block.alias("block"),
        (F.col("offset") + F.col("n") - 1 - block).alias("pos"),
        "line",
        F.coalesce("own_head.line", "carried.line").alias("header_line"),
        F.lit(None).cast("boolean").alias("block_ok"),
    )


def parse_lines(lines: DataFrame) -> Archive:
    """Parse headers and turns; a bad line is reported and its block is left out."""
    return archive_of(parsed_lines(lines))


def parsed_lines(lines: DataFrame) -> DataFrame:
    """Every line with its header ``h`` and turn ``t``, the keys besides, and why it is bad.

    This is the form to store: the text of a line is kept only where it is bad, and of its
    header only the fields.
    """
    return lines.select(*_parsed_columns())


@functools.cache
def _parsed_columns() -> tuple[Column | str, ...]:
    reason = F.when(~F.coalesce("block_ok", F.lit(False)), _bad_line(F.col("line"), F.col("pos") == 0))
    is_turn = F.col("pos") > 0
    return (
        *FILE_COLUMNS,
        "block",
        "pos",
        "block_ok",
        F.from_json("header_line", HEADER_SCHEMA).alias("h"),
        F.when(is_turn, F.from_json("line", TURN_SCHEMA)).alias("t"),
        F.when(is_turn, extra_fields(F.col("line"))).alias("metadata"),
        reason.alias("reason"),
        F.when(reason.isNotNull(), F.col("line")).alias("line"),
    )


def archive_of(parsed: DataFrame, judged: bool = False) -> Archive:
    """``judged``: every line says whether its block is good, as lines of files read whole do."""
    errors = parsed.where(F.col("reason").isNotNull()).select("file_path", "block", "pos", "reason", "line")
    good = parsed.where(F.col("block_ok"))
    if not judged:
        bad_blocks = errors.select("file_path", "block").distinct()
        unknown = parsed.where(F.col("block_ok").isNull()).join(bad_blocks, ["file_path", "block"], "left_anti")
        good = good.unionByName(unknown)
    place, header, turn = _archive_columns(BLOCK_TURNS)
    good = good.select("*", *place)
    return Archive(good.where(F.col("pos") == 0).select(*header), good.where(F.col("pos") > 0).select(*turn), errors)


@functools.cache
def _archive_columns(block_turns: int) -> tuple[tuple[Column | str, ...], ...]:
    """What tells a line's place and version, the columns of headers, the columns of turns."""
    place = (
        # Archives written before ``first`` was kept have the number of the block.
        F.coalesce("h.first", F.col("h.part") * block_turns, F.lit(0)).alias("part"),
        F.coalesce("h.version", "modified_at").alias("version"),
        # Two writes of one version number are told apart by their own mark.
        F.when(F.col("h.version").isNull(), F.col("file_path")).otherwise(F.coalesce("h.write_id", F.lit(""))).alias("version_file"),
    )
    header = (
        "h.session_id",
        "h.start_time",
        "h.profile_id",
        "h.source",
        "h.agent_model",
        "h.title",
        F.coalesce("h.tags", F.array().cast("array<string>")).alias("tags"),
        "part",
        "version",
        "version_file",
        "file_path",
    )
    turn = (
        "h.session_id",
        "h.profile_id",
        "h.start_time",
        (F.col("part") + F.col("pos")).alias("pos"),
        "t.ts",
        "t.seq",
        "t.role",
        "t.content",
        "metadata",
        "version",
        "version_file",
    )
    return place, header, turn


def extra_fields(line: Column) -> Column:
    """The keys besides the fixed ones, as JSON text; NULL where there are none."""
    fields = F.map_filter(F.from_json(line, "map<string,variant>"), lambda key, _: ~key.isin(TURN_FIELDS))
    return F.when(F.size(fields) > 0, F.to_json(fields))


def _bad_line(line: Column, is_header: Column) -> Column:
    """Why a line cannot be used, or NULL. The header is known by its position."""
    header = F.from_json(line, HEADER_SCHEMA)
    turn = F.from_json(line, TURN_SCHEMA)
    no_header = _any_null(header, ["v", "type", "session_id", "start_time", "profile_id"])
    return (
        F.when(is_header & no_header, "bad header")
        .when(is_header & to_millis(header["start_time"]).isNull(), "bad start time")
        .when(~is_header & _any_null(turn, TURN_FIELDS), "bad turn")
    )


def _any_null(record: Column, fields: list[str]) -> Column:
    missing = record.isNull()
    for field in fields:
        missing = missing | record[field].isNull()
    return missing


def write_archive(
    headers: DataFrame,
    turns: DataFrame,
    path: str,
    version: int,
    mode: str = "append",
    blocks_per_file: int = 10_000,
    block_turns: int | None = None,
) -> None:
    """Write sessions as blocks of one header line and up to ``BLOCK_TURNS`` turn lines.

    A session of any length becomes a row of bounded blocks, so that no task
    gathers a whole session. Folders are year / month / day of the start (UTC).
    ``version`` marks this write: of two versions of a session the later one wins, of two
    writes with the same version the one with the larger mark, as a whole.
    """
    blocks = archive_blocks(headers, turns, version, block_turns or BLOCK_TURNS)
    day = day_of(to_millis(F.col("start_time")))
    out = blocks.select(
        F.substring(day, 1, 4).alias("year"),
        F.substring(day, 6, 2).alias("month"),
        F.substring(day, 9, 2).alias("day"),
        F.col("block_text").alias("value"),
    )
    # Rebalancing splits a busy day into tasks of even size.
    writer = out.hint("rebalance", "year", "month", "day").write.partitionBy("year", "month", "day").mode(mode)
    writer.option("maxRecordsPerFile", blocks_per_file).text(path)


def archive_blocks(headers: DataFrame, turns: DataFrame, version: int, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row per block: profile_id, session_id, part (turns before it), start_time, block_text.

    ``headers`` may have one row per block, as ``read_archive`` gives them: a session is
    written once, with its newest first header.
    """
    key = ["profile_id", "session_id"]
    numbered = turns.withColumn("slot", F.floor((F.col("pos") - 1) / block_turns)).withColumn("line", turn_line())
    # The window sums at most block_turns rows.
    before = Window.partitionBy(*key, "slot").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    size = F.coalesce(F.sum(F.octet_length("line")).over(before), F.lit(0))
    cut = numbered.select(*key, "slot", F.floor(size / BLOCK_BYTES).alias("cut"), F.struct("pos", "line").alias("x"))
    bodies = cut.groupBy(*key, "slot", "cut").agg(F.array_sort(F.collect_list("x")).alias("x"))
    bodies = bodies.select(*key, (F.get("x", F.lit(0))["pos"] - 1).alias("first"), F.col("x.line").alias("lines"))
    starts = turns.groupBy(*key).agg((F.min("pos") - 1).alias("start"))
    parts = _one_header(headers).join(starts, key, "left").join(bodies, key, "left")
    # The first block of a session counts from 0, whatever place its first turn had.
    parts = parts.withColumn("first", F.when(F.col("first") != F.col("start"), F.col("first")))
    header_line = F.to_json(
        F.struct(
            F.lit(1).alias("v"),
            F.lit(HEADER_TYPE).alias("type"),
            "session_id",
            "start_time",
            "profile_id",
            "source",
            "agent_model",
            "title",
            F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
            F.when(F.col("first") > 0, F.col("first")).alias("first"),
            F.lit(version).cast("long").alias("version"),
            F.lit(uuid.uuid4().hex).alias("write_id"),
        )
    )
    text = F.concat_ws("\n", header_line, F.col("lines"))
    return parts.select(*key, F.coalesce("first", F.lit(0)).alias("part"), "start_time", text.alias("block_text"))


def _one_header(headers: DataFrame) -> DataFrame:
    """The newest header of every session, of its first block."""
    fields = ["start_time", "source", "agent_model", "title", "tags"]
    order = [
        F.col("version") if "version" in headers.columns else F.lit(0),
        F.col("version_file") if "version_file" in headers.columns else F.lit(""),
        -F.col("part") if "part" in headers.columns else F.lit(0),
    ]
    newest = headers.groupBy("profile_id", "session_id").agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("h"))
    return newest.select("profile_id", "session_id", "h.*")


def turn_line() -> Column:
    """JSON of the fixed fields with the extra fields laid flat beside them."""
    fixed = F.to_json(F.struct(*TURN_FIELDS))
    extra = F.col("metadata")
    has_extra = extra.isNotNull() & extra.startswith("{") & ~extra.rlike(r"^\{\s*\}$")
    joined = F.concat(F.regexp_replace(fixed, r"\}$", ","), F.regexp_replace(extra, r"^\{\s*", ""))
    return F.when(has_extra, joined).otherwise(fixed)

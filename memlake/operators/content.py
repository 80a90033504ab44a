"""Archive against store by content: digests of groups first, then the turns of the groups that differ."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.operators.ingest import SESSION_KEY
from memlake.session import settled

# What is compared by default: groups (the folders of a store) and the columns of a turn.
GROUP = ("profile_id", "day")
CONTENT = ("role", "timestamp_ms", "content")
# Up to this number of unequal groups the scans are told which they are.
LITERAL_GROUPS = 200


def row_digest(columns: list[str]) -> list[Column]:
    """Two numbers of 60 bits from the MD5 of some columns; null is not the empty text."""
    named = [F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")) for c in columns]
    digest = F.md5(F.concat(*[F.coalesce(c, F.lit("-")) for c in named]))
    return [F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(20,0)").alias(name) for start, name in ((1, "d1"), (17, "d2"))]


def group_digests(turns: DataFrame, by: tuple[str, ...] = GROUP, columns: tuple[str, ...] = CONTENT) -> DataFrame:
    """Number of turns and sums of their digests per group: equal for equal turns in any order. Partial sums are
    made before the shuffle, so a group that holds most of the rows costs no more than another."""
    rows = turns.select(*by, *row_digest([*SESSION_KEY, "seq", *columns]))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum("d1").alias("d1"), F.sum("d2").alias("d2"))


def unequal_groups(
    archived: DataFrame, stored: DataFrame, by: tuple[str, ...] = GROUP, columns: tuple[str, ...] = CONTENT
) -> DataFrame:
    """Groups whose turns differ between archive and store, with the number of turns in each (0 if it has none)."""
    sides = ((archived, "n_archived", 1), (stored, "n_stored", -1))
    # One side's sums count against the other's: what is left is the difference.
    signed = [
        group_digests(table, by, columns).select(
            *by, *[(F.col("n") if c == name else F.lit(0)).cast("long").alias(c) for _, c, _ in sides], *[(F.col(d) * sign).alias(d) for d in ("d1", "d2")]
        )
        for table, name, sign in sides
    ]
    both = signed[0].unionByName(signed[1]).groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("n_archived", "n_stored", "d1", "d2")])
    differs = (F.col("n_archived") != F.col("n_stored")) | (F.col("d1") != 0) | (F.col("d2") != 0)
    return both.where(differs).select(*by, "n_archived", "n_stored")


def content_differences(
    archived: DataFrame, stored: DataFrame, by: tuple[str, ...] = GROUP, columns: tuple[str, ...] = CONTENT
) -> DataFrame:
    """Turns that archive and store do not have alike: profile_id, session_id, seq, kind, other_profile.

    Kinds: ``changed``, ``regrouped`` (the same content in another group of its profile, another day say),
    ``missing`` (not in the store), ``added`` (not in the archive); where the same turn is missing from one
    profile and added to another it is ``moved`` in the first and ``arrived`` in the second, and ``other_profile`` names the
    other one (the smallest). Only groups with unequal digests are read by turn. A turn that occurs several
    times counts as changed unless both sides have it equally often.
    """
    groups, found = settled(unequal_groups(archived, stored, by, columns).select(*by), LITERAL_GROUPS, "unequal-groups")
    key = [*SESSION_KEY, "seq"]
    sides = []
    for name, table in (("archived", archived), ("stored", stored)):
        group = F.to_json(F.struct(*by)).alias("group")
        rows = _of_groups(table, groups, found, by).select(*key, group, *row_digest(list(columns)), F.lit(name).alias("side"))
        sides.append(rows)
    here = {name: F.col("side") == name for name in ("archived", "stored")}
    figures = [
        agg(F.when(own, F.col(c))).alias(f"{c}_{name}")
        for name, own in here.items()
        for c, agg in (("d1", F.sum), ("d2", F.sum), ("side", F.count), ("group", F.min))
    ]
    turns = sides[0].unionByName(sides[1]).groupBy(*key).agg(*figures)

    def alike(*names: str) -> Column:
        return reduce(Column.__and__, [F.col(f"{c}_archived").eqNullSafe(F.col(f"{c}_stored")) for c in names])

    same = alike("d1", "d2", "side")
    kind = (
        F.when(F.col("side_stored") == 0, "missing").when(F.col("side_archived") == 0, "added")
        .when(~same, "changed").when(~alike("group"), "regrouped")
    )
    differing = turns.withColumn("kind", kind).where(F.col("kind").isNotNull())
    content = [F.coalesce(f"{d}_archived", f"{d}_stored").alias(d) for d in ("d1", "d2")]
    single = F.col("kind").isin("missing", "added")
    # Changed turns look for no partner: they are spread by their own profile.
    differing = differing.select(*key, "kind", *content, F.when(~single, F.col("profile_id")).alias("own"))
    alike_turns = Window.partitionBy("session_id", "seq", "d1", "d2", "own")
    target, origin = (F.min(F.when(F.col("kind") == k, F.col("profile_id"))).over(alike_turns) for k in ("added", "missing"))
    partner = F.when(F.col("kind") == "missing", target).when(F.col("kind") == "added", origin)
    named = differing.select(*key, "kind", partner.alias("other_profile"))
    moved = F.when(F.col("kind") == "missing", "moved").otherwise("arrived")
    return named.withColumn("kind", F.when(F.col("other_profile").isNotNull(), moved).otherwise(F.col("kind")))


def _of_groups(table: DataFrame, groups: DataFrame, rows: list[dict] | None, by: tuple[str, ...]) -> DataFrame:
    """Rows of some groups; a scan of a table that lies in folders by group leaves out all others."""
    if rows is None:
        named = groups.select(*[F.col(c).alias(f"_{c}") for c in by])
        return table.join(named, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]), "left_semi")
    *leading, last = by
    values: dict[tuple, list] = {}
    for row in rows:
        values.setdefault(tuple(row[c] for c in leading), []).append(row[last])
    condition = F.lit(False)
    for names, own in values.items():
        named = F.col(last).isin([v for v in own if v is not None]) | (F.lit(None in own) & F.col(last).isNull())
        for c, name in zip(leading, names):
            named = named & F.col(c).eqNullSafe(F.lit(name))
        condition = condition | named
    return table.where(condition)

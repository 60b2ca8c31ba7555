"""How often subjects share a group (a cluster of any instrument)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import join_on_keys
from ..session import written
from .cohort import SUBJECT

#: Profiles of a group that one task pairs with as many others.
TILE = 4096


def membership_profiles(members: DataFrame, group: str = "group_id", subject: str = SUBJECT) -> DataFrame:
    """The set of groups of each subject: ``(subject, profile)``.

    A subject belongs to few groups (at most one cluster per instrument and
    run), so the collected set is small whatever the group sizes are.
    """
    return members.groupBy(subject).agg(F.array_sort(F.collect_set(group)).alias("profile"))


def cooccurrence(members: DataFrame, known: DataFrame | None = None, group: str = "group_id",
                 subject: str = SUBJECT) -> DataFrame:
    """The symmetric co-occurrence matrix between profiles of group membership:
    ``(profile_a, profile_b, subjects_a, subjects_b, n)``.

    Two subjects share exactly the groups their profiles share, so subjects of
    one profile have equal rows in the matrix.  The matrix over profiles plus
    ``membership_profiles`` is therefore the whole subject matrix without loss,
    and no pair of subjects is ever formed: a group holding a third of all
    subjects contributes as many rows as it has distinct profiles.  The
    diagonal entry of a profile counts its different subjects' shared groups;
    a subject with itself counts 0, so a profile of one subject has none.
    Subjects outside ``known`` are ignored.
    """
    if known is not None:
        members = members.join(known.select(subject), subject, "left_semi")
    sizes = membership_profiles(members, group, subject).groupBy("profile").agg(F.count("*").alias("subjects"))
    flat = sizes.select("profile", "subjects", F.explode("profile").alias("_g"))
    return _shared(flat, flat)


def _tiled(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with the tiles ``_ta`` and ``_tb`` in which they meet.

    A group of more than TILE profiles is cut into tiles by a hash of the
    profile.  A left profile is repeated for each tile of the right side and a
    right one for each of the left, so every pair meets once, in the pair of
    their tiles, and a task holds about TILE profiles a side.  Groups up to TILE
    are one tile and nothing is repeated.
    """
    def cut(side, sizes, own, other):
        at = join_on_keys(side, sizes, ["_g"])
        return at.select("_g", "profile", "subjects", F.pmod(F.xxhash64("profile"), F.col(f"_n{own}")).alias(f"_t{own}"),
                         F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"_n{other}") - 1)).alias(f"_t{other}"))

    tiles = lambda side, name: side.groupBy("_g").agg(F.ceil(F.count("*") / TILE).alias(name))
    sizes = written(tiles(left, "_na").join(tiles(right, "_nb"), "_g"), "tiles")
    return cut(left, sizes, "a", "b"), cut(right, sizes, "b", "a")


def _shared(left: DataFrame, right: DataFrame) -> DataFrame:
    """Shared groups of the profiles of two exploded tables ``(profile, subjects, _g)``."""
    left, right = _tiled(left, right)
    at = ["_g", "_ta", "_tb"]
    a = left.select(*at, F.col("profile").alias("profile_a"), F.col("subjects").alias("subjects_a"))
    b = right.select(*at, F.col("profile").alias("profile_b"), F.col("subjects").alias("subjects_b"))
    return a.join(b, at).where((F.col("profile_a") != F.col("profile_b")) | (F.col("subjects_a") > 1)).groupBy(
        "profile_a", "profile_b", "subjects_a", "subjects_b").agg(F.count("*").alias("n"))


def cooccurrence_rows(members: DataFrame, wanted: DataFrame, group: str = "group_id",
                      subject: str = SUBJECT) -> DataFrame:
    """Matrix rows of chosen subjects: ``(subject, other, n)`` with n > 0; only
    the rows of their profiles are formed."""
    profiles = membership_profiles(members, group, subject)
    chosen = profiles.join(wanted.select(subject).distinct(), subject)
    sizes = profiles.groupBy("profile").agg(F.count("*").alias("subjects"))
    flat = sizes.select("profile", "subjects", F.explode("profile").alias("_g"))
    matrix = _shared(flat.join(chosen.select("profile").distinct(), "profile", "left_semi"), flat)
    mine = chosen.withColumnRenamed("profile", "profile_a")
    others = profiles.select(F.col(subject).alias("other"), F.col("profile").alias("profile_b"))
    return (mine.join(matrix.select("profile_a", "profile_b", "n"), "profile_a")
            .join(others, "profile_b").filter(F.col(subject) != F.col("other")).select(subject, "other", "n"))


def cooccurrence_totals(members: DataFrame, group: str = "group_id", subject: str = SUBJECT) -> DataFrame:
    """Row sums of the subject matrix: how many memberships each subject shares
    with others."""
    distinct = members.select(group, subject).distinct()
    sizes = distinct.groupBy(group).agg(F.count("*").alias("_size"))
    return distinct.join(sizes, group).groupBy(subject).agg(F.sum(F.col("_size") - 1).alias("shared"))

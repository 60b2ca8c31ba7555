"""Build the analytic tables: cohort, instrument levels, views, snapshots."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators import cohort, views
from ..operators.levels import LevelConfig, build_levels
from ..session import written
from ..sources.writers import save_snapshot, save_tables


@dataclass
class Dataset:
    """Lazy results of a build."""

    demographics: DataFrame
    levels: dict[str, DataFrame]
    longitudinal: DataFrame
    cross_sections: dict[str, DataFrame]
    order: tuple[str, ...] = ("_ord",)

    def computed_once(self) -> Dataset:
        """The same with every level written to the shared folder, and the views
        derived from the written levels: for queries that read both views."""
        levels = {n: written(df, "level") for n, df in self.levels.items()}
        return replace(self, levels=levels, longitudinal=longitudinal_index(levels),
                       cross_sections=views.cross_sections(levels, self.order))

    def save(self, folder: str) -> DataFrame:
        """Parquet snapshots of every part under one folder, and the rows and
        subjects of each: ``(stage, instrument, observations, subjects)``, zeros
        for a part without rows.

        A level is computed once, when it is written; the longitudinal index and
        the cross-sections are derived from the written levels, and the inner and
        outer wide tables from the written cross-sections.
        """
        read = self.demographics.sparkSession.read.parquet
        save_snapshot(self.demographics, f"{folder}/demographics")
        levels = {n: read(p) for n, p in save_tables(self.levels, f"{folder}/levels").items()}
        save_snapshot(longitudinal_index(levels), f"{folder}/longitudinal", ["instrument"])
        sections = {n: read(p) for n, p in save_tables(
            views.cross_sections(levels, self.order), f"{folder}/cross_section").items()}
        stages = {"level": levels, "cross_section": sections}
        if sections:
            inner, outer = wide_tables(sections)
            stages["wide"] = {"wide": read(save_snapshot(inner, f"{folder}/wide"))}
            stages["outer_wide"] = {"outer_wide": read(save_snapshot(outer, f"{folder}/outer_wide"))}
        stages["demographics"] = {"demographics": read(f"{folder}/demographics").withColumnRenamed(
            "gui", cohort.SUBJECT)}
        counts = [df.agg(F.count("*").alias("observations"), F.count_distinct(cohort.SUBJECT).alias("subjects")).select(
            F.lit(stage).alias("stage"), F.lit(name).alias("instrument"), "observations", "subjects")
            for stage, tables in stages.items() for name, df in tables.items()]
        return reduce(DataFrame.unionByName, counts)


def longitudinal_index(levels: Mapping[str, DataFrame]) -> DataFrame:
    """Observations over all levels; the merged schedule table stays out, so
    that its single modules count."""
    observed = views.stack({n: df for n, df in levels.items() if n != "ados"}, ["interview_age", "interview_date"])
    return views.longitudinal(observed)


def wide_tables(sections: Mapping[str, DataFrame], subject: str = cohort.SUBJECT) -> tuple[DataFrame, DataFrame]:
    """Inner and outer wide table of cross-sections, ``_`` helpers left out.
    In the outer one the schedule's features, and those of every instrument that
    shares a name with another, carry the instrument's name."""
    plain = {n: df.drop(*[c for c in df.columns if c.startswith("_")]) for n, df in sections.items()}
    holders: dict[str, list[str]] = {}
    for name, df in plain.items():
        for c in df.columns:
            if c != subject and not re.search(views.NOT_A_FEATURE, c):
                holders.setdefault(c.lower(), []).append(name)
    shared = {name for names in holders.values() if len(names) > 1 for name in names}
    return (views.wide_inner(plain, subject),
            views.wide_outer(plain, subject, [n for n in plain if n in shared or n == "ados"]))


def build_dataset(tables: Mapping[str, DataFrame], phenotypes: DataFrame, config: LevelConfig,
                  pattern: str | None = None, exception_pattern: str | None = None,
                  phenotype_order: Sequence[str] = ("_ord",)) -> Dataset:
    """Select the cohort, restrict every instrument table to it, build the
    levels and derive the longitudinal index and the cross-sections.

    The merged schedule table stays out of the longitudinal index, so that its
    single modules count; single modules stay out of the cross-sections.
    """
    selected = cohort.select_phenotype(phenotypes, pattern, exception_pattern, order=phenotype_order)
    restricted = {name: cohort.restrict(df, selected) for name, df in tables.items()}
    levels = build_levels(restricted, config)
    return Dataset(
        demographics=cohort.demographics(selected),
        levels=levels,
        longitudinal=longitudinal_index(levels),
        cross_sections=views.cross_sections(levels, config.order),
        order=tuple(config.order),
    )

"""From item answers to subscales and scales: level maps and the per-instrument
level tables built with them."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import columns as X
from ..functions.columns import col
from . import clean
from .clean import ORDER
from .cohort import SUBJECT, exclude_listed

OBSERVATION = (SUBJECT, "interview_age", "interview_date")
MAX_CODEBOOK_ROWS = 100_000


@dataclass(frozen=True)
class LevelMap:
    """Items, their subscales and scales, and the items' maximum scores."""

    items: tuple[str, ...]
    subscales: Mapping[str, tuple[str, ...]]
    scales: Mapping[str, tuple[str, ...]]
    max_scores: Mapping[str, float] | None = field(default=None)


def codebook_name(file_name: str) -> str:
    """Instrument a codebook is for: the third ``_`` part of its file name."""
    return file_name.rsplit("/", 1)[-1].split("_")[2]


def codebook_subscales(codebook: DataFrame) -> DataFrame:
    """Per subscale: number of items and the highest reachable sum.  Codebook
    columns: item, max_score, subscale, scale, position."""
    return codebook.groupBy("subscale").agg(F.count("*").alias("n_items"), F.sum("max_score").alias("max_total"))


def codebook_scales(codebook: DataFrame) -> DataFrame:
    """The distinct subscales of each scale, one row each."""
    return codebook.select("scale", "subscale").distinct()


def level_map(codebook: DataFrame, scaling: bool = True) -> LevelMap:
    """Level map of one instrument's codebook.

    A codebook is configuration (one row per questionnaire item); it is read to
    the driver behind a row limit so that scores become plain column expressions.
    """
    rows = codebook.select("item", "max_score", "subscale", "scale", "position").limit(MAX_CODEBOOK_ROWS + 1).collect()
    if len(rows) > MAX_CODEBOOK_ROWS:
        raise ValueError(f"a codebook has at most {MAX_CODEBOOK_ROWS} rows")
    rows.sort(key=lambda r: r["position"])
    subscales, scales = {}, {}
    for r in rows:
        subscales.setdefault(r["subscale"], []).append(r["item"])
        members = scales.setdefault(r["scale"], [])
        if r["subscale"] not in members:
            members.append(r["subscale"])
    return LevelMap(
        items=tuple(r["item"] for r in rows),
        subscales={k: tuple(v) for k, v in subscales.items()},
        scales={k: tuple(v) for k, v in scales.items()},
        max_scores={r["item"]: float(r["max_score"]) for r in rows} if scaling else None,
    )


# ---- scoring ----------------------------------------------------------------

def score_subscales(df: DataFrame, levels: LevelMap) -> DataFrame:
    """Add the subscale scores; a subscale none of whose items exist is NULL."""
    scores = {}
    for name, items in levels.subscales.items():
        present = [i for i in items if i in df.columns]
        scores[name] = X.subscale_score(present, levels.max_scores) if present else F.lit(None).cast("double")
    return df.withColumns(scores)


def score_scales(df: DataFrame, levels: LevelMap) -> DataFrame:
    averaged = levels.max_scores is not None
    return df.withColumns({name: X.scale_score(subs, averaged) for name, subs in levels.scales.items()})


def add_period(df: DataFrame) -> DataFrame:
    return df.withColumn("interview_period", X.age_period("interview_age"))


def _level_columns(df, items, levels, order):
    kept = [c for c in order if c not in OBSERVATION and c not in items]
    return df.select(*OBSERVATION, "interview_period", *items, *levels.subscales, *levels.scales, *kept)


# ---- instrument level tables ------------------------------------------------

def adi_levels(df: DataFrame, levels: LevelMap, recode: int | None = 3, order: Sequence[str] = ORDER) -> DataFrame:
    """Interview levels: recoded items, subscales, scales and age period.

    ``order`` columns are kept, so that the first and last rows stay defined.
    """
    items = [i for i in levels.items if i in df.columns]
    rows = clean.drop_uninformative(clean.recode_items(df, items, recode), items)
    rows = clean.drop_repeats(rows, items, order=order)
    return _level_columns(add_period(score_scales(score_subscales(rows, levels), levels)), items, levels, order)


def merge_equal_features(tables: Mapping[str, DataFrame], items: Sequence[str],
                         keep: Sequence[str] = OBSERVATION) -> dict[str, DataFrame]:
    """Stack tables that have the same set of items, under the first one's name."""
    wanted = set(items)
    groups: dict[tuple, list[str]] = {}
    for name, df in tables.items():
        groups.setdefault(tuple(sorted(wanted.intersection(df.columns))), []).append(name)
    return {
        names[0]: reduce(DataFrame.unionByName, [
            tables[n].select(*dict.fromkeys(keep), *[X.number(c).alias(c) for c in shared if c not in keep])
            for n in names])
        for shared, names in groups.items()
    }


def ados_levels(tables: Mapping[str, DataFrame], levels: LevelMap, renames: Mapping[str, str] | None = None,
                recode: int | None = 3, order: Sequence[str] = ORDER) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Schedule levels over modules and editions: one table of subscales and
    scales for all, and one item table per group of equal item sets."""
    renamed = {n: clean.rename(df, renames or {}) for n, df in tables.items()}
    merged = merge_equal_features(renamed, levels.items, keep=(*OBSERVATION, *order))
    built = {n: adi_levels(df, levels, recode, order) for n, df in merged.items()}
    kept = [c for c in order if c not in OBSERVATION and c not in levels.items]
    upper = [*OBSERVATION, "interview_period", *levels.subscales, *levels.scales, *kept]
    both = reduce(DataFrame.unionByName, [df.select(*upper) for df in built.values()])
    items = {n: df.select(*OBSERVATION, "interview_period", *[i for i in levels.items if i in df.columns], *kept)
             for n, df in built.items()}
    return both, items


def mullen_levels(df: DataFrame, scores: Sequence[str], order: Sequence[str] = ORDER,
                  mode: str = "current") -> DataFrame:
    """Early-learning levels: recoded standard scores and age period.

    ``older``: 999 marks missing, floor scores stay, and an uninformative row
    removes its subject.
    """
    current = mode == "current"
    rows = clean.recode(df, scores, lambda c: X.recode_scale_score(c, 777 if current else 999))
    if current:
        rows = clean.drop_floor_scores(rows, scores)
    rows = clean.drop_uninformative(rows, scores, mode="row" if current else "subject")
    rows = add_period(clean.drop_repeats(rows, scores, order=order))
    kept = [c for c in order if c not in OBSERVATION and c not in scores]
    return rows.select(*OBSERVATION, "interview_period", *scores, *kept)


def _versions(tables, wanted, prepare, order):
    """Prepared versions stacked; a column some versions lack is NULL there."""
    parts = [clean.keep_listed(prepare(df), wanted, always=tuple(dict.fromkeys((*OBSERVATION, *order))))
             for df in tables.values()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _informant_levels(rows, wanted, order, mode):
    informant, features = wanted[0], [c for c in wanted[1:] if c in rows.columns]
    rows = clean.drop_uninformative(rows, features, mode="row" if mode == "current" else "subject")
    return add_period(clean.drop_repeats(rows, features, informant=informant, order=order))


def vineland_levels(tables: Mapping[str, DataFrame], columns: Sequence[str], twins: Mapping[str, str],
                    excluded_subjects: Sequence = (), order: Sequence[str] = ORDER,
                    mode: str = "current") -> DataFrame:
    """Adaptive-behaviour levels over versions; ``columns[0]`` is the informant."""
    rows = _versions(tables, columns, lambda df: clean.merge_twins(df, twins), order)
    present = [c for c in columns if c in rows.columns]
    rows = clean.recode(rows, present, lambda c: X.recode_adaptive(c, columns[0], mode))
    rows = exclude_listed(rows, excluded_subjects)
    return _informant_levels(rows, columns, order, mode)


def srs_levels(tables: Mapping[str, DataFrame], columns: Sequence[str], twins: Mapping[str, str],
               renames: Mapping[str, str], order: Sequence[str] = ORDER, mode: str = "current") -> DataFrame:
    """Social-responsiveness levels over versions; ``columns[0]`` is the
    respondent.  ``older`` ends with one row per respondent."""
    def prepare(df):
        filled = {a: b for a, b in twins.items() if a in df.columns and b in df.columns}
        df = clean.rename(clean.merge_twins(df, filled), renames)
        return clean.recode_tokens(df, [c for c in columns if c in df.columns], columns[0], mode)
    rows = _versions(tables, columns, prepare, order)
    rows = _informant_levels(rows, columns, order, mode)
    return clean.one_per_respondent(rows, columns[0], order) if mode == "older" else rows


def data_levels(df: DataFrame, levels: LevelMap, recode: int | None = None, order: Sequence[str] = ORDER,
                extra: Sequence[str] = ("sex", "phenotype", "site")) -> dict[str, DataFrame]:
    """Three linked tables (items, subscales, scales), keeping only rows in
    which every subscale with items in the table has an answer; uninformative
    rows remove their subject."""
    items = [i for i in levels.items if i in df.columns]
    rows = clean.drop_uninformative(clean.recode_items(df, items, recode), items, mode="subject")
    rows = score_subscales(clean.drop_repeats(rows, items, order=order), levels)
    present = [n for n, members in levels.subscales.items() if any(i in df.columns for i in members)]
    rows = score_scales(rows.filter(X.row_count(present) == len(present)), levels)
    base = [SUBJECT, "interview_age", *extra, *[c for c in order if c not in items]]
    return {
        "level-1": rows.select(*base, *items),
        "level-2": rows.select(*base, *levels.subscales),
        "level-3": rows.select(*base, *levels.scales),
    }


# ---- routing ----------------------------------------------------------------

@dataclass(frozen=True)
class LevelConfig:
    """What the level builders of each instrument family need."""

    level_maps: Mapping[str, LevelMap] = field(default_factory=dict)
    ados_renames: Mapping[str, str] = field(default_factory=dict)
    mullen_scores: Sequence[str] = ()
    vineland_columns: Sequence[str] = ()
    vineland_twins: Mapping[str, str] = field(default_factory=dict)
    vineland_excluded: Sequence = ()
    srs_columns: Sequence[str] = ()
    srs_twins: Mapping[str, str] = field(default_factory=dict)
    srs_renames: Mapping[str, str] = field(default_factory=dict)
    order: Sequence[str] = ORDER


def build_levels(tables: Mapping[str, DataFrame], config: LevelConfig) -> dict[str, DataFrame]:
    """Level table of each instrument family found among the table names.

    A family is recognized by its name's start; tables of one family are built
    together, and the schedule family also yields its item tables.
    """
    def family(prefix):
        return {n: df for n, df in tables.items() if re.match(prefix, n)}

    builders: dict[str, Callable] = {
        "adi": lambda t: {"adi": adi_levels(
            reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), t.values()),
            config.level_maps["adi"], order=config.order)},
        "ados": lambda t: _with_items(*ados_levels(t, config.level_maps["ados"], config.ados_renames,
                                                   order=config.order)),
        "mullen": lambda t: {"mullen": mullen_levels(
            reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), t.values()),
            config.mullen_scores, config.order)},
        "srs": lambda t: {"srs": srs_levels(t, config.srs_columns, config.srs_twins, config.srs_renames,
                                            config.order)},
        "vineland": lambda t: {"vineland": vineland_levels(t, config.vineland_columns, config.vineland_twins,
                                                           config.vineland_excluded, config.order)},
    }
    out: dict[str, DataFrame] = {}
    for prefix, build in builders.items():
        found = family(prefix)
        if found:
            out.update(build(found))
    return out


def _with_items(both, items):
    return {"ados": both, **items}

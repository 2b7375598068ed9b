"""Feature profiles of one subject table: correlations and distributions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from cohortry.functions.columns import col
from cohortry.operators import clean, profile
from cohortry.sources.tables import resolve_features


def numeric_features(df: DataFrame, id_col: str, names: list[str]) -> tuple[DataFrame, list[str]]:
    """Requested columns that exist, sentinels removed, as doubles beside the id."""
    features = resolve_features(df, names, strict=True)
    kept = df.select(col(id_col), *[col(c) for c in features])
    return clean.coerce_numeric(clean.replace_sentinels(kept, features), features), features


@dataclass
class Correlations:
    matrix: DataFrame
    top: DataFrame
    tests: DataFrame


def correlations(df: DataFrame, id_col: str, names: list[str], k: int = 10) -> Correlations:
    """Spearman matrix of the complete rows, its largest entries, and rho, t, p of every pair."""
    numbers, features = numeric_features(df, id_col, names)
    matrix = profile.spearman_matrix(clean.drop_incomplete(numbers, features), id_col, features)
    return Correlations(matrix, profile.top_correlations(matrix, k),
                        profile.spearman_test(matrix, profile.feature_pairs(df, features)))


@dataclass
class Distributions:
    missing: DataFrame
    skewness: DataFrame
    bins: DataFrame


def distributions(df: DataFrame, id_col: str, names: list[str], bins: int = 30) -> Distributions:
    """Missing values of the raw features; skewness and histograms of the complete rows."""
    numbers, features = numeric_features(df, id_col, names)
    complete = clean.drop_incomplete(numbers, features)
    return Distributions(clean.na_profile(numbers, features), profile.skew_profile(complete, features),
                         profile.histogram(complete, features, bins))

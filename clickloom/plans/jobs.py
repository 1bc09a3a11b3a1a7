"""The four jobs as plans over the operators; nothing is collected."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from clickloom.operators import areas, funnel, sessions, topn
from clickloom.params import TaskParams
from clickloom.sources.tables import between_dates


@dataclass(frozen=True)
class SessionReport:
    filtered: DataFrame
    statistics: DataFrame
    ratios: DataFrame
    sample: DataFrame
    sample_details: DataFrame
    top_categories: DataFrame
    top_sessions: DataFrame
    top_session_details: DataFrame


def session_analysis(actions: DataFrame, users: DataFrame, p: TaskParams, sample: int = 100, categories: int = 10, per_category: int = 10) -> SessionReport:
    """Sessions that meet the conditions, and what is derived from them; persist `filtered` to share it among actions."""
    own = between_dates(actions, p.start_date, p.end_date)
    kept = sessions.session_filter(sessions.with_users(sessions.session_aggregate(own), users), p)
    of_kept = sessions.details(own, kept)
    counts = sessions.session_statistics(kept)
    picked = sessions.stratified_sample(kept, sample)
    top = topn.top_categories(topn.category_counts(of_kept), categories)
    best = topn.top_sessions(topn.category_session_counts(of_kept, top), per_category)
    return SessionReport(kept, counts, sessions.session_ratios(counts), picked, sessions.details(own, picked), top, best, sessions.details(of_kept, best))


def page_conversion(actions: DataFrame, p: TaskParams) -> DataFrame:
    return funnel.conversion(between_dates(actions, p.start_date, p.end_date), p.page_flow)


def area_top_products(clicks: DataFrame, cities: DataFrame, products: DataFrame, p: TaskParams | None = None, n: int = 3, levels=areas.LEVELS) -> DataFrame:
    own = between_dates(clicks, p.start_date, p.end_date) if p else clicks
    counts = areas.area_product_counts(areas.with_cities(own.where("product_id IS NOT NULL"), cities))
    return areas.top_products(areas.with_products(counts, products), n, levels)

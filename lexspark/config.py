"""Limits and weights; every one can be replaced with ``dataclasses.replace``."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # Index.
    docs_per_chunk: int = 30_000
    token_limit: int = 20  # a token of this many characters or more is skipped
    title_limit: int = 50
    abstract_limit: int = 100
    abstract_from: int = 5
    # Query.
    query_limit: int = 40
    per_chunk: int = 999
    shortest_url: int = 10
    top: int = 30
    page: int = 10
    # Weights.
    static_weight: int = 10
    dynamic_weight: int = 10
    dynamic_some_rare: int = 12
    dynamic_most_rare: int = 15
    rare_multiplier: int = 100_000
    most: float = 0.6
    some: float = 0.3
    short_url: int = 40
    short_url_weight: int = 30
    short_title: int = 6
    short_title_weight: int = 30
    tld_bonus: bool = False
    url_home: int = 250
    url_word: int = 70
    title_ladder: tuple[tuple[float, int], ...] = ((1.0, 250), (0.74, 90), (0.49, 70), (0.24, 35), (0.05, 10))
    span_cap: int = 20
    near: int = 3
    near_top: int = 100
    frequency_ladder: tuple[tuple[float, int], ...] = ((0.6, 10), (0.3, 5))
    frequency_all: int = 15
    # Crawl.
    links_per_page: int = 1000
    host_cap: int = 10_000
    redirects: int = 5
    redirect_length: int = 200
    pick_group: int = 3
    pick_count: int = 400
    frontier_limit: int = 1_000_000


DEFAULT = Config()

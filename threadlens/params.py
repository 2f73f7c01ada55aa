"""Operator parameters (the reference's config file, as a frozen dataclass)."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    memo_ttl_hours: int = 24
    max_comments: int | None = None  # root limit (FL1) and pre-filter size (RK2); None: the whole thread
    quality_threshold: float = 2.0   # RK3; the reference's function default is 5.0
    batch_size: int = 20             # EN1
    max_depth: int | None = None     # TR1: depth of the last replies that are followed; None: any depth
    comment_order: str = "source"    # TR3: sibling order for the root limit and pre-order: source | new | top
    gallery_images: int | None = None      # TX1: images of a gallery that are read; None: all
    article_cut: int | None = None         # TX1: characters of a linked article; None: whole
    report_top_k: int = 10           # RK4 in the report
    markdown_top_k: int = 5          # RK4 in the Markdown rendering
    markdown_body_cut: int | None = None   # REP1: characters of a comment; None: whole
    themes_top_k: int = 5            # AG4
    # PL3: partitions feeding a Python annotator, i.e. at most this many concurrent model
    # calls (the reference used 3). None keeps Spark's partitioning (no cap).
    max_concurrent_calls: int | None = None


DEFAULT = Params()

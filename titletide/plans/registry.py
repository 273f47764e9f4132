"""Every registered query: name -> function of (spark, sf_dir)."""

from __future__ import annotations

from titletide.plans import (listing_queries, match_queries, mention_queries, money_queries, price_queries,
                             source_queries, stream_queries, title_queries)

ALL = {**price_queries.QUERIES, **mention_queries.QUERIES, **listing_queries.QUERIES, **money_queries.QUERIES,
       **title_queries.QUERIES, **match_queries.QUERIES,
       **stream_queries.QUERIES, **source_queries.QUERIES}

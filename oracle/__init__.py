"""SQL twins of the registered queries, for checking results on the same tables with another engine."""

from oracle import listings, matching, mentions, money, prices, sources, streams, titles


def all_sql() -> dict[str, str]:
    return {**prices.SQL, **mentions.SQL, **listings.SQL, **money.SQL, **titles.SQL, **matching.SQL, **streams.SQL, **sources.SQL}

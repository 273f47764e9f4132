"""Explicit schemas of the tables the engine reads and writes."""

ITEMS = """headline STRING, source STRING, source_type STRING, feed STRING, link STRING, matched_game STRING,
matched_games ARRAY<STRING>, match_score INT, match_method STRING, matched_in STRING, is_remaster_rumor BOOLEAN,
is_digital_only BOOLEAN, sentiment INT, hype INT, views BIGINT, ts TIMESTAMP_NTZ"""

ENTRIES = """feed_title STRING, source_type STRING, source_name STRING, feed STRING, title STRING, link STRING,
comments STRING, id STRING, summary STRING, content ARRAY<STRUCT<value: STRING>>, tags ARRAY<STRUCT<term: STRING>>,
enclosures ARRAY<STRUCT<href: STRING>>, views STRING, published TIMESTAMP_NTZ, updated TIMESTAMP_NTZ, position INT,
fetched TIMESTAMP_NTZ"""

THREAD = """no BIGINT, time BIGINT, replies INT, images INT, sub STRING, com STRING, sticky INT,
last_replies ARRAY<STRUCT<no: BIGINT, time: BIGINT, com: STRING>>"""

LISTING = """itemId STRING, legacyItemId STRING, title STRING, price STRUCT<value: STRING, currency: STRING>,
shippingOptions ARRAY<STRUCT<shippingCost: STRUCT<value: STRING, currency: STRING>>>, condition STRING,
itemCreationDate STRING, itemWebUrl STRING"""

HISTORY = "stamp TIMESTAMP_NTZ, title STRING, site STRING, copies INT, lowest DOUBLE, median DOUBLE"

ARCHIVE = "d TIMESTAMP_NTZ, g STRING, h STRING, s STRING, t STRING, n INT, r BOOLEAN, m STRING, month STRING"

DIGITAL = "d TIMESTAMP_NTZ, h STRING, s STRING, t STRING, l STRING, month STRING"

"""Independent DuckDB SQL for the correctness gate.

``PRELUDE`` builds the logical inputs from the driver's generic tables exactly as
``clientele.sources.fixtures`` does with DataFrames (FIXTURES.md section 2); each query's
oracle appends its own CTEs and a final SELECT.
"""

from __future__ import annotations

# Driver-query parameters (FIXTURES.md section 2): wider than the library defaults so
# sessions and as-of matches are non-trivial on the synthetic stream.
SESSION_S = 86400
TOLERANCE_S = 21600
DAYS_IN_TARGET = 5
PROP_SKU_N = 20
PROP_CAT_N = 10

PRELUDE = f"""
WITH
ev AS (
  SELECT user_id AS client_id, ts AS "timestamp", event_type AS _kind,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS _k
  FROM events),
vf AS (
  SELECT vec_id, label, list_transform(range(0, 16), lambda i: (embedding[4*i+1]::DOUBLE + embedding[4*i+2]::DOUBLE + embedding[4*i+3]::DOUBLE + embedding[4*i+4]::DOUBLE) / 4.0) AS folded FROM embeddings),
vt AS (
  SELECT vec_id, label,
         '[' || array_to_string(list_transform(folded,
               lambda x: CAST(floor((x + 1.0) * 127.5) AS INTEGER)), ' ') || ']' AS vtext
  FROM vf),
product_buy AS (SELECT client_id, "timestamp", _k AS sku FROM ev WHERE _kind = 'purchase'),
add_to_cart AS (SELECT client_id, "timestamp", _k AS sku FROM ev WHERE _kind = 'click'),
remove_from_cart AS (SELECT client_id, "timestamp", _k AS sku FROM ev WHERE _kind = 'error'),
page_visit AS (SELECT client_id, "timestamp", _k AS url FROM ev WHERE _kind = 'view'),
search_query AS (
  SELECT e.client_id, e."timestamp", v.vtext AS query
  FROM ev e LEFT JOIN vt v ON v.vec_id = e._k + 100 WHERE e._kind = 'signup'),
product_properties AS (
  SELECT p.p_partkey AS sku, CAST(regexp_extract(p.p_brand, '[0-9]+') AS BIGINT) AS category,
         CAST(p.p_size AS BIGINT) AS price, v.vtext AS name
  FROM part p LEFT JOIN vt v ON v.vec_id = p.p_partkey % (SELECT count(*) FROM embeddings)),
relevant_clients AS (
  SELECT DISTINCT client_id FROM ev WHERE _kind = 'view' AND "timestamp" >= (SELECT max("timestamp") FROM ev) - INTERVAL 2 DAY),
name_clusters AS (
  SELECT vec_id AS sku, CAST(label AS BIGINT) AS cluster_id FROM embeddings),
query_cluster_of_text AS (
  SELECT vtext AS query, CAST(min(label) AS BIGINT) AS cluster_id FROM vt GROUP BY vtext),
products AS (
  SELECT client_id, "timestamp", sku, 'product_buy' AS event_type FROM product_buy
  UNION ALL SELECT client_id, "timestamp", sku, 'add_to_cart' FROM add_to_cart
  UNION ALL SELECT client_id, "timestamp", sku, 'remove_from_cart' FROM remove_from_cart),
split AS (
  SELECT date_trunc('day', max("timestamp") - INTERVAL {2 * DAYS_IN_TARGET - 1} DAY) AS train_start,
         date_trunc('day', max("timestamp") - INTERVAL {2 * DAYS_IN_TARGET - 1} DAY)
           + INTERVAL {DAYS_IN_TARGET} DAY AS val_start,
         max("timestamp") AS end_ts
  FROM product_buy),
input_buys AS (SELECT b.* FROM product_buy b, split s WHERE b."timestamp" < s.train_start),
active_clients AS (SELECT DISTINCT client_id FROM input_buys),
propensity_sku AS (
  SELECT sku AS item, CAST(row_number() OVER (ORDER BY count(*) DESC, sku) AS INTEGER) AS pos
  FROM input_buys GROUP BY sku ORDER BY count(*) DESC, sku LIMIT {PROP_SKU_N}),
propensity_category AS (
  SELECT p.category AS item,
         CAST(row_number() OVER (ORDER BY count(*) DESC, p.category) AS INTEGER) AS pos
  FROM input_buys b JOIN product_properties p USING (sku)
  GROUP BY p.category ORDER BY count(*) DESC, p.category LIMIT {PROP_CAT_N}),
client_factors AS (
  SELECT c.client_id, e.folded AS factors
  FROM (SELECT DISTINCT client_id FROM ev
        WHERE _kind = 'purchase' AND "timestamp" < (SELECT min("timestamp") FROM ev) + INTERVAL 3 DAY) c
  JOIN vf e ON e.vec_id = c.client_id % (SELECT count(*) FROM embeddings)),
item_factors AS (
  SELECT p.p_partkey AS item, e.folded AS factors
  FROM part p JOIN vf e ON e.vec_id = (p.p_partkey + 100) % (SELECT count(*) FROM embeddings)
  WHERE p.p_size <= 45),
category_factors AS (
  SELECT item, list(f ORDER BY k) AS factors FROM (
    SELECT p.category AS item, r.k, avg(i.factors[r.k]) AS f
    FROM item_factors i JOIN product_properties p ON p.sku = i.item, range(1, 17) r(k) GROUP BY p.category, r.k)
  GROUP BY item)
"""


def sql(body: str, recursive: bool = False) -> str:
    """``PRELUDE`` + extra CTEs/final select. ``body`` starts with ``, name AS (...)`` or
    directly with ``SELECT``."""
    b = body.strip()
    pre = PRELUDE.replace("WITH\n", "WITH RECURSIVE\n", 1) if recursive else PRELUDE
    if b.startswith(","):
        return pre + b
    return pre + "\n" + b

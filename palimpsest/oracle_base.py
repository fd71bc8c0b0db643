"""The derived memory as DuckDB common table expressions, written apart from the DataFrame version."""

from __future__ import annotations

BASE = """
ord AS (
    SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS st, o_orderpriority AS pr, o_orderdate AS d, 'default' AS sp, '' AS pre FROM orders
    UNION ALL
    SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_orderdate, 'other', 'o:' FROM orders WHERE o_orderkey % 50 = 0
),
ep AS MATERIALIZED (
    SELECT concat(pre, 'ep:order:', k) AS id, sp AS space_id, 'order' AS kind, concat('order ', k, ' status ', st, ' priority ', pr) AS content,
           concat(pre, 'src:orders:', pr) AS source_id, concat('segment:', c_mktsegment) AS group_id, d AS observed_at, d + INTERVAL 1 DAY AS ingested_at
    FROM ord JOIN customer ON c = c_custkey
    UNION ALL
    SELECT concat('ep:conv:', conv_id, ':', turn), 'default', 'message', text, concat('src:conv:', conv_id), concat('conv:', conv_id),
           TIMESTAMP '2024-01-01' + to_days(conv_id::int) + to_minutes(turn), TIMESTAMP '2024-01-01 01:00:00' + to_days(conv_id::int) + to_minutes(turn)
    FROM conversations
    UNION ALL
    SELECT concat('ep:doc:', doc_id), 'default', 'document', text, concat('src:documents:', source), concat('lang:', lang), NULL, TIMESTAMP '2024-02-01' + to_minutes(doc_id)
    FROM documents
    UNION ALL
    SELECT concat('ep:event:', event_id), 'default', event_type, concat('user ', user_id, ' ', event_type), 'src:events', 'events', ts, ts + INTERVAL 5 MINUTE
    FROM events
),
src AS MATERIALIZED (
    SELECT source_id AS id, space_id,
           CASE WHEN source_id LIKE '%src:orders:%' THEN 'orders' WHEN source_id LIKE 'src:documents:%' THEN 'documents' WHEN source_id LIKE 'src:conv:%' THEN 'chat' ELSE 'events' END AS kind,
           min(ingested_at) AS created_at
    FROM ep GROUP BY 1, 2
),
ent AS MATERIALIZED (
    SELECT concat('customer:', c_custkey) AS id, 'default' AS space_id, 'Customer' AS type, CASE WHEN c_custkey % 10 = 0 THEN c_name || ' Ltd' ELSE c_name END AS canonical_name,
           [c_mktsegment] AS aliases, TIMESTAMP '1995-01-01' AS created_at, CASE WHEN c_custkey % 10 = 0 THEN TIMESTAMP '1998-01-01' ELSE TIMESTAMP '1995-01-01' END AS updated_at
    FROM customer
    UNION ALL
    SELECT concat('o:customer:', c_custkey), 'other', 'Customer', CASE WHEN c_custkey % 10 = 0 THEN c_name || ' Ltd' ELSE c_name END,
           [c_mktsegment], TIMESTAMP '1995-01-01', CASE WHEN c_custkey % 10 = 0 THEN TIMESTAMP '1998-01-01' ELSE TIMESTAMP '1995-01-01' END
    FROM customer WHERE c_custkey IN (SELECT c FROM ord WHERE sp = 'other')
    UNION ALL SELECT concat('supplier:', s_suppkey), 'default', 'Supplier', s_name, [], TIMESTAMP '1995-01-01', TIMESTAMP '1995-01-01' FROM supplier
    UNION ALL SELECT concat('nation:', n_nationkey), 'default', 'Nation', n_name, [], TIMESTAMP '1995-01-01', TIMESTAMP '1995-01-01' FROM nation
    UNION ALL SELECT concat('region:', r_regionkey), 'default', 'Region', r_name, [], TIMESTAMP '1995-01-01', TIMESTAMP '1995-01-01' FROM region
    UNION ALL SELECT concat('part:', p_partkey), 'default', 'Part', p_name, [], TIMESTAMP '1995-01-01', TIMESTAMP '1995-01-01' FROM part
),
entrev AS MATERIALIZED (
    SELECT id, space_id, type, CASE WHEN updated_at > created_at THEN left(canonical_name, length(canonical_name) - 4) ELSE canonical_name END AS canonical_name, aliases,
           created_at, created_at AS tx_time, 1 AS n FROM ent
    UNION ALL
    SELECT id, space_id, type, canonical_name, aliases, created_at, updated_at, 2 FROM ent WHERE updated_at > created_at
),
chain AS (
    SELECT *, lead(d) OVER w AS nd, lead(k) OVER w AS nk, lag(k) OVER w AS pk FROM ord WINDOW w AS (PARTITION BY sp, c ORDER BY d, k)
),
ret AS (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate) AS n
    FROM lineitem WHERE l_returnflag = 'R'
),
fact AS MATERIALIZED (
    SELECT concat('fact:located:customer:', c_custkey) AS id, 'default' AS space_id, 'LOCATED_IN' AS predicate, concat('customer:', c_custkey) AS subject_id, concat('nation:', c_nationkey) AS object_id,
           NULL::VARCHAR AS value_text, 'active' AS status, NULL::TIMESTAMP AS valid_from, NULL::TIMESTAMP AS valid_to, NULL::TIMESTAMP AS observed_at, TIMESTAMP '1995-01-02' AS created_at,
           TIMESTAMP '1995-01-02' AS updated_at, NULL::TIMESTAMP AS retracted_at, NULL::VARCHAR AS retraction_reason, [concat('ep:order:', k)] AS eps, NULL::VARCHAR AS superseded_by, NULL::VARCHAR AS supersedes, NULL::VARCHAR AS supersede_reason
    FROM customer JOIN (SELECT c, min(k) AS k FROM ord WHERE sp = 'default' GROUP BY c) ON c = c_custkey
    UNION ALL
    SELECT concat('fact:located:supplier:', s_suppkey), 'default', 'LOCATED_IN', concat('supplier:', s_suppkey), concat('nation:', s_nationkey), NULL, 'active', NULL, NULL, NULL, TIMESTAMP '1995-01-02', TIMESTAMP '1995-01-02', NULL, NULL, ['ep:doc:0'], NULL, NULL, NULL FROM supplier
    UNION ALL
    SELECT concat('fact:located:nation:', n_nationkey), 'default', 'LOCATED_IN', concat('nation:', n_nationkey), concat('region:', n_regionkey), NULL, 'active', NULL, NULL, NULL, TIMESTAMP '1995-01-02', TIMESTAMP '1995-01-02', NULL, NULL, ['ep:doc:0'], NULL, NULL, NULL FROM nation
    UNION ALL
    SELECT concat(pre, 'fact:order:', k), sp, 'LATEST_ORDER_STATUS', concat(pre, 'customer:', c), NULL, st, CASE WHEN nk IS NULL THEN 'active' ELSE 'superseded' END, d, CASE WHEN nd > d THEN nd END, d,
           d + INTERVAL 1 DAY, coalesce(nd, d) + INTERVAL 1 DAY, NULL, NULL, [concat(pre, 'ep:order:', k)], CASE WHEN nk IS NOT NULL THEN concat(pre, 'fact:order:', nk) END,
           CASE WHEN pk IS NOT NULL THEN concat(pre, 'fact:order:', pk) END, CASE WHEN nk IS NOT NULL OR pk IS NOT NULL THEN 'cardinality_one_slot_replaced' END
    FROM chain
    UNION ALL
    SELECT concat('fact:supplies:', l_suppkey, ':', l_partkey), 'default', 'SUPPLIES', concat('supplier:', l_suppkey), concat('part:', l_partkey), NULL, 'active', NULL, NULL, min(l_shipdate),
           min(l_shipdate) + INTERVAL 1 DAY, min(l_shipdate) + INTERVAL 1 DAY, NULL, NULL, list_sort(list(DISTINCT concat('ep:order:', l_orderkey))), NULL, NULL, NULL
    FROM lineitem GROUP BY l_suppkey, l_partkey
    UNION ALL
    SELECT concat('fact:returned:', l_orderkey, ':', n), 'default', 'RETURNED', concat('customer:', c), concat('part:', l_partkey), NULL, 'retracted', NULL, NULL, l_shipdate,
           l_shipdate + INTERVAL 1 DAY, l_shipdate + INTERVAL 30 DAY, l_shipdate + INTERVAL 30 DAY, 'returned', [concat('ep:order:', l_orderkey)], NULL, NULL, NULL
    FROM ret JOIN ord ON k = l_orderkey AND sp = 'default'
),
factrev AS MATERIALIZED (
    SELECT * REPLACE ('active' AS status, NULL::TIMESTAMP AS valid_to, created_at AS updated_at, NULL::TIMESTAMP AS retracted_at, NULL::VARCHAR AS retraction_reason, NULL::VARCHAR AS superseded_by,
                      CASE WHEN supersedes IS NOT NULL THEN supersede_reason END AS supersede_reason), created_at AS tx_time, 1 AS n FROM fact
    UNION ALL
    SELECT *, updated_at, CASE status WHEN 'superseded' THEN 2 ELSE 3 END FROM fact WHERE status <> 'active'
)
"""

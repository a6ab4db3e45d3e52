"""The fixture tables as SQL text, used as leading CTEs of every oracle query."""

FIXTURES = {
    "fx_enrollment": """
SELECT o_custkey AS p_id, CAST(min(o_orderdate) AS DATE) AS enrollment_date,
 CASE WHEN o_custkey % 7 = 0 THEN CAST(max(o_orderdate) AS DATE) END AS withdrawal_date
 FROM orders WHERE o_custkey % 10 <> 0 GROUP BY o_custkey
""",
    "fx_active": """
SELECT o_custkey AS p_id, o_orderdate AS ts,
 CASE WHEN o_orderkey % 3 = 0 THEN 'PHQ8' WHEN o_orderkey % 3 = 1 THEN 'RSES' ELSE 'ESM' END AS data_name FROM orders
""",
    "fx_passive": """
SELECT o.o_custkey AS p_id, l.l_shipdate AS ts,
 CASE l.l_returnflag WHEN 'N' THEN 'Passive_phone' WHEN 'R' THEN 'Passive_Fitbit' ELSE 'Passive_other' END AS data_name
 FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
""",
    "fx_contact": """
SELECT o_custkey AS p_id, CAST(o_orderdate AS DATE) AS date,
 row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS record_num FROM orders WHERE o_orderstatus = 'F'
""",
    "fx_ids": """
SELECT o_custkey AS p_id, CAST(o_orderdate AS DATE) AS date,
 row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS record_num,
 CAST(floor(o_totalprice) AS BIGINT) % 85 AS ids_score FROM orders WHERE o_orderpriority = '1-URGENT'
""",
    "fx_demog": """
SELECT c.c_custkey AS p_id, CASE WHEN c.c_custkey % 23 <> 0 THEN CAST(18 + c.c_custkey % 60 AS DOUBLE) END AS age,
 CASE WHEN c.c_custkey % 3 = 0 THEN 'male' ELSE 'female' END AS sex, c.c_mktsegment AS marry_align,
 c.c_acctbal AS edu_age_align, r.r_name AS site, c.c_custkey % 9 AS brand_code, c.c_custkey % 4 AS phone_status,
 CASE c.c_custkey % 7 WHEN 0 THEN 'Employed' WHEN 1 THEN 'Furloughed' WHEN 2 THEN 'Unemployed' WHEN 3 THEN 'Off sick'
  WHEN 4 THEN 'Student' WHEN 5 THEN 'Retired' END AS employment_status
 FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
""",
    "fx_survey": """
SELECT o.o_custkey AS p_id, l.l_orderkey, l.l_linenumber, l.l_shipdate AS start_time,
 CASE WHEN l.l_linenumber % 5 = 0 AND l.l_orderkey % 4 = 0 THEN -1 ELSE CAST(l.l_quantity AS BIGINT) * 60 END AS notif_lag_s,
 CAST(l.l_quantity AS BIGINT) AS total_time_taken,
 (CAST(l.l_quantity AS BIGINT) * 1 + l.l_linenumber) % 4 AS s_1,
 (CAST(l.l_quantity AS BIGINT) * 2 + l.l_linenumber) % 4 AS s_2,
 (CAST(l.l_quantity AS BIGINT) * 3 + l.l_linenumber) % 4 AS s_3,
 (CAST(l.l_quantity AS BIGINT) * 4 + l.l_linenumber) % 4 AS s_4,
 (CAST(l.l_quantity AS BIGINT) * 5 + l.l_linenumber) % 4 AS s_5,
 (CAST(l.l_quantity AS BIGINT) * 6 + l.l_linenumber) % 4 AS s_6,
 (CAST(l.l_quantity AS BIGINT) * 7 + l.l_linenumber) % 4 AS s_7,
 (CAST(l.l_quantity AS BIGINT) * 8 + l.l_linenumber) % 4 AS s_8,
 (CAST(l.l_quantity AS BIGINT) * 9 + l.l_linenumber) % 4 AS s_9,
 (CAST(l.l_quantity AS BIGINT) * 10 + l.l_linenumber) % 4 AS s_10 FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
""",
    "fx_comorbidity": """
SELECT c_custkey AS p_id,
 CASE WHEN (c_custkey * 1) % 29 = 0 THEN 1 ELSE 0 END AS ill_0,
 CASE WHEN (c_custkey * 2) % 29 = 0 THEN 1 ELSE 0 END AS ill_1,
 CASE WHEN (c_custkey * 3) % 29 = 0 THEN 1 ELSE 0 END AS ill_2,
 CASE WHEN (c_custkey * 4) % 29 = 0 THEN 1 ELSE 0 END AS ill_3,
 CASE WHEN (c_custkey * 5) % 29 = 0 THEN 1 ELSE 0 END AS ill_4,
 CASE WHEN (c_custkey * 6) % 29 = 0 THEN 1 ELSE 0 END AS ill_5,
 CASE WHEN (c_custkey * 7) % 29 = 0 THEN 1 ELSE 0 END AS ill_6,
 CASE WHEN (c_custkey * 8) % 29 = 0 THEN 1 ELSE 0 END AS ill_7,
 CASE WHEN (c_custkey * 9) % 29 = 0 THEN 1 ELSE 0 END AS ill_8,
 CASE WHEN (c_custkey * 10) % 29 = 0 THEN 1 ELSE 0 END AS ill_9,
 CASE WHEN (c_custkey * 11) % 29 = 0 THEN 1 ELSE 0 END AS ill_10,
 CASE WHEN (c_custkey * 12) % 29 = 0 THEN 1 ELSE 0 END AS ill_11,
 CASE WHEN (c_custkey * 13) % 29 = 0 THEN 1 ELSE 0 END AS ill_12,
 CASE WHEN (c_custkey * 14) % 29 = 0 THEN 1 ELSE 0 END AS ill_13,
 CASE WHEN (c_custkey * 15) % 29 = 0 THEN 1 ELSE 0 END AS ill_14,
 CASE WHEN (c_custkey * 16) % 29 = 0 THEN 1 ELSE 0 END AS ill_15,
 CASE WHEN (c_custkey * 17) % 29 = 0 THEN 1 ELSE 0 END AS ill_16,
 CASE WHEN (c_custkey * 18) % 29 = 0 THEN 1 ELSE 0 END AS ill_17,
 CASE WHEN (c_custkey * 19) % 29 = 0 THEN 1 ELSE 0 END AS ill_18 FROM customer
""",
    "fx_ev_enrollment": """
SELECT user_id AS p_id, CAST(min(ts) AS DATE) AS enrollment_date FROM events WHERE event_type = 'signup' GROUP BY user_id
""",
    "fx_ev_stream": """
SELECT user_id AS p_id, ts, event_type AS data_name, value FROM events WHERE event_type <> 'signup'
""",
}

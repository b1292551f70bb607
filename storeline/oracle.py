"""Independent DuckDB SQL for every registered query (the correctness oracle).

The SQL is written straight from the rules (no pre-aggregation, plain joins),
so it checks the Spark plans rather than mirroring them. Views available:
region nation customer supplier part orders lineitem events documents
embeddings pages benchmark labels conversations.
"""

from __future__ import annotations

# ---------------------------------------------------------------- model tables

MODEL_CTES = r"""
n_outlets AS (SELECT COUNT(*) AS n FROM supplier),
m_outlet AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS outlet_id, s_name AS outlet, n_name AS city
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey),
m_menu AS (
  SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_name AS product_name, p_type AS category,
         CAST(p_retailprice AS DECIMAL(18,2)) AS price, CAST(p_size * 10 AS DECIMAL(18,2)) AS product_cost
  FROM part),
m_bridge AS (
  SELECT DISTINCT CAST(l_suppkey AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) AS outlet_menu_id,
         CAST(l_suppkey AS VARCHAR) AS outlet_id, CAST(l_partkey AS VARCHAR) AS product_id
  FROM lineitem),
m_order AS (
  SELECT CAST(l_suppkey AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) AS outlet_menu_id,
         CAST(o_custkey AS VARCHAR) AS customer_id,
         CAST(l_quantity AS DECIMAL(18,2)) AS quantity, CAST(l_extendedprice AS DECIMAL(18,2)) AS unit_price
  FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey),
m_daily AS (
  SELECT CAST(l_suppkey AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) AS outlet_product_id,
         CAST(l_shipdate AS DATE) AS d, SUM(CAST(l_quantity AS DECIMAL(18,2))) AS sales
  FROM lineitem GROUP BY 1, 2),
m_review AS (
  SELECT CAST(l_suppkey AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) AS outlet_menu_id,
         CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS positive_score,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS negative_score,
         CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS neutral_score
  FROM lineitem),
m_quality AS (
  SELECT CAST(l_suppkey AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) AS outlet_menu_id,
         CAST((CAST(0.10 AS DECIMAL(18,2)) - CAST(l_discount AS DECIMAL(18,2))) * 50 AS DECIMAL(18,4)) AS total_stage,
         l_linestatus AS quality_status
  FROM lineitem),
m_transport AS (
  SELECT CAST(l_suppkey AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) AS outlet_menu_id,
         CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(18,2)) AS DECIMAL(18,4)) AS transportation_cost
  FROM lineitem),
m_promotion AS (
  SELECT CAST(user_id % (SELECT n FROM n_outlets) AS VARCHAR) AS outlet_id,
         CAST(value AS DECIMAL(18,2)) AS cost, event_type AS sources,
         CAST(json_extract_string(props, '$.k') AS DECIMAL(18,0)) AS products
  FROM events),
m_employment AS (
  SELECT CAST(c_custkey % (SELECT n FROM n_outlets) AS VARCHAR) AS outlet_id, c_mktsegment AS position_id,
         CASE WHEN CAST(c_acctbal AS DECIMAL(18,2)) < 0 THEN NULL
              ELSE CAST(CAST(c_acctbal AS DECIMAL(18,2)) / 2000 AS DECIMAL(18,6)) END AS performance_rating
  FROM customer)
"""

FACT_CTES = r"""
f_sales_o AS (
  SELECT b.outlet_id, CAST(SUM(o.quantity) AS DOUBLE) AS total_units_sold,
         CAST(SUM(o.quantity * o.unit_price) AS DOUBLE) AS total_revenue,
         COUNT(DISTINCT o.customer_id) AS unique_customers
  FROM m_order o JOIN m_bridge b ON o.outlet_menu_id = b.outlet_menu_id GROUP BY b.outlet_id),
f_daily_o AS (
  SELECT b.outlet_id, CAST(SUM(d.sales) AS DOUBLE) AS total_sales
  FROM m_daily d JOIN m_bridge b ON d.outlet_product_id = b.outlet_menu_id GROUP BY b.outlet_id),
f_emp_avg AS (
  SELECT outlet_id, CASE WHEN COUNT(performance_rating) > 0
         THEN CAST(SUM(performance_rating) AS DOUBLE) / COUNT(performance_rating) END AS avg_employee_rating
  FROM m_employment GROUP BY outlet_id),
f_emp_role AS (
  SELECT outlet_id, position_id AS top_employee_role FROM (
    SELECT outlet_id, position_id,
           ROW_NUMBER() OVER (PARTITION BY outlet_id ORDER BY COUNT(*) DESC, position_id) AS rn
    FROM m_employment WHERE position_id IS NOT NULL GROUP BY outlet_id, position_id) WHERE rn = 1),
f_emp AS (
  SELECT COALESCE(a.outlet_id, r.outlet_id) AS outlet_id, a.avg_employee_rating, r.top_employee_role
  FROM f_emp_avg a FULL JOIN f_emp_role r ON a.outlet_id = r.outlet_id),
f_promo AS (
  SELECT s.outlet_id, s.total_promotion_cost, s.num_promoted_products, m.main_promotion_method FROM (
    SELECT outlet_id, CAST(SUM(cost) AS DOUBLE) AS total_promotion_cost,
           CAST(SUM(products) AS DOUBLE) AS num_promoted_products
    FROM m_promotion GROUP BY outlet_id) s
  LEFT JOIN (
    SELECT outlet_id, sources AS main_promotion_method FROM (
      SELECT outlet_id, sources, ROW_NUMBER() OVER (PARTITION BY outlet_id ORDER BY COUNT(*) DESC, sources) AS rn
      FROM m_promotion WHERE sources IS NOT NULL GROUP BY outlet_id, sources) WHERE rn = 1) m
  ON s.outlet_id = m.outlet_id),
f_transport_o AS (
  SELECT b.outlet_id, CAST(SUM(t.transportation_cost) AS DOUBLE) / COUNT(*) AS avg_transportation_cost,
         CAST(MIN(t.transportation_cost) AS DOUBLE) AS min_transportation_cost,
         CAST(MAX(t.transportation_cost) AS DOUBLE) AS max_transportation_cost
  FROM m_transport t JOIN m_bridge b ON t.outlet_menu_id = b.outlet_menu_id GROUP BY b.outlet_id),
f_review_o AS (
  SELECT b.outlet_id,
         CAST(SUM(positive_score) AS DOUBLE) / COUNT(*) AS avg_positive_score,
         CAST(SUM(negative_score) AS DOUBLE) / COUNT(*) AS avg_negative_score,
         CAST(SUM(neutral_score) AS DOUBLE) / COUNT(*) AS avg_neutral_score,
         CAST(SUM(positive_score - negative_score) AS DOUBLE) / COUNT(*) AS avg_sentiment_signal,
         COUNT(*) AS total_reviews
  FROM m_review r JOIN m_bridge b ON r.outlet_menu_id = b.outlet_menu_id GROUP BY b.outlet_id),
f_quality_o AS (
  SELECT a.outlet_id, a.avg_quality_score, m.quality_status_most_common FROM (
    SELECT b.outlet_id, CAST(SUM(total_stage) AS DOUBLE) / COUNT(*) AS avg_quality_score
    FROM m_quality q JOIN m_bridge b ON q.outlet_menu_id = b.outlet_menu_id GROUP BY b.outlet_id) a
  LEFT JOIN (
    SELECT outlet_id, quality_status AS quality_status_most_common FROM (
      SELECT b.outlet_id, q.quality_status,
             ROW_NUMBER() OVER (PARTITION BY b.outlet_id ORDER BY COUNT(*) DESC, q.quality_status) AS rn
      FROM m_quality q JOIN m_bridge b ON q.outlet_menu_id = b.outlet_menu_id
      WHERE q.quality_status IS NOT NULL GROUP BY b.outlet_id, q.quality_status) WHERE rn = 1) m
  ON a.outlet_id = m.outlet_id),
f_sales_p AS (
  SELECT b.product_id, CAST(SUM(o.quantity) AS DOUBLE) AS units_sold_total,
         CAST(SUM(o.quantity * o.unit_price) AS DOUBLE) AS revenue_total,
         COUNT(DISTINCT o.customer_id) AS num_unique_customers_bought,
         COUNT(o.customer_id) AS total_purchase_records,
         CASE WHEN COUNT(DISTINCT o.customer_id) > 0
              THEN CAST(COUNT(o.customer_id) AS DOUBLE) / COUNT(DISTINCT o.customer_id) ELSE 0.0 END
           AS repeat_purchase_rate
  FROM m_order o JOIN m_bridge b ON o.outlet_menu_id = b.outlet_menu_id GROUP BY b.product_id),
f_outlets_p AS (
  SELECT product_id, COUNT(DISTINCT outlet_id) AS num_outlets_selling
  FROM m_bridge WHERE product_id IS NOT NULL GROUP BY product_id),
f_review_p AS (
  SELECT b.product_id,
         CAST(SUM(positive_score) AS DOUBLE) / COUNT(*) AS avg_positive_score,
         CAST(SUM(negative_score) AS DOUBLE) / COUNT(*) AS avg_negative_score,
         CAST(SUM(neutral_score) AS DOUBLE) / COUNT(*) AS avg_neutral_score,
         CAST(SUM(positive_score - negative_score) AS DOUBLE) / COUNT(*) AS avg_sentiment_signal,
         COUNT(*) AS total_reviews
  FROM m_review r JOIN m_bridge b ON r.outlet_menu_id = b.outlet_menu_id GROUP BY b.product_id),
f_quality_p AS (
  SELECT b.product_id, CAST(SUM(total_stage) AS DOUBLE) / COUNT(*) AS avg_quality_score
  FROM m_quality q JOIN m_bridge b ON q.outlet_menu_id = b.outlet_menu_id GROUP BY b.product_id),
f_transport_p AS (
  SELECT b.product_id, CAST(SUM(t.transportation_cost) AS DOUBLE) / COUNT(*) AS avg_transportation_cost,
         CAST(MIN(t.transportation_cost) AS DOUBLE) AS min_transportation_cost,
         CAST(MAX(t.transportation_cost) AS DOUBLE) AS max_transportation_cost
  FROM m_transport t JOIN m_bridge b ON t.outlet_menu_id = b.outlet_menu_id GROUP BY b.product_id)
"""

MASTER_CTES = r"""
k_outlet AS (
  SELECT o.outlet_id, o.outlet, o.city, CAST(0 AS BIGINT) AS employee_count,
         COALESCE(d.total_sales, 0.0) AS total_sales,
         COALESCE(s.total_units_sold, 0.0) AS total_units_sold,
         COALESCE(s.total_revenue, 0.0) AS total_revenue,
         COALESCE(s.unique_customers, 0) AS unique_customers,
         CASE WHEN COALESCE(s.unique_customers, 0) > 0
              THEN COALESCE(s.total_revenue, 0.0) / CAST(s.unique_customers AS DOUBLE) ELSE 0.0 END
           AS avg_spend_per_customer,
         COALESCE(e.avg_employee_rating, 0.0) AS avg_employee_rating,
         e.top_employee_role,
         COALESCE(p.total_promotion_cost, 0.0) AS total_promotion_cost,
         COALESCE(p.num_promoted_products, 0.0) AS num_promoted_products,
         p.main_promotion_method,
         COALESCE(t.avg_transportation_cost, 0.0) AS avg_transportation_cost,
         COALESCE(t.min_transportation_cost, 0.0) AS min_transportation_cost,
         COALESCE(t.max_transportation_cost, 0.0) AS max_transportation_cost,
         COALESCE(r.avg_positive_score, 0.0) AS avg_positive_score,
         COALESCE(r.avg_negative_score, 0.0) AS avg_negative_score,
         COALESCE(r.avg_neutral_score, 0.0) AS avg_neutral_score,
         COALESCE(r.avg_sentiment_signal, 0.0) AS avg_sentiment_signal,
         COALESCE(r.total_reviews, 0) AS total_reviews,
         COALESCE(q.avg_quality_score, 0.0) AS avg_quality_score,
         COALESCE(q.quality_status_most_common, 'unknown') AS quality_status_most_common
  FROM m_outlet o
  LEFT JOIN f_sales_o s ON o.outlet_id = s.outlet_id
  LEFT JOIN f_daily_o d ON o.outlet_id = d.outlet_id
  LEFT JOIN f_emp e ON o.outlet_id = e.outlet_id
  LEFT JOIN f_promo p ON o.outlet_id = p.outlet_id
  LEFT JOIN f_transport_o t ON o.outlet_id = t.outlet_id
  LEFT JOIN f_review_o r ON o.outlet_id = r.outlet_id
  LEFT JOIN f_quality_o q ON o.outlet_id = q.outlet_id),
s_outlet AS (
  SELECT MIN(total_revenue) AS r0, MAX(total_revenue) AS r1,
         MIN(avg_quality_score) AS q0, MAX(avg_quality_score) AS q1,
         MIN(avg_employee_rating) AS e0, MAX(avg_employee_rating) AS e1,
         MIN(avg_sentiment_signal) AS s0, MAX(avg_sentiment_signal) AS s1,
         MIN(CAST(unique_customers AS DOUBLE)) AS c0, MAX(CAST(unique_customers AS DOUBLE)) AS c1
  FROM k_outlet),
master_outlet AS (
  SELECT k.*,
    CAST(0.30 AS DOUBLE) * (CASE WHEN r1 = r0 THEN 0.0 ELSE (total_revenue - r0) / (r1 - r0) END)
    + CAST(0.20 AS DOUBLE) * (CASE WHEN q1 = q0 THEN 0.0 ELSE (avg_quality_score - q0) / (q1 - q0) END)
    + CAST(0.20 AS DOUBLE) * (CASE WHEN e1 = e0 THEN 0.0 ELSE (avg_employee_rating - e0) / (e1 - e0) END)
    + CAST(0.15 AS DOUBLE) * (CASE WHEN s1 = s0 THEN 0.0 ELSE (avg_sentiment_signal - s0) / (s1 - s0) END)
    + CAST(0.15 AS DOUBLE) * (CASE WHEN c1 = c0 THEN 0.0 ELSE (CAST(unique_customers AS DOUBLE) - c0) / (c1 - c0) END)
      AS outlet_score
  FROM k_outlet k, s_outlet),
k_product AS (
  SELECT m.product_id, m.category, m.product_name, CAST(m.price AS DOUBLE) AS price,
         CAST(m.product_cost AS DOUBLE) AS product_cost,
         CAST(m.price - m.product_cost AS DOUBLE) AS profit_per_unit,
         CAST(m.price - m.product_cost AS DOUBLE) * COALESCE(s.units_sold_total, 0.0) AS total_profit,
         CASE WHEN m.price > 0 THEN CAST(m.price - m.product_cost AS DOUBLE) / CAST(m.price AS DOUBLE) ELSE 0.0 END
           AS margin_percentage,
         COALESCE(s.units_sold_total, 0.0) AS units_sold_total,
         COALESCE(s.revenue_total, 0.0) AS revenue_total,
         COALESCE(n.num_outlets_selling, 0) AS num_outlets_selling,
         COALESCE(s.num_unique_customers_bought, 0) AS num_unique_customers_bought,
         COALESCE(s.repeat_purchase_rate, 0.0) AS repeat_purchase_rate,
         COALESCE(q.avg_quality_score, 0.0) AS avg_quality_score,
         COALESCE(r.avg_positive_score, 0.0) AS avg_positive_score,
         COALESCE(r.avg_negative_score, 0.0) AS avg_negative_score,
         COALESCE(r.avg_neutral_score, 0.0) AS avg_neutral_score,
         COALESCE(r.avg_sentiment_signal, 0.0) AS avg_sentiment_signal,
         COALESCE(r.total_reviews, 0) AS total_reviews,
         COALESCE(t.avg_transportation_cost, 0.0) AS avg_transportation_cost
  FROM m_menu m
  LEFT JOIN f_sales_p s ON m.product_id = s.product_id
  LEFT JOIN f_outlets_p n ON m.product_id = n.product_id
  LEFT JOIN f_review_p r ON m.product_id = r.product_id
  LEFT JOIN f_quality_p q ON m.product_id = q.product_id
  LEFT JOIN f_transport_p t ON m.product_id = t.product_id),
s_product AS (
  SELECT MIN(units_sold_total) AS u0, MAX(units_sold_total) AS u1,
         MIN(avg_quality_score) AS q0, MAX(avg_quality_score) AS q1,
         MIN(CAST(total_reviews AS DOUBLE)) AS v0, MAX(CAST(total_reviews AS DOUBLE)) AS v1,
         MIN(avg_sentiment_signal) AS s0, MAX(avg_sentiment_signal) AS s1,
         MIN(total_profit) AS p0, MAX(total_profit) AS p1
  FROM k_product),
master_product AS (
  SELECT k.*,
    CAST(0.35 AS DOUBLE) * (CASE WHEN u1 = u0 THEN 0.0 ELSE (units_sold_total - u0) / (u1 - u0) END)
    + CAST(0.20 AS DOUBLE) * (CASE WHEN q1 = q0 THEN 0.0 ELSE (avg_quality_score - q0) / (q1 - q0) END)
    + CAST(0.15 AS DOUBLE) * (CASE WHEN v1 = v0 THEN 0.0 ELSE (CAST(total_reviews AS DOUBLE) - v0) / (v1 - v0) END)
    + CAST(0.15 AS DOUBLE) * (CASE WHEN s1 = s0 THEN 0.0 ELSE (avg_sentiment_signal - s0) / (s1 - s0) END)
    + CAST(0.15 AS DOUBLE) * (CASE WHEN p1 = p0 THEN 0.0 ELSE (total_profit - p0) / (p1 - p0) END)
      AS product_score
  FROM k_product k, s_product)
"""

ENRICH_CTES = r"""
e_outlet0 AS (
  SELECT outlet_id, TRIM(outlet) AS outlet, COALESCE(LOWER(TRIM(city)), 'unknown') AS city, employee_count,
         total_sales, total_units_sold, total_revenue, unique_customers, avg_spend_per_customer,
         avg_employee_rating, COALESCE(top_employee_role, 'unknown') AS top_employee_role,
         total_promotion_cost, num_promoted_products,
         COALESCE(LOWER(TRIM(main_promotion_method)), 'unknown') AS main_promotion_method,
         avg_transportation_cost, min_transportation_cost, max_transportation_cost,
         avg_positive_score, avg_negative_score, avg_neutral_score, avg_sentiment_signal, total_reviews,
         avg_quality_score, COALESCE(LOWER(TRIM(quality_status_most_common)), 'unknown') AS quality_status_most_common,
         outlet_score,
         total_revenue * CAST(0.4 AS DOUBLE) + CAST(unique_customers AS DOUBLE) * CAST(0.3 AS DOUBLE)
           + outlet_score * CAST(0.3 AS DOUBLE) * CAST(100.0 AS DOUBLE) AS performance_score
  FROM master_outlet),
e_outlet AS (
  SELECT e.*, c.city_rev, c.city_customers, s.rev_std, e.outlet_score < 0.5 AS needs_improvement
  FROM e_outlet0 e
  LEFT JOIN (SELECT city, CAST(SUM(CAST(total_revenue AS DECIMAL(38,4))) AS DOUBLE) AS city_rev,
                    CAST(SUM(CAST(unique_customers AS DECIMAL(38,4))) AS BIGINT) AS city_customers
             FROM e_outlet0 GROUP BY city) c ON e.city = c.city,
  (SELECT ROUND(COALESCE(STDDEV_SAMP(total_revenue), 0.0), 4) AS rev_std FROM e_outlet0) s),
e_product0 AS (
  SELECT product_id, COALESCE(LOWER(TRIM(category)), 'unknown') AS category,
         COALESCE(LOWER(TRIM(product_name)), 'unknown') AS product_name,
         price, product_cost, profit_per_unit, total_profit, margin_percentage, units_sold_total, revenue_total,
         num_outlets_selling, num_unique_customers_bought, repeat_purchase_rate, avg_quality_score,
         avg_positive_score, avg_negative_score, avg_neutral_score, avg_sentiment_signal, total_reviews,
         avg_transportation_cost, product_score,
         revenue_total * CAST(0.4 AS DOUBLE) + units_sold_total * CAST(0.3 AS DOUBLE)
           + product_score * CAST(0.3 AS DOUBLE) * CAST(100.0 AS DOUBLE) AS performance_score
  FROM master_product),
e_product AS (
  SELECT e.*, c.category_rev, c.category_units, s.price_rating_corr,
         COALESCE(s.rev / NULLIF(s.units, 0) * CAST(o.cust AS DOUBLE), 0.0) AS avg_order_value,
         e.price > 50 AS is_premium
  FROM e_product0 e
  LEFT JOIN (SELECT category, CAST(SUM(CAST(revenue_total AS DECIMAL(38,4))) AS DOUBLE) AS category_rev,
                    CAST(SUM(CAST(units_sold_total AS DECIMAL(38,4))) AS DOUBLE) AS category_units
             FROM e_product0 GROUP BY category) c ON e.category = c.category,
  (SELECT ROUND(CASE WHEN STDDEV_SAMP(price) * STDDEV_SAMP(avg_quality_score) > 0
                     THEN COVAR_SAMP(price, avg_quality_score) / (STDDEV_SAMP(price) * STDDEV_SAMP(avg_quality_score))
                     ELSE 0.0 END, 6) AS price_rating_corr,
          CAST(SUM(CAST(revenue_total AS DECIMAL(38,4))) AS DOUBLE) AS rev,
          CAST(SUM(CAST(units_sold_total AS DECIMAL(38,4))) AS DOUBLE) AS units
   FROM e_product0) s,
  (SELECT SUM(COALESCE(unique_customers, 0)) AS cust FROM master_outlet) o)
"""


def with_ctes(*blocks: str, body: str) -> str:
    return "WITH " + ",\n".join(b.strip() for b in blocks) + "\n" + body


ALL_MASTER = (MODEL_CTES, FACT_CTES, MASTER_CTES)
ALL_ENRICH = (MODEL_CTES, FACT_CTES, MASTER_CTES, ENRICH_CTES)

OUTLET_COLS = ("outlet_id, outlet, city, employee_count, total_sales, total_units_sold, total_revenue, "
               "unique_customers, avg_spend_per_customer, avg_employee_rating, top_employee_role, "
               "total_promotion_cost, num_promoted_products, main_promotion_method, avg_transportation_cost, "
               "min_transportation_cost, max_transportation_cost, avg_positive_score, avg_negative_score, "
               "avg_neutral_score, avg_sentiment_signal, total_reviews, avg_quality_score, "
               "quality_status_most_common, outlet_score")


def sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["sales_by_outlet"] = with_ctes(*ALL_MASTER, body="SELECT * FROM f_sales_o")
    q["daily_sales_by_outlet"] = with_ctes(*ALL_MASTER, body="SELECT * FROM f_daily_o")
    q["employee_metrics"] = with_ctes(*ALL_MASTER, body="SELECT * FROM f_emp")
    q["promotion_by_outlet"] = with_ctes(*ALL_MASTER, body="SELECT * FROM f_promo")
    q["transport_by_outlet"] = with_ctes(*ALL_MASTER, body="SELECT * FROM f_transport_o")
    q["reviews_by_outlet"] = with_ctes(*ALL_MASTER, body="SELECT * FROM f_review_o")
    q["quality_by_outlet"] = with_ctes(*ALL_MASTER, body="SELECT * FROM f_quality_o")
    q["sales_by_product"] = with_ctes(*ALL_MASTER, body="SELECT * FROM f_sales_p")
    q["outlets_by_product"] = with_ctes(*ALL_MASTER, body="SELECT * FROM f_outlets_p")
    q["reviews_by_product"] = with_ctes(*ALL_MASTER, body="SELECT * FROM f_review_p")
    q["quality_by_product"] = with_ctes(*ALL_MASTER, body="SELECT * FROM f_quality_p")
    q["transport_by_product"] = with_ctes(*ALL_MASTER, body="SELECT * FROM f_transport_p")
    q["master_outlet"] = with_ctes(*ALL_MASTER, body=f"SELECT {OUTLET_COLS} FROM master_outlet")
    q["master_product"] = with_ctes(*ALL_MASTER, body="SELECT * FROM master_product")
    q["enrich_outlet"] = with_ctes(*ALL_ENRICH, body="SELECT * FROM e_outlet")
    q["enrich_product"] = with_ctes(*ALL_ENRICH, body="SELECT * FROM e_product")
    q["top_performers"] = with_ctes(*ALL_ENRICH, body=(
        "SELECT outlet_id, outlet, city, total_revenue, unique_customers, outlet_score, performance_score "
        "FROM e_outlet ORDER BY performance_score DESC, outlet_id LIMIT 5"))
    q.update(_intent_sql())
    q.update(_doc_sql())
    q.update(_misc_sql())
    q.update(_selection_sql())
    q.update(_evidence_sql())
    q.update(_source_sql())
    return q


# ---------------------------------------------------------------- questions and intents

def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def question_cte() -> str:
    from storeline.sources.questions import CONV_FACTOR, TEMPLATE_BASE, TEMPLATES
    values = ", ".join(f"({i}, {_sql_str(t)})" for i, t in enumerate(TEMPLATES))
    return f"""
qs AS (
  SELECT CAST(conv_id * {CONV_FACTOR} + turn AS BIGINT) AS q_id, text AS question
  FROM conversations WHERE role = 'user'
  UNION ALL
  SELECT CAST({TEMPLATE_BASE} + s_suppkey * 100 + tp.i AS BIGINT) AS q_id,
         replace(replace(tp.tpl, '{{outlet}}', COALESCE(s_name, '')), '{{city}}', COALESCE(n_name, '')) AS question
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey, (VALUES {values}) tp(i, tpl))
"""


def _words(ws) -> str:
    return r"(?:^|[^\p{L}\p{N}_])(?:" + "|".join(ws) + r")(?:[^\p{L}\p{N}_]|$)"


def _any(col: str, ws) -> str:
    return "(" + " OR ".join(f"contains({col}, {_sql_str(w)})" for w in ws) + ")"


def intents_ctes() -> str:
    from storeline.operators import intents as I
    rx = lambda ws: f"regexp_matches(q, {_sql_str(_words(ws))})"
    loc = f"({rx(I.LOCATION_WORDS)} OR contains(q, 'where'))"
    cmp_ = rx(I.COMPARISON_WORDS)
    cnt = rx(I.COUNT_WORDS)
    agg = rx(I.AGGREGATE_WORDS)
    rank = rx(I.RANKING_WORDS)
    ana = rx(I.ANALYTICAL_WORDS)
    lst = rx(I.LIST_WORDS)
    det = _any("q", I.DETAIL_SUBSTRINGS)
    outl = rx(I.ENTITY_OUTLET_WORDS)
    rank_n = _sql_str(r"(?:^|[^\p{L}\p{N}_])(?:top|best|worst|bottom)\s+([0-9]+)(?:[^\p{L}\p{N}_]|$)")
    one = _sql_str(r"(?:^|[^\p{L}\p{N}_])(?:best|worst|top|highest|lowest)(?:$|[^\p{L}\p{N}_\s]|\s+(?:$|[^\s0-9]))")
    price = _sql_str(r"between\s+₹?([0-9]+)(?:\s*-\s*|\s+and\s+)₹?([0-9]+)")
    rating = _sql_str(r"(?:rating|score)(?:\s+)?(?:above|over|greater than)\s+([0-9]+(?:\.[0-9]+)?)")
    comp = _sql_str(r"(?i)(?:compare|vs|versus|between)\s+(.+?)\s+(?:and|vs|versus|with|,)\s+(.+?)(?:\?|\n?\z|by)")
    quoted = _sql_str(r"[\"']([^\"']+)[\"']")
    metrics = ", ".join(f"CASE WHEN {_any('q', kws)} THEN {_sql_str(m)} END" for m, kws in I.METRIC_VOCAB.items())
    qwords = ", ".join(f"CASE WHEN {_any('q', kws)} THEN {_sql_str(w)} END" for w, kws in I.QUESTION_WORDS.items())
    cats = " ".join(f"WHEN contains(q, {_sql_str(c)}) THEN {_sql_str(I.CATEGORY_TITLES[c])}" for c in I.CATEGORIES)
    strip = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
    return f"""
ql AS (SELECT q_id, COALESCE(question, '') AS question,
              {strip.format(x="lower(COALESCE(question, ''))")} AS q FROM qs),
d_city AS (SELECT lower(city) AS k, MIN(TRY_CAST(outlet_id AS DOUBLE)) AS o FROM e_outlet
           WHERE city IS NOT NULL AND lower(city) <> 'unknown' GROUP BY lower(city)),
d_outlet AS (SELECT lower(outlet) AS k, ARG_MIN(outlet, TRY_CAST(outlet_id AS DOUBLE)) AS v, MIN(TRY_CAST(outlet_id AS DOUBLE)) AS o FROM e_outlet WHERE outlet IS NOT NULL AND outlet <> ''
             GROUP BY lower(outlet)),
q_city AS (SELECT q_id, array_to_string(list_transform(string_split(k, ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS city_match FROM (
    SELECT ql.q_id, d.k, ROW_NUMBER() OVER (PARTITION BY ql.q_id ORDER BY d.o, d.k) AS rn
    FROM ql JOIN d_city d ON contains(ql.q, d.k) WHERE d.k <> '') WHERE rn = 1),
q_outlet AS (SELECT q_id, v AS outlet_match FROM (
    SELECT ql.q_id, d.v, ROW_NUMBER() OVER (PARTITION BY ql.q_id ORDER BY d.o, d.k) AS rn
    FROM ql JOIN d_outlet d ON contains(ql.q, d.k) WHERE d.k <> '') WHERE rn = 1),
qf AS (
  SELECT ql.*, c.city_match, o.outlet_match,
         {loc} AS is_loc, {cmp_} AS is_cmp, {cnt} AS is_cnt, {agg} AS is_agg, {rank} AS is_rank,
         {ana} AS is_ana, {lst} AS is_list, {det} AS is_det, {outl} AS is_outlet_word,
         regexp_extract(q, {rank_n}, 1) AS rank_txt, regexp_matches(q, {one}) AS rank_one,
         regexp_extract(q, {price}, 1) AS pmin, regexp_extract(q, {price}, 2) AS pmax,
         regexp_extract(q, {rating}, 1) AS rmin,
         regexp_extract(ql.question, {comp}, 1) AS ca, regexp_extract(ql.question, {comp}, 2) AS cb,
         regexp_extract_all(ql.question, {quoted}, 1) AS quoted
  FROM ql LEFT JOIN q_city c ON ql.q_id = c.q_id LEFT JOIN q_outlet o ON ql.q_id = o.q_id),
intents AS (
  SELECT q_id,
    CASE WHEN is_loc THEN 'location' WHEN is_cmp THEN 'comparison' WHEN is_cnt THEN 'aggregate'
         WHEN is_agg THEN 'aggregate' WHEN is_rank THEN 'ranking' WHEN is_ana THEN 'analytical'
         WHEN is_list THEN 'list' WHEN is_det THEN 'detail' ELSE 'simple_fact' END AS query_type,
    CASE WHEN is_loc OR is_outlet_word THEN 'outlet' ELSE 'product' END AS entity,
    concat_ws(',', {metrics}) AS metrics,
    city_match AS filter_city,
    CASE {cats} END AS filter_category,
    CASE WHEN pmin <> '' THEN TRY_CAST(pmin AS BIGINT) END AS price_min,
    CASE WHEN pmax <> '' THEN TRY_CAST(pmax AS BIGINT) END AS price_max,
    CASE WHEN rmin <> '' THEN TRY_CAST(rmin AS DOUBLE) END AS rating_min,
    CASE WHEN NOT (is_loc OR is_cmp OR is_cnt OR is_agg) AND is_rank THEN
      CASE WHEN {rx(I.MAX_WORDS)} THEN 'max' WHEN {rx(I.MIN_WORDS)} THEN 'min' END END AS superlative,
    array_to_string(list_concat(
      CASE WHEN is_cmp AND NOT is_loc AND ca <> ''
           THEN [{strip.format(x="ca")}, {strip.format(x="cb")}] ELSE []::VARCHAR[] END,
      CASE WHEN (is_loc OR is_outlet_word) AND outlet_match IS NOT NULL THEN [outlet_match] ELSE []::VARCHAR[] END,
      CASE WHEN is_loc OR is_outlet_word THEN quoted ELSE []::VARCHAR[] END), ' | ') AS comparison_entities,
    CASE WHEN is_loc OR is_cmp THEN NULL WHEN is_cnt THEN 'count'
         WHEN is_agg THEN CASE WHEN contains(q, 'total') OR contains(q, 'sum') THEN 'total'
                               WHEN contains(q, 'average') OR contains(q, 'mean') THEN 'average'
                               WHEN contains(q, 'median') THEN 'median' END END AS aggregate_type,
    CASE WHEN NOT (is_loc OR is_cmp OR is_cnt OR is_agg) AND is_rank THEN
      CASE WHEN rank_txt <> '' THEN TRY_CAST(rank_txt AS BIGINT) WHEN rank_one THEN 1 ELSE 5 END END AS ranking_n,
    (NOT (is_loc OR is_cmp OR is_cnt OR is_agg OR is_rank) AND is_ana) AS needs_calculation,
    concat_ws(',', {qwords}) AS question_words,
    q AS raw_question
  FROM qf)
"""


def _intent_sql() -> dict[str, str]:
    blocks = (*ALL_ENRICH, question_cte(), intents_ctes())
    return {"intents": with_ctes(*blocks, body="SELECT * FROM intents")}


# columns of the document texts, in their order
DOC_TEXTS = {
    "outlet": ["outlet_id", "outlet", "city", "total_revenue", "total_units_sold", "unique_customers", "avg_quality_score",
               "avg_sentiment_signal", "outlet_score"],
    "product": ["product_id", "product_name", "category", "price", "units_sold_total", "revenue_total", "avg_quality_score",
                "avg_sentiment_signal", "product_score"],
}


def doc_cte(products: bool = True) -> str:
    def part(c):
        return f"'{c}: ' || COALESCE(CAST({c} AS VARCHAR), 'nan')"
    sides = [f"SELECT 'master_{t}:' || {t}_id AS id, 'master_{t}' AS source, '{t}' AS tbl, {t}_id AS pk, "
             + " || ' | ' || ".join(part(c) for c in DOC_TEXTS[t]) + f" AS text FROM master_{t}" for t in ("outlet", "product")[:1 + products]]
    return "doc AS (" + " UNION ALL ".join(sides) + ")"


# counts of words in 384 buckets by md5, as unit vectors of single precision, made unit again
VECTOR_CTES = r"""
d_tf AS (SELECT id, b, COUNT(*) AS tf FROM (
    SELECT id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 384 AS b
    FROM (SELECT id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM doc)) GROUP BY id, b),
d_u AS (SELECT id, b, CAST(tf / n AS FLOAT) AS u FROM d_tf JOIN (SELECT id, sqrt(SUM(tf * tf)) AS n FROM d_tf GROUP BY id) USING (id))
"""
HIT_CTES = VECTOR_CTES + r""",
d_v AS (SELECT id, b, u::DOUBLE / n AS v FROM d_u JOIN (SELECT id, sqrt(SUM(u::DOUBLE * u::DOUBLE)) AS n FROM d_u GROUP BY id) USING (id)),
need AS (SELECT i.q_id, s.question FROM intents i JOIN qs s USING (q_id) WHERE {need} AND regexp_matches(COALESCE(s.question, ''), '[\p{L}\p{N}_]')),
q_tf AS (SELECT q_id, b, COUNT(*) AS tf FROM (
    SELECT q_id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 384 AS b
    FROM (SELECT q_id, unnest(regexp_extract_all(lower(question), '[\p{L}\p{N}_]+')) AS w FROM need)) GROUP BY q_id, b),
q_u AS (SELECT q_id, b, CAST(tf / n AS FLOAT) AS u FROM q_tf JOIN (SELECT q_id, sqrt(SUM(tf * tf)) AS n FROM q_tf GROUP BY q_id) USING (q_id)),
q_v AS (SELECT q_id, b, u::DOUBLE / n AS v FROM q_u JOIN (SELECT q_id, sqrt(SUM(u::DOUBLE * u::DOUBLE)) AS n FROM q_u GROUP BY q_id) USING (q_id)),
met AS (SELECT q_id, id, SUM(q_v.v * d_v.v) AS sc FROM q_v JOIN d_v USING (b) GROUP BY q_id, id),
found AS (SELECT q_id, id, source, tbl, pk, score, ROW_NUMBER() OVER (PARTITION BY q_id ORDER BY score DESC, id) AS rank
          FROM (SELECT n.q_id, d.id, d.source, d.tbl, d.pk, ROUND(COALESCE(m.sc, 0), 9) AS score
                FROM need n CROSS JOIN doc d LEFT JOIN met m ON m.q_id = n.q_id AND m.id = d.id) QUALIFY rank <= 5)
"""

EVIDENCE_CTES = r"""
ents AS (SELECT e.q_id, e.query_type, t.i - 1 AS i, lower(x[t.i]) AS ent
         FROM (SELECT q_id, query_type, string_split(comparison_entities, ' | ') AS x FROM eff
               WHERE query_type IN ('location', 'comparison', 'detail', 'simple_fact') AND comparison_entities <> '') e,
              unnest(range(1, len(x) + 1)) AS t(i)),
named AS (SELECT n.q_id, n.query_type, n.i, n.ent, r.name_l = n.ent AS exact, r.tbl, r.pk
          FROM ents n JOIN eff_rows r ON n.q_id = r.q_id AND contains(r.name_l, n.ent)),
firsts AS (
  SELECT q_id, query_type, i, exact, ent, tbl, pk,
         ROW_NUMBER() OVER (PARTITION BY q_id, i ORDER BY TRY_CAST(pk AS DOUBLE) NULLS LAST, pk) AS rn_any,
         ROW_NUMBER() OVER (PARTITION BY q_id, i, exact ORDER BY TRY_CAST(pk AS DOUBLE) NULLS LAST, pk) AS rn_exact
  FROM named),
placed AS (
  SELECT r.q_id, e.query_type, e.filter_city, CASE WHEN COALESCE(e.ranking_n, 0) = 0 THEN 5 ELSE e.ranking_n END AS n, r.tbl, r.pk,
         ROW_NUMBER() OVER (PARTITION BY r.q_id ORDER BY TRY_CAST(r.pk AS DOUBLE) NULLS LAST, r.pk) AS by_file,
         ROW_NUMBER() OVER (PARTITION BY r.q_id ORDER BY r.perf DESC NULLS LAST, TRY_CAST(r.pk AS DOUBLE) NULLS LAST, r.pk) AS by_perf,
         ROW_NUMBER() OVER (PARTITION BY r.q_id ORDER BY
           (CASE WHEN COALESCE(e.superlative, '') = 'min' THEN 1 ELSE -1 END) *
           (CASE WHEN contains(',' || e.metrics || ',', ',price,') AND e.tbl = 'product' THEN r.price
                 WHEN contains(',' || e.metrics || ',', ',revenue,') THEN r.revenue
                 WHEN contains(',' || e.metrics || ',', ',volume,') THEN r.units
                 WHEN contains(',' || e.metrics || ',', ',rating,') THEN r.rating
                 WHEN contains(',' || e.metrics || ',', ',customers,') AND e.tbl = 'outlet' THEN r.customers
                 ELSE r.perf END) ASC NULLS LAST, TRY_CAST(r.pk AS DOUBLE) ASC NULLS LAST, r.pk) AS by_rank
  FROM eff e JOIN eff_rows r ON e.q_id = r.q_id),
options AS (
  SELECT q_id, 0 AS way, by_rank AS pos, 'row' AS kind, tbl, pk FROM placed WHERE query_type = 'ranking' AND by_rank <= n
  UNION ALL SELECT q_id, 0, by_file, 'row', tbl, pk FROM placed WHERE query_type = 'list' AND by_file <= 50
  UNION ALL SELECT q_id, 0, by_perf, 'row', tbl, pk FROM placed WHERE query_type = 'analytical' AND by_perf <= 3
  UNION ALL SELECT q_id, 0, 0, 'summary', tbl, NULL FROM eff WHERE query_type = 'analytical'
  UNION ALL SELECT q_id, 0, 1, 'agg', tbl, NULL FROM eff WHERE query_type = 'aggregate'
  UNION ALL SELECT q_id, 1 + 2 * i + CASE WHEN exact THEN 0 ELSE 1 END, 1, 'row', tbl, pk FROM firsts WHERE query_type = 'location' AND rn_exact = 1
  UNION ALL SELECT q_id, 1000000, by_file, 'row', tbl, pk FROM placed WHERE query_type = 'location' AND filter_city IS NOT NULL AND by_file <= 10
  UNION ALL SELECT q_id, 2000000, 1, 'doc', 'outlet', arg_min(pk, rank) FROM found WHERE source = 'master_outlet'
            AND q_id IN (SELECT q_id FROM eff WHERE query_type = 'location') GROUP BY q_id
  UNION ALL SELECT q_id, 3000000, by_file, 'row', tbl, pk FROM placed WHERE query_type = 'location' AND by_file <= 20
  UNION ALL SELECT q_id, 0, i + 1, 'row', tbl, pk FROM firsts WHERE query_type = 'comparison' AND rn_any = 1 AND trim(ent) <> ''
  UNION ALL SELECT q_id, 1, by_perf, 'row', tbl, pk FROM placed WHERE query_type = 'comparison' AND by_perf <= 2
  UNION ALL SELECT q_id, i, 1, 'row', tbl, pk FROM firsts WHERE query_type IN ('detail', 'simple_fact') AND rn_any = 1
  UNION ALL SELECT q_id, 2000000, 1, 'doc', tbl, pk FROM found WHERE rank = 1 AND q_id IN (SELECT q_id FROM eff WHERE query_type IN ('detail', 'simple_fact'))
  UNION ALL SELECT q_id, 3000000, 1, 'row', tbl, pk FROM placed WHERE query_type IN ('detail', 'simple_fact') AND by_perf = 1),
taken AS (SELECT * FROM options WHERE (q_id, way) IN (SELECT (q_id, MIN(way)) FROM options GROUP BY q_id)),
records AS (
  SELECT 'row' AS kind, 'outlet' AS tbl, outlet_id AS pk, {n_eo} AS n_fields, outlet AS name, city AS grp, CAST(total_revenue AS VARCHAR) AS revenue FROM e_outlet
  UNION ALL SELECT 'row', 'product', product_id, {n_ep}, product_name, category, CAST(revenue_total AS VARCHAR) FROM e_product
  UNION ALL SELECT 'doc', 'outlet', outlet_id, {n_mo}, outlet, city, CAST(total_revenue AS VARCHAR) FROM master_outlet
  UNION ALL SELECT 'doc', 'product', product_id, {n_mp}, product_name, category, CAST(revenue_total AS VARCHAR) FROM master_product)
"""

# columns of the masters, as stored and enriched
N_FIELDS = {"mo": 25, "mp": 21, "eo": 30, "ep": 27}
READS = "i.query_type IN ('location', 'detail', 'simple_fact')"
ABOUT_PRODUCTS = "(i.query_type <> 'location' AND i.entity <> 'outlet')"


def _evidence_sql() -> dict[str, str]:
    blocks = (*ALL_ENRICH, question_cte(), intents_ctes())
    q = {}
    q["evidence"] = with_ctes(*blocks, SELECTION_CTES, doc_cte(), HIT_CTES.replace("{need}", READS),
                              EVIDENCE_CTES.format(n_eo=N_FIELDS["eo"], n_ep=N_FIELDS["ep"], n_mo=N_FIELDS["mo"], n_mp=N_FIELDS["mp"]), body="""
SELECT t.q_id, CAST(t.pos AS INTEGER) AS pos, t.kind, t.tbl, t.pk, ROUND(CASE WHEN t.kind = 'doc' THEN f.score ELSE 1.0 END, 6) AS score,
       CAST(r.n_fields AS BIGINT) AS n_fields, r.name, r.grp, r.revenue
FROM taken t LEFT JOIN found f ON t.kind = 'doc' AND f.q_id = t.q_id AND f.tbl = t.tbl AND f.pk = t.pk
     LEFT JOIN records r ON r.kind = t.kind AND r.tbl = t.tbl AND r.pk = t.pk""")
    # without products every product question reads the five nearest documents, which are outlets
    q["select_fallback"] = with_ctes(*blocks, SELECTION_CTES, doc_cte(products=False), HIT_CTES.replace("{need}", f"({READS} OR {ABOUT_PRODUCTS})"),
                                     EVIDENCE_CTES.format(n_eo=0, n_ep=0, n_mo=0, n_mp=0), body="""
SELECT f.q_id, CAST(f.rank AS INTEGER) AS pos, f.tbl, f.pk, ROUND(f.score, 6) AS score
FROM found f JOIN eff e USING (q_id) WHERE e.tbl = 'product'
UNION ALL
SELECT t.q_id, CAST(t.pos AS INTEGER), t.tbl, t.pk, ROUND(f.score, 6)
FROM taken t JOIN eff e ON e.q_id = t.q_id AND e.tbl = 'outlet' JOIN found f ON f.q_id = t.q_id AND f.tbl = t.tbl AND f.pk = t.pk
WHERE t.kind = 'doc'""")
    q["embed_documents"] = with_ctes(*ALL_MASTER, doc_cte(), VECTOR_CTES, body="""
SELECT d.id, d.source, d.pk, list_transform(range(0, 384), lambda i: COALESCE(m[i], 0.0)::FLOAT) AS embedding
FROM doc d JOIN (SELECT id, map(list(b), list(u)) AS m FROM d_u GROUP BY id) USING (id)""")
    q["retrieve_fallback"] = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e,
         sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS n FROM embeddings),
u AS (SELECT vec_id, list_transform(e, lambda x: x / CASE WHEN n = 0 OR isnan(n) THEN 1.0 ELSE n END) AS e FROM v),
s AS (SELECT a.vec_id AS q_id, CAST(b.vec_id AS VARCHAR) AS id, list_dot_product(a.e, b.e) AS sc FROM u a, u b WHERE a.vec_id % 10 = 0)
SELECT 'all' AS index, q_id, id, CAST(rank AS INTEGER) AS rank, ROUND(sc, 6) AS score, NULL AS fallback FROM (
  SELECT q_id, id, sc, ROW_NUMBER() OVER (PARTITION BY q_id ORDER BY sc DESC, id) AS rank FROM s) WHERE rank <= 5
UNION ALL
SELECT 'none', vec_id, NULL, 1, 0.0, 'No index available—build it first.' FROM embeddings WHERE vec_id % 10 = 0"""
    q["answer_texts"] = r"""
WITH c AS (SELECT conv_id, role, text, conv_id * 100000 + turn AS q_id FROM conversations),
a AS (SELECT q_id, CASE WHEN conv_id % 11 <> 3 THEN text END AS question FROM c WHERE role = 'user'
      UNION ALL SELECT q_id, text FROM c WHERE role = 'user' AND conv_id % 13 = 5),
n AS (SELECT *, COUNT(*) OVER (PARTITION BY q_id) AS times FROM a)
SELECT n.q_id, CASE WHEN n.question IS NULL THEN 'Error processing query: question is null'
                    WHEN times > 1 THEN 'Error processing query: question id is not unique'
                    WHEN r.q_id IS NULL THEN 'Error processing query: no reply'
                    ELSE regexp_replace(r.text, '^\s+|\s+$', '', 'g') END AS answer
FROM n LEFT JOIN (SELECT q_id - 1 AS q_id, text FROM c WHERE role = 'assistant') r ON r.q_id = n.q_id"""
    return q


def _doc_sql() -> dict[str, str]:
    docs = with_ctes(*ALL_MASTER, doc_cte(), body="SELECT id, source, pk, text FROM doc")
    topk = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e,
         sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS n FROM embeddings),
u AS (SELECT vec_id, list_transform(e, lambda x: x / CASE WHEN n = 0 OR isnan(n) THEN 1.0 ELSE n END) AS e FROM v),
s AS (SELECT a.vec_id AS q_id, CAST(b.vec_id AS VARCHAR) AS id, list_dot_product(a.e, b.e) AS sc FROM u a, u b)
SELECT q_id, id, CAST(rank AS INTEGER) AS rank, ROUND(sc, 6) AS score FROM (
  SELECT q_id, id, sc, ROW_NUMBER() OVER (PARTITION BY q_id ORDER BY sc DESC, id) AS rank FROM s) WHERE rank <= 5
"""
    return {"documents": docs, "retrieve_topk": topk}


# columns whose availability is told, by table
FLAGS = [
    ("availability_flags", "outlet", ["total_sales", "total_units_sold", "total_revenue", "unique_customers", "avg_employee_rating",
                                      "total_promotion_cost", "avg_transportation_cost", "total_reviews", "avg_quality_score"]),
    ("availability_flags_product", "product", ["units_sold_total", "revenue_total", "num_outlets_selling", "total_reviews", "avg_quality_score",
                                               "avg_sentiment_signal", "total_profit"]),
]


def _misc_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["extract_answer"] = r"""
SELECT conv_id, turn,
       CASE WHEN turn % 4 = 3 THEN text ELSE regexp_replace(text, '^\s+|\s+$', '', 'g') END AS answer
FROM conversations WHERE role = 'assistant'"""
    q["chat_messages"] = """
SELECT conv_id, COUNT(*) AS n_messages, string_agg(COALESCE(role, 'user'), ',' ORDER BY turn) AS roles,
       CAST(SUM(length(COALESCE(text, ''))) AS BIGINT) AS content_chars,
       sha256(string_agg(COALESCE(role, 'user') || chr(10) || COALESCE(text, '') || chr(10), ''
                         ORDER BY turn, COALESCE(role, 'user'), COALESCE(text, ''))) AS messages_sha256
FROM conversations GROUP BY conv_id"""
    q["best_outlet"] = with_ctes(*ALL_ENRICH, body="""
SELECT b.outlet, b.city, b.score, b.revenue,
       CASE WHEN b.outlet IS NOT NULL OR b.found THEN 'Highest weighted performance (40% revenue + 30% customers + 30% score)' END AS why,
       CASE WHEN NOT COALESCE(b.found, FALSE) THEN 'No outlets found for filters.' END AS error
FROM (SELECT 1 AS one) x LEFT JOIN (
  SELECT outlet, city, performance_score AS score, total_revenue AS revenue, TRUE AS found
  FROM e_outlet ORDER BY performance_score DESC, outlet_id LIMIT 1) b ON TRUE""")
    q["best_product"] = with_ctes(*ALL_ENRICH, body="""
SELECT b.product, b.category, b.score, b.revenue,
       CASE WHEN b.found THEN 'Highest weighted performance (40% revenue + 30% units + 30% score)' END AS why,
       CASE WHEN NOT COALESCE(b.found, FALSE) THEN 'No products found for filters.' END AS error
FROM (SELECT 1 AS one) x LEFT JOIN (
  SELECT product_name AS product, category, performance_score AS score, revenue_total AS revenue, TRUE AS found
  FROM e_product WHERE regexp_matches(category, '(?i)promo')
  ORDER BY performance_score DESC, product_id LIMIT 1) b ON TRUE""")
    for key, table, columns in FLAGS:
        flags = ", ".join(f"({c} IS NOT NULL AND {c} <> 0) AS {c}_available" for c in columns)
        q[key] = with_ctes(*ALL_MASTER, body=f"SELECT {table}_id, {flags} FROM master_{table}")
    q["minmax_normalize"] = with_ctes(*ALL_MASTER, body="""
SELECT outlet_id,
  CASE WHEN r1 = r0 THEN 0.0 ELSE (total_revenue - r0) / (r1 - r0) END AS norm_revenue,
  CASE WHEN q1 = q0 THEN 0.0 ELSE (avg_quality_score - q0) / (q1 - q0) END AS norm_quality,
  CASE WHEN e1 = e0 THEN 0.0 ELSE (avg_employee_rating - e0) / (e1 - e0) END AS norm_employee,
  CASE WHEN s1 = s0 THEN 0.0 ELSE (avg_sentiment_signal - s0) / (s1 - s0) END AS norm_sentiment,
  CASE WHEN c1 = c0 THEN 0.0 ELSE (CAST(unique_customers AS DOUBLE) - c0) / (c1 - c0) END AS norm_customers,
  outlet_score
FROM master_outlet, s_outlet""")
    q["profile_tables"] = _profile_sql()
    return q


# (logical table, CTE, [(column, numeric?)]) in the column order the Spark model tables have
PROFILE_LAYOUT = [
    ("outlet", "m_outlet", [("outlet_id", 0), ("outlet", 0), ("city", 0)]),
    ("menu", "m_menu", [("product_id", 0), ("product_name", 0), ("category", 0), ("price", 1), ("product_cost", 1)]),
    ("outlet_menu", "m_bridge", [("outlet_menu_id", 0), ("outlet_id", 0), ("product_id", 0)]),
    ("order", "p_order", [("outlet_menu_id", 0), ("customer_id", 0), ("quantity", 1), ("unit_price", 1), ("date", 0)]),
    ("daily_sales", "p_daily", [("outlet_product_id", 0), ("date", 0), ("sales", 1)]),
    ("review", "p_review", [("outlet_menu_id", 0), ("review_id", 0), ("positive_score", 1), ("negative_score", 1),
                            ("neutral_score", 1)]),
    ("food_quality", "m_quality", [("outlet_menu_id", 0), ("total_stage", 1), ("quality_status", 0)]),
    ("transportation", "m_transport", [("outlet_menu_id", 0), ("transportation_cost", 1)]),
    ("promotion", "m_promotion", [("outlet_id", 0), ("cost", 1), ("sources", 0), ("products", 1)]),
    ("employment", "m_employment", [("outlet_id", 0), ("position_id", 0), ("performance_rating", 1)]),
]

PROFILE_EXTRA_CTES = r"""
p_order AS (
  SELECT CAST(l_suppkey AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) AS outlet_menu_id,
         CAST(o_custkey AS VARCHAR) AS customer_id,
         CAST(l_quantity AS DECIMAL(18,2)) AS quantity, CAST(l_extendedprice AS DECIMAL(18,2)) AS unit_price,
         CAST(l_shipdate AS DATE) AS date
  FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey),
p_daily AS (SELECT outlet_product_id, d AS date, sales FROM m_daily),
p_review AS (
  SELECT CAST(l_suppkey AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) AS outlet_menu_id,
         CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS review_id,
         CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS positive_score,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS negative_score,
         CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS neutral_score
  FROM lineitem)
"""


PROFILE_TYPES = {
    "price": "decimal(18,2)", "product_cost": "decimal(18,2)", "quantity": "decimal(18,2)", "unit_price": "decimal(18,2)", "date": "date",
    "sales": "decimal(28,2)", "positive_score": "int", "negative_score": "int", "neutral_score": "int", "total_stage": "decimal(18,4)",
    "transportation_cost": "decimal(18,4)", "cost": "decimal(18,2)", "products": "decimal(18,0)", "performance_rating": "decimal(18,6)",
}


def _source_sql() -> dict[str, str]:
    parts = []
    for table, cte, cols in PROFILE_LAYOUT:
        if table in ("outlet", "menu", "outlet_menu", "order", "promotion", "employment"):
            for c, _ in cols:
                parts.append(f"""
SELECT '{table}' AS "table", '{c}' AS "column", COUNT(*) AS rows, CAST(SUM(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing,
       (SELECT COALESCE(string_agg(v, ', ' ORDER BY v), '') FROM (
          SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM {cte} WHERE {c} IS NOT NULL ORDER BY v LIMIT 5)) AS examples
FROM {cte}""")
    parts.append("""
SELECT 'customer', 'note', COUNT(*), CAST(SUM(CASE WHEN COALESCE(text, '') = '' THEN 1 ELSE 0 END) AS BIGINT), CAST(SUM(length(text)) AS VARCHAR) FROM documents""")
    q = {"load_tables": with_ctes(MODEL_CTES, PROFILE_EXTRA_CTES, body=" UNION ALL ".join(parts))}
    types = ", ".join(f"('{c}', '{t}')" for c, t in PROFILE_TYPES.items())
    q["profile_report"] = f"""
SELECT printf('| %s | %s | %d | %.2f | %d | %.2f | %s |', p."column", COALESCE(t.dtype, 'string'), p.n_missing, p.pct_missing, p.n_zeros, p.pct_zeros,
              array_to_string(string_split(p.examples, ', ')[1:3], ', ')) AS line
FROM ({_profile_sql()}) p LEFT JOIN (VALUES {types}) t(c, dtype) ON t.c = "column" """
    q["stored_documents"] = with_ctes(*ALL_MASTER, doc_cte(), body="""
SELECT d.id, d.source, d.pk, d.text, COALESCE(o.outlet_score, p.product_score) AS score, 384 AS dimensions
FROM doc d LEFT JOIN master_outlet o ON d.tbl = 'outlet' AND d.pk = o.outlet_id LEFT JOIN master_product p ON d.tbl = 'product' AND d.pk = p.product_id""")
    q["sanitize_values"] = """
SELECT vec_id, x, label, x AS y, 't' AS z, x AS m0, 1.5::DOUBLE AS m1
FROM (SELECT vec_id, label, CASE WHEN vec_id % 3 < 2 THEN 0.0 ELSE embedding[1]::DOUBLE END AS x FROM embeddings)"""
    return q


def _profile_sql() -> str:
    parts = []
    for table, cte, cols in PROFILE_LAYOUT:
        for pos, (c, numeric) in enumerate(cols):
            zero = f"SUM(CASE WHEN {c} = 0 THEN 1 ELSE 0 END)" if numeric else "0"
            parts.append(f"""
SELECT '{table}' AS "table", '{c}' AS "column", {pos} AS position, COUNT(*) AS rows,
       CAST(SUM(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing,
       CAST(SUM(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS DOUBLE) / GREATEST(COUNT(*), 1) AS pct_missing,
       CAST({zero} AS BIGINT) AS n_zeros,
       CAST({zero} AS DOUBLE) / GREATEST(COUNT(*), 1) AS pct_zeros,
       (SELECT COALESCE(string_agg(v, ', ' ORDER BY v), '') FROM (
          SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM {cte} WHERE {c} IS NOT NULL ORDER BY v LIMIT 5)) AS examples
FROM {cte}""")
    return with_ctes(MODEL_CTES, PROFILE_EXTRA_CTES, body=" UNION ALL ".join(parts))


SELECTION_CTES = r"""
fq AS (
  SELECT i.q_id, i.query_type, i.entity, i.filter_city, i.aggregate_type, i.comparison_entities, i.metrics, i.ranking_n, i.superlative,
         CASE WHEN i.query_type = 'location' OR i.entity = 'outlet' THEN 'outlet' ELSE 'product' END AS tbl,
         lower(i.filter_city) AS f_city, lower(i.filter_category) AS f_cat,
         CASE WHEN i.price_min <> 0 THEN CAST(i.price_min AS DOUBLE) END AS pmin,
         CASE WHEN i.price_max <> 0 THEN CAST(i.price_max AS DOUBLE) END AS pmax,
         CASE WHEN i.rating_min <> 0 THEN i.rating_min END AS rmin
  FROM intents i),
rows_all AS (
  SELECT 'outlet' AS tbl, outlet_id AS pk, lower(outlet) AS name_l, lower(city) AS city_l, CAST(NULL AS VARCHAR) AS cat_l,
         CAST(NULL AS DOUBLE) AS price, total_revenue AS revenue, total_units_sold AS units,
         avg_quality_score AS rating, CAST(unique_customers AS DOUBLE) AS customers, performance_score AS perf
  FROM e_outlet
  UNION ALL
  SELECT 'product', product_id, lower(product_name), NULL, lower(category), price, revenue_total, units_sold_total,
         avg_quality_score, NULL, performance_score
  FROM e_product),
pairs AS (
  SELECT fq.q_id, r.pk
  FROM fq JOIN rows_all r ON r.tbl = fq.tbl
  WHERE (fq.tbl <> 'outlet' OR fq.f_city IS NULL OR r.city_l = fq.f_city)
    AND (fq.tbl <> 'product' OR fq.f_cat IS NULL OR contains(r.cat_l, fq.f_cat))
    AND (fq.tbl <> 'product' OR fq.pmin IS NULL OR r.price >= fq.pmin)
    AND (fq.tbl <> 'product' OR fq.pmax IS NULL OR r.price <= fq.pmax)
    AND (fq.rmin IS NULL OR r.rating >= fq.rmin)),
sel AS (SELECT q_id, COUNT(*) AS n_sel FROM pairs GROUP BY q_id),
eff AS (
  SELECT fq.*, COALESCE(sel.n_sel, 0) > 0 AS filtered FROM fq LEFT JOIN sel ON fq.q_id = sel.q_id),
eff_rows AS (
  SELECT e.q_id, r.* FROM eff e JOIN pairs p ON e.q_id = p.q_id JOIN rows_all r ON r.tbl = e.tbl AND r.pk = p.pk
  WHERE e.filtered
  UNION ALL
  SELECT e.q_id, r.* FROM eff e JOIN rows_all r ON r.tbl = e.tbl WHERE NOT e.filtered)
"""


# the first row whose name holds the entity, for each compared entity that is not blank
NAMES_CTE = r"""
ents AS (SELECT e.q_id, t.i AS pos, lower(x[t.i]) AS ent
         FROM (SELECT q_id, string_split(comparison_entities, ' | ') AS x FROM eff
               WHERE query_type = 'comparison' AND comparison_entities <> '') e, unnest(range(1, len(x) + 1)) AS t(i)),
hits AS (SELECT q_id, pos, tbl, pk FROM (
    SELECT n.q_id, n.pos, r.tbl, r.pk,
           ROW_NUMBER() OVER (PARTITION BY n.q_id, n.pos ORDER BY TRY_CAST(r.pk AS DOUBLE) NULLS LAST, r.pk) AS rn
    FROM ents n JOIN eff_rows r ON n.q_id = r.q_id AND contains(r.name_l, n.ent) WHERE trim(n.ent) <> '') WHERE rn = 1)
"""


def _selection_sql() -> dict[str, str]:
    blocks = (*ALL_ENRICH, question_cte(), intents_ctes(), SELECTION_CTES)
    q = {}
    q["filter_or_all"] = with_ctes(*blocks, body="""
SELECT e.q_id, e.tbl, COUNT(*) AS n_rows, SUM(CAST('0x' || substr(md5(r.pk), 1, 8) AS BIGINT))::BIGINT AS key_sum,
       MIN(r.pk) AS first_key, MAX(r.pk) AS last_key, e.filtered
FROM eff e JOIN eff_rows r ON e.q_id = r.q_id GROUP BY e.q_id, e.tbl, e.filtered""")
    q["handle_list"] = with_ctes(*blocks, body="""
SELECT q_id, CAST(pos AS INTEGER) AS pos, tbl, pk FROM (
  SELECT r.q_id, r.tbl, r.pk, ROW_NUMBER() OVER (PARTITION BY r.q_id ORDER BY TRY_CAST(r.pk AS DOUBLE) NULLS LAST, r.pk) AS pos
  FROM eff e JOIN eff_rows r ON e.q_id = r.q_id WHERE e.query_type = 'list')
WHERE pos <= 50""")
    q["handle_comparison"] = with_ctes(*blocks, NAMES_CTE, body="""
SELECT q_id, CAST(pos AS INTEGER) AS pos, tbl, pk FROM hits
UNION ALL
SELECT q_id, CAST(pos AS INTEGER) AS pos, tbl, pk FROM (
  SELECT r.q_id, r.tbl, r.pk, ROW_NUMBER() OVER (PARTITION BY r.q_id ORDER BY r.perf DESC NULLS LAST, TRY_CAST(r.pk AS DOUBLE) NULLS LAST, r.pk) AS pos
  FROM eff e JOIN eff_rows r ON e.q_id = r.q_id
  WHERE e.query_type = 'comparison' AND e.q_id NOT IN (SELECT q_id FROM hits))
WHERE pos <= 2""")
    aggregates = """
SELECT e.q_id, e.tbl, e.aggregate_type AS agg_type,
       CASE WHEN e.aggregate_type = 'count' THEN COUNT(*) END AS count,
       CASE WHEN e.aggregate_type = 'count' THEN e.entity END AS entity_type,
       CASE WHEN e.aggregate_type = 'total' THEN trunc(SUM(CAST(r.revenue AS DECIMAL(38,4)))::DOUBLE)::BIGINT END AS total_revenue,
       CASE WHEN e.aggregate_type = 'total' THEN trunc(SUM(CAST(r.units AS DECIMAL(38,4)))::DOUBLE)::BIGINT END AS total_units,
       CASE WHEN e.aggregate_type = 'average' AND e.priced THEN round_even(SUM(CAST(r.price AS DECIMAL(38,4)))::DOUBLE / COUNT(r.price), 2) END AS average_price,
       CASE WHEN e.aggregate_type = 'average' THEN round_even(SUM(CAST(r.revenue AS DECIMAL(38,4)))::DOUBLE / COUNT(r.revenue), 2) END AS average_revenue,
       CASE WHEN e.aggregate_type = 'median' AND e.priced THEN round_even(MEDIAN(CAST(r.price AS DOUBLE)), 2) END AS median_price
FROM (SELECT *, contains(',' || metrics || ',', ',price,') AND tbl = 'product' AS priced FROM eff) e JOIN eff_rows r ON e.q_id = r.q_id
WHERE e.query_type = 'aggregate' GROUP BY e.q_id, e.tbl, e.aggregate_type, e.entity, e.priced"""
    q["handle_aggregate"] = with_ctes(*blocks, body=aggregates)
    grouped = "format('{{:,}}', CAST(trunc({c}) AS BIGINT)) || regexp_extract(CAST({c} AS VARCHAR), '\\.[0-9]+$')"
    q["build_prompt"] = with_ctes(*blocks, f"aggs AS ({aggregates})", body=f"""
SELECT a.q_id, 'user' AS role, 'Question: ' || COALESCE(s.question, '') || chr(10) || chr(10) || concat_ws(chr(10), 'AGGREGATE RESULTS:',
       'Count: ' || format('{{:,}}', a.count), 'Entity Type: ' || a.entity_type,
       'Total Revenue: ₹' || format('{{:,}}', a.total_revenue), 'Total Units: ' || format('{{:,}}', a.total_units),
       'Average Price: ' || {grouped.format(c="a.average_price")}, 'Average Revenue: ₹' || format('{{:,.0f}}', a.average_revenue),
       'Median Price: ' || {grouped.format(c="a.median_price")})
       || chr(10) || chr(10) || 'Provide a clear, accurate answer based ONLY on the data above.' AS content
FROM aggs a JOIN qs s USING (q_id)""")
    q["handle_analytical"] = with_ctes(*blocks, body="""
SELECT e.q_id, 0 AS pos, 'summary' AS kind, e.tbl, CAST(NULL AS VARCHAR) AS pk,
       round_even(AVG(r.perf), 2) AS avg_performance, round_even(STDDEV_SAMP(r.perf), 2) AS std_performance
FROM eff e JOIN eff_rows r ON e.q_id = r.q_id WHERE e.query_type = 'analytical' GROUP BY e.q_id, e.tbl
UNION ALL
SELECT q_id, CAST(pos AS INTEGER) AS pos, 'row', tbl, pk, NULL, NULL FROM (
  SELECT r.q_id, r.tbl, r.pk, ROW_NUMBER() OVER (PARTITION BY r.q_id ORDER BY r.perf DESC NULLS LAST, TRY_CAST(r.pk AS DOUBLE) NULLS LAST, r.pk) AS pos
  FROM eff e JOIN eff_rows r ON e.q_id = r.q_id WHERE e.query_type = 'analytical')
WHERE pos <= 3""")
    q["handle_ranking"] = with_ctes(*blocks, body="""
SELECT q_id, CAST(pos AS INTEGER) AS pos, tbl, pk FROM (
  SELECT r.q_id, r.tbl, r.pk,
         ROW_NUMBER() OVER (PARTITION BY r.q_id ORDER BY
           (CASE WHEN COALESCE(e.superlative, '') = 'min' THEN 1 ELSE -1 END) *
           (CASE WHEN contains(',' || e.metrics || ',', ',price,') AND e.tbl = 'product' THEN r.price
                 WHEN contains(',' || e.metrics || ',', ',revenue,') THEN r.revenue
                 WHEN contains(',' || e.metrics || ',', ',volume,') THEN r.units
                 WHEN contains(',' || e.metrics || ',', ',rating,') THEN r.rating
                 WHEN contains(',' || e.metrics || ',', ',customers,') AND e.tbl = 'outlet' THEN r.customers
                 ELSE r.perf END) ASC NULLS LAST,
           TRY_CAST(r.pk AS DOUBLE) ASC NULLS LAST, r.pk) AS pos,
         CASE WHEN COALESCE(e.ranking_n, 0) = 0 THEN 5 ELSE e.ranking_n END AS n
  FROM eff e JOIN eff_rows r ON e.q_id = r.q_id WHERE e.query_type = 'ranking')
WHERE pos <= n""")
    return q

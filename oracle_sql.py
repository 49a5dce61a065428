"""DuckDB oracle SQL for every registered query key.

Each statement computes a query's result in its own way on the logical tables, preceded by the
adapter CTEs that map the driver's tables onto those tables (the same mapping as
``cairn.sources.tables``).  Where the results need a convention:

* tie-breakers added where the reference order is not total (NTILE, running
  sums, LIMIT);
* ``PERCENTILE_CONT(p) OVER ()`` (not valid SQL) is written as a scalar
  ``quantile_cont`` over the same rows;
* integer results cast to BIGINT so both engines report the same types;
* money summed in exact integer cents, ROUND(quantity * unit_price * 100),
  with averages rounded at the cent: summing doubles makes the cent of an
  average depend on the summation order at half-cent ties (the mathematical
  value is the same).
"""

from __future__ import annotations

ADAPTER = """
WITH customers AS (
    SELECT c.c_custkey AS customer_id, c.c_name AS name, n.n_name AS country,
           c.c_mktsegment AS segment
    FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
),
products AS (
    SELECT p_partkey AS product_id, p_name AS name, p_type AS category,
           p_brand AS subcategory, p_retailprice AS unit_price,
           ROUND(p_retailprice * ((40 + p_size % 26) / 100), 2) AS cost_price
    FROM part
),
orders AS (
    SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS order_date,
           CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'returned'
                ELSE 'cancelled' END AS status,
           o_orderpriority AS channel
    FROM orders
),
order_items AS (
    SELECT l_orderkey AS order_id, l_partkey AS product_id, l_quantity AS quantity,
           l_extendedprice / l_quantity AS unit_price
    FROM lineitem
),
patients AS (
    SELECT event_id AS patient_id,
           CAST(50 + user_id % 35 AS INTEGER) AS age,
           CASE WHEN 50 + user_id % 35 > 49 AND 50 + user_id % 35 <= 59 THEN '50-59'
                WHEN 50 + user_id % 35 > 59 AND 50 + user_id % 35 <= 69 THEN '60-69'
                WHEN 50 + user_id % 35 > 69 AND 50 + user_id % 35 <= 79 THEN '70-79'
                WHEN 50 + user_id % 35 > 79 AND 50 + user_id % 35 <= 89 THEN '80-89'
           END AS age_group,
           CASE WHEN event_type IN ('click', 'signup') THEN 'treatment' ELSE 'control' END AS "group",
           value AS baseline_score,
           value + 8 + (event_id % 21) / 2.0
               + (CASE WHEN event_type IN ('click', 'signup') THEN 1 ELSE 0 END) * 10 AS followup_score,
           CAST(10 + (event_id * 37) % 31
               + (1 - CASE WHEN event_type IN ('click', 'signup') THEN 1 ELSE 0 END) * 10 AS INTEGER)
               AS recovery_days,
           event_id % 5 < 1 + 3 * (CASE WHEN event_type IN ('click', 'signup') THEN 1 ELSE 0 END)
               AS completed_programme,
           ROUND(value + 8 + (event_id % 21) / 2.0
               + (CASE WHEN event_type IN ('click', 'signup') THEN 1 ELSE 0 END) * 10 - value, 1)
               AS score_improvement
    FROM events
)
"""

SQL: dict[str, str] = {}

# Completed orders with their lines added up first: cents, lines.  Every sales statement starts from
# these rows, one per order, as the library does.
DONE = """
, line AS (SELECT order_id, product_id, quantity, ROUND(quantity * unit_price * 100) AS c FROM order_items),
basket AS (SELECT order_id, SUM(c) AS c, COUNT(*) AS lines FROM line GROUP BY order_id),
done AS (
    SELECT order_id, customer_id, order_date, channel, c, lines, DATE_TRUNC('month', order_date) AS month
    FROM orders JOIN basket USING (order_id)
    WHERE status = 'completed'
)
"""

# Units and cents of each product by status; a product's cost is its units times its unit cost.
SOLD = """
, line AS (SELECT order_id, product_id, quantity, ROUND(quantity * unit_price * 100) AS c FROM order_items),
sold AS (
    SELECT product_id, status, SUM(quantity) AS units, SUM(c) AS c
    FROM line JOIN orders USING (order_id) GROUP BY product_id, status
),
shelf AS (
    SELECT category, subcategory, units, c, ROUND(units * cost_price * 100) AS cost
    FROM sold JOIN products USING (product_id) WHERE status = 'completed'
)
"""

# One row per customer with a completed order.
BUYERS = DONE + """
, buyer AS (
    SELECT customer_id, name, country, segment, n, c, first_day, last_day
    FROM customers JOIN (
        SELECT customer_id, COUNT(*) AS n, SUM(c) AS c, MIN(order_date) AS first_day, MAX(order_date) AS last_day
        FROM done GROUP BY customer_id) USING (customer_id)
)
"""

SQL["monthly_revenue"] = DONE + """
SELECT month, COUNT(*) AS total_orders, COUNT(DISTINCT customer_id) AS unique_customers,
       SUM(c) / 100 AS gross_revenue, ROUND(SUM(c) / COUNT(*)) / 100 AS avg_order_value
FROM done GROUP BY month
"""

SQL["category_margin"] = SOLD + """
SELECT category, subcategory, u AS units_sold, r / 100 AS revenue, k / 100 AS total_cost,
       ROUND((r - k) / NULLIF(r, 0) * 100, 2) AS margin_pct, ROUND(r / whole * 100, 2) AS pct_of_category
FROM (SELECT category, subcategory, SUM(units) AS u, SUM(c) AS r, SUM(cost) AS k FROM shelf GROUP BY ALL)
JOIN (SELECT category, SUM(c) AS whole FROM shelf GROUP BY ALL) USING (category)
"""

SQL["category_performance"] = SOLD + """
SELECT category, r / 100 AS revenue, k / 100 AS cost, ROUND((r - k) / NULLIF(r, 0) * 100, 1) AS margin_pct
FROM (SELECT category, SUM(c) AS r, SUM(cost) AS k FROM shelf GROUP BY category)
"""

# Quartiles: ties by customer_id.  Percentiles are scalars over the same rows.
SQL["customer_ltv_segments"] = BUYERS + """
, mark AS (SELECT quantile_cont(c / 100, [0.4, 0.7, 0.9]) AS cuts FROM buyer)
SELECT customer_id, name, country, segment, n AS total_orders, c / 100 AS lifetime_value,
       first_day AS first_order, last_day AS last_order, DATE_DIFF('day', first_day, last_day) AS customer_tenure_days,
       CAST(NTILE(4) OVER (ORDER BY c, customer_id) AS BIGINT) AS ltv_quartile,
       ['At Risk', 'Potential', 'Loyal', 'Champions'][1 + len(list_filter(cuts, lambda x: c / 100 >= x))] AS rfm_segment
FROM buyer, mark
"""

# The ten are taken before the names are looked up; ties by product_id.
SQL["top_products_return_rate"] = SOLD + """
, best AS (
    SELECT product_id, COALESCE(SUM(units) FILTER (WHERE status = 'completed'), 0) AS u,
           COALESCE(SUM(units) FILTER (WHERE status = 'returned'), 0) AS back,
           COALESCE(SUM(c) FILTER (WHERE status = 'completed'), 0) / 100 AS r
    FROM sold GROUP BY product_id ORDER BY r DESC, product_id LIMIT 10
)
SELECT name, category, u AS units_sold, r AS revenue, ROUND(back / NULLIF(u, 0) * 100, 2) AS return_rate_pct
FROM best JOIN products USING (product_id)
"""

SQL["channel_performance"] = DONE + """
, by_channel AS (
    SELECT channel, COUNT(*) AS n, COUNT(DISTINCT customer_id) AS people, SUM(c) AS r, SUM(lines) AS l
    FROM done GROUP BY channel
)
SELECT channel, n AS orders, people AS customers, r / 100 AS revenue, ROUND(r / l) / 100 AS avg_item_value,
       ROUND(r / n) / 100 AS avg_order_value, ROUND(r / (SELECT SUM(c) FROM done) * 100, 2) AS revenue_share_pct
FROM by_channel
"""

SQL["channel_aov"] = DONE + """
SELECT channel, COUNT(*) AS orders, ROUND(AVG(c)) / 100 AS avg_order_value FROM done GROUP BY channel
"""

SQL["customer_ltv"] = BUYERS + """
SELECT customer_id, country, segment, n AS total_orders, c / 100 AS lifetime_value FROM buyer
"""

# A rank is one more than the number of better values; the dense rank counts distinct ones.
SQL["customer_rank_by_country"] = BUYERS + """
, level AS (
    SELECT country, c, COUNT(*) AS same,
           SUM(COUNT(*)) OVER w AS upto, COUNT(*) OVER w AS levels
    FROM buyer GROUP BY country, c
    WINDOW w AS (PARTITION BY country ORDER BY c DESC ROWS UNBOUNDED PRECEDING)
)
SELECT country, name, c / 100 AS total_revenue, CAST(1 + upto - same AS BIGINT) AS revenue_rank,
       levels AS revenue_dense_rank, ROUND(c / whole * 100, 2) AS pct_of_country_revenue
FROM buyer JOIN level USING (country, c) JOIN (SELECT country, SUM(c) AS whole FROM buyer GROUP BY country) USING (country)
"""

# Months are few: neighbours by month number, sums over earlier months by a join.
SQL["mom_growth"] = DONE + """
, m AS (SELECT month, SUM(c) AS c, row_number() OVER (ORDER BY month) AS i FROM done GROUP BY month),
t AS (
    SELECT a.i, SUM(b.c) AS upto, SUM(b.c) FILTER (WHERE b.i > a.i - 3) AS three,
           COUNT(*) FILTER (WHERE b.i > a.i - 3) AS k
    FROM m a JOIN m b ON b.i <= a.i GROUP BY a.i
)
SELECT m.month, m.c / 100 AS revenue, p.c / 100 AS prev_month_revenue,
       ROUND((m.c / 100 - p.c / 100) / NULLIF(p.c / 100, 0) * 100, 2) AS mom_growth_pct,
       upto / 100 AS cumulative_revenue, three / k / 100 AS rolling_3m_avg
FROM m JOIN t USING (i) LEFT JOIN m p ON p.i = m.i - 1
"""

# Ties of both orders by order_id.
SQL["order_value_distribution"] = DONE + """
SELECT order_id, order_date, c / 100 AS order_value, SUM(c) OVER by_day / 100 AS running_total,
       ROUND((RANK() OVER by_value - 1) / GREATEST((SELECT COUNT(*) FROM done) - 1, 1) * 100, 2) AS percentile,
       CAST(NTILE(10) OVER (ORDER BY c, order_id) AS BIGINT) AS decile
FROM done
WINDOW by_day AS (ORDER BY order_date, order_id ROWS UNBOUNDED PRECEDING), by_value AS (ORDER BY c)
"""

SQL["first_last_purchase"] = """
SELECT customer_id, a AS first_purchase_date, z AS last_purchase_date, n AS total_orders,
       DATE_DIFF('day', a, z) AS days_between_first_last
FROM (SELECT customer_id, MIN(order_date) AS a, MAX(order_date) AS z, COUNT(*) AS n
      FROM orders WHERE status = 'completed' GROUP BY customer_id)
"""

# A customer's cohort is the month of the first completed order: a window minimum over the orders.
# A cohort's size is its number of customers, who are all active in their first month.
RETENTION = """
, active AS (
    SELECT customer_id, DATE_TRUNC('month', order_date) AS month,
           MIN(DATE_TRUNC('month', order_date)) OVER (PARTITION BY customer_id) AS cohort_month
    FROM orders WHERE status = 'completed'
),
retention AS (
    SELECT cohort_month, people AS cohort_size, k AS months_since_first, n AS active_customers,
           ROUND(n / people * 100, 1) AS retention_pct
    FROM (SELECT cohort_month, DATE_DIFF('month', cohort_month, month) AS k, COUNT(DISTINCT customer_id) AS n
          FROM active GROUP BY ALL)
    JOIN (SELECT cohort_month, COUNT(DISTINCT customer_id) AS people FROM active GROUP BY ALL) USING (cohort_month)
)
"""

SQL["cohort_retention"] = RETENTION + "SELECT * FROM retention"

SQL["cohort_matrix"] = RETENTION + """
SELECT strftime(c.cohort_month, '%Y-%m') AS cohort, 'Month ' || p.k AS period, r.retention_pct
FROM (SELECT DISTINCT cohort_month FROM retention) c, (SELECT DISTINCT months_since_first AS k FROM retention) p
LEFT JOIN retention r ON (r.cohort_month, r.months_since_first) = (c.cohort_month, p.k)
"""

# means over integer tenths (retention_pct has one decimal): exact in both engines
CURVE = RETENTION + """
, curve AS (
    SELECT months_since_first AS month, SUM(CAST(ROUND(retention_pct * 10) AS BIGINT)) / COUNT(*) / 10.0 AS avg_retention_pct
    FROM retention GROUP BY ALL
)
"""

SQL["retention_curve"] = CURVE + "SELECT * FROM curve"

SQL["retention_summary"] = CURVE + """
, heads AS (SELECT COUNT(DISTINCT cohort_month) AS n_cohorts, MAX(months_since_first) AS max_period FROM retention),
marks AS (
    SELECT MAX(avg_retention_pct) FILTER (WHERE month = 1) AS month1_retention_pct,
           MIN(avg_retention_pct) AS retention_floor_min_pct, arg_max(avg_retention_pct, month) AS retention_floor_last_pct
    FROM curve
)
SELECT *, 100.0 - month1_retention_pct AS drop_m0_m1_pts FROM heads, marks
"""

SQL["mom_summary"] = DONE + """
, m AS (SELECT month, SUM(c) / 100 AS r, row_number() OVER (ORDER BY month) AS i FROM done GROUP BY month),
growth AS (SELECT (a.r / NULLIF(b.r, 0) - 1) * 100 AS pct FROM m a LEFT JOIN m b ON b.i = a.i - 1),
peak AS (SELECT month FROM m ORDER BY r DESC, month LIMIT 1)
SELECT ROUND(AVG(pct), 6) AS avg_mom_growth_pct, any_value(month) AS peak_month,
       strftime(any_value(month), '%b %Y') AS peak_month_label
FROM growth, peak
"""

SQL["group_summary"] = """
SELECT "group", n, ROUND(b / n, 2) AS avg_baseline, ROUND(f / n, 2) AS avg_followup, ROUND(i / n, 2) AS avg_improvement,
       ROUND(d / n, 1) AS avg_recovery_days, finished AS completed_n
FROM (SELECT "group", COUNT(*) AS n, SUM(baseline_score) AS b, SUM(followup_score) AS f, SUM(score_improvement) AS i,
             SUM(recovery_days) AS d, COUNT(*) FILTER (WHERE completed_programme) AS finished
      FROM patients GROUP BY "group")
"""

SQL["age_group_summary"] = """
SELECT age_group, COUNT(*) AS n, ROUND(AVG(score_improvement), 2) AS avg_improvement,
       ROUND(sqrt(var_samp(score_improvement)), 2) AS std_improvement
FROM patients GROUP BY ALL
"""

SCORES = """
, scores AS (SELECT c_custkey AS id, c_name AS name, c_acctbal AS score FROM customer)
"""

SQL["count_basic"] = SCORES + "SELECT COUNT(*) AS n FROM scores"
SQL["filter_basic"] = SCORES + "SELECT name, score FROM scores WHERE score > 80"
SQL["avg_basic"] = SCORES + "SELECT ROUND(AVG(score), 2) AS avg_score FROM scores"
SQL["rank_basic"] = SCORES + """
SELECT name, score, RANK() OVER (ORDER BY score DESC) AS rnk FROM scores
"""



# ---------------------------------------------------------------------------
# Statistics.  p-values need the regularized incomplete beta (Student t) and
# upper incomplete gamma (chi-square, normal); DuckDB has neither, so they are
# evaluated with recursive CTEs: Lentz continued fractions / power series run
# for a fixed number of steps (they converge well before it).
# ---------------------------------------------------------------------------

def _beta_ctes(src: str, out: str, steps: int = 400) -> str:
    """CTEs computing ``out(id, ib)`` = I_x(a, b) for rows ``src(id, a, b, x)``."""
    return f"""
, {out}_in AS (
    SELECT id, x >= (a + 1) / (a + b + 2) AS sw,
           CASE WHEN x >= (a + 1) / (a + b + 2) THEN b ELSE a END AS aa,
           CASE WHEN x >= (a + 1) / (a + b + 2) THEN a ELSE b END AS bb,
           CASE WHEN x >= (a + 1) / (a + b + 2) THEN 1 - x ELSE x END AS xx
    FROM {src} WHERE x > 0 AND x < 1
),
{out}_cf AS (
    SELECT id, 1 AS m, 1.0::DOUBLE AS c, 1.0 / (1.0 - (aa + bb) * xx / (aa + 1.0)) AS d,
           1.0 / (1.0 - (aa + bb) * xx / (aa + 1.0)) AS h
    FROM {out}_in
    UNION ALL
    SELECT id, m, c2, d2, h2 FROM (
        SELECT f.id, f.m + 1 AS m,
               f.m * (i.bb - f.m) * i.xx / ((i.aa - 1 + 2 * f.m) * (i.aa + 2 * f.m)) AS e1,
               1.0 / (1.0 + e1 * f.d) AS d1,
               1.0 + e1 / f.c AS c1,
               -(i.aa + f.m) * (i.aa + i.bb + f.m) * i.xx / ((i.aa + 2 * f.m) * (i.aa + 1 + 2 * f.m)) AS e2,
               1.0 / (1.0 + e2 * d1) AS d2,
               1.0 + e2 / c1 AS c2,
               f.h * d1 * c1 * d2 * c2 AS h2
        FROM {out}_cf f JOIN {out}_in i ON f.id = i.id
        WHERE f.m < {steps})
),
{out} AS (
    SELECT s.id,
           CASE WHEN s.x <= 0 THEN 0.0 WHEN s.x >= 1 THEN 1.0
                WHEN i.sw THEN 1 - exp(lgamma(i.aa + i.bb) - lgamma(i.aa) - lgamma(i.bb)
                                       + i.aa * ln(i.xx) + i.bb * ln(1 - i.xx)) * f.h / i.aa
                ELSE exp(lgamma(i.aa + i.bb) - lgamma(i.aa) - lgamma(i.bb)
                         + i.aa * ln(i.xx) + i.bb * ln(1 - i.xx)) * f.h / i.aa END AS ib
    FROM {src} s
    LEFT JOIN {out}_in i ON s.id = i.id
    LEFT JOIN {out}_cf f ON s.id = f.id AND f.m = {steps}
)"""


def _gamma_q_ctes(src: str, out: str, steps: int = 600) -> str:
    """CTEs computing ``out(id, q)`` = Q(s, x) for rows ``src(id, s, x)``."""
    return f"""
, {out}_ser AS (
    SELECT id, 0 AS k, 1.0 / s AS del, 1.0 / s AS tot FROM {src} WHERE x > 0
    UNION ALL
    SELECT r.id, r.k + 1, r.del * g.x / (g.s + r.k + 1),
           r.tot + r.del * g.x / (g.s + r.k + 1)
    FROM {out}_ser r JOIN {src} g ON r.id = g.id WHERE r.k < {steps}
),
{out}_cf AS (
    SELECT id, 0 AS i, x + 1 - s AS b, 1e300::DOUBLE AS c, 1.0 / (x + 1 - s) AS d,
           1.0 / (x + 1 - s) AS h FROM {src} WHERE x > 0 AND x >= s + 1
    UNION ALL
    SELECT id, i, b, c2, d2, h2 FROM (
        SELECT f.id, f.i + 1 AS i, -(f.i + 1) * (f.i + 1 - g.s) AS an, f.b + 2 AS b,
               1.0 / (an * f.d + f.b + 2) AS d2, f.b + 2 + an / f.c AS c2, f.h * d2 * c2 AS h2
        FROM {out}_cf f JOIN {src} g ON f.id = g.id WHERE f.i < {steps})
),
{out} AS (
    SELECT g.id,
           CASE WHEN g.x <= 0 THEN 1.0
                WHEN g.x < g.s + 1 THEN GREATEST(0.0, 1 - r.tot * exp(-g.x + g.s * ln(g.x) - lgamma(g.s)))
                ELSE exp(-g.x + g.s * ln(g.x) - lgamma(g.s)) * f.h END AS q
    FROM {src} g
    LEFT JOIN {out}_ser r ON g.id = r.id AND r.k = {steps}
    LEFT JOIN {out}_cf f ON g.id = f.id AND f.i = {steps}
)"""


def _label_d(expr: str) -> str:
    return (f"CASE WHEN abs({expr}) < 0.2 THEN 'negligible' WHEN abs({expr}) < 0.5 THEN 'small' "
            f"WHEN abs({expr}) < 0.8 THEN 'medium' ELSE 'large' END")


def _label_v(expr: str) -> str:
    return (f"CASE WHEN {expr} < 0.1 THEN 'negligible' WHEN {expr} < 0.3 THEN 'small' "
            f"WHEN {expr} < 0.5 THEN 'medium' ELSE 'large' END")


def _interp(p: str, yes: str, no: str, alpha: str = "0.05") -> str:
    return (f"CASE WHEN {p} < {alpha} THEN '{yes} (p=' || printf('%.4f', {p}) || ' < {alpha})' "
            f"ELSE '{no} (p=' || CASE WHEN {p} IS NULL THEN 'nan' ELSE printf('%.4f', {p}) END "
            f"|| ' >= {alpha})' END")


def _describe(source: str, expr: str) -> str:
    """M-1 over ``expr`` of ``source`` (NaN counts as missing)."""
    return f"""
, d_base AS (SELECT CASE WHEN isnan(({expr})::DOUBLE) THEN NULL ELSE ({expr})::DOUBLE END AS x FROM {source}),
d_q AS (SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS med,
               quantile_cont(x, 0.75) AS q3 FROM d_base),
d_out AS (SELECT COUNT(*) AS o FROM d_base, d_q
          WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1))
SELECT COUNT(x) AS count, ROUND(AVG(x), 4) AS mean, ROUND(ANY_VALUE(med), 4) AS median,
       ROUND(STDDEV_SAMP(x), 4) AS std, ROUND(MIN(x), 4) AS min, ROUND(ANY_VALUE(q1), 4) AS q1,
       ROUND(ANY_VALUE(q3), 4) AS q3, ROUND(MAX(x), 4) AS max,
       ROUND(ANY_VALUE(q3) - ANY_VALUE(q1), 4) AS iqr,
       ANY_VALUE(o) AS outlier_count,
       ROUND(ANY_VALUE(o) * 100.0 / COUNT(*), 2) AS outlier_pct,
       ROUND(CASE WHEN STDDEV_POP(x) = 0 THEN 0.0 ELSE SKEWNESS(x) END, 4) AS skewness,
       ROUND(CASE WHEN STDDEV_POP(x) = 0 THEN 0.0 ELSE KURTOSIS(x) END, 4) AS kurtosis,
       COUNT(*) - COUNT(x) AS missing,
       ROUND((COUNT(*) - COUNT(x)) * 100.0 / COUNT(*), 2) AS missing_pct
FROM d_base, d_q, d_out
"""


SQL["describe_extendedprice"] = _describe("lineitem", "l_extendedprice")
SQL["describe_acctbal"] = _describe("customer", "c_acctbal")
SQL["describe_discount_missing"] = _describe("lineitem", "NULLIF(l_discount, 0)")
SQL["describe_ltv"] = """
, customer_ltv AS (
    SELECT c.customer_id, SUM(ROUND(oi.quantity * oi.unit_price * 100)) / 100 AS lifetime_value
    FROM customers c
    JOIN orders o       ON c.customer_id = o.customer_id
    JOIN order_items oi ON o.order_id    = oi.order_id
    WHERE o.status = 'completed'
    GROUP BY 1
)""" + _describe("customer_ltv", "lifetime_value")


def _ttest(value: str, source: str, grp: str, a: str, b: str) -> str:
    return f"""
, tt_m AS (
    SELECT COUNT(x) FILTER (WHERE g = {a}) AS n_a, COUNT(x) FILTER (WHERE g = {b}) AS n_b,
           AVG(x) FILTER (WHERE g = {a}) AS m_a, AVG(x) FILTER (WHERE g = {b}) AS m_b,
           VAR_SAMP(x) FILTER (WHERE g = {a}) AS v_a, VAR_SAMP(x) FILTER (WHERE g = {b}) AS v_b
    FROM (SELECT ({value})::DOUBLE AS x, {grp} AS g FROM {source})
),
tt AS (
    SELECT *, (m_a - m_b) / sqrt(v_a / n_a + v_b / n_b) AS t,
           power(v_a / n_a + v_b / n_b, 2)
               / (power(v_a / n_a, 2) / (n_a - 1) + power(v_b / n_b, 2) / (n_b - 1)) AS dof,
           (m_a - m_b) / sqrt(((n_a - 1) * v_a + (n_b - 1) * v_b) / (n_a + n_b - 2)) AS d
    FROM tt_m
),
tt_src AS (SELECT 1 AS id, dof / 2 AS a, 0.5::DOUBLE AS b, dof / (dof + t * t) AS x FROM tt)
{_beta_ctes("tt_src", "tt_p")}
SELECT ROUND(t, 4) AS t_stat, ROUND(LEAST(1.0, ib), 6) AS p_value, 0.05::DOUBLE AS alpha,
       COALESCE(LEAST(1.0, ib) < 0.05, false) AS significant, ROUND(d, 4) AS cohen_d,
       {_label_d("d")} AS effect_size,
       ROUND(m_a, 4) AS mean_a, ROUND(m_b, 4) AS mean_b, ROUND(m_a - m_b, 4) AS mean_diff,
       {_interp("LEAST(1.0, ib)", "Statistically significant difference", "No significant difference")}
           AS interpretation
FROM tt, tt_p
"""


SQL["ttest_recovery_days"] = _ttest("recovery_days", "patients", '"group"', "'treatment'", "'control'")
SQL["ttest_baseline_score"] = _ttest("baseline_score", "patients", '"group"', "'treatment'", "'control'")
SQL["cohens_d_recovery_days"] = """
, m AS (
    SELECT COUNT(recovery_days) FILTER (WHERE "group" = 'treatment') AS n_a,
           COUNT(recovery_days) FILTER (WHERE "group" = 'control') AS n_b,
           AVG(recovery_days) FILTER (WHERE "group" = 'treatment') AS m_a,
           AVG(recovery_days) FILTER (WHERE "group" = 'control') AS m_b,
           VAR_SAMP(recovery_days) FILTER (WHERE "group" = 'treatment') AS v_a,
           VAR_SAMP(recovery_days) FILTER (WHERE "group" = 'control') AS v_b
    FROM patients
)
SELECT ROUND(CASE WHEN ((n_a - 1) * v_a + (n_b - 1) * v_b) / (n_a + n_b - 2) > 0
             THEN (m_a - m_b) / sqrt(((n_a - 1) * v_a + (n_b - 1) * v_b) / (n_a + n_b - 2))
             ELSE 0.0 END, 6) AS cohen_d
FROM m
"""


def _mann_whitney(value: str, source: str, grp: str, a: str, b: str) -> str:
    """Mid-ranks by window; exact null distribution by enumerating the sorted
    arrangements (only when the exact path applies: small, tie-free)."""
    return f"""
, mw_s AS (SELECT ({value})::DOUBLE AS v, {grp} AS g FROM {source}
           WHERE ({value}) IS NOT NULL AND NOT isnan(({value})::DOUBLE) AND {grp} IN ({a}, {b})),
mw_r AS (SELECT v, g, RANK() OVER (ORDER BY v) + (COUNT(*) OVER (PARTITION BY v) - 1) / 2.0 AS rk
         FROM mw_s),
mw_t AS (SELECT COUNT(*) AS t FROM mw_s GROUP BY v),
mw AS (
    SELECT COUNT(*) FILTER (WHERE g = {a})::DOUBLE AS n1, COUNT(*) FILTER (WHERE g = {b})::DOUBLE AS n2,
           SUM(rk) FILTER (WHERE g = {a}) AS r1,
           (SELECT SUM(t * t * t - t) FROM mw_t)::DOUBLE AS ties, (SELECT MAX(t) FROM mw_t) AS maxt,
           quantile_cont(v, 0.5) FILTER (WHERE g = {a}) AS med_a,
           quantile_cont(v, 0.5) FILTER (WHERE g = {b}) AS med_b
    FROM mw_r
),
mw_u AS (
    SELECT *, r1 - n1 * (n1 + 1) / 2 AS u1,
           GREATEST(r1 - n1 * (n1 + 1) / 2, n1 * n2 - (r1 - n1 * (n1 + 1) / 2)) AS u,
           sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS s,
           LEAST(n1, n2) <= 8 AND maxt <= 1 AND n1 * n2 <= 10000 AS is_exact
    FROM mw
),
mw_z AS (SELECT 1 AS id, 0.5::DOUBLE AS s, power((u - n1 * n2 / 2 - 0.5) / s, 2) / 2 AS x,
                (u - n1 * n2 / 2 - 0.5) / s AS z FROM mw_u WHERE s > 0)
{_gamma_q_ctes("mw_z", "mw_q")},
mw_paths AS (
    SELECT 0 AS i, 0 AS j, 0.0::DOUBLE AS uu FROM mw_u WHERE is_exact
    UNION ALL
    SELECT p.i + mv.di, p.j + mv.dj, p.uu + mv.di * p.j
    FROM mw_paths p, mw_u, (VALUES (1, 0), (0, 1)) mv(di, dj)
    WHERE p.i + mv.di <= mw_u.n1 AND p.j + mv.dj <= mw_u.n2
),
mw_exact AS (
    SELECT COUNT(*) FILTER (WHERE uu >= (SELECT u FROM mw_u)) / COUNT(*) AS sf
    FROM mw_paths, mw_u WHERE i = mw_u.n1 AND j = mw_u.n2
),
mw_p AS (
    SELECT CASE WHEN n1 = 0 OR n2 = 0 THEN NULL
                WHEN is_exact THEN LEAST(1.0, 2 * (SELECT sf FROM mw_exact))
                WHEN s > 0 THEN LEAST(1.0, 2 * (SELECT CASE WHEN z >= 0 THEN 0.5 * q ELSE 1 - 0.5 * q END
                                                 FROM mw_z JOIN mw_q ON mw_z.id = mw_q.id))
                ELSE 1.0 END AS p
    FROM mw_u
)
SELECT ROUND(u1, 4) AS u_stat, ROUND(p, 6) AS p_value, 0.05::DOUBLE AS alpha,
       COALESCE(p < 0.05, false) AS significant,
       ROUND(med_a, 4) AS median_a, ROUND(med_b, 4) AS median_b,
       {_interp("p", "Significant difference in distributions", "No significant difference")}
           AS interpretation
FROM mw_u, mw_p
"""


SQL["mann_whitney_recovery_days"] = _mann_whitney("recovery_days", "patients", '"group"',
                                                  "'treatment'", "'control'")
SQL["mann_whitney_quantity_linestatus"] = _mann_whitney("l_quantity", "lineitem", "l_linestatus",
                                                        "'O'", "'F'")
SQL["mann_whitney_supplier_balance"] = _mann_whitney("s_acctbal", "supplier", "s_nationkey", "1", "2")


def _chi_square(source: str, r: str, c: str, v_only: bool = False, steps: int = 600) -> str:
    """Full R x C grid (zero cells included) and Yates' correction for 2x2."""
    head = f"""
, cx_cells AS (SELECT {r} AS r, {c} AS c, COUNT(*) AS o FROM {source}
               WHERE {r} IS NOT NULL AND {c} IS NOT NULL GROUP BY 1, 2),
cx_rows AS (SELECT r, SUM(o) AS rr FROM cx_cells GROUP BY 1),
cx_cols AS (SELECT c, SUM(o) AS cc FROM cx_cells GROUP BY 1),
cx_grid AS (
    SELECT cx_rows.r, cx_cols.c, COALESCE(cx_cells.o, 0) AS o,
           rr * cc / (SELECT SUM(o) FROM cx_cells)::DOUBLE AS e
    FROM cx_rows CROSS JOIN cx_cols
    LEFT JOIN cx_cells ON cx_cells.r = cx_rows.r AND cx_cells.c = cx_cols.c
),
cx AS (
    SELECT (SELECT COUNT(*) FROM cx_rows) AS nr, (SELECT COUNT(*) FROM cx_cols) AS nc,
           SUM(o) AS n,
           ((SELECT COUNT(*) FROM cx_rows) - 1) * ((SELECT COUNT(*) FROM cx_cols) - 1) AS dof,
           SUM(power(o - e, 2) / e) AS chi_plain,
           SUM(power(GREATEST(abs(o - e) - 0.5, 0), 2) / e) AS chi_yates
    FROM cx_grid
),
cx_stat AS (
    SELECT *, CASE WHEN dof = 0 THEN 0.0 WHEN dof = 1 THEN chi_yates ELSE chi_plain END AS chi2
    FROM cx
),
cx_v AS (
    SELECT *, CASE WHEN LEAST(nr, nc) - 1 > 0 THEN sqrt(chi2 / (n * (LEAST(nr, nc) - 1)))
                   ELSE 0.0 END AS v FROM cx_stat
)"""
    if v_only:
        return head + "\nSELECT ROUND(v, 6) AS cramers_v FROM cx_v\n"
    return head + f""",
cx_src AS (SELECT 1 AS id, dof / 2.0 AS s, chi2 / 2.0 AS x FROM cx_v WHERE dof > 0)
{_gamma_q_ctes("cx_src", "cx_q", steps)}
SELECT ROUND(chi2, 4) AS chi2,
       ROUND(CASE WHEN dof = 0 THEN 1.0 ELSE (SELECT q FROM cx_q) END, 6) AS p_value,
       dof::BIGINT AS dof, 0.05::DOUBLE AS alpha,
       COALESCE(CASE WHEN dof = 0 THEN 1.0 ELSE (SELECT q FROM cx_q) END < 0.05, false) AS significant,
       ROUND(v, 4) AS cramers_v, {_label_v("v")} AS effect_size,
       {_interp("CASE WHEN dof = 0 THEN 1.0 ELSE (SELECT q FROM cx_q) END",
                "Significant association", "No significant association")} AS interpretation
FROM cx_v
"""


SQL["chi_square_quality_toxic"] = _chi_square("labels", "quality", "toxic")
SQL["chi_square_returnflag_linestatus"] = _chi_square("lineitem", "l_returnflag", "l_linestatus")
SQL["chi_square_partkey_suppkey"] = _chi_square("lineitem", "l_partkey", "l_suppkey", steps=6000)
SQL["cramers_v_returnflag_linestatus"] = _chi_square("lineitem", "l_returnflag", "l_linestatus",
                                                     v_only=True)


def _correlation(source: str, cols: list[str], method: str = "pearson",
                 min_periods: int = 30, strong: float | None = None) -> str:
    """Pairwise-complete correlation for all ordered pairs; t-based p-values."""
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            if method == "spearman" and a != b:
                inner = (f"SELECT RANK() OVER (ORDER BY {a}) + (COUNT(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS xa, "
                         f"RANK() OVER (ORDER BY {b}) + (COUNT(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS xb "
                         f"FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL")
            else:
                inner = (f"SELECT {a}::DOUBLE AS xa, {b}::DOUBLE AS xb FROM {source} "
                         f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL")
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, COUNT(*) AS n, "
                         f"CASE WHEN STDDEV_POP(xa) > 0 AND STDDEV_POP(xb) > 0 THEN "
                         f"GREATEST(-1.0, LEAST(1.0, COVAR_POP(xa, xb) / (STDDEV_POP(xa) * STDDEV_POP(xb)))) "
                         f"END AS r FROM ({inner})")
    union = "\n    UNION ALL ".join(parts)
    body = f"""
, cr_upper AS (
    {union}
),
cr_pairs AS (
    SELECT row_number() OVER (ORDER BY col_a, col_b) AS id, * FROM (
        SELECT col_a, col_b, n, r FROM cr_upper
        UNION ALL SELECT col_b, col_a, n, r FROM cr_upper WHERE col_a <> col_b)
),
cr_src AS (SELECT id, (n - 2) / 2.0 AS a, 0.5::DOUBLE AS b,
                  (n - 2) / ((n - 2) + r * r * (n - 2) / (1 - r * r)) AS x
           FROM cr_pairs WHERE n >= {min_periods} AND abs(r) < 1 AND col_a <> col_b)
{_beta_ctes("cr_src", "cr_p")},
cr AS (
    SELECT p.col_a, p.col_b, p.n::BIGINT AS n,
           ROUND(CASE WHEN p.n >= {min_periods} THEN p.r END, 6) AS corr,
           ROUND(CASE WHEN p.col_a = p.col_b OR p.n < {min_periods} THEN 1.0
                      WHEN abs(p.r) >= 1 THEN 0.0 ELSE q.ib END, 6) AS p_value
    FROM cr_pairs p LEFT JOIN cr_p q ON p.id = q.id
)
"""
    if strong is not None:
        return body + f"SELECT * FROM cr WHERE col_a < col_b AND abs(corr) > {strong} ORDER BY col_a, col_b\n"
    return body + "SELECT * FROM cr\n"


_LINEITEM_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_PATIENT_NUMERIC = ["age", "baseline_score", "followup_score", "score_improvement", "recovery_days"]
SQL["correlation_lineitem"] = _correlation("lineitem", _LINEITEM_NUMERIC)
SQL["correlation_lineitem_spearman"] = _correlation("lineitem", _LINEITEM_NUMERIC, method="spearman")
SQL["correlation_patients"] = _correlation("patients", _PATIENT_NUMERIC)
SQL["strong_correlations"] = _correlation("patients", _PATIENT_NUMERIC, strong=0.3)

SQL["group_means"] = """
SELECT "group",
       round_even(AVG(baseline_score) * 100, 0) / 100 AS baseline_score,
       round_even(AVG(followup_score) * 100, 0) / 100 AS followup_score,
       round_even(AVG(recovery_days) * 100, 0) / 100 AS recovery_days
FROM patients GROUP BY 1
"""


# ---------------------------------------------------------------------------
# Plot data, window siblings, as-of join, pivot.
# ---------------------------------------------------------------------------

SQL["histogram_extendedprice"] = """
, hx AS (SELECT l_extendedprice::DOUBLE AS x FROM lineitem
         WHERE l_extendedprice IS NOT NULL AND NOT isnan(l_extendedprice)),
hs AS (SELECT MIN(x) AS mn, MAX(x) AS mx, AVG(x) AS mean, quantile_cont(x, 0.5) AS median FROM hx),
hr AS (SELECT *, CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS lo,
              CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS hi FROM hs),
hb AS (SELECT LEAST(FLOOR((x - lo) * (40.0 / (hi - lo))), 39)::INTEGER AS bin, COUNT(*) AS n
       FROM hx, hr GROUP BY 1)
SELECT g.bin, lo + g.bin * ((hi - lo) / 40.0) AS bin_start, lo + (g.bin + 1) * ((hi - lo) / 40.0) AS bin_end,
       COALESCE(hb.n, 0) AS count, ROUND(mean, 6) AS mean, ROUND(median, 6) AS median
FROM (SELECT range::INTEGER AS bin FROM range(40)) g CROSS JOIN hr LEFT JOIN hb ON hb.bin = g.bin
ORDER BY 1
"""

SQL["kde_extendedprice"] = """
, kx AS (SELECT l_extendedprice::DOUBLE AS x FROM lineitem
         WHERE l_extendedprice IS NOT NULL AND NOT isnan(l_extendedprice)),
ks AS (SELECT MIN(x) AS mn, MAX(x) AS mx, COUNT(x) AS n, STDDEV_SAMP(x) AS sd FROM kx),
kr AS (SELECT *, CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS lo,
              CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS hi,
              sd * power(n::DOUBLE, -0.2) AS h, (mx - mn) / 199.0 AS step FROM ks),
dens AS (SELECT g.point, SUM(exp(-0.5 * power((kr.mn + g.point * kr.step - kx.x) / kr.h, 2))) AS s
         FROM (SELECT range::INTEGER AS point FROM range(200)) g, kr, kx GROUP BY g.point)
SELECT point, mn + point * step AS x,
       ROUND(s / (n * h * sqrt(2 * pi())), 12) AS density,
       ROUND(s / (n * h * sqrt(2 * pi())) * n * (hi - lo) / 40.0, 6) AS count
FROM dens, kr ORDER BY point
"""


def _box(source: str, value: str, grp: str) -> str:
    return f"""
, bx AS (SELECT {grp} AS g, ({value})::DOUBLE AS x FROM {source} WHERE ({value}) IS NOT NULL),
bq AS (SELECT g, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median,
              quantile_cont(x, 0.75) AS q3 FROM bx GROUP BY g),
bf AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM bq),
bs AS (SELECT bf.g, bf.q1, bf.median, bf.q3, COUNT(*) AS n,
              MIN(CASE WHEN x >= lo AND x <= hi THEN x END) AS whisker_low,
              MAX(CASE WHEN x >= lo AND x <= hi THEN x END) AS whisker_high,
              COUNT(*) FILTER (WHERE NOT (x >= lo AND x <= hi)) AS n_fliers
       FROM bx JOIN bf ON bx.g = bf.g GROUP BY bf.g, bf.q1, bf.median, bf.q3)
SELECT g AS {grp}, n, ROUND(q1, 6) AS q1, ROUND(median, 6) AS median, ROUND(q3, 6) AS q3,
       ROUND(whisker_low, 6) AS whisker_low, ROUND(whisker_high, 6) AS whisker_high, n_fliers,
       ROW_NUMBER() OVER (ORDER BY median DESC, g) AS "order"
FROM bs ORDER BY "order"
"""


SQL["box_stats_ltv_by_country"] = """
, customer_ltv AS (
    SELECT c.customer_id, c.country, SUM(ROUND(oi.quantity * oi.unit_price * 100)) / 100 AS lifetime_value
    FROM customers c
    JOIN orders o       ON c.customer_id = o.customer_id
    JOIN order_items oi ON o.order_id    = oi.order_id
    WHERE o.status = 'completed'
    GROUP BY 1, 2
)""" + _box("customer_ltv", "lifetime_value", "country")
SQL["box_stats_recovery_by_group"] = _box("patients", "recovery_days", '"group"')

_MONTHLY_NOTEBOOK = """
, monthly AS (
    SELECT DATE_TRUNC('month', o.order_date) AS month,
           COUNT(DISTINCT o.order_id) AS total_orders,
           SUM(ROUND(oi.quantity * oi.unit_price * 100)) / 100 AS revenue,
           SUM(ROUND(oi.quantity * oi.unit_price * 100)) AS revenue_c
    FROM orders o JOIN order_items oi ON o.order_id = oi.order_id
    WHERE o.status = 'completed' GROUP BY 1
)"""

SQL["revenue_rolling"] = _MONTHLY_NOTEBOOK + """
SELECT month, revenue,
       CASE WHEN COUNT(revenue_c) OVER w = 3 THEN SUM(revenue_c) OVER w / 3 / 100 END AS rolling_mean
FROM monthly
WINDOW w AS (ORDER BY month ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)
ORDER BY month
"""

SQL["monthly_pct_change"] = _MONTHLY_NOTEBOOK + """
SELECT month, revenue,
       ROUND((revenue / NULLIF(LAG(revenue) OVER (ORDER BY month), 0) - 1) * 100, 6) AS mom_growth_pct
FROM monthly ORDER BY month
"""

SQL["ranked_category_revenue"] = """
, perf AS (
    SELECT p.category, SUM(ROUND(oi.quantity * oi.unit_price * 100)) / 100 AS revenue
    FROM order_items oi
    JOIN products p ON oi.product_id = p.product_id
    JOIN orders o   ON oi.order_id   = o.order_id
    WHERE o.status = 'completed'
    GROUP BY 1
)
SELECT category, revenue, ROW_NUMBER() OVER (ORDER BY revenue DESC, category) AS rank
FROM perf WHERE revenue IS NOT NULL
ORDER BY revenue DESC, category LIMIT 15
"""

SQL["correlation_heatmap_patients"] = _correlation("patients", _PATIENT_NUMERIC).replace(
    "SELECT * FROM cr\n",
    "SELECT * FROM cr WHERE list_position(" + repr(_PATIENT_NUMERIC).replace('"', "'") + ", col_a) > "
    "list_position(" + repr(_PATIENT_NUMERIC).replace('"', "'") + ", col_b)\n")

SQL["order_sequence"] = """
SELECT customer_id, order_id, order_date,
       ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY order_date, order_id) AS order_seq,
       LEAD(order_date) OVER (PARTITION BY customer_id ORDER BY order_date, order_id) AS next_order_date,
       DATE_DIFF('day', order_date,
                 LEAD(order_date) OVER (PARTITION BY customer_id ORDER BY order_date, order_id))::DOUBLE
           AS days_to_next
FROM orders WHERE status = 'completed'
"""

SQL["purchase_last_click"] = """
, purchases AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'purchase'),
clicks AS (SELECT user_id, event_id AS click_event_id, ts AS click_ts, value AS click_value
           FROM events WHERE event_type = 'click')
SELECT p.event_id, p.user_id, p.ts, p.value, c.click_event_id::VARCHAR AS click_event_id,
       c.click_ts, c.click_value
FROM purchases p ASOF LEFT JOIN clicks c ON p.user_id = c.user_id AND p.ts >= c.click_ts
"""

SQL["channel_status_pivot"] = """
SELECT * FROM (
    PIVOT (SELECT channel, status FROM orders)
    ON status IN ('completed', 'returned', 'cancelled') USING COUNT(*)
)
"""


def _kendall(source: str, cols: list[str], min_periods: int = 30) -> str:
    """Kendall tau-b over distinct points with weights.

    Discordant pairs are counted over the bits of the rank of y, as an order-statistic tree would hold
    them: two points part at the highest bit in which their ranks differ, and the pair is discordant
    where the one with the bit set comes earlier by (x, y).  Tie-corrected variance; normal tail by the
    incomplete gamma.
    """
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    points = "\n    UNION ALL ".join(
        f"SELECT {i} AS id, {a}::DOUBLE AS x, {b}::DOUBLE AS y, COUNT(*) AS w FROM {source} "
        f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 2, 3" for i, (a, b) in enumerate(pairs))
    names = ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(pairs))

    def ties(col: str) -> str:
        return (f"SELECT id, SUM(t * (t - 1) / 2) AS {col}tie, SUM(t * (t - 1) * (t - 2)) AS {col}0, "
                f"SUM(t * (t - 1) * (2 * t + 5)) AS {col}1 "
                f"FROM (SELECT id, SUM(w)::DOUBLE AS t FROM kp GROUP BY id, {col}) GROUP BY id")

    return f"""
, kn(id, col_a, col_b) AS (VALUES {names}),
kp AS MATERIALIZED ({points}),
ko AS (SELECT id, w, ROW_NUMBER() OVER (PARTITION BY id ORDER BY x, y) AS place,
              DENSE_RANK() OVER (PARTITION BY id ORDER BY y) - 1 AS yrank FROM kp),
kb AS (SELECT id, w, (yrank >> bit) & 1 AS side,
              SUM(CASE WHEN (yrank >> bit) & 1 = 1 THEN w ELSE 0 END) OVER (
                  PARTITION BY id, bit, yrank >> (bit + 1) ORDER BY place ROWS UNBOUNDED PRECEDING) AS earlier
       FROM ko, (SELECT UNNEST(range(0, 40)) AS bit) WHERE bit < (SELECT ceil(log2(MAX(yrank) + 2)) FROM ko)),
kdis AS (SELECT id, SUM(w * earlier)::DOUBLE AS dis FROM kb WHERE side = 0 GROUP BY id),
kd AS (SELECT * FROM kn
       JOIN (SELECT id, SUM(w)::DOUBLE AS n, SUM(w * (w - 1) / 2)::DOUBLE AS ntie FROM kp GROUP BY id) USING (id)
       JOIN ({ties("x")}) USING (id) JOIN ({ties("y")}) USING (id) JOIN kdis USING (id)),
kt AS (
    SELECT *, n * (n - 1) / 2 AS tot,
           n * (n - 1) / 2 - xtie - ytie + ntie - 2 * dis AS cmd,
           (n * (n - 1) * (2 * n + 5) - x1 - y1) / 18 + (2 * xtie * ytie) / (n * (n - 1))
               + x0 * y0 / (9 * n * (n - 1) * (n - 2)) AS var
    FROM kd
),
kz AS (SELECT id, 0.5::DOUBLE AS s, power(cmd / sqrt(var), 2) / 2 AS x FROM kt
       WHERE var > 0 AND col_a <> col_b)
{_gamma_q_ctes("kz", "kq")},
kr AS (
    SELECT t.col_a, t.col_b, t.n::BIGINT AS n,
           ROUND(CASE WHEN t.n >= {min_periods} AND (t.tot - t.xtie) > 0 AND (t.tot - t.ytie) > 0
                      THEN GREATEST(-1.0, LEAST(1.0, t.cmd / (sqrt(t.tot - t.xtie) * sqrt(t.tot - t.ytie))))
                 END, 6) AS corr,
           ROUND(CASE WHEN t.col_a = t.col_b OR t.n < {min_periods} THEN 1.0
                      ELSE LEAST(1.0, q.q) END, 6) AS p_value
    FROM kt t LEFT JOIN kq q ON t.id = q.id
)
SELECT * FROM kr
UNION ALL SELECT col_b, col_a, n, corr, p_value FROM kr WHERE col_a <> col_b
"""


SQL["correlation_lineitem_kendall"] = _kendall("lineitem", _LINEITEM_NUMERIC)
SQL["correlation_patients_kendall"] = _kendall("patients", _PATIENT_NUMERIC)


def _histogram(source: str, value: str) -> str:
    return f"""
, hx AS (SELECT ({value})::DOUBLE AS x FROM {source}
         WHERE ({value}) IS NOT NULL AND NOT isnan(({value})::DOUBLE)),
hs AS (SELECT MIN(x) AS mn, MAX(x) AS mx, AVG(x) AS mean, quantile_cont(x, 0.5) AS median FROM hx),
hr AS (SELECT *, CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS lo,
              CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS hi FROM hs),
hb AS (SELECT LEAST(FLOOR((x - lo) * (40.0 / (hi - lo))), 39)::INTEGER AS bin, COUNT(*) AS n
       FROM hx, hr GROUP BY 1)
SELECT g.bin, lo + g.bin * ((hi - lo) / 40.0) AS bin_start, lo + (g.bin + 1) * ((hi - lo) / 40.0) AS bin_end,
       COALESCE(hb.n, 0) AS count, ROUND(mean, 6) AS mean, ROUND(median, 6) AS median
FROM (SELECT range::INTEGER AS bin FROM range(40)) g CROSS JOIN hr LEFT JOIN hb ON hb.bin = g.bin
ORDER BY 1
"""


def _kde(source: str, value: str) -> str:
    return f"""
, kx AS (SELECT ({value})::DOUBLE AS x FROM {source}
         WHERE ({value}) IS NOT NULL AND NOT isnan(({value})::DOUBLE)),
ks AS (SELECT MIN(x) AS mn, MAX(x) AS mx, COUNT(x) AS n, STDDEV_SAMP(x) AS sd FROM kx),
kr AS (SELECT *, CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS lo,
              CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS hi,
              sd * power(n::DOUBLE, -0.2) AS h, (mx - mn) / 199.0 AS step FROM ks),
dens AS (SELECT g.point, SUM(exp(-0.5 * power((kr.mn + g.point * kr.step - kx.x) / kr.h, 2))) AS s
         FROM (SELECT range::INTEGER AS point FROM range(200)) g, kr, kx GROUP BY g.point)
SELECT point, mn + point * step AS x,
       ROUND(s / (n * h * sqrt(2 * pi())), 12) AS density,
       ROUND(s / (n * h * sqrt(2 * pi())) * n * (hi - lo) / 40.0, 6) AS count
FROM dens, kr ORDER BY point
"""


_LTV_CTE = """
, customer_ltv AS (
    SELECT c.customer_id, c.country, SUM(ROUND(oi.quantity * oi.unit_price * 100)) / 100 AS lifetime_value
    FROM customers c
    JOIN orders o       ON c.customer_id = o.customer_id
    JOIN order_items oi ON o.order_id    = oi.order_id
    WHERE o.status = 'completed'
    GROUP BY 1, 2
)"""

SQL["histogram_ltv"] = _LTV_CTE + _histogram("customer_ltv", "lifetime_value")
SQL["kde_ltv"] = _LTV_CTE + _kde("customer_ltv", "lifetime_value")
SQL["box_stats_improvement_by_age_group"] = _box("patients", "score_improvement", "age_group")


# ---------------------------------------------------------------------------
# Parsing, conditions, missing values, scripts and files.
# ---------------------------------------------------------------------------

SQL["order_dates_parsed"] = """
, w AS (
    SELECT order_id, order_date, CASE status WHEN 'completed' THEN strftime(order_date, '%Y-%m-%d')
               WHEN 'returned' THEN strftime(order_date, '%d/%m/%Y %H:%M')
               ELSE 'Q' || quarter(order_date) || ' ' || year(order_date) END AS written
    FROM orders
)
SELECT order_id, written, COALESCE(try_strptime(written, '%Y-%m-%d'), try_strptime(written, '%d/%m/%Y %H:%M')) AS parsed FROM w
"""

SQL["patients_adjusted"] = """
SELECT patient_id, LEAST(20.0::DOUBLE, GREATEST(8.0::DOUBLE, score_improvement)) AS bounded_improvement,
       GREATEST(25.0::DOUBLE, baseline_score) AS baseline_floor,
       CAST(recovery_days - CASE "group" WHEN 'treatment' THEN CASE WHEN age > 70 THEN 2 ELSE 5 END ELSE 0 END AS INTEGER)
           AS adjusted_days
FROM patients
"""

SQL["cohort_matrix_wide"] = RETENTION + "SELECT strftime(cohort_month, '%Y-%m') AS cohort, " + ", ".join(
    f"MAX(retention_pct) FILTER (WHERE months_since_first = {k}) AS \"Month {k}\"" for k in (0, 1, 2, 3, 6, 12)
) + " FROM retention GROUP BY ALL"

SQL["ranked_subcategory_revenue"] = SOLD + """
SELECT subcategory, r / 100 AS revenue, row_number() OVER (ORDER BY r DESC, subcategory) AS rank
FROM (SELECT subcategory, SUM(c) AS r FROM shelf GROUP BY ALL) QUALIFY rank <= 15
"""

_MISSING = """
, missing AS (SELECT l_quantity, NULLIF(l_discount, 0) AS discount, NULLIF(l_tax, 0) AS tax FROM lineitem)
"""
SQL["correlation_missing"] = _MISSING + _correlation("missing", ["l_quantity", "discount", "tax"])
SQL["correlation_missing_spearman"] = _MISSING + _correlation("missing", ["l_quantity", "discount", "tax"], method="spearman")
SQL["correlation_patients_spearman"] = _correlation("patients", [
    "patient_id", "age", "baseline_score", "followup_score", "recovery_days", "score_improvement"], method="spearman")

SQL["script_returns_by_year"] = """
SELECT channel, year(order_date) AS order_year, COUNT(*) AS orders,
       ROUND(COUNT(*) FILTER (WHERE status = 'returned') / COUNT(*) * 100, 2) AS returned_pct
FROM orders GROUP BY ALL
"""

SQL["csv_customers"] = """
SELECT c_mktsegment AS segment, COUNT(*) AS n, MAX(c_custkey) AS last_id, MAX(c_acctbal) AS best_balance
FROM customer GROUP BY ALL
"""

# whole numbers of 2^-44 and 2^-60, summed as 128-bit integers; the two parts of a sum are exact doubles, so one rounding is left
SQL["exact_line_sums"] = """
, units AS (
    SELECT l_returnflag, l_linestatus, COUNT(*) AS n,
           SUM((l_extendedprice * (1 - l_discount) * (1 + l_tax) * power(2::DOUBLE, 44))::HUGEINT) AS charge,
           SUM((l_tax::DOUBLE * power(2::DOUBLE, 60))::HUGEINT) AS tax
    FROM lineitem GROUP BY ALL
),
sums AS (
    SELECT *, ((charge // 33554432)::DOUBLE * 33554432 + (charge % 33554432)::DOUBLE) / power(2::DOUBLE, 44) AS sum_charge,
           ((tax // 33554432)::DOUBLE * 33554432 + (tax % 33554432)::DOUBLE) / power(2::DOUBLE, 60) AS sum_l_tax
    FROM units
)
SELECT l_returnflag, l_linestatus, n AS n_charge, sum_charge, sum_charge / n AS mean_charge,
       n AS n_l_tax, sum_l_tax, sum_l_tax / n AS mean_l_tax
FROM sums
"""


def oracle_sql() -> dict[str, str]:
    """Full statements: adapter CTEs followed by each query (a leading comma
    continues the WITH list)."""
    out = {}
    for key, body in SQL.items():
        head = ADAPTER.rstrip()
        if "RECURSIVE" not in head and ("_cf AS" in body or "_ser AS" in body or "mw_paths" in body):
            head = head.replace("WITH customers AS", "WITH RECURSIVE customers AS", 1)
        out[key] = head + "\n" + body.strip()
    return out

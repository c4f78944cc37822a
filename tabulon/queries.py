"""The registered queries over the driver's tables, each with SQL for the same rows where SQL can express it."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import registry, scalars, sqlite_compat
from .operators import context, reshape, stats, topup
from .plans import analyze, sql
from .plans.intent import Intent, compile_question
from .session import table
from .sources import csv_ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
LINEITEM = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


def query(oracle: str | None = None):
    """Register the function under its name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def from_sql(name: str, text: str, tables: tuple[str, ...], oracle: str | None = None) -> None:
    """Register a query that is SQL text itself, run through the guarded SQL runner; the tables become views of the caller's session."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        for t in tables:
            table(spark, folder, t).createOrReplaceTempView(t)
        return sql.run(spark, text)

    run.__name__ = name
    query(oracle or text)(run)


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# --- statistics


def _describe_sql(names: tuple[str, ...]) -> str:
    one = "SELECT '{0}' AS \"column\", s AS stat, round(v, 4) AS value FROM (SELECT count({0})::DOUBLE AS a, avg({0})::DOUBLE AS b, stddev_samp({0}) AS c, min({0})::DOUBLE AS d, quantile_cont({0}::DOUBLE, 0.25) AS e, quantile_cont({0}::DOUBLE, 0.5) AS f, quantile_cont({0}::DOUBLE, 0.75) AS g, max({0})::DOUBLE AS h FROM lineitem), LATERAL (VALUES ('count', a), ('mean', b), ('std', c), ('min', d), ('25%', e), ('50%', f), ('75%', g), ('max', h)) t(s, v)"
    return " UNION ALL ".join(one.format(n) for n in names)


@query(_describe_sql(LINEITEM))
def describe_numeric(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(stats.describe_numeric(table(spark, folder, "lineitem")), 4, "value")


@query("SELECT round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS minimum, max(o_totalprice) AS maximum, quantile_cont(o_totalprice, 0.5) AS median FROM orders")
def column_summary(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(stats.column_summary(table(spark, folder, "orders"), "o_totalprice"), 4, "mean")


def _categories(names: tuple[str, ...], t: str) -> str:
    one = "SELECT '{0}' AS \"column\", count({0}) AS \"count\", count(DISTINCT {0}) AS \"unique\", (SELECT {0} FROM {1} GROUP BY {0} ORDER BY count(*) DESC, {0} LIMIT 1) AS top, (SELECT count(*) FROM {1} GROUP BY {0} ORDER BY count(*) DESC, {0} LIMIT 1) AS freq FROM {1}"
    return " UNION ALL ".join(one.format(n, t) for n in names)


@query(_categories(("o_orderstatus", "o_orderpriority"), "orders"))
def describe_categorical(spark: SparkSession, folder: str) -> DataFrame:
    return stats.describe_categorical(table(spark, folder, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("WITH j AS (SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM j" for c in ("doc_id", "lang", "quality", "toxic")))
def null_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    return stats.null_counts(docs.join(table(spark, folder, "labels"), "doc_id", "left"))


@query("SELECT count(*) AS \"rows\", 11::INTEGER AS \"columns\" FROM lineitem")
def shape_profile(spark: SparkSession, folder: str) -> DataFrame:
    return stats.shape(table(spark, folder, "lineitem"))


@query("""
WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
c AS (SELECT least(20, 1 + floor((l_extendedprice - lo) / ((hi - lo) / 20)))::INTEGER AS bin, count(*) AS n FROM lineitem, b GROUP BY 1)
SELECT r.i::INTEGER AS bin, round(lo + (r.i - 1) * ((hi - lo) / 20), 6) AS lo, round(lo + r.i * ((hi - lo) / 20), 6) AS hi, coalesce(n, 0) AS n FROM range(1, 21) r(i) CROSS JOIN b LEFT JOIN c ON c.bin = r.i
""")
def histogram20(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(stats.histogram(table(spark, folder, "lineitem"), "l_extendedprice"), 6, "lo", "hi")


@query(" UNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, round(corr({y}, {x}), 8) AS corr FROM lineitem" for x in LINEITEM for y in LINEITEM))
def corr_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(stats.corr_matrix(table(spark, folder, "lineitem")), 8, "corr")


@query("SELECT l_quantity AS x, l_discount AS y FROM lineitem WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL")
def scatter_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return stats.scatter_pairs(table(spark, folder, "lineitem"), "l_quantity", "l_discount")


_GROUPED = """
WITH b AS (SELECT min(l_discount) AS lo, max(l_discount) AS hi FROM lineitem),
c AS (SELECT 1 + (l_discount > lo + 1 * (hi - lo) / 5)::INTEGER + (l_discount > lo + 2 * (hi - lo) / 5)::INTEGER + (l_discount > lo + 3 * (hi - lo) / 5)::INTEGER + (l_discount > lo + 4 * (hi - lo) / 5)::INTEGER AS bin, count(*) AS n, avg(l_quantity) AS mean FROM lineitem, b GROUP BY 1)
SELECT r.i::INTEGER AS bin, coalesce(n, 0) AS n, round(mean, 6) AS mean FROM range(1, 6) r(i) LEFT JOIN c ON c.bin = r.i
"""


@query(_GROUPED)
def grouped_bin_mean(spark: SparkSession, folder: str) -> DataFrame:
    lineitem = table(spark, folder, "lineitem")
    result = analyze.run(compile_question("l_quantity by l_discount", lineitem), lineitem)
    return rounded(result.tables["grouped"].select("bin", "n", "mean"), 6, "mean")


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS index, o_totalprice AS value FROM orders")
def trend_by_index(spark: SparkSession, folder: str) -> DataFrame:
    return stats.trend(table(spark, folder, "orders"), "o_totalprice", ["o_orderkey"])


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def trend_monthly(spark: SparkSession, folder: str) -> DataFrame:
    by = reshape.resample(table(spark, folder, "orders"), "o_orderdate", "month", {"n": F.count("*"), "total": F.round(F.sum("o_totalprice"), 2)})
    return by.select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "n", "total")


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2, regr_count(l_extendedprice, l_quantity)::BIGINT AS n FROM lineitem")
def regression_1d(spark: SparkSession, folder: str) -> DataFrame:
    out = stats.regression(table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice")
    return out.select(F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 8).alias("r2"), "n")


def _normal_equations(t: str, x: tuple[str, str, str], y: str) -> str:
    """Least squares over three columns by Cramer's rule on the centred sums."""
    sums = ", ".join(f"covar_pop({a}, {b}) AS s{i}{j}" for i, a in enumerate(x) for j, b in enumerate(x)) + ", " + ", ".join(f"covar_pop({a}, {y}) AS t{i}" for i, a in enumerate(x))
    det = lambda m: f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]}) - {m[0][1]} * ({m[1][0]} * {m[2][2]} - {m[1][2]} * {m[2][0]}) + {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))"
    base = [[f"s{i}{j}" for j in range(3)] for i in range(3)]
    solved = ", ".join(f"{det([[f't{i}' if j == k else base[i][j] for j in range(3)] for i in range(3)])} / {det(base)} AS b{k}" for k in range(3))
    terms = "('intercept', my - b0 * m0 - b1 * m1 - b2 * m2), " + ", ".join(f"('{a}', b{k})" for k, a in enumerate(x))
    return f"""
WITH s AS (SELECT {sums}, {", ".join(f"avg({a}) AS m{i}" for i, a in enumerate(x))}, avg({y}) AS my, var_pop({y}) AS vy FROM {t}), b AS (SELECT *, {solved} FROM s)
SELECT term, round(c, 4) AS coefficient, round((b0 * t0 + b1 * t1 + b2 * t2) / vy, 8) AS r2, round(vy - b0 * t0 - b1 * t1 - b2 * t2, 0) AS mse FROM b, LATERAL (VALUES {terms}) v(term, c)
"""


@query(_normal_equations("lineitem", ("l_quantity", "l_discount", "l_tax"), "l_extendedprice"))
def regression_nd(spark: SparkSession, folder: str) -> DataFrame:
    out = stats.regression_many(table(spark, folder, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    return out.select("term", F.round("coefficient", 4).alias("coefficient"), F.round("r2", 8).alias("r2"), F.round("mse", 0).alias("mse"))


@query("SELECT count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(var_samp(l_quantity), 6) AS var, round(skewness(l_quantity), 6) AS skew, round(kurtosis(l_quantity), 6) AS kurt FROM lineitem")
def moments(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(stats.moments(table(spark, folder, "lineitem"), "l_quantity"), 6, "mean", "var", "skew", "kurt")


@query("""
WITH g AS (SELECT count(*) FILTER (WHERE l_returnflag = 'A')::DOUBLE AS n0, avg(l_quantity) FILTER (WHERE l_returnflag = 'A') AS m0, var_samp(l_quantity) FILTER (WHERE l_returnflag = 'A') AS v0, count(*) FILTER (WHERE l_returnflag = 'N')::DOUBLE AS n1, avg(l_quantity) FILTER (WHERE l_returnflag = 'N') AS m1, var_samp(l_quantity) FILTER (WHERE l_returnflag = 'N') AS v1 FROM lineitem)
SELECT round((m0 - m1) / sqrt(v0 / n0 + v1 / n1), 6) AS t, round((v0 / n0 + v1 / n1) ^ 2 / ((v0 / n0) ^ 2 / (n0 - 1) + (v1 / n1) ^ 2 / (n1 - 1)), 3) AS dof FROM g
""")
def welch_t_test(spark: SparkSession, folder: str) -> DataFrame:
    out = stats.t_test(table(spark, folder, "lineitem"), "l_quantity", "l_returnflag", "A", "N")
    return out.select(F.round("t", 6).alias("t"), F.round("dof", 3).alias("dof"))


@query("SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_samp(o_totalprice) FROM orders), 6) AS z FROM orders")
def z_scores(spark: SparkSession, folder: str) -> DataFrame:
    return stats.z_scores(table(spark, folder, "orders"), "o_totalprice").select("o_orderkey", F.round("o_totalprice_z", 6).alias("z"))


@query("WITH e AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS b, quantile_cont(o_totalprice, 0.75) AS c FROM orders) SELECT 1 + (o_totalprice > a)::INTEGER + (o_totalprice > b)::INTEGER + (o_totalprice > c)::INTEGER AS bin, count(*) AS n FROM orders, e GROUP BY 1")
def quantile_bins(spark: SparkSession, folder: str) -> DataFrame:
    return reshape.quantile_bins(table(spark, folder, "orders"), "o_totalprice", 4).groupBy(F.col("o_totalprice_bin").alias("bin")).agg(F.count("*").alias("n"))


# --- SQL

from_sql("sql_filter_project", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice BETWEEN 100000 AND 200000", ("orders",))
from_sql("sql_group_having", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 12", ("orders",))
from_sql("sql_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", ("lineitem",))
from_sql("sql_order_limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5", ("orders",))
from_sql("sql_cte_recursive", "SELECT * FROM (WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 10) SELECT n FROM t) x", ())
from_sql("sql_group_filter_total", "SELECT l_returnflag, count(*) FILTER (WHERE l_discount > 0.05) AS n, count(DISTINCT l_suppkey) AS suppliers, coalesce(sum(CASE WHEN l_tax > 1 THEN l_tax END), 0) AS total FROM lineitem GROUP BY l_returnflag", ("lineitem",))
from_sql("join_inner", "SELECT n.n_name, count(*) AS n FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name", ("customer", "nation"))
from_sql("join_left", "SELECT c.c_custkey, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P' GROUP BY c.c_custkey", ("customer", "orders"))
from_sql("join_full", "SELECT coalesce(c.k, -1) AS c, coalesce(s.k, -1) AS s FROM (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9000) c FULL JOIN (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000) s ON c.k = s.k", ("customer", "supplier"))
from_sql("join_right_using", "SELECT o_custkey AS k, o_orderkey, c_name FROM (SELECT c_custkey AS o_custkey, c_name FROM customer WHERE c_acctbal > 5000) c RIGHT JOIN (SELECT o_custkey, o_orderkey FROM orders WHERE o_totalprice > 400000) o USING (o_custkey)", ("customer", "orders"))
from_sql("join_cross", "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n", ("region", "nation"))
from_sql("join_self", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", ("nation",))
from_sql("semi_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)", ("customer", "orders"))
from_sql("semi_in", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)", ("part", "lineitem"))
from_sql("anti_not_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)", ("customer", "orders"))
from_sql("anti_not_in", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 45 AND l_partkey IS NOT NULL)", ("part", "lineitem"))
from_sql("scalar_subquery", "SELECT o_orderkey, o_totalprice FROM orders o WHERE o_totalprice > (SELECT 1.5 * avg(o2.o_totalprice) FROM orders o2 WHERE o2.o_custkey = o.o_custkey)", ("orders",))
from_sql("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier", ("customer", "supplier"))
from_sql("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", ("customer", "supplier"))
from_sql("intersect", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'", ("orders",))
from_sql("except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 200000", ("customer", "orders"))
from_sql("win_rank", "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr, round(percent_rank() OVER w, 8) AS pr, round(cume_dist() OVER w, 8) AS cd FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)", ("orders",))
from_sql("win_lag_lead", "SELECT event_id, lag(value) OVER w AS before, lead(value, 2, -1.0e0) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)", ("events",))
from_sql("win_frame_rows", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS s3, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM events", ("events",))
from_sql("win_frame_range", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_totalprice RANGE BETWEEN 10000 PRECEDING AND 10000 FOLLOWING) AS near FROM orders", ("orders",))
from_sql("win_ntile", "SELECT o_orderkey, ntile(4) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS quarter FROM orders", ("orders",), "SELECT o_orderkey, (ntile(4) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey))::INTEGER AS quarter FROM orders")
from_sql("win_first_last", "SELECT event_id, first_value(event_type) OVER w AS f, last_value(event_type) OVER w AS l, nth_value(event_type, 2) OVER w AS n2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)", ("events",))
from_sql("listagg_group", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", ("nation",), "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
from_sql("agg_filter_distinct", "SELECT l_linestatus, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(DISTINCT l_partkey) AS parts, round(avg(l_quantity) FILTER (WHERE l_tax > 0.04), 6) AS q FROM lineitem GROUP BY l_linestatus", ("lineitem",))
from_sql("case_coalesce", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS band, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment FROM customer", ("customer",))
from_sql("string_scalars", "SELECT p_partkey, lower(p_name) AS lo, upper(p_brand) AS up, length(p_name) AS n, replace(p_type, ' ', '_') AS r, substr(p_name, 2, 5) AS s, instr(p_name, 'a') AS i, trim(concat('  ', p_brand, ' ')) AS t, p_name LIKE '%a%' AS has_a FROM part", ("part",), "SELECT p_partkey, lower(p_name) AS lo, upper(p_brand) AS up, length(p_name)::INTEGER AS n, replace(p_type, ' ', '_') AS r, substr(p_name, 2, 5) AS s, instr(p_name, 'a')::INTEGER AS i, trim(concat('  ', p_brand, ' ')) AS t, p_name LIKE '%a%' AS has_a FROM part")
from_sql("date_scalars", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, date_format(date_trunc('MONTH', o_orderdate), 'yyyy-MM-dd') AS first_day, date_format(o_orderdate + INTERVAL 30 DAYS, 'yyyy-MM-dd') AS due, datediff(timestamp'2001-08-01', o_orderdate) AS age FROM orders", ("orders",), "SELECT o_orderkey, year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS m, day(o_orderdate)::INTEGER AS d, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS first_day, strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') AS due, date_diff('day', o_orderdate::DATE, DATE '2001-08-01')::INTEGER AS age FROM orders")
from_sql("math_scalars", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, abs(l_discount - 0.05e0) AS a, greatest(l_quantity, 25) AS g, round(sqrt(l_extendedprice), 6) AS s, floor(l_extendedprice / 100) AS f, l_orderkey % 7 AS m, round(pow(l_quantity, 2), 4) AS p FROM lineitem", ("lineitem",), "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, abs(l_discount - 0.05e0) AS a, greatest(l_quantity, 25) AS g, round(sqrt(l_extendedprice), 6) AS s, floor(l_extendedprice / 100)::BIGINT AS f, l_orderkey % 7 AS m, round(pow(l_quantity, 2), 4) AS p FROM lineitem")
from_sql("json_scalars", "SELECT event_id, cast(get_json_object(props, '$.k') AS bigint) AS k FROM events", ("events",), "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")


from_sql("sql_order_nulls", "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer ORDER BY segment ASC NULLS FIRST, c_custkey LIMIT 20", ("customer",))
from_sql("sql_case_insensitive", "SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE 'build%' AND lower(c_name) LIKE '%1'", ("customer",))
from_sql("cube_sums", "SELECT coalesce(l_returnflag, '-') AS f, coalesce(l_linestatus, '-') AS s, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", ("lineitem",))
from_sql("rollup_sums", "SELECT coalesce(o_orderpriority, '-') AS p, coalesce(o_orderstatus, '-') AS s, cast(sum(cast(o_totalprice AS decimal(18,2))) AS double) AS total FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)", ("orders",))
from_sql("join_natural", "SELECT r_name, count(*) AS n FROM (SELECT n_regionkey AS r_regionkey, n_name FROM nation) n NATURAL JOIN region GROUP BY r_name", ("nation", "region"))
from_sql("star_join", "SELECT n.n_name, year(o.o_orderdate) AS y, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE o.o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY n.n_name, year(o.o_orderdate)", ("lineitem", "orders", "customer", "nation"), "SELECT n.n_name, year(o.o_orderdate)::INTEGER AS y, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE o.o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY n.n_name, year(o.o_orderdate)")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 300000 AND o_orderstatus = 'F'")
def sql_parameters(spark: SparkSession, folder: str) -> DataFrame:
    table(spark, folder, "orders").createOrReplaceTempView("orders")
    return sql.run(spark, "SELECT o_orderkey FROM orders WHERE o_totalprice > :least AND o_orderstatus = :status", {"least": 300000, "status": "F"})


@query("SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 2) AS s FROM orders")
def win_frame_groups(spark: SparkSession, folder: str) -> DataFrame:
    frame = lambda how: reshape.peer_group_frame("o_totalprice", ["o_orderpriority"], 1, 1, ["o_custkey"], how)
    group, total = frame(F.sum)
    return table(spark, folder, "orders").withColumn("g", group).select("o_orderkey", frame(F.count)[1].alias("n"), F.round(total, 2).alias("s"))


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW), 6) AS near FROM events")
def win_exclude_current(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 2)
    return table(spark, folder, "events").select("event_id", F.round(reshape.without_own_row("value", w), 6).alias("near"))


@query("SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1")
def value_counts(spark: SparkSession, folder: str) -> DataFrame:
    return reshape.value_counts(table(spark, folder, "events"), "event_type")


@query("SELECT event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INTEGER AS n FROM events")
def group_numbers(spark: SparkSession, folder: str) -> DataFrame:
    return reshape.numbered(table(spark, folder, "events").select("event_id", "user_id", "ts"), ["user_id"], ["ts", "event_id"]).select("event_id", "n")


@query("SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, round(var_samp(l_quantity), 6) AS var, round(covar_samp(l_quantity, l_discount), 8) AS cov, quantile_cont(l_quantity, 0.9) AS q90, (SELECT l_linenumber FROM lineitem i WHERE i.l_returnflag = o.l_returnflag GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mode FROM lineitem o GROUP BY l_returnflag")
def group_stats(spark: SparkSession, folder: str) -> DataFrame:
    lineitem = table(spark, folder, "lineitem")
    counts = lineitem.groupBy("l_returnflag", "l_linenumber").count()
    modes = counts.groupBy("l_returnflag").agg(F.max_by("l_linenumber", F.struct("count", -F.col("l_linenumber"))).alias("mode"))
    out = lineitem.groupBy("l_returnflag").agg(F.countDistinct("l_suppkey").alias("suppliers"), F.round(F.var_samp("l_quantity"), 6).alias("var"), F.round(F.covar_samp("l_quantity", "l_discount"), 8).alias("cov"), F.percentile("l_quantity", 0.9).alias("q90"))
    return out.join(modes, "l_returnflag")


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality, least(greatest(d.n_chars, 100), 5000)::BIGINT AS chars, CASE d.lang WHEN 'en' THEN 'english' ELSE d.lang END AS lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def cleaning(spark: SparkSession, folder: str) -> DataFrame:
    joined = table(spark, folder, "documents").select("doc_id", "lang", "n_chars").join(table(spark, folder, "labels"), "doc_id", "left")
    return joined.na.fill({"quality": -1}).replace({"en": "english"}, subset=["lang"]).select("doc_id", "quality", reshape.clip(F.col("n_chars"), 100, 5000).cast("long").alias("chars"), "lang")


@query("SELECT c_custkey AS key, c_name AS name, CAST(NULL AS VARCHAR) AS brand FROM customer UNION ALL SELECT p_partkey, p_name, p_brand FROM part")
def concat_frames(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    b = table(spark, folder, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    return reshape.concat(a, b)


@query("SELECT w AS word, count(*) AS n FROM (SELECT unnest(string_split(lower(p_type), ' ')) AS w FROM part) GROUP BY w")
def explode_words(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(F.explode(F.split(F.lower("p_type"), " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, to_base64(encode(p_name)) AS b64, md5(p_name) AS digest, format('{:.2f}', p_retailprice) AS price FROM part")
def encode_scalars(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", F.base64(F.encode("p_name", "UTF-8")).alias("b64"), F.md5("p_name").alias("digest"), F.format_string("%.2f", "p_retailprice").alias("price"))


@query("SELECT c_custkey, length(c_name)::INTEGER AS cols, c_mktsegment AS kind, c_name AS first FROM customer")
def json_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata written as JSON text and read back by schema."""
    info = F.to_json(F.struct(F.array("c_name", F.lit("b")).alias("columns"), F.create_map(F.lit("a"), F.col("c_mktsegment")).alias("dtypes"), F.struct(F.lit(3).alias("rows"), F.length("c_name").alias("cols")).alias("shape")))
    kept = table(spark, folder, "customer").select("c_custkey", info.alias("info"))
    read = kept.withColumn("i", F.from_json("info", "columns array<string>, dtypes map<string,string>, shape struct<rows:int,cols:int>"))
    return read.select("c_custkey", F.col("i.shape.cols").alias("cols"), F.col("i.dtypes")["a"].alias("kind"), F.col("i.columns")[0].alias("first"))


@query("SELECT conv_id, turn FROM conversations WHERE role || '_' || conv_id = 'user_3'")
def session_key_filter(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").where(F.concat_ws("_", "role", "conv_id") == "user_3").select("conv_id", "turn")


@query("SELECT conv_id, count(*) AS messages, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id")
def session_totals(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").groupBy("conv_id").agg(F.count("*").alias("messages"), F.sum(F.length("text")).cast("long").alias("chars"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE '[PDF 1 Content Start: ' || source || ']' || chr(10) || text || chr(10) || '[PDF 1 Content End]' || chr(10) END
  || CASE WHEN lang = 'de' THEN chr(10) || '[SEARCH RESULTS START]' || chr(10) || 'Source 1: ' || lang || chr(10) || 'URL: No URL' || chr(10) || 'Content: ' || text || chr(10) || chr(10) || '[SEARCH RESULTS END]' || chr(10) || chr(10) ELSE '' END
  || 'User: ' || source || chr(10) || 'AI: ' || lang || chr(10)
  || 'Based on the above search results and context, please answer the following question: ' || source || '?' || chr(10) || 'AI:' AS prompt FROM documents
""")
def context_prompt(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts of all four parts, some with no document or no search result."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    blocks = context.document_context(docs.where("doc_id % 3 <> 0"), ["doc_id"], "lang", filename="source", text="text")
    hits = docs.where("lang = 'de'").select("doc_id", F.lit(1).alias("rank"), F.col("lang").alias("title"), F.col("text").alias("body"), F.lit("").alias("href"))
    found = context.search_context(hits, ["doc_id"]).select("doc_id", "block")
    history = context.last_history(docs.select("doc_id", F.lit(1).alias("n"), F.col("source").alias("prompt"), F.col("lang").alias("response")), ["doc_id"], ["n"])
    all_parts = docs.join(blocks, "doc_id", "left").join(found, "doc_id", "left").join(history, "doc_id")
    return all_parts.select("doc_id", context.prompt(F.col("documents"), F.col("block"), F.col("history"), F.concat("source", F.lit("?"))).alias("prompt"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_type, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS kind FROM part")
def registered_functions(spark: SparkSession, folder: str) -> DataFrame:
    registry.install(spark)
    table(spark, folder, "part").createOrReplaceTempView("part")
    return sql.run(spark, "SELECT p_partkey, title_case(p_type) AS kind FROM part")


@query("SELECT vec_id, len(embedding)::INTEGER AS n, embedding[1] AS head, list_position(embedding, embedding[3])::BIGINT AS third, round(list_sum(list_transform(embedding[1:4], lambda x: x::DOUBLE)), 4) + 0.0::DOUBLE AS s4 FROM embeddings")
def array_scalars(spark: SparkSession, folder: str) -> DataFrame:
    v = F.col("embedding")
    total = F.aggregate(F.slice(v, 1, 4), F.lit(0.0), lambda a, x: a + x.cast("double"))
    return table(spark, folder, "embeddings").select("vec_id", F.size(v).alias("n"), v[0].alias("head"), F.array_position(v, v[2]).alias("third"), (F.round(total, 4) + F.lit(0.0)).alias("s4"))


@query("SELECT l.l_orderkey, l.l_partkey, l.l_quantity, r.band FROM lineitem l JOIN (VALUES (1.0e0, 10.0e0, 'small'), (10.0e0, 30.0e0, 'medium'), (30.0e0, 51.0e0, 'large')) r(lo, hi, band) ON l.l_quantity >= r.lo AND l.l_quantity < r.hi")
def join_theta_range(spark: SparkSession, folder: str) -> DataFrame:
    bands = spark.createDataFrame([(1.0, 10.0, "small"), (10.0, 30.0, "medium"), (30.0, 51.0, "large")], "lo double, hi double, band string")
    points = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return reshape.range_join(points, bands, "l_quantity", "lo", "hi", 10.0).select("l_orderkey", "l_partkey", "l_quantity", "band")


@query("SELECT e.event_id, e.user_id, p.value AS right_value FROM events e ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts")
def asof_join(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("event_id", "user_id", "ts", "event_type", "value")
    bought = events.where("event_type = 'purchase'").select("user_id", "ts", "value")
    return reshape.asof_join(events.select("event_id", "user_id", "ts"), bought, ["user_id"], "ts", ["value"]).select("event_id", "user_id", "right_value")


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS \"F\", count(*) FILTER (WHERE o_orderstatus = 'O') AS \"O\", count(*) FILTER (WHERE o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1")
def pivot_counts(spark: SparkSession, folder: str) -> DataFrame:
    return reshape.pivot_counts(table(spark, folder, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("SELECT s_suppkey, 'nation' AS variable, s_nationkey::DOUBLE AS value FROM supplier UNION ALL SELECT s_suppkey, 'balance', s_acctbal FROM supplier")
def melt_long(spark: SparkSession, folder: str) -> DataFrame:
    wide = table(spark, folder, "supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("nation"), F.col("s_acctbal").alias("balance"))
    return reshape.melt(wide, ["s_suppkey"], ["nation", "balance"])


@query("SELECT event_id, CASE WHEN count(value) OVER w >= 3 THEN round(avg(value) OVER w, 6) END AS mean3, round((value - lag(value) OVER o) / nullif(lag(value) OVER o, 0), 6) AS change FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 2 PRECEDING), o AS (PARTITION BY user_id ORDER BY ts, event_id)")
def rolling_mean(spark: SparkSession, folder: str) -> DataFrame:
    order = ["ts", "event_id"]
    return table(spark, folder, "events").select("event_id", F.round(reshape.rolling("value", order, 3, ["user_id"]), 6).alias("mean3"), F.round(reshape.pct_change("value", order, ["user_id"]), 6).alias("change"))


# --- sessions and context


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS n FROM conversations) WHERE n = 1")
def latest_per_session(spark: SparkSession, folder: str) -> DataFrame:
    return reshape.latest_per_session(table(spark, folder, "conversations"), ["conv_id"], ["turn"])


@query("SELECT conv_id, turn, role, text FROM conversations WHERE conv_id = 7 ORDER BY turn")
def session_history(spark: SparkSession, folder: str) -> DataFrame:
    return reshape.session_history(table(spark, folder, "conversations"), {"conv_id": 7}, ["turn"])


_TURNS = "SELECT conv_id, turn, text AS prompt, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS response, role FROM conversations"


@query(f"SELECT conv_id, 'User: ' || coalesce(prompt, '') || chr(10) || 'AI: ' || coalesce(response, '') || chr(10) AS history FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM ({_TURNS}) WHERE role = 'user') WHERE n = 1")
def context_history(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, folder, "conversations").select("conv_id", "turn", F.col("text").alias("prompt"), F.lead("text").over(w).alias("response"), "role")
    return context.last_history(turns.where("role = 'user'"), ["conv_id"], ["turn"])


@query("""
SELECT source, batch, string_agg('[PDF ' || k || ' Content Start: ' || doc_id || ']' || chr(10) || text || chr(10) || '[PDF ' || k || ' Content End]' || chr(10), '' ORDER BY k) AS documents
FROM (SELECT source, doc_id // 400 AS batch, doc_id, text, row_number() OVER (PARTITION BY source, doc_id // 400 ORDER BY doc_id) AS k FROM documents WHERE text IS NOT NULL) WHERE length(text) > 0 GROUP BY source, batch
""")
def context_documents(spark: SparkSession, folder: str) -> DataFrame:
    """A source's uploads in batches, so that no session grows with the table."""
    docs = table(spark, folder, "documents").select("source", F.floor(F.col("doc_id") / 400).cast("long").alias("batch"), "doc_id", F.col("doc_id").cast("string").alias("filename"), F.col("text").alias("extracted_text"))
    return context.document_context(docs, ["source", "batch"], "doc_id")


_HITS = "SELECT source, cast(floor(doc_id / 400) AS bigint) AS batch, row_number() OVER (PARTITION BY source, floor(doc_id / 400) ORDER BY doc_id) AS rank, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS title, CASE WHEN doc_id % 6 IN (0, 1) THEN '' ELSE text END AS body, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'http://x/' || doc_id END AS href FROM documents"


@query(f"""
WITH h AS ({_HITS}),
g AS (SELECT source, batch, count(*) AS n_results, count(*) FILTER (WHERE title <> '' OR body <> '') AS n_valid,
  chr(10) || '[SEARCH RESULTS START]' || chr(10) || coalesce(string_agg('Source ' || rank || ': ' || CASE WHEN title = '' THEN 'No title' ELSE title END || chr(10) || 'URL: ' || CASE WHEN href = '' THEN 'No URL' ELSE href END || chr(10) || 'Content: ' || CASE WHEN body = '' THEN 'No content available' ELSE body END || chr(10) || chr(10), '' ORDER BY rank) FILTER (WHERE title <> '' OR body <> ''), '') || '[SEARCH RESULTS END]' || chr(10) || chr(10) AS full_block FROM h GROUP BY source, batch)
SELECT source, batch, CASE WHEN n_valid > 0 THEN full_block ELSE '' END AS block, n_results, n_valid, length(full_block)::INTEGER AS chars,
  CASE WHEN n_results = 0 THEN 'No results found' WHEN n_valid = 0 THEN 'All results empty' WHEN length(full_block) < 100 THEN 'not successful' ELSE 'success' END AS status FROM g
""")
def search_block_status(spark: SparkSession, folder: str) -> DataFrame:
    table(spark, folder, "documents").createOrReplaceTempView("documents")
    return context.search_context(spark.sql(_HITS), ["source", "batch"])


def _topup_sql(most: int | None) -> str:
    n = "least(3, (SELECT count(*) FROM n))" if most is None else f"least({most} - 2, (SELECT count(*) FROM n))"
    total = 5 if most is None else most
    return f"""
WITH a AS (SELECT doc_id FROM documents WHERE source = 'src1'), n AS (SELECT doc_id FROM documents WHERE source = 'src2'), w AS (SELECT doc_id FROM documents WHERE source = 'src3'),
r AS (SELECT 1 AS priority, doc_id, row_number() OVER (ORDER BY doc_id) AS i FROM a UNION ALL SELECT 2, doc_id, row_number() OVER (ORDER BY doc_id) FROM n UNION ALL SELECT 3, doc_id, row_number() OVER (ORDER BY doc_id) FROM w),
t AS (SELECT least(2, (SELECT count(*) FROM a)) AS ta, {n} AS tn),
p AS (SELECT r.* FROM r, t WHERE (priority = 1 AND i <= ta) OR (priority = 2 AND i <= tn) OR (priority = 3 AND i <= {total} - ta - tn))
SELECT doc_id, priority::INTEGER AS priority, (row_number() OVER (ORDER BY priority, doc_id))::INTEGER AS rank FROM p
"""


def _ranked_sources(spark: SparkSession, folder: str) -> list[DataFrame]:
    docs = table(spark, folder, "documents").select("doc_id", "source")
    return [docs.where(f"source = 'src{i}'").select("doc_id") for i in (1, 2, 3)]


@query(_topup_sql(None))
def topup_union(spark: SparkSession, folder: str) -> DataFrame:
    return topup.topup(*_ranked_sources(spark, folder), pos="doc_id")


@query(_topup_sql(9))
def topup_union_fill(spark: SparkSession, folder: str) -> DataFrame:
    return topup.topup(*_ranked_sources(spark, folder), pos="doc_id", most=9)


@query("SELECT p_partkey, replace(p_name, ' ', '') AS name FROM part p WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_quantity > 45)")
def not_added_yet(spark: SparkSession, folder: str) -> DataFrame:
    old = table(spark, folder, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return reshape.not_added_yet(table(spark, folder, "part"), old, ["p_partkey"]).select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("")).alias("name"))


# --- ingest and text


@query("SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS price, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END::DOUBLE AS done, o_orderpriority AS priority FROM orders")
def numeric_coercion(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    texts = orders.select("o_orderkey", F.format_number("o_totalprice", 2).alias("price"), F.when(F.col("o_orderstatus") == "F", "True").otherwise("False").alias("done"), F.col("o_orderpriority").alias("priority"))
    typed = csv_ingest.coerce_numbers(texts)
    return typed.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.round("price", 2).alias("price"), "done", "priority")


@query("SELECT doc_id, lower(list_last(string_split(source || '.TXT', '.'))) AS ext, substr(text, 1, 10) || '...' || right(text, 4) AS masked, substr(text, 1, 20) AS title, length(text) > 0 AS has_text FROM documents")
def text_scalars(spark: SparkSession, folder: str) -> DataFrame:
    x = F.col("text")
    return table(spark, folder, "documents").select("doc_id", scalars.extension(F.concat("source", F.lit(".TXT"))).alias("ext"), scalars.mask(x).alias("masked"), scalars.title_of(x).alias("title"), (F.length(x) > 0).alias("has_text"))


@query("""
SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 2 ELSE 1 END::INTEGER AS size, greatest(o_custkey, 500)::BIGINT AS at_least, CAST(NULL AS DOUBLE) AS nothing, CAST(NULL AS BIGINT) AS rest,
  round(o_totalprice / 1000) AS thousands, strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH + to_days((day(o_orderdate) - 1)::INTEGER), '%Y-%m-%d') AS due, o_orderpriority ILIKE '1-urg%' AS urgent FROM orders
""")
def sqlite_dialect(spark: SparkSession, folder: str) -> DataFrame:
    """Meanings of the embedded-database dialect, written as its users write them."""
    table(spark, folder, "orders").createOrReplaceTempView("orders")
    return sqlite_compat.run(spark, """SELECT o_orderkey, iif(o_totalprice > 100000, 2, 1) AS size, max(o_custkey, 500) AS at_least, o_totalprice / 0 AS nothing, "o_orderkey" % 0 AS rest, round(o_totalprice / 1000) AS thousands, date(o_orderdate, '+1 month') AS due, o_orderpriority LIKE '1-URG%' AS urgent FROM orders""")


@query("SELECT o_orderstatus, sum(o_totalprice)::DOUBLE::BIGINT // 1000 AS total, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS kinds FROM orders GROUP BY o_orderstatus")
def sqlite_aggregates(spark: SparkSession, folder: str) -> DataFrame:
    table(spark, folder, "orders").select("o_orderstatus", "o_orderpriority", "o_totalprice").createOrReplaceTempView("orders")
    got = sqlite_compat.run(spark, "SELECT o_orderstatus, total(abs(o_totalprice)) AS total, group_concat(DISTINCT o_orderpriority) AS kinds FROM orders GROUP BY o_orderstatus")
    return got.select("o_orderstatus", F.floor(F.col("total") / 1000).alias("total"), F.array_join(F.array_sort(F.split("kinds", ",")), ",").alias("kinds"))


_GUARDED = [
    ("select 1", True), ("  SELECT 1", True), ("with c as (select 1) select * from c", True), ("with c as (select 1) insert into x select * from c", False), ("drop table x", False), ("insert into x values (1)", False),
    ("set a=b", False), ("select 1; select 2", False), ("select transform(a) using 'cat' from t", False), ("select java_method('java.lang.System', 'exit', 1)", False), ("select * from parquet.`/path`", False),
    ("select identifier('java_method')('java.util.UUID', 'randomUUID')", False), ("with c as (select identifier('reflect')('a', 'b')) select * from c", False), ("select (select identifier('reflect')('a', 'b'))", False),
    ("execute immediate 'create temporary view zz as select 1 as a'", False),
]


@query("SELECT * FROM (VALUES " + ", ".join("('" + c.replace("'", "''") + f"', {ok}, {c.strip().lower().startswith('select')})" for c, ok in _GUARDED) + ") t(text, allowed, by_prefix)")
def sql_guard(spark: SparkSession, folder: str) -> DataFrame:
    return spark.createDataFrame([(c, sql.is_read_only(spark, c), sql.starts_with_select(c)) for c, _ in _GUARDED], "text string, allowed boolean, by_prefix boolean")


@query("SELECT o_orderkey::DOUBLE AS key, round(o_totalprice, 2) AS price, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS status FROM orders")
def csv_ingest_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Orders written as a messy CSV folder and read back."""
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias(" key "), F.format_number("o_totalprice", 2).alias("price"), F.when(F.col("o_orderkey") % 5 == 0, "NA").otherwise(F.col("o_orderstatus")).alias("status"))
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp()
    path = f"{base.rstrip('/')}/csv-{spark.sparkContext.applicationId}"
    orders.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    name = [f for f in spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path).select("path").limit(1).collect()][0].path
    return csv_ingest.read_csv(spark, name)


_ASKED = [
    ("What is the average l_extendedprice?", "summary", ["l_extendedprice"]), ("describe the data", "describe", []), ("average l_extendedprice by l_quantity", "summary", ["l_quantity"]),
    ("l_extendedprice by l_quantity", "grouped", ["l_quantity", "l_quantity"]), ("l_quantity by l_discount", "grouped", ["l_quantity", "l_discount"]), ("compare l_tax by l_quantity", "grouped", ["l_quantity", "l_quantity"]),
    ("show by l_returnflag", "grouped", ["median_income", "l_returnflag"]), ("Histogram of l_discount", "histogram", ["l_discount"]), ("show the distribution", "histogram", ["l_orderkey"]),
    ("correlation heatmap", "corr_matrix", [*LINEITEM]), ("relationship between l_tax and l_discount", "scatter", ["l_tax", "l_discount"]), ("compare quantity vs extendedprice", "scatter", ["l_quantity", "l_extendedprice"]),
    ("correlation of demand for x", "scatter", ["l_orderkey", "l_partkey"]), ("compare prices", "profile", []), ("trend of l_tax", "trend", ["l_tax"]), ("l_tax over time by month", "grouped", ["l_tax", "l_partkey"]),
    ("monthly progression", "trend", ["l_orderkey"]), ("l_tax grouped by range of l_discount", "grouped", ["l_discount", "l_discount"]), ("administrator count", "describe", []), ("hello", "profile", []),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{k}', [" + ", ".join(f"'{c}'" for c in cols) + "]::VARCHAR[])" for a, k, cols in _ASKED) + ") t(question, kind, columns)")
def intent_cases(spark: SparkSession, folder: str) -> DataFrame:
    """What questions about lineitem compile to."""
    lineitem = table(spark, folder, "lineitem")
    plans: list[Intent] = [compile_question(a, lineitem) for a, _, _ in _ASKED]
    return spark.createDataFrame([(a, p.kind, [*p.columns]) for (a, _, _), p in zip(_ASKED, plans, strict=True)], "question string, kind string, columns array<string>")

"""The same results in SQL, for DuckDB over the same Parquet tables."""

from __future__ import annotations

import math

ORACLES: dict[str, str] = {}

LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

ORDERS = """orders_gaps AS (
  SELECT o_orderkey, o_custkey,
         CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS o_orderstatus,
         CASE WHEN o_orderkey % 20 <> 0 THEN o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority
  FROM orders)"""

DOCUMENTS = r"""docs AS (
  SELECT d.doc_id, CAST(n_chars AS DOUBLE) AS n_chars,
         CAST(len(string_split_regex(text, '\s+')) AS DOUBLE) AS words,
         CAST(length(regexp_replace(text, '[^0-9]', '', 'g')) AS DOUBLE) AS digits, toxic, quality
  FROM documents d JOIN labels USING (doc_id))"""

GUESSES = """guesses AS (
  SELECT l_returnflag AS label,
         CASE WHEN l_quantity < 20 THEN 'A' WHEN l_quantity < 35 THEN 'N' ELSE 'R' END AS prediction
  FROM lineitem)"""


def union(parts) -> str:
    return " UNION ALL ".join(parts)


def key(row_id: str, seed: str = "42") -> str:
    return f"CAST('0x' || substr(md5(CAST({row_id} AS VARCHAR) || '|{seed}'), 1, 15) AS BIGINT)"


def unit(row_id: str, seed: str) -> str:
    return f"({key(row_id, seed)} / 1152921504606846976.0::DOUBLE)"


def half_up(x: str, places: int) -> str:
    """Round as a decimal, so that a tie goes up on both engines."""
    return f"CAST(round(CAST({x} AS DECIMAL(28, 10)), {places}) AS DOUBLE)"


def fences(table: str, column: str) -> str:
    return f"""SELECT quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.5) AS median,
        quantile_cont({column}, 0.75) AS q3, q3 - q1 AS iqr,
        q1 - 1.5 * iqr AS lo, q3 + 1.5 * iqr AS hi FROM {table}"""


def adjusted_skewness(x: str) -> str:
    return f"CASE WHEN min({x}) = max({x}) THEN 0.0 ELSE skewness({x}) END"


ORACLES["s_csv_scan"] = ORACLES["s_csv_scan_mixed"] = "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer"
ORACLES["s_csv_encoding"] = "SELECT doc_id, text, lang, source, n_chars FROM documents"

ORACLES["p_dropna"] = f"WITH {ORDERS} SELECT * FROM orders_gaps WHERE o_totalprice IS NOT NULL AND o_orderstatus IS NOT NULL"
ORACLES["p_target_mask"] = f"WITH {ORDERS} SELECT * FROM orders_gaps WHERE o_orderstatus IS NOT NULL"
ORACLES["p_drop_null_columns"] = "SELECT p_partkey, p_retailprice FROM part"
ORACLES["p_coerce_numeric"] = """
SELECT p_partkey, TRY_CAST(replace(p_brand, 'Brand#', '') AS DOUBLE) AS brand, TRY_CAST(p_type AS DOUBLE) AS kind FROM part"""
ORACLES["p_scatter_pairs"] = "SELECT l_returnflag, l_quantity, l_discount FROM lineitem WHERE l_discount <> 0.0"

_kinds = {"o_orderkey": "int64", "o_custkey": "int64", "o_orderstatus": "object", "o_totalprice": "float64", "o_orderdate": "datetime64", "o_orderpriority": "object"}
ORACLES["a_null_profile"] = f"WITH {ORDERS} " + union(
    f"SELECT '{c}' AS column_name, {i} AS position, '{k}' AS type, count(*) - count({c}) AS missing, "
    f"{half_up(f'100.0 * (count(*) - count({c})) / count(*)', 2)} AS missing_pct FROM orders_gaps"
    for i, (c, k) in enumerate(_kinds.items())
)
ORACLES["a_table_quality"] = f"""WITH {ORDERS}, m AS (
  SELECT count(*) AS rows, 6 * count(*) - {" - ".join(f"count({c})" for c in _kinds)} AS missing_cells FROM orders_gaps)
SELECT rows, CAST(6 AS BIGINT) AS columns, missing_cells, round(100.0 * missing_cells / (rows * 6), 6) AS missing_pct,
       CAST(3 AS BIGINT) AS numeric_columns, CAST(2 AS BIGINT) AS string_columns FROM m"""
ORACLES["a_duplicate_rows"] = """
WITH twice AS (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 10 = 0)
SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM twice)) AS duplicates FROM twice"""
ORACLES["a_describe"] = union(
    f"SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, "
    f"round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.5), 4) AS median, "
    f"round(quantile_cont({c}, 0.75), 4) AS q3, round(max({c}), 4) AS max FROM lineitem"
    for c in LINE_NUMBERS
)
LINE_TYPES = """lines AS (
  SELECT CAST(l_quantity AS DOUBLE) AS as_float, CAST(l_quantity * 2 AS DOUBLE) AS as_decimal,
         CAST(l_linenumber AS DOUBLE) AS as_smallint, CAST(l_linenumber AS DOUBLE) AS as_tinyint,
         CAST(l_partkey AS DOUBLE) AS as_int
  FROM lineitem)"""
TYPED = ["as_float", "as_decimal", "as_smallint", "as_tinyint", "as_int"]
ORACLES["a_describe_types"] = f"WITH {LINE_TYPES} " + union(
    f"SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, "
    f"round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.5), 4) AS median, "
    f"round(quantile_cont({c}, 0.75), 4) AS q3, round(max({c}), 4) AS max FROM lines"
    for c in TYPED
)
ORACLES["a_distribution_stats"] = union(
    f"SELECT {i} AS position, '{name}' AS statistic, round({e}, 6) AS value FROM events"
    for i, (name, e) in enumerate(
        {
            "Count": "CAST(count(value) AS DOUBLE)", "Mean": "avg(value)", "Median": "quantile_cont(value, 0.5)",
            "Std": "stddev_samp(value)", "Min": "min(value)", "Q1": "quantile_cont(value, 0.25)",
            "Q3": "quantile_cont(value, 0.75)", "Max": "max(value)", "Skewness": "skewness(value)",
        }.items()
    )
)
ORACLES["a_score_bands"] = union(
    f"SELECT '{band}' AS band, count(*) FILTER ({test}) AS n, round(100.0 * count(*) FILTER ({test}) / count(*), 6) AS pct FROM events"
    for band, test in {
        "0-25": "value < 25", "25-50": "value >= 25 AND value < 50", "50-75": "value >= 50 AND value < 75", "75-100": "value >= 75",
    }.items()
)
ORACLES["a_quantiles"] = ORACLES["a_quantiles_bracketed"] = union(
    f"SELECT '{c}' AS column_name, CAST({p} AS DOUBLE) AS p, round(quantile_cont({c}, {p}), 6) AS value FROM lineitem"
    for c in LINE_NUMBERS for p in (0.05, 0.25, 0.5, 0.75, 0.95)
)
ORACLES["a_skewness"] = union(
    [f"SELECT '{c}' AS column_name, round({adjusted_skewness(c)}, 6) AS skewness FROM lineitem" for c in LINE_NUMBERS]
    + ["SELECT 'constant' AS column_name, CAST(0.0 AS DOUBLE) AS skewness"]
)
ORACLES["a_correlation"] = "SELECT round(corr(l_discount, l_extendedprice), 6) AS correlation FROM lineitem WHERE l_discount <> 0.0"
_line = """CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n,
  round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
  round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 4) AS r2"""
ORACLES["a_ols_by_group"] = f"SELECT l_returnflag, {_line} FROM lineitem GROUP BY l_returnflag"
ORACLES["a_ols_overall"] = f"SELECT {_line} FROM lineitem"
_boxes = """WITH q AS (
  SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3
  FROM events GROUP BY event_type),
b AS (
  SELECT event_type, value, q1, median, q3,
         value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS far
  FROM events JOIN q USING (event_type))"""
ORACLES["a_box_stats"] = ORACLES["a_box_stats_bracketed"] = f"""{_boxes}
SELECT event_type, count(*) AS n, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median,
       round(any_value(q3), 6) AS q3, round(min(value) FILTER (NOT far), 6) AS whisker_low,
       round(max(value) FILTER (NOT far), 6) AS whisker_high, count(*) FILTER (far) AS outliers
FROM b GROUP BY event_type"""
ORACLES["a_box_outliers"] = f"{_boxes} SELECT event_type, value FROM b WHERE far"
ORACLES["a_histogram"] = """WITH r AS (SELECT min(value) AS lo, (max(value) - min(value)) / 30 AS w FROM events),
c AS (SELECT CAST(least(floor((value - lo) / w), 29) AS INTEGER) AS bin, count(*) AS n FROM events, r GROUP BY 1)
SELECT CAST(b.bin AS INTEGER) AS bin, round(lo + b.bin * w, 6) AS low, round(lo + (b.bin + 1) * w, 6) AS high, coalesce(n, 0) AS n
FROM range(30) AS b(bin) CROSS JOIN r LEFT JOIN c ON c.bin = b.bin"""
ORACLES["a_distinct_values"] = f"WITH {ORDERS} SELECT DISTINCT o_orderstatus AS value FROM orders_gaps WHERE o_orderstatus IS NOT NULL"
ORACLES["a_value_counts"] = f"""WITH {ORDERS}
SELECT o_orderstatus AS value, count(*) AS n FROM orders_gaps WHERE o_orderstatus IS NOT NULL GROUP BY 1"""
ORACLES["a_range"] = union(f"SELECT '{c}' AS column_name, min({c}) AS min, max({c}) AS max FROM lineitem" for c in LINE_NUMBERS)
ORACLES["t_head"] = "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10"

_chi2 = (
    "WITH v AS ("
    + union(
        f"SELECT '{c}' AS feature, l_returnflag AS y, {c} - (SELECT min({c}) FROM lineitem) + 1 AS x FROM lineitem"
        for c in LINE_NUMBERS
    )
    + """), o AS (SELECT feature, y, sum(x) AS seen, count(*) AS n FROM v GROUP BY ALL),
e AS (SELECT *, sum(seen) OVER (PARTITION BY feature) * n / sum(n) OVER (PARTITION BY feature) AS due FROM o),
s AS (SELECT feature, sum((seen - due) * (seen - due) / due) AS chi2_score FROM e GROUP BY feature)"""
)
ORACLES["t_topk_features"] = f"{_chi2} SELECT feature, round(chi2_score, 4) AS chi2_score FROM s ORDER BY s.chi2_score DESC, feature LIMIT 3"
ORACLES["f_chi2"] = f"""{_chi2}
SELECT feature, round(chi2_score, 4) AS chi2_score, round(exp(-s.chi2_score / 2), 4) AS p_value FROM s"""

ORACLES["f_standard_scale"] = (
    "SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"round((l.{c} - m_{c}) / s_{c}, 6) AS {c}" for c in LINE_NUMBERS)
    + " FROM lineitem l, (SELECT "
    + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in LINE_NUMBERS)
    + " FROM lineitem)"
)
ORACLES["f_one_hot"] = (
    f"WITH {ORDERS} SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, "
    + ", ".join(
        f"CAST(coalesce({c} = '{v}', false) AS INTEGER) AS \"{c}_{v}\""
        for c, values in {
            "o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], "o_orderstatus": ["F", "O", "P"],
        }.items()
        for v in values
    )
    + " FROM orders_gaps"
)
ORACLES["f_label_encode"] = ORACLES["f_label_encode_shuffled"] = f"""WITH {ORDERS},
p AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT o_orderpriority AS v FROM orders_gaps)),
s AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT coalesce(o_orderstatus, 'nan') AS v FROM orders_gaps))
SELECT o_orderkey, CAST(p.code AS INTEGER) AS o_orderpriority, o_orderstatus, CAST(s.code AS INTEGER) AS status_code
FROM orders_gaps JOIN p ON p.v = o_orderpriority JOIN s ON s.v = coalesce(o_orderstatus, 'nan')"""


_sparse = ["day", "o_orderpriority", "o_orderstatus"]
ORACLES["f_one_hot_sparse"] = f"""WITH {ORDERS},
o AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority, o_orderstatus FROM orders_gaps),
v AS ({union(f"SELECT DISTINCT {i} AS c, {c} AS v FROM o WHERE {c} IS NOT NULL" for i, c in enumerate(_sparse))}),
p AS (SELECT c, v, CAST(row_number() OVER (ORDER BY c, v) - 1 AS INTEGER) AS place FROM v)
SELECT o_orderkey, {", ".join(f"p{i}.place AS {c}_at" for i, c in enumerate(_sparse))}
FROM o {" ".join(f"LEFT JOIN p p{i} ON p{i}.c = {i} AND p{i}.v = o.{c}" for i, c in enumerate(_sparse))}"""


def detected(table: str, column: str, digits: int = 6) -> str:
    return f"""SELECT '{column}' AS column_name, round(any_value(q1), {digits}) AS q1, round(any_value(q3), {digits}) AS q3,
  round(any_value(iqr), {digits}) AS iqr, round(any_value(lo), {digits}) AS lower_bound, round(any_value(hi), {digits}) AS upper_bound,
  count(*) FILTER ({column} < lo OR {column} > hi) AS outlier_count,
  round(100.0 * count(*) FILTER ({column} < lo OR {column} > hi) / count({column}), {digits}) AS outlier_percentage,
  min({column}) AS min_value, max({column}) AS max_value, round(avg({column}), {digits}) AS mean, round(stddev_samp({column}), {digits}) AS std,
  count(*) FILTER ({column} < lo) AS outliers_below, count(*) FILTER ({column} > hi) AS outliers_above
FROM {table}, ({fences(table, column)})"""


ORACLES["f_outlier_detect"] = union([detected("events", "value"), detected("customer", "c_acctbal")])
ORACLES["f_outlier_detect_types"] = f"WITH {LINE_TYPES} " + union(detected("lines", c, 4) for c in TYPED)
ORACLES["f_outlier_table"] = f"""SELECT 'value' AS column_name, count(*) FILTER (value < lo OR value > hi) AS outliers,
  printf('%.1f%%', 100.0 * count(*) FILTER (value < lo OR value > hi) / count(value)) AS pct,
  printf('%.4f', any_value(lo)) AS lower_bound, printf('%.4f', any_value(hi)) AS upper_bound
FROM events, ({fences("events", "value")})"""
ORACLES["f_outlier_cap"] = f"""SELECT event_id, event_type,
  round(CASE WHEN value < lo THEN lo WHEN value > hi THEN hi ELSE value END, 6) AS value
FROM events, ({fences("events", "value")})"""


def capped(table: str, column: str) -> str:
    clipped = f"CASE WHEN {column} < lo THEN lo WHEN {column} > hi THEN hi ELSE CAST({column} AS DOUBLE) END"
    return union(
        f"""SELECT '{column}' AS column_name, '{stage}' AS stage, count(x) AS count, round(avg(x), 6) AS mean,
  round(stddev_samp(x), 6) AS std, round(min(x), 6) AS min, round(quantile_cont(x, 0.25), 6) AS q1,
  round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.75), 6) AS q3, round(max(x), 6) AS max,
  count(*) FILTER (far) AS outlier_count
FROM (SELECT {x} AS x, {column} < lo OR {column} > hi AS far FROM {table}, ({fences(table, column)}))"""
        for stage, x in (("before", f"CAST({column} AS DOUBLE)"), ("after", clipped))
    )


ORACLES["f_outlier_cap_stats"] = union([capped("events", "value"), capped("documents", "n_chars")])
ORACLES["f_outlier_summary"] = f"""WITH c AS (
  SELECT value AS before, CASE WHEN value < lo THEN lo WHEN value > hi THEN hi ELSE value END AS after
  FROM events, ({fences("events", "value")}))
SELECT 'value' AS column_name, """ + ", ".join(
    f"printf('%.4f', {f}({s})) AS {s}_{m}"
    for m, f in {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}.items() for s in ("before", "after")
) + " FROM c"
ORACLES["f_skew_report"] = union(
    f"SELECT '{c}' AS column_name, round(skewness({c}), 4) AS skewness, "
    f"CASE WHEN abs(skewness({c})) > 0.5 THEN 'Yes' ELSE 'No' END AS skewed FROM {t}"
    for t, c in (("events", "value"), ("orders", "o_totalprice"))
)


def logged(column: str, low: str) -> str:
    return f"ln(1 + {column} + CASE WHEN {low} <= 0 THEN abs({low}) + 1 ELSE 0 END)"


ORACLES["f_skew_before_after"] = union(
    f"SELECT '{c}' AS column_name, round(skewness({c}), 6) AS before, round(skewness({logged(c, 'lo')}), 6) AS after "
    f"FROM {t}, (SELECT min({c}) AS lo FROM {t})"
    for t, c in (("events", "value"), ("customer", "c_acctbal"))
)
ORACLES["f_log_transform"] = f"""SELECT c_custkey, round({logged("c_acctbal", "lo")}, 6) AS c_acctbal
FROM customer, (SELECT min(c_acctbal) AS lo FROM customer)"""
ORACLES["f_log_transform_skewed"] = f"""SELECT event_id,
  CASE WHEN abs(su) > 0.5 THEN round({logged("user_id", "lu")}, 6) ELSE user_id END AS user_id,
  CASE WHEN abs(sv) > 0.5 THEN round({logged("value", "lv")}, 6) ELSE value END AS value
FROM events, (SELECT min(user_id) AS lu, skewness(user_id) AS su, min(value) AS lv, skewness(value) AS sv FROM events)"""
ORACLES["f_impute_median"] = f"""WITH {ORDERS}
SELECT o_orderkey, o_custkey, o_orderstatus, round(coalesce(o_totalprice, m), 6) AS o_totalprice, o_orderdate, o_orderpriority
FROM orders_gaps, (SELECT quantile_cont(o_totalprice, 0.5) AS m FROM orders_gaps)"""


def codes(column: str) -> str:
    return f"(SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT {column} AS v FROM parts))"


ORACLES["f_clean_data"] = f"""WITH parts AS (
  SELECT p_partkey, p_name, coalesce(nullif(p_brand, 'Brand#2'), 'nan') AS p_brand, p_type, nullif(p_size, 1) AS p_size, p_retailprice
  FROM part)
SELECT p_partkey, n.code AS p_name, b.code AS p_brand, t.code AS p_type,
       round(coalesce(p_size, (SELECT avg(p_size) FROM parts)), 6) AS p_size, p_retailprice
FROM parts JOIN {codes("p_name")} n ON n.v = p_name JOIN {codes("p_brand")} b ON b.v = p_brand JOIN {codes("p_type")} t ON t.v = p_type"""
ORACLES["f_quantile_bin"] = """SELECT o_orderkey, o_totalprice,
  CAST(o_totalprice > a AS INTEGER) + CAST(o_totalprice > b AS INTEGER) + CAST(o_totalprice > c AS INTEGER) AS bin
FROM orders, (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS b,
                     quantile_cont(o_totalprice, 0.75) AS c FROM orders)"""
ORACLES["f_quantile_bin_repeated"] = """WITH d AS (
  SELECT l_orderkey, CASE WHEN l_discount < 0.03 THEN 0.0 ELSE l_discount END AS l_discount FROM lineitem),
e AS (SELECT list_sort(list_distinct(quantile_cont(l_discount, [0.0, 0.25, 0.5, 0.75, 1.0]))) AS edges FROM d)
SELECT l_orderkey, l_discount, CAST(len(list_filter(edges[2:-2], lambda x: x < l_discount)) AS INTEGER) AS bin FROM d, e"""


def neighbour_information(table: str, row_id: str, target: str, columns: list[str]) -> str:
    """The estimator by comparing all pairs: the independent check of the sorted form."""
    points = union(
        f"SELECT '{c}' AS feature, {row_id} AS id, {target} AS y, ({c} - m) / s + ({unit(row_id, f'42|{c}')} * 2 - 1) * 3e-10 AS x "
        f"FROM {table}, (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM {table})"
        for c in columns
    )
    psi = "(coalesce(list_sum(list_transform(range(1, CAST({} AS BIGINT)), lambda i: 1.0::DOUBLE / i)), 0.0::DOUBLE) - 0.5772156649015329)"
    return f"""WITH p AS ({points}), c AS (SELECT feature, y, count(*) AS nc FROM p GROUP BY ALL HAVING count(*) > 1),
q AS (SELECT p.*, nc, least(3, nc - 1) AS k FROM p JOIN c USING (feature, y)),
d AS (SELECT a.feature, a.id, any_value(a.k) AS k, list_sort(list(abs(a.x - b.x))) AS near
      FROM q a JOIN q b ON a.feature = b.feature AND a.y = b.y AND a.id <> b.id GROUP BY ALL),
r AS (SELECT q.*, near[d.k] AS r FROM q JOIN d USING (feature, id)),
m AS (SELECT a.feature, a.id, any_value(a.k) AS k, any_value(a.nc) AS nc, count(*) AS m
      FROM r a JOIN q b ON a.feature = b.feature AND (abs(a.x - b.x) < a.r OR a.x = b.x) GROUP BY a.feature, a.id)
SELECT feature, round(greatest({psi.format("count(*)")} + avg({psi.format("k")}) - avg({psi.format("nc")}) - avg({psi.format("m")}), 0), 4)
  AS mutual_info FROM m GROUP BY feature"""


ORACLES["f_mutual_info"] = ORACLES["f_mutual_info_sliced"] = neighbour_information("part", "p_partkey", "p_type", ["p_size", "p_retailprice"])
_deciles = [i / 10 for i in range(11)]
ORACLES["f_mutual_info_binned"] = (
    "WITH v AS ("
    + union(
        f"""SELECT '{c}' AS feature, l_returnflag AS y, len(list_filter(edges, lambda e: e < {c})) AS bin
        FROM lineitem, (SELECT list_distinct(quantile_cont({c}, {_deciles[1:-1]})) AS edges FROM lineitem)"""
        for c in LINE_NUMBERS
    )
    + """), c AS (SELECT feature, bin, y, count(*)::DOUBLE AS n FROM v GROUP BY ALL),
w AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, bin) AS b,
             sum(n) OVER (PARTITION BY feature, y) AS k FROM c)
SELECT feature, round(greatest(sum(n / t * ln(n * t / (b * k))), 0.0), 6) AS mutual_info FROM w GROUP BY feature"""
)
ORACLES["f_target_profile"] = f"""WITH {ORDERS},
a AS (SELECT o_orderstatus AS v FROM orders_gaps WHERE o_orderstatus IS NOT NULL)
SELECT 'o_orderstatus' AS target, 'Categorical' AS kind, 'Classification' AS model_type,
       (SELECT count(DISTINCT v) FROM a) AS n_unique, v AS category, CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max
FROM (SELECT DISTINCT v FROM a)
UNION ALL SELECT 'l_tax', 'Categorical', 'Classification', (SELECT count(DISTINCT l_tax) FROM lineitem), CAST(v AS VARCHAR), NULL, NULL
FROM (SELECT DISTINCT l_tax AS v FROM lineitem)
UNION ALL SELECT 'l_quantity', 'Numerical', 'Regression', count(DISTINCT l_quantity), NULL, min(l_quantity), max(l_quantity) FROM lineitem"""

_canonical = dict(zip(LINE_NUMBERS, ["MP_Count_per_L", "Risk_Score", "Microplastic_Size_mm_midpoint", "Density_midpoint"]))
ORACLES["l_preprocess_preset"] = (
    "WITH s AS (SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"(l.{c} - m_{c}) / s_{c} AS {c}" for c in LINE_NUMBERS)
    + " FROM lineitem l, (SELECT "
    + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in LINE_NUMBERS)
    + " FROM lineitem)) SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"round({logged(c, f'lo_{c}')}, 6) AS {_canonical[c]}" for c in LINE_NUMBERS)
    + " FROM s, (SELECT " + ", ".join(f"min({c}) AS lo_{c}" for c in LINE_NUMBERS) + " FROM s)"
)
ORACLES["l_preprocess_full"] = f"""WITH c AS (
  SELECT event_id, event_type, CASE WHEN value < lo THEN lo WHEN value > hi THEN hi ELSE value END AS v
  FROM events, ({fences("events", "value")})),
g AS (SELECT event_id, event_type, {logged("v", "lv")} AS v FROM c, (SELECT min(v) AS lv FROM c))
SELECT event_id, round((v - m) / s, 5) AS "Risk_Score", """ + ", ".join(
    f"CAST(event_type = '{t}' AS INTEGER) AS \"Location_{t}\"" for t in ("click", "error", "purchase", "signup", "view")
) + " FROM g, (SELECT avg(v) AS m, stddev_pop(v) AS s FROM g)"

_ranked = f"row_number() OVER (ORDER BY {key('o_orderkey')}, o_orderkey)"
_ranked_in_class = f"row_number() OVER (PARTITION BY o_orderpriority ORDER BY {key('o_orderkey')}, o_orderkey)"
ORACLES["m_split_random"] = ORACLES["m_split_random_cut"] = f"""
SELECT o_orderkey, o_orderpriority, CAST({_ranked} <= ceil((SELECT count(*) FROM orders) * 2 / 10.0) AS INTEGER) AS is_test FROM orders"""
ORACLES["m_split_stratified"] = f"""WITH n AS (SELECT o_orderpriority AS y, count(*) AS c, sum(count(*)) OVER () AS t FROM orders GROUP BY 1),
s AS (SELECT *, CAST(t - ceil(t * 2 / 10.0) AS BIGINT) AS train FROM n),
f AS (SELECT *, (train * c) // t AS whole, row_number() OVER (ORDER BY (train * c) % t DESC, y) AS turn FROM s),
w AS (SELECT y, c - whole - CASE WHEN turn <= train - (SELECT sum(whole) FROM f) THEN 1 ELSE 0 END AS test FROM f)
SELECT o_orderkey, o_orderpriority, CAST({_ranked_in_class} <= test AS INTEGER) AS is_test
FROM orders JOIN w ON y = o_orderpriority"""
ORACLES["m_fold_assign"] = ORACLES["m_fold_assign_cut"] = f"""WITH n AS (
  SELECT o_orderpriority AS y, count(*) AS c, sum(count(*)) OVER (ORDER BY o_orderpriority) - count(*) AS start FROM orders GROUP BY 1),
a AS (SELECT y, i AS fold, (SELECT count(*) FROM range(CAST(start AS BIGINT), CAST(start + c AS BIGINT)) t(p) WHERE p % 5 = i) AS held
      FROM n, range(5) r(i)),
e AS (SELECT y, fold, sum(held) OVER (PARTITION BY y ORDER BY fold) AS upto, held FROM a),
o AS (SELECT o_orderkey, o_orderpriority, {_ranked_in_class} AS place FROM orders)
SELECT o_orderkey, o_orderpriority, CAST(fold AS INTEGER) AS fold FROM o JOIN e ON y = o_orderpriority AND place <= upto AND place > upto - held"""
ORACLES["m_class_weights_many"] = """WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
SELECT o_custkey, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight FROM n"""
_LONG, _SHORT = (
    f"(SELECT unnest({names}) AS model)"
    for names in (
        ["Logistic Regression", "RandomForestClassifier", "GradientBoostingClassifier"],
        ["Logistic Regression", "Random Forest", "Gradient Boosting"],
    )
)
ORACLES["m_predict"] = f"""SELECT p_partkey AS id, model,
  CASE WHEN p_size <= 15 THEN 'Low' WHEN p_size <= 30 THEN 'Medium' ELSE 'High' END AS predicted FROM part, {_LONG}"""
ORACLES["m_evaluate_ruled"] = f"""SELECT model, CAST(1 AS DOUBLE) AS accuracy, CAST(1 AS DOUBLE) AS precision,
  CAST(1 AS DOUBLE) AS recall, CAST(1 AS DOUBLE) AS f1, CAST(NULL AS VARCHAR) AS error FROM {_LONG}"""
ORACLES["m_categories_ruled"] = ORACLES["m_evaluate_ruled"]
ORACLES["m_cross_validate_ruled"] = f"""SELECT model, CAST(1 AS DOUBLE) AS mean_accuracy, CAST(0 AS DOUBLE) AS std_accuracy,
  CAST(1 AS DOUBLE) AS mean_f1, CAST(0 AS DOUBLE) AS std_f1, CAST(NULL AS VARCHAR) AS error FROM {_SHORT}"""
ORACLES["m_best_model_ruled"] = """SELECT 'Logistic Regression' AS model, CAST(1 AS DOUBLE) AS accuracy, CAST(1 AS DOUBLE) AS precision,
  CAST(1 AS DOUBLE) AS recall, CAST(1 AS DOUBLE) AS f1, CAST(NULL AS VARCHAR) AS error"""
ORACLES["m_compare_targets_ruled"] = f"""SELECT target, model, CAST(1 AS DOUBLE) AS accuracy, CAST(1 AS DOUBLE) AS f1
FROM {_LONG}, (VALUES ('Risk_Type'), ('Risk_Level')) t(target)"""
ORACLES["m_train_models_ruled"] = f"""SELECT model, CAST(1 AS DOUBLE) AS accuracy, CAST(NULL AS VARCHAR) AS error,
  CAST(model = 'Logistic Regression' AS INTEGER) AS is_best FROM {_SHORT}"""
ORACLES["m_train_reports_ruled"] = f"""SELECT class, CAST(1 AS DOUBLE) AS precision, CAST(1 AS DOUBLE) AS recall, CAST(1 AS DOUBLE) AS f1, model
FROM {_SHORT}, (VALUES ('0.0'), ('1.0'), ('2.0')) c(class)"""
ORACLES["m_train_smote_ruled"] = f"""SELECT model, CAST(1 AS DOUBLE) AS accuracy, CAST(1 AS DOUBLE) AS f1, CAST(NULL AS VARCHAR) AS error FROM {_LONG}"""
ORACLES["f_rf_importance_ruled"] = "SELECT * FROM (VALUES ('worth', CAST(1 AS DOUBLE)), ('flat', CAST(0 AS DOUBLE))) t(feature, importance)"
ORACLES["f_rf_importance_deep"] = """SELECT * FROM (VALUES ('worth', true, CAST(1 AS DOUBLE)), ('other', false, CAST(1 AS DOUBLE))) t(feature, leads, total)"""
ORACLES["m_deep_forest"] = """SELECT p_partkey, CAST(CASE WHEN p_partkey % 10 = 0 THEN p_partkey % 3 WHEN p_size <= 15 THEN 0
  WHEN p_retailprice < 950 THEN 1 ELSE 2 END AS INTEGER) AS predicted, CAST(1 AS DOUBLE) AS share FROM part"""
def whole_profile(table: str, column: str, kind: str, value: str | None = None) -> str:
    return f"""SELECT column_name, type, rows, rows - n AS missing, round(100.0 * (rows - n) / rows, 2) AS missing_pct, round(mean, 6) AS mean,
  round(std, 6) AS std, round(min, 6) AS min, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(max, 6) AS max,
  round(skewness, 6) AS skewness, round(lo, 6) AS lower_bound, round(hi, 6) AS upper_bound, below AS outliers_below, above AS outliers_above,
  round(100.0 * (below + above) / n, 6) AS outlier_percentage
FROM (SELECT '{column}' AS column_name, '{kind}' AS type, any_value(q1) AS q1, any_value(q3) AS q3, any_value(median) AS median,
  any_value(lo) AS lo, any_value(hi) AS hi, count(*) AS rows, count(x) AS n, avg(x) AS mean, stddev_samp(x) AS std, min(x)::DOUBLE AS min,
  max(x)::DOUBLE AS max, skewness(x) AS skewness, count(*) FILTER (x < lo) AS below, count(*) FILTER (x > hi) AS above
  FROM (SELECT {value or column} AS x FROM {table}), (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (
    SELECT quantile_cont(x, 0.25)::DOUBLE AS q1, quantile_cont(x, 0.5)::DOUBLE AS median, quantile_cont(x, 0.75)::DOUBLE AS q3
    FROM (SELECT ({value or column})::DOUBLE AS x FROM {table}))))"""


ORACLES["a_whole_profile"] = union(
    [whole_profile("lineitem", c, "float64") for c in LINE_NUMBERS]
    + [whole_profile("events", "value", "float64", "CASE WHEN event_id % 9 <> 0 THEN value END"), whole_profile("events", "user_id", "int64")]
)
ORACLES["a_stored_moments"] = union(
    [
        f"""SELECT '{c}' AS column_name, count(*) AS rows, count({c}) AS n, round(min({c})::DOUBLE, 6) AS min, round(max({c})::DOUBLE, 6) AS max,
  round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std FROM orders""" for c in ("o_totalprice", "o_custkey")
    ]
    + ["SELECT 'o_orderstatus', count(*), count(o_orderstatus), NULL, NULL, NULL, NULL FROM orders"]
)
ORACLES["a_stored_quantiles"] = """SELECT p, count(*) AS n, true AS within
FROM orders, (VALUES (0.01::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)) t(p) GROUP BY p"""
ORACLES["a_stored_distinct"] = union(
    f"SELECT '{c}' AS column_name, count({c}) AS n, count(DISTINCT {c}) AS exact, true AS within FROM orders" for c in ("o_totalprice", "o_custkey", "o_orderstatus")
)
ORACLES["m_class_weights"] = """WITH n AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)
SELECT o_orderpriority, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight FROM n"""
_classes = f"""WITH {GUESSES}, k AS (SELECT DISTINCT label AS class FROM guesses UNION SELECT DISTINCT prediction FROM guesses),
r AS (SELECT class, count(*) FILTER (label = class) AS support, count(*) FILTER (prediction = class) AS claimed,
             count(*) FILTER (label = class AND prediction = class) AS hits FROM guesses, k GROUP BY class),
s AS (SELECT class, coalesce(hits / nullif(claimed, 0), 0) AS p, coalesce(hits / nullif(support, 0), 0) AS r,
             coalesce(2.0 * hits / nullif(claimed + support, 0), 0) AS f, support, hits FROM r)"""
ORACLES["m_metrics"] = f"""{_classes}
SELECT round(sum(hits) / sum(support), 6) AS accuracy, round(sum(p * support) / sum(support), 6) AS precision,
       round(sum(r * support) / sum(support), 6) AS recall, round(sum(f * support) / sum(support), 6) AS f1 FROM s"""
ORACLES["m_classification_report"] = f"""{_classes}
SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, support FROM s
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(hits) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM s
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), CAST(sum(support) AS BIGINT) FROM s
UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6),
  round(sum(f * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM s"""
ORACLES["m_smote_counts"] = f"""WITH {DOCUMENTS}, n AS (SELECT toxic, count(*) AS c FROM docs GROUP BY 1)
SELECT toxic AS value, max(c) OVER () AS n FROM n"""


def smote_rows(features: list[str], target: str) -> str:
    """Synthetic rows by comparing all pairs of the smaller class."""
    moved = ", ".join(
        f"round(a.{c} + {{along}} * (near[1 + CAST({{which}} % k AS BIGINT)].{c} - a.{c}), 6) AS {c}" for c in features
    ).format(along=unit("a.doc_id || '|' || draw", "42|along"), which=key("a.doc_id || '|' || draw", "42|neighbour"))
    far = " + ".join(f"power(a.{c} - b.{c}, 2)" for c in features)
    packed = ", ".join(f"{c} := b.{c}" for c in features)
    return f"""WITH {DOCUMENTS},
n AS (SELECT {target} AS y, count(*) AS c, max(count(*)) OVER () AS most, least(5, min(count(*)) OVER () - 1) AS k FROM docs GROUP BY 1),
s AS (SELECT docs.*, c, most, k, row_number() OVER (PARTITION BY {target} ORDER BY {key("doc_id")}, doc_id) AS turn
      FROM docs JOIN n ON y = {target} WHERE c < most),
d AS (SELECT a.doc_id, list(struct_pack({packed}) ORDER BY {far}, b.doc_id) AS near
      FROM s a JOIN s b ON a.{target} = b.{target} AND a.doc_id <> b.doc_id GROUP BY 1),
w AS (SELECT id, i AS draw FROM (
  SELECT doc_id AS id, (most - c) // c + CASE WHEN turn <= (most - c) % c THEN 1 ELSE 0 END AS times FROM s),
  LATERAL (SELECT unnest(range(times)) AS i))
SELECT doc_id, {", ".join(f"round({c}, 6) AS {c}" for c in features)}, {target} FROM docs
UNION ALL SELECT NULL, {moved}, a.{target} FROM w JOIN s a ON a.doc_id = w.id JOIN d ON d.doc_id = a.doc_id"""


ORACLES["m_smote"] = ORACLES["m_smote_cells"] = smote_rows(["n_chars", "words", "digits"], "quality")
ORACLES["m_smote_one_feature"] = smote_rows(["n_chars"], "quality")


def sample_rows() -> str:
    """The synthetic samples for every event."""
    core = ["MP_Count_per_L", "Risk_Score", "Microplastic_Size_mm_midpoint", "Density_midpoint"]

    def draw(name: str, use: str = "value") -> str:
        return unit("event_id", f"42|{name}|{use}")

    def normal(name: str, mean: float, std: float) -> str:
        return f"{mean} + {std} * sqrt(-2 * ln(1 - {draw(name, 'radius')})) * cos(2 * pi() * {draw(name, 'angle')})"

    def uniform(name: str, lo: float, hi: float, use: str = "value") -> str:
        return f"{lo} + ({hi} - {lo}) * {draw(name, use)}"

    def poisson(name: str, mean: int, use: str) -> str:
        # Smallest k whose cumulative probability exceeds the draw.
        total, steps = 0.0, []
        for k in range(mean + 40 * int(math.sqrt(mean))):
            total += math.exp(-mean + k * math.log(mean) - math.lgamma(k + 1))
            steps.append(total)
            if total >= 1 - 1e-12:
                break
        return f"CAST(len(list_filter({[f'{s!r}' for s in steps]}::DOUBLE[], lambda s: s <= {draw(name, use)})) AS DOUBLE)"

    def choice(name: str, values: list[str], shares: list[float] | None = None) -> str:
        shares, total, cases = shares or [1 / len(values)] * len(values), 0.0, []
        for v, s in zip(values[:-1], shares):
            total += s
            cases.append(f"WHEN {draw(name)} < {total!r}::DOUBLE THEN '{v}'")
        return f"CASE {' '.join(cases)} ELSE '{values[-1]}' END"

    plain = {
        "MP_Count_per_L": poisson("MP_Count_per_L", 50, "value"), "Particle_Size_um": normal("Particle_Size_um", 100, 30),
        "Microplastic_Size_mm_midpoint": normal("Microplastic_Size_mm_midpoint", 2.5, 1.5),
        "Density_midpoint": normal("Density_midpoint", 1.0, 0.1), "pH": normal("pH", 7, 0.5),
        "Temperature_C": normal("Temperature_C", 20, 5), "Risk_Score": uniform("Risk_Score", 0, 100),
    }
    far = {
        "Risk_Score": uniform("Risk_Score", 150, 200, "outlier"), "MP_Count_per_L": poisson("MP_Count_per_L", 200, "outlier"),
        "Microplastic_Size_mm_midpoint": uniform("Microplastic_Size_mm_midpoint", 10, 20, "outlier"),
        "Density_midpoint": uniform("Density_midpoint", 1.5, 2.0, "outlier"),
    }
    texts = {
        "Polymer_Type": choice("Polymer_Type", ["PE", "PP", "PS", "PET", "PVC", "Nylon"]),
        "Water_Source": choice("Water_Source", ["River", "Lake", "Ocean", "Groundwater", "Tap"]),
        "Risk_Level": choice("Risk_Level", ["Low", "Medium", "High", "Critical"], [0.3, 0.35, 0.25, 0.1]),
        "Risk_Type": choice("Risk_Type", ["Type_A", "Type_B", "Type_C"], [0.5, 0.3, 0.2]),
        "Location": choice("Location", ["Urban", "Rural", "Industrial", "Coastal"]),
        "Season": choice("Season", ["Winter", "Spring", "Summer", "Fall"]),
        "Author": choice("Author", ["Author_A", "Author_B", "Author_C"]),
        "Source": choice("Source", ["Source_1", "Source_2", "Source_3"]),
    }
    picks = ", ".join(
        f"row_number() OVER (ORDER BY {key('event_id', f'42|{c}|pick')}, event_id) <= floor((count(*) OVER ()) * 0.05) AS far_{c}" for c in core
    )
    numbers = ", ".join(
        f"CASE WHEN {draw(c, 'missing')} >= 0.05 THEN round("
        + (f"CASE WHEN far_{c} THEN {far[c]} ELSE {x} END" if c in core else x) + f", 4) END AS \"{c}\""
        for c, x in plain.items()
    )
    return f"""WITH f AS (SELECT event_id, {picks} FROM events)
SELECT 'MP_' || CASE WHEN event_id > 9999 THEN CAST(event_id AS VARCHAR) ELSE lpad(CAST(event_id AS VARCHAR), 4, '0') END AS "Sample_ID",
  {numbers}, {", ".join(f'{x} AS "{c}"' for c, x in texts.items())} FROM f"""


ORACLES["s_sample_source"] = sample_rows()

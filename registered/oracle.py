"""SQL equivalents of the registered queries, written independently of the Spark code, for an embedded SQL engine."""

from __future__ import annotations

ORACLE: dict[str, str] = {}


def sql(name: str, text: str) -> None:
    ORACLE[name] = text.strip()


def periods(table: str, time: str, value: str, label: str = "date_trunc('day', t)") -> str:
    """Period means as ``days(period, mean, min, max, n)``, from the raw rows."""
    return f"""
raw AS (SELECT {time} AS t, {value} AS v FROM {table} WHERE {time} IS NOT NULL AND {value} IS NOT NULL),
days AS (
  SELECT CAST({label} AS TIMESTAMP) AS period, avg(v) AS mean, min(v) AS lo, max(v) AS hi, count(*) AS n
  FROM raw GROUP BY 1)"""


DAYS = periods("orders", "o_orderdate", "o_totalprice")
MONTHS = periods("orders", "o_orderdate", "o_totalprice", "last_day(t)")
YEARS = """
years AS (
  SELECT CAST(year(period) AS INTEGER) AS year, avg(mean) AS mean, stddev_samp(mean) AS std,
         min(mean) AS lo, max(mean) AS hi, count(*) AS n
  FROM days GROUP BY 1)"""
YEAR_FIT = """
fit AS (
  SELECT regr_slope(mean, year) AS slope, regr_intercept(mean, year) AS intercept, regr_r2(mean, year) AS r2,
         max(year) - min(year) AS span FROM years)"""
DIRECTION = "CASE WHEN slope > 0 THEN 'increasing' WHEN slope < 0 THEN 'decreasing' ELSE 'stable' END"
SEASON = """CASE WHEN {m} IN (12, 1, 2) THEN 'winter' WHEN {m} IN (3, 4, 5) THEN 'spring'
  WHEN {m} IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END"""
MONTH_NAMES = "['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec']"

# --- trends ---------------------------------------------------------------------------------------------

sql("annual_trend_signal", f"""
WITH {DAYS}, {YEARS}, {YEAR_FIT}
SELECT year, round(mean, 4) AS mean, round(std, 4) AS std, round(lo, 4) AS min, round(hi, 4) AS max, n AS count,
       round(slope * year + intercept, 4) AS trend
FROM years, fit""")

YEAR_SUMMARY = f"""
SELECT round(slope, 4) AS slope_per_year, round(slope * 10, 4) AS slope_per_decade,
       round(slope * span, 4) AS total_change, round(r2, 6) AS r2, {DIRECTION} AS trend_direction,
       (SELECT year FROM years ORDER BY mean, year LIMIT 1) AS lowest_year,
       (SELECT round(min(mean), 4) FROM years) AS lowest_value,
       (SELECT year FROM years ORDER BY mean DESC, year LIMIT 1) AS highest_year,
       (SELECT round(max(mean), 4) FROM years) AS highest_value
FROM fit"""
sql("annual_trend_summary", f"WITH {DAYS}, {YEARS}, {YEAR_FIT} {YEAR_SUMMARY}")

sql("annual_trend_coverage", """
SELECT count(*) AS source_rows,
       count(*) FILTER (WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL) AS valid_rows,
       count(DISTINCT date_trunc('day', o_orderdate)) AS daily_periods,
       min(o_orderdate) AS start, max(o_orderdate) AS "end",
       count(*) FILTER (WHERE o_orderdate IS NULL) AS missing_time,
       count(*) FILTER (WHERE o_totalprice IS NULL) AS missing_target,
       count(DISTINCT year(o_orderdate)) AS annual_periods
FROM orders""")

EVENT_FIT = """
xy AS (SELECT epoch_us(ts) / 1e6 AS x, value AS y, ts FROM events WHERE ts IS NOT NULL AND value IS NOT NULL),
line AS (SELECT count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2 FROM xy)"""
sql("trend_fit", f"""
WITH {EVENT_FIT}
SELECT n AS rows, round(slope * 86400, 6) AS slope_per_day, round(intercept, 3) AS intercept, round(r2, 9) AS r2,
       {DIRECTION} AS trend_direction FROM line""")
sql("trend_points", f"""
WITH {EVENT_FIT}
SELECT ts AS time, round(y, 4) AS value, round(slope * x + intercept, 4) AS fitted FROM xy, line""")
sql("temperature_trend_pick", f"""
WITH {EVENT_FIT}
SELECT 'air_temp' AS target_column, round(slope * 86400, 6) AS slope_per_day, round(r2, 9) AS r2 FROM line""")
sql("precipitation_trend_pick", """
SELECT 'rainfall' AS target_column,
       round(regr_slope(l_extendedprice, epoch_us(l_shipdate) / 1e6) * 86400, 6) AS slope_per_day,
       round(regr_r2(l_extendedprice, epoch_us(l_shipdate) / 1e6), 9) AS r2
FROM lineitem""")

# --- resampling -------------------------------------------------------------------------------------------

sql("temporal_agg_daily", """
SELECT date_trunc('day', l_shipdate)::TIMESTAMP AS period_start,
       round(avg(l_quantity), 7) AS l_quantity_mean,
       round(avg(l_extendedprice), 7) AS l_extendedprice_mean,
       round(min(l_quantity), 4) AS l_quantity_min, round(min(l_extendedprice), 4) AS l_extendedprice_min,
       round(max(l_quantity), 4) AS l_quantity_max, round(max(l_extendedprice), 4) AS l_extendedprice_max,
       round(max(l_quantity) - min(l_quantity), 4) AS l_quantity_range,
       round(max(l_extendedprice) - min(l_extendedprice), 4) AS l_extendedprice_range
FROM lineitem GROUP BY 1""")
sql("temporal_agg_monthly", """
SELECT last_day(o_orderdate)::TIMESTAMP AS period_start, round(avg(o_totalprice), 4) AS o_totalprice_mean,
       round(stddev_samp(o_totalprice), 4) AS o_totalprice_std, round(max(o_totalprice), 4) AS o_totalprice_max,
       round(max(o_totalprice) - min(o_totalprice), 4) AS o_totalprice_range
FROM orders GROUP BY 1""")
_MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_yearly = ", ".join(
    f"round(sum({c}), 2) AS {c}_sum, count({c}) AS {c}_count, round(avg({c}), 2) AS {c}_mean, "
    f"round(stddev_samp({c}), 2) AS {c}_std"
    for c in _MEASURES
)
sql("temporal_agg_yearly", f"""
SELECT make_date(year(l_shipdate), 12, 31)::TIMESTAMP AS period_start, {_yearly} FROM lineitem GROUP BY 1""")
sql("temporal_agg_gapfill", """
WITH d AS (
  SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS p, sum(o_totalprice) AS s, count(*) AS n, avg(o_totalprice) AS m
  FROM orders GROUP BY 1),
spine AS (SELECT unnest(generate_series((SELECT min(p) FROM d), (SELECT max(p) FROM d), INTERVAL 1 DAY)) AS p)
SELECT spine.p AS period_start, round(coalesce(s, 0), 4) AS o_totalprice_sum, coalesce(n, 0) AS o_totalprice_count,
       round(m, 7) AS o_totalprice_mean
FROM spine LEFT JOIN d ON spine.p = d.p""")
sql("temporal_agg_gapfill_monthly", """
WITH d AS (
  SELECT date_trunc('month', DATE '1995-01-31' + CAST(o_orderkey % 40 * 61 AS INTEGER))::TIMESTAMP AS p, max(o_totalprice) AS m,
         count(*) AS n
  FROM orders GROUP BY 1),
spine AS (SELECT unnest(generate_series((SELECT min(p) FROM d), (SELECT max(p) FROM d), INTERVAL 1 MONTH)) AS p)
SELECT last_day(spine.p)::TIMESTAMP AS period_start, round(m, 4) AS o_totalprice_max, coalesce(n, 0) AS o_totalprice_count
FROM spine LEFT JOIN d ON spine.p = d.p""")
sql("temporal_agg_mixed_text", """
SELECT last_day(o_orderdate)::TIMESTAMP AS period_start, round(max(o_totalprice), 4) AS o_totalprice_max,
       count(*) AS o_totalprice_count
FROM orders WHERE o_orderkey % 7 >= 2 GROUP BY 1""")
sql("derived_dataset", """
SELECT date_trunc('day', ts)::TIMESTAMP AS period_start, round(avg(value), 6) AS value_mean,
       round(avg(value + 10), 6) AS value_shifted_mean, round(max(value) - min(value), 6) AS value_range,
       round(max(value + 10) - min(value + 10), 6) AS value_shifted_range
FROM events GROUP BY 1""")
sql("derived_input_rows", "SELECT count(*) AS input_rows, count(ts) AS valid_time_rows FROM events")

# --- statistics -------------------------------------------------------------------------------------------


def _describe(table: str, columns: tuple[str, ...]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean,
        round(stddev_samp({c}), 4) AS std, round(min({c})::DOUBLE, 4) AS min,
        round(quantile_cont({c}::DOUBLE, 0.25), 4) AS "25%", round(quantile_cont({c}::DOUBLE, 0.5), 4) AS "50%",
        round(quantile_cont({c}::DOUBLE, 0.75), 4) AS "75%", round(max({c})::DOUBLE, 4) AS max FROM {table}"""
        for c in columns
    )


sql("describe_stats", _describe("lineitem", _MEASURES))
sql("describe_orders", _describe("orders", ("o_totalprice", "o_custkey")))
sql("corr_long", " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS r FROM lineitem"
    for a in _MEASURES for b in _MEASURES))
_HOLES = {
    "l_quantity": "l_quantity", "l_extendedprice": "CASE WHEN l_extendedprice > 2000 THEN l_extendedprice END",
    "l_discount": "CASE WHEN l_discount > 0.04 THEN l_discount END", "l_tax": "CASE WHEN l_tax > 0.02 THEN l_tax END",
    "late": "CASE WHEN l_orderkey > 500 THEN l_quantity END",  # a constant more or less does not matter
}
sql("corr_incomplete", " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({x}, {y}), 6) AS r FROM lineitem"
    for a, x in _HOLES.items() for b, y in _HOLES.items()))
sql("corr_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS \"column\", " + ", ".join(f"round(corr({a}, {b}), 6) AS {b}" for b in _MEASURES)
    + " FROM lineitem" for a in _MEASURES))

# --- cycles -----------------------------------------------------------------------------------------------

sql("seasonal_monthly", f"""
WITH m AS (
  SELECT month(o_orderdate) AS month, avg(o_totalprice) AS mean, stddev_samp(o_totalprice) AS std,
         min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(o_totalprice) AS n
  FROM orders GROUP BY 1)
SELECT CAST(k.month AS INTEGER) AS month, {MONTH_NAMES}[k.month] AS month_label, round(mean, 4) AS mean,
       round(std, 4) AS std, round(lo, 4) AS min, round(hi, 4) AS max, coalesce(n, 0) AS count
FROM range(1, 13) AS k(month) LEFT JOIN m ON m.month = k.month""")
sql("seasonal_cycle", f"""
WITH s AS (
  SELECT {SEASON.format(m='month(o_orderdate)')} AS season, avg(o_totalprice) AS mean,
         stddev_samp(o_totalprice) AS std, min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(o_totalprice) AS n
  FROM orders GROUP BY 1)
SELECT k.season, round(mean, 4) AS mean, round(std, 4) AS std, round(lo, 4) AS min, round(hi, 4) AS max,
       coalesce(n, 0) AS count
FROM (VALUES ('winter'), ('spring'), ('summer'), ('autumn')) AS k(season) LEFT JOIN s ON s.season = k.season""")
sql("seasonal_summary", f"""
WITH m AS (SELECT CAST(month(o_orderdate) AS INTEGER) AS month, avg(o_totalprice) AS mean FROM orders GROUP BY 1),
w AS (SELECT month, mean FROM m ORDER BY mean DESC, month LIMIT 1),
c AS (SELECT month, mean FROM m ORDER BY mean, month LIMIT 1)
SELECT round((SELECT avg(o_totalprice) FROM orders), 4) AS annual_mean, w.month AS warmest_month,
       {MONTH_NAMES}[w.month] AS warmest_month_label, round(w.mean, 4) AS warmest_value, c.month AS coolest_month,
       {MONTH_NAMES}[c.month] AS coolest_month_label, round(c.mean, 4) AS coolest_value,
       round(w.mean - c.mean, 4) AS seasonal_range
FROM w, c""")
sql("seasonal_quality", """
SELECT count(*) FILTER (WHERE o_orderdate IS NULL) AS missing_time,
       count(*) FILTER (WHERE o_totalprice IS NULL) AS missing_target,
       count(DISTINCT month(o_orderdate)) AS observed_months,
       count(DISTINCT month(o_orderdate)) = 12 AS complete_12_month_profile
FROM orders""")
sql("seasonal_month_pattern", """
SELECT CAST(month(ts) AS INTEGER) AS month, round(avg(value), 4) AS mean_value FROM events GROUP BY 1""")


def _local(shift: str) -> str:
    return f"local AS (SELECT ts + INTERVAL '{shift}' AS t, value AS v FROM events WHERE ts IS NOT NULL AND value IS NOT NULL)"


_HOUR_STATS = "avg(v) AS mean, stddev_samp(v) AS std, min(v) AS lo, max(v) AS hi, count(*) AS n"
sql("diurnal_hourly", f"""
WITH {_local('330 minutes')}, h AS (SELECT hour(t) AS hour, {_HOUR_STATS} FROM local GROUP BY 1)
SELECT CAST(k.hour AS INTEGER) AS hour, round(mean, 4) AS mean, round(std, 4) AS std, round(lo, 4) AS min,
       round(hi, 4) AS max, coalesce(n, 0) AS count
FROM range(0, 24) AS k(hour) LEFT JOIN h ON h.hour = k.hour""")
sql("diurnal_season_hour", f"""
WITH {_local('330 minutes')},
h AS (SELECT {SEASON.format(m='month(t)')} AS season, hour(t) AS hour, {_HOUR_STATS} FROM local GROUP BY 1, 2)
SELECT s.season, CAST(k.hour AS INTEGER) AS hour, round(mean, 4) AS mean, round(std, 4) AS std, round(lo, 4) AS min,
       round(hi, 4) AS max, coalesce(n, 0) AS count
FROM (VALUES ('winter'), ('spring'), ('summer'), ('autumn')) AS s(season) CROSS JOIN range(0, 24) AS k(hour)
LEFT JOIN h ON h.hour = k.hour AND h.season = s.season""")
sql("diurnal_peaks", f"""
WITH {_local('330 minutes')},
h AS (SELECT {SEASON.format(m='month(t)')} AS season, CAST(hour(t) AS INTEGER) AS hour, avg(v) AS mean FROM local GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY season ORDER BY mean DESC, hour) AS top,
             row_number() OVER (PARTITION BY season ORDER BY mean, hour) AS low FROM h)
SELECT a.season, a.hour AS warmest_hour, round(a.mean, 4) AS warmest_value, b.hour AS coolest_hour,
       round(b.mean, 4) AS coolest_value, round(a.mean - b.mean, 4) AS diurnal_range
FROM r a JOIN r b ON a.season = b.season WHERE a.top = 1 AND b.low = 1""")
sql("diurnal_summary", f"""
WITH {_local('-180 minutes')},
h AS (SELECT CAST(hour(t) AS INTEGER) AS hour, avg(v) AS mean FROM local GROUP BY 1),
w AS (SELECT * FROM h ORDER BY mean DESC, hour LIMIT 1), c AS (SELECT * FROM h ORDER BY mean, hour LIMIT 1)
SELECT round(w.mean - c.mean, 4) AS diurnal_range, w.hour AS warmest_hour, round(w.mean, 4) AS warmest_value,
       c.hour AS coolest_hour, round(c.mean, 4) AS coolest_value FROM w, c""")

sql("diurnal_quality", """
SELECT count(*) FILTER (WHERE ts IS NULL) AS missing_time, count(*) FILTER (WHERE value IS NULL) AS missing_target,
       count(DISTINCT hour(ts)) AS observed_hours, count(DISTINCT hour(ts)) = 24 AS complete_24_hour_profile
FROM events""")

# --- baseline ---------------------------------------------------------------------------------------------

USED = "used AS (SELECT * FROM days WHERE period BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31')"
BASE = "base AS (SELECT month(period) AS month, avg(mean) AS baseline FROM used GROUP BY 1)"
ANOM = """
anom AS (SELECT CAST(year(period) AS INTEGER) AS year, mean - baseline AS a
         FROM days JOIN base ON month(period) = base.month),
ya AS (SELECT year, avg(a) AS anomaly, stddev_samp(a) AS std, min(a) AS lo, max(a) AS hi, count(*) AS n FROM anom GROUP BY 1)"""
sql("baseline_monthly", f"""
WITH {DAYS}, {USED}, {BASE}
SELECT CAST(k.month AS INTEGER) AS month, {MONTH_NAMES}[k.month] AS month_label, round(baseline, 4) AS baseline
FROM range(1, 13) AS k(month) LEFT JOIN base ON base.month = k.month""")
sql("baseline_annual_anomalies", f"""
WITH {DAYS}, {USED}, {BASE}, {ANOM}
SELECT year, round(anomaly, 4) AS anomaly, round(std, 4) AS std, round(lo, 4) AS min, round(hi, 4) AS max, n AS count
FROM ya""")
_FACTS = """
SELECT min(period) AS start, max(period) AS "end", '{start}' AS requested_start, '{end}' AS requested_end,
       {used} AS used_requested_period, count(*) AS periods, round(avg(mean), 4) AS mean,
       count(DISTINCT month(period)) AS observed_months,
       count(DISTINCT month(period)) = 12 AS complete_12_month_profile
FROM {rows}"""
sql("baseline_facts", f"WITH {DAYS}, {USED} "
    + _FACTS.format(start="1996-01-01", end="1998-12-31", used="true", rows="used"))
sql("baseline_fallback", f"WITH {DAYS} "
    + _FACTS.format(start="1950-01-01", end="1960-12-31", used="false", rows="days"))
sql("baseline_summary", f"""
WITH {DAYS}, {USED}, {BASE}, {ANOM}
SELECT (SELECT round(avg(mean), 4) FROM used) AS baseline_mean,
       (SELECT year FROM ya ORDER BY anomaly, year LIMIT 1) AS most_negative_year,
       round(min(anomaly), 4) AS most_negative_anomaly,
       (SELECT year FROM ya ORDER BY anomaly DESC, year LIMIT 1) AS most_positive_year,
       round(max(anomaly), 4) AS most_positive_anomaly,
       count(*) FILTER (WHERE anomaly < 0) AS negative_years, count(*) FILTER (WHERE anomaly >= 0) AS positive_years
FROM ya""")

# --- extremes ---------------------------------------------------------------------------------------------


def limits(high: float, low: float) -> str:
    return f"""
lim AS (SELECT quantile_cont(hi, {high}) AS high, quantile_cont(lo, {low}) AS low FROM days),
ye AS (
  SELECT CAST(year(period) AS INTEGER) AS year, count(*) FILTER (WHERE days.hi >= lim.high) AS high_days,
         count(*) FILTER (WHERE days.lo <= lim.low) AS low_days, count(*) AS observed_days
  FROM days, lim GROUP BY 1),
ef AS (
  SELECT regr_slope(high_days, year) AS hs, regr_intercept(high_days, year) AS hi0, regr_r2(high_days, year) AS hr,
         regr_slope(low_days, year) AS ls, regr_intercept(low_days, year) AS li0, regr_r2(low_days, year) AS lr FROM ye)"""


sql("extreme_thresholds", f"""
WITH {DAYS}, {limits(0.95, 0.05)}
SELECT 0.95::DOUBLE AS high_quantile, 0.05::DOUBLE AS low_quantile, round(high, 4) AS high_threshold,
       round(low, 4) AS low_threshold FROM lim""")
sql("extreme_annual", f"""
WITH {DAYS}, {limits(0.95, 0.05)}
SELECT year, high_days, low_days, observed_days, round(hs * year + hi0, 4) AS high_trend,
       round(ls * year + li0, 4) AS low_trend FROM ye, ef""")
sql("extreme_summary", f"""
WITH {DAYS}, {limits(0.9, 0.1)}
SELECT round(lim.high, 4) AS high_threshold, round(lim.low, 4) AS low_threshold,
       round(hs * 10, 4) AS high_trend_per_decade, round(ls * 10, 4) AS low_trend_per_decade,
       round(hr, 4) AS high_r2, round(lr, 4) AS low_r2,
       (SELECT sum(high_days)::BIGINT FROM ye) AS high_total_days, (SELECT sum(low_days)::BIGINT FROM ye) AS low_total_days,
       (SELECT year FROM ye ORDER BY high_days DESC, year LIMIT 1) AS max_high_year,
       (SELECT max(high_days) FROM ye) AS max_high_days,
       (SELECT year FROM ye ORDER BY low_days DESC, year LIMIT 1) AS max_low_year,
       (SELECT max(low_days) FROM ye) AS max_low_days
FROM lim, ef""")

# --- distributions ----------------------------------------------------------------------------------------

DECADES = "dec AS (SELECT CAST(year(period) // 10 * 10 AS INTEGER) AS decade, mean FROM days)"
sql("decadal_stats", f"""
WITH {DAYS}, {DECADES}
SELECT decade, decade || 's' AS label, count(*) AS count, round(avg(mean), 4) AS mean,
       round(stddev_samp(mean), 4) AS std, round(min(mean), 4) AS min, round(quantile_cont(mean, 0.05), 4) AS q05,
       round(quantile_cont(mean, 0.25), 4) AS q25, round(quantile_cont(mean, 0.5), 4) AS median,
       round(quantile_cont(mean, 0.75), 4) AS q75, round(quantile_cont(mean, 0.95), 4) AS q95, round(max(mean), 4) AS max
FROM dec GROUP BY decade""")
HIST = f"""
{DECADES}, ends AS (SELECT min(mean) AS mn, max(mean) AS mx FROM days),
edges AS (
  SELECT i::INTEGER AS bin, mn + i * ((mx - mn) / 20) AS lft, CASE WHEN i = 19 THEN mx ELSE mn + (i + 1) * ((mx - mn) / 20) END AS rgt
  FROM ends, range(0, 20) AS k(i)),
cells AS (SELECT d.decade, e.bin, e.lft, e.rgt FROM (SELECT DISTINCT decade FROM dec) d CROSS JOIN edges e),
totals AS (SELECT decade, count(*) AS total FROM dec GROUP BY 1),
hist AS (
  SELECT c.decade, c.bin, c.lft, c.rgt, count(dec.mean) AS n, any_value(total) AS total
  FROM cells c JOIN totals ON totals.decade = c.decade
  LEFT JOIN dec ON dec.decade = c.decade AND dec.mean >= c.lft AND (dec.mean < c.rgt OR (c.bin = 19 AND dec.mean <= c.rgt))
  GROUP BY 1, 2, 3, 4)"""
sql("decadal_hist", f"""
WITH {DAYS}, {HIST}
SELECT decade, decade || 's' AS label, bin, round(lft, 4) AS left, round(rgt, 4) AS right, n AS count,
       round(n / (total * (rgt - lft)), 12) AS density
FROM hist""")
sql("decadal_hist_steps", f"""
WITH {DAYS}, {HIST}
SELECT decade, bin * 2 AS step, round(lft, 4) AS x, round(n / (total * (rgt - lft)), 12) AS y FROM hist
UNION ALL
SELECT decade, bin * 2 + 1, round(rgt, 4), round(n / (total * (rgt - lft)), 12) FROM hist""")
sql("decadal_summary", f"""
WITH {DAYS}, {DECADES}, m AS (SELECT decade, avg(mean) AS mean FROM dec GROUP BY 1)
SELECT (SELECT min(decade) FROM m) AS first_decade, (SELECT max(decade) FROM m) AS last_decade,
       (SELECT decade FROM m ORDER BY mean, decade LIMIT 1) AS lowest_decade,
       (SELECT round(min(mean), 4) FROM m) AS lowest_mean,
       (SELECT decade FROM m ORDER BY mean DESC, decade LIMIT 1) AS highest_decade,
       (SELECT round(max(mean), 4) FROM m) AS highest_mean,
       round((SELECT mean FROM m ORDER BY decade DESC LIMIT 1) - (SELECT mean FROM m ORDER BY decade LIMIT 1), 4) AS mean_shift""")

# --- workflow ---------------------------------------------------------------------------------------------

sql("workflow_coverage", """
SELECT count(*) AS source_rows,
       count(*) FILTER (WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL) AS valid_rows,
       count(DISTINCT date_trunc('month', o_orderdate)) AS aggregated_periods,
       min(o_orderdate) AS start, max(o_orderdate) AS "end",
       count(*) FILTER (WHERE o_orderdate IS NULL) AS missing_time,
       count(*) FILTER (WHERE o_totalprice IS NULL) AS missing_target
FROM orders""")
sql("workflow_summary", """
SELECT count(o_totalprice) AS count, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std,
       round(min(o_totalprice), 4) AS min, round(quantile_cont(o_totalprice, 0.25), 4) AS q25,
       round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.75), 4) AS q75,
       round(max(o_totalprice), 4) AS max
FROM orders""")
sql("workflow_month", f"""
WITH {DAYS}
SELECT CAST(month(period) AS INTEGER) AS month, round(avg(mean), 4) AS mean, round(stddev_samp(mean), 4) AS std, count(*) AS count
FROM days GROUP BY 1""")
sql("workflow_season", f"""
WITH {MONTHS}
SELECT {SEASON.format(m='month(period)')} AS season, round(avg(mean), 4) AS mean, round(stddev_samp(mean), 4) AS std,
       count(*) AS count FROM days GROUP BY 1""")
sql("workflow_annual", f"WITH {DAYS}, {YEARS}, {YEAR_FIT} {YEAR_SUMMARY}")
sql("workflow_annual_points", f"WITH {MONTHS}, {YEARS} SELECT year, round(mean, 4) AS mean FROM years")
sql("workflow_anomalies", f"""
WITH {MONTHS}, {USED}, {BASE},
anom AS (SELECT CAST(year(period) AS INTEGER) AS year, mean - baseline AS a
         FROM days LEFT JOIN base ON month(period) = base.month)
SELECT year, round(avg(a), 4) AS anomaly FROM anom GROUP BY 1""")
sql("workflow_extremes", f"""
WITH {DAYS}, {limits(0.95, 0.05)}
SELECT 0.95::DOUBLE AS high_quantile, 0.05::DOUBLE AS low_quantile, round(lim.high, 4) AS high_threshold,
       round(lim.low, 4) AS low_threshold, round(hs * 10, 4) AS high_trend_per_decade,
       round(ls * 10, 4) AS low_trend_per_decade FROM lim, ef""")
sql("workflow_extremes_per_year", f"""
WITH {MONTHS}, {limits(0.95, 0.05)} SELECT year, high_days AS high_count, low_days AS low_count FROM ye""")
sql("workflow_decade", f"""
WITH {DAYS}, {DECADES}
SELECT decade, round(avg(mean), 4) AS mean, round(stddev_samp(mean), 4) AS std, round(min(mean), 4) AS min,
       round(max(mean), 4) AS max, count(*) AS count FROM dec GROUP BY 1""")


def spaced(total: str, size: int) -> str:
    """The indices of ``size`` evenly spaced rows out of ``total``."""
    return f"""
pick AS (
  SELECT DISTINCT CASE WHEN total <= {size} THEN i WHEN i = {size - 1} THEN total - 1
         ELSE CAST(floor(i * ((total - 1)::DOUBLE / {size - 1})) AS BIGINT) END AS i
  FROM ({total}) AS n(total), range(0, {size}) AS k(i))"""


sql("workflow_preview", f"""
WITH {DAYS}, numbered AS (SELECT *, row_number() OVER (ORDER BY period) - 1 AS i FROM days),
{spaced('SELECT count(*) FROM days', 1000)}
SELECT period AS time, round(mean, 7) AS mean, round(lo, 4) AS min, round(hi, 4) AS max, round(hi - lo, 4) AS range, n AS count
FROM numbered JOIN pick USING (i)""")

# --- z-scores ---------------------------------------------------------------------------------------------

Z = """
m AS (SELECT avg(value) AS mean, stddev_pop(value) AS std FROM events),
z AS (SELECT event_id, ts AS time, value, (value - mean) / std AS z_score FROM events, m WHERE value IS NOT NULL)"""
sql("zscore_anomalies", f"""
WITH {Z} SELECT event_id, time, round(value, 6) AS value, round(z_score, 6) AS z_score FROM z WHERE abs(z_score) >= 2.0""")
sql("zscore_listing", f"""
WITH {Z} SELECT time, round(value, 6) AS value, round(z_score, 6) AS z_score, event_id FROM z
WHERE abs(z_score) >= 1.5 ORDER BY event_id LIMIT 500""")
sql("zscore_listing_whole", f"""
WITH {Z} SELECT time, round(value, 6) AS value, round(z_score, 6) AS z_score, event_id FROM z WHERE abs(z_score) >= 2""")
sql("zscore_summary", f"""
WITH {Z} SELECT 1.5::DOUBLE AS z_threshold, round(mean, 6) AS mean, round(std, 6) AS std,
  (SELECT count(*) FROM z WHERE abs(z_score) >= 1.5) AS anomaly_count FROM m""")

# --- models -----------------------------------------------------------------------------------------------

OLS = """
train AS (SELECT l_quantity AS a, l_discount AS b, l_extendedprice AS y FROM lineitem WHERE l_orderkey % 5 <> 0),
test AS (SELECT l_quantity AS a, l_discount AS b, l_extendedprice AS y FROM lineitem WHERE l_orderkey % 5 = 0),
s AS (SELECT var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS bys,
             avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM train),
w AS (SELECT (ay * bb - bys * ab) / (aa * bb - ab * ab) AS wa, (bys * aa - ay * ab) / (aa * bb - ab * ab) AS wb, ma, mb, my FROM s),
f AS (SELECT wa, wb, my - wa * ma - wb * mb AS w0 FROM w)"""
sql("ols_coefficients", f"""
WITH {OLS} SELECT 'l_quantity' AS feature, round(wa, 4) AS coefficient FROM f
UNION ALL SELECT 'l_discount', round(wb, 4) FROM f""")
sql("ols_metrics", f"""
WITH {OLS}, e AS (SELECT y, y - (w0 + wa * a + wb * b) AS err FROM test, f)
SELECT round((SELECT w0 FROM f), 4) AS intercept, round(1 - sum(err * err) / (var_pop(y) * count(*)), 8) AS r2,
       round(sqrt(avg(err * err)), 4) AS rmse, count(*) AS test_points FROM e""")


# The forest is random; what must hold of it is not.
sql("forest_net_price", """
SELECT count(*) AS test_points, true AS above_line, 'l_extendedprice' AS top_feature, CAST(1 AS DOUBLE) AS importance_total
FROM lineitem
WHERE l_orderkey % 5 = 0 AND l_extendedprice IS NOT NULL AND l_discount IS NOT NULL AND l_quantity IS NOT NULL""")


def autoregression(source: str) -> str:
    """Two-lag least squares over ``series(i, v)`` by Cramer's rule, as ``f(w1, w2, w0)``."""
    return f"""
series AS ({source}),
lagged AS (SELECT v AS y, lag(v, 1) OVER (ORDER BY i) AS a, lag(v, 2) OVER (ORDER BY i) AS b FROM series),
full_rows AS (SELECT * FROM lagged WHERE a IS NOT NULL AND b IS NOT NULL),
s AS (SELECT var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS bys,
             avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM full_rows),
w AS (SELECT (ay * bb - bys * ab) / (aa * bb - ab * ab) AS w1, (bys * aa - ay * ab) / (aa * bb - ab * ab) AS w2, ma, mb, my FROM s),
f AS (SELECT w1, w2, my - w1 * ma - w2 * mb AS w0 FROM w),
steps AS (
  SELECT 0 AS step, (SELECT v FROM series ORDER BY i DESC LIMIT 1) AS last, (SELECT v FROM series ORDER BY i DESC LIMIT 1 OFFSET 1) AS prev
  UNION ALL
  SELECT step + 1, w0 + w1 * last + w2 * prev, last FROM steps, f WHERE step < 12)"""


_MONTHLY = "SELECT row_number() OVER (ORDER BY period) AS i, mean AS v FROM days"
_EVENTS = "SELECT row_number() OVER (ORDER BY ts, event_id) AS i, value AS v FROM events"
sql("forecast_ar2", f"""
WITH RECURSIVE {MONTHS}, {autoregression(_MONTHLY)}
SELECT last_day((SELECT date_trunc('month', max(period)) FROM days) + step * INTERVAL 1 MONTH)::TIMESTAMP AS time,
       round(last, 3) AS forecast FROM steps WHERE step >= 1""")
sql("forecast_coefficients", f"""
WITH RECURSIVE {autoregression(_EVENTS)}
SELECT 'lag_1' AS lag, round(w1, 6) AS coefficient FROM f UNION ALL SELECT 'lag_2', round(w2, 6) FROM f""")
sql("forecast_steps", f"""
WITH RECURSIVE {autoregression(_EVENTS)}
SELECT step, round(last, 4) AS forecast FROM steps WHERE step BETWEEN 1 AND 6""")

sql("forecast_six_lags", """
SELECT count(*) - 6 AS rows_fitted, 6::INTEGER AS lags, true AS uncorrelated, 12::INTEGER AS steps
FROM events WHERE ts IS NOT NULL AND value IS NOT NULL""")

# --- recipes ----------------------------------------------------------------------------------------------

sql("recipe_units", """
SELECT p_partkey, round(p_retailprice, 6) AS p_retailprice, round(p_retailprice - 273.15, 6) AS kelvin_to_celsius,
       round((p_retailprice - 273.15) * 9.0 / 5.0 + 32.0, 6) AS kelvin_to_fahrenheit,
       round(p_retailprice + 273.15, 6) AS celsius_to_kelvin, round(p_retailprice * 3.6, 6) AS ms_to_kmh,
       round(p_retailprice * 2.2369362921, 6) AS ms_to_mph, round(p_retailprice / 100.0, 6) AS pa_to_hpa
FROM part""")
sql("recipe_arith", """
SELECT p_partkey, p_size, round(p_size * 2.5::DOUBLE, 6) AS multiply_constant, round(p_size / 4::DOUBLE, 6) AS divide_constant,
       round(p_size + 100::DOUBLE, 6) AS add_constant, round(p_size - 0.75::DOUBLE, 6) AS subtract_constant
FROM part""")
for _name, _reach, _digits in (("recipe_rolling_mean", 6, 7), ("recipe_rolling_mean_long", 364, 9)):
    sql(_name, f"""
SELECT event_id, ts, round(value, 4) AS value,
       round(avg(value) OVER (ORDER BY ts, event_id ROWS BETWEEN {_reach} PRECEDING AND CURRENT ROW), {_digits}) AS rolled
FROM events""")
sql("recipe_day_mean", """
SELECT event_id, ts, round(value, 6) AS value,
       round(avg(value) OVER (PARTITION BY date_trunc('day', ts)), 6) AS value_daymean
FROM events""")
sql("recipe_month_mean", """
SELECT o_orderkey, o_orderdate, round(o_totalprice, 4) AS o_totalprice,
       round(avg(o_totalprice) OVER (PARTITION BY date_trunc('month', o_orderdate)), 4) AS o_totalprice_monthmean
FROM orders""")
sql("recipe_chain", """
WITH k AS (SELECT event_id, ts, value + 273.15 AS kelvin FROM events),
f AS (SELECT *, (kelvin - 273.15) * 9.0 / 5.0 + 32.0 AS fahrenheit FROM k)
SELECT event_id, round(kelvin, 4) AS kelvin, round(fahrenheit, 4) AS fahrenheit,
       round(avg(fahrenheit) OVER (PARTITION BY date_trunc('day', ts)), 4) AS fahrenheit_day
FROM f""")
sql("recipe_month_mean_no_time", """
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate END AS placed, o_totalprice FROM orders)
SELECT o_orderkey, placed, round(o_totalprice, 4) AS o_totalprice,
       round(avg(o_totalprice) OVER (PARTITION BY date_trunc('month', placed)), 4) AS monthmean
FROM o""")
sql("recipe_suggest", """
SELECT event_id, round(value - 273.15, 6) AS air_k_c, round(value / 100.0, 6) AS push_hpa, round(value * 3.6, 6) AS wind_kmh FROM events""")
sql("recipe_checks", """
WITH lows AS (
  SELECT 'l_quantity' AS source, min(l_quantity) AS low FROM lineitem UNION ALL SELECT 'l_extendedprice', min(l_extendedprice) FROM lineitem
  UNION ALL SELECT 'l_discount', min(l_discount) FROM lineitem UNION ALL SELECT 'l_tax', min(l_tax) FROM lineitem)
SELECT source, operation, CASE operation WHEN 'divide_constant' THEN low = 0 ELSE true END AS refused
FROM lows, (VALUES ('divide_constant'), ('add_constant'), ('rolling_mean')) AS o(operation)""")

# --- roles --------------------------------------------------------------------------------------------------


# No event column has a telling name, so the coordinates follow from the value ranges.
sql("infer_roles", """
WITH cols AS (
  SELECT * FROM (VALUES (1, 'event_id', 'n'), (2, 'ts', 't'), (3, 'user_id', 'n'), (4, 'event_type', 'c'),
                        (5, 'value', 'n'), (6, 'props', 'c')) AS c(pos, name, kind)),
spans AS (
  SELECT 'event_id' AS name, min(event_id) AS lo, max(event_id) AS hi FROM events
  UNION ALL SELECT 'user_id', min(user_id), max(user_id) FROM events
  UNION ALL SELECT 'value', min(value), max(value) FROM events),
lat AS (SELECT name FROM cols JOIN spans USING (name) WHERE lo >= -90 AND hi <= 90 ORDER BY pos LIMIT 1),
lon AS (SELECT name FROM cols JOIN spans USING (name) WHERE lo >= -180 AND hi <= 180 ORDER BY pos LIMIT 1),
flagged AS (
  SELECT name, kind, name IN (SELECT name FROM lat) AS is_lat, name IN (SELECT name FROM lon) AS is_lon FROM cols)
SELECT name AS "column",
       CASE WHEN kind = 't' THEN 'time' WHEN kind = 'c' THEN 'categorical' WHEN is_lon THEN 'longitude'
            WHEN is_lat THEN 'latitude' ELSE 'numeric' END AS role,
       kind = 't' AS is_time, is_lat AS is_latitude, is_lon AS is_longitude,
       kind = 'n' AND NOT is_lat AND NOT is_lon AS is_variable
FROM flagged""")
# An x in the name tells of a longitude; the latitude is the first column whose values fit. One may be both, and then has the label found last.
sql("infer_roles_ranges", """
WITH spans AS (
  SELECT 3 AS pos, 'l_tax' AS name, min(l_tax) AS lo, max(l_tax) AS hi FROM lineitem
  UNION ALL SELECT 4, 'l_extendedprice', min(l_extendedprice), max(l_extendedprice) FROM lineitem
  UNION ALL SELECT 5, 'l_discount', min(l_discount), max(l_discount) FROM lineitem),
lat AS (SELECT min_by(name, pos) AS name FROM spans WHERE lo >= -90 AND hi <= 90),
lon AS (SELECT min_by(name, pos) AS name FROM spans WHERE name LIKE '%x%'),
cols AS (
  SELECT name, 'n' AS kind FROM spans
  UNION ALL SELECT column_name, CASE WHEN column_type LIKE 'TIMESTAMP%' THEN 't' ELSE 'c' END
  FROM (DESCRIBE SELECT l_shipdate, l_returnflag FROM lineitem))
SELECT name AS "column",
       CASE WHEN kind = 't' THEN 'time' WHEN kind = 'c' THEN 'categorical' WHEN name = (SELECT name FROM lat) THEN 'latitude'
            WHEN name = (SELECT name FROM lon) THEN 'longitude' ELSE 'numeric' END AS role,
       kind = 't' AS is_time, coalesce(name = (SELECT name FROM lat), false) AS is_latitude,
       coalesce(name = (SELECT name FROM lon), false) AS is_longitude,
       kind = 'n' AND name IS DISTINCT FROM (SELECT name FROM lat) AND name IS DISTINCT FROM (SELECT name FROM lon) AS is_variable
FROM cols""")
# Text is a time if four fifths of its cells are.
sql("infer_roles_text", """
WITH t AS (SELECT strftime(o_orderdate, '%-m/%-d/%Y') AS placed, o_orderpriority, o_totalprice FROM orders),
shares AS (
  SELECT 'placed' AS name, count(try_strptime(placed, '%m/%d/%Y')) >= 0.8 * count(placed) AS times FROM t
  UNION ALL SELECT 'o_orderpriority', count(try_strptime(o_orderpriority, '%m/%d/%Y')) >= 0.8 * count(o_orderpriority) FROM t),
place AS (SELECT max(abs(o_totalprice)) <= 180 AS fits FROM t)
SELECT name AS "column", CASE WHEN times THEN 'time' ELSE 'categorical' END AS role, times AS is_time, false AS is_latitude,
       false AS is_longitude, false AS is_variable FROM shares
UNION ALL SELECT 'o_totalprice', CASE WHEN fits THEN 'longitude' ELSE 'numeric' END, false, fits, fits, NOT fits FROM place""")

# --- charts -------------------------------------------------------------------------------------------------



def grid(lat_bins: int, lon_bins: int, value: str = "l_extendedprice") -> str:
    """Cell means ``means(lat_bin, lon_bin, value)`` of right-closed equal-width bins, the minimum in bin 0."""

    def axis(name: str, low: str, high: str, bins: int) -> str:
        return f"""
{name} AS (SELECT i::INTEGER AS {name}_bin, i * (({high} - {low}) / {bins}) + {low} AS lft,
                  CASE WHEN i = {bins - 1} THEN {high} ELSE (i + 1) * (({high} - {low}) / {bins}) + {low} END AS rgt
           FROM b, range(0, {bins}) AS k(i))"""

    return f"""
b AS (SELECT min(l_quantity) AS alo, max(l_quantity) AS ahi, min(l_discount) AS olo, max(l_discount) AS ohi FROM lineitem),
{axis('lat', 'alo', 'ahi', lat_bins)}, {axis('lon', 'olo', 'ohi', lon_bins)},
placed AS (
  SELECT lat_bin, lon_bin, {value} AS v FROM lineitem
  JOIN lat ON (l_quantity > lat.lft OR (lat_bin = 0 AND l_quantity = lat.lft)) AND l_quantity <= lat.rgt
  JOIN lon ON (l_discount > lon.lft OR (lon_bin = 0 AND l_discount = lon.lft)) AND l_discount <= lon.rgt),
means AS (SELECT lat_bin, lon_bin, avg(v) AS value FROM placed GROUP BY 1, 2)"""


for _name, _bins, _digits in (("spatial_grid", (12, 8), 7), ("spatial_grid_default", (45, 90, "l_partkey"), 8)):
    sql(_name, f"""
WITH {grid(*_bins)}
SELECT lat.lat_bin, lon.lon_bin, round(coalesce(value, 0), {_digits}) AS value
FROM lat CROSS JOIN lon LEFT JOIN means ON means.lat_bin = lat.lat_bin AND means.lon_bin = lon.lon_bin""")
_columns = ", ".join(
    f"round(coalesce(max(value) FILTER (WHERE lon_bin = {i}), 0), 7) AS lon_{i}" for i in range(4)
)
sql("spatial_grid_matrix", f"""
WITH {grid(6, 4)} SELECT lat.lat_bin, {_columns} FROM lat LEFT JOIN means ON means.lat_bin = lat.lat_bin GROUP BY 1""")
sql("grid_edges", """
WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
SELECT i::INTEGER AS bin,
       round(CASE WHEN i = 0 THEN lo - (hi - lo) * 0.001::DOUBLE ELSE lo + i * ((hi - lo) / 10) END, 6) AS left,
       round(CASE WHEN i = 9 THEN hi ELSE lo + (i + 1) * ((hi - lo) / 10) END, 6) AS right
FROM b, range(0, 10) AS k(i)""")
sql("chart_heatmap_corr", ORACLE["corr_long"])
sql("map_points", f"""
WITH numbered AS (
  SELECT l_quantity AS lat, l_tax AS lon, round(l_extendedprice, 6) AS value,
         row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS i
  FROM lineitem WHERE l_quantity IS NOT NULL AND l_tax IS NOT NULL AND l_extendedprice IS NOT NULL),
{spaced('SELECT count(*) FROM numbered', 5000)}
SELECT lat, lon, value FROM numbered JOIN pick USING (i)""")
sql("systematic_sample_rows", f"""
WITH numbered AS (
  SELECT o_orderkey, o_orderdate, o_totalprice, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i FROM orders),
{spaced('SELECT count(*) FROM orders', 1000)}
SELECT o_orderkey, o_orderdate, o_totalprice FROM numbered JOIN pick USING (i)""")
sql("chart_time_series", """
SELECT ts AS time, round(value, 6) AS value FROM events WHERE ts IS NOT NULL AND value IS NOT NULL ORDER BY ts""")
sql("chart_scatter", """
SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL""")
sql("chart_anomaly", f"""
WITH {Z} SELECT time AS x, round(value, 6) AS value, abs(z_score) >= 1.5 AS is_anomaly FROM z""")

# --- sources and sinks --------------------------------------------------------------------------------------

sql("flatten_grid_cells", """
WITH cells AS (
  SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)
SELECT vec_id, CAST(pos // 8 * 10 AS INTEGER) AS lat, CAST(pos // 2 % 4 + 100 AS INTEGER) AS lon,
       CAST(CASE pos % 2 WHEN 0 THEN 850 ELSE 500 END AS INTEGER) AS level, round(v, 6) AS v
FROM cells""")
sql("flatten_raster_points", """
WITH cells AS (
  SELECT vec_id, unnest(embedding) AS p, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)
SELECT vec_id, round(0.5::DOUBLE * (pos % 8 + 0.5::DOUBLE) - 10, 6) AS longitude,
       round(-0.25::DOUBLE * (pos // 8 + 0.5::DOUBLE) + 60, 6) AS latitude, round(p::DOUBLE, 6) AS value
FROM cells WHERE p > 0""")
sql("standardize_cells", """
SELECT event_id, props, '[' || user_id || ',' || event_id || ']' AS pair FROM events""")
sql("coerce_quality", """
SELECT event_type, count(TRY_CAST(nullif(regexp_extract(props, '([0-9]+)', 1), '') AS DOUBLE)) AS k_numbers,
       sum(TRY_CAST(nullif(regexp_extract(props, '([0-9]+)', 1), '') AS DOUBLE)) AS k_sum,
       count(value) AS padded_numbers, round(sum(value), 4) AS padded_sum,
       CAST(0 AS BIGINT) AS literal_numbers, count(TRY_CAST(props AS DOUBLE)) AS props_numbers
FROM events GROUP BY 1""")
sql("preview_page", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 250")
sql("dataset_profile", """
SELECT 'orders.parquet' AS name, 'parquet' AS source_format,
       'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority,thousands' AS columns,
       'thousands' AS derived_columns, 'o_orderdate' AS time_column, 'o_totalprice,thousands' AS climate_variables,
       count(*) AS row_count FROM orders""")
sql("dataset_list", """
SELECT 'orders.parquet' AS name, 'parquet' AS source_format, count(*) AS row_count, 6::INTEGER AS column_count FROM orders
UNION ALL SELECT 'lineitem.parquet', 'parquet', count(*), 11 FROM lineitem
UNION ALL SELECT 'events.parquet', 'parquet', count(*), 6 FROM events""")
sql("export_flat", f"""
WITH {DAYS}, {YEARS}, {YEAR_FIT}, cov AS ({ORACLE['annual_trend_coverage']}), summ AS ({YEAR_SUMMARY})
SELECT 'o_orderdate' AS time_column, 'o_totalprice' AS target_column, cov.*,
       slope_per_year AS summary_slope_per_year, slope_per_decade AS summary_slope_per_decade,
       total_change AS summary_total_change, r2 AS summary_r2, trend_direction AS summary_trend_direction,
       lowest_year AS summary_lowest_year, lowest_value AS summary_lowest_value,
       highest_year AS summary_highest_year, highest_value AS summary_highest_value
FROM cov, summ""")
sql("csv_round_trip", """
SELECT o_orderkey, 'two "lines",' || chr(10) || o_orderpriority AS mark, CASE WHEN o_orderkey % 3 = 1 THEN 'x' END AS word,
       o_custkey % 2 = 0 AS even, o_totalprice FROM orders""")
sql("parquet_by_year", """
SELECT o_orderkey, o_orderdate, round(o_totalprice, 4) AS o_totalprice FROM orders WHERE year(o_orderdate) > 1995""")
sql("export_primary", ORACLE["corr_matrix"])
sql("export_every_table", ORACLE["baseline_summary"].replace("(SELECT year FROM", "(SELECT CAST(year AS BIGINT) FROM"))
sql("capped_ingest", f"""
WITH numbered AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders),
{spaced('SELECT count(*) FROM orders', 777)}
SELECT o_orderkey, o_totalprice AS price FROM numbered JOIN pick USING (i)""")
sql("raster_capped", f"""
WITH cells AS (
  SELECT vec_id, unnest(range(len(embedding))) AS spot, unnest(embedding)::DOUBLE AS value FROM embeddings),
numbered AS (SELECT *, row_number() OVER (ORDER BY vec_id, spot) - 1 AS i FROM cells WHERE value IS NOT NULL),
{spaced('SELECT count(*) FROM numbered', 999)}
SELECT vec_id, round((spot % 8 + 0.5) * 0.5 - 10.0, 6) AS longitude, round((spot // 8 + 0.5) * -0.25 + 60.0, 6) AS latitude, round(value, 6) AS value
FROM numbered JOIN pick USING (i)""")
sql("override_roles", """
SELECT make_date(year(l_shipdate), 12, 31)::TIMESTAMP AS period_start, count(l_tax) AS l_tax_count, count(l_discount) AS l_discount_count,
       round(max(l_tax), 4) AS l_tax_max, round(max(l_discount), 4) AS l_discount_max
FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1""")
sql("size_guards", """
WITH sizes AS (
  SELECT 'YE' AS period, count(DISTINCT year(o_orderdate)) AS n FROM orders
  UNION ALL SELECT 'ME', count(DISTINCT date_trunc('month', o_orderdate)) FROM orders
  UNION ALL SELECT 'D', count(DISTINCT date_trunc('day', o_orderdate)) FROM orders),
years AS (SELECT count(DISTINCT year(o_orderdate)) AS years FROM orders)
SELECT analysis, period, CASE analysis WHEN 'annual_trend' THEN years < 3 ELSE n < least END AS refused
FROM sizes, years, (VALUES ('annual_trend', 3), ('regression', 10), ('forest', 30), ('forecast', 12)) AS a(analysis, least)""")
sql("readable_times", """
SELECT 'us' AS "column", count(ts) > 0 AS readable FROM events
UNION ALL SELECT 'plain', count(ts) > 0 FROM events
UNION ALL SELECT 'event_type', count(try_cast(event_type AS TIMESTAMP)) > 0 FROM events
UNION ALL SELECT 'props', count(try_cast(props AS TIMESTAMP)) > 0 FROM events
UNION ALL SELECT 'rare', count(*) FILTER (WHERE event_id = 17 AND ts IS NOT NULL) > 0 FROM events""")
sql("preview_limits", """
SELECT k::INTEGER AS "case", o_orderkey
FROM (VALUES (0, 7), (1, 12), (2, 100), (3, 100), (4, 100), (5, 1), (6, 1), (7, 2)) AS l(k, most)
JOIN (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS i FROM orders) ON i <= most""")
sql("zscore_listing_text", f"""
WITH m AS (SELECT avg(value) AS mean, stddev_pop(value) AS std FROM events)
SELECT CASE WHEN event_id % 7 <> 0 THEN strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') ELSE 'unknown' END AS time, round(value, 6) AS value,
       round((value - mean) / std, 6) AS z_score, event_id
FROM events, m WHERE abs((value - mean) / std) >= 2""")

"""Queries of aggregates, labels, scores and threshold rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberframe.operators import joins_space, joins_time, labels, metrics, quality, rules, sampling, weather
from emberframe.plans.views import table, view

W = "avg(t2m) AS t2m_mean, max(t2m) AS t2m_max, min(t2m) AS t2m_min, " + ", ".join(f"avg({c}) AS {c}_mean" for c in weather.MEANS) + ", max(i10fg) AS i10fg_max, coalesce(sum(tp), 0) * 1000 AS tp_sum_mm"
DAILY = f"d AS (SELECT cell_id, CAST(time AS DATE) AS date, {W} FROM v_wx GROUP BY cell_id, CAST(time AS DATE))"
RH = "greatest(least(100 * (6.112 * exp(17.67 * (d2m_mean - 273.15) / (d2m_mean - 273.15 + 243.5))) / (6.112 * exp(17.67 * (t2m_mean - 273.15) / (t2m_mean - 273.15 + 243.5))), 100), 0)"
SPECS = {"t2m_max_7d": ("t_max", "max"), "tp_sum_7d": ("p_sum", "sum"), "t2m_min_7d": ("t_min", "min"), "t2m_mean_7d": ("t_mean", "avg")}
ROLL = ", ".join(f"CASE WHEN count({c}) OVER w = 7 THEN round({f}({c}) OVER w, 6) END AS {n}" for n, (c, f) in SPECS.items())

THR = """f AS (SELECT day, count(*) AS n_valid_pixels, count(*) FILTER (flag > 0) AS n_fire_pixels_label, coalesce(max(conf) FILTER (flag > 0), 0) AS conf_max, coalesce(avg(conf) FILTER (flag > 0), 0) AS conf_mean, coalesce(quantile_cont(conf, 0.9) FILTER (flag > 0), 0) AS conf_p90, coalesce(max(t21) FILTER (flag > 0), 0) AS t21_max, coalesce(avg(t21) FILTER (flag > 0), 0) AS t21_mean, coalesce(quantile_cont(t21, 0.9) FILTER (flag > 0), 0) AS t21_p90, """ + ", ".join(
    [f"count(*) FILTER (flag > 0 AND conf >= {s}) AS n_conf_ge_{s}" for s in labels.CONF_STEPS] + [f"count(*) FILTER (flag > 0 AND t21 >= {s}) AS n_t21_ge_{s}" for s in labels.T21_STEPS] + [f"count(*) FILTER (flag > 0 AND conf >= {a} AND t21 >= {b}) AS n_both_conf{a}_t21{b}" for a, b in labels.BOTH]
) + " FROM v_hot GROUP BY day)"


def threshold_features(s, d):
    return labels.daily_threshold_features(view(s, d, "v_hot"))


def study(s, d):
    """Daily features with a made-up target that follows from the number of pixels."""
    f = threshold_features(s, d)
    return f.withColumn("target", F.when((F.col("n_valid_pixels") % 3) == 0, 1).otherwise(0))


STUDY = f"{THR}, s AS (SELECT *, CASE WHEN n_valid_pixels % 3 = 0 THEN 1 ELSE 0 END AS target FROM f)"
_ALL = " UNION ALL ".join([f"SELECT '{f}' AS f, {f} AS v, day, target FROM s" for f in rules.SINGLE])
_PAIRS = " UNION ALL ".join([f"SELECT '{a}' AS f1, '{b}' AS f2, {a} AS v1, {b} AS v2, target FROM s" for a, b in rules.PAIRS])
RULES = f"""WITH {STUDY}, one AS ({_ALL}), two AS ({_PAIRS}),
 t1 AS (SELECT f, greatest(2, least(max(v), 200)) AS top FROM one GROUP BY f), r1 AS (SELECT f, unnest(range(1, top + 1)) AS t FROM t1),
 t2 AS (SELECT f1, f2, greatest(2, least(max(v1), 50)) AS a, greatest(2, least(max(v2), 50)) AS b FROM two GROUP BY f1, f2),
 r2 AS (SELECT f1, f2, t, unnest(range(1, b + 1)) AS u FROM (SELECT f1, f2, b, unnest(range(1, a + 1)) AS t FROM t2) x),
 c AS (SELECT 'single' AS rule_type, r1.f AS feature_1, t AS threshold_1, NULL AS feature_2, CAST(NULL AS BIGINT) AS threshold_2, count(*) FILTER (v >= t AND target = 1) AS tp, count(*) FILTER (v >= t AND target = 0) AS fp, count(*) FILTER (v < t AND target = 1) AS fn, count(*) FILTER (v < t AND target = 0) AS tn FROM r1 JOIN one ON one.f = r1.f GROUP BY r1.f, t
 UNION ALL SELECT 'and', r2.f1, t, r2.f2, u, count(*) FILTER (v1 >= t AND v2 >= u AND target = 1), count(*) FILTER (v1 >= t AND v2 >= u AND target = 0), count(*) FILTER (NOT (v1 >= t AND v2 >= u) AND target = 1), count(*) FILTER (NOT (v1 >= t AND v2 >= u) AND target = 0) FROM r2 JOIN two ON two.f1 = r2.f1 AND two.f2 = r2.f2 GROUP BY r2.f1, r2.f2, t, u
 UNION ALL SELECT 'or', r2.f1, t, r2.f2, u, count(*) FILTER ((v1 >= t OR v2 >= u) AND target = 1), count(*) FILTER ((v1 >= t OR v2 >= u) AND target = 0), count(*) FILTER (NOT (v1 >= t OR v2 >= u) AND target = 1), count(*) FILTER (NOT (v1 >= t OR v2 >= u) AND target = 0) FROM r2 JOIN two ON two.f1 = r2.f1 AND two.f2 = r2.f2 GROUP BY r2.f1, r2.f2, t, u),
 m AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS f1, coalesce((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, tp / nullif(tp + fn, 0), tn / nullif(tn + fp, 0)) AS balanced_accuracy FROM c)"""
_RULE_COLS = "rule_type, feature_1, threshold_1, feature_2, threshold_2, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(balanced_accuracy, 6) AS balanced_accuracy"
_BEST = "f1 DESC, balanced_accuracy DESC, recall DESC, precision DESC, rule_type, feature_1, threshold_1, feature_2, threshold_2"


def best_rule_days(s, d):
    days = study(s, d)
    best = rules.search_rules(days, "target").first().asDict()  # one row
    return rules.apply_rule(days, best).select("day", "predicted_fire_day_best")


CONF = "sum(CAST(p >= {t} AND y = 1 AS INT)) AS tp, sum(CAST(p >= {t} AND y = 0 AS INT)) AS fp, sum(CAST(p < {t} AND y = 1 AS INT)) AS fn, sum(CAST(p < {t} AND y = 0 AS INT)) AS tn"
RATIOS = "CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, round(tp / (tp + fp + 1e-8), 6) AS precision, round(tp / (tp + fn + 1e-8), 6) AS recall, round(2 * (tp / (tp + fp + 1e-8)) * (tp / (tp + fn + 1e-8)) / (tp / (tp + fp + 1e-8) + tp / (tp + fn + 1e-8) + 1e-8), 6) AS f1, round((2 * tp + 1e-6) / (2 * tp + fp + fn + 1e-6), 6) AS dice, round((tp + tn) / (tp + fp + fn + tn + 1e-8), 6) AS accuracy, round((tp + fn) / (tp + fp + fn + tn), 6) AS positive_rate_true, round((tp + fp) / (tp + fp + fn + tn), 6) AS positive_rate_pred"
BYSCORE = "s AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM v_score GROUP BY p), k AS (SELECT *, sum(neg) OVER (ORDER BY p) - neg AS below, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(pos + neg) OVER (ORDER BY p DESC) AS n, sum(pos) OVER () AS total FROM s)"


def scored(s, d):
    """V_score as two models' scores on three splits."""
    v = view(s, d, "v_score").select("cell_id", F.concat(F.lit("m"), (F.col("l_linenumber") % 2).cast("string")).alias("model"), F.concat(F.lit("s"), (F.col("l_orderkey") % 3).cast("string")).alias("split"), (F.col("p") / 10).alias("p"), "y")
    return v


def alert_samples(s, d):
    """One score per day and cell from V_score, with a made-up point."""
    v = view(s, d, "v_score").groupBy("day", "cell_id").agg(F.avg("p").alias("x"), F.max("y").alias("y_fire"))
    return v.select(F.col("day").alias("label_date"), "cell_id", (F.round("x", 6) / 10).alias("p_fire"), "y_fire")


ALERTS = "a AS (SELECT day AS label_date, cell_id, round(avg(p), 6) / 10 AS p_fire, max(y) AS y_fire FROM v_score GROUP BY day, cell_id)"


def alerts_daily(s, d):
    """The minimum slice, end to end: hourly readings to days, trailing week, terrain, next-day label, a weather score,
    and the top cells of each day."""
    day = weather.daily_weather(view(s, d, "v_wx"))
    day = weather.rolling_history(day, {"t7": ("t2m_max", "max"), "r7": ("rh_mean", "min")}, 3).filter("t7 IS NOT NULL AND r7 IS NOT NULL")
    day = joins_space.attach_static(day, view(s, d, "v_static").select("cell_id", "slope"))
    out = labels.attach_label(day, labels.cell_labels(view(s, d, "v_hot"), 60.0))
    score = F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-((F.col("t7") - 290) / 10 + F.col("slope") / 50 - F.col("r7") / 100))), 6)
    return metrics.alerts(out.withColumn("p_fire", score), 5).select("label_date", "cell_id", "rank", "y_fire", "firms_n_pixels", F.round(F.col("p_fire").cast("double"), 4).alias("p_fire"))


ALERTS_DAILY = f"""WITH {DAILY}, e AS (SELECT *, {RH} AS rh_mean FROM d), r AS (SELECT *, CASE WHEN count(t2m_max) OVER w = 3 THEN max(t2m_max) OVER w END AS t7, CASE WHEN count(rh_mean) OVER w = 3 THEN min(rh_mean) OVER w END AS r7 FROM e WINDOW w AS (PARTITION BY cell_id ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
 l AS (SELECT day, cell_id, count(*) AS n FROM v_hot WHERE conf >= 60 GROUP BY day, cell_id),
 p AS (SELECT r.date + 1 AS label_date, r.cell_id, CAST(CASE WHEN l.n IS NULL THEN 0 ELSE 1 END AS TINYINT) AS y_fire, CAST(coalesce(l.n, 0) AS INT) AS firms_n_pixels, round(1 / (1 + exp(-((t7 - 290) / 10 + slope / 50 - r7 / 100))), 6) AS p_fire FROM r JOIN v_static ON v_static.cell_id = r.cell_id LEFT JOIN l ON l.day = r.date + 1 AND l.cell_id = r.cell_id WHERE t7 IS NOT NULL AND r7 IS NOT NULL),
 k AS (SELECT *, CAST(row_number() OVER (PARTITION BY label_date ORDER BY p_fire DESC, cell_id) AS INT) AS rank FROM p)
 SELECT label_date, cell_id, rank, y_fire, firms_n_pixels, round(CAST(CAST(p_fire AS FLOAT) AS DOUBLE), 4) AS p_fire FROM k WHERE rank <= 5"""

SUMMARY = "m AS (SELECT day, count(flag) AS n_valid_pixels, count(*) FILTER (flag > 0) AS n_positive_pixels, min(conf) AS confidence_min, max(conf) AS confidence_max, avg(conf) AS confidence_mean, stddev_pop(conf) AS confidence_std, min(t21) AS t21_min, max(t21) AS t21_max, avg(t21) AS t21_mean, stddev_pop(t21) AS t21_std, count(*) FILTER (flag > 0) / count(*) AS positive_fraction FROM v_hot GROUP BY day)"
_STATS = "confidence_min confidence_max confidence_mean confidence_std t21_min t21_max t21_mean t21_std positive_fraction".split()
_QS = ", ".join(f"round(quantile_cont(value, {q}), 6) AS {n}" for n, q in quality.PERCENTS)


def layers(s, d):
    return view(s, d, "v_ras").select(F.concat(F.lit("l"), (F.col("row") % 3).cast("string")).alias("layer"), "row", "col", "value")


def bounds(s, d):
    """Boxes of four sources from V_pts."""
    return view(s, d, "v_pts").groupBy((F.col("pt_id") % 4).alias("k"), (F.col("pt_id") % 12).alias("tile")).agg(*(f(c).alias(n) for f, c, n in ((F.min, "lon", "west"), (F.min, "lat", "south"), (F.max, "lon", "east"), (F.max, "lat", "north")))).select(F.concat(F.lit("src"), F.col("k").cast("string")).alias("source"), "west", "south", "east", "north")


BOUNDS = "b AS (SELECT concat('src', CAST(pt_id % 4 AS VARCHAR(5))) AS source, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north FROM v_pts GROUP BY pt_id % 4)"
_EDGES = " UNION ALL ".join(f"SELECT '{e}' AS edge, source, {e} * {s} AS v FROM b" for e, s in (("west", 1), ("south", 1), ("east", -1), ("north", -1)))


def tile_meta(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("tile"), F.when(F.col("p_partkey") % 5 != 0, "EPSG:4326").alias("crs"), (F.col("p_partkey") % 7).alias("bands"), F.lit(100).alias("n_pixels"), (F.lit(0.25) + (F.col("p_partkey") % 4) * 0.02).alias("pixel_size")).filter("tile % 3 <> 0")


QUERIES = {
    "alerts_daily": (alerts_daily, ALERTS_DAILY),
    "a1_daily_weather": (lambda s, d: weather.daily_weather(view(s, d, "v_wx")), f"WITH {DAILY} SELECT cell_id, date, " + ", ".join(f"round({c}, 6) AS {c}" for c in ["t2m_mean", "t2m_max", "t2m_min", *(f"{c}_mean" for c in weather.MEANS), "i10fg_max", "tp_sum_mm"]) + f", round(sqrt(u10_mean * u10_mean + v10_mean * v10_mean), 6) AS wind_speed_mean, round(sin(radians(degrees(atan2(u10_mean, v10_mean)) + 180)), 6) + 0 AS wind_dir_sin, round(cos(radians(degrees(atan2(u10_mean, v10_mean)) + 180)), 6) + 0 AS wind_dir_cos, round({RH}, 6) AS rh_mean, round((swvl1_mean + swvl2_mean) / 2, 6) AS soil_moisture_index FROM d"),
    "a3_daily_weather_grid": (lambda s, d: weather.daily_weather_grid(view(s, d, "v_wx")), "WITH d AS (SELECT cell_id, CAST(time AS DATE) AS date, max(t2m) - 273.15 AS t2m_max_C, min(t2m) - 273.15 AS t2m_min_C, avg(t2m) - 273.15 AS t2m_mean_C, avg(d2m) - 273.15 AS d2m_mean_C, avg(sp) AS sp_mean, avg(u10) AS u, avg(v10) AS v, max(i10fg) AS wind_gust_max, coalesce(sum(tp), 0) * 1000 AS precip_sum_mm, avg(swvl1) AS soil_water_l1_mean, avg(swvl2) AS soil_water_l2_mean, avg(cvh) AS high_veg_cover, avg(cvl) AS low_veg_cover, avg(lai_hv) AS lai_high_veg, avg(lai_lv) AS lai_low_veg, avg(blh) AS blh_mean, max(blh) AS blh_max FROM v_wx GROUP BY cell_id, CAST(time AS DATE)) SELECT cell_id, date, " + ", ".join(f"round({c}, 6) AS {c}" for c in "t2m_max_C t2m_min_C t2m_mean_C d2m_mean_C sp_mean wind_gust_max precip_sum_mm soil_water_l1_mean soil_water_l2_mean high_veg_cover low_veg_cover lai_high_veg lai_low_veg blh_mean blh_max".split()) + ", round(sqrt(u * u + v * v), 6) AS wind_speed_mean, round(sin(atan2(v, u)), 6) + 0 AS wind_dir_sin, round(cos(atan2(v, u)), 6) + 0 AS wind_dir_cos, round(0.6108 * exp(17.27 * t2m_mean_C / (t2m_mean_C + 237.3)) - 0.6108 * exp(17.27 * d2m_mean_C / (d2m_mean_C + 237.3)), 6) AS vpd FROM d"),
    "s5_complete_years": (lambda s, d: weather.concat_complete_years(table(s, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("time"))).select("o_orderkey", F.year("time").alias("year")), "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS year FROM orders WHERE year(o_orderdate) IN (SELECT year(o_orderdate) FROM orders GROUP BY year(o_orderdate) HAVING count(DISTINCT month(o_orderdate)) = 12)"),
    "w1_rolling_rows": (lambda s, d: weather.rolling_history(view(s, d, "v_day"), SPECS, 7, day="day").select("cell_id", "day", *SPECS), f"SELECT cell_id, day, {ROLL} FROM v_day WINDOW w AS (PARTITION BY cell_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"),
    "w1_rolling_calendar": (lambda s, d: weather.rolling_history(view(s, d, "v_day"), SPECS, 7, day="day", calendar=True).select("cell_id", "day", *SPECS), f"SELECT cell_id, day, {ROLL} FROM v_day WINDOW w AS (PARTITION BY cell_id ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW)"),
    "w2_rainfall_24h": (lambda s, d: weather.rainfall_24h(view(s, d, "v_obs"), time="ts", value="value", ties=("event_id",)).select("event_id", "rainfall_24h"), "SELECT event_id, round(sum(value) OVER (PARTITION BY cell_id ORDER BY ts, event_id ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), 6) AS rainfall_24h FROM v_obs"),
    "j10_carry_forward": (lambda s, d: weather.carry_forward(view(s, d, "v_hot").groupBy("cell_id", "day").agg(F.max("conf").alias("conf")), "cell_id", "day", "conf"), "SELECT cell_id, day, round(last_value(conf IGNORE NULLS) OVER (PARTITION BY cell_id ORDER BY day ROWS UNBOUNDED PRECEDING), 6) AS conf FROM (SELECT cell_id, day, max(conf) AS conf FROM v_hot GROUP BY cell_id, day) x"),
    "a4_cell_labels": (lambda s, d: labels.cell_labels(view(s, d, "v_hot"), 60.0), "SELECT day, cell_id, CAST(count(*) AS INT) AS firms_n_pixels, round(max(conf), 6) AS firms_max_confidence, CAST(1 AS TINYINT) AS y_fire FROM v_hot WHERE conf >= 60 GROUP BY day, cell_id"),
    "j2_attach_label": (lambda s, d: labels.attach_label(view(s, d, "v_day").select("cell_id", F.col("day").alias("date"), "n"), labels.cell_labels(view(s, d, "v_hot"), 60.0)), "WITH l AS (SELECT day, cell_id, count(*) AS n, max(conf) AS m FROM v_hot WHERE conf >= 60 GROUP BY day, cell_id) SELECT v_day.day + 1 AS label_date, v_day.cell_id, v_day.day AS date, v_day.n, CAST(coalesce(l.n, 0) AS INT) AS firms_n_pixels, round(m, 6) AS firms_max_confidence, CAST(l.n IS NOT NULL AS TINYINT) AS y_fire FROM v_day LEFT JOIN l ON l.day = v_day.day + 1 AND l.cell_id = v_day.cell_id"),
    "j22_label_coverage": (lambda s, d: labels.labels_with_coverage(view(s, d, "v_smp").select("sample_id", "day", "y_fire"), view(s, d, "v_day").filter(F.dayofmonth("day") % 4 != 0).select("day"), "day"), "SELECT sample_id, day, CASE WHEN day(day) % 4 <> 0 THEN y_fire END AS y_fire FROM v_smp"),
    "a5_daily_summary": (lambda s, d: labels.daily_summary(view(s, d, "v_hot")), f"WITH {SUMMARY} SELECT day, n_valid_pixels, n_positive_pixels, CAST(n_positive_pixels > 0 AS INT) AS has_fire, " + ", ".join(f"round({c}, 6) AS {c}" for c in _STATS) + " FROM m"),
    "a6_threshold_features": (threshold_features, f"WITH {THR} SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in 'conf_max conf_mean conf_p90 t21_max t21_mean t21_p90'.split())}) FROM f"),
    "a7_period_summary": (lambda s, d: labels.period_summary(labels.daily_summary(view(s, d, "v_hot"))), f"WITH {SUMMARY} SELECT CAST(year(day) AS INT) AS year, CAST(month(day) AS INT) AS month, count(*) AS days, CAST(sum(n_positive_pixels) AS BIGINT) AS total_positive_pixels, round(avg(positive_fraction), 6) AS mean_positive_fraction FROM m GROUP BY GROUPING SETS ((year(day), month(day)), (year(day)))"),
    "a8_fire_frequency": (lambda s, d: labels.fire_frequency(view(s, d, "v_ras"), ("col",), "fire"), "SELECT col, count(*) FILTER (fire > 0) AS days_on_fire FROM v_ras GROUP BY col"),
    "l1_top_days": (lambda s, d: labels.top_days(labels.daily_summary(view(s, d, "v_hot")), 10).select("day", "n_positive_pixels"), f"WITH {SUMMARY} SELECT day, n_positive_pixels FROM m ORDER BY n_positive_pixels DESC, day LIMIT 10"),
    "a29_label_separation": (lambda s, d: labels.label_separation(view(s, d, "v_smp"), ["t_max", "t_min", "t_mean"]), " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}) FILTER (y_fire = 1), 6) AS mean_fire, round(avg({c}) FILTER (y_fire = 0), 6) AS mean_no_fire, round(avg({c}) FILTER (y_fire = 1) - avg({c}) FILTER (y_fire = 0), 6) AS difference, round(corr({c}, y_fire), 6) AS correlation FROM v_smp" for c in ("t_max", "t_min", "t_mean"))),
    "j12_active_per_day": (lambda s, d: joins_time.active_per_day(view(s, d, "v_iv")), "SELECT date, CAST(count(*) AS BIGINT) AS reference_active_count FROM (SELECT CAST(unnest(generate_series(s, greatest(s, coalesce(e, s)), INTERVAL 1 DAY)) AS DATE) AS date FROM v_iv) x GROUP BY date"),
    "j13_on_calendar": (lambda s, d: joins_time.on_calendar(joins_time.calendar(s, F.date_sub(F.min("s"), 40), F.date_add(F.max("s"), 40), view(s, d, "v_iv")), view(s, d, "v_iv").groupBy(F.col("s").alias("date")).agg(F.count("*").alias("starts")), {"starts": "start_day"}), "WITH c AS (SELECT CAST(unnest(generate_series(min(s) - 40, max(s) + 40, INTERVAL 1 DAY)) AS DATE) AS date FROM v_iv), n AS (SELECT s, count(*) AS n FROM v_iv GROUP BY s) SELECT date, coalesce(n, 0) AS starts, CAST(coalesce(n, 0) > 0 AS INT) AS start_day FROM c LEFT JOIN n ON s = date"),
    "j14_attach_reference": (lambda s, d: joins_time.attach_reference(threshold_features(s, d).select("day", "n_conf_ge_60"), view(s, d, "v_win").select(F.col("window_start").alias("day")).distinct().withColumn("target", F.lit(1)), "target", "day"), f"WITH {THR} SELECT day, n_conf_ge_60, 1 AS target FROM f WHERE day IN (SELECT window_start FROM v_win)"),
    "a27_search_rules": (lambda s, d: rules.search_rules(study(s, d), "target"), f"{RULES} SELECT {_RULE_COLS} FROM m"),
    "a28_apply_rule": (best_rule_days, f"{RULES}, b AS (SELECT * FROM m ORDER BY {_BEST} LIMIT 1), v AS (SELECT day, f, v FROM one), w AS (SELECT DISTINCT day FROM s) SELECT w.day, CAST(CASE rule_type WHEN 'or' THEN a.v >= threshold_1 OR c2.v >= threshold_2 WHEN 'and' THEN a.v >= threshold_1 AND c2.v >= threshold_2 ELSE a.v >= threshold_1 END AS INT) AS predicted_fire_day_best FROM w, b JOIN v a ON a.f = feature_1 LEFT JOIN v c2 ON c2.f = feature_2 AND c2.day = a.day WHERE a.day = w.day"),
    "a22_binary_metrics": (lambda s, d: metrics.binary_metrics(view(s, d, "v_score"), threshold=0.5), f"WITH c AS (SELECT {CONF.format(t=0.5)} FROM v_score) SELECT {RATIOS} FROM c"),
    "a35_floor_metrics": (lambda s, d: metrics.floor_metrics(view(s, d, "v_score")), f"WITH c AS (SELECT 0 AS tp, 0 AS fp, sum(y) AS fn, sum(1 - y) AS tn FROM v_score) SELECT {RATIOS} FROM c"),
    "a23_roc_auc": (lambda s, d: metrics.roc_auc(view(s, d, "v_score")), f"WITH {BYSCORE} SELECT round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) AS roc_auc FROM k"),
    "a24_avg_precision": (lambda s, d: metrics.avg_precision(view(s, d, "v_score")), f"WITH {BYSCORE} SELECT round(sum(pos * tp / n) / max(total), 6) AS avg_precision FROM k"),
    "a25_pr_curve": (lambda s, d: metrics.pr_curve(view(s, d, "v_score")).select("threshold", "precision", "recall"), f"WITH {BYSCORE} SELECT round(p, 6) AS threshold, round(tp / n, 6) AS precision, round(tp / total, 6) AS recall FROM k"),
    "a26_class_report": (lambda s, d: metrics.class_report(view(s, d, "v_score")), f"WITH c AS (SELECT {CONF.format(t=0.5)} FROM v_score) SELECT 'no_fire' AS class, round(coalesce(tn / nullif(tn + fn, 0), 0), 6) AS precision, round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS recall, round(coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0), 6) AS f1, CAST(tn + fp AS BIGINT) AS support FROM c UNION ALL SELECT 'fire', round(coalesce(tp / nullif(tp + fp, 0), 0), 6), round(coalesce(tp / nullif(tp + fn, 0), 0), 6), round(coalesce(2 * tp / nullif(2 * tp + fn + fp, 0), 0), 6), CAST(tp + fn AS BIGINT) FROM c"),
    "m4_compare": (lambda s, d: metrics.compare(scored(s, d)).filter("metric IN ('precision', 'recall', 'accuracy', 'roc_auc')"), "WITH v AS (SELECT concat('m', CAST(l_linenumber % 2 AS VARCHAR(3))) AS model, concat('s', CAST(l_orderkey % 3 AS VARCHAR(3))) AS split, p / 10 AS p, y FROM v_score), c AS (SELECT model, split, " + CONF.format(t=0.5) + " FROM v GROUP BY model, split), k AS (SELECT model, split, p, sum(y) AS pos, sum(1 - y) AS neg FROM v GROUP BY model, split, p), b AS (SELECT *, sum(neg) OVER (PARTITION BY model, split ORDER BY p) - neg AS below FROM k) SELECT model, split, 'precision' AS metric, round(tp / (tp + fp + 1e-8), 6) AS value FROM c UNION ALL SELECT model, split, 'recall', round(tp / (tp + fn + 1e-8), 6) FROM c UNION ALL SELECT model, split, 'accuracy', round((tp + tn) / (tp + fp + fn + tn + 1e-8), 6) FROM c UNION ALL SELECT model, split, 'roc_auc', round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) FROM b GROUP BY model, split"),
    "w4_top_k": (lambda s, d: sampling.top_k(alert_samples(s, d), 3, "p_fire", "label_date", "cell_id").select("label_date", "cell_id", "rank"), f"WITH {ALERTS}, k AS (SELECT *, CAST(row_number() OVER (PARTITION BY label_date ORDER BY p_fire DESC, cell_id) AS INT) AS rank FROM a) SELECT label_date, cell_id, rank FROM k WHERE rank <= 3"),
    "m3_alerts": (lambda s, d: metrics.alerts(alert_samples(s, d), 4).select("label_date", "cell_id", "rank", "y_fire", F.round("confidence_pct", 3).alias("confidence_pct")), f"WITH {ALERTS}, k AS (SELECT *, CAST(row_number() OVER (PARTITION BY label_date ORDER BY p_fire DESC, cell_id) AS INT) AS rank FROM a) SELECT label_date, cell_id, rank, y_fire, round(CAST(CAST(p_fire * 100 AS FLOAT) AS DOUBLE), 3) AS confidence_pct FROM k WHERE rank <= 4"),
    "a34_pick_day": (lambda s, d: metrics.pick_day(alert_samples(s, d)), f"WITH {ALERTS} SELECT label_date, count(*) FILTER (y_fire = 1) AS n_pos, round(avg(p_fire), 6) AS mean_p FROM a GROUP BY label_date ORDER BY n_pos DESC, avg(p_fire) DESC, label_date LIMIT 1"),
    "a15_class_balance": (lambda s, d: sampling.class_balance(view(s, d, "v_smp"), "day"), "SELECT split, count(*) AS n, count(*) FILTER (y_fire = 1) AS n_pos, round(count(*) FILTER (y_fire = 1) / count(*), 6) AS positive_rate, CAST(min(year(day)) AS INT) AS first_year, CAST(max(year(day)) AS INT) AS last_year, round(greatest(coalesce(count(*) FILTER (y_fire = 0) / nullif(count(*) FILTER (y_fire = 1), 0), 1), 1), 6) AS pos_weight FROM v_smp GROUP BY split"),
    "a20_impute_median": (lambda s, d: sampling.impute_median(view(s, d, "v_smp"), ["t_min"]).select("sample_id", "t_min"), "SELECT sample_id, round(coalesce(t_min, (SELECT quantile_cont(t_min, 0.5) FROM v_smp WHERE split = 'train')), 6) AS t_min FROM v_smp"),
    "a20_impute_zero": (lambda s, d: sampling.impute_zero(view(s, d, "v_smp").select("sample_id", "t_min"), ["t_min"]), "SELECT sample_id, round(coalesce(t_min, 0), 6) AS t_min FROM v_smp"),
    "a21_zscore": (lambda s, d: sampling.zscore_apply(view(s, d, "v_smp").select("sample_id", "split", "t_max", "t_mean"), sampling.zscore_fit(view(s, d, "v_smp"), ["t_max", "t_mean"]), ["t_max", "t_mean"]).select("sample_id", "t_max", "t_mean"), "WITH m AS (SELECT avg(t_max) AS a, stddev_pop(t_max) AS b, avg(t_mean) AS c, stddev_pop(t_mean) AS e FROM v_smp WHERE split = 'train') SELECT sample_id, round((t_max - a) / b, 6) + 0 AS t_max, round((t_mean - c) / e, 6) + 0 AS t_mean FROM v_smp, m"),
    "a12_layer_stats": (lambda s, d: quality.layer_stats(layers(s, d)), f"WITH l AS (SELECT concat('l', CAST(row % 3 AS VARCHAR(3))) AS layer, value FROM v_ras) SELECT layer, count(value) AS count, round(min(value), 6) AS min, {_QS}, round(max(value), 6) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(skewness(value), 6) AS skew FROM l GROUP BY layer"),
    "a13_corr_pairs": (lambda s, d: quality.corr_pairs(view(s, d, "v_day"), ["t_max", "t_min", "t_mean", "p_sum"]), " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM v_day" for i, a in enumerate(("t_max", "t_min", "t_mean", "p_sum")) for b in ("t_max", "t_min", "t_mean", "p_sum")[i + 1 :])),
    "a16_missing_report": (lambda s, d: quality.missing_report(view(s, d, "v_hot"), ["conf", "t21", "flag"]), " UNION ALL ".join(f"SELECT count(*) AS steps, '{c}' AS variable, round(1 - count({c}) / count(*), 6) AS missing_fraction, 1 - count({c}) / count(*) > 0.01 AS warn FROM v_hot" for c in ("conf", "t21", "flag"))),
    "a17_coverage": (lambda s, d: quality.coverage(view(s, d, "v_obs").withColumns({"lat": F.col("cell_id") % 10, "lon": F.col("cell_id") % 7}), "ts"), "SELECT min(cell_id % 10) AS lat_min, max(cell_id % 10) AS lat_max, min(cell_id % 7) AS lon_min, max(cell_id % 7) AS lon_max, count(DISTINCT (cell_id % 10) * 100 + cell_id % 7) AS n_points, min(ts) AS first_time, max(ts) AS last_time, count(DISTINCT ts) AS n_times, (SELECT string_agg(h, ',') FROM (SELECT DISTINCT hour(ts) AS h0, CAST(hour(ts) AS VARCHAR(2)) AS h FROM v_obs ORDER BY h0) x) AS hours FROM v_obs"),
    "a18_raster_qa": (lambda s, d: quality.raster_qa(layers(s, d).select("layer", F.col("col").cast("double").alias("west"), (F.col("row") % 90).cast("double").alias("south"), (F.col("col") + 1.0).alias("east"), (F.col("row") % 90 + 1.0).alias("north"), "value"), {"west": 0.0, "south": 0.0, "east": 100.0, "north": 89.5}), "WITH l AS (SELECT concat('l', CAST(row % 3 AS VARCHAR(3))) AS layer, row % 90 AS r, col, value FROM v_ras) SELECT layer, min(col) <= 0.01 AND max(col) + 1 >= 99.99 AS lon_ok, min(r) <= 0.01 AND max(r) + 1 >= 89.49 AS lat_ok, count(value) AS n_valid, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(col) <= 0.01 AND max(col) + 1 >= 99.99 AND min(r) <= 0.01 AND max(r) + 1 >= 89.49 AND count(value) > 0 AS passed FROM l GROUP BY layer"),
    "a19_validate_tiles": (lambda s, d: quality.validate_tiles(table(s, d, "part").select(F.col("p_partkey").alias("tile")), tile_meta(s, d), 0.25), "SELECT p_partkey AS tile, CASE WHEN p_partkey % 3 = 0 THEN 'missing' WHEN p_partkey % 5 = 0 OR p_partkey % 7 = 0 THEN 'invalid' ELSE 'valid' END AS status, CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND (p_partkey % 4) * 0.02 > 0.025 + 1e-8 THEN 'pixel size' END AS warning FROM part"),
    "a30_density": (lambda s, d: joins_space.density(view(s, d, "v_pts"), 0.5), "SELECT round(floor(lat / 0.5) * 0.5, 6) AS lat_bin, round(floor(lon / 0.5) * 0.5, 6) AS lon_bin, count(*) AS n FROM v_pts GROUP BY floor(lat / 0.5), floor(lon / 0.5)"),
    "a31_timeline": (lambda s, d: quality.timeline(table(s, d, "orders").select(F.col("o_orderpriority").alias("source"), F.year("o_orderdate").alias("year"))), "SELECT o_orderpriority AS source, string_agg(DISTINCT CAST(year(o_orderdate) AS VARCHAR(4)), ',' ORDER BY CAST(year(o_orderdate) AS VARCHAR(4))) AS years, count(*) AS n FROM orders GROUP BY o_orderpriority"),
    "a32_intersect_bounds": (lambda s, d: joins_space.intersect_bounds(bounds(s, d)), f"WITH {BOUNDS} SELECT round(max(west), 6) AS west, round(max(south), 6) AS south, round(min(east), 6) AS east, round(min(north), 6) AS north FROM b"),
    "a32_binding_edges": (lambda s, d: joins_space.binding_edges(bounds(s, d)), f"WITH {BOUNDS}, e AS ({_EDGES}), t AS (SELECT *, max(v) OVER (PARTITION BY edge) AS top FROM e) SELECT edge, string_agg(source, ',' ORDER BY source) AS sources FROM t WHERE v = top GROUP BY edge"),
    "j18_gaps": (lambda s, d: joins_time.gaps(view(s, d, "v_day").select("cell_id", F.expr("date_add(DATE '2024-01-01', CAST(floor(datediff(day, DATE '2024-01-01') / 5) * 5 AS INT))").alias("window_start")), view(s, d, "v_win"), ["cell_id", "window_start"]), "SELECT DISTINCT cell_id, DATE '2024-01-01' + CAST(floor(date_diff('day', DATE '2024-01-01', day) / 5) * 5 AS INT) AS window_start FROM v_day EXCEPT SELECT cell_id, window_start FROM v_win"),
    "j18_sparse_months": (lambda s, d: quality.sparse_months(view(s, d, "v_iv").select(F.col("s").alias("window_start")), 31), "SELECT CAST(year(s) AS INT) AS year, CAST(month(s) AS INT) AS month, count(DISTINCT s) AS n_windows FROM v_iv GROUP BY year(s), month(s) HAVING count(DISTINCT s) < 31"),
}

"""Windows, features and spectra."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from ..functions.tables import register_tables
from ..operators import features, scaling, spectral, windows
from .registry import E, L, query, r6, table, trials

N, FS = 64, 128.0


def _series(spark, d):
    return table(spark, d, "events").select("user_id", "ts", "event_id", "value")


_SERIES = """s AS (SELECT user_id, value, CAST(row_number() OVER u - 1 AS INT) AS pos, count(*) OVER (PARTITION BY user_id) AS n,
         value - lag(value) OVER u AS d1, value - 2 * lag(value) OVER u + lag(value, 2) OVER u AS d2
  FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id))"""


@query(f"""
WITH {_SERIES}, w AS (
  SELECT *, pos - window_idx * 8 AS in_pos FROM (SELECT s.*, CAST(unnest(range(greatest(0, pos // 8 - 1), pos // 8 + 1)) AS INT) AS window_idx FROM s)
  WHERE window_idx * 8 + 16 <= n AND pos < window_idx * 8 + 16),
f AS (SELECT user_id, window_idx, avg(value) AS m, stddev_pop(value) AS s, median(value) AS med, quantile_cont(value, 0.9) - quantile_cont(value, 0.1) AS spread,
        var_pop(value) AS act, var_pop(d1) FILTER (in_pos >= 1) AS v1, var_pop(d2) FILTER (in_pos >= 2) AS v2,
        avg(value * value) AS m2, avg(value * value * value) AS m3, kurtosis_pop(value) AS kurt
      FROM w GROUP BY ALL)
SELECT user_id, window_idx, round(m, 6) AS mean, round(s, 6) AS std,
  CASE WHEN s > 0 THEN round((m3 - 3 * m * m2 + 2 * m * m * m) / (s * s * s), 6) + 0.0 END AS skew, round(kurt, 6) + 0.0 AS kurt, round(med, 6) AS median, round(spread, 6) AS spread,
  round(act + 1e-9, 6) AS activity, round(sqrt(v1 / (act + 1e-8)), 6) AS mobility,
  round(sqrt(v2 / (v1 + 1e-8)) / (sqrt(v1 / (act + 1e-8)) + 1e-8), 6) AS complexity
FROM f""")
def window_features_events(spark, d):
    series = windows.number_samples(_series(spark, d), "user_id", ["ts", "event_id"], F.date_trunc("day", "ts"))
    cut = windows.explode_windows(series, 16, 8)
    out = features.window_features(cut, ["user_id", "window_idx"])
    # Values of two decimals make variances that end in an exact half: those are rounded up, whatever their last bit.
    rounded = lambda c: r6(F.col(c) + 1e-9, c) if c == "activity" else r6(c)
    return out.select("user_id", "window_idx", *[rounded(c) for c in out.columns[2:]])


@query(f"""WITH {_SERIES}, w AS (SELECT user_id, value, CAST(unnest(range(greatest(0, pos // 8 - 1), pos // 8 + 1)) AS INT) AS window_idx, pos, n FROM s)
SELECT user_id, window_idx, count(*) AS n, round(avg(value), 6) + 0.0 AS mean, round(max(value), 6) + 0.0 AS most FROM w WHERE window_idx * 8 + 16 <= n AND pos >= window_idx * 8 AND pos < window_idx * 8 + 16 GROUP BY ALL""")
def windows_in_sql(spark, d):
    """Windows by the SQL table function over each user's events."""
    register_tables(spark)
    name = f"series_{uuid.uuid4().hex}"
    _series(spark, d).createOrReplaceTempView(name)
    rows = spark.sql(f"SELECT * FROM sliding_windows(TABLE(SELECT * FROM {name}) PARTITION BY user_id ORDER BY (ts, event_id), key => 'user_id', value => 'value', size => 16, step => 8)")
    out = rows.select("user_id", "window_idx", F.size("samples").cast("long").alias("n"), r6(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x) / 16, "mean"), r6(F.array_max("samples"), "most"))
    spark.catalog.dropTempView(name)
    return out


@query("""
SELECT user_id, n AS samples, CAST(CASE WHEN n < 16 THEN 0 ELSE (n - 16) // 8 + 1 END AS INT) AS windows,
       CAST(CASE WHEN n <= 16 THEN 0 ELSE (n - 17) // 8 + 1 END AS INT) AS windows_open
FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)""")
def window_count(spark, d):
    n = _series(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("samples"))
    return n.withColumn("windows", windows.window_count(F.col("samples"), 16, 8)).withColumn("windows_open", windows.window_count_open(F.col("samples"), 16, 8))


@query(f"""
WITH {E} SELECT vec_id, CAST(k AS INT) AS window_idx, round(list_sum(list_transform(embedding[k * 8 + 1 : k * 8 + 16], lambda x: CAST(x AS DOUBLE))), 6) + 0.0 AS total
FROM e, range(0, 6) r(k)""")
def window_drop_last_variant(spark, d):
    cut = windows.cut_windows(trials(spark, d), "embedding", 16, 8, open_end=True)
    return cut.select("vec_id", "window_idx", r6(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double")), "total"))


@query(f"""
WITH {E} SELECT vec_id, CAST(k AS INT) AS window_idx, list_transform(embedding[k * 8 + 1 : k * 8 + 16], lambda x: round(CAST(x AS DOUBLE), 6) + 0.0) AS samples
FROM e, range(0, 4) r(k)""")
def window_segments_capped(spark, d):
    cut = windows.cut_windows(trials(spark, d), "embedding", 16, 8, cap=4)
    return cut.select("vec_id", "window_idx", F.transform("samples", lambda x: r6(x.cast("double"))).alias("samples"))


@query(f"""
WITH {E} SELECT vec_id, CAST(k AS INT) AS factor, list_transform(list_filter(embedding, lambda x, i: (i - 1) % k = 0), lambda x: round(CAST(x AS DOUBLE), 6) + 0.0) AS samples
FROM e, range(2, 6) r(k)""")
def decimate_stride(spark, d):
    rows = trials(spark, d).withColumn("factor", F.explode(F.array(*map(F.lit, (2, 3, 4, 5)))))
    return rows.select("vec_id", "factor", F.transform(windows.decimate("embedding", F.col("factor")), lambda x: r6(x.cast("double"))).alias("samples"))


@query(f"""
WITH {L}, s AS (SELECT vec_id, avg(value) AS m, stddev_pop(value) AS sd FROM l GROUP BY 1)
SELECT vec_id, feature_idx, round((value - m) / (sd + 1e-6), 6) + 0.0 AS z FROM l JOIN s USING (vec_id)""")
def zscore_window(spark, d):
    return windows.zscore(trials(spark, d), "embedding").select("vec_id", F.posexplode("z").alias("feature_idx", "z")).select("vec_id", "feature_idx", r6("z"))


@query(f"""
WITH {L}, s AS (SELECT vec_id, avg(value) AS m FROM l GROUP BY 1)
SELECT vec_id, feature_idx, round(value - m, 6) + 0.0 AS centred FROM l JOIN s USING (vec_id)""")
def dc_remove(spark, d):
    return windows.remove_dc(trials(spark, d), "embedding").select("vec_id", F.posexplode("centred").alias("feature_idx", "centred")).select("vec_id", "feature_idx", r6("centred"))


@query(f"""
WITH {L}, s AS (SELECT vec_id, var_pop(value) AS v, avg(value * value) AS p FROM l GROUP BY 1)
SELECT vec_id, round(0.5 * ln({features.TWO_PI_E!r} * (v + 1e-10)), 6) + 0.0 AS de_added, round(0.5 * ln({features.TWO_PI_E!r} * greatest(v, 1e-10)), 6) + 0.0 AS de_floored,
       round(ln(greatest(p, 1e-10)), 6) + 0.0 AS log_energy FROM s""")
def de_variance(spark, d):
    rows = windows.with_moments(trials(spark, d), "embedding").withColumn("p", windows.mean_of(F.transform("embedding", lambda x: x.cast("double") * x.cast("double"))))
    return rows.select("vec_id", r6(features.gaussian_entropy_added(F.col("v")), "de_added"), r6(features.gaussian_entropy_floored(F.col("v")), "de_floored"), r6(features.log_energy(F.col("p")), "log_energy"))


@query(f"""
WITH {L} SELECT vec_id, avg(value) FILTER (feature_idx < 32) IS NULL AS none, round(ln(var_pop(value) FILTER (feature_idx >= 32) + 1e-8) - ln(var_pop(value) FILTER (feature_idx < 32) + 1e-8), 6) + 0.0 AS asym
FROM l GROUP BY 1""")
def hemisphere_asymmetry(spark, d):
    rows = trials(spark, d).select("vec_id", F.slice("embedding", 1, 32).alias("a"), F.slice("embedding", 33, 32).alias("b"))
    va, vb = (windows.variance_of(F.col(c), windows.mean_of(c)) for c in "ab")
    return rows.select("vec_id", F.lit(False).alias("none"), r6(F.ln(vb + 1e-8) - F.ln(va + 1e-8), "asym"))


_DFT = f"""{L}, tw AS (SELECT CAST(f AS INT) AS bin, CAST(t AS INT) AS feature_idx, cos(2 * pi() * f * t / {N}) AS c, sin(2 * pi() * f * t / {N}) AS s FROM range(0, {N // 2 + 1}) a(f), range(0, {N}) b(t)),
p AS (SELECT vec_id, bin, bin * {FS / N!r}::DOUBLE AS freq, sum(value * c) * sum(value * c) + sum(value * s) * sum(value * s) AS power FROM l JOIN tw USING (feature_idx) GROUP BY vec_id, bin)"""


def _power(spark, d):
    return spectral.with_power(trials(spark, d), "embedding", N)


@query(f"WITH {_DFT} SELECT vec_id, bin, round(power, 6) + 0.0 AS power FROM p")
def dft_power(spark, d):
    return spectral.bins(_power(spark, d), "vec_id", "power", FS / N).select("vec_id", "bin", r6("power"))


_BANDS = "b(ord, band, low, high) AS (VALUES " + ", ".join(f"({i}, '{b}', {lo!r}::DOUBLE, {hi!r}::DOUBLE)" for i, (b, lo, hi) in enumerate(spectral.safe_bands(spectral.BANDS_DE, FS))) + ")"


@query(f"""
WITH {_DFT}, {_BANDS}, per AS (SELECT vec_id, band, avg(power) AS m, sum(power) AS s FROM p JOIN b ON freq >= low AND freq <= high GROUP BY ALL),
whole AS (SELECT vec_id, sum(power) AS t FROM p WHERE freq >= 1 AND freq <= 50 GROUP BY 1)
SELECT vec_id, band, round(ln(m + 1e-8), 6) + 0.0 AS log_power, round(s / (t + 1e-8), 6) AS relative FROM per JOIN whole USING (vec_id)""")
def band_power(spark, d):
    out = spectral.band_power(_power(spark, d), "vec_id", "power", FS / N, spectral.safe_bands(spectral.BANDS_DE, FS))
    return out.select("vec_id", "band", r6("log_power"), r6("relative"))


@query(f"WITH {_DFT} SELECT vec_id, round(sum(freq * power) / (sum(power) + 1e-8), 6) AS centroid FROM p WHERE freq BETWEEN 4 AND 45 GROUP BY 1")
def spectral_centroid(spark, d):
    return spectral.centroid(_power(spark, d), "vec_id", "power", FS / N, 4.0, 45.0).select("vec_id", r6("centroid"))


@query(f"""
WITH {_DFT}, q AS (SELECT vec_id, freq, sum(power) OVER (PARTITION BY vec_id ORDER BY freq ROWS UNBOUNDED PRECEDING) AS run, sum(power) OVER (PARTITION BY vec_id) AS total FROM p)
SELECT vec_id, min(freq) AS edge FROM q WHERE run >= 0.9 * total GROUP BY 1""")
def spectral_edge(spark, d):
    return spectral.spectral_edge(_power(spark, d), "vec_id", "power", FS / N).select("vec_id", "edge")


WELCH = f"""{E}, seg AS (SELECT vec_id, CAST(k AS INT) AS k, CAST(t AS INT) AS t, CAST(embedding[k * 16 + t + 1] AS DOUBLE) AS x FROM e, range(0, 3) a(k), range(0, 32) b(t)),
c AS (SELECT vec_id, k, t, (x - avg(x) OVER (PARTITION BY vec_id, k)) * (0.5 - 0.5 * cos(2 * pi() * t / 32)) AS x FROM seg),
p AS (SELECT vec_id, k, CAST(f AS INT) AS bin, sum(x * cos(2 * pi() * f * t / 32)) AS re, sum(x * sin(2 * pi() * f * t / 32)) AS im FROM c, range(0, 17) r(f) GROUP BY ALL),
dn AS (SELECT vec_id, bin, avg(re * re + im * im) * CASE WHEN bin IN (0, 16) THEN 1 ELSE 2 END / ({FS!r} * 12) AS density FROM p GROUP BY vec_id, bin)"""


@query(f"WITH {WELCH} SELECT vec_id, bin, round(density, 6) + 0.0 AS density FROM dn")
def welch_psd(spark, d):
    out = spectral.welch(trials(spark, d), "embedding", FS, 32, N)
    return out.select("vec_id", F.posexplode("psd").alias("bin", "density")).select("vec_id", "bin", r6("density"))


_EMOTION = ", ".join(f"('{name}', {low}::DOUBLE, {high}::DOUBLE)" for name, low, high in spectral.BANDS_EMOTION)


@query(f"""WITH {E}, b(band, low, high) AS (VALUES {_EMOTION}), r AS (SELECT vec_id, 40.0::DOUBLE + 15 * session AS fs FROM e),
k AS (SELECT fs, 'kept' AS rule, band, low, high FROM r, b WHERE high <= 0.99 * fs / 2 UNION ALL SELECT fs, 'clamped', band, low, least(high, fs / 2 - 2) FROM r, b WHERE least(high, fs / 2 - 2) > low)
SELECT fs, rule, band, low, high, count(*) AS recordings FROM k GROUP BY ALL""")
def nyquist_bands(spark, d):
    """Sessions were sampled at 40, 55 and 70 Hz: the bands that each trial's rate can tell, whole or cut."""
    rows = trials(spark, d).select("vec_id", (40.0 + 15 * F.col("session")).alias("fs"))
    rules = {"kept": spectral.valid_bands(spectral.BANDS_EMOTION, F.col("fs")), "clamped": spectral.cut_bands(spectral.BANDS_EMOTION, F.col("fs"))}
    one = lambda name: rows.select("fs", F.lit(name).alias("rule"), F.inline(rules[name]))
    return one("kept").unionByName(one("clamped")).groupBy("fs", "rule", "band", "low", "high").agg(F.count(F.lit(1)).alias("recordings"))


def _sides_sql(pairs, channels, bands):
    named = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(pairs))
    at = lambda side: f"CAST(embedding[band * {channels} + {side} + 1] AS DOUBLE)"
    return f"{E}, pr(pair, a, b) AS (VALUES {named}), s AS (SELECT vec_id, CAST(band AS INT) AS band, CAST(pair AS INT) AS pair, {at('a')} AS l, {at('b')} AS r FROM e, pr, range(0, {bands}) x(band))"


#: The ten pairs need 21 channels, so a vector holds three bands of them; the 27 pairs need 62, so one.
TEN = list(zip(features.LEFT, features.RIGHT))
_SIDES, _SIDES62 = _sides_sql(TEN, 21, 3), _sides_sql(features.PAIRS27, 62, 1)


def _sides(spark, d):
    return features.asymmetry(trials(spark, d), "embedding", TEN, 21, 3)


@query(f"WITH {_SIDES} SELECT vec_id, band, pair, round(r - l, 6) + 0.0 AS rasm FROM s")
def asymmetry_difference(spark, d):
    return _sides(spark, d).select("vec_id", "band", "pair", r6(features.difference_right_left(F.col("l"), F.col("r")), "rasm"))


@query(f"WITH {_SIDES} SELECT vec_id, band, pair, CASE WHEN r + 1e-6 = 0 THEN 0.0 ELSE round(l / (r + 1e-6), 6) + 0.0 END AS ratio FROM s")
def asymmetry_ratio(spark, d):
    return _sides(spark, d).select("vec_id", "band", "pair", r6(features.ratio_left_right(F.col("l"), F.col("r")), "ratio"))


@query(f"WITH {_SIDES62} SELECT vec_id, band, pair, round(least(greatest(l - r, -500), 500), 6) + 0.0 AS dasm, round(least(greatest(CASE WHEN r + 1e-8 = 0 THEN 0.0 ELSE l / (r + 1e-8) END, -500), 500), 6) + 0.0 AS rasm FROM s")
def asymmetry_clipped(spark, d):
    ratio = features.ratio_left_right(F.col("l"), F.col("r"), 1e-8)
    return features.asymmetry(trials(spark, d), "embedding", features.PAIRS27, 62, 1).select("vec_id", "band", "pair", r6(features.clip(F.col("l") - F.col("r"), -500.0, 500.0), "dasm"), r6(features.clip(ratio, -500.0, 500.0), "rasm"))


@query(f"WITH {L} SELECT vec_id, CAST(feature_idx // 8 AS INT) AS channel, round(avg(value), 6) + 0.0 AS mean FROM l GROUP BY ALL")
def channel_means(spark, d):
    """The last resort among features: each channel's mean, within the row."""
    means = F.array(*[windows.mean_of(F.slice("embedding", 1 + 8 * c, 8)) for c in range(8)])
    return trials(spark, d).select("vec_id", F.posexplode(means).alias("channel", "v")).select("vec_id", "channel", r6("v", "mean"))


@query("""
WITH f AS (SELECT user_id, avg(value) AS m, stddev_pop(value) AS s, avg(value * value) AS m2, avg(value * value * value) AS m3, kurtosis_pop(value) AS k,
  median(value) AS med, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.75) AS p75, max(value) - min(value) AS ptp FROM events GROUP BY 1)
SELECT user_id, round(m, 6) AS mean, round(s, 6) AS std, CASE WHEN s > 0 THEN round((m3 - 3 * m * m2 + 2 * m * m * m) / (s * s * s), 6) + 0.0 END AS skew, round(k, 6) + 0.0 AS kurt,
  round(med, 6) AS median, round(p25, 6) AS p25, round(p75, 6) AS p75, round(ptp, 6) AS ptp FROM f""")
def moments_wide(spark, d):
    rows = _series(spark, d).select("user_id", F.col("value"))
    out = rows.groupBy("user_id").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.skewness("value").alias("skew"), F.kurtosis("value").alias("kurt"), (F.max("value") - F.min("value")).alias("ptp"))
    ranks = scaling.exact_quantiles(rows, ["user_id"], [0.25, 0.5, 0.75])
    out = out.join(ranks, "user_id").select("user_id", "mean", "std", "skew", "kurt", F.col("q")[1].alias("median"), F.col("q")[0].alias("p25"), F.col("q")[2].alias("p75"), "ptp")
    return out.select("user_id", *[r6(c) for c in out.columns[1:]])


@query("""
WITH g AS (SELECT user_id, min(value) AS lo, max(value) AS hi, count(value) AS n FROM events GROUP BY 1),
w AS (SELECT user_id, n, CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo, CASE WHEN lo = hi THEN 0.1 ELSE (hi - lo) / 10 END AS width FROM g),
c AS (SELECT user_id, n, width, least(floor((value - lo) / width), 9) AS bin, count(*) AS c FROM events JOIN w USING (user_id) GROUP BY ALL)
SELECT user_id, round(-sum(c / (n * width) * ln(c / (n * width))), 6) + 0.0 AS entropy FROM c GROUP BY 1""")
def histogram_entropy(spark, d):
    return features.histogram_entropy(_series(spark, d).select("user_id", "value"), ["user_id"], "value").select("user_id", r6("entropy"))


@query(f"""
WITH {L}, a AS (SELECT vec_id, feature_idx // 16 AS c, feature_idx % 16 AS t, value FROM l), p AS (
  SELECT x.vec_id, CAST(x.c AS INT) AS c1, CAST(y.c AS INT) AS c2, avg(x.value * y.value) - avg(x.value) * avg(y.value) AS cov, var_pop(x.value) AS vx, var_pop(y.value) AS vy
  FROM a x JOIN a y ON x.vec_id = y.vec_id AND x.t = y.t AND x.c < y.c GROUP BY ALL)
SELECT vec_id, c1, c2, CASE WHEN vx <= 1e-18 OR vy <= 1e-18 THEN 0.0 ELSE round(cov / sqrt(vx * vy), 6) + 0.0 END AS corr FROM p""")
def channel_correlation(spark, d):
    return features.channel_correlation(trials(spark, d), "vec_id", "embedding", 4, 16).select("vec_id", "c1", "c2", r6("corr"))


@query(f"""
WITH {L} SELECT vec_id, feature_idx, CASE WHEN vec_id % 7 = 0 THEN -10.0 WHEN vec_id % 11 = 0 THEN 10.0 WHEN vec_id % 13 = 0 THEN -10.0 ELSE round(value, 6) + 0.0 END AS clean FROM l""")
def clean_nonfinite(spark, d):
    """Rows get NaN and infinities by their id, then cleaning to constants."""
    x = F.when(F.col("vec_id") % 7 == 0, float("nan")).when(F.col("vec_id") % 11 == 0, float("inf")).when(F.col("vec_id") % 13 == 0, float("-inf")).otherwise(F.col("v").cast("double"))
    rows = trials(spark, d).select("vec_id", F.posexplode("embedding").alias("feature_idx", "v"))
    return rows.select("vec_id", "feature_idx", r6(features.finite_or(x, -10.0, -10.0, 10.0), "clean"))


@query(f"""
WITH {L} SELECT vec_id, CAST(feature_idx // 16 AS INT) AS band, CAST(feature_idx % 16 AS INT) AS channel, CAST(feature_idx % 4 AS INT) AS band_minor, CAST(feature_idx // 4 AS INT) AS channel_major, round(value, 6) + 0.0 AS value FROM l""")
def reshape_band_channel(spark, d):
    rows = features.unflatten(trials(spark, d).select("vec_id", "embedding"), "embedding", 16, 4)
    minor, major = features.layout(F.col("feature_idx"), 16, 4, band_major=False)
    return rows.select("vec_id", "band", "channel", minor.alias("band_minor"), major.alias("channel_major"), r6(F.col("value").cast("double"), "value"))

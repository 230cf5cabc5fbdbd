"""Registered queries of the recording operators, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import beats, blocks, calcium, groups, images, motion, pairs, pixels, selection, signals
from ..streaming import hourly as streaming
from . import bridges as B
from . import image_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles to so many digits; minus zero becomes zero."""
    return df.select(*[(F.round(F.col(f"`{c}`"), digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in df.dtypes])


def smoothed_sql(table: str, windows: str) -> str:
    """smoothed(recording_id, idx, s): a cubic fit over ``w`` samples of ``windows`` (recording_id, w), with the fit's hat matrices as values."""
    hats = ", ".join(f"({w}, {r}, {j}, {h!r}::DOUBLE)" for w in range(5, 17, 2) for r, row in enumerate(signals.cubic_fit(w).tolist()) for j, h in enumerate(row))
    return f"""hat(w, r, j, h) AS (VALUES {hats}),
placed AS (
  SELECT t.recording_id, idx, w.w, CASE WHEN idx < w.w // 2 THEN idx WHEN idx >= n - w.w // 2 THEN w.w - n + idx ELSE w.w // 2 END AS r,
         CASE WHEN idx < w.w // 2 THEN 0 WHEN idx >= n - w.w // 2 THEN n - w.w ELSE idx - w.w // 2 END AS lo
  FROM {table} t JOIN {windows} w ON w.recording_id = t.recording_id JOIN (SELECT recording_id, count(*) AS n FROM {table} GROUP BY ALL) c ON c.recording_id = t.recording_id),
smoothed AS (
  SELECT p.recording_id, p.idx, sum(h * x.raw) AS s FROM placed p JOIN hat ON hat.w = p.w AND hat.r = p.r JOIN {table} x ON x.recording_id = p.recording_id AND x.idx = p.lo + j GROUP BY ALL)"""


def peaked_sql(prominence: float) -> str:
    """mx: peaks of ``sig``, thinned to the distance in ``tuned`` (recording_id, distance), that stand out by a part of the signal's range; needs WITH RECURSIVE."""
    return f"""{B.TOPS_SQL.replace("mx AS", "tops AS")},
ordered AS MATERIALIZED (
  SELECT t.recording_id, idx, v, distance, row_number() OVER (PARTITION BY t.recording_id ORDER BY v DESC, idx DESC) AS n, count(*) OVER (PARTITION BY t.recording_id) AS last FROM tops t JOIN tuned ON tuned.recording_id = t.recording_id),
walk AS (
  SELECT recording_id, n, last, [idx] AS kept FROM ordered WHERE n = 1
  UNION ALL
  SELECT o.recording_id, o.n, o.last, CASE WHEN len(list_filter(w.kept, lambda k: abs(k - o.idx) < o.distance)) = 0 THEN list_append(w.kept, o.idx) ELSE w.kept END
  FROM walk w JOIN ordered o ON o.recording_id = w.recording_id AND o.n = w.n + 1),
thin AS (SELECT w.recording_id, w.idx, o.v FROM (SELECT recording_id, unnest(kept) AS idx FROM walk WHERE n = last) w JOIN ordered o ON o.recording_id = w.recording_id AND o.idx = w.idx),
bounds AS (SELECT m.recording_id, m.idx, m.v, max(s.idx) FILTER (WHERE s.raw > m.v AND s.idx < m.idx) AS lo, min(s.idx) FILTER (WHERE s.raw > m.v AND s.idx > m.idx) AS hi FROM thin m JOIN sig s ON s.recording_id = m.recording_id GROUP BY ALL),
sides AS (SELECT b.recording_id, b.idx, b.v, min(s.raw) FILTER (WHERE s.idx <= b.idx) AS l, min(s.raw) FILTER (WHERE s.idx >= b.idx) AS r FROM bounds b JOIN sig s ON s.recording_id = b.recording_id AND s.idx > coalesce(lo, -1) AND s.idx < coalesce(hi, 1000000000) GROUP BY ALL),
mx AS MATERIALIZED (SELECT s.recording_id, idx, v FROM sides s JOIN (SELECT recording_id, max(raw) - min(raw) AS range FROM sig GROUP BY ALL) g ON g.recording_id = s.recording_id WHERE v - greatest(l, r) >= greatest({prominence} * range, 1e-9))"""


def consecutive_beats_sql(table: str) -> str:
    """sig and mx of the frame-to-frame differences of ``table`` (recording_id, frame_idx, pos, v), tuned to their period."""
    return f"""
raws AS MATERIALIZED (SELECT y.recording_id, CAST(x.frame_idx AS INTEGER) AS idx, avg(abs(y.v - x.v)) AS raw FROM {table} x JOIN {table} y ON x.recording_id = y.recording_id AND x.pos = y.pos AND y.frame_idx = x.frame_idx + 1 GROUP BY ALL),
c AS (SELECT recording_id, idx, raw - avg(raw) OVER (PARTITION BY recording_id) AS c FROM raws),
power AS (SELECT recording_id, sum(c * c) AS p FROM c GROUP BY ALL),
r AS (SELECT x.recording_id, y.idx - x.idx AS lag, sum(x.c * y.c) / any_value(p) AS r FROM c x JOIN c y ON x.recording_id = y.recording_id AND y.idx - x.idx BETWEEN 9 AND 120 JOIN power ON power.recording_id = x.recording_id GROUP BY ALL),
period AS MATERIALIZED (SELECT recording_id, first(lag ORDER BY round(r, 12) DESC, lag) / 30.0 AS period FROM r GROUP BY ALL),
told AS (SELECT recording_id, period, least(greatest(period / 6, 0.05), 0.5) AS window_s, least(greatest(100 / period, 30), 400) AS gap FROM period),
chosen AS (SELECT *, CAST(greatest(round_even(window_s * 30, 0), 5) AS INTEGER) AS w FROM told),
tuned AS MATERIALIZED (SELECT * REPLACE (w + CAST(w % 2 = 0 AS INTEGER) AS w), greatest(round_even(60.0 / gap * 30, 0), 1) AS distance FROM chosen),
{smoothed_sql("raws", "tuned")},
sig AS MATERIALIZED (SELECT recording_id, idx, s AS raw FROM smoothed),{peaked_sql(0.15)}"""


def normal_p_sql(z: str) -> str:
    """Two-sided normal p by the series of the error function whose terms are all positive."""
    x = f"greatest(abs({z}) / sqrt(2), 1e-300)"
    term = f"exp((2 * k + 1) * ln({x}) + 2 * k * ln(2) + lgamma(k + 1) - lgamma(2 * k + 2))"
    return f"greatest(1 - 2 / sqrt(pi()) * exp(-({x}) * ({x})) * list_sum(list_transform(range(0, 300), lambda k: {term})), 0)"


def student_p_sql(r: str, n: str) -> str:
    """Two-sided p of a correlation over n pairs, by the finite series of Student's t for even and for odd degrees of freedom."""
    even = f"abs({r}) * list_sum(list_transform(range(0, ({n} - 2) // 2), lambda k: exp(lgamma(2 * k + 1) - 2 * lgamma(k + 1) - k * ln(4) + k * ln(1 - {r} * {r}))))"
    odd = f"2 / pi() * (asin(abs({r})) + abs({r}) * sqrt(1 - {r} * {r}) * coalesce(list_sum(list_transform(range(0, ({n} - 3) // 2), lambda k: exp((2 * k + 1) * ln(2) + lgamma(k + 1) + lgamma(k + 2) - lgamma(2 * k + 3) + k * ln(1 - {r} * {r})))), 0))"
    return f"CASE WHEN abs({r}) >= 1 THEN 0 WHEN {n} % 2 = 0 THEN greatest(1 - {even}, 0) ELSE greatest(1 - {odd}, 0) END"


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return register


# --- frames


@query(f"WITH {B.PIXELS_SQL} SELECT recording_id, frame_idx AS idx, round(avg(v), 6) AS raw FROM px GROUP BY ALL")
def frame_mean_intensity(spark, d):
    return pixels.intensity(B.frames(spark, d)).drop("fps")


@query(f"WITH {B.PIXELS_SQL} SELECT recording_id, frame_idx AS idx, round(avg(v), 6) AS raw FROM px WHERE pos % 8 BETWEEN 2 AND 5 AND pos // 8 BETWEEN 1 AND 4 GROUP BY ALL")
def roi_crop_mean(spark, d):
    return pixels.intensity(pixels.crop(B.frames(spark, d), 2, 1, 4, 4)).drop("fps")


@query(f"WITH {B.PIXELS_SQL} SELECT recording_id, CAST(pos AS INTEGER) AS pos, round(max(v), 6) AS v FROM px GROUP BY ALL")
def max_projection(spark, d):
    return pixels.max_projection(B.frames(spark, d))


@query(f"WITH {B.PIXELS_SQL} SELECT y.recording_id, x.frame_idx AS idx, round(avg(abs(y.v - x.v)), 6) AS raw FROM px x JOIN px y ON x.recording_id = y.recording_id AND x.pos = y.pos AND y.frame_idx = x.frame_idx + 1 GROUP BY ALL")
def consecutive_diff_signal(spark, d):
    return pixels.consecutive_signal(B.frames(spark, d)).drop("fps")


@query(f"WITH {B.PIXELS_SQL} SELECT y.recording_id, y.frame_idx AS idx, round(avg(abs(y.v - x.v)), 6) AS raw FROM px x JOIN px y ON x.recording_id = y.recording_id AND x.pos = y.pos AND x.frame_idx = 0 GROUP BY ALL")
def reference_diff_signal(spark, d):
    return beats.motion_signal(B.frames(spark, d), beats.BeatParams(reference_index=0))[0].drop("fps")


@query(f"""WITH {B.PIXELS_SQL},
moved AS (SELECT y.recording_id, x.frame_idx AS idx, avg(abs(y.v - x.v)) AS raw FROM px x JOIN px y ON x.recording_id = y.recording_id AND x.pos = y.pos AND y.frame_idx = x.frame_idx + 1 GROUP BY ALL),
nine AS (SELECT DISTINCT recording_id, 9 AS w FROM moved),
{smoothed_sql("moved", "nine")},
inner_part AS (SELECT recording_id, idx, s, count(*) OVER (PARTITION BY recording_id) AS n FROM smoothed)
SELECT recording_id, CAST(first(idx ORDER BY s, idx) AS INTEGER) AS reference_index FROM inner_part
WHERE idx >= greatest(round_even(0.03 * n, 0), 2) AND idx < n - greatest(round_even(0.03 * n, 0), 2) GROUP BY ALL""")
def pick_reference(spark, d):
    return beats.reference_frames(B.frames(spark, d))


@query(f"""WITH {B.PIXELS_SQL}, m AS (SELECT recording_id, frame_idx AS idx, avg(v) AS raw FROM px GROUP BY ALL),
f AS (SELECT recording_id, greatest(quantile_cont(raw, 0.1), 1e-6) AS f0 FROM m GROUP BY ALL)
SELECT recording_id, idx, round(f0, 6) AS f0, round((raw - f0) / f0, 3) AS df_f0 FROM m JOIN f USING (recording_id)""")
def df_f0(spark, d):
    return calcium.df_f0(pixels.intensity(B.frames(spark, d))).select("recording_id", "idx", "f0", F.round("df_f0", 3).alias("df_f0"))


# --- signals

_LAGS = f"""{B.SIGNAL_SQL}, c AS (SELECT recording_id, idx, raw - avg(raw) OVER (PARTITION BY recording_id) AS c FROM sig),
power AS (SELECT recording_id, sum(c * c) AS p FROM c GROUP BY ALL),
r AS (SELECT x.recording_id, y.idx - x.idx AS lag, sum(x.c * y.c) / any_value(p) AS r FROM c x JOIN c y ON x.recording_id = y.recording_id AND y.idx - x.idx BETWEEN 9 AND 120 JOIN power ON power.recording_id = x.recording_id GROUP BY ALL),
period AS (SELECT recording_id, first(lag ORDER BY round(r, 12) DESC, lag) / 30.0 AS period FROM r GROUP BY ALL)"""


@query(f"WITH {_LAGS} SELECT recording_id, lag, round(r, 6) AS r FROM r")
def autocorr_band(spark, d):
    return signals.autocorrelation(B.signal(spark, d), 9, 120)


@query(f"WITH {_LAGS} SELECT recording_id, round(period, 6) AS period FROM period")
def dominant_period(spark, d):
    return signals.pack(B.signal(spark, d)).select("recording_id", signals.dominant_period("values", "fps").alias("period"))


@query(f"WITH {_LAGS} SELECT recording_id, round(least(greatest(period / 6, 0.05), 0.5), 6) AS window_s, round(least(greatest(100 / period, 30), 400), 6) AS gap FROM period")
def auto_tune(spark, d):
    return beats.tuned(signals.pack(B.signal(spark, d))).select("recording_id", "window_s", "gap")


@query(f"""WITH {B.SIGNAL_SQL}, w AS (SELECT recording_id, idx, (-3 * lag(raw, 2) OVER o + 12 * lag(raw) OVER o + 17 * raw + 12 * lead(raw) OVER o - 3 * lead(raw, 2) OVER o) / 35.0 AS smoothed FROM sig WINDOW o AS (PARTITION BY recording_id ORDER BY idx))
SELECT recording_id, idx, round(smoothed, 6) AS smoothed FROM w WHERE smoothed IS NOT NULL""")
def savgol_interior(spark, d):
    packed = signals.pack(B.signal(spark, d)).withColumn("values", signals.smooth("values", "fps", F.lit(0.15)))
    last = packed.select("recording_id", F.size("values").alias("n"))
    return signals.unpack(packed, "smoothed").join(last, "recording_id").where("idx >= 2 and idx < n - 2").drop("n", "fps")


@query(f"""WITH {_LAGS},
chosen AS (SELECT recording_id, CAST(greatest(round_even(least(greatest(period / 6, 0.05), 0.5) * 30, 0), 5) AS INTEGER) AS w FROM period),
tuned AS (SELECT recording_id, w + CAST(w % 2 = 0 AS INTEGER) AS w FROM chosen),
{smoothed_sql("sig", "tuned")}
SELECT recording_id, idx, round(s, 6) + 0.0 AS smoothed FROM smoothed""")
def smooth_full(spark, d):
    return signals.unpack(beats.tuned(signals.pack(B.signal(spark, d))).withColumn("values", F.col("smoothed")), "smoothed").drop("fps")


@query(f"WITH {B.MAXIMA_SQL} SELECT recording_id, idx, round(v, 6) AS v FROM mx")
def local_maxima(spark, d):
    return signals.maxima(B.signal(spark, d))


@query(f"""WITH {B.MAXIMA_SQL},
bounds AS (SELECT m.recording_id, m.idx, m.v, max(s.idx) FILTER (WHERE s.raw > m.v AND s.idx < m.idx) AS lo, min(s.idx) FILTER (WHERE s.raw > m.v AND s.idx > m.idx) AS hi FROM mx m JOIN sig s USING (recording_id) GROUP BY ALL),
sides AS (SELECT b.recording_id, b.idx, b.v, min(s.raw) FILTER (WHERE s.idx <= b.idx) AS l, min(s.raw) FILTER (WHERE s.idx >= b.idx) AS r FROM bounds b JOIN sig s ON s.recording_id = b.recording_id AND s.idx > coalesce(lo, -1) AND s.idx < coalesce(hi, 1000000000) GROUP BY ALL)
SELECT recording_id, idx, round(v, 6) AS v, round(v - greatest(l, r), 6) AS prominence FROM sides""")
def peak_prominence(spark, d):
    return signals.peak_prominence(B.signal(spark, d))


@query(f"""WITH RECURSIVE {B.MAXIMA_SQL},
ordered AS MATERIALIZED (SELECT recording_id, idx, row_number() OVER (PARTITION BY recording_id ORDER BY v DESC, idx DESC) AS n, count(*) OVER (PARTITION BY recording_id) AS last FROM mx),
walk AS (
  SELECT recording_id, n, last, [idx] AS kept FROM ordered WHERE n = 1
  UNION ALL
  SELECT o.recording_id, o.n, o.last, CASE WHEN len(list_filter(w.kept, lambda k: abs(k - o.idx) < 12)) = 0 THEN list_append(w.kept, o.idx) ELSE w.kept END
  FROM walk w JOIN ordered o ON o.recording_id = w.recording_id AND o.n = w.n + 1)
SELECT recording_id, unnest(kept) AS idx FROM walk WHERE n = last""")
def peaks_min_distance(spark, d):
    return signals.thinned(signals.maxima(B.signal(spark, d)), 12)


def _peaked(spark, d) -> DataFrame:
    found = signals.maxima(B.signal(spark, d)).groupBy("recording_id").agg(F.sort_array(F.collect_list("idx")).alias("peaks"))
    return signals.pack(B.signal(spark, d)).join(found, "recording_id")


_BEAT = ("contraction_start_time_s", "peak_time_s", "relaxation_end_time_s", "amplitude", "contraction_time_s", "relaxation_time_s", "max_contraction_velocity", "max_relaxation_velocity", "time_to_decay_10_s", "time_to_decay_50_s", "time_to_decay_90_s", "inter_beat_interval_s", "instantaneous_bpm")


@query(f"WITH {B.BEATS_SQL} SELECT recording_id, CAST(beat_index AS INTEGER) AS beat_index, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in _BEAT)} FROM beats")
def beat_table(spark, d):
    return beats.beat_table(_peaked(spark, d), "values")


@query(f"""WITH {B.BEATS_SQL}
SELECT recording_id, round(any_value(n) / 30.0, 6) AS duration_s, CAST(count(beat_index) AS INTEGER) AS n_beats, round(60.0 / avg(inter_beat_interval_s), 6) AS mean_bpm, round(avg(inter_beat_interval_s), 6) AS mean_inter_beat_interval_s,
round(stddev_pop(inter_beat_interval_s), 6) AS ibi_std_s, round(100 * stddev_pop(inter_beat_interval_s) / avg(inter_beat_interval_s), 6) AS ibi_cv_percent, round(100 * stddev_pop(amplitude) / avg(amplitude), 6) AS amplitude_cv_percent,
{', '.join(f'round(avg({c}), 6) AS mean_{c}' for c in beats.MEANS)} FROM beats JOIN (SELECT recording_id, count(*) AS n FROM sig GROUP BY ALL) USING (recording_id) GROUP BY ALL""")
def beat_summary(spark, d):
    packed = _peaked(spark, d)
    return beats.beat_summary(packed, beats.beat_table(packed, "values"))


@query(f"WITH {B.BEATS_SQL} SELECT recording_id, CAST(beat_index AS INTEGER) AS beat_index, round(time_to_decay_10_s, 6) AS t10, round(time_to_decay_50_s, 6) AS t50, round(time_to_decay_90_s, 6) AS t90 FROM beats")
def decay_times(spark, d):
    return beats.beat_table(_peaked(spark, d), "values").select("recording_id", "beat_index", F.col("time_to_decay_10_s").alias("t10"), F.col("time_to_decay_50_s").alias("t50"), F.col("time_to_decay_90_s").alias("t90"))


@query(f"""WITH {B.BEATS_SQL},
up AS (SELECT e.recording_id, no, min(s.idx) FILTER (WHERE s.raw >= vb + 0.1::DOUBLE * (v - vb)) AS lo, min(s.idx) FILTER (WHERE s.raw >= vb + 0.9::DOUBLE * (v - vb)) AS hi, any_value(v - vb) AS amplitude
FROM ends e JOIN sig s ON s.recording_id = e.recording_id AND s.idx BETWEEN before AND peak GROUP BY ALL)
SELECT recording_id, CAST(no AS INTEGER) AS transient_index, round(amplitude, 6) AS amplitude_df_f0, CASE WHEN amplitude > 0 THEN round((hi - lo) / 30.0, 6) END AS rise_time_10_90_s FROM up""")
def rise_time(spark, d):
    return calcium.transient_table(_peaked(spark, d), "values").select("recording_id", "transient_index", "amplitude_df_f0", "rise_time_10_90_s")


@query()
def decay_tau(spark, d):
    return calcium.transient_table(_peaked(spark, d), "values").select("recording_id", "transient_index", "decay_tau_s")


# --- images

_OTSU = """h AS (SELECT {k}, {v} AS v, count(*) AS n FROM {t} GROUP BY ALL),
cut AS (SELECT *, sum(n) OVER o AS n0, sum(n * v) OVER o AS s0, sum(n) OVER g AS nn, sum(n * v) OVER g AS ss FROM h WINDOW o AS (PARTITION BY {k} ORDER BY v), g AS (PARTITION BY {k})),
th AS (SELECT {k}, first(v ORDER BY coalesce(n0::DOUBLE * (nn - n0) * pow(s0 / n0 - (ss - s0) / nullif(nn - n0, 0), 2), -1) DESC, v) AS threshold FROM cut GROUP BY ALL)"""


@query(f"WITH {B.BRIGHT_SQL}, {_OTSU.format(k='recording_id', v='v', t='bx')} SELECT recording_id, threshold FROM th")
def otsu_threshold(spark, d):
    long = B.bright_frames(spark, d).select("recording_id", F.explode("pixels").alias("v"))
    return pairs.otsu(pairs.histogram(long))


@query(f"""WITH {B.BRIGHT_SQL}, pj AS (SELECT recording_id, pos, max(v) AS v FROM bx GROUP BY ALL),
ab AS (SELECT x.recording_id AS k, x.v AS a, y.v AS b FROM pj x JOIN pj y ON x.pos = y.pos AND y.recording_id = x.recording_id + 1),
{_OTSU.format(k='recording_id', v='v', t='pj')},
t AS (SELECT ab.*, ta.threshold AS ta, tb.threshold AS tb FROM ab JOIN th ta ON ta.recording_id = k JOIN th tb ON tb.recording_id = k + 1)
SELECT k AS image_id, count(*) AS n_pixels, any_value(ta) AS threshold_a, any_value(tb) AS threshold_b, round(corr(a, b), 6) AS pearson_r, round(sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 6) AS manders_overlap_coefficient,
round(coalesce(sum(a) FILTER (WHERE b > tb), 0) / sum(a), 6) AS manders_m1, round(coalesce(sum(b) FILTER (WHERE a > ta), 0) / sum(b), 6) AS manders_m2,
round(avg(CAST(a > ta AS INT)), 6) AS fraction_a_positive, round(avg(CAST(b > tb AS INT)), 6) AS fraction_b_positive, round(avg(CAST(a > ta AND b > tb AS INT)), 6) AS fraction_both_positive FROM t GROUP BY k""")
def coloc_metrics(spark, d):
    p = pixels.max_projection(B.bright_frames(spark, d))
    a = p.select(F.col("recording_id").alias("image_id"), "pos", F.col("v").alias("a"))
    b = p.select((F.col("recording_id") - 1).alias("image_id"), "pos", F.col("v").alias("b"))
    return pairs.colocalization(a.join(b, ["image_id", "pos"]).select("image_id", "a", "b")).drop("pearson_p")


@query("""WITH s AS (SELECT event_type, count(*) AS n, sum(cos(2 * value)) AS c, sum(sin(2 * value)) AS s FROM events GROUP BY ALL)
SELECT event_type, n, round(sqrt(c * c + s * s) / n, 6) AS alignment_score, round(degrees(atan2(s, c) / 2), 6) AS mean_orientation_deg FROM s""")
def circular_alignment(spark, d):
    rows = B.table(spark, d, "events").select("event_type", F.col("value").alias("theta"), F.lit(1.0).alias("weight"))
    return pairs.circular_alignment(rows, by=("event_type",))


def _vectors(spark, d) -> DataFrame:
    e = B.table(spark, d, "embeddings").select(F.col("label").alias("recording_id"), *[F.get("embedding", F.lit(k)).cast("double").alias(c) for k, c in enumerate("zyx")])
    norm = F.sqrt(F.col("z") * F.col("z") + F.col("y") * F.col("y") + F.col("x") * F.col("x"))
    return e.withColumn("_n", norm).where("_n > 0").select("recording_id", *[(F.col(c) / F.col("_n")).alias(c) for c in "zyx"], F.lit(1.0).alias("weight"))


_Q = """v AS (SELECT label AS recording_id, embedding[1]::DOUBLE AS z, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS x FROM embeddings),
u AS (SELECT recording_id, z / n AS z, y / n AS y, x / n AS x FROM (SELECT *, sqrt(z * z + y * y + x * x) AS n FROM v) WHERE n > 0),
q AS (SELECT recording_id, count(*) AS n, sum(3 * z * z - 1) / (2.0 * count(*)) AS q_zz, sum(3 * z * y) / (2.0 * count(*)) AS q_zy, sum(3 * z * x) / (2.0 * count(*)) AS q_zx,
sum(3 * y * y - 1) / (2.0 * count(*)) AS q_yy, sum(3 * y * x) / (2.0 * count(*)) AS q_yx, sum(3 * x * x - 1) / (2.0 * count(*)) AS q_xx FROM u GROUP BY ALL)"""


@query(f"WITH {_Q} SELECT recording_id, n, {', '.join(f'round(q_{k}, 6) + 0.0 AS q_{k}' for k in ('zz', 'zy', 'zx', 'yy', 'yx', 'xx'))} FROM q")
def nematic_q_tensor(spark, d):
    return pairs.nematic_tensor(_vectors(spark, d))


@query(f"""WITH {_Q}, m AS (SELECT *, (q_zz + q_yy + q_xx) / 3 AS mean FROM q),
p AS (SELECT *, sqrt((pow(q_zz - mean, 2) + pow(q_yy - mean, 2) + pow(q_xx - mean, 2) + 2 * (q_zy * q_zy + q_zx * q_zx + q_yx * q_yx)) / 6) AS p FROM m),
e AS (SELECT *, ((q_zz - mean) * ((q_yy - mean) * (q_xx - mean) - q_yx * q_yx) - q_zy * (q_zy * (q_xx - mean) - q_yx * q_zx) + q_zx * (q_zy * q_yx - (q_yy - mean) * q_zx)) / (2 * p * p * p) AS d FROM p)
SELECT recording_id, n, round(greatest(mean + 2 * p * cos(acos(least(greatest(d, -1), 1)) / 3), 0), 6) AS alignment_score_3d FROM e""")
def nematic_score(spark, d):
    return pairs.nematic_alignment(_vectors(spark, d)).drop("mean_direction_zyx")


@query(f"""WITH {B.BRIGHT_SQL}, g AS (SELECT unnest(generate_series(0, 2)) AS k),
w AS (SELECT recording_id, CAST(gr.k AS INTEGER) AS "row", CAST(gc.k AS INTEGER) AS col, stddev_pop(v) AS std FROM bx, g gr, g gc WHERE frame_idx = 0 AND pos // 8 BETWEEN 2 * gr.k AND 2 * gr.k + 3 AND pos % 8 BETWEEN 2 * gc.k AND 2 * gc.k + 3 GROUP BY ALL)
SELECT recording_id, 0 AS frame_idx, "row", col, round(std, 6) AS std FROM w""")
def window_texture(spark, d):
    return motion.texture(B.bright_frames(spark, d).where("frame_idx = 0"), 4, 2)


@query(f"""WITH {B.BRIGHT_SQL}, g AS (SELECT unnest(generate_series(0, 2)) AS k),
w AS (SELECT recording_id, gr.k AS r, gc.k AS c, stddev_pop(v) AS std FROM bx, g gr, g gc WHERE frame_idx = 0 AND pos // 8 BETWEEN 2 * gr.k AND 2 * gr.k + 3 AND pos % 8 BETWEEN 2 * gc.k AND 2 * gc.k + 3 GROUP BY ALL)
SELECT recording_id, round(median(std), 6) AS piv_median_window_std, median(std) < {motion.LEAST_TEXTURE} AS piv_low_texture_warning, CAST(count(*) AS INTEGER) AS piv_n_windows_total,
CAST(count(*) FILTER (WHERE std < {motion.LEAST_TEXTURE}) AS INTEGER) AS piv_n_low_texture_windows_masked FROM w GROUP BY ALL""")
def texture_summary(spark, d):
    return motion.texture_summary(B.bright_frames(spark, d).where("frame_idx = 0"), 4, 2)


@query(f'WITH {B.BRIGHT_SQL}, {image_sql.piv_sql()} SELECT recording_id, pair_idx, "row", col, x::DOUBLE AS x, y::DOUBLE AS y, round(u, 6) + 0.0 AS u, round(v, 6) + 0.0 AS v, usable FROM field')
def piv_field(spark, d):
    return motion.piv(B.bright_frames(spark, d), 4, 2).drop("fps")


@query(f"WITH {B.BRIGHT_SQL}, {image_sql.piv_sql()} SELECT recording_id, pair_idx AS idx, round(coalesce(avg(sqrt(u * u + v * v)) FILTER (WHERE usable), avg(sqrt(u * u + v * v))), 6) AS raw FROM field GROUP BY ALL")
def piv_signal(spark, d):
    return motion.motion_signal(B.bright_frames(spark, d), 4, 2).drop("fps")


@query(f"""WITH {B.BRIGHT_SQL}, pj AS (SELECT recording_id, pos, max(v) AS v FROM bx GROUP BY ALL), {image_sql.image_tensor_sql()}
SELECT recording_id, round(texture_alignment_score, 6) AS texture_alignment_score, round(texture_mean_orientation_deg, 6) + 0.0 AS texture_mean_orientation_deg, round(texture_mean_coherence, 6) AS texture_mean_coherence FROM texture""")
def structure_tensor(spark, d):
    return images.texture_2d(pixels.projected(B.bright_frames(spark, d)))


@query()
def object_table(spark, d):
    return images.morphology_2d(B.bright_frames(spark, d), least=2, distance=2)[0]


@query()
def object_summary(spark, d):
    return images.morphology_2d(B.bright_frames(spark, d), least=2, distance=2, texture=True)[1]


_REGION = ("eccentricity", "orientation", "major_axis_length", "minor_axis_length", "equivalent_diameter_area", "mean_intensity", '"centroid-0"', '"centroid-1"', "orientation_deg", "perimeter")
_OBJECTS = f"""WITH RECURSIVE {B.BRIGHT_SQL}, pj AS (SELECT recording_id, pos, max(v) AS v FROM bx GROUP BY ALL), {_OTSU.format(k="recording_id", v="v", t="pj")}, {image_sql.objects_sql(2)}"""


@query(f"{_OBJECTS} SELECT recording_id, CAST(label AS INTEGER) AS label, v AS p, 0 AS z, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x FROM lb")
def object_labels(spark, d):
    slices = pixels.projected(B.bright_frames(spark, d)).withColumn("frame_idx", F.lit(0))
    return blocks.label_rows(blocks.labelled(slices, 2, blocks.Shape(1, 4, 4, 2), True))


@query(f"{_OBJECTS}, {image_sql.REGIONS_SQL} SELECT recording_id, label, area, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in _REGION)} FROM regions")
def merged_objects(spark, d):
    return images.merged_objects_2d(pixels.projected(B.bright_frames(spark, d)), 2, blocks.Shape(1, 4, 4, 2))


@query(f"WITH {B.BRIGHT_SQL}, {image_sql.volume_tensor_sql()} SELECT recording_id, n, {', '.join(f'round({k}, 4) + 0.0 AS {k}' for k in ('w', 'zz', 'zy', 'zx', 'yy', 'yx', 'xx'))} FROM tensor_sums")
def volume_tensor(spark, d):
    return rounded(blocks.tensor_sums(B.bright_frames(spark, d), shape=blocks.Shape(16, 0, 0)), 4)


@query()
def volume_texture(spark, d):
    return blocks.texture_3d(B.bright_frames(spark, d))


@query(f"""WITH RECURSIVE {B.BRIGHT_SQL}, {image_sql.piv_sql()}, {consecutive_beats_sql("bx")},
strongest AS (SELECT m.recording_id, least(first(idx ORDER BY v DESC, idx), any_value(n) - 1) AS pair_idx FROM mx m JOIN (SELECT recording_id, count(*) AS n FROM sig GROUP BY ALL) k ON k.recording_id = m.recording_id GROUP BY ALL)
SELECT f.recording_id, f.pair_idx, "row", col, x::DOUBLE AS x, y::DOUBLE AS y, round(u, 6) + 0.0 AS u, round(v, 6) + 0.0 AS v, usable FROM field f JOIN strongest s ON s.recording_id = f.recording_id AND s.pair_idx = f.pair_idx""")
def representative_field(spark, d):
    frames = B.bright_frames(spark, d)
    packed = beats.beating(frames, beats.BeatParams(signal_mode="consecutive"))[0]
    return motion.piv(frames, 4, 2).drop("fps").join(beats.strongest_pair(packed), ["recording_id", "pair_idx"])


@query()
def volume_objects(spark, d):
    return images.morphology_3d(B.bright_frames(spark, d), least=4, distance=2)[0]


# --- pairs


_ICC = f"""{B.PAIRS_SQL}, g AS (SELECT *, (avg(a) OVER () + avg(b) OVER ()) / 2 AS g, count(*) OVER () AS n FROM pr),
ss AS (SELECT any_value(n)::DOUBLE AS n, 2 * sum(pow((a + b) / 2 - g, 2)) AS sr, sum(pow(a - g, 2) + pow(b - g, 2)) AS st, any_value(n) * (pow(avg(a) - any_value(g), 2) + pow(avg(b) - any_value(g), 2)) AS sc FROM g),
ms AS (SELECT n, sr / (n - 1) AS r, sc AS c, greatest((st - sr - sc) / (n - 1), 0) AS e FROM ss),
icc AS (SELECT (r - e) / (r + e + 2 * (c - e) / n) AS icc FROM ms)"""


_AGREEMENT = """count(*) AS n, round(corr(a, b), 6) AS pearson_r, round(any_value(icc), 6) AS icc_2_1, round(avg(a - b), 3) AS bland_altman_bias, round(stddev_samp(a - b), 3) AS bland_altman_sd_diff,
round(avg(a - b) - 1.96 * stddev_samp(a - b), 3) AS bland_altman_loa_lower, round(avg(a - b) + 1.96 * stddev_samp(a - b), 3) AS bland_altman_loa_upper,
round(regr_slope(b, a), 6) AS regression_slope, round(regr_intercept(b, a), 3) AS regression_intercept, round(regr_r2(b, a), 6) AS regression_r_squared"""
_RANKED = "r AS (SELECT pair_id, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM pr)"


def _thousandths(agreed: DataFrame) -> DataFrame:
    return agreed.withColumns({c: F.round(c, 3) for c in agreed.columns if c.startswith("bland") or c.endswith("intercept")})


@query(f"WITH {_ICC} SELECT pair_id, {_AGREEMENT} FROM pr, icc GROUP BY pair_id")
def agreement_core(spark, d):
    return _thousandths(pairs.agreement(B.pairs(spark, d), with_p=False, with_ranks=False))


@query(f"WITH {B.PAIRS_SQL}, {_RANKED} SELECT pair_id, round(corr(ra, rb), 6) AS spearman_r FROM r GROUP BY pair_id")
def agreement_spearman(spark, d):
    return pairs.spearman(B.pairs(spark, d))


@query(f"""WITH {_ICC}, {_RANKED}, sp AS (SELECT pair_id, corr(ra, rb) AS rs, count(*) AS k FROM r GROUP BY pair_id), pe AS (SELECT pair_id, corr(a, b) AS rp FROM pr GROUP BY pair_id),
ag AS (SELECT pair_id, {_AGREEMENT} FROM pr, icc GROUP BY pair_id)
SELECT ag.*, round(rs, 6) AS spearman_r, round({student_p_sql("rp", "k")}, 6) AS pearson_p, round({student_p_sql("rs", "k")}, 6) AS spearman_p FROM ag JOIN sp ON sp.pair_id = ag.pair_id JOIN pe ON pe.pair_id = ag.pair_id""")
def agreement_full(spark, d):
    return _thousandths(pairs.agreement(B.pairs(spark, d)))


@query(f"WITH {B.PAIRS_SQL} SELECT o_orderkey, round(a - b, 6) AS diff, round((a + b) / 2, 6) AS mean FROM pr")
def bland_altman_rows(spark, d):
    return pairs.bland_altman_rows(B.pairs(spark, d)).select("o_orderkey", "diff", "mean")


@query("""SELECT event_id, round(TRY_CAST(regexp_extract(props, '[0-9.]+') AS DOUBLE), 6) AS a, round(value, 6) AS b FROM events WHERE TRY_CAST(regexp_extract(props, '[0-9.]+') AS DOUBLE) IS NOT NULL AND value IS NOT NULL""")
def coerce_pairs(spark, d):
    rows = B.table(spark, d, "events").select("event_id", F.regexp_extract("props", "[0-9.]+", 0).alias("x"), F.col("value").alias("y"))
    return pairs.complete_pairs(rows, "x", "y").select("event_id", "a", "b")


@query(r"""WITH s AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[\n,]+')) AS x FROM documents), k AS (SELECT doc_id, regexp_replace(x, '^\s+|\s+$', '', 'g') AS x FROM s)
SELECT d.doc_id, count(k.x) AS n_labels, coalesce(sum(length(k.x)), 0)::BIGINT AS n_chars FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id AND k.x <> '' GROUP BY ALL""")
def label_parse(spark, d):
    found = B.table(spark, d, "documents").select("doc_id", F.coalesce(selection.label_list(F.col("text")), F.array().cast("array<string>")).alias("l"))
    return found.select("doc_id", F.size("l").cast("bigint").alias("n_labels"), F.aggregate("l", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)).alias("n_chars"))


# --- groups


@query(f"WITH {B.metrics_sql()} SELECT metric, group_idx::INTEGER AS group_idx, label, count(*) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std FROM me GROUP BY ALL")
def group_descriptive(spark, d):
    return groups.descriptive(B.metrics(spark, d))


@query("""WITH t AS (
SELECT 'customer ' || c_custkey AS recording_id, c_nationkey::DOUBLE AS nationkey, c_acctbal AS acctbal FROM customer
UNION ALL SELECT 'supplier ' || s_suppkey, s_nationkey::DOUBLE, s_acctbal FROM supplier)
SELECT recording_id, metric, round(value, 6) AS value FROM t UNPIVOT (value FOR metric IN (nationkey, acctbal))""")
def metric_unpivot(spark, d):
    def side(k: int, name: str):
        fields = {"group_idx": F.lit(k), "label": F.lit(name), "recording_id": F.concat(F.lit(name + " "), F.col(f"{name[0]}_{name[:4]}key")), "cluster": F.lit(None).cast("string")}
        return B.table(spark, d, name).select(*[v.alias(c) for c, v in fields.items()], F.col(f"{name[0]}_nationkey").alias("nationkey"), F.col(f"{name[0]}_acctbal").alias("acctbal"))

    return groups.unpivoted(side(0, "customer").unionByName(side(1, "supplier"))).select("recording_id", "metric", "value")


@query(f"""WITH {B.metrics_sql("parity")},
u AS (SELECT s.metric, n AS n1, total - n AS n2, rs - n * (n + 1) / 2 AS u, sqrt(n * (total - n) / 12 * ((total + 1) - ties / (total * (total - 1)))) AS sd FROM sums s JOIN tied USING (metric) WHERE group_idx = 0)
SELECT metric, n1::BIGINT AS n1, n2::BIGINT AS n2, round(u, 6) AS u, round((greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sd, 6) AS z FROM u""")
def mann_whitney_u(spark, d):
    return groups.mann_whitney(B.metrics(spark, d, "parity"), with_p=False)


@query(f"""WITH {B.metrics_sql()},
h AS (SELECT metric, count(*) AS groups, (12 / (any_value(total) * (any_value(total) + 1)) * sum(rs * rs / n) - 3 * (any_value(total) + 1)) / (1 - any_value(ties) / (pow(any_value(total), 3) - any_value(total))) AS h FROM sums JOIN tied USING (metric) GROUP BY ALL)
SELECT metric, groups, round(h, 6) AS h, round(exp(-h / 2) * (1 + h / 2), 6) AS p_value FROM h""")
def kruskal_wallis(spark, d):
    return groups.kruskal_wallis(B.metrics(spark, d))


@query(f"""WITH {B.metrics_sql()}
SELECT x.metric, x.label AS group_a, y.label AS group_b, round((x.rs / x.n - y.rs / y.n) / sqrt((total * (total + 1) / 12 - ties / (12 * (total - 1))) * (1 / x.n + 1 / y.n)), 6) + 0.0 AS z
FROM sums x JOIN sums y ON x.metric = y.metric AND x.group_idx < y.group_idx JOIN tied ON tied.metric = x.metric""")
def dunn_posthoc(spark, d):
    return groups.dunn(B.metrics(spark, d), with_p=False)


_DUNN = f"""{B.metrics_sql()},
dunn AS (SELECT x.metric, x.label AS group_a, y.label AS group_b, (x.rs / x.n - y.rs / y.n) / sqrt((total * (total + 1) / 12 - ties / (12 * (total - 1))) * (1 / x.n + 1 / y.n)) AS z
FROM sums x JOIN sums y ON x.metric = y.metric AND x.group_idx < y.group_idx JOIN tied ON tied.metric = x.metric),
tested AS (SELECT *, {normal_p_sql("z")} AS p, count(*) OVER (PARTITION BY metric) AS k FROM dunn)"""


@query(f"WITH {_DUNN} SELECT metric, group_a, group_b, round(z, 6) + 0.0 AS z, round(p, 6) AS p_value, round(least(p * k, 1), 6) AS p_value_bonferroni FROM tested")
def dunn_p_values(spark, d):
    return groups.dunn(B.metrics(spark, d))


@query(f"WITH {B.metrics_sql()} SELECT metric, group_idx::INTEGER AS group_idx, label, cluster, count(*) AS n, round(sum(value), 3) AS s1 FROM me GROUP BY ALL")
def lmm_sufficient_stats(spark, d):
    return groups.sufficient(B.metrics(spark, d)).drop("s2").withColumn("s1", F.round("s1", 3))


@query(f"""WITH {B.SIGNAL_SQL},
named AS (SELECT recording_id, (dense_rank() OVER (ORDER BY recording_id) - 1) % 2 AS g FROM (SELECT DISTINCT recording_id FROM sig)),
means AS (SELECT s.recording_id, any_value(g) AS g, count(*) AS n, avg(raw) AS m, var_pop(raw) * count(*) AS within FROM sig s JOIN named d ON d.recording_id = s.recording_id GROUP BY ALL),
sides AS (SELECT g, count(*) AS c, avg(m) AS mean, var_pop(m) * count(*) AS between FROM means GROUP BY ALL),
-- clusters of one size: the criterion is least at the moments, or at a ratio of 0
parts AS (SELECT any_value(n)::DOUBLE AS n, count(*) AS c, sum(within) AS within, any_value(n) * (SELECT sum(between) FROM sides) AS between FROM means),
fit AS (SELECT n, c, CASE WHEN between / (c - 2) > within / (c * (n - 1)) THEN within / (c * (n - 1)) ELSE (within + between) / (c * n - 2) END AS s2,
  greatest(between / (c - 2) / (within / (c * (n - 1))) - 1, 0) / n AS ratio FROM parts),
tested AS (SELECT b.mean - a.mean AS d, fit.c AS clusters, s2, ratio, (b.mean - a.mean) / sqrt(s2 * (1 + n * ratio) * (1.0 / (n * a.c) + 1.0 / (n * b.c))) AS z FROM fit, (SELECT * FROM sides WHERE g = 0) a, (SELECT * FROM sides WHERE g = 1) b)
SELECT 'raw' AS metric, true AS lmm_converged, CAST(clusters AS INTEGER) AS lmm_n_clusters, round(ratio * s2, 3) + 0.0 AS cluster_variance, round(s2, 3) AS residual_variance, 'even' AS group_a, 'odd' AS group_b, round(d, 4) AS coefficient, round({normal_p_sql("z")}, 6) AS p_value FROM tested""")
def lmm_balanced(spark, d):
    signal = B.signal(spark, d)
    # a handful of event types
    sides = signal.select("recording_id").distinct().withColumn("group_idx", (F.row_number().over(Window.orderBy("recording_id")) - 1) % 2)
    rows = signal.join(F.broadcast(sides), "recording_id").select(F.lit("raw").alias("metric"), "group_idx", F.when(F.col("group_idx") == 0, "even").otherwise("odd").alias("label"), F.concat_ws("-", "recording_id", "idx").alias("recording_id"), F.col("recording_id").alias("cluster"), F.col("raw").alias("value"))
    return groups.lmm_pairwise(rows).withColumns({"cluster_variance": F.round("cluster_variance", 3), "residual_variance": F.round("residual_variance", 3), "coefficient": F.round("coefficient", 4)})


@query()
def lmm_pairwise(spark, d):
    return groups.lmm_pairwise(B.metrics(spark, d))


@query(f"""WITH {_DUNN},
h AS (SELECT metric, (12 / (any_value(total) * (any_value(total) + 1)) * sum(rs * rs / n) - 3 * (any_value(total) + 1)) / (1 - any_value(ties) / (pow(any_value(total), 3) - any_value(total))) AS h FROM sums JOIN tied USING (metric) GROUP BY ALL),
d AS (SELECT metric, label, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS std FROM me GROUP BY ALL),
c AS (SELECT metric, CAST(count(DISTINCT cluster) AS INTEGER) AS k FROM me GROUP BY ALL)
SELECT t.metric, 'kruskal_wallis' AS test, round(h, 6) AS statistic, round(exp(-h / 2) * (1 + h / 2), 6) AS p_value, group_a, group_b, a.n AS n_a, b.n AS n_b, round(a.mean, 6) AS mean_a, round(b.mean, 6) AS mean_b,
round(a.std, 6) AS std_a, round(b.std, 6) AS std_b, round(z, 6) + 0.0 AS z, round(least(p * t.k, 1), 6) AS p_value_bonferroni, c.k AS lmm_n_clusters
FROM tested t JOIN h ON h.metric = t.metric JOIN c ON c.metric = t.metric JOIN d a ON a.metric = t.metric AND a.label = group_a JOIN d b ON b.metric = t.metric AND b.label = group_b""")
def compare_groups(spark, d):
    rows = groups.compare_groups(B.metrics(spark, d), 5).select("metric", "test", "statistic", "p_value", "groups", "lmm_n_clusters", F.explode("posthoc").alias("pair"))
    of = lambda k: F.filter("groups", lambda g: g["label"] == F.col(f"pair.group_{k}"))[0]
    sides = [of(k)[c].alias(f"{c}_{k}") for c in ("n", "mean", "std") for k in "ab"]
    return rows.select("metric", "test", "statistic", "p_value", "pair.group_a", "pair.group_b", *sides, "pair.z", "pair.p_value_bonferroni", "lmm_n_clusters")


@query("SELECT l_orderkey::VARCHAR AS metric, round(sum(l_tax), 6) AS p_value FROM lineitem GROUP BY l_orderkey ORDER BY sum(l_tax), metric LIMIT 12")
def topk_metrics(spark, d):
    sums = B.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("metric")).agg(F.round(F.sum("l_tax"), 6).alias("p_value"))
    return groups.top_metrics(sums)


# --- whole pipelines and streams


@query(f"""WITH RECURSIVE {B.PIXELS_SQL}, {consecutive_beats_sql("px")},{B.EVENTS_SQL}
SELECT k.recording_id, round(any_value(k.n) / 30.0, 6) AS duration_s, CAST(count(beat_index) AS INTEGER) AS n_beats, round(60.0 / avg(inter_beat_interval_s), 6) AS mean_bpm, round(avg(inter_beat_interval_s), 6) AS mean_inter_beat_interval_s,
round(stddev_pop(inter_beat_interval_s), 6) AS ibi_std_s, round(100 * stddev_pop(inter_beat_interval_s) / avg(inter_beat_interval_s), 6) AS ibi_cv_percent, round(100 * stddev_pop(amplitude) / avg(amplitude), 6) AS amplitude_cv_percent,
round(any_value(period), 6) AS estimated_period_s, round(any_value(window_s), 6) AS smoothing_window_s, round(any_value(gap), 6) AS min_bpm_gap_used, 'consecutive' AS signal_mode,
{', '.join(f'round(avg({c}), 6) AS mean_{c}' for c in beats.MEANS)}
FROM (SELECT recording_id, count(*) AS n FROM sig GROUP BY ALL) k JOIN tuned t ON t.recording_id = k.recording_id LEFT JOIN beats b ON b.recording_id = k.recording_id GROUP BY k.recording_id""")
def beating_pipeline(spark, d):
    return beats.beating(B.frames(spark, d), beats.BeatParams(signal_mode="consecutive"))[2]


_CALCIUM = f"""WITH RECURSIVE {B.BRIGHT_SQL}, lit AS (SELECT recording_id, CAST(frame_idx AS INTEGER) AS idx, avg(v) AS light FROM bx GROUP BY ALL),
f0 AS (SELECT recording_id, greatest(quantile_cont(light, 0.1), 1e-6) AS f0 FROM lit GROUP BY ALL),
changed AS MATERIALIZED (SELECT l.recording_id, idx, (light - f0) / f0 AS raw FROM lit l JOIN f0 ON f0.recording_id = l.recording_id),
tuned AS MATERIALIZED (SELECT recording_id, 5 AS w, 8 AS distance FROM f0),
{smoothed_sql("changed", "tuned")},
sig AS MATERIALIZED (SELECT recording_id, idx, s AS raw FROM smoothed),{peaked_sql(0.2)},{B.EVENTS_SQL},
risen AS (SELECT e.recording_id, no, min(s.idx) FILTER (WHERE s.raw >= vb + 0.1::DOUBLE * (v - vb)) AS lo, min(s.idx) FILTER (WHERE s.raw >= vb + 0.9::DOUBLE * (v - vb)) AS hi
  FROM ends e JOIN sig s ON s.recording_id = e.recording_id AND s.idx BETWEEN before AND peak GROUP BY ALL),
transients AS (SELECT e.recording_id, e.no AS transient_index, peak / 30.0 AS peak_time_s, v - vb AS amplitude_df_f0, CASE WHEN v > vb THEN (hi - lo) / 30.0 END AS rise_time_10_90_s, peak / 30.0 - previous / 30.0 AS inter_peak_interval_s
  FROM ends e JOIN risen r ON r.recording_id = e.recording_id AND r.no = e.no)"""


@query(f"""{_CALCIUM} SELECT recording_id, CAST(transient_index AS INTEGER) AS transient_index, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in ('peak_time_s', 'amplitude_df_f0', 'rise_time_10_90_s', 'inter_peak_interval_s'))} FROM transients""")
def calcium_events(spark, d):
    return calcium.calcium(B.bright_frames(spark, d))[1].drop("decay_tau_s")


@query(f"""{_CALCIUM} SELECT k.recording_id, round(any_value(k.n) / 30.0, 6) AS duration_s, CAST(count(transient_index) AS INTEGER) AS n_transients, round(avg(inter_peak_interval_s), 6) AS mean_inter_peak_interval_s,
round(avg(amplitude_df_f0), 6) AS mean_amplitude_df_f0, round(60.0 / avg(inter_peak_interval_s), 6) AS mean_frequency_per_min, round(100 * stddev_pop(amplitude_df_f0) / avg(amplitude_df_f0), 6) AS amplitude_cv_percent
FROM (SELECT recording_id, count(*) AS n FROM sig GROUP BY ALL) k LEFT JOIN transients t ON t.recording_id = k.recording_id GROUP BY k.recording_id""")
def calcium_summary(spark, d):
    return calcium.calcium(B.bright_frames(spark, d))[2].drop("mean_decay_tau_s")


@query()
def calcium_pipeline(spark, d):
    return calcium.calcium(B.bright_frames(spark, d))[2]


@query("SELECT event_type, epoch(date_trunc('hour', ts))::BIGINT AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def hourly_stream(spark, d):
    events = B.table(spark, d, "events").withColumn("ts", F.expr("timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts))"))
    return streaming.hourly(events).select("event_type", F.unix_timestamp("hour").alias("hour"), "n", F.round("total", 4).alias("total"))

"""The driver's tables seen as recordings, signals, pairs and groups; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FPS = 30.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 x 8 frames, one recording a label."""
    order = Window.partitionBy("label").orderBy("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("recording_id"), (F.row_number().over(order) - 1).alias("frame_idx"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.col("embedding").cast("array<double>").alias("pixels"), F.lit(FPS).alias("fps")
    )


def bright_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with whole pixel values 0..255."""
    return frames(spark, sf_dir).withColumn("pixels", F.transform("pixels", lambda e: F.floor((e + 1) * 127.5).cast("double")))


PIXELS_SQL = """
fr AS (SELECT label AS recording_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_idx, embedding::DOUBLE[] AS p FROM embeddings),
px AS (SELECT recording_id, frame_idx, unnest(p) AS v, generate_subscripts(p, 1) - 1 AS pos FROM fr)"""
BRIGHT_SQL = PIXELS_SQL + ",\nbx AS (SELECT recording_id, frame_idx, pos, floor((v + 1) * 127.5) AS v FROM px)"


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summed event values of each hour from the first to the last, 0 where there are none; one recording an event type."""
    hours = table(spark, sf_dir, "events").select(F.col("event_type").alias("recording_id"), F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ'2000-01-01 00:00:00', ts)").cast("int").alias("h"), "value")
    summed = hours.groupBy("recording_id", "h").agg(F.round(F.sum("value"), 2).alias("raw"))
    span = summed.agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    kinds = summed.select("recording_id").distinct()
    calendar = span.select("lo", F.explode(F.sequence("lo", "hi")).alias("h")).join(F.broadcast(kinds))
    return calendar.join(summed, ["recording_id", "h"], "left").select("recording_id", (F.col("h") - F.col("lo")).alias("idx"), F.coalesce("raw", F.lit(0.0)).alias("raw"), F.lit(FPS).alias("fps"))


SIGNAL_SQL = """
hours AS MATERIALIZED (SELECT event_type AS recording_id, date_diff('hour', TIMESTAMP '2000-01-01', date_trunc('hour', ts)) AS h, round(sum(value), 2) AS raw FROM events GROUP BY ALL),
span AS (SELECT min(h) AS lo, max(h) AS hi FROM hours),
calendar AS MATERIALIZED (SELECT recording_id, lo, unnest(generate_series(lo, hi)) AS h FROM span, (SELECT DISTINCT recording_id FROM hours)),
sig AS MATERIALIZED (SELECT c.recording_id, CAST(c.h - lo AS INTEGER) AS idx, coalesce(raw, 0.0) AS raw FROM calendar c LEFT JOIN hours USING (recording_id, h))"""
#: mx(recording_id, idx, v): local maxima of ``sig``.
TOPS_SQL = """
turned AS (SELECT *, CASE WHEN raw = lag(raw) OVER w THEN 0 ELSE 1 END AS turn FROM sig WINDOW w AS (PARTITION BY recording_id ORDER BY idx)),
numbered AS (SELECT *, sum(turn) OVER (PARTITION BY recording_id ORDER BY idx) AS run FROM turned),
runs AS (SELECT recording_id, run, min(idx) AS lo, max(idx) AS hi, min(raw) AS v FROM numbered GROUP BY ALL),
flanked AS (SELECT *, lag(v) OVER w AS b, lead(v) OVER w AS a FROM runs WINDOW w AS (PARTITION BY recording_id ORDER BY run)),
mx AS MATERIALIZED (SELECT recording_id, CAST((lo + hi) // 2 AS INTEGER) AS idx, v FROM flanked WHERE v > b AND v > a)"""
MAXIMA_SQL = f"{SIGNAL_SQL},{TOPS_SQL}"
#: beats of the peaks ``mx`` of ``sig``.
EVENTS_SQL = """
ev AS MATERIALIZED (SELECT recording_id, idx AS peak, v, lag(idx) OVER w AS previous, lead(idx) OVER w AS following, row_number() OVER w - 1 AS no FROM mx WINDOW w AS (PARTITION BY recording_id ORDER BY idx)),
lows AS MATERIALIZED (SELECT e.recording_id, no, first(s.idx ORDER BY s.raw, s.idx) AS before, min(s.raw) AS vb FROM ev e JOIN sig s ON s.recording_id = e.recording_id AND s.idx >= coalesce(previous, 0) AND s.idx < peak GROUP BY ALL),
tails AS MATERIALIZED (SELECT e.recording_id, no, first(s.idx ORDER BY s.raw, s.idx) AS after, min(s.raw) AS va FROM ev e JOIN sig s ON s.recording_id = e.recording_id AND s.idx >= peak AND s.idx < coalesce(following, 1000000000) GROUP BY ALL),
ends AS MATERIALIZED (
  SELECT ev.*, before, after, vb, va, v - (vb + va) / 2 AS amplitude FROM ev JOIN lows ON lows.recording_id = ev.recording_id AND lows.no = ev.no JOIN tails ON tails.recording_id = ev.recording_id AND tails.no = ev.no),
stepped AS MATERIALIZED (SELECT recording_id, idx, raw, raw - lag(raw) OVER w AS d, lead(raw) OVER w AS nxt FROM sig WINDOW w AS (PARTITION BY recording_id ORDER BY idx)),
speed AS (
  SELECT e.recording_id, no, max(d) FILTER (WHERE s.idx <= peak) * 30.0 AS up, -min(d) FILTER (WHERE s.idx > peak) * 30.0 AS down
  FROM ends e JOIN stepped s ON s.recording_id = e.recording_id AND s.idx > before AND s.idx <= after GROUP BY ALL),
fallen AS (
  SELECT e.recording_id, no, f, min(s.idx) AS k, any_value(amplitude) AS amplitude, any_value((vb + va) / 2 + (1 - f) * amplitude) AS target, any_value(peak) AS peak
  FROM ends e, (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)) t(f) JOIN stepped s ON s.recording_id = e.recording_id AND s.idx >= peak AND s.idx < after AND s.nxt <= (vb + va) / 2 + (1 - f) * amplitude
  WHERE amplitude > 0 GROUP BY ALL),
decays AS (
  SELECT d.recording_id, no, f, (k - peak + CASE WHEN s.raw <> s.nxt THEN (s.raw - target) / (s.raw - s.nxt) ELSE 0 END) / 30.0 AS t
  FROM fallen d JOIN stepped s ON s.recording_id = d.recording_id AND s.idx = k),
decayed AS (
  SELECT e.recording_id, e.no, max(t) FILTER (WHERE f = 0.1) AS t10, max(t) FILTER (WHERE f = 0.5) AS t50, max(t) FILTER (WHERE f = 0.9) AS t90
  FROM ends e LEFT JOIN decays d ON d.recording_id = e.recording_id AND d.no = e.no GROUP BY ALL),
beats AS (
  SELECT e.recording_id, e.no AS beat_index, before / 30.0 AS contraction_start_time_s, peak / 30.0 AS peak_time_s, after / 30.0 AS relaxation_end_time_s, amplitude,
         peak / 30.0 - before / 30.0 AS contraction_time_s, after / 30.0 - peak / 30.0 AS relaxation_time_s, up AS max_contraction_velocity, down AS max_relaxation_velocity,
         t10 AS time_to_decay_10_s, t50 AS time_to_decay_50_s, t90 AS time_to_decay_90_s, peak / 30.0 - previous / 30.0 AS inter_beat_interval_s, 60.0 / (peak / 30.0 - previous / 30.0) AS instantaneous_bpm
  FROM ends e LEFT JOIN speed s ON s.recording_id = e.recording_id AND s.no = e.no LEFT JOIN decayed d ON d.recording_id = e.recording_id AND d.no = e.no)"""
BEATS_SQL = f"{MAXIMA_SQL},{EVENTS_SQL}"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order: its total price and the summed price of its lines."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum("l_extendedprice"), 2).alias("b"))
    return table(spark, sf_dir, "orders").join(lines, "o_orderkey").select(F.lit("orders").alias("pair_id"), "o_orderkey", F.col("o_totalprice").alias("a"), "b")


PAIRS_SQL = """
pr AS (SELECT 'orders' AS pair_id, o_orderkey, o_totalprice AS a, b FROM orders JOIN (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS b FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""


#: The groups that order prices are compared in: market segments, or customers with even and odd keys.
LABELS = {"segment": "c_mktsegment", "parity": "CASE WHEN c_custkey % 2 = 0 THEN 'even' ELSE 'odd' END"}


def metrics(spark: SparkSession, sf_dir: str, by: str = "segment") -> DataFrame:
    """Order prices as one metric: a group a label of the customer, a cluster a nation."""
    customers = table(spark, sf_dir, "customer").withColumn("label", F.expr(LABELS[by]))
    order = Window.orderBy("label")
    # a handful of labels
    named = customers.select("label").distinct().withColumn("group_idx", F.row_number().over(order) - 1)
    rows = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select("label", F.col("o_orderkey").cast("string").alias("recording_id"), F.col("c_nationkey").cast("string").alias("cluster"), F.col("o_totalprice").alias("value"))
    return rows.join(F.broadcast(named), "label").select(F.lit("o_totalprice").alias("metric"), "group_idx", "label", "recording_id", "cluster", "value")


def metrics_sql(by: str = "segment") -> str:
    return f"""
cu AS (SELECT *, {LABELS[by]} AS label FROM customer),
named AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS group_idx FROM (SELECT DISTINCT label FROM cu)),
me AS (SELECT 'o_totalprice' AS metric, group_idx, cu.label, o_orderkey, CAST(c_nationkey AS VARCHAR) AS cluster, o_totalprice AS value FROM orders JOIN cu ON o_custkey = c_custkey JOIN named ON named.label = cu.label),
ranked AS (SELECT *, rank() OVER (PARTITION BY metric ORDER BY value) + (count(*) OVER (PARTITION BY metric, value) - 1) / 2.0 AS r FROM me),
sums AS (SELECT metric, group_idx, label, count(*)::DOUBLE AS n, sum(r) AS rs FROM ranked GROUP BY ALL),
tied AS (SELECT metric, sum(t)::DOUBLE AS total, sum(t::DOUBLE * t * t - t) AS ties FROM (SELECT metric, value, count(*) AS t FROM me GROUP BY ALL) GROUP BY ALL)"""

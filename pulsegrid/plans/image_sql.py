"""SQL for what the image operators find on the driver's 8 x 8 frames: objects, structure tensors, displacement fields."""

from __future__ import annotations

import math

from ..operators import motion


def _reach(name: str, start: str, grid: str, test: str, near: str) -> str:
    """Places that are reached from each start over neighbouring places of ``grid`` for which ``test`` holds."""
    return f"""{name} AS (
  {start}
  UNION SELECT r.recording_id, r.y, r.x, m.y AS ty, m.x AS tx FROM {name} r JOIN {grid} m ON m.recording_id = r.recording_id AND m.{test} AND {near.format(a='m', b='r')})"""


_FACES = "abs({a}.y - {b}.ty) + abs({a}.x - {b}.tx) = 1"
_CORNERS = "greatest(abs({a}.y - {b}.ty), abs({a}.x - {b}.tx)) = 1"


def objects_sql(least: int) -> str:
    """lb(recording_id, y, x, v, label) of the projections ``pj`` (recording_id, pos, v) with thresholds ``th``; needs WITH RECURSIVE."""
    one = lambda grid: f"SELECT recording_id, y, x, y AS ty, x AS tx FROM {grid} WHERE lit"
    return f"""
mk AS MATERIALIZED (SELECT p.recording_id, pos // 8 AS y, pos % 8 AS x, v, v > threshold AS lit, NOT v > threshold AS dark FROM pj p JOIN th ON th.recording_id = p.recording_id),
{_reach("edge", "SELECT recording_id, y, x, y AS ty, x AS tx FROM mk WHERE dark AND (y IN (0, 7) OR x IN (0, 7))", "mk", "dark", _FACES)},
fl AS MATERIALIZED (SELECT m.recording_id, m.y, m.x, v, e.ty IS NULL AS lit FROM mk m LEFT JOIN (SELECT DISTINCT recording_id, ty, tx FROM edge) e ON e.recording_id = m.recording_id AND e.ty = m.y AND e.tx = m.x),
{_reach("faced", one("fl"), "fl", "lit", _FACES)},
kp AS MATERIALIZED (SELECT f.*, c.n >= {least} AS big FROM fl f JOIN (SELECT recording_id, y, x, count(*) AS n FROM faced GROUP BY ALL) c ON c.recording_id = f.recording_id AND c.y = f.y AND c.x = f.x),
gd AS MATERIALIZED (SELECT recording_id, y, x, v, big AS lit FROM kp),
{_reach("joined", one("gd"), "gd", "lit", _CORNERS)},
roots AS (SELECT recording_id, y, x, min(ty * 8 + tx) AS root FROM joined GROUP BY ALL),
lb AS MATERIALIZED (SELECT r.recording_id, r.y, r.x, v, dense_rank() OVER (PARTITION BY r.recording_id ORDER BY root) AS label FROM roots r JOIN gd ON gd.recording_id = r.recording_id AND gd.y = r.y AND gd.x = r.x)"""


#: Properties of the labels ``lb``, as ``images`` names them.
REGIONS_SQL = """
moments AS (
  SELECT recording_id, label, count(*) AS n, avg(v) AS mean, avg(y::DOUBLE) AS r, avg(x::DOUBLE) AS c, var_pop(y) + 1 / 12.0::DOUBLE AS rr, var_pop(x) + 1 / 12.0::DOUBLE AS cc, covar_pop(y, x) AS rc
  FROM lb GROUP BY ALL),
axes AS (SELECT *, (rr + cc + sqrt((rr - cc) * (rr - cc) + 4 * rc * rc)) / 2 AS big, greatest((rr + cc - sqrt((rr - cc) * (rr - cc) + 4 * rc * rc)) / 2, 0) AS small,
         CASE WHEN abs(rr - cc) + abs(rc) = 0 THEN 0 ELSE 0.5 * atan2(2 * rc, rr - cc) END AS angle FROM moments),
beside AS (SELECT a.recording_id, a.label, a.y, a.x, b.y AS ny, b.x AS nx FROM lb a JOIN lb b ON b.recording_id = a.recording_id AND b.label = a.label AND greatest(abs(a.y - b.y), abs(a.x - b.x)) = 1),
border AS MATERIALIZED (
  SELECT l.recording_id, l.label, l.y, l.x FROM lb l LEFT JOIN (SELECT recording_id, y, x, count(*) AS n FROM beside WHERE y = ny OR x = nx GROUP BY ALL) s ON s.recording_id = l.recording_id AND s.y = l.y AND s.x = l.x
  WHERE coalesce(n, 0) < 4),
steps AS (
  SELECT a.recording_id, a.label, a.y, a.x, count(b.y) FILTER (WHERE a.y = b.y OR a.x = b.x) AS straight, count(b.y) FILTER (WHERE a.y <> b.y AND a.x <> b.x) AS diagonal
  FROM border a LEFT JOIN border b ON b.recording_id = a.recording_id AND b.label = a.label AND greatest(abs(a.y - b.y), abs(a.x - b.x)) = 1 GROUP BY ALL),
outline AS (
  SELECT recording_id, label, sum(CASE WHEN straight + diagonal < 2 THEN 0 WHEN straight = 1 AND diagonal = 1 THEN (1 + sqrt(2)) / 2 WHEN straight >= 2 THEN 1 WHEN diagonal >= 2 THEN sqrt(2) ELSE (1 + sqrt(2)) / 2 END) AS perimeter
  FROM steps GROUP BY ALL),
regions AS (
  SELECT a.recording_id, CAST(a.label AS INTEGER) AS label, n AS area, sqrt(CASE WHEN big > 0 THEN 1 - small / big ELSE 0 END) AS eccentricity, angle AS orientation, 4 * sqrt(big) AS major_axis_length,
         4 * sqrt(small) AS minor_axis_length, sqrt(4 * n / pi()) AS equivalent_diameter_area, mean AS mean_intensity, r AS "centroid-0", c AS "centroid-1", degrees(angle) AS orientation_deg, perimeter
  FROM axes a JOIN outline o ON o.recording_id = a.recording_id AND o.label = a.label)"""


def _weights(kinds: dict[str, tuple[float, int]]) -> str:
    """wt(kind, off, w): Gaussians (sigma, order 0) and their derivatives (order 1), to four standard deviations."""
    rows = []
    for kind, (sigma, order) in kinds.items():
        reach = range(-int(4 * sigma + 0.5), int(4 * sigma + 0.5) + 1)
        total = math.fsum(math.exp(-(k * k) / (2 * sigma * sigma)) for k in reach)
        rows += [(kind, k, math.exp(-(k * k) / (2 * sigma * sigma)) / total * (k / sigma**2 if order else 1)) for k in reach]
    return f"wt(kind, off, w) AS (VALUES {', '.join(f'({kind!r}, {off}, {w!r}::DOUBLE)' for kind, off, w in rows)})"


#: mp(kind, n, i, j, w): how much voxel j adds to voxel i of an axis of n voxels, whose edges are mirrored; ``sizes``: n.
_MIRRORED = """places AS (SELECT n, unnest(range(n)) AS i FROM sizes),
mp AS MATERIALIZED (
  SELECT kind, n, i, CASE WHEN m < n THEN m ELSE 2 * n - 1 - m END AS j, sum(w) AS w
  FROM (SELECT kind, n, i, ((i + off) % (2 * n) + 2 * n) % (2 * n) AS m, w FROM places, wt) GROUP BY ALL)"""


def _pass(name: str, source: str, axis: str, size: str, kind: str, keep: str = "true") -> str:
    """One filter along one axis of ``source`` (recording_id, depth, c, z, y, x, v and whatever kinds it has)."""
    placed = {k: f"s.{k}" for k in "zyx"} | {axis: f"m.i AS {axis}"}
    return f"""{name} AS MATERIALIZED (SELECT s.recording_id, s.depth, s.c, {', '.join(placed.values())}, sum(m.w * s.v) AS v FROM {source} s JOIN mp m ON m.kind = {kind} AND m.n = {size} AND m.j = s.{axis} WHERE {keep.format(k='m.i')} GROUP BY ALL)"""


def volume_tensor_sql(stride: int = 2) -> str:
    """tensor_sums(recording_id, n, w, zz .. xx) of the frames ``bx`` read as volumes."""
    kind = lambda axis: f"CASE WHEN s.c = {axis} THEN 'd' ELSE 'g' END"
    even = f"{{k}} % {stride} = 0"
    return f"""
vx AS MATERIALIZED (
  SELECT b.recording_id, depth, frame_idx AS z, pos // 8 AS y, pos % 8 AS x, v FROM bx b JOIN (SELECT recording_id, count(DISTINCT frame_idx) AS depth FROM bx GROUP BY ALL) d ON d.recording_id = b.recording_id),
sizes AS (SELECT DISTINCT depth AS n FROM vx UNION SELECT 8),
{_weights({"g": (1.0, 0), "d": (1.0, 1), "a": (2.0, 0)})},
{_MIRRORED},
ch AS (SELECT vx.*, t.c FROM vx, range(3) t(c)),
{_pass("g1", "ch", "z", "s.depth", kind(0))},
{_pass("g2", "g1", "y", "8", kind(1))},
{_pass("g3", "g2", "x", "8", kind(2))},
pr AS (SELECT a.recording_id, a.depth, a.c * 3 + b.c AS c, a.z, a.y, a.x, a.v * b.v AS v FROM g3 a JOIN g3 b ON b.recording_id = a.recording_id AND b.z = a.z AND b.y = a.y AND b.x = a.x AND b.c >= a.c),
{_pass("t1", "pr", "z", "s.depth", "'a'", even)},
{_pass("t2", "t1", "y", "8", "'a'", even)},
{_pass("t3", "t2", "x", "8", "'a'", even)},
tn AS (SELECT recording_id, z, y, x, {', '.join(f"sum(v) FILTER (WHERE c = {a * 3 + b}) AS {'zyx'[a]}{'zyx'[b]}" for a in range(3) for b in range(a, 3))} FROM t3 GROUP BY ALL),
iv AS (SELECT *, (zz + yy + xx) / 3 AS mean, zz * zz + yy * yy + xx * xx + 2 * (zy * zy + zx * zx + yx * yx) AS sq FROM tn),
ip AS (SELECT *, sqrt(greatest(sq - 3 * mean * mean, 0) / 6) AS p FROM iv),
ia AS (SELECT *, acos(least(greatest(((zz - mean) * ((yy - mean) * (xx - mean) - yx * yx) - zy * (zy * (xx - mean) - yx * zx) + zx * (zy * yx - (yy - mean) * zx)) / (2 * p * p * p), -1), 1)) / 3 AS phi FROM ip),
ev AS (SELECT *, mean + 2 * p * cos(phi) AS l1, mean + 2 * p * cos(phi + 2 * pi() / 3) AS l3, sqrt(1.5 * greatest(sq - 3 * mean * mean, 0) / sq) AS fa FROM ia),
-- the projection on the direction of the smallest value: (T - l1)(T - l2) / ((l3 - l1)(l3 - l2))
ew AS (SELECT *, 3 * mean - l1 - l3 AS l2 FROM ev),
tensor_sums AS (SELECT recording_id, count(*) AS n, sum(fa) AS w, {', '.join(f"sum(fa * ({_product(a, b)}) / ((l3 - l1) * (l3 - l2))) AS {'zyx'[a]}{'zyx'[b]}" for a in range(3) for b in range(a, 3))} FROM ew GROUP BY ALL)"""


def _product(a: int, b: int) -> str:
    entry = lambda r, c, of: "zyx"[min(r, c)] + "zyx"[max(r, c)] + (f" - {of}" if r == c else "")
    return " + ".join(f"({entry(a, k, 'l1')}) * ({entry(k, b, 'l2')})" for k in range(3))


def image_tensor_sql() -> str:
    """texture(recording_id, ..) of the projections ``pj`` (recording_id, pos, v)."""
    kind = lambda axis: f"CASE WHEN s.c = {axis} THEN 'd' ELSE 'g' END"
    return f"""
sizes AS (SELECT 8 AS n),
{_weights({"g": (1.0, 0), "d": (1.0, 1), "a": (3.0, 0)})},
{_MIRRORED},
ch AS (SELECT recording_id, 1 AS depth, 0 AS z, pos // 8 AS y, pos % 8 AS x, v, t.c FROM pj, range(1, 3) t(c)),
{_pass("g1", "ch", "y", "8", kind(1))},
{_pass("g2", "g1", "x", "8", kind(2))},
pr AS (SELECT a.recording_id, a.depth, a.c * 3 + b.c AS c, a.z, a.y, a.x, a.v * b.v AS v FROM g2 a JOIN g2 b ON b.recording_id = a.recording_id AND b.y = a.y AND b.x = a.x AND b.c >= a.c),
{_pass("t1", "pr", "y", "8", "'a'")},
{_pass("t2", "t1", "x", "8", "'a'")},
tn AS (SELECT recording_id, y, x, sum(v) FILTER (WHERE c = 4) AS yy, sum(v) FILTER (WHERE c = 5) AS yx, sum(v) FILTER (WHERE c = 8) AS xx FROM t2 GROUP BY ALL),
-- cosine and sine of twice the angle, times the coherence; the texture is across the gradient
ts AS (SELECT recording_id, count(*) AS n, sum(CASE WHEN xx + yy > 1e-12 THEN -(xx - yy) / (xx + yy) ELSE 0 END) AS c, sum(CASE WHEN xx + yy > 1e-12 THEN -2 * yx / (xx + yy) ELSE 0 END) AS s,
       sum(CASE WHEN xx + yy > 1e-12 THEN sqrt(pow(xx - yy, 2) + 4 * yx * yx) / (xx + yy) ELSE 0 END) AS w FROM tn GROUP BY ALL),
texture AS (SELECT recording_id, CASE WHEN w > 0 THEN sqrt(c * c + s * s) / w END AS texture_alignment_score, CASE WHEN w > 0 THEN degrees(atan2(s, c) / 2) END AS texture_mean_orientation_deg, w / n AS texture_mean_coherence FROM ts)"""


def _subpixel(before: str, after: str, axis: str, window: int) -> str:
    bend = f"ln({before}) - 2 * ln(top) + ln({after})"
    return f"CASE WHEN {axis} > 0 AND {axis} < {window - 1} AND abs({bend}) > 1e-12 THEN 0.5 * (ln({before}) - ln({after})) / ({bend}) ELSE 0 END"


def piv_sql(window: int = 4, step: int = 2) -> str:
    """field(recording_id, pair_idx, row, col, x, y, u, v, usable) of the frames ``bx``: circular correlations added up directly."""
    half, last, area = window // 2, (8 - window) // step, window * window
    return f"""
cells AS (SELECT CAST(a.k AS INTEGER) AS "row", CAST(b.k AS INTEGER) AS col FROM range({last + 1}) a(k), range({last + 1}) b(k)),
wn AS MATERIALIZED (
  SELECT recording_id, frame_idx, "row", col, pos // 8 - {step} * "row" AS wy, pos % 8 - {step} * col AS wx, v - avg(v) OVER (PARTITION BY recording_id, frame_idx, "row", col) AS d, v
  FROM bx, cells WHERE pos // 8 BETWEEN {step} * "row" AND {step} * "row" + {window - 1} AND pos % 8 BETWEEN {step} * col AND {step} * col + {window - 1}),
shifted AS (
  SELECT a.recording_id, CAST(a.frame_idx AS INTEGER) AS pair_idx, a."row", a.col, (b.wy - a.wy + {half} + {window}) % {window} AS py, (b.wx - a.wx + {half} + {window}) % {window} AS px, sum(a.d * b.d) AS f
  FROM wn a JOIN wn b ON b.recording_id = a.recording_id AND b.frame_idx = a.frame_idx + 1 AND b."row" = a."row" AND b.col = a.col GROUP BY ALL),
found AS MATERIALIZED (SELECT * REPLACE (CASE WHEN abs(f) < 1e-9 THEN 0 ELSE f END AS f) FROM shifted),
lifted AS MATERIALIZED (SELECT *, f - min(f) OVER w + 1e-6 AS top, row_number() OVER (PARTITION BY recording_id, pair_idx, "row", col ORDER BY f DESC, py * {window} + px) AS place FROM found WINDOW w AS (PARTITION BY recording_id, pair_idx, "row", col)),
peaks AS (
  SELECT t.recording_id, t.pair_idx, t."row", t.col, any_value(t.py) AS py, any_value(t.px) AS px, any_value(t.top) AS top,
         max(o.top) FILTER (WHERE o.py = t.py - 1 AND o.px = t.px) AS up, max(o.top) FILTER (WHERE o.py = t.py + 1 AND o.px = t.px) AS down,
         max(o.top) FILTER (WHERE o.py = t.py AND o.px = t.px - 1) AS before, max(o.top) FILTER (WHERE o.py = t.py AND o.px = t.px + 1) AS after
  FROM lifted t JOIN lifted o ON o.recording_id = t.recording_id AND o.pair_idx = t.pair_idx AND o."row" = t."row" AND o.col = t.col WHERE t.place = 1 GROUP BY ALL),
textured AS (SELECT recording_id, "row", col, sqrt(sum(d * d) / {area}) >= {motion.LEAST_TEXTURE} AS usable FROM wn WHERE frame_idx = 0 GROUP BY ALL),
field AS MATERIALIZED (
  SELECT p.recording_id, pair_idx, p."row", p.col, p.col * {step}.0 + {half} AS x, p."row" * {step}.0 + {half} AS y,
         px - {half} + {_subpixel("before", "after", "px", window)} AS u, py - {half} + {_subpixel("up", "down", "py", window)} AS v, usable
  FROM peaks p JOIN textured t ON t.recording_id = p.recording_id AND t."row" = p."row" AND t.col = p.col)"""

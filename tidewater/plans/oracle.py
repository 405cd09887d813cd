"""DuckDB SQL for the queries: the same results from the same tables, written independently."""

from __future__ import annotations

import math

from ..functions.names import METRIC_NAMES
from ..sources.tables import LINE_ORDER, METRIC_COLUMNS, MOST_TILES

EPS = "1e-6"
GREY = "((r * 9798 + g * 19235 + b * 3735 + 16384) >> 15)"


def tiles(side: int = 27, suppliers: int = 1) -> str:
    """CTEs px (image_id, y, x, b, g, r) and gp (image_id, y, x, v)."""
    order = ", ".join(("l_suppkey", *LINE_ORDER))
    return f"""numbered AS (SELECT *, l_suppkey // {suppliers} AS image_id FROM lineitem),
    placed AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY {order}) - 1 AS n FROM numbered),
    wholes AS (SELECT image_id, count(*) AS whole FROM numbered GROUP BY image_id),
    shown AS (SELECT image_id, n, l_partkey % 256 AS b, l_orderkey * 7 % 256 AS g, l_quantity * 5 AS r FROM placed UNION ALL
      SELECT image_id, unnest(range(whole, CAST(ceil(whole / {side * side}.0) AS BIGINT) * {side * side})), 0, 0, 0 FROM wholes),
    px AS MATERIALIZED (SELECT image_id * {MOST_TILES} + n // {side * side} AS image_id, CAST(n % {side * side} // {side} AS INTEGER) AS y, CAST(n % {side} AS INTEGER) AS x, CAST(b AS INTEGER) AS b, CAST(g AS INTEGER) AS g, CAST(r AS INTEGER) AS r FROM shown),
    gp AS MATERIALIZED (SELECT image_id, y, x, {GREY} AS v FROM px)"""


GREY_TILES = """cells AS (SELECT vec_id AS image_id, generate_subscripts(embedding, 1) - 1 AS p, unnest(embedding) AS e FROM embeddings),
    gp AS (SELECT image_id, CAST(p // 8 AS INTEGER) AS y, CAST(p % 8 AS INTEGER) AS x, least(255, greatest(0, CAST(floor((CAST(e AS DOUBLE) + 0.6) / 1.2 * 256) AS INTEGER))) AS v FROM cells)"""


def around(name: str, of: str, taps: list[tuple[int, int, float]], side: int, rule: str = "mirror", columns: str = "sum(k.w * q.v) AS v", value: str = "v") -> str:
    """A CTE with a weighted sum over neighbours; borders by rule: mirror, symmetric or edge."""
    last = side - 1
    fold = {
        "mirror": lambda t: f"CASE WHEN {t} < 0 THEN -({t}) WHEN {t} > {last} THEN {2 * last} - ({t}) ELSE {t} END",
        "symmetric": lambda t: f"CASE WHEN {t} < 0 THEN -({t}) - 1 WHEN {t} > {last} THEN {2 * last + 1} - ({t}) ELSE {t} END",
        "edge": lambda t: f"least({last}, greatest(0, {t}))",
    }[rule]
    rows = ", ".join(f"({dy}, {dx}, {w!r}::DOUBLE)" for dy, dx, w in taps)
    return f"""{name}_to AS MATERIALIZED (SELECT p.image_id, p.y, p.x, {fold('p.y + k.dy')} AS ty, {fold('p.x + k.dx')} AS tx, k.w FROM {of} p, (VALUES {rows}) AS k(dy, dx, w)),
    {name} AS MATERIALIZED (SELECT k.image_id, k.y, k.x, {columns} FROM {name}_to k JOIN {of} q ON q.image_id = k.image_id AND q.y = k.ty AND q.x = k.tx GROUP BY k.image_id, k.y, k.x)"""


def box_std(name: str, of: str, size: int, side: int) -> str:
    """CTEs that end in {name} (image_id, v): the mean deviation in boxes, by sums in window frames along rows and then columns of mirrored images."""
    half, last = size // 2, side - 1
    fold = f"CASE WHEN e < 0 THEN -e WHEN e > {last} THEN {2 * last} - e ELSE e END"
    return f"""{name}m AS (SELECT e, {fold} AS s FROM range({-half}, {side + half}) t(e)),
    {name}x AS (SELECT image_id, y, e AS x, sum(v) OVER w AS v, sum(v * v) OVER w AS q FROM {of} JOIN {name}m ON s = x WINDOW w AS (PARTITION BY image_id, y ORDER BY e ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)),
    {name}y AS (SELECT image_id, e AS y, x, sum(v) OVER w / {size * size}.0::DOUBLE AS m, sum(q) OVER w / {size * size}.0::DOUBLE AS q FROM {name}x JOIN {name}m ON s = y WHERE x BETWEEN 0 AND {last} WINDOW w AS (PARTITION BY image_id, x ORDER BY e ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)),
    {name} AS (SELECT image_id, avg(sqrt(greatest(q - m * m, 0))) AS v FROM {name}y WHERE y BETWEEN 0 AND {last} GROUP BY image_id)"""


SOBEL_X = [(i, j, float(j * (2 - abs(i)))) for i in (-1, 0, 1) for j in (-1, 1)]
SOBEL_Y = [(j, i, float(j * (2 - abs(i)))) for i in (-1, 0, 1) for j in (-1, 1)]
LAPLACE = [(0, 0, -4.0), (0, 1, 1.0), (0, -1, 1.0), (1, 0, 1.0), (-1, 0, 1.0)]


def gradient(of: str, side: int, rule: str, name: str = "sob") -> str:
    """A CTE name (image_id, y, x, dx, dy)."""
    return ", ".join([around(f"{name}x", of, SOBEL_X, side, rule), around(f"{name}y", of, SOBEL_Y, side, rule), f"{name} AS (SELECT a.image_id, a.y, a.x, a.v AS dx, b.v AS dy FROM {name}x a JOIN {name}y b USING (image_id, y, x))"])


def canny(of: str, side: int, name: str) -> str:
    """CTEs that end in {name}edges (image_id, y, x)."""
    near = {(i, j): f"n{i + 1}{j + 1}" for i in (-1, 0, 1) for j in (-1, 0, 1)}
    pivot = ", ".join(f"coalesce(max(CASE WHEN k.i = {i} AND k.j = {j} THEN q.s END), 0) AS {n}" for (i, j), n in near.items())
    steps = f"(VALUES {', '.join(map(str, near))}) AS k(i, j)"
    return f"""{gradient(of, side, 'edge', name)},
    {name}mag AS MATERIALIZED (SELECT *, abs(dx) + abs(dy) AS s FROM {name}),
    {name}to AS MATERIALIZED (SELECT p.*, k.i, k.j, p.y + k.i AS ty, p.x + k.j AS tx FROM {name}mag p, {steps}),
    {name}nb AS (SELECT k.image_id, k.y, k.x, any_value(k.dx) AS dx, any_value(k.dy) AS dy, any_value(k.s) AS s, {pivot} FROM {name}to k JOIN {name}mag q ON q.image_id = k.image_id AND q.y = k.ty AND q.x = k.tx GROUP BY k.image_id, k.y, k.x),
    {name}thin AS MATERIALIZED (SELECT image_id, y, x, s FROM {name}nb WHERE s > 50 AND CASE
      WHEN abs(dy) * 32768 < abs(dx) * 13573 THEN s > n10 AND s >= n12
      WHEN abs(dy) * 32768 > abs(dx) * 13573 + abs(dx) * 65536 THEN s > n01 AND s >= n21
      WHEN (dx < 0) <> (dy < 0) THEN s > n02 AND s > n20
      ELSE s > n00 AND s > n22 END),
    {name}edges AS (SELECT image_id, y, x FROM {name}thin WHERE s > 150 UNION
      SELECT t.image_id, t.y, t.x FROM {name}edges e, {steps}, {name}thin t WHERE t.image_id = e.image_id AND t.y = e.y + k.i AND t.x = e.x + k.j)"""


def blurred(name: str, sigma: float, side: int) -> str:
    half = (int(round(6 * sigma + 1)) | 1) // 2
    taps = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-half, half + 1)]
    taps = [t / math.fsum(taps) for t in taps]
    span = range(-half, half + 1)
    return ", ".join([
        around(f"{name}v", "gp", [(i, 0, t) for i, t in zip(span, taps, strict=True)], side),
        around(f"{name}r", f"{name}v", [(0, i, t) for i, t in zip(span, taps, strict=True)], side),
        f"{name}s AS (SELECT image_id, y, x, CAST(least(255, greatest(0, round_even(v, 0))) AS INTEGER) AS v FROM {name}r)",
    ])


def eme(of: str, image: str = "image_id") -> str:
    """A scalar per image over (y, x, v)."""
    return f"""SELECT {image}, sum(CASE WHEN lo > 0 THEN ln(hi / lo + {EPS}) ELSE 0 END) / (count(*) FILTER (WHERE lo > 0) + {EPS}) AS eme
      FROM (SELECT {image}, y // 8 AS i, x // 8 AS j, max(v) AS hi, min(v) AS lo FROM {of} GROUP BY ALL) GROUP BY {image}"""


def histogram(channels: dict[str, str], of: str = "px") -> str:
    """CTE hist (image_id, channel, v, n, p)."""
    union = " UNION ALL ".join(f"SELECT image_id, '{k}' AS channel, CAST({e} AS INTEGER) AS v FROM {of}" for k, e in channels.items())
    return f"""vals AS ({union}), counted AS (SELECT image_id, channel, v, count(*) AS n FROM vals GROUP BY ALL),
    hist AS (SELECT *, n / (sum(n) OVER (PARTITION BY image_id, channel) + {EPS}) AS p FROM counted)"""


RAW_HUE = "CASE WHEN v = r THEN g - b WHEN v = g THEN b - r + 2 * d ELSE r - g + 4 * d END"
HUE = f"""hsv AS (SELECT *, greatest(b, g, r) AS v, greatest(b, g, r) - least(b, g, r) AS d FROM px),
    stepped AS (SELECT *, CASE WHEN d = 0 THEN 0 ELSE floor(({RAW_HUE} * round_even(122880.0 / d, 0) + 2048) / 4096) END AS h FROM hsv),
    hued AS (SELECT image_id, CAST(CASE WHEN h < 0 THEN h + 180 ELSE h END AS INTEGER) AS h FROM stepped)"""


def _linear(c: str) -> str:
    return f"CASE WHEN {c} / 255.0::DOUBLE <= 0.04045 THEN {c} / 255.0::DOUBLE / 12.92 ELSE pow(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END"


def _f(x: str) -> str:
    return f"CASE WHEN {x} > 0.008856 THEN cbrt({x}) ELSE 7.787 * ({x}) + 16.0 / 116.0 END"


LAB = f"""lin AS (SELECT image_id, y, x, {_linear('b')} AS lb, {_linear('g')} AS lg, {_linear('r')} AS lr FROM px),
    xyz AS (SELECT image_id, y, x, (0.412453 * lr + 0.357580 * lg + 0.180423 * lb) / 0.950456 AS cx, 0.212671 * lr + 0.715160 * lg + 0.072169 * lb AS cy, (0.019334 * lr + 0.119193 * lg + 0.950227 * lb) / 1.088754 AS cz FROM lin),
    curved AS (SELECT image_id, y, x, {_f('cx')} AS fx, {_f('cy')} AS fy, {_f('cz')} AS fz FROM xyz),
    lab AS (SELECT image_id, y, x, least(255, greatest(0, CAST(floor((116 * fy - 16) * 2.55 + 0.5) AS INTEGER))) AS l, least(255, greatest(0, CAST(floor(500 * (fx - fy) + 128 + 0.5) AS INTEGER))) AS a,
      least(255, greatest(0, CAST(floor(200 * (fy - fz) + 128 + 0.5) AS INTEGER))) AS bb FROM curved),
    chroma AS (SELECT image_id, y, x, l, l / 255.0::DOUBLE AS light, sqrt(pow(a / 255.0::DOUBLE - 128 / 255.0::DOUBLE, 2) + pow(bb / 255.0::DOUBLE - 128 / 255.0::DOUBLE, 2)) AS c FROM lab)"""
LAB_OUT = f"round(stddev_pop(l) / (avg(l) + {EPS}), 6) AS lab_contrast, round(0.4680 * stddev_pop(c) + 0.2745 * stddev_pop(light) + 0.2576 * avg(c / (light + {EPS})), 6) AS uciqe_score"


def clip(x: str) -> str:
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x}))"


def share(x: str, full: float) -> str:
    return clip(f"{x} / {full}::DOUBLE")


def _metric(name: str, m: int, k: int, d: float, o: float) -> str:
    return f"CASE WHEN o_orderkey % 97 <> 0 THEN (o_orderkey * {m} % {k}) / {d}::DOUBLE + {o}::DOUBLE END AS {name}"


SCORES = f"""d1 AS (SELECT *, (blue_channel_mean - red_channel_mean) / 255 AS blue_dominance, (green_channel_mean - red_channel_mean) / 255 AS green_dominance, blue_channel_mean / (green_channel_mean + {EPS}) AS blue_green_ratio,
      (blue_channel_mean + green_channel_mean) / (red_channel_mean + {EPS}) AS color_temperature FROM base),
    d2 AS (SELECT *, CASE WHEN error IS NULL THEN {clip('blue_dominance + 0.5 * green_dominance')} END AS blue_water_severity,
      CASE WHEN error IS NULL THEN 0.4 * {share('rms_contrast', 0.5)} + 0.4 * {share('sharpness_gradient', 30)} + 0.2 * {share('edge_density', 0.2)} END AS visibility_score FROM d1),
    d3 AS (SELECT *, CASE WHEN error IS NULL THEN 0.3 * blue_water_severity + 0.3 * (1 - {share('rms_contrast', 0.5)}) + 0.2 * blur_estimate + 0.2 * (1 - {share('edge_density', 0.2)}) END AS turbidity_score FROM d2),
    d4 AS (SELECT *, CASE WHEN error IS NULL THEN 25 * {share('edge_density', 0.2)} + 20 * {share('keypoint_density', 2)} + 20 * {share('rms_contrast', 0.5)} + 15 * {share('sharpness_gradient', 30)} + 10 * {share('entropy_gray', 7.5)} + 10 * (1 - turbidity_score) END AS feature_usefulness_score,
      CASE WHEN error IS NULL THEN 30 * visibility_score + 25 * (1 - turbidity_score) + 20 * (1 - blue_water_severity) + 15 * {share('edge_density', 0.2)} + 10 * {share('uciqe_score', 0.6)} END AS marine_science_value FROM d3),
    d5 AS (SELECT *, CASE WHEN error IS NULL THEN greatest(0.0, least(100.0, 0.35 * feature_usefulness_score + 0.35 * marine_science_value + 20 * visibility_score - 10 * blue_water_severity)) END AS overall_score,
      CASE WHEN error IS NULL THEN 5 * blue_water_severity + 3 * turbidity_score + 2 * (1 - {share('rms_contrast', 0.5)}) END AS blue_water_problem_severity FROM d4),
    scored AS (SELECT *, CASE WHEN overall_score >= 80 THEN 'Excellent' WHEN overall_score >= 60 THEN 'Good' WHEN overall_score >= 40 THEN 'Fair' WHEN overall_score >= 20 THEN 'Poor' WHEN overall_score IS NOT NULL THEN 'Unusable' END AS usability_category FROM d5),
    ok AS (SELECT * FROM scored WHERE error IS NULL)"""
SCORED = f"""base AS (SELECT 's' || (o_custkey % 9) || '/img' || o_orderkey || '.png' AS path, CASE WHEN o_orderkey % 97 = 0 THEN 'failed' END AS error, {', '.join(_metric(*c) for c in METRIC_COLUMNS)} FROM orders),
    {SCORES}"""

FRAMES = """fr AS (SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS frame_idx, least(100.0::DOUBLE, value) AS score, 10 - least(100.0::DOUBLE, value) / 10 AS severity, least(100.0::DOUBLE, value) / 200 + 0.25 AS visibility FROM events),
    df AS (SELECT *, abs(score - lag(score) OVER w) AS qd, abs(severity - lag(severity) OVER w) AS bd, abs(visibility - lag(visibility) OVER w) AS vd FROM fr WINDOW w AS (PARTITION BY video_id ORDER BY frame_idx))"""


def texts(rules: list[tuple[str, str]], default: str | None = None) -> str:
    """The texts of the rules that hold, joined."""
    whole = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {p} THEN {t if t.startswith('printf') else repr(t)} END" for p, t in rules) + "], lambda z: z IS NOT NULL), '; ')"
    return whole if default is None else f"CASE WHEN {whole} = '' THEN '{default}' ELSE {whole} END"


def rounded(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


CV = [("edge_density < 0.05", "few edges"), ("keypoint_density < 0.5", "few keypoints"), ("visibility_score < 0.3", "poor visibility"), ("blur_estimate > 0.7", "strong blur")]
MARINE = [("blue_water_severity > 0.7", "severe blue water"), ("turbidity_score > 0.7", "high turbidity"), ("visibility_score < 0.3", "poor visibility"), ("rms_contrast < 0.2", "low contrast")]


def why(score: str, strong: str, weak: str, rules: list[tuple[str, str]]) -> str:
    joined = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {p} THEN '{t}' END" for p, t in rules) + "], lambda z: z IS NOT NULL), ', ')"
    return f"CASE WHEN {score} >= 50 THEN '{strong}' WHEN {score} >= 30 THEN '{weak}' ELSE 'Insufficient: ' || CASE WHEN {joined} = '' THEN 'low score' ELSE {joined} END END"


def slope(y: str) -> str:
    return f"covar_pop(frame_idx::DOUBLE, {y}) / nullif(var_pop(frame_idx::DOUBLE), 0)"


STABLE = "CASE WHEN count(*) < 2 THEN 1.0::DOUBLE ELSE 1 - least(0.5 * stddev_pop(score) / 100 + 0.5 * avg(qd) / 100, 1.0::DOUBLE) END"
KEEP = "coalesce(score, 50.0) >= 40"
CATEGORY = "CASE WHEN score >= 80 THEN 'Excellent' WHEN score >= 60 THEN 'Good' WHEN score >= 40 THEN 'Fair' WHEN score >= 20 THEN 'Poor' ELSE 'Unusable' END"

HYBRID = """own AS (SELECT doc_id AS path, least(100.0::DOUBLE, n_chars / 50.0::DOUBLE) AS t, CAST(n_chars % 11 AS DOUBLE) AS ts FROM documents),
    model AS (SELECT doc_id AS path, quality * 60.0::DOUBLE + doc_id % 41 AS d, toxic * 5.0::DOUBLE + doc_id % 5 AS ds FROM labels),
    hy AS (SELECT path, t AS traditional_score, d AS dl_score, CASE WHEN d IS NULL THEN t ELSE 0.6 * d + 0.4 * t END AS hybrid_score, CASE WHEN ds IS NULL THEN ts ELSE 0.6 * ds + 0.4 * ts END AS hybrid_severity FROM own LEFT JOIN model USING (path))"""


def corr(a: str, b: str) -> str:
    x, y = f"CASE WHEN {b} IS NOT NULL THEN {a} END", f"CASE WHEN {a} IS NOT NULL THEN {b} END"
    return f"round(covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0), 6)"


def bars(panel: dict[str, str]) -> str:
    return f"WITH {SCORED} " + " UNION ALL ".join(f"SELECT path, '{k}' AS bar, round({e}, 6) AS height FROM ok" for k, e in panel.items())


RING = [(-3, 0), (-3, 1), (-2, 2), (-1, 3), (0, 3), (1, 3), (2, 2), (3, 1), (3, 0), (3, -1), (2, -2), (1, -3), (0, -3), (-1, -3), (-2, -2), (-3, -1)]
_GAUSS = [math.exp(-(i * i) / 2) for i in range(-4, 5)]
_GAUSS = [g / math.fsum(_GAUSS) for g in _GAUSS]
_BEND = [(i * i - 1) * g for i, g in zip(range(-4, 5), _GAUSS, strict=True)]


def log_of(name: str, of: str, side: int) -> str:
    """CTEs that end in {name} (image_id, y, x, v): the size of the Laplacian of Gaussian, as two pairs of passes."""
    down, across = (lambda taps: [(i, 0, w) for i, w in zip(range(-4, 5), taps, strict=True)]), (lambda taps: [(0, i, w) for i, w in zip(range(-4, 5), taps, strict=True)])
    parts = [around(f"{name}{k}{n}", of if n == 0 else f"{name}{k}0", taps, side, "symmetric") for k, pair in enumerate(((down(_BEND), across(_GAUSS)), (across(_BEND), down(_GAUSS)))) for n, taps in enumerate(pair)]
    return ", ".join([*parts, f"{name} AS (SELECT a.image_id, a.y, a.x, abs(a.v + b.v) AS v FROM {name}01 a JOIN {name}11 b USING (image_id, y, x))"])


ENTROPY = "sum(-p * log2(p))"
CAST_OUT = f"""round(avg(b), 6) AS blue_channel_mean, round(avg(g), 6) AS green_channel_mean, round(avg(r), 6) AS red_channel_mean, round((avg(b) - avg(r)) / 255, 6) AS blue_dominance, round((avg(g) - avg(r)) / 255, 6) AS green_dominance,
    round(avg(b) / (avg(g) + {EPS}), 6) AS blue_green_ratio, round({clip('(avg(b) - avg(r)) / 255 + 0.5 * ((avg(g) - avg(r)) / 255)')}, 6) AS blue_water_severity, round((avg(b) + avg(g)) / (avg(r) + {EPS}), 6) AS color_temperature,
    round(sqrt((pow(avg(b) - (avg(b) + avg(g) + avg(r)) / 3, 2) + pow(avg(g) - (avg(b) + avg(g) + avg(r)) / 3, 2) + pow(avg(r) - (avg(b) + avg(g) + avg(r)) / 3, 2)) / 3), 6) AS color_channel_std"""
GLOBAL_OUT = f"round(stddev_pop(v) / (avg(v) + {EPS}), 6) AS rms_contrast, round((max(v) - min(v)) / (max(v) + min(v) + {EPS}), 6) AS michelson_contrast"
RANKED = "path, round(overall_score, 6) AS overall_score, round(blue_water_problem_severity, 6) AS blue_water_problem_severity"
WEBER = f"""WITH {tiles(54, 4)}, patch AS (SELECT image_id, y // 32 AS i, x // 32 AS j, avg(CASE WHEN y % 32 BETWEEN 8 AND 23 AND x % 32 BETWEEN 8 AND 23 THEN v END) AS c,
      avg(CASE WHEN NOT (y % 32 BETWEEN 8 AND 23 AND x % 32 BETWEEN 8 AND 23) AND v > 0 THEN v END) AS s FROM gp WHERE y < 32 AND x < 32 GROUP BY ALL)
    SELECT image_id, round(coalesce(avg(CASE WHEN coalesce(s, c) > 1 THEN abs(c - coalesce(s, c)) / coalesce(s, c) END), 0.0), 6) AS weber_contrast FROM patch GROUP BY image_id"""
ZERO = "coalesce(max(CASE WHEN q.y = p.y + {i} AND q.x = p.x + {j} THEN q.v END), 0) AS n{a}{b}"
FAST = f"""WITH {tiles()}, f AS (SELECT image_id, y, x, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS v FROM px),
    nb AS (SELECT p.image_id, p.y, p.x, {', '.join(ZERO.format(i=i, j=j, a=i + 1, b=j + 1) for i in (-1, 0, 1) for j in (-1, 0, 1))} FROM f p JOIN f q ON q.image_id = p.image_id AND abs(q.y - p.y) <= 1 AND abs(q.x - p.x) <= 1 GROUP BY p.image_id, p.y, p.x),
    gr AS (SELECT image_id, n01 + n21 + n10 + n12 - 4 * n11 AS lap, sqrt(pow((n02 + 2 * n12 + n22) - (n00 + 2 * n10 + n20), 2) + pow((n20 + 2 * n21 + n22) - (n00 + 2 * n01 + n02), 2)) AS grad FROM nb),
    st AS (SELECT image_id, var_samp(lap) AS lv, avg(grad) AS gm, avg(grad) + stddev_samp(grad) AS lim FROM gr GROUP BY image_id),
    ed AS (SELECT image_id, avg(CASE WHEN grad > lim THEN 1.0 ELSE 0.0 END) AS ed FROM gr JOIN st USING (image_id) GROUP BY image_id),
    fl AS (SELECT image_id, avg(b) AS bm, avg(g) AS gm2, avg(r) AS rm, stddev_samp(b) AS bs, stddev_samp(g) AS gs, stddev_samp(r) AS rs FROM px GROUP BY image_id),
    lu AS (SELECT image_id, stddev_pop(v) / 255 AS rms, (max(v) - min(v)) / (max(v) + min(v) + {EPS}) AS mi FROM f GROUP BY image_id)
    SELECT image_id, round(bm, 6) AS fast_blue_mean, round(gm2, 6) AS fast_green_mean, round(rm, 6) AS fast_red_mean, round(bs, 6) AS fast_blue_std, round(gs, 6) AS fast_green_std, round(rs, 6) AS fast_red_std,
      round(rms, 6) AS fast_rms_contrast, round(mi, 6) AS fast_michelson_contrast, round(lv, 6) AS fast_laplacian_variance, round(gm, 6) AS fast_gradient, round(ed, 6) AS fast_edge_density,
      round((bm - rm) / 255, 6) AS fast_blue_dominance, round((bm + gm2) / greatest(rm, 1.0), 6) AS fast_color_temperature,
      round(greatest(0.0, least(10.0, 5 * ((bm - rm) / 255) + 5 * (1 - rms))), 6) AS fast_blue_water, round({clip('0.5 * rms + 0.5 * (1 - abs((bm - rm) / 255))')}, 6) AS fast_visibility
    FROM fl JOIN st USING (image_id) JOIN ed USING (image_id) JOIN lu USING (image_id)"""
SUMMARY = """SELECT split_part(path, '/', 1) AS survey, count(*) AS total_images, count(*) FILTER (WHERE error IS NULL) AS successful_assessments, count(*) FILTER (WHERE error IS NOT NULL) AS failed_assessments,
      round(avg(overall_score), 6) AS average_overall_score, round(avg(feature_usefulness_score), 6) AS average_feature_usefulness, round(avg(marine_science_value), 6) AS average_marine_value, round(avg(blue_water_problem_severity), 6) AS average_blue_water_severity FROM scored GROUP BY 1"""


def edge_share(name: str, side: int = 27) -> str:
    return f"SELECT image_id, count({name}edges.y) / {side * side}.0::DOUBLE AS d FROM (SELECT DISTINCT image_id FROM px) t LEFT JOIN {name}edges USING (image_id) GROUP BY image_id"


RECOMMENDATIONS = texts([
    ("blue_water_severity > 0.7", "Severe blue cast: correct the white balance and restore the red channel"), ("blue_water_severity > 0.5 AND blue_water_severity <= 0.7", "Moderate blue-green cast: apply colour correction"),
    ("rms_contrast < 0.2", "Low contrast: equalise locally or adjust gamma"), ("blur_estimate > 0.6", "Blurred: sharpen, and check focus and motion"), ("turbidity_score > 0.7", "Turbid: capture in clearer water"),
    ("edge_density < 0.05", "Few features: check distance and clarity"), ("visibility_score < 0.3", "Poor visibility: add light or move closer"), ("sharpness_laplacian < 100", "Soft: sharpen or lock the focus"),
    ("hue_diversity < 3.0", "Few hues: restore colours"), ("feature_usefulness_score > 70", "Good for computer vision"), ("marine_science_value > 70", "Good for marine science"),
], "Adequate for basic analysis")
WARNINGS = texts([
    ("feature_usefulness_score < 20", "CRITICAL: hardly any features"), ("marine_science_value < 20", "CRITICAL: hardly any scientific value"), ("blue_water_severity > 0.7", "CRITICAL: severe blue cast"),
    ("visibility_score < 0.2", "CRITICAL: extremely poor visibility"), ("turbidity_score > 0.75", "HIGH: very turbid"), ("michelson_contrast < 0.2", "HIGH: very low contrast"), ("edge_density < 0.03", "HIGH: hardly any edges"),
    ("blur_estimate > 0.7", "MEDIUM: strong blur"), ("keypoint_density < 0.5", "MEDIUM: few keypoints"), ("entropy_gray < 4.0", "MEDIUM: little information"),
    ("blue_dominance > 0.3", "Blue dominates: reds are attenuated"), ("color_temperature > 2.0", "Blue-shifted: warm colours are reduced"),
])
COLOUR_QUALITY = "CAST(round(CAST(round(0.6 * greatest(0.0, 100 * (1 - 2 * abs(blue_green_ratio - 0.5))) + 0.4 * least(100.0, 400 * rms_contrast), 9) AS DECIMAL(20, 9)), 1) AS DOUBLE)"

SQL: dict[str, str] = {
    "colour_cast": f"WITH {tiles()} SELECT image_id, {CAST_OUT} FROM px GROUP BY image_id",
    "global_contrast": f"WITH {tiles()} SELECT image_id, {GLOBAL_OUT} FROM gp GROUP BY image_id",
    "lab_uciqe": f"WITH {tiles()}, {LAB} SELECT image_id, {LAB_OUT} FROM chroma GROUP BY image_id",
    "uicm": f"WITH {tiles()} SELECT image_id, round(-0.0268 * sqrt(pow(avg(r - g), 2) + pow(avg((r + g) / 2.0::DOUBLE - b), 2)) + 0.1586 * sqrt(var_pop(r - g) + var_pop((r + g) / 2.0::DOUBLE - b)), 6) AS uicm FROM px GROUP BY image_id",
    "weber_contrast": WEBER,
    "weber_kernel": WEBER,
    "fast_metrics": FAST,
    "histogram_distribution": f"""WITH {tiles()}, {histogram({'b': 'b', 'g': 'g', 'r': 'r'})} SELECT image_id, channel, round((sum(pow(p - 1 / 256.0::DOUBLE, 2)) + (256 - count(*)) * pow(1 / 256.0::DOUBLE, 2)) / (1 / 256.0::DOUBLE + {EPS}), 6) AS uniformity,
      round(count(*) FILTER (WHERE p > 0.001) / 256.0::DOUBLE, 6) AS dynamic_range FROM hist GROUP BY image_id, channel""",
    "gray_entropy": f"WITH {tiles()}, {histogram({'v': 'v'}, 'gp')} SELECT image_id, round({ENTROPY}, 6) AS entropy_gray FROM hist GROUP BY image_id",
    "channel_entropy": f"WITH {tiles()}, {histogram({'b': 'b', 'g': 'g', 'r': 'r'})} SELECT image_id, round({ENTROPY} / 3, 6) AS entropy_color FROM hist GROUP BY image_id",
    "hue_diversity": f"WITH {tiles()}, {HUE}, {histogram({'h': 'h'}, 'hued')} SELECT image_id, round({ENTROPY}, 6) AS hue_diversity FROM hist GROUP BY image_id",
    "local_contrast": f"WITH {tiles(54, 4)}, {box_std('std15', 'gp', 15, 54)}, {box_std('std9', 'gp', 9, 54)} SELECT image_id, round(a.v, 6) AS local_contrast, round(b.v, 6) AS texture_complexity FROM std15 a JOIN std9 b USING (image_id)",
    "tiled_metrics": f"""WITH RECURSIVE {tiles(54, 4)}, {box_std('std15', 'gp', 15, 54)}, {box_std('std9', 'gp', 9, 54)}, {around('lap', 'gp', LAPLACE, 54)}, {gradient('gp', 54, 'mirror')}, {canny('gp', 54, 'c')},
      l AS (SELECT image_id, var_pop(v) AS v FROM lap GROUP BY image_id), s AS (SELECT image_id, avg(sqrt(dx * dx + dy * dy)) AS v FROM sob GROUP BY image_id), ed AS ({edge_share('c', 54)})
      SELECT image_id, round(std15.v, 6) AS local_contrast, round(std9.v, 6) AS texture_complexity, round(l.v, 6) AS sharpness_laplacian, round(s.v, 6) AS sharpness_gradient, round(d, 6) AS edge_density
      FROM std15 JOIN std9 USING (image_id) JOIN l USING (image_id) JOIN s USING (image_id) JOIN ed USING (image_id)""",
    "sharpness": f"WITH {tiles()}, {around('lap', 'gp', LAPLACE, 27)}, {gradient('gp', 27, 'mirror')}, l AS (SELECT image_id, var_pop(v) AS v FROM lap GROUP BY image_id), s AS (SELECT image_id, avg(sqrt(dx * dx + dy * dy)) AS v FROM sob GROUP BY image_id) SELECT image_id, round(l.v, 6) AS sharpness_laplacian, round(s.v, 6) AS sharpness_gradient FROM l JOIN s USING (image_id)",
    "harris_corner_density": f"""WITH {tiles()}, {gradient('gp', 27, 'mirror')}, prod AS (SELECT image_id, y, x, dx * dx AS a, dx * dy AS b, dy * dy AS d FROM sob),
      {around('box', 'prod', [(0, 0, 1.0), (0, -1, 1.0), (-1, 0, 1.0), (-1, -1, 1.0)], 27, columns='sum(q.a) AS a, sum(q.b) AS b, sum(q.d) AS d')},
      resp AS (SELECT image_id, a * d - b * b - 0.04::DOUBLE * (a + d) * (a + d) AS v FROM box), top AS (SELECT *, max(v) OVER (PARTITION BY image_id) AS m FROM resp)
      SELECT image_id, round(avg(CASE WHEN v > 0.01::DOUBLE * m THEN 1.0 ELSE 0.0 END), 6) AS corner_density FROM top GROUP BY image_id""",
    "canny_edge_density": f"WITH RECURSIVE {tiles()}, {canny('gp', 27, 'c')} SELECT image_id, round(d, 6) AS edge_density FROM ({edge_share('c')})",
    "multi_scale_edge_density": f"WITH RECURSIVE {tiles()}, " + ", ".join(f"{blurred(f'g{i}', s, 27)}, {canny(f'g{i}s', 27, f'e{i}')}" for i, s in enumerate((1.0, 2.0, 4.0))) + " SELECT image_id, round(avg(d), 6) AS multi_scale_edge_density FROM (" + " UNION ALL ".join(edge_share(f"e{i}") for i in range(3)) + ") GROUP BY image_id",
    "fast_keypoints": f"""WITH {tiles()}, ring AS (SELECT p.image_id, p.y, p.x, list(q.v - p.v ORDER BY k.i) AS d FROM gp p, (VALUES {', '.join(f'({i}, {a}, {b})' for i, (a, b) in enumerate(RING))}) AS k(i, dy, dx), gp q
        WHERE q.image_id = p.image_id AND q.y = p.y + k.dy AND q.x = p.x + k.dx AND p.y BETWEEN 3 AND 23 AND p.x BETWEEN 3 AND 23 GROUP BY p.image_id, p.y, p.x),
      best AS (SELECT image_id, y, x, list_max(list_transform(range(16), lambda s: greatest(list_min(list_transform(range(9), lambda i: d[(s + i) % 16 + 1])), list_min(list_transform(range(9), lambda i: -d[(s + i) % 16 + 1]))))) AS s FROM ring),
      sc AS (SELECT image_id, y, x, CASE WHEN s > 20 THEN s - 1 ELSE 0 END AS s FROM best),
      corner AS (SELECT a.image_id, a.y, a.x FROM sc a WHERE a.s > 0 AND NOT EXISTS (SELECT 1 FROM sc b WHERE b.image_id = a.image_id AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1 AND (b.y <> a.y OR b.x <> a.x) AND b.s >= a.s))
      SELECT image_id, round(count(corner.y) / 729.0::DOUBLE * 1000, 6) AS keypoint_density FROM (SELECT DISTINCT image_id FROM px) t LEFT JOIN corner USING (image_id) GROUP BY image_id""",
    "relational_kernels": f"""WITH {tiles()}, {LAB}, {HUE}, g0 AS (SELECT image_id, {GLOBAL_OUT} FROM gp GROUP BY image_id), l0 AS (SELECT image_id, {LAB_OUT} FROM chroma GROUP BY image_id),
      vals AS (SELECT image_id, 'b' AS channel, b AS v FROM px UNION ALL SELECT image_id, 'g', g FROM px UNION ALL SELECT image_id, 'r', r FROM px UNION ALL SELECT image_id, 'v', v FROM gp UNION ALL SELECT image_id, 'h', h FROM hued),
      counted AS (SELECT image_id, channel, v, count(*) AS n FROM vals GROUP BY ALL), hist AS (SELECT *, n / (sum(n) OVER (PARTITION BY image_id, channel) + {EPS}) AS p FROM counted),
      e0 AS (SELECT image_id, round(sum(CASE WHEN channel = 'v' THEN -p * log2(p) END), 6) AS entropy_gray, round(sum(CASE WHEN channel IN ('b', 'g', 'r') THEN -p * log2(p) END) / 3, 6) AS entropy_color, round(sum(CASE WHEN channel = 'h' THEN -p * log2(p) END), 6) AS hue_diversity FROM hist GROUP BY image_id)
      SELECT * FROM g0 JOIN l0 USING (image_id) JOIN e0 USING (image_id)""",
    "blur_dft": f"""WITH {GREY_TILES}, uv AS (SELECT u.u AS u, w.w AS w FROM range(8) AS u(u), range(8) AS w(w)),
      f AS (SELECT image_id, u, w, sqrt(pow(sum(v * cos(2 * pi() * (u * y + w * x) / 8)), 2) + pow(sum(v * sin(2 * pi() * (u * y + w * x) / 8)), 2)) AS m FROM gp, uv GROUP BY image_id, u, w),
      bl AS (SELECT image_id, tanh(sum(CASE WHEN u = 0 AND w = 0 THEN m END) / (sum(CASE WHEN u <> 0 OR w <> 0 THEN m END) + {EPS}) / 100) AS v FROM f GROUP BY image_id), {around('lap', 'gp', LAPLACE, 8)},
      lv AS (SELECT image_id, var_pop(v) AS v FROM lap GROUP BY image_id) SELECT image_id, round(bl.v, 6) AS blur_estimate, round(lv.v, 6) AS sharpness_laplacian FROM bl JOIN lv USING (image_id)""",
    "uiqm_parts": f"WITH {tiles()}, {gradient('gp', 27, 'mirror')}, mag AS (SELECT image_id, y, x, sqrt(dx * dx + dy * dy) AS v FROM sob), " + ", ".join(
        f"c{c} AS (SELECT image_id, y, x, {c} AS v FROM px), {log_of(f'log{c}', f'c{c}', 27)}, eme{c} AS ({eme(f'log{c}')})" for c in "bgr"
    ) + f", em AS ({eme('mag')}) SELECT image_id, round(em.eme, 6) AS uism, round((emeb.eme + emeg.eme + emer.eme) / 3, 6) AS uiconm FROM em JOIN emeb USING (image_id) JOIN emeg USING (image_id) JOIN emer USING (image_id)",
    "custom_metric_udf": f"WITH {tiles()} SELECT image_id, round(CAST(sum(r) AS DOUBLE) / CAST(sum(b + g + r) AS DOUBLE), 6) AS red_share FROM px GROUP BY image_id",
    "visibility_turbidity": f"WITH {SCORED} SELECT path, {rounded('visibility_score', 'turbidity_score')} FROM ok",
    "usefulness": f"WITH {SCORED} SELECT path, {rounded('feature_usefulness_score', 'marine_science_value')} FROM ok",
    "overall_score": f"WITH {SCORED} SELECT path, {rounded('overall_score', 'blue_water_problem_severity')}, usability_category FROM ok",
    "colour_quality": f"WITH {SCORED} SELECT path, {COLOUR_QUALITY} AS colour_quality FROM ok",
    "recommendations": f"WITH {SCORED} SELECT path, {RECOMMENDATIONS} AS recommendations FROM ok",
    "warnings": f"WITH {SCORED} SELECT path, {WARNINGS} AS warnings FROM ok",
    "labels_and_colours": f"""WITH {SCORED} SELECT path, CASE WHEN blue_water_problem_severity >= 7 THEN 'Severe' WHEN blue_water_problem_severity >= 5 THEN 'Moderate' WHEN blue_water_problem_severity >= 3 THEN 'Mild' ELSE 'Minimal' END AS severity_label,
      CASE WHEN overall_score >= 80 THEN 'green' WHEN overall_score >= 60 THEN 'lightgreen' WHEN overall_score >= 40 THEN 'yellow' WHEN overall_score >= 20 THEN 'orange' ELSE 'red' END AS score_colour,
      CASE WHEN blue_water_severity >= 0.7 THEN 'red' WHEN blue_water_severity >= 0.5 THEN 'orange' WHEN blue_water_severity >= 0.3 THEN 'yellow' ELSE 'green' END AS severity_colour FROM ok""",
    "usability": f"WITH {SCORED} SELECT path, feature_usefulness_score >= 30 AS cv_usable, {why('feature_usefulness_score', 'Sufficient features', 'Marginal features', CV)} AS cv_reason, marine_science_value >= 30 AS marine_usable, {why('marine_science_value', 'Sufficient quality', 'Marginal quality', MARINE)} AS marine_reason FROM ok",
    "batch_summary": f"""WITH {SCORED}, s AS ({SUMMARY}), c AS (SELECT split_part(path, '/', 1) AS survey, usability_category, count(*) AS n FROM ok GROUP BY ALL),
      j AS (SELECT survey, string_agg(usability_category || '=' || n, ',' ORDER BY usability_category) AS categories FROM c GROUP BY survey) SELECT * FROM s JOIN j USING (survey)""",
    "category_distribution": f"WITH {SCORED} SELECT usability_category, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percentage FROM ok GROUP BY usability_category",
    "score_spread": f"WITH {FRAMES} SELECT count(*) AS n, round(avg(score), 6) AS overall_score_mean, round(median(score), 6) AS overall_score_median, round(stddev_pop(score), 6) AS overall_score_std, round(min(score), 6) AS overall_score_min, round(max(score), 6) AS overall_score_max FROM fr",
    "top_10": f"WITH {SCORED} SELECT {RANKED} FROM (SELECT * FROM ok ORDER BY overall_score DESC, path LIMIT 10)",
    "bottom_10": f"WITH {SCORED} SELECT {RANKED} FROM (SELECT * FROM ok ORDER BY overall_score, path DESC LIMIT 10)",
    "high_quality": f"WITH {SCORED} SELECT {RANKED} FROM (SELECT * FROM ok ORDER BY overall_score DESC, path LIMIT 10) WHERE overall_score > 40",
    "low_quality": f"WITH {SCORED} SELECT {RANKED} FROM ok WHERE overall_score < 30",
    "severe_blue_water": f"WITH {SCORED} SELECT {RANKED} FROM ok WHERE blue_water_problem_severity > 7",
    "ranking": f"WITH {SCORED} SELECT path, round(overall_score, 6) AS overall_score, row_number() OVER (ORDER BY overall_score DESC, path) AS rank FROM scored WHERE overall_score > 0",
    "best_by_survey": f"WITH {SCORED} SELECT survey, CAST(rank AS INTEGER) AS rank, path, round(overall_score, 6) AS overall_score FROM (SELECT split_part(path, '/', 1) AS survey, row_number() OVER (PARTITION BY split_part(path, '/', 1) ORDER BY overall_score DESC, path) AS rank, path, overall_score FROM ok) WHERE rank <= 5",
    "web_summary": f"WITH {SCORED}, x AS (SELECT CASE WHEN overall_score > 0 THEN overall_score END AS s FROM scored) SELECT count(*) AS total, count(s) AS successful, round(avg(s), 6) AS mean, round(median(s), 6) AS median, round(min(s), 6) AS least, round(max(s), 6) AS largest, round(stddev_pop(s), 6) AS std FROM x",
    "batch_means": "SELECT count(*) AS batches, round(avg(v), 6) AS value FROM (SELECT event_id // 32 AS b, avg(value) AS v FROM events GROUP BY 1)",
    "temporal_metrics": f"""WITH {FRAMES} SELECT video_id, count(*) AS analyzed_frames, round(CASE WHEN count(*) >= 2 THEN avg(qd) END, 6) AS quality_mean_diff, round(CASE WHEN count(*) >= 2 THEN max(qd) END, 6) AS quality_max_diff,
      round(avg(bd), 6) AS blue_water_mean_diff, round(avg(vd), 6) AS visibility_mean_diff, round(CASE WHEN count(*) >= 2 THEN var_pop(score) END, 6) AS quality_temporal_variance, round(CASE WHEN count(*) >= 2 THEN var_pop(severity) END, 6) AS blue_water_temporal_variance,
      round(CASE WHEN count(*) >= 2 THEN {slope('score')} END, 6) AS quality_trend, round(CASE WHEN count(*) >= 2 THEN {slope('severity')} END, 6) AS blue_water_trend, count(*) FILTER (WHERE score >= 60) AS good_frames_count, count(*) FILTER (WHERE score < 40) AS poor_frames_count,
      round(count(*) FILTER (WHERE score >= 60) * 100.0 / count(*), 6) AS good_frames_percentage, round({STABLE}, 6) AS temporal_stability FROM df GROUP BY video_id""",
    "temporal_diffs": f"WITH {FRAMES} SELECT video_id, frame_idx, round(qd, 6) AS quality_diff, round(bd, 6) AS blue_water_diff, round(vd, 6) AS visibility_diff FROM df",
    "video_summary": f"""WITH {FRAMES}, v AS (SELECT video_id, count(*) AS analyzed_frames, avg(score) AS average_frame_score, min(score) AS min_frame_score, max(score) AS max_frame_score, stddev_pop(score) AS quality_std, avg(severity) AS blue_water_severity_avg, avg(visibility) AS visibility_avg,
      greatest(0.0, avg(score) - least(stddev_pop(score) / 20, 1.0) * 10) AS overall_video_score, {STABLE} AS temporal_stability, CASE WHEN count(*) >= 2 THEN max(qd) END AS quality_max_diff, CASE WHEN count(*) >= 2 THEN {slope('score')} END AS quality_trend,
      avg(CASE WHEN score < 20 THEN 1 ELSE 0 END) * 100 AS very_poor_percentage, avg(CASE WHEN severity > 7 THEN 1 ELSE 0 END) * 100 AS severe_percentage FROM df GROUP BY video_id)
      SELECT video_id, analyzed_frames, {rounded('average_frame_score', 'min_frame_score', 'max_frame_score', 'quality_std', 'blue_water_severity_avg', 'visibility_avg', 'overall_video_score', 'temporal_stability', 'quality_max_diff', 'quality_trend', 'very_poor_percentage', 'severe_percentage')}, """ + texts([
        ("quality_std > 20", "printf('High variability (std %.1f): stabilise the camera or the light', CAST(round(CAST(round(quality_std, 9) AS DECIMAL(20, 9)), 1) AS DOUBLE))"), ("temporal_stability < 0.5", "printf('Low temporal stability (%.2f): quality changes fast between frames', CAST(round(CAST(round(temporal_stability, 9) AS DECIMAL(20, 9)), 2) AS DOUBLE))"),
        ("average_frame_score < 40", "printf('Poor average quality (%.1f): capture again', CAST(round(CAST(round(average_frame_score, 9) AS DECIMAL(20, 9)), 1) AS DOUBLE))"), ("average_frame_score > 70", "printf('Good average quality (%.1f)', CAST(round(CAST(round(average_frame_score, 9) AS DECIMAL(20, 9)), 1) AS DOUBLE))"),
        ("blue_water_severity_avg > 7", "printf('Severe blue water (%.1f of 10): correct colours', CAST(round(CAST(round(blue_water_severity_avg, 9) AS DECIMAL(20, 9)), 1) AS DOUBLE))"), ("quality_trend < -0.5", "Declining quality: turbidity or light may change"), ("quality_trend > 0.5", "Improving quality: early frames are less useful"),
    ]) + " AS recommendations, " + texts([
        ("very_poor_percentage > 50", "printf('CRITICAL: %.1f%% of the frames are very poor', CAST(round(CAST(round(very_poor_percentage, 9) AS DECIMAL(20, 9)), 1) AS DOUBLE))"), ("very_poor_percentage > 25 AND very_poor_percentage <= 50", "printf('HIGH: %.1f%% of the frames are poor', CAST(round(CAST(round(very_poor_percentage, 9) AS DECIMAL(20, 9)), 1) AS DOUBLE))"),
        ("quality_max_diff > 40", "printf('HIGH: abrupt quality changes (%.1f)', CAST(round(CAST(round(quality_max_diff, 9) AS DECIMAL(20, 9)), 1) AS DOUBLE))"), ("severe_percentage > 30", "printf('HIGH: %.1f%% of the frames have severe blue water', CAST(round(CAST(round(severe_percentage, 9) AS DECIMAL(20, 9)), 1) AS DOUBLE))"),
    ]) + " AS warnings FROM v",
    "best_frames": f"WITH {FRAMES}, k AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, frame_idx) AS rank FROM fr) SELECT video_id, frame_idx, CAST(rank AS INTEGER) AS rank, round(score, 6) AS overall_score, printf('frame_%06d_quality_%.1f_t%.2fs.jpg', frame_idx, CAST(round(CAST(round(score, 9) AS DECIMAL(20, 9)), 1) AS DOUBLE), CAST(round(CAST(round(frame_idx / 30.0::DOUBLE, 9) AS DECIMAL(20, 9)), 2) AS DOUBLE)) AS name FROM k WHERE rank <= 10",
    "timeline": f"WITH {FRAMES} SELECT video_id, frame_idx, round(frame_idx / 30.0::DOUBLE, 6) AS t, round(score, 6) AS score, round(severity, 6) AS severity, round(visibility * 100, 6) AS visibility FROM fr",
    "frame_sampling": f"WITH {FRAMES} SELECT video_id, frame_idx, round(score, 6) AS overall_score FROM fr WHERE frame_idx % 5 = 0 AND frame_idx < 30",
    "frame_filter": f"WITH {FRAMES} SELECT video_id, frame_idx AS frame, CAST(round(CAST(round(frame_idx / 30.0::DOUBLE, 9) AS DECIMAL(20, 9)), 2) AS DOUBLE) AS time_s, CAST(round(CAST(round(score, 9) AS DECIMAL(20, 9)), 2) AS DOUBLE) AS overall_score, CAST(round(CAST(round(severity, 9) AS DECIMAL(20, 9)), 2) AS DOUBLE) AS blue_water_severity, {CATEGORY} AS usability, {KEEP} AS kept FROM fr",
    "frame_filter_report": f"""WITH {FRAMES} SELECT video_id, count(*) AS total_frames, count(*) FILTER (WHERE {KEEP}) AS frames_kept, count(*) FILTER (WHERE NOT ({KEEP})) AS frames_removed, round(count(*) FILTER (WHERE {KEEP}) * 100.0 / count(*), 6) AS kept_percentage,
      round(min(score), 6) AS min_score, round(max(score), 6) AS max_score, round(avg(score), 6) AS mean_score, round(avg(CASE WHEN {KEEP} THEN score END), 6) AS mean_kept_score FROM fr GROUP BY video_id""",
    "hybrid_blend": f"WITH {HYBRID} SELECT path, {rounded('traditional_score', 'dl_score', 'hybrid_score', 'hybrid_severity')}, CASE WHEN hybrid_score >= 80 THEN 'Excellent' WHEN hybrid_score >= 60 THEN 'Good' WHEN hybrid_score >= 40 THEN 'Fair' ELSE 'Poor' END AS hybrid_category FROM hy",
    "hybrid_stats": f"WITH {HYBRID} SELECT count(*) AS n, " + ", ".join(f"round(avg({c}), 6) AS {c}_mean, round(median({c}), 6) AS {c}_median, round(stddev_pop({c}), 6) AS {c}_std" for c in ("traditional_score", "dl_score", "hybrid_score")) + " FROM hy",
    "method_correlation": f"WITH {HYBRID} SELECT {corr('traditional_score', 'dl_score')} AS traditional_dl, {corr('traditional_score', 'hybrid_score')} AS traditional_hybrid, {corr('dl_score', 'hybrid_score')} AS dl_hybrid FROM hy",
    "select_first": "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 20",
    "select_last": "SELECT doc_id, source FROM documents ORDER BY doc_id DESC LIMIT 20",
    "select_random": "SELECT doc_id, source FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 20",
    "label_join": "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "label_missing": "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
    "training_labels": f"WITH {SCORED} SELECT split_part(path, '/', 2) AS filename, round(overall_score, 6) AS quality_score, round(blue_water_problem_severity, 6) AS blue_water_severity, round(feature_usefulness_score, 6) AS feature_usefulness FROM ok",
    "hybrid_csv": f"""WITH {HYBRID} SELECT path AS filename, CAST(hybrid_score AS VARCHAR) IS NOT NULL AS scored, CASE WHEN hybrid_score >= 80 THEN 'Excellent' WHEN hybrid_score >= 60 THEN 'Good' WHEN hybrid_score >= 40 THEN 'Fair' ELSE 'Poor' END AS usability_category,
      round(traditional_score, 6) AS traditional_score, round(dl_score, 6) AS deep_learning_score, round(hybrid_score, 6) AS hybrid_score, round(traditional_score / 2, 6) AS traditional_feature_usefulness, round(ts, 6) AS traditional_blue_water_severity FROM hy JOIN own USING (path)""",
    "csv_projection": f"WITH {SCORED} SELECT split_part(path, '/', 2) AS filename, CASE WHEN error IS NULL THEN printf('%.4f', CAST(round(CAST(round(overall_score, 9) AS DECIMAL(20, 9)), 4) AS DOUBLE)) ELSE 'ERROR' END AS overall_score, usability_category, round(feature_usefulness_score, 6) AS feature_usefulness, {rounded('marine_science_value', 'blue_water_problem_severity', 'blue_water_severity', 'turbidity_score', 'visibility_score', 'rms_contrast', 'sharpness_gradient', 'edge_density', 'uciqe_score', 'uiqm_score')} FROM scored",
    "web_csv": f"WITH {SCORED} SELECT split_part(path, '/', 2) AS filename, printf('%.2f', CAST(round(CAST(round(overall_score, 9) AS DECIMAL(20, 9)), 2) AS DOUBLE)) AS overall_score, usability_category, printf('%.2f', CAST(round(CAST(round(feature_usefulness_score, 9) AS DECIMAL(20, 9)), 2) AS DOUBLE)) AS feature_usefulness, printf('%.2f', CAST(round(CAST(round(marine_science_value, 9) AS DECIMAL(20, 9)), 2) AS DOUBLE)) AS marine_science_value, printf('%.2f', CAST(round(CAST(round(blue_water_problem_severity, 9) AS DECIMAL(20, 9)), 2) AS DOUBLE)) AS blue_water_severity, printf('%.3f', CAST(round(CAST(round(visibility_score, 9) AS DECIMAL(20, 9)), 3) AS DOUBLE)) AS visibility_score FROM ok",
    "video_scan": f"""WITH {tiles(8)}, f AS (SELECT image_id // {MOST_TILES} AS video_id, image_id % {MOST_TILES} AS frame_idx, avg(b) AS b, avg(g) AS g, avg(r) AS r FROM px GROUP BY image_id)
      SELECT video_id, frame_idx, total_frames, round(frame_idx / 25.0, 6)::DOUBLE AS t, round(b, 6) AS blue_channel_mean, round(g, 6) AS green_channel_mean, round(r, 6) AS red_channel_mean
      FROM (SELECT *, count(*) OVER (PARTITION BY video_id) AS total_frames FROM f) WHERE frame_idx % 2 = 0 AND frame_idx < 8""",
    "edge_overlay": f"""WITH RECURSIVE {tiles()}, {canny('gp', 27, 'c')} SELECT p.image_id, count(e.y) AS edge_pixels, round(avg(CASE WHEN e.y IS NULL THEN b ELSE 0 END), 6) AS mean_b,
      round(avg(CASE WHEN e.y IS NULL THEN g ELSE 255 END), 6) AS mean_g, round(avg(CASE WHEN e.y IS NULL THEN r ELSE 255 END), 6) AS mean_r
      FROM px p LEFT JOIN cedges e ON e.image_id = p.image_id AND e.y = p.y AND e.x = p.x GROUP BY p.image_id""",
    "panel_histogram": f"WITH {tiles()}, {histogram({'b': 'b', 'g': 'g', 'r': 'r'})} SELECT image_id, channel, v, n, round(n / max(n) OVER (PARTITION BY image_id, channel), 6) AS height FROM hist",
    "panel_indicators": bars({"severity": "blue_water_severity * 100", "turbidity": "turbidity_score * 100", "temperature": f"{share('color_temperature', 3)} * 100", "dominance": "(blue_dominance + 0.5) * 100"}),
    "panel_contrast": bars({"rms": "rms_contrast * 100", "michelson": "michelson_contrast * 100", "local": f"{share('local_contrast', 50)} * 100", "gradient": f"{share('sharpness_gradient', 30)} * 100"}),
    "panel_scores": bars({"overall": "overall_score", "features": "feature_usefulness_score", "science": "marine_science_value"}),
    "json_fields": "SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY key",
    "event_windows": "SELECT date_trunc('hour', ts) AS hour, count(*) AS n, round(avg(least(100.0::DOUBLE, value)), 6) AS mean_score, round(min(least(100.0::DOUBLE, value)), 6) AS min_score FROM events GROUP BY 1",
}


def finely(name: str) -> str:
    """The query with its numbers as they are, but for the last digits."""
    return "(" + SQL[name].replace(", 6) AS ", ", 14) AS ") + ")"


#: The transform of 27 x 27 pixels: rows, then columns; sizes in the disc of low frequencies around zero, and outside.
BLUR_27 = f"""(WITH {tiles()}, across AS MATERIALIZED (SELECT image_id, y, u, sum(v * cos(2 * pi() * u * x / 27)) AS re, -sum(v * sin(2 * pi() * u * x / 27)) AS im FROM gp, range(27) t(u) GROUP BY image_id, y, u),
    whole AS (SELECT image_id, u, w, sum(re * cos(2 * pi() * w * y / 27) + im * sin(2 * pi() * w * y / 27)) AS re, sum(im * cos(2 * pi() * w * y / 27) - re * sin(2 * pi() * w * y / 27)) AS im FROM across, range(27) t(w) GROUP BY image_id, u, w),
    sized AS (SELECT image_id, sqrt(re * re + im * im) AS m, pow((u + 13) % 27 - 13, 2) + pow((w + 13) % 27 - 13, 2) < 9 AS low FROM whole)
    SELECT image_id, tanh(sum(CASE WHEN low THEN m END) / (sum(CASE WHEN NOT low THEN m END) + {EPS}) / 100) AS blur_estimate FROM sized GROUP BY image_id)"""
BOXES_27 = f"(WITH {tiles()}, {box_std('std15', 'gp', 15, 27)}, {box_std('std9', 'gp', 9, 27)} SELECT image_id, a.v AS local_contrast, b.v AS texture_complexity FROM std15 a JOIN std9 b USING (image_id))"
CHANNELS_27 = "(SELECT image_id, " + ", ".join(f"max(CASE WHEN channel = '{c}' THEN {v} END) AS {n}_{c}" for v, n in (("uniformity", "histogram_uniformity"), ("dynamic_range", "dynamic_range")) for c in "bgr") + f" FROM {finely('histogram_distribution')} GROUP BY image_id)"
#: Every metric of every tile from the queries of its parts; tiles of 27 pixels have no patch of 32.
PARTS_27 = ["colour_cast", "relational_kernels", "uicm", "uiqm_parts", "sharpness", "harris_corner_density", "canny_edge_density", "multi_scale_edge_density", "fast_keypoints"]


def joined(parts: list[str]) -> str:
    return parts[0] + " a0 " + " ".join(f"JOIN {p} a{i} USING (image_id)" for i, p in enumerate(parts[1:], 1))


ASSESSED = f"""base AS (SELECT * EXCLUDE (blue_dominance, green_dominance, blue_green_ratio, blue_water_severity, color_temperature, uicm, uism, uiconm), 0.0::DOUBLE AS weber_contrast, NULL AS error,
      0.0282 * uicm + 0.2953 * uism + 3.5753 * uiconm AS uiqm_score FROM {joined([*map(finely, PARTS_27), BLUR_27, BOXES_27, CHANNELS_27])}), {SCORES}"""
SQL |= {
    "tile_assessment": f"WITH {ASSESSED} SELECT image_id, {rounded(*METRIC_NAMES, 'overall_score', 'blue_water_problem_severity')}, round({COLOUR_QUALITY}, 6) AS colour_quality, usability_category, {RECOMMENDATIONS} AS recommendations, {WARNINGS} AS warnings FROM ok",
    "flagship": f"WITH {ASSESSED} SELECT usability_category, count(*) AS n, " + ", ".join(f"round(avg({c}), 4) AS mean_{c}" for c in ("overall_score", "blue_water_problem_severity", "visibility_score", "uiqm_score")) + " FROM ok GROUP BY usability_category",
}


def half_up(x: str, digits: int) -> str:
    return f"CAST(round(CAST(round({x}, 9) AS DECIMAL(20, 9)), {digits}) AS DOUBLE)"


MEANS = "round(avg(b), 6) AS blue_channel_mean, round(avg(g), 6) AS green_channel_mean, round(avg(r), 6) AS red_channel_mean"
HALVED = f"""WITH {tiles(26)}, small AS (SELECT image_id, round_even(avg(b), 0) AS b, round_even(avg(g), 0) AS g, round_even(avg(r), 0) AS r FROM px GROUP BY image_id, y // 2, x // 2) SELECT image_id, {MEANS} FROM small GROUP BY image_id"""
LISTED = lambda title, expr: f"'{title}' || coalesce((SELECT string_agg(chr(10) || i || '. ' || t, '' ORDER BY i) FROM (SELECT unnest(string_split({expr}, '; ')) AS t, generate_subscripts(string_split({expr}, '; '), 1) AS i)), '')"
FEATURES_27 = {"edges": "edge_density * 500", "corners": "corner_density * 10000", "keypoints": "keypoint_density * 10", "texture": "texture_complexity / 2"}
FEATURED_27 = f"f AS (SELECT * FROM {joined([*map(finely, ('harris_corner_density', 'canny_edge_density', 'fast_keypoints')), BOXES_27])})"
SQL |= {
    "panel_channels": bars({n: f"{n}_channel_mean" for n in ("blue", "green", "red")}),
    "panel_underwater": bars({"uciqe": "uciqe_score * 100", "uiqm": f"{share('uiqm_score', 3)} * 100", "visibility": "visibility_score * 100", "clarity": "(1 - turbidity_score) * 100"}),
    "panel_gauges": bars({"features": "feature_usefulness_score", "science": "marine_science_value", "clarity": "(1 - turbidity_score) * 100"}),
    "panel_features": f"WITH {FEATURED_27} " + " UNION ALL ".join(f"SELECT image_id, '{k}' AS bar, round({e}, 6) AS height FROM f" for k, e in FEATURES_27.items()),
    "panel_overlay": SQL["labels_and_colours"].replace("SELECT path, CASE WHEN blue_water_problem_severity", "SELECT path, round(overall_score, 6) AS overall_score, usability_category, blue_water_severity > 0.5 AS blue_flag, CASE WHEN blue_water_problem_severity").replace(
        "CASE WHEN blue_water_problem_severity >= 7 THEN 'Severe' WHEN blue_water_problem_severity >= 5 THEN 'Moderate' WHEN blue_water_problem_severity >= 3 THEN 'Mild' ELSE 'Minimal' END AS severity_label,", ""),
    "lab_scatter": f"WITH {tiles()}, {LAB} SELECT image_id, y, x, l AS lab_l, a AS lab_a, bb AS lab_b FROM lab",
    "survey_files": f"WITH {tiles()} SELECT image_id, 'survey' || (image_id % 3) AS survey, 27 AS height, 27 AS width, true AS listed, {MEANS} FROM px GROUP BY image_id",
    "scaled_read": HALVED,
    "bounded_read": HALVED,
    "model_batches": f"WITH {tiles()} SELECT image_id, round(sum(b + g + r) / 2187.0::DOUBLE, 6) AS dl_score, round(sum(r) / greatest(sum(b + g + r), 1)::DOUBLE, 6) AS dl_severity FROM px GROUP BY image_id",
    "json_sink": f"WITH {SCORED} SELECT path, split_part(path, '/', 1) AS survey, error, round(overall_score, 6) AS overall_score, usability_category FROM scored",
    "csv_sink": f"WITH {SCORED} SELECT split_part(path, '/', 2) AS filename, CASE WHEN error IS NOT NULL THEN 'ERROR' END AS failed, {rounded('overall_score', 'visibility_score')}, usability_category FROM scored",
    "model_csv": f"WITH {HYBRID} SELECT 'b' || path AS filename, 'a/b' || path AS filepath, d AS overall_score, ds AS dl_severity FROM model WHERE path % 7 <> 0",
    "example_csv": f"WITH {SCORED} SELECT split_part(path, '/', 2) AS filename, usability_category, " + ", ".join(f"{half_up(c, 2)} AS {n}" for c, n in (
        ("overall_score", "overall_score"), ("feature_usefulness_score", "feature_usefulness"), ("marine_science_value", "marine_science_value"), ("blue_water_problem_severity", "blue_water_severity"))) + " FROM ok",
    "report_text": f"""WITH {SCORED}, told AS (SELECT *, {RECOMMENDATIONS} AS advice, {WARNINGS} AS warned FROM ok)
      SELECT path, concat_ws(chr(10), 'IMAGE QUALITY REPORT', printf('%-24s%s', 'Category', usability_category), """ + ", ".join(f"printf('{label:<24}{f}', {half_up(c, int(f[2]))})" for label, c, f in (
        ("Overall score", "overall_score", "%.1f"), ("Feature usefulness", "feature_usefulness_score", "%.1f"), ("Marine science value", "marine_science_value", "%.1f"), ("Blue water (0-10)", "blue_water_problem_severity", "%.1f"),
        ("Visibility", "visibility_score", "%.3f"), ("Turbidity", "turbidity_score", "%.3f"))) + f""", {LISTED('Recommendations', 'advice')}, {LISTED('Warnings', "nullif(warned, '')")}) AS report,
      printf('%s (%.1f/100): features %.1f, science %.1f, blue water %.1f/10', usability_category, {', '.join(half_up(c, 1) for c in ('overall_score', 'feature_usefulness_score', 'marine_science_value', 'blue_water_problem_severity'))}) AS summary FROM told""",
    "filter_json": f"""WITH {FRAMES}, v AS (SELECT video_id, count(*) AS total_frames, count(*) FILTER (WHERE {KEEP}) AS frames_kept, round(avg(score), 6) AS mean_score, CAST(count(*) AS INTEGER) AS records, max(frame_idx) AS last_frame FROM fr GROUP BY video_id)
      SELECT video_id, total_frames, frames_kept, mean_score, records, last_frame, {half_up('score', 2)} AS last_score, {KEEP} AS last_kept FROM v JOIN fr USING (video_id) WHERE frame_idx = last_frame""",
    "valid_rows": f"WITH {SCORED} SELECT path, round(overall_score, 6) AS overall_score FROM ok JOIN orders ON o_orderkey = CAST(regexp_extract(path, 'img([0-9]+)', 1) AS BIGINT) WHERE o_custkey % 5 <> 0",
    "select_limit": SQL["select_first"],
    "select_all": "SELECT doc_id, source FROM documents",
}

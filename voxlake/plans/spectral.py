"""Fourier-domain queries; the SQL twins use plain cosine and sine sums."""

from pyspark.sql import functions as F

from voxlake.operators import spectral as sp
from voxlake.plans.histogram import float_hist_sql, otsu_sql
from voxlake.plans.registry import query
from voxlake.plans.score import cc_sql
from voxlake.plans.voxel import VOX, r6


def dft_sql(src: str, out: str, axis: str, n: int, sign: int, keys: str = "volume_id") -> str:
    """One axis of a transform of (re, im) rows; sign -1 forward, +1 back (with 1/n)."""
    ks = ", ".join(f"s.{k.strip()}" for k in keys.split(","))
    others = ", ".join(f"s.{a}" for a in "zyx" if a != axis)
    arg = f"(2 * pi() * ((k.k * s.{axis}) % {n}) / {n})"
    scale = f"/ {n}" if sign > 0 else ""
    c, t = f"cos{arg}", f"({sign} * sin{arg})"
    return f"""{out} AS (SELECT {ks}, {others}, CAST(k.k AS INT) AS {axis}, sum(re * {c} - im * {t}) {scale} AS re, sum(re * {t} + im * {c}) {scale} AS im
  FROM {src} s, range({n}) k(k) GROUP BY {ks}, {others}, k.k)"""


_START = f"d0 AS (SELECT {VOX}, v AS re, CAST(0 AS DOUBLE) AS im FROM fx_dense)"
_PLANE = f"{_START}, {dft_sql('d0', 'd1', 'x', 12, -1)}, {dft_sql('d1', 'sp', 'y', 12, -1)}"
_SPACE = f"{_START}, {dft_sql('d0', 'd1', 'x', 12, -1)}, {dft_sql('d1', 'd2', 'y', 12, -1)}, {dft_sql('d2', 'sp', 'z', 7, -1)}"
_C = {a: f"(({a} + {n // 2}) % {n} - {n // 2})" for a, n in (("z", 7), ("y", 12), ("x", 12))}


def radial_sql(keys: str, z: bool) -> str:
    zz = f" + pow({_C['z']} * 7 / 12.0::DOUBLE, 2)" if z else ""
    return f"""rp AS (SELECT {keys}, sqrt({_C['x']} * {_C['x']} + {_C['y']} * {_C['y']}{zz}) AS d, re * re + im * im AS p FROM sp WHERE re * re + im * im > 0),
rm AS (SELECT {keys}, CAST(floor(d) AS INT) AS radius, avg(p) AS power FROM rp GROUP BY ALL),
rb AS (SELECT {keys}, CAST(unnest(range(CAST(ceil(max(d)) AS BIGINT))) AS INT) AS radius FROM rp GROUP BY {keys}),
rc AS (SELECT {keys}, radius, coalesce(power, 0) AS power FROM rb LEFT JOIN rm USING ({keys}, radius))"""


def knee_sql(keys: str) -> str:
    return f"""ka AS (SELECT {keys}, radius, (radius - min(radius) OVER w) / (max(radius) OVER w - min(radius) OVER w)::DOUBLE AS nx, (power - min(power) OVER w) / (max(power) OVER w - min(power) OVER w) AS ny,
  1.0::DOUBLE / (count(*) OVER w - 1) AS step FROM rc WINDOW w AS (PARTITION BY {keys})),
kb AS (SELECT *, 1 - ny - nx AS d FROM ka),
kc AS (SELECT *, lead(d) OVER w AS nxt, d >= coalesce(lag(d) OVER w, d) AND d >= coalesce(lead(d) OVER w, d) AS mx, d <= coalesce(lag(d) OVER w, d) AND d <= coalesce(lead(d) OVER w, d) AS mn
  FROM kb WINDOW w AS (PARTITION BY {keys} ORDER BY radius)),
kd AS (SELECT *, last_value(CASE WHEN mn THEN 0 WHEN mx THEN d - step END IGNORE NULLS) OVER w AS lim, last_value(CASE WHEN mx THEN radius END IGNORE NULLS) OVER w AS peak_at
  FROM kc WINDOW w AS (PARTITION BY {keys} ORDER BY radius ROWS UNBOUNDED PRECEDING)),
ke AS (SELECT {keys}, arg_min(peak_at, radius) AS knee FROM kd WHERE peak_at IS NOT NULL AND nxt < lim GROUP BY {keys}),
kn AS (SELECT {keys}, knee FROM (SELECT DISTINCT {keys} FROM rc) LEFT JOIN ke USING ({keys}))"""


@query("q_spectrum", f"WITH {_PLANE} SELECT {VOX}, round(sqrt(re * re + im * im), 5) AS size FROM sp")
def q_spectrum(fx):
    s = sp.fourier(fx.sparse, fx.volumes)
    return s.select("volume_id", "z", "y", "x", F.round(sp.magnitude(), 5).alias("size"))


@query("q_radial_mean", f"WITH {_PLANE}, {radial_sql('volume_id, z', False)} SELECT volume_id, z, radius, round(power, 3) AS power FROM rc")
def q_radial_mean(fx):
    return sp.radial_mean(sp.fourier(fx.sparse, fx.volumes)).withColumn("power", F.round("power", 3))


@query("q_radial_mean_volume", f"WITH {_SPACE}, {radial_sql('volume_id', True)} SELECT volume_id, radius, round(power, 3) AS power FROM rc")
def q_radial_mean_volume(fx):
    s = sp.fourier(fx.sparse, fx.volumes, sp.SPACE)
    return sp.radial_mean(s, ["volume_id"]).withColumn("power", F.round("power", 3))


@query("q_knee", f"WITH {_PLANE}, {radial_sql('volume_id, z', False)}, {knee_sql('volume_id, z')} SELECT volume_id, z, knee FROM kn")
def q_knee(fx):
    return sp.knee(sp.radial_mean(sp.fourier(fx.sparse, fx.volumes)))


_HIGH = f"""{_PLANE}, {radial_sql('volume_id, z', False)}, {knee_sql('volume_id, z')},
hp AS (SELECT {VOX}, re, im FROM sp JOIN kn USING (volume_id, z) WHERE sqrt({_C['x']} * {_C['x']} + {_C['y']} * {_C['y']}) >= coalesce(knee, 0)),
{dft_sql('hp', 'h1', 'x', 12, 1)}, {dft_sql('h1', 'h2', 'y', 12, 1)}, hv AS (SELECT {VOX}, round(sqrt(re * re + im * im), 9) AS v FROM h2)"""


@query("q_highpass_map", f"WITH {_HIGH} SELECT {VOX}, round(v, 6) AS v FROM hv")
def q_highpass_map(fx):
    return r6(sp.high_frequency_map(fx.sparse, fx.volumes, fx.parts))


@query(
    "q_highpass",
    f"""WITH {_HIGH}, hq AS (SELECT volume_id, z, quantile_cont(v, 0.9) AS t FROM hv GROUP BY ALL), hm AS (SELECT {VOX}, 1 AS label FROM hv JOIN hq USING (volume_id, z) WHERE v > t),
{cc_sql('hm', 2, 'volume_id', 'hc')}, hb AS (SELECT volume_id, object_id FROM hc GROUP BY ALL HAVING count(*) > 3) SELECT {VOX}, 1 AS label FROM hc JOIN hb USING (volume_id, object_id)""",
)
def q_highpass(fx):
    # Few frequencies make many equal values; the comparison rounds, so that they are equal for either sum.
    field = sp.high_frequency_map(fx.sparse, fx.volumes, fx.parts).withColumn("v", F.round("v", 9))
    return sp.field_objects(field, fx.volumes, 90.0, 3)


FREQS, SIGMA = (1.0, 3.0, 5.0), 1.5
_R = f"sqrt({_C['z']} * {_C['z']} + {_C['y']} * {_C['y']} + {_C['x']} * {_C['x']})"
_PHASE = f"""{_SPACE}, ff AS (SELECT f.f AS f0 FROM (VALUES (1.0::DOUBLE), (3.0::DOUBLE), (5.0::DOUBLE)) f(f)),
gb AS (SELECT volume_id, f0, z, y, x, re, im, exp(-pow(ln((CASE WHEN {_R} = 0 THEN 1 ELSE {_R} END) / f0), 2) / (2 * pow(ln(1.5::DOUBLE), 2))) AS g FROM sp, ff),
gg AS (SELECT volume_id, f0, z, y, x, re * g AS re, im * g AS im FROM gb),
{dft_sql('gg', 'g1', 'x', 12, 1, 'volume_id, f0')}, {dft_sql('g1', 'g2', 'y', 12, 1, 'volume_id, f0')}, {dft_sql('g2', 'g3', 'z', 7, 1, 'volume_id, f0')},
gp AS (SELECT {VOX}, round(sqrt(pow(sum(cos(atan2(im, re))), 2) + pow(sum(sin(atan2(im, re))), 2)) / 3, 9) AS v FROM g3 GROUP BY ALL)"""


def _phase(fx):
    """The field, rounded for the comparison: its equal values are sums in another order in the twin."""
    return sp.phase_congruency(fx.sparse, fx.volumes, FREQS, SIGMA, fx.parts).withColumn("v", F.round("v", 9))


@query("q_phase_map", f"WITH {_PHASE} SELECT {VOX}, round(v, 6) AS v FROM gp")
def q_phase_map(fx):
    return r6(sp.phase_congruency(fx.sparse, fx.volumes, FREQS, SIGMA, fx.parts))


@query("q_phase_congruency", f"WITH {_PHASE}, gq AS (SELECT volume_id, quantile_cont(v, 0.4) AS t FROM gp GROUP BY ALL) SELECT {VOX}, 1 AS label FROM gp JOIN gq USING (volume_id) WHERE v > t")
def q_phase_congruency(fx):
    return sp.field_foreground(_phase(fx), fx.sparse, fx.volumes, 40.0, False, fx.parts)


_LOW = f"""{_SPACE}, {radial_sql('volume_id', True)}, {knee_sql('volume_id')},
lp AS (SELECT {VOX}, re, im, CASE WHEN knee IS NULL THEN 1 WHEN knee = 0 THEN CASE WHEN {_R} = 0 THEN 1 ELSE 0 END ELSE exp(-{_R} * {_R} / (2.0::DOUBLE * knee * knee)) END AS g FROM sp JOIN kn USING (volume_id)),
lg AS (SELECT {VOX}, re * g AS re, im * g AS im FROM lp), {dft_sql('lg', 'l1', 'x', 12, 1)}, {dft_sql('l1', 'l2', 'y', 12, 1)}, {dft_sql('l2', 'l3', 'z', 7, 1)},
lv AS (SELECT {VOX}, sqrt(re * re + im * im) AS v FROM l3)"""


@query("q_lowpass_map", f"WITH {_LOW} SELECT {VOX}, round(v, 6) AS v FROM lv")
def q_lowpass_map(fx):
    return r6(sp.low_pass(fx.sparse, fx.volumes, fx.parts))


@query(
    "q_phase_foreground",
    f"""WITH {_PHASE}, gq AS (SELECT volume_id, quantile_cont(v, 0.3) AS t FROM gp GROUP BY ALL), gm AS (SELECT {VOX} FROM gp JOIN gq USING (volume_id) WHERE v > t),
{_LOW[len(_SPACE) + 2:]}, {float_hist_sql('lv', 'volume_id, z', 'lh')}, {otsu_sql('lh', 'volume_id, z', 'lo')}
SELECT {VOX}, 1 AS label FROM gm JOIN lv USING (volume_id, z, y, x) JOIN lo USING (volume_id, z) WHERE lv.v > threshold""",
)
def q_phase_foreground(fx):
    return sp.field_foreground(_phase(fx), fx.sparse, fx.volumes, 30.0, True, fx.parts)

"""DuckDB SQL for the registered queries: transforms as direct sums, iterations unrolled, folds as recursion."""

from __future__ import annotations

from ..operators import pitch

TAU = "6.283185307179586::DOUBLE"

EV = """
ev1 AS (SELECT date_trunc('hour', min(ts)) AS first FROM events),
ev0 AS (SELECT event_type AS track, date_diff('hour', (SELECT first FROM ev1), date_trunc('hour', ts)) AS i, sum(value) AS s, count(*)::DOUBLE AS c
        FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL GROUP BY ALL),
grid AS (SELECT track, i FROM (SELECT DISTINCT track FROM ev0), (SELECT unnest(range(0, (SELECT max(i) + 1 FROM ev0))) AS i)),
ev AS (SELECT track, 0 AS ch, i, coalesce(s, 0)::DOUBLE AS x FROM grid LEFT JOIN ev0 USING (track, i)
       UNION ALL SELECT track, 1, i, coalesce(c, 0)::DOUBLE FROM grid LEFT JOIN ev0 USING (track, i)),
mono AS (SELECT track, i, avg(x) AS x FROM ev GROUP BY ALL),
size AS (SELECT track, max(i) + 1 AS n FROM ev GROUP BY 1)"""

ORD = """
od0 AS (SELECT o_orderstatus AS track, o_orderdate::DATE AS day, sum(o_totalprice) / 1e6::DOUBLE AS x FROM orders GROUP BY ALL),
ord AS (SELECT track, row_number() OVER (PARTITION BY track ORDER BY day) - 1 AS i, x FROM od0)"""

EMB = """
em0 AS (SELECT label::VARCHAR AS track, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t, embedding FROM embeddings),
emb AS (SELECT track, t, b, abs(embedding[b + 1]::DOUBLE) AS mag FROM em0, (SELECT unnest(range(0, 64)) AS b))"""

PARTS = """
parts AS (SELECT c_nationkey::VARCHAR AS track, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS idx,
                 ['percussive', 'harmonic', 'mixed'][c_custkey % 3 + 1] AS kind, c_acctbal AS energy,
                 CASE WHEN c_custkey % 5 = 0 THEN '—' ELSE 'named' END AS name, CAST(c_custkey % 12 AS INTEGER) AS tonic FROM customer)"""


def r(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"


def spectrum(signal: str, n: int, hop: int, name: str = "st") -> str:
    """CTEs of the cells (track, t, b, re, im, mag) of mono rows (track, i, x)."""
    return f"""
{name}_n AS (SELECT track, max(i) + 1 AS n FROM {signal} GROUP BY 1),
{name}_t AS (SELECT track, unnest(range(0, CASE WHEN n < {n} THEN 0 ELSE (n - {n}) // {hop} + 1 END)) AS t FROM {name}_n),
{name}_f AS MATERIALIZED (SELECT track, t, k, x * (0.5::DOUBLE - 0.5::DOUBLE * cos({TAU} * k / {n})) AS xw FROM {name}_t JOIN {signal} USING (track), (SELECT unnest(range(0, {n})) AS k) WHERE i = t * {hop} + k),
{name} AS MATERIALIZED (SELECT track, t, b, re, im, sqrt(re * re + im * im) AS mag FROM
       (SELECT track, t, b, sum(xw * cos({TAU} * ((b * k) % {n}) / {n})) AS re, -sum(xw * sin({TAU} * ((b * k) % {n}) / {n})) AS im
        FROM {name}_f, (SELECT unnest(range(0, {n // 2 + 1})) AS b) GROUP BY ALL))"""


def inverse(cells: str, n: int, hop: int, name: str = "ola") -> str:
    """CTE of samples (track, i, x) from cells (track, t, b, re, im)."""
    return f"""
{name}_y AS (SELECT track, t, k, sum((CASE WHEN b IN (0, {n // 2}) THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END) * (re * cos({TAU} * ((b * k) % {n}) / {n}) - im * sin({TAU} * ((b * k) % {n}) / {n}))) / {n} AS y
       FROM {cells}, (SELECT unnest(range(0, {n})) AS k) GROUP BY ALL),
{name}_s AS (SELECT track, t * {hop} + k AS i, sum(y * w) AS s, sum(w * w) AS q FROM (SELECT *, 0.5::DOUBLE - 0.5::DOUBLE * cos({TAU} * k / {n}) AS w FROM {name}_y) GROUP BY ALL),
{name} AS MATERIALIZED (SELECT track, i, CASE WHEN q > 1e-8 THEN s / q ELSE s END AS x FROM {name}_s)"""


def vocoder(n: int, hop_out: int, name: str = "pv") -> str:
    hop = n // 4
    return (
        spectrum("mono", n, hop, "vs")
        + f""",
{name}_p AS (SELECT *, atan2(round(im, 9) + 0.0, round(re, 9) + 0.0) AS phase FROM vs),
{name}_r AS (SELECT *, phase - lag(phase) OVER w - {TAU} * b / {n} * {hop} AS raw FROM {name}_p WINDOW w AS (PARTITION BY track, b ORDER BY t)),
{name}_d AS (SELECT *, coalesce(({TAU} * b / {n} + (raw - {TAU} * floor(raw / {TAU} + 0.5::DOUBLE)) / {hop}) * {hop_out}, phase) AS step FROM {name}_r),
{name}_a AS (SELECT *, sum(step) OVER (PARTITION BY track, b ORDER BY t ROWS UNBOUNDED PRECEDING) AS psi FROM {name}_d),
{name}_c AS MATERIALIZED (SELECT track, t, b, mag * cos(psi) AS re, mag * sin(psi) AS im FROM {name}_a),"""
        + inverse(f"{name}_c", n, hop_out, name)
    )


def resampled(signal: str, lengths: str) -> str:
    """CTE rs (track, i, x); lengths has (track, length)."""
    return f"""
rs_n AS (SELECT track, max(i) + 1 AS n FROM {signal} GROUP BY 1),
rs_g AS (SELECT track, n, unnest(range(0, length)) AS j, length FROM rs_n JOIN {lengths} USING (track)),
rs_p AS (SELECT *, floor(pos)::BIGINT AS i0, least(n - 1, floor(pos)::BIGINT + 1) AS i1 FROM (SELECT *, CASE WHEN length = 1 THEN 0.0::DOUBLE ELSE j * ((n - 1)::DOUBLE / greatest(1, length - 1)) END AS pos FROM rs_g)),
rs AS (SELECT p.track, j AS i, a.x * (1 - (pos - i0)) + b.x * (pos - i0) AS x FROM rs_p p JOIN {signal} a ON p.track = a.track AND p.i0 = a.i JOIN {signal} b ON p.track = b.track AND p.i1 = b.i)"""


def prng(seed: int, n: str) -> str:
    h = "::HUGEINT"
    m = "4294967295::HUGEINT"
    a = f"(({seed}{h} + ({n} + 1){h} * 1831565813{h}) & {m})"
    t1 = f"((xor({a}, {a} >> 15) * ({a} | 1{h})) & {m})"
    t2 = f"xor({t1}, ({t1} + ((xor({t1}, {t1} >> 7) * ({t1} | 61{h})) & {m})) & {m})"
    return f"(xor({t2}, {t2} >> 14)::DOUBLE / 4294967296.0::DOUBLE)"


def nmf(iterations: int = 3, rank: int = 2, cells: str = "st", p: str = "", seed: int = 1) -> str:
    """CTEs wN (track, b, k, x) and hN (track, k, t, x), behind p, of ``rank`` components over the cells."""
    out = f""",
{p}dim AS (SELECT track, max(b) + 1 AS nb, max(t) + 1 AS nt FROM {cells} GROUP BY 1),
{p}ks AS (SELECT unnest({list(range(rank))}) AS k),
{p}w0 AS MATERIALIZED (SELECT track, b, k, 0.9::DOUBLE * {prng(seed, f"(b * {rank} + k)")} + 0.1::DOUBLE AS x FROM (SELECT track, unnest(range(0, nb)) AS b FROM {p}dim), {p}ks),
{p}h0 AS MATERIALIZED (SELECT track, k, t, 0.9::DOUBLE * {prng(seed, f"(nb * {rank} + k * nt + t)")} + 0.1::DOUBLE AS x FROM (SELECT track, nb, nt, unnest(range(0, nt)) AS t FROM {p}dim), {p}ks)"""
    for n in range(iterations):
        for step, (wn, hn) in enumerate(((f"{p}w{n}", f"{p}h{n}"), (f"{p}w{n}", f"{p}h{n + 1}"))):
            ratio = f"{p}q{n}{step}"
            out += f""",
{ratio} AS MATERIALIZED (SELECT v.track, v.b, v.t, v.mag / (e.v + 1e-12::DOUBLE) AS q FROM {cells} v JOIN
   (SELECT w.track, w.b, h.t, sum(w.x * h.x) AS v FROM {wn} w JOIN {hn} h ON w.track = h.track AND w.k = h.k GROUP BY ALL) e ON v.track = e.track AND v.b = e.b AND v.t = e.t)"""
            if step == 0:
                out += f""",
{p}h{n + 1} AS MATERIALIZED (SELECT h.track, h.k, h.t, h.x * u.u / (s.s + 1e-12::DOUBLE) AS x FROM {hn} h
   JOIN (SELECT w.track, w.k, q.t, sum(w.x * q.q) AS u FROM {wn} w JOIN {ratio} q ON w.track = q.track AND w.b = q.b GROUP BY ALL) u ON h.track = u.track AND h.k = u.k AND h.t = u.t
   JOIN (SELECT track, k, sum(x) AS s FROM {wn} GROUP BY ALL) s ON h.track = s.track AND h.k = s.k)"""
            else:
                out += f""",
{p}w{n + 1} AS MATERIALIZED (SELECT w.track, w.b, w.k, w.x * u.u / (s.s + 1e-12::DOUBLE) AS x FROM {wn} w
   JOIN (SELECT h.track, h.k, q.b, sum(h.x * q.q) AS u FROM {hn} h JOIN {ratio} q ON h.track = q.track AND h.t = q.t GROUP BY ALL) u ON w.track = u.track AND w.k = u.k AND w.b = u.b
   JOIN (SELECT track, k, sum(x) AS s FROM {hn} GROUP BY ALL) s ON w.track = s.track AND w.k = s.k)"""
    return out


def shares_of(rank_masks: str, w: str, h: str, own: str = "1.0::DOUBLE", cells: str = "") -> str:
    """CTE (track, k, t, b, mask) of each component's part of what all of them make, times ``own`` of the joined cells."""
    joined = f" JOIN {cells} c ON w.track = c.track AND w.b = c.b AND h.t = c.t" if cells else ""
    return f""",
{rank_masks} AS (SELECT track, k, t, b, own * wh / (sum(wh) OVER (PARTITION BY track, t, b) + 1e-12::DOUBLE) AS mask FROM
   (SELECT w.track, w.k, h.t, w.b, {own} AS own, w.x * h.x AS wh FROM {w} w JOIN {h} h ON w.track = h.track AND w.k = h.k{joined}))"""


#: (track, ch, part, i, x) from ola, whose tracks are track#ch#part, and the place of each part by kind, loudness and number.
PLACED = """,
pa AS (SELECT split_part(o.track, '#', 1) AS track, split_part(o.track, '#', 2)::INTEGER AS ch, split_part(o.track, '#', 3) AS part, o.i, o.x FROM ola o JOIN size s ON split_part(o.track, '#', 1) = s.track WHERE o.i < s.n),
pe AS (SELECT track, part, avg(x * x) AS energy FROM pa WHERE ch = 0 GROUP BY ALL),
pl AS (SELECT track, part, CAST(row_number() OVER (PARTITION BY track ORDER BY part NOT LIKE 'percussive%', energy DESC, part) - 1 AS INTEGER) AS idx FROM pe)"""


ST = EV + "," + spectrum("mono", 64, 16)
FIT = ST + nmf(3)
COS = """,
cs AS (SELECT a.track, a.k AS i, b.k AS j, sum(a.x * b.x) / ((sqrt(sum(a.x * a.x)) + 1e-12::DOUBLE) * (sqrt(sum(b.x * b.x)) + 1e-12::DOUBLE)) AS cosine FROM w3 a JOIN w3 b ON a.track = b.track AND a.b = b.b AND a.k < b.k GROUP BY ALL),
wt AS (SELECT w.track, w.k, w.s * h.s AS weight FROM (SELECT track, k, sum(x) AS s FROM w3 GROUP BY ALL) w JOIN (SELECT track, k, sum(x) AS s FROM h3 GROUP BY ALL) h ON w.track = h.track AND w.k = h.k),
sh AS (SELECT track, k, weight / sum(weight) OVER (PARTITION BY track) AS share FROM wt)"""

#: Of three components: the pair that agrees most, the third with both, then the small ones; l is the first component of each one's group.
GROUPS3 = COS + """,
gc AS (SELECT track, max(cosine) FILTER (i = 0 AND j = 1) AS a, max(cosine) FILTER (i = 0 AND j = 2) AS b, max(cosine) FILTER (i = 1 AND j = 2) AS c FROM cs GROUP BY 1),
gs AS (SELECT track, max(share) FILTER (k = 0) AS s0, max(share) FILTER (k = 1) AS s1, max(share) FILTER (k = 2) AS s2 FROM sh GROUP BY 1),
gm AS (SELECT *, CASE WHEN greatest(a, b, c) < 0.85 THEN 'none' WHEN a >= b AND a >= c THEN '01' WHEN b >= c THEN '02' ELSE '12' END AS pair, least(s0, s1, s2) AS low FROM gc JOIN gs USING (track)),
gl AS (SELECT track, CASE pair
   WHEN '01' THEN CASE WHEN (b + c) / 2 >= 0.85 OR least(s0 + s1, s2) < 0.08 THEN [0, 0, 0] ELSE [0, 0, 2] END
   WHEN '02' THEN CASE WHEN (a + c) / 2 >= 0.85 OR least(s0 + s2, s1) < 0.08 THEN [0, 0, 0] ELSE [0, 1, 0] END
   WHEN '12' THEN CASE WHEN (a + b) / 2 >= 0.85 OR least(s1 + s2, s0) < 0.08 THEN [0, 0, 0] ELSE [0, 1, 1] END
   ELSE CASE WHEN low >= 0.08 THEN [0, 1, 2]
        WHEN s0 = low THEN CASE WHEN a >= b THEN CASE WHEN least(s0 + s1, s2) < 0.08 THEN [0, 0, 0] ELSE [1, 1, 2] END ELSE CASE WHEN least(s0 + s2, s1) < 0.08 THEN [0, 0, 0] ELSE [2, 1, 2] END END
        WHEN s1 = low THEN CASE WHEN a >= c THEN CASE WHEN least(s0 + s1, s2) < 0.08 THEN [0, 0, 0] ELSE [0, 0, 2] END ELSE CASE WHEN least(s1 + s2, s0) < 0.08 THEN [0, 0, 0] ELSE [0, 2, 2] END END
        ELSE CASE WHEN b >= c THEN CASE WHEN least(s0 + s2, s1) < 0.08 THEN [0, 0, 0] ELSE [0, 1, 0] END ELSE CASE WHEN least(s1 + s2, s0) < 0.08 THEN [0, 0, 0] ELSE [0, 1, 1] END END END END AS l FROM gm),
gk AS (SELECT track, k, dense_rank() OVER (PARTITION BY track ORDER BY l[k + 1]) - 1 AS part FROM gl, (SELECT unnest([0, 1, 2]) AS k))"""


def hpss(cells: str) -> str:
    return f""",
md AS (SELECT *, median(mag) OVER (PARTITION BY track, b ORDER BY t ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS h,
              median(mag) OVER (PARTITION BY track, t ORDER BY b ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS p FROM {cells}),
hp AS MATERIALIZED (SELECT track, t, b, mag, h * h / (h * h + p * p + 1e-12::DOUBLE) AS harmonic, p * p / (h * h + p * p + 1e-12::DOUBLE) AS percussive FROM md)"""


HPSS = EMB + hpss("emb")

ENV = ST + """,
fl AS (SELECT track, t, sum(greatest(0.0::DOUBLE, coalesce(ln(1 + mag) - ln(1 + before), 0.0::DOUBLE))) AS flux FROM (SELECT *, lag(mag) OVER (PARTITION BY track, b ORDER BY t) AS before FROM st) GROUP BY ALL),
env AS MATERIALIZED (SELECT track, t, greatest(0.0::DOUBLE, flux - avg(flux) OVER (PARTITION BY track ORDER BY t ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)) AS env FROM fl)"""

LAG = ENV + """,
en AS (SELECT track, CASE WHEN sum(env * env) > 0 THEN sum(env * env) ELSE 1.0::DOUBLE END AS energy FROM env GROUP BY 1),
lg AS (SELECT unnest(range(2, 21)) AS lag),
ac AS (SELECT a.track, lag, sum(a.env * b.env) AS ac FROM env a, lg JOIN env b ON a.track = b.track AND b.t = a.t - lag GROUP BY ALL),
sc AS (SELECT en.track, lg.lag, coalesce(ac.ac, 0.0::DOUBLE) / energy AS ac,
              coalesce(ac.ac, 0.0::DOUBLE) / energy * exp(-0.5::DOUBLE * pow(log2(240.0::DOUBLE / lg.lag / 40.0::DOUBLE), 2) / 0.81::DOUBLE) AS score
       FROM en CROSS JOIN lg LEFT JOIN ac ON en.track = ac.track AND lg.lag = ac.lag),
bl AS (SELECT track, lag, least(1.0::DOUBLE, ac) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY score DESC, lag) AS n FROM sc) WHERE n = 1)"""

BEAT = LAG + """,
ph AS (SELECT track, phase FROM (SELECT track, phase, row_number() OVER (PARTITION BY track ORDER BY s DESC, phase) AS n FROM (SELECT track, t % lag AS phase, sum(env) AS s FROM env JOIN bl USING (track) GROUP BY ALL)) WHERE n = 1),
pk AS (SELECT track, t, max(env) OVER (PARTITION BY track ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS peak FROM env),
sl AS (SELECT track, lag, phase, ((t - phase) // lag) % 4 AS slot, avg(peak) AS loud FROM pk JOIN bl USING (track) JOIN ph USING (track) WHERE t >= phase AND (t - phase) % lag = 0 GROUP BY ALL),
db AS (SELECT track, phase AS first_beat_frame, phase + slot * lag AS first_downbeat_frame FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY loud DESC, slot) AS n FROM sl) WHERE n = 1)"""

CHROMA = EMB + """,
pc AS (SELECT b, ((CAST(floor(69 + 12 * log2(b * 32.5::DOUBLE / 440.0::DOUBLE) + 0.5::DOUBLE) AS INTEGER) % 12) + 12) % 12 AS pc FROM (SELECT unnest(range(2, 63)) AS b)),
cm AS (SELECT track, pc, sum(mag) AS m FROM emb JOIN pc USING (b) GROUP BY ALL),
cg AS (SELECT track, pc, coalesce(m, 0.0::DOUBLE) AS m FROM (SELECT DISTINCT track FROM emb) CROSS JOIN (SELECT unnest(range(0, 12))::INTEGER AS pc) LEFT JOIN cm USING (track, pc)),
ch AS MATERIALIZED (SELECT track, pc, CASE WHEN sum(m) OVER w > 0 THEN m / sum(m) OVER w ELSE 0.0::DOUBLE END AS p FROM cg WINDOW w AS (PARTITION BY track)),
tn AS (SELECT track, 1.0::DOUBLE + sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0.0::DOUBLE END) / ln(12.0::DOUBLE) AS tonality FROM ch GROUP BY 1),
pr AS (SELECT 'major' AS mode, {major}::DOUBLE[] AS v UNION ALL SELECT 'minor', {minor}::DOUBLE[]),
ky AS (SELECT track, tonic, mode, coalesce(corr(p, v[(pc - tonic + 12) % 12 + 1]), 0.0::DOUBLE) AS r FROM ch, (SELECT unnest(range(0, 12))::INTEGER AS tonic), pr GROUP BY ALL),
dk AS (SELECT track, tonic, mode, {names}[tonic + 1] || ' ' || mode AS name, r AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY round(r, 12) DESC, tonic, mode) AS n FROM ky) WHERE n = 1)""".format(major=list(pitch.MAJOR), minor=list(pitch.MINOR), names=pitch.NAMES)

SIDES = """
sd AS (SELECT label::VARCHAR AS pair, vec_id AS idx, vec_id % 3 <> 0 AS tonal, embedding::DOUBLE[] AS v FROM embeddings),
ca AS MATERIALIZED (SELECT a.pair, a.idx AS a, b.idx AS b, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS similarity,
       CASE WHEN a.tonal THEN 'tonal' ELSE 'percussive' END AS basis FROM sd a JOIN sd b ON a.pair = b.pair AND a.tonal = b.tonal AND a.idx % 2 = 0 AND b.idx % 2 = 1{only})"""

GREEDY = """
WITH RECURSIVE""" + SIDES + """,
rk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY round(similarity, 12) DESC, a, b) AS n FROM ca),
go AS (SELECT pair, 0::BIGINT AS n, []::BIGINT[] AS ua, []::BIGINT[] AS ub, NULL::BIGINT AS a, NULL::BIGINT AS b, 0.0::DOUBLE AS similarity, '' AS basis FROM (SELECT DISTINCT pair FROM ca)
   UNION ALL SELECT go.pair, rk.n, CASE WHEN free THEN list_append(ua, rk.a) ELSE ua END, CASE WHEN free THEN list_append(ub, rk.b) ELSE ub END,
                    CASE WHEN free THEN rk.a END, CASE WHEN free THEN rk.b END, rk.similarity, rk.basis
             FROM go JOIN rk ON go.pair = rk.pair AND rk.n = go.n + 1, LATERAL (SELECT NOT list_contains(ua, rk.a) AND NOT list_contains(ub, rk.b) AS free))
"""

SLOTS = EV + """,
lo AS (SELECT track AS slot, ch, i, x FROM ev WHERE i < 48),
st AS (SELECT slot, max(i) + 1 AS n, length(slot) % 4 AS repeats, CASE WHEN length(slot) % 2 = 0 THEN 'fade' ELSE 'hard' END AS entrance, CASE WHEN length(slot) % 3 = 0 THEN 'fade' ELSE 'hard' END AS exit, length(slot) / 10.0::DOUBLE AS gain FROM lo GROUP BY slot),
sp AS (SELECT *, n * repeats AS life, unnest(range(0, repeats)) AS rep FROM st WHERE repeats > 0),
sj AS (SELECT sp.slot, ch, i + rep * n AS j, x, life, life / 2.0::DOUBLE AS half, gain AS g, entrance, exit FROM sp JOIN lo USING (slot)),
se AS (SELECT slot, ch, j, x * CASE WHEN exit = 'fade' AND j >= half THEN g * (life - j) / half WHEN entrance = 'fade' AND j < half THEN g * j / half ELSE g END AS x FROM sj),
tr AS (SELECT coalesce(max(n * repeats), 0) AS t FROM st)"""

SEL = "sel AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'A' ELSE 'B' END AS source, c_custkey AS idx FROM customer)"

_PITCHED = "(CASE WHEN tonality >= 0.005 THEN {a} ELSE {b} END)"


def _lengths(ratio: float) -> str:
    return f"ln AS (SELECT track, greatest(1, floor(n * {ratio}::DOUBLE + 0.5::DOUBLE))::BIGINT AS length FROM size)"


def _hop(ratio: float, n: int = 64) -> int:
    return max(1, int(n // 4 * ratio + 0.5))


ALL: dict[str, str] = {
    "downmix_mono": f"WITH {EV} SELECT track, i, {r('x')} AS x FROM mono",
    "crop_channels": f"WITH {EV} SELECT track, ch, i - 83 AS i, {r('x')} AS x FROM ev WHERE i >= 83 AND i < 283",
    "crop_mono": f"WITH {EV} SELECT track, i - 32 AS i, {r('x')} AS x FROM mono WHERE i >= 32 AND i < 144",
    "loop_trim": f"""WITH {ORD}, z AS (SELECT track, n, least(300, n) AS m, least(40, least(300, n), n - least(300, n)) AS cf FROM (SELECT track, max(i) + 1 AS n FROM ord GROUP BY 1))
        SELECT o.track, 0 AS ch, o.i, {r('CASE WHEN o.i < cf THEN (1 - o.i::DOUBLE / cf) * q.x + o.i::DOUBLE / cf * o.x ELSE o.x END')} AS x FROM ord o JOIN z USING (track) LEFT JOIN ord q ON q.track = o.track AND q.i = m + o.i WHERE o.i < m""",
    "rms_energy": f"WITH {EV} SELECT track, ch, {r('sqrt(avg(x * x))')} AS rms FROM ev GROUP BY ALL",
    "pcm16": f"WITH {ORD}, c AS (SELECT track, i, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, x - 0.5::DOUBLE)) AS c FROM ord) SELECT track, i, CAST(trunc(CASE WHEN c < 0 THEN c * 32768 ELSE c * 32767 END) AS INTEGER) AS v FROM c",
    "wav_bytes": f"""WITH {ORD}, c AS (SELECT track, i, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, x - 0.5::DOUBLE)) AS c FROM ord WHERE i < 50),
        v AS (SELECT track, i, CAST(trunc(CASE WHEN c < 0 THEN c * 32768 ELSE c * 32767 END) AS INTEGER) & 65535 AS v FROM c),
        b AS (SELECT track, count(*) * 2 AS bytes, string_agg(printf('%02X%02X', v & 255, v >> 8), '' ORDER BY i) AS data FROM v GROUP BY 1)
        SELECT track, '52494646' || printf('%02X%02X0000', (bytes + 36) & 255, (bytes + 36) >> 8) || '57415645666D74201000000001000100401F0000803E00000200100064617461' || printf('%02X%02X0000', bytes & 255, bytes >> 8) || data AS wav_hex FROM b""",
    "hann_frames": f"WITH {EV}, e0 AS (SELECT track, i, x FROM ev WHERE ch = 0), {spectrum('e0', 64, 16)} SELECT track, 0 AS ch, t, k, {r('xw')} AS xw FROM st_f",
    "fft_bins": f"WITH {ST} SELECT track, t, b::INTEGER AS b, {r('re', 4)} AS re, {r('im', 4)} AS im FROM st",
    "stft_magnitude": f"WITH {ST} SELECT track, t, b::INTEGER AS b, {r('mag', 4)} AS mag FROM st",
    "istft_roundtrip": f"WITH {ST}, {inverse('st', 64, 16)} SELECT track, i, {r('x', 4)} AS x FROM ola",
    "masked_reconstruct": f"WITH {ST}, mk AS (SELECT track, t, b, re / (1 + b) AS re, im / (1 + b) AS im FROM st), {inverse('mk', 64, 16)} SELECT track, i, {r('x', 4)} AS x FROM ola",
    "median_filter": f"WITH {ORD} SELECT track, i, {r('median(x) OVER (PARTITION BY track ORDER BY i ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING)', 10)} AS median FROM ord",
    "hpss_masks": f"WITH {HPSS} SELECT track, t, b::INTEGER AS b, {r('harmonic')} AS harmonic, {r('percussive')} AS percussive FROM hp",
    "stream_ranks": f"""WITH {HPSS}, s AS (SELECT track, CASE WHEN sum(mag) > 0 THEN sum(mag * percussive) / sum(mag) ELSE 0 END AS ps, CASE WHEN sum(mag) > 0 THEN sum(mag * harmonic) / sum(mag) ELSE 0 END AS hs FROM hp GROUP BY 1)
        SELECT track, {r('ps')} AS percussive_share, {r('hs')} AS harmonic_share, CASE WHEN ps < 0.4 AND hs < 0.4 AND ps >= hs THEN 1 WHEN ps < 0.4 THEN 0 ELSE 2 END AS k_percussive, CASE WHEN ps < 0.4 AND hs < 0.4 AND ps < hs THEN 1 WHEN hs < 0.4 THEN 0 ELSE 2 END AS k_harmonic FROM s""",
    "prng_draws": f"SELECT n, {prng(1, 'n')} AS u1, {prng(7, 'n')} AS u7 FROM (SELECT unnest(range(0, 2000)) AS n)",
    "nmf_basis": f"WITH {FIT} SELECT track, b, k, {r('x')} AS x FROM w3",
    "nmf_activations": f"WITH {FIT} SELECT track, k, t, {r('x', 4)} AS x FROM h3",
    "component_masks": f"WITH {FIT}, wh AS (SELECT w.track, h.t, w.b, w.k, w.x * h.x AS wh FROM w3 w JOIN h3 h ON w.track = h.track AND w.k = h.k) SELECT track, t, b::INTEGER AS b, k, {r('wh / (sum(wh) OVER (PARTITION BY track, t, b) + 1e-12::DOUBLE)')} AS mask FROM wh",
    "basis_cosines": f"WITH {FIT}{COS} SELECT track, i, j, {r('cosine')} AS cosine FROM cs",
    "component_shares": f"WITH {FIT}{COS} SELECT track, k, {r('share')} AS share FROM sh",
    "cluster_components": f"WITH {FIT}{COS}, o AS (SELECT cs.track, cosine >= 0.9 OR small < 0.08 AS one FROM cs JOIN (SELECT track, min(share) AS small FROM sh GROUP BY 1) USING (track)) SELECT track, k, CASE WHEN one THEN 0 ELSE k END AS grp FROM o, ks",
    "grouped_masks": f"WITH {ST}{nmf(3, 3)}{GROUPS3}{shares_of('ms', 'w3', 'h3')} SELECT track, part::INTEGER AS part, t, b::INTEGER AS b, {r('sum(mask)')} AS mask FROM ms JOIN gk USING (track, k) GROUP BY track, part, t, b",
    "split_three": f"""WITH {EV}, e0 AS (SELECT track, i, x FROM ev WHERE ch = 0), {spectrum('e0', 64, 16)}{nmf(3, 3)}{shares_of('ms', 'w3', 'h3')},
        pm AS (SELECT track || '#0#harmonic:' || k AS track, t, b, re * mask AS re, im * mask AS im FROM st JOIN ms USING (track, t, b)), {inverse('pm', 64, 16)}{PLACED}
        SELECT track, idx, ch, i, {r('x', 4)} AS x FROM pa JOIN pl USING (track, part)""",
    "separate_five": f"""WITH {ST}{hpss('st')}, vp AS MATERIALIZED (SELECT track, t, b, mag * percussive AS mag FROM hp), vh AS MATERIALIZED (SELECT track, t, b, mag * harmonic AS mag FROM hp){nmf(3, 2, 'vp', 'p', 1)}{nmf(3, 3, 'vh', 'h', 7)}
        {shares_of('mp', 'pw3', 'ph3', 'c.percussive', 'hp')}{shares_of('mh', 'hw3', 'hh3', 'c.harmonic', 'hp')},
        ms AS (SELECT track, t, b, 'percussive:' || k AS part, mask FROM mp UNION ALL SELECT track, t, b, 'harmonic:' || k, mask FROM mh), sc AS (SELECT track || '#' || ch AS track, i, x FROM ev), {spectrum('sc', 64, 16, 'sx')},
        pm AS (SELECT sx.track || '#' || part AS track, sx.t, sx.b, re * mask AS re, im * mask AS im FROM sx JOIN ms ON split_part(sx.track, '#', 1) = ms.track AND sx.t = ms.t AND sx.b = ms.b), {inverse('pm', 64, 16)}{PLACED}
        SELECT track, idx, ch, i, {r('x', 4)} AS x FROM pa JOIN pl USING (track, part)""",
    "onset_envelope": f"WITH {ENV} SELECT track, t, {r('env')} AS env FROM env",
    "tempo_lag_scores": f"WITH {LAG} SELECT track, lag::INTEGER AS lag, {r('ac')} AS ac, {r('score')} AS score FROM sc",
    "best_lag": f"WITH {LAG} SELECT track, lag::INTEGER AS lag, {r('confidence')} AS confidence FROM bl",
    "beat_phase": f"WITH {BEAT} SELECT track, phase FROM ph",
    "downbeat": f"WITH {BEAT} SELECT track, first_beat_frame, first_downbeat_frame FROM db",
    "analyze_tempo": f"""WITH {BEAT}, a AS (SELECT track, 60.0::DOUBLE / (lag / 4.0::DOUBLE) AS bpm, lag / 4.0::DOUBLE AS beat, lag::DOUBLE AS bar, first_beat_frame * 16.0::DOUBLE / 64 AS fb, first_downbeat_frame * 16.0::DOUBLE / 64 AS fd, confidence, n / 64.0::DOUBLE AS dur FROM bl JOIN db USING (track) JOIN size USING (track)),
        f AS (SELECT *, greatest(1, floor(least(8.0::DOUBLE, dur) / bar)) AS fit FROM a), g AS (SELECT *, CASE WHEN fit >= 8 THEN 8 WHEN fit >= 4 THEN 4 WHEN fit >= 2 THEN 2 ELSE 1 END AS bars FROM f),
        s AS (SELECT *, fd + bars * bar > dur AS over FROM g), z AS (SELECT *, CASE WHEN over THEN greatest(0.0::DOUBLE, dur - bars * bar) ELSE fd END AS cs FROM s)
        SELECT track, {r('bpm')} AS bpm, {r('beat')} AS beat_period, {r('bar')} AS bar_length, 4 AS beats_per_bar, {r('fb')} AS first_beat, {r('fd')} AS first_downbeat, {r('confidence')} AS confidence, {r('dur')} AS duration, {r('cs')} AS crop_start, {r('CASE WHEN over THEN least(dur, cs + bars * bar) ELSE cs + bars * bar END')} AS crop_end, bars FROM z""",
    "snap_to_bars": f"""WITH s AS (SELECT p_partkey, p_size - 4.1::DOUBLE AS a, p_size - 4.1::DOUBLE + p_retailprice / 100 AS e FROM part), q AS (SELECT *, 0.3::DOUBLE + floor((a - 0.3::DOUBLE) / 0.5::DOUBLE + 0.5::DOUBLE) * 0.5::DOUBLE AS raw FROM s),
        t AS (SELECT *, CASE WHEN raw < 0 THEN raw + 0.5::DOUBLE * ceil(-raw / 0.5::DOUBLE) ELSE raw END AS z FROM q),
        b AS (SELECT *, CAST(least(greatest(1, floor((e - a) / 2.0::DOUBLE + 0.5::DOUBLE)), greatest(1, floor(least(20.0::DOUBLE, 60.0::DOUBLE - z) / 2.0::DOUBLE))) AS INTEGER) AS bars FROM t)
        SELECT p_partkey, {r('z')} AS snap_start, {r('z + bars * 2.0::DOUBLE')} AS snap_end, bars AS snap_bars FROM b""",
    "chroma": f"WITH {CHROMA} SELECT track, pc, {r('p')} AS p FROM ch",
    "tonality": f"WITH {CHROMA} SELECT track, {r('tonality')} AS tonality FROM tn",
    "key_correlation": f"WITH {CHROMA} SELECT track, tonic, mode, {r('r')} AS r FROM ky",
    "detect_key": f"WITH {CHROMA} SELECT track, tonic, mode, name, {r('confidence')} AS confidence FROM dk",
    "label_pitch": f"""WITH {CHROMA}, tp AS (SELECT track, pc FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY p DESC, pc) AS n FROM ch) WHERE n = 1)
        SELECT tn.track, {_PITCHED.format(a='pc', b='-1')} AS pitch_class, {_PITCHED.format(a='tonic', b='0')} AS tonic, {_PITCHED.format(a='mode', b="'major'")} AS mode, {_PITCHED.format(a='name', b="'—'")} AS name, {r('tonality')} AS confidence FROM tn JOIN tp USING (track) JOIN dk USING (track)""",
    "perc_descriptor": f"""WITH {EV}, m6 AS (SELECT * FROM mono WHERE i < 640), {spectrum('m6', 64, 32)},
        bd AS (SELECT b, least(7, greatest(0, CAST(floor((ln(b::DOUBLE) - ln(2.0::DOUBLE)) / (ln(32.0::DOUBLE) - ln(2.0::DOUBLE)) * 8) AS INTEGER))) AS band FROM (SELECT unnest(range(2, 33)) AS b)),
        v AS (SELECT track, band, ln(1 + avg(mag)) AS v FROM st JOIN bd USING (b) GROUP BY ALL),
        g AS (SELECT track, band, coalesce(v, 0.0::DOUBLE) AS v FROM (SELECT DISTINCT track FROM st) CROSS JOIN (SELECT unnest(range(0, 8))::INTEGER AS band) LEFT JOIN v USING (track, band))
        SELECT track, band, {r('v / sqrt(sum(v * v) OVER (PARTITION BY track))')} AS x FROM g""",
    "cosine_matrix": f"WITH {SIDES.format(only='')} SELECT pair, a, b, {r('similarity')} AS similarity, basis FROM ca",
    "greedy_match": f"{GREEDY.replace('{only}', '')} SELECT pair, a, b, {r('similarity')} AS similarity, basis FROM go WHERE a IS NOT NULL",
    "unpaired": f"{GREEDY.replace('{only}', ' AND a.idx % 5 <> 0')} SELECT pair, idx, CASE WHEN idx % 2 = 0 THEN 'a' ELSE 'b' END AS side FROM sd WHERE (idx % 2 = 1 OR idx % 5 <> 0) AND idx NOT IN (SELECT a FROM go WHERE a IS NOT NULL UNION ALL SELECT b FROM go WHERE b IS NOT NULL)",
    "semitone_distance": "SELECT p_partkey, CAST((p_size % 12 - p_partkey % 12 + 18) % 12 - 6 AS INTEGER) AS semitones FROM part",
    "resample_linear": f"WITH {ORD}, ln AS (SELECT DISTINCT track, 1000 AS length FROM ord), {resampled('ord', 'ln')} SELECT track, i, {r('x')} AS x FROM rs",
    "time_stretch": f"WITH {EV}, {vocoder(64, 24)} SELECT track, i, {r('x', 4)} AS x FROM pv",
    "pitch_shift": f"WITH {EV}, {vocoder(64, _hop(2 ** (4 / 12)))}, {_lengths(1.0)}, {resampled('pv', 'ln')} SELECT track, i, {r('x', 4)} AS x FROM rs",
    "conform": f"WITH {EV}, {vocoder(64, _hop(0.8 * 2 ** (-3 / 12)))}, {_lengths(0.8)}, {resampled('pv', 'ln')} SELECT track, i, {r('x', 4)} AS x FROM rs",
    "mix_channels": f"""WITH {EV}, f AS (SELECT * FROM ev WHERE ch = 0 OR length(track) % 2 = 1), w AS (SELECT track, max(ch) AS last FROM f GROUP BY 1),
        d AS (SELECT track, c, least(c, last) AS ch FROM w, (SELECT unnest(range(0, (SELECT max(ch) + 1 FROM f)))::INTEGER AS c)) SELECT c AS ch, i, {r('sum(x)')} AS x FROM f JOIN d USING (track, ch) GROUP BY ALL""",
    "plan_timeline": f"WITH {SLOTS} SELECT 'm' AS mix, 30::BIGINT AS a_body, 30::BIGINT AS transition_start, t::BIGINT AS transition, (30 + t)::BIGINT AS b_start, 20::BIGINT AS b_body, (50 + t)::BIGINT AS total FROM tr",
    "fade_envelope": f"WITH {SLOTS} SELECT slot, ch, j, {r('x')} AS x FROM se",
    "render_mix": f"""WITH {SLOTS}, bo AS (SELECT ch, i, sum(x) AS x FROM ev WHERE i < 30 GROUP BY ALL),
        al AS (SELECT ch, j + 30 AS i, x FROM se UNION ALL SELECT ch, i, x FROM bo UNION ALL SELECT ch, i + 30 + (SELECT t FROM tr), x FROM bo WHERE i < 20),
        su AS (SELECT ch, i, sum(x) AS x FROM al GROUP BY ALL), gr AS (SELECT c::INTEGER AS ch, unnest(range(0, 50 + t)) AS i FROM tr, (SELECT unnest([0, 1]) AS c))
        SELECT ch, i, {r('coalesce(x, 0)')} AS x FROM gr LEFT JOIN su USING (ch, i)""",
    "solo_mute": "WITH t AS (SELECT c_nationkey AS mix, c_custkey AS idx, c_custkey % 3 = 0 AS mute, c_custkey % 7 = 0 AND c_nationkey % 2 = 0 AS solo FROM customer) SELECT idx, CASE WHEN (CASE WHEN bool_or(solo) OVER (PARTITION BY mix) THEN solo ELSE NOT mute END) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS gain FROM t",
    "transport_position": f"SELECT p_partkey, {r('CASE WHEN p_size <= 0 THEN 0.0::DOUBLE WHEN p_partkey % 2 = 0 THEN p_retailprice % p_size::DOUBLE ELSE least(p_retailprice, p_size::DOUBLE) END', 4)} AS position FROM part",
    "waveform_peaks": f"""WITH {ORD}, s AS (SELECT track, greatest(1, (max(i) + 1) // 120) AS step FROM ord GROUP BY 1), g AS (SELECT track, i // step AS bucket, least(1.0::DOUBLE, min(x)) AS lo, greatest(-1.0::DOUBLE, max(x)) AS hi FROM ord JOIN s USING (track) GROUP BY ALL)
        SELECT track, bucket, {r('coalesce(lo, 0)')} AS lo, {r('coalesce(hi, 0)')} AS hi FROM s CROSS JOIN (SELECT unnest(range(0, 120)) AS bucket) LEFT JOIN g USING (track, bucket)""",
    "component_labels": f"WITH {PARTS}, l AS (SELECT track, idx, upper(kind[1]) || kind[2:] || ' ' || row_number() OVER (PARTITION BY track, kind ORDER BY idx) AS label FROM parts) SELECT track, idx::INTEGER AS idx, label, lower(regexp_replace(label || '.wav', '\\s+', '-', 'g')) AS file FROM l",
    "component_order": f"WITH {PARTS} SELECT track, idx::INTEGER AS idx, CAST(row_number() OVER (PARTITION BY track ORDER BY CASE WHEN kind = 'percussive' THEN 0 ELSE 1 END, energy DESC, idx) - 1 AS INTEGER) AS pos FROM parts",
    "describe_parts": f"""WITH {PARTS}, n AS (SELECT track, kind, count(*) AS n, CASE kind WHEN 'percussive' THEN 0 WHEN 'harmonic' THEN 1 ELSE 2 END AS o FROM parts GROUP BY ALL)
        SELECT track, sum(n)::BIGINT || CASE WHEN sum(n) = 1 THEN ' part (' ELSE ' parts (' END || string_agg(n || ' ' || kind, ' · ' ORDER BY o) || ')' AS summary FROM n GROUP BY 1""",
    "deck_tonic": f"WITH {PARTS}, b AS (SELECT track, tonic FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY energy DESC, idx) AS n FROM parts WHERE name <> '—') WHERE n = 1) SELECT track, tonic FROM (SELECT DISTINCT track FROM parts) LEFT JOIN b USING (track)",
    "target_defaults": "SELECT s_suppkey AS pair, CAST(floor(coalesce(CASE WHEN s_suppkey % 4 > 0 THEN abs(s_acctbal) / 50 END, 120.0::DOUBLE) + 0.5::DOUBLE) AS INTEGER) AS target_bpm, CAST(coalesce(CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey % 12 END, CASE WHEN s_suppkey % 2 > 0 THEN s_suppkey % 11 END, 0) AS INTEGER) AS target_tonic FROM supplier",
    "slot_settings": f"""WITH {SEL}, o AS (SELECT CASE WHEN k % 2 = 0 THEN 'A' ELSE 'B' END AS source, k AS idx, CAST(1 + k % 16 AS INTEGER) AS repeats, CASE WHEN k % 5 = 0 THEN 'hard' END AS entrance, CASE WHEN k % 7 = 0 THEN 'fade' END AS exit, (k % 100) / 100.0::DOUBLE AS gain FROM (SELECT o_orderkey AS k FROM orders) WHERE k % 3 = 0)
        SELECT source, idx, coalesce(repeats, 4) AS repeats, coalesce(entrance, CASE WHEN source = 'B' THEN 'fade' ELSE 'hard' END) AS entrance, coalesce(exit, CASE WHEN source = 'A' THEN 'fade' ELSE 'hard' END) AS exit, coalesce(gain, 1.0::DOUBLE) AS gain FROM sel LEFT JOIN o USING (source, idx)""",
    "prune_selection": f"WITH {SEL} SELECT source, idx FROM sel SEMI JOIN (SELECT CASE WHEN s_suppkey % 4 < 2 THEN 'A' ELSE 'B' END AS source, s_suppkey AS idx FROM supplier) USING (source, idx)",
    "key_roundtrip": f"WITH {SEL} SELECT source || ':' || idx AS key, source, idx::INTEGER AS idx FROM sel",
    "combine_parts": f"""WITH {EV}, s AS (SELECT track, row_number() OVER (ORDER BY track) - 1 AS idx FROM (SELECT DISTINCT track FROM ev)),
        j AS (SELECT CASE WHEN idx = 2 THEN 1 ELSE idx END AS seat, i, sum(x) AS x FROM ev JOIN s USING (track) WHERE ch = 0 GROUP BY ALL)
        SELECT 'deck' AS track, CAST(dense_rank() OVER (ORDER BY seat) - 1 AS INTEGER) AS idx, CASE WHEN seat = 1 THEN 'mixed' WHEN seat % 2 = 0 THEN 'harmonic' ELSE 'percussive' END AS kind, {r('sqrt(avg(x * x))')} AS energy FROM j GROUP BY seat""",
    "splice_split": f"""WITH {PARTS}, u AS (SELECT track, idx, 0 AS sub, kind, energy FROM parts WHERE idx <> 1 UNION ALL SELECT track, 1, s, 'harmonic', s::DOUBLE FROM (SELECT DISTINCT track FROM parts), (SELECT unnest([0, 1, 2]) AS s))
        SELECT track, CAST(row_number() OVER (PARTITION BY track ORDER BY idx, sub) - 1 AS INTEGER) AS idx, kind, energy FROM u""",
    "format_time": "SELECT o_orderkey, CAST(floor(w / 60) AS BIGINT) || ':' || lpad(CAST(w % 60 AS BIGINT)::VARCHAR, 2, '0') AS shown FROM (SELECT o_orderkey, floor(o_totalprice / 100) AS w FROM orders)",
    "similarity_percent": "SELECT l_orderkey, CAST(floor(avg(l_discount) * 100 + 0.5::DOUBLE) AS BIGINT) || '%' AS shown FROM lineitem GROUP BY 1",
    "clamp_settings": f"SELECT p_partkey, greatest(1, least(16, p_size - 5)) AS repeats, greatest(0, least(4, p_size - 25)) AS parts, {r('CASE WHEN p_retailprice / 8 BETWEEN 40 AND 240 THEN p_retailprice / 8 END')} AS bpm, least(p_size + 20.0::DOUBLE, p_retailprice / 30) AS crop_end FROM part",
    "loop_params": "WITH n AS (SELECT p_partkey, CAST(floor((1.5::DOUBLE + p_size / 7.0::DOUBLE - 1.5::DOUBLE) * 441.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS n FROM part) SELECT p_partkey, n AS length, least(5, greatest(0, n - 1)) AS crossfade FROM n",
    "info_texts": """WITH p AS (SELECT p_partkey, p_retailprice, p_size, floor(3.0::DOUBLE + p_size / 4.0::DOUBLE) AS e FROM part)
        SELECT p_partkey, CAST(floor(p_retailprice / 10 + 0.5::DOUBLE) AS BIGINT) || ' BPM · 4/4 · bar ' || printf('%.2f', round(p_size / 8.0::DOUBLE, 2)) || 's' || CASE WHEN p_size / 100.0::DOUBLE < 0.12 THEN ' · low confidence' ELSE '' END AS tempo_text,
               '0:03 – ' || CAST(e // 60 AS BIGINT) || ':' || lpad(CAST(e % 60 AS BIGINT)::VARCHAR, 2, '0') || ' · ' || printf('%.1f', round(p_size / 4.0::DOUBLE, 1)) || 's · ' || printf('%.1f', round(p_size / 8.0::DOUBLE, 1)) || ' bars' AS crop_text FROM p""",
}

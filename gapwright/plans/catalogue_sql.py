"""DuckDB text of every SQL-expressible query, written independently of the Spark plans.

Plain whole-partition windows and joins: the point is an obvious statement of the result,
not a scalable one.
"""

from __future__ import annotations

from ..constants import SCENARIOS

P = 2147483647
LOGS = ("GR", "RHOB", "NPHI")
COLS = ("gr", "rhob", "nphi")
METHODS = ("mean", "locf", "interp_linear", "ridge")
PAIRS = (("locf", "mean"), ("locf", "interp_linear"), ("interp_linear", "ridge"), ("ridge", "mean"))
ORD = {"mean": 0, "locf": 1}


def u(a: str, b: str, salt: str) -> str:
    """Uniform draw from two integer keys and a salt."""
    r1 = f"((CAST({a} AS BIGINT) * 7919 + CAST({b} AS BIGINT) * 104729 + CAST({salt} AS BIGINT) * 1299709) % {P} * 48271 + 11) % {P}"
    r2 = f"(({r1}) * (({r1}) % 65521 + 1)) % {P}"
    return f"(CAST((({r2}) * 69621 + CAST({salt} AS BIGINT)) % {P} AS DOUBLE) / CAST({P} AS DOUBLE))"


CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, deps: str, sql: str) -> None:
    """Register a named building block."""
    CTES[name] = (tuple(deps.split()), sql)


def build(final: str, *names: str) -> str:
    """WITH clause holding the needed blocks, then the final select."""
    need: list[str] = []

    def add(n: str) -> None:
        for m in CTES[n][0]:
            add(m)
        if n not in need:
            need.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in need) + "\n" + final


def r(expr: str, n: int, name: str | None = None) -> str:
    """Rounded column."""
    return f"round({expr}, {n}) + 0.0 AS {name or expr}"


# --- samples -----------------------------------------------------------------------------------
cte("raw", "", """SELECT l_suppkey AS well, idx, 1000.0::DOUBLE + idx * 0.1524::DOUBLE AS depth, l_quantity * 4.0::DOUBLE AS gr,
  1.9::DOUBLE + l_extendedprice / 105000.0::DOUBLE AS rhob, l_discount * 5.0::DOUBLE + 0.02::DOUBLE AS nphi
FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_shipdate) - 1 AS idx FROM lineitem)""")
H = "((well * 31 + (idx // 37) * 17) % 11)"
LATE = "(idx >= 400 + well % 50)"
cte("s", "raw", f"""SELECT well, idx, depth,
  CASE WHEN NOT ({LATE} AND {H} IN (0, 1)) THEN gr END AS gr,
  CASE WHEN NOT ({LATE} AND {H} IN (1, 2, 3, 4)) THEN rhob END AS rhob,
  CASE WHEN NOT ({LATE} AND {H} IN (1, 2, 3, 4)) THEN nphi END AS nphi FROM raw""")
cte("dirty", "s", """SELECT well, idx, CASE WHEN idx % 97 = 0 AND well % 3 = 0 AND gr IS NOT NULL THEN 450.0::DOUBLE
    WHEN well % 13 = 5 THEN gr / 40.0::DOUBLE ELSE gr END AS gr, rhob, CASE WHEN well % 7 = 3 THEN nphi * 100.0::DOUBLE ELSE nphi END AS nphi FROM s""")
cte("flags", "dirty", """SELECT well, quantile_cont(nphi, 0.99) > 1.5 AS percent, quantile_cont(gr, 0.5) < 6.0 AS aberrant FROM dirty GROUP BY well""")
cte("scaled", "dirty flags", """SELECT d.well, idx, CASE WHEN NOT coalesce(aberrant, false) THEN gr END AS gr, rhob,
  CASE WHEN percent THEN nphi / 100.0::DOUBLE ELSE nphi END AS nphi, percent, aberrant FROM dirty d JOIN flags f ON d.well = f.well""")
BOUNDS = {"gr": (0.0, 400.0), "rhob": (1.2, 3.1), "nphi": (-0.05, 1.0)}
cte("ev", "", """SELECT user_id AS well, epoch_us(ts) / 1e6::DOUBLE AS depth,
  row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) / 1e6::DOUBLE, event_id) - 1 AS idx FROM events""")


def qc(src: str) -> None:
    """Depth QC blocks for one sample table."""
    cte(f"st_{src}", src, f"SELECT well, depth - lag(depth) OVER (PARTITION BY well ORDER BY idx) AS step FROM {src}")
    cte(f"med_{src}", f"st_{src}", f"SELECT well, quantile_cont(step, 0.5) AS m FROM st_{src} WHERE step IS NOT NULL GROUP BY well")
    cte(f"qc_{src}", f"st_{src} med_{src}", f"""SELECT w.well, m AS median_step_m, mn AS min_step_m, mx AS max_step_m, coalesce(n_nonpos, 0) AS n_nonpos,
      coalesce(n_jumps, 0) AS n_jumps, coalesce(jump_m, 0.0) AS jump_m,
      CASE WHEN abs(m - 0.1524) <= 0.001 AND n_nonpos = 0 AND n_jumps = 0 THEN 'kept' ELSE 'EXCLUDED' END AS status
    FROM (SELECT DISTINCT well FROM {src}) w LEFT JOIN (SELECT t.well, any_value(m) AS m, min(step) AS mn, max(step) AS mx,
      count(*) FILTER (step <= 0) AS n_nonpos, count(*) FILTER (step > 2 * m) AS n_jumps, sum(step - m) FILTER (step > 2 * m) AS jump_m
      FROM st_{src} t JOIN med_{src} d ON t.well = d.well WHERE step IS NOT NULL GROUP BY t.well) q ON w.well = q.well""")


qc("ev")
qc("s")

# --- missingness --------------------------------------------------------------------------------
cte("code", "s", """SELECT well, idx, (CASE WHEN gr IS NULL THEN 1 ELSE 0 END) + (CASE WHEN rhob IS NULL THEN 2 ELSE 0 END) + (CASE WHEN nphi IS NULL THEN 4 ELSE 0 END) AS code FROM s""")
cte("isl", "code", """SELECT *, sum(chg) OVER (PARTITION BY well ORDER BY idx) AS run FROM
  (SELECT *, CASE WHEN code IS DISTINCT FROM lag(code) OVER (PARTITION BY well ORDER BY idx) THEN 1 ELSE 0 END AS chg FROM code)""")
COMBO = "concat_ws('+', CASE WHEN code & 1 > 0 THEN 'GR' END, CASE WHEN code & 2 > 0 THEN 'RHOB' END, CASE WHEN code & 4 > 0 THEN 'NPHI' END)"
cte("iv", "isl", f"""SELECT well, code, {COMBO} AS combo, min(idx) AS start, max(idx) + 1 AS "end", max(idx) + 1 - min(idx) AS length
  FROM isl WHERE code <> 0 GROUP BY well, run, code""")
cte("seg", "isl", """SELECT well, min(idx) AS start, max(idx) + 1 AS "end", max(idx) + 1 - min(idx) AS length FROM isl WHERE code = 0 GROUP BY well, run HAVING count(*) >= 256""")
cte("len", "s", "SELECT well, max(idx) + 1 AS well_len FROM s GROUP BY well")
cte("gapl", "code len", """SELECT g.well, log, min(idx) AS start, max(idx) + 1 AS "end", count(*) AS length, count(*) * 0.1524::DOUBLE AS length_m,
    (min(idx) = 0 OR max(idx) + 1 = any_value(well_len)) AS is_edge
  FROM (SELECT well, log, idx, idx - row_number() OVER (PARTITION BY well, log ORDER BY idx) AS grp FROM
    (SELECT well, idx, 'GR' AS log FROM code WHERE code & 1 > 0 UNION ALL SELECT well, idx, 'RHOB' FROM code WHERE code & 2 > 0
     UNION ALL SELECT well, idx, 'NPHI' FROM code WHERE code & 4 > 0)) g JOIN len ON g.well = len.well GROUP BY g.well, log, grp""")

# --- windows ---------------------------------------------------------------------------------------
cte("win", "s", """SELECT well, idx AS start, row_number() OVER (PARTITION BY well ORDER BY idx) - 1 AS win_ord FROM
  (SELECT well, idx, sum(CASE WHEN gr IS NOT NULL AND rhob IS NOT NULL AND nphi IS NOT NULL THEN 1 ELSE 0 END)
     OVER (PARTITION BY well ORDER BY idx ROWS BETWEEN CURRENT ROW AND 255 FOLLOWING) AS n FROM s) WHERE n = 256 AND idx % 64 = 0""")
cte("ws", "s win", """SELECT w.well, w.start, CAST(s.idx - w.start AS INTEGER) AS t, gr, rhob, nphi FROM win w JOIN s ON s.well = w.well AND s.idx BETWEEN w.start AND w.start + 255""")
cte("folds", "win", "SELECT row_number() OVER (ORDER BY well) - 1 AS fold_id, well AS test_well FROM (SELECT DISTINCT well FROM win)")
ALLP = [(a, b) for i, a in enumerate(COLS) for b in COLS[i:]]
CEN = {"gr": 75.0, "rhob": 2.4, "nphi": 0.25}
cte("mom", "ws", "SELECT well, count(*)::DOUBLE AS n, " + ", ".join(f"sum({c} - {CEN[c]}) AS s_{c}" for c in COLS) + ", "
    + ", ".join(f"sum(({a} - {CEN[a]}) * ({b} - {CEN[b]})) AS q_{a}_{b}" for a, b in ALLP) + " FROM ws GROUP BY well")
MO = ["n", *[f"s_{c}" for c in COLS], *[f"q_{a}_{b}" for a, b in ALLP]]
cte("loo", "mom", "SELECT well, " + ", ".join(f"sum({m}) OVER () - {m} AS {m}" for m in MO) + " FROM mom")
cte("scl", "loo", "SELECT *, " + ", ".join(
    f"s_{c} / n + {CEN[c]} AS mu_{c}, sqrt(greatest(q_{c}_{c} / n - (s_{c} / n) * (s_{c} / n), 0.0)) + 1e-8 AS sd_{c}" for c in COLS) + " FROM loo")


def _z(p: str, q: str) -> str:
    name = f"q_{p}_{q}" if (p, q) in ALLP else f"q_{q}_{p}"
    return f"(({name} - s_{p} * s_{q} / n) / (sd_{p} * sd_{q}))"


def _ridge() -> str:
    out = []
    for c in COLS:
        a, b = [o for o in COLS if o != c]
        saa, sbb, sab, say, sby = f"({_z(a, a)} + 1.0)", f"({_z(b, b)} + 1.0)", _z(a, b), _z(a, c), _z(b, c)
        det = f"({saa} * {sbb} - {sab} * {sab})"
        out += [f"({say} * {sbb} - {sby} * {sab}) / {det} AS w_{c}_{a}", f"({sby} * {saa} - {say} * {sab}) / {det} AS w_{c}_{b}"]
    return ", ".join(out)


cte("fits", "scl", f"SELECT well, {', '.join(f'mu_{c}, sd_{c}' for c in COLS)}, {_ridge()} FROM scl")

# --- masks --------------------------------------------------------------------------------------------
SALT = {"single": 100, "block": 200, "profile": 300, "blackout": 400}


def bits(sc: str, seed: str = "mask_seed", full: bool = True) -> str:
    """Mask bitmask of one scenario at (well, start, t)."""
    d = lambda k: u("well", "start", f"({seed}) * 1000 + {SALT[sc] + k}")
    one = f"(1 << CAST(floor({d(0)} * 3) AS INTEGER))"
    if sc == "profile":
        return one
    if sc == "single":
        hit = " OR ".join(f"t = CAST(floor({d(k)} * 256) AS INTEGER)" for k in range(1, 6))
        return f"CASE WHEN {hit} THEN {one} ELSE 0 END"
    if sc == "block":
        ln = f"(CASE WHEN floor({d(1)} * 2) = 0 THEN 20 ELSE 100 END)"
        s = f"CAST(floor({d(2)} * (256 - {ln} + 1)) AS INTEGER)"
        return f"CASE WHEN t >= {s} AND t < {s} + {ln} THEN {one} ELSE 0 END"
    k = f"(CASE WHEN {d(0)} < 0.035 THEN 1 WHEN {d(0)} < 0.035 + 0.759 THEN 2 ELSE {3 if full else 2} END)"
    one = f"(1 << CAST(floor({d(1)} * 3) AS INTEGER))"
    cols = f"(CASE {k} WHEN 1 THEN {one} WHEN 2 THEN 7 - {one} ELSE 7 END)"
    ln = f"CAST(greatest(1, least(256, round_even((0.3::DOUBLE + 0.6000000000000001::DOUBLE * {d(2)}) * 256, 0))) AS INTEGER)"
    s = f"CAST(floor({d(3)} * (256 - {ln} + 1)) AS INTEGER)"
    return f"CASE WHEN t >= {s} AND t < {s} + {ln} THEN {cols} ELSE 0 END"


XS = ", ".join(f"CASE WHEN mask_bits & {1 << i} = 0 THEN {c} END AS x_{c}" for i, c in enumerate(COLS))


def masked(name: str, scenarios, seeds, full: bool = True) -> str:
    """Block with masked window rows of the given cells."""
    cells = " UNION ALL ".join(f"SELECT '{s}' AS scenario, {m} AS mask_seed" for s in scenarios for m in seeds)
    case = "CASE scenario " + " ".join(f"WHEN '{s}' THEN {bits(s, full=full)}" for s in scenarios) + " END"
    cte(name, "ws", f"SELECT *, {XS} FROM (SELECT ws.*, scenario, mask_seed, CAST({case} AS INTEGER) AS mask_bits FROM ws CROSS JOIN ({cells}))")
    return name


def summary(src: str) -> str:
    """Per-window mask summary."""
    return f"""SELECT scenario, mask_seed, well, start, {', '.join(f'CAST(sum(CASE WHEN mask_bits & {1 << i} > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_{c}' for i, c in enumerate(COLS))},
      min(t) AS t_min, max(t) AS t_max FROM {src} WHERE mask_bits > 0 GROUP BY scenario, mask_seed, well, start"""


# --- predictions -----------------------------------------------------------------------------------------
def predicted(name: str, src: str, methods=METHODS) -> str:
    """Long points of the native imputers for a masked block."""
    cell = "scenario, mask_seed, well, start"
    nb = ", ".join(
        f"last_value(x_{c} IGNORE NULLS) OVER f AS by_{c}, last_value(CASE WHEN x_{c} IS NOT NULL THEN t END IGNORE NULLS) OVER f AS bt_{c}, "
        f"first_value(x_{c} IGNORE NULLS) OVER a AS ay_{c}, first_value(CASE WHEN x_{c} IS NOT NULL THEN t END IGNORE NULLS) OVER a AS at_{c}" for c in COLS)
    cte(f"{name}_n", f"{src} fits", f"""SELECT n.*, f.* EXCLUDE (well) FROM (SELECT *, {nb} FROM {src} WINDOW f AS (PARTITION BY {cell} ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
      a AS (PARTITION BY {cell} ORDER BY t ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) n JOIN fits f ON n.well = f.well WHERE mask_bits > 0""")
    parts = []
    state = {c: f"coalesce((x_{c} - mu_{c}) / sd_{c}, 0.0)" for c in COLS}
    for i, c in enumerate(COLS):
        a, b = [o for o in COLS if o != c]
        fit = f"(w_{c}_{a} * {state[a]} + w_{c}_{b} * {state[b]})"
        state[c] = f"(CASE WHEN mask_bits & {1 << i} > 0 THEN {fit} ELSE {state[c]} END)"     # seen by the channels after it
        lin = (f"coalesce(CASE WHEN by_{c} IS NOT NULL AND ay_{c} IS NOT NULL THEN by_{c} + (ay_{c} - by_{c}) * (t - bt_{c}) / (at_{c} - bt_{c})::DOUBLE "
               f"ELSE coalesce(by_{c}, ay_{c}) END, mu_{c})")
        expr = {"mean": f"mu_{c}", "locf": f"coalesce(by_{c}, mu_{c})", "locf_win": f"coalesce(by_{c}, mu_{c})", "interp_linear": lin,
                "ridge": f"{fit} * sd_{c} + mu_{c}"}
        parts += [f"SELECT {cell}, t, '{m}' AS method, '{c.upper()}' AS log, {expr[m]} AS pred, {c} AS truth FROM {name}_n WHERE mask_bits & {1 << i} > 0" for m in methods]
    cte(name, f"{name}_n", " UNION ALL ".join(parts))
    return name


masked("m0", SCENARIOS, (0,))
masked("m01", SCENARIOS, (0, 1))
predicted("p0", "m0")
predicted("p01", "m01")
predicted("ml01", "m01", ("mean", "locf"))
MET = """avg(abs(pred - truth)) AS mae, sqrt(avg((pred - truth) * (pred - truth))) AS rmse,
  CASE WHEN var_pop(truth) > 0 THEN 1 - sum((pred - truth) * (pred - truth)) / (var_pop(truth) * count(*)) END AS r2,
  CASE WHEN stddev_pop(pred) > 1e-12 AND stddev_pop(truth) > 0 AND count(*) > 1 THEN corr(pred, truth) END AS cc, count(*) AS n"""


def suff(name: str, src: str) -> None:
    """Sufficient statistics of a points block."""
    cte(name, src, f"""SELECT method, log, scenario, mask_seed, mask_seed AS init_seed, well, count(*) AS n, sum(truth) AS sum_y, sum(truth * truth) AS sum_y2,
      sum((pred - truth) * (pred - truth)) AS sse, sum(abs(pred - truth)) AS sae FROM {src} GROUP BY method, log, scenario, mask_seed, well""")


suff("f0", "p0")
suff("f01", "p01")
suff("fml", "ml01")
R2 = "CASE WHEN sum(n) > 1 AND sum(sum_y2) - sum(sum_y) * sum(sum_y) / sum(n) > 0 THEN 1 - sum(sse) / (sum(sum_y2) - sum(sum_y) * sum(sum_y) / sum(n)) END"
for _f in ("f0", "f01", "fml"):
    cte(f"{_f}_log", _f, f"SELECT method, scenario, init_seed, mask_seed, log, sum(n) AS n, {R2} AS r2, sum(sae) / sum(n) AS mae, sqrt(sum(sse) / sum(n)) AS rmse FROM {_f} GROUP BY ALL")
    cte(f"{_f}_mac", f"{_f}_log", f"SELECT method, scenario, init_seed, mask_seed, CASE WHEN count(r2) = 3 THEN avg(r2) END AS r2_macro FROM {_f}_log GROUP BY ALL")
    cte(f"{_f}_all", f"{_f} {_f}_log", f"""SELECT method, scenario, init_seed, mask_seed, log, r2 FROM {_f}_log UNION ALL
      SELECT method, scenario, init_seed, mask_seed, 'all', {R2} FROM {_f} GROUP BY method, scenario, init_seed, mask_seed""")
cte("sig", "scl", " UNION ALL ".join(f"SELECT well, '{c.upper()}' AS log, sd_{c} AS sigma FROM scl" for c in COLS))
cte("nr", "f01 sig", """SELECT method, init_seed, mask_seed, scenario, f.well, sqrt(avg(sse / (n * sigma * sigma))) AS nrmse
  FROM f01 f JOIN sig g ON f.well = g.well AND f.log = g.log GROUP BY method, init_seed, mask_seed, scenario, f.well""")
cte("err0", "nr", "SELECT method, scenario, well, avg(nrmse) AS nrmse FROM nr GROUP BY ALL")
cte("err", "err0", "SELECT method, scenario, well, round(nrmse, 6) AS nrmse FROM err0")
cte("raw01", "f01 folds", f"""SELECT mask_seed AS seed, method, scenario, fold_id AS fold, log, round(r2, 6) AS r2 FROM (
    SELECT mask_seed, method, scenario, well, log, {R2} AS r2 FROM f01 GROUP BY ALL UNION ALL
    SELECT mask_seed, method, scenario, well, 'all', {R2} FROM f01 GROUP BY mask_seed, method, scenario, well) x JOIN folds ON x.well = test_well""")
MORD = "CASE method WHEN 'mean' THEN 0 WHEN 'locf' THEN 1 ELSE 11 END"

# --- spatial ---------------------------------------------------------------------------------------------------
cte("co", "", """SELECT s_suppkey AS well, CAST(100000 + 2000 * (s_suppkey % 10) + 7 * ((s_suppkey * s_suppkey) % 97) AS DOUBLE) AS x,
  CAST(200000 + 2000 * (s_suppkey // 10) + 11 * ((s_suppkey * s_suppkey * s_suppkey) % 89) AS DOUBLE) AS y FROM supplier""")
cte("dist", "co", "SELECT a.well AS src, b.well AS dst, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM co a JOIN co b ON a.well <> b.well")
cte("edges", "dist", "SELECT src, dst, d / 1000.0 AS d_km, rk AS rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS rk FROM dist) WHERE rk <= 8")
cte("scale", "dist", "SELECT quantile_cont(d, 0.5) / 1000.0 AS scale_km FROM dist WHERE d > 0")
cte("adj0", "edges scale", """SELECT src, dst, d_km, exp(-(d_km * d_km) / (2 * scale_km * scale_km)) AS w FROM edges, scale UNION ALL
  SELECT DISTINCT src, src, 0.0, 1.0 FROM edges""")
cte("adj", "adj0", "SELECT src, dst, d_km, w / (sum(w) OVER (PARTITION BY src) + 1e-8) AS weight FROM adj0")
cte("offs", "s", """SELECT well, CAST(round_even((top - min(top) OVER ()) / 0.1524, 0) AS BIGINT) AS "offset", length,
  CAST(round_even((max(base) OVER () - min(top) OVER ()) / 0.1524, 0) + 1 AS BIGINT) AS d_tot
  FROM (SELECT well, min_by(depth, idx) AS top, max_by(depth, idx) AS base, max(idx) + 1 AS length FROM s GROUP BY well)""")
cte("grid", "s offs", "SELECT s.well, idx, idx + \"offset\" AS g, gr, rhob, nphi FROM s JOIN offs o ON s.well = o.well")
masked("mb", ("block",), (0,))
cte("sp_t", "mb offs", " UNION ALL ".join(
    f"SELECT m.well, start, t, start + t + \"offset\" AS g, '{c.upper()}' AS log FROM mb m JOIN offs o ON m.well = o.well WHERE mask_bits & {1 << i} > 0" for i, c in enumerate(COLS)))
cte("sp_v", "grid", " UNION ALL ".join(f"SELECT well, g, '{c.upper()}' AS log, {c} AS v FROM grid WHERE {c} IS NOT NULL" for c in COLS))
cte("mus", "scl", " UNION ALL ".join(f"SELECT well, '{c.upper()}' AS log, mu_{c} AS mu FROM scl" for c in COLS))
cte("nav", "win offs edges adj sp_v", """SELECT w.well, w.start, t, v.log, count(*) AS na, min(e.d_km) AS dn, sum(a.weight) AS wa
  FROM (SELECT win.well, start, unnest(range(256)) AS t FROM win) w JOIN offs o ON w.well = o.well JOIN edges e ON e.src = w.well
  JOIN adj a ON a.src = e.src AND a.dst = e.dst JOIN sp_v v ON v.well = e.dst AND v.g = w.start + w.t + o."offset" GROUP BY ALL""")
cte("navw", "win nav", """SELECT w.well, w.start, coalesce(na, 0) AS na, dn, coalesce(wa, 0) AS wa FROM win w LEFT JOIN
  (SELECT well, start, sum(na) / 768.0 AS na, avg(dn) AS dn, sum(wa) / 768.0 AS wa FROM nav GROUP BY well, start) n ON w.well = n.well AND w.start = n.start""")
cte("navail", "navw edges", """SELECT well, avg(na) AS n_avail, avg(dn) AS d_nearest_km, avg(wa) AS w_avail,
  (SELECT count(*) FROM edges e WHERE e.src = navw.well) AS k_neighbours FROM navw GROUP BY well""")


# --- random orders ------------------------------------------------------------------------------------------------
def shuffle(name: str, src: str, seed: int, salt: int) -> None:
    """Random order of the windows of a block."""
    cte(name, src, f"SELECT well, start, row_number() OVER (ORDER BY {u('well', 'start', f'{seed} * 1000 + {salt}')}, well, start) - 1 AS pos, count(*) OVER () AS n_all FROM {src}")


shuffle("sh_split", "win", 0, 950)
shuffle("sh_sub", "win", 1, 951)
shuffle("sh_train", "win", 0, 900)
cte("split", "sh_split", "SELECT well, start, pos < round_even(n_all * 0.2, 0) AS is_test FROM sh_split")
cte("setb", "split", """SELECT a.well, a.start FROM split a WHERE NOT a.is_test AND NOT EXISTS
  (SELECT 1 FROM split b WHERE b.is_test AND b.well = a.well AND abs(b.start - a.start) < 256)""")
cte("plan", "sh_train", """SELECT well, start, CASE WHEN pos < (n_all % 4) * (n_all // 4 + 1) THEN pos // (n_all // 4 + 1)
  ELSE n_all % 4 + (pos - (n_all % 4) * (n_all // 4 + 1)) // (n_all // 4) END AS part FROM sh_train""")
cte("mtrain", "ws plan", "SELECT *, CASE scenario " + " ".join(f"WHEN '{s}' THEN {bits(s, '500')}" for s in SCENARIOS) + """ END AS mask_bits, 500 AS mask_seed FROM
  (SELECT ws.*, CASE part WHEN 0 THEN 'single' WHEN 1 THEN 'block' WHEN 2 THEN 'profile' ELSE 'blackout' END AS scenario FROM ws JOIN plan p ON ws.well = p.well AND ws.start = p.start)""")

# --- empirical blackout ---------------------------------------------------------------------------------------------
cte("cat", "iv", f"SELECT row_number() OVER (ORDER BY floor({u('well', 'start', '77')} * 1024), well, start) - 1 AS iv_ord, code, length, count(*) OVER () AS n_iv FROM iv")


def emp(name: str, reps: int) -> None:
    """Empirical masks with a number of replicates."""
    cte(name + "_d", "seg cat", f"""SELECT well, start AS seg_start, "end" AS seg_end, rep, {u('well', 'start', '500 + 2 * rep')} AS u0, {u('well', 'start', '500 + 2 * rep + 1')} AS u1,
      (SELECT max(n_iv) FROM cat) AS n_iv FROM seg CROSS JOIN (SELECT unnest(range({reps})) AS rep)""")
    cte(name, f"{name}_d cat", f"""SELECT well, seg_start, seg_end, CAST(rep AS INTEGER) AS rep, 0 AS mask_seed, code AS mask_cols,
      CASE WHEN length >= seg_end - seg_start THEN seg_start ELSE seg_start + CAST(floor(u1 * (seg_end - seg_start - length + 1)) AS BIGINT) END AS mask_from,
      CASE WHEN length >= seg_end - seg_start THEN seg_end ELSE seg_start + CAST(floor(u1 * (seg_end - seg_start - length + 1)) AS BIGINT) + length END AS mask_to
      FROM {name}_d d JOIN cat c ON c.iv_ord = CAST(floor(d.u0 * d.n_iv) AS BIGINT)""")


emp("emp5", 5)
emp("emp2", 2)
cte("tile", "seg", """SELECT DISTINCT well, start AS seg_start, "end" AS seg_end, start + o AS start FROM
  (SELECT *, unnest(list_append(range(0, length - 256 + 1, 128), length - 256)) AS o FROM seg)""")
cte("em_rows", "emp2 tile s", f"""SELECT *, {XS} FROM (SELECT e.well, e.seg_start, rep, tl.start, s.idx, gr, rhob, nphi,
    CASE WHEN s.idx >= mask_from AND s.idx < mask_to THEN mask_cols ELSE 0 END AS mask_bits
  FROM emp2 e JOIN tile tl ON e.well = tl.well AND e.seg_start = tl.seg_start JOIN s ON s.well = e.well AND s.idx BETWEEN tl.start AND tl.start + 255)""")
cte("em_locf", "em_rows", "SELECT *, " + ", ".join(
    f"last_value(x_{c} IGNORE NULLS) OVER (PARTITION BY well, seg_start, rep, start ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS by_{c}" for c in COLS) + " FROM em_rows")
cte("em_win", "em_locf scl", " UNION ALL ".join(
    f"""SELECT l.well, seg_start, rep, idx, '{c.upper()}' AS log, avg(coalesce(by_{c}, mu_{c})) AS pred, any_value({c}) AS truth
    FROM em_locf l JOIN scl ON l.well = scl.well WHERE mask_bits & {1 << i} > 0 GROUP BY l.well, seg_start, rep, idx""" for i, c in enumerate(COLS)))
cte("nbr", "s", "SELECT well, idx, " + ", ".join(
    f"last_value({c} IGNORE NULLS) OVER f AS by_{c}, last_value(CASE WHEN {c} IS NOT NULL THEN idx END IGNORE NULLS) OVER f AS bt_{c}, "
    f"first_value({c} IGNORE NULLS) OVER a AS ay_{c}, first_value(CASE WHEN {c} IS NOT NULL THEN idx END IGNORE NULLS) OVER a AS at_{c}" for c in COLS)
    + """ FROM s WINDOW f AS (PARTITION BY well ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    a AS (PARTITION BY well ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)""")
cte("em_well", "emp2 nbr s scl", " UNION ALL ".join(
    f"""SELECT e.well, e.seg_start, rep, s.idx, '{c.upper()}' AS log, s.{c} AS truth, coalesce(b.by_{c}, mu_{c}) AS locf,
    coalesce(CASE WHEN b.by_{c} IS NOT NULL AND a.ay_{c} IS NOT NULL THEN b.by_{c} + (a.ay_{c} - b.by_{c}) * (s.idx - b.bt_{c}) / (a.at_{c} - b.bt_{c})::DOUBLE
      ELSE coalesce(b.by_{c}, a.ay_{c}) END, mu_{c}) AS lin
    FROM emp2 e JOIN nbr b ON b.well = e.well AND b.idx = e.mask_from JOIN nbr a ON a.well = e.well AND a.idx = e.mask_to - 1
    JOIN s ON s.well = e.well AND s.idx >= e.mask_from AND s.idx < e.mask_to JOIN scl ON scl.well = e.well WHERE mask_cols & {1 << i} > 0""" for i, c in enumerate(COLS)))
cte("em_pts", "em_win em_well", """SELECT 'locf_win' AS method, log, well, pred, truth FROM em_win UNION ALL SELECT 'locf', log, well, locf, truth FROM em_well
  UNION ALL SELECT 'interp_linear', log, well, lin, truth FROM em_well""")

def cubic(name: str, src: str) -> None:
    """Shape-preserving cubic at ``x`` between knots (x1, y1) and (x2, y2), with (x0, y0) and (x3, y3) beyond them."""
    end = lambda h, g, m, n: (f"CASE WHEN sign(((2 * {h} + {g}) * {m} - {h} * {n}) / ({h} + {g})) <> sign({m}) THEN 0 "  # noqa: E731
                              f"WHEN sign({m}) <> sign({n}) AND abs(((2 * {h} + {g}) * {m} - {h} * {n}) / ({h} + {g})) > 3 * abs({m}) THEN 3 * {m} "
                              f"ELSE ((2 * {h} + {g}) * {m} - {h} * {n}) / ({h} + {g}) END")
    mid = lambda h, g, m, n: f"CASE WHEN {m} * {n} <= 0 THEN 0 ELSE 3 * ({h} + {g}) / ((2 * {g} + {h}) / {m} + ({g} + 2 * {h}) / {n}) END"
    cte(name + "_m", src, f"SELECT *, (y1 - y0) / h0 AS m0, (y2 - y1) / h1 AS m1, (y3 - y2) / h2 AS m2 FROM "
                          f"(SELECT *, (x1 - x0)::DOUBLE AS h0, (x2 - x1)::DOUBLE AS h1, (x3 - x2)::DOUBLE AS h2 FROM {src})")
    cte(name + "_d", name + "_m", f"""SELECT *, CASE WHEN m0 IS NOT NULL THEN {mid('h0', 'h1', 'm0', 'm1')} WHEN m2 IS NOT NULL THEN {end('h1', 'h2', 'm1', 'm2')} END AS d1,
      CASE WHEN m2 IS NOT NULL THEN {mid('h1', 'h2', 'm1', 'm2')} WHEN m0 IS NOT NULL THEN {end('h1', 'h0', 'm1', 'm0')} END AS d2 FROM {name}_m""")
    cte(name, name + "_d", f"""SELECT *, CASE WHEN m1 IS NULL THEN coalesce(y1, y2) WHEN d1 IS NULL OR d2 IS NULL THEN y1 + m1 * (x - x1)
      ELSE y1 + (x - x1) * (d1 + (x - x1) / h1 * (3 * m1 - 2 * d1 - d2 + (x - x1) / h1 * (d1 + d2 - 2 * m1))) END AS cub FROM {name}_d""")


def four(lo: str, hi: str) -> str:
    """Joins of the knots numbered ``lo - 1``, ``lo``, ``hi`` and ``hi + 1``."""
    return " ".join(f"LEFT JOIN knots k{i} ON k{i}.well = p.well AND k{i}.log = p.log AND k{i}.ord = {o}" for i, o in enumerate((f"{lo} - 1", lo, hi, f"{hi} + 1")))


KNOTS = ", ".join(f"k{i}.idx AS x{i}, k{i}.y AS y{i}" for i in range(4))
cte("knots", "s", " UNION ALL ".join(
    f"SELECT well, '{c.upper()}' AS log, idx, {c} AS y, row_number() OVER (PARTITION BY well ORDER BY idx) AS ord FROM s WHERE {c} IS NOT NULL" for c in COLS))
cte("seen", "s", "SELECT well, idx, " + ", ".join(f"count({c}) OVER (PARTITION BY well ORDER BY idx) AS k_{c}, {c}" for c in COLS) + " FROM s")
cte("holes", "seen", " UNION ALL ".join(f"SELECT well, '{c.upper()}' AS log, idx AS x, k_{c} AS k FROM seen WHERE {c} IS NULL" for c in COLS))
cte("hole_knots", "holes knots", f"SELECT p.well, p.log, p.x, {KNOTS} FROM holes p {four('k', 'k + 1')}")
cubic("hole_cubic", "hole_knots")
cte("em5", "emp5 seen", " UNION ALL ".join(
    f"""SELECT e.well, seg_start, rep, '{c.upper()}' AS log, mask_from, mask_to, a.k_{c} - 1 AS lo, b.k_{c} + 1 AS hi
    FROM emp5 e JOIN seen a ON a.well = e.well AND a.idx = mask_from JOIN seen b ON b.well = e.well AND b.idx = mask_to - 1 WHERE mask_cols & {1 << i} > 0""" for i, c in enumerate(COLS)))
cte("em5_knots", "em5 knots", f"SELECT p.well, p.log, t.idx AS x, t.y AS truth, {KNOTS} FROM em5 p JOIN knots t ON t.well = p.well AND t.log = p.log AND t.idx >= mask_from AND t.idx < mask_to {four('lo', 'hi')}")
cubic("em5_cubic", "em5_knots")
cte("em5_pts", "em5_cubic scl", "SELECT 'interp_pchip' AS method, log, p.well, coalesce(cub, CASE log "
    + " ".join(f"WHEN '{c.upper()}' THEN mu_{c}" for c in COLS) + " END) AS pred, truth FROM em5_cubic p JOIN scl ON scl.well = p.well")

# --- tests --------------------------------------------------------------------------------------------------------
AVGR = "rank() OVER (PARTITION BY {p} ORDER BY {v}) + (count(*) OVER (PARTITION BY {p}, {v0}) - 1) / 2.0"
TIE = "count(*) OVER (PARTITION BY {p}, {v})"


def friedman(name: str, src: str, keys: str, block: str, value: str, desc: bool, by_method: bool) -> None:
    """Rank sums and the Friedman statistic over complete blocks or complete methods."""
    if by_method:
        cte(f"{name}_c", src, f"""SELECT * FROM (SELECT *, count({value}) OVER (PARTITION BY {keys}, method) AS have FROM {src}) q
          JOIN (SELECT {keys}, count(DISTINCT {block}) AS nb FROM {src} GROUP BY {keys}) USING ({keys}) WHERE have = nb AND nb >= 3""")
    else:
        cte(f"{name}_c", src, f"""SELECT * FROM (SELECT *, count({value}) OVER (PARTITION BY {keys}, {block}) AS have FROM {src}) q
          JOIN (SELECT {keys}, count(DISTINCT method) AS kk FROM {src} GROUP BY {keys}) USING ({keys}) WHERE have = kk""")
    p = f"{keys}, {block}"
    cte(f"{name}_r", f"{name}_c", f"SELECT *, {AVGR.format(p=p, v=value + (' DESC' if desc else ''), v0=value)} AS rk, {TIE.format(p=p, v=value)} AS tie FROM {name}_c")
    cte(f"{name}_s", f"{name}_r", f"SELECT {keys}, method, sum(rk) AS rs, avg(rk) AS mr, count(*) AS n, sum(tie * tie - 1) AS ties FROM {name}_r GROUP BY ALL")
    cte(name, f"{name}_s", f"""SELECT {keys}, k_methods, n_blocks, round(chi2, 5) AS chi2_F, round(chi2 / (n_blocks * (k_methods - 1)), 6) AS kendall_W FROM (
      SELECT {keys}, count(*) AS k_methods, max(n) AS n_blocks,
      (12.0 / (count(*) * max(n) * (count(*) + 1)) * sum(rs * rs) - 3.0 * max(n) * (count(*) + 1)) / (1 - sum(ties) / (count(*) * (count(*) * count(*) - 1.0) * max(n))) AS chi2
      FROM {name}_s GROUP BY {keys})""")


friedman("fr_w", "err", "scenario", "well", "nrmse", False, False)
cte("raw_all", "raw01", "SELECT * FROM raw01 WHERE log = 'all'")
friedman("fr_f", "raw_all", "scenario, seed", "fold", "r2", True, True)
cte("prs", "", " UNION ALL ".join(f"SELECT '{s}' AS scenario, {i * len(PAIRS) + j} AS pair_ord, '{a}' AS A, '{b}' AS B" for i, s in enumerate(SCENARIOS) for j, (a, b) in enumerate(PAIRS)))
cte("dif", "err prs", """SELECT p.scenario, pair_ord, A, B, a.well, round(a.nrmse - b.nrmse, 6) AS d FROM prs p JOIN err a ON a.scenario = p.scenario AND a.method = A
  JOIN err b ON b.scenario = p.scenario AND b.method = B AND a.well = b.well WHERE a.nrmse IS NOT NULL AND b.nrmse IS NOT NULL""")
cte("wrk", "dif", "SELECT *, " + AVGR.format(p="scenario, pair_ord, A, B", v="abs(d)", v0="abs(d)") + " AS rk FROM dif WHERE d <> 0")
cte("wsum", "wrk", "SELECT scenario, pair_ord, A, B, coalesce(sum(rk) FILTER (d > 0), 0) AS t_plus, coalesce(sum(rk) FILTER (d < 0), 0) AS t_minus FROM wrk GROUP BY ALL")
cte("sprk", "err navail", """SELECT scenario, gain, na FROM (SELECT c.scenario, c.well, round(c.nrmse - m.nrmse, 6) AS gain FROM err c JOIN err m
  ON c.scenario = m.scenario AND c.well = m.well WHERE c.method = 'mean' AND m.method = 'locf') g JOIN (SELECT well, round(n_avail, 6) AS na FROM navail) USING (well)
  WHERE gain IS NOT NULL AND na IS NOT NULL""")
cte("pv", "", "SELECT l_returnflag, l_linenumber, round(avg(l_discount) * avg(l_discount) * l_linenumber, 8) AS p FROM lineitem GROUP BY l_returnflag, l_linenumber")
cte("pvr", "pv", "SELECT *, count(*) OVER (PARTITION BY l_returnflag) - row_number() OVER (PARTITION BY l_returnflag ORDER BY p, l_linenumber) + 1 AS lft FROM pv")


def points(src: str, method: str) -> str:
    """Predictions of one method as rows."""
    digits = 9 if method == "interp_linear" else 5
    return f"SELECT well, start, t, log, round(pred, {digits}) AS pred FROM {src} WHERE method = '{method}'"


ORACLES: dict[str, str] = {}
for _s in SCENARIOS:
    ORACLES[f"mask_{_s}"] = build(summary(masked(f"k_{_s}", (_s,), (0, 1))), f"k_{_s}")
ORACLES["mask_blackout_partial"] = build(summary(masked("k_part", ("blackout",), (0, 1), False)), "k_part")
for _m, _s in (("mean", "profile"), ("locf", "block"), ("locf_win", "single"), ("interp_linear", "blackout"), ("ridge", "blackout")):
    masked(f"i_{_m}", (_s,), (0,))
    predicted(f"ip_{_m}", f"i_{_m}", (_m,))
    ORACLES[f"impute_{_m}"] = build(points(f"ip_{_m}", _m), f"ip_{_m}")
predicted("pb", "mb", ("locf",))

ORACLES |= {
    "coverage": build(" UNION ALL ".join(f"SELECT well, '{c.upper()}' AS log, round(count({c}) / count(*) * 100.0, 6) AS coverage_pct FROM s GROUP BY well" for c in COLS), "s"),
    "depth_qc": build("SELECT well, round(median_step_m, 4) AS median_step_m, round(min_step_m, 4) AS min_step_m, round(max_step_m, 4) AS max_step_m, n_nonpos, n_jumps, round(jump_m, 2) AS jump_m, status FROM qc_ev", "qc_ev"),
    "depth_qc_regular": build("SELECT well, round(median_step_m, 6) AS median_step_m, round(min_step_m, 6) AS min_step_m, round(max_step_m, 6) AS max_step_m, n_nonpos, n_jumps, round(jump_m, 2) AS jump_m, status FROM qc_s", "qc_s"),
    "harmonise_actions": build(" UNION ALL ".join(
        f"""SELECT well, '{c.upper()}' AS log, n_out, CASE WHEN txt = '' THEN 'ok' ELSE txt END AS action FROM (SELECT well, n_out, concat_ws('; ',
        {"CASE WHEN percent THEN '/100(%->frac)' END" if c == "nphi" else "NULL"}, {"CASE WHEN aberrant THEN 'EXCLUDED(GR median<6, aberrant)' END" if c == "gr" else "NULL"},
        CASE WHEN n_out > 0 THEN 'bounds[{lo},{hi}]:-' || n_out END) AS txt FROM (SELECT well, any_value(percent) AS percent, any_value(aberrant) AS aberrant,
        count(*) FILTER ({c} < {lo} OR {c} > {hi}) AS n_out FROM scaled GROUP BY well))""" for c, (lo, hi) in BOUNDS.items()), "scaled"),
    "harmonised_samples": build("SELECT well, idx, " + ", ".join(f"round(CASE WHEN NOT ({c} < {lo} OR {c} > {hi}) THEN {c} END, 6) AS {c}" for c, (lo, hi) in BOUNDS.items()) + " FROM scaled", "scaled"),
    "excluded_wells": build("SELECT well, status = 'kept' AS kept FROM qc_ev", "qc_ev"),
    "triplet_wells": build("SELECT well, count(*) AS n_complete FROM s WHERE gr IS NOT NULL AND rhob IS NOT NULL AND nphi IS NOT NULL GROUP BY well HAVING count(*) > 256", "s"),
    "cooccur_samples": build("""SELECT CAST(k AS INTEGER) AS k, count(well) AS n, round(count(well) / greatest(sum(count(well)) OVER (), 1), 6) AS prob FROM (SELECT unnest([1, 2, 3]) AS k) g
        LEFT JOIN (SELECT well, bit_count(code) AS b FROM code WHERE code > 0) c ON g.k = c.b GROUP BY k""", "code"),
    "cooccur_intervals": build("""SELECT CAST(k AS INTEGER) AS k, count(well) AS n, round(count(well) / greatest(sum(count(well)) OVER (), 1), 6) AS prob FROM (SELECT unnest([1, 2, 3]) AS k) g
        LEFT JOIN (SELECT well, bit_count(code) AS b FROM iv) c ON g.k = c.b GROUP BY k""", "iv"),
    "missing_intervals": build("SELECT * FROM iv", "iv"),
    "interval_combos": build("""SELECT combo, CAST(sum(length) AS BIGINT) AS n_samples, count(*) AS n_intervals, round(sum(length) / sum(sum(length)) OVER () * 100, 1) AS share_samples_pct,
        round(count(*) / sum(count(*)) OVER () * 100, 1) AS share_intervals_pct, """ + ", ".join(f"round(quantile_cont(length * 0.1524::DOUBLE, {q}), 1) AS p{int(q * 100)}_m" for q in (0.25, 0.5, 0.75, 0.9)) + " FROM iv GROUP BY combo", "iv"),
    "gap_lengths": build("SELECT well, log, start, \"end\", length, round(length_m, 6) AS length_m, is_edge FROM gapl", "gapl"),
    "gap_quartiles": build("SELECT scope, count(*) AS n, " + ", ".join(f"round(quantile_cont(length * 0.1524::DOUBLE, {q}), 1) AS p{int(q * 100)}_m" for q in (0.25, 0.5, 0.75, 0.9))
                           + " FROM (SELECT 'all' AS scope, length FROM gapl UNION ALL SELECT 'interior', length FROM gapl WHERE NOT is_edge) GROUP BY scope", "gapl"),
    "gaps_per_well": build("SELECT well, count(*) AS n_gaps FROM gapl GROUP BY well", "gapl"),
    "intact_segments": build("SELECT * FROM seg", "seg"),
    "windows_intact": build("SELECT * FROM win", "win"),
    "window_explode": build("SELECT well, start, t, round(gr, 6) AS gr, round(rhob, 6) AS rhob, round(nphi, 6) AS nphi FROM ws", "ws"),
    "folds_loo": build("SELECT * FROM folds", "folds"),
    "loo_scaler": build("SELECT well, " + ", ".join(f"round(a.mu_{c}, 6) AS mu_{c}, round(a.sd_{c}, 6) AS sd_{c}" for c in COLS) + " FROM (SELECT f.test_well AS well, "
                        + ", ".join(f"avg(ws.{c}) AS mu_{c}, stddev_pop(ws.{c}) + 1e-8 AS sd_{c}" for c in COLS) + " FROM folds f JOIN ws ON ws.well <> f.test_well GROUP BY f.test_well) a", "folds", "ws"),
    "standardised_windows": build("SELECT ws.well, start, t, " + ", ".join(f"round(({c} - mu_{c}) / sd_{c}, 6) + 0.0 AS z_{c}" for c in COLS) + " FROM ws JOIN scl ON ws.well = scl.well", "ws", "scl"),
    "segment_tiles": build("SELECT * FROM tile", "tile"),
    "mask_blackout_emp": build("SELECT * FROM emp5", "emp5"),
    "training_mask": build(summary("mtrain"), "mtrain"),
    "window_split": build("SELECT * FROM split", "split"),
    "matched_subsample": build("SELECT well, start FROM sh_sub WHERE pos < 25", "sh_sub"),
    "impute_locf_well": build("SELECT s.well, s.idx, " + ", ".join(f"round(coalesce({c}, by_{c}, mu_{c}), 6) AS {c}" for c in COLS) + " FROM s JOIN nbr n ON s.well = n.well AND s.idx = n.idx JOIN scl ON s.well = scl.well", "s", "nbr", "scl"),
    "impute_interp_well": build("SELECT s.well, s.idx, " + ", ".join(
        f"round(coalesce({c}, CASE WHEN by_{c} IS NOT NULL AND ay_{c} IS NOT NULL THEN by_{c} + (ay_{c} - by_{c}) * (s.idx - bt_{c}) / (at_{c} - bt_{c})::DOUBLE ELSE coalesce(by_{c}, ay_{c}) END, mu_{c}), 6) AS {c}"
        for c in COLS) + " FROM s JOIN nbr n ON s.well = n.well AND s.idx = n.idx JOIN scl ON s.well = scl.well", "s", "nbr", "scl"),
    "impute_pchip_well": build("SELECT s.well, s.idx, " + ", ".join(f"round(coalesce(s.{c}, q_{c}.cub, mu_{c}), 6) AS {c}" for c in COLS) + " FROM s JOIN scl ON s.well = scl.well "
                               + " ".join(f"LEFT JOIN hole_cubic q_{c} ON q_{c}.well = s.well AND q_{c}.x = s.idx AND q_{c}.log = '{c.upper()}'" for c in COLS), "s", "scl", "hole_cubic"),
    "empirical_pchip": build("SELECT method, log, well, count(*) AS n, round(sum((pred - truth) * (pred - truth)), CASE WHEN log = 'GR' THEN 3 ELSE 6 END) AS sse, round(sum(abs(pred - truth)), CASE WHEN log = 'GR' THEN 3 ELSE 6 END) AS sae FROM em5_pts GROUP BY method, log, well", "em5_pts"),
    "overlap_avg": build("SELECT well, seg_start, rep, idx, log, round(pred, 5) AS pred FROM em_win", "em_win"),
    "empirical_blackout": build("SELECT method, log, well, count(*) AS n, round(sum((pred - truth) * (pred - truth)), CASE WHEN log = 'GR' THEN 3 ELSE 6 END) AS sse, round(sum(abs(pred - truth)), CASE WHEN log = 'GR' THEN 3 ELSE 6 END) AS sae FROM em_pts GROUP BY method, log, well", "em_pts"),
    "entry_slice": build(f"""SELECT method, scenario, log, {r('mae', 6)}, {r('rmse', 6)}, {r('r2', 6)}, {r('cc', 6)}, n FROM (
        SELECT method, scenario, log, {MET} FROM pb GROUP BY method, scenario, log UNION ALL SELECT method, scenario, 'all', {MET} FROM pb GROUP BY method, scenario)""", "pb"),
    "point_metrics": build(f"""SELECT method, scenario, log, {r('mae', 6)}, {r('rmse', 6)}, {r('r2', 6)}, {r('cc', 5)}, n FROM (
        SELECT method, scenario, log, {MET} FROM p0 GROUP BY method, scenario, log UNION ALL SELECT method, scenario, 'all', {MET} FROM p0 GROUP BY method, scenario)""", "p0"),
    "pooled_vs_foldmean": build(f"""SELECT method, scenario, log, {r('pooled_r2', 5)}, n, {r('fold_mean_r2', 5)}, n_folds FROM (SELECT method, scenario, log, r2 AS pooled_r2, n FROM (SELECT method, scenario, log, {MET} FROM p0 GROUP BY ALL)) a
        JOIN (SELECT method, scenario, log, avg(r2) AS fold_mean_r2, count(r2) AS n_folds FROM (SELECT method, scenario, log, well, {MET} FROM p0 GROUP BY ALL) WHERE r2 IS NOT NULL GROUP BY ALL) b USING (method, scenario, log)""", "p0"),
    "suff_stats": build("SELECT method, log, scenario, mask_seed, init_seed, well, n, " + ", ".join(f"round({c}, CASE WHEN log = 'GR' THEN 3 ELSE 6 END) AS {c}" for c in ("sum_y", "sum_y2", "sse", "sae")) + " FROM f01", "f01"),
    "macro_r2": build(f"SELECT method, init_seed, mask_seed, scenario, {r('r2_macro', 6)} FROM f01_mac", "f01_mac"),
    "nrmse_well": build("SELECT method, init_seed, mask_seed, scenario, well, round(nrmse, 6) AS nrmse FROM nr", "nr"),
    "fallback_sigma": build("""SELECT method, init_seed, mask_seed, scenario, log, well, round(CASE WHEN n_ > 1 THEN sqrt(greatest(sy2 / n_ - (sy / n_) * (sy / n_), 0)) END, 5) AS sigma FROM (SELECT *,
        sum(n) OVER g - n AS n_, sum(sum_y) OVER g - sum_y AS sy, sum(sum_y2) OVER g - sum_y2 AS sy2 FROM f01 WINDOW g AS (PARTITION BY method, init_seed, mask_seed, scenario, log))""", "f01"),
    "per_log_table": build(f"""SELECT method, scenario, log, count(*) AS n_seeds, {r('avg(r2)', 6, 'r2_mean')}, {r('coalesce(stddev_samp(r2), 0.0)', 6, 'r2_sd')}, {r('avg(mae)', 6, 'mae_mean')}, {r('avg(rmse)', 6, 'rmse_mean')}
        FROM f01_log GROUP BY method, scenario, log""", "f01_log"),
    "main_table": build(f"""SELECT method, scenario, n_seeds, {r('m', 6, 'r2_macro_mean')}, {r('sd', 6, 'r2_macro_sd')}, row_number() OVER (PARTITION BY scenario ORDER BY round(m, 9) DESC, {MORD}, method) AS rank_r2_macro,
        round(q1, 6) AS nrmse_well_q1, round(q2, 6) AS nrmse_well_median, round(q3, 6) AS nrmse_well_q3, round(av, 6) AS nrmse_well_mean
        FROM (SELECT method, scenario, count(*) AS n_seeds, avg(r2_macro) AS m, coalesce(stddev_samp(r2_macro), 0.0) AS sd FROM f01_mac GROUP BY method, scenario) a
        LEFT JOIN (SELECT method, scenario, quantile_cont(nrmse, 0.25) AS q1, quantile_cont(nrmse, 0.5) AS q2, quantile_cont(nrmse, 0.75) AS q3, avg(nrmse) AS av FROM err0 GROUP BY method, scenario) b USING (method, scenario)""", "f01_mac", "err0"),
    "seed_variance": build(f"""SELECT method, scenario, 2 AS n_init_seeds, count(*) AS n_mask_seeds, {r('avg(r2_macro)', 6, 'r2_macro_mean')}, 2 * count(*) AS n_cells, 0.0 AS sd_init,
        {r('stddev_samp(r2_macro)', 6, 'sd_mask')}, 0.0 AS sd_init_at_mask0 FROM fml_mac GROUP BY method, scenario""", "fml_mac"),
    "rank_stability": build(f"SELECT scenario, mask_seed AS seed, row_number() OVER (PARTITION BY scenario, mask_seed ORDER BY round(r2, 9) DESC, {MORD}, method) AS rank, method, {r('r2', 6, 'r2_all')} FROM f01_all WHERE log = 'all'", "f01_all"),
    "top_verdict": build(f"""SELECT scenario, count(*) AS n_seeds, count(DISTINCT method) AS n_leaders, array_to_string(list_sort(list(DISTINCT method)), ',') AS leaders,
        CASE WHEN count(DISTINCT method) = 1 THEN 'STABLE' ELSE 'UNSTABLE' END AS verdict FROM (SELECT scenario, method, row_number() OVER (PARTITION BY scenario, mask_seed ORDER BY round(r2, 9) DESC, {MORD}, method) AS rk FROM f01_all WHERE log = 'all')
        WHERE rk = 1 GROUP BY scenario""", "f01_all"),
    "seed_ci": build(f"""SELECT method, scenario, log, n_seeds, {r('m', 6, '"pooledR2_mean"')}, {r('sd', 6, '"pooledR2_std"')}, {r('m - 12.706204736174694 * sd / sqrt(2)', 5, '"pooledR2_ci_low"')}, {r('m + 12.706204736174694 * sd / sqrt(2)', 5, '"pooledR2_ci_high"')}
        FROM (SELECT method, scenario, log, count(*) AS n_seeds, avg(r2) AS m, stddev_samp(r2) AS sd FROM f01_all GROUP BY ALL)""", "f01_all"),
    "fold_spread": build(f"SELECT method, scenario, log, {r('avg(r2)', 9, 'fold_mean')}, count(r2) AS n_folds, {r('quantile_cont(r2, 0.5)', 7, 'fold_median')} FROM raw01 WHERE seed = 0 GROUP BY method, scenario, log", "raw01"),
    "dedup_raw": "SELECT user_id AS seed, event_type AS method, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "mask_parity": build("SELECT scenario, mask_seed, log, count(DISTINCT method) AS n_methods, CAST(sum(n) AS BIGINT) AS n_points, 0 AS bad FROM f0 GROUP BY scenario, mask_seed, log", "f0"),
    "mask_ids": build("""SELECT scenario, mask_seed, fold_id AS fold, 'W' || lpad(CAST(fold_id + 1 AS VARCHAR), CAST(greatest(2, length(CAST(fold_id + 1 AS VARCHAR))) AS INTEGER), '0') AS label,
        coalesce(max(n) FILTER (log = 'GR'), 0) AS "n_GR", coalesce(max(n) FILTER (log = 'RHOB'), 0) AS "n_RHOB", coalesce(max(n) FILTER (log = 'NPHI'), 0) AS "n_NPHI"
        FROM fml JOIN folds ON well = test_well WHERE method = 'mean' GROUP BY scenario, mask_seed, fold_id""", "fml", "folds"),
    "friedman_wells": build('SELECT scenario, k_methods, n_blocks, chi2_F AS "chi2_F", kendall_W AS "kendall_W" FROM fr_w', "fr_w"),
    "friedman_folds": build('SELECT scenario, seed, k_methods, n_blocks, chi2_F AS "chi2_F", kendall_W AS "kendall_W" FROM fr_f', "fr_f"),
    "nemenyi_ranks": build("""SELECT a.scenario, a.method AS "A", b.method AS "B", round(abs(a.mr - b.mr), 6) AS rank_gap, round(abs(a.mr - b.mr) / sqrt(a.k * (a.k + 1) / (6.0 * a.n)) * sqrt(2.0), 5) AS q
        FROM (SELECT *, count(*) OVER (PARTITION BY scenario) AS k FROM fr_w_s) a JOIN fr_w_s b ON a.scenario = b.scenario AND a.method < b.method""", "fr_w_s"),
    "wilcoxon_stat": build("""SELECT b.scenario, b.pair_ord, b.A AS "A", b.B AS "B", n, n_zero, round(med, 7) + 0.0 AS median_diff, t_plus, t_minus,
        CASE WHEN n >= 5 AND t_plus IS NOT NULL THEN least(t_plus, t_minus) END AS "W_stat", CASE WHEN n >= 5 THEN round((t_plus - t_minus) / (t_plus + t_minus), 6) + 0.0 END AS rank_biserial
        FROM (SELECT scenario, pair_ord, A, B, count(*) AS n, count(*) FILTER (d = 0) AS n_zero, quantile_cont(d, 0.5) AS med FROM dif GROUP BY ALL) b
        LEFT JOIN wsum w ON b.scenario = w.scenario AND b.pair_ord = w.pair_ord""", "dif", "wsum"),
    "holm": build("""SELECT l_returnflag, l_linenumber, p, round(max(least(1.0, lft * p)) OVER w, 6) AS p_holm, min(CASE WHEN p <= 0.05::DOUBLE / lft THEN 1 ELSE 0 END) OVER w = 1 AS reject
        FROM pvr WINDOW w AS (PARTITION BY l_returnflag ORDER BY p, l_linenumber)""", "pvr"),
    "spearman": build(f"""SELECT scenario, count(*) AS n, round(corr(ra, rb), 6) + 0.0 AS rho FROM (SELECT *, {AVGR.format(p='scenario', v='gain', v0='gain')} AS ra, {AVGR.format(p='scenario', v='na', v0='na')} AS rb FROM sprk) GROUP BY scenario""", "sprk"),
    "bootstrap_point": build("""SELECT p.scenario, A AS "A", B AS "B", round(avg(a.r2_macro - b.r2_macro), 6) + 0.0 AS delta FROM prs p JOIN f01_mac a ON a.scenario = p.scenario AND a.method = A
        JOIN f01_mac b ON b.scenario = p.scenario AND b.method = B AND a.mask_seed = b.mask_seed GROUP BY ALL""", "prs", "f01_mac"),
    "pair_alignment": build("SELECT scenario, count(*) AS n, 0 AS bad FROM p0 WHERE method = 'mean' GROUP BY scenario", "p0"),
    "knn_graph": build("SELECT src, dst, round(d_km, 6) AS d_km, rank FROM edges", "edges"),
    "median_distance": build("SELECT round(scale_km, 6) AS scale_km FROM scale", "scale"),
    "adjacency": build("SELECT src, dst, round(d_km, 6) AS d_km, round(weight, 6) AS weight FROM adj", "adj"),
    "graph_aggregate": build("SELECT a.src AS well, g, round(sum(weight * coalesce(gr, 0.0)), 4) AS gr, round(sum(weight * coalesce(rhob, 0.0)), 5) AS rhob, round(sum(weight * coalesce(nphi, 0.0)), 5) AS nphi FROM adj a JOIN grid ON grid.well = a.dst GROUP BY a.src, g", "adj", "grid"),
    "grid_offsets": build("SELECT * FROM offs", "offs"),
    "impute_idw": build("""SELECT well, start, t, log, round(coalesce(num / den, mu), 4) AS pred FROM (SELECT t.well, t.start, t.t, t.log, sum(v.v / pow(greatest(d.d / 1000.0, 0.001), 2)) AS num, sum(1 / pow(greatest(d.d / 1000.0, 0.001), 2)) AS den
        FROM sp_t t LEFT JOIN sp_v v ON v.g = t.g AND v.log = t.log AND v.well <> t.well LEFT JOIN dist d ON d.src = t.well AND d.dst = v.well GROUP BY ALL) JOIN mus USING (well, log)""", "sp_t", "sp_v", "dist", "mus"),
    "impute_nnwell": build("""SELECT well, start, t, log, round(coalesce(nv, mu), 4) AS pred FROM (SELECT t.well, t.start, t.t, t.log, min_by(v.v, d.d) AS nv
        FROM sp_t t LEFT JOIN sp_v v ON v.g = t.g AND v.log = t.log AND v.well <> t.well LEFT JOIN dist d ON d.src = t.well AND d.dst = v.well GROUP BY ALL) JOIN mus USING (well, log)""", "sp_t", "sp_v", "dist", "mus"),
    "variogram_pairs": build("""SELECT a.well AS a, b.well AS b, a.log, round(any_value(d.d) / 1000.0, 6) AS d_km, count(*) AS n, round(sum((a.v - b.v) * (a.v - b.v)), 6) AS sum_sq FROM sp_v a JOIN sp_v b ON a.g = b.g AND a.log = b.log AND a.well < b.well
        JOIN dist d ON d.src = a.well AND d.dst = b.well GROUP BY a.well, b.well, a.log""", "sp_v", "dist"),
    "neighbour_availability": build("SELECT well, round(n_avail, 6) AS n_avail, round(d_nearest_km, 6) AS d_nearest_km, round(w_avail, 6) AS w_avail, k_neighbours FROM navail", "navail"),
    "norm_ids": """SELECT s_suppkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(upper(lower(s_name) || '_ss--' || s_nationkey || 'd-14-' || s_suppkey || 'x'),
        '-?14-\\d+.*$', ''), '_', '-'), '-+', '-', 'g'), '^-+|-+$', '', 'g'), '(\\d+)D\\b', '\\1', 'g'), '\\bSS\\b', 'SOUS', 'g') AS norm_id FROM supplier""",
    "leak_overlap_antijoin": build("SELECT * FROM setb", "setb"),
    "leak_matched_sizes": build("""SELECT config, n, min(n) OVER () AS n_match FROM (SELECT 'A_window_overlap' AS config, count(*) AS n FROM split WHERE NOT is_test UNION ALL SELECT 'B_window_no_overlap', count(*) FROM setb
        UNION ALL SELECT 'D_well_split', min(tot - w) FROM (SELECT well, count(*) AS w, bool_or(is_test) AS has, sum(count(*)) OVER () AS tot FROM split GROUP BY well) WHERE has)""".replace("min(tot - w)", "CAST(min(tot - w) AS BIGINT)"), "split", "setb"),
    "histogram": build(" UNION ALL ".join(f"""SELECT '{c.upper()}' AS log, CAST(least(79, floor(({c} - lo) / (hi - lo) * 80)) AS INTEGER) AS bin, count(*) AS n FROM s, (SELECT min({c}) AS lo, max({c}) AS hi FROM s)
        WHERE {c} IS NOT NULL GROUP BY ALL""" for c in COLS), "s"),
    "pairwise_corr": build(" UNION ALL ".join(f"SELECT '{a.upper()}' AS log_a, '{b.upper()}' AS log_b, round(corr({a}, {b}), 6) + 0.0 AS r, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM s"
                                             for a, b in (("gr", "rhob"), ("gr", "nphi"), ("rhob", "nphi"))), "s"),
    "hexbin": build("""SELECT CASE WHEN a < b THEN 0 ELSE 1 END AS lattice, CAST(CASE WHEN a < b THEN i1 ELSE i2 END AS INTEGER) AS i, CAST(CASE WHEN a < b THEN j1 ELSE j2 END AS INTEGER) AS j, count(*) AS n FROM (
        SELECT *, pow(u - i1, 2) + 3 * pow(v - j1, 2) AS a, pow(u - i2 - 0.5, 2) + 3 * pow(v - j2 - 0.5, 2) AS b FROM (SELECT *, round_even(u, 0) AS i1, round_even(v, 0) AS j1, floor(u) AS i2, floor(v) AS j2 FROM (
        SELECT (gr - x0) / ((x1 - x0) / 60) AS u, (rhob - y0) / ((y1 - y0) / 34) AS v FROM s, (SELECT min(gr) AS x0, max(gr) AS x1, min(rhob) AS y0, max(rhob) AS y1 FROM s WHERE gr IS NOT NULL AND rhob IS NOT NULL)
        WHERE gr IS NOT NULL AND rhob IS NOT NULL))) GROUP BY ALL""", "s"),
}

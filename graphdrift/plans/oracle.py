"""DuckDB SQL twins of the registered queries (the correctness oracle).

The SQL is written independently of the Spark plans, in the plainest form: all-pairs
repulsion is a brute-force self-join here (only the oracle does that, on the small
check data), iterations are unrolled CTE chains.  Literals come from the same
parameter objects as the Spark queries, printed with ``repr`` so both engines see the
same doubles.
"""

from __future__ import annotations

from ..model import LayoutParams
from ..operators.coarsen import MATCH_ROUNDS
from . import queries as Q


def d(v: float) -> str:
    """A double literal."""
    return f"CAST({float(v)!r} AS DOUBLE)"


def r4(expr: str, alias: str) -> str:
    return f"ROUND({expr}, 4) + 0.0 AS \"{alias}\""


def unit_hash(*parts: str) -> str:
    return f"(CAST(CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 12) AS BIGINT) AS DOUBLE) / {d(1 << 48)})"


def on_grid(expr: str, eps: float) -> str:
    return f"(floor(({expr}) / {d(eps)} + {d(0.5)}) * {d(eps)})"


def pos(id_expr: str, width: float, height: float, seed: int = 0, bounds: str = "center", eps: float = 1e-4) -> str:
    x0, y0 = (-width / 2, -height / 2) if bounds == "center" else (0.0, 0.0)
    draw = lambda axis, lo, size: on_grid(
        f"{d(lo)} + {unit_hash(str(seed), repr(axis), f'CAST({id_expr} AS VARCHAR)')} * {d(size)}", eps)
    return f"{draw('x', x0, width)} AS x, {draw('y', y0, height)} AS y"


# ----------------------------------------------------------------------------- views

def v_trade(width=10000.0, height=10000.0, seed=0, bounds="center"):
    return (f"SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS label, {pos('n_nationkey', width, height, seed, bounds)}, "
            f"{d(0)} AS dx, {d(0)} AS dy FROM nation")


LI_NATION = ("SELECT l_orderkey, s_nationkey, COUNT(*) AS n_items, SUM(l_extendedprice) AS revenue "
             "FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_orderkey, s_nationkey")


ORDER_NATION = "SELECT o_orderkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey"


E_TRADE = (f"SELECT CAST(s_nationkey AS BIGINT) AS src, CAST(c_nationkey AS BIGINT) AS dst, "
           f"CAST(SUM(n_items) AS DOUBLE) AS weight FROM ({LI_NATION}) li JOIN ({ORDER_NATION}) oc "
           f"ON l_orderkey = o_orderkey GROUP BY s_nationkey, c_nationkey")

E_TRADE_FUNC = (f"SELECT src, dst, w / MAX(w) OVER () AS weight FROM ("
                f"SELECT CAST(s_nationkey AS BIGINT) AS src, CAST(c_nationkey AS BIGINT) AS dst, SUM(revenue) AS w "
                f"FROM ({LI_NATION}) li JOIN ({ORDER_NATION}) oc ON l_orderkey = o_orderkey "
                f"GROUP BY s_nationkey, c_nationkey) t")


def v_supply(width=10000.0, height=10000.0, seed=0):
    return (f"SELECT id, label, {pos('id', width, height, seed)}, {d(0)} AS dx, {d(0)} AS dy FROM ("
            f"SELECT CAST(p_partkey * 2 AS BIGINT) AS id, 'P' || CAST(p_partkey AS VARCHAR) AS label FROM part "
            f"UNION ALL SELECT CAST(s_suppkey * 2 + 1 AS BIGINT), s_name FROM supplier) t")


E_SUPPLY = ("SELECT CAST(l_partkey * 2 AS BIGINT) AS src, CAST(l_suppkey * 2 + 1 AS BIGINT) AS dst, "
            "CAST(SUM(l_quantity) AS DOUBLE) AS weight FROM lineitem GROUP BY l_partkey, l_suppkey")


V_MARKET = ("SELECT CAST(c_custkey * 3 AS BIGINT) AS id FROM customer UNION ALL SELECT CAST(p_partkey * 3 + 1 AS BIGINT) FROM part "
            "UNION ALL SELECT CAST(s_suppkey * 3 + 2 AS BIGINT) FROM supplier")
E_MARKET = ("SELECT DISTINCT src, dst FROM (SELECT o_custkey * 3 AS src, l_partkey * 3 + 1 AS dst FROM lineitem JOIN orders "
            "ON l_orderkey = o_orderkey UNION ALL SELECT l_partkey * 3 + 1, l_suppkey * 3 + 2 FROM lineitem UNION ALL "
            "SELECT l_suppkey * 3 + 2, o_custkey * 3 FROM lineitem JOIN orders ON l_orderkey = o_orderkey) t")


def v_geo(with_regions=True):
    parts = [f"SELECT CAST(n_nationkey AS BIGINT) * 3 + 1 AS id, n_name AS label FROM nation",
             f"SELECT CAST(c_custkey AS BIGINT) * 3 + 2, c_name FROM customer"]
    if with_regions:
        parts.insert(0, "SELECT CAST(r_regionkey AS BIGINT) * 3 AS id, r_name AS label FROM region")
    return (f"SELECT id, label, {pos('id', 10000.0, 10000.0)}, {d(0)} AS dx, {d(0)} AS dy FROM ("
            + " UNION ALL ".join(parts) + ") t")


E_GEO = (f"SELECT CAST(n_nationkey AS BIGINT) * 3 + 1 AS src, CAST(n_regionkey AS BIGINT) * 3 AS dst, {d(1)} AS weight "
         f"FROM nation UNION ALL SELECT CAST(c_custkey AS BIGINT) * 3 + 2, CAST(c_nationkey AS BIGINT) * 3 + 1, {d(1)} "
         f"FROM customer")


def lines(with_comments: bool) -> str:
    li = ("SELECT concat_ws(chr(9), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), "
          "CAST(l_quantity AS VARCHAR)) AS value FROM lineitem")
    if not with_comments:
        return li
    return li + " UNION ALL SELECT '# order ' || CAST(o_orderkey AS VARCHAR) FROM orders"


PARSE = (f"SELECT CAST(split_part(value, chr(9), 1) AS BIGINT) AS src, CAST(split_part(value, chr(9), 2) AS BIGINT) AS dst, "
         f"{d(1)} AS weight FROM lines")


def block_ctes() -> list[tuple[str, str]]:
    """CTEs of the grid of link blocks: dealt (block, src, dst) and routes (block, id)."""
    drawn = lambda n, *parts: f"CAST(floor({unit_hash(*parts)} * {n}) AS BIGINT)"
    text = lambda c: f"CAST({c} AS VARCHAR)"
    placed = (f"SELECT src, dst, q, {drawn('q', repr('row'), text('src'))} AS r, {drawn('q', repr('col'), text('dst'))} AS c "
              f"FROM e, (SELECT GREATEST(1, CAST(ceil(sqrt(COUNT(*) / {d(Q.QUERY_BLOCK)})) AS BIGINT)) AS q FROM e) side")
    cut = f"SELECT r, c, CAST(ceil(COUNT(*) / {d(Q.QUERY_BLOCK)}) AS BIGINT) AS parts FROM placed GROUP BY r, c"
    dealt = (f"SELECT (p.r * p.q + p.c) * (SELECT MAX(parts) FROM cut) + "
             f"{drawn('cut.parts', repr('part'), text('src'), text('dst'))} AS block, src, dst "
             f"FROM placed p JOIN cut ON p.r = cut.r AND p.c = cut.c")
    return [("e", E_SUPPLY), ("placed", placed), ("cut", cut), ("dealt", dealt),
            ("routes", "SELECT block, src AS id FROM dealt UNION SELECT block, dst FROM dealt")]


def with_(*ctes: tuple[str, str], body: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({s})" for n, s in ctes) + "\n" + body


# ----------------------------------------------------------------------------- force fragments

def k_expr(v: str, p: LayoutParams) -> str:
    return f"(SELECT {d(p.kf)} * sqrt({d(p.area)} / COUNT(*)) FROM {v})"


def rep_all(v: str, k: str, p: LayoutParams) -> str:
    """(id, dx, dy): brute force over all ordered pairs."""
    l2 = f"GREATEST({d(p.eps ** 2)}, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"
    f = f"{d(p.rep_scale)} * {k} * {k}"
    return (f"SELECT a.id, COALESCE(SUM((a.x - b.x) / {l2}), 0) * {f} AS dx, "
            f"COALESCE(SUM((a.y - b.y) / {l2}), 0) * {f} AS dy "
            f"FROM {v} a LEFT JOIN {v} b ON a.id <> b.id GROUP BY a.id")


def rep_radius(v: str, k: str, p: LayoutParams) -> str:
    """(id, dx, dy): brute force over ordered pairs within the radius."""
    l2 = "GREATEST({e}, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))".format(e=d(p.eps ** 2))
    within = f"(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {d(p.radius ** 2)}"
    f = f"{d(p.rep_scale)} * {k} * {k}"
    return (f"SELECT a.id, COALESCE(SUM((a.x - b.x) / {l2}), 0) * {f} AS dx, "
            f"COALESCE(SUM((a.y - b.y) / {l2}), 0) * {f} AS dy "
            f"FROM {v} a LEFT JOIN {v} b ON a.id <> b.id AND {within} GROUP BY a.id")


def rep_term(dx: str, dy: str, k: str, p: LayoutParams) -> tuple[str, str]:
    l = f"GREATEST({d(p.eps)}, sqrt(({dx}) * ({dx}) + ({dy}) * ({dy})))"
    f = f"({d(p.rep_scale)} * {k} * {k} / ({l} * {l}))"
    return f"{f} * ({dx})", f"{f} * ({dy})"


def rep_neighbors(v: str, e: str, k: str, p: LayoutParams) -> str:
    """(id, dx, dy): from linked vertices, each neighbour once."""
    nx, ny = rep_term("s.x - t.x", "s.y - t.y", k, p)
    pairs = UNDIRECTED.format(e=e)
    return (f"SELECT a.id, COALESCE(f.fx, 0) AS dx, COALESCE(f.fy, 0) AS dy FROM {v} a LEFT JOIN (SELECT pr.src AS id, "
            f"SUM({nx}) AS fx, SUM({ny}) AS fy FROM ({pairs}) pr JOIN {v} s ON pr.src = s.id JOIN {v} t ON pr.dst = t.id "
            f"GROUP BY pr.src) f ON a.id = f.id")


def attr_links(v: str, e: str, k: str, p: LayoutParams, weighted: bool) -> str:
    dx, dy = "(s.x - t.x)", "(s.y - t.y)"
    l = f"GREATEST({d(p.eps)}, sqrt({dx} * {dx} + {dy} * {dy}))"
    f = f"({d(p.attr_scale)} * {l} / {k})" + (" * e.weight" if weighted else "")
    return (f"SELECT e.src, e.dst, {f} * {dx} AS mx, {f} * {dy} AS my "
            f"FROM {e} e JOIN {v} s ON e.src = s.id JOIN {v} t ON e.dst = t.id")


def attr_both(v: str, e: str, k: str, p: LayoutParams, weighted: bool) -> str:
    m = attr_links(v, e, k, p, weighted)
    return (f"SELECT vv.id, COALESCE(SUM(u.dx), 0) AS dx, COALESCE(SUM(u.dy), 0) AS dy FROM {v} vv LEFT JOIN ("
            f"SELECT dst AS id, mx AS dx, my AS dy FROM ({m}) m1 UNION ALL "
            f"SELECT src, -mx, -my FROM ({m}) m2) u ON vv.id = u.id GROUP BY vv.id")


def attr_target(v: str, e: str, k: str, p: LayoutParams, weighted: bool) -> str:
    m = attr_links(v, e, k, p, weighted)
    return (f"SELECT vv.id, COALESCE(SUM(m.mx), 0) AS dx, COALESCE(SUM(m.my), 0) AS dy FROM {v} vv "
            f"LEFT JOIN ({m}) m ON vv.id = m.dst GROUP BY vv.id")


def grav(x: str, y: str, p: LayoutParams) -> tuple[str, str]:
    l = f"GREATEST({d(p.eps)}, sqrt({x} * {x} + {y} * {y}))"
    f = f"({d(-p.gravity)} / ({l} * {l}))"
    return f"{f} * {x}", f"{f} * {y}"


def parts(v: str, e: str, k: str, p: LayoutParams) -> str:
    """(id, label, x, y, rep_dx, rep_dy, attr_dx, attr_dy, grav_dx, grav_dy)."""
    rep = {"radius": lambda: rep_radius(v, k, p), "all": lambda: rep_all(v, k, p),
           "neighbors": lambda: rep_neighbors(v, e, k, p)}[p.repulsion]()
    att = (attr_target if p.attraction == "target" else attr_both)(v, e, k, p, p.weighted)
    gx, gy = grav("vv.x", "vv.y", p)
    return (f"SELECT vv.id, vv.label, vv.x, vv.y, r.dx AS rep_dx, r.dy AS rep_dy, a.dx AS attr_dx, a.dy AS attr_dy, "
            f"{gx} AS grav_dx, {gy} AS grav_dy FROM {v} vv JOIN ({rep}) r ON vv.id = r.id "
            f"JOIN ({att}) a ON vv.id = a.id")


def factor(p: LayoutParams, iteration: int, temperature: float, dx="dx", dy="dy") -> str:
    if p.step == "temperature_cap":
        n = f"sqrt({dx} * {dx} + {dy} * {dy})"
        return f"CASE WHEN {n} > 0 THEN LEAST({d(temperature)}, {n}) / {n} ELSE {d(0)} END"
    if p.step == "inverse_iteration":
        return d(10.0 / iteration)
    return d(1.0)


def clamp(expr: str, lo: float, hi: float) -> str:
    return f"GREATEST({d(lo)}, LEAST({d(hi)}, {expr}))"


def bounds(p: LayoutParams):
    if p.bounds == "center":
        return -p.width / 2, p.width / 2, -p.height / 2, p.height / 2
    if p.bounds == "corner":
        return 0.0, p.width, 0.0, p.height
    return None


def moved(expr_x: str, expr_y: str, p: LayoutParams) -> tuple[str, str]:
    b = bounds(p)
    expr_x, expr_y = on_grid(expr_x, p.eps), on_grid(expr_y, p.eps)
    if b is None:
        return expr_x, expr_y
    return clamp(expr_x, b[0], b[1]), clamp(expr_y, b[2], b[3])


def layout_ctes(v0: str, e: str, p: LayoutParams, prefix: str = "") -> tuple[list[tuple[str, str]], str, str]:
    """CTEs of the unrolled layout; returns (ctes, final vertex cte, k expression).
    Each iteration t has f{t} (parts + step + new position) and v{t} (vertices)."""
    k = k_expr(v0, p)
    ctes = []
    cur = v0
    for t in range(1, p.rounds + 1):
        temp = p.temperature(t - 1)
        fp = f"{prefix}f{t}"
        tot = (f"SELECT *, rep_dx + attr_dx + grav_dx AS tdx, rep_dy + attr_dy + grav_dy AS tdy "
               f"FROM ({parts(cur, e, k, p)}) pp")
        fac = factor(p, t, temp, "tdx", "tdy")
        stepped = f"SELECT *, tdx * ({fac}) AS sx, tdy * ({fac}) AS sy FROM ({tot}) tt"
        nx, ny = moved("x + sx", "y + sy", p)
        ctes.append((fp, f"SELECT *, {nx} AS nx, {ny} AS ny FROM ({stepped}) ss"))
        vt = f"{prefix}v{t}"
        ctes.append((vt, f"SELECT id, label, nx AS x, ny AS y, -sx AS dx, -sy AS dy FROM {fp}"))
        cur = vt
    return ctes, cur, k


def layout_sql(v0_sql: str, e_sql: str, p: LayoutParams) -> str:
    ctes, last, _ = layout_ctes("v0", "e", p)
    body = (f"SELECT id, label, {r4('x', 'x')}, {r4('y', 'y')}, {r4('dx', 'dx')}, {r4('dy', 'dy')} FROM {last}")
    return with_(("v0", v0_sql), ("e", e_sql), *ctes, body=body)


# ----------------------------------------------------------------------------- statistics fragments

UNDIRECTED = ("SELECT DISTINCT src, dst FROM (SELECT src, dst FROM {e} UNION ALL SELECT dst, src FROM {e}) s "
              "WHERE src <> dst")


def lp_ctes(v: str, e: str, rounds: int) -> tuple[list[tuple[str, str]], str]:
    ctes = [("lp_pairs", UNDIRECTED.format(e=e)), ("lp0", f"SELECT id, id AS module FROM {v}")]
    for r in range(1, rounds + 1):
        prev = f"lp{r - 1}"
        votes = (f"SELECT p.dst AS id, l.module, COUNT(*) AS votes FROM lp_pairs p JOIN {prev} l ON p.src = l.id "
                 f"GROUP BY p.dst, l.module")
        best = (f"SELECT id, module FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY votes DESC, module ASC) "
                f"AS rn FROM ({votes}) vv) x WHERE rn = 1")
        ctes.append((f"lp{r}", f"SELECT l.id, COALESCE(b.module, l.module) AS module FROM {prev} l "
                               f"LEFT JOIN ({best}) b ON l.id = b.id"))
    return ctes, f"lp{rounds}"


def match_ctes(v: str, e: str, rounds: int) -> list[tuple[str, str]]:
    """Heavy-edge matching: (id, cluster) as ``cl``; links ranked by weight, hash, ends."""
    h = unit_hash("'match'", "CAST(lo AS VARCHAR)", "CAST(hi AS VARCHAR)")
    ctes = [("once", f"SELECT LEAST(src, dst) AS lo, GREATEST(src, dst) AS hi, SUM(COALESCE(weight, 1)) AS w FROM {e} "
                     "WHERE src <> dst GROUP BY 1, 2"),
            ("rk", f"SELECT lo, hi, ROW_NUMBER() OVER (ORDER BY w, {h}, lo, hi) AS r FROM once WHERE w > 0"),
            ("pr", "SELECT lo AS u, hi AS v, r FROM rk UNION ALL SELECT hi, lo, r FROM rk"), ("free0", "SELECT * FROM pr")]
    for t in range(1, rounds + 1):
        ctes += [(f"mt{t}", f"SELECT lo, hi FROM rk WHERE r IN (SELECT r FROM (SELECT u, MAX(r) AS r FROM free{t - 1} GROUP BY u) b "
                            "GROUP BY r HAVING COUNT(*) = 2)"),
                 (f"tk{t}", f"SELECT lo AS id, lo AS cluster FROM mt{t} UNION ALL SELECT hi, lo FROM mt{t}"),
                 (f"free{t}", f"SELECT * FROM free{t - 1} WHERE u NOT IN (SELECT id FROM tk{t}) AND v NOT IN (SELECT id FROM tk{t})")]
    ctes.append(("mat", " UNION ALL ".join(f"SELECT id, cluster FROM tk{t}" for t in range(1, rounds + 1))))
    ctes.append(("late", "SELECT u AS id, ARG_MAX(cluster, r) AS cluster FROM pr JOIN mat ON pr.v = mat.id "
                         "WHERE u NOT IN (SELECT id FROM mat) GROUP BY u"))
    ctes.append(("cl", f"SELECT {v}.id, COALESCE(mat.cluster, late.cluster, {v}.id) AS cluster FROM {v} "
                       f"LEFT JOIN mat ON mat.id = {v}.id LEFT JOIN late ON late.id = {v}.id"))
    return ctes


def move_ctes(v: str, e: str, rounds: int, seed: int = 0) -> tuple[list[tuple[str, str]], str]:
    """Rounds of moves by modularity gain: (id, c, k) and the modularity of the last one that counted."""
    q = lambda m: (f"(SELECT COALESCE(SUM(w), 0) FROM sw JOIN {m} a ON a.id = u JOIN {m} b ON b.id = v WHERE a.c = b.c) / (SELECT t FROM tm) - "  # noqa: E731
                   f"(SELECT SUM(kk * kk) FROM (SELECT SUM(k) AS kk FROM {m} GROUP BY c) s) / ((SELECT t FROM tm) * (SELECT t FROM tm))")
    ctes = [("sw", f"SELECT u, v, SUM(w) AS w FROM (SELECT src AS u, dst AS v, COALESCE(weight, 1) AS w FROM {e} UNION ALL "
                   f"SELECT dst, src, COALESCE(weight, 1) FROM {e}) x WHERE u <> v AND w > 0 GROUP BY u, v"),
            ("tm", "SELECT SUM(w) AS t FROM sw"),
            ("mb0", f"SELECT id, id AS c, COALESCE(k, 0.0) AS k FROM {v} LEFT JOIN (SELECT u, SUM(w) AS k FROM sw GROUP BY u) s ON u = id"),
            ("q0", f"SELECT {q('mb0')} AS q")]
    for t in range(1, rounds + 1):
        p = f"mb{t - 1}"
        turn = f"{unit_hash(str(seed), str((t - 1) // 2), 'CAST(m.id AS VARCHAR)')} < 0.5"
        may = turn if t % 2 else f"NOT ({turn})"
        ctes += [(f"to{t}", f"SELECT u, d, SUM(w) AS w FROM (SELECT u, c AS d, w FROM sw JOIN {p} ON id = v UNION ALL SELECT id, c, 0.0 FROM {p}) x GROUP BY u, d"),
                 (f"gn{t}", f"SELECT u, d, w - k * (kk - CASE WHEN d = c THEN k ELSE 0.0 END) / (SELECT t FROM tm) AS gain, d = c AS home "
                            f"FROM to{t} JOIN {p} ON id = u JOIN (SELECT c AS cc, SUM(k) AS kk FROM {p} GROUP BY c) s ON cc = d"),
                 (f"bs{t}", f"SELECT u, d FROM gn{t} QUALIFY ROW_NUMBER() OVER (PARTITION BY u ORDER BY gain DESC, home DESC, "
                            f"{unit_hash(str(seed), repr('tie'), 'CAST(d AS VARCHAR)')} DESC, d DESC) = 1"),
                 (f"nw{t}", f"SELECT m.id, CASE WHEN {may} THEN b.d ELSE m.c END AS c, m.k FROM {p} m JOIN bs{t} b ON b.u = m.id"),
                 (f"qn{t}", f"SELECT {q(f'nw{t}')} AS q"),
                 (f"mb{t}", f"SELECT n.id, CASE WHEN (SELECT q FROM qn{t}) > (SELECT q FROM q{t - 1}) THEN n.c ELSE m.c END AS c, m.k "
                            f"FROM nw{t} n JOIN {p} m ON m.id = n.id"),
                 (f"q{t}", f"SELECT GREATEST((SELECT q FROM qn{t}), (SELECT q FROM q{t - 1})) AS q")]
    return ctes, f"mb{rounds}"


def cc_ctes(v: str, e: str) -> tuple[list[tuple[str, str]], str]:
    """Clustering coefficient by brute force over neighbour pairs (oracle only)."""
    ctes = [
        ("cc_pairs", UNDIRECTED.format(e=e)),
        ("cc_deg", "SELECT src AS id, COUNT(*) AS deg FROM cc_pairs GROUP BY src"),
        ("cc_tri", "SELECT a.src AS id, COUNT(*) / 2 AS tri FROM cc_pairs a JOIN cc_pairs b ON a.src = b.src "
                   "AND a.dst <> b.dst JOIN cc_pairs c ON c.src = a.dst AND c.dst = b.dst GROUP BY a.src"),
        ("cc", f"SELECT v.id, CAST(COALESCE(g.deg, 0) AS BIGINT) AS degree, CAST(COALESCE(t.tri, 0) AS BIGINT) AS triangles, "
               f"CASE WHEN COALESCE(g.deg, 0) >= 2 THEN 2.0 * COALESCE(t.tri, 0) / (g.deg * (g.deg - 1)) "
               f"ELSE {d(0)} END AS clustering FROM {v} v LEFT JOIN cc_deg g ON v.id = g.id "
               f"LEFT JOIN cc_tri t ON v.id = t.id"),
    ]
    return ctes, "cc"


def degree_sql(v: str, e: str) -> str:
    return (f"SELECT v.id, CAST(COALESCE(SUM(u.i), 0) AS BIGINT) AS in_degree, CAST(COALESCE(SUM(u.o), 0) AS BIGINT) "
            f"AS out_degree, CAST(COALESCE(SUM(u.i), 0) + COALESCE(SUM(u.o), 0) AS BIGINT) AS degree FROM {v} v "
            f"LEFT JOIN (SELECT src AS id, 0 AS i, 1 AS o FROM {e} UNION ALL SELECT dst, 1, 0 FROM {e}) u "
            f"ON v.id = u.id GROUP BY v.id")


# ----------------------------------------------------------------------------- the queries

def _trade_total_ctes():
    p = Q.TRADE.but(gravity=Q.GRAVITY)
    k = k_expr("v0", p)
    pr = parts("v0", "e", k, p)
    tot = (f"SELECT id, label, x, y, rep_dx + attr_dx + grav_dx AS dx, rep_dy + attr_dy + grav_dy AS dy "
           f"FROM ({pr}) pp")
    return p, [("v0", v_trade()), ("e", E_TRADE), ("tot", tot)]


def _layers_ctes():
    ps = Q.TRADE.but(iterations=Q.LAYER_ITERATIONS)
    pf = Q.TRADE.but(iterations=Q.LAYER_ITERATIONS, weighted=True)
    cs, ls, ks = layout_ctes("v0", "e", ps, "s_")
    cf, lf, _ = layout_ctes("v0", "fe", pf, "g_")
    base = [("v0", v_trade()), ("e", E_TRADE), ("fe", E_TRADE_FUNC)]
    return base + cs + cf, ls, lf, ks


def _pairs_sql(e1: str, e2: str) -> str:
    return (f"SELECT DISTINCT LEAST(src, dst) AS a, GREATEST(src, dst) AS b FROM "
            f"(SELECT src, dst FROM {e1} UNION ALL SELECT src, dst FROM {e2}) u WHERE src <> dst")


def _ratio_sql(la: str, lb: str, pairs: str) -> str:
    return (f"SELECT p.a, p.b, sqrt((a2.x - a1.x) * (a2.x - a1.x) + (a2.y - a1.y) * (a2.y - a1.y)) AS dist_a, "
            f"sqrt((b2.x - b1.x) * (b2.x - b1.x) + (b2.y - b1.y) * (b2.y - b1.y)) AS dist_b "
            f"FROM ({pairs}) p JOIN {la} a1 ON p.a = a1.id JOIN {la} a2 ON p.b = a2.id "
            f"JOIN {lb} b1 ON p.a = b1.id JOIN {lb} b2 ON p.b = b2.id")


def _link_dist_sql(layout: str, e: str) -> str:
    return (f"SELECT e.src, e.dst, e.weight, sqrt((t.x - s.x) * (t.x - s.x) + (t.y - s.y) * (t.y - s.y)) AS distance "
            f"FROM {e} e JOIN {layout} s ON e.src = s.id JOIN {layout} t ON e.dst = t.id")


def _node_table_ctes():
    lp, lpn = lp_ctes("v0", "e", Q.LP_ROUNDS)
    cc, ccn = cc_ctes("v0", "e")
    node = (f"SELECT v.label AS Id, v.x AS X, v.y AS Y, v.dx AS dX, v.dy AS dY, dg.degree AS k, m.module AS m, "
            f"c.clustering AS c FROM v0 v JOIN ({degree_sql('v0', 'e')}) dg ON v.id = dg.id "
            f"JOIN {lpn} m ON v.id = m.id JOIN {ccn} c ON v.id = c.id")
    return [("v0", v_trade()), ("e", E_TRADE)] + lp + cc + [("node", node)]


def build_oracle() -> dict[str, str]:
    T = Q.TRADE
    o: dict[str, str] = {}
    o["edge_list_parse"] = with_(("lines", lines(False)), body=PARSE)
    o["edge_list_comments"] = with_(("lines", f"SELECT * FROM ({lines(True)}) x WHERE NOT starts_with(value, '#')"),
                                    body=PARSE)
    o["edge_sample"] = with_(("lines", f"SELECT * FROM ({lines(True)}) x WHERE NOT starts_with(value, '#') AND "
                                       f"{unit_hash(str(Q.SAMPLE_SEED), 'value')} < {d(Q.SAMPLE_FRACTION)}"), body=PARSE)
    o["functional_layer"] = f"SELECT src, dst, {r4('weight', 'weight')} FROM ({E_TRADE_FUNC}) t"

    o["vertices_from_edges"] = (f"SELECT DISTINCT id, 'defaultProperty' AS label FROM (SELECT src AS id FROM ({E_SUPPLY}) a "
                                f"UNION ALL SELECT dst FROM ({E_SUPPLY}) b) u")
    o["graph_complete"] = with_(
        ("v", v_geo(False)), ("e", E_GEO),
        ("ids", "SELECT src AS id FROM e UNION SELECT dst FROM e"),
        body=(f"SELECT COALESCE(v.id, i.id) AS id, COALESCE(v.label, 'NONODE') AS label, "
              f"{r4('COALESCE(v.x, 0.0)', 'x')}, {r4('COALESCE(v.y, 0.0)', 'y')}, {r4('COALESCE(v.dx, 0.0)', 'dx')}, "
              f"{r4('COALESCE(v.dy, 0.0)', 'dy')} FROM v FULL OUTER JOIN ids i ON v.id = i.id"))
    raw = ("raw", "SELECT CAST(split_part(value, chr(9), 1) AS BIGINT) AS src, CAST(split_part(value, chr(9), 2) AS BIGINT) "
                  "AS dst, CAST(split_part(value, chr(9), 3) AS DOUBLE) AS weight FROM lines")
    ids = ("ids", "SELECT src AS id FROM raw UNION SELECT dst FROM raw")
    converted = (f"SELECT id, CAST(id AS VARCHAR) AS label, {pos('id', T.width, T.height)}, {d(0)} AS dx, {d(0)} AS dy FROM ids")
    o["graph_convert"] = with_(
        ("lines", lines(False)), raw, ids, ("v", converted),
        ("w", "SELECT src, SUM(weight) AS weight_out FROM raw GROUP BY src"),
        body=(f"SELECT id, label, {r4('x', 'x')}, {r4('y', 'y')}, {r4('dx', 'dx')}, {r4('dy', 'dy')}, "
              f"{r4('COALESCE(weight_out, 0.0)', 'weight_out')} FROM v LEFT JOIN w ON v.id = w.src"))
    o["positions_shuffle"] = (f"SELECT id, label, {r4('x', 'x')}, {r4('y', 'y')} FROM ({v_supply(seed=Q.SHUFFLE_SEED)}) v")
    o["edges_symmetric"] = (f"SELECT DISTINCT src, dst, {d(1)} AS weight FROM (SELECT src, dst FROM ({E_TRADE}) a "
                            f"UNION ALL SELECT dst, src FROM ({E_TRADE}) b) u")
    o["graph_size"] = (f"SELECT (SELECT COUNT(*) FROM ({v_supply()}) v) AS n_vertices, "
                       f"(SELECT COUNT(*) FROM ({E_SUPPLY}) e) AS n_edges")
    o["triplets"] = with_(("v", v_trade()), ("e", E_TRADE), body=(
        f"SELECT e.src, e.dst, s.label AS src_label, t.label AS dst_label, {r4('e.weight', 'weight')}, "
        f"{r4('s.x', 'src_x')}, {r4('s.y', 'src_y')}, {r4('t.x', 'dst_x')}, {r4('t.y', 'dst_y')} "
        f"FROM e JOIN v s ON e.src = s.id JOIN v t ON e.dst = t.id"))
    ks = k_expr("v", T)
    o["attach_displacement"] = with_(
        ("v", v_supply()), ("e", E_SUPPLY), ("m", attr_links("v", "e", ks, T, False)),
        ("pulls", "SELECT dst AS id, SUM(mx) AS dx, SUM(my) AS dy FROM m GROUP BY dst"),
        body=(f"SELECT v.id, v.label, {r4('v.x', 'x')}, {r4('v.y', 'y')}, {r4('COALESCE(p.dx, 0.0)', 'dx')}, "
              f"{r4('COALESCE(p.dy, 0.0)', 'dy')} FROM v LEFT JOIN pulls p ON v.id = p.id"))
    pg = T.but(gravity=Q.GRAVITY)
    gx, gy = grav("x", "y", pg)
    o["superpose_union"] = with_(
        ("v", v_trade()), ("e", E_TRADE),
        ("u", f"SELECT id, dx, dy FROM ({attr_target('v', 'e', k_expr('v', pg), pg, False)}) a "
              f"UNION ALL SELECT id, {gx}, {gy} FROM v"),
        body=f"SELECT id, {r4('SUM(dx)', 'dx')}, {r4('SUM(dy)', 'dy')} FROM u GROUP BY id")

    o["ideal_length"] = (f"SELECT COUNT(*) AS n, {r4(f'{d(T.kf)} * sqrt({d(T.area)} / COUNT(*))', 'k')} "
                         f"FROM ({v_supply()}) v")
    rad = Q.RADIUS
    rx, ry = rep_term("a.x - b.x", "a.y - b.y", ks, T)
    o["repulsion_all_pairs"] = with_(("v", v_supply()), body=(
        f"SELECT id, {r4('dx', 'dx')}, {r4('dy', 'dy')} FROM ({rep_all('v', ks, T)}) r"))
    crowd = lambda c: (f"CASE WHEN id % 2 = 1 THEN floor({c} * {d(Q.SPOT)} / {d(T.eps)} + 0.5) * {d(T.eps)} ELSE {c} END AS {c}")
    o["repulsion_dense_spot"] = with_(("v0", v_supply()), ("v", f"SELECT id, {crowd('x')}, {crowd('y')} FROM v0"), body=(
        f"SELECT id, {r4('dx / 1000.0', 'kdx')}, {r4('dy / 1000.0', 'kdy')} FROM ({rep_all('v', ks, T)}) r"))
    nx_, ny_ = rep_term("s.x - t.x", "s.y - t.y", ks, T)
    o["repulsion_neighbors"] = with_(
        ("v", v_supply()), ("e", E_SUPPLY), ("pr", UNDIRECTED.format(e="e")),
        ("f", f"SELECT pr.src AS id, SUM({nx_}) AS fx, SUM({ny_}) AS fy FROM pr JOIN v s ON pr.src = s.id "
              f"JOIN v t ON pr.dst = t.id GROUP BY pr.src"),
        body=f"SELECT v.id, {r4('COALESCE(f.fx, 0.0)', 'dx')}, {r4('COALESCE(f.fy, 0.0)', 'dy')} FROM v LEFT JOIN f ON v.id = f.id")
    o["repulsion_radius"] = with_(
        ("v", v_supply()),
        ("f", f"SELECT a.id, SUM({rx}) AS fx, SUM({ry}) AS fy FROM v a JOIN v b ON a.id <> b.id AND "
              f"(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {d(rad * rad)} GROUP BY a.id"),
        body=f"SELECT v.id, {r4('COALESCE(f.fx, 0.0)', 'dx')}, {r4('COALESCE(f.fy, 0.0)', 'dy')} FROM v LEFT JOIN f ON v.id = f.id")
    o["attraction_links"] = with_(("v", v_supply()), ("e", E_SUPPLY), body=(
        f"SELECT src, dst, {r4('mx', 'mx')}, {r4('my', 'my')} FROM ({attr_links('v', 'e', ks, T, False)}) m"))
    o["attraction_dealt"] = o["attraction_links"]
    o["link_blocks"] = with_(*block_ctes(), body=(
        "SELECT l.block, l.n_links, v.n_vertices FROM (SELECT block, COUNT(*) AS n_links FROM dealt GROUP BY block) l JOIN "
        "(SELECT block, COUNT(*) AS n_vertices FROM routes GROUP BY block) v ON l.block = v.block"))
    o["link_routes"] = with_(*block_ctes(), body="SELECT id, COUNT(*) AS n_blocks FROM routes GROUP BY id")
    o["attraction_both_ends"] = with_(("v", v_supply()), ("e", E_SUPPLY), body=(
        f"SELECT id, {r4('dx', 'dx')}, {r4('dy', 'dy')} FROM ({attr_both('v', 'e', ks, T, False)}) m"))
    o["attraction_target_only"] = with_(("v", v_supply()), ("e", E_SUPPLY), body=(
        f"SELECT id, {r4('dx', 'dx')}, {r4('dy', 'dy')} FROM ({attr_target('v', 'e', ks, T, False)}) m"))
    o["gravity"] = f"SELECT id, {r4(gx, 'dx')}, {r4(gy, 'dy')} FROM ({v_supply()}) v"
    p, base = _trade_total_ctes()
    o["force_total"] = with_(*base, body=f"SELECT id, {r4('dx', 'dx')}, {r4('dy', 'dy')} FROM tot")

    o["displacement_length"] = with_(*base, body=(
        f"SELECT id, {r4('dx', 'dx')}, {r4('dy', 'dy')}, {r4('sqrt(dx * dx + dy * dy)', 'length')} FROM tot"))
    fac = factor(p, 1, p.temperature(0))
    o["step_temperature_cap"] = with_(*base, body=(
        f"SELECT id, {r4(f'dx * ({fac})', 'sx')}, {r4(f'dy * ({fac})', 'sy')} FROM tot"))
    pi_ = p.but(step="inverse_iteration")
    fac3 = factor(pi_, 3, pi_.temperature(2))
    o["step_inverse_iteration"] = with_(*base, body=(
        f"SELECT id, {r4(f'dx * ({fac3})', 'sx')}, {r4(f'dy * ({fac3})', 'sy')} FROM tot"))
    for name, bnd in (("update_clamp_corner", "corner"), ("update_clamp_center", "center")):
        pb = p.but(bounds=bnd)
        st = f"SELECT id, label, x, y, dx * ({fac}) AS sx, dy * ({fac}) AS sy FROM tot"
        nx, ny = moved("x + sx", "y + sy", pb)
        o[name] = with_(*base, ("st", st), body=(
            f"SELECT id, label, {r4(nx, 'x')}, {r4(ny, 'y')}, {r4('-sx', 'dx')}, {r4('-sy', 'dy')} FROM st"))

    o["layout_fr_1"] = layout_sql(v_trade(), E_TRADE, T.but(iterations=1))
    o["layout_fr_3"] = layout_sql(v_trade(), E_TRADE, T.but(iterations=3))
    o["layout_fr_unit"] = layout_sql(v_trade(Q.UNIT.width, Q.UNIT.height, bounds=Q.UNIT.bounds), E_TRADE, Q.UNIT)
    o["layout_early_stop"] = layout_sql(v_trade(), E_TRADE, T.but(max_iterations=2))
    o["layout_radius"] = layout_sql(v_supply(), E_SUPPLY, T.but(iterations=2, repulsion="radius", radius=Q.RADIUS))
    o["layout_shuffled"] = layout_sql(v_trade(seed=Q.SHUFFLE_SEED), E_TRADE, T.but(iterations=2, seed=Q.SHUFFLE_SEED))
    for name, p_ in Q.VARIANTS.items():
        o[name] = layout_sql(v_supply(), E_SUPPLY, p_)
    ctes, last, _ = layout_ctes("v0", "e", Q.JOB)
    o["edge_list_layout"] = with_(
        ("lines", f"SELECT * FROM ({lines(True)}) x WHERE NOT starts_with(value, '#')"), raw, ids, ("v0", converted),
        ("e", "SELECT src, dst, weight FROM raw"), *ctes, body=(
            f"SELECT label AS Id, {r4('x', 'X')}, {r4('y', 'Y')}, {r4('dx', 'dX')}, {r4('dy', 'dY')} FROM {last}"))
    pt = T.but(iterations=2)
    ctes, _, _ = layout_ctes("v0", "e", pt)
    tr = []
    for t in range(1, pt.rounds + 1):
        tr.append(f"SELECT {t} AS iteration, 'A' AS phase, id, x, y, rep_dx AS dx, rep_dy AS dy FROM f{t}")
        tr.append(f"SELECT {t}, 'B', id, x, y, rep_dx + attr_dx, rep_dy + attr_dy FROM f{t}")
        tr.append(f"SELECT {t}, 'C', id, nx, ny, -sx, -sy FROM f{t}")
    o["layout_trace"] = with_(("v0", v_trade()), ("e", E_TRADE), *ctes, ("tr", " UNION ALL ".join(tr)), body=(
        f"SELECT iteration, phase, id, {r4('x', 'x')}, {r4('y', 'y')}, {r4('dx', 'dx')}, {r4('dy', 'dy')} FROM tr"))
    pr3 = T.but(iterations=3)
    ctes, _, k3 = layout_ctes("v0", "e", pr3)
    rp = [f"SELECT {t} AS iteration, {d(pr3.temperature(t - 1))} AS temperature, {k3} AS k, COUNT(*) AS n, "
          f"(SELECT COUNT(*) FROM e) AS n_edges, "
          f"SUM(sqrt(sx * sx + sy * sy)) AS total_step, MAX(sqrt(sx * sx + sy * sy)) AS max_step FROM f{t}"
          for t in range(1, pr3.rounds + 1)]
    base3 = [("v0", v_trade()), ("e", E_TRADE), *ctes, ("rp", " UNION ALL ".join(rp))]
    o["layout_report"] = with_(*base3, body=(
        f"SELECT iteration, n, n_edges, {r4('temperature', 'temperature')}, {r4('k', 'k')}, "
        f"{r4('total_step', 'total_step')}, {r4('max_step', 'max_step')} FROM rp"))
    planned = (f"SELECT CAST(i AS BIGINT) AS iteration, (1.0 - i / {d(pr3.iterations)}) * {d(pr3.temperature(0))} AS planned "
               f"FROM range(0, {pr3.iterations + 1}) r(i)")
    o["cooling_schedule"] = with_(*base3, ("plan", planned), body=(
        f"SELECT plan.iteration, {r4('planned', 'temperature')}, {r4('COALESCE(rp.max_step, 0.0)', 'max_step')} "
        f"FROM plan LEFT JOIN rp ON plan.iteration + 1 = rp.iteration"))

    o["degree"] = with_(("v", v_supply()), ("e", E_SUPPLY), body=degree_sql("v", "e"))
    lp, lpn = lp_ctes("v", "e", Q.LP_ROUNDS)
    o["module_label_propagation"] = with_(("v", v_supply()), ("e", E_SUPPLY), *lp, body=f"SELECT id, module FROM {lpn}")
    recursive = lambda *a, body: with_(*a, body=body).replace("WITH ", "WITH RECURSIVE ", 1)
    o["shortest_hops"] = recursive(
        ("v", v_supply()), ("e", E_SUPPLY), ("p", UNDIRECTED.format(e="e")),
        ("b", f"SELECT CAST({Q.HOPS_FROM} AS BIGINT) AS id, CAST(0 AS BIGINT) AS hops UNION SELECT p.dst, hops + 1 FROM b JOIN p "
              f"ON p.src = b.id WHERE hops < 12"),
        body="SELECT v.id, MIN(hops) AS hops FROM v LEFT JOIN b ON b.id = v.id GROUP BY v.id")
    o["components"] = recursive(
        ("v", v_geo()), ("e", E_GEO), ("p", UNDIRECTED.format(e="e")),
        ("b", "SELECT id, id AS c FROM v UNION SELECT p.dst, c FROM b JOIN p ON p.src = b.id"),
        body="SELECT id, MIN(c) AS component FROM b GROUP BY id")
    mv, mvn = move_ctes("v", "e", Q.MOVE_ROUNDS)
    o["module_moves"] = with_(("v", v_supply()), ("e", E_SUPPLY), *mv, body=(
        f"SELECT id, c AS module, {r4(f'(SELECT q FROM q{Q.MOVE_ROUNDS})', 'modularity')} FROM {mvn}"))
    sup = (("v", v_supply()), ("e", E_SUPPLY), *match_ctes("v", "e", MATCH_ROUNDS))
    o["coarsen_clusters"] = with_(*sup, body="SELECT id, cluster FROM cl")
    o["coarsen_links"] = with_(*sup, body=(
        f"SELECT LEAST(a.cluster, b.cluster) AS src, GREATEST(a.cluster, b.cluster) AS dst, {r4('SUM(weight)', 'weight')} FROM e "
        f"JOIN cl a ON a.id = src JOIN cl b ON b.id = dst WHERE a.cluster <> b.cluster GROUP BY 1, 2"))
    shift = lambda a: (f"({unit_hash('0', repr('prolong ' + a), 'CAST(v.id AS VARCHAR)')} - {d(0.5)}) * {ks}")
    at = lambda a: f"GREATEST({d(-5000)}, LEAST({d(5000)}, {on_grid(f'c.{a} + {shift(a)}', T.eps)}))"
    o["prolongation"] = with_(*sup, ("c", f"SELECT id, {pos('id', 10000.0, 10000.0)} FROM (SELECT DISTINCT cluster AS id FROM cl) q"), body=(
        f"SELECT v.id, v.label, {r4(at('x'), 'x')}, {r4(at('y'), 'y')} FROM v JOIN cl ON cl.id = v.id JOIN c ON c.id = cl.cluster"))
    cc, ccn = cc_ctes("v", "e")
    o["clustering_coefficient"] = with_(("v", v_trade()), ("e", E_TRADE), *cc, body=(
        f"SELECT id, degree, triangles, {r4('clustering', 'clustering')} FROM {ccn}"))

    # every triangle has one customer, one part and one supplier
    o["clustering_market"] = with_(
        ("v", V_MARKET), ("pr", UNDIRECTED.format(e=f"({E_MARKET})")), ("dg", "SELECT src AS id, COUNT(*) AS deg FROM pr GROUP BY src"),
        ("t", "SELECT a.src AS c, a.dst AS p, b.dst AS s FROM pr a JOIN pr b ON b.src = a.dst AND b.dst % 3 = 2 "
              "JOIN pr x ON x.src = a.src AND x.dst = b.dst WHERE a.src % 3 = 0 AND a.dst % 3 = 1"),
        ("n", "SELECT id, COUNT(*) AS t FROM (SELECT c AS id FROM t UNION ALL SELECT p FROM t UNION ALL SELECT s FROM t) q GROUP BY id"),
        body=(f"SELECT v.id, CAST(COALESCE(deg, 0) AS BIGINT) AS degree, CAST(COALESCE(t, 0) AS BIGINT) AS triangles, "
              f"{r4('CASE WHEN COALESCE(deg, 0) >= 2 THEN 2.0 * COALESCE(t, 0) / (deg * (deg - 1)) ELSE 0.0 END', 'clustering')} "
              f"FROM v LEFT JOIN dg ON dg.id = v.id LEFT JOIN n ON n.id = v.id"))
    place = lambda c: f"(RANK() OVER (ORDER BY {c}) + (COUNT(*) OVER (PARTITION BY {c}) - 1) / {d(2)})"
    rk = (("v", v_supply()), ("e", E_SUPPLY), ("ld", _link_dist_sql("v", "e")),
          ("rk", f"SELECT src, dst, {place('weight')} AS wr, {place('distance')} AS dr FROM ld"))
    o["link_ranks"] = with_(*rk, body=f"SELECT src, dst, {r4('wr', 'weight_rank')}, {r4('dr', 'distance_rank')} FROM rk")
    o["distance_strength_ranks"] = with_(*rk, body=f"SELECT COUNT(*) AS n_links, {r4('CORR(wr, dr)', 'rank_corr')} FROM rk")
    ca, la, _ = layout_ctes("v", "e", Q.SUPPLY_LAYER, "a_")
    cb, lb, _ = layout_ctes("v", "e", Q.SUPPLY_LAYER.but(weighted=True), "b_")
    fit = (("v", v_supply()), ("e", E_SUPPLY), *ca, *cb,
           ("j", f"SELECT a.id, a.x AS xa, a.y AS ya, b.x AS xb, b.y AS yb FROM {la} a JOIN {lb} b ON a.id = b.id"),
           ("m", "SELECT COUNT(*) AS n, AVG(xa) AS ax, AVG(ya) AS ay, AVG(xb) AS bx, AVG(yb) AS by_, COVAR_POP(xb, xa) AS xx, "
                 "COVAR_POP(xb, ya) AS xy, COVAR_POP(yb, xa) AS yx, COVAR_POP(yb, ya) AS yy FROM j"),
           ("s", "SELECT *, sqrt((xx - yy) ** 2 + (xy + yx) ** 2) > sqrt((xx + yy) ** 2 + (xy - yx) ** 2) * (1 + 1e-9) AS flipped FROM m"),
           ("h", "SELECT *, CASE WHEN flipped THEN atan2(xy + yx, xx - yy) ELSE atan2(xy - yx, xx + yy) END AS th, "
                 "CASE WHEN flipped THEN -1.0 ELSE 1.0 END AS f FROM s"),
           ("t", "SELECT j.id, xa, ya, xb, yb, n, flipped, th, ax + cos(th) * (xb - bx) - sin(th) * f * (yb - by_) AS xt, "
                 "ay + sin(th) * (xb - bx) + cos(th) * f * (yb - by_) AS yt FROM j, h"))
    rms = lambda x, y: f"sqrt(AVG(({x} - xa) * ({x} - xa) + ({y} - ya) * ({y} - ya)))"
    o["layer_rigid_fit"] = with_(*fit, body=(
        f"SELECT n, flipped, {r4('degrees(th)', 'angle')}, {r4(rms('xb', 'yb'), 'rms_before')}, "
        f"{r4(rms('xt', 'yt'), 'rms_after')} FROM t GROUP BY n, flipped, th"))
    o["layer_turned_displacement"] = with_(*fit, body=(
        f"SELECT id, {r4('xt - xa', 'ddx')}, {r4('yt - ya', 'ddy')}, "
        f"{r4('sqrt((xt - xa) * (xt - xa) + (yt - ya) * (yt - ya))', 'distance')} FROM t"))

    lc, ls, lf, kst = _layers_ctes()
    o["layer_displacement"] = with_(*lc, body=(
        f"SELECT a.id, {r4('b.x - a.x', 'ddx')}, {r4('b.y - a.y', 'ddy')}, "
        f"{r4('sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y))', 'distance')}, "
        f"{r4('degrees(atan2(b.y - a.y, b.x - a.x))', 'angle')} FROM {ls} a JOIN {lf} b ON a.id = b.id"))
    ratio = _ratio_sql(ls, lf, _pairs_sql("e", "fe"))
    o["layer_distance_ratio"] = with_(*lc, ("rt", ratio), body=(
        f"SELECT a, b, CASE WHEN dist_b > dist_a THEN 'longer' WHEN dist_b < dist_a THEN 'shorter' ELSE 'same' END "
        f"AS relation, {r4('dist_a', 'dist_a')}, {r4('dist_b', 'dist_b')}, "
        f"{r4('CASE WHEN dist_a > 0 THEN dist_b / dist_a END', 'ratio')} FROM rt"))
    ld = _link_dist_sql(ls, "fe")
    o["distance_vs_strength"] = with_(*lc, ("ld", ld), body=(
        f"SELECT CAST(GREATEST(0, LEAST(FLOOR(weight * 10), 9)) AS INTEGER) AS strength_bin, COUNT(*) AS n_links, "
        f"{r4('AVG(distance)', 'avg_distance')}, {r4('MIN(distance)', 'min_distance')}, "
        f"{r4('MAX(distance)', 'max_distance')} FROM ld GROUP BY 1"))
    o["distance_strength_corr"] = with_(*lc, ("ld", ld), body=(
        f"SELECT COUNT(*) AS n_links, {r4('CORR(weight, distance)', 'corr')} FROM ld"))
    o["functional_force"] = with_(*lc, body=(
        f"SELECT id, {r4('dx', 'dx')}, {r4('dy', 'dy')} FROM ({attr_both(ls, 'fe', kst, T, True)}) m"))
    o["layer_alignment"] = with_(*lc, ("rt", ratio), body=(
        f"SELECT (SELECT COUNT(*) FROM {ls} a JOIN {lf} b ON a.id = b.id) AS n_vertices, "
        f"{r4(f'(SELECT AVG(sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y))) FROM {ls} a JOIN {lf} b ON a.id = b.id)', 'mean_displacement')}, "
        f"(SELECT COUNT(*) FROM rt WHERE dist_a > 0 AND dist_b / dist_a > 0) AS n_pairs, "
        f"{r4('(SELECT AVG(ABS(LN(dist_b / dist_a))) FROM rt WHERE dist_a > 0 AND dist_b / dist_a > 0)', 'mean_abs_log_ratio')}"))

    o["export_edges"] = with_(("v", v_trade()), ("e", E_TRADE), body=(
        f"SELECT s.label AS Source, t.label AS Target, {r4('e.weight', 'Weight')} FROM e JOIN v s ON e.src = s.id "
        f"JOIN v t ON e.dst = t.id"))
    nt = _node_table_ctes()
    node_cols = (f"k, m, {r4('X', 'X')}, {r4('Y', 'Y')}, {r4('dX', 'dX')}, {r4('dY', 'dY')}, {r4('c', 'c')}")
    o["export_nodes"] = with_(*nt, body=f"SELECT Id, {node_cols} FROM node")
    o["export_nodes_prefixed"] = with_(*nt, body=f"SELECT Id AS \"#Id\", {node_cols} FROM node")
    o["export_displacements"] = with_(("v", v_trade()), body=(
        f"SELECT id AS ID, 'rep' AS label, 1 AS iteration, {r4('dx', 'dX')}, {r4('dy', 'dY')} "
        f"FROM ({rep_all('v', k_expr('v', T), T)}) r"))
    ctes, last, _ = layout_ctes("v0", "e", Q.UNIT)
    o["export_layout_nodes"] = with_(("v0", v_trade(Q.UNIT.width, Q.UNIT.height, bounds=Q.UNIT.bounds)), ("e", E_TRADE), *ctes, body=(
        f"SELECT label, {r4('x', 'posX')}, {r4('y', 'posY')} FROM {last}"))
    o["export_layout_links"] = f"SELECT src AS SOURCE, dst AS TARGET, {d(1)} AS WEIGHT FROM ({E_TRADE}) e"
    o["inspect_links"] = with_(("v", v_trade()), ("e", E_TRADE), body=(
        "SELECT s.label || ' linkTo( ' || t.label || ' )' AS line FROM e JOIN v s ON e.src = s.id JOIN v t ON e.dst = t.id"))
    return o


ORACLE = build_oracle()

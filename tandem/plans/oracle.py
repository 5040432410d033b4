"""DuckDB SQL stating each registered query by brute force (views ``events``,
``lineitem``, ``orders``, ``embeddings`` ... are registered by the caller).
"""

from __future__ import annotations

from . import catalog as C

D = C.DELTA
H = C.HOUR
DAYUS = C.DAY

BASE = f"""
ev AS (SELECT event_id AS id, value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y,
              epoch_us(ts) AS t, event_type, user_id, ts FROM events),
pl AS (SELECT * FROM ev WHERE event_type = 'purchase'),
pr AS (SELECT * FROM ev WHERE event_type = 'view'),
box_right AS (SELECT min(id) AS id, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy,
                     min(t) AS start_us, max(t) AS end_us, user_id
              FROM pr GROUP BY user_id, floor(t / {float(DAYUS)})),
box_left AS (SELECT min(id) AS id, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy,
                    min(t) AS start_us, max(t) AS end_us, user_id
             FROM pl GROUP BY user_id, floor(t / {float(4 * DAYUS)})),
sessions AS (SELECT min(id) AS id, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy,
                    min(t) AS start_us, max(t) AS end_us, user_id
             FROM ev GROUP BY user_id, floor(t / {float(DAYUS)})),
long_intervals AS (SELECT l_orderkey AS id, min(epoch_us(l_shipdate)) AS start_us,
                          max(epoch_us(l_shipdate)) AS end_us FROM lineitem GROUP BY l_orderkey),
g AS (SELECT min(x) AS x0, min(y) AS y0,
             CASE WHEN greatest(max(x) - min(x), max(y) - min(y)) > 0
                  THEN greatest(max(x) - min(x), max(y) - min(y)) ELSE 1.0 END AS side FROM ev)
"""


def cell(v: str, origin: str, side: str, level: str) -> str:
    n = f"pow(2.0, {level})"
    return f"CAST(least(greatest(floor(({v} - {origin}) / {side} * {n}), 0), CAST({n} - 1 AS BIGINT)) AS INTEGER)"


def with_base(body: str) -> str:
    """Prefix the shared CTEs; ``body`` is either more CTEs + SELECT or a SELECT."""
    body = body.strip()
    sep = "\n" if body.upper().startswith("SELECT") else ",\n"
    return "WITH RECURSIVE " + BASE.strip() + sep + body


def knn_pairs(left: str, right: str, cond: str, dist: str, k: int) -> str:
    return f"""p AS (SELECT l.id AS l_id, r.id AS r_id, {dist} AS dist FROM {left} l JOIN {right} r ON {cond}),
top AS (SELECT l_id, r_id, dist, CAST(rank AS INTEGER) AS rank FROM
          (SELECT *, row_number() OVER (PARTITION BY l_id ORDER BY dist, r_id) AS rank FROM p)
        WHERE rank <= {k})"""


PT_DIST = "sqrt((l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y))"
PT_TIME = f"r.t <= l.t + {D} AND r.t >= l.t - {D}"
BOX_DIST = ("sqrt(greatest(0.0, r.minx - l.maxx, l.minx - r.maxx) * greatest(0.0, r.minx - l.maxx, l.minx - r.maxx)"
            " + greatest(0.0, r.miny - l.maxy, l.miny - r.maxy) * greatest(0.0, r.miny - l.maxy, l.miny - r.maxy))")
PT_TOP = knn_pairs("pl", "pr", PT_TIME, PT_DIST, C.K)

KIND = ("CASE event_type WHEN 'purchase' THEN 'POINT' WHEN 'view' THEN 'LINESTRING' WHEN 'click' THEN 'POLYGON' "
        "WHEN 'signup' THEN 'MULTIPOINT' ELSE 'MULTIPOLYGON' END")
MAXX = "CASE event_type WHEN 'purchase' THEN x WHEN 'view' THEN x + 2 WHEN 'click' THEN x + 4 WHEN 'signup' THEN x + 1 ELSE x + 4 END"
MAXY = "CASE event_type WHEN 'purchase' THEN y WHEN 'view' THEN y + 3 WHEN 'click' THEN y + 4 WHEN 'signup' THEN y + 1 ELSE y + 1 END"


def _box_d(px, py, x0, y0, x1, y1):
    gx = f"greatest(0.0, {x0} - {px}, {px} - ({x1}))"
    gy = f"greatest(0.0, {y0} - {py}, {py} - ({y1}))"
    return f"sqrt({gx} * {gx} + {gy} * {gy})"


def _pt_d(px, py, ax, ay):
    return f"sqrt(({ax} - {px}) * ({ax} - {px}) + ({ay} - {py}) * ({ay} - {py}))"


def _boxes_d(ax, ay, a, bx, by, b):
    """Distance of the squares of side a at (ax, ay) and side b at (bx, by)."""
    gx = f"greatest(0.0, {bx} - ({ax} + {a}), {ax} - ({bx} + {b}))"
    gy = f"greatest(0.0, {by} - ({ay} + {a}), {ay} - ({by} + {b}))"
    return f"sqrt({gx} * {gx} + {gy} * {gy})"


def _pt_seg_d(px, py, ax, ay, bx, by):
    """Distance of a point to a segment."""
    l2 = f"(({bx} - {ax}) * ({bx} - {ax}) + ({by} - {ay}) * ({by} - {ay}))"
    u = f"least(1.0, greatest(0.0, CASE WHEN {l2} = 0 THEN 0.0 ELSE (({px} - {ax}) * ({bx} - {ax}) + ({py} - {ay}) * ({by} - {ay})) / {l2} END))"
    return f"sqrt(power({ax} + {u} * ({bx} - {ax}) - {px}, 2) + power({ay} + {u} * ({by} - {ay}) - {py}, 2))"


def gen_dist(px: str, py: str, x: str = "x", y: str = "y", kind: str = "event_type") -> str:
    """Distance of the geometry generated at (x, y) to the point (px, py)."""
    p = (px, py)
    return f"""CASE {kind}
  WHEN 'purchase' THEN {_pt_d(*p, x, y)}
  WHEN 'view' THEN least({_box_d(*p, x, y, f'{x} + 2', y)}, {_box_d(*p, f'{x} + 2', y, f'{x} + 2', f'{y} + 3')})
  WHEN 'click' THEN CASE
      WHEN {px} > {x} + 1 AND {px} < {x} + 2 AND {py} > {y} + 1 AND {py} < {y} + 2
        THEN least({px} - ({x} + 1), ({x} + 2) - {px}, {py} - ({y} + 1), ({y} + 2) - {py})
      ELSE {_box_d(*p, x, y, f'{x} + 4', f'{y} + 4')} END
  WHEN 'signup' THEN least({_pt_d(*p, x, y)}, {_pt_d(*p, f'{x} + 1', f'{y} + 1')})
  ELSE least({_box_d(*p, x, y, f'{x} + 1', f'{y} + 1')}, {_box_d(*p, f'{x} + 3', y, f'{x} + 4', f'{y} + 1')}) END"""


def collection_dist(px: str, py: str, x: str, y: str) -> str:
    """Distance of the collection generated at (x, y) to the point (px, py)."""
    p = (px, py)
    return (f"least({_pt_d(*p, x, y)}, {_box_d(*p, f'{x} + 1', y, f'{x} + 1', f'{y} + 3')}, "
            f"{_box_d(*p, f'{x} + 4', y, f'{x} + 6', f'{y} + 2')})")


# distance of the generated geometry to P = (y, x)
GEN_DIST = gen_dist("y", "x")

BOX_PAIRS = f"""bl AS (SELECT *, floor(start_us / {float(4 * DAYUS)}) AS p FROM box_left),
br AS (SELECT *, floor(start_us / {float(4 * DAYUS)}) AS p FROM box_right),
bp AS (SELECT bl.id AS l_id, br.id AS r_id, bl.minx AS lminx, bl.miny AS lminy, bl.maxx AS lmaxx, bl.maxy AS lmaxy,
              br.minx AS rminx, br.miny AS rminy, br.maxx AS rmaxx, br.maxy AS rmaxy,
              bl.start_us AS ls, bl.end_us AS le, br.start_us AS rs, br.end_us AS re
       FROM bl JOIN br ON bl.user_id = br.user_id AND bl.p = br.p)"""

INTERSECTS = "lminx <= rmaxx AND lmaxx >= rminx AND lminy <= rmaxy AND lmaxy >= rminy"

# interval bins over sessions
BINS = f"""spec AS (SELECT min(start_us) AS s0, max(end_us) AS e0,
                 greatest(1, CAST(ceil((max(end_us) - min(start_us) + 1) / {float(C.N_BINS)}) AS BIGINT)) AS w
          FROM sessions),
sb AS (SELECT least(greatest((start_us - s0) // w, 0), {C.N_BINS - 1}) AS bin, count(*) AS n FROM sessions, spec GROUP BY ALL),
eb AS (SELECT least(greatest((end_us - s0) // w, 0), {C.N_BINS - 1}) AS bin, count(*) AS n FROM sessions, spec GROUP BY ALL),
dense AS (SELECT CAST(b AS INTEGER) AS bin FROM range(0, {C.N_BINS}) t(b)),
bins AS (SELECT d.bin, coalesce(sb.n, 0) AS n_start, coalesce(eb.n, 0) AS n_end FROM dense d
         LEFT JOIN sb ON sb.bin = d.bin LEFT JOIN eb ON eb.bin = d.bin),
cum AS (SELECT bin, n_start, n_end,
               CAST(sum(n_end) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS ends_le,
               CAST(sum(n_start) OVER (ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS starts_ge,
               CAST(sum(n_start) OVER () AS BIGINT) AS total FROM bins)"""

PERIODS = f"""pst AS (SELECT min(start_us) AS s0, max(end_us) AS e0, count(*) AS n0, avg(end_us - start_us) AS len0 FROM sessions),
pspec AS (SELECT s0, e0, greatest(1, CAST(ceil(greatest({float(2 * H)}, len0, (e0 - s0) / {float(C.ALPHA)})) AS BIGINT)) AS span,
                 greatest(n0 // {C.ALPHA}, {C.BETA * C.TILE_K}) AS mc FROM pst),
hist AS (SELECT (start_us - s0) // span AS bin, count(*) AS cnt FROM sessions, pspec GROUP BY ALL),
ob AS (SELECT bin, cnt, row_number() OVER (ORDER BY bin) AS i FROM hist),
fold AS (SELECT i, bin, cnt, cnt AS held, 0 AS grp FROM ob WHERE i = 1
         UNION ALL
         SELECT ob.i, ob.bin, ob.cnt, CASE WHEN fold.held >= mc THEN ob.cnt ELSE fold.held + ob.cnt END,
                CASE WHEN fold.held >= mc THEN fold.grp + 1 ELSE fold.grp END
         FROM fold JOIN ob ON ob.i = fold.i + 1, pspec),
tail AS (SELECT max(grp) - CASE WHEN max(grp) > 0 AND arg_max(held, i) < (SELECT mc FROM pspec) THEN 1 ELSE 0 END AS top
         FROM fold),
hb AS (SELECT bin, cnt, least(grp, top) AS grp FROM fold, tail),
per AS (SELECT grp, min(bin) AS b0, CAST(sum(cnt) AS BIGINT) AS n FROM hb GROUP BY grp),
periods AS (SELECT CAST(row_number() OVER (ORDER BY grp) - 1 AS INTEGER) AS period,
                   CAST(CASE WHEN b0 = 0 THEN s0 ELSE s0 + b0 * span END AS BIGINT) AS p_start, n, grp
            FROM per, pspec),
periods2 AS (SELECT period, p_start,
                    CAST(coalesce(lead(p_start) OVER (ORDER BY grp), (SELECT e0 + 1 FROM pspec)) AS BIGINT) AS p_end, n
             FROM periods)"""


def _cellq(v, origin, level):
    return cell(v, origin, "side", level)


QUAD = f"""lv AS (SELECT CAST(l AS INTEGER) AS level FROM range(0, {C.QUAD_LEVEL + 1}) t(l)),
cnt AS (SELECT level, {_cellq('x', 'x0', 'level')} AS cx, {_cellq('y', 'y0', 'level')} AS cy, count(*) AS n
        FROM ev, g, lv GROUP BY ALL),
cap AS (SELECT greatest(count(*) // {C.QUAD_BETA}, {4 * C.TILE_K}) AS cap FROM ev),
split AS (SELECT level, cx, cy FROM cnt, cap WHERE n > cap AND level < {C.QUAD_LEVEL}),
kids AS (SELECT level + 1 AS level, cx * 2 + dx AS cx, cy * 2 + dy AS cy
         FROM split, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) q(dx, dy)),
kidn AS (SELECT k.level, k.cx, k.cy, coalesce(c.n, 0) AS n FROM kids k LEFT JOIN cnt c
         ON c.level = k.level AND c.cx = k.cx AND c.cy = k.cy),
tiles AS (SELECT level, cx, cy, n FROM kidn, cap WHERE n <= cap OR level = {C.QUAD_LEVEL}
          UNION ALL SELECT level, cx, cy, n FROM cnt, cap WHERE level = 0 AND NOT (n > cap)),
numbered AS (SELECT CAST(row_number() OVER (ORDER BY level, cx, cy) - 1 AS INTEGER) AS tile, level, cx, cy, n FROM tiles)"""


def _box_cols(level):
    size = f"(side / pow(2.0, {level}))"
    return (f"x0 + cx * {size} AS minx, y0 + cy * {size} AS miny, "
            f"x0 + cx * {size} + {size} AS maxx, y0 + cy * {size} + {size} AS maxy")


def _geojson_point(x, y):
    return f"""'{{"type":"Point","coordinates":[' || CAST({x} AS VARCHAR) || ',' || CAST({y} AS VARCHAR) || ']}}'"""


def _feature(geom):
    return f"""'{{"type": "Feature", "geometry": ' || {geom} || ', "properties": {{}}}}'"""


WC = (2 * D + 1) // 4   # count-bin width of the kNN plan for delta = 1 day (M = 3)

SHARES = ", ".join(str(i / C.DEPTH_BINS) for i in range(1, C.DEPTH_BINS))
DEPTH = f"""cuts AS (SELECT user_id, min(end_us) AS min_end, max(start_us) AS max_start,
                    list_distinct(quantile_disc(start_us, [{SHARES}])) AS start_cuts,
                    list_distinct(quantile_disc(end_us, [{SHARES}])) AS end_cuts FROM sessions GROUP BY user_id),
        placed AS (SELECT s.user_id, len(list_filter(start_cuts, lambda u: u <= start_us)) AS sb,
                          len(list_filter(end_cuts, lambda u: u <= end_us)) AS eb
                   FROM sessions s JOIN cuts ON cuts.user_id = s.user_id),
        depth AS (SELECT c.user_id, CAST(b AS INTEGER) AS bin, count(*) FILTER (sb = b) AS n_start, count(*) FILTER (eb = b) AS n_end,
                         count(*) FILTER (eb <= b) AS ends_le, count(*) FILTER (sb >= b) AS starts_ge, count(*) AS total
                  FROM cuts c, range(0, {C.DEPTH_BINS}) t(b), placed p WHERE p.user_id = c.user_id GROUP BY ALL)"""

SQL: dict[str, str] = {
    "parse_time": """SELECT event_id AS id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS t_text,
        epoch_us(strptime(strftime(ts, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S')) AS epoch_us FROM events""",
    "load_wkt_tsv": with_base("""SELECT id, 'POINT' AS kind, x AS minx, y AS miny, x AS maxx, y AS maxy,
        epoch_us(date_trunc('second', ts)) AS start_us, epoch_us(date_trunc('second', ts)) AS end_us FROM ev"""),
    "parse_wkt": with_base(f"""SELECT id, {KIND} AS kind,
        CAST(CASE event_type WHEN 'purchase' THEN 1 WHEN 'view' THEN 3 WHEN 'click' THEN 10 WHEN 'signup' THEN 2 ELSE 10 END AS INTEGER) AS n_pts,
        CAST(CASE event_type WHEN 'purchase' THEN 1 WHEN 'view' THEN 1 ELSE 2 END AS INTEGER) AS n_parts,
        x AS minx, y AS miny, {MAXX} AS maxx, {MAXY} AS maxy FROM ev"""),
    "envelope": with_base(f"""SELECT id, x AS minx, y AS miny, {MAXX} AS maxx, {MAXY} AS maxy FROM ev"""),
    "envelope_expand": with_base("""SELECT id, minx - 2.5 AS minx, miny - 2.5 AS miny,
        maxx + 2.5 AS maxx, maxy + 2.5 AS maxy FROM box_right"""),
    "time_expand": with_base(f"""SELECT id, start_us - {H} AS start_us, end_us + {H} AS end_us FROM sessions"""),
    "centroid": with_base(f"""SELECT id, {KIND} AS kind,
        round(CASE event_type WHEN 'purchase' THEN x WHEN 'view' THEN x + 1.6 WHEN 'click' THEN x + 30.5 / 15.0
              WHEN 'signup' THEN x + 0.5 ELSE x + 2 END, 6) AS cx,
        round(CASE event_type WHEN 'purchase' THEN y WHEN 'view' THEN y + 0.9 WHEN 'click' THEN y + 30.5 / 15.0
              WHEN 'signup' THEN y + 0.5 ELSE y + 0.5 END, 6) AS cy FROM ev"""),
    "centre": with_base("""SELECT id, (start_us + end_us) >> 1 AS centre_t,
        (minx + maxx) / 2 AS centre_x, (miny + maxy) / 2 AS centre_y FROM sessions"""),
    "distance": with_base(f"""SELECT id, {KIND} AS kind, round({GEN_DIST}, 6) AS dist FROM ev"""),
    "envelope_distance": with_base(BOX_PAIRS + """
        SELECT l_id, r_id, sqrt(greatest(0.0, rminx - lmaxx, lminx - rmaxx) * greatest(0.0, rminx - lmaxx, lminx - rmaxx)
            + greatest(0.0, rminy - lmaxy, lminy - rmaxy) * greatest(0.0, rminy - lmaxy, lminy - rmaxy)) AS env_dist FROM bp"""),
    "envelope_intersection": with_base(BOX_PAIRS + f"""
        SELECT l_id, r_id, CASE WHEN {INTERSECTS} THEN greatest(lminx, rminx) END AS ix_minx,
            CASE WHEN {INTERSECTS} THEN greatest(lminy, rminy) END AS ix_miny,
            CASE WHEN {INTERSECTS} THEN least(lmaxx, rmaxx) END AS ix_maxx,
            CASE WHEN {INTERSECTS} THEN least(lmaxy, rmaxy) END AS ix_maxy FROM bp"""),
    "time_reference_point": with_base(BOX_PAIRS + f"""
        SELECT l_id, r_id, CASE WHEN ls - {H} <= re AND le + {H} >= rs THEN greatest(ls - {H}, rs) END AS t_ref FROM bp"""),
    "global_stats": with_base("""SELECT min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy,
        count(*) AS n, min(start_us) AS start_us, max(end_us) AS end_us, avg(end_us - start_us) AS avg_len,
        round(avg(greatest(maxx - minx, maxy - miny)), 6) AS avg_extent FROM box_right"""),
    "cell_envelope": with_base(f"""c AS (SELECT DISTINCT {_cellq('x', 'x0', '3')} AS cx, {_cellq('y', 'y0', '3')} AS cy FROM ev, g)
        SELECT CAST(3 AS INTEGER) AS level, cx, cy, {_box_cols('3')} FROM c, g"""),
    "quadrant_envelope": with_base(f"""c AS (SELECT DISTINCT {_cellq('x', 'x0', '3')} AS cx, {_cellq('y', 'y0', '3')} AS cy FROM ev, g),
        q AS (SELECT cx, cy, CAST(q AS INTEGER) AS q, cx * 2 + (q % 2) AS qx, cy * 2 + (q // 2) AS qy
              FROM c, range(0, 4) t(q))
        SELECT CAST(3 AS INTEGER) AS level, cx, cy, q, x0 + qx * (side / 16.0) AS minx, y0 + qy * (side / 16.0) AS miny,
               x0 + qx * (side / 16.0) + side / 16.0 AS maxx, y0 + qy * (side / 16.0) + side / 16.0 AS maxy FROM q, g"""),
    "st_knn_join": with_base(PT_TOP + " SELECT l_id, r_id, dist, rank FROM top"),
    "st_knn_join_nested": with_base(PT_TOP + """, nn AS (SELECT l_id, CAST(count(*) AS INTEGER) AS n_neighbours FROM top GROUP BY l_id)
        SELECT top.l_id, pl.x AS l_minx, n_neighbours, rank, r_id, dist FROM top JOIN nn USING (l_id)
        JOIN pl ON pl.id = top.l_id"""),
    "interval_overlap_filter": with_base(f"""SELECT id, start_us, end_us FROM sessions
        WHERE start_us <= {C.WIN_END} AND end_us >= {C.WIN_START}"""),
    "envelope_intersects": with_base("""SELECT id FROM box_right
        WHERE minx <= 200.0 AND maxx >= 100.0 AND miny <= 60.0 AND maxy >= 20.0"""),
    "bound_contains_point": with_base("""SELECT id FROM ev WHERE x >= 100.0 AND x < 200.0 AND y >= 20.0 AND y < 60.0"""),
    "bound_contains_time": with_base(f"""SELECT id FROM ev WHERE t >= {C.WIN_START} AND t < {C.WIN_END}"""),
    "bound_contains_range": with_base(f"""SELECT id FROM sessions WHERE start_us > {C.WIN_START} AND end_us < {C.WIN_END2}"""),
    "bound_contains_envelope": with_base("""SELECT id FROM box_right
        WHERE minx >= 100.0 AND maxx <= 300.0 AND miny >= 20.0 AND maxy <= 80.0"""),
    "right_prefilter": with_base(f"""lr AS (SELECT min(epoch_us(o_orderdate)) AS s, max(epoch_us(o_orderdate)) AS e
                   FROM orders WHERE year(o_orderdate) = 1995)
        SELECT id, start_us, end_us FROM long_intervals, lr WHERE start_us <= e + {D} AND end_us >= s - {D}"""),
    "replicated_join_dedup": with_base(f"""SELECT l.id AS l_id, r.id AS r_id, {BOX_DIST} AS dist FROM box_left l JOIN box_right r
        ON r.start_us <= l.end_us + {H} AND r.end_us >= l.start_us - {H} WHERE {BOX_DIST} <= 5.0"""),
    "st_distance_join": with_base(f"""SELECT l.id AS l_id, r.id AS r_id, {PT_DIST} AS dist FROM pl l JOIN pr r
        ON r.t <= l.t + {6 * H} AND r.t >= l.t - {6 * H} WHERE {PT_DIST} <= 3.0"""),
    "validate_rows": """SELECT l.l_orderkey AS id, l.l_linenumber, epoch_us(o.o_orderdate) AS start_us,
        epoch_us(l.l_shipdate) AS end_us,
        CASE WHEN epoch_us(o.o_orderdate) > epoch_us(l.l_shipdate) THEN 'start after end' END AS problem
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""",
    "with_row_id": "SELECT event_id, event_type, CAST(1 AS BIGINT) AS n_same_id FROM events",
    "sample_bounds": with_base(f"""tot AS (SELECT count(*) AS n FROM sessions),
        want AS (SELECT n, CASE WHEN n < 1000 THEN n ELSE greatest({2 * C.ALPHA * C.BETA}, n // 100) END / CAST(n AS DOUBLE) AS p,
                        -ln(1e-4) / n AS gamma FROM tot),
        frac AS (SELECT least(1.0, greatest(1e-10, p + gamma + sqrt(gamma * gamma + 2 * gamma * p))) AS f FROM want)
        SELECT id, minx, miny, maxx, maxy, start_us, end_us FROM sessions, frac
        WHERE CAST('0x' || substr(md5(CAST(id AS VARCHAR) || ':7'), 1, 8) AS UBIGINT) / 4294967296.0 < f"""),
    "sample_results": with_base(PT_TOP + """, nn AS (SELECT l_id, CAST(count(*) AS INTEGER) AS n_neighbours FROM top GROUP BY l_id)
        SELECT l_id, n_neighbours FROM nn ORDER BY md5(CAST(l_id AS VARCHAR) || ':7') LIMIT 10"""),
    # a row is bounded when the count bins inside its window hold k starts
    "knn_bound": with_base(PT_TOP + f""",
        sb AS (SELECT pr.t // {WC} AS sb, count(*) AS n FROM pr, (SELECT min(t) AS ls, max(t) AS le FROM pl) b
               WHERE pr.t <= b.le + {D} AND pr.t >= b.ls - {D} GROUP BY ALL),
        lq AS (SELECT id, (t - {D} + {WC} - 1) // {WC} AS b0, t FROM pl),
        enough AS (SELECT lq.id FROM lq JOIN sb ON sb.sb BETWEEN lq.b0 AND lq.b0 + 2
                   WHERE (lq.b0 + 3) * {WC} - 1 <= lq.t + {D} GROUP BY lq.id HAVING sum(sb.n) >= {C.K})
        SELECT DISTINCT l_id, l_id IN (SELECT id FROM enough) AS bounded, true AS bound_ok FROM top"""),
    "st_knn_join_copies": with_base(f"""pc AS (SELECT id, floor(x / 100) * 100.0 AS x, floor(y / 50) * 50.0 AS y,
                                                   (t // {DAYUS}) * {DAYUS} AS t FROM pr),
        """ + knn_pairs("pc", "pc", PT_TIME + " AND l.id <> r.id", PT_DIST, C.K) + " SELECT l_id, r_id, dist, rank FROM top"),
    "st_knn_join_hot": with_base("""ph AS (SELECT id, t,
            CASE WHEN id % 9 = 0 THEN 100.0 WHEN id % 3 = 0 THEN 100.0 + x * CAST(1e-7 AS DOUBLE) ELSE x END::DOUBLE AS x,
            CASE WHEN id % 9 = 0 THEN 50.0 WHEN id % 3 = 0 THEN 50.0 + y * CAST(1e-7 AS DOUBLE) ELSE y END::DOUBLE AS y FROM pr),
        """ + knn_pairs("ph", "ph", PT_TIME + " AND l.id <> r.id", PT_DIST, C.K) + " SELECT l_id, r_id, dist, rank FROM top"),
    "validate_wkt": """SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN 'empty geometry'
        WHEN 5 THEN 'infinite coordinate' ELSE 'malformed geometry' END AS problem FROM events""",
    # two polygons: 4 x 4 less a unit hole, and 2 x 2; centroid by areas 16 - 1 + 4
    "multipolygon": """SELECT event_id AS id, true AS same_text, 2 AS n_polygons, 2 AS n_rings_first, 1 AS n_rings_second,
        round((16 * 2 - 1.5 + 4 * 11) / 19.0, 6) AS cx, round((16 * 2 - 1.5 + 4 * 1) / 19.0, 6) AS cy FROM events""",
    "wkt_collections": with_base(f"""SELECT id, 'GEOMETRYCOLLECTION' AS kind, 8 AS n_pts, 3 AS n_parts, 1 AS n_shells,
        x AS minx, y AS miny, x + 6 AS maxx, y + 3 AS maxy, round(x + 5, 6) AS cx, round(y + 1, 6) AS cy,
        round({collection_dist('y', 'x', 'x', 'y')}, 6) AS dist, 'Point,LineString,Polygon' AS members, true AS same_text FROM ev"""),
    "collection_knn_join": with_base(f"""p AS (SELECT l.id AS l_id, r.id AS r_id,
            {collection_dist("l.x", "l.y", "r.x", "r.y")} AS dist FROM pl l JOIN ev r ON {PT_TIME}),
        top AS (SELECT *, row_number() OVER (PARTITION BY l_id ORDER BY dist, r_id) AS rank FROM p)
        SELECT l_id, r_id, round(dist, 6) AS dist, CAST(rank AS INTEGER) AS rank FROM top WHERE rank <= {C.K}"""),
    "geom_knn_join": with_base(f"""p AS (SELECT l.id AS l_id, r.id AS r_id, {KIND.replace("event_type", "r.event_type")} AS r_kind,
            {gen_dist("l.x", "l.y", "r.x", "r.y", "r.event_type")} AS dist FROM pl l JOIN ev r ON {PT_TIME}),
        top AS (SELECT *, row_number() OVER (PARTITION BY l_id ORDER BY dist, r_id) AS rank FROM p)
        SELECT l_id, r_id, r_kind, round(dist, 6) AS dist, CAST(rank AS INTEGER) AS rank FROM top WHERE rank <= {C.K}"""),
    "st_knn_query": with_base(f"""q AS (SELECT x, y, t FROM pl ORDER BY id LIMIT 1),
        c AS (SELECT r.id AS r_id, sqrt((r.x - q.x) * (r.x - q.x) + (r.y - q.y) * (r.y - q.y)) AS dist
              FROM pr r, q WHERE r.t <= q.t + {12 * H} AND r.t >= q.t - {12 * H})
        SELECT r_id, dist, CAST(rank AS INTEGER) AS rank FROM
          (SELECT *, row_number() OVER (ORDER BY dist, r_id) AS rank FROM c) WHERE rank <= 10"""),
    "layout_knn_query": with_base(f"""q AS (SELECT x, y, t FROM pl ORDER BY id LIMIT 1),
        c AS (SELECT r.id AS r_id, sqrt((r.x - q.x) * (r.x - q.x) + (r.y - q.y) * (r.y - q.y)) AS dist
              FROM pr r, q WHERE r.t <= q.t + {12 * H} AND r.t >= q.t - {12 * H})
        SELECT r_id, dist, CAST(rank AS INTEGER) AS rank FROM
          (SELECT *, row_number() OVER (ORDER BY dist, r_id) AS rank FROM c) WHERE rank <= 10"""),
    "interval_overlap_join": with_base("""SELECT l.id AS l_id, s.id AS r_id FROM pl l JOIN sessions s
        ON s.start_us <= l.t AND s.end_us >= l.t"""),
    "cell_equi_join": with_base(f"""k AS (SELECT id, {_cellq('x', 'x0', '4')} AS cx, {_cellq('y', 'y0', '4')} AS cy,
                 t // {DAYUS} AS tb, event_type FROM ev, g),
        rc AS (SELECT cx, cy, tb, count(*) AS n FROM k WHERE event_type = 'view' GROUP BY ALL)
        SELECT id, k.cx, k.cy, k.tb, coalesce(rc.n, 0) AS n_right FROM k LEFT JOIN rc
        ON rc.cx = k.cx AND rc.cy = k.cy AND rc.tb = k.tb WHERE k.event_type = 'purchase'"""),
    "cell_assign": with_base(f"""bg AS (SELECT min(minx) AS x0, min(miny) AS y0,
              CASE WHEN greatest(max(maxx) - min(minx), max(maxy) - min(miny)) > 0
                   THEN greatest(max(maxx) - min(minx), max(maxy) - min(miny)) ELSE 1.0 END AS side FROM box_right),
        a AS (SELECT id, start_us // {DAYUS} AS t0, end_us // {DAYUS} AS t1,
              {_cellq('minx', 'x0', '3')} AS x0c, {_cellq('maxx', 'x0', '3')} AS x1c,
              {_cellq('miny', 'y0', '3')} AS y0c, {_cellq('maxy', 'y0', '3')} AS y1c FROM box_right, bg)
        SELECT id, tb, CAST(cx AS INTEGER) AS cx, CAST(cy AS INTEGER) AS cy FROM a,
          generate_series(t0, t1) s1(tb), generate_series(x0c, x1c) s2(cx), generate_series(y0c, y1c) s3(cy)"""),
    "cell_assign_within": with_base(f"""a AS (SELECT id, (t - {12 * H}) // {DAYUS} AS t0, (t + {12 * H}) // {DAYUS} AS t1,
              {_cellq('x - 10.0', 'x0', '4')} AS x0c, {_cellq('x + 10.0', 'x0', '4')} AS x1c,
              {_cellq('y - 10.0', 'y0', '4')} AS y0c, {_cellq('y + 10.0', 'y0', '4')} AS y1c FROM pl, g)
        SELECT id, tb, CAST(cx AS INTEGER) AS cx, CAST(cy AS INTEGER) AS cy FROM a,
          generate_series(t0, t1) s1(tb), generate_series(x0c, x1c) s2(cx), generate_series(y0c, y1c) s3(cy)"""),
    "tile_lookup": with_base(QUAD + f""",
        pc AS (SELECT id, level, {_cellq('x', 'x0', 'level')} AS cx, {_cellq('y', 'y0', 'level')} AS cy FROM ev, g, lv)
        SELECT pc.id, numbered.tile, pc.level FROM pc JOIN numbered
          ON numbered.level = pc.level AND numbered.cx = pc.cx AND numbered.cy = pc.cy"""),
    "equi_depth_bins": with_base(DEPTH + " SELECT user_id, bin, n_start, n_end, ends_le, starts_ge, total FROM depth"),
    "equi_depth_bound": with_base(DEPTH + f""",
        q AS (SELECT id, user_id, t - {10 * DAYUS} AS a, t + {10 * DAYUS} AS c FROM pl)
        SELECT q.id, q.user_id, CAST(greatest(0, lo.total - CASE WHEN a > min_end THEN lo.ends_le ELSE 0 END
                  - CASE WHEN c < max_start THEN hi.starts_ge ELSE 0 END) AS BIGINT) AS lower_bound, lower_bound >= {C.TILE_K} AS has_k
        FROM q JOIN cuts ON cuts.user_id = q.user_id
        JOIN depth lo ON lo.user_id = q.user_id AND lo.bin = len(list_filter(end_cuts, lambda u: u <= a))
        JOIN depth hi ON hi.user_id = q.user_id AND hi.bin = len(list_filter(start_cuts, lambda u: u <= c))"""),
    "load_rejects": """SELECT CASE event_id % 7 WHEN 0 THEN 'valid' WHEN 1 THEN 'malformed geometry' WHEN 2 THEN 'empty geometry'
            WHEN 4 THEN 'start after end' WHEN 5 THEN 'infinite coordinate' ELSE 'null time' END AS problem,
        count(*) AS n_counted, count(*) AS n_stored, CAST(sum(event_id) AS BIGINT) AS id_sum FROM events GROUP BY 1""",
    "interval_bins": with_base(BINS + " SELECT bin, n_start, n_end, ends_le, starts_ge, total FROM cum"),
    "grouped_interval_bins": with_base("""gs AS (SELECT user_id, min(start_us) AS o, max(end_us) - min(start_us) + 1 AS span
                                                 FROM sessions GROUP BY user_id),
        sp AS (SELECT user_id, o AS origin_us, (span + 7) // 8 AS width_us, CAST(b AS INTEGER) AS bin FROM gs, range(0, 8) t(b))
        SELECT sp.user_id, origin_us, width_us, bin,
               count(*) FILTER ((start_us - origin_us) // width_us = bin) AS n_start,
               count(*) FILTER ((end_us - origin_us) // width_us = bin) AS n_end,
               count(*) FILTER ((end_us - origin_us) // width_us <= bin) AS ends_le,
               count(*) FILTER ((start_us - origin_us) // width_us >= bin) AS starts_ge, count(*) AS total
        FROM sp JOIN sessions s ON s.user_id = sp.user_id GROUP BY ALL"""),
    "overlap_count_bound": with_base(BINS + f""",
        q AS (SELECT id, t - {H} AS a, t + {H} AS c FROM pl),
        qb AS (SELECT id, a, c, least(greatest((a - s0) // w, 0), {C.N_BINS - 1}) AS ba,
                      least(greatest((c - s0) // w, 0), {C.N_BINS - 1}) AS bc, s0, e0 FROM q, spec),
        j AS (SELECT qb.*, lo.ends_le, lo.total, hi.starts_ge FROM qb JOIN cum lo ON lo.bin = qb.ba JOIN cum hi ON hi.bin = qb.bc),
        b AS (SELECT id, CAST(CASE WHEN a > e0 OR c < s0 THEN 0 ELSE greatest(0, total
                    - CASE WHEN a > s0 THEN ends_le ELSE 0 END - CASE WHEN c < e0 THEN starts_ge ELSE 0 END) END AS BIGINT) AS lower_bound
              FROM j)
        SELECT id, lower_bound, lower_bound >= {C.TILE_K} AS has_k FROM b"""),
    "st_knn_count": with_base(PT_TOP + " SELECT count(DISTINCT l_id) AS n FROM top"),
    "time_periods": with_base(PERIODS + " SELECT period, p_start, p_end, n FROM periods2"),
    "period_density": with_base(PERIODS + """ SELECT period, p_start, p_end, n,
        n / CAST(p_end - p_start AS DOUBLE) AS density FROM periods2"""),
    "periods_for_range": with_base(PERIODS + """ SELECT s.id, p.period FROM sessions s JOIN periods2 p
        ON s.start_us < p.p_end AND s.end_us >= p.p_start"""),
    "periods_many": with_base("""lim AS (SELECT min(t) AS lo, max(t) AS hi FROM ev),
        met AS (SELECT id, (t - lo) // 20000000 AS p0, least((t + 45000000 - lo) // 20000000, (hi - lo) // 20000000) AS p1 FROM ev, lim)
        SELECT id, CAST(p AS INTEGER) AS period FROM met, generate_series(p0, p1) s(p)"""),
    "area_distance_join": with_base(f"""a AS (SELECT id, x, y, t FROM ev WHERE event_type = 'click'),
        b AS (SELECT id, x, y, t FROM ev WHERE event_type = 'error'),
        d AS (SELECT a.id AS l_id, b.id AS r_id, least({_boxes_d('a.x', 'a.y', 4, 'b.x', 'b.y', 1)},
                     {_boxes_d('a.x', 'a.y', 4, 'b.x + 3', 'b.y', 1)}) AS dist
              FROM a JOIN b ON abs(a.t - b.t) <= {2 * C.HOUR})
        SELECT l_id, r_id, round(dist, 6) AS dist FROM d WHERE dist <= 6"""),
    "trajectory_distance": with_base("""pts AS (SELECT user_id, event_type, x, y, row_number() OVER (
            PARTITION BY user_id, event_type ORDER BY t, id) AS i, count(*) OVER (PARTITION BY user_id, event_type) AS n
          FROM ev WHERE event_type IN ('purchase', 'view')),
        seg AS (SELECT a.user_id, a.event_type, a.x AS ax, a.y AS ay, coalesce(b.x, a.x) AS ex, coalesce(b.y, a.y) AS ey
                FROM pts a LEFT JOIN pts b ON b.user_id = a.user_id AND b.event_type = a.event_type AND b.i = a.i + 1
                WHERE b.i IS NOT NULL OR a.n = 1),
        pair AS (SELECT s.user_id, s.ax, s.ay, s.ex, s.ey, t.ax AS cx, t.ay AS cy, t.ex AS dx, t.ey AS dy
                 FROM seg s JOIN seg t ON s.user_id = t.user_id AND s.event_type = 'purchase' AND t.event_type = 'view'),
        side AS (SELECT *, sign((ex - ax) * (cy - ay) - (ey - ay) * (cx - ax)) * sign((ex - ax) * (dy - ay) - (ey - ay) * (dx - ax)) AS o1,
                 sign((dx - cx) * (ay - cy) - (dy - cy) * (ax - cx)) * sign((dx - cx) * (ey - cy) - (dy - cy) * (ex - cx)) AS o2 FROM pair)
        SELECT user_id, round(min(CASE WHEN o1 < 0 AND o2 < 0 THEN 0.0 ELSE least("""
        + ", ".join(_pt_seg_d(*a) for a in (("ax", "ay", "cx", "cy", "dx", "dy"), ("ex", "ey", "cx", "cy", "dx", "dy"),
                                            ("cx", "cy", "ax", "ay", "ex", "ey"), ("dx", "dy", "ax", "ay", "ex", "ey")))
        + """) END), 6) AS dist FROM side GROUP BY user_id"""),
    "period_cell_assign": with_base(PERIODS + f""",
        sg AS (SELECT min(minx) AS x0, min(miny) AS y0,
               CASE WHEN greatest(max(maxx) - min(minx), max(maxy) - min(miny)) > 0
                    THEN greatest(max(maxx) - min(minx), max(maxy) - min(miny)) ELSE 1.0 END AS side FROM sessions),
        a AS (SELECT id, start_us, end_us, {_cellq('minx', 'x0', '2')} AS x0c, {_cellq('maxx', 'x0', '2')} AS x1c,
              {_cellq('miny', 'y0', '2')} AS y0c, {_cellq('maxy', 'y0', '2')} AS y1c FROM sessions, sg)
        SELECT a.id, p.period, CAST(cx AS INTEGER) AS cx, CAST(cy AS INTEGER) AS cy
        FROM a JOIN periods2 p ON a.start_us < p.p_end AND a.end_us >= p.p_start,
             generate_series(x0c, x1c) s2(cx), generate_series(y0c, y1c) s3(cy)"""),
    "group_envelope": with_base(f"""k AS (SELECT x, y, {_cellq('x', 'x0', '2')} AS cx, {_cellq('y', 'y0', '2')} AS cy FROM ev, g)
        SELECT cx, cy, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy, count(*) AS n FROM k GROUP BY cx, cy"""),
    "kth_distance": with_base(PT_TOP + f""" SELECT l_id, CASE WHEN count(*) >= {C.K} THEN max(dist) END AS kth_dist,
        count(*) AS n_neighbours FROM top GROUP BY l_id"""),
    "quad_tiles": with_base(QUAD + f" SELECT level, cx, cy, n, {_box_cols('level')} FROM tiles, g"),
    "cell_numbering": with_base(QUAD + " SELECT tile, level, cx, cy FROM numbered"),
    "home_cell": with_base(f"""rs AS (SELECT pr.* FROM pr, (SELECT min(t) AS ls, max(t) AS le FROM pl) b
                WHERE pr.t <= b.le + {D} AND pr.t >= b.ls - {D}),
        rg AS (SELECT min(x) AS x0, min(y) AS y0,
               CASE WHEN greatest(max(x) - min(x), max(y) - min(y)) > 0
                    THEN greatest(max(x) - min(x), max(y) - min(y)) ELSE 1.0 END AS side FROM rs),
        lv AS (SELECT CAST(l AS INTEGER) AS level FROM range(0, 7) t(l)),
        rc AS (SELECT level, {_cellq('x', 'x0', 'level')} AS cx, {_cellq('y', 'y0', 'level')} AS cy,
                      t // {WC} AS sb, count(*) AS n FROM rs, rg, lv GROUP BY ALL),
        lq AS (SELECT id, level, {_cellq('x', 'x0', 'level')} AS cx, {_cellq('y', 'y0', 'level')} AS cy,
                      (t - {D} + {WC} - 1) // {WC} AS b0 FROM pl, rg, lv
               WHERE ((t - {D} + {WC} - 1) // {WC} + 3) * {WC} - 1 <= t + {D}),
        hits AS (SELECT lq.id, lq.level, lq.cx, lq.cy FROM lq JOIN rc ON rc.level = lq.level AND rc.cx = lq.cx
                 AND rc.cy = lq.cy AND rc.sb BETWEEN lq.b0 AND lq.b0 + 2
                 GROUP BY lq.id, lq.level, lq.cx, lq.cy HAVING sum(rc.n) >= {C.K})
        SELECT id, level, cx, cy FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY level DESC) AS rn FROM hits)
        WHERE rn = 1"""),
    "st_knn_join_filtered": with_base(knn_pairs("pr", "pr", PT_TIME + " AND l.id <> r.id", PT_DIST, C.K)
                                      + " SELECT l_id, r_id, dist, rank FROM top"),
    "st_knn_join_widening": with_base(knn_pairs("pl", "pr", PT_TIME + " AND l.user_id % 7 = r.user_id % 7", PT_DIST, C.K)
                                      + " SELECT l_id, r_id, dist, rank FROM top"),
    "box_knn_join": with_base(knn_pairs("box_left", "box_right",
                                        f"r.start_us <= l.end_us + {D} AND r.end_us >= l.start_us - {D}", BOX_DIST, C.K)
                              + " SELECT l_id, r_id, dist, rank FROM top"),
    "box_knn_join_overlapping": with_base(f"""wide AS (SELECT min(id) AS id, min(x) AS minx, min(y) AS miny, max(x) AS maxx,
            max(y) AS maxy, min(t) AS start_us, max(t) AS end_us FROM pr GROUP BY user_id, floor(t / {float(16 * DAYUS)})),
        pb AS (SELECT id, x AS minx, y AS miny, x AS maxx, y AS maxy, t AS start_us, t AS end_us FROM pl), """
        + knn_pairs("pb", "wide", f"r.start_us <= l.end_us + {D} AND r.end_us >= l.start_us - {D}", BOX_DIST, C.K)
        + " SELECT l_id, r_id, dist, rank FROM top"),
    "session_knn_join": with_base("""pl2 AS (SELECT id, x AS minx, y AS miny, x AS maxx, y AS maxy, t AS start_us, t AS end_us
                                  FROM pl), """ + knn_pairs(
        "pl2", "sessions", f"r.start_us <= l.end_us + {H} AND r.end_us >= l.start_us - {H}", BOX_DIST, C.K)
        + " SELECT l_id, r_id, dist, rank FROM top"),
    "vec_knn_join": """WITH v AS (SELECT vec_id AS id, CAST(embedding[2] AS DOUBLE) AS x, CAST(embedding[3] AS DOUBLE) AS y
                  FROM embeddings), """ + knn_pairs("v", "v", "l.id <> r.id", PT_DIST, C.K)
                    + " SELECT l_id, r_id, dist, rank FROM top",
    "result_roundtrip": with_base(PT_TOP + " SELECT l_id, rank, r_id, dist FROM top"),
    # the text layout holds whole seconds
    "load_join_store": with_base("""s AS (SELECT id, x, y, epoch_us(date_trunc('second', ts)) AS t, event_type FROM ev),
        sl AS (SELECT * FROM s WHERE event_type = 'purchase'), sr AS (SELECT * FROM s WHERE event_type = 'view'),
        """ + knn_pairs("sl", "sr", PT_TIME, PT_DIST, C.K) + """ SELECT sl.x, sl.y, sl.t AS start_us, rank, dist
        FROM top JOIN sl ON sl.id = top.l_id"""),
    "geojson_export": with_base(PT_TOP + f""",
        f AS (SELECT top.l_id, top.rank, {_feature(_geojson_point('r.x', 'r.y'))} AS feat
              FROM top JOIN pr r ON r.id = top.r_id),
        agg AS (SELECT l_id, string_agg(feat, ', ' ORDER BY rank) AS feats FROM f GROUP BY l_id)
        SELECT agg.l_id, '{{"type": "FeatureCollection", "features": [' || {_feature(_geojson_point('l.x', 'l.y'))}
               || ', ' || feats || ']}}' AS geojson FROM agg JOIN pl l ON l.id = agg.l_id"""),
}

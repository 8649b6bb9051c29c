"""DuckDB SQL that must give each query's rows, written from the definitions, not from the plans.

Where a query walks a tree by joins, its SQL recurses; where a query cuts a log into buckets, its SQL
orders the whole log.
"""

from __future__ import annotations

LAT, LON = 46.55, 7.98
# Planes (a, b, c, d) of the two cameras' views, found from the angles of the view pyramid's sides
# (fields of view 60 degrees and, across, 2 atan(tan(30) 16 / 9); heading 20, pitch -15 and -55).
PLANES = [
    (0.892378, 0.411455, -0.185381, 370.762615),
    (-0.419123, 0.888802, -0.185381, 370.762615),
    (0.241845, 0.664463, 0.707107, -1414.213562),
    (0.088521, 0.24321, -0.965926, 1931.851653),
    (0.330366, 0.907673, -0.258819, 516.63809),
    (-0.330366, -0.907673, 0.258819, 19999482.36191),
]
HIGH_PLANES = [
    (0.796262, 0.147379, -0.586725, 880086.761616),
    (-0.515239, 0.624727, -0.586725, 880086.761616),
    (0.340719, 0.936117, 0.087156, -130733.614121),
    (-0.144544, -0.397131, -0.906308, 1359461.680555),
    (0.196175, 0.538986, -0.819152, 1228727.066433),
    (-0.196175, -0.538986, 0.819152, 18771271.933567),
]
POS, HIGH_POS = (0.0, 0.0, 2000.0), (0.0, 0.0, 1_500_000.0)
#: Pixels times the cotangent of half the field of view.
H_P11 = "(1080 / tan(pi() / 6))"
MAX_Z = 6
BOX = "lo_x lo_y lo_z hi_x hi_y hi_z".split()

GEO = """geo_points AS (
    SELECT c_custkey AS id, (c_custkey * 137.5077640500378e0) % 360 - 180 AS lon,
           (c_custkey * 61.8033988749895e0) % 170 - 85 AS lat, c_acctbal AS h FROM customer)"""
HITS = (
    GEO
    + """, tile_hits AS (
    SELECT id, z::BIGINT AS z, lon, lat, h,
           least(greatest(trunc((lon + 180) / 360 * (2::BIGINT << z))::BIGINT, 0), (2::BIGINT << z) - 1) AS x,
           least(greatest(trunc((lat + 90) / 180 * (1::BIGINT << z))::BIGINT, 0), (1::BIGINT << z) - 1) AS y
    FROM geo_points, range(1, 10) r(z))"""
)
RECTS = """avail_rects AS (
    SELECT k AS ingest_seq, level, sx, sy, least(sx + greatest(cols // 8, 1), cols - 1) AS ex, least(sy + greatest(rws // 4, 1), rws - 1) AS ey
    FROM (SELECT *, (k * 37) % cols AS sx, (k * 11) % rws AS sy
          FROM (SELECT s_suppkey AS k, (1 + s_suppkey % 9)::BIGINT AS level, 2::BIGINT << (1 + s_suppkey % 9)::INT AS cols, 1::BIGINT << (1 + s_suppkey % 9)::INT AS rws FROM supplier)))"""
A, E2 = "6378137.0::DOUBLE", "((1/298.257223563e0) * (2 - 1/298.257223563e0))"


def west(z="z", x="x"):
    return f"({x} * (2 * pi() / (2::BIGINT << {z}::INT)) - pi())"


def south(z="z", y="y"):
    return f"({y} * (pi() / (1::BIGINT << {z}::INT)) - pi() / 2)"


def ecef(lon, lat, h):
    n = f"({A} / sqrt(1 - {E2} * sin({lat}) * sin({lat})))"
    return [f"(({n} + ({h})) * cos({lat}) * cos({lon}))", f"(({n} + ({h})) * cos({lat}) * sin({lon}))", f"(({n} * (1 - {E2}) + ({h})) * sin({lat}))"]


def _frame():
    p, q = f"radians({LAT}e0)", f"radians({LON}e0)"
    o = ecef(q, p, "0")
    return f"""frame AS (SELECT {o[0]} AS ox, {o[1]} AS oy, {o[2]} AS oz, sin({q}) AS sl, cos({q}) AS cl, sin({p}) AS sp, cos({p}) AS cp)"""


FRAME = _frame()


def local(x, y, z):
    """East, north, up; needs `frame` beside."""
    dx, dy, dz = f"(({x}) - ox)", f"(({y}) - oy)", f"(({z}) - oz)"
    return [f"(-sl * {dx} + cl * {dy})", f"(-sp * cl * {dx} - sp * sl * {dy} + cp * {dz})", f"(cp * cl * {dx} + cp * sl * {dy} + sp * {dz})"]


def merc_y(lat):
    lim = "atan(sinh(pi()))"
    return f"((ln(tan(pi() / 4 + least(greatest({lat}, -{lim}), {lim}) / 2)) + pi()) / (2 * pi()))"


def in_planes(p="", planes=PLANES):
    return " AND ".join(f"({' + '.join(f'({n!r}::DOUBLE) * {p}{"hi" if n > 0 else "lo"}_{a}' for n, a in zip(pl[:3], 'xyz'))} + ({pl[3]!r}::DOUBLE) >= 0)" for pl in planes)


def distance(p="", pos=POS):
    d = [f"greatest({p}lo_{a} - ({v!r}::DOUBLE), ({v!r}::DOUBLE) - {p}hi_{a}, 0)" for a, v in zip("xyz", pos)]
    return f"sqrt({' + '.join(f'{e} * {e}' for e in d)})"


def rounded(names, n):
    return ", ".join(f"round({c}, {n}) AS {c}" for c in names)


ORACLES: dict[str, str] = {}


def sql(name: str, text: str) -> None:
    ORACLES[name] = text


# Scalars
x, y, z = ecef("radians(lon)", "radians(lat)", "h")
sql("ecef", f"WITH {GEO} SELECT id, round({x}, 3) + 0 AS ex, round({y}, 3) + 0 AS ey, round({z}, 3) + 0 AS ez FROM geo_points")
e, n, u = local(x, y, z)
sql("enu", f"WITH {GEO}, {FRAME} SELECT id, round({e}, 3) AS e, round({n}, 3) AS n, round({u}, 3) AS u FROM geo_points, frame")
sql("tile_rect", f"WITH {HITS} SELECT id, z, round({west()}, 9) AS west, round({south()}, 9) AS south, round({west(x='(x + 1)')}, 9) AS east, round({south(y='(y + 1)')}, 9) AS north FROM tile_hits")
sql("children_parent", f"WITH {HITS} SELECT DISTINCT z, x, y, z + 1 AS kz, 2 * x + i AS kx, 2 * y + j AS ky, x AS px, y AS py FROM tile_hits, range(2) a(i), range(2) b(j)")
sql("lonlat_to_tile", f"WITH {HITS} SELECT id, z, x, y FROM tile_hits")
sql("uv_ancestor", f"""WITH {HITS}, d AS (SELECT *, greatest(z - 4, 0)::INT AS dz FROM tile_hits)
    SELECT id, z, z - dz AS az, x >> dz AS ax, y >> dz AS ay, 1.0::DOUBLE / (1::BIGINT << dz) AS scale,
           (x - ((x >> dz) << dz)) / (1::BIGINT << dz)::DOUBLE AS u_off, (y - ((y >> dz) << dz)) / (1::BIGINT << dz)::DOUBLE AS v_off FROM d""")
sql("merc_norm", f"WITH {GEO} SELECT id, round((radians(lon) + pi()) / (2 * pi()), 9) AS mx, round({merc_y('radians(lat)')}, 9) AS my FROM geo_points")
sql("quadkey", f"""WITH {HITS}, t AS (SELECT id, z, x, (2::BIGINT << z::INT) - 1 - y AS top FROM tile_hits),
    d AS (SELECT id, z, string_agg((((x >> i::INT) & 1) + 2 * ((top >> i::INT) & 1))::VARCHAR, '' ORDER BY i DESC) AS qk, min((x + top) % 4) AS sub FROM t, range(0, 10) r(i) WHERE i <= z GROUP BY id, z)
    SELECT id, z, qk, sub FROM d""")
sql("sse", f"""WITH {HITS}, g AS (SELECT id, z, 77067e0 / (1::BIGINT << z::INT) * {H_P11} AS e, abs(h) * 10 + 1 AS d FROM tile_hits)
    SELECT id, z, round(e / (2 * greatest(d, 1e-6)), 6) AS err, round(e / 2, 6) AS ortho FROM g""")
FLOOR = "CASE WHEN z >= {m} THEN 0 ELSE 6.0::DOUBLE * (2 * pi() / (2::BIGINT << z::INT)) * 6378137.0::DOUBLE * greatest(cos(" + south() + " + pi() / (1::BIGINT << z::INT) / 2), 0.05) / 256 END"
sql("ge_floor", f"WITH {HITS} SELECT id, z, round({FLOOR.format(m=8)}, 6) AS least FROM tile_hits")
HORIZON = "sqrt(hh * (2 * 6378137.0::DOUBLE + hh)) + sqrt(9000 * (2 * 6378137.0::DOUBLE + 9000))"
sql("horizon", f"""WITH {GEO}, {FRAME}, c AS (SELECT id, lon * 100 AS e, lat * 100 AS n, abs(h) AS u FROM geo_points),
    w AS (SELECT id, u, sqrt(ox*ox + oy*oy + oz*oz) AS r, ox - sl*e - sp*cl*n + cp*cl*u AS wx, oy + cl*e - sp*sl*n + cp*sl*u AS wy, oz + cp*n + sp*u AS wz FROM c, frame),
    k AS (SELECT id, greatest(sqrt(wx*wx + wy*wy + wz*wz) - r, u, 0) AS hh FROM w) SELECT id, round({HORIZON}, 2) AS limit_m FROM k""")
_m = ", ".join(f"round(sin(id * {i + 1}), 6) AS m{i}" for i in range(16))
_planes = []
for _i, (_row, _sign) in enumerate((r, s) for r in range(3) for s in ("+", "-")):
    _v = [f"(m{12 + c} {_sign} m{4 * _row + c})" for c in range(4)]
    _n = f"coalesce(nullif(sqrt({_v[0]}*{_v[0]} + {_v[1]}*{_v[1]} + {_v[2]}*{_v[2]}), 0), 1)"
    _planes += [f"round({v} / {_n}, 6) AS p{_i}{'abcd'[c]}" for c, v in enumerate(_v)]
sql("frustum_planes", f"WITH {GEO}, m AS (SELECT id, {_m} FROM geo_points) SELECT id, {', '.join(_planes)} FROM m")
POINT_BOXES = f"{GEO}, b AS (SELECT id, lon*100 AS lo_x, lat*100 AS lo_y, h AS lo_z, lon*100 + 500 AS hi_x, lat*100 + 300 AS hi_y, h + 50 AS hi_z FROM geo_points)"
sql("frustum_cull", f"WITH {POINT_BOXES} SELECT id FROM b WHERE {in_planes()}")
sql("aabb_dist", f"WITH {POINT_BOXES} SELECT id, round({distance()}, 6) AS dist FROM b")

# Sources, names
sql("tile_url", f"WITH {HITS} SELECT id, z, 'https://tiles.example/v1/' || z || '/' || x || '/' || y || '.terrain' AS url FROM tile_hits")
PLAIN = "trim(regexp_replace(html, '<[^>]+>', '', 'g'), ' ')"
sql("strip_html", f"SELECT page_id, length({PLAIN}) AS n, md5({PLAIN}) AS plain_md5 FROM pages")
sql("url_sha1", "SELECT page_id, sha1(url) AS url_sha1 FROM pages")
sql("url_namespace", "SELECT page_id, coalesce(nullif(left(regexp_replace(regexp_replace(rtrim(trim(url), '/'), '^[a-z]+://', '', 'i'), '[^A-Za-z0-9._-]+', '_', 'g'), 80), ''), 'server') AS namespace FROM pages")
sql("sniff_ext", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '.jpg' WHEN 1 THEN '.png' WHEN 2 THEN '.tif' WHEN 3 THEN '.tif' ELSE '.bin' END AS ext FROM documents")
sql("content_kind", "SELECT doc_id, CASE WHEN strlen(coalesce(text, '')) < 8 THEN 'error' ELSE CASE doc_id % 6 WHEN 0 THEN 'glb' WHEN 1 THEN 'b3dm' WHEN 2 THEN 'cmpt' WHEN 5 THEN 'error' ELSE 'skip' END END AS kind FROM documents")
sql("ext_priority", """WITH f AS (SELECT doc_id % 97 AS tile, CASE doc_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 3 END AS r FROM documents)
    SELECT tile, CASE min(r) WHEN 1 THEN '.jpg' WHEN 2 THEN '.png' ELSE '.tif' END AS ext FROM f WHERE r IS NOT NULL GROUP BY tile""")
sql("tile_names", f"WITH {HITS} SELECT id, z, 'T_' || z || '_' || x || '_' || y AS object, 'M_img_' || z || '_' || x || '_' || y AS material FROM tile_hits")
sql("resolve_uri", """SELECT page_id, 'https://cdn.example/t/' || page_id || CASE page_id % 3 WHEN 0 THEN '.glb?key=own&session=s' || page_id % 7
    WHEN 1 THEN '.glb?session=s' || page_id % 7 || '&key=k1' ELSE '.json?v=2&session=s' || page_id % 7 || '&key=k1' END AS resolved FROM pages""")

# Availability, covers
THERE = "EXISTS (SELECT 1 FROM avail_rects r WHERE r.level = {z} AND {x} BETWEEN r.sx AND r.ex AND {y} BETWEEN r.sy AND r.ey)"
sql("availability", f"WITH {HITS}, {RECTS} SELECT id, z, x, y FROM tile_hits t WHERE {THERE.format(z='t.z', x='t.x', y='t.y')}")
sql("nearest_real_ancestor", f"""WITH {HITS}, {RECTS}, up AS (SELECT id, z, az, x >> (z - az)::INT AS ax, y >> (z - az)::INT AS ay FROM tile_hits, range(0, 10) r(az) WHERE az <= z)
    SELECT id, z AS level, max(az) AS az, arg_max(ax, az) AS ax, arg_max(ay, az) AS ay FROM up WHERE az = 0 OR {THERE.format(z='az', x='ax', y='ay')} GROUP BY id, z""")
sql("imagery_fallback", f"""WITH {HITS}, have AS (SELECT DISTINCT z, x, y FROM tile_hits WHERE (x * 3 + y * 5 + z) % 4 = 0),
    up AS (SELECT id, z, az, x >> (z - az)::INT AS ax, y >> (z - az)::INT AS ay FROM tile_hits, range(0, 8) r(az) WHERE az <= z)
    SELECT id, z AS level, max(az) AS az, arg_max(ax, az) AS ax, arg_max(ay, az) AS ay FROM up WHERE (az, ax, ay) IN (SELECT z, x, y FROM have) GROUP BY id, z""")
sql("set_intersect", f"WITH {HITS}, {RECTS} SELECT z, x, y FROM tile_hits INTERSECT SELECT level, sx, sy FROM avail_rects")
sql("imagery_url", f"""WITH {HITS}, t AS (SELECT id, z, x, y, (1::BIGINT << z::INT) - 1 - y AS top FROM tile_hits),
    d AS (SELECT id, z, any_value(x) AS x, any_value(y) AS y, any_value(top) AS top, string_agg((((x >> i::INT) & 1) + 2 * ((top >> i::INT) & 1))::VARCHAR, '' ORDER BY i DESC) AS qk FROM t, range(0, 10) r(i) WHERE i < z GROUP BY id, z)
    SELECT id, z, 'https://m.example/tiles/' || z || '/' || x || '/' || y || '.png' AS map_url, 'https://t' || (x + top) % 3 || '.example/a' || qk || '.jpeg?g=1&n=z' AS quad_url FROM d""")
_few = f"few AS (SELECT DISTINCT z, x, y FROM tile_hits)"
_x = lambda v, e: f"least(trunc(({v} {e}) * (1::BIGINT << m::INT))::BIGINT, (1::BIGINT << m::INT) - 1)"
COVERS = f"""{HITS}, {_few}, span AS (SELECT z, x, y, ({west()} + pi()) / (2 * pi()) AS x0, ({west(x='x')} + 2 * pi() / (2::BIGINT << z::INT) + pi()) / (2 * pi()) AS x1,
        {merc_y(south())} AS y0, {merc_y('(' + south() + ' + pi() / (1::BIGINT << z::INT))')} AS y1 FROM few),
    grids AS (SELECT z, x, y, m, {_x('x0', '+ 1e-9')} AS tx0, {_x('y0', '+ 1e-9')} AS ty0, {_x('x1', '- 1e-9')} AS tx1, {_x('y1', '- 1e-9')} AS ty1 FROM span, range(0, 11) r(m) WHERE m <= z + 1),
    covers AS (SELECT * FROM grids WHERE tx1 - tx0 < 1 AND ty1 - ty0 < 2),
    deepest AS (SELECT * FROM covers QUALIFY row_number() OVER (PARTITION BY z, x, y ORDER BY m DESC) = 1)"""
FILES = """files AS (SELECT DISTINCT m, tx, ty FROM (SELECT m, unnest(range(tx0, tx1 + 1)) AS tx, ty0, ty1 FROM covers) c, LATERAL (SELECT unnest(range(c.ty0, c.ty1 + 1)) AS ty) t WHERE (tx * 3 + ty * 5 + m) % 7 <> 0)"""
WHOLE = "(SELECT count(*) FROM files f WHERE f.m = c.m AND f.tx BETWEEN c.tx0 AND c.tx1 AND f.ty BETWEEN c.ty0 AND c.ty1) = (c.tx1 - c.tx0 + 1) * (c.ty1 - c.ty0 + 1)"
sql("merc_cover", f"WITH {COVERS} SELECT z, x, y, m, tx0, ty0, tx1, ty1 FROM deepest")
sql("cover_complete", f"WITH {COVERS}, {FILES} SELECT z, x, y, m FROM deepest c WHERE {WHOLE}")
sql("cover_fallback", f"WITH {COVERS}, {FILES} SELECT z, x, y, m, tx0, ty0, tx1, ty1 FROM covers c WHERE {WHOLE} QUALIFY row_number() OVER (PARTITION BY z, x, y ORDER BY m DESC) = 1")
sql("coverage_center", f"""WITH {RECTS} SELECT level, (ex - sx + 1) * (ey - sy + 1) AS area, round((sy + ey + 1) / 2.0::DOUBLE / (1::BIGINT << level::INT) * 180 - 90, 9) AS lat,
    round((sx + ex + 1) / 2.0::DOUBLE / (2::BIGINT << level::INT) * 360 - 180, 9) AS lon FROM avail_rects ORDER BY level DESC, area DESC, ingest_seq LIMIT 1""")
sql("max_level", f"WITH {RECTS} SELECT coalesce(max(level), 0) AS max_level FROM avail_rects")
sql("absent_lattice", f"""WITH {RECTS}, g AS (SELECT 7::BIGINT AS z, x, y FROM range(16, 256, 32) a(x), range(8, 128, 16) b(y))
    SELECT z, x, y FROM g WHERE NOT {THERE.format(z='7', x='g.x', y='g.y')} ORDER BY x, y LIMIT 20""")
META = """meta AS (SELECT (s_suppkey % 5 + 1)::BIGINT AS z, s_suppkey % 4 AS x, (s_suppkey * 3) % 2 AS y, s_suppkey AS k,
        CASE WHEN s_suppkey % 3 = 0 THEN (2::BIGINT << (s_suppkey % 5 + 2)::INT) - 1 ELSE (2::BIGINT << (s_suppkey % 5 + 1)::INT) - 1 END AS top FROM supplier),
    both_ AS (SELECT *, CASE WHEN k % 7 = 0 THEN 2::BIGINT << (z + 2)::INT ELSE top END AS wide FROM meta),
    off AS (SELECT *, CASE WHEN top < (2::BIGINT << (z + 1)::INT) AND wide < (2::BIGINT << (z + 2)::INT) THEN 1 WHEN top < (2::BIGINT << z::INT) AND wide < (2::BIGINT << (z + 1)::INT) THEN 0 ELSE 1 END AS o FROM both_)"""
sql("avail_offset", f"WITH {META} SELECT k AS ingest_seq, z, o::BIGINT AS level_offset FROM off")
sql("avail_ingest", f"""WITH {META}, once AS (SELECT * FROM off QUALIFY row_number() OVER (PARTITION BY z, x, y ORDER BY k) = 1)
    SELECT z + o AS level, 0::BIGINT AS sx, 0::BIGINT AS sy, top AS ex, 0::BIGINT AS ey, k AS ingest_seq FROM once UNION ALL SELECT z + o + 1, 0, 0, wide, 0, k FROM once""")
sql("ingest_once", f"WITH {META} SELECT z, x, y, min(k) AS ingest_seq FROM meta GROUP BY z, x, y")


# Boxes
def boxes(rows, key, n, w, s, e_, n_, h0, h1):
    """CTEs that put a box of an n x n grid at two heights around each row of `rows`."""
    lon, lat = f"({w} + i / {n - 1}.0::DOUBLE * (({e_}) - ({w})))", f"({s} + j / {n - 1}.0::DOUBLE * (({n_}) - ({s})))"
    pe, pn, pu = local(*ecef("plon", "plat", "ph"))
    sp = f"(6378137.0::DOUBLE * greatest(({e_}) - ({w}), ({n_}) - ({s})) / {n - 1})"
    return f"""samples AS (SELECT {key}, {lon} AS plon, {lat} AS plat, CASE k WHEN 0 THEN {h0} ELSE {h1} END AS ph, least({sp} * {sp} / (2 * 6378137.0::DOUBLE), 6378137.0::DOUBLE) AS mg FROM {rows}, range({n}) a(i), range({n}) b(j), range(2) c(k)),
    pts AS (SELECT {key}, mg, {pe} AS px, {pn} AS py, {pu} AS pz FROM samples, frame),
    boxed AS (SELECT {key}, min(px) - min(mg) AS lo_x, min(py) - min(mg) AS lo_y, min(pz) - min(mg) AS lo_z, max(px) + min(mg) AS hi_x, max(py) + min(mg) AS hi_y, max(pz) + min(mg) AS hi_z FROM pts GROUP BY {key})"""


TILE_BOXES = lambda rows: boxes(rows, "z, x, y", 5, west(), south(), west(x="(x + 1)"), south(y="(y + 1)"), "-1000.0::DOUBLE", "9000.0::DOUBLE")
sql("tile_aabb", f"WITH {HITS}, {_few}, {FRAME}, {TILE_BOXES('few')} SELECT z, x, y, {rounded(BOX, 2)} FROM boxed")
sql("bv_region", f"""WITH {GEO}, {FRAME}, reg AS (SELECT id, radians(lon) AS w, radians(lat) AS s, radians(lon + 0.5) AS e, radians(lat + 0.25) AS n, h AS h0, h + 100 AS h1 FROM geo_points),
    {boxes('reg', 'id', 3, 'w', 's', 'e', 'n', 'h0', 'h1')} SELECT id, {rounded(BOX, 2)} FROM boxed""")
_c = ecef("radians(lon)", "radians(lat)", "h")
VOL = f"vol AS (SELECT id, abs(h) + 1 AS r, {_c[0]} AS cx, {_c[1]} AS cy, {_c[2]} AS cz FROM geo_points)"
_pe = local("cx - 2 * q", "cy + 2 * p_", "cz + 2 * r_")
sql("bv_box", f"""WITH {GEO}, {FRAME}, {VOL}, cor AS (SELECT id, cx, cy, cz, 1 + 10 * i + 2 * k AS p_, 2 + 20 * j AS q, 3 + i + 30 * k AS r_ FROM vol, (VALUES (-1), (1)) a(i), (VALUES (-1), (1)) b(j), (VALUES (-1), (1)) c(k)),
    p AS (SELECT id, {_pe[0]} AS px, {_pe[1]} AS py, {_pe[2]} AS pz FROM cor, frame)
    SELECT id, round(min(px), 2) AS lo_x, round(min(py), 2) AS lo_y, round(min(pz), 2) AS lo_z, round(max(px), 2) AS hi_x, round(max(py), 2) AS hi_y, round(max(pz), 2) AS hi_z FROM p GROUP BY id""")
_ps = local("cx - 4", "cy + 2", "cz + 6")
sql("bv_sphere", f"""WITH {GEO}, {FRAME}, {VOL}, p AS (SELECT id, r, {_ps[0]} AS px, {_ps[1]} AS py, {_ps[2]} AS pz FROM vol, frame)
    SELECT id, round(px - 2*r, 2) AS lo_x, round(py - 2*r, 2) AS lo_y, round(pz - 2*r, 2) AS lo_z, round(px + 2*r, 2) AS hi_x, round(py + 2*r, 2) AS hi_y, round(pz + 2*r, 2) AS hi_z FROM p""")

# Selection
STATE = """CASE WHEN z < 3 OR k < 80 THEN 'built' WHEN k < 87 THEN 'queued' WHEN k < 91 THEN 'failed' WHEN k < 93 THEN 'fetching' WHEN k < 96 THEN 'decoded' ELSE 'dead' END"""
STATED = lambda rows: f"SELECT z, x, y, k, {STATE} AS state, (k % 3 = 0) AND {STATE} = 'built' AS visible, ((x * 31 + y * 17 + z) % 97) / 2.0::DOUBLE AS last_wanted FROM (SELECT z, x, y, (x * 7 + y * 13 + z * 5) % 97 AS k FROM {rows})"
PYRAMID = f"pyramid AS (SELECT z::BIGINT AS z, x, y FROM range(0, {MAX_Z + 2}) r(z), LATERAL (SELECT unnest(range(2::BIGINT << z::INT)) AS x) a, LATERAL (SELECT unnest(range(1::BIGINT << z::INT)) AS y) b)"
LIMIT = "(SELECT sqrt(hh * (2 * 6378137.0::DOUBLE + hh)) + sqrt(9000 * (2 * 6378137.0::DOUBLE + 9000)) FROM (SELECT 1500000.0::DOUBLE AS hh))"


def facts(threshold):
    err = f"round(greatest(77067e0 / (1::BIGINT << z::INT), {FLOOR.format(m=5)}) * {H_P11} / (2 * greatest(dist, 1e-6)), 6)"
    return f"""{FRAME}, {RECTS}, {PYRAMID}, tiles AS ({STATED('pyramid')}), {TILE_BOXES('pyramid')},
    f0 AS (SELECT t.*, b.* EXCLUDE (z, x, y), {distance('b.', HIGH_POS)} AS dist FROM tiles t JOIN boxed b USING (z, x, y)),
    f1 AS MATERIALIZED (SELECT z, x, y, state, {in_planes(planes=HIGH_PLANES)} AND dist <= {LIMIT} AS vis, {err} AS err, z <= 5 OR {THERE.format(z='f0.z', x='f0.x', y='f0.y')} AS real_ FROM f0),
    kid AS MATERIALIZED (SELECT z - 1 AS z, x >> 1 AS x, y >> 1 AS y, bool_and(real_ AND state <> 'dead') AS good, bool_and(NOT vis OR state = 'built') AS ready FROM f1 WHERE z > 0 GROUP BY ALL),
    facts AS MATERIALIZED (SELECT f1.*, err <= {threshold} OR NOT (f1.z < {MAX_Z} AND coalesce(good, false)) AS stop, coalesce(ready, false) AS ready FROM f1 LEFT JOIN kid USING (z, x, y))"""


WALK = """walk AS (SELECT * FROM facts WHERE z = 0 AND vis UNION ALL
    SELECT c.* FROM walk p JOIN facts c ON c.z = p.z + 1 AND c.x >> 1 = p.x AND c.y >> 1 = p.y WHERE NOT p.stop AND p.ready AND c.vis)"""
SHOWN = "shown AS (SELECT z, x, y FROM walk WHERE stop OR NOT ready)"
sql("lod_select", f"WITH RECURSIVE {facts(2.0)}, {WALK}, {SHOWN} SELECT z, x, y FROM shown")
sql("lod_load", f"""WITH RECURSIVE {facts(2.0)}, {WALK} SELECT z, x, y, round(-err, 3) AS priority FROM walk WHERE state IN ('queued', 'failed') UNION ALL
    SELECT c.z, c.x, c.y, round(-p.err, 3) FROM walk p JOIN facts c ON c.z = p.z + 1 AND c.x >> 1 = p.x AND c.y >> 1 = p.y WHERE NOT p.stop AND NOT p.ready AND c.vis AND c.state IN ('queued', 'failed')""")
_pass = [0.5 * 1.5**i for i in range(4)]
_walks = ", ".join(f"""walk{i} AS (SELECT * FROM facts WHERE z = 0 AND vis UNION ALL
    SELECT c.* FROM walk{i} p JOIN facts c ON c.z = p.z + 1 AND c.x >> 1 = p.x AND c.y >> 1 = p.y WHERE NOT (p.stop OR p.err <= {t}) AND p.ready AND c.vis),
    shown{i} AS (SELECT z, x, y, {t}::DOUBLE AS threshold FROM walk{i} WHERE stop OR err <= {t} OR NOT ready)""" for i, t in enumerate(_pass))
sql("lod_valve", f"""WITH RECURSIVE {facts(0.5)}, {_walks}, pick AS (SELECT CASE {' '.join(f'WHEN (SELECT count(*) FROM shown{i}) <= 60 THEN {i}' for i in range(3))} ELSE 3 END AS i)
    {' UNION ALL '.join(f'SELECT s.* FROM shown{i} s, pick WHERE pick.i = {i}' for i in range(4))}""")
sql("keep_set", f"WITH RECURSIVE {facts(2.0)}, {WALK}, {SHOWN} SELECT DISTINCT a AS z, x >> (z - a)::INT AS x, y >> (z - a)::INT AS y FROM shown, range(0, {MAX_Z + 1}) r(a) WHERE a <= z")
sql("visibility_diff", f"""WITH RECURSIVE {facts(2.0)}, {WALK}, {SHOWN}, now_ AS (SELECT z, x, y FROM tiles WHERE visible AND z <= {MAX_Z})
    (SELECT z, x, y, 'show' AS action FROM (SELECT * FROM shown EXCEPT SELECT * FROM now_)) UNION ALL (SELECT z, x, y, 'hide' FROM (SELECT * FROM now_ EXCEPT SELECT * FROM shown))""")
sql("single_tile", f"""WITH t AS (SELECT trunc(({LON} + 180) / 360e0 * 2048)::BIGINT AS x, trunc(({LAT} + 90) / 180e0 * 1024)::BIGINT AS y) SELECT 10::BIGINT AS z, x, y, x >> 2 AS ax, y >> 2 AS ay, 0.25::DOUBLE AS scale FROM t""")

# The tree
_leaf = "((s_suppkey * 7919) % 20001 - 10000)::DOUBLE AS cx, ((s_suppkey * 104729) % 20001 - 10000)::DOUBLE AS cy"
NODES = f"""nodes AS (
    SELECT 0::BIGINT AS id, NULL::BIGINT AS parent, 0 AS depth, 500000e0 AS error, 'REPLACE' AS refine, NULL::VARCHAR AS uri, -40000e0 AS lo_x, -40000e0 AS lo_y, -100e0 AS lo_z, 40000e0 AS hi_x, 40000e0 AS hi_y, 300e0 AS hi_z, false AS is_ready
    UNION ALL SELECT r_regionkey + 1, 0, 1, 20000, 'REPLACE', 'r' || r_regionkey || '.b3dm', -30000, -30000, -100, 30000, 30000, 300, true FROM region
    UNION ALL SELECT n_nationkey + 100, n_regionkey + 1, 2, 3000, CASE WHEN n_nationkey % 2 = 0 THEN 'ADD' ELSE 'REPLACE' END, CASE WHEN n_nationkey % 5 = 4 THEN 'n' || n_nationkey || '.glb' END, -25000, -25000, -100, 25000, 25000, 300, n_nationkey % 3 <> 1 FROM nation
    UNION ALL SELECT s_suppkey + 10000, s_nationkey + 100, 3, 60, 'REPLACE', CASE WHEN s_nationkey = 3 AND s_suppkey % 4 = 0 THEN 'x' || s_suppkey || '/tileset.json?v=1' ELSE 's' || s_suppkey || '.glb' END, cx - 200, cy - 200, -50, cx + 200, cy + 200, 150, s_nationkey > 2 OR s_suppkey % 2 = 1 FROM (SELECT *, {_leaf} FROM supplier))"""
TREE = f"""{NODES}, t0 AS (SELECT *, {distance()} AS dist, coalesce(regexp_matches(lower(split_part(uri, '?', 1)), '\\.json$'), false) AS tset FROM nodes),
    t1 AS (SELECT *, {in_planes()} AND dist <= 60000 AS seen, round(error * {H_P11} / (2 * greatest(dist, 1e-6)), 6) AS err, round(16 * (1 + dist / 2000), 6) AS thr, uri IS NOT NULL AS has_uri, EXISTS (SELECT 1 FROM nodes c WHERE c.parent = t0.id) AS has_kids FROM t0),
    t2 AS MATERIALIZED (SELECT *, (err > thr OR NOT (has_uri AND NOT tset)) AND (has_kids OR tset) AS wants FROM t1),
    s3 AS (SELECT id, parent, seen, NOT tset AND is_ready AS ok FROM t2 WHERE depth = 3),
    k2 AS (SELECT id, parent, seen, has_uri, is_ready, tset, coalesce((SELECT bool_and(NOT s.seen OR s.ok) FROM s3 s WHERE s.parent = t2.id), true) AS kids FROM t2 WHERE depth = 2),
    s2 AS (SELECT *, CASE WHEN has_uri THEN NOT tset AND is_ready ELSE kids END AS ok FROM k2),
    k1 AS (SELECT id, parent, seen, has_uri, is_ready, tset, coalesce((SELECT bool_and(NOT s.seen OR s.ok) FROM s2 s WHERE s.parent = t2.id), true) AS kids FROM t2 WHERE depth = 1),
    s1 AS (SELECT *, CASE WHEN has_uri THEN NOT tset AND is_ready ELSE kids END AS ok FROM k1),
    kids AS (SELECT id, kids FROM k1 UNION ALL SELECT id, kids FROM k2 UNION ALL SELECT 0, coalesce((SELECT bool_and(NOT seen OR ok) FROM s1), true) UNION ALL SELECT id, true FROM s3),
    t AS MATERIALIZED (SELECT t2.*, kids.kids AS kids_ready FROM t2 JOIN kids USING (id))"""
sql("tileset_select", f"""WITH RECURSIVE {TREE}, walk AS (SELECT t.*, NULL::DOUBLE AS wait FROM t WHERE parent IS NULL AND seen UNION ALL
    SELECT c.*, CASE WHEN p.wait IS NOT NULL THEN p.wait WHEN p.refine = 'REPLACE' AND NOT p.kids_ready THEN -p.err END FROM walk p JOIN t c ON c.parent = p.id AND c.seen
    WHERE CASE WHEN p.wait IS NOT NULL THEN NOT p.has_uri ELSE NOT p.tset AND p.wants END),
    acts AS (SELECT id, wait IS NULL AND has_uri AND NOT tset AND (refine = 'ADD' OR NOT (wants AND has_kids) OR NOT kids_ready) AS render,
        CASE WHEN wait IS NOT NULL THEN has_uri AND NOT is_ready WHEN tset THEN true ELSE has_uri AND NOT is_ready AND (refine = 'ADD' OR NOT (wants AND has_kids)) END AS load,
        CASE WHEN wait IS NOT NULL THEN wait ELSE -err END AS prio, CASE WHEN wait IS NOT NULL THEN NOT has_uri ELSE true END AS keep FROM walk)
    SELECT id, render, load, CASE WHEN load THEN round(prio, 3) END AS priority, keep FROM acts WHERE render OR load OR keep""")
sql("graft", f"""WITH {NODES}, m AS (SELECT id, id * 100 AS root FROM nodes WHERE regexp_matches(coalesce(uri, ''), 'json'))
    SELECT id, parent, depth::BIGINT AS depth, CASE WHEN id IN (SELECT id FROM m) THEN 'root.glb' ELSE uri END AS uri, id IN (SELECT id FROM m) AS grafted, CASE WHEN id IN (SELECT id FROM m) THEN 1e0 ELSE lo_x END AS lo_x FROM nodes
    UNION ALL SELECT root, NULL, 3, 'root.glb', false, 1 FROM m UNION ALL SELECT root + 1, id, 4, 'kid.glb', false, 1 FROM m""")

# Meshes
CODES = "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber::BIGINT AS code FROM lineitem"
_w = "OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, code ROWS UNBOUNDED PRECEDING)"
sql("zigzag", f"SELECT *, (sum(xor(code >> 1, -(code & 1))) {_w})::BIGINT AS value FROM ({CODES})")
sql("highwater", f"SELECT *, (sum((code = 0)::INT) {_w} - (code = 0)::INT - code)::BIGINT AS index FROM (SELECT l_orderkey, l_partkey, l_suppkey, code % 3 AS code FROM ({CODES}))")
NET = """v AS (SELECT (p_partkey - 1) // 81 AS mesh, (p_partkey - 1) % 81 AS v, p_retailprice AS vh, ((p_partkey - 1) % 81 % 9) * 4000e0 AS vx, ((p_partkey - 1) % 81 // 9) * 4000e0 AS vy FROM part),
    low AS (SELECT mesh, v AS a FROM v WHERE v % 9 < 8 AND v < 72), idx AS (SELECT mesh, a * 2 AS tri, a AS i1, a + 1 AS i2, a + 10 AS i3 FROM low UNION ALL SELECT mesh, a * 2 + 1, a, a + 10, a + 9 FROM low),
    tri AS (SELECT i.mesh, tri, a.vx AS x1, a.vy AS y1, a.vh AS h1, b.vx AS x2, b.vy AS y2, b.vh AS h2, c.vx AS x3, c.vy AS y3, c.vh AS h3 FROM idx i JOIN v a ON a.mesh = i.mesh AND a.v = i1 JOIN v b ON b.mesh = i.mesh AND b.v = i2 JOIN v c ON c.mesh = i.mesh AND c.v = i3)"""
SAMPLED = """bary AS (SELECT p.mesh, p.point, t.tri, h1, h2, h3, ((y2 - y3) * (px - x3) + (x3 - x2) * (py - y3)) / nullif((y2 - y3) * (x1 - x3) + (x3 - x2) * (y1 - y3), 0) AS w1,
        ((y3 - y1) * (px - x3) + (x1 - x3) * (py - y3)) / nullif((y2 - y3) * (x1 - x3) + (x3 - x2) * (y1 - y3), 0) AS w2 FROM pts p JOIN tri t ON t.mesh = p.mesh),
    hit AS (SELECT mesh, point, arg_min(w1 * h1 + w2 * h2 + (1 - w1 - w2) * h3, tri) AS h FROM bary WHERE w1 >= -1e-9 AND w2 >= -1e-9 AND 1 - w1 - w2 >= -1e-9 GROUP BY mesh, point),
    near AS (SELECT p.mesh, p.point, v.vh AS h FROM pts p JOIN v ON v.mesh = p.mesh WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.mesh = p.mesh AND hit.point = p.point) QUALIFY row_number() OVER (PARTITION BY p.mesh, p.point ORDER BY (vx - px) * (vx - px) + (vy - py) * (vy - py), v.v) = 1),
    sampled AS (SELECT mesh, point, h, true AS hit FROM hit UNION ALL SELECT mesh, point, h, false FROM near)"""
sql("tin_sample", f"""WITH {GEO}, {NET}, pts AS (SELECT id % (SELECT greatest(1, (count(*) + 80) // 81) FROM part) AS mesh, id AS point, (lon + 180) / 360 * 33000 AS px, (lat + 85) / 170 * 33000 AS py FROM geo_points), {SAMPLED}
    SELECT mesh, point, round(h, 4) AS h, hit FROM sampled WHERE mesh IN (SELECT mesh FROM v)""")
sql("upsample", f"""WITH {NET}, want AS (SELECT mesh, 6 + mesh % 2 AS z, CASE mesh % 2 WHEN 0 THEN 21 ELSE 43 END AS x, CASE mesh % 2 WHEN 0 THEN 20 ELSE 40 END AS y, 5 AS az, 10 AS ax, 10 AS ay FROM v WHERE v = 0),
    pts AS (SELECT mesh::BIGINT AS mesh, j * 9 + i AS point, ((x - (ax << (z - az)::INT)) + i / 8e0) / (1 << (z - az)::INT) * 32000 AS px, ((y - (ay << (z - az)::INT)) + j / 8e0) / (1 << (z - az)::INT) * 32000 AS py FROM want, range(9) a(i), range(9) b(j)), {SAMPLED},
    r AS (SELECT mesh, point, round(h, 4) AS h, min(round(h, 4)) OVER (PARTITION BY mesh) AS lo, max(round(h, 4)) OVER (PARTITION BY mesh) AS hi FROM sampled)
    SELECT mesh, point, round(lo, 4) AS min_h, round(hi, 4) AS max_h, coalesce(round_even((h - lo) / nullif(hi - lo, 0) * 32767, 0), 0)::BIGINT AS hq FROM r""")
VERT = f"""vert AS (SELECT p_partkey, 6 AS z, p_partkey % 128 AS x, p_partkey % 64 AS y, ((p_partkey * 37) % 32768) / 32767e0 AS fu, ((p_partkey * 101) % 32768) / 32767e0 AS fv, ((p_partkey * 211) % 32768) / 32767e0 * p_retailprice AS hh FROM part),
    ll AS (SELECT *, {west()} + fu * (2 * pi() / 128) AS lon, {south()} + fv * (pi() / 64) AS lat FROM vert)"""
_e = local(*ecef("lon", "lat", "hh"))
sql("mesh_enu", f"WITH {FRAME}, {VERT} SELECT p_partkey, round({_e[0]}, 2) AS e, round({_e[1]}, 2) AS n, round({_e[2]}, 2) AS up FROM ll, frame")
sql("mesh_uv", f"""WITH {VERT}, m AS (SELECT *, {merc_y(south())} AS y0, greatest({merc_y('(' + south() + ' + pi() / 64)')} - {merc_y(south())}, 1e-9) AS dy, {merc_y('lat')} AS my FROM ll)
    SELECT p_partkey, round(fu * 0.25 + (x - ((x >> 2) << 2)) * 0.25, 7) AS u, round(fv * 0.25 + (y - ((y >> 2) << 2)) * 0.25, 7) AS v, round(fu, 6) AS mu, round(least(greatest((my - y0) / dy, 0), 1), 6) AS mv FROM m""")
sql("mesh_aabb", f"""WITH {FRAME}, {VERT}, p AS (SELECT x, y, {_e[0]} AS e, {_e[1]} AS n, {_e[2]} AS up FROM ll, frame)
    SELECT x, y, {', '.join(f'round({f}({c}), 2) AS {p}_{c}' for c in ('e', 'n', 'up') for f, p in (('min', 'lo'), ('max', 'hi')))} FROM p GROUP BY x, y""")

# Life cycle
SESSION = f"{HITS}, hit_tiles AS (SELECT DISTINCT z, x, y FROM tile_hits), session AS ({STATED('hit_tiles')})"
LOG = "log AS (SELECT event_id, ts, user_id, CASE event_type WHEN 'purchase' THEN 'ok' WHEN 'error' THEN 'conn' WHEN 'signup' THEN 'dead' ELSE 'http' END AS outcome FROM events)"
sql("state_counts", f"WITH {SESSION} SELECT state, count(*) AS n, count(*) FILTER (visible) AS n_visible, coalesce(max(z), 0) AS max_level FROM session GROUP BY state")
sql("node_stats", f"""WITH {NODES}, s AS (SELECT CASE WHEN id % 11 < 7 THEN 'built' WHEN id % 11 < 9 THEN 'fetching' WHEN id % 11 < 10 THEN 'dead' ELSE 'queued' END AS state, id % 3 AS n FROM nodes)
    SELECT count(*) FILTER (state = 'built' AND n > 0) AS built, count(*) FILTER (state = 'fetching') AS fetching, count(*) FILTER (state = 'dead') AS dead, count(*) AS known FROM s""")
sql("request_tally", f"WITH {LOG} SELECT count(*) AS total, count(*) FILTER (outcome = 'ok') AS ok, count(*) FILTER (outcome = 'dead') AS not_found, count(*) FILTER (outcome = 'http') AS http_error, count(*) FILTER (outcome = 'conn') AS conn_error FROM log")
sql("elev_range", f"""WITH {SESSION}, r AS (SELECT min(k2 * 10e0) AS a, max(k2 * 30e0) AS b FROM (SELECT (x + y) % 50 AS k2, visible FROM session) WHERE visible AND k2 > 3)
    SELECT coalesce(a, 0) AS low, CASE WHEN a IS NULL THEN 4000e0 WHEN b - a < 200 THEN a + 200 ELSE b END AS high FROM r""")
sql("load_topk", f"""WITH {SESSION}, r AS (SELECT *, x * 7 + y * 3 + z AS j FROM session)
    SELECT -((j % 1000) / 8e0) AS priority, z, x, y, state FROM r WHERE state = 'queued' OR (state = 'failed' AND (j % 40) / 2e0 <= 10) ORDER BY priority, z, x, y LIMIT 13""")
sql("lru_evict", f"""WITH {SESSION}, r AS (SELECT z, x, y, last_wanted, row_number() OVER (ORDER BY last_wanted, z, x, y) AS i FROM session WHERE state = 'built' AND NOT visible AND z > 3 AND 50 - last_wanted > 10)
    SELECT z, x, y, last_wanted FROM r WHERE i <= least(24, greatest(0, (SELECT count(*) FROM session WHERE state = 'built') - 400))""")
sql("lru_evict_nodes", f"""WITH {NODES}, s AS (SELECT id, id % 4 < 3 AS built, id % 5 = 0 AS visible, ((id * 13) % 50)::DOUBLE AS last_wanted FROM nodes),
    r AS (SELECT id, last_wanted, row_number() OVER (ORDER BY last_wanted, id) AS i FROM s WHERE built AND NOT visible AND id >= 110 AND 50 - last_wanted > 10)
    SELECT id, last_wanted FROM r WHERE i <= least(16, greatest(0, (SELECT count(*) FROM s WHERE built) - 20))""")
sql("retry_schedule", f"""WITH {LOG}, r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS retry FROM log WHERE outcome IN ('http', 'conn'))
    SELECT user_id, event_id, retry, CASE WHEN retry <= 3 THEN 'failed' ELSE 'dead' END AS state, CASE retry WHEN 1 THEN event_id + 1e0 WHEN 2 THEN event_id + 4e0 WHEN 3 THEN event_id + 15e0 END AS next_retry FROM r""")
sql("breaker", f"""WITH {LOG}, g AS (SELECT outcome, sum((outcome = 'ok')::INT) OVER (ORDER BY ts NULLS FIRST, event_id ROWS UNBOUNDED PRECEDING) AS g FROM log),
    runs AS (SELECT g, count(*) FILTER (outcome = 'conn') AS n FROM g GROUP BY g) SELECT coalesce(max(n), 0)::BIGINT AS max_run, count(*) FILTER (n >= 8) AS openings FROM runs""")
sql("need_select", """WITH l AS (SELECT event_id, user_id, floor(value / 20)::BIGINT AS s, event_id // 500 AS g, event_id / 400e0 AS t FROM events),
    p AS (SELECT *, lag(s) OVER w AS ls, lag(g) OVER w AS lg, lag(t) OVER w AS la FROM l WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    SELECT event_id, ls IS NULL OR ls <> s OR lg <> g OR t - la > 0.5 AS need_select FROM p""")
sql("stale_generation", "SELECT event_id, CASE WHEN event_id % 7 = max(event_id % 7) OVER (PARTITION BY user_id) THEN 'used' ELSE 'queued' END AS result FROM events")
sql("sweep_unused", "SELECT p_partkey AS block FROM part WHERE p_partkey % 3 <> 0 OR NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey // 3 = p_partkey // 3)")
sql("restore_key", f"""WITH {HITS} SELECT id, z, CASE WHEN id % 4 = 0 THEN 'stored_' || id ELSE 'I_m_' || least(z, 7) || '_' || (x >> greatest(z - 7, 0)::INT) || '_' || (y >> greatest(z - 7, 0)::INT) END AS image_key FROM tile_hits""")
sql("fsm_replay", f"""WITH RECURSIVE {LOG}, o AS MATERIALIZED (SELECT user_id AS tile, event_id AS seq, outcome, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM log),
    run AS (SELECT DISTINCT tile, 0::BIGINT AS i, 'queued' AS state, 0::BIGINT AS retries, 0e0 AS due FROM o UNION ALL
        SELECT r.tile, o.i, CASE WHEN r.state = 'dead' THEN 'dead' WHEN outcome = 'ok' THEN 'built' WHEN outcome = 'dead' OR r.retries >= 3 THEN 'dead' ELSE 'failed' END,
            r.retries + (r.state <> 'dead' AND outcome IN ('http', 'conn'))::INT,
            CASE WHEN r.state <> 'dead' AND outcome IN ('http', 'conn') AND r.retries < 3 THEN o.seq + CASE r.retries WHEN 0 THEN 1e0 WHEN 1 THEN 4e0 ELSE 15e0 END ELSE r.due END
        FROM run r JOIN o ON o.tile = r.tile AND o.i = r.i + 1)
    SELECT tile, arg_max(state, i) AS state, arg_max(retries, i) AS retries, arg_max(due, i) AS next_retry FROM run GROUP BY tile""")

sql("breaker_state", f"""WITH RECURSIVE {LOG}, o AS MATERIALIZED (SELECT user_id % 20 AS session, event_id, row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS i,
        CASE WHEN event_id % 29 = 0 THEN 'probe_ok' WHEN event_id % 31 = 0 THEN 'probe_failed' WHEN outcome = 'http' AND event_id % 2 = 0 THEN 'conn' ELSE outcome END AS outcome FROM log),
    run AS (SELECT DISTINCT session, 0::BIGINT AS i, NULL::BIGINT AS event_id, 0::BIGINT AS n, false AS open FROM o UNION ALL
        SELECT o.session, o.i, o.event_id, CASE WHEN outcome IN ('ok', 'probe_ok') THEN 0 ELSE n + (outcome = 'conn')::INT END, outcome <> 'probe_ok' AND (open OR (outcome = 'conn' AND n >= 7)) FROM run r JOIN o ON o.session = r.session AND o.i = r.i + 1)
    SELECT session, event_id, n AS n_failures, open AS is_open FROM run WHERE i > 0""")
sql("ground_ray", f"""WITH {GEO}, s AS (SELECT id, min(i) FILTER ((id + i) % 3 = 0) AS i FROM geo_points, range(0, 4) r(i) WHERE i <= id % 7 GROUP BY id)
    SELECT id, round(CASE WHEN i IS NULL THEN h + 5000 - 3000 ELSE h - i * 10 END, 4) AS ground FROM geo_points JOIN s USING (id)""")
sql("fsm_full", """WITH RECURSIVE o AS MATERIALIZED (SELECT user_id AS tile, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i,
        CASE WHEN event_id % 97 = 0 THEN 'dead' ELSE ['fetch', 'ok', 'built', 'http', 'conn', 'build_failed', 'evict', 'stale', 'stop', 'late', 'graft_drawable', 'graft_done', 'nothing'][event_id * 7 % 13 + 1] END AS outcome FROM events),
    run AS (SELECT DISTINCT tile, 0::BIGINT AS i, 'queued' AS state, 0::BIGINT AS n, 0e0 AS due FROM o UNION ALL
        SELECT r.tile, o.i,
            CASE WHEN state = 'dead' OR outcome = 'dead' THEN 'dead' WHEN outcome IN ('http', 'conn', 'build_failed') THEN CASE WHEN n >= 3 THEN 'dead' ELSE 'failed' END
                WHEN outcome = 'fetch' THEN 'fetching' WHEN outcome = 'ok' THEN 'decoded' WHEN outcome IN ('built', 'graft_done') THEN 'built' WHEN outcome = 'nothing' THEN state ELSE 'queued' END,
            CASE WHEN state = 'dead' THEN n WHEN outcome = 'graft_drawable' THEN 0 ELSE n + (outcome IN ('http', 'conn', 'build_failed'))::INT END,
            CASE WHEN state <> 'dead' AND outcome IN ('http', 'conn', 'build_failed') AND n < 3 THEN seq + [1e0, 4e0, 15e0][n + 1] ELSE due END
        FROM run r JOIN o ON o.tile = r.tile AND o.i = r.i + 1)
    SELECT tile, arg_max(state, i) AS state, arg_max(n, i) AS retries, arg_max(due, i) AS next_retry FROM run GROUP BY tile""")

# Formats: what the samples are made of, by their number
sql("qm_decode", """SELECT '8/' || k % 512 || '/' || k // 512 || '.terrain' AS path, k % 10 = 0 AS damaged, CASE WHEN k % 10 > 0 THEN 0e0 END AS min_h, CASE WHEN k % 10 > 0 THEN k::DOUBLE END AS max_h,
    CASE WHEN k % 10 > 0 THEN 4 END AS n_vertices, CASE WHEN k % 10 > 0 THEN 2 END AS n_triangles, CASE WHEN k % 10 > 0 THEN k / 2e0 END AS geometric_error FROM (SELECT s_suppkey AS k FROM supplier)""")
QM = """qm AS (SELECT k, k % 512 AS x, k // 512 AS y, k % 32767 / 32767e0 * k AS h0 FROM (SELECT s_suppkey AS k FROM supplier) WHERE k % 10 > 0)"""
_qm = local(*ecef("lon", "lat", "h"))
sql("mesh_from_bytes", f"""WITH {FRAME}, {QM}, c AS (SELECT k, x, y, i, {west('8', 'x')} + (i % 2) * (2 * pi() / 512) AS lon, {south('8', 'y')} + (i // 2) * (pi() / 256) AS lat, CASE i WHEN 0 THEN h0 WHEN 3 THEN k ELSE 0e0 END AS h FROM qm, range(4) r(i)),
    p AS (SELECT k, x, y, i, {_qm[0]} AS e, {_qm[1]} AS n, {_qm[2]} AS up FROM c, frame)
    SELECT x, y, 2::BIGINT AS n_triangles, 0.625e0 AS last_v, round(min(up) OVER (PARTITION BY k), 2) AS low_up, i, round(e::FLOAT::DOUBLE, 1) AS e, round(n::FLOAT::DOUBLE, 1) AS n, round(up::FLOAT::DOUBLE, 1) AS up FROM p""")
sql("upsample_mesh", f"""WITH {QM}, g AS (SELECT k, x * 2 AS x, y * 2 + 1 AS y, j * 5 + i AS i, i / 8e0 AS px, 0.5e0 + j / 8e0 AS py, i AS gi, j AS gj, h0 FROM qm, range(5) a(i), range(5) b(j)),
    s AS (SELECT *, CASE WHEN px + py <= 1 THEN h0 * (1 - px - py) ELSE k * (px + py - 1) END AS h FROM g),
    m AS (SELECT *, min(h) OVER (PARTITION BY k) AS lo, max(h) OVER (PARTITION BY k) AS hi FROM s)
    SELECT x, y, round(lo, 4) AS min_h, round(hi, 4) AS max_h, 96::BIGINT AS n_loops, 9::BIGINT AS second_east, i, round_even(gi / 4e0 * 32767, 0)::BIGINT AS u, round_even(gj / 4e0 * 32767, 0)::BIGINT AS v,
        coalesce(round_even((h - lo) / nullif(hi - lo, 0) * 32767, 0), 0)::BIGINT AS h FROM m""")
DOCS = """docs AS (SELECT s_suppkey AS k, 'https://t.example/' || s_suppkey || '/tileset.json' AS url FROM supplier)"""
sql("tileset_parse", f"""WITH {DOCS}, n AS (SELECT url, NULL::VARCHAR AS error, 1::BIGINT AS id, NULL::BIGINT AS parent, 0::BIGINT AS depth, 100e0 AS geometric_error, 'region' AS volume, NULL::VARCHAR AS uri, 10e0 AS moved_x FROM docs WHERE k % 9 > 0
    UNION ALL SELECT url, NULL, 2, 1, 1, 10, 'box', NULL, 10 + k FROM docs WHERE k % 9 > 0
    UNION ALL SELECT url, NULL, 3 + i, 2, 2, 1, 'sphere', k || '_' || i || '.glb', 10 + k FROM docs, range(0, 3) r(i) WHERE k % 9 > 0 AND i < k % 4)
    SELECT url, error, id, parent, depth, geometric_error, 'ADD' AS refine, volume, uri, moved_x FROM n
    UNION ALL SELECT url, 'no root tile', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM docs WHERE k % 9 = 0""")
_b = local("15 + k + p_", "6 + q", "7 + r_")
_s = local("10 + k", "0", "0")
sql("tileset_boxes", f"""WITH {DOCS}, {FRAME}, reg AS (SELECT url, 0.5e0 AS w, 0.25e0 AS s, 0.51e0 AS e, 0.27e0 AS n, 0e0 AS h0, 90e0 AS h1 FROM docs WHERE k % 9 > 0),
    {boxes('reg', 'url', 3, 'w', 's', 'e', 'n', 'h0', 'h1')},
    corners AS (SELECT url, {_b[0]} AS px, {_b[1]} AS py, {_b[2]} AS pz FROM docs, frame, (VALUES (-10), (10)) a(p_), (VALUES (-20), (20)) b(q), (VALUES (-30), (30)) c(r_) WHERE k % 9 > 0),
    balls AS (SELECT url, i, {_s[0]} AS px, {_s[1]} AS py, {_s[2]} AS pz FROM docs, frame, range(0, 3) r(i) WHERE k % 9 > 0 AND i < k % 4)
    SELECT url, 1::BIGINT AS id, {rounded(BOX, 2)} FROM boxed
    UNION ALL SELECT url, 2, round(min(px), 2), round(min(py), 2), round(min(pz), 2), round(max(px), 2), round(max(py), 2), round(max(pz), 2) FROM corners GROUP BY url
    UNION ALL SELECT url, 3 + i, round(px - i, 2), round(py - i, 2), round(pz - i, 2), round(px + i, 2), round(py + i, 2), round(pz + i, 2) FROM balls""")
sql("unwrap_content", """WITH c AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 1 THEN '{"extensions": {"VENDOR_RTC": {"center": [' || s_suppkey || ', 0, 0]}}}' ELSE '{}' END AS chunk FROM supplier),
    m AS (SELECT k, 'c' || k AS url, 20 + (length(chunk) + 3) // 4 * 4 AS n FROM c)
    SELECT url, false AS damaged, i AS part, n AS n_bytes, CASE WHEN k % 2 = 1 THEN k::DOUBLE END AS center_x FROM m, range(0, 2) r(i) WHERE k % 6 < 3 AND (i = 0 OR k % 6 = 2)
    UNION ALL SELECT url, true, NULL, NULL, NULL FROM m WHERE k % 6 > 3""")
sql("resolve_uri_full", """WITH p AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM pages),
    d AS (SELECT page_id, host, coalesce(nullif(regexp_replace(path, '[^/]*$', ''), ''), '/') AS folder FROM p)
    SELECT page_id, host || regexp_replace(folder, '[^/]+/$', '') || 'sub/' || page_id || '.glb?session=a+b&key=k' AS resolved FROM d""")

# Styling
_stops = [(0.0, 0.169, 0.292, 0.152), (0.22, 0.302, 0.410, 0.209), (0.45, 0.557, 0.502, 0.312), (0.68, 0.475, 0.386, 0.284), (0.86, 0.727, 0.696, 0.630), (1.0, 0.937, 0.926, 0.898)]
_rock = (0.412, 0.365, 0.306)
_smooth = lambda t: f"({t} * {t} * (3 - 2 * {t}))"
_tint = lambda c: "CASE " + " ".join(f"WHEN t < {b[0]} THEN {a[c + 1]}e0 + (t - {a[0]}) / ({b[0]}e0 - {a[0]}e0) * ({b[c + 1]}e0 - {a[c + 1]}e0)" for a, b in zip(_stops, _stops[1:])) + f" ELSE {_stops[-1][c + 1]}e0 END"
sql("relief", f"""WITH {GEO}, a AS (SELECT id, round(h + (lon*1000*lon*1000 + lat*1000*lat*1000) / (2 * 6378137.0::DOUBLE), 6) AS e, least(greatest((abs(cos(id)) - 0.7e0) / (0.93e0 - 0.7e0), 0), 1) AS s FROM geo_points),
    b AS (SELECT id, e, 1 - {_smooth('s')} AS steep, least(greatest(e / 4000, 0), 1) AS t, least(greatest((e % 250) / 250 / 0.035e0, 0), 1) AS c FROM a)
    SELECT id, e, {', '.join(f'round((({_tint(i)}) * (1 - steep) + {_rock[i]}e0 * steep) * (0.55e0 + 0.45e0 * {_smooth("c")}), 6) AS {n}' for i, n in enumerate('rgb'))} FROM b""")
sql("cloud_profile", f"""WITH {GEO}, a AS (SELECT id, least(greatest(((lon + 180) / 360 - (0.684e0 - 0.13e0 - 0.045e0)) / 0.09e0, 0), 1) AS b, (lat + 85) / 170 AS t, least(greatest((abs(sin(id)) - 0.72e0) / (1 - 0.72e0), 0), 1) AS f FROM geo_points)
    SELECT id, round({_smooth('b')} * greatest(4 * t * (1 - t), 0) * (1 - {_smooth('f')}) * 0.8e0, 9) AS density FROM a""")

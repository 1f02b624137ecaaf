"""SQL (DuckDB's) for the queries over fields: each states anew, with recursive CTEs, what its query computes.

The blocks below are lists of CTEs, to be joined by commas. The grid of the queries has 12 rows and 24 columns.
"""

from __future__ import annotations

GRID = """g AS MATERIALIZED (SELECT ((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1)::INT AS t, (l_suppkey % 12)::INT AS y,
  (l_partkey % 24)::INT AS x, sum(round(l_extendedprice * 100)::BIGINT)::DOUBLE AS v FROM lineitem GROUP BY 1, 2, 3)"""
VOLUME = """g4 AS MATERIALIZED (SELECT ((year(l_shipdate) - 1995) * 4 + quarter(l_shipdate) - 1)::INT AS t, (l_linenumber % 4)::INT AS z,
  (l_suppkey % 12)::INT AS y, (l_partkey % 24)::INT AS x, sum(round(l_extendedprice * 100)::BIGINT)::DOUBLE AS v FROM lineitem GROUP BY 1, 2, 3, 4)"""
LAT, LON = "(y * 15.0::DOUBLE - 82.5)", "(x * 15.0::DOUBLE + 7.5)"
#: Thickness and depth of the four levels.
LEVELS = """levels AS (SELECT z, depth, coalesce((n - p) / 2, n - depth, depth - p, 0) AS dz FROM (
  SELECT *, lag(depth) OVER (ORDER BY z) AS p, lead(depth) OVER (ORDER BY z) AS n FROM (SELECT i::INT AS z, (i * i * 10.0 + i * 5.0)::DOUBLE AS depth FROM range(4) r(i))))"""


def query(*ctes: str, then: str) -> str:
    return f"WITH RECURSIVE {', '.join(ctes)} {then}"


def hot(q: float) -> str:
    """h: the cells (t, y, x, v) at or over their quantile."""
    return GRID + f", h AS MATERIALIZED (SELECT t, y, x, v FROM (SELECT *, quantile_cont(v, {q}) OVER (PARTITION BY y, x) AS thr FROM g) WHERE v >= thr)"


def hot_volume(q: float = 0.7) -> str:
    """h4: the same of the volume field (t, z, y, x)."""
    return VOLUME + f", h4 AS MATERIALIZED (SELECT t, z, y, x FROM (SELECT *, quantile_cont(v, {q}) OVER (PARTITION BY z, y, x) AS thr FROM g4) WHERE v >= thr)"


EIGHT = "abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1"
FOUR = "abs(a.y - b.y) + abs(a.x - b.x) <= 1"
#: Eight neighbours, also around the edge columns.
AROUND = "abs(a.y - b.y) <= 1 AND (abs(a.x - b.x) <= 1 OR abs(a.x - b.x) = 23)"


def blobs(src: str, to: str, near: str = EIGHT, keys: tuple[str, ...] = ("t",)) -> str:
    """to: the cells (keys, y, x) of src with blob, the least index of the cells that each reaches within its keys."""
    k = ", ".join(keys)
    same = " AND ".join(f"a.{c} = b.{c}" for c in keys)
    onward = " AND ".join(f"r.{c} = e.{c}" for c in keys)
    ak = ", ".join(f"a.{c}" for c in keys)
    rk = ", ".join(f"r.{c}" for c in keys)
    return f"""{to}_e AS MATERIALIZED (SELECT {ak}, a.y * 24 + a.x AS i, b.y * 24 + b.x AS j FROM {src} a JOIN {src} b ON {same} AND {near}),
{to}_r AS (SELECT {k}, i, j FROM {to}_e UNION SELECT {rk}, r.i, e.j FROM {to}_r r JOIN {to}_e e ON {onward} AND r.j = e.i),
{to} AS MATERIALIZED (SELECT {k}, (i // 24)::INT AS y, (i % 24)::INT AS x, min(j)::BIGINT AS blob FROM {to}_r GROUP BY {k}, i)"""


def graph(nodes: str, edges: str, to: str) -> str:
    """to: id and root, the least id that each id of nodes reaches over edges (a, b) in either direction."""
    return f"""{to}_e AS MATERIALIZED (SELECT a, b FROM {edges} UNION SELECT b, a FROM {edges}),
{to}_r(id, root) AS (SELECT id, id FROM {nodes} UNION SELECT r.id, e.b FROM {to}_r r JOIN {to}_e e ON r.root = e.a),
{to} AS MATERIALIZED (SELECT id, min(root) AS root FROM {to}_r GROUP BY id)"""


def neighbours(src: str, to: str, least: float) -> str:
    """to: the cells of blobs src with the label of their event: blobs of neighbouring times of which one shares at
    least that part of its cells with the other."""
    return f"""{to}_n AS (SELECT t * 288 + blob AS id, count(*) AS size FROM {src} GROUP BY 1),
{to}_o AS (SELECT a.t * 288 + a.blob AS a, b.t * 288 + b.blob AS b, count(*) AS n FROM {src} a JOIN {src} b ON b.t = a.t + 1 AND a.y = b.y AND a.x = b.x GROUP BY 1, 2),
{to}_k AS (SELECT o.a, o.b FROM {to}_o o JOIN {to}_n p ON p.id = o.a JOIN {to}_n q ON q.id = o.b WHERE greatest(o.n / p.size, o.n / q.size) >= {least}),
{graph(f'{to}_n', f'{to}_k', f'{to}_g')},
{to} AS MATERIALIZED (SELECT t, y, x, dense_rank() OVER (ORDER BY root)::BIGINT AS label FROM {src} JOIN {to}_g ON id = t * 288 + blob)"""


def tracked(then: str, *more: str) -> str:
    return query(hot(0.9), blobs("h", "blobs"), neighbours("blobs", "labels", 0.3), *more, then=then)


def wrapped(src: str, to: str, closure: bool = False) -> str:
    """to: the cells (t, y, x, label) of src with labels merged across the edge columns: by closure, or (for each label
    of the first column, in ascending order) once; then without gaps."""
    pairs = f"{to}_p AS MATERIALIZED (SELECT DISTINCT a.label AS a, b.label AS b FROM {src} a JOIN {src} b ON a.t = b.t AND a.y = b.y AND a.x = 0 AND b.x = 23)"
    if closure:
        names = f"{to}_i AS (SELECT a AS id FROM {to}_p UNION SELECT b FROM {to}_p), {graph(f'{to}_i', f'{to}_p', f'{to}_c')}, {to}_m AS (SELECT id AS old, root AS new FROM {to}_c)"
    else:
        names = f"""{to}_s AS (SELECT list_sort(list_distinct(list_concat(list(a), list(b)))) AS l, list(a) AS pa, list(b) AS pb, list_sort(list_distinct(list(a))) AS vs FROM {to}_p),
{to}_c AS MATERIALIZED (SELECT l, vs, list_transform(pa, lambda x: list_position(l, x)) AS ia, list_transform(pb, lambda x: list_position(l, x)) AS ib FROM {to}_s WHERE l IS NOT NULL),
{to}_w(k, m) AS (SELECT 1, l FROM {to}_c UNION ALL
  SELECT k + 1, list_transform(m, lambda x: CASE WHEN list_contains(gone, x) THEN v ELSE x END) FROM (
    SELECT k, m, vs[k] AS v, list_transform(list_filter(range(1, len(ia) + 1), lambda q: m[ia[q]] = vs[k]), lambda q: m[ib[q]]) AS gone
    FROM {to}_w, {to}_c WHERE k <= len(vs))),
{to}_m AS (SELECT unnest(l) AS old, unnest(m) AS new FROM {to}_c, (SELECT m FROM {to}_w ORDER BY k DESC LIMIT 1))"""
    return f"""{pairs}, {names},
{to} AS MATERIALIZED (SELECT t, y, x, dense_rank() OVER (ORDER BY coalesce(new, label))::BIGINT AS label FROM {src} LEFT JOIN {to}_m ON old = label)"""


def objects(src: str, to: str) -> str:
    """to: the cells (t, y, x) of src with numbers of their blobs."""
    return f"{blobs(src, f'{to}_b')}, {to} AS MATERIALIZED (SELECT t, y, x, dense_rank() OVER (ORDER BY t, blob)::BIGINT AS label FROM {to}_b)"


def large(src: str, to: str, q: float, floor: float) -> str:
    """to: the cells of src (t, y, x, label) in labels as large as the floor and the quantile; to_a: areas, to_l: least."""
    return f"""{to}_a AS MATERIALIZED (SELECT label, count(*) AS area FROM {src} GROUP BY label),
{to}_l AS MATERIALIZED (SELECT greatest({float(floor)}::DOUBLE, quantile_cont(area::DOUBLE, {q})) AS least, count(*) AS n FROM {to}_a),
{to} AS MATERIALIZED (SELECT t, y, x FROM {src} JOIN {to}_a USING (label), {to}_l WHERE area >= least)"""


def depths(src: str, to: str) -> str:
    """to: the cells (t, z, y, x) of src with blob: objects of eight neighbours in a level and of faces above and below."""
    return f"""{blobs(src, f'{to}_s', keys=('t', 'z'))},
{to}_i AS MATERIALIZED (SELECT *, t * 1152 + z * 288 + blob AS id FROM {to}_s),
{to}_f AS (SELECT DISTINCT a.id AS a, b.id AS b FROM {to}_i a JOIN {to}_i b ON a.t = b.t AND a.y = b.y AND a.x = b.x AND b.z = a.z + 1),
{to}_n AS (SELECT DISTINCT id FROM {to}_i), {graph(f'{to}_n', f'{to}_f', f'{to}_g')},
{to} AS MATERIALIZED (SELECT t, z, y, x, (root % 1152)::BIGINT AS blob FROM {to}_i JOIN {to}_g USING (id))"""


def large_by_depth(src: str, to: str, q: float, floor: float) -> str:
    """to: the cells of src in four-connected slice objects as large as their level's floor and quantile."""
    return f"""{blobs(src, f'{to}_b', FOUR, ('t', 'z'))},
{to}_a AS (SELECT t, z, blob, count(*) AS area FROM {to}_b GROUP BY ALL),
{to}_l AS (SELECT z, greatest(quantile_cont(area::DOUBLE, {q}), {float(floor)}::DOUBLE) AS least FROM {to}_a GROUP BY z),
{to} AS MATERIALIZED (SELECT t, z, y, x FROM {to}_b JOIN {to}_a USING (t, z, blob) JOIN {to}_l USING (z) WHERE area >= least)"""


def without_smallest(src: str, to: str, frac: float) -> str:
    """to: the cells of src (t, z, y, x, label) without the smallest labels; to_k: label, vol, rank."""
    return f"""{to}_v AS (SELECT label, count(*) AS vol FROM {src} GROUP BY label),
{to}_k AS (SELECT label, vol, row_number() OVER (ORDER BY vol, label) AS rank FROM {to}_v),
{to} AS MATERIALIZED (SELECT s.* FROM {src} s JOIN {to}_k USING (label) WHERE rank > (SELECT floor(count(*) * {frac}) FROM {to}_k))"""


def lineage(src: str, to: str, least: float, alpha: float | None = None) -> str:
    """to: t, label and event of each object of src (t, z, y, x, label). With alpha, volumes are those of `levels`."""
    vol = "sum(10000.0::DOUBLE * (dz / 100))" if alpha is not None else "NULL::DOUBLE"
    join = "JOIN levels USING (z)" if alpha is not None else ""
    cells = "greatest(sh.n / o.n, sh.n / ev.n)"
    score = cells if alpha is None else f"{alpha} * {cells} + {1 - alpha} * greatest(sh.w / o.w, sh.w / ev.w)"
    return f"""{to}_o AS MATERIALIZED (SELECT t, label, count(*)::DOUBLE AS n, {vol} AS w FROM {src} {join} GROUP BY t, label),
{to}_p AS MATERIALIZED (SELECT b.t, b.label, a.label AS prev, count(*)::DOUBLE AS n, {vol} AS w FROM {src} b JOIN {src} a ON b.t = a.t + 1 AND a.z = b.z AND a.y = b.y AND a.x = b.x
  {join.replace('USING (z)', 'ON levels.z = b.z')} GROUP BY 1, 2, 3),
{to}_f(t, label, event, next) AS (
  SELECT 0, label, event, (SELECT coalesce(max(label), 0) + 1 FROM {to}_o WHERE t = 0) FROM (
    SELECT label, label AS event FROM {to}_o WHERE t = 0 UNION ALL SELECT NULL, NULL)
  UNION ALL
  SELECT t, label, event, max(greatest(next, coalesce(event, 0) + 1)) OVER () FROM (
    SELECT c.t, c.label, CASE WHEN c.label IS NULL THEN NULL WHEN e IS NOT NULL THEN e
      ELSE next - 1 + row_number() OVER (PARTITION BY e IS NULL AND c.label IS NOT NULL ORDER BY c.label) END AS event, next
    FROM (SELECT t, label FROM {to}_o WHERE t = (SELECT max(t) + 1 FROM {to}_f) UNION ALL SELECT max(t) + 1, NULL FROM {to}_f) c
    CROSS JOIN (SELECT max(next) AS next FROM {to}_f) LEFT JOIN (
      SELECT sh.label, min(sh.event) AS e FROM (
        SELECT p.label, f.event, sum(p.n) AS n, sum(p.w) AS w FROM {to}_p p JOIN {to}_f f ON p.t = f.t + 1 AND p.prev = f.label GROUP BY 1, 2) sh
      JOIN (SELECT f.event, sum(o.n) AS n, sum(o.w) AS w FROM {to}_o o JOIN {to}_f f ON o.t = f.t AND o.label = f.label GROUP BY 1) ev ON ev.event = sh.event
      JOIN {to}_o o ON o.label = sh.label AND o.t = (SELECT max(t) + 1 FROM {to}_f)
      WHERE {score} > {least} GROUP BY sh.label) fit ON fit.label = c.label
    WHERE c.t <= (SELECT max(t) FROM {to}_o))),
{to} AS MATERIALIZED (SELECT t::INT AS t, label, event::BIGINT AS event FROM {to}_f WHERE label IS NOT NULL)"""


def slice_wrap(src: str, to: str) -> str:
    """to: the cells (t, z, y, x, label) of src, in each slice of which, by y, the larger label of two that face each
    other becomes the smaller."""
    return f"""{to}_p AS (SELECT a.t, a.z, a.y, greatest(a.label, b.label) AS old, least(a.label, b.label) AS new FROM {src} a
  JOIN {src} b ON a.t = b.t AND a.z = b.z AND a.y = b.y AND a.x = 0 AND b.x = 23 WHERE a.label <> b.label),
{to}_s AS MATERIALIZED (SELECT t, z, list(old ORDER BY y) AS o, list(new ORDER BY y) AS n, list_sort(list_distinct(list_concat(list(old), list(new)))) AS l FROM {to}_p GROUP BY t, z),
{to}_w(t, z, k, m) AS (SELECT t, z, 1, l FROM {to}_s UNION ALL
  SELECT w.t, w.z, k + 1, list_transform(m, lambda x: CASE WHEN x = o[k] THEN n[k] ELSE x END) FROM {to}_w w JOIN {to}_s USING (t, z) WHERE k <= len(o)),
{to}_m AS (SELECT t, z, unnest(l) AS old, unnest(m) AS new FROM {to}_w JOIN {to}_s USING (t, z) WHERE k = len(o) + 1),
{to} AS MATERIALIZED (SELECT c.t, c.z, c.y, c.x, coalesce(m.new, c.label) AS label FROM {src} c LEFT JOIN {to}_m m ON m.t = c.t AND m.z = c.z AND m.old = c.label)"""


def disk(radius: int, strict: bool) -> str:
    """Offsets (dy, dx) within the radius; strict leaves out the rim."""
    sign = "<" if strict else "<="
    return f"(SELECT dy, dx FROM range({-radius}, {radius + 1}) a(dy), range({-radius}, {radius + 1}) b(dx) WHERE dy * dy + dx * dx {sign} {radius * radius})"


def close_open(src: str, to: str, radius: int, strict: bool, pad: int, keys: tuple[str, ...] = ("t",)) -> str:
    """to: the cells (keys, y, x) of src after closing and opening on a margin of cyclic copies."""
    k, d = ", ".join(keys), disk(radius, strict)
    inside = f"BETWEEN {-pad} AND {{}}"
    parts = [f"""{to}_w AS (SELECT {k}, y + 12 * i AS y, x + 24 * j AS x FROM {src}, range(-1, 2) a(i), range(-1, 2) b(j)
  WHERE y + 12 * i {inside.format(11 + pad)} AND x + 24 * j {inside.format(23 + pad)})"""]  # fmt: skip
    last = f"{to}_w"
    for n, grow in enumerate((True, False, False, True)):
        moved = f"SELECT {k}, y + dy AS y, x + dx AS x FROM {last}, {d} WHERE y + dy {inside.format(11 + pad)} AND x + dx {inside.format(23 + pad)}"
        parts.append(f"{to}_{n} AS (SELECT {k}, y, x FROM ({moved}) GROUP BY ALL" + ("" if grow else f" HAVING count(*) = (SELECT count(*) FROM {d})") + ")")
        last = f"{to}_{n}"
    parts.append(f"{to} AS MATERIALIZED (SELECT {k}, y::INT AS y, x::INT AS x FROM {last} WHERE y BETWEEN 0 AND 11 AND x BETWEEN 0 AND 23)")
    return ", ".join(parts)


#: Cells over zero of the field less 3 million, where the queries' mask is valid.
POSITIVE = "p AS MATERIALIZED (SELECT t, y, x FROM g WHERE v - 3e6 > 0 AND (y * 7 + x) % 11 <> 0)"
SURFACE_TRACKER = (
    GRID, POSITIVE, objects("p", "o"), wrapped("o", "ow"), large("ow", "f", 0.25, 3), blobs("f", "fb"), neighbours("fb", "e", 0.5), wrapped("e", "events"),
)


def volume_tracker(least: float, alpha: float | None) -> tuple[str, ...]:
    return (
        hot_volume(), LEVELS, close_open("h4", "c", 1, False, 1, ("t", "z")), blobs("c", "c2", FOUR, ("t", "z")), large_by_depth("c", "k", 0.25, 2), depths("k", "d"),
        "l3 AS MATERIALIZED (SELECT t, z, y, x, dense_rank() OVER (PARTITION BY t ORDER BY blob)::BIGINT AS label FROM d)",
        without_smallest("l3", "l4", 0.25), lineage("l4", "names", least, alpha),
        "tracked AS (SELECT l4.t, z, y, x, event FROM l4 JOIN names USING (t, label))",
    )


def centres(src: str, to: str, keys: str, weight: str = "1.0::DOUBLE") -> str:
    """to: keys, lat, lon: the centre of mass of src (keys, y, x and more) for each of the keys."""
    return f"""{to}_c AS (SELECT {keys}, x, sum({weight}) AS s, sum({weight} * y) AS sy FROM {src} GROUP BY ALL),
{to}_k AS (SELECT DISTINCT {keys} FROM {src}),
{to}_j AS (SELECT {keys}, arg_min(x, (coalesce(s, 0), -x)) AS low FROM (SELECT * FROM {to}_k, (SELECT i::INT AS x FROM range(24) r(i))) LEFT JOIN {to}_c USING ({keys}, x) GROUP BY ALL),
{to} AS MATERIALIZED (SELECT {keys}, cy * 15.0::DOUBLE - 82.5 AS lat, ((cx - shift + 48) % 24) * 15.0::DOUBLE + 7.5 AS lon FROM (
  SELECT {keys}, any_value(23 - low) AS shift, round_even(sum(sy) / sum(s), 0)::INT AS cy, round_even(sum(s * ((x + 23 - low) % 24)) / sum(s), 0)::INT AS cx
  FROM {to}_c JOIN {to}_j USING ({keys}) GROUP BY {keys}))"""


def km(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    h = f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)"
    return f"2 * 6371.0088 * asin(sqrt(least(1.0, {h}) + 0 * ({h})))"  # least() alone would skip NULL


def moved(src: str, to: str) -> str:
    """to: the path src (label, t, lat, lon) with km to the next place."""
    return f"{to} AS (SELECT label, t, lat, lon, {km('lat', 'lon', 'lat2', 'lon2')} AS km FROM (SELECT *, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM {src} WINDOW w AS (PARTITION BY label ORDER BY t)))"


EXTENTS = f"a AS MATERIALIZED (SELECT label, t, sum(cos(radians({LAT}))) * 110.574 * 111.320 AS s FROM labels GROUP BY label, t)"
WHOLE = "w AS (SELECT label, max(s) AS smax, avg(s) AS smean, sum(s) AS ssum FROM a GROUP BY label)"
DEFORMATION = f"""b AS (SELECT *, lead(t) OVER n AS tn, lead(s) OVER n AS sn FROM a WINDOW n AS (PARTITION BY label ORDER BY t)),
i AS (SELECT b.label, b.t, sum(cos(radians(l.y * 15.0::DOUBLE - 82.5))) * 110.574 * 111.320 AS c FROM b JOIN labels l ON l.label = b.label AND l.t = b.t
  JOIN labels m ON m.label = b.label AND m.t = b.tn AND m.y = l.y AND m.x = l.x GROUP BY b.label, b.t),
d AS (SELECT b.label, b.t, coalesce(c, 0) / (s + sn) AS x FROM b LEFT JOIN i USING (label, t) WHERE tn IS NOT NULL)"""
#: Level lines: in each square of four cells, the pieces between the middles of its sides where cell and not-cell meet;
#: highs that touch by a corner are apart. Places are doubled. Lines that end at the border are closed by a chord.
OUTLINES = f"""o1 AS MATERIALIZED (SELECT label, t, y, x, 1 AS v FROM labels),
sq AS (SELECT DISTINCT label, t, (y - dy)::INT AS r, (x - dx)::INT AS c FROM o1, range(2) p(dy), range(2) q(dx) WHERE y - dy BETWEEN 0 AND 10 AND x - dx BETWEEN 0 AND 22),
co AS (SELECT s.label, s.t, s.r, s.c, coalesce(a.v, 0) AS ul, coalesce(b.v, 0) AS ur, coalesce(d.v, 0) AS ll, coalesce(e.v, 0) AS lr FROM sq s
  LEFT JOIN o1 a ON (a.label, a.t, a.y, a.x) = (s.label, s.t, s.r, s.c) LEFT JOIN o1 b ON (b.label, b.t, b.y, b.x) = (s.label, s.t, s.r, s.c + 1)
  LEFT JOIN o1 d ON (d.label, d.t, d.y, d.x) = (s.label, s.t, s.r + 1, s.c) LEFT JOIN o1 e ON (e.label, e.t, e.y, e.x) = (s.label, s.t, s.r + 1, s.c + 1)),
sides AS (SELECT label, t, r, c, ul, ur, ll, lr, ul + lr = 2 AND ur + ll = 0 OR ur + ll = 2 AND ul + lr = 0 AS saddle, unnest([
  {{'k': 'T', 'on': ul <> ur, 'y': 2 * r, 'x': 2 * c + 1}}, {{'k': 'R', 'on': ur <> lr, 'y': 2 * r + 1, 'x': 2 * c + 2}},
  {{'k': 'B', 'on': ll <> lr, 'y': 2 * r + 2, 'x': 2 * c + 1}}, {{'k': 'L', 'on': ul <> ll, 'y': 2 * r + 1, 'x': 2 * c}}]) AS s FROM co),
seg AS MATERIALIZED (SELECT a.label, a.t, a.s.y AS y1, a.s.x AS x1, b.s.y AS y2, b.s.x AS x2 FROM sides a JOIN sides b
  ON a.label = b.label AND a.t = b.t AND a.r = b.r AND a.c = b.c AND a.s.on AND b.s.on AND a.s.k <> b.s.k
  AND (NOT a.saddle OR (a.s.k || b.s.k) IN ('TL', 'LT', 'BR', 'RB') AND a.ul = 1 OR (a.s.k || b.s.k) IN ('TR', 'RT', 'BL', 'LB') AND a.ur = 1)),
deg AS (SELECT label, t, y1 AS y, x1 AS x FROM seg GROUP BY ALL HAVING count(*) = 1),
trail(label, t, y0, x0, py, px, y, x) AS (SELECT label, t, y, x, -9, -9, y, x FROM deg UNION ALL
  SELECT r.label, r.t, r.y0, r.x0, r.y, r.x, s.y2, s.x2 FROM trail r JOIN seg s ON s.label = r.label AND s.t = r.t AND s.y1 = r.y AND s.x1 = r.x AND (s.y2, s.x2) <> (r.py, r.px)),
chord AS (SELECT r.label, r.t, r.y0 AS y1, r.x0 AS x1, r.y AS y2, r.x AS x2 FROM trail r JOIN deg ON deg.label = r.label AND deg.t = r.t AND deg.y = r.y AND deg.x = r.x WHERE (r.y, r.x) <> (r.y0, r.x0)),
peri AS (SELECT label, t, sum(km) / 2 AS perimeter FROM (SELECT label, t, {km('la', 'lo', 'lb', 'lp')} AS km FROM (
  SELECT label, t, (y1 // 2) * 15.0::DOUBLE - 82.5 AS la, (x1 // 2) * 15.0::DOUBLE + 7.5 AS lo, (y2 // 2) * 15.0::DOUBLE - 82.5 AS lb, (x2 // 2) * 15.0::DOUBLE + 7.5 AS lp
  FROM (SELECT * FROM seg UNION ALL SELECT * FROM chord))) GROUP BY label, t),
mid AS MATERIALIZED (SELECT DISTINCT label, t, (2 * y + dy)::INT AS y, (2 * x + dx)::INT AS x FROM labels, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) m(dy, dx)),
ends AS (SELECT label, t, y, min(x) AS x FROM mid GROUP BY ALL UNION SELECT label, t, y, max(x) FROM mid GROUP BY ALL),
edge AS (SELECT p.label, p.t, p.y AS py, p.x AS px, q.y AS qy, q.x AS qx FROM ends p JOIN ends q ON p.label = q.label AND p.t = q.t AND (p.y, p.x) <> (q.y, q.x)
  JOIN ends z ON z.label = p.label AND z.t = p.t GROUP BY ALL HAVING min((q.y - p.y) * (z.x - p.x) - (q.x - p.x) * (z.y - p.y)) >= 0),
box AS (SELECT label, t, unnest(range(min(y), max(y) + 1)) AS y, min(x) AS x0, max(x) AS x1 FROM labels GROUP BY label, t),
cell AS (SELECT label, t, y, unnest(range(x0, x1 + 1)) AS x FROM box),
hull AS (SELECT label, t, count(*) AS n FROM (SELECT c.label, c.t, c.y, c.x FROM cell c JOIN edge e USING (label, t) GROUP BY ALL
  HAVING min((e.qy - e.py) * (2 * c.x - e.px) - (e.qx - e.px) * (2 * c.y - e.py)) >= 0) GROUP BY label, t),
size AS (SELECT label, t, count(*) AS n FROM labels GROUP BY label, t)"""


#: Basis and normal equations of the harmonic fit: six functions of time, their products, and the inverse of these by
#: elimination on rows of (6 + 6) numbers.
def harmonic() -> str:
    step = """SELECT k + 1, list_transform(range(1, 7), lambda r: CASE WHEN r = k + 1 THEN top ELSE
      list_transform(range(1, 13), lambda c: m[r][c] - m[r][k + 1] * top[c]) END) FROM (
      SELECT k, m, list_transform(m[k + 1], lambda c: c / m[k + 1][k + 1]) AS top FROM inv WHERE k < 6)"""
    return f"""years AS (SELECT t::INT AS t, 1995 + t // 12 + (t % 12 + 1) / 12 AS u FROM range(84) r(t)),
b AS MATERIALIZED (SELECT t, [1.0::DOUBLE, u - (SELECT avg(u) FROM years), sin(2 * pi() * u), cos(2 * pi() * u), sin(4 * pi() * u), cos(4 * pi() * u)] AS m FROM years),
prod AS (SELECT i, j, sum(m[i] * m[j]) AS s FROM b, range(1, 7) p(i), range(1, 7) q(j) GROUP BY i, j),
inv(k, m) AS (SELECT 0, (SELECT list(row ORDER BY i) FROM (SELECT i, list_concat(list(s ORDER BY j), list_transform(range(1, 7), lambda c: CASE WHEN c = i THEN 1.0::DOUBLE ELSE 0.0 END)) AS row
  FROM prod GROUP BY i)) UNION ALL {step}),
n AS (SELECT m FROM inv WHERE k = 6),
f AS MATERIALIZED (SELECT a.t, c.y, c.x, coalesce(g.v, 0.0) AS v FROM range(84) a(t), (SELECT i // 24 AS y, i % 24 AS x FROM range(288) r(i)) c
  LEFT JOIN g ON g.t = a.t AND g.y = c.y AND g.x = c.x),
rhs AS (SELECT y, x, {', '.join(f'sum(m[{k}] * v) AS r{k}' for k in range(1, 7))} FROM f JOIN b USING (t) GROUP BY y, x),
fit AS (SELECT y, x, {', '.join('(' + ' + '.join(f'm[{k}][{6 + j}] * r{j}' for j in range(1, 7)) + f') AS b{k}' for k in range(1, 7))} FROM rhs, n),
parts AS MATERIALIZED (SELECT t, y, x, v, b1 AS mean, m[2] * b2 AS trend, m[3] * b3 + m[4] * b4 + m[5] * b5 + m[6] * b6 AS seas,
  v - (b1 + m[2] * b2 + m[3] * b3 + m[4] * b4 + m[5] * b5 + m[6] * b6) AS anom FROM f JOIN b USING (t) JOIN fit USING (y, x))"""


def member_names() -> str:
    """names: file names of two members, historical and future decades."""
    parts = []
    for prefix in ("b.e21.BHISTcmip6.f09.001.pop.h", "b.e21.BSSP370smbb.f09.002.pop.h"):
        for first, decades, last in ((1850, 16, "201001-201412"), (2015, 8, "209501-210012")):
            parts.append(f"SELECT '{prefix}.TEMP.' || ({first} + 10 * i) || '01-' || ({first} + 10 * i + 9) || '12.nc' AS name FROM range({decades}) r(i) UNION ALL SELECT '{prefix}.TEMP.{last}.nc'")
    return f"names AS ({' UNION ALL '.join(parts)})"


MEMBERS = f"""{member_names()}, members AS (SELECT DISTINCT CASE WHEN name LIKE 'b.e21.BHIST%' THEN 'historical' ELSE 'future' END AS scenario,
  array_to_string(string_split(name, '.')[:-4], '.') AS prefix FROM names)"""

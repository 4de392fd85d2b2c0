"""DuckDB twins of the registered queries."""

from __future__ import annotations

from tessella.queries import FIXTURES, POLYGONS, WALKS

_IJ, _AB = "STRUCT(i BIGINT, j BIGINT)[]", "STRUCT(a BIGINT, b BIGINT)[]"
_TEXT = "array_to_string(list_transform({0}, lambda zz: '(' || zz.a || ', ' || zz.b || ') , '), '')"
_POSITIONS = "array_to_string(list_transform({0}, lambda zz: zz.i || '-' || zz.j), ' ')"


def _values(graphs: dict) -> str:
    """faces(g, fc, f) of inline graphs."""
    return "SELECT * FROM (VALUES " + ", ".join(f"('{g}', {k}, {list(f)}::BIGINT[])" for g, faces in graphs.items() for k, f in enumerate(faces)) + ") v(g, fc, f)"


_NATIONS = """SELECT CAST(n_regionkey AS VARCHAR) AS g, k AS fc, list(CAST(n_nationkey AS BIGINT) ORDER BY n_nationkey) AS f
FROM nation, unnest(range({copies})) AS u(k) GROUP BY n_regionkey, k"""
_SUPPLIERS = """SELECT CAST(s_nationkey AS VARCHAR) AS g, k AS fc, list(CAST(s_suppkey AS BIGINT) ORDER BY s_suppkey) AS f
FROM supplier, unnest(range(2)) AS u(k) GROUP BY s_nationkey, k"""
_POLYGON = "SELECT CAST(n AS VARCHAR) AS g, 0 AS fc, range(n) AS f FROM (VALUES {0}) v(n)"

#: All triangulations by positions (p, sorted) and by vertices (c, sorted) of faces(g, fc, f), one open interval a step.
_TRI = f"""bnd AS (SELECT g, list({{'a': a, 'b': b}}) AS present FROM (
  SELECT DISTINCT g, least(f[i + 1], f[(i + 1) % len(f) + 1]) AS a, greatest(f[i + 1], f[(i + 1) % len(f) + 1]) AS b FROM faces, unnest(range(len(f))) AS u(i)) GROUP BY g),
st(g, fc, f, op, made) AS (
  SELECT g, fc, f, CASE WHEN len(f) >= 3 THEN [{{'i': CAST(0 AS BIGINT), 'j': CAST(len(f) - 1 AS BIGINT)}}] ELSE CAST([] AS {_IJ}) END, CAST([] AS {_IJ}) FROM faces
  UNION ALL
  SELECT g, fc, f, list_concat(new, op[2:]), list_concat(made, new) FROM (
    SELECT g, fc, f, op, made, list_filter([{{'i': op[1].i, 'j': k}}, {{'i': k, 'j': op[1].j}}], lambda x: x.j - x.i >= 2) AS new
    FROM st, unnest(range(op[1].i + 1, op[1].j)) AS u(k) WHERE len(op) > 0)),
tri AS (SELECT g, fc, f, list_sort(made) AS p, list_sort(list_transform(made, lambda zz: {{'a': least(f[zz.i + 1], f[zz.j + 1]), 'b': greatest(f[zz.i + 1], f[zz.j + 1])}})) AS c
  FROM st WHERE len(op) = 0)"""
#: Rows of whole graphs: faces joined in order, and the validity filter.
_ROWS = f"""size AS (SELECT g, max(fc) + 1 AS n FROM faces GROUP BY g),
whole(g, k, c) AS (
  SELECT g, CAST(0 AS BIGINT), CAST([] AS {_AB}) FROM size
  UNION ALL
  SELECT w.g, w.k + 1, list_concat(w.c, t.c) FROM whole w JOIN tri t ON t.g = w.g AND t.fc = w.k WHERE NOT list_has_any(w.c, t.c)),
rows AS (SELECT w.g, w.c FROM whole w JOIN size s ON s.g = w.g AND s.n = w.k JOIN bnd b ON b.g = w.g
  WHERE NOT list_has_any(w.c, b.present) AND len(list_filter(w.c, lambda x: x.a = x.b)) = 0 AND len(list_distinct(w.c)) = len(w.c))"""


def _with(faces: str, *parts: str) -> str:
    return f"WITH RECURSIVE faces AS ({faces}), " + ",\n".join(parts)


def _graph_rows(faces: str) -> str:
    return _with(faces, _TRI, _ROWS) + f"\nSELECT g AS graph_id, {_TEXT.format('c')} AS row FROM rows"


#: Third corners of every chord of the polygon triangulations.
_APEX = """q AS (SELECT len(f) AS n, p, row_number() OVER () AS id FROM tri),
sides AS (SELECT id, n, p, list_concat(p, list_concat(list_transform(range(n - 1), lambda i: {'i': CAST(i AS BIGINT), 'j': CAST(i + 1 AS BIGINT)}), [{'i': CAST(0 AS BIGINT), 'j': CAST(n - 1 AS BIGINT)}])) AS e FROM q),
corner AS (SELECT id, n, p, x.i AS i, x.j AS j, k FROM (SELECT id, n, p, e, unnest(p) AS x FROM sides), unnest(range(n)) AS u(k)
  WHERE k <> x.i AND k <> x.j AND list_contains(e, {'i': least(x.i, k), 'j': greatest(x.i, k)}) AND list_contains(e, {'i': least(x.j, k), 'j': greatest(x.j, k)})),
apex AS (SELECT id, n, p, i, j, max(k) FILTER (k > i AND k < j) AS ki, max(k) FILTER (k < i OR k > j) AS ko FROM corner GROUP BY id, n, p, i, j),
flip AS (SELECT *, list_sort(list_concat(list_filter(p, lambda zz: zz.i <> i OR zz.j <> j), [{'i': least(ki, ko), 'j': greatest(ki, ko)}])) AS nb FROM apex),
blk AS (SELECT q.id, q.n, q.p, max(a.i) FILTER (a.i > 0 AND a.ko = 0) AS b FROM q LEFT JOIN apex a ON a.id = q.id GROUP BY q.id, q.n, q.p)"""


def _flips(sizes: str, select: str) -> str:
    return _with(_POLYGON.format(sizes), _TRI, _APEX) + "\n" + select


def _safe(high: bool) -> str:
    start = "len(f) - 1, 1" if high else "0, len(f) - 2"
    ds, de = (-1, 1) if high else (1, -1)
    return f"""WITH RECURSIVE faces AS ({_NATIONS.format(copies=1)}),
a AS (SELECT g, f, step, list_transform(range(len(f) - step), lambda i: {{'a': least(f[i + 1], f[i + 1 + step]), 'b': greatest(f[i + 1], f[i + 1 + step])}}) AS present FROM faces, (VALUES (2), (3)) v(step)),
w(g, f, step, present, s, e, t) AS (SELECT g, f, step, present, {start}, 0 FROM a
  UNION ALL SELECT g, f, step, present, CASE WHEN m THEN s + {ds} ELSE s END, CASE WHEN m THEN e ELSE e + {de} END, t + 1
  FROM (SELECT *, list_contains(present, {{'a': least(f[s + 1], f[e + 1]), 'b': greatest(f[s + 1], f[e + 1])}}) AS m FROM w WHERE t < len(f) - 3))
SELECT g AS graph_id, step, CAST(s AS INTEGER) AS root FROM w WHERE t = greatest(len(f) - 3, 0)"""


_WALK_BAGS = _with(_values(WALKS), _TRI, _ROWS) + f""",
r AS (SELECT g AS graph_id, {_TEXT.format('c')} AS row FROM rows),
n0 AS (SELECT graph_id, row, count(*) AS c FROM r GROUP BY graph_id, row),
n AS (SELECT graph_id, row, c, row = min(row) OVER (PARTITION BY graph_id) AS least FROM n0),
m AS (SELECT graph_id, row, c - CASE WHEN least AND graph_id = 'path5' THEN 1 ELSE 0 END AS l, c - CASE WHEN least AND graph_id = 'star' THEN 1 ELSE 0 END AS r FROM n)"""

_STATS = "round(avg({0}), 6) AS mean, round(median({0}), 6) AS median, round(min({0}), 6) AS min, round(max({0}), 6) AS max, round(coalesce(stddev_samp({0}), 0), 6) AS stddev"
_TRACE = """WITH t AS (SELECT user_id, event_id, ts, date_diff('microsecond', min(ts) OVER (PARTITION BY user_id), ts) AS elapsed FROM events),
s AS (SELECT user_id, event_id, row_number() OVER w AS n, elapsed, elapsed - coalesce(lag(elapsed) OVER w, 0) AS incremental FROM t WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
c AS (SELECT *, CAST(sum(incremental) OVER (PARTITION BY user_id ORDER BY n) AS BIGINT) AS running FROM s)"""
_DAYS = "WITH d AS (SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, avg(o_totalprice) AS mean, coalesce(stddev_samp(o_totalprice), 0) AS dev FROM orders GROUP BY 1)"
_TOTALS = "o AS (SELECT sum(l_quantity) AS x, sum(l_extendedprice) AS y FROM lineitem GROUP BY l_orderkey)"
_LAW = "law AS (SELECT regr_slope(log10(y), log10(x)) AS slope, regr_intercept(log10(y), log10(x)) AS intercept FROM o WHERE x > 0 AND y > 0)"
_CYCLES = "(4, 2), (5, 10), (6, 68), (7, 546), (8, 4872), (9, 46782), (10, 474180), (11, 5010456), (12, 54721224), (13, 613912182), (14, 7042779996), (15, 82329308040)"
#: Results, checks, successful checks, invalid traversals.
_COUNTERS = "('path3', 1, 1, 0, 0), ('path4', 2, 6, 2, 1), ('path5', 12, 35, 16, 5), ('path6', 100, 250, 132, 33), ('star', 5, 43, 13, 9)"
_SIZE = "n_chars * CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 1000 ELSE 1000000 END"
_SIZES = ", ".join(f"({n})" for n in POLYGONS)


def _bytes_text(unit: str, name: str) -> str:
    return f"printf('%.2f {name}', round_even(x / {unit}, 2))"


ORACLES: dict[str, str] = {
    "face_edges": f"WITH faces AS ({_NATIONS.format(copies=1)}) SELECT g AS graph_id, CAST(i AS INTEGER) AS pos, CAST(least(f[i + 1], f[(i + 1) % len(f) + 1]) AS INTEGER) AS a, CAST(greatest(f[i + 1], f[(i + 1) % len(f) + 1]) AS INTEGER) AS b FROM faces, unnest(range(len(f))) AS u(i)",
    "boundary_edges": f"WITH faces AS ({_SUPPLIERS}) SELECT DISTINCT g AS graph_id, CAST(least(f[i + 1], f[(i + 1) % len(f) + 1]) AS INTEGER) AS a, CAST(greatest(f[i + 1], f[(i + 1) % len(f) + 1]) AS INTEGER) AS b FROM faces, unnest(range(len(f))) AS u(i)",
    "boundary_multiplicity": f"WITH faces AS ({_SUPPLIERS}) SELECT g AS graph_id, CAST(least(f[i + 1], f[(i + 1) % len(f) + 1]) AS INTEGER) AS a, CAST(greatest(f[i + 1], f[(i + 1) % len(f) + 1]) AS INTEGER) AS b, count(*) AS mult FROM faces, unnest(range(len(f))) AS u(i) GROUP BY ALL",
    "face_profile": f"""WITH faces AS ({_SUPPLIERS}), e AS (SELECT g, count(DISTINCT (least(f[i + 1], f[(i + 1) % len(f) + 1]), greatest(f[i + 1], f[(i + 1) % len(f) + 1]))) AS n_edges FROM faces, unnest(range(len(f))) AS u(i) GROUP BY g),
v AS (SELECT g, count(DISTINCT x) AS n_vertices FROM (SELECT g, unnest(f) AS x FROM faces) GROUP BY g), c AS (SELECT g, count(*) AS n_faces, max(len(f)) AS largest_face FROM faces GROUP BY g)
SELECT g AS graph_id, CAST(n_faces AS INTEGER) AS n_faces, CAST(n_vertices AS INTEGER) AS n_vertices, CAST(n_edges AS INTEGER) AS n_edges, CAST(largest_face AS INTEGER) AS largest_face, CAST(n_vertices - n_edges + n_faces AS INTEGER) AS euler, true AS usable FROM c JOIN v USING (g) JOIN e USING (g)""",
    "rotated_faces": f"WITH faces AS ({_NATIONS.format(copies=1)}) SELECT g AS graph_id, CAST(r AS INTEGER) AS root, array_to_string(list_concat(f[r + 1:], f[:r]), ' ') AS face FROM faces, unnest(range(len(f))) AS u(r)",
    "safe_root_high": _safe(True),
    "safe_root_low": _safe(False),
    "root_fan": f"SELECT CAST(n AS INTEGER) AS n, array_to_string(list_transform(range(2, n - 1), lambda j: '0-' || j), ' ') AS fan FROM (VALUES {_SIZES}) v(n)",
    "parse_graph_text": "SELECT * FROM (VALUES ('two', 0, '1 2 3 4'), ('two', 1, '1 2 3 4'), ('extra', 0, '7 8 9')) v(graph_id, face_id, face)",
    "face_triangulations": _with(_NATIONS.format(copies=1), _TRI) + f"\nSELECT g AS graph_id, {_TEXT.format('c')} AS row FROM tri",
    "face_triangulation_count": _with(_POLYGON.format(_SIZES), _TRI) + "\nSELECT CAST(len(f) AS INTEGER) AS n, count(*) AS triangulations FROM tri GROUP BY 1",
    "triangulate_graph": _graph_rows(_NATIONS.format(copies=2)),
    "triangulate_fixtures": _graph_rows(_values(FIXTURES)),
    "triangulate_count": _with(_values(FIXTURES), _TRI, _ROWS) + "\nSELECT g AS graph_id, count(*) AS triangulations FROM rows GROUP BY g",
    "triangulate_closed_walk": _graph_rows(_values(WALKS)),
    "bruteforce_triangulations": _graph_rows(_NATIONS.format(copies=2)),
    "count_graphs": _with(_NATIONS.format(copies=2), _TRI, _ROWS) + "\nSELECT g AS graph_id, count(*) AS triangulations FROM rows GROUP BY g",
    "cycle_pair_count": f"SELECT CAST(n AS INTEGER) AS n, CAST(triangulations AS BIGINT) AS triangulations FROM (VALUES {_CYCLES}) v(n, triangulations)",
    "search_counters": f"SELECT graph_id, CAST(r AS BIGINT) AS results, CAST(c AS BIGINT) AS checks, CAST(s AS BIGINT) AS successful, CAST(i AS BIGINT) AS invalid, CAST(r + i AS BIGINT) AS traversals FROM (VALUES {_COUNTERS}) v(graph_id, r, c, s, i)",
    "bag_compare_report": _WALK_BAGS + "\nSELECT graph_id, row, 'MATCH' AS label, least(l, r) AS n FROM m WHERE least(l, r) > 0 UNION ALL SELECT graph_id, row, 'EXTRA', l - r FROM m WHERE l > r UNION ALL SELECT graph_id, row, 'MISSING', r - l FROM m WHERE r > l",
    "diff_report_lines": _WALK_BAGS + """, d AS (SELECT row, 'MATCH' AS label, least(l, r) AS n FROM m UNION ALL SELECT row, 'EXTRA', l - r FROM m UNION ALL SELECT row, 'MISSING', r - l FROM m)
SELECT '[' || label || '] ' || row AS value FROM d, unnest(range(0, CAST(n AS BIGINT))) WHERE n > 0 UNION ALL SELECT '[STATUS] MISMATCHED'""",
    "match_status": _WALK_BAGS + """
SELECT graph_id, CAST(sum(l) AS BIGINT) AS engine_total, CAST(sum(r) AS BIGINT) AS oracle_total, CAST(sum(least(l, r)) AS BIGINT) AS matches, CAST(sum(greatest(l - r, 0)) AS BIGINT) AS extra, CAST(sum(greatest(r - l, 0)) AS BIGINT) AS missing,
round(CASE WHEN sum(r) <> 0 THEN sum(l) / sum(r) ELSE 0 END, 4) AS ratio, CASE WHEN sum(greatest(r - l, 0)) = 0 THEN 'MATCHED' ELSE 'MISMATCHED' END AS contained, CASE WHEN sum(abs(r - l)) = 0 THEN 'MATCHED' ELSE 'MISMATCHED' END AS equal FROM m GROUP BY graph_id""",
    "positional_equal": _WALK_BAGS + "\nSELECT graph_id, sum(abs(r - l)) = 0 AS equal FROM m GROUP BY graph_id",
    "flip_neighbors": _flips("(6)", f"SELECT {_POSITIONS.format('p')} AS tri, {_POSITIONS.format('nb')} AS neighbor FROM flip"),
    "flip_parent": _flips("(6)", f"""SELECT {_POSITIONS.format('k.p')} AS tri, CASE WHEN k.b IS NOT NULL THEN {_POSITIONS.format('x.nb')} END AS parent, CAST(k.n - 3 - len(list_filter(k.p, lambda zz: zz.i = 0)) AS INTEGER) AS depth,
CAST(len(list_filter(k.p, lambda zz: zz.i = 0 AND zz.j >= coalesce(k.b, 0))) AS INTEGER) AS n_children FROM blk k LEFT JOIN flip x ON x.id = k.id AND x.i = k.b AND x.ko = 0"""),
    "flip_children": _flips("(6)", f"SELECT {_POSITIONS.format('x.p')} AS tri, {_POSITIONS.format('x.nb')} AS child FROM flip x JOIN blk k ON k.id = x.id WHERE x.i = 0 AND x.j >= coalesce(k.b, 0)"),
    "flip_depth_histogram": _with(_POLYGON.format(_SIZES), _TRI) + "\nSELECT CAST(len(f) AS INTEGER) AS n, CAST(len(f) - 3 - len(list_filter(p, lambda zz: zz.i = 0)) AS INTEGER) AS depth, count(*) AS triangulations FROM tri GROUP BY ALL",
    "valid_generating_sets": _flips("(6)", f"""SELECT {_POSITIONS.format('k.p')} AS tri, coalesce(string_agg(x.i || '-' || x.j, ' ' ORDER BY x.i, x.j), '') AS gs,
coalesce(string_agg(x.i || '-' || x.j, ' ' ORDER BY x.i, x.j) FILTER (NOT (least(ki, ko) = 1 AND greatest(ki, ko) = 3)), '') AS vgs FROM blk k LEFT JOIN apex x ON x.id = k.id AND x.i = 0 AND x.j >= coalesce(k.b, 0) GROUP BY k.id, k.p"""),
    "degree_sequences": _with(_POLYGON.format("(4), (5), (6), (7), (8)"), _TRI) + """,
d AS (SELECT len(f) AS n, list_transform(range(len(f)), lambda v: len(list_filter(p, lambda zz: zz.i = v OR zz.j = v)) + 2) AS d FROM tri),
turned AS (SELECT n, d, list_reverse(d) AS r FROM d),
canon AS (SELECT n, list_max(list_concat(list_transform(range(n), lambda k: list_concat(d[k + 1:], d[:k])), list_transform(range(n), lambda k: list_concat(r[k + 1:], r[:k])))) AS c FROM turned)
SELECT CAST(n AS INTEGER) AS n, array_to_string(c, ' ') AS degrees, count(*) AS members FROM canon GROUP BY n, c""",
    "bench_stats": f"SELECT event_type, count(value) AS runs, {_STATS.format('value')} FROM events GROUP BY event_type",
    "bench_stats_by_order": f"SELECT l_orderkey, count(l_extendedprice) AS runs, {_STATS.format('l_extendedprice')} FROM lineitem GROUP BY l_orderkey",
    "run_results": """WITH r AS (SELECT l_orderkey, CAST(floor(l_extendedprice * 1000) AS BIGINT) * 840 / 1e9 AS s, CAST(trunc(l_discount * 100000) AS BIGINT) - CAST(trunc(l_quantity * 100) AS BIGINT) AS grown FROM lineitem)
SELECT 'order-' || l_orderkey AS filename, CAST(l_orderkey % 7 AS INTEGER) AS vertices, l_orderkey % 11 AS triangulations, round(avg(s), 9) AS meanTime, round(median(s), 9) AS medianTime, round(min(s), 9) AS minTime, round(max(s), 9) AS maxTime,
round(coalesce(stddev_samp(s), 0), 9) AS stddevTime, round_even(CASE WHEN l_orderkey % 11 <> 0 THEN avg(s) / (l_orderkey % 11) * 1e9 ELSE 0 END, 0) AS perTriangNs, max(greatest(grown, 0)) AS peakMemory, round(CASE WHEN l_orderkey % 7 <> 0 THEN max(greatest(grown, 0)) / (l_orderkey % 7) ELSE 0 END, 4) AS memoryPerVertex FROM r GROUP BY l_orderkey""",
    "results_csv_round_trip": """WITH r AS (SELECT l_orderkey, CAST(floor(l_extendedprice * 1000) AS BIGINT) * 840 / 1e9 AS s, CAST(trunc(l_discount * 100000) AS BIGINT) - CAST(trunc(l_quantity * 100) AS BIGINT) AS grown FROM lineitem)
SELECT 'order-' || l_orderkey AS filename, CAST(l_orderkey % 7 AS INTEGER) AS vertices, l_orderkey % 11 AS triangulations, round(avg(s), 9) AS meanTime, round(median(s), 9) AS medianTime, round(min(s), 9) AS minTime, round(max(s), 9) AS maxTime,
round(coalesce(stddev_samp(s), 0), 9) AS stddevTime, max(greatest(grown, 0)) AS peakMemory FROM r GROUP BY l_orderkey""",
    "per_item_cost": "SELECT o_orderkey, round(CASE WHEN items > 0 THEN o_totalprice / items ELSE 0 END, 6) AS cost FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS items FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey",
    "success_rates": "SELECT o_orderpriority, count(*) AS checks, count(*) FILTER (o_orderstatus = 'F') AS successful, round(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*), 2) AS rate FROM orders GROUP BY 1",
    "loglog_regression": f"WITH {_TOTALS}, {_LAW} SELECT round(slope, 6) AS slope, round(intercept, 6) AS intercept FROM law",
    "regression_envelope": f"WITH {_TOTALS}, {_LAW} SELECT round(slope, 4) AS slope, round(intercept, 4) AS intercept, round(max(y / pow(10, intercept + slope * log10(x))), 4) AS upper, round(min(y / pow(10, intercept + slope * log10(x))), 4) AS lower FROM o, law WHERE x > 0 AND y > 0 GROUP BY slope, intercept",
    "resume_skip": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
    "first_record_wins": "SELECT l_partkey, l_orderkey, l_linenumber, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) = 1",
    "incremental_cost": f"{_TRACE} SELECT user_id, event_id, n, elapsed, incremental, running, running // n AS cumulative_avg FROM c",
    "stream_running_cost": f"{_TRACE} SELECT CAST(user_id AS VARCHAR) AS graph_id, n, elapsed, incremental, running // n AS cumulative_avg FROM c",
    "first_n_with_final": f"{_TRACE}, f AS (SELECT user_id, max_by(running // n, n) AS final, max(n) AS total FROM c GROUP BY 1) SELECT c.user_id, n, running // n AS cumulative_avg, final, total FROM c JOIN f ON f.user_id = c.user_id WHERE n <= 5",
    "smoothed_mean": f"{_DAYS} SELECT day, round(mean, 6) AS mean, round(avg(mean) OVER (ORDER BY day ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS mean_smooth FROM d",
    "smoothed_envelope": f"{_DAYS} SELECT day, round(avg(mean) OVER w, 6) AS mean, round(avg(mean + dev) OVER w, 6) AS upper, round(avg(mean - dev) OVER w, 6) AS lower FROM d WINDOW w AS (ORDER BY day ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)",
    "format_bytes": f"""WITH d AS (SELECT doc_id, CAST({_SIZE} AS DOUBLE) AS x FROM documents)
SELECT doc_id, CASE WHEN x < 1024 THEN printf('%.2f B', x) WHEN x < 1048576 THEN {_bytes_text('1024.0', 'KB')} WHEN x < 1073741824 THEN {_bytes_text('1048576.0', 'MB')} ELSE {_bytes_text('1073741824.0', 'GB')} END AS size,
CASE WHEN x < 1024 THEN 'small' WHEN x < 10240 THEN 'medium' ELSE 'large' END AS band FROM d""",
    "strip_ansi": "SELECT page_id, url || ' ok' AS plain, substring(url, 1, 25) AS short FROM pages",
    "stem_name": "SELECT page_id, regexp_extract(url, '[^/]*$') AS name, regexp_replace(regexp_extract(url, '[^/]*$'), '(.)\\.[^.]*$', '\\1') AS stem FROM pages",
    "wall_clock": "SELECT event_id, strftime(TIMESTAMP '1970-01-01 01:00:00' + to_microseconds(event_id * 1234567 // 1000), '%H:%M:%S.%f') AS wall_clock FROM events",
    "parse_count": "SELECT o_orderkey, o_orderkey * 7919 AS n FROM orders",
}

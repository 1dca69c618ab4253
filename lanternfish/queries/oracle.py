"""SQL for DuckDB that gives what the queries give."""

from __future__ import annotations

K = 10
POINTS = "pts AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings)"


def dist(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def uniform(*parts: str) -> str:
    """The first 13 hex digits of the md5, as a fraction."""
    return f"CAST(CAST('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 13) AS UBIGINT) AS DOUBLE) / {16**13}.0"


def topk(pairs: str, k: int = K) -> str:
    """id, neighbor_id, sq_dist, rank of pairs (id, nb) by the vectors in pts."""
    return f"""SELECT id, nb AS neighbor_id, round(d, 6) AS sq_dist, CAST(rank AS INTEGER) AS rank FROM (
        SELECT id, nb, d, row_number() OVER (PARTITION BY id ORDER BY d, nb) AS rank FROM (
            SELECT p.id, p.nb, {dist('a.x', 'b.x')} AS d FROM ({pairs}) p JOIN pts a ON a.id = p.id JOIN pts b ON b.id = p.nb)) WHERE rank <= {k}"""


def nearest(pairs: str, k: int = K) -> str:
    """id, nb of the nearest of pairs (id, nb)."""
    return f"SELECT id, neighbor_id AS nb FROM ({topk(pairs, k)})"


def forest(trees: int, least: int, most: int, seed: int = 0, name: str = "f", points: str = "pts") -> str:
    """Recursive member: tree, id, path, leaf, depth of all points at all levels."""
    return f"""{name} AS (
        SELECT t.tree, id, 'r' AS path, FALSE AS leaf, 0 AS depth FROM {points}, (SELECT CAST(unnest(range({trees})) AS INTEGER) AS tree) t
        UNION ALL
        SELECT tree, id, path || way, CASE WHEN least(nl, nr) < {least} THEN nl + nr <= {most} WHEN way = 'L' THEN nl <= {most} - 2 ELSE nr <= {most} - 2 END, depth + 1
        FROM (SELECT *, CASE WHEN least(nl, nr) < {least} THEN CASE WHEN nl >= nr THEN 'L' ELSE 'R' END ELSE side END AS way
            FROM (SELECT *, count(*) FILTER (WHERE side = 'L') OVER (PARTITION BY tree, path) AS nl, count(*) FILTER (WHERE side = 'R') OVER (PARTITION BY tree, path) AS nr
                FROM (SELECT m.tree, m.id, m.path, m.depth,
                        CASE WHEN list_sum(list_transform(list_zip(v.x, a.x, b.x), lambda z: z[1] * (z[2] - z[3])))
                            < list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * ((z[1] + z[2]) / 2))) THEN 'R' ELSE 'L' END AS side
                    FROM (SELECT *, max(CASE WHEN n = 1 THEN id END) OVER (PARTITION BY tree, path) AS i1, max(CASE WHEN n = 2 THEN id END) OVER (PARTITION BY tree, path) AS i2
                        FROM (SELECT *, row_number() OVER (PARTITION BY tree, path ORDER BY md5(concat_ws(':', {seed}, tree, path, id)), id) AS n FROM {name} WHERE NOT leaf)) m
                    JOIN {points} v ON v.id = m.id JOIN {points} a ON a.id = m.i1 JOIN {points} b ON b.id = m.i2))))"""


def with_forest(body: str, trees: int = 4, least: int = 32, most: int = 128, more: str = "") -> str:
    return f"WITH RECURSIVE {POINTS}, {forest(trees, least, most)}, lf AS (SELECT tree, id, path, depth FROM f WHERE leaf){', ' + more if more else ''} {body}"


LEAVES = """lv AS (SELECT tree, path, CAST(dense_rank() OVER (PARTITION BY tree ORDER BY path) - 1 AS INTEGER) AS leaf_id, n, depth
    FROM (SELECT tree, path, count(*) AS n, max(depth) AS depth FROM lf GROUP BY tree, path))"""
IN_LEAF = "SELECT DISTINCT a.id, b.id AS nb FROM lf a JOIN lf b ON a.tree = b.tree AND a.path = b.path AND a.id <> b.id"
SELF = "SELECT id, id AS nb FROM pts"
LOG = "lg AS (SELECT tree, CAST(max(depth) AS INTEGER) AS depth, max(n) AS max_leaf, min(n) AS min_leaf, count(*) AS total_leaves FROM lv GROUP BY tree)"


def explored(name: str) -> str:
    return f"SELECT id, nb FROM {name} UNION SELECT a.id, b.nb FROM {name} a JOIN {name} b ON a.nb = b.id WHERE a.id <> b.nb"


EXACT_PAIRS = "SELECT a.id, b.id AS nb FROM pts a, pts b WHERE a.id <> b.id"
EXACT = f"WITH {POINTS} {topk(EXACT_PAIRS)}"
SYMMETRIC = f"""ex AS ({nearest(EXACT_PAIRS)}), sy AS (SELECT id AS src, nb AS dst FROM ex UNION SELECT nb, id FROM ex)"""
CURVES = """cv AS (SELECT * FROM (VALUES ('forest', 0.2, 1.0, 1000), ('forest', 0.5, 2.0, 1000), ('forest', 0.9, 8.0, 1000),
    ('lists', 0.3, 2.0, 1000), ('lists', 0.6, 9.0, 1000), ('lists', 0.95, 20.0, 1000)) v(method, quality, seconds, n))"""


def projected(value: str, levels: str) -> str:
    """method, level, y: the line through the points around each level."""
    return f"""pr AS (
        SELECT method, level, y0 + (level - x0) / (x1 - x0) * (y1 - y0) AS y FROM (
            SELECT *, row_number() OVER (PARTITION BY method ORDER BY x1) AS n, count(*) OVER (PARTITION BY method) AS m FROM (
                SELECT method, CAST(quality AS DOUBLE) AS x1, CAST({value} AS DOUBLE) AS y1, lag(CAST(quality AS DOUBLE)) OVER w AS x0, lag(CAST({value} AS DOUBLE)) OVER w AS y0
                FROM cv WINDOW w AS (PARTITION BY method ORDER BY quality)) WHERE x0 IS NOT NULL),
            (SELECT CAST(unnest({levels}) AS DOUBLE) / 10 AS level)
        WHERE (n = 1 OR level > x0) AND (n = m OR level <= x1))"""


ROOT = f"""WITH {POINTS}, o AS (SELECT id, x, row_number() OVER (ORDER BY md5(concat_ws(':', 0, 0, 'r', id)), id) AS n FROM pts),
    pl AS (SELECT list_transform(list_zip(a.x, b.x), lambda z: z[1] - z[2]) AS normal,
        list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * ((z[1] + z[2]) / 2))) AS off FROM o a, o b WHERE a.n = 1 AND b.n = 2)"""
SIDE = "SELECT id, CASE WHEN list_sum(list_transform(list_zip(x, normal), lambda z: z[1] * z[2])) < off THEN 'R' ELSE 'L' END AS side FROM pts, pl"
COMPONENTS = "SELECT id, CAST(pos - 1 AS INTEGER) AS pos, round({value}, 6) AS value FROM (SELECT id, generate_subscripts(x, 1) AS pos, unnest(x) AS v FROM pts)"
TRUTH = f"tr AS ({topk(EXACT_PAIRS)}), gf AS ({topk(IN_LEAF)})"
COARSE = "pts AS (SELECT p_partkey AS id, [p_size % 7, p_size % 3] AS x FROM part)"

_BASE = "pts AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), base AS (SELECT * FROM pts), qs AS (SELECT * FROM pts WHERE id % 50 = 0)"
# The tree over the base; a query goes where the base's nodes say, and to the sibling of a side that was merged.
_ROUTED = f"""{forest(4, 32, 128, points='base')},
    kids AS (SELECT tree, substr(path, 1, length(path) - 1) AS parent, path, bool_and(leaf) AS leaf FROM f WHERE depth > 0 GROUP BY tree, path),
    an AS (SELECT tree, path, max(CASE WHEN n = 1 THEN id END) AS i1, max(CASE WHEN n = 2 THEN id END) AS i2 FROM (
        SELECT *, row_number() OVER (PARTITION BY tree, path ORDER BY md5(concat_ws(':', 0, tree, path, id)), id) AS n FROM f WHERE NOT leaf) GROUP BY tree, path),
    rt AS (
        SELECT CAST(t.tree AS INTEGER) AS tree, id, 'r' AS path, FALSE AS leaf FROM qs, (SELECT unnest(range(4)) AS tree) t
        UNION ALL
        SELECT s.tree, s.id, coalesce(k1.path, k2.path), coalesce(k1.leaf, k2.leaf) FROM (
            SELECT r.tree, r.id, r.path, CASE WHEN list_sum(list_transform(list_zip(q.x, a.x, b.x), lambda z: z[1] * (z[2] - z[3])))
                < list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * ((z[1] + z[2]) / 2))) THEN 'R' ELSE 'L' END AS side
            FROM rt r JOIN an ON an.tree = r.tree AND an.path = r.path JOIN qs q ON q.id = r.id JOIN base a ON a.id = an.i1 JOIN base b ON b.id = an.i2 WHERE NOT r.leaf) s
        LEFT JOIN kids k1 ON k1.tree = s.tree AND k1.parent = s.path AND k1.path = s.path || s.side
        LEFT JOIN kids k2 ON k2.tree = s.tree AND k2.parent = s.path AND k2.path <> s.path || s.side)"""

ORACLE_SQL: dict[str, str] = {
    "exact_knn_graph": EXACT,
    "exact_knn_graph_blocks": f"WITH {POINTS} {topk('SELECT a.id, b.id AS nb FROM pts a, pts b')}",
    "exact_knn_search": f"WITH {POINTS} {topk('SELECT a.id, b.id AS nb FROM pts a, pts b WHERE a.id % 50 = 0')}",
    "pairwise_sq_l2": f"WITH {POINTS} SELECT a.id AS left_id, b.id AS right_id, round({dist('a.x', 'b.x')}, 6) AS sq_dist FROM pts a, pts b WHERE b.id % 50 = 0",
    "knn_matrix": with_forest(
        f"""SELECT p.id, CAST(s.place AS INTEGER) AS place, coalesce(g.neighbor_id, -1) AS neighbor_id
        FROM pts p, (SELECT unnest(range(1, {K} + 1)) AS place) s LEFT JOIN g ON g.id = p.id AND g.rank = s.place""",
        1, 5, 20, f"g AS ({topk(IN_LEAF)})",
    ),
    "sample_order": f"WITH {POINTS} SELECT id, md5(concat_ws(':', 0, 0, 'r', id)) AS sample_key FROM pts",
    "hyperplane_root": f"{ROOT} SELECT 0 AS tree, CAST(generate_subscripts(normal, 1) - 1 AS INTEGER) AS pos, round(unnest(normal), 6) AS value, round(off, 6) AS offset FROM pl",
    "root_side": f"{ROOT} {SIDE}",
    "root_side_counts": f"{ROOT} SELECT side, count(*) AS n FROM ({SIDE}) GROUP BY side",
    "tree_leaf_assignment": with_forest("SELECT tree, id, path, CAST(depth AS INTEGER) AS depth FROM lf"),
    "tree_leaf_assignment_collapsing": with_forest("SELECT tree, id, path, CAST(depth AS INTEGER) AS depth FROM lf", 3, 20, 60),
    "tree_leaf_stats": with_forest("SELECT tree, leaf_id, path, n AS n_points FROM lv", 3, 20, 60, LEAVES),
    "tree_nodes": with_forest(
        """SELECT tree, p AS path, CAST(d AS INTEGER) AS depth, n_left, n_right, CASE WHEN least(n_left, n_right) >= 20 THEN '-' WHEN n_left >= n_right THEN 'L' ELSE 'R' END AS merged FROM (
            SELECT m.tree, m.path AS p, m.depth AS d, count(*) FILTER (WHERE s = 'L') AS n_left, count(*) FILTER (WHERE s = 'R') AS n_right FROM (
                SELECT m.*, CASE WHEN list_sum(list_transform(list_zip(v.x, a.x, b.x), lambda z: z[1] * (z[2] - z[3])))
                    < list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * ((z[1] + z[2]) / 2))) THEN 'R' ELSE 'L' END AS s
                FROM (SELECT *, max(CASE WHEN n = 1 THEN id END) OVER (PARTITION BY tree, path) AS i1, max(CASE WHEN n = 2 THEN id END) OVER (PARTITION BY tree, path) AS i2
                    FROM (SELECT *, row_number() OVER (PARTITION BY tree, path ORDER BY md5(concat_ws(':', 0, tree, path, id)), id) AS n FROM f WHERE NOT leaf)) m
                JOIN pts v ON v.id = m.id JOIN pts a ON a.id = m.i1 JOIN pts b ON b.id = m.i2) m GROUP BY m.tree, m.path, m.depth)""",
        3, 20, 60,
    ),
    "leaf_size_histogram": with_forest("SELECT tree, n AS leaf_size, count(*) AS n_leaves FROM lv GROUP BY tree, n UNION ALL SELECT -1, n, count(*) FROM lv GROUP BY n", more=LEAVES),
    "tree_bucket_slots": with_forest("SELECT tree, leaf_id, CAST(row_number() OVER (PARTITION BY tree, path ORDER BY id) - 1 AS INTEGER) AS slot, id FROM lf JOIN lv USING (tree, path)", more=LEAVES),
    "partition_padded": with_forest(
        """SELECT l.tree, l.leaf_id, CAST(s.slot AS INTEGER) AS slot, coalesce(b.id, -1) AS id
        FROM (SELECT *, max(n) OVER (PARTITION BY tree) AS most FROM lv) l JOIN (SELECT unnest(range(128)) AS slot) s ON s.slot < l.most
        LEFT JOIN (SELECT tree, path, id, row_number() OVER (PARTITION BY tree, path ORDER BY id) - 1 AS slot FROM lf) b ON b.tree = l.tree AND b.path = l.path AND b.slot = s.slot""",
        more=LEAVES,
    ),
    "partition_tree": with_forest("SELECT leaf_id, id, n AS n_points FROM lf JOIN lv USING (tree, path)", trees=1, more=LEAVES),
    "partition_unpadded": with_forest("SELECT tree, leaf_id, id FROM lf JOIN lv USING (tree, path)", more=LEAVES),
    "forest_log": with_forest("SELECT * FROM lg", more=f"{LEAVES}, {LOG}"),
    "forest_log_statistics": with_forest(
        """SELECT attribute, round(sum(value), 6) AS sum, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(stddev_samp(value) / sqrt(count(value)), 6) AS sem
        FROM (SELECT unnest(['depth', 'max_leaf', 'min_leaf', 'total_leaves']) AS attribute, unnest([CAST(depth AS DOUBLE), max_leaf, min_leaf, total_leaves]) AS value FROM lg) GROUP BY attribute""",
        more=f"{LEAVES}, {LOG}",
    ),
    "bucket_candidates": with_forest(f"SELECT id, count(*) AS n_candidates FROM ({IN_LEAF}) GROUP BY id"),
    "knn_graph_no_explore": with_forest(topk(f"{IN_LEAF} UNION {SELF}")),
    "knn_graph_no_self": with_forest(topk(IN_LEAF)),
    "knn_graph_explore1": with_forest(topk(explored("g0")), more=f"g0 AS ({nearest(f'{IN_LEAF} UNION {SELF}')})"),
    "knn_graph_explore2": with_forest(topk(explored("g1")), more=f"g0 AS ({nearest(IN_LEAF)}), g1 AS ({nearest(explored('g0'))})"),
    "knn_graph_ensure_valid": f"""WITH RECURSIVE {POINTS}, {forest(2, 5, 20)}, {forest(1, 11, 33, name='e')}, lf AS (SELECT tree, id, path FROM f WHERE leaf UNION ALL SELECT 100 + tree, id, path FROM e WHERE leaf)
        {topk(IN_LEAF)}""",
    "query_routing": f"WITH RECURSIVE {_BASE}, {_ROUTED} SELECT tree, id, path FROM rt WHERE leaf",
    "knn_search_forest": f"WITH RECURSIVE {_BASE}, {_ROUTED} {topk('SELECT DISTINCT r.id, b.id AS nb FROM rt r JOIN f b ON b.tree = r.tree AND b.path = r.path WHERE r.leaf AND b.leaf')}",
    "nne_rate": with_forest(f"SELECT round(count(*) / (SELECT count(DISTINCT id) * {K} FROM tr), 6) AS recall FROM tr JOIN gf USING (id, neighbor_id)", more=TRUTH),
    "recall_eps": with_forest(
        f"""SELECT round(count(*) FILTER (WHERE d <= reach) / (SELECT count(DISTINCT id) * {K} FROM tr), 6) AS recall
        FROM (SELECT g.id, {dist('a.x', 'b.x')} AS d FROM gf g JOIN pts a ON a.id = g.id JOIN pts b ON b.id = g.neighbor_id)
        JOIN (SELECT t.id, max({dist('a.x', 'b.x')}) * 1.05 AS reach FROM tr t JOIN pts a ON a.id = t.id JOIN pts b ON b.id = t.neighbor_id GROUP BY t.id) USING (id)""",
        more=TRUTH,
    ),
    "dist_mean": with_forest(f"SELECT round(avg({dist('a.x', 'b.x')}), 6) AS mean_sq_dist FROM gf g JOIN pts a ON a.id = g.id JOIN pts b ON b.id = g.neighbor_id", more=TRUTH),
    "missing_neighbors": with_forest(f"SELECT id, {K} - (n - 1) AS missing FROM lf JOIN lv USING (tree, path) WHERE n - 1 < {K}", 1, 5, 20, LEAVES),
    "label_agreement": f"WITH {POINTS}, g AS ({topk(EXACT_PAIRS)}) SELECT round(avg(CASE WHEN a.label = b.label THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM g JOIN pts a ON a.id = g.id JOIN pts b ON b.id = g.neighbor_id",
    "throughput_projection": f"WITH {CURVES}, {projected('n / seconds', '[2, 3, 4, 5, 6, 7, 8, 9]')} SELECT method, round(level, 6) AS level, round(y, 6) AS projected FROM pr",
    "speed_up": f"WITH {CURVES}, {projected('seconds', '[2, 3, 4, 5, 6, 7, 8, 9]')} SELECT p.method, round(p.level, 6) AS level, round(b.y / p.y, 6) AS speed_up FROM pr p JOIN pr b ON p.level = b.level AND b.method = 'lists'",
    "results_wide": f"""WITH {CURVES} SELECT CAST({K} AS INTEGER) AS k, round(CAST(quality AS DOUBLE) * 10, 6) AS param_value,
        max(CASE WHEN method = 'forest' THEN CAST(seconds AS DOUBLE) END) AS forest_seconds, max(CASE WHEN method = 'forest' THEN CAST(quality AS DOUBLE) END) AS forest_quality,
        max(CASE WHEN method = 'lists' THEN CAST(seconds AS DOUBLE) END) AS lists_seconds, max(CASE WHEN method = 'lists' THEN CAST(quality AS DOUBLE) END) AS lists_quality
        FROM cv WHERE method = 'forest' OR quality = 0.3 GROUP BY quality""",
    "symmetric_graph": f"WITH {POINTS}, {SYMMETRIC} SELECT src, dst, CAST(1 AS DOUBLE) AS weight FROM sy",
    "graph_degree": f"WITH {POINTS}, {SYMMETRIC} SELECT src AS id, count(*) AS degree FROM sy GROUP BY src",
    "csr_offsets": f"""WITH {POINTS}, {SYMMETRIC}, dg AS (SELECT id, (SELECT count(*) FROM sy WHERE src = pts.id) AS degree FROM pts)
        SELECT id, degree, CAST(coalesce(sum(degree) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS indptr FROM dg""",
    "hbgf_bipartite": with_forest("SELECT src, dst, CAST(1 AS DOUBLE) AS weight FROM (SELECT 'p' || id AS src, 't' || tree || ':' || path AS dst FROM lf UNION ALL SELECT 't' || tree || ':' || path, 'p' || id FROM lf)"),
    "jitter_ranges": f"WITH {POINTS} SELECT CAST(pos - 1 AS INTEGER) AS pos, round(min(v), 9) AS lo, round(max(v), 9) AS hi, round((max(v) - min(v)) / count(*), 9) AS radius FROM (SELECT generate_subscripts(x, 1) AS pos, unnest(x) AS v FROM pts) GROUP BY pos",
    "random_motion": f"""WITH {POINTS}, c AS (SELECT id, generate_subscripts(x, 1) AS pos, unnest(x) AS v FROM pts), r AS (SELECT pos, (max(v) - min(v)) / count(*) AS radius FROM c GROUP BY pos)
        SELECT id, CAST(pos - 1 AS INTEGER) AS pos, round(v + (2 * ({uniform('0', 'id', 'pos - 1')}) - 1) * radius, 6) AS value FROM c JOIN r USING (pos)""",
    "scale_pixels": f"WITH {POINTS} {COMPONENTS.format(value='v * (CAST(0.99 AS DOUBLE) / 255) + CAST(0.01 AS DOUBLE)')}",
    "scale_pixels_as_coded": f"WITH {POINTS} {COMPONENTS.format(value='v * (CAST(0.99 AS DOUBLE) / 255 + CAST(0.01 AS DOUBLE))')}",
    "dedup_vectors": f"""WITH {COARSE}, u AS (SELECT x, min(id) AS first_id, count(*) AS n_copies FROM pts GROUP BY x), n AS (SELECT *, row_number() OVER (ORDER BY first_id) - 1 AS unique_no FROM u)
        SELECT id, first_id, unique_no, n_copies FROM pts JOIN n USING (x)""",
    "minmax_label": f"WITH {POINTS} SELECT id, round((label - min(label) OVER ()) / CAST(max(label) OVER () - min(label) OVER () AS DOUBLE), 6) AS scaled FROM pts",
    "class_names": f"WITH {POINTS} SELECT id, CASE WHEN label BETWEEN 0 AND 7 THEN 'class ' || label ELSE '-' END AS class_name FROM pts",
    "hash_split": f"WITH {POINTS} SELECT id, {uniform('0', chr(39) + 'split' + chr(39), 'id')} < 0.5 AS is_train FROM pts",
    "first_by_hash": f"WITH {POINTS} SELECT id FROM pts ORDER BY md5(concat_ws(':', 0, id)), id LIMIT 50",
    "uniform_generator": f"SELECT id, CAST(pos AS INTEGER) AS pos, round({uniform('7', 'id', 'pos')}, 6) AS value FROM (SELECT unnest(range(200)) AS id), (SELECT unnest(range(4)) AS pos)",
    "split_line_generator": f"SELECT id, CAST(pos AS INTEGER) AS pos, round(CASE WHEN id < 100 THEN id / 200 ELSE id / 200 + 1 END + ({uniform('0', 'id', 'pos')}) / 200, 6) AS value FROM (SELECT unnest(range(200)) AS id), (SELECT unnest(range(2)) AS pos)",
    "auto_n_trees": f"WITH {POINTS} SELECT CAST(scale AS BIGINT) AS scale, CAST(greatest(ceil((SELECT count(*) FROM pts) * scale * (SELECT max(len(x)) FROM pts) / ((11 + 22) / 2 * 24913)), 50) AS BIGINT) AS n_trees FROM (SELECT unnest([1, 1000, 100000]) AS scale)",
    "parameter_defaults": "SELECT CAST(k AS BIGINT) AS k, CAST(k + 1 AS BIGINT) AS min_leaf, CAST(2 * (k + 1) AS BIGINT) AS max_leaf, CAST(k <= 32 AS BIGINT) AS explore, CAST(50 AS BIGINT) AS n_trees FROM (SELECT unnest([1, 10, 32, 33, 64]) AS k)",
    "ivf_flat_search": f"""WITH {POINTS}, ce AS (SELECT id, x FROM (SELECT *, row_number() OVER (ORDER BY md5(concat_ws(':', 0, id)), id) AS n FROM pts) WHERE n <= (SELECT CAST(floor(sqrt(count(*))) AS BIGINT) FROM pts)),
        ra AS (SELECT p.id, c.id AS list, row_number() OVER (PARTITION BY p.id ORDER BY {dist('p.x', 'c.x')}, c.id) AS n FROM pts p, ce c)
        {topk('SELECT q.id, b.id AS nb FROM ra q JOIN ra b ON q.list = b.list WHERE q.n <= 3 AND b.n = 1')}""",
}

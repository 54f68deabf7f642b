"""DuckDB SQL for the named queries: plain formulas over whole tables, with no index."""

from __future__ import annotations

from .catalog import BOXES_4D


def _scaled(name: str, source: str, key: str | None, exprs: list[str]) -> str:
    """A point set rescaled to [0, 10000]."""
    raw = ", ".join(f"CAST({e} AS DOUBLE) AS v{k}" for k, e in enumerate(exprs, 1))
    ends = ", ".join(f"min(v{k}) AS a{k}, greatest(max(v{k}) - min(v{k}), 1e-12) AS w{k}" for k in range(1, len(exprs) + 1))
    out = ", ".join(f"(v{k} - a{k}) / w{k} * CAST(10000.0 AS DOUBLE) + CAST(0.0 AS DOUBLE) AS x{k}" for k in range(1, len(exprs) + 1))
    pid = f"{key} AS pid, " if key else ""
    return f"{name}_raw AS (SELECT {pid}{raw} FROM {source}), {name}_ends AS (SELECT {ends} FROM {name}_raw), {name} AS (SELECT {'pid, ' if key else ''}{out} FROM {name}_raw, {name}_ends)"


EV = _scaled("ev", "events", "event_id", ["value", "user_id"])
EV3 = _scaled("ev", "events", "event_id", ["value", "epoch(date_trunc('second', CAST(ts AS TIMESTAMP)))", "user_id"])
ORD = _scaled("ord", "orders", "o_orderkey", ["o_totalprice", "date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))"])
LI = _scaled("li", "lineitem", None, ["l_extendedprice", "l_quantity"])
LI4 = _scaled("li", "lineitem", None, ["l_extendedprice", "l_quantity", "l_discount", "l_tax"])


def _boxes(half: float) -> str:
    sides = ", ".join(f"x{k} - CAST({half} AS DOUBLE) AS lo{k}, x{k} + CAST({half * 3} AS DOUBLE) AS hi{k}" for k in (1, 2))
    return f"boxes AS (SELECT pid AS qid, {sides} FROM ord WHERE pid % 50 = 0)"


def _centers(r: float = 150.0) -> str:
    return f"asked AS (SELECT pid AS qid, x1 AS c1, x2 AS c2, CAST({r} AS DOUBLE) AS r FROM ord WHERE pid % 50 = 0)"


IN_BOX = "x1 BETWEEN lo1 AND hi1 AND x2 BETWEEN lo2 AND hi2"
DIST = "sqrt((x1 - c1) * (x1 - c1) + (x2 - c2) * (x2 - c2))"
SPLITS = """
tiles AS (SELECT x1, ntile(10) OVER (ORDER BY x1, pid) AS tile FROM ev),
ends AS (SELECT tile, max(x1) AS ub FROM tiles GROUP BY tile),
splits AS (SELECT CAST(tile - 1 AS BIGINT) AS part, lag(ub, 1, CAST(0 AS DOUBLE)) OVER (ORDER BY tile) AS lb,
  CASE WHEN tile = max(tile) OVER () THEN CAST(10000 AS DOUBLE) ELSE ub END AS ub FROM ends),
inner_cuts AS (SELECT list(ub) AS cuts FROM splits WHERE part < (SELECT max(part) FROM splits))"""
KEYED = (
    SPLITS
    + """,
celled AS (SELECT ev.*, CAST(len(list_filter(cuts, lambda c: c <= x1)) AS BIGINT) AS cell FROM ev, inner_cuts),
keyed AS (SELECT pid, x1, x2, cell, CAST(0.01 AS DOUBLE) * (CASE WHEN ub > lb THEN (x1 - lb) / (ub - lb) ELSE CAST(0 AS DOUBLE) END)
  + x2 / CAST(10000 AS DOUBLE) * CAST(9 AS DOUBLE) + CAST(10 AS DOUBLE) * cell AS key FROM celled JOIN splits ON cell = part)"""
)
RANKS = KEYED + ",\nranks AS (SELECT *, row_number() OVER (ORDER BY key, pid) AS rank FROM keyed)"
PLACED = (
    RANKS
    + """,
step AS (SELECT count(*) // 16 AS step FROM ranks),
mids AS (SELECT i, (a.key + b.key) / 2 AS mid FROM generate_series(1, 15) g(i), step JOIN ranks a ON a.rank = i * step JOIN ranks b ON b.rank = i * step + 1),
bounds AS (SELECT i, min(key) AS boundary FROM mids JOIN ranks ON key > mid GROUP BY i),
placed AS (SELECT r.*, (SELECT count(*) FROM bounds WHERE boundary <= r.key) AS col_id FROM ranks r),
stats AS (SELECT *, CAST(sum(n) OVER (ORDER BY col_id) AS BIGINT) AS cum_n FROM (SELECT col_id, count(*) AS n, min(key) AS min_key, max(key) AS max_key FROM placed GROUP BY col_id)),
pairs AS (SELECT pid, p.col_id, n, rank, rank - 1 - cum_n + n AS pos, key - min_key AS t, key FROM placed p JOIN stats USING (col_id)),
knots AS (SELECT col_id, n, pos // greatest(n // 8, 1) AS i, t AS beta, pos FROM pairs WHERE pos % greatest(n // 8, 1) = 0 AND pos // greatest(n // 8, 1) < 8)"""
)
MODEL = (
    PLACED
    + """,
chain AS (SELECT col_id, i, beta, pos FROM knots UNION ALL SELECT col_id, 1000000, max_key - min_key, n - 1 FROM stats),
slopes AS (SELECT *, CASE WHEN next_beta > beta THEN (next_pos - pos) / (next_beta - beta) ELSE CAST(0 AS DOUBLE) END AS slope
  FROM (SELECT *, lead(beta) OVER o AS next_beta, lead(pos) OVER o AS next_pos FROM chain WINDOW o AS (PARTITION BY col_id ORDER BY i)) WHERE i < 1000000),
model AS (SELECT col_id, list(beta ORDER BY i) AS betas, list(alpha ORDER BY i) AS alphas FROM
  (SELECT *, slope - coalesce(lag(slope) OVER (PARTITION BY col_id ORDER BY i), CAST(0 AS DOUBLE)) AS alpha FROM slopes) GROUP BY col_id),
predicted AS (SELECT p.*, list_reduce(list_transform(list_zip(alphas, betas), lambda z: z[1] * greatest(t - z[2], CAST(0 AS DOUBLE))), lambda a, b: a + b) AS predicted FROM pairs p JOIN model USING (col_id))"""
)
SHARDS = (
    MODEL
    + """,
raw AS (SELECT *, greatest(CAST(floor(predicted / 50) AS BIGINT), 0) AS raw FROM predicted),
counts AS (SELECT col_id, raw, count(*) AS c FROM raw GROUP BY ALL),
tails AS (SELECT *, sum(c) OVER o AS tail, row_number() OVER o AS nth FROM counts WINDOW o AS (PARTITION BY col_id ORDER BY raw DESC)),
limits AS (SELECT col_id, CASE WHEN sum(c) <= 50 THEN 0 WHEN max(CASE WHEN nth = 1 THEN c END) >= 50 THEN max(raw)
  ELSE coalesce(max(CASE WHEN nth > 1 AND tail > 50 THEN raw END), 0) END AS most FROM tails GROUP BY col_id),
firsts AS (SELECT col_id, most, CAST(sum(most + 1) OVER (ORDER BY col_id) - most - 1 AS BIGINT) AS first FROM limits),
sharded AS (SELECT pid, key, rank, col_id, first + least(raw, most) AS shard_id FROM raw JOIN firsts USING (col_id)),
shards AS (SELECT shard_id, col_id, count(*) AS n, min(rank) - 1 AS start, max(rank) AS stop, (count(*) + 49) // 50 AS n_pages FROM sharded GROUP BY ALL),
numbered AS (SELECT *, CAST(sum(n_pages) OVER (ORDER BY shard_id) - n_pages AS BIGINT) AS first_page FROM shards),
paged AS (SELECT s.*, first_page + (rank - 1 - start) // 50 AS page_no FROM sharded s JOIN numbered USING (shard_id))"""
)
LATTICE = """
corners AS (SELECT pid, x1, x2, least(greatest(CAST(floor((x1 - CAST(0 AS DOUBLE)) / CAST(1000 AS DOUBLE)) AS BIGINT), 0), 9) + a AS i,
  least(greatest(CAST(floor((x2 - CAST(0 AS DOUBLE)) / CAST(1000 AS DOUBLE)) AS BIGINT), 0), 9) + b AS j, a + 2 * b AS c
  FROM ev, (VALUES (0), (1)) s(a), (VALUES (0), (1)) t(b)),
inverse AS (SELECT pid, c, i + 11 * j AS node_id, CAST(1 AS DOUBLE) / (sqrt((x1 - i * 1000) * (x1 - i * 1000) + (x2 - j * 1000) * (x2 - j * 1000)) + CAST(1e-8 AS DOUBLE)) AS inv FROM corners),
weights AS (SELECT pid, node_id, inv / sum(inv) OVER (PARTITION BY pid) AS w FROM inverse)"""


def _r(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in names)


def _q(parts: list[str], body: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + body


_COUNTS = "SELECT qid, count(x1) AS n FROM boxes LEFT JOIN {pts} ON " + IN_BOX + " GROUP BY qid"
_TOP = "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, pid) AS rank FROM (SELECT qid, pid, " + DIST + " AS dist FROM asked, {pts})"
_BATCH = "batch AS (SELECT pid + 10000000 AS pid, x1, x2 FROM ev WHERE pid % 10 = 3)"
_BOX_ROUNDS = """
rounds AS (SELECT i, 100.0::DOUBLE * (1 << i) AS h FROM generate_series(0, 7) g(i)),
fits AS (SELECT qid, min(i) AS i FROM (SELECT qid, i, count(*) AS c FROM asked, rounds, ev WHERE x1 BETWEEN c1 - h AND c1 + h AND x2 BETWEEN c2 - h AND c2 + h GROUP BY ALL) WHERE c >= 10 GROUP BY qid),
boxed AS (SELECT * FROM (SELECT f.qid, pid, %s AS dist, row_number() OVER (PARTITION BY f.qid ORDER BY %s, pid) AS rank FROM fits f JOIN rounds USING (i) JOIN asked USING (qid), ev
  WHERE x1 BETWEEN c1 - h AND c1 + h AND x2 BETWEEN c2 - h AND c2 + h) WHERE rank <= 10),
variant AS (SELECT a.qid, k AS rank, b.dist FROM asked a CROSS JOIN generate_series(1, 10) g(k) LEFT JOIN boxed b ON b.qid = a.qid AND b.rank = k)""" % (DIST, DIST)
_BOXES_4D = "boxes AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join([str(b[0]), *(f"CAST({v!r} AS DOUBLE)" for v in b[1:])]) + ")" for b in BOXES_4D) + ") t(qid, lo1, lo2, lo3, lo4, hi1, hi2, hi3, hi4))"
_IN_4D = " AND ".join(f"x{k} BETWEEN lo{k} AND hi{k}" for k in range(1, 5))
_INTERVALS = """
met AS (SELECT qid, part AS cell, greatest(lo1, lb) AS a1, least(hi1, ub) AS b1, lo2, hi2, lb, ub FROM boxes JOIN splits
  ON (hi1 >= lb OR lb = 0) AND (lo1 < ub OR ub = 10000) WHERE lo1 <= hi1 AND lo2 <= hi2),
intervals AS (SELECT qid, cell,
  CAST(0.01 AS DOUBLE) * (CASE WHEN ub > lb THEN (a1 - lb) / (ub - lb) ELSE CAST(0 AS DOUBLE) END) + lo2 / CAST(10000 AS DOUBLE) * CAST(9 AS DOUBLE) + CAST(10 AS DOUBLE) * cell AS low,
  CAST(0.01 AS DOUBLE) * (CASE WHEN ub > lb THEN (b1 - lb) / (ub - lb) ELSE CAST(0 AS DOUBLE) END) + hi2 / CAST(10000 AS DOUBLE) * CAST(9 AS DOUBLE) + CAST(10 AS DOUBLE) * cell AS high FROM met)"""

_PAGES = "page_bounds AS (SELECT page_no, shard_id, min(key) AS k_low, max(key) AS k_high FROM paged GROUP BY ALL)"
_VISITED = "visited AS (SELECT DISTINCT qid, page_no FROM intervals JOIN page_bounds ON k_low <= high AND k_high >= low)"


def oracle_sql() -> dict[str, str]:
    return {
        "range_count": _q([ORD, LI, _boxes(50.0)], _COUNTS.format(pts="li")),
        "range_rows": _q([ORD, _boxes(20.0)], f"SELECT qid, pid, {_r('x1', 'x2')} FROM boxes JOIN ord ON {IN_BOX}"),
        "range_count_with_zero": _q([ORD, _boxes(-60.0)], _COUNTS.format(pts="ord")),
        "range_avg_match": _q([ORD, _boxes(50.0)], f"SELECT round(avg(n), 6) AS avg_match, count(*) AS n_queries FROM ({_COUNTS.format(pts='ord')})"),
        "range_count_4d": _q([LI4, _BOXES_4D], f"SELECT CAST(qid AS BIGINT) AS qid, count(x1) AS n FROM boxes LEFT JOIN li ON {_IN_4D} GROUP BY qid"),
        "range_brute": _q([ORD, _boxes(20.0)], _COUNTS.format(pts="ord")),
        "sphere_rows": _q([ORD, _centers()], f"SELECT qid, pid, round({DIST}, 6) AS dist FROM asked JOIN ord ON {DIST} <= r"),
        "sphere_count": _q([ORD, _centers()], f"SELECT qid, count(pid) AS n FROM asked LEFT JOIN ord ON {DIST} <= r GROUP BY qid"),
        "knn_exact": _q([ORD, _centers()], f"SELECT qid, rank, pid, round(dist, 6) AS dist FROM ({_TOP.format(pts='ord')}) WHERE rank <= 10"),
        "knn_brute": _q([ORD, EV, _centers()], f"SELECT qid, rank, pid, round(dist, 6) AS dist FROM ({_TOP.format(pts='ev')}) WHERE rank <= 10"),
        "knn_kth_radius": _q([EV, "asked AS (SELECT pid AS qid, x1 AS c1, x2 AS c2 FROM ev WHERE pid % 50 = 0)"], f"SELECT qid AS pid, round(dist, 6) AS radius FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, pid) AS rank FROM (SELECT qid, pid, {DIST} AS dist FROM asked JOIN ev ON pid <> qid)) WHERE rank = 5"),
        "knn_box_variant": _q([ORD, EV, _centers(), _BOX_ROUNDS], "SELECT qid, rank, round(dist, 6) AS dist FROM variant"),
        "knn_embeddings": "WITH asked AS (SELECT vec_id AS qid, embedding AS q FROM embeddings WHERE vec_id % 50 = 0), met AS (SELECT qid, vec_id, list_reduce(list_transform(list_zip(q, embedding), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE))), lambda a, b: a + b) AS dist2 FROM asked, embeddings) SELECT qid, rank, vec_id, round(dist2, 6) AS dist2 FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist2, vec_id) AS rank FROM met) WHERE rank <= 5",
        "recall_at_k": _q([ORD, EV, _centers(), _BOX_ROUNDS, f"truth AS (SELECT * FROM ({_TOP.format(pts='ev')}) WHERE rank <= 10)"], "SELECT round(avg(CASE WHEN abs(v.dist - t.dist) <= 1e-3 + 1e-3 * abs(t.dist) THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall FROM truth t LEFT JOIN variant v USING (qid, rank)"),
        "upper_bound_count": _q([ORD, _boxes(20.0)], "SELECT qid, count(x1) AS n FROM boxes LEFT JOIN ord ON x1 <= hi1 AND x2 <= hi2 GROUP BY qid"),
        "knn_within_radius": _q([ORD, _centers(), f"top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, pid) AS rank, count(*) OVER (PARTITION BY qid) AS held FROM (SELECT qid, pid, {DIST} AS dist FROM asked JOIN ord ON {DIST} <= r))"], "SELECT a.qid, k AS rank, round(dist, 6) AS dist FROM asked a CROSS JOIN generate_series(1, 5) g(k) LEFT JOIN top t ON t.qid = a.qid AND t.rank = k AND held >= 5"),
        "knn_doubling_radius": _q([ORD, _centers(), "radii AS (SELECT 50.0::DOUBLE * (1 << i) AS h FROM generate_series(0, 29) g(i))"], f"SELECT qid, min(h) AS r FROM (SELECT qid, h FROM asked, radii, ord WHERE {DIST} <= h GROUP BY ALL HAVING count(*) >= 10) GROUP BY qid"),
        "rescale_minmax": _q([EV], f"SELECT pid, {_r('x1', 'x2')} FROM ev"),
        "dedupe_points": _q([LI], "SELECT DISTINCT round(x1, 3) AS x1, round(x2, 3) AS x2 FROM li"),
        "clip_points": _q([EV], "SELECT pid, round(greatest(least(x1, 9000.0::DOUBLE), 1000.0::DOUBLE), 6) AS x1, round(greatest(least(x2, 9000.0::DOUBLE), 1000.0::DOUBLE), 6) AS x2 FROM ev"),
        "drop_nan": _q([EV], f"SELECT pid, {_r('x1', 'x2')} FROM ev WHERE pid % 7 <> 0 AND pid % 11 <> 0"),
        "split_static_insert_delete": _q([ORD, "marked AS (SELECT pid, row_number() OVER (ORDER BY pid) AS r, row_number() OVER (ORDER BY reverse(lpad(CAST(pid % 1000000 AS VARCHAR), 6, '0')), pid) AS s, count(*) OVER () // 2 AS half FROM ord)"], "SELECT pid, r <= half AS is_static, r > half AS is_insert, s > half AS is_delete FROM marked"),
        "axis_product": "SELECT r_regionkey, n_nationkey FROM region, nation",
        "grid_splits": _q([EV, SPLITS], f"SELECT part, {_r('lb', 'ub')} FROM splits"),
        "grid_splits_3d": _q(
            [
                EV3,
                "t0 AS (SELECT x1, ntile(6) OVER (ORDER BY x1, pid) AS tile FROM ev), e0 AS (SELECT tile, max(x1) AS ub FROM t0 GROUP BY tile)",
                "s0 AS (SELECT CAST(tile - 1 AS BIGINT) AS part, lag(ub, 1, 0.0::DOUBLE) OVER (ORDER BY tile) AS lb, CASE WHEN tile = max(tile) OVER () THEN 10000.0::DOUBLE ELSE ub END AS ub FROM e0)",
                "c0 AS (SELECT ev.*, (SELECT count(*) FROM s0 WHERE part < (SELECT max(part) FROM s0) AND ub <= x1) AS parent FROM ev)",
                "t1 AS (SELECT parent, x2, ntile(6) OVER (PARTITION BY parent ORDER BY x2, pid) AS tile FROM c0), e1 AS (SELECT parent, tile, max(x2) AS ub FROM t1 GROUP BY ALL)",
                "s1 AS (SELECT parent, CAST(tile - 1 AS BIGINT) AS part, lag(ub, 1, 0.0::DOUBLE) OVER (PARTITION BY parent ORDER BY tile) AS lb, CASE WHEN tile = max(tile) OVER (PARTITION BY parent) THEN 10000.0::DOUBLE ELSE ub END AS ub FROM e1)",
            ],
            f"SELECT 0 AS level, 0::BIGINT AS parent, part, {_r('lb', 'ub')} FROM s0 UNION ALL SELECT 1, parent, part, {_r('lb', 'ub')} FROM s1",
        ),
        "last_dim_splits": _q([EV, SPLITS.replace("x1", "x2")], f"SELECT part, {_r('lb', 'ub')} FROM splits"),
        "cell_borders": _q([EV, SPLITS], "SELECT part AS cell, round(lb, 6) AS front_0, round(ub, 6) AS back_0, round(ub - lb, 6) AS measure FROM splits"),
        "monotone_key": _q([EV, KEYED], f"SELECT pid, cell, {_r('key')} FROM keyed"),
        "key_rank": _q([EV, RANKS], "SELECT pid, rank FROM ranks"),
        "key_order_check": _q([EV, RANKS], "SELECT count(*) FILTER (WHERE key < before) AS n_inversions FROM (SELECT key, lag(key) OVER (ORDER BY rank) AS before FROM ranks)"),
        "column_boundaries": _q([EV, PLACED], "SELECT CAST(i AS BIGINT) AS col_id, round(boundary, 6) AS boundary FROM bounds"),
        "column_stats": _q([EV, PLACED], "SELECT col_id, n, cum_n, round(min_key, 6) AS min_key FROM stats"),
        "train_pairs": _q([EV, PLACED], "SELECT col_id, pos, round(t, 6) AS t FROM pairs"),
        "knots": _q([EV, PLACED], "SELECT col_id, i, pos, round(beta, 6) AS beta FROM knots"),
        "knot_predict": _q([EV, MODEL], "SELECT col_id, pos, round(predicted, 4) AS predicted FROM predicted"),
        "model_loss": _q([EV, MODEL], "SELECT col_id, round(sum((greatest(least(predicted, n), 0.0::DOUBLE) - pos) * (greatest(least(predicted, n), 0.0::DOUBLE) - pos)), 3) AS loss FROM predicted GROUP BY col_id"),
        "model_valid": _q([EV, MODEL], "SELECT col_id, bool_and(next_beta > beta OR next_beta IS NULL OR next_pos IS NULL OR i = (SELECT max(i) FROM knots k WHERE k.col_id = slopes.col_id)) AND min(slope) >= -1e-9 AS valid FROM slopes GROUP BY col_id"),
        "shard_layout": _q([EV, SHARDS], "SELECT shard_id, col_id, n FROM shards"),
        "shard_assign": _q([EV, SHARDS], "SELECT pid, shard_id FROM sharded"),
        "shards_per_column": _q([EV, SHARDS], "SELECT col_id, count(*) AS n_shards, min(shard_id) AS first_shard FROM shards GROUP BY col_id"),
        "rebuild_order": _q([EV, RANKS], "SELECT pid, rank AS place FROM ranks"),
        "page_assign": _q([EV, SHARDS], "SELECT pid, page_no FROM paged"),
        "page_split_keys": _q([EV, SHARDS], "SELECT shard_id, page_no, round(min(key), 6) AS split_key FROM paged JOIN numbered USING (shard_id) WHERE page_no > first_page GROUP BY ALL"),
        "flat_offsets": _q([EV, SHARDS], "SELECT shard_id, start, stop FROM shards"),
        "range_pages_touched": _q([EV, ORD, _boxes(100.0), SHARDS], f"SELECT qid, count(x1) AS n, count(DISTINCT page_no) AS n_pages FROM boxes LEFT JOIN (SELECT pid, page_no, x1, x2 FROM paged JOIN ev USING (pid)) ON {IN_BOX} GROUP BY qid"),
        "lookup_exact": _q([EV, SHARDS], "SELECT pid, shard_id FROM sharded"),
        "page_lookup": _q([EV, SHARDS, _PAGES], "SELECT p.pid, max(b.page_no) AS page_no FROM paged p JOIN page_bounds b ON b.shard_id = p.shard_id AND b.k_low <= p.key GROUP BY p.pid"),
        "range_by_index": _q([EV, ORD, _boxes(100.0), SHARDS, _PAGES, _INTERVALS, _VISITED, "held AS (SELECT qid, count(x1) AS n FROM boxes LEFT JOIN ev ON " + IN_BOX + " GROUP BY qid)"], "SELECT qid, any_value(n) AS n, count(page_no) AS n_pages FROM held LEFT JOIN visited USING (qid) GROUP BY qid"),
        "index_reload_range": _q([EV, ORD, _boxes(100.0), SHARDS, _PAGES, _INTERVALS, _VISITED, "held AS (SELECT qid, count(x1) AS n FROM boxes LEFT JOIN ev ON " + IN_BOX + " GROUP BY qid)"], "SELECT qid, any_value(n) AS n, count(page_no) AS n_pages FROM held LEFT JOIN visited USING (qid) GROUP BY qid"),
        "index_update_range": _q([EV, ORD, _BATCH, _boxes(100.0), "left_over AS (SELECT x1, x2 FROM ev UNION ALL SELECT x1, x2 FROM batch EXCEPT ALL SELECT x1, x2 FROM ev WHERE pid % 10 = 4)"], _COUNTS.format(pts="left_over")),
        "knn_by_radius": _q([ORD, EV, _centers()], f"SELECT qid, rank, pid, round(dist, 6) AS dist FROM ({_TOP.format(pts='ev')}) WHERE rank <= 10"),
        "dominance_check": _q([EV, RANKS], "SELECT count(*) FILTER (WHERE x1 <= b1 AND x2 <= b2 AND (x1 < b1 OR x2 < b2)) AS n_dominated FROM (SELECT x1, x2, lag(x1) OVER o AS b1, lag(x2) OVER o AS b2 FROM ranks WINDOW o AS (ORDER BY rank))"),
        "split_order_check": _q([EV, SPLITS], "SELECT count(*) FILTER (WHERE ub <= before) AS n_flat FROM (SELECT ub, lag(ub) OVER (ORDER BY part) AS before FROM splits)"),
        "csv_points": _q([EV], f"SELECT {_r('x1', 'x2')} FROM ev"),
        "text_boxes": _q([ORD, _boxes(50.0)], f"SELECT {_r('lo1', 'lo2', 'hi1', 'hi2', digits=4)} FROM boxes"),
        "text_map": "SELECT n_name AS key, n_nationkey::BIGINT AS value FROM nation",
        "pages_in_intervals": _q([EV, ORD, _boxes(100.0), SHARDS, _PAGES, _INTERVALS, _VISITED], "SELECT qid, page_no FROM visited"),
        "range_cell_intervals": _q([EV, ORD, _boxes(100.0), SPLITS, _INTERVALS], f"SELECT qid, cell, {_r('low', 'high')} FROM intervals"),
        "interval_union": _q(
            [EV, ORD, _boxes(100.0).replace("boxes AS", "narrow AS"), "boxes AS (SELECT qid, lo1, 0.0::DOUBLE AS lo2, hi1, 10000.0::DOUBLE AS hi2 FROM narrow)", SPLITS, _INTERVALS,
             "marked AS (SELECT *, CASE WHEN low - max(high) OVER (PARTITION BY qid ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 2.0 THEN 0 ELSE 1 END AS fresh FROM intervals)",
             "islands AS (SELECT *, sum(fresh) OVER (PARTITION BY qid ORDER BY low, high) AS island FROM marked)"],
            "SELECT qid, round(min(low), 6) AS low, round(max(high), 6) AS high FROM islands GROUP BY qid, island",
        ),
        "insert_batch": _q([EV, _BATCH], f"SELECT pid, {_r('x1', 'x2')} FROM ev UNION ALL SELECT pid, {_r('x1', 'x2')} FROM batch"),
        "insert_then_range": _q([EV, ORD, _BATCH, _boxes(100.0), "everything AS (SELECT * FROM ev UNION ALL SELECT * FROM batch)"], _COUNTS.format(pts="everything")),
        "insert_placed": _q([EV, PLACED, "batch_cells AS (SELECT pid, (SELECT count(*) FROM bounds WHERE boundary <= k.key) AS col_id FROM keyed k WHERE pid % 10 = 3)"], "SELECT col_id, count(*) AS n FROM (SELECT col_id FROM placed UNION ALL SELECT col_id FROM batch_cells) GROUP BY col_id"),
        "insert_shards": _q(
            [
                EV, SHARDS,
                "batch AS (SELECT pid + 10000000 AS pid, key, (SELECT count(*) FROM bounds WHERE boundary <= k.key) AS col_id FROM keyed k WHERE pid % 10 = 3)",
                "sent AS (SELECT b.*, list_reduce(list_transform(list_zip(alphas, betas), lambda z: z[1] * greatest(b.key - s.min_key - z[2], CAST(0 AS DOUBLE))), lambda a, b: a + b) AS predicted FROM batch b JOIN stats s USING (col_id) JOIN model USING (col_id))",
                "every AS (SELECT pid, shard_id FROM sharded UNION ALL SELECT pid, first + least(greatest(CAST(floor(predicted / 50) AS BIGINT), 0), most) FROM sent JOIN firsts USING (col_id))",
                "sized AS (SELECT shard_id, count(*) AS n, (count(*) + 49) // 50 AS n_pages FROM every GROUP BY shard_id)",
            ],
            "SELECT shard_id, n, CAST(sum(n) OVER o - n AS BIGINT) AS start, n_pages, CAST(sum(n_pages) OVER o - n_pages AS BIGINT) AS first_page FROM sized WINDOW o AS (ORDER BY shard_id)",
        ),
        "delete_tolerance": _q(
            [
                EV,
                "targets AS (SELECT x1 + 4e-8::DOUBLE AS t1, x2 + 4e-8::DOUBLE AS t2 FROM ev WHERE pid % 10 = 4 UNION ALL SELECT x1 + 3e-7::DOUBLE, x2 + 3e-7::DOUBLE FROM ev WHERE pid % 10 = 5)",
                "numbered AS (SELECT t1, t2, count(*) AS n FROM targets GROUP BY ALL)",
                "first AS (SELECT n, min((x1, x2)) AS p FROM numbered JOIN ev ON x1 BETWEEN t1 - 2e-7::DOUBLE AND t1 + 2e-7::DOUBLE AND abs(x1 - t1) <= 1e-7::DOUBLE AND abs(x2 - t2) <= 1e-7::DOUBLE GROUP BY t1, t2, n)",
                "wanted AS (SELECT p, sum(n) AS n FROM first GROUP BY p)",
            ],
            "SELECT pid FROM (SELECT pid, n, row_number() OVER (PARTITION BY x1, x2 ORDER BY pid) AS i FROM ev LEFT JOIN wanted ON p = (x1, x2)) WHERE n IS NULL OR i > n",
        ),
        "delete_batch": _q([EV], "SELECT round(x1, 6) AS x1, round(x2, 6) AS x2, count(*) AS n FROM (SELECT x1, x2 FROM ev EXCEPT ALL SELECT x1, x2 FROM ev WHERE pid % 10 = 4) GROUP BY ALL"),
        "delete_batch_dups": _q([EV, "targets AS (SELECT x1, x2, count(*) AS n FROM (SELECT x1, x2 FROM ev WHERE pid % 10 = 4 UNION ALL SELECT x1, x2 FROM ev WHERE pid % 50 = 4) GROUP BY ALL)"], "SELECT pid FROM (SELECT pid, n, row_number() OVER (PARTITION BY ev.x1, ev.x2 ORDER BY pid) AS i FROM ev LEFT JOIN targets t ON t.x1 = ev.x1 AND t.x2 = ev.x2) WHERE n IS NULL OR i > n"),
        "insert_delete_roundtrip": _q([EV], "SELECT count(*) AS n, count(DISTINCT (x1, x2)) AS n_distinct FROM ev"),
        "lattice_nodes": "SELECT i + 11 * j AS node_id, CAST(i * 1000 AS DOUBLE) AS c1, CAST(j * 1000 AS DOUBLE) AS c2 FROM generate_series(0, 10) a(i), generate_series(0, 10) b(j)",
        "laplacian": "WITH n AS (SELECT i + 11 * j AS a, i, j FROM generate_series(0, 10) a(i), generate_series(0, 10) b(j)), e AS (SELECT x.a, y.a AS b FROM n x JOIN n y ON abs(x.i - y.i) + abs(x.j - y.j) = 1), v AS (SELECT a, b, -1.0::DOUBLE AS v FROM e UNION ALL SELECT a, a, CAST(count(*) AS DOUBLE) FROM e GROUP BY a) SELECT a, b, round(v / (SELECT count(*) FROM e) * 2, 9) AS value FROM v",
        "corner_weights": _q([EV, LATTICE], "SELECT pid, node_id, round(w, 6) AS w FROM weights"),
        "lattice_predict": _q([EV, LATTICE], "SELECT pid, round(sum(w * (node_id % 11 * 2000 + node_id // 11 * 1000 + 1)), 4) AS y FROM weights GROUP BY pid"),
        "metrics_unpivot": "WITH w AS (SELECT n_regionkey, CAST(count(*) AS DOUBLE) AS n, avg(n_nationkey) AS mean, stddev_pop(n_nationkey) AS std FROM nation GROUP BY n_regionkey) SELECT n_regionkey, 'n' AS metric, round(n, 6) AS value FROM w UNION ALL SELECT n_regionkey, 'mean', round(mean, 6) FROM w UNION ALL SELECT n_regionkey, 'std', round(std, 6) FROM w",
        "metrics_report": "WITH w AS (SELECT n_regionkey, CAST(count(*) AS DOUBLE) AS n, avg(n_nationkey) AS mean FROM nation GROUP BY n_regionkey) SELECT n_regionkey || ': mean=' || printf('%.3f', mean) || '  n=' || printf('%.3f', n) || '  std=n/a' AS line FROM w",
        "text_helpers": "SELECT n_name, n_name || ' x' AS joined, n_name AS stripped, true AS marks, regexp_matches(n_name, '^[A-M]') AS early FROM nation",
    }

"""The pN_ queries of the general problems, over whole tables with production parameters."""

from __future__ import annotations

from lodegraph.pipeline import reconcile as rc
from lodegraph.pipeline import references as rf
from lodegraph.pipeline import shredding as sh
from lodegraph.pipeline import snapshot_changes as sc
from lodegraph.tables import load


def p1_found(spark, d):
    return sc.snapshot_changes(
        {"entities": (load(spark, d, "entities"), "span"), "relationships": (load(spark, d, "relationships"), "confidence")},
        load(spark, d, "snapshots"),
    )


def p1_rates(spark, d):
    return sc.change_rates(p1_found(spark, d))


def p2_found(spark, d):
    return rf.orphan_references(*(load(spark, d, t) for t in ("entities", "relationships", "text_units")))


def p2_report(spark, d):
    return rf.orphan_report(p2_found(spark, d), load(spark, d, "snapshots"))


def p3_found(spark, d):
    links = sh.child_links(load(spark, d, "clang_asts"))
    return links.withColumnRenamed("record_id", "ast_id")


def p3_kinds(spark, d):
    return sh.kind_report(load(spark, d, "clang_asts"))


def p5_found(spark, d):
    names = ("entities", "relationships", "entities_export", "relationships_export", "snapshots")
    return rc.graph_export_differences(*(load(spark, d, t) for t in names))


def p5_rates(spark, d):
    return rc.difference_rates(p5_found(spark, d))


QUERIES = {f.__name__: f for f in (p1_found, p1_rates, p2_found, p2_report, p3_found, p3_kinds, p5_found, p5_rates)}

P1_SQL = """
WITH s AS (
  SELECT graph_name, snapshot_id, row_number() OVER (PARTITION BY graph_name ORDER BY min(created_at), snapshot_id) AS o,
         count(*) OVER (PARTITION BY graph_name) AS n
  FROM snapshots WHERE created_at IS NOT NULL GROUP BY graph_name, snapshot_id),
r AS (
  SELECT DISTINCT 'entities' AS table_name, graph_name, snapshot_id, id, span AS v FROM entities
  UNION ALL
  SELECT DISTINCT 'relationships', graph_name, snapshot_id, id,
         CAST(CASE WHEN isnan(confidence) THEN NULL ELSE confidence END AS VARCHAR) FROM relationships),
p AS (SELECT r.*, s.o, s.n FROM r JOIN s USING (graph_name, snapshot_id)),
e AS (
  SELECT b.table_name, b.graph_name, b.o, b.id, CASE WHEN a.id IS NULL THEN 'added' ELSE 'changed' END AS change_kind
  FROM p b LEFT JOIN p a ON a.table_name = b.table_name AND a.graph_name = b.graph_name AND a.id = b.id AND a.o = b.o - 1
  WHERE b.o > 1 AND (a.id IS NULL OR a.v IS DISTINCT FROM b.v)
  UNION ALL
  SELECT a.table_name, a.graph_name, a.o + 1, a.id, 'removed'
  FROM p a LEFT JOIN p b ON a.table_name = b.table_name AND a.graph_name = b.graph_name AND a.id = b.id AND a.o = b.o - 1
  WHERE a.o < a.n AND b.id IS NULL)
SELECT DISTINCT e.table_name, e.graph_name, s.snapshot_id, e.id AS record_id, e.change_kind
FROM e JOIN s ON s.graph_name = e.graph_name AND s.o = e.o
"""

P2_SQL = """
WITH t AS (SELECT DISTINCT graph_name, snapshot_id, title AS v FROM entities WHERE title IS NOT NULL
           UNION SELECT DISTINCT graph_name, snapshot_id, id FROM entities WHERE id IS NOT NULL),
i AS (SELECT DISTINCT graph_name, snapshot_id, id AS v FROM entities WHERE id IS NOT NULL),
r AS (SELECT graph_name, snapshot_id, id AS record_id, 'source' AS ref_field, source AS v FROM relationships
      UNION ALL SELECT graph_name, snapshot_id, id, 'target', target FROM relationships)
SELECT DISTINCT 'relationships' AS table_name, graph_name, snapshot_id, record_id, ref_field
FROM r ANTI JOIN t USING (graph_name, snapshot_id, v) WHERE v IS NOT NULL AND v <> ''
UNION ALL
SELECT DISTINCT 'text_units', graph_name, snapshot_id, id, 'entity_id'
FROM (SELECT graph_name, snapshot_id, id, entity_id AS v FROM text_units) u ANTI JOIN i USING (graph_name, snapshot_id, v)
WHERE v IS NOT NULL AND v <> ''
"""

_TRUTH = (
    "CASE WHEN lower(trim({c})) IN ('true','t','yes','y','1','on') THEN 'true'"
    " WHEN lower(trim({c})) IN ('false','f','no','n','0','off') THEN 'false' ELSE {c} END"
)
P5_SQL = f"""
WITH last AS (SELECT graph_name, arg_max(snapshot_id, created_at) AS snapshot_id FROM snapshots GROUP BY 1),
ge AS (SELECT DISTINCT graph_name, id, title, CAST(is_deterministic AS VARCHAR) AS det, CAST(dynamic_dependent AS VARCHAR) AS dyn
       FROM entities SEMI JOIN last USING (graph_name, snapshot_id)),
xe AS (SELECT DISTINCT graph_name, id, title, {_TRUTH.format(c="is_deterministic")} AS det, {_TRUTH.format(c="dynamic_dependent")} AS dyn
       FROM entities_export),
gr AS (SELECT DISTINCT graph_name, id, resolved_target_hint AS hint FROM relationships SEMI JOIN last USING (graph_name, snapshot_id)),
xr AS (SELECT DISTINCT graph_name, id, resolved_target_hint AS hint FROM relationships_export),
je AS (SELECT ge.*, xe.title AS t2, xe.det AS d2, xe.dyn AS y2 FROM ge JOIN xe USING (graph_name, id)),
jr AS (SELECT gr.*, xr.hint AS h2 FROM gr JOIN xr USING (graph_name, id))
SELECT 'entities' AS table_name, graph_name, id AS record_id, 'only_in_graph' AS diff_kind FROM ge ANTI JOIN xe USING (graph_name, id)
UNION SELECT 'entities', graph_name, id, 'only_in_export' FROM xe ANTI JOIN ge USING (graph_name, id)
UNION SELECT 'relationships', graph_name, id, 'only_in_graph' FROM gr ANTI JOIN xr USING (graph_name, id)
UNION SELECT 'relationships', graph_name, id, 'only_in_export' FROM xr ANTI JOIN gr USING (graph_name, id)
UNION SELECT 'entities', graph_name, id, 'title' FROM je WHERE title IS DISTINCT FROM t2
UNION SELECT 'entities', graph_name, id, 'is_deterministic' FROM je WHERE det IS DISTINCT FROM d2
UNION SELECT 'entities', graph_name, id, 'dynamic_dependent' FROM je WHERE dyn IS DISTINCT FROM y2
UNION SELECT 'relationships', graph_name, id, 'resolved_target_hint' FROM jr WHERE hint IS DISTINCT FROM h2
"""

P3_SQL = """
WITH RECURSIVE good AS (
  SELECT DISTINCT ast_id, CAST(ast_json AS JSON) AS j FROM clang_asts
  WHERE json_valid(ast_json) AND json_type(CASE WHEN json_valid(ast_json) THEN ast_json END) = 'OBJECT'),
n AS (
  SELECT ast_id, '0' AS node_path, CAST(NULL AS VARCHAR) AS parent_path, j FROM good
  UNION ALL
  SELECT ast_id, node_path || '.' || CAST(i AS VARCHAR), node_path, e FROM (
    SELECT ast_id, node_path, unnest(kids) AS e, generate_subscripts(kids, 1) - 1 AS i FROM (
      SELECT ast_id, node_path, CASE json_type(j->'inner') WHEN 'ARRAY' THEN CAST(j->'inner' AS JSON[])
        WHEN 'OBJECT' THEN [j->'inner'] ELSE CAST([] AS JSON[]) END AS kids FROM n))
  WHERE json_type(e) = 'OBJECT')
SELECT DISTINCT ast_id, parent_path, node_path FROM n WHERE parent_path IS NOT NULL
"""

SQL = {
    "p1_found": P1_SQL,
    "p1_rates": f"SELECT table_name, graph_name, snapshot_id, change_kind, count(*) AS n_records FROM ({P1_SQL}) GROUP BY ALL",
    "p2_found": P2_SQL,
    "p2_report": f"""
SELECT table_name, ref_field, date_trunc('month', created_at)::TIMESTAMP AS period, CAST(sum(n) AS BIGINT) AS n_orphans, count(*) AS n_snapshots
FROM (SELECT table_name, ref_field, graph_name, snapshot_id, count(*) AS n FROM ({P2_SQL}) GROUP BY ALL)
LEFT JOIN (SELECT graph_name, snapshot_id, min(created_at) AS created_at FROM snapshots GROUP BY ALL) USING (graph_name, snapshot_id)
GROUP BY ALL""",
    "p3_found": P3_SQL,
    "p3_kinds": P3_SQL.replace("SELECT DISTINCT ast_id, parent_path, node_path FROM n WHERE parent_path IS NOT NULL", """,
k AS (SELECT DISTINCT ast_id, node_path, CASE WHEN json_type(j->'kind') = 'VARCHAR' THEN j->>'kind' END AS kind, CASE WHEN json_type(j->'loc'->'file') = 'VARCHAR' THEN j->'loc'->>'file' END AS file FROM n)
SELECT kind, count(*) AS n_nodes, count(DISTINCT ast_id) AS n_records, CAST(max(len(string_split(node_path, '.')) - 1) AS INT) AS max_depth, count(file) AS n_files FROM k GROUP BY kind"""),
    "p5_found": P5_SQL,
    "p5_rates": f"SELECT table_name, graph_name, diff_kind, count(*) AS n_records FROM ({P5_SQL}) GROUP BY ALL",
}

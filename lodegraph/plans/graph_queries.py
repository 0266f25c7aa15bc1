"""Queries over the newest snapshot of every graph, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodegraph.current import current
from lodegraph.functions import text as tx
from lodegraph.functions.spans import call_line, first_line, last_line
from lodegraph.operators import audit, diff, lookup, measures, traverse, windows
from lodegraph.tables import load, once

HUB = "runtime_log:emit"
QUERIES: dict = {}
SQL: dict[str, str] = {}

_LAST = "last AS (SELECT graph_name, arg_max(snapshot_id, created_at) AS snapshot_id FROM snapshots GROUP BY 1)"


def _cur(name: str, columns: str, alias: str) -> str:
    return f"{alias} AS (SELECT DISTINCT graph_name, {columns} FROM {name} SEMI JOIN last USING (graph_name, snapshot_id))"


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that DuckDB answers it by."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _edges(spark, d, *more):
    return current(spark, d, "relationships", "source", "target", "type", *more)


def _entities(spark, d, *more):
    return current(spark, d, "entities", "id", "title", "type", *more)


def _one_hop_sql(here: str, there: str, kind: str | None) -> str:
    test = f" AND type = '{kind}'" if kind else ""
    return f"WITH {_LAST} SELECT DISTINCT graph_name, {there} AS title FROM relationships SEMI JOIN last USING (graph_name, snapshot_id) WHERE {here} = '{HUB}'{test} AND {there} IS NOT NULL"


# --- scans and envelopes -------------------------------------------------------------------------


@query("""
SELECT graph_name, snapshot_id, 'entities' AS table_name, count(DISTINCT id) AS n_rows FROM entities GROUP BY ALL
UNION ALL SELECT graph_name, snapshot_id, 'relationships', count(DISTINCT id) FROM relationships GROUP BY ALL
UNION ALL SELECT graph_name, snapshot_id, 'text_units', count(DISTINCT id) FROM text_units GROUP BY ALL""")
def snapshot_table_scan(spark, d):
    parts = [
        load(spark, d, t).groupBy("graph_name", "snapshot_id").agg(F.countDistinct("id").alias("n_rows"))
        .select("graph_name", "snapshot_id", F.lit(t).alias("table_name"), "n_rows")
        for t in ("entities", "relationships", "text_units")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""
WITH s AS (SELECT graph_name, snapshot_id, max(counts) AS counts FROM snapshots GROUP BY ALL),
a AS (SELECT 'entities' AS table_name, graph_name, snapshot_id, count(DISTINCT id) AS actual FROM entities GROUP BY ALL
 UNION ALL SELECT 'relationships', graph_name, snapshot_id, count(DISTINCT id) FROM relationships GROUP BY ALL
 UNION ALL SELECT 'text_units', graph_name, snapshot_id, count(DISTINCT id) FROM text_units GROUP BY ALL),
p AS (SELECT graph_name, snapshot_id, 'entities' AS table_name, counts.entities AS stated FROM s
 UNION ALL SELECT graph_name, snapshot_id, 'relationships', counts.relationships FROM s
 UNION ALL SELECT graph_name, snapshot_id, 'text_units', counts.text_units FROM s)
SELECT graph_name, snapshot_id, table_name, stated, coalesce(actual, 0) AS actual FROM p LEFT JOIN a USING (graph_name, snapshot_id, table_name)
WHERE stated IS DISTINCT FROM coalesce(actual, 0)""")
def envelope_counts(spark, d):
    tables = {t: load(spark, d, t).select("graph_name", "snapshot_id", "id").distinct() for t in ("entities", "relationships", "text_units")}
    return measures.envelope_counts(load(spark, d, "snapshots"), tables)


@query("""
SELECT DISTINCT graph_name, snapshot_id, code FROM (
 SELECT graph_name, snapshot_id, unnest([
  CASE WHEN schema_version IS DISTINCT FROM 1 THEN 'invalid_schema_version' END,
  CASE WHEN snapshot_id IS NULL OR regexp_matches(snapshot_id, '^\\s*$|^\\.|[/\\\\]') THEN 'invalid_snapshot_id' END,
  CASE WHEN created_at IS NULL THEN 'invalid_created_at' END,
  CASE WHEN counts IS NULL OR least(counts.entities, counts.relationships, counts.text_units, counts.call_observations) < 0 THEN 'invalid_counts' END,
  CASE WHEN files IS NULL THEN 'invalid_files' END,
  CASE WHEN NOT list_has_all(coalesce(files, []), ['entities.parquet','relationships.parquet','text_units.parquet']) THEN 'missing_required_file' END,
  CASE WHEN counts.call_observations > 0 AND NOT list_contains(files, 'call_observations.parquet') THEN 'missing_observation_file' END,
  CASE WHEN counts.call_observations = 0 AND list_contains(files, 'call_observations.parquet') THEN 'zero_row_observation_file' END,
  CASE WHEN total_size_bytes IS NULL OR total_size_bytes < 0 THEN 'invalid_total_size_bytes' END,
  CASE WHEN corpus_hash IS NOT NULL THEN 'invalid_corpus_hash' END,
  CASE WHEN git_commit IS NOT NULL AND NOT regexp_matches(git_commit, '^[0-9a-f]{40}$') THEN 'invalid_git_commit' END,
  CASE WHEN source_root IS NULL OR trim(source_root) = '' THEN 'invalid_source_root' END]) AS code FROM snapshots) WHERE code IS NOT NULL""")
def envelope_anomalies(spark, d):
    return measures.envelope_anomalies(load(spark, d, "snapshots"))


# --- lookup --------------------------------------------------------------------------------------

_RESOLVE = [HUB, "runtime_log", "RUNTIME_LOG:EM", "emit$", "no_such_symbol"]


def _resolve_sql(strict: bool) -> str:
    parts = []
    for q in _RESOLVE:
        fits = {
            "exact": f"title = '{q}'",
            "module": f"(type = 'module' AND (title IN ('{q}', '{q}:{q}', '{q}:__module__') OR suffix(title, ':{q}')))",
            "pattern": f"regexp_matches(title, '(?i){q}')",
        }
        ns = ", ".join(f"count(*) FILTER ({t}) AS n_{k}, max(title) FILTER ({t}) AS t_{k}" for k, t in fits.items())
        op = ">=" if strict else "="
        case = lambda f, other: "CASE " + " ".join(f"WHEN n_{k} {op} 1 THEN {f(k)}" for k in fits) + f" ELSE {other} END"
        title = case(lambda k: f"CASE WHEN n_{k} = 1 THEN t_{k} END", "NULL")
        parts.append(
            f"SELECT graph_name, '{q}' AS query, {title} AS title, {case(lambda k: repr(k), 'NULL')} AS stage, {case(lambda k: f'n_{k}', 'n_pattern')} AS candidates"
            f" FROM (SELECT graph_name, {ns} FROM e GROUP BY 1)"
        )
    return f"WITH {_LAST}, {_cur('entities', 'title, type', 'e')} " + " UNION ALL ".join(parts)


@query(_resolve_sql(False))
def resolve_symbol(spark, d):
    return lookup.resolve(_entities(spark, d), _RESOLVE)


@query(_resolve_sql(True))
def find_entity(spark, d):
    return lookup.resolve(_entities(spark, d), _RESOLVE, strict=True)


@query(f"""
WITH {_LAST} SELECT DISTINCT graph_name, title, type, description, source_file, span, substring(snippet, 1, 200) AS snippet
FROM entities SEMI JOIN last USING (graph_name, snapshot_id) WHERE title = '{HUB}'""")
def symbol_lookup(spark, d):
    return lookup.symbol_card(_entities(spark, d, "description", "source_file", "span", "snippet"), HUB).distinct()


@query(_one_hop_sql("target", "source", "calls"))
def callers(spark, d):
    return lookup.callers(_edges(spark, d), HUB)


@query(_one_hop_sql("source", "target", "calls"))
def callees(spark, d):
    return lookup.callees(_edges(spark, d), HUB)


@query(_one_hop_sql("source", "target", "uses_type"))
def types_used_by(spark, d):
    return lookup.types_used_by(_edges(spark, d), HUB)


@query(f"""WITH {_LAST}, {_cur('relationships', 'source, target, type', 'r')}, u AS (SELECT target FROM r WHERE type = 'uses_type' AND target <> '' GROUP BY 1 ORDER BY count(*) DESC, target LIMIT 1)
SELECT DISTINCT graph_name, source AS title FROM r WHERE type = 'uses_type' AND target = (SELECT target FROM u) AND source IS NOT NULL""")
def type_users(spark, d):
    """Users of the most used type of the newest snapshots."""
    edges = _edges(spark, d)
    most = edges.where("type = 'uses_type' and target <> ''").groupBy("target").count().orderBy(F.desc("count"), "target").first()
    return lookup.type_users(edges, most["target"] if most else "")


_NEIGHBORS = f"""
WITH {_LAST}, {_cur('relationships', 'source, target', 'r')}
SELECT DISTINCT graph_name, 'incoming' AS direction, source AS title FROM r WHERE target = '{HUB}' AND source IS NOT NULL
UNION ALL SELECT DISTINCT graph_name, 'outgoing', target FROM r WHERE source = '{HUB}' AND target IS NOT NULL"""


@query(_NEIGHBORS)
def neighbors(spark, d):
    return lookup.neighbors(_edges(spark, d), HUB)


@query(_NEIGHBORS)
def subgraph(spark, d):
    return lookup.subgraph(_edges(spark, d), HUB)


_OBS = "source, display_target, confidence, reason, source_file, span"


@query(f"""WITH {_LAST}, {_cur('call_observations', _OBS, 'o')}
SELECT * FROM o WHERE source = 'runtime_log:__module__' OR source = 'runtime_log' OR starts_with(source, 'runtime_log:')""")
def module_observations(spark, d):
    return lookup.observations(current(spark, d, "call_observations", *_OBS.split(", ")), "runtime_log:__module__", "module")


@query(f"WITH {_LAST}, {_cur('call_observations', _OBS, 'o')} SELECT * FROM o WHERE source = '{HUB}' OR starts_with(source, '{HUB}.')")
def symbol_observations(spark, d):
    return lookup.observations(current(spark, d, "call_observations", *_OBS.split(", ")), HUB)


@query(f"""WITH {_LAST}, {_cur('relationships', 'id, source, target, type', 'r')}
SELECT * FROM r WHERE source IN ('{HUB}', 'ent:fn:{HUB}') OR target IN ('{HUB}', 'ent:fn:{HUB}')""")
def pack_neighbors(spark, d):
    return lookup.incident_edges(_edges(spark, d, "id"), HUB, f"ent:fn:{HUB}").select("graph_name", "id", "source", "target", "type")


@query(f"""WITH {_LAST}, {_cur('entities', 'title, text_unit_ids', 'e')}, {_cur('text_units', 'id, n_tokens', 't')},
w AS (SELECT DISTINCT graph_name, unnest(text_unit_ids) AS id FROM e WHERE title = '{HUB}')
SELECT t.* FROM t SEMI JOIN w USING (graph_name, id)""")
def pack_text_units(spark, d):
    owners = current(spark, d, "entities", "title", "text_unit_ids").where(F.col("title") == HUB)
    return lookup.text_units_of(current(spark, d, "text_units", "id", "n_tokens"), owners)


@query(f"WITH {_LAST}, {_cur('entities', 'id, title, type', 'e')} SELECT graph_name, type, count(*) AS n FROM e WHERE type NOT IN ('class','module','file') GROUP BY ALL")
def packable_symbols(spark, d):
    return lookup.packable(_entities(spark, d)).groupBy("graph_name", "type").agg(F.count(F.lit(1)).alias("n"))


# --- spans and scalar functions ------------------------------------------------------------------


@query(f"""WITH {_LAST}, {_cur('entities', 'id, span', 'e')}, {_cur('relationships', 'id, span', 'r')}
SELECT graph_name, id, CASE WHEN regexp_matches(span, '^[0-9]+:[0-9]+(-[0-9]+:[0-9]+)?$') THEN TRY_CAST(regexp_extract(span, '^([0-9]+)', 1) AS INT) END AS first_line,
 CASE WHEN regexp_matches(span, '^[0-9]+:[0-9]+-[0-9]+:[0-9]+$') THEN TRY_CAST(regexp_extract(span, '-([0-9]+):', 1) AS INT)
      WHEN regexp_matches(span, '^[0-9]+:[0-9]+$') THEN TRY_CAST(regexp_extract(span, '^([0-9]+)', 1) AS INT) END AS last_line,
 TRY_CAST(nullif(regexp_extract(span, '^\\s*([0-9]+)\\s*(:|$)', 1), '') AS INT) AS call_line
FROM (SELECT * FROM e UNION ALL SELECT * FROM r)""")
def span_parse(spark, d):
    both = current(spark, d, "entities", "id", "span").unionByName(current(spark, d, "relationships", "id", "span"))
    s = F.col("span")
    return both.select("graph_name", "id", first_line(s).alias("first_line"), last_line(s).alias("last_line"), call_line(s).alias("call_line"))


@query(f"""WITH {_LAST}, {_cur('entities', 'title, source_file', 'e')}, {_cur('text_units', 'id, text, n_tokens', 't')}
SELECT graph_name, title AS name, regexp_replace(regexp_replace(title, '[^A-Za-z0-9_.:\\-]+', '_', 'g'), '^_+|_+$', '', 'g') AS value FROM e
UNION ALL SELECT graph_name, source_file, replace(regexp_replace(regexp_replace(source_file, '\\.py$', ''), '/__init__$', ''), '/', '.') FROM e WHERE source_file IS NOT NULL
UNION ALL SELECT graph_name, id, CAST(greatest(1, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))) AS VARCHAR) FROM t WHERE text IS NOT NULL""")
def scalar_functions(spark, d):
    e = current(spark, d, "entities", "title", "source_file")
    t = current(spark, d, "text_units", "id", "text", "n_tokens").where("text is not null")
    return (
        e.select("graph_name", F.col("title").alias("name"), tx.slug(F.col("title")).alias("value"))
        .unionByName(e.where("source_file is not null").select("graph_name", F.col("source_file").alias("name"), tx.module_key(F.col("source_file")).alias("value")))
        .unionByName(t.select("graph_name", F.col("id").alias("name"), tx.n_tokens(F.col("text")).cast("string").alias("value")))
    )


@query(f"""WITH {_LAST}, {_cur('relationships', 'source, target, type', 'r')}
SELECT graph_name, source, target, left(sha256('depends_on' || chr(0) || source || chr(0) || target), 12) AS digest FROM r WHERE type = 'depends_on' AND source IS NOT NULL AND target IS NOT NULL""")
def edge_digests(spark, d):
    e = _edges(spark, d).where("type = 'depends_on' and source is not null and target is not null")
    return e.select("graph_name", "source", "target", tx.short_digest(F.lit("depends_on"), F.col("source"), F.col("target")).alias("digest"))


@query("""SELECT graph_name, sha256(string_agg(printf('%016X', octet_length(encode(snapshot_id))) || snapshot_id, '' ORDER BY encode(snapshot_id))) AS fingerprint
FROM (SELECT DISTINCT graph_name, snapshot_id FROM snapshots) GROUP BY 1""")
def index_fingerprint(spark, d):
    s = load(spark, d, "snapshots").groupBy("graph_name").agg(F.sort_array(F.collect_set("snapshot_id")).alias("ids"))
    return s.select("graph_name", tx.fingerprint(F.col("ids")).alias("fingerprint"))


@query("SELECT DISTINCT snapshot_id, trim(snapshot_id) <> '' AND NOT regexp_matches(snapshot_id, '^\\.|[/\\\\\\s]') AS published FROM snapshots")
def published_ids(spark, d):
    return load(spark, d, "snapshots").select("snapshot_id", tx.published_id(F.col("snapshot_id")).alias("published")).distinct()


# --- audits --------------------------------------------------------------------------------------

_AUDIT = f"""{_LAST}, {_cur('entities', 'title, span', 'e0')}, {_cur('relationships', 'id, source, target, span, type', 'r0')},
e AS (SELECT graph_name, title, max(span) AS caller_span FROM e0 GROUP BY ALL), c AS (SELECT * FROM r0 WHERE type = 'calls'),
j AS (SELECT c.*, e.title IS NOT NULL AS known, CASE WHEN regexp_matches(caller_span, '^[0-9]+:[0-9]+(-[0-9]+:[0-9]+)?$') THEN TRY_CAST(regexp_extract(caller_span, '^([0-9]+)', 1) AS INT) END AS a,
 coalesce(CASE WHEN regexp_matches(caller_span, '^[0-9]+:[0-9]+-[0-9]+:[0-9]+$') THEN TRY_CAST(regexp_extract(caller_span, '-([0-9]+):', 1) AS INT) END,
  CASE WHEN regexp_matches(caller_span, '^[0-9]+:[0-9]+$') THEN TRY_CAST(regexp_extract(caller_span, '^([0-9]+)', 1) AS INT) END) AS b,
 TRY_CAST(nullif(regexp_extract(span, '^\\s*([0-9]+)\\s*(:|$)', 1), '') AS INT) AS line FROM c LEFT JOIN e ON e.graph_name = c.graph_name AND e.title = c.source),
an AS (SELECT graph_name, CASE WHEN NOT known THEN 'no_caller_entity' WHEN a IS NULL THEN 'caller_no_span' WHEN line IS NOT NULL AND NOT (line BETWEEN a AND b) THEN 'span_outside_caller' END AS kind, source, target, span, a, b FROM j),
dt AS (SELECT c.graph_name, c.source, c.target, c.span FROM c WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.graph_name = c.graph_name AND e.title = c.target))"""


def _calls(spark, d, *more):
    return _edges(spark, d, "id", "span", *more).where("type = 'calls'")


@query(f"WITH {_AUDIT} SELECT graph_name, kind, source, target, span, CASE WHEN kind = 'span_outside_caller' THEN a || '-' || b END AS caller_range FROM an WHERE kind IS NOT NULL")
def structural_audit(spark, d):
    return audit.structural_audit(current(spark, d, "entities", "title", "span"), _calls(spark, d))


@query(f"WITH {_AUDIT} SELECT * FROM dt")
def dangling_targets(spark, d):
    return audit.dangling_targets(current(spark, d, "entities", "title"), _calls(spark, d))


@query(f"""WITH {_AUDIT} SELECT g.graph_name, coalesce(n, 0) AS n_calls, coalesce(x, 0) AS n_anomalies, coalesce(y, 0) AS n_dangling,
 CASE WHEN coalesce(n, 0) = 0 THEN 1.0 ELSE round(CAST(n - coalesce(x, 0) - coalesce(y, 0) AS DOUBLE) / n, 4) END AS pass_rate
FROM (SELECT DISTINCT graph_name FROM e) g LEFT JOIN (SELECT graph_name, count(*) AS n FROM c GROUP BY 1) USING (graph_name)
LEFT JOIN (SELECT graph_name, count(*) AS x FROM an WHERE kind IS NOT NULL GROUP BY 1) USING (graph_name)
LEFT JOIN (SELECT graph_name, count(*) AS y FROM dt GROUP BY 1) USING (graph_name)""")
def audit_report(spark, d):
    return audit.audit_report(current(spark, d, "entities", "title", "span"), _calls(spark, d))


@query(f"""WITH {_LAST}, {_cur('entities', 'title, type', 'e')}, {_cur('relationships', 'id, source, target, span, type, description, confidence, is_deterministic', 'r')},
x AS (SELECT r.*, regexp_extract(description, 'ast Attribute:\\s*(.*)$', 1) AS tail FROM r WHERE type = 'calls' AND EXISTS (SELECT 1 FROM e WHERE e.graph_name = r.graph_name AND e.title = r.target AND e.type = 'fn'))
SELECT graph_name, source, target, span, trim(split_part(tail, ' ->', 1)) AS display, trim(split_part(tail, '-> ', 2)) AS resolved_display, confidence, is_deterministic
FROM x WHERE tail LIKE '%.%' AND split_part(target, ':', 2) = regexp_extract(split_part(tail, ' ->', 1), '\\.([^.]*)$', 1)""")
def semantic_suspicions(spark, d):
    calls = _calls(spark, d, "description", "confidence", "is_deterministic")
    return audit.semantic_suspicions(_entities(spark, d), calls)


@query(f"""WITH {_LAST}, {_cur('entities', 'title', 'e')}, {_cur('relationships', 'source, target, type', 'r0')},
p AS (SELECT graph_name, source, target, regexp_replace(source, '\\.(__init__|__new__|__call__)$', '') AS sb, regexp_replace(target, '\\.(__init__|__new__|__call__)$', '') AS tb FROM r0 WHERE type = 'calls'),
q AS (SELECT p.graph_name, CASE WHEN a.title IS NOT NULL THEN sb ELSE source END AS source, CASE WHEN b.title IS NOT NULL THEN tb ELSE target END AS target
 FROM p LEFT JOIN e a ON a.graph_name = p.graph_name AND a.title = sb AND sb <> source LEFT JOIN e b ON b.graph_name = p.graph_name AND b.title = tb AND tb <> target)
SELECT DISTINCT * FROM q WHERE source <> '' AND target <> '' AND source <> target""")
def normalised_edges(spark, d):
    return audit.normalised_edges(_edges(spark, d).where("type = 'calls'"), current(spark, d, "entities", "title"))


@query(f"""WITH {_LAST}, {_cur('relationships', 'source, target, type, is_deterministic', 'r0')}, r AS (SELECT * FROM r0 WHERE source IS NOT NULL AND target IS NOT NULL),
s AS (SELECT DISTINCT graph_name, source, target FROM r WHERE type = 'calls'), o AS (SELECT DISTINCT graph_name, source, target FROM r WHERE type = 'calls' AND is_deterministic
 UNION SELECT DISTINCT graph_name, source, target FROM r WHERE type = 'inherits'),
g AS (SELECT DISTINCT graph_name FROM (SELECT graph_name FROM s UNION SELECT graph_name FROM o)),
n AS (SELECT graph_name, (SELECT count(*) FROM s JOIN o USING (graph_name, source, target) WHERE s.graph_name = g.graph_name) AS c,
 (SELECT count(*) FROM o ANTI JOIN s USING (graph_name, source, target) WHERE o.graph_name = g.graph_name) AS m,
 (SELECT count(*) FROM s ANTI JOIN o USING (graph_name, source, target) WHERE s.graph_name = g.graph_name) AS u FROM g)
SELECT graph_name, c AS n_confirmed, m AS n_missed, u AS n_unconfirmed, round(CAST(c AS DOUBLE) / nullif(c + m, 0), 4) AS recall, round(CAST(c AS DOUBLE) / nullif(c + u, 0), 4) AS coverage FROM n""")
def edge_scores(spark, d):
    e = _edges(spark, d, "is_deterministic").where("source is not null and target is not null")
    stated = e.where("type = 'calls'")
    observed = e.where("type = 'calls' and is_deterministic or type = 'inherits'")
    return audit.edge_scores(stated, observed)


# --- aggregates ----------------------------------------------------------------------------------


@query(f"""WITH {_LAST}, {_cur('entities', 'title', 'e')}, {_cur('relationships', 'id, target, type', 'r')},
n AS (SELECT graph_name, target, count(*) AS n_calls FROM r SEMI JOIN (SELECT graph_name, title AS target FROM e) USING (graph_name, target) WHERE type = 'calls' GROUP BY ALL)
SELECT graph_name, CAST(rank AS INT) AS rank, target AS title, n_calls FROM (SELECT *, row_number() OVER (PARTITION BY graph_name ORDER BY n_calls DESC, target) AS rank FROM n) WHERE rank <= 3""")
def top_called(spark, d):
    return measures.top_called(_edges(spark, d, "id"), current(spark, d, "entities", "title"))


@query(f"""WITH {_LAST}, {_cur('relationships', 'source, target, type', 'a')}, b AS (SELECT DISTINCT graph_name, source, target, type FROM relationships_export),
x AS (SELECT graph_name, type, sum(n) AS d FROM (SELECT graph_name, type, source, target, count(*) AS n FROM a GROUP BY ALL UNION ALL SELECT graph_name, type, source, target, -count(*) FROM b GROUP BY ALL) GROUP BY graph_name, type, source, target)
SELECT graph_name, type, CAST(sum(greatest(d, 0)) AS BIGINT) AS n_missing, CAST(sum(greatest(-d, 0)) AS BIGINT) AS n_extra FROM x GROUP BY ALL""")
def bag_difference(spark, d):
    export = load(spark, d, "relationships_export").select("graph_name", "source", "target", "type").distinct()
    return measures.bag_difference(_edges(spark, d), export, ["source", "target"], ["graph_name", "type"])


@query(f"""WITH {_LAST}, {_cur('entities', 'id, source_file', 'e')}, n AS (SELECT graph_name, count(*) FILTER (source_file LIKE '%.py') AS n_python, count(*) FILTER (regexp_matches(source_file, '\\.[ch]$')) AS n_c FROM e GROUP BY 1)
SELECT *, CASE WHEN n_python > 0 AND n_c > 0 THEN 'mixed' WHEN n_python > 0 THEN 'python' WHEN n_c > 0 THEN 'c' ELSE 'none' END AS language FROM n""")
def language_vote(spark, d):
    return measures.language_vote(current(spark, d, "entities", "id", "source_file"))


@query(f"""WITH {_LAST}, {_cur('relationships', 'id, text_unit_ids', 'r')}, p AS (SELECT DISTINCT graph_name, unnest(text_unit_ids) AS text_unit_id, id FROM r)
SELECT graph_name, text_unit_id, list_sort(list(id)) AS relationship_ids FROM p WHERE id IS NOT NULL GROUP BY ALL""")
def back_references(spark, d):
    return measures.back_references(current(spark, d, "relationships", "id", "text_unit_ids"))


@query(f"""WITH {_LAST}, {_cur('relationships', 'id, type, weight', 'r')}
SELECT type, median(weight) AS median, min(weight) AS least, max(weight) AS most, count(weight) AS n FROM r GROUP BY 1""")
def arm_summary(spark, d):
    return measures.arm_summary(current(spark, d, "relationships", "id", "type", "weight"), "type", "weight")


@query(f"""WITH {_LAST}, {_cur('entities', 'source_file, type, preprocessor_branches', 'e')}, b AS (SELECT graph_name, source_file, unnest(preprocessor_branches) AS b FROM e WHERE type = 'file')
SELECT graph_name, b.liveness AS liveness, count(*) AS n_regions, count(DISTINCT source_file) AS n_files, max(b.end_line - b.start_line) AS longest FROM b GROUP BY ALL""")
def region_census(spark, d):
    return measures.region_census(current(spark, d, "entities", "source_file", "type", "preprocessor_branches"))


@query(f"""WITH {_LAST}, {_cur('entities', 'id, type', 'e')} SELECT graph_name, count(*) FILTER (type = 'class') AS class, count(*) FILTER (type = 'data') AS data, count(*) FILTER (type = 'file') AS file,
 count(*) FILTER (type = 'fn') AS fn, count(*) FILTER (type = 'function') AS function, count(*) FILTER (type = 'method') AS method, count(*) FILTER (type = 'module') AS module FROM e GROUP BY 1""")
def type_cross_tab(spark, d):
    kinds = ["class", "data", "file", "fn", "function", "method", "module"]
    return measures.cross_tab(_entities(spark, d), "graph_name", "type", kinds)


@query(f"""WITH {_LAST}, {_cur('relationships', 'id, type, confidence, is_deterministic', 'r')}
SELECT graph_name, type, count(*) AS n, count(*) FILTER (confidence < 1 AND NOT isnan(confidence) AND is_deterministic) AS n_uncertain_stated_certain FROM r GROUP BY ALL""")
def confidence_rule(spark, d):
    r = current(spark, d, "relationships", "id", "type", "confidence", "is_deterministic")
    odd = (F.col("confidence") < 1) & ~F.isnan("confidence") & F.col("is_deterministic")
    return r.groupBy("graph_name", "type").agg(F.count(F.lit(1)).alias("n"), F.count_if(odd).alias("n_uncertain_stated_certain"))


# --- traversals ----------------------------------------------------------------------------------


def _starts(entities, title):
    return entities.where(F.col("title") == title).select("graph_name", F.col("title").alias("start")).distinct()


@query(f"""WITH RECURSIVE {_LAST}, {_cur('relationships', 'source, target, type', 'r')}, {_cur('entities', 'title', 'e')}, c AS (SELECT graph_name, source, target FROM r WHERE type = 'calls' AND source IS NOT NULL),
w AS (SELECT DISTINCT graph_name, title FROM e WHERE title = '{HUB}' UNION SELECT c.graph_name, c.source FROM w JOIN c ON c.graph_name = w.graph_name AND c.target = w.title)
SELECT graph_name, '{HUB}' AS start, title FROM w WHERE title <> '{HUB}'""")
def impact(spark, d):
    return traverse.impact(_edges(spark, d), _starts(current(spark, d, "entities", "title"), HUB))


_CLOSURE = f"""{_LAST}, {_cur('relationships', 'id, source, target, type', 'r')}, {_cur('entities', 'title', 'e')}, c AS (SELECT DISTINCT graph_name, id, source, target FROM r WHERE type = 'uses_type' AND source <> '' AND target <> ''),
h AS (SELECT graph_name, source AS a, target AS b FROM c UNION SELECT graph_name, target, source FROM c),
w AS (SELECT DISTINCT graph_name, title, 0 AS depth FROM e WHERE title = '{HUB}' UNION SELECT h.graph_name, h.b, w.depth + 1 FROM w JOIN h ON h.graph_name = w.graph_name AND h.a = w.title WHERE w.depth < 3),
nodes AS (SELECT graph_name, title, min(depth) AS depth FROM w GROUP BY ALL),
ed AS (SELECT c.graph_name, c.id, c.source, c.target, min(n.depth) AS depth FROM c JOIN nodes n ON n.graph_name = c.graph_name AND n.title IN (c.source, c.target) WHERE n.depth < 3 GROUP BY ALL)"""


def _closure(spark, d):
    edges = _edges(spark, d, "id").where("source <> '' and target <> ''")
    return traverse.type_closure(edges, _starts(current(spark, d, "entities", "title"), HUB), "both", 3, check=False)


@query(f"WITH RECURSIVE {_CLOSURE} SELECT graph_name, '{HUB}' AS start, title, depth FROM nodes")
def type_closure_nodes(spark, d):
    return _closure(spark, d)[0]


@query(f"WITH RECURSIVE {_CLOSURE} SELECT graph_name, '{HUB}' AS start, id, source, target, depth FROM ed")
def type_closure_edges(spark, d):
    return _closure(spark, d)[1]


@query(f"""WITH RECURSIVE {_CLOSURE} SELECT graph_name, '{HUB}' AS start, n AS n_nodes_total, least(n, 50) AS n_nodes_returned, n > 50 AS nodes_truncated, coalesce(m, 0) AS n_edges_total, least(coalesce(m, 0), 100) AS n_edges_returned, coalesce(m, 0) > 100 AS edges_truncated
FROM (SELECT graph_name, count(*) AS n FROM nodes GROUP BY 1) LEFT JOIN (SELECT graph_name, count(*) AS m FROM ed GROUP BY 1) USING (graph_name)""")
def type_closure_totals(spark, d):
    return traverse.closure_totals(*_closure(spark, d))


_FOLLOWED = ", ".join(f"'{t}'" for t in traverse.FOLLOWED)


@query(f"""WITH RECURSIVE {_LAST}, {_cur('relationships', 'source, target, type', 'r')}, {_cur('entities', 'title', 'e')}, c AS (SELECT DISTINCT graph_name, source, target FROM r WHERE type IN ({_FOLLOWED}) AND source IS NOT NULL AND target IS NOT NULL),
w AS (SELECT DISTINCT graph_name, title FROM e WHERE title = 'runtime_log:__module__' UNION SELECT c.graph_name, c.target FROM w JOIN c ON c.graph_name = w.graph_name AND c.source = w.title)
SELECT graph_name, 'runtime_log:__module__' AS start, count(*) AS size, 2 - count(*) FILTER (title IN ('{HUB}', 'runtime_log:__module__')) AS n_missing, count(*) FILTER (title = 'no_such:title') AS n_leaked FROM w SEMI JOIN e USING (graph_name, title) GROUP BY 1""")
def adequacy(spark, d):
    e = current(spark, d, "entities", "title")
    closed = traverse.adequacy_closure(_edges(spark, d), e, _starts(e, "runtime_log:__module__"))
    return traverse.adequacy(closed, [HUB, "runtime_log:__module__"], ["no_such:title"])


@query(f"""WITH RECURSIVE {_LAST}, {_cur('relationships', 'source, target, type', 'r')}, c AS (SELECT DISTINCT graph_name, source, target FROM r WHERE type = 'contains' AND source IS NOT NULL AND target IS NOT NULL),
n AS (SELECT graph_name, source AS title FROM c UNION SELECT graph_name, target FROM c),
w AS (SELECT graph_name, title, 0 AS level FROM n ANTI JOIN (SELECT graph_name, target AS title FROM c) USING (graph_name, title) UNION SELECT c.graph_name, c.target, w.level + 1 FROM w JOIN c ON c.graph_name = w.graph_name AND c.source = w.title)
SELECT graph_name, title, max(level) AS level FROM w GROUP BY ALL""")
def dependency_order(spark, d):
    return traverse.dependency_order(_edges(spark, d))


@query()
def class_linearisations(spark, d):
    e = _entities(spark, d, "source_file").where("type = 'class'").select("graph_name", "source_file", "title").distinct()
    up = _edges(spark, d).where("type = 'inherits'").groupBy("graph_name", F.col("source").alias("title")).agg(F.sort_array(F.collect_set("target")).alias("bases"))
    return traverse.linearisations(e.join(up, ["graph_name", "title"], "left"))


@query(f"""WITH RECURSIVE {_LAST}, {_cur('relationships', 'source, target, type', 'r')}, {_cur('entities', 'title, type', 'e')}, i AS (SELECT DISTINCT graph_name, source, target FROM r WHERE type = 'inherits' AND source IS NOT NULL AND target IS NOT NULL AND source <> target),
m AS (SELECT DISTINCT graph_name, regexp_replace(title, '\\.[^.]*$', '') AS title, regexp_extract(title, '\\.([^.]*)$', 1) AS member FROM e WHERE type = 'method'),
w AS (SELECT DISTINCT graph_name, title AS start, title, 0 AS depth FROM e WHERE type = 'class' UNION SELECT i.graph_name, w.start, i.target, w.depth + 1 FROM w JOIN i ON i.graph_name = w.graph_name AND i.source = w.title WHERE w.depth < 40),
k AS (SELECT graph_name, start, title, min(depth) AS depth FROM w GROUP BY ALL)
SELECT graph_name, start, member, arg_min(title, (depth, title)) AS owner, min(depth) AS depth FROM k JOIN m USING (graph_name, title) GROUP BY ALL""")
def nearest_definition(spark, d):
    e = _entities(spark, d)
    members = e.where("type = 'method'").select(
        "graph_name", F.regexp_replace("title", r"\.[^.]*$", "").alias("title"), F.regexp_extract("title", r"\.([^.]*)$", 1).alias("member")
    ).distinct()
    starts = e.where("type = 'class'").select("graph_name", F.col("title").alias("start")).distinct()
    return traverse.nearest_definition(_edges(spark, d).where("type = 'inherits'"), members, starts)


# --- windows, history, differences ---------------------------------------------------------------


@query("""WITH s AS (SELECT graph_name, snapshot_id, min(created_at) AS created_at FROM snapshots GROUP BY ALL),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY graph_name ORDER BY created_at DESC, snapshot_id DESC) AS INT) AS rank, count(*) OVER (PARTITION BY graph_name) AS total FROM s)
SELECT *, total > 3 AS truncated FROM k WHERE rank <= 3""")
def snapshot_history(spark, d):
    return windows.history(load(spark, d, "snapshots"), 3)


@query("""WITH s AS (SELECT graph_name, snapshot_id, min(created_at) AS created_at FROM snapshots GROUP BY ALL),
p AS (SELECT graph_name, min(snapshot_id) AS snapshot_id FROM s WHERE graph_name LIKE '%1' GROUP BY 1),
f AS (SELECT s.*, p.graph_name IS NOT NULL AS pin, row_number() OVER (PARTITION BY s.graph_name ORDER BY created_at DESC, s.snapshot_id DESC) = 1 AS cur FROM s LEFT JOIN p ON p.graph_name = s.graph_name AND p.snapshot_id = s.snapshot_id),
g AS (SELECT *, greatest(3 - count(*) FILTER (pin OR cur) OVER (PARTITION BY graph_name), 0) AS slots, row_number() OVER (PARTITION BY graph_name ORDER BY (pin OR cur), snapshot_id DESC) AS nth FROM f)
SELECT graph_name, snapshot_id, CASE WHEN cur THEN 'current' WHEN pin THEN 'pinned' WHEN nth <= slots THEN 'newest' ELSE 'delete' END AS decision FROM g""")
def retention_plan(spark, d):
    s = load(spark, d, "snapshots")
    pins = s.where("graph_name like '%1'").groupBy("graph_name").agg(F.min("snapshot_id").alias("snapshot_id"))
    return windows.retention(s, 3, pins)


@query(f"""WITH {_LAST}, {_cur('entities', 'id', 'e')}, k AS (SELECT graph_name, id, CAST(row_number() OVER (PARTITION BY graph_name ORDER BY encode(id)) AS INT) AS rank, count(*) OVER (PARTITION BY graph_name) AS total FROM e)
SELECT *, total > 10 AS truncated FROM k WHERE rank <= 10""")
def bounded_ids(spark, d):
    return windows.capped(current(spark, d, "entities", "id"), ["graph_name"], ["id"], 10)


@query(f"""WITH {_LAST}, {_cur('relationships', 'id, source, target, type', 'r')}
SELECT graph_name, id, source, target, CAST(k AS INT) AS sample_rank FROM (SELECT *, row_number() OVER (PARTITION BY graph_name ORDER BY md5('42' || chr(31) || coalesce(id, '')), id) AS k FROM r WHERE type = 'calls') WHERE k <= 5""")
def edge_sample(spark, d):
    calls = _edges(spark, d, "id").where("type = 'calls'").select("graph_name", "id", "source", "target")
    return windows.hash_sample(calls, ["graph_name"], ["id"], 5)


@query(f"""WITH {_LAST}, {_cur('call_observations', _OBS, 'o')}
SELECT *, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY graph_name ORDER BY (reason = 'unresolved receiver') DESC, source, display_target, span, source_file, reason, confidence) AS k FROM o) t
WHERE k <= 15""".replace("SELECT *, CAST(k AS INT) AS rank", "SELECT * EXCLUDE (k), CAST(k AS INT) AS rank"))
def observation_window(spark, d):
    o = current(spark, d, "call_observations", *_OBS.split(", "))
    return windows.priority_window(o, ["graph_name"], F.col("reason") == "unresolved receiver", ["source", "display_target", "span", "source_file", "reason", "confidence"])


@query(f"""WITH {_LAST}, {_cur('relationships', 'id, source, target, type, span', 'r')}, x AS (SELECT graph_name, id, source, target, TRY_CAST(nullif(regexp_extract(span, '^\\s*([0-9]+)\\s*(:|$)', 1), '') AS INT) AS line, type FROM r),
c AS (SELECT * FROM x WHERE type = 'calls' AND line IS NOT NULL), a AS (SELECT * FROM x WHERE type = 'uses_data' AND line IS NOT NULL),
s AS (SELECT c.graph_name, c.source, c.id AS call_id, arg_max(a.target, (a.line, coalesce(a.target, ''))) AS last_type, list_sort(list(DISTINCT a.target)) AS types FROM c JOIN a ON a.graph_name = c.graph_name AND a.source = c.source AND a.line <= c.line GROUP BY ALL)
SELECT c.graph_name, c.source, c.id AS call_id, last_type, coalesce(list_filter(types, lambda v: v IS NOT NULL), []) AS types, false AS any_unknown FROM c LEFT JOIN s ON s.graph_name = c.graph_name AND s.source = c.source AND s.call_id = c.id""")
def last_assignment(spark, d):
    x = _edges(spark, d, "id", "span").withColumn("line", call_line(F.col("span"))).where("line is not null")
    calls = x.where("type = 'calls'").select("graph_name", "source", F.col("id").alias("call_id"), "line")
    data = x.where("type = 'uses_data' and target is not null").select("graph_name", "source", F.col("line").alias("at_line"), F.col("target").alias("type"))
    return windows.last_assignment(calls, data, ["graph_name", "source"])


_PAIR = """o AS (SELECT graph_name, snapshot_id, row_number() OVER (PARTITION BY graph_name ORDER BY min(created_at) DESC) AS k FROM snapshots GROUP BY graph_name, snapshot_id)"""


def _two(spark, d, name, *columns):
    """The last two snapshots of each graph, as (before, after)."""
    from pyspark.sql.window import Window

    s = load(spark, d, "snapshots").groupBy("graph_name", "snapshot_id").agg(F.min("created_at").alias("at"))
    ranked = s.withColumn("k", F.row_number().over(Window.partitionBy("graph_name").orderBy(F.desc("at"))))
    rows = load(spark, d, name).select("graph_name", "snapshot_id", *columns)
    pick = lambda k: rows.join(ranked.where(f"k = {k}").select("graph_name", "snapshot_id"), ["graph_name", "snapshot_id"], "left_semi").drop("snapshot_id").distinct()
    return pick(2), pick(1)


_DIFF_COLUMNS = ("id", "title", "type", "source_file", "span", "confidence", "is_deterministic", "human_readable_id")


@query(f"""WITH {_PAIR}, b AS (SELECT DISTINCT graph_name, {', '.join(_DIFF_COLUMNS)} FROM entities JOIN o USING (graph_name, snapshot_id) WHERE k = 1),
a AS (SELECT DISTINCT graph_name, {', '.join(_DIFF_COLUMNS)} FROM entities JOIN o USING (graph_name, snapshot_id) WHERE k = 2),
j AS (SELECT coalesce(a.graph_name, b.graph_name) AS graph_name, coalesce(a.id, b.id) AS id, a.id IS NULL AS na, b.id IS NULL AS nb, list_filter([{', '.join(f"CASE WHEN {'CASE WHEN isnan(a.confidence) THEN NULL ELSE a.confidence END' if c == 'confidence' else 'a.' + c} IS DISTINCT FROM {'CASE WHEN isnan(b.confidence) THEN NULL ELSE b.confidence END' if c == 'confidence' else 'b.' + c} THEN '{c}' END" for c in sorted(_DIFF_COLUMNS[1:]))}], lambda x: x IS NOT NULL) AS f
 FROM a FULL JOIN b ON a.graph_name = b.graph_name AND a.id = b.id)
SELECT graph_name, id, CASE WHEN na THEN 'added' WHEN nb THEN 'removed' ELSE 'modified' END AS change, CASE WHEN NOT na AND NOT nb THEN f END AS fields FROM j WHERE na OR nb OR len(f) > 0""")
def snapshot_diff(spark, d):
    return diff.row_diff(*_two(spark, d, "entities", *_DIFF_COLUMNS), ["graph_name", "id"])


@query(f"""WITH {_PAIR}, b AS (SELECT DISTINCT graph_name, id, source, target, type FROM relationships JOIN o USING (graph_name, snapshot_id) WHERE k = 1),
a AS (SELECT DISTINCT graph_name, id, source, target, type FROM relationships JOIN o USING (graph_name, snapshot_id) WHERE k = 2),
j AS (SELECT coalesce(a.graph_name, b.graph_name) AS graph_name, a.id IS NULL AS na, b.id IS NULL AS nb, (a.source, a.target, a.type) IS DISTINCT FROM (b.source, b.target, b.type) AS m FROM a FULL JOIN b ON a.graph_name = b.graph_name AND a.id = b.id)
SELECT graph_name, count(*) FILTER (na) AS n_added, count(*) FILTER (nb) AS n_removed, count(*) FILTER (NOT na AND NOT nb AND m) AS n_modified FROM j WHERE na OR nb OR m GROUP BY 1""")
def snapshot_diff_totals(spark, d):
    return diff.diff_summary(diff.row_diff(*_two(spark, d, "relationships", "id", "source", "target", "type"), ["graph_name", "id"]), ["graph_name"])


@query(f"WITH d AS ({SQL['snapshot_diff']}), k AS (SELECT graph_name, change, id, CAST(row_number() OVER (PARTITION BY graph_name, change ORDER BY encode(id)) AS INT) AS rank, count(*) OVER (PARTITION BY graph_name, change) AS total FROM d) SELECT *, total > 50 AS truncated FROM k WHERE rank <= 50")
def snapshot_diff_samples(spark, d):
    found = diff.row_diff(*_two(spark, d, "entities", *_DIFF_COLUMNS), ["graph_name", "id"])
    return diff.diff_samples(found, ["graph_name"], "id", 50)


@query("""WITH s AS (SELECT graph_name, source_root, git_commit, row_number() OVER (PARTITION BY graph_name ORDER BY created_at DESC) AS k FROM (SELECT DISTINCT graph_name, created_at, source_root, git_commit FROM snapshots)),
j AS (SELECT a.graph_name, a.source_root AS r1, b.source_root AS r2, a.git_commit AS c1, b.git_commit AS c2 FROM s a JOIN s b USING (graph_name) WHERE a.k = 2 AND b.k = 1)
SELECT graph_name, list_filter([CASE WHEN c1 IS NULL AND c2 IS NOT NULL THEN 'git_commit' END, CASE WHEN r1 IS NULL AND r2 IS NOT NULL THEN 'source_root' END], lambda x: x IS NOT NULL) AS added,
 list_filter([CASE WHEN c2 IS NULL AND c1 IS NOT NULL THEN 'git_commit' END, CASE WHEN r2 IS NULL AND r1 IS NOT NULL THEN 'source_root' END], lambda x: x IS NOT NULL) AS removed,
 list_filter([CASE WHEN c1 <> c2 THEN 'git_commit' END, CASE WHEN r1 <> r2 THEN 'source_root' END], lambda x: x IS NOT NULL) AS changed FROM j""")
def manifest_key_summary(spark, d):
    from pyspark.sql.window import Window

    s = load(spark, d, "snapshots").select("graph_name", "created_at", "source_root", "git_commit").distinct()
    entries = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).alias("value")) for c in ("source_root", "git_commit")])
    maps = s.select(
        "graph_name",
        F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("manifest"),
        F.row_number().over(Window.partitionBy("graph_name").orderBy(F.desc("created_at"))).alias("k"),
    )
    return diff.manifest_keys(maps.where("k = 2"), maps.where("k = 1"))


@query(f"""WITH {_LAST}, t AS (SELECT graph_name, id, max(n_tokens) AS n_tokens FROM text_units SEMI JOIN last USING (graph_name, snapshot_id) GROUP BY ALL) SELECT * FROM t""")
def text_unit_dedup(spark, d):
    t = load(spark, d, "text_units").select("graph_name", "snapshot_id", "id", "n_tokens", "ingested_at")
    last = current(spark, d, "text_units", "id").select("graph_name").distinct()
    kept = once(t, ["graph_name", "snapshot_id", "id"])
    from lodegraph.pipeline.reconcile import last_snapshots

    return kept.join(last_snapshots(load(spark, d, "snapshots")), ["graph_name", "snapshot_id"], "left_semi").join(last, "graph_name", "left_semi").select("graph_name", "id", "n_tokens")


# --- interval joins and edge rules ---------------------------------------------------------------

from lodegraph.operators import construct, intervals  # noqa: E402

_FACTS = """f AS (SELECT graph_name, source_file, id, TRY_CAST(regexp_extract(span, '^([0-9]+)', 1) AS INT) AS a,
 CASE WHEN span LIKE '%-%' THEN TRY_CAST(regexp_extract(span, '-([0-9]+):', 1) AS INT) ELSE TRY_CAST(regexp_extract(span, '^([0-9]+)', 1) AS INT) END AS z
 FROM e WHERE type <> 'file' AND regexp_matches(span, '^[0-9]+:[0-9]+(-[0-9]+:[0-9]+)?$')),
g AS (SELECT graph_name, source_file, kind, s, t, m.c AS condition, m.l AS liveness, m.b AS basis FROM (SELECT graph_name, source_file, b.kind AS kind, b.start_line AS s, b.end_line AS t,
 min({'c': coalesce(b.condition, ''), 'l': coalesce(b.liveness, ''), 'b': coalesce(b.basis, '')}) AS m FROM (SELECT graph_name, source_file, unnest(preprocessor_branches) AS b FROM e WHERE type = 'file') GROUP BY ALL))"""
_BRANCH_COLUMNS = "id, type, source_file, span, preprocessor_branches"


def _branches(spark, d):
    e = current(spark, d, "entities", *_BRANCH_COLUMNS.split(", "))
    s = F.col("span")
    facts = e.where("type <> 'file'").select("graph_name", "source_file", "id", first_line(s).cast("bigint").alias("first"), last_line(s).cast("bigint").alias("last"))
    b = e.where("type = 'file'").select("graph_name", "source_file", F.explode("preprocessor_branches").alias("b"))
    regions = b.select(
        "graph_name", "source_file", F.col("b.start_line").alias("first"), F.col("b.end_line").alias("last"), F.col("b.kind").alias("kind"),
        F.col("b.condition").alias("condition"), F.col("b.liveness").alias("liveness"), F.col("b.basis").alias("basis"), F.lit(False).alias("is_guard"),
    )
    return intervals.branches_for_spans(facts, regions, ["graph_name", "source_file"])


@query(f"""WITH {_LAST}, {_cur('entities', _BRANCH_COLUMNS, 'e')}, {_FACTS}
SELECT DISTINCT f.graph_name, f.source_file, f.id, g.kind, g.condition, g.s AS r_first, g.t AS r_last, g.liveness, g.basis FROM f JOIN g ON g.graph_name = f.graph_name AND g.source_file = f.source_file AND f.z >= g.s AND f.a <= g.t""")
def branches_for_spans(spark, d):
    return _branches(spark, d)


@query(f"""WITH {_LAST}, {_cur('entities', _BRANCH_COLUMNS, 'e')}, {_FACTS}, j AS (SELECT f.graph_name, f.source_file, f.id, unnest(['inside_conditional:' || g.kind || '(' || left(coalesce(g.condition, ''), 40) || ')', 'branch_' || g.liveness || ':' || g.kind || '(' || left(coalesce(g.condition, ''), 40) || ')']) AS reason
 FROM f JOIN g ON g.graph_name = f.graph_name AND g.source_file = f.source_file AND f.z >= g.s AND f.a <= g.t)
SELECT graph_name, source_file, id, list_sort(list(DISTINCT reason)) AS reasons FROM j GROUP BY ALL""")
def region_reasons(spark, d):
    return intervals.region_reasons(_branches(spark, d), ["graph_name", "source_file"])


@query(f"""WITH {_LAST}, {_cur('entities', 'id, title, source_file, span, type', 'e')}, {_cur('relationships', 'id, source_file, span, type', 'r')},
o AS (SELECT graph_name, source_file, title, TRY_CAST(regexp_extract(span, '^([0-9]+)', 1) AS INT) AS a, CASE WHEN span LIKE '%-%' THEN TRY_CAST(regexp_extract(span, '-([0-9]+):', 1) AS INT) ELSE TRY_CAST(regexp_extract(span, '^([0-9]+)', 1) AS INT) END AS z
 FROM e WHERE type IN ('fn', 'method', 'function', 'class') AND regexp_matches(span, '^[0-9]+:[0-9]+(-[0-9]+:[0-9]+)?$')),
p AS (SELECT graph_name, source_file, id, TRY_CAST(nullif(regexp_extract(span, '^\\s*([0-9]+)\\s*(:|$)', 1), '') AS INT) AS line FROM r WHERE type = 'calls')
SELECT graph_name, source_file, p.id AS point_id, arg_max(title, (a, -z, title)) AS owner FROM p JOIN o USING (graph_name, source_file) WHERE line BETWEEN a AND z GROUP BY ALL""")
def enclosing_functions(spark, d):
    s = F.col("span")
    owners = current(spark, d, "entities", "id", "title", "source_file", "span", "type").where("type in ('fn', 'method', 'function', 'class')").select(
        "graph_name", "source_file", F.col("title").alias("owner"), first_line(s).alias("first"), last_line(s).alias("last"))
    points = current(spark, d, "relationships", "id", "source_file", "span", "type").where("type = 'calls'").select(
        "graph_name", "source_file", F.col("id").alias("point_id"), call_line(s).alias("line"))
    return audit.innermost_owner(points, owners, ["graph_name", "source_file"])


@query(f"""WITH {_LAST}, {_cur('entities', 'id, title, human_readable_id', 'e')}, {_cur('relationships', 'source, target, source_file', 'r')},
t AS (SELECT graph_name, title, min(human_readable_id) AS o FROM e GROUP BY ALL), b AS (SELECT graph_name, regexp_extract(title, '([^:]*)$', 1) AS bare, arg_min(title, (o, title)) AS of_bare FROM t GROUP BY ALL),
i AS (SELECT graph_name, id, arg_min(title, human_readable_id) AS of_id FROM e GROUP BY ALL),
q AS (SELECT DISTINCT graph_name, raw, regexp_extract(source_file, '([^/]+)\\.[^./]+$', 1) AS stem FROM (SELECT graph_name, source AS raw, source_file FROM r UNION ALL SELECT graph_name, target, source_file FROM r) WHERE raw IS NOT NULL AND raw <> ''),
p AS (SELECT *, string_split(raw, ':') AS s, regexp_replace(regexp_extract(raw, '([^:]*)$', 1), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS bare FROM q),
k AS (SELECT *, CASE WHEN starts_with(raw, 'ent:') AND len(s) >= 3 THEN CASE WHEN s[2] = 'file' THEN array_to_string(s[3:], ':') WHEN len(s) >= 4 THEN array_to_string(s[4:], ':') ELSE s[-1] END END AS tail FROM p),
c AS (SELECT k.*, stem || ':' || tail AS ci, stem || ':' || replace(tail, '_', '.') AS cd, CASE WHEN contains(raw, ':') THEN stem || ':' || regexp_extract(raw, ':(.*)$', 1) END AS cc FROM k)
SELECT c.graph_name, c.raw, c.stem,
 CASE WHEN x.title IS NOT NULL THEN c.raw WHEN of_id IS NOT NULL THEN of_id WHEN y.title IS NOT NULL THEN ci WHEN z.title IS NOT NULL THEN cd WHEN w.title IS NOT NULL THEN cc WHEN of_bare IS NOT NULL THEN of_bare ELSE c.raw END AS title,
 CASE WHEN x.title IS NOT NULL THEN 'title' WHEN of_id IS NOT NULL THEN 'id' WHEN y.title IS NOT NULL THEN 'internal' WHEN z.title IS NOT NULL THEN 'dotted' WHEN w.title IS NOT NULL THEN 'context' WHEN of_bare IS NOT NULL THEN 'bare' ELSE 'raw' END AS step
FROM c LEFT JOIN t x ON x.graph_name = c.graph_name AND x.title = c.raw LEFT JOIN i ON i.graph_name = c.graph_name AND i.id = c.raw LEFT JOIN t y ON y.graph_name = c.graph_name AND y.title = ci
 LEFT JOIN t z ON z.graph_name = c.graph_name AND z.title = cd LEFT JOIN t w ON w.graph_name = c.graph_name AND w.title = cc LEFT JOIN b ON b.graph_name = c.graph_name AND b.bare = c.bare""")
def title_resolution(spark, d):
    e = current(spark, d, "entities", "id", "title", "human_readable_id").withColumnRenamed("human_readable_id", "ordinal")
    r = current(spark, d, "relationships", "source", "target", "source_file")
    stem = F.regexp_extract("source_file", r"([^/]+)\.[^./]+$", 1).alias("stem")
    refs = r.select("graph_name", F.col("source").alias("raw"), stem).unionByName(r.select("graph_name", F.col("target").alias("raw"), stem))
    return construct.resolve_titles(refs, e)


_WEAK = "id, type, extractor, description, confidence, resolved_target_hint"


@query(f"""WITH {_LAST}, {_cur('relationships', _WEAK, 'r')},
x AS (SELECT *, type = 'calls' AND contains(extractor, '+ast') AS judged, CASE WHEN confidence IS NULL OR isnan(confidence) THEN 0 ELSE confidence END AS conf, coalesce(resolved_target_hint, '') <> '' AS hinted FROM r),
y AS (SELECT *, CASE WHEN description LIKE '%builtin container%' THEN 'builtin/container call observation' WHEN description LIKE '%ambiguous annotation%' THEN 'ambiguous annotation' WHEN description LIKE '%ambiguous constructors%' THEN 'ambiguous constructors'
 WHEN description LIKE '%guarded by reassignment%' THEN 'guarded by reassignment' WHEN description LIKE '%unresolved receiver%' THEN 'unresolved receiver' WHEN conf < 0.6 THEN 'low confidence' END AS told, conf < 0.7 OR NOT hinted AS leaves FROM x)
SELECT graph_name, id, coalesce(judged AND (told IS NOT NULL OR leaves), false) AS observed, CASE WHEN judged AND (told IS NOT NULL OR leaves) THEN coalesce(told, 'low confidence call observation') END AS reason, NOT coalesce(judged AND leaves, false) AS kept FROM y""")
def weak_call_demotion(spark, d):
    return construct.demote_weak_calls(current(spark, d, "relationships", *_WEAK.split(", "))).select("graph_name", "id", "observed", "reason", "kept")


@query(f"""WITH {_LAST}, {_cur('entities', 'title', 'e')}, {_cur('call_observations', 'source, display_target', 'c')}, o AS (SELECT graph_name, regexp_extract(title, '([^:]*)$', 1) AS target, max(title) AS f FROM e GROUP BY ALL HAVING count(*) = 1)
SELECT c.graph_name, c.source, CASE WHEN NOT contains(display_target, ':') AND f IS NOT NULL THEN f ELSE display_target END AS target, NOT contains(display_target, ':') AND f IS NOT NULL AS upgraded FROM c LEFT JOIN o ON o.graph_name = c.graph_name AND o.target = c.display_target WHERE display_target IS NOT NULL""")
def bare_name_upgrade(spark, d):
    o = current(spark, d, "call_observations", "source", "display_target").where("display_target is not null")
    edges = o.select("graph_name", "source", F.col("display_target").alias("target"), F.lit("calls").alias("type"), F.lit(0.5).alias("confidence"), F.lit(False).alias("is_deterministic"))
    return construct.upgrade_bare_targets(edges, current(spark, d, "entities", "title")).select("graph_name", "source", "target", "upgraded")


@query("""WITH f AS (SELECT DISTINCT graph_name, source_file, regexp_extract(source_file, '([^/]+)\\.[^./]+$', 1) AS stem, regexp_extract(source_file, '(?:^|/)([^/]+)/[^/]+$', 1) AS parent, regexp_replace(source_file, '[^/]*$', '') AS folder FROM source_files),
n AS (SELECT graph_name, stem, count(DISTINCT folder) AS k FROM f GROUP BY ALL) SELECT graph_name, source_file, CASE WHEN k > 1 AND parent <> '' THEN parent || '/' || stem ELSE stem END AS module_key FROM f JOIN n USING (graph_name, stem)""")
def c_module_keys(spark, d):
    return construct.module_keys(load(spark, d, "source_files"))


@query(f"""WITH {_LAST}, s AS (SELECT DISTINCT graph_name, split_part(title, ':', 1) AS module_key, type AS kind, symbol_name AS name FROM entities SEMI JOIN last USING (graph_name, snapshot_id) WHERE symbol_name IS NOT NULL),
n AS (SELECT graph_name, module_key, name, count(DISTINCT kind) AS k FROM s GROUP BY ALL) SELECT s.*, CASE WHEN k > 1 THEN module_key || ':' || kind || ':' || name ELSE module_key || ':' || name END AS title FROM s JOIN n USING (graph_name, module_key, name)""")
def c_symbol_titles(spark, d):
    e = current(spark, d, "entities", "title", "type", "symbol_name").where("symbol_name is not null")
    return construct.symbol_titles(e.select("graph_name", F.substring_index("title", ":", 1).alias("module_key"), F.col("type").alias("kind"), F.col("symbol_name").alias("name")))


@query(f"""WITH {_LAST}, r AS (SELECT DISTINCT graph_name, 'rel:' || type AS id, source, target, type, span FROM relationships SEMI JOIN last USING (graph_name, snapshot_id)), n AS (SELECT *, count(*) OVER (PARTITION BY graph_name, id) AS k FROM r)
SELECT graph_name, id, source, target, span, CASE WHEN k > 1 THEN id || ':' || left(sha256(coalesce(source, '') || chr(0) || coalesce(target, '') || chr(0) || coalesce(type, '') || chr(0) || coalesce(span, '')), 12) ELSE id END AS new_id FROM n""")
def id_disambiguation(spark, d):
    r = current(spark, d, "relationships", "source", "target", "type", "span").withColumn("id", F.concat(F.lit("rel:"), "type"))
    return construct.disambiguate_ids(r).select("graph_name", "id", "source", "target", "span", "new_id")


@query(f"""WITH {_LAST}, {_cur('relationships', 'source, target, type', 'r')} SELECT DISTINCT graph_name, source, target FROM r WHERE type = 'includes' AND NOT EXISTS
 (SELECT 1 FROM r q WHERE q.type = 'depends_on' AND q.graph_name = r.graph_name AND q.source = r.source AND q.target = r.target) AND source IS NOT NULL AND target IS NOT NULL""")
def unseen_dependencies(spark, d):
    r = _edges(spark, d).where("source is not null and target is not null")
    keys = ["graph_name", "source", "target"]
    return construct.append_unseen(r.where("type = 'depends_on'"), r.where("type = 'includes'"), keys).select(*keys)


# --- extraction from source ----------------------------------------------------------------------

from lodegraph.sources import c_conditionals, python_facts  # noqa: E402


@query()
def python_facts_census(spark, d):
    facts = python_facts.python_facts(load(spark, d, "source_files"))
    return facts.groupBy("record", "type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("graph_name").alias("n_graphs"), F.avg("confidence").alias("mean_confidence"))


@query()
def dynamic_sites(spark, d):
    facts = python_facts.python_facts(load(spark, d, "source_files")).where("record = 'site'")
    return facts.groupBy("type").agg(F.count(F.lit(1)).alias("n_sites"), F.countDistinct("graph_name", "source_file").alias("n_files"))


@query()
def extracted_bare_calls(spark, d):
    """Calls of the extractor with their targets resolved against all titles of the graph."""
    facts = python_facts.python_facts(load(spark, d, "source_files"))
    entities = facts.where("record = 'entity'").select("graph_name", F.col("source").alias("title"), F.concat_ws(":", F.lit("ent"), "type", "source").alias("id"), F.col("first").alias("ordinal"))
    refs = facts.where("record = 'edge' and type = 'calls'").select("graph_name", F.col("target").alias("raw"), F.regexp_extract("source_file", r"([^/]+)\.py$", 1).alias("stem"))
    return construct.resolve_titles(refs, entities).groupBy("graph_name", "step").agg(F.count(F.lit(1)).alias("n"))


@query()
def conditional_regions(spark, d):
    r = c_conditionals.conditional_regions(load(spark, d, "source_files"))
    return r.groupBy("graph_name", "kind", "liveness").agg(F.count(F.lit(1)).alias("n_regions"), F.max("depth").alias("max_depth"))


@query("""WITH t AS (SELECT DISTINCT graph_name, source_file, content FROM source_files WHERE content IS NOT NULL AND regexp_matches(source_file, '\\.[ch]$'))
SELECT graph_name, count(*) AS n_files, CAST(sum(len(regexp_extract_all(content, '(?m)^[ \\t]*#[ \\t]*define[ \\t]+\\w+\\('))) AS BIGINT) AS n_function_macros,
 CAST(sum(len(regexp_extract_all(content, '(?m)^[ \\t]*#[ \\t]*define[ \\t]+\\w+(?:[^\\w(]|$)'))) AS BIGINT) AS n_object_macros,
 CAST(sum(len(regexp_extract_all(content, '(?m)^[ \\t]*#[ \\t]*if(n?def)?\\b'))) AS BIGINT) AS n_conditionals FROM t GROUP BY 1""")
def macro_census(spark, d):
    return c_conditionals.macro_census(load(spark, d, "source_files"))


@query("""WITH f AS (SELECT DISTINCT graph_name, source_file, content FROM source_files WHERE source_file LIKE '%.json' AND content IS NOT NULL)
SELECT n_cases, count(*) AS n_files FROM (SELECT CAST(CASE WHEN json_valid(content) THEN coalesce(json_array_length(content, '$.cases'), 0) ELSE 0 END AS INT) AS n_cases FROM f) GROUP BY 1""")
def golden_cases(spark, d):
    files = load(spark, d, "source_files").where("source_file like '%.json' and content is not null").select("graph_name", "source_file", "content").distinct()
    return measures.json_cases(files).groupBy("n_cases").agg(F.count(F.lit(1)).alias("n_files"))


# --- packs ---------------------------------------------------------------------------------------

from lodegraph.operators import pack  # noqa: E402
from lodegraph.tables import GraphTables  # noqa: E402


def _graph(spark, d):
    return GraphTables(
        current(spark, d, "entities", "id", "title", "type", "text_unit_ids"),
        current(spark, d, "relationships", "id", "source", "target", "type", "text_unit_ids"),
        current(spark, d, "text_units", "id", "text"),
        current(spark, d, "call_observations", "source", "display_target", "reason", "span"),
    )


_TABLES = f"""{_LAST}, {_cur('entities', 'id, title, type, text_unit_ids', 'e')}, {_cur('relationships', 'id, source, target, type, text_unit_ids', 'r')}, {_cur('text_units', 'id, text', 't')}, {_cur('call_observations', 'source, display_target, reason, span', 'o')}"""
#: A section's rows: graph, name, five sort keys, item, whether the text is cut, limit.
_WEAK_ROW = "CASE WHEN coalesce(contains(reason, 'registry'), false) THEN 'false' ELSE 'true' END, source, display_target, span, reason, concat_ws(' ', source, display_target, reason), CAST(NULL AS BOOLEAN), 15"
_EDGE = "concat_ws(' ', source, type, target), CAST(NULL AS BOOLEAN)"
_UNIT = "SELECT graph_name, 'texts', id, NULL, NULL, NULL, NULL, substring(text, 1, 300), length(text) > 300, 10 FROM t SEMI JOIN w USING (graph_name, id) WHERE text IS NOT NULL"
_RANKED = """q AS (SELECT DISTINCT * FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY graph_name, section ORDER BY k1 NULLS FIRST, k2 NULLS FIRST, k3 NULLS FIRST, k4 NULLS FIRST, k5 NULLS FIRST, item NULLS FIRST) AS n, count(*) OVER (PARTITION BY graph_name, section) AS total FROM q),
ranked AS (SELECT graph_name, section, CAST(n AS INT) AS rank, item, total, total > lim AS truncated, cut FROM k WHERE n <= lim)"""
_PACK = f"""{_TABLES},
n AS (SELECT graph_name, id AS name FROM e WHERE title = '{HUB}' UNION SELECT graph_name, title FROM e WHERE title = '{HUB}'),
x AS (SELECT r.*, target AS other, 'out' AS way FROM r SEMI JOIN (SELECT graph_name, name AS source FROM n) USING (graph_name, source) UNION ALL SELECT r.*, source, 'in' FROM r SEMI JOIN (SELECT graph_name, name AS target FROM n) USING (graph_name, target)),
y AS (SELECT * FROM x WHERE other IS NOT NULL), w AS (SELECT DISTINCT graph_name, id FROM (SELECT graph_name, unnest(text_unit_ids) AS id FROM e WHERE title = '{HUB}' UNION ALL SELECT graph_name, unnest(text_unit_ids) FROM e SEMI JOIN (SELECT graph_name, other AS title FROM y) USING (graph_name, title))),
s(graph_name, section, k1, k2, k3, k4, k5, item, cut, lim) AS (SELECT graph_name, 'neighbors', other, type, id, NULL, NULL, {_EDGE}, 30 FROM y UNION ALL {_UNIT}
 UNION ALL SELECT graph_name, 'data', other, id, NULL, NULL, NULL, {_EDGE}, 30 FROM y WHERE type = 'uses_data' UNION ALL SELECT graph_name, 'types_out', target, id, NULL, NULL, NULL, {_EDGE}, 20 FROM x WHERE way = 'out' AND type = 'uses_type'
 UNION ALL SELECT graph_name, 'types_in', source, id, NULL, NULL, NULL, {_EDGE}, 20 FROM x WHERE way = 'in' AND type = 'uses_type'
 UNION ALL SELECT graph_name, 'observations', {_WEAK_ROW} FROM o WHERE source = '{HUB}' OR starts_with(source, '{HUB}.')), {_RANKED}"""


@query(f"WITH {_PACK} SELECT * FROM ranked")
def context_pack_sections(spark, d):
    return pack.context_sections(_graph(spark, d), HUB)


@query(f"""WITH {_PACK}, b AS (SELECT graph_name, section, list(item ORDER BY rank) AS items, max(total) AS total, bool_or(truncated) AS truncated, CASE WHEN section = 'texts' THEN list(cut ORDER BY rank) END AS cut FROM ranked GROUP BY graph_name, section)
SELECT graph_name, count(*) AS n_sections, CAST(sum(len(items)) AS BIGINT) AS n_items, CAST(sum(total) AS BIGINT) AS n_total, CAST(count_if(truncated) AS BIGINT) AS n_truncated, string_agg(section || '|' || array_to_string(items, '|'), '||' ORDER BY section) AS told, CAST(sum(CASE WHEN cut IS NULL THEN 0 ELSE len(list_filter(cut, lambda v: v)) END) AS BIGINT) AS n_cut FROM b GROUP BY 1""")
def context_pack(spark, d):
    """The JSON records read back: what they hold is compared, not how a writer spells JSON."""
    shape = "title string, sections array<struct<section:string,items:array<string>,total:bigint,truncated:boolean,cut:array<boolean>>>"
    p = pack.context_pack(_graph(spark, d), HUB).select("graph_name", F.from_json("pack_json", shape)["sections"].alias("s"))
    one = p.select("graph_name", F.explode("s").alias("s")).select("graph_name", "s.*")
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", F.array_join("items", "|").alias("i")))), lambda x: F.concat(x["section"], F.lit("|"), x["i"])), "||")
    return one.groupBy("graph_name").agg(
        F.count(F.lit(1)).alias("n_sections"), F.sum(F.size("items")).alias("n_items"), F.sum("total").alias("n_total"), F.count_if("truncated").alias("n_truncated"), told.alias("told"),
        F.sum(F.when(F.col("cut").isNull(), 0).otherwise(F.size(F.filter("cut", lambda v: v)))).alias("n_cut"),
    )


@query(f"""WITH {_TABLES}, m AS (SELECT * FROM e WHERE starts_with(title, 'runtime_log:')), y AS (SELECT * FROM r WHERE starts_with(source, 'runtime_log:') OR starts_with(target, 'runtime_log:')),
w AS (SELECT DISTINCT graph_name, id FROM (SELECT graph_name, unnest(text_unit_ids) AS id FROM m UNION ALL SELECT graph_name, unnest(text_unit_ids) FROM y)),
s(graph_name, section, k1, k2, k3, k4, k5, item, cut, lim) AS (SELECT graph_name, 'members', title, NULL, NULL, NULL, NULL, concat_ws(' ', type, title), CAST(NULL AS BOOLEAN), 50 FROM m UNION ALL SELECT graph_name, 'edges', source, target, type, id, NULL, {_EDGE}, 100 FROM y
 UNION ALL {_UNIT} UNION ALL SELECT graph_name, 'observations', {_WEAK_ROW} FROM o WHERE starts_with(source, 'runtime_log:')), {_RANKED} SELECT * FROM ranked""")
def module_pack(spark, d):
    return pack.module_pack(_graph(spark, d), "runtime_log")


@query(f"""WITH RECURSIVE {_CLOSURE}, {_cur('entities', 'id, title, text_unit_ids', 'pe')}, {_cur('text_units', 'id, text', 'pt')},
nn AS (SELECT *, row_number() OVER (PARTITION BY graph_name ORDER BY depth, title) AS k, count(*) OVER (PARTITION BY graph_name) AS total FROM nodes),
ct AS (SELECT graph_name, title, count(DISTINCT id) AS n FROM pe GROUP BY ALL),
tx AS (SELECT graph_name, title, arg_min(text, id) AS text FROM (SELECT DISTINCT graph_name, title, unnest(text_unit_ids) AS id FROM pe) JOIN (SELECT * FROM pt WHERE text IS NOT NULL) USING (graph_name, id) GROUP BY ALL)
SELECT graph_name, '{HUB}' AS start, CAST(k AS INT) AS rank, title, depth, CASE WHEN n = 1 THEN 'present' WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS status, substring(text, 1, 300) AS text, length(text) > 300 AS cut, total, total > 50 AS truncated
FROM nn LEFT JOIN ct USING (graph_name, title) LEFT JOIN tx USING (graph_name, title) WHERE k <= 50""")
def context_pack_closure(spark, d):
    nodes, _ = _closure(spark, d)
    return pack.closure_section(nodes, _graph(spark, d))


@query(f"""WITH RECURSIVE {_CLOSURE} SELECT graph_name, '{HUB}' AS start, CASE WHEN coalesce(m, 0) = 0 THEN 'empty_closure' ELSE 'truncated_closure' END AS problem
FROM (SELECT graph_name, count(*) AS n FROM nodes GROUP BY 1) LEFT JOIN (SELECT graph_name, count(*) AS m FROM ed GROUP BY 1) USING (graph_name) WHERE coalesce(m, 0) = 0 OR n > 50 OR m > 100""")
def type_context_gate(spark, d):
    return pack.type_context_gate(traverse.closure_totals(*_closure(spark, d)))


# --- words for numbers, over the order tables ----------------------------------------------------

from lodegraph.functions import humanise, plain  # noqa: E402


@query("""SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) || CASE WHEN o_orderkey % 100 BETWEEN 11 AND 13 THEN 'th' WHEN o_orderkey % 10 = 1 THEN 'st' WHEN o_orderkey % 10 = 2 THEN 'nd' WHEN o_orderkey % 10 = 3 THEN 'rd' ELSE 'th' END AS nth,
 format('{:,}', CAST(floor(o_totalprice) AS BIGINT) * 1000) AS grouped,
 CASE WHEN o_orderkey * 997 = 1 THEN CAST(o_orderkey * 997 AS VARCHAR) || ' Byte' WHEN o_orderkey * 997 < 1000 THEN CAST(o_orderkey * 997 AS VARCHAR) || ' Bytes' WHEN o_orderkey * 997 < 1000000 THEN printf('%.1f', o_orderkey * 997 / 1000.0) || ' kB' WHEN o_orderkey * 997 < 1000000000 THEN printf('%.1f', o_orderkey * 997 / 1000000.0) || ' MB' ELSE printf('%.1f', o_orderkey * 997 / 1000000000.0) || ' GB' END AS size,
 CASE WHEN o_orderkey < 10 THEN ['zero','one','two','three','four','five','six','seven','eight','nine'][o_orderkey + 1] ELSE CAST(o_orderkey AS VARCHAR) END AS word,
 CASE WHEN o_totalprice < 2000 THEN '<2000' WHEN o_totalprice > 100000 THEN '>100000' ELSE 'between' END AS bound FROM orders""")
def number_words(spark, d):
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    bound = F.when(price.between(2000, 100000), "between").otherwise(humanise.clamp(price, 2000, 100000))
    return load(spark, d, "orders").select(
        "o_orderkey", humanise.ordinal(k).alias("nth"), humanise.intcomma(F.floor(price).cast("bigint") * 1000).alias("grouped"), humanise.naturalsize(k * 997).alias("size"),
        humanise.digit_word(k).alias("word"), bound.alias("bound"),
    )


@query("""SELECT r_name, CASE count(*) WHEN 1 THEN min(n_name) ELSE array_to_string(list(n_name ORDER BY n_name)[:-2], ', ') || ' and ' || max(n_name) END AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def natural_lists(spark, d):
    n = load(spark, d, "nation").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.groupBy("r_name").agg(humanise.natural_list(F.sort_array(F.collect_list("n_name"))).alias("nations"))


@query("""SELECT o_orderkey, CASE WHEN s < 1 THEN 'a moment' WHEN s < 2 THEN 'a second' WHEN s < 60 THEN s || ' seconds' WHEN s < 120 THEN 'a minute' WHEN s < 3600 THEN (s // 60) || ' minutes' WHEN s < 7200 THEN 'an hour' WHEN s < 86400 THEN (s // 3600) || ' hours' WHEN s < 172800 THEN 'a day' ELSE (s // 86400) || ' days' END AS words
FROM (SELECT o_orderkey, o_orderkey % 1000000 AS s FROM orders)""")
def duration_words(spark, d):
    return load(spark, d, "orders").select("o_orderkey", humanise.naturaldelta(F.col("o_orderkey") % 1000000).alias("words"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, 'P' || CAST(o_orderkey % 30 + 1 AS VARCHAR) || 'D' AS duration, CAST(o_orderkey % 30 + 1 AS INT) AS days FROM orders")
def iso_round_trip(spark, d):
    """Dates and durations through their ISO texts and back."""
    to_date, days_of = plain.vectorised(plain.parse_date, "date"), plain.vectorised(lambda t: plain.parse_duration(t)["days"], "int")
    o = load(spark, d, "orders").withColumn("duration", F.concat(F.lit("P"), (F.col("o_orderkey") % 30 + 1).cast("string"), F.lit("D")))
    return o.select("o_orderkey", to_date(F.date_format("o_orderdate", "yyyy-MM-dd")).cast("string").alias("day"), "duration", days_of("duration").alias("days"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, '{\"k\": ' || json_extract(props, '$.k') || ', \"type\": \"' || event_type || '\"}' AS patched FROM events")
def json_documents(spark, d):
    """A pointer into each event's properties, and the document after a patch."""
    at, patch = plain.vectorised(plain.resolve_pointer, "string"), plain.vectorised(plain.apply_patch, "string")
    op = F.concat(F.lit('[{"op": "add", "path": "/type", "value": "'), "event_type", F.lit('"}]'))
    return load(spark, d, "events").select("event_id", at("props", F.lit("/k")).alias("k"), patch("props", op).alias("patched"))


@query("""SELECT p_partkey, CASE WHEN p_size % 10 >= 2 AND p_size % 10 < 5 THEN true ELSE false END AS fits, CASE WHEN p_size % 10 > 2 THEN 1 WHEN p_size % 10 < 2 THEN -1 WHEN p_partkey % 7 > 0 THEN 1 ELSE 0 END AS order_to_2 FROM part""")
def version_order(spark, d):
    fits, compare = plain.vectorised(plain.matches_spec, "boolean"), plain.vectorised(plain.compare_versions, "int")
    v = F.concat((F.col("p_size") % 10).cast("string"), F.lit("."), (F.col("p_partkey") % 7).cast("string"), F.lit(".0"))
    return load(spark, d, "part").select("p_partkey", fits(F.lit(">=2.0.0,<5.0.0"), v).alias("fits"), compare(v, F.lit("2.0.0")).alias("order_to_2"))


@query()
def text_edits(spark, d):
    """Differences between the names of neighbouring parts."""
    from pyspark.sql.window import Window

    distance = plain.vectorised(plain.diff_distance, "int")
    before = F.lag("p_name").over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    return load(spark, d, "part").select("p_partkey", "p_name", before.alias("before")).where("before is not null").select("p_partkey", distance("p_name", "before").alias("distance"))


# --- compiler trees and contracts ----------------------------------------------------------------

from lodegraph.operators import contracts  # noqa: E402
from lodegraph.sources import ast_facts  # noqa: E402


@query()
def ast_definitions(spark, d):
    facts = ast_facts.ast_facts(load(spark, d, "clang_asts")).where("record = 'definition'")
    return audit.merge_observations(facts, ["graph_name", "file", "name", "line", "col"], "entry_index", ["qual_type"])


@query()
def ast_calls(spark, d):
    facts = ast_facts.ast_facts(load(spark, d, "clang_asts")).where("record = 'call'")
    return audit.merge_observations(facts, ["graph_name", "file", "owner", "byte_offset", "line", "col"], "entry_index", ["target"])


@query()
def ast_types(spark, d):
    facts = ast_facts.ast_facts(load(spark, d, "clang_asts")).where("record = 'type'")
    return facts.groupBy("graph_name", "kind").agg(F.countDistinct("name").alias("n_names"), F.count(F.lit(1)).alias("n_sites"))


@query()
def ast_type_uses(spark, d):
    """Core types of uses per kind, primitives apart."""
    facts = ast_facts.ast_facts(load(spark, d, "clang_asts")).where("record = 'use'")
    core = tx.core_type(F.col("qual_type"))
    return facts.groupBy("kind", core.alias("core_type"), tx.is_external_primitive(core).alias("primitive")).agg(F.count(F.lit(1)).alias("n_uses"))


_EDGE_CONTRACT = """
WITH {last}, {r}, {e}, k AS (SELECT graph_name, title, count(DISTINCT id) AS n, max(type) AS kind FROM e GROUP BY ALL), x AS (SELECT * FROM r WHERE type = '{kind}'),
c AS (SELECT x.graph_name, x.id, unnest([CASE WHEN coalesce(trim(x.id), '') = '' THEN 'empty_relationship_id' END, CASE WHEN count(*) OVER (PARTITION BY x.graph_name, x.id) > 1 THEN 'duplicate_relationship_id' END,
 CASE WHEN isnan(confidence) OR confidence < 0 OR confidence > 1 THEN 'confidence_boundary' END, CASE WHEN isnan(confidence) OR isinf(confidence) THEN 'nan_or_infinity' END,
 CASE WHEN is_deterministic IS DISTINCT FROM true THEN 'field_mismatch' END, CASE WHEN x.source IS NOT NULL AND x.target IS NOT NULL AND count(*) OVER (PARTITION BY x.graph_name, x.source, x.target) > 1 THEN 'duplicate_endpoint_pair' END,
 CASE WHEN a.n IS NULL THEN 'dangling_source' END, CASE WHEN a.n > 1 THEN 'ambiguous_source_title' END, CASE WHEN a.n = 1 AND NOT a.kind IN ({s}) THEN 'invalid_source_kind' END,
 CASE WHEN b.n IS NULL THEN 'dangling_target' END, CASE WHEN b.n > 1 THEN 'ambiguous_target_title' END, CASE WHEN b.n = 1 AND NOT b.kind IN ({t}) THEN 'invalid_target_kind' END]) AS code
 FROM x LEFT JOIN k a ON a.graph_name = x.graph_name AND a.title = x.source LEFT JOIN k b ON b.graph_name = x.graph_name AND b.title = x.target)
SELECT DISTINCT graph_name, id, code FROM c WHERE code IS NOT NULL"""
_CONTRACT_COLUMNS = "id, source, target, type, confidence, is_deterministic"


def _contract_sql(kind: str, source: str, target: str) -> str:
    return _EDGE_CONTRACT.format(last=_LAST, r=_cur("relationships", _CONTRACT_COLUMNS, "r"), e=_cur("entities", "id, title, type", "e"), kind=kind, s=source, t=target)


def _contract(spark, d, name):
    rows = current(spark, d, "relationships", *_CONTRACT_COLUMNS.split(", "))
    return contracts.row_anomalies(contracts.CONTRACTS[name], rows, _entities(spark, d), "legacy_absent")


@query(_contract_sql("depends_on", "'file'", "'file'"))
def dependency_contract(spark, d):
    return _contract(spark, d, "dependency")


@query(_contract_sql("includes", "'file'", "'file'"))
def include_contract(spark, d):
    return _contract(spark, d, "include")


@query(_contract_sql("uses_type", "'function','struct','typedef'", "'struct','enum','typedef'"))
def type_use_contract(spark, d):
    return _contract(spark, d, "type_use")


_LIVE = "id, preprocessor_dependent, preprocessor_reasons, preprocessor_eval_mode, preprocessor_macro_seed_digest, preprocessor_branches"


@query(f"""WITH {_LAST}, {_cur('entities', _LIVE, 'e')}, p AS (SELECT *, (preprocessor_dependent IS NOT NULL)::INT + (preprocessor_reasons IS NOT NULL)::INT + (preprocessor_eval_mode IS NOT NULL)::INT + (preprocessor_macro_seed_digest IS NOT NULL)::INT + (preprocessor_branches IS NOT NULL)::INT AS n FROM e)
SELECT DISTINCT graph_name, id, code FROM (SELECT graph_name, id, unnest([CASE WHEN n BETWEEN 1 AND 4 THEN 'partial_liveness_payload' END, CASE WHEN preprocessor_dependent <> (len(preprocessor_reasons) > 0) THEN 'dependent_reasons_mismatch' END,
 CASE WHEN len(list_filter(preprocessor_branches, lambda b: b.start_line > b.end_line OR b.kind IS NULL OR NOT coalesce(b.liveness IN ('live','dead','unknown'), true))) > 0 THEN 'branch_contract' END,
 CASE WHEN len(list_filter(preprocessor_reasons, lambda r: trim(r) = '')) > 0 THEN 'reason_contract' END, CASE WHEN NOT regexp_matches(preprocessor_macro_seed_digest, '^(sha256:)?[0-9a-f]{{12,64}}$') THEN 'digest_mismatch' END]) AS code FROM p) WHERE code IS NOT NULL""")
def liveness_contract(spark, d):
    return contracts.liveness_anomalies(current(spark, d, "entities", *_LIVE.split(", ")))


# --- recurrences, offsets, programs --------------------------------------------------------------

from lodegraph.operators import comparisons, simulation  # noqa: E402


@query("""WITH t AS (SELECT s_suppkey AS run, tick, tick IN (s_suppkey % 11, s_suppkey % 29) AS jump FROM supplier, range(50) r(tick)),
j AS (SELECT *, max(CASE WHEN jump THEN tick END) OVER (PARTITION BY run ORDER BY tick) AS jumped FROM t),
v AS (SELECT *, CASE WHEN jumped IS NOT NULL THEN 6.0::DOUBLE ELSE 0.0::DOUBLE END + coalesce(tick - jumped + 1, tick + 1) * (-0.8::DOUBLE) AS vy FROM j),
y AS (SELECT *, sum(vy) OVER (PARTITION BY run ORDER BY tick) AS y, (tick + 1) * 1.0::DOUBLE AS x FROM v),
h AS (SELECT *, max((abs(x - 10) <= 0.6 AND y BETWEEN -1 - 1e-9 AND 2 + 1e-9 OR abs(x - 22) <= 0.6 AND y BETWEEN 1 - 1e-9 AND 5 + 1e-9 OR abs(x - 35) <= 0.6 AND y BETWEEN -2 - 1e-9 AND 1.5 + 1e-9)::INT) OVER (PARTITION BY run ORDER BY tick) AS c FROM y)
SELECT run, CAST(tick AS INT) AS tick, round(x, 4) AS x, round(y, 4) AS y, round(vy, 4) AS vy, CAST(sum(1 - c) OVER (PARTITION BY run ORDER BY tick) AS INT) AS score, c = 1 AS collided FROM h""")
def simulations(spark, d):
    s = load(spark, d, "supplier")
    jumps = F.array((F.col("s_suppkey") % 11).cast("int"), (F.col("s_suppkey") % 29).cast("int"))
    return simulation.simulate(s.select(F.col("s_suppkey").alias("run"), jumps.alias("jumps")))


@query("""WITH f AS (SELECT DISTINCT graph_name || '/' || source_file AS file, content FROM source_files WHERE content IS NOT NULL AND regexp_matches(source_file, '\\.[ch]$')),
l AS (SELECT file, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM f)
SELECT file, CAST(line AS INT) AS line, CAST(coalesce(sum(octet_length(encode(text)) + 1) OVER (PARTITION BY file ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset FROM l""")
def line_offsets(spark, d):
    f = load(spark, d, "source_files").where(r"content is not null and source_file rlike '\\.[ch]$'").select(F.concat_ws("/", "graph_name", "source_file").alias("file"), "content").distinct()
    return comparisons.byte_offsets(f)


@query("SELECT p_partkey, CAST(p_size * 3 + p_partkey AS VARCHAR) AS shown FROM part")
def small_programs(spark, d):
    """A two-statement program per part, compiled and run."""
    run = plain.vectorised(lambda s: plain.run_program(s)["stdout"][0], "string")
    source = F.concat(F.lit("let a = "), F.col("p_size").cast("string"), F.lit("; a * (1 + 2) + "), F.col("p_partkey").cast("string"))
    return load(spark, d, "part").select("p_partkey", run(source).alias("shown"))


from lodegraph.plans import index as index_plans  # noqa: E402
from lodegraph.session import cut_lineage  # noqa: E402
from lodegraph.sources.c_facts import c_facts  # noqa: E402


@query()
def c_index(spark, d):
    """Edges and weak calls per kind of the graphs indexed from the C files."""
    files = load(spark, d, "source_files").where(r"content is not null and source_file rlike '\\.[ch]$'").select("graph_name", "source_file", "content").dropDuplicates(["graph_name", "source_file"])
    t = index_plans.c_graph_from_facts(cut_lineage(c_facts(files)), files)
    kinds = t["relationships"].select("graph_name", "type").unionByName(t["call_observations"].select("graph_name", F.col("reason").alias("type")))
    return kinds.groupBy("graph_name", "type").agg(F.count(F.lit(1)).alias("n"))

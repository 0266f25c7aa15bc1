"""Queries that compare two bodies of facts: the last two snapshots of each graph stand for the two sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodegraph.current import current
from lodegraph.functions.spans import call_line, first_line, last_line
from lodegraph.operators import audit, comparisons, intervals, lookup
from lodegraph.plans.graph_queries import _LAST, _PAIR, HUB, _cur, _two

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


def _side(name: str, columns: str, k: int, alias: str) -> str:
    return f"{alias} AS (SELECT DISTINCT graph_name, {columns} FROM {name} SEMI JOIN (SELECT graph_name, snapshot_id FROM o WHERE k = {k}) USING (graph_name, snapshot_id))"


_CALL_COLUMNS = "id, source, target, type, source_file, span"
_LINE = "TRY_CAST(nullif(regexp_extract(span, '^\\s*([0-9]+)\\s*(:|$)', 1), '') AS INT)"
_COL = "TRY_CAST(nullif(regexp_extract(span, '^[0-9]+:([0-9]+)', 1), '') AS INT)"
_CALL = f"""SELECT *, CASE WHEN line % 3 <> 0 THEN line * 1000 + col END AS byte_offset FROM (SELECT concat_ws(chr(31), graph_name, id, source, target, source_file, span) AS row_id,
 graph_name || '|' || source AS caller, graph_name || '/' || source_file AS path, target, {_LINE} AS line, {_COL} AS col FROM {{t}} WHERE type = 'calls')"""


def _match_sql(tag: str, left: str, right: str) -> str:
    """CTEs that pair two sides one to one, by offset and then by line and column: the last is {tag}."""
    n = lambda keys: f"row_number() OVER (PARTITION BY {keys} ORDER BY row_id) AS n"
    exact, near = "caller, path, target, byte_offset", "caller, path, target, line, col"
    return f"""{tag}1 AS (SELECT l.row_id AS left_id, r.row_id AS right_id FROM (SELECT *, {n(exact)} FROM {left} WHERE byte_offset IS NOT NULL) l JOIN (SELECT *, {n(exact)} FROM {right} WHERE byte_offset IS NOT NULL) r USING ({exact}, n)),
{tag}2 AS (SELECT l.row_id AS left_id, r.row_id AS right_id FROM (SELECT *, {n(near)} FROM {left} WHERE row_id NOT IN (SELECT left_id FROM {tag}1)) l FULL JOIN (SELECT *, {n(near)} FROM {right} WHERE row_id NOT IN (SELECT right_id FROM {tag}1)) r USING ({near}, n)),
{tag} AS (SELECT *, 'matched_offset' AS bucket FROM {tag}1 UNION ALL SELECT *, CASE WHEN right_id IS NULL THEN 'compiler_only' WHEN left_id IS NULL THEN 'stated_only' ELSE 'matched_position' END FROM {tag}2)"""


def _calls_of(rows):
    span = F.col("span")
    col = F.regexp_extract(span, r"^[0-9]+:([0-9]+)", 1)
    out = rows.where("type = 'calls'").select(
        F.concat_ws("\x1f", "graph_name", "id", "source", "target", "source_file", "span").alias("row_id"), F.concat("graph_name", F.lit("|"), "source").alias("caller"),
        F.concat("graph_name", F.lit("/"), "source_file").alias("path"), "target", call_line(span).alias("line"), F.when(col != "", col.try_cast("int")).alias("col"),
    )
    return out.withColumn("byte_offset", F.when(F.col("line") % 3 != 0, F.col("line") * 1000 + F.col("col")))


_CALL_SIDES = f"{_PAIR}, {_side('relationships', _CALL_COLUMNS, 2, 'ra')}, {_side('relationships', _CALL_COLUMNS, 1, 'rb')}, a AS ({_CALL.format(t='ra')}), b AS ({_CALL.format(t='rb')})"


@query(f"WITH {_CALL_SIDES}, {_match_sql('m', 'a', 'b')} SELECT * FROM m")
def matched_calls(spark, d):
    before, after = _two(spark, d, "relationships", *_CALL_COLUMNS.split(", "))
    return audit.match_calls(_calls_of(before), _calls_of(after))


_CLASS = f"CASE WHEN target = '{HUB}' THEN 'external_direct' WHEN line % 7 = 0 THEN 'macro_location_unsupported' WHEN line % 11 = 0 THEN 'indirect' WHEN line % 13 = 0 THEN 'odd' ELSE 'internal_direct' END"


@query(f"""WITH {_CALL_SIDES}, ac AS (SELECT *, {_CLASS} AS call_class FROM a), i AS (SELECT * FROM ac WHERE call_class = 'internal_direct' AND caller <> '' AND target <> ''),
sc AS (SELECT DISTINCT path FROM b WHERE length(path) % 5 <> 0), s AS (SELECT b.* FROM b SEMI JOIN sc USING (path)), {_match_sql('m', 'i', 's')},
x AS (SELECT * REPLACE ('' AS target) FROM ac WHERE call_class <> 'internal_direct'), y AS (SELECT * REPLACE ('' AS target) FROM s WHERE row_id IN (SELECT right_id FROM m WHERE left_id IS NULL)), {_match_sql('w', 'x', 'y')}
SELECT left_id, right_id, CASE WHEN right_id IS NULL THEN 'compiler_only_internal' ELSE 'matched_internal' END AS bucket FROM m WHERE left_id IS NOT NULL
UNION ALL SELECT row_id, NULL, CASE call_class WHEN 'internal_direct' THEN 'compiler_only_internal' WHEN 'external_direct' THEN 'external_direct' WHEN 'indirect' THEN 'indirect' WHEN 'macro_location_unsupported' THEN 'macro_unsupported' ELSE 'ambiguous' END FROM ac WHERE row_id NOT IN (SELECT row_id FROM i)
UNION ALL SELECT NULL, right_id, CASE WHEN left_id IS NULL THEN 'stated_only' ELSE 'covered_by_other' END FROM w WHERE right_id IS NOT NULL
UNION ALL SELECT NULL, row_id, 'out_of_scope' FROM b ANTI JOIN sc USING (path)""")
def call_buckets(spark, d):
    before, after = (_calls_of(x) for x in _two(spark, d, "relationships", *_CALL_COLUMNS.split(", ")))
    call_class = F.expr(_CLASS)
    return audit.call_buckets(before.withColumn("call_class", call_class), after, after.where("length(path) % 5 <> 0").select("path"))


_FN = "id, title, type, source_file, span"
_FIRST = "TRY_CAST(nullif(regexp_extract(span, '^([0-9]+):[0-9]+(-[0-9]+:[0-9]+)?$', 1), '') AS INT)"
_SITES = f"SELECT DISTINCT type AS kind, title AS name, graph_name || '/' || source_file AS path, {_FIRST} AS line, {_COL} AS col FROM {{t}}"


def _sites_of(rows):
    col = F.regexp_extract("span", r"^[0-9]+:([0-9]+)", 1)
    return rows.select(F.col("type").alias("kind"), F.col("title").alias("name"), F.concat("graph_name", F.lit("/"), "source_file").alias("path"), first_line(F.col("span")).alias("line"), F.when(col != "", col.try_cast("int")).alias("col")).distinct()


_ENTITY_SIDES = f"{_PAIR}, {_side('entities', _FN, 2, 'ea')}, {_side('entities', _FN, 1, 'eb')}, a AS ({_SITES.format(t='ea')}), b AS ({_SITES.format(t='eb')})"


@query(f"""WITH {_ENTITY_SIDES}, x AS (SELECT path, name, count(*) AS n, min(line) AS l FROM a WHERE kind IN ('fn', 'function', 'method') GROUP BY ALL), y AS (SELECT path, name, count(*) AS n, min(line) AS l FROM b WHERE kind IN ('fn', 'function', 'method') GROUP BY ALL)
SELECT path, name, CASE WHEN y.n IS NULL THEN 'compiler_only' WHEN x.n IS NULL THEN 'stated_only' WHEN x.n > 1 OR y.n > 1 OR abs(x.l - y.l) > 2 THEN 'ambiguous' ELSE 'matched' END AS bucket FROM x FULL JOIN y USING (path, name)""")
def matched_definitions(spark, d):
    before, after = (_sites_of(x).where("kind in ('fn', 'function', 'method')") for x in _two(spark, d, "entities", *_FN.split(", ")))
    return audit.match_definitions(before, after)


@query(f"""WITH {_ENTITY_SIDES}, j AS (SELECT kind, name, path, line, col, a.z AS az, b.z AS bz FROM (SELECT *, 1 AS z FROM a) a FULL JOIN (SELECT *, 1 AS z FROM b) b USING (kind, name, path, line, col)),
k AS (SELECT *, max(az + bz) OVER (PARTITION BY kind, name) IS NOT NULL AS matched FROM j)
SELECT kind, name, path, line, col, CASE WHEN az + bz = 2 THEN 'matched' WHEN az = 1 AND matched THEN 'alternate' WHEN az = 1 THEN 'compiler_only' ELSE 'stated_only' END AS bucket FROM k""")
def matched_declarations(spark, d):
    before, after = (_sites_of(x) for x in _two(spark, d, "entities", *_FN.split(", ")))
    return audit.match_declarations(before, after)


@query(f"""WITH {_PAIR}, {_side('relationships', 'id, source, target, type', 2, 'ra')}, {_side('relationships', 'id, source, target, type', 1, 'rb')},
a AS (SELECT graph_name || '|' || source AS registry, target AS key, max(id) AS v FROM ra WHERE type = 'uses_data' AND source <> '' AND target <> '' GROUP BY ALL), b AS (SELECT graph_name || '|' || source AS registry, target AS key, max(id) AS v FROM rb WHERE type = 'uses_data' AND source <> '' AND target <> '' GROUP BY ALL)
SELECT registry, key, CASE WHEN registry NOT IN (SELECT registry FROM a) THEN 'undetected' WHEN a.v IS NULL THEN 'missed' WHEN b.v IS NULL THEN 'false_positive' WHEN a.v = b.v THEN 'agree' ELSE 'disagree' END AS bucket FROM a FULL JOIN b USING (registry, key)""")
def registry_buckets(spark, d):
    shape = lambda x: x.where("type = 'uses_data' and source <> '' and target <> '' and id is not null").select(F.concat("graph_name", F.lit("|"), "source").alias("registry"), F.col("target").alias("key"), F.col("id").alias("value"))
    before, after = _two(spark, d, "relationships", "id", "source", "target", "type")
    return comparisons.registry_comparison(shape(before), shape(after))


@query(f"""WITH {_LAST}, {_cur('relationships', 'id, target, type, source_file', 'r')}, {_cur('entities', 'title, source_file, type', 'e')},
x AS (SELECT DISTINCT graph_name || '|' || id AS export, graph_name || '|' || regexp_extract(target, '([^:.]*)$', 1) AS name, graph_name || '/' || source_file AS origin_file FROM r WHERE type = 'calls' AND target <> ''),
f AS (SELECT DISTINCT graph_name || '|' || regexp_extract(regexp_extract(title, ':(.*)$', 1), '([^.]*)$', 1) AS name, graph_name || ':' || title AS title, graph_name || '/' || source_file AS source_file FROM e WHERE regexp_extract(regexp_extract(title, ':(.*)$', 1), '([^.]*)$', 1) <> ''),
p AS (SELECT export, count_if(f.source_file = origin_file) AS h, max(CASE WHEN f.source_file = origin_file THEN title END) AS t, count(title) AS n FROM x LEFT JOIN f USING (name) GROUP BY 1)
SELECT export, CASE WHEN h = 1 THEN t END AS title, CASE WHEN h = 1 THEN 'resolved' WHEN h > 1 THEN 'ambiguous' WHEN n > 0 THEN 'other_file' ELSE 'unknown' END AS outcome FROM p WHERE export IS NOT NULL""")
def matched_exports(spark, d):
    """Names that the calls of a file use, against the entities of that file and of others."""
    r = current(spark, d, "relationships", "id", "target", "type", "source_file").where("type = 'calls' and target <> '' and id is not null")
    exports = r.select(F.concat("graph_name", F.lit("|"), "id").alias("export"), F.concat("graph_name", F.lit("|"), F.regexp_extract("target", r"([^:.]*)$", 1)).alias("name"), F.concat("graph_name", F.lit("/"), "source_file").alias("origin_file")).distinct()
    e = current(spark, d, "entities", "title", "source_file", "type")
    # a graph's names stand apart: the graph is written before the last part of a title
    graph, tail = F.col("graph_name"), F.substring_index(F.regexp_extract("title", r":(.*)$", 1), ".", -1)
    named = e.where(tail != "").select(F.concat(graph, F.lit(":"), "title").alias("title"), F.concat(graph, F.lit("/"), "source_file").alias("source_file"), F.concat(graph, F.lit("|"), tail).alias("name"))
    return comparisons.match_exports(exports, named)


@query(f"""WITH {_LAST}, {_cur('entities', 'id, title, type, source_file, span', 'e')}, {_cur('call_observations', 'source, reason, source_file, span', 'o')},
f AS (SELECT *, {_FIRST} AS a, coalesce(TRY_CAST(nullif(regexp_extract(span, '^[0-9]+:[0-9]+-([0-9]+):[0-9]+$', 1), '') AS INT), {_FIRST}) AS z, regexp_extract(title, '([^:]*)$', 1) AS bare FROM e),
s AS (SELECT graph_name, source_file, reason, {_LINE} AS line, regexp_extract(source, '([^:]*)$', 1) AS enclosing FROM o),
u AS (SELECT graph_name, source_file, f.id, reason FROM f JOIN s USING (graph_name, source_file) WHERE line BETWEEN a AND z
 UNION ALL SELECT graph_name, source_file, f.id, reason FROM f JOIN s USING (graph_name, source_file) WHERE f.type IN ('method', 'fn', 'function', 'class') AND bare = enclosing AND (a IS NULL OR line BETWEEN a - 1 AND z + 1)
 UNION ALL SELECT graph_name, source_file, f.id, reason FROM f JOIN s USING (graph_name, source_file) WHERE f.type = 'class' AND contains(enclosing, '.') AND bare = regexp_replace(enclosing, '\\.[^.]*$', ''))
SELECT graph_name, source_file, id, coalesce(list_sort(list(DISTINCT reason) FILTER (reason IS NOT NULL)), []) AS reasons FROM u GROUP BY ALL""")
def dynamic_stamps(spark, d):
    s, keys = F.col("span"), ["graph_name", "source_file"]
    facts = current(spark, d, "entities", "id", "title", "type", "source_file", "span").select(*keys, "id", "title", "type", first_line(s).alias("first"), last_line(s).alias("last"))
    o = current(spark, d, "call_observations", "source", "reason", "source_file", "span")
    sites = o.select(*keys, call_line(s).alias("first"), call_line(s).alias("last"), F.substring_index("source", ":", -1).alias("enclosing"), "reason")
    return intervals.dynamic_reasons(facts, sites, keys)


@query(f"WITH {_LAST}, {_cur('entities', 'id, title, type', 'e')} SELECT graph_name, id, title, type FROM e WHERE title = '{HUB}'")
def entity_get(spark, d):
    return lookup.get_entity(current(spark, d, "entities", "id", "title", "type"), HUB)

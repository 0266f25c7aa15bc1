"""Source trees to graph tables: scan, resolve across files, demote weak calls, attach texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodegraph.functions.text import fingerprint, n_tokens, short_digest, slug
from lodegraph.operators.construct import CONFIDENCE, module_keys, resolve_titles, symbol_titles
from lodegraph.sources.c_facts import c_facts
from lodegraph.sources.files import c_sources, python_sources
from lodegraph.sources.python_facts import python_facts
from lodegraph.session import cut_lineage
from lodegraph.sources.snapshot_store import tables_of
from lodegraph.tables import GraphTables

BY = "graph_name"
EXTRACTOR = "python-ast"


def _span() -> F.Column:
    return F.concat(F.col("first").cast("string"), F.lit(":0-"), F.col("last").cast("string"), F.lit(":0"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows numbered through their graph by (source_file, order): ranked within a file, behind the rows of the files before it."""
    before = Window.partitionBy(BY).orderBy("source_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(BY, "source_file").agg(F.count(F.lit(1)).alias("_n")).select(BY, "source_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy(BY, "source_file").orderBy(*order))
    return rows.withColumn("_own", own).join(starts, [BY, "source_file"]).withColumn("human_readable_id", F.col("_start") + F.col("_own")).drop("_own", "_start")


def graph_from_facts(facts: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """The four tables of each graph from the facts of its files, with graph_name."""
    stem = F.regexp_extract("source_file", r"([^/]+)\.[^./]+$", 1)
    found = facts.where("record = 'entity'").groupBy(BY, "source_file", "type", F.col("source").alias("title")).agg(F.min("first").alias("first"), F.max("last").alias("last"))
    entity_id = F.concat_ws(":", F.lit("ent"), "type", "title")
    lines = files.select(BY, "source_file", F.split("content", r"\r?\n").alias("lines"))
    with_text = numbered(found, ["first", "title", "type"]).join(lines, [BY, "source_file"])
    snippet = F.array_join(F.slice("lines", F.col("first"), F.greatest(F.col("last") - F.col("first") + 1, F.lit(1))), "\n")
    unit_id = F.concat(F.lit("tu:"), F.lower(slug("title")))
    whole = F.col("type").isin("file", "module")
    described = with_text.withColumn("snippet", F.when(~whole, snippet))
    entities = described.select(
        BY, entity_id.alias("id"), "title", "type", F.concat_ws(" ", "type", "title").alias("description"), "snippet",
        F.when(~whole, F.array(unit_id)).otherwise(F.array().cast("array<string>")).alias("text_unit_ids"), "human_readable_id", "source_file",
        F.when(F.col("type") == "module", "module").otherwise(_span()).alias("span"), F.lit(EXTRACTOR).alias("extractor"), F.lit(1.0).alias("confidence"), F.lit(True).alias("is_deterministic"),
    )
    units = described.where(~whole & F.col("snippet").isNotNull()).select(
        BY, unit_id.alias("id"), "human_readable_id", F.col("snippet").alias("text"), n_tokens("snippet").cast("bigint").alias("n_tokens"), F.col("source_file").alias("document_id"),
        entity_id.alias("entity_id"), F.array(entity_id).alias("entity_ids"), "source_file", _span().alias("span"), F.lit(EXTRACTOR).alias("extractor"), F.lit(1.0).alias("confidence"), F.lit(True).alias("is_deterministic"),
    ).dropDuplicates([BY, "id"])
    edges = facts.where("record = 'edge'").withColumn("stem", stem)
    known = entities.select(BY, "id", "title", F.col("human_readable_id").alias("ordinal"))
    names = resolve_titles(edges.select(BY, F.col("target").alias("raw"), "stem"), known)
    hit = names.where("step <> 'raw'").select(BY, F.col("raw").alias("target"), "stem", F.col("title").alias("resolved"), "step")
    joined = edges.join(hit, [BY, "target", "stem"], "left")
    far = (F.col("step") == "bare") & (F.col("type") == "calls")
    target = F.coalesce("resolved", F.when(F.col("type") == "imports", F.col("target")))
    kept = joined.withColumns({
        "confidence": F.when(far, F.least("confidence", F.lit(0.75))).otherwise(F.col("confidence")),
        "is_deterministic": F.when(far, False).otherwise(F.col("is_deterministic")),
        "full": target,
    }).where("full is not null")
    rel_id = F.concat_ws(":", F.lit("rel"), "type", short_digest(F.col("type"), F.col("source"), F.col("full"), F.col("first").cast("string")))
    relationships = numbered(kept, ["first", "source", "full", "type"]).select(
        BY, rel_id.alias("id"), "source", F.col("full").alias("target"), "type", F.concat_ws(" ", "source", "type", "full").alias("description"), F.col("confidence").alias("weight"),
        F.array(F.concat(F.lit("tu:"), F.lower(slug("source")))).alias("text_unit_ids"), "human_readable_id",
        "source_file", F.concat(F.col("first").cast("string"), F.lit(":0")).alias("span"), F.lit(EXTRACTOR).alias("extractor"), "confidence", "is_deterministic", F.col("detail").alias("fact_kind"), F.col("resolved").alias("resolved_target_hint"),
    ).dropDuplicates([BY, "id"])
    weak = facts.where("record in ('observation', 'candidate')").select(
        BY, "source", F.col("target").alias("display_target"), "confidence", F.when(F.col("record") == "candidate", "registry candidate").otherwise(F.col("detail")).alias("reason"),
        "source_file", F.concat(F.col("first").cast("string"), F.lit(":0")).alias("span"), F.lit(EXTRACTOR).alias("extractor"), F.concat_ws(" calls ", "source", "target").alias("description"),
    )
    refs = relationships.select(BY, F.explode("text_unit_ids").alias("id"), F.col("id").alias("rel")).groupBy(BY, "id").agg(F.sort_array(F.collect_set("rel")).alias("relationship_ids"))
    units = units.join(refs, [BY, "id"], "left").withColumn("relationship_ids", F.coalesce("relationship_ids", F.array().cast("array<string>")))
    return {"entities": entities, "relationships": relationships, "text_units": units, "call_observations": weak}


def stamp_dynamic(entities: DataFrame, facts: DataFrame) -> DataFrame:
    """Flags and sorted reasons of the dynamic sites inside each entity; earlier stamps are replaced."""
    from lodegraph.functions.spans import first_line, last_line
    from lodegraph.operators.intervals import dynamic_reasons

    s = F.col("span")
    spots = entities.select(BY, "source_file", "id", "title", "type", first_line(s).alias("first"), last_line(s).alias("last"))
    sites = facts.where("record = 'site'").select(BY, "source_file", "first", "last", F.regexp_extract("target", r"(.*)", 1).alias("enclosing"), F.col("detail").alias("reason"))
    why = dynamic_reasons(spots, sites, [BY, "source_file"]).select(BY, "id", "reasons")
    plain = entities.drop("dynamic_dependent", "dynamic_reasons").join(why, [BY, "id"], "left")
    return plain.withColumns({"dynamic_dependent": F.col("reasons").isNotNull(), "dynamic_reasons": F.coalesce("reasons", F.array().cast("array<string>"))}).drop("reasons")


def index_python(spark: SparkSession, package: str, graph: str = "graph") -> GraphTables:
    """Graph tables of the Python package in a directory."""
    files = python_sources(spark, package).select(F.lit(graph).alias(BY), "source_file", "content")
    facts = cut_lineage(python_facts(files))  # read by every table: scanned once
    tables = graph_from_facts(facts, files)
    tables["entities"] = stamp_dynamic(tables["entities"], facts)
    return tables_of({k: v.drop(BY) for k, v in tables.items()}, spark)


def c_graph_from_facts(facts: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """Tables of C graphs: titles by module key, calls to the one definition a name means, the rest observed.

    A static function of the same file comes before one of another file; a name with several external
    definitions is ambiguous.  ``contains`` starts at the id of the file entity.
    """
    keys = module_keys(files)
    found = facts.where("record = 'entity'").join(keys, [BY, "source_file"])
    titled = symbol_titles(found).withColumnRenamed("kind", "type")
    symbols = found.select(BY, "source_file", "module_key", F.col("kind").alias("type"), "name", "first", "last", "is_static").join(titled, [BY, "module_key", "type", "name"])
    file_rows = files.select(BY, "source_file", F.regexp_extract("source_file", r"([^/]+)$", 1).alias("title")).distinct()
    lines = files.select(BY, "source_file", F.split("content", r"\r?\n").alias("lines")).dropDuplicates([BY, "source_file"])
    eid = F.concat_ws(":", F.lit("ent"), "type", "title")
    base = symbols.groupBy(BY, "source_file", "type", "title", "name").agg(F.min("first").alias("first"), F.max("last").alias("last")).join(lines, [BY, "source_file"])
    snippet = F.array_join(F.slice("lines", F.col("first"), F.greatest(F.col("last") - F.col("first") + 1, F.lit(1))), "\n")
    unit = F.concat(F.lit("tu:"), F.lower(slug("title")))
    stamp = [F.lit("c-scan").alias("extractor"), F.lit(1.0).alias("confidence"), F.lit(True).alias("is_deterministic")]
    code = base.select(BY, eid.alias("id"), "title", "type", F.concat_ws(" ", "type", "title").alias("description"), snippet.alias("snippet"), F.array(unit).alias("text_unit_ids"), "source_file", _span().alias("span"), F.col("name").alias("symbol_name"), *stamp)
    whole = file_rows.select(BY, F.concat(F.lit("ent:file:"), "source_file").alias("id"), "title", F.lit("file").alias("type"), F.concat(F.lit("file "), "title").alias("description"), F.lit(None).cast("string").alias("snippet"),
                             F.array().cast("array<string>").alias("text_unit_ids"), "source_file", F.lit("1:0").alias("span"), F.lit(None).cast("string").alias("symbol_name"), *stamp)
    entities = code.unionByName(whole).dropDuplicates([BY, "id"])
    functions = symbols.where("type = 'function'").select(BY, "source_file", F.col("name").alias("target"), "title", "is_static").distinct()
    own = functions.groupBy(BY, "source_file", "target").agg(F.max("title").alias("own"))
    far = functions.where("not is_static").groupBy(BY, "target").agg(F.countDistinct("title").alias("n"), F.max("title").alias("far"))
    callers = functions.select(BY, "source_file", F.col("target").alias("name"), F.col("title").alias("source")).distinct()
    calls = facts.where("record = 'call'").select(BY, "source_file", "name", "target", "first").join(callers, [BY, "source_file", "name"])
    calls = calls.join(own, [BY, "source_file", "target"], "left").join(far, [BY, "target"], "left").withColumn("hit", F.coalesce("own", F.when(F.col("n") == 1, F.col("far"))))
    place = F.concat(F.col("first").cast("string"), F.lit(":0")).alias("span")

    def edge(df: DataFrame, kind: str, source, target, confidence: float, span) -> DataFrame:
        rid = F.concat_ws(":", F.lit("rel"), F.lit(kind), short_digest(F.lit(kind), source, target, F.coalesce(span, F.lit(""))))
        return df.select(BY, rid.alias("id"), source.alias("source"), target.alias("target"), F.lit(kind).alias("type"), F.concat_ws(" ", source, F.lit(kind), target).alias("description"), F.lit(confidence).alias("weight"),
                         "source_file", span.alias("span"), F.lit("c-scan").alias("extractor"), F.lit(confidence).alias("confidence"), F.lit(True).alias("is_deterministic"))

    c = F.col
    holds = edge(code, "contains", F.concat(F.lit("ent:file:"), c("source_file")), c("title"), 1.0, F.lit(""))
    called = edge(calls.where("hit is not null"), "calls", c("source"), c("hit"), CONFIDENCE["c_call"], F.concat(c("first").cast("string"), F.lit(":0")))
    by_name = file_rows.select(BY, c("title").alias("base"), c("source_file").alias("there")).groupBy(BY, "base").agg(F.count(F.lit(1)).alias("n"), F.max("there").alias("there"))
    inc = facts.where("record = 'include'").select(BY, "source_file", F.substring_index("target", "/", -1).alias("base"), "first").join(by_name.where("n = 1"), [BY, "base"])
    included = edge(inc, "includes", F.regexp_extract("source_file", r"([^/]+)$", 1), c("base"), 1.0, F.concat(c("first").cast("string"), F.lit(":0")))
    relationships = holds.unionByName(called).unionByName(included).dropDuplicates([BY, "id"])
    reason = F.when(c("n") > 1, "ambiguous C call").otherwise("external/undefined C call")
    weak = calls.where("hit is null").select(BY, "source", c("target").alias("display_target"), F.lit(CONFIDENCE["weak"]).alias("confidence"), reason.alias("reason"), "source_file", place, F.lit("c-scan").alias("extractor"), F.concat_ws(" calls ", "source", "target").alias("description"))
    units = code.select(BY, unit.alias("id"), c("snippet").alias("text"), n_tokens("snippet").cast("bigint").alias("n_tokens"), c("source_file").alias("document_id"), c("id").alias("entity_id"), F.array("id").alias("entity_ids"), "source_file", "span", *stamp).dropDuplicates([BY, "id"])
    return {"entities": entities, "relationships": relationships, "text_units": units, "call_observations": weak}


def index_c(spark: SparkSession, package: str, graph: str = "graph") -> GraphTables:
    """Graph tables of the C package in a directory."""
    files = c_sources(spark, package).select(F.lit(graph).alias(BY), "source_file", "content")
    tables = c_graph_from_facts(cut_lineage(c_facts(files)), files)
    return tables_of({k: v.drop(BY) for k, v in tables.items()}, spark)


def input_fingerprint(files: DataFrame) -> str:
    """SHA-256 over the ordered (path, content digest) records of a source tree."""
    record = F.concat_ws("\0", "source_file", F.sha2("content", 256))
    return files.agg(F.sort_array(F.collect_list(record)).alias("r")).select(fingerprint(F.col("r"))).first()[0]

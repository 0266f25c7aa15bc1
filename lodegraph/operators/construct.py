"""Rules that turn extracted facts into edges: names, tiers, observations, identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodegraph.functions.text import short_digest

BY = "graph_name"

#: What a call's description says about why it is weak, in order of precedence.
WEAK_REASONS = (
    ("builtin container", "builtin/container call observation"),
    ("ambiguous annotation", "ambiguous annotation"),
    ("ambiguous constructors", "ambiguous constructors"),
    ("guarded by reassignment", "guarded by reassignment"),
    ("unresolved receiver", "unresolved receiver"),
)
#: Confidence by how an edge was found.
CONFIDENCE = {
    "structural": 1.0, "inherits": 0.95, "data": 0.90, "reference": 0.90, "c_call": 0.90, "import_hint": 0.85, "property": 0.85, "typed_call": 0.80,
    "local_name": 0.75, "cross_file": 0.75, "registry": 0.75, "super_init": 0.75, "imported_name": 0.65, "ambiguous": 0.50, "weak": 0.40, "candidate": 0.35,
}


def tier(kind: Column) -> Column:
    return F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in CONFIDENCE.items()])


def resolve_titles(refs: DataFrame, entities: DataFrame) -> DataFrame:
    """Raw references to titles: (graph_name, raw, stem, title, step).

    Steps: the title itself; an id; an extractor id seen from its module; a symbol seen from its module;
    the first entity of the bare name; the raw text.  ``refs``: graph_name, raw, stem; ``entities``:
    graph_name, id, title, ordinal (the order in which "first" is meant).
    """
    titles = entities.groupBy(BY, "title").agg(F.min("ordinal").alias("ordinal"))
    known = titles.select(BY, "title", F.lit(True).alias("hit"))
    by_id = entities.groupBy(BY, F.col("id").alias("raw")).agg(F.min_by("title", "ordinal").alias("of_id"))
    bare = titles.groupBy(BY, F.substring_index("title", ":", -1).alias("bare")).agg(F.min_by("title", F.struct("ordinal", "title")).alias("of_bare"))
    raw = F.col("raw")
    parts = F.split(raw, ":")
    internal = raw.startswith("ent:") & (F.size(parts) >= 3)
    tail = F.when(parts[1] == "file", F.array_join(F.slice(parts, 3, 1000), ":")).when(F.size(parts) >= 4, F.array_join(F.slice(parts, 4, 1000), ":")).otherwise(F.element_at(parts, -1))
    r = refs.select(BY, "raw", "stem").distinct().withColumns({
        "c_internal": F.when(internal, F.concat_ws(":", "stem", tail)),
        "c_dotted": F.when(internal, F.concat_ws(":", "stem", F.replace(tail, F.lit("_"), F.lit(".")))),
        "c_context": F.when(F.instr("raw", ":") > 0, F.concat_ws(":", "stem", F.regexp_extract("raw", r":(.*)$", 1))),
        "bare": F.regexp_replace(F.substring_index("raw", ":", -1), r"(?U)^\s+|\s+$", ""),
    })
    for column in ("raw", "c_internal", "c_dotted", "c_context"):
        r = r.join(known.select(BY, F.col("title").alias(column), F.col("hit").alias(f"hit_{column}")), [BY, column], "left")
    r = r.join(by_id, [BY, "raw"], "left").join(bare, [BY, "bare"], "left")
    steps = [
        ("title", F.col("hit_raw"), raw), ("id", F.col("of_id").isNotNull(), F.col("of_id")), ("internal", F.col("hit_c_internal"), F.col("c_internal")),
        ("dotted", F.col("hit_c_dotted"), F.col("c_dotted")), ("context", F.col("hit_c_context"), F.col("c_context")), ("bare", F.col("of_bare").isNotNull(), F.col("of_bare")),
    ]
    title, step = raw, F.lit("raw")
    for name, test, value in reversed(steps):
        title, step = F.when(test, value).otherwise(title), F.when(test, name).otherwise(step)
    return r.where(raw.isNotNull() & (raw != "")).select(BY, "raw", "stem", title.alias("title"), step.alias("step"))


def demote_weak_calls(edges: DataFrame) -> DataFrame:
    """Each edge with ``observed`` (it is also a weak fact), its reason, and ``kept`` (it stays an edge).

    Only calls of the import-aware extractor are judged.  A call below 0.7 or without a resolved hint
    leaves the edges; one with a telling description is observed even if it stays.
    """
    judged = (F.col("type") == "calls") & F.col("extractor").contains("+ast")
    conf = F.coalesce(F.when(~F.isnan("confidence"), F.col("confidence")), F.lit(0.0))
    hinted = F.coalesce(F.col("resolved_target_hint"), F.lit("")) != ""
    told = F.coalesce(*[F.when(F.col("description").contains(k), v) for k, v in WEAK_REASONS], F.when(conf < 0.6, "low confidence"))
    leaves = (conf < 0.7) | ~hinted
    observed = judged & (told.isNotNull() | leaves)
    return edges.withColumns({
        "observed": F.coalesce(observed, F.lit(False)),
        "reason": F.when(observed, F.coalesce(told, F.lit("low confidence call observation"))),
        "kept": ~F.coalesce(judged & leaves, F.lit(False)),
    })


def upgrade_bare_targets(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """A bare call target that exactly one title ends with becomes that title, at 0.75 and not deterministic."""
    one = (
        entities.select(BY, "title").distinct().groupBy(BY, F.substring_index("title", ":", -1).alias("target"))
        .agg(F.count(F.lit(1)).alias("n"), F.max("title").alias("full")).where("n = 1").drop("n")
    )
    j = edges.join(one, [BY, "target"], "left")
    hit = (F.col("type") == "calls") & (F.instr("target", ":") == 0) & F.col("full").isNotNull()
    return j.withColumns({
        "confidence": F.when(hit, CONFIDENCE["cross_file"]).otherwise(F.col("confidence")),
        "is_deterministic": F.when(hit, False).otherwise(F.col("is_deterministic")),
        "upgraded": F.coalesce(hit, F.lit(False)),
        "target": F.when(hit, F.col("full")).otherwise(F.col("target")),
    }).drop("full")


def import_hints(edges: DataFrame, imports: DataFrame) -> DataFrame:
    """Calls whose receiver is an imported name get the import's target and at least 0.85."""
    hint = imports.groupBy(BY, "source_file", F.col("name").alias("receiver")).agg(F.max("target").alias("hint"))
    j = edges.join(hint, [BY, "source_file", "receiver"], "left")
    found = F.col("hint").isNotNull()
    return j.withColumns({
        "resolved_target_hint": F.when(found, F.col("hint")).otherwise(F.col("resolved_target_hint")),
        "confidence": F.when(found, F.greatest("confidence", F.lit(CONFIDENCE["import_hint"]))).otherwise(F.col("confidence")),
    }).drop("hint")


def attribute_tiers(facts: DataFrame) -> DataFrame:
    """Confidence of attribute calls from what is known of the receiver.

    ``facts``: is_container, is_ambiguous, is_guarded, n_types, is_import, is_class booleans and counts.
    """
    kind = (
        F.when(F.col("is_container"), "weak").when(F.col("is_ambiguous") | F.col("is_guarded"), "ambiguous")
        .when(F.col("is_import") | F.col("is_class") | (F.col("n_types") == 1), "typed_call").when(F.col("n_types") > 1, "ambiguous").otherwise("weak")
    )
    return facts.withColumns({"tier": kind, "confidence": tier(kind), "is_deterministic": kind == "typed_call"})


def module_keys(files: DataFrame) -> DataFrame:
    """Key of each C file: its stem, or parent/stem where several directories share the stem."""
    stem = F.regexp_extract("source_file", r"([^/]+)\.[^./]+$", 1)
    parent = F.regexp_extract("source_file", r"(?:^|/)([^/]+)/[^/]+$", 1)
    folder = F.regexp_replace("source_file", r"[^/]*$", "")
    f = files.select(BY, "source_file").distinct().withColumns({"stem": stem, "parent": parent, "folder": folder})
    same_stem = Window.partitionBy(BY, "stem")
    shared = F.coalesce(F.min("folder").over(same_stem) != F.max("folder").over(same_stem), F.lit(False))
    key = F.when(shared & (F.col("parent") != ""), F.concat_ws("/", "parent", "stem")).otherwise(F.col("stem"))
    return f.withColumn("module_key", key).select(BY, "source_file", "module_key")


def symbol_titles(symbols: DataFrame) -> DataFrame:
    """Title ``key:name``, or ``key:kind:name`` where kinds collide on a name."""
    same_name = Window.partitionBy(BY, "module_key", "name")
    collide = F.coalesce(F.min("kind").over(same_name) != F.max("kind").over(same_name), F.lit(False))
    plain = F.concat_ws(":", "module_key", "name")
    return symbols.select(BY, "module_key", "kind", "name").distinct().withColumn(
        "title", F.when(collide, F.concat_ws(":", "module_key", "kind", "name")).otherwise(plain)
    )


def disambiguate_ids(edges: DataFrame) -> DataFrame:
    """Edges that share an id get a digest of what tells them apart behind it."""
    n = F.count(F.lit(1)).over(Window.partitionBy(BY, "id"))
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("source", "target", "type", "span")]
    return edges.withColumn("new_id", F.when(n > 1, F.concat_ws(":", "id", short_digest(*parts))).otherwise(F.col("id")))


def append_unseen(edges: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """New edges whose keys no edge has yet, each once."""
    return more.dropDuplicates(keys).join(edges.select(*keys).distinct(), keys, "left_anti")


def makefile_dependencies(text: str) -> list[str]:
    """Prerequisites of the first rule of a dependency file, escapes undone."""
    import re

    joined = re.sub(r"\\\r?\n", " ", text)
    rule = re.match(r"(?:[^:\\]|\\.|:(?=\S))*:(?=\s|$)", joined.lstrip())
    body = joined.lstrip()[rule.end() :] if rule else ""
    body = body.split("\n", 1)[0]
    words = re.findall(r"(?:[^\s\\]|\\.)+", body)
    return [re.sub(r"\\(.)", r"\1", w).replace("$$", "$") for w in words]


def include_trace(trace: DataFrame) -> DataFrame:
    """Lines of an include trace: (unit, text) -> (unit, ord, depth, path); the dots are the depth."""
    lines = trace.select("unit", F.posexplode(F.split("text", r"\r?\n")).alias("ord", "line")).where(F.col("line").rlike(r"^\.+ "))
    return lines.select("unit", F.col("ord").cast("bigint").alias("ord"), F.length(F.regexp_extract("line", r"^(\.+) ", 1)).alias("depth"), F.regexp_extract("line", r"^\.+ (.*)$", 1).alias("path"))

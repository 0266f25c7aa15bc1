"""Row contracts of persisted facts: every violated rule is one row of an anomaly frame.

A contract looks at the decorated rows of one overlay.  Its state comes from the overlay's block in the
manifest: without a block the overlay is ``legacy_absent``, with ``enabled: false`` it is ``off``, else
``enabled``; a block that is no object is invalid, never legacy.  Rules are column expressions evaluated
in one scan; uniqueness and endpoints take one aggregation and one join each; manifest counts are compared
last.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodegraph.functions.text import short_digest

BY = "graph_name"


@dataclass(frozen=True)
class Contract:
    """What an overlay adds to its carrier rows and what must hold of them."""

    name: str
    carrier: str  # "entities" or "relationships"
    rows: str  # SQL test for the carrier rows that may be decorated
    fields: dict[str, str]  # overlay columns and their types
    marker: str  # column whose presence says that a row is decorated
    required: tuple[str, ...] = ()
    json_lists: tuple[str, ...] = ()
    counts: dict[str, str] = field(default_factory=dict)  # JSON list column -> count column
    endpoint_kinds: tuple[tuple[str, ...], tuple[str, ...]] | None = None
    pair_unique: bool = False
    deterministic: bool | None = None


_OBS = {"observations_json": "string", "compilers": "string", "entry_indices": "array<bigint>", "compile_commands_digest": "string"}


def _with(prefix: str, **more: str) -> dict[str, str]:
    return {f"{prefix}_{k}": v for k, v in (_OBS | more).items()}


CONTRACTS = {
    c.name: c
    for c in (
        Contract("type_use", "relationships", "type = 'uses_type'", _with("clang_type_use", kinds="array<string>", count="bigint", source_id="string", target_id="string"),
                 "clang_type_use_observations_json", ("clang_type_use_kinds", "clang_type_use_compile_commands_digest"), ("clang_type_use_observations_json",),
                 {"clang_type_use_observations_json": "clang_type_use_count"}, (("function", "struct", "typedef"), ("struct", "enum", "typedef")), True, True),
        Contract("type_shape", "entities", "type in ('struct', 'enum')", _with("clang_shape", member_names="string", member_count="bigint"),
                 "clang_shape_member_names", ("clang_shape_member_count", "clang_shape_compile_commands_digest"), ("clang_shape_member_names",), {"clang_shape_member_names": "clang_shape_member_count"}),
        Contract("type_declaration", "entities", "type in ('struct', 'enum', 'typedef')", _with("clang_type", site="string", qual_type="string"),
                 "clang_type_site", ("clang_type_compile_commands_digest",), ("clang_type_observations_json",)),
        Contract("signature", "entities", "type = 'function'", _with("clang_signature", qual_type="string", return_type="string", count="bigint"),
                 "clang_signature_qual_type", ("clang_signature_observations_json", "clang_signature_compile_commands_digest"), ("clang_signature_observations_json",), {"clang_signature_observations_json": "clang_signature_count"}),
        Contract("call", "relationships", "type = 'calls'", _with("clang_call", match_basis="string", byte_offset="bigint", count="bigint"),
                 "clang_call_match_basis", ("clang_call_observations_json", "clang_call_compile_commands_digest"), ("clang_call_observations_json",), {"clang_call_observations_json": "clang_call_count"}),
        Contract("dependency", "relationships", "type = 'depends_on'", {"compile_commands_digest": "string", "compiler": "string"}, "compile_commands_digest",
                 ("compiler",), (), {}, (("file",), ("file",)), True, True),
        Contract("include", "relationships", "type = 'includes'", {"compile_commands_digest": "string", "compiler": "string"}, "compile_commands_digest",
                 ("compiler",), (), {}, (("file",), ("file",)), True, True),
    )
}


def state_of(manifest: dict, name: str) -> str:
    """legacy_absent, off, enabled, or invalid."""
    if name not in manifest:
        return "legacy_absent"
    block = manifest[name]
    if not isinstance(block, dict) or not isinstance(block.get("enabled"), bool):
        return "invalid"
    return "enabled" if block["enabled"] else "off"


def _complete(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast(t) for c, t in fields.items() if c not in df.columns})


def row_anomalies(contract: Contract, rows: DataFrame, entities: DataFrame, state: str) -> DataFrame:
    """(graph_name, id, code) of every broken rule of the carrier rows."""
    df = _complete(rows.where(contract.rows), contract.fields)
    decorated = F.col(contract.marker).isNotNull()
    any_field = F.greatest(*[F.col(c).isNotNull().cast("int") for c in contract.fields]) == 1
    kind = "relationship" if contract.carrier == "relationships" else "entity"
    per_id = Window.partitionBy(BY, "id")
    conf = F.col("confidence")
    tests: list[tuple[str, Column]] = [
        (f"empty_{kind}_id", F.coalesce(F.trim("id"), F.lit("")) == ""),
        (f"duplicate_{kind}_id", F.count(F.lit(1)).over(per_id) > 1),
        ("partial_payload", any_field & F.greatest(*[F.col(c).isNull().cast("int") for c in (contract.marker, *contract.required)], F.lit(0)).cast("boolean")),
        ("confidence_boundary", F.isnan(conf) | (conf < 0) | (conf > 1)),
        ("nan_or_infinity", F.isnan(conf) | (F.abs(conf) == F.lit(float("inf")))),
    ]
    if state in ("off", "legacy_absent"):
        tests.append(("off_with_decorated_rows" if state == "off" else "legacy_block_missing_with_fields", any_field))
    if contract.deterministic is not None:
        tests.append(("field_mismatch", ~F.col("is_deterministic").eqNullSafe(F.lit(contract.deterministic))))
    for c in contract.json_lists:
        items = F.from_json(F.col(c), "array<string>")
        tests += [("malformed_json", F.col(c).isNotNull() & items.isNull()), ("empty_observations", F.size(items) == 0)]
        ordered = F.to_json(F.sort_array(items)) != F.to_json(items)
        tests.append(("non_canonical_order", F.col(c).isNotNull() & ordered))
        if c in contract.counts:
            tests.append(("observation_count_mismatch", items.isNotNull() & ~F.size(items).eqNullSafe(F.col(contract.counts[c]).cast("int"))))
    digest = next((c for c in contract.fields if c.endswith("digest")), None)
    if digest:
        tests.append(("digest_mismatch", decorated & ~F.col(digest).rlike("^[0-9a-f]{64}$")))
    if contract.pair_unique:
        pair = Window.partitionBy(BY, "source", "target")
        tests.append(("duplicate_endpoint_pair", F.col("source").isNotNull() & F.col("target").isNotNull() & (F.count(F.lit(1)).over(pair) > 1)))
    if contract.endpoint_kinds:
        for end, kinds in zip(("source", "target"), contract.endpoint_kinds, strict=True):
            known = entities.groupBy(BY, F.col("title").alias(end)).agg(F.countDistinct("id").alias(f"n_{end}"), F.max("type").alias(f"kind_{end}"))
            df = df.join(known, [BY, end], "left")
            tests += [
                (f"dangling_{end}", F.col(f"n_{end}").isNull()),
                (f"ambiguous_{end}_title", F.col(f"n_{end}") > 1),
                (f"invalid_{end}_kind", (F.col(f"n_{end}") == 1) & ~F.col(f"kind_{end}").isin(*kinds)),
            ]
    codes = F.array_compact(F.array(*[F.when(test, F.lit(code)) for code, test in tests]))
    # the windows of the uniqueness rules have to be computed before the list is unfolded
    return df.withColumn("_codes", codes).select(BY, "id", F.explode("_codes").alias("code")).distinct()


def manifest_anomalies(contract: Contract, rows: DataFrame, manifest: dict) -> list[tuple[str, str]]:
    """(code, detail) of the manifest block against the rows; one aggregation."""
    state = state_of(manifest, contract.name)
    if state == "invalid":
        return [("invalid_enabled_block", contract.name)]
    if state != "enabled":
        return []
    block = manifest[contract.name]
    df = _complete(rows.where(contract.rows), contract.fields)
    digest = next((c for c in contract.fields if c.endswith("digest")), None)
    got = df.where(F.col(contract.marker).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), (F.sort_array(F.collect_set(digest)) if digest else F.array().cast("array<string>")).alias("digests")
    ).first()
    out = []
    if block.get("count") != got["n"]:
        out.append(("manifest_count_mismatch", f"{block.get('count')} stated, {got['n']} decorated"))
    if got["digests"] and got["digests"] != [block.get("compile_commands_digest")]:
        out.append(("digest_mismatch", ",".join(got["digests"])))
    return out


def liveness_anomalies(entities: DataFrame) -> DataFrame:
    """Faults of the five preprocessor columns: (graph_name, id, code)."""
    dep, why, branches = F.col("preprocessor_dependent"), F.col("preprocessor_reasons"), F.col("preprocessor_branches")
    present = [dep.isNotNull(), why.isNotNull(), F.col("preprocessor_eval_mode").isNotNull(), F.col("preprocessor_macro_seed_digest").isNotNull(), branches.isNotNull()]
    some, every = F.greatest(*[p.cast("int") for p in present]), F.least(*[p.cast("int") for p in present])
    tests = {
        "partial_liveness_payload": (some == 1) & (every == 0),
        "dependent_reasons_mismatch": dep.isNotNull() & why.isNotNull() & (dep != (F.size(why) > 0)),
        "branch_contract": F.exists(branches, lambda b: (b["start_line"] > b["end_line"]) | b["kind"].isNull() | ~b["liveness"].isin("live", "dead", "unknown")),
        "reason_contract": F.exists(why, lambda r: F.trim(r) == ""),
        "digest_mismatch": F.col("preprocessor_macro_seed_digest").isNotNull() & ~F.col("preprocessor_macro_seed_digest").rlike("^(sha256:)?[0-9a-f]{12,64}$"),
    }
    codes = F.array_compact(F.array(*[F.when(t, F.lit(c)) for c, t in tests.items()]))
    return entities.select(BY, "id", F.explode(codes).alias("code")).distinct()


def coherence_anomalies(manifest: dict) -> list[tuple[str, str]]:
    """Enabled overlays against the first enabled one: digest, entry count, compilers, translation units."""
    blocks = [(n, manifest[n]) for n in sorted(manifest) if n in CONTRACTS and state_of(manifest, n) == "enabled"]
    out = []
    for name, block in blocks[1:]:
        first = blocks[0][1]
        for key, code in (("compile_commands_digest", "digest_mismatch"), ("compile_entry_count", "compile_entry_count_mismatch"), ("compilers", "compiler_census_mismatch"), ("translation_units", "translation_unit_census_mismatch")):
            if first.get(key) != block.get(key):
                out.append((code, f"{blocks[0][0]} / {name}"))
    return out


def edge_id_anomalies(edges: DataFrame, kind: str) -> DataFrame:
    """Edges of a kind whose id does not follow from their ends: (graph_name, id, expected)."""
    expected = F.concat(F.lit(f"rel:{kind}:"), short_digest(F.lit(kind), F.col("source"), F.col("target")))
    return edges.where(F.col("type") == kind).select(BY, "id", expected.alias("expected")).where("id <> expected")


def doctor(tables: dict[str, DataFrame], manifest: dict, sample: int = 50) -> list[dict]:
    """All contracts of a snapshot in order: state, exact number of anomalies, a bounded sample.

    A broken envelope ends the examination: what it describes cannot be trusted.
    """
    needed = [n for n in ("entities", "relationships", "text_units") if n not in tables]
    if needed:
        return [{"component": "envelope", "state": "invalid", "n_anomalies": len(needed), "sample": [f"missing_required_file {n}" for n in needed]}]
    out = []
    for name, c in CONTRACTS.items():
        state = state_of(manifest, name)
        rows = row_anomalies(c, tables[c.carrier], tables["entities"], state)
        found = rows.groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per code
        extra = manifest_anomalies(c, tables[c.carrier], manifest)
        listed = [f"{r['code']} {r['id']}" for r in rows.orderBy("code", "id").limit(sample).collect()] + [" ".join(e) for e in extra]
        out.append({"component": name, "state": state, "n_anomalies": sum(r["n"] for r in found) + len(extra), "sample": listed[:sample]})
    extra = coherence_anomalies(manifest)
    out.append({"component": "coherence", "state": "checked", "n_anomalies": len(extra), "sample": [" ".join(e) for e in extra]})
    return out


def schema_problems(df: DataFrame, schema: str) -> list[str]:
    """Columns of a fixed schema that are missing or of another type."""
    have = dict(df.dtypes)
    return [f.name for f in T._parse_datatype_string(schema).fields if have.get(f.name) != f.dataType.simpleString()]

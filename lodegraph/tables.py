"""Schemas of the graph tables and the readers for a directory of Parquet tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BRANCH = "struct<kind:string,condition:string,start_line:bigint,end_line:bigint,liveness:string,basis:string>"

ENTITIES = (
    "id string, title string, type string, description string, snippet string, text_unit_ids array<string>, "
    "human_readable_id bigint, source_file string, span string, extractor string, confidence double, "
    "is_deterministic boolean, document_ids array<string>, covariate_ids array<string>, symbol_name string, "
    "dynamic_dependent boolean, dynamic_reasons array<string>, preprocessor_dependent boolean, "
    "preprocessor_reasons array<string>, preprocessor_eval_mode string, preprocessor_macro_seed_digest string, "
    f"preprocessor_branches array<{BRANCH}>"
)
RELATIONSHIPS = (
    "id string, source string, target string, type string, description string, weight double, "
    "text_unit_ids array<string>, human_readable_id bigint, source_file string, span string, extractor string, "
    "confidence double, is_deterministic boolean, document_ids array<string>, covariate_ids array<string>, "
    "fact_kind string, resolved_target_hint string, dynamic_dependent boolean"
)
TEXT_UNITS = (
    "id string, human_readable_id bigint, text string, n_tokens bigint, document_id string, "
    "document_ids array<string>, entity_id string, entity_ids array<string>, relationship_ids array<string>, "
    "covariate_ids array<string>, source_file string, span string, extractor string, confidence double, "
    "is_deterministic boolean"
)
CALL_OBSERVATIONS = (
    "source string, display_target string, confidence double, reason string, source_file string, span string, "
    "extractor string, description string"
)
SCHEMAS = {
    "entities": ENTITIES,
    "relationships": RELATIONSHIPS,
    "text_units": TEXT_UNITS,
    "call_observations": CALL_OBSERVATIONS,
}


@dataclass(frozen=True)
class GraphTables:
    """One graph, or many graphs side by side, as four DataFrames."""

    entities: DataFrame
    relationships: DataFrame
    text_units: DataFrame
    call_observations: DataFrame

    def named(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in SCHEMAS}


def load(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], T._parse_datatype_string(SCHEMAS[name]))


def once(df: DataFrame, keys: list[str], latest: str = "ingested_at") -> DataFrame:
    """Repeated deliveries of a row count once; of rows that differ the one delivered last is kept.

    ``max_by`` combines map-side, so a key that a third of the rows share costs one row per map task.
    """
    value = F.struct(*[c for c in df.columns if c not in keys])
    order = F.col(latest) if latest in df.columns else F.lit(0)
    kept = df.groupBy(*keys).agg(F.max_by(value, F.struct(order, F.xxhash64(value))).alias("_row"))
    return kept.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])

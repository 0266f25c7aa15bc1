"""The pN_ queries of the language-model problems, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodegraph.llm import abuse as ab
from lodegraph.llm import chunk_encoding as ce
from lodegraph.llm import packing as pk
from lodegraph.llm import syntax as sx
from lodegraph.session import cut_lineage
from lodegraph.tables import load

PACK_NAME = "context_default"


def p4_found(spark, d):
    return sx.invalid_files(load(spark, d, "entities"), load(spark, d, "source_files"))


def p4_verdicts(spark, d):
    return sx.listed_verdicts(load(spark, d, "entities"), load(spark, d, "source_files"))


def p4_rates(spark, d):
    return sx.syntax_rates(p4_verdicts(spark, d))


def p6_ids(spark, d):
    return ce.encode_corpus(load(spark, d, "documents"))


def p6_sources(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "source").distinct()
    counted = ce.token_counts(load(spark, d, "documents"))
    return counted.join(docs, "doc_id").groupBy("source").agg(
        F.count(F.lit(1)).alias("n_documents"), F.sum("n_tokens").alias("n_tokens"), F.max("n_tokens").alias("longest")
    )


def _capacities(spark, d):
    rows = load(spark, d, "pack_sizes").where("capacity_tokens > 0").distinct().collect()  # a fixed table of three rows
    return {r["pack_name"]: int(r["capacity_tokens"]) for r in rows}


def p7_packs(spark, d):
    counts = cut_lineage(ce.token_counts(load(spark, d, "documents")))
    return pk.pack_documents(counts, _capacities(spark, d)[PACK_NAME], PACK_NAME)


def p7_fill(spark, d):
    counts = cut_lineage(ce.token_counts(load(spark, d, "documents")))
    parts = [pk.fill_report(pk.pack_documents(counts, c, name)) for name, c in sorted(_capacities(spark, d).items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def p8_scores(spark, d):
    docs = load(spark, d, "documents")
    scored = ab.abuse_scores(docs, ab.fit_model(docs, load(spark, d, "labels")))
    return scored.groupBy("doc_id").agg(F.max("score").alias("score"), F.max("flagged").alias("flagged"))


def p8_found(spark, d):
    docs = load(spark, d, "documents")
    scored = ab.abuse_scores(docs, ab.fit_model(docs, load(spark, d, "labels")))
    return scored.where("flagged").select("doc_id").distinct()


def p8_rates(spark, d):
    docs = load(spark, d, "documents")
    return ab.source_rates(docs, ab.abuse_scores(docs, ab.fit_model(docs, load(spark, d, "labels"))))


QUERIES = {f.__name__: f for f in (p4_found, p4_verdicts, p4_rates, p6_ids, p6_sources, p7_packs, p7_fill, p8_found, p8_scores, p8_rates)}
SQL: dict[str, str] = {}

"""Registered queries of the text operators, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import written
from . import (chat, decontaminate, jaccard, language, mixing, oracle, packing, privacy, quality, runs, secrets, suffixes,
               urls, vafile)
from .exprs import let, words

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = dict(oracle.ORACLE)
#: Of the registered query only: users pass a key of their own.
PSEUDONYM_KEY = "a key for the registered query"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op7_secret_scan(spark, sf_dir):
    """Secrets of every document: counts of the base kinds, their digest, all spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    s, base = F.col("secret_spans"), [r.kind for r in secrets.BASE_RULES]

    def count(kind):
        return F.size(F.filter(s, lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(k) for k in base]
    return secrets.scan_secrets(docs).select("doc_id", *counts, F.sha2(secrets.joined(s, base), 256).alias("base_sha256"),
                                             secrets.joined(s).alias("spans"))


@query
def op9_url_filter(spark, sf_dir):
    """Verdict on every page's address."""
    return urls.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select(
        "page_id", "host", "path", "rule", "verdict")


@query
def op10_quality_rules(spark, sf_dir):
    """Counts, base rules and robust outliers of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality.quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                              "n_repeat_words", "base_failed", "kept", "distance")


@query
def op6_language_id(spark, sf_dir):
    """Language of every document by a model of labelled documents outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(~language.held_out(F.col("doc_id"))).select("lang", "text"))
    return language.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


@query
def op5_benchmark_leaks(spark, sf_dir):
    """Each benchmark item that a document holds with at most a twentieth of its characters edited."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.find_items(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")


@query
def op4_jaccard_join(spark, sf_dir):
    """Groups of documents linked by a Jaccard similarity of 0.8 of their 5-word shingles."""
    return jaccard.join_similar(table(spark, sf_dir, "documents"))


@query
def op1_best_fit_packing(spark, sf_dir):
    """Place of every piece of every document in training sequences."""
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)


@query
def op3_suffix_dedup(spark, sf_dir):
    """Every document without the 50-byte strings that an earlier one has, as a digest."""
    return suffixes.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


@query
def op8_private_data(spark, sf_dir):
    """Every document with pseudonyms in place of personal data."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return privacy.pseudonymize(docs, PSEUDONYM_KEY)


@query
def op2_chat_turns(spark, sf_dir):
    """Turns of all conversations, parsed from transcripts in which speakers are named only in part."""
    rows = chat.as_transcripts(table(spark, sf_dir, "conversations"))
    model = chat.fit(rows.where(~language.held_out(F.col("conv_id"))))
    return chat.parse(rows.select("conv_id", "turn", "text"), model)


@query
def op11_centroids(spark, sf_dir):
    """Cluster of every vector after five rounds from 40 hashed starts, in whole numbers."""
    return vafile.centroid_clusters(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """Documents of which a tenth, by a hash of the id, end in a repeated stretch of their own words."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("bigint")

    def repeated(w):
        n = F.size(w).cast("bigint")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("bigint")
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.array_join(F.transform(w, lambda _, i: F.get(w, place(i.cast("bigint")).cast("int"))), " ")

    tail = let(words(F.col("text")), lambda w: F.when(F.size(w) > 0, repeated(w)))
    return docs.withColumn("text", F.when(h % 10 == 0, tail).otherwise(F.col("text")))


@query
def op12_periodic_runs(spark, sf_dir):
    """Runs of words of four or more periods in every document, and the words that they leave."""
    docs = with_periodic_tails(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = runs.periodic_runs(docs)
    r = F.col("runs")
    # Exact order of length / period: cross products stay far below 2**63.
    best = F.aggregate(r, F.lit(None).cast(r_type := "struct<start:bigint,length:bigint,period:bigint>"), lambda s, x: F.when(
        s.isNull() | (x["length"] * s["period"] > s["length"] * x["period"]), x).otherwise(s).cast(r_type))
    lines = F.transform(r, lambda x: F.concat_ws(",", *[x[c].cast("string") for c in ("start", "length", "period")]))
    told = F.concat(F.array_join(lines, "\n"), F.when(F.size(r) > 0, "\n").otherwise(""))
    return found.select("doc_id", F.size(r).cast("bigint").alias("n_runs"), best.alias("b"),
                        F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "b.start", "b.length", "b.period",
        F.expr("(1000 * b.length) div b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


@query
def op13_source_mix(spark, sf_dir):
    """Words taken of every document in a mix of all sources, weighted 5, 2, 1 in turn."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("n_words"))
    return mixing.mix(written(docs, "sizes"), size="n_words").select("doc_id", "size", "source_size", "target", "taken")

"""The corpus pipeline against plain Python, stage by stage."""

import zlib

from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from cohortlens.llm import language
from cohortlens.llm.decontaminate import normal
from cohortlens.llm.queries import ORACLE, QUERIES

from .test_text_operators import BASE, WORD, brute_join

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = [stage for _, stage in corpus_pipeline.STAGES]
    known = kept[0](spark, docs, SF).cache()
    assert known.columns == columns and known.count() == docs.count()
    first = kept[1](spark, known, SF).cache()
    group = brute_join([(r.doc_id, r.text) for r in known.collect()])
    assert first.columns == columns and {r.doc_id for r in first.collect()} == {d for d, c in group.items() if d == c}
    clear = kept[2](spark, first, SF).cache()
    items = [normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    # Items are planted unchanged; edits are tested with the operator.
    held = {r.doc_id for r in first.collect() if any(i in normal(r.text) for i in items)}
    assert clear.columns == columns and {r.doc_id for r in clear.collect()} == {r.doc_id for r in first.collect()} - held
    masked = kept[3](spark, clear, SF).cache()
    assert masked.columns == columns and masked.count() == clear.count()
    before = {r.doc_id: r.text for r in clear.collect()}
    for r in masked.collect():
        plain = any(len(m[g]) >= n for _, p, g, n in BASE for m in p.finditer(before[r.doc_id]))
        assert (r.text != before[r.doc_id]) == plain and r.n_chars == len(r.text)
        assert not any(len(m[g]) >= n for _, p, g, n in BASE for m in p.finditer(r.text))
    packed = kept[4](spark, masked, SF).collect()
    texts = {}
    for r in sorted(packed, key=lambda r: r.piece):
        texts[r.doc_id] = texts.get(r.doc_id, "") + r.text
    assert texts == {r.doc_id: r.text for r in masked.collect()}
    assert sum(r.n_tokens for r in packed) == sum(len(WORD.findall(t)) for t in texts.values())


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SF).columns[-1] == "bin_length"
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_entry_has_all_queries():
    names = set(contract.queries())
    assert {"pipeline", *QUERIES} <= names and len(QUERIES) == 10 and set(ORACLE) <= set(QUERIES) <= names


def test_held_out_is_a_checksum(spark):
    rows = spark.range(50).select("id", language.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)

"""Corpus pipeline: the documents table through the training-data operators, stage by stage.

Each stage works on all that its predecessor kept and is written as Parquet
before the next one reads it. Documents in no known language go, lines that
many sources carry go, one document of each group of near duplicates stays,
documents with a benchmark passage go, and the rest is packed into training
sequences. Nulls, empty texts, repeated rows, empty tables and columns of any
name are handled as the operators' docstrings say. A stage has no SQL twin: language ID is a fitted model and best-fit
packing is a procedure.
"""

from __future__ import annotations

from streakline.llm import langid, line_dedup, ngram_jaccard, packing, winnowing
from streakline.llm.shared import Scratch


def language(spark, docs, sf_dir):
    return langid.in_known_language(docs)


def lines(spark, docs, sf_dir):
    return line_dedup.remove_boilerplate(docs).select(*[f"`{c}`" for c in docs.columns])


def near_duplicates(spark, docs, sf_dir):
    return ngram_jaccard.near_duplicates_out(docs)


def decontamination(spark, docs, sf_dir):
    return winnowing.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark, docs, sf_dir):
    return packing.sequences(packing.pack_documents(docs))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates),
          ("decontamination", decontamination), ("packing", packed)]
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"{i}-{name}")
    return docs

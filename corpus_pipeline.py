"""The corpus pipeline: from documents to mixed, tokenised training rows.

Each stage works on all that the one before kept; run() writes each stage's rows below the
shared folder and reads them again, so that a lost executor costs a stage at most.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from binweave.llm import bpe, host_rules, mixing, prefix_join, suffix_dedup
from binweave.llm.common import documents, materialise


def quality_rules(spark, docs, sf_dir):
    """Documents that the rules or the host's verdict reject go."""
    return host_rules.judge(docs).where("__rules.kept").select(*docs.columns)


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of near copies stays."""
    return prefix_join.keep_one(docs)


def repeated_passages(spark, docs, sf_dir):
    """Passages of 200 bytes or more that repeat are cut out of the texts."""
    return suffix_dedup.dedup(docs)


def mix_sources(spark, docs, sf_dir):
    """Sources are brought to their target weights; a document comes once for each epoch."""
    return mixing.copies(mixing.mix(docs)).select(*docs.columns)


def tokenise(spark, docs, sf_dir):
    """Token ids of each row's text."""
    ids = bpe.encode(docs.select("doc_id", "source", "lang", "text"), offsets=None)
    return ids.select("doc_id", "source", "lang", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE", tokenise),
]

#: The near-duplicate and suffix stages have no SQL of reasonable cost; the pipeline is
#: tested against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)

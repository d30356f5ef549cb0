"""Corpus pipeline: language ID, near-dedup, decontamination, secret masking, packing.

Every stage works on all rows that the stage before it kept, written as
Parquet and read again. Stages 1 and 2 drop documents, 3 and 4 change the
texts of hit documents only, the last returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers

from sparkvane.llm import decontaminate, langid, packing, secrets, similar
from sparkvane.llm.common import durable, read


def language_id(spark, docs, sf_dir):
    """Documents in no known language go; the others get theirs where `lang` is null."""
    return langid.keep_known(docs, langid.trained_filter(docs))


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near copies stays, that of the smallest id: SimHash
    over five-word shingles, BK-trees, a similarity of at least 0.8."""
    return similar.keep_one(docs)


def decontamination(spark, docs, sf_dir):
    """Words of benchmark windows are cut out."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def secret_scan(spark, docs, sf_dir):
    """Secrets are masked."""
    return secrets.mask_secrets(docs, secrets.fresh_ledger(spark))


def best_fit_packing(spark, docs, sf_dir):
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: The stages need tokenizers, 64-bit hashes and trained filters, which SQL can't
#: express; tests hold the pipeline against a brute-force version instead.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

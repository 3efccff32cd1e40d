"""A training-data pipeline over ``documents``: language filter, near-copy removal,
secret masking, source mixing and packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``. All stages but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from washframe.llm import blob_ledger, byte_gru, mixing, pow2_pack, set_join
from washframe.llm.common import documents, store, without_ids

REJECTED_SHARE = 0.002   # share of a language's learning documents that its least score rejects


def language(spark, docs, sf_dir):
    """Keep the documents that the byte network gives a language as surely as it gives
    nearly all learning documents of that language."""
    learn = docs.where(~byte_gru.held_out())
    model = byte_gru.fit(learn)
    names = byte_gru.result_names(docs)   # the table may have columns of these names
    found, score = F.col(names["lang_pred"]), F.col(names["score"])
    sure = found != "und"
    for lang, least in sorted(byte_gru.least_scores(learn, model, REJECTED_SHARE).items()):
        sure &= (found != lang) | (score >= least)
    return byte_gru.predict(docs, model).where(sure).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_copies(spark, docs, sf_dir):
    """Of every group of documents linked by 5-word Jaccard >= 0.8, the least
    doc_id stays; wordless documents, those without an id and rows that repeat the
    staying doc_id stay too."""
    groups = set_join.JaccardJoin(docs, 4, 5, 5).components()
    gone = store(groups.where("doc_id <> component_id").select("doc_id").distinct(), "near-copies")
    return without_ids(docs, gone, ["doc_id"])


def secrets(spark, docs, sf_dir):
    """Mask every secret; no document goes."""
    return blob_ledger.redacted(spark, docs)


def mix(spark, docs, sf_dir):
    """Repeat and sample documents to the sources' target weights."""
    return mixing.Mixture(docs).mixed()


def pack(spark, docs, sf_dir):
    """Power-of-two pieces of the mixed documents."""
    import public_tokenizers
    return pow2_pack.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("near_copies", near_copies), ("secrets", secrets), ("mix", mix), ("pack", pack)]

# The first stage is a trained network, which SQL cannot express.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages, applied to the documents table."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

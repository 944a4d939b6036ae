"""The corpus pipeline: toxicity, near duplicates, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on every row of ``docs`` and returns a DataFrame; all but the last return
the columns of ``docs``, whatever their names. ``run`` writes each stage's rows to the shared folder and reads them again
for the next. Empty tables give empty ones in every stage. Null texts pass all stages but the last, where they are empty;
null ids are never near duplicates, and after all others for passages. Repeated rows are rows of their own, except that
near duplicates keep the smallest id's rows of a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.llm.common import drop_shared, read_table, write_shared
from lociflow.llm.op1_jaccard import BROADCAST_IDS, jaccard_links
from lociflow.llm.op3_suffix_dedup import remove_repeats
from lociflow.llm.op6_packing import pack_pieces, token_pieces
from lociflow.llm.op7_toxicity import THRESHOLD, fit_toxicity, with_toxicity
from lociflow.llm.op10_secrets import with_redacted

__all__ = ["ORACLE_SQL", "STAGES", "run"]

#: Tokenisers and learned scores can't be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have, in any case of its letters."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _with_text(docs: DataFrame, columns: list[str], text) -> DataFrame:
    """``docs`` with another text, and ``n_chars`` of it where there is such a column."""
    new = {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in columns else {})
    return docs.select(*[new[c].alias(c) if c in new else docs[c] for c in columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold go; the model is fitted on the labels of this stage's own documents."""
    model = fit_toxicity(docs, read_table(spark, sf_dir, "labels"))
    score = _free(docs, "toxicity")
    return with_toxicity(docs, model, name=score).filter(F.col(score) < THRESHOLD).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays; equal rows of that id all do."""
    id_, hash_ = _free(docs, "gone_id"), _free(docs, "gone_hash")
    gone = jaccard_links(docs).filter("not kept").select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)).distinct()
    gone = write_shared(gone, "gone")
    marked = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(marked, (docs["doc_id"] == gone[id_]) & (F.xxhash64(docs["text"]) == gone[hash_]), "left_anti")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has too are cut out; halves of characters at the cuts go as well."""
    found = remove_repeats(docs, as_text=True)
    kept = _free(docs, "kept")
    return _with_text(found.select("rest.*", F.col("kept").alias(kept)), docs.columns, F.col(kept))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each secret becomes a mark; documents without one are as they were."""
    redacted = _free(docs, "redacted")
    return _with_text(with_redacted(docs, name=redacted), docs.columns, F.col(redacted))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in sequences of at most 4096 tokens."""
    import public_tokenizers

    return pack_pieces(token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("secrets", secrets), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's table goes when the next one is written."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = write_shared(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            drop_shared(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

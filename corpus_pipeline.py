"""A training corpus from `documents`: five stages, each reading what the one before wrote.

1. `quality`: documents that the co-trained quality classifier rejects go. Labels are
   those of the table `labels`.
2. `line_dedup`: runs of three lines, and shorter ones of over 50 words, that occurred
   before are cut from the texts. Documents of which no word is left go; those that came
   in without words stay.
3. `near_dedup`: of each group of near-duplicates the one with the smallest id stays.
   Rows that repeat this id count as one. Texts without words are near nothing and stay.
4. `decontaminate`: documents of which the table `benchmark` covers a twentieth go.
5. `packing`: what is left is packed into sequences of 4096 tokens; a row per piece.

Stages 1 to 4 return the columns of documents, extra ones included; where a text was cut,
`n_chars` is its new length. Nulls, empty texts and empty tables are what the operators'
docstrings say; null texts stay null unless a stage drops the row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from closebook.llm import decontaminate, linededup, minhash, packing, quality
from closebook.llm.common import free_name, table, whole, written


def _aside(docs: DataFrame, taken: set[str]) -> tuple[DataFrame, list]:
    """`docs` with other names for columns that an operator would replace, and the way back."""
    out, back = docs, []
    for c in docs.columns:
        other = c if c.lower() not in taken else free_name(out, f"_{c}")
        out = out if other == c else out.withColumnRenamed(c, other)
        back.append(F.col(f"`{other}`").alias(c))
    return out, back


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    rows, back = _aside(docs, quality.NEW)
    return quality.score_quality(rows, model).where("accepted").select(*back)


def _wordless(text):
    return ~F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, emptied: bool = True) -> DataFrame:
    """Every row with its text cut; without `emptied`, not those that lost all their words."""
    came = free_name(docs, "came_wordless")
    rows, back = _aside(docs.withColumn(came, _wordless("text")), linededup.NEW)
    back = back[:-1]
    cut = linededup.delete_repeated_runs(rows, words=linededup.WORDS)
    length = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    if not emptied:
        cut = cut.where(F.col(came) | ~_wordless("text"))
    return cut.withColumn("n_chars", length).select(*back)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_stage(spark, docs, sf_dir, emptied=False)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(docs)
    # Of each component the smallest id; rows without words all stay.
    texts = found.where("n_shingles > 0").groupBy("component", "doc_id", "text_key").agg(F.count("*").alias("copies"))
    best = texts.groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key", "copies")).alias("best"))
    key, copies = free_name(docs, "text_key"), free_name(docs, "copies")
    keep = best.select(
        F.col("best.doc_id").alias("kept_id"), F.col("best.text_key").alias("kept_key"), F.col("best.copies").alias(copies))
    keyed = docs.withColumn(key, F.sha2(whole(), 256))
    chosen = keyed.join(keep, F.col(key).eqNullSafe(F.col("kept_key")) & F.col("doc_id").eqNullSafe(F.col("kept_id")))
    # A chosen row that stands in the table several times is one document.
    once = chosen.where(F.col(copies) == 1).select(*docs.columns)
    several = chosen.where(F.col(copies) > 1).dropDuplicates([key, "doc_id"]).select(*docs.columns)
    wordless = docs.where(_wordless("text"))
    return once.unionByName(several).unionByName(wordless)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, back = _aside(docs, decontaminate.NEW)
    found = decontaminate.find_contamination(rows, table(spark, sf_dir, "benchmark"))
    return found.where("NOT contaminated").select(*back)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_stage),
    ("decontaminate", decontaminate_stage),
    ("packing", packing_stage),
]

#: Trained and tokenized stages have no SQL twin; tests hold the others against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; every stage but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = written(docs, name)
    return docs

"""A training corpus in five stages: toxicity, near duplicates, decontamination, secrets, token pieces.

Each stage takes what its predecessor kept (written as Parquet and read again) and lets its decisions take effect: toxic
documents go; of each group of near copies (five-word shingles, Jaccard similarity 0.8 or more, linked in any chain) the
row with the smallest id stays (a null id sorts first; of rows with that id, one), whatever other rows share its id;
documents that hold a benchmark item go; secrets are replaced by ``[SECRET]`` and ``n_chars`` follows; the last stage returns the encoded documents. Documents with null text stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.llm.common import cut, spent, table
from chronotext.llm.decontamination import drop_leaking
from chronotext.llm.jaccard import jaccard_components
from chronotext.llm.pieces import encode_documents
from chronotext.llm.secrets import redact, scan_secrets
from chronotext.llm.toxicity import fit_toxicity, score_column

PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return docs.where(score_column(model, F.col("text")) < 0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are known by a number of their own, as ids may be null or repeat; its column has a name that the documents have not."""
    no = "row_no"
    while no in docs.columns:
        no += "_"
    rows = cut(docs.withColumn(no, F.monotonically_increasing_id()))
    groups = jaccard_components(rows, n_words=5, p=80, q=100, id_col=no).select(F.col("doc_id").alias(no), "component_id")
    groups = cut(groups.join(rows.select(no, "doc_id"), no))
    first = groups.groupBy("component_id").agg(F.min(F.struct("doc_id", no)).alias("least")).select(f"least.{no}")
    others = cut(groups.select(no).join(first, no, "left_anti"))
    spent(groups)
    return rows.join(others, no, "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = redact(docs, scan_secrets(docs, owner_col="source", repo_cols=["source", "lang"]))
    return clean.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), "n_chars")).select(docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = encode_documents(docs, PIECES, dropout=0.1, seed=1)
    return encoded.withColumn("n_pieces", (F.octet_length("ids") / 2).cast("long"))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("encoding", encoding),
]
#: SQL can express neither the classifier nor the merge agenda; tests hold the stages against plain forms.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

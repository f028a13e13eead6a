"""Training-data pipeline: quality rules, line dedup, near duplicates, decontamination, pieces.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's documents. All but the
last return the columns of documents.
"""

import uuid

from tabia.llm.chosen_path import one_of_each
from tabia.llm.common import shared_folder, table
from tabia.llm.importance_rules import quality_filtered
from tabia.llm.latent_retrieval import decontaminated
from tabia.llm.line_runs import with_lines_removed
from tabia.llm.nbest_pieces import encode

#: Characters cut into pieces together: few, as the executors still hold what the stages before took.
PIECES_CHARS = 2 << 20


def quality_rules(spark, docs, sf_dir):
    """Documents that the rules reject go."""
    return quality_filtered(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark, docs, sf_dir):
    """Lines that an earlier document holds go; the documents stay."""
    return with_lines_removed(docs)


def near_duplicates(spark, docs, sf_dir):
    """The first document of each group of near duplicates stays."""
    return one_of_each(docs)


def decontamination(spark, docs, sf_dir):
    """Documents that hold a benchmark item go."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark, docs, sf_dir):
    """Every document as vocabulary pieces: doc_id, ids, scores, exact."""
    return encode(docs, slice_chars=PIECES_CHARS)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pieces", pieces),
]

#: The hashes and models of the stages have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

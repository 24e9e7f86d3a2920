"""Constraint checks and cascades (Q1, Q2)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegrid.functions.fixed import CLAUSE_REF_LIMIT


def violations(chunks: DataFrame, documents: DataFrame, clause_ref_limit: int = CLAUSE_REF_LIMIT) -> DataFrame:
    """Q1: (document_id, chunk_id, problem) for every broken constraint."""
    def broken(problem: str, where: Column) -> Column:
        return F.when(where, F.lit(problem))

    found = F.array_compact(F.array(
        broken("text is null", F.col("text").isNull()),
        broken("clause_ref too long", F.length("clause_ref") > clause_ref_limit),
    ))
    own = chunks.select("document_id", "chunk_id", F.explode(found).alias("problem"))
    orphans = chunks.join(documents.select("document_id"), "document_id", "left_anti").select(
        "document_id", "chunk_id", F.lit("no such document").alias("problem")
    )
    untitled = documents.filter("title is null").select(
        "document_id", F.lit(None).cast(chunks.schema["chunk_id"].dataType).alias("chunk_id"), F.lit("title is null").alias("problem")
    )
    return own.unionByName(orphans).unionByName(untitled)


def split_documents(documents: DataFrame, broken: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Q1: one violation rejects the whole document: (accepted, rejected with first problem)."""
    first = broken.groupBy("document_id").agg(F.count("*").alias("n_problems"), F.min("problem").alias("reason"))
    accepted = documents.join(first, "document_id", "left_anti")
    return accepted, documents.join(first, "document_id")


def rating_violations(feedback: DataFrame) -> DataFrame:
    """Q1: feedback whose rating is outside 1..5 (null is allowed)."""
    return feedback.filter(~F.col("rating").between(1, 5))


def cascade(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Q2: children left after their parents in ``deleted`` are gone."""
    return children.join(deleted.select(key).distinct(), key, "left_anti")

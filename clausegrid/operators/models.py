"""Scorers and judges as Arrow batch functions (U1), for reranking (R8), judging retrieved pairs
(P10), conflict candidates (G18) and prompts (L1).

A model takes Arrow arrays of equal length, one per input column, and returns one array. It is
called with slices of bounded size inside tasks, so it can pass a whole batch to a library at
once; nothing is shuffled for it. A scorer that an expression can state stays an expression.
"""

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from clausegrid.functions.sizes import small_side
from clausegrid.operators.graph import edge
from clausegrid.operators.questions import conflict_rows
from clausegrid.operators.replies import said_yes

BATCH_ROWS = 1024


class Model(NamedTuple):
    """``answer(*arrays) -> array``; ``kind`` is the Spark type of the answers. ``load`` runs
    once per task and its result comes first among the arguments, for models that are costly
    to set up."""

    answer: Callable[..., pa.Array]
    kind: str = "double"
    batch_rows: int = BATCH_ROWS
    load: Callable[[], object] | None = None


#: Models by name; users add their own.
MODELS: dict[str, Model] = {}


def named(model: Model | str) -> Model:
    if isinstance(model, str):
        if model not in MODELS:
            raise ValueError(f"no model {model!r}; there are {sorted(MODELS)}")
        return MODELS[model]
    return model


def answered(rows: DataFrame, inputs: list[str], model: Model | str, name: str) -> DataFrame:
    """``rows`` with the model's answer to the ``inputs`` of each row as column ``name``.

    A batch that comes back with another length is an error. Nulls go in as nulls.
    """
    model, given = named(model), rows.drop(name)
    columns = given.columns
    at = [columns.index(c) for c in inputs]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = () if model.load is None else (model.load(),)
        for batch in batches:
            for start in range(0, batch.num_rows, model.batch_rows):
                part = batch.slice(start, model.batch_rows)
                answers = model.answer(*first, *[part.column(i) for i in at])
                if len(answers) != part.num_rows:
                    raise ValueError(f"{len(answers)} answers to {part.num_rows} rows")
                yield pa.RecordBatch.from_arrays([*part.columns, answers], names=[*columns, name])

    return given.mapInArrow(work, _schema(given, name, model.kind))


def _schema(rows: DataFrame, name: str, kind: str):
    added = rows.limit(0).select(F.lit(None).cast(kind).alias(name)).schema
    return StructType([*rows.schema.fields, *added.fields])


def pair_scores(candidates: DataFrame, questions: DataFrame, chunks: DataFrame, model: Model | str) -> DataFrame:
    """``(query_id, chunk_id, score)`` of the candidates, as ``rerank(scorer=...)`` takes them."""
    wanted = small_side(candidates.select("query_id", "chunk_id"), F.lit(100))
    pairs = chunks.select("chunk_id", "text").join(wanted, "chunk_id").join(
        questions.select("query_id", "question"), "query_id")
    return answered(pairs, ["question", "text"], model, "score").select("query_id", "chunk_id", "score")


def judged_pairs(pairs: DataFrame, model: Model | str) -> DataFrame:
    """P10: the pairs of ``questions.judge_pairs`` that the model says conflict."""
    yes = answered(pairs, ["text_a", "text_b"], model, "reply").filter(said_yes(F.col("reply")))
    return conflict_rows(yes.select("query_id", "clause_a", "clause_b"))


def judged_candidates(candidates: DataFrame, model: Model | str) -> DataFrame:
    """CONFLICTS_WITH edges of the candidates that the model says conflict."""
    yes = answered(candidates.select("clause_a", "clause_b", "text_a", "text_b"), ["text_a", "text_b"], model, "reply")
    return yes.filter(said_yes(F.col("reply"))).select(*edge("CONFLICTS_WITH", "Clause", "clause_a", "Clause", "clause_b")).distinct()


def replies_to(prompts: DataFrame, model: Model | str) -> DataFrame:
    """L1: a prompt table with the model's ``reply``, as the parsers of replies take it."""
    return answered(prompts, ["prompt"], model, "reply")

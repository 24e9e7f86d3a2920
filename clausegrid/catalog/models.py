"""Queries with scorers and judges as Arrow batch functions, one for each of their places."""

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from clausegrid.catalog.derived import CLAUSES
from clausegrid.catalog.graph import PAIRS, candidates, edge_sql
from clausegrid.catalog.questions import CONFLICT_CTES, hits
from clausegrid.catalog.registry import query, with_ctes
from clausegrid.catalog.retrieval import BM25, SECOND, fused, questions, stored_corpus
from clausegrid.operators import models as M
from clausegrid.operators import questions as P
from clausegrid.operators import replies as L
from clausegrid.operators import retrieval as R


def _length_ratio(question: pa.Array, text: pa.Array) -> pa.Array:
    a, b = (pc.cast(pc.utf8_length(x), pa.float64()) for x in (question, text))
    return pc.divide(pc.min_element_wise(a, b), pc.max_element_wise(a, b))


def _judge(divisor: int):
    def says(first: pa.Array, second: pa.Array) -> pa.Array:
        both = pc.add(pc.utf8_length(first), pc.utf8_length(second))
        yes = pc.equal(both, pc.multiply(pc.divide(both, divisor), divisor))
        return pc.if_else(yes, "Yes, they do.", "No.")

    return says


def _short_reply(prompt: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise("Length ", pc.cast(pc.utf8_length(prompt), pa.string()), pa.scalar(": yes"), "")


M.MODELS |= {
    "length ratio": M.Model(_length_ratio),
    "even lengths": M.Model(_judge(2), "string"),
    "lengths by three": M.Model(_judge(3), "string"),
    "prompt length": M.Model(_short_reply, "string"),
}


@query("rerank_by_batch_scorer", with_ctes(BM25, SECOND, """
pool as (select query_id, chunk_id, f.rank as was, round(least(length(question), length(text)) / greatest(length(question), length(text)), 9) as score
  from fused f join questions using (query_id) join chunks using (chunk_id))""", select="""
  select query_id, row_number() over (partition by query_id order by score desc, was) as rank, chunk_id, round(score, 6) as score from pool qualify rank <= 3"""))
def rerank_by_batch_scorer(spark, sf):
    chunks, asked = stored_corpus(spark, sf), questions(spark, sf)
    found = R.materialise(fused(asked, chunks))
    best = R.rerank(found, asked, chunks, scorer=M.pair_scores(found, asked, chunks, "length ratio"))
    return best.withColumn("score", F.round("score", 6))


@query("conflicts_judged_in_batches", with_ctes(*CONFLICT_CTES, select="""
  select query_id, cast(clause_a as varchar) as clause_a, cast(clause_b as varchar) as clause_b, '' as ref, 'model' as source
  from judge where (length(text_a) + length(text_b)) % 2 = 0"""))
def conflicts_judged_in_batches(spark, sf):
    return M.judged_pairs(P.judge_pairs(hits(spark, sf)), "even lengths")


@query("conflict_edges_judged_in_batches", with_ctes(CLAUSES.cte, PAIRS, select=edge_sql("CONFLICTS_WITH", "Clause", "clause_a", "Clause", "clause_b") + """
  from pairs where (length(text_a) + length(text_b)) % 3 = 0"""))
def conflict_edges_judged_in_batches(spark, sf):
    return M.judged_candidates(candidates(spark, sf), "lengths by three")


@query("replies_in_batches", with_ctes(CLAUSES.cte, PAIRS, select="""
  select clause_a, clause_b, 'Length ' || length('Do these two clauses contradict each other? Answer yes or no.' || chr(10) || chr(10)
    || 'FIRST: ' || left(text_a, 300) || chr(10) || 'SECOND: ' || left(text_b, 300)) || ': yes' as reply from pairs"""))
def replies_in_batches(spark, sf):
    return M.replies_to(L.conflict_prompts(candidates(spark, sf).drop("document_id", "gap")), "prompt length").drop("prompt")

"""The question pipeline as one batch job (survey T9, T10, S11).

questions -> intents -> (retrieval for the types that read it) -> evidence
-> context -> prompt messages. The four master tables are reused by several
branches, so they are checkpointed once into the session's checkpoint folder
(reliable storage: an executor loss re-reads them instead of recomputing the
fact aggregates).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storeline.operators import context, enrich, facts, intents, masters, retrieval, select
from storeline.plans import errors
from storeline.session import cut_lineage

RETRIEVAL_TYPES = ("location", "detail", "simple_fact")


def build_masters(tables, persist: bool = True) -> dict[str, DataFrame]:
    if persist:
        facts.share(tables)
    mo = masters.master_outlet(tables)
    mp = masters.master_product(tables)
    if persist:
        mo, mp = cut_lineage(mo, "master_outlet"), cut_lineage(mp, "master_product")
    eo = enrich.enrich_outlet(mo)
    ep = enrich.enrich_product(mp, mo)
    if persist:
        eo, ep = cut_lineage(eo, "enriched_outlet"), cut_lineage(ep, "enriched_product")
    return {"mo": mo, "mp": mp, "eo": eo, "ep": ep}


def answers(questions: DataFrame, m: dict[str, DataFrame], k: int = retrieval.DEFAULT_K,
            use_retrieval: bool = True, persist: bool = True, vectoriser=None) -> DataFrame:
    """(q_id, query_type, context, messages, error) for every question; a failed one has its error only.

    A context depends on the question's text alone, so every distinct text is worked on once, under its least q_id."""
    asked, failed = errors.quarantine(questions.select(F.col("q_id").cast("bigint").alias("q_id"), "question"))
    questions = asked.groupBy("question").agg(F.min("q_id").alias("q_id")).select("q_id", "question")
    if persist:
        questions = cut_lineage(questions, "texts")
    same = asked.join(questions.select("question", F.col("q_id").alias("first_id")), "question").select("q_id", "first_id")
    it = intents.parse(questions, m["eo"])
    if persist:
        it = cut_lineage(it, "intents")
    hits = None
    if use_retrieval:
        hits, unread = retrieved(questions, it, m, k, persist, vectoriser)
        failed = failed.unionByName(same.join(unread.withColumnRenamed("q_id", "first_id"), "first_id").select("q_id", "error"))
        it = it.join(unread, "q_id", "left_anti")
    ev, sel = select.evidence(it, m["eo"], m["ep"], hits)
    summaries = select.summary_records(sel)
    ctx = context.contexts(it, ev, m["eo"], m["ep"], m["mo"], m["mp"], summaries)
    out = (it.select("q_id", "query_type").join(ctx, "q_id")
           .join(questions.select("q_id", "question"), "q_id"))
    good = out.select("q_id", "query_type", "context", context.messages(F.col("question"), F.col("context")).alias("messages"),
                      F.lit(None).cast("string").alias("error"))
    good = same.join(good.withColumnRenamed("q_id", "first_id"), "first_id").drop("first_id")
    return good.unionByName(failed, allowMissingColumns=True)


def retrieved(questions: DataFrame, it: DataFrame, m: dict[str, DataFrame], k: int = retrieval.DEFAULT_K, persist: bool = True,
              vectoriser=None) -> tuple[DataFrame, DataFrame]:
    """(hits, failed): the documents of the questions that read them, and (q_id, error) of those that have no vector.

    Questions read documents by their type (``RETRIEVAL_TYPES``), or where their master table has no rows (S11)."""
    docs = retrieval.embed_text(retrieval.documents(m["mo"], m["mp"]), "text", vectoriser=vectoriser)
    if persist:
        docs = cut_lineage(docs, "documents")
    asked = questions.where(F.regexp_like(F.coalesce("question", F.lit("")), F.lit(r"[\p{L}\p{N}_]")))  # no word: nothing to look for
    reads = F.col("query_type").isin(*RETRIEVAL_TYPES)
    tbl = F.when((F.col("query_type") == "location") | (F.col("entity") == "outlet"), "outlet").otherwise("product")
    for name, master in (("outlet", m["eo"]), ("product", m["ep"])):
        if master.isEmpty():
            reads |= tbl == name
    vectors = retrieval.question_vectors(asked.join(it.where(reads).select("q_id"), "q_id"), vectoriser)
    reason = F.col("v_error") if "v_error" in vectors.columns else F.lit("question has no vector")
    if persist:
        vectors = cut_lineage(vectors, "question_vectors")
    failed = vectors.where(F.col("v").isNull()).select("q_id", errors.error_text(reason).alias("error"))
    hits = retrieval.hits_of(vectors, docs, k)
    return (cut_lineage(hits, "hits") if persist else hits), failed

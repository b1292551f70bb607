"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Each query builds its whole plan from the given parquet tables; nothing is
collected to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storeline.operators import enrich, facts, masters
from storeline.sources.fixtures import model_tables

Query = Callable[[SparkSession, str], DataFrame]


def _fact(fn) -> Query:
    return lambda spark, sf: fn(model_tables(spark, sf))


def master_outlet(spark: SparkSession, sf: str) -> DataFrame:
    return masters.master_outlet(model_tables(spark, sf))


def master_product(spark: SparkSession, sf: str) -> DataFrame:
    return masters.master_product(model_tables(spark, sf))


def enriched_product(spark: SparkSession, sf: str) -> DataFrame:
    t = model_tables(spark, sf)
    facts.share(t)
    # of the outlets only the customers are read
    return enrich.enrich_product(masters.master_product(t), masters.master_outlet(t, stored=False))


def enrich_outlet(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.enrich_outlet(master_outlet(spark, sf)).withColumn("rev_std", F.round("rev_std", 4))


def enrich_product(spark: SparkSession, sf: str) -> DataFrame:
    return enriched_product(spark, sf).withColumn("price_rating_corr", F.round("price_rating_corr", 6))


def top_performers(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship slice: top 5 outlets by performance_score."""
    eo = enrich_outlet(spark, sf)
    return enrich.top_performers(eo, 5, "outlet_id").select(
        "outlet_id", "outlet", "city", "total_revenue", "unique_customers", "outlet_score", "performance_score")


QUERIES: dict[str, Query] = {
    "sales_by_outlet": _fact(facts.sales_by_outlet),
    "daily_sales_by_outlet": _fact(facts.daily_sales_by_outlet),
    "employee_metrics": _fact(facts.employee_metrics),
    "promotion_by_outlet": _fact(facts.promotion_by_outlet),
    "transport_by_outlet": _fact(facts.transport_by_outlet),
    "reviews_by_outlet": _fact(facts.reviews_by_outlet),
    "quality_by_outlet": _fact(facts.quality_by_outlet),
    "sales_by_product": _fact(facts.sales_by_product),
    "outlets_by_product": _fact(facts.outlets_by_product),
    "reviews_by_product": _fact(facts.reviews_by_product),
    "quality_by_product": _fact(facts.quality_by_product),
    "transport_by_product": _fact(facts.transport_by_product),
    "master_outlet": master_outlet,
    "master_product": master_product,
    "enrich_outlet": enrich_outlet,
    "enrich_product": enrich_product,
    "top_performers": top_performers,
}

FLAGSHIP = "top_performers"


def intents_table(spark: SparkSession, sf: str) -> DataFrame:
    from storeline.operators import intents
    from storeline.sources.questions import questions
    from storeline.session import cut_lineage
    # the outlet master feeds two dictionaries: materialise it once instead of computing it twice
    eo = cut_lineage(enrich_outlet(spark, sf), "enriched_outlet")
    return intents.parse(questions(spark, sf), eo)


def intents_flat(spark: SparkSession, sf: str) -> DataFrame:
    from storeline.operators import intents
    return intents.flat(intents_table(spark, sf))


QUERIES["intents"] = intents_flat


def masters_pair(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    t = model_tables(spark, sf)
    facts.share(t)
    return masters.master_outlet(t), masters.master_product(t)


def documents_table(spark: SparkSession, sf: str) -> DataFrame:
    from storeline.operators import retrieval
    mo, mp = masters_pair(spark, sf)
    return retrieval.documents(mo, mp).select("id", "source", "pk", "text")


def embed_documents(spark: SparkSession, sf: str) -> DataFrame:
    from storeline.operators import retrieval
    mo, mp = masters_pair(spark, sf)
    return retrieval.embed_text(retrieval.documents(mo, mp), "text").select("id", "source", "pk", "embedding")


def retrieve_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Exact cosine top-5 of every vector of ``embeddings`` among all of them."""
    from storeline.operators import retrieval
    from storeline.sources.testdata import read_table
    e = read_table(spark, sf, "embeddings")
    return retrieval.cosine_topk(e.select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("v")),
                                 e.select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("v")),
                                 k=5).withColumn("score", F.round("score", 6))


def retrieve_approximate(spark: SparkSession, sf: str) -> DataFrame:
    """R3 / J8 by locality-sensitive buckets: approximate top-5 of every vector of ``embeddings`` among all of them."""
    from storeline.operators import approximate
    from storeline.sources.testdata import read_table
    e = read_table(spark, sf, "embeddings")
    return approximate.approximate_topk(e.select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("v")),
                                        e.select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("v")),
                                        k=5).withColumn("score", F.round("score", 6))


QUERIES["retrieve_approximate"] = retrieve_approximate
QUERIES["documents"] = documents_table
QUERIES["embed_documents"] = embed_documents
QUERIES["retrieve_topk"] = retrieve_topk


def answers_table(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: the whole question pipeline over the derived question table."""
    from storeline.plans import answers
    from storeline.sources.questions import questions
    m = answers.build_masters(model_tables(spark, sf))
    return answers.answers(questions(spark, sf), m)


QUERIES["answers"] = answers_table


def extract_answer(spark: SparkSession, sf: str) -> DataFrame:
    """C11 over assistant turns, wrapped in the response shapes a chat service returns."""
    from storeline.operators.responses import extract_answer as extract
    from storeline.sources.testdata import read_table
    c = read_table(spark, sf, "conversations").where(F.col("role") == "assistant")
    shape = F.pmod(F.col("turn"), F.lit(4))
    resp = (F.when(shape == 0, F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content"))
                                                                    .alias("message"))).alias("choices"))))
            .when(shape == 1, F.to_json(F.struct(F.col("text").alias("content"))))
            .when(shape == 2, F.to_json(F.struct(F.col("text").alias("text"))))
            .otherwise(F.col("text")))
    return c.select("conv_id", "turn", extract(resp).alias("answer"))


def chat_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered messages per conversation (flattened for checking)."""
    from storeline.operators.responses import chat_messages as msgs
    from storeline.sources.testdata import read_table
    m = msgs(read_table(spark, sf, "conversations"))
    return m.select("conv_id", F.size("messages").alias("n_messages"),
                    F.array_join(F.transform("messages", lambda x: x["role"]), ",").alias("roles"),
                    F.aggregate("messages", F.lit(0).cast("bigint"),
                                lambda acc, x: acc + F.length(x["content"])).alias("content_chars"),
                    F.sha2(F.array_join(F.transform("messages", lambda x: F.concat(x["role"], F.lit("\n"), x["content"], F.lit("\n"))), "")
                           .cast("binary"), 256).alias("messages_sha256"))


PROFILED = ["outlet", "menu", "outlet_menu", "order", "daily_sales", "review", "food_quality", "transportation",
            "promotion", "employment"]


def profile_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Column profile of the model tables."""
    from storeline.operators import profile
    p = profile.profile_tables(model_tables(spark, sf), PROFILED)
    return p.select("table", "column", "position", "rows", "n_missing", "pct_missing", "n_zeros", "pct_zeros",
                    F.array_join("examples", ", ").alias("examples"))


def best_outlet(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.best_outlet(enrich_outlet(spark, sf))


def best_product(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.best_product(enriched_product(spark, sf), "promo")


def availability_flags(spark: SparkSession, sf: str) -> DataFrame:
    mo = master_outlet(spark, sf)
    return masters.availability_flags(mo, masters.OUTLET_FLAG_COLUMNS).select(
        "outlet_id", *[f"{c}_available" for c in masters.OUTLET_FLAG_COLUMNS])


def availability_flags_product(spark: SparkSession, sf: str) -> DataFrame:
    return masters.availability_flags(master_product(spark, sf), masters.PRODUCT_FLAG_COLUMNS).select(
        "product_id", *[f"{c}_available" for c in masters.PRODUCT_FLAG_COLUMNS])


def minmax_normalize(spark: SparkSession, sf: str) -> DataFrame:
    mo = masters.master_outlet(model_tables(spark, sf), keep_components=True)
    return mo.select("outlet_id", *masters.OUTLET_WEIGHTS, "outlet_score")


def _evidence_of(spark: SparkSession, sf: str, without_products: bool = False) -> DataFrame:
    from storeline.operators import intents, select
    from storeline.plans import answers
    from storeline.session import cut_lineage
    from storeline.sources.questions import questions
    m = answers.build_masters(model_tables(spark, sf))
    if without_products:
        m |= {"mp": m["mp"].limit(0), "ep": m["ep"].limit(0)}
    qs = questions(spark, sf)
    it = cut_lineage(intents.parse(qs, m["eo"]), "intents")
    hits, _ = answers.retrieved(qs, it, m)
    ev, _ = select.evidence(it, m["eo"], m["ep"], hits)
    return select.with_raw(ev, m)


def evidence_table(spark: SparkSession, sf: str) -> DataFrame:
    """H0-H8: the evidence rows of every question, their score, and fields of the record behind each."""
    ev = _evidence_of(spark, sf)
    field = lambda *names: F.coalesce(*(F.col("raw")[n] for n in names))
    return ev.select("q_id", "pos", "kind", "tbl", "pk", F.round("score", 6).alias("score"), F.when(F.col("raw").isNotNull(), F.size("raw")).cast("long").alias("n_fields"),
                     field("outlet", "product_name").alias("name"), field("city", "category").alias("grp"),
                     field("total_revenue", "revenue_total").alias("revenue"))


def select_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Without a product master, questions about products are answered by the first five documents retrieved for them."""
    return _evidence_of(spark, sf, without_products=True).where("kind = 'doc'").select(
        "q_id", "pos", "tbl", "pk", F.round("score", 6).alias("score"))


def retrieve_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Every tenth vector asked against all vectors, and against an index without documents."""
    from storeline.operators import retrieval
    from storeline.sources.testdata import read_table
    e = read_table(spark, sf, "embeddings")
    asked = e.where("vec_id % 10 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("v"))
    docs = e.select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("v"))
    out = None
    for name, index in (("all", docs), ("none", docs.where("id is null"))):
        hits = retrieval.or_placeholder(retrieval.cosine_topk(asked, index), asked, index)
        one = hits.select(F.lit(name).alias("index"), "q_id", "id", "rank", F.round("score", 6).alias("score"),
                          F.col("raw")["fallback"].alias("fallback"))
        out = one if out is None else out.unionByName(one)
    return out


def answer_texts(spark: SparkSession, sf: str) -> DataFrame:
    """User turns as questions and the next turn as the reply; some questions are null, some ids repeat, some
    replies are missing, and each of them is answered by its error."""
    from storeline.plans import errors
    from storeline.sources.questions import CONV_FACTOR
    from storeline.sources.testdata import read_table
    c = read_table(spark, sf, "conversations").select("conv_id", "role", "text", (F.col("conv_id") * CONV_FACTOR + F.col("turn")).alias("q_id"))
    asked = c.where("role = 'user'").select("q_id", F.when(F.col("conv_id") % 11 != 3, F.col("text")).alias("question"))
    again = c.where("role = 'user' and conv_id % 13 = 5").select("q_id", F.col("text").alias("question"))
    good, failed = errors.quarantine(asked.unionByName(again))
    replies = c.where("role = 'assistant'").select((F.col("q_id") - 1).alias("q_id"), F.to_json(F.struct(F.col("text").alias("content"))).alias("response"))
    return errors.answer_texts(good.withColumn("error", F.lit(None).cast("string")).select("q_id", "error").unionByName(failed), replies)


QUERIES.update({
    "extract_answer": extract_answer, "chat_messages": chat_messages, "profile_tables": profile_tables,
    "best_outlet": best_outlet, "best_product": best_product, "availability_flags": availability_flags,
    "availability_flags_product": availability_flags_product,
    "minmax_normalize": minmax_normalize, "evidence": evidence_table, "select_fallback": select_fallback,
    "retrieve_fallback": retrieve_fallback, "answer_texts": answer_texts,
})
FLAGSHIP = "answers"


def _selection_inputs(spark: SparkSession, sf: str):
    from storeline.operators import intents
    from storeline.plans import answers
    from storeline.session import cut_lineage
    from storeline.sources.questions import questions
    m = answers.build_masters(model_tables(spark, sf))
    it = cut_lineage(intents.parse(questions(spark, sf), m["eo"]), "intents")
    return m, it


def filter_or_all(spark: SparkSession, sf: str) -> DataFrame:
    """The keys each question's filters select, or the whole table's when they select none.

    A set of keys is given by its size, its first and last key and the sum of a number made of each key."""
    from storeline.operators import select
    m, it = _selection_inputs(spark, sf)
    sel = select.selection(select.signatures(it), select.slim_masters(m["eo"], m["ep"]))
    return sel.q.join(sel.stats, "esig").select("q_id", "tbl", F.col("n").alias("n_rows"), "key_sum", "first_key", "last_key",
                                                (F.coalesce(F.col("n_sel"), F.lit(0)) > 0).alias("filtered"))


def _handled(spark: SparkSession, sf: str, query_type: str) -> DataFrame:
    from storeline.operators import select
    m, it = _selection_inputs(spark, sf)
    return select.evidence(it.where(F.col("query_type") == query_type), m["eo"], m["ep"], None)[0]


def handle_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """H4 / L1-L2: the ranked rows of every ranking question."""
    return _handled(spark, sf, "ranking").select("q_id", "pos", "tbl", "pk")


def handle_list(spark: SparkSession, sf: str) -> DataFrame:
    """H5 / L4: the first rows of every list question, in file order."""
    return _handled(spark, sf, "list").select("q_id", "pos", "tbl", "pk")


def handle_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """H3 / F8 / U4: the row of each compared entity, or the two best rows."""
    return _handled(spark, sf, "comparison").select("q_id", "pos", "tbl", "pk")


def handle_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    """The record of every aggregate question."""
    return _handled(spark, sf, "aggregate").select("q_id", "tbl", "agg_type", "count", "entity_type", "total_revenue", "total_units",
                                                   "average_price", "average_revenue", "median_price")


def build_prompt(spark: SparkSession, sf: str) -> DataFrame:
    """The prompt of every aggregate question: its text, its result lines and the closing request."""
    from storeline.operators import context, select
    from storeline.sources.questions import questions
    m, it = _selection_inputs(spark, sf)
    asked = it.where(F.col("query_type") == "aggregate")
    ev, sel = select.evidence(asked, m["eo"], m["ep"], None)
    ctx = context.contexts(asked, ev, m["eo"], m["ep"], m["mo"], m["mp"], select.summary_records(sel))
    both = ctx.join(questions(spark, sf), "q_id").select("q_id", context.messages(F.col("question"), F.col("context")).alias("messages"))
    return both.select("q_id", F.col("messages")[1]["role"].alias("role"), F.col("messages")[1]["content"].alias("content"))


def handle_analytical(spark: SparkSession, sf: str) -> DataFrame:
    """The summary of every analytical question in front (pos 0), then its top performers."""
    from storeline.operators import select
    m, it = _selection_inputs(spark, sf)
    ev, sel = select.evidence(it.where(F.col("query_type") == "analytical"), m["eo"], m["ep"], None)
    both = ev.join(select.summary_records(sel), "esig", "left")
    own = F.col("kind") == "summary"
    return both.select("q_id", "pos", "kind", "tbl", "pk", F.when(own, F.col("avg_performance")).alias("avg_performance"),
                       F.when(own, F.col("std_performance")).alias("std_performance"))


QUERIES.update({"filter_or_all": filter_or_all, "handle_ranking": handle_ranking, "handle_list": handle_list,
                "handle_comparison": handle_comparison, "handle_aggregate": handle_aggregate, "handle_analytical": handle_analytical,
                "build_prompt": build_prompt})


#: Headers as the exports of the source system write them, by logical table: file name, and headers that differ from the model's.
CSV_LAYOUT = {
    "outlet": ("Outlet.csv", {"outlet_id": "Outlet ID"}),
    "menu": ("menu.CSV", {"product_id": "ProductID", "product_name": "Product"}),
    "outlet_menu": ("outlet_menu.csv", {"outlet_menu_id": "ID", "product_id": "ProductID", "outlet_id": "OutletID"}),
    "order": ("order.csv", {"outlet_menu_id": " Outlet_Product(ID)", "customer_id": "Customer_ID(", "quantity": "Quantity(",
                            "unit_price": "Unit Price", "date": "Date "}),
    "promotion": ("promotion.csv", {}),
    "employment": ("employment.csv", {"position_id": "Position"}),
    "customer": ("customer_data.csv", {"customer_id": "Customer-ID", "note": "Note"}),
}


def csv_folder(spark: SparkSession, sf: str) -> str:
    """A folder of CSV exports of the model tables, and of the documents as customers' notes (quotes, line ends), below the
    shared checkpoint folder."""
    import uuid

    from storeline.session import ensure_checkpoint_dir
    from storeline.sources.testdata import read_table
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    t = model_tables(spark, sf)
    notes = read_table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("customer_id"), F.col("text").alias("note"))
    for name, (file, renames) in CSV_LAYOUT.items():
        df = notes if name == "customer" else t[name]
        # the writer's own trimming off, quotes doubled
        named = df.select(*(F.col(c).alias(renames.get(c, c)) for c in df.columns))
        named.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False) \
            .option("ignoreTrailingWhiteSpace", False).csv(f"{folder}/{file}")
    return folder


def load_tables(spark: SparkSession, sf: str) -> DataFrame:
    """A folder of CSV exports, loaded and normalised: rows, missing values and examples of every column."""
    from storeline.operators import profile
    from storeline.sources import csv_tables
    loaded = csv_tables.load_tables(spark, csv_folder(spark, sf))
    p = profile.profile_tables(loaded, [n for n in CSV_LAYOUT if n != "customer"])
    notes = loaded["customer"].agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("note").isNull()).alias("n_missing"),
                                   F.sum(F.length("note")).cast("string").alias("examples"))
    return p.select("table", "column", "rows", "n_missing", F.array_join("examples", ", ").alias("examples")).unionByName(
        notes.select(F.lit("customer").alias("table"), F.lit("note").alias("column"), "rows", "n_missing", "examples"))


def _built(spark: SparkSession, sf: str) -> str:
    """The outputs of the whole build over the model tables, committed below the shared checkpoint folder."""
    import uuid

    from storeline.plans import build
    from storeline.session import ensure_checkpoint_dir
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}"
    t = model_tables(spark, sf)
    build.build_from(spark, {n: t[n] for n in PROFILED}, folder)
    return folder


def stored_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Build, commit, and read back what the newest manifest names: documents with their masters' scores."""
    from storeline.sources import stored
    folder = _built(spark, sf)
    docs = stored.read_documents(spark, folder)
    m = stored.read_masters(spark, folder, ["master_outlet", "master_product"])
    scores = m["master_outlet"].select(F.lit("master_outlet").alias("source"), F.col("outlet_id").alias("pk"), F.col("outlet_score").alias("score")) \
        .unionByName(m["master_product"].select(F.lit("master_product").alias("source"), F.col("product_id").alias("pk"), F.col("product_score").alias("score")))
    size = stored.read_vectors(spark, folder).select("id", F.size("embedding").alias("dimensions"))
    return docs.join(scores, ["source", "pk"]).join(size, "id").select("id", "source", "pk", "text", "score", "dimensions")


def profile_report(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of the data profile, as the build wrote them."""
    from storeline.sources import stored
    return stored.read_report(spark, _built(spark, sf)).select(F.col("value").alias("line"))


def sanitize_values(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors nested in structs, arrays and maps, some numbers made infinite or NaN, with all of those as 0."""
    from storeline.operators import retrieval
    from storeline.sources.testdata import read_table
    e = read_table(spark, sf, "embeddings")
    bad = F.when(F.col("vec_id") % 3 == 0, F.lit(float("nan"))).when(F.col("vec_id") % 3 == 1, F.lit(float("-inf"))).otherwise(F.element_at("embedding", 1).cast("double"))
    nested = e.select("vec_id", F.struct(bad.alias("x"), F.col("label"), F.array(F.struct(bad.alias("y"), F.lit("t").alias("z"))).alias("list"),
                                         F.create_map(F.lit("k"), F.array(bad, F.lit(1.5))).alias("map")).alias("raw"))
    clean = retrieval.sanitize_values(nested)
    return clean.select("vec_id", F.col("raw.x").alias("x"), F.col("raw.label").alias("label"), F.col("raw.list")[0]["y"].alias("y"),
                        F.col("raw.list")[0]["z"].alias("z"), F.col("raw.map")["k"][0].alias("m0"), F.col("raw.map")["k"][1].alias("m1"))


QUERIES.update({"load_tables": load_tables, "stored_documents": stored_documents, "profile_report": profile_report, "sanitize_values": sanitize_values})

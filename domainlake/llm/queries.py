"""Registered queries of the training-data operators and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from domainlake.llm.common import held_out, table
from domainlake.llm.fingerprints import edit_fingerprints
from domainlake.llm.html import extract_main_text
from domainlake.llm.minhash import min_hash_components
from domainlake.llm.mixing import document_rates
from domainlake.llm.packing import pack
from domainlake.llm.quality import fit_neighbours, score_quality
from domainlake.llm.secrets import secret_spans, spans_column
from domainlake.llm.simhash import near_duplicate_components
from domainlake.llm.spelling import spelling_variants
from domainlake.llm.sqltext import MIN_HASH, SPELLING, TRIE
from domainlake.llm.substrings import remove_repeated_spans
from domainlake.llm.topk import exact_top_k
from domainlake.llm.toxicity import fit_toxicity, score_toxicity
from domainlake.llm.tries import conversation_trie

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a job under its name, with its SQL check where SQL can express it."""

    def add(job: Callable[[SparkSession, str], DataFrame]):
        QUERIES[job.__name__] = job
        if sql is not None:
            ORACLES[job.__name__] = sql
        return job

    return add


TOP_K = """
with usable as (
  select vec_id, [floor(1024 * x::double) for x in embedding] as codes
  from embeddings
  where vec_id is not null and embedding is not null
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
scored as (
  select q.vec_id as query_id, v.vec_id, list_inner_product(q.codes, v.codes)::bigint as score
  from usable q join usable v on q.vec_id % 100 = 0 and v.vec_id <> q.vec_id),
ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 10
"""


@query(TOP_K)
def op1_exact_top_k(spark, sf_dir):
    """The ten nearest vectors, by inner product, of every hundredth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return exact_top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


@query()
def op10_simhash_components(spark, sf_dir):
    """Component of near duplicates of every document."""
    found = near_duplicate_components(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query()
def op6_best_fit_packing(spark, sf_dir):
    """Sequence and offset of every piece of every document."""
    from public_tokenizers import path

    return pack(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), capacity=1024, end_id=2)


@query()
def op3_secret_scan(spark, sf_dir):
    """Counts and spans of secrets in every document."""
    found = secret_spans(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(spans_column(F.col("base")), 256).alias("base_sha256"),
        spans_column(F.concat("base", "added")).alias("spans"),
    )


@query()
def op5_order_minhash(spark, sf_dir):
    """Order MinHash of every document, its edited text, and their likeness."""
    return edit_fingerprints(table(spark, sf_dir, "documents"))


@query()
def op8_line_block_text(spark, sf_dir):
    """Main text of every page."""
    return extract_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query()
def op7_de_bruijn_substrings(spark, sf_dir):
    """What is left of every document without spans that an earlier one holds."""
    found = remove_repeated_spans(table(spark, sf_dir, "documents"), window=50)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query()
def op2_subsequence_svm_toxicity(spark, sf_dir):
    """Toxicity score of every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score_toxicity(docs.select("doc_id", "text"), fit_toxicity(docs, labels))
    return scored.select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query()
def op9_nearest_neighbour_quality(spark, sf_dir):
    """Quality score of every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score_quality(docs.select("doc_id", "text"), fit_neighbours(docs, labels))
    return scored.select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


@query()
def op4_soft_membership_mixing(spark, sf_dir):
    """Rate and copies of every document for the target weights of domains."""
    rated = document_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rated.select("doc_id", "tokens", "domains", F.transform("p", lambda x: F.round(x, 6)).alias("p"), "rate", "copies")


@query(SPELLING)
def op12_spelling_variants(spark, sf_dir):
    """Near words, form and root of every word of the corpus."""
    return spelling_variants(table(spark, sf_dir, "documents"))


@query(TRIE)
def op13_euler_tour_trie(spark, sf_dir):
    """Members, leaves and savings of every node of the conversations' prefix tree."""
    return conversation_trie(table(spark, sf_dir, "conversations")).drop("position")


@query(MIN_HASH)
def op11_min_hash_components(spark, sf_dir):
    """Shingle set size and component of similar sets of every document."""
    return min_hash_components(table(spark, sf_dir, "documents"))

"""The registered queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, html, langid, packing, pii, runs, simhash, substrings, tiling, tokenfile, topk, toxicity, versions
from .common import read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the token files of ``documents`` and derive the digests from what is read back."""
    return tokenfile.token_file_query(read(spark, sf_dir, "documents"), tokenizer_path())


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of ``documents`` with its place in a sequence of at most 2048 tokens."""
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path(), digests=True)


@query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned from the rows that are not held out."""
    return langid.language_query(read(spark, sf_dir, "documents"))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; learned from the labels that are not held out."""
    return toxicity.toxicity_query(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that are left without 13-word windows of documents with smaller ids."""
    kept = substrings.remove_repeats(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query
def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extract(read(spark, sf_dir, "pages"))


@query
def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest inner products of every vector whose id is divisible by 50."""
    vectors = topk.whole_numbers(read(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


ORACLES["op5_top_k"] = """
WITH whole AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
           FROM whole q JOIN whole c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest coverage of a benchmark item in every document, and the items that contaminate it."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = tiling.judged(docs, read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "coverage", F.size("items").cast("long").alias("n_items"), F.array_join(F.col("items").cast("array<string>"), ",").alias("items"), (F.size("items") > 0).alias("contaminated"))


@query
def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and a digest of the base spans of every document, and all its spans."""
    found = pii.find(read(spark, sf_dir, "documents"))
    names = F.array(*[F.lit(k) for k in pii.KINDS])

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every document, a tenth of which end in a repeated stretch, and digests of them and of the collapsed text."""
    return runs.digests(runs.find(runs.repeat_tails(read(spark, sf_dir, "documents"))))


@query
def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited version, and their likeness by the paragraph digests that peeling recovers."""
    return versions.edited_versions(read(spark, sf_dir, "documents"))


@query
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the tokens of two tokenizers in every document, weighed by how many documents hold a link."""
    return align.alignment_query(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))

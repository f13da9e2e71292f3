"""One registered query per operator of this package; each reads its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    alignment, decontaminate, fingerprints, jaccard_join, licenses, line_dedup, mixing, neighbours, quality, ranked_search, secrets, suffix_dedup,
    toxicity,
)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade, tail probabilities and the decision for every document."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, quality.grades_of(labels))
    score = F.col("score")
    tails = [model.tail(score, k + 1) for k in range(len(model.thresholds))]
    return docs.select("doc_id", model.score(F.col("text")).alias("score")).select(
        "doc_id", "score", model.expected(score).alias("expected_grade"), tails[0].alias("p_usable"),
        tails[-1].alias("p_best"), (tails[0] < 0.5).alias("rejected"),
    )


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated strings cover in every document, and a digest of what stays."""
    return suffix_dedup.deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")


def op3_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest found for every fiftieth vector, against all vectors."""
    return neighbours.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items per document."""
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.scanned(docs.select("doc_id", "text"), items).select("doc_id", "_found.*")
    hit = F.aggregate(F.transform("ranges", lambda v, k: F.when(k % 2 == 0, -v).otherwise(v)), F.lit(0), lambda a, v: a + v)
    names = F.array_sort(F.transform(F.array_distinct("items"), lambda v: v.cast("string")))
    return found.select(
        "doc_id", "n_words", hit.cast("long").alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
        F.coalesce(F.array_max("longest"), F.lit(0)).alias("longest_match"),
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices per document, with the share of the notice that was found."""
    return licenses.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), licenses.builtin_templates(spark))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of near copies for every document."""
    return jaccard_join.joined(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document when sources are mixed to their targets."""
    return mixing.taken(*mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the fixed formats' spans, and all spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = docs.select("doc_id", secrets.spans(F.col("text"), secrets.learn(docs)).alias("s"))
    base = F.filter("s", lambda x: x["base"])
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in secrets.KINDS], F.sha2(text(base), 256).alias("base_sha256"),
        text(F.col("s")).alias("spans"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes of every document when repeated runs of lines are removed, and a digest of what stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = line_dedup.deduplicated(docs)
    return out.select(
        "doc_id", F.col("_n_chunks").alias("n_chunks"), F.col("_removed_chunks").alias("removed_chunks"),
        F.col("_removed_lines").alias("removed_lines"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score and a decision for every document; rows of the held-out fold teach nothing."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels)
    return docs.select("doc_id", model.score(F.col("text")).alias("score")).select(
        "doc_id", (~toxicity.learning(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op11_nra_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return ranked_search.ranked(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are."""
    return fingerprints.compared_to_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers per document, and how often the linked ids meet in the corpus."""
    return alignment.aligned(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {
    f.__name__: f for f in (
        op1_quality, op2_suffix_dedup, op3_nn_descent, op4_decontaminate, op5_license_scan, op6_jaccard_join, op7_mix, op8_secrets, op9_line_dedup,
        op10_toxicity, op11_nra_search, op12_minhash, op13_tokenizer_alignment,
    )
}
ORACLES = {"op9_line_dedup": line_dedup.ORACLE, "op11_nra_search": ranked_search.ORACLE}

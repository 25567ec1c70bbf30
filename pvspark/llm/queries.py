"""The registered queries ``opN_<name>``: operators with production parameters on whole tables."""

import hashlib

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from pvspark.llm import (
    centroids,
    decontaminate,
    divergence,
    jaccard,
    langid,
    lm,
    mixing,
    neighbours,
    oracles,
    quality,
    repeats,
    secrets,
    token_files,
    urls,
)
from pvspark.llm.common import remainder, table
from pvspark.session import scratch_path


def op1_secret_scan(spark, sf_dir):
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
    base = F.filter("spans", lambda s: s["kind"] != "random")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in secrets.KINDS],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def op2_suffix_dedup(spark, sf_dir):
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_bytes",
        gone.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op3_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = langid.train(docs, ~held_out)
    return langid.predict(docs, model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected"
    )


def op4_ngram_jaccard(spark, sf_dir):
    return jaccard.join(table(spark, sf_dir, "documents"), jaccard.Params(words=3, num=90, den=100, universe=3.0))


def op5_url_filter(spark, sf_dir):
    """A page is labelled by the document of its number: blocked if toxic or of low quality."""
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"),
        ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("blocked"),
    )
    return urls.filter_urls(table(spark, sf_dir, "pages"), labels)


def op6_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 5) == 0
    model = quality.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    return quality.predict(docs, model).select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op7_decontaminate(spark, sf_dir):
    """One row per document and benchmark item that share a passage."""
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.leaks(docs, benchmark).select(
        "doc_id",
        "item_id",
        F.col("matched").cast("long").alias("matched_words"),
        F.col("of").cast("long").alias("window_words"),
    )


def op8_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return mixing.probabilities(docs).select(
        "doc_id",
        "source",
        "lang",
        F.col("__topic").alias("topic"),
        F.col("__weight").alias("weight"),
        F.col("__probability").alias("probability"),
        F.col("__kept").alias("kept"),
    )


def op9_nearest(spark, sf_dir):
    """Every 20th vector against all."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(20)) == 0)


def op10_lm_score(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 7) == 2
    model, rare = lm.train(docs, ~held_out)
    scored = lm.score(docs, model, rare)
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )


def op11_token_files(spark, sf_dir):
    folder = scratch_path(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.read(spark, folder).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


def op12_centroids(spark, sf_dir):
    found = centroids.cluster(table(spark, sf_dir, "embeddings"))
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    facts = [(k, n, digest(c)) for k, (n, c) in enumerate(zip(found.inertia, found.centroids.tolist()))]
    of_cluster = spark.createDataFrame(facts, "cluster int, cluster_inertia long, centroid_sha256 string")
    return found.assigned.join(F.broadcast(of_cluster), "cluster").select(  # 16 rows
        "vec_id",
        "cluster",
        "distance",
        "cluster_inertia",
        F.lit(sum(found.inertia)).cast("long").alias("inertia"),
        "centroid_sha256",
    )


def op13_divergence(spark, sf_dir):
    return divergence.divergences(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = [
    op1_secret_scan,
    op2_suffix_dedup,
    op3_language_id,
    op4_ngram_jaccard,
    op5_url_filter,
    op6_quality,
    op7_decontaminate,
    op8_mixing,
    op9_nearest,
    op10_lm_score,
    op11_token_files,
    op12_centroids,
    op13_divergence,
    pipeline,
]
ORACLES = {"op12_centroids": oracles.centroids(), "op13_divergence": oracles.DIVERGENCE}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL

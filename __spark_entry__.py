"""

Test tables stand in for the library's inputs: ``documents`` are source files
(``source`` = repository or version, path = ``source/doc_id.lang``),
``embeddings`` are file vectors (``label`` = version, ``vec_id`` = file),
``pages.url`` are repository URLs, ``orders`` are repository metadata.
Embeddings are near-random, so their queries use threshold 0.4; the default
0.99 is exercised on term-frequency vectors of the documents.
"""

from __future__ import annotations

import datetime
import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from pvspark.functions import text, vectors  # noqa: E402
from pvspark.functions.versioning import version_key  # noqa: E402
from pvspark.operators import catalog, duplicates, pv, vocab  # noqa: E402
from pvspark.operators import versions as V  # noqa: E402
from pvspark.operators.bag_similarity import bag_duplicates  # noqa: E402
from pvspark.operators.ranking import global_rank  # noqa: E402
from pvspark.operators.sign_projections import approximate_duplicates  # noqa: E402
from pvspark.plans import cross_version, training  # noqa: E402
from pvspark.plans.corpus import prepare_corpus  # noqa: E402
from pvspark.session import discard, materialize, scratch_path, spread  # noqa: E402
from pvspark.sources import sinks, tables  # noqa: E402

# the training-data operators are an optional part
try:
    import pvspark.llm.queries as llm  # noqa: E402
except ModuleNotFoundError as missing:
    if not str(missing.name).startswith(("pvspark.llm", "corpus_pipeline")):
        raise
    llm = None

T = 0.4
AS_OF = datetime.date(2001, 8, 2)
PV = pv.PVParams(vector_size=16, epochs=2, passes_per_round=2)

# ---- inputs -------------------------------------------------------------


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``repo, version, path, text``; path is relative to the repository."""
    d = _table(spark, sf_dir, "documents")
    return d.select(
        "doc_id",
        F.col("source").alias("repo"),
        F.col("source").alias("version"),
        F.concat(F.col("doc_id").cast("string"), F.lit("."), "lang").alias("path"),
        "text",
    )


def _documents(spark: SparkSession, sf_dir: str, min_tokens: int = text.MIN_TOKENS) -> DataFrame:
    files = spread(_files(spark, sf_dir))
    return text.prepare_documents(
        files, F.col("text"), F.col("repo"), F.col("path"), ["repo", "version", "path"], min_tokens
    )


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored documents, for queries that go over them more than once."""
    return prepare_corpus(_files(spark, sf_dir), F.col("repo"), keep=["repo", "version", "path"])


def _repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories in list order (here: version order)."""
    names = _table(spark, sf_dir, "documents").select(F.col("source").alias("repo")).distinct()
    return global_rank(names, [version_key(F.col("repo")), F.col("repo")], "repo_pos")


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("label").cast("string").alias("version"), "label", "embedding"
    )


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored: one row per version, used several times by each report."""
    e = _embeddings(spark, sf_dir)
    counted = V.files_per_version(V.select_versions(e, "[0-9]+"), e.select("version"))
    return materialize(V.versions_with_documents(counted), "versions")


def _one_set(spark: SparkSession, sf_dir: str) -> duplicates.NearDuplicates:
    return duplicates.near_duplicates(_embeddings(spark, sf_dir), T, file="vec_id")


def _two_sets(spark: SparkSession, sf_dir: str) -> duplicates.NearDuplicates:
    e = _embeddings(spark, sf_dir)
    return duplicates.two_sets(
        e.filter(F.col("label") < 5), e.filter(F.col("label") >= 5), T, file="vec_id"
    )


def _by_version(
    spark: SparkSession, sf_dir: str, versions: DataFrame | None = None
) -> duplicates.NearDuplicates:
    versions = _versions(spark, sf_dir) if versions is None else versions
    e = _embeddings(spark, sf_dir).join(versions.select("version", "ord"), "version")
    return duplicates.near_duplicates(e, T, file="vec_id", ord=F.col("ord"))


# ---- text and corpus ----------------------------------------------------

_WORDS = (
    # fixed value: the token pattern
    "list_transform(list_filter(regexp_extract_all(text, '[A-Za-z_][A-Za-z_0-9]*'), "
    "lambda t: length(t) > 1), lambda t: lower(t))"
)
_DOCS = f"""docs AS (
  SELECT source || '/' || doc_id || '.' || lang AS tag, source, lang, doc_id,
         CAST(substr(source, 4) AS INT) AS repo_pos, doc_id || '.' || lang AS path, words
  FROM (SELECT *, {_WORDS} AS words FROM documents) WHERE len(words) > 5)"""


def tokenize(spark, sf_dir):
    d = spread(_files(spark, sf_dir)).select("doc_id", text.tokenize(F.col("text")).alias("words"))
    joined = F.concat_ws(" ", "words")
    return d.select("doc_id", F.size("words").cast("long").alias("n_tokens"), joined.alias("words"))


def decode_source(spark, sf_dir):
    """Stray bytes around every text are dropped, the text itself is kept."""
    stray = F.unhex(F.lit("FFC3"))
    content = F.concat(stray, F.encode("text", "UTF-8"), F.unhex(F.lit("E282")))
    decoded = text.decode_source(content)
    return _files(spark, sf_dir).select("doc_id", F.md5(F.encode(decoded, "UTF-8")).alias("digest"))


def prepare_documents(spark, sf_dir):
    return _documents(spark, sf_dir).select(
        "tag", F.size("words").cast("long").alias("n_tokens"), F.concat_ws(" ", "words").alias("words")
    )


def scan_by_extension(spark, sf_dir):
    """Two overlapping suffixes and a glob; each file once."""
    return text.filter_extensions(_files(spark, sf_dir), [".fr", "fr", ".e?"]).select(
        text.make_tag(F.col("repo"), F.col("path")).alias("tag")
    )


def source_dir_filter(spark, sf_dir):
    tags = _files(spark, sf_dir).select(text.make_tag(F.col("repo"), F.col("path")).alias("path"))
    return text.filter_source_dir(tags, "src1/")


def _counted_versions(spark, sf_dir):
    """Every version of the files and some that have none, one of them between others."""
    names = _files(spark, sf_dir).select("version")
    unused = names.withColumn("version", F.concat("version", F.lit(".5")))
    tags = V.select_versions(names.union(unused), "src[0-9]+")
    return V.files_per_version(tags, _documents(spark, sf_dir))


def files_per_version(spark, sf_dir):
    return _counted_versions(spark, sf_dir).select("version", "files")


def total_documents(spark, sf_dir):
    counted = V.files_per_version(
        V.select_versions(_files(spark, sf_dir), "src[0-9]+"), _documents(spark, sf_dir)
    )
    return counted.agg(F.sum("files").alias("total_documents"))


def version_tags(spark, sf_dir):
    """Regex is anchored at the start only: ``src1`` takes ``src1`` and ``src10`` to ``src19``."""
    chosen = V.select_versions(_files(spark, sf_dir), "src1", max_versions=8)
    return chosen.select("version", F.col("ord").cast("long").alias("ord"))


def versions_with_docs(spark, sf_dir):
    return V.versions_with_documents(_counted_versions(spark, sf_dir)).select(
        "version", F.col("ord").cast("long").alias("ord"), "files"
    )


def repo_list(spark, sf_dir):
    """Written as a text list with stray whitespace, read back clean."""
    padded = F.concat(F.lit("\t "), "url", F.lit(" \r"))
    path = scratch_path(spark, "repo-list")
    sinks.write_repo_list(_table(spark, sf_dir, "pages").select(padded.alias("url")), path, "url")
    return tables.read_repo_list(spark, path)


def repo_names(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select(
        "page_id", text.repo_name(F.col("url")).alias("repo_name")
    )


def batch_assignment(spark, sf_dir):
    docs = _documents(spark, sf_dir).select("tag", "repo", "path")
    return vocab.assign_batches(docs, _repos(spark, sf_dir), 3, 40).select(
        "tag", *[F.col(c).cast("long").alias(c) for c in ("batch", "batch_pos", "sub_batch")]
    )


def corpus_progress(spark, sf_dir):
    return vocab.corpus_progress(_documents(spark, sf_dir), _repos(spark, sf_dir), 3).withColumn(
        "batch", F.col("batch").cast("long")
    )


def _sample(spark, sf_dir):
    return vocab.sample_documents(
        _documents(spark, sf_dir).select("tag", "repo", "path"), _repos(spark, sf_dir)
    )


def sample_documents(spark, sf_dir):
    return _sample(spark, sf_dir).select("tag")


def sample_unique_repos(spark, sf_dir):
    """Over all documents: the name is that of the report's field."""
    return vocab.unique_repos(_documents(spark, sf_dir).select("tag"))


def vocab_build(spark, sf_dir):
    return vocab.build(_documents(spark, sf_dir))


def _one_batch_per_repo(spark, sf_dir):
    return _documents(spark, sf_dir).join(
        _repos(spark, sf_dir).withColumnRenamed("repo_pos", "batch"), "repo"
    )


def vocab_growth(spark, sf_dir):
    grown = vocab.growth(_one_batch_per_repo(spark, sf_dir))
    return grown.select(*[F.col(c).cast("long").alias(c) for c in grown.columns])


def vocab_incremental(spark, sf_dir):
    return vocab.first_batches(_one_batch_per_repo(spark, sf_dir)).select(
        "word", "count", F.col("first_batch").cast("long").alias("first_batch")
    )


def encode_documents(spark, sf_dir):
    docs = _corpus(spark, sf_dir)
    tokens = docs.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    encoded = vocab.encode(docs, vocab.build(docs), max(1, -(-tokens // vocab.ENCODE_TOKENS)))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select("tag", F.size("ids").cast("long").alias("n_ids"), ids.alias("ids"))


# ---- catalog ------------------------------------------------------------


def _repo_metadata(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("language"),
        F.col("o_orderstatus").alias("org"),
        F.col("o_totalprice").alias("stargazers_count"),
        F.col("o_orderdate").cast("date").alias("created"),
        F.col("o_orderkey").alias("full_name"),
    )


def popular_items(spark, sf_dir):
    found = catalog.popular_repos(
        _repo_metadata(spark, sf_dir), "1-URGENT", 100, 1000, as_of=AS_OF
    )
    return found.select("full_name", "stargazers_count")


def popular_items_org(spark, sf_dir):
    found = catalog.popular_repos(
        _repo_metadata(spark, sf_dir), "2-HIGH", 5000, 10**9, org="F", as_of=AS_OF
    )
    return found.select("full_name", "stargazers_count")


# ---- duplicates ---------------------------------------------------------

_REPORT = [
    "total_files",
    "duplicate_pairs",
    "exact_duplicate_pairs",
    "files_with_duplicates",
    "percentage_files_with_duplicates",
    "threshold",
]


def _rounded(pairs: DataFrame, *columns: str) -> DataFrame:
    cast = [F.col(c).cast("long").alias(c) for c in columns]
    return pairs.select(*cast, "file_a", "file_b", F.round("similarity", 6).alias("similarity"))


def dup_pairs(spark, sf_dir):
    return _rounded(_one_set(spark, sf_dir).sorted_pairs())


def dup_pairs_nan(spark, sf_dir):
    """The vectors of one version hold a NaN each: they are similar to nothing."""
    nan = F.array_append(F.slice("embedding", 1, 63), F.lit(float("nan")).cast("float"))
    e = _embeddings(spark, sf_dir).withColumn(
        "embedding", F.when(F.col("label") == 3, nan).otherwise(F.col("embedding"))
    )
    return _rounded(duplicates.near_duplicates(e, T, file="vec_id").sorted_pairs())


def dup_pairs_cross(spark, sf_dir):
    return _rounded(_two_sets(spark, sf_dir).sorted_pairs())


def dup_top10(spark, sf_dir):
    return _rounded(_one_set(spark, sf_dir).top(10))


def dup_pairs_hashed(spark, sf_dir):
    """Sign projections against the exact join: no pair that is not one, at least nine in ten found."""
    e = _embeddings(spark, sf_dir)
    hashed = approximate_duplicates(e, T, recall=0.99, file="vec_id").pairs().select("file_a", "file_b", "similarity")
    exact = duplicates.near_duplicates(e, T, file="vec_id").pairs().select("file_a", "file_b", "similarity")
    both = hashed.select("*", F.lit(1).alias("found"), F.lit(0).alias("exact")).unionAll(
        exact.select("*", F.lit(0), F.lit(1))
    )
    pairs = both.groupBy("file_a", "file_b", "similarity").agg(F.sum("found").alias("found"), F.sum("exact").alias("exact"))
    return pairs.agg(
        F.sum("exact").alias("exact_pairs"),
        F.count_if((F.col("found") != F.col("exact")) & (F.col("found") > 0)).alias("wrong_pairs"),
        (F.count_if(F.col("found") == F.col("exact")) >= 0.9 * F.sum("exact")).alias("recall_reached"),
    )


def group_links(spark, sf_dir):
    """Pairs of copy groups, named by their first file, with the versions of each as a bitmap."""
    links, members = _by_version(spark, sf_dir).compressed()
    names = members.groupBy("gid").agg(F.min("file").alias("name"))
    side = lambda s: names.select(F.col("gid").alias(f"gid_{s}"), F.col("name").alias(f"name_{s}"))
    named = links.join(side("a"), "gid_a").join(side("b"), "gid_b")
    flip = F.col("name_a") > F.col("name_b")
    pick = lambda x, y: F.when(flip, F.col(x)).otherwise(F.col(y))
    return named.select(
        pick("name_b", "name_a").alias("file_a"),
        pick("name_a", "name_b").alias("file_b"),
        F.round("similarity", 6).alias("similarity"),
        pick("versions_b", "versions_a")[0].alias("versions_a"),
        pick("versions_a", "versions_b")[0].alias("versions_b"),
    )


def group_members(spark, sf_dir):
    """Every file with the first file of its copy group: with ``group_links`` the whole pair list."""
    _, members = _by_version(spark, sf_dir).compressed()
    names = members.groupBy("gid").agg(F.min("file").alias("group_file"))
    return members.join(names, "gid").select("file", F.col("ord").cast("long").alias("ord"), "group_file")


def files_in_duplicates(spark, sf_dir):
    return _one_set(spark, sf_dir).files_in_duplicates().select(F.col("file").alias("vec_id"))


def dup_report(spark, sf_dir):
    return _one_set(spark, sf_dir).report()


def dup_report_cross(spark, sf_dir):
    return _two_sets(spark, sf_dir).report()


def dup_pairs_tf(spark, sf_dir):
    docs = _documents(spark, sf_dir).select("tag", "words")
    return _rounded(bag_duplicates(docs, 0.99).pairs())


def dup_report_tf(spark, sf_dir):
    return bag_duplicates(_documents(spark, sf_dir).select("tag", "words"), 0.99).report()


def version_pairs_all(spark, sf_dir):
    return _rounded(V.version_pairs(_by_version(spark, sf_dir)), "ord_a", "ord_b")


def version_pairs_consecutive(spark, sf_dir):
    return _rounded(V.consecutive_pairs(_by_version(spark, sf_dir)), "ord_a", "ord_b")


def within_version_pairs(spark, sf_dir):
    return _rounded(V.within_version_pairs(_by_version(spark, sf_dir)), "ord_a")


def leakage_pairs(spark, sf_dir):
    return _rounded(V.leakage_pairs(_by_version(spark, sf_dir)), "pair")


def train_duplicate_pairs(spark, sf_dir):
    versions = _versions(spark, sf_dir)
    found = _by_version(spark, sf_dir, versions)
    return _rounded(V.train_duplicate_pairs(found, versions.count()), "pair")


def leakage_report(spark, sf_dir):
    versions = _versions(spark, sf_dir)
    return V.leakage_report(_by_version(spark, sf_dir, versions), versions)


def consecutive_report(spark, sf_dir):
    versions = _versions(spark, sf_dir)
    return V.consecutive_report(_by_version(spark, sf_dir, versions), versions)


def overall_result(spark, sf_dir):
    return V.overall_result(leakage_report(spark, sf_dir))


def pair_totals(spark, sf_dir):
    return V.pair_totals(_by_version(spark, sf_dir))


# ---- vectors ------------------------------------------------------------


def embeddings_wide_roundtrip(spark, sf_dir):
    """Written as wide CSV, read back, widened again."""
    e = _embeddings(spark, sf_dir).select(
        F.col("vec_id").alias("file_path"), vectors.as_doubles(F.col("embedding")).alias("embedding")
    )
    path = scratch_path(spark, "wide")
    sinks.write_embeddings_csv(e, path, 64)
    back = vectors.to_wide(tables.read_embeddings_csv(spark, path), 64)
    return back.withColumn("file_path", F.col("file_path").cast("long"))


def embeddings_versioned_roundtrip(spark, sf_dir):
    """Written with a folder per version: the version comes back as a column, not as a component."""
    e = _embeddings(spark, sf_dir).select(
        F.col("vec_id").alias("file_path"),
        F.concat("version", F.lit(".0")).alias("version"),
        vectors.as_doubles(F.col("embedding")).alias("embedding"),
    )
    path = scratch_path(spark, "versioned")
    sinks.write_embeddings_csv(e, path, 64, version="version")
    back = tables.read_embeddings_csv(spark, path)
    return back.select(
        F.col("file_path").cast("long").alias("file_path"),
        "version",
        F.size("embedding").cast("long").alias("dims"),
        F.col("embedding")[0].alias("dim_0"),
        F.col("embedding")[63].alias("dim_63"),
    )


def _tag_requests(spark, sf_dir):
    """Wanted tags: every order key; most of them have no vector."""
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tag"))


def _stored(spark, sf_dir):
    return _embeddings(spark, sf_dir).select(
        F.col("vec_id").alias("tag"), vectors.as_doubles(F.col("embedding")).alias("vector")
    )


def stored_lookup(spark, sf_dir):
    found = pv.lookup_vectors(_stored(spark, sf_dir), _tag_requests(spark, sf_dir))
    first = F.round(F.col("vector")[0], 6)
    return found.select("tag", F.size("vector").cast("long").alias("dims"), first.alias("dim_0"))


def missing_tags(spark, sf_dir):
    return pv.missing_tags(_stored(spark, sf_dir), _tag_requests(spark, sf_dir))


def _shape(found: DataFrame) -> DataFrame:
    finite = F.forall("vector", lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(1e6)))
    moved = F.exists("vector", lambda x: x != 0)
    return found.select(
        "tag", F.size("vector").cast("long").alias("dims"), (finite & moved).alias("usable")
    )


def pv_train(spark, sf_dir):
    """A base model by the library's own settings: 200 floats a vector, 20 epochs."""
    return _shape(pv.PVTrainer(pv.PVParams()).fit(_corpus(spark, sf_dir)).doc_vectors())


def pv_train_batches(spark, sf_dir):
    """Ten repositories per batch, vocabulary extended by the second batch."""
    trained = training.train_base(
        _files(spark, sf_dir), _repos(spark, sf_dir), None, PV, batch_size=10
    )
    return _shape(trained.model.doc_vectors())


def _base(spark, sf_dir) -> pv.PVModel:
    docs = _corpus(spark, sf_dir)
    model = pv.PVTrainer(PV).fit(docs)
    discard(docs)
    return model


def pv_finetune(spark, sf_dir):
    """The base model continues on the files of all versions."""
    tuned = training.finetune_and_embed(
        _base(spark, sf_dir),
        _files(spark, sf_dir).withColumn("path", F.concat_ws("/", "repo", "path")),
        None,
        epochs=1,
        infer_epochs=1,
    )
    return _shape(tuned.embeddings.withColumnsRenamed({"file_path": "tag", "embedding": "vector"}))


def pv_infer(spark, sf_dir):
    """Besides the shape: whether each vector equals that of the first document with the same words.

    Base model and inference go by the library's own settings: 200 floats, 20 epochs each.
    """
    docs = _corpus(spark, sf_dir)
    found = materialize(pv.PVTrainer(pv.PVParams()).fit(docs).infer(docs), "inferred")
    words = docs.select("tag", F.xxhash64("words").alias("words"))
    first = words.groupBy("words").agg(F.min("tag").alias("first"))
    named = words.join(first, "words").join(found, "tag")
    other = found.select(F.col("tag").alias("first"), F.col("vector").alias("theirs"))
    equal = named.join(other, "first").select("tag", (F.col("vector") == F.col("theirs")).alias("as_copy"))
    return _shape(found).join(equal, "tag")


def pv_sample(spark, sf_dir):
    trained = training.train_base(
        _files(spark, sf_dir), _repos(spark, sf_dir), None, PV, batch_size=20, max_docs_per_batch=10**9
    )
    found = trained.sample_embeddings()
    return _shape(found.withColumnsRenamed({"file_path": "tag", "embedding": "vector"}))


def pv_cumulative(spark, sf_dir):
    """Languages as versions: four steps, each continuing from the one before."""
    files = _files(spark, sf_dir).select(
        F.substring_index("path", ".", -1).alias("version"),
        F.concat_ws("/", "repo", "path").alias("path"),
        "text",
    )
    run = cross_version.cross_version(
        pv.PVModel.empty(spark, PV), files, "[a-z]+$", None, epochs=1, threshold=0.99
    )
    return _shape(run.embeddings.withColumnsRenamed({"file_path": "tag", "embedding": "vector"}))


# ---- contract -----------------------------------------------------------

_QUERIES = [
    tokenize,
    decode_source,
    prepare_documents,
    scan_by_extension,
    source_dir_filter,
    files_per_version,
    total_documents,
    version_tags,
    versions_with_docs,
    repo_list,
    repo_names,
    batch_assignment,
    corpus_progress,
    sample_documents,
    sample_unique_repos,
    vocab_build,
    vocab_growth,
    vocab_incremental,
    encode_documents,
    popular_items,
    popular_items_org,
    dup_pairs,
    dup_pairs_nan,
    dup_pairs_cross,
    dup_pairs_hashed,
    group_links,
    group_members,
    dup_top10,
    files_in_duplicates,
    dup_report,
    dup_report_cross,
    dup_pairs_tf,
    dup_report_tf,
    version_pairs_all,
    version_pairs_consecutive,
    within_version_pairs,
    leakage_pairs,
    train_duplicate_pairs,
    leakage_report,
    consecutive_report,
    overall_result,
    pair_totals,
    embeddings_wide_roundtrip,
    embeddings_versioned_roundtrip,
    stored_lookup,
    missing_tags,
    pv_train,
    pv_train_batches,
    pv_finetune,
    pv_infer,
    pv_sample,
    pv_cumulative,
]


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: train/test leakage at every version boundary."""
    return leakage_report(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    more = llm.QUERIES if llm else []
    return {q.__name__: q for q in [*_QUERIES, *more]}


def oracle_sql() -> dict[str, str]:
    pairs = f"""e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
      p AS (SELECT a.label AS la, b.label AS lb, a.vec_id AS file_a, b.vec_id AS file_b,
                   list_cosine_similarity(a.v, b.v) AS s
            FROM e a JOIN e b ON a.label < b.label OR (a.label = b.label AND a.vec_id < b.vec_id)
            WHERE list_cosine_similarity(a.v, b.v) >= {T})"""
    one = f"""e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
      p AS (SELECT a.vec_id AS file_a, b.vec_id AS file_b, list_cosine_similarity(a.v, b.v) AS s
            FROM e a JOIN e b ON a.vec_id < b.vec_id
            WHERE list_cosine_similarity(a.v, b.v) >= {T})"""
    two = f"""e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
      p AS (SELECT a.vec_id AS file_a, b.vec_id AS file_b, list_cosine_similarity(a.v, b.v) AS s
            FROM e a JOIN e b ON a.label < 5 AND b.label >= 5
            WHERE list_cosine_similarity(a.v, b.v) >= {T})"""
    bags = f"""{_DOCS},
      tf AS (SELECT tag, word, count(*) AS n FROM (SELECT tag, unnest(words) AS word FROM docs)
             GROUP BY tag, word),
      norm AS (SELECT tag, CAST(sum(n * n) AS DOUBLE) AS n2 FROM tf GROUP BY tag),
      dot AS (SELECT a.tag AS file_a, b.tag AS file_b, CAST(sum(a.n * b.n) AS DOUBLE) AS d
              FROM tf a JOIN tf b ON a.word = b.word AND a.tag < b.tag GROUP BY ALL),
      p AS (SELECT file_a, file_b, d / sqrt(x.n2 * y.n2) AS s FROM dot
            JOIN norm x ON x.tag = file_a JOIN norm y ON y.tag = file_b
            WHERE d / sqrt(x.n2 * y.n2) >= 0.99)"""
    sim = "round(s, 6) AS similarity"

    def report(total: str, threshold: float) -> str:
        return f"""SELECT {total} AS total_files, count(*) AS duplicate_pairs,
          count(*) FILTER (s >= 0.9999) AS exact_duplicate_pairs,
          (SELECT count(DISTINCT f) FROM (SELECT file_a AS f FROM p UNION ALL SELECT file_b FROM p))
            AS files_with_duplicates,
          round_even((SELECT count(DISTINCT f) FROM
            (SELECT file_a AS f FROM p UNION ALL SELECT file_b FROM p)) / {total} * 100, 2)
            AS percentage_files_with_duplicates,
          CAST({threshold} AS DOUBLE) AS threshold FROM p"""

    classes = f"""WITH g AS (SELECT min(vec_id) AS name, CAST(any_value(embedding) AS DOUBLE[]) AS v, count(*) AS n,
                         bit_or(CAST(1 AS BIGINT) << label) AS versions FROM embeddings GROUP BY embedding)"""
    boundary = f"""WITH {pairs},
      v AS (SELECT label, count(*) AS files FROM e GROUP BY label),
      b AS (SELECT v.label AS tr, w.label AS te, v.files AS fa, w.files AS fb
            FROM v JOIN v w ON w.label = v.label + 1),
      r AS (SELECT tr, te, fa + fb AS total_files, fb,
        (SELECT count(*) FROM p WHERE la = tr AND lb = te) AS duplicate_pairs,
        (SELECT count(*) FROM p WHERE la = tr AND lb = te AND s >= 0.9999) AS exact_duplicate_pairs,
        (SELECT count(DISTINCT f) FROM (SELECT la, lb, unnest([file_a, file_b]) AS f FROM p) q
          WHERE la = tr AND lb = te) AS files_with_duplicates,
        (SELECT CAST(sum(files) AS BIGINT) FROM v WHERE label <= tr) AS training_set_size,
        (SELECT count(*) FROM p WHERE lb <= tr) AS training_duplicate_pairs,
        (SELECT count(DISTINCT file_b) FROM p WHERE lb = te AND la < te) AS leaking,
        (SELECT count(*) FROM p WHERE lb = te AND la < te) AS leakage_pairs
        FROM b)"""
    consecutive = """CAST(tr AS VARCHAR) AS version_a, CAST(te AS VARCHAR) AS version_b,
        total_files, duplicate_pairs, exact_duplicate_pairs, files_with_duplicates,
        round_even(files_with_duplicates / total_files * 100, 2) AS percentage_files_with_duplicates,
        CAST(0.4 AS DOUBLE) AS threshold"""
    src_pos = "CAST(substr(source, 4) AS BIGINT)"
    repos = f"repos AS (SELECT DISTINCT source, {src_pos} AS repo_pos FROM documents)"
    batch_counts = f"""WITH {_DOCS}, tok AS (SELECT repo_pos AS batch, unnest(words) AS word FROM docs),
      per_batch AS (SELECT batch, word, count(*) AS n FROM tok GROUP BY ALL HAVING count(*) >= 3),
      firsts AS (SELECT word, CAST(sum(n) AS BIGINT) AS count, CAST(min(batch) AS BIGINT) AS first_batch
                 FROM per_batch GROUP BY word)"""
    vocabulary = f"""WITH {_DOCS},
      counts AS (SELECT word, count(*) AS count FROM (SELECT unnest(words) AS word FROM docs)
                 GROUP BY word HAVING count(*) >= 3),
      vocab AS (SELECT word, row_number() OVER (ORDER BY count DESC, word) - 1 AS word_id, count
                FROM counts)"""
    shape = f"WITH {_DOCS} SELECT tag, CAST(16 AS BIGINT) AS dims, true AS usable FROM docs"
    whole = f"WITH {_DOCS} SELECT tag, CAST(200 AS BIGINT) AS dims, true AS usable FROM docs"
    return (dict(llm.ORACLES) if llm else {}) | {
        "tokenize": f"""SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens,
            array_to_string(w, ' ') AS words FROM (SELECT doc_id, {_WORDS} AS w FROM documents)""",
        "decode_source": "SELECT doc_id, md5(text) AS digest FROM documents",
        "prepare_documents": f"""WITH {_DOCS} SELECT tag, CAST(len(words) AS BIGINT) AS n_tokens,
            array_to_string(words, ' ') AS words FROM docs""",
        "scan_by_extension": """SELECT source || '/' || doc_id || '.' || lang AS tag FROM documents
            WHERE lang IN ('fr', 'en', 'es')""",
        "source_dir_filter": """SELECT source || '/' || doc_id || '.' || lang AS path FROM documents
            WHERE source = 'src1'""",
        "dup_pairs_hashed": f"""WITH {one} SELECT count(*) AS exact_pairs, CAST(0 AS BIGINT) AS wrong_pairs,
            true AS recall_reached FROM p""",
        "group_links": f"""{classes} SELECT a.name AS file_a, b.name AS file_b,
            round(list_cosine_similarity(a.v, b.v), 6) AS similarity,
            a.versions AS versions_a, b.versions AS versions_b
            FROM g a JOIN g b ON a.name < b.name OR (a.name = b.name AND a.n > 1)
            WHERE list_cosine_similarity(a.v, b.v) >= {T}""",
        "group_members": """SELECT vec_id AS file, CAST(label AS BIGINT) AS ord,
            min(vec_id) OVER (PARTITION BY embedding) AS group_file FROM embeddings""",
        "files_per_version": f"""WITH {_DOCS} SELECT s.source AS version, count(docs.tag) AS files
            FROM (SELECT DISTINCT unnest([source, source || '.5']) AS source FROM documents) s
            LEFT JOIN docs ON docs.source = s.source GROUP BY s.source""",
        "total_documents": f"WITH {_DOCS} SELECT count(*) AS total_documents FROM docs",
        "version_tags": f"""SELECT source AS version, ord FROM
            (SELECT source, row_number() OVER (ORDER BY {src_pos}) - 1 AS ord
             FROM (SELECT DISTINCT source FROM documents WHERE source LIKE 'src1%')) WHERE ord < 8""",
        "versions_with_docs": f"""WITH {_DOCS} SELECT source AS version,
            row_number() OVER (ORDER BY {src_pos}) - 1 AS ord, files FROM
            (SELECT source, count(*) AS files FROM docs GROUP BY source)""",
        "repo_list": "SELECT url FROM pages",
        "repo_names": """SELECT page_id, replace(split_part(url, '/', -1), '.git', '') AS repo_name
            FROM pages""",
        "batch_assignment": f"""WITH {_DOCS}, n AS (SELECT tag, repo_pos // 3 AS batch,
            row_number() OVER (PARTITION BY repo_pos // 3 ORDER BY repo_pos, path) - 1 AS batch_pos
            FROM docs) SELECT tag, CAST(batch AS BIGINT) AS batch, batch_pos,
            CAST(batch_pos // 40 AS BIGINT) AS sub_batch FROM n""",
        "corpus_progress": f"""WITH {_DOCS}, {repos},
            per AS (SELECT r.repo_pos // 3 AS batch, count(docs.tag) AS documents,
                    count(DISTINCT r.source) AS repos
                    FROM repos r LEFT JOIN docs ON docs.source = r.source GROUP BY 1)
            SELECT batch, documents,
              CAST(sum(CASE WHEN documents > 0 THEN repos ELSE 0 END) OVER (ORDER BY batch) AS BIGINT)
                AS repos_processed,
              CAST(sum(documents) OVER (ORDER BY batch) AS BIGINT) AS documents_so_far FROM per""",
        "sample_documents": f"WITH {_DOCS} SELECT tag FROM docs ORDER BY repo_pos, path LIMIT 100",
        "sample_unique_repos": f"""WITH {_DOCS} SELECT count(DISTINCT split_part(tag, '/', 1))
            AS unique_repos FROM docs""",
        "vocab_build": f"{vocabulary} SELECT word, word_id, count FROM vocab",
        "vocab_growth": f"""{batch_counts},
            grown AS (SELECT b.batch, count(f.word) AS new_words
                      FROM (SELECT DISTINCT repo_pos AS batch FROM docs) b
                      LEFT JOIN firsts f ON f.first_batch = b.batch GROUP BY b.batch)
            SELECT CAST(batch AS BIGINT) AS batch, new_words,
              CAST(sum(new_words) OVER (ORDER BY batch) - new_words AS BIGINT) AS old_size,
              CAST(sum(new_words) OVER (ORDER BY batch) AS BIGINT) AS new_size FROM grown""",
        "vocab_incremental": f"{batch_counts} SELECT word, count, first_batch FROM firsts",
        "encode_documents": f"""{vocabulary},
            tok AS (SELECT tag, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM docs),
            ids AS (SELECT tag, i, word_id FROM tok JOIN vocab USING (word))
            SELECT docs.tag, count(word_id) AS n_ids,
              coalesce(string_agg(CAST(word_id AS VARCHAR), ' ' ORDER BY i), '') AS ids
            FROM docs LEFT JOIN ids ON ids.tag = docs.tag GROUP BY docs.tag""",
        "popular_items": """SELECT o_orderkey AS full_name, o_totalprice AS stargazers_count FROM orders
            WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 1000
              AND CAST(o_orderdate AS DATE) > DATE '2001-08-02' - 1825
            ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""",
        "popular_items_org": """SELECT o_orderkey AS full_name, o_totalprice AS stargazers_count
            FROM orders WHERE o_orderpriority = '2-HIGH' AND o_orderstatus = 'F'
            ORDER BY o_totalprice DESC, o_orderkey LIMIT 5000""",
        "dup_pairs": f"WITH {one} SELECT file_a, file_b, {sim} FROM p",
        "dup_pairs_nan": f"""WITH {one} SELECT file_a, file_b, {sim} FROM p
            WHERE file_a NOT IN (SELECT vec_id FROM embeddings WHERE label = 3)
              AND file_b NOT IN (SELECT vec_id FROM embeddings WHERE label = 3)""",
        "dup_pairs_cross": f"WITH {two} SELECT file_a, file_b, {sim} FROM p",
        "dup_top10": f"""WITH {one} SELECT file_a, file_b, {sim} FROM p
            ORDER BY s DESC, file_a, file_b LIMIT 10""",
        "files_in_duplicates": f"""WITH {one} SELECT DISTINCT f AS vec_id FROM
            (SELECT file_a AS f FROM p UNION ALL SELECT file_b FROM p)""",
        "dup_report": f"WITH {one} " + report("(SELECT count(*) FROM e)", T),
        "dup_report_cross": f"WITH {two} " + report("(SELECT count(*) FROM e)", T),
        "dup_pairs_tf": f"WITH {bags} SELECT file_a, file_b, {sim} FROM p",
        "dup_report_tf": f"WITH {bags} " + report("(SELECT count(*) FROM docs)", 0.99),
        "version_pairs_all": f"""WITH {pairs} SELECT CAST(la AS BIGINT) AS ord_a,
            CAST(lb AS BIGINT) AS ord_b, file_a, file_b, {sim} FROM p WHERE la < lb""",
        "version_pairs_consecutive": f"""WITH {pairs} SELECT CAST(la AS BIGINT) AS ord_a,
            CAST(lb AS BIGINT) AS ord_b, file_a, file_b, {sim} FROM p WHERE lb = la + 1""",
        "within_version_pairs": f"""WITH {pairs} SELECT CAST(la AS BIGINT) AS ord_a, file_a, file_b,
            {sim} FROM p WHERE la = lb""",
        "leakage_pairs": f"""WITH {pairs} SELECT CAST(lb AS BIGINT) AS pair, file_a, file_b, {sim}
            FROM p WHERE la < lb""",
        "train_duplicate_pairs": f"""WITH {pairs}, b AS (SELECT DISTINCT label AS tr FROM e
              WHERE label < (SELECT max(label) FROM e))
            SELECT CAST(tr + 1 AS BIGINT) AS pair, file_a, file_b, {sim} FROM p JOIN b ON lb <= tr""",
        "leakage_report": f"""{boundary} SELECT {consecutive}, training_set_size,
            training_duplicate_pairs, fb AS test_set_size, leaking AS test_entries_with_leakage,
            round_even(leaking / fb * 100, 2) AS test_leakage_percentage, leakage_pairs FROM r""",
        "consecutive_report": f"{boundary} SELECT {consecutive} FROM r",
        "overall_result": f"""{boundary} SELECT count(*) AS total_pairs_analyzed,
            CAST(sum(duplicate_pairs) AS BIGINT) AS total_duplicate_pairs FROM r""",
        "pair_totals": f"""WITH {pairs} SELECT count(*) FILTER (la = lb) AS within_pairs,
            count(*) FILTER (la < lb) AS cross_pairs FROM p""",
        "embeddings_wide_roundtrip": "SELECT vec_id AS file_path, "
        + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS dim_{i}" for i in range(64))
        + " FROM embeddings",
        "embeddings_versioned_roundtrip": """SELECT vec_id AS file_path, label || '.0' AS version,
            CAST(len(embedding) AS BIGINT) AS dims, CAST(embedding[1] AS DOUBLE) AS dim_0,
            CAST(embedding[64] AS DOUBLE) AS dim_63 FROM embeddings""",
        "stored_lookup": """SELECT o_orderkey AS tag, CAST(len(embedding) AS BIGINT) AS dims,
            round(CAST(embedding[1] AS DOUBLE), 6) AS dim_0
            FROM orders JOIN embeddings ON vec_id = o_orderkey""",
        "missing_tags": """SELECT o_orderkey AS tag FROM orders
            WHERE o_orderkey NOT IN (SELECT vec_id FROM embeddings)""",
        # training has no SQL form: these check that every document got a vector
        "pv_train": whole,
        "pv_train_batches": shape,
        "pv_finetune": shape,
        "pv_infer": f"SELECT *, true AS as_copy FROM ({whole})",
        "pv_sample": f"""WITH {_DOCS} SELECT tag, CAST(16 AS BIGINT) AS dims, true AS usable FROM docs
            ORDER BY repo_pos, path LIMIT 100""",
        "pv_cumulative": f"""WITH {_DOCS} SELECT lang || '/' || tag AS tag, CAST(16 AS BIGINT) AS dims,
            true AS usable FROM docs""",
    }

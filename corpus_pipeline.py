"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept.  All but the last
return the columns of ``docs``; columns beyond those of ``documents`` pass through.  Empty tables stay
empty, and repeated rows are judged alike until the near-duplicate stage keeps one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import bpe, langid, minhash, mixing, quality, simhash
from marlstone.llm.common import documents, materialize, maybe_broadcast, null_safe, settled

#: A text stays if its language's filter holds at least this share of its n-grams.
MIN_COVER = 0.3
#: Near copies share 0.8 of their shingles of so many words.
NEAR_WORDS = 5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the base rules or whose source's shrunk failure rate is too high.

    Null and blank texts fail; a null source is a host of its own.
    """
    return quality.judge(docs).filter("__q_kept").select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters, and those whose n-grams no learned language explains.

    The filter is learned from all rows with a text and a ``lang``; a document's own ``lang``, null or
    not, plays no part in its verdict.  If no row has a ``lang``, nothing can be learned and every
    document with letters stays.
    """
    model = langid.fit(docs)
    into = ("__l_pred", "__l_score", "__l_cover")
    told = langid.identify(docs, model, into=into)
    if not model.langs:
        return docs.filter(F.regexp_like(F.coalesce("text", F.lit("")), F.lit(r"\p{L}")))
    return told.filter((F.col("__l_pred") != "und") & (F.col("__l_cover") >= MIN_COVER)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component: the smallest id's, of its texts the one of the smallest key.

    Components are those of the SimHash fingerprints of three-word shingles, linked at three bits, joined by all texts that share 0.8 of
    their five-word shingles, found by MinHash bands and confirmed on whole sets.  Rows without an id take part, and stay only for
    components that have no other.  Of rows alike in id and text the one of the smallest hash of its other columns stays.
    """
    return settled(spark, lambda: _keepers(docs)).transform(lambda keepers: one_of_each(docs.withColumn("__d_key", simhash.text_key(F.col("text"))), keepers, ["doc_id", "__d_key"], "__d_rows", docs.columns).select(*docs.columns))


def _keepers(docs: DataFrame) -> DataFrame:
    """``doc_id, __d_key, __d_rows``: id, text key and number of the rows that stand for each component."""
    prints = simhash.near_components(docs)
    texts = minhash.linked(docs, words=NEAR_WORDS).filter("root is not null").select(F.col("text_key").alias("key"), F.xxhash64(F.lit("shingles"), "root").alias("v")).distinct()
    named = prints.withColumn("u", F.xxhash64(F.lit("bits"), "root"))
    roots = simhash.components(named.select("key", "u").distinct().join(texts, "key").select("u", "v").distinct())
    each = named.groupBy("u", "doc_id", "key").agg(F.count(F.lit(1)).alias("__d_rows"))
    joined = each.join(roots.withColumnRenamed("node", "u"), "u", "left").withColumn("root", F.coalesce("root", "u"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key", "__d_rows")).alias("f")
    return joined.groupBy("root").agg(first).select("f.doc_id", F.col("f.key").alias("__d_key"), "f.__d_rows")


def one_of_each(rows: DataFrame, wanted: DataFrame, key: list[str], times: str, columns: list[str]) -> DataFrame:
    """The row of each wanted ``key``, with the other columns of ``wanted``.

    Where ``times`` says that several rows have the key, the one of the smallest hash of the columns of ``documents``
    besides id and text; only these are gathered, and only if there are any.
    """
    single = null_safe(rows, wanted.filter(F.col(times) == 1).hint("merge"), key)  # the same plan at every size
    repeated = wanted.filter(F.col(times) > 1)
    n = repeated.count()
    if not n:
        return single.select(*columns, *[c for c in wanted.columns if c not in columns])
    more = [c for c in wanted.columns if c not in columns]
    others = F.xxhash64(*[F.col(c) for c in ("source", "lang", "n_chars") if c in columns], F.lit(0))
    found = null_safe(rows, maybe_broadcast(repeated, n), key)
    whole = F.struct(*[F.col(c) for c in [*columns, *more]])
    return single.select(*columns, *more).unionByName(found.groupBy(*key).agg(F.min_by(whole, others).alias("__row")).select("__row.*"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that each source's words come near its target.

    Rows alike in id, source and text are told apart by nothing, so one of them stands for all their copies.
    """
    key = ["doc_id", "source", "__m_key"]
    marked = docs.withColumn("__m_key", simhash.text_key(F.col("text")))
    copies = mixing.mix(mixing.word_sizes(marked, carry=["__m_key"])).groupBy(*key).agg(F.sum("copies").alias("__m_copies"), F.count(F.lit(1)).alias("__m_rows"))
    joined = one_of_each(marked, materialize(copies.filter("__m_copies > 0")), key, "__m_rows", docs.columns)
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("__m_copies")))
    return joined.withColumn("__m_copy", times).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row's ids and of their decoding."""
    import public_tokenizers

    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode),
]

#: Rank-queue merges, fingerprint components and learned filters are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written to the shared folder."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs

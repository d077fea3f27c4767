"""The thin ``opN_<name>`` queries over ``documents`` and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import binout, bpe, langid, merkle, minhash, mixing, negatives, ngram, quality, sharding, simhash, sketch, tokencount
from marlstone.llm.common import documents, id_crc


def op1_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


def op3_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(mixing.word_sizes(documents(spark, sf_dir)))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(documents(spark, sf_dir).select("doc_id", "source", "text"), carry=["doc_id"])
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select("doc_id", *[F.col(f"__q_{c}").alias(c) for c in names])


def op10_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_components(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _vocabulary(name: str) -> str:
    """Where the public vocabulary files lie; the same place on every worker."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.compare_edited(documents(spark, sf_dir))


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = F.pmod(id_crc(F.col("doc_id")), F.lit(5)) == 1
    model = ngram.count(docs.filter(~held_out))
    return ngram.score(docs, model).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op5_bitmask_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = F.pmod(id_crc(F.col("doc_id")), F.lit(4)) == 2
    model = langid.fit(docs.filter(~held_out))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_pfor_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binout.encode_documents(documents(spark, sf_dir), _vocabulary("word_bpe_49k.json"), 2)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(documents(spark, sf_dir), _vocabulary("piece_bpe_32k.model"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(documents(spark, sf_dir), _vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.check_documents(documents(spark, sf_dir))


def op12_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_components(documents(spark, sf_dir))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(negatives.usable(vectors, label), F.col("id") % 100 == 0)


QUERIES = {
    "op4_kneser_ney": op4_kneser_ney,
    "op2_scaled_sketch": op2_scaled_sketch,
    "op5_bitmask_langid": op5_bitmask_langid,
    "op6_pfor_tokens": op6_pfor_tokens,
    "op7_token_counts": op7_token_counts,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_simhash_components": op10_simhash_components,
    "op1_lpt_sharding": op1_lpt_sharding,
    "op3_systematic_mix": op3_systematic_mix,
    "op8_host_rules": op8_host_rules,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_minhash_components": op12_minhash_components,
    "op13_hard_negatives": op13_hard_negatives,
}

_WORD = r"'[^\x20\x09-\x0D]+'"

ORACLE_SQL = {
    "op3_systematic_mix": rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_WORD})) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([1, 2, 3])[1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3]::BIGINT AS weight FROM s),
r AS (SELECT *, 3 * source_size AS cap, 3 * source_size / weight AS ratio FROM w),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER p, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0)) AS level
      FROM r WINDOW p AS (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap::DOUBLE, (SELECT max(level) FROM l) * weight) AS target,
             ('0x' || substr(md5('mix-1:' || coalesce(source, '') || ':' || CASE WHEN source IS NULL THEN 'true' ELSE 'false' END), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS start FROM l),
k AS (SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY size DESC, doc_id DESC NULLS FIRST) - 1 AS pos FROM d),
f AS (SELECT source, 0::BIGINT AS pos, target AS to_take, source_size::DOUBLE AS rest, start AS phase, 0::BIGINT AS copies FROM t
      UNION ALL
      SELECT source, pos + 1, to_take - floor(up) * size, rest - size, up - floor(up), floor(up)::BIGINT
      FROM (SELECT f.source, f.pos, f.to_take, f.rest, k.size, f.phase + CASE WHEN f.rest > 0 THEN least(greatest(f.to_take / f.rest, 0.0::DOUBLE), 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS up
            FROM f JOIN k ON k.source IS NOT DISTINCT FROM f.source AND k.pos = f.pos WHERE f.pos < 256)),
e AS (SELECT source, phase, CASE WHEN rest > 0 THEN least(greatest(to_take / rest, 0.0::DOUBLE), 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS each_copy FROM f WHERE pos = 256),
c AS (SELECT k.*, CASE WHEN k.pos < 256 THEN f.copies ELSE least(floor(e.phase + each_copy * (k.pos - 255)) - floor(e.phase + each_copy * (k.pos - 256)), 3) END AS copies
      FROM k LEFT JOIN f ON k.pos < 256 AND f.pos = k.pos + 1 AND k.source IS NOT DISTINCT FROM f.source LEFT JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source""",
    "op8_host_rules": rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM i),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM g, (VALUES (0), (1), (2)) v(k) WHERE n >= 2 GROUP BY doc_id),
x AS (SELECT d.doc_id, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(list_filter(string_split(t, chr(10)), lambda y: regexp_matches(y, {_WORD}))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda y: regexp_matches(y, {_WORD})))))::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM x),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS k FROM f GROUP BY source),
m AS (SELECT sum(k) / sum(n) AS mean, sum(k * k / n) / sum(n) - (sum(k) / sum(n)) ** 2 - (sum(k) / sum(n)) * (1 - sum(k) / sum(n)) * count(*) / sum(n) AS spread FROM h),
b AS (SELECT mean, CASE WHEN spread > 0 THEN least(greatest(mean * (1 - mean) / spread - 1, 1.0), 10000.0) ELSE 10000.0 END AS strength FROM m),
v AS (SELECT source, n + strength AS seen, (k + mean * strength) / (n + strength) AS rate, 3.0 * mean / (1 - mean + 3.0 * mean) AS most FROM h, b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate - 1.645 * sqrt(rate * (1 - rate) / (seen + 1)) <= most AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source""",
    "op11_merkle_manifest": """
WITH RECURSIVE f AS (SELECT lang, doc_id, n_chars IS NOT NULL AND xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
           lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) % 7 = 0 AS odd, n_chars,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head, coalesce(strlen(text) || ':' || text, '-') AS tail FROM documents),
l AS (SELECT lang, doc_id, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
             CASE WHEN odd THEN sha256(head || strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) || tail) END AS found FROM f),
i AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM l),
up AS (SELECT g, 0 AS level, idx, n, leaf AS h FROM i
       UNION ALL SELECT g, level + 1, idx // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM up WHERE n > 1 GROUP BY g, level, idx // 2),
tops AS (SELECT g, h AS subroot, (SELECT count(DISTINCT g) FROM i) AS n FROM up WHERE n = 1),
roots AS (SELECT 0 AS level, g AS idx, n, subroot AS h FROM tops
          UNION ALL SELECT level + 1, idx // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM roots WHERE n > 1 GROUP BY level, idx // 2),
nodes AS (SELECT g, level, idx, n, h FROM up UNION ALL SELECT -1, level, idx, n, h FROM roots),
steps AS (SELECT g, level, idx, n = 1 AS top, coalesce(lag(h) OVER w, '') AS before, coalesce(lead(h) OVER w, '') AS after FROM nodes WINDOW w AS (PARTITION BY g, level, idx // 2 ORDER BY idx)),
walk AS (SELECT g AS tree, idx AS row, g, 0 AS level, idx, '' AS proof, coalesce(found, leaf) AS h FROM i
         UNION ALL
         SELECT tree, row, CASE WHEN top THEN -1 ELSE w.g END, CASE WHEN top THEN 0 ELSE w.level + 1 END, CASE WHEN top THEN w.g ELSE w.idx // 2 END,
                CASE WHEN top THEN proof ELSE proof || before || after END, CASE WHEN top THEN w.h ELSE sha256(before || w.h || after) END
         FROM walk w JOIN steps s ON s.g = w.g AND s.level = w.level AND s.idx = w.idx WHERE NOT (w.g = -1 AND top)),
ends AS (SELECT w.* FROM walk w JOIN steps s ON w.g = -1 AND s.g = -1 AND s.top AND s.level = w.level)
SELECT i.doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, e.h AS folded_root, e.h = r.h AS verified
FROM i JOIN tops USING (g) JOIN ends e ON e.tree = i.g AND e.row = i.idx, (SELECT h FROM roots WHERE n = 1) r""",
    "op12_minhash_components": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORD}) AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) END AS s FROM d),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS u, doc_id AS v FROM d UNION SELECT r.u, q.v FROM r JOIN (SELECT u, v FROM p UNION ALL SELECT v, u FROM p) q ON r.v = q.u),
c AS (SELECT u AS doc_id, min(v) AS component_id FROM r GROUP BY u)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)""",
    "op13_hard_negatives": """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT q.vec_id AS anchor_id, c.vec_id AS id, q.label = c.label AS same, list_dot_product(q.v, c.v)::BIGINT AS score FROM e q, e c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM a WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT anchor_id, positive_id, positive_score, id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank
      FROM p JOIN a USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
}

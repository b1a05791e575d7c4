"""One query for each operator, over its whole table, with the columns of its contract."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.llm import langid, minhash, mixing, oracles, packing, pii, quality, secrets, sharding, topk, urls
from quarrylight.llm.common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_shards(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"))


def op2_minhash(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_urls(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op4_packing(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_pii(spark, sf_dir):
    return pii.scan(table(spark, sf_dir, "documents"))


def op6_secrets(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"))


def op7_topk(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op8_language(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_mixing(spark, sf_dir):
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_quality(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents")).drop("n_common_words")


# The parts of results that SQL can say where it can't say the whole.


def shard_sizes(spark, sf_dir):
    return op1_shards(spark, sf_dir).select("doc_id", "size", "law", "grown_shard")


def url_rules(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("ruled"))


def personal_base(spark, sf_dir):
    return op5_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def secret_base(spark, sf_dir):
    return op6_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


OPERATORS = (op1_shards, op2_minhash, op3_urls, op4_packing, op5_pii, op6_secrets, op7_topk, op8_language, op9_mixing, op10_quality)
PARTS = (shard_sizes, url_rules, personal_base, secret_base)


def queries():
    return {f.__name__: f for f in (*OPERATORS, *PARTS)}


#: DuckDB SQL of the exact search over all vectors.
TOPK_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as x from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0)
select q.vec_id as query_id, row_number() over (partition by q.vec_id order by list_inner_product(q.x, c.x) desc, c.vec_id)::int as rank,
       c.vec_id, list_inner_product(q.x, c.x)::bigint as score
from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.x) = len(c.x)
qualify rank <= 5
"""


def oracle_sql():
    whole = {"op2_minhash": oracles.NEAR_DUPLICATES, "op7_topk": TOPK_SQL, "op9_mixing": mixing.SQL, "op10_quality": oracles.QUALITY}
    return whole | {"shard_sizes": oracles.SHARD_SIZES, "url_rules": oracles.URL_RULES, "personal_base": oracles.PERSONAL_BASE, "secret_base": oracles.SECRET_BASE}

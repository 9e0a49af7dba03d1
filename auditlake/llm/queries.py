"""The operators' queries on the driver's tables, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm import audit, bpe, fim, forest, html, katz, lengths, licences, minhash, mixing, quality, rotation, toxicity
from auditlake.llm.stages import stage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def codec(spark: SparkSession) -> bpe.Codec:
    import public_tokenizers

    return bpe.Codec(spark, bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), minhash.Settings(width=2))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted_pages(_table(spark, sf_dir, "pages"))


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents"))


def op4_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.scored(_table(spark, sf_dir, "documents"))


def op6_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotation.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.decisions(_table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return toxicity.scored_documents(_table(spark, sf_dir, "documents"), labels)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), codec(spark))


def op10_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _table(spark, sf_dir, "documents").select(codec(spark).lengths("text").alias("n_tokens"))
    return lengths.suffix_sums(stage(lengths.histogram(n), "histogram"))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(_table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality.scored_documents(_table(spark, sf_dir, "documents"), labels)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    found = [op1_minhash, op2_html, op3_licences, op4_forest, op5_katz, op6_rotation, op7_mixing, op8_toxicity, op9_byte_bpe, op10_lengths, op11_fim, op12_filter_audit, op13_quality]
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


_OP1_SQL = """
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
sets as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) = 1 then w else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as s from words),
items as (select doc_id, len(s) as n, unnest(s) as item from sets),
links as (
  select a.doc_id as a, b.doc_id as b from items a join items b on a.item = b.item and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach as (select doc_id as a, doc_id as b from sets union select r.a, l.b from reach r join links l on r.b = l.a)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, min(r.b) as component_id, s.doc_id = min(r.b) as kept
from sets s join reach r on r.a = s.doc_id group by s.doc_id, len(s.s)"""

_OP6_SQL = """
with recursive v as (
  select vec_id, label, cast(embedding as double[]) as e from embeddings
  where label is not null and embedding is not null and list_dot_product(cast(embedding as double[]), cast(embedding as double[])) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  where list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.98),
reach as (select vec_id as a, vec_id as b from embeddings union select r.a, l.b from reach r join links l on r.b = l.a),
n as (select a, count(*) as n from links group by a)
select e.vec_id, cast(coalesce(max(n.n), 0) as bigint) as n_links, min(r.b) as component_id, e.vec_id = min(r.b) as kept
from embeddings e join reach r on r.a = e.vec_id left join n on n.a = e.vec_id group by e.vec_id"""


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash": _OP1_SQL, "op3_licences": licences.scan_sql(), "op6_rotation": _OP6_SQL, "op11_fim": fim.digests_sql(), "op12_filter_audit": audit.interactions_sql()}

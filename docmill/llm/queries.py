"""One registered query per operator, over its whole tables, and its check SQL where SQL can
express it."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from docmill.llm import (
    op1_sharding,
    op2_lines,
    op3_topk,
    op4_units,
    op5_blocks,
    op6_language,
    op7_hmm,
    op8_decontaminate,
    op9_minhash,
    op10_sentencepiece,
    op11_negatives,
    op12_clusters,
    op13_packing,
)
from docmill.llm.common import crc_remainder, read_table, ship_package


def vocabulary() -> str:
    """Default place of the public vocabulary file; every operator takes it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def byte_tokenizer() -> str:
    """Default place of the public tokenizer for packing."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def sharding_query(spark: SparkSession, root: str) -> DataFrame:
    return op1_sharding.shard(read_table(spark, root, "documents"), 8)


def lines_query(spark: SparkSession, root: str) -> DataFrame:
    """Every deleted run of lines or words, with its place and the place of the copy that stays."""
    return op2_lines.repeated_runs(read_table(spark, root, "documents"))


def topk_query(spark: SparkSession, root: str) -> DataFrame:
    vectors = read_table(spark, root, "embeddings")
    return op3_topk.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), 10)


def units_query(spark: SparkSession, root: str) -> DataFrame:
    """Every removed unit or run of words, with its original offsets and the occurrence that stays."""
    return op4_units.repeated_text(read_table(spark, root, "documents"))


def blocks_query(spark: SparkSession, root: str) -> DataFrame:
    pages = read_table(spark, root, "pages")
    return op5_blocks.extract(pages, op5_blocks.train(pages))


def language_model(docs: DataFrame) -> op6_language.Model:
    """Model from the rows that are not held out."""
    return op6_language.train(docs.where(crc_remainder("doc_id", 4) != 2))


def language_query(spark: SparkSession, root: str) -> DataFrame:
    docs = read_table(spark, root, "documents")
    found = op6_language.identify(docs, language_model(docs), passed=["doc_id"])
    return found.select(
        "doc_id", (crc_remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected"
    )


def hmm_query(spark: SparkSession, root: str) -> DataFrame:
    return op7_hmm.score(read_table(spark, root, "documents"), crc_remainder("doc_id", 10) == 0)


def decontaminate_query(spark: SparkSession, root: str) -> DataFrame:
    """Every region of a document that matches a benchmark item."""
    return op8_decontaminate.contaminated(
        read_table(spark, root, "documents"), read_table(spark, root, "benchmark")
    )


def minhash_query(spark: SparkSession, root: str) -> DataFrame:
    return op9_minhash.near_duplicates(read_table(spark, root, "documents"))


def sentencepiece_query(spark: SparkSession, root: str) -> DataFrame:
    return op10_sentencepiece.encode_digests(read_table(spark, root, "documents"), vocabulary())


def negatives_query(spark: SparkSession, root: str) -> DataFrame:
    vectors = read_table(spark, root, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return op11_negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0, label=label)


def clusters_query(spark: SparkSession, root: str) -> DataFrame:
    found = op12_clusters.cluster(read_table(spark, root, "embeddings"), k=40, rounds=5, length=64)
    return found.withColumn("centroid_sha256", op12_clusters.centroid_digest(F.col("centroid"))).drop("centroid")


def packing_query(spark: SparkSession, root: str) -> DataFrame:
    packed = op13_packing.pack_documents(read_table(spark, root, "documents"), byte_tokenizer())
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


QUERIES = {
    "op1_sharding": sharding_query,
    "op2_lines": lines_query,
    "op3_topk": topk_query,
    "op4_units": units_query,
    "op5_blocks": blocks_query,
    "op6_language": language_query,
    "op7_hmm": hmm_query,
    "op8_decontaminate": decontaminate_query,
    "op9_minhash": minhash_query,
    "op10_sentencepiece": sentencepiece_query,
    "op11_negatives": negatives_query,
    "op12_clusters": clusters_query,
    "op13_packing": packing_query,
}
TOPK_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id and len(c.v) = len(q.v)),
r as (
  select query_id, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank,
    vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""

MINHASH_SQL = r"""
with recursive
w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as shingle from w),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (
  select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id
  group by all),
e as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 75 * (x.n + y.n - k)),
g as (select a, b from e union all select b, a from e),
r as (select a as doc_id, a as m from g union select r.doc_id, g.b from r join g on g.a = r.m),
m as (select doc_id, min(m) as m from r group by doc_id)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(m.m, d.doc_id) as component_id,
  coalesce(m.m, d.doc_id) = d.doc_id as kept
from documents d left join n using (doc_id) left join m using (doc_id)
"""

NEGATIVES_SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as anchor_id, c.vec_id, c.label = q.label as same, list_inner_product(q.v, c.v)::bigint as score
  from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id and len(c.v) = len(q.v)),
p as (
  select anchor_id, vec_id as positive_id, score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id,
  row_number() over (partition by anchor_id, positive_id order by s.score desc, s.vec_id)::integer as rank,
  s.vec_id as negative_id, p.score as positive_score, s.score as negative_score
from p join s using (anchor_id)
where not same and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score
qualify rank <= 10
"""


def clusters_sql(k: int = 40, rounds: int = 5, length: int = 64, seed: str = "2") -> str:
    """Plain rounds, every vector against every centroid."""
    steps = [f"""
v as (
  select row_number() over () as row, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings where len(embedding) = {length}
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as (
  select row_number() over (order by sha256('{seed}:' || coalesce(vec_id::varchar, '')), v) - 1 as c, v as m from v
  qualify c < {k})"""]
    for at in range(rounds + 1):
        steps.append(f"""
d{at} as (
  select row, c, list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d
  from v cross join c{at}),
a{at} as (select row, c, d from d{at} qualify row_number() over (partition by row order by d, c) = 1)""")
        if at < rounds:
            sums = ", ".join(f"sum(v[{i}])" for i in range(1, length + 1))
            steps.append(f"""
s{at} as (select c, count(*) as n, [{sums}] as s from a{at} join v using (row) group by c),
c{at + 1} as (
  select c, case when n is null then m else list_transform(s, lambda x: ((x - ((x % n) + n) % n) / n)::bigint) end as m
  from c{at} left join s{at} using (c))""")
    return f"""
with {",".join(steps)},
i as (select c, sum(d)::bigint as cluster_inertia from a{rounds} group by c)
select vec_id, c::integer as cluster, d as distance, cluster_inertia,
  (select sum(d)::bigint from a{rounds}) as inertia, sha256(array_to_string(m, ',')) as centroid_sha256
from a{rounds} join v using (row) join c{rounds} using (c) join i using (c)
"""


ORACLES: dict[str, str] = {
    "op3_topk": TOPK_SQL, "op9_minhash": MINHASH_SQL, "op11_negatives": NEGATIVES_SQL, "op12_clusters": clusters_sql(),
}


def _shipped(query):
    @wraps(query)
    def run(spark, root):
        return query(ship_package(spark), root)

    return run


def all_queries() -> dict:
    return {name: _shipped(query) for name, query in QUERIES.items()}

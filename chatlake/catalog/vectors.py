"""Chunks, vector tables, similarity search and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.catalog.registry import query
from chatlake.operators import density, vectors
from chatlake.sources.adapters import Tables


@query(
    "D01_token_chunks",
    """
    with w as (select doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') as ws from documents),
    c as (select doc_id, ws, unnest(range(0, case when len(ws) <= 512 then 1 else cast(ceil((len(ws) - 512) / 462.0) as bigint) + 1 end)) as i from w where len(ws) > 0)
    select doc_id, concat(doc_id, '_chunk_', i) as chunk_id, cast(i as int) as chunk_no, cast(len(ws[i * 462 + 1 : i * 462 + 512]) as int) as n_tokens,
           md5(array_to_string(ws[i * 462 + 1 : i * 462 + 512], ' ')) as digest
    from c
    """,
)
def token_chunks(t: Tables) -> DataFrame:
    pieces = vectors.token_chunks(t.table("documents"), "doc_id", "text")
    return pieces.select("doc_id", "chunk_id", "chunk_no", "n_tokens", F.md5("chunk").alias("digest"))


@query(
    "D02_current_vectors",
    "select vec_id, case when vec_id % 3 = 0 then 2 else 1 end as log_no, "
    "round(cast(embedding[1] as double) * case when vec_id % 3 = 0 then -1 else 1 end, 6) + 0.0 as first from embeddings",
)
def current_vectors(t: Tables) -> DataFrame:
    first = t.table("embeddings").select("vec_id", "embedding", F.lit(1).alias("log_no"))
    turned = F.transform("embedding", lambda x: -x).alias("embedding")
    again = first.filter("vec_id % 3 = 0").select("vec_id", turned, F.lit(2).alias("log_no"))
    rows = vectors.current_vectors(first.unionByName(again), "vec_id")
    value = F.round(F.get("embedding", F.lit(0)).cast("double"), 6) + F.lit(0.0)
    return rows.select("vec_id", "log_no", value.alias("first"))


def _cosine_sql(same: str) -> str:
    exact = "list_cosine_similarity(list_transform(v.embedding, lambda x: cast(x as double)), list_transform(q.embedding, lambda x: cast(x as double)))"
    return f"""
    with s as (select q.vec_id as query, v.vec_id, {exact} as exact from embeddings q join embeddings v on v.vec_id <> q.vec_id{same} where q.vec_id % 20 = 0),
    r as (select *, row_number() over (partition by query order by round(exact, 9) desc, vec_id) as rank from s)
    select query, cast(rank as int) as rank, vec_id, round(exact, 6) + 0.0 as similarity from r where rank <= 25
    """


def _cosine_top(t: Tables, within: list[str]) -> DataFrame:
    found = vectors.nearest_to_all(t.table("embeddings"), F.col("vec_id") % 20 == 0, 25, key="vec_id", within=within)
    return found.select("query", "rank", "vec_id", (F.round("similarity", 6) + F.lit(0.0)).alias("similarity"))


@query("D03_cosine_top", _cosine_sql(""))
def cosine_top(t: Tables) -> DataFrame:
    """The rows most like each of the queries, among all rows."""
    return _cosine_top(t, [])


@query("D03_cosine_top_within", _cosine_sql(" and v.label = q.label"))
def cosine_top_within(t: Tables) -> DataFrame:
    """The same among rows with the query's label."""
    return _cosine_top(t, ["label"])


@query("D04_clusters")
def clusters(t: Tables) -> DataFrame:
    found = vectors.clusters(t.table("embeddings"), 10, key="vec_id")
    return vectors.representatives(found, "vec_id")


@query("D04_density_clusters")
def density_clusters(t: Tables) -> DataFrame:
    """Each row with its cluster by density, if it is in one."""
    return density.density_clusters(t.table("embeddings"), key="vec_id").select("vec_id", "cluster", F.round("distance", 6).alias("distance"))

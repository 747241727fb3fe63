"""DuckDB SQL for the rows of those corpus queries that SQL can express."""

OP10 = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) v
  from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0
), s as (
  select q.vec_id query_id, c.vec_id vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint score
  from v q join v c on c.vec_id <> q.vec_id
  where q.vec_id % 100 = 0
), r as (
  select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int rank, vec_id, score from s
)
select query_id, rank, vec_id, score from r where rank <= 10
"""

SQL: dict[str, str] = {"op10_nra_topk": OP10}

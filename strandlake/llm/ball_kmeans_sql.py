"""The clustering as one SQL query: every round written out, every vector compared with every centroid."""


def clustering_sql(k: int = 40, rounds: int = 5, seed: int = 2, width: int = 64) -> str:
    steps = [
        f"""with e as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings where len(embedding) = {width} and list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))))""",
        "x as materialized (select r, unnest(v) as x, generate_subscripts(v, 1) as i from e)",
        f"f as (select row_number() over (order by sha256('{seed}:' || coalesce(vec_id::varchar, '')), v) - 1 as c, v from e qualify c < {k})",
        "c0 as materialized (select c, unnest(v) as y, generate_subscripts(v, 1) as i from f)",
    ]
    for n in range(rounds + 1):
        steps.append(f"d{n} as (select r, c, sum((x - y) * (x - y))::bigint as d from x join c{n} on x.i = c{n}.i group by r, c)")
        steps.append(f"a{n} as materialized (select r, min({{'d': d, 'c': c}}) as m from d{n} group by r)")
        if n < rounds:
            steps.append(f"s{n} as (select m.c as c, i, sum(x)::bigint as s, count(*) as n from a{n} join x using (r) group by all)")
            steps.append(f"c{n + 1} as materialized (select o.c, o.i, coalesce((s - ((s % n + n) % n)) // n, y)::bigint as y from c{n} o left join s{n} on o.c = s{n}.c and o.i = s{n}.i)")
    end = f"h as (select c, sha256(string_agg(y::varchar, ',' order by i)) as centroid_sha256 from c{rounds} group by c)"
    return ",\n".join([*steps, end]) + f"""
select vec_id, m.c::int as cluster, m.d as distance, sum(m.d) over (partition by m.c)::bigint as cluster_inertia, sum(m.d) over ()::bigint as inertia, centroid_sha256 from a{rounds} join e using (r) join h on h.c = m.c"""


SQL = clustering_sql()

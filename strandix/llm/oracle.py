"""DuckDB SQL for the operators whose results SQL can express."""

from __future__ import annotations

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ngram_components(n: int = 3, percent: int = 90) -> str:
    """Links by counting common n-grams of every pair that has one, then closure; ids are distinct."""
    return (
        "with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), "
        f"'{_UPPER}', '{_UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') w from documents), "
        f"grams as (select distinct doc_id, case when len(w) < {n} then array_to_string(w, ' ') else array_to_string(w[i:i + {n - 1}], ' ') end g "
        f"from words, unnest(range(1, greatest(1, len(w) - {n - 1}) + 1)) t(i) where len(w) > 0), "
        "sizes as materialized (select doc_id, count(*) n, md5(string_agg(g, chr(10) order by g)) own from grams group by doc_id), "
        "pairs as (select a.doc_id x, b.doc_id y, count(*) common from grams a join grams b on a.g = b.g and a.doc_id <> b.doc_id group by all), "
        f"links as materialized (select x, y from pairs join sizes s on s.doc_id = x join sizes t on t.doc_id = y where 100 * common >= {percent} * (s.n + t.n - common)), "
        "reach(a, b) as (select doc_id, doc_id from documents union select r.a, l.y from reach r join links l on l.x = r.b), "
        "least as (select a, min(b) b from reach group by a), counts as (select x, count(*) n from links group by x), classes as (select own, min(doc_id) c from sizes group by own) "
        "select d.doc_id, cast(coalesce(s.n, 0) as bigint) n_shingles, l.b component_id, coalesce(c.c, d.doc_id) class_id, cast(coalesce(k.n, 0) as bigint) n_links "
        "from documents d left join sizes s using (doc_id) left join classes c using (own) left join least l on l.a = d.doc_id left join counts k on k.x = d.doc_id"
    )


def top_inner_products(every: int = 20, k: int = 20, scale: int = 64) -> str:
    """All pairs of a query and a candidate; ids are distinct."""
    return (
        f"with v as (select vec_id, [floor({scale} * cast(x as double)) for x in embedding] e from embeddings where vec_id is not null and len(embedding) > 0 and len([x for x in embedding if x is null or not isfinite(x)]) = 0), "
        f"s as (select q.vec_id query_id, v.vec_id, cast(list_dot_product(q.e, v.e) as bigint) score from v q join v on v.vec_id <> q.vec_id and len(v.e) = len(q.e) where q.vec_id % {every} = 0) "
        f"select query_id, cast(rank as integer) rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s) where rank <= {k}"
    )

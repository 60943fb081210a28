"""DuckDB SQL for the registered queries, put together from shared parts."""

from __future__ import annotations

from ..operators.minimizers import MULTIPLIER
from .inputs import STRETCHES

DNA = "translate(regexp_replace(lower(text), '[^a-z0-9]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz0123456789', '" + "ACGT" * 6 + "AC" + "N" * 10 + "')"
RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"


def rc(x: str) -> str:
    return RC.format(x)


def pieces(k: int, table: str = "documents", key: str = "doc_id") -> str:
    """CTE of index sequences: the stretches without N."""
    return (
        f"dna_rows as (select {key} id, string_split({DNA}, 'N') parts from {table} where text is not null), "
        f"pieces as (select id * {STRETCHES} + i - 1 sid, parts[i] seq from dna_rows, unnest(range(1, len(parts) + 1)) t(i) where length(parts[i]) >= {k})"
    )


def dictionary(k: int, table: str = "documents", key: str = "doc_id") -> str:
    """CTEs up to ``kmers`` and ``strings``, as defined by first occurrences and their islands."""
    return (
        pieces(k, table, key)
        + f", windows as (select sid, p pos, substr(seq, cast(p + 1 as bigint), {k}) kmer from pieces, unnest(range(0, length(seq) - {k} + 1)) t(p)), "
        f"firsts as (select min({{'sid': sid, 'pos': pos}}) f, count(*) weight from windows group by least(kmer, {rc('kmer')})), "
        "placed as (select f.sid sid, f.pos pos, weight from firsts), "
        "ranked as (select *, row_number() over (order by sid, pos) - 1 kmer_id, case when lag(pos) over (partition by sid order by pos) = pos - 1 then 0 else 1 end fresh from placed), "
        "named as (select *, sum(fresh) over (order by sid, pos rows unbounded preceding) - 1 string_id from ranked), "
        f"kmers as materialized (select cast(kmer_id as bigint) kmer_id, cast(string_id as bigint) string_id, cast(kmer_id - min(kmer_id) over (partition by string_id) as bigint) kmer_id_in_string, "
        f"cast(kmer_id + string_id * {k - 1} as bigint) kmer_offset, count(*) over (partition by string_id) string_kmers, substr(seq, cast(pos + 1 as bigint), {k}) kmer, sid, pos, weight from named join pieces using (sid)), "
        f"strings as materialized (select string_id, any_value(string_kmers) num_kmers, min(kmer_id) first_kmer_id, min(kmer_offset) string_begin, min(kmer_offset) + any_value(string_kmers) + {k - 1} string_end, "
        f"substr(arg_min(p.seq, k.kmer_id), cast(min(k.pos) + 1 as bigint), any_value(string_kmers) + {k - 1}) seq from kmers k join pieces p using (sid) group by string_id)"
    )


def lookup(queries: str, k: int, canonical: bool = False, column: str = "kmer", check_rc: bool = True) -> str:
    """Select of ``queries`` with their lookup results, left unmatched where not found."""
    pal = -1 if canonical else 1
    both = f"case when q.{column} = {rc('q.' + column)} then {pal} when d.kmer = q.{column} then 1 else -1 end"
    on = f"least(d.kmer, {rc('d.kmer')}) = least(q.{column}, {rc('q.' + column)})"
    if not check_rc:
        on = f"d.kmer = q.{column}"
    return (
        f"select q.*, d.kmer_id, d.kmer_id_in_string, d.kmer_offset, case when d.kmer_id is not null then {both} end kmer_orientation, d.string_id, "
        f"d.kmer_offset - d.kmer_id_in_string string_begin, d.kmer_offset - d.kmer_id_in_string + d.string_kmers + {k - 1} string_end from {queries} q left join kmers d on {on}"
    )


def reads(k: int, table: str, key: str, flip: bool) -> str:
    """CTEs of reads, their windows, and which are valid."""
    seq = f"case when {key} % 2 = 1 then {rc(DNA)} else {DNA} end" if flip else DNA
    return (
        f"reads as (select cast({key} as bigint) read_id, {seq} seq from {table}), "
        f"read_windows as (select read_id, p pos, substr(seq, cast(p + 1 as bigint), {k}) kmer from reads, unnest(range(0, length(seq) - {k} + 1)) t(p))"
    )


def report(k: int, per_read: bool = True) -> str:
    """Select of the counters from ``reads``, ``read_windows`` and ``kmers``."""
    inner = (
        f"hits as ({lookup('read_windows', k)}), "
        "marked as (select *, coalesce(lag(string_id) over w = string_id and lag(kmer_id) over w + lag(kmer_orientation) over w = kmer_id, false) extended, contains(kmer, 'N') invalid from hits window w as (partition by read_id order by pos)), "
        "counted as (select read_id, count(*) n, count_if(kmer_id is not null) p, count_if(invalid) i, count_if(extended) e from marked group by read_id), "
        "report as (select r.read_id, coalesce(n, 0) num_kmers, cast(coalesce(p, 0) as bigint) num_positive_kmers, cast(coalesce(n - p - i, 0) as bigint) num_negative_kmers, cast(coalesce(i, 0) as bigint) num_invalid_kmers, cast(coalesce(p - e, 0) as bigint) num_searches, cast(coalesce(e, 0) as bigint) num_extensions from reads r left join counted using (read_id))"
    )
    names = ("num_kmers", "num_positive_kmers", "num_negative_kmers", "num_invalid_kmers", "num_searches", "num_extensions")
    tail = "select * from report" if per_read else "select " + ", ".join(f"cast(sum({c}) as bigint) {c}" for c in names) + " from report"
    return inner, tail


def packed(x: str, m: int) -> str:
    """A sequence of m bases as a number, the first base lowest."""
    return f"(select sum(cast(instr('ACTG', substr({x}, cast(j + 1 as bigint), 1)) - 1 as hugeint) << cast(2 * j as integer)) from unnest(range(0, {m})) u(j))"


def minimizers(k: int, m: int, magic: int, canonical: bool = False) -> str:
    """CTEs up to ``mins``: each k-mer's minimizer and its place."""
    digit = lambda s: "+".join(f"(instr('ACTG', substr({s}, {j + 1}, 1)) - 1) * {4**j}::bigint" for j in range(m))
    unsigned = magic % 2**64
    mixed = f"xor(((code::hugeint * {MULTIPLIER}::hugeint) % 18446744073709551616::hugeint)::ubigint, " + f"{unsigned}::ubigint)"
    out = f"mmers as (select kmer_id, i, {digit('substr(kmer, cast(i + 1 as bigint), ' + str(m) + ')')} code from kmers, unnest(range(0, {k - m + 1})) t(i)), "
    out += f"best as (select kmer_id, min({{'h': {mixed}, 'i': i, 'code': code}}) b from mmers group by kmer_id), "
    if canonical:
        out += f"mmers_rc as (select kmer_id, i, {digit('substr(' + rc('kmer') + ', cast(i + 1 as bigint), ' + str(m) + ')')} code from kmers, unnest(range(0, {k - m + 1})) t(i)), "
        out += f"best_rc as (select kmer_id, min({{'h': {mixed}, 'i': i, 'code': code}}) b from mmers_rc group by kmer_id), "
        out += f"chosen as (select kmer_id, case when r.b.code < f.b.code then r.b.code else f.b.code end code, case when r.b.code < f.b.code then {k - m} - r.b.i else f.b.i end i from best f join best_rc r using (kmer_id)), "
    else:
        out += "chosen as (select kmer_id, b.code code, b.i i from best), "
    return out + "mins as materialized (select string_id, kmer_id, cast(code as bigint) minimizer, cast(kmer_offset + i as bigint) pos_in_seq, cast(i as bigint) pos_in_kmer from chosen join kmers using (kmer_id))"


SUPER = (
    "cuts as (select *, case when lag(minimizer) over w = minimizer and lag(pos_in_seq) over w = pos_in_seq then 0 else 1 end fresh from mins window w as (partition by string_id order by kmer_id)), "
    "numbered as (select *, sum(fresh) over (partition by string_id order by kmer_id rows unbounded preceding) run from cuts), "
    "supers as (select string_id, min(kmer_id) first_kmer_id, any_value(minimizer) minimizer, any_value(pos_in_seq) pos_in_seq, max(pos_in_kmer) pos_in_kmer, count(*) num_kmers from numbered group by string_id, run), "
    "buckets as (select minimizer, count(distinct pos_in_seq) size, cast(sum(num_kmers) as bigint) num_kmers, count(*) num_super_kmers from supers group by minimizer)"
)
RUNS = (
    "flags as (select *, case when lag(weight) over (partition by string_id order by kmer_id) = weight then 0 else 1 end fresh, case when lag(weight) over (order by kmer_id) = weight then 0 else 1 end turned from kmers), "
    "runs as (select *, sum(fresh) over (partition by string_id order by kmer_id rows unbounded preceding) run, sum(turned) over (order by kmer_id rows unbounded preceding) - 1 run_id from flags)"
)

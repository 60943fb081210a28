"""The registered queries: every operator over whole tables, each with SQL where SQL can express it.

The main dictionary holds the documents (k = 31). Where SQL over it would be too slow, a query over the dictionary of benchmark texts is held
against SQL, and its twin ``<name>_of_documents`` does the whole table, has no SQL and is tested against brute force.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..config import Config
from ..functions import sequence as S
from ..operators import minimizers as M
from ..operators import reads as R
from ..operators import reorder as O
from ..operators import statistics as T
from ..operators import weights as W
from ..operators.dictionary import RESULT, Dictionary
from ..operators.firsts import count_kmers
from ..operators.kmerize import cut, squeezed_pieces, unsqueezed_pieces
from ..operators.protein import protein_kmers
from ..operators.running import running_sums
from ..sources.files import mix_reads, read_blank_separated, read_fasta, read_fastq, read_segments, read_weighted_fasta, write_fasta
from ..sources.pieces import read_pieces, stream_sequences
from ..sources.storage import shared_dir, stored
from . import oracle as Q
from .inputs import index_of, index_sequences, reads_of, table

K, SMALL_K, SMALL_M, SEED = 31, 15, 7, 1
QUERIES: dict = {}
ORACLE: dict[str, str] = {}
CTE = "with "


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def _docs(spark, sf_dir) -> Dictionary:
    return index_of(spark, sf_dir, k=K)


def _bench(spark, sf_dir, **more) -> Dictionary:
    return index_of(spark, sf_dir, "benchmark", "item_id", **({"k": SMALL_K, "m": SMALL_M, "seed": SEED} | more))


def _windows(spark, sf_dir, k=K, flip=True):
    """(read_id, pos, kmer) of all benchmark windows as strings."""
    rows = reads_of(table(spark, sf_dir, "benchmark"), "item_id", flip).where(F.length("seq") >= k)
    rows = rows.withColumn("pos", F.explode(F.sequence(F.lit(0), F.length("seq") - k)))
    return rows.select("read_id", F.col("pos").cast("long").alias("pos"), S.kmer_at(F.col("seq"), F.col("pos"), k).alias("kmer"))


DOCS = Q.dictionary(K)
BENCH = Q.dictionary(SMALL_K, "benchmark", "item_id")
READS = Q.reads(K, "benchmark", "item_id", True)
RESULTS = ", ".join(f"cast({c} as {'integer' if c == 'kmer_orientation' else 'bigint'}) {c}" for c in RESULT)

# ---- scalar functions -------------------------------------------------------------------------------


@query(CTE + READS + f" select read_id, pos, kmer, {Q.rc('kmer')} rc, least(kmer, {Q.rc('kmer')}) canonical, cast({Q.packed('kmer', K)} as bigint) packed, kmer unpacked, not contains(kmer, 'N') valid, left(kmer, {K - 1}) prefix, right(kmer, {K - 1}) suffix, substr(kmer, 2, {K - 1}) || 'A' appended, 'C' || left(kmer, {K - 1}) prepended from read_windows")
def sequence_functions(spark, sf_dir):
    x = F.col("kmer")
    return _windows(spark, sf_dir).select("read_id", "pos", "kmer", S.reverse_complement(x).alias("rc"), S.canonical(x).alias("canonical"), S.pack(x).alias("packed"), S.unpack(S.pack(x), K).alias("unpacked"), S.is_valid(x).alias("valid"), S.prefix(x, K).alias("prefix"), S.suffix(x, K).alias("suffix"), S.append_base(x, F.lit("A")).alias("appended"), S.prepend_base(x, F.lit("C")).alias("prepended"))


@query(f"select item_id, {Q.DNA} seq, not contains({Q.DNA}, 'N') and length({Q.DNA}) > 0 valid, cast(length({Q.DNA}) as bigint) len from benchmark")
def valid_sequences(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", S.dna_of(F.col("text")).alias("seq")).select("item_id", "seq", S.is_valid(F.col("seq")).alias("valid"), F.length("seq").cast("long").alias("len"))


# ---- the dictionary itself ---------------------------------------------------------------------------


@query(CTE + DOCS + " select '1.0.0' " + "\"version\", 'multiply-xor 64' hasher, 31 k, 20 m, false canonical, false weighted, (select count(*) from kmers) num_kmers, count(*) num_strings, cast(sum(length(seq)) as bigint) num_bases, cast(max(length(seq)) as bigint) max_len from strings")
def dictionary_metadata(spark, sf_dir):
    return _docs(spark, sf_dir).metadata()


@query(CTE + DOCS + " select string_id, seq, cast(length(seq) as bigint) len, num_kmers, string_begin, string_end, first_kmer_id from strings")
def strings_table(spark, sf_dir):
    return _docs(spark, sf_dir).strings.select("string_id", "seq", "len", "num_kmers", "string_begin", "string_end", "first_kmer_id")


@query(CTE + DOCS + f" select string_id, num_kmers, string_begin, string_end, left(seq, {K - 1}) string_prefix, right(seq, {K - 1}) string_suffix from strings")
def string_ends(spark, sf_dir):
    return _docs(spark, sf_dir).string_ends()


@query(CTE + BENCH + " select kmer_id, string_id, kmer_id_in_string, kmer_offset, kmer, weight from kmers")
def kmer_table(spark, sf_dir):
    return _bench(spark, sf_dir).kmer_table()


@query(CTE + DOCS + " select weight, count(*) num_kmers from kmers group by weight")
def weight_frequencies(spark, sf_dir):
    return W.weight_frequencies(_docs(spark, sf_dir))


@query(CTE + DOCS + " select weight, kmer_id, kmer from kmers order by weight desc, kmer_id limit 10")
def heaviest_kmers(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.kmers.orderBy(F.desc("weight"), "kmer_id").limit(10).select("weight", "kmer_id", d.kmer_strings().alias("kmer"))


@query(CTE + "p as (" + f"select string_split({Q.DNA}, 'N') parts from documents where text is not null), s as (select unnest(parts) seq from p), w as (select substr(seq, cast(i + 1 as bigint), {K}) kmer from s, unnest(range(0, length(seq) - {K} + 1)) t(i)) select count(*) num_windows, count(distinct least(kmer, {Q.rc('kmer')})) num_kmers from w")
def kmer_count(spark, sf_dir):
    sequences = index_sequences(table(spark, sf_dir, "documents"), "doc_id", K).withColumnRenamed("sequence_id", "id")
    pieces = squeezed_pieces(cut(sequences, K).select("id", F.col("start").alias("place"), "seq")).repartition("id", "place")
    return count_kmers(unsqueezed_pieces(stored(pieces, _folder(spark))), K)


# ---- point queries -----------------------------------------------------------------------------------


@query(CTE + DOCS + ", " + READS + f", found as ({Q.lookup('read_windows', K)}) select read_id, pos, kmer, {RESULTS} from found")
def lookup_both_strands(spark, sf_dir):
    return _docs(spark, sf_dir).lookup(_windows(spark, sf_dir))


@query(CTE + DOCS + ", " + READS + f", found as ({Q.lookup('read_windows', K, check_rc=False)}) select read_id, pos, kmer, {RESULTS} from found")
def lookup_forward_only(spark, sf_dir):
    return _docs(spark, sf_dir).lookup(_windows(spark, sf_dir), check_rc=False)


def _palindromes(canonical):
    words = "w as (select a.c || b.c || d.c || e.c kmer from l a, l b, l d, l e)"
    return CTE + Q.dictionary(4, "benchmark", "item_id") + f", l(c) as (values ('A'), ('C'), ('G'), ('T')), {words}, found as ({Q.lookup('w', 4, canonical)}) select kmer, {RESULTS} from found"


def _all_words(spark):
    base = spark.createDataFrame([(c,) for c in "ACGT"], "c string")
    return base.selectExpr("explode(flatten(flatten(flatten(transform(array('A','C','G','T'), a -> transform(array('A','C','G','T'), b -> transform(array('A','C','G','T'), d -> transform(array('A','C','G','T'), e -> concat(a, b, d, e))))))))) kmer").distinct()


@query(_palindromes(False))
def lookup_palindromes(spark, sf_dir):
    return _bench(spark, sf_dir, k=4, m=3).lookup(_all_words(spark))


@query(_palindromes(True))
def lookup_palindromes_canonical(spark, sf_dir):
    return _bench(spark, sf_dir, k=4, m=3, canonical=True).lookup(_all_words(spark))


_MEMBERS = " select read_id, pos, kmer from read_windows q where {} exists (select 1 from kmers d where least(d.kmer, " + Q.rc("d.kmer") + ") = least(q.kmer, " + Q.rc("q.kmer") + "))"


@query(CTE + DOCS + ", " + READS + _MEMBERS.format(""))
def members(spark, sf_dir):
    return _docs(spark, sf_dir).members(_windows(spark, sf_dir))


@query(CTE + DOCS + ", " + READS + _MEMBERS.format("not"))
def non_members(spark, sf_dir):
    return _docs(spark, sf_dir).members(_windows(spark, sf_dir), present=False)


@query(CTE + DOCS + " select l.doc_id kmer_id, k.kmer, k.weight from labels l left join kmers k on k.kmer_id = l.doc_id")
def access_and_weight(spark, sf_dir):
    d = _docs(spark, sf_dir)
    ids = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("kmer_id"))
    return d.access_weighted(ids)


@query(CTE + DOCS + " select l.doc_id kmer_id, k.kmer from labels l left join kmers k on k.kmer_id = l.doc_id")
def access_from_strings(spark, sf_dir):
    return _docs(spark, sf_dir).access(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("kmer_id")))


@query(CTE + DOCS + " select l.doc_id kmer_id, k.weight from labels l left join kmers k on k.kmer_id = l.doc_id")
def weight_by_interval(spark, sf_dir):
    ids = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("kmer_id"))
    return W.weight_of_ids(ids, W.global_runs(_docs(spark, sf_dir)))


@query(CTE + DOCS + " select kmer_id, kmer from kmers where string_id = 5")
def iterate_string(spark, sf_dir):
    return _docs(spark, sf_dir).iterate(string_id=5)


@query(CTE + BENCH + " select kmer_id, kmer from kmers where kmer_id >= 1000")
def iterate_from_id(spark, sf_dir):
    return _bench(spark, sf_dir).iterate(first_id=1000)


# ---- navigation --------------------------------------------------------------------------------------

_STEPS = "slots(slot, base) as (values (0, 'A'), (1, 'C'), (2, 'T'), (3, 'G'))"


def _steps(source: str, k: int, sides=("forward", "backward"), keep: str = "read_id, pos, kmer") -> str:
    move = {"forward": f"substr(kmer, 2, {k - 1}) || base", "backward": f"base || left(kmer, {k - 1})"}
    return _STEPS + ", steps as (" + " union all ".join(f"select {keep}, '{s}' direction, slot, base, {move[s]} neighbour from {source}, slots" for s in sides) + f"), found as ({Q.lookup('steps', k, column='neighbour')})"


@query(CTE + DOCS + ", " + READS + ", " + _steps("read_windows", K) + f" select read_id, pos, kmer, direction, slot, base, neighbour, {RESULTS} from found")
def neighbours(spark, sf_dir):
    return _docs(spark, sf_dir).neighbours(_windows(spark, sf_dir))


@query(CTE + DOCS + ", " + READS + ", " + _steps("read_windows", K, ("forward",)) + f" select read_id, pos, kmer, direction, slot, base, neighbour, {RESULTS} from found")
def neighbours_forward(spark, sf_dir):
    return _docs(spark, sf_dir).neighbours(_windows(spark, sf_dir), backward=False)


@query(CTE + DOCS + ", " + READS + ", " + _steps("read_windows", K, ("backward",)) + f" select read_id, pos, kmer, direction, slot, base, neighbour, {RESULTS} from found")
def neighbours_backward(spark, sf_dir):
    return _docs(spark, sf_dir).neighbours(_windows(spark, sf_dir), forward=False)


@query(CTE + DOCS + f", heads as (select string_id from_string, left(seq, {K}) kmer from strings), tails as (select string_id from_string, right(seq, {K}) kmer from strings), {_STEPS}, "
    f"steps as (select from_string, kmer, 'backward' direction, slot, base, base || left(kmer, {K - 1}) neighbour from heads, slots union all select from_string, kmer, 'forward', slot, base, substr(kmer, 2, {K - 1}) || base from tails, slots), found as ({Q.lookup('steps', K, column='neighbour')}) select from_string, kmer, direction, slot, base, neighbour, {RESULTS} from found")
def string_neighbours(spark, sf_dir):
    return _docs(spark, sf_dir).string_neighbours()


@query(CTE + BENCH + ", " + _steps("kmers", SMALL_K, keep="kmer_id from_kmer, kmer") + ", each as (select from_kmer, count_if(direction = 'forward' and kmer_id is not null) forward_degree, count_if(direction = 'backward' and kmer_id is not null) backward_degree from found group by from_kmer) select cast(forward_degree as bigint) forward_degree, cast(backward_degree as bigint) backward_degree, count(*) num_kmers from each group by 1, 2")
def degree_histogram(spark, sf_dir):
    return T.degree_histogram(_bench(spark, sf_dir))


# ---- read queries ------------------------------------------------------------------------------------

_REPORT, _PER_READ = Q.report(K)
_TOTAL = Q.report(K, False)[1]


@query(CTE + DOCS + ", " + READS + ", " + _REPORT + " " + _TOTAL)
def read_report_total(spark, sf_dir):
    return R.total_report(_docs(spark, sf_dir), reads_of(table(spark, sf_dir, "benchmark"), "item_id", True))


@query(CTE + DOCS + ", " + READS + ", " + _REPORT + " " + _PER_READ)
def read_report(spark, sf_dir):
    return R.read_report(_docs(spark, sf_dir), reads_of(table(spark, sf_dir, "benchmark"), "item_id", True))


@query(CTE + DOCS + ", " + READS + ", " + _REPORT + " select read_id, pos, kmer_id, string_id, cast(kmer_orientation as integer) kmer_orientation, extended from marked where kmer_id is not null")
def read_extensions(spark, sf_dir):
    return R.positive_windows(_docs(spark, sf_dir), reads_of(table(spark, sf_dir, "benchmark"), "item_id", True)).select("read_id", "pos", "kmer_id", "string_id", "kmer_orientation", "extended")


@query(CTE + DOCS + ", " + READS + ", " + _REPORT + " select read_id, num_kmers, num_positive_kmers, num_kmers > 0 and num_positive_kmers >= 0.8 * num_kmers covered from report")
def read_coverage(spark, sf_dir):
    return R.covered_reads(_docs(spark, sf_dir), reads_of(table(spark, sf_dir, "benchmark"), "item_id", True))


_BENCH31 = Q.dictionary(K, "benchmark", "item_id")


@query(CTE + _BENCH31 + ", " + Q.reads(K, "documents", "doc_id", False) + ", " + _REPORT + " " + _PER_READ)
def document_report(spark, sf_dir):
    """Documents as reads against the benchmark: many long reads, some with invalid windows."""
    return R.read_report(_bench(spark, sf_dir, k=K, m=20), reads_of(table(spark, sf_dir, "documents"), "doc_id"))


_TURNS = Q.reads(K, "(select conv_id * 1000 + turn key, text from conversations)", "key", False)


@query(CTE + DOCS + ", " + _TURNS + ", " + _REPORT + " " + _TOTAL)
def conversation_report(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), "text")
    return R.total_report(_docs(spark, sf_dir), reads_of(turns, "key"))


_K63 = 63
_R63, _ = Q.report(_K63)


@query(CTE + Q.dictionary(_K63, "benchmark", "item_id") + ", " + Q.reads(_K63, "documents", "doc_id", False) + ", " + _R63 + " " + _PER_READ)
def document_report_k63(spark, sf_dir):
    """The same with 128-bit keys."""
    return R.read_report(_bench(spark, sf_dir, k=_K63, m=20), reads_of(table(spark, sf_dir, "documents"), "doc_id"))


@query(CTE + Q.dictionary(_K63, "benchmark", "item_id") + " select kmer_id, string_id, kmer_id_in_string, kmer_offset, kmer, weight from kmers")
def kmer_table_k63(spark, sf_dir):
    return _bench(spark, sf_dir, k=_K63, m=20).kmer_table()


# ---- minimizers --------------------------------------------------------------------------------------

MAGIC = M.magic_of(SEED)
MINS = BENCH + ", " + Q.minimizers(SMALL_K, SMALL_M, MAGIC)
SUPERS = MINS + ", " + Q.SUPER
CLASS = "case when size < 2 then 'SINGLETON' when size < 65 then 'MIDLOAD' else 'HEAVYLOAD' end"


@query(CTE + MINS + " select * from mins")
def minimizers(spark, sf_dir):
    return M.kmer_minimizers(_bench(spark, sf_dir))


@query(CTE + BENCH + ", " + Q.minimizers(SMALL_K, SMALL_M, MAGIC, True) + " select * from mins")
def minimizers_canonical(spark, sf_dir):
    return M.kmer_minimizers(_bench(spark, sf_dir, canonical=True))


@query(CTE + SUPERS + " select * from supers")
def super_kmers(spark, sf_dir):
    return M.super_kmers(_bench(spark, sf_dir))


@query(CTE + SUPERS + f" select minimizer, size, num_kmers, num_super_kmers, {CLASS} bucket_class, case when size >= 65 then cast(ceil(log2(size)) - 7 as integer) end skew_partition from buckets")
def buckets(spark, sf_dir):
    return M.buckets(_bench(spark, sf_dir))


@query(CTE + SUPERS + " select size, count(*) num_buckets, cast(sum(num_kmers) as bigint) num_kmers from buckets group by size")
def bucket_histogram(spark, sf_dir):
    return M.bucket_histogram(_bench(spark, sf_dir))


@query(CTE + SUPERS + f" select {CLASS} bucket_class, count(*) num_buckets, cast(sum(size) as bigint) num_positions, cast(sum(num_kmers) as bigint) num_kmers, max(size) max_size from buckets group by 1")
def bucket_classes(spark, sf_dir):
    return M.bucket_classes(_bench(spark, sf_dir))


@query(CTE + SUPERS + f", c as (select unnest({list(M.SIZE_CLASSES)}) up_to) select cast(up_to as bigint) up_to, cast(coalesce(sum(case when size <= up_to then num_kmers end), 0) as bigint) kmers, round(100.0::double * coalesce(sum(case when size <= up_to then num_kmers end), 0) / sum(num_kmers), 6) percent from buckets, c group by up_to")
def cumulative_kmers(spark, sf_dir):
    return M.cumulative_kmers(_bench(spark, sf_dir))


@query(CTE + SUPERS + " select num_kmers, count(*) num_super_kmers from supers group by num_kmers")
def super_kmer_histogram(spark, sf_dir):
    return M.super_kmer_histogram(_bench(spark, sf_dir))


# ---- the same over all documents, without SQL --------------------------------------------------------


@query()
def kmer_table_of_documents(spark, sf_dir):
    return _docs(spark, sf_dir).kmer_table()


@query()
def kmer_table_k63_of_documents(spark, sf_dir):
    return index_of(spark, sf_dir, k=_K63).kmer_table()


@query()
def iterate_from_id_of_documents(spark, sf_dir):
    return _docs(spark, sf_dir).iterate(first_id=1000)


@query()
def degree_histogram_of_documents(spark, sf_dir):
    return T.degree_histogram(_docs(spark, sf_dir))


@query()
def minimizers_of_documents(spark, sf_dir):
    return M.kmer_minimizers(_docs(spark, sf_dir))


@query()
def minimizers_canonical_of_documents(spark, sf_dir):
    return M.kmer_minimizers(index_of(spark, sf_dir, k=K, canonical=True))


@query()
def super_kmers_of_documents(spark, sf_dir):
    return M.super_kmers(_docs(spark, sf_dir))


@query()
def buckets_of_documents(spark, sf_dir):
    return M.buckets(_docs(spark, sf_dir))


@query()
def bucket_histogram_of_documents(spark, sf_dir):
    return M.bucket_histogram(_docs(spark, sf_dir))


@query()
def bucket_classes_of_documents(spark, sf_dir):
    return M.bucket_classes(_docs(spark, sf_dir))


@query()
def cumulative_kmers_of_documents(spark, sf_dir):
    return M.cumulative_kmers(_docs(spark, sf_dir))


@query()
def super_kmer_histogram_of_documents(spark, sf_dir):
    return M.super_kmer_histogram(_docs(spark, sf_dir))


# ---- weights and reordering ----------------------------------------------------------------------------


@query(CTE + DOCS + ", " + Q.RUNS + " select cast(run_id as bigint) run_id, min(kmer_id) begin_kmer_id, max(kmer_id) + 1 end_kmer_id, any_value(weight) weight from runs group by run_id")
def weight_runs(spark, sf_dir):
    return W.global_runs(_docs(spark, sf_dir))


@query(CTE + DOCS + ", " + Q.RUNS + " select string_id, cast(run as bigint) run, min(kmer_id) begin_kmer_id, max(kmer_id) + 1 end_kmer_id, any_value(weight) weight from runs group by string_id, run")
def weight_runs_of_strings(spark, sf_dir):
    return W.string_runs(_docs(spark, sf_dir)).withColumn("run", F.col("run").cast("long"))


@query(CTE + DOCS + ", f as (select weight, count(*) c from kmers group by weight), n as (select sum(c) n from f) select count(*) distinct_weights, cast(sum(weight * c) as bigint) sum_of_weights, round(cast(sum(weight * (c / n)) as double), 6) expected_weight, round(cast(sum(-(c / n) * log2(c / n)) as double), 6) entropy, cast(sum(c) - max(c) as bigint) kmers_without_top_weight from f, n")
def weight_summary(spark, sf_dir):
    return W.weight_summary(_docs(spark, sf_dir))


_ENDS = ", " + Q.RUNS + ", ends as (select string_id, arg_min(weight, kmer_id) front, arg_max(weight, kmer_id) back, cast(sum(fresh) as bigint) num_runs from runs group by string_id)"


@query(CTE + DOCS + _ENDS + " select * from ends")
def string_endpoints(spark, sf_dir):
    return W.endpoints(_docs(spark, sf_dir))


@query(CTE + DOCS + _ENDS + ", sides as (select front weight, front = back lone from ends union all select back, front = back from ends), each as (select weight, count(*) % 2 odd, bool_and(lone) lone from sides group by weight) select (select count(*) from ends) num_strings, (select cast(sum(num_runs) as bigint) from ends) num_runs, cast(sum(odd) as bigint) odd_weights, count_if(lone)::bigint lone_weights, cast(floor((sum(odd) + 2 * count_if(lone)) / 2) as bigint) walks_at_least from each")
def walk_lower_bound(spark, sf_dir):
    return W.walk_lower_bound(W.endpoints(_docs(spark, sf_dir)))


@query()
def permuted_strings(spark, sf_dir):
    """Strings reordered and turned so that the fewest weight runs remain; any of several best orders will do, so there is no SQL."""
    d = _docs(spark, sf_dir)
    order, _ = O.permutation(W.endpoints(d))
    return O.apply_permutation(d.strings.select("string_id", "seq"), order)


@query(CTE + DOCS + _ENDS + " select (select cast(sum(num_runs) as bigint) from ends) runs_before, (select count(*) from strings) num_strings")
def runs_before_reordering(spark, sf_dir):
    return W.endpoints(_docs(spark, sf_dir)).agg(F.sum("num_runs").alias("runs_before"), F.count("*").alias("num_strings"))


@query(CTE + DOCS + ", " + Q.RUNS + ", a as (select (select count(*) from kmers) num_kmers, (select count(*) from strings) num_strings, (select cast(sum(length(seq)) as bigint) from strings) num_bases, (select count(distinct run_id) from runs) num_weight_runs, (select count(distinct weight) from kmers) num_weights), "
    "b as (select *, 2 * num_bases base_bits, cast((num_strings + 1) * ceil(log2(num_bases + 1)) as bigint) offset_bits, cast(num_weight_runs * (ceil(log2(num_kmers + 1)) + greatest(1, ceil(log2(num_weights + 1)))) as bigint) weight_bits from a) "
    f"select *, round((base_bits + offset_bits + weight_bits)::double / num_kmers, 6) bits_per_kmer, round(2 + 2.0::double * num_strings * {K - 1} / num_kmers, 6) string_bits_per_kmer from b")
def space_model(spark, sf_dir):
    return T.space_model(_docs(spark, sf_dir))


# ---- protein, files ------------------------------------------------------------------------------------


@query("with s as (select item_id, upper(text) seq from benchmark), w as (select substr(seq, cast(i + 1 as bigint), 6) kmer from s, unnest(range(0, length(seq) - 5)) t(i)) select kmer, count(*) weight from w where regexp_full_match(kmer, '[A-Z]+') group by kmer")
def protein_kmer_count(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("seq"))
    return protein_kmers(rows, "item_id", "seq", 6).groupBy("kmer").agg(F.count("*").alias("weight"))


_ROUND = f"select row_number() over (order by item_id) - 1 sequence_id, cast(item_id as varchar) header, {Q.DNA} seq from benchmark"


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/strandix/files-{uuid.uuid4().hex}"


@query(_ROUND)
def fasta_round_trip(spark, sf_dir):
    path = _folder(spark)
    write_fasta(reads_of(table(spark, sf_dir, "benchmark"), "item_id"), path, "read_id")
    return read_fasta(spark, path)


@query(_ROUND)
def segment_round_trip(spark, sf_dir):
    path = _folder(spark)
    rows = reads_of(table(spark, sf_dir, "benchmark"), "item_id").repartitionByRange("read_id").sortWithinPartitions("read_id")
    rows.select(F.concat_ws("\t", F.col("read_id").cast("string"), "seq").alias("value")).write.text(path)
    return read_segments(spark, path)


@query(f"select row_number() over (order by item_id) - 1 sequence_id, cast(item_id as varchar) header, {Q.DNA} seq, repeat('I', cast(length({Q.DNA}) as bigint)) qual from benchmark")
def fastq_round_trip(spark, sf_dir):
    path = _folder(spark)
    rows = reads_of(table(spark, sf_dir, "benchmark"), "item_id").repartitionByRange("read_id").sortWithinPartitions("read_id")
    rows.select(F.concat(F.lit("@"), F.col("read_id").cast("string"), F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.expr("repeat('I', length(seq))")).alias("value")).write.text(path)
    return read_fastq(spark, path)


@query("select false from_right, doc_id sequence_id, row_number() over (order by doc_id) - 1 nth, cast(length(" + Q.DNA + ") as bigint) bases from documents union all "
       "select true, item_id, row_number() over (order by item_id) - 1, cast(length(" + Q.DNA + ") as bigint) from benchmark")
def mixed_reads(spark, sf_dir):
    """Documents and benchmark texts as reads, mixed at random; counted along the mix, the reads of each table come in the order of their ids, and all come."""
    left, right = (reads_of(table(spark, sf_dir, t), key).select(F.col("read_id").cast("long").alias("sequence_id"), "seq") for t, key in (("documents", "doc_id"), ("benchmark", "item_id")))
    mixed = mix_reads(left, right, None, SEED).withColumn("one", F.lit(1).cast("long"))
    sides = [running_sums(mixed.where(F.col("from_right") == side), "place", {"one": "nth"}) for side in (False, True)]
    return sides[0].unionByName(sides[1]).select("from_right", "sequence_id", "nth", F.length("seq").cast("long").alias("bases"))


@query(_ROUND)
def gzip_round_trip(spark, sf_dir):
    path = _folder(spark)
    rows = reads_of(table(spark, sf_dir, "benchmark"), "item_id").repartitionByRange("read_id").sortWithinPartitions("read_id")
    rows.select(F.concat(F.lit(">"), F.col("read_id").cast("string"), F.lit("\n"), F.col("seq")).alias("value")).write.option("compression", "gzip").text(path)
    return read_fasta(spark, path)


@query(f"select row_number() over (order by item_id) - 1 sequence_id, {Q.DNA} seq from benchmark")
def multiline_round_trip(spark, sf_dir):
    """Sequences of several lines, with an empty line after each."""
    path = _folder(spark)
    rows = reads_of(table(spark, sf_dir, "benchmark"), "item_id").repartitionByRange("read_id").sortWithinPartitions("read_id")
    lines = F.regexp_replace("seq", "(.{60})(?=.)", "$1\n")
    rows.select(F.concat(F.lit(">"), F.col("read_id").cast("string"), F.lit("\n"), lines, F.lit("\n")).alias("value")).write.text(path)
    return read_blank_separated(spark, path)


@query(CTE + _BENCH31 + " select kmer_id, string_id, kmer, pos + 1 weight from kmers")
def weighted_fasta_dictionary(spark, sf_dir):
    """A dictionary with weights from headers: each k-mer is given its place in its sequence, counted from 1."""
    path = _folder(spark)
    rows = reads_of(table(spark, sf_dir, "benchmark"), "item_id").where(F.length("seq") >= K)
    write_fasta(rows.withColumn("weights", F.sequence(F.lit(1).cast("long"), (F.length("seq") - (K - 1)).cast("long"))), path, "read_id")
    d = Dictionary.build(read_weighted_fasta(spark, path, K), Config(k=K, weighted=True))
    return d.kmers.select("kmer_id", "string_id", d.kmer_strings().alias("kmer"), "weight")


@query(CTE + BENCH + " select kmer_id, string_id, kmer_id_in_string, kmer_offset, kmer, weight from kmers")
def save_and_load(spark, sf_dir):
    path = _folder(spark)
    _bench(spark, sf_dir).save(path)
    d = Dictionary.load(spark, path)
    return d.kmers.select("kmer_id", "string_id", "kmer_id_in_string", "kmer_offset", d.kmer_strings().alias("kmer"), "weight")


def _one_record(spark, sf_dir, name, key) -> str:
    """A folder of files that are parts of one text: a single FASTA record of all sequences, a line and an N each."""
    path = f"{_folder(spark)}/record.fa"
    rows = reads_of(table(spark, sf_dir, name).where("text is not null"), key).select(F.col("read_id").alias("at"), F.concat("seq", F.lit("N")).alias("value"))
    head = table(spark, sf_dir, name).agg((F.min(key) - 1).alias("at"), F.lit(">all of it").alias("value"))
    head.unionByName(rows).repartitionByRange(3, "at").sortWithinPartitions("at").select("value").write.text(path)
    return path


@query(CTE + BENCH + " select kmer_id, string_id, kmer_id_in_string, kmer_offset, kmer, weight from kmers")
def long_record_dictionary(spark, sf_dir):
    """All benchmark texts as one record over several files, read in splits of 2,000 bytes and pieces of 700 bases."""
    path = _one_record(spark, sf_dir, "benchmark", "item_id")
    d = Dictionary.build(read_pieces(spark, path, SMALL_K, split=2_000, piece=700, joined=True), Config(k=SMALL_K, m=SMALL_M, seed=SEED))
    return d.kmers.select("kmer_id", "string_id", "kmer_id_in_string", "kmer_offset", d.kmer_strings().alias("kmer"), "weight")


@query(CTE + DOCS + " select string_id, seq, cast(length(seq) as bigint) len, num_kmers, string_begin, string_end, first_kmer_id from strings")
def long_record_strings(spark, sf_dir):
    """The strings of all documents, whose sequences are one record, read in splits of 100 KB."""
    path = _one_record(spark, sf_dir, "documents", "doc_id")
    d = Dictionary.build(read_pieces(spark, path, K, split=100_000, joined=True), Config(k=K))
    return d.strings.select("string_id", "seq", "len", "num_kmers", "string_begin", "string_end", "first_kmer_id")


@query(CTE + DOCS + ", " + READS + ", " + _REPORT + f", total as ({_TOTAL}) select kind, total.* from total, (values ('fasta'), ('fasta, gzipped'), ('fastq')) t(kind)")
def file_reports(spark, sf_dir):
    """The report of the same reads from files of three kinds, cut into small splits."""
    d, path = _docs(spark, sf_dir), _folder(spark)
    reads = reads_of(table(spark, sf_dir, "benchmark"), "item_id", True)
    rows = reads.repartitionByRange(2, "read_id").sortWithinPartitions("read_id")
    fasta = rows.select(F.concat(F.lit(">"), F.col("read_id").cast("string"), F.lit("\n"), F.regexp_replace("seq", "(.{60})(?=.)", "$1\n")).alias("value"))
    fasta.write.text(f"{path}/reads.fa")
    fasta.write.option("compression", "gzip").text(f"{path}/reads.fa.gz")
    rows.select(F.concat(F.lit("@"), F.col("read_id").cast("string"), F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.expr("repeat('I', length(seq))")).alias("value")).write.text(f"{path}/reads.fq")
    kinds = {"fasta": "reads.fa", "fasta, gzipped": "reads.fa.gz", "fastq": "reads.fq"}
    reports = [R.file_report(d, f"{path}/{name}", split=3_000).select(F.lit(kind).alias("kind"), *R.COUNTERS) for kind, name in kinds.items()]
    return reports[0].unionByName(reports[1]).unionByName(reports[2])


@query(f"select row_number() over (order by item_id) record, cast(item_id as varchar) header, {Q.DNA} seq from benchmark")
def streamed_fastq(spark, sf_dir):
    """A FASTQ file of all benchmark texts, taken up by a stream."""
    path = _folder(spark)
    rows = reads_of(table(spark, sf_dir, "benchmark"), "item_id").repartitionByRange(1, "read_id").sortWithinPartitions("read_id")
    rows.select(F.concat(F.lit("@"), F.col("read_id").cast("string"), F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.expr("repeat('I', length(seq))")).alias("value")).write.text(f"{path}/in")
    stream_sequences(spark, f"{path}/in").writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").select("record", "header", "seq")


# ---- one strand only, packed forms, offsets ------------------------------------------------------------


@query(CTE + DOCS + ", " + READS + " select read_id, pos, kmer from read_windows q where exists (select 1 from kmers d where d.kmer = q.kmer)")
def members_forward_only(spark, sf_dir):
    return _docs(spark, sf_dir).members(_windows(spark, sf_dir), check_rc=False)


@query(CTE + DOCS + ", " + READS + ", " + _steps("read_windows", K).replace(Q.lookup("steps", K, column="neighbour"), Q.lookup("steps", K, column="neighbour", check_rc=False)) + f" select read_id, pos, kmer, direction, slot, base, neighbour, {RESULTS} from found")
def neighbours_forward_only(spark, sf_dir):
    return _docs(spark, sf_dir).neighbours(_windows(spark, sf_dir), check_rc=False)


@query(CTE + DOCS + f", heads as (select string_id from_string, left(seq, {K}) kmer from strings), tails as (select string_id from_string, right(seq, {K}) kmer from strings), {_STEPS}, "
    f"steps as (select from_string, kmer, 'backward' direction, slot, base, base || left(kmer, {K - 1}) neighbour from heads, slots union all select from_string, kmer, 'forward', slot, base, substr(kmer, 2, {K - 1}) || base from tails, slots), found as ({Q.lookup('steps', K, column='neighbour', check_rc=False)}) select from_string, kmer, direction, slot, base, neighbour, {RESULTS} from found")
def string_neighbours_forward_only(spark, sf_dir):
    return _docs(spark, sf_dir).string_neighbours(check_rc=False)


@query(CTE + BENCH + f" select kmer_id, {Q.rc('kmer')} kmer from kmers")
def iterate_backward(spark, sf_dir):
    return _bench(spark, sf_dir).iterate(backward=True)


_SHORT = "w as (select read_id, pos, left(kmer, 20) s from read_windows)"
_CODE = "(instr('ACTG', substr(s, {0}, 1)) - 1)"


@query(CTE + READS + f", {_SHORT} select read_id, pos, cast({Q.packed('s', 20)} as bigint) packed, cast({_CODE.format(6)} as integer) at5, cast({Q.packed('left(s, 7)', 7)} as bigint) taken, cast({Q.packed('substr(s, 8)', 13)} as bigint) dropped, "
    f"cast({Q.packed(repr('G') + ' || s', 21)} as bigint) padded, cast({Q.packed('s || ' + repr('T'), 21)} as bigint) appended, cast({_CODE.format(1)} as integer) popped, cast({Q.packed('substr(s, 2)', 19)} as bigint) rest, cast({Q.packed('left(s, 4) || ' + repr('C') + ' || substr(s, 6)', 20)} as bigint) replaced, substr(s, 8, 7) minimizer from w")
def packed_functions(spark, sf_dir):
    x = S.pack(F.substring("kmer", 1, 20))
    first, rest = S.packed_pop(F.col("packed"))
    rows = _windows(spark, sf_dir).select("read_id", "pos", x.alias("packed"))
    p = F.col("packed")
    return rows.select("read_id", "pos", "packed", S.packed_at(p, 5).alias("at5"), S.packed_take(p, 7).alias("taken"), S.packed_drop(p, 7).alias("dropped"), S.packed_pad(p, F.lit(3)).alias("padded"), S.packed_append(p, F.lit(2), 20).alias("appended"), first.alias("popped"), rest.alias("rest"), S.packed_set(p, 4, F.lit(1)).alias("replaced"), S.minimizer_string(S.packed_take(S.packed_drop(p, 7), 7), 7).alias("minimizer"))


@query(CTE + READS + f" select read_id, pos, kmer, cast({Q.packed('kmer', K).replace('ACTG', 'ACGT')} as bigint) packed, kmer unpacked, cast(instr('ACGT', left(kmer, 1)) - 1 as integer) code from read_windows")
def packed_in_the_other_alphabet(spark, sf_dir):
    x, e = F.col("kmer"), "traditional"
    return _windows(spark, sf_dir).select("read_id", "pos", "kmer", S.pack(x, e).alias("packed"), S.unpack(S.pack(x, e), K, e).alias("unpacked"), S.char_code(S.base_at(x, 0), e).alias("code"))


@query(CTE + DOCS + f" select l.doc_id * 7 \"offset\", s.string_id, s.string_begin, s.string_end, case when l.doc_id * 7 + {K} <= s.string_end then l.doc_id * 7 - s.string_begin end kmer_id_in_string, case when l.doc_id * 7 + {K} <= s.string_end then l.doc_id * 7 - s.string_id * {K - 1} end kmer_id from labels l left join strings s on s.string_begin <= l.doc_id * 7 and l.doc_id * 7 < s.string_end")
def locate_offsets(spark, sf_dir):
    return _docs(spark, sf_dir).locate(table(spark, sf_dir, "labels").select((F.col("doc_id") * 7).alias("offset")))


_BITS = "(select cast(floor(log2(max(length(seq)))) + 1 as integer) from strings)"


@query(CTE + DOCS + f" select string_id, string_begin, string_end, string_id << {_BITS} encoded, {_BITS} relative_bits from strings")
def encoded_offsets(spark, sf_dir):
    return _docs(spark, sf_dir).encoded_offsets()


@query(CTE + DOCS + f", e as (select (string_id << {_BITS}) + num_kmers encoded, string_begin + num_kmers absolute, num_kmers relative, string_id, string_begin, string_end from strings) select * from e")
def decoded_offsets(spark, sf_dir):
    d = _docs(spark, sf_dir)
    bits = d.relative_bits()
    return d.decode_offsets(d.strings.select((F.shiftleft("string_id", bits) + F.col("num_kmers")).alias("encoded")), relative_bits=bits)


@query(CTE + DOCS + ", b as (select sum(length(seq)) bases, max(length(seq)) longest, count(*) n from strings) select cast(floor(log2(bases)) + 1 as integer) absolute_bits, cast(floor(log2(longest)) + 1 as integer) relative_bits, cast(floor(log2(n)) + 1 as integer) string_bits, cast(floor(log2(longest)) + floor(log2(n)) + 2 as integer) encoded_bits from b")
def offset_widths(spark, sf_dir):
    return T.offset_widths(_docs(spark, sf_dir))


@query(CTE + DOCS + ", " + Q.RUNS + ", a as (select (select count(*) from kmers) k, (select count(*) from strings) s, (select sum(length(seq)) from strings) b, (select count(distinct run_id) from runs) r, (select count(distinct weight) from kmers) w), "
    "p as (select 'base' part, cast(2 * b as bigint) bits, k from a union all select 'offset', cast((s + 1) * ceil(log2(b + 1)) as bigint), k from a union all select 'weight', cast(r * (ceil(log2(k + 1)) + greatest(1, ceil(log2(w + 1)))) as bigint), k from a) "
    "select part, bits, round(bits::double / k, 6) bits_per_kmer, round(100.0::double * bits / (select sum(bits) from p), 6) percent from p")
def space_breakdown(spark, sf_dir):
    return T.space_breakdown(_docs(spark, sf_dir))


@query(CTE + DOCS + ", b as (select cast(sum(length(seq)) as bigint) n from strings) select n num_bases, 20 m, cast(ceil(log2(n) / 2) + 1 as integer) advised_m, 20 < ceil(log2(n) / 2) + 1 short from b")
def minimizer_advice(spark, sf_dir):
    return T.minimizer_advice(_docs(spark, sf_dir))


# ---- buckets of short minimizers, which are heavy ------------------------------------------------------

SHORT_M = 3
SHORT = CTE + BENCH + ", " + Q.minimizers(SMALL_K, SHORT_M, MAGIC) + ", " + Q.SUPER


@query(SHORT + f" select {CLASS} bucket_class, count(*) num_buckets, cast(sum(size) as bigint) num_positions, cast(sum(num_kmers) as bigint) num_kmers, max(size) max_size from buckets group by 1")
def bucket_classes_of_short_minimizers(spark, sf_dir):
    return M.bucket_classes(_bench(spark, sf_dir, m=SHORT_M))


@query(SHORT + ", h as (select *, cast(ceil(log2(size)) - 7 as integer) skew_partition from buckets where size >= 65) select skew_partition, 1::bigint << (skew_partition + 6) larger_than, 1::bigint << (skew_partition + 7) up_to, count(*) num_buckets, cast(sum(size) as bigint) num_positions, cast(sum(num_kmers) as bigint) num_kmers from h group by skew_partition")
def skew_partitions(spark, sf_dir):
    return M.skew_partitions(_bench(spark, sf_dir, m=SHORT_M))


@query(SHORT + " select count(*) num_minimizers, cast(sum(size) as bigint) num_positions, cast(sum(num_super_kmers) as bigint) num_super_kmers, max(size) max_bucket, (select max(num_kmers) from supers) max_super_kmer from buckets")
def minimizer_counts(spark, sf_dir):
    return M.minimizer_counts(_bench(spark, sf_dir, m=SHORT_M))


@query(SHORT + " select distinct minimizer, pos_in_seq from supers where minimizer in (select minimizer from buckets where size >= 65)")
def bucket_positions(spark, sf_dir):
    d = _bench(spark, sf_dir, m=SHORT_M)
    return M.bucket_positions(d, M.buckets(d).where("size >= 65"))


@query()
def skew_partitions_of_documents(spark, sf_dir):
    return M.skew_partitions(_docs(spark, sf_dir))


@query()
def minimizer_counts_of_documents(spark, sf_dir):
    return M.minimizer_counts(_docs(spark, sf_dir))


# ---- reports and reordering as tables ------------------------------------------------------------------

_SHARE = "round(case when {1} > 0 then 100.0::double * {0} / {1} else 0 end, 6)"


@query(CTE + DOCS + ", " + READS + ", " + _REPORT + f", total as ({_TOTAL}) select *, {_SHARE.format('num_positive_kmers', 'num_kmers')} positive_percent, {_SHARE.format('num_negative_kmers', 'num_kmers')} negative_percent, {_SHARE.format('num_invalid_kmers', 'num_kmers')} invalid_percent, {_SHARE.format('num_extensions', 'num_positive_kmers')} extension_percent from total")
def read_report_percent(spark, sf_dir):
    return R.with_percentages(R.total_report(_docs(spark, sf_dir), reads_of(table(spark, sf_dir, "benchmark"), "item_id", True)))


@query("select 0::bigint num_kmers, 0::bigint num_positive_kmers, 0::bigint num_negative_kmers, 0::bigint num_invalid_kmers, 0::bigint num_searches, 0::bigint num_extensions")
def report_of_unknown_file(spark, sf_dir):
    return R.file_report(_bench(spark, sf_dir), "reads.unknown")


@query(CTE + _BENCH31 + ", " + Q.reads(K, "documents", "doc_id", False) + ", " + _REPORT + " select d.lang, count(*) num_reads, round(avg(case when num_kmers > 0 then num_positive_kmers / num_kmers end), 6) hit_rate, round(avg(case when num_positive_kmers > 0 then num_extensions / num_positive_kmers end), 6) extension_rate from report r join documents d on d.doc_id = r.read_id group by d.lang")
def hit_rates_by_language(spark, sf_dir):
    report = R.read_report(_bench(spark, sf_dir, k=K, m=20), reads_of(table(spark, sf_dir, "documents"), "doc_id"))
    languages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("read_id"), "lang")
    return T.collection_rates(report.join(languages, "read_id"), "lang")


@query("with recursive " + DOCS + _ENDS + ", links as materialized (select distinct front a, back b from ends union select distinct back, front from ends), reach(a, b) as (select a, a from links union select r.a, l.b from reach r join links l on l.a = r.b), "
    "part as (select a, min(b) p from reach group by a), degree as (select w, count(*) n from (select front w from ends union all select back from ends) group by w), walks as (select p, greatest(1, count_if(n % 2 = 1) // 2) n from degree join part on part.a = degree.w group by p), "
    "sums as (select cast(sum(num_runs) as bigint) runs, count(*) s from ends) select runs runs_before, s num_strings, cast(w as bigint) num_walks, cast(runs - s + w as bigint) runs_promised, cast(runs - s + w as bigint) runs_after from sums, (select sum(n) w from walks)")
def reordering_accounting(spark, sf_dir):
    return O.accounting(W.endpoints(_docs(spark, sf_dir)))


@query(CTE + DOCS + ", " + Q.RUNS + " select (select count(*) from strings) num_strings, (select count(*) from kmers) num_kmers, (select count(*) from (select distinct string_id, run from runs)) num_runs, (select count(distinct weight) from kmers) distinct_weights, (select cast(sum(weight) as bigint) from kmers) sum_of_weights")
def weighted_scan_summary(spark, sf_dir):
    return O.scan_summary(O.weighted_strings(_docs(spark, sf_dir)))


# ---- sweeps, exports, permutation files ------------------------------------------------------------------

_SWEPT = (5, 7, 9)


def _swept(m: int) -> str:
    inner = CTE + BENCH + ", " + Q.minimizers(SMALL_K, m, MAGIC) + ", " + Q.SUPER
    return f"select * from ({inner} select {m}::bigint m, count(*) num_minimizers, cast(sum(size) as bigint) num_positions, cast(sum(num_super_kmers) as bigint) num_super_kmers, max(size) max_bucket, cast(sum(num_kmers) as bigint) num_kmers, round(sum(num_kmers)::double / sum(num_super_kmers), 6) kmers_per_super_kmer from buckets)"


@query(" union all ".join(_swept(m) for m in _SWEPT))
def minimizer_sweep(spark, sf_dir):
    return M.minimizer_sweep(_bench(spark, sf_dir), list(_SWEPT))


@query(ORACLE["hit_rates_by_language"])
def exported_hit_rates(spark, sf_dir):
    """The rates written as CSV and read back."""
    path = _folder(spark)
    rates = hit_rates_by_language(spark, sf_dir)
    T.export_csv(rates, path)
    return spark.read.schema(rates.schema).option("header", True).csv(path)


@query(CTE + DOCS + " select string_id, 1::bigint places, true in_range, true known_sign from strings")
def permutation_file(spark, sf_dir):
    """The permutation written and read back: each string has one place, from 0 on, and a sign."""
    d, path = _docs(spark, sf_dir), _folder(spark)
    order, _ = O.permutation(W.endpoints(d))
    O.write_permutation(order, path)
    read = O.read_permutation(spark, path)
    n = d.strings.count()
    return read.groupBy("string_id").agg(F.count("*").alias("places"), F.bool_and((F.col("new_pos") >= 0) & (F.col("new_pos") < n)).alias("in_range"), F.bool_and(F.col("forward").isNotNull()).alias("known_sign"))


@query(CTE + _BENCH31 + f" select cast(string_id as bigint) string_id, seq, cast(length(seq) - {K - 1} as bigint) num_weights, w total from strings join (select string_id, cast(sum(weight) as bigint) w from kmers group by string_id) using (string_id)")
def permuted_fasta(spark, sf_dir):
    """Weighted strings written in their new order and orientation, read back and turned round again: strings and weights are as before."""
    d, path = _bench(spark, sf_dir, k=K, m=20), _folder(spark)
    order, _ = O.permutation(W.endpoints(d))
    write_fasta(O.apply_permutation(O.weighted_strings(d), order), path, "string_id", "seq", "new_pos", K)
    back = read_weighted_fasta(spark, path, K).withColumn("string_id", F.regexp_extract("header", r"^(\d+)", 1).cast("long")).join(order, "string_id")
    turned = S.reversed_weights(F.col("header"))
    head = F.when(F.col("forward"), F.col("header")).otherwise(turned)
    weights = F.split(F.trim(F.regexp_extract(head, r"ab:Z:([\d ]+)", 1)), " ").cast("array<bigint>")
    seq = F.when(F.col("forward"), F.col("seq")).otherwise(S.reverse_complement(F.col("seq")))
    return back.select("string_id", seq.alias("seq"), F.size(weights).cast("long").alias("num_weights"), F.aggregate(weights, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(CTE + READS + " select read_id, pos, kmer, left(kmer, 1) first_base, cast(instr('ACGT', left(kmer, 1)) - 1 as integer) code, right(kmer, 1) = 'A' ends_with_a from read_windows")
def bases_by_code(spark, sf_dir):
    """A base turned into its code and back, in the other alphabet, and the end of a k-mer."""
    e, x = "traditional", F.col("kmer")
    code = S.char_code(S.base_at(x, 0), e)
    return _windows(spark, sf_dir).select("read_id", "pos", "kmer", S.code_char(code, e).alias("first_base"), code.alias("code"), x.endswith("A").alias("ends_with_a"))


@query(CTE + DOCS + ", " + READS + ", " + f"found as ({Q.lookup('read_windows', K)}) select read_id, pos, true same, d.kmer_id is null missing from found d")
def lookups_of_both_strands_agree(spark, sf_dir):
    """A k-mer and its opposite strand are looked up in one dictionary: the results agree in all but orientation."""
    d = R.require_mode(_docs(spark, sf_dir), canonical=False)
    rows = _windows(spark, sf_dir).select("read_id", "pos", F.upper("kmer").alias("kmer"))
    one = d.lookup(rows).select("read_id", "pos", F.struct("kmer_id", "kmer_id_in_string", F.abs("kmer_orientation").alias("kmer_orientation"), "string_id", "string_begin", "string_end").alias("left"))
    other = d.lookup(rows.withColumn("kmer", S.reverse_complement(F.col("kmer")))).select("read_id", "pos", F.struct("kmer_id", "kmer_id_in_string", F.abs("kmer_orientation").alias("kmer_orientation"), "string_id", "string_begin", "string_end").alias("right"))
    return one.join(other, ["read_id", "pos"]).select("read_id", "pos", S.same_result("left", "right").alias("same"), F.col("left.kmer_id").isNull().alias("missing"))


# ---- dictionaries in the other order of bases ------------------------------------------------------------

_OTHER = "traditional"


@query(CTE + BENCH + " select kmer_id, string_id, kmer_id_in_string, kmer_offset, kmer, weight from kmers")
def kmer_table_in_the_other_alphabet(spark, sf_dir):
    d = _bench(spark, sf_dir, encoding=_OTHER)
    return d.kmers.select("kmer_id", "string_id", "kmer_id_in_string", "kmer_offset", d.kmer_strings().alias("kmer"), "weight")


@query((CTE + BENCH + ", " + Q.minimizers(SMALL_K, SMALL_M, MAGIC, True)).replace("'ACTG'", "'ACGT'") + " select * from mins")
def minimizers_in_the_other_alphabet(spark, sf_dir):
    """Minimizers, in canonical mode, of k-mers packed in the other order."""
    return M.kmer_minimizers(_bench(spark, sf_dir, encoding=_OTHER, canonical=True))


@query((CTE + BENCH + ", " + Q.reads(SMALL_K, "documents", "doc_id", False) + ", " + Q.report(SMALL_K)[0] + " " + Q.report(SMALL_K)[1]))
def read_report_in_the_other_alphabet(spark, sf_dir):
    return R.read_report(_bench(spark, sf_dir, encoding=_OTHER), reads_of(table(spark, sf_dir, "documents"), "doc_id"))


@query(CTE + BENCH + ", " + _steps("kmers", SMALL_K, keep="kmer_id from_kmer, kmer").replace("(0, 'A'), (1, 'C'), (2, 'T'), (3, 'G')", "(0, 'A'), (1, 'C'), (2, 'G'), (3, 'T')") + f" select from_kmer, kmer, direction, slot, base, neighbour, {RESULTS} from found")
def neighbours_in_the_other_alphabet(spark, sf_dir):
    d = _bench(spark, sf_dir, encoding=_OTHER)
    return d.neighbours(d.kmers.select(F.col("kmer_id").alias("from_kmer"), d.kmer_strings().alias("kmer")))

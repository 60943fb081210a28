"""WARC archives and their index: captures of one URL key in order of time, over all archives.

Archives are written by Spark's own text writer: a record is one string, and what ends a record in the format separates the lines, so writes
are committed, retried and stored as any table's are. They are read back as a stream a file and cut by the lengths that records state, so payloads
may hold anything, separators and whole records included.

A payload of some size that other captures repeat is stored once, with the largest id; the others are revisits that refer to it and keep
their HTTP header, which states the payload's length, and its digest.

The index is an external merge. The captures of each reading task are sorted and written as a run; ranges of (URL key, time, id) are cut over all runs, so a
URL that holds a third of all captures is cut too; in each range the runs' slices, some 50,000 captures, are merged by a tree of losers. Places in the whole
order and the capture before come from the ranges' counts and last captures.

Defined results: a null payload is empty; a null URL has no target line and an empty key; a null id stands in its record as ``null`` and can revisit but is
not referred to; several rows of the largest id of a payload are all responses; carriage returns and line feeds of URLs are percent-encoded; repeated rows
are a record each; other columns are never read; an empty table gives no archive and an empty index.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, written

SEPARATOR = "\r\n\r\n"
#: Bytes from which on a repeated payload is a revisit.
REVISITED = 1000
#: Captures of a range of the index, about.
RANGE = 50_000
#: Payload groups of more than this share of all rows are joined by broadcast; there are at most this many.
HOT = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: Column) -> Column:
    """Host labels in reverse order, then path and query: without scheme, user, ``www.``, port, fragment and closing slash; host in small letters."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"(?i)^[a-z][a-z0-9+.-]*://|#.*$", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^.*@|:[0-9]*$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*(.*)$", 1), "/$", "")
    return F.when(rest == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path))


def revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", at_least: int = REVISITED) -> DataFrame:
    """``pages`` with ``__size``, ``__sha1``, and ``__first``, the id of the response that a row revisits, else null."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    sized = pages.withColumns({"__size": F.length(payload).cast("long"), "__sha1": F.sha1(payload), "__same": F.sha2(payload, 256)})
    groups = sized.where(F.col("__size") >= at_least).groupBy("__same").agg(F.max(id_col).alias("__largest"), F.count("*").alias("__n"))
    groups = written(groups.where("__n > 1 and __largest is not null"), "warc-groups")
    hot = groups.where(F.col("__n") > F.lit(pages.count() // HOT))
    cold = groups.join(F.broadcast(hot.select("__same")), "__same", "left_anti")
    with_hot = sized.join(F.broadcast(hot.select("__same", F.col("__largest").alias("__hot"))), "__same", "left")
    # small payloads and those of hot groups match nothing below, and are dealt out by a number of their own
    spread = F.when((F.col("__size") >= at_least) & F.col("__hot").isNull(), F.col("__same")).otherwise(F.concat(F.lit("-"), F.xxhash64(F.col(id_col), F.monotonically_increasing_id()).cast("string")))
    found = with_hot.withColumn("__same", spread).join(cold.select("__same", "__largest"), "__same", "left")
    largest = F.coalesce("__hot", "__largest")
    return found.withColumn("__first", F.when(~F.col(id_col).eqNullSafe(largest), largest)).drop("__same", "__hot", "__largest")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", captured_at: Column | None = None) -> None:
    """Writes a record a row, in gzipped files of the tasks; times are of the column given, else the first second of 1970."""
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    rows = revisits(pages.select(F.col(id_col).alias("__id"), F.col(url_col).cast("string").alias("__url"), F.col(payload_col).cast("string").alias("__payload"), (F.timestamp_seconds(F.lit(0)) if captured_at is None else captured_at).alias("__at")), "__id", "__payload")
    again = F.col("__first").isNotNull()
    url = F.replace(F.replace(F.col("__url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("__size").cast("string"), F.lit(SEPARATOR))
    block = F.concat(http, F.when(again, "").otherwise(F.coalesce("__payload", F.lit(""))))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(again, "revisit").otherwise("response"),
        F.lit("\r\n"),
        line("WARC-Record-ID", urn("__id")),
        line("WARC-Date", F.date_format(F.to_utc_timestamp("__at", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "__sha1")),
        line("WARC-Refers-To", F.when(again, urn("__first"))),
        line("WARC-Profile", F.when(again, F.lit(PROFILE))),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.octet_length(http) + F.when(again, 0).otherwise(F.col("__size"))).cast("string"),
    )
    rows.select(F.concat(head, F.lit(SEPARATOR), block).alias("value")).write.option("lineSep", SEPARATOR).option("compression", "gzip").text(path)


class Records:
    """Cuts the stream of one archive into (fields, block) by the lengths that records state."""

    def __init__(self):
        self.held, self.head, self.size = bytearray(), None, 0

    def feed(self, piece: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        self.held += piece + b"\r\n\r\n"
        while True:
            if self.head is None:
                end = self.held.find(b"\r\n\r\n")
                if end < 0 or not self.held.strip(b"\r\n"):
                    return
                lines = self.held[:end].decode("utf-8").split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError(f"no record begins with {lines[0][:80]!r}")
                self.head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
                self.size = int(self.head["content-length"])
                del self.held[: end + 4]
            if len(self.held) < self.size + 4:
                return
            head, block = self.head, bytes(self.held[: self.size])
            del self.held[: self.size + 4]
            self.head = None
            yield head, block

    def close(self) -> None:
        if self.head is not None or self.held.strip(b"\r\n"):
            raise ValueError("an archive ends within a record")


def _id_of(urn: str | None) -> str | None:
    found = urn[len("<urn:page:") : -1] if urn else None
    return None if found == "null" else found


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """archive, number (in it), record_type, page_id (as text), url, captured_at, refers_to, payload_digest, payload_bytes and, unless left out, payload.

    A response whose payload doesn't have the digest or the length that its record states is an error.
    """
    schema = "archive string, number long, record_type string, page_id string, url string, captured_at string, refers_to string, payload_digest string, payload_bytes long" + ", payload binary" * payloads
    rows = spark.read.option("lineSep", SEPARATOR).schema("value string").text(path).select(F.col("_metadata.file_path").alias("archive"), F.col("value").cast("binary").alias("value"))

    def of(archive: str, number: int, head: dict, block: bytes) -> tuple:
        http, _, payload = block.partition(b"\r\n\r\n")
        stated = next(int(x[15:]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        digest = head["warc-payload-digest"].removeprefix("sha1:")
        if head["warc-type"] == "response" and (len(payload) != stated or hashlib.sha1(payload).hexdigest() != digest):
            raise ValueError(f"{head['warc-record-id']} is not what its record states")
        out = (archive, number, head["warc-type"], _id_of(head["warc-record-id"]), head.get("warc-target-uri"), head["warc-date"], _id_of(head.get("warc-refers-to")), digest, stated)
        return (*out, payload if head["warc-type"] == "response" else None) if payloads else out

    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64() if x.endswith("long") else pa.binary() if x.endswith("binary") else pa.string() for x in schema.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, records, number, out, held = None, Records(), 0, [], 0
        for batch in batches:
            for name, piece in zip(batch.column(0), batch.column(1), strict=True):
                if name.as_py() != archive:
                    records.close()
                    archive, records, number = name.as_py(), Records(), 0
                for head, block in records.feed(piece.as_py()):
                    out.append(of(archive, number, head, block))
                    number, held = number + 1, held + len(block)
                    if len(out) >= 2_000 or held >= 4 << 20:
                        yield batch_of(out)
                        out, held = [], 0
        records.close()
        if out:
            yield batch_of(out)

    return rows.mapInArrow(run, schema)


class LoserTree:
    """Sorted runs merged: each inner node keeps the run that lost there, so the next element costs one path of log2 k comparisons."""

    def __init__(self, runs: list[Iterator]):
        self.runs = runs
        self.heads = [next(r, None) for r in runs]
        n = len(runs)
        winners = [0] * n + list(range(n))
        self.losers = [0] * n
        for node in range(n - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._first(a, b) else (b, a)
        if n:
            self.losers[0] = winners[1] if n > 1 else 0

    def _first(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) <= (y, b))

    def __iter__(self) -> Iterator:
        n = len(self.runs)
        while n:
            won = self.losers[0]
            if self.heads[won] is None:
                return
            yield self.heads[won]
            self.heads[won] = next(self.runs[won], None)
            node = (won + n) // 2
            while node:
                if self._first(self.losers[node], won):
                    self.losers[node], won = won, self.losers[node]
                node //= 2
            self.losers[0] = won


def merged_index(captures: DataFrame, id_col: str = "page_id", captures_a_range: int = RANGE) -> DataFrame:
    """``captures`` with ``url_key``, ``place`` from 0 in the order of (URL key, time, id) and ``previous``, the id of the capture before of the same key."""
    order = ("url_key", "captured_at", id_col)
    run = captures.withColumn("url_key", url_key(F.col("url"))).sortWithinPartitions(*order)
    runs = written(run.withColumn("__seq", F.monotonically_increasing_id()), "warc-runs")  # by task, then in the order of its run
    ranges = max(1, -(-runs.count() // captures_a_range))
    slices = runs.repartitionByRange(ranges, *order).sortWithinPartitions("__seq").withColumn("__range", F.spark_partition_id())
    schema = slices.select("*", F.lit(0).cast("long").alias("__at"), F.col(id_col).alias("__before")).drop("__seq").schema
    places = [slices.columns.index(c) for c in (*order, "__seq")]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        urls, times, ids, seqs = (table.column(c).to_pylist() for c in places)
        keys = [(u, t or "", i is not None, i if i is not None else 0) for u, t, i in zip(urls, times, ids, strict=True)]
        cuts = [0, *(i for i in range(1, len(seqs)) if seqs[i] >> 33 != seqs[i - 1] >> 33), len(seqs)]
        taken = [at for _, at in LoserTree([((keys[i], i) for i in range(a, b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])]
        before = [ids[taken[j - 1]] if j and urls[taken[j - 1]] == urls[taken[j]] else None for j in range(len(taken))]
        out = table.drop_columns(["__seq"]).take(pa.array(taken, pa.int64()))
        out = out.append_column("__at", pa.array(range(len(taken)), pa.int64())).append_column("__before", pa.array(before, table.column(places[2]).type))
        yield from out.combine_chunks().to_batches(max_chunksize=10_000)

    index = written(slices.mapInArrow(merge, schema), "warc-index")
    # a row a range: where it begins, and the last capture before it
    ends = index.groupBy("__range").agg(F.count("*").alias("n"), F.max_by(F.struct("url_key", F.col(id_col).alias("id")), "__at").alias("last"))
    before = Window.orderBy("__range")
    ends = ends.select("__range", F.coalesce(F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"), F.lag("last").over(before).alias("__last"))
    joined = index.join(F.broadcast(ends), "__range")
    previous = F.when((F.col("__at") == 0) & (F.col("__last.url_key") == F.col("url_key")), F.col("__last.id")).otherwise(F.col("__before"))
    return joined.withColumns({"place": F.col("__base") + F.col("__at"), "previous": previous}).drop("__range", "__at", "__before", "__base", "__last")


def capture_histories(pages: DataFrame, path: str | None = None, captured_at: Column | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes archives, reads them back and merges their index: a row a record, without payloads, with ids of the type that they had."""
    spark, kind = pages.sparkSession, pages.schema[id_col].dataType.simpleString()
    path = path or f"{shared_dir(spark)}/strandix/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, id_col, url_col, payload_col, captured_at)
    read = read_archives(spark, path, payloads=False)
    return merged_index(read.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")}))


def op11_warc_histories(spark, sf_dir):
    """Each page's record and its place among all captures; pages have no time, so their ids stand for the seconds of a crawl."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = capture_histories(pages, captured_at=F.timestamp_seconds(F.coalesce("page_id", F.lit(0))))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "place", F.col("previous").alias("previous_id"))


def oracle_sql(at_least: int = REVISITED) -> str:
    """Groups of equal payloads, and captures ordered as a whole; ids are distinct."""
    rest = "regexp_replace(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://|#.*$', '', 'g')"
    host = "regexp_replace(regexp_replace(lower(regexp_extract(r, '^([^/?]*)', 1)), '^.*@|:[0-9]*$', '', 'g'), '^www\\.', '')"
    key = f"case when r = '' then '' else array_to_string(list_reverse(string_split({host}, '.')), ',') || ')' || regexp_replace(regexp_extract(r, '^[^/?]*(.*)$', 1), '/$', '') end"
    return (
        f"with p as (select page_id, coalesce(html, '') h, {rest} r from pages), "
        f"s as (select page_id, octet_length(encode(h)) n, sha1(h) d, {key} k, max(page_id) over (partition by h) largest from p), "
        f"t as (select *, n >= {at_least} and page_id <> largest again from s) "
        "select page_id, n::bigint payload_bytes, d payload_digest, case when again then 'revisit' else 'response' end record_type, case when again then largest end refers_to, "
        "row_number() over (order by k, page_id) - 1 place, lag(page_id) over (partition by k order by page_id) previous_id from t"
    )

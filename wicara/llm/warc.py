"""WARC archives and their index: sorted capture runs merged into one global order.

Pages become WARC records, written as archive files by Spark's text writer (a record ends with the
line feed the writer adds). Of records with equal payloads of at least
``REVISIT_BYTES`` the one with the largest page id is the response; the others are revisits that
refer to it. Each archive yields a capture run, locally sorted by URL key and time. A range shuffle
hands every index partition one slice of each run; a loser tree merges the k slices, so the index is
globally ordered without sorting it again.

Defined results: a null html is an empty payload, a null url an empty URL; rows without a page id
are responses; rows that repeat the responding page's id are responses too. Columns other than the
three named are not read.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wicara.llm.common import Scratch, lean

REVISIT_BYTES = 1000
FIRST_CAPTURE = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)  # plus one second per page id
SECONDS = 10 * 365 * 86_400
RECORDS_PER_ARCHIVE = 5_000  # an archive is read by one task as a whole
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEAD = re.compile(rb"WARC/1\.1\r\n(?:[^\r\n]+\r\n)+\r\n")
_HEADER = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


def url_key(url: Column) -> Column:
    """Sort key of a URL: reversed host, then port, path and query; scheme, www and fragment dropped."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, r"^(?:[^/?]*@)?(?:www\d*\.)?([^/?:]*)", 1))
    rest = F.regexp_extract(bare, r"^[^/?:]*(?::\d+)?(.*)$", 1)
    path = F.when(rest == "", "/").otherwise(F.lower(rest))
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path)


def responses(payloads: DataFrame) -> DataFrame:
    """(digest, refers_to): the largest page id of each long payload that occurs more than once."""
    return (
        payloads.where((F.col("bytes") >= REVISIT_BYTES) & F.col("page").isNotNull())
        .groupBy("digest")
        .agg(F.max("page").alias("refers_to"), F.count("*").alias("copies"))
        .where("copies > 1")
        .select("digest", "refers_to")
    )


def record_rows(
    pages: DataFrame, scratch: Scratch, page_id: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """One text row per WARC record.

    The responses that have revisits are written first: a table of known size, which pages meet by
    digest, and no payload is moved for a table small enough to be sent to every task.
    """
    body = F.coalesce(pages[html].cast("string"), F.lit(""))
    rows = pages.select(
        pages[page_id].cast("long").alias("page"),
        F.coalesce(pages[url].cast("string"), F.lit("")).alias("url"),
        body.alias("body"),
        F.sha1(body.cast("binary")).alias("digest"),
        F.octet_length(body).alias("bytes"),
    )
    known = rows.join(scratch.write(responses(rows.drop("url", "body")), "responses"), "digest", "left")
    revisit = F.col("refers_to").isNotNull() & (F.col("page") != F.col("refers_to")) & (F.col("bytes") >= REVISIT_BYTES)
    revisit = F.coalesce(revisit, F.lit(False))
    ident = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    second = F.pmod(F.coalesce("page", F.lit(0)), F.lit(SECONDS))
    when = F.date_format(
        F.timestamp_seconds(F.lit(int(FIRST_CAPTURE.timestamp())) + second), "yyyy-MM-dd'T'HH:mm:ss'Z'"
    )
    payload = F.when(revisit, F.lit("")).otherwise(F.col("body"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    safe = F.regexp_replace("url", "[\r\n]", "")
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", ident(F.col("page"))),
        line("WARC-Target-URI", safe),
        line("WARC-Date", when),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(revisit, line("WARC-Refers-To", ident(F.col("refers_to")))).otherwise(""),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}\r\n")).otherwise(""),
        line("X-URL-Key", url_key(safe)),
        line("X-Payload-Length", F.col("bytes").cast("string")),
        line("Content-Length", F.octet_length(payload).cast("string")),
        F.lit("\r\n"),
        payload,
        F.lit("\r\n\r"),  # the writer's line feed completes the record
    )
    return known.select(record.alias("value"))


def write_archives(pages: DataFrame, scratch: Scratch, files: int | None = None, **names: str) -> str:
    """Write the records of ``pages``, dealt to ``files`` tasks or as they lie; a task's
    records fill archives of at most ``RECORDS_PER_ARCHIVE``."""
    rows, path = record_rows(pages, scratch, **names), scratch.path("archives")
    dealt = rows.repartition(files) if files else rows
    dealt.write.mode("overwrite").option("maxRecordsPerFile", RECORDS_PER_ARCHIVE).text(path)
    return path


def parse_records(data) -> Iterator[tuple[int, dict[str, str], memoryview]]:
    """(offset, headers, payload) of every record of an archive; lengths, not marks, end payloads.

    ``data`` is any buffer; it is not copied.
    """
    at, whole = 0, memoryview(data)
    while at < len(whole):
        start, head = at, _HEAD.match(whole, at)
        if not head:
            raise ValueError(f"no WARC record at offset {at}")
        headers = {k.decode(): v.decode() for k, v in _HEADER.findall(head.group())}
        at = head.end() + int(headers["Content-Length"])
        yield start, headers, whole[head.end() : at]
        if whole[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"record at offset {start} does not end where its length says")
        at += 4


_ENTRY = (
    "urlkey string, captured string, page_id long, record_type string, payload_bytes long, "
    "payload_digest string, refers_to long, url string, file string, position long"
)
ENTRY_COLUMNS = [c.split()[0] for c in _ENTRY.split(", ")]


def _number(ident: str) -> int | None:
    digits = ident.removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def _packed(entries: list[tuple]):
    import pyarrow as pa

    kinds = {"string": pa.string(), "long": pa.int64()}
    types = [kinds[c.split()[1]] for c in _ENTRY.split(", ")]
    columns = zip(zip(*entries, strict=True), types, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=ENTRY_COLUMNS)


@lean
def _runs(batches):
    """Archives (path, content) to their capture entries, each archive's sorted by key and time."""
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            run = []
            for position, head, payload in parse_records(content.as_buffer()):
                digest = hashlib.sha1(payload).hexdigest()
                response = head["WARC-Type"] == "response"
                if response and head["WARC-Payload-Digest"] != f"sha1:{digest}":
                    raise ValueError(f"payload digest differs at offset {position} of {path}")
                run.append(
                    (
                        head["X-URL-Key"],
                        head["WARC-Date"],
                        _number(head["WARC-Record-ID"]),
                        head["WARC-Type"],
                        len(payload) if response else int(head["X-Payload-Length"]),
                        head["WARC-Payload-Digest"].removeprefix("sha1:"),
                        None if response else _number(head["WARC-Refers-To"]),
                        head["WARC-Target-URI"],
                        path.rsplit("/", 1)[-1],
                        position,
                    )
                )
            run.sort(key=order_of)
            for i in range(0, len(run), 2000):
                yield _packed(run[i : i + 2000])


def order_of(entry: tuple) -> tuple:
    """URL key, time, then archive and offset, which are unique."""
    return entry[0], entry[1], entry[8], entry[9]


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The capture run of every archive below ``path``; one task reads one archive."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_runs, _ENTRY)


def loser_tree_merge(runs: list[Iterator], key) -> Iterator:
    """Merge sorted iterators; each inner node keeps the loser of its match, so an item costs log k
    comparisons along one path."""
    k, done = len(runs), (1,)
    heads = [next(r, None) for r in runs]
    keys = [done if h is None else (0, key(h)) for h in heads]
    losers = [-1] * k

    def play(leaf: int) -> int:
        """Climb from a leaf; the winner, or -1 if the leaf waits in a node without an opponent yet."""
        winner, node = leaf, (leaf + k) // 2
        while node:
            other = losers[node]
            if other < 0:
                losers[node] = winner
                return -1
            if (keys[other], other) < (keys[winner], winner):
                losers[node], winner = winner, other
            node //= 2
        return winner

    winner = -1
    for leaf in range(k):
        winner = play(leaf)  # the last leaf finds every node taken
    while k and keys[winner] != done:
        yield heads[winner]
        heads[winner] = next(runs[winner], None)
        keys[winner] = done if heads[winner] is None else (0, key(heads[winner]))
        winner = play(winner)


@lean
def _merge(batches):
    """The slices of the runs, as they arrive, to one ordered sequence."""
    slices: list[list[tuple]] = []
    last = None
    for batch in batches:
        for entry in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not slices or entry[8] != slices[-1][-1][8] or order_of(entry) < last:
                slices.append([])
            slices[-1].append(entry)
            last = order_of(entry)
    out = []
    for entry in loser_tree_merge([iter(s) for s in slices], order_of):
        out.append(entry)
        if len(out) == 2000:
            yield _packed(out)
            out = []
    if out:
        yield _packed(out)


def merge_runs(runs: DataFrame, partitions: int | None = None) -> DataFrame:
    """The global index: partitions in key order, entries in key and time order within.

    A map task keeps the order of its run, so every index partition receives sorted slices; it holds
    the entries of one key range, and captures of one URL key are split by time.
    """
    order = ["urlkey", "captured", "file", "position"]
    dealt = runs.repartitionByRange(partitions, *order) if partitions else runs.repartitionByRange(*order)
    return dealt.mapInArrow(_merge, _ENTRY)


def capture_index(pages: DataFrame, files: int | None = None, partitions: int | None = None, **names: str) -> DataFrame:
    """Write the archives, read them back and merge their runs; one row per page.

    ``part`` numbers the index partitions in key order; each is stored in key and time order.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    runs = scratch.write(read_runs(spark, write_archives(pages, scratch, files, **names)), "runs")
    return scratch.finish(merge_runs(runs, partitions).withColumn("part", F.spark_partition_id()), "index")

"""WARC archives: pages written as records by Spark's text writer, and read back by verified chains of record boundaries.

A record is a header, a block and two line ends, so the text writer with a separator of two line ends writes archives into
any store. Payloads of SHARED bytes or more that are equal are stored once: the page with the largest page_id is the
response, the others are revisits that refer to it and hold the HTTP header alone.

Reading doesn't trust the magic, which payloads may hold too. Tasks read ranges of the files, wherever those begin. Each
finds the candidates in its range, their headers and the offset of the record behind each of them, and follows these inside
the range to the offset at which the chain leaves it. Pointer jumping over those exits, from each file's first byte, says
which ranges are entered where; a record counts if the chain from there reaches it. So a whole archive inside a payload
stays payload. Where a chain breaks off, what stands behind isn't read: `chains` tells such files.

Files are read through pyarrow's file systems (file, hdfs, s3, gs, abfs), uncompressed. A header line of more than LINE bytes
is none. Null and empty payloads are records without payload. A very long payload is read whole, by one task. Rows that
repeat a page_id are a record each; those that repeat the largest one of equal payloads are all responses. A null page_id
counts as the smallest. A null url leaves its field out. An empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, pick, shared_dir

SHARED = 1000
#: Groups of equal payloads that are sent to every task; more of them are joined by a shuffle.
SENT_GROUPS = 100_000
RANGE = 16 << 20
LINE = 1 << 20
#: Tasks of a scan, at most, and payload bytes of a batch.
TASKS = 20_000
BATCH = 4 << 20
END = "\r\n"
_MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
_LONGEST = 10


def record(page_id: Column, url: Column, payload: Column, kept: Column, date: str) -> Column:
    """The record of a page, without the two line ends behind it; `kept` is the page that a revisit refers to, else null."""
    name = lambda page: F.concat(F.lit("<urn:x-page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))
    line = lambda field, value: F.concat(F.lit(f"{field}: "), value, F.lit(END))
    size = F.octet_length(payload).cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}"), line("Content-Length", size), F.lit(END))
    block = F.when(kept.isNull(), F.concat(http, payload)).otherwise(http)
    target = F.regexp_replace(F.regexp_replace(url, "\r", "%0D"), "\n", "%0A")
    return F.concat(
        F.lit(f"WARC/1.1{END}"),
        line("WARC-Type", F.when(kept.isNull(), F.lit("response")).otherwise(F.lit("revisit"))),
        line("WARC-Record-ID", name(page_id)),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", target), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.sha1(payload.cast("binary")))),
        F.when(kept.isNull(), F.lit("")).otherwise(F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", name(kept)))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(END),
        block,
    )


def write(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """Archives of the pages (page_id, url, html), one file for each task."""
    rows = pick(pages, "page_id", "url", "html").withColumn("html", F.coalesce("html", F.lit("")))
    large = F.octet_length("html") >= SHARED
    rows = rows.withColumn("same", F.when(large, F.unhex(F.sha2("html", 256))))
    groups = rows.filter(large).groupBy("same").agg(F.max("page_id").alias("kept"), F.count("*").alias("n"))
    groups = cut(groups.filter("n > 1").select("same", "kept"))
    if groups.count() <= SENT_GROUPS:
        groups = F.broadcast(groups)
    rows = rows.join(groups, "same", "left")
    kept = F.when(F.col("kept").eqNullSafe(F.col("page_id")), None).otherwise(F.col("kept"))
    told = rows.select(record(F.col("page_id"), F.col("url"), F.col("html"), kept, date))
    told.write.option("lineSep", END * 2).text(path)


class Archive:
    """Bytes of a file by offset; those from `start` on are read ahead, `ahead` of them."""

    def __init__(self, path: str, start: int, ahead: int):
        scheme, _, rest = path.partition(":")
        if scheme == "file" or path.startswith("/"):
            store, name = fs.LocalFileSystem(), re.sub("^/+", "/", rest if scheme == "file" else path)
        else:
            store, name = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))
        self.file, self.start = store.open_input_file(name), start
        self.size = self.file.size()
        self.held = self.file.read_at(max(0, min(ahead, self.size - start)), start)

    def at(self, offset: int, n: int) -> bytes:
        i = offset - self.start
        return self.held[i : i + n] if 0 <= i and i + n <= len(self.held) else self.file.read_at(max(0, min(n, self.size - offset)), offset)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()


def header(get, offset: int) -> tuple[dict[str, str], int] | None:
    """The fields (names in lower case) of lines up to an empty one, and where the next byte stands; None if it isn't one."""
    fields: dict[str, str] = {}
    have, at, step = get(offset, 2048), 0, 2048
    last = None
    while True:
        end = have.find(b"\r\n", at)
        if end < 0:
            if len(have) - at > LINE or len(have) < step:
                return None
            step *= 2
            have = get(offset, step)
            continue
        line = have[at:end].decode("utf-8", "replace")
        at = end + 2
        if not line:
            return fields, offset + at
        if line[0] in " \t" and last:
            fields[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon or not name.strip() or " " in name.strip():
            return None
        last = name.strip().lower()
        fields[last] = value.strip()


_FIELDS = ("warc-type", "warc-record-id", "warc-target-uri", "warc-payload-digest", "warc-refers-to", "content-type")
_CANDIDATE = "file string, range long, offset long, next long, body long, length long, size long, exit long, type string, record_id string, target_uri string, digest string, refers_to string, content_type string"
_KINDS = [pa.string() if x.endswith("string") else pa.int64() for x in _CANDIDATE.split(", ")]
_NAMES = [x.split()[0] for x in _CANDIDATE.split(", ")]


def candidates(file: str, start: int, most: int) -> list[tuple]:
    """What looks like a record in a range, in order, each with the offset at which its chain leaves the range."""
    found = []
    with Archive(file, start, most + _LONGEST - 1 + 4096) as archive:
        for m in _MAGIC.finditer(archive.held, 0, most + _LONGEST - 1):
            offset = start + m.start()
            told = header(archive.at, offset + _LONGEST)
            if told is None or not re.fullmatch("[0-9]{1,18}", told[0].get("content-length", "")):
                continue
            length, body = int(told[0]["content-length"]), told[1]
            if body + length <= archive.size:
                found.append((offset, min(body + length + 4, archive.size), body, length, archive.size, *(told[0].get(f) for f in _FIELDS)))
    out: dict[int, int] = {}
    for offset, behind, *_ in reversed(found):
        out[offset] = out.get(behind, behind)
    return [(file, start, *x[:5], out[x[0]], *x[5:]) for x in found]


def scan(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The candidates of all files below a path, and the number of tasks that their ranges deserve."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length").filter("length > 0")
    ranges = files.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(RANGE).cast("long"))).alias("range"))
    tasks = max(1, min(ranges.count(), TASKS))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if rows := candidates(file, start, RANGE):
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], _NAMES)

    return cut(ranges.repartition(tasks).mapInArrow(find, _CANDIDATE)), tasks


def entries(found: DataFrame) -> DataFrame:
    """file, offset: where the chains from the files' first bytes enter ranges, by pointer jumping over the exits."""
    reached = cut(found.filter("offset = 0").select("file", "offset"))
    targets = found.select("file", F.col("exit").alias("offset")).distinct().unionByName(reached).distinct()
    links = cut(found.select("file", "offset", "exit").join(targets, ["file", "offset"], "left_semi"))
    n = reached.count()
    while True:
        steps = reached.join(links, ["file", "offset"]).select("file", F.col("exit").alias("offset"))
        reached = cut(reached.unionByName(steps.join(links, ["file", "offset"], "left_semi")).distinct())
        if (now := reached.count()) == n:
            return reached
        n = now
        further = links.select("file", F.col("offset").alias("exit"), F.col("exit").alias("behind"))
        links = cut(links.join(further, ["file", "exit"], "left").select("file", "offset", F.coalesce("behind", "exit").alias("exit")))


def reachable(found: DataFrame, tasks: int) -> DataFrame:
    """The candidates on the chains, in order of their offsets within each range; a task has whole ranges."""
    flagged = found.join(entries(found).withColumn("entered", F.lit(True)), ["file", "offset"], "left").select(*_NAMES, "entered")

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, due = None, None
        for batch in batches:
            keep = []
            columns = (batch.column(c).to_pylist() for c in ("file", "range", "offset", "next", "entered"))
            for file, start, offset, behind, entered in zip(*columns, strict=True):
                if (file, start) != place:
                    place, due = (file, start), None
                keep.append(bool(entered) or offset == due)
                if keep[-1]:
                    due = behind
            yield batch.select(_NAMES).filter(pa.array(keep))

    return flagged.repartition(tasks, "file", "range").sortWithinPartitions("file", "range", "offset").mapInArrow(follow, _CANDIDATE)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives below a path: its fields, its payload (without an HTTP header), and http_length, which
    the HTTP header gives as the payload's bytes; `file` and `offset` say where it stands."""
    found, tasks = scan(spark, path)
    plain = ["file", "offset", "type", "record_id", "target_uri", "digest", "refers_to", "content_type"]
    kinds = [pa.int64() if n == "offset" else pa.string() for n in plain]
    schema = ", ".join(f"{n} {'long' if n == 'offset' else 'string'}" for n in plain) + ", http_length long, payload binary"

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def told() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [*kinds, pa.int64(), pa.binary()], strict=True)], [*plain, "http_length", "payload"])

        place, archive = None, None
        try:
            for batch in batches:
                for r in batch.to_pylist():
                    if (r["file"], r["range"]) != place:
                        place = (r["file"], r["range"])
                        if archive is not None:
                            archive.file.close()
                        archive = Archive(r["file"], r["offset"], r["range"] + RANGE - r["offset"])
                    payload, http_length = archive.at(r["body"], r["length"]), None
                    if (r["content_type"] or "").startswith("application/http"):
                        first = payload.find(b"\r\n") + 2
                        http = header(lambda o, n, p=payload: p[o : o + n], first) if first > 1 else None
                        if http is not None:
                            payload, length = payload[http[1] :], http[0].get("content-length", "")
                            http_length = int(length) if re.fullmatch("[0-9]{1,18}", length) else None
                    rows.append((*(r[n] for n in plain), http_length, payload))
                    held += len(payload)
                    if held > BATCH or len(rows) >= 1000:
                        yield told()
                        rows, held = [], 0
            if rows:
                yield told()
        finally:
            if archive is not None:
                archive.file.close()

    return reachable(found, tasks).mapInArrow(fetch, schema)


def chains(spark: SparkSession, path: str) -> DataFrame:
    """file, n (records), end (where its chain stops) and size of every file that has a record; a whole one's end is its size."""
    found, tasks = scan(spark, path)
    return reachable(found, tasks).groupBy("file").agg(F.count("*").alias("n"), F.max("next").alias("end"), F.max("size").alias("size"))


def op12_warc(spark, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    found = read(spark, path)
    page = lambda c: F.regexp_extract(c, "^<urn:x-page:(-?[0-9]+)>$", 1).try_cast("long")
    revisit = F.col("type") == "revisit"
    own, told = F.sha1("payload"), F.regexp_replace("digest", "^sha1:", "")
    return found.select(
        page("record_id").alias("page_id"),
        F.when(revisit, F.col("http_length")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(revisit, told).otherwise(own).alias("payload_digest"),
        F.col("type").alias("record_type"),
        page("refers_to").alias("refers_to"),
        (revisit | (own == told)).alias("intact"),
    )

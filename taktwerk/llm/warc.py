"""WARC: records written as whole-file gzip streams, normalised to a member for each record with a sidecar offset index, and read back."""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote_plus

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taktwerk.llm.common import BROADCAST_ROWS, written

END = b"\r\n\r\n"  # of a header, and of a record
STEP = 1 << 20
SALTS = 32
INDEX = "archive string, offset long, length long, record_id string, type string, target string"
READ = T.StructType(
    [
        T.StructField("page_id", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def with_types(pages: DataFrame, least_bytes: int, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Adds digest, n_bytes and `first`: the largest page_id among equal payloads, null where a payload is single or short.

    Repeated payloads are found from digests alone; they come back by broadcast if they are few, else to rows dealt over SALTS parts of
    each digest, so that no payload's copies meet in one task.
    """
    hashed = pages.withColumns({"digest": F.sha1("payload"), "n_bytes": F.octet_length("payload").cast("long")})
    groups = hashed.filter(F.col("n_bytes") >= least_bytes).groupBy("digest", "n_bytes").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    again = written(groups.filter("n > 1").drop("n"))
    if again.count() <= broadcast_rows:
        return hashed.join(F.broadcast(again), ["digest", "n_bytes"], "left")
    again = again.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
    return hashed.withColumn("salt", salt).join(again, ["digest", "n_bytes", "salt"], "left").drop("salt")


def record(date: str) -> Column:
    """The text of a row's record, but for the empty lines at its end."""
    line = "\r\n"

    def name(page_id: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.url_encode(page_id.cast("string")), F.lit("")), F.lit(":"), F.col("digest"), F.lit(">"))

    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{line}Content-Type: text/html; charset=utf-8{line}Content-Length: "), F.col("n_bytes").cast("string"), F.lit(line * 2)
    )
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    url = F.regexp_replace(F.regexp_replace(F.col("url"), "\r", "%0D"), "\n", "%0A")
    return F.concat(
        F.lit(f"WARC/1.1{line}WARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{line}WARC-Record-ID: "),
        name(F.col("page_id")),
        F.lit(f"{line}WARC-Date: {date}"),
        F.coalesce(F.concat(F.lit(f"{line}WARC-Target-URI: "), url), F.lit("")),
        F.lit(f"{line}WARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.when(
            revisit,
            F.concat(
                F.lit(f"{line}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{line}WARC-Refers-To: "), name(F.col("first"))
            ),
        ).otherwise(""),
        F.lit(f"{line}Content-Type: application/http; msgtype=response{line}Content-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(line * 2),
        block,
    )


def write_archives(
    pages: DataFrame,
    folder: str,
    page_id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_bytes: int = 1000,
    date: str = "2000-01-01T00:00:00Z",
    max_records: int = 100_000,
    broadcast_rows: int = BROADCAST_ROWS,
) -> None:
    """Writes a record for each row, a file for each task, each file one gzip stream.

    A row without payload has an empty one. Of equal payloads of least_bytes or more the row with the largest id is the response, and
    the others revisit it and leave the payload out; rows that share that id, too, are responses each. A row without id counts as
    smaller than any other. The separator of the text source is what ends a WARC record.
    """
    rows = pages.select(F.col(page_id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("payload"))
    texts = with_types(rows, least_bytes, broadcast_rows).select(record(date).alias("value"))
    texts.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", max_records).text(folder)


class Inflated:
    """The bytes of a gzip stream of one member or more, inflated once as they are asked for; STEP of them at a time are held."""

    def __init__(self, stream):
        self.stream, self.inflate, self.raw, self.held, self.done = stream, zlib.decompressobj(31), b"", bytearray(), False

    def more(self) -> bool:
        while not self.done:
            if not self.raw:
                self.raw = self.stream.read(STEP)
                if not self.raw:
                    self.done = True
                    if not self.inflate.eof:
                        raise ValueError("the gzip stream ends early")
                    return False
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
            got = self.inflate.decompress(self.raw, STEP)
            self.raw = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            if got:
                self.held += got
                return True
        return False

    def header(self) -> bytes | None:
        """All up to the next empty line, with it; None at the end. Empty lines before it are passed over."""
        at = 0
        while True:
            while self.held[:2] == b"\r\n":
                del self.held[:2]
            end = self.held.find(END, at)
            if end >= 0:
                out = bytes(self.held[: end + 4])
                del self.held[: end + 4]
                return out
            at = max(len(self.held) - 3, 0)
            if not self.more():
                if self.held.strip(b"\r\n"):
                    raise ValueError("the archive ends within a header")
                return None

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes, in pieces."""
        while n:
            if not self.held and not self.more():
                raise ValueError("the archive ends within a record")
            piece = bytes(self.held[:n])
            del self.held[:n]
            n -= len(piece)
            yield piece


def fields(header: bytes) -> dict[str, str]:
    """The named fields of a header, names in lower case."""
    lines = header.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def rewrite(source: str, target: str) -> tuple[int, int]:
    """Rewrites an archive, each record as a member of its own, and writes the index beside it; the numbers of records and bytes.

    Both files get their names when they are whole, so a task that fails leaves none, and one that runs again gives the same.
    """
    (system, path), (to, out_path) = opened(source), opened(target)
    spare = f"{out_path.rpartition('/')[0]}/_{uuid.uuid4().hex}"
    at = n = 0
    with system.open_input_stream(path, compression=None) as raw, to.open_output_stream(spare, compression=None) as out, to.open_output_stream(f"{spare}.idx", compression=None) as index:
        stream = Inflated(raw)
        while (head := stream.header()) is not None:
            own = fields(head)
            deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
            size = out.write(deflate.compress(head))
            for piece in stream.take(int(own["content-length"])):
                size += out.write(deflate.compress(piece))
            size += out.write(deflate.compress(END) + deflate.flush())
            row = {"archive": target, "offset": at, "length": size, "record_id": own.get("warc-record-id"), "type": own.get("warc-type"), "target": own.get("warc-target-uri")}
            index.write(json.dumps(row).encode() + b"\n")
            at, n = at + size, n + 1
    to.move(spare, out_path)
    to.move(f"{spare}.idx", f"{out_path}.idx.json")
    return n, at


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Normalises every *.gz of a folder, a file a task at a time, in bounded memory; returns the index, a row a record.

    A damaged file fails the job and names no archive. A folder without archives gives an empty index.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path")
    system, path = opened(target)
    system.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.column(0).to_pylist():
                name = one.rpartition("/")[2].removesuffix(".gz").removesuffix(".txt")
                n, size = rewrite(one, f"{target}/{name}.warc.gz")
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["n", "size"])

    done = files.mapInArrow(run, "n long, size long").agg(F.sum("n")).first()[0]
    if not done:
        return spark.createDataFrame([], INDEX)
    return spark.read.schema(INDEX).json(f"{target}/*.idx.json")


def parsed(raw: bytes) -> tuple:
    """A record's values, its payload held against the digest that its header gives."""
    data = zlib.decompress(raw, 31)
    cut = data.index(END) + 4
    head = fields(data[:cut])
    block = data[cut : cut + int(head["content-length"])]
    http = block.index(END) + 4
    n_bytes, payload = int(fields(block[:http])["content-length"]), block[http:]
    digest = head["warc-payload-digest"].removeprefix("sha1:")

    def page(record_id: str | None) -> str | None:
        return unquote_plus(record_id.removeprefix("<urn:page:").rpartition(":")[0]) or None if record_id else None

    if head["warc-type"] == "revisit":
        return page(head["warc-record-id"]), head.get("warc-target-uri"), n_bytes, digest, "revisit", page(head["warc-refers-to"]), None
    found = hashlib.sha1(payload).hexdigest()
    if found != digest or len(payload) != n_bytes:
        raise ValueError(f"the payload of {head['warc-record-id']} isn't the one that was written")
    return page(head["warc-record-id"]), head.get("warc-target-uri"), n_bytes, found, head["warc-type"], None, payload


def read_back(index: DataFrame, task_bytes: int = 4 << 20, with_payload: bool = True) -> DataFrame:
    """The records that an index names, read from their offsets: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    Records are dealt by stretches of task_bytes of an archive, each read in its order. A revisit has no payload of its own, but the
    size and digest of the one it refers to.
    """
    total = index.agg(F.sum("length")).first()[0] or 0
    schema = READ if with_payload else T.StructType(READ.fields[:-1])
    n = max(total // task_bytes, index.sparkSession.sparkContext.defaultParallelism)
    places = index.select("archive", "offset", "length").repartition(int(n), "archive", F.floor(F.col("offset") / task_bytes)).sortWithinPartitions("archive", "offset")
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()][: len(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for archive, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if archive != name:
                    system, path = opened(archive)
                    name, file = archive, system.open_input_file(path)
                file.seek(offset)
                rows.append(parsed(file.read(length))[: len(schema)])
                size += length
                if size > STEP:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=schema.names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=schema.names)

    return places.mapInArrow(run, schema)

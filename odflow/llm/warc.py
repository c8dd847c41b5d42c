"""WARC archives in Zstandard: one frame a record, the dictionary in a leading skippable frame.

Writing: each task trains a dictionary on the first records of an archive, writes it as a skippable frame (magic 0x184D2A5D),
then every record as a frame of its own, and starts a new archive when one is full. Archives are files in a folder that all
machines reach, under names of their own for every attempt, so a task that runs again leaves at most a file that nothing
lists. Reading: a task opens an archive as a stream, takes the dictionary from the leading frame (plain, or compressed itself),
and decodes one frame at a time; it holds a block of the file and one record. Headers, lengths and digests of every record are
checked, and a record that fails is a row that says why.

Paths are URIs that Arrow's file systems can open (file, hdfs, s3, gs). Other skippable frames are passed over.
"""

from __future__ import annotations

import hashlib
import re
import struct
import urllib.parse
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odflow.llm.common import shared_dir, stored

DICTIONARY, FRAME, TRAINED = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
#: A page's record is urn:page:<page_id>.
NAME = "urn:page:"
#: An archive ends at so many bytes; its dictionary has at most DICTIONARY_BYTES and is trained on the first SAMPLE_BYTES of its
#: records. The dictionary changes the size of an archive only, never what is read back.
ARCHIVE_BYTES, DICTIONARY_BYTES, SAMPLE_BYTES = 64 << 20, 32 << 10, 2 << 20
#: A shared payload refers to the first one from this size on.
LEAST_SHARED = 100
SALTS = 64

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = (
    "archive string, place long, record_id string, record_type string, target_uri string, date string, refers_to string, "
    "payload_digest string, payload_bytes long, payload binary, error string"
)


class Malformed(ValueError):
    """A record or archive that breaks a rule; the message names it."""


# ------------------------------------------------------------------------------------------------------------- writing


def record_bytes(name: str, uri: str | None, payload: bytes, digest: str, size: int, refers_to: str | None, date: str) -> bytes:
    """A response record, or a revisit of ``refers_to`` whose block keeps the HTTP header of the full payload only.

    White space and control characters of the URI are percent-encoded; without a URI, the record's own name stands there.
    """
    uri = urllib.parse.quote(uri, safe="".join(map(chr, range(33, 127)))) if uri else name
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{name}>", f"WARC-Target-URI: {uri}",
        f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        *([f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"] if refers_to else []),
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _trained(records: list[bytes]):
    """A dictionary for such records, or None where they are too few or too much alike to train one."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records)
    except zstandard.ZstdError:
        return None


class ArchiveWriter:
    """Writes records to one file: the dictionary's frame as soon as the sample is full, then a frame a record."""

    def __init__(self, filesystem, path: str, level: int = 3):
        self.out = filesystem.open_output_stream(path, compression=None)
        self.level, self.packer, self.sample, self.frames, self.bytes = level, None, [], 0, 0
        self.sampled = 0

    def add(self, record: bytes) -> None:
        if self.packer is not None:
            self._put(self.packer.compress(record))
            self.frames += 1
            return
        self.sample.append(record)
        self.sampled += len(record)
        if self.sampled >= SAMPLE_BYTES:
            self._start()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def _start(self) -> None:
        import zstandard

        words = _trained(self.sample)
        self.packer = zstandard.ZstdCompressor(level=self.level, dict_data=words, write_checksum=True, write_content_size=True)
        if words is not None:
            raw = words.as_bytes()
            self._put(struct.pack("<II", DICTIONARY, len(raw)) + raw)
        for record in self.sample:
            self.add(record)
        self.sample = []

    def close(self) -> None:
        if self.packer is None:
            self._start()
        self.out.close()


def write_archives(records: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives in ``folder`` of rows (name, uri, html, digest, size, refers_to): a DataFrame of (archive, frames, bytes), written.

    Null html is an empty payload; refers_to null makes a response. The list is written as a table, so the archives are made once.
    """

    def write(batches):
        import pyarrow as pa
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        writer, done = None, []

        def closed():
            writer.close()
            done.append((f"{folder.rstrip('/')}/{at}", writer.frames, writer.bytes))

        for batch in batches:
            for row in range(batch.num_rows):
                name, uri, html, digest, size, refers_to = (batch.column(c)[row].as_py() for c in range(6))
                if writer is None:
                    system.create_dir(root, recursive=True)
                    at = f"{uuid.uuid4().hex}.warc.zst"
                    writer = ArchiveWriter(system, f"{root.rstrip('/')}/{at}")
                writer.add(record_bytes(name, uri, (html or "").encode(), digest, size, refers_to, date))
                if writer.bytes >= archive_bytes:
                    closed()
                    writer = None
        if writer is not None:
            closed()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), *(pa.array([d[k] for d in done], pa.int64()) for k in (1, 2))], ["archive", "frames", "bytes"])

    return stored(records.select("name", "uri", "html", "digest", "size", "refers_to").mapInArrow(write, "archive string, frames long, bytes long"))


# ------------------------------------------------------------------------------------------------------------- reading


def _exactly(stream, n: int) -> bytes:
    data = stream.read(n)
    if len(data) != n:
        raise Malformed("archive ends inside a frame")
    return data


def frames(stream, block: int = 1 << 16):
    """The decoded frames of an archive, one at a time. The leading skippable frame gives the dictionary."""
    import zstandard

    unpacker, held, first = zstandard.ZstdDecompressor(), b"", True
    while True:
        while len(held) < 8 and (more := stream.read(block)):
            held += more
        if not held:
            return
        if len(held) < 8:
            raise Malformed("archive ends inside a frame")
        magic, size = struct.unpack_from("<II", held)
        if magic in SKIPPABLE:
            rest = max(0, size - (len(held) - 8))
            body, held = held[8 : 8 + size] + (_exactly(stream, rest) if rest else b""), held[8 + size :]
            if first and magic == DICTIONARY:
                if body[:4] == struct.pack("<I", FRAME):
                    body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
                if body[:4] != struct.pack("<I", TRAINED):
                    raise Malformed("no dictionary in the leading frame")
                unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
            first = False
            continue
        if magic != FRAME:
            raise Malformed("not a Zstandard frame")
        first = False
        one, parts = unpacker.decompressobj(), []
        while not one.eof:
            if not held and not (held := stream.read(block)):
                raise Malformed("archive ends inside a frame")
            try:
                parts.append(one.decompress(held))
            except zstandard.ZstdError as e:
                raise Malformed(f"frame does not decode: {e}") from e
            held = one.unused_data if one.eof else b""
        yield b"".join(parts)


def _headers(data: bytes) -> tuple[str, dict[str, str], int]:
    """First line, fields by lower-cased name, and where the body starts."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise Malformed("header does not end")
    first, *lines = data[:end].decode("utf-8", "replace").split("\r\n")
    fields: dict[str, str] = {}
    last = None
    for line in lines:
        if line[:1] in (" ", "\t") and last:
            fields[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            raise Malformed("header line without a name")
        last = name.lower()
        if last in fields and last != "warc-concurrent-to":
            raise Malformed(f"{name} is given twice")
        fields[last] = value.strip()
    return first, fields, end + 4


def _length(fields: dict[str, str], of: str) -> int:
    value = fields.get("content-length", "")
    if not re.fullmatch(r"[0-9]+", value):
        raise Malformed(f"{of} has no length")
    return int(value)


def _digest(value: str | None) -> str | None:
    """The hex of a ``sha256:<hex>`` field; None for no field or another algorithm."""
    kind, _, rest = (value or "").partition(":")
    return rest.lower() if kind.lower() in ("sha256", "sha-256") and re.fullmatch(r"[0-9a-fA-F]{64}", rest) else None


def parsed(record: bytes) -> dict:
    """The fields of RECORD (without archive and place) of one frame's bytes; Malformed if a rule is broken."""
    first, fields, at = _headers(record)
    if not re.fullmatch(r"WARC/1\.[01]", first):
        raise Malformed("not a WARC record")
    for name in ("WARC-Type", "WARC-Record-ID", "WARC-Date"):
        if not fields.get(name.lower()):
            raise Malformed(f"{name} is missing")
    size = _length(fields, "record")
    if record[at + size :] != b"\r\n\r\n":
        raise Malformed("Content-Length differs from the record's block")
    block = record[at : at + size]
    whole = _digest(fields.get("warc-block-digest"))
    if whole and whole != hashlib.sha256(block).hexdigest():
        raise Malformed("block digest differs")
    out = {
        "record_id": fields["warc-record-id"].strip("<>"), "record_type": fields["warc-type"], "target_uri": fields.get("warc-target-uri"),
        "date": fields["warc-date"], "refers_to": (fields.get("warc-refers-to") or "").strip("<>") or None,
        "payload_digest": _digest(fields.get("warc-payload-digest")), "payload_bytes": len(block), "payload": block,
    }
    if not fields.get("content-type", "").replace(" ", "").startswith("application/http"):
        return out
    _, http, start = _headers(block)
    payload = block[start:]
    if out["record_type"] == "revisit":
        if not out["refers_to"] or payload:
            raise Malformed("revisit with a payload or without a record to refer to")
        return out | {"payload": None, "payload_bytes": _length(http, "payload") if "content-length" in http else None}
    if "content-length" in http and _length(http, "payload") != len(payload):
        raise Malformed("HTTP Content-Length differs from the payload")
    found = hashlib.sha256(payload).hexdigest()
    if out["payload_digest"] not in (None, found):
        raise Malformed("payload digest differs")
    return out | {"payload_digest": found, "payload_bytes": len(payload), "payload": payload}


def read_archives(archives: DataFrame, batch_bytes: int = 4 << 20) -> DataFrame:
    """Every record of the files in column ``archive``: RECORD, in which ``place`` counts an archive's frames from 0.

    A frame that is no valid record is a row with ``error`` and nothing else but archive and place; an archive that breaks off
    ends with such a row. One task reads an archive at a time.
    """
    def read(batches):
        import pyarrow as pa
        from pyarrow import fs

        kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
        schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in RECORD.split(", ")])
        held, size = [], 0
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                system, path = fs.FileSystem.from_uri(archive)
                with system.open_input_stream(path, compression=None) as stream:
                    for row in _rows(archive, stream):
                        held.append(row)
                        size += len(row.get("payload") or b"") + 500
                        if size >= batch_bytes:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    # a number of its own: the list is tiny, and partitions chosen by its bytes would leave all archives to one task
    parts = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("archive").repartition(parts, "archive").mapInArrow(read, RECORD)


def _rows(archive: str, stream):
    place = 0
    try:
        for place, record in enumerate(frames(stream)):
            try:
                yield {"archive": archive, "place": place, **parsed(record)}
            except Malformed as e:
                yield {"archive": archive, "place": place, "error": str(e)}
            place += 1
    except Malformed as e:
        yield {"archive": archive, "place": place, "error": str(e)}


# ---------------------------------------------------------------------------------------------------------------- pages


def with_references(pages: DataFrame) -> DataFrame:
    """Rows to write for pages: name, uri, html, digest, size, refers_to.

    Of pages whose payloads of at least LEAST_SHARED bytes are equal, the smallest page_id's rows are responses and all others
    refer to it (a null page_id is never the smallest, unless all are null: then all are responses). A digest's pages are counted
    by digest and salt before they meet, and the answer goes back to the salts that occur, so no digest is a hot key.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", F.col("url").alias("uri"), html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("long").alias("size"), F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).alias("salt"))
    keys = rows.select("page_id", "digest", "salt", "size").filter(F.col("size") >= LEAST_SHARED)
    salted = keys.groupBy("digest", "salt").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    shared = salted.groupBy("digest").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.collect_list("salt").alias("salts"))
    shared = shared.filter("n > 1").select("digest", "first", F.explode("salts").alias("salt"))
    name = lambda c: F.concat(F.lit(NAME), F.coalesce(F.col(c).cast("string"), F.lit("")))
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(shared, ["digest", "salt"], "left").select(name("page_id").alias("name"), "uri", "html", "digest", "size", F.when(other, name("first")).alias("refers_to"))


def archived_pages(pages: DataFrame) -> DataFrame:
    """Write pages as archives in the shared folder and return the list of them."""
    return write_archives(with_references(pages), f"{_uri(pages.sparkSession, shared_dir(pages.sparkSession)).rstrip('/')}/{uuid.uuid4().hex}-warc")


def _uri(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme that Spark would give it, as Arrow's file systems write it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    full = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/+", "file:///", full)


def page_digests(archives: DataFrame, kind: str = "long") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the records read back; kind is page_id's type.

    A response's size and digest are those of the payload that was read, a revisit's those that its headers state. A row of an
    invalid record keeps its error and nulls.
    """
    page = lambda c: F.expr(f"nullif(substring({c}, {len(NAME) + 1}), '')").cast(kind)
    return read_archives(archives).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"), "error")

"""WARC archives in Zstandard frames, one frame per record, with a dictionary in front.

An archive begins with a skippable frame that holds the dictionary (itself plain or
Zstandard-compressed). Every record is one frame of its own, so a reader can find
record boundaries from block headers without decoding. Readers check checksums,
header syntax, lengths and digests, and fail on the first record that breaks a rule.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm._shared import fresh_path, id_type, join_to_one, materialize, small_batches
from siftwell.llm.files import RolledFile, read_named

# Fixed values of the two formats.
FRAME_MAGIC, DICTIONARY_MAGIC, TRAINED_MAGIC = 0xFD2FB528, 0x184D2A5D, 0xEC30A437
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
#: Digests that are checked. Fixed values.
ALGORITHMS = ("md5", "sha1", "sha224", "sha256", "sha384", "sha512")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Bytes of an archive after which the next is begun, of a dictionary and of payloads it is trained on, and of a dictionary that is read at most.
ARCHIVE_BYTES, DICTIONARY_BYTES, TRAINING_BYTES, MOST_DICTIONARY = 16 << 20, 16 << 10, 512 << 10, 1 << 28
ID_PREFIX = "urn:page:"


class WarcError(ValueError):
    """An archive that breaks a rule of its format."""


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that begins at ``at`` ends, from its header and block headers."""
    try:
        flags = data[at + 4]
        single, checksum = flags >> 5 & 1, flags >> 2 & 1
        here = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((single, 2, 4, 8)[flags >> 6])
        last = 0
        while not last:
            head = data[here] | data[here + 1] << 8 | data[here + 2] << 16
            last, kind, size = head & 1, head >> 1 & 3, head >> 3
            if kind == 3:
                raise WarcError(f"a frame at byte {at} has a reserved block type")
            here += 3 + (1 if kind == 1 else size)
        here += 4 * checksum
    except IndexError:
        here = len(data) + 1
    if here > len(data):
        raise WarcError(f"the frame at byte {at} is cut short")
    return here


def load_dictionary(data: memoryview) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """The dictionary of the leading skippable frame, if there is one, and where the records begin."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != DICTIONARY_MAGIC:
        return None, 0
    end = 8 + struct.unpack_from("<I", data, 4)[0]
    if end > len(data):
        raise WarcError("the dictionary's frame is cut short")
    content = bytes(data[8:end])
    if content[:4] == struct.pack("<I", FRAME_MAGIC):
        content = zstandard.ZstdDecompressor().decompress(content, max_output_size=MOST_DICTIONARY)
    elif content[:4] != struct.pack("<I", TRAINED_MAGIC):
        raise WarcError("the leading frame holds no dictionary")
    return zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_FULLDICT), end


def parse_headers(head: bytes) -> tuple[str, dict[str, str]]:
    """First line and named fields (names in lower case); folded lines are unfolded."""
    first, *lines = head.decode("utf-8").split("\r\n")
    fields: dict[str, str] = {}
    name = ""
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            fields[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        name = name.strip().lower()
        if not colon or not name:
            raise WarcError(f"{line[:80]!r} is no header field")
        fields.setdefault(name, value.strip())
    return first, fields


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block of one decoded record, after checks of version, fields, length and block digest."""
    cut = record.find(b"\r\n\r\n")
    if cut < 0:
        raise WarcError("a record's header doesn't end")
    version, fields = parse_headers(record[:cut])
    if not re.fullmatch(r"WARC/1\.[01]", version):
        raise WarcError(f"{version[:40]!r} is no version that can be read")
    for name in REQUIRED:
        if name not in fields:
            raise WarcError(f"a record has no {name}")
    if not fields["content-length"].isdecimal():
        raise WarcError("a record's length is no number")
    size = int(fields["content-length"])
    block = record[cut + 4 : cut + 4 + size]
    if len(block) != size or record[cut + 4 + size :] != b"\r\n\r\n":
        raise WarcError(f"a record's block doesn't have the {size} bytes that its header says")
    if (said := fields.get("warc-block-digest")) and not agrees(said, block):
        raise WarcError("a block doesn't have the digest that its header says")
    return fields, block


def read_archive(content: bytes | memoryview) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields and block of each record of an archive."""
    data = memoryview(content).cast("B")
    dictionary, at = load_dictionary(data)
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(data):
        if len(data) < at + 8:
            raise WarcError("an archive ends within a frame's header")
        magic, size = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + size
            continue
        if magic != FRAME_MAGIC:
            raise WarcError(f"no frame begins at byte {at}")
        end = frame_end(data, at)
        try:
            # a frame needn't say its size, and may be of any
            stream = decoder.decompressobj()
            record = stream.decompress(data[at:end])
        except zstandard.ZstdError as e:
            raise WarcError(f"the frame at byte {at} can't be decoded: {e}") from e
        if not stream.eof:
            raise WarcError(f"the frame at byte {at} doesn't end")
        yield parse_record(record)
        at = end


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def agrees(said: str, data: bytes) -> bool:
    """Whether ``algorithm:digest`` is the digest of data: in base 32 or hexadecimal, in any case; an unknown algorithm can't be held against it."""
    name, _, value = said.strip().partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in ALGORITHMS:
        return True
    digest = hashlib.new(name, data).digest()
    return value.strip().lower() == digest.hex() or value.strip().upper().rstrip("=") == base64.b32encode(digest).decode().rstrip("=")


def bare_sha1(said: str, payload: bytes | None) -> str:
    """The payload's SHA-1 in base 32, upper case: of the payload itself, or from what a header says of one that isn't there."""
    if payload is not None:
        return sha1(payload).removeprefix("sha1:")
    name, _, value = said.strip().partition(":")
    if name.strip().lower().replace("-", "") != "sha1":
        return said
    return base64.b32encode(bytes.fromhex(value)).decode() if re.fullmatch(r"[0-9a-fA-F]{40}", value := value.strip()) else value.upper()


def split_http(block: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and payload of an HTTP response."""
    cut = block.find(b"\r\n\r\n")
    if cut < 0 or not block.startswith(b"HTTP/"):
        raise WarcError("a block is no HTTP response")
    return parse_headers(block[:cut])[1], block[cut + 4 :]


def page_record(page_id, url: str | None, payload: bytes, digest: bytes, refers_to, is_response: bool) -> bytes:
    """A response record, or a revisit record that keeps the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if is_response else http
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:none")
    name = lambda i: f"<{ID_PREFIX}{'' if i is None else i}>"
    fields = [
        "WARC/1.1", f"WARC-Type: {'response' if is_response else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {uri}",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}", f"WARC-Block-Digest: {sha1(block)}",
    ]
    if not is_response:
        fields += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join([*fields, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary, or none where the samples are too few for one."""
    if len(samples) < 16:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=64, d=8)
    except zstandard.ZstdError:
        return None


class ArchiveWriter:
    """Writes one archive; the first records are held back until the dictionary is trained on them."""

    def __init__(self, out, level: int):
        self.out, self.level, self.held, self.size, self.n, self.frames = out, level, [], 0, 0, None

    def add(self, record: bytes) -> None:
        self.n += 1
        if self.frames is None:
            self.held.append(record)
            self.size += len(record)
            if self.size >= TRAINING_BYTES:
                self.begin()
        else:
            self.out.write(self.frames.compress(record))

    def begin(self) -> None:
        dictionary = train([r[:16384] for r in self.held])
        if dictionary:
            content = dictionary.as_bytes()
            self.out.write(struct.pack("<II", DICTIONARY_MAGIC, len(content)) + content)
        self.frames = zstandard.ZstdCompressor(level=self.level, dict_data=dictionary, write_checksum=True, write_content_size=True)
        for record in self.held:
            self.out.write(self.frames.compress(record))
        self.held = []

    def close(self) -> None:
        if self.frames is None:
            self.begin()
        self.out.close()


def with_roles(pages: DataFrame, least_bytes: int, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """page_id, url, html, digest, refers_to, is_response of each page.

    Only digests and ids are aggregated. The join deals pages by digest; a digest that many pages
    have is dealt to several tasks.
    """
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.unhex(F.sha1(F.encode("html", "utf-8"))))
    kept = materialize(rows.groupBy("digest").agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("n")), "payloads")
    response = F.col("page_id").eqNullSafe(F.col("kept")) | (F.octet_length("html") < least_bytes)
    return join_to_one(rows, kept, "digest", "n", ["page_id"]).select("page_id", "url", "html", "digest", F.when(~response, F.col("kept")).alias("refers_to"), response.alias("is_response"))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, level: int = 3, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record for each page into archives under ``folder``; returns the manifest (file_name, n_records)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, writer = [], None
        for batch in batches:
            for page_id, url, html, digest, refers_to, is_response in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if writer is None:
                    writer = ArchiveWriter(RolledFile(folder, ".warc.zst"), level)
                writer.add(page_record(page_id, url, html.encode(), digest, refers_to, is_response))
                if writer.out.size >= archive_bytes:
                    writer.close()
                    made.append((writer.out.name, writer.n))
                    writer = None
        if writer is not None:
            writer.close()
            made.append((writer.out.name, writer.n))
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made, strict=True)], names=["file_name", "n_records"])

    small_batches(pages.sparkSession)
    return materialize(with_roles(pages, least_bytes, id_col, url_col, html_col).mapInArrow(write, "file_name string, n_records long"), "warc-manifest")


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """Per record: page_id string, payload_bytes, payload_digest, record_type, refers_to string, and with ``with_payload`` payload."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * with_payload]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, n_records in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                rows, seen = [], 0
                for fields, block in read_archive(content.as_buffer()):
                    http, payload = split_http(block)
                    kind, said = fields["warc-type"], fields.get("warc-payload-digest", "")
                    size = int(http.get("content-length", len(payload)))
                    if kind == "response" and (not agrees(said, payload) or len(payload) != size):
                        raise WarcError("a payload doesn't have the digest or length that its headers say")
                    refers_to = fields.get("warc-refers-to", "<>")[1:-1].removeprefix(ID_PREFIX) or None
                    rows.append((fields["warc-record-id"][1:-1].removeprefix(ID_PREFIX) or None, size, bare_sha1(said, payload if kind == "response" else None), kind, refers_to if kind == "revisit" else None, payload))
                    seen += 1
                    if len(rows) == 512:
                        yield columns(rows)
                        rows = []
                if seen != n_records:
                    raise WarcError(f"an archive has {seen} records; its writer noted {n_records}")
                if rows:
                    yield columns(rows)

    def columns(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)][: len(names)], names=names)

    schema = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string" + ", payload binary" * with_payload
    return read_named(spark, folder, manifest).select("content", "n_records").mapInArrow(read, schema)


def archive_round_trip(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write all pages to archives and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null html is an empty payload, a null url ``urn:none``. Of equal payloads of ``least_bytes``
    or more the row with the largest id is the response (all rows that repeat that id are), the
    others revisit it; null ids count as smallest. No rows: no archives and no rows. Other columns
    are not read, so their names can't clash.
    """
    spark, kind = pages.sparkSession, id_type(pages, id_col)
    folder = fresh_path(spark, "archives")
    manifest = write_archives(pages, folder, least_bytes, id_col=id_col, url_col=url_col, html_col=html_col)
    if manifest.isEmpty():
        return spark.createDataFrame([], f"page_id {kind}, payload_bytes long, payload_digest string, record_type string, refers_to {kind}")
    found = read_archives(spark, folder, manifest)
    return found.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))

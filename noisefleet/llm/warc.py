"""WARC archives in Zstandard: one frame per record, the dictionary in the leading skippable frame.

Writing: every task writes one archive through Spark's own text writer, whose commit protocol keeps archives
whole when executors are lost or tasks run twice, on any store Spark reaches. A row of the writer is one frame; the
writer's line separator is itself an empty skippable frame, so the file is a plain sequence of frames.

Reading: archives are read by Spark's binary source. Frame ends are found from the frame and block headers, each
frame is decoded by itself with the archive's dictionary, and the record inside is checked: version line, header
syntax, required fields, Content-Length against what is there, the closing blank lines, and the payload
digest. What fails comes back as a row with ``error`` set and does not stop the rest of the archive; a frame whose
end cannot be found ends it. An archive is one value in memory, so writers keep them small: here one holds what
one task read (spark.sql.files.maxPartitionBytes).

Equal payloads: of records whose payload has ``least_bytes`` bytes or more, the one with the largest page_id is
a response and the others are revisits that refer to it; smaller ones are all responses.

Defined cases: null html is an empty payload; a null page_id is written as such and reads back null, and never
is the one others refer to if another has an id; repeated rows of the largest page_id are all responses; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noisefleet.llm.common import stored
from noisefleet.session import new_folder

# Fixed values of the Zstandard format and of its use for WARC.
FRAME_MAGIC, SKIP_MAGIC, DICTIONARY_MAGIC = 0xFD2FB528, 0x184D2A50, 0x184D2A5D
EMPTY_FRAME = "P*M\x18\0\0\0\0"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
PAGE_URN = "urn:page:"
PAYLOAD_LENGTH = "X-Payload-Length"  # extension field: a revisit's block is empty

LEAST_BYTES = 1000
DICTIONARY_BYTES = 32768
SAMPLED_PAGES = 300
DATE = "2024-01-01T00:00:00Z"

RECORD = ("archive string, record_no bigint, warc_type string, record_id string, target_uri string, warc_date string, refers_to string, "
          "payload_bytes bigint, payload_digest string, payload binary, error string")


# -- frames -------------------------------------------------------------------------------------------------

def skippable(content: bytes, magic: int = DICTIONARY_MAGIC) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that begins at ``at`` ends, from its headers alone."""
    if at + 8 > len(data):
        raise ValueError("truncated frame")
    magic, size = struct.unpack_from("<II", data, at)
    if magic & 0xFFFFFFF0 == SKIP_MAGIC:
        end = at + 8 + size
    elif magic == FRAME_MAGIC:
        checked = data[at + 4] >> 2 & 1
        end, last = at + zstandard.frame_header_size(bytes(data[at:at + 18])), False
        while not last:
            if end + 3 > len(data):
                raise ValueError("truncated frame")
            block = int.from_bytes(data[end:end + 3], "little")
            last, kind, length = block & 1, block >> 1 & 3, block >> 3
            if kind == 3:
                raise ValueError("reserved block type")
            end += 3 + (1 if kind == 1 else length)
        end += 4 * checked
    else:
        raise ValueError("no frame")
    if end > len(data):
        raise ValueError("truncated frame")
    return end


def leading_dictionary(data: memoryview) -> tuple[bytes, int]:
    """The dictionary of an archive, decoded if it is compressed itself, and where the records begin."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != DICTIONARY_MAGIC:
        return b"", 0
    end = frame_end(data, 0)
    content = bytes(data[8:end])
    if content[:4] == struct.pack("<I", FRAME_MAGIC):
        content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
    return content, end


# -- records ------------------------------------------------------------------------------------------------

def record_bytes(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in (*fields, ("Content-Length", str(len(block)))))
    return head.encode() + b"\r\n" + block + b"\r\n\r\n"


def read_record(record: bytes) -> dict:
    """Fields of one record; ``error`` names the first thing that is wrong with it."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    out: dict = {"payload": None}
    try:
        lines = head.decode("utf-8").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        out |= {"warc_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "target_uri": fields.get("warc-target-uri"),
                "warc_date": fields.get("warc-date"), "refers_to": fields.get("warc-refers-to")}
        if not gap or not lines[0].startswith("WARC/1."):
            raise ValueError("no WARC/1.x record")
        if any(not x.partition(":")[1] or not x.partition(":")[0].strip() for x in lines[1:]):
            raise ValueError("malformed header line")
        if missing := [k for k in REQUIRED if k.lower() not in fields]:
            raise ValueError(f"no {missing[0]}")
        if not fields["content-length"].isdigit():
            raise ValueError("Content-Length is no number")
        length = int(fields["content-length"])
        if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
            raise ValueError(f"Content-Length {length} does not fit the record")
        said = fields.get("warc-payload-digest", "")
        if fields["warc-type"] == "revisit":
            if not fields.get("warc-refers-to"):
                raise ValueError("a revisit without WARC-Refers-To")
            if not fields.get(PAYLOAD_LENGTH.lower(), "").isdigit():
                raise ValueError(f"a revisit without {PAYLOAD_LENGTH}")
            return out | {"payload_bytes": int(fields[PAYLOAD_LENGTH.lower()]), "payload_digest": said.removeprefix("sha1:"), "error": None}
        payload = rest[:length]
        digest = hashlib.sha1(payload).hexdigest()
        if said and said != f"sha1:{digest}":
            raise ValueError("the payload does not have its digest")
        return out | {"payload": payload, "payload_bytes": length, "payload_digest": digest, "error": None}
    except (ValueError, UnicodeDecodeError) as wrong:
        return out | {"payload_bytes": None, "payload_digest": None, "error": str(wrong)}


def read_archive(content: bytes) -> Iterator[dict]:
    data = memoryview(content)
    try:
        dictionary, at = leading_dictionary(data)
    except (ValueError, zstandard.ZstdError) as wrong:
        yield {"error": f"dictionary: {wrong}"}
        return
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    while at < len(data):
        try:
            end = frame_end(data, at)
        except (ValueError, zstandard.ZstdError) as wrong:
            yield {"error": f"{wrong} at byte {at}"}
            return
        if struct.unpack_from("<I", data, at)[0] == FRAME_MAGIC:
            try:
                yield read_record(decoder.decompressobj().decompress(data[at:end]))
            except zstandard.ZstdError as wrong:
                yield {"error": f"{wrong} at byte {at}"}
        at = end


# -- Spark --------------------------------------------------------------------------------------------------

def train_dictionary(pages: DataFrame, size: int = DICTIONARY_BYTES, sampled: int = SAMPLED_PAGES, longest: int = 65536) -> bytes:
    """A dictionary from at most ``sampled`` pages of ``longest`` characters or less; empty if they are too few to train one."""
    some = [r[0].encode() for r in pages.where(F.length("html").between(1, longest)).select("html").limit(sampled).collect()]
    try:
        return zstandard.train_dictionary(size, some).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def marked(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, kept_id): ``kept_id`` is the page whose response
    holds an equal payload, null where the page's own record does."""
    p = pages.select(pages["page_id"].cast("bigint").alias("page_id"), pages["url"].alias("url"),
                     F.coalesce(pages["html"], F.lit("")).cast("binary").alias("payload"))
    p = p.withColumns({"payload_bytes": F.length("payload").cast("bigint"), "payload_digest": F.sha1("payload")})
    large = F.col("payload_bytes") >= least_bytes
    groups = p.where(large).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("kept_id"), F.count("*").alias("n"))
    # stored apart, so that a payload with very many copies can be split in the join
    p = p.join(stored(groups.where("n > 1").drop("n"), "warc-copies"), ["payload_digest", "payload_bytes"], "left")
    return p.withColumn("kept_id", F.when(~F.col("kept_id").eqNullSafe(F.col("page_id")), F.col("kept_id")))


def write_archives(pages: DataFrame, folder: str, dictionary: bytes | None = None, least_bytes: int = LEAST_BYTES, level: int = 3) -> None:
    """Write (page_id, url, html) as .warc.zst files, one per task, into ``folder``."""
    words = train_dictionary(pages) if dictionary is None else dictionary

    def frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = zstandard.ZstdCompressor(level=level, write_checksum=True, dict_data=zstandard.ZstdCompressionDict(words) if words else None)
        if words:
            yield pd.DataFrame({"frame": [skippable(words)]})
        for batch in batches:
            out = []
            for page, url, payload, size, digest, kept in zip(batch["page_id"], batch["url"], batch["payload"], batch["payload_bytes"],
                                                              batch["payload_digest"], batch["kept_id"]):
                revisit = not pd.isna(kept)
                name = "" if pd.isna(page) else int(page)
                fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{PAGE_URN}{name}>"), ("WARC-Date", DATE)]
                if isinstance(url, str) and url:
                    fields.append(("WARC-Target-URI", "".join(c if c.isprintable() else "%{:02X}".format(ord(c)) for c in url)))
                fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
                if revisit:
                    fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                               ("WARC-Refers-To", f"<{PAGE_URN}{int(kept)}>"), (PAYLOAD_LENGTH, str(size))]
                out.append(encoder.compress(record_bytes(fields, b"" if revisit else payload)))
            yield pd.DataFrame({"frame": out})

    rows = marked(pages, least_bytes).withColumns({c: F.col(c).cast("string") for c in ("page_id", "kept_id")}).mapInPandas(frames, "frame binary")
    rows.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", EMPTY_FRAME).option("compression", "none").text(folder)


def read_archives(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of all archives in ``folder``: see RECORD; ``payload`` is null without ``with_payload``."""
    columns = [c.split()[0] for c in RECORD.split(", ")]

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows, held = [], 0
                for n, r in enumerate(read_archive(bytes(content))):
                    rows.append(r | {"archive": path, "record_no": n} | ({} if with_payload else {"payload": None}))
                    held += len(r.get("payload") or b"")
                    if len(rows) >= 5000 or held >= 1 << 24:
                        yield pd.DataFrame(rows, columns=columns).astype(object)
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=columns).astype(object)

    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInPandas(records, RECORD)


def round_trip(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write ``pages`` to new archives in the shared folder and read them back, without payloads."""
    folder = new_folder(pages.sparkSession, "warc")
    write_archives(pages, folder, least_bytes=least_bytes)
    return read_archives(pages.sparkSession, folder, with_payload=False)


def page_of(urn: Column) -> Column:
    """The page_id in a record id; null where there is none."""
    digits = F.regexp_extract(urn, rf"^<{PAGE_URN}(-?\d+)>$", 1)
    return F.when(digits != "", digits).cast("bigint")

"""WARC archives compressed with a dictionary of their own (operator 9)."""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import cut, ensure_checkpoints, in_slices, partitions, released, skew_join

#: Fixed values of the format: the skippable frame that holds a dictionary, Zstandard's own magic number.
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, intact boolean, archive string"
_NAMES = [c.split()[0] for c in RECORDS.split(", ")]
_KINDS = [{"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[c.split()[1]] for c in RECORDS.split(", ")]


def _target(url: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")


def _urn(page_id) -> str:
    return "<urn:page:null>" if page_id is None else f"<urn:page:{page_id}>"


def _page(urn: str | None) -> int | None:
    last = (urn or "").strip("<>").rpartition(":")[2]
    return int(last) if last.lstrip("-").isdigit() else None


def format_record(page_id, url: str | None, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit (``refers_to`` is set) with HTTP headers only."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {_target(url)}", f"WARC-Payload-Digest: sha256:{digest}"]
    if revisit:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(warc["Content-Length"])]
    top, _, payload = block.partition(b"\r\n\r\n")
    return warc, dict(x.split(": ", 1) for x in top.decode().split("\r\n")[1:]), payload


def _dictionary(records: list[bytes], size: int, sample: int):
    """A dictionary from records spread evenly over the archive, ``sample`` bytes at most; a raw one where too few can train."""
    import zstandard as zstd

    step = max(1, sum(map(len, records)) // max(sample, 1))
    picked = records[::step]
    try:
        return zstd.train_dictionary(size, picked, k=200, d=8)
    except zstd.ZstdError:
        return zstd.ZstdCompressionDict(b"".join(picked)[:size] or b"WARC/1.1\r\n", dict_type=zstd.DICT_TYPE_RAWCONTENT)


def write_archive(records: list[bytes], dictionary_bytes: int = 32_768, sample_bytes: int = 2_000_000, level: int = 3) -> bytes:
    """A skippable frame with the (compressed) dictionary, then each record as a frame of its own."""
    import zstandard as zstd

    trained = _dictionary(records, dictionary_bytes, sample_bytes)
    packed = zstd.ZstdCompressor(level=9).compress(trained.as_bytes())
    press = zstd.ZstdCompressor(level=level, dict_data=trained, write_content_size=True)
    return b"".join([struct.pack("<II", DICTIONARY_FRAME, len(packed)), packed, *map(press.compress, records)])


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one at a time, decompressed with the dictionary it leads with."""
    import zstandard as zstd

    magic, size = struct.unpack("<II", data[:8])
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive doesn't begin with a dictionary")
    held = data[8 : 8 + size]
    if held[:4] == ZSTD_MAGIC:
        held = zstd.ZstdDecompressor().decompress(held)
    kind = zstd.DICT_TYPE_FULLDICT if held[:4] == b"\x37\xa4\x30\xec" else zstd.DICT_TYPE_RAWCONTENT
    loose, rest = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(held, dict_type=kind)), memoryview(data)[8 + size :]
    while len(rest):
        one = loose.decompressobj()
        yield one.decompress(rest)
        rest = rest[len(rest) - len(one.unused_data) :]


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def plan_records(pages: DataFrame, least: int = 100) -> DataFrame:
    """(page_id, url, html, digest, refers_to): of pages with equal payloads of at least ``least`` bytes all but that with the smallest page_id refer to it.

    Digests are counted with a partial aggregate; payloads that a large part of all pages share are joined by broadcast (their
    number is bounded), so no task gets all pages of one payload."""
    raw = F.coalesce("html", F.lit("")).cast("binary")
    pages = pages.select("page_id", "url", "html", F.sha2(raw, 256).alias("digest"))
    firsts = pages.where(F.octet_length("html") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    out = skew_join(pages, cut(firsts), "digest", "n", how="left")
    return out.select("page_id", "url", "html", "digest", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None, roll_bytes: int = 32_000_000, date: str = "2024-01-01T00:00:00Z", **how) -> DataFrame:
    """Writes a record per row of ``pages`` and returns the manifest (archive, records, bytes), held in the checkpoint folder.

    Each task rolls over to a new archive after ``roll_bytes`` of records, so memory is bounded.  Names hold the task attempt:
    what a lost or repeated attempt left behind is in no manifest.  ``folder`` must be shared by all executors; by default it is
    made below spark.checkpoint.dir."""
    folder = folder or f"{ensure_checkpoints(pages.sparkSession)}/warc-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, size, count = TaskContext.get(), [], 0, 0
        store, root = _open(folder)
        store.create_dir(root, recursive=True)

        def close() -> pa.RecordBatch:
            name, data = f"{root}/{task.partitionId():06d}-{task.taskAttemptId()}-{count:04d}.warc.zst", write_archive(held, **how)
            with store.open_output_stream(name) as out:
                out.write(data)
            return pa.RecordBatch.from_pydict({"archive": [name], "records": [len(held)], "bytes": [len(data)]})

        for part in (p for batch in batches for p in in_slices(batch, 2)):
            for page_id, url, html, digest, refers in zip(*(part.column(c).to_pylist() for c in range(5)), strict=True):
                held.append(format_record(page_id, url, (html or "").encode(), digest, refers, date))
                size += len(held[-1])
                if size >= roll_bytes:
                    yield close()
                    held, size, count = [], 0, count + 1
        if held:
            yield close()

    return cut(plan_records(pages).mapInArrow(released(write), "archive string, records long, bytes long"))


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per record of the archives in ``manifest``: what its headers say, and whether a response's payload has its digest."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = _open(folder)[0]
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                with store.open_input_stream(name) as data:
                    raw = data.read()
                rows = []
                for record in read_archive(raw):
                    warc, http, payload = parse_record(record)
                    digest, kind = warc["WARC-Payload-Digest"].partition(":")[2], warc["WARC-Type"]
                    whole = kind == "revisit" or hashlib.sha256(payload).hexdigest() == digest
                    rows.append((_page(warc["WARC-Record-ID"]), warc["WARC-Target-URI"], kind, int(http["Content-Length"]), digest, _page(warc.get("WARC-Refers-To")), whole, name.rpartition("/")[2]))
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), _KINDS, strict=True)], _NAMES)

    return manifest.repartition(partitions(manifest.sparkSession)).mapInArrow(released(read), RECORDS)


def archive_pages(pages: DataFrame, folder: str | None = None, **how) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as archives and reads them back: one row per page.

    Null html is an empty payload; a null page_id is kept as null and never referred to unless a smaller one is missing;
    repeated rows give repeated records, each for itself; other columns of ``pages`` are left out; pages of any length are one record; an empty table gives no archive and no row."""
    folder = folder or f"{ensure_checkpoints(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(pages, folder, **how), folder)

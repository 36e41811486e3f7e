"""WARC archives: a deterministic sharded writer, and a reader.

Writing. Records are range-sorted by (id, content, URL). The bounds of shards of
about `shard_bytes` of payload are quantiles of a sample that a hash of the record
picks, so neither partitioning nor chance moves them; an id that many records share
is divided between shards by content. Rows alike in all are one row with a number of
copies, in pieces of COPIES, so they are divided as well. A task takes a shard's
records in order and writes one gzip member each; a new file begins once one holds
`roll_bytes` compressed. Headers, record ids and digests are made anew from content,
without clock or chance, so equal input gives equal bytes. Payloads of `least_revisit`
bytes or more that recur are written once, by the largest id, and elsewhere as revisits.

There are MOST_SHARDS shards at most; above that they grow, and roll into more files.
Only the sample comes to the driver: SAMPLED records a shard, without payload.

Commit. A task writes files under temporary names that no other attempt uses, and
returns a manifest row for each. Only when the manifest is a written table are its
files renamed, by tasks that may run twice, and leftovers of lost attempts are
deleted; the manifest stays beside the archives and names what belongs to them.

Reading streams members one by one, checks digests against content, and yields a
row a record. Files are reached with pyarrow's file systems, in any folder that executors share.

Defined results: a null payload is empty; a null id is less than others, and its
record has no id header; of rows with the same payload and the same largest id one
is the response and the others revisit it; a null URL becomes urn:page:<id>; an
empty table gives no files and an empty result. Ids are 64-bit integers of any
span; columns but the id, the URL and the payload are not written, whatever their names.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

MOST_SHARDS, SAMPLED, COPIES, MOST_TASKS = 20_000, 16, 1000, 100_000
SHARD_BYTES, LEAST_REVISIT = 8 << 20, 1000
#: A file holds an eighth of a shard's mean payload, compressed, within these bounds.
ROLL_BYTES = (1 << 20, 1 << 30)
DATE = "2024-01-01T00:00:00Z"
_MANIFEST = "file string, temporary string, records long, bytes long, sha256 string"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL name space of RFC 4122


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _head(lines: list[tuple[str, object]]) -> bytes:
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in lines if v is not None) + b"\r\n"


def record(row: dict, copy: int) -> bytes:
    """One gzip member: a response with its payload, or a revisit without. copy: which of the rows alike it is."""
    revisit, size = row["refers_url"] is not None and not (row["holder"] and copy == 0), row["payload_bytes"]
    payload = b"" if revisit else row["payload"].encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block, uri = http + payload, row["url"]
    uri = quote(uri, safe="%/:=&?~#+!$,;'@()*[]") if uri else f"urn:page:{'' if row['id'] is None else row['id']}"
    name = lambda *parts: f"<urn:uuid:{uuid.uuid5(_NAMESPACE, '/'.join(map(str, parts)))}>"
    own = [row["id"], row["url"], row["content"], *([copy] if copy else [])]
    digest = "sha1:" + base64.b32encode(bytes.fromhex(row["payload_sha1"])).decode()
    head = _head(
        [
            ("WARC-Type", "revisit" if revisit else "response"),
            ("WARC-Record-ID", name(*own, "revisit") if revisit else name(*own)),
            ("WARC-Date", DATE),
            ("WARC-Target-URI", uri),
            ("WARC-Payload-Digest", digest),
            ("WARC-Block-Digest", _digest(block)),
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None),
            ("WARC-Refers-To", name(row["refers_to"], row["refers_url"][0], row["content"]) if revisit else None),
            ("X-Page-Id", row["id"]),
            ("X-Refers-To-Page-Id", row["refers_to"] if revisit else None),
            ("X-Payload-Length", size),
            ("Content-Type", "application/http; msgtype=response"),
            ("Content-Length", len(block)),
        ]
    )
    return gzip.compress(head + block + b"\r\n\r\n", 6, mtime=0)


def members(stream) -> Iterator[bytes]:
    """The decompressed gzip members of a stream, one at a time."""
    pending = b""
    while True:
        pending = pending or stream.read(1 << 20)
        if not pending:
            return
        expand, out = zlib.decompressobj(31), []
        while not expand.eof:
            out.append(expand.decompress(pending))
            pending = expand.unused_data if expand.eof else stream.read(1 << 20)
            if not pending and not expand.eof:
                raise ValueError("a record is cut short")
        yield b"".join(out)


def parse(member: bytes) -> dict:
    """The row of a record; digests are checked against the content."""
    head, _, rest = member.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    revisit = fields["WARC-Type"] == "revisit"
    if _digest(block) != fields["WARC-Block-Digest"] or not revisit and (_digest(payload) != fields["WARC-Payload-Digest"] or len(payload) != int(fields["X-Payload-Length"])):
        raise ValueError(f"digest differs in {fields['WARC-Record-ID']}")
    number = lambda k: int(fields[k]) if k in fields else None
    return {
        "page_id": number("X-Page-Id"),
        "payload_bytes": int(fields["X-Payload-Length"]) if revisit else len(payload),
        "payload_digest": base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex(),
        "record_type": fields["WARC-Type"],
        "refers_to": number("X-Refers-To-Page-Id"),
        "url": fields["WARC-Target-URI"],
        "payload": None if revisit else payload.decode(),
    }


def _key(id_: int | None, content: str, url: str | None, piece: int) -> tuple:
    return id_ is not None, id_ or 0, content, url or "", piece


def shard_bounds(rows: DataFrame, shard_bytes: int) -> tuple[list[tuple], int]:
    """The least keys of all shards but the first, and the mean bytes of a shard. rows: id, content, url, piece, copies, payload_bytes."""
    bytes_ = (F.col("payload_bytes") + 512) * F.least(F.lit(COPIES), F.col("copies") - F.col("piece") * COPIES)
    n, total = rows.agg(F.count("*"), F.sum(bytes_)).first()
    shards = min(MOST_SHARDS, max(1, -(-(total or 0) // shard_bytes)))
    every = max(1, n // (SAMPLED * shards))
    sample = rows.where(F.pmod(F.xxhash64("id", "content", "url", "piece"), F.lit(every)) == 0).select("id", "content", "url", "piece", bytes_.alias("bytes")).collect()
    sample = sorted((_key(r["id"], r["content"], r["url"], r["piece"]), r["bytes"]) for r in sample)
    weight, at, bounds = sum(x for _, x in sample), 0, []
    for key, size in sample:
        if at * shards >= weight * (len(bounds) + 1) and key > (bounds[-1] if bounds else ()):
            bounds.append(key)
        at += size
    return bounds, (total or 0) // shards


def write_archives(spark: SparkSession, pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_revisit: int = LEAST_REVISIT, shard_bytes: int = SHARD_BYTES, roll_bytes: int | None = None) -> DataFrame:
    """Archives in `folder`; returns their manifest (file, records, bytes, sha256)."""
    scratch = Scratch(spark, "warc")
    text = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), text.alias("payload"), F.octet_length(text).cast("long").alias("payload_bytes"), F.sha1(text.cast("binary")).alias("payload_sha1"), F.sha2(text, 256).alias("content"))
    # names a row for joins; what is written follows from content alone
    rows = scratch.table(rows.withColumn("place", F.monotonically_increasing_id()), "rows")
    narrow = rows.select("id", "url", "content", "place", "payload_bytes")
    # one row for each payload that recurs, with the row that holds it
    best = F.max(F.struct(F.col("id").isNotNull().alias("has"), F.col("id").alias("id"), F.coalesce("url", F.lit("")).alias("by"), F.col("url").alias("url"), (-F.col("place")).alias("place"))).alias("best")
    held = rows.where(F.col("payload_bytes") >= least_revisit).groupBy("content").agg(best, F.count("*").alias("n")).where("n > 1")
    # an array, as the URL itself may be null
    held = scratch.table(held.select("content", F.col("best.id").alias("refers_to"), F.array("best.url").alias("refers_url"), (-F.col("best.place")).alias("refers_row")), "held")
    alike = [F.col("id").isNull().alias("no_id"), F.coalesce("id", F.lit(0)).alias("id0"), F.col("url").isNull().alias("no_url"), F.coalesce("url", F.lit("")).alias("url0"), F.col("content").alias("content0")]
    same = scratch.table(narrow.groupBy(*alike).agg(F.min("place").alias("first_row"), F.count("*").alias("copies")).where("copies > 1"), "same")
    joined = narrow.select("place", "content", *alike).join(same, ["no_id", "id0", "no_url", "url0", "content0"], "left").join(held, "content", "left")
    # what is known of rows that are not plain responses
    odd = joined.where("copies IS NOT NULL OR refers_row IS NOT NULL").select("place", "copies", (F.col("place") != F.col("first_row")).alias("gone"), "refers_to", "refers_url", (F.col("place") == F.col("refers_row")).alias("holder"))
    odd = scratch.table(odd, "odd")

    def in_pieces(df: DataFrame) -> DataFrame:
        """Rows to write, without those that another stands for, a row for each COPIES copies."""
        df = df.join(odd, "place", "left").where("NOT coalesce(gone, false)").withColumn("copies", F.coalesce("copies", F.lit(1)))
        return df.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES))))

    bounds, mean = shard_bounds(in_pieces(narrow), shard_bytes)
    roll_bytes = roll_bytes or min(ROLL_BYTES[1], max(ROLL_BYTES[0], mean // 8))

    @F.arrow_udf("int")
    def shard_of(id_: pa.Array, content: pa.Array, url: pa.Array, piece: pa.Array) -> pa.Array:
        return pa.array([bisect.bisect_right(bounds, _key(*x)) for x in zip(*(c.to_pylist() for c in (id_, content, url, piece)), strict=True)], pa.int32())

    # a payload that is not written is not shuffled
    payload = F.when(F.col("refers_url").isNull() | F.col("holder") & (F.col("piece") == 0), F.col("payload"))
    joined = in_pieces(rows).withColumns({"shard": shard_of("id", "content", "url", "piece"), "payload": payload})
    # a shard is a partition; by hash, some partitions would get several
    dealt = joined.repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("shard", F.asc_nulls_first("id"), "content", F.coalesce("url", F.lit("")), "url", "piece")
    base = folder.rstrip("/")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, fs, root = TaskContext.get().taskAttemptId(), *pyarrow.fs.FileSystem.from_uri(base)
        out, sink, now = [], None, None

        def close() -> None:
            nonlocal sink
            if sink is not None:
                sink.close()
                now[4] = now[4].hexdigest()
                out.append(tuple(now))
                sink = None

        shard, roll = None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != shard:
                    close()
                    shard, roll = row["shard"], 0
                for copy in range(row["piece"] * COPIES, min(row["copies"], (row["piece"] + 1) * COPIES)):
                    if sink is not None and now[3] >= roll_bytes:
                        close()
                        roll += 1
                    if sink is None:
                        file = f"part-{shard:06d}-{roll:05d}.warc.gz"
                        now = [file, f"_temporary/{file}.{attempt}", 0, 0, hashlib.sha256()]
                        fs.create_dir(f"{root}/_temporary", recursive=True)
                        sink = fs.open_output_stream(f"{root}/{now[1]}")
                    data = record(row, copy)
                    sink.write(data)
                    now[2] += 1
                    now[3] += len(data)
                    now[4].update(data)
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["file", "temporary", "records", "bytes", "sha256"])

    manifest = scratch.table(dealt.mapInArrow(write, _MANIFEST), "manifest")

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(base)
        for batch in batches:
            for row in batch.to_pylist():
                if fs.get_file_info(f"{root}/{row['temporary']}").type == pyarrow.fs.FileType.File:
                    fs.move(f"{root}/{row['temporary']}", f"{root}/{row['file']}")
                if fs.get_file_info(f"{root}/{row['file']}").size != row["bytes"]:
                    raise OSError(f"{row['file']} is not whole")
            yield batch

    done = spark.read.schema(manifest.schema).parquet(f"{scratch.root}/manifest").mapInArrow(commit, _MANIFEST).drop("temporary")
    done.write.mode("overwrite").parquet(f"{base}/_manifest")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/_temporary")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    scratch.drop("rows", "held", "same", "odd", "manifest")
    return spark.read.schema(done.schema).parquet(f"{base}/_manifest")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each record of the archives that the manifest names."""
    base = folder.rstrip("/")
    manifest = spark.read.schema(_MANIFEST).parquet(f"{base}/_manifest").select("file")
    # one file a task: a file is the unit of reading
    files = manifest.repartition(max(1, min(manifest.count(), MOST_TASKS)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(base)
        kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "url": pa.string(), "payload": pa.string()}
        make = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], list(kinds))
        for batch in batches:
            for file in batch["file"].to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{root}/{file}", compression=None) as stream:
                    for member in members(stream):
                        rows.append(parse(member))
                        held += len(member)
                        if held > 4 << 20:
                            yield make(rows)
                            rows, held = [], 0
                yield make(rows)

    return files.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload string")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written to archives and read back."""
    scratch = Scratch(spark, "warc-archives")
    write_archives(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"), f"{scratch.root}/archives")
    return read_archives(spark, f"{scratch.root}/archives").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

"""WARC archives: a deterministic sharded writer and a reader that verifies digests.

Records are range-sorted by page_id into shards with cuts from a fixed histogram; within a shard they are ordered by page_id,
then digest. Every record is a gzip member of its own. A shard's files roll once their compressed size passes `roll_bytes`.
Tasks write under temporary names that no other attempt shares; the manifest they return, which holds the successful attempts
only, then drives the renames, and is written last: an archive folder without a manifest is not committed. A lost executor
only repeats its shards. Of records with equal payloads the one with the largest page_id is the response; the others are
revisits without a body, whose HTTP header still tells the payload's length; a reader can check a revisit's block, but its payload
digest only against the response that it names.

Defined cases: null html is an empty payload; null page_ids sort first and never win over another; of repeated rows with the
winning page_id the first is the response and the others revisit it; null urls are written as empty; extra columns are not
read; an empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_dir, table

DATE = "2026-01-01T00:00:00Z"
ROLL_BYTES, BINS = 32 << 20, 4096
MANIFEST = "shard int, file string, temporary string, records long, bytes long"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def build_record(page_id: int | None, url: str, payload: bytes, digest: str, response: bool, winner: int | None) -> bytes:
    """A response with its HTTP message, or a revisit with the HTTP header only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if response else head
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if response else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"), f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if not response:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(winner, digest)}", f"X-Refers-To-Page-ID: {'' if winner is None else winner}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(data: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a gzip stream of members."""
    inflate, text = zlib.decompressobj(31), bytearray()
    for chunk in data:
        while chunk:
            text += inflate.decompress(chunk)
            chunk = inflate.unused_data
            if inflate.eof:  # a member is a record
                head, _, rest = bytes(text).partition(b"\r\n\r\n")
                fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
                yield fields, rest[: int(fields["Content-Length"])]
                inflate, text = zlib.decompressobj(31), bytearray()
    if text:
        raise ValueError("the archive ends inside a record")


def _cuts(pages: DataFrame, shards: int) -> list[int]:
    """page_ids that end the shards: the same for the same rows, however they are dealt. A histogram of BINS equal ranges of
    page_id; ranges with more than a quarter of a shard are cut into BINS again, all in one job, so outlying ids do no harm."""
    low, high = pages.agg(F.min("page_id"), F.max("page_id")).first()
    if low is None or shards < 2:
        return []
    total = pages.filter("page_id is not null").count()
    done, open_ = [], [(low, high - low + 1)]  # counted ranges (first id, rows), and ranges (first id, width) to cut
    while open_:
        widths = [-(-w // BINS) for _, w in open_]
        place = F.lit(None).cast("struct<range:int,bin:bigint>")
        for k, ((first, w), width) in enumerate(zip(open_, widths)):
            inside = (F.col("page_id") >= first) & (F.col("page_id") <= first + w - 1)
            place = F.when(inside, F.struct(F.lit(k).alias("range"), F.floor((F.col("page_id").cast("decimal(20,0)") - first) / width).cast("long").alias("bin"))).otherwise(place)
        found = pages.select(place.alias("p")).filter("p is not null").groupBy("p.range", "p.bin").count().collect()
        again = []
        for r in found:
            first, width = open_[r["range"]][0] + r["bin"] * widths[r["range"]], widths[r["range"]]
            if width > 1 and r["count"] * 4 * shards > total:
                again.append((first, width))
            else:
                done.append((first + width, r["count"]))
        open_ = sorted(again)
    cuts, upto = [], 0
    for end, n in sorted(done):
        upto += n
        if upto * shards >= (len(cuts) + 1) * total and len(cuts) < shards - 1 and end <= high:
            cuts.append(end)
    return cuts


def write_archives(pages: DataFrame, folder: str, shards: int | None = None, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) into folder and returns the manifest: shard, file, records, bytes."""
    spark = pages.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha1", F.unhex(F.sha1("payload")))
    keys = rows.select("page_id", "sha1")
    winners = keys.groupBy("sha1").agg(F.max("page_id").alias("winner"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    decided = keys.distinct().join(winners, "sha1")
    # The decisions travel beside the payloads and sort just before them, so that payloads move once and join nothing.
    both = rows.withColumn("winner", F.lit(None).cast("long")).withColumn("told", F.lit(1)).unionByName(
        decided.select("page_id", F.lit("").alias("url"), F.lit(None).cast("binary").alias("payload"), "sha1", "winner", F.lit(0).alias("told"))
    )
    cuts = F.array(*[F.lit(c) for c in _cuts(pages, shards)]).cast("array<bigint>")
    shard = F.when(F.col("page_id").isNull(), 0).otherwise(F.size(F.filter(cuts, lambda c: c <= F.col("page_id"))))
    dealt = both.withColumn("shard", shard).repartitionByRange(shards, "shard").sortWithinPartitions("shard", F.asc_nulls_first("page_id"), "sha1", "told")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        attempt, done, now, last, decision = uuid.uuid4().hex[:12], [], None, None, (None, None)

        def close() -> None:
            nonlocal now
            if now:
                now["out"].close()
                done.append((now["shard"], now["file"], now["temporary"], now["records"], now["bytes"]))
            now = None

        number = 0
        for batch in batches:
            for r in batch.to_pylist():
                key = (r["page_id"], r["sha1"])
                if not r["told"]:
                    decision = (key, r["winner"])
                    continue
                copies = decision[0] == key
                response = not copies or decision[1] == r["page_id"] and last != key
                last = key
                if now and (now["shard"] != r["shard"] or now["bytes"] >= roll_bytes):
                    number = number + 1 if now["shard"] == r["shard"] else 0
                    close()
                if not now:
                    name = f"shard-{r['shard']:06d}-{number:04d}.warc.gz"
                    now = {"shard": r["shard"], "file": name, "temporary": f".{name}.{attempt}", "records": 0, "bytes": 0}
                    now["out"] = store.open_output_stream(f"{root}/{now['temporary']}", compression=None)
                packer = zlib.compressobj(4, zlib.DEFLATED, 31)
                record = build_record(r["page_id"], r["url"], r["payload"], base64.b32encode(r["sha1"]).decode(), response, decision[1])
                data = packer.compress(record) + packer.flush()
                now["out"].write(data)
                now["records"] += 1
                now["bytes"] += len(data)
        close()
        kinds = (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], ["shard", "file", "temporary", "records", "bytes"])

    written = materialize(dealt.select("page_id", "url", "payload", "sha1", "winner", "told", "shard").mapInArrow(write, MANIFEST), "warc-written")

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for r in batch.to_pylist():
                with contextlib.suppress(FileNotFoundError):  # done by an earlier attempt
                    store.move(f"{root}/{r['temporary']}", f"{root}/{r['file']}")
                if store.get_file_info(f"{root}/{r['file']}").size != r["bytes"]:
                    raise OSError(f"{r['file']} is not whole")
            yield batch

    written.mapInArrow(commit, MANIFEST).drop("temporary").write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of every record; digests are computed anew and compared."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = [x.split()[0] for x in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        number = lambda x: int(x) if x else None
        for batch in batches:
            for file in batch["file"].to_pylist():
                rows = []
                with store.open_input_stream(f"{root}/{file}", compression=None) as stream:
                    for head, block in parse_records(iter(lambda: stream.read(1 << 20), b"")):
                        http, _, body = block.partition(b"\r\n\r\n")
                        said, digest = int(http.rsplit(b"Content-Length: ", 1)[1].split(b"\r\n")[0]), head["WARC-Payload-Digest"].removeprefix("sha1:")
                        whole = head["WARC-Type"] == "response"
                        if base32_sha1(block) != head["WARC-Block-Digest"].removeprefix("sha1:") or whole and (base32_sha1(body) != digest or len(body) != said):
                            raise ValueError(f"{file}: {head['WARC-Record-ID']} does not match its digests")
                        rows.append((number(head["X-Page-ID"]), head["WARC-Target-URI"], said, digest, head["WARC-Type"], number(head.get("X-Refers-To-Page-ID"))))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    parts = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("file").repartition(parts).mapInArrow(read, schema)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page what the archive says of it after writing all pages and reading the archives back."""
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex[:12]}"
    if "://" not in folder:
        folder = "file://" + folder
    manifest = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(manifest, folder).drop("url")


#: Five hex digits of a SHA-1 are four base32 characters.
ORACLE_SQL = {
    "op2_warc": """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as hx from pages),
d as (select page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + cast((cast('0x' || substr(hx, 1 + 5 * (i // 4), 5) as bigint) >> cast(15 - 5 * (i % 4) as int)) & 31 as int), 1)), '') as payload_digest from p),
w as (select *, max(page_id) over (partition by payload_digest) as winner from d)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest, case when page_id = winner then 'response' else 'revisit' end as record_type,
    case when page_id <> winner then winner end as refers_to from w""",
}

"""Web archives: a sharded writer that gives the same files for the same pages.

Records are sorted by page and dealt to shards by bounds that depend on the pages
alone, by bytes. Each task writes one shard, in gzip members of one record, and
rolls to a new file when one has reached its compressed size. Files get temporary
names; the rows that committed tasks return are the manifest, by which the files
are renamed and read. What a lost attempt leaves is in no manifest.

A record whose payload occurs under a smaller page is a revisit: it has the
headers and digests alone.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogspark.llm.frames import new_path, spread, table
from catalogspark.session import cut

#: Bytes of pages that a shard is planned for, and compressed bytes of a file.
SHARD_BYTES, FILE_BYTES = 1 << 30, 1 << 30
#: Pages sampled for each shard's bounds.
SAMPLES = 20
#: Bytes that a record has beside its payload, roughly, for planning.
HEADERS = 600
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LAST = (1 << 63) - 1

MANIFEST = "shard long, number long, name string, n_records long, n_bytes long, sha256 string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(url: str | None) -> str:
    """A URL as a header line can hold it."""
    return "urn:x-none" if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{name}: {value}\r\n" for name, value in [*headers, ("Content-Length", str(len(block)))])
    press = zlib.compressobj(6, zlib.DEFLATED, 31)  # a gzip member without time or name
    return press.compress(f"WARC/1.1\r\n{lines}\r\n".encode()) + press.compress(block) + press.compress(b"\r\n\r\n") + press.flush()


def _record(page, url, payload: bytes, number: int, first: tuple | None, date: str) -> bytes:
    """One page's record; `first` is (page_id, url) of the response it revisits."""
    named = lambda page, url, n: uuid.uuid5(uuid.NAMESPACE_URL, f"{page} {n} {_uri(url)}")
    digest = sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first else http + payload
    headers = [
        ("WARC-Type", "revisit" if first else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{named(page, url, number)}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", _uri(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{sha1(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if page is not None:
        headers.append(("X-Page-Id", str(page)))
    if url is None:
        headers.append(("X-No-Url", "1"))
    if first:
        headers += [
            ("WARC-Profile", PROFILE),
            ("WARC-Refers-To", f"<urn:uuid:{named(*first, 0)}>"),
            ("WARC-Refers-To-Target-URI", _uri(first[1])),
            ("WARC-Refers-To-Date", date),
        ]
        if first[0] is not None:
            headers.append(("X-Refers-To-Page-Id", str(first[0])))
    return _member(headers, block)


class _Files:
    """The files of one shard, under temporary names of this attempt."""

    def __init__(self, folder: str, limit: int, date: str):
        self.store, self.root = _store(f"{folder}/_temporary")
        self.store.create_dir(self.root, recursive=True)
        self.limit, self.date, self.attempt = limit, date, uuid.uuid4().hex
        self.number, self.out, self.done = 0, None, []

    def write(self, shard: int, member: bytes) -> None:
        if self.out is None:
            self.shard, self.n, self.size, self.sha = shard, 0, 0, hashlib.sha256()
            self.name = f"{shard:08d}-{self.number:05d}-{self.attempt}"
            self.out = self.store.open_output_stream(f"{self.root}/{self.name}", compression=None)
            info = b"software: catalogspark\r\nformat: WARC File Format 1.1\r\n"
            self._put(_member([
                ("WARC-Type", "warcinfo"), ("WARC-Date", self.date),
                ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'warcinfo {shard} {self.number}')}>"),
                ("WARC-Filename", final_name(shard, self.number)), ("Content-Type", "application/warc-fields"),
            ], info))
        self._put(member)
        self.n += 1
        if self.size >= self.limit:
            self.close()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.shard, self.number, self.name, self.n, self.size, self.sha.hexdigest()))
            self.number, self.out = self.number + 1, None


def final_name(shard: int, number: int) -> str:
    return f"pages-{shard:08d}-{number:05d}.warc.gz"


def _write(folder: str, limit: int, date: str, least: int):
    """Rows of one shard in order, a revisit's row before those of its page."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, last, copies, first = _Files(folder, limit, date), None, 0, None
        for batch in batches:
            for i in range(batch.num_rows):
                shard, page, url, key, first_page, first_url, payload = (c[i].as_py() for c in batch.columns)
                if (page, url, key) != last:
                    last, copies, first = (page, url, key), 0, None
                if payload is None:
                    first = (first_page, first_url)
                    continue
                if files.out is not None and files.shard != shard:
                    files.close()
                    files.number = 0
                # of equal rows the first may be the response
                mine = first or ((page, url) if copies and len(payload) >= least else None)
                files.write(shard, _record(page, url, payload, copies, mine, date))
                copies += 1
        files.close()
        if files.done:
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("shard", "number", "name", "n_records", "n_bytes", "sha256"), f)) for f in files.done],
                schema=pa.schema([("shard", pa.int64()), ("number", pa.int64()), ("name", pa.string()),
                                  ("n_records", pa.int64()), ("n_bytes", pa.int64()), ("sha256", pa.string())]),
            )

    return run


def _rename(folder: str):
    """Temporary to final names; a repeated task finds its files moved."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = _store(folder)
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                temporary, row["name"] = row["name"], final_name(row["shard"], row["number"])
                there = store.get_file_info(f"{root}/{row['name']}")
                if there.type == fs.FileType.NotFound or there.size != row["n_bytes"]:
                    store.move(f"{root}/_temporary/{temporary}", f"{root}/{row['name']}")
            yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)

    return run


def _shard_of(bounds: list[tuple[int, int]]):
    """Number of the bounds (page, hash) at or before each row."""
    pages = np.array([b[0] for b in bounds], np.int64)
    hashes = np.array([b[1] for b in bounds], np.int64)

    def run(page: pa.Array, hash_: pa.Array) -> pa.Array:
        page, hash_ = page.to_numpy(zero_copy_only=False), hash_.to_numpy(zero_copy_only=False)
        low, out = np.searchsorted(pages, page, "left"), np.searchsorted(pages, page, "right")
        split = np.flatnonzero(low < out)  # pages that bounds divide
        for at in np.unique(low[split]).tolist():
            own = split[low[split] == at]
            to = int(out[own[0]])
            out[own] = at + np.searchsorted(hashes[at:to], hash_[own], "right")
        return pa.array(out, pa.int64())

    return F.arrow_udf(run, "long")


def _bounds(groups: DataFrame, shard_bytes: int, least: int) -> list[tuple[int, int]]:
    """The (page, hash) at which shards behind the first begin, from pages chosen
    by a hash of their own: about SAMPLES for each shard, whatever the rows."""
    total = groups.agg(F.count("*").alias("n"), F.sum(F.col("size")).alias("size")).first()
    if not total.n:
        return []
    shards = max(least, -(-total.size // shard_bytes))
    share = min(1.0, SAMPLES * shards / total.n)
    drawn = groups.filter(F.pmod(F.xxhash64("page", "hash", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    rows = drawn.select("page", "hash", "size").orderBy("page", "hash").toArrow()
    if not rows.num_rows:
        return []
    ends = np.cumsum(rows["size"].to_numpy())
    at = np.unique(np.searchsorted(ends, ends[-1] * np.arange(1, shards) / shards, "right"))
    at = at[at < rows.num_rows]
    pages, hashes = rows["page"].to_numpy()[at], rows["hash"].to_numpy()[at]
    return sorted(set(zip(pages.tolist(), hashes.tolist())))


def write_warc(
    pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES,
    least_payload: int = 0, date: str = DATE,
) -> DataFrame:
    """Write a record for each row of `pages` (page_id, url, html) and return the
    manifest (shard, number, name, n_records, n_bytes, sha256), a row a file, which
    is also the table `manifest` in `folder`.

    The payload is the html in UTF-8, null an empty one. Of records with equal
    payloads of at least `least_payload` bytes the one with the smallest page_id
    is the response, ties to the smaller url, then to the first of equal rows; the
    others revisit it. Rows without a page_id are behind all others. Every row has
    a record, repeated or not. No rows: no files. Other columns are ignored.

    The same rows and settings give the same files, in whatever order and
    partitions the rows come. `folder` must be one that all executors reach and
    that holds no archive yet. Payloads are shuffled once; copies are recognised
    on a table of digests, whose hot keys are joined by parts.
    """
    spark, parts = pages.sparkSession, spread(pages.sparkSession)
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.unhex(F.sha2(payload, 256)).alias("key"), payload.alias("payload"),
    )
    page, hash_ = F.coalesce("page_id", F.lit(LAST)).alias("page"), F.xxhash64("url", "key").alias("hash")
    small = cut(rows.select("page_id", "url", "key", F.octet_length("payload").cast("long").alias("payload_bytes")))
    groups = small.groupBy("page_id", "url", "key").agg(F.max("payload_bytes").alias("payload_bytes"), F.count("*").alias("n"))
    bounds = _bounds(
        groups.select(page, hash_, (F.col("payload_bytes") + HEADERS * F.col("n")).alias("size")), shard_bytes, parts
    )
    revisits = _revisits(groups.filter(F.col("payload_bytes") >= least_payload), parts)
    none = F.lit(None)
    both = rows.select("page_id", "url", "key", none.cast("long").alias("first_page"), none.cast("string").alias("first_url"), "payload")
    both = both.unionByName(revisits.select("page_id", "url", "key", "first_page", "first_url", none.cast("binary").alias("payload")))
    shard = _shard_of(bounds)("page", "hash") if bounds else F.lit(0).cast("long")
    both = both.withColumns({"page": page, "hash": hash_}).withColumn("shard", shard)
    order = [F.col("shard"), F.col("page"), F.col("page_id").isNull(), F.col("hash"), F.col("url"), F.col("key"), F.col("payload").isNotNull()]
    written = (
        both.repartitionById(len(bounds) + 1, F.col("shard").cast("int")).sortWithinPartitions(*order)
        .select("shard", "page_id", "url", "key", "first_page", "first_url", "payload")
        .mapInArrow(_write(folder, file_bytes, date, least_payload), MANIFEST)
    )
    named = cut(written).repartition(parts, "name").mapInArrow(_rename(folder), MANIFEST)
    named.write.parquet(f"{folder}/manifest")
    _discard(f"{folder}/_temporary")
    # dealt by temporary names above, which differ from run to run
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").orderBy("shard", "number")


def _discard(folder: str) -> None:
    """Remove what lost attempts left."""
    from pyarrow import fs

    store, root = _store(folder)
    if store.get_file_info(root).type == fs.FileType.Directory:
        store.delete_dir(root)


def _revisits(groups: DataFrame, parts: int) -> DataFrame:
    """(page_id, url, key, first_page, first_url) of the pages that aren't the first
    of their payload. A payload's pages are dealt to `parts`, and its first page is
    brought to each part that has any, so no key gathers them all."""
    own = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("page"), F.col("url").alias("url"))
    dealt = groups.select("page_id", "url", "key", F.pmod(F.xxhash64("page_id", "url"), F.lit(parts)).alias("part"))
    firsts = dealt.groupBy("key", "part").agg(F.min(own).alias("first"), F.count("*").alias("n"))
    firsts = firsts.groupBy("key").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.collect_list("part").alias("parts"))
    firsts = firsts.filter("n > 1").select("key", "first", F.explode("parts").alias("part"))
    return dealt.join(firsts, ["key", "part"]).filter(~(own.eqNullSafe(F.col("first")))).select(
        "page_id", "url", "key", F.col("first.page").alias("first_page"), F.col("first.url").alias("first_url")
    )


# Reading --------------------------------------------------------------------


def _members(stream) -> Iterator[bytes]:
    """The members of a gzip file, one after the other."""
    press, out, data = zlib.decompressobj(31), [], stream.read(1 << 20)
    while data:
        out.append(press.decompress(data))
        if press.eof:
            yield b"".join(out)
            data = press.unused_data or stream.read(1 << 20)
            press, out = zlib.decompressobj(31), []
        else:
            data = stream.read(1 << 20)
    if out:
        raise ValueError("a record is cut off")


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """-> (headers by lower-case name, block) of a record."""
    head, _, rest = bytes(member).partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
    size = int(headers["content-length"])
    if len(rest) != size + 4:
        raise ValueError("a record's length is wrong")
    return headers, rest[:size]


def _read(folder: str, payloads: bool):
    names = [part.split()[0] for part in RECORD.split(", ")]
    types = dict(zip(names, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())))
    schema = pa.schema([(name, types[name]) for name in names if payloads or name != "payload"])
    number = lambda text: None if text is None else int(text)

    def rows(file: dict) -> Iterator[dict]:
        store, root = _store(folder)
        n = 0
        with store.open_input_stream(f"{root}/{file['name']}", compression=None) as stream:
            for member in _members(stream):
                headers, block = parse_record(member)
                if headers["warc-type"] == "warcinfo":
                    continue
                n += 1
                digest = headers["warc-payload-digest"].removeprefix("sha1:")
                payload = block.partition(b"\r\n\r\n")[2] if headers["warc-type"] == "response" else None
                size = int(headers["x-payload-length"])
                if f"sha1:{sha1(block)}" != headers["warc-block-digest"]:
                    raise ValueError(f"a block's digest is wrong in {file['name']}")
                if payload is not None and (sha1(payload) != digest or len(payload) != size):
                    raise ValueError(f"a payload's digest is wrong in {file['name']}")
                yield {
                    "page_id": number(headers.get("x-page-id")),
                    "url": None if "x-no-url" in headers else headers["warc-target-uri"],
                    "payload_bytes": size, "payload_digest": digest, "record_type": headers["warc-type"],
                    "refers_to": number(headers.get("x-refers-to-page-id")), "payload": payload,
                }
        if n != file["n_records"]:
            raise ValueError(f"{file['name']} holds {n} records, not {file['n_records']}")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.to_pylist():
                held, size = [], 0
                for row in rows(file):
                    if not payloads:
                        del row["payload"]
                    held.append(row)
                    size += 200 + (len(row["payload"] or b"") if payloads else 0)
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    return run


def read_warc(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of an archive that `write_warc` committed, digests checked:
    (page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload),
    `refers_to` being the page_id of a revisit's response and `payload` null for
    revisits, or left out without `payloads`. Only files of the manifest are read,
    a file by one task, record by record."""
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").repartition(spread(spark), "name")
    columns = RECORD if payloads else RECORD.removesuffix(", payload binary")
    return files.mapInArrow(_read(folder, payloads), columns)


def op11_sharded_warc(spark, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), folder)
    return read_warc(spark, folder, payloads=False).drop("url")


OP11_SQL = """
WITH digits AS (
  SELECT list_transform(range(16), lambda d: lpad(bin(d), 4, '0')) AS four,
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' AS letters
), p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), b AS (
  SELECT page_id, html, list_aggregate(list_transform(string_split(hex, ''),
           lambda c: four[instr('0123456789abcdef', c)]), 'string_agg', '') AS bits, letters
  FROM p, digits
), d AS (
  SELECT page_id, html, list_aggregate(list_transform(range(32), lambda i: substr(letters, 1 + CAST(list_sum(
           list_transform(range(5), lambda j: CASE WHEN substr(bits, CAST(5 * i + j + 1 AS INT), 1) = '1' THEN 1 << (4 - j) ELSE 0 END)) AS INT), 1)),
           'string_agg', '') AS payload_digest,
         row_number() OVER (PARTITION BY html ORDER BY page_id NULLS LAST) AS n,
         first_value(page_id) OVER (PARTITION BY html ORDER BY page_id NULLS LAST) AS first
  FROM b
)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN n = 1 THEN NULL ELSE first END AS refers_to
FROM d
"""

"""Token ids as wavelet matrices: one compressed file for each shard.

A shard holds the ids of consecutive documents as bit-planes, highest bit first,
each plane in the order that the planes before it sort the ids into (zeros
first). With counts of ones at every 512th place, a token's id, the number of
times an id occurs before a place, and the place of its n-th occurrence take one
step for each plane.

File: "WMX1", then little-endian unsigned integers of 32 bits for the length of
the header and of 64 bits for that of the body before compression, the header
(JSON: tokens, planes, documents), and the body, compressed by zstd: documents'
ids and numbers of tokens as 64-bit integers, then for each plane its bits, 8 to
a byte, first place highest, and its counts of ones as 64-bit integers.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogspark.llm.encode import encoder, tokenizer_path
from catalogspark.llm.frames import new_path, slices, spread, table, texts

MAGIC = b"WMX1"
#: A shard is closed when it holds so many tokens; a document is never divided.
SHARD_TOKENS = 1 << 20
#: Places between two stored counts of ones.
STEP = 512
NO_ID = -(1 << 63)


def build(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """The file of a shard: `ids` of the documents, one after the other."""
    import zstandard

    planes = max(1, int(ids.max(initial=0)).bit_length())
    now = ids.astype(np.uint16) if planes <= 16 else ids.astype(np.uint32)
    body = [
        np.array([NO_ID if d is None else d for d in doc_ids], "<i8").tobytes(),
        np.array(lengths, "<i8").tobytes(),
    ]
    for plane in range(planes - 1, -1, -1):
        bits = (now & now.dtype.type(1 << plane)).astype(bool)
        packed = np.packbits(bits)
        body += [packed.tobytes(), _counts(packed).tobytes()]
        chosen = np.packbits(bits, bitorder="little")  # Arrow's order of bits
        now = np.concatenate([_chosen(now, ~chosen), _chosen(now, chosen)])
    head = json.dumps({"tokens": len(ids), "planes": planes, "documents": len(doc_ids)}).encode()
    whole = b"".join(body)
    return MAGIC + struct.pack("<IQ", len(head), len(whole)) + head + zstandard.ZstdCompressor(level=1).compress(whole)


def _chosen(ids: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The ids whose bits are set; Arrow takes about half of numpy's time for it."""
    mask = pa.Array.from_buffers(pa.bool_(), len(ids), [None, pa.py_buffer(bits)])
    values = pa.Array.from_buffers(pa.from_numpy_dtype(ids.dtype), len(ids), [None, pa.py_buffer(ids)])
    return values.filter(mask).to_numpy()


def _counts(packed: np.ndarray) -> np.ndarray:
    """Ones before places 0, STEP, 2 * STEP, ... and before the end."""
    ones = np.bitwise_count(np.pad(packed, (0, -len(packed) % (STEP // 8))))
    return np.concatenate([[0], np.cumsum(ones.reshape(-1, STEP // 8).sum(axis=1, dtype=np.int64))]).astype("<i8")


class Shard:
    """An opened file."""

    def __init__(self, payload: bytes):
        import zstandard

        if payload[:4] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        head, size = struct.unpack_from("<IQ", payload, 4)
        self.head = json.loads(payload[16 : 16 + head])
        body = zstandard.ZstdDecompressor().decompress(payload[16 + head :], max_output_size=size)
        n, docs = self.head["tokens"], self.head["documents"]
        self.n, self.at = n, 0

        def take(kind: str, count: int) -> np.ndarray:
            out = np.frombuffer(body, kind, count, self.at)
            self.at += out.nbytes
            return out

        self.doc_ids = [None if d == NO_ID else d for d in take("<i8", docs).tolist()]
        self.first = np.concatenate([[0], np.cumsum(take("<i8", docs))]).astype(np.int64)
        self.planes = [(take("u1", -(-n // 8)), take("<i8", -(-n // STEP) + 1)) for _ in range(self.head["planes"])]

    def _ones(self, plane: int, place: int) -> int:
        packed, counts = self.planes[plane]
        block = place // STEP
        if block * STEP == place:
            return int(counts[block])
        piece = np.unpackbits(packed[block * STEP // 8 : -(-place // 8)], count=place - block * STEP)
        return int(counts[block]) + int(piece.sum())

    def _bit(self, plane: int, place: int) -> int:
        return int(self.planes[plane][0][place >> 3]) >> (7 - (place & 7)) & 1

    def access(self, place: int) -> int:
        """The id at a place."""
        if not 0 <= place < self.n:
            raise IndexError(place)
        token = 0
        for plane in range(len(self.planes)):
            bit = self._bit(plane, place)
            ones = self._ones(plane, place)
            place = self.n - int(self.planes[plane][1][-1]) + ones if bit else place - ones
            token = token << 1 | bit
        return token

    def _down(self, token: int, place: int) -> list[int]:
        """Places that `place` maps to, plane by plane, along the token's bits."""
        path = [place]
        for plane in range(len(self.planes)):
            ones = self._ones(plane, path[-1])
            if token >> (len(self.planes) - 1 - plane) & 1:
                path.append(self.n - int(self.planes[plane][1][-1]) + ones)
            else:
                path.append(path[-1] - ones)
        return path

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """Occurrences of an id at places from `low` to before `high`."""
        if token < 0 or token >> len(self.planes) or not self.n:
            return 0
        high = self.n if high is None else high
        return self._down(token, high)[-1] - self._down(token, low)[-1]

    def locate(self, token: int, k: int) -> int:
        """Place of the k-th occurrence of an id, from 0."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        place = self._down(token, 0)[-1] + k
        for plane in range(len(self.planes) - 1, -1, -1):
            bit = token >> (len(self.planes) - 1 - plane) & 1
            zeros = self.n - int(self.planes[plane][1][-1])
            place = self._select(plane, bit, place - zeros if bit else place)
        return place

    def _select(self, plane: int, bit: int, k: int) -> int:
        packed, counts = self.planes[plane]
        steps = np.minimum(np.arange(len(counts)) * STEP, self.n)
        before = counts if bit else steps - counts
        block = int(np.searchsorted(before, k, "right")) - 1
        bits = np.unpackbits(packed[block * STEP // 8 : (block + 1) * STEP // 8], count=min(STEP, self.n - block * STEP))
        return block * STEP + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def ids(self) -> np.ndarray:
        """All ids in order, the planes undone from the last to the first."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for weight, (packed, counts) in enumerate(reversed(self.planes)):
            bits = np.unpackbits(packed, count=self.n).view(bool)
            zeros = self.n - int(counts[-1])
            before = np.empty(self.n, kind)
            before[np.flatnonzero(~bits)] = now[:zeros]  # places are faster than masks
            before[np.flatnonzero(bits)] = now[zeros:] | kind(1 << weight)
            now = before
        return now


def _shards(path: str, end: int):
    """Texts of one range of documents, in order -> its shards."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        closing = np.array([end], "<u4").tobytes()
        docs, lengths, held, tokens, number, before = [], [], [], 0, 0, 0

        def shard():
            payload = build(docs, lengths, np.frombuffer(b"".join(held), "<u4"))
            return pa.RecordBatch.from_arrays(
                [*(pa.array([x], pa.int64()) for x in (number, before, tokens)), pa.array([payload], pa.binary())],
                ["number", "before", "tokens", "payload"],
            )

        for batch in slices(batches, 1):
            for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                docs.append(doc)
                held.append(ids + closing)
                lengths.append(len(ids) // 4 + 1)
                tokens += lengths[-1]
                if tokens >= SHARD_TOKENS:
                    yield shard()
                    docs, lengths, held, tokens, number, before = [], [], [], 0, number + 1, before + tokens
        if docs:
            yield shard()

    return run


def write_shards(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end: int = 2, shards: int | None = None) -> None:
    """Write the ids of all documents, in ascending doc_id order (null first, equal
    ids by a hash of the text), each with the id `end` behind it, as files of shards.

    The table at `path` holds a row for each file: `range` and `number`, in whose
    order the shards follow each other, `before`, the tokens of its range's earlier
    shards, `tokens`, its own, and `payload`, the file. Ranges
    are cut by doc_id, as many as `shards` (default: shuffle partitions). A null
    text is empty: its document is the id `end` alone. No rows: no files. Other
    columns are ignored. Spark commits a range's files as a whole, so a lost
    executor's ranges are written anew.
    """
    file = tokenizer if "/" in tokenizer else tokenizer_path(tokenizer)
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text")]
    (
        texts(docs)
        .repartitionByRange(shards or spread(docs.sparkSession), *order).sortWithinPartitions(*order)
        .mapInArrow(_shards(file, end), "number long, before long, tokens long, payload binary")
        .select(F.spark_partition_id().alias("range"), "number", "before", "tokens", "payload")
        .write.parquet(path)
    )


def read_documents(spark, path: str) -> DataFrame:
    """-> (doc_id, start, n_tokens, ids_crc32, range, number) of the documents in the
    files: `start` counts the ids of all documents before, ids_crc32 is that of the
    ids as little-endian unsigned 32-bit integers."""
    files = spark.read.schema("range int, number long, before long, tokens long, payload binary").parquet(path)
    # one number for each range, whatever the documents hold
    ranges = files.groupBy("range").agg(F.sum("tokens").alias("n")).orderBy("range").collect()
    bases = dict(zip([r.range for r in ranges], np.cumsum([0, *(r.n for r in ranges)]).tolist()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for range_, number, start, payload in zip(*(c.to_pylist() for c in batch.columns)):
                shard = Shard(payload)
                ids = shard.ids().astype("<u4")
                first = shard.first
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(first[:-1], first[1:])]
                n = len(crc)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard.doc_ids, pa.int64()), pa.array(bases[range_] + start + first[:-1]),
                        pa.array(np.diff(first)), pa.array(crc, pa.int64()),
                        pa.array([range_] * n, pa.int32()), pa.array([number] * n, pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "range", "number"],
                )

    return files.select("range", "number", "before", "payload").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long, range int, number long"
    )


def op1_wavelet_matrix(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "wavelet")
    write_shards(table(spark, sf_dir, "documents"), path)
    return read_documents(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")

"""Packing along a space-filling curve.

A document's tokens vote, by hashed signs, on a point in a few dimensions; the
point's place on a Hilbert curve is the document's key. In the order of keys the
documents form one stream of tokens, cut every `length` tokens, so neighbours on
the curve share sequences and only the stream's end could need padding: it is
cut into powers of two, which need none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogspark.llm.encode import encoder, tokenizer_path
from catalogspark.llm.frames import slices, spread, table, texts
from catalogspark.llm.shingles import mix
from catalogspark.session import cut

#: Dimensions of the points, and bits of each coordinate.
DIMENSIONS, BITS = 4, 10


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points (rows) of unsigned coordinates under
    2 ** bits: neighbouring places belong to neighbouring cells."""
    axes = [points[:, i].astype(np.int64) for i in range(points.shape[1])]
    for level in range(bits - 1, 0, -1):
        side, below = 1 << level, (1 << level) - 1
        for i in range(len(axes)):
            high = axes[i] & side != 0
            swap = np.where(high, 0, (axes[0] ^ axes[i]) & below)
            axes[0] = np.where(high, axes[0] ^ below, axes[0] ^ swap)
            if i:
                axes[i] = axes[i] ^ swap
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    turn = np.zeros_like(axes[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(axes[-1] & (1 << level) != 0, (1 << level) - 1, 0)
    place = np.zeros_like(axes[0])
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            place = place << 1 | ((axis ^ turn) >> level & 1)
    return place


def _votes(n: int) -> list[np.ndarray]:
    """Token i's votes, 0 to 255 in each dimension, from a hash; two dimensions
    share an integer, 32 bits apart, so that they are added up together."""
    hashed = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    votes = [hashed >> np.uint64(8 * d) & np.uint64(255) for d in range(DIMENSIONS)]
    return [low | high << np.uint64(32) for low, high in zip(votes[::2], votes[1::2])]


def _points(ids: list[np.ndarray], votes: list[np.ndarray]) -> np.ndarray:
    """Mean votes, spread over the range of coordinates. A sum holds the votes of
    16 million tokens; longer texts are added up in parts."""
    sums = np.zeros((len(ids), DIMENSIONS))
    for row, own in zip(sums, ids):
        for start in range(0, len(own), 1 << 24):
            for pair, lanes in enumerate(votes):
                total = int(lanes[own[start : start + (1 << 24)]].sum())
                row[2 * pair] += total & 0xFFFFFFFF
                row[2 * pair + 1] += total >> 32
    means = sums / np.array([len(own) for own in ids] or [1])[:, None] / 127.5 - 1
    return ((0.5 + 0.5 * np.tanh(6 * means)) * ((1 << BITS) - 1)).astype(np.int64)


def _encode(path: str, end: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        own = encoder(path)
        votes = _votes(max(own.library.get_vocab_size(), end + 1))
        press = zstandard.ZstdCompressor(level=1).compress
        closing = np.array([end], "<u4").tobytes()
        for batch in slices(batches, 1):
            ids = [np.frombuffer(i + closing, "<u4") for i in own.encode(batch.column(1).to_pylist())]
            keys = hilbert(_points(ids, votes), BITS)
            small = np.uint16 if len(votes[0]) <= 1 << 16 else np.uint32
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(keys), pa.array([len(i) for i in ids], pa.int64()),
                    pa.array([press(i.astype(small).tobytes()) for i in ids], pa.binary()),
                ],
                ["doc_id", "key", "n", "ids"],
            )

    return run


def _running(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = 0
    for batch in batches:
        n = batch.column(1).to_numpy()
        ends = total + np.cumsum(n)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ends - n)], ["row", "n", "before"])
        total = int(ends[-1]) if len(ends) else total


def _cuts(total: int, length: int) -> np.ndarray:
    """Starts of the sequences behind the last full one, and the end."""
    rest = total % length
    parts = [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
    return total - rest + np.cumsum([0, *parts])


def _pieces(bases: dict[int, int], total: int, length: int):
    tail = _cuts(total, length)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        open_ = zstandard.ZstdDecompressor().decompress
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc, n, payload, range_, before in zip(*(c.to_pylist() for c in batch.columns)):
                payload = open_(payload)
                ids = np.frombuffer(payload, "<u2" if len(payload) == 2 * n else "<u4").astype("<u4")
                low = bases[range_] + before
                high = low + n
                full = np.arange(low // length * length, min(high, int(tail[0])), length)
                starts = np.concatenate([full, tail[:-1]])
                numbers = np.concatenate([full // length, tail[0] // length + np.arange(len(tail) - 1)])
                ends = np.concatenate([full + length, tail[1:]])
                met = (starts < high) & (ends > low)
                for at, to, number in zip(starts[met].tolist(), ends[met].tolist(), numbers[met].tolist()):
                    a, b = max(at, low) - low, min(to, high) - low
                    piece = ids[a:b].tobytes()
                    for column, value in zip(out, (doc, a, b - a, zlib.crc32(piece), n, number, low + a - at, piece)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.binary() if name == "ids" else pa.int64()) for name, c in zip(names, out)], names
            )

    return run


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end: int = 0, length: int = 1024) -> DataFrame:
    """-> (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids), a
    row for each piece of a document in a sequence of at most `length` tokens.

    A document is the ids of its whole text with `end` behind them (`end` alone
    for a null or empty text). Its piece of `length` ids from `start` stands at
    `offset` of the sequence; `ids` are little-endian unsigned 32-bit integers and
    ids_crc32 theirs. Sequences are full but for those at the stream's end, whose
    lengths are different powers of two. Equal texts have equal keys and are
    neighbours, in any number; each row of `docs` is packed, repeated or not, with
    its doc_id or null. No rows: no pieces. Other columns are ignored.
    """
    file = tokenizer if "/" in tokenizer else tokenizer_path(tokenizer)
    encoded = cut(
        texts(docs).mapInArrow(_encode(file, end), "doc_id long, key long, n long, ids binary")
        .withColumn("row", F.monotonically_increasing_id())
    )
    placed = cut(
        encoded.select("row", "n", "key")
        .repartitionByRange(spread(docs.sparkSession), "key", "row").sortWithinPartitions("key", "row")
        .select("row", "n").mapInArrow(_running, "row long, n long, before long")
        .withColumn("range", F.spark_partition_id())
    )
    # one number for each range, whatever the documents hold
    ranges = placed.groupBy("range").agg(F.sum("n").alias("n")).orderBy("range").collect()
    ends = np.cumsum([0, *(r.n for r in ranges)]).tolist()
    bases = dict(zip([r.range for r in ranges], ends))
    return (
        encoded.select("row", "doc_id", "n", "ids").join(placed.select("row", "range", "before").hint("shuffle_hash"), "row")
        .select("doc_id", "n", "ids", "range", "before")
        .mapInArrow(
            _pieces(bases, ends[-1], length),
            "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary",
        )
    )


def op4_hilbert_order(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).drop("ids")

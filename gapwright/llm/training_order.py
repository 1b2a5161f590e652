"""Training-order materialisation: token sequences of fixed length in a keyed random order, in fixed-stride shards.

1. Every document becomes ids of a byte-level vocabulary (two bytes each) and an end mark; the stream of all documents in input order is cut
   into sequences of ``length`` tokens, the last one padded with the end mark.
2. Sequence s goes to slot P(s): a Feistel network keyed by ``key`` permutes the next even power of two, and walking its
   cycle until the value is below the number of sequences makes that a permutation of exactly these.
3. Slot ranges of ``shard_rows`` are the shards.  Pieces of sequences are dealt by shard, sorted by slot and joined, so a
   shard file holds record k of stride ``2 * length + 1`` bytes (a newline ends it) at byte ``k * stride``.  A reader that
   stopped at slot s goes on at shard ``s // shard_rows``, record ``s % shard_rows``.

Only the token counts of input partitions reach the driver (one number each).  The encoded stream is checkpointed once, so
a lost executor repeats its own part.  Null and empty texts are the end mark alone; ids play no part, so null and repeated
ids are as good as others; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapwright.llm.batches import pieces, texts_of
from gapwright.session import cut_lineage

LENGTH, SHARD_ROWS, KEY = 2048, 4096, 20240607
DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50256                 # free in the vocabulary
# Fixed value: the pattern that goes with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ROUNDS = 6


def _round(half: np.ndarray, key: int, r: int) -> np.ndarray:
    h = half + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD6E8FEB86659FD93) % 2 ** 64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def permuted(values: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """Image of ``values`` under the keyed permutation of 0 .. n - 1."""
    side = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << side) - np.uint64(1)
    out = np.asarray(values, np.uint64).copy()
    todo = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(todo):
            left, right = out[todo] >> side, out[todo] & mask
            for r in range(ROUNDS):
                left, right = right, left ^ (_round(right, key, r) & mask)
            out[todo] = (left << side) | right
            todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


@functools.lru_cache(maxsize=2)
def encoding(ranks_file: str) -> tiktoken.Encoding:
    """One encoder per Python worker."""
    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _encode(ranks_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(ranks_file).encode_ordinary
        pack = zstandard.ZstdCompressor(level=1)
        for batch in pieces(batches, "__text"):
            parts = [np.array([*encode(t.as_py()), END], "<u2") for t in texts_of(batch.column("__text"))]
            stream = np.concatenate(parts)
            yield pa.RecordBatch.from_arrays([pa.array([len(stream)], pa.int64()), pa.array([pack.compress(stream.tobytes())], pa.binary())],
                                             ["n", "stream"])
    return run


def _cut(bases: dict[int, int], total: int, length: int, shard_rows: int, key: int):
    """Parts of sequences from the parts of the stream that input partitions hold."""
    n = -(-total // length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        at: dict[int, int] = {}
        for batch in batches:
            for part, raw in zip(batch.column("part").to_pylist(), batch.column("stream").to_pylist()):
                stream = unpack.decompress(raw)
                g = at.setdefault(part, bases[part])
                m = len(stream) // 2
                at[part] = g + m
                seq = np.arange(g // length, (g + m - 1) // length + 1)
                lo, hi = np.maximum(seq * length, g), np.minimum((seq + 1) * length, g + m)
                slot = permuted(seq, n, key)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((slot // shard_rows).astype(np.int64)), pa.array(slot), pa.array(seq), pa.array((lo - seq * length).astype(np.int32)),
                     pa.array([stream[2 * (a - g):2 * (b - g)] for a, b in zip(lo.tolist(), hi.tolist())], pa.binary())],
                    ["shard", "slot", "sequence", "place", "tokens"])
    return run


def _join(length: int, shard_rows: int):
    """Whole sequences from their sorted parts."""
    pad = np.array([END], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None                     # (slot, sequence, parts)
        for batch in batches:
            done = []
            for slot, seq, tokens in zip(*(batch.column(c).to_pylist() for c in ("slot", "sequence", "tokens"))):
                if held and held[0] == slot:
                    held[2].append(tokens)
                else:
                    if held:
                        done.append(held)
                    held = (slot, seq, [tokens])
            yield from _records(done, length, shard_rows, pad)
        if held:
            yield from _records([held], length, shard_rows, pad)
    return run


def _records(done: list[tuple], length: int, shard_rows: int, pad: bytes) -> Iterator[pa.RecordBatch]:
    if done:
        slot = np.array([d[0] for d in done], np.int64)
        raw = [b"".join(d[2]) for d in done]
        yield pa.RecordBatch.from_arrays(
            [pa.array(slot // shard_rows), pa.array(slot), pa.array([d[1] for d in done], pa.int64()),
             pa.array(slot % shard_rows * (2 * length + 1)), pa.array([len(r) // 2 for r in raw], pa.int32()),
             pa.array([r + pad * (length - len(r) // 2) for r in raw], pa.binary())],
            ["shard", "slot", "sequence", "byte_offset", "n_tokens", "tokens"])


def ordered(docs: DataFrame, text: str = "text", length: int = LENGTH, shard_rows: int = SHARD_ROWS, key: int = KEY,
            ranks_file: str = DEFAULT_RANKS) -> DataFrame:
    """One row per sequence in training order: shard, slot, sequence (its place in the stream), byte_offset in the shard
    file, n_tokens before padding, tokens (little-endian 16-bit ids)."""
    stream = cut_lineage(docs.select(F.col(text).alias("__text")).mapInArrow(_encode(ranks_file), "n bigint, stream binary")
                         .withColumn("part", F.spark_partition_id()))
    sums = {r["part"]: r["n"] for r in stream.groupBy("part").agg(F.sum("n").alias("n")).collect()}   # one per input partition
    bases, total = {}, 0
    for part in sorted(sums):
        bases[part], total = total, total + sums[part]
    shards = max(1, -(-(-(-total // length)) // shard_rows))
    parts = stream.mapInArrow(_cut(bases, total, length, shard_rows, key), "shard bigint, slot bigint, sequence bigint, place int, tokens binary")
    return (parts.repartition(shards, "shard").sortWithinPartitions("shard", "slot", "place")
            .mapInArrow(_join(length, shard_rows), "shard bigint, slot bigint, sequence bigint, byte_offset bigint, n_tokens int, tokens binary"))


def write_shards(rows: DataFrame, path: str) -> None:
    """One folder ``shard=<k>`` with one file of fixed-stride records per shard; the text writer puts bytes out as they are."""
    (rows.select("shard", F.col("tokens").cast("string").alias("value")).write.partitionBy("shard")
     .option("lineSep", "\n").mode("errorifexists").text(path))


def read_shards(spark: SparkSession, path: str, slot: int = 0, length: int = LENGTH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(slot, tokens) from ``slot`` on; earlier shards are not opened."""
    stride = 2 * length + 1
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).filter(F.col("shard") >= slot // shard_rows))
    first = F.when(F.col("shard") == slot // shard_rows, F.lit(slot % shard_rows)).otherwise(F.lit(0))
    last = (F.octet_length("content") / stride).cast("int") - 1
    each = files.filter(first <= last).select("shard", "content", F.explode(F.sequence(first, last)).alias("k"))
    return each.select((F.col("shard") * shard_rows + F.col("k")).alias("slot"), F.expr(f"substring(content, k * {stride} + 1, {2 * length})").alias("tokens"))

"""Line dedup: two Bloom filters find suspected repeats, only those are counted exactly and removed.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased.

1. Every task reduces its lines to distinct 64-bit hashes per batch and a flag "in two documents of this batch".
   Hashes are dealt out by value, so a line that a third of all documents hold arrives once per batch.
2. Each hash partition feeds a once-seen and a twice-seen Bloom filter and keeps the hashes of the twice-seen one.  The
   filters are local to the partition (spark.sql.shuffle.partitions of them) and sized by the 8-byte hashes it holds;
   nothing is broadcast.
3. Only lines with a suspected hash are shuffled, as 128-bit digests, and their documents counted exactly.
4. Dropped digests go back to their documents, whose texts are rebuilt line by line.

Null and empty texts are one empty line.  Rows with a null id count as one document; rows that repeat an id share a
decision, which depends on the key alone.  Empty tables give empty results; other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwright.llm.batches import NO_ID, coded, flat, hash64, ids_of, pieces, texts_of
from gapwright.session import cut_lineage

FILTER_BITS = 16            # filter bits per hash, two probes


def _keys(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct keys, key code of every line, row offsets."""
    lines, at = flat(pc.split_pattern(texts, "\n"))
    distinct, codes = coded(pc.ascii_lower(pc.ascii_trim_whitespace(lines)))
    return distinct, codes, at


def _per_doc(batch: pa.RecordBatch, min_chars: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct keys and the distinct (key code, document id) pairs of a batch; short keys left out."""
    distinct, codes, at = _keys(texts_of(batch.column("__text")))
    ids = np.repeat(ids_of(batch.column("__id")), np.diff(at))
    long_enough = pc.greater_equal(pc.utf8_length(distinct), min_chars).to_numpy(zero_copy_only=False)
    use = long_enough[codes]
    codes, ids = codes[use], ids[use]
    order = np.lexsort((ids, codes))
    codes, ids = codes[order], ids[order]
    new = np.ones(len(codes), bool)
    new[1:] = (codes[1:] != codes[:-1]) | (ids[1:] != ids[:-1])
    return distinct, codes[new], ids[new]


def _hash_chunks(parts: int, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "__text"):
            distinct, codes, _ = _per_doc(batch, min_chars)
            if not len(codes):
                continue
            h = hash64(distinct)
            seen, n = np.unique(codes, return_counts=True)
            packed = (h[seen] & ~np.uint64(1)) | (n > 1).astype(np.uint64)     # lowest bit: in two documents of the batch
            part = ((packed >> np.uint64(1)) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            part, packed = part[order], packed[order]
            cut = np.flatnonzero(np.diff(part)) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[np.r_[0, cut]]), pa.array([x.tobytes() for x in np.split(packed, cut)], pa.binary())],
                ["part", "hashes"])
    return run


def _suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chunks = [np.frombuffer(x, np.uint64) for b in batches for x in b.column("hashes").to_pylist()]
    total = sum(map(len, chunks))
    if not total:
        return
    bits = max(10, int(np.ceil(np.log2(total * FILTER_BITS))))
    once, twice = np.zeros(1 << bits, bool), np.zeros(1 << bits, bool)
    shift, odd = np.uint64(64 - bits), (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))

    def probes(h: np.ndarray) -> list[np.ndarray]:
        return [((h * k) >> shift).astype(np.int64) for k in odd]

    for c in chunks:
        h = c & ~np.uint64(1)
        p, q = probes(h)
        again = (once[p] & once[q]) | (c & np.uint64(1)).astype(bool)
        twice[p[again]] = True
        twice[q[again]] = True
        once[p] = True
        once[q] = True
    found = np.unique(np.concatenate([h[twice[p] & twice[q]] for h in (c & ~np.uint64(1) for c in chunks)
                                      for p, q in [probes(h)]]))
    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["h"])


def _occurrences(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "__text"):
            distinct, codes, ids = _per_doc(batch, min_chars)
            h = (hash64(distinct) & ~np.uint64(1)).view(np.int64)
            digest = pa.array([xxhash.xxh3_128_digest(x) for x in distinct.cast(pa.large_binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(h[codes]), digest.take(pa.array(codes)), pa.array(ids)],
                                             ["h", "digest", "id"])
    return run


def suspected(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """(digest, id) of lines whose hash is in a twice-seen filter, once per document; ``docs`` has ``__id``, ``__text``."""
    spark = docs.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = cut_lineage(docs.mapInArrow(_hash_chunks(width, min_chars), "part int, hashes binary"))
    hashes = cut_lineage(chunks.repartition(width, "part").mapInArrow(_suspects, "h bigint"))
    spread = docs.mapInArrow(_occurrences(min_chars), "h bigint, digest binary, id bigint")
    return cut_lineage(spread.join(hashes, "h", "left_semi").select("digest", "id"))


def repeated_keys(found: DataFrame, min_docs: int) -> DataFrame:
    """Digests of lines in at least ``min_docs`` documents, with the smallest id that holds each."""
    once = found.distinct()
    return once.groupBy("digest").agg(F.count("*").alias("n_docs"), F.min("id").alias("first_id")).filter(F.col("n_docs") >= min_docs)


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "__text"):
        texts = texts_of(batch.column("__text")).to_pylist()
        lists = batch.column("__drop").to_pylist()
        n_lines, n_dropped, kept = [], [], []
        for t, drop in zip(texts, lists):
            lines = t.split("\n")
            n_lines.append(len(lines))
            if drop:
                drop = set(drop)
                stay = [x for x in lines if xxhash.xxh3_128_digest(_key(x)) not in drop]
            else:
                stay = lines
            n_dropped.append(len(lines) - len(stay))
            kept.append(t if len(stay) == len(lines) else "\n".join(stay))
        yield pa.RecordBatch.from_arrays(
            [batch.column("__row"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())],
            ["__row", "n_lines", "n_dropped", "kept_text"])


_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _key(line: str) -> bytes:
    return line.strip(" \t\n\x0b\x0c\r").encode().translate(_LOWER)


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none",
                id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` as the struct ``__row`` with ``n_lines``, ``n_dropped`` and ``kept_text``.

    Lines of keys with at least ``min_chars`` code points found in at least ``min_docs`` documents go: everywhere with
    ``keep="none"``, everywhere but in the document with the smallest id with ``keep="first"``.
    """
    if keep not in ("none", "first"):
        raise ValueError(keep)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    base = docs.select(row.alias("__row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("__id"), F.col(text).alias("__text"))
    found = suspected(base.select("__id", "__text"), min_chars)
    keys = cut_lineage(repeated_keys(found, min_docs))
    hits = found.join(keys, "digest")
    if keep == "first":
        hits = hits.filter(F.col("id") != F.col("first_id"))
    drops = cut_lineage(hits.groupBy(F.col("id").alias("__id")).agg(F.collect_set("digest").alias("__drop")))
    joined = base.join(drops, "__id", "left").select("__row", "__text", "__drop")
    kind = docs.select(row.alias("r")).schema["r"].dataType.simpleString()
    return joined.mapInArrow(_rebuild, f"__row {kind}, n_lines bigint, n_dropped bigint, kept_text string")


def digest_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: id, line counts and the digest of what stays."""
    out = dedup_lines(docs.select(id_col, "text"), id_col=id_col)
    return out.select(F.col(f"__row.{id_col}").alias(id_col), "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def clean(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """``docs`` with repeated lines gone, columns unchanged; ``n_chars`` follows the text where it exists."""
    out = dedup_lines(docs, min_docs)
    cols = []
    for c in docs.columns:
        v = F.col(f"__row.`{c}`")
        if c == "text":
            v = F.col("kept_text")
        elif c == "n_chars":
            v = F.length("kept_text").cast(docs.schema[c].dataType)
        cols.append(v.alias(c))
    return out.select(*cols)

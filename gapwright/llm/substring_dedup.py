"""Substring dedup: every byte inside a 200-byte string that starts anywhere else too is removed.

The windows (200-byte strings) are sorted by digits, most significant first, and only as deep as 200 bytes; after each
pass a window alone in its group is out, and equal groups at full depth are exactly the repeated windows.

* First digit: the window's anchor, the 64-byte string inside it with the smallest hash.  Neighbouring windows share
  anchors, so one record (a run of window starts) stands for about 60 windows, and every record's anchor and whole content
  are digested.  Runs with an anchor that occurs once are out; runs with equal content are repeated as a whole.
* The runs left over lie at the borders of shared passages.  Their windows are grouped by distance from the anchor in
  ranges of 16, then 4, then 1.  The bytes that all windows of a range share are the next digit: alone means out, equal
  content means repeated, anything else goes one pass deeper.

All digests that decide a repeat have 128 bits.  Groups are counted by partial aggregation and flags are joined back to
their members, so a passage in a third of all documents is never gathered.  Texts longer than 1 MB are read in
overlapping blocks.  Null texts are empty; rows are known by id and 64-bit hash of the text, a null id
by its text's crc32 and length besides; rows that repeat id and text repeat each
other's windows and are treated alike; texts under 200 bytes stay whole; extra columns are carried by ``dedup``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwright.llm.batches import ids_of, pieces, ragged
from gapwright.session import cut_lineage

SPAN = 200                  # bytes of a window
GRAM = 64                   # bytes of an anchor
BLOCK = 1 << 20             # window starts handled at once
WIDTHS = (16, 4, 1)         # windows per range in the passes after the first
PLACE_BITS = np.uint64(26)

_DRAW = np.random.default_rng(7)
_LETTER = [_DRAW.integers(0, 2 ** 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_BACK = [pow(b, -1, 2 ** 64) for b in _BASE]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


class Rolling:
    """Hashes of any substrings of ``data`` from one running sum; two lanes give independent hashes."""

    def __init__(self, data: np.ndarray, lane: int):
        self.sum = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_LETTER[lane][data] * _powers(_BASE[lane], len(data)), out=self.sum[1:])
        self.back = _powers(_BACK[lane], len(data) + 1)

    def hash(self, start, stop) -> np.ndarray:
        return _mix((self.sum[stop] - self.sum[start]) * self.back[start])


def runs(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per run of windows with one anchor: first start, number of starts, anchor place, anchor hash, content hash."""
    none = np.zeros(0, np.int64)
    if len(data) < SPAN:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    first_lane = Rolling(data, 0)
    n = len(data) - GRAM + 1
    h = _mix((first_lane.sum[GRAM:] - first_lane.sum[:-GRAM]) * first_lane.back[:n])
    low = (np.uint64(1) << PLACE_BITS) - np.uint64(1)
    least = (h & ~low) | np.arange(n, dtype=np.uint64)          # ties go to the first place
    wide, width = SPAN - GRAM + 1, 1
    while width < wide:                                         # minimum over ``wide`` places by doubling
        step = min(width, wide - width)
        least = np.minimum(least[:len(least) - step], least[step:])
        width += step
    place = (least & low).astype(np.int64)
    inside = np.zeros(len(place), bool)                         # windows that do not cross documents
    inside[ragged(at[:-1], np.maximum(np.diff(at) - SPAN + 1, 0))] = True
    cut = np.ones(len(place) + 1, bool)
    cut[1:-1] = (place[1:] != place[:-1]) | ~inside[1:] | ~inside[:-1]
    begin = np.flatnonzero(cut[:-1] & inside)
    count = np.flatnonzero(cut[1:] & inside) + 1 - begin
    place = place[begin]
    return begin, count, place, h[place], Rolling(data, 1).hash(begin, begin + count + SPAN - 1)


def _key(text: bytes) -> int:
    """What Spark's ``xxhash64`` gives for the text."""
    h = xxhash.xxh64_intdigest(text, 42)
    return h - (h >> 63 << 64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list, list, list]]:
    """(bytes, offsets, ids, keys, places in their texts) of blocks of whole short texts or parts of long ones."""
    for batch in pieces(batches, "__text", BLOCK):
        ids = ids_of(batch.column("__id")).tolist()
        texts = [b"" if x is None else x for x in batch.column("__text").cast(pa.binary()).to_pylist()]
        long = [len(t) > 2 * BLOCK for t in texts]
        short = [k for k, x in enumerate(long) if not x]
        if short:
            part = [texts[k] for k in short]
            yield (np.frombuffer(b"".join(part), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in part])]).astype(np.int64),
                   [ids[k] for k in short], [_key(t) for t in part], [0] * len(part))
        for k in (k for k, x in enumerate(long) if x):
            key = _key(texts[k])
            for a in range(0, len(texts[k]) - SPAN + 1, BLOCK):
                data = np.frombuffer(texts[k], np.uint8, min(BLOCK + SPAN - 1, len(texts[k]) - a), a)
                yield data, np.array([0, len(data)]), [ids[k]], [key], [a]


def _anchor_chunks(parts: int):
    """Anchor and content hashes of all runs, packed by part: what a batch holds twice is said once, with a flag."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for data, at, *_ in _blocks(batches):
                _, _, _, anchor, content = runs(data, at)
                if not len(anchor):
                    continue
                order = np.lexsort((content, anchor))
                anchor, content = anchor[order], content[order]
                new = np.r_[True, (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])]
                begin = np.flatnonzero(new)
                many = np.diff(np.r_[begin, len(anchor)]) > 1
                rec = np.stack([anchor[begin], (content[begin] & ~np.uint64(1)) | many], axis=1)
                part = (rec[:, 0] % np.uint64(parts)).astype(np.int32)
                order = np.argsort(part, kind="stable")
                part, rec = part[order], rec[order]
                cut = np.flatnonzero(np.diff(part)) + 1
                yield pa.RecordBatch.from_arrays([pa.array(part[np.r_[0, cut]]), pa.array([x.tobytes() for x in np.split(rec, cut)], pa.binary())],
                                                 ["part", "recs"])
    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contents whose anchor occurs again: whether the content itself does, and whether the anchor has several contents."""
    chunks = [np.frombuffer(x, np.uint64).reshape(-1, 2) for b in batches for x in b.column("recs").to_pylist()]
    if not chunks:
        return
    rec = np.concatenate(chunks)
    flag, content, anchor = (rec[:, 1] & np.uint64(1)).astype(np.int64), rec[:, 1] & ~np.uint64(1), rec[:, 0]
    order = np.lexsort((content, anchor))
    flag, content, anchor = flag[order], content[order], anchor[order]
    begin = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])])
    seen = np.add.reduceat(flag + 1, begin)
    anchor, content = anchor[begin], content[begin]
    group = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    size = np.diff(np.r_[group, len(anchor)])
    mixed = np.repeat(size > 1, size)
    use = (seen > 1) | mixed
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor[use].view(np.int64), content[use].view(np.int64), seen[use] > 1, mixed[use])],
                                     ["anchor", "content", "whole", "mixed"])


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for data, at, ids, keys, places in _blocks(batches):
            begin, count, place, anchor, content = runs(data, at)
            doc = np.searchsorted(at, begin, "right") - 1
            start = begin - at[doc] + np.array(places, np.int64)[doc]
            packed = (start << 16) | (count << 8) | (place - begin)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.view(np.int64)), pa.array((content & ~np.uint64(1)).view(np.int64)),
                 pa.array(np.array(ids, np.int64)[doc]), pa.array(np.array(keys, np.int64)[doc]), pa.array(packed)],
                ["anchor", "content", "id", "key", "run"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows with compressed texts, for the shuffle that brings them to their runs."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        packed = pa.array([pack(t) for t in batch.column("__text").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([packed if n == "__text" else batch.column(n) for n in batch.schema.names], batch.schema.names)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in pieces(batches, "__text", BLOCK):
        texts = pa.array([unpack(t) for t in batch.column("__text").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([texts if n == "__text" else batch.column(n) for n in batch.schema.names], batch.schema.names)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of every open run."""
    for batch in _unpacked(batches):
        ids, keys, out_run, out_bytes = [], [], [], []
        texts = batch.column("__text")
        for i, c, t, open_ in zip(ids_of(batch.column("__id")).tolist(), batch.column("key").to_pylist(), texts, batch.column("open").to_pylist()):
            t = t.as_buffer()
            for r in open_:
                a = r >> 16
                ids.append(i)
                keys.append(c)
                out_run.append(r)
                out_bytes.append(t.slice(a, ((r >> 8) & 255) + SPAN - 1).to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(out_run, pa.int64()),
                                          pa.array(out_bytes, pa.binary())], ["id", "key", "run", "bytes"])


def _range_digests(width: int, parent: int):
    """Per range of ``width`` windows: hash of the bytes they share (core) and of all their bytes (two lanes).

    Ranges count distances from the anchor, so equal windows fall into equal ranges wherever their runs begin.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in pieces(batches, "bytes", BLOCK):
                column = batch.column("bytes")
                data = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
                size = pc.binary_length(column).to_numpy().astype(np.int64)
                base = np.concatenate([[0], np.cumsum(size)])[:-1]
                packed = batch.column("run").to_numpy()
                count, anchor = (packed >> 8) & 255, packed & 255            # distances anchor - count + 1 .. anchor
                near, far = anchor - count + 1, anchor
                if parent:
                    lists = batch.column("ranges")
                    at = lists.offsets.to_numpy().astype(np.int64)
                    row = np.repeat(np.arange(len(packed)), np.diff(at))
                    above = lists.flatten().to_numpy().astype(np.int64)
                    near, far = np.maximum(near[row], above * parent), np.minimum(far[row], above * parent + parent - 1)
                else:
                    row = np.arange(len(packed))
                n = far // width - near // width + 1
                rng = ragged(near // width, n)
                row, near, far = np.repeat(row, n), np.repeat(near, n), np.repeat(far, n)
                zero = base[row] + anchor[row]                              # place of the anchor
                lo, hi = np.maximum(rng * width, near), np.minimum(rng * width + width - 1, far)   # windows present
                one, two = Rolling(data, 0), Rolling(data, 1)
                core = one.hash(zero - rng * width, zero - (rng * width + width - 1) + SPAN)
                salt = _mix((lo * 256 + hi).astype(np.uint64))
                f1 = one.hash(zero - hi, zero - lo + SPAN) ^ salt
                f2 = two.hash(zero - hi, zero - lo + SPAN)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("cid").take(pa.array(row)), pa.array(rng.astype(np.int32)), pa.array(lo.astype(np.int32)),
                     pa.array(hi.astype(np.int32)), *(pa.array(x.view(np.int64)) for x in (core, f1, f2))],
                    ["cid", "rng", "lo", "hi", "core", "f1", "f2"])
    return run


def _border_windows(contexts: DataFrame) -> DataFrame:
    """(cid, lo, hi): distances from the anchor whose windows are repeated, for open runs."""
    found, ranges, parent = None, None, 0
    for width in WIDTHS:
        rows = contexts if ranges is None else contexts.join(ranges, "cid")
        marks = cut_lineage(rows.mapInArrow(_range_digests(width, parent), "cid bigint, rng int, lo int, hi int, core bigint, f1 bigint, f2 bigint"))
        kinds = marks.groupBy("core", "f1", "f2").agg(F.count("*").alias("n"), F.min(F.struct("cid", "rng")).alias("one"))
        kinds = cut_lineage(kinds)
        whole = cut_lineage(kinds.filter("n > 1").select("f1", "f2", "one"))
        hit = marks.join(whole.select("f1", "f2"), ["f1", "f2"], "left_semi").select("cid", "lo", "hi")
        found = hit if found is None else found.unionByName(hit)
        if width > 1:
            # one deeper: ranges whose shared bytes occur in several contents; of equal contents one stands for all
            cores = cut_lineage(kinds.groupBy("core").agg(F.count("*").alias("k")).filter("k > 1").select("core"))
            left = marks.join(cores, "core", "left_semi").join(whole, ["f1", "f2"], "left")
            left = left.filter(F.col("one").isNull() | (F.col("one") == F.struct("cid", "rng")))
            ranges = cut_lineage(left.groupBy("cid").agg(F.collect_set("rng").alias("ranges")))
            parent = width
    return found


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(id, key, spans) of documents with repeated windows; ``docs`` has ``__id``, ``key``, ``__text`` (binary).

    ``spans`` packs first window start and number of starts as ``start * 65536 + number * 256``.
    """
    spark = docs.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select("__id", "__text")
    again = cut_lineage(texts.mapInArrow(_anchor_chunks(width), "part int, recs binary").repartition(width, "part")
                        .mapInArrow(_repeated, "anchor bigint, content bigint, whole boolean, mixed boolean")
                        .withColumn("aid", F.monotonically_increasing_id()))
    rows = texts.mapInArrow(_run_rows, "anchor bigint, content bigint, id bigint, key bigint, run bigint")
    shared = rows.join(again, ["anchor", "content"]).select("id", "key", "run", "whole", "mixed", "aid")
    lists = cut_lineage(shared.groupBy("id", "key").agg(
        F.collect_set(F.when(F.col("whole"), F.col("run"))).alias("spans"),
        F.collect_set(F.when(~F.col("whole"), F.col("run"))).alias("single"),
        F.collect_set(F.when(F.col("whole") & F.col("mixed"), F.struct("run", "aid"))).alias("twin")))
    # open runs: single contents, and one of each repeated content that single ones may overlap
    twins = (lists.select("id", "key", F.explode("twin").alias("t")).groupBy("t.aid").agg(F.min(F.struct("id", "key", "t.run")).alias("one"))
             .groupBy("one.id", "one.key").agg(F.collect_set("one.run").alias("also")))
    none = F.array().cast("array<bigint>")
    opened = (lists.select("id", "key", "single").join(cut_lineage(twins), ["id", "key"], "left")
              .select(F.col("id").alias("__id"), "key", F.concat("single", F.coalesce("also", none)).alias("open")).filter(F.size("open") > 0))
    contexts = cut_lineage(docs.mapInArrow(_pack, docs.schema).join(opened, ["__id", "key"]).select("__id", "key", "__text", "open").dropDuplicates(["__id", "key"])
                           .mapInArrow(_contexts, "id bigint, key bigint, run bigint, bytes binary")
                           .withColumn("cid", F.monotonically_increasing_id()))
    hit = _border_windows(contexts.select("cid", "run", "bytes"))
    start = F.shiftright("run", 16) + F.col("run").bitwiseAND(F.lit(255)) - F.col("hi")
    border = (contexts.select("cid", "id", "key", "run").join(hit, "cid").groupBy("id", "key")
              .agg(F.collect_set(start * 65536 + (F.col("hi") - F.col("lo") + 1) * 256).alias("border")))
    out = lists.select("id", "key", "spans").join(border, ["id", "key"], "left")
    return (out.select(F.col("id").alias("__id"), "key", F.concat("spans", F.coalesce("border", none)).alias("spans"))
            .filter(F.size("spans") > 0))


def _cut(text: bytes, spans: list[int]) -> tuple[bytes, int, int]:
    """(bytes that stay, number removed, number of removed stretches)."""
    kept, at, removed, stretches = [], 0, 0, 0
    end = -1
    for s in sorted(spans):
        a, b = s >> 16, (s >> 16) + ((s >> 8) & 255) + SPAN - 1
        if a > end:                                   # a new stretch: text between it and the last one stays
            kept.append(text[at:a])
            stretches += 1
            removed += b - a
            at = end = b
        elif b > end:
            removed += b - end
            at = end = b
    kept.append(text[at:])
    return b"".join(kept), removed, stretches


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _unpacked(batches):
        n, removed, stretches, kept = [], [], [], []
        for t, spans in zip(batch.column("__text").to_pylist(), batch.column("spans").to_pylist()):
            k, r, s = _cut(t, spans or [])
            n.append(len(t))
            removed.append(r)
            stretches.append(s)
            kept.append(k)
        yield pa.RecordBatch.from_arrays([batch.column("__row"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(stretches, pa.int64()),
                                          pa.array(kept, pa.binary()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])],
                                         ["__row", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` without their text as the struct ``__row`` with n_bytes, n_removed, n_spans, kept (binary) and its SHA-256."""
    row = F.struct(F.col(id_col), *(F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text)))
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    other = F.shiftleft(F.crc32(raw), 31).bitwiseOR(F.octet_length(raw).cast("long"))       # stands for a null id
    base = docs.select(row.alias("__row"), F.coalesce(F.col(id_col).cast("long"), other).alias("__id"),
                       F.xxhash64(raw).alias("key"), raw.alias("__text"))
    spans = cut_lineage(repeated_runs(base.select("__id", "key", "__text")))
    kind = base.schema["__row"].dataType.simpleString()
    return base.mapInArrow(_pack, base.schema).join(spans, ["__id", "key"], "left").select("__row", "__text", "spans").mapInArrow(
        _finish, f"__row {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string")


def digest_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: id, bytes, bytes and stretches removed, and the digest of what stays."""
    out = dedup(docs.select(F.col(id_col), F.col("text")), id_col)
    return out.select(F.col(f"__row.{id_col}").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256")

"""Near-duplicate detection by b-bit MinHash.

A document's set holds the hashes of its distinct 5-word shingles (A-Z lower-cased, words split at ``[\\x20\\x09-\\x0D]``).
Each set gives 128 minima.  Groups of four full minima form 32 band keys for candidate search; of every minimum only the
lowest two bits are kept, packed into four 64-bit words, and the similarity of a candidate pair is estimated from the
bit count of the XOR, corrected for chance collisions.  Pairs whose estimate is clearly too low are dropped, the others
are confirmed on full sets.

* Documents with equal sets form one class; only its smallest id takes part in the search.
* A bucket of equal band keys is compared with one hub first.  Once confirmed links have joined components, only members
  outside a bucket's largest component are compared with the rest of it, exactly and in blocks of 128 by 128 sets that
  give back one link per document and component.  No pair between components stays unseen, and a group of copies never
  turns into rows for all its pairs.
* A pair at exactly 0.75 misses all 32 bands with probability 5e-6; the estimate's cut-off lies six deviations below.

Null or wordless texts have no set and link with nothing.  Rows with a null id are returned unlinked.  Rows that repeat
an id count as one document with several texts.  Empty tables give empty results; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwright.llm.batches import NO_ID, hash64, ids_of, pieces, texts_of, words_of
from gapwright.session import cut_lineage

WIDTH = 5                   # words in a shingle
PERMS, ROWS, BITS = 128, 4, 2
SLACK = 0.28                # six standard deviations of the corrected estimate at 0.75
BLOCK = 128                 # sets on either side of one exact comparison of blocks, on average
BLOCK_SHINGLES = 200_000    # and shingles, on average beside one longer set

_DRAW = np.random.default_rng(20240607)
_MUL = (_DRAW.integers(0, 2 ** 32, PERMS, dtype=np.uint32) | np.uint32(1))[:, None]
_ADD = _DRAW.integers(0, 2 ** 32, PERMS, dtype=np.uint32)[:, None]
_FOLD = _DRAW.integers(0, 2 ** 63, ROWS, dtype=np.uint64) | np.uint64(1)
_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xD6E8FEB86659FD93)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _B
    h = (h ^ (h >> np.uint64(29))) * _A
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    distinct, codes, at = words_of(texts, lower=True)
    w = hash64(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    full = np.zeros(max(0, len(w) - WIDTH + 1), np.uint64)
    for k in range(WIDTH):
        full = full * _A + w[k:k + len(full)]
    full = _mix(full)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= WIDTH:
            out.append(np.unique(full[a:b - WIDTH + 1]))
        elif b > a:                                   # the whole sequence is the one shingle
            h = np.uint64(b - a)
            for x in w[a:b]:
                h = h * _A + x
            out.append(_mix(np.array([h ^ np.uint64(0x5851F42D4C957F2D)])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minima(values: np.ndarray) -> np.ndarray:
    """The full 32-bit minima of one set."""
    x = (values ^ (values >> np.uint64(32))).astype(np.uint32)
    best = np.full(PERMS, 2 ** 32 - 1, np.uint32)
    for a in range(0, len(x), 4096):
        np.minimum(best, (x[None, a:a + 4096] * _MUL + _ADD).min(axis=1), out=best)
    return best


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in pieces(batches, "__text"):
            sets = shingle_sets(texts_of(batch.column("__text")))
            sig = np.stack([minima(s) for s in sets])
            keys = _mix((sig.reshape(len(sets), -1, ROWS).astype(np.uint64) * _FOLD).sum(axis=2, dtype=np.uint64)
                        + np.arange(PERMS // ROWS, dtype=np.uint64) * _A)
            low = (sig & np.uint32(2 ** BITS - 1)).astype(np.uint64).reshape(len(sets), -1, 64 // BITS)
            packed = (low << np.arange(0, 64, BITS, dtype=np.uint64)).sum(axis=2, dtype=np.uint64).view(np.int64)
            n = np.array([len(s) for s in sets], np.int64)
            width = keys.shape[1]
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * width), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids_of(batch.column("__id"))), pa.array(n),
                 pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), bands,
                 *(pa.array(packed[:, k].copy()) for k in range(packed.shape[1]))],
                ["id", "n", "set_key", "bands", *(f"s{k}" for k in range(packed.shape[1]))])


SIGNATURE = [f"s{k}" for k in range(PERMS * BITS // 64)]
_FP = "id bigint, n bigint, set_key binary, bands array<bigint>, " + ", ".join(f"{s} bigint" for s in SIGNATURE)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in pieces(batches, "__text"):
            sets = shingle_sets(texts_of(batch.column("__text")))
            yield pa.RecordBatch.from_arrays([batch.column("__id"), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "set"])


def _between(percent: int):
    """Links between two blocks of one bucket: at most one for each left document and right component."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, comps = (right.column(c).to_numpy() for c in ("y_id", "y_comp"))
        parts = [np.frombuffer(v, np.uint64) for v in right.column("y_set").to_pylist()]
        n = np.array([len(p) for p in parts], np.int64)
        found: set[tuple[int, int]] = set()
        if len(parts) and left.num_rows:
            values, at = np.concatenate(parts), np.concatenate([[0], np.cumsum(n)])
            for a, comp, raw in zip(left.column("x_id").to_pylist(), left.column("x_comp").to_pylist(), left.column("x_set").to_pylist()):
                own = np.frombuffer(raw, np.uint64)
                hit = own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values
                both = np.diff(np.concatenate([[0], np.cumsum(hit)])[at])
                link = np.flatnonzero((comps != comp) & (100 * both >= percent * (n + len(own) - both)))
                for k in link[np.unique(comps[link], return_index=True)[1]]:
                    found.add((a, int(ids[k])))
        a, b = zip(*sorted(found)) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return run


def _confirm(numerator: int, denominator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("set_a"), batch.column("set_b"))):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if len(x) > len(y):
                    x, y = y, x
                if not len(x):
                    continue
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                hit[i] = denominator * both >= numerator * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(hit))
    return run


def estimate(left: str, right: str) -> Column:
    """Collision-corrected similarity of the packed signatures under two prefixes."""
    odd = F.lit(0x5555555555555555)
    differ = None
    for s in SIGNATURE:
        x = F.col(left + s).bitwiseXOR(F.col(right + s))
        one = F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(odd))
        differ = one if differ is None else differ + one
    chance = 2.0 ** -BITS
    return ((1 - differ / F.lit(float(PERMS))) - chance) / (1 - chance)


def components(edges: DataFrame, settle=cut_lineage) -> DataFrame:
    """(id, comp): smallest id reachable, for every id in the undirected ``edges`` (a, b).

    Minimum over neighbours, then a jump to the label of the label; both rows and rounds stay small because links are
    stars around hubs.  Every round is checkpointed by ``settle``.
    """
    both = settle(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = settle(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("comp")).withColumnRenamed("a", "id"))
    while True:
        near = (both.join(labels.select(F.col("id").alias("b"), F.col("comp").alias("c")), "b").groupBy("a").agg(F.min("c").alias("c")))
        step = settle(labels.join(near.withColumnRenamed("a", "id"), "id").select("id", F.col("comp").alias("old"), F.least("comp", "c").alias("comp")))
        jump = step.select(F.col("id").alias("comp"), F.col("comp").alias("to"))
        labels = settle(step.join(jump, "comp").select("id", "old", F.col("to").alias("comp")))
        if labels.filter(F.col("old") != F.col("comp")).isEmpty():
            return labels.select("id", "comp")
        labels = labels.select("id", "comp")


class Linker:
    """Candidate search and confirmation over one table of documents (``__id``, ``__text``)."""

    def __init__(self, docs: DataFrame, percent: int):
        self.percent = percent
        self.docs = docs
        self.prints = cut_lineage(docs.mapInArrow(_fingerprint, _FP))
        named = self.prints.filter((F.col("n") > 0) & (F.col("id") != NO_ID))
        heads = cut_lineage(named.groupBy("set_key").agg(F.min("id").alias("rep")))
        self.classes = named.select("id", "n", "set_key").join(heads, "set_key").select("id", "rep")
        self.nodes = named.join(heads, "set_key").filter(F.col("id") == F.col("rep")).select("id", "n", "bands", *SIGNATURE)

    def likely(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose sizes and signature estimate allow the similarity."""
        side = self.nodes.select("id", "n", *SIGNATURE)
        for p in ("a", "b"):
            pairs = pairs.join(side.select(F.col("id").alias(p), *(F.col(c).alias(f"{p}_{c}") for c in ["n", *SIGNATURE])), p)
        return pairs.filter(self._possible("a_", "b_")).select("a", "b").distinct()

    def _possible(self, left: str, right: str) -> Column:
        x, y = F.col(left + "n"), F.col(right + "n")
        return (100 * F.least(x, y) >= self.percent * F.greatest(x, y)) & (estimate(left, right) >= self.percent / 100 - SLACK)

    def sets(self, ids: DataFrame) -> DataFrame:
        """Full sets of the given documents."""
        wanted = ids.select(F.col("id").alias("__id")).distinct()
        return cut_lineage(self.docs.join(wanted, "__id", "left_semi").select("__id", "__text").mapInArrow(_sets, "id bigint, set binary"))

    def confirm(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Pairs confirmed on full sets; the rows of a frequent hub are split by the adaptive skew join."""
        both = (pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
                .join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b"))
        return cut_lineage(both.mapInArrow(_confirm(self.percent, 100), "a bigint, b bigint").distinct())

    def links(self) -> DataFrame:
        """Confirmed links between class representatives that span every component."""
        keyed = self.nodes.select("id", "n", F.explode("bands").alias("key"))
        shared = cut_lineage(keyed.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("top"))
                             .filter(F.col("hub") < F.col("top")).select("key", "hub"))
        buckets = cut_lineage(keyed.join(shared, "key"))
        spokes = buckets.filter(F.col("id") != F.col("hub")).select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
        sets = self.sets(buckets.select("id"))        # one reading of the texts for both comparisons
        links = self.confirm(self.likely(spokes), sets)
        members = buckets.join(components(links), "id", "left").select("key", "id", "n", F.coalesce("comp", "id").alias("comp"))
        members = cut_lineage(members)
        blocks = lambda k, n: F.ceil(F.greatest(k / BLOCK, n / BLOCK_SHINGLES))
        sizes = (members.groupBy("key", "comp").agg(F.count("*").alias("k"), F.sum("n").alias("n")).groupBy("key")
                 .agg(F.max_by(F.struct("comp", "k", "n"), F.struct("k", "comp")).alias("m"), F.sum("k").alias("k"), F.sum("n").alias("n"))
                 .filter(F.col("k") > F.col("m.k"))
                 .select("key", F.col("m.comp").alias("main"), blocks(F.col("k"), F.col("n")).alias("n_y"),
                         blocks(F.col("k") - F.col("m.k"), F.col("n") - F.col("m.n")).alias("n_x")))
        dealt = cut_lineage(members.join(cut_lineage(sizes), "key"))
        row = F.xxhash64("id")
        x = (dealt.filter(F.col("comp") != F.col("main")).withColumn("bx", F.pmod(row, F.col("n_x")))
             .withColumn("by", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_y") - 1))))
        y = (dealt.withColumn("by", F.pmod(row, F.col("n_y")))
             .withColumn("bx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_x") - 1))))
        cell = ["key", "bx", "by"]
        x, y = (t.join(sets, "id").select(*(F.col(c).alias(side + c) for c in [*cell, "id", "comp", "set"]))
                .groupBy(*(side + c for c in cell)) for side, t in (("x_", x), ("y_", y)))
        more = x.cogroup(y).applyInArrow(_between(self.percent), "a bigint, b bigint")
        return cut_lineage(links.unionByName(more).distinct())


def near_duplicates(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable over links) and kept (id = component_id)."""
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("__id"), F.col(text).alias("__text"))
    linker = Linker(base, percent)
    links = linker.links()
    comp = components(links)
    one = linker.classes.distinct().withColumnRenamed("id", "a").withColumnRenamed("rep", "b")
    # a repeated id belongs to several classes: its classes are linked through it
    several = one.groupBy("a").agg(F.count("*").alias("k"), F.min("b").alias("m")).filter("k > 1").select("a", "m")
    if not several.isEmpty():
        extra = one.join(several, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        comp = components(links.unionByName(extra))
    found = (one.join(comp.withColumnRenamed("id", "b"), "b", "left").groupBy("a").agg(F.min(F.coalesce("comp", "b")).alias("comp"))
             .withColumnRenamed("a", "id"))
    out = linker.prints.select("id", "n").join(cut_lineage(found), "id", "left")
    own = F.when(F.col("id") != NO_ID, F.coalesce("comp", "id"))
    return out.select(F.nullif(F.col("id"), F.lit(NO_ID)).alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"),
                      F.coalesce(own == F.col("id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``docs`` with one document of each group, columns unchanged; rows with a null id stay."""
    gone = cut_lineage(near_duplicates(docs, percent).filter(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct())
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")

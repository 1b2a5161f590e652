"""Conversation structure repair by a square-root checkpointed dynamic program.

``damaged`` applies the fixed damage of the query's contract.  ``repair`` takes each conversation's rows by turn (nulls first;
rows of one turn by role, then by the MD5 of the text), names each row's first fault and finds the cheapest edits after which
the role initials read ``(s?(ua)+)?``.  Four states remember what was put out last; the cost to finish from row i on is a
vector of four costs that follows from the one of row i + 1.

* Rows get a global position by one range sort of narrow rows (no text).  A conversation of n rows is cut into blocks of about
  sqrt(n) rows, so a conversation with a third of all rows is many tasks: each block gives a 4 x 4 cost matrix, and only the
  vectors at block borders, the checkpoints, are stored.  Blocks are then recomputed while walking forward from each of the
  four states they could be entered in, taking the ASCII-least tight edit, and the entered states are chained.
* A task or group holds sqrt(n) rows or blocks.  The digest of a repaired conversation is sequential by nature: its texts are
  sorted by conversation and place (spilling) and streamed through one hash, a batch at a time.

Null roles and texts count as one space, a null conversation id is a conversation of its own, rows with equal turn, role and
text are interchangeable, very long texts are only hashed.  A role counts by its first character, as it is.  Conversations
without rows after damage give zeros; empty tables an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwright.llm.batches import NO_ID
from gapwright.session import cut_lineage

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SPACE = " \t\n\x0b\x0c\r"
# states: 0 nothing put out, 1 after the system's turn, 2 after the user's, 3 after the assistant's
NEXT = (2, 2, 3, 2)                                    # state after the one role that may be inserted
ROLE = {2: "user", 3: "assistant"}
END = (0, 6, 3, 0)                                     # cost to finish behind the last row
FAR = 1 << 60
INITIALS = "sua"                                       # code of a row: 4 * initial (3 for others) + fault
PLAIN, CUT, BLANK, TWICE = range(4)


def damaged(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text) after dropping, emptying, cutting, repeating or re-roling by the hash of ``conv_id:turn``."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    base = rows.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("conv"), F.col("turn").cast("long").alias("turn"),
                       kind.alias("kind"), text("role").alias("role"), text("text").alias("text")).filter("kind <> 0")
    return base.select("conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                       F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
                       F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def _after(code: int, state: int) -> int:
    """State after a kept row; -1 where it may not be kept."""
    initial = code >> 2
    if initial == 0:
        return 1 if state == 0 else -1
    if initial == 1:
        return 2 if state != 2 else -1
    return 3 if initial == 2 and state == 2 else -1


def _step(code: int, ahead: list[int]) -> list[int]:
    """Costs to finish before a row from those behind it."""
    fault = code & 3
    out = []
    for q in range(4):
        best = DELETE + ahead[q]
        if fault < BLANK:
            extra = TRUNCATED if fault == CUT else 0
            k = _after(code, q)
            if k >= 0:
                best = min(best, extra + ahead[k])
            best = min(best, REROLE + extra + ahead[NEXT[q]])
        out.append(best)
    u, a = min(out[2], INSERT + out[3]), min(out[3], INSERT + out[2])
    return [min(out[0], INSERT + u), min(out[1], INSERT + u), u, a]


def _matrix(codes: bytes) -> list[int]:
    """Cost from each state before the block (column) to each state behind it (row)."""
    out = []
    for r in range(4):
        costs = [0 if q == r else FAR for q in range(4)]
        for c in reversed(codes):
            costs = _step(c, costs)
        out.extend(costs)
    return out


def _walk(codes: bytes, behind: list[int]) -> list[tuple[int, str]]:
    """For each state of entry: the state behind the block and the ASCII-least tight edits."""
    vectors = [behind]
    for c in reversed(codes):
        vectors.append(_step(c, vectors[-1]))
    vectors.reverse()
    out = []
    for q in range(4):
        edits = []
        for i, c in enumerate(codes):
            now, ahead = vectors[i], vectors[i + 1]
            fault = c & 3
            extra = TRUNCATED if fault == CUT else 0
            while True:
                if now[q] == DELETE + ahead[q]:
                    edits.append("D")
                    break
                if now[q] == INSERT + now[NEXT[q]]:
                    edits.append("I")
                    q = NEXT[q]
                    continue
                k = _after(c, q)
                if k >= 0 and now[q] == extra + ahead[k]:
                    edits.append("K")
                    q = k
                else:
                    edits.append("R")
                    q = NEXT[q]
                break
        out.append((q, "".join(edits)))
    return out


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in filter(len, batches):
        rows = []
        for conv, blk, items in zip(*(batch.column(c).to_pylist() for c in ("conv", "blk", "rows"))):
            codes = bytes(x["code"] for x in items)
            faults = [c & 3 for c in codes]
            initials = "".join((INITIALS + "x")[c >> 2] for c in codes)
            illegal = sum(initials[k:k + 2] not in ("su", "ua", "au") for k in range(len(initials) - 1))
            rows.append((conv, blk, codes, _matrix(codes), faults.count(BLANK), faults.count(TWICE), faults.count(CUT), illegal, initials[0], initials[-1]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), *[pa.int64()] * 4, pa.string(), pa.string()))],
            ["conv", "blk", "codes", "matrix", "blank", "duplicate", "truncated", "illegal", "head", "tail"])


def _checkpoints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cost vectors behind every block, backwards from the end; total cost and breaks between blocks per conversation."""
    for batch in filter(len, batches):
        rows = []
        for conv, blocks in zip(batch.column("conv").to_pylist(), batch.column("blocks").to_pylist()):
            costs, behind = list(END), []
            for b in reversed(blocks):
                behind.append({"blk": b["blk"], "behind": costs})
                m = b["matrix"]
                costs = [min(m[4 * r + q] + costs[r] for r in range(4)) for q in range(4)]
            breaks = sum(x["tail"] + y["head"] not in ("su", "ua", "au") for x, y in zip(blocks, blocks[1:]))
            rows.append((conv, costs[0], breaks, behind))
        kind = pa.list_(pa.struct([("blk", pa.int64()), ("behind", pa.list_(pa.int64()))]))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), kind))],
                                         ["conv", "cost", "breaks", "at"])


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in filter(len, batches):
        walks = [_walk(c, b) for c, b in zip(batch.column("codes").to_pylist(), batch.column("behind").to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv"), batch.column("blk"), pa.array([[q for q, _ in w] for w in walks], pa.list_(pa.int32())),
             pa.array([[e for _, e in w] for w in walks], pa.list_(pa.string()))], ["conv", "blk", "exits", "edits"])


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state every block is really entered in, its edits, and the edits of the whole conversation."""
    for batch in filter(len, batches):
        rows = []
        for conv, blocks in zip(batch.column("conv").to_pylist(), batch.column("blocks").to_pylist()):
            q, taken = 0, []
            for b in blocks:
                taken.append({"blk": b["blk"], "entry": q, "edits": b["edits"][q]})
                q = b["exits"][q]
            end = "I" * (END[q] // INSERT)
            rows.append((conv, "".join(t["edits"] for t in taken) + end, [ROLE[s] for s in ((2, 3) if q == 1 else (3,))] if end else [], taken))
        kind = pa.list_(pa.struct([("blk", pa.int64()), ("entry", pa.int32()), ("edits", pa.string())]))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.list_(pa.string()), kind))],
                                         ["conv", "audit", "closing", "taken"])


def _row_edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pos, roles inserted before the row, role of the row if re-roled, whether it stays) of rows that put out something."""
    for batch in filter(len, batches):
        rows = []
        for items, q, edits in zip(*(batch.column(c).to_pylist() for c in ("rows", "entry", "edits"))):
            i, before = 0, []
            for e in edits:
                if e == "I":
                    q = NEXT[q]
                    before.append(ROLE[q])
                    continue
                item = items[i]
                i += 1
                if e == "K":
                    q = _after(item["code"], q)
                elif e == "R":
                    q = NEXT[q]
                if e != "D" or before:
                    rows.append((item["pos"], before, ROLE[q] if e == "R" else None, e != "D"))
                before = []
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 4, (pa.int64(), pa.list_(pa.string()), pa.string(), pa.bool_()))],
                                         ["pos", "before", "new_role", "stays"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines, streamed: edits of a (turn, role, text) come before the texts themselves."""
    conv, sha, first, waiting, key = None, None, True, [], None
    done: list[tuple[int, str]] = []

    def put(line: str) -> None:
        nonlocal first
        sha.update((line if first else "\n" + line).encode())
        first = False

    for batch in batches:
        for c, last, turn, role, h, pos, before, new_role, stays, text in zip(
                *(batch.column(x).to_pylist() for x in ("conv", "last", "turn", "role", "h", "pos", "before", "new_role", "stays", "text"))):
            if c != conv:
                if sha:
                    done.append((conv, sha.hexdigest()))
                conv, sha, first, waiting, key = c, hashlib.sha256(), True, [], None
            if pos is not None:                       # an edit
                if (last, turn, role, h) != key:
                    key, waiting = (last, turn, role, h), []
                if any(s for _, _, s in waiting) or stays:
                    waiting.append((before, new_role, stays))
                else:
                    for r in before:
                        put(f"{r}:")
            elif waiting and (last, turn, role, h) == key:
                for roles, new, kept in waiting:
                    for r in roles:
                        put(f"{r}:")
                    if kept:
                        put(f"{new or role}:{text}")
                waiting = []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), (pa.int64(), pa.string()))], ["conv", "repaired_sha256"])
            done = []
    if sha:
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([sha.hexdigest()])], ["conv", "repaired_sha256"])


def _named(rows: DataFrame) -> DataFrame:
    return rows.withColumn("h", F.unhex(F.md5("text")))


def ordered_codes(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, h, pos, code) of all rows; ``pos`` grows along each conversation."""
    body = F.rtrim("text", F.lit(SPACE))
    fault = F.when(F.length(body) == 0, BLANK).when(~F.right(body, F.lit(1)).rlike("[.!?]"), CUT).otherwise(PLAIN)
    initial = F.coalesce(*(F.when(F.substring("role", 1, 1) == c, k) for k, c in enumerate(INITIALS)), F.lit(3))
    narrow = _named(rows).select("conv", "turn", "role", "h", fault.alias("fault"), initial.alias("initial"), F.monotonically_increasing_id().alias("deal"))
    by = ["conv", "turn", "role", "h", "deal"]         # equal rows are spread by the last key
    placed = cut_lineage(narrow.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("pos", F.monotonically_increasing_id()).drop("deal"))
    same = placed.groupBy("conv", "role", "h").agg(F.min("pos").alias("first"), F.count("*").alias("k")).filter("k > 1").drop("k")
    again = (F.col("fault") != BLANK) & (F.col("pos") > F.col("first"))
    fault = F.when(F.coalesce(again, F.lit(False)), TWICE).otherwise(F.col("fault"))
    return placed.join(same, ["conv", "role", "h"], "left").select("conv", "turn", "role", "h", "pos", (4 * F.col("initial") + fault).cast("int").alias("code"))


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, edits): one row per conversation; one row per row that stays or has something inserted before it.

    ``rows`` holds conv (no nulls), turn, role, text.  ``edits`` has conv, turn, role, h (MD5 of the text), pos, the inserted
    roles ``before``, ``new_role`` and ``stays``; closing inserts have ``last`` = 1.
    """
    coded = cut_lineage(ordered_codes(rows))
    gaps = coded.groupBy("conv").agg(F.count("*").alias("n"), F.coalesce(F.max("turn") - F.min("turn") + 1, F.lit(0)).alias("span"))
    turns = coded.filter("turn IS NOT NULL").groupBy("conv", "turn").agg(F.lit(1)).groupBy("conv").agg(F.count("*").alias("turns"))
    gaps = gaps.join(turns, "conv", "left").select("conv", "n", (F.col("span") - F.coalesce("turns", F.lit(0))).alias("gaps"))
    sizes = gaps.select("conv", F.ceil(F.log2(F.greatest(F.sqrt("n"), F.lit(16.0)))).cast("int").alias("bits"))
    blocks = coded.join(sizes, "conv").groupBy("conv", F.expr("shiftright(pos, bits)").alias("blk")).agg(F.sort_array(F.collect_list(F.struct("pos", "code"))).alias("rows"))
    blocks = cut_lineage(blocks)
    sums = cut_lineage(blocks.mapInArrow(_summaries, "conv bigint, blk bigint, codes binary, matrix array<bigint>, blank bigint, duplicate bigint, "
                                                     "truncated bigint, illegal bigint, head string, tail string"))
    counts = ["blank", "duplicate", "truncated", "illegal"]
    whole = sums.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("blk", "matrix", "head", "tail"))).alias("blocks"))
    back = cut_lineage(whole.mapInArrow(_checkpoints, "conv bigint, cost bigint, breaks bigint, at array<struct<blk:bigint,behind:array<bigint>>>"))
    at = back.select("conv", F.explode("at").alias("x")).select("conv", "x.blk", "x.behind")
    walks = sums.select("conv", "blk", "codes").join(at, ["conv", "blk"]).mapInArrow(_walks, "conv bigint, blk bigint, exits array<int>, edits array<string>")
    chain = walks.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("blk", "exits", "edits"))).alias("blocks"))
    chain = cut_lineage(chain.mapInArrow(_chained, "conv bigint, audit string, closing array<string>, taken array<struct<blk:bigint,entry:int,edits:string>>"))
    report = (sums.groupBy("conv").agg(*(F.sum(c).alias(c) for c in counts)).join(back.select("conv", "cost", "breaks"), "conv")
              .join(gaps.select("conv", "gaps"), "conv").join(chain.select("conv", "audit"), "conv")
              .select("conv", "gaps", "blank", "duplicate", "truncated", (F.col("illegal") + F.col("breaks")).alias("illegal"), "cost", "audit"))
    taken = chain.select("conv", F.explode("taken").alias("x")).select("conv", "x.*")
    edits = blocks.join(taken, ["conv", "blk"]).mapInArrow(_row_edits, "pos bigint, before array<string>, new_role string, stays boolean")
    edits = coded.select("conv", "turn", "role", "h", "pos").join(edits, "pos").withColumn("last", F.lit(0))
    closing = chain.filter(F.size("closing") > 0).select("conv", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(b"").alias("h"), F.lit(0).cast("long").alias("pos"),
                                                         F.col("closing").alias("before"), F.lit(None).cast("string").alias("new_role"), F.lit(False).alias("stays"), F.lit(1).alias("last"))
    return report, edits.unionByName(closing)


def digests(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv, repaired_sha256): the lines ``role:text`` that are left, in order, joined by line breaks."""
    texts = _named(rows).select("conv", F.lit(0).alias("last"), "turn", "role", "h", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("array<string>").alias("before"),
                                F.lit(None).cast("string").alias("new_role"), F.lit(None).cast("boolean").alias("stays"), "text")
    both = edits.withColumn("text", F.lit(None).cast("string")).unionByName(texts)
    order = ["conv", "last", F.asc_nulls_first("turn"), "role", "h", F.asc_nulls_last("pos")]
    return both.repartition("conv").sortWithinPartitions(*order).mapInArrow(_digests, "conv bigint, repaired_sha256 string")


def repaired(conversations: DataFrame) -> DataFrame:
    """Damage, faults, cheapest edits and digest of every conversation of the table (conv_id, turn, role, text)."""
    rows = damaged(conversations)
    report, edits = repair(rows)
    all_ids = conversations.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("conv")).distinct()
    out = all_ids.join(report, "conv", "left").join(digests(rows, edits), "conv", "left")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    empty: Column = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(F.nullif(F.col("conv"), F.lit(NO_ID)).alias("conv_id"), *(number(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                      F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))

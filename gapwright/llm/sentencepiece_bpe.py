"""SentencePiece encoding and decoding by suffix-array matching.

Per batch the distinct words of all texts are concatenated and their suffixes sorted by their first 8 letters (4 in batches
with over 255 kinds of letters).  Every piece of the vocabulary is then found by binary search as a range of that order;
longer pieces keep the places of their range where their other letters fit.  Occurrences are edges (start, end, piece).  Edges are sorted by start and relaxed from left to right: an edge is taken when its start was
reached and its piece can follow the piece that reached it, that is when the merges of the two pieces put side by side
would not have crossed their border earlier.  For a BPE vocabulary exactly one edge survives per reached position, and
following the survivors back from the end of a word gives the very ids that merging by score gives.

Words are cut before each space (no piece holds an inner space mark) and around characters in no piece, which fall back
to byte pieces.  Decoding joins pieces, turns byte pieces into bytes and drops the one leading space of the encoder.

Null and empty texts encode to no ids and decode to the empty text; ids outside the vocabulary and control pieces decode
to nothing.  Repeated rows give equal rows; null ids and other columns are carried; empty tables give empty results.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwright.llm.batches import coded, flat, pieces, ragged, texts_of

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
BATCH_BYTES = 3 << 20
SEEN_WORDS = 200_000
LETTERS = 1 << 18           # letters of distinct words matched at once
LONG = 256                  # letters from which a word is walked alone, over its own edges


class Vocabulary:
    """Pieces of a BPE model, their merge order and the split that forms each of them."""

    def __init__(self, model_file: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.size = n
        self.seen = Seen()
        raw = [sp.id_to_piece(i) for i in range(n)]
        self.byte_id = np.zeros(256, np.int64)
        normal = []
        for i, p in enumerate(raw):
            if sp.is_byte(i):
                self.byte_id[int(p[1:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                normal.append(i)
        self.runs = {len(raw[i]): i for i in normal if set(raw[i]) == {SPACE}}
        words = [i for i in normal if set(raw[i]) != {SPACE} or len(raw[i]) == 1]
        if any(SPACE in raw[i][1:] or " " in raw[i] or "\n" in raw[i] for i in words):
            raise ValueError("pieces with inner spaces are not supported")
        scores = [sp.get_score(i) for i in words if len(raw[i]) > 1]
        if len(set(scores)) < len(scores):
            raise ValueError("merge scores must differ")
        # outputs: what each id decodes to
        self.out = [b"" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else
                    bytes([int(p[1:-1], 16)]) if sp.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(raw)]
        # merge order: rank 0 merges first; single characters never result from a merge
        by_text = {raw[i]: i for i in words}
        order = sorted((i for i in words if len(raw[i]) > 1), key=lambda i: -sp.get_score(i))
        self.rank = np.full(n + 1, -1, np.int64)
        self.left = np.full(n + 1, -1, np.int64)
        self.right = np.full(n + 1, -1, np.int64)
        for k, i in enumerate(order):
            self.rank[i] = k
        usable = [i for i in words if len(raw[i]) == 1]
        for i in order:
            split = self._split(raw[i], by_text)
            if split:
                self.left[i], self.right[i] = split
                usable.append(i)
        pairs = [(int(self.left[i]) * (n + 1) + int(self.right[i]), int(self.rank[i])) for i in usable if self.left[i] >= 0]
        pairs.sort()
        self.pair_key = np.array([a for a, _ in pairs], np.int64)
        self.pair_rank = np.array([b for _, b in pairs], np.int64)
        self.pairs = dict(pairs)
        self.joins: dict[tuple[int, int], bool] = {}
        self.undone = [x.tolist() for x in (self.rank, self.left, self.right)]
        self.maybe = np.zeros(1 << 20, bool)                  # hashes of the pairs: most looked up are in none
        self.maybe[_slot(self.pair_key)] = True
        # match tables
        self.ids = np.array(usable, np.int64)
        text = [raw[i] for i in usable]
        self.length = np.array([len(t) for t in text], np.int64)
        self.depth = int(self.length.max())
        points = np.frombuffer("".join(text).encode("utf-32-le"), np.uint32)
        self.alphabet = np.unique(points)
        at = np.concatenate([[0], np.cumsum(self.length)])
        self.spelled = np.zeros((len(usable), self.depth), np.uint16)     # alphabet codes from 1, then 0
        code = (np.searchsorted(self.alphabet, points) + 1).astype(np.uint16)
        for k in range(self.depth):
            has = self.length > k
            self.spelled[has, k] = code[at[:-1][has] + k]

    def _split(self, text: str, by_text: dict[str, int]) -> tuple[int, int] | None:
        """The two pieces whose merge is the last when ``text`` is merged alone; None if it ends as several pieces."""
        parts = [by_text.get(c) for c in text]
        if None in parts:
            return None
        names = list(text)
        while len(names) > 2:
            best = min(((self.rank[by_text[a + b]], k) for k, (a, b) in enumerate(zip(names, names[1:])) if a + b in by_text), default=None)
            if best is None:
                return None
            k = best[1]
            names[k:k + 2] = [names[k] + names[k + 1]]
        if len(names) == 2 and "".join(names) in by_text:
            return by_text[names[0]], by_text[names[1]]
        return None

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether piece b may stand after piece a: undo merges of either side, latest first, and look for a border merge
        that would have come before the merge undone last."""
        a, b = a.copy(), b.copy()
        ok = np.ones(len(a), bool)
        limit = np.full(len(a), np.iinfo(np.int64).max)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = x * (self.size + 1) + y
            some = np.flatnonzero(self.maybe[_slot(key)])
            at = np.minimum(np.searchsorted(self.pair_key, key[some]), len(self.pair_key) - 1)
            bad = np.zeros(len(live), bool)
            bad[some] = (self.pair_key[at] == key[some]) & (self.pair_rank[at] < limit[live[some]])
            ok[live[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~bad & ((rx >= 0) | (ry >= 0))
            live, x, y, rx, ry = live[go], x[go], y[go], rx[go], ry[go]
            undo_left = rx > ry
            # at equal rank a left merge was done first, so the right one is undone first
            limit[live] = np.where(undo_left, rx, ry + 1)
            a[live] = np.where(undo_left, self.right[x], x)
            b[live] = np.where(undo_left, y, self.left[y])
        return ok


    def follows_one(self, a: int, b: int) -> bool:
        """``follows`` for one pair, remembered."""
        known = self.joins.get((a, b))
        if known is not None:
            return known
        if len(self.joins) > SEEN_WORDS:
            self.joins.clear()
        rank, left, right = self.undone
        x, y, limit = a, b, len(rank) + 1
        while True:
            if self.pairs.get(x * (self.size + 1) + y, limit) < limit:
                break
            rx, ry = rank[x], rank[y]
            if rx < 0 and ry < 0:
                break
            if rx > ry:
                limit, x = rx, right[x]
            else:
                limit, y = ry + 1, left[y]
        fits = self.joins[a, b] = self.pairs.get(x * (self.size + 1) + y, limit) >= limit
        return fits


def _slot(keys: np.ndarray) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)


def _packed(codes: np.ndarray) -> list[np.ndarray]:
    """Rows of 8- or 16-bit codes as 64-bit keys that compare like the rows."""
    per = 8 // codes.dtype.itemsize
    if codes.shape[1] % per:
        codes = np.pad(codes, ((0, 0), (0, -codes.shape[1] % per)))
    keys = np.ascontiguousarray(codes.astype(codes.dtype.newbyteorder(">"))).view(">u8").astype(np.uint64)
    return [np.ascontiguousarray(keys[:, k]) for k in range(keys.shape[1])]


@functools.lru_cache(maxsize=2)
def vocabulary(model_file: str) -> Vocabulary:
    """One vocabulary per Python worker."""
    return Vocabulary(model_file)


def encode_words(v: Vocabulary, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of the distinct words, matched in runs of at most ``LETTERS`` letters (one longer word alone)."""
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts, total = [0], 0
    for k, n in enumerate(size.tolist()):
        if total and total + n > LETTERS:
            cuts.append(k)
            total = 0
        total += n
    parts = [_encode_run(v, words.slice(a, b - a)) for a, b in zip(cuts, [*cuts[1:], len(words)])]
    ends = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(offs) for _, offs in parts]))])
    return np.concatenate([ids for ids, _ in parts]), ends


def _encode_run(v: Vocabulary, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of the distinct words; a word starts with its space mark where it has one."""
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(lengths)])
    points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), at
    code = np.minimum(np.searchsorted(v.alphabet, points), len(v.alphabet) - 1)
    code = np.where(v.alphabet[code] == points, code + 1, 0)
    # codes of the letters in this batch only, as narrow as they allow; pieces with other letters cannot occur
    used = np.unique(code[code > 0])
    narrow = np.zeros(len(v.alphabet) + 1, np.uint8 if len(used) < 256 else np.uint16)
    narrow[used] = np.arange(1, len(used) + 1)
    code = narrow[code]
    spelled = narrow[v.spelled]
    able = np.flatnonzero(((spelled > 0) == (v.spelled > 0)).all(axis=1))
    spelled, size = spelled[able], v.length[able]
    # suffix order by the letters of one 64-bit key, not across words; later keys tell longer pieces apart
    left = np.minimum(np.repeat(at[1:], lengths) - np.arange(n), v.depth).astype(np.uint8)
    window = np.lib.stride_tricks.sliding_window_view(np.concatenate([code, np.zeros(v.depth, code.dtype)]), v.depth)[:n]
    keys = _packed(np.where(np.arange(v.depth, dtype=np.uint8) < left[:, None], window, code.dtype.type(0)))
    suffix = np.argsort(keys[0])
    order = keys[0][suffix]
    shown = np.where(np.arange(v.depth) < size[:, None], np.iinfo(code.dtype).max, 0).astype(code.dtype)
    masks = _packed(shown)
    wanted = _packed(spelled)
    lo = np.searchsorted(order, wanted[0], "left")
    hi = np.searchsorted(order, wanted[0] | ~masks[0], "right")
    found = np.flatnonzero(hi > lo)
    count = (hi - lo)[found]
    start = suffix[ragged(lo[found], count)]
    which = np.repeat(found, count)
    for key, want, mask in list(zip(keys, wanted, masks))[1:]:   # longer pieces: the rest of their letters
        same = (mask[which] == 0) | ((key[start] & mask[which]) == want[which])
        start, which = start[same], which[same]
    del keys, order
    piece, length = v.ids[able[which]], size[which]
    plain = np.zeros(n, bool)
    plain[start[length == 1]] = True
    single = np.flatnonzero(~plain)                           # characters in no piece: byte fallback
    start = np.concatenate([start, single])
    piece = np.concatenate([piece, np.full(len(single), v.size)])
    length = np.concatenate([length, np.ones(len(single), np.int64)])
    # relax by place in the word: all words advance together, long ones alone
    word = np.repeat(np.arange(len(lengths)), lengths)
    last = np.full(n + len(lengths), -1, np.int64)           # piece that ends before this point; one more point per word
    came = np.zeros(n + len(lengths), np.int64)
    alone = (lengths > LONG)[word[start]]
    if alone.any():
        far = np.flatnonzero(alone)
        far = far[np.argsort(start[far], kind="stable")]
        owner = word[start[far]]
        for s in np.split(np.arange(len(far)), np.flatnonzero(np.diff(owner)) + 1):
            first = int(at[owner[s[0]]])
            ends, from_, by = _walk(v, int(lengths[owner[s[0]]]), (start[far[s]] - first).tolist(), piece[far[s]].tolist(), length[far[s]].tolist())
            point = np.array(ends) + first + owner[s[0]]
            last[point], came[point] = by, np.array(from_) + first + owner[s[0]]
        start, piece, length = start[~alone], piece[~alone], length[~alone]
    spot = start - at[word[start]]
    by = np.argsort(spot.astype(np.uint16), kind="stable")
    start, piece, length = start[by], piece[by], length[by]
    step = np.concatenate([[0], np.cumsum(np.bincount(spot))])
    base = start + word[start]
    for k in range(len(step) - 1):
        s = slice(step[k], step[k + 1])
        b, p, e = base[s], piece[s], base[s] + length[s]
        if k:
            reach = np.flatnonzero(last[b] >= 0)
            b, p, e = b[reach], p[reach], e[reach]
            fits = v.follows(last[b], p)
            b, p, e = b[fits], p[fits], e[fits]
        last[e] = p
        came[e] = b
    # walk back from the ends of all words
    point = at[1:] + np.arange(len(lengths))
    first = at[:-1] + np.arange(len(lengths))
    live = np.flatnonzero(lengths > 0)
    point = point[live]
    taken = []
    while len(live):
        taken.append(point)
        point = came[point]
        more = point > first[live]
        live, point = live[more], point[more]
    ends = np.sort(np.concatenate(taken))
    ids = last[ends]
    owner = np.searchsorted(first, ends, "right") - 1
    # byte fallback
    width = np.ones(len(ids), np.int64)
    lost = np.flatnonzero(ids == v.size)
    if len(lost):
        raw = [chr(c).encode("utf-8", "surrogatepass") for c in points[(came[ends[lost]] - owner[lost])].tolist()]
        width[lost] = [len(x) for x in raw]
        out = np.repeat(ids, width)
        spot = np.concatenate([[0], np.cumsum(width)])[lost]
        out[ragged(spot, width[lost])] = v.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        ids = out
    per = np.bincount(owner, weights=width, minlength=len(lengths)).astype(np.int64)
    return ids, np.concatenate([[0], np.cumsum(per)])


def _walk(v: Vocabulary, n: int, start: list[int], piece: list[int], length: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(reached points, where their edge began, its piece) of one word, over its edges in order of their start."""
    last, came = [-1] * (n + 1), [0] * (n + 1)
    for s, p, k in zip(start, piece, length):
        if not s or (last[s] >= 0 and v.follows_one(last[s], p)):
            last[s + k], came[s + k] = p, s
    ends = [e for e in range(1, n + 1) if last[e] >= 0]
    return ends, [came[e] for e in ends], [last[e] for e in ends]


def space_run(v: Vocabulary, k: int) -> list[int]:
    """Ids of k space marks in a row: equal scores merge from the left for as long as any neighbours fit."""
    parts: list[int] = []
    while k or (len(parts) > 1 and parts[-2] + parts[-1] in v.runs):
        if len(parts) > 1 and parts[-2] + parts[-1] in v.runs:
            parts[-2:] = [parts[-2] + parts[-1]]
        elif parts and parts[-1] + 1 in v.runs:
            parts[-1] += 1
            k -= 1
        else:
            step = 2 if k > 1 and 2 in v.runs else 1
            parts.append(step)
            k -= step
    return [v.runs[p] for p in parts]


class Seen:
    """Words that this Python worker has encoded lately, at most ``SEEN_WORDS`` of them beside those of one batch."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.offs = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, v: Vocabulary, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the distinct words, each behind a space mark."""
        if len(self.place) > SEEN_WORDS:
            self.__init__()
        new = [w for w in words if w not in self.place]
        if new:
            ids, offs = encode_words(v, pa.array([SPACE + w for w in new], pa.large_string()))
            start = len(self.place)
            self.place.update((w, start + k) for k, w in enumerate(new))
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
            self.offs = np.concatenate([self.offs, self.offs[-1] + offs[1:]])
        at = np.fromiter((self.place[w] for w in words), np.int64, len(words))
        n = self.offs[at + 1] - self.offs[at]
        return self.ids[ragged(self.offs[at], n)].astype(np.int64), np.concatenate([[0], np.cumsum(n)])


def _merge_runs(v: Vocabulary, codes: np.ndarray, at: np.ndarray, empty: int, ids: np.ndarray,
                offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Give every run of empty words (spaces in a row) one code of its own; the mark of the next word joins the run where
    that word keeps it apart."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    gap = codes == empty
    head = gap & ~np.r_[False, gap[:-1] & (row[1:] == row[:-1])]
    begin = np.flatnonzero(head)
    stop = np.flatnonzero(gap & ~np.r_[gap[1:] & (row[1:] == row[:-1]), False])
    codes, extra, known = codes.copy(), [], {}
    mark = v.runs[1]
    drop = gap & ~head

    def code(key, make) -> int:
        if key not in known:
            known[key] = len(offs) - 1 + len(extra)
            extra.append(make())
        return known[key]

    for a, b in zip(begin.tolist(), stop.tolist()):
        k, after = b - a + 1, b + 1
        if after < len(codes) and row[after] == row[a]:
            w = int(codes[after])
            own = ids[offs[w]:offs[w + 1]]
            if len(own) and own[0] == mark:
                k += 1
                codes[after] = code(("rest", w), lambda o=own: o[1:])
        codes[a] = code(("run", k), lambda n=k: np.array(space_run(v, n), np.int64))
    ids = np.concatenate([ids, *extra])
    offs = np.concatenate([offs, offs[-1] + np.cumsum([len(x) for x in extra])]).astype(np.int64)
    keep = ~drop
    return codes[keep], np.concatenate([[0], np.cumsum(keep)])[at], ids, offs


def encode_texts(v: Vocabulary, texts: pa.Array) -> pa.ListArray:
    """Ids of every text."""
    # the encoder takes its own space mark for a space
    words, at = flat(pc.split_pattern(pc.replace_substring(texts, SPACE, " "), " "))
    distinct, codes = coded(words)
    codes = codes.astype(np.int64)
    ids, offs = v.seen.encode(v, distinct.to_pylist())
    blank = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    if blank.any():                                   # an empty text has no words at all
        keep = ~np.repeat(blank, np.diff(at))
        codes, at = codes[keep], np.concatenate([[0], np.cumsum(keep)])[at]
    empty = pc.index(distinct, pa.scalar("", distinct.type)).as_py()
    if empty >= 0 and len(codes):
        codes, at, ids, offs = _merge_runs(v, codes, at, empty, ids, offs)
    n = np.diff(offs)[codes]
    out = ids.astype(np.int32)[ragged(offs[:-1][codes], n)]
    ends = np.concatenate([[0], np.cumsum(n)])[at].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(out, pa.int32()))


def decode_ids(v: Vocabulary, lists: pa.Array) -> list[str]:
    """Texts of lists of ids; a null list gives the empty text."""
    out = pa.array([*v.out, b""], pa.large_binary())
    values, at = flat(lists)
    values = pc.fill_null(values, v.size).to_numpy(zero_copy_only=False).astype(np.int64)
    values = np.where((values < 0) | (values > v.size), v.size, values)
    parts = pa.LargeListArray.from_arrays(pa.array(at), out.take(pa.array(values)))
    joined = pc.binary_join(parts, pa.scalar(b"", pa.large_binary())).to_pylist()
    return [(x[1:] if x[:1] == b" " else x).decode("utf-8", "replace") for x in joined]


def _encode(model_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_file)
        with np.errstate(over="ignore"):
            for batch in pieces(batches, "__text", BATCH_BYTES):
                ids = encode_texts(v, texts_of(batch.column("__text")))
                yield pa.RecordBatch.from_arrays([batch.column("__row"), ids], ["__row", "ids"])
    return run


def _round_trip(model_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_file)
        with np.errstate(over="ignore"):
            for batch in pieces(batches, "__text", BATCH_BYTES):
                texts = texts_of(batch.column("__text"))
                ids = encode_texts(v, texts)
                back = pa.array(decode_ids(v, ids), pa.large_string())
                yield pa.RecordBatch.from_arrays([batch.column("__row"), ids, pc.equal(back, texts)], ["__row", "ids", "exact"])
    return run


def _decode(model_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_file)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("__row"), pa.array(decode_ids(v, batch.column("__ids")), pa.string())],
                                             ["__row", "decoded"])
    return run


def _row(df: DataFrame):
    return F.struct(*(F.col(f"`{c}`") for c in df.columns))


def _kind(df: DataFrame) -> str:
    return df.select(_row(df).alias("r")).schema["r"].dataType.simpleString()


def encode(docs: DataFrame, text: str = "text", model_file: str = DEFAULT_MODEL) -> DataFrame:
    """Rows of ``docs`` as the struct ``__row`` with the array ``ids``."""
    return docs.select(_row(docs).alias("__row"), F.col(text).alias("__text")).mapInArrow(
        _encode(model_file), f"__row {_kind(docs)}, ids array<int>")


def decode(rows: DataFrame, ids: str = "ids", model_file: str = DEFAULT_MODEL) -> DataFrame:
    """``rows`` as the struct ``__row`` with the text ``decoded``."""
    return rows.select(_row(rows).alias("__row"), F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("__ids")).mapInArrow(
        _decode(model_file), f"__row {_kind(rows)}, decoded string")


def encode_checked(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), text: str = "text", model_file: str = DEFAULT_MODEL) -> DataFrame:
    """Per row: the carried columns, n_tokens, ids, and whether decoding them gives the text back (``decoded_equal``).

    It does for every text without the encoder's own space mark, which decodes to a space.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("__row"), F.col(text).alias("__text"))
    out = rows.mapInArrow(_round_trip(model_file), f"__row {rows.schema['__row'].dataType.simpleString()}, ids array<int>, exact boolean")
    return out.select(*(F.col(f"__row.`{c}`").alias(c) for c in carry), F.size("ids").cast("long").alias("n_tokens"), "ids",
                      F.col("exact").alias("decoded_equal"))

"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, everything else its lower-cased core without outer punctuation.  Hashes
of 8-token template windows of the benchmark are looked up for every window of every document (shorter items: one window
of their length).  A hit aligns item and document; each aligned item is then compared token by token, and the values that
stand in placeholders must map consistently (an item's value always becomes the same value), which catches questions
with new numbers or names and passes over chance templates.

Template windows with fewer than half literals are not looked up, because "number number number" is everywhere.  Every
window of every item is looked up by its plain words (lower case, without outer punctuation) too, so a copy is found
whatever its words are: title case, lists of numbers or names, items of a few words.  An alignment that only plain words
gave counts equal words, not equal placeholders.

An item counts as leaked when at least half of its tokens are matched and at most a fifth of its slots break the mapping,
or when one stretch of ``STRETCH`` tokens (the whole item if that is shorter) is matched without a gap and without a break
of the mapping inside it, whatever share of the item that is.

The benchmark is read in blocks of at most ``BLOCK_TOKENS`` tokens.  One block's index is broadcast at a time, so memory
is bounded whatever the benchmark's size, and documents are never shuffled.  Null or wordless texts and items match
nothing; null ids are carried; repeated rows give a row each; extra columns are not read; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwright.llm.batches import pieces, ragged, texts_of, words_of
from gapwright.session import cut_lineage

WINDOW = 8
MIN_LITERAL = 0.5           # share of a window that must not be placeholders
BLOCK_TOKENS = 2_000_000    # tokens of benchmark text behind one broadcast
COVER, BREAKS = 0.5, 0.2
STRETCH = 50                # tokens in a row that are a leak by themselves

# Unit words, number words, given names.
UNITS = set("""mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers
kilometre kilometres mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l liter liters litre
litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years s min h hr hrs mph kmh
dollar dollars cent cents euro euros usd eur percent % $ € £ degree degrees celsius fahrenheit joule joules watt watts volt volts""".split())
NUMBERS = set("""zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen
eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half dozen""".split())
NAMES = set("""alice bob carol david emma frank grace henry john mary james anna peter susan tom maria robert linda michael sarah
william julia thomas laura daniel lisa paul kate mark lucy george jane sam ben amy jack lily""".split())

_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(%|st|nd|rd|th)?[a-zA-Zµ°²³]{0,3}$")
_OUTER = re.compile(r"^\W+|\W+$")
_STOP = (".", "!", "?", ":", ";", '."', '!"', '?"')
NUMBER, NAME, UNIT = "\x01number", "\x01name", "\x01unit"


def template(word: str, first: bool) -> str:
    """Template token of a word; ``first`` words of a sentence are capitalised anyway and no sign of a name."""
    if word.isalpha() and word.islower():
        low = word
    else:
        if _NUMBER.match(word.strip("()[]\"'!?;,.")) and any(c.isdigit() for c in word):
            return NUMBER
        core = _OUTER.sub("", word)
        low = (core or word).lower()
        if core[:1].isupper() and core[1:].islower() and not first and low not in NUMBERS and low not in UNITS:
            return NAME
    if low in NUMBERS:
        return NUMBER
    if low in UNITS:
        return UNIT
    return NAME if low in NAMES else low


def _h(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s)


SLOTS = np.array([_h(x) for x in (NUMBER, NAME, UNIT)], np.uint64)
_A = np.uint64(0x9E3779B97F4A7C15)


class Tokens:
    """Template hashes and words of a batch of texts."""

    def __init__(self, texts: pa.Array):
        distinct, codes, self.at = words_of(texts)
        self.words = distinct.to_pylist()
        self.codes = codes
        plain = (w if w.isalpha() and w.islower() else (_OUTER.sub("", w) or w).lower() for w in self.words)
        self.plain = np.fromiter((_h(x) for x in plain), np.uint64, len(self.words))[codes]
        within = [template(w, False) for w in self.words]
        start = np.fromiter((_h(template(w, True) if x == NAME else x) for w, x in zip(self.words, within)), np.uint64, len(within))
        inner = np.fromiter((_h(x) for x in within), np.uint64, len(within))
        ends = np.fromiter((w.endswith(_STOP) for w in self.words), bool, len(self.words))
        first = np.zeros(len(codes), bool)
        first[1:] = ends[codes[:-1]]
        first[self.at[:-1][self.at[:-1] < len(codes)]] = True
        self.t = np.where(first, start[codes], inner[codes]) if len(codes) else np.zeros(0, np.uint64)

    def windows(self, width: int, plain: bool = False) -> np.ndarray:
        """Hash of the template (or ``plain`` words) of the window that starts at each token; 0 where it leaves its text,
        and for a template with too few literals."""
        tokens = self.plain if plain else self.t
        n = len(tokens) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        h = np.zeros(n, np.uint64)
        for k in range(width):
            h = (h ^ (h >> np.uint64(31))) * _A + tokens[k:k + n]
        end = np.repeat(self.at[1:], np.diff(self.at))[:n]
        good = np.arange(n) + width <= end
        if not plain:
            literal = np.r_[0, np.cumsum(~np.isin(self.t, SLOTS))]
            good &= literal[width:] - literal[:-width] >= MIN_LITERAL * width
        return np.where(good, h | np.uint64(1), np.uint64(0))

    def slot_value(self, i: int) -> str:
        return _OUTER.sub("", self.words[self.codes[i]]).lower()


class Index:
    """Window hashes of a block of benchmark items."""

    def __init__(self, ids: list, texts: list[str | None]):
        self.ids = ids
        self.tokens = Tokens(texts_of(pa.array(texts, pa.string())))
        lengths = np.diff(self.tokens.at)
        self.item = np.repeat(np.arange(len(ids)), lengths)
        self.windows: dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]] = {}
        for width in sorted({min(WINDOW, int(x)) for x in lengths if x}):
            for plain in (False, True):
                h = self.tokens.windows(width, plain)
                use = (h != 0) & (np.minimum(lengths, WINDOW)[self.item[:len(h)]] == width)
                at = np.flatnonzero(use)
                order = np.argsort(h[at], kind="stable")
                if len(at):
                    self.windows[width, plain] = h[at][order], at[order]

    def hits(self, doc: Tokens) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
        """(plain, document tokens, index tokens) of all equal windows, kind by kind."""
        for (width, plain), (keys, at) in self.windows.items():
            h = doc.windows(width, plain)
            lo = np.searchsorted(keys, h, "left")
            cand = np.flatnonzero((keys[np.minimum(lo, len(keys) - 1)] == h) & (h != 0))
            many = np.searchsorted(keys, h[cand], "right") - lo[cand]
            yield plain, np.repeat(cand, many), at[ragged(lo[cand], many)]


def _longest(same: np.ndarray, slot: np.ndarray, old: np.ndarray, new: np.ndarray) -> int:
    """Length of the longest stretch of ``same`` tokens in which an old slot value always has one new value."""
    edge = np.flatnonzero(np.diff(np.r_[False, same, False]))
    best = 0
    for start, end in zip(edge[::2].tolist(), edge[1::2].tolist()):
        if end - start <= best:
            continue
        last: dict[int, tuple[int, int]] = {}
        for k in (start + np.flatnonzero(slot[start:end])).tolist():
            value, at = last.get(int(old[k]), (None, -1))
            if at >= start and value != int(new[k]):
                best = max(best, k - start)
                start = at + 1
            last[int(old[k])] = int(new[k]), k
        best = max(best, end - start)
    return best


def _leaks(index: Index, doc: Tokens) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(row, item, matched, longest stretch, slots, broken) of every aligned pair."""
    pairs: dict[tuple[int, int], tuple[set[int], set[int]]] = {}
    row_of = np.repeat(np.arange(len(doc.at) - 1), np.diff(doc.at))
    for plain, i, j in index.hits(doc):
        if len(i):
            for row, item, shift in np.unique(np.stack([row_of[i], index.item[j], i - j], axis=1), axis=0).tolist():
                pairs.setdefault((row, item), (set(), set()))[plain].add(shift)
    ref = index.tokens
    for (row, item), (shifts, copies) in sorted(pairs.items()):
        a, b = int(ref.at[item]), int(ref.at[item + 1])
        best, matched = np.zeros(b - a, bool), np.zeros(b - a, bool)
        slot, run = np.isin(ref.t[a:b], SLOTS), 0
        maps: dict[str, dict[str, int]] = {}
        for shift in sorted(shifts | copies):
            lo = max(a, int(doc.at[row]) - shift)
            hi = min(b, int(doc.at[row + 1]) - shift)
            own, other = slice(lo, hi), slice(lo + shift, hi + shift)
            copied = ref.plain[own] == doc.plain[other]
            alike = ref.t[own] == doc.t[other]
            matched[lo - a:hi - a] |= copied
            run = max(run, _longest(copied | alike if shift in shifts else copied, slot[lo - a:hi - a], ref.plain[own], doc.plain[other]))
            if shift not in shifts:
                continue
            same = np.zeros(b - a, bool)
            same[lo - a:hi - a] = alike
            new = same & ~best
            for k in np.flatnonzero(new & slot).tolist():
                seen = maps.setdefault(ref.slot_value(a + k), {})
                value = doc.slot_value(a + k + shift)
                seen[value] = seen.get(value, 0) + 1
            best |= same
        slots = sum(sum(v.values()) for v in maps.values())
        broken = slots - sum(max(v.values()) for v in maps.values())
        yield row, item, int((best | matched).sum()), run, slots, broken


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts = shared.value
        with np.errstate(over="ignore"):
            index = Index(ids, texts)
            lengths = np.diff(index.tokens.at)
            for batch in pieces(batches, "__text"):
                found = list(_leaks(index, Tokens(texts_of(batch.column("__text")))))
                rows, items, *numbers = (list(x) for x in zip(*found)) if found else [[] for _ in range(6)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("__id").take(pa.array(rows, pa.int64())), pa.array([ids[i] for i in items], pa.int64()),
                     pa.array([lengths[i] for i in items], pa.int64()), *(pa.array(x, pa.int64()) for x in numbers)],
                    ["doc_id", "item_id", "n_tokens", "n_matched", "n_stretch", "n_slots", "n_broken"])
    return run


def blocks(benchmark: DataFrame) -> Iterator[tuple[list, list]]:
    """Benchmark rows in blocks of bounded size."""
    ids, texts, size = [], [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        n = len((r[1] or "").split())
        if ids and size + n > BLOCK_TOKENS:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r[0])
        texts.append(r[1])
        size += n
    yield ids, texts


def aligned(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per aligned document and item with its evidence and verdict ``contaminated``."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text).alias("__text"))
    schema = "doc_id bigint, item_id bigint, n_tokens bigint, n_matched bigint, n_stretch bigint, n_slots bigint, n_broken bigint"
    out = None
    for block in blocks(benchmark):
        part = base.mapInArrow(_search(spark.sparkContext.broadcast(block)), schema)
        out = part if out is None else cut_lineage(out).unionByName(part)
    verdict = (F.col("n_matched") >= COVER * F.col("n_tokens")) & (F.col("n_broken") <= BREAKS * F.col("n_slots"))
    stretch = (F.col("n_tokens") > 0) & (F.col("n_stretch") >= F.least(F.lit(STRETCH), F.col("n_tokens")))
    return out.withColumn("contaminated", verdict | stretch)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item that it contains."""
    return aligned(docs, benchmark).filter("contaminated")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that contain a benchmark item; rows with a null id stay only if clean.

    The verdict is joined back by id, so rows that repeat an id share it; null ids compare equal to each other.
    """
    bad = cut_lineage(leaks(docs, benchmark).select(F.col("doc_id").alias("__bad")).distinct())
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["__bad"]), "left_anti")

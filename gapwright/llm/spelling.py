"""Spelling variants by finite-state composition.

Words are maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z lower-cased; one occurrence in 199 loses a letter first
(``damaged``), as the contract of the query states.  The vocabulary holds the distinct words of at least ``MIN_CHARS`` code
points and ``MIN_COUNT`` occurrences.  Two words are near when exactly one code point is inserted, deleted or replaced.

Near pairs are the paths of V o E o V, where V is the minimised acceptor of the vocabulary and E a transducer of one edit.  The
composition is cut by initial state: of two near words the shorter has m letters, and they share their first m // 2 letters or
their last m - m // 2.  Hence each word is dealt to the state behind its first half, and in the reversed vocabulary to that
behind its last half, for m its length and its length less one.  A task builds the acceptor behind each of its states
(sorted words, equal right languages merged as they close) and walks the composition with an explicit stack, so that long
words need no recursion.  Every pair is found in one place and at its last possible edit; each word's count and best partner
are aggregated there.  A state with over ``LIMIT`` words is cut into blocks, and each pair of blocks is composed by itself.

Null and empty texts have no words; null ids count as the empty string in the hash; repeated rows count again; ties of the
largest count go to the smallest word; empty tables give an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwright.session import cut_lineage

MIN_CHARS, MIN_COUNT, RATIO, DAMAGE = 6, 5, 5, 199
LIMIT = 20_000              # words behind one initial state that one task composes
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def damaged(doc_id: Column, run: Column, every: int = DAMAGE) -> Column:
    """The run, without one code point where ``every`` divides the hash of id and run."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text: str = "text", every: int = DAMAGE, min_chars: int = MIN_CHARS,
               min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the vocabulary; shorter runs cannot become long enough and are left out before hashing."""
    runs = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit("([A-Za-zÀ-ÿ]+)"), F.lit(1))).alias("run"))
    runs = runs.filter(F.char_length("run") >= min_chars).select("id", F.translate("run", UPPER, LOWER).alias("run"))
    words = runs.select(damaged(F.col("id"), F.col("run"), every).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return words.filter((F.char_length("word") >= min_chars) & (F.col("n") >= min_count))


class Acceptor:
    """Minimal deterministic acceptor of sorted distinct words; state 0 is the initial one."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = [{}]
        self.final = [False]
        register: dict[tuple, int] = {}
        tail: list[tuple[int, str, int]] = []       # arcs of the last word whose targets may still grow

        def close(keep: int) -> None:
            while len(tail) > keep:
                parent, c, child = tail.pop()
                seen = register.setdefault((self.final[child], *self.arcs[child].items()), child)
                self.arcs[parent][c] = seen

        last = ""
        for w in words:
            k = 0
            while k < len(last) and k < len(w) and last[k] == w[k]:
                k += 1
            close(k)
            state = tail[-1][2] if tail else 0
            for c in w[k:]:
                self.arcs.append({})
                self.final.append(False)
                self.arcs[state][c] = len(self.arcs) - 1
                tail.append((state, c, len(self.arcs) - 1))
                state = len(self.arcs) - 1
            self.final[state] = True
            last = w
        close(0)


def near_words(left: Acceptor, right: Acceptor) -> Iterator[tuple[str, str]]:
    """(u, v): u of ``left``, v of ``right``; v has one code point more, or a larger one in one place.

    A letter that could be inserted in several places of a run is inserted in the last one, so every pair comes once.
    """
    stack: list[tuple[int, int, str, str | None, str]] = [(0, 0, "", None, "")]     # states, u so far, v if edited, letter not to follow
    while stack:
        a, b, u, v, ban = stack.pop()
        p, q = left.arcs[a], right.arcs[b]
        if v is not None:
            if left.final[a] and right.final[b]:
                yield u, v
            few, many = (p, q) if len(p) < len(q) else (q, p)
            stack.extend((p[c], q[c], u + c, v + c, "") for c in few if c in many and c != ban)
            continue
        for c, t in p.items():
            if c in q:
                stack.append((t, q[c], u + c, None, ""))
        for d, s in q.items():
            stack.append((a, s, u, u + d, d))
            stack.extend((t, s, u + c, u + d, "") for c, t in p.items() if c < d)


def _best(into: dict, word: str, near: str, n: int) -> None:
    count, top = into.get(word, (0, None))
    if top is None or (-n, near) < top:
        top = (-n, near)
    into[word] = (count + 1, top)


def compose(turned: bool, m: int, key: str, rows: list[tuple[str, int, int]]) -> dict[str, tuple[int, tuple[int, str]]]:
    """Near words behind one initial state: word -> (count, (-n, word) of its best partner)."""
    counts = {w: n for w, n, _ in rows}
    cut = len(key)

    def behind(side: int) -> list[str]:
        return sorted({(w[::-1] if turned else w)[cut:] for w, _, s in rows if s & side})

    right = Acceptor(behind(2))
    left = right if all(s == 3 for _, _, s in rows) else Acceptor(behind(1))
    out: dict[str, tuple[int, tuple[int, str]]] = {}
    for u, v in near_words(left, right):
        if len(u) + cut > m:
            continue                                  # both of m + 1 letters: another state's pair
        u, v = key + u, key + v
        if turned:
            u, v = u[::-1], v[::-1]
            if u[:m // 2] == v[:m // 2]:
                continue                              # found in the vocabulary as it stands
        _best(out, u, v, counts[v])
        _best(out, v, u, counts[u])
    return out


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (state, cell, word, n, side) state by state."""
    names = ["word", "n_near", "best_n", "best"]
    done: list[tuple[str, int, int, str]] = []

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), (pa.string(), pa.int64(), pa.int64(), pa.string()))], names)
        done.clear()
        return batch

    def finish(state: tuple, rows: list) -> None:
        if len(rows) > 1:
            head = state[0]
            found = compose(head[0] == "r", int(head[1:head.index(":")]), head[head.index(":") + 1:], rows)
            done.extend((w, k, -top[0], top[1]) for w, (k, top) in found.items())

    state, rows = None, []
    for batch in batches:
        cells = zip(*(batch.column(c).to_pylist() for c in ("state", "bx", "by")))
        for at, row in zip(cells, zip(*(batch.column(c).to_pylist() for c in ("word", "n", "side")))):
            if at != state:
                if state:
                    finish(state, rows)
                state, rows = at, []
                if len(done) > 20_000:
                    yield flush()
            rows.append(row)
    if state:
        finish(state, rows)
    if done:
        yield flush()


def near_summary(vocab: DataFrame, min_chars: int = MIN_CHARS, limit: int = LIMIT) -> DataFrame:
    """(word, n_near, form of largest count, its count) of the words with near words; ``vocab`` has word and n."""
    size = F.char_length("word")
    keyed = vocab.select("word", "n", F.explode(F.array(size, size - 1)).alias("m")).filter(F.col("m") >= min_chars)
    half = (F.col("m") / 2).cast("int")
    first = F.concat(F.lit("f"), F.col("m"), F.lit(":"), F.left("word", half))
    last = F.concat(F.lit("r"), F.col("m"), F.lit(":"), F.reverse(F.right("word", F.col("m") - half)))
    keyed = keyed.select("word", "n", "m", F.explode(F.array(first, last)).alias("state"))
    large = keyed.groupBy("state").agg(F.count("*").alias("k")).filter(F.col("k") > limit).select("state", F.ceil(F.col("k") / limit).cast("int").alias("k"))
    keyed = keyed.join(large, "state", "left").withColumn("own", F.pmod(F.hash("word"), F.coalesce("k", F.lit(1))))
    cells = ["state", "bx", "by", "word", "n", "side"]
    small = keyed.filter(F.col("k").isNull()).select("state", F.lit(0).alias("bx"), F.lit(0).alias("by"), "word", "n", F.lit(3).alias("side"))
    big = keyed.filter(F.col("k").isNotNull()).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    as_left = big.filter(F.char_length("word") == F.col("m")).select("state", F.col("own").alias("bx"), F.col("other").alias("by"), "word", "n", F.lit(1).alias("side"))
    as_right = big.select("state", F.col("other").alias("bx"), F.col("own").alias("by"), "word", "n", F.lit(2).alias("side"))
    rows = small.unionByName(as_left).unionByName(as_right).select(*cells)
    found = (rows.repartition("state", "bx", "by").sortWithinPartitions("state", "bx", "by")
             .mapInArrow(_composed, "word string, n_near bigint, best_n bigint, best string"))
    top = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("w")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), top.alias("top")).select(
        "word", "n_near", F.col("top.w").alias("best"), (-F.col("top.n")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of all words with a form: counts grow along forms, so pointers double until none moves."""
    to = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        step = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut_lineage(to.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        to = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return to


def variants(docs: DataFrame, id_col: str = "doc_id", text: str = "text", ratio: int = RATIO) -> DataFrame:
    """Per vocabulary word: form, root, n, n_near, form_n."""
    vocab = cut_lineage(vocabulary(docs, id_col, text))
    full = vocab.join(near_summary(vocab), "word", "left")
    strong = F.col("best_n") >= ratio * F.col("n")
    full = cut_lineage(full.select("word", F.when(strong, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                                   F.when(strong, F.col("best_n")).alias("form_n")))
    return full.join(roots(full.filter("form IS NOT NULL")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

"""Corpus operators on small tables: brute force, round trips, odd rows."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from gapwright.llm import (decontaminate, html_extract, line_dedup, minhash, quality_rules, sentencepiece_bpe, sharding,
                           substring_dedup, toxicity, training_order)
from gapwright.session import cut_lineage

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, shard string"


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


def odd_rows():
    """Nulls, empty, white space, short, repeated, long, non-ASCII, clashing columns."""
    long = words(4000, 1)
    base = [None, "", "   \n\t ", "one", "a b c d", words(80, 2), words(80, 2), words(80, 3) + "\n" + words(20, 4), long, long + " end",
            "é漢😀 " * 60, "x" * 3000, "ab" * 2000, "line\nline\n  LINE \n\nother"]
    rows = [(i, t, None if i % 3 else "en", None, None, "k", None) for i, t in enumerate(base)]
    return rows + [(None, words(60, 9), None, None, None, None, None), (None, None, None, None, None, None, None), rows[5], rows[5]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    out, word = [], ""
    for c in text or "":
        if c in " \t\n\x0b\x0c\r":
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out + [word] if word else out


def test_quality_measures_match_brute_force(docs):
    got = collections.Counter(tuple(r) for r in quality_rules.with_policy(quality_rules.ledger(docs)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    want = collections.Counter()
    for i, t, *_ in odd_rows():
        w = split(t)
        grams = collections.Counter(zip(w, w[1:], w[2:]))
        rep = {k + o for k in range(len(w) - 2) if grams[tuple(w[k:k + 3])] > 1 for o in range(3)}
        lines = [x for x in (t or "").split("\n") if split(x)]
        want[(i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(rep),
              len(w) < 50 or 100 * len(rep) > 50 * len(w))] += 1
    assert got == want


def test_quality_policies_and_ablation(docs):
    ledger = quality_rules.ledger(docs)
    kept = quality_rules.with_policy(ledger).filter("kept").count()
    assert quality_rules.apply_policy(docs).columns == docs.columns
    assert quality_rules.apply_policy(docs).count() == kept
    for r in quality_rules.ablation(ledger).collect():
        assert r["n_kept_without"] == kept + r["n_only"]
    assert quality_rules.with_policy(ledger, "v1").filter("kept").count() >= kept


def test_line_dedup_drops_shared_lines(spark):
    rows = [(i, f"own {i}\n  Shared LINE\t\n{'x' if i < 9 else 'y'}") for i in range(12)] + [(50, None), (51, ""), (None, "shared line\nz")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: r for r in line_dedup.digest_rows(d).collect()}
    assert got[0].n_lines == 3 and got[0].n_dropped == 1
    assert got[0].kept_sha256 == hashlib.sha256(b"own 0\nx").hexdigest()          # x is in 9 documents only
    assert got[50].n_lines == 1 and got[51].n_dropped == 0 and got[50].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[None].n_dropped == 1
    first = {r["__row"].doc_id: r.n_dropped for r in line_dedup.dedup_lines(d, keep="first").collect()}
    assert sum(first.values()) == 12


def test_line_dedup_odd_rows(docs, empty):
    out = line_dedup.clean(docs, min_docs=2)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert line_dedup.clean(empty).count() == 0


def shingles(text):
    w = [x.translate({a: a + 32 for a in range(65, 91)}) for x in split(text)]
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if w else set()


def brute_components(rows):
    sets = {}
    for i, t, *_ in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t))
    comp = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                if comp[i] != comp[j] and any(a and b and 100 * len(a & b) >= 75 * len(a | b) for a in sets[i] for b in sets[j]):
                    comp[i] = comp[j] = min(comp[i], comp[j])
                    changed = True
    return comp


def near_rows():
    r = random.Random(5)
    base = words(150, 11).split()
    rows = [(i, " ".join(base)) for i in range(6)]
    for i in range(6, 70):                                   # near copies with very different numbers of edits
        w = list(base)
        for _ in range(r.randint(1, 9)):
            w[r.randrange(len(w))] = f"edit{r.random()}"
        rows.append((i, " ".join(w)))
    return rows + [(100, None), (101, ""), (102, "a b"), (103, "A  b"), (104, "b a"), (None, " ".join(base)), (105, words(90, 6)), (105, words(90, 6))]


def test_near_duplicates_match_brute_force(spark):
    d = spark.createDataFrame(near_rows(), "doc_id bigint, text string").repartition(5)
    got = minhash.near_duplicates(d).collect()
    want = brute_components(near_rows())
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id is not None} == set(want.items())
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got) and len(got) == len(near_rows())
    assert {r.doc_id: r.n_shingles for r in got}[102] == 1


def test_near_duplicates_keep_one_and_odd_rows(docs, empty):
    out = minhash.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    ids = {r.doc_id for r in out.select("doc_id").collect()}
    assert {5, 7, 8} <= ids and 6 not in ids and 9 not in ids and None in ids
    assert minhash.near_duplicates(empty).count() == 0


def test_estimate_follows_similarity():
    a = np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        x, y = minhash.minima(a[:900]), minhash.minima(a[100:])
    assert abs(float((x == y).mean()) - 0.8) < 0.12


def brute_repeats(rows, span=substring_dedup.SPAN):
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    seen = collections.Counter(b[k:k + span] for _, b in texts for k in range(len(b) - span + 1))
    out = collections.Counter()
    for i, b in texts:
        cover = np.zeros(len(b) + 1, int)
        for k in range(len(b) - span + 1):
            if seen[b[k:k + span]] > 1:
                cover[k] += 1
                cover[k + span] -= 1
        gone = np.cumsum(cover[:-1]) > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[(i, len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest())] += 1
    return out


def passage_rows():
    shared = words(80, 21)
    rows = [(i, words(40, 100 + i) + " " + shared[i % 7:len(shared) - i % 5] + " " + words(30, 200 + i)) for i in range(40)]
    return rows + [(60, shared), (61, shared), (62, shared[:199]), (63, "z" * 500), (64, ("pq" * 99) + "!" + ("pq" * 130))]


@pytest.mark.parametrize("rows", [passage_rows, odd_rows])
def test_substring_dedup_matches_brute_force(spark, rows):
    data = [(r[0], r[1]) for r in rows()]
    d = spark.createDataFrame(data, "doc_id bigint, text string").repartition(6)
    got = collections.Counter(tuple(r) for r in substring_dedup.digest_rows(d).collect())
    assert got == brute_repeats(data)


@pytest.mark.parametrize("doc_id", [None, 5])
def test_substring_dedup_keeps_texts_of_equal_crc_apart(spark, doc_id):
    one, two = words(90, 22), words(90, 23)
    end, tail = words(70, 24), words(70, 25)
    heads = {zlib.crc32(f"{k} {one} {end}".encode().ljust(900)): k for k in range(150_000)}
    pair = next((heads[c], k) for k in range(10 ** 6) if (c := zlib.crc32(f"{tail} {two} {k}".encode().ljust(900))) in heads)
    texts = [f"{pair[0]} {one} {end}".ljust(900), f"{tail} {two} {pair[1]}".ljust(900)]
    assert zlib.crc32(texts[0].encode()) == zlib.crc32(texts[1].encode())
    data = [(doc_id, texts[0]), (doc_id, texts[1]), (1, one[3:]), (2, two[3:])]
    d = spark.createDataFrame(data, "doc_id bigint, text string").repartition(3)
    assert collections.Counter(tuple(r) for r in substring_dedup.digest_rows(d).collect()) == brute_repeats(data)


def test_substring_dedup_reads_long_texts_in_blocks(spark, monkeypatch):
    shared = words(120, 31)
    data = [(1, words(900, 32) + shared + words(900, 33)), (2, shared), (3, words(50, 34))]
    assert substring_dedup._cut(b"a" * 500, [0 << 16 | 1 << 8, 100 << 16 | 3 << 8]) == (b"a" * 198, 302, 1)
    d = spark.createDataFrame(data, "doc_id bigint, text string")
    got = collections.Counter(tuple(r) for r in substring_dedup.digest_rows(d).collect())
    assert got == brute_repeats(data)


def test_sharding_law_and_slots(docs, empty):
    rows = sharding.shard_documents(docs, 4).collect()
    assert len(rows) == docs.count()
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert {r.grown_shard for r in rows if r.grown_shard != r.shard} <= {4}
    by_id = {r[0]: r[1] for r in odd_rows()}
    for r in rows:
        if r.doc_id is not None:
            raw = (by_id[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    assert sharding.shard_documents(empty).count() == 0


def test_sharding_weights_and_growth(spark):
    d = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    heavy = {r["shard"]: r["count"] for r in sharding.assign(d, [1.0, 3.0]).groupBy("shard").count().collect()}
    assert abs(heavy[1] / 20000 - 0.75) < 0.02
    three = {r.doc_id: r.shard for r in sharding.assign(d, [1.0] * 3).collect()}
    assert all(r.grown_shard == r.shard and three[r.doc_id] in (r.shard, 2) for r in sharding.assign(d, [1.0] * 2).collect() if three[r.doc_id] != 2)
    assert all((r.grown_shard == 2) == (three[r.doc_id] == 2) for r in sharding.assign(d, [1.0] * 2).collect())


ITEM = "Alice has 12 apples and gives 5 of them to her friend Peter before walking 3 km home in the rain"


def test_decontamination_finds_copies_and_new_numbers(spark):
    b = spark.createDataFrame([(1, ITEM), (2, words(30, 40)), (3, None), (4, "short item"), (5, "")], "item_id bigint, text string")
    filler = words(40, 41)
    rows = [(1, f"{filler} {ITEM} {filler}"), (2, filler + " " + ITEM.replace("12", "30").replace("5 ", "7 ").replace("Alice", "Carol").replace("km", "miles")),
            (3, filler), (4, None), (5, words(30, 40)), (6, ITEM[:30]), (None, ITEM)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(d, b).collect()}
    assert got == {(1, 1), (2, 1), (5, 2), (None, 1)}
    assert {r.doc_id for r in decontaminate.drop_leaks(d, b).collect()} == {3, 4, 6}


def test_decontamination_finds_copies_with_few_literals(spark):
    items = ["The Old Man And The Sea Was Written By Ernest Hemingway While He Was Living In Cuba", "Sort the list: 14, 3, 27, 9, 81, 5, 62, 40, 11, 8, 33, 70, 19, 2",
             "Alice, Bob, Carol, David, Emma, Frank, Grace, Henry, John, Mary, James, Anna, Peter, Susan, Tom", "Paris Rome 7 9", "Which river runs through this city"]
    b = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    filler = words(40, 41)
    rows = [(i, f"{filler} {x.lower() if i == 3 else x} {filler}") for i, x in enumerate(items)]
    rows += [(10, filler + " Sort the list: " + ", ".join(str(x) for x in range(200, 214))), (11, filler + " Lima Oslo 7 9 " + filler),
             (12, filler + " 3, 27, 9, 81, 5, 62, 40, 11 " + filler.replace(" ", " 6 "))]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(d, b).collect()} == {(i, i) for i in range(5)}
    assert {r.doc_id for r in decontaminate.drop_leaks(d, b).collect()} == {10, 11, 12}


def test_decontamination_finds_long_stretches_of_longer_items(spark):
    item = words(600, 50).split()
    numbers = " ".join(f"{w} 3" if i % 9 == 4 else w for i, w in enumerate(words(400, 51).split())).split()
    b = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(numbers))], "item_id bigint, text string")
    rng = iter(range(10, 10_000))
    part = [("8" if w == "3" else w) for w in numbers[100:170]]
    rows = [(1, item[100:350]), (2, item[:50]), (3, item[-50:]), (4, item[200:249]), (5, part),
            (6, [str(next(rng)) if w == "8" else w for w in part])]
    d = spark.createDataFrame([(i, f"{words(30, 60)} {' '.join(x)} {words(30, 61)}") for i, x in rows], "doc_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(d, b).collect()} == {(1, 1), (2, 1), (3, 1), (5, 2)}
    assert {r.doc_id for r in decontaminate.drop_leaks(d, b).collect()} == {4, 6}


def test_longest_consistent_stretch_matches_brute_force():
    r = random.Random(4)
    for _ in range(300):
        n = r.randint(1, 25)
        same, slot = (np.array([r.random() < q for _ in range(n)]) for q in (0.85, 0.5))
        old, new = (np.array([r.randint(0, 2) for _ in range(n)], np.uint64) for _ in range(2))
        fits = lambda a, b: same[a:b].all() and all(len({int(new[k]) for k in range(a, b) if slot[k] and old[k] == v}) < 2 for v in range(3))
        want = max([b - a for a in range(n) for b in range(a + 1, n + 1) if fits(a, b)], default=0)
        assert decontaminate._longest(same, slot, old, new) == want


def test_decontamination_slots_must_agree():
    with np.errstate(over="ignore"):
        item = "if 3 boys share 3 cakes and 3 girls share 3 pies then how many sweets are there for 3 teachers"
        index = decontaminate.Index([1], [item])
        same = list(decontaminate._leaks(index, decontaminate.Tokens(decontaminate.texts_of(__import__("pyarrow").array([item.replace("3", "8")])))))
        other = item
        for k in (1, 2, 4, 5, 6):
            other = other.replace("3", str(k), 1)
        mixed = list(decontaminate._leaks(index, decontaminate.Tokens(decontaminate.texts_of(__import__("pyarrow").array([other])))))
    assert same[0][4:] == (5, 0) and mixed[0][5] > 0.2 * mixed[0][4]


def test_decontamination_blocks_and_empty(spark, docs, empty, monkeypatch):
    b = spark.createDataFrame([(i, words(20, 300 + i)) for i in range(5)], "item_id bigint, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_TOKENS", 30)
    assert len(list(decontaminate.blocks(b))) == 5
    d = spark.createDataFrame([(i, words(9, i) + " " + words(20, 300 + i)) for i in range(5)], "doc_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(d, b).collect()} == {(i, i) for i in range(5)}
    assert decontaminate.leaks(empty, b).count() == 0 and decontaminate.leaks(docs, b.limit(0)).count() == 0
    assert decontaminate.drop_leaks(docs, b).columns == docs.columns


def piece_texts():
    r = random.Random(3)
    letters = list("abcdeinorst THE  \n\t.,!<>s/0x1é門ก😀ß▁") + ["the", "ing", " of ", "   "]
    odd = ["", " ", "  ", "a ", "   a  b   ", "\n  x", "<s> </s> <0x41>", "a" * 3000, " " * 77 + "x", " " * 41 + "\n", "hello world " * 30]
    return odd + ["".join(r.choice(letters) for _ in range(r.randint(0, 80))) for _ in range(1500)]


def test_pieces_equal_the_library(spark):
    texts = piece_texts()
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "doc_id bigint, text string").repartition(3)
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.DEFAULT_MODEL)
    got = {r.doc_id: r for r in sentencepiece_bpe.encode_checked(d).collect()}
    assert got[-1].ids == []
    for i, t in enumerate(texts):
        assert got[i].ids == sp.encode(t), t
        assert got[i].decoded_equal == ("▁" not in t)
    back = sentencepiece_bpe.decode(d.sparkSession.createDataFrame([(1, sp.encode("  some text é")), (2, None), (3, [99999, -4, 1])], "k int, ids array<int>"))
    assert {r["__row"].k: r.decoded for r in back.collect()} == {1: "  some text é", 2: "", 3: ""}


def test_pieces_odd_rows(docs, empty):
    rows = sentencepiece_bpe.encode_checked(docs, ("doc_id", "lang", "kept")).collect()
    assert len(rows) == docs.count() and all(r.decoded_equal for r in rows)
    assert sentencepiece_bpe.encode(docs).columns == ["__row", "ids"] and sentencepiece_bpe.encode_checked(empty).count() == 0


def test_permutation_is_one_to_one():
    for n in (1, 2, 3, 5, 16, 17, 1000, 65537):
        for key in (1, 2):
            assert sorted(training_order.permuted(np.arange(n), n, key).tolist()) == list(range(n))
    assert (training_order.permuted(np.arange(1000), 1000, 1) != training_order.permuted(np.arange(1000), 1000, 2)).any()


def test_training_order_round_trip(spark, docs, empty, tmp_path):
    rows = training_order.ordered(docs, length=64, shard_rows=50)
    got = sorted(rows.collect(), key=lambda r: r.slot)
    assert [r.slot for r in got] == list(range(len(got)))
    stream = np.concatenate([np.frombuffer(r.tokens, "<u2")[:r.n_tokens] for r in sorted(got, key=lambda r: r.sequence)]).tolist()
    texts, part = [], []
    for t in stream:
        if t == training_order.END:
            texts.append(tuple(part))
            part = []
        else:
            part.append(t)
    encode = training_order.encoding(training_order.DEFAULT_RANKS).encode_ordinary
    assert part == [] and collections.Counter(texts) == collections.Counter(tuple(encode(r[1] or "")) for r in odd_rows())
    path = str(tmp_path / "shards")
    training_order.write_shards(rows, path)
    at = len(got) // 2
    back = {r.slot: bytes(r.tokens) for r in training_order.read_shards(spark, path, at, 64, 50).collect()}
    assert back == {r.slot: bytes(r.tokens) for r in got[at:]}
    assert training_order.ordered(empty).count() == 0


PAGE = """<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies &amp; more.</div>{open}<h1>Head &amp; shoulders</h1><p>First   para <b>bold.<br><p>Second one, long enough to be text.
{close}<div class="comments"><div class="comment"><p>Nice post, thanks.</p></div></div><footer>&copy; me</footer>"""


def test_html_main_text(spark):
    pages = [(i, "u", PAGE.format(open="<article>", close="</article>")) for i in range(20)]
    pages += [(50, "u", PAGE.format(open='<div class="post-content">', close="</div>")), (51, "u", None), (52, "u", ""), (53, None, "<p>"), (None, "u", "x < y")]
    d = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    got = {r["__row"].page_id: r.text for r in html_extract.extract(d).collect()}
    want = "Head & shoulders\n\nFirst para bold.\n\nSecond one, long enough to be text."
    assert got[0] == want and got[50] == want and got[51] == got[52] == got[53] == ""
    assert html_extract.extract(d.limit(0)).count() == 0


def test_html_broken_and_unusual_markup():
    """Nothing behind an unclosed element is lost; formulas and drawings keep their words; nothing unseen is read."""
    read = lambda page: [b.text for b in html_extract.leaves(page)]
    for tag in ("svg", "math", "object", "noscript"):
        assert read(f"<article><p>One.</p><{tag}><p>Two.</p><p>Three.</p>") == ["One.", "Two.", "Three."]
        assert read(f"<p>One <{tag}>and</{tag}> two.</p>")[-1].endswith("two.") and "and" in " ".join(read(f"<p>One <{tag}>and</{tag}> two.</p>"))
    for tag in ("select", "textarea", "iframe", "canvas", "audio", "video", "script", "style", "template", "title"):
        assert read(f"<p>One.</p><{tag}>hidden<p>Two.</p><p>Three.</p>") == ["One.", "Two.", "Three."]
        assert read(f"<p>One.</p><{tag}>hidden</{tag}><p>Two.</p>") == ["One.", "Two."]
    for tag in ("textarea", "iframe"):                         # the first has no end tag, the second has one
        assert read(f"<p>One.</p><{tag}>hidden<p>Two.</p><{tag}>hidden</{tag}><p>Three.</p>") == ["One.", "Two.", "Three."]
    assert read("<script>if (a<b) put('<script>')</script><p>One.") == ["One."]
    assert read("<head><title>T<body><p>One.") == ["One."]
    assert len(read("<p>word <script>" * 20_000)) == 20_000


def test_html_learns_from_labelled_pages_first(spark):
    plain = [(i, f"<div class=post><p>Nothing labelled on page {i}.</p></div>") for i in range(400)]
    marked = [(1000 + i, f"<nav>Home</nav><article><p>The labelled page {i} says so.</p></article>") for i in range(3)]
    d = spark.createDataFrame(plain + marked, "page_id bigint, html string")
    names = html_extract.fit(d, sample=5).weights
    assert "near=article" in names and html_extract.fit(d, sample=5).weights == names


def test_html_odd_rows(spark):
    """Repeated rows, names that clash with the operator's own, a page of 20,000 paragraphs."""
    page = PAGE.format(open="<article>", close="</article>")
    long = "<nav>Home</nav><article>" + "".join(f"<p>Paragraph number {k} of a long page.</p>" for k in range(20_000)) + "</article>"
    rows = [(i, page, "t", i) for i in range(12)] + [(5, page, "t", 5)] * 3 + [(99, long, None, None)]
    d = spark.createDataFrame(rows, "page_id bigint, html string, text string, seed int")
    got = [(r["__row"], r.text) for r in html_extract.extract(d).collect()]
    assert len(got) == 16 and {t for k, t in got if k.page_id != 99} == {"Head & shoulders\n\nFirst para bold.\n\nSecond one, long enough to be text."}
    assert next(t for k, t in got if k.page_id == 99).count("\n\n") == 19_999 and next(k for k, _ in got if k.page_id == 5).text == "t"


def test_html_field_on_held_out_variants():
    rows = [(html_extract.described(b), y) for k in range(60) for b, y in html_extract.variants(list(html_extract.SENTENCES), k)]
    field = html_extract.train(rows[:140])
    right = [a == b for f, y in rows[140:] for a, b in zip(field.labels(f), y)]
    assert np.mean(right) > 0.97


def test_viterbi_is_the_best_labelling():
    field = html_extract.Field({"a": 0, "b": 1}, np.array([[0.3, 0.1], [-0.2, 0.4]]), np.array([[0.5, -0.4], [-0.7, 0.6]]))
    r = random.Random(2)
    for _ in range(50):
        seq = [[r.choice("ab") for _ in range(r.randint(0, 2))] for _ in range(6)]

        def score(ys):
            return sum(field.weights[f][y] for fs, y in zip(seq, ys) for f in fs) + sum(field.moves[a][b] for a, b in zip(ys, ys[1:]))
        best = max(score([k >> i & 1 for i in range(6)]) for k in range(64))
        assert abs(score(field.labels(seq)) - best) < 1e-9


def test_toxicity_separates_held_out(spark, docs, empty):
    r = random.Random(8)
    rows, labels = [], []
    for i in range(900):
        w = words(40, 1000 + i).split()
        bad = r.random() < 0.3
        if bad:
            for _ in range(3):
                w[r.randrange(40)] = r.choice(["idiot", "scum", "grumbol"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    d = spark.createDataFrame(rows + [(5000, None), (None, "")], "doc_id bigint, text string")
    lab = spark.createDataFrame(labels + [(None, 1), (7000, None)], "doc_id bigint, toxic int")
    got = toxicity.score_documents(d, lab).collect()
    assert len(got) == 902 and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in got)
    truth = dict(labels)
    held = [x for x in got if x.held_out and x.doc_id in truth]
    assert np.mean([x.predicted == truth[x.doc_id] for x in held]) > 0.95
    none = toxicity.score_documents(docs, lab.limit(0)).collect()
    assert len(none) == docs.count() and {x.score for x in none} == {0.0}


def test_pipeline_stages(spark, sf):
    import corpus_pipeline
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = cut_lineage(stage(spark, docs, sf))
        assert docs.columns == columns and docs.count() <= before, name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {"doc_id", "ids", "n_tokens"} <= set(last.columns) and last.count() == docs.count()

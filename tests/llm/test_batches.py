"""Batches cut into several slices give the rows of uncut texts."""

import collections
import random
import time

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from gapwright.llm import batches, decontaminate, html_extract, line_dedup, minhash, sentencepiece_bpe, substring_dedup, toxicity, training_order
from tests.llm.test_corpus import ITEM, shingles, words

TEXTS = [words(60, 1), "Upper CASE words\nshared line\n" + words(30, 2), None, "", words(200, 3), words(60, 1), "É " * 40 + "shared line", f"{words(20, 4)} {ITEM} end",
         words(90, 5), "x"]


def batch(texts, first=0):
    n = len(texts)
    ids = pa.array(range(first, first + n), pa.int64())
    return pa.RecordBatch.from_arrays([ids, pa.array(texts, pa.string()), pa.array(texts, pa.string()), pa.StructArray.from_arrays([ids], ["doc_id"]),
                                       pa.array([k % 2 for k in range(n)], pa.int32()), pa.array([None] * n, pa.list_(pa.binary()))],
                                      ["__id", "__text", "__html", "__row", "toxic", "__drop"])


def rows(task, data):
    return [tuple(r.values()) for b in task(iter(data)) for r in b.to_pylist()]


@pytest.fixture()
def cut(monkeypatch):
    monkeypatch.setattr(batches, "PIECE", 300)
    monkeypatch.setattr(sentencepiece_bpe, "BATCH_BYTES", 300)
    monkeypatch.setattr(substring_dedup, "BLOCK", 300)
    assert len(list(batches.pieces(iter([batch(TEXTS)]), "__text"))) >= 3


class Shared:
    value = ([7], [ITEM])


TASKS = {"signatures": minhash._fingerprint, "sets": minhash._sets, "terms": toxicity._terms, "features": toxicity._features(frozenset(["upper"]), frozenset()),
         "lines": line_dedup._occurrences(1), "rebuilt lines": line_dedup._rebuild, "leaks": decontaminate._search(Shared),
         "pieces": sentencepiece_bpe._round_trip(sentencepiece_bpe.DEFAULT_MODEL)}


@pytest.mark.parametrize("name", TASKS)
def test_slices_give_the_rows_of_single_texts(cut, name):
    task = TASKS[name]
    alone = [r for k, t in enumerate(TEXTS) for r in rows(task, [b for b in [batch(TEXTS).take(pa.array([k]))]])]
    got = rows(task, [batch(TEXTS)])
    assert collections.Counter(map(str, got)) == collections.Counter(map(str, alone)) and got


def test_sliced_shingles_match_brute_force(cut):
    got = {r[0]: r[1] for r in rows(minhash._fingerprint, [batch(TEXTS)])}
    assert got == {k: len(shingles(t)) for k, t in enumerate(TEXTS)}


def test_texts_of_slices():
    whole = pa.array(["Aa b", None, "Ee", "Ff g h"])
    texts = batches.texts_of(whole.slice(1, 3))
    names, codes, at = batches.words_of(texts, lower=True)
    assert names.take(pa.array(codes)).to_pylist() == ["ee", "ff", "g", "h"] and at.tolist() == [0, 0, 1, 4]
    assert batches.texts_of(whole.slice(4)).to_pylist() == []


def test_long_words_and_many_words_equal_the_library(monkeypatch):
    monkeypatch.setattr(sentencepiece_bpe, "LETTERS", 900)
    v = sentencepiece_bpe.vocabulary(sentencepiece_bpe.DEFAULT_MODEL)
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.DEFAULT_MODEL)
    r = random.Random(6)
    texts = ["".join(r.choice("etaoinsé門😀▁") for _ in range(n)) for n in (255, 256, 257, 700, 2500)] + ["ab" * 900, words(900, 7)]
    texts.append(" ".join(texts))
    with np.errstate(over="ignore"):
        assert sentencepiece_bpe.encode_texts(v, pa.array(texts, pa.large_string())).to_pylist() == [sp.encode(t) for t in texts]
        long = "".join(r.choice("etaoinshrdlu") for _ in range(80_000))
        began = time.time()
        sentencepiece_bpe.encode_texts(v, pa.array([long], pa.large_string()))
    assert time.time() - began < 10


def test_ids_and_html_of_slices(cut):
    pages = [f"<article><p>{t or ''}</p></article>" for t in TEXTS]
    data = batch(pages)
    got = [b.column("__html").to_pylist() for b in batches.pieces(iter([data]), "__html")]
    assert [x for part in got for x in part] == pages
    assert training_order.encoding(training_order.DEFAULT_RANKS) and html_extract.texts_of(data.column("__html").slice(3, 2)).to_pylist() == pages[3:5]

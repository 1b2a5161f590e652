"""Toxicity: boosted trees over dense text features, calibrated by isotonic regression.

Features of a whole text: densities of a fixed lexicon of insults and of words and word beginnings that mark toxic
training texts, their nearness to the second person, capitals, punctuation and obfuscation rates, length.  Words and
beginnings are learnt by document counts over the training rows; so are the trees, on another part of them.

Labels are read only for rows with crc32(id) mod 5 other than 0: parts 1 to 3 give the learnt lexicon, part 4 the trees
(even crc32 // 5) and the calibration (odd).  At most ``MAX_ROWS`` labelled rows are used, those
with the smallest hash of their id; scoring covers every row.  No other column is an input.

Null and empty texts have all-zero features and get the score of those.  Rows with a null id are scored and belong to
``held_out`` = crc32 of the empty text.  Repeated rows are scored alike; a repeated id in the labels counts once per
label.  Without labels of both kinds every score is the share of label 1 (0 without any).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwright.llm.batches import coded, pieces, texts_of, words_of
from gapwright.session import cut_lineage

MAX_ROWS = 40_000           # labelled rows that are learnt from
MAX_TERMS = 2_000           # learnt words, and learnt beginnings
MIN_DOCS = 5                # training documents that a learnt term is found in
PURITY = 0.7                # share of them that is toxic
STEMS = (4, 5)              # letters of a word beginning
NEAR = 5                    # words between an insult and the second person

# Common insults and second-person words.
INSULTS = """idiot stupid moron dumb loser pathetic worthless scum trash disgusting clown fool ugly jerk garbage filthy hate
shut kill bastard bitch damn crap imbecile coward liar freak pig rat vermin""".split()
SECOND = """you your yours yourself u ur ya du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos usted ustedes
ti vosotros tuyo""".split()

FEATURES = ["lexicon", "word_rate", "word_hits", "stem_rate", "stem_hits", "near_second", "second", "capitals", "upper_words",
            "exclaim", "question", "punct", "obfuscated", "stretched", "digits", "log_words"]

_EDGE = regex.compile(r"^[\W_]+|[\W_]+$")
_OBFUSCATED = regex.compile(r"\p{L}[*@$#!0134]+\p{L}|\p{L}(?:[.\-_]\p{L}){2,}")
_STRETCHED = regex.compile(r"(\p{L})\1{3,}")


def fold(id_col: Column) -> Column:
    """crc32 of the id as text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary"))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, toxic) of the distinct words and word beginnings of each labelled text."""
    for batch in pieces(batches, "__text"):
        distinct, codes, at = words_of(texts_of(batch.column("__text")), lower=True)
        cores = [_EDGE.sub("", w.lower()) for w in distinct.to_pylist()]
        toxic = batch.column("toxic").to_numpy()
        row = np.repeat(np.arange(batch.num_rows), np.diff(at))
        for mark, names in (("w", cores), *(("s", [c[:k] if len(c) > k else "" for c in cores]) for k in STEMS)):
            values, of = coded(pa.array(names, pa.string()))
            pair = np.unique(row * max(1, len(values)) + of[codes])
            r, k = pair // max(1, len(values)), pair % max(1, len(values))
            terms = values.take(pa.array(k))
            full = pc.greater(pc.utf8_length(terms), 1)
            yield pa.RecordBatch.from_arrays(
                [pc.binary_join_element_wise(pa.scalar(mark), terms, ":").filter(full), pa.array(toxic[r].astype(np.int32)).filter(full)],
                ["term", "toxic"])


def _features(words: frozenset[str], stems: frozenset[str]):
    insults, second = frozenset(INSULTS), frozenset(SECOND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "__text"):
            texts = texts_of(batch.column("__text"))
            distinct, codes, at = words_of(texts)
            raw = distinct.to_pylist()
            n = np.diff(at)
            size = np.maximum(n, 1)
            marks = np.zeros((10, len(raw)))
            for i, w in enumerate(raw):
                core = _EDGE.sub("", w)
                low = core.lower()
                upper = sum(map(str.isupper, core)) if core != low else 0
                plain = w.isalpha()
                marks[:, i] = (low in insults, low in words, any(low[:k] in stems for k in STEMS), low in second, upper,
                               len(core) > 1 and upper == len(core), len(w),
                               not plain and _OBFUSCATED.search(w) is not None, _STRETCHED.search(w) is not None,
                               0 if plain else sum(map(str.isdigit, w)))
            per = marks[:, codes]
            sums = np.stack([np.diff(np.concatenate([[0.0], np.cumsum(x)])[at]) for x in per])
            bad = (per[0] + per[1] + per[2]) > 0
            # nearest second-person word, within the text
            place = np.arange(len(codes))
            you = np.where(per[3] > 0, place, -10 ** 9)
            before = np.maximum.accumulate(you) if len(codes) else you
            after = -np.maximum.accumulate(np.where(per[3] > 0, -place, -10 ** 9)[::-1])[::-1] if len(codes) else you
            start, stop = np.repeat(at[:-1], n), np.repeat(at[1:], n)
            near = bad & (((before >= start) & (place - before <= NEAR)) | ((after < stop) & (after - place <= NEAR)))
            near = np.diff(np.concatenate([[0], np.cumsum(near)])[at])
            letters = np.maximum(sums[6], 1)
            count = lambda p: pc.count_substring(texts, p).to_numpy(zero_copy_only=False)
            punct = pc.count_substring_regex(texts, r"[[:punct:]]").to_numpy(zero_copy_only=False)
            values = [sums[0] / size, sums[1] / size, np.minimum(sums[1], 50), sums[2] / size, np.minimum(sums[2], 50), near / size,
                      sums[3] / size, sums[4] / letters, sums[5] / size, count("!") / letters, count("?") / letters, punct / letters,
                      sums[7] / size, sums[8] / size, sums[9] / letters, np.log1p(n)]
            yield pa.RecordBatch.from_arrays([batch.column("__row"), *(pa.array(np.asarray(v, np.float64)) for v in values)], ["__row", *FEATURES])
    return run


class Scorer:
    """Learnt terms, trees and calibration."""

    def __init__(self, terms: DataFrame, trees, calibration, share: float):
        rows = terms.collect()                       # at most 2 * MAX_TERMS rows
        self.words = frozenset(r[0][2:] for r in rows if r[0].startswith("w"))
        self.stems = frozenset(r[0][2:] for r in rows if r[0].startswith("s"))
        self.trees, self.calibration, self.share = trees, calibration, share

    def featured(self, docs: DataFrame) -> DataFrame:
        """``__row`` and the features of ``__text``."""
        return features(docs, self.words, self.stems)

    def score(self, rows: DataFrame) -> DataFrame:
        """Adds ``score``, between 0 and 1."""
        if self.trees is None:
            return rows.withColumn("score", F.lit(self.share))
        raw = margin(self.trees, rows)
        out = self.calibration.transform(raw)
        # isotonic steps tie; the margin orders inside a step without leaving it
        return out.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("calibrated"))))


def features(docs: DataFrame, words: frozenset[str], stems: frozenset[str]) -> DataFrame:
    kind = docs.schema["__row"].dataType.simpleString()
    return docs.select("__row", "__text").mapInArrow(_features(words, stems), f"__row {kind}, " + ", ".join(f"{f} double" for f in FEATURES))


def margin(trees, rows: DataFrame) -> DataFrame:
    """Adds ``margin``, the log odds of the trees."""
    made = VectorAssembler(inputCols=FEATURES, outputCol="__x").transform(rows)
    return trees.transform(made).withColumn("margin", vector_to_array("rawPrediction")[1]).drop("__x", "rawPrediction", "probability", "prediction")


def learnt_terms(labelled: DataFrame) -> DataFrame:
    """Words and beginnings that mark toxic texts, the surest ``MAX_TERMS`` of each; ``labelled``: __text, toxic."""
    counts = (labelled.mapInArrow(_terms, "term string, toxic int").groupBy("term")
              .agg(F.count("*").alias("n"), F.sum("toxic").alias("k")))
    sure = counts.filter((F.col("n") >= MIN_DOCS) & (F.col("k") >= PURITY * F.col("n"))).withColumn("kind", F.substring("term", 1, 1))
    tops = [sure.filter(F.col("kind") == k).orderBy(F.desc("k"), "n", "term").limit(MAX_TERMS) for k in ("w", "s")]
    return tops[0].unionByName(tops[1]).select("term")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "toxic", max_rows: int = MAX_ROWS) -> Scorer:
    """A scorer learnt from the labelled rows outside the held-out part."""
    known = (labels.select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("toxic")).filter("toxic in (0, 1)").distinct()
             .withColumn("__f", fold(F.col("__id"))).filter(F.col("__f") % 5 != 0)
             .orderBy(F.xxhash64("__id", "toxic")).limit(max_rows))
    rows = cut_lineage(docs.select(F.col(id_col).alias("__id"), F.col("text").alias("__text")).join(known, "__id")
                       .select(F.struct("__f", "toxic").alias("__row"), "__text"))
    mix = {r["toxic"]: r["n"] for r in rows.groupBy("__row.toxic").agg(F.count("*").alias("n")).collect()}
    total = sum(mix.values())
    part = F.col("__row.__f") % 5
    terms = learnt_terms(rows.filter(part <= 3).select("__text", F.col("__row.toxic").alias("toxic")))
    scorer = Scorer(terms, None, None, mix.get(1, 0) / total if total else 0.0)
    if min(mix.get(0, 0), mix.get(1, 0)) < 10:
        return scorer
    made = cut_lineage(scorer.featured(rows.filter(part == 4)).select(*FEATURES, F.col("__row.toxic").cast("double").alias("y"),
                                                                     ((F.col("__row.__f") / 5).cast("long") % 2).alias("half")))
    x = VectorAssembler(inputCols=FEATURES, outputCol="__x").transform(made.filter("half = 0"))
    if made.filter("half = 0").select("y").distinct().count() < 2 or made.filter("half = 1").isEmpty():
        return scorer
    scorer.trees = GBTClassifier(featuresCol="__x", labelCol="y", maxIter=20, maxDepth=3, maxBins=32, stepSize=0.2, seed=11).fit(x)
    held = margin(scorer.trees, made.filter("half = 1"))
    scorer.calibration = IsotonicRegression(featuresCol="margin", labelCol="y", predictionCol="calibrated").fit(held)
    return scorer


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, held_out, score, predicted."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    scorer = fit(base, labels.withColumnRenamed(id_col, "doc_id"))
    rows = scorer.score(scorer.featured(base.select(F.struct("doc_id").alias("__row"), F.col("text").alias("__text"))))
    return rows.select(F.col("__row.doc_id").alias(id_col), (fold(F.col("__row.doc_id")) % 5 == 0).alias("held_out"), "score",
                       (F.col("score") >= 0.5).cast("int").alias("predicted"))

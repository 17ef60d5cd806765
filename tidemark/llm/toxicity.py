"""Toxicity: gradient-boosted trees over dense features of a text, calibrated by isotonic regression.

`learn_lexicon` finds the words that mark toxic training texts (counted by Spark over the whole training sample),
`features` measures a text against them: how dense lexicon words are, how near to a second person, capitals,
punctuation, obfuscated spellings. `fit` trains spark.ml trees on three quarters of the sample and calibrates their
margin on the rest. Labels, language, source and id are no features.

The training sample is bounded: at most max_labelled rows, chosen by the hash of their id. All else covers all rows.

Defined cases: null and empty texts have features of 0 and get a score like any other; rows without id are scored but
never learned from; where labels repeat an id each counts; with no training row of one of the classes, every score is
the share of label 1 (0 without any label); an empty table gives no rows; other columns pass through untouched, but for one named toxicity, which is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .common import ship, stored

#: Common insults, the part of the lexicon that is given; the rest is learned.
INSULTS = ("idiot", "idiota", "imbecile", "moron", "stupid", "dumb", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown", "fool", "freak", "pig", "estupido", "basura", "crétin", "connard", "dummkopf", "abschaum")
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "ur", "tu", "tus", "usted", "ustedes", "vous", "votre", "toi", "du", "dein", "ihr", "euch", "dich")
#: Signs that stand for letters in disguised words.
DISGUISES = str.maketrans("013457@$!", "oieastasi")
FEATURES = ("lexicon_per_word", "weight_per_word", "top_weight", "hits", "kinds", "second_person_near", "second_person_per_word", "capitals", "punctuation", "exclaims", "digits", "disguised_hits", "disguised_words", "log_words", "wide_letters")


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    base: float
    trees: GBTClassificationModel | None = None
    calibration: IsotonicRegressionModel | None = None
    text_col: str = field(default="text")


def _measure(text: str | None, hits, lexicon: dict[str, float]) -> list[float]:
    """The features (FEATURES) of one text; hits finds lexicon and second-person words in lower-case text."""
    if not text:
        return [0.0] * len(FEATURES)
    n = max(1, text.count(" ") + text.count("\n") + 1)
    counts = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    upper, lower, digits = counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum()
    marks = counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()
    low = text.lower()
    found = hits(low)
    own = [(at, w) for at, w in found if w in lexicon]
    you = [at for at, w in found if w in _SECOND]
    near = _nearness(low, [at for at, _ in own], you) if own and you else 0.0
    disguised = _DISGUISED(low)
    plain = sum(1 for w in disguised if w.translate(DISGUISES) in lexicon)
    total = sum(lexicon[w] for _, w in own)
    letters = max(1, upper + lower)
    return [len(own) / n, total / n, max((lexicon[w] for _, w in own), default=0.0), float(np.log1p(len(own))), float(len({w for _, w in own})), near, len(you) / n, upper / letters, marks / n, counts[33] / n, digits / n, float(plain), len(disguised) / n, float(np.log1p(n)), counts[192:].sum() / letters]


def _nearness(low: str, own: list[int], you: list[int]) -> float:
    """1 / (1 + spaces between) for the lexicon word that has fewest spaces between itself and its nearest second person.
    Both lists ascend; sorted look-ups keep texts of very many hits linear, but for a logarithm."""
    hits, places = np.array(own), np.array(you)
    right = np.searchsorted(places, hits).clip(1, max(1, len(places) - 1)) if len(places) > 1 else np.zeros(len(hits), np.int64)
    left = np.maximum(right - 1, 0)
    nearest = np.where(np.abs(places[left] - hits) <= np.abs(places[right] - hits), places[left], places[right])
    spaces = np.flatnonzero(np.frombuffer(low.encode("utf-32-le"), "<u4") == 32)
    between = np.abs(np.searchsorted(spaces, nearest) - np.searchsorted(spaces, hits))
    return 1.0 / (1 + int(between.min()))


_SECOND = frozenset(SECOND_PERSON)
_DISGUISED = re.compile(r"(?:[a-z]+[0-9@$!](?=[a-z0-9@$])|[0-9@$]+[a-z])[a-z0-9@$!]*").findall


def finder(words: list[str]):
    """A function from lower-case text to the (position, word) of whole words in it."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for w in words:
        machine.add_word(w, w)
    machine.make_automaton()

    def hits(low: str) -> list[tuple[int, str]]:
        out = []
        for end, w in machine.iter(low):
            start = end - len(w) + 1
            if (start == 0 or not low[start - 1].isalpha()) and (end + 1 == len(low) or not low[end + 1].isalpha()):
                out.append((start, w))
        return out

    return hits


def features(docs: DataFrame, lexicon: dict[str, float], text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """row, a struct of the columns `keep`, and features, an array of doubles."""
    ship(docs.sparkSession)
    row = F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row") if keep else F.lit(None).cast("int").alias("row")
    # A text that the row holds already goes to Python once.
    within = list(keep).index(text_col) if text_col in keep else None
    own = docs.select(row) if within is not None else docs.select(row, F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = finder([*lexicon, *SECOND_PERSON])
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                texts = some.column(1) if within is None else some.column(0).flatten()[within]
                rows = [_measure(t, hits, lexicon) for t in texts.to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["row", "features"])

    return own.mapInArrow(run, StructType([own.schema["row"], StructField("features", ArrayType(DoubleType()))]))


def learn_lexicon(rows: DataFrame, size: int = 200, min_docs: int = 5, min_lift: float = 4.0) -> dict[str, float]:
    """Words (and their log odds) of `rows` (text, label) that are in many more texts of label 1 than of label 0."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), F.lit(0)))
    n = rows.agg(F.sum("label").alias("bad"), F.count("*").alias("all")).first()
    bad, good = float(n["bad"] or 0), float(n["all"] - (n["bad"] or 0))
    counts = rows.select("label", F.explode(words).alias("word")).where(F.length("word") >= 3).groupBy("word").agg(F.sum("label").alias("b"), F.count("*").alias("n"))
    odds = F.log(((F.col("b") + 0.5) / (bad + 1)) / ((F.col("n") - F.col("b") + 0.5) / (good + 1)))
    # z: how far the count lies above what the word's frequency alone would give.
    z = (F.col("b") - F.col("n") * bad / max(1.0, bad + good)) / F.sqrt(F.col("n") * bad / max(1.0, bad + good) + 1)
    top = counts.where(F.col("b") >= min_docs).select("word", odds.alias("odds"), z.alias("z")).where((F.col("odds") >= float(np.log(min_lift))) & (F.col("z") >= 5)).orderBy(F.desc("z"), "word").limit(size)
    learned = {r["word"]: float(r["odds"]) for r in top.collect()}
    return {**dict.fromkeys(INSULTS, float(np.log(min_lift))), **learned}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic", *, train: Column | None = None, max_labelled: int = 20_000, trees: int = 20, depth: int = 3, lexicon_size: int = 200) -> ToxicityModel:
    """Trains on the rows of docs that have a label. train: which labels may be used, a condition on the id `doc_id`."""
    own = labels.select(F.col(label_id).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    if train is not None:
        own = own.where(train)
    n = own.count()
    if n > max_labelled:  # the rows with the smallest hashes, max_labelled of them
        own = own.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_labelled)
    # At most max_labelled rows of 12 bytes: small enough to send to every executor.
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = stored(texts.join(F.broadcast(own), "doc_id").select("doc_id", "label", "text"), "labelled")
    known = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("bad")).first()
    if known["bad"] in (0, known["n"]):
        return ToxicityModel({}, known["bad"] / known["n"] if known["n"] else 0.0)
    lexicon = learn_lexicon(rows, lexicon_size)
    table = stored(features(rows, lexicon, "text", ["doc_id", "label"]), "features").select("row.doc_id", F.col("row.label").cast("double").alias("label"), array_to_vector("features").alias("x")).repartition(4).cache()
    part = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(4))
    gbt = GBTClassifier(featuresCol="x", labelCol="label", predictionCol="predicted", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=5, maxBins=64).setProbabilityCol("probability").setRawPredictionCol("raw")
    model = gbt.fit(table.where(part != 0))
    scored = model.transform(table.where(part == 0)).select("label", vector_to_array("probability")[1].alias("p"))
    iso = IsotonicRegression(featuresCol="p", labelCol="label", predictionCol="calibrated").fit(scored) if not scored.isEmpty() else None
    table.unpersist()
    return ToxicityModel(lexicon, known["bad"] / known["n"], model, iso)


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all of docs) and toxicity, a double from 0 to 1."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != "toxicity"]
    if model.trees is None:
        return docs.select(*(F.col(f"`{c}`") for c in keep), F.lit(float(model.base)).alias("toxicity"))
    # The row travels as one struct, so its columns may have any names.
    rows = features(docs, model.lexicon, text_col, keep)
    rows = model.trees.transform(rows.withColumn("x", array_to_vector("features")))
    rows, last = rows.withColumn("p", vector_to_array("probability")[1]), "p"
    if model.calibration is not None:
        rows, last = model.calibration.transform(rows), "calibrated"
    return rows.select(*(F.col(f"row.`{c}`") for c in keep), F.least(F.greatest(F.col(last), F.lit(0.0)), F.lit(1.0)).alias("toxicity"))


def held_out(id_col: str = "doc_id") -> Column:
    """The rows that are not learned from: crc32 of the id as text, modulo 4, is 2 (never for a null id)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))

"""Language identification: words first, then backoff to shorter and shorter character n-grams.

A known word is scored by its log frequency in each language. A word that was not learned falls back to its character
n-grams of the longest order of which some are known, each with a penalty for each order given up. The model is fitted by
Spark on a bounded sample: about ``docs_per_lang`` different labelled documents of each language, taken by a hash of id and
text (all of them where a language has no more). Equal rows count once, so that neither null ids nor repeated rows change
the bound. The model holds all words and n-grams that the sample has at least ``least`` times, in whichever language: a
word seen once tells no more than its n-grams do. Only this model, which the sample bounds, is sent to the tasks.

``evidence`` tells how much of a text the model knows at all, in whichever language. ``recognised`` predicts the language of each
row as ``predict`` does, and keeps the rows in a wanted language whose score and evidence are high enough.

Defined results: a null text or one without letters is ``und`` with score 0; so is every text if nothing was learned; null
languages are not learned; ties go to the language first in alphabetical order; repeated rows each give a row; a text of any
length is scored whole, word by word; an empty table gives no rows and teaches nothing; extra columns are ignored by
``predict`` and come back from ``recognised`` as they were.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Collection, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm.common import batches, cut_lineage, python_rows

ORDERS = (4, 3, 2, 1)
#: What a word gives for each order of n-grams that it must fall back by, as in stupid backoff.
BACKOFF = math.log(0.4)

#: Words whose scores a task remembers.
CACHED = 200_000

#: Least evidence of a recognised text. Held-out documents of sf0.01 (a fifth, 189 with letters) have 0.94 or more, half
#: of them 0.999; random letters 0.03, a sentence of Polish 0.07 and of Finnish 0.40, which the test tables don't hold.
EVIDENCE = 0.5

#: Least score of a recognised text's language. Held-out documents of sf0.01 have 0.976 or more; a text of two languages in equal
#: parts has about a half.
SCORE = 0.65

_OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


_WORD = re.compile(r"[^\W\d_]+")


def _grams(word: str, n: int) -> list[str]:
    w = f"_{word}_"
    return [word] if n == 0 else [w[i : i + n] for i in range(len(w) - n + 1)]


class Rows(Mapping):
    """Rows of numbers by name: one matrix and the place of each name in it."""

    def __init__(self, index: dict[str, int], matrix: np.ndarray):
        self.index, self.matrix = index, matrix

    def __getitem__(self, name: str) -> np.ndarray:
        return self.matrix[self.index[name]]

    def __contains__(self, name: object) -> bool:
        return name in self.index

    def get(self, name: str, default=None):
        at = self.index.get(name)
        return default if at is None else self.matrix[at]

    def mean_of(self, names: list[str]) -> np.ndarray | None:
        """Mean of the rows of those names that there are."""
        at = [i for i in map(self.index.get, names) if i is not None]
        return self.matrix[at].sum(0, dtype=np.float64) / len(at) if at else None

    def __iter__(self) -> Iterator[str]:
        return iter(self.index)

    def __len__(self) -> int:
        return len(self.index)


#: Different words that a task counts before it passes them on.
HELD_WORDS = 50_000


def _count_words(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of rows (text, lang), with the counts of many rows put together."""
    words: dict[str, Counter] = {}

    def counted() -> Iterator[pa.RecordBatch]:
        for lang, c in words.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c)), pa.array(list(c)), pa.array(list(c.values()), pa.int64())], ["lang", "word", "n"])
        words.clear()

    for part in parts:
        for text, lang in python_rows(part, 64):
            words.setdefault(lang, Counter()).update(words_of(text or ""))
            if sum(map(len, words.values())) > HELD_WORDS:
                yield from counted()
    yield from counted()


def _count_grams(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, order, gram, n) of rows (lang, word, n); order 0 is whole words."""
    for part in parts:
        for i in range(0, part.num_rows, 4096):
            counts: Counter = Counter()
            for lang, word, k in python_rows(part.slice(i, 4096)):
                for n in (0, *ORDERS):
                    for g in _grams(word, n):
                        counts[lang, n, g] += k
            lang, order, gram = zip(*counts)
            yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(order, pa.int32()), pa.array(gram), pa.array(list(counts.values()), pa.int64())], ["lang", "order", "gram", "n"])


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", docs_per_lang: int = 1500, least: int = 2) -> dict:
    """The model: {"langs": [...], "grams": {order: {gram: log frequency in each language}}, "repeated": {order: grams}}.

    Order 0 is words. ``repeated`` has the words and longest n-grams that occur at least twice in the sample, so that a
    document's own noise, if it is in the sample, doesn't make it known.
    """
    rows = docs.select(F.xxhash64(id_col, text_col).alias("hash"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.countDistinct("hash").alias("n")).collect()}  # a row for each language
    langs = sorted(sizes)
    if not langs:
        return {"langs": [], "grams": {}, "repeated": {}}
    share = F.lit(0.0)
    for lang in langs:
        share = F.when(F.col("lang") == lang, min(1.0, docs_per_lang / sizes[lang])).otherwise(share)
    sample = rows.filter(F.pmod("hash", F.lit(1 << 30)) < share * float(1 << 30)).dropDuplicates(["lang", "hash"]).select("text", "lang")
    words = sample.mapInArrow(_count_words, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = words.mapInArrow(_count_grams, "lang string, order int, gram string, n bigint")
    each = [F.coalesce(F.sum(F.when(F.col("lang") == lang, F.col("n"))), F.lit(0)) for lang in langs]
    counts = cut_lineage(counts.groupBy("order", "gram").agg(F.array(*each).alias("n")))
    sums = [x for i in range(len(langs)) for x in (F.sum(F.col("n")[i]).alias(f"total{i}"), F.count_if(F.col("n")[i] > 0).alias(f"kinds{i}"))]
    size = {r["order"]: [r[f"total{i}"] + r[f"kinds{i}"] for i in range(len(langs))] for r in counts.groupBy("order").agg(*sums).collect()}
    index: dict[int, dict[str, int]] = {n: {} for n in (0, *ORDERS)}
    seen: dict[int, array] = {n: array("f") for n in index}
    for r in counts.filter(F.aggregate("n", F.lit(0).cast("bigint"), lambda a, x: a + x) >= least).toLocalIterator():
        index[r["order"]][r["gram"]] = len(index[r["order"]])
        seen[r["order"]].extend(r["n"])
    grams = {}
    for n in index:
        matrix = np.frombuffer(seen[n], np.float32).reshape(-1, len(langs)) + np.float32(0.5)
        grams[n] = Rows(index[n], np.log(matrix / np.maximum(size.get(n, [1] * len(langs)), 1)).astype(np.float32))
    return {"langs": langs, "grams": grams, "repeated": {n: frozenset(index[n]) for n in (0, ORDERS[0])}}


class Scores:
    """Sums of words' scores; the rows of up to ``CACHED`` words are remembered."""

    PIECE = 10_000

    def __init__(self, model: dict, size: int = 0):
        self.grams, self.width = model["grams"], len(model["langs"])
        self.place: dict[str, int] = {}
        self.rows = np.empty((max(size, self.PIECE), self.width))

    def total(self, words: list[str]) -> np.ndarray:
        out = np.zeros(self.width)
        for i in range(0, len(words), self.PIECE):
            out += self._piece(words[i : i + self.PIECE])
        return out

    def _piece(self, words: list[str]) -> np.ndarray:
        at = list(map(self.place.get, words))
        if None in at:
            new = {w for w, i in zip(words, at) if i is None}
            if len(self.place) + len(new) > len(self.rows):
                self.place.clear()
                new = set(words)
            for w in new:
                self.rows[len(self.place)] = _word_scores(self.grams, w, self.width)
                self.place[w] = len(self.place)
            at = list(map(self.place.__getitem__, words))
        return self.rows[at].sum(0)


def score_text(model: dict, text: str | None, scores: Scores | None = None) -> tuple[str, float]:
    """(language, share of belief in it among the learned languages)."""
    langs = model["langs"]
    words = words_of(text) if langs and text else []
    if not words:
        return "und", 0.0
    total = (Scores(model) if scores is None else scores).total(words)
    belief = np.exp((total - total.max()) / math.sqrt(len(words)))
    return langs[int(total.argmax())], float(belief.max() / belief.sum())


def _word_scores(grams: dict, word: str, n_langs: int) -> np.ndarray:
    known = grams[0].get(word)
    if known is not None:
        return np.array(known)
    for k, n in enumerate(ORDERS, 1):
        own = grams[n] if hasattr(grams[n], "mean_of") else Rows({g: i for i, g in enumerate(grams[n])}, np.array(list(grams[n].values())))
        mean = own.mean_of(_grams(word, n))
        if mean is not None:
            return mean + k * BACKOFF
    return np.zeros(n_langs)


def evidence(model: dict, text: str | None, cache: dict | None = None) -> float | None:
    """Mean over the words: 1 for a repeated word, else the share of its longest n-grams that are repeated.

    None without letters; 1 if nothing was learned, as nothing then speaks against a text.
    """
    cache, total, seen = {} if cache is None else cache, 0.0, 0
    for word in words_of(text or ""):
        own = cache.get(word)
        if own is None:
            own = cache[word] = _word_evidence(model, word)
        total += own
        seen += 1
    return total / seen if seen else None


def _word_evidence(model: dict, word: str) -> float:
    if not model["langs"] or word in model["repeated"][0]:
        return 1.0
    grams = _grams(word, ORDERS[0])
    return sum(g in model["repeated"][ORDERS[0]] for g in grams) / len(grams) if grams else 0.0


def recognised(docs: DataFrame, model: dict, least: float = EVIDENCE, text_col: str = "text", score: float = SCORE, langs: Collection[str] | None = None) -> DataFrame:
    """The rows of ``docs`` whose text is predicted to be in one of ``langs`` (None: any learned one), each judged by its own text.

    The prediction's score is at least ``score`` and the text's evidence at least ``least``. If nothing was learned, no language can
    be told, and every text with letters stays.
    """
    # The repeated words and n-grams are those that have rows, unless the model was pruned: they are sent once.
    repeated = {n: model["grams"][n] if model["grams"][n].keys() == found else found for n, found in model["repeated"].items()}
    shared = docs.sparkSession.sparkContext.broadcast({"langs": model["langs"], "grams": model["grams"], "repeated": repeated})
    place = docs.columns.index(text_col)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cache = shared.value, {}
        scores = Scores(own, CACHED)

        def stays(text: str | None) -> bool:
            known = evidence(own, text, cache)
            if known is None or known < least or not own["langs"]:
                return known is not None and known >= least
            lang, sure = score_text(own, text, scores)
            return lang != "und" and sure >= score and (langs is None or lang in langs)

        for part in parts:
            for i in range(0, part.num_rows, 512):
                some, keep = part.slice(i, 512), []
                for text in some.column(place).to_pylist():
                    if len(cache) > CACHED:
                        cache.clear()
                    keep.append(stays(text))
                yield some.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score); only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast({"langs": model["langs"], "grams": model["grams"]})

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        scores = Scores(own, CACHED)

        def rows():
            for part in parts:
                for doc_id, text in python_rows(part):
                    yield (doc_id, *score_text(own, text, scores))

        return batches(rows(), _OUT)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, lang_pred string, score double")

"""Language identification by a string kernel machine.

Texts are compared by a blended-spectrum presence kernel: the number of hashed character n-grams (n = 1 to 3) that
both hold, over the geometric mean of their own numbers.  A Nyström map to ``landmarks`` training texts and one
ridge regression per language (one against the rest) give a weight per landmark and language; a batch of texts is
scored by two matrix products, presence by landmarks and kernel by weights.

Training reads a bounded sample: ``per_language`` labelled texts of each language, in the order of a hash, the first
``MAX_CHARS`` characters of each (prediction takes whole texts).  Everything else covers all rows.

Scores rank the learned languages; those of a text add up to about one, so they cannot tell that none of them fits.
``known`` asks something else: which share of a text's three-letter runs the training texts of its predicted language
hold, against the share that these texts find among one another.  It does not depend on the number of languages.

Defined cases: a null text or one without a letter is ``und`` with score 0; without labelled rows all texts are
``und``; a null doc_id counts as held out; equal scores go to the language first in order; a very long text is
read in segments that overlap by an n-gram; extra columns stay, a clashing ``lang_pred`` or ``score`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.common import renamed, sliced

ORDERS = 3
BUCKETS = 8192
PER_LANGUAGE = 300
LANDMARKS = 128
MAX_CHARS = 10_000
RIDGE = 1e-3
BLOCK_CHARS, BLOCK_ROWS = 1 << 19, 64
RUN_BITS, PRIOR = 18, 5.0
UNKNOWN = "und"
FEW_LANGUAGES = 1000


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # landmarks x buckets, presence over the root of its sum
    weights: np.ndarray  # landmarks x languages
    offsets: np.ndarray  # per language


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that training never sees: crc32 of the id's text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _blocks(texts: list[str]) -> Iterator[list[tuple[int, str]]]:
    """(row, segment) lists of bounded length; a row's segments overlap by the longest n-gram less one."""
    block: list[tuple[int, str]] = []
    chars = 0
    for row, text in enumerate(texts):
        for at in range(0, max(1, len(text)), BLOCK_CHARS):
            segment = text[max(0, at - ORDERS + 1):at + BLOCK_CHARS]
            if block and chars + len(segment) > BLOCK_CHARS:
                yield block
                block, chars = [], 0
            block.append((row, segment))
            chars += len(segment)
    if block:
        yield block


def presence(texts: list[str]) -> np.ndarray:
    """Texts by buckets: 1 where an n-gram of the lower-cased text falls, over the root of the row's sum."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for block in _blocks([t.lower() for t in texts]):
        codes = np.frombuffer("\x00".join([s for _, s in block]).encode("utf-32-le", "surrogatepass"), "<u4")
        sizes = np.array([len(s) + 1 for _, s in block])
        rows = np.repeat(np.array([r for r, _ in block]), sizes)[:len(codes)]
        ends = np.cumsum(sizes)[:-1] - 1
        inside = np.ones(len(codes), bool)
        inside[ends] = False
        grams = np.zeros(len(codes), np.uint64)
        for n in range(1, ORDERS + 1):
            length = len(codes) - n + 1
            if length <= 0:
                break
            grams = grams[:length] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1:] + np.uint64(n)
            whole = inside[:length] & inside[n - 1:] if n == 1 else whole[:length] & inside[n - 1:]
            mixed = grams ^ (grams >> np.uint64(29))
            place = ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(51)).astype(np.int64)
            out[rows[:length][whole], place[whole]] = 1
    return out / np.sqrt(np.maximum(out.sum(1, keepdims=True), 1))


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def letter_runs(text: str) -> np.ndarray:
    """Hashed runs of three letters, one for each place; words are marked at both ends by one blank, whatever is between."""
    out, lowered, last = [], text.lower(), np.array([32], np.uint64)
    for at in range(0, len(lowered), BLOCK_CHARS):
        codes = np.frombuffer(lowered[at:at + BLOCK_CHARS].encode("utf-32-le", "surrogatepass"), "<u4")
        codes = np.concatenate([last, np.where(_letters()[codes], codes, 32).astype(np.uint64)])
        if at + BLOCK_CHARS >= len(lowered):
            codes = np.append(codes, np.uint64(32))
        codes = codes[np.append(True, (codes[1:] != 32) | (codes[:-1] != 32))]
        mixed = ((codes[:-2] << np.uint64(42)) ^ (codes[1:-1] << np.uint64(21)) ^ codes[2:]) * np.uint64(0x9E3779B97F4A7C15)
        out.append(((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - RUN_BITS))
        last = codes[-2:]
    return np.concatenate([*out, np.zeros(0, np.uint64)]).astype(np.int64)


@dataclass
class Profile:
    """Of one language: the runs its training texts hold (packed bits), and the share of a text's runs that the others
    hold, for the middle text."""

    runs: np.ndarray
    usual: float

    def share(self, text: str) -> float:
        """The share of the text's runs, times the usual one's inverse; a few runs more of the usual kind steady that of
        a short text."""
        runs = letter_runs(text)
        held = int(((self.runs[runs >> 3] >> (7 - (runs & 7)).astype(np.uint8)) & 1).sum())
        return (held + PRIOR * self.usual) / (len(runs) + PRIOR) / self.usual if self.usual else 1.0


def profiles(sample: list) -> dict[str, Profile]:
    """For each language of the training rows; repeated texts count once.  A language with one text has no usual share
    and turns nothing away."""
    out, texts = {}, {}
    for r in sample:
        texts.setdefault(r["lang"], set()).add(r["text"])
    for lang, own in texts.items():
        number, runs = np.zeros(1 << RUN_BITS, np.int32), [letter_runs(t) for t in sorted(own)]
        for r in runs:
            number[np.unique(r)] += 1
        out[lang] = Profile(np.packbits(number > 0), float(np.median([(number[r] > 1).mean() if len(r) else 1.0 for r in runs])))
    return out


def training_rows(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """The bounded sample: at most ``per_language`` rows (lang, text) of each language, none of them held out."""
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out()).select(
        "lang", "text", F.abs(F.xxhash64("doc_id", "text") % (1 << 30)).alias("h"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    few = counts.limit(FEW_LANGUAGES + 1).collect()
    if len(few) <= FEW_LANGUAGES:  # so few rows may be broadcast; more are joined as the planner likes
        counts = F.broadcast(docs.sparkSession.createDataFrame(few, counts.schema))
    near = rows.join(counts, "lang").where(  # thins the sort below
        F.col("h") * F.col("n") < F.lit((1 << 30) * 4 * (per_language + 25)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    return near.withColumn("rank", rank).where(F.col("rank") <= per_language).select(
        "lang", F.substring("text", 1, MAX_CHARS).alias("text"), "rank")


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS) -> Model | None:
    """Train on the bounded sample (on the driver: at most ``per_language`` short texts of each language)."""
    return trained(sampled(docs, per_language), landmarks)


def sampled(docs: DataFrame, per_language: int = PER_LANGUAGE) -> list:
    return [r for r in training_rows(docs, per_language).orderBy("rank", "lang").collect() if has_letter(r["text"])]


def trained(sample: list, landmarks: int = LANDMARKS) -> Model | None:
    if not sample:
        return None
    languages = sorted({r["lang"] for r in sample})
    x = presence([r["text"] for r in sample])
    marks = x[:max(landmarks, 8 * len(languages))]  # in rank order: spread over the languages
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])
    z = (x @ marks.T).astype(np.float64) @ root
    target = np.array([[1.0 if r["lang"] == c else -1.0 for c in languages] for r in sample])
    mean, offsets = z.mean(0), target.mean(0)
    centred = z - mean
    beta = np.linalg.solve(centred.T @ centred + RIDGE * len(z) * np.eye(z.shape[1]), centred.T @ (target - offsets))
    return Model(languages, marks, (root @ beta).astype(np.float32), (offsets - mean @ beta).astype(np.float32))


def scores(model: Model, texts: list[str]) -> np.ndarray:
    """Texts by languages, 0 to 1."""
    kernel = presence(texts) @ model.landmarks.T
    return np.clip((kernel @ model.weights + model.offsets + 1) / 2, 0, 1)


def predict(docs: DataFrame, model: Model | None, usual: dict[str, Profile] | None = None, least_share: float = 0) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; whole texts, no shuffle.  With profiles, texts below the share of
    their language are ``und`` as well."""
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast((model, usual))
    schema = T.StructType([*docs.schema, T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, told = shared.value
        for batch in sliced(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            names, best = [UNKNOWN] * len(texts), np.zeros(len(texts))
            letters = [i for i, t in enumerate(texts) if own is not None and has_letter(t)]
            for k in range(0, len(letters), BLOCK_ROWS):
                some = letters[k:k + BLOCK_ROWS]
                found = scores(own, [texts[i] for i in some])
                for i, c, s in zip(some, found.argmax(1), found.max(1), strict=True):
                    if told is None or told[own.languages[c]].share(texts[i]) >= least_share:
                        names[i], best[i] = own.languages[c], s
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(best)],
                                             names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(rows, schema)


def known(docs: DataFrame, least_share: float) -> DataFrame:
    """The documents in a learned language, with their own columns: not ``und``, and of the runs that a training text of
    the predicted language shares with the others usually, at least ``least_share`` times as many."""
    rows, back = renamed(docs, {"lang_pred", "score"})
    sample = sampled(docs)
    kept = predict(rows, trained(sample), profiles(sample), least_share).where(F.col("lang_pred") != UNKNOWN)
    return kept.drop("lang_pred", "score").withColumnsRenamed(back)

"""Language identification with bit-sliced Bloom filters of character n-grams.

One filter serves all languages: slot s holds a bitmask with bit l set when some n-gram of
language l hashes to s. And-ing the masks of an n-gram's slots returns every language that
contains it. Per language the hits of a text are counted over all its n-grams and corrected
for false positives, (hits - n * f) / (1 - f) with f the share of set slots to the power of
the number of probes; the largest corrected count decides, ties go to the smaller name.

Fitting looks only at text and lang of the learning rows: a bounded sample of whole texts
(of each language the ``SAMPLE_DOCS`` distinct texts with letters first by hash), whose n-grams are counted by
Spark. A language keeps its most frequent ``GRAMS`` n-grams among those that are not much
more frequent elsewhere. Prediction uses every n-gram of the whole text.

Defined results: a text that is null or has no letter is ``und`` with score 0; so is every
text if there is no learning row. Null ids are neither held out nor learnt from. Every row
is kept, repeated ids too; an empty table gives an empty result; other columns are passed through
by ``keep_identified``, where none may be named as its two own, and ignored else. Score is the winner's
corrected count over the number of n-grams, between 0 and 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, save, table

#: Documented bound of the fitting sample: distinct learning texts per language.
SAMPLE_DOCS = 1500
#: n-grams kept per language; more languages than these are refused, so the filter's size is bounded.
GRAMS, MAX_LANGUAGES = 6000, 512
ORDERS = (3, 4)
SLOT_BITS, PROBES = 18, 3
#: An n-gram belongs to a language if its share there is at least this part of its largest share.
COMMON = 0.5
CHUNK = 1 << 20
#: The pipeline rejects texts with a lower score, and texts without letters.
REJECT_BELOW = 0.2

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def grams(text: str):
    """Hashes of the n-grams of a text, chunk by chunk; runs of other characters are one blank."""
    for s in range(0, max(1, len(text)), CHUNK):
        part = text[max(0, s - max(ORDERS)) : s + CHUNK].lower()
        c = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4")
        c = np.concatenate([[0], np.where(letters()[c], c, 0), [0]]).astype(np.uint64)
        c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]
        for n in ORDERS:
            if len(c) >= n:
                h = np.full(len(c) - n + 1, n, np.uint64)
                for k in range(n):
                    h = (h ^ c[k : len(c) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(32)
                yield h


def slots(h: np.ndarray, probe: int) -> np.ndarray:
    return ((h * np.uint64((0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)[probe])) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


class LanguageFilter:
    """Bit-sliced filter; ``words`` has one uint64 mask array for every 64 languages."""

    def __init__(self, members: dict[str, np.ndarray]):
        self.languages = sorted(members)
        self.words = np.zeros((max(1, -(-len(self.languages) // 64)), 1 << SLOT_BITS), np.uint64)
        for i, name in enumerate(self.languages):
            for p in range(PROBES):
                at = slots(members[name].astype(np.uint64), p)
                self.words[i // 64, at] |= np.uint64(1) << np.uint64(i % 64)
        self.false = np.array([((self.words[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() ** PROBES for i in range(len(self.languages))])

    def masks(self, h: np.ndarray, word: int = 0) -> np.ndarray:
        """Bitmask of the languages that contain each n-gram."""
        m = self.words[word][slots(h, 0)]
        for p in range(1, PROBES):
            m &= self.words[word][slots(h, p)]
        return m

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages:
            return "und", 0.0
        hits, n, any_letter = np.zeros(len(self.languages)), 0, False
        for h in grams(text):
            n += len(h)
            for word in range(len(self.words)):
                m = self.masks(h, word)
                for i in range(64 * word, min(64 * word + 64, len(self.languages))):
                    hits[i] += np.count_nonzero(m & (np.uint64(1) << np.uint64(i % 64)))
        if not n or not any(map(str.isalpha, text)):
            return "und", 0.0
        found = (hits - n * self.false) / (1 - np.minimum(self.false, 0.999))
        best = int(found.argmax())
        return self.languages[best], float(min(1.0, max(0.0, found[best] / n)))


def learning_sample(rows: DataFrame) -> DataFrame:
    """(lang, text): of each language the SAMPLE_DOCS distinct texts with letters that are first by hash.

    Copies count once, so neither the choice nor its size depends on how often a text is repeated."""
    rows = rows.dropna().where(F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64("text").alias("h"))
    known = save(rows.select("lang", "h").distinct())
    counts = save(known.groupBy("lang").count())
    if counts.count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    # twice the sample by the hash alone, so that no task ranks a whole language
    share = F.least(F.lit(1.0), 2 * SAMPLE_DOCS / F.col("count"))
    near = known.join(F.broadcast(counts), "lang").where((F.col("count") <= 2 * SAMPLE_DOCS) | (F.col("h").cast("double") <= (2 * share - 1) * 2.0**63))
    rank = Window.partitionBy("lang").orderBy("h")
    first = save(near.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= SAMPLE_DOCS).select("lang", "h"))
    return rows.join(F.broadcast(first), ["lang", "h"]).groupBy("lang", "h").agg(F.first("text").alias("text")).select("lang", "text")


def fit(learning: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageFilter:
    """Fits on a bounded sample; only n_languages * GRAMS n-grams reach the driver."""
    sample = learning_sample(learning.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")))

    def count(batches):
        for b in batches:
            names, found, n = [], [], []
            by: dict[str, list] = {}
            for lang, text in zip(b["lang"].to_pylist(), b["text"].to_pylist(), strict=True):
                by.setdefault(lang, []).extend(np.unique(h, return_counts=True) for h in grams(text))
            for lang, parts in by.items():
                keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True) if parts else (np.empty(0, np.uint64), [])
                names += [lang] * len(keys)
                found.append(keys.view(np.int64))
                n.append(np.bincount(at, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64) if parts else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(found) if found else [], pa.int64()), pa.array(np.concatenate(n) if n else [], pa.int64())], ["lang", "gram", "n"])

    table_ = save(sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    total = table_.groupBy("lang").agg(F.sum("n").alias("total"))
    part = table_.join(F.broadcast(total), "lang").withColumn("part", F.col("n") / F.col("total"))
    top = part.groupBy("gram").agg(F.max("part").alias("most"))
    kept = part.join(top, "gram").where(F.col("part") >= COMMON * F.col("most"))
    rank = Window.partitionBy("lang").orderBy(F.desc("part"), "gram")
    kept = kept.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= GRAMS).select("lang", "gram")
    members = kept.toPandas()  # bounded: MAX_LANGUAGES * GRAMS rows
    return LanguageFilter({k: g["gram"].to_numpy(np.int64) for k, g in members.groupby("lang")})


def predict(docs: DataFrame, model: LanguageFilter, keep: list[str], text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` with the predicted language and its score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            found = [shared.value.predict(t.as_py()) for t in b[text_col]]
            more = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), *more], [*keep, *names])

    columns = list(dict.fromkeys([*keep, text_col]))
    types = dict(docs.dtypes)
    return docs.select(*columns).mapInArrow(run, ", ".join([f"`{c}` {types[c]}" for c in keep] + [f"{names[0]} string", f"{names[1]} double"]))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score."""
    model = fit(docs.where(F.col(id_col).isNotNull() & ~held_out(id_col)))
    found = predict(docs, model, [id_col])
    return found.select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows whose language is recognised; columns as they came."""
    model = fit(docs.where(F.col("doc_id").isNotNull() & ~held_out()) if "doc_id" in docs.columns else docs)
    names = (free_name(docs.columns, "lang_pred"), free_name(docs.columns, "score"))
    found = predict(docs, model, docs.columns, names=names)
    return found.where((F.col(names[0]) != "und") & (F.col(names[1]) >= REJECT_BELOW)).select(*docs.columns)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))

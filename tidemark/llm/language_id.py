"""Language identification by nearest centroids.

A text's vector holds its hashed byte trigrams (of the lower-cased text, with everything but letters as blanks),
weighted (1 + log tf) * idf and scaled to length 1. Each language has several centroids, found by spherical k-means
over its sample. A text gets the language of the centroid with the largest cosine; that cosine is the score. The
text is *rejected* if the cosine lies below the language's floor for texts of its length. Cosines grow with length, so
there is a floor for each doubling of the number of trigrams. Floors come from a quarter of the sample that the centroids
don't learn from: the cosines of its texts, and of cuts of them, have a median m in each band and 16 of 100 below q; the
floor is m - ``SPREADS`` * (m - q). Junk in the sample hardly moves these two. Texts that repeat a few words, are in
another script or of random letters lie far below it.

The model is fitted on at most ``per_language`` labelled ids of each language, chosen by a hash of the id, so the
sample is bounded (``SAMPLE``) and does not depend on the order of rows; of rows with one id one text is taken.
Prediction reads the text alone.

Null texts, and texts without a letter, get ``und``, score 0 and are rejected. Very long texts are counted whole. Rows with
a null language are not learnt from; without any labelled row every text is ``und``. Rows are independent, so repeated
rows and ties between ids do not matter; equal cosines go to the language that sorts first. Clashing columns are replaced.
An empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.shared import stored
from tidemark.llm.words import extended, slices

UNKNOWN = "und"
#: Labelled rows of a language that a model is fitted on.
SAMPLE = 384
CENTROIDS = 4
_BITS = 14
DIMENSIONS = 1 << _BITS
#: How many spreads below the median of its language and length a text is rejected, and the least spread.
SPREADS, LEAST_SPREAD = 5.0, 0.04
#: Floors for less than 2, 4, 8, ... trigrams; longer texts have the last one. A band's floor needs so many held-out cuts.
BANDS, CUTS = 24, 16
_BLANKS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def trigram_counts(text: str) -> np.ndarray:
    raw = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "surrogatepass").translate(_BLANKS), np.uint8)
    if len(raw) < 3:
        return np.zeros(DIMENSIONS, np.int64)
    code = raw[:-2].astype(np.uint32)
    code <<= np.uint32(8)
    code |= raw[1:-1]
    code <<= np.uint32(8)
    code |= raw[2:]
    code = code[code != 0x202020]
    code *= np.uint32(2654435761)
    code >>= np.uint32(32 - _BITS)
    return np.bincount(code, minlength=DIMENSIONS)


def unit_vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(counts)
    x = np.zeros(DIMENSIONS, np.float32)
    x[at] = (1 + np.log(counts[at])) * idf[at]
    norm = np.sqrt(np.dot(x, x))
    return x / norm if norm else x


@dataclass
class LanguageModel:
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    floors: np.ndarray  # of each centroid and band
    idf: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if text is None or not len(self.languages) or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        counts = trigram_counts(text)
        cosines = self.centroids @ unit_vector(counts, self.idf)
        best = int(np.argmax(cosines))
        score = float(min(1.0, max(0.0, cosines[best])))
        return self.languages[best], score, bool(score < self.floors[best, band(counts)])


def band(counts: np.ndarray) -> int:
    return min(int(counts.sum()).bit_length(), BANDS - 1)


def cuts(text: str) -> list[str]:
    """The text, and from its start and its middle cuts of 16, 32, ... characters."""
    sizes = [1 << k for k in range(4, BANDS) if 1 << k < len(text)]
    return [text] + [text[at : at + n] for n in sizes for at in (0, len(text) // 2) if len(text) - at >= n]


def floors_of(bands: np.ndarray, cosines: np.ndarray) -> np.ndarray:
    """The floor of each band; bands with few cuts have that of the band before."""
    out, floor = np.zeros(BANDS), 0.0
    for b in range(BANDS):
        own = cosines[bands == b]
        if len(own) >= CUTS:
            middle, low = np.quantile(own, (0.5, 0.16))
            floor = max(0.0, middle - SPREADS * max(middle - low, LEAST_SPREAD))
        out[b] = floor
    return out


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of unit rows; starts from rows spread by farthest-first choice, so it has no random part."""
    mean = x.mean(0)
    chosen = [int(np.argmax(x @ mean))]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argmin((x @ x[chosen].T).max(1))))
    centres = x[chosen]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(1)
        sums = np.stack([x[own == i].sum(0) if (own == i).any() else centres[i] for i in range(len(centres))])
        new = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, centres, atol=1e-6):
            break
        centres = new
    # A centroid of a few odd rows would speak for noise; it is dropped unless it is the only one.
    size = np.bincount((x @ centres.T).argmax(1), minlength=len(centres))
    solid = size >= max(2, 0.02 * len(x))
    return centres[solid] if solid.any() else centres


def sample_rows(rows: DataFrame, per_language: int, lang: str, row_id: str) -> DataFrame:
    """About per_language ids of each language: the lowest hashes in each of 16 buckets, so that no task holds all rows
    of a language."""
    h = F.xxhash64(F.col(row_id).cast("string"))
    bucket = Window.partitionBy(lang, F.pmod(h, F.lit(16))).orderBy(h, row_id)
    ranked = rows.select(row_id, lang).withColumn("_r", F.row_number().over(bucket))
    return ranked.where(F.col("_r") <= -(-per_language // 16)).select(row_id).distinct()


def fit(
    rows: DataFrame,
    per_language: int = SAMPLE,
    centroids: int = CENTROIDS,
    text: str = "text",
    lang: str = "lang",
    row_id: str = "doc_id",
) -> LanguageModel:
    """Learns from rows with a text, an id and a language."""
    rows = rows.select(row_id, lang, text).where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(row_id).isNotNull())
    ids = sample_rows(rows, per_language, lang, row_id)
    # At most per_language + 15 ids a language, one text each: bounded by the sample, whatever the table's size.
    sampled = rows.join(F.broadcast(ids), row_id).groupBy(F.col(row_id).alias("id"), F.col(lang).alias("lang")).agg(F.min(text).alias("text"))
    sampled = sampled.select("lang", "text", (F.pmod(F.xxhash64(F.lit(3), F.col("id").cast("string")), F.lit(4)) == 0).alias("held"))

    def count(batches):
        for part in slices(batches, 64):
            rows = []
            for lang, text, held in zip(*(part.column(c).to_pylist() for c in ("lang", "text", "held")), strict=True):
                for k, own in enumerate(cuts(text)):
                    counts = trigram_counts(own)
                    at = np.flatnonzero(counts)
                    rows.append((lang, held, k == 0, at.astype(np.int32), counts[at].astype(np.int32)))
            kinds = (pa.string(), pa.bool_(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in rows], k) for i, (c, k) in enumerate(zip(("lang", "held", "whole", "at", "n"), kinds, strict=True))})

    sparse = stored(sampled.mapInArrow(count, "lang string, held boolean, whole boolean, at array<int>, n array<int>"), "language-sample")
    learnt = sparse.where("whole AND NOT held")
    total = learnt.count()
    df = np.zeros(DIMENSIONS)
    for at, n in learnt.select(F.explode("at").alias("at")).groupBy("at").count().collect():
        df[at] = n
    idf = (np.log((1 + total) / (1 + df)) + 0.05).astype(np.float32)

    def vectors(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        x, bands = np.zeros((len(group), DIMENSIONS), np.float32), np.zeros(len(group), int)
        for i, (at, n) in enumerate(zip(group["at"], group["n"], strict=True)):
            counts = np.zeros(DIMENSIONS, np.int64)
            counts[np.asarray(at, np.int64)] = n
            x[i], bands[i] = unit_vector(counts, idf), band(counts)
        return x, bands

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        own = group[group["whole"] & ~group["held"]]
        centres = spherical_kmeans(vectors(own if len(own) else group[group["whole"]])[0], centroids)
        # Where too few rows are held out, the floors come from all of them.
        tested = group[group["held"]] if (group["held"] & group["whole"]).sum() >= CUTS else group
        seen, cosines = [], []
        for start in range(0, len(tested), 256):
            x, bands = vectors(tested[start : start + 256])
            seen.append(bands)
            cosines.append((x @ centres.T).max(1))
        floors = floors_of(np.concatenate(seen), np.concatenate(cosines)).tolist()
        return pd.DataFrame({"lang": group["lang"].iloc[0], "floors": [floors] * len(centres), "v": list(map(bytes, centres.astype("<f4")))})

    found = sparse.groupBy("lang").applyInPandas(cluster, "lang string, floors array<double>, v binary").collect()
    found.sort(key=lambda r: (r["lang"], bytes(r["v"])))
    vectors_ = [np.frombuffer(r["v"], "<f4") for r in found]
    return LanguageModel(
        [r["lang"] for r in found],
        np.stack(vectors_) if found else np.zeros((0, DIMENSIONS), np.float32),
        np.array([r["floors"] for r in found]).reshape(-1, BANDS),
        idf,
    )


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Adds lang_pred, score and rejected. The model (a few centroids of 16,384 numbers a language) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("lang_pred", "score", "rejected")
    schema = extended(kept.schema, "lang_pred string, score double, rejected boolean")

    def run(batches):
        own = shared.value
        for part in slices(batches):
            found = [own.predict(t) for t in part.column(text).to_pylist()]
            new = {n: pa.array([f[i] for f in found], k) for i, (n, k) in enumerate((("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())))}
            yield pa.RecordBatch.from_pydict({n: part.column(n) for n in part.schema.names} | new)

    return kept.mapInArrow(run, schema)


def held_out(row_id: str = "doc_id") -> Column:
    """Whether a row is kept from learning; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(row_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))

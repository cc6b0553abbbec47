"""Language identification by nearest centroid.

A text is the TF-IDF vector of its letter n-grams, hashed into a fixed number of dimensions and brought to unit
length. Each language has several centroids, clustered from its labelled texts; the nearest by cosine gives the
language, and a text too far from all centroids is rejected.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labelled rows that a fit sees at most (those of the least hash), dimensions, centroids per language.
MAX_LABELLED, DIMENSIONS, CENTROIDS = 2500, 4096, 4
#: A text is rejected where its cosine is below this part of the median of the training texts of about its length, which the fit holds
#: out of its centroids: one in HELD_OUT. A median isn't moved by the odd texts among them. Lengths count in powers of two up to
#: 2 ** (BANDS - 1) letters; a band is told by BAND_ROWS texts at least, or by those of the shorter bands with it.
REJECT_PART, HELD_OUT, BANDS, BAND_ROWS = 0.5, 4, 13, 15
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
#: ASCII bytes that aren't letters become spaces; others are kept.
_TABLE = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def counts(text: str | None, dims: int = DIMENSIONS) -> np.ndarray | None:
    """Hashed counts of the byte 2-, 3- and 4-grams of the lower-cased whole text; None if it has no letter."""
    if not text or not _LETTER.search(text):
        return None
    raw = b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_TABLE).split()) + b" "
    out = np.zeros(dims, np.int64)
    for at in range(0, len(raw), 1 << 20):  # a long text in runs that overlap by three bytes
        b = np.frombuffer(raw[at : at + (1 << 20) + 3], np.uint8).astype(np.uint32)
        two = b[:-1] * np.uint32(257) + b[1:]
        grams = [two[: 1 << 20]]
        if len(b) > 2:
            three = two[:-1] * np.uint32(263) + b[2:]
            grams.append(three[: 1 << 20])
            if len(b) > 3:
                grams.append((three[:-1] * np.uint32(269) + b[3:])[: 1 << 20])
        for g in grams:
            out += np.bincount((g * np.uint32(2654435761)) >> np.uint32(20) & np.uint32(dims - 1), minlength=dims)
    return out


def weigh(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(c) * idf
    return (v / max(np.linalg.norm(v), 1e-12)).astype(np.float32)


@dataclass(frozen=True)
class Model:
    """Unit centroids, the language of each, idf weights and the least cosine that is accepted in each band of lengths."""

    langs: tuple[str, ...]
    owner: np.ndarray
    centroids: np.ndarray
    idf: np.ndarray
    least: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, cosine in 0..1, rejected)."""
        c = counts(text, len(self.idf))
        if c is None or not self.langs:
            return UNKNOWN, 0.0, True
        cosines = self.centroids @ weigh(c, self.idf)
        best = int(np.argmax(cosines))
        score = float(min(1.0, max(0.0, cosines[best])))
        lang = int(self.owner[best])
        return self.langs[lang], score, score < self.least[band(c)]


def band(c: np.ndarray) -> int:
    """Band of a text by its number of grams, about three a letter."""
    return min(BANDS - 1, max(0, int(c.sum()) // 3).bit_length())


def least_cosines(bands: np.ndarray, cosines: np.ndarray) -> np.ndarray:
    """What a text of each band must reach. It doesn't fall as texts get longer; a band without texts takes the one below."""
    out, from_band = np.zeros(BANDS), 0
    for b in range(BANDS):
        own = cosines[(bands >= from_band) & (bands <= b)]
        told = out[b - 1] if b else 0.0
        if len(own) >= BAND_ROWS:
            told, from_band = max(told, REJECT_PART * float(np.median(own))), b + 1
        out[b] = told
    return out


def _cluster(v: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    k = min(k, len(v))
    centers = v[rng.choice(len(v), k, replace=False)].astype(np.float64)
    for _ in range(rounds):
        near = np.argmax(v @ centers.T, axis=1)
        for j in range(k):
            own = v[near == j]
            if len(own):
                mean = own.mean(axis=0)
                centers[j] = mean / max(np.linalg.norm(mean), 1e-12)
    return centers.astype(np.float32)


def fit(labelled: DataFrame, limit: int = MAX_LABELLED, dims: int = DIMENSIONS, k: int = CENTROIDS, seed: int = 0) -> Model:
    """Learns from ``labelled`` (doc_id, text, lang); null texts and languages are left out.

    At most ``limit`` rows are used: of every language in turn the row of the least hash of doc_id, so that a rare language isn't
    missed. Their vectors (dims bytes and more each) are what the driver gathers. Of a repeated doc_id the rows that come first by
    language and text count.
    """
    usable = labelled.where("lang is not null and text is not null and doc_id is not null")
    # ``limit`` languages at most. Rows of a hash so low that about twice the limit of a language have it are put in order, however many there are.
    known = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(limit)
    low = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)).cast("double") * F.col("n") < float(2 * limit) * (1 << 40)
    some = usable.select("doc_id", "lang").join(F.broadcast(known), "lang").where(low)
    turn = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = some.select("doc_id", "lang", turn.alias("turn")).orderBy("turn", "lang").limit(limit).select("doc_id").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, g, c) for d, g, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) if (c := counts(t, dims)) is not None]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": [r[0] for r in rows], "lang": [r[1] for r in rows], "c": [zlib.compress(np.minimum(r[2], 0xFFFFFFFF).astype("<u4").tobytes(), 1) for r in rows]},
                schema=pa.schema({"doc_id": pa.int64(), "lang": pa.string(), "c": pa.binary()}),
            )

    rows = (
        usable.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
        .join(F.broadcast(chosen), "doc_id", "left_semi")  # ``limit`` ids at most
        .mapInArrow(run, "doc_id long, lang string, c binary")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "lang", "c")
        .limit(limit)
        .toPandas()
    )
    langs = tuple(sorted(rows["lang"].unique()))
    if not langs:
        return Model((), np.zeros(0, int), np.zeros((0, dims), np.float32), np.ones(dims), np.zeros(BANDS))
    c = np.stack([np.frombuffer(zlib.decompress(x), "<u4") for x in rows["c"]])
    idf = np.log((1 + len(c)) / (1 + (c > 0).sum(axis=0))) + 1
    v = np.stack([weigh(x, idf) for x in c])
    rng, owner, centers, bands, cosines = np.random.default_rng(seed), [], [], [], []
    lengths = np.array([band(x) for x in c])
    for i, lang in enumerate(langs):
        at = np.flatnonzero((rows["lang"] == lang).to_numpy())
        held = np.arange(len(at)) % HELD_OUT == HELD_OUT - 1
        found = _cluster(v[at[~held]], k, rng)
        centers.append(found)
        owner += [i] * len(found)
        bands.append(lengths[at[held]])
        cosines.append((v[at[held]] @ found.T).max(axis=1))
    return Model(langs, np.array(owner), np.concatenate(centers), idf, least_cosines(np.concatenate(bands), np.concatenate(cosines)))


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of ``docs`` doc_id and text, with lang_pred, score and rejected.

    Nulls and texts without a letter are ``und``, score 0, rejected. Repeated rows each give a row; ties between
    centroids fall to the first language; long texts are read whole. Empty table: no rows. Other columns are ignored.
    """
    # Some centroids of fixed size: the model is bounded by its parameters.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in text], columns=["lang_pred", "score", "rejected"])

    return docs.withColumn("lid", predict("text"))


def held_out() -> Column:
    """Whether a row is kept from learning: crc32 of doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """Fit on the rows that aren't held out and predict all: doc_id, held_out, lang_pred, score, rejected."""
    model = fit(docs.where(~held_out()), limit)
    return classify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out().alias("held_out"), "lid.lang_pred", "lid.score", "lid.rejected"
    )


def keep(docs: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, with all their columns; the model is learned as in :func:`identify`."""
    model = fit(docs.where(~held_out()), limit)
    held = docs.select(F.struct(*(F.col(c).alias(c) for c in docs.columns)).alias("row"), F.col("text"))
    return classify(held, model).where(~F.col("lid.rejected")).select("row.*")

"""Language identification by sparse multinomial logistic regression (operator 9).

Features are the TF-IDF of hashed character 1-, 2- and 3-grams of the lower-cased letters. Document frequencies come
from all documents that may be learned from; the regression is fitted with follow-the-regularised-leader (proximal, per
coordinate, with L1 and L2 penalties) on a bounded sample (SAMPLE documents in all, evenly over the languages, chosen by
the hash of the id; fewer if their n-grams are more than SAMPLE_GRAMS), and its temperature is set on a part of the
sample that the fit hasn't seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import cut, strings, table
from tessella.llm.toxicity import held_out

HELD_OUT, HELD_REST = 4, 2
SAMPLE = 4000
#: Distinct n-grams of all documents of the sample together, at most: 8 bytes each on the driver.
SAMPLE_GRAMS = 12_000_000
SIZE = 1 << 16
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 0.02, 0.001
CHUNK = 1 << 20
UNKNOWN = "und"


def letters_of(text: str) -> np.ndarray:
    """Code points of the lower-cased text; 0 stands for each run of others than letters."""
    low = text.lower()
    codes = np.frombuffer(low.encode("utf-32-le", "replace"), "<u4")
    if not len(codes):
        return codes
    is_letter = np.zeros(int(codes.max()) + 1, bool)
    here = np.unique(codes)
    is_letter[here] = [chr(c).isalpha() for c in here.tolist()]
    codes = np.where(is_letter[codes], codes, 0)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] > 0) | (codes[:-1] > 0)
    return codes[keep]


def gram_counts(text: str) -> np.ndarray | None:
    """Counts of the hashed n-grams, SIZE long; None if the text has no letter."""
    codes = letters_of(text)
    if not codes.any():
        return None
    x = np.concatenate([[0], codes, [0]]).astype(np.uint32)
    counts = np.zeros(SIZE, np.int64)
    for low in range(0, len(x), CHUNK):
        part = x[low : low + CHUNK + 2]
        grams = part * np.uint32(0x9E3779B1)
        for n in (1, 2, 3):
            if n > 1:
                grams = (grams[:-1] ^ (grams[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + part[n - 1 :] * np.uint32(0xC2B2AE3D)
            fresh = grams[: max(0, min(len(grams), CHUNK))]
            counts += np.bincount((fresh >> np.uint32(16)).astype(np.int64), minlength=SIZE)
    return counts


def weigh_at(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the unit-length TF-IDF vector of the n-grams ``at`` with their counts."""
    values = (1 + np.log(counts)) * idf[at]
    return at, values / max(1e-12, float(np.sqrt((values * values).sum())))


def weigh(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(counts)
    return weigh_at(at, counts[at], idf)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs, df = 0, np.zeros(SIZE, np.int64)
    for batch in batches:
        for text in strings(batch.column(0)):
            counts = gram_counts(text)
            if counts is not None:
                df += counts > 0
                docs += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, SIZE)), pa.array(np.append(df[at], docs))], ["gram", "n"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, text, place in zip(batch.column(0).to_pylist(), strings(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            counts = gram_counts(text)
            if counts is not None:
                at = np.flatnonzero(counts)
                columns = [pa.array([lang]), pa.array([place]), pa.array([at.astype(np.int32)], pa.list_(pa.int32())), pa.array([counts[at].astype(np.int32)], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "place", "at", "n"])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def _ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> np.ndarray:
    z, n = np.zeros((SIZE + 1, classes)), np.zeros((SIZE + 1, classes))  # the last row is the constant

    def weights(at: np.ndarray) -> np.ndarray:
        pull = np.sign(z[at]) * np.maximum(np.abs(z[at]) - L1, 0)
        return -pull / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            at, values, label = rows[i]
            at, values = np.append(at, SIZE), np.append(values, 1.0)
            w = weights(at)
            p = _softmax(values @ w)
            p[label] -= 1
            g = values[:, None] * p[None, :]
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    return weights(np.arange(SIZE + 1))


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least cross-entropy, from a fixed grid; 1 without rows."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        x = logits / t
        x = x - x.max(1, keepdims=True)
        return float((np.log(np.exp(x).sum(1)) - x[np.arange(len(labels)), labels]).mean())

    return min((float(t) for t in np.geomspace(0.05, 5, 60)), key=loss)


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE, grams: int = SAMPLE_GRAMS) -> dict:
    """The model. Reads text and lang of documents that aren't held out and have a language, nothing else."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.filter("lang is not null").filter(~held_out(F.col("doc_id"), HELD_OUT, HELD_REST))
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return {"langs": [], "idf": np.zeros(SIZE), "w": np.zeros((SIZE + 1, 1)), "t": 1.0}
    rows = known.select("text").mapInArrow(_frequencies, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    at, n = rows["gram"].to_numpy(), rows["n"].to_numpy()
    df, total = np.zeros(SIZE), int(n[at == SIZE].sum())
    df[at[at < SIZE]] = n[at < SIZE]
    idf = np.log((1 + total) / (1 + df)) + 1
    each = max(1, sample // len(langs))
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, each / sizes[k])))])[F.col("lang")]
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    chosen = known.filter(place < share).select("lang", "text", (place / share).alias("place"))
    chosen = cut(chosen.mapInArrow(_vectors, "lang string, place double, at array<int>, n array<int>"))
    held = chosen.agg(F.sum(F.size("at"))).first()[0] or 0
    chosen = chosen.filter(F.col("place") < min(1.0, grams / max(held, 1))).toArrow()
    index = {k: i for i, k in enumerate(langs)}
    data = []
    for batch in chosen.to_batches():
        for i in range(batch.num_rows):
            at, values = weigh_at(batch.column(2)[i].values.to_numpy(), batch.column(3)[i].values.to_numpy(), idf)
            data.append((at, values.astype(np.float32), index[batch.column(0)[i].as_py()]))
    data.sort(key=lambda r: (len(r[0]), float(r[1].sum()), r[2]))  # the same order however the rows arrive
    aside = [r for i, r in enumerate(data) if i % 5 == 4]
    w = _ftrl([r for i, r in enumerate(data) if i % 5 != 4], len(langs))
    logits = np.array([v @ w[a] + w[SIZE] for a, v, _ in aside])
    return {"langs": langs, "idf": idf.astype(np.float32), "w": w.astype(np.float32), "t": _temperature(logits, np.array([r[2] for r in aside]))}


def identify(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    Texts without a letter (null and empty ones) are ``und`` with score 0, and so is every text under a model that has
    learned no language. Texts of any length are read whole. Of languages with the same score the first by name is said.
    Rows that repeat a doc_id are judged each for itself; a null doc_id stays null and isn't held
    out. An empty table gives an empty result; other columns are ignored.
    """
    langs, idf, w, t = model["langs"], model["idf"], model["w"], model["t"]
    sent = docs.sparkSession.sparkContext.broadcast((idf, w))  # SIZE floats and SIZE x languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, w = sent.value
        for batch in batches:
            said, scores = [], []
            for value in strings(batch.column(1)):
                counts = gram_counts(value) if langs else None
                if counts is None:
                    said.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                at, values = weigh(counts, idf)
                p = _softmax((values @ w[at] + w[SIZE]) / t)
                said.append(langs[int(p.argmax())])
                scores.append(float(p.max()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return rows.select("doc_id", held_out(F.col("doc_id"), HELD_OUT, HELD_REST).alias("held_out"), "lang_pred", "score")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))

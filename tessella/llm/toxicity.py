"""Toxicity by noisy-channel deobfuscation (operator 2).

Obfuscated words (leetspeak, letters spaced out or parted by signs, repeated letters) are character lattices. A Viterbi
search under a character trigram model of the corpus picks the reading, and the restored text is scored. Words without
anything to decode have one reading only and skip the search; each distinct word is decoded once per task.

The character model counts the trigrams of all documents, over the letters of every script below LAST (ideographs and
syllables beyond are one letter: they are words by themselves). A token of digits alone is a number. The scorer is fitted on a bounded sample of labelled rows
(SAMPLE per class, by the hash of the id), of which near copies are left out: words and word beginnings whose toxic
share is significant, and a logistic regression on how many and how heavy those of a text are.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessella.llm.common import cut, strings, table

#: Labelled rows of each class to fit on, at most.
SAMPLE = 4000
HELD_OUT = 5
#: A feature needs so many toxic sample documents, and such a lower bound of its log odds ratio.
LEAST_DOCS = 6
LEAST_ODDS = 1.5
PREFIXES = (4, 5, 6)
#: Code points with letters of their own, and ids that are counted in a dense table.
LAST, DENSE = 0x3040, 128
#: Trigrams kept are those of at least this share of all: a million at most.
LEAST_SHARE = 1e-6
MEMO = 400_000
#: Readings of signs as letters. Fixed values of leetspeak.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "#": "h", "*": "aeiou",
}
#: Channel costs in nats. A letter costs the character model some 2.5 nats, so a sign that can stand for a letter is read
#: as one at a discount, and to drop it is dear; a sign that can't is dropped or parts words.
READ, VOWEL, LOSE, PART, DROP, ONCE, TWICE = -1.5, 0.0, 4.0, 1.5, 0.7, 0.3, 0.5


def _letters() -> np.ndarray:
    """Character to id: 0 parts words, the last id is that of all from LAST on."""
    ids, out = {}, np.zeros(LAST + 1, np.int64)
    for c in range(LAST):
        low = chr(c).lower()
        if chr(c).isalpha() and len(low) == 1 and ord(low) < LAST:
            out[c] = ids.setdefault(low, len(ids) + 1)
    out[LAST] = len(ids) + 1
    return out


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    letters, dense = _letters(), np.zeros(DENSE**3, np.int64)
    size_ = int(letters[LAST]) + 1
    held: list[str] = []
    sparse = (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def add(text: str) -> None:
        nonlocal sparse
        codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
        x = np.concatenate([[0, 0], letters[np.minimum(codes, LAST)], [0]])
        a, b, c = x[:-2], x[1:-1], x[2:]
        a = np.where(b == 0, 0, a)
        keep = (b > 0) | (c > 0)
        if x.max() >= DENSE:
            rare = keep & (np.maximum(np.maximum(a, b), c) >= DENSE)
            keys, n = np.unique((a[rare] * size_ + b[rare]) * size_ + c[rare], return_counts=True)
            keys, place = np.unique(np.concatenate([sparse[0], keys]), return_inverse=True)
            sparse = keys, np.bincount(place, weights=np.concatenate([sparse[1], n]), minlength=len(keys)).astype(np.int64)
            keep &= ~rare
        dense[:] += np.bincount(((a * DENSE + b) * DENSE + c)[keep], minlength=len(dense))

    size = 0
    for batch in batches:
        for text in strings(batch.column(0)):
            held.append(text)
            size += len(text)
            if size > 2_000_000:
                add(" ".join(held))
                held, size = [], 0
    if held:
        add(" ".join(held))
    at = np.flatnonzero(dense)
    a, b, c = at // DENSE**2, at // DENSE % DENSE, at % DENSE
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([(a * size_ + b) * size_ + c, sparse[0]])), pa.array(np.concatenate([dense[at], sparse[1]]))], ["gram", "n"])


def character_model(docs: DataFrame, text: str = "text") -> dict[int, float]:
    """Trigram to its cost in nats, interpolated with bigrams and single characters.

    Unseen trigrams cost what their last two characters do, under the key -2 less those; -1 is the cost of the rest.
    """
    counts = cut(docs.select(F.col(text).cast("string").alias("text")).mapInArrow(_trigrams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.filter(F.col("n") >= LEAST_SHARE * total).toArrow()  # 1 / LEAST_SHARE of them at most, whatever the corpus
    size = int(_letters()[LAST]) + 1
    grams, n = rows["gram"].to_numpy(), rows["n"].to_numpy().astype(float)

    def sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys, their sums, and each key's sum."""
        found, place = np.unique(keys, return_inverse=True)
        summed = np.bincount(place, weights=counts, minlength=len(found))
        return found, summed, summed[place]

    pairs, seen, _ = sums(grams % size**2, n)
    first, last = sums(pairs // size, seen)[2], sums(pairs % size, seen)[2]
    pair = 0.2 * seen / np.maximum(first, 1) + 0.05 * last / max(1.0, float(seen.sum()))
    p = 0.75 * n / np.maximum(sums(grams // size, n)[2], 1) + pair[np.searchsorted(pairs, grams % size**2)]
    costs = {-1: 14.0} | dict(zip((-2 - pairs).tolist(), (-np.log(pair)).tolist(), strict=True))
    return costs | dict(zip(grams.tolist(), (-np.log(p)).tolist(), strict=True))


class Decoder:
    """Restores words under a character model."""

    def __init__(self, model: dict[int, float]) -> None:
        self.cost, self.unseen = model, model[-1]
        letters = _letters()
        self.other, self.size = int(letters[LAST]), int(letters[LAST]) + 1
        self.id = {chr(c): int(letters[c]) for c in np.flatnonzero(letters[:LAST]).tolist()}

    def options(self, c: str, run: int) -> list[tuple[str, float]]:
        """Readings of a run of one character, with their channel costs. A blank parts words."""
        if c.isalpha():
            return [(c, 0.0)] if run == 1 else [(c * 2, 0.0), (c, TWICE)] if run == 2 else [(c, ONCE), (c * 2, TWICE)]
        if c == " ":
            return [(" ", PART), ("", 0.0)]
        price = VOWEL if c == "*" else READ
        out = [(x, price) for x in LEET.get(c, "")] + ([(" ", LOSE), ("", LOSE)] if c in LEET else [(" ", PART), ("", DROP)])
        return out + [(2 * x, price + TWICE) for x in LEET.get(c, "") if run == 2]

    def step(self, a: int, b: int, reading: str) -> tuple[float, int, int]:
        """The character model's cost of ``reading`` after the ids a and b, and the last two ids."""
        cost, size, costs = 0.0, self.size, self.cost
        for ch in reading:
            c = 0 if ch == " " else self.id.get(ch, self.other)
            if c or b:
                known = costs.get((a * size + b) * size + c)
                cost += costs.get(-2 - (b * size + c), self.unseen) if known is None else known
            a, b = (b, c) if c else (0, 0)
        return cost, a, b

    def cheapest(self, raw: str) -> tuple[float, str]:
        """The cost and the text of the cheapest reading of ``raw``, which is lower-case. Its length costs time in proportion:
        the states are the last two letters, and a state remembers its way as a chain of readings."""
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        units = [(m[0][0], len(m[0])) for m in re.finditer(r"(.)\1*", raw, re.DOTALL)]
        for c, run in [*units, (" ", 0)]:
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            options = self.options(c, run) if run else [(" ", 0.0)]
            for (a, b), (spent, way) in best.items():
                for reading, price in options:
                    cost, x, y = self.step(a, b, reading)
                    cost += spent + price
                    if (x, y) not in after or cost < after[x, y][0]:
                        after[x, y] = (cost, (reading, way))
            best = after
        cost, way = min(best.values(), key=lambda found: found[0])
        said = []
        while way:
            said.append(way[0])
            way = way[1]
        return cost, "".join(reversed(said))

    def restore(self, raw: str) -> list[str]:
        """The words of the cheapest reading of ``raw``, which is lower-case."""
        return self.cheapest(raw)[1].split()


_EDGES = ".,;:?\"'()[]{}<>«»“”„…¡¿#%&^~=/\\`´"
_PLAIN = re.compile(r"[^\W\d_]+").fullmatch
_RUN = re.compile(r"(.)\1").search
_SPACED = re.compile(r"(?<!\S)\S(?:[^\S\n]+\S){2,}(?!\S)")


def _coded(signs: str) -> bool:
    """Whether signs and digits without a letter may be a word: each can be read as a letter, and not all are digits."""
    return len(signs) >= 3 and not signs.isdigit() and all(c in LEET for c in signs)


def restored(token: str, decoder: Decoder) -> list[str]:
    """The words that a lower-cased token stands for."""
    bare = re.sub(r"([^\w\s])\1{2,}$", "", token.strip(_EDGES)).strip(_EDGES)
    if not any(c.isalpha() for c in bare):
        return decoder.restore(bare) if _coded(bare) else []
    plain = bare.rstrip("!")
    if not _PLAIN(plain):
        return decoder.restore(bare)
    return list(dict.fromkeys([plain, *decoder.restore(plain)])) if _RUN(plain) else [plain]


def _collapsed(word: str) -> str:
    """Every run of one character made single."""
    return re.sub(r"(.)\1+", r"\1", word)


def features(word: str) -> list[str]:
    return ["=" + word, *("^" + word[:n] for n in PREFIXES if len(word) >= n)]


def _spaced(text: str, decoder: Decoder) -> list[str]:
    """Words restored from letters that stand apart, each run of them as one lattice."""
    out: list[str] = []
    for m in _SPACED.finditer(text):
        run = "".join(m[0].split())
        if sum(c.isalpha() or c in LEET for c in run) >= 3 and not run.isdigit():
            out += decoder.restore(" ".join(run))
    return [w for w in out if len(w) > 2]


def held_out(doc_id: Column, parts: int = HELD_OUT, rest: int = 0) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == rest, F.lit(False))


def _sample_features(model: dict[int, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, memo = Decoder(model), {}
        for batch in batches:
            rows = []
            for doc, toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strings(batch.column(2)), strict=True):
                low = text.lower()
                found: set[str] = set()
                for token in set(low.split()):
                    if token not in memo:
                        memo[token] = [f for w in restored(token, decoder) for f in features(w)]
                    found.update(memo[token])
                for w in _spaced(low, decoder):
                    found.update(features(w))
                words = low.split()
                marks = [2**63 - 1] * 4
                for i in range(max(1, len(words) - 2)):
                    h = xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode("utf-8", "replace"))
                    for k in range(4):
                        marks[k] = min(marks[k], (h * (2 * k + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> 1)
                rows.append((doc, toxic, marks, sorted(found)))
            if rows:
                doc, toxic, marks, found_ = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(toxic, pa.int32()), pa.array(marks, pa.list_(pa.int64())), pa.array(found_, pa.list_(pa.string()))],
                    ["doc_id", "toxic", "marks", "features"],
                )

    return run


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression with a constant first column, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _summary(weights: list[float], tokens: int) -> list[float]:
    """What the regression sees of a text: a constant, the weight of its distinct features, their number, their share."""
    total = sum(weights)
    return [1.0, math.log1p(total), math.log1p(len(weights)), 10 * len(weights) / (tokens + 20)]


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", sample: int = SAMPLE) -> dict:
    """The model: character costs, feature weights, regression weights. Held-out labels are never read.

    Without any toxic or any clean label every text gets the share of toxic labels (0.5 without labels: score 0).
    """
    marked = labels.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id")))
    marked = marked.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    order = F.xxhash64("doc_id")
    chosen = cut(marked.filter("toxic = 1").orderBy(order, "doc_id").limit(sample).unionAll(marked.filter("toxic = 0").orderBy(order, "doc_id").limit(sample)))
    characters = character_model(docs, text)
    # at most 2 x sample rows by their making: the bound is proven
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")
    rows = cut(texts.mapInArrow(_sample_features(characters), "doc_id long, toxic int, marks array<long>, features array<string>"))
    seen: set[tuple] = set()
    kept: dict[int, int] = {}
    for r in sorted(rows.select("doc_id", "toxic", "marks").collect()):
        own = {(k, m, r.toxic) for k, m in enumerate(r.marks)}
        if not own & seen:  # no near copy of an earlier one
            kept.setdefault(r.doc_id, r.toxic)
        seen |= own
    model = {"characters": characters, "features": {}, "weights": [-3.0, 0.0, 0.0, 0.0]}
    toxic = sum(kept.values())
    clean = len(kept) - toxic
    if not toxic or not clean:
        return model
    spark = docs.sparkSession
    ids = spark.createDataFrame([(int(i),) for i in kept], "doc_id long")
    pure = rows.join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"])
    counts = pure.select("toxic", F.explode("features").alias("f")).groupBy("f").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    odds = F.log((F.col("t") + 0.5) / (toxic - F.col("t") + 0.5)) - F.log((F.col("c") + 0.5) / (clean - F.col("c") + 0.5))
    spread = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    good = counts.filter((F.col("t") >= F.lit(min(LEAST_DOCS, max(1, toxic // 4)))) & (odds - 2 * spread > LEAST_ODDS)).select("f", odds.alias("w"))
    weights = {r.f: float(r.w) for r in good.collect()}
    x, y = [], []
    for r in pure.select("toxic", F.expr("size(features)").alias("n"), F.array_intersect("features", F.array(*map(F.lit, sorted(weights)))).alias("f") if weights else F.array().alias("f")).collect():
        x.append(_summary([weights[f] for f in r.f], r.n // 3))
        y.append(r.toxic)
    return model | {"features": weights, "weights": [float(v) for v in _logistic(np.array(x), np.array(y, float))]}


def _scores(model: dict, at: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, known, weights = Decoder(model["characters"]), model["features"], model["weights"]
        # A word of letters alone has readings that differ from it in the length of runs only. If no known feature
        # begins it even with runs made single, none of its readings has one, and it needs no search.
        single = {_collapsed(f[1:]) for f in known}
        lengths = sorted({len(x) for x in single})

        class Memo(dict):
            def __missing__(self, token: str) -> tuple[str, ...]:
                plain = token.strip(_EDGES).rstrip("!")
                if plain.isalpha():
                    one = _collapsed(plain) if _RUN(plain) else plain
                    search = any(one[:n] in single for n in lengths)
                else:
                    search = True
                out = tuple(f for w in restored(token, decoder) for f in features(w) if f in known) if search else ()
                self[token] = out
                return out

        memo = Memo()  # of this task: a worker that lives on for other stages keeps none of it
        for batch in batches:
            scores = []
            for text in strings(batch.column(at)):
                low = text.lower()
                tokens = low.split()
                if len(memo) > MEMO:
                    memo.clear()
                found = set().union(*filter(None, [memo[t] for t in tokens]))
                for w in _spaced(low, decoder):
                    found.update(f for f in features(w) if f in known)
                z = sum(a * b for a, b in zip(weights, _summary([known[f] for f in found], len(set(tokens))), strict=True))
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, name])

    return run


def with_score(docs: DataFrame, model: dict, name: str, text: str = "text") -> DataFrame:
    """``docs`` as it is, and the score of each row's string column ``text`` as column ``name``, which ``docs`` hasn't."""
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    return docs.mapInArrow(_scores(model, docs.columns.index(text), name), schema)


def toxicity(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Null and empty texts get the score of a text without toxic features; texts of any length are read whole. Rows that
    repeat a doc_id are scored each for itself; a null doc_id stays null and isn't held out. Of readings that cost the
    same, the one found first stands. An empty table gives an empty result; other columns are ignored.
    """
    rows = with_score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), model, "score")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))

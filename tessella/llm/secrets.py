"""Secret scans by a randomness test battery (operator 8), DataFrame functions only.

Fixed patterns give the base spans. The battery adds spans of tokens that look random though no pattern names them:

* A token's encoding is inferred from its characters: hex, base 32, letters and base 36 in one case, and base 62. The
  signs of base 64 and its URL-safe kind are left out; the letters and digits of a random token are uniform without them.
* Against randomness: a chi-squared test of uniform use of that alphabet, a runs test about its middle and a serial
  correlation test. A token that any of them rejects (Bonferroni) is not random.
* Against language: its index of coincidence under the letter frequencies of the corpus's own long words, as a z score.
  The standard deviation falls with the length, so the same shape counts for more in a longer token. Over all tokens of
  the corpus the Benjamini-Hochberg rule sets the z score that keeps the share of false discoveries at FALSE_SHARE. The
  rule runs over a histogram of fixed size. Tokens of letters in one case are what language is measured by; they are
  spans if they pass and have LEAST_LETTERS characters; shorter ones can't be told from words run together.

Spark's regex functions give matches without places. The pieces between matches do: a running sum over a document's
pieces and matches gives every start, in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm.common import cut, table, whole

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs are maximal, so a least length in the pattern finds what a later test of the length would leave.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
LEAST_ASSIGN = 12
#: Tokens that the battery looks at.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ["assign", "access", "hex", "random"]
FALSE_SHARE = 0.01
#: A token is random unless one of the three tests rejects it at this level.
LEVEL = 0.01
BINS, STEP = 800, 0.05
#: Characters from which on a token of letters in one case can be told from language.
LEAST_LETTERS = 64
#: Index of coincidence if the corpus has no long words to tell it.
COINCIDENCE, CUBES = 0.0667, 0.0055


def upper_tail(z: Column) -> Column:
    """The normal distribution's upper tail, by Abramowitz and Stegun 26.2.17 (26.2.12 far out)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    density = F.exp(-a * a / 2) / F.sqrt(F.lit(2 * 3.141592653589793))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.when(a > 6, density / a).otherwise(density * poly)
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _occurrences(docs: DataFrame, text: str) -> DataFrame:
    """(doc_id, sha, kind, start, length, token, secret): every match of every pattern. Repeated rows give one."""

    def matches(kind: int, pattern: str, secret: int) -> Column:
        t = F.col("t")
        lengths = F.transform(F.split(t, pattern, -1), lambda x: F.length(x))
        found = F.arrays_zip(
            F.slice(lengths, 1, F.greatest(F.size(lengths) - 1, F.lit(0))).alias("before"),
            F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("token"),
            F.regexp_extract_all(t, F.lit(pattern), F.lit(secret)).alias("secret"),
        )
        nothing = F.lit(None).cast("array<struct<before:int,token:string,secret:string>>")
        return F.struct(F.lit(kind).alias("kind"), F.when(t.rlike(pattern), found).otherwise(nothing).alias("found"))

    kinds = F.array(matches(0, ASSIGN, 2), matches(1, ACCESS, 0), matches(2, HEX, 0), matches(3, TOKEN, 0))
    rows = docs.select("doc_id", whole(F.col(text)).alias("t")).select("doc_id", F.sha2("t", 256).alias("sha"), kinds.alias("kinds")).select("doc_id", "sha", F.explode_outer("kinds").alias("k"))
    rows = rows.select("doc_id", "sha", "k.kind", F.posexplode_outer("k.found").alias("nth", "m")).filter("nth is not null")
    rows = rows.select("doc_id", "sha", "kind", "nth", F.col("m.before").cast("long").alias("before"), "m.token", F.length("m.secret").alias("secret"), F.length("m.token").cast("long").alias("length"))
    so_far = W.partitionBy("doc_id", "sha", "kind").orderBy("nth").rowsBetween(W.unboundedPreceding, 0)
    start = F.sum(F.col("before") + F.col("length")).over(so_far) - F.col("length")
    return rows.distinct().withColumn("start", start).drop("before", "nth")


def _measured(tokens: DataFrame) -> DataFrame:
    """``tokens`` (token) with what the tests need: letters and digits only, by the token's alphabet."""
    bare = F.regexp_replace("token", "[^A-Za-z0-9]", "")
    kind = (
        F.when(F.col("bare").rlike(r"^([0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(F.col("bare").rlike(r"^([A-Z2-7]+|[a-z2-7]+)$") & F.col("bare").rlike("[2-7]"), "base32")
        .when(F.col("bare").rlike(r"^([a-z]+|[A-Z]+|[A-Z][a-z]+)$"), "letters")
        .when(F.col("bare").rlike(r"^([a-z0-9]+|[A-Z0-9]+)$"), "base36")
        .otherwise("base62")
    )
    digits, low = "0123456789", "abcdefghijklmnopqrstuvwxyz"
    alphabets = {"hex": digits + "abcdef", "base32": low + "234567", "letters": low, "base36": digits + low, "base62": digits + low.upper() + low}
    table_ = F.create_map(*[x for k, v in alphabets.items() for x in (F.lit(k), F.lit(v))])
    return (
        tokens.withColumn("bare", bare)
        .withColumn("encoding", kind)
        .filter("length(bare) >= 16 and not bare rlike '^[0-9]+$'")
        .withColumn("alphabet", table_[F.col("encoding")])
        .withColumn("folded", F.when(F.col("encoding") == "base62", F.col("bare")).otherwise(F.lower("bare")))
    )


def _battery(tokens: DataFrame) -> DataFrame:
    """``tokens`` (token, distinct): n, coincidence, p_random and words (letters alone)."""
    chars = cut(_measured(tokens).select("token", "encoding", F.length("alphabet").alias("k"), F.split("folded", "").alias("c"), F.split(F.lower("bare"), "").alias("plain"), "alphabet"))
    # Each step is a row-wise expression over columns that are there; the cut keeps the optimiser from nesting them.
    values = cut(
        chars.select(
            "token", "encoding", "k", F.size("c").alias("n"),
            F.transform("c", lambda x: F.instr(F.col("alphabet"), x) - 1).alias("v"),
            F.aggregate(F.transform(F.array_distinct("c"), lambda x: F.pow(F.size(F.filter("c", lambda y: y == x)), F.lit(2))), F.lit(0.0), lambda s, x: s + x).alias("squares"),
            F.aggregate(F.transform(F.array_distinct("plain"), lambda x: F.pow(F.size(F.filter("plain", lambda y: y == x)), F.lit(2))), F.lit(0.0), lambda s, x: s + x).alias("plain_squares"),
        )
    )
    mean = F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / F.col("n")
    sums = cut(
        values.withColumn("mean", mean).withColumn("pairs", F.arrays_zip(F.slice("v", 1, F.col("n") - 1).alias("a"), F.slice("v", 2, F.col("n") - 1).alias("b"))).select(
            "token", "encoding", "k", "n", "squares", "plain_squares",
            F.aggregate("pairs", F.lit(0.0), lambda s, p: s + (p["a"] - F.col("mean")) * (p["b"] - F.col("mean"))).alias("product"),
            F.aggregate("v", F.lit(0.0), lambda s, x: s + (x - F.col("mean")) * (x - F.col("mean"))).alias("spread"),
            (1 + F.size(F.filter("pairs", lambda p: (p["a"] * 2 < F.col("k")) != (p["b"] * 2 < F.col("k"))))).alias("runs"),
            F.size(F.filter("v", lambda x: x * 2 < F.col("k"))).alias("low"),
        )
    )
    n, df = F.col("n").cast("double"), (F.col("k") - 1)
    chi = F.col("k") / n * F.col("squares") - n
    z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    n1, n2 = F.col("low").cast("double"), n - F.col("low")
    expected = 1 + 2 * n1 * n2 / n
    variance = (expected - 1) * (expected - 2) / (n - 1)
    z_runs = F.when(variance > 0, (F.col("runs") - expected) / F.sqrt(variance)).otherwise(F.lit(9.0))
    z_serial = F.when(F.col("spread") > 0, F.col("product") / F.col("spread") * F.sqrt(n)).otherwise(F.lit(9.0))
    least = F.least(upper_tail(z_chi), 2 * upper_tail(F.abs(z_runs)), 2 * upper_tail(F.abs(z_serial)))
    return sums.select("token", "encoding", F.col("n").cast("double").alias("n"), ((F.col("plain_squares") - n) / (n * (n - 1))).alias("coincidence"), (3 * least).alias("p_random"))


def _random_tokens(occurrences: DataFrame) -> DataFrame:
    """The tokens that pass the battery and the false-discovery rule (token)."""
    tokens = occurrences.filter("kind = 3").groupBy("token").agg(F.count("*").alias("times"))
    tested = cut(_battery(tokens.select("token")))
    usual = tested.filter("encoding = 'letters'").agg(F.sum(F.col("coincidence") * F.col("n")).alias("s"), F.sum("n").alias("n"))
    usual = usual.select(F.coalesce(F.when(F.col("n") > 0, F.col("s") / F.col("n")), F.lit(COINCIDENCE)).alias("usual"))
    n, c = F.col("n"), F.col("usual")
    cubes = F.pow(c, F.lit(1.5)) * (CUBES / COINCIDENCE**1.5)  # the cube sum of a language's frequencies follows its square sum
    deviation = F.sqrt(F.greatest(4 * (cubes - c * c) / n, F.lit(0.0)) + 2 * c / (n * (n - 1)))
    scored = tested.crossJoin(F.broadcast(usual)).withColumn("z", (c - F.col("coincidence")) / deviation)  # one row
    scored = cut(scored.select("token", "encoding", "n", "p_random", "z", F.least(F.greatest(F.floor(F.col("z") / STEP), F.lit(0)), F.lit(BINS)).cast("int").alias("bin")))
    bins = scored.groupBy("bin").agg(F.count("*").alias("here"))  # BINS + 1 rows at most
    above = F.sum("here").over(W.orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, 0))
    ranked = bins.select("bin", above.alias("rank"), F.sum("here").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("all"))
    cutoff = ranked.filter(upper_tail(F.col("bin") * STEP) <= FALSE_SHARE * F.col("rank") / F.col("all")).agg(F.min("bin").alias("cutoff"))
    return scored.crossJoin(F.broadcast(cutoff)).filter((F.col("bin") >= F.col("cutoff")) & (F.col("p_random") >= LEVEL) & ((F.col("encoding") != "letters") | (F.col("n") >= LEAST_LETTERS))).select("token")


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    Base spans are those of the three patterns; ``spans`` has them and those of the battery that overlap none of them,
    as kind:start:end by start and kind, comma-joined. Null counts as empty and has no spans, base_sha256 that of the
    empty string. Rows that repeat a doc_id are scanned each for itself, and a null doc_id stays null. An empty table
    gives an empty result; other columns are ignored.
    """
    occurrences = cut(_occurrences(docs, text))
    random = _random_tokens(occurrences).withColumn("random", F.lit(True))
    base = occurrences.filter(f"kind < 3 and (kind <> 0 or secret >= {LEAST_ASSIGN})").select("doc_id", "sha", "kind", "start", (F.col("start") + F.col("length")).alias("end"))
    added = occurrences.filter("kind = 3").join(random, "token").select("doc_id", "sha", "kind", "start", (F.col("start") + F.col("length")).alias("end"))
    span = F.struct("start", "kind", "end")
    lists = base.unionAll(added).groupBy("doc_id", "sha").agg(F.sort_array(F.collect_list(span)).alias("s"))
    lists = lists.withColumn("base", F.filter("s", lambda x: x["kind"] < 3)).withColumn("s", F.col("s"))
    free = F.filter("s", lambda x: (x["kind"] < 3) | ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    lists = cut(lists.select("doc_id", "sha", "base", free.alias("s")))
    names = F.array(*map(F.lit, KINDS))

    def joined(column: str) -> Column:
        return F.concat_ws(",", F.transform(column, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))))

    def count(kind: int) -> Column:
        return F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    found = lists.select("doc_id", "sha", *[count(k) for k in range(4)], F.sha2(joined("base"), 256).alias("base_sha256"), joined("s").alias("spans"))
    rows = docs.select("doc_id", F.sha2(whole(F.col(text)), 256).alias("sha"))
    out = rows.alias("r").join(found.alias("f"), F.col("r.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("r.sha") == F.col("f.sha")), "left")
    none = F.lit(0).cast("long")
    return out.select(
        "r.doc_id", *[F.coalesce(f"n_{k}", none).alias(f"n_{k}") for k in KINDS[:3]],
        F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("n_random", none).alias("n_random"),
    )


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))

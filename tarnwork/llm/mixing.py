"""Sources mixed to target weights: soft membership by a classifier, rates by projected gradient."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwork.session import stage

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: fixed value: the published pattern that splits text before the merges of this vocabulary
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BINS = 16  # of the histogram of token numbers, by which the classifier sees the text
TRAIN_ROWS = 20_000
NAME_TRUST = 0.995  # how often a listed source is taken to be the true one
REGULARISER = 0.2
PRIOR_WEIGHT = 0.5  # of the empty row that stands for each class in the training rows
MAX_DOMAINS = 1_000
ROUNDS = 30


def normal_source(column: str) -> Column:
    """A source's name without case, outer blanks and the difference of blank, hyphen and underscore."""
    return F.regexp_replace(F.lower(F.regexp_replace(column, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), r"[\s\p{Z}\-]", "_")


@lru_cache(maxsize=2)
def _encoder(path: str):  # noqa: ANN202
    """The tokenizer of a file, built once in a Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """docs without the text, with its tokens and their histogram (shares of BINS bins). NULL and empty texts have none.

    The tokenizer's file need only be on the driver: Spark ships it to the executors.
    """
    docs.sparkSession.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(SparkFiles.get(name)).encode_ordinary
        for f in frames:
            tokens, shares = [], []
            for body in f.pop("_text"):
                ids = encode(body) if body else []
                tokens.append(len(ids))
                shares.append(np.bincount(np.asarray(ids, np.int64) % BINS, minlength=BINS) / max(len(ids), 1))
            yield f.assign(tokens=tokens, shares=shares)

    rest = docs.drop(text)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)
    return docs.withColumnRenamed(text, "_text").mapInPandas(run, f"{fields}, tokens bigint, shares array<double>")


def _vectors(rows: DataFrame, words: str) -> DataFrame:
    sized = VectorSizeHint(inputCol="_shares", size=BINS, handleInvalid="optimistic").transform(rows.withColumn("_shares", array_to_vector("shares")))
    hashed = HashingTF(inputCol=words, outputCol="_hashed", numFeatures=1024, binary=True).transform(sized)
    return VectorAssembler(inputCols=["_hashed", "_shares"], outputCol="_x").transform(hashed)


def _sampled(rows: DataFrame, label: str, classes: int, train_rows: int) -> DataFrame:
    """The labelled rows, of every class at most about train_rows / classes picked by hash, with the weight that makes up for it."""
    counts = {r[0]: r[1] for r in rows.where(F.col(label).isNotNull()).groupBy(label).count().collect()}  # a row a class
    quota = max(1, train_rows // max(classes, 1))
    parts = F.coalesce(*[F.when(F.col(label) == c, F.lit(-(-n // quota))) for c, n in sorted(counts.items())], F.lit(1))
    return rows.where(F.col(label).isNotNull() & (F.pmod(F.xxhash64("key", F.lit(3)), parts) == 0)).withColumn("_weight", parts.cast("double"))


def _fit(train: DataFrame, label: str, words: str, classes: int) -> LogisticRegressionModel:
    """Multinomial logistic regression on words (strings) and shares; an empty row of small weight stands for every class, so
    that one without a labelled row has a small posterior."""
    empty = train.sparkSession.createDataFrame([(float(c), [], [0.0] * BINS, PRIOR_WEIGHT) for c in range(classes)], "y double, words array<string>, shares array<double>, w double")
    rows = train.select(F.col(label).cast("double").alias("y"), F.col(words).alias("words"), "shares", F.col("_weight").alias("w")).repartition(4).unionByName(empty)
    train = stage(_vectors(rows, "words").select("y", "_x", "w"), "mix-train")
    return LogisticRegression(featuresCol="_x", labelCol="y", weightCol="w", family="multinomial", regParam=REGULARISER, maxIter=40).fit(train)


def posteriors(rows: DataFrame, label: str, words: str, classes: int, train_rows: int) -> DataFrame:
    """rows with p, the posterior of each class, by multinomial logistic regression on words (strings) and shares.

    It is fitted on the labelled rows, at most about train_rows of them, an equal number of each class, weighted back. The label
    is no feature and doesn't change a row's own posterior.
    """
    if classes < 2:
        return rows.withColumn("p", F.array(*[F.lit(1.0)] * classes).cast("array<double>"))
    model = _fit(_sampled(rows, label, classes, train_rows), label, words, classes)
    return model.transform(_vectors(rows, words)).withColumn("p", vector_to_array("probability")).drop("_x", "_hashed", "_shares", "rawPrediction", "probability", "prediction")


def memberships(rows: DataFrame, label: str, classes: int, trust: float = NAME_TRUST) -> DataFrame:
    """rows with p weighed by the written label: right with probability `trust`, else any other class. Without a label p stays."""
    if classes < 2:
        return rows
    weighed = F.transform("p", lambda x, i: x * F.when(F.col(label).isNull(), F.lit(1.0)).when(i == F.col(label), F.lit(trust)).otherwise(F.lit((1 - trust) / (classes - 1))))
    whole = rows.withColumn("p", weighed).withColumn("_whole", F.aggregate("p", F.lit(0.0), lambda s, y: s + y))
    return whole.withColumn("p", F.transform("p", lambda x: x / F.col("_whole"))).drop("_whole")


def replay(history: np.ndarray, p: np.ndarray, cap: np.ndarray) -> np.ndarray:
    """The rates after the steps in history: each a move against the gradient, cut to 0..cap."""
    rate = np.minimum(1.0, cap)
    for h in history:
        rate = np.clip(rate - p @ h, 0.0, cap)
    return rate


def draw_whole(rates: DataFrame) -> DataFrame:
    """rates (key, domain, tokens, cap, rate) with repeats, whole numbers whose tokens come near those of the rates.

    The fractions left over by whole parts are rounded by domain and size band (eighths of a power of two, at most 512
    a domain), large texts first: a band gives one more repeat to so many texts as make up its fractions and what
    larger bands left over. Who gets it is decided by a hash over the fraction. The place in that order is found within
    64 buckets and from their counts, so that no band is sorted in one task.
    """
    frac = F.col("rate") - F.floor("rate")
    marked = rates.withColumn("frac", frac).withColumn("band", F.floor(F.log2(F.col("tokens") + F.lit(1.0)) * 8).cast("int"))
    marked = marked.withColumn("q", (F.pmod(F.xxhash64(F.col("key").cast("string"), F.lit(11)), F.lit(1 << 30)) + 1) / F.lit(float(1 << 30)) / F.greatest("frac", F.lit(1e-12))).withColumn("bucket", F.floor(F.col("q") / (F.col("q") + 1) * 64).cast("int"))
    open_ = (F.col("frac") > 0) & (F.col("tokens") > 0)
    bands = marked.where(open_).groupBy("domain", "band").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"), F.sum(F.col("frac") * F.col("tokens")).alias("f")).collect()  # at most 512 rows a domain
    more, carry = [], {}
    for r in sorted(bands, key=lambda r: (r.domain, -r.band)):
        left = r.f + carry.get(r.domain, 0.0)
        k = min(r.n, max(0, round(left / (r.t / r.n))))
        carry[r.domain] = left - k * r.t / r.n
        more.append((r.domain, r.band, k))
    spark = rates.sparkSession
    if not more:
        return rates.withColumn("repeats", F.least(F.floor("rate"), F.col("cap").cast("bigint")).cast("int"))
    before = Window.partitionBy("domain", "band").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = marked.where(open_).groupBy("domain", "band", "bucket").count().select("domain", "band", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    offsets = offsets.join(F.broadcast(spark.createDataFrame(more, "domain int, band int, more int")), ["domain", "band"]).where("before < more")
    # only rows of buckets that reach the number of their band are ranked
    met = marked.where(open_).join(offsets, ["domain", "band", "bucket"], "left")
    place = F.row_number().over(Window.partitionBy("domain", "band", "bucket").orderBy("q", "key"))
    ranked = met.where("before is not null").withColumn("extra", (F.col("before") + place <= F.col("more")).cast("int"))
    none = [marked.where(~F.coalesce(open_, F.lit(False))), met.where("before is null")]
    every = reduce(DataFrame.unionByName, [x.select(*rates.columns, F.lit(0).alias("extra")) for x in none], ranked.select(*rates.columns, "extra"))
    return every.withColumn("repeats", F.least(F.floor("rate") + F.col("extra"), F.col("cap").cast("bigint")).cast("int")).drop("extra")


def _described(docs: DataFrame, doc_id: str, text: str, source: str, traits: list[str], wish: list, tokenizer: str) -> DataFrame:
    """key, domain (the listed target of the written source, if any), words (the traits, for the classifier), tokens, shares."""
    spot = docs.sparkSession.createDataFrame([(r.name, i) for i, r in enumerate(wish)], "name string, domain int")
    traits_ = [F.concat(F.lit(f"{t}:"), F.coalesce(F.col(t).cast("string"), F.lit(""))) for t in traits]
    rows = docs.select(F.col(doc_id).alias("key"), F.coalesce(normal_source(source), F.lit("")).alias("name"), F.array(*traits_).cast("array<string>").alias("words"), F.col(text).alias("body"))
    return count_tokens(rows.join(F.broadcast(spot), "name", "left").select("key", "domain", "words", "body"), "body", tokenizer)


def _wishes(targets: DataFrame) -> list:
    wish = targets.select(normal_source("source_name").alias("name"), F.col("source_name"), F.col("target_share").cast("double"), F.col("max_repeats").cast("double")).where("source_name is not null").limit(MAX_DOMAINS + 1).collect()
    if len(wish) > MAX_DOMAINS:
        raise ValueError("too many targets")
    return sorted(wish, key=lambda r: r.name)


def posterior_quality(docs: DataFrame, doc_id: str, text: str, source: str, traits: list[str], targets: DataFrame, tokenizer: str = TOKENIZER, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(rows, log_loss, prior_log_loss, accuracy, commonest): the classifier's posteriors on a fifth of the documents with a listed
    source, held out by hash, beside those of the shares alone. prior_log_loss is the entropy of the held-out sources."""
    wish = _wishes(targets)
    n = len(wish)
    counted = stage(_described(docs, doc_id, text, source, traits, wish, tokenizer).where("domain is not null"), "mix-counted")
    held = F.pmod(F.xxhash64("key", F.lit(17)), F.lit(5)) == 0
    if n < 2 or counted.where(~held).isEmpty():
        return counted.limit(0).agg(F.count(F.lit(1)).alias("rows")).selectExpr("rows", "cast(null as double) as log_loss", "cast(null as double) as prior_log_loss", "cast(null as double) as accuracy", "cast(null as double) as commonest")
    model = _fit(_sampled(counted.where(~held), "domain", n, train_rows), "domain", "words", n)
    p = model.transform(_vectors(counted.where(held), "words")).select("domain", vector_to_array("probability").alias("p"))
    own = F.get("p", F.col("domain"))
    by = stage(p.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.sum(-F.log(F.greatest(own, F.lit(1e-12)))).alias("loss"), F.count_if(own == F.array_max("p")).alias("right")), "mix-quality")
    all_ = by.agg(F.sum("n").alias("rows"))
    return by.join(F.broadcast(all_)).groupBy("rows").agg((F.sum("loss") / F.first("rows")).alias("log_loss"), F.sum(-F.col("n") / F.col("rows") * F.log(F.col("n") / F.col("rows"))).alias("prior_log_loss"), (F.sum("right") / F.first("rows")).alias("accuracy"), (F.max("n") / F.first("rows")).alias("commonest"))


def mix_to_targets(docs: DataFrame, doc_id: str, text: str, source: str, traits: list[str], targets: DataFrame, tokenizer: str = TOKENIZER, train_rows: int = TRAIN_ROWS, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(draws, report). draws has doc_id, domain, tokens, rate, repeats for each row of docs; report a row for each target.

    targets has source_name, target_share, max_repeats (at most 1,000 rows, else ValueError; names compared as sources are).
    The wished size of a target is its share of the tokens of all documents. report: own_tokens and reach (max_repeats x
    own tokens over all tokens) by the written source; fitted_share, what the rates give in expectation over the
    memberships; drawn_tokens with their share of all tokens (drawn_share, to hold against the wish) and of what is drawn (actual_share); falls_short, where both the fit stays below
    the wish and reach does. Documents of unlisted, odd or NULL sources are members of targets by their posterior alone; without targets nothing is drawn. NULL and empty
    texts have no tokens; repeated rows are rows of their own; empty tables give an empty draw and a report of zeros.

    Method: logistic regression on the rows with a listed source gives each document its posterior over targets, from its
    traits and token histogram alone; the source's name is no feature. The written source then weighs it as evidence that is
    right in NAME_TRUST of all cases (memberships), so that no membership is certain. Rates between 0 and the cap of the likeliest target then minimise
    the squared gaps between expected tokens and wishes, each over the target's mass or its wish, whichever is more; with each document's step
    scaled by its tokens, a step of 1 is safe, and a few rounds settle. A round is one sum over all documents; only a
    number a target passes the driver, and a document's rate is worked out again from the history of these numbers.
    A rate is drawn as its whole part, and for some documents one more (see draw_whole).
    """
    spark = docs.sparkSession
    wish = _wishes(targets)
    n = len(wish)
    counted = stage(_described(docs, doc_id, text, source, traits, wish, tokenizer), "mix-counted")
    caps = F.array(*[F.lit(r.max_repeats) for r in wish])
    own = F.coalesce(F.col("domain"), (F.array_position("p", F.array_max("p")) - 1).cast("int"))
    known = memberships(posteriors(counted, "domain", "words", n, train_rows), "domain", n)
    ready = stage(known.select("key", F.col("domain").alias("written"), own.alias("domain"), "tokens", F.coalesce(F.get(caps, own).cast("double"), F.lit(0.0)).alias("cap"), "p"), "mix-ready")

    masses = np.zeros(n)
    history = np.zeros((0, n))

    def expected(history: np.ndarray, ones: bool = False) -> np.ndarray:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if len(f):
                    p = np.stack(f["p"])
                    rate = np.ones(len(f)) if ones else replay(history, p, f["cap"].to_numpy())
                    yield pd.DataFrame({"j": np.arange(n), "s": (rate * f["tokens"].to_numpy()) @ p})

        sums = ready.select("p", "cap", "tokens").mapInPandas(run, "j int, s double").groupBy("j").agg(F.sum("s").alias("s")).collect()
        out = np.zeros(n)
        for r in sums:
            out[r.j] = r.s
        return out

    masses = expected(history, ones=True)
    total = masses.sum()
    wanted = np.array([r.target_share for r in wish]) * total
    got = expected(history)
    for _ in range(rounds if total else 0):
        scale = np.maximum(masses, wanted)
        step = np.where(scale > 0, (got - wanted) / np.where(scale > 0, scale, 1.0), 0.0)
        history = np.vstack([history, step])
        after = expected(history)
        settled = np.abs(after - got).max() <= 1e-4 * total
        got = after
        if settled:
            break

    def rated(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.drop(columns="p").assign(rate=replay(history, np.stack(f["p"]), f["cap"].to_numpy()) if len(f) else [])

    draws = ready.select("key", "written", "domain", "tokens", "cap", "p").mapInPandas(rated, f"key {docs.schema[doc_id].dataType.simpleString()}, written int, domain int, tokens bigint, cap double, rate double")
    draws = draw_whole(stage(draws, "mix-rates"))
    draws = stage(draws, "mix-draws")
    written = draws.where("written is not null").groupBy(F.col("written").alias("domain")).agg(F.sum("tokens").alias("own_tokens"))
    drawn = draws.groupBy("domain").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("drawn_tokens"), F.max("repeats").alias("most_repeats"))
    sums = draws.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all_tokens"), F.coalesce(F.sum(F.col("tokens") * F.col("repeats")), F.lit(0)).alias("all_drawn"))
    fitted = spark.createDataFrame([(i, r.source_name, r.target_share, int(r.max_repeats), float(got[i] / total) if total else 0.0) for i, r in enumerate(wish)], "domain int, source_name string, target_share double, max_repeats int, fitted_share double")
    report = fitted.join(written, "domain", "left").join(drawn, "domain", "left").join(F.broadcast(sums)).select(
        "source_name", "target_share", "max_repeats", F.coalesce("own_tokens", F.lit(0)).alias("own_tokens"),
        F.coalesce(F.try_divide(F.col("max_repeats") * F.coalesce("own_tokens", F.lit(0)), "all_tokens"), F.lit(0.0)).alias("reach"), "fitted_share",
        F.coalesce("drawn_tokens", F.lit(0)).alias("drawn_tokens"), F.coalesce(F.try_divide(F.coalesce("drawn_tokens", F.lit(0)), "all_drawn"), F.lit(0.0)).alias("actual_share"), F.coalesce(F.try_divide(F.coalesce("drawn_tokens", F.lit(0)), "all_tokens"), F.lit(0.0)).alias("drawn_share"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
    )
    # the fit says who stays below the wish; the check on written sources follows it
    short = (F.col("fitted_share") < 0.99 * F.col("target_share")) & (F.col("reach") < F.col("target_share"))
    return draws.select(F.col("key").alias("doc_id"), F.get(F.array(*[F.lit(r.source_name) for r in wish]), F.col("domain")).alias("domain"), "tokens", "rate", "repeats"), report.withColumn("falls_short", short)

"""Personal information in free text: overlapping candidates, boosted trees, calibrated thresholds."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwork.llm.pii_candidates import TYPES, NameParts, features, label, plain, spans
from tarnwork.session import stage

LEAST_LABELS = 10
MISSED = 0.01  # share of the labelled spans of a kind that may fall below its threshold
MARGIN = 0.8  # between that share's probability and the threshold
CLEAR = 0.15  # calibrated probability below which a candidate is taken as false
MAX_HINTS = 100_000
FOUND = "array<struct<start:int,stop:int,kind:string,piece:string>>"


@dataclass
class Judge:
    """What a task needs to judge candidates: the trees of each kind as arrays."""

    names: NameParts
    trees: dict[str, list[tuple[np.ndarray, ...]]] = field(default_factory=dict)

    def marks(self, kind: str, x: np.ndarray) -> np.ndarray:
        """The probability that the trees of a kind give each row of features."""
        margin = np.zeros(len(x))
        for weight, at, cut, left, right, value in self.trees[kind]:
            node = np.zeros(len(x), int)
            while (inner := at[node] >= 0).any():
                n = node[inner]
                node[inner] = np.where(x[inner, at[n]] <= cut[n], left[n], right[n])
            margin += weight * value[node]
        return 1 / (1 + np.exp(-2 * margin))

    def find(self, text: str) -> list[dict]:
        """The accepted spans of a text, none overlapping another."""
        every: dict[str, list[tuple[int, int]]] = {}
        for s, e, kind in spans(text):
            every.setdefault(kind, []).append((s, e))
        kept = []
        for kind, places in every.items():
            if kind in self.trees:
                marks = self.marks(kind, np.array([features(text, s, e, kind, self.names) for s, e in places]))
            else:
                marks = [float(plain(text, s, e, kind, self.names)) for s, e in places]
            kept += [{"start": s, "stop": e, "kind": kind, "piece": text[s:e], "p": float(p)} for (s, e), p in zip(places, marks) if p >= 0.5]
        return _settle(kept)


def _arrays(printed: str) -> tuple[np.ndarray, ...]:
    """A tree's printed form as arrays: feature (-1 in a leaf), cut, left and right node, value."""
    rows: list[list[float]] = []
    above: list[int] = []  # inner nodes that wait for a child
    for line in printed.splitlines():
        step = re.search(r"(If|Else) \(feature (\d+) (?:<=|>) (\S+)\)|Predict: (\S+)", line)
        if step is None:
            continue
        if step[1] == "Else":
            continue  # its node is there already, and the next line is its right child
        if above:
            parent = rows[above[-1]]
            side = 2 if parent[2] < 0 else 3
            parent[side] = len(rows)
            if side == 3:
                above.pop()
        if step[1] == "If":
            above.append(len(rows))
            rows.append([int(step[2]), float(step[3]), -1, -1, 0.0])
        else:
            rows.append([-1, 0.0, 0, 0, float(step[4])])
    at, cut, left, right, value = zip(*rows)
    return np.array(at), np.array(cut), np.array(left, int), np.array(right, int), np.array(value)


def _boost(rows: DataFrame, kinds: list[int], depth: int, leaf: int) -> dict[int, GBTClassificationModel]:
    """Trees for the label of each kind, on all candidates: those of the same features and label are one row, weighted by their number, and
    every leaf holds `leaf` candidates at least. The kinds are fitted at the same time, as each is a chain of small jobs."""
    few = stage(rows.groupBy("kind", "label", "features").agg(F.count(F.lit(1)).cast("double").alias("weight")), "pii-train")
    sizes = {r.kind: r for r in few.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight")).collect()}  # a row a kind
    parts = max(2, sum(r.n for r in sizes.values()) // 50_000)
    few = few.withColumn("vector", array_to_vector("features")).drop("features").coalesce(parts)

    def fit_one(k: int) -> GBTClassificationModel:
        least = min(leaf / sizes[k].weight, 0.49)
        trees = GBTClassifier(featuresCol="vector", labelCol="label", weightCol="weight", maxIter=10, maxDepth=depth, maxBins=32, minWeightFractionPerNode=least, stepSize=0.4, seed=7)
        return trees.fit(few.where(F.col("kind") == k))

    with ThreadPoolExecutor(len(TYPES)) as pool:
        return dict(zip(kinds, pool.map(inheritable_thread_target(rows.sparkSession)(fit_one), kinds)))


def _transform(models: dict[int, GBTClassificationModel], rows: DataFrame) -> DataFrame:
    """rows with g, the probability by the trees of their kind."""
    vectors = rows.withColumn("vector", array_to_vector("features"))
    parts = [m.transform(vectors.where(F.col("kind") == k)).select(*rows.columns, vector_to_array("probability")[1].alias("g")) for k, m in models.items()]
    return reduce(DataFrame.unionByName, parts)


def fit(docs: DataFrame, names: NameParts) -> Judge:
    """The judge, from all candidates of all documents.

    A field label stands before some of the true spans only, and the rest are unlabelled rather than wrong. So trees first
    learn how likely a label is; that over the mean likelihood of a kind's labelled spans (held out for it, a fifth) is the
    chance that a span is true (Elkan and Noto's calibration). The threshold of a kind lies below all but MISSED of its
    labelled spans. Spans above it and the likeliest of their place are then taken as true, those below CLEAR as false, and
    the trees that judge are fitted to these. Kinds with fewer than LEAST_LABELS labels are judged by their form alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(names)

    def labelled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = shared.value
        for f in frames:
            out = [(TYPES.index(kind), label(text, s, kind), features(text, s, e, kind, names), f"{key}/{s}/{e}") for key, text in zip(f["doc_id"], f["text"]) if text for s, e, kind in spans(text)]
            if out:
                yield pd.DataFrame(out, columns=["kind", "label", "features", "place"])

    rows = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(labelled, "kind int, label int, features array<double>, place string")
    rows = stage(rows.withColumn("h", F.xxhash64("place", "kind")), "pii-labelled")
    labels = {r.kind: r.n for r in rows.groupBy("kind").agg(F.sum("label").alias("n")).collect()}
    kinds = sorted(k for k, n in labels.items() if n >= LEAST_LABELS)
    if not kinds:
        return Judge(names)
    rows = rows.where(F.col("kind").isin(kinds))
    # with few labels a held-out fifth says little, so all of them count then
    enough = [k for k in kinds if labels[k] >= 50 * LEAST_LABELS]
    held = (F.col("label") == 1) & F.col("kind").isin(enough) & (F.pmod(F.xxhash64("h"), F.lit(5)) == 0)
    marked = stage(_transform(_boost(rows.where(~held), kinds, 3, 20), rows.withColumn("held", held)), "pii-marked")
    known = marked.where("label = 1").where(F.col("held") | ~F.col("kind").isin(enough)).groupBy("kind").agg(F.avg("g").alias("mean"), F.percentile("g", MISSED).alias("low")).collect()  # a row a kind
    pick = lambda values: F.coalesce(*[F.when(F.col("kind") == k, F.lit(float(v))) for k, v in values])
    p = F.col("g") / pick((r.kind, r.mean) for r in known)
    cut = pick((r.kind, min(0.5, max(CLEAR, MARGIN * r.low / r.mean))) for r in known)
    judged = marked.withColumn("p", p).withColumn("best", F.max("p").over(Window.partitionBy("place")))
    judged = judged.withColumn("label", F.when((F.col("p") >= cut) & (F.col("p") == F.col("best")), 1).when((F.col("p") < CLEAR) | (F.col("p") < F.col("best")), 0))
    models = _boost(judged.where("label is not null"), kinds, 4, 5)
    return Judge(names, {TYPES[k]: [(w, *_arrays(t.toDebugString)) for w, t in zip(m.treeWeights, m.trees)] for k, m in models.items()})


def _settle(rows: list) -> list[dict]:
    """Of overlapping accepted spans the longest stays, then the likelier one."""
    taken: list[dict] = []
    ends: list[int] = []
    for r in sorted(rows, key=lambda r: (r["start"] - r["stop"], -r["p"], r["start"], r["kind"])):
        i = bisect.bisect(ends, r["start"])
        # ends[i] is the first end after this start: its span must begin at or after this stop
        if i == len(ends) or taken[i]["start"] >= r["stop"]:
            taken.insert(i, {k: r[k] for k in ("start", "stop", "kind", "piece")})
            ends.insert(i, r["stop"])
    return taken


def _judge(docs: DataFrame, doc_id: str, text: str, name_hints: DataFrame) -> Judge:
    hints = name_hints.select(F.col("name_part").cast("string"), F.lower(F.trim("part_kind"))).where("name_part is not null").limit(MAX_HINTS + 1).collect()
    if len(hints) > MAX_HINTS:
        raise ValueError("too many name hints for one task")
    names = NameParts([(a, k) for a, k in hints if k in ("given", "family")])
    return fit(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), names)


def find_personal(docs: DataFrame, doc_id: str, text: str, name_hints: DataFrame) -> DataFrame:
    """(doc_id, copy, found): for each text with personal information the spans found, by place; positions count code points.

    name_hints has name_part and part_kind (given or family), at most 100,000 rows (else ValueError). NULL and empty
    texts have no row; copies of a row (same doc_id and text) share one; empty tables give an empty result; texts are read whole.

    Method: generators propose overlapping spans of five kinds. Gradient-boosted trees judge each by its format, the signs
    around it and, for names, by how its words begin and end like those of the hints (a word's own entry left out).
    Field labels ("Tel:", "passport no.", "signed") stand before some of the true spans; they are no features, and the
    trees learn from them on all candidates of all documents (see fit). Without labels of a kind
    only forms that tell by themselves are found. Spans of probability 0.5 or more stay. The trees go to the tasks, so that
    each text is judged and settled where it is read; only findings are shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_judge(docs, doc_id, text, name_hints))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["found"] = [shared.value.find(t) for t in f.pop("text")]
            yield f[f["found"].map(len) > 0]

    kind = docs.schema[doc_id].dataType.simpleString()
    whole = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("copy"), F.col(text).alias("text")).where("text is not null and text <> ''")
    return whole.mapInPandas(run, f"doc_id {kind}, copy bigint, found {FOUND}").dropDuplicates(["doc_id", "copy"])


def redact_personal(docs: DataFrame, doc_id: str, text: str, name_hints: DataFrame) -> DataFrame:
    """(doc_id, text): every text with [EMAIL], [PHONE], ... in the place of what find_personal finds; all else stays as it is.

    The placeholders are written in the pass that judges the spans, so no text is shuffled. NULL and empty texts come
    back as they are, and one row comes out for each row that goes in.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_judge(docs, doc_id, text, name_hints))

    def written(body: str | None) -> str | None:
        if not body:
            return body
        out, at = [], 0
        for r in shared.value.find(body):
            out += [body[at : r["start"]], f"[{r['kind'].upper()}]"]
            at = r["stop"]
        return "".join([*out, body[at:]])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(text=[written(t) for t in f["text"]])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, f"doc_id {kind}, text string")


def redact(docs: DataFrame, doc_id: str, text: str, found: DataFrame) -> DataFrame:
    """(doc_id, text): texts with placeholders for findings that are there already, such as checked ones from find_personal.

    NULL and empty texts come back as they are, and one row comes out for each row that goes in. Texts meet their findings in a shuffle.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("copy"), F.col(text).alias("text"))
    met = rows.join(found, ["doc_id", "copy"], "left")
    # from place to place: the text between two spans, then the placeholder
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))
    step = lambda a, x: F.struct((x["stop"] + 1).alias("at"), F.concat(a["out"], F.substring(F.col("text"), a["at"], x["start"] + 1 - a["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("out"))
    joined = F.aggregate("found", start, step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"], F.length("text"))))
    return met.select("doc_id", F.when(F.col("found").isNull(), F.col("text")).otherwise(joined).alias("text"))

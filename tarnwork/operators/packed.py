"""Fields that hold several values: one row per value, by rules resolved once per delimiter skeleton."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.operators.joins import join_null_safe, join_weighted
from tarnwork.session import stage

SEPARATORS = ",;|\t\n\r"
QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "«": "»"}
BRACKETS = {"[": "]", "{": "}", "(": ")", "<": ">"}
BROADCAST_BYTES = 16 << 20
MAX_KNOWN = 5_000
RULES = "array<struct<start:int,n:int,quote:string>>"


def resolve(skeleton: str, known: bool) -> list[tuple[int, int, str]]:
    """(first atom from 1, number of atoms, quote) of every value of a skeleton, one character an atom.

    'v' is a known value, 'a' a run of ordinary characters, 's' a joining word or sign; all else stands for itself.
    """
    i, j = 0, len(skeleton)

    def trim(i: int, j: int) -> tuple[int, int]:
        while i < j and skeleton[i] in " \t\n\r":
            i += 1
        while j > i and skeleton[j - 1] in " \t\n\r":
            j -= 1
        return i, j

    def spans(i: int, j: int) -> bool:
        """Whether the bracket at i closes at j - 1 and not before."""
        depth = 0
        for k in range(i, j):
            depth += (skeleton[k] == skeleton[i]) - (skeleton[k] == BRACKETS[skeleton[i]])
            if not depth:
                return k == j - 1
        return False

    i, j = trim(i, j)
    while j - i >= 2 and skeleton[i] in BRACKETS and spans(i, j):
        i, j = trim(i + 1, j - 1)
    out: list[tuple[int, int, str]] = []
    if known:
        k = i
        while k < j:
            if skeleton[k] == "v":
                out.append((k + 1, 1, ""))
            elif skeleton[k] == "a":  # unknown words, as far as they go with blanks between
                e = k + 1
                while e < j and (skeleton[e] == "a" or (skeleton[e] == " " and e + 1 < j and skeleton[e + 1] == "a")):
                    e += 1
                out.append((k + 1, e - k, ""))
                k = e - 1
            k += 1
        return out
    k = i
    while k < j:
        if skeleton[k] in SEPARATORS or skeleton[k] == " ":
            k += 1
            continue
        quote = QUOTES.get(skeleton[k])
        if quote:
            e = k + 1
            while e < j and (skeleton[e] != quote or skeleton[e + 1 : e + 2] == quote):
                e += 2 if skeleton[e] == quote else 1
            after = e + 1
            while after < j and skeleton[after] == " ":
                after += 1
            if e < j and (after >= j or skeleton[after] in SEPARATORS):
                s, t = trim(k + 1, e)
                if t > s:
                    out.append((s + 1, t - s, quote))
                k = after
                continue
        e, depth = k, 0
        while e < j and (depth or skeleton[e] not in SEPARATORS):
            depth = max(0, depth + (skeleton[e] == "(") - (skeleton[e] == ")"))
            e += 1
        if depth:  # an opening bracket without its end keeps nothing together
            e = k
            while e < j and skeleton[e] not in SEPARATORS:
                e += 1
        s, t = trim(k, e)
        out.append((s + 1, t - s, ""))
        k = e
    return out


def split_packed(df: DataFrame, key: str, field: str, known_values: list[str] | None = None, joiners: tuple[str, ...] = ("and", "&", "+", "/", "·", "•")) -> DataFrame:
    """(row_key, field_name, item_position, item_value): every value packed in `field`, positions from 1.

    Separators are , ; | tab and line breaks. Values lose outer blanks and quotes (straight, typographic), doubled quotes
    inside become single, separators within quotes or round brackets belong to the value; a quote without its partner is an
    ordinary character. Brackets around a whole list are dropped. With known_values (at most 5,000, else ValueError) these
    are found first, longest first, and every other quote, bracket, blank and joiner separates; unknown words between
    separators come out too. NULL, empty and blank fields and empty values give no row; rows with a NULL or
    repeated key are handled like any other; an empty table gives an empty result; a field of any length is one row's work.

    Method: atoms are known values, runs of ordinary characters, or single signs. Masking the runs gives a skeleton; the
    rule (which atoms make up which value) is resolved once for each distinct skeleton, in parallel, and applied
    to the atoms by position. The rules are broadcast if they take less than 16 MB; else they are joined, with those
    of very frequent skeletons broadcast.
    """
    known = sorted(set(known_values or []), key=lambda v: (-len(v), v))
    if len(known) > MAX_KNOWN:
        raise ValueError("too many known values for one pattern")
    signs = re.escape("".join(dict.fromkeys(SEPARATORS + " " + "".join(QUOTES) + "".join(QUOTES.values()) + "".join(BRACKETS) + "".join(BRACKETS.values()))))
    quoted = lambda values: "|".join(re.sub(r"([^\w\s])", r"\\\1", v) for v in values)
    words = [w for w in joiners if w.isalpha()] if known else []
    marks = "".join(re.escape(w) for w in joiners if not w.isalpha()) if known else ""
    kinds = []
    if known:
        kinds.append(("v", rf"(?<![\p{{L}}\p{{N}}_])(?:{quoted(known)})(?![\p{{L}}\p{{N}}_]|\.\p{{N}})"))
        kinds.append(("s", rf"(?<![\p{{L}}\p{{N}}_])(?:{quoted(words)})(?![\p{{L}}\p{{N}}_])|[{marks}]" if words else rf"[{marks}]"))
        # a run of ordinary characters ends before a joining sign
        kinds.append(("a", rf"[^{signs}{marks}]+"))
    else:
        kinds.append(("a", rf"[^{signs}]+"))
    atom = "|".join(f"(?:{p})" for _, p in kinds) + "|[\\s\\S]"
    rows = df.select(F.col(key).alias("row_key"), F.col(field).cast("string").alias("packed")).where(F.trim("packed") != "")
    rows = rows.select("row_key", F.regexp_extract_all("packed", F.lit(atom), F.lit(0)).alias("atoms"))
    kind = lambda x: F.when(F.length(x) == 1, F.when(x.rlike(f"^[{signs}]$"), x)).otherwise(F.lit(None))

    def mask(x):
        m = kind(x)
        if known:
            m = F.coalesce(F.when(x.isin(known), F.lit("v")), F.when(x.isin(list(joiners)), F.lit("s")), m)
        return F.coalesce(m, F.lit("a"))

    rows = stage(rows.withColumn("skeleton", F.array_join(F.transform("atoms", mask), "")), "packed-rows")
    has_known = bool(known)

    def rules(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["rules"] = [[{"start": s, "n": n, "quote": q} for s, n, q in resolve(x, has_known)] for x in f["skeleton"]]
            yield f

    found = stage(rows.groupBy("skeleton").agg(F.count(F.lit(1)).alias("weight")).mapInPandas(rules, f"skeleton string, weight bigint, rules {RULES}"), "packed-rules")
    size = found.agg(F.sum(F.octet_length("skeleton") + 40 * F.size("rules"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        met = join_null_safe(rows, F.broadcast(found.drop("weight")), ["skeleton"])
    else:
        met = join_weighted(rows, found, ["skeleton"], "weight")

    def value(r):
        v = F.array_join(F.slice("atoms", r["start"], r["n"]), "")
        return F.when(r["quote"] != "", F.replace(v, F.concat(r["quote"], r["quote"]), r["quote"])).otherwise(v)

    return met.select("row_key", F.lit(field).alias("field_name"), F.posexplode(F.transform("rules", value)).alias("item_position", "item_value")).withColumn("item_position", F.col("item_position") + 1)

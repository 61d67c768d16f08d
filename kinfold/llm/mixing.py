"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source should be copied ``target / source size`` times. The whole part is certain; the fractions are
made 0 or 1 by pairing documents and moving words at random from one to the other until one of the two is settled. A
move keeps the expected copies of each document and the expected words of the pair, so a source ends at its target but
for one document. Pairs are taken large documents first, so what is left over is small. Documents are paired within
buckets of bounded size, what each bucket leaves over is paired on the next level, until one is left per source. That one
is rounded at random, and the words this moves are given back in whole documents of its last group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.session import materialize

from . import tokens as T
from .sides import narrow

WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3.0
FAN = 2048
_WORD = "[^\\x20\\x09-\\x0D]+"
_EPS = 1e-9


def word_count(text):
    """Number of runs of characters other than blanks and the controls 9 to 13; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """``(source, source_no, source_size, target)`` from ``(source, size)`` rows.

    Sources in code point order, null last, weigh 5, 2, 1 and again. They share all words by weight; a target stops at
    three times its source, and what is above goes to the others by weight until none is above: sources are taken by
    the level at which they fill up, and the level is that of the first source which the rest does not fill.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("source_no") % len(WEIGHTS) + 1).cast("int"))
    ranked = sources.withColumn("source_no", number).withColumn("weight", weight).withColumn("most", MOST_COPIES * F.col("source_size"))
    by_level = Window.orderBy(F.col("most") / F.col("weight"), "source_no")
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = F.coalesce(F.sum("most").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(every) - filled) / open_weight
    stepped = ranked.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= F.col("most"))
    stepped = stepped.withColumn("place", F.row_number().over(by_level))
    final = F.min(F.when(F.col("fits"), F.struct("place", "level"))).over(every)
    return stepped.withColumn("final", final["level"]).select(
        "source", "source_no", "source_size", F.least(F.col("final") * F.col("weight"), F.col("most")).alias("target"))


def settle(p: np.ndarray, mass: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Make all fractions 0 or 1 but at most one, keeping ``sum(p * mass)``; documents come in the given order."""
    p = p.copy()
    carry = -1
    for j in range(len(p)):
        if not _EPS < p[j] < 1 - _EPS:
            p[j] = round(p[j])
            continue
        if carry < 0:
            carry = j
            continue
        i = carry
        up = min((1 - p[i]) * mass[i], p[j] * mass[j])
        down = min(p[i] * mass[i], (1 - p[j]) * mass[j])
        moved = up if draw[j] * (up + down) < down else -down
        p[i] += moved / mass[i]
        p[j] -= moved / mass[j]
        for k in (i, j):
            if not _EPS < p[k] < 1 - _EPS:
                p[k] = round(p[k])
        carry = i if 0 < p[i] < 1 else j if 0 < p[j] < 1 else -1
    return p


def give_back(p: np.ndarray, mass: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Round the one fraction left at random, and change settled documents, large ones first, by what that moved."""
    p = p.copy()
    for c in np.flatnonzero((p > 0) & (p < 1)):
        chosen = float(draw[c] < p[c])
        owed = (p[c] - chosen) * mass[c]
        p[c] = chosen
        for k in range(len(p)):
            if k != c and mass[k] <= abs(owed) and p[k] == float(owed < 0):
                p[k] = 1 - p[k]
                owed -= mass[k] if p[k] else -mass[k]
    return p


def _pairing(level: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["mass", "unit"], ascending=[False, True])
        keys = T.mix(pdf["unit"].to_numpy().view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) & (1 << 64) - 1))
        draw = (keys >> np.uint64(11)).astype(np.float64) / float(1 << 53)
        p = settle(pdf["p"].to_numpy(), pdf["mass"].to_numpy(), draw)
        p = give_back(p, pdf["mass"].to_numpy(), draw) if last else p
        return pdf.assign(p=p)[["source_no", "unit", "mass", "p"]]

    return run


def _round(units: DataFrame) -> DataFrame:
    """``(unit, extra)``: whether each unit takes one copy more than the whole part."""
    most = units.groupBy("source_no").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    current, settled, level = units.select("source_no", "unit", "mass", "p"), [], 0
    while True:
        buckets = -(-most // FAN)
        counts = current.groupBy("source_no").agg(F.count("*").alias("n"))
        placed = current.join(narrow(counts), "source_no").withColumn(
            "bucket", F.pmod(F.xxhash64("unit", F.lit(level)), F.ceil(F.col("n") / FAN)))
        done = materialize(placed.groupBy("source_no", "bucket").applyInPandas(_pairing(level, buckets <= 1), "source_no int, unit long, mass double, p double"))
        settled.append(done.filter("p = 0 OR p = 1").select("unit", F.col("p").cast("int").alias("extra")))
        current = done.filter("p > 0 AND p < 1")
        if buckets <= 1:
            break
        most, level = buckets, level + 1
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out


def mix(docs: DataFrame) -> DataFrame:
    """``(unit, doc_id, source, rows, size, source_size, target, copies)``: how often the mix takes each document.

    ``size`` is the number of words, null and empty texts have 0 and are taken as often as the whole part of
    ``target / source_size`` says. Rows with equal id, source and text are one unit with ``rows`` rows that share a
    decision; ``unit`` is a hash of the three. The same rows give the same mix, whatever their order or partitions.
    An empty table gives an empty mix.
    """
    unit = unit_key().alias("unit")
    units = docs.select(unit, "doc_id", "source", word_count(F.col("text")).alias("size"))
    units = materialize(units.groupBy("unit", "doc_id", "source", "size").agg(F.count("*").alias("rows")))
    targets = materialize(source_targets(units.select("source", (F.col("size") * F.col("rows")).alias("size"))))
    named = targets.withColumnRenamed("source", "_source")
    units = units.join(narrow(named), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(copies + _EPS)
    units = units.withColumn("whole", whole.cast("int")).withColumn("p", F.greatest(copies - whole, F.lit(0.0)))
    units = materialize(units.withColumn("mass", (F.col("size") * F.col("rows")).cast("double")))
    extra = _round(units.filter(f"mass > 0 AND p > {_EPS}"))
    return units.join(extra, "unit", "left").select(
        "unit", "doc_id", "source", "rows", "size", "source_size", "target",
        (F.col("whole") + F.coalesce("extra", F.lit(0))).alias("copies"))


def unit_key():
    """The key of a row in a mix."""
    nulls = F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in ("doc_id", "source", "text")])
    return F.xxhash64("doc_id", "source", "text", nulls)


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: a row for every copy, none for documents it leaves out."""
    decided = materialize(mix(docs).select(F.col("unit").alias("_mix_unit"), F.col("copies").alias("_mix_copies")))
    joined = docs.join(narrow(decided), unit_key() == F.col("_mix_unit")).filter("_mix_copies > 0")
    return joined.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies")))).select(*[docs[c] for c in docs.columns])

"""Removal of repeated and nearly repeated lines by a segment-partition edit join, in DataFrame functions only.

Lines within ``TAU`` edits must agree in one of ``TAU + 1`` segments, up to a shift the position of the segment bounds
(Li et al., Pass-Join, 2011). Every distinct line posts the segments of its own length and probes, with the few
substrings that the multi-match rule leaves, the lengths up to ``TAU`` shorter. A first pass finds the live keys, those
of two different lines, with an aggregate that is combined on the map side; only live keys are posted. The earliest line
of each list is verified first, which settles dense lists; what is left meets the earlier lines of its lists, where
letter counts, which ``TAU`` edits change by ``2 * TAU`` at most, drop nearly all pairs before they are made.
Verification strips what the lines share at both ends and runs a bit-parallel automaton over the band of diagonals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.session import materialize, release, scratch_path

from .sides import BROADCAST_ROWS, narrow

TAU = 2
MIN_CHARS = 16
_LETTERS = "etaonisrdlu."
_BITS = 21


def _segment(n: Column, i: int, tau: int) -> tuple[Column, Column]:
    """Start (from 1) and length of segment ``i`` of a line of ``n`` characters; the last ones are one longer."""
    parts = tau + 1
    base, longer = F.floor(n / parts).cast("int"), (n % parts).cast("int")
    short = parts - longer
    return F.lit(i) * base + F.greatest(F.lit(i) - short, F.lit(0)) + 1, base + F.when(F.lit(i) >= short, 1).otherwise(0)


def _postings(line: Column, n: Column, tau: int) -> Column:
    """All ``(key, probe)`` of a line; unshifted segments of its own length are posted, all others only probe."""
    found = []
    for delta in range(tau + 1):
        for i in range(tau + 1):
            start, length = _segment(n - delta, i, tau)
            low = max(-i, delta - (tau - i))
            high = min(i, delta + (tau - i))
            for shift in range(low, high + 1):
                key = F.xxhash64(n - delta, F.lit(i), F.substring(line, start + shift, length))
                found.append(F.struct(key.alias("key"), F.lit(delta != 0 or shift != 0).alias("probe")))
    return F.array(*found)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _shared_prefix(a: Column, b: Column) -> Column:
    """Characters the texts have in common at the front, by bisection over substrings."""
    most = F.least(F.length(a), F.length(b))
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(_BITS))])

    def longer(got, step):
        fits = (got + step <= most) & (F.substring(a, F.lit(1), got + step) == F.substring(b, F.lit(1), got + step))
        return F.when(fits, got + step).otherwise(got)

    return F.aggregate(steps, F.lit(0), longer)


def banded_distance(a: Column, b: Column, tau: int = TAU) -> Column:
    """Edit distance in characters if it is at most ``tau``, else null.

    State ``r[e]`` holds, as bits, the diagonals reachable with ``e`` edits after the characters of ``b`` read so far;
    ``2 * tau + 1`` diagonals are all a distance of ``tau`` can touch, so one integer a row is enough for any length.
    """
    width = 2 * tau + 1

    def walk(p: Column, t: Column) -> Column:
        m, n = F.length(p), F.length(t)
        chars = F.struct(F.split(p, "").alias("p"), F.split(t, "").alias("t"))
        reached = _let(chars, lambda c: last_row(c["p"], c["t"], n))
        goal = F.element_at(F.array(*[F.lit(1 << k) for k in range(width)]), m - n + tau + 1)
        result = lambda r: F.coalesce(*[F.when(goal.bitwiseAND(r[f"r{e}"]) != 0, F.lit(e)) for e in range(tau + 1)])
        return F.when(F.abs(m - n) > tau, None).when(F.least(m, n) == 0, F.greatest(m, n)).otherwise(_let(reached, result))

    def last_row(pc: Column, tc: Column, n: Column) -> Column:
        def step(r, j):
            here = F.get(tc, j)
            same = sum((F.when(F.get(pc, j + (k - tau)) == here, 1 << k).otherwise(0) for k in range(1, width)), F.when(F.get(pc, j - tau) == here, 1).otherwise(0))

            def rows(match):
                done = []
                for e in range(tau + 1):
                    value = r[f"r{e}"].bitwiseAND(match)
                    if e:
                        old = r[f"r{e - 1}"]
                        value = value.bitwiseOR(old).bitwiseOR(F.shiftright(old, 1)).bitwiseOR(F.shiftleft(done[-1], 1)).bitwiseAND((1 << width) - 1)
                    done.append(value)
                return F.struct(*[x.alias(f"r{e}") for e, x in enumerate(done)])

            return F.when(r[f"r{tau}"] == 0, r).otherwise(_let(same, rows))  # nothing comes back once no diagonal is left

        first = F.struct(*[F.lit(sum(1 << (tau + d) for d in range(e + 1))).alias(f"r{e}") for e in range(tau + 1)])
        return F.aggregate(F.sequence(F.lit(0), n - 1), first, step)

    def after_prefix(cut):
        x, y = F.substring(a, cut + 1, F.length(a)), F.substring(b, cut + 1, F.length(b))
        return _let(F.struct(F.reverse(x).alias("x"), F.reverse(y).alias("y")), lambda s: _let(
            _shared_prefix(s["x"], s["y"]),
            lambda end: _let(F.struct(F.substring(s["x"], end + 1, F.length(s["x"])).alias("x"), F.substring(s["y"], end + 1, F.length(s["y"])).alias("y")),
                             lambda s2: walk(s2["x"], s2["y"]))))

    return F.when(F.abs(F.length(a) - F.length(b)) <= tau, _let(_shared_prefix(a, b), after_prefix))


def _occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """Every line with a letter or digit, with its row, its number from 0, a 64-bit hash of its text, and whether it has
    the characters to be compared by edits."""
    row = F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), F.col("doc_id").isNull(), "text").alias("row")
    lines = docs.filter("text IS NOT NULL").select(row, "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    lines = lines.withColumn("n", F.length("line")).withColumn("long", F.col("n") >= min_chars)
    return lines.filter(F.col("long") | F.col("line").rlike("[\\p{L}\\p{N}]")).withColumn("cid", F.xxhash64("line"))


def dropped_lines(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(row, dropped)``: the numbers of the lines that go, for each row of ``docs`` that loses any.

    Lines are in order of ``doc_id`` (null last) and number. A line goes if an earlier line has the same text, or, with
    ``min_chars`` characters or more, if the first line with its text has any earlier line of that length within ``tau``
    edits. Shorter lines without a letter or digit (blanks, braces, rules), which give a text its layout, and null texts
    stay. Rows with equal id and text are one document: what stays of one stays of the other.
    """
    spark = docs.sparkSession
    lines = _occurrences(docs.select("doc_id", "text"), min_chars)
    paths = {x: scratch_path(spark, x) for x in ("places", "postings", "posts", "texts", "rows", "links")}
    places = materialize(lines.select("row", "doc_id", "i", "cid", "long"), path=paths["places"])
    lines = lines.filter("long")
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "i", "cid")
    classes = materialize(places.groupBy("cid").agg(F.min(place).alias("pos"), F.count("*").alias("times"), F.min("long").alias("long")))

    # a text posts once, from its first place, which so is the place of its class
    copied = classes.filter("times > 1 AND long").select(F.col("cid").alias("c_cid"), F.col("pos.doc_id").alias("c_doc"), F.col("pos.i").alias("c_i"))
    single = lines.join(narrow(copied), F.col("cid") == F.col("c_cid"), "left")
    single = single.filter(F.col("c_cid").isNull() | (F.col("doc_id").eqNullSafe(F.col("c_doc")) & (F.col("i") == F.col("c_i"))))
    posted = single.select("cid", place.alias("pos"), F.explode(_postings(F.col("line"), F.col("n"), tau)).alias("p")).select("p.key", "cid", "p.probe", "pos")
    posted = materialize(posted, path=paths["postings"])
    live = posted.groupBy("key").agg(F.min("cid").alias("a"), F.max("cid").alias("b")).filter("a <> b").select("key")
    posts = materialize(posted.join(narrow(materialize(live)), "key", "left_semi").distinct(), path=paths["posts"])
    release(spark, paths.pop("postings"))

    counts = [(F.length("line") - F.length(F.replace(F.col("line"), F.lit(c)))).alias(f"c{k}") for k, c in enumerate(_LETTERS)]
    wanted = materialize(posts.select("cid").distinct())
    texts = lines.join(narrow(wanted), "cid", "left_semi").select("cid", "line", "n", *counts).dropDuplicates(["cid"])
    texts = materialize(texts, path=paths["texts"])
    rows = materialize(posts.join(texts.drop("line"), "cid"), path=paths["rows"])
    release(spark, paths.pop("posts"))

    def side(prefix: str, frame: DataFrame) -> DataFrame:
        return frame.select(*[F.col(c).alias(f"{prefix}_{c}") for c in frame.columns])

    close = sum((F.abs(F.col(f"l_c{k}") - F.col(f"r_c{k}")) for k in range(1, len(_LETTERS))), F.abs(F.col("l_c0") - F.col("r_c0"))) <= 2 * tau

    def verified(pairs: DataFrame) -> DataFrame:
        one = texts.select(F.col("cid").alias("l_cid"), F.col("line").alias("l_line"))
        two = texts.select(F.col("cid").alias("r_cid"), F.col("line").alias("r_line"))
        checked = pairs.join(one, "l_cid").join(two, "r_cid")
        return checked.filter(banded_distance(F.col("l_line"), F.col("r_line"), tau).isNotNull()).select(F.col("l_cid").alias("cid")).distinct()

    head = F.struct("pos", *[c for c in rows.columns if c not in ("key", "probe", "pos")])
    first = rows.groupBy("key").agg(F.min(head).alias("head")).select("key", "head.*")
    meet = (F.col("l_key") == F.col("r_key")) & (F.col("r_pos") < F.col("l_pos")) & close
    star = side("l", rows.drop("probe")).join(side("r", first), meet).select("l_cid", "r_cid").distinct()
    settled = materialize(verified(star), path=paths["links"])

    left, right = side("l", rows.join(settled, "cid", "left_anti")), side("r", rows)
    meet &= ~(F.col("l_probe") & F.col("r_probe")) & (F.abs(F.col("l_n") - F.col("r_n")) <= tau)
    rest = verified(left.join(right, meet).select("l_cid", "r_cid").distinct())

    near = settled.unionByName(rest).distinct().withColumn("near", F.lit(True))
    fates = classes.join(near, "cid", "left").filter("times > 1 OR near").select(
        "cid", F.col("pos.doc_id").alias("first_doc"), F.col("pos.i").alias("first_i"), F.coalesce("near", F.lit(False)).alias("near"))
    fates = materialize(fates)
    hit = places.join(narrow(fates), "cid")
    hit = hit.filter(F.col("near") | ~(F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("i") == F.col("first_i"))))
    out = materialize(hit.groupBy("row").agg(F.collect_set("i").alias("dropped")))
    release(spark, *paths.values())
    return out


def dedup_lines(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with ``text`` less its repeated lines, and ``dropped_lines``, the numbers (from 0) of the lines that went.

    All other columns and all rows stay (a column already named ``dropped_lines`` is replaced); a null text stays null, a text without repeats stays as it is, a text all of whose lines
    went becomes empty. See ``dropped_lines`` for what counts as repeated.
    """
    docs = docs.drop("dropped_lines")
    gone = dropped_lines(docs, tau, min_chars).select(F.col("row").alias("_dedup_row"), F.col("dropped").alias("dropped_lines"))
    lines = gone.agg(F.sum(F.size("dropped_lines")).alias("n")).first()["n"] or 0
    gone = F.broadcast(gone) if lines <= BROADCAST_ROWS else gone
    row = F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), F.col("doc_id").isNull(), "text")
    marked = docs.withColumn("_dedup_row", row).join(gone, "_dedup_row", "left").drop("_dedup_row")
    every = F.split("text", "\n", -1)
    left = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(every) - 1), F.col("dropped_lines")))
    kept = F.array_join(F.transform(left, lambda i: F.get(every, i)), "\n")
    return marked.withColumn("text", F.when(F.col("dropped_lines").isNull(), F.col("text")).otherwise(kept))

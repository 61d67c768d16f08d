import random

import pytest
from pyspark.sql import functions as F

from kinfold.llm import line_dedup
from kinfold.llm.line_dedup import banded_distance, dedup_lines

SCHEMA = "doc_id long, text string, dropped_lines string, line string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def edited(rng, text, times):
    out = list(text)
    for _ in range(times):
        at = rng.randint(0, len(out))
        kind = rng.randint(0, 2)
        if kind == 0 or at == len(out):
            out.insert(at, rng.choice("abé"))
        elif kind == 1:
            del out[at]
        else:
            out[at] = rng.choice("abé")
    return "".join(out)


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_banded_distance(spark, tau):
    rng = random.Random(3)
    pairs = [(a, edited(rng, a, rng.randint(0, tau + 2))) for a in ("".join(rng.choice("abé") for _ in range(rng.randint(0, 25))) for _ in range(150))]
    pairs.append(("x" * 40_000 + "a", "x" * 40_000 + "bc"))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", banded_distance(F.col("a"), F.col("b"), tau).alias("d")).collect()
    for r in got:
        want = 2 if len(r.a) > 1000 else distance(r.a, r.b)
        assert r.d == (want if want <= tau else None), (r.a[-30:], r.b[-30:])


def expected(rows, tau=2, least=16):
    counts = lambda line: len(line) >= least or any(c.isalnum() for c in line)
    places = sorted({(d is None, d or 0, i, line) for d, t in rows if t is not None for i, line in enumerate(t.split("\n")) if counts(line)})
    first = {}
    for p in places:
        first.setdefault(p[3], p[:3])
    long = [m for m in first if len(m) >= least]
    near = {x for x in long if any(first[m] < first[x] and abs(len(m) - len(x)) <= tau and distance(x, m) <= tau for m in long if m != x)}
    out = []
    for d, t in rows:
        if t is None:
            out.append((d, None))
            continue
        lines = t.split("\n")
        out.append((d, "\n".join(x for i, x in enumerate(lines) if not counts(x) or (x not in near and first[x] == (d is None, d or 0, i)))))
    return sorted(out, key=repr)


def test_against_all_pairs(spark):
    rng = random.Random(8)
    bases = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randint(10, 40))) for _ in range(30)]
    rows = [(i, "\n".join(edited(rng, rng.choice(bases), rng.choice([0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 5)))) for i in range(90)]
    rows += [(None, rows[3][1]), (None, "a null id stands after all others"), (200, None), (201, ""), (202, "\n\n"), rows[7], (8, "another text with an id that is there")]
    found = dedup_lines(spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA))
    assert sorted(((r.doc_id, r.text) for r in found.collect()), key=repr) == expected(rows)


def test_dense_group_of_unlike_lines(spark):
    rng = random.Random(9)
    base = [rng.choice(["alpha", "beta", "gamma", "delta"]) + str(k) for k in range(20)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(2):
            words[rng.randrange(20)] = "word" + str(rng.randint(0, 400))
        rows.append((i, " ".join(words)))
    found = dedup_lines(spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA))
    assert sorted(((r.doc_id, r.text) for r in found.collect()), key=repr) == expected(rows)


def test_short_lines_go_by_their_exact_text_and_layout_stays(spark):
    rows = [(1, "Home\n}\n\nContact"), (2, "home\nHome\n}\n\n---"), (3, "Contact\n---\n确认"), (4, "确认\nContacts\nHome"), (5, "Home"), (5, "Home"), (None, "}\nContact")]
    found = sorted(((r.doc_id, r.text) for r in dedup_lines(spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)).collect()), key=repr)
    assert found == expected(rows)
    assert (2, "home\n}\n\n---") in found and (4, "Contacts") in found and found.count((5, "")) == 2 and (None, "}") in found


def test_empty_table_and_nothing_repeated(spark):
    assert dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0
    row = dedup_lines(spark.createDataFrame([(1, "a line of its own, long enough", "x", "y")], SCHEMA)).first()
    assert row.text == "a line of its own, long enough" and row.dropped_lines is None and row.line == "y"


def test_main_path_is_native(spark):
    plan = dedup_lines(spark.createDataFrame([(1, "a line of its own, long enough", "x", "y")], SCHEMA))._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def test_no_step_is_planned_with_many_joins(spark, monkeypatch):
    """The driver plans a step anew after each of its stages, so a step with many joins is what its memory goes into."""
    joins, write = [], line_dedup.materialize

    def counted(df, **options):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return write(df, **options)

    monkeypatch.setattr(line_dedup, "materialize", counted)
    rows = [(1, "a line that comes again, long enough"), (2, "a line that comes again, long enouhg"), (3, "a line that comes aga1n, long enough")]
    found = dedup_lines(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA))
    assert sorted((r.doc_id, r.text) for r in found.collect()) == expected(rows)
    assert max(joins) <= 5

"""Text functions, Column in and Column out.

Everything but Jaro-Winkler is a composition of built-in expressions. Jaro-Winkler is an Arrow batch function because
its greedy matching has no built-in equivalent; the operators call it on distinct value pairs only.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import jaro

# The batch function travels inside the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(jaro)

# The code points with the Unicode White_Space property.
WHITESPACE = "".join(
    map(chr, (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
)


def strip(c: Column) -> Column:
    """Remove leading and trailing whitespace of every kind (``trim`` alone knows only U+0020)."""
    return F.btrim(c, F.lit(WHITESPACE))


def is_blank(c: Column) -> Column:
    """True for null, empty and whitespace-only text."""
    return c.isNull() | (strip(c.cast("string")) == "")


def normalize(c: Column) -> Column:
    """Comparison form: text, stripped, lower case. Null stays null."""
    return F.lower(strip(c.cast("string")))


def comparison_value(c: Column, blank_as_null: bool = False) -> Column:
    """Comparison form of a record's value; on request empty text counts as missing."""
    return F.nullif(normalize(c), F.lit("")) if blank_as_null else normalize(c)


def title_case(c: Column) -> Column:
    """Upper-case every letter that follows a non-letter, lower-case the rest (``O'Brien Mary-Jane``)."""
    lowered = F.lower(c)
    pieces = F.transform(F.split(lowered, r"(?<=[^\p{L}])"), F.initcap)
    return F.when(lowered.rlike(r"[^\p{L} ]"), F.array_join(pieces, "")).otherwise(F.initcap(lowered))


# Metaphone after L. Philips (1990). Lower-case letters are still to be coded, upper-case letters and 0 are codes, so a
# later rule never touches what an earlier rule has produced. What no rule changes codes as itself or by _LETTERS.
_SILENT = "|".join(
    (
        r"^[kgp](?=n)", r"^w(?=r)", r"^a(?=e)",       # knee, gnome, pneu, write, aesop
        r"(?<=m)b(?= |$)",                            # dumb
        r"t(?=ch)", r"c(?=k)",                        # match, back
        r"gh(?![aeiou])",                             # night
        r"(?<=^w)h", r"(?<=[aeiou])h(?![aeiou])",     # whale, hurrah
        r"^w(?!h?[aeiou])", r"(?<!^)w(?![aeiou])", r"y(?![aeiou])",
    )
)
_METAPHONE_RULES = (
    (r"\s+", " "),
    (r"([abd-z])\1+", "$1"),                          # doubled letters count once, cc excepted
    (_SILENT, ""),
    (r"gn(?= |$)", "N"),                              # sign
    (r"c(?=ia)|ch|sh|[st](?=i[oa])", "X"),
    (r"c(?=[iey])|(?<![^ ])x", "S"),
    (r"x", "KS"),
    (r"d?g(?=[iey])", "J"),
    (r"ph", "F"),
    (r"th", "0"),
    (r"(?<=[^ ])[aeiou]", ""),                        # vowels are kept at the start of a word only
)
_LETTERS = ("cdgqvz", "KTKKFS")


def metaphone(c: Column) -> Column:
    """Phonetic code of the letters and spaces of ``c``; words stay separated. Empty text has the empty code."""
    out = F.lower(strip(F.regexp_replace(c, r"[^a-zA-Z\s]", "")))
    for pattern, replacement in _METAPHONE_RULES:
        out = F.regexp_replace(out, pattern, replacement)
    return F.upper(F.translate(out, *_LETTERS))


def levenshtein_distance(a: Column, b: Column) -> Column:
    """Edit distance of the comparison forms; against a null side, the length of the other."""
    x, y = F.coalesce(normalize(a), F.lit("")), F.coalesce(normalize(b), F.lit(""))
    return F.levenshtein(x, y)


def guarded_similarity(x: Column, y: Column, similarity: Column) -> Column:
    """The null and empty rules shared by both similarities, over values already in comparison form."""
    return (
        F.when(x.isNull() | y.isNull(), F.lit(0.0))
        .when((x == "") & (y == ""), F.lit(1.0))
        .when((x == "") | (y == ""), F.lit(0.0))
        .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), similarity)))
    )


def levenshtein_similarity_normalized(x: Column, y: Column) -> Column:
    longest = F.greatest(F.length(x), F.length(y), F.lit(1))
    return guarded_similarity(x, y, 1.0 - F.levenshtein(x, y).cast("double") / longest.cast("double"))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """``1 - distance / longer length`` in [0, 1]; null scores 0, two empty texts 1, one empty text 0."""
    return levenshtein_similarity_normalized(normalize(a), normalize(b))


_jaro_winkler_udf = F.arrow_udf(jaro.jaro_winkler_arrow, T.DoubleType())
# Said not to be deterministic so that Spark leaves a filter on the score above it: a filter pushed down scores all again.
_jaro_winkler_once_udf = F.arrow_udf(jaro.jaro_winkler_arrow, T.DoubleType()).asNondeterministic()


def jaro_winkler_normalized(x: Column, y: Column, once: bool = False) -> Column:
    """``once``: the score is worked out in one place of the plan, also where a filter reads it; not for join conditions."""
    return guarded_similarity(x, y, (_jaro_winkler_once_udf if once else _jaro_winkler_udf)(x, y))


def jaro_winkler(a: Column, b: Column) -> Column:
    """Jaro-Winkler of the comparison forms; null scores 0, two empty texts 1, one empty text 0."""
    return jaro_winkler_normalized(normalize(a), normalize(b))


def jaro_winkler_raw(a: Column, b: Column) -> Column:
    """Jaro-Winkler of the texts as they are (case-sensitive)."""
    return _jaro_winkler_udf(a, b)


def register_sql_functions(spark: SparkSession) -> None:
    """Make ``metaphone``, ``jaro_winkler`` and ``levenshtein_similarity`` callable from SQL text."""
    spark.udf.register("jaro_winkler_raw", _jaro_winkler_udf)
    whitespace = "".join(f"\\u{ord(ch):04x}" for ch in WHITESPACE)
    norm = f"lower(btrim({{0}}, '{whitespace}'))"
    x, y = norm.format("a"), norm.format("b")
    guard = (
        f"CASE WHEN a IS NULL OR b IS NULL THEN 0.0D WHEN {x} = '' AND {y} = '' THEN 1.0D "
        f"WHEN {x} = '' OR {y} = '' THEN 0.0D ELSE {{0}} END"
    )
    distance = f"levenshtein({x}, {y}) / greatest(length({x}), length({y}), 1)"
    code = f"lower(btrim(regexp_replace(t, r'[^a-zA-Z\\s]', ''), '{whitespace}'))"
    for pattern, replacement in _METAPHONE_RULES:
        code = f"regexp_replace({code}, r'{pattern}', '{replacement}')"
    code = f"upper(translate({code}, '{_LETTERS[0]}', '{_LETTERS[1]}'))"
    for signature, body in (
        ("jaro_winkler(a STRING, b STRING) RETURNS DOUBLE", guard.format(f"jaro_winkler_raw({x}, {y})")),
        ("levenshtein_similarity(a STRING, b STRING) RETURNS DOUBLE", guard.format(f"1.0D - {distance}")),
        ("metaphone(t STRING) RETURNS STRING", code),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")

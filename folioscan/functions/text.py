"""Normalising and scoring answers. All are column expressions; no Python runs on the executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_ANSWERABLE = "not-answerable"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"


def bind(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value found once, however often it is used: an expression stays small for the compiler."""
    return F.transform(F.array(value), then)[0]


def strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\A\s+", ""), r"\s+\z", "")


def preprocess(text: Column) -> Column:
    """Lower case without surrounding white space; a null is the empty text."""
    return strip(F.lower(F.coalesce(text, F.lit(""))))


def normal_answers(answers: Column) -> Column:
    """Distinct answers in lower case; none counts as one empty answer."""
    return F.coalesce(F.array_distinct(F.transform(answers, F.lower)), F.array(F.lit("")))


def whole(text: Column, pattern: str) -> Column:
    return text.rlike(rf"\A(?:{pattern})\z")


def is_special(text: Column) -> Column:
    """Answers that must match exactly: links, code files, page references, numbers, times, dates, addresses."""
    out = F.contains(text, F.lit("https://")) | F.contains(text, F.lit("http://"))
    out |= text.endswith(".py") | text.endswith(".ipynb") | text.startswith("page")
    out |= whole(text, r"\d+(-\d+|\s\d+)?") | F.contains(text, F.lit("a.m.")) | F.contains(text, F.lit("p.m."))
    out |= whole(text, r"\d{4}[-\s]\d{2}[-\s]\d{2}") | whole(text, r"\d{4}[-\s]\d{2}")
    return out | whole(text, EMAIL)


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.try_divide(F.levenshtein(a, b).cast("double"), longest.cast("double")))


def anls_strict(gold: Column, pred: Column, least: float = 0.5) -> Column:
    """The similarity, 0 unless above `least`; edits are counted only as far as that allows."""
    longest = F.greatest(F.length(gold), F.length(pred))
    edits = F.call_function("levenshtein", gold, pred, F.floor(longest * (1 - least) + 1e-9).cast("int"))
    s = F.when(longest == 0, 1.0).when(edits < 0, 0.0).otherwise(1 - F.try_divide(edits.cast("double"), longest.cast("double")))
    return bind(s, lambda s: F.when(s > least, s).otherwise(0.0))


#: What Python's int() and float() read, without the surrounding white space.
_INT = r"[+-]?\d+(?:_\d+)*"
_FLOAT = r"[+-]?(?:\d+(?:_\d+)*(?:\.(?:\d+(?:_\d+)*)?)?|\.\d+(?:_\d+)*)(?:e[+-]?\d+(?:_\d+)*)?"
_NO_NUMBER = r"[+-]?(?:nan|inf|infinity)"


def whole_number(text: Column) -> Column:
    """The integer that a text spells; null for anything else, a decimal point included."""
    t = strip(text)
    return F.when(whole(t, _INT), F.regexp_replace(t, "_", "").try_cast("decimal(38,0)"))


def number(text: Column) -> Column:
    """The number that a text in lower case spells; null for anything else, and NaN for what is read but equals nothing."""
    t = strip(text)
    return F.when(whole(t, _FLOAT), F.regexp_replace(t, "_", "").try_cast("double")).when(whole(t, _NO_NUMBER), F.lit(float("nan")))


def truncated(x: Column) -> Column:
    """The number without its fraction, towards zero; null for NaN and what is too large."""
    return F.when(~F.isnan(x), F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).try_cast("decimal(38,0)"))


def _without_percent(text: Column) -> Column:
    return F.regexp_replace(strip(text), r"%+\z", "")


def _parts(text: Column) -> Column:
    return F.array_sort(F.split(F.regexp_replace(text, r"\A[\[\]]+|[\[\]]+\z", ""), ","))


def _scored(golds: Column, pred: Column, kind: Column) -> Column:
    """accuracy of what is preprocessed."""
    typed = kind.isin("int", "float")
    read = lambda x: F.when(kind == "int", whole_number(x).cast("double")).otherwise(number(_without_percent(x)))
    as_number = lambda gs, p: F.forall(gs, lambda g: g.isNotNull()) & F.exists(gs, lambda g: F.when(kind == "int", g == p).otherwise(F.abs(p - g) < 0.01))
    given = F.when(kind == "int", truncated(number(pred)).cast("double")).otherwise(number(_without_percent(pred)))
    as_typed = bind(F.transform(golds, read), lambda gs: bind(given, lambda p: as_number(gs, p)))
    as_list = bind(_parts(pred), lambda p: F.exists(golds, lambda g: _parts(g) == p))
    found = F.when(kind == NOT_ANSWERABLE, pred.isin("", "none")).when(pred == "none", F.lit(False))
    found = found.when(F.exists(golds, is_special), F.array_contains(golds, pred))
    found = found.when(typed, F.coalesce(as_typed, F.lit(False))).when(kind == "list", as_list)
    return found.otherwise(F.array_contains(golds, pred)).cast("double")


def accuracy(golds: Column, pred: Column, kind: Column) -> Column:
    """1 or 0 for a prediction against an array of right answers of one type; a null type is a string's.

    One right answer that isn't of its type fails them all, as does a prediction that isn't. Whole numbers are compared as
    double-precision numbers.
    """
    return bind(preprocess(pred), lambda p: bind(F.transform(golds, preprocess), lambda g: _scored(g, p, kind)))


def anls(golds: Column, pred: Column, kind: Column, least: float = 0.5) -> Column:
    """The best similarity over the right answers if at least `least`; typed and special answers count by accuracy.

    An empty prediction never scores; an empty right answer, like a question without an answer, wants "none".
    """

    def score(g: Column, p: Column) -> Column:
        none = (F.coalesce(kind, F.lit("string")) == NOT_ANSWERABLE) | F.array_contains(g, "")
        found = F.when(p == "", 0.0).when(none, (p == "none").cast("double")).when(p == "none", 0.0)
        found = found.when(kind.isin("int", "float", "list") | F.exists(g, is_special), _scored(g, p, kind))
        return found.otherwise(bind(F.array_max(F.transform(g, lambda x: similarity(x, p))), lambda best: F.when(best >= least, best).otherwise(0.0)))

    return bind(preprocess(pred), lambda p: bind(F.transform(golds, preprocess), lambda g: score(g, p)))


def clean(text: Column) -> Column:
    """Lower case without what stands in parentheses, one quote on either side, leading dollar and trailing percent signs."""
    x = strip(F.regexp_replace(strip(F.lower(text)), r"\s*\([^)]*\)", ""))
    x = strip(F.regexp_replace(x, r"\A['\"]|['\"]\z", ""))
    return strip(F.regexp_replace(strip(F.regexp_replace(x, r"\A\$+", "")), r"%+\z", ""))


def decimals(x: Column) -> Column:
    """Digits behind the point of a number as Python writes it; 3 for one that it writes without a point."""

    def count(written: Column) -> Column:
        power = F.coalesce(F.when(F.contains(written, F.lit("E")), F.substring_index(written, "E", -1).cast("int")), F.lit(0))
        behind = F.substring_index(F.substring_index(written, "E", 1), ".", -1)
        digits = F.when(behind == "0", 0).otherwise(F.length(behind))
        scientific = (x != 0) & ((F.abs(x) < 1e-4) | (F.abs(x) >= 1e16))
        exponent = 2 + F.greatest(F.lit(2), F.length(F.abs(power).cast("string")))
        return F.when(scientific, F.when(digits == 0, 3).otherwise(digits + exponent)).otherwise(F.greatest(F.lit(1), digits - power))

    return bind(F.abs(x).cast("string"), count)


def float_equal(gold: Column, pred: Column) -> Column:
    """Within 1 % of the right number, its hundredth or its hundredfold, or equal when rounded to the fewer of their digits.

    They are rounded to two digits at least, and halves away from zero. NaN equals nothing.
    """

    def same(g: Column, p: Column, digits: Column) -> Column:
        rounded = lambda x, scale: F.floor(F.abs(x) * scale + 0.5) * F.signum(x)
        equal = lambda scale: rounded(p, scale) == rounded(g, scale)
        scale = F.pow(F.lit(10.0), F.greatest(F.lit(2), F.least(digits, decimals(g))))
        return (F.abs(g - p) <= 0.01 * F.greatest(F.abs(g), F.abs(p))) | bind(scale, equal)

    pair = F.struct(gold.alias("g"), pred.alias("p"), decimals(pred).alias("d"))
    found = bind(pair, lambda x: F.exists(F.array(x["g"] / 100, x["g"], x["g"] * 100), lambda g: same(g, x["p"], x["d"])))
    return F.when(gold.isNull() | pred.isNull() | F.isnan(gold) | F.isnan(pred), F.lit(False)).otherwise(found)


def is_exact(text: Column) -> Column:
    """Answers of the report that must match exactly: as is_special, but links are https alone, and notebooks need no dot."""
    shapes = whole(text, r"\d+(-\d+|\s\d+)?") | whole(text, r"\d{4}[-\s]\d{2}[-\s]\d{2}") | whole(text, r"\d{4}[-\s]\d{2}") | whole(text, EMAIL)
    return F.contains(text, F.lit("https://")) | text.endswith(".py") | text.endswith("ipynb") | text.startswith("page") | F.contains(text, F.lit("a.m.")) | F.contains(text, F.lit("p.m.")) | shapes


#: One item of a written list: quoted, with backslashes before quotes inside, or bare up to the next comma.
_ITEM = r"\s*('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|[^,'\"\[\]\s](?:[^,\[\]]*[^,\[\]\s])?)\s*(?:,|\z)"


def items(text: Column) -> Column:
    """The items of a list as it is written, [a, 'b, c']; any other text is one item. Nothing is evaluated."""
    inner = F.regexp_replace(text, r"\A\[|\]\s*\z", "")
    quoted = F.transform(F.regexp_extract_all(inner, F.lit(_ITEM), F.lit(1)), lambda x: F.when(x.rlike(r"\A['\"]"), F.regexp_replace(F.substring(x, 2, F.greatest(F.length(x) - 2, F.lit(0))), r"\\(.)", "$1")).otherwise(x))
    return F.when(whole(text, r"(?s)\[.*\]\s*"), quoted).otherwise(F.array(text))


def eval_score(gold: Column, pred: Column, kind: Column) -> Column:
    """The report's score: Int, Float, Str, None or List. What can't be read as its type scores 0."""

    def as_int(g: Column, p: Column) -> Column:
        return bind(whole_number(g), lambda a: bind(truncated(number(F.lower(p))), lambda b: F.when(a.isNotNull() & b.isNotNull(), a == b).otherwise(g == "")))

    def as_float(g: Column, p: Column) -> Column:
        return bind(number(clean(g)), lambda a: bind(number(clean(p)), lambda b: float_equal(a, b)))

    def as_text(g: Column, p: Column) -> Column:
        return bind(clean(g), lambda a: bind(clean(p), lambda b: F.when(is_exact(a), (a == b).cast("double")).otherwise(anls_strict(a, b))))

    def as_list(g: Column, p: Column) -> Column:
        first = lambda a: F.try_element_at(a, F.lit(1))
        exact = lambda a: bind(first(a), lambda x: number(x).isNotNull() | is_exact(x))
        held = lambda a, b: F.when((F.size(a) != F.size(b)) | (F.size(a) == 0), 0.0).when(exact(a), (F.array_join(a, "-") == F.array_join(b, "-")).cast("double")).otherwise(F.array_min(F.zip_with(a, b, lambda x, y: anls_strict(x, y))))
        each = lambda x: F.array_sort(F.transform(items(x), clean))
        return bind(each(g), lambda a: bind(each(p), lambda b: held(a, b)))

    def score(g: Column, p: Column) -> Column:
        found = F.when(kind == "Int", as_int(g, p).cast("double")).when(kind == "Float", as_float(g, p).cast("double"))
        return found.when(kind.isin("Str", "None"), as_text(g, p)).otherwise(as_list(g, p))

    return bind(F.coalesce(gold, F.lit("")), lambda g: bind(F.coalesce(pred, F.lit("")), lambda p: score(g, p)))

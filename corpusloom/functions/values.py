"""Dates, numbers and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

# Accepted forms of an edit date, in the order tried.
DATE_FORMATS = ("yyyy-M-d'T'H:m:s'Z'", "yyyy-M-d'T'H:m:s", "yyyy-M-d", "yyyy-M-d H:m:s")


def parse_edit_date(x: Column | str) -> Column:
    """Timestamp of the first form that fits, else null; a trailing Z is read as is."""
    x = F.col(x) if isinstance(x, str) else x
    return F.coalesce(*[F.try_to_timestamp(x, F.lit(f)) for f in DATE_FORMATS])


def human_date(x: Column | str) -> Column:
    return F.date_format(x, "MMMM dd, yyyy")


def iso_date(x: Column | str) -> Column:
    return F.date_format(x, "yyyy-MM-dd")


def short_date_to_iso(x: Column | str) -> Column:
    """'M:D:YY' of the old layout, taken as 20YY."""
    x = F.col(x) if isinstance(x, str) else x
    part = lambda i: F.lpad(F.regexp_extract(x, r"^(\d{1,2}):(\d{1,2}):(\d{2})$", i), 2, "0")
    return F.when(x.rlike(r"^\d{1,2}:\d{1,2}:\d{2}$"), F.concat(F.lit("20"), part(3), F.lit("-"), part(1), F.lit("-"), part(2)))


def modified_since(edited: Column, previous: str, days: int = 30) -> Column:
    """Edited after the previous run less ``days``; a date that cannot be read passes."""
    return F.coalesce(edited >= F.date_sub(F.lit(previous).cast("date"), days), F.lit(True))


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def truncate_and_normalize(v: Column | str, dimensions: int) -> Column:
    """First ``dimensions`` components at length one; a zero vector stays."""
    head = F.slice(v, 1, dimensions)
    n = norm(head)
    return F.when(n > 0, F.transform(head, lambda x: x.cast("double") / n)).otherwise(F.transform(head, lambda x: x.cast("double")))


def sign_bits(v: Column | str, dimensions: int) -> Column:
    """Signs packed 32 to a long; a lambda over slices, as an expression for each dimension would be compiled for long."""
    one = F.lit(1).cast("long")
    bit = lambda x, i: F.when(x > 0, F.call_function("shiftleft", one, i)).otherwise(F.lit(0).cast("long"))
    word = lambda w: F.aggregate(F.transform(F.slice(v, w * 32 + 1, F.lit(32)), bit), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))
    return F.transform(F.sequence(F.lit(0), F.lit((dimensions - 1) // 32)), word)


def differing_bits(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def softmax(score: Column, over: WindowSpec | list[str]) -> Column:
    """exp(score) over its sum in the window; the largest score is subtracted first, so no score overflows."""
    w = Window.partitionBy(*over) if isinstance(over, list) else over
    raised = F.exp(score - F.max(score).over(w))
    return raised / F.sum(raised).over(w)


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Of two token arrays taken as sets; two empty ones score 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def yes_probability(top: Column | str, temperature: float = 5.0) -> Column:
    """Share of 'yes' among the yes and no tokens of array<struct<token, logprob>>, tempered; null without either."""
    low = lambda x: F.lower(x["token"])
    said = F.filter(top, lambda x: low(x).contains("yes") | (low(x).contains("no") & ~low(x).contains("not")))
    weigh = lambda items: F.aggregate(items, F.lit(0.0), lambda s, x: s + F.exp(x["logprob"] / temperature))
    return F.when(F.size(said) > 0, weigh(F.filter(said, lambda x: low(x).contains("yes"))) / weigh(said))


def list_score(place: Column, size: Column) -> Column:
    """1 - i/n for the i-th (from 0) of n: a score that follows a list's order."""
    return 1 - place / size


def merged_options(defaults: Column | str, overrides: Column | str) -> Column:
    """Two maps as one; the second one's values win."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (defaults, overrides))
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def available_languages(links: Column | str, labels: Column | str, left_out: tuple[str, ...] = ("en", "en-gb", "en-ca", "commons", "simple")) -> Column:
    """map<language, name> of an entity's links and labels, a link before a label; without the languages ``left_out``."""
    merged = merged_options(labels, links)
    keys = F.array_except(F.map_keys(merged), F.array(*[F.lit(x) for x in left_out]))
    return F.map_filter(merged, lambda k, _: F.array_contains(keys, k))

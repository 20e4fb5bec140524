"""Column expressions that turn raw article cells into typed values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwind.functions import fixed_values as fixed

SINGLE_QUOTES = {"allowSingleQuotes": "true"}
SENTIMENT_FIELDS = "class string, polarity double, subjectivity double, corrupt string"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_sentiment(cell: str | Column, defaults: bool = True) -> Column:
    """Sentiment text (JSON or a Python dict) as ``struct(class, polarity, subjectivity, corrupt)``.

    With ``defaults`` a missing class becomes 'unknown' and a missing number 0; without, both stay NULL and the
    Python words None / True / False are understood too.
    """
    text = _col(cell)
    if not defaults:
        text = F.regexp_replace(text, r"(:\s*)None(\s*[,}])", "$1null$2")
    parsed = F.from_json(text, SENTIMENT_FIELDS, {**SINGLE_QUOTES, "columnNameOfCorruptRecord": "corrupt"})
    cls, pol, sub = parsed["class"], parsed["polarity"], parsed["subjectivity"]
    if defaults:
        cls, pol, sub = F.coalesce(cls, F.lit("unknown")), F.coalesce(pol, F.lit(0.0)), F.coalesce(sub, F.lit(0.0))
    return F.struct(
        cls.alias("class"),
        pol.alias("polarity"),
        sub.alias("subjectivity"),
        F.coalesce(parsed["corrupt"].isNotNull(), F.lit(False)).alias("corrupt"),
    )


def parse_list(cell: str | Column) -> Column:
    """A list cell as ``array<string>``; blank, malformed and non-list text, and lists holding null, give []."""
    empty = F.array().cast("array<string>")
    items = F.from_json(_col(cell), "array<string>", SINGLE_QUOTES)
    return F.when(F.exists(items, lambda x: x.isNull()), empty).otherwise(F.coalesce(items, empty))


def tone_score(cell: str | Column, normalize_case: bool = False) -> Column:
    """positive / neutral / negative as 1 / 0 / -1, anything else 0. Case matters unless normalized."""
    tone = F.lower(_col(cell)) if normalize_case else _col(cell)
    scored = reduce(
        lambda acc, kv: acc.when(tone == kv[0], F.lit(kv[1])), fixed.TONE_SCORES.items(), F.when(F.lit(False), 0)
    )
    return scored.otherwise(0)


def join_texts(*cells: str | Column, keep_blank: bool = True) -> Column:
    """Space-joined texts. Blank parts are kept (two spaces appear) or dropped; NULL counts as blank."""
    if keep_blank:
        return F.concat_ws(" ", *[F.coalesce(_col(c), F.lit("")) for c in cells])
    return F.concat_ws(" ", *[F.nullif(_col(c), F.lit("")) for c in cells])


def categorize(
    subject: str | Column, rules: list[tuple[str, list[str]]] | None = None, default: str = fixed.CATEGORY_DEFAULT
) -> Column:
    """The first rule with a substring of the lower-cased subject; NULL falls to ``default``."""
    text = F.coalesce(F.lower(_col(subject)), F.lit("nan"))
    out = None
    for name, needles in rules or fixed.CATEGORY_RULES:
        hit = reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in needles])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def iso_instant(cell: str | Column) -> Column:
    """ISO-8601 text, with ``Z`` or an offset, as an instant; bad text gives NULL."""
    return F.try_to_timestamp(_col(cell))


def percent(part: Column, whole: Column, digits: int | None = 1) -> Column:
    share = F.try_divide(part * F.lit(100.0), whole)
    return share if digits is None else F.round(share, digits)


def shorten(text: Column, limit: int = fixed.NAME_LENGTH) -> Column:
    """Cut text longer than ``limit`` so that it ends in three dots at exactly ``limit`` characters."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def capitalize(text: Column) -> Column:
    """First character upper, the rest lower."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 2**30)))


def title_case(text: Column) -> Column:
    """Upper-case each letter that does not follow a letter, lower-case the others."""
    letters_upper = F.regexp_replace(F.lower(text), r"(?<!\p{L})(\p{L})", "\u0001$1")
    parts = F.split(letters_upper, "\u0001")
    cased = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(capitalize(p)))
    return F.array_join(cased, "")


def fill_missing(df: DataFrame, texts=(), numbers=(), named: dict[str, str] | None = None) -> DataFrame:
    """NULL texts to '', NULL numbers to 0, and chosen columns to a chosen value."""
    values: dict[str, object] = {c: "" for c in texts} | {c: 0 for c in numbers} | (named or {})
    return df.fillna(values) if values else df


def columns_like(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def preprocess(df: DataFrame, normalize_case: bool = False) -> DataFrame:
    """All derived columns of an annotated article table, in one projection."""
    out = df.withColumn("_s", parse_sentiment("sentiment")).withColumns(
        {f"{c}_parsed": parse_list(c) for c in fixed.ANNOTATION_LISTS}
    )
    derived = {
        "sentiment_class": F.col("_s.class"),
        "sentiment_polarity": F.col("_s.polarity"),
        "sentiment_subjectivity": F.col("_s.subjectivity"),
        "sentiment_corrupt": F.col("_s.corrupt"),
        "crypto_category": categorize("subject"),
    }
    for c in fixed.ANNOTATION_LISTS:
        derived[f"{c}_count"] = F.size(f"{c}_parsed")
        derived[f"{c}_text"] = F.array_join(f"{c}_parsed", " ")
    for c in fixed.ANNOTATION_TONES:
        derived[f"{c}_score"] = tone_score(c, normalize_case)
    out = out.withColumns(derived).drop("_s")
    texts = [f"{c}_text" for c in fixed.ANNOTATION_LISTS]
    return out.withColumns(
        {
            "all_linguistic_features": join_texts(*texts),
            "all_verbs": join_texts("title_verbs_text", "text_verbs_text", keep_blank=False),
            "all_adjectives": join_texts("title_adjectives_text", "text_adjectives_text", keep_blank=False),
        }
    )

"""Text column expressions. Everything here stays inside the JVM except NFKC."""

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from folioscope import constants as K

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()

# White space as browsers see it: Java's \\s plus the Unicode spaces and the BOM. The
# range in front lets the matcher dismiss ASCII letters with one comparison.
_WIDE_SPACE = "\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACE = rf"[\x09-\x0d\x20[\u00a0-\ufeff&&[{_WIDE_SPACE}]]]"
SPACE_CHARACTERS = "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def let(value: Column, body) -> Column:
    """Evaluate `value` once and use it several times in `body`.

    A column used n times in nested expressions is copied n times into the plan;
    binding it to a lambda variable keeps the plan small.
    """
    return F.get(F.transform(F.array(value), body), 0)


def ascii_lower(c: Column) -> Column:
    """Fold A-Z only, the way the archive compares and sorts text."""
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def contains_ascii_nocase(c: Column, needle: str) -> Column:
    """Literal substring test that ignores ASCII case.

    Java folds only ASCII under (?i), so one pass of the matcher replaces
    a translated copy of the whole text.
    """
    if re.search("[A-Za-z]", needle):
        return c.rlike("(?i)" + quote(needle))
    return F.contains(c, F.lit(needle))


def quote(literal: str) -> str:
    """A regular expression that matches `literal` and nothing else."""
    return r"\Q" + literal.replace(r"\E", r"\E\\E\Q") + r"\E"


def js_trim(c: Column) -> Column:
    return F.trim(c, F.lit(SPACE_CHARACTERS))


def collapse_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def non_empty(c: Column) -> Column:
    """The value, or null for an empty string."""
    return F.nullif(c, F.lit(""))


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 code units, so characters outside the BMP count twice."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("bigint")


def round_half_up(c: Column) -> Column:
    return F.floor(c + F.lit(0.5))


# --- Markdown ---------------------------------------------------------------


def markdown_to_plain(md: Column) -> Column:
    return collapse_space(F.regexp_replace(md, K.PLAIN_MARKS, " "))


def markdown_to_plain_fenced(md: Column) -> Column:
    """Like markdown_to_plain, but code-fence marker lines and pipes go as well."""
    unfenced = F.regexp_replace(md, r"```(?:[^\n]*?```|[^\n]*\n([\s\S]*?)```)", " $1 ")
    return collapse_space(F.regexp_replace(unfenced, K.PLAIN_MARKS_WITH_PIPE, " "))


def normalize_markdown(md: Column) -> Column:
    c = F.regexp_replace(md, r"\n{4,}", "\n\n\n")
    c = F.regexp_replace(c, rf"\[{SPACE}*\]\([^)]*\)", "")
    c = F.regexp_replace(c, r"[ \t]+\n", "\n")
    return js_trim(c)


def content_length(md: Column) -> Column:
    return utf16_length(md)


def reading_minutes(md: Column) -> Column:
    cjk = F.regexp_count(md, F.lit(K.CJK_READING))
    words = F.regexp_count(md, F.lit("[A-Za-z0-9]+"))
    return F.greatest(F.lit(1), round_half_up(cjk / 300 + words / 220)).cast("bigint")


# --- cards ------------------------------------------------------------------


def _excerpt(candidate: Column, q: str) -> Column:
    at = F.instr(F.lower(candidate), F.lit(q.lower()))  # 1-based, 0 = no match
    return let(at, lambda position: _cut(candidate, position, q))


def _cut(candidate: Column, at: Column, q: str) -> Column:
    start = F.greatest(F.lit(0), at - F.lit(1 + 55))
    end = F.least(F.length(candidate), at - 1 + F.lit(len(q) + 105))
    body = markdown_to_plain(F.substring(candidate, start + 1, end - start))
    return F.when(
        at > 0,
        F.concat(
            F.when(start > 0, "…").otherwise(""),
            body,
            F.when(end < F.length(candidate), "…").otherwise(""),
        ),
    )


def matching_excerpt(note: Column, plain: Column, md: Column, q: str) -> Column:
    """Text around the first match of q in note, plain text or Markdown; else null."""
    if not q:
        return F.lit(None).cast("string")
    return F.coalesce(*[_excerpt(c, q) for c in (note, plain, md)])


def summary(
    excerpt: Column,
    description: Column,
    plain: Column,
    status: Column,
    characters: int = K.SUMMARY_CHARACTERS,
) -> Column:
    """The excerpt, else the description, else the first `characters` of the text."""
    return F.coalesce(
        non_empty(excerpt),
        non_empty(js_trim(description)),
        non_empty(F.substring(js_trim(plain), 1, characters)),
        F.when(status == "pending", K.PENDING_SUMMARY).otherwise(K.EMPTY_SUMMARY),
    )


def highlight_segments(text: Column, q: str) -> Column:
    """array<struct<segment, is_match>> covering the whole text."""
    if not q:
        return F.array(F.struct(text.alias("segment"), F.lit(False).alias("is_match")))
    pattern = "(?iu)" + quote(q)
    between = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.transform(
        between,
        lambda part, i: F.array(
            F.struct(part.alias("segment"), F.lit(False).alias("is_match")),
            F.struct(F.get(matches, i).alias("segment"), F.lit(True).alias("is_match")),
        ),
    )
    return F.filter(F.flatten(pairs), lambda s: s["segment"].isNotNull())


# --- quality ------------------------------------------------------------------


def cjk_characters(text: Column) -> Column:
    return F.regexp_count(text, F.lit(K.CJK_QUALITY))


def english_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(K.ENGLISH_WORD))


def text_stats(text: Column) -> Column:
    """struct of CJK characters, Latin words, paragraphs (blank-line blocks), characters."""
    paragraphs = F.filter(
        F.split(text, r"\n\s*\n"), lambda block: F.length(js_trim(block)) > 0
    )
    return let(
        collapse_space(text),
        lambda normalized: F.struct(
            cjk_characters(normalized).cast("bigint").alias("cjk_characters"),
            english_words(normalized).cast("bigint").alias("latin_words"),
            F.size(paragraphs).cast("bigint").alias("paragraphs"),
            utf16_length(normalized).alias("characters"),
        ),
    )


def content_quality(
    text: Column,
    paragraphs: Column,
    has_password: Column,
    login_within: int = K.LOGIN_WORDS_WITHIN,
) -> Column:
    """Null when the text is good enough, else JS_REQUIRED or CONTENT_TOO_SHORT.

    Words of a login page count within the first `login_within` characters of a short text.
    """

    def judge(normalized: Column) -> Column:
        size = utf16_length(normalized)
        login_words = F.substring(normalized, 1, login_within).rlike(K.LOGIN_WORDS)
        login = has_password | ((size < 800) & login_words)
        valid = (
            (english_words(normalized) >= 80)
            | (cjk_characters(normalized) >= 100)
            | ((paragraphs >= 3) & (size >= 240))
        )
        return F.when(login, "JS_REQUIRED").when(~valid, "CONTENT_TOO_SHORT")

    return let(collapse_space(text), judge)


# --- names --------------------------------------------------------------------


@F.pandas_udf(StringType())
def _nfkc_lower(names: pd.Series) -> pd.Series:
    return names.map(
        lambda s: unicodedata.normalize("NFKC", s).lower(), na_action="ignore"
    )


@F.pandas_udf(ArrayType(StringType()))
def nfkc_lower_lists(lists: pd.Series) -> pd.Series:
    """NFKC + lower case of every name in a list; takes a plain column."""
    return lists.map(
        lambda names: [unicodedata.normalize("NFKC", s).lower() for s in names],
        na_action="ignore",
    )


def tag_display_name(name: Column) -> Column:
    return collapse_space(name)


def normalize_tag_name(name: Column) -> Column:
    """Identity of a tag: NFKC + lower case. ASCII names never leave the JVM as text."""
    shown = tag_display_name(name)
    is_ascii = shown.rlike(r"^[\x00-\x7f]*$")
    return F.when(is_ascii, F.lower(shown)).otherwise(
        _nfkc_lower(F.when(~is_ascii, shown))
    )


def split_tag_names(text: Column) -> Column:
    trimmed = F.transform(F.split(text, "[,，]"), js_trim)
    return F.array_distinct(F.filter(trimmed, lambda name: F.length(name) > 0))


def safe_filename(title: Column, characters: int = K.FILENAME_CHARACTERS) -> Column:
    """A title as the name of a file, of at most `characters`."""
    cleaned = collapse_space(F.regexp_replace(title, K.UNSAFE_FILENAME, "-"))
    return F.coalesce(non_empty(F.substring(cleaned, 1, characters)), F.lit("bookmark"))


def sha_prefix(value: Column, length: int, upper: bool = False) -> Column:
    digest = F.substring(F.sha2(value, 256), 1, length)
    return F.upper(digest) if upper else digest


def json_string(value: Column) -> Column:
    """The value as a JSON string literal."""
    wrapped = F.to_json(F.struct(value.alias("v")))
    return F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)


def recency_label(ts: Column, now: Column) -> Column:
    minutes = round_half_up((F.unix_millis(now) - F.unix_millis(ts)) / 60_000)
    return let(minutes, lambda age: _recency(ts, now, age))


def _recency(ts: Column, now: Column, minutes: Column) -> Column:
    hours = round_half_up(minutes / 60)
    clock = F.date_format(ts, "HH:mm")
    month_day = F.concat(
        F.month(ts).cast("string"), F.lit("月"), F.dayofmonth(ts).cast("string"), F.lit("日")
    )
    return (
        F.when(minutes < 1, "刚刚")
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" 分钟前")))
        .when(
            (hours < 24) & (F.to_date(ts) == F.to_date(now)),
            F.concat(F.lit("今天 "), clock),
        )
        .when(
            F.to_date(ts) == F.date_sub(F.to_date(now), 1),
            F.concat(F.lit("昨天 "), clock),
        )
        .when(F.year(ts) == F.year(now), month_day)
        .otherwise(F.concat(F.year(ts).cast("string"), F.lit("年"), month_day))
    )

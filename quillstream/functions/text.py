"""Column functions over short texts: tokens, forms of an identifier, normal forms."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What counts as a token, a segment, a Roman numeral, an identifier and a separator.
#: A token is a run of ASCII digits, a run of ASCII letters, or one other character that is no white space.
TOKEN = r"([0-9]+|[A-Za-z]+|\S)"
SEGMENT = r"([0-9]+|[A-Za-z]+)"
ROMAN = r"^(?:x{0,3})(?:ix|iv|v?i{0,3})$"
ID_CHARACTERS = r"^[0-9A-Za-z()\[\].\-\s]+$"
SEPARATORS = "().-:_,/[]{}'\"`~;"
ALNUM = r"[\p{L}\p{N}]"


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def normalised(df: DataFrame, text_col: str, out: str = "text") -> DataFrame:
    """Adds the text in compatibility composition, stripped. Only texts beyond ASCII are read by Python; null gives ''."""
    plain = F.coalesce(F.col(text_col), F.lit(""))
    beyond = F.octet_length(plain) != F.length(plain)
    # the worker gets nulls for plain texts
    return df.withColumn(out, stripped(F.coalesce(_nfkc(F.when(beyond, plain)), plain)))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^(?U)\s+|(?U)\s+$", "")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1))


def is_digits(token: Column) -> Column:
    return token.rlike("^[0-9]+$")


def is_letters(token: Column) -> Column:
    return token.rlike("^[A-Za-z]+$")


def is_roman(text: Column) -> Column:
    """Lower-case Roman numerals up to 39."""
    return (text != "") & text.rlike(ROMAN)


def split_segments(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(SEGMENT), F.lit(1)), F.lower)


def key(segments: Column) -> Column:
    """10|b|1"""
    return F.array_join(segments, "|")


def flat(segments: Column) -> Column:
    """10b1"""
    return F.array_join(segments, "")


def display(segments: Column) -> Column:
    """10(b)(1)"""
    rest = F.transform(F.slice(segments, 2, F.greatest(F.size(segments) - 1, F.lit(0))), lambda s: F.concat(F.lit("("), s, F.lit(")")))
    return F.concat(F.element_at(segments, 1), F.array_join(rest, ""))


def allowed_id(text: Column) -> Column:
    return text.rlike(ID_CHARACTERS)


def has_alnum(text: Column) -> Column:
    return text.rlike(ALNUM)


def single_alnum(text: Column) -> Column:
    """Whether exactly one character is a letter or a digit."""
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", "")) == 1


def script_id(path: Column) -> Column:
    """The file's stem, with anything but ASCII letters, digits, '.', '_' and '-' as '_'."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return F.regexp_replace(stem, r"[^A-Za-z0-9._-]+", "_")


def page_id(script: Column, page_index: Column) -> Column:
    return F.format_string("%s-P%03d", script, page_index)


def content_version(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(text, 256), 1, 12))


def in_order_once(*lists: Column) -> Column:
    """All elements, each at its first place."""
    return F.array_distinct(F.concat(*lists))


def present(*pairs: tuple[Column, str]) -> Column:
    """The names whose condition holds, in the order given."""
    return F.filter(F.array(*(F.when(condition, F.lit(name)) for condition, name in pairs)), lambda x: x.isNotNull())

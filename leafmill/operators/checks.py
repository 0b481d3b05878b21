"""Input checks and masking as column expressions.

Each check returns its message, NULL meaning valid.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions import catalog as C
from leafmill.functions import text as T


# the URL pattern with a possessive host, safe for hosts of any length: either a top-level name
# follows the dotted labels, or the last label was it and a closing dot
_URL = C.URL_PATTERN.replace(r"[A-Z0-9])?\.)+[A-Z]{2,6}\.?|", r"[A-Z0-9])?\.)++(?:[A-Z]{2,6}|(?<=\.[A-Z]{2,6}\.))|")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot, '' without one; leading dots do not start one."""
    return F.lower(F.regexp_extract(base_name(path), r"^\.*[^.].*?(\.[^.]*)$", 1))


def url_error(url: Column) -> Column:
    ok = url.isNull() | (url == "") | T.matches(url, _URL, ignore_case=True)
    return F.when(~ok, T.message(C.INVALID_URL, url=url))


def extension_error(path: Column) -> Column:
    allowed = C.IMAGE_EXTENSIONS + C.DOCUMENT_EXTENSIONS
    return F.when(~extension(path).isin(allowed), T.message(
        C.UNSUPPORTED_FILE, extension=extension(path), supported=", ".join(allowed)))


def key_error(key: Column) -> Column:
    return F.when(F.coalesce(key, F.lit("")) == "", C.KEY_MISSING).when(
        F.length(key) < C.MIN_KEY_LENGTH, T.message(C.KEY_SHORT, low=C.MIN_KEY_LENGTH))


def tokens_error(n: Column) -> Column:
    low, high = C.TOKEN_RANGE
    return F.when(n < low, T.message(C.TOKENS_LOW, low=low)).when(n > high, T.message(C.TOKENS_HIGH, high=high))


def image_size_error(n: Column) -> Column:
    low, high = C.IMAGE_SIZE_RANGE
    return F.when(n < low, T.message(C.IMAGE_SIZE_LOW, low=low)).when(n > high, T.message(C.IMAGE_SIZE_HIGH, high=high))


def safe_name(path: Column, fallback: str | None = None) -> Column:
    """Base name without the unsafe parts, removed one after the other."""
    name = base_name(path)
    for part in C.UNSAFE_NAME_PARTS:
        name = F.replace(name, F.lit(part), F.lit(""))
    return name if fallback is None else F.when(name == "", fallback).otherwise(name)


def masked(secret: Column, shown: int = 8) -> Column:
    """First characters, the rest as asterisks."""
    hidden = F.greatest(F.length(secret) - shown, F.lit(0))
    return F.concat(F.substring(secret, 1, shown), F.repeat(F.lit("*"), hidden))


def key_prefix(key: Column) -> Column:
    return F.substring(key, 1, 8)


def key_hash(key: Column) -> Column:
    return F.sha2(key, 256)

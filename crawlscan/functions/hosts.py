"""Hidden-service host names in record bodies, with built-in expressions only.

A host is 16 or 56 characters of a-z and 2-7 before ``.onion``, with a word boundary on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

# The host grammar and the literal that every match holds.
HOST = r"(?:[a-z2-7]{16}|[a-z2-7]{56})\.onion"
LITERAL = ".onion"
BOUNDARY = {
    "ascii": rf"(?<![A-Za-z0-9_]){HOST}(?![A-Za-z0-9_])",
    "unicode": rf"(?U)(?<!\w){HOST}(?!\w)",
}


def hosts_in(body: Column, *, binary: bool, boundary: str = "ascii") -> Column:
    """All hosts of a body, in order, repeats included.

    With ``ascii`` boundaries bytes are matched as Latin-1, so any byte over 0x7F is a boundary; with
    ``unicode`` the body is read as UTF-8, invalid bytes replaced, and letters of any script join words.
    """
    if boundary not in BOUNDARY:
        raise ValueError(f"boundary must be one of {sorted(BOUNDARY)}")
    text = F.decode(body, "ISO-8859-1") if binary and boundary == "ascii" else body.cast("string")
    return F.transform(F.regexp_extract_all(text, F.lit(BOUNDARY[boundary]), F.lit(0)), F.lower)


def extract_hosts(records: DataFrame, body_col: str = "body", *, boundary: str = "ascii") -> DataFrame:
    """One row per host found in each record: ``records`` without its body, and ``onion``.

    A byte search for the literal comes first: it settles almost every record without the pattern.
    Null and empty bodies have no hosts.
    """
    binary = isinstance(records.schema[body_col].dataType, BinaryType)
    body = F.col(body_col)
    likely = F.contains(body, F.lit(LITERAL.encode()) if binary else F.lit(LITERAL))
    rest = [c for c in records.columns if c not in (body_col, "onion")]
    return records.filter(likely).select(*rest, F.explode(hosts_in(body, binary=binary, boundary=boundary)).alias("onion"))


def is_response(warc_type: Column) -> Column:
    """Record type test, ignoring case."""
    return F.lower(warc_type) == "response"


def digits_as_long(value: Column) -> Column:
    """The ASCII digits of a header value as a number; none, or too many for 64 bits, give 0."""
    return F.coalesce(F.nullif(F.regexp_replace(value, "[^0-9]", ""), F.lit("")).try_cast("bigint"), F.lit(0).cast("bigint"))


def filename(uri: Column) -> Column:
    """What follows the last slash of a URI; empty for a trailing slash, the whole if there is none."""
    return F.element_at(F.split(uri, "/"), -1)


def host_version(onion: Column) -> Column:
    """2 or 3, from the length of the host."""
    return F.when(F.length(onion) == 22, 2).when(F.length(onion) == 62, 3)


# The characters of Unicode's White_Space property.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def trimmed(line: Column | str) -> Column:
    """A line without white space at either end."""
    return F.btrim(line, F.lit(WHITE_SPACE))

"""HTML entities, whitespace and Markdown marks."""

from __future__ import annotations

import json
import zlib
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .text import let, strip

_TOKEN = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


_BUCKETS = 1024


def _entities() -> Column:
    """Named entities as a constant, taken from the Python standard library.

    A map is searched from its first key on, so the names are dealt by their checksum into
    buckets of a few names each.
    """
    buckets: list[dict[str, str]] = [{} for _ in range(_BUCKETS)]
    for name, text in html5.items():
        buckets[zlib.crc32(name.encode()) % _BUCKETS][name] = text
    return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,string>>")


def _named(names: Column, name: Column) -> Column:
    """The characters of an entity, NULL if there is none of that name."""
    bucket = F.pmod(F.crc32(name.cast("binary")), F.lit(_BUCKETS)).cast("int")
    return F.try_element_at(F.get(names, bucket), name)


def _windows_1252() -> Column:
    """Code points 128-159 written as numbers mean Windows-1252 characters."""
    table = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160)}
    return F.from_json(F.lit(json.dumps({str(k): v for k, v in table.items()})), "map<string,string>")


def _code_point(token: Column) -> Column:
    hexed = F.regexp_extract(token, "^#[xX]([0-9a-fA-F]+)", 1)
    digits = F.regexp_replace(
        F.when(hexed != "", hexed).otherwise(F.regexp_extract(token, "^#([0-9]+)", 1)), "^0+(?=.)", ""
    )
    base = F.when(hexed != "", digits).otherwise(F.conv(digits, 10, 16))
    # more than seven hex digits lie beyond Unicode in any case
    n = F.when(F.length(digits) > 9, F.lit(0x7FFFFFFF)).otherwise(F.conv(base, 16, 10).try_cast("long"))
    char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    noncharacter = (
        n.between(1, 8) | (n == 11) | n.between(14, 31) | n.between(127, 159)
        | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    )
    return (
        F.when((n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), "�")
        .when(n.between(128, 159), F.try_element_at(_windows_1252(), n.cast("string")))
        .when(noncharacter, "")
        .otherwise(char)
    )


def _decode_piece(piece: Column, names: Column) -> Column:
    """Text after an ampersand with its leading entity resolved."""

    def resolve(token):
        # names that are also valid without their semicolon may be a mere prefix
        lengths = F.filter(
            F.sequence(F.least(F.length(token) - 1, F.lit(8)), F.lit(2), F.lit(-1)),
            lambda n: _named(names, F.substr(token, F.lit(1), n)).isNotNull(),
        )
        prefix = let(
            F.when(F.length(token) > 2, F.get(lengths, F.lit(0))),
            lambda n: F.concat(
                _named(names, F.substr(token, F.lit(1), n)), F.substr(token, n + 1, F.length(token))
            ),
        )
        rest = F.substr(piece, F.length(token) + 1, F.length(piece))
        return F.concat(
            F.when(token == "", "&")
            .when(token.startswith("#"), _code_point(token))
            .otherwise(F.coalesce(_named(names, token), prefix, F.concat(F.lit("&"), token))),
            rest,
        )

    return let(F.regexp_extract(piece, _TOKEN, 1), resolve)


def unescape_html(c: Column) -> Column:
    """Entities to characters (S5). Texts without an ampersand pass untouched."""
    pieces = F.split(c, "&")
    decoded = F.concat(
        F.get(pieces, F.lit(0)),
        let(
            _entities(),
            lambda names: F.array_join(
                F.transform(F.slice(pieces, 2, F.size(pieces)), lambda p: _decode_piece(p, names)), ""
            ),
        ),
    )
    return F.when(F.contains(c, F.lit("&")), decoded).otherwise(c)


def normalize(c: Column) -> Column:
    """Unescaped, white space runs as one space, lower case."""
    return F.lower(F.regexp_replace(unescape_html(c), f"(?U){V.SPACE_CLASS}+", " "))


def flatten_markup(c: Column) -> Column:
    """Only the words: Markdown marks and white space collapsed, lower case."""
    plain = F.regexp_replace(F.regexp_replace(c, V.MARKUP_RUN, " "), f"(?U){V.SPACE_CLASS}+", " ")
    return F.lower(strip(plain))

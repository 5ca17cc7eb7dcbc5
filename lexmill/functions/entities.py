"""HTML character references, decoded inside the JVM."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
# Two control characters that no name or value of the published table contains.
ENTRY, PAIR = "\u0001", "\u0002"
# Names that are known without a semicolon, longest first.
BARE = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))


def _windows_1252() -> list[str]:
    """Numbers 128 to 159 stand for the characters of Windows-1252, where it has one."""
    return [bytes([n]).decode("cp1252") if n not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(n) for n in range(128, 160)]


def _character(number: Column) -> Column:
    """The character of a reference by number; null means that the number was too large to read."""
    control = number.between(1, 8) | (number == 11) | number.between(14, 31) | (number == 127)
    none = number.between(0xFDD0, 0xFDEF) | (number.bitwiseAND(0xFFFE) == 0xFFFE)
    code = F.unhex(F.lpad(F.hex(number), 8, "0"))
    return (
        F.when(number.isNull() | (number == 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF), "�")
        .when(number.between(128, 159), F.element_at(F.array(*[F.lit(c) for c in _windows_1252()]), (F.greatest(number, F.lit(128)) - 127).cast("int")))
        .when(control | none, "")
        .otherwise(F.decode(code, "UTF-32"))
    )


def _number(digits: Column, base: int, most: int) -> Column:
    """Digits as a number; null if there are more than any character needs."""
    short = F.regexp_replace(digits, "^0+(?=.)", "")
    return F.when(F.length(short) <= most, F.conv(short, base, 10).cast("bigint"))


def decode_references(text: Column) -> Column:
    """Decode all named and numeric character references, as browsers do.

    A name counts with its semicolon, or else by the longest beginning that is
    known without one. Texts without "&" are not touched.
    """
    table = ENTRY.join(f"{name}{PAIR}{value}" for name, value in html5.items())
    named = F.str_to_map(F.lit(table), F.lit(ENTRY), F.lit(PAIR))

    def decoded(pair: Column) -> Column:
        found, name = pair["found"], F.substr(pair["found"], F.lit(2))
        decimal, hexadecimal = F.regexp_extract(found, "^&#([0-9]+)", 1), F.regexp_extract(found, "^&#[xX]([0-9a-fA-F]+)", 1)
        begins = F.regexp_extract(name, f"^({'|'.join(BARE)})", 1)
        value = (
            F.when(found.isNull(), "")
            .when(decimal != "", _character(_number(decimal, 10, 7)))
            .when(hexadecimal != "", _character(_number(hexadecimal, 16, 6)))
            .when(F.map_contains_key(named, name), F.try_element_at(named, name))
            .when(begins != "", F.concat(F.try_element_at(named, begins), F.substr(name, F.length(begins) + 1)))
            .otherwise(found)
        )
        return F.concat(pair["between"], value)

    pairs = F.arrays_zip(F.split(text, REFERENCE, -1).alias("between"), F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)).alias("found"))
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(pairs, decoded), "")).otherwise(text)

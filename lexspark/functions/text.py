"""Tokens, abstracts and posting codecs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "^[A-Za-z]+$"
SPACE = r"[ \t\n\r]+"


def raw_words(text: Column) -> Column:
    """Runs between spaces, tabs and line ends, in order."""
    return F.split(text, SPACE)


def keep_words(words: Column) -> Column:
    """Words of ASCII letters only, in lower case; any other word is dropped whole."""
    return F.transform(F.filter(words, lambda w: w.rlike(WORD)), F.lower)


def tokenize(text: Column) -> Column:
    return keep_words(raw_words(text))


def short_words(words: Column, limit: int) -> Column:
    """Words below ``limit`` characters."""
    return F.filter(words, lambda w: F.length(w) < limit)


def fitting_prefix(words: Column, limit: int) -> Column:
    """The longest prefix of whole words whose lengths, each with a space, sum to
    ``limit`` at most, joined by spaces."""
    state = F.struct(F.lit(0).alias("used"), F.lit(False).alias("full"), F.lit("").alias("out"))

    def add(s: Column, w: Column) -> Column:
        full = s["full"] | (s["used"] + F.length(w) + 1 > limit)
        return F.struct(
            F.when(full, s["used"]).otherwise(s["used"] + F.length(w) + 1).alias("used"),
            full.alias("full"),
            F.when(full, s["out"]).when(s["used"] == 0, w).otherwise(F.concat(s["out"], F.lit(" "), w)).alias("out"),
        )

    return F.aggregate(words, state, add)["out"]


def varint_length(x: Column) -> Column:
    """Bytes of the variable-length code: 5 bits in the first byte, 8 in each later one."""
    out = F.lit(8)
    for n in range(7, 0, -1):
        out = F.when(x < F.lit(1 << (8 * n - 3)), n).otherwise(out)
    return out.cast("int")


def varint_hex(x: Column) -> Column:
    """The code in lower-case hex: big-endian, the top 3 bits of the first byte count
    the bytes that follow."""
    n = varint_length(x)
    out = None
    for k in range(1, 9):
        tag = (k - 1) << (8 * k - 3)
        value = F.lit(tag - (1 << 64) if tag >= 1 << 63 else tag).cast("long").bitwiseOR(x)
        digits = F.lower(F.lpad(F.hex(value), 2 * k, "0"))
        out = F.when(n == k, digits) if out is None else out.when(n == k, digits)
    return out


def varint_decode(digits: Column) -> Column:
    """The value of a code in hex."""
    head = F.conv(F.substring(digits, 1, 2), 16, 10).cast("int")
    first = F.lpad(F.lower(F.hex(head.bitwiseAND(31))), 2, "0")
    return F.conv(F.concat(first, F.substr(digits, F.lit(3))), 16, 10).cast("long")

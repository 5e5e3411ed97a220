"""Check digits as column expressions (higher-order functions over the digits)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT
from .normalize import digits

ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def luhn(c: Column) -> Column:
    """Luhn's check over twelve digits or more."""
    d = F.reverse(digits(c))

    def value(ch: Column, i: Column) -> Column:
        twice = ch.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    total = F.aggregate(F.transform(F.split(d, "(?<=.)(?=.)"), value), F.lit(0), lambda a, x: a + x)
    return F.when(F.length(d) >= 12, total % 10 == 0).otherwise(False)


def _dihedral() -> list[int]:
    """Products of the dihedral group of order ten, row after row."""

    def times(a: int, b: int) -> int:
        if a < 5:
            return (a + b) % 5 if b < 5 else 5 + (a + b - 5) % 5
        return 5 + (a - 5 - b) % 5 if b < 5 else (a - b) % 5

    return [times(a, b) for a in range(10) for b in range(10)]


def _permutations() -> list[int]:
    """Powers 0 to 7 of the permutation 1 5 7 6 2 8 3 0 9 4, row after row."""
    base, row, out = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4], list(range(10)), []
    for _ in range(8):
        out += row
        row = [base[x] for x in row]
    return out


def verhoeff(c: Column) -> Column:
    """Verhoeff's check over two digits or more."""
    d = F.reverse(digits(c))
    group, moved = F.array(*map(F.lit, _dihedral())), F.array(*map(F.lit, _permutations()))
    steps = F.transform(F.split(d, "(?<=.)(?=.)"), lambda ch, i: F.get(moved, (i % 8) * 10 + ch.cast("int")))
    return F.when(F.length(d) >= 2, F.aggregate(steps, F.lit(0), lambda a, p: F.get(group, a * 10 + p)) == 0).otherwise(False)


def gstin(c: Column) -> Column:
    """Modulus-36 check character of a 15-character number."""
    g = F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9A-Za-z]", ""))

    def value(ch: Column, i: Column) -> Column:
        x = (F.instr(F.lit(ALPHABET), ch) - 1) * F.when(i % 2 == 0, 1).otherwise(2)
        return F.floor(x / 36) + x % 36

    chars = F.split(F.substring(g, 1, 14), "(?<=.)(?=.)")
    total = F.aggregate(F.transform(chars, value), F.lit(0).cast("bigint"), lambda a, x: a + x)
    want = F.substring(F.lit(ALPHABET), ((36 - total % 36) % 36 + 1).cast("int"), F.lit(1))
    return F.when(F.length(g) == 15, want == F.substring(g, 15, 1)).otherwise(False)


def valid_imei(norm: Column) -> Column:
    ok = norm.rlike("^[0-9]{15}$")
    return ok & luhn(norm) if DEFAULT.checksum_validation else ok


def valid_aadhaar(norm: Column) -> Column:
    ok = norm.rlike("^[0-9]{12}$")
    return ok & verhoeff(norm) if DEFAULT.checksum_validation else ok


def valid_gstin(norm: Column) -> Column:
    ok = F.length(norm) == 15
    return ok & gstin(norm) if DEFAULT.checksum_validation else ok

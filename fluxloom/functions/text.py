"""Keys and formats as columns, and as plain functions for reports."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def side_key(parts: Column) -> Column:
    """Non-empty parts in order, joined by dots."""
    return F.array_join(F.array_sort(F.filter(parts, lambda p: F.coalesce(p, F.lit("")) != "")), ".")


def reaction_key(reactants: Column, products: Column) -> Column:
    """Canonical text of a reaction; the direction stays."""
    return F.concat(side_key(reactants), F.lit(">>"), side_key(products))


def formula_counts(formula: Column) -> Column:
    """'C3H4O3' with every count written -> map of counts."""
    names = F.regexp_extract_all(formula, F.lit(r"([A-Za-z]+)(\d+)"), F.lit(1))
    numbers = F.regexp_extract_all(formula, F.lit(r"([A-Za-z]+)(\d+)"), F.lit(2))
    return F.map_from_arrays(names, F.transform(numbers, lambda n: n.cast("int")))


def no_space(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def composition_key(symbols: Column) -> Column:
    return F.array_join(F.array_sort(symbols), "_")


def arity(n_reactants: Column, n_products: Column) -> Column:
    return F.concat(n_reactants.cast("string"), F.lit("->"), n_products.cast("string"))


def query_parts(text: str) -> tuple[str, int]:
    """'FORMULA:CHARGE' of a seed query."""
    formula, _, charge = text.rpartition(":")
    return re.sub(r"\s+", "", formula), int(charge)


def duration(seconds: float) -> str:
    s = int(seconds)
    return f"{s // 3600}h{s % 3600 // 60:02d}m" if s >= 3600 else f"{s // 60}m{s % 60:02d}s" if s >= 60 else f"{seconds:.1f}s"


def size(n: float) -> str:
    for unit in ("B", "KB", "MB", "GB"):
        if n < 1024:
            return f"{n:.1f} {unit}"
        n /= 1024
    return f"{n:.1f} TB"


def formula_words(text: Column, symbols: list[str]) -> Column:
    """Runs of ASCII letters and digits that symbols and counts of four digits at most spell out; none of a null text."""
    one = "|".join(sorted(symbols, key=lambda s: (-len(s), s)))
    words = F.split(F.coalesce(text, F.lit("")), "[^A-Za-z0-9]+")
    return F.filter(words, lambda w: w.rlike(f"^(?:(?:{one})[0-9]{{0,4}})+$"))


def canonical_formula(word: Column, symbols: list[str], least_atoms: int = 1) -> Column:
    """'CH3OH' -> 'C1H4O1', symbols in alphabetical order; null of fewer atoms."""

    def count(symbol: str) -> Column:
        numbers = F.regexp_extract_all(word, F.lit(f"{symbol}(?![a-z])([0-9]*)"), F.lit(1))
        return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, n: a + F.when(n == "", 1).otherwise(n.cast("long")))

    counts = F.array(*(F.struct(F.lit(s).alias("s"), count(s).alias("n")) for s in sorted(symbols)))
    there = F.filter(counts, lambda c: c["n"] > 0)
    atoms = F.aggregate(there, F.lit(0).cast("long"), lambda a, c: a + c["n"])
    return F.when(atoms >= least_atoms, F.array_join(F.transform(there, lambda c: F.concat(c["s"], c["n"].cast("string"))), ""))

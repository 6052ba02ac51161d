"""Formulas in texts: which compositions a corpus writes about, and the species of the pool that have them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxloom.functions import text
from fluxloom.schema import NONE


def counted(docs: DataFrame, symbols: list[str], least_atoms: int = 2, by: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """formula, n_mentions, n_texts for each value of by.

    A formula is a whole run of letters and digits that the symbols and their
    counts spell out.  Runs of the same composition are one formula, its symbols
    in alphabetical order.  Mentions are added up in each text's task, and before
    the shuffle.
    """
    by = by or []
    found = F.array_compact(F.transform(text.formula_words(F.col(text_col), symbols), lambda w: text.canonical_formula(w, symbols, least_atoms)))
    one = lambda mention, whole: lambda f: F.struct(f.alias("formula"), F.lit(mention).alias("mention"), F.lit(whole).alias("text"))
    rows = docs.select(*by, found.alias("f")).filter(F.size("f") > 0)
    rows = rows.select(*by, F.explode(F.concat(F.transform("f", one(1, 0)), F.transform(F.array_distinct("f"), one(0, 1)))).alias("m"))
    return rows.groupBy(*by, F.col("m.formula").alias("formula")).agg(F.sum("m.mention").alias("n_mentions"), F.sum("m.text").alias("n_texts"))


def formula_of(columns: dict[str, str]) -> Column:
    """The canonical formula of a species from its count columns by symbol."""
    part = lambda s: F.when(F.col(columns[s]) > 0, F.concat(F.lit(s), F.col(columns[s]).cast("string"))).otherwise("")
    return F.concat(*(part(s) for s in sorted(columns)))


def with_species(found: DataFrame, species: DataFrame, columns: dict[str, str], charge: int = 0) -> DataFrame:
    """found with n_species of each formula's composition, and seed: the one of that charge with the lowest energy, ties by number, or -1."""
    own = F.col("charge") == charge
    pool = species.groupBy(formula_of(columns).alias("formula")).agg(
        F.count("*").alias("n_species"), F.min(F.when(own, F.struct("solvation_free_energy", "ind")))["ind"].alias("seed")
    )
    return found.join(pool, "formula", "left").withColumns({"n_species": F.coalesce("n_species", F.lit(0).cast("long")), "seed": F.coalesce("seed", F.lit(NONE))})

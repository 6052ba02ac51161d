"""Energies, barriers and rates as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from fluxloom import schema as S


def free_energy(energy_ha: Column, enthalpy_kcal: Column, entropy_cal: Column, temperature: float = S.ROOM_TEMP) -> Column:
    """E + H - T S in eV; null if enthalpy or entropy is."""
    return energy_ha * S.HARTREE_EV + S.KCAL_EV * enthalpy_kcal - F.lit(temperature) * entropy_cal * S.CAL_K_EV


def rate(barrier: Column, temperature: float = S.ROOM_TEMP) -> Column:
    kt = S.KB * temperature
    return F.lit(kt / S.PLANCK) * F.exp(-barrier / F.lit(kt))


def eyring_rate(barrier: Column, temperature: float = S.ROOM_TEMP) -> Column:
    """The prefactor alone where there is no barrier."""
    kt = S.EYRING_KB * temperature
    prefactor = kt * S.EYRING_E / S.EYRING_H
    return F.when(barrier <= 0, F.lit(prefactor)).otherwise(F.lit(prefactor) * F.exp(-barrier / F.lit(kt)))


def cost(dg: Column) -> Column:
    return F.exp(F.least(F.lit(10.0), dg) / F.lit(S.ROOM_TEMP * S.KB)) + 1


def outer_reorganization() -> float:
    """Marcus solvent reorganization energy in eV near an electrode; distances are in Angstrom."""
    m = S.MARCUS
    geometry = (1 / m["r"] - 1 / (2 * m["R"])) * 1e10
    return m["e"] / (8 * math.pi * m["eps0"]) * geometry * (1 / m["n"] ** 2 - 1 / m["eps"])


def mean_known(*values: Column) -> Column:
    """The mean of the values that aren't null."""
    known = F.filter(F.array(*values), lambda v: v.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, v: a + v) / F.size(known))


def marcus_barrier(dg: Column, dq: Column, reactant: Column, product: Column) -> Column:
    """Barrier of a one-electron step; null where the charge changes by more, or no gap energy is known.

    reactant and product are structs with electron_affinity and ionization_energy.
    """
    gained = mean_known(reactant["electron_affinity"], product["ionization_energy"])
    lost = mean_known(reactant["ionization_energy"], product["electron_affinity"])
    inner = F.when(dq == -1, gained).when(dq == 1, lost)
    total = F.greatest(F.lit(0.0), inner) + F.lit(outer_reorganization())
    return F.when(inner.isNotNull(), total / 4 * F.pow(1 + dg / total, F.lit(2)))

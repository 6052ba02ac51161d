"""Schemas of the network's tables and fixed constants."""

from __future__ import annotations

RAW_SPECIES = (
    "molecule_id string, number_atoms int, spin_multiplicity int, charge int, "
    "atoms array<struct<symbol:string,x:double,y:double,z:double>>, bonds array<struct<u:int,v:int,ord:int>>, "
    "thermo struct<raw:struct<`electronic_energy_Ha`:double,`total_enthalpy_kcal/mol`:double,`total_entropy_cal/molK`:double>,"
    "shifted_rrho_eV:struct<electronic_energy:double,total_enthalpy:double,total_entropy:double>,"
    "quasi_rrho_eV:struct<electronic_energy:double,total_enthalpy:double,total_entropy:double>>, "
    "partial_charges struct<resp:array<double>,mulliken:array<double>,nbo:array<double>>, "
    "partial_spins struct<mulliken:array<double>,nbo:array<double>>, "
    "redox struct<electron_affinity_eV:double,ionization_energy_eV:double>"
)
FRAGMENTS = "array<struct<n_frag:int,n_broken:int,bonds_broken:array<struct<u:int,v:int>>,hashes:array<string>>>"
SPECIES = (
    "ind int, entry_id string, formula string, charge int, spin_multiplicity int, num_atoms int, "
    "atoms array<struct<symbol:string,x:double,y:double,z:double>>, bonds array<struct<u:int,v:int,ord:int>>, "
    "n_by_element map<string,int>, comp_key string, is_metal boolean, free_energy double, solvation_free_energy double, "
    "electron_affinity double, ionization_energy double, penalty int, covalent_hash string, "
    f"star_counts map<string,int>, bond_counts map<string,int>, fragments {FRAGMENTS}"
)
REACTIONS = (
    "reaction_id long, number_of_reactants int, number_of_products int, reactant_1 int, reactant_2 int, "
    "product_1 int, product_2 int, rate double, dG double, dG_barrier double, is_redox int, iteration int"
)
TRAJECTORIES = "seed int, step int, reaction_id long, time double"
INITIAL_STATE = "species_id int, count int"
FACTORS = "factor_zero double, factor_two double, factor_duplicate double"
VERDICTS = "rxn_key string, allowed int, status string, elapsed double, ts double, mapper_version string"
MAPPER_IN = "reaction_id long, reactant string, product string"

# Physical constants and unit conversions that results depend on.
ROOM_TEMP = 298.15
KB = 8.617333262e-5
PLANCK = 4.135667696e-15
HARTREE_EV, KCAL_EV, CAL_K_EV = 27.21139, 0.0433641, 0.0000433641
EV_HARTREE, EV_KCAL, EV_K_CAL = 0.0367493, 23.061, 23061.0
EYRING_KB, EYRING_H, EYRING_E = 8.617333e-5, 6.62607015e-34, 1.602176634e-19
MARCUS = {"n": 1.415, "eps": 18.5, "r": 6.0, "R": 7.5, "eps0": 8.85419e-12, "e": 1.602e-19}
METALS = ("Li", "Na")
METAL_FORMULAS = ("Li1", "Na1")
COORDINATE_PAIRS = ("Li-O", "Na-O")
# Solvation environments.
ENVIRONMENTS = {
    "li_ec": {"correction": -0.68, "radius": 2.4, "max_bonds": 4, "metal": "Li"},
    "na_ec": {"correction": -0.44, "radius": 2.4, "max_bonds": 5, "metal": "Na"},
}
BLOCK_IDS = 1 << 20  # reactions whose ids share a folder of the network
NONE = -1  # stands for no second reactant or product
MAPPER_VERSION = "1.0.0"

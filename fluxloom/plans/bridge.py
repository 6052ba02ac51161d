"""A reaction network read out of the sample tables: the same expressions for Spark and for SQL.

Suppliers are the species pool, parts the reactions, events the firing log.  All
rows are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluxloom import schema as S
from fluxloom.operators.enumeration import KEYS
from fluxloom.operators.rules import atom_hash

ELEMENTS = ["n_c", "n_h", "n_o", "n_s"]
SPECIES = [
    "CAST(s_suppkey AS INT) AS ind", "CAST(CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey % 3 - 1 ELSE 0 END AS INT) AS charge", "CAST(1 + s_suppkey % 2 AS INT) AS spin_multiplicity",
    "CAST(s_nationkey % 4 AS INT) AS n_c", "CAST(s_suppkey % 4 AS INT) AS n_h", "CAST((s_suppkey - s_suppkey % 4) % 8 / 4 AS INT) AS n_o",
    "CAST(CAST(floor(abs(s_acctbal)) AS BIGINT) % 3 AS INT) AS n_s", "-s_acctbal / CAST(1000 AS DOUBLE) AS free_energy",
    "-s_acctbal / CAST(1000 AS DOUBLE) - CAST(s_suppkey % 2 AS DOUBLE) / 4 AS solvation_free_energy",
    "s_suppkey % 11 = 4 AS is_metal", "concat('h', CAST(s_nationkey AS VARCHAR(9))) AS covalent_hash", "CAST(s_nationkey % 2 AS INT) AS penalty",
    "CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE abs(s_acctbal) / 1000 END AS electron_affinity", "CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE abs(s_acctbal) / 2000 END AS ionization_energy",
]
#: The species that a run starts from, and those that it would add next.
CORE, NEXT = "s_nationkey = 3", "s_nationkey = 7"
NETWORK = [
    "CAST(p_partkey AS BIGINT) AS reaction_id", "CAST(p_partkey * 7 % 90 AS INT) AS reactant_1",
    "CAST(CASE WHEN p_partkey % 3 = 0 THEN -1 ELSE p_partkey * 11 % 90 END AS INT) AS reactant_2",
    "CAST((p_partkey * 13 + 1) % 90 AS INT) AS product_1", "CAST(CASE WHEN p_partkey % 2 = 0 THEN -1 ELSE (p_partkey * 17 + 3) % 90 END AS INT) AS product_2",
    "CAST(CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 2 END AS INT) AS number_of_reactants", "CAST(CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 2 END AS INT) AS number_of_products",
    "CAST(1 AS DOUBLE) AS rate", "(CAST(949 AS DOUBLE) - p_retailprice) / CAST(100 AS DOUBLE) AS dG", "CAST(p_size % 2 AS INT) AS is_redox",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def species(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(*SPECIES)


def core(spark, sf_dir, which: str = CORE) -> DataFrame:
    return table(spark, sf_dir, "supplier").filter(which).selectExpr(SPECIES[0])


def network(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*NETWORK)


def initial(spark, sf_dir) -> DataFrame:
    n = network(spark, sf_dir)
    return n.select(F.col("reactant_1").alias("species_id")).distinct().select("species_id", F.expr("CAST(CASE WHEN species_id < 10 THEN 50 ELSE 0 END AS INT)").alias("count"))


def log(spark, sf_dir) -> DataFrame:
    parts = table(spark, sf_dir, "part").count()
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("seed"), (F.row_number().over(order) - 1).cast("int").alias("step"), (F.col("event_id") % parts).alias("reaction_id")
    )


def log_unordered(spark, sf_dir) -> DataFrame:
    """The log without steps, for operators that only count."""
    parts = table(spark, sf_dir, "part").count()
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("seed"), (F.col("event_id") % parts).alias("reaction_id"))


def verdicts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "concat('k', CAST(user_id AS STRING)) AS rxn_key", "CAST(event_id % 2 AS INT) AS allowed", "event_type AS status", "abs(value) AS elapsed",
        "CAST(event_id AS DOUBLE) AS ts", "CASE WHEN event_id % 3 = 0 THEN '0.9' ELSE '1.0.0' END AS mapper_version",
    )


def with_maps(s: DataFrame) -> DataFrame:
    """Counts of bonds and neighbourhoods, for the rules over maps."""
    m = lambda **k: F.map_filter(F.create_map(*[x for a, b in k.items() for x in (F.lit(a), F.col(b))]), lambda _, n: n > 0)
    return s.withColumns({"bond_counts": m(**{"C-H": "n_h", "C-O": "n_o", "Li-O": "n_s"}), "star_counts": m(a="n_c", b="n_h")})


#: Fragmentations by name: when there is one, pieces, broken bonds and hashes, over the columns of SPECIES.
_H, _O = atom_hash("H"), atom_hash("O")
_FRAGMENTS = [
    ("true", 1, 0, ["covalent_hash"]), ("n_h > 0", 2, 1, ["concat('x', CAST(n_c AS {text}))", f"'{_H}'"]),
    ("n_o > 0", 2, 1, ["concat('x', CAST(n_c AS {text}))", f"'{_O}'"]), ("n_s > 0", 1, 1, ["concat('r', CAST(n_c AS {text}))"]),
]
_RINGS = [("n_c = 3", 2, 2, ["concat('h', CAST(ind % 5 AS {text}))", "concat('h', CAST(ind % 5 + 1 AS {text}))"])]


def _fragments(which: list, spark: bool) -> str:
    """The same list of structs in either dialect."""
    one = "named_struct('n_frag', {n}, 'n_broken', {b}, 'hashes', array({h}))" if spark else "{{'n_frag': {n}, 'n_broken': {b}, 'hashes': [{h}]}}"
    rows = ", ".join(f"CASE WHEN {w} THEN {one.format(n=n, b=b, h=', '.join(h))} END".replace("{text}", "STRING" if spark else "VARCHAR") for w, n, b, h in which)
    return f"filter(array({rows}), x -> x IS NOT NULL)" if spark else f"list_filter([{rows}], lambda x: x IS NOT NULL)"


def with_fragments(s: DataFrame) -> DataFrame:
    """with_maps() and fragmentations, for the rules over graphs."""
    return with_maps(s).withColumns({"fragments": F.expr(_fragments(_FRAGMENTS, True)), "ring_fragments": F.expr(_fragments(_RINGS, True))})


#: A molecule for each supplier: chains with an oxygen and hydrogens, rings, metal complexes, ions, and two atoms apart.
MOLECULES = [
    "s_name AS entry_id", "CAST(s_suppkey % 8 AS INT) AS kind", "CAST(s_nationkey % 4 + 1 AS INT) AS n_c", "CAST(s_suppkey % 2 AS INT) AS has_o", "CAST(s_suppkey % 3 AS INT) AS n_h",
    "CAST(s_nationkey % 2 AS INT) AS odd",
    "CAST(CASE WHEN s_suppkey % 8 = 6 THEN 1 - s_nationkey % 2 WHEN s_suppkey % 8 = 7 THEN 0 ELSE s_suppkey % 4 - 1 END AS INT) AS charge", "s_acctbal AS energy",
]
CHAIN, RING, COMPLEX, ION = "kind < 4", "kind = 4", "kind = 5", "kind = 6"


def molecules(spark, sf_dir) -> DataFrame:
    """Raw documents of the molecules."""
    d = table(spark, sf_dir, "supplier").selectExpr(*MOLECULES)
    d = d.withColumn("symbols", F.expr(f"""CASE WHEN {CHAIN} THEN concat(array_repeat('C', n_c), array_repeat('O', has_o), array_repeat('H', n_h))
        WHEN {RING} THEN array_repeat('C', n_c + 2) WHEN {COMPLEX} THEN array('Li', 'O', 'C') WHEN {ION} THEN array('Li') ELSE array('C', 'C') END"""))
    bond = "named_struct('u', CAST({u} AS INT), 'v', CAST({v} AS INT), 'ord', 1)"
    none = "CAST(array() AS array<struct<u:int,v:int,ord:int>>)"
    d = d.withColumn("bonds", F.expr(f"""CASE WHEN {CHAIN} THEN concat(
        if(n_c + has_o > 1, transform(sequence(1, greatest(n_c + has_o - 1, 1)), i -> {bond.format(u='i - 1', v='i')}), {none}),
        if(n_h > 0, transform(sequence(0, greatest(n_h - 1, 0)), i -> {bond.format(u='0', v='n_c + has_o + i')}), {none}))
        WHEN {RING} THEN transform(sequence(0, n_c + 1), i -> {bond.format(u='least(i, (i + 1) % (n_c + 2))', v='greatest(i, (i + 1) % (n_c + 2))')})
        WHEN {COMPLEX} THEN array({bond.format(u=1, v=2)}) ELSE {none} END"""))
    natural = F.expr(f"transform(symbols, x -> CASE WHEN x = 'Li' THEN if({COMPLEX} AND n_h = 0, 0.01D, 0.9D) WHEN {COMPLEX} AND x = 'O' THEN if(odd = 0, -0.5D, 0.5D) ELSE 0.1D END)")
    plain = F.expr("transform(symbols, x -> if(x = 'Li', 0.9D, 0.1D))")
    spins = F.expr("transform(symbols, x -> if(kind = 1, 0.5D, 0.0D))")
    raw = F.struct(F.col("energy").cast("double").alias("electronic_energy_Ha"), F.lit(0.0).alias("total_enthalpy_kcal/mol"), F.lit(0.0).alias("total_entropy_cal/molK"))
    return d.select(
        F.col("entry_id").alias("molecule_id"), F.size("symbols").alias("number_atoms"), F.expr("if(kind = 1, 2, 1)").alias("spin_multiplicity"), "charge",
        F.expr("transform(symbols, (x, i) -> named_struct('symbol', x, 'x', CAST(i AS DOUBLE), 'y', 0.0D, 'z', 0.0D))").alias("atoms"), "bonds",
        F.struct(raw.alias("raw")).alias("thermo"), F.struct(F.expr("transform(symbols, x -> 0.1D)").alias("resp"), plain.alias("mulliken"), natural.alias("nbo")).alias("partial_charges"),
        F.struct(spins.alias("mulliken"), spins.alias("nbo")).alias("partial_spins"),
        F.struct(F.lit(None).cast("double").alias("electron_affinity_eV"), F.lit(None).cast("double").alias("ionization_energy_eV")).alias("redox"),
    )


def sodium(spark, sf_dir) -> DataFrame:
    """Raw documents with a sodium beside carbon alone, between two oxygens, or beside one; half of the first are too weakly charged to be bound."""
    d = table(spark, sf_dir, "supplier").selectExpr("s_name AS molecule_id", "CAST(s_suppkey % 3 AS INT) AS kind", "s_nationkey % 2 = 1 AS weak", "s_acctbal AS energy")
    d = d.withColumn("symbols", F.expr("CASE kind WHEN 0 THEN array('Na', 'C') WHEN 1 THEN array('Na', 'O', 'O') ELSE array('Na', 'O', 'C') END"))
    bonds = F.expr("if(kind = 2, array(named_struct('u', 1, 'v', 2, 'ord', 1)), CAST(array() AS array<struct<u:int,v:int,ord:int>>))")
    charges = F.expr("transform(symbols, x -> CASE x WHEN 'Na' THEN 0.9D WHEN 'O' THEN -0.5D ELSE if(kind = 0 AND NOT weak, -0.5D, 0.1D) END)")
    zero, none = F.expr("transform(symbols, x -> 0.0D)"), F.lit(None).cast("double")
    raw = F.struct(F.col("energy").cast("double").alias("electronic_energy_Ha"), F.lit(0.0).alias("total_enthalpy_kcal/mol"), F.lit(0.0).alias("total_entropy_cal/molK"))
    return d.select(
        "molecule_id", F.size("symbols").alias("number_atoms"), F.lit(1).alias("spin_multiplicity"), F.lit(0).alias("charge"),
        F.expr("transform(symbols, (x, i) -> named_struct('symbol', x, 'x', CAST(i AS DOUBLE), 'y', 0.0D, 'z', 0.0D))").alias("atoms"), bonds.alias("bonds"),
        F.struct(raw.alias("raw")).alias("thermo"), F.struct(charges.alias("resp"), charges.alias("mulliken"), charges.alias("nbo")).alias("partial_charges"),
        F.struct(zero.alias("mulliken"), zero.alias("nbo")).alias("partial_spins"), F.struct(none.alias("electron_affinity_eV"), none.alias("ionization_energy_eV")).alias("redox"),
    )


_KEYS = ", ".join(KEYS)
_SUM = ", ".join(f"a.{e} + b.{e} AS {e}" for e in ELEMENTS)
_EL = ", ".join(ELEMENTS)
_ON = " AND ".join(f"c.{e} = p.{e}" for e in ELEMENTS)

#: Fragmentations of one side: of a single species, or of two that break one bond at most.
_LIST = lambda s: f"""CASE WHEN {s}2.ind IS NULL THEN list_transform({s}1.fragments, lambda f: {{'n_frag': f.n_frag, 'n_broken': f.n_broken, 'hashes': list_sort(f.hashes)}})
    ELSE flatten(list_transform({s}1.fragments, lambda f: list_transform(list_filter({s}2.fragments, lambda g: f.n_broken + g.n_broken <= 1),
    lambda g: {{'n_frag': f.n_frag + g.n_frag, 'n_broken': f.n_broken + g.n_broken, 'hashes': list_sort(list_concat(f.hashes, g.hashes))}}))) END"""  # noqa: E731

#: The views by name, each built on those before it.
SQL = {
    "species_b": f"SELECT {', '.join(SPECIES)} FROM supplier",
    "core_b": f"SELECT {SPECIES[0]} FROM supplier WHERE {CORE}",
    "next_b": f"SELECT {SPECIES[0]} FROM supplier WHERE {NEXT}",
    "complexes_b": f"""SELECT ind AS s1, -1 AS s2, {_EL} FROM species_b WHERE ind IN (SELECT ind FROM core_b)
        UNION ALL SELECT a.ind, b.ind, {_SUM} FROM species_b a JOIN species_b b ON a.ind <= b.ind
        WHERE a.ind IN (SELECT ind FROM core_b) OR b.ind IN (SELECT ind FROM core_b)""",
    "index_b": f"SELECT ind AS p1, -1 AS p2, {_EL} FROM species_b UNION ALL SELECT a.ind, b.ind, {_SUM} FROM species_b a JOIN species_b b ON a.ind <= b.ind",
    "cand_b": f"""SELECT c.s1 AS reactant_1, c.s2 AS reactant_2, p.p1 AS product_1, p.p2 AS product_2
        FROM complexes_b c JOIN index_b p ON {_ON} WHERE NOT (c.s1 = p.p1 AND c.s2 = p.p2)""",
    "species_f": f"SELECT *, {_fragments(_FRAGMENTS, False)} AS fragments, {_fragments(_RINGS, False)} AS ring_fragments FROM species_b",
    "match_b": f"""SELECT {_KEYS}, list_filter(list_transform(rl, lambda r: {{'r': r, 'p': list_filter(pl, lambda p: p.hashes = r.hashes AND NOT (two AND p.n_frag = 2 AND r.n_frag = 2))[1]}}),
        lambda m: m.p IS NOT NULL)[1] AS m FROM (SELECT x.*, r2.ind IS NOT NULL AND p2.ind IS NOT NULL AS two, {_LIST('r')} AS rl, {_LIST('p')} AS pl
        FROM cand_b x JOIN species_f r1 ON x.reactant_1 = r1.ind LEFT JOIN species_f r2 ON x.reactant_2 = r2.ind
        JOIN species_f p1 ON x.product_1 = p1.ind LEFT JOIN species_f p2 ON x.product_2 = p2.ind)""",
    "net_b": f"SELECT {', '.join(NETWORK)} FROM part",
    "init_b": "SELECT DISTINCT reactant_1 AS species_id, CAST(CASE WHEN reactant_1 < 10 THEN 50 ELSE 0 END AS INT) AS count FROM net_b",
    "log_b": """SELECT user_id AS seed, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS step,
        event_id % (SELECT count(*) FROM part) AS reaction_id FROM events""",
    "side_b": " UNION ALL ".join(
        f"SELECT reaction_id, {k} AS species_id, {int(k[0] == 'p')} AS produced, {int(k[0] == 'r')} AS consumed FROM net_b WHERE {k} >= 0" for k in KEYS
    ),
    "fire_b": "SELECT l.seed, l.step, s.* FROM log_b l JOIN side_b s ON l.reaction_id = s.reaction_id",
    "flux_b": """SELECT species_id, CAST(sum(produced) AS BIGINT) AS produced, CAST(sum(consumed) AS BIGINT) AS consumed,
        count(*) AS touched, count(DISTINCT reaction_id) AS n_rxns FROM fire_b GROUP BY species_id""",
    # One row of each reaction, sides unordered; later: those that no reaction of a first reactant below 45 holds.
    "one_each_b": """SELECT *, NOT bool_or(reactant_1 < 45) OVER (PARTITION BY k1, k2, k3, k4) AS later FROM net_k_b
        QUALIFY row_number() OVER (PARTITION BY k1, k2, k3, k4 ORDER BY reactant_1 >= 45, reactant_1, reactant_2, product_1, product_2) = 1""",
    "net_k_b": """SELECT *, least(reactant_1, reactant_2) AS k1, greatest(reactant_1, reactant_2) AS k2, least(product_1, product_2) AS k3, greatest(product_1, product_2) AS k4 FROM net_b""",
    "first_b": """SELECT f.*, n.reactant_1, n.reactant_2, n.product_1, n.product_2, list_sort(list_filter([n.reactant_1, n.reactant_2], lambda x: x >= 0)) AS used,
        list_sort(list_filter([n.product_1, n.product_2], lambda x: x >= 0)) AS made FROM (
        SELECT seed, species_id, min(step) AS step, arg_min(reaction_id, step * 10000000 + reaction_id) AS reaction_id FROM fire_b WHERE produced > 0 GROUP BY seed, species_id) f
        JOIN net_b n ON f.reaction_id = n.reaction_id""",
    # A firing's heads: the first producers, before it, of its reactants that were absent; one whose products are just the reactants stands alone.
    "head_b": """SELECT f.seed, f.species_id, a.species_id AS one, a.made = f.used AS one_alone, b.species_id AS two, b.made = f.used AS two_alone FROM first_b f
        LEFT JOIN first_b a ON a.seed = f.seed AND a.species_id = f.reactant_1 AND a.step < f.step AND f.reactant_1 IN (SELECT species_id FROM init_b WHERE count = 0)
        LEFT JOIN first_b b ON b.seed = f.seed AND b.species_id = f.reactant_2 AND b.step < f.step AND f.reactant_2 IN (SELECT species_id FROM init_b WHERE count = 0)""",
    "edge_b": """SELECT seed, species_id, one AS child, '2' AS place FROM head_b WHERE one IS NOT NULL AND (one_alone OR NOT coalesce(two_alone, false))
        UNION ALL SELECT seed, species_id, two, '1' FROM head_b WHERE two IS NOT NULL AND NOT coalesce(one_alone, false)""",
    # Every firing below a species' pathway with its place in it; heads of the second reactant come first, the firing itself last.
    "tree_b": """SELECT seed, species_id AS root, species_id AS node, '' AS place FROM first_b
        UNION ALL SELECT t.seed, t.root, e.child, t.place || e.place FROM tree_b t JOIN edge_b e ON t.seed = e.seed AND t.node = e.species_id""",
    "path_b": """SELECT t.seed, t.root AS species_id, list(f.reaction_id ORDER BY t.place || '3') AS pathway FROM tree_b t
        JOIN first_b f ON t.seed = f.seed AND t.node = f.species_id GROUP BY t.seed, t.root""",
    "ways_b": f"""SELECT w.*, (SELECT sum(exp(least(10, n.dG) / CAST({S.ROOM_TEMP * S.KB!r} AS DOUBLE)) + 1) FROM (SELECT unnest(w.pathway) AS reaction_id) u JOIN net_b n ON u.reaction_id = n.reaction_id) AS weight
        FROM (SELECT species_id, list_sort(list_distinct(pathway)) AS path_key, count(*) AS frequency, arg_min(pathway, seed) AS pathway FROM path_b GROUP BY ALL) w""",
    # What the molecules' graphs give: covalent bonds by kind, atoms and bonds among all but metals, ring bonds one apart.
    "mol_b": f"""SELECT *, CASE WHEN {CHAIN} THEN n_c - 1 WHEN {RING} THEN n_c + 2 ELSE 0 END AS cc, CASE WHEN {CHAIN} THEN has_o WHEN {COMPLEX} THEN 1 ELSE 0 END AS co,
        CASE WHEN {CHAIN} THEN n_h ELSE 0 END AS ch, CASE WHEN {CHAIN} THEN n_c + has_o + n_h WHEN {RING} THEN n_c + 2 WHEN {ION} THEN 0 ELSE 2 END AS atoms,
        CASE WHEN {RING} THEN [0, 2, 5, 6][n_c] ELSE 0 END AS ring_pairs, CASE WHEN {COMPLEX} AND odd = 0 THEN 1 ELSE 0 END AS near,
        CASE WHEN {COMPLEX} THEN 'C1Li1O1' WHEN {ION} THEN 'Li1' WHEN {RING} THEN 'C' || (n_c + 2) WHEN kind = 7 THEN 'C2'
            ELSE 'C' || n_c || CASE WHEN n_h > 0 THEN 'H' || n_h ELSE '' END || CASE WHEN has_o = 1 THEN 'O1' ELSE '' END END AS formula,
        CASE WHEN {CHAIN} AND charge = 2 THEN 'charge' WHEN {COMPLEX} AND n_h = 0 THEN 'neutral_metal' WHEN {ION} AND charge = 0 THEN 'metal_ion'
            WHEN {COMPLEX} AND odd = 1 THEN 'bad_coordination' WHEN kind = 7 THEN 'not_connected' ELSE 'kept' END AS rule,
        energy * CAST({S.HARTREE_EV} AS DOUBLE) AS g FROM (SELECT {', '.join(MOLECULES)} FROM supplier)""",
    "pool_b": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY charge, formula, CASE WHEN {CHAIN} THEN 'chain' ELSE CAST(kind AS VARCHAR) END ORDER BY penalty, solvation, entry_id) AS n
        FROM (SELECT *, CASE WHEN kind = 1 AND atoms > 1 THEN 1 ELSE 0 END AS penalty,
        g + CASE WHEN {COMPLEX} OR {ION} THEN CAST({S.ENVIRONMENTS['li_ec']['correction']} AS DOUBLE) * (4 - near) ELSE 0 END AS solvation FROM mol_b) WHERE rule = 'kept') WHERE n = 1""",
    "verdict_b": """SELECT concat('k', CAST(user_id AS VARCHAR)) AS rxn_key, CAST(event_id % 2 AS INT) AS allowed, event_type AS status, abs(value) AS elapsed,
        CAST(event_id AS DOUBLE) AS ts, CASE WHEN event_id % 3 = 0 THEN '0.9' ELSE '1.0.0' END AS mapper_version FROM events""",
}


def sql(query: str) -> str:
    """The query with the views it needs as a WITH chain."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name, body in SQL.items():
            if name in text and name not in needed and name not in open_:
                open_.append(name)  # a recursive view names itself
                need(body)
                needed.append(name)

    open_: list[str] = []
    need(query)
    return f"WITH RECURSIVE {', '.join(f'{n} AS ({SQL[n]})' for n in needed)} {query}" if needed else query

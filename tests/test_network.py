"""The network's operators on hand-built molecules and small logs."""

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxloom import schema as S
from fluxloom.config import RunConfig, load_config
from fluxloom.functions import graphs, text, thermo
from fluxloom.operators import analysis, bucketing, enumeration, flux, mapper, ordering, rules, simulate
from fluxloom.operators import species as sp
from fluxloom.plans import driver, status
from fluxloom.sources import readers, writers
from fluxloom.streaming import live

E = ["n_a", "n_b"]


@pytest.fixture(scope="module")
def small(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, int(rnd.integers(0, 3)), int(rnd.integers(0, 3))) for i in range(14)]
    return rows, spark.createDataFrame(rows, "ind int, n_a int, n_b int")


def ids(spark, x):
    return spark.createDataFrame([(i,) for i in x], "ind int")


def brute_complexes(n, core, new=None, unary=True, inside=True):
    fresh, old = set(core if new is None else new), set() if new is None else set(core) - set(new)
    out = set()
    for a, b in itertools.combinations_with_replacement(range(n), 2):
        if not {a, b} & fresh or {a, b} & old or (not inside and new is None and {a, b} <= fresh):
            continue
        out.add((a, b))
    return out | ({(s, -1) for s in fresh} if unary else set())


@pytest.mark.parametrize("core,new,inside", [([0, 1, 2], None, True), ([0, 1, 2], None, False), ([0, 1, 2, 5, 6], [5, 6], True), ([0, 1], [], True)])
def test_complexes(spark, small, core, new, inside):
    _, d = small
    got = bucketing.complexes(d, ids(spark, core), E, None if new is None else ids(spark, new), pairs_in_core=inside, blocks=4)
    rows = [(r.s1, r.s2) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute_complexes(14, core, new, inside=inside)
    if new:
        k, old = len(new), len(core) - len(new)
        assert sum(b != -1 for _, b in rows) == k * (14 - old - k) + k * (k + 1) // 2


def test_full_is_the_union_of_increments(spark, small):
    _, d = small
    whole = {(r.s1, r.s2) for r in bucketing.complexes(d, ids(spark, [0, 1, 2]), E).collect()}
    first = {(r.s1, r.s2) for r in bucketing.complexes(d, ids(spark, [0, 1]), E).collect()}
    more = {(r.s1, r.s2) for r in bucketing.complexes(d, ids(spark, [0, 1, 2]), E, ids(spark, [2])).collect()}
    assert first | more == whole and not first & more


def test_candidates_are_the_brute_ones(spark, small):
    rows, d = small
    comp = {i: (a, b) for i, a, b in rows}
    add = lambda s: tuple(map(sum, zip(*(comp[x] for x in s if x >= 0), strict=True)))
    sides = [(i, -1) for i in comp] + list(itertools.combinations_with_replacement(comp, 2))
    c = bucketing.complexes(d, ids(spark, [0, 1]), E)
    index = enumeration.product_index(d, E, c, blocks=3)
    got = [tuple(r) for r in enumeration.candidates(c, index, E).collect()]
    left = [s for s in sides if s[0] in (0, 1) or s[1] in (0, 1)]
    want = {(*a, *b) for a in left for b in sides if a != b and add(a) == add(b)}
    assert len(got) == len(set(got)) and set(got) == want
    near = enumeration.touching(spark.createDataFrame([(0, 5, 1, 2), (4, 5, 0, 1), (6, -1, 0, -1)], "reactant_1 int, reactant_2 int, product_1 int, product_2 int"), ids(spark, [0, 1]))
    assert [tuple(r) for r in near.collect()] == [(0, 5, 1, 2)]


def test_groups(spark):
    rows = spark.createDataFrame([(i, -1, 0, 0) for i in range(6)] + [(9, -1, 1, 0)], "s1 int, s2 int, n_a int, n_b int")
    g = bucketing.grouped(rows, E, 3)
    assert sorted(r.group_id for r in g.filter("composition_id = 0").collect()) == [0, 0, 0, 1, 1, 1]
    assert {r.composition_id: r["count"] for r in bucketing.group_counts(g, 3).collect()} == {0: 3, 1: 1}
    assert tuple(bucketing.stats(rows, E).first()) == (7, 7, 0, 2)


def test_numbering_and_dedup(spark):
    rows = spark.createDataFrame([(2, 1, 3, -1), (1, 2, -1, 3), (1, 2, 4, -1), (5, -1, 6, -1)], "reactant_1 int, reactant_2 int, product_1 int, product_2 int")
    old = spark.createDataFrame([(-1, 5, 6, -1)], rows.schema)
    new = enumeration.numbered(enumeration.fresh(rows, old), 10)
    assert sorted(r.reaction_id for r in new.collect()) == [10, 11]
    assert enumeration.duplicate_groups(rows).first().n == 2 and enumeration.duplicate_groups(new).count() == 0


@pytest.mark.parametrize("advisory", ["64m", "64k"])
def test_numbers_of_many_wide_rows(spark, advisory):
    """As many ids as rows, each once, in order, however ranges are merged."""
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", advisory)
    try:
        n = 3_000_000 if advisory == "64m" else 200_000
        rows = spark.range(n).selectExpr("xxhash64(id) AS k", "repeat(hex(xxhash64(id, 1)), 8) AS wide")
        got = ordering.numbered(rows, ["k"], "no", 5)
        assert got.columns == ["k", "wide", "no"]
        assert tuple(got.agg(F.count("*"), F.countDistinct("no"), F.min("no"), F.max("no")).first()) == (n, n, 5, n + 4)
        # In order: the numbers' ranges and the keys' ranges agree.
        parts = got.groupBy(F.floor(F.col("no") / 1000).alias("p")).agg(F.min("k").alias("low"), F.max("k").alias("high")).orderBy("p").collect()
        assert all(a.high < b.low for a, b in itertools.pairwise(parts))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_running_totals_and_percentiles(spark):
    rnd = np.random.default_rng(4)
    rows = [(None if g == 3 else f"g{g}", float(v)) for g, v in zip(rnd.integers(0, 4, 5000), rnd.integers(0, 700, 5000), strict=True)] + [("g0", None)]
    d = spark.createDataFrame(rows, "g string, v double")
    total = ordering.running(d.filter("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("k")), ["v"], "k", "upto")
    values = sorted(v for _, v in rows if v is not None)
    assert {r.v: r.upto for r in total.collect()} == {v: i + 1 for i, v in enumerate(values)}

    def at(v):
        n = len(v)
        return v[n // 2], v[min(int(n * 0.95), n - 1)], v[min(int(n * 0.99), n - 1)]

    assert tuple(analysis.percentiles(d, "v").first()) == at(values)
    got = {r.g: (r.p50, r.p95, r.p99) for r in analysis.percentiles(d, "v", "g").collect()}
    assert got == {g: at(sorted(v for h, v in rows if h == g and v is not None)) for g in ("g0", "g1", "g2", None)}
    assert tuple(analysis.percentiles(d.limit(0), "v").first()) == (None, None, None) and analysis.percentiles(d.limit(0), "v", "g").count() == 0


def test_appended_ids_are_checked(spark, tmp_path, monkeypatch):
    rows = spark.range(50).selectExpr("CAST(id AS INT) reactant_1", "-1 reactant_2", "CAST(id + 1 AS INT) product_1", "-1 product_2", "1 number_of_reactants", "1 number_of_products", "1.0D rate", "0.0D dG", "0.0D dG_barrier", "0 is_redox")
    assert writers.append_reactions(rows, str(tmp_path / "net"), 1, None, 7) == 50
    monkeypatch.setattr(writers, "numbered", lambda d, offset: d.withColumn("reaction_id", F.lit(offset).cast("long")))
    with pytest.raises(AssertionError, match="ids"):
        writers.append_reactions(rows, str(tmp_path / "net"), 2, None, 7)


# --- molecules


def mol(symbols, bonds, charge=0, energy=0.0, **more):
    labels = {i: s for i, s in enumerate(symbols) if s not in S.METALS}
    edges = [(u, v) for u, v, *_ in bonds if u in labels and v in labels]
    formula = "".join(f"{e}{symbols.count(e)}" for e in sorted(set(symbols)))
    return {
        "entry_id": formula + str(bonds) + str(charge), "formula": formula, "charge": charge, "spin_multiplicity": 1, "num_atoms": len(symbols),
        "atoms": [{"symbol": s, "x": float(i), "y": 0.0, "z": 0.0} for i, s in enumerate(symbols)], "bonds": [{"u": u, "v": v, "ord": (o or [1])[0]} for u, v, *o in bonds],
        "n_by_element": {e: symbols.count(e) for e in set(symbols)}, "comp_key": "_".join(sorted(symbols)), "is_metal": formula in S.METAL_FORMULAS,
        "free_energy": energy, "solvation_free_energy": energy, "electron_affinity": None, "ionization_energy": None, "penalty": 0,
        "covalent_hash": graphs.part_hash(labels, sorted(labels), edges), "full_hash": graphs.wl_hash(symbols, [(u, v) for u, v, *_ in bonds]),
        "star_counts": graphs.star_counts(labels, edges), "bond_counts": graphs.bond_counts(labels, edges), "fragments": graphs.fragments(labels, edges),
        "ring_fragments": graphs.ring_fragments(labels, edges),
    } | more


POOL_SCHEMA = S.SPECIES + f", full_hash string, ring_fragments {S.FRAGMENTS}"
WATER, OH, H = mol(list("OHH"), [(0, 1), (0, 2)], energy=-3.0), mol(list("OH"), [(0, 1)], energy=-1.0), mol(["H"], [], energy=-0.5)
LI, LI_OH = mol(["Li"], [], 1, -1.0), mol(["Li", "O", "H"], [(1, 2), (0, 1, 0)], 1, -2.5)
OH_ION, HOOH, PEROXY = mol(list("OH"), [(0, 1)], -1, -2.0), mol(list("OOHH"), [(0, 1), (0, 2), (1, 3)], energy=-2.6), mol(list("OOH"), [(0, 1), (1, 2)], energy=-1.2)
ETHER, RING = mol(list("COC"), [(0, 1), (1, 2)], energy=-2.0), mol(list("CCCC"), [(0, 1), (1, 2), (2, 3), (0, 3)], energy=-4.0)
ETHENE = mol(list("CC"), [(0, 1, 2)], energy=-2.5)
POOL = [WATER, OH, H, LI, LI_OH, OH_ION, HOOH, PEROXY, ETHER, RING, ETHENE]


@pytest.fixture(scope="module")
def pool(spark):
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(POOL_SCHEMA)
    return spark.createDataFrame([tuple(({"ind": i} | m).get(f) for f in schema.names) for i, m in enumerate(POOL)], schema)


def judged(spark, pool, *reactions, efe=-1.4, tree=None):
    rows = spark.createDataFrame(reactions, "reactant_1 int, reactant_2 int, product_1 int, product_2 int")
    d = rules.judged(enumeration.attached(rows, pool), rules.Context(efe), tree or rules.default_tree())
    return {tuple(r[:4]): r for r in d.select(*enumeration.KEYS, "verdict", "rule", "dq", "dG", "rate", "dG_barrier").collect()}


def test_default_tree(spark, pool):
    got = judged(
        spark, pool,
        (0, -1, 1, 2), (1, 2, 0, -1), (1, -1, 5, -1), (5, -1, 1, -1), (0, 1, 1, 0), (3, 1, 4, -1), (3, 2, 3, 2), (6, 2, 0, 1), (1, 1, 6, -1), (3, -1, 3, -1), (5, 2, 0, -1),
    )
    rule = {k: r.rule for k, r in got.items()}
    assert rule[(0, -1, 1, 2)] == "dg"  # uphill
    assert rule[(1, 2, 0, -1)] == "matched" and got[(1, 2, 0, -1)].verdict == "KEEP"
    assert rule[(1, -1, 5, -1)] == "redox_dg" or got[(1, -1, 5, -1)].dG == pytest.approx(-2.0 + 1.0 - 1 * -1.4)
    assert rule[(3, 1, 4, -1)] in ("metal_coordination", "concerted_metal_one_product")
    assert rule[(3, 2, 3, 2)] == "covalent_decomposable"
    assert rule[(3, -1, 3, -1)] == "metal_metal" and rule[(5, 2, 0, -1)] == "redox_arity"
    assert rule[(1, 1, 6, -1)] == "matched"
    kept = got[(1, 2, 0, -1)]
    assert kept.dG == pytest.approx(-1.5) and kept.dG_barrier == 0 and kept.rate == pytest.approx(S.KB * 298.15 / S.PLANCK)
    assert judged(spark, pool, (1, -1, 5, -1), efe=-3.0)[(1, -1, 5, -1)].rule == "redox_dg"
    assert judged(spark, pool, (1, -1, 5, -1), efe=3.0)[(1, -1, 5, -1)].rule == "redox_kept"


@pytest.mark.parametrize("most", [63, 0])
def test_judging_in_parts_is_judging_at_once(spark, pool, monkeypatch, most):
    """With packed counts (63) and without (0); what is kept is the same when only that is asked for."""
    monkeypatch.setattr(rules, "MOST", most)
    sides = [(i, -1) for i in range(len(POOL))] + [(0, 1), (1, 1), (1, 2), (2, 7), (6, 2), (10, 10), (0, 7), (3, 1), (3, 2)]
    d = spark.createDataFrame([(*a, *b) for a in sides for b in sides if a != b], "reactant_1 int, reactant_2 int, product_1 int, product_2 int")
    c, tree = rules.Context(-1.4), rules.default_tree()
    tree = [*tree[:-1], ("ring_break_two", rules.ring_break_two, rules.KEEP), ("ring_form_two", rules.ring_form_two, rules.KEEP), tree[-1]]
    names = [*enumeration.KEYS, "verdict", "rule", "dq", "dG", "rate"]
    want = {tuple(r[:4]): tuple(r) for r in rules.judged(enumeration.attached(d, pool), c, tree).select(*names).collect()}
    got = {tuple(r[:4]): tuple(r) for r in rules.judge(d, pool, c, tree).select(*names).collect()}
    assert got == want and len({r[5] for r in got.values()}) > 8
    kept = {tuple(r[:4]): tuple(r) for r in rules.judge(d, pool, c, tree, keep_only=True).select(*names).collect()}
    assert kept == {k: r for k, r in want.items() if r[4] == rules.KEEP}
    # The test over totals drops none of them.
    carried = enumeration.CARRIED
    total = lambda s, f: F.col(f"{s}1.{f}") + F.coalesce(F.col(f"{s}2.{f}"), F.lit(0))
    sums = enumeration.attached(d, pool).select(*enumeration.KEYS, *(total(s, f).alias(f"{s}_{f}") for f in carried for s in "rp"))
    passed = {tuple(r[:4]) for r in sums.filter(rules.may_keep(tree, c)).select(*enumeration.KEYS).collect()}
    assert set(kept) <= passed and len(passed) < len(want)


def brute_match(a, b):
    """First pair of fragmentations by loops."""
    def combos(side):
        if len(side) == 1:
            return [[f] for f in side[0]["fragments"]]
        return [[f, g] for f in side[0]["fragments"] for g in side[1]["fragments"] if f["n_broken"] + g["n_broken"] <= 1]

    for x in combos(a):
        for y in combos(b):
            n, m = sum(f["n_frag"] for f in x), sum(f["n_frag"] for f in y)
            if len(a) == len(b) == 2 and n == m == 2:
                continue
            if sorted(h for f in x for h in f["hashes"]) == sorted(h for f in y for h in f["hashes"]):
                return n, m
    return None


def test_fragment_match_is_the_first(spark, pool):
    sides = [(i, -1) for i in range(len(POOL))] + [(0, 1), (1, 1), (1, 2), (2, 7), (6, 2), (10, 10), (0, 7)]
    rows = [(*a, *b) for a in sides for b in sides if a != b]
    d = spark.createDataFrame(rows, "reactant_1 int, reactant_2 int, product_1 int, product_2 int")
    got = enumeration.attached(d, pool).withColumn("match", rules.fragment_match(rules.Context(0.0))).select(*enumeration.KEYS, "match").collect()
    for r in got:
        want = brute_match([POOL[i] for i in r[:2] if i >= 0], [POOL[i] for i in r[2:4] if i >= 0])
        assert (None if r.match is None else (r.match.r.n_frag, r.match.p.n_frag)) == want


def test_single_rules(spark, pool):
    def one(rule, *reaction):
        d = enumeration.attached(spark.createDataFrame([reaction], "reactant_1 int, reactant_2 int, product_1 int, product_2 int"), pool)
        d = d.withColumn("match", rules.fragment_match(rules.Context(0.0)))
        return d.select(rule(rules.Context(0.0)).alias("x")).first().x

    assert one(rules.concerted_metal, 3, 1, 0, 2) and not one(rules.concerted_metal, 0, 1, 6, 2)
    assert one(rules.concerted_metal_one_product, 3, 1, 0, -1) and not one(rules.concerted_metal_one_product, 3, 1, 4, -1)
    assert one(rules.concerted_metal_one_reactant, 0, -1, 3, 1) and not one(rules.concerted_metal_one_reactant, 4, -1, 3, 1)
    assert one(rules.star_change_above(0), 0, -1, 6, -1) and not one(rules.star_change_above(0), 0, -1, 0, -1)
    assert one(rules.bond_change_above(2), 0, -1, 9, -1) and not one(rules.bond_change_above(2), 0, -1, 1, 2)
    assert one(rules.charge_change_above(1), 5, -1, 3, -1) and not one(rules.charge_change_above(1), 1, -1, 5, -1)
    assert one(rules.other_skeleton, 0, -1, 1, -1) and not one(rules.other_skeleton, 1, -1, 5, -1)
    assert one(rules.ring_break_two, 9, -1, 10, 10) and one(rules.ring_form_two, 10, 10, 9, -1) and not one(rules.ring_break_two, 8, -1, 10, 10)
    assert one(lambda c: rules.bond_delta_within(c, 1), 0, -1, 1, 2) and not one(lambda c: rules.bond_delta_within(c, 1), 9, -1, 1, 2)
    with pytest.raises(ValueError):
        rules.dg_above(0.0, "enthalpy")


def test_marcus(spark):
    d = spark.sql("SELECT named_struct('electron_affinity', 1.0D, 'ionization_energy', CAST(NULL AS DOUBLE)) r, named_struct('electron_affinity', CAST(NULL AS DOUBLE), 'ionization_energy', 2.0D) p")
    col = lambda dq: thermo.marcus_barrier(F.lit(-0.5), F.lit(dq), F.col("r"), F.col("p"))
    a, b, c = d.select(col(-1), col(1), col(2)).first()
    total = 1.5 + thermo.outer_reorganization()
    assert a == pytest.approx(total / 4 * (1 - 0.5 / total) ** 2) and b is None and c is None
    assert d.select(thermo.cost(F.lit(-100.0))).first()[0] == pytest.approx(1.0)
    assert d.select(thermo.free_energy(F.lit(1.0), F.lit(None).cast("double"), F.lit(1.0))).first()[0] is None


# --- graphs


def permuted(symbols, bonds, seed):
    p = np.random.default_rng(seed).permutation(len(symbols))
    return [symbols[int(np.flatnonzero(p == i)[0])] for i in range(len(symbols))], [(int(p[u]), int(p[v])) for u, v in bonds]


def test_graphs():
    s, b = list("CCOHHH"), [(0, 1), (1, 2), (0, 3), (0, 4), (2, 5)]
    for seed in range(8):
        t, c = permuted(s, b, seed)
        assert graphs.wl_hash(s, b) == graphs.wl_hash(t, c) and graphs.isomorphic(s, b, t, c)
    assert not graphs.isomorphic(s, b, s, [*b[:-1], (1, 5)]) and graphs.wl_hash(s, b) != graphs.wl_hash(s, [*b[:-1], (1, 5)])
    six, two = [(i, (i + 1) % 6) for i in range(6)], [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5)]
    assert graphs.wl_hash(list("CCCCCC"), six) == graphs.wl_hash(list("CCCCCC"), two) and not graphs.isomorphic(list("CCCCCC"), six, list("CCCCCC"), two)
    f = graphs.fragments({0: "O", 1: "H", 2: "H"}, [(0, 1), (0, 2)])
    assert [x["n_frag"] for x in f] == [1, 2, 2] and graphs.components([0, 1, 2], [(0, 2)]) == [[0, 2], [1]]
    assert graphs.fragments({}, []) == [] and graphs.bond_counts({0: "O", 1: "H"}, [(0, 1)]) == {"H-O": 1}


# --- species


def raw(name, symbols, xyz, bonds, charge=0, spin=1, nbo=None, spins=None, e=-1.0, h=0.0, s=0.0, **more):
    n = len(symbols)
    return {
        "molecule_id": name, "number_atoms": n, "spin_multiplicity": spin, "charge": charge, "atoms": [{"symbol": a, "x": p[0], "y": p[1], "z": p[2]} for a, p in zip(symbols, xyz, strict=True)],
        "bonds": [{"u": u, "v": v, "ord": 1} for u, v in bonds], "thermo": {"raw": {"electronic_energy_Ha": e, "total_enthalpy_kcal/mol": h, "total_entropy_cal/molK": s}},
        "partial_charges": {"resp": [0.1] * n, "mulliken": nbo or [0.1] * n, "nbo": nbo or [0.1] * n}, "partial_spins": {"mulliken": spins, "nbo": spins}, "redox": None,
    } | more


def test_species_pool(spark, tmp_path):
    line = lambda n: [(float(i), 0.0, 0.0) for i in range(n)]
    docs = [
        raw("li", ["Li"], line(1), [], 1, nbo=[0.9]), raw("li0", ["Li"], line(1), [], 0, nbo=[0.9]), raw("na", ["Na"], line(1), [], 1, nbo=[0.9]),
        raw("two_h", list("OHO"), line(3), [(0, 1), (1, 2)]), raw("water_a", list("OHH"), line(3), [(0, 1), (0, 2)], e=-2.0), raw("water_b", list("HOH"), line(3), [(0, 1), (1, 2)], e=-2.5),
        raw("apart", list("CC"), line(2), []), raw("charged", list("CC"), line(2), [(0, 1)], 2), raw("radical", list("CCO"), line(3), [(0, 1), (1, 2)], spin=2, spins=[0.5, 0.5, 0.0]),
        raw("coordinated", ["Li", "O", "C"], line(3), [(1, 2)], 1, nbo=[0.9, -0.5, 0.1]), raw("bare_carbon", ["Li", "C", "C"], line(3), [(0, 1), (1, 2)], 1, nbo=[0.9, 0.5, 0.5]),
        raw("hot_metal", ["Li", "O"], line(2), [(0, 1)], 1, nbo=[1.5, -0.5]), raw("neutral", ["Li", "O"], line(2), [(0, 1)], 0, nbo=[0.01, -0.5]),
    ]
    path = tmp_path / "species.json"
    path.write_text(json.dumps(docs))
    d = readers.raw_species(spark, str(path))
    chosen, every = sp.pool(d, "li_ec")
    rule = {r.entry_id: r.rule for r in every.collect()}
    assert rule == {
        "li": "kept", "li0": "metal_ion", "na": "unknown_metal", "two_h": "not_connected", "water_a": "kept", "water_b": "kept", "apart": "not_connected", "charged": "charge",
        "radical": "kept", "coordinated": "kept", "bare_carbon": "bad_coordination", "hot_metal": "unknown_metal", "neutral": "neutral_metal",
    }
    got = {r.entry_id: r for r in chosen.collect()}
    assert set(got) == {"li", "water_b", "radical", "coordinated"} and sorted(r.ind for r in got.values()) == [0, 1, 2, 3]
    assert got["radical"].penalty == 1 and got["water_b"].free_energy == pytest.approx(-2.5 * S.HARTREE_EV)
    assert got["li"].solvation_free_energy == pytest.approx(-S.HARTREE_EV - 0.68 * 4) and got["coordinated"].solvation_free_energy == pytest.approx(-S.HARTREE_EV - 0.68 * 3)
    assert {r.rule: r.n for r in sp.exclusion_counts(every).collect()}["not_connected"] == 2
    assert sp.lowest_energy(chosen, "H2 O1", 0) == got["water_b"].ind and sp.lowest_energy(chosen, "C9", 0) is None and sp.by_entry_id(chosen, "li") == got["li"].ind
    assert sp.by_structure(chosen, [{"symbol": s, "x": 0.0, "y": 0.0, "z": 0.0} for s in "HHO"], [{"u": 0, "v": 2}, {"u": 1, "v": 2}], 0) == got["water_b"].ind
    xyz = tmp_path / "w.xyz"
    xyz.write_text("3\nwater\nO 0 0 0\nH 0.96 0 0\nH -0.24 0.93 0\n")
    r = readers.xyz_files(spark, str(xyz)).first()
    assert [(b.u, b.v) for b in r.bonds] == [(0, 1), (0, 2)]
    lines = tmp_path / "lines"
    spark.createDataFrame([(json.dumps(x),) for x in docs], "value string").coalesce(1).write.text(str(lines))
    assert readers.raw_species(spark, str(lines)).count() == len(docs)
    twice = sp.pool(d.unionByName(d).unionByName(d.filter("molecule_id = 'water_a'").withColumn("molecule_id", F.lit("li"))), "li_ec")[0]
    assert sorted(r.entry_id for r in twice.collect()) == ["coordinated", "li", "radical", "water_b"]
    own = [("large", F.col("num_atoms") > 2)]
    assert {r.rule for r in sp.pool(d, "li_ec", tree=own)[1].collect()} == {"large", "kept"}
    with pytest.raises(ValueError):
        sp.Environment.named("water")
    with pytest.raises(Exception, match="required field"):
        sp.flattened(d.withColumn("charge", F.lit(None).cast("int"))).collect()


# --- mapper


def simple(m):
    return [a["symbol"] for a in m["atoms"]], [(b["u"], b["v"], b["ord"]) for b in m["bonds"]]


def brute_mapping(rs, ps):
    r, p = mapper.Side.of(rs), mapper.Side.of(ps)
    best = None
    for perm in itertools.permutations(range(len(p.symbols))):
        if any(r.symbols[i] != p.symbols[j] for i, j in enumerate(perm)):
            continue
        e = mapper.edits(r, p, list(perm))
        back = {j: i for i, j in enumerate(perm)}
        now = {tuple(sorted((back[a], back[b]))): n for (a, b), n in p.orders.items()}
        units = sum(abs(now.get(x, 0) - r.orders.get(x, 0)) for x in {*now, *r.orders})
        best = min(best, e.rank(units)) if best else e.rank(units)
    return best


@pytest.mark.parametrize(
    "left,right",
    [([WATER], [OH, H]), ([OH, OH], [HOOH]), ([HOOH, H], [WATER, OH]), ([WATER, OH], [OH, WATER]), ([PEROXY, H], [HOOH]), ([RING], [ETHENE, ETHENE]), ([ETHER], [ETHER]), ([LI, OH], [LI_OH]), ([HOOH, OH], [WATER, PEROXY])],
)
def test_mapper_finds_the_best(left, right):
    rs, ps = [simple(m) for m in left], [simple(m) for m in right]
    ok, state, to, e = mapper.mapped(rs, ps, 10)
    r, p = mapper.Side.of(rs), mapper.Side.of(ps)
    back = {j: i for i, j in enumerate(to)}
    now = {tuple(sorted((back[a], back[b]))): n for (a, b), n in p.orders.items()}
    units = sum(abs(now.get(x, 0) - r.orders.get(x, 0)) for x in {*now, *r.orders})
    assert state == "mapped" and e.rank(units) == brute_mapping(rs, ps) and ok == e.elementary


def test_mapper_verdicts():
    assert mapper.by_hand([simple(WATER)], [simple(OH), simple(H)])["allowed"]
    assert mapper.by_hand([simple(HOOH), simple(H)], [simple(WATER), simple(OH)])["allowed"]  # broken and formed share an atom
    apart = [(["C", "O", "N", "S"], [(0, 1, 1)])], [(["C", "O", "N", "S"], [(2, 3, 1)])]
    assert mapper.by_hand(*apart)["allowed"] is False
    assert mapper.by_hand([(["C", "O"], [(0, 1, 2)])], [(["C"], []), (["O"], [])])["allowed"] is False  # a double bond at once
    assert mapper.by_hand([(["C", "O"], [(0, 1, 2)])], [(["C", "O"], [(0, 1, 1)])])["changed"] == [((0, 1), 2, 1)]
    assert mapper.by_hand([simple(WATER)], [simple(OH)])["status"] == "no_mapping"
    big = (["C"] * 14, [(i, j, 1) for i in range(14) for j in range(i) if (i * j) % 3])
    other = (["C"] * 14, [(i, j, 1) for i in range(14) for j in range(i) if (i + j) % 4])
    assert mapper.mapped([big], [other], 0.0)[1] in ("timeout", "mapped")


def test_mapper_stage_and_cache(spark, pool, tmp_path):
    rows = spark.createDataFrame([(1, 2, 0, -1), (2, 1, 0, -1), (6, 2, 0, 1), (9, -1, 10, 10)], "reactant_1 int, reactant_2 int, product_1 int, product_2 int")
    d = enumeration.attached(rows, pool)
    staged, new = mapper.mapper_stage(d, rules.Context(0.0), None, 10.0)
    got = {r.rxn_key: r for r in new.collect()}
    assert len(got) == 3 and sorted(r.status for r in got.values()) == ["allowed", "allowed", "rejected"]
    path = str(tmp_path / "cache")
    writers.verdicts(mapper.storable(new), path)
    cache = readers.verdict_cache(spark, path)
    assert mapper.mapper_stage(d, rules.Context(0.0), cache)[1].count() == 0
    kept = mapper.verdicts(staged, cache).select(*enumeration.KEYS).collect()
    assert {tuple(r) for r in kept} == {(1, 2, 0, -1), (2, 1, 0, -1), (6, 2, 0, 1)}
    assert mapper.current(cache, "0.9").count() == 0 and readers.verdict_cache(spark, str(tmp_path / "none")).count() == 0
    other = cache.limit(1).withColumn("allowed", F.lit(0)).withColumn("ts", F.lit(1.0))
    m = {r.rxn_key: r.allowed for r in mapper.merged(cache, other).collect()}
    assert len(m) == 3 and m[other.first().rxn_key] == 0
    assert {r.status: r.n for r in analysis.verdict_stats(cache).collect()} == {"allowed": 2, "rejected": 1}


def test_mapper_csv(spark, tmp_path):
    side = lambda *m: json.dumps([{"symbols": simple(x)[0], "bonds": [{"u": u, "v": v, "ord": o} for u, v, o in simple(x)[1]]} for x in m])
    rows = spark.createDataFrame([(2, side(WATER), side(OH, H)), (1, side(OH), side(WATER))], "reaction_id long, reactant string, product string")
    rows.write.option("header", True).option("escape", '"').csv(str(tmp_path / "in"))
    d = readers.mapper_csv(spark, str(tmp_path / "in"))
    done = mapper.map_reactions(d, 5.0).select(F.col("rxn_key").cast("long").alias("reaction_id"), "status", "n_bonds_broken", "bonds_broken")
    writers.mapper_csv(done, str(tmp_path / "out"))
    got = {int(r.reaction_id): r for r in spark.read.option("header", True).csv(str(tmp_path / "out")).collect()}
    assert got[2].status == "allowed" and got[2].n_bonds_broken == "1" and got[1].status == "no_mapping"


# --- logs


@pytest.fixture(scope="module")
def run_log(spark):
    net = [(0, 0, -1, 1, -1, -1.0), (1, 1, 2, 3, -1, -0.5), (2, 3, -1, 1, 2, -0.1), (3, 0, 2, 4, 1, -0.2), (4, 3, 3, 5, -1, -0.3)]
    network = spark.createDataFrame([(a, 1 + (c >= 0), 1 + (e >= 0), b, c, d, e, 1.0, g, 0.0, 0, 1) for a, b, c, d, e, g in net], S.REACTIONS)
    initial = spark.createDataFrame([(0, 30), (1, 0), (2, 20), (3, 0), (4, 0), (5, 0)], S.INITIAL_STATE)
    log = simulate.simulated(network, initial, 6, 60, 100)
    rows = [tuple(r) for r in log.orderBy("seed", "step").collect()]
    return net, network, initial, spark.createDataFrame(rows, S.TRAJECTORIES), rows


def test_simulation(spark, run_log):
    net, network, initial, log, rows = run_log
    again = simulate.simulated(network, initial, 6, 60, 100).orderBy("seed", "step").collect()
    assert [tuple(r) for r in again] == rows
    start = {r.species_id: r["count"] for r in initial.collect()}
    for seed in {r[0] for r in rows}:
        count, before = dict(start), 0.0
        for _, _, rid, t in (r for r in rows if r[0] == seed):
            _, a, b, c, d, _ = net[rid]
            for s, k in ((a, -1), (b, -1), (c, 1), (d, 1)):
                if s >= 0:
                    count[s] += k
            assert min(count.values()) >= 0 and t > before
            before = t
    none = spark.createDataFrame([(0, 0)], S.INITIAL_STATE)
    assert simulate.simulated(network, none, 2, 10).count() == 0


def test_flux(spark, run_log):
    net, network, initial, log, rows = run_log
    made, used, rx = {}, {}, {}
    for _, _, rid, _ in rows:
        _, a, b, c, d, _ = net[rid]
        for s in (a, b):
            used[s] = used.get(s, 0) + 1
        for s in (c, d):
            made[s] = made.get(s, 0) + 1
        for s in (a, b, c, d):
            rx.setdefault(s, set()).add(rid)
    got = {r.species_id: r for r in flux.species_flux(network, log).collect()}
    assert set(got) == {s for s in rx if s >= 0}
    for s, r in got.items():
        assert (r.produced, r.consumed, r.touched, r.n_rxns) == (made.get(s, 0), used.get(s, 0), made.get(s, 0) + used.get(s, 0), len(rx[s]))
    p = flux.promoted(flux.species_flux(network, log), ids(spark, [0, 2]), fraction=0.05).collect()
    limit = 0.05 * sum(r.produced for r in got.values())
    assert [(r.species_id, r.produced) for r in p] == sorted(((s, r.produced) for s, r in got.items() if r.produced >= limit and s not in (0, 2)), key=lambda x: (-x[1], x[0]))
    empty = flux.species_flux(network, log.limit(0))
    assert flux.promoted(empty, ids(spark, [0])).count() == 0 and tuple(flux.summary(empty).first())[:2] == (0, 0)


def brute_path(net, initial, log, target, before=float("inf")):
    for step, rid in log:
        if step >= before:
            return []
        if target in net[rid][3:5]:
            break
    else:
        return []
    a, b, *_ = reactants = [s for s in net[rid][1:3]]
    heads = []
    for s in (a, b):
        if s >= 0 and initial[s] == 0:
            head = brute_path(net, initial, log, s, step)
            if head:
                heads.append(head)
                if sorted(x for x in reactants if x >= 0) == sorted(x for x in net[head[-1]][3:5] if x >= 0):
                    return head + [rid]
    out = [rid]
    for h in heads:
        out = h + out
    return out


def test_analysis(spark, run_log):
    net, network, initial, log, rows = run_log
    start = {r.species_id: r["count"] for r in initial.collect()}
    seeds = sorted({r[0] for r in rows})
    logs = {s: [(r[1], r[2]) for r in rows if r[0] == s] for s in seeds}
    got = {(r.seed, r.species_id): list(r.pathway) for r in analysis.pathways(network, log, initial).collect()}
    want = {(s, x): p for s in seeds for x in start if (p := brute_path(net, start, logs[s], x))}
    assert got == want
    table = analysis.pathway_table(analysis.pathways(network, log, initial), network)
    assert sum(r.frequency for r in table.filter("species_id = 3").collect()) == sum(x == 3 for _, x in want)
    assert {r.species_id: r.length for r in analysis.shortest(table, initial).collect()}[0] == "unreachable"
    assert analysis.pathway_report(table, 3, 1).count() == 1
    state = {(s, x): start[x] for s in seeds for x in start}
    series = {(r.seed, r.step, r.species_id): r["count"] for r in analysis.state_series(network, log, initial).collect()}
    for s, step, rid, _ in rows:
        for x, k in zip(net[rid][1:5], (-1, -1, 1, 1), strict=True):
            if x >= 0:
                state[(s, x)] += k
        for x in {*net[rid][1:5]} - {-1}:
            assert series[(s, step, x)] == state[(s, x)]
    final = {r.species_id: r.expected for r in analysis.final_state(network, log, initial).collect()}
    assert all(final[x] == pytest.approx(sum(state[(s, x)] for s in seeds) / len(seeds)) for x in start)
    sinks = {r.species_id: r for r in analysis.sinks(network, log, initial).collect()}
    assert all(r.ratio == (1e10 if not r.n_consumed else pytest.approx(r.n_produced / r.n_consumed)) for r in sinks.values())
    padded = analysis.padded_series(analysis.state_series(network, log, initial), initial, 60, log.select("seed").distinct())
    mean = {(r.species_id, r.step): r["mean"] for r in analysis.mean_series(network, log, initial, 60, len(seeds)).collect()}
    assert mean[(3, 59)] == pytest.approx(final[3])
    assert analysis.tally(log, 0).first().firings == max(sum(r[2] == i for r in rows) for i in range(5))
    assert {r.n_reactions for r in analysis.tally_totals(network, log).collect()} == {len({r[2] for r in rows})}
    for n in (1, 2, 5, 100):
        d = spark.createDataFrame([(float(i % 7),) for i in range(n)], "v double")
        x = sorted(float(i % 7) for i in range(n))
        assert tuple(analysis.percentiles(d, "v").first()) == (x[n // 2], x[min(int(0.95 * n), n - 1)], x[min(int(0.99 * n), n - 1)])


def test_streaming(spark, run_log, tmp_path):
    net, network, initial, log, rows = run_log
    log.coalesce(1).write.parquet(str(tmp_path / "log"))
    q = live.live_flux(live.firing_stream(spark, str(tmp_path / "log")), network).writeStream.outputMode("complete").format("memory").queryName("live_flux").start()
    q.processAllAvailable()
    q.stop()
    want = {r.species_id: (r.produced, r.consumed) for r in flux.species_flux(network, log).collect()}
    assert {r.species_id: (r.produced, r.consumed) for r in spark.table("live_flux").collect()} == want


# --- the whole run


def test_run_resumes_and_reports(spark, pool, tmp_path):
    path = str(tmp_path / "species")
    pool.write.parquet(path)
    cfg = {"species_path": path, "out_dir": str(tmp_path / "a"), "electron_free_energy": -1.4, "initial_state_counts": {"1": 40, "2": 40}, "n_simulations": 4, "step_cutoff": 50, "max_iterations": 4, "pathway_ev_cutoff": 1.0, "_note": "x", "extra": 1}
    (tmp_path / "run.json").write_text(json.dumps(cfg))
    c, ignored = load_config(str(tmp_path / "run.json"))
    assert ignored == ["extra"] and c.initial_state_counts == {1: 40, 2: 40}
    state = driver.run(spark, c)
    net = readers.Network.open(spark, c.out_dir)
    assert net.reactions.count() == sum(state.per_iter_rxn_counts) > 0 and enumeration.duplicate_groups(net.reactions).count() == 0
    assert sorted(r.reaction_id for r in net.reactions.collect()) == list(range(net.reactions.count()))
    by = {i: m for i, m in enumerate(POOL)}
    for r in net.reactions.collect():
        left, right = [x for x in r[3:5] if x >= 0], [x for x in r[5:7] if x >= 0]
        assert sorted(a["symbol"] for x in left for a in by[x]["atoms"]) == sorted(a["symbol"] for x in right for a in by[x]["atoms"])
    import dataclasses

    d = dataclasses.replace(c, out_dir=str(tmp_path / "b"))
    driver.run(spark, d, max_new_iterations=1)
    again = driver.run(spark, d)
    assert again.core_ids == state.core_ids and again.per_iter_rxn_counts == state.per_iter_rxn_counts
    facts = status.collect(spark, c.out_dir)
    assert status.anomalies(facts) == [] and "reactions" in status.render(facts)
    assert (tmp_path / "a/reports/convergence.md").exists() and (tmp_path / "a/reports/sinks.tex").exists()
    with pytest.raises(ValueError, match="positive"):
        driver.resolve_seeds(RunConfig(path, "x", 0.0, seed_species=(1,)), pool)
    assert driver.resolve_seeds(RunConfig(path, "x", 0.0, seed_species_query=(("H2 O1", 0, 5),)), pool) == {0: 5}


def test_qubo(spark):
    from fluxloom.functions import qubo

    q, c = qubo.coefficients([(2.0, ("x", "x")), (1.0, ("y", "x")), (-3.0, ("y",)), (5.0, ())])
    assert q == {("x", "x"): 2.0, ("x", "y"): 1.0, ("y", "y"): -3.0} and c == 5.0
    with pytest.raises(ValueError):
        qubo.coefficients([(1.0, ("a", "b", "c"))])
    nodes, edges = list("abcdef"), [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("a", "f"), ("a", "d")]
    got = qubo.annealed(qubo.independent_set(nodes, edges), reads=30)
    sets = [{n for n, v in x.items() if v} for x, _ in got]
    assert {-e for _, e in got} == {3.0} and all(not any({a, b} <= s for a, b in edges) for s in sets)
    t = qubo.table(spark, [{"x": 1, "y": 0}, {"x": 0, "y": 1}, {"x": 2, "y": 5}])
    assert [r.solution for r in qubo.best(t, F.col("x") + F.col("y"), qubo.at_most(F.lit(1.0), F.col("x"))).collect()] == [0]
    assert qubo.best(t, F.col("x"), F.col("x") < 0).count() == 0


def test_annealed_mapping():
    r, p = mapper.Side.of([simple(HOOH), simple(H)]), mapper.Side.of([simple(WATER), simple(OH)])
    to, e = mapper.annealed(r, p, mapper.time.monotonic() + 20)
    assert e.elementary and sorted(to) == list(range(5))


def test_text(spark):
    d = spark.sql("SELECT array('b', '', 'a', NULL) r, array('c') p, 'C3H4O10' f")
    assert d.select(text.reaction_key(F.col("r"), F.col("p"))).first()[0] == "a.b>>c"
    assert d.select(text.formula_counts(F.col("f"))).first()[0] == {"C": 3, "H": 4, "O": 10}
    assert text.query_parts("Li 1:1") == ("Li1", 1) and text.duration(3700) == "1h01m" and text.size(2048) == "2.0 KB"

"""Reaction rules as columns over structs r1, r2, p1, p2, and trees compiled to one CASE.

A rule maps a Context to a boolean Column; a tree is a list of (name, rule,
outcome), an outcome being KEEP, DISCARD or a tree.  The first rule that holds
decides; where none does, or a rule is null, the row goes on and is discarded in
the end.  compiled() gives the verdict and the deciding rule's name.

judge() takes candidates by ids and decides in parts, each written before the
next, so that no part's generated code grows beyond what the JVM compiles and
few rows reach the costly ones: rules over charges, energies and hashes; then
stars and bonds, whose counts are packed in words and compared by arithmetic;
then sums of hashes of fragmentations; and for rows with a sum in common the
fragments.  may_keep() is a test over totals alone, for the join that makes
candidates.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxloom import schema as S
from fluxloom import shared
from fluxloom.functions import thermo
from fluxloom.operators import bucketing, ordering
from fluxloom.operators.enumeration import CARRIED, KEYS, attached, candidates, product_index, unique_ids

KEEP, DISCARD = "KEEP", "DISCARD"
#: What rules over charges, energies and hashes read, and what rules over graphs do.
NARROW = ["ind", "charge", "free_energy", "solvation_free_energy", "is_metal", "covalent_hash"]
GRAPH = ["star_counts", "bond_counts", "ring_fragments"]
#: Keys of a map of counts that don't count as a change.
LEFT_OUT = {"star_counts": (), "bond_counts": S.COORDINATE_PAIRS}
#: Words of packed counts, bytes in each, and the most that one byte may hold so that two add up.
WORDS, LANES, MOST = 3, 7, 63
#: Columns of summed().
SUMS = ["whole", "once", "more"]


@dataclass(frozen=True)
class Context:
    """packed: maps whose counts with_words() has packed, and whether exactly.  totals: sides are known by carried sums alone.
    ready: arities and changes are columns already, as with_changes() has them; written out in every rule they make code too long to compile."""

    electron_free_energy: float
    temperature: float = S.ROOM_TEMP
    packed: dict[str, bool] = field(default_factory=dict)
    totals: bool = False
    ready: bool = False

    r1 = property(lambda self: F.col("r1"))
    p1 = property(lambda self: F.col("p1"))
    nr = property(lambda self: F.col("nr__") if self.ready else 1 + (F.col("reactant_2") >= 0 if self.totals else F.col("r2").isNotNull()).cast("int"))
    np = property(lambda self: F.col("np__") if self.ready else 1 + (F.col("product_2") >= 0 if self.totals else F.col("p2").isNotNull()).cast("int"))

    def total(self, side: str, field: str) -> Column:
        if self.totals:
            return F.col(f"{side}_{field}")
        return F.col(f"{side}1.{field}") + F.coalesce(F.col(f"{side}2.{field}"), F.lit(0))

    def dq(self) -> Column:
        return F.col("dq__") if self.ready else self.total("p", "charge") - self.total("r", "charge")

    def dg(self, field: str) -> Column:
        return F.col(f"dg__{field}") if self.ready else self.total("p", field) - self.total("r", field) + self.dq() * F.lit(self.electron_free_energy)

    def any_metal(self, *sides: str) -> Column:
        return reduce(lambda a, b: a | b, (F.coalesce(F.col(f"{s}.is_metal"), F.lit(False)) for s in sides))

    def arity(self, reactants: int, products: int) -> Column:
        return (self.nr == reactants) & (self.np == products)

    def counts(self, s: str, field: str) -> Column:
        """The map of one side, both species added."""
        none = F.create_map().cast("map<string,int>")
        side = lambda n: F.coalesce(F.col(f"{s}{n}.{field}"), none)
        add = lambda _, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
        return F.map_zip_with(side(1), side(2), add)

    def count_change(self, field: str, leave_out: tuple[str, ...] = ()) -> Column:
        """Sum over the map's keys of how much their counts differ between the sides."""
        gap = F.map_zip_with(self.counts("r", field), self.counts("p", field), lambda _, a, b: F.abs(F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0))))
        if leave_out:
            gap = F.map_filter(gap, lambda k, _: ~k.isin(*leave_out))
        return F.aggregate(F.map_values(gap), F.lit(0), lambda a, b: a + b)

    def change_above(self, field: str, limit: int) -> Column:
        """count_change() over limit, by packed counts where these are exact, or else by them first: they never differ more than the maps."""
        exactly = lambda: self.count_change(field, LEFT_OUT[field]) > limit
        if field not in self.packed:
            return exactly()
        near = F.col(f"change__{field}") > limit
        return near if self.packed[field] else near | exactly()


def metal_metal(c: Context) -> Column:
    return c.arity(1, 1) & F.col("r1.is_metal") & F.col("p1.is_metal")


def redox(c: Context) -> Column:
    return c.dq() != 0


def not_one_to_one(c: Context) -> Column:
    return ~c.arity(1, 1)


def charge_change_above(limit: int = 1) -> Rule:
    return lambda c: F.abs(c.dq()) > limit


def other_skeleton(c: Context) -> Column:
    return F.col("r1.covalent_hash") != F.col("p1.covalent_hash")


def dg_above(threshold: float, field: str) -> Rule:
    if field not in ("free_energy", "solvation_free_energy"):
        raise ValueError(f"no free energy {field!r}")
    return lambda c: c.dg(field) > threshold


def star_change_above(limit: int) -> Rule:
    return lambda c: c.change_above("star_counts", limit)


def covalent_decomposable(c: Context) -> Column:
    sides = lambda s: F.array(F.col(f"{s}1.covalent_hash"), F.col(f"{s}2.covalent_hash"))
    return c.arity(2, 2) & F.arrays_overlap(sides("r"), sides("p"))


def concerted_metal(c: Context) -> Column:
    return c.arity(2, 2) & c.any_metal("r1", "r2", "p1", "p2")


def concerted_metal_one_product(c: Context) -> Column:
    h = F.col("p1.covalent_hash")
    return c.arity(2, 1) & c.any_metal("r1", "r2") & (h != F.col("r1.covalent_hash")) & (h != F.col("r2.covalent_hash"))


def concerted_metal_one_reactant(c: Context) -> Column:
    h = F.col("r1.covalent_hash")
    return c.arity(1, 2) & c.any_metal("p1", "p2") & (h != F.col("p1.covalent_hash")) & (h != F.col("p2.covalent_hash"))


def metal_coordination(c: Context) -> Column:
    return c.any_metal("r1", "r2", "p1", "p2")


def bond_change_above(limit: int = 2) -> Rule:
    return lambda c: c.change_above("bond_counts", limit)


def fragment_match(c: Context) -> Column:
    """The first pair of fragmentations with equal hashes: struct(r, p), null if there is none.

    Reactant fragmentations are the outer order, product ones the inner; sides of
    two species break one bond at most, and pairs that both open and close a ring
    are left out.
    """
    frag = "struct<n_frag:int,n_broken:int,hashes:array<string>>"

    def side(s: str) -> Column:
        first, second = F.col(f"{s}1.fragments"), F.col(f"{s}2.fragments")
        one = F.transform(first, lambda f: F.struct(f["n_frag"].alias("n_frag"), f["n_broken"].alias("n_broken"), F.array_sort(f["hashes"]).alias("hashes")))

        def with_second(f: Column) -> Column:
            fits = F.filter(second, lambda g: f["n_broken"] + g["n_broken"] <= 1)
            return F.transform(fits, lambda g: F.struct((f["n_frag"] + g["n_frag"]).alias("n_frag"), (f["n_broken"] + g["n_broken"]).alias("n_broken"), F.array_sort(F.concat(f["hashes"], g["hashes"])).alias("hashes")))

        two = F.flatten(F.transform(first, with_second))
        return F.coalesce(F.when(F.col(f"{s}2").isNull(), one).otherwise(two), F.array().cast(f"array<{frag}>"))

    both_two = c.arity(2, 2)

    def first_product(r: Column) -> Column:
        hits = F.filter(side("p"), lambda p: (p["hashes"] == r["hashes"]) & ~(both_two & (p["n_frag"] == 2) & (r["n_frag"] == 2)))
        return F.struct(r.alias("r"), F.get(hits, F.lit(0)).alias("p"))

    return F.get(F.filter(F.transform(side("r"), first_product), lambda m: m["p"].isNotNull()), F.lit(0))


def fragments_match(c: Context) -> Column:
    return F.col("match").isNotNull()


def _one_each() -> Column:
    return (F.col("match.r.n_broken") == 1) & (F.col("match.p.n_broken") == 1)


def not_atom_transfer(atoms: tuple[str, ...]) -> Rule:
    """atoms: the hashes of single atoms that may move."""
    return lambda c: c.arity(1, 1) & _one_each() & ~F.arrays_overlap(F.col("match.r.hashes"), F.array(*map(F.lit, atoms)))


def ring_close(c: Context) -> Column:
    return c.arity(1, 2) & _one_each() & (F.col("match.p.n_frag") == 2)


def _ring_break(one: str, two: str) -> Column:
    want = lambda: F.array_sort(F.array(F.col(f"{two}1.covalent_hash"), F.col(f"{two}2.covalent_hash")))
    return F.coalesce(F.exists(F.col(f"{one}1.ring_fragments"), lambda f: F.array_sort(F.array_distinct(f["hashes"])) == F.array_distinct(want())), F.lit(False))


def ring_break_two(c: Context) -> Column:
    return c.arity(1, 2) & _ring_break("r", "p")


def ring_form_two(c: Context) -> Column:
    return c.arity(2, 1) & _ring_break("p", "r")


def always(c: Context) -> Column:
    return F.lit(True)


def atom_hash(symbol: str) -> str:
    from fluxloom.functions.graphs import wl_hash

    return wl_hash([symbol], [])


def default_tree() -> list:
    return [
        ("metal_metal", metal_metal, DISCARD),
        ("redox", redox, [
            ("redox_arity", not_one_to_one, DISCARD),
            ("charge_change", charge_change_above(1), DISCARD),
            ("other_skeleton", other_skeleton, DISCARD),
            ("redox_dg", dg_above(0.0, "free_energy"), DISCARD),
            ("redox_kept", always, KEEP),
        ]),
        ("dg", dg_above(0.0, "solvation_free_energy"), DISCARD),
        ("star_change", star_change_above(6), DISCARD),
        ("covalent_decomposable", covalent_decomposable, DISCARD),
        ("concerted_metal", concerted_metal, DISCARD),
        ("concerted_metal_one_product", concerted_metal_one_product, DISCARD),
        ("concerted_metal_one_reactant", concerted_metal_one_reactant, DISCARD),
        ("metal_coordination", metal_coordination, KEEP),
        ("bond_change", bond_change_above(2), DISCARD),
        ("fragments_match", fragments_match, [
            ("not_atom_transfer", not_atom_transfer((atom_hash("H"), atom_hash("F"))), DISCARD),
            ("ring_close", ring_close, DISCARD),
            ("matched", always, KEEP),
        ]),
        ("no_match", always, DISCARD),
    ]


TREES: dict[str, Callable[[], list]] = {"default": default_tree}
#: Names of rules that read graph columns, and of those that read the match of fragments.
GRAPH_RULES, MATCH_RULES = {"star_change", "bond_change", "ring_break_two", "ring_form_two"}, {"fragments_match", "not_atom_transfer", "ring_close"}
#: Names of rules that read no more than the sides' totals and arity.
TOTAL_RULES = {"redox", "redox_arity", "charge_change", "redox_dg", "dg"}


def compiled(tree: list, c: Context, whole: bool = True) -> Column:
    """struct(verdict, rule) of each row, as one CASE whose branches are tried in order; undecided rows are null unless the tree is whole."""
    outcome = lambda verdict, name: F.struct(F.lit(verdict).alias("verdict"), F.lit(name).alias("rule"))
    case = None
    for name, rule, then in tree:
        value = outcome(then, name) if isinstance(then, str) else compiled(then, c)
        case = F.when(rule(c), value) if case is None else case.when(rule(c), value)
    if case is None:
        case = F.when(F.lit(False), outcome(DISCARD, "none"))
    return case.otherwise(outcome(DISCARD, "none")) if whole else case


def names(tree: list) -> set[str]:
    """Of all rules in a tree."""
    return {n for name, _, then in tree for n in ({name} if isinstance(then, str) else {name} | names(then))}


def kept_names(tree: list) -> set[str]:
    """Of the rules that keep."""
    return set().union(*(kept_names(then) if not isinstance(then, str) else {name} if then == KEEP else set() for name, _, then in tree))


def may_keep(tree: list, c: Context) -> Column:
    """False only of candidates that the tree discards, whatever its other rules say: a test over carried sums."""
    c, false = replace(c, totals=True), F.lit(False)

    def some(tree: list) -> Column:
        out, on = false, F.lit(True)  # on: a row may come as far as here
        for name, rule, then in tree:
            known = F.coalesce(rule(c), false) if name in TOTAL_RULES else None
            if then != DISCARD:
                inner = some(then) if not isinstance(then, str) else F.lit(True)
                out = out | (on & inner if known is None else on & known & inner)
            if known is not None:
                on = on & ~known
        return out

    return some(tree)


def phases(tree: list, graph_rules: set[str] = GRAPH_RULES) -> tuple[list, list, list]:
    """The tree cut before its first entry that reads graphs, and before its first that reads the match."""
    first = lambda kinds: next((i for i, entry in enumerate(tree) if names([entry]) & kinds), len(tree))
    match = first(MATCH_RULES)
    graph = min(first(graph_rules), match)
    return tree[:graph], tree[graph:match], tree[match:]


def discards_first(tree: list, graph_rules: set[str]) -> list:
    """A tree that keeps the same rows: discards that read no graph go before those that do, as long as no other outcome lies between."""
    n = next((i for i, (_, _, then) in enumerate(tree) if then != DISCARD and i >= len(phases(tree, graph_rules)[0])), len(tree))
    begin = len(phases(tree, graph_rules)[0])
    costly = lambda entry: bool(names([entry]) & (graph_rules | MATCH_RULES))
    return tree[:begin] + sorted(tree[begin:n], key=costly) + tree[n:]


def packed(species: DataFrame) -> tuple[DataFrame, dict[str, bool]]:
    """species with its maps of counts as WORDS words of LANES bytes each, and whether these hold the counts exactly.

    With more keys in the pool than bytes, keys that share a byte are added up.
    """
    exact = {}
    for name, out in LEFT_OUT.items():
        if name not in species.columns:
            continue
        entries = species.select(F.explode(name).alias("k", "n")).filter(~F.col("k").isin(*out) if out else F.lit(True))
        keys = [r.k for r in entries.select("k").distinct().orderBy("k").limit(WORDS * LANES + 1).collect()]  # two dozen at most
        if (entries.agg(F.max("n")).first()[0] or 0) > MOST:
            continue
        exact[name] = len(keys) <= WORDS * LANES
        of = (lambda i, name=name, keys=keys: F.try_element_at(name, F.lit(keys[i])) if i < len(keys) else F.lit(0)) if exact[name] else (
            lambda i, name=name, out=out: F.least(F.lit(MOST), F.aggregate(F.map_values(F.map_filter(name, lambda k, _: (F.pmod(F.hash(k), F.lit(WORDS * LANES)) == i) & ~k.isin("", *out))), F.lit(0), lambda a, x: a + x)))
        for word in range(WORDS):
            lanes = (F.shiftleft(F.coalesce(of(LANES * word + i), F.lit(0)).cast("long"), 8 * i) for i in range(LANES))
            species = species.withColumn(f"{name}_{word}", reduce(lambda a, b: a + b, lanes))
    return species, exact


def count_keys(species: DataFrame, name: str) -> list[str] | None:
    """The keys of a map of counts that count as a change; None if there are more than packed() has bytes."""
    keys = species.select(F.explode(F.map_keys(name)).alias("k")).filter(~F.col("k").isin(*LEFT_OUT[name]) if LEFT_OUT[name] else F.lit(True)).distinct().orderBy("k").limit(WORDS * LANES + 1).collect()
    return [r.k for r in keys] if len(keys) <= WORDS * LANES else None


def summed(species: DataFrame) -> DataFrame:
    """species with whole, once, more: for the fragmentations that break no bond, one, or more, the sum of the hashes of what is left.

    Equal fragments give equal sums, and the sums of two species add up.
    """
    total = lambda f: F.aggregate(f["hashes"], F.lit(0).cast("long"), lambda a, h: a + F.shiftright(F.xxhash64(h), 8))
    of = lambda test: F.transform(F.filter("fragments", test), total)
    return species.withColumns(dict(zip(SUMS, (of(lambda f: f["n_broken"] == 0), of(lambda f: f["n_broken"] == 1), of(lambda f: f["n_broken"] > 1)), strict=True)))


def sums_meet() -> Column:
    """False only if no fragmentations of the two sides can be equal."""
    def side(s: str) -> Column:
        one, two = ({k: F.col(f"{s}{i}.{k}") for k in SUMS} for i in (1, 2))
        both = lambda x, y: F.flatten(F.transform(x, lambda a: F.transform(y, lambda b: a + b)))
        pairs = F.concat(both(one["whole"], two["whole"]), both(one["once"], two["whole"]), both(one["whole"], two["once"]))
        return F.when(F.col(f"{s}2").isNull(), F.concat(*one.values())).otherwise(pairs)

    return F.coalesce(F.arrays_overlap(side("r"), side("p")), F.lit(False))


def match_decides(tree: list) -> bool:
    """Whether two reactants give two products only by a match of fragments, and with no covalent graph on both sides, as the default tree has it."""
    discards: set[str] = set()
    matched = False
    for name, _, then in tree:
        if then == DISCARD:
            discards.add(name)
        elif name == "fragments_match" and {"covalent_decomposable", "concerted_metal"} <= discards:
            matched = True
        elif name == "redox" and not isinstance(then, str) and then and (then[0][0], then[0][2]) == ("redox_arity", DISCARD):
            continue
        elif name != "metal_coordination" or "concerted_metal" not in discards:
            return False
    return matched


def matching_gists(known: DataFrame, first: DataFrame) -> DataFrame:
    """r_low, r_high, p_low, p_high: pairs of gists between which match_decides() may keep.

    known: ind, covalent_hash, is_metal and SUMS of each gist; first: those of
    which one is among the reactants.  Pairs meet by a sum of hashes that both
    have, so those that can't match are not compared.
    """
    def side(pairs: DataFrame, s: str) -> DataFrame:
        both = lambda x, y: F.flatten(F.transform(x, lambda u: F.transform(y, lambda v: u + v)))
        sums = F.array_distinct(F.concat(both(F.col("a_whole"), F.col("b_whole")), both(F.col("a_once"), F.col("b_whole")), both(F.col("a_whole"), F.col("b_once"))))
        free = ~(F.coalesce("a_is_metal", F.lit(False)) | F.coalesce("b_is_metal", F.lit(False)))
        low, high = F.least("a_ind", "b_ind").alias(f"{s}_low"), F.greatest("a_ind", "b_ind").alias(f"{s}_high")
        return pairs.filter(free).select(low, high, F.array("a_covalent_hash", "b_covalent_hash").alias(f"{s}_hashes"), F.explode(sums).alias("sum"))

    met = side(bucketing.pairs(first, known), "r").join(side(bucketing.pairs(known, known, unordered=True), "p"), "sum")
    apart = ~F.coalesce(F.arrays_overlap("r_hashes", "p_hashes"), F.lit(False))
    return met.filter(apart).select("r_low", "r_high", "p_low", "p_high").distinct()


def kept_candidates(species: DataFrame, core: DataFrame, keys: list[str], tree: list, c: Context, parts: int = 0) -> DataFrame:
    """Those of candidates() around a core that the tree may keep, by ids.

    Rules over totals decide in the join.  Where match_decides(), pairs are held
    against pairs by their gists first, so only those between gists that may match
    are made; there are far fewer gists than species.  The rest has a single
    species on one side, and grows with a power less.
    """
    s = species.select("ind", *keys, *CARRIED)
    made = lambda found, index, on=keys: candidates(found, index, on, CARRIED, parts=parts).filter(may_keep(tree, c)).select(*KEYS)
    if not (match_decides(tree) and unique_ids(species)):
        found = bucketing.complexes(s, core, [*keys, *CARRIED])
        return made(found, product_index(s, keys, found, carried=CARRIED))
    single = s.join(core.select("ind").distinct(), "ind", "left_semi").select(F.col("ind").alias("s1"), F.lit(S.NONE).alias("s2"), *keys, *CARRIED)
    double = bucketing.complexes(s, core, [*keys, *CARRIED], unary=False)
    alone = s.select(F.col("ind").alias("p1"), F.lit(S.NONE).alias("p2"), *keys, *CARRIED)
    out = made(single, product_index(s, keys, single, carried=CARRIED)).unionByName(made(double, alone))
    gist = ["covalent_hash", "is_metal", *SUMS]
    held = summed(species).select("ind", *gist)
    numbers = ordering.numbered(held.select(F.to_json(F.struct(*gist)).alias("all"), *gist).dropDuplicates(["all"]), ["all"], "gist")
    of = shared.written(held.withColumn("all", F.to_json(F.struct(*gist))).select("ind", "all").join(numbers.select("all", "gist"), "all").select("ind", "gist"), "gists")
    known = numbers.select(F.col("gist").alias("ind"), *gist)
    first = known.join(of.join(core.select("ind").distinct(), "ind", "left_semi").select(F.col("gist").alias("ind")).distinct(), "ind", "left_semi")
    matching = shared.written(matching_gists(known, first), "gists")
    if matching.isEmpty():
        return out

    def numbered(sides: DataFrame, one: str, two: str, s: str) -> DataFrame:
        a, b = of.toDF(one, "a__"), of.toDF(two, "b__")
        pairs = matching.select(f"{s}_low", f"{s}_high").distinct()
        return sides.join(a, one).join(b, two).select(*sides.columns, F.least("a__", "b__").alias(f"{s}_low"), F.greatest("a__", "b__").alias(f"{s}_high")).join(pairs, [f"{s}_low", f"{s}_high"], "left_semi")

    right = numbered(product_index(s, keys, double, carried=CARRIED).filter(F.col("p2") != S.NONE), "p1", "p2", "p")
    left = numbered(double, "s1", "s2", "r").join(matching, ["r_low", "r_high"])
    return out.unionByName(made(left, right, [*keys, "p_low", "p_high"]))


def _with_energies(d: DataFrame, c: Context) -> DataFrame:
    """dq, dG, dG_barrier and rate."""
    d = d.withColumn("dq", c.dq())
    d = d.withColumn("dG", F.when(F.col("dq") != 0, c.dg("free_energy")).otherwise(c.dg("solvation_free_energy")))
    barrier = F.when(F.col("dG") < 0, F.lit(0.0)).otherwise(F.col("dG"))
    return d.withColumn("dG_barrier", barrier).withColumn("rate", thermo.rate(F.col("dG_barrier"), c.temperature))


def judged(rows: DataFrame, c: Context, tree: list, fragments: bool = True) -> DataFrame:
    """attached() rows with verdict, rule, dq, dG, dG_barrier and rate."""
    d = rows
    if fragments:
        d = d.withColumn("match", fragment_match(c))
    return _with_energies(d.withColumn("decision", compiled(tree, c)), c).select("*", "decision.*").drop("decision")


def with_changes(d: DataFrame, c: Context) -> DataFrame:
    """Arities and changes of attached() rows as columns, each computed once."""
    d = d.withColumns({"nr__": c.nr, "np__": c.np, "dq__": c.dq()})
    return d.withColumns({f"dg__{f}": c.total("p", f) - c.total("r", f) + F.col("dq__") * F.lit(c.electron_free_energy) for f in ("free_energy", "solvation_free_energy")})


def with_words(d: DataFrame, exact: dict[str, bool]) -> DataFrame:
    """change__<map>: by how much the packed counts of attached() rows differ between the sides, all bytes of a word at once.

    Bytes hold 126 at most, so their top bits are free: set before a subtraction,
    they keep it from reaching into the next byte, and tell the sign after it.
    """
    words = [f"{m}_{i}" for m in exact for i in range(WORDS)]
    every = lambda byte: sum(byte << 8 * i for i in range(LANES))
    side = lambda s, x: F.coalesce(F.col(f"{s}1.{x}"), F.lit(0)) + F.coalesce(F.col(f"{s}2.{x}"), F.lit(0))
    d = d.withColumns({f"x__{x}": side("r", x).bitwiseOR(F.lit(every(128))) - side("p", x) for x in words})
    d = d.withColumns({f"n__{x}": F.shiftright(F.bitwise_not(f"x__{x}").bitwiseAND(F.lit(every(128))), 7) for x in words})
    d = d.withColumns({f"a__{x}": F.col(f"x__{x}").bitwiseAND(F.lit(every(127))).bitwiseXOR(F.col(f"n__{x}") * 127) + F.col(f"n__{x}") for x in words})
    low = F.lit(sum(255 << 16 * i for i in range(LANES // 2 + 1)))
    pairs = lambda x: F.col(f"a__{x}").bitwiseAND(low) + F.shiftright(f"a__{x}", 8).bitwiseAND(low)
    d = d.withColumns({f"s__{m}": reduce(lambda a, b: a + b, (pairs(f"{m}_{i}") for i in range(WORDS))) for m in exact})
    total = lambda m: reduce(lambda a, b: a + b, (F.shiftright(f"s__{m}", 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(LANES // 2 + 1)))
    return d.withColumns({f"change__{m}": total(m) for m in exact})


def judge(rows: DataFrame, species: DataFrame, c: Context, tree: list, keep_only: bool = False) -> DataFrame:
    """Candidates by ids (KEYS) with verdict, rule, dq, dG, dG_barrier and rate; with keep_only those that are kept."""
    if keep_only:
        tree = discards_first(tree, GRAPH_RULES)
    cheap, graph, match = phases(tree)
    narrow = [x for x in NARROW if x in species.columns]
    open_, done = F.col("decision").isNull(), F.col("decision").isNotNull()

    def decide(d: DataFrame, part: list, c: Context, last: bool) -> DataFrame:
        ready = replace(c, ready=True)
        dg = F.when(ready.dq() != 0, ready.dg("free_energy")).otherwise(ready.dg("solvation_free_energy"))
        d = with_changes(d, c).select(*KEYS, compiled(part, ready, last).alias("decision"), ready.dq().alias("dq"), dg.alias("dG"))
        if last:
            return d
        # Written before it is filtered: a filter would evaluate the whole tree once more.
        d = shared.written(d, "judged")
        return d.filter(open_ | (F.col("decision.verdict") == KEEP)) if keep_only else d

    d = decide(attached(rows.select(*KEYS), species, narrow), cheap, c, not graph + match)
    out = [d.filter(done)] if graph + match else [d]
    if graph:
        held, exact = packed(species)
        columns = [f"{m}_{i}" for m in exact for i in range(WORDS)] + [m for m in GRAPH if m in species.columns and not exact.get(m)]
        d = attached(d.filter(open_).select(*KEYS), held, narrow + columns)
        d = decide(with_words(d, exact), graph, replace(c, packed=exact), not match)
        out.append(d.filter(done) if match else d)
    if match:
        d = attached(d.filter(open_).select(*KEYS), summed(species), SUMS).select(*KEYS, sums_meet().alias("meet__"))
        d = shared.written(d, "judged")
        more = [m for m in (*GRAPH, "fragments") if m in species.columns]
        far = attached(d.filter("NOT meet__").select(*KEYS), species, narrow + [m for m in more if m != "fragments" and names(match) & GRAPH_RULES])
        near = attached(d.filter("meet__").select(*KEYS), species, narrow + more)
        none = F.struct(*(F.struct(F.lit(0).alias("n_frag"), F.lit(0).alias("n_broken"), F.array().cast("array<string>").alias("hashes")).alias(x) for x in "rp"))
        out.append(decide(far.withColumn("match", F.when(F.lit(False), none)), match, c, True))
        out.append(decide(near.withColumn("match", fragment_match(c)), match, c, True))
    d = reduce(DataFrame.unionByName, out)
    if keep_only:
        d = d.filter(F.col("decision.verdict") == KEEP)
    barrier = F.when(F.col("dG") < 0, F.lit(0.0)).otherwise(F.col("dG"))
    return d.withColumn("dG_barrier", barrier).withColumn("rate", thermo.rate(F.col("dG_barrier"), c.temperature)).select(*KEYS, "decision.*", "dq", "dG", "dG_barrier", "rate")


def bond_delta_within(c: Context, limit: int = 3) -> Column:
    """The cheap test before the mapper; rows without bond counts pass."""
    return F.coalesce(~c.change_above("bond_counts", limit), F.lit(True))

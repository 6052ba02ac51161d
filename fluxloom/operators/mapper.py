"""Atom mapping: is a reaction one elementary step?

The best element-preserving mapping of reactant atoms to product atoms is found
by branch and bound over bond graphs.  Mappings are ranked by total change of
bond orders, then by bonds broken and formed, then elementary ones first, then
broken, formed, and changed orders.  Verdicts are kept in a table by reaction
key; each distinct reaction that the table lacks is mapped once.
"""

from __future__ import annotations

import math
import random
import time
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxloom import schema as S
from fluxloom.functions import text
from fluxloom.operators import rules
from fluxloom.operators.enumeration import KEYS
from fluxloom.session import ship

Pair = tuple[int, int]
STORED = ("allowed", "rejected", "no_mapping")
_COORDINATE = {frozenset(p.split("-")) for p in S.COORDINATE_PAIRS}


@dataclass(frozen=True)
class Side:
    """Atoms of one side of a reaction and bond orders between them."""

    symbols: tuple[str, ...]
    orders: dict[Pair, int]

    @classmethod
    def of(cls, molecules: list[tuple[list[str], list[tuple[int, int, int]]]]) -> Side:
        symbols: list[str] = []
        orders: dict[Pair, int] = {}
        for labels, bonds in molecules:
            at = len(symbols)
            symbols += labels
            for u, v, n in bonds:
                if frozenset((labels[u], labels[v])) not in _COORDINATE and n > 0:
                    pair = (at + min(u, v), at + max(u, v))
                    orders[pair] = orders.get(pair, 0) + n
        return cls(tuple(symbols), orders)


@dataclass(frozen=True)
class Edits:
    broken: list[Pair] = field(default_factory=list)
    formed: list[Pair] = field(default_factory=list)
    changed: list[tuple[Pair, int, int]] = field(default_factory=list)

    @property
    def elementary(self) -> bool:
        """At most one bond broken and one formed, and these share an atom."""
        b, f = len(self.broken), len(self.formed)
        return b + f <= 1 or (b == f == 1 and bool(set(self.broken[0]) & set(self.formed[0])))

    def rank(self, units: int) -> tuple:
        b, f = len(self.broken), len(self.formed)
        return units, b + f, not self.elementary, b, f, len(self.changed)


def edits(r: Side, p: Side, to: list[int]) -> Edits:
    """Bonds lost, made and changed when reactant atom i becomes product atom to[i]; a bond counts by its order."""
    back = {j: i for i, j in enumerate(to)}
    now = {tuple(sorted((back[a], back[b]))): n for (a, b), n in p.orders.items()}
    e = Edits()
    for pair in sorted({*r.orders, *now}):
        before, after = r.orders.get(pair, 0), now.get(pair, 0)
        if not after:
            e.broken.extend([pair] * before)
        elif not before:
            e.formed.extend([pair] * after)
        elif before != after:
            e.changed.append((pair, before, after))
    return e


class Search:
    """Best mapping of r to p, or a timeout."""

    def __init__(self, r: Side, p: Side, deadline: float):
        self.r, self.p, self.deadline = r, p, deadline
        self.near_r, self.near_p = self._near(r), self._near(p)
        self.best: tuple[tuple, list[int], Edits] | None = None
        self.nodes = 0
        n = len(r.symbols)
        self.to, self.used = [-1] * n, [False] * n
        self.order = self._ordered()
        self.twins = self._twins()
        # Bond orders by pair of elements that are not decided yet: their difference is a bound.
        self.left: Counter = Counter()
        for side, sign in ((r, 1), (p, -1)):
            for (a, b), k in side.orders.items():
                self.left[self._kind(side, a, b)] += sign * k

    @staticmethod
    def _near(s: Side) -> list[dict[int, int]]:
        out: list[dict[int, int]] = [{} for _ in s.symbols]
        for (a, b), n in s.orders.items():
            out[a][b] = out[b][a] = n
        return out

    @staticmethod
    def _kind(s: Side, a: int, b: int) -> str:
        return "-".join(sorted((s.symbols[a], s.symbols[b])))

    def _ordered(self) -> list[int]:
        """Rare elements first, then along bonds, hydrogens last."""
        scarce, seen, out = Counter(self.r.symbols), set(), []
        heavy = sorted((i for i, s in enumerate(self.r.symbols) if s != "H"), key=lambda i: (scarce[self.r.symbols[i]], -len(self.near_r[i]), i))
        for start in heavy:
            todo = [start]
            while todo:
                i = todo.pop(0)
                if i in seen or self.r.symbols[i] == "H":
                    continue
                seen.add(i)
                out.append(i)
                todo += sorted(self.near_r[i])
        return out + [i for i, s in enumerate(self.r.symbols) if s == "H"]

    def _twins(self) -> list[int]:
        """The first product atom that is the same in element and bonds, for each."""
        first: dict[tuple, int] = {}
        return [first.setdefault((s, tuple(sorted(self.near_p[j].items()))), j) for j, s in enumerate(self.p.symbols)]

    def run(self) -> None:
        self._place(0, 0)

    def _place(self, k: int, units: int) -> None:
        self.nodes += 1
        if self.nodes % 512 == 0 and time.monotonic() > self.deadline:
            raise TimeoutError
        if self.best and units + sum(map(abs, self.left.values())) > self.best[0][0]:
            return
        if k == len(self.order):
            e = edits(self.r, self.p, self.to)
            rank = e.rank(units)
            if self.best is None or rank < self.best[0]:
                self.best = rank, list(self.to), e
            return
        if self.best and self.best[0][:3] == (units, 0, False):
            return
        i = self.order[k]
        choices, tried = [], set()
        for j, s in enumerate(self.p.symbols):
            if self.used[j] or s != self.r.symbols[i] or self.twins[j] in tried:
                continue
            tried.add(self.twins[j])
            choices.append((*self._cost(i, j), j))
        for cost, settled, j in sorted(choices, key=lambda c: (c[0], -len(c[1]), c[2])):
            self.to[i], self.used[j] = j, True
            self.left.subtract(settled)
            self._place(k + 1, units + cost)
            self.left.update(settled)
            self.to[i], self.used[j] = -1, False

    def _cost(self, i: int, j: int) -> tuple[int, Counter]:
        """Change of orders to atoms that are placed already, and the bond orders that this settles."""
        cost, settled, seen = 0, Counter(), set()
        for x, n in self.near_r[i].items():
            if (y := self.to[x]) >= 0:
                m = self.near_p[j].get(y, 0)
                cost += abs(n - m)
                settled[self._kind(self.r, i, x)] += n - m
                seen.add(y)
        for y, m in self.near_p[j].items():
            if self.used[y] and y not in seen:
                cost += m
                settled[self._kind(self.p, j, y)] -= m
        return cost, settled


def annealed(r: Side, p: Side, deadline: float, seed: int = 0) -> tuple[list[int], Edits] | None:
    """A mapping by swaps of equal elements at falling temperatures; the first elementary one, else None."""
    rng = random.Random(seed)
    groups = [g for e in sorted(set(r.symbols)) if len(g := [i for i, s in enumerate(r.symbols) if s == e]) > 1]
    places = {e: [j for j, s in enumerate(p.symbols) if s == e] for e in set(p.symbols)}
    units = lambda e: len(e.broken) + len(e.formed) + sum(abs(a - b) for _, a, b in e.changed)
    while time.monotonic() < deadline:
        left = {e: rng.sample(js, len(js)) for e, js in places.items()}
        to = [left[s].pop() for s in r.symbols]
        now = edits(r, p, to)
        heat = 2.0
        while heat > 0.05 and time.monotonic() < deadline:
            if now.elementary:
                return to, now
            if not groups:
                return None
            i, j = rng.sample(rng.choice(groups), 2)
            to[i], to[j] = to[j], to[i]
            new = edits(r, p, to)
            rise = units(new) - units(now)
            if rise <= 0 or rng.random() < math.exp(-rise / heat):
                now = new
            else:
                to[i], to[j] = to[j], to[i]
            heat *= 0.999
    return None


def mapped(reactants: list, products: list, budget_s: float) -> tuple[bool | None, str, list[int], Edits]:
    """allowed (None: no verdict), status, mapping and edits."""
    r, p = Side.of(reactants), Side.of(products)
    if Counter(r.symbols) != Counter(p.symbols):
        return None, "no_mapping", [], Edits()
    s = Search(r, p, time.monotonic() + budget_s)
    try:
        s.run()
    except TimeoutError:
        # An elementary mapping is one, however it is found; without one there is no verdict.
        found = annealed(r, p, time.monotonic() + budget_s / 4)
        return (True, "mapped", *found) if found else (None, "timeout", [], Edits())
    _, to, e = s.best
    return e.elementary, "mapped", to, e


def tagged(i: int, symbols: tuple[str, ...]) -> str:
    return f"{i + 1}({symbols[i]})"


def written_bonds(pairs: list[Pair], symbols: tuple[str, ...]) -> str:
    return ";".join(f"{tagged(a, symbols)}-{tagged(b, symbols)}" for a, b in sorted(pairs))


def written_changes(changes: list[tuple[Pair, int, int]], symbols: tuple[str, ...]) -> str:
    return ";".join(f"{tagged(a, symbols)}-{tagged(b, symbols)}:{n}->{m}" for (a, b), n, m in sorted(changes))


def written_mapping(to: list[int], r: Side, p: Side) -> str:
    return ";".join(f"{tagged(i, r.symbols)}->{tagged(j, p.symbols)}" for i, j in enumerate(to))


RESULT = (
    "rxn_key string, allowed int, status string, elapsed double, atom_mapping string, n_bonds_broken int, n_bonds_formed int, "
    "bonds_broken string, bonds_formed string, n_bond_order_changes int, bond_order_changes string"
)


def map_reactions(rows: DataFrame, budget_s: float) -> DataFrame:
    """rxn_key, reactants, products (arrays of struct(symbols, bonds)) -> RESULT; errors of a row are its status."""

    ship(rows.sparkSession)

    def plain(molecules) -> list:
        return [(list(m["symbols"]), [(int(b["u"]), int(b["v"]), int(b["ord"])) for b in m["bonds"]]) for m in molecules]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for x in b.itertuples(index=False):
                began = time.monotonic()
                try:
                    rs, ps = plain(x.reactants), plain(x.products)
                    ok, status, to, e = mapped(rs, ps, budget_s)
                    r, p = Side.of(rs), Side.of(ps)
                    text_ = (written_mapping(to, r, p), len(e.broken), len(e.formed), written_bonds(e.broken, r.symbols), written_bonds(e.formed, r.symbols), len(e.changed), written_changes(e.changed, r.symbols))
                except (ValueError, KeyError, IndexError, RecursionError, MemoryError):
                    ok, status, text_ = None, "error", ("", 0, 0, "", "", 0, "")
                if status == "mapped":
                    status = "allowed" if ok else "rejected"
                out.append((x.rxn_key, None if ok is None else int(ok), status, time.monotonic() - began, *text_))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])

    return rows.select("rxn_key", "reactants", "products").mapInPandas(run, RESULT)


def reaction_keys(rows: DataFrame) -> DataFrame:
    """attached() rows with rxn_key from the species' own keys (graph and charge), sides unordered."""
    one = lambda s: F.when(F.col(s).isNotNull(), F.concat(F.col(f"{s}.full_hash"), F.lit("_"), F.col(f"{s}.charge").cast("string")))
    return rows.withColumn("rxn_key", text.reaction_key(F.array(one("r1"), one("r2")), F.array(one("p1"), one("p2"))))


def current(cache: DataFrame, version: str = S.MAPPER_VERSION) -> DataFrame:
    """The verdicts of this version; others are void."""
    return cache.filter(F.col("mapper_version") == version)


def merged(dst: DataFrame, src: DataFrame, version: str = S.MAPPER_VERSION) -> DataFrame:
    """Verdicts of both; src's come first, whatever their time."""
    both = dst.withColumn("first_", F.lit(1)).unionByName(src.filter(F.col("mapper_version") == version).withColumn("first_", F.lit(0)))
    order = Window.partitionBy("rxn_key").orderBy("first_", F.desc("ts"))
    return both.withColumn("n_", F.row_number().over(order)).filter("n_ = 1").drop("n_", "first_")


def mapper_stage(
    rows: DataFrame, c: rules.Context, cache: DataFrame | None = None, budget_s: float = 120.0, max_bond_delta: int | None = 3
) -> tuple[DataFrame, DataFrame]:
    """attached() rows that pass the bond-count test, with rxn_key; and the verdicts that the cache lacks.

    verdicts() applies these: only a verdict rejects, while no mapping, a timeout
    and an error follow the caller's choice.
    """
    d = reaction_keys(rows if max_bond_delta is None else rows.filter(rules.bond_delta_within(c, max_bond_delta)))
    known = None if cache is None else current(cache).select("rxn_key", "allowed", "status")
    molecule = lambda s: F.when(F.col(s).isNotNull(), F.struct(F.transform(F.col(f"{s}.atoms"), lambda a: a["symbol"]).alias("symbols"), F.col(f"{s}.bonds").alias("bonds")))
    there = lambda *s: F.filter(F.array(*map(molecule, s)), lambda m: m.isNotNull())
    todo = d if known is None else d.join(known, "rxn_key", "left_anti")
    todo = todo.groupBy("rxn_key").agg(F.min_by(F.struct(there("r1", "r2").alias("reactants"), there("p1", "p2").alias("products")), F.struct(*KEYS)).alias("m"))
    todo = todo.select("rxn_key", "m.*").repartition("rxn_key")  # mapping costs far more than moving
    new = map_reactions(todo, budget_s)
    new = new.withColumn("ts", F.unix_timestamp().cast("double")).withColumn("mapper_version", F.lit(S.MAPPER_VERSION))
    return d, new


def verdicts(d: DataFrame, known: DataFrame, keep_without_verdict: bool = True) -> DataFrame:
    """mapper_stage() rows with their verdict applied; known: rxn_key, allowed, status of old and new ones."""
    v = known.select("rxn_key", F.col("allowed").alias("verdict_"), F.col("status").alias("status_"))
    has = F.col("status_").isin("allowed", "rejected")
    keep = F.when(has, F.col("verdict_") == 1).otherwise(F.lit(keep_without_verdict))
    return d.join(v, "rxn_key", "left").filter(keep).drop("verdict_", "status_")


def storable(new: DataFrame) -> DataFrame:
    """New verdicts in the cache's columns; passing statuses are not kept."""
    names = [c.split()[0] for c in S.VERDICTS.split(", ")]
    return new.filter(F.col("status").isin(*STORED)).withColumn("allowed", F.coalesce("allowed", F.lit(0))).select(*names)


def by_hand(reactants: list, products: list, budget_s: float = 10.0) -> dict:
    """One reaction's verdict as a record, for tests and the command line."""
    ok, status, to, e = mapped(reactants, products, budget_s)
    return {"allowed": ok, "status": status, "mapping": to, "broken": e.broken, "formed": e.formed, "changed": e.changed}


"""Plans that grow with their input: what a task holds, and what goes through the driver."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fluxloom.operators import bucketing, enumeration

E = ["n_c", "n_h"]


def species(spark, n):
    return spark.range(n).selectExpr("CAST(id AS INT) AS ind", "CAST(id % 3 AS INT) AS n_c", "CAST(id % 2 AS INT) AS n_h")


def test_pairs_are_dealt_to_all_tasks(spark):
    d = species(spark, 60)
    core = d.filter("ind % 4 = 0").select("ind")
    for rows in (bucketing.complexes(d, core, E), enumeration.product_index(d, E)):
        per_task = Counter(r.at for r in rows.select(F.spark_partition_id().alias("at")).collect())
        assert len(per_task) >= bucketing.tasks_of(spark) // 2
    index = {tuple(r) for r in enumeration.product_index(d, E).select("p1", "p2").collect()}
    assert index == {(i, j) for i in range(60) for j in range(i, 60)} | {(i, -1) for i in range(60)}


def test_rows_of_species_with_one_id_pair_as_often_as_in_sql(spark):
    d = species(spark, 3).unionByName(species(spark, 1))
    index = Counter(tuple(r) for r in enumeration.product_index(d, E).select("p1", "p2").collect())
    assert index == {(0, -1): 2, (1, -1): 1, (2, -1): 1, (0, 0): 4, (0, 1): 2, (0, 2): 2, (1, 1): 1, (1, 2): 1, (2, 2): 1}


@pytest.mark.parametrize("chunks", [1, 7, 256])
def test_groups_of_a_popular_composition_are_numbered_in_ranges(spark, chunks):
    rows = spark.range(500).selectExpr("CAST(id * 37 % 500 AS INT) AS s1", "CAST(CASE WHEN id % 2 = 0 THEN -1 ELSE id + 500 END AS INT) AS s2", "CAST(0 AS INT) AS n_c", "CAST(id % 10 = 0 AS INT) AS n_h")
    grouped = bucketing.grouped(rows, E, 3, chunks)
    want = {}
    for h in (0, 1):
        for k, r in enumerate(sorted((r.s1, r.s2) for r in rows.filter(f"n_h = {h}").collect())):
            want[r] = (h, k // 3)
    assert {(r.s1, r.s2): (r.composition_id, r.group_id) for r in grouped.collect()} == want
    number = grouped._jdf.queryExecution().analyzed().toString()
    assert "row_number() windowspecdefinition(n_c" in number and number.split("row_number() windowspecdefinition(")[1].split("s1")[0].count("chunk") == 1
    assert bucketing.grouped(rows.limit(0), E).count() == 0


@pytest.mark.parametrize("n", [0, 1, 30])
def test_candidates_are_counted_by_composition(spark, n, monkeypatch):
    d, core = species(spark, n), species(spark, n).filter("ind % 4 = 1").select("ind")
    c = bucketing.complexes(d, core, E)
    rows = enumeration.candidates(c, enumeration.product_index(d, E), E).collect()
    monkeypatch.setattr(enumeration, "candidates", None)  # none are made
    got = enumeration.candidate_totals(d, core, E).first()
    assert (got.n, got.checksum) == (len(rows), sum(map(sum, rows)) if rows else None)
    assert enumeration.unique_ids(d) and not enumeration.unique_ids(species(spark, 3).unionByName(species(spark, 1)))
    big = spark.sql("SELECT CAST('36893488147419103237' AS DECIMAL(38,0)) AS x, CAST('9223372036854775808' AS DECIMAL(38,0)) AS y")
    assert tuple(big.select(enumeration.wrapped(F.col("x")), enumeration.wrapped(F.col("y"))).first()) == (5, -(1 << 63))


def test_a_tally_is_exported_without_the_driver(spark, tmp_path, monkeypatch):
    from fluxloom.sources import writers

    monkeypatch.setattr(writers, "record", None)
    tally = spark.createDataFrame([(1, 7), (2, 5)], "reaction_id long, firings long")
    net = spark.createDataFrame([(1, 0, -1, 1, 2), (2, 1, 2, 0, -1), (3, 0, -1, 2, -1)], "reaction_id long, reactant_1 int, reactant_2 int, product_1 int, product_2 int")
    names = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "ind int, entry_id string")
    writers.tally_rows(tally, net, names, str(tmp_path / "tally"))
    got = spark.read.json(str(tmp_path / "tally"))
    assert {(r.reaction_id, r.firings, tuple(r.reactants), tuple(r.products)) for r in got.collect()} == {(1, 7, ("a",), ("b", "c")), (2, 5, ("b", "c"), ("a",))}


def test_a_padded_series_joins_no_table_of_steps(spark):
    from fluxloom.operators import analysis

    series = spark.createDataFrame([(1, 2, 7, 5), (1, 4, 7, 6), (1, 9, 7, 1), (1, 12, 8, 3), (2, 0, 7, 4), (3, 1, 7, 9)], "seed long, step int, species_id int, count long")
    initial = spark.createDataFrame([(7, 50)], "species_id int, count int")
    padded = analysis.padded_series(series, initial, 6, spark.createDataFrame([(1,), (2,)], "seed long"))
    got = sorted(tuple(r) for r in padded.select("seed", "species_id", "step", "count").collect())
    want = [(1, 7, i, [50, 50, 5, 5, 6, 6][i]) for i in range(6)] + [(1, 8, i, 0) for i in range(6)] + [(2, 7, i, 4) for i in range(6)]
    assert got == want and "sequence(0, 5" not in padded._jdf.queryExecution().optimizedPlan().toString()


def test_seeds_are_looked_up_at_once(spark):
    from fluxloom.operators import species as pool

    d = spark.createDataFrame([(0, "a", "C 1 O1", 0, -1.0), (1, "b", "C1O1", 0, -2.0), (2, "b", "C1O1", 0, -2.0), (3, "c", "C1O1", 1, -9.0)], "ind int, entry_id string, formula string, charge int, solvation_free_energy double")
    wanted = spark.createDataFrame([("C1 O1", 0, "b"), ("C9", 0, "z")], "formula string, charge int, entry_id string")
    assert {tuple(r) for r in pool.lowest_energies(d, wanted).collect()} == {(f, c, pool.lowest_energy(d, f, c)) for f, c in (("C1 O1", 0), ("C9", 0))} == {("C1 O1", 0, 1), ("C9", 0, None)}
    assert {(r.entry_id, r.by_entry) for r in pool.by_entry_ids(d, wanted).collect()} == {("b", 1), ("z", None)}


def test_equal_graphs_are_tested_once(spark, monkeypatch):
    from fluxloom.operators import species as pool

    kind = "entry_id string, charge int, formula string, covalent_hash string, penalty int, solvation_free_energy double, atoms array<struct<symbol:string,x:double>>, bonds array<struct<u:int,v:int,ord:int>>"
    rows = [(f"m{i:03}", 0, "C1O1", "h", 0, float(-i % 7), [("C", float(i)), ("O", 0.0)] if i % 2 else [("O", 0.0), ("C", float(i))], [(0, 1, 1)]) for i in range(100)]
    d = spark.createDataFrame(rows, kind)
    assert [(r.ind, r.entry_id) for r in pool.representatives(d).collect()] == [(0, "m000")]
    monkeypatch.setattr(pool.ordering, "numbered", lambda rows, *_, **__: rows.withColumn("ind", F.lit(0)))
    plan = pool.representatives(d)._jdf.queryExecution().analyzed().toString()
    assert re.search(r"FlatMapGroupsInPandas.*\n.*Project.*\n.*(Distinct|Deduplicate|Aggregate)", plan), plan


@pytest.mark.parametrize("parts", [0, 3])
def test_new_candidates_are_found_without_moving_them(spark, parts):
    d = species(spark, 12)
    c, index = bucketing.complexes(d, d.filter("ind < 3").select("ind"), E), enumeration.product_index(d, E)
    every = {tuple(r) for r in enumeration.candidates(c, index, E).collect()}
    held = sorted(every)[::5]
    net = spark.createDataFrame([(b, a, p, q) for a, b, p, q in held], ", ".join(f"{k} int" for k in enumeration.KEYS))
    net = net.select(*enumeration.canonical(net))
    for network in ({"network": net}, {"stored": [net.filter("k1 % 2 = 0"), net.filter("k1 % 2 <> 0")], "buckets": 3}):
        got = [tuple(r) for r in enumeration.fresh_candidates(c, index, E, parts=parts, **network).collect()]
        assert len(got) == len(set(got)) and set(got) == every - set(held)


def test_a_simulation_holds_its_network_as_arrays():
    import tracemalloc

    import numpy as np

    from fluxloom.operators import simulate

    n = 50_000
    places = np.random.default_rng(1).integers(0, 90, (n, 4)).astype(np.int32)
    tracemalloc.start()
    fired = list(simulate.trajectory(7, np.arange(n), places, np.ones(n), {i: 50 for i in range(10)}, 3, simulate.Factors()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(fired) == 3 and peak < 90 * n


def test_a_stream_keeps_few_states_for_a_seed(spark, tmp_path):
    from fluxloom.streaming import live, state

    net = spark.range(60).selectExpr("id AS reaction_id", "CAST(id AS INT) AS reactant_1", "-1 AS reactant_2", "CAST((id + 1) % 60 AS INT) AS product_1", "-1 AS product_2")
    initial = spark.createDataFrame([(0, 5)], "species_id int, count int")
    log, at = spark.range(360).selectExpr("id % 3 AS seed", "CAST(id DIV 3 AS INT) AS step", "id DIV 3 % 60 AS reaction_id"), str(tmp_path / "log")
    for part in ("step < 50 AND step <> 7", "step >= 50 AND step < 110", "step = 7", "step >= 110"):  # step 7 is late
        log.filter(part).coalesce(1).write.mode("append").parquet(at)
        q = live.append_batches(state.live_state(live.firing_stream(spark, at, schema=log.schema), net, initial), lambda rows: rows, str(tmp_path / "out"), str(tmp_path / "c"))
        state.append_series(live.firing_stream(spark, at, schema=log.schema), net, initial, str(tmp_path / "series"), str(tmp_path / "c2"))
    assert q.lastProgress.stateOperators[0].numRowsTotal == 3 * state.SHARES
    want, have = set(), {}
    for step in [*range(7), *range(8, 110), 7, *range(110, 120)]:
        for species, delta in ((step % 60, -1), ((step + 1) % 60, 1)):
            have[species] = have.get(species, 5 if species == 0 else 0) + delta
            late = step == 7 and species in (7, 8)
            want |= {(seed, step, species, have[species], late) for seed in range(3)}
    names = ["seed", "step", "species_id", "count", "late"]
    assert {tuple(r) for r in live.read_batches(spark, str(tmp_path / "out"), state.OUT).select(names).collect()} == want
    # A batch that is run again replaces its rows.
    state._append(log.filter("step >= 110"), 3, state._changes(net, initial), str(tmp_path / "series"))
    again = state.read_series(spark, str(tmp_path / "series")).select(names).collect()
    assert len(again) == len(want) and {tuple(r) for r in again} == want


def small_pool(spark, n):
    """Species without metal, of two graphs a composition, in fragments that may match across graphs."""
    d = spark.range(n).selectExpr("CAST(id AS INT) AS ind", "CAST(id % 3 AS INT) AS n_c", "CAST(id % 2 AS INT) AS n_h", "CAST(id % 5 = 1 AS INT) AS charge", "-id * 1.5D % 7 AS free_energy", "-id * 2.5D % 9 AS solvation_free_energy", "id % 11 = 4 AS is_metal", "concat('h', CAST(id % 7 AS STRING)) AS covalent_hash")
    whole = "named_struct('n_frag', 1, 'n_broken', 0, 'hashes', array(concat('w', CAST(n_c AS STRING))))"  # not the graph's own hash
    return d.selectExpr("*", f"array({whole}, named_struct('n_frag', 2, 'n_broken', 1, 'hashes', array('x', concat('y', CAST(ind % 2 AS STRING))))) AS fragments", "map('a', n_c) AS star_counts", "map('b', n_h) AS bond_counts", "CAST(array() AS array<struct<n_frag:int,n_broken:int,hashes:array<string>>>) AS ring_fragments")


@pytest.mark.parametrize("parts", [0, 3])
def test_what_may_be_kept_is_found_without_all_candidates(spark, parts, monkeypatch):
    from fluxloom.operators import rules

    d = small_pool(spark, 24)
    core, c, tree = d.filter("ind % 6 = 1").select("ind"), rules.Context(-1.4), rules.default_tree()
    found = bucketing.complexes(d, core, E)
    every = enumeration.candidates(found, enumeration.product_index(d, E), E)
    want = {tuple(r) for r in rules.judge(every, d, c, tree, keep_only=True).select(*enumeration.KEYS).collect()}
    rows = rules.kept_candidates(d, core, E, tree, c, parts)
    some = [tuple(r) for r in rows.collect()]
    got = {tuple(r) for r in rules.judge(rows, d, c, tree, keep_only=True).select(*enumeration.KEYS).collect()}
    assert got == want and len(some) == len(set(some)) < every.count() // 4
    assert {(b != -1, q != -1) for _, b, _, q in want} >= {(True, True), (True, False)}
    assert rules.match_decides(tree) and not rules.match_decides([*tree, ("more", rules.always, rules.KEEP)]) and not rules.match_decides(tree[:4] + tree[6:])
    double = d.unionByName(d.filter("ind = 3"))  # where ids repeat, all candidates are made
    monkeypatch.setattr(rules, "matching_gists", None)
    assert rules.kept_candidates(double, core, E, tree, c, parts).count() >= len(some)


@pytest.mark.parametrize("n", [0, 1, 25])
def test_candidates_are_numbered_without_sorting_them(spark, n, monkeypatch):
    d, core = species(spark, n), species(spark, n).filter("ind % 4 = 1 OR ind = 0").select("ind")
    rows = enumeration.candidates(bucketing.complexes(d, core, E), enumeration.product_index(d, E), E).collect()
    placed, sizes = enumeration.ordering.placed, []
    monkeypatch.setattr(enumeration.ordering, "placed", lambda rows, keys: sizes.append(rows.count()) or placed(rows, keys))
    got = sorted(tuple(r) for r in enumeration.numbered_candidates(d, core, E, 7, 3).select(*enumeration.KEYS, "reaction_id").collect())
    assert got == [(*r, i) for i, r in enumerate(sorted(tuple(r) for r in rows), 7)]
    assert max(sizes) == bucketing.complexes(d, core, E).count()


@pytest.mark.parametrize("name", ["bond_prefilter", "ring_rules"])
def test_species_are_looked_up_by_side(spark, sf_dir, name, monkeypatch):
    from fluxloom.plans import catalog

    monkeypatch.setattr(enumeration, "attached", None)  # no candidate looks its species up
    plan = catalog.queries()[name](spark, sf_dir)
    assert plan.filter("reactant_1 < 0").isEmpty()


def test_sides_carry_what_species_have(spark):
    d = species(spark, 9)
    c, index = bucketing.complexes(d, d.filter("ind < 3").select("ind"), E), enumeration.product_index(d, E)
    want = enumeration.attached(enumeration.candidates(c, index, E), d, ["ind", "n_c"])
    keep = lambda x: F.struct(x["ind"].alias("ind"), x["n_c"].alias("n_c"))
    got = enumeration.attached_candidates(c, index, E, d, lambda one, two: (keep(one), F.when(two.isNotNull(), keep(two))), 3)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) != []


def ringed_pool(spark, n):
    """small_pool() whose maps differ between sides, with fragmentations that close rings, and some equal ones broken otherwise."""
    ring = "named_struct('n_frag', 1, 'n_broken', 1, 'hashes', array('x', concat('w', CAST(n_c AS STRING))))"
    wide = "named_struct('n_frag', 3, 'n_broken', 1, 'hashes', array('x', 'w0', concat('w', CAST(n_c AS STRING))))"
    apart = "named_struct('n_frag', 2, 'n_broken', 1, 'hashes', array('x', concat('w', CAST(n_c AS STRING))))"
    d = small_pool(spark, n).withColumn("fragments", F.expr(f"concat(if(ind % 2 = 0, fragments, array({ring})), if(ind % 3 = 0, array({apart}), array({wide}, {ring})))"))
    return d.withColumns({"star_counts": F.expr("map('a', ind % 4 * 2)"), "bond_counts": F.expr("map('b', ind % 4 * 2, 'Li-O', ind)"), "charge": F.expr("CAST(ind % 9 = 1 AS INT)")})


@pytest.mark.parametrize("pool,n", [("small_pool", 0), ("small_pool", 24), ("ringed_pool", 26)])
def test_rules_are_counted_without_candidates(spark, pool, n, monkeypatch):
    from fluxloom.operators import rules, totals

    d = globals()[pool](spark, n)
    core, c, tree = d.filter("ind % 6 < 2").select("ind"), rules.Context(-1.4), rules.default_tree()
    every = enumeration.candidates(bucketing.complexes(d, core, E), enumeration.product_index(d, E), E)
    want = {r.rule: r.n for r in rules.judge(every, d, c, tree).groupBy("rule").agg(F.count("*").alias("n")).collect()}
    made, judge = [], rules.judge
    monkeypatch.setattr(rules, "judge", lambda rows, *more: made.append(rows.filter("reactant_2 >= 0 OR product_2 >= 0").isEmpty()) or judge(rows, *more))
    assert {r.rule: r.n for r in totals.rule_totals(d, core, E, c).collect()} == want and made == [True]
    assert n < 24 or want.keys() >= ({"star_change", "bond_change", "ring_close"} if pool == "ringed_pool" else {"other_skeleton", "matched"})
    # What a task holds at once makes no difference.
    monkeypatch.setattr(totals, "COLUMNS", 3)
    groups = [g for _, g in totals.by_composition(totals.marked(d, core, E), E).toPandas().groupby(E)]
    few, many = (sum((Counter(dict(totals.counted(g.reset_index(drop=True), batch=batch).itertuples(index=False))) for g in groups), Counter()) for batch in (1, 50))
    assert few == many and sum(few.values()) == every.filter("reactant_2 >= 0 OR product_2 >= 0").count()


@pytest.mark.parametrize("sizes", [{}, {"block": 2, "edge": 3, "part": 50}])
@pytest.mark.parametrize("pool,n", [("small_pool", 0), ("small_pool", 24), ("ringed_pool", 26)])
def test_verdicts_are_found_without_writing_candidates(spark, pool, n, sizes, monkeypatch):
    from fluxloom.operators import rules, totals

    d = globals()[pool](spark, n)
    core, c, tree = d.filter("ind % 6 < 2").select("ind"), rules.Context(-1.4), rules.default_tree()
    names = [*enumeration.KEYS, "rule", "verdict", "dq"]
    every = enumeration.candidates(bucketing.complexes(d, core, E), enumeration.product_index(d, E), E)
    want = sorted(tuple(r) for r in rules.judge(every, d, c, tree).select(*names).collect())
    written, seen = totals.shared.written, []
    monkeypatch.setattr(totals.shared, "written", lambda rows, what: seen.append((what, written(rows, what))) or seen[-1][1])
    rows = totals.verdicts(d, core, E, c, **sizes)
    assert rows.columns == names and sorted(tuple(r) for r in rows.collect()) == want
    assert n < 24 or {r[4] for r in want} >= ({"star_change", "bond_change", "ring_close"} if pool == "ringed_pool" else {"other_skeleton", "matched"})
    # Only candidates of a single species on both sides are written, and blocks of sides, also where these are dealt in parts.
    assert all(table.filter("reactant_2 >= 0 OR product_2 >= 0").isEmpty() for what, table in seen if what == "judged")
    (blocks,) = (table for what, table in seen if what == "sides")
    assert n == 0 or (blocks.agg(F.max("parts")).first()[0] > 1) == bool(sizes)


def test_rule_verdicts_writes_no_candidates(spark, tmp_path, monkeypatch):
    from fluxloom import shared
    from fluxloom.plans import catalog

    suppliers = spark.range(20).selectExpr("id * 8 AS s_suppkey", "CAST(if(id < 4, 3, 7) AS INT) AS s_nationkey", "id * 1.5D AS s_acctbal")
    suppliers.coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    written, seen = shared.written, []
    monkeypatch.setattr(shared, "written", lambda rows, what: seen.append(written(rows, what)) or seen[-1])
    n = catalog.queries()["rule_verdicts"](spark, str(tmp_path)).count()
    assert sum(table.count() for table in seen) < n // 10


def test_what_cant_be_counted_is_judged(spark):
    from fluxloom.operators import totals

    d = small_pool(spark, 6)
    assert totals.countable(d, E) and totals.countable(d.filter("ind < 0"), E)
    assert totals.countable(d.withColumns({"charge": F.expr("if(ind = 3, null, charge)"), "n_c": F.expr("if(ind = 3, null, n_c)")}), E)  # is in no candidate
    for odd in (d.unionByName(d), *(d.withColumn(x, F.expr(f"if(ind = 3, null, {x})")) for x in ("charge", "covalent_hash", "fragments")), d.withColumn("free_energy", F.expr("if(ind = 3, double('NaN'), free_energy)"))):
        assert not totals.countable(odd, E)


def test_complexes_are_moved_for_few_parts(spark, sf_dir, tmp_path, monkeypatch):
    from fluxloom.plans import catalog
    from fluxloom.sources import keyed

    suppliers = spark.range(300).selectExpr("id * 8 AS s_suppkey", "CAST(if(id < 9, 3, 7) AS INT) AS s_nationkey", "0.0D AS s_acctbal")  # of one composition
    suppliers.write.parquet(str(tmp_path / "supplier.parquet"))
    seen, dealt = [], keyed.to_parts
    monkeypatch.setattr(keyed, "to_parts", lambda rows, *more: seen.append((rows, dealt(rows, *more))) or seen[-1][1])
    assert catalog.queries()["keyed_candidates"](spark, str(tmp_path)).limit(5).count() == 5
    (rows, copies), = seen
    assert rows.count() < copies.count() < 8 * rows.count()  # 45,150 pairs in 6 parts


def test_pairs_move_blocks_and_not_copies_of_rows(spark, monkeypatch):
    d, moved = species(spark, 2000), []
    frame = type(d)
    deal = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, *a: moved.append(self.count()) or deal(self, *a))
    n = bucketing.pairs(d, d, 4, unordered=True).count()
    assert n == 2000 * 2001 // 2 and moved == [10, 10]  # of 8,000 and more copies before


@pytest.fixture
def moved(spark, monkeypatch):
    """Rows of all tables that are dealt by a key or written."""
    from fluxloom import shared

    seen, frame = [], type(spark.range(0))
    deal, written = frame.repartition, shared.written
    monkeypatch.setattr(frame, "repartition", lambda self, *a: seen.append(self.count()) or deal(self, *a))
    monkeypatch.setattr(shared, "written", lambda rows, what: seen.append(rows.count()) or written(rows, what))
    return seen


def suppliers(spark, path, n):
    """A table of n suppliers, a third of them in the core, in a few compositions."""
    d = spark.range(n).selectExpr("id AS s_suppkey", "CAST(if(id % 3 = 0, 3, 7 + id % 2) AS INT) AS s_nationkey", "id % 5 * 1.5D AS s_acctbal")
    d.coalesce(1).write.parquet(f"{path}/supplier.parquet")
    return str(path)


@pytest.mark.parametrize("edge,part", [(256, 1 << 26), (2, 50)])
def test_candidates_are_made_from_blocks_of_sides(spark, edge, part, monkeypatch):
    from fluxloom.operators import sides

    monkeypatch.setattr(sides, "EDGE", edge)
    monkeypatch.setattr(sides, "PART", part)
    d = species(spark, 25).withColumn("n_c", F.expr("if(ind = 7, null, n_c)"))  # 7 is in none
    core = d.filter("ind % 4 = 1 OR ind = 0").select("ind")
    want = sorted(tuple(r) for r in enumeration.candidates(bucketing.complexes(d, core, E), enumeration.product_index(d, E), E).collect())
    every = sides.blocks(d, core, E)
    assert sorted(tuple(r) for r in sides.candidates(every, every.filter("core"), E).collect()) == want != []


@pytest.mark.parametrize("name", ["candidates", "keyed_candidates"])
def test_candidates_move_no_sides(spark, tmp_path, name, moved):
    from fluxloom.plans import catalog

    rows = catalog.queries()[name](spark, suppliers(spark, tmp_path, 120))
    assert max(moved) < 120 * 121 // 2 // 2 < rows.count()  # 8 times the complexes and all products before


@pytest.mark.parametrize("name", ["bond_prefilter"])
def test_what_decides_over_blocks_moves_no_sides(spark, tmp_path, name, moved, monkeypatch):
    from fluxloom.operators import sides
    from fluxloom.plans import bridge, catalog

    path = suppliers(spark, tmp_path, 100)
    counts = lambda s: s.withColumns({"bond_counts": F.expr("map('C-H', ind % 4 * 2, 'C-O', ind % 3)"), "star_counts": F.expr("map('a', 1)")})
    monkeypatch.setattr(bridge, "with_maps", counts)
    got = sorted(tuple(r) for r in catalog.queries()[name](spark, path).collect())
    assert max(moved) < 100 * 101 // 2
    monkeypatch.setattr(sides, "blocks", None)
    monkeypatch.setattr(enumeration, "unique_ids", lambda _: False)
    n = catalog.candidates(spark, path).count()
    assert got == sorted(tuple(r) for r in catalog.queries()[name](spark, path).collect()) and 0 < len(got) < n


def test_new_candidates_are_found_in_blocks(spark, moved):
    from fluxloom.operators import sides

    d = species(spark, 30)
    core = d.filter("ind % 4 = 1").select("ind")
    every = {tuple(r) for r in enumeration.candidates(bucketing.complexes(d, core, E), enumeration.product_index(d, E), E).collect()}
    held = [*sorted(every)[::500], *sorted(r for r in every if r[1] < 0 and r[3] < 0)[:3]]
    net = spark.createDataFrame([(b, a, p, q) for a, b, p, q in held] + [(99, 1, 2, 3)], ", ".join(f"{k} int" for k in enumeration.KEYS))
    net = net.select(*enumeration.canonical(net))
    for network in ({"network": net}, {"stored": [net.filter("k1 % 2 = 0"), net.filter("k1 % 2 <> 0")], "buckets": 3}):
        moved.clear()
        got = [tuple(r) for r in sides.fresh(d, core, E, parts=3, **network).collect()]
        assert len(got) == len(set(got)) and set(got) == every - set(held) and max(moved) < len(every) // 10


def test_a_firing_copies_nothing_of_the_networks_size():
    import tracemalloc

    import numpy as np

    from fluxloom.operators import simulate

    n, none = 100_000, np.full(100_000, -1)
    places = np.stack([np.arange(n), none, np.arange(n) + 1, none], axis=1).astype(np.int32)
    fired = simulate.trajectory(7, np.arange(n), places, np.ones(n), {0: 1}, n, simulate.Factors())
    assert next(fired)[:2] == (0, 0)
    tracemalloc.start()
    steps = [next(fired)[:2] for _ in range(50)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert steps == [(i, i) for i in range(1, 51)] and peak < n  # 8 bytes a reaction for each look-up before


def test_candidates_are_numbered_without_moving_products(spark, moved, monkeypatch):
    monkeypatch.setattr(enumeration, "RANKED", 3)
    monkeypatch.setattr(enumeration, "RANKED_PART", 40)
    d = species(spark, 40)
    core = d.filter("ind % 13 = 1").select("ind")
    c = bucketing.complexes(d, core, E)
    rows = sorted(tuple(r) for r in enumeration.candidates(c, enumeration.product_index(d, E), E).collect())
    moved.clear()
    got = sorted(tuple(r) for r in enumeration.numbered_candidates(d, core, E, 5, 2).select(*enumeration.KEYS, "reaction_id").collect())
    assert got == [(*r, i) for i, r in enumerate(rows, 5)]
    assert max(moved) < 40 * 41 // 2 + 40  # complexes and blocks alone; all products before


def test_rings_are_looked_up_for_sides_of_one_and_two_alone(spark, tmp_path, monkeypatch):
    from fluxloom.plans import catalog

    path, seen, attached = str(tmp_path), [], enumeration.attached_candidates
    spark.range(40).selectExpr("id AS s_suppkey", "CAST(3 + id div 8 % 2 AS INT) AS s_nationkey", "0.0D AS s_acctbal").write.parquet(f"{path}/supplier.parquet")
    monkeypatch.setattr(enumeration, "attached_candidates", lambda *a: seen.append(attached(*a)) or seen[-1])
    got = sorted(tuple(r) for r in catalog.queries()["ring_rules"](spark, path).collect())
    assert len(seen) == 2 and 0 < sum(d.count() for d in seen) < len(got) // 2
    assert all((r[1] < 0) != (r[3] < 0) for d in seen for r in d.select(*enumeration.KEYS).collect())
    monkeypatch.setattr(enumeration, "unique_ids", lambda _: False)
    assert got == sorted(tuple(r) for r in catalog.queries()["ring_rules"](spark, path).collect()) and any(r[4] or r[5] for r in got)

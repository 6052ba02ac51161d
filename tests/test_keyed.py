"""Keyed tables, lookups by table, rounds cut off, and the watch over jobs."""

import dataclasses
import re
import threading
import time

import pytest
from pyspark.sql import functions as F

from fluxloom import schema as S
from fluxloom import shared
from fluxloom.config import RunConfig
from fluxloom.operators import bucketing, enumeration
from fluxloom.plans import driver, watch
from fluxloom.sources import keyed, readers, writers
from tests.test_network import E, pool  # noqa: F401  (a fixture)


@pytest.fixture(scope="module")
def many(spark):
    return spark.range(40).selectExpr("CAST(id AS INT) AS ind", "CAST(id % 3 AS INT) AS n_a", "CAST(id % 2 AS INT) AS n_b")


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def branches(df):
    """The plan's scans, each with the operators above it up to the next join."""
    text = df._jdf.queryExecution().executedPlan().toString()
    lines = [(len(re.match(r"[ :+\-|]*", x)[0]), x) for x in text.splitlines() if re.search(r"[A-Za-z]", x)]
    out = []
    for i, (depth, line) in enumerate(lines):
        if "FileScan" in line:
            above, at = [line], depth
            for d, x in reversed(lines[:i]):
                if d < at:
                    if "Join" in x or "Union" in x:
                        break
                    above.append(x)
                    at = d
            out.append(above)
    return out


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("part_rows", [10**6, 30, 1])
def test_candidates_from_a_keyed_index(spark, many, tmp_path, no_broadcast, part_rows):
    core = many.filter("ind < 3").select("ind")
    complexes = bucketing.complexes(many, core, E)
    want = rows_of(enumeration.candidates(complexes, enumeration.product_index(many, E), E))
    index, path = enumeration.product_index(many, E), str(tmp_path / "index")
    writers.index(index, path, E, 8, part_rows)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in index.schema)
    table, parts = readers.index(spark, path, schema, E, 8)
    assert (parts.count() > 0) == (part_rows < 10**6) and table.count() == index.count()
    for round_ in (complexes, bucketing.complexes(many, many.filter("ind < 5").select("ind"), E, many.filter("ind IN (3, 4)").select("ind"))):
        keys = [*E, keyed.PART]
        got = enumeration.candidates(keyed.to_parts(round_, parts, E).repartition(8, *keys), table, keys)
        scan = [b for b in branches(got) if "Bucketed: true" in b[0]]
        assert len(scan) == 1 and not any("Exchange" in x for x in scan[0])  # the index isn't moved, in any round
        assert rows_of(got) == (want if round_ is complexes else rows_of(enumeration.candidates(round_, index, E)))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("keyed_")]


def test_dedup_shuffles_the_batch_alone(spark, tmp_path, no_broadcast):
    rows = spark.range(3000).selectExpr("CAST(id % 40 AS INT) AS reactant_1", "CAST(id % 7 AS INT) AS reactant_2", "CAST(id % 11 AS INT) AS product_1", "-1 AS product_2")
    full = lambda d: d.selectExpr("*", "2 AS number_of_reactants", "1 AS number_of_products", "1.0D AS rate", "0.0D AS dG", "0.0D AS dG_barrier", "0 AS is_redox")
    net, keys = str(tmp_path / "net"), str(tmp_path / "keys")
    sizes = []
    for i, low in ((1, 30), (2, 20), (3, 0)):
        batch = full(rows.filter(F.col("reactant_1") >= low))
        sizes.append(writers.append_reactions(batch, net, i, offset=sum(sizes), keys=keys, buckets=8))
    stored = readers.reactions(spark, net)
    assert sizes[0] and sizes[1] and sizes[2] and enumeration.duplicate_groups(stored).count() == 0
    assert rows_of(stored.select(*enumeration.canonical(stored))) == rows_of(rows.select(*enumeration.canonical(rows)).distinct())
    assert rows_of(stored.select("reaction_id")) == [(i,) for i in range(sum(sizes))]
    d = enumeration.fresh(full(rows), stored=writers.stored_keys(spark, net, keys, 3, 8), buckets=8)
    scans = [b for b in branches(d) if "Bucketed: true" in b[0]]
    assert len(scans) == 3 and not any("Exchange" in x for b in scans for x in b)
    assert d._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # the batch, once
    assert d.count() == 0
    # Keys that are lost are written again from the network; a repeated round replaces its own.
    shared.remove(f"{keys}/iteration=1")
    batch = full(rows.filter(F.col("reactant_1") >= 20))
    assert writers.append_reactions(batch, net, 2, offset=sizes[0], keys=keys, buckets=8) == sizes[1]


def test_lookup_opens_the_blocks_of_its_ids_alone(spark, tmp_path):
    rows = spark.range(1000).selectExpr("CAST(id AS INT) AS reactant_1", "-1 AS reactant_2", "0 AS product_1", "-1 AS product_2", "1 AS number_of_reactants", "1 AS number_of_products", "1.0D AS rate", "0.0D AS dG", "0.0D AS dG_barrier", "0 AS is_redox")
    path = str(tmp_path / "net")
    writers.append_reactions(rows, path, 1, block_ids=50)
    net = readers.Network(rows, readers.reactions(spark, path), blocks=readers.reactions_in_blocks(spark, path))
    assert "block" not in net.reactions.columns and net.reactions.count() == 1000
    ids = spark.createDataFrame([(3,), (3,), (49,), (720,), (None,), (5000,)], "reaction_id long")
    got = net.lookup(ids, 50)
    assert sorted(r.reaction_id for r in got.collect()) == [3, 49, 720] and {r.reactant_1 for r in got.collect()} == {3, 49, 720}
    files = lambda d: {r.f for r in d.select(F.input_file_name().alias("f")).distinct().collect()}
    opened = files(net.blocks.filter(F.col("block").isin([0, 14])))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*block#\d+L? IN", plan) and 0 < len(opened) < len(files(net.blocks)) / 5
    assert net.lookup(ids.limit(0), 50).count() == 0
    plain = readers.Network(rows, net.reactions)
    assert rows_of(plain.lookup(ids)) == rows_of(got)


def test_an_index_of_other_species_is_replaced(spark, many, tmp_path):
    d = many.withColumns({c: F.lit(0.0) for c in enumeration.CARRIED})
    cfg = RunConfig("a", str(tmp_path), 0.0)
    first = driver.product_index(spark, cfg, d, E)[0].count()
    when = shared.modified(cfg.path("work", "index.json"))
    assert driver.product_index(spark, cfg, d, E)[0].count() == first and shared.modified(cfg.path("work", "index.json")) == when
    assert driver.product_index(spark, cfg, d.filter("ind < 10"), E)[0].count() == 10 + 55
    assert driver.product_index(spark, dataclasses.replace(cfg, species_path="b"), d, E)[0].count() == first


def config(tmp_path, pool, name, **more):  # noqa: F811
    path = tmp_path / "species"
    if not path.exists():
        pool.write.parquet(str(path))
    return RunConfig(str(path), str(tmp_path / name), -1.4, initial_state_counts={1: 40, 2: 40}, n_simulations=4, step_cutoff=50, max_iterations=2, end_of_run_reports=False, **more)


def network_of(spark, cfg):
    return rows_of(readers.reactions(spark, f"{cfg.out_dir}/network").select("reaction_id", *enumeration.KEYS, "iteration"))


def test_a_round_cut_twice_gives_the_rows_of_an_uncut_one(spark, pool, tmp_path):  # noqa: F811
    whole = config(tmp_path, pool, "whole")
    state = driver.run(spark, whole)
    cut = config(tmp_path, pool, "cut", work_pieces=2, iteration_seconds=0.0, progress_path=str(tmp_path / "progress.json"))
    first = driver.run(spark, cut)
    assert first.cut_off and first.iteration == 0 and shared.json_or(str(tmp_path / "progress.json"))["pieces_left"] == 1
    second = driver.run(spark, cut)  # ends the first round, is cut off in the second
    assert second.iteration == 1 and second.cut_off
    while (last := driver.run(spark, cut)).cut_off:
        pass
    assert (last.iteration, last.core_ids, last.per_iter_rxn_counts) == (state.iteration, state.core_ids, state.per_iter_rxn_counts)
    assert network_of(spark, cut) == network_of(spark, whole)
    assert not shared.listed(f"{cut.out_dir}/work/round=*")


def test_a_broken_record_isnt_taken_for_none(spark, pool, tmp_path):  # noqa: F811
    cfg = config(tmp_path, pool, "a")
    (tmp_path / "a").mkdir()
    (tmp_path / "a/core_state.json").write_text('{"core_ids": [1')
    with pytest.raises(ValueError, match="core_state.json"):
        driver.run(spark, cfg)


def _slow(batches):
    for b in batches:
        time.sleep(60 if (b.column("id").to_numpy() == 7).any() else 0.01)
        yield b


def test_a_stalled_job_is_recorded_and_cancelled(spark, tmp_path):
    spark.range(4).mapInArrow(_slow, "id long").count()  # workers are up
    record, began = str(tmp_path / "watch.json"), time.time()
    with pytest.raises(watch.Stalled), watch.watched(spark, 5.0, record, 0.2, counts=lambda: {"verdicts": 3}):
        spark.range(40, numPartitions=40).mapInArrow(_slow, "id long").count()
    assert time.time() - began < 40
    found = shared.json_or(record)
    assert found["stalled_seconds"] > 5 and found["tasks_done"] >= 30 and found["tasks_active"] >= 1 and found["counts"] == {"verdicts": 3}
    with watch.watched(spark, 30.0, record, 0.1):
        assert spark.range(10).count() == 10
    with pytest.raises(ZeroDivisionError), watch.watched(spark, 30.0):
        1 / 0  # noqa: B018
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None


def test_scopes_of_threads_are_their_own(spark):
    inside, go_on = threading.Event(), threading.Event()
    kept = {}

    def other():
        kept["mine"] = shared.written(spark.range(3).toDF("x"), "t")
        inside.set()
        go_on.wait(60)

    with shared.scratch():
        t = threading.Thread(target=other)
        t.start()
        inside.wait(60)
        own = shared.written(spark.range(2).toDF("x"), "t")
    go_on.set()
    t.join()
    assert kept["mine"].count() == 3 and not shared.exists(own.shared_path_)


# --- a series over a stream, and pathways by pointer doubling


def test_state_series_over_a_stream(spark, tmp_path):
    from fluxloom.operators import analysis
    from fluxloom.streaming import live, state

    net = spark.createDataFrame([(1, 1, 2, 3, -1), (2, 3, -1, 1, 1), (3, 4, -1, 4, -1)], "reaction_id long, reactant_1 int, reactant_2 int, product_1 int, product_2 int")
    initial = spark.createDataFrame([(1, 50), (2, 40)], "species_id int, count int")
    fired = [(s, i, 1 + (s * 7 + i * i) % 3) for s in range(3) for i in range(30)] + [(9, 0, -1), (9, 1, None)]
    log = spark.createDataFrame(fired, "seed int, step int, reaction_id long")
    want = rows_of(analysis.state_series(net, log, initial).selectExpr("CAST(seed AS LONG)", "step", "species_id", "count"))
    at = str(tmp_path / "log")
    for low, high in ((0, 10), (10, 11), (11, 30)):  # each start goes on from the checkpoint
        log.filter((F.col("step") >= low) & (F.col("step") < high)).coalesce(1).write.mode("append").parquet(at)
        stream = live.firing_stream(spark, at, schema=log.schema)
        live.append_batches(state.live_state(stream, net, initial), lambda rows: rows, str(tmp_path / "out"), str(tmp_path / "c"))
    got = live.read_batches(spark, str(tmp_path / "out"), state.OUT)
    assert rows_of(got.filter("NOT late").drop("late", "batch")) == want and got.filter("late").count() == 0
    # A firing of step 5 that comes now counts from now on.
    spark.createDataFrame([(0, 5, 2)], log.schema).write.mode("append").parquet(at)
    live.append_batches(state.live_state(live.firing_stream(spark, at, schema=log.schema), net, initial), lambda rows: rows, str(tmp_path / "out"), str(tmp_path / "c"))
    late = {(r.species_id, r["count"]) for r in live.read_batches(spark, str(tmp_path / "out"), state.OUT).filter("late").collect()}
    last = {r.species_id: r.n for r in got.filter("seed = 0 AND NOT late").groupBy("species_id").agg(F.max_by("count", "step").alias("n")).collect()}
    assert late == {(1, last[1] + 2), (3, last[3] - 1)}


def test_idle_seeds_are_forgotten(spark, tmp_path):
    from fluxloom.streaming import live, state

    net = spark.createDataFrame([(1, 1, -1, 2, -1)], "reaction_id long, reactant_1 int, reactant_2 int, product_1 int, product_2 int")
    initial = spark.createDataFrame([(1, 50)], "species_id int, count int")
    kind, at = "seed int, step int, reaction_id long, ts timestamp", str(tmp_path / "log")
    counts = []
    for seed, step, hour in ((1, 0, 0), (1, 1, 0), (2, 0, 9), (2, 1, 9), (1, 2, 9)):
        spark.createDataFrame([(seed, step, 1)], "seed int, step int, reaction_id long").selectExpr("*", f"timestamp'2024-01-01 0{hour}:00:00' AS ts").write.mode("append").parquet(at)
        stream = live.firing_stream(spark, at, schema=kind)
        live.append_batches(state.live_state(stream, net, initial, "ts"), lambda rows: rows, str(tmp_path / "out"), str(tmp_path / "c"))
    for r in live.read_batches(spark, str(tmp_path / "out"), state.OUT).filter("species_id = 1").collect():
        counts.append((r.seed, r.step, r["count"]))
    assert sorted(counts) == [(1, 0, 49), (1, 1, 48), (1, 2, 49), (2, 0, 49), (2, 1, 48)]  # the first seed starts anew after nine hours


def plain_pathways(net, log, absent):
    """seed, species: pathway, one seed at a time."""
    out = {}
    for seed in {s for s, _, _ in log}:
        made = {}
        for _, step, r in sorted((x for x in log if x[0] == seed), key=lambda x: x[1]):
            for s in (x for x in net[r][2:] if x >= 0):
                made.setdefault(s, (step, r))
        for s, (step, r) in sorted(made.items(), key=lambda x: x[1]):
            heads, way = [], None
            for x in net[r][:2]:
                if x in absent and x in made and made[x][0] < step:
                    heads.append(out[seed, x])
                    if sorted(y for y in net[made[x][1]][2:] if y >= 0) == sorted(y for y in net[r][:2] if y >= 0):
                        way = [*out[seed, x], r]
                        break
            if way is None:
                way = [r]
                for h in heads:
                    way = h + way
            out[seed, s] = way
    return out


def test_pathways_of_one_long_and_many_short_seeds(spark):
    import random

    from fluxloom.operators import analysis

    rnd = random.Random(2)
    net = {i: (i, -1, i + 1, -1) for i in range(300)}  # a chain
    net |= {1000 + i: (rnd.randrange(12), rnd.choice([-1, *range(12)]), rnd.randrange(12), rnd.choice([-1, *range(12)])) for i in range(60)}
    log = [(1, i, i) for i in range(300)] + [(s, i, 1000 + rnd.randrange(60)) for s in range(2, 30) for i in range(40)] + [(50, 0, -1)]
    absent = set(range(3, 301))
    network = spark.createDataFrame([(k, *v) for k, v in net.items()], "reaction_id long, reactant_1 int, reactant_2 int, product_1 int, product_2 int")
    initial = spark.createDataFrame([(i, 0 if i in absent else 5) for i in range(301)], "species_id int, count int")
    d = analysis.pathways(network, spark.createDataFrame(log, "seed long, step int, reaction_id long"), initial)
    want = plain_pathways(net, [x for x in log if x[2] >= 0], absent)
    assert {(r.seed, r.species_id): r.pathway for r in d.collect()} == want
    assert max(map(len, want.values())) > 290 and analysis.pathways(network, spark.createDataFrame([], "seed long, step int, reaction_id long"), initial).count() == 0


def verdict_rows(spark, *rows):
    return spark.createDataFrame([(k, a, "allowed" if a else "rejected", 0.1, float(ts), v) for k, a, ts, v in rows], S.VERDICTS)


def test_compaction_keeps_the_latest_of_each_key_and_what_is_added_meanwhile(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "cache")
    seen = lambda: sorted((r.rxn_key, r.allowed, r.ts) for r in readers.verdict_cache(spark, path).collect())
    assert writers.compact_verdicts(spark, path) == 0 and seen() == []
    writers.verdicts(verdict_rows(spark, ("a", 1, 1, "1.0.0"), ("b", 1, 1, "0.9")), path)
    writers.verdicts(verdict_rows(spark, ("a", 0, 2, "1.0.0"), ("c", 1, 1, "1.0.0")), path)
    early = readers.verdict_cache(spark, path)
    assert writers.compact_verdicts(spark, path) == 2 and seen() == [("a", 0, 2.0), ("c", 1, 1.0)]  # b is another version's
    assert early.count() == 4  # who began before reads on
    # Added between the compaction's reading and its record.
    own = writers.record
    with monkeypatch.context() as m:
        m.setattr(writers, "record", lambda *a: (writers.verdicts(verdict_rows(spark, ("d", 1, 5, "1.0.0")), path), own(*a)))
        assert writers.compact_verdicts(spark, path) == 2
    assert seen() == [("a", 0, 2.0), ("c", 1, 1.0), ("d", 1, 5.0)]
    # Cut off before the record: the cache is as it was, and the next compaction goes through.
    with monkeypatch.context() as m:
        m.setattr(writers, "record", lambda *a: (_ for _ in ()).throw(RuntimeError("cut off")))
        with pytest.raises(RuntimeError, match="cut off"):
            writers.compact_verdicts(spark, path)
    assert seen() == [("a", 0, 2.0), ("c", 1, 1.0), ("d", 1, 5.0)]
    assert writers.compact_verdicts(spark, path) == 3 and len(readers.verdict_parts(path)) == 1


def test_appends_and_compactions_at_once_lose_nothing(spark, tmp_path):
    path, failed = str(tmp_path / "cache"), []

    def add():
        try:
            for i in range(6):
                writers.verdicts(verdict_rows(spark, (f"k{i}", 1, i, "1.0.0")), path)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    t = threading.Thread(target=add)
    t.start()
    while t.is_alive():
        writers.compact_verdicts(spark, path)
    t.join()
    assert not failed and {r.rxn_key for r in readers.verdict_cache(spark, path).collect()} == {f"k{i}" for i in range(6)}
    assert writers.compact_verdicts(spark, path) == 6


"""The jobs over growing, repeated and odd input, and their command lines."""

import json
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from fluxloom.operators import mentions
from fluxloom.streaming import live
from jobs import firing_ledger, seed_evidence, settings

ROOT = Path(__file__).resolve().parents[1]
FIRINGS = "event_id long, ts timestamp, user_id long, day int, batch int, seed double"
PARTS = "p_partkey long, p_retailprice double, p_size int, batch int"


def rows_of(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


def files_of(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


@pytest.fixture
def growing(spark, sf_dir, tmp_path):
    """A folder for events, a function that adds the n-th third of them, and the parts."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = tmp_path / "events.parquet"

    def add(n):
        events.filter(F.col("event_id") % 3 == n).coalesce(2).write.mode("append").parquet(str(at))

    return at, add, f"{sf_dir}/part.parquet"


def of_sql(events, part):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{events}/*.parquet')")
    con.sql(f"CREATE VIEW part AS SELECT * FROM read_parquet('{part}')")
    d = con.sql(firing_ledger.SQL)
    return sorted((tuple(r) for r in d.select(*(duckdb.ColumnExpression(c) for c in sorted(d.columns))).fetchall()), key=str)


def test_ledger_takes_only_what_is_new(spark, growing, tmp_path, caplog):
    at, add, part = growing
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    caplog.set_level("INFO", "jobs")
    run = lambda **c: firing_ledger.run(spark, str(at), part, out, mark, c)
    add(0)
    assert rows_of(run()) == of_sql(at, part)
    first = files_of(out)
    assert rows_of(run()) == of_sql(at, part) and files_of(out) == first  # nothing new: nothing is written
    add(1)
    add(2)
    caplog.clear()
    assert rows_of(run(files_per_batch=1)) == of_sql(at, part)
    new = spark.read.parquet(str(at)).count() - spark.read.parquet(str(at)).filter("event_id % 3 = 0").count()
    assert f"read {new} new firings" in caplog.text and "in 2 batches" in caplog.text
    assert {k: v for k, v in files_of(f"{out}/ledger").items() if k.startswith("batch=0/")} == {k[7:]: v for k, v in first.items() if k.startswith("ledger/batch=0/")}


def test_only_touched_days_are_written_anew(spark, growing, tmp_path):
    at, add, part = growing
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    add(0)
    firing_ledger.run(spark, str(at), part, out, mark)
    before = files_of(f"{out}/daily")
    day = "2024-01-05"
    spark.read.parquet(str(at)).filter(F.date_format("ts", "yyyy-MM-dd") == day).limit(3).coalesce(1).write.mode("append").parquet(str(at))
    assert rows_of(firing_ledger.run(spark, str(at), part, out, mark)) == of_sql(at, part)
    after = files_of(f"{out}/daily")
    assert {k for k in after if after[k] != before.get(k)} == {k for k in after if k.startswith(f"day={day}/")}


@pytest.mark.parametrize("place", ["ledger", "commit", "daily"])
def test_ledger_goes_on_after_a_failure(spark, growing, tmp_path, monkeypatch, place):
    """Cut off while it adds up a batch, between a batch's write and its commit, and before the daily sums."""
    at, add, part = growing
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    add(0)
    firing_ledger.run(spark, str(at), part, out, mark)
    add(1)
    with monkeypatch.context() as m:
        fail = lambda *a, **k: (_ for _ in ()).throw(RuntimeError("cut off"))
        if place == "daily":
            m.setattr(firing_ledger, "daily", fail)
        elif place == "ledger":
            m.setattr(firing_ledger, "additions", fail)
        else:
            own = live._write_batch
            m.setattr(live, "_write_batch", lambda *a: (own(*a), fail()))
        with pytest.raises(Exception, match="cut off"):
            firing_ledger.run(spark, str(at), part, out, mark)
    if place == "commit":
        assert live.read_batches(spark, f"{out}/ledger", "batch long").agg(F.max("batch")).first()[0] == 1  # written, not committed
    add(2)
    assert rows_of(firing_ledger.run(spark, str(at), part, out, mark)) == of_sql(at, part)


def test_ledger_of_odd_firings(spark, tmp_path):
    parts = spark.createDataFrame([(i, 900.0, 1, 7) for i in range(6)], PARTS)
    parts.write.parquet(str(tmp_path / "part.parquet"))
    events = spark.createDataFrame([(1, None, 1, 0, 0, 0.0), (1, None, 1, 0, 0, 0.0), (None, None, 2, 0, 0, 0.0), (2, None, None, 0, 0, 0.0)], FIRINGS)
    events.limit(0).write.parquet(str(tmp_path / "e.parquet"))
    run = lambda: firing_ledger.run(spark, str(tmp_path / "e.parquet") + "/", str(tmp_path / "part.parquet"), str(tmp_path / "out"), str(tmp_path / "c"))
    assert run().count() == 0
    events.write.mode("append").parquet(str(tmp_path / "e.parquet"))
    got = run()
    assert {r.day for r in got.collect()} == {None}
    side = Counter()
    for n, i in ((2, 1), (1, 2)):
        for s in [i * 7 % 90] + ([i * 11 % 90] if i % 3 else []) + [(i * 13 + 1) % 90] + ([(i * 17 + 3) % 90] if i % 2 else []):
            side[s] += n
    assert {r.species_id: r.touched for r in got.collect()} == dict(side)
    assert sum(r.n_seeds for r in got.collect()) == len({s for i in (1,) for s in (7, 11, 14, 20)})  # a null seed counts as none


def test_evidence_of_texts(spark, tmp_path):
    docs = [(1, "CH3OH and HOCH3, CH. x", "a"), (1, "CH3OH and HOCH3, CH. x", "a"), (2, "C H OH é-OH C12345H", None), (3, None, "b"), (4, "", "b"), (5, "no formula; Co, OHx, xOH", "b"), (6, "SO2 " * 30_000, "c")]
    d = spark.createDataFrame([(i, t, s, "clash", 3) for i, t, s in docs], "doc_id long, text string, source string, formula string, n_texts int")
    found = mentions.counted(d.select("text", "source", "formula"), ["C", "H", "O", "S"], 2, ["source"])
    assert rows_of(found) == sorted([("C1H4O1", 4, 2, "a"), ("C1H1", 2, 2, "a"), ("H1O1", 2, 1, None), ("O2S1", 30_000, 1, "c")], key=str)
    pool = spark.createDataFrame([(7, 1, 4, 1, 0, 0, -1.0), (5, 1, 4, 1, 0, 0, -1.0), (4, 1, 4, 1, 0, 1, -9.0), (3, 1, 1, 0, 0, 1, -9.0)], "ind int, n_c int, n_h int, n_o int, n_s int, charge int, solvation_free_energy double")
    named = mentions.with_species(found, pool, settings(seed_evidence.__file__)["symbols"])
    assert {r.formula: (r.n_species, r.seed) for r in named.collect()} == {"C1H4O1": (3, 5), "C1H1": (1, -1), "H1O1": (0, -1), "O2S1": (0, -1)}
    assert mentions.counted(d.limit(0), ["C"], 1).count() == 0


def test_symbols_of_two_letters(spark):
    d = spark.createDataFrame([("Li2CO3 LiF NaC Na2O Nx CNa",)], "text string")
    got = {r.formula: r.n_mentions for r in mentions.counted(d, ["C", "F", "Li", "N", "Na", "O"]).collect()}
    assert got == {"C1Li2O3": 1, "F1Li1": 1, "C1Na1": 2, "Na2O1": 1}


def test_evidence_runs_again_with_the_same_result(spark, sf_dir, tmp_path):
    run = lambda: rows_of(seed_evidence.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/supplier.parquet", str(tmp_path / "out")))
    assert run() == run() and run()
    assert all(p.parent.name.startswith("source=") for p in (tmp_path / "out").rglob("*.parquet"))


@pytest.mark.parametrize("name", ["firing_ledger", "seed_evidence"])
def test_command_lines(spark, sf_dir, tmp_path, name):
    given = {"firing_ledger": ["--events", "events", "--network", "part"], "seed_evidence": ["--documents", "documents", "--species", "supplier"]}[name]
    paths = [f"{sf_dir}/{x}.parquet" if i % 2 else x for i, x in enumerate(given)]
    more = ["--checkpoint", str(tmp_path / "c")] if name == "firing_ledger" else []
    (tmp_path / "c.json").write_text(json.dumps({"files_per_batch": 1} if more else {"least_atoms": 3}))
    done = subprocess.run([sys.executable, "-m", f"jobs.{name}", *paths, "--out", str(tmp_path / "out"), *more, "--config", str(tmp_path / "c.json")], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read " in done.stderr and "wrote " in done.stderr
    assert spark.read.parquet(str(tmp_path / ("out/daily" if more else "out"))).count() > 0


def test_settings_that_are_none(tmp_path):
    (tmp_path / "c.json").write_text('{"colour": 1}')
    with pytest.raises(ValueError, match="colour"):
        settings(seed_evidence.__file__, str(tmp_path / "c.json"))


@pytest.mark.parametrize("job", [firing_ledger, seed_evidence])
def test_registered_query_equals_its_sql(spark, sf_dir, job):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    d = con.sql(job.SQL)
    want = sorted((tuple(r) for r in d.select(*(duckdb.ColumnExpression(c) for c in sorted(d.columns))).fetchall()), key=str)
    settings_before = {k: v for k, v in spark.conf.getAll.items() if k.startswith("spark.sql")}
    assert rows_of(job.query(spark, sf_dir)) == want and want
    assert {k: v for k, v in spark.conf.getAll.items() if k.startswith("spark.sql")} == settings_before


"""The state of a run as facts and as text."""

from __future__ import annotations

import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from fluxloom import shared
from fluxloom.functions import text
from fluxloom.operators import analysis, enumeration
from fluxloom.sources import readers


def collect(spark: SparkSession, out_dir: str, cache_path: str | None = None) -> dict:
    """What a run has made so far; parts that are missing are left out."""
    state = shared.json_or(f"{out_dir}/core_state.json") or {}
    config = shared.json_or(f"{out_dir}/config_used.json") or (shared.json_or(f"{out_dir}/final_summary.json") or {}).get("config", {})
    facts: dict = {
        "out_dir": out_dir, "state": state, "reports": readers.iteration_reports(out_dir), "now": time.time(),
        "config": config, "saved_at": shared.modified(f"{out_dir}/core_state.json"),
    }
    if shared.exists(f"{out_dir}/network"):
        net = readers.reactions(spark, f"{out_dir}/network")
        facts["n_reactions"] = net.count()
        facts["by_arity"] = {r.arity: r.n for r in enumeration.by_arity(net).toLocalIterator()}
        facts["n_species"] = enumeration.species_in(net).count()
        facts["n_duplicate_groups"] = enumeration.duplicate_groups(net).count()
    cache = readers.verdict_cache(spark, cache_path or f"{out_dir}/verdicts")
    facts["verdicts"] = {r.status: r.n for r in analysis.verdict_stats(cache).toLocalIterator()}
    facts["elapsed"] = analysis.elapsed_stats(cache).first().asDict()
    facts["percentiles"] = next((r.asDict() for r in analysis.percentiles(cache.filter(F.col("elapsed") > 0.01), "elapsed").toLocalIterator()), None)
    return facts


def totals(reports: list[dict]) -> dict:
    """Sums over iterations."""
    return {"n_new_reactions": sum(r.get("n_new_reactions", 0) for r in reports), "elapsed_sec": sum(r.get("elapsed_sec", 0) for r in reports), "n_promoted": sum(len(r.get("promoted_ids", [])) for r in reports)}


def variant(facts: dict) -> str:
    """Whether candidates went through the mapper: by the configuration and by the verdicts that lie there."""
    if facts["config"].get("aam_filter"):
        return "with mapping"
    return "mapping off, but verdicts are there" if facts.get("verdicts") else "without mapping"


def stale(facts: dict, after_s: float = 24 * 3600, stuck_s: float = 3600) -> str | None:
    """Why a run looks idle: its last save, or that of a round in progress, lies too far back; None if it doesn't."""
    if not facts.get("saved_at"):
        return None
    age = facts["now"] - facts["saved_at"]
    if age > after_s:
        return f"last saved {text.duration(age)} ago: idle or finished"
    at = (shared.json_or(facts["config"]["progress_path"]) or {}).get("at") if facts["config"].get("progress_path") else None
    if at and not facts["state"].get("converged") and facts["now"] - max(at, facts["saved_at"]) > stuck_s:
        return f"no progress for {text.duration(facts['now'] - max(at, facts['saved_at']))}"
    return None


def anomalies(facts: dict) -> list[str]:
    found = []
    counts = facts["state"].get("per_iter_rxn_counts", [])
    if "n_reactions" in facts and facts["n_reactions"] != sum(counts):
        found.append(f"the network has {facts['n_reactions']} reactions, the record {sum(counts)}")
    if facts.get("n_duplicate_groups"):
        found.append(f"{facts['n_duplicate_groups']} reactions occur more than once")
    if facts.get("verdicts", {}).get("no_mapping"):
        found.append(f"{facts['verdicts']['no_mapping']} reactions have no mapping")
    if facts.get("verdicts", {}).get("timeout"):
        found.append(f"{facts['verdicts']['timeout']} mappings ran out of time")
    if reason := stale(facts):
        found.append(reason)
    return found


def render(facts: dict) -> str:
    t = totals(facts["reports"])
    lines = [f"run {facts['out_dir']}, {variant(facts)}", f"iterations {facts['state'].get('iteration', 0)}, core {len(facts['state'].get('core_ids', []))}, reactions {facts.get('n_reactions', 0):,}"]
    lines += [f"  {k}: {n:,}" for k, n in sorted(facts.get("by_arity", {}).items())]
    lines.append(f"verdicts {facts['verdicts']}, elapsed {text.duration(t['elapsed_sec'])}, promoted {t['n_promoted']}")
    kept, rejected = facts["verdicts"].get("allowed", 0), facts["verdicts"].get("rejected", 0)
    if kept + rejected:
        lines.append(f"share kept {kept / (kept + rejected):.3f}")
    return "\n".join([*lines, *(f"anomaly: {a}" for a in anomalies(facts))])

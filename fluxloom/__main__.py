"""python -m fluxloom run CONFIG | production CONFIG [N STEPS] | reports CONFIG | sinks OUT_DIR [SPECIES] | status OUT_DIR | seeds SPECIES FORMULA:CHARGE... | map IN_CSV OUT_CSV [SECONDS]"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from fluxloom.config import load_config
from fluxloom.functions import text
from fluxloom.operators import mapper, species
from fluxloom.plans import driver, status
from fluxloom.sources import readers, writers


def main(args: list[str]) -> int:
    if not args:
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("fluxloom").getOrCreate()
    what, *rest = args
    if what in ("run", "production", "reports"):
        cfg, ignored = load_config(rest[0])
        if ignored:
            print("ignored settings:", ", ".join(ignored))
        if what == "run":
            state = driver.run(spark, cfg)
            print(f"{len(state.core_ids)} species in core after {state.iteration} iterations, {sum(state.per_iter_rxn_counts)} reactions")
        elif what == "production":
            n, steps = (int(rest[1]), int(rest[2])) if len(rest) > 2 else (10_000, 200_000)
            print(driver.production(spark, cfg, n, steps).count(), "firings")
        else:
            print(*driver.reports(spark, cfg, readers.species(spark, cfg.species_path)), sep="\n")
    elif what == "sinks":
        print(*driver.stand_alone_sinks(spark, *rest), sep="\n")
    elif what == "status":
        print(status.render(status.collect(spark, rest[0])))
    elif what == "seeds":
        pool = readers.species(spark, rest[0])
        for q in rest[1:]:
            print(q, species.lowest_energy(pool, *text.query_parts(q)))
    elif what == "map":
        done = mapper.map_reactions(readers.mapper_csv(spark, rest[0]), float(rest[2]) if len(rest) > 2 else 120.0)
        writers.mapper_csv(done.select(F.col("rxn_key").cast("long").alias("reaction_id"), *done.columns[1:]), rest[1])
    else:
        print(__doc__)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

"""Time headline queries and print one line of JSON."""

from __future__ import annotations

import json
import os
import sys
import time

from tessera import catalog
from tessera.plans import queries as plans
from tessera.session import local_session

HEADLINE = """search_and_or_not unique_terms_words unique_terms_bigrams term_lift network_type_pair_stats ego_network global_network
entity_metrics related_documents degree_distribution transitivity mixing_matrix strata_facets demo_decades knn_cosine rrf_fusion chunk_fixed
events_tumbling events_session""".split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(f"local[{os.environ.get('BENCH_CPUS', '8')}]")
    spark.sparkContext.setLogLevel("ERROR")
    found = catalog.queries()
    spark.range(1).count()
    took = {}
    # The stored mentions and network, which the queries after them read.
    for name, build in (("mentions_build", plans.mentions), ("network_build", plans.edges)):
        began = time.time()
        build(spark, sf_dir)
        took[name] = round(time.time() - began, 3)
    for name in HEADLINE:
        began = time.time()
        found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir)}))
    sys.stdout.flush()


if __name__ == "__main__":
    main()

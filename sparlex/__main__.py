"""python -m sparlex list | run QUERY SF_DIR [OUT] | report SF_DIR | query SF_DIR TEXT [--mode M] [--limit N] [--chunker C] [--lang L] [--source S] [--min-chars N] [--max-chars N]

The registered queries, and one question of your own, from the command line.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .plans import catalog
from .reports import report


def ask(args: list[str]) -> int:
    """One question: the filters stand before the search; hits with a snippet, then the seconds of each step."""
    from .operators.retrieval import MODES, build_filter
    from .operators.searching import Searcher, one_shot
    from .plans.search import chunks

    p = argparse.ArgumentParser(prog="sparlex query")
    p.add_argument("sf_dir")
    p.add_argument("text")
    p.add_argument("--mode", default="hybrid_dbsf", choices=MODES)
    p.add_argument("--limit", type=int, default=5)
    for name in ("--chunker", "--lang", "--source"):
        p.add_argument(name)
    for name in ("--min-chars", "--max-chars"):
        p.add_argument(name, type=int)
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("sparlex").getOrCreate()
    papers = spark.read.parquet(f"{a.sf_dir}/documents.parquet").select(F.col("doc_id").alias("paper_id"), "lang", "source", "n_chars")
    place = chunks(spark, a.sf_dir).join(papers, "paper_id")
    hits, times = one_shot(Searcher(place), a.text, a.mode, a.limit, build_filter({"n_chars": (a.min_chars, a.max_chars)}, {"chunker": a.chunker, "lang": a.lang, "source": a.source}))
    hits.show(2 * a.limit, truncate=120)
    print(times)
    return 0


def main(args: list[str]) -> int:
    if args[:1] == ["query"]:
        return ask(args[1:])
    known = catalog.queries()
    if args[:1] == ["list"]:
        print("\n".join(sorted(known)))
        return 0
    if not args or args[0] not in ("run", "report") or args[0] == "run" and (len(args) < 3 or args[1] not in known):
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("sparlex").getOrCreate()
    if args[0] == "report":
        names = ("mrr_by_config", "win_loss_tie", "success_at_budget", "tokens_per_result_list", "overlap_by_category", "ols_regression", "abstention_rates")
        print(report("Retrieval evaluation", {n: known[n](spark, args[1]) for n in names}))
        return 0
    out = known[args[1]](spark, args[2])
    out.write.mode("overwrite").parquet(args[3]) if len(args) > 3 else out.show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

"""Print the physical plan of registered queries (for plan review).

usage: python scripts/show_plans.py [sf_dir] name [name ...]
"""
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main(argv):
    from gridflow.plans.queries import QUERIES
    from gridflow.session import get_spark
    sf_dir = argv[1] if len(argv) > 1 and "/" in argv[1] else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if "/" not in a]
    spark = get_spark("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                     "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    for n in names:
        print(f"===== {n}")
        QUERIES[n](spark, sf_dir).explain("formatted")


if __name__ == "__main__":
    main(sys.argv)

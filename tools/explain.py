"""Print the formatted physical plan of registered analyses.

    python tools/explain.py [--lazy] [--sf-dir DIR] name [name ...]

``--lazy`` plans from the raw tables (no saved base tables), which shows the whole
lineage: scans, pushed filters, joins, partial aggregation and every exchange.
"""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.01")
    ap.add_argument("--lazy", action="store_true")
    ap.add_argument("--mode", default="formatted")
    ap.add_argument("names", nargs="+")
    args = ap.parse_args()

    from cohortlens.plans.analyses import ANALYSES
    from cohortlens.plans.blocks import BLOCKS
    from cohortlens.plans.community import Community
    from cohortlens.plans.derived import DERIVED
    from cohortlens.session import build_session

    spark = build_session()
    fns = {**BLOCKS, **ANALYSES, **DERIVED}
    c = Community.from_fixture(spark, args.sf_dir, materialize=not args.lazy)
    for n in args.names:
        print(f"===== {n} =====")
        fns[n](c).explain(args.mode)


if __name__ == "__main__":
    main()

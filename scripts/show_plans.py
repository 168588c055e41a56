"""Print the physical plan of registered queries (after running them, so the
adaptive plan is final).

usage: python scripts/show_plans.py [sf_dir] [name ...]
"""

from __future__ import annotations

import sys

sys.path.insert(0, ".")

from tickerlake.plans.queries import registry  # noqa: E402
from tickerlake.session import build_session  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or ["q_signal", "q_backtest_full", "q_score"]
    spark = build_session()
    qs = registry()
    for name in names:
        df = qs[name](spark, sf_dir)
        df.collect()
        print(f"===== {name} =====")
        df.explain("formatted")


if __name__ == "__main__":
    main()

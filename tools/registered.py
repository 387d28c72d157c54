"""Print the names of the queries one catalog module registers."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from newsweave.catalog import QUERIES  # noqa: E402

print(" ".join(n for n, fn in QUERIES.items() if fn.__module__ == f"newsweave.catalog.{sys.argv[1]}"))

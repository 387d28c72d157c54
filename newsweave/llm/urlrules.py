"""URL rules by a sort-merge range join.

A rule names a host and the start of a path. It fits the host and all its subdomains, and of the rules
that fit a URL the longest one (host and path together, then the longer host) decides.

A host's canonical key has its labels in reverse order, each with a dot behind it
(``www.example.com``: ``com.example.www.``), so that a host and all its subdomains are one interval of
keys. URLs and rules are dealt into ranges of keys and sorted; a rule goes to every range that its
interval meets. One sweep over a range keeps a stack of the rule hosts whose intervals are open.
Intervals nest or are apart, so the stack is at most as deep as a host has labels, and holds all
rules that can fit the next URL; their path starts are looked up by length.

The ranges are cut at places of a bounded sample (``SAMPLE`` URLs for each range, those with the smallest
hash), which decides only how even they are. URLs of one host are ordered by a hash, so a host with a
third of all rows is cut into several ranges as well.

Null URLs, and those without ``://``, have an empty host and path, which no rule fits. Rules without a host are
left out; a null path counts as empty and fits every path; of equal rules with different verdicts block wins.
Repeated URLs are judged each; empty tables give empty results, without rules all URLs get ``default``.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweave.llm.common import cells, map_batches, schema_of, with_columns

#: URLs sampled for each range.
SAMPLE = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LAST = "\U0010ffff"


def host_of(url: Column) -> Column:
    """Behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url.cast("string"), r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """Behind the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url.cast("string"), r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(host: str) -> str:
    """Canonical key of a host."""
    return ".".join(reversed(host.split("."))) + "." if host else ""


def range_of(cuts: list[tuple[str, int]], key: str, spread: int) -> int:
    return bisect_right(cuts, (key, spread))


def ranges_of_rule(cuts: list[tuple[str, int]], key: str) -> range:
    """All ranges that the interval of a rule host meets."""
    return range(bisect_left(cuts, (key, -(1 << 63))), bisect_right(cuts, (key + LAST, 1 << 63)) + 1)


class Sweep:
    """The open rule hosts at the current place of a range."""

    def __init__(self):
        self.open: list[tuple[str, str, dict[str, str]]] = []

    def move(self, key: str) -> None:
        while self.open and not key.startswith(self.open[-1][0]):
            self.open.pop()

    def rule(self, key: str, host: str, path: str, verdict: str) -> None:
        self.move(key)
        if not self.open or self.open[-1][0] != key:
            self.open.append((key, host, {}))
        paths = self.open[-1][2]
        if paths.get(path) != "block":
            paths[path] = verdict

    def judge(self, key: str, path: str) -> tuple[str | None, str | None]:
        """(rule, verdict) of the longest rule that fits."""
        self.move(key)
        best, found = (-1, -1), (None, None)
        for _, host, paths in self.open:
            for n in sorted({len(p) for p in paths if len(p) <= len(path)}, reverse=True):
                verdict = paths.get(path[:n])
                if verdict is not None:
                    if (len(host) + n, len(host)) > best:
                        best, found = (len(host) + n, len(host)), (host + path[:n], verdict)
                    break
        return found


def judge(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", ranges: int | None = None) -> DataFrame:
    """``urls`` with host, path, rule (null where none fits) and verdict; columns of these names are replaced. ``rules`` has the columns
    host, path and verdict (allow or block)."""
    ranges = ranges or int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = urls.drop("host", "path", "rule", "verdict")
    own = kept.columns
    parsed = kept.withColumns({"_host": host_of(F.col(url)), "_path": path_of(F.col(url)), "_spread": F.xxhash64(*own)})
    sample = parsed.select("_host", "_spread").orderBy(F.xxhash64("_spread")).limit(SAMPLE * ranges).collect()
    places = sorted((key_of(r["_host"]), r["_spread"]) for r in sample)
    cuts = sorted({places[i * len(places) // ranges] for i in range(1, ranges)}) if places else []

    def place_urls(batches):
        for b in batches:
            keys = [key_of(h) for h in cells(b, "_host")]
            at = [range_of(cuts, k, s) for k, s in zip(keys, cells(b, "_spread"))]
            yield with_columns(b, _range=pa.array(at, pa.int32()), _key=pa.array(keys, pa.string()), _rule=pa.array([False] * len(at)), _verdict=pa.nulls(len(at), pa.string()))

    def place_rules(batches):
        for b in batches:
            rows = [(r, key_of(h), True, h, p, v) for h, p, v in zip(cells(b, "_host"), cells(b, "_path"), cells(b, "_verdict"))
                    for r in ranges_of_rule(cuts, key_of(h))]
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["_range", "_key", "_rule", "_host", "_path", "_verdict"])

    def sweep(batches):
        state, at = Sweep(), None
        for b in batches:
            out = []
            for r, key, is_rule, host, path, verdict in zip(*(cells(b, c) for c in ("_range", "_key", "_rule", "_host", "_path", "_verdict"))):
                if r != at:
                    state, at = Sweep(), r
                if is_rule:
                    state.rule(key, host, path, verdict)
                else:
                    out.append(state.judge(key, path))
            mine = b.filter(pc.invert(b.column("_rule")))
            yield with_columns(mine.select(own), host=mine.column("_host"), path=mine.column("_path"), rule=pa.array([o[0] for o in out], pa.string()),
                               verdict=pa.array([o[1] or default for o in out], pa.string()))

    left = map_batches(parsed, place_urls, schema_of(parsed) + "_range int, _key string, _rule boolean, _verdict string")
    named = rules.select(F.translate(F.col("host"), UPPER, LOWER).alias("_host"), F.coalesce("path", F.lit("")).alias("_path"),
                         F.col("verdict").alias("_verdict")).where("_host <> ''")
    right = map_batches(named, place_rules, "_range int, _key string, _rule boolean, _host string, _path string, _verdict string")
    both = left.unionByName(right, allowMissingColumns=True).repartition(ranges, "_range").sortWithinPartitions("_range", "_key", F.desc("_rule"))
    return map_batches(both, sweep, schema_of(kept) + "host string, path string, rule string, verdict string")

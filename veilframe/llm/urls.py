"""URL filters as a sort-merge range join (operator 8).

A rule is a host and a path; it fits its host and all subdomains, for paths that start with its own. A host's key has its labels
in reverse, each closed by a separator below all others, so all hosts that a rule covers form one interval of keys: those
that begin with the rule's. Rules and URLs are sorted by key together; a sweep keeps the stack of rule hosts whose interval is open,
which are nested, and looks for each URL's path on every level of it. The longest rule wins.

The order is cut into ranges at keys of a bounded sample of rows. Ranges are by key, path and a hash of the id, so a host, and
even a single URL, that a third of all rows have is dealt to many of them. A rule goes to all ranges that its interval meets. One
shuffle moves ids, hosts and paths; no suffix of a host is ever written out, and nothing is joined back.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.shared import lower_ascii, materialize, ship

POINT, RULE = 1, 0
SEPARATOR = "\x01"
#: Ranges for each shuffle partition, sampled rows for each range, characters of a key or path that a cut keeps.
RANGES, SAMPLED, CUT_CHARS = 4, 24, 200
#: Above all keys that begin alike.
LAST = "\U0010ffff"
OUT_ROWS = 10_000


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null or no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """The labels in reverse, each with a separator behind it."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), SEPARATOR), F.lit(SEPARATOR))


def sweep(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Of rows ``(range, key, kind, host, path, action, row)`` in order, each point's ``(row, host, path, rule host, rule path, action)``; None without a rule.

    The stack holds an entry for each rule host that contains the current key: its paths' actions, and the paths' lengths, the longest first.
    """
    stack: list[tuple[str, str, dict[str, str], list[int]]] = []
    now = None
    for place, key, kind, host, path, action, row in rows:
        if place != now:
            now, stack = place, []
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        if kind == RULE:
            if not stack or stack[-1][0] != key:
                stack.append((key, host, {}, []))
            _, _, actions, lengths = stack[-1]
            if path not in actions:
                actions[path] = action
                if len(path) not in lengths:
                    lengths.insert(bisect_left(lengths, -len(path), key=int.__neg__), len(path))
            continue
        best = None
        for _, rule_host, actions, lengths in stack:
            # a label may hold the separator, so the host itself decides
            if host != rule_host and not host.endswith("." + rule_host):
                continue
            for n in lengths:
                if n <= len(path) and path[:n] in actions:
                    rank = (len(rule_host) + n, len(rule_host))
                    if best is None or rank > best[0]:
                        best = rank, rule_host, path[:n], actions[path[:n]]
                    break
        yield row, host, path, *(best[1:] if best else (None, None, None))


def _cuts(points: DataFrame, ranges: int) -> list[tuple[str, str, int]]:
    """Where ranges begin, but the first one: evenly spaced rows of a sample by hash, whose size is bounded."""
    sample = points.select(F.substring("key", 1, CUT_CHARS).alias("key"), F.substring("path", 1, CUT_CHARS).alias("path"), "h").orderBy(F.xxhash64("h", "key", "path")).limit(SAMPLED * ranges).collect()
    found = sorted(map(tuple, sample))
    return sorted({found[i * len(found) // ranges] for i in range(1, ranges)}) if found else []


def match_urls(urls: DataFrame, rules: DataFrame, id_col: str, ranges: int | None = None) -> DataFrame:
    """``(id, host, path, rule_host, rule_path, action)`` for each row of ``urls(id, host, path)``, nulls where no rule fits.

    ``rules`` has host, path and action; of equal host and path the smallest action counts, without a host a rule is void, and without a path it
    fits all. Rules longer in host and path together win, of equal lengths the one with the longer host.
    """
    spark = urls.sparkSession
    ship(spark)
    own = rules.where("host is not null").groupBy(lower_ascii(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path")).agg(F.min("action").alias("action"))
    own = own.select(host_key(F.col("host")).alias("key"), "host", "path", "action")
    points = urls.select(host_key(F.col("host")).alias("key"), "host", "path", F.xxhash64(id_col).alias("h"), F.col(id_col).alias("row"))
    ranges = ranges or RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # at most SAMPLED * ranges rows of CUT_CHARS characters reach the driver, and fewer cuts the workers
    cuts = spark.sparkContext.broadcast(_cuts(points, ranges))
    columns = ["place", "key", "kind", "host", "path", "action", "row"]
    schema = f"place int, key string, kind int, host string, path string, action string, row {points.schema['row'].dataType.simpleString()}"

    def place_points(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["place"] = [bisect_right(cuts.value, p) for p in zip(pdf["key"], pdf["path"], pdf["h"], strict=True)]
            yield pdf.assign(kind=POINT, action=None)[columns]

    def place_rules(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, host, path, action in pdf.itertuples(index=False, name=None):
                first, last = bisect_right(cuts.value, (key, "", -(1 << 63))), bisect_right(cuts.value, (key + LAST, "", 0))
                yield pd.DataFrame({"place": range(first, last + 1), "key": key, "kind": RULE, "host": host, "path": path, "action": action, "row": None}, columns=columns)

    dealt = points.mapInPandas(place_points, schema).unionByName(materialize(own, "url-rules").mapInPandas(place_rules, schema))
    dealt = dealt.repartition("place").sortWithinPartitions("place", "key", "kind", "path")

    def swept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from veilframe.llm.urls import sweep as run

        out: list[tuple] = []
        names = ["row", "host", "path", "rule_host", "rule_path", "action"]
        for found in run(row for pdf in batches for row in pdf.astype({"row": "object"}).itertuples(index=False, name=None)):
            out.append(found)
            if len(out) == OUT_ROWS:
                yield pd.DataFrame(out, columns=names, dtype="object")
                out = []
        yield pd.DataFrame(out, columns=names, dtype="object")

    found = dealt.mapInPandas(swept, f"row {points.schema['row'].dataType.simpleString()}, host string, path string, rule_host string, rule_path string, action string")
    return found.withColumnRenamed("row", id_col)


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", id_col: str = "page_id", otherwise: str = "allow", ranges: int | None = None) -> DataFrame:
    """``(id, host, path, rule, verdict)``, a row for each row of ``pages``; without a rule the verdict is ``otherwise``.

    A null url, or one without ``://``, has an empty host and path, which a rule for the empty host alone fits. Repeated rows and null ids stay as they are. Very
    long hosts and paths are compared whole, though ranges are cut by their beginnings. Only id and url are read, so other columns may have any name; empty tables of
    pages or rules give no rows and no rules.
    """
    cut = pages.select(F.col(id_col), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    found = match_urls(cut, rules, id_col, ranges)
    return found.select(id_col, "host", "path", F.concat("rule_host", "rule_path").alias("rule"), F.coalesce("action", F.lit(otherwise)).alias("verdict"))

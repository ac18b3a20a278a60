"""URL filters as a temporal list join.

A list is a history: dated entries add a host, a domain or a URL prefix to it or remove it.
Entries become validity intervals (an addition holds until the next entry of the
same list and pattern), and an as-of join evaluates each capture against the intervals that
hold at its fetch time.  Captures are joined by equality on the keys they can
match: every suffix of the host, and the host with every leading part of the path.

A key's intervals travel as one sorted array (so the history of one key should fit a row), a capture meets each key once, and the join
deals hot keys (a host with a third of all captures) evenly.  Keys longer than the longest listed ones are not made.

Defined cases: a null or unparsable URL matches nothing; a host with a dot at its end is the host without it, and an address in
brackets is one name without suffixes; a capture without fetch time meets
no interval.  Of entries of one list, pattern and date, a removal comes last.  Removing
what is absent, or adding what is present, changes nothing.  Repeated captures are judged as often as
they come.  Null entries are skipped.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lookup, stored

_URL = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:\[\]]+|\[[^/?#\[\]]+\])(?::[0-9]*)?(?=[/?#]|$)([^?#]*)"


def host_of(url: str) -> str:
    """SQL for the host in lower case, without the dot that may end it; an address in brackets keeps them."""
    return f"nullif(regexp_replace(lower(regexp_extract({url}, r'{_URL}', 1)), '[.]$', ''), '')"


def match_keys(url: str, labels: int = 127, folders: int = 2048) -> str:
    """SQL for the keys a URL can match: 'host:' and each suffix of its host, 'path:' and the host with each leading part of its path.

    Suffixes of more than ``labels`` labels and parts of more than ``folders`` folders are left out.
    """
    name = f"coalesce({host_of(url)}, '')"
    host = f"if(startswith({name}, '['), array({name}), split({name}, '[.]'))"
    hosts = f"transform(sequence(greatest(1, size({host}) - {labels - 1}), size({host})), i -> concat('host:', array_join(slice({host}, i, size({host})), '.')))"
    path = f"split(regexp_replace(regexp_extract({url}, r'{_URL}', 2), '^/|/$', ''), '/')"
    paths = f"transform(slice(sequence(1, size({path})), 1, {folders}), i -> concat('path:', {host_of(url)}, '/', array_join(slice({path}, 1, i), '/')))"
    return f"if({host_of(url)} is null, array(), array_distinct(concat({hosts}, {paths})))"


def intervals(entries: DataFrame) -> DataFrame:
    """list, key, valid_from, valid_to (null: for good) of the entries (list, key, action, dated)."""
    known = entries.where("list is not null and key is not null and dated is not null and action in ('add', 'remove')")
    last = known.groupBy("list", "key", "dated").agg(F.min(F.col("action") == "add").alias("adds"))
    order = Window.partitionBy("list", "key").orderBy("dated")
    turns = last.withColumn("before", F.lag("adds", 1, False).over(order)).where("adds <> before")
    spans = turns.withColumn("valid_to", F.lead("dated").over(order)).where("adds")
    return spans.select("list", "key", F.col("dated").alias("valid_from"), "valid_to")


def judge_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per capture (capture_id, url, fetched): capture_id, fetched, host, n_matches, lists (sorted), blocked."""
    span = F.struct("valid_from", "valid_to", "list")
    per_key = stored(intervals(entries).groupBy("key").agg(F.sort_array(F.collect_list(span)).alias("spans")), "spans")
    # no key is made that is longer than those listed: a long path costs what the lists can match
    parts = F.when(F.col("key").startswith("path:"), F.size(F.split("key", "/")) - 1)
    most = per_key.agg(F.max(F.size(F.split("key", "[.]"))), F.max(parts)).first()
    keys = match_keys("url", max(most[0] or 1, 1), max(most[1] or 1, 1))
    asked = captures.select(F.monotonically_increasing_id().alias("row"), "capture_id", "url", "fetched")
    asked = stored(asked, "captures")
    keyed = asked.select("row", "fetched", F.expr(f"explode({keys})").alias("key"))
    rows = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    found = lookup(keyed, per_key.join(rows, "key"), ["key"], ["spans"], "rows", F.col("row"))
    holding = F.expr("filter(spans, s -> s.valid_from <= fetched and (s.valid_to is null or fetched < s.valid_to))")
    matched = found.where("spans is not null").select("row", F.explode(holding).alias("span")).groupBy("row").agg(F.count(F.lit(1)).alias("n_matches"), F.array_sort(F.collect_set("span.list")).alias("lists"))
    out = asked.join(matched, "row", "left")
    return out.select(
        "capture_id", "fetched", F.expr(host_of("url")).alias("host"),
        F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"),
        F.coalesce("lists", F.array().cast("array<string>")).alias("lists"),
        F.col("n_matches").isNotNull().alias("blocked"),
    )

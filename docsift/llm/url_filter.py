"""URL filters by a temporal list join, with DataFrame functions only.

A list is a history of dated entries: from its day on, an entry's action holds for its rule
until the rule's next entry. A rule is a host, which covers its subdomains, or a host and
leading path segments. Entries become validity intervals; an as-of join evaluates each capture
against the intervals that hold on the day it was fetched, and the longest rule decides. An entry
whose action is neither ``block`` nor ``allow`` ends the rule's last one and decides nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LIST_SCHEMA = "rule string, category string, action string, listed_on string"


def validity(entries: DataFrame) -> DataFrame:
    """(rule, category, action, valid_from, valid_to): when each entry of (rule, category, action, listed_on) holds.

    valid_to is the day of the rule's next entry, null for the last. Of entries of a rule on
    one day the last in order of action and category holds. Entries without rule or day are void.
    """
    day = entries.select(F.lower(F.trim("rule")).alias("rule"), "category", "action", F.col("listed_on").cast("date").alias("valid_from")).where("rule <> '' and valid_from is not null")
    day = day.groupBy("rule", "valid_from").agg(F.max(F.struct("action", "category")).alias("e"))
    after = Window.partitionBy("rule").orderBy("valid_from")
    return day.select("rule", "e.category", "e.action", "valid_from", F.lead("valid_from").over(after).alias("valid_to"))


def url_parts(url: F.Column) -> tuple[F.Column, F.Column]:
    """(host, path): lower-case host without user, port and last dot, empty if there is none; path without query and fragment."""
    host = F.regexp_extract(url, r"^[ ]*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    path = F.regexp_extract(url, r"^[^:/?#]*://[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.regexp_replace(F.lower(host), r"[.]+$", ""), F.lit("")), F.coalesce(path, F.lit(""))


def histories(entries: DataFrame) -> DataFrame:
    """(rule, labels, steps, history): one row a rule, with its intervals in order of time, the labels of its host and the steps of its path."""
    held = validity(entries).groupBy("rule").agg(F.sort_array(F.collect_list(F.struct("valid_from", "valid_to", "action", "category"))).alias("history"))
    parts = F.split("rule", "/")
    return held.withColumns({"labels": F.size(F.split(parts[0], "[.]")), "steps": F.size(parts) - 1})


def url_filter(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "fetched_on") -> DataFrame:
    """One row per row of ``captures``: id, host, fetched_on, blocked, rule, category, listed_on.

    The last three are those of the deciding entry, null where none holds; blocked is whether
    its action is ``block``. A null, empty or relative URL has an empty host and, like a capture
    without a day, meets no entry. Null ids and repeated rows are evaluated like others, very long
    URLs whole. Other columns are ignored. Without captures the result is empty, without entries
    nothing is blocked.

    A capture's keys are its host and the hosts above it, each with the leading steps of its path,
    of the lengths that rules have: a row tells these, and no other key is built, however many
    labels and steps a URL has. A key meets its rule in one row, and the as-of step finds the
    interval that holds among the rule's, so no history multiplies captures.
    """
    url = F.col(url_col).cast("string")
    host, path = url_parts(url)
    key = F.unhex(F.md5(F.coalesce(url, F.lit("")).cast("binary")))
    base = captures.select(F.col(id_col).alias("id"), key.alias("u"), F.col(day_col).cast("date").alias("day"), host.alias("host"), path.alias("path"))
    rules = histories(entries)
    # one row, of the distinct lengths of rules
    lengths = rules.agg(F.collect_set(F.struct("labels", "steps")).alias("lengths"))
    split = base.where("host <> '' and day is not null").select("id", "u", "day", F.split("host", "[.]").alias("labels"), F.expr("filter(split(path, '/'), s -> s <> '')").alias("steps"), F.col("host").rlike("^[0-9.]+$").alias("address"))
    # an address is no subdomain of its last numbers
    fits = "filter(lengths, x -> x.steps <= size(steps) and if(address, x.labels = size(labels), x.labels <= size(labels)))"
    keyed = split.crossJoin(F.broadcast(lengths)).select("id", "u", "day", "labels", "steps", F.explode(F.expr(fits)).alias("x"))
    key = "concat_ws('/', array_join(slice(labels, size(labels) - x.labels + 1, x.labels), '.'), if(x.steps > 0, array_join(slice(steps, 1, x.steps), '/'), null))"
    keyed = keyed.select("id", "u", "day", F.expr(key).alias("rule"))
    as_of = F.expr("try_element_at(filter(history, x -> x.valid_from <= day), -1)")
    met = keyed.join(rules.select("rule", "history"), "rule").select("id", "u", "day", "rule", as_of.alias("e")).where("e.action in ('block', 'allow')")
    best = met.groupBy("id", "u", "day").agg(F.max(F.struct(F.length("rule"), F.col("rule"), F.col("e.category").alias("category"), F.col("e.action").alias("action"), F.col("e.valid_from").alias("listed_on"))).alias("e"))
    out = base.alias("a").join(best.alias("b"), F.expr("a.id <=> b.id and a.u = b.u and a.day = b.day"), "left")
    return out.select(F.col("a.id").alias(id_col), "a.host", F.col("a.day").alias("fetched_on"), F.coalesce(F.col("e.action") == "block", F.lit(False)).alias("blocked"), F.col("e.rule").alias("rule"), F.col("e.category").alias("category"), F.col("e.listed_on").alias("listed_on"))

"""What goes into an index: pieces of clauses, entries of clauses and of changes, names of services."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_list, tokens
from .frames import slices
from .retrieval import LIST_PIECES

# Characters of a piece, of what is embedded, and of a change's text.
PIECE_CHARS, EMBED_CHARS, CHANGE_CHARS = 1500, 6000, 4000


def split_long(text: str, limit: int) -> list[str]:
    """Parts of at most ``limit`` characters, cut at line ends where there are any; a table's first line goes before each later part.

    Nothing is lost: a line that is too long is cut anywhere.
    """
    lines = text.split("\n")
    head = lines[0] if lines[0].startswith("|") and len(lines[0]) < limit // 2 else None
    parts, now = [], ""
    for line in lines:
        while True:
            room = limit - (len(now) + 1 if now else 0)
            if len(line) <= room:
                now = f"{now}\n{line}" if now else line
                break
            if now:
                parts.append(now)
                now = head if head is not None else ""
                if now and len(line) > limit - len(now) - 1:
                    now = ""
                continue
            parts.append(line[:limit])
            line = line[limit:]
    return [*parts, now] if now or not parts else parts


def pack_units(units: list[str], limit: int) -> list[str]:
    """Units joined by blank lines into pieces of at most ``limit`` characters; one that is too long is split and not joined."""
    out, now = [], ""
    for unit in units:
        if len(unit) > limit:
            out += [now] * bool(now) + split_long(unit, limit)
            now = ""
        elif now and len(now) + 2 + len(unit) <= limit:
            now = f"{now}\n\n{unit}"
        else:
            out += [now] * bool(now)
            now = unit
    return out + [now] * bool(now)


def pieces(clauses: DataFrame, key: str, units: str, limit: int = PIECE_CHARS) -> DataFrame:
    """key, piece (from 1), pieces and text of each clause (an array of its units' texts)."""
    kind = clauses.schema[key].dataType.simpleString()

    def pack(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames, "units", lambda units: sum(len(u or "") for u in units)):
            rows = []
            for k, own in zip(frame["key"], frame["units"]):
                found = pack_units([u or "" for u in own], limit)
                rows += [(k, n, len(found), t) for n, t in enumerate(found, 1)]
            yield pd.DataFrame(rows, columns=["key", "piece", "pieces", "text"])

    chosen = clauses.where(F.col(units).isNotNull()).select(F.col(key).alias("key"), F.col(units).alias("units"))
    return chosen.mapInPandas(pack, f"key {kind}, piece int, pieces int, text string").withColumnRenamed("key", key)


def entries(found: DataFrame, document: str, group: str, order: list[str], header: Column, text: str) -> DataFrame:
    """Index entries of pieces: id, embed (what an embedder takes), embed_hash (of the whole text), prev, next, vector (false from the fourth list piece of a document on)."""
    whole = F.concat(header, F.lit("\n"), F.col(text))
    walk = Window.partitionBy(document).orderBy(*order)
    rows = found.withColumn("id", F.concat_ws("::", group, F.col("piece").cast("string"))).withColumn("embed", F.substring(whole, 1, EMBED_CHARS))
    lists = F.sum(is_list(F.col(text)).cast("int")).over(walk.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    own = Window.partitionBy(group).orderBy("piece")
    return (
        rows.withColumn("embed_hash", F.substring(F.sha2(whole, 256), 1, 16))
        .withColumn("prev", F.lag("id").over(own))
        .withColumn("next", F.lead("id").over(own))
        .withColumn("vector", ~is_list(F.col(text)) | (lists <= LIST_PIECES))
    )


def change_entries(changes: DataFrame, path: str, clause: str, date: str, kind: str, order: str) -> DataFrame:
    """``changes``, initial ones left out, with id ``path::clause::date::kind`` (and ``#n`` where it comes again)."""
    name = F.concat_ws("::", F.col(path).cast("string"), F.col(clause).cast("string"), F.col(date).cast("string"), F.col(kind))
    rows = changes.where(F.col(kind) != "initial").withColumn("name", name)
    nth = F.row_number().over(Window.partitionBy("name").orderBy(order))
    return rows.withColumn("id", F.when(nth > 1, F.concat(F.col("name"), F.lit("#"), nth.cast("string"))).otherwise(F.col("name"))).drop("name")


def change_text(header: Column, old: Column, new: Column, limit: int = CHANGE_CHARS) -> Column:
    """What a change says: its header, the text before and the text after, each left out where null."""
    part = lambda label, text: F.when(text.isNotNull(), F.concat(F.lit(f"\n[{label}]\n"), text)).otherwise("")
    return F.substring(F.concat(header, part("before", old), part("after", new)), 1, limit)


def detect_services(queries: DataFrame, key: str, text: str, aliases: list[tuple[str, str]]) -> DataFrame:
    """``queries`` with services: those whose alias stands in the text, longer aliases first; characters count once.

    ``aliases`` is a small list of (alias, service). Aliases of the Latin alphabet are whole words.
    """
    ordered = []
    for alias, service in sorted(aliases, key=lambda a: (-len(a[0]), a[0])):
        edge = r"(?<![a-z0-9]){}(?![a-z0-9])" if alias.isascii() else "{}"
        ordered.append(F.struct(F.lit(edge.format(re.escape(alias.lower()))).alias("pattern"), F.lit(service).alias("service")))
    start = F.struct(F.lower(text).alias("rest"), F.array().cast("array<string>").alias("found"))

    def take(state: Column, alias: Column) -> Column:
        found = F.when(F.regexp_like(state["rest"], alias["pattern"]), F.array_append(state["found"], alias["service"])).otherwise(state["found"])
        return F.struct(F.regexp_replace(state["rest"], alias["pattern"], F.lit(" ")).alias("rest"), found.alias("found"))

    return queries.withColumn("services", F.array_distinct(F.aggregate(F.array(*ordered), start, take)["found"]))


def named_document(queries: DataFrame, key: str, text: str, titles: DataFrame, title_key: str, title: str) -> DataFrame:
    """The title that shares most terms with each query (the shorter, then the smaller key, of equal ones): key, title_key, shared."""
    asked = queries.select(key, F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))
    held = titles.select(title_key, F.length(title).alias("size"), F.explode(F.array_distinct(tokens(F.col(title)))).alias("term"))
    shared = asked.join(held, "term").groupBy(key, title_key).agg(F.count("*").alias("shared"), F.first("size").alias("size"))
    order = Window.partitionBy(key).orderBy(F.desc("shared"), "size", title_key)
    return shared.withColumn("n", F.row_number().over(order)).where("n = 1").select(key, title_key, "shared")

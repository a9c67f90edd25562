"""Benchmark decontamination as a prefix-filtered set join, with built-in expressions only.

Windows of a benchmark item are sets of word shingles.  Ordered by rarity in the documents,
the rarest shingle is the prefix that an occurrence can't lack: windows and documents are
joined on it alone.  The shingle's place in the window bounds the window's place in the
document, whose length bounds it again; the words there are then compared one by one.
"""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardloom.llm.textcols import lower_ascii
from hazardloom.session import write_and_read

WINDOW = 10
SHINGLE = 3
# Shingles of the benchmark looked for in one pass over the documents; a larger benchmark goes in several passes.
PASS_SHINGLES = 100_000
# Fixed value of the definition: what separates words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words in order; a null text has none."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), GAP), lambda w: w != "")


def _shingle(of: str, k: int, at: Column) -> Column:
    """Hash of the ``k`` words from ``at`` (from 0) of a column."""
    return F.xxhash64(*[F.get(of, at + j) for j in range(k)])


def _found(k: int, window: int, at: Column) -> Column:
    """A wanted shingle of ``w`` at a place, with the words a window around it can reach."""
    near_at = F.greatest(at - (window - 1), F.lit(0))
    return F.struct(
        F.lit(k).alias("k"),
        _shingle("w", k, at).alias("h"),
        at.alias("at"),
        near_at.alias("near_at"),
        F.slice(F.col("w"), near_at + 1, F.lit(2 * window + k)).alias("near"),
    )


def _positions(n: Column, k: int) -> Column:
    """0 .. n - k."""
    return F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))


def benchmark_windows(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """``win, n, items``: distinct windows with the items that have them, ids as strings."""
    items = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("item"), words(F.col(f"`{text_col}`")).alias("w"))
    items = items.where(F.size("w") > 0)
    short = F.size("w") < window
    starts = F.when(short, F.array(F.lit(0))).otherwise(_positions(F.size("w"), window))
    every = items.select("item", "w", F.explode(starts).alias("at"), F.least(F.size("w"), F.lit(window)).alias("n"))
    win = F.slice("w", F.col("at") + 1, F.col("n")).alias("win")
    return every.select("item", win, "n").groupBy("win", "n").agg(F.array_compact(F.collect_set("item")).alias("items"))


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``row, doc_id, n_words, n_hit, items`` of every document row.

    ``n_hit`` counts the words inside any occurrence of a window, ``items`` lists the items with
    one, sorted as strings.  Null and empty texts have no words; an item without words has no
    window, an item with a null id hits but isn't listed; repeated rows each come out (``row``
    tells them apart); other columns are not read.
    """
    windows = write_and_read(benchmark_windows(benchmark, window, item_col, item_text_col), "benchmark-windows")
    size = F.least(F.col("n"), F.lit(SHINGLE))
    in_window = windows.select("win", "n", "items", size.alias("k")).withColumn(
        "h", F.expr("null").cast("array<bigint>")
    )
    for k in range(1, SHINGLE + 1):
        each = F.transform(_positions(F.col("n"), k), partial(_shingle, "win", k))
        in_window = in_window.withColumn("h", F.when(F.col("k") == k, each).otherwise(F.col("h")))
    # The benchmark is the query set: its distinct shingles go to the documents in passes of a bounded size.
    shingles = in_window.select("k", F.explode("h").alias("h")).distinct()
    passes = max(1, math.ceil(shingles.count() / PASS_SHINGLES))
    found = None
    for part in range(passes):
        wanted: dict[int, list[int]] = {}
        for r in shingles.where(F.pmod("h", F.lit(passes)) == part).collect():
            wanted.setdefault(r["k"], []).append(r["h"])
        one = _candidates(docs, wanted, window, id_col, text_col, part)
        found = one if found is None else found.unionByName(one)
    # Row, words and candidates of every document; the texts are read no more.
    found = write_and_read(found, "contamination-candidates")
    rows = found.where("part = 0").select("row", "id", "n_words")
    candidates = found.select("row", "n_words", F.inline("candidates"))
    rarity = candidates.groupBy("k", "h").agg(F.count(F.lit(1)).alias("times"))
    places = in_window.select("win", "n", "items", "k", F.posexplode("h").alias("place", "h"))
    rarest = places.join(rarity, ["k", "h"], "left").groupBy("win", "n", "items", "k").agg(
        F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "place", "h")).alias("rare")
    )
    prefix = rarest.where("rare.times > 0").select("win", "n", "items", "k", "rare.h", "rare.place")
    prefix = write_and_read(prefix, "benchmark-prefixes")
    start = F.col("at") - F.col("place")
    inside = (start >= 0) & (start + F.col("n") <= F.col("n_words"))
    same = F.slice("near", start - F.col("near_at") + 1, F.col("n")) == F.col("win")
    # The bounds come first; slice() takes no start below one.
    met = candidates.join(prefix, ["k", "h"]).where(F.when(inside, same).otherwise(F.lit(False)))
    spans = F.collect_set(F.struct(start.alias("start"), F.col("n").alias("n"))).alias("spans")
    hits = met.groupBy("row").agg(spans, F.flatten(F.collect_set("items")).alias("items"))
    covered = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1)))
    hits = hits.select(
        "row",
        F.size(F.array_distinct(covered)).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct("items")).alias("items"),
    )
    return rows.join(hits, "row", "left").select(
        "row",
        F.col("id").alias(id_col),
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def _candidates(
    docs: DataFrame, wanted: dict[int, list[int]], window: int, id_col: str, text_col: str, part: int
) -> DataFrame:
    """Per row the places of wanted shingles, each with the words a window around it can reach."""
    held = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(f"`{id_col}`").alias("id"),
        words(F.col(f"`{text_col}`")).alias("w"),
    )
    # Bound to one name, because a column used twice would be computed twice.
    held = held.select("row", "id", F.explode(F.array("w")).alias("w"))
    n = F.size("w")
    lists = [F.array().cast("array<struct<k:int,h:bigint,at:int,near_at:int,near:array<string>>>")]
    for k, hashes in sorted(wanted.items()):
        among = ",".join(f"{h}L" if h > -(1 << 63) else "-9223372036854775808" for h in hashes)
        here = F.expr(
            f"filter({_positions_sql(k)}, at -> xxhash64({', '.join(f'get(w, at + {j})' for j in range(k))}) in ({among}))"
        )
        lists.append(F.transform(here, partial(_found, k, window)))
    return held.select(
        F.lit(part).alias("part"), "row", "id", n.alias("n_words"), F.concat(*lists).alias("candidates")
    )


def _positions_sql(k: int) -> str:
    return f"if(size(w) >= {k}, sequence(0, size(w) - {k}), cast(array() as array<int>))"


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The registered result of ``contamination``."""
    return found.select(
        id_col,
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS_SQL = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

ORACLE_SQL = f"""
with docs as (select row_number() over () as r, doc_id, {_WORDS_SQL} as w from documents),
items as (select cast(item_id as varchar) as item, {_WORDS_SQL} as w from benchmark),
wins as (
  select distinct item, case when len(w) < {WINDOW} then w else w[i : i + {WINDOW - 1}] end as win
  from (select item, w, unnest(generate_series(1, greatest(len(w) - {WINDOW - 1}, 1))) as i from items where len(w) > 0)
),
sizes as (select distinct len(win) as n from wins),
places as (select r, n, w, unnest(generate_series(1, len(w) - n + 1)) as i from docs, sizes where len(w) >= n),
met as (select r, i, n, item from places join wins on w[i : i + n - 1] = win),
hit as (select r, count(distinct p) as n_hit from (select r, unnest(generate_series(i, i + n - 1)) as p from met) group by r),
named as (
  select r, count(*) as n_items, string_agg(item, ',' order by item) as names
  from (select distinct r, item from met where item is not null) group by r
)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join hit using (r) left join named using (r)
"""

"""Benchmark decontamination by winnowing, in DataFrame functions only.

Of the 5-gram hashes of every 8 words in sequence the least is kept (its position
breaks ties), on documents and benchmark items alike.  A document and an item that share 8
words in sequence keep the same gram for them, so a join on kept grams misses no shared
window; each hit is extended to the whole window before it counts.  Items of fewer
than 8 words are one window, looked up by the hash of all their words.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import cut, without_keys

WINDOW = 8
GRAM = 5
#: Rows of distinct benchmark windows, five numbers each, up to which they are broadcast (some 80 bytes a row); beyond, both sides are shuffled.
BROADCAST_ROWS = 500_000
#: Bytes of item_ids, over all distinct sets of items, up to which these are broadcast.
BROADCAST_BYTES = 8 << 20
#: Items in which a document's windows must occur for it to count as contaminated.
MIN_ITEMS = 2

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SENTINEL = -1


def _words(text: str) -> Column:
    """Words of a text with A-Z in lower case; none for null."""
    whole = F.coalesce(F.col(text), F.lit(""))
    ascii_only = F.length(whole) == F.octet_length(whole)
    lower = F.when(ascii_only, F.lower(whole)).otherwise(F.translate(whole, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(lower, _SEPARATORS), "")


def _hash_at(hashes: str, start: Column, n: int) -> Column:
    """Hash of ``n`` words from ``start`` (from 0); the count is part of it."""
    return F.xxhash64(F.lit(n), *[F.get(F.col(hashes), start + i) for i in range(n)])


def _kept_grams(hashes: str, packed: str) -> Column:
    """Positions of the grams that winnowing keeps."""
    size, p = F.size(hashes), F.col(packed)

    def least(x: Column, j: Column) -> Column:
        return F.least(x, *[F.get(p, j + i) for i in range(1, WINDOW - GRAM + 1)])

    chosen = F.transform(F.slice(p, F.lit(1), size - WINDOW + 1), least)
    at = F.transform(F.array_distinct(chosen), lambda x: x.bitwiseAND(F.lit(0x7FFFFFFF)))
    return F.when(size >= WINDOW, at).otherwise(F.array().cast("array<bigint>"))


def _packed_grams(hashes: str) -> Column:
    """For each position its gram's high bits over the position itself."""
    h = F.col(hashes)

    def pack(w: Column, i: Column) -> Column:
        gram = F.xxhash64(w, *[F.get(h, i + k) for k in range(1, GRAM)])
        return F.shiftleft(F.shiftright(gram, 31), 31).bitwiseOR(i.cast("bigint"))

    return F.transform(h, pack)


def _plus(tag: Column):
    return lambda i: i + tag


def _prepared(rows: DataFrame, *keep: str) -> DataFrame:
    """``keep``, the hashes of each row's words and the packed grams."""
    hashed = rows.select(*keep, _words("text").alias("words"))
    hashed = hashed.select(*keep, F.transform("words", lambda w: F.xxhash64(w)).alias("wh"))
    return hashed.select(*keep, "wh", _packed_grams("wh").alias("packed"))


def _benchmark_grams(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gram, offset, n, window, set_id): each distinct window under its kept gram; and (set_id, items): the items that hold it.

    Both are written.  The item_ids of a window are one array, as they are in a result that hits it.
    """
    items = _prepared(benchmark.select(F.col("item_id").cast("string").alias("item"), "text"), "item").where(F.size("wh") > 0)
    size = F.size("wh")
    starts = F.when(size >= WINDOW, F.sequence(F.lit(0), size - WINDOW)).otherwise(F.array(F.lit(0)))
    windows = items.select("item", "wh", "packed", F.least(size, F.lit(WINDOW)).alias("n"), F.explode(starts).alias("j"))
    kept = F.least(*[F.get("packed", F.col("j") + i) for i in range(WINDOW - GRAM + 1)]).bitwiseAND(F.lit(0x7FFFFFFF))
    shorts = {n: _hash_at("wh", F.lit(0), n) for n in range(1, WINDOW)}
    by_size = F.lit(None).cast("bigint")
    for n, h in shorts.items():
        by_size = F.when(F.col("n") == n, h).otherwise(by_size)
    full = F.col("n") == WINDOW
    rows = windows.select(
        "item",
        "n",
        F.when(full, _hash_at("wh", kept, GRAM)).otherwise(by_size).alias("gram"),
        F.when(full, kept - F.col("j")).otherwise(F.lit(0)).alias("offset"),
        F.when(full, _hash_at("wh", F.col("j"), WINDOW)).otherwise(by_size).alias("window"),
    )
    grouped = rows.groupBy("gram", "offset", "n", "window").agg(F.sort_array(F.collect_set("item")).alias("items"))
    # some 256 windows an item
    most = 256 * benchmark.count()
    grouped = cut(grouped.withColumn("set_id", F.xxhash64("items")), most)
    return grouped.drop("items"), cut(grouped.groupBy("set_id").agg(F.first("items").alias("items")), most)


def shared_windows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, n_words, spans (array of start, n) and items (array).

    ``spans`` are the document's windows that occur in the benchmark, in words from 0; ``items`` the
    item_ids, as strings in order, with such windows.  Null or empty texts have no words.  A null
    item_id's text is searched for, but it is not listed.  Repeated rows come out as often as
    they went in, null doc_ids stay, an empty table on either side gives no hits, and columns
    beside the ids and texts are not read.
    """
    right, sets = _benchmark_grams(benchmark)
    short = sorted(r["n"] for r in right.where(F.col("n") < WINDOW).select("n").distinct().collect())
    small = right.count() <= BROADCAST_ROWS

    left = _prepared(docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text"), "doc_id", "text_key")
    size = F.size("wh")
    # a lookup is its position, with the words it hashes (none: a kept gram) in the high bits
    lookups = [F.array(F.lit(_SENTINEL).cast("bigint")), _kept_grams("wh", "packed")]
    for n in short:
        tag = F.lit(n << 40)
        every = F.transform(F.sequence(F.lit(0).cast("bigint"), (size - n).cast("bigint")), _plus(tag))
        lookups.append(F.when(size >= n, every).otherwise(F.array().cast("array<bigint>")))
    rows = left.select("doc_id", "text_key", "wh", F.size("wh").alias("n_words"), F.explode(F.concat(*lookups)).alias("at"))
    whole = F.col("at") == _SENTINEL
    p = F.when(whole, F.lit(0)).otherwise(F.col("at").bitwiseAND(F.lit((1 << 31) - 1)).cast("int"))
    rows = rows.select("doc_id", "text_key", "wh", "n_words", whole.alias("whole"), F.shiftright("at", 40).alias("kind"), p.alias("p"))
    gram = F.when(F.col("whole"), F.xxhash64(F.lit(_SENTINEL), "doc_id", "text_key"))
    for n in short:
        gram = gram.when(F.col("kind") == n, _hash_at("wh", F.col("p"), n))
    rows = rows.withColumn("gram", gram.otherwise(_hash_at("wh", F.col("p"), GRAM)))
    start = F.col("p") - F.col("offset")

    def whole_window(j: Column) -> Column:
        inside = (j >= 0) & (j + WINDOW <= F.col("n_words"))
        return F.when(inside, _hash_at("wh", j, WINDOW))

    if small:
        right = F.broadcast(right)
        found = whole_window(start)
    else:
        # the words stay behind: a row carries the hashes of the windows its gram may stand for
        spread = F.array(*[whole_window(F.col("p") - o) for o in range(WINDOW - GRAM + 1)])
        rows = rows.withColumn("around", spread).drop("wh")
        found = F.get("around", F.col("offset").cast("int"))
    joined = rows.join(right.withColumnRenamed("gram", "__gram"), F.col("gram") == F.col("__gram"), "left")
    # a lookup of all words of a short window is a hit as it stands
    same = (F.col("kind") == F.when(F.col("n") < WINDOW, F.col("n")).otherwise(0)) & ((F.col("n") < WINDOW) | (found == F.col("window")))
    hit = F.when(~F.col("whole") & same, F.struct(start.cast("int").alias("start"), F.col("n").cast("int").alias("n")))
    joined = joined.select("doc_id", "text_key", "n_words", "whole", hit.alias("hit"), "set_id").where(F.col("whole") | F.col("hit").isNotNull())
    keys = ["doc_id", "text_key", "n_words"]
    per_doc = joined.groupBy(*keys).agg(
        F.sum(F.col("whole").cast("int")).alias("rows"),
        F.collect_set("hit").alias("hits"),
        F.collect_set(F.when(F.col("hit").isNotNull(), F.col("set_id"))).alias("sets"),
    )
    if (sets.agg(F.sum(F.octet_length(F.array_join("items", ",")) + 16)).first()[0] or 0) <= BROADCAST_BYTES:
        # joined and grouped again where the rows are
        wide = per_doc.select(*keys, "rows", "hits", F.explode_outer("sets").alias("set_id")).join(F.broadcast(sets), "set_id", "left")
        found = wide.groupBy(*keys).agg(F.first("rows").alias("rows"), F.first("hits").alias("hits"), F.collect_set("items").alias("items"))
    else:
        per_doc = cut(per_doc)
        hit_docs = per_doc.where(F.size("sets") > 0).select(*keys, F.explode("sets").alias("set_id")).join(sets, "set_id")
        listed = hit_docs.groupBy(*keys).agg(F.collect_set("items").alias("items"))
        same = [F.col(f"d.{k}").eqNullSafe(F.col(f"i.{k}")) for k in keys]
        found = per_doc.alias("d").join(listed.alias("i"), same, "left").select("d.*", F.coalesce("i.items", F.array().cast("array<array<string>>")).alias("items"))
    return found.select(
        F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int"))).alias("copy"),
        "doc_id",
        "text_key",
        F.col("n_words").cast("bigint").alias("n_words"),
        F.sort_array("hits").alias("spans"),
        F.sort_array(F.array_distinct(F.flatten("items"))).alias("items"),
    ).drop("copy")


def _covered(spans: str) -> Column:
    """Words that sorted spans cover."""
    zero = F.struct(F.lit(0).cast("bigint").alias("words"), F.lit(0).cast("bigint").alias("end"))

    def add(acc: Column, s: Column) -> Column:
        end = s["start"].cast("bigint") + s["n"]
        fresh = F.greatest(F.lit(0).cast("bigint"), end - F.greatest(s["start"].cast("bigint"), acc["end"]))
        return F.struct((acc["words"] + fresh).alias("words"), F.greatest(acc["end"], end).alias("end"))

    return F.aggregate(spans, zero, add, lambda acc: acc["words"])


def contamination(docs: DataFrame, benchmark: DataFrame, min_items: int = MIN_ITEMS) -> DataFrame:
    """doc_id, text_key, n_words, n_hit, items and contaminated of every row; see ``shared_windows``."""
    return shared_windows(docs, benchmark).select(
        "doc_id", "text_key", "n_words", _covered("spans").alias("n_hit"), "items", (F.size("items") >= min_items).alias("contaminated")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_items: int = MIN_ITEMS) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    found = contamination(docs, benchmark, min_items).where("contaminated")
    return without_keys(docs, cut(found.select("doc_id", "text_key").distinct()))

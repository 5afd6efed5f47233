"""Equal-size shards by histogram sort: probe, count, refine, then exchange once.

Documents are ordered by (hash of the text, hash of the id), so equal texts are
neighbours.  Each round counts the exact bytes and rows between candidate key
boundaries over all partitions and narrows the interval around every splitter
that is not good enough yet; a round returns at most shards x probes numbers.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairband.llm.common import running, upper_63, written

LAST_KEY = (1 << 63) - 1  # both key parts are in [0, 2^63)
CELLS_TEXT, CELLS_ID = 12, 8  # bits; cells of the slot numbers


@dataclass(frozen=True)
class Splitter:
    """Rows before it have a text hash below ``text``, or that one and an id hash below ``id``."""

    text: int
    id: int = 0

    def before(self) -> Column:
        t, i = F.col("text_hash"), F.col("id_hash")
        return (t < self.text) | ((t == self.text) & (i < self.id))


def sharding_keys(docs: DataFrame, id_col: str, text_col: str, *others: str) -> DataFrame:
    """Slim rows ``(id, size, text_crc32, text_hash, id_hash)``; a null text has no bytes, and every row counts 1 more."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"), upper_63(F.xxhash64(text)).alias("text_hash"),
                       upper_63(F.xxhash64(F.col(id_col), F.lit("shard"))).alias("id_hash"), *others)


def _numbered(keys: DataFrame, splitters: list[Splitter]) -> DataFrame:
    """Rows with their ``shard`` and ``slot``."""
    shard = reduce(lambda a, s: a + F.when(s.before(), 0).otherwise(1), splitters, F.lit(0))
    placed = (keys.withColumn("shard", shard.cast("int")).withColumn("one", F.lit(1).cast("long"))
              .withColumn("cell_text", F.shiftright("text_hash", 63 - CELLS_TEXT))
              .withColumn("cell_id", F.shiftright("id_hash", 63 - CELLS_ID)))
    return running(placed, "one", ["shard"], ["cell_text", "cell_id"], ["text_hash", "id_hash", "id", "size"], "slot").withColumn("slot", F.col("slot") - 1)


@dataclass
class _Search:
    """A closed interval of keys around one wanted cumulative size."""

    goal: int
    low: int = 0
    high: int = LAST_KEY
    below: int = 0  # exact bytes before ``low``
    text: int | None = None  # set: the interval is over id hashes of this one text hash
    found: Splitter | None = None

    def at(self, key: int) -> Splitter:
        return Splitter(key) if self.text is None else Splitter(self.text, key)


def _counts(keys: DataFrame, searches: list[_Search], probes: int) -> dict[int, list]:
    """Exact (bytes, rows, smallest and largest key) between neighbouring probes, for every open search."""
    spans = list(dict.fromkeys((s.text, s.low, s.high) for s in searches))
    probed = []
    for n, (text, low, high) in enumerate(spans):
        key = F.col("text_hash" if text is None else "id_hash")
        inside = key.between(low, high)
        if text is not None:
            inside = inside & (F.col("text_hash") == text)
        step = (high - low) // probes + 1
        probed.append(F.when(inside, F.struct(F.lit(n).alias("span"), F.floor((key - low) / F.lit(step)).cast("int").alias("probe"),
                                              key.alias("key"))))
    one = keys.select("size", F.explode(F.array(*probed)).alias("p")).filter("p IS NOT NULL")
    got = (one.groupBy("p.span", "p.probe")
           .agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min("p.key").alias("first"), F.max("p.key").alias("last"))
           .orderBy("span", "probe").collect())
    found: dict[tuple, list] = {span: [] for span in spans}
    for r in got:
        found[spans[r["span"]]].append(r)
    return {id(s): found[(s.text, s.low, s.high)] for s in searches}


def _narrow(search: _Search, counts: list, tolerance: float, group_tolerance: float) -> None:
    """Settle the splitter if a counted boundary is close enough, else keep the interval that holds the goal."""
    below = search.below
    for r in counts:
        if below + r["bytes"] < search.goal:
            below += r["bytes"]
            continue
        short, over = search.goal - below, below + r["bytes"] - search.goal
        single = r["first"] == r["last"]
        near = search.at(r["first"]) if short <= over else search.at(min(r["last"] + 1, LAST_KEY))
        allowed = group_tolerance if single and search.text is None else tolerance
        if min(short, over) <= allowed or r["rows"] == 1 or (single and search.text is not None):
            search.found = near
        elif single:  # one text fills more than the tolerance: cut among its ids
            search.text, search.low, search.high, search.below = r["first"], 0, LAST_KEY, below
        else:
            search.low, search.high, search.below = r["first"], r["last"], below
        return
    search.found = search.at(search.high)


def find_splitters(keys: DataFrame, shards: int, tolerance: float = 0.001, group_tolerance: float = 0.01,
                   probes: int = 4096) -> list[Splitter]:
    """``shards - 1`` boundaries with near equal bytes between them.

    A boundary is off by ``tolerance`` of a shard at most, or by half of the one row
    that straddles it.  A group of equal texts is cut only if keeping it whole
    would miss by more than ``group_tolerance`` of a shard.
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    searches = [_Search(goal=total * (i + 1) // shards) for i in range(shards - 1)]
    share = total / shards
    while open_ := [s for s in searches if s.found is None]:
        counts = _counts(keys, open_, probes)
        for s in open_:
            _narrow(s, counts[id(s)], tolerance * share, group_tolerance * share)
    return [s.found for s in searches]


def assign_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text",
                  tolerance: float = 0.001) -> DataFrame:
    """Shard and slot of every row under the law of near equal bytes.

    Returns ``id_col``, ``size`` (UTF-8 bytes of the text plus 1; null: 1),
    ``text_crc32``, ``shard`` and ``slot`` (gapless from 0 in each shard).  Other
    input columns are not read.  Equal texts share a shard where sizes allow;
    repeated rows get slots of their own; null ids hash like a value; an empty
    table gives an empty result.  The order is by hash, so reruns agree.
    """
    keys = written(sharding_keys(docs, id_col, text_col), "shard-keys")
    numbered = _numbered(keys, find_splitters(keys, shards, tolerance))
    return numbered.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.001) -> None:
    """Write whole rows as Parquet, one folder per shard, rows in slot order.

    A row's shard follows from its own text and id, so rows with null or repeated ids and
    rows that repeat others are written each once.  Columns ``shard`` and ``slot`` of the input are replaced, others
    may have any name; null and very long texts are written as they are; an empty table writes no shard.
    """
    whole = docs.drop("shard", "slot").select(F.struct("*").alias("row"))
    splitters = find_splitters(written(sharding_keys(docs, id_col, text_col), "shard-keys"), shards, tolerance)
    rows = _numbered(sharding_keys(whole, f"row.{id_col}", f"row.{text_col}", "row"), splitters).select("row.*", "shard", "slot")
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)

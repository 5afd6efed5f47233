"""Mixing sources to target weights by weighted fair queueing.

The documents of a source queue up in a shuffled order, twice (a source may be
repeated once).  Each copy gets a virtual finish time: the source's words up to
and with it, divided by the source's target.  All copies are then ranged over
cells of finish time, summed in that order, and cut off at the total budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairband.llm.common import aside, running, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5  # of all words
REPEATS = 2  # copies of a document, and so the cap of a target
TIME_CELLS = 16384


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
                   cap: int = REPEATS) -> DataFrame:
    """One row per source: ``source``, ``rank``, ``weight``, ``source_size``, ``target``.

    Sources in code point order, null last, take the weights in turn.  A source
    stops at ``cap`` times its size; what it leaves goes to the others by weight.
    In order of size per weight the sources that stop come first, so the level at
    which the rest shares follows from running sums.  One small row per source.
    """
    in_order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by_need = Window.orderBy((F.col("room") / F.col("weight")), "rank").rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.partitionBy()
    sources = (sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
               .withColumn("rank", F.row_number().over(in_order) - 1)
               .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights)) + 1))
               .withColumn("room", F.col("source_size") * cap))
    level = ((F.sum("source_size").over(everywhere) * share - F.coalesce(F.sum("room").over(by_need), F.lit(0)))
             / (F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(by_need), F.lit(0))))
    levels = sources.withColumn("level", level).withColumn(
        "shared", F.min(F.when(F.col("room") >= F.col("level") * F.col("weight"), F.struct(F.col("room") / F.col("weight"), "rank", "level")))
        .over(everywhere)["level"])
    return levels.select("source", "rank", "weight", "source_size",
                         F.coalesce(F.least(F.col("room").cast("double"), F.col("shared") * F.col("weight")),
                                    F.col("room").cast("double")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, seed: str = "mix") -> DataFrame:
    """What a mix of ``share`` times all words takes of every document.

    Returns one row per input row: ``id_col``, ``size`` (words; null text: 0),
    ``source_size``, ``target`` (words wanted of its source) and ``taken`` (words the
    mix takes: 0, 1 or 2 times the size).  Other input columns are not read.  A null
    source is a source of its own; documents without words and sources without
    words take nothing; repeated rows queue one after the other; an empty table
    gives an empty result.  The order depends on id and seed alone, so reruns agree.
    """
    sized = written(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"))
                    .withColumn("lot", F.md5(F.concat_ws(":", F.lit(seed), F.col("id").cast("string")))), "mix-sizes")
    targets = written(source_targets(sized, weights, share), "mix-targets")
    same = F.col("source").eqNullSafe(F.col("_source"))
    queued = (sized.join(targets.drop("weight").withColumnRenamed("source", "_source"), same).drop("_source", "source")
              .withColumn("lot_cell", F.conv(F.substring("lot", 1, 3), 16, 10).cast("int")))
    queued = running(queued, "size", ["rank"], ["lot_cell"], ["lot", "id", "size"], "words_to")
    copies = (queued.filter("size > 0").withColumn("copy", F.explode(F.array(*map(F.lit, range(REPEATS)))))
              .withColumn("finish", (F.col("words_to") + F.col("copy") * F.col("source_size")) / F.col("target"))
              .withColumn("cell", F.floor(F.col("finish") / (F.col("finish") + 1) * TIME_CELLS).cast("int"))
              .select("id", "rank", "lot", "size", "words_to", "finish", "cell"))
    budget = targets.agg(F.sum("target")).first()[0] or 0.0
    taken = (running(copies, "size", [], ["cell"], ["finish", "lot", "rank", "words_to"], "mixed")
             .filter(F.col("mixed") <= budget)
             .groupBy("rank", "words_to").agg(F.sum("size").alias("taken")))
    # a source's running count names each of its documents that has words
    return (queued.withColumn("place", F.when(F.col("size") > 0, F.col("words_to")))
            .join(taken.withColumnsRenamed({"rank": "_rank", "words_to": "_place"}),
                  (F.col("rank") == F.col("_rank")) & (F.col("place") == F.col("_place")), "left")
            .select(F.col("id").alias(id_col), "size", "source_size", "target",
                    F.coalesce("taken", F.lit(0)).cast("long").alias("taken")))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of the mix with all their columns: a document taken twice is there twice.

    Rows that repeat an id are as often in the mix as the one of them taken most often;
    a null id is an id; texts without words are not taken; an empty table stays empty; extra columns may have any name.
    """
    docs, back = aside(docs, "__mix_id", "__copies")
    copies = written(mix(docs, id_col, text_col, source_col, **options).filter("taken > 0")
                     .groupBy(F.col(id_col).alias("__mix_id")).agg(F.max(F.col("taken") / F.col("size")).cast("int").alias("__copies")), "mix-copies")
    return back(docs.join(copies.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col("__mix_id")))
                .withColumn("__copies", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(docs.columns))


QUERY_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || doc_id) AS lot
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, [3, 1, 2][(rank % 3 + 1)::INT] AS weight, 2 * source_size AS room FROM sources
), levels AS (
  SELECT *, ((sum(source_size) OVER ()) * 1.5::DOUBLE
             - coalesce(sum(room) OVER (ORDER BY room / weight::DOUBLE, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER (ORDER BY room / weight::DOUBLE, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            AS level
  FROM weighed
), targets AS (
  SELECT source, rank, source_size,
         least(room::DOUBLE, weight * (SELECT arg_min(level, {'a': room / weight::DOUBLE, 'b': rank}) FROM levels WHERE room >= level * weight)) AS target
  FROM levels
), queued AS (
  SELECT doc_id, rank, lot, size, source_size, target,
         sum(size) OVER (PARTITION BY rank ORDER BY lot, doc_id, size ROWS UNBOUNDED PRECEDING) AS words_to
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
), copies AS (
  SELECT doc_id, size, lot, rank, words_to, (words_to + copy * source_size)::DOUBLE / target AS finish
  FROM queued, (VALUES (0), (1)) AS c(copy) WHERE size > 0
), mixed AS (
  SELECT *, sum(size) OVER (ORDER BY finish, lot, rank, words_to ROWS UNBOUNDED PRECEDING) AS mixed FROM copies
), taken AS (
  SELECT rank, words_to, sum(size) AS taken FROM mixed
  WHERE mixed <= (SELECT sum(target) FROM targets) GROUP BY ALL
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken
FROM queued LEFT JOIN taken ON queued.rank = taken.rank AND queued.words_to = taken.words_to AND size > 0
"""

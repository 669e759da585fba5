"""Mixing sources to target weights by systematic sampling.

A source's documents are laid out in one fixed order; each is expected ``target / source size`` times, these
expectations are prefix-summed, one offset per source is added, and a document is emitted once for every integer
boundary its interval crosses. The order goes from small to large texts (in half octaves of the word count), so the words
taken stay close to the target. The prefix sum is distributed: counts of (source, size class, salt) cells are summed
first, and rows are only numbered inside a cell. The number of salts grows with the rows (``CELL_ROWS`` of them for each
salt beyond the first ``N_SALTS``), so a hot source is spread over as many cells as it needs.

Defined results: a NULL text has size 0 and takes no words; a NULL source is a source of its own and comes last; equal
rows are drawn as rows of their own; sources whose texts are all empty keep each document once; an empty table gives no
rows; columns of the caller are kept unless an output has their name, and the working columns avoid their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, temp_name, word_count

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
N_SALTS = 16
CELL_ROWS = 1 << 18
SEED = 17


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """Targets of the sources in ``sizes`` (no_src, src, source_size: one row per source).

    Resharing the excess over the caps until none is left ends at one water level: a source gets the smaller of its cap
    and level * weight. In order of cap per weight, the level is the largest of (words not yet given) / (weight not yet
    served). The windows run over one row per source.
    """
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("no_src", "src")) - 1) % len(weights) + 1)
    caps = sizes.withColumn("weight", w).withColumn("cap", F.lit(max_epochs) * F.col("source_size"))
    line = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), "no_src", "src")
    whole = Window.partitionBy(F.lit(0))
    given = F.coalesce(F.sum("cap").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    unserved = F.sum("weight").over(line.rowsBetween(0, Window.unboundedFollowing))
    levels = caps.withColumn("level", (F.sum("source_size").over(whole) - given) / unserved)
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.max("level").over(whole))
    shift = F.conv(F.substring(F.md5(F.concat(F.when(F.col("no_src"), "?").otherwise(F.concat(F.lit("="), "src")), F.lit(f"#{seed}"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return levels.select("no_src", "src", "source_size", target.alias("target"), shift.alias("shift"))


def size_class(size: Column) -> Column:
    """Half octaves: twice the bit length, plus the bit after the leading one."""
    bits = F.length(F.bin(size))
    return (bits * 2 + F.when(size >= 2, F.substring(F.bin(size), 2, 1).cast("int")).otherwise(0)).cast("int")


def mix(df: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, n_salts: int | None = None, seed: int = SEED, prefix: str = "") -> DataFrame:
    """The caller's rows with ``size``, ``source_size``, ``target`` and ``copies`` (how often the mix emits the row), after a prefix."""
    no_src, src, cls, salt, size, tie, base, part, shift, whole, goal, rank = temp_name(df, "no_src", "src", "cls", "salt", "size", "tie", "base", "share", "shift", "whole", "goal", "rank")
    times = max(1, -(-df.count() // (N_SALTS * CELL_ROWS))) if n_salts is None else 1  # a count reads no column
    first = n_salts or N_SALTS
    key = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("?"), F.xxhash64(text).cast("string"))))
    digits = lambda a, n: F.conv(F.substring(key, a, n), 16, 10).cast("long")
    salted = (digits(1, 4) % first) * times + digits(5, 12) % times
    rows = df.withColumns({no_src: F.col(source).isNull(), src: F.coalesce(F.col(source), F.lit("")), size: word_count(F.col(text))}).withColumns({cls: F.coalesce(size_class(F.col(size)), F.lit(0)), salt: F.coalesce(salted, F.lit(0)), tie: F.xxhash64(text)})  # never NULL, or joins would test that by counting the words again
    cells = rows.groupBy(F.col(no_src).alias("no_src"), F.col(src).alias("src"), F.col(cls).alias("cls"), F.col(salt).alias("salt")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("words"))
    cells = cut(cells)  # some hundred rows a source and a row for each CELL_ROWS, read four times below
    classes = cells.groupBy("no_src", "src", "cls").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    targets = source_targets(classes.groupBy("no_src", "src").agg(F.sum("words").alias("source_size")), weights, max_epochs, seed)
    before = (Window.unboundedPreceding, -1)
    sum_n = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(*before)), F.lit(0))
    class_base = classes.select("no_src", "src", "cls", sum_n(Window.partitionBy("no_src", "src").orderBy("cls")).alias("class_base"))
    cell_base = cells.select("no_src", "src", "cls", "salt", sum_n(Window.partitionBy("no_src", "src", "cls").orderBy("salt")).alias("cell_base"))
    plan = cell_base.join(class_base, ["no_src", "src", "cls"]).join(targets, ["no_src", "src"])
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    plan = plan.select(F.col("no_src").alias(no_src), F.col("src").alias(src), F.col("cls").alias(cls), F.col("salt").alias(salt), (F.col("class_base") + F.col("cell_base")).alias(base), share.alias(part), F.col("shift").alias(shift), F.col("source_size").alias(whole), F.col("target").alias(goal))
    place = F.row_number().over(Window.partitionBy(no_src, src, cls, salt).orderBy(F.col(doc_id).asc_nulls_last(), tie))
    drawn = rows.withColumn(rank, place).join(plan, [no_src, src, cls, salt])
    upto = lambda k: F.floor((F.col(base) + F.col(rank) - k) * F.col(part) + F.col(shift))
    made = {"size": F.col(size), "source_size": F.col(whole), "target": F.col(goal), "copies": (upto(0) - upto(1)).cast("long")}
    keep = [F.col(c) for c in df.columns if c.lower() not in {f"{prefix}{n}".lower() for n in made}]
    return drawn.select(*keep, *[value.alias(f"{prefix}{n}") for n, value in made.items()])


def emit(mixed: DataFrame, copies: str = "copies") -> DataFrame:
    """The mix itself: each row as often as it was drawn."""
    (copy,) = temp_name(mixed, "copy")
    return mixed.where(F.col(copies) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).drop(copy)

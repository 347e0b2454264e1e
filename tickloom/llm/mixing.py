"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source is one shuffled stream of words (its documents in a fixed random order, read again from
the start when it ends), cut into blocks of ``block_words``. A schedule of slots maps van der Corput
points through the cumulative target shares to sources; the k-th slot of a source takes block k of
its stream. Any prefix of the schedule holds the sources close to their shares.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import WORD, word_count, written

BLOCK_WORDS = 256
#: Rows that one task ranks or sums at a time.
GROUP_ROWS = 1024
#: Bits of a van der Corput point.
POINT_BITS = 48


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """Target words per source: ``least(epochs * size, level * weight)`` that add up to ``share`` of all words.

    ``sizes``: source, source_size. Weights repeat along the sources by code point, null last. What
    a full source cannot take goes to the others by weight, which is the level where all of it fits.
    One row per source passes through one task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.select("source", "source_size", (F.row_number().over(by_name) - 1).alias("source_no"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    capped = ranked.withColumns({"weight": weight, "cap": F.col("source_size") * float(epochs)})
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    before, after = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    levels = capped.withColumns({
        "room": F.sum("source_size").over(everything) * float(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "open": F.sum("weight").over(after),
    })
    # with the k sources that fill first at their caps, the rest would stand at room / open; the true k has the highest
    level = F.max(F.col("room") / F.col("open")).over(everything)
    return levels.withColumn("target", F.least("cap", level * F.col("weight"))).select(
        "source", "source_no", "source_size", "target"
    )


def van_der_corput(number):
    """Bits of ``number`` mirrored at the binary point: a value in [0, 1)."""
    mirrored = F.conv(F.reverse(F.lpad(F.bin(number), POINT_BITS, "0")), 2, 10)
    return mirrored.cast("double") / float(2**POINT_BITS)


def schedule(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows slot, source_no, block, words: the blocks to read, in order of slot.

    A source gets exactly the blocks its target needs, the last one cut: slots beyond them are left
    out, and the few that the points have not reached follow at the end. Ranking goes in two steps,
    inside runs of slots and over runs, so that a dominant source is not ranked in one task.
    """
    spark = targets.sparkSession
    needs = targets.withColumn("words", F.floor("target").cast("long")).where("words > 0").withColumn(
        "blocks", F.ceil(F.col("words") / block_words).cast("long")
    )
    total = needs.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    shares = Window.orderBy("source_no")
    ranges = needs.withColumn("upto", F.sum("words").over(shares) / F.sum("words").over(Window.partitionBy()))
    ranges = ranges.withColumn("from", F.coalesce(F.lag("upto").over(shares), F.lit(0.0)))
    # cells of equal width: a point finds its few candidate sources by its cell, without comparing it to all
    cells = 1024
    low, high = F.floor(F.col("from") * cells).cast("int"), F.least(F.floor(F.col("upto") * cells), F.lit(cells - 1)).cast("int")
    by_cell = ranges.select("source_no", "from", "upto", F.explode(F.sequence(low, high)).alias("cell"))
    slots = spark.range(total).select(F.col("id").alias("slot"), van_der_corput("id").alias("point"))
    slots = slots.withColumn("cell", F.floor(F.col("point") * cells).cast("int"))
    placed = slots.join(by_cell, "cell").where("point >= from AND point < upto").select(
        "slot", "source_no", F.floor(F.col("slot") / GROUP_ROWS).alias("run")
    )
    runs = placed.groupBy("source_no", "run").count()
    over_runs = Window.partitionBy("source_no").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select("source_no", "run", F.coalesce(F.sum("count").over(over_runs), F.lit(0)).alias("start"))
    in_run = Window.partitionBy("source_no", "run").orderBy("slot")
    ranked = placed.withColumn("nth", F.row_number().over(in_run) - 1).join(starts, ["source_no", "run"])
    taken = ranked.select("slot", "source_no", (F.col("start") + F.col("nth")).alias("block"))
    reached = runs.groupBy("source_no").agg(F.sum("count").alias("reached"))
    missing = needs.join(reached, "source_no", "left").withColumn("reached", F.coalesce("reached", F.lit(0))).where("reached < blocks")
    rest = missing.select((F.lit(total) + F.col("source_no")).alias("slot"), "source_no", F.explode(F.sequence(F.col("reached"), F.col("blocks") - 1)).alias("block"))
    every = taken.union(rest).join(needs.select("source_no", F.col("words").alias("_need")), "source_no")
    return every.where(F.col("block") * block_words < F.col("_need")).select(
        "slot", "source_no", "block", F.least(F.lit(block_words), F.col("_need") - F.col("block") * block_words).alias("words")
    )


def mix_sources(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, epochs: int = 2, block_words: int = BLOCK_WORDS,
    seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """The mix of ``docs``: (documents, pieces).

    documents: doc_id, source, size, source_size, target, taken, one row per input row. pieces: slot,
    row_no, doc_id, epoch, first_word, n_words, the stretches of documents in the order of the mix.

    A null text and one without words have size 0 and give no piece. Rows are alike however often an
    id repeats: each takes its own place in the stream, and equal rows share what they take in any
    order. A null id is an id. A null source is a source, the last. An empty table gives empty tables.
    Columns beside the three named are not read.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    shuffled = F.xxhash64(F.lit(seed), "doc_id", "size")
    sized = written(sized.withColumn("mark", shuffled), "mixing-sizes")
    rows = sized.count()
    buckets = max(1, -(-rows // GROUP_ROWS))
    sized = sized.withColumn("bucket", F.pmod("mark", F.lit(buckets)))
    in_bucket = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    targets = source_targets(in_bucket.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, share, epochs)
    targets = written(targets, "mixing-targets")

    def same(left, right):
        return left["source"].eqNullSafe(right["source"])

    along = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = in_bucket.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(along), F.lit(0)))
    placed = placed.join(targets, same(placed, targets)).select(
        placed["source"].alias("_source"), F.col("bucket").alias("_bucket"), "bucket_start", "source_no", "source_size", "target"
    )
    within = Window.partitionBy("source", "bucket").orderBy("mark", "doc_id", "size")
    streamed = sized.withColumns({
        "nth": F.row_number().over(within), "into": F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"),
    })
    streamed = streamed.join(placed, streamed["source"].eqNullSafe(placed["_source"]) & (streamed["bucket"] == placed["_bucket"])).select(
        F.concat_ws(".", "source_no", "bucket", "nth").alias("row_no"), "doc_id", "source", "size", "source_no", "source_size", "target",
        (F.col("bucket_start") + F.col("into")).alias("start"),
    )
    streamed = written(streamed, "mixing-stream")
    # every pass over the stream that the target reaches, cut at block ends
    passes = streamed.where("size > 0").select(
        "row_no", "doc_id", "source_no", "size", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"), "start", "source_size", "target"
    ).withColumn("at", F.col("start") + F.col("epoch") * F.col("source_size")).where("at < target")
    cut = passes.select(
        "row_no", "doc_id", "source_no", "size", "epoch", "at",
        F.explode(F.sequence(F.floor(F.col("at") / block_words), F.floor((F.col("at") + F.col("size") - 1) / block_words))).alias("block"),
    )
    blocks = schedule(targets, block_words)
    begin = F.greatest(F.col("at"), F.col("block") * block_words)
    end = F.least(F.col("at") + F.col("size"), F.col("block") * block_words + F.col("words"))
    pieces = cut.join(blocks, ["source_no", "block"]).where(end > begin).select(
        "slot", "row_no", "doc_id", "epoch", (begin - F.col("at")).alias("first_word"), (end - begin).alias("n_words")
    )
    pieces = written(pieces, "mixing-pieces")
    taken = pieces.groupBy("row_no").agg(F.sum("n_words").alias("taken"))
    documents = streamed.join(taken, "row_no", "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )
    return documents, pieces


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of ``docs`` as the mix of ``mix_sources`` takes them, all columns.

    A document stands once for each pass that takes it, and not at all if none does. Where a source's
    target ends inside a document, its text is cut to the words taken, joined by single spaces.
    """
    nested = docs.select(F.struct("*").alias("row"))
    # rows with this key are equal in every column, so that it doesn't matter which of them is drawn
    told = F.to_json("row", {"ignoreNullFields": "false"})
    text = F.col("row")[text_col].cast("string")
    keyed = nested.select("row", F.md5(told.cast("binary")).alias("key"), text.alias("text"), F.col("row")[source_col].alias("source"))
    _, pieces = mix_sources(keyed, id_col="key", text_col="text", source_col="source", **how)
    drawn = pieces.groupBy("row_no", F.col("doc_id").alias("drawn"), "epoch").agg(F.min("first_word").alias("first"), F.sum("n_words").alias("n"))
    drawn = written(drawn.select("drawn", "first", "n"), "mixing-drawn")
    joined = keyed.dropDuplicates(["key"]).join(drawn, F.col("key") == F.col("drawn"))
    words = F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), (F.col("first") + 1).cast("int"), F.col("n").cast("int"))
    cut = F.when(F.col("n") < word_count(F.col("text")), F.array_join(words, " ")).otherwise(F.col("text"))
    kind = docs.schema[text_col].dataType
    return joined.select(F.col("row").withField(f"`{text_col}`", cut.cast(kind)).alias("row")).select("row.*")

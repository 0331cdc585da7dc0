"""Mixing sources to target weights with a low-discrepancy slot schedule."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from kinloom.llm.common import intake, outgo, word_count
from kinloom.operators.recovery import checkpointed

#: Points live on a circle of 2^40 steps; STEP is 2^40 over the golden ratio, made odd.
BITS = 40
STEP = int((5**0.5 - 1) / 2 * 2**BITS) | 1
HALF = 1 << 20
#: Slots are ranked within chunks of this many before the chunks are added up.
CHUNK = 1 << 16
#: Rows of one bucket of a source's shuffled order, about.
BUCKET_ROWS = 20_000
#: The table of sources is broadcast only up to this many rows.
BROADCAST_SOURCES = 10_000


@dataclass
class Mix:
    """``documents``: one row per input row with size, source_size, target, taken,
    copies; ``slots``: the schedule (position, source, epoch, block, words);
    ``sources``: one row per source with size, weight and target."""

    documents: DataFrame
    slots: DataFrame
    sources: DataFrame


def golden_point(i: Column) -> Column:
    """``i * STEP mod 2^40`` without overflow, for i below 2^40."""
    low, high = i.bitwiseAND(HALF - 1), F.shiftright(i, 20).bitwiseAND(HALF - 1)
    turned = F.shiftleft((high * (STEP & (HALF - 1))).bitwiseAND(HALF - 1), 20)
    return (turned + low * F.lit(STEP)).bitwiseAND((1 << BITS) - 1)


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """``sizes(source, size)`` with weight, target and quota (target in whole words).

    Water filling: sources in order of cap over weight; those before the first
    one that stays below its cap at the level of the rest get their cap.
    One row per source, so the windows over all of them are small.
    """
    by_name, by_cap = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    place = (F.row_number().over(by_name) - 1) % len(weights) + 1
    out = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place.cast("int")))
    out = out.withColumn("cap", F.col("size").cast("double") * max_epochs).withColumn("ratio", F.col("cap") / F.col("weight"))
    total, capped = F.sum("size").over(every), F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rest = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    out = out.withColumn("level", (total - capped) / rest)
    # Past the first source below its cap the levels only fall.
    level = F.max(F.when(F.col("ratio") >= F.col("level"), F.col("level"))).over(every)
    out = out.withColumn("target", F.least("cap", F.coalesce(F.col("weight") * level, F.col("cap"))))
    return out.select("source", "size", "weight", "target", F.round("target").cast("long").alias("quota"))


def _schedule(sources: DataFrame, n_sources: int, total: int, block: int) -> DataFrame:
    """(position, source, rank): golden-ratio points mapped through the cumulative targets.

    Each source keeps as many slots as fill its quota; the few that the points
    leave out come after the last point.
    """
    spark = sources.sparkSession
    span = float(1 << BITS)
    upto = Window.orderBy(F.col("source").asc_nulls_last())
    everything = F.sum("target").over(Window.partitionBy())
    edge = F.round(F.sum("target").over(upto) / F.greatest(everything, F.lit(1e-9)) * span).cast("long")
    parts = sources.where("quota > 0").select("source", "size", "quota", edge.alias("high"))
    parts = parts.withColumn("low", F.coalesce(F.lag("high").over(upto), F.lit(0)))
    # Whole rounds through the source's blocks, of which the last is short, and the rest.
    blocks = F.expr(f"(size + {block - 1}) div {block}")
    parts = parts.withColumn("blocks", blocks).withColumn("wanted", F.expr(f"(quota div size) * blocks + (quota % size + {block - 1}) div {block}"))
    cells = max(4096, 4 * n_sources)
    width = (1 << BITS) // cells + 1
    by_cell = parts.where("high > low").withColumn("cell", F.explode(F.sequence(F.expr(f"low div {width}"), F.expr(f"(high - 1) div {width}"))))
    count = -(-total // block) + n_sources
    points = spark.range(count).select(F.col("id").alias("position"), golden_point(F.col("id")).alias("point"))
    points = points.withColumn("cell", F.expr(f"point div {width}"))
    hit = points.join(by_cell, "cell").where("point >= low and point < high").select("position", "source", F.expr(f"position div {CHUNK}").alias("chunk"))
    per_chunk = hit.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_chunk.select("source", "chunk", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "chunk").orderBy("position")
    ranked = hit.withColumn("k", F.row_number().over(inside) - 1).alias("a").join(
        offsets.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.chunk") == F.col("b.chunk"))
    ).select("a.source", "a.position", (F.col("k") + F.col("offset")).alias("rank"))
    found = offsets.groupBy("source").agg(F.sum("n").alias("found"))
    parts = parts.alias("p")
    tail = (
        parts.join(found.alias("f"), F.col("p.source").eqNullSafe(F.col("f.source")), "left")
        .select("p.source", "wanted", F.coalesce("found", F.lit(0)).alias("found"))
        .where("found < wanted")
        .select("source", F.explode(F.sequence(F.col("found"), F.col("wanted") - 1)).alias("rank"))
        .select("source", (F.lit(count) + F.col("rank")).alias("position"), "rank")
    )
    slots = ranked.unionByName(tail).alias("s")
    return (
        slots.join(parts, F.col("s.source").eqNullSafe(F.col("p.source")))
        .where("rank < wanted")
        .select("s.source", "position", "rank", "size", "quota", "blocks")
        .withColumn("epoch", F.expr("rank div blocks"))
        .withColumn("block", F.expr("rank % blocks"))
        .withColumn("start", F.col("epoch") * F.col("size") + F.col("block") * block)
        .withColumn("words", F.least(F.lit(block), F.col("size") - F.col("block") * block, F.col("quota") - F.col("start")))
        .where("words > 0")
        .select("position", "source", "epoch", "block", "words")
    )


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    max_epochs: int = 3,
    block_words: int = 256,
    seed: int = 11,
) -> Mix:
    """Mix documents so that each source fills its share of all words.

    Sources in code-point order, null last, take the weights in turn.  Their
    shares of the corpus size are the targets, stopped at ``max_epochs`` times
    the source's size with the excess reshared.  Each source is shuffled by a
    seeded hash and cut into blocks of ``block_words``; slots of the schedule
    take the source's blocks round by round.  Window sums run over buckets of
    the hash, so a source with most rows is spread out; only sizes and offsets
    are shuffled, never texts.

    ``copies`` is how often the mix takes a document's middle word: its whole
    copies when documents are not cut.  Null text has size 0 and is never
    taken.  Null ids and repeated rows are rows of their own.  An empty table,
    or one without words, has targets 0.  Reruns give the same mix.  Texts of any
    length are counted whole; columns named like the operator's own do no harm.
    Running sums over sources are taken in one task, so sources may number
    many thousands but are not meant to be as many as the documents.
    """
    spark = docs.sparkSession
    base, names = intake(docs, id_col, text_col, source_col)
    base = base.select("_rest", "_w0", "_w1", F.col("_w2").alias("source"), F.xxhash64(F.lit(seed), "_w0", "_w1").alias("h"), F.xxhash64("_w1").alias("tag"))
    sized = base.select(F.col("_w0").alias("id"), "source", "h", "tag", word_count(F.col("_w1")).alias("words"))
    sized = checkpointed(sized)
    rows = sized.count()
    deep = max(0, (rows // BUCKET_ROWS).bit_length())
    sized = sized.withColumn("bucket", F.shiftrightunsigned("h", 64 - deep) if deep else F.lit(0).cast("long"))
    buckets = sized.groupBy("source", "bucket").agg(F.sum("words").alias("n"))
    buckets = checkpointed(buckets)
    sources = checkpointed(source_targets(buckets.groupBy("source").agg(F.sum("n").alias("size")), weights, max_epochs))
    facts = sources.agg(F.count("*").alias("n"), F.sum("size").alias("total")).first()
    small = F.broadcast if facts["n"] <= BROADCAST_SOURCES else lambda df: df
    slots = _schedule(sources, facts["n"], facts["total"] or 0, block_words)

    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select("source", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset")).alias("o")
    inside = Window.partitionBy("source", "bucket").orderBy("h", F.col("id").asc_nulls_last(), "tag").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("local", F.coalesce(F.sum("words").over(inside), F.lit(0))).alias("d").join(
        starts, F.col("d.source").eqNullSafe(F.col("o.source")) & (F.col("d.bucket") == F.col("o.bucket"))
    ).select("d.source", "id", "h", "tag", "words", (F.col("local") + F.col("offset")).alias("start"))
    placed = placed.withColumn("end", F.col("start") + F.col("words")).withColumn("middle", F.expr("start + words div 2"))

    # How often each block is taken whole, and up to which word it is taken once more.
    cuts = slots.groupBy("source", "block").agg(F.max("epoch").alias("last"), F.max_by("words", "epoch").alias("part")).alias("c")
    spans = placed.where("words > 0").withColumn("block", F.explode(F.sequence(F.expr(f"start div {block_words}"), F.expr(f"(end - 1) div {block_words}"))))
    low, high = F.greatest(F.col("start"), F.col("block") * block_words), F.least(F.col("end"), (F.col("block") + 1) * block_words)
    once = F.greatest(F.lit(0), F.least(F.col("high"), F.col("b0") + F.col("part")) - F.col("low"))
    middle = F.when((F.col("middle") >= F.col("low")) & (F.col("middle") < F.col("high")), F.col("last") + (F.col("middle") < F.col("b0") + F.col("part")).cast("int"))
    taken = (
        spans.withColumn("low", low).withColumn("high", high).withColumn("b0", F.col("block") * block_words).alias("s")
        .join(cuts, F.col("s.source").eqNullSafe(F.col("c.source")) & (F.col("s.block") == F.col("c.block")))
        .withColumn("got", F.col("last") * (F.col("high") - F.col("low")) + once)
        .groupBy("s.source", "id", "h", "tag", "start", "words")
        .agg(F.sum("got").alias("taken"), F.coalesce(F.max(middle), F.lit(0)).alias("copies"))
        .select(F.col("source").alias("t_source"), F.col("start").alias("t_start"), "taken", "copies")
    ).alias("t")
    done = (
        placed.alias("p")
        .join(taken, F.col("p.source").eqNullSafe(F.col("t_source")) & (F.col("p.start") == F.col("t_start")) & (F.col("words") > 0), "left")
        .join(small(sources.select("source", F.col("size").alias("source_size"), "target")).alias("q"), F.col("p.source").eqNullSafe(F.col("q.source")))
        .select(F.col("p.source").alias("source"), "id", "h", "tag", F.col("words").alias("size"), "source_size", "target",
                F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("copies", F.lit(0)).cast("long").alias("copies"))
    )
    return Mix(done, slots, sources)


def take_copies(docs: DataFrame, **params) -> DataFrame:
    """The documents as often as the mix takes them whole: none, one or several rows each."""
    id_col, text_col, source_col = (params.get(k, d) for k, d in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source")))
    seed = params.get("seed", 11)
    chosen = mix_sources(docs, **params).documents
    # Rows alike in id, text and source have one fate: the rounded mean of their copies.
    alike = chosen.groupBy("h", "tag", "id", "source").agg(F.round(F.avg("copies")).cast("int").alias("copies")).where("copies > 0").alias("m")
    base, names = intake(docs, id_col, text_col, source_col)
    base = base.withColumn("h", F.xxhash64(F.lit(seed), "_w0", "_w1")).withColumn("tag", F.xxhash64("_w1")).alias("b")
    same = (F.col("b.h") == F.col("m.h")) & (F.col("b.tag") == F.col("m.tag")) & F.col("_w0").eqNullSafe(F.col("m.id")) & F.col("_w2").eqNullSafe(F.col("m.source"))
    rows = base.join(alike, same).select("_rest", "_w0", "_w1", "_w2", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy"))
    return outgo(rows, names, {id_col: F.col("_w0"), text_col: F.col("_w1"), source_col: F.col("_w2")})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    out = mix_sources(docs).documents
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")

"""Mixing sources to target weights: fixed-length blocks of words, dealt to output shards.

Sources in code-point order (null last) weigh ``WEIGHTS``, repeating, and share ``SHARE`` of all words; no target exceeds
``MOST`` times its source, what is above is shared among the others by weight.

* **Blocks.** The documents of a source, by doc_id, form one stream of words, cut into blocks of ``BLOCK_WORDS``; the last is
  shorter. A source is drawn from as many times as brings its blocks nearest to the target, so its words miss the target by less than
  a block, however small it is.
* **Counts.** Slots of the mix, shards of ``SHARD_SLOTS`` one after the other, draw their sources at random: a pseudorandom
  permutation of all slots deals out each source's draws. The counts of a shard follow the multinomial law of the
  targets, given that each source's total is exact; independent totals would stray from a small source's target by the root of it.
* **Blocks of the draws.** Draw j of a source takes block p(j mod blocks), p a pseudorandom permutation of the source's block
  numbers, another one for each time round. So a block occurs again only after all others of its source, and a document is
  never taken more than ``MOST`` times.
* Draws and documents meet by block number, at most ``BLOCK_WORDS`` documents and ``MOST`` draws a block.

Everything depends on content and the seed only. DataFrame functions only; texts are not shuffled. A source of any size is
spread: its documents by ranges, its draws by chunks.

Cases: a null text has no words, a document without words is taken 0 times; null and repeated doc_ids are ordinary keys; rows equal in
doc_id, source and text stand next to each other; a source without words has target 0; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillpulse.llm.common import stored
from tillpulse.llm.running import running_sums

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
BLOCK_WORDS = 64
SHARD_SLOTS = 1 << 14
CHUNK_ROWS = 1 << 14
ROUNDS = 6
SEED = 20240611


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def target_sizes(sources: DataFrame) -> DataFrame:
    """``sources`` (source_size, weight, ...) with ``target``. The level, words for each unit of weight, rises until no source that
    still follows it is above its limit; a round is one aggregate over the sources."""
    limit = F.col("source_size") * float(MOST)
    above = F.lit(False)
    stopped, level = -1, 0.0
    while True:
        found = sources.agg(
            F.sum("source_size").alias("all"), F.count_if(above).alias("stopped"), F.sum(F.when(above, limit).otherwise(0.0)).alias("given"),
            F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("weight"),
        ).first()
        if found["stopped"] == stopped:
            break
        stopped = found["stopped"]
        level = (SHARE * found["all"] - found["given"]) / found["weight"] if found["weight"] else 0.0
        above = F.col("weight") * F.lit(level) > limit
    return sources.withColumn("target", F.when(above, limit).otherwise(F.col("weight") * F.lit(level)))


def _div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def _step(df: DataFrame, source: str, target: str) -> DataFrame:
    """One application of the permutation; a round is a projection of its own, so that no expression is written out twice."""
    left, right = "_left", "_right"
    df = df.withColumns({left: _div(F.col(source), F.col("_b")), right: F.pmod(F.col(source), F.col("_b"))})
    for i in range(ROUNDS):
        mine, other, side = (left, right, "_a") if i % 2 == 0 else (right, left, "_b")
        mixed = F.pmod(F.xxhash64(F.col(other), F.col("_seed"), F.lit(i)), F.col(side))
        df = df.withColumn(mine, F.pmod(F.col(mine) + mixed, F.col(side)))
    return df.withColumn(target, F.col(left) * F.col("_b") + F.col(right)).drop(left, right)


def _sides(df: DataFrame, n: str) -> DataFrame:
    df = df.withColumn("_b", F.greatest(F.ceil(F.sqrt(F.col(n))).cast("long"), F.lit(1)))
    return df.withColumn("_a", F.greatest(_div(F.col(n) + F.col("_b") - 1, F.col("_b")), F.lit(1)))


def permuted(df: DataFrame, number: str, position: str, n: str, seeds: list[str], cycles: DataFrame) -> DataFrame:
    """``position``: where ``number`` (0..n-1) goes in a permutation of 0..n-1 of its own for every value of ``seeds``. ``cycles`` has
    every pair of ``n`` and ``seeds`` that occurs. A value that lands beyond n - 1 is permuted again; how often that can
    be needed is found beforehand from the fewer than root-of-n values beyond."""
    seed = F.xxhash64(*seeds, F.lit(SEED))
    sized = _sides(cycles.select(n, *seeds), n).where(F.col("_a") * F.col("_b") > F.col(n)).withColumn("_seed", seed)
    outside = sized.select("*", F.explode(F.sequence(F.col(n), F.col("_a") * F.col("_b") - 1)).alias("_first"))
    outside = stored(outside.withColumn("_x", F.col("_first")), "walks")
    depth = 0
    while outside.limit(1).count():
        depth += 1
        # Written before it is filtered: a filter would be pushed down with the permutation written out in it.
        outside = stored(_step(outside, "_x", "_y").drop("_x").withColumnRenamed("_y", "_x"), "walks")
        # A walk that returns to its start never meets a value below n.
        outside = outside.where((F.col("_x") >= F.col(n)) & (F.col("_x") != F.col("_first")))
    df = _step(_sides(df, n).withColumn("_seed", seed), number, position)
    for _ in range(depth):
        df = _step(df, position, "_again")
        df = df.withColumn(position, F.when(F.col(position) < F.col(n), F.col(position)).otherwise(F.col("_again"))).drop("_again")
    return df.drop("_a", "_b", "_seed")


def _numbers(df: DataFrame, n: Column, name: str) -> DataFrame:
    """Every row once for each of 0..n-1, as ``name``; chunks of bounded length, dealt out to all tasks."""
    chunks = df.where(n > 0).withColumn("_to", n - 1).withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_to"), F.lit(CHUNK_ROWS).cast("long"))))
    # A fixed number of partitions: a chunk is a few bytes here and many rows in the next step.
    dealt = chunks.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *df.columns, "_from")
    last = F.least(F.col("_from") + CHUNK_ROWS - 1, F.col("_to"))
    return dealt.withColumn(name, F.explode(F.sequence("_from", last))).drop("_from", "_to")


def placed_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (row, doc_id, size, source_no, start) with their place in the stream of their source, and
    (source_no, source, source_size, weight, target, blocks, draws)."""
    thin = stored(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"),
    ), "mix-rows")
    found = thin.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_null", F.col("source").isNull())
    numbered = running_sums(stored(found, "mix-sources"), [], ["_null", "source"], {"n": F.lit(1).cast("long")})
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod("n_before", F.lit(len(WEIGHTS))) + 1).cast("int"))
    sources = stored(numbered.select(F.col("n_before").alias("source_no"), "source", "source_size", weight.alias("weight")), "mix-weights")
    blocks = _div(F.col("source_size") + BLOCK_WORDS - 1, BLOCK_WORDS)
    draws = F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * F.col("blocks"))).otherwise(0).cast("long")
    sources = stored(target_sizes(sources).withColumn("blocks", blocks).withColumn("draws", draws), "mix-targets")
    places = running_sums(thin, ["source"], ["doc_id", "digest", "size"], {"row": F.lit(1).cast("long"), "words": F.col("size")})
    placed = places.join(sources.select(F.col("source").alias("_source"), "source_no", "source_size", "target"), F.col("source").eqNullSafe(F.col("_source")))
    rows = placed.select(
        "source_no", F.col("row_before").alias("row"), "doc_id", "size", F.col("words_before").alias("start"), "source_size", "target"
    )
    return stored(rows, "mix-places"), sources


def drawn_blocks(sources: DataFrame) -> DataFrame:
    """(shard, slot, source_no, block): the source and block of every slot of the mix."""
    spans = running_sums(sources, [], ["source_no"], {"slots": F.col("draws")})
    draws = _numbers(spans.select("source_no", "blocks", "draws", "slots_before", "slots_total"), F.col("draws"), "draw")
    draws = draws.withColumns({
        "number": F.col("slots_before") + F.col("draw"), "mix": F.lit(0), "turn": _div(F.col("draw"), F.col("blocks")),
        "of_turn": F.pmod("draw", F.col("blocks")),
    })
    whole = spans.select("slots_total").distinct().withColumn("mix", F.lit(0))
    draws = permuted(draws, "number", "position", "slots_total", ["mix"], whole)
    turns = spans.where("draws > 0").select("source_no", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), _div(F.col("draws") - 1, F.col("blocks")))).alias("turn"))
    draws = permuted(draws, "of_turn", "block", "blocks", ["source_no", "turn"], turns)
    return stored(draws.select(
        _div(F.col("position"), SHARD_SLOTS).alias("shard"), F.pmod("position", F.lit(SHARD_SLOTS)).alias("slot"), "source_no", "block"
    ), "mix-draws")


def shard_counts(draws: DataFrame) -> DataFrame:
    """(shard, source_no, slots): how many slots of a shard each source has drawn."""
    return draws.groupBy("shard", "source_no").agg(F.count(F.lit(1)).alias("slots"))


def mixed_spans(places: DataFrame, draws: DataFrame) -> DataFrame:
    """(shard, slot, source_no, row, doc_id, first_word, words): the mix, as stretches of documents in slot order of their blocks."""
    pieces = places.where("size > 0").select(
        "source_no", "row", "doc_id", "size", "start",
        F.explode(F.sequence(_div(F.col("start"), BLOCK_WORDS), _div(F.col("start") + F.col("size") - 1, BLOCK_WORDS))).alias("block"),
    )
    first = F.greatest(F.col("start"), F.col("block") * BLOCK_WORDS)
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * BLOCK_WORDS)
    cut = pieces.select("source_no", "block", "row", "doc_id", (first - F.col("start")).alias("first_word"), (end - first).alias("words"))
    return draws.join(cut, ["source_no", "block"]).select("shard", "slot", "source_no", "row", "doc_id", "first_word", "words")


def mixed(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of ``docs``."""
    places, sources = placed_documents(docs)
    spans = mixed_spans(places, drawn_blocks(sources))
    values = ["doc_id", "size", "source_size", "target"]
    taken = spans.groupBy("source_no", "row").agg(F.sum("words").alias("taken"))
    known = places.select("source_no", "row", *values, F.lit(0).cast("long").alias("taken"))
    both = known.unionByName(taken.select("source_no", "row", *[F.lit(None).cast(t).alias(c) for c, t in known.dtypes if c in values], "taken"))
    found = both.groupBy("source_no", "row").agg(*[F.max(c).alias(c) for c in values], F.sum("taken").alias("taken"))
    return found.drop("source_no", "row")

"""Merkle manifest of a table: a digest per row, a tree per language, one root, and a proof for every row.

A row's leaf is the SHA-256 of its columns, each written as ``-`` if null, else byte count, colon and value. Within a language
leaves are ranked by doc_id (null first), rows that share a doc_id by their leaf; runs of eight nodes become the digest of
their digests until one is left, the subroot. Subroots, by language (null first), are the leaves of the tree above them.

Trees are built by rolling up nested structs. The octal digits of a rank are columns; within a block of 8 ** ``BLOCK_DIGITS``
neighbouring nodes the last digit is grouped away, its nodes become an array inside their parent, then the next digit, until
the block is one row with its nodes nested in it. A block therefore never holds more than that many nodes, however many rows a
language has; the blocks' digests are the nodes of the next tier. On the way down every block meets its own path to the root
as two rows of one group, and a transform over the nested arrays with an explode gives each node the siblings of every level:
no joins. Levels are those of the whole tree: a node that is alone on its level passes as it is.

Cases: null columns are written ``-``; rows equal in all columns are leaves of their own with neighbouring ranks; a null
doc_id is never tampered with; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillpulse.llm.common import stored
from tillpulse.llm.running import running_sums

FAN_BITS = 3  # eight children
BLOCK_DIGITS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEP = "struct<before string, after string>"


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(columns: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*[_field(columns[name]) for name in FIELDS]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(lang, doc_id, leaf, tampered) per row: ``tampered`` is the leaf after lower-casing A-Z in the text where three divides
    the CRC-32 of the doc_id, elsewhere null."""
    columns = {name: F.col(name) for name in FIELDS} | {name: F.col(name).cast("long") for name in ("doc_id", "n_chars")}
    lowered = columns | {"text": F.translate("text", string.ascii_uppercase, string.ascii_lowercase)}
    changed = F.crc32(columns["doc_id"].cast("string").cast("binary")) % 3 == 0
    return docs.select(
        F.col("lang"), columns["doc_id"].alias("doc_id"), leaf_digest(columns).alias("leaf"),
        F.when(changed, leaf_digest(lowered)).alias("tampered"),
    )


def _alone(level: int) -> Column:
    """Whether the tree has one node only below ``level`` (1: among the nodes of this tier)."""
    return F.col("n") <= 1 << FAN_BITS * (level - 1)


def rolled_up(nodes: DataFrame) -> DataFrame:
    """(tree, n, block, digest, kids) from ``nodes`` (tree, rank, n, digest, payload): one row per block. ``kids`` nests
    struct(digit, digest, kids) down to struct(digit, digest, payload)."""
    digits = [f"digit_{k}" for k in range(BLOCK_DIGITS)]
    low = (1 << FAN_BITS) - 1
    rows = nodes.select(
        "tree", "n", F.shiftright("rank", FAN_BITS * BLOCK_DIGITS).alias("block"),
        *[F.shiftright("rank", FAN_BITS * k).bitwiseAND(F.lit(low)).cast("int").alias(d) for k, d in enumerate(digits)],
        "digest", F.col("payload").alias("inner"),
    ).repartition("tree", "block")
    for level, digit in enumerate(digits, 1):
        child = F.struct(F.col(digit).alias("digit"), "digest", "inner")
        rows = rows.groupBy("tree", "n", "block", *digits[level:]).agg(F.sort_array(F.collect_list(child)).alias("inner"))
        every = F.array_join(F.transform("inner", lambda x: x["digest"]), "")
        rows = rows.withColumn("digest", F.when(_alone(level), F.col("inner")[0]["digest"]).otherwise(F.sha2(every, 256)))
    return rows.withColumnRenamed("inner", "kids")


def _steps(kids: Column, at: Column, level: int) -> Column:
    """What stands left and right of child ``at`` among its siblings; no step where the tree has no such level."""
    digests = F.transform(kids, lambda x: x["digest"])
    step = F.struct(
        F.array_join(F.slice(digests, F.lit(1), at), "").alias("before"),
        F.array_join(F.slice(digests, at + 2, F.lit(1 << FAN_BITS)), "").alias("after"),
    )
    return F.when(_alone(level), F.array().cast(f"array<{_STEP}>")).otherwise(F.array(step))


def _unnested(kids: Column, level: int, place: Column, above: Column) -> Column:
    """All nodes below ``kids`` as structs (rank, digest, payload, steps), the steps from the node upwards. ``place`` is the
    rank of the parent among those of its level."""
    def of(child: Column, at: Column) -> Column:
        steps = F.concat(_steps(kids, at, level), above)
        rank = place * (1 << FAN_BITS) + child["digit"]
        if level > 1:
            return _unnested(child["inner"], level - 1, rank, steps)
        return F.array(F.struct(rank.alias("rank"), child["digest"].alias("digest"), child["inner"].alias("payload"), steps.alias("steps")))

    return F.flatten(F.transform(kids, of))


def with_paths(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """(tree, rank, digest, payload, steps, subroot, root) of the nodes of ``blocks``. ``paths`` (tree, block, steps, subroot, root)
    leads from every block to the root."""
    given = ["steps", "subroot", "root"]
    kinds = dict(paths.dtypes)
    built = blocks.select("tree", "block", "n", "kids", *[F.lit(None).cast(kinds[c]).alias(c) for c in given])
    known = paths.select("tree", "block", *[F.lit(None).cast(blocks.schema[c].dataType).alias(c) for c in ("n", "kids")], *given)
    met = built.unionByName(known).groupBy("tree", "block").agg(*[F.first(c, True).alias(c) for c in ("n", "kids", *given)])
    below = _unnested(F.col("kids"), BLOCK_DIGITS, F.col("block"), F.col("steps"))
    nodes = met.select("tree", "subroot", "root", F.explode(below).alias("node"))
    return nodes.select("tree", "node.*", "subroot", "root")


def build(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The tiers of blocks, lowest first, and (tree, digest, tier): the digest that is left of each tree, and the tier at which it is."""
    tiers, tops = [], []
    more = True
    while more:
        blocks = stored(rolled_up(nodes), "merkle-blocks")
        size = F.shiftright(F.col("n") + ((1 << FAN_BITS * BLOCK_DIGITS) - 1), FAN_BITS * BLOCK_DIGITS)
        above = blocks.withColumn("size", size)
        tops.append(above.where("size <= 1").select("tree", "digest", F.lit(len(tiers)).alias("tier")))
        tiers.append(blocks)
        nodes = above.where("size > 1").select(
            "tree", F.col("block").alias("rank"), F.col("size").alias("n"), "digest", F.lit(None).cast("string").alias("payload")
        )
        more = bool(nodes.limit(1).count())
    return tiers, reduce(DataFrame.unionByName, tops)


def descend(tiers: list[DataFrame], tops: DataFrame) -> DataFrame:
    """``with_paths`` of the lowest tier. ``tops`` (tree, tier, steps, subroot, root): the path of what is left of each tree."""
    nodes = None
    for tier in reversed(range(len(tiers))):
        own = tops.where(F.col("tier") == tier).select("tree", F.lit(0).cast("long").alias("block"), "steps", "subroot", "root")
        paths = own if nodes is None else own.unionByName(nodes.select("tree", "block", "steps", "subroot", "root"))
        nodes = with_paths(tiers[tier], paths)
        if tier:
            nodes = stored(nodes.withColumn("block", F.col("rank")), "merkle-paths")
    return nodes


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, steps, proof_sha256, folded_root, verified: one row per row of ``docs``. ``steps`` is the
    proof itself, from leaf to root: what comes before and after the node in its run. ``folded_root`` starts from the tampered
    leaf, where there is one."""
    thin = stored(leaves(docs), "merkle-leaves")
    ranked = running_sums(thin, ["lang"], ["doc_id", "leaf"], {"n": F.lit(1).cast("long")})
    tiers, tops = build(ranked.select(
        F.col("lang").alias("tree"), F.col("n_before").alias("rank"), F.col("n_total").alias("n"), F.col("leaf").alias("digest"),
        F.struct("doc_id", "tampered").alias("payload"),
    ))
    subroots = stored(tops, "merkle-subroots")
    ordered = running_sums(subroots, [], ["tree"], {"n": F.lit(1).cast("long")})
    top_tiers, roots = build(ordered.select(
        F.lit(0).alias("tree"), F.col("n_before").alias("rank"), F.col("n_total").alias("n"), "digest",
        F.struct(F.col("tree").alias("lang"), "tier").alias("payload"),
    ))
    start = roots.select(
        "tree", "tier", F.array().cast(f"array<{_STEP}>").alias("steps"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root")
    )
    by_lang = descend(top_tiers, start).select(
        F.col("payload.lang").alias("tree"), "payload.tier", "steps", F.col("digest").alias("subroot"), "root"
    )
    nodes = descend(tiers, stored(by_lang, "merkle-lang-paths"))
    siblings = F.array_join(F.transform("steps", lambda s: F.concat(s["before"], s["after"])), "")
    changed = F.coalesce("payload.tampered", "digest")
    folded = F.aggregate("steps", changed, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))
    found = nodes.select(
        "payload.doc_id", F.col("digest").alias("leaf"), "subroot", "root", "steps",
        F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))

"""Placement of rows on shards by a weighted hash tree.

Shards form a tree (regions of racks of shards). A key descends it: at every level each child
draws -ln(u) / weight, with u hashed from the key and the child's path and the weight of its
whole subtree, and the least draw wins. Only the children on the key's own way are hashed.

A changed weight changes the draws of the nodes above it and no others: keys move between
regions only into or out of its region, inside that region only into or out of its rack, and
inside that rack only into or out of the shard. A shard that is added as a region of its own
therefore takes keys and moves none between the others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratadup.llm.durable import durable
from stratadup.llm.textkit import pick


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def uniform_tree(n_shards: int, per_rack: int = 4, racks_per_region: int = 2) -> list[Shard]:
    """Equal shards, filled rack by rack; more shards extend the tree without renaming any."""
    return [Shard(s // (per_rack * racks_per_region), s // per_rack, s) for s in range(n_shards)]


def grown(tree: list[Shard]) -> list[Shard]:
    """The tree with one shard more, in a rack and region of its own."""
    top = lambda name: max(getattr(s, name) for s in tree) + 1
    return [*tree, Shard(top("region"), top("rack"), top("shard"))]


def _pick(path: str, children: dict[int, float]) -> str:
    """The child with the least (draw, number), of a node whose path is the column `path`."""
    nodes = ", ".join(f"named_struct('w', {w!r}D, 'id', {i})" for i, w in sorted(children.items()))
    unit = f"(cast(conv(substr(md5(concat({path}, '/', x.id)), 1, 13), 16, 10) as double) + 0.5D) / {2.0**52!r}D"
    return f"array_min(transform(array({nodes}), x -> named_struct('draw', -ln({unit}) / x.w, 'id', x.id))).id"


def place(df: DataFrame, key: str, tree: list[Shard], out: str, seed: str = "tree") -> DataFrame:
    """Add the column `out`: the shard each row's key descends to. A null key is a key of its own."""
    if not tree or any(s.weight <= 0 for s in tree):
        raise ValueError("the tree needs shards, all of positive weight")
    if len({s.shard for s in tree}) < len(tree):
        raise ValueError("shards need numbers of their own")
    regions: dict[int, dict[int, dict[int, float]]] = {}
    for s in tree:
        regions.setdefault(s.region, {}).setdefault(s.rack, {})[s.shard] = s.weight
    path, region, rack = (f"{out} {x}" for x in ("path", "region", "rack"))
    weight = lambda racks: sum(sum(shards.values()) for shards in racks.values())
    rows = df.withColumn(path, F.concat(F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("null")), F.lit(f"|{seed}")))
    rows = rows.withColumn(region, F.expr(_pick(f"`{path}`", {r: float(weight(racks)) for r, racks in regions.items()})))
    ways = [f"when {r} then {_pick(f'concat(`{path}`, {chr(39)}/{r}{chr(39)})', {k: float(sum(s.values())) for k, s in racks.items()})}" for r, racks in regions.items()]
    rows = rows.withColumn(rack, F.expr(f"case `{region}` {' '.join(ways)} end"))
    ways = [f"when `{region}` = {r} and `{rack}` = {k} then {_pick(f'concat(`{path}`, {chr(39)}/{r}/{k}{chr(39)})', shards)}" for r, racks in regions.items() for k, shards in racks.items()]
    return rows.withColumn(out, F.expr(f"case {' '.join(ways)} end")).drop(path, region, rack)


def slots(df: DataFrame, shard: str, key: str, out: str, per_bucket: int = 500_000) -> DataFrame:
    """Number the rows of every shard from 0 without a gap.

    Rows get a number of their own first, in a written table. A shard is ordered by (bucket, key,
    number), where the bucket is a hash of key and number: rows that share a key spread over all
    buckets. Buckets hold about `per_bucket` rows, are numbered in separate tasks, and their
    starts come from one count per (shard, bucket).
    """
    rows = durable(df.withColumn("_row", F.monotonically_increasing_id()))
    buckets = max(16, rows.count() // per_bucket)
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(key, "_row"), F.lit(buckets)))
    counts = rows.groupBy(shard, "_bucket").count()
    starts = counts.select(
        F.col(shard).alias("_shard"),
        F.col("_bucket").alias("_b"),
        (F.sum("count").over(Window.partitionBy(shard).orderBy("_bucket")) - F.col("count")).alias("_start"),
    )
    rank = F.row_number().over(Window.partitionBy(shard, "_bucket").orderBy(key, "_row")) - 1
    ranked = rows.withColumn("_rank", rank)
    # one row for about `per_bucket` rows of the table, and 16 for every shard
    joined = ranked.join(F.broadcast(starts) if buckets <= 4096 else starts, (ranked[shard] == starts["_shard"]) & (ranked["_bucket"] == starts["_b"]))
    return joined.withColumn(out, (F.col("_start") + F.col("_rank")).cast("long")).drop("_row", "_bucket", "_rank", "_shard", "_b", "_start")


def shard_documents(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """Every document's shard, and its shard in a tree with one shard more.

    The law is `key`: doc_id and the number of shards decide; the shard more takes rows only into
    itself. A null id is a key of its own; rows that repeat an id share its shard and have slots of
    their own. A null text has no bytes, a long one counts whole. Empty tables give empty results;
    further columns are ignored, whatever their names.
    """
    docs = pick(docs, "doc_id", "text")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = place(rows, "doc_id", uniform_tree(n_shards), "shard")
    placed = place(placed, "doc_id", grown(uniform_tree(n_shards)), "grown_shard")
    return slots(placed, "shard", "doc_id", "slot").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")

"""K-d tree partitioning into shards of near-equal bytes.

The tree is built over metadata alone: id, size, source and language ordinals (by hash of the value), each
scaled to its extent in the whole table. Every node is split along its widest dimension at the weighted
median, where the weight of a row is its bytes, until there are `shards` leaves, that is until leaves reach
total / shards bytes; nodes with an odd number of leaves are split in that proportion. Medians are
distributed: a row's place along a dimension is one 62-bit number (the value, then hashes of the text, of the
id and of a written row id, so that rows of equal value still have an order), and the median's place is found
digit by digit from sums of bytes in 4096 bins, of which the driver gets one row
a bin and node. Refinement stops when the bin that holds the median weighs less than TOLERANCE of its node's
bytes; the cut is then exact to that share. The law is `bytes`. Equal texts are next to each other only among
rows of equal value in the dimension of a split: as ids, sources and languages are dimensions too, copies with
other metadata may be in other shards, and a group that straddles a median is split, however large.

Slots count the rows of a shard without gaps: rows are numbered within parts of a shard (a hash of the row id;
PART rows on average), and the parts' counts give the offsets.

Nulls: a null text weighs 1 byte and has the checksum 0; null ids, sources and languages are values of their
own. Rows equal in all columns are told apart by the row id and dealt like all others. An empty table gives no
rows. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm.common import materialize

SHARDS, BITS, TOLERANCE, PART, PARTS = 16, 12, 0.0005, 200, 1 << 16
_DIMENSIONS = ("d_id", "d_size", "d_source", "d_lang")


def metadata(docs: DataFrame) -> DataFrame:
    """One narrow row a document: id, size, checksum and its place along each dimension."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"), F.xxhash64("source").alias("s"), F.xxhash64("lang").alias("l"))
    rows = rows.select("doc_id", (F.length("t") + 1).cast("long").alias("size"), F.crc32("t").alias("text_crc32"), F.xxhash64("t").alias("text_key"), F.xxhash64("doc_id").alias("id_key"), "s", "l")
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()), "metadata")


def _placed(rows: DataFrame) -> DataFrame:
    """Adds d_*: 22 bits of the value, scaled, then 14 bits of the text's hash, 13 of the id's and 13 of the row's."""
    low = rows.agg(F.min("doc_id").alias("i0"), F.max("doc_id").alias("i1"), F.max("size").alias("z1")).first()
    first, span = low["i0"] or 0, max(1, (low["i1"] or 0) - (low["i0"] or 0))
    scaled = {
        "d_id": F.coalesce((F.col("doc_id") - F.lit(first)).cast("double") / F.lit(float(span)), F.lit(0.0)),
        "d_size": F.log(F.col("size").cast("double")) / F.log(F.lit(float(max(2, low["z1"] or 2)))),
        "d_source": F.pmod(F.col("s"), F.lit(1 << 22)).cast("double") / F.lit(float(1 << 22)),
        "d_lang": F.pmod(F.col("l"), F.lit(1 << 22)).cast("double") / F.lit(float(1 << 22)),
    }
    tie = F.shiftleft(F.pmod("text_key", F.lit(1 << 14)), 26) + F.shiftleft(F.pmod("id_key", F.lit(1 << 13)), 13) + F.pmod(F.xxhash64("row"), F.lit(1 << 13))
    return rows.withColumns({k: F.shiftleft(F.least(F.floor(v * ((1 << 22) - 1)), F.lit((1 << 22) - 1)).cast("long"), 40) + tie for k, v in scaled.items()})


def _node(tree: dict, leaf: bool = False):
    """The expression of a row's node: splits as nested conditions, one for each inner node."""

    def at(name: tuple):
        if name in tree:
            dimension, cut = tree[name]
            return F.when(F.col(dimension) < F.lit(cut), at((*name, 0))).otherwise(at((*name, 1)))
        return F.lit("".join(map(str, name)))

    return at(())


def build(rows: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> tuple[dict, dict[str, int]]:
    """The tree {path: (dimension, cut)} and the shard of each leaf's path."""
    tree: dict[tuple, tuple[str, int]] = {}
    level = {(): shards}
    while level := {k: n for k, n in level.items() if n > 1}:
        named = rows.withColumn("node", _node(tree))
        stats = named.groupBy("node").agg(F.sum("size").alias("bytes"), *(f(F.shiftright(d, 40)).alias(f"{n}_{d}") for d in _DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max)))).collect()  # a row a node
        facts = {r["node"]: r for r in stats}
        search = {}  # node -> [dimension, prefix, bits left, bytes before, wanted bytes, all bytes]
        for path, n in level.items():
            r = facts.get("".join(map(str, path)))
            if r is None:  # no rows here: any cut will do
                tree[path] = (_DIMENSIONS[0], 0)
                continue
            widest = max(_DIMENSIONS, key=lambda d: r[f"hi_{d}"] - r[f"lo_{d}"])
            search[path] = [widest, 0, 62, 0, r["bytes"] * (n // 2) / n, r["bytes"]]
        while search:
            place, keep = None, None
            for path, (d, prefix, bits, *_) in search.items():
                mine = F.col("node") == "".join(map(str, path))
                inside = mine & (F.shiftright(d, bits) == F.lit(prefix)) if bits < 62 else mine
                digit = F.shiftright(d, max(0, bits - BITS)).cast("long")
                place = F.when(inside, digit) if place is None else place.when(inside, digit)
                keep = inside if keep is None else keep | inside
            got: dict[str, list] = {}
            for r in named.filter(keep).groupBy("node", place.alias("bin")).agg(F.sum("size").alias("bytes")).collect():  # 2**BITS rows a node at most
                got.setdefault(r["node"], []).append((r["bin"], r["bytes"]))
            for path in list(search):
                d, prefix, bits, before, wanted, total = search[path]
                left = max(0, bits - BITS)
                for bin_, held in sorted(got["".join(map(str, path))]):
                    if before + held >= wanted:
                        break
                    before += held
                if left == 0 or held <= tolerance * total:
                    cut = bin_ if wanted - before < before + held - wanted else bin_ + 1
                    tree[path] = (d, cut << left)
                    del search[path]
                else:
                    search[path] = [d, bin_, left, before, wanted, total]
        level = {(*k, side): m for k, n in level.items() for side, m in ((0, n // 2), (1, n - n // 2))}
    leaves, paths = {}, [()]
    while paths:
        path = paths.pop(0)
        if path in tree:
            paths += [(*path, 0), (*path, 1)]
        else:
            leaves["".join(map(str, path))] = len(leaves)
    return tree, leaves


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of docs (doc_id, text, source, lang)."""
    rows = _placed(metadata(docs))
    tree, leaves = build(rows, shards)
    number = F.lit(0)
    named = F.col("node")
    for path, k in leaves.items():
        number = F.when(named == path, F.lit(k)).otherwise(number)
    dealt = rows.withColumn("node", _node(tree)).withColumn("shard", number.cast("int"))
    total = rows.count()
    parts = max(64, min(PARTS, total // PART) // shards)
    dealt = dealt.select("doc_id", "size", "text_crc32", "shard", "row", F.pmod(F.xxhash64("row"), F.lit(parts)).alias("part"))
    held = dealt.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = held.select("shard", "part", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row")) - 1
    out = dealt.withColumn("own", own).join(before, ["shard", "part"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("own")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

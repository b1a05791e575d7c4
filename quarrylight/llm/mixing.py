"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

Every source has a weight and a cap, MAX_EPOCHS times its size. All sources are filled in proportion to their
weights; those above their cap are clamped there and the excess goes to the others by weight, until none is
above. Each such round is one distributed sum over the table of sources, of which the driver gets one row; the
places of the sources by code point, which give their weights, come from ranges of sources and their counts.

A source is then repeated target / size times: whole repetitions for every document, and one more for the
first ones in the order of a seeded hash of id and text, so that the words taken are as near to the target as
whole documents allow. The end of this prefix is found in two steps: sums of each (source, GRAIN buckets of the
hash), then the documents of the one bucket that holds the end; rows equal in id and text are one entry with a
count there. Where the prefix ends within such equal rows, only these are written with a row id and numbered by
parts. Cuts reach the documents as a broadcast table up to BROADCAST_SOURCES sources; beyond it the join is
salted by the hash, so that a hot source is never one task.

Weights go 5, 2, 1 in turn over the sources by code point, the null source last. Nulls: a null or empty text
has size 0 and is taken 0 words; a null doc_id hashes as an empty one. Of rows equal in id and text any may be
taken once more than others; how many are is the same in each run. Sources of size 0 have the target 0; without
any words all targets are 0. Extra columns are kept, whatever their names; only mixed() puts its own columns
(size, source_size, target, repeats, taken) in the place of those of the same name. Empty in, empty out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm.common import WORD, materialize, unused

WEIGHTS, MAX_EPOCHS, SEED = (5, 2, 1), 3, "mix-1"
#: Hexadecimal digits of the hash that name a bucket: 4096 buckets a source.
GRAIN = 3
#: Cuts (about 100 bytes a source) are sent to all executors up to this count; beyond it the join is salted.
BROADCAST_SOURCES, SALTS = 100_000, 64
#: Equal rows are numbered in parts of about so many.
PART = 1000
ADDED = ("size", "source_size", "target", "repeats", "taken")


def _source_key(column):
    """Sources sort by code point and null last."""
    return F.coalesce(F.concat(F.lit("0"), column.cast("string")), F.lit("1"))


def _hash(doc_id, text, seed: str):
    """32 hexadecimal digits; equal for rows equal in id and text alone."""
    content = F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f"|{seed}|"), content).cast("binary"))


def _size(text):
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _before(rows: DataFrame, part: str, n: str) -> DataFrame:
    """part, before: the sum of n over all smaller parts; one row a part, of which there are few."""
    w = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return rows.groupBy(part).agg(F.sum(n).alias("held")).select(part, F.coalesce(F.sum("held").over(w), F.lit(0)).alias("before"))


def targets(sources: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sources (key, source_size) with weight and target."""
    dealt = materialize(sources.repartitionByRange("key").withColumn("part", F.spark_partition_id()), "sources")
    before = _before(dealt.withColumn("one", F.lit(1)), "part", "one")
    own = F.row_number().over(Window.partitionBy("part").orderBy("key")) - 1
    place = (F.col("own") + F.col("before")) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    ranked = dealt.withColumn("own", own).join(F.broadcast(before), "part")  # a row a range
    ranked = ranked.select("key", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(max_epochs))).alias("cap"))
    ranked = materialize(ranked, "weights")
    level, clamped = None, -1
    while True:  # one row each: what is left for the sources not clamped, by weight
        open_ = F.lit(True) if level is None else F.lit(level) * F.col("weight") <= F.col("cap")
        r = ranked.agg(
            F.sum("source_size").alias("total"),
            F.coalesce(F.sum(F.when(~open_, F.col("cap"))), F.lit(0.0)).alias("caps"),
            F.sum(F.when(open_, F.col("weight"))).alias("weight"),
            F.count_if(~open_).alias("clamped"),
        ).first()
        if r["total"] is None or r["clamped"] == clamped or r["weight"] is None:
            break
        level, clamped = (r["total"] - r["caps"]) / r["weight"], r["clamped"]
    filled = F.col("cap") if level is None else F.least("cap", F.lit(level) * F.col("weight"))
    return ranked.select("key", "source_size", "weight", filled.alias("target"))


def cuts(narrow: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """key, source_size, target, whole, last, some, copies of every source of the written table narrow (key, hash, size):
    one repetition more for hashes below `last`, and for `some` of the `copies` equal rows that have it."""
    bucket = F.substring("hash", 1, GRAIN)
    sums = materialize(narrow.groupBy("key", bucket.alias("bucket")).agg(F.sum("size").alias("words")), "sums")
    sources = targets(sums.groupBy("key").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = sources.withColumn("whole", whole).withColumn("wanted", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    sources = materialize(sources, "wanted")
    upto = F.sum("words").over(Window.partitionBy("key").orderBy("bucket"))  # GRAIN buckets a source at most
    edges = sums.withColumn("upto", upto).join(sources.select("key", "wanted"), "key").filter("upto >= wanted")
    ends = edges.groupBy("key").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"), "wanted")).alias("end")).select("key", "end.*")
    ends = materialize(ends, "ends")
    few = ends.count() <= BROADCAST_SOURCES
    inside = narrow.withColumn("bucket", bucket).join(F.broadcast(ends) if few else ends, ["key", "bucket"])
    cells = inside.groupBy("key", "hash", "bucket", "before", "wanted").agg(F.count("*").alias("copies"), F.max("size").alias("size"))
    held = F.sum(F.col("copies") * F.col("size")).over(Window.partitionBy("key").orderBy("hash").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.withColumn("left", F.col("wanted") - F.col("before") - F.coalesce(held, F.lit(0)))
    # A row is taken if more than half of it is wanted.
    some = F.when(F.col("size") > 0, F.greatest(F.lit(0), F.least(F.col("copies"), F.ceil(F.col("left") / F.col("size") - 0.5)))).otherwise(0).cast("long")
    last = cells.withColumn("some", some).filter("some > 0").groupBy("key").agg(F.max(F.struct("hash", "some", "copies")).alias("last"))
    out = sources.join(ends.select("key", "bucket"), "key", "left").join(last, "key", "left")
    ended = F.coalesce(F.col("last.hash"), F.col("bucket"), F.lit(""))
    return out.select("key", "source_size", "target", "whole", ended.alias("last"), F.coalesce("last.some", F.lit(0)).alias("some"), F.coalesce("last.copies", F.lit(0)).alias("copies"))


def _numbered(rows: DataFrame, key: str, copies: str) -> tuple[DataFrame, str]:
    """Few or many rows of some sources, as a written table with a number from 0 in each source."""
    row, part, own, before, number = unused(rows, "mix_row", "mix_part", "mix_own", "mix_before", "mix_number")
    parts = F.greatest(F.lit(1), F.expr(f"`{copies}` div {PART}"))
    rows = materialize(rows.withColumn(row, F.monotonically_increasing_id()), "equal").withColumn(part, F.pmod(F.xxhash64(row), parts))
    counts = rows.groupBy(key, part).agg(F.count("*").alias(own))
    w = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(key, part, F.coalesce(F.sum(own).over(w), F.lit(0)).alias(before))
    rows = rows.withColumn(own, F.row_number().over(Window.partitionBy(key, part).orderBy(row)) - 1).join(counts, [key, part])
    return rows.withColumn(number, F.col(own) + F.col(before)), number


def _repeated(docs: DataFrame, weights, max_epochs, seed) -> tuple[DataFrame, list[str]]:
    """docs with size, source_size, target and repeats under the names that are given back."""
    key, hash_, size, source_size, target, whole, last, some, copies, salt, repeats = names = unused(
        docs, "mix_key", "mix_hash", "mix_size", "mix_source_size", "mix_target", "mix_whole", "mix_last", "mix_some", "mix_copies", "mix_salt", "mix_repeats"
    )
    hashed = _hash(F.col("doc_id"), F.col("text"), seed)
    narrow = docs.select(_source_key(F.col("source")).alias("key"), hashed.alias("hash"), _size(F.col("text")).alias("size"))
    found = materialize(cuts(materialize(narrow, "sizes"), weights, max_epochs), "cuts")
    named = found.select(*(F.col(c).alias(n) for c, n in (("key", key), ("source_size", source_size), ("target", target), ("whole", whole), ("last", last), ("some", some), ("copies", copies))))
    sized = docs.withColumns({key: _source_key(F.col("source")), hash_: hashed, size: _size(F.col("text"))})
    if found.count() <= BROADCAST_SOURCES:
        out = sized.join(F.broadcast(named), key)
    else:
        sized = sized.withColumn(salt, F.pmod(F.xxhash64(hash_), F.lit(SALTS)).cast("int"))
        out = sized.join(named.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [key, salt])
    c = lambda n: F.col(f"`{n}`")
    split = (c(hash_) == c(last)) & (c(some) > 0) & (c(some) < c(copies))
    more = (c(hash_) < c(last)) | (c(hash_) == c(last)) & (c(some) > 0)
    times = lambda once_more: F.when(c(source_size) > 0, c(whole) + once_more.cast("long")).otherwise(F.lit(0).cast("long"))
    columns = [*docs.columns, size, source_size, target, repeats]
    if found.filter("some > 0 and some < copies").isEmpty():
        return out.withColumn(repeats, times(more)).select(*columns), names
    equal, number = _numbered(out.filter(split), key, copies)
    equal = equal.withColumn(repeats, times(c(number) < c(some))).select(*columns)
    return out.filter(~split).withColumn(repeats, times(more)).select(*columns).union(equal), names


def mixed(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """docs with size, source_size, target (its source's), repeats and taken (size * repeats)."""
    out, names = _repeated(docs, weights, max_epochs, seed)
    rest = [c for c in docs.columns if c.lower() not in ADDED]
    size, source_size, target, repeats = (F.col(names[i]) for i in (2, 3, 4, 10))
    return out.select(*rest, size.alias("size"), source_size.alias("source_size"), target.alias("target"), repeats.alias("repeats"), (size * repeats).alias("taken"))


def drawn(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself: each row of docs as often as it is repeated, with the columns and values of docs."""
    out, names = _repeated(docs, weights, max_epochs, seed)
    (copy,) = unused(out, "mix_copy")
    out = out.filter(F.col(names[10]) > 0)
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(names[10])))).select(*docs.columns)


#: DuckDB SQL of the mix of documents.
SQL = """
with sized as (
  select doc_id, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
         coalesce('0' || source, '1') as k,
         md5(coalesce(doc_id::varchar, '') || '|mix-1|' || md5(coalesce(text, ''))) as h
  from documents),
sources as (select k, sum(size)::double as s, (row_number() over (order by k) - 1) % 3 as i from sized group by k),
weighted as (select k, s, case i when 0 then 5.0 when 1 then 2.0 else 1.0 end::double as w, 3.0::double * s as cap from sources),
levels as (
  select *, (sum(s) over () - coalesce(sum(cap) over before, 0)) / (sum(w) over () - coalesce(sum(w) over before, 0)) as l
  from weighted window before as (order by cap / w, k rows between unbounded preceding and 1 preceding)),
fixed as (select l as fixed from levels where l * w <= cap order by cap / w, k limit 1),
targets as (
  select k, s, least(cap, coalesce(fixed * w, cap)) as target from levels left join fixed on true),
wants as (
  select *, case when s > 0 then floor(target / s) else 0 end as whole, target - case when s > 0 then floor(target / s) else 0 end * s as wanted from targets),
rows_ as (
  select *, wanted - coalesce(sum(size) over (partition by k order by h rows between unbounded preceding and 1 preceding), 0) as still
  from sized join wants using (k))
select doc_id, size, s::bigint as source_size, target, case when s > 0 then size * (whole::bigint + (2 * still > size)::int) else 0 end::bigint as taken
from rows_
"""

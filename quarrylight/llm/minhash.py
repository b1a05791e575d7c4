"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document is the set of its distinct 5-word shingles (64-bit fingerprints, A-Z lower-cased); with fewer
words the whole sequence is the one member. A false equality of two members of one pair has a probability of
2**-64; what is compared over the whole corpus, the word sequence that names a class, has a digest of 128 bits. The sketch has T coordinates. Round i hashes every member to a
(bin, value) pair; a coordinate keeps the smallest (round, value). Rounds go on until all coordinates are
filled; rounds T..2T put every member into the one bin T..2T names, so that each coordinate fills whatever
the set. The expected work is O(T log T + |set|), and equal coordinates count as Jaccard trials with
concentration bounds of independent ones. BANDS bands of ROWS coordinates each give the candidates: at a
Jaccard similarity of 0.75 a pair shares no band with probability (1 - 0.75**5)**50, about 1.4e-6.

Equal word sequences are one class before anything is paired. Candidate links between classes go through hubs: each
bucket names one hub, members are verified against it, and components are joined; the next round takes
another hub for buckets that still hold several components; the last round pairs what is left across
components, so that no link is lost to the hubs. The first hub is the most central member, as a rule the text
that the others were copied from; of the first hubs that a class was compared with, the heaviest is its pivot.
Let x and y have the pivot h, with overlaps of o_x and o_y. They share at most min(o_x, o_y) members of h, so if
that is too little for a link, they must share members outside h. The last round finds such pairs by their
members outside the pivot, which copies with edits of their own rarely share; all other pairs by their buckets.
A pair must also be alike in the lowest bits of its T coordinates: DIFFER is five standard deviations above what
a similarity of 0.75 gives, and is what one of about 0.6 gives in the mean; first hubs may differ in HUB_DIFFER,
so that more classes get a pivot. Every link is confirmed on the full sets. No pairs within an already joined group are made, and nothing of all documents goes to the
driver.

Nulls: a null or empty text, or one without words, has an empty set and is linked with nothing. A null
doc_id takes part in its class but is never a component_id; a document in a component without any doc_id
has a null one; kept is false for a null doc_id. Repeated rows (equal doc_id and text) are returned as often as they came. Extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm import hashing
from quarrylight.llm.common import bounded, byte_texts, materialize, sub_batches

U = np.uint64
WIDTH, ROWS, BANDS, SHARE = 5, 5, 50, 75
T = ROWS * BANDS
#: A pair's coordinates are compared by their lowest PLANES bits, in four longs a plane. At a similarity of 0.75
#: 15/64 of the T codes differ in the mean; a candidate may differ in 5 standard deviations more.
PLANES = 4
DIFFER = int(T * 15 / 64 + 5 * (T * 15 * 49) ** 0.5 / 64)
#: The same for a similarity of 0.5, for the overlap with the first hubs.
HUB_DIFFER = int(T * 15 / 32 + 5 * (T * 15 * 17) ** 0.5 / 32)
_BITS = tuple(f"b{p}_{k}" for p in range(PLANES) for k in range(4))
#: Rounds that take one hub for each bucket before the rest is paired.
HUB_ROUNDS = 2
#: Text keys (16 bytes) are sent to all executors up to this count; beyond it the join shuffles.
BROADCAST_ROWS = 500_000
#: Tables of class ids are written in parts of about so many rows, and of no fewer than the cluster has cores.
PART_ROWS = 100_000
_SEEDS = hashing.mix(np.arange(1, T + 1, dtype=U) * U(0x9E3779B97F4A7C15))
_LOW = U(0xFFFFFFFF)


def shingle_set(data: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle fingerprints of one text, A-Z lower-cased."""
    return _set(hashing.words(data.lower()), width)


def _set(hashes: np.ndarray, width: int) -> np.ndarray:
    if len(hashes) == 0:
        return np.empty(0, dtype=U)
    if len(hashes) < width:
        return np.array([hashing.sequence(hashes)], dtype=U)
    return np.unique(hashing.windows(hashes, width))


def sketch(members: np.ndarray) -> np.ndarray:
    """T coordinates of (round << 32 | value) of a non-empty set. A later round never lowers a filled
    coordinate, so rounds may be done in blocks."""
    out = np.full(T, np.iinfo(np.uint64).max, dtype=U)
    done = 0
    while done < T:
        block = min(T - done, max(1, int(1.2 * T * np.log(T) / len(members)) + 1 if done == 0 else max(1, 2 * T // len(members))))
        for a in range(done, done + block, max(1, (1 << 16) // len(members))):
            b = min(done + block, a + max(1, (1 << 16) // len(members)))
            h = hashing.mix(members[None, :] ^ _SEEDS[a:b, None])
            bins = ((h >> U(32)) * U(T) >> U(32)).astype(np.intp).ravel()
            np.minimum.at(out, bins, ((np.arange(a, b, dtype=U)[:, None] << U(32)) | (h & _LOW)).ravel())
        done += block
        if int(out.max()) != np.iinfo(np.uint64).max:
            return out
    for k in np.flatnonzero(out == np.iinfo(np.uint64).max):
        out[k] = (U(T + int(k)) << U(32)) | ((hashing.mix(members ^ ~_SEEDS[k]) & _LOW).min())
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    grid = coordinates.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=U)
    for k in range(ROWS):
        key = hashing.mix(key + grid[:, k] * hashing._ORDER[k])
    return key.view(np.int64)


def low_bits(coordinates: np.ndarray) -> list[int]:
    """The lowest bits of each coordinate, plane by plane in four signed longs."""
    bits = np.zeros((PLANES, 256), dtype=np.uint8)
    for p in range(PLANES):
        bits[p, :T] = (coordinates >> U(p)) & U(1)
    return np.packbits(bits, axis=1).view(np.int64).ravel().tolist()


def text_class(data: bytes) -> bytes:
    """128-bit digest of the lower-cased word sequence: equal ones have equal sets."""
    return hashing.text_digest(data.lower())


_EMPTY = (None, 0, None, [None] * len(_BITS))


def _sketched(batches):
    """(row columns, text) -> class digest, n, bands; texts equal to a recent one are not done again."""
    recent: dict[bytes, tuple] = {}
    for batch in batches:
        ids, keys = batch.column("doc_id"), batch.column("text_key")
        cls, n, bands, bits = [], [], [], []
        for t in byte_texts(batch.column("text")):
            got = None
            if t:
                digest = hashlib.blake2b(t, digest_size=16).digest()
                got = recent.get(digest)
                if got is None:
                    members = shingle_set(t)
                    if len(members):
                        found = sketch(members)
                        got = (text_class(t), len(members), band_keys(found).tobytes(), low_bits(found))
                    else:
                        got = _EMPTY
                    if len(recent) >= 2000:
                        recent.clear()
                    recent[digest] = got
            else:
                got = _EMPTY
            cls.append(got[0])
            n.append(got[1])
            bands.append(got[2])
            bits.append(got[3])
        yield pa.RecordBatch.from_arrays([ids, keys, pa.array(cls, pa.binary()), pa.array(n, pa.int64()), pa.array(bands, pa.binary()), *(pa.array([b[k] for b in bits], pa.int64()) for k in range(len(_BITS)))], names=["doc_id", "text_key", "digest", "n", "bands", *_BITS])


def _unpacked(batches):
    """Band rows of classes: one row for each class and band."""
    for batch in batches:
        cls = np.asarray(batch.column("cls"))
        n = np.asarray(batch.column("n"))
        for a in range(0, len(cls), 2000):
            part = batch.column("bands").slice(a, 2000).to_pylist()
            keys = np.frombuffer(b"".join(part), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(cls[a : a + 2000], BANDS)), pa.array(np.repeat(n[a : a + 2000], BANDS))], names=["bucket", "cls", "n"])


def _sets(batches):
    for batch in batches:
        texts = byte_texts(batch.column("text"))
        for a, b in sub_batches(batch, texts):
            part = [t or b"" for t in texts[a:b]]
            digests, sets = [text_class(t) for t in part], [shingle_set(t).tobytes() for t in part]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(sets, pa.binary())], names=["digest", "members"])


def _within(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of a's members b has; both sorted and distinct, b not empty."""
    where = np.searchsorted(b, a)
    where[where == len(b)] = 0
    return b[where] == a


def linked(both: int, n_a: int, n_b: int, share: int = SHARE) -> bool:
    """100 * intersection >= share * union."""
    return 100 * both >= share * (n_a + n_b - both)


def _compared(batches):
    """a, b, weight, the size of the intersection and whether it links them."""
    for batch in batches:
        sets = [[np.frombuffer(x.as_buffer(), dtype=U) for x in batch.column(c)] for c in ("members_a", "members_b")]
        both = [int(np.count_nonzero(_within(a, b))) for a, b in zip(*sets)]
        link = [linked(k, len(a), len(b)) for k, a, b in zip(both, *sets)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "weight")), pa.array(both, pa.int64()), pa.array(link, pa.bool_())], names=["a", "b", "weight", "both", "link"])


def _outside(batches):
    """pivot, cls and one member of cls that the pivot lacks."""
    for batch in batches:
        for i in range(batch.num_rows):
            own = np.frombuffer(batch.column("members_a")[i].as_buffer(), dtype=U)
            rest = own[~_within(own, np.frombuffer(batch.column("members_b")[i].as_buffer(), dtype=U))].view(np.int64)
            same = [pa.array(np.full(len(rest), batch.column(c)[i].as_py(), dtype=np.int64)) for c in ("b", "a")]
            yield pa.RecordBatch.from_arrays([*same, pa.array(rest)], names=["pivot", "cls", "member"])


def _narrow(df: DataFrame, name: str, parts: int) -> DataFrame:
    """A written table of class ids in no more than so many files."""
    return materialize(df.coalesce(parts), name)


def components(links: DataFrame, parts: int) -> DataFrame:
    """(cls, root) for every end of a link: the smallest id reachable. Labels spread along links and are
    then looked up once more, so chains shorten by half in each round; each round is a written table."""
    both = _narrow(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "links", parts)
    labels = _narrow(both.groupBy(F.col("a").alias("cls")).agg(F.min("b").alias("least")).select("cls", F.least("cls", "least").alias("root")), "labels", parts)
    while True:
        near = both.join(labels.select(F.col("cls").alias("b"), F.col("root").alias("seen")), "b").groupBy(F.col("a").alias("cls")).agg(F.min("seen").alias("seen"))
        step = labels.join(near, "cls").select("cls", "root", F.least("root", "seen").alias("next"))
        jump = labels.select(F.col("cls").alias("next"), F.col("root").alias("further"))
        new = _narrow(step.join(jump, "next", "left").select("cls", F.col("root").alias("was"), F.least("next", F.coalesce("further", "next")).alias("root")), "labels", parts)
        if new.filter("root <> was").isEmpty():
            return new.select("cls", "root")
        labels = new.select("cls", "root")


def _extended(labels: DataFrame | None, links: DataFrame, parts: int) -> DataFrame:
    """labels (cls, root) after further links; only the roots that these touch are put together anew."""
    if labels is None:
        return components(links, parts)
    for end in ("a", "b"):
        links = links.join(labels.select(F.col("cls").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
    top = components(links.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")).filter("a <> b"), parts)
    moved = labels.join(top.select(F.col("cls").alias("root"), F.col("root").alias("new")), "root", "left").select("cls", F.coalesce("new", "root").alias("root"))
    fresh = top.join(labels.select("cls"), "cls", "left_anti")
    return _narrow(moved.union(fresh.select("cls", "root")), "labels", parts)


def _text_key():
    return F.unhex(F.md5(F.col("text").cast("binary")))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, class digest, n of every document and the bands, as a written table."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", _text_key())
    return materialize(bounded(source).mapInArrow(_sketched, "doc_id long, text_key binary, digest binary, n long, bands binary, " + ", ".join(f"{b} long" for b in _BITS)), "sketches")


def _alike(one: str, other: str, differ: int = DIFFER):
    words = ("(" + " | ".join(f"({one.format(b)} ^ {other.format(b)})" for b in _BITS[k::4]) + ")" for k in range(4))
    return F.expr(" + ".join(f"bit_count({w})" for w in words) + f" <= {differ}")


def _central(members: DataFrame) -> DataFrame:
    """bucket, hub, weight: the member that shares most places in buckets with others. The text that copies were made
    from is nearer to each of them than they are to one another, so it leads their buckets."""
    sizes = members.groupBy("bucket").agg(F.count("*").alias("held"))
    weights = members.select("bucket", "cls").join(sizes, "bucket").groupBy("cls").agg(F.sum("held").alias("weight"))
    return members.select("bucket", "cls").join(weights, "cls").groupBy("bucket").agg(F.max(F.struct("weight", "cls")).alias("top")).select("bucket", F.col("top.cls").alias("hub"), F.col("top.weight").alias("weight"))


def _drawn(members: DataFrame, k: int) -> DataFrame:
    """bucket, hub, weight (0): a member drawn by the round's own order."""
    mask = F.lit(int(_SEEDS[k].view(np.int64)))
    return members.groupBy("bucket").agg(F.min(F.col("cls").bitwiseXOR(mask)).bitwiseXOR(mask).alias("hub")).withColumn("weight", F.lit(0).cast("long"))


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    with_a = pairs.join(sets.select(F.col("cls").alias("a"), F.col("members").alias("members_a")), "a")
    return with_a.join(sets.select(F.col("cls").alias("b"), F.col("members").alias("members_b")), "b")


def _pivots(found: DataFrame, parts: int) -> DataFrame:
    """cls, pivot, overlap of the classes compared with first hubs; a hub that is its own pivot has a null overlap."""
    own = found.select(F.col("b").alias("cls"), "weight", F.col("b").alias("pivot"), F.lit(None).cast("long").alias("overlap")).distinct()
    near = found.select(F.col("a").alias("cls"), "weight", F.col("b").alias("pivot"), F.col("both").alias("overlap"))
    top = near.union(own).groupBy("cls").agg(F.max(F.struct("weight", "pivot", "overlap")).alias("top"))
    return _narrow(top.select("cls", "top.pivot", "top.overlap"), "pivots", parts)


def _left(now: DataFrame, pivots: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: the pairs across components that may be linked. Where 7 * min(overlaps) < 3 * (n_x + n_y), members
    of the common pivot can't link a pair, so it is found by the members outside it; else by a bucket."""
    now = now.join(pivots, "cls", "left").withColumn("overlap", F.when(F.col("pivot").isNotNull(), F.coalesce("overlap", "n")))
    now = materialize(now.select("bucket", "cls", "n", "root", "pivot", "overlap", *_BITS), "open")
    few = "7 * least(x.overlap, y.overlap) < 3 * (x.n + y.n)"
    fits = F.expr("x.root < y.root and 100 * least(x.n, y.n) >= 75 * greatest(x.n, y.n)") & _alike("x.{}", "y.{}")
    ends = (F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b"))
    x, y = now.alias("x"), now.alias("y")
    by_bucket = x.join(y, F.expr(f"x.bucket = y.bucket and not coalesce(x.pivot = y.pivot and {few}, false)") & fits).select(*ends)
    each = now.filter("pivot <> cls").drop("bucket").distinct()
    rest = _with_sets(each.select(F.col("cls").alias("a"), F.col("pivot").alias("b")), sets)
    rest = materialize(rest.select("a", "b", "members_a", "members_b").mapInArrow(_outside, "pivot long, cls long, member long"), "outside")
    shared = rest.groupBy("pivot", "member").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).filter("low <> high").select("pivot", "member")
    rest = materialize(rest.join(shared, ["pivot", "member"]).join(each.drop("pivot"), "cls"), "shared")
    x, y = rest.alias("x"), rest.alias("y")
    needed = F.expr("3 * (x.n + y.n) - 7 * least(x.overlap, y.overlap)").alias("needed")
    outside = x.join(y, F.expr(f"x.pivot = y.pivot and x.member = y.member and {few}") & fits).select(*ends, needed)
    outside = outside.groupBy("a", "b", "needed").agg(F.count("*").alias("more")).filter("7 * more >= needed").select("a", "b")
    return by_bucket.union(outside)


def near_links(docs: DataFrame, sketches: DataFrame) -> DataFrame | None:
    """(digest, root) of all classes with a confirmed link, or None. Inside, classes go by numbers that a written
    table gives them, so that no two of them ever share one."""
    every = sketches.filter("digest is not null").groupBy("digest").agg(F.first(F.struct("n", "bands", "text_key", *_BITS)).alias("c")).select("digest", "c.*")
    every = materialize(every.withColumn("cls", F.monotonically_increasing_id()), "classes")
    single = every.select("cls", "n", "bands")
    rows = materialize(single.mapInArrow(_unpacked, "bucket long, cls long, n long"), "bands")
    shared = rows.groupBy("bucket").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).filter("low <> high").select("bucket")
    bits = every.select("cls", *_BITS)
    members = materialize(rows.join(shared, "bucket").join(bits, "cls"), "members")
    wanted = materialize(every.join(members.select("cls").distinct(), "cls", "left_semi").select("cls", "digest", "text_key"), "wanted")
    count = wanted.count()
    if count == 0:
        return None
    keys = wanted.select("text_key")
    texts = docs.select(F.col("text").cast("string").alias("text")).withColumn("text_key", _text_key())
    picked = texts.join(F.broadcast(keys) if count <= BROADCAST_ROWS else keys, "text_key").dropDuplicates(["text_key"])
    sets = bounded(picked.select("text")).mapInArrow(_sets, "digest binary, members binary")
    sets = materialize(sets.join(wanted.select("digest", "cls"), "digest").select("cls", "members"), "sets")
    # Pairs, links and labels are no more rows than the bucket members.
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, members.count() // PART_ROWS)
    labels, tested = None, None
    for k in range(HUB_ROUNDS + 1):
        now = members
        if labels is not None:
            now = members.join(labels, "cls", "left").select("bucket", "cls", "n", *_BITS, F.coalesce("root", "cls").alias("root"))
            open_ = now.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("bucket")
            now = now.join(open_, "bucket")
            now = materialize(now, "open") if k < HUB_ROUNDS else now
        else:
            now = members.withColumn("root", F.col("cls"))
        if k < HUB_ROUNDS:
            hubs = _central(now) if k == 0 else _drawn(now, k)
            pairs = now.join(hubs, "bucket").filter("cls <> hub").select("cls", "hub", "weight", "root", "n", *_BITS).distinct()
            other = members.groupBy(F.col("cls").alias("hub")).agg(F.min("n").alias("n_hub"), *(F.min(b).alias(f"h{b}") for b in _BITS))
            if labels is not None:
                other = other.join(labels.select(F.col("cls").alias("hub"), F.col("root").alias("root_hub")), "hub", "left")
            else:
                other = other.withColumn("root_hub", F.col("hub"))
            pairs = pairs.join(other, "hub").filter(F.col("root") != F.coalesce("root_hub", "hub"))
            pairs = pairs.filter("100 * least(n, n_hub) >= 75 * greatest(n, n_hub)").filter(_alike("{}", "h{}", DIFFER if k else HUB_DIFFER))
            pairs = pairs.select(F.col("cls").alias("a"), F.col("hub").alias("b"), "weight")
        else:
            pairs = _left(now, pivots, sets).withColumn("weight", F.lit(0).cast("long"))
        pairs = pairs.distinct()
        if tested is not None:
            pairs = pairs.withColumns({"low": F.least("a", "b"), "high": F.greatest("a", "b")}).join(tested, ["low", "high"], "left_anti").select("a", "b", "weight")
        pairs = _narrow(pairs, "pairs", parts)
        ends = pairs.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
        tested = ends if tested is None else tested.union(ends)
        compared = _with_sets(pairs, sets).select("a", "b", "weight", "members_a", "members_b")
        compared = materialize(bounded(compared).mapInArrow(_compared, "a long, b long, weight long, both long, link boolean"), "compared")
        if k == 0:
            pivots = _pivots(compared, parts)
        found = compared.filter("link").select("a", "b")
        if found.isEmpty():
            continue
        labels = _extended(labels, found, parts)
    return None if labels is None else labels.join(every.select("cls", "digest"), "cls").select("digest", "root")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text)."""
    sketches = classes(docs)
    labels = near_links(docs, sketches)
    least = sketches.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("least"))
    if labels is not None:
        rooted = materialize(least.join(labels, "digest", "left"), "rooted")
        smallest = rooted.filter("root is not null").groupBy("root").agg(F.min("least").alias("smallest"))
        component = F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("smallest"))
        least = rooted.join(smallest, "root", "left").select("digest", component.alias("component_id"))
    else:
        least = least.select("digest", F.col("least").alias("component_id"))
    rows = sketches.select("doc_id", F.col("n").alias("n_shingles"), "digest")
    out = rows.join(least, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))

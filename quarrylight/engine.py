"""The engine over one root folder: index, publish, search, exact search, windows, cleanup, archive."""

from __future__ import annotations

import json
import threading
import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quarrylight.errors import EngineError
from quarrylight.functions import expressions as E
from quarrylight.operators import exact, inventory, objects, prepare, ranked, results
from quarrylight.operators.windows import Session, Window
from quarrylight.plans.generation import GENERATION_TABLES, Root, drop_generation, expired, faults, offsets
from quarrylight.schemas import BROADCAST_KEYS, CLASS_WEIGHTS, MAX_UNIT_BYTES, PART_BYTES, PREFERRED_UNIT_BYTES
from quarrylight.sources import files
from quarrylight.streaming.watch import watch

TABLES = ("sources", "preparations")
#: Seconds that a retired generation and its objects stay for readers that have it pinned.
GRACE_S = 600.0


class Engine:
    """max_sources and max_bytes are off by default: the limits of one process have no place on a cluster."""

    def __init__(self, spark: SparkSession, root: str, max_sources: int | None = None, max_bytes: int | None = None, deadline_s: float | None = None):
        self.spark, self.root = spark, Root(spark, root)
        self.max_sources, self.max_bytes, self.deadline_s = max_sources, max_bytes, deadline_s

    # the saved state

    def initialize(self) -> "Engine":
        self.root.initialize()
        return self

    def inspect(self) -> str:
        return self.root.state()

    def discard_incomplete(self) -> None:
        self.root.discard_incomplete()

    def settings(self, preferred: int | None = None, maximum: int | None = None) -> dict:
        """The saved preparation settings; defaults only where there are none. A change bumps the wanted revision."""
        m = self.root.manifest()
        now = m["settings"] or {"preferred": PREFERRED_UNIT_BYTES, "maximum": MAX_UNIT_BYTES, "revision": 1}
        want = now | {k: v for k, v in (("preferred", preferred), ("maximum", maximum)) if v}
        if not 1 <= want["preferred"] <= want["maximum"] <= MAX_UNIT_BYTES:
            raise EngineError("SETTINGS_INVALID")
        if m["settings"] != want:
            want["revision"] = now["revision"] + (m["settings"] is not None)
            self.root.write_manifest(m | {"settings": want, "wanted_revision": m["wanted_revision"] + 1}, m)
        return want

    def _snapshot(self, m: dict, name: str) -> DataFrame | None:
        return self.spark.read.parquet(self.root.at(name, f"snapshot={m['snapshot']}")) if m["snapshot"] else None

    def selections(self, path: str | None = None) -> list[dict]:
        saved = self.root.manifest()["selections"]
        out = saved if path is None else [s for s in saved if s["path"] == path]
        if not out:
            raise EngineError("INDEX_NO_SELECTION")
        return out

    def admit(self, path: str, kind: str = "tree") -> bool:
        """Idempotent; a new selection bumps the wanted revision."""
        m = self.root.manifest()
        one = {"path": path.rstrip("/"), "kind": kind}
        if one in m["selections"]:
            return False
        self.root.write_manifest(m | {"selections": [*m["selections"], one], "wanted_revision": m["wanted_revision"] + 1}, m)
        return True

    def objects_path(self, m: dict) -> str:
        """The folder of the object store; a sweep writes the next one and the manifest names it."""
        return self.root.at("objects", f"version={m['objects']}")

    def _objects(self, m: dict) -> DataFrame | None:
        return self.spark.read.parquet(self.objects_path(m)) if self.root.exists("objects", f"version={m['objects']}") else None

    # write path

    def index(self, path: str | None = None, kind: str = "tree", publish: bool = True) -> dict:
        """Scan, keep bytes, prepare, publish. Saved work that still holds is reused. Without publish, what is kept is served
        from the next publication on."""
        if path is not None:
            self.admit(path, kind)
        chosen = self.selections(path.rstrip("/") if path else None)
        scopes = [(s["path"], s["kind"]) for s in chosen]
        scratch, own = f"scan-{uuid.uuid4().hex}", (self.root.path.removeprefix("file://"),)

        def scan(k: int) -> DataFrame:
            return files.union([files.scan(self.spark, s["path"], s["kind"], self.root.at(scratch, k, i), own) for i, s in enumerate(chosen)])

        try:
            found = scan(0)
            if not files.too_large(found).isEmpty():
                raise EngineError("SOURCE_TOO_LARGE")
            observed = self._observed(found)
            saved = self._snapshot(self.root.manifest(), "sources")
            present = None
            if saved is not None:  # what isn't admitted any more but still there is no removal
                asked = saved.filter(inventory.in_scopes(F.col("path"), scopes)).join(found.select("path"), "path", "left_anti")
                present = files.existing(asked)
            changed = self._save(observed, scopes, present)
            files.stable(found, scan(1))
        finally:
            self.root.delete(scratch)
        return (self.publish() if publish else {"published": False}) | {"changed": changed}

    def _observed(self, found: DataFrame) -> DataFrame:
        read = files.contents(found)
        return read.select("path", "modified", "content", E.digest(F.col("content")).alias("digest"), F.col("length").alias("bytes"))

    def retain_file(self, path: str) -> dict:
        """One file without a selection."""
        return {"changed": self._save(self._observed(files.scan(self.spark, path, "file", self.root.at("scan"))), [], None)}

    def index_rows(self, rows: DataFrame) -> dict:
        """Sources that are table rows: path and content (bytes). They replace all earlier ones."""
        observed = rows.select("path", F.lit(None).cast("timestamp").alias("modified"), "content", E.digest(F.col("content")).alias("digest"), F.octet_length("content").cast("long").alias("bytes"))
        changed = self._save(observed, [("/", "tree")], None)
        return self.publish() | {"changed": changed}

    def _save(self, observed: DataFrame, scopes, present) -> int:
        """Write the next snapshot of sources and preparations; returns the number of changes."""
        if self.root.manifest()["settings"] is None:
            self.settings()
        m = self.root.manifest()
        s = m["settings"]
        empty = self.spark.createDataFrame([], "source_id string, path string, row_revision long, digest string, bytes long")
        saved = self._snapshot(m, "sources")
        changes = inventory.diff(empty if saved is None else saved, observed, scopes, present).cache()
        try:
            inventory.preflight(changes, self.max_sources, self.max_bytes)
            n = changes.filter("action in ('new', 'changed', 'removed')").count()
            prep = self._snapshot(m, "preparations")
            fits = None
            if prep is not None:
                # An outcome follows from bytes and settings alone, so a gap is only tried again when one of them changes.
                fits = prep.filter((F.col("preferred") == s["preferred"]) & (F.col("maximum") == s["maximum"]))
            if n == 0 and saved is not None and saved.join(fits, "digest", "left_anti").isEmpty():
                return 0
            known, fresh = self._objects(m), observed.select("path", "content")
            paths = changes.filter("action in ('new', 'changed')").select("path")
            if saved is not None:  # else every row is new, and no bytes are dealt out to find that
                fresh = fresh.join(paths, "path", "left_semi")
            if saved is None or not paths.isEmpty():
                new = objects.stored(fresh, "source")
                if known is not None:
                    new = new.join(known.select("digest"), "digest", "left_anti")
                self.root.write(new.sortWithinPartitions("digest"), "objects", f"version={m['objects']}", mode="append")
            next_ = m["snapshot"] + 1
            kept = changes.filter("action <> 'removed'")
            kept = kept.select(E.digest(F.encode("path", "UTF-8")).alias("source_id"), "path", "row_revision", "digest", "bytes", E.source_class(F.col("path")).alias("source_class"))
            self.root.write(kept, "sources", f"snapshot={next_}")
            sources = self.spark.read.parquet(self.root.at("sources", f"snapshot={next_}"))
            todo = sources.select("digest").distinct() if fits is None else sources.select("digest").distinct().join(fits.select("digest"), "digest", "left_anti")
            done = None if fits is None else fits.join(sources.select("digest").distinct(), "digest", "left_semi")
            if done is None or not todo.isEmpty():
                bytes_ = self._objects(m).select("digest", "content")
                if fits is not None or known is not None:  # else the store holds what is to be prepared and nothing else
                    bytes_ = bytes_.join(todo, "digest", "left_semi")
                made = prepare.prepare(bytes_.withColumnRenamed("digest", "source_id"), s["preferred"], s["maximum"])
                made = made.select(F.col("source_id").alias("digest"), F.lit(s["preferred"]).alias("preferred"), F.lit(s["maximum"]).alias("maximum"), F.when(F.col("gap").isNull(), "ready").otherwise("gap").alias("state"), "gap", "units")
                done = made if done is None else made.unionByName(done)
            self.root.write(done, "preparations", f"snapshot={next_}")
            self.root.write_manifest(m | {"snapshot": next_, "wanted_revision": m["wanted_revision"] + 1}, m)
            return n
        finally:
            changes.unpersist()

    def publish(self) -> dict:
        """Build a generation from the current snapshot unless the served one is of this revision."""
        m = self.root.manifest()
        if m["current"] and m["current"]["wanted_revision"] == m["wanted_revision"]:
            return {"generation": m["current"]["generation"], "published": False}
        sources, prep = self._snapshot(m, "sources"), self._snapshot(m, "preparations")
        if sources is None:
            raise EngineError("PUBLICATION_EMPTY")
        if not sources.join(prep, "digest", "left_anti").isEmpty():
            raise EngineError("PUBLICATION_SOURCE_NOT_PREPARED")
        n = m["next_generation"]
        self.root.write_manifest(reserved := m | {"next_generation": n + 1}, m)
        try:
            current = self._build(n, m, sources, prep)
        except Exception:
            drop_generation(self.root, n)  # an abandoned build leaves nothing behind
            raise
        retired = [*m["retired"], *([[m["current"]["generation"], time.time()]] if m["current"] else [])]
        self.root.write_manifest(reserved | {"current": current, "retired": retired}, reserved)
        return {"generation": n, "published": True}

    def _build(self, n: int, m: dict, sources: DataFrame, prep: DataFrame) -> dict:
        """Write and check the tables of generation n."""
        written = lambda name: self.spark.read.parquet(self.root.at(name, f"generation={n}"))
        write = lambda df, name: self.root.write(df, name, f"generation={n}")
        counted = prep.select("digest", "state", "gap", F.coalesce(F.size("units"), F.lit(0)).cast("long").alias("units"))
        columns = ("source_id", "path", "source_class", "row_revision", "digest", "bytes", "state", "gap", "units")
        write(sources.join(counted, "digest").select(*columns), "gen_sources")
        gen_sources = written("gen_sources")
        placed = gen_sources.filter("state = 'ready'").select("source_id", "path", "source_class", "digest", "bytes", F.col("units").alias("n"))
        placed = placed.join(offsets(placed.select("source_id", "n")), "source_id")
        # Units are spans of objects; their text is not stored again.
        rows = placed.join(prep.select("digest", F.posexplode("units").alias("unit", "u")), "digest")
        ordinal = F.col("offset") + F.col("unit")
        staged = rows.select("source_id", "path", "source_class", "digest", "bytes", F.col("unit").cast("long").alias("unit"), "u.*", ordinal.alias("ordinal"), E.point_id(n, ordinal).alias("point_id"))
        seen = Observation()
        facts = (F.count("*").alias("n"), F.sum(F.xxhash64(*sorted(staged.columns)).cast("decimal(20,0)")).alias("h"))
        write(staged.observe(seen, *facts).sortWithinPartitions("ordinal"), "units")
        units = written("units")
        if (back := units.agg(*facts).first().asDict()) != seen.get:
            raise EngineError("PUBLICATION_READBACK_FAILED")
        held = self._objects(m).select("digest", "content")
        size = gen_sources.agg(F.sum("bytes")).first()[0] or 0
        slices, texts_read = objects.slices(size), 0
        cores = self.spark.sparkContext.defaultParallelism
        parts = (size // len(slices) // PART_BYTES // cores + 1) * cores  # no core waits for a last few
        firsts = units.filter("unit = 0").select("digest", "source_class", "bytes", F.col("ordinal").alias("source_id"))
        # Bytes are dealt out to their units in slices, one after the other, so that the disk holds the shuffle files of one.
        for inside in slices:
            dealt = [df.filter(inside).repartition(parts, "digest") for df in (firsts, prep.select("digest", "units"), held)]
            texts_read += self._index_slice(n, m, parts, *dealt)
            del dealt  # or the disk would hold them besides the next slice's
            self.root.tidy()
        if texts_read != back["n"]:
            raise EngineError("PUBLICATION_GRAPH_INVALID")
        index = written("postings")
        write(index.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf")).sortWithinPartitions("term"), "terms")
        self.root.tidy()  # its shuffle files would lie there while the graph is checked
        if not faults(units, gen_sources).isEmpty():
            raise EngineError("PUBLICATION_GRAPH_INVALID")
        points = back["n"]
        tokens = written("terms").agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("tokens")).first()["tokens"]
        self._canary(index, units, held, points, tokens)
        counts = gen_sources.agg(F.count("*").alias("s"), F.count_if(F.col("state") == "gap").alias("g")).first()
        return {"generation": n, "wanted_revision": m["wanted_revision"], "sources": counts["s"], "gaps": counts["g"], "points": points, "tokens": tokens, "snapshot": m["snapshot"]}

    def _index_slice(self, n: int, m: dict, parts: int, firsts: DataFrame, units: DataFrame, held: DataFrame) -> int:
        """Append the postings of some digests to generation n, in `parts` files at most; returns the number of units read."""
        read = Observation()
        # Joins deal out to the session's shuffle partitions, if those are more; each file would hold its terms once more.
        ready = firsts.join(units, "digest").join(held.hint("merge"), "digest").coalesce(parts)
        # Saved units that don't fit their bytes, or have none, are not read here, so that there are less than were staged.
        ready = prepare.inspected(ready, m["settings"]["maximum"]).withColumnRenamed("fault", "gap")
        texts = prepare.unit_rows(ready, "source_class").withColumn("text", F.decode("body", "UTF-8")).withColumnRenamed("source_id", "source")
        # Sorted by term in each part of the texts: a term's postings are a few pages of every part, and nothing is dealt
        # out by term. They name a source by the ordinal of its first unit, so that sources are in the order of their ids.
        index = ranked.postings(texts.observe(read, F.count("*").alias("n")), "source", "unit", "source_class")
        self.root.write(index.sortWithinPartitions("term"), "postings", f"generation={n}", mode="append")
        return read.get["n"]

    def _canary(self, index: DataFrame, units: DataFrame, held: DataFrame, points: int, tokens: int) -> None:
        """A posting's term must be one of its unit's and find the unit with a positive score. Without postings no unit may
        have a letter or digit."""
        row = index.head(1)
        if not row:
            texts = units.select("digest").distinct().join(held, "digest").select(F.decode("content", "UTF-8").alias("text"))
            if not texts.filter(F.col("text").rlike(r"[\p{L}\p{N}]")).isEmpty():
                raise EngineError("PUBLICATION_CANARY_FAILED")
            return
        term, source, ordinal = row[0]["term"], row[0]["source"], row[0]["unit"]
        unit = (units.filter(F.col("ordinal") == source + ordinal).select("digest", "start", "end").head(1) or [None])[0]
        body = unit and held.filter(F.col("digest") == unit["digest"]).select(F.expr(f"substring(content, {unit['start'] + 1}, {unit['end'] - unit['start']})").alias("body")).head(1)
        found = ranked.scores_from_postings(index, [term], points, tokens / points, "source", "unit")
        if not body or term not in E.query_terms(bytes(body[0]["body"]).decode()) or found.filter((F.col("source") == source) & (F.col("unit") == ordinal) & (F.col("score") > 0)).isEmpty():
            raise EngineError("PUBLICATION_CANARY_FAILED")

    # read path

    def pin(self) -> "View":
        m = self.root.manifest()
        if not m["current"]:
            raise EngineError("QUERY_NOT_PUBLISHED")
        return View(self, m["current"], m["wanted_revision"], self.objects_path(m))

    def open_verified(self) -> "View":
        """pin(), after a full check of the generation."""
        view = self.pin()
        if not faults(view.units, view.sources).isEmpty():
            raise EngineError("PUBLICATION_GRAPH_INVALID")
        return view

    def search(self, query: str, limit: int = 10, source_class: str | None = None) -> list[dict]:
        return self._timed(lambda: self.pin().search(query, limit, source_class))

    def exact(self, literal, mode: str = "decoded", limit: int = 10, **scope) -> dict:
        return self._timed(lambda: self.pin().exact(literal, mode, limit, **scope))

    def _timed(self, work):
        """Jobs of a query are cancelled when its time is over."""
        if self.deadline_s is None:
            return work()
        group = f"query-{threading.get_ident()}-{id(work)}"
        sc, over = self.spark.sparkContext, threading.Event()
        sc.setJobGroup(group, "query", True)
        timer = threading.Timer(self.deadline_s, lambda: (over.set(), sc.cancelJobGroup(group)))
        timer.start()
        try:
            return work()
        except Exception as e:
            raise EngineError("QUERY_DEADLINE") if over.is_set() else e
        finally:
            timer.cancel()

    def session(self, **options) -> Session:
        """One retained answer, asked for by requests of increasing ids."""
        return Session(self, **options)

    def watch(self, interval_s: float = 30.0, **options) -> int:
        return watch(self.index, interval_s, **options)

    # maintenance

    def _marks(self, m: dict, kept: list) -> DataFrame:
        refs = [self._snapshot(m, "sources").select(F.lit("source").alias("kind"), "digest", "bytes")] if m["snapshot"] else []
        for n in [*([m["current"]["generation"]] if m["current"] else []), *(n for n, _ in kept)]:
            if self.root.exists("gen_sources", f"generation={n}"):
                refs.append(self.spark.read.parquet(self.root.at("gen_sources", f"generation={n}")).select(F.lit("source").alias("kind"), "digest", "bytes"))
        if not refs:
            raise EngineError("COLLECT_NOTHING_MARKED")
        return objects.marks(*refs)

    def collect_objects(self, grace_s: float = GRACE_S) -> dict:
        """Verify every marked object, delete the generations whose grace is over, and leave the objects that nothing marks out
        of the store's next version. The manifest names the version in one step, so a crash leaves a store that can be read;
        the version before it stays until the next sweep, for readers that have it open."""
        m = self.root.manifest()
        over, kept = expired(m, time.time(), grace_s)
        marked, held = self._marks(m, kept), self._objects(m)
        status = {r["status"]: r["n"] for r in objects.statuses(marked, held).groupBy("status").agg(F.count("*").alias("n")).collect()}
        if set(status) - {"ok"}:
            raise EngineError("COLLECT_INTEGRITY_FAILURE", str(status))
        if over:  # first, so that the disk doesn't hold them besides the store's next version
            self.root.write_manifest(now := m | {"retired": kept}, m)
            m = now
            for n, _ in over:
                drop_generation(self.root, n)
        unmarked, version = objects.unreferenced(held.select("kind", "digest"), marked), m["objects"]
        gone = unmarked.count()
        if gone:
            version += 1
            self.root.tidy()
            self.root.write(objects.without(held, unmarked, gone).sortWithinPartitions("digest"), "objects", f"version={version}")
            self.root.write_manifest(m | {"objects": version}, m)
            if version >= 2:
                self.root.delete("objects", f"version={version - 2}")
        return {"marked": sum(status.values()), "verified": status.get("ok", 0), "deleted": gone, "preserved": sum(status.values())}

    def export(self, out: str) -> dict:
        """The served generation and its objects; the manifest, written last, completes the archive."""
        m, target = self.root.manifest(), Root(self.spark, out)
        if not m["current"]:
            raise EngineError("QUERY_NOT_PUBLISHED")
        if target.state() != "absent":
            raise EngineError("ARCHIVE_EXISTS")
        n, snapshot = m["current"]["generation"], m["current"]["snapshot"]
        sources = self.spark.read.parquet(self.root.at("gen_sources", f"generation={n}"))
        refs, held = sources.select(F.lit("source").alias("kind"), "digest", "bytes").distinct(), self._objects(m)
        if not objects.statuses(refs, held).filter("status <> 'ok'").isEmpty():
            raise EngineError("ARCHIVE_OBJECT_MISSING")
        self.root.tidy()
        others = objects.unreferenced(held.select("kind", "digest"), refs)
        kept = objects.without(held, others, others.count())
        target.write(kept.select("kind", "digest", "bytes", "content", E.object_name(F.col("kind"), F.col("digest")).alias("name")), "objects", "version=0", mode="error")
        for name in GENERATION_TABLES:
            target.write(self.spark.read.parquet(self.root.at(name, f"generation={n}")), name, f"generation={n}", mode="error")
        for name in TABLES:
            target.write(self.spark.read.parquet(self.root.at(name, f"snapshot={snapshot}")), name, f"snapshot={snapshot}", mode="error")
        if not faults(self.spark.read.parquet(target.at("units", f"generation={n}")), sources).isEmpty():
            raise EngineError("ARCHIVE_INVALID")
        self.root.tidy()
        target.write_manifest(m | {"retired": [], "objects": 0, "snapshot": snapshot, "wanted_revision": m["current"]["wanted_revision"]})
        return m["current"]

    def import_archive(self, archive: str, take: bool = False) -> dict:
        """Verify an archive, make it this root's content, and compare what is served here with it. take: an archive that
        nobody needs afterwards is moved, so that it doesn't lie on the disk twice."""
        other = Engine(self.spark, archive)
        if self.root.state() != "absent":
            raise EngineError("ROOT_ALREADY_INITIALIZED")
        view = other.open_verified()
        refs = view.sources.select(F.lit("source").alias("kind"), "digest", "bytes").distinct()
        if not objects.statuses(refs, other._objects(other.root.manifest())).filter("status <> 'ok'").isEmpty():
            raise EngineError("ARCHIVE_OBJECT_MISSING")
        names = ("source_id", "path", "row_revision", "digest", "bytes", "state", "units")
        if take:
            facts = (F.count("*").alias("n"), F.sum(F.xxhash64(*names).cast("decimal(20,0)")).alias("h"))
            there, current = view.sources.agg(*facts).first(), view.current
            self.root.tidy()
            self.root.take(archive)
            copied = self.open_verified()
            if copied.units.count() != current["points"] or copied.sources.agg(*facts).first() != there:
                raise EngineError("ARCHIVE_INVALID")
            self.root.tidy()
            return current
        current = other.export(self.root.path)
        copied = self.open_verified()
        there, here = view.sources.select(*names), copied.sources.select(*names)
        if copied.units.count() != current["points"] or not there.exceptAll(here).union(here.exceptAll(there)).isEmpty():
            raise EngineError("ARCHIVE_INVALID")
        return current


class View:
    """One pinned generation; later publications do not change it."""

    def __init__(self, engine: Engine, current: dict, wanted: int, objects_path: str):
        self.engine, self.current, self.wanted = engine, current, wanted
        self.generation = current["generation"]
        read = lambda name: engine.spark.read.parquet(engine.root.at(name, f"generation={self.generation}"))
        self.sources, self.units, self.postings, self.terms = map(read, GENERATION_TABLES)
        self.objects = engine.spark.read.parquet(objects_path).select("digest", "content")

    def summary(self, selected: DataFrame | None = None) -> dict:
        r = (self.sources if selected is None else selected).agg(F.count("*").alias("n"), F.count_if(F.col("state") == "gap").alias("g")).first()
        return self._summary(r["n"], r["g"])

    def _summary(self, selected: int, gaps: int) -> dict:
        s = self.current
        if self.wanted < s["wanted_revision"]:
            raise EngineError("CONTROL_CORRUPT")
        out = {"published_wanted_revision": s["wanted_revision"], "published_sources": s["sources"], "published_preparation_gaps": s["gaps"]}
        control = {"status": "known", "wanted_revision": self.wanted, "known_control_lag": self.wanted > s["wanted_revision"]}
        return out | {"selected_sources": selected, "selected_preparation_gaps": gaps, "control": control}

    def exact(self, literal, mode: str = "decoded", limit: int = 10, ids=None, prefix=None, source_class=None, source_info: bool = False) -> dict:
        """Facts over all selected sources and the first items. One pass verifies the bytes and counts, object by object, so
        that facts are joined to the sources and not bytes; another finds the first sources that hold the literal, if there
        are any, and only those are read for items. What is too large to go out loses the saved paths that
        source_info asked for, then whole items."""
        selected = exact.select(self.sources, ids, prefix, source_class)
        data, held = exact.check(literal, limit), self.objects
        if not (ids is None and prefix is None and source_class is None):
            wanted = selected.select("digest").distinct()
            if wanted.count() <= BROADCAST_KEYS:
                held = held.join(F.broadcast(wanted), "digest", "left_semi")
        judged = exact.counted(held.withColumn("bad", E.digest(F.col("content")) != F.col("digest")), data)
        rows = selected.select("source_id", "digest", "state").join(judged, "digest", "left").withColumn("there", F.coalesce("there", F.lit(False)))
        if mode == "decoded":
            rows = rows.withColumn("there", F.col("there") & (F.col("state") == "ready"))
        bad, gaps = F.count_if("bad").alias("bad"), F.count_if(F.col("state") == "gap").alias("gaps")
        facts = exact.facts(rows, limit, bad, gaps).first().asDict()
        if facts.pop("bad"):
            raise EngineError("OBJECT_INTEGRITY_FAILURE")
        found = [r.asDict() for r in self._items(rows, literal, limit).collect()] if facts["items"] else []
        if source_info and found:
            shown = self._infos({i["source_id"] for i in found})
            found = [{**i, "source_info": shown[i["source_id"]]} for i in found]
        answer = facts | {"generation": self.generation, "items": found, "summary": self._summary(facts["selected_sources"], facts.pop("gaps"))}
        return results.fit(answer, keep_items=True)

    def _items(self, rows: DataFrame, literal, limit: int) -> DataFrame:
        """The first items of rows (source_id, digest, there, hits). A source that has any has one at least, so that they
        are in the first `limit` of these sources."""
        first = rows.filter("not there or hits > 0").orderBy("source_id").limit(limit).select("source_id", F.when(F.col("there"), F.col("digest")).alias("digest")).collect()
        held = self.objects.filter(F.col("digest").isin(sorted({r["digest"] for r in first if r["digest"]})))
        named = self.engine.spark.createDataFrame(first, "source_id string, digest string")  # at most 64 rows
        return exact.items(F.broadcast(named).join(held, "digest", "left").select("source_id", "content"), literal, limit)

    def _infos(self, ids: set[str]) -> dict[str, dict]:
        """The saved locators of at most 64 sources."""
        rows = self.sources.filter(F.col("source_id").isin(sorted(ids))).select("source_id", results.source_info(F.col("path")).alias("info")).collect()
        return {r["source_id"]: r["info"].asDict() for r in rows}

    def search(self, query: str, limit: int = 10, source_class: str | None = None) -> list[dict]:
        """Hits with rank, score, evidence and a verified excerpt; a hit whose bytes are missing keeps its rank as a gap.
        Only the postings of the terms, the units of the hits and their objects are read."""
        terms = ranked.check(query, limit)
        if not terms or not self.current["points"]:
            return []
        best = self.best(terms, limit, source_class)
        if not best:
            return []
        units = self.units.filter(F.col("ordinal").isin(list(best)))
        rows = {r["ordinal"]: r for r in units.collect()}  # a row a hit
        held = self._verified(rows)
        out = []
        for key, b in sorted(best.items(), key=lambda x: x[1]["rank"]):
            if key not in rows:
                raise EngineError("EVIDENCE_UNIT_MISSING")
            r = rows[key]
            names = ("source_id", "path", "source_class", "unit", "point_id", "digest", "start", "end", "line_start", "line_end", "starts_at_line_boundary", "ends_at_line_boundary")
            item = {"rank": b["rank"], "score": b["score"], **{k: r[k] for k in names}}
            if key not in held:
                out.append(item | {"kind": "gap", "code": "object_missing"})
                continue
            if held[key] is None:
                raise EngineError("OBJECT_INTEGRITY_FAILURE")
            a, e = ranked.excerpt(held[key], E.excerpt_terms(query))
            out.append(item | {"kind": "hit", "excerpt": {"start": r["start"] + a, "end": r["start"] + e, "text": held[key][a:e].decode()}})
        return out[: results.fitting(out)]

    def best(self, terms: list[str], limit: int, source_class: str | None = None) -> dict[int, dict]:
        """score and rank of the best units, by their ordinals, in order."""
        counts = {r["term"]: r["df"] for r in self.terms.filter(F.col("term").isin(terms)).collect()}  # a row a query term
        if not counts:
            return {}
        index = self.postings if source_class is None else self.postings.filter(F.col("source_class") == source_class)
        avg = self.current["tokens"] / self.current["points"]
        scored = ranked.scores_from_postings(index, list(counts), self.current["points"], avg, "source", "unit", "source_class", counts=counts)
        found = ranked.best(scored, limit, source="source").collect()  # at most 64 rows
        return {r["source"] + r["unit"]: {"score": r["score"], "rank": i} for i, r in enumerate(found, 1)}

    def _verified(self, rows: dict) -> dict:
        """The bytes of units by ordinal; None where the object isn't the one named. Objects that are missing have no entry."""
        spans = [{k: r[k] for k in ("ordinal", "digest", "start", "end")} for r in rows.values()]  # at most 64
        kind = "array<struct<ordinal:long,digest:string,start:long,end:long>>"
        wanted = F.filter(F.from_json(F.lit(json.dumps(spans)), kind), lambda x: x["digest"] == F.col("digest"))
        held = self.objects.filter(F.col("digest").isin(sorted({r["digest"] for r in rows.values()})))
        held = held.select("content", (E.digest(F.col("content")) == F.col("digest")).alias("fine"), F.explode(wanted).alias("u"))
        body = F.expr("substring(content, cast(u.start as int) + 1, cast(u.end - u.start as int))")
        got = held.select("u.ordinal", F.when(F.col("fine"), body).alias("body")).collect()
        return {r["ordinal"]: r["body"] and bytes(r["body"]) for r in got}

    def read(self, source_id: str) -> bytes:
        one = self.sources.filter(F.col("source_id") == source_id).select("digest").head(1)
        rows = self.objects.filter(F.col("digest") == one[0]["digest"]).select("content", (E.digest(F.col("content")) == F.col("digest")).alias("fine")).head(1) if one else []
        if not rows:
            raise EngineError("OBJECT_MISSING")
        if not rows[0]["fine"]:
            raise EngineError("OBJECT_INTEGRITY_FAILURE")
        return bytes(rows[0]["content"])

    def unit(self, source_id: str, ordinal: int) -> dict:
        """One prepared unit; a source without units is `empty`, another ordinal is refused."""
        row = self.sources.filter(F.col("source_id") == source_id).head(1)
        if not row:
            raise EngineError("SOURCE_NOT_PUBLISHED")
        if row[0]["state"] == "gap":
            return {"state": "gap", "gap": row[0]["gap"]}
        if row[0]["units"] == 0:
            return {"state": "empty"}
        found = self.units.filter((F.col("source_id") == source_id) & (F.col("unit") == ordinal)).head(1)
        if not found:
            raise EngineError("UNIT_OUT_OF_RANGE")
        body = self._verified({ordinal: found[0]})
        if not body:
            raise EngineError("OBJECT_MISSING")
        (data,) = body.values()
        if data is None:
            raise EngineError("OBJECT_INTEGRITY_FAILURE")
        return {"state": "ready", **found[0].asDict(), "text": data.decode()}

    def window(self, query: str | None = None, literal=None, limit: int = 10, mode: str = "decoded", scope: dict | None = None, **options) -> Window:
        """A retained answer of a ranked query or an exact literal; scope: the other arguments of search() or exact()."""
        scope = scope or {}
        items = self.search(query, limit, **scope) if query is not None else self.exact(literal, mode, limit, **scope)["items"]
        return Window(items, self.generation, self.read, **options)


__all__ = ["CLASS_WEIGHTS", "Engine", "View"]

"""The engine's operators over the test tables, each with the SQL that DuckDB must agree with."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Window as SqlWindow
from pyspark.sql import functions as F

from quarrylight.engine import Engine
from quarrylight.errors import EngineError
from quarrylight.functions import expressions as E
from quarrylight.operators import exact, inventory, objects, prepare, ranked, results
from quarrylight.operators.windows import Window
from quarrylight.plans.generation import faults, with_points
from quarrylight.sources import tables

LITERAL, ABSENT, QUERY, PREFIX, PREFERRED, HARD = "tion ", "no such literal", "the token worthless trash", "/corpus/en", 256, 1024
TERMS = E.query_terms(QUERY)
QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def docs(spark, sf_dir):
    return tables.from_documents(tables.spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")))


def units(spark, sf_dir):
    return prepare.prepare(docs(spark, sf_dir).select("source_id", "source_class", "content"), PREFERRED, HARD)


SOURCES = """
sources as (
  select doc_id as source_id, '/corpus/' || lang || '/' || source || '/' || case when doc_id % 7 = 0 then 'vendor/' else '' end || doc_id || case when doc_id % 5 = 0 then '.md' else '.txt' end as path,
         case when doc_id % 7 = 0 then 'vendor' when doc_id % 5 = 0 then 'documentation' else 'primary' end as source_class, text
  from documents)"""
FACTS = """
select count(*) as selected_sources, count(text) as scanned_sources, sum(strlen(text))::bigint as scanned_bytes, sum({m})::bigint as matches, count(*) - count(text) as missing_sources,
  least(64, sum({m}))::bigint as items, true as scan_complete, sum({m}) = 0 as complete_negative, case when sum({m}) > 64 then 'output_limit' else 'complete' end as stop from sources"""
OCCURS = "(len(string_split(text, '{}')) - 1)"


@query(f"with {SOURCES} {FACTS.format(m=OCCURS.format(LITERAL))}")
def exact_raw_summary(spark, sf_dir):
    return exact.summary(docs(spark, sf_dir), LITERAL.encode())


@query(f"with {SOURCES} {FACTS.format(m=OCCURS.format(ABSENT))}")
def exact_negative_summary(spark, sf_dir):
    return exact.summary(docs(spark, sf_dir), ABSENT.encode())


@query(f"with {SOURCES} {FACTS.format(m=OCCURS.format(LITERAL))} where starts_with(path, '{PREFIX}/') and source_class = 'primary'")
def exact_scoped_summary(spark, sf_dir):
    ready = prepare.prepare(exact.select(docs(spark, sf_dir), prefix=PREFIX, source_class="primary").select("source_id", "content"), PREFERRED, HARD)
    return exact.summary(ready.withColumn("content", F.when(F.col("gap").isNull(), F.col("content"))), LITERAL)


@query(f"""
with {SOURCES},
parts as (select source_id, text, string_split(text, '{LITERAL}') as p from sources where contains(text, '{LITERAL}')),
places as (select source_id, text, list_transform(range(1, len(p)), lambda i: strlen(array_to_string(p[1:i], '{LITERAL}'))) as starts, p from parts),
flat as (select source_id, text, unnest(starts) as start, unnest(list_transform(range(1, len(p)), lambda i: array_to_string(p[1:i], '{LITERAL}'))) as before from places)
select source_id, start::bigint as start, (start + {len(LITERAL)})::bigint as "end", (1 + length(before) - length(replace(before, chr(10), '')))::bigint as line, '{LITERAL.encode().hex()}' as hex, '{LITERAL}' as ascii
from flat order by source_id, start limit 64""")
def exact_items_topn(spark, sf_dir):
    return exact.items(docs(spark, sf_dir), LITERAL, 64).select("source_id", "start", "end", "line", "hex", "ascii")


@query("select item_id as literal_id, count(d.doc_id) as sources, coalesce(sum(len(string_split(d.text, b.text)) - 1), 0)::bigint as matches from benchmark b left join documents d on contains(d.text, b.text) group by item_id")
def exact_many_literals(spark, sf_dir):
    """All benchmark texts, in blocks of bounded size, each block in one pass."""
    wanted = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("literal_id"), "text")
    return exact.count_all(docs(spark, sf_dir), wanted)


@query(f"with {SOURCES} select source_class, count(*) as sources, sum(strlen(text))::bigint as bytes from sources group by source_class")
def scope_class_counts(spark, sf_dir):
    return docs(spark, sf_dir).groupBy("source_class").agg(F.count("*").alias("sources"), F.sum(F.octet_length("content")).alias("bytes"))


@query(f"with {SOURCES} select source_id, path, source_class from sources where path = '{PREFIX}' or starts_with(path, '{PREFIX}/')")
def scope_prefix_select(spark, sf_dir):
    return exact.select(docs(spark, sf_dir), prefix=PREFIX).select("source_id", "path", "source_class")


LINES = r"""
lines as (
  select doc_id as source_id, unnest(regexp_extract_all(text, '[^\r\n]*(?:\r\n|\n|\r)|[^\r\n]+')) as line, unnest(range(len(regexp_extract_all(text, '[^\r\n]*(?:\r\n|\n|\r)|[^\r\n]+')))) as line_index from documents),
spans as (select source_id, line_index, line, sum(strlen(line)) over (partition by source_id order by line_index)::bigint as e from lines)"""


@query(f"""with {LINES} select source_id, line_index, e - strlen(line) as start, e as "end", e - strlen(line) + strlen(regexp_replace(line, '(\\r\\n|\\n|\\r)$', '')) as content_end from spans""")
def line_spans(spark, sf_dir):
    return prepare.line_spans(docs(spark, sf_dir))


UNITS = f"""
{LINES},
ends as (select source_id, list(e order by e) as ends from spans group by source_id),
texts as (select doc_id as source_id, strlen(text) as n, hex(encode(text)) as h, ends from documents join ends on doc_id = source_id),
grown as (
  select source_id, 0::bigint as s, 0::bigint as e, -1 as unit from texts
  union all
  select g.source_id, g.e, case
      when n - g.e <= {PREFERRED} then n
      when list_max(list_filter(ends, lambda x: x <= g.e + {PREFERRED} and x > g.e)) is not null then list_max(list_filter(ends, lambda x: x <= g.e + {PREFERRED} and x > g.e))
      when list_min(list_filter(ends, lambda x: x > g.e)) <= g.e + {HARD} then list_min(list_filter(ends, lambda x: x > g.e))
      else list_max(list_filter([g.e + {PREFERRED}, g.e + {PREFERRED} - 1, g.e + {PREFERRED} - 2, g.e + {PREFERRED} - 3], lambda p: substr(h, (2 * p + 1)::bigint, 1) not in ('8', '9', 'A', 'B')))
    end, g.unit + 1
  from grown g join texts t using (source_id) where g.e < n),
units as (
  select source_id, unit::bigint as unit, s as start, e as "end", len(list_filter(ends, lambda x: x <= s)) as line_start, len(list_filter(ends, lambda x: x < e)) + 1 as line_end,
         s = 0 or list_contains(ends, s) as starts_at_line_boundary, list_contains(ends, e) as ends_at_line_boundary, h
  from grown join texts using (source_id) where unit >= 0)"""


@query(f"with recursive {UNITS} select * exclude (h) from units")
def unit_spans(spark, sf_dir):
    return prepare.unit_rows(units(spark, sf_dir)).drop("body")


@query("""
with made as (
  select doc_id * 4 + k as source_id, case k when 0 then null when 1 then case when strlen(text) > 20000 then 'input_too_large' else 'binary_content' end
    when 2 then case when strlen(text) + 8 > 20000 then 'input_too_large' when 8 >= greatest(4, ceil((strlen(text) + 8) / 100.0)) then 'binary_content' end
    when 3 then case when strlen(text) + 1 > 20000 then 'input_too_large' else 'invalid_utf8' end end as gap, strlen(text) as n, k
  from documents, range(4) r(k))
select case when k = 0 and n > 20000 then 'input_too_large' else coalesce(gap, 'ready') end as outcome, count(*) as sources from made group by all""")
def preparation_gaps(spark, sf_dir):
    """Each text as it is, with a NUL in place of its last byte, with 8 control bytes more, and with an invalid byte more."""
    d = docs(spark, sf_dir)
    kinds = F.array(F.col("content"), F.expr("concat(substring(content, 1, octet_length(content) - 1), X'00')"), F.expr("concat(content, X'0102030405060708')"), F.expr("concat(content, X'FF')"))
    made = d.select("source_id", F.posexplode(kinds).alias("k", "content")).select((F.col("source_id") * 4 + F.col("k")).alias("source_id"), "content")
    return prepare.prepare(made, 16384, 65536, max_input=20000).groupBy(F.coalesce("gap", F.lit("ready")).alias("outcome")).agg(F.count("*").alias("sources"))


SPLIT = r"list_filter(string_split(replace(lower(regexp_replace(regexp_replace(r, '(\p{Ll})(\p{Lu})', '\1 \2', 'g'), '(\p{Lu})(\p{Lu}\p{Ll})', '\1 \2', 'g')), '_', ' '), ' '), lambda p: p <> '')"
TOKENS = rf"""
runs as (select doc_id as source_id, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')) as r from documents),
parts as (select source_id, {SPLIT} as p, lower(r) as whole from runs),
toks as (select source_id, unnest(case when len(p) > 1 then list_append(p, whole) else p end) as term from parts)"""


@query(f"with {TOKENS} select source_id, term, count(*) as tf from toks group by all")
def tokens(spark, sf_dir):
    return ranked.postings(docs(spark, sf_dir), "source_id").drop("dl")


@query(f"with {TOKENS} select term, count(distinct source_id) as df, count(*) as tf from toks group by all")
def doc_freq(spark, sf_dir):
    return ranked.postings(docs(spark, sf_dir), "source_id").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@query(f"with {TOKENS} select (select count(*) from documents) as n, count(*)::bigint as tokens, round(count(*) / (select count(*) from documents), 6) as avgdl from toks")
def corpus_stats(spark, sf_dir):
    return ranked.statistics(docs(spark, sf_dir)).withColumn("avgdl", F.round("avgdl", 6))


BM25 = f"""
{SOURCES}, {TOKENS},
dls as (select source_id, count(*)::double as dl from toks group by all),
tfs as (select source_id, term, count(*)::double as tf from toks where term in ({', '.join(f"'{t}'" for t in TERMS)}) group by all),
dfs as (select term, count(*)::double as df from tfs group by all),
facts as (select count(*)::double as n, (select sum(dl) from dls) / count(*) as avgdl from sources),
scored as (
  select source_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as score
  from tfs join dfs using (term) join dls using (source_id), facts group by source_id),
weighted as (select source_id, source_class, score * case source_class when 'vendor' then 0.35 when 'documentation' then 0.65 else 1.0 end as score from scored join sources using (source_id))"""


@query(f"with {BM25} select source_id, round(score, 6) as score from scored")
def bm25_scores(spark, sf_dir):
    return ranked.scores(docs(spark, sf_dir), TERMS).select("source_id", F.round("score", 6).alias("score"))


@query(f"with {BM25} select source_id, round(score, 6) as score, row_number() over (order by round(score, 9) desc, source_id)::int as rank from weighted qualify rank <= 64")
def ranked_topk(spark, sf_dir):
    scored = ranked.scores(docs(spark, sf_dir), TERMS).withColumn("unit", F.lit(0))
    scored = scored.withColumn("score", F.round(F.col("score") * ranked.class_weight(F.col("source_class")), 9) / ranked.class_weight(F.col("source_class")))
    return ranked.ranked(scored, 64).select("source_id", F.round("score", 6).alias("score"), "rank")


UNIT_BM25 = rf"""
recursive {UNITS},
bodies as (select source_id, unit, decode(unhex(substr(h, (2 * start + 1)::bigint, (2 * ("end" - start))::bigint))) as body from units),
{SOURCES.strip()},
runs as (select source_id, unit, unnest(regexp_extract_all(body, '[\p{{L}}\p{{N}}_]+')) as r from bodies),
parts as (select source_id, unit, {SPLIT} as p, lower(r) as whole from runs),
toks as (select source_id, unit, unnest(case when len(p) > 1 then list_append(p, whole) else p end) as term from parts),
dls as (select source_id, unit, count(*)::double as dl from toks group by all),
tfs as (select source_id, unit, term, count(*)::double as tf from toks where term in ({', '.join(f"'{t}'" for t in TERMS)}) group by all),
dfs as (select term, count(*)::double as df from tfs group by all),
facts as (select count(*)::double as n, (select sum(dl) from dls) / count(*) as avgdl from bodies),
scored as (
  select source_id, unit, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as score
  from tfs join dfs using (term) join dls using (source_id, unit), facts group by all),
weighted as (select source_id, unit, round(score, 9) * case source_class when 'vendor' then 0.35 when 'documentation' then 0.65 else 1.0 end as score from scored join sources using (source_id)),
own as (select *, row_number() over (partition by source_id order by score desc, unit) as k from weighted),
best as (select source_id, unit, score from own where k <= 2 order by score desc, source_id, unit limit 64)"""


VIEW_BEST = UNIT_BM25.replace("order by score desc, source_id, unit limit 64", "order by score desc, sha256(path), unit limit 64")
VIEW_BEST = VIEW_BEST.replace("from own where k <= 2", "from own join sources using (source_id) where k <= 2")


def _best(spark, sf_dir, source_class=None):
    """The served generation and its 64 best units by the stored postings, with their spans."""
    view = engine(spark, sf_dir).pin()
    found = view.best(TERMS, 64, source_class)  # at most 64, by whose ordinals the scan of the units is pruned
    rows = spark.createDataFrame([(k, b["score"], b["rank"]) for k, b in found.items()], "ordinal long, score double, rank int")
    return view, view.units.filter(F.col("ordinal").isin(list(found))).join(F.broadcast(rows), "ordinal")


@query(f"with {VIEW_BEST} select path, unit, round(score, 6) as score, row_number() over (order by score desc, sha256(path), unit)::int as rank from best join sources using (source_id)")
def ranked_diverse(spark, sf_dir):
    return _best(spark, sf_dir)[1].select("path", "unit", F.round("score", 6).alias("score"), "rank")


CLASS_BEST = VIEW_BEST.replace("from own join sources using (source_id) where k <= 2", "from own join sources using (source_id) where k <= 2 and source_class = 'documentation'")


@query(f"with {CLASS_BEST} select path, unit, round(score, 6) as score, row_number() over (order by score desc, sha256(path), unit)::int as rank from best join sources using (source_id)")
def ranked_class(spark, sf_dir):
    """The hits of one source class; the terms' frequencies are those of all classes."""
    return _best(spark, sf_dir, "documentation")[1].select("path", "unit", F.round("score", 6).alias("score"), "rank")


def _bodies(spark, sf_dir):
    """The best units with the bytes that the object store holds for them."""
    view, best = _best(spark, sf_dir)
    wanted = [r["digest"] for r in best.select("digest").collect()]  # at most 64
    held = view.objects.filter(F.col("digest").isin(wanted)).join(F.broadcast(best), "digest")
    return held.withColumn("body", F.expr("substring(content, cast(start as int) + 1, cast(end - start as int))")).drop("content")


@query(f"""with {VIEW_BEST} select path, unit, u.start, u."end", u.line_start, u.line_end, sha256(encode(body)) as body_digest
from best join units u using (source_id, unit) join bodies using (source_id, unit) join sources using (source_id)""")
def evidence_join(spark, sf_dir):
    best = _bodies(spark, sf_dir)
    return best.select("path", "unit", "start", "end", "line_start", "line_end", E.digest(F.col("body")).alias("body_digest"))


EXCERPTS = f"""
bodied as (select source_id, unit, strlen(body) as n, hex(encode(body)) as h, translate(body, '{E.UPPER}', '{E.LOWER}') as low from best join bodies using (source_id, unit)),
placed as (
  select *, case {' '.join(f"when contains(low, '{t}') then greatest(0, strlen(string_split(low, '{t}')[1]) - (512 - {len(t)}) // 2)" for t in E.excerpt_terms(QUERY))} else 0 end as wanted from bodied),
begun as (
  select *, case when n <= 512 then 0 else list_min(list_filter([least(wanted, n - 512) + i for i in range(4)], lambda p: p >= n or substr(h, (2 * p + 1)::bigint, 1) not in ('8', '9', 'A', 'B'))) end as s from placed),
shown as (
  select source_id, unit, s::bigint as excerpt_start,
         list_max(list_filter([least(n, s + 512) - i for i in range(4)], lambda p: p >= n or substr(h, (2 * p + 1)::bigint, 1) not in ('8', '9', 'A', 'B')))::bigint as excerpt_end from begun)"""


@query(f"with {VIEW_BEST}, {EXCERPTS} select path, unit, excerpt_start, excerpt_end from shown join sources using (source_id)")
def excerpts(spark, sf_dir):
    """Spans shown of all hits' units: whole short ones, else around the first of the longest terms found."""
    terms = E.excerpt_terms(QUERY)
    span = F.udf(lambda body: ranked.excerpt(bytes(body), terms), "struct<excerpt_start:long,excerpt_end:long>")
    return _bodies(spark, sf_dir).select("path", "unit", span("body").alias("span")).select("path", "unit", "span.*")


@query(f"with recursive {UNITS} select source_id, unit, lower('0000000000000001' || lpad(hex(row_number() over (order by source_id, unit) - 1), 16, '0')) as point_id from units")
def point_ids(spark, sf_dir):
    return with_points(prepare.unit_rows(units(spark, sf_dir)).drop("body"), 1).select("source_id", "unit", "point_id")


@query("select 'v1-source-' || sha256(encode(text)) as name, any_value(strlen(text))::bigint as bytes from documents group by all")
def object_dedup(spark, sf_dir):
    return objects.stored(docs(spark, sf_dir), "source").select("name", "bytes")


def _refs(frame):
    return frame.select(F.lit("source").alias("kind"), E.digest(F.col("content")).alias("digest"), F.octet_length("content").cast("long").alias("bytes"))


@query("select distinct sha256(encode(text)) as digest, strlen(text)::bigint as bytes from documents where lang <> 'de'")
def reachable_objects(spark, sf_dir):
    d = docs(spark, sf_dir)
    return objects.marks(_refs(d.filter(E.below(F.col("path"), "/corpus/en"))), _refs(d.filter(~E.below(F.col("path"), "/corpus/de")))).drop("kind")


@query("select distinct sha256(encode(text)) as digest from documents where sha256(encode(text)) not in (select sha256(encode(text)) from documents where lang <> 'de')")
def unreferenced_objects(spark, sf_dir):
    d = docs(spark, sf_dir)
    return objects.unreferenced(objects.stored(d, "source"), objects.marks(_refs(d.filter(~E.below(F.col("path"), "/corpus/de"))))).select("digest")


def _window(spark, sf_dir):
    """A window over the first 64 exact items, with the contents of their sources, of which there are no more."""
    d = docs(spark, sf_dir)
    items = [r.asDict() for r in exact.items(d, LITERAL, 64).collect()]
    read = {r["source_id"]: bytes(r["content"]) for r in d.filter(F.col("source_id").isin([i["source_id"] for i in items])).select("source_id", "content").collect()}
    return Window(items, 1, read.__getitem__)


FIRST = f"""
parts as (select doc_id as source_id, text, string_split(text, '{LITERAL}') as p from documents where contains(text, '{LITERAL}')),
flat as (select source_id, text, unnest(list_transform(range(1, len(p)), lambda i: strlen(array_to_string(p[1:i], '{LITERAL}'))))::bigint as start from parts),
first as (select *, start + {len(LITERAL)} as "end", row_number() over (order by source_id, start)::int - 1 as position, hex(encode(text)) as h, strlen(text) as n from flat qualify position < 64)"""
INSIDE = "substr(h, (2 * ({}) + 1)::bigint, 1) in ('8', '9', 'A', 'B')"


@query(f'with {FIRST} select position, source_id, start, "end" from first where position between 16 and 31')
def window_page(spark, sf_dir):
    """The second page of 16 of a window, after the first was acknowledged."""
    w = _window(spark, sf_dir)
    w.ack(0, w.page(16)["next"])
    page = w.page(16)
    rows = [(page["first"] + i, x["source_id"], x["start"], x["end"]) for i, x in enumerate(page["items"])]
    return spark.createDataFrame(rows, "position int, source_id long, start long, end long")


@query(f"""
with {FIRST},
sides as (select *, greatest(start - 16, 0) as a, least("end" + 16, n) as b from first),
judged as (select *, (a < n and {INSIDE.format('a')}) or (b < n and {INSIDE.format('b')}) as broken from sides)
select position, source_id, case when broken then 'WINDOW_UTF8_BOUNDARY' else 'ok' end as outcome,
       case when not broken then decode(unhex(substr(h, (2 * a + 1)::bigint, (2 * (start - a))::bigint))) end as before,
       case when not broken then decode(unhex(substr(h, (2 * "end" + 1)::bigint, (2 * (b - "end"))::bigint))) end as after from judged""")
def expand_context(spark, sf_dir):
    """Sixteen bytes on each side of every item of a window, as far as its source goes; refused inside a character."""
    w, rows = _window(spark, sf_dir), []
    w.page(64)
    for i, x in enumerate(w.items):
        try:
            got = w.expand(i, min(16, x["start"]), min(16, len(w._read(x["source_id"])) - x["end"]))
            rows.append((i, x["source_id"], "ok", got["before"][1], got["after"][1]))
        except EngineError as e:
            rows.append((i, x["source_id"], e.code, None, None))
    return spark.createDataFrame(rows, "position int, source_id long, outcome string, before string, after string")


OVERLAP = "thth"


@query(f"with {SOURCES} {FACTS.format(m=f"len(list_filter(range(1, length(text)), lambda i: substr(text, i, {len(OVERLAP)}) = '{OVERLAP}'))")}")
def exact_overlap_summary(spark, sf_dir):
    """A literal that overlaps itself: every place counts."""
    return exact.summary(docs(spark, sf_dir), OVERLAP)


@query(f"""
with {FIRST},
lined as (select *, coalesce(list_max(list_filter(range(0, start), lambda i: substr(h, 2 * i + 1, 2) = '0A')) + 1, 0) as line_start from first),
begun as (select *, list_min(list_filter([greatest(start - 128, line_start) + i for i in range(4)], lambda p: not {INSIDE.format('p')})) as a from lined),
bounded as (select *, least(n, a + 512) as most from begun),
ended as (select *, list_min(list_filter(range(start, most), lambda i: substr(h, 2 * i + 1, 2) = '0A')) + 1 as lf from bounded)
select position, source_id, a::bigint as excerpt_start,
       coalesce(lf, list_max(list_filter([most - i for i in range(4)], lambda p: p >= n or not {INSIDE.format('p')})))::bigint as excerpt_end from ended""")
def exact_line_excerpts(spark, sf_dir):
    """The lines shown around the first items."""
    found = exact.items(docs(spark, sf_dir), LITERAL, 64).select("source_id", "start", "excerpt_start", "excerpt_end")
    return found.withColumn("position", F.row_number().over(SqlWindow.orderBy("source_id", "start")) - 1).drop("start")  # at most 64 rows


@query(f"""with {SOURCES}, held as (select source_id, case when source_id % 7 <> 0 then text end as text from sources),
flat as (select source_id, 'gap' as kind, null::bigint as start from held where text is null
  union all select source_id, 'match', unnest(list_transform(range(1, len(string_split(text, '{LITERAL}'))), lambda i: strlen(array_to_string(string_split(text, '{LITERAL}')[1:i], '{LITERAL}'))))::bigint from held where contains(text, '{LITERAL}'))
select * from flat order by source_id, start nulls first limit 64""")
def exact_missing_items(spark, sf_dir):
    """Sources without content are items of their own, in order."""
    d = docs(spark, sf_dir).withColumn("content", F.when(F.col("source_id") % 7 != 0, F.col("content")))
    return exact.items(d, LITERAL, 64).select("source_id", "kind", "start")


@query(f"""with {SOURCES}, held as (select case when source_id % 7 <> 0 then text end as text from sources)
select count(*) as selected_sources, count(text) as scanned_sources, sum(strlen(text))::bigint as scanned_bytes, sum({OCCURS.format(ABSENT)})::bigint as matches, count(*) - count(text) as missing_sources,
  least(64, count(*) - count(text))::bigint as items, false as scan_complete, false as complete_negative, case when count(*) - count(text) > 64 then 'output_limit' else 'complete' end as stop from held""")
def exact_missing_summary(spark, sf_dir):
    """Nothing found, but not everything read: no claim of absence."""
    d = docs(spark, sf_dir).withColumn("content", F.when(F.col("source_id") % 7 != 0, F.col("content")))
    return exact.summary(d, ABSENT)


@query(f"with {SOURCES} select path, source_class from sources order by path limit 100 offset 100")
def inventory_page(spark, sf_dir):
    """The second page of 100 of the inventory, from behind the first page's last row."""
    d = docs(spark, sf_dir).select("path", "source_class")
    last = inventory.page(d, 100, key="path").agg(F.max("path")).first()[0]
    return inventory.page(d, 100, last, key="path")


@query("""select sha256(encode(text)) as digest, case when doc_id % 3 = 0 then 'prepared' else 'source' end as kind, strlen(text)::bigint * 20000 as bytes from documents
where doc_id % 5 <> 0 and doc_id % 7 <> 0 and strlen(text)::bigint * 20000 <= case when doc_id % 3 = 0 then 67108864 else 8388608 end""")
def sweep_candidates(spark, sf_dir):
    """Entries of an object folder that a sweep may touch: some names are cut, some have other letters or bytes behind."""
    d, kind = docs(spark, sf_dir), F.when(F.col("source_id") % 3 == 0, "prepared").otherwise("source")
    name = E.object_name(kind, E.digest(F.col("content")))
    name = F.when(F.col("source_id") % 5 == 0, F.concat(name, F.lit("\n"))).when(F.col("source_id") % 7 == 0, F.upper(name)).otherwise(name)
    return objects.candidates(d.select(name.alias("name"), (F.octet_length("content").cast("long") * 20000).alias("bytes")))


@query(f"""with {SOURCES},
named as (select source_id, case when source_id % 11 = 0 then path[2:] when source_id % 50 = 1 then path || repeat('x', 70000) when source_id % 17 = 0 then 'file:' || path else path end as p from sources)
select source_id, case when source_id % 11 = 0 or strlen(p) > 65536 then 'unavailable' else 'available' end as status, case when not (source_id % 11 = 0 or strlen(p) > 65536) then p end as saved_path_hint,
  case when source_id % 11 = 0 then 'invalid_locator' when strlen(p) > 65536 then 'output_limit' end as reason, 'not_checked' as live_status from named""")
def source_infos(spark, sf_dir):
    """Saved locators as they are shown: relative paths and paths of more than 64 KiB are not."""
    path, i = F.col("path"), F.col("source_id")
    path = F.when(i % 11 == 0, F.substring(path, 2, 1 << 20)).when(i % 50 == 1, F.concat(path, F.repeat(F.lit("x"), 70000))).when(i % 17 == 0, F.concat(F.lit("file:"), path)).otherwise(path)
    shown = docs(spark, sf_dir).select("source_id", path.alias("path"))
    return shown.select("source_id", results.source_info(F.col("path")).alias("info")).select("source_id", "info.*")


@query(f"""with parts as (select doc_id as source_id, string_split(text, '{LITERAL}') as p from documents where contains(text, '{LITERAL}')),
flat as (select source_id, unnest(list_transform(range(1, len(p)), lambda i: strlen(array_to_string(p[1:i], '{LITERAL}'))))::bigint as start from parts),
first as (select *, row_number() over (order by source_id, start)::int - 1 as position from flat qualify position < 64),
sized as (select *, sum(strlen('{{"source_id":' || source_id || ',"start":' || start || '}}') + 1) over (order by position) as s from first)
select position, source_id, start from sized where s - 1 + 2 <= 1000""")
def output_fit(spark, sf_dir):
    """As many whole items as 1000 bytes of JSON hold."""
    items = [{"source_id": r["source_id"], "start": r["start"]} for r in exact.items(docs(spark, sf_dir), LITERAL, 64).collect()]
    rows = [(i, x["source_id"], x["start"]) for i, x in enumerate(items[: results.fitting(items, 1000)])]
    return spark.createDataFrame(rows, "position int, source_id long, start long")


@query(f"""with {SOURCES},
kept as (select * from sources where source_id % 3 <> 0),
gone as (select distinct text from sources where text not in (select text from kept))
select (select count(*) from kept) as sources, (select count(distinct text) from kept) as marked, (select count(distinct text) from kept) as verified, (select count(*) from gone) as deleted,
  (select sum({OCCURS.format(LITERAL)}) from kept)::bigint as matches, (select count(*) from sources where source_id % 3 = 0) as changed""")
def sweep_after_removal(spark, sf_dir):
    """A root that lost a third of its sources: the next generation, and the objects left after a sweep."""
    folder, d = _shared(spark), docs(spark, sf_dir)
    made = Engine(spark, f"{folder}/store").initialize()
    made.settings(PREFERRED, HARD)
    made.index_rows(d.select("path", "content"))
    changed = made.index_rows(d.filter("source_id % 3 <> 0").select("path", "content"))["changed"]
    swept = made.collect_objects(grace_s=0)
    row = (made.open_verified().sources.count(), swept["marked"], swept["verified"], swept["deleted"], made.exact(LITERAL)["matches"], changed)
    made.root.delete_path(folder)
    return spark.createDataFrame([row], "sources long, marked long, verified long, deleted long, matches long, changed long")


@query(f"""with {SOURCES},
one as (select path, 2::bigint as row_revision, sha256(encode('other bytes')) as digest from sources where source_id = (select min(source_id) from sources))
select path, 1::bigint as row_revision, sha256(encode(text)) as digest from sources where path not in (select path from one) union all select * from one""")
def inventory_upsert(spark, sf_dir):
    """One row set to other bytes by compare-and-set, after a stale expectation was refused."""
    d = docs(spark, sf_dir)
    path = d.orderBy("source_id").first()["path"]
    saved = d.select("path", F.lit(1).cast("long").alias("row_revision"), E.digest(F.col("content")).alias("digest"), F.octet_length("content").cast("long").alias("bytes"))
    other = spark.range(1).select(E.digest(F.encode(F.lit("other bytes"), "UTF-8"))).first()[0]
    try:
        inventory.upsert(saved, path, 7, other, 11)
    except EngineError as e:
        return inventory.upsert(saved, path, 1, other, 11)[0].drop("bytes") if e.code == "SOURCE_STALE" else None


@query("select count(*) as n, sum(strlen(text))::bigint as bytes from documents")
def inventory_totals(spark, sf_dir):
    n, size = inventory.totals(docs(spark, sf_dir).select("path", F.octet_length("content").cast("long").alias("bytes")))
    return spark.createDataFrame([(n, size)], "n long, bytes long")


@query("""select distinct sha256(encode(text)) as digest, case when doc_id % 11 = 0 then 'missing' when doc_id % 9 = 0 then 'integrity_failure' else 'ok' end as status
from (select min(doc_id) as doc_id, text from documents group by text)""")
def verified_reads(spark, sf_dir):
    """Objects of which some are missing and some hold other bytes."""
    d = docs(spark, sf_dir).groupBy("content").agg(F.min("source_id").alias("source_id"))
    refs = d.select("source_id", F.lit("source").alias("kind"), E.digest(F.col("content")).alias("digest"), F.octet_length("content").cast("long").alias("bytes"))
    bytes_ = F.when(F.col("source_id") % 9 == 0, F.expr("concat(content, X'00')")).otherwise(F.col("content"))
    held = d.filter("source_id % 11 <> 0").select(F.lit("source").alias("kind"), E.digest(F.col("content")).alias("digest"), bytes_.alias("content"))
    return objects.read(refs.drop("source_id"), held).select("digest", "status")


@query(f"""with recursive {UNITS},
counted as (select source_id, count(*) as n, max("end") filter (unit = 0) as first_end from units group by source_id)
select source_id, case when source_id % 23 = 0 then 'digest' when source_id % 13 = 0 and n > 1 or source_id % 10 = 0 and first_end > 1 then 'coverage'
  when source_id % 17 = 0 then 'line_range' when source_id % 19 = 0 then 'flags' end as fault
from counted where source_id % 23 = 0 or source_id % 13 = 0 and n > 1 or source_id % 10 = 0 and first_end > 1 or source_id % 17 = 0 or source_id % 19 = 0""")
def saved_layouts(spark, sf_dir):
    """Saved units that don't hold with their bytes: some moved by a byte, some left out, some with other lines or flags."""
    rows = units(spark, sf_dir).filter("gap is null and size(units) > 0")
    rows = rows.withColumn("digest", F.when(F.col("source_id") % 23 == 0, E.digest(F.lit(""))).otherwise(E.digest(F.col("content"))))
    rows = rows.withColumn("bytes", F.octet_length("content").cast("long"))
    first = F.col("units")[0]
    changed = (
        F.when((F.col("source_id") % 13 == 0) & (F.size("units") > 1), F.expr("filter(units, (u, i) -> i <> 1)"))
        .when((F.col("source_id") % 10 == 0) & (first["end"] > 1), F.expr("transform(units, (u, i) -> named_struct('start', u.start, 'end', u.end - if(i = 0, 1, 0), 'line_start', u.line_start, 'line_end', u.line_end, 'starts_at_line_boundary', u.starts_at_line_boundary, 'ends_at_line_boundary', u.ends_at_line_boundary))"))
        .when(F.col("source_id") % 17 == 0, F.expr("transform(units, u -> named_struct('start', u.start, 'end', u.end, 'line_start', u.line_start, 'line_end', u.line_end + 1, 'starts_at_line_boundary', u.starts_at_line_boundary, 'ends_at_line_boundary', u.ends_at_line_boundary))"))
        .when(F.col("source_id") % 19 == 0, F.expr("transform(units, u -> named_struct('start', u.start, 'end', u.end, 'line_start', u.line_start, 'line_end', u.line_end, 'starts_at_line_boundary', not u.starts_at_line_boundary, 'ends_at_line_boundary', u.ends_at_line_boundary))"))
        .otherwise(F.col("units"))
    )
    return prepare.inspected(rows.withColumn("units", changed), HARD).filter("fault is not null").select("source_id", "fault")


@query(f"""with recursive {UNITS},
kept as (select source_id, unit, start, "end" from units where not (source_id % 10 = 0 and unit = 1)),
chained as (select *, coalesce(lag("end") over (partition by source_id order by unit), 0) as before, row_number() over (partition by source_id order by unit) - 1 as number from kept)
select source_id, 'unit_chain' as fault from chained where start <> before or unit <> number
union all select source_id, 'unit_count' from units where source_id % 10 = 0 and unit = 1""")
def generation_faults(spark, sf_dir):
    """The faults of a generation that lost the second unit of some sources."""
    every = with_points(prepare.unit_rows(units(spark, sf_dir)).drop("body"), 1)
    counted = every.groupBy("source_id").agg(F.count("*").alias("units")).withColumn("state", F.lit("ready"))
    return faults(every.filter("not (source_id % 10 = 0 and unit = 1)"), counted)


@query("""with named as (select doc_id, sha256(encode(text)) as digest, strlen(text)::bigint as bytes, sha256(encode('prepared ' || doc_id)) as prepared from documents)
select 'prepared' as kind, prepared as digest, 8::bigint as bytes from named where doc_id % 3 = 0 union select 'source', digest, bytes from named where doc_id % 3 = 0""")
def object_closure(spark, sf_dir):
    """Prepared artifacts pull in the sources that they were made of."""
    made = docs(spark, sf_dir).select("source_id", E.digest(F.col("content")).alias("digest"), F.octet_length("content").cast("long").alias("bytes"))
    made = made.withColumn("prepared_digest", E.digest(F.encode(F.concat(F.lit("prepared "), F.col("source_id").cast("string")), "UTF-8")))
    marked = made.filter("source_id % 3 = 0").select(F.lit("prepared").alias("kind"), F.col("prepared_digest").alias("digest"), F.lit(8).cast("long").alias("bytes"))
    return objects.closure(objects.marks(marked), made)


@query(f"""
with {SOURCES},
saved as (select path, 1 as was, sha256(encode(text)) as d from sources where source_id % 11 <> 0),
seen as (select path, sha256(encode(case when source_id % 13 = 0 then text || '!' else text end)) as d from sources where source_id % 3 <> 0),
paired as (select coalesce(a.path, b.path) as path, a.was, a.d as old, b.d as new from saved a full join seen b on a.path = b.path)
select path, case when was is null then 'new' when new is null and (path = '{PREFIX}' or starts_with(path, '{PREFIX}/')) then 'removed' when new is null then 'kept' when new = old then 'same' else 'changed' end as action,
  case when was is null then 1 when new <> old then 2 else 1 end::bigint as row_revision, coalesce(new, old) as digest from paired""")
def inventory_diff(spark, sf_dir):
    d = docs(spark, sf_dir)
    named = lambda f, text: f.select("path", E.digest(F.encode(text, "UTF-8")).alias("digest"), F.octet_length(F.encode(text, "UTF-8")).cast("long").alias("bytes"))
    saved = named(d.filter("source_id % 11 <> 0"), F.col("text")).withColumn("row_revision", F.lit(1).cast("long"))
    seen = named(d.filter("source_id % 3 <> 0"), F.when(F.col("source_id") % 13 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return inventory.diff(saved, seen, [(PREFIX, "tree")]).drop("bytes")


@query("select regexp_replace(regexp_replace(url, '^[a-z]+://', '/'), '[?#].*$', '') as path, count(*) as pages, sum(strlen(html))::bigint as bytes from pages group by all")
def page_paths(spark, sf_dir):
    return tables.from_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).groupBy("path").agg(F.count("*").alias("pages"), F.sum(F.octet_length("content")).alias("bytes"))


@query("with c as (select conv_id as source_id, string_agg(concat_ws(': ', role, text), chr(10) order by turn, role, text) as t from conversations group by conv_id) select source_id, sha256(encode(t)) as digest from c")
def conversation_sources(spark, sf_dir):
    return tables.from_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet")).select("source_id", E.digest(F.encode("text", "UTF-8")).alias("digest"))


# queries over a root of the engine

_engines: dict[tuple[str, str], Engine] = {}


def _shared(spark) -> str:
    """A folder that all machines see: below spark.checkpoint.dir; one of our own only where it is unset in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise EngineError("SHARED_FOLDER_UNSET")
    return (named or tempfile.mkdtemp(prefix="quarrylight-")).rstrip("/") + f"/root-{uuid.uuid4().hex}"


def engine(spark, sf_dir) -> Engine:
    """A root with all documents as sources, built once for an application and a table."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _engines:
        made = Engine(spark, _shared(spark)).initialize()
        made.settings(PREFERRED, HARD)
        made.index_rows(docs(spark, sf_dir).select("path", "content"))
        _engines[key] = made
    return _engines[key]


@query(f"""with recursive {UNITS}, {SOURCES.strip()}, counted as (select source_id, count(*) as units from units group by all)
select path, source_class, 1::bigint as row_revision, sha256(encode(text)) as digest, strlen(text)::bigint as bytes, 'ready' as state, coalesce(units, 0) as units from sources left join counted using (source_id)""")
def published_sources(spark, sf_dir):
    return engine(spark, sf_dir).open_verified().sources.select("path", "source_class", "row_revision", "digest", "bytes", "state", "units")


@query(f"""with recursive {UNITS}, {SOURCES.strip()}
select path, unit, start, "end", line_start, line_end, '{1:016x}' || lower(lpad(hex(row_number() over (order by sha256(path), unit) - 1), 16, '0')) as point_id from units join sources using (source_id)""")
def published_units(spark, sf_dir):
    return engine(spark, sf_dir).pin().units.select("path", "unit", "start", "end", "line_start", "line_end", "point_id")


@query(f"with {UNIT_BM25} select term, count(distinct (source_id, unit)) as df, count(*) as tf from toks group by term")
def published_postings(spark, sf_dir):
    """The sums of each term's postings, which the generation keeps with the term."""
    return engine(spark, sf_dir).pin().terms.select("term", "df", "tf")


@query(f"with {SOURCES} {FACTS.format(m=OCCURS.format(LITERAL))} where starts_with(path, '{PREFIX}/') and source_class = 'vendor'")
def view_exact(spark, sf_dir):
    found = engine(spark, sf_dir).exact(LITERAL, limit=64, prefix=PREFIX, source_class="vendor")
    names = ("selected_sources", "scanned_sources", "scanned_bytes", "matches", "missing_sources", "items", "scan_complete", "complete_negative", "stop")
    kinds = ("long",) * 5 + ("long", "boolean", "boolean", "string")
    row = {**found, "items": len(found["items"])}
    return spark.createDataFrame([tuple(row[n] for n in names)], ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))


@query(f"with {SOURCES} select count(*) as published_sources, 0::bigint as published_preparation_gaps, count(*) filter (source_class = 'vendor') as selected_sources, 0::bigint as selected_preparation_gaps, false as known_control_lag from sources")
def query_summary(spark, sf_dir):
    """The summary that comes with an answer over the vendor sources of the served generation."""
    view = engine(spark, sf_dir).pin()
    s = view.summary(exact.select(view.sources, source_class="vendor"))
    row = (s["published_sources"], s["published_preparation_gaps"], s["selected_sources"], s["selected_preparation_gaps"], s["control"]["known_control_lag"])
    return spark.createDataFrame([row], "published_sources long, published_preparation_gaps long, selected_sources long, selected_preparation_gaps long, known_control_lag boolean")


@query(f"""with {VIEW_BEST}, {EXCERPTS}
select path, unit, round(score, 6) as score, row_number() over (order by score desc, sha256(path), unit)::int as rank, u.start + excerpt_start as excerpt_start, u.start + excerpt_end as excerpt_end, 'hit' as kind
from best join shown using (source_id, unit) join units u using (source_id, unit) join sources using (source_id)""")
def view_search(spark, sf_dir):
    """Ranked hits of the served generation with evidence verified against the stored bytes."""
    hits = engine(spark, sf_dir).search(QUERY, 64)
    rows = [(h["path"], h["unit"], round(h["score"], 6), h["rank"], h["excerpt"]["start"], h["excerpt"]["end"], h["kind"]) for h in hits]
    return spark.createDataFrame(rows, "path string, unit long, score double, rank int, excerpt_start long, excerpt_end long, kind string")


@query(f"with {SOURCES} select count(*) as sources, sum({OCCURS.format(LITERAL)})::bigint as matches, count(distinct text) as objects from sources")
def archive_round_trip(spark, sf_dir):
    """What a root holds that was made from an archive of another."""
    first, folder = engine(spark, sf_dir), _shared(spark)
    first.export(f"{folder}/archive")
    other = Engine(spark, f"{folder}/copy")
    other.import_archive(f"{folder}/archive", take=True)  # it would be deleted below
    view = other.open_verified()
    row = (view.sources.count(), other.exact(LITERAL)["matches"], view.objects.count())
    other.root.delete_path(folder)
    return spark.createDataFrame([row], "sources long, matches long, objects long")


#: Trees of one digit that all texts are dealt out to.
TREES = 4


def _as_files(folder: str):
    """Writes each text as a file: some names start with `_`, some with a dot, some end in .log."""

    def run(batches):
        import os

        for batch in batches:
            for i, text in zip(batch.column("source_id").to_pylist(), batch.column("text").to_pylist()):
                path = f"{folder}/{'_' if i % 3 == 0 else ''}{i % 10}/{'.' if i % 7 == 0 else '_' if i % 4 == 0 else ''}{i}.{'log' if i % 5 == 0 else 'txt'}"
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "wb") as f:
                    f.write(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return run


@query("""
select case when doc_id % 3 = 0 then '_' else '' end || doc_id % 10 || '/' || case when doc_id % 7 = 0 then '.' when doc_id % 4 = 0 then '_' else '' end || doc_id || '.' || case when doc_id % 5 = 0 then 'log' else 'txt' end as name,
       sha256(encode(text)) as digest, strlen(text)::bigint as bytes
from documents where doc_id % 10 = 5 or doc_id % 7 <> 0 and doc_id % 5 <> 0""")
def tree_sources(spark, sf_dir):
    """All texts as trees of files with rules: which are sources, and their bytes. The folders of the names 5 keep their .log
    files, those whose names start with a dot too. The trees are written, kept by the engine and deleted one after the other,
    so that the disk holds the files of one of them besides the store."""
    folder, d = _shared(spark), docs(spark, sf_dir).select("source_id", "text")
    made = Engine(spark, f"{folder}/store").initialize()
    made.settings(PREFERRED, HARD)
    for k in range(TREES):
        tree = folder.removeprefix("file://") + f"/tree{k}"
        d.filter((F.floor(F.col("source_id") / 100) % TREES) == k).mapInArrow(_as_files(tree), "n long").agg(F.sum("n")).collect()
        for name, rules in ((".gitignore", "*.log\n"), ("5/.ignore", "!*.log\n"), ("_5/.ignore", "!*.log\n")):
            made.root.write_text(f"{folder}/tree{k}/{name}", rules)
        made.index(tree, publish=False)
        made.root.delete_path(f"{folder}/tree{k}")
    made.publish()
    found = made.pin().sources
    return found.select(F.expr(f"substring(path, {len(tree) + 2})").alias("name"), "digest", "bytes")

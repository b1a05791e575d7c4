"""URL filter: prefix rules, then logistic regression on hashed character n-grams of host and path.

All of it is DataFrame functions. The model is fitted by stochastic gradient steps over the labelled table
below (EXAMPLES, the bound of the training set) inside one `aggregate` expression, EPOCHS times over in fixed
order; it is BUCKETS weights, which scoring holds as one constant array. A url's features are the distinct
buckets of the n-grams of `host` (with ^ and $ at its ends) and of the path's words (marked by /), so a
frequent n-gram counts once. A url without a fitting rule is blocked if its probability is over one half.

Nulls: a null url, or one without ://, has an empty host and path, fits no rule and gets the model's verdict
on empty strings, which is allow (no features, and the bias is fitted below one half). Very long urls are
judged whole. A host word of no kind in the table is judged by the parts it shares with those in it. Repeated rows are returned as often as they came. Extra columns are not read; empty in, empty out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.common import ascii_lower

BUCKETS, EPOCHS, RATE, DECAY = 2048, 4, 0.5, 1e-3
#: The rules of the contract as (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: The labelled table: words of hosts that sell, lure or track, and words of ordinary hosts.
_BLOCKED = """casino poker betting bets jackpot slots roulette blackjack gambling lotto bonus wager xxx porn adult sex escort nude camgirls
hentai spam scam phishing malware viagra cialis pills replica payday loans ads adserver banner clicks tracker tracking pixel popups
affiliate warez crack keygen torrent hacked cheats free-money win-prize cheap-meds""".split()
_ALLOWED = """news library weather garden history museum science university recipes travel forum music school council journal research health
hospital kitchen football cinema theatre gallery archive maps railway airport economy politics culture nature physics biology chemistry
mathematics engineering software docs wiki blog support community village city market bakery coffee books""".split()
_HOSTS = ("{0}.example.com", "www.{0}-{1}.org", "blog.{0}{1}.co.uk", "{0}.{1}.info", "m.my{0}.de", "the-{0}.net")
_PATHS = ("/en/{0}", "/{0}.html", "/a/{0}/", "/", "/de/p/{0}", "/{0}?id=1")


def _table() -> tuple[tuple[str, str, int], ...]:
    """(host, path, label): every word in each host pattern, with the word five places on as its neighbour."""
    out = []
    for i in range(len(_BLOCKED)):
        for k, host in enumerate(_HOSTS):
            for words, label in ((_BLOCKED, 1), (_ALLOWED, 0)):
                word, next_ = words[i], words[(i + 5) % len(words)]
                out.append((host.format(word, next_), _PATHS[(i + k) % len(_PATHS)].format(17 * i + 3).split("?")[0], label))
    return tuple(out)


EXAMPLES = _table()


def parts(url):
    """host and path expressions of a url column."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format("url")))
    host = F.coalesce(ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def buckets(host: str, path: str) -> str:
    """SQL of the distinct bucket numbers (from 1) of a url's 3- and 4-grams; none for an empty host and path."""

    def grams(s: str, n: int) -> str:
        return f"transform(sequence(1, greatest(length({s}) - {n - 1}, 1)), i -> concat('{n}', substring({s}, i, {n})))"

    h, p = f"concat('^', {host}, '$')", f"concat(regexp_replace({path}, '[0-9]+', '0'), '/')"
    every = f"concat({grams(h, 3)}, {grams(h, 4)}, {grams(p, 3)})"
    return f"if({host} = '' and {path} = '', array(), array_distinct(transform({every}, g -> cast(pmod(xxhash64(g), {BUCKETS}) as int) + 1)))"


def fit(spark: SparkSession, examples=EXAMPLES) -> list[float]:
    """The weights, the bias last."""
    values = ", ".join(f"({i}, '{h}', '{p}', {y}D)" for i, (h, p, y) in enumerate(examples))
    table = spark.sql(f"select * from values {values} as t(i, host, path, y)")
    rows = table.selectExpr("i", "y", f"{buckets('host', 'path')} as xs").groupBy().agg(F.sort_array(F.collect_list(F.struct("i", "y", "xs"))).alias("rows"))
    # One step: the error under the current weights, then the weights it changes. The error is bound by a one-element transform.
    error = f"(1 / (1 + exp(-(w[{BUCKETS}] + aggregate(r.xs, 0D, (s, x) -> s + w[x - 1])))) - r.y) * {RATE} / sqrt(size(r.xs) + 1)"
    step = f"transform(array({error}), e -> transform(w, (v, k) -> v * (1 - {DECAY}) - if(k = {BUCKETS} or array_contains(r.xs, k + 1), e, 0D)))[0]"
    passes = f"flatten(array_repeat(rows, {EPOCHS}))"
    return rows.selectExpr(f"aggregate({passes}, array_repeat(0D, {BUCKETS + 1}), (w, r) -> {step}) as w").first()["w"]


def judge(pages: DataFrame, rules=RULES, weights: list[float] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, probability of every row of pages (page_id, url)."""
    weights = weights or fit(pages.sparkSession)
    host, path = parts(F.col("url"))
    rows = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, ruled = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(ruled)
    score = F.aggregate(F.expr(buckets("host", "path")), F.lit(weights[-1]), lambda s, x: s + F.element_at(F.lit(weights[:-1]), x))
    out = rows.select("page_id", "host", "path", rule.alias("rule"), ruled.alias("ruled"), (1 / (1 + F.exp(-score))).alias("probability"))
    verdict = F.coalesce("ruled", F.when((F.col("host") == "") & (F.col("path") == ""), "allow").when(F.col("probability") > 0.5, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "probability")

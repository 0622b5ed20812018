"""The library's own queries over the driver's tables, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import clean, periodicals, records, text
from quire.functions import constants as K
from quire.operators import dedupe, filters, lookup, pages, ranks, series
from quire.session import spread
from quire.sources import archives

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query under its name, with its oracle if SQL can express it."""

    def add(build):
        QUERIES[name] = build
        if oracle:
            ORACLES[name] = oracle
        return build

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The driver's tables have no books, so the operators run here on columns of like shape, with Latin words.
NAME_WORDS = ("spam", "login", "casino")
CONTENT_WORDS = ("cookie", "track(7)", "lorem")


def _any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{w}')" for w in words) + ")"


@query(
    "page_keyword_filter",
    f"""WITH k AS (SELECT page_id, url, regexp_replace(lower(url), '[?#].*$', '') AS key FROM pages WHERE NOT {_any('url', NAME_WORDS)} AND NOT {_any('html', CONTENT_WORDS)})
SELECT page_id, url FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY page_id) AS r FROM k) WHERE r = 1""",
)
def page_keyword_filter(spark, d):
    """Junk words in name or content drop a page, the first page of an address stays, in page order (FI1, FI2, WI1)."""
    clean = table(spark, d, "pages").where(~filters.junk_page(F.col("url"), F.col("html"), NAME_WORDS, CONTENT_WORDS)).select("page_id", "url")
    return dedupe.first_wins(clean, F.regexp_replace(F.lower("url"), "[?#].*$", ""), ["page_id"]).orderBy("page_id")


@query(
    "last_item_rule",
    """SELECT conv_id, turn, turn = max(turn) OVER (PARTITION BY conv_id) AND (contains(lower(text), 'thing') OR contains(lower(text), 'ou ')) AS tail_junk FROM conversations""",
)
def last_item_rule(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text")
    return filters.tail_junk(rows, "conv_id", "turn", "text", ("thing", "ou ")).select("conv_id", "turn", "tail_junk")


@query(
    "leading_run_drop",
    """WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, role <> 'assistant' AS hit FROM conversations),
s AS (SELECT *, least(coalesce(min(CASE WHEN NOT hit THEN pos END) OVER (PARTITION BY conv_id), 4), 4) AS stop FROM t)
SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos FROM s WHERE pos >= stop""",
)
def leading_run_drop(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.row_number().over(w).alias("pos"), "role")
    return filters.drop_leading_run(rows, "conv_id", "pos", F.col("role") != "assistant").select("conv_id", "turn", "pos")


_HREFS = r"""regexp_extract_all(html, '<a href="([^"]*)"', 1)"""
# what each link of the page becomes before it is normalised, by its place: the table's own links have nothing to resolve
_HREF_FORMS = ("{}", "a/../.{}", "x%20y{}%23z#top", "b//./c{}", "up/..\\d{}", "/r/../..{}", "%zz{}%2F")


@query(
    "href_extract_normalize",
    rf"""WITH h AS (SELECT page_id, unnest({_HREFS}) AS href, generate_subscripts({_HREFS}, 1) AS ord FROM pages),
f AS (SELECT page_id, ord, href, CASE ord % 7 WHEN 1 THEN href WHEN 2 THEN concat('a/../.', href) WHEN 3 THEN concat('x%20y', href, '%23z#top') WHEN 4 THEN concat('b//./c', href)
  WHEN 5 THEN concat('up/..\d', href) WHEN 6 THEN concat('/r/../..', href) ELSE concat('%zz', href, '%2F') END AS form FROM h),
p AS (SELECT *, regexp_replace(replace(replace(replace(replace(form, '%20', ' '), '%23', '#'), '%2F', '/'), '\', '/'), '#.*$', '') AS plain FROM f),
-- only these forms have segments to resolve, and each of them at a known place
r AS (SELECT *, CASE ord % 7 WHEN 2 THEN regexp_replace(plain, '^a/\.\./', '') WHEN 5 THEN regexp_replace(plain, '^up/\.\./?', '') WHEN 6 THEN regexp_replace(plain, '^/r/\.\./\.\.', '/') ELSE plain END AS r FROM p),
s AS (SELECT *, concat(CASE WHEN r LIKE '/%' THEN '/' ELSE '' END, array_to_string(list_filter(string_split(r, '/'), lambda x: x <> '' AND x <> '.'), '/')) AS path FROM r)
SELECT page_id, CAST(ord AS INTEGER) AS ord, form AS href, CASE WHEN path = '' THEN '.' ELSE path END AS path FROM s""",
)
def href_extract_normalize(spark, d):
    """Links of each page in document order, in seven forms by their place, normalised (ST1)."""
    hrefs = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    rows = table(spark, d, "pages").select("page_id", F.posexplode(hrefs).alias("ord", "link")).withColumn("ord", F.col("ord") + 1)
    form = None
    for k, shape in enumerate(_HREF_FORMS):
        before, after = shape.split("{}")
        value = F.concat(F.lit(before), F.col("link"), F.lit(after))
        test = F.col("ord") % 7 == (k + 1) % 7
        form = F.when(test, value) if form is None else form.when(test, value)
    return rows.select("page_id", "ord", form.alias("href"), text.normal_path(form).alias("path"))


@query(
    "url_title",
    r"""SELECT page_id, CASE WHEN regexp_extract(url, '[?&]page=([^&#]+)', 1) <> '' THEN regexp_extract(url, '[?&]page=([^&#]+)', 1)
 WHEN regexp_extract(url, '^[a-z]+://[^/]+/(?:en|fr|de|es)/([^?#]+)', 1) <> '' THEN regexp_extract(url, '^[a-z]+://[^/]+/(?:en|fr|de|es)/([^?#]+)', 1) END AS title FROM pages""",
)
def url_title(spark, d):
    """A title from an address: a query field, else the path below a language (ST12's shape)."""
    asked, path = F.regexp_extract("url", r"[?&]page=([^&#]+)", 1), F.regexp_extract("url", r"^[a-z]+://[^/]+/(?:en|fr|de|es)/([^?#]+)", 1)
    return table(spark, d, "pages").select("page_id", F.when(asked != "", asked).when(path != "", path).alias("title"))


@query(
    "natural_order_rank",
    r"""WITH k AS (SELECT page_id, list_transform(regexp_extract_all(lower(url), '([0-9]+|[^0-9]+)'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]') THEN concat('1', lpad(p, 30, '0')) ELSE concat('0', p) END) AS key FROM pages)
SELECT page_id, CAST(row_number() OVER (ORDER BY key, page_id) AS INTEGER) AS rank FROM k""",
)
def natural_order_rank(spark, d):
    """Places in natural order (SO1): ranks by sorted ranges, so no task sorts the whole table."""
    keyed = table(spark, d, "pages").select("page_id", text.natural_key(F.col("url")).alias("key"))
    return ranks.global_rank(keyed, ["key", "page_id"], "rank").select("page_id", F.col("rank").cast("int").alias("rank"))


@query(
    "first_wins_dedupe",
    r"""WITH k AS (SELECT doc_id, lower(trim(regexp_replace(replace(text, '_', ' '), '[\s]+', ' ', 'g'))) AS key FROM documents)
SELECT doc_id, md5(key) AS key_md5 FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS r FROM k) WHERE r = 1""",
)
def first_wins_dedupe(spark, d):
    """The first document of each title-like key stays (WI1, ST32)."""
    rows = table(spark, d, "documents").select("doc_id", F.md5(text.title_key(F.col("text"))).alias("key_md5"))
    return dedupe.first_wins(rows, "key_md5", ["doc_id"])


@query(
    "text_match_key",
    r"""SELECT doc_id, md5(lower(regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g'))) AS key_md5 FROM documents""",
)
def text_match_key(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.letters_key(F.col("text"))).alias("key_md5"))


CATEGORIES = {"license": ("licensed under", "all rights reserved"), "mail": ("@",), "secret": ("token =", "password"), "web": ("http://", "https://")}


@query(
    "category_hits_score",
    f"""WITH h AS (SELECT doc_id, list_filter([{', '.join(f"CASE WHEN {_any('text', w)} THEN '{n}' END" for n, w in CATEGORIES.items())}], lambda x: x IS NOT NULL) AS hits, contains(lower(text), 'license') AS title FROM documents)
SELECT doc_id, array_to_string(hits, ',') AS hits, CAST(4 * CAST(title AS INTEGER) + len(hits) AS INTEGER) AS score, len(hits) >= 2 OR (title AND len(hits) >= 1) AS decided FROM h""",
)
def category_hits_score(spark, d):
    """Category hits and their score (AG10, FI16)."""
    hits = filters.category_hits(F.col("text"), CATEGORIES)
    title = F.contains(F.lower("text"), F.lit("license"))
    rows = table(spark, d, "documents").select("doc_id", hits.alias("h"), title.alias("t"))
    return rows.select("doc_id", F.array_join("h", ",").alias("hits"), (4 * F.col("t").cast("int") + F.size("h")).alias("score"), ((F.size("h") >= 2) | (F.col("t") & (F.size("h") >= 1))).alias("decided"))


@query(
    "pattern_vocab_map",
    """SELECT p_partkey, array_to_string(list_filter([CASE WHEN regexp_matches(p_name, '(?i)ring|bolt') THEN 'fastener' END, CASE WHEN regexp_matches(p_name, '(?i)gear|widget') THEN 'drive' END,
CASE WHEN regexp_matches(p_type, '(?i)^(small|economy)$') THEN 'low' END], lambda x: x IS NOT NULL), ',') AS terms, NOT regexp_matches(p_type, '(?i)^PROMO') AS is_content FROM part""",
)
def pattern_vocab_map(spark, d):
    """Several terms of an ordered vocabulary for each row, and the maintenance filter (ST43, FI15)."""
    rules = [("fastener", "p_name", "(?i)ring|bolt"), ("drive", "p_name", "(?i)gear|widget"), ("low", "p_type", "(?i)^(small|economy)$")]
    terms = F.array_compact(F.array(*[F.when(F.col(c).rlike(p), F.lit(n)) for n, c, p in rules]))
    return table(spark, d, "part").select("p_partkey", F.array_join(terms, ",").alias("terms"), (~F.col("p_type").rlike("(?i)^PROMO")).alias("is_content"))


@query(
    "ordered_number_extract",
    r"""WITH n AS (SELECT page_id, coalesce(nullif(regexp_extract(url, 'page=([0-9]+)', 1), ''), nullif(regexp_extract(url, '/([0-9]+)(?:\.html)?(?:[?#/]|$)', 1), '')) AS n FROM pages)
SELECT page_id, regexp_replace(n, '^0+([0-9])', '\1') AS number, CASE WHEN length(regexp_replace(n, '^0+([0-9])', '\1')) < 3 THEN lpad(regexp_replace(n, '^0+([0-9])', '\1'), 3, '0') ELSE regexp_replace(n, '^0+([0-9])', '\1') END AS padded FROM n""",
)
def ordered_number_extract(spark, d):
    """The number of the first pattern that fits, canonical and padded (ST10, ST13, ST15)."""
    number = text.first_number(F.col("url"), (r"page=([0-9]+)", r"/([0-9]+)(?:\.html)?(?:[?#/]|$)"))
    return table(spark, d, "pages").select("page_id", number.alias("number"), text.padded_number(number).alias("padded"))


@query(
    "lookup_inner_ordered",
    """SELECT l_orderkey, l_linenumber, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def lookup_inner_ordered(spark, d):
    """Ordered rows with their keyed row, unmatched dropped, repeats kept (JN1)."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority", F.col("o_orderdate").alias("o"))
    return lookup.ordered_inner(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), orders, "l_orderkey", "o")


@query(
    "lookup_left_lastwins",
    """WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events)
SELECT c_custkey AS user_id, event_type FROM customer LEFT JOIN (SELECT * FROM e WHERE r = 1) ON user_id = c_custkey""",
)
def lookup_left_lastwins(spark, d):
    tags = table(spark, d, "events").select("user_id", "event_type", "event_id")
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return lookup.left_last_wins(rows, tags, "user_id", "event_id").select("user_id", "event_type")


@query("seen_anti", """SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def seen_anti(spark, d):
    return lookup.unseen(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


_WORDS = 4  # of 16 bits each


@query(
    "hamming_near_match",
    """WITH v AS (SELECT vec_id, CAST(label AS INTEGER) AS label, CAST(list_sum(list_transform(range(64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN CAST(1 AS HUGEINT) << CAST(i AS INTEGER) ELSE 0 END)) AS HUGEINT) AS w FROM embeddings),
p AS (SELECT a.vec_id, b.vec_id AS match_id, CAST(bit_count(xor(a.w, b.w)) AS INTEGER) AS distance FROM v a JOIN v b ON a.vec_id <> b.vec_id AND abs(a.label - b.label) <= 1 WHERE a.vec_id % 20 = 0 AND bit_count(xor(a.w, b.w)) <= 26)
SELECT vec_id, match_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, match_id) AS r FROM p) WHERE r = 1""",
)
def hamming_near_match(spark, d):
    """The nearest other bit string within limits of label and distance, for the rows whose id is divisible by 20 against all rows."""
    def word(k: int):
        return F.aggregate(F.sequence(F.lit(0), F.lit(15)), F.lit(0).cast("long"), lambda a, i: a + F.when(F.get("embedding", i + 16 * k) > 0, F.pow(F.lit(2), i).cast("long")).otherwise(0))

    rows = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("int").alias("label"), *[word(k).alias(f"w{k}") for k in range(_WORDS)])
    return dedupe.nearest_within(rows.where("vec_id % 20 = 0"), rows, "label", [f"w{k}" for k in range(_WORDS)], 26, 1, "vec_id")


@query(
    "greedy_leader_dedupe",
    """WITH RECURSIVE v AS (SELECT vec_id, CAST(label AS INTEGER) AS label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x - list_avg(CAST(embedding AS DOUBLE[]))) AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS place FROM embeddings),
z AS (SELECT CAST(-1 AS BIGINT) AS vec_id, label, CAST(0 AS BIGINT) AS place, CAST([] AS DOUBLE[][]) AS leaders, FALSE AS kept FROM v GROUP BY label
UNION ALL SELECT vec_id, label, place, CASE WHEN near THEN leaders ELSE list_append(leaders, e) END, NOT near FROM
 (SELECT v.vec_id, v.label, v.place, v.e, z.leaders, len(list_filter(z.leaders, lambda x: list_cosine_similarity(x, v.e) >= 0.5)) > 0 AS near FROM z JOIN v ON v.label = z.label AND v.place = z.place + 1))
SELECT vec_id, label, kept FROM z WHERE place > 0""",
)
def greedy_leader_dedupe(spark, d):
    """Greedy near-duplicate leaders in order, group by group (WI4)."""
    rows = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("int").alias("label"), "embedding")
    return dedupe.greedy_leaders(rows, "label", "vec_id", "embedding", 0.5).select("vec_id", "label", "kept")


@query(
    "greedy_size_groups",
    """WITH RECURSIVE s AS (SELECT p_brand, CAST(p_size * 10 + 300 AS DOUBLE) AS w, p_retailprice AS h, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS place FROM part WHERE p_size * 10 + 300 >= 300 AND p_retailprice >= 300),
z AS (SELECT p_brand, CAST(0 AS BIGINT) AS place, CAST([] AS STRUCT(w DOUBLE[], h DOUBLE[], mw DOUBLE, mh DOUBLE)[]) AS c FROM part GROUP BY p_brand
UNION ALL SELECT p_brand, place, CASE WHEN pos IS NULL THEN list_append(c, {'w': [w], 'h': [h], 'mw': round_even(w, 0), 'mh': round_even(h, 0)})
  ELSE list_transform(c, lambda x, i: CASE WHEN i = pos THEN {'w': list_append(x.w, w), 'h': list_append(x.h, h), 'mw': round_even(list_median(list_append(x.w, w)), 0), 'mh': round_even(list_median(list_append(x.h, h)), 0)} ELSE x END) END
 FROM (SELECT s.*, z.c, list_filter(list_transform(z.c, lambda x, i: CASE WHEN abs(s.w - x.mw) <= greatest(10, floor(0.035 * x.mw)) AND abs(s.h - x.mh) <= greatest(10, floor(0.035 * x.mh)) THEN i END), lambda i: i IS NOT NULL)[1] AS pos FROM z JOIN s ON s.p_brand = z.p_brand AND s.place = z.place + 1)),
l AS (SELECT p_brand, max(place) AS n, arg_max(c, place) AS c FROM z GROUP BY p_brand),
b AS (SELECT p_brand, n, list_filter(c, lambda x: len(x.w) = list_max(list_transform(c, lambda y: len(y.w))))[1] AS best FROM l)
SELECT p_brand, CASE WHEN n >= 6 AND len(best.w) >= greatest(6, floor(0.2 * n)) THEN best.mw END AS common_width, CASE WHEN n >= 6 AND len(best.w) >= greatest(6, floor(0.2 * n)) THEN best.mh END AS common_height FROM b""",
)
def greedy_size_groups(spark, d):
    """Dominant size of each brand's parts by running-median clusters (AG2)."""
    rows = table(spark, d, "part").select("p_brand", "p_partkey", (F.col("p_size") * 10 + 300).alias("w"), F.col("p_retailprice").alias("h"))
    return series.greedy_sizes(rows, "p_brand", "p_partkey", "w", "h")


_BOX = """SELECT l_suppkey AS book, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS idx,
CAST(l_quantity AS INTEGER) AS l, CAST(l_quantity AS INTEGER) * 2 AS t, 200 + CAST(l_discount * 100 AS INTEGER) * 30 AS r, 300 + CAST(l_tax * 100 AS INTEGER) * 40 AS b, l_discount * 8 AS fg FROM lineitem"""


@query(
    "parity_consensus",
    f"""WITH p AS ({_BOX}), m AS (SELECT *, CAST(round_even(median(l) OVER w, 0) AS INTEGER) AS ml, CAST(round_even(median(t) OVER w, 0) AS INTEGER) AS mt, CAST(round_even(median(r) OVER w, 0) AS INTEGER) AS mr, CAST(round_even(median(b) OVER w, 0) AS INTEGER) AS mb
FROM p WINDOW w AS (PARTITION BY book, idx % 2)),
c AS (SELECT *, fg < 0.37 AND r - l < greatest(1, mr - ml) * 0.82 AS across, fg < 0.37 AND b - t < greatest(1, mb - mt) * 0.82 AS down FROM m)
SELECT book, CAST(idx AS INTEGER) AS idx, greatest(0, CASE WHEN across THEN ml ELSE l END - 12) AS l, greatest(0, CASE WHEN down THEN mt ELSE t END - 12) AS t,
least(600, CASE WHEN across THEN mr ELSE r END + 12) AS r, least(800, CASE WHEN down THEN mb ELSE b END + 12) AS b FROM c""",
)
def parity_consensus(spark, d):
    """Consensus boxes of odd and even pages (AG3, AG4)."""
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    hundredth = lambda c: F.bround(F.col(c) * 100).cast("int")
    rows = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("book"), (F.row_number().over(w) - 1).alias("idx"), F.col("l_quantity").cast("int").alias("l"), (F.col("l_quantity").cast("int") * 2).alias("t"),
        (200 + hundredth("l_discount") * 30).alias("r"), (300 + hundredth("l_tax") * 40).alias("b"), (F.col("l_discount") * 8).alias("fg"), F.lit(600).alias("pw"), F.lit(800).alias("ph"),
    )
    return series.consensus_boxes(rows, "book", "idx", ["l", "t", "r", "b"], "fg", ["pw", "ph"]).select("book", "idx", "l", "t", "r", "b")


@query(
    "sampled_median_clamp",
    """WITH o AS (SELECT o_custkey, o_totalprice / 100 AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS p, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
s AS (SELECT o_custkey, v FROM o WHERE n <= 6 OR list_contains(list_transform(range(6), lambda i: CAST(round_even(i * (n - 1) / 5, 0) AS BIGINT)), p))
SELECT o_custkey, round(CASE WHEN median(v) >= 1200 THEN least(median(v), 4000) ELSE 3500 END, 6) AS edge FROM s GROUP BY o_custkey""",
)
def sampled_median_clamp(spark, d):
    """Clamped median of evenly spaced rows (AG5), six of them here."""
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_totalprice") / 100).alias("v"))
    return series.sampled_median(rows, "o_custkey", ["o_orderkey"], "v", most=6, out="edge").select("o_custkey", F.round("edge", 6).alias("edge"))


@query(
    "longest_true_run",
    """WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, value > 10 AS flag FROM events),
i AS (SELECT user_id, pos, pos - row_number() OVER (PARTITION BY user_id ORDER BY pos) AS island FROM e WHERE flag),
r AS (SELECT user_id, min(pos) AS start, count(*) AS length FROM i GROUP BY user_id, island)
SELECT user_id, CAST(start AS INTEGER) AS start, length FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY length DESC, start) AS k FROM r) WHERE k = 1""",
)
def longest_true_run(spark, d):
    return series.longest_true_run(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("value") > 10)


@query(
    "moving_mean_run",
    """WITH m AS (SELECT user_id, event_id, row_number() OVER w AS pos, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7 > 12 AS flag FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT user_id, pos, pos - row_number() OVER (PARTITION BY user_id ORDER BY pos) AS island FROM m WHERE flag),
r AS (SELECT user_id, min(pos) AS start, count(*) AS length FROM i GROUP BY user_id, island)
SELECT user_id, CAST(start AS INTEGER) AS start, length FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY length DESC, start) AS k FROM r) WHERE k = 1""",
)
def moving_mean_run(spark, d):
    """The longest run of a smoothed series above a threshold (WI6)."""
    smooth = series.moving_mean(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value")
    return series.longest_true_run(smooth, "user_id", ["ts", "event_id"], F.col("mean") > 12)


@query(
    "pair_band_count",
    """SELECT a.p_brand, count(*) AS pairs FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey AND abs(a.p_retailprice - b.p_retailprice) <= 5 AND abs(a.p_size - b.p_size) <= 4 GROUP BY a.p_brand""",
)
def pair_band_count(spark, d):
    return series.band_pairs(table(spark, d, "part"), "p_brand", "p_partkey", "p_retailprice", "p_size", 5.0, 4)


@query(
    "ranked_union_cap",
    """WITH u AS (SELECT 0 AS l, s_suppkey AS r, s_name AS name, s_nationkey AS key FROM supplier UNION ALL SELECT 1, c_custkey, c_name, c_nationkey FROM customer),
f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY l, r) AS k FROM u)
SELECT name, key, r AS place FROM f WHERE k = 1 ORDER BY l, r LIMIT 10""",
)
def ranked_union_cap(spark, d):
    """Two ranked lists, the first of each key, ten at most (SE1, SO8)."""
    a = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("key"), F.col("s_suppkey").alias("place"))
    b = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("key"), F.col("c_custkey").alias("place"))
    return dedupe.ranked_union([a, b], "key", "place", 10)


@query(
    "scored_top1",
    r"""WITH k AS (SELECT *, lower(regexp_replace(p_name, '[^\p{L}\p{N}]+', '', 'g')) AS key FROM part),
s AS (SELECT p_brand, p_partkey, p_name, CASE WHEN key = 'redbolt' THEN 10 WHEN contains(key, 'redbolt') OR contains('redbolt', key) THEN 5 ELSE 0 END
 + 1 + 3 * (CAST(contains(key, 'red') AS INTEGER) + CAST(contains(key, 'bolt') AS INTEGER)) AS score FROM k)
SELECT p_brand, p_partkey, p_name, CAST(score AS INTEGER) AS score FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey) AS r FROM s) WHERE r = 1""",
)
def scored_top1(spark, d):
    """The best candidate of each group by title score, the first on ties (SO5, ST34)."""
    rows = table(spark, d, "part").select("p_brand", "p_partkey", "p_name")
    return lookup.best_scored(rows, "p_brand", lookup.title_score(F.col("p_name"), F.lit("red bolt"), F.lit(1)), "p_partkey")


@query(
    "net_turns_mod4",
    """WITH t AS (SELECT user_id, event_type, CAST(sum(CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN -1 ELSE event_id % 5 - 2 END) AS BIGINT) AS s FROM events GROUP BY user_id, event_type)
SELECT user_id, event_type, CAST(((s % 4) + 4) % 4 AS INTEGER) AS turns FROM t WHERE ((s % 4) + 4) % 4 <> 0""",
)
def net_turns_mod4(spark, d):
    delta = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "error", -1).otherwise(F.col("event_id") % 5 - 2)
    return series.net_turns(table(spark, d, "events").withColumn("delta", delta), ["user_id", "event_type"], "delta")


@query(
    "fill_missing",
    """SELECT d.doc_id, coalesce(quality, CASE WHEN n_chars > 2000 THEN 1 ELSE 0 END) AS quality, coalesce(nullif(CASE WHEN d.doc_id % 3 = 0 THEN '' ELSE lang END, ''), source) AS lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def fill_missing(spark, d):
    """Empty fields filled from another column, what is there wins (SR7)."""
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")).alias("lang"), "source", F.when(F.col("n_chars") > 2000, 1).otherwise(0).alias("guess"))
    rows = rows.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return clean.fill_missing(rows, {"quality": "guess", "lang": "source"}).select("doc_id", "quality", "lang")


@query(
    "clean_scalars",
    r"""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'other' END AS kind, CAST(trunc(value) AS BIGINT) AS whole,
CASE WHEN event_id % 4 = 0 THEN true WHEN event_id % 4 = 1 THEN false END AS flag FROM events""",
)
def clean_scalars(spark, d):
    """Scalar coercions: integers through fractions, flags by word, enumerations with a default."""
    word = F.element_at(F.array(*[F.lit(x) for x in (" Yes", "FALSE", "maybe", "")]), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", clean.integer(F.get_json_object("props", "$.k")).alias("k"), clean.one_of(F.upper("event_type"), ("view", "click"), "other").alias("kind"), clean.integer(F.col("value")).alias("whole"), clean.boolean(word).alias("flag"))


@query(
    "json_version_gate",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS INTEGER) = 7""",
)
def json_version_gate(spark, d):
    """Cached records of another schema version are rejected (SR15)."""
    parsed = table(spark, d, "events").select("event_id", F.from_json("props", "k INT").alias("p"))
    return parsed.where(F.col("p.k") == K.CACHE_VERSION).select("event_id", F.col("p.k").alias("k"))


@query(
    "group_stats_hist",
    """SELECT l_returnflag, CAST(least(15, floor((l_quantity - 1) / 49 * 16)) AS INTEGER) AS bin, count(*) AS n, round(stddev_pop(l_extendedprice), 4) AS spread FROM lineitem GROUP BY 1, 2""",
)
def group_stats_hist(spark, d):
    """Population spread and a histogram of 16 bins, the last one closed (the shape of a picture's measures)."""
    bin_ = F.least(F.lit(15), F.floor((F.col("l_quantity") - 1) / 49 * 16)).cast("int")
    return table(spark, d, "lineitem").groupBy("l_returnflag", bin_.alias("bin")).agg(F.count("*").alias("n"), F.round(F.stddev_pop("l_extendedprice"), 4).alias("spread"))


@query("value_counter", """SELECT l_linenumber, count(*) AS n FROM lineitem GROUP BY l_linenumber""")
def value_counter(spark, d):
    return table(spark, d, "lineitem").groupBy("l_linenumber").agg(F.count("*").alias("n"))


@query(
    "xml_roundtrip",
    """SELECT p_partkey, p_name AS title, p_size AS number, p_type AS genre FROM part""",
)
def xml_roundtrip(spark, d):
    """Records as XML and back (SR3, SR4)."""
    record = F.struct(F.col("p_name").alias("Title"), F.col("p_size").alias("Number"), F.col("p_type").alias("Genre"))
    text_ = table(spark, d, "part").select("p_partkey", F.to_xml(record, {"rowTag": "ComicInfo"}).alias("xml"))
    back = text_.select("p_partkey", F.from_xml("xml", "Title STRING, Number INT, Genre STRING").alias("r"))
    return back.select("p_partkey", F.col("r.Title").alias("title"), F.col("r.Number").alias("number"), F.col("r.Genre").alias("genre"))


@query(
    "raw_name_clean",
    r"""WITH n AS (SELECT p_partkey, concat('[', p_brand, '][', p_type, ']', p_name, CASE WHEN p_partkey % 3 = 0 THEN '.KEPUB' ELSE ' (x) y' END) AS n FROM part)
SELECT p_partkey, trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(n, '(?i)\.kepub$', '')), '^(?:\[[^\]]+\])+', '')), '^[^\[\]]+?\([^)]*\)', '')) AS name FROM n""",
)
def raw_name_clean(spark, d):
    """Names without bracketed leads and the .kepub suffix (ST6)."""
    raw = F.concat(F.lit("["), "p_brand", F.lit("]["), "p_type", F.lit("]"), "p_name", F.when(F.col("p_partkey") % 3 == 0, ".KEPUB").otherwise(" (x) y"))
    return table(spark, d, "part").select("p_partkey", text.clean_name(raw).alias("name"))


@query(
    "garbage_page_reason",
    f"""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice * 3 AS size, 0.98 + l_discount / 5 AS w, l_tax / 20 AS e, 230 + l_quantity AS v, l_quantity / 2 AS g, l_tax / 30 AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN size < {K.GARBAGE_BYTES} THEN CASE WHEN w > 0.995 AND size < {K.GARBAGE_BYTES_SMALL} AND e < 0.002 THEN 'blank'
WHEN w >= 0.985 AND e < 0.007 AND v > 252 AND g < 22 AND b < 0.003 AND 1 - w <= 0.018 THEN 'faint' END END AS reason FROM s""",
)
def garbage_page_reason(spark, d):
    """Why a page is garbage, by thresholds on its statistics; most pages have no reason (FI6)."""
    stats = F.struct((0.98 + F.col("l_discount") / 5).alias("white_ratio"), (F.col("l_tax") / 20).alias("edge_ratio"), (230 + F.col("l_quantity")).alias("value_mean"), (F.col("l_quantity") / 2).alias("gray_std"), (F.col("l_tax") / 30).alias("black_ratio"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_extendedprice") * 3).alias("size"), stats.alias("s"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", filters.garbage_reason(F.col("size"), F.col("s")).alias("reason"))


@query(
    "page_with_fallbacks",
    """SELECT c_custkey AS key, coalesce(CASE WHEN c_acctbal > 0 THEN c_name END, s_name) AS name, coalesce(CASE WHEN c_nationkey > 5 THEN c_nationkey END, s_nationkey) AS nation FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey""",
)
def page_with_fallbacks(spark, d):
    """Fields from the page where it has them, else from its summary (JN9, SC17, SC24)."""
    page = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("name"), F.when(F.col("c_nationkey") > 5, F.col("c_nationkey")).alias("nation"))
    summary = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return lookup.with_fallbacks(page, summary, "key", ["name", "nation"]).select("key", "name", "nation")


@query(
    "title_match_strength",
    r"""WITH k AS (SELECT p_partkey, p_partkey % 3 AS works, lower(regexp_replace(concat('the ', p_name), '[^\p{L}\p{N}]+', '', 'g')) AS t, lower(regexp_replace(p_type, '[^\p{L}\p{N}]+', '', 'g')) AS p FROM part),
r AS (SELECT *, t = 'standardredbolt' OR (length(t) >= 7 AND contains('standardredbolt', substr(t, 4))) AS t_near, p = 'standardredbolt' OR (length(p) >= 4 AND contains('standardredbolt', p)) AS p_near FROM k)
SELECT p_partkey, CAST(CASE WHEN works > 0 THEN CASE WHEN t = 'standardredbolt' THEN 3 WHEN works = 1 AND t_near THEN 2 ELSE 0 END WHEN p_near THEN 1 ELSE 0 END AS INTEGER) AS strength FROM r""",
)
def title_match_strength(spark, d):
    """How well pages of no, one or two works fit the title asked for (ST35, ST36)."""
    strength = lookup.match_strength(F.lit("Standard red bolt"), F.concat(F.lit("the "), "p_name"), F.col("p_partkey") % 3, F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", strength.alias("strength"))


@query(
    "page_choice",
    """WITH c AS (SELECT l_orderkey AS query, l_linenumber AS rank, l_partkey, CAST(l_quantity AS INTEGER) % 3 AS phase, CAST(l_suppkey % 4 AS INTEGER) AS strength FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY strength DESC, phase, rank, l_partkey) AS k FROM c WHERE strength > 0 AND (phase < 2 OR strength = 3))
SELECT query, phase, rank, strength FROM r WHERE k = 1""",
)
def page_choice(spark, d):
    """The page of each query: the first of full strength, else the strongest of the early phases (SO6)."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query"), F.struct(F.col("l_linenumber").alias("n"), "l_partkey").alias("rank"), (F.col("l_quantity").cast("int") % 3).alias("phase"), (F.col("l_suppkey") % 4).cast("int").alias("strength"))
    return pages.choose(rows).select("query", "phase", F.col("rank.n").alias("rank"), "strength")


@query(
    "periodical_name",
    """WITH n AS (SELECT p_partkey, p_brand AS s, p_size, p_partkey % 6 AS form FROM part)
SELECT p_partkey, CASE form WHEN 0 THEN concat(s, ' v', lpad(p_size::VARCHAR, 3, '0'), '.cbz') WHEN 1 THEN concat(s, ' v', lpad(p_size::VARCHAR, 3, '0'), '-', lpad((p_size + 1)::VARCHAR, 3, '0'), ' 合刊 spring.cbz')
 WHEN 2 THEN concat(s, ' SP', lpad(p_size::VARCHAR, 3, '0'), ' 增刊 maps.cbz') WHEN 3 THEN concat(s, ' v', lpad(p_size::VARCHAR, 3, '0'), ' notes.cbz') WHEN 4 THEN 'some title.cbz' ELSE concat(s, ' SP000 大全 red.cbz') END AS name FROM n""",
)
def periodical_name(spark, d):
    """Archive names of periodical files in six forms (ST16-ST20)."""
    size, series = F.col("p_size").cast("string"), F.col("p_brand")
    forms = (
        F.concat(series, F.lit(" Vol."), size), F.concat(F.lit("["), series, F.lit("] "), size, F.lit("~"), (F.col("p_size") + 1).cast("string"), F.lit(" 合刊 spring")), F.concat(F.lit("v"), size, F.lit("_增刊_maps")),
        F.concat(F.lit("第"), size, F.lit("期 (notes) full_CRAZ")), F.lit("some  title 1x2+3x4=5"), F.lit("大全 red"),
    )
    stem = F.element_at(F.array(*forms), (F.col("p_partkey") % 6 + 1).cast("int"))
    path = F.concat(F.lit("/books/"), series, F.lit("/"), stem, F.lit(".pdf"))
    return periodicals.archive_names(table(spark, d, "part").select("p_partkey", path.alias("path")), out="name").select("p_partkey", "name")


@query(
    "record_roundtrip",
    """SELECT p_partkey, p_name AS title, concat(p_type, ' & <', p_brand, '>') AS series, CAST(p_size AS BIGINT) AS count, concat(lower(p_type), '|', p_name) AS genre,
 CASE WHEN p_size % 3 = 0 THEN 'YesAndRightToLeft' WHEN p_size % 3 = 1 THEN 'Yes' END AS manga, CAST(1 AS BIGINT) AS pages FROM part""",
)
def record_roundtrip(spark, d):
    """Records of 49 fields, normalised, as XML and back (SR3-SR6, SR8)."""
    page = F.from_json(F.lit('{"image": 3, "page_type": ["story", "x", "Story"]}'), records.PAGE)
    rows = spread(table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size")).select(
        "p_partkey", F.concat(F.lit(" "), "p_name").alias("title"), F.concat("p_type", F.lit(" & <"), "p_brand", F.lit(">")).alias("series"), F.concat("p_size", F.lit(".0")).alias("count"),
        F.concat(F.lower("p_type"), F.lit(", "), F.upper("p_type"), F.lit(",,"), "p_name").alias("genre"), F.when(F.col("p_size") % 3 == 0, "yesandrighttoleft").when(F.col("p_size") % 3 == 1, "?").alias("manga"), F.array(page, F.lit(None)).alias("pages"),
    )
    back = records.from_xml(records.normalise(rows).select("p_partkey", records.to_xml().alias("xml")))
    return back.select("p_partkey", "title", "series", "count", F.array_join("genre", "|").alias("genre"), "manga", F.size(F.filter("pages", lambda p: p["page_type"] == F.array(F.lit("Story")))).cast("long").alias("pages"))


@query(
    "rating_clean",
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, round(CAST(l_quantity / 8 AS DECIMAL(20, 6)), 1) AS r FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, CAST(CASE WHEN r BETWEEN 0 AND 5 THEN r END AS DOUBLE) AS rating FROM r""",
)
def rating_clean(spark, d):
    """Ratings of one decimal within 0 to 5."""
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", clean.rating(F.col("l_quantity") / 8).cast("double").alias("rating"))


@query("duplicate_entry_names", """SELECT source AS archive FROM documents GROUP BY source HAVING count(*) <> count(DISTINCT lower(lang))""")
def duplicate_entry_names(spark, d):
    """Archives in which an entry name comes twice, but for case (SE5)."""
    return archives.unique_names(table(spark, d, "documents").select(F.col("source").alias("archive"), F.col("lang").alias("name")))


@query(
    "repair_plan",
    """SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_id % 5 = 0 THEN 'rebuild' WHEN value > 10 THEN 'metadata_only' ELSE 'nothing' END AS action FROM events""",
)
def repair_plan(spark, d):
    """Rebuild, metadata only or nothing, for each archive (SK5, SK8)."""
    rows = table(spark, d, "events").select("event_id", (F.col("event_id") % 7 == 0).cast("int").alias("garbage_pages"), (F.col("event_id") % 5 == 0).cast("int").alias("rotated_pages"), (F.col("value") > 10).alias("metadata_changed"))
    return archives.planned_repairs(rows).select("event_id", "action")


@query("first_year", """SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders""")
def first_year(spark, d):
    """The first year named in a text (SR2)."""
    return table(spark, d, "orders").select("o_orderkey", text.year(F.concat(F.lit("n. 7, "), F.col("o_orderdate").cast("string"))).alias("year"))


@query(
    "safe_file_name",
    r"""SELECT page_id, substr(trim(regexp_replace(url, '[\\/:*?"<>|\s]+', '_', 'g')), 1, 80) AS file FROM pages""",
)
def safe_file_name(spark, d):
    """A title as a file name of 80 characters at most (ST50)."""
    return table(spark, d, "pages").select("page_id", text.safe_file_name(F.col("url")).alias("file"))

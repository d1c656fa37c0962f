"""The library's queries by name, and SQL for those that SQL can express. Each runs over its whole tables."""

from __future__ import annotations

import io
import json
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import chat, csv_codec, jwt, oauth2, toml_codec, urls, xml_codec, yaml_codec
from millrace.operators import article, cssx, dom, html_api, robots, sitemap
from millrace.plans import relational
from millrace.sources import archive, redis_template, xlsx
from millrace.streaming import events as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Unset, a temporary one serves a local master alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.conf.get("spark.master", "local").split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or f"file://{tempfile.mkdtemp()}").rstrip("/")


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: Entities of the pages, decoded in SQL (``&amp;`` last).
DECODED = "replace(replace(replace(replace({}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
H1 = DECODED.format("regexp_extract(html, '<h1>(.*?)</h1>', 1)")
HREFS = "list_transform(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1), lambda x: " + DECODED.format("x") + ")"


def mapped(df: DataFrame, columns: list[str], to: list[tuple[str, str, pa.DataType]], f: Callable[..., tuple]) -> DataFrame:
    """``f`` over rows of ``columns`` in Arrow batches, giving the new columns ``to`` (name, Spark type, Arrow type) after the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [f(*x) for x in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns))]
            new = list(zip(*rows)) if rows else [[] for _ in to]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t[2]) for c, t in zip(new, to))], names=[*batch.schema.names, *(t[0] for t in to)])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *(T.StructField(n, T._parse_datatype_string(k)) for n, k, _ in to)]))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over four tasks a core, for rows of few bytes and much work, of which a few tasks would read all."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


# --- pages: selection pipelines ---


@register(f"SELECT page_id, {H1} AS title FROM pages")
def css_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cssx.query(table(spark, sf_dir, "pages"), {"title": "h1 >> :text() >> :first()"})
    return found.select("page_id", F.try_element_at("title", F.lit(1)).alias("title"))


@register("SELECT page_id, len(regexp_extract_all(html, '<a ')) AS links, len(regexp_extract_all(html, '<p>')) AS paragraphs, len(regexp_extract_all(html, '<table')) > 0 AS has_table, len(regexp_extract_all(html, '<h1>')) = 1 AS one_h1, len(regexp_extract_all(html, '<form')) = 0 AS no_form FROM pages")
def css_reducers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cssx.query(table(spark, sf_dir, "pages"), {"links": ":count(a)", "paragraphs": ":count(p)", "has_table": ":exists(table)", "one_h1": ":one(h1)", "no_form": ":empty(form)"})
    first = lambda c, t: F.col(c)[0].cast(t).alias(c)
    return found.select("page_id", first("links", "long"), first("paragraphs", "long"), first("has_table", "boolean"), first("one_h1", "boolean"), first("no_form", "boolean"))


@register(f"SELECT page_id, unnest({HREFS}) AS href, CAST(unnest(range(len({HREFS}))) AS INTEGER) AS pos FROM pages")
def css_hrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cssx.query(table(spark, sf_dir, "pages"), {"hrefs": 'a >> :attr("href") >> :compact()'})
    return found.select("page_id", F.posexplode("hrefs").alias("pos", "href"))


@register(
    f"""WITH h AS (SELECT page_id, {HREFS} AS a FROM pages)
SELECT page_id, a[1] AS first, a[len(a)] AS last, a[3] AS third, array_to_string(a[1:2], '|') AS take2, array_to_string(a[3:], '|') AS skip2, array_to_string(a[2:3], '|') AS slice12,
CAST(len(list_distinct(a)) AS INTEGER) AS n_distinct, CAST(len(a) AS INTEGER) AS n, list_position(a, a[2]) - 1 AS index_of_second FROM h"""
)
def css_selection_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First, last, nth, take, skip, slice, distinct, count, indexOf and join, once in the page's own pipeline and going on in the JVM."""
    names = {"a": ':attr("href", a)', "first": ':first(:attr("href", a))', "last": ':last(:attr("href", a))', "third": ':nth(2, :attr("href", a))', "take2": ':join("|", :take(2, :attr("href", a)))', "skip2": ':join("|", :skip(2, :attr("href", a)))', "slice12": ':join("|", :slice(1, 2, :attr("href", a)))', "d": ':distinct(:attr("href", a))', "second": ':nth(1, :attr("href", a))'}
    found = cssx.query(table(spark, sf_dir, "pages"), names)
    one = lambda c: F.try_element_at(F.col(c), F.lit(1)).alias(c)
    return found.select("page_id", *map(one, ("first", "last", "third", "take2", "skip2", "slice12")), F.size("d").alias("n_distinct"), F.size("a").alias("n"), cssx.COLUMN_OPS["indexOf"](F.col("a"), F.try_element_at("second", F.lit(1))).alias("index_of_second"))


@register("SELECT page_id, len(regexp_extract_all(html, '<li><a ')) AS li_with_a, len(regexp_extract_all(html, '<li>')) - 1 AS next_li, len(regexp_extract_all(html, '<a ')) AS in_nav, len(regexp_extract_all(html, '<li>')) AS closest_li, len(regexp_extract_all(html, '<div class=\"ad\">')) AS matches_ad, len(regexp_extract_all(html, '<li>')) AS not_ad, len(regexp_extract_all(html, '<nav><ul>')) AS ul_parents FROM pages")
def css_filters_traversals(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"li_with_a": ':count(:has("a", li))', "next_li": ":count(:next(li))", "in_nav": ':count(:within("nav", a))', "closest_li": ':count(:closest("li", a))', "matches_ad": ':count(:matches(".ad", div))', "not_ad": ':count(:not(".ad", li))', "ul_parents": ":count(:distinct(:parent(li)))"}
    found = cssx.query(table(spark, sf_dir, "pages"), names)
    return found.select("page_id", *[F.col(c)[0].cast("long").alias(c) for c in names])


@register(f"SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) || href AS absolute FROM (SELECT page_id, url, unnest({HREFS}) AS href FROM pages)")
def css_abs_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The absolute form of every link; the links of these pages are all rooted, which SQL can resolve."""
    found = cssx.query(table(spark, sf_dir, "pages"), {"u": ':url("href", a)'})
    return found.select("page_id", F.explode("u").alias("absolute"))


@register("SELECT name, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<(p|li|a|h1|nav|footer|article|ul)[ >]', 1)) AS name FROM pages) GROUP BY name")
def dom_tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = dom.parse_nodes(table(spark, sf_dir, "pages"))
    return nodes.where("node_type = 1 and name in ('p', 'li', 'a', 'h1', 'nav', 'footer', 'article', 'ul')").groupBy("name").agg(F.count("*").alias("n"))


@register("SELECT page_id, len(regexp_extract_all(html, '<a ')) AS links_in_nav FROM pages")
def dom_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containment as a range within a page: links below ``nav``. Both sides meet by page, never across pages."""
    nodes = dom.parse_nodes(table(spark, sf_dir, "pages")).where("name in ('a', 'nav')").select("page_id", "node_id", "end_id", "name")
    kids = nodes.where("name = 'a'").select(F.col("page_id"), F.col("node_id").alias("at"))
    tops = nodes.where("name = 'nav'").select("page_id", "node_id", "end_id")
    inside = kids.join(tops, "page_id").where("at > node_id and at <= end_id").groupBy("page_id").agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "pages").select("page_id").join(inside, "page_id", "left").select("page_id", F.coalesce("n", F.lit(0)).alias("links_in_nav"))


@register(f"SELECT page_id, {H1} AS title, len(regexp_extract_all(html, '<li>')) AS items FROM pages")
def xpath_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(html: str) -> tuple:
        page = html_api.html_parse(html)
        return html_api.evaluate_xpath(page, "string(//h1)"), int(html_api.evaluate_xpath(page, "count(//ul/li)"))

    return mapped(table(spark, sf_dir, "pages").select("page_id", "html"), ["html"], [("title", "string", pa.string()), ("items", "bigint", pa.int64())], one).drop("html")


@register("SELECT page_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang, regexp_extract(html, '<div class=\"([^\"]*)\"', 1) AS first_class, regexp_extract(html, '<meta charset=\"([^\"]*)\"', 1) AS charset, contains(html, '<h1>') AS is_element FROM pages")
def html_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(html: str) -> tuple:
        page = html_api.html_parse(html)
        return html_api.attr_query(page, "html", "lang").get("lang"), html_api.attr_get(html_api.element(page, "div"), "class")["class"], html_api.attr_query(page, "meta", "charset")["charset"], html_api.is_html_element(html_api.element(page, "h1"))

    to = [("lang", "string", pa.string()), ("first_class", "string", pa.string()), ("charset", "string", pa.string()), ("is_element", "boolean", pa.bool_())]
    return mapped(table(spark, sf_dir, "pages").select("page_id", "html"), ["html"], to, one).drop("html")


@register(
    """SELECT page_id, regexp_extract(url, '^([a-z]+:)', 1) AS protocol, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS pathname,
regexp_extract(url, '(\\?[^#]*)', 1) AS search, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS origin FROM pages"""
)
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "pages").select("page_id", urls.parse_url(F.col("url")).alias("u"))
    return x.select("page_id", *[F.col(f"u.{c}").alias(c) for c in ("protocol", "host", "pathname", "search", "origin")])


@register("SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || '/a/b?c=1' AS absolute FROM pages")
def url_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.resolve_url(F.col("url"), F.lit("/a/b?c=1")).alias("absolute"))


ROBOTS = "User-agent: *\nDisallow: /en/\nAllow: /en/1\nDisallow: /*?page=\nDisallow: /fr/*5$\n\nUser-agent: other\nDisallow: /\n"


@register(
    """WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+([^#]*)', 1) AS t FROM pages),
r AS (SELECT page_id, CASE WHEN t LIKE '/en/1%' THEN 5 ELSE -1 END AS allow, greatest(CASE WHEN t LIKE '/en/%' THEN 4 ELSE -1 END, CASE WHEN t LIKE '/%?page=%' THEN 7 ELSE -1 END, CASE WHEN t LIKE '/fr/%5' THEN 6 ELSE -1 END) AS disallow FROM p)
SELECT page_id, allow >= disallow AS allowed, CASE WHEN allow < 0 AND disallow < 0 THEN NULL WHEN allow >= disallow THEN 'allow' ELSE 'disallow' END AS directive FROM r"""
)
def robots_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = robots.match_paths(table(spark, sf_dir, "pages").select("page_id", "url"), ROBOTS)
    return found.select("page_id", "match.allowed", "match.directive")


@register("SELECT DISTINCT url AS loc FROM pages")
def sitemap_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sitemap for each remainder of page_id, under one index, walked as a table."""
    pages = table(spark, sf_dir, "pages").where("url is not null")
    entry = F.concat(F.lit("<url><loc>"), F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))
    maps = pages.groupBy(F.concat(F.lit("http://maps/"), (F.col("page_id") % 64).cast("string")).alias("url")).agg(F.concat(F.lit("<urlset>"), F.array_join(F.sort_array(F.collect_list(entry)), ""), F.lit("</urlset>")).alias("body"))
    index = F.concat(F.lit("<sitemapindex>"), F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("<sitemap><loc>"), "url", F.lit("</loc></sitemap>")))), ""), F.lit("</sitemapindex>"))
    bodies = maps.unionByName(maps.agg(index.alias("body")).select(F.lit("http://maps/index").alias("url"), "body"))
    return sitemap.walk_table(bodies, "http://maps/index", max_depth=2).select("loc")


@register(f"SELECT page_id, trim(regexp_replace({H1}, '\\s+', ' ', 'g')) AS title, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang FROM pages")
def article_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return article.extract_pages(table(spark, sf_dir, "pages")).select("page_id", "title", "lang")


@register()
def article_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return article.extract_pages(table(spark, sf_dir, "pages")).select("page_id", "text", "markdown", "wordCount", "readingTimeMinutes")


# --- codecs ---


@register("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as CSV text, a text for each row, and back with inferred types."""
    names = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]

    def one(*values: object) -> tuple:
        back = csv_codec.decode(csv_codec.encode([dict(zip(names, values))]), {"inferTypes": True})[0]
        return tuple(back[n] if n != "c_acctbal" else float(back[n]) for n in names)

    src = table(spark, sf_dir, "customer").select(*[F.col(n).alias(f"in_{n}") for n in names])
    to = [("c_custkey", "bigint", pa.int64()), ("c_name", "string", pa.string()), ("c_nationkey", "int", pa.int32()), ("c_acctbal", "double", pa.float64()), ("c_mktsegment", "string", pa.string())]
    return mapped(src, src.columns, to, one).select(*names)


@register("SELECT p_partkey, len(p_name) AS name_length, 'p' AS root, 2 AS n_children, p_name AS text, CAST(p_size AS VARCHAR) AS size FROM part")
def xml_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(key: int, name: str, size: int) -> tuple:
        node = {"type": "element", "name": "p", "attrs": {"size": str(size)}, "children": [{"type": "text", "value": name}, {"type": "element", "name": "e", "attrs": {}, "children": []}]}
        doc = xml_codec.decode(xml_codec.encode(node))
        return len(xml_codec.text(doc)), xml_codec.root(doc)["name"], len(xml_codec.children(xml_codec.root(doc))), xml_codec.text(doc), xml_codec.attr(doc, "size")

    to = [("name_length", "bigint", pa.int64()), ("root", "string", pa.string()), ("n_children", "int", pa.int32()), ("text", "string", pa.string()), ("size", "string", pa.string())]
    return mapped(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), ["p_partkey", "p_name", "p_size"], to, one).drop("p_name", "p_size")


@register("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def yaml_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda props: (yaml_codec.decode(yaml_codec.encode(json.loads(props)))["k"],)
    return mapped(table(spark, sf_dir, "events").select("event_id", "props"), ["props"], [("k", "bigint", pa.int64())], one).drop("props")


@register("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def toml_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda props: (toml_codec.decode(toml_codec.encode({"t": json.loads(props)}))["t"]["k"],)
    return mapped(table(spark, sf_dir, "events").select("event_id", "props"), ["props"], [("k", "bigint", pa.int64())], one).drop("props")


@register("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def variant_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))


@register("SELECT c_custkey, c_name AS sub, 'HS256' AS alg FROM customer")
def jwt_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens signed in batches, read in the JVM."""
    sign = lambda key, name: (jwt.sign({"sub": name, "n": key}, jwt.hmac_key("query"), now=0),)
    signed = mapped(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), ["c_custkey", "c_name"], [("token", "string", pa.string())], sign)
    x = signed.select("c_custkey", jwt.inspect_column(F.col("token")).alias("t"))
    return x.select("c_custkey", F.get_json_object("t.claims", "$.sub").alias("sub"), F.get_json_object("t.header", "$.alg").alias("alg"))


@register("SELECT o_orderkey, o_orderdate <= TIMESTAMP '1995-06-17 00:01:00' AS expired, greatest(0, CAST(date_diff('millisecond', TIMESTAMP '1995-06-17', o_orderdate) AS BIGINT)) AS valid_for FROM orders")
def oauth_token_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, at = F.lit("1995-06-17").cast("timestamp"), F.col("o_orderdate").cast("timestamp")
    return table(spark, sf_dir, "orders").select("o_orderkey", oauth2.expired_column(at, now, 60_000).alias("expired"), oauth2.valid_for_column(at, now).alias("valid_for"))


@register("SELECT c_custkey, 'SET customer:' || c_custkey || ' ' || c_mktsegment AS command FROM customer")
def redis_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = redis_template.compile_template("SET customer:$id $segment")
    one = lambda key, segment: (" ".join(map(str, redis_template.bind(template, {"id": key, "segment": segment}))),)
    return mapped(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), ["c_custkey", "c_mktsegment"], [("command", "string", pa.string())], one).drop("c_mktsegment")


@register("SELECT o_orderkey, o_totalprice AS price, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS day FROM orders")
def number_and_date_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("USD "), F.format_number("o_totalprice", 2)).alias("a"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("b"))
    return mapped(src, ["a", "b"], [("price", "double", pa.float64()), ("day", "string", pa.string())], lambda a, b: (cssx.to_number(a), cssx.to_date(b))).drop("a", "b")


# --- sources ---


@register("SELECT n_nationkey, n_name || '.txt' AS name, CAST(len(n_name) AS BIGINT) AS size, n_name AS content FROM nation")
def archive_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    def pack(name: str) -> tuple:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(f"{name}.txt", name)
        return (out.getvalue(), archive.read_entry(out.getvalue(), f"{name}.txt", {"as": "string"}))

    packed = mapped(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), ["n_name"], [("content", "binary", pa.binary()), ("text", "string", pa.string())], pack)
    listed = archive.list_archives(packed, "n_nationkey", "content").select("n_nationkey", "name", "size")
    return listed.join(packed.select("n_nationkey", F.col("text").alias("content")), "n_nationkey")


@register("SELECT r_regionkey AS key, r_name AS name FROM region")
def xlsx_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five regions through a workbook's bytes and back, as objects by its header."""
    book = xlsx.Workbook()
    rows = [[r.r_regionkey, r.r_name] for r in table(spark, sf_dir, "region").collect()]
    book.sheet("Sheet1").write_range("A1", [["key", "name"], *rows])
    back = xlsx.Workbook.read(xlsx.write_cells(book._sheets)).sheet("Sheet1").query(f"A1:B{len(rows) + 1}", {"headers": True})
    return spark.createDataFrame([(int(x["key"]), x["name"]) for x in back], "key int, name string")


@register("SELECT conv_id, string_agg(role || ':' || len(text), ',' ORDER BY turn) AS history, CAST(count(*) AS INTEGER) AS turns FROM conversations GROUP BY conv_id")
def chat_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = chat.histories(table(spark, sf_dir, "conversations"))
    return h.select("conv_id", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), F.length(m["content"]).cast("string"))), ",").alias("history"), F.size("messages").alias("turns"))


# --- streams ---


@register("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE value > 50) WHERE n = 1")
def first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "events").where("value > 50").withColumn("order", F.struct("ts", "event_id"))
    return found.groupBy("user_id").agg(F.min("order").alias("o")).select("user_id", F.col("o.event_id").alias("event_id"))


_KINDS = "CASE event_id % 3 WHEN 0 THEN 'started' WHEN 1 THEN 'finished' ELSE 'failed' END"


@register(
    f"""WITH e AS (SELECT user_id AS session, ts, CAST(event_id % 7 AS VARCHAR) AS request_id, {_KINDS} AS kind FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, request_id, kind DESC) AS p FROM e),
o AS (SELECT session, p AS from_p, coalesce(lead(p) OVER (PARTITION BY session, request_id ORDER BY p), 1000000000000) AS to_p, kind FROM n),
c AS (SELECT n.session, n.ts, n.p, count(o.session) AS inflight FROM n LEFT JOIN o ON o.session = n.session AND o.kind = 'started' AND o.from_p <= n.p AND n.p < o.to_p GROUP BY ALL),
l AS (SELECT *, lead(ts) OVER (PARTITION BY session ORDER BY p) AS nxt FROM c)
SELECT session, ts + INTERVAL 500 MILLISECOND AS idle_at, CAST(inflight AS INTEGER) AS inflight FROM l WHERE inflight <= 0 AND (nxt IS NULL OR nxt >= ts + INTERVAL 500 MILLISECOND)"""
)
def network_idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), "ts", F.expr("cast(event_id % 7 as string)").alias("request_id"), F.expr(_KINDS).alias("kind"))
    return streams.network_idle_batch(e)


@register("SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) = 1")
def stream_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each type out of a replayed stream, as the sink has it when the stream has ended."""
    src = table(spark, sf_dir, "events")
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex[:8]}"
    src.repartitionByRange("ts").write.parquet(f"{root}/in")
    events = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
    # the least event of each type: a sum that a row a type holds, whatever order files arrive in
    first = events.groupBy("event_type").agg(F.min(F.struct("ts", "event_id")).alias("o")).select("event_type", F.col("o.event_id").alias("event_id"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.parquet(f"{root}/out/batch={number:09d}", mode="overwrite")

    first.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.option("basePath", f"{root}/out").parquet(f"{root}/out")
    return out.where(F.col("batch") == out.agg(F.max("batch")).first()[0]).select("event_type", "event_id")


# --- documents ---



@register("SELECT doc_id, CAST(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS words, CAST(greatest(1, ceil(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) / 200.0)) AS BIGINT) AS reading_minutes, CAST(octet_length(encode(text)) AS BIGINT) AS bytes FROM documents")
def document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", words.alias("words"), F.greatest(F.lit(1), F.ceil(words / 200)).cast("long").alias("reading_minutes"), F.octet_length("text").cast("long").alias("bytes"))


for _name, (_make, _sql) in relational.QUERIES.items():
    QUERIES[_name] = _make
    ORACLE_SQL[_name] = _sql


"""The queries of the library's own operators over the driver's tables, with the same in DuckDB's SQL where it can say it.

Keyword and host lists come from the tables themselves or are written here; every query reads whole tables.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import millrace.operators  # noqa: F401
from millrace.functions.label_model import fit_label_model
from millrace.operators.tokens import SIMPLIFIED, TRADITIONAL, TREEBANK
from millrace.plans.durable import shared_dir
from millrace.plans.pipeline import Pipeline, run_operator
from millrace.streaming import dedup_stream, over_stream

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    return run_operator("regular_path_reader", spark=spark, input_path=f"{sf_dir}/{name}.parquet", format="parquet", spread=spread)


_written: dict[tuple[str, str], str] = {}


def _resource(spark: SparkSession, value) -> str:
    """A JSON file in the shared folder, written once in a session."""
    key = spark.sparkContext.applicationId, json.dumps(value, ensure_ascii=False)
    if key not in _written:
        path = f"{shared_dir(spark)}/millrace-resource-{uuid.uuid4().hex}"
        spark.createDataFrame([(key[1],)], "value string").coalesce(1).write.text(path)
        _written[key] = path
    return _written[key]


def docs(spark, sf_dir, *columns, spread=False):
    return table(spark, sf_dir, "documents", spread).select(*(columns or ("doc_id", "text")))


def with_tokens(df):
    return df.withColumn("tokens", F.split("text", " ", -1)).drop("text")


@query("SELECT lang, count(*) AS count FROM (SELECT lang, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS n FROM documents WHERE text IS NULL OR length(text) BETWEEN 200 AND 20000) WHERE n = 1 GROUP BY lang")
def curated_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: read, measure, filter by length, drop exact copies, count by language; declared as one pipeline."""
    return Pipeline.from_dict({
        "read": {"op_name": "regular_path_reader", "input_path": f"{sf_dir}/documents.parquet", "format": "parquet", "output_df": "docs"},
        "measure": {"op_name": "text_length_mapper", "input_df": "docs", "output_df": "measured", "field": "text", "output_field": "length"},
        "bound": {"op_name": "length_filter", "input_df": "measured", "output_df": "bounded", "field": "text", "min_length": 200, "max_length": 20000},
        "unique": {"op_name": "exact_deduplicator", "input_df": "bounded", "output_df": "unique", "field": "text", "order_by": ["doc_id"]},
        "count": {"op_name": "field_count_reducer", "input_df": "unique", "output_df": "counts", "field": "lang"},
    }).run(spark)


@query("SELECT doc_id, length(text)::INTEGER AS n FROM documents")
def text_length(spark, sf_dir):
    return run_operator("text_length_mapper", docs(spark, sf_dir), field="text", output_field="n", drop=["text"])


LENGTHS = dict(field="text", min_length=500, max_length=3000)


@query("SELECT doc_id, coalesce(length(text) BETWEEN 500 AND 3000, true) AS tag FROM documents")
def length_filter_tag(spark, sf_dir):
    return run_operator("length_filter", docs(spark, sf_dir), mode="tag", drop=["text"], **LENGTHS)


@query("SELECT doc_id FROM documents WHERE coalesce(length(text) BETWEEN 500 AND 3000, true)")
def length_filter(spark, sf_dir):
    return run_operator("length_filter", docs(spark, sf_dir), drop=["text"], **LENGTHS)


@query("SELECT doc_id, true AS tag FROM documents WHERE coalesce(length(text) BETWEEN 500 AND 3000, true)")
def length_filter_tag_and_filter(spark, sf_dir):
    return run_operator("length_filter", docs(spark, sf_dir), mode="tag_and_filter", drop=["text"], **LENGTHS)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount >= 0.05")
def numeric_filter(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    return run_operator("numeric_filter", items, field="l_discount", operator="ge", threshold=0.05, select=["l_orderkey", "l_linenumber"])


@query("SELECT l_orderkey, l_linenumber, l_quantity < 17 AS lt, l_quantity <= 17 AS le, l_quantity > 17 AS gt, l_quantity >= 17 AS ge, l_quantity = 17 AS eq FROM lineitem")
def numeric_comparisons(spark, sf_dir):
    """Every comparison as a tag."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    for name in ("lt", "le", "gt", "ge", "eq"):
        items = run_operator("numeric_filter", items, field="l_quantity", operator=name, threshold=17.0, mode="tag", tag_field=name)
    return items.drop("l_quantity")


@query("SELECT doc_id FROM documents WHERE contains(text, ' the ')")
def substring_contain_filter(spark, sf_dir):
    return run_operator("substring_contain_filter", docs(spark, sf_dir), field="text", substring=" the ", select=["doc_id"])


@query("SELECT event_id FROM events WHERE event_id IS NOT NULL AND value IS NOT NULL AND props IS NOT NULL")
def null_rows_filter(spark, sf_dir):
    return run_operator("null_rows_filter", table(spark, sf_dir, "events"), field="event_id", fields=["event_id", "value", "props"], select=["event_id"])


@query("""SELECT doc_id, length(text) > 0 AND coalesce(1 - list_sum(list_transform(list_filter(t, lambda x: regexp_matches(x, '[\\x{FFFD}\\x00-\\x08\\x0E-\\x1F\\x{7F}-\\x{9F}]') OR regexp_full_match(x, '[¡-ÿĀ-ſ]{1,2}') AND NOT regexp_full_match(x, '[àáéóòèÀÉÓ«»¿¡°]')), lambda x: length(x)))
  / list_sum(list_transform(t, lambda x: length(x))), 1) < 0.5 AS is_garbled FROM (SELECT doc_id, text, list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS t FROM documents)""")
def garbled_text_filter(spark, sf_dir):
    return run_operator("garbled_text_filter", docs(spark, sf_dir, spread=True), field="text", mode="tag", drop=["text"])


KEYWORDS = ("idiot", "scum", "pathetic", "worthless")


@query("SELECT doc_id, " + " + ".join(f"len(string_split(text, '{w}')) - 1" for w in KEYWORDS) + " <= 1 AND text IS NOT NULL AS tag FROM documents")
def sensitive_doc_filter(spark, sf_dir):
    return run_operator("sensitive_doc_filter", docs(spark, sf_dir, spread=True), field="text", sensitive_keyword_paths=[_resource(spark, KEYWORDS)], mode="tag", drop=["text"])


@query("SELECT doc_id, k.w AS keyword, count(*) AS hits FROM documents, (SELECT unnest(['idiot', 'scum', 'pathetic', 'worthless']) AS w) k, range(1, 100000) r(i) WHERE i < len(string_split(text, k.w)) GROUP BY ALL")
def sensitive_doc_hits(spark, sf_dir):
    tagged = run_operator("sensitive_doc_filter", docs(spark, sf_dir, spread=True), field="text", sensitive_keyword_paths=[_resource(spark, KEYWORDS)], targeted_keywords_field="hits", mode="tag")
    return run_operator("explode", tagged, field="hits", exploded_cols=["h"]).groupBy("doc_id", F.col("h.keyword").alias("keyword")).agg(F.count("*").alias("hits"))


HOSTS = ("thanor.example.com", "the.example.net", "tiontion.example.net", "therhe.example.org")


@query("SELECT page_id, h.host FROM (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1)) AS host FROM pages) h WHERE host NOT IN ('" + "', '".join(HOSTS) + "')")
def trash_host_filter(spark, sf_dir):
    pages = run_operator("url_component_extraction_mapper", table(spark, sf_dir, "pages").select("page_id", "url"), field="url", required_components=["host"])
    return run_operator("trash_host_filter", pages, field="host", trash_host_paths=[_resource(spark, HOSTS)], select=["page_id", "host"])


@query("SELECT o_orderkey, o_totalprice::INTEGER AS o_totalprice, o_custkey::VARCHAR AS o_custkey, try_cast(o_orderstatus AS INTEGER) AS o_orderstatus FROM (SELECT o_orderkey, trunc(o_totalprice) AS o_totalprice, o_custkey, o_orderstatus FROM orders)")
def field_type_converter(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_custkey", "o_orderstatus")
    return run_operator("field_type_converter", orders, field_type_mapping={"o_totalprice": "int", "o_custkey": "string", "o_orderstatus": "int"})


@query("""SELECT n_name, o_orderpriority, grouping(o_orderpriority)::TINYINT AS g, count(*) AS n, sum(o_totalprice)::DECIMAL(18, 2)::DOUBLE AS total, max(rank) AS most FROM (
  SELECT n_name, o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate, o_orderkey) AS rank
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) GROUP BY ROLLUP (n_name, o_orderpriority) HAVING count(*) > 1""")
def spark_sql_executor(spark, sf_dir):
    read = lambda t: {"op_name": "regular_path_reader", "input_path": f"{sf_dir}/{t}.parquet", "format": "parquet", "output_df": t}
    sql = """SELECT n_name, o_orderpriority, grouping(o_orderpriority) AS g, count(*) AS n, CAST(CAST(sum(o_totalprice) AS DECIMAL(18, 2)) AS DOUBLE) AS total, max(rank) AS most FROM (
      SELECT n_name, o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate, o_orderkey) AS rank
      FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey) GROUP BY ROLLUP (n_name, o_orderpriority) HAVING count(*) > 1"""
    return Pipeline.from_list([*map(read, ("orders", "customer", "nation")), {"op_name": "spark_sql_executor", "output_df": "out", "sql_query": sql}]).run(spark)


@query("SELECT * FROM (SELECT c_nationkey AS key FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) UNION ALL SELECT * FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")
def sql_set_operations(spark, sf_dir):
    read = lambda t: {"op_name": "regular_path_reader", "input_path": f"{sf_dir}/{t}.parquet", "format": "parquet", "output_df": t}
    sql = "SELECT * FROM (SELECT c_nationkey AS key FROM {customer} EXCEPT SELECT s_nationkey FROM {supplier} WHERE s_acctbal > 5000) UNION ALL SELECT * FROM (SELECT c_nationkey FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier} WHERE s_acctbal > 9000)"
    return Pipeline.from_list([*map(read, ("customer", "supplier")), {"op_name": "spark_sql_executor", "output_df": "out", "sql_query": sql}]).run(spark)


@query("SELECT event_type, count(*) AS count FROM events GROUP BY event_type")
def field_count_reducer(spark, sf_dir):
    return run_operator("field_count_reducer", table(spark, sf_dir, "events"), field="event_type")


@query("SELECT tokens, count(*) AS count FROM (SELECT unnest(string_split(text, ' ')) AS tokens FROM documents) GROUP BY tokens")
def array_flatmap_count_reducer(spark, sf_dir):
    return run_operator("array_flatmap_count_reducer", with_tokens(docs(spark, sf_dir, spread=True)), field="tokens")


@query("""SELECT char, frequency, cumsum, cumsum / total AS cumsum_rate FROM (SELECT char, frequency, sum(frequency) OVER (ORDER BY frequency DESC, char ROWS UNBOUNDED PRECEDING)::BIGINT AS cumsum, sum(frequency) OVER () AS total
  FROM (SELECT char, count(*) AS frequency FROM (SELECT unnest(string_split(text, '')) AS char FROM documents) WHERE char <> '' GROUP BY char)) WHERE cumsum / total >= 0.99""")
def filter_obscure_char_reducer(spark, sf_dir):
    return run_operator("filter_obscure_char_reducer", docs(spark, sf_dir, spread=True), field="text")


@query("SELECT quantile_disc(l_quantity, 0.95) AS l_quantity FROM lineitem")
def percentile_reducer(spark, sf_dir):
    return run_operator("percentile_reducer", table(spark, sf_dir, "lineitem"), field="l_quantity")


KEEP = "row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id)"


@query(f"SELECT doc_id, gid FROM (SELECT doc_id, sha256(text) AS gid, {KEEP} AS n FROM documents) WHERE n = 1")
def exact_deduplicator(spark, sf_dir):
    return run_operator("exact_deduplicator", docs(spark, sf_dir), field="text", order_by=["doc_id"], drop=["text"])


@query(f"SELECT doc_id, gid FROM (SELECT doc_id, sha256(text) AS gid, {KEEP} AS n FROM documents) WHERE n > 1")
def exact_deduplicator_dup(spark, sf_dir):
    return run_operator("exact_deduplicator", docs(spark, sf_dir), field="text", mode="dup", order_by=["doc_id"], drop=["text"])


@query(f"SELECT doc_id, sha256(text) AS gid, {KEEP} = 1 AS __stay__ FROM documents")
def exact_deduplicator_flag(spark, sf_dir):
    return run_operator("exact_deduplicator", docs(spark, sf_dir), field="text", mode="dedup_with_dup", order_by=["doc_id"], drop=["text"])


@query()
def minhash_lsh_deduplicator(spark, sf_dir):
    near = run_operator("minhash_lsh_deduplicator", docs(spark, sf_dir, spread=True), field="text", threshold=0.8, ngram_size=5, mode="dedup_with_dup", order_by=["doc_id"])
    return near.select("doc_id", "__component__", "__stay__")


@query()
def sample(spark, sf_dir):
    return run_operator("sample", docs(spark, sf_dir, "doc_id"), sample=100)


@query("SELECT least(count(*), 100) AS n, least(count(*), 100) AS ids FROM documents")
def sample_size(spark, sf_dir):
    return sample(spark, sf_dir).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids"))


@query("SELECT o_orderpriority, least(count(*), 50) AS n FROM orders GROUP BY o_orderpriority")
def stratified_sampler(spark, sf_dir):
    drawn = run_operator("stratified_sampler", table(spark, sf_dir, "orders"), strata_column="o_orderpriority", samples_per_stratum=50)
    return drawn.groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT vec_id, unnest(embedding) AS x FROM embeddings")
def explode(spark, sf_dir):
    return run_operator("explode", table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), field="embedding", exploded_cols=["x"], drop=["embedding"])


@query("SELECT doc_id, nullif(nfc_normalize(text), '') AS text FROM documents -- no document holds a character whose forms NFC and NFKC differ")
def character_normalization(spark, sf_dir):
    return run_operator("character_normalization_mapper", docs(spark, sf_dir), field="text", output_field="text")


@query("SELECT doc_id, translate(text, 'aeiou.,', '') AS text FROM documents")
def character_removal(spark, sf_dir):
    return run_operator("character_removal_mapper", docs(spark, sf_dir), field="text", output_field="text", characters_to_remove="aeiou.,")


@query(r"SELECT doc_id, regexp_replace(text, '[^\P{C}\n]|[^\P{Z} ]', '', 'g') AS text FROM documents")
def unprintable_char_remove(spark, sf_dir):
    return run_operator("unprintable_char_remove_mapper", docs(spark, sf_dir, spread=True), field="text", output_field="text")


@query(f"SELECT doc_id, translate(text, '{TRADITIONAL}', '{SIMPLIFIED}') AS text FROM documents")
def chinese_traditional_to_simple(spark, sf_dir):
    return run_operator("chinese_traditional_to_simple_mapper", docs(spark, sf_dir, spread=True), field="text", output_field="text")


@query(r"SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda l: NOT regexp_matches(l, '[0-9]')), chr(10)) AS text FROM documents")
def filter_line_by_regex(spark, sf_dir):
    return run_operator("filter_line_by_regex_mapper", docs(spark, sf_dir), field="text", output_field="text", regex="[0-9]")


@query("SELECT s_name, n_name, levenshtein(s_name, n_name)::INTEGER AS d FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def edit_distance(spark, sf_dir):
    pairs = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_name", "n_name")
    return run_operator("edit_distance_mapper", pairs, fields=["s_name", "n_name"], output_field="d")


SHARE = "SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE (list_sum(list_transform(p, lambda x: length(x))) - list_sum(list_transform(list_distinct(p), lambda x: length(x)))) / length(text) END::FLOAT AS share FROM (SELECT doc_id, text, string_split(text, {}) AS p FROM documents)"


@query(SHARE.format("chr(10)"))
def duplicate_line_chr_fraction(spark, sf_dir):
    return run_operator("duplicate_line_chr_fraction_mapper", docs(spark, sf_dir), field="text", output_field="share", drop=["text"])


@query(SHARE.format("chr(10) || chr(10)"))
def duplicate_paragraph_chr_fraction(spark, sf_dir):
    return run_operator("duplicate_paragraph_chr_fraction_mapper", docs(spark, sf_dir), field="text", output_field="share", drop=["text"])


def _grams(low: int, high: int, name: str, top: bool) -> str:
    """Windows over all positions: which n-grams start there, whether they count, which characters they reach."""
    hit = "n > 1" if not top else "g = first_value(g) OVER (PARTITION BY doc_id ORDER BY n DESC, i)"
    one = """SELECT doc_id, avg(hit)::DOUBLE AS f{n} FROM (SELECT doc_id, max(start) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {back} PRECEDING AND CURRENT ROW) AS hit FROM (
      SELECT doc_id, i, CASE WHEN length(g) = {n} AND {hit} THEN 1 ELSE 0 END AS start FROM (SELECT *, CASE WHEN length(g) = {n} THEN count(*) OVER (PARTITION BY doc_id, g) ELSE 0 END AS n FROM (SELECT doc_id, i, substr(text, i, {n}) AS g FROM p)))) GROUP BY doc_id"""
    parts = " ".join(f"LEFT JOIN ({one.format(n=n, back=n - 1, hit=hit)}) t{n} USING (doc_id)" for n in range(low, high + 1))
    columns = ", ".join(f"coalesce(f{n}, 0) AS {name.format(n)}" for n in range(low, high + 1))
    return f"WITH p AS (SELECT doc_id, text, unnest(range(1, length(text) + 1)) AS i FROM documents) SELECT doc_id, {columns} FROM documents {parts}"


@query(_grams(5, 10, "dup_{}_ngram_chr_fraction", False))
def duplicate_ngram_chr_fraction(spark, sf_dir):
    return run_operator("duplicate_ngram_chr_fraction_mapper", docs(spark, sf_dir, spread=True), field="text", drop=["text"])


@query(_grams(3, 5, "top_{}_gram_chr_fraction", True))
def top_ngram_chr_fraction(spark, sf_dir):
    return run_operator("top_ngram_chr_fraction_mapper", docs(spark, sf_dir, spread=True), field="text", drop=["text"])


@query("""WITH t AS (SELECT doc_id, unnest(string_split(text, ' ')) AS token FROM documents), c AS (SELECT doc_id, token, count(*) AS tf FROM t GROUP BY ALL), d AS (SELECT token, count(*) AS df FROM c GROUP BY token)
  SELECT doc_id, token, tf, df, round_even(tf * (ln((SELECT count(*) FROM documents)::DOUBLE / (df + 1)) + 1), 4) AS tfidf FROM c JOIN d USING (token)""")
def tfidf(spark, sf_dir):
    made = run_operator("tfidf_mapper", with_tokens(docs(spark, sf_dir, spread=True)), field="tokens", output_field="scores")
    return run_operator("explode", made, field="scores", exploded_cols=["s"]).select("doc_id", "s.token", "s.tf", "s.df", "s.tfidf")


@query(r"""SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) AS scheme, lower(regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1)) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path,
  CASE WHEN url LIKE 'https:%' THEN '443' ELSE '80' END AS port, regexp_extract(url, '\?([^#]*)', 1) AS query FROM pages""")
def url_component_extraction(spark, sf_dir):
    return run_operator("url_component_extraction_mapper", table(spark, sf_dir, "pages").select("page_id", "url"), field="url", drop=["url"])


@query(r"""SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) || '://' || lower(regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1)) AS origin, regexp_extract(url, '#(.*)$', 1) AS fragment,
  array_to_string(list_sort(string_split(regexp_extract(url, '\?([^#]*)', 1), '&')), '&') AS args FROM pages""")
def url_origin_and_args(spark, sf_dir):
    """The other components; the arguments are written as pairs again."""
    made = run_operator("url_component_extraction_mapper", table(spark, sf_dir, "pages").select("page_id", "url"), field="url", required_components=["origin", "fragment", "args"], drop=["url"])
    pairs = F.transform(F.map_entries(F.from_json("args", "map<string,string>")), lambda kv: F.concat(kv["key"], F.lit("="), kv["value"]))
    return made.withColumn("args", F.array_join(F.array_sort(pairs), "&"))


@query(r"""SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1)) || regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) ||
  coalesce('?' || array_to_string(list_sort(string_split(nullif(regexp_extract(url, '\?([^#]*)', 1), ''), '&')), '&'), '') AS url FROM pages""")
def url_normalization(spark, sf_dir):
    return run_operator("url_normalization_mapper", table(spark, sf_dir, "pages").select("page_id", "url"), field="url", output_field="url")


@query("SELECT event_id, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') || '|' || strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS dates FROM events")
def datetime_extraction(spark, sf_dir):
    said = F.concat(F.lit("Seen on "), F.date_format("ts", "yyyy-MM-dd 'at' HH:mm"), F.lit(", noted "), F.date_format("ts", "MMMM d, yyyy"), F.lit("."))
    found = run_operator("datetime_extraction_mapper", table(spark, sf_dir, "events").select("event_id", said.alias("text")), field="text", output_field="dates", drop=["text"])
    return found.withColumn("dates", F.array_join("dates", "|"))


@query(r"""SELECT doc_id, array_to_string(list_transform(list_filter(list_transform(
    regexp_extract_all(text, '\b(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|(?:January|February|March|April|May|June|July|August|September|October|November|December) [0-9]{1,2}, [0-9]{4})\b'),
    lambda m: coalesce(try_strptime(m, '%Y-%m-%d'), try_strptime(m, '%B %d, %Y'))), lambda d: d IS NOT NULL), lambda d: strftime(d, '%Y-%m-%d %H:%M:%S')), '|') AS dates FROM documents""")
def datetime_extraction_documents(spark, sf_dir):
    """The dates of every document; the SQL reads two forms by itself, others a test holds against brute force."""
    found = run_operator("datetime_extraction_mapper", docs(spark, sf_dir, spread=True), field="text", output_field="dates", drop=["text"])
    return found.withColumn("dates", F.array_join("dates", "|"))


@query("SELECT event_id, floor(epoch(ts))::BIGINT - 28800 AS seconds FROM events")
def timestamp_mapper(spark, sf_dir):
    written = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("dt"))
    return run_operator("timestamp_mapper", written, field="dt", output_field="seconds", tz="UTC+08:00", drop=["dt"])


@query(r"""WITH a AS (SELECT page_id, regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<(/?p|/?h1|br)[^<>]*>', chr(1), 'g') AS x FROM pages),
  b AS (SELECT page_id, list_transform(string_split(regexp_replace(x, '<[^<>]*>', '', 'g'), chr(1)), lambda s: regexp_replace(replace(replace(replace(replace(s, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;?', '&', 'g')) AS x FROM a)
  SELECT page_id, nullif(array_to_string(list_filter(list_transform(x, lambda s: trim(regexp_replace(s, '\s+', ' ', 'g'))), lambda s: s <> ''), chr(10)), '') AS text FROM b""")
def html_content_extract(spark, sf_dir):
    """The pages' text is in one article; the SQL takes its headings and paragraphs, the operator has to find it."""
    return run_operator("html_content_extract_mapper", table(spark, sf_dir, "pages", spread=True).select("page_id", "html"), field="html", output_field="text", drop=["html"])


@query("""SELECT DISTINCT page_id, class FROM (SELECT page_id, unnest(string_split_regex(c, '\\s+')) AS class FROM (SELECT page_id, unnest(regexp_extract_all(html, '<[^<>]* class="([^"]*)"', 1)) AS c FROM pages)) WHERE class <> ''""")
def css_extraction(spark, sf_dir):
    found = run_operator("css_extraction_mapper", table(spark, sf_dir, "pages", spread=True).select("page_id", "html"), field="html", output_field="classes", drop=["html"])
    return run_operator("explode", found, field="classes", exploded_cols=["class"], drop=["classes"])


@query("SELECT page_id, regexp_extract(html, '<article.*?(<h1>.*?</h1>)', 1, 's') AS heads FROM pages")
def dom_element_extraction(spark, sf_dir):
    return run_operator("dom_element_extraction_mapper", table(spark, sf_dir, "pages", spread=True).select("page_id", "html"), field="html", output_field="heads", css_selector="article h1", as_written=True, drop=["html"])


def _treebank() -> str:
    text = "text"
    for pattern, to in TREEBANK:
        quoted = [x.replace("'", "''") for x in (pattern, to.replace("$", "\\"))]
        text = f"regexp_replace({text}, '{quoted[0]}', '{quoted[1]}', 'g')"
    return f"SELECT doc_id, trim(regexp_replace({text}, '\\s+', ' ', 'g')) AS tokens FROM documents"


@query(_treebank())
def nltk_tokenizer(spark, sf_dir):
    made = run_operator("nltk_tokenizer_mapper", docs(spark, sf_dir, spread=True), field="text", output_field="tokens", drop=["text"])
    return made.withColumn("tokens", F.array_join("tokens", " "))


@query(r"""SELECT doc_id, array_to_string(list_filter(regexp_extract_all(text, '(?s)[A-Za-z0-9]+(?:\.[0-9]+)?%?|[+#&._%-]+|\r\n|.'), lambda t: NOT regexp_matches(t, '\pP')), '|') AS tokens FROM documents""")
def jieba_chinese_tokenizer(spark, sf_dir):
    """The documents hold no Chinese; the SQL has the rules for everything else."""
    made = run_operator("jieba_chinese_tokenizer_mapper", docs(spark, sf_dir, spread=True), field="text", output_field="tokens", drop=["text"])
    return made.withColumn("tokens", F.array_join("tokens", "|"))


@query()
def language_identification(spark, sf_dir):
    return run_operator("language_identification_mapper", docs(spark, sf_dir, spread=True), field="text", output_field="language", drop=["text"])


ACCENTED = "éèàçêäöüßñíóú"


@query(f"""SELECT doc_id, CASE WHEN a >= 0.02 THEN 'accented' ELSE 'other' END AS label, 1 / (1 + exp(-abs(a - 0.02))) AS prob FROM (SELECT doc_id,
  (length(t) - length(regexp_replace(t, '[{ACCENTED}]', '', 'g'))) / length(t) AS a FROM (SELECT doc_id, replace(text, chr(10), '') AS t FROM documents))""")
def fasttext_model(spark, sf_dir):
    path = _resource(spark, {"ngrams": [1, 1], "bias": {"other": 0.02}, "weights": {"accented": dict.fromkeys(ACCENTED, 1.0), "other": {}}})
    return run_operator("fasttext_model_mapper", docs(spark, sf_dir, spread=True), field="text", output_field="label", prob_field="prob", model_path=path, drop=["text"])


@query()
def fitted_label_model(spark, sf_dir):
    """Language by a model that is fitted on the labelled documents but a third of them, for all documents. A test has its accuracy on that third."""
    given = table(spark, sf_dir, "documents", spread=True).select("doc_id", "text", "lang")
    model = fit_label_model(given.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1), "text", "lang")
    path = _resource(spark, json.loads(model))
    return run_operator("language_identification_mapper", given, field="text", output_field="language", model_path=path, select=["doc_id", "language", "language_prob"])


@query()
def mask_pii(spark, sf_dir):
    chosen = {"EMAIL_ADDRESS": None, "PHONE_NUMBER": {"type": "replace", "new_value": "<PHONE>"}, "CREDIT_CARD": {"type": "redact"}, "IP_ADDRESS": None}
    return run_operator("mask_pii_mapper", docs(spark, sf_dir, spread=True), field="text", output_field="masked", mask_map=chosen, drop=["text"])


@query(r"SELECT doc_id, regexp_replace(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+\b', '<ANONYMIZED>', 'g') AS masked FROM documents")
def mask_pii_email(spark, sf_dir):
    return run_operator("mask_pii_mapper", docs(spark, sf_dir, spread=True), field="text", output_field="masked", mask_map={"EMAIL_ADDRESS": None}, drop=["text"])


@query("SELECT item_id, (length(text) + 7)::INTEGER AS length FROM benchmark")
def litellm(spark, sf_dir):
    def client():
        class Client:
            def complete(self, prompt):
                return json.dumps({"length": len(prompt)})

        return Client()

    items = table(spark, sf_dir, "benchmark")
    return run_operator(
        "litellm_mapper", items, field="text", output_field="a", model_name="stub", api_key="none", prompt_template="Count: {text}", return_format="json", answer_schema="length int", answer_flatten=True, client=client, select=["item_id", "length"]
    )


@query("SELECT doc_id, length(text)::INTEGER AS n FROM documents WHERE contains(text, ' the ')")
def streamed_mappers(spark, sf_dir):
    """Row-local operators over a stream of the documents, run to the end of what is there and read back from the shared folder."""
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    path = f"{sf_dir}/documents.parque[t]"  # as a pattern it may be a file or a folder
    folder = f"{shared_dir(spark)}/millrace-stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).parquet(path).select("doc_id", "text")
    out = over_stream(stream, [{"op_name": "substring_contain_filter", "field": "text", "substring": " the "}, {"op_name": "text_length_mapper", "field": "text", "output_field": "n", "drop": ["text"]}])
    out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


@query("SELECT doc_id, length(text)::INTEGER AS n FROM documents")
def written_and_read(spark, sf_dir):
    """Through the file sink, the table sink and the readers."""
    folder = f"{shared_dir(spark)}/millrace-written-{uuid.uuid4().hex}"
    made = run_operator("text_length_mapper", docs(spark, sf_dir), field="text", output_field="n", drop=["text"])
    run_operator("path_writer", made, path=folder, format="parquet", mode="overwrite")
    name = f"millrace_{uuid.uuid4().hex[:12]}"
    run_operator("hive_table_writer", run_operator("regular_path_reader", spark=spark, input_path=folder, format="parquet"), table_name=name, save_mode="overwrite", is_external=True, external_location=f"{folder}-table")
    return run_operator("hive_reader", spark=spark, table_name=name)


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'new ' ELSE '' END || n_name AS n_name, n_regionkey FROM nation")
def partitions_overwritten(spark, sf_dir):
    """A managed table by regions, of which one is written anew by a dynamic overwrite."""
    name, nations = f"millrace_{uuid.uuid4().hex[:12]}", table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    run_operator("hive_table_writer", nations, table_name=name, save_mode="overwrite", partition_by=["n_regionkey"])
    new = nations.filter("n_regionkey = 1").withColumn("n_name", F.concat(F.lit("new "), "n_name"))
    run_operator("hive_table_writer", new, table_name=name, save_mode="overwrite", partition_by=["n_regionkey"], dynamic_partition_overwrite=True)
    return run_operator("hive_reader", spark=spark, table_name=name)


@query("SELECT DISTINCT sha256(user_id::VARCHAR || ':' || event_type) AS gid FROM events")
def stream_deduplicator(spark, sf_dir):
    """Exact duplicates over a stream of the events; which row of a class is first depends on the stream, its class does not."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    folder = f"{shared_dir(spark)}/millrace-stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").select(F.col("ts").cast("timestamp").alias("ts"), F.concat_ws(":", "user_id", "event_type").alias("kind"))
    out = dedup_stream(stream, "kind", "ts", "3650 days")
    out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out").select("gid")


@query("SELECT n_nationkey::VARCHAR AS key, n_name AS name FROM nation")
def whole_files(spark, sf_dir):
    """A file for each nation, read back whole."""
    folder = f"{shared_dir(spark)}/millrace-files-{uuid.uuid4().hex}"
    nations = table(spark, sf_dir, "nation").select(F.concat_ws("|", "n_nationkey", "n_name").alias("value"))
    nations.repartition(32, "value").write.option("lineSep", ";").text(folder)
    read = run_operator("whole_text_file_reader", spark=spark, input_path=f"{folder}/part-*")
    line = F.explode(F.filter(F.split("text", ";"), lambda x: x != ""))
    return read.select(line.alias("x")).select(F.split_part("x", F.lit("|"), F.lit(1)).alias("key"), F.split_part("x", F.lit("|"), F.lit(2)).alias("name"))


@query("SELECT url, html AS content FROM pages")
def warc_responses(spark, sf_dir):
    """Pages as HTTP responses in compressed WARC files."""
    folder = f"{shared_dir(spark)}/millrace-warc-{uuid.uuid4().hex}"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), "html")
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), "url", F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(http).cast("string"), F.lit("\r\n\r\n"))
    table(spark, sf_dir, "pages").select(F.concat(head, http, F.lit("\r\n\r\n")).alias("value")).write.option("lineSep", "\n").option("compression", "gzip").text(folder)
    return run_operator("warc_wet_reader", spark=spark, input_path=f"{folder}/part-*", types=["response"])


@query("SELECT url, html AS content FROM pages")
def warc_wet_reader(spark, sf_dir):
    """Pages written as WARC records and read back."""
    folder = f"{shared_dir(spark)}/millrace-warc-{uuid.uuid4().hex}"
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: conversion\r\nWARC-Target-URI: "), "url", F.lit("\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit("\r\n\r\n"))
    table(spark, sf_dir, "pages").select(F.concat(head, "html", F.lit("\r\n\r\n")).alias("value")).write.option("lineSep", "\n").text(folder)
    return run_operator("warc_wet_reader", spark=spark, input_path=f"{folder}/part-*", types=["conversion"])

"""The queries over the test tables and their SQL for DuckDB."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import converters, mail, ranking, relations
from paperloom.operators.batches import map_rows
from paperloom.operators.words import best_similarity, word_bound
from paperloom.plans import report
from paperloom.sources.files import CORPUS_EXTENSIONS, DEFAULT_EXTENSIONS, corpus


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _corpus(s: SparkSession, d: str) -> DataFrame:
    return corpus(_t(s, d, "documents"))


def _stats(s: SparkSession, d: str) -> DataFrame:
    return relations.file_stats(_corpus(s, d).withColumn("method", F.lit("direct_read")))


def _entries(s: SparkSession, d: str) -> DataFrame:
    return report.entries(_corpus(s, d).withColumn("method", F.lit("direct_read")))


def bundle_md5(s: SparkSession, d: str) -> DataFrame:
    """A digest of each entry, and of each source's entries in order; only digests meet."""
    e = _entries(s, d).select(F.regexp_extract("rel_path", "^[^/]*", 0).alias("source"), "rel_path", F.md5(F.col("entry").cast("binary")).alias("digest"))
    return relations.ordered_digest(e, "source", "rel_path", "digest").withColumnRenamed("md5", "bundle_md5")


def thread_md5(s: SparkSession, d: str) -> DataFrame:
    c = _t(s, d, "conversations")
    part = F.concat(F.lit("### "), F.col("turn") + 1, F.lit(". "), "role", F.lit("\n\n```\n"), "text", F.lit("\n```\n\n"))
    return relations.ordered_digest(c.select("conv_id", "turn", F.md5(part.cast("binary")).alias("digest")), "conv_id", "turn", "digest").withColumnRenamed("md5", "thread_md5")


def _bench_stats(s: SparkSession, d: str) -> DataFrame:
    """Events stand for runs of converters: the type is the file, the user the converter, the value the time."""
    e = _t(s, d, "events").where("value is not null").withColumn("priority", F.col("user_id") % 7)
    runs = e.select(F.col("event_type").alias("file"), F.substring("event_type", 1, 1).alias("fmt"), F.concat(F.lit("c"), "priority").alias("converter"), "priority", F.lit(0).alias("run"), F.col("value").alias("elapsed"), F.lit("done").alias("text"))
    return ranking.run_stats(runs)


def _bench_rank(s: SparkSession, d: str) -> DataFrame:
    return ranking.scored(_bench_stats(s, d).withColumn("accuracy", F.col("priority") / 7))


def _converters(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Parts stand for converters that are asked for, line items of over 45 pieces for those that are there."""
    fmt = F.lit("any").alias("fmt")
    asked = _t(s, d, "part").select(fmt, F.col("p_partkey").alias("converter"))
    there = _t(s, d, "lineitem").where("l_quantity > 45").select(fmt, F.col("l_partkey").alias("converter"))
    return tuple(x.select(F.col("converter").alias("p_partkey")) for x in ranking.active_and_missing(asked, there))


def _tables(s: SparkSession, d: str) -> DataFrame:
    n = _t(s, d, "nation").select("n_regionkey", F.array(F.col("n_nationkey").cast("string"), F.when(F.col("n_nationkey") % 4 != 0, F.col("n_name"))).alias("row"), "n_nationkey")
    return n.groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "row"))), lambda x: x["row"]).alias("cells"))


def _attachment(s: SparkSession, d: str) -> DataFrame:
    """Documents stand for e-mails, labelled ones have a folder; sizes by kind."""
    place = F.concat(F.lit("mail/"), F.col("doc_id").cast("string"))
    emails = _t(s, d, "documents").select(place.alias("dir"), "text")
    files = _t(s, d, "labels").where("quality > 0").select(F.concat(place, F.lit("/"), F.get(F.array(*map(F.lit, relations.FOLDERS)), (F.col("doc_id") % 4).cast("int"))).alias("dir"))
    source = F.when(F.col("folder").isNotNull(), "Local folder").otherwise("Extracted from email")
    return relations.attachment_folder(emails, files).groupBy(T.email_label(source).alias("method")).agg(F.count("*").alias("emails"), F.sum(F.octet_length("text").cast("long")).alias("total_size"))


AUTH = ("spf=pass dkim=fail dmarc=pass", "spf=fail spf=pass", "dkim=pass", "none", "")


def _auth(s: SparkSession, d: str) -> DataFrame:
    c = _t(s, d, "customer").select("c_custkey", F.get(F.array(*map(F.lit, AUTH)), (F.col("c_custkey") % len(AUTH)).cast("int")).alias("auth"))
    return c.select("c_custkey", *[T.auth_result(F.col("auth"), x).alias(x) for x in ("spf", "dkim", "dmarc")])


def _first_success(s: SparkSession, d: str) -> DataFrame:
    """Line items stand for attempts: the line number is the priority, a discount of 0 a failure."""
    c = _t(s, d, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("priority"), F.col("l_linenumber").cast("string").alias("converter"), F.when(F.col("l_discount") > 0.03, F.col("l_returnflag")).alias("text"))
    return relations.first_success(c.groupBy("file", "priority", "converter").agg(F.min("text").alias("text")))


def _word_overlap(s: SparkSession, d: str) -> DataFrame:
    """How many of the long words that only one benchmark item has each document shares with it."""
    b = _t(s, d, "benchmark").select("item_id", F.explode(F.array_distinct(F.split("text", "[ \n]+"))).alias("w"))
    w = _t(s, d, "documents").select("doc_id", F.explode(F.array_distinct(F.split("text", "[ \n]+"))).alias("w"))
    rare = b.groupBy("w").agg(F.count("*").alias("n"), F.min("item_id").alias("item_id")).where("n = 1 and length(w) >= 12").select("w", "item_id")
    return w.join(rare, "w").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))


def _similarity(s: SparkSession, d: str) -> DataFrame:
    return best_similarity(_t(s, d, "documents"), _t(s, d, "benchmark"))


def _pages(s: SparkSession, d: str, fn, name: str) -> DataFrame:
    return map_rows(_t(s, d, "pages").select("page_id", "html"), lambda i, x: (i, fn(x or "")), f"page_id long, {name} string")


def _zips(s: SparkSession, d: str) -> DataFrame:
    """Each document in an archive of its own, unpacked again."""

    def run(i, name, text):
        with zipfile.ZipFile(held := io.BytesIO(), "w") as z:
            z.writestr("a.txt", text or "")
        return i, *converters.unzip(name + ".zip", held.getvalue())

    return map_rows(_corpus(s, d).select("doc_id", "name", "text"), run, "doc_id long, text string, method string")


def _emails(s: SparkSession, d: str) -> DataFrame:
    """Each document as the body of a message."""

    def run(i, text):
        return i, *mail.compile_email("m.eml", f"Subject: document {i}\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n{text or ''}".encode())

    return map_rows(_corpus(s, d).select("doc_id", "text"), run, "doc_id long, text string, method string")


Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "q_char_token_counts": lambda s, d: _t(s, d, "documents").select("doc_id", T.char_count(F.col("text")).alias("chars"), T.token_count(F.col("text")).alias("tokens")),
        "q_totals": lambda s, d: relations.totals(_stats(s, d)),
        "q_file_stats": _stats,
        "q_top5_files": lambda s, d: relations.top_files(_stats(s, d)).select("rank", "path", "chars", "tokens"),
        "q_top_per_language": lambda s, d: _t(s, d, "documents").select("lang", "doc_id", T.char_count(F.col("text")).alias("chars"), F.row_number().over(Window.partitionBy("lang").orderBy(F.desc(F.length("text")), "doc_id")).alias("rank")).where("rank <= 3"),
        "q_security_scan": lambda s, d: relations.suspicious(_corpus(s, d)).select("rel_path", "size"),
        "q_bundle_md5_by_source": bundle_md5,
        "q_thread_report_md5": thread_md5,
        "q_html_title": lambda s, d: _t(s, d, "pages").select("page_id", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"), (F.size(F.split("html", "<p>")) - 1).cast("long").alias("paragraphs")),
        "q_extension_filter": lambda s, d: relations.wanted(_corpus(s, d), list(DEFAULT_EXTENSIONS)).select("rel_path", "ext"),
        "q_exclude_regex": lambda s, d: relations.without(_corpus(s, d), ["7", r"^0+1\d*\.md"]).select("rel_path"),
        "q_language_map": lambda s, d: _corpus(s, d).select("rel_path", "ext", T.language(F.col("ext")).alias("language"), F.coalesce(T.converter_format(F.col("ext")), F.lit("none")).alias("fmt")),
        "q_ext_histogram": lambda s, d: _corpus(s, d).groupBy("ext").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.min("rel_path").alias("first")),
        "q_processing_mode": lambda s, d: relations.processing_mode(_corpus(s, d), ["dir"]),
        "q_directory_tree": lambda s, d: relations.directory_tree(_corpus(s, d)).select("rel_path", "kind", "line"),
        "q_human_sizes": lambda s, d: _corpus(s, d).select("rel_path", T.human_size(F.col("size")).alias("human")),
        "q_thousands": lambda s, d: _corpus(s, d).select("rel_path", T.thousands(F.col("size")).alias("bytes")),
        "q_markdown_table": lambda s, d: _tables(s, d).select("n_regionkey", T.markdown_table(F.col("cells")).alias("md")),
        "q_table_density": lambda s, d: _tables(s, d).select("n_regionkey", T.cell_density(F.col("cells")).alias("density")),
        "q_converter_first_success": _first_success,
        "q_converter_missing": lambda s, d: _converters(s, d)[1],
        "q_converter_active": lambda s, d: _converters(s, d)[0],
        "q_attachment_join": _attachment,
        "q_auth_results": _auth,
        "q_bench_stats": lambda s, d: _bench_stats(s, d).select("file", "priority", "runs", F.round("mean", 6).alias("mean"), "min", "max"),
        "q_bench_rank": lambda s, d: _bench_rank(s, d).select("file", "converter", F.round("combined_score", 6).alias("score"), "rank"),
        "q_bench_merge": lambda s, d: ranking.merged(_bench_rank(s, d)).select("fmt", F.array_join("ranking", ",").alias("ranking")),
        "q_word_overlap": _word_overlap,
        "q_word_bound": lambda s, d: word_bound(_t(s, d, "documents"), _t(s, d, "benchmark")),
        "q_word_similarity": _similarity,
        "q_html_to_markdown": lambda s, d: _pages(s, d, converters.html_to_markdown, "markdown"),
        "q_html_tables": lambda s, d: _pages(s, d, converters.html_tables_to_markdown, "text"),
        "q_zip_members": _zips,
        "q_email_compile": _emails,
    }


_WS = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_TOKENS = f"(len(regexp_extract_all(text, '[^{_WS}]+')) + CASE WHEN regexp_matches(text, '[.!?][{_WS}]*$') THEN 1 ELSE 0 END)::BIGINT"
_LIST = "[" + ", ".join(f"'{e}'" for e in CORPUS_EXTENSIONS) + "]"
_CORPUS = f"""corpus AS (SELECT *, source || '/' || name AS rel_path, lower(regexp_extract(name, '\\.[^.]*$')) AS ext, octet_length(encode(text))::BIGINT AS size FROM
 (SELECT *, lpad(doc_id::VARCHAR, 8, '0') || ({_LIST})[(doc_id % {len(CORPUS_EXTENSIONS)})::INT + 1] AS name FROM documents))"""
_STATS = f"WITH {_CORPUS}, stats AS (SELECT rel_path AS path, length(text)::BIGINT AS chars, {_TOKENS} AS tokens, 'direct_read' AS conversion_method FROM corpus)"
_LANGUAGE = "CASE ext " + " ".join(f"WHEN '{e}' THEN '{n}'" for e, n in T.LANGUAGES.items()) + " ELSE '' END"
_FORMAT = "CASE ext " + " ".join(f"WHEN '{e}' THEN '{n}'" for e, n in T.FORMATS.items()) + " ELSE 'none' END"
_BENCH = """b AS (SELECT event_type AS file, user_id % 7 AS priority, count(*) AS runs, avg(value) AS mean, min(value) AS min, max(value) AS max FROM events WHERE value IS NOT NULL GROUP BY ALL),
 s AS (SELECT *, 0.4 * CASE WHEN max(mean) OVER (PARTITION BY file) > 0 THEN 1 - mean / max(mean) OVER (PARTITION BY file) ELSE 1.0::DOUBLE END + 0.6 * priority / 7 AS score FROM b),
 r AS (SELECT *, 'c' || priority AS converter, row_number() OVER (PARTITION BY file ORDER BY score DESC, priority) AS rank FROM s)"""
_AUTH_LIST = "[" + ", ".join(f"'{a}'" for a in AUTH) + "]"
_CELLS = "c AS (SELECT n_regionkey, n_nationkey, n_nationkey::VARCHAR AS a, CASE WHEN n_nationkey % 4 <> 0 THEN n_name END AS b FROM nation)"
_HUMAN = " ".join(f"WHEN size < {1024 ** (p + 1)} THEN printf('%.1f {u}', (CASE WHEN (size * 10) % {1024**p} * 2 = {1024**p} THEN 2 * round((size * 10) / {1024**p}.0 / 2) ELSE round((size * 10) / {1024**p}.0) END) / 10)" for p, u in enumerate(("B", "KB", "MB", "GB")))


def oracle_sql() -> dict[str, str]:
    auth = ", ".join(f"CASE WHEN contains(auth, '{x}=pass') THEN 'Pass' WHEN contains(auth, '{x}=fail') THEN 'Fail' END AS {x}" for x in ("spf", "dkim", "dmarc"))
    suspicious = ", ".join(f"'{e}'" for e in relations.SUSPICIOUS)
    default = ", ".join(f"'{e}'" for e in DEFAULT_EXTENSIONS)
    return {
        "q_char_token_counts": f"SELECT doc_id, length(text)::BIGINT AS chars, {_TOKENS} AS tokens FROM documents",
        "q_totals": f"{_STATS} SELECT count(*) AS files, coalesce(sum(chars), 0)::BIGINT AS chars, coalesce(sum(tokens), 0)::BIGINT AS tokens FROM stats",
        "q_file_stats": f"{_STATS} SELECT * FROM stats",
        "q_top5_files": f"{_STATS} SELECT row_number() OVER (ORDER BY chars DESC, path)::INT AS rank, path, chars, tokens FROM stats ORDER BY chars DESC, path LIMIT 5",
        "q_top_per_language": "SELECT lang, doc_id, length(text)::BIGINT AS chars, row_number() OVER (PARTITION BY lang ORDER BY length(text) DESC, doc_id)::INT AS rank FROM documents QUALIFY rank <= 3",
        "q_security_scan": f"WITH {_CORPUS} SELECT rel_path, size FROM corpus WHERE ext IN ({suspicious}) AND (size > {relations.LARGE} OR regexp_matches(substr(text, 1, {relations.PREFIX}), '{relations.RISKY}'))",
        "q_bundle_md5_by_source": f"WITH {_CORPUS}, e AS (SELECT source, rel_path, md5('## File: ' || rel_path || ' (converted with direct_read)' || chr(10) || CASE WHEN ext IN ('.zip', '.eml', '.pdf') THEN text ELSE '````' || {_LANGUAGE} || chr(10) || text || chr(10) || '````' || chr(10) || chr(10) END) AS digest FROM corpus) SELECT source, md5(string_agg(digest, '' ORDER BY rel_path)) AS bundle_md5 FROM e GROUP BY source",
        "q_thread_report_md5": "SELECT conv_id, md5(string_agg(md5('### ' || (turn + 1) || '. ' || role || chr(10) || chr(10) || '```' || chr(10) || text || chr(10) || '```' || chr(10) || chr(10)), '' ORDER BY turn)) AS thread_md5 FROM conversations GROUP BY conv_id",
        "q_html_title": "SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, (len(string_split(html, '<p>')) - 1)::BIGINT AS paragraphs FROM pages",
        "q_extension_filter": f"WITH {_CORPUS} SELECT rel_path, ext FROM corpus WHERE ext IN ({default})",
        "q_exclude_regex": f"WITH {_CORPUS} SELECT rel_path FROM corpus WHERE NOT regexp_matches(name, '7') AND NOT regexp_matches(name, '^0+1\\d*\\.md')",
        "q_language_map": f"WITH {_CORPUS} SELECT rel_path, ext, {_LANGUAGE} AS language, {_FORMAT} AS fmt FROM corpus",
        "q_ext_histogram": f"WITH {_CORPUS} SELECT ext, count(*) AS files, sum(size)::BIGINT AS bytes, min(rel_path) AS first FROM corpus GROUP BY ext",
        "q_processing_mode": f"WITH {_CORPUS} SELECT source AS dir, CASE WHEN count(*) = 1 AND max(ext) = '.eml' THEN 'single_email' ELSE 'standard' END AS mode FROM corpus GROUP BY source",
        "q_directory_tree": f"WITH {_CORPUS} SELECT rel_path, 1 AS kind, '  ' || rel_path AS line FROM corpus UNION ALL SELECT DISTINCT source, 0, source || '/' FROM corpus",
        "q_human_sizes": f"WITH {_CORPUS} SELECT rel_path, CASE {_HUMAN} END AS human FROM corpus",
        "q_thousands": f"WITH {_CORPUS} SELECT rel_path, format('{{:,}}', size) AS bytes FROM corpus",
        "q_markdown_table": f"WITH {_CELLS}, l AS (SELECT n_regionkey, n_nationkey, '| ' || a || ' | ' || coalesce(b, '') || ' |' || CASE WHEN n_nationkey = min(n_nationkey) OVER (PARTITION BY n_regionkey) THEN chr(10) || '| --- | --- |' ELSE '' END AS line FROM c) SELECT n_regionkey, string_agg(line, chr(10) ORDER BY n_nationkey) AS md FROM l GROUP BY n_regionkey",
        "q_table_density": f"WITH {_CELLS} SELECT n_regionkey, (count(a) + count(b)) / (2.0 * count(*))::DOUBLE AS density FROM c GROUP BY n_regionkey",
        "q_converter_first_success": "WITH c AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS text FROM lineitem WHERE l_discount > 0.03 GROUP BY ALL) SELECT l_orderkey AS file, arg_min(l_linenumber::VARCHAR, l_linenumber) AS method, arg_min(text, l_linenumber) AS text FROM c GROUP BY l_orderkey",
        "q_converter_missing": "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)",
        "q_converter_active": "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)",
        "q_attachment_join": "SELECT CASE WHEN l.quality > 0 THEN 'email+local_folder' ELSE 'email+extracted_from_email' END AS method, count(*) AS emails, sum(octet_length(encode(text)))::BIGINT AS total_size FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1",
        "q_auth_results": f"WITH a AS (SELECT c_custkey, ({_AUTH_LIST})[(c_custkey % {len(AUTH)})::INT + 1] AS auth FROM customer) SELECT c_custkey, {auth} FROM a",
        "q_bench_stats": f"WITH {_BENCH} SELECT file, priority, runs, round(mean, 6) AS mean, min, max FROM b",
        "q_bench_rank": f"WITH {_BENCH} SELECT file, converter, round(score, 6) AS score, rank::INT AS rank FROM r",
        "q_bench_merge": f"WITH {_BENCH}, f AS (SELECT substr(file, 1, 1) AS fmt, converter, min({{'f': file, 'r': rank}}) AS pos FROM r GROUP BY 1, 2) SELECT fmt, string_agg(converter, ',' ORDER BY pos, converter) AS ranking FROM f GROUP BY fmt",
        "q_word_overlap": r"WITH b AS (SELECT item_id, unnest(list_distinct(regexp_split_to_array(text, '[ \n]+'))) AS w FROM benchmark), w AS (SELECT doc_id, unnest(list_distinct(regexp_split_to_array(text, '[ \n]+'))) AS w FROM documents), rare AS (SELECT w, min(item_id) AS item_id FROM b GROUP BY w HAVING count(*) = 1 AND length(w) >= 12) SELECT doc_id, item_id, count(*) AS shared FROM w JOIN rare USING (w) GROUP BY ALL",
    }

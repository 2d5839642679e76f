"""Queries over records, pages, names and replies, and over files read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ripplegraph.functions import text
from ripplegraph.operators import keywords
from ripplegraph.sources import readers, sinks

from .runtime import place, query, with_ordinal

S = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"  # strip


def strip_sql(x: str) -> str:
    return S.replace("{}", x)


# --- records ----------------------------------------------------------------------------
query("src_wos_split", lambda k: _records(k).select(text.paper_id(F.col("doc")).alias("paper_id")), "SELECT 'WOS:' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS paper_id FROM rec WHERE doc IS NOT NULL")


def _records(k):
    path = place(k.spark, "records")
    k.records.where("doc IS NOT NULL").select("doc").write.text(path)
    return readers.read_records(k.spark, path)


def field_sql(tag: str, anchored: bool = True) -> str:
    return f"regexp_extract(doc, '(?s){chr(92) + 'n' if anchored else ''}{tag} (.*?)\\n[A-Z]{{2}} ', 1)"


TAGS = ("TI", "AB", "SO", "DI", "SC", "UT", "PY")
query("prj_wos_fields", lambda k: k.records.where("doc IS NOT NULL").select("doc_id", *[text.collapse(text.field(F.col("doc"), t)).alias(t.lower()) for t in TAGS]), "SELECT doc_id, " + ", ".join(f"trim(regexp_replace({field_sql(t)}, '\\s+', ' ', 'g')) AS {t.lower()}" for t in TAGS) + " FROM rec WHERE doc IS NOT NULL")
query("fn_collapse_ws", lambda k: k.table("pages").select("page_id", text.collapse(F.col("html")).alias("html")), "SELECT page_id, trim(regexp_replace(html, '\\s+', ' ', 'g')) AS html FROM pages")
YEAR = "coalesce(" + ", ".join(f"try_cast(nullif(regexp_extract(doc, '\\n{p}(\\d{{4}})', 1), '') AS INTEGER)" for p in ("PY ", "EA .*?", "PD .*?")) + ")"
query("prj_year", lambda k: k.records.select("doc_id", text.year(F.col("doc")).alias("year")), f"SELECT doc_id, {YEAR} AS year FROM rec")
query("flt_kg_only", lambda k: k.records.select("doc_id", F.nullif(F.regexp_extract("doc", r"\nPY (\d{4})", 1), F.lit("")).cast("int").alias("py")).where("py <= 2024"), "SELECT * FROM (SELECT doc_id, try_cast(nullif(regexp_extract(doc, '\\nPY (\\d{4})', 1), '') AS INTEGER) AS py FROM rec) WHERE py <= 2024")
query("prj_paper_id", lambda k: k.records.select("doc_id", text.paper_id(F.col("doc")).alias("paper_id")), "SELECT doc_id, CASE WHEN doc IS NOT NULL THEN 'WOS:' || lpad(CAST(doc_id AS VARCHAR), 9, '0') END AS paper_id FROM rec")
query("prj_safe_name", lambda k: k.table("pages").select("page_id", text.safe_name(F.col("url")).alias("name")), """SELECT page_id, regexp_replace(url, '[<>:"/\\\\|?*]', '_', 'g') AS name FROM pages""")


def _bibliography(k):
    """paper_id, year, journal, doi, split of every record."""
    d = F.col("doc")
    year = text.year(d)
    return k.records.where("doc IS NOT NULL").select(text.paper_id(d).alias("paper_id"), year.alias("year"), text.collapse(text.field(d, "SO")).alias("journal"), text.collapse(text.field(d, "DI")).alias("doi"), F.when(year <= 2024, "KG_Construction").otherwise("Holdout_QA").alias("split"))


BIB = f", bib AS (SELECT 'WOS:' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS paper_id, {YEAR} AS year, trim(regexp_replace({field_sql('SO')}, '\\s+', ' ', 'g')) AS journal, trim(regexp_replace({field_sql('DI')}, '\\s+', ' ', 'g')) AS doi, CASE WHEN {YEAR} <= 2024 THEN 'KG_Construction' ELSE 'Holdout_QA' END AS split FROM rec WHERE doc IS NOT NULL)"
query("agg_dataset_stats", lambda k: _bibliography(k).agg(F.count("*").alias("n"), F.count_if(F.col("split") == "KG_Construction").alias("kg"), F.min("year").alias("first"), F.max("year").alias("last"), F.count_if(F.col("doi") != "").alias("doi"), F.count_distinct(F.nullif("journal", F.lit(""))).alias("journals"), F.count_if(F.col("paper_id") == "").alias("empty"), (F.count("*") - F.count_distinct("paper_id")).alias("duplicates")), f"{BIB} SELECT count(*) AS n, count(*) FILTER (WHERE split = 'KG_Construction') AS kg, min(year) AS first, max(year) AS last, count(*) FILTER (WHERE doi <> '') AS doi, count(DISTINCT nullif(journal, '')) AS journals, count(*) FILTER (WHERE paper_id = '') AS empty, count(*) - count(DISTINCT paper_id) AS duplicates FROM bib")
query("srt_dataset", lambda k: with_ordinal(_bibliography(k).select("paper_id", "year", (-F.coalesce("year", F.lit(0))).alias("key")), "key", "paper_id", name="place").select("place", "paper_id", "year"), f"{BIB} SELECT row_number() OVER (ORDER BY year DESC NULLS LAST, paper_id) AS place, paper_id, year FROM bib")


def _csv_round(k):
    path = place(k.spark, "csv")
    sinks.write_csv(_bibliography(k), path, bom=True)
    return readers.read_csv_header(k.spark, path, "paper_id string, year int, journal string, doi string, split string")


query("src_csv_header", _csv_round, f"{BIB} SELECT paper_id, year, nullif(journal, '') AS journal, nullif(doi, '') AS doi, split FROM bib")
query("snk_csv", lambda k: _csv_round(k).groupBy("split").agg(F.count("*").alias("n"), F.sum("year").alias("years")), f"{BIB} SELECT split, count(*) AS n, CAST(sum(year) AS BIGINT) AS years FROM bib GROUP BY split")


def _positional(k):
    """A list with a blank line after every entry, numbered by line."""
    path = place(k.spark, "list")
    k.spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(50)), lambda i: F.concat(i, F.lit("-"), 2 * i, F.lit("\n"))), "\n").alias("value")).write.text(path)
    return readers.read_csv_positional(k.spark, path)


query("src_csv_positional", _positional, "SELECT CAST(2 * i - 1 AS INTEGER) AS pos, i || '-' || 2 * i AS value FROM (SELECT unnest(range(1, 51)) AS i)")
query("jn_position", lambda k: _positional(k).join(k.spark.range(1, 101).select(F.col("id").cast("int").alias("pos")), "pos").select("pos", F.size(text.page_range(F.col("value"))).alias("pages")), "SELECT CAST(2 * i - 1 AS INTEGER) AS pos, CAST(i + 1 AS INTEGER) AS pages FROM (SELECT unnest(range(1, 51)) AS i)")
query("fn_parse_range", lambda k: k.table("customer").select("c_custkey", F.explode(text.page_range(F.concat("c_nationkey", F.lit("-"), F.col("c_nationkey") + 3))).alias("page")), "SELECT c_custkey, CAST(unnest(range(c_nationkey, c_nationkey + 4)) AS INTEGER) AS page FROM customer")
query("src_pdf_slice", lambda k: k.pages.join(k.pages.groupBy("doc_id").agg(F.max("page_no").alias("last")), "doc_id").where("page_no BETWEEN 2 AND least(4, last)").select("doc_id", "page_no", "text"), "SELECT doc_id, page_no, text FROM pg WHERE page_no BETWEEN 2 AND 4")


def _jsonl(k):
    path = place(k.spark, "jsonl")
    for split in ("kg", "holdout"):
        sinks.append_jsonl(k.kg.where(F.col("split") == split).select("ordinal", "paper_id", "start_node", "end_node"), path)
    return readers.read_jsonl(k.spark, path, "ordinal long, paper_id string, start_node string, end_node string")


query("src_jsonl", _jsonl, "SELECT ordinal, paper_id, start_node, end_node FROM kg")
query("snk_jsonl_append", lambda k: _jsonl(k).groupBy("paper_id").agg(F.count("*").alias("n")), "SELECT paper_id, count(*) AS n FROM kg GROUP BY paper_id")


def _split_json(k):
    path = place(k.spark, "split")
    sinks.write_split_json(k.kg.select("ordinal", "split", "start_node"), path)
    return k.spark.read.schema("ordinal long, start_node string, split string").json(path)


query("snk_split_json", _split_json, "SELECT ordinal, start_node, split FROM kg")


def _map_round(k):
    path = place(k.spark, "map")
    k.node_layers.select(F.col("node").alias("entity"), "layer").selectExpr("entity", "layer AS canonical").write.parquet(path)
    return readers.read_merge_map(k.spark, path).union(readers.read_merge_map(k.spark, path + "-none"))


query("src_merge_map", _map_round, "SELECT node AS entity, layer AS canonical FROM nl")
query("src_tensor", lambda k: (lambda path: (k.table("embeddings").write.parquet(path), k.spark.read.parquet(path))[1])(place(k.spark, "tensor")).select("vec_id", F.size("embedding").alias("width"), "label"), "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS width, label FROM embeddings")


def _quarantine(k):
    """Replies that are no JSON, with what they hold, kept apart from those that are."""
    path = place(k.spark, "raw")
    k.kg.select(F.when(F.col("confidence").isNull(), F.concat(F.lit("{broken "), "start_node")).otherwise(F.to_json(F.struct("start_node", "end_node")))).write.text(path)
    return readers.read_quarantine(k.spark, path)


query("snk_error_log", _quarantine, "SELECT '{broken ' || start_node AS payload FROM kg WHERE confidence IS NULL")
query("ctl_error_isolation", lambda k: _quarantine(k).agg(F.count("*").alias("bad")), "SELECT count(*) AS bad FROM kg WHERE confidence IS NULL")

# --- pages ------------------------------------------------------------------------------
NOISY = "'<!-- Meanless: a' || chr(10) || 'b -->' || text || '<img src=\"x\" /><!-- Media --> <td>cell</td><!-- Footnote -->' || chr(10) || chr(10) || chr(10) || chr(10) || '<!-- figureText: y' || chr(10) || '-->end'"


def clean_sql(x: str) -> str:
    for pattern, put in text.NOISE:
        x = f"regexp_replace({x}, '{pattern}', '{put}', 'g')" if "\n" not in put else f"regexp_replace({x}, '{pattern}', chr(10) || chr(10), 'g')"
    return strip_sql(x)


query("fn_clean_page", lambda k: k.pages.select("doc_id", "page_no", text.clean_page(F.expr(NOISY)).alias("text")), f"SELECT doc_id, page_no, {clean_sql('(' + NOISY + ')')} AS text FROM pg")
MARKDOWN = "'preamble' || chr(10) || '<!-- page 1, score: 95 -->' || chr(10) || chr(10) || replace(text, chr(10), chr(10) || chr(10) || '---' || chr(10) || chr(10) || '<!-- page 2, score: 90 -->' || chr(10) || chr(10))"
query("fn_split_pages", lambda k: k.table("documents").where("text IS NOT NULL").select("doc_id", F.posexplode(text.split_pages(F.expr(MARKDOWN))).alias("pos", "page")).select("doc_id", "pos", "page"), f", m AS (SELECT doc_id, string_split_regex({MARKDOWN}, '{text.MARKER}') AS p FROM documents WHERE text IS NOT NULL), u AS (SELECT doc_id, unnest(range(len(p) - 1)) AS pos, unnest(p[2:]) AS page FROM m) SELECT doc_id, CAST(pos AS INTEGER) AS pos, " + clean_sql(strip_sql("regexp_replace(" + strip_sql("page") + ", '-+$', '')")) + " AS page FROM u")
query("fn_assemble_md", lambda k: k.pages.where("trim(text) <> ''").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", F.trim("text").alias("t")))).alias("p")).select("doc_id", F.sha2(F.array_join(F.transform("p", lambda x: F.concat(F.lit("<!-- page "), x["page_no"], F.lit(", score: 1 -->\n\n"), x["t"])), "\n\n---\n\n"), 256).alias("digest")), "SELECT doc_id, sha256(string_agg('<!-- page ' || page_no || ', score: 1 -->' || chr(10) || chr(10) || trim(text), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY page_no)) AS digest FROM pg WHERE trim(text) <> '' GROUP BY doc_id")


def _markdown_files(k):
    path = place(k.spark, "markdown")
    k.table("benchmark").repartition(8, "item_id").select("text").write.text(path)
    return readers.read_markdown(k.spark, path)


query("src_markdown", lambda k: _markdown_files(k).select(F.explode(F.split(F.regexp_replace("text", "\n$", ""), "\n")).alias("line")), "SELECT unnest(string_split(text, chr(10))) AS line FROM benchmark")
WORDS = f"CASE WHEN {strip_sql('text')} = '' THEN 0 ELSE len(string_split_regex({strip_sql('text')}, '\\s+')) END"
query("fn_word_count", lambda k: k.pages.select("doc_id", "page_no", text.word_count(F.col("text")).alias("words")), f"SELECT doc_id, page_no, CAST({WORDS} AS INTEGER) AS words FROM pg")
SENTENCES = "list_filter(string_split_regex(regexp_replace({}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: length(s) > 10)"
query("flt_min_frag", lambda k: k.pages.select("doc_id", "page_no", F.size(F.filter(F.split(text.strip(F.col("text")), r"(?<=[.!?])\s+"), lambda s: F.length(s) > text.FRAGMENT)).alias("n")), f"SELECT doc_id, page_no, CAST(len({SENTENCES.replace('{}', strip_sql('text'))}) AS INTEGER) AS n FROM pg")
query("fn_last_n_sentences", lambda k: k.pages.select("doc_id", "page_no", text.last_sentences(F.col("text")).alias("tail")), f"SELECT doc_id, page_no, array_to_string({SENTENCES.replace('{}', strip_sql('text'))}[-2:], ' ') AS tail FROM pg")
CHUNKS = (
    f", p AS (SELECT doc_id, page_no, {strip_sql('text')} AS text FROM pg), e AS (SELECT *, {WORDS} >= {text.MIN_WORDS} OR lead(page_no) OVER (PARTITION BY doc_id ORDER BY page_no) IS NULL AS ends FROM p), "
    "g AS (SELECT *, coalesce(sum(CASE WHEN ends THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM e), "
    f"j AS (SELECT doc_id, chunk, {strip_sql('string_agg(text, chr(10) || chr(10) ORDER BY page_no)')} AS text, string_agg(page_no, ',' ORDER BY page_no) AS pages FROM g GROUP BY doc_id, chunk), "
    "c AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY chunk) AS before FROM j)"
)
query("win_chunk_islands", lambda k: text.chunks(k.pages).select("doc_id", "chunk", F.sha2("text", 256).alias("digest"), F.array_join(F.transform("page_nums", lambda x: x.cast("string")), ",").alias("pages")), f"{CHUNKS} SELECT doc_id, CAST(chunk AS BIGINT) AS chunk, sha256(text) AS digest, pages FROM c WHERE text <> ''")
CONTEXT = f"coalesce(array_to_string({SENTENCES.replace('{}', 'before')}[-2:], ' '), '')"
query("win_prev_context", lambda k: text.chunks(k.pages).select("doc_id", "chunk", "context"), f"{CHUNKS} SELECT doc_id, CAST(chunk AS BIGINT) AS chunk, {CONTEXT} AS context FROM c WHERE text <> ''")
query("fn_prompt_context", lambda k: text.chunks(k.pages).select("doc_id", "chunk", F.sha2(text.prompt(F.col("context"), F.col("text")), 256).alias("digest")), f"{CHUNKS} SELECT doc_id, CAST(chunk AS BIGINT) AS chunk, sha256(CASE WHEN {CONTEXT} <> '' THEN '[Context of the page before; extract nothing from it]' || chr(10) || {CONTEXT} || chr(10) || chr(10) || '---' || chr(10) || chr(10) || text ELSE text END) AS digest FROM c WHERE text <> ''")

# --- names ------------------------------------------------------------------------------


def readable_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')"


query("fn_readable", lambda k: k.node_layers.select("node", text.readable(F.col("node")).alias("name")), f"SELECT node, {readable_sql('node')} AS name FROM nl")
query("fn_format_entity", lambda k: k.node_layers.select("node", text.title_case(F.concat("node", F.lit("_of_it"))).alias("name")), f"SELECT node, array_to_string(list_transform(string_split(replace({readable_sql('node')} || '_of_it', '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS name FROM nl")
query("fn_keyword_layer", lambda k: k.node_layers.select("node", keywords.layer(F.col("node")).alias("layer")), f"SELECT node, {keywords.layer_sql('node')} AS layer FROM nl")
query("fn_subcategory", lambda k: k.node_layers.select("node", keywords.subcategory(F.col("node"), F.col("layer")).alias("sub")), f"SELECT node, {keywords.subcategory_sql('node', 'layer')} AS sub FROM nl")
query("fn_truncate", lambda k: k.kg.select("ordinal", text.truncate(F.col("evidence_sentence"), 50).alias("t")), "SELECT ordinal, CASE WHEN length(evidence_sentence) <= 50 THEN evidence_sentence ELSE substr(evidence_sentence, 1, 47) || '...' END AS t FROM kg")


def latex_sql(x: str) -> str:
    for old, new in text.LATEX:
        x = f"replace({x}, '{old}', '{new}')"
    return x


query("fn_latex_escape", lambda k: k.table("pages").select("page_id", F.sha2(text.latex(F.col("html")), 256).alias("digest")), f"SELECT page_id, sha256({latex_sql('html')}) AS digest FROM pages")




query("fn_highlight", lambda k: k.kg.select("ordinal", text.highlighted(F.col("evidence_sentence"), F.col("start_node"), F.col("end_node")).alias("evidence")))
query("fn_parse_answer", lambda k: k.table("conversations").select("conv_id", "turn", text.answer(F.col("text")).alias("answer")), "SELECT conv_id, turn, CASE WHEN contains(upper(text), 'A') THEN 'A' WHEN contains(upper(text), 'B') THEN 'B' WHEN contains(upper(text), 'C') THEN 'C' WHEN contains(upper(text), 'D') THEN 'D' ELSE 'X' END AS answer FROM conversations")

# --- replies ----------------------------------------------------------------------------
BODY = """'{"start_node": "' || start_node || '", "end_node": "' || end_node || '"}'"""
query("fn_json_fence", lambda k: k.kg.select("ordinal", text.unfence(F.concat(F.lit("```json\n"), F.expr(BODY), F.lit("\n```"))).alias("body")), f"SELECT ordinal, {BODY} AS body FROM kg")
query("fn_json_unwrap", lambda k: k.kg.select("ordinal", F.size(F.from_json(text.unwrap(F.when(F.col("split") == "kg", F.concat(F.lit('{"relationships": ['), F.expr(BODY), F.lit(","), F.expr(BODY), F.lit("]}"))).otherwise(F.expr(BODY))), "array<struct<start_node:string,end_node:string>>")).alias("n")), "SELECT ordinal, CAST(CASE WHEN split = 'kg' THEN 2 ELSE 1 END AS INTEGER) AS n FROM kg")
DAMAGED = "CASE WHEN confidence IS NULL THEN '[' || {b} || ',{{\"start_node\": \"cut' WHEN confidence = 'low' THEN replace({b}, '\"', chr(39)) ELSE '/* note */ [' || {b} || ']' END".format(b=BODY)
query("fn_json_repair", lambda k: text.repair(k.kg.select(F.col("ordinal").alias("id"), F.expr(DAMAGED).alias("reply"))), """SELECT ordinal AS id, TRUE AS ok, '[{"end_node": "' || end_node || '", "start_node": "' || start_node || '"}]' AS objects FROM kg""")
query("fn_json_salvage", lambda k: text.repair(k.kg.where("confidence IS NULL").select(F.col("ordinal").alias("id"), F.expr(DAMAGED).alias("reply"))).select("id", "objects"), """SELECT ordinal AS id, '[{"end_node": "' || end_node || '", "start_node": "' || start_node || '"}]' AS objects FROM kg WHERE confidence IS NULL""")

"""Queries over triples, layers and joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ripplegraph.operators import keywords, layers, resolve, triples

from .runtime import query, with_ordinal

R6 = lambda c: F.round(c, 6)

# --- projections, filters -------------------------------------------------------------
query("prj_triple_clean", lambda k: k.clean, "SELECT * FROM cl")
query("prj_confidence", lambda k: k.kg.select("ordinal", triples.confidence_value(F.col("confidence")).alias("confidence_float")), "SELECT ordinal, cf AS confidence_float FROM cl")
query("flt_valid_items", lambda k: k.kg.where("start_node IS NOT NULL AND end_node IS NOT NULL").select("ordinal"), "SELECT ordinal FROM kg WHERE start_node IS NOT NULL AND end_node IS NOT NULL")
query("flt_no_self_loop", lambda k: k.clean.where("src <> dst").select("ordinal", "src", "dst"), "SELECT ordinal, src, dst FROM cl WHERE src <> dst")
query("flt_cross_layer", lambda k: k.clean.where(layers.cross(F.col("sl"), F.col("el"))).select("ordinal", "sl", "el"), "SELECT ordinal, sl, el FROM cl WHERE sl <> el AND sl IN (SELECT layer FROM valid) AND el IN (SELECT layer FROM valid)")
query("flt_directional", lambda k: k.clean.groupBy("paper_id").agg(layers.step("physical", "biological").alias("n")), "SELECT paper_id, count(*) FILTER (WHERE sl = 'physical' AND el = 'biological') AS n FROM cl GROUP BY paper_id")
query("flt_temporal_split", lambda k: k.kg.select("ordinal", triples.temporal_split(F.col("year"), 2000).alias("split")), "SELECT ordinal, CASE WHEN year <= 2000 THEN 'kg' ELSE 'holdout' END AS split FROM kg")
query("flt_resume", lambda k: k.clean.join(k.clean.where("split = 'holdout'").select("paper_id").distinct(), "paper_id", "left_anti").select("ordinal", "paper_id"), "SELECT ordinal, paper_id FROM cl WHERE paper_id NOT IN (SELECT paper_id FROM cl WHERE split = 'holdout')")
query("flt_touching", lambda k: triples.touching(k.clean, k.node_layers.where("node LIKE 'Heat%'").select(F.col("node").alias("entity"))).select("ordinal", "src", "dst"), "SELECT ordinal, src, dst FROM cl WHERE src IN (SELECT node FROM nl WHERE node LIKE 'Heat%') OR dst IN (SELECT node FROM nl WHERE node LIKE 'Heat%')")
query("flt_range_batch", lambda k: k.kg.where("ordinal BETWEEN 101 AND 200").select("ordinal", "paper_id"), "SELECT ordinal, paper_id FROM kg WHERE ordinal BETWEEN 101 AND 200")

# --- joins ------------------------------------------------------------------------------
MAP = "SELECT node AS entity, regexp_replace(node, '[0-9]+$', '') AS canonical FROM nl WHERE layer = 'physical'"


def _mapping(k):
    return k.node_layers.where("layer = 'physical'").select(F.col("node").alias("entity"), F.regexp_replace("node", "[0-9]+$", "").alias("canonical"))


MERGED = f"m AS ({MAP}), mg AS (SELECT cl.* EXCLUDE (src, dst), coalesce(a.canonical, src) AS src, coalesce(b.canonical, dst) AS dst FROM cl LEFT JOIN m a ON src = a.entity LEFT JOIN m b ON dst = b.entity)"
query("jn_merge_map", lambda k: triples.apply_mapping(k.clean, _mapping(k)).select("ordinal", "src", "dst"), f", {MERGED} SELECT ordinal, src, dst FROM mg")
query(
    "jn_map_chain",
    lambda k: triples.chain_mappings(_mapping(k), _mapping(k).select("canonical").distinct().select(F.col("canonical").alias("entity"), F.substring("canonical", 1, 4).alias("canonical"))),
    f", m AS ({MAP}), s AS (SELECT DISTINCT canonical AS entity, substr(canonical, 1, 4) AS canonical FROM m) SELECT m.entity, coalesce(s.canonical, m.canonical) AS canonical FROM m LEFT JOIN s ON m.canonical = s.entity UNION ALL SELECT entity, canonical FROM s WHERE entity NOT IN (SELECT entity FROM m)",
)


def _split_edges(k, split):
    return triples.collapse_last(k.clean.where(F.col("split") == split))


HALVES = "he AS (SELECT src, dst, max_by(rel, ordinal) AS rel FROM cl WHERE src <> dst AND split = 'holdout' GROUP BY src, dst), ke AS (SELECT DISTINCT src, dst FROM cl WHERE src <> dst AND split = 'kg')"
query("jn_edge_intersect", lambda k: _split_edges(k, "holdout").join(_split_edges(k, "kg").select("src", "dst"), ["src", "dst"], "left_semi").select("src", "dst", "rel"), f", {HALVES} SELECT he.* FROM he SEMI JOIN ke USING (src, dst)")
query("jn_edge_flag", lambda k: _split_edges(k, "holdout").select("src", "dst").join(_split_edges(k, "kg").select("src", "dst", F.lit(True).alias("in_kg")), ["src", "dst"], "left").withColumn("in_kg", F.coalesce("in_kg", F.lit(False))), f", {HALVES} SELECT src, dst, (src, dst) IN (SELECT (src, dst) FROM ke) AS in_kg FROM he")


def _nodes(edges):
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


query("jn_node_semi", lambda k: _nodes(_split_edges(k, "holdout")).join(_nodes(_split_edges(k, "kg")), "node", "left_semi"), f", {HALVES}, hn AS (SELECT src AS node FROM he UNION SELECT dst FROM he), kn AS (SELECT src AS node FROM ke UNION SELECT dst FROM ke) SELECT node FROM hn SEMI JOIN kn USING (node)")
query("set_intersect_nodes", lambda k: _nodes(_split_edges(k, "holdout")).intersect(_nodes(_split_edges(k, "kg"))), f", {HALVES} SELECT src AS node FROM (SELECT src FROM he UNION SELECT dst FROM he) INTERSECT SELECT src FROM (SELECT src FROM ke UNION SELECT dst FROM ke)")
query("set_union_all", lambda k: k.clean.where("split = 'kg'").unionByName(k.clean.where("split = 'holdout'")).groupBy("split").agg(F.count("*").alias("n")), "SELECT split, count(*) AS n FROM cl GROUP BY split")
query("set_except_leftover", lambda k: k.edges.select("src", "dst").join(_split_edges(k, "holdout").select("src", "dst"), ["src", "dst"], "left_anti"), f", {HALVES} SELECT src, dst FROM ed ANTI JOIN he USING (src, dst)")
query(
    "jn_abs_full",
    lambda k: k.kg.select("paper_id").distinct().join(k.clean.where("sl = 'physical'").groupBy("paper_id").agg(F.count("*").alias("n_abs")), "paper_id", "left").join(k.clean.where("el = 'economic'").groupBy("paper_id").agg(F.count("*").alias("n_full")), "paper_id", "left").agg(F.count("*").alias("papers"), F.count_if(F.isnull("n_abs")).alias("no_abs"), F.count_if(F.isnull("n_full")).alias("no_full")),
    ", p AS (SELECT paper_id, count(*) FILTER (WHERE sl = 'physical') AS a, count(*) FILTER (WHERE el = 'economic') AS f FROM cl GROUP BY paper_id) SELECT count(*) AS papers, count(*) FILTER (WHERE a = 0) AS no_abs, count(*) FILTER (WHERE f = 0) AS no_full FROM p",
)
query("jn_edge_attr", lambda k: k.clean.select("ordinal", "src", "dst").join(k.edges.select("src", "dst", "rel", "cf"), ["src", "dst"]), "SELECT cl.ordinal, cl.src, cl.dst, ed.rel, ed.cf FROM cl JOIN ed ON cl.src = ed.src AND cl.dst = ed.dst")
query(
    "jn_reverse_fallback",
    lambda k: (lambda e: k.clean.where("src < dst").select("ordinal", "src", "dst").join(e, ["src", "dst"], "left").join(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("rel").alias("back")), ["src", "dst"], "left").select("ordinal", F.coalesce("rel", "back").alias("rel")))(k.edges.where("sl <> 'social'").select("src", "dst", "rel")),
    ", e AS (SELECT src, dst, rel FROM ed WHERE sl <> 'social') SELECT cl.ordinal, coalesce(a.rel, b.rel) AS rel FROM cl LEFT JOIN e a ON cl.src = a.src AND cl.dst = a.dst LEFT JOIN e b ON cl.src = b.dst AND cl.dst = b.src WHERE cl.src < cl.dst",
)

# --- aggregates ---------------------------------------------------------------------------
query("agg_layer_counts", lambda k: layers.votes(k.clean).groupBy("layer").agg(F.count("*").alias("n")), "SELECT layer, count(*) AS n FROM votes GROUP BY layer")
query("agg_dominant_layer", lambda k: layers.majority(k.clean.select("paper_id", F.explode(layers.said()).alias("v")).select("paper_id", "v.*"), "paper_id"), ", v AS (SELECT paper_id, sl AS layer, 2 * ordinal AS pos FROM cl UNION ALL SELECT paper_id, el, 2 * ordinal + 1 FROM cl), t AS (SELECT paper_id, layer, count(*) AS n, min(pos) AS first FROM v WHERE layer IN (SELECT layer FROM valid) GROUP BY 1, 2) SELECT paper_id, layer FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY n DESC, first) AS rn FROM t) WHERE rn = 1")
query("agg_transition_edge", lambda k: layers.transitions(k.edges), "SELECT a.layer AS start_layer, b.layer AS end_layer, count(ed.src) AS n FROM valid a CROSS JOIN valid b LEFT JOIN ed ON ed.sl = a.layer AND ed.el = b.layer GROUP BY 1, 2")
NE = "ne AS (SELECT ed.*, a.layer AS nsl, b.layer AS nel FROM ed LEFT JOIN nl a ON src = a.node LEFT JOIN nl b ON dst = b.node)"
query("agg_transition_node", lambda k: layers.transitions(layers.with_node_layers(k.edges, k.node_layers), "nsl", "nel"), f", {NE} SELECT a.layer AS start_layer, b.layer AS end_layer, count(ne.src) AS n FROM valid a CROSS JOIN valid b LEFT JOIN ne ON nsl = a.layer AND nel = b.layer GROUP BY 1, 2")
BMR = "count(*) FILTER (WHERE {a} = 'physical' AND {b} = 'biological') AS pb, count(*) FILTER (WHERE {a} = 'biological' AND {b} = 'economic') AS be, count(*) FILTER (WHERE {a} = 'physical' AND {b} = 'economic') AS pe"
DIVIDE = "CASE WHEN pe = 0 AND pb + be = 0 THEN 0 WHEN pe = 0 THEN CAST('inf' AS DOUBLE) ELSE CAST(pb + be AS DOUBLE) / pe END AS bmr"
query("agg_bmr", lambda k: layers.mediation(k.edges), f", c AS (SELECT {BMR.format(a='sl', b='el')} FROM ed) SELECT pb, be, pe, {DIVIDE} FROM c")
query("agg_bmr_node", lambda k: layers.mediation(layers.with_node_layers(k.edges, k.node_layers), a="nsl", b="nel", on_zero="inf"), f", {NE}, c AS (SELECT {BMR.format(a='nsl', b='nel')} FROM ne) SELECT pb, be, pe, CASE WHEN pe = 0 THEN CAST('inf' AS DOUBLE) ELSE CAST(pb + be AS DOUBLE) / pe END AS bmr FROM c")
query("agg_cross_pct", lambda k: k.edges.agg(R6(F.avg(layers.cross(F.col("sl"), F.col("el")).cast("double"))).alias("of_all"), R6(F.avg(F.when(triples.is_layer(F.col("sl")) & triples.is_layer(F.col("el")), (F.col("sl") != F.col("el")).cast("double")))).alias("of_valid")), ", v AS (SELECT *, sl IN (SELECT layer FROM valid) AND el IN (SELECT layer FROM valid) AS ok FROM ed) SELECT round(avg(CASE WHEN ok AND sl <> el THEN 1.0::DOUBLE ELSE 0 END), 6) AS of_all, round(avg(CASE WHEN NOT ok THEN NULL WHEN sl <> el THEN 1.0::DOUBLE ELSE 0 END), 6) AS of_valid FROM v")
query(
    "agg_paper_metrics",
    lambda k: k.clean.groupBy("paper_id").agg(F.count("*").alias("n"), F.count_if(layers.cross(F.col("sl"), F.col("el"))).alias("crossing"), layers.step("physical", "economic").alias("pe")),
    "SELECT paper_id, count(*) AS n, count(*) FILTER (WHERE sl <> el AND sl IN (SELECT layer FROM valid) AND el IN (SELECT layer FROM valid)) AS crossing, count(*) FILTER (WHERE sl = 'physical' AND el = 'economic') AS pe FROM cl GROUP BY paper_id",
)
query("agg_edge_collapse_max", lambda k: k.edges, "SELECT * FROM ed")
query("agg_edge_collapse_last", lambda k: triples.collapse_last(k.clean).select("src", "dst", "rel", "cf", "ordinal"), "SELECT src, dst, max_by(rel, ordinal) AS rel, max_by(cf, ordinal) AS cf, max(ordinal) AS ordinal FROM cl WHERE src <> dst GROUP BY src, dst")
query(
    "agg_triple_dedup",
    lambda k: triples.deduplicate(k.kg).select("first", "ordinal", "start_node", "relationship", "end_node", "confidence"),
    ", r AS (SELECT *, CASE coalesce(confidence, 'low') WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS rank FROM kg), w AS (SELECT *, min(ordinal) OVER p AS first, row_number() OVER (PARTITION BY lower(start_node), lower(relationship), lower(end_node) ORDER BY rank DESC, ordinal) AS rn FROM r WINDOW p AS (PARTITION BY lower(start_node), lower(relationship), lower(end_node))) SELECT first, ordinal, start_node, relationship, end_node, confidence FROM w WHERE rn = 1",
)
query("agg_bridge", lambda k: layers.bridges(k.edges, k.node_layers), ", b AS (SELECT src AS node, dst AS other FROM ed UNION ALL SELECT dst, src FROM ed), l AS (SELECT node, layer FROM nl UNION ALL SELECT b.node, nl.layer FROM b JOIN nl ON b.other = nl.node) SELECT node, count(DISTINCT layer) AS n_layers FROM l GROUP BY node HAVING count(DISTINCT layer) >= 3")
query("agg_node_layers", lambda k: k.node_layers, "SELECT * FROM nl")
query("agg_layer_nodes", lambda k: _nodes(k.edges).join(k.node_layers, "node", "left").groupBy(F.coalesce("layer", F.lit("unknown")).alias("layer")).agg(F.count("*").alias("n")), "SELECT coalesce(layer, 'unknown') AS layer, count(*) AS n FROM deg LEFT JOIN nl USING (node) GROUP BY 1")
SCH = ", ".join(map(str, layers.scheme_rows()))
FI = f"fi AS (SELECT node, {keywords.split_biological_sql('node', 'layer')} AS layer FROM nl), s(scheme, layer, new, role) AS (VALUES {SCH})"
EXPERIMENT = f", {FI}, j AS (SELECT a.scheme, a.new AS a, b.new AS b, a.role AS ra, b.role AS rb FROM ed JOIN fi x ON src = x.node JOIN fi y ON dst = y.node JOIN s a ON x.layer = a.layer JOIN s b ON y.layer = b.layer AND a.scheme = b.scheme), c AS (SELECT scheme, count(*) AS edges, count(*) FILTER (WHERE a <> b) AS crossing, count(*) FILTER (WHERE ra = 'p' AND rb = 'b') AS pb, count(*) FILTER (WHERE ra = 'b' AND rb = 'e') AS be, count(*) FILTER (WHERE ra = 'p' AND rb = 'e') AS pe FROM j GROUP BY scheme)"
query("lay_experiment", lambda k: layers.experiment(k.edges, k.fine_layers), f"{EXPERIMENT} SELECT scheme, edges, crossing, pb, be, pe, CASE WHEN scheme = '2layer_coarse' THEN NULL WHEN pe = 0 AND pb + be = 0 THEN 0 WHEN pe = 0 THEN CAST('inf' AS DOUBLE) ELSE CAST(pb + be AS DOUBLE) / pe END AS bmr FROM c")
query("agg_bmr_general", lambda k: layers.experiment(k.edges, k.fine_layers).select("scheme", "pb", "be", "pe"), f"{EXPERIMENT} SELECT scheme, pb, be, pe FROM c")
query("fn_layer_remap", lambda k: k.fine_layers.join(F.broadcast(layers.scheme_table(k.spark)), "layer").select("scheme", "node", "new_layer"), f", {FI} SELECT scheme, node, new AS new_layer FROM fi JOIN s USING (layer)")
query("fn_bio_split", lambda k: k.fine_layers, f", {FI} SELECT * FROM fi")
query("agg_paper_support", lambda k: k.clean.where("src <> dst").groupBy("src", "dst").agg(F.count_distinct("paper_id").alias("papers")).withColumn("tier", F.when(F.col("papers") >= 10, ">=10").when(F.col("papers") >= 5, "5-9").when(F.col("papers") >= 2, "2-4").otherwise("1")), "SELECT src, dst, count(DISTINCT paper_id) AS papers, CASE WHEN count(DISTINCT paper_id) >= 10 THEN '>=10' WHEN count(DISTINCT paper_id) >= 5 THEN '5-9' WHEN count(DISTINCT paper_id) >= 2 THEN '2-4' ELSE '1' END AS tier FROM cl WHERE src <> dst GROUP BY src, dst")
query("agg_merge_stats", lambda k: resolve.merge_stats(_mapping(k)), f", m AS ({MAP}), g AS (SELECT canonical, count(*) AS n FROM m GROUP BY canonical) SELECT count(*) FILTER (WHERE n >= 2) AS groups, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS merged, CAST(sum(n) AS BIGINT) AS entities FROM g")
query("agg_empty_rate", lambda k: k.table("orders").select(F.concat(F.lit("WOS:"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("paper_id")).join(k.clean.select("paper_id").distinct().withColumn("has", F.lit(1)), "paper_id", "left").agg(F.count("*").alias("papers"), R6(F.avg(F.isnull("has").cast("double"))).alias("empty_rate")), ", p AS (SELECT o_orderkey, ('WOS:' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0')) IN (SELECT paper_id FROM cl) AS has FROM orders) SELECT count(*) AS papers, round(avg(CASE WHEN has THEN 0 ELSE 1.0::DOUBLE END), 6) AS empty_rate FROM p")
query("agg_matrix_norm", lambda k: layers.transitions(k.edges).withColumn("share", R6(F.col("n") / F.greatest(F.lit(1), F.sum("n").over(Window.partitionBy("start_layer"))))), ", t AS (SELECT a.layer AS start_layer, b.layer AS end_layer, count(ed.src) AS n FROM valid a CROSS JOIN valid b LEFT JOIN ed ON ed.sl = a.layer AND ed.el = b.layer GROUP BY 1, 2) SELECT *, round(CAST(n AS DOUBLE) / greatest(1, sum(n) OVER (PARTITION BY start_layer)), 6) AS share FROM t")
query("agg_matrix_caption", lambda k: layers.transitions(k.edges).agg(F.sum(F.when(F.col("start_layer") == F.col("end_layer"), F.col("n")).otherwise(0)).alias("intra"), F.sum(F.when(F.col("start_layer") != F.col("end_layer"), F.col("n")).otherwise(0)).alias("inter")), "SELECT count(*) FILTER (WHERE sl = el) AS intra, count(*) FILTER (WHERE sl <> el) AS inter FROM ed WHERE sl IN (SELECT layer FROM valid) AND el IN (SELECT layer FROM valid)")
query("win_best_evidence", lambda k: k.clean.where("src <> dst").groupBy("src", "dst").agg(F.max_by("ev", F.struct(F.length("ev").alias("l"), (-F.col("ordinal")).alias("o"))).alias("evidence")), "SELECT src, dst, ev AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY length(ev) DESC, ordinal) AS rn FROM cl WHERE src <> dst) WHERE rn = 1")
query("win_first_per_paper", lambda k: k.clean.where("src <> dst").groupBy("src", "dst", "paper_id").agg(F.min("ordinal").alias("ordinal")), "SELECT src, dst, paper_id, min(ordinal) AS ordinal FROM cl WHERE src <> dst GROUP BY 1, 2, 3")
query("win_cycle_answer", lambda k: with_ordinal(k.clean.where("split = 'holdout'").select("ordinal"), "ordinal", name="rn").select("ordinal", ((F.col("rn") - 1) % 4).cast("int").alias("slot")), "SELECT ordinal, CAST((row_number() OVER (ORDER BY ordinal) - 1) % 4 AS INTEGER) AS slot FROM cl WHERE split = 'holdout'")
query("src_triples_json", lambda k: _json_round(k), "SELECT ordinal, start_node, relationship, end_node, confidence FROM kg")
query("src_triples_glob", lambda k: _json_round(k).where("relationship <> ''").select("ordinal", "relationship"), "SELECT ordinal, relationship FROM kg WHERE relationship <> ''")
query("src_triples_file", lambda k: k.table("orders").select(F.concat(F.lit("WOS:"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("paper_id")).join(k.clean.groupBy("paper_id").agg(F.count("*").alias("n")), "paper_id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))), ", c AS (SELECT paper_id, count(*) AS n FROM cl GROUP BY paper_id), o AS (SELECT 'WOS:' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS paper_id FROM orders) SELECT o.paper_id, coalesce(n, 0) AS n FROM o LEFT JOIN c USING (paper_id)")


def _json_round(k):
    from ripplegraph.sources import readers, sinks

    from .runtime import place

    path = place(k.spark, "json")
    sinks.write_json(k.kg, path)
    return readers.read_triples(k.spark, path, extra="ordinal long").select("ordinal", "start_node", "relationship", "end_node", "confidence")


query("set_union_topk", lambda k: (lambda t: t.where("split='kg'").groupBy("src").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "src").limit(20).select("src").union(t.where("split='holdout'").groupBy("src").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "src").limit(20).select("src")).distinct())(k.clean), "(SELECT src FROM cl WHERE split = 'kg' GROUP BY src ORDER BY count(*) DESC, src LIMIT 20) UNION (SELECT src FROM cl WHERE split = 'holdout' GROUP BY src ORDER BY count(*) DESC, src LIMIT 20)")
query("set_distinct_paths", lambda k: k.clean.select("src", "rel", "dst").distinct(), "SELECT DISTINCT src, rel, dst FROM cl")
query("gr_build", lambda k: k.edges.select("src", "dst", "rel", "sl", "el", "cf"), "SELECT src, dst, rel, sl, el, cf FROM ed")
query("gr_undirected", lambda k: k.edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct(), "SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM ed")
query("prov_index", lambda k: triples.apply_mapping(k.clean, _mapping(k)).select("src", "dst", "ordinal").union(k.clean.select("src", "dst", "ordinal")).distinct(), f", {MERGED} SELECT src, dst, ordinal FROM mg UNION SELECT src, dst, ordinal FROM cl")
query("smp_stratified", lambda k: k.node_layers.select("node", "layer", F.md5(F.concat(F.lit("42:"), "node")).alias("h")).withColumn("rank", F.row_number().over(Window.partitionBy("layer").orderBy("h", "node"))).where("rank <= 20").select("layer", "node"), "SELECT layer, node FROM (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY md5('42:' || node), node) AS rn FROM nl) WHERE rn <= 20")
query("smp_pairs", lambda k: k.edges.select("src", "dst").orderBy(F.md5(F.concat_ws("|", F.lit("43"), "src", "dst")), "src", "dst").limit(300), "SELECT src, dst FROM ed ORDER BY md5('43|' || src || '|' || dst), src, dst LIMIT 300")
query("jn_sample_enrich", lambda k: k.node_layers.where("node LIKE 'Coral%'").join(k.edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_out")), "node", "left").select("node", "layer", F.coalesce("n_out", F.lit(0).cast("long")).alias("n_out")), "SELECT nl.node, layer, coalesce(n, 0) AS n_out FROM nl LEFT JOIN (SELECT src AS node, count(*) AS n FROM ed GROUP BY src) USING (node) WHERE nl.node LIKE 'Coral%'")
query("jn_cache", lambda k: k.edges.select(F.concat_ws("|||", "src", "dst").alias("key"), "sl", "el").join(k.edges.where("cf = 1").select(F.concat_ws("|||", "src", "dst").alias("key"), F.when(F.col("sl") == F.col("el"), "YES").otherwise("NO").alias("cached")), "key", "left").select("key", F.coalesce("cached", F.lit("ASK")).alias("answer")), "SELECT src || '|||' || dst AS key, CASE WHEN cf <> 1 THEN 'ASK' WHEN sl = el THEN 'YES' ELSE 'NO' END AS answer FROM ed")
query("jn_group_pairs", lambda k: resolve.group_pairs(_mapping(k)), f", m AS (SELECT * FROM ({MAP})) SELECT a.canonical, a.entity AS a, b.entity AS b FROM m a JOIN m b ON a.canonical = b.canonical AND a.entity < b.entity")
query("fn_yes_no", lambda k: k.kg.select("ordinal", F.upper("evidence_sentence").alias("t")).select("ordinal", F.when(F.col("t").contains("YES"), "YES").when(F.col("t").contains("NO"), "NO").otherwise("INVALID").alias("answer")), "SELECT ordinal, CASE WHEN contains(upper(evidence_sentence), 'YES') THEN 'YES' WHEN contains(upper(evidence_sentence), 'NO') THEN 'NO' ELSE 'INVALID' END AS answer FROM kg")

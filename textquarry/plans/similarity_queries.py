"""Queries on hashes, n-grams, vectors, checks and audits, each with its SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.functions import text as t
from textquarry.operators import crawl, embedding, postings, similarity
from textquarry.operators.guard import blocks_of
from textquarry.operators.set_join import similar_sets
from textquarry.operators.vector_index import VectorIndex
from textquarry.settings import DEFAULT
from textquarry.sources import tables
from textquarry.sources.sinks import check_rows

# ---------------------------------------------------------------- SQL pieces
#: Texts that hold chemical fields: every third document gets some.
CHEMICAL_TAIL = " CAS: 1000573-03-4; Purity: 99%"


def n(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^0-9a-zı㐀-鿿]+', '', 'g')"


FIELDS = r"(?i)(?:CAS(?:\s*(?:No\.?|号))?|分子式|Molecular\s*Formula|分子量|Molecular\s*Weight|Mol\.?\s*Wt\.?|规格(?:参数)?|Specification|纯度|Purity)\s*[:：]?\s*[^\n；;。]{1,100}"


def bare(x: str) -> str:
    """Chemical fields blanked; RE2 has no look-around, so a neighbour is captured and put back (twice, for adjacent ones)."""
    x = f"regexp_replace({x}, '{FIELDS}', ' ', 'g')"
    for _ in range(2):
        x = rf"regexp_replace({x}, '(^|[^0-9])[0-9]{{2,7}}-[0-9]{{2}}-[0-9]($|[^0-9])', '\1 \2', 'g')"
    for _ in range(2):
        x = rf"regexp_replace({x}, '(^|[^0-9A-Za-z_])[≥>≤<]?\s*[0-9]{{1,3}}(?:\.[0-9]+)?\s*%($|[^0-9A-Za-z_])', '\1 \2', 'g')"
    return x


def grams(x: str, size: int = 3) -> str:
    return f"CASE WHEN length({x}) >= {size} THEN list_distinct(list_transform(range(1, length({x}) - {size} + 2), lambda i: substr({x}, i, {size}))) WHEN length({x}) > 0 THEN [{x}] ELSE [] END"


SITE = "CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT)"
BLOCKS = f"SELECT doc_id AS id, {SITE} AS site_id, source AS site_name, CASE WHEN {SITE} % 5 = 0 THEN 'candidate' ELSE 'baseline' END AS site_type, text AS original_content FROM documents"


def prepared(source: str, name: str) -> str:
    """CTEs that derive normalized, core, content_hash, chemical_ratio and embed_text."""
    return f"""
{name}_0 AS ({source}),
{name}_1 AS (SELECT *, {n('original_content')} AS normalized, {n(bare('original_content'))} AS core FROM {name}_0),
{name} AS (SELECT *, sha256(normalized) AS content_hash, CASE WHEN length(normalized) > 0 THEN greatest(0.0, least(1.0, 1 - length(core) / length(normalized))) ELSE 0.0 END AS chemical_ratio,
  CASE WHEN length(core) >= 3 THEN core ELSE normalized END AS embed_text FROM {name}_1)"""


def sparse(source: str, key: str, text: str, name: str) -> str:
    return f"""
{name}_t AS (SELECT {key}, token, count(*) AS n FROM (SELECT {key}, unnest(CASE WHEN length({text}) >= 2 THEN list_transform(range(1, length({text})), lambda i: substr({text}, i, 2)) ELSE [{text}] END) AS token FROM {source}) GROUP BY ALL),
{name}_d AS (SELECT token, sha256(token) AS h FROM (SELECT DISTINCT token FROM {name}_t)),
{name} AS (SELECT {key}, bucket, CAST(sum(n * sign) AS BIGINT) AS weight FROM (SELECT {key}, n, CAST(CAST('0x' || substr(h, 1, 8) AS BIGINT) % 512 AS INTEGER) AS bucket, CASE WHEN CAST('0x' || substr(h, 9, 2) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END AS sign FROM {name}_t JOIN {name}_d USING (token)) GROUP BY {key}, bucket HAVING sum(n * sign) <> 0)"""


QUERY_ITEMS = "SELECT item_id AS query_id, CAST(NULL AS BIGINT) AS site_id, text AS original_content FROM benchmark"
QUERY_SITES = f"SELECT id AS query_id, site_id, original_content FROM ({BLOCKS}) WHERE site_type = 'candidate'"
BASELINE = f"SELECT id, site_id, original_content FROM ({BLOCKS}) WHERE site_type = 'baseline'"


def semantic_sql(limit: int = 200) -> str:
    return f"""{sparse('q', 'query_id', 'embed_text', 'qv')}, {sparse('b', 'id', 'embed_text', 'bv')},
qn AS (SELECT query_id, sqrt(sum(weight * weight)) AS qn FROM qv GROUP BY 1), bn AS (SELECT id, sqrt(sum(weight * weight)) AS bn FROM bv GROUP BY 1),
dots AS (SELECT query_id, id, sum(qv.weight * bv.weight) AS dot FROM qv JOIN bv USING (bucket) GROUP BY 1, 2),
cosines AS (SELECT q.query_id, b.id, coalesce(dot, 0) / (qn * bn) AS semantic FROM q JOIN qn USING (query_id), b JOIN bn USING (id) LEFT JOIN dots ON dots.query_id = q.query_id AND dots.id = b.id WHERE q.site_id IS DISTINCT FROM b.site_id),
sem AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY semantic DESC, id) AS semantic_rank FROM cosines QUALIFY semantic_rank <= {limit})"""


def trigram_sql() -> str:
    padded = "('  ' || normalized || ' ')"
    return f"""
qt AS (SELECT query_id, site_id, CASE WHEN length(normalized) > 0 THEN {grams(padded)} ELSE [] END AS g FROM q WHERE length(normalized) >= 3),
bt AS (SELECT id, site_id, CASE WHEN length(normalized) > 0 THEN {grams(padded)} ELSE [] END AS g FROM b),
tri AS (SELECT query_id, id, count(*) AS k FROM (SELECT query_id, site_id, unnest(g) AS g FROM qt) x JOIN (SELECT id, site_id AS bs, unnest(g) AS g FROM bt) y USING (g) WHERE x.site_id IS DISTINCT FROM y.bs GROUP BY 1, 2),
lex AS (SELECT query_id, id, k / (len(qt.g) + len(bt.g) - k) AS trigram, row_number() OVER (PARTITION BY query_id ORDER BY k / (len(qt.g) + len(bt.g) - k) DESC, id) AS lexical_rank
  FROM tri JOIN qt USING (query_id) JOIN bt USING (id) WHERE k / (len(qt.g) + len(bt.g) - k) >= 0.3 QUALIFY lexical_rank <= 200)"""


EXACT = """
ex AS (SELECT query_id, b.id, row_number() OVER (PARTITION BY query_id ORDER BY b.id) AS exact_rank FROM q JOIN b USING (content_hash) WHERE q.site_id IS DISTINCT FROM b.site_id QUALIFY exact_rank <= 50)"""


def candidates_sql() -> str:
    return f"""{semantic_sql()}, {trigram_sql()}, {EXACT},
pairs AS (SELECT query_id, id, min(source) AS source, arg_min(rank, source) AS source_rank, arg_min(semantic, source) AS semantic FROM (
  SELECT query_id, id, semantic, 0 AS source, semantic_rank AS rank FROM sem
  UNION ALL SELECT lex.query_id, lex.id, cosines.semantic, 1, lexical_rank FROM lex JOIN cosines ON cosines.query_id = lex.query_id AND cosines.id = lex.id
  UNION ALL SELECT query_id, id, 1.0, 2, exact_rank FROM ex) GROUP BY 1, 2)"""


def check_sql(queries: str, limit: int) -> str:
    """CTEs up to `matches`."""
    return f"""WITH {prepared(queries, 'q')}, {prepared(BASELINE, 'b')}, {candidates_sql()},
qg AS (SELECT query_id, unnest(g) AS g FROM (SELECT query_id, {grams('normalized')} AS g FROM q)), bg AS (SELECT id, unnest(g) AS g FROM (SELECT id, {grams('normalized')} AS g FROM b)),
qc AS (SELECT query_id, unnest(g) AS g FROM (SELECT query_id, {grams('core')} AS g FROM q)), bc AS (SELECT id, unnest(g) AS g FROM (SELECT id, {grams('core')} AS g FROM b)),
f AS (SELECT query_id, id, count(*) AS i1 FROM pairs JOIN qg USING (query_id) JOIN bg USING (id, g) GROUP BY 1, 2), c AS (SELECT query_id, id, count(*) AS i2 FROM pairs JOIN qc USING (query_id) JOIN bc USING (id, g) GROUP BY 1, 2),
qgn AS (SELECT query_id, count(*) AS qgn FROM qg GROUP BY 1), bgn AS (SELECT id, count(*) AS bgn FROM bg GROUP BY 1), qcn AS (SELECT query_id, count(*) AS qcn FROM qc GROUP BY 1), bcn AS (SELECT id, count(*) AS bcn FROM bc GROUP BY 1),
j AS (SELECT pairs.*, q.content_hash = b.content_hash AS exact_match, q.content_hash = b.content_hash AND length(q.core) >= 8 AS meaningful, least(q.chemical_ratio, b.chemical_ratio) AS chemical_overlap, q.chemical_ratio AS qr,
  coalesce(i1 / (qgn + bgn - i1), 0.0) AS full_score, coalesce(i2 / (qcn + bcn - i2), 0.0) AS core_score
  FROM pairs JOIN q USING (query_id) JOIN b ON b.id = pairs.id LEFT JOIN f ON f.query_id = pairs.query_id AND f.id = pairs.id LEFT JOIN c ON c.query_id = pairs.query_id AND c.id = pairs.id
  LEFT JOIN qgn ON qgn.query_id = pairs.query_id LEFT JOIN bgn ON bgn.id = pairs.id LEFT JOIN qcn ON qcn.query_id = pairs.query_id LEFT JOIN bcn ON bcn.id = pairs.id),
l AS (SELECT *, CASE WHEN meaningful THEN 1.0 ELSE greatest(full_score * (1 - 0.7 * chemical_overlap), core_score) END AS lexical, greatest(0.0, least(1.0, semantic)) AS sem1 FROM j),
o AS (SELECT *, CASE WHEN meaningful THEN 1.0 ELSE greatest(0.0, least(1.0, (0.45 * lexical + 0.55 * sem1) * CASE WHEN exact_match AND qr > 0.5 THEN 1 - 0.7 * qr ELSE 1 END)) END AS overall FROM l),
matches AS (SELECT query_id, id, lexical, sem1 AS semantic, overall, exact_match, chemical_overlap, CASE WHEN overall >= 0.90 THEN 'high' WHEN overall >= 0.75 THEN 'medium' ELSE 'low' END AS risk_level,
  row_number() OVER (PARTITION BY query_id ORDER BY round(overall, 4) DESC, source, source_rank, id) AS rank FROM o WHERE overall + 1e-9 >= 0.60 QUALIFY rank <= {limit})"""


# ---------------------------------------------------------------- inputs
def items(spark: SparkSession, sf: str) -> DataFrame:
    return tables.read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.lit(None).cast("long").alias("site_id"), F.col("text").alias("original_content"))


def baseline(spark: SparkSession, sf: str) -> DataFrame:
    return tables.blocks(spark, sf).filter("site_type = 'baseline'")


def candidate_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return tables.blocks(spark, sf).filter("site_type = 'candidate'").select(F.col("id").alias("query_id"), "site_id", "original_content")


def hashed(spark: SparkSession, sf: str) -> DataFrame:
    blocks = tables.blocks(spark, sf)
    return blocks.withColumn("content_hash", t.hash_of(t.normalized(F.col("original_content")))).drop("original_content")


def chemical_docs(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables.read(spark, sf, "documents")
    return docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(CHEMICAL_TAIL))).otherwise(F.col("text")).alias("original_content"))


CHEMICAL_DOCS = f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || '{CHEMICAL_TAIL}' ELSE text END AS original_content FROM documents"
HASHED = f"SELECT id, site_id, site_name, site_type, sha256({n('original_content')}) AS content_hash FROM ({BLOCKS})"


# ---------------------------------------------------------------- queries
def normalize_documents(spark, sf):
    return tables.read(spark, sf, "documents").select("doc_id", t.normalized(F.col("text")).alias("normalized"), t.clean_display_text(F.col("text")).alias("display"))


def content_hash_documents(spark, sf):
    return hashed(spark, sf).select(F.col("id").alias("doc_id"), "content_hash")


def exact_cross_site(spark, sf):
    """Per candidate block: equal baseline blocks, counted, not expanded."""
    rows = hashed(spark, sf)
    base = rows.filter("site_type = 'baseline'").groupBy("content_hash").agg(F.count("*").alias("n_matches"), F.min("id").alias("first_block_id"))
    return rows.filter("site_type = 'candidate'").join(base, "content_hash").select(F.col("id").alias("query_id"), "n_matches", "first_block_id")


def exact_candidates_top50(spark, sf):
    q, b = similarity.prepare(candidate_blocks(spark, sf)), similarity.prepare(baseline(spark, sf))
    return similarity.exact_candidates(q, b).select("query_id", F.col("id").alias("block_id"), "exact_rank")


def dedupe_site_blocks(spark, sf):
    """The oldest block of each (site, hash)."""
    return hashed(spark, sf).groupBy("site_id", "content_hash").agg(F.min("id").alias("id"))


def dedupe_self_join(spark, sf):
    """Blocks that have an older block of their site and hash."""
    rows = hashed(spark, sf).select("id", "site_id", "content_hash")
    oldest = rows.groupBy("site_id", "content_hash").agg(F.min("id").alias("oldest"))
    return rows.join(oldest, ["site_id", "content_hash"]).filter("id > oldest").select("id", "site_id", "oldest")


def hash_multiplicity(spark, sf):
    return hashed(spark, sf).groupBy("site_id", "content_hash").agg(F.count("*").alias("n"))


def page_hash_lists(spark, sf):
    """Hashes of each page's lines, in order, as one digest."""
    rows = tables.lines(spark, sf).withColumn("h", t.hash_of(t.normalized(F.col("content"))))
    listed = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line", "h"))).alias("l"))
    return listed.select(F.col("doc_id").alias("page_id"), F.size("l").cast("long").alias("n_hashes"), F.sha2(F.array_join(F.transform("l", lambda x: x["h"]), ","), 256).alias("hashes_sha256"))


def ngram_counts(spark, sf):
    rows = tables.spread(tables.read(spark, sf, "documents"), "doc_id").select("doc_id", t.normalized(F.col("text")).alias("n"))
    return rows.select("doc_id", F.size(t.ngrams(F.col("n"))).cast("long").alias("n_grams"))


def jaccard_benchmark(spark, sf):
    """Benchmark items against all documents, from a Jaccard similarity of 0.2 on."""
    grams = t.coded(t.ngrams(t.normalized(F.col("text"))))
    docs = tables.spread(tables.read(spark, sf, "documents"), "doc_id").select(F.col("doc_id").alias("id"), F.lit(None).cast("long").alias("right_group"), grams.alias("members"))
    asked = tables.read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.lit(None).cast("long").alias("left_group"), grams.alias("members"))
    return similar_sets(asked, docs, 0.2).select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "jaccard")


def chemical_strip(spark, sf):
    rows = similarity.prepare(chemical_docs(spark, sf))
    return rows.select("doc_id", F.sha2("core", 256).alias("core_sha256"), "chemical_ratio")


def embedding_text(spark, sf):
    rows = similarity.prepare(chemical_docs(spark, sf))
    return rows.select("doc_id", F.length("embed_text").cast("long").alias("length"), F.sha2("embed_text", 256).alias("embed_sha256"))


def lexical_discounted(spark, sf):
    """Each document with chemical fields against the same text without them; both come from one row, so nothing is joined."""
    docs = tables.spread(tables.read(spark, sf, "documents"), "doc_id").select("doc_id", "text")
    tail = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(CHEMICAL_TAIL))).otherwise(F.col("text"))
    forms = docs.select("doc_id", t.normalized(tail).alias("n1"), t.chemical_core(tail).alias("c1"), t.normalized(F.col("text")).alias("n2"), t.chemical_core(F.col("text")).alias("c2"))
    overlap = F.least(t.chemical_ratio(F.col("n1"), F.col("c1")), t.chemical_ratio(F.col("n2"), F.col("c2")))
    # each set is made once, as a column of its own, before sets are compared
    sets = forms.select("doc_id", overlap.alias("overlap"), *[t.coded(t.ngrams(F.col(c))).alias(f"{c}_grams") for c in ("n1", "n2", "c1", "c2")])
    full = t.jaccard(F.col("n1_grams"), F.col("n2_grams")) * (1 - DEFAULT.chemical_discount * F.col("overlap"))
    return sets.select("doc_id", F.greatest(full, t.jaccard(F.col("c1_grams"), F.col("c2_grams"))).alias("lexical"), "overlap")


def hash_embedding(spark, sf):
    rows = tables.read(spark, sf, "documents").select("doc_id", t.normalized(F.col("text")).alias("n"))
    return embedding.sparse(rows, "doc_id", "n")


def semantic_top200(spark, sf):
    q, b = similarity.prepare(items(spark, sf)), similarity.prepare(baseline(spark, sf))
    return similarity.semantic_candidates(q, b).select("query_id", "id", F.round("semantic", 9).alias("semantic"), F.col("semantic_rank").cast("long").alias("semantic_rank"))


def vector_topk(spark, sf):
    """The ten nearest stored vectors of every fiftieth one."""
    rows = tables.read(spark, sf, "embeddings").select("vec_id", "embedding")
    out = None
    for part in blocks_of(rows.filter("vec_id % 50 = 0")):
        one = embedding.top_vectors(part, rows, 10)
        out = one if out is None else out.unionByName(one)
    return out.select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def vector_lists(spark, sf):
    """vector_topk by inverted lists, all of which are read: exact."""
    rows = tables.read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("site_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    index = VectorIndex.build(rows, tables.fresh_folder(spark, "vector-lists"))
    out = None
    for part in blocks_of(rows.filter("id % 50 = 0").withColumnRenamed("id", "query_id")):
        one = index.search(part, 10, probes=len(index.centroids))
        out = one if out is None else out.unionByName(one)
    return out.select("query_id", F.col("id").alias("vec_id"), F.round("semantic", 6).alias("score"), F.col("semantic_rank").cast("long").alias("rank"))


def persisted_checks(spark, sf):
    """Every benchmark passage's persisted check: its results go through JSON and back, one row a result, rounded as stored."""
    asked = items(spark, sf)
    rows = check_rows(asked, similarity.check(asked, baseline(spark, sf), DEFAULT.result_limit))
    kind = rows.schema["results"].dataType
    back = rows.select("query_id", "result_count", "top_score", F.explode_outer(F.from_json(F.to_json("results"), kind)).alias("r"))
    return back.select("query_id", "result_count", "top_score", F.coalesce("r.content_block_id", F.lit(-1)).alias("content_block_id"), "r.overall_similarity", "r.risk_level", F.coalesce("r.exact_match", F.lit(False)).alias("exact_match"), F.coalesce(F.col("r.rank").cast("long"), F.lit(0)).alias("rank"))


def signature_scope(spark, sf):
    """Every third block has vectors of another signature: it is no semantic candidate, but still an exact one."""
    q, b = similarity.prepare(candidate_blocks(spark, sf)), similarity.prepare(baseline(spark, sf))
    b = b.withColumn("embedding_version", F.when(F.col("id") % 3 == 0, "legacy").otherwise(DEFAULT.signature))
    near = similarity.semantic_candidates(q, b, replace(DEFAULT, candidate_limit=3)).select("query_id", "id", F.lit("semantic").alias("source"), F.col("semantic_rank").cast("long").alias("rank"))
    return near.unionByName(similarity.exact_candidates(q, b).select("query_id", "id", F.lit("exact").alias("source"), F.col("exact_rank").cast("long").alias("rank")))


#: Patterns that keyword_postings looks for, with wildcards, in either case.
KEYWORDS = ("password", "The%of", "e_a%ing", "Copyright", "zzzzqq")


def keyword_postings(spark, sf):
    """How many documents match each pattern: by the 3-gram postings, then by the whole pattern."""
    blocks = tables.blocks(spark, sf).withColumn("page_title", F.lit(None).cast("string"))
    table = tables.saved(postings.postings(blocks))
    out = None
    for word in KEYWORDS:
        near = postings.candidates(table, f"%{word}%")
        mine = blocks.join(near.select("id"), "id", "left_semi").filter(F.col("original_content").ilike(f"%{word}%"))
        one = mine.agg(F.lit(word).alias("keyword"), F.count("*").alias("n"), F.coalesce(F.min("id"), F.lit(-1).cast("long")).alias("first_id"))
        out = one if out is None else out.unionByName(one)
    return out


def hash_count_deltas(spark, sf):
    """Counts of hashes a site after every fourth page is gone and comes again with changed lines, by deltas of the stored counts."""
    lines = tables.saved(tables.lines(spark, sf).select("site_id", "doc_id", "line", "content", t.hash_of(t.normalized(F.col("content"))).alias("content_hash")))
    counts = lines.groupBy("site_id", "content_hash").agg(F.count("*").alias("n"))
    away = lines.filter("doc_id % 4 = 0")
    edited = F.when(F.col("line") % 2 == 0, F.concat("content", F.lit(" new"))).otherwise(F.col("content"))
    fresh = away.withColumn("content_hash", t.hash_of(t.normalized(edited)))
    return crawl.counted(counts, away, fresh)


def cosine_pairs(spark, sf):
    """Every vector with its successor."""
    rows = tables.read(spark, sf, "embeddings").select("vec_id", "embedding")
    nxt = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rows.join(nxt, "vec_id").select("vec_id", F.round(embedding.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


def trigram_candidates(spark, sf):
    q, b = similarity.prepare(items(spark, sf)), similarity.prepare(baseline(spark, sf))
    return similarity.lexical_candidates(q, b).select("query_id", "id", "trigram", F.col("lexical_rank").cast("long").alias("lexical_rank"))


def candidate_union(spark, sf):
    q, b = similarity.prepare(items(spark, sf)), similarity.prepare(baseline(spark, sf))
    return similarity.candidates(q, b).select("query_id", "id", "source", F.col("source_rank").cast("long").alias("source_rank"))


def _matches(queries, blocks, limit):
    out = similarity.check(queries, blocks, limit)
    return out.select("query_id", "id", F.round("lexical", 9).alias("lexical"), F.round("semantic", 9).alias("semantic"), F.round("overall", 9).alias("overall"), "exact_match", F.round("chemical_overlap", 9).alias("chemical_overlap"), "risk_level", F.col("rank").cast("long").alias("rank"))


def similarity_check(spark, sf):
    return _matches(items(spark, sf), baseline(spark, sf), DEFAULT.result_limit)


def risk_levels(spark, sf):
    """Matches of the benchmark by risk."""
    found = similarity.check(items(spark, sf), baseline(spark, sf), DEFAULT.result_limit)
    return found.groupBy("risk_level").agg(F.count("*").alias("n"), F.round(F.max("overall"), 9).alias("top"))


def site_audit_matches(spark, sf):
    return similarity.check(candidate_blocks(spark, sf), baseline(spark, sf), DEFAULT.audit_limit)


def site_audit_findings(spark, sf):
    out = similarity.findings(site_audit_matches(spark, sf), DEFAULT.findings_limit)
    return out.withColumn("top_score", F.round("top_score", 9))


def site_audit_summary(spark, sf):
    out = similarity.summary(site_audit_matches(spark, sf), candidate_blocks(spark, sf))
    return out.withColumn("max_similarity", F.round("max_similarity", 9))


def highlight_matches(spark, sf):
    """Highlighted originals of the best match of each benchmark item."""
    best = similarity.check(items(spark, sf), baseline(spark, sf), 1).select("query_id", "id")
    rows = best.join(items(spark, sf).select("query_id", F.col("original_content").alias("query")), "query_id").join(baseline(spark, sf).select("id", "original_content"), "id")
    return rows.select("query_id", "id", t.highlight(F.col("query"), F.col("original_content")).alias("highlight_segments"))


MATCH_COLUMNS = "query_id, id, round(lexical, 9) AS lexical, round(semantic, 9) AS semantic, round(overall, 9) AS overall, exact_match, round(chemical_overlap, 9) AS chemical_overlap, risk_level, rank"
CHECK = check_sql(QUERY_ITEMS, 10)
AUDIT = check_sql(QUERY_SITES, 3)
ITEMS_Q = f"WITH {prepared(QUERY_ITEMS, 'q')}, {prepared(BASELINE, 'b')}"

ORACLES = {
    "normalize_documents": f"SELECT doc_id, {n('text')} AS normalized, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS display FROM documents",
    "content_hash_documents": f"SELECT id AS doc_id, content_hash FROM ({HASHED})",
    "exact_cross_site": f"WITH h AS ({HASHED}) SELECT q.id AS query_id, count(*) AS n_matches, min(b.id) AS first_block_id FROM h q JOIN h b USING (content_hash) WHERE q.site_type = 'candidate' AND b.site_type = 'baseline' GROUP BY 1",
    "exact_candidates_top50": f"WITH {prepared(QUERY_SITES, 'q')}, {prepared(BASELINE, 'b')}, {EXACT} SELECT query_id, id AS block_id, exact_rank FROM ex",
    "dedupe_site_blocks": f"SELECT site_id, content_hash, min(id) AS id FROM ({HASHED}) GROUP BY 1, 2",
    "dedupe_self_join": f"WITH h AS ({HASHED}) SELECT d.id, d.site_id, min(o.id) AS oldest FROM h d JOIN h o ON d.site_id = o.site_id AND d.content_hash = o.content_hash AND d.id > o.id GROUP BY 1, 2",
    "hash_multiplicity": f"SELECT site_id, content_hash, count(*) AS n FROM ({HASHED}) GROUP BY 1, 2",
    "page_hash_lists": f"WITH l AS (SELECT doc_id, generate_subscripts(s, 1) AS line, unnest(s) AS content FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)) SELECT doc_id AS page_id, count(*) AS n_hashes, sha256(string_agg(sha256({n('content')}), ',' ORDER BY line)) AS hashes_sha256 FROM l GROUP BY 1",
    "ngram_counts": f"SELECT doc_id, len({grams('n')}) AS n_grams FROM (SELECT doc_id, {n('text')} AS n FROM documents)",
    "jaccard_benchmark": f"""WITH d AS (SELECT doc_id, {grams('n')} AS g FROM (SELECT doc_id, {n('text')} AS n FROM documents)), i AS (SELECT item_id, {grams('n')} AS g FROM (SELECT item_id, {n('text')} AS n FROM benchmark)),
k AS (SELECT item_id, doc_id, count(*) AS k FROM (SELECT item_id, unnest(g) AS g FROM i) JOIN (SELECT doc_id, unnest(g) AS g FROM d) USING (g) GROUP BY 1, 2)
SELECT item_id, doc_id, k / (len(i.g) + len(d.g) - k) AS jaccard FROM k JOIN i USING (item_id) JOIN d USING (doc_id) WHERE k / (len(i.g) + len(d.g) - k) >= 0.2""",
    "chemical_strip": f"WITH {prepared(CHEMICAL_DOCS, 'x')} SELECT doc_id, sha256(core) AS core_sha256, chemical_ratio FROM x",
    "embedding_text": f"WITH {prepared(CHEMICAL_DOCS, 'x')} SELECT doc_id, length(embed_text) AS length, sha256(embed_text) AS embed_sha256 FROM x",
    "lexical_discounted": f"""WITH {prepared(CHEMICAL_DOCS, 'x')}, {prepared('SELECT doc_id, text AS original_content FROM documents', 'y')},
p AS (SELECT doc_id, least(x.chemical_ratio, y.chemical_ratio) AS overlap, {grams('x.normalized')} AS a, {grams('y.normalized')} AS b, {grams('x.core')} AS c, {grams('y.core')} AS d FROM x JOIN y USING (doc_id)),
k AS (SELECT *, len(a) + len(b) - len(list_distinct(list_concat(a, b))) AS i, len(c) + len(d) - len(list_distinct(list_concat(c, d))) AS j FROM p)
SELECT doc_id, overlap, greatest((CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE i / (len(a) + len(b) - i) END) * (1 - 0.7 * overlap), CASE WHEN len(c) = 0 OR len(d) = 0 THEN 0.0 ELSE j / (len(c) + len(d) - j) END) AS lexical FROM k""",
    "hash_embedding": f"WITH x AS (SELECT doc_id, {n('text')} AS n FROM documents), {sparse('x', 'doc_id', 'n', 'v')} SELECT doc_id, bucket, weight FROM v",
    "semantic_top200": f"{ITEMS_Q}, {semantic_sql()} SELECT query_id, id, round(semantic, 9) AS semantic, semantic_rank FROM sem",
    "vector_topk": "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.v, e.v), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.v, e.v) DESC, e.vec_id) AS rank FROM e q, e WHERE q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id QUALIFY rank <= 10",
    "persisted_checks": f"""{CHECK}, best AS (SELECT query_id, CAST(count(*) AS INTEGER) AS result_count, round(max(overall), 4) AS top_score FROM matches GROUP BY 1)
SELECT i.query_id, coalesce(result_count, 0) AS result_count, top_score, coalesce(id, -1) AS content_block_id, round(overall, 4) AS overall_similarity, risk_level, coalesce(exact_match, false) AS exact_match, coalesce(rank, 0) AS rank
FROM ({QUERY_ITEMS}) i LEFT JOIN best USING (query_id) LEFT JOIN matches USING (query_id)""",
    "signature_scope": f"""WITH {prepared(QUERY_SITES, 'q')}, {prepared(BASELINE, 'ba')}, b AS (SELECT * FROM ba WHERE id % 3 <> 0), {semantic_sql(3)}, {EXACT.replace('JOIN b ', 'JOIN ba b ')}
SELECT query_id, id, 'semantic' AS source, semantic_rank AS rank FROM sem UNION ALL SELECT query_id, id, 'exact', exact_rank FROM ex""",
    "keyword_postings": " UNION ALL ".join(f"SELECT '{k}' AS keyword, count(*) AS n, coalesce(min(doc_id), -1) AS first_id FROM documents WHERE text ILIKE '%{k}%'" for k in KEYWORDS),
    "hash_count_deltas": f"""WITH l AS (SELECT doc_id, {SITE} AS site_id, generate_subscripts(s, 1) - 1 AS line, unnest(s) AS content FROM (SELECT doc_id, source, string_split(text, chr(10)) AS s FROM documents))
SELECT site_id, sha256({n("CASE WHEN doc_id % 4 = 0 AND line % 2 = 0 THEN content || ' new' ELSE content END")}) AS content_hash, count(*) AS n FROM l GROUP BY 1, 2""",
    "cosine_pairs": "SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "trigram_candidates": f"{ITEMS_Q}, {trigram_sql()} SELECT query_id, id, trigram, lexical_rank FROM lex",
    "candidate_union": f"{ITEMS_Q}, {candidates_sql()} SELECT query_id, id, source, source_rank FROM pairs",
    "similarity_check": f"{CHECK} SELECT {MATCH_COLUMNS} FROM matches",
    "risk_levels": f"{CHECK} SELECT risk_level, count(*) AS n, round(max(overall), 9) AS top FROM matches GROUP BY 1",
    "site_audit_findings": f"{AUDIT} SELECT query_id, round(arg_min(overall, rank), 9) AS top_score, arg_min(risk_level, rank) AS risk_level, count(*) AS n_matches FROM matches GROUP BY 1 ORDER BY arg_min(overall, rank) DESC, 1 LIMIT 100",
    "site_audit_summary": f"{AUDIT}, top AS (SELECT * FROM matches WHERE rank = 1) SELECT (SELECT count(*) FROM q) AS total_blocks, count(*) AS matched_blocks, count(*) FILTER (risk_level = 'high') AS high_risk_blocks, count(*) FILTER (risk_level = 'medium') AS medium_risk_blocks, count(*) FILTER (risk_level = 'low') AS low_risk_blocks, round(coalesce(max(overall), 0.0), 9) AS max_similarity FROM top",
}

ORACLES["vector_lists"] = ORACLES["vector_topk"]
QUERIES = {f.__name__: f for f in (
    normalize_documents, content_hash_documents, exact_cross_site, exact_candidates_top50, dedupe_site_blocks, dedupe_self_join, hash_multiplicity, page_hash_lists, ngram_counts, jaccard_benchmark,
    chemical_strip, embedding_text, lexical_discounted, hash_embedding, semantic_top200, vector_topk, vector_lists, keyword_postings, hash_count_deltas, persisted_checks, signature_scope, cosine_pairs, trigram_candidates, candidate_union, similarity_check, risk_levels,
    site_audit_findings, site_audit_summary, highlight_matches,
)}

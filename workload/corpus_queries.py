"""Library, store, ingestion, evaluation and streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from codexflow.functions.text import content_hash
from codexflow.hooks import embed_hashing as embed
from codexflow.operators import chunking as C
from codexflow.operators import evaluation as E
from codexflow.operators import hierarchy as H
from codexflow.plans import ingest as I
from codexflow.session import new_table_path
from codexflow.sources import library as L
from codexflow.sources import datasource, sketch, store, tables
from codexflow.streaming import ingest as X
from workload import sqlviews as S
from workload import views as W
from workload.registry import query
from workload.structure_queries import chunks_sql, recursive_chunks_sql, section_sql, sections_sql, windows_sql
from workload.text_queries import _legal

DOCUMENTS_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
MANIFEST = ["file_hash", "name", "md_filename", "processed_at", "source_tool", "chars"]


# ------------------------------------------------------------------- library

@query("golden_copy_render", f"""
WITH {S.LIBRARY}
SELECT doc_id, file_hash, 'doc_' || doc_id || '_' || file_hash || '.md' AS md_filename,
  '---' || chr(10) || 'source_pdf: doc ' || doc_id || '.pdf' || chr(10) || 'processed_at: 2024-05-01' || chr(10) || 'source_tool: docling' || chr(10)
  || 'file_hash: ' || file_hash || chr(10) || '---' || chr(10) || chr(10) || text AS rendered, length(text) AS chars
FROM lib""")
def golden_copy_render(spark, sf):
    docs = W.library(spark, sf).drop("file_hash").withColumn("content", F.col("text"))
    out = L.render_golden_copy(docs, F.lit("2024-05-01"), F.lit("docling"))
    return out.select("doc_id", "file_hash", "md_filename", "rendered", "chars")


@query("library_exists", f"WITH {S.LIBRARY} SELECT doc_id, file_hash FROM lib WHERE file_hash IN (SELECT file_hash FROM manifest)")
def library_exists(spark, sf):
    return L.known(W.library(spark, sf), W.manifest(spark, sf)).select("doc_id", "file_hash")


@query("library_lookup", f"WITH {S.LIBRARY} SELECT doc_id, file_hash, md_filename, chars FROM lib LEFT JOIN manifest USING (file_hash)")
def library_lookup(spark, sf):
    return L.lookup(W.library(spark, sf), W.manifest(spark, sf)).select("doc_id", "file_hash", "md_filename", "chars")


UPDATES = """
upd AS (SELECT file_hash, 'new ' || doc_id || '.pdf' AS name, 'new_' || doc_id || '.md' AS md_filename,
  strftime(DATE '2024-06-01' + CAST(doc_id % 200 AS INTEGER), '%Y-%m-%d') AS processed_at, source AS source_tool, length(text) AS chars FROM lib),
tagged AS (SELECT *, 0 AS is_new FROM manifest UNION ALL SELECT *, 1 AS is_new FROM upd)"""


UPSERTED = f"""
WITH {S.LIBRARY}, {UPDATES}
SELECT file_hash, name, md_filename, processed_at, source_tool, chars FROM tagged
QUALIFY row_number() OVER (PARTITION BY file_hash ORDER BY processed_at DESC, is_new DESC, name DESC) = 1"""


def _updates(spark, sf):
    d = F.col("doc_id")
    return W.library(spark, sf).select(
        "file_hash", F.concat(F.lit("new "), d, F.lit(".pdf")).alias("name"), F.concat(F.lit("new_"), d, F.lit(".md")).alias("md_filename"),
        F.date_format(F.date_add(F.lit("2024-06-01").cast("date"), (d % 200).cast("int")), "yyyy-MM-dd").alias("processed_at"),
        F.col("source").alias("source_tool"), F.length("text").cast("bigint").alias("chars"))


@query("library_upsert", UPSERTED)
def library_upsert(spark, sf):
    return L.upsert(W.manifest(spark, sf), _updates(spark, sf)).select(*MANIFEST)


@query("library_upsert_bucketed", UPSERTED)
def library_upsert_bucketed(spark, sf):
    """The stored side lies in buckets of the hash; a new version is written in buckets again."""
    name = f"library_{uuid.uuid4().hex[:8]}"
    tables.write(W.manifest(spark, sf).select(*MANIFEST), name, 8)
    return spark.table(tables.append_and_compact(spark, name, _updates(spark, sf), 8)).select(*MANIFEST)


@query("library_list", f"WITH {S.LIBRARY} SELECT * FROM manifest ORDER BY processed_at DESC, file_hash")
def library_list(spark, sf):
    return L.list_all(W.manifest(spark, sf))


@query("library_delete", f"""
WITH {S.LIBRARY} SELECT * FROM manifest WHERE file_hash NOT IN (SELECT file_hash FROM lib WHERE doc_id IN (SELECT doc_id FROM labels))""")
def library_delete(spark, sf):
    gone = W.library(spark, sf).join(W.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    return L.delete(W.manifest(spark, sf), gone)


INCREMENTAL = f"""
WITH {S.LIBRARY},
src AS (SELECT doc_id, lang, text, file_hash FROM lib UNION ALL SELECT -1 - doc_id, lang, ' ', sha256('blank ' || (-1 - doc_id)) FROM lib WHERE doc_id % 10 = 3)
SELECT doc_id, file_hash, m.file_hash IS NOT NULL AS was_cached, CASE WHEN m.file_hash IS NOT NULL THEN 'cached' ELSE lang END AS tool,
  m.file_hash IS NOT NULL OR {S.strip('text')} <> '' AS success,
  CASE WHEN m.file_hash IS NULL AND {S.strip('text')} = '' THEN 'no text extracted' END AS error
FROM src LEFT JOIN (SELECT file_hash FROM manifest) m USING (file_hash)"""


def _incremental(spark, sf, sketch=None):
    docs = W.with_blanks(W.library(spark, sf))  # some conversions fail
    out = L.convert_incremental(docs, W.manifest(spark, sf), F.col("lang"), sketch=sketch)
    return out.select("doc_id", "file_hash", "was_cached", "tool", "success", "error")


@query("library_incremental", INCREMENTAL)
def library_incremental(spark, sf):
    return _incremental(spark, sf)


@query("library_incremental_sketch", INCREMENTAL)
def library_incremental_sketch(spark, sf):
    """Texts that the library's sketch rules out are not shuffled."""
    return _incremental(spark, sf, sketch.save(W.manifest(spark, sf), new_table_path(spark, "sketch")))


@query("library_exists_sketch", f"WITH {S.LIBRARY} SELECT doc_id, file_hash FROM lib WHERE file_hash IN (SELECT file_hash FROM manifest)")
def library_exists_sketch(spark, sf):
    known = sketch.save(W.manifest(spark, sf), new_table_path(spark, "sketch"))
    return L.known(W.library(spark, sf), W.manifest(spark, sf), known).select("doc_id", "file_hash")


@query("page_source", "SELECT doc_id, text, 'documents.parquet' AS source, CAST(NULL AS VARCHAR) AS error FROM documents")
def page_source(spark, sf):
    """The documents through the package's own data source."""
    datasource.register(spark)
    return spark.read.format("page_text").option("path", f"{sf}/documents.parquet").load()


# --------------------------------------------------------------------- store

@query("index_batches", "SELECT event_id, CAST((row_number() OVER (ORDER BY event_id) - 1) // 20 AS BIGINT) AS batch_id FROM events")
def index_batches(spark, sf):
    return store.with_batch_id(W.table(spark, sf, "events").select("event_id"), "event_id", 20)


@query("collection_count", """
SELECT source AS collection, CAST(sum(greatest(CAST(ceil((n_chars - 150) / 650.0) AS BIGINT), 1)) AS BIGINT) AS n_chunks FROM documents GROUP BY source""")
def collection_count(spark, sf):
    path = new_table_path(spark, "collection")
    chunks = W.documents(spark, sf).select("source", F.explode(C.split_fixed(F.col("text"), 800, 150)).alias("content"))
    n = store.append(chunks, path, "all", "first")
    assert n == store.append(chunks, path, "all", "first") == store.count(spark, path, "all")  # a repeated batch doubles nothing
    return store.read(spark, path, "all").groupBy(F.col("source").alias("collection")).agg(F.count("*").alias("n_chunks"))


@query("ingest_summary", f"""
WITH {S.BLANKS}, md AS (SELECT doc_id, {_legal('text')} AS body FROM src), {sections_sql('md')}, {chunks_sql(800, 150)},
out AS (SELECT doc_id, true AS success FROM pieces UNION ALL SELECT doc_id, false FROM md WHERE body = '')
SELECT lang, 'direct_md' AS tool, count(*) AS docs_loaded, sum(CAST(success AS BIGINT))::BIGINT AS docs_indexed,
  count(DISTINCT source) AS n_sources, sum(CAST(NOT success AS BIGINT))::BIGINT AS n_errors FROM out JOIN src USING (doc_id) GROUP BY lang""")
def ingest_summary(spark, sf):
    docs = W.with_blanks(W.documents(spark, sf).select("doc_id", "lang", "source", "text"))
    rows = I.ingest(docs, processed_at=F.lit("2024-05-01"), splitter=C.fixed_splitter(800, 150))
    return store.ingest_summary(rows, "source", "success", "lang", F.col("extraction_tool").alias("tool"))


INGEST_COLUMNS = ("doc_id", "source", "chunk_index", "h1", "h2", "h3", "h4", "is_refined", "content", "document_type", "resolution_number", "section")


@query("ingest_end_to_end", f"""
WITH {S.NOISY}, md AS (SELECT doc_id, source, {_legal('body')} AS body FROM noisy), {sections_sql('md')}, {chunks_sql(800, 150)},
num AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sec_no, i) - 1 AS chunk_index FROM pieces),
joined AS (SELECT doc_id, string_agg(content, chr(10) || chr(10) ORDER BY chunk_index) AS body FROM num GROUP BY doc_id),
m AS (SELECT doc_id, CASE WHEN contains(lower(body), 'resolución no.') THEN 'resolucion' ELSE 'legal_document' END AS document_type,
  nullif(regexp_extract(body, '(?i)Resolución' || chr(92) || 's+No' || chr(92) || '.?' || chr(92) || 's*(' || chr(92) || 'd{{3,6}})', 1), '') AS resolution_number FROM joined)
SELECT doc_id, source, chunk_index, h1, h2, h3, h4, big AS is_refined, content, document_type, resolution_number, {section_sql('content')} AS section
FROM num JOIN m USING (doc_id) JOIN documents USING (doc_id)""")
def ingest_end_to_end(spark, sf):
    rows = I.ingest(W.noisy(spark, sf), "body", processed_at=F.lit("2024-05-01"), splitter=C.fixed_splitter(800, 150))
    return rows.filter("success").withColumn("chunk_index", F.col("chunk_index").cast("bigint")).select(*INGEST_COLUMNS)


@query("ingest_recursive", f"""
WITH RECURSIVE {S.NOISY}, md AS (SELECT doc_id, source, {_legal('body')} AS body FROM noisy), {sections_sql('md')}, {recursive_chunks_sql()},
num AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sec_no, i) - 1 AS chunk_index FROM pieces),
joined AS (SELECT doc_id, string_agg(content, chr(10) || chr(10) ORDER BY chunk_index) AS body FROM num GROUP BY doc_id),
m AS (SELECT doc_id, CASE WHEN contains(lower(body), 'resolución no.') THEN 'resolucion' ELSE 'legal_document' END AS document_type,
  nullif(regexp_extract(body, '(?i)Resolución' || chr(92) || 's+No' || chr(92) || '.?' || chr(92) || 's*(' || chr(92) || 'd{{3,6}})', 1), '') AS resolution_number FROM joined)
SELECT doc_id, source, chunk_index, h1, h2, h3, h4, big AS is_refined, content, document_type, resolution_number, {section_sql('content')} AS section,
  true AS success, CAST(NULL AS VARCHAR) AS error
FROM num JOIN m USING (doc_id) JOIN documents USING (doc_id)""")
def ingest_recursive(spark, sf):
    """The default path: the splitter that users get."""
    rows = I.ingest(W.noisy(spark, sf), "body", processed_at=F.lit("2024-05-01"))
    return rows.withColumn("chunk_index", F.col("chunk_index").cast("bigint")).select(*INGEST_COLUMNS, "success", "error")


# -------------------------------------------------------------------- levels

@query("hier_index", f"""
WITH ch AS (SELECT doc_id, i - 1 AS chunk_index, parts[i] AS content FROM (
  SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS i FROM (SELECT doc_id, {windows_sql('text', 1100, 300)} AS parts FROM documents)))
SELECT doc_id, chunk_index, 'detailed' AS level, false AS is_summary, NULL AS original_content_length FROM ch
UNION ALL SELECT doc_id, chunk_index, 'summary', true, length(content) FROM ch""")
def hier_index(spark, sf):
    return H.build_levels(_summary_chunks(spark, sf)).select(
        "doc_id", "chunk_index", "level", "is_summary", F.col("original_content_length").cast("bigint").alias("original_content_length"))


def _summary_chunks(spark, sf):
    cut = C.split_fixed(F.col("text"), 1100, 300)
    return W.documents(spark, sf).select("doc_id", F.posexplode(cut).alias("pos", "content")).select(
        "doc_id", F.col("pos").cast("bigint").alias("chunk_index"), "content")


SENTENCES = r"list_filter(string_split(regexp_replace({0}, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)), lambda s: trim(s) <> '')"


@query("summarize_extractive", rf"""
WITH ch AS (SELECT doc_id, i - 1 AS chunk_index, parts[i] AS content FROM (
  SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS i FROM (SELECT doc_id, {windows_sql('text', 1100, 300)} AS parts FROM documents))),
st AS (SELECT doc_id, chunk_index, pos, ss[pos] AS s FROM (
  SELECT doc_id, chunk_index, ss, unnest(generate_series(1, len(ss))) AS pos FROM (
    SELECT doc_id, chunk_index, {SENTENCES.format('content')} AS ss FROM ch))),
sc AS (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_index ORDER BY len(list_filter(list_distinct({S.tokens('s')}), lambda w: length(w) >= 4)) DESC, pos) AS r FROM st)
SELECT doc_id, chunk_index, coalesce(x, '') AS content, true AS is_summary FROM (
  SELECT doc_id, chunk_index FROM ch) LEFT JOIN (
  SELECT doc_id, chunk_index, string_agg(s, ' ' ORDER BY pos) AS x FROM sc WHERE r <= 3 GROUP BY ALL) USING (doc_id, chunk_index)""")
def summarize_extractive(spark, sf):
    return H.summarize(_summary_chunks(spark, sf)).drop("original_content_length")


# MurmurHash3 (32 bits, seed 42) of a term's UTF-8 bytes, in 64-bit arithmetic; ``hex`` holds the bytes as text
M32 = "4294967296::HUGEINT"
ROTATED = lambda x, n: f"((({x}) * {2 ** n}) % {M32} + ({x}) // {2 ** (32 - n)})"
MIXED = lambda k: f"(({ROTATED(f'(({k})::HUGEINT * 3432918353) % {M32}', 15)}) * 461845907) % {M32}"
BYTE = lambda i: f"('0x' || substring(hx, {i} * 2 + 1, 2))::UBIGINT"
HASHED = f"""
terms AS (SELECT DISTINCT term, hex(encode(term)) AS hx, strlen(term) AS size FROM tf),
blocks AS (SELECT term, size, list_transform(generate_series(0, size // 4 - 1), lambda b: {BYTE('(b * 4)')} + {BYTE('(b * 4 + 1)')} * 256 + {BYTE('(b * 4 + 2)')} * 65536 + {BYTE('(b * 4 + 3)')} * 16777216) AS ks,
  list_sum(list_transform(generate_series(size // 4 * 4, size - 1), lambda i: {BYTE('i')} * (256 ** (i % 4))::UBIGINT))::HUGEINT AS tail FROM terms),
walked AS (SELECT term, size, tail, list_reduce(list_prepend(42::HUGEINT, list_transform(ks, lambda k: ({MIXED('k')})::HUGEINT)),
  lambda h, k: (({ROTATED('xor(h, k)', 13)}) * 5 + 3864292196) % {M32}) AS h FROM blocks),
ended AS (SELECT term, xor(CASE WHEN tail IS NULL THEN h ELSE xor(h, ({MIXED('tail')})::HUGEINT) END, size::HUGEINT) AS h FROM walked),
f1 AS (SELECT term, (xor(h, h // 65536) * 2246822507) % {M32} AS h FROM ended),
f2 AS (SELECT term, (xor(h, h // 8192) * 3266489909) % {M32} AS h FROM f1),
placed AS (SELECT term, CAST(xor(h, h // 65536) % 64 AS INTEGER) AS dim FROM f2)"""


@query("embed_hashing", f"""
WITH tk AS (SELECT doc_id, {S.tokens("coalesce(text, '')")} AS toks FROM documents),
tf AS (SELECT doc_id, unnest(toks) AS term FROM tk), {HASHED},
counted AS (SELECT doc_id, dim, count(*) AS n FROM tf JOIN placed USING (term) GROUP BY ALL),
weighed AS (SELECT doc_id, dim, n * ln(((SELECT count(*) FROM documents) + 1.0) / (count(*) OVER (PARTITION BY dim) + 1.0)) AS w FROM counted),
unit AS (SELECT doc_id, dim, CAST(w / nullif(sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 0) AS FLOAT)::DOUBLE AS x FROM weighed),
cells AS (SELECT doc_id, d.dim, round(coalesce(x, 0.0), 4) + 0.0 AS x FROM documents CROSS JOIN (SELECT unnest(generate_series(0, 63)) AS dim) d LEFT JOIN unit USING (doc_id, dim))
SELECT doc_id, list(x ORDER BY dim) AS embedding FROM cells GROUP BY doc_id""")
def embed_hashing(spark, sf):
    out = embed(W.documents(spark, sf).select("doc_id", "text"))
    return out.select("doc_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 4)).alias("embedding"))


# ---------------------------------------------------------------- evaluation

SCORES = f"""{S.REPLIES},
txt AS (SELECT doc_id, trim(regexp_replace(reply, '```(?:json)?[ \\n\\t]*', '', 'g'), ' ' || chr(10)) AS j FROM replies),
scores AS (SELECT doc_id, CASE WHEN json_valid(j) THEN CAST(json_extract_string(j, '$.faithfulness') AS INT) ELSE 0 END AS faithfulness,
  CASE WHEN json_valid(j) THEN CAST(json_extract_string(j, '$.completeness') AS INT) ELSE 0 END AS completeness,
  CASE WHEN json_valid(j) THEN CAST(json_extract_string(j, '$.citation_quality') AS INT) ELSE 0 END AS citation_quality,
  CASE WHEN json_valid(j) THEN json_extract_string(j, '$.reasoning') ELSE 'Fallo: invalid JSON' END AS reasoning FROM txt)"""


@query("parse_judge", f"WITH {SCORES} SELECT * FROM scores")
def parse_judge(spark, sf):
    return E.parse_judge(W.judge_replies(spark, sf)).select("doc_id", *E.METRICS, "reasoning")


@query("eval_summary", f"""
WITH {SCORES}
SELECT round(avg(faithfulness), 6) AS faithfulness, round(avg(completeness), 6) AS completeness, round(avg(citation_quality), 6) AS citation_quality,
  count(*) AS n, round((avg(faithfulness) + avg(completeness) + avg(citation_quality)) / 3, 6) AS overall FROM scores""")
def eval_summary(spark, sf):
    out = E.summary(E.parse_judge(W.judge_replies(spark, sf)))
    return out.select(*[F.round(c, 6).alias(c) for c in (*E.METRICS, "overall")], "n")


LATENCY = "lat AS (SELECT event_id, value FROM events)"


@query("eval_detail", f"""
WITH {SCORES}, {LATENCY}
SELECT doc_id, faithfulness, completeness, citation_quality, printf('%.2fs', value) AS latency, reasoning FROM scores JOIN lat ON event_id = doc_id""")
def eval_detail(spark, sf):
    latency = W.table(spark, sf, "events").select(F.col("event_id").alias("doc_id"), "value")
    out = E.detail(E.parse_judge(W.judge_replies(spark, sf)).join(latency, "doc_id"), "value")
    return out.select("doc_id", *E.METRICS, "latency", "reasoning")


@query("eval_report_rows", f"""
WITH {SCORES}
SELECT doc_id, faithfulness, reasoning, '| ' || doc_id || ' | ' || faithfulness || ' | ' || reasoning || ' |' AS line FROM scores""")
def eval_report_rows(spark, sf):
    return E.report_rows(E.parse_judge(W.judge_replies(spark, sf)), ["doc_id", "faithfulness", "reasoning"])


PARSED = f"""{S.ANALYSIS},
txt AS (SELECT doc_id, trim(regexp_replace(reply, '```(?:json)?[ \\n\\t]*', '', 'g'), ' ' || chr(10)) AS j FROM analysis)"""


TEXTS = ("tipo_documento", "tono_general", "analisis_critico")
NUMBERS = ("nivel_urgencia", "nivel_coercion")
LISTS = ("temas_principales", "plazos_inmediatos", "ambigüedades_identificadas", "excepciones_mencionadas", "entidades_afectadas",
         "referencias_internas", "menciones_de_otras_leyes")


def _json_fields():
    when = lambda e: f"CASE WHEN json_valid(j) THEN {e} END"
    rows = [when(f"json_extract_string(j, '$.{c}')") + f" AS {c}" for c in TEXTS]
    rows += [when(f"CAST(json_extract_string(j, '$.{c}') AS INT)") + f" AS {c}" for c in NUMBERS]
    rows += [when(f"array_to_string(CAST(json_extract(j, '$.{c}') AS VARCHAR[]), '|')") + f' AS "{c}"' for c in LISTS]
    rows.append(when("CAST(json_array_length(j, '$.obligaciones_criticas') AS INT)") + " AS n_obligations")
    rows.append(when("CAST(len(json_keys(j, '$.definiciones_clave')) AS INT)") + " AS n_definitions")
    return ", ".join(rows)


@query("parse_analysis", f"""
WITH {PARSED}
SELECT doc_id, json_valid(j) AS valid, {_json_fields()},
  CASE WHEN json_valid(j) THEN NULL ELSE 'Error procesando el análisis especializado: invalid JSON' END AS error FROM txt""")
def parse_analysis(spark, sf):
    out = E.parse_analysis(W.analysis_replies(spark, sf))
    when = lambda value, name: F.when(F.col("valid"), value).alias(name)
    return out.select(
        "doc_id", "valid", *[when(F.col(f"parsed.{c}"), c) for c in (*TEXTS, *NUMBERS)],
        *[when(F.array_join(f"parsed.`{c}`", "|"), c) for c in LISTS],
        when(F.size("parsed.obligaciones_criticas"), "n_obligations"), when(F.size(F.map_keys("parsed.definiciones_clave")), "n_definitions"), "error")


@query("analysis_obligations", f"""
WITH {PARSED}, n AS (SELECT doc_id, j, unnest(generate_series(1, CAST(json_array_length(j, '$.obligaciones_criticas') AS BIGINT))) AS p FROM txt WHERE json_valid(j))
SELECT doc_id, CAST(p - 1 AS BIGINT) AS pos, json_extract_string(j, '$.obligaciones_criticas[' || (p - 1) || '].texto') AS texto,
  json_extract_string(j, '$.obligaciones_criticas[' || (p - 1) || '].sujeto') AS sujeto,
  json_extract_string(j, '$.obligaciones_criticas[' || (p - 1) || '].plazo') AS plazo,
  json_extract_string(j, '$.obligaciones_criticas[' || (p - 1) || '].consecuencia_incumplimiento') AS consecuencia_incumplimiento,
  CAST(json_extract_string(j, '$.obligaciones_criticas[' || (p - 1) || '].nivel_criticidad') AS INT) AS nivel_criticidad
FROM n""")
def analysis_obligations(spark, sf):
    out = E.obligations(E.parse_analysis(W.analysis_replies(spark, sf)), "doc_id")
    return out.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "texto", "sujeto", "plazo", "consecuencia_incumplimiento", "nivel_criticidad")


@query("analysis_definitions", f"""
WITH {PARSED} SELECT doc_id, 'término' AS term, json_extract_string(j, '$.definiciones_clave.término') AS definition FROM txt WHERE json_valid(j)""")
def analysis_definitions(spark, sf):
    return E.definitions(E.parse_analysis(W.analysis_replies(spark, sf)), "doc_id")


# ----------------------------------------------------------------- streaming

def _drain(stream, sink, spark):
    X.start(stream, sink, new_table_path(spark, "checkpoint")).awaitTermination()


def _arriving(spark, rows, name, schema, batches=4):
    """A table as files that arrive one micro-batch after the other, each batch in as many files as keep all cores busy and each small."""
    path = new_table_path(spark, f"arriving-{name}")
    files = max(spark.sparkContext.defaultParallelism, -(-rows.rdd.getNumPartitions() // batches))
    rows.repartition(batches * files).write.parquet(path)
    return X.file_stream(spark, path, "*.parquet", schema, files_per_batch=files)


@query("stream_ingest", f"""
WITH md AS (SELECT doc_id, {_legal('text')} AS body FROM documents), {sections_sql('md')}, {chunks_sql(800, 150)}
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sec_no, i) - 1 AS chunk_index, content, true AS success FROM pieces
UNION ALL SELECT doc_id, NULL, NULL, false FROM md WHERE body = ''""")
def stream_ingest(spark, sf):
    out = new_table_path(spark, "stream-ingest")
    docs = _arriving(spark, W.documents(spark, sf), "documents", DOCUMENTS_SCHEMA).select("doc_id", "source", "text")
    _drain(docs, X.ingest_sink(out, processed_at=F.lit("2024-05-01"), splitter=C.fixed_splitter(800, 150)), spark)
    return spark.read.parquet(out).select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "content", "success")


@query("stream_index", f"""
WITH {S.BLANKS}, md AS (SELECT doc_id, {_legal('text')} AS body FROM src), {sections_sql('md')}, {chunks_sql(800, 150)},
out AS (SELECT doc_id, true AS success FROM pieces UNION ALL SELECT doc_id, false FROM md WHERE body = '')
SELECT source, success, count(*) AS n FROM out JOIN src USING (doc_id) GROUP BY ALL""")
def stream_index(spark, sf):
    """Chunks per source, and beside them the documents set aside for having no text."""
    out = new_table_path(spark, "stream-index")
    docs = _arriving(spark, W.with_blanks(W.documents(spark, sf)), "documents", DOCUMENTS_SCHEMA).select("doc_id", "source", "text")
    _drain(docs, X.ingest_sink(out, processed_at=F.lit("2024-05-01"), splitter=C.fixed_splitter(800, 150)), spark)
    return spark.read.parquet(out).groupBy("source", "success").agg(F.count("*").alias("n"))


@query("stream_dedupe", f"""
WITH {S.LIBRARY} SELECT file_hash, min(doc_id) AS doc_id, count(*) AS copies FROM lib GROUP BY file_hash""")
def stream_dedupe(spark, sf):
    out = new_table_path(spark, "stream-dedupe")
    _drain(_arriving(spark, W.documents(spark, sf), "documents", DOCUMENTS_SCHEMA), X.dedupe_sink(out, "doc_id"), spark)
    return X.once_per_content(spark, out, "doc_id")


@query("stream_window_counts", """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total
FROM events GROUP BY ALL""")
def stream_window_counts(spark, sf):
    out = new_table_path(spark, "stream-windows")
    _drain(_arriving(spark, W.table(spark, sf, "events"), "events", EVENTS_SCHEMA), X.window_sink(out), spark)
    return X.merged_windows(spark, out).select(
        F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("stream_first_copies", f"WITH {S.LIBRARY} SELECT DISTINCT file_hash FROM lib")
def stream_first_copies(spark, sf):
    """Each content once, whenever its copies arrive: the engine's state first, the library for those after its time."""
    out = new_table_path(spark, "stream-first")
    stream = _arriving(spark, W.documents(spark, sf), "documents", DOCUMENTS_SCHEMA, 6)
    _drain(X.first_per_content(stream, "30 seconds"), X.library_sink(out, ["doc_id"]), spark)
    return spark.read.parquet(out).select("file_hash")


@query("stream_window_final", """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total
FROM events GROUP BY ALL""")
def stream_window_final(spark, sf):
    """Windows given out as final, open ones, and late rows: together they are all rows."""
    out = new_table_path(spark, "stream-final")
    stream = _arriving(spark, W.table(spark, sf, "events"), "events", EVENTS_SCHEMA)
    for running in X.start_windows(stream, out, new_table_path(spark, "checkpoint"), "2 hours"):
        running.awaitTermination()
    return X.settled_windows(spark, out).select(
        F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", (F.col("n") + F.col("n_late")).alias("n"),
        F.round(F.col("total") + F.col("total_late"), 4).alias("total"))

"""Sections, chunks, metadata and quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from codexflow.functions import fields, fixed_values as V
from codexflow.operators import chunking as C
from codexflow.operators import quality as Q
from codexflow.operators.answering import context_window as add_windows
from codexflow.operators.enrich import enrich_chunks as enrich
from codexflow.operators.enrich import extract_metadata as extract
from codexflow.sources import pages as P
from workload import sqlviews as S
from workload import views as W
from workload.registry import query
from workload.text_queries import _loader

OVER = "(PARTITION BY doc_id ORDER BY {0} ROWS UNBOUNDED PRECEDING)"


def sections_sql(view: str, body: str = "body", extra: str = "") -> str:
    """CTEs ending in sections(doc_id, sec_no, h1..h4, content), line by line."""
    win = "OVER (PARTITION BY doc_id ORDER BY pos)"
    levels = ",\n".join(
        f"last_value(CASE WHEN level BETWEEN 1 AND {n} THEN CASE WHEN level = {n} THEN 'T' || title ELSE 'N' END END IGNORE NULLS) "
        f"OVER (PARTITION BY doc_id ORDER BY sec ROWS UNBOUNDED PRECEDING) AS p{n}" for n in range(1, 5))
    same = " AND ".join(f"lag(p{n}) OVER w IS NOT DISTINCT FROM p{n}" for n in range(1, 5))
    return rf"""
ln AS (
  SELECT doc_id, pos, {S.strip('lines[pos]')} AS line FROM (
    SELECT doc_id, lines, unnest(generate_series(1, len(lines))) AS pos
    FROM (SELECT doc_id, string_split({body}, chr(10)) AS lines FROM {view}))),
hd AS (SELECT *, regexp_matches(line, '^#{{1,4}}( |$)') AS is_head, coalesce(lag(line) {win} = '', false) AS gap FROM ln),
sc AS (SELECT *, sum(CAST(is_head AS INT)) {win} AS sec FROM hd),
kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sec ORDER BY pos) AS nth FROM sc WHERE line <> ''),
raw AS (
  SELECT doc_id, sec, string_agg(CASE WHEN nth = 1 THEN '' WHEN gap THEN '  ' || chr(10) ELSE chr(10) END || line, '' ORDER BY pos) AS content,
    max(CASE WHEN is_head THEN length(regexp_extract(line, '^#+')) ELSE 0 END) AS level,
    max(CASE WHEN is_head THEN {S.strip("regexp_replace(line, '^#+', '')")} END) AS title, arg_max(line, pos) AS last_line
  FROM kept GROUP BY doc_id, sec),
pt0 AS (SELECT *, {levels} FROM raw),
pt AS (SELECT * REPLACE (nullif(p1, 'N') AS p1, nullif(p2, 'N') AS p2, nullif(p3, 'N') AS p3, nullif(p4, 'N') AS p4) FROM pt0),
dp AS (SELECT *, CAST(p1 IS NOT NULL AS INT) + CAST(p2 IS NOT NULL AS INT) + CAST(p3 IS NOT NULL AS INT) + CAST(p4 IS NOT NULL AS INT) AS depth FROM pt),
mg AS (SELECT *, coalesce(lag(sec) OVER w IS NOT NULL AND (({same}) OR (lag(depth) OVER w < depth AND starts_with(lag(last_line) OVER w, '#'))), false) AS merges
  FROM dp WINDOW w AS (PARTITION BY doc_id ORDER BY sec)),
gr AS (SELECT *, sum(CAST(NOT merges AS INT)) OVER (PARTITION BY doc_id ORDER BY sec) AS sec_no FROM mg),
sections AS (
  SELECT doc_id, sec_no, substring(arg_max(coalesce(p1, ''), sec), 2) AS t1, string_agg(content, '  ' || chr(10) ORDER BY sec) AS content,
    {", ".join(f"substring(last(p{n} ORDER BY sec), 2) AS h{n}" for n in range(1, 5))}
  FROM gr GROUP BY doc_id, sec_no)"""


def windows_sql(text: str, size: int, overlap: int) -> str:
    """List of fixed windows over a text expression."""
    return (f"list_transform(generate_series(0, greatest(length({text}) - {overlap}, 1) - 1, {size - overlap}), "
            f"lambda o: substring({text}, CAST(o AS BIGINT) + 1, {size}))")


def chunks_sql(size: int, overlap: int) -> str:
    return f"""
cut AS (SELECT *, length(content) > {size} AS big, CASE WHEN length(content) > {size} THEN {windows_sql('content', size, overlap)} ELSE [content] END AS parts
  FROM sections),
pieces AS (SELECT doc_id, sec_no, h1, h2, h3, h4, big, i, parts[i] AS content FROM (SELECT *, unnest(generate_series(1, len(parts))) AS i FROM cut))"""


# ------------------------------------------------------------------ sections

@query("split_headers", f"WITH {S.LEGAL}, {sections_sql('legal')} SELECT doc_id, sec_no - 1 AS section_no, h1, h2, h3, h4, content FROM sections")
def split_headers(spark, sf):
    rows = W.legal(spark, sf).select("doc_id", C.split_headers(F.col("body")).alias("chunks"))
    return C.explode_chunks(rows).withColumn("section_no", F.col("chunk_index").cast("bigint")).drop("chunk_index")


RECURSIVE = (V.ADAPTIVE_SEPARATORS, V.ADAPTIVE_SIZE, V.ADAPTIVE_OVERLAP)


def recursive_chunks_sql(separators: list[str] = V.ADAPTIVE_SEPARATORS, size: int = V.ADAPTIVE_SIZE, overlap: int = V.ADAPTIVE_OVERLAP) -> str:
    """CTEs ending in pieces(doc_id, sec_no, h1..h4, big, i, content): sections, the large ones cut by the default splitter."""
    large = f"(SELECT * FROM sections WHERE length(content) > {size})"
    split = S.recursive_split(large, "struct_pack(d := doc_id, s := sec_no)", "content", separators, size, overlap)
    return f"""{split},
pieces AS (
  SELECT doc_id, sec_no, h1, h2, h3, h4, true AS big, i + 1 AS i, rec.content FROM rec JOIN sections ON doc_id = rec.k.d AND sec_no = rec.k.s
  UNION ALL SELECT doc_id, sec_no, h1, h2, h3, h4, false, 1, content FROM sections WHERE length(content) <= {size})"""


@query("split_recursive", f"WITH RECURSIVE {S.recursive_split('documents', 'doc_id', 'text', *RECURSIVE)} SELECT k AS doc_id, i AS chunk_index, content FROM rec")
def split_recursive(spark, sf):
    cut = C.split_recursive(F.col("text"), *RECURSIVE)
    return W.documents(spark, sf).select("doc_id", F.posexplode(cut).alias("pos", "content")).select(
        "doc_id", F.col("pos").cast("bigint").alias("chunk_index"), "content")


@query("split_recursive_sql", f"WITH RECURSIVE {S.recursive_split('documents', 'doc_id', 'text', *RECURSIVE)} SELECT k AS doc_id, i AS chunk_index, content FROM rec")
def split_recursive_sql(spark, sf):
    """The splitter as a table function, called from SQL text."""
    C.register_split_recursive(spark, "split_recursive", *RECURSIVE)
    return spark.sql("SELECT d.doc_id, c.chunk_index, c.content FROM {docs} AS d, LATERAL split_recursive(d.text) AS c", docs=W.documents(spark, sf))


@query("split_fixed_overlap", f"""
SELECT doc_id, i - 1 AS chunk_index, parts[i] AS content FROM (
  SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS i FROM (
    SELECT doc_id, {windows_sql('text', 800, 150)} AS parts FROM documents))""")
def split_fixed_overlap(spark, sf):
    cut = C.split_fixed(F.col("text"), V.ADAPTIVE_SIZE, V.ADAPTIVE_OVERLAP)
    return W.documents(spark, sf).select("doc_id", F.posexplode(cut).alias("pos", "content")).select(
        "doc_id", F.col("pos").cast("bigint").alias("chunk_index"), "content")


@query("chunk_adaptive", f"""
WITH RECURSIVE {S.LEGAL}, {sections_sql('legal')}, {recursive_chunks_sql()}
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sec_no, i) - 1 AS chunk_index, h1, h2, h3, h4,
  CASE WHEN big THEN i - 1 END AS section_chunk_index, big AS is_refined, content FROM pieces""")
def chunk_adaptive(spark, sf):
    rows = C.chunk_adaptive(W.legal(spark, sf).select("doc_id", "body"), "body")
    return rows.withColumns({c: F.col(c).cast("bigint") for c in ("chunk_index", "section_chunk_index")})


@query("chunk_adaptive_fixed", f"""
WITH {S.LEGAL}, {sections_sql('legal')}, {chunks_sql(800, 150)}
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sec_no, i) - 1 AS chunk_index, h1, h2, h3, h4,
  CASE WHEN big THEN i - 1 END AS section_chunk_index, big AS is_refined, content FROM pieces""")
def chunk_adaptive_fixed(spark, sf):
    rows = C.chunk_adaptive(W.legal(spark, sf).select("doc_id", "body"), "body", splitter=C.fixed_splitter(800, 150))
    return rows.withColumns({c: F.col(c).cast("bigint") for c in ("chunk_index", "section_chunk_index")})


ARTICLE = "nullif(rtrim(coalesce(regexp_extract({0}, '(?i)ARTÍCULO\\s*([\\d.]+)', 1), ''), '.'), '')"
PAGE = "TRY_CAST(regexp_extract({0}, '\\[Página\\s*(\\d+)\\]', 1) AS INTEGER)"


PAGE_TEXT_CHUNKS = rf"""named AS (SELECT *, {ARTICLE.format('piece')} AS article, {PAGE.format('piece')} AS page FROM pieces WHERE length({S.strip('piece')}) >= 1),
done AS (SELECT *, '[Documento: ' || source || ' | ' || coalesce('Art. ' || article, 'Contexto general') || ' | Página: ' || coalesce(CAST(page AS VARCHAR), '?')
  || ']' || chr(10) || {S.strip('piece')} AS content FROM named)
SELECT doc_id, source, chunk_index, article, page, content, length(content) AS chunk_size FROM done"""
MARKDOWN_CHUNKS = rf"""named AS (SELECT p.*, source, coalesce(nullif(rtrim(coalesce(regexp_extract(h3, '(\d[\d.]*)', 1), ''), '.'), ''), {ARTICLE.format('p.content')}) AS article
  FROM pieces p JOIN documents USING (doc_id) WHERE length({S.strip('p.content')}) >= 1),
done AS (SELECT *, '[Documento: ' || source || ' | ' || coalesce('Art. ' || article, 'Contexto general')
  || coalesce(' | ' || coalesce(nullif(h2, ''), nullif(h1, '')), '') || ' | Formato: Markdown]' || chr(10) || {S.strip('content')} AS full_content FROM named)
SELECT doc_id, source, row_number() OVER (PARTITION BY doc_id ORDER BY sec_no, i) - 1 AS chunk_index, h1, h2, h3, h4,
  CASE WHEN big THEN i - 1 END AS section_chunk_index, big AS is_refined, article, full_content AS content, length(full_content) AS chunk_size, 'markdown' AS format
FROM done"""


@query("chunk_page_text", rf"""
WITH {S.NOISY},
cut AS (SELECT doc_id, source, {windows_sql('t', 2500, 400)} AS parts FROM (SELECT doc_id, source, {_loader('body')} AS t FROM noisy)),
pieces AS (SELECT doc_id, source, i - 1 AS chunk_index, parts[i] AS piece FROM (SELECT *, unnest(generate_series(1, len(parts))) AS i FROM cut)),
{PAGE_TEXT_CHUNKS}""")
def chunk_page_text(spark, sf):
    rows = C.chunk_page_text(W.noisy(spark, sf), "body", splitter=C.fixed_splitter(2500, 400))
    return rows.withColumns({c: F.col(c).cast("bigint") for c in ("chunk_index", "chunk_size")})


@query("chunk_markdown", rf"""
WITH {S.LEGAL}, md AS (SELECT doc_id, source, {_loader('body')} AS body FROM legal), {sections_sql('md')}, {chunks_sql(600, 100)},
{MARKDOWN_CHUNKS}""")
def chunk_markdown(spark, sf):
    rows = C.chunk_markdown(W.legal(spark, sf), "body", size=600, splitter=C.fixed_splitter(600, 100))
    return rows.withColumns({c: F.col(c).cast("bigint") for c in ("chunk_index", "section_chunk_index", "chunk_size")})


@query("chunk_page_text_default", rf"""
WITH RECURSIVE {S.NOISY}, src AS (SELECT doc_id, source, {_loader('body')} AS t FROM noisy),
{S.recursive_split('src', 'doc_id', 't', V.PAGE_TEXT_SEPARATORS, V.LOADER_SIZE, V.LOADER_OVERLAP)},
pieces AS (SELECT doc_id, source, i AS chunk_index, content AS piece FROM rec JOIN src ON doc_id = k),
{PAGE_TEXT_CHUNKS}""")
def chunk_page_text_default(spark, sf):
    rows = C.chunk_page_text(W.noisy(spark, sf), "body")
    return rows.withColumns({c: F.col(c).cast("bigint") for c in ("chunk_index", "chunk_size")})


@query("chunk_markdown_default", rf"""
WITH RECURSIVE {S.LEGAL}, md AS (SELECT doc_id, source, {_loader('body')} AS body FROM legal), {sections_sql('md')},
{recursive_chunks_sql(V.MARKDOWN_SEPARATORS, V.LOADER_SIZE, V.LOADER_OVERLAP)},
{MARKDOWN_CHUNKS}""")
def chunk_markdown_default(spark, sf):
    rows = C.chunk_markdown(W.legal(spark, sf), "body")
    return rows.withColumns({c: F.col(c).cast("bigint") for c in ("chunk_index", "section_chunk_index", "chunk_size")})


@query("inject_context_header", f"""
WITH {S.CITABLE}
SELECT doc_id, '[Documento: ' || source || ' | ' || coalesce('Art. ' || article, 'Contexto general') || ' | Página: '
  || coalesce(CAST(page AS VARCHAR), '?') || ']' || chr(10) || content AS content FROM citable""")
def inject_context_header(spark, sf):
    header = fields.context_header(F.col("source"), F.col("article"), F.col("page"))
    return W.citable(spark, sf).select("doc_id", F.concat(header, "content").alias("content"))


@query("extract_page_article", f"WITH {S.NOISY} SELECT doc_id, {PAGE.format('body')} AS page, {ARTICLE.format('body')} AS article FROM noisy")
def extract_page_article(spark, sf):
    b = F.col("body")
    return W.noisy(spark, sf).select("doc_id", fields.page_of(b).alias("page"), fields.article_of(b).alias("article"))


@query("article_number", rf"""
WITH {S.LEGAL}
SELECT doc_id, coalesce(nullif(rtrim(coalesce(regexp_extract(CASE WHEN doc_id % 2 = 0 THEN 'ARTÍCULO 9.' || doc_id || '. x' ELSE 'sin' END, '(\d[\d.]*)', 1), ''), '.'), ''),
  {ARTICLE.format('body')}) AS article FROM legal""")
def article_number(spark, sf):
    head = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("ARTÍCULO 9."), F.col("doc_id").cast("string"), F.lit(". x"))).otherwise("sin")
    return W.legal(spark, sf).select("doc_id", fields.article_number(head, F.col("body")).alias("article"))


@query("context_window", f"""
WITH {S.LEGAL}, {sections_sql('legal')}
SELECT doc_id, sec_no - 1 AS chunk_index, content, string_agg(content, chr(10)) OVER (
  PARTITION BY doc_id ORDER BY sec_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS "window" FROM sections""")
def context_window(spark, sf):
    rows = W.legal(spark, sf).select("doc_id", C.split_headers(F.col("body")).alias("chunks"))
    return C.explode_chunks(add_windows(rows)).withColumn("chunk_index", F.col("chunk_index").cast("bigint"))


@query("parent_child", f"""
WITH {S.LEGAL}, {sections_sql('legal')}
SELECT doc_id, i - 1 AS child_no, parts[i] AS child, content AS parent FROM (
  SELECT *, unnest(generate_series(1, len(parts))) AS i FROM (SELECT doc_id, content, {windows_sql('content', 300, 50)} AS parts FROM sections))""")
def parent_child(spark, sf):
    sections = W.legal(spark, sf).select("doc_id", F.explode(C.split_headers(F.col("body"))).alias("s")).select("doc_id", "s.content")
    return C.with_parents(sections, "content", 300, 50).withColumn("child_no", F.col("child_no").cast("bigint"))


# ------------------------------------------------------------------ metadata

RESOLUTION = S.first("body", r"(?i)Resolución\s+No\.?\s*(\d{3,6})", r"(?i)Resolución\s+Nro\.?\s*(\d{3,6})", r"(?i)RESOLUCIÓN\s+No\.\s*(\d+)")
ENTITY = S.first("body", "(?i)Secretaría Distrital de Ambiente", "(?i)Corporación Autónoma Regional de Cundinamarca",
                 "(?i)CAR.*Alto Magdalena", group=0)
ACRONYM = ("nullif(regexp_extract(body, '(^|[^0-9A-Za-zÀ-ÿ_])({0})([^0-9A-Za-zÀ-ÿ_]|$)', 2), '')")
ENTITY = f"coalesce({ENTITY}, {ACRONYM.format('SDA')}, {ACRONYM.format('CAR')})"
MONTHS = "enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre"
DATE = S.first("body", rf"(?i)(\d{{1,2}})\s+de\s+({MONTHS})\s+de\s+(\d{{4}})", r"(\d{2}/\d{2}/\d{4})", r"(\d{4}-\d{2}-\d{2})", group=0)
NIT = r"translate(" + S.first("body", r"(?i)NIT\s*[:=]?\s*(\d{6,12}[-\s]?\d?)", r"(?i)N\.?I\.?T\.?\s*(\d{6,12})") + ", ' -' || chr(10), '')"
LOCATION = S.strip(S.first("body", *[rf"(?i){p}([A-Za-zÁÉÍÓÚáéíóú\s]+)" for p in ("municipio de ", "localidad de ", r"vereda\s+")]))
CONCESSION = S.first("body", r"(?i)concesión\s+de\s+aguas\s+(subterráneas|superficiales)", r"(?i)concesion\s+de\s+aguas", r"(?i)pozo\s+\d+", group=0)
DOC_TYPE = """CASE WHEN contains(lower(body), 'resolución no.') OR contains(lower(body), 'resuelve') THEN 'resolucion'
  WHEN contains(lower(body), 'concesión de aguas') OR (contains(lower(body), 'pozo') AND contains(lower(body), 'm³')) THEN 'concesion_aguas'
  WHEN contains(lower(body), 'cláusula') THEN 'contrato' ELSE 'legal_document' END"""


def section_sql(c):
    return f"""CASE WHEN contains(upper({c}), 'RESUELVE') THEN 'RESUELVE' WHEN contains(upper({c}), 'CONSIDERANDO') THEN 'CONSIDERANDO'
  WHEN contains(upper({c}), 'ANTECEDENTES') THEN 'ANTECEDENTES' WHEN contains(upper({c}), 'ARTÍCULO') THEN 'ARTICULO'
  WHEN contains(substring(upper({c}), 1, 400), 'TABLA') OR contains(substring({c}, 1, 300), '|') THEN 'TABLA' ELSE 'GENERAL' END"""


def date_sql(raw):
    month = f"list_position(string_split('{MONTHS}', '|'), lower(regexp_extract({raw}, '(?i)de\\s+([a-z]+)\\s+de', 1)))"
    return f"""CAST(coalesce(
      CASE WHEN {month} > 0 THEN make_date(CAST(regexp_extract({raw}, '(\\d{{4}})$', 1) AS INT), CAST({month} AS INT), CAST(regexp_extract({raw}, '^(\\d+)', 1) AS INT)) END,
      CAST(try_strptime({raw}, '%d/%m/%Y') AS DATE), CAST(try_strptime({raw}, '%Y-%m-%d') AS DATE)) AS VARCHAR)"""


META = f"""{DOC_TYPE} AS document_type, {RESOLUTION} AS resolution_number, {ENTITY} AS entity, {DATE} AS issue_date,
  {NIT} AS nit, {LOCATION} AS location, {CONCESSION} AS concession_type"""


def _field(name, expr, fn):
    def run(spark, sf):
        return W.described(spark, sf).select("doc_id", fn(F.col("body")).alias(name))

    return f"WITH {S.DESCRIBED} SELECT doc_id, {expr} AS {name} FROM described", run


for _query, _name, _expr, _fn in [
    ("meta_resolution", "resolution_number", RESOLUTION, fields.resolution_number),
    ("meta_entity", "entity", ENTITY, fields.entity),
    ("meta_entity_compat", "entity", S.first("body", "(?i)Secretaría Distrital de Ambiente", "(?i)Corporación Autónoma Regional de Cundinamarca",
                                             "(?i)CAR.*Alto Magdalena", "(?i)SDA", "(?i)CAR", group=0), lambda c: fields.entity(c, compat=True)),
    ("meta_nit", "nit", NIT, fields.nit),
    ("meta_location", "location", LOCATION, fields.location),
    ("meta_concession", "concession_type", CONCESSION, fields.concession_type),
    ("classify_doc_type", "document_type", DOC_TYPE, fields.document_type),
    ("classify_section", "section", section_sql("body"), fields.section),
]:
    _sql, _run = _field(_name, _expr, _fn)
    query(_query, _sql)(_run)


@query("meta_date", f"""
WITH {S.DESCRIBED}, d AS (SELECT doc_id, {DATE} AS issue_date FROM described)
SELECT doc_id, issue_date, {date_sql('issue_date')} AS parsed FROM d""")
def meta_date(spark, sf):
    rows = W.described(spark, sf).select("doc_id", fields.issue_date(F.col("body")).alias("issue_date"))
    return rows.withColumn("parsed", fields.issue_date_parsed(F.col("issue_date")).cast("string"))


@query("meta_flags", f"""
WITH {S.DESCRIBED}, m AS (SELECT doc_id, {DOC_TYPE} AS k, {RESOLUTION} AS n FROM described)
SELECT doc_id, k = 'resolucion' AS is_resolucion, n IS NOT NULL AS has_resolution_number FROM m""")
def meta_flags(spark, sf):
    return extract(W.described(spark, sf), "body").select("doc_id", "is_resolucion", "has_resolution_number")


@query("extract_metadata", f"""
WITH {S.DESCRIBED}, m AS (SELECT doc_id, {META} FROM described)
SELECT *, {date_sql('issue_date')} AS issue_date_parsed, document_type = 'resolucion' AS is_resolucion,
  resolution_number IS NOT NULL AS has_resolution_number FROM m""")
def extract_metadata(spark, sf):
    return extract(W.described(spark, sf), "body").withColumn("issue_date_parsed", F.col("issue_date_parsed").cast("string"))


@query("enrich_chunks", f"""
WITH {S.DESCRIBED}, {sections_sql('described')}, {chunks_sql(800, 150)},
num AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sec_no, i) - 1 AS chunk_index, content FROM pieces),
joined AS (SELECT doc_id, string_agg(content, chr(10) || chr(10) ORDER BY chunk_index) AS body FROM num GROUP BY doc_id),
m AS (SELECT doc_id, {META} FROM joined)
SELECT doc_id, chunk_index, content, document_type, resolution_number, entity, issue_date, nit, location, concession_type, {section_sql('content')} AS section
FROM num JOIN m USING (doc_id)""")
def enrich_chunks(spark, sf):
    chunked = C.with_adaptive_chunks(W.described(spark, sf), "body", splitter=C.fixed_splitter(800, 150)).drop("body")
    return enrich(chunked).select(
        "doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "content", "document_type", "resolution_number",
        "entity", "issue_date", "nit", "location", "concession_type", "section")


# ------------------------------------------------------------ pages, quality

def _assembled(mark, cap=""):
    return (f"WITH {S.PAGES} SELECT doc_id, string_agg({mark} || text, chr(10) || chr(10) ORDER BY page_no) AS text "
            f"FROM pages_view WHERE {S.strip('text')} <> '' {cap} GROUP BY doc_id")


@query("assemble_pages", _assembled("'[Página ' || page_no || ']' || chr(10)"))
def assemble_pages(spark, sf):
    return P.assemble_pages(W.pages(spark, sf))


@query("assemble_pages_md", _assembled("'## Página ' || page_no || chr(10) || chr(10)"))
def assemble_pages_md(spark, sf):
    return P.assemble_pages_markdown(W.pages(spark, sf))


@query("assemble_clean_pages", f"""
WITH {S.PAGES}, c AS (SELECT doc_id, page_no, {S.strip("array_to_string(list_filter(string_split(regexp_replace(text, '_{4,}|-{4,}', '', 'g'), chr(10)), lambda x: " + S.strip('x') + " <> ''), chr(10))")} AS t FROM pages_view)
SELECT doc_id, string_agg(t, chr(10) || chr(10) ORDER BY page_no) AS text FROM c WHERE t <> '' GROUP BY doc_id""")
def assemble_clean_pages(spark, sf):
    return P.assemble_clean_pages(W.pages(spark, sf))


FEATURES = f"""{S.PAGES},
feat AS (SELECT doc_id, page_no, length(t) AS chars, len({S.tokens('t')}) AS n_words, least(1.0, len({S.tokens('t')}) / 350.0) AS coverage,
    contains(t, '│') OR (contains(t, 'Tabla') AND contains(t, 'Si')) AS has_table
  FROM (SELECT doc_id, page_no, {S.strip('text')} AS t FROM pages_view)),
doc AS (SELECT doc_id, sum(chars) / greatest(count(*), 1) AS avg_chars, avg(CAST(coverage AS DOUBLE)) AS avg_coverage, bool_or(has_table) AS has_tables FROM feat GROUP BY doc_id),
sc AS (SELECT *, least(1.0, avg_chars / 1400.0 * 0.55 + avg_coverage * 0.35) AS score, avg_chars > 650 AND avg_coverage > 0.65 AS is_native,
    avg_chars < 280 OR avg_coverage < 0.45 AS is_scanned FROM doc),
rt AS (SELECT *, CASE WHEN has_tables AND score < 0.75 THEN 'docling' WHEN is_scanned OR score < 0.58 THEN 'ocr_heavy'
    WHEN is_native THEN 'pymupdf' ELSE 'docling' END AS recommendation FROM sc)"""


@query("page_features", f"WITH {FEATURES} SELECT doc_id, page_no, chars, n_words, round(CAST(coverage AS DOUBLE), 6) AS coverage, has_table FROM feat")
def page_features(spark, sf):
    return Q.page_features(W.pages(spark, sf)).select(
        "doc_id", "page_no", F.col("chars").cast("bigint").alias("chars"), F.col("n_words").cast("bigint").alias("n_words"),
        F.round("coverage", 6).alias("coverage"), "has_table")


@query("doc_features", f"WITH {FEATURES} SELECT doc_id, round(avg_chars, 6) AS avg_chars, round(avg_coverage, 6) AS avg_coverage, has_tables FROM doc")
def doc_features(spark, sf):
    return Q.document_features(Q.page_features(W.pages(spark, sf))).select(
        "doc_id", F.round("avg_chars", 6).alias("avg_chars"), F.round("avg_coverage", 6).alias("avg_coverage"), "has_tables")


@query("quality_score", f"WITH {FEATURES} SELECT doc_id, round(score, 6) AS score FROM sc")
def quality_score(spark, sf):
    return Q.assess(W.pages(spark, sf)).select("doc_id", F.round("score", 6).alias("score"))


@query("quality_flags", f"WITH {FEATURES} SELECT doc_id, is_native, is_scanned FROM sc")
def quality_flags(spark, sf):
    return Q.assess(W.pages(spark, sf)).select("doc_id", "is_native", "is_scanned")


@query("quality_route", f"WITH {FEATURES} SELECT doc_id, recommendation FROM rt")
def quality_route(spark, sf):
    return Q.assess(W.pages(spark, sf)).select("doc_id", "recommendation")


def half_even(value: str, digits: int) -> str:
    """Half-even rounding in integers, from nine decimals."""
    unit = 10 ** (9 - digits)
    v = f"CAST(round({value} * 1000000000) AS BIGINT)"
    up = f"CASE WHEN {v} % {unit} > {unit // 2} OR ({v} % {unit} = {unit // 2} AND ({v} // {unit}) % 2 = 1) THEN 1 ELSE 0 END"
    return f"(({v} // {unit} + {up}) / {10 ** digits}::DOUBLE)"


@query("quality_report", f"""
WITH {FEATURES}
SELECT doc_id, is_native, is_scanned, {half_even('score', 3)} AS quality_score, {half_even('avg_chars', 1)} AS avg_chars_per_page,
  {half_even('avg_coverage', 3)} AS text_coverage, 72.0::DOUBLE AS dpi_estimate, has_tables, false AS has_images, recommendation, recommendation = 'ocr_heavy' AS needs_ocr,
  'Chars/page: ' || CAST(CAST({half_even('avg_chars', 0)} AS BIGINT) AS VARCHAR) || printf(', Coverage: %.2f, Tables: ', {half_even('avg_coverage', 2)})
    || CASE WHEN has_tables THEN 'True' ELSE 'False' END || ', DPI: 72 → ' || recommendation AS reasoning
FROM rt""")
def quality_report(spark, sf):
    return Q.report(W.pages(spark, sf))

"""Cleaning, line and name operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from codexflow.functions import text as T
from codexflow.sources.files import path_parts, scan_files, with_sha256
from workload import sqlviews as S
from workload import views as W
from workload.registry import query



def _on(view, column: str, fn):
    return lambda spark, sf: view(spark, sf).select("doc_id", fn(F.col(column)).alias("text"))


def _dots(e):
    return S.sub(e, r"(\d+)\s*,\s*(\d+)", r"\1.\2")


def _general(e):
    return S.strip(S.sub(e, r"\s+", " "))


def _ocr(e):
    for chars, digit in (("lI1", "1"), ("Oo", "0")):
        for _ in range(2):  # neighbours share a separator
            e = S.sub(e, rf"(^|[^0-9A-Za-zÀ-ÿ_])[{chars}]([^0-9A-Za-zÀ-ÿ_]|$)", rf"\1{digit}\2")
    return _general(_dots(e))


def _collapse(e, newlines=3):
    return S.strip(S.sub(f"regexp_replace({e}, '\\n{{4,}}', repeat(chr(10), {newlines}), 'g')", " +", " "))


def _headings(e):
    for w, m in (("ANTECEDENTES", "##"), ("CONSIDERANDO", "##"), ("CONSIDERACIONES TÉCNICAS", "##"),
                 ("ANÁLISIS AMBIENTAL", "##"), ("RESUELVE", "##"), ("ARTÍCULO", "###")):
        e = S.sub(e, f"(?im)^{w}", f"{m} {w}")
    return e


def _noise(e, decree=r"Decreto 1072 de 2015[^\n]*?EVA[^\n]*?Gestor Normativo"):
    for p in ("Departamento Administrativo de la Función Pública", decree, r"Diario Oficial No\.\s*\d+", "_{4,}|-{4,}"):
        e = S.sub(e, f"(?i){p}", "")
    return e


def _units(e):
    for u in ("m³", "L/s"):
        e = S.sub(e, rf"(\d+(?:\.\d+)?)\.?\s*{u}", rf"\1 {u}")
    return e


def _resolution(e):
    return S.sub(e, r"(?i)Resolución\s+No\.\s*0*", "Resolución No. ")


def _legal(e):
    return _collapse(_units(_noise(_headings(_resolution(S.sub(_dots(e), r"[ \t]+", " "))))))


def _compat(e):
    e = _resolution(_ocr(e))
    for w, m in (("ANTECEDENTES", "##"), ("CONSIDERANDO", "##"), ("CONSIDERACIONES TÉCNICAS", "##"),
                 ("ANÁLISIS AMBIENTAL", "##"), ("RESUELVE", "##"), ("ARTÍCULO", "###")):
        e = S.sub(e, f"(?i){w}", f"{m} {w}")
    e = _noise(e, "Decreto 1072 de 2015.*EVA.*Gestor Normativo")
    for u in ("m³", "L/s"):
        e = S.sub(e, rf"(\d+)\.?(\d*)\s*{u}", rf"\1.\2 {u}")
    return _collapse(e)


def _contract(e):
    for w in ("CLÁUSULA", "LAS PARTES"):
        e = S.sub(e, f"(?im)^{w}", f"### {w}")
    return e


def _loader(e):
    e = S.sub(e, "(?i)Departamento Administrativo de la Función Pública", "")
    e = S.sub(e, r"(?i)Decreto 1072 de 2015 Sector Trabajo\s*\d+\s*EVA - Gestor Normativo", "")
    return _collapse(S.sub(e, "_{4,}|-{4,}", ""))


def _loose(e):
    e = S.sub(e, r"(?i)Decreto\s+1072\s+de\s+2015\s+Sector\s+Trabajo\s*\d*\s*EVA\s*[-]?\s*Gestor\s+Normativo", "")
    e = S.sub(e, r"(?i)Departamento\s+Administrativo\s+de\s+la\s+Funci[oó]n\s+P[uú]blica", "")
    return S.sub(e, "_{4,}|-{4,}", "")


def _page(e):
    return S.strip(f"array_to_string(list_filter(string_split({_loose(e)}, chr(10)), lambda x: {S.strip('x')} <> ''), chr(10))")


def _sql(cte, view, expr, column="text"):
    head = f"WITH {cte} " if cte else ""
    return f"{head}SELECT doc_id, {expr} AS {column} FROM {view}"


query("clean_general", _sql("", "documents", _general("text")))(_on(W.documents, "text", T.clean_general))
query("clean_ocr", _sql("", "documents", _ocr("text")))(_on(W.documents, "text", T.clean_ocr))
query("clean_resolution_no", _sql(S.LEGAL, "legal", _resolution("body")))(_on(W.legal, "body", T.normalize_resolution_number))
query("inject_sections", _sql(S.PLAIN, "plain", _headings("body")))(_on(W.plain, "body", T.inject_headings))
query("strip_noise", _sql(S.NOISY, "noisy", _noise("body")))(_on(W.noisy, "body", T.strip_noise))
query("normalize_units", _sql(S.LEGAL, "legal", _units(_dots("body"))))(
    _on(W.legal, "body", lambda c: T.normalize_units(T.dot_decimals(c))))
query("collapse_blank", _sql(S.NOISY, "noisy", _collapse("body")))(_on(W.noisy, "body", T.collapse_blank))
query("clean_legal", _sql(S.NOISY, "noisy", _legal("body")))(_on(W.noisy, "body", T.clean_legal))
query("clean_legal_compat", _sql(S.NOISY, "noisy", _compat("body")))(
    _on(W.noisy, "body", lambda c: T.clean_legal(c, compat=True)))
query("clean_contract", _sql(S.PLAIN, "plain", _contract(_legal("replace(body, 'PARÁGRAFO 1.', 'Cláusula primera.')"))))(
    _on(W.plain, "body", lambda c: T.clean_contract(F.replace(c, F.lit("PARÁGRAFO 1."), F.lit("Cláusula primera.")))))
query("clean_loader", _sql(S.NOISY, "noisy", _loader("body")))(_on(W.noisy, "body", T.clean_loader))
query("clean_markdown", _sql(S.NOISY, "noisy", _collapse(_loose("body"))))(_on(W.noisy, "body", T.clean_markdown))
query("clean_page", _sql(S.NOISY, "noisy", _page("body")))(_on(W.noisy, "body", T.clean_page))
query("clean_basic", _sql(S.NOISY, "noisy", _collapse(
    S.sub(S.sub(S.sub(S.sub("body", "(?i)Departamento Administrativo de la Función Pública", ""),
                      r"(?i)Decreto 1072 de 2015 Sector Trabajo\s*\d+\s*EVA - Gestor Normativo", ""), "_{4,}|-{4,}", ""),
          r"\[Página \d+\]", ""), 2)))(_on(W.noisy, "body", T.clean_basic))
query("fold_accents", _sql("", "documents", (
    "translate(replace(text, 'ß', 'ss'), 'áàâäãéèêëíìîïóòôöõúùûüñçÁÀÂÄÃÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ', "
    "'aaaaaeeeeiiiiooooouuuuncAAAAAEEEEIIIIOOOOOUUUUNC')")))(_on(W.documents, "text", T.fold_accents))


@query("clean_by_profile", f"""
SELECT doc_id, CASE lang WHEN 'en' THEN {_general('text')} WHEN 'fr' THEN {_ocr('text')}
  WHEN 'de' THEN {S.strip(_contract(_legal('text')))} ELSE {_legal('text')} END AS text
FROM documents""")
def clean_by_profile(spark, sf):
    profile = (F.when(F.col("lang") == "en", "general").when(F.col("lang") == "fr", "ocr_output")
               .when(F.col("lang") == "de", "contract").otherwise("anything else"))
    return W.documents(spark, sf).select("doc_id", T.clean_by_profile(F.col("text"), profile).alias("text"))


@query("lines_to_markdown", f"""
WITH {S.PLAIN},
t AS (SELECT doc_id, list_filter(list_transform(string_split(replace(body, 'PARÁGRAFO 1. ', '1. '), chr(10)), lambda x: {S.strip('x')}),
    lambda x: x <> '' AND NOT regexp_matches(x, '(?i)EVA - Gestor Normativo|Función Pública')) AS l FROM plain)
SELECT doc_id, {_collapse(_loose(r'''array_to_string(list_transform(l, lambda x: CASE
  WHEN regexp_matches(x, '(?i)^(ARTÍCULO|CAPÍTULO|SECCIÓN|PARÁGRAFO|PARTE\s+\d|TÍTULO)\s') THEN chr(10) || '## ' || x || chr(10)
  WHEN regexp_matches(x, '^\d+\.\s') THEN '- ' || x ELSE x END), chr(10))'''))} AS text
FROM t""")
def lines_to_markdown(spark, sf):
    raw = F.replace("body", F.lit("PARÁGRAFO 1. "), F.lit("1. "))
    return W.plain(spark, sf).select("doc_id", T.lines_to_markdown(raw).alias("text"))


@query("rows_to_markdown_table", """
SELECT p_partkey AS id, '| name | brand | size |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| ' || p_name || ' | '
  || coalesce(CASE WHEN p_size % 3 > 0 THEN p_brand END, '') || ' | ' || p_size || ' |' || chr(10) AS table_md
FROM part""")
def rows_to_markdown_table(spark, sf):
    header = F.array(F.lit("name"), F.lit("brand"), F.lit("size"))
    row = F.array("p_name", F.when(F.col("p_size") % 3 > 0, F.col("p_brand")), F.col("p_size").cast("string"))
    return W.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), T.rows_to_markdown_table(F.array(header, row)).alias("table_md"))


def paragraphs_sql(view: str, body: str) -> str:
    """CTEs ending in mended(doc_id, body)."""
    return rf"""
p AS (
  SELECT doc_id, i, {S.strip('parts[i]')} AS para FROM (
    SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS i FROM (
      SELECT doc_id, regexp_split_to_array({body}, '\n\n+') AS parts FROM {view}))),
f AS (
  SELECT doc_id, i, para, lead(para) OVER w AS nxt,
    coalesce(para <> '' AND NOT contains('.;:)]"', right(para, 1)) AND lead(para) OVER w <> '' AND NOT regexp_matches(lead(para) OVER w,
      '(?i)^(ART[IÍ]CULO|CAP[IÍ]TULO|SECCI[OÓ]N|P[AÁ]R[AÁ]GRAFO|\d+\.\s|\(Decreto|\(Par[aá]grafo)'), false) AS joins
  FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT *, i - sum(CAST(joins AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM f),
r AS (SELECT *, joins AND (row_number() OVER (PARTITION BY doc_id, island, joins ORDER BY i) - 1) % 2 = 0 AS merges FROM g),
o AS (SELECT *, coalesce(lag(merges) OVER (PARTITION BY doc_id ORDER BY i), false) AS consumed FROM r),
mended AS MATERIALIZED (SELECT doc_id, string_agg(CASE WHEN merges THEN para || ' ' || nxt ELSE para END, chr(10) || chr(10) ORDER BY i) AS body
  FROM o WHERE NOT consumed GROUP BY doc_id)"""


@query("join_broken_paragraphs", f"WITH {S.LEGAL}, {paragraphs_sql('legal', 'body')} SELECT doc_id, body AS text FROM mended")
def join_broken_paragraphs(spark, sf):
    return W.legal(spark, sf).select("doc_id", T.join_broken_paragraphs(F.col("body")).alias("text"))


# RE2 has no look-behind: numerals after PARÁGRAFO are marked first, then restored
def formatted(expr: str) -> str:
    out = f"replace({expr}, '*', '')"
    for p, r in [
        (r"\(\s*\n+\s*([^(\n])", r"(\1"), (r"(P[AÁ]R[AÁ]GRAFO)\s*\n+\s*(\d+\.?)\s*", r"\1 \2 "),
        (r"([a-záéíóúüñA-ZÁÉÍÓÚÜÑ,;])\n([a-záéíóúüñ])", r"\1 \2"), (r"\n{3,}", "\n\n"),
        (r"((?i:PARÁGRAFO))\s+(\d+\.\s+[A-ZÁÉÍÓÚÜÑ])", r"\1@@\2"), (r"\s+(\d+\.\s+[A-ZÁÉÍÓÚÜÑ])", "\n" + r"\1"), ("@@", " "),
        (r"(?i)\s*(P[AÁ]R[AÁ]GRAFO\s*\d+\.?\s*)", "\n\n" + r"\1"), (r"\s*(\(Decreto\s+\d+\s+de\s+\d+[\s\S]*?\))", "\n\n" + r"\1"),
        (r"(?i)\s*(\(Par[aá]grafo\s+adicionado[\s\S]*?\))", "\n" + r"\1"), (r"\n{3,}", "\n\n"), (" +", " "),
    ]:
        out = S.sub(out, p, r)
    return S.strip(out)


RAW_ANSWER = r"""'**' || body || '**' || repeat(chr(10), 4) || 'PARÁGRAFO' || chr(10) || '2. texto (Decreto 17 de 2016,' || chr(10) || 'art. 1)  1. Uno'"""


@query("format_answer", f"WITH {S.PLAIN} SELECT doc_id, {formatted(RAW_ANSWER)} AS text FROM plain")
def format_answer(spark, sf):
    raw = F.concat(F.lit("**"), F.col("body"), F.lit("**\n\n\n\nPARÁGRAFO\n2. texto (Decreto 17 de 2016,\nart. 1)  1. Uno"))
    return W.plain(spark, sf).select("doc_id", T.format_answer(raw).alias("text"))


@query("strip_code_fence", f"""
WITH {S.REPLIES} SELECT doc_id, {S.strip(S.sub('reply', '```(?:json)?' + chr(92) + 's*', ''))} AS text FROM replies""")
def strip_code_fence(spark, sf):
    return W.judge_replies(spark, sf).select("doc_id", T.strip_code_fence(F.col("reply")).alias("text"))


@query("strip_front_matter", rf"""
SELECT doc_id, CASE WHEN starts_with(t, '---') AND position(chr(10) || '---' || chr(10) IN substring(t, 4)) > 0
  THEN {S.strip("substring(t, position(chr(10) || '---' || chr(10) IN substring(t, 4)) + 8)")} ELSE t END AS text
FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '---' || chr(10) || 'source_pdf: ' || source || chr(10) || '---' || chr(10) || chr(10) || text
  WHEN 1 THEN '--- sin cierre ' || text ELSE text END AS t FROM documents)""")
def strip_front_matter(spark, sf):
    kind, text = F.col("doc_id") % 3, F.col("text")
    raw = (F.when(kind == 0, F.concat(F.lit("---\nsource_pdf: "), F.col("source"), F.lit("\n---\n\n"), text))
           .when(kind == 1, F.concat(F.lit("--- sin cierre "), text)).otherwise(text))
    return W.documents(spark, sf).select("doc_id", T.strip_front_matter(raw).alias("text"))


@query("sanitize_name", """
SELECT page_id, regexp_replace(url, '[^0-9A-Za-zÀ-ÿ_-]', '_', 'g') AS name FROM pages""")
def sanitize_name(spark, sf):
    return W.table(spark, sf, "pages").select("page_id", T.sanitize_name(F.col("url")).alias("name"))


@query("path_parts", r"""
WITH p AS (SELECT page_id, string_split(url, '/')[-1] AS name FROM (SELECT page_id, url || '.HTML' AS url FROM pages))
SELECT page_id, name, regexp_replace(name, '^(.+)\.[^.]+$', '\1') AS stem, lower(regexp_extract(name, '^.+(\.[^.]+)$', 1)) AS suffix
FROM p""")
def path_parts_query(spark, sf):
    rows = W.table(spark, sf, "pages").select("page_id", F.concat("url", F.lit(".HTML")).alias("path"))
    return path_parts(rows).drop("path")


@query("truncate_context", """
SELECT doc_id, substring(text, 1, 180000) AS context, substring(text, 1, 1500) AS evidence, substring(text, 1, 500) AS preview
FROM documents""")
def truncate_context(spark, sf):
    cut = lambda n: F.substring("text", 1, n)
    return W.documents(spark, sf).select(
        "doc_id", cut(180_000).alias("context"), cut(1500).alias("evidence"), cut(500).alias("preview"))


@query("tokenize", f"""
SELECT doc_id, len({S.tokens('text')}) AS n_tokens, array_to_string({S.tokens('text')}, '|') AS tokens FROM documents""")
def tokenize(spark, sf):
    t = T.tokens(F.col("text"))
    return W.documents(spark, sf).select("doc_id", t.alias("t")).select(
        "doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.array_join("t", "|").alias("tokens"))


@query("content_hash", "SELECT doc_id, sha256(text) AS file_hash FROM documents")
def content_hash(spark, sf):
    return W.documents(spark, sf).select("doc_id", T.content_hash(F.col("text")).alias("file_hash"))


@query("scan_files")
def scan(spark, sf):
    """The given files by name, with a digest of what they hold."""
    return with_sha256(scan_files(spark, sf, "*.parquet"), sf, ".parquet").select("name", "length", "sha256")

"""The views of ``workload/views.py`` as SQL common table expressions."""

WS = "(' ' || chr(9) || chr(10) || chr(13))"
NL = "chr(10)"

LEGAL = r"""
legal AS (
  SELECT doc_id, source, array_to_string(list_transform(string_split(text, chr(10)), lambda x, j: CASE
    WHEN j = 1 THEN 'Resolución No. 0' || (doc_id + 1000) || ' de la Secretaría Distrital de Ambiente, 5 de marzo de '
      || (doc_id % 10 + 2010) || '. NIT: ' || (doc_id + 900000000) || '. ' || x
    WHEN (j - 1) % 4 = 1 THEN '## CONSIDERANDO' || chr(10) || chr(10) || x
    WHEN (j - 1) % 4 = 2 THEN '### ARTÍCULO 2.2.' || (doc_id % 5) || '.' || (j - 1) || '. ' || x
    WHEN (j - 1) % 4 = 3 THEN 'PARÁGRAFO 1. ' || x || ' 120,5 m³ ____'
    ELSE x END), chr(10) || chr(10)) AS body
  FROM documents)"""

PLAIN = LEGAL + r""",
plain AS (SELECT doc_id, source, regexp_replace(body, '#+ ', '', 'g') AS body FROM legal)"""

NOISY = PLAIN + r""",
noisy AS (
  SELECT doc_id, source, body || repeat(chr(10), 5) || '[Página 3]' || chr(10) || 'Decreto 1072 de 2015 Sector Trabajo ' || doc_id
    || ' EVA - Gestor Normativo' || chr(10) || 'departamento administrativo de la función pública' || chr(10) || '-----'
    || chr(10) || 'Diario Oficial No. 77  fin' AS body
  FROM plain)"""

DESCRIBED = LEGAL + r""",
described AS (
  SELECT doc_id, CASE doc_id % 4
    WHEN 0 THEN body
    WHEN 1 THEN 'CONTRATO de obra, cláusula primera. RESOLUCIÓN Nro ' || (doc_id + 100) || ' del 2019-0' || (doc_id % 9 + 1)
      || '-1' || (doc_id % 9) || ', CAR. NIT ' || (doc_id + 80000000) || '-7, localidad de Usme y otros. ' || body
    WHEN 2 THEN 'Solicitud de concesión de aguas subterráneas, pozo ' || doc_id || ', vereda El Salitre. N.I.T. '
      || (doc_id + 7000000) || '. Fecha 0' || (doc_id % 9 + 1) || '/12/2020. Tabla | a | b | ' || replace(body, ' de marzo de ', ' marzo ')
    ELSE 'Cargo de la SDA en el municipio de Chía, 1 de Enero de 2021, 120 m³ del pozo ' || doc_id || '. ' || body END AS body
  FROM legal)"""

PAGES = r"""
pages_view AS (
  SELECT doc_id, page_no, substring(text, (page_no - 1) * 1500 + 1, 1500) AS text
  FROM (SELECT doc_id, text, CAST(unnest(generate_series(1, greatest(CAST(ceil(n_chars / 1500.0) AS BIGINT), 1))) AS INTEGER) AS page_no
        FROM documents))"""

QUESTIONS = """
questions AS (SELECT item_id AS qid, text || ' artículo 2.2.4.' || (item_id % 12) AS question FROM benchmark)"""

PASSAGES = """
passages AS (SELECT doc_id, 'Artículo 2.2.4.' || (doc_id % 12) || '. ' || text AS content, lang, source, n_chars FROM documents)"""

ARTICLE_QUESTIONS = r"""
questions AS (
  SELECT item_id AS qid, '¿Qué dice el artículo 2.2.' || (item_id % 6) || '.' || (item_id % 11 * 4 + 2) || '?' AS question
  FROM benchmark)"""

VECTORS = r"""
qv AS (
  SELECT b.item_id AS qid, CAST(e.embedding AS DOUBLE[]) AS qvec, e.label FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id),
cv AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings)"""

CITABLE = PASSAGES + r""",
citable AS (
  SELECT doc_id, content, CASE WHEN lang = 'es' THEN '2.2.' || doc_id END AS article,
    CASE WHEN lang <> 'de' THEN n_chars // 1500 + 1 END AS page, source
  FROM passages)"""

LIBRARY = r"""
lib AS (
  SELECT doc_id, lang, source, text, sha256(text) AS file_hash,
    'in/' || source || '/doc ' || doc_id || '.pdf' AS path
  FROM documents),
manifest AS (
  SELECT file_hash, 'doc ' || min(doc_id) || '.pdf' AS name, 'doc_' || min(doc_id) || '.md' AS md_filename,
    strftime(DATE '2024-01-01' + CAST(min(doc_id) % 300 AS INTEGER), '%Y-%m-%d') AS processed_at,
    'docling' AS source_tool, CAST(max(length(text)) AS BIGINT) AS chars
  FROM lib WHERE lang = 'en' GROUP BY file_hash)"""

BLANKS = r"""
src AS (SELECT doc_id, lang, source, text FROM documents UNION ALL SELECT -1 - doc_id, lang, source, ' ' FROM documents WHERE doc_id % 10 = 3)"""

REPLIES = r"""
replies AS (
  SELECT doc_id, CASE WHEN doc_id % 7 = 3 THEN b WHEN doc_id % 3 = 0 THEN '```json' || chr(10) || b || '}' || chr(10) || '```'
    ELSE b || '}' END AS reply
  FROM (SELECT doc_id, '{"faithfulness": ' || (quality * 5) || ', "completeness": ' || (toxic * 3 + 1) || ', "citation_quality": '
    || (doc_id % 6) || ', "reasoning": "doc ' || doc_id || '"' AS b FROM labels))"""

ANALYSIS = r"""
analysis AS (
  SELECT doc_id, n_chars, CASE WHEN n_chars % 7 = 0 THEN b WHEN doc_id % 2 = 0 THEN '```json' || chr(10) || b || '}' || chr(10) || '```'
    ELSE b || '}' END AS reply
  FROM (SELECT doc_id, n_chars, '{"tipo_documento": "' || source || '", "tono_general": "' || lang || '", "nivel_urgencia": ' || (n_chars % 10)
    || ', "nivel_coercion": ' || (doc_id % 5) || ', "obligaciones_criticas": [{"texto": "o' || doc_id || '", "sujeto": "' || source
    || '", "plazo": "' || (n_chars % 30) || ' días", "consecuencia_incumplimiento": "multa", "nivel_criticidad": ' || (n_chars % 3)
    || '}, {"texto": "p' || doc_id || '", "nivel_criticidad": 1}], "temas_principales": ["' || lang
    || '"], "definiciones_clave": {"término": "' || source || '"}, "analisis_critico": "largo ' || n_chars || '"' AS b FROM documents))"""


def strip(expr: str) -> str:
    return f"trim({expr}, {WS})"


def sub(expr: str, pattern: str, repl: str) -> str:
    return f"regexp_replace({expr}, '{pattern}', '{repl}', 'g')"


def first(expr: str, *patterns: str, group: int = 1) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({expr}, '{p}', {group}), '')" for p in patterns) + ")"


def tokens(expr: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({expr}), '\s+'), lambda t: t <> '')"


def bm25(docs: str, text: str, k: int, questions: str = "questions") -> str:
    """CTEs ending in sparse(qid, id, score, rank), from questions(qid, question)."""
    return f"""
tk AS MATERIALIZED (SELECT doc_id AS id, {tokens(text)} AS toks FROM {docs}),
tf AS MATERIALIZED (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(toks) AS term FROM tk) GROUP BY ALL),
st AS MATERIALIZED (SELECT count(*) AS n, sum(len(toks)) / count(*) AS avgdl FROM tk),
df AS MATERIALIZED (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, st GROUP BY term),
fl AS MATERIALIZED (SELECT 0.25 * avg(raw) AS floor FROM df),
idf AS MATERIALIZED (SELECT term, df, CASE WHEN raw < 0 THEN floor ELSE raw END AS idf FROM df, fl),
qt AS MATERIALIZED (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({tokens('question')}) AS term FROM {questions}) GROUP BY ALL),
ln_ AS MATERIALIZED (SELECT id, len(toks) AS dl FROM tk),
score AS MATERIALIZED (
  SELECT qid, tf.id, round(sum(qtf * idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))), 6) AS score
  FROM qt JOIN tf USING (term) JOIN idf USING (term) JOIN ln_ ON ln_.id = tf.id, st GROUP BY qid, tf.id),
sparse AS MATERIALIZED (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM score WHERE score > 0
  QUALIFY rank <= {k})"""


def names_article(content: str, article: str) -> str:
    pattern = f"'(^|[^0-9.])' || replace({article}, '.', '[.]') || '($|[^0-9.]|[.]($|[^0-9]))'"
    return f"coalesce(regexp_matches({content}, {pattern}), false)"


def recursive_split(source: str, key: str, text: str, separators: list[str], size: int, overlap: int) -> str:
    """CTEs ending in rec(k, i, content): the chunks of every text of ``source`` in order.

    One cut per separator level; pieces under ``size`` stay in runs, others go on to the next level. A run's
    chunks follow from the bounds of its pieces, one recursion step per chunk.
    """
    quoted = lambda sep: " || ".join("chr(10)" if c == chr(10) else f"'{c}'" for c in sep)
    parts, last = [f"a0 AS (SELECT {key} AS k, []::BIGINT[] AS path, {text} AS t FROM {source} WHERE {text} IS NOT NULL)"], len(separators) - 1
    for n, sep in enumerate(separators):
        q = quoted(sep)
        parts.append(f"""
s{n} AS MATERIALIZED (SELECT k, path, j, CASE WHEN j = 1 THEN p[1] ELSE {q} || p[j] END AS piece
  FROM (SELECT k, path, p, unnest(generate_series(1, len(p))) AS j FROM (SELECT k, path, string_split(t, {q}) AS p FROM a{n} WHERE contains(t, {q})))
  WHERE j > 1 OR p[1] <> ''),
g{n} AS (SELECT *, length(piece) >= {size} AS big, sum(CAST(length(piece) >= {size} AS INT)) OVER (PARTITION BY k, path ORDER BY j) AS run FROM s{n}),
a{n + 1} AS (SELECT k, path, t FROM a{n} WHERE NOT contains(t, {q}){f' UNION ALL SELECT k, list_append(path, j), piece FROM g{n} WHERE big' if n < last else ''})""")
    runs = " UNION ALL ".join(
        f"SELECT k, list_append(path, min(j)) AS ord, string_agg(piece, '' ORDER BY j) AS t, list(length(piece) ORDER BY j) AS sizes FROM g{n} WHERE NOT big GROUP BY k, path, run"
        for n in range(last + 1))
    first_over = f"list_filter(bounds, lambda v: v > {{0}} + {size})[1]"
    end = "CASE WHEN {0} IS NULL THEN bounds[-1] ELSE list_filter(bounds, lambda v: v < {0})[-1] END"
    parts.append(f"""
runs AS MATERIALIZED (SELECT *, row_number() OVER () AS rid, list_prepend(0, list_transform(sizes, lambda s, i: list_sum(sizes[1:i])))::BIGINT[] AS bounds FROM ({runs})),
fill(rid, n, b, x, e) AS (
  SELECT rid, 0, 0::BIGINT, x, {end.format('x')} FROM (SELECT rid, bounds, {first_over.format('0')} AS x FROM runs)
  UNION ALL
  SELECT rid, n, b, x, {end.format('x')} FROM (SELECT rid, n, b, bounds, {first_over.format('b')} AS x FROM (
    SELECT f.rid, n + 1 AS n, r.bounds, list_filter(r.bounds, lambda v: v >= f.b AND f.e - v <= {overlap} AND (f.x - v <= {size} OR v >= f.e))[1] AS b
    FROM fill f JOIN runs r ON r.rid = f.rid WHERE f.x IS NOT NULL))),
found AS (
  SELECT k, ord, n, {strip('substring(t, b + 1, e - b)')} AS content FROM fill JOIN runs USING (rid)
  UNION ALL SELECT k, list_append(path, j), 0, piece FROM g{last} WHERE big
  UNION ALL SELECT k, path, 0, CASE WHEN length(t) >= {size} THEN t ELSE {strip('t')} END FROM a{last + 1}),
rec AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY ord, n) - 1 AS i, content FROM found WHERE content <> '')""")
    return ",".join(parts)

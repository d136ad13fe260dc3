"""Queries on Markdown, HTML and CSV structure, tables and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from docframe.functions import text as X
from docframe.operators import markdown as M
from docframe.operators import words as W
from docframe.plans import derived as D
from docframe.plans.registry import Register, over, rows

register = Register()

#: The shapes that the lines of a text are given in turn, so that every document becomes a Markdown document (% is the line's beginning).
_SHAPES = ("# %", "", "## %", "Intro %", "more %", "| a | % |", "| --- | --- |", "| 1 | % |", "### %", "1. %", "2) %", "- %", "* %", "| % | y |", "", "## Part %", "```", "code | %", "```", "__%__", "tail %")
_MD = "(SELECT doc_id, line_pos + 1 AS line_no, replace(list_extract([" + ", ".join(f"'{x}'" for x in _SHAPES) + f"], CAST((line_pos + doc_id) % {len(_SHAPES)} AS INT) + 1), '%', regexp_replace(left(line, 12), '[^A-Za-z0-9 ]', '', 'g')) AS line FROM {D.LINES})"


def _md(spark, sf_dir):
    begin = F.regexp_replace(F.left("line", F.lit(12)), "[^A-Za-z0-9 ]", "")
    shape = F.element_at(F.array(*map(F.lit, _SHAPES)), ((F.col("line_pos") + F.col("doc_id")) % len(_SHAPES)).cast("int") + 1)
    lines = D.lines(D.table(spark, sf_dir, "documents"))
    return lines.select("doc_id", (F.col("line_pos") + 1).alias("line_no"), F.replace(shape, F.lit("%"), begin).alias("line"))


@register(r"SELECT doc_id, line_no, CASE WHEN starts_with(line, '### ') THEN 3 ELSE 2 END AS level, trim(regexp_extract(line, '^#{2,3}\s+(.+)$', 1)) AS title FROM " + _MD + r" WHERE regexp_matches(line, '^#{2,3}\s+.+$')")
def md_headings(spark, sf_dir):
    return M.headings(_md(spark, sf_dir)).select("doc_id", "line_no", "level", "title")


@register(
    rf"""WITH m AS (SELECT *, trim(nullif(regexp_extract(line, '^##\s+(.+)$', 1), '')) AS x2, trim(nullif(regexp_extract(line, '^###\s+(.+)$', 1), '')) AS x3, starts_with(trim(line), '|') AND ends_with(trim(line), '|') AS is_table FROM {_MD}),
    a AS (SELECT *, last_value(x2 IGNORE NULLS) OVER w AS h2, sum(CASE WHEN x2 IS NOT NULL THEN 1 ELSE 0 END) OVER w AS part FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
    b AS (SELECT *, last_value(x3 IGNORE NULLS) OVER (PARTITION BY doc_id, part ORDER BY line_no) AS h3 FROM a),
    c AS (SELECT *, lead(line_no) OVER w IS NULL AS is_last, lead(h2) OVER w AS n2, lead(h3) OVER w AS n3 FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
    d AS (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM c WHERE is_table)
    SELECT doc_id, min(line_no) AS start_line, max(line_no) AS end_line, count(*) AS rows, arg_max(CASE WHEN is_last THEN h2 ELSE n2 END, line_no) AS h2, max(CASE WHEN line_no = e THEN CASE WHEN is_last THEN h3 ELSE n3 END END) AS h3
    FROM (SELECT *, max(line_no) OVER (PARTITION BY doc_id, island) AS e FROM d) GROUP BY doc_id, island"""
)
def md_table_blocks(spark, sf_dir):
    return M.table_blocks(_md(spark, sf_dir))


_KIND = r"""CASE WHEN starts_with(s, '|') THEN CASE WHEN contains(s, '---') THEN 'table_separator' ELSE 'table' END WHEN s = '' THEN 'blank' WHEN starts_with(s, '# ') THEN 'heading1' WHEN starts_with(s, '## ') THEN 'heading2' WHEN starts_with(s, '### ') THEN 'heading3'
 WHEN regexp_matches(s, '^\d+[.)]\s+') THEN 'ordered_item' WHEN starts_with(s, '- ') OR starts_with(s, '* ') THEN 'bullet_item' ELSE 'paragraph' END"""
_STRIPPED = rf"(SELECT doc_id, line_no, line, trim(regexp_replace(rtrim(line), '^_+|_+$', '', 'g')) AS s FROM {_MD})"


@register(f"SELECT doc_id, line_no, {_KIND} AS kind FROM {_STRIPPED}")
def md_line_kinds(spark, sf_dir):
    return _md(spark, sf_dir).select("doc_id", "line_no", M.line_kinds(F.col("line")).alias("kind"))


@register(
    f"""WITH k AS (SELECT doc_id, line_no, line, {_KIND} AS raw, CASE WHEN {_KIND} = 'table_separator' THEN 'table' ELSE {_KIND} END AS kind FROM {_STRIPPED}),
    n AS (SELECT *, CASE WHEN kind IN ('paragraph', 'table') AND lag(kind) OVER (PARTITION BY doc_id ORDER BY line_no) = kind THEN 0 ELSE 1 END AS fresh FROM k),
    b AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY line_no) AS block FROM n)
    SELECT doc_id, block::BIGINT AS block, min(kind) AS kind, string_agg(trim(line), '/' ORDER BY line_no) AS content FROM b WHERE kind <> 'blank' AND raw <> 'table_separator' GROUP BY doc_id, block"""
)
def md_blocks(spark, sf_dir):
    return M.blocks(_md(spark, sf_dir)).select("doc_id", "block", "kind", F.array_join("lines", "/").alias("content"))


@register(rf"""SELECT doc_id, slide, count(*) AS n FROM (SELECT *, sum(CASE WHEN regexp_matches(line, '^#{{1,3}}\s') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no)::BIGINT AS slide FROM {_MD}) WHERE trim(line) <> '' AND NOT starts_with(trim(line), '|') GROUP BY ALL""")
def md_slides(spark, sf_dir):
    return M.slides(_md(spark, sf_dir)).groupBy("doc_id", "slide").agg(F.count("*").alias("n"))


@register(f"SELECT doc_id, line_no, n % 2 = 1 AS is_code FROM (SELECT *, sum(CASE WHEN starts_with(trim(line), '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS n FROM {_MD}) WHERE NOT starts_with(trim(line), '```')")
def md_code_lines(spark, sf_dir):
    return M.fenced(_md(spark, sf_dir)).select("doc_id", "line_no", "is_code")


@register("SELECT doc_id, replace(replace(replace(text, '|', chr(92) || '|'), chr(13), ' '), chr(10), '<br>') AS exported, replace(trim(replace(replace(text, chr(13), ' '), chr(10), ' ')), '|', chr(92) || '|') AS extracted FROM documents")
def md_escape(spark, sf_dir):
    return D.table(spark, sf_dir, "documents").select("doc_id", X.escape_cell_breaks("text").alias("exported"), X.escape_cell_plain("text").alias("extracted"))


@register(r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '\*\*(.*?)\*\*', '\1', 'g'), '\*(.*?)\*', '\1', 'g'), '`(.*?)`', '\1', 'g')) AS cell FROM documents")
def md_clean_cell(spark, sf_dir):
    return D.table(spark, sf_dir, "documents").select("doc_id", X.clean_markdown_cell("text").alias("cell"))


@register(r"SELECT doc_id, regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM documents")
def md_normalize(spark, sf_dir):
    return D.table(spark, sf_dir, "documents").select("doc_id", X.normalize_markdown("text").alias("text"))


_CSV = over("(VALUES (1, 'a,b,c\n1,2\n\n x|y ,z'), (2, ''), (3, 'one')) t(id, text)")


@register(
    f"""WITH r AS (SELECT id, list_transform(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> ''), lambda l: string_split(l, ',')) AS rows FROM {_CSV}),
    w AS (SELECT id, rows, list_max(list_transform(rows, lambda x: len(x))) AS n FROM r),
    l AS (SELECT id, n, list_transform(rows, lambda x: '| ' || array_to_string(list_transform(list_resize(x, n, ''), lambda c: replace(trim(c), '|', chr(92) || '|')), ' | ') || ' |') AS lines FROM w)
    SELECT id, CASE WHEN len(lines) > 0 THEN array_to_string(list_concat([lines[1]], list_concat(['| ' || array_to_string(list_resize(['---'], n, '---'), ' | ') || ' |'], lines[2:])), chr(10)) ELSE '' END AS md FROM l"""
)
def csv_to_md(spark, sf_dir):
    return rows(spark, _CSV, sf_dir).select("id", M.csv_table(F.col("text")).alias("md"))


@register(r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
def html_to_text(spark, sf_dir):
    return D.table(spark, sf_dir, "pages").select("page_id", X.html_to_text("html").alias("text"))


@register("SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;') AS escaped FROM pages")
def html_escape(spark, sf_dir):
    return D.table(spark, sf_dir, "pages").select("page_id", X.escape_html("html").alias("escaped"))


# Every line's words dealt to four columns: short lines leave gaps, and of words in one place the last counts.
_CELLS = f"(SELECT doc_id AS table_id, line_pos AS row, word_pos % 4 AS col, word_pos AS cell_no, text FROM {D.WORDS})"


@register(
    f"""WITH c AS (SELECT table_id, row, col, arg_max(text, cell_no) AS text FROM {_CELLS} GROUP BY ALL), s AS (SELECT table_id, max(row) AS r, max(col) AS c FROM {_CELLS} GROUP BY table_id),
    g AS (SELECT table_id, row, unnest(range(0, (c + 1)::BIGINT)) AS col FROM (SELECT table_id, c, unnest(range(0, (r + 1)::BIGINT)) AS row FROM s))
    SELECT table_id, row, string_agg(coalesce(text, ''), '|' ORDER BY col) AS texts FROM g LEFT JOIN c USING (table_id, row, col) GROUP BY ALL"""
)
def table_matrix(spark, sf_dir):
    w = D.words(D.table(spark, sf_dir, "documents"))
    cells = w.select(F.col("doc_id").alias("table_id"), F.col("line_pos").alias("row"), (F.col("word_pos") % 4).alias("col"), F.col("word_pos").alias("cell_no"), "text")
    return W.matrix(cells).select("table_id", F.col("row").cast("long").alias("row"), F.array_join("texts", "|").alias("texts"))


@register("SELECT doc_id, '# Document ' || doc_id || chr(10) || chr(10) || '> ' || source || chr(10) || chr(10) || '## Page 1' || chr(10) || chr(10) || regexp_replace(text, '^\\s+|\\s+$', '', 'g') || chr(10) AS markdown FROM documents")
def export_markdown(spark, sf_dir):
    from docframe.sources import exports as E

    docs = D.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), F.col("source").alias("engine"), F.array(F.col("text")).alias("pages"))
    return E.markdown(docs).select("doc_id", "markdown")


@register(
    f"""SELECT doc_id, round(avg(CASE WHEN confidence >= 0 THEN confidence END), 4) AS mean_confidence, count(*) AS words,
    count(*) FILTER (WHERE confidence < 0.7) AS weak, sum(length(text))::BIGINT AS chars FROM {D.WORDS} GROUP BY doc_id"""
)
def audit_rows(spark, sf_dir):
    w = D.words(D.table(spark, sf_dir, "documents"))
    return w.groupBy("doc_id").agg(X.rounded(F.avg(F.when(F.col("confidence") >= 0, F.col("confidence"))), 4).alias("mean_confidence"), F.count("*").alias("words"), F.count_if(F.col("confidence") < 0.7).alias("weak"), F.sum(F.length("text")).alias("chars"))


QUERIES, ORACLES = register.queries, register.oracles

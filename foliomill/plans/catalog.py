"""The registered queries over the driver's tables, and the same in SQL.

A book is a source of `documents`, a page one document, an element a line of its text, and a heading a line of 1 to 39 characters. Its level is
1 plus the length modulo 3.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import encoding
from ..functions import text as T
from ..operators import candidates, matching, metrics, references, reports, scan, segmentation, trees
from ..runtime import importable, shared_folder
from ..sources import layout_xml, outlines, pdf, segments, spreadsheets, workbook_source
from ..streaming import batching

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("source").alias("book"), F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("seq", "text"))


def as_layout(rows: DataFrame) -> DataFrame:
    """Lines as positioned elements: one on each line of the page."""
    return rows.select("book", "page", "seq", F.col("seq").alias("top"), F.col("text").alias("text_head"), F.col("text").alias("text_inline"))


def is_heading(text: Column) -> Column:
    return F.length(text).between(1, 39)


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headings with their number in the book: that of the first of a page comes from a scan over the pages' counts, so no window sees the lines of a book."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    pages = table(spark, sf_dir, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("page"), F.filter(lines, lambda x: is_heading(x["x"])).alias("found"))
    pages = scan.scanned(pages, ("book",), ("page",), sums={"before": F.coalesce(F.size("found"), F.lit(0))})
    rows = pages.select("book", "page", "before", F.posexplode("found").alias("at", "one"))
    return rows.select("book", "page", (F.col("before") + F.col("at")).cast("int").alias("seq"), (F.length("one.x") % 3 + 1).alias("level"), F.col("one.x").alias("heading"))


def pages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("page"))


def big(*names: str) -> list:
    return [F.col(n).cast("bigint").alias(n) for n in names]


OUTER, NOT_WORD = T.OUTER, T.NOT_WORD
EL = "el AS (SELECT book, page, i - 1 AS seq, l[i] AS text FROM (SELECT book, page, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT source AS book, doc_id AS page, string_split(text, chr(10)) AS l FROM documents)))"
HD = EL + ", hd AS (SELECT book, page, row_number() OVER (PARTITION BY book ORDER BY page, seq) - 1 AS seq, length(text) % 3 + 1 AS level, text AS heading FROM el WHERE length(text) BETWEEN 1 AND 39)"


def sql_trimmed(x: str) -> str:
    return f"regexp_replace({x}, '{OUTER}', '', 'g')"


def sql_exact(x: str) -> str:
    return f"replace(lower({sql_trimmed(x)}), ' ', '')"


def sql_loose(x: str) -> str:
    return f"lower({sql_trimmed(f"regexp_replace({x}, '{NOT_WORD}', '', 'g')")})"


def sql_clean(x: str) -> str:
    return f"translate(trim({x}, chr(13) || chr(10)), '/“”’)(\"''', '')"


def sql_match(t: str, h: str) -> str:
    return f"({t}_e = {h}_e OR contains({t}_l, {h}_l) OR (length({t}_l) > 0 AND contains({h}_l, {t}_l)))"


# ---- scalar functions -------------------------------------------------------------------------------------------


@query(f"WITH {EL} SELECT book, page, CAST(seq AS BIGINT) AS seq, text FROM el WHERE text <> ''")
def elements_scan(spark, sf_dir):
    return elements(spark, sf_dir).where("text <> ''").select("book", "page", *big("seq"), "text")


@query(r"SELECT doc_id, regexp_replace(text, '\p{C}', '', 'g') AS stripped FROM documents")
def control_char_strip(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.strip_control("text").alias("stripped"))


@query(f"WITH {EL} SELECT page, CAST(seq AS BIGINT) AS seq, trim(trim(trim(text, '\"'), chr(13) || chr(10)), ' ') AS trimmed, {sql_clean('text')} AS cleaned FROM el")
def heading_clean(spark, sf_dir):
    return elements(spark, sf_dir).select("page", *big("seq"), T.trim_chain("text").alias("trimmed"), T.heading_clean("text").alias("cleaned"))


@query(f"WITH {EL} SELECT page, CAST(seq AS BIGINT) AS seq, {sql_exact('text')} AS match_key FROM el")
def match_key_exact(spark, sf_dir):
    return elements(spark, sf_dir).select("page", *big("seq"), T.key_exact("text").alias("match_key"))


@query(f"WITH {EL} SELECT page, CAST(seq AS BIGINT) AS seq, {sql_loose('text')} AS match_key FROM el")
def match_key_loose(spark, sf_dir):
    return elements(spark, sf_dir).select("page", *big("seq"), T.key_loose("text").alias("match_key"))


@query("SELECT page_id, TRY_CAST(regexp_extract(url, '/([^/]*)$', 1) AS INTEGER) AS page FROM pages")
def safe_page_cast(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.safe_int(F.regexp_extract("url", "/([^/]*)$", 1)).alias("page"))


@query(f"SELECT doc_id, CAST(CASE WHEN length(t) = 0 THEN 0 ELSE len(string_split_regex(t, '[\\s{T.WIDE}]+')) END AS BIGINT) AS tokens FROM (SELECT doc_id, {sql_trimmed('text')} AS t FROM documents)")
def token_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.token_count("text").cast("bigint").alias("tokens"))


@query("SELECT doc_id, regexp_replace(regexp_replace(source, '[0-9]+$', ''), '_+$', '') AS slug, trim(source || '_fdp.pdf', '.pdf') AS quirk FROM documents")
def slug_forms(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.slug_trimmed("source").alias("slug"), T.slug_with_tool_quirk(F.concat("source", F.lit("_fdp.pdf"))).alias("quirk"))


# ---- outline files ----------------------------------------------------------------------------------------------


@query(f"WITH {HD}, ln AS (SELECT book, seq, string_split(level || ',' || heading || ',' || page, ',') AS f FROM hd) SELECT book, CAST(seq AS BIGINT) AS seq, TRY_CAST(f[1] AS INTEGER) AS level, {sql_clean('f[2]')} AS heading_naive FROM ln")
def outline_parse_naive(spark, sf_dir):
    line = headings(spark, sf_dir).select("book", "seq", F.split(F.concat_ws(",", "level", "heading", "page"), ",").alias("f"))
    return line.select("book", *big("seq"), T.safe_int(F.get("f", F.lit(0))).alias("level"), T.heading_clean(F.get("f", F.lit(1))).alias("heading_naive"))


def _parsed(rows: DataFrame) -> DataFrame:
    """Lines are written with quotes where needed and parsed again; a fourth field rejects a line."""
    lines = outlines.entry_lines(rows)
    found = lines.select("book", "seq", F.from_csv("line", F.lit("level string, heading string, page string, more string"), {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}).alias("f"))
    return found.where("f.page is not null and f.more is null").select("book", *big("seq"), T.safe_int("f.level").alias("level"), "f.heading", T.safe_int("f.page").alias("page"))


@query(f"WITH {HD} SELECT book, CAST(seq AS BIGINT) AS seq, CAST(level AS INTEGER) AS level, heading, CAST(page AS INTEGER) AS page FROM hd")
def outline_parse_strict_all(spark, sf_dir):
    return _parsed(headings(spark, sf_dir))


# the lines of an outline file, as they are written
FILE_LINES = HD + ", fl AS (SELECT book, seq, level || ',' || CASE WHEN regexp_matches(heading, '[,\"\\r\\n]') THEN '\"' || replace(heading, '\"', '\"\"') || '\"' ELSE heading END || ',' || page AS line FROM hd)"


@query(f"WITH {HD} SELECT book, CAST(seq AS BIGINT) AS seq, CAST(level AS INTEGER) AS level, regexp_replace(heading, '\\\\(.)', '\\1', 'g') AS heading, CAST(page AS INTEGER) AS page FROM hd")
def outline_files_strict(spark, sf_dir):
    """All headings written as outline files into the shared folder and read again by the strict reader."""
    folder = shared_folder(spark, "outlines")
    outlines.write_outline_csv(headings(spark, sf_dir), folder)
    good, _ = outlines.read_strict(spark, folder, "gt")
    return good.select("book", *big("seq"), "level", "heading", "page")


@query(f"WITH {FILE_LINES} SELECT book, CAST(seq AS BIGINT) AS seq, TRY_CAST(string_split(line, ',')[1] AS INTEGER) AS level, {sql_clean("string_split(line, ',')[2]")} AS heading_naive FROM fl")
def outline_files_naive(spark, sf_dir):
    """The same files, read by the naive reader."""
    folder = shared_folder(spark, "outlines")
    outlines.write_outline_csv(headings(spark, sf_dir), folder)
    return outlines.read_naive(spark, folder, "gt").select("book", *big("seq"), "level", "heading_naive")


@query(
    f"WITH {HD} SELECT book, CAST(seq AS BIGINT) AS seq, CAST(level AS INTEGER) AS level, regexp_replace(heading, '\\\\(.)', '\\1', 'g') AS heading, CAST(page AS INTEGER) AS page FROM hd "
    "WHERE book IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)"
)
def outlines_of_toxic_books(spark, sf_dir):
    """All headings as outline files; read are those of the books with a text that is labelled toxic, and no other file is opened."""
    folder = shared_folder(spark, "outlines")
    outlines.write_outline_csv(headings(spark, sf_dir), folder)
    good, _ = outlines.read_shelf(spark, folder, "gt")
    asked = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", "left_semi").select(F.col("source").alias("book")).distinct()
    return good.join(asked, "book", "left_semi").select("book", *big("seq"), "level", "heading", "page")


def _validated(rows: DataFrame) -> DataFrame:
    """Every third page number is spelt wrongly, so its row has no page and isn't valid. A quote is doubled."""
    page = F.when(F.col("page") % 3 == 0, F.concat(F.lit("p"), F.col("page").cast("string"))).otherwise(F.col("page").cast("string"))
    raw = rows.select("book", "seq", F.format_string('"%d","%s","%s"', "level", F.replace("heading", F.lit('"'), F.lit('""')), page).alias("raw"))
    good, _ = candidates.parsed_response(raw)
    return candidates.valid(good).select("book", *big("seq"), "level", "heading", "page")


@query(f"WITH {HD} SELECT book, CAST(seq AS BIGINT) AS seq, CAST(level AS VARCHAR) AS level, heading, CAST(page AS INTEGER) AS page FROM hd WHERE page % 3 > 0")
def response_validate_all(spark, sf_dir):
    return _validated(headings(spark, sf_dir))


@query(f"WITH {HD} SELECT book, heading, page, CAST(min(seq) AS BIGINT) AS seq FROM hd GROUP BY book, heading, page")
def candidate_dedup(spark, sf_dir):
    return candidates.unique_candidates(headings(spark, sf_dir)).select("book", "heading", "page", *big("seq"))


def _encoded(batches):
    """Texts as bytes in one encoding after another by id, in UTF-8 where it has no place for a character."""
    for batch in batches:
        out = []
        for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data = text.encode("utf-8")
            with contextlib.suppress(UnicodeEncodeError):
                data = text.encode(encoding.ENCODINGS[k % len(encoding.ENCODINGS)])
            out.append(data)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "content"])


@query("SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE text IS NOT NULL")
def detected_encodings(spark, sf_dir):
    """Documents written in six encodings without marks come back by what their bytes say."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").where("text is not null and doc_id is not null")
    models = outlines.learned_encodings(docs)
    importable(spark)
    raw = docs.mapInArrow(_encoded, "doc_id bigint, content binary")
    return outlines.decoded(raw, models).select("doc_id", F.md5("text").alias("text_md5"))


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def book_semi_join(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_semi").select("doc_id", "source")


@query("SELECT doc_id AS book FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AND NOT EXISTS (SELECT 1 FROM pages p WHERE p.page_id = d.doc_id)")
def pending_books(spark, sf_dir):
    books = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book"))
    done, failed = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("book")), table(spark, sf_dir, "pages").select(F.col("page_id").alias("book"))
    return outlines.pending(books, done, failed)


@query(f"WITH {EL} SELECT book, page, CAST(seq AS BIGINT) AS seq, {sql_trimmed('text')} AS text_full, seq % 4 = 0 AS bold, CASE WHEN seq % 4 = 0 THEN {sql_trimmed('text')} ELSE '' END AS text_inline FROM el")
def xml_elements(spark, sf_dir):
    """Documents as positioned-text XML, every fourth line bold, parsed again."""
    line = F.replace(F.replace(F.replace(F.col("x"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    rows = elements(spark, sf_dir).withColumn("x", F.col("text")).withColumn("x", line)
    body = F.when(F.col("seq") % 4 == 0, F.concat(F.lit("<b>"), "x", F.lit("</b>"))).otherwise(F.col("x"))
    one = F.concat(F.lit('<text top="'), F.col("seq").cast("string"), F.lit('" left="0" font="f">'), body, F.lit("</text>"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", one.alias("t")))), lambda p: p["t"])
    files = rows.groupBy("book", "page").agg(F.concat(F.lit('<pdf2xml><page number="1"><fontspec id="f" size="9"/>'), F.array_join(parts, ""), F.lit("</page></pdf2xml>")).alias("content"))
    found = layout_xml.elements(files.select(F.concat_ws("\t", "book", "page").alias("book"), "content"))
    key = F.split("book", "\t")
    return found.select(key[0].alias("book"), key[1].cast("bigint").alias("page"), *big("seq"), "text_full", "bold", "text_inline")


# ---- candidates -------------------------------------------------------------------------------------------------

TAGS = "tg AS (SELECT book, page_id * 1000000 + i AS seq, t[i] AS tag FROM (SELECT book, page_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS book, page_id, regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1) AS t FROM pages)))"
HIST = TAGS + ", hi AS (SELECT book, tag, count(*) AS n, row_number() OVER (PARTITION BY book ORDER BY count(*) DESC, min(seq)) AS rank FROM tg GROUP BY book, tag)"


def tags(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1))
    rows = pages.select(F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("book"), "page_id", F.posexplode(found).alias("i", "tag"))
    return rows.select("book", (F.col("page_id") * 1_000_000 + F.col("i") + 1).alias("seq"), "tag")


@query(f"WITH {HIST} SELECT book, tag, CAST(n AS BIGINT) AS n, CAST(rank AS BIGINT) AS rank FROM hi")
def tag_histogram(spark, sf_dir):
    return candidates.histogram(tags(spark, sf_dir), "tag").select("book", "tag", *big("n", "rank"))


@query(f"WITH {HIST} SELECT book, tag, CAST(n AS BIGINT) AS n FROM hi a WHERE n > 0.5 * (SELECT max(n) FROM hi b WHERE b.book = a.book)")
def baseline_tags(spark, sf_dir):
    return candidates.baseline(candidates.histogram(tags(spark, sf_dir), "tag")).select("book", "tag", *big("n"))


@query(f"WITH {EL} SELECT book, page, CAST(seq AS BIGINT) AS seq, text FROM (SELECT *, count(*) OVER (PARTITION BY book, text) AS n FROM el) WHERE n <= 2")
def rare_candidates(spark, sf_dir):
    return candidates.rare(elements(spark, sf_dir), "text", 2).select("book", "page", *big("seq"), "text")


@query("SELECT conv_id AS book, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS BIGINT) AS recency FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS r FROM conversations) WHERE r = 1")
def last_per_level(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "book")
    return candidates.last_per_level(rows, "role", "turn").select("book", "turn", "role", *big("recency"))


LIMIT = 120


@query(
    f"""WITH RECURSIVE c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, turn,
  CASE WHEN length(t) = 0 THEN 0 ELSE len(string_split_regex(t, '[\\s{T.WIDE}]+')) END AS n FROM (SELECT conv_id, turn, {sql_trimmed('text')} AS t FROM conversations)),
r AS (SELECT conv_id, k, turn, n AS used, CASE WHEN n > {LIMIT} THEN 1 ELSE 0 END AS batch FROM c WHERE k = 1
  UNION ALL SELECT c.conv_id, c.k, c.turn, CASE WHEN r.used + c.n > {LIMIT} THEN c.n ELSE r.used + c.n END, r.batch + CASE WHEN r.used + c.n > {LIMIT} THEN 1 ELSE 0 END
  FROM r JOIN c ON c.conv_id = r.conv_id AND c.k = r.k + 1)
SELECT conv_id, turn, CAST(batch AS BIGINT) AS batch FROM r"""
)
def token_batches(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("n", T.token_count("text"))
    lists = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "n"))).alias("items"))
    importable(spark)
    numbered = lists.withColumn("batch", candidates.batch_numbers(F.transform("items", lambda x: x["n"]), LIMIT))
    return numbered.select("conv_id", F.explode(F.arrays_zip("items", "batch")).alias("z")).select("conv_id", "z.items.turn", F.col("z.batch").cast("bigint").alias("batch"))


BATCHED = f"""c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, turn, role, text,
  CASE WHEN length(t) = 0 THEN 0 ELSE len(string_split_regex(t, '[\\s{T.WIDE}]+')) END AS n FROM (SELECT *, {sql_trimmed('text')} AS t FROM conversations)),
r AS (SELECT conv_id, k, turn, n AS used, CASE WHEN n > {LIMIT} THEN 1 ELSE 0 END AS batch FROM c WHERE k = 1
  UNION ALL SELECT c.conv_id, c.k, c.turn, CASE WHEN r.used + c.n > {LIMIT} THEN c.n ELSE r.used + c.n END, r.batch + CASE WHEN r.used + c.n > {LIMIT} THEN 1 ELSE 0 END
  FROM r JOIN c ON c.conv_id = r.conv_id AND c.k = r.k + 1)"""


@query(
    f"""WITH RECURSIVE {BATCHED}, f AS (SELECT conv_id, batch, min(turn) AS first FROM r GROUP BY conv_id, batch)
SELECT r.conv_id AS book, r.turn AS seq, CAST(r.batch AS BIGINT) AS batch, CAST((SELECT count(DISTINCT role) FROM c WHERE c.conv_id = r.conv_id AND c.turn < f.first) AS BIGINT) AS context_levels
FROM r JOIN f ON f.conv_id = r.conv_id AND f.batch = r.batch"""
)
def token_batch_stream(spark, sf_dir):
    """token_batches as a stream with state: a conversation's role is the level, and a batch has as context the roles that spoke before it was opened."""
    kinds = table(spark, sf_dir, "conversations").schema
    path = f"{sf_dir}/conversations.parque[t]"  # a pattern may name a file or a folder, a plain path only a folder
    rows = spark.readStream.schema(kinds).parquet(path).select(F.col("conv_id").alias("book"), F.col("turn").cast("bigint").alias("seq"), F.col("role").alias("level"), T.token_count("text").cast("bigint").alias("tokens"))
    found = batching.collected(batching.token_batches(rows, LIMIT), shared_folder(spark, "stream"))
    return found.select("book", "seq", *big("batch", "context_levels"))


# of the turns a response's line has the first words as heading; every fifth conversation has no response
@query(
    f"""WITH RECURSIVE {BATCHED}, l AS (SELECT r.conv_id AS book, r.batch, row_number() OVER (PARTITION BY r.conv_id, r.batch ORDER BY r.turn) - 1 AS line_no, role AS level, left(regexp_replace(text, '[\\s"]+', ' ', 'g'), 30) AS heading, CAST(r.turn AS INTEGER) AS page
  FROM r JOIN c USING (conv_id, k) WHERE r.conv_id % 5 > 0)
SELECT book, CAST(batch AS BIGINT) AS batch, CAST(line_no AS BIGINT) AS line_no, level, heading, page FROM l"""
)
def replayed_responses(spark, sf_dir):
    """Stored responses to the batches of each conversation, joined to them and parsed."""
    turns = token_batches(spark, sf_dir).join(table(spark, sf_dir, "conversations"), ["conv_id", "turn"])
    heading = F.substring(F.regexp_replace("text", '[\\s"]+', " "), 1, 30)
    line = F.format_string('"%s","%s","%d"', "role", heading, "turn")
    stored = turns.where("conv_id % 5 > 0").groupBy(F.col("conv_id").alias("book"), "batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("raw"))
    good, _ = candidates.replayed(turns.select(F.col("conv_id").alias("book"), "batch"), stored)
    return good.select("book", "batch", *big("line_no"), "level", "heading", "page")


# ---- matching and segmentation ---------------------------------------------------------------------------------


@query(f"SELECT conv_id AS book, role AS top, CAST(min(turn) AS BIGINT) AS line, {sql_trimmed("coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (text <> ''), '')")} AS text FROM conversations GROUP BY conv_id, role")
def line_combine(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book"), F.lit(0).alias("page"), F.col("turn").alias("seq"), F.col("role").alias("top"), F.col("text").alias("text_inline"))
    return segmentation.lines(rows).select("book", "top", *big("line"), "text")


def _between(tag: str) -> str:
    return f"(?s)<{tag}>(.*?)<"


@query(
    "WITH p AS (SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)<', 1) AS t, regexp_extract(html, '(?s)<h1>(.*?)<', 1) AS h, regexp_extract(html, '(?s)<b>(.*?)<', 1) AS b FROM pages) "
    f"SELECT page_id, {sql_exact('t')} = {sql_exact('h')} AS title_is_h1, {sql_exact('t')} = {sql_exact('b')} AS title_is_bold FROM p"
)
def title_h1_exact_match(spark, sf_dir):
    title, h1, bold = (F.regexp_extract("html", _between(t), 1) for t in ("title", "h1", "b"))
    return table(spark, sf_dir, "pages").select("page_id", T.matches_exact(title, h1).alias("title_is_h1"), T.matches_exact(title, bold).alias("title_is_bold"))


@query(f"SELECT doc_id, item_id FROM (SELECT doc_id, {sql_loose('text')} AS d FROM documents) JOIN (SELECT item_id, {sql_loose('text')} AS h FROM benchmark) ON contains(d, h)")
def heading_contains_match(spark, sf_dir):
    """Items that a document contains, by their loose keys."""
    items = table(spark, sf_dir, "benchmark").select("item_id", T.key_loose("text").alias("key"))
    docs = table(spark, sf_dir, "documents").select("doc_id", T.key_loose("text").alias("text"))
    return matching.containing(docs, items, "doc_id", "item_id")


KEYS = HD + f", ek AS (SELECT book, page, seq AS el, text, {sql_exact('text')} AS t_e, {sql_loose('text')} AS t_l FROM el), hk AS (SELECT *, {sql_exact('heading')} AS h_e, {sql_loose('heading')} AS h_l FROM hd)"
HITS = KEYS + f", ht AS (SELECT hk.book, hk.seq, min(el) AS hit FROM hk JOIN ek USING (book, page) WHERE {sql_match('t', 'h')} GROUP BY hk.book, hk.seq)"


@query(f"WITH {HITS} SELECT book, CAST(seq AS BIGINT) AS seq, CAST(hit AS BIGINT) AS hit FROM ht")
def heading_first_hit(spark, sf_dir):
    el = elements(spark, sf_dir).withColumnRenamed("seq", "el")
    return matching.first_hits(headings(spark, sf_dir), el, ["text"], "el").select("book", *big("seq", "hit"))


@query(
    f"""WITH {KEYS}, nx AS (SELECT DISTINCT book, page, lead(page) OVER (PARTITION BY book ORDER BY page) AS next FROM (SELECT DISTINCT source AS book, doc_id AS page FROM documents)),
mv AS (SELECT hk.book, hk.seq, nx.next AS page, heading, h_e, h_l FROM hk JOIN nx USING (book, page) WHERE next IS NOT NULL)
SELECT book, page, CAST(seq AS BIGINT) AS seq, heading FROM mv WHERE NOT EXISTS (SELECT 1 FROM ek WHERE ek.book = mv.book AND ek.page = mv.page AND {sql_match('ek.t', 'mv.h')})"""
)
def unmatched_headings(spark, sf_dir):
    """Headings looked for on the page after their own."""
    pages = pages_of(spark, sf_dir).distinct().withColumn("back", -F.col("page"))
    after = scan.scanned(pages, ("book",), ("back",), lasts={"next": F.col("page")}).select("book", "page", "next")
    moved = headings(spark, sf_dir).join(after, ["book", "page"]).where("next is not null").drop("page").withColumnRenamed("next", "page")
    return segmentation.unmatched(moved, as_layout(elements(spark, sf_dir))).select("book", "page", *big("seq"), "heading")


@query(
    f"""WITH {HD}, t AS (SELECT book, page, row_number() OVER (PARTITION BY book ORDER BY level, page, seq) - 1 AS seq FROM hd),
b AS (SELECT *, sum(CASE WHEN page < lg THEN 1 ELSE 0 END) OVER (PARTITION BY book ORDER BY seq ROWS UNBOUNDED PRECEDING) AS stall FROM (SELECT *, lag(page) OVER (PARTITION BY book ORDER BY seq) AS lg FROM t))
SELECT book, CAST(seq AS BIGINT) AS seq, page FROM b WHERE stall = 0"""
)
def toc_reachable(spark, sf_dir):
    """The outline in the order of its levels, so that pages go back: numbered within each level, after the entries of the levels before."""
    found = headings(spark, sf_dir)
    before = found.groupBy("book", "level").count().withColumn("before", F.coalesce(F.sum("count").over(Window.partitionBy("book").orderBy("level").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    toc = scan.numbered(found, ("book", "level"), ("page", "seq"), "at").join(before.drop("count"), ["book", "level"])
    toc = toc.select("book", "page", (F.col("before") + F.col("at")).alias("seq"), "level", "heading")
    return segmentation.reachable(toc, pages_of(spark, sf_dir)).select("book", *big("seq"), "page")


@query(f"WITH {HD} SELECT book, CAST(seq AS BIGINT) AS seq, CAST(last_value(CASE WHEN length(heading) % 2 = 0 THEN seq END IGNORE NULLS) OVER (PARTITION BY book ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS owner FROM hd")
def section_owner(spark, sf_dir):
    return segmentation.owners(headings(spark, sf_dir).withColumn("opens", F.length("heading") % 2 == 0)).select("book", *big("seq", "owner"))


@query(
    f"""WITH {HD}, o AS (SELECT book, page, seq, text, max(CASE WHEN length(text) BETWEEN 1 AND 39 THEN page * 100000 + seq END) OVER (PARTITION BY book ORDER BY page, seq ROWS UNBOUNDED PRECEDING) AS owner FROM el)
SELECT book, owner, CAST(count(*) AS BIGINT) AS n_items, md5(string_agg(text, chr(10) ORDER BY page, seq)) AS content_md5 FROM o WHERE owner IS NOT NULL AND NOT length(text) BETWEEN 1 AND 39 GROUP BY book, owner"""
)
def section_content(spark, sf_dir):
    """Every line in the section of the last heading before it, across pages: the last of its page so far, or the last of the pages before."""
    rows = elements(spark, sf_dir).withColumn("is_heading", is_heading(F.col("text")))
    mark = F.when(F.col("is_heading"), F.col("page") * 100_000 + F.col("seq"))
    pages = rows.groupBy("book", "page").agg(F.max(mark).alias("mark"))
    before = scan.scanned(pages, ("book",), ("page",), lasts={"carried": F.col("mark")}).select("book", "page", "carried")
    near = F.max(mark).over(Window.partitionBy("book", "page").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("near", near).join(before, ["book", "page"]).withColumn("owner", F.coalesce("near", "carried"))
    body = rows.where("owner is not null and not is_heading").groupBy("book", "owner").agg(F.count(F.lit(1)).alias("n_items"), F.array_sort(F.collect_list(F.struct("page", "seq", "text"))).alias("c"))
    return body.select("book", "owner", "n_items", F.md5(F.array_join(F.transform("c", lambda x: x["text"]), "\n")).alias("content_md5"))


@query(
    f"""WITH {HITS}, m AS (SELECT hd.*, hit, lag(hd.seq) OVER (PARTITION BY book ORDER BY hd.seq) AS owner FROM hd JOIN ht USING (book, seq)),
c AS (SELECT m.book, m.owner, m.seq AS a, e.seq AS c, e.text FROM m JOIN el e USING (book, page) WHERE e.seq < m.hit AND m.owner IS NOT NULL),
g AS (SELECT book, owner, count(*) AS n, string_agg(text, chr(10) ORDER BY a, c) AS s FROM c GROUP BY book, owner)
SELECT m.book, CAST(row_number() OVER (PARTITION BY m.book ORDER BY m.seq) AS BIGINT) AS sec_seq, CAST(level AS BIGINT) AS level, heading, CAST(coalesce(n, 0) AS BIGINT) AS n_items, md5(coalesce(s, '')) AS content_md5
FROM m LEFT JOIN g ON g.book = m.book AND g.owner = m.seq
UNION ALL SELECT DISTINCT book, 0, NULL, NULL, NULL, NULL FROM m"""
)
def section_compat_prefix(spark, sf_dir):
    found = segmentation.segment(headings(spark, sf_dir), as_layout(elements(spark, sf_dir)), pages_of(spark, sf_dir), mode="compat")
    return found.select("book", *big("sec_seq", "level"), "heading", F.size("content").cast("bigint").alias("n_items"), F.md5(F.array_join("content", "\n")).alias("content_md5")).withColumn("n_items", F.when(F.col("heading").isNotNull(), F.col("n_items")))


def _matched_headings(spark, sf_dir) -> DataFrame:
    el = elements(spark, sf_dir).withColumnRenamed("seq", "el")
    return matching.first_hits(headings(spark, sf_dir), el, ["text"], "el").groupBy("book").agg(F.count(F.lit(1)).alias("n_matched"))


@query(f"WITH {HITS} SELECT book, CAST(count(*) AS BIGINT) AS n_matched FROM ht GROUP BY book")
def accepted_books_any(spark, sf_dir):
    """Books with at least one matched heading."""
    return _matched_headings(spark, sf_dir)


# ---- scores -----------------------------------------------------------------------------------------------------

SIDES = "hs AS (SELECT lang, doc_id, heading FROM (SELECT lang, doc_id, " + sql_clean("unnest(string_split(text, chr(10)))") + " AS heading FROM documents) WHERE length(heading) BETWEEN 1 AND 39), gt AS (SELECT lang, heading FROM hs WHERE doc_id % 2 = 0), sy AS (SELECT lang, heading FROM hs WHERE doc_id % 2 = 1)"


def sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(system, truth): the headings of odd and of even documents by language."""
    rows = table(spark, sf_dir, "documents").select("lang", "doc_id", F.explode(F.split("text", "\n")).alias("x"))
    rows = rows.select("lang", "doc_id", T.heading_clean("x").alias("heading")).where(F.length("heading").between(1, 39))
    return rows.where("doc_id % 2 = 1"), rows.where("doc_id % 2 = 0")


@query(
    f"""WITH {SIDES}, a AS (SELECT lang, count(*) AS n, avg(CASE WHEN EXISTS (SELECT 1 FROM gt WHERE gt.lang = sy.lang AND gt.heading = sy.heading) THEN 1.0 ELSE 0.0 END) AS p FROM sy GROUP BY lang),
b AS (SELECT lang, count(*) AS n, avg(CASE WHEN EXISTS (SELECT 1 FROM sy WHERE gt.lang = sy.lang AND gt.heading = sy.heading) THEN 1.0 ELSE 0.0 END) AS r FROM gt GROUP BY lang)
SELECT b.lang, CAST(b.n AS BIGINT) AS n_truth, CAST(coalesce(a.n, 0) AS BIGINT) AS n_system, round(coalesce(p, 0.0), 9) AS "precision", round(r, 9) AS recall FROM b LEFT JOIN a USING (lang)"""
)
def outline_precision_recall(spark, sf_dir):
    got = metrics.precision_recall(*sides(spark, sf_dir), key="lang")
    return got.select("lang", *big("n_truth", "n_system"), F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


def _tolerant(system: DataFrame, truth: DataFrame) -> DataFrame:
    got = metrics.precision_recall(system, truth, key="lang")
    return got.select("lang", F.round("tolerant_precision", 9).alias("tolerant_precision"), F.round("tolerant_recall", 9).alias("tolerant_recall"))


# DuckDB's levenshtein counts bytes. Distance 0 or 1 in code points: after a common beginning, one character is replaced, left out or put in.
@query(
    f"""WITH {SIDES},
dg AS (SELECT DISTINCT lang, heading AS g FROM gt), ds AS (SELECT DISTINCT lang, heading AS s FROM sy),
nr AS (SELECT dg.lang, g, s FROM dg JOIN ds ON dg.lang = ds.lang AND abs(length(g) - length(s)) <= 1 AND (g = s OR len(list_filter(range(greatest(length(g), length(s))), lambda i:
  left(g, i) = left(s, i) AND (substr(g, i + 2) = substr(s, i + 2) OR substr(g, i + 2) = substr(s, i + 1) OR substr(g, i + 1) = substr(s, i + 2)))) > 0))
SELECT lang, round(coalesce((SELECT avg(CASE WHEN EXISTS (SELECT 1 FROM nr WHERE nr.lang = sy.lang AND nr.s = sy.heading) THEN 1.0 ELSE 0.0 END) FROM sy WHERE sy.lang = l.lang), 0.0), 9) AS tolerant_precision,
  round((SELECT avg(CASE WHEN EXISTS (SELECT 1 FROM nr WHERE nr.lang = gt.lang AND nr.g = gt.heading) THEN 1.0 ELSE 0.0 END) FROM gt WHERE gt.lang = l.lang), 9) AS tolerant_recall
FROM (SELECT DISTINCT lang FROM gt) l"""
)
def tolerant_precision_recall_all(spark, sf_dir):
    return _tolerant(*sides(spark, sf_dir))


BOUNDS = """{n} AS (SELECT doc_id, max(e) - 1 AS total, list(e - 1 ORDER BY e) FILTER (i < n) AS pos, count(*) - 1 AS c FROM (SELECT doc_id, i, n, sum(length(replace(l[i], ' ', '')) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS e
  FROM (SELECT doc_id, l, len(l) AS n, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, {l} AS l FROM documents))) GROUP BY doc_id)"""
BOTH = BOUNDS.format(n="ba", l="string_split(text, chr(10))") + ", " + BOUNDS.format(n="bb", l="string_split(replace(text, chr(10), ''), '.')")
WINDOW = BOTH + ", k AS (SELECT doc_id, greatest(ba.total, bb.total) AS total, ba.pos AS a, bb.pos AS b, CAST(CASE WHEN ba.c > 0 AND bb.c > 0 THEN floor((greatest(ba.total, bb.total) / ba.c + greatest(ba.total, bb.total) / bb.c) / 2) ELSE 5 END AS BIGINT) AS k FROM ba JOIN bb USING (doc_id))"


def both_boundaries(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Boundaries of lines and of sentences of each document."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    sentences = docs.select("doc_id", F.posexplode(F.split(F.replace("text", F.lit("\n"), F.lit("")), "\\.")).alias("pos", "text"))
    return tuple(metrics.boundaries(x, book="doc_id", order=("pos",)) for x in (lines, sentences))


@query("WITH " + BOTH + " SELECT doc_id, CAST(total AS BIGINT) AS total, coalesce(array_to_string(pos, ','), '') AS positions FROM ba")
def boundary_positions(spark, sf_dir):
    a, _ = both_boundaries(spark, sf_dir)
    return a.select("doc_id", *big("total"), F.array_join(F.transform("positions", lambda x: x.cast("string")), ",").alias("positions"))


@query("WITH " + WINDOW + " SELECT doc_id, CAST(total AS BIGINT) AS total, k FROM k")
def window_size_k(spark, sf_dir):
    a, b = both_boundaries(spark, sf_dir)
    both = a.join(b.select("doc_id", F.col("total").alias("t2"), F.col("positions").alias("p2")), "doc_id").withColumn("total", F.greatest("total", "t2"))
    return both.select("doc_id", *big("total"), metrics.window_size(F.col("total"), F.size("positions"), F.size("p2")).cast("bigint").alias("k"))


SERIES = WINDOW + """, pl AS (SELECT doc_id, unnest(range(0, CAST(total AS BIGINT))) AS p FROM k), flag AS (SELECT pl.doc_id, pl.p, CASE WHEN x.p IS NULL THEN 0 ELSE 1 END AS fa, CASE WHEN y.p IS NULL THEN 0 ELSE 1 END AS fb
  FROM pl LEFT JOIN (SELECT doc_id, unnest(pos) AS p FROM ba) x ON x.doc_id = pl.doc_id AND x.p = pl.p LEFT JOIN (SELECT doc_id, unnest(pos) AS p FROM bb) y ON y.doc_id = pl.doc_id AND y.p = pl.p),
cum AS (SELECT doc_id, p, sum(fa) OVER w AS ca, sum(fb) OVER w AS cb, fa, fb FROM flag WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
win AS (SELECT lo.doc_id, hi.ca - lo.ca + lo.fa AS na, hi.cb - lo.cb + lo.fb AS nb FROM cum lo JOIN k USING (doc_id) JOIN cum hi ON hi.doc_id = lo.doc_id AND hi.p = lo.p + k.k - 1)"""


@query("WITH " + SERIES + " SELECT doc_id, round(s, 9) AS pk FROM k LEFT JOIN (SELECT doc_id, avg(CASE WHEN (na > 0) <> (nb > 0) THEN 1.0 ELSE 0.0 END) AS s FROM win GROUP BY doc_id) USING (doc_id)")
def pk_score(spark, sf_dir):
    return metrics.segmentation_scores(*both_boundaries(spark, sf_dir), book="doc_id").select("doc_id", F.round("pk", 9).alias("pk"))


@query("WITH " + SERIES + " SELECT doc_id, round(s, 9) AS windowdiff FROM k LEFT JOIN (SELECT doc_id, avg(CASE WHEN na <> nb THEN 1.0 ELSE 0.0 END) AS s FROM win GROUP BY doc_id) USING (doc_id)")
def windowdiff_score(spark, sf_dir):
    return metrics.segmentation_scores(*both_boundaries(spark, sf_dir), book="doc_id").select("doc_id", F.round("windowdiff", 9).alias("windowdiff"))


# ---- trees ------------------------------------------------------------------------------------------------------


@query(f"WITH {HD} SELECT book, CAST(max(level) AS BIGINT) AS depth, CAST(max(level) + 1 AS BIGINT) AS compat_depth FROM hd GROUP BY book")
def outline_depth(spark, sf_dir):
    toc = headings(spark, sf_dir)
    return trees.depth(toc).join(trees.depth(toc, compat_plus_one=True).withColumnRenamed("depth", "compat_depth"), "book").select("book", *big("depth", "compat_depth"))


@query(f"WITH {HD} SELECT book, CAST(sum(CASE WHEN level > b + 1 THEN 1 ELSE 0 END) AS BIGINT) AS skips FROM (SELECT *, coalesce(lag(level) OVER (PARTITION BY book ORDER BY seq), 0) AS b FROM hd) GROUP BY book")
def level_skip_check(spark, sf_dir):
    return trees.skips(headings(spark, sf_dir)).select("book", *big("skips"))


@query(f"WITH {HD} SELECT a.book, CAST(a.seq AS BIGINT) AS seq, CAST(max(b.seq) AS BIGINT) AS parent FROM hd a LEFT JOIN hd b ON b.book = a.book AND b.seq < a.seq AND b.level < a.level GROUP BY a.book, a.seq")
def tree_parent(spark, sf_dir):
    return trees.parents(headings(spark, sf_dir)).select("book", *big("seq", "parent"))


@query()
def tree_edit_distance(spark, sf_dir):
    """Outlines of each book's pages in alternate blocks of 20 against those of the other blocks. No SQL expresses the kernel; tests hold it against a recursive definition."""
    return trees.edit_distances(*sides_by_page(headings(spark, sf_dir)), mode="full").select("book", "etd")


def sides_by_page(toc: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(system, truth): the entries of each book's pages in alternate blocks of 20."""
    number = F.col("page") - F.pmod(F.col("page"), F.lit(20))
    return toc.where(number % 40 == 20), toc.where(number % 40 == 0)


@query(
    f"""WITH RECURSIVE {HD}, a AS (SELECT book, list(heading ORDER BY seq) AS x FROM hd WHERE (page - page % 20) % 40 = 20 GROUP BY book), b AS (SELECT book, list(heading ORDER BY seq) AS y FROM hd WHERE (page - page % 20) % 40 = 0 GROUP BY book),
ab AS (SELECT * FROM a JOIN b USING (book)),
d AS (SELECT book, 0 AS i, list_transform(range(0, len(y) + 1), lambda j: CAST(j AS BIGINT)) AS r FROM ab
  UNION ALL SELECT d.book, d.i + 1, list_reduce(list_transform(range(1, len(y) + 1), lambda j: [least(r[j + 1] + 1, r[j] + CASE WHEN x[d.i + 1] <> y[j] THEN 1 ELSE 0 END)]),
    lambda acc, v: list_append(acc, least(v[1], acc[len(acc)] + 1)), [CAST(d.i + 1 AS BIGINT)]) FROM d JOIN ab USING (book) WHERE d.i < len(x))
SELECT d.book, CAST(d.r[len(d.r)] AS DOUBLE) AS etd FROM d JOIN ab USING (book) WHERE d.i = len(x)"""
)
def flat_edit_distance(spark, sf_dir):
    """tree_edit_distance of the same outlines with all levels 1: the edit distance of their headings as sequences, which SQL can express."""
    return trees.edit_distances(*sides_by_page(headings(spark, sf_dir).withColumn("level", F.lit(1))), mode="full").select("book", "etd")


# ---- references and reports -----------------------------------------------------------------------------------


@query("SELECT c_custkey AS custkey, CAST(n_regionkey + 1 AS INTEGER) AS page FROM customer JOIN nation ON c_nationkey = n_nationkey")
def ref_resolve(spark, sf_dir):
    """customer -> nation -> region, where the region has the page."""
    none = F.lit(None)
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("ref"), F.lit("objref").alias("kind"), F.concat(F.lit("n"), "c_nationkey").alias("next_ref"), none.cast("int").alias("page"))
    rows = rows.unionByName(table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("ref"), F.lit("dict").alias("kind"), F.concat(F.lit("r"), "n_regionkey").alias("next_ref"), none.cast("int").alias("page")))
    rows = rows.unionByName(table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("ref"), F.lit("list").alias("kind"), none.cast("string").alias("next_ref"), (F.col("r_regionkey") + 1).cast("int").alias("page")))
    found = references.resolve(rows.withColumn("book", F.lit("all")))
    return found.where(F.startswith("ref", F.lit("c"))).select(F.substr("ref", F.lit(2)).cast("bigint").alias("custkey"), "page")


SCORES = f"{EL}, sc AS (SELECT lang AS system, CAST(len(string_split(text, chr(10))) AS DOUBLE) AS value, d % 3 + 1 AS gt_depth FROM (SELECT lang, text, length(text) AS d FROM documents))"


@query(
    f"""WITH {SCORES} SELECT system, CAST(gt_depth AS BIGINT) AS gt_depth, CAST(count(value) AS BIGINT) AS n, round(avg(value), 6) AS mean, min(value) AS least,
  round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, max(value) AS most
FROM sc GROUP BY GROUPING SETS ((system, gt_depth), (system))"""
)
def depth_distribution(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scores = docs.select(F.col("lang").alias("system"), F.lit("lines").alias("metric"), F.size(F.split("text", "\n")).cast("double").alias("value"), (F.length("text") % 3 + 1).alias("gt_depth"))
    got = reports.by_depth(scores)
    return got.select("system", *big("gt_depth", "n"), *[F.round(c, 6).alias(c) for c in ("mean",)], "least", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3")], "most")


@query("SELECT lang, min(n_chars) - 0.05 * (max(n_chars) - min(n_chars)) AS low, max(n_chars) + 0.05 * (max(n_chars) - min(n_chars)) AS high FROM (SELECT lang, CAST(n_chars AS DOUBLE) AS n_chars FROM documents) GROUP BY lang")
def axis_limits(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("lang", F.col("n_chars").cast("double").alias("value"))
    return reports.axis_limits(rows, keys=("lang",))


@query("SELECT s_suppkey AS book, s_acctbal AS value, n_name AS publisher_group, CAST((dense_rank() OVER (ORDER BY n_name) - 1) % 8 AS BIGINT) AS marker FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def dimension_join_rank(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier")
    groups = suppliers.join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("book"), F.col("n_name").alias("publisher_group"))
    return reports.with_group(suppliers.select(F.col("s_suppkey").alias("book"), F.col("s_acctbal").alias("value")), groups).select("book", "value", "publisher_group", *big("marker"))


@query("SELECT s_suppkey AS book_key, lower(left(s_name, length(s_name) - 4)) AS book, n_name AS publisher_group, CAST(s_acctbal AS VARCHAR) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def dimension_from_workbooks(spark, sf_dir):
    """Suppliers as one workbook for each nation, with columns that nobody needs, read again as the dimension of publishers: these go, and File becomes the slug."""
    nations = table(spark, sf_dir, "nation")
    rows = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    rows = rows.select(F.col("n_name").alias("publisher_group"), F.col("s_name").alias("File"), F.col("s_suppkey").alias("book_key"), F.col("s_acctbal").cast("string").alias("balance"), F.col("s_nationkey").alias("Nation"), F.lit(None).cast("string").alias("Notes"))
    books = spreadsheets.workbooks(rows, "publisher_group")
    found = spreadsheets.dimension(books.select(F.concat("publisher_group", F.lit(".xlsx")).alias("path"), "content"), ["File", "book_key", "balance", "Nation", "Notes"], drop=["Nation", "Notes"])
    return found.select(F.col("book_key").cast("bigint").alias("book_key"), "book", F.regexp_replace("path", "\\.xlsx$", "").alias("publisher_group"), "balance")


@query(
    "SELECT doc_id, source, CAST(n_chars AS BIGINT) AS n_chars, coalesce(lang, 'none') || '-' || (doc_id // 10000) AS workbook, count(*) OVER (PARTITION BY lang, doc_id // 10000) AS n FROM documents WHERE doc_id IS NOT NULL"
)
def workbooks_read_back(spark, sf_dir):
    """The list of documents as workbooks, one for each language and 10,000 ids, written by the data source and read by it, with how many rows their workbook has."""
    name = F.concat_ws("-", F.coalesce("lang", F.lit("none")), F.expr("doc_id div 10000").cast("string"))
    rows = table(spark, sf_dir, "documents").where("doc_id is not null").select(name.alias("name"), "doc_id", "source", "n_chars", F.lit(None).cast("string").alias("notes"))
    folder = shared_folder(spark, "workbooks")
    workbook_source.write_workbooks(rows, "name", folder)
    found = workbook_source.scan_workbooks(spark, folder, columns=["doc_id", "source", "n_chars"])
    sizes = found.groupBy("workbook").agg(F.count("row").alias("n"))
    return found.join(sizes, "workbook").select(*big("doc_id"), "source", *big("n_chars"), "workbook", "n")


@query(f"WITH {HD} SELECT heading, min(page) AS page FROM hd GROUP BY heading")
def first_seen_labels(spark, sf_dir):
    return reports.first_seen(headings(spark, sf_dir), "heading", "page")


@query("SELECT lang AS system, min(value) AS low, max(value) AS high, arg_min(doc_id, (value, doc_id)) AS low_book, arg_max(doc_id, (value, doc_id)) AS high_book FROM (SELECT lang, doc_id, CAST(n_chars AS DOUBLE) AS value FROM documents) GROUP BY lang")
def score_extremes(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("system"), F.lit("chars").alias("metric"), F.col("doc_id").alias("book"), F.col("n_chars").cast("double").alias("value"))
    return reports.extremes(rows).select("system", "low", "low_book", "high", "high_book")


@query(f"WITH {HD} SELECT book, CAST(level AS BIGINT) AS level, CAST(count(*) AS BIGINT) AS n, arg_min(heading, seq) AS first FROM hd GROUP BY book, level")
def headings_by_level(spark, sf_dir):
    return trees.headings_by_level(headings(spark, sf_dir)).select("book", *big("level", "n"), "first")


@query(f"WITH {HD} SELECT CAST(d AS BIGINT) AS depth, CAST(count(*) AS BIGINT) AS n, min(book) AS least, max(book) AS most FROM (SELECT book, max(level) AS d FROM hd GROUP BY book) GROUP BY d")
def books_by_depth(spark, sf_dir):
    return trees.books_by_depth(headings(spark, sf_dir)).select(*big("depth", "n"), "least", "most")


@query(
    f"""WITH {SCORES}
SELECT system, CAST(gt_depth AS BIGINT) AS gt_depth, CAST(count(*) AS BIGINT) AS n, round(avg(n_chars), 6) AS mean, round(quantile_cont(n_chars, 0.5), 6) AS median
FROM (SELECT lang AS system, CAST(n_chars AS DOUBLE) AS n_chars, length(text) % 3 + 1 AS gt_depth FROM documents) GROUP BY GROUPING SETS ((system, gt_depth), (system))"""
)
def scores_rebucketed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scores = docs.select(F.col("doc_id").alias("book"), F.col("lang").alias("system"), F.lit("chars").alias("metric"), F.col("n_chars").cast("double").alias("value"))
    depths = docs.select(F.col("doc_id").alias("book"), (F.length("text") % 3 + 1).alias("depth"))
    return reports.rebucketed(scores, depths).select("system", *big("gt_depth", "n"), F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"))


@query(
    f"""WITH {HD} SELECT book, CAST(seq AS BIGINT) AS seq, trim(trim(trim(regexp_replace(heading, '\\p{{C}}', '', 'g'), '"'), chr(13) || chr(10)), ' ') AS heading,
  CAST(CASE WHEN seq % 4 < 3 THEN page END AS INTEGER) AS page FROM hd WHERE trim(trim(trim(regexp_replace(heading, '\\p{{C}}', '', 'g'), '"'), chr(13) || chr(10)), ' ') <> ''"""
)
def outline_from_destinations(spark, sf_dir):
    """Each heading's page through one of three references, of which every fourth heading has none."""
    toc = headings(spark, sf_dir)
    name = F.concat_ws(":", F.lit("p"), "page")
    raw = toc.select("book", "seq", "level", F.col("heading").alias("title"), *[F.when(F.col("seq") % 4 == k, F.concat(name, F.lit(":" + c))).otherwise(F.lit("")).alias(c) for k, c in enumerate(("dest", "action", "element"))])
    pages = toc.select("book", "page").distinct()
    none = F.lit(None)
    refs = pages.select("book", name.alias("ref"), F.lit("objref").alias("kind"), none.cast("string").alias("next_ref"), F.col("page").cast("int").alias("page"))
    for c in ("dest", "action", "element"):
        refs = refs.unionByName(pages.select("book", F.concat(name, F.lit(":" + c)).alias("ref"), F.lit("dict").alias("kind"), name.alias("next_ref"), none.cast("int").alias("page")))
    return pdf.outline_rows(raw, refs, "gt").select("book", *big("seq"), "heading", "page")


@query("SELECT s AS source FROM (SELECT DISTINCT source AS s FROM documents) ORDER BY s LIMIT 4 OFFSET 3")
def part_of_a_run(spark, sf_dir):
    """Books number 3 to 7 by name: the limit is the operator."""
    return outlines.nth(table(spark, sf_dir, "documents").select(F.col("source").alias("book")), 3, 7).select(F.col("book").alias("source"))


# ---- sinks, tiers and rejects -------------------------------------------------------------------------------


@query(f"WITH {HD} SELECT DISTINCT book, 'NULL_PAGE' AS reason FROM hd WHERE seq % 90 = 89")
def rejected_books(spark, sf_dir):
    """Books with an entry without a page: every 90th loses it."""
    toc = headings(spark, sf_dir)
    return segmentation.rejected_books(toc.withColumn("page", F.when(F.col("seq") % 90 < 89, F.col("page"))))


@query(f"WITH {HD} SELECT DISTINCT source AS book, 'NO_CANDIDATES' AS reason FROM documents WHERE source NOT IN (SELECT book FROM hd WHERE length(heading) = 39 AND page % 10 = 0)")
def books_without_candidates(spark, sf_dir):
    found = headings(spark, sf_dir).where((F.length("heading") == 39) & (F.col("page") % 10 == 0))
    return candidates.without_candidates(pages_of(spark, sf_dir).select("book").distinct(), found)


@query(
    f"""WITH {EL}, r AS (SELECT book, page, seq, 'f' || (length(text) % 7) AS font_id, CAST(8 + length(text) % 7 AS DOUBLE) AS font_size, seq % 9 = 0 AS bold, seq % 11 = 0 AS italic FROM el),
fs AS (SELECT book, font_size, count(*) AS n FROM r GROUP BY book, font_size), body AS (SELECT book, max(font_size) AS body FROM fs WHERE n > 0.5 * (SELECT max(n) FROM fs b WHERE b.book = fs.book) GROUP BY book),
few AS (SELECT book, font_id FROM r GROUP BY book, font_id HAVING count(*) <= 70)
SELECT book, page, CAST(seq AS BIGINT) AS seq, CAST(dense_rank() OVER (PARTITION BY book ORDER BY font_size DESC) AS BIGINT) AS level FROM r JOIN few USING (book, font_id) LEFT JOIN body USING (book) WHERE font_size > body OR bold OR italic"""
)
def style_candidates(spark, sf_dir):
    """Lines in fonts by their length: larger than the books' body sizes, bold or italic, in a font of at most 70 lines."""
    n = F.length("text") % 7
    rows = elements(spark, sf_dir).select("book", "page", "seq", F.concat(F.lit("f"), n.cast("string")).alias("font_id"), (n + 8).cast("double").alias("font_size"), (F.col("seq") % 9 == 0).alias("bold"), (F.col("seq") % 11 == 0).alias("italic"))
    return candidates.by_style(rows, 70).select("book", "page", *big("seq", "level"))


@query(
    f"""WITH {HD}, k AS (SELECT book, row_number() OVER (PARTITION BY book ORDER BY seq) - 1 AS seq, level, heading, page FROM hd WHERE seq % 10 < 9)
SELECT book, CAST(seq AS BIGINT) AS seq, CAST(level AS INTEGER) AS level, regexp_replace(heading, '\\\\(.)', '\\1', 'g') AS heading, CAST(page AS INTEGER) AS page FROM k"""
)
def candidate_files(spark, sf_dir):
    """Candidates written as files, but for every tenth, which has no page; read again by the strict reader."""
    folder = shared_folder(spark, "candidates")
    rows = headings(spark, sf_dir)
    outlines.write_candidates(rows.withColumn("page", F.when(F.col("seq") % 10 < 9, F.col("page"))), folder)
    good, _ = outlines.read_strict(spark, folder, "llm")
    return good.select("book", *big("seq"), "level", "heading", "page")


@query(
    "SELECT source || '_' || (doc_id // 500) AS book, CAST(row_number() OVER (PARTITION BY source || '_' || (doc_id // 500) ORDER BY doc_id) - 1 AS BIGINT) AS pos, CAST(doc_id % 4 AS BIGINT) AS level, lang AS heading,"
    " replace(text, chr(10), ' ') AS content FROM documents WHERE text IS NOT NULL"
)
def hierarchy_files(spark, sf_dir):
    """Documents as the items of a layout parser, some hundred to a book, written as literals and read again."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    book = F.concat_ws("_", "source", F.floor(F.col("doc_id") / 500).cast("string"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "lang", "text"))), lambda d: F.struct((d["doc_id"] % 4).cast("int").alias("level"), d["lang"].alias("heading"), d["text"].alias("content")))
    folder = shared_folder(spark, "hierarchies")
    segments.write_layout(docs.groupBy(book.alias("book")).agg(items.alias("items")), folder)
    rows = segments.read_literals(spark, folder).select("book", F.posexplode("items").alias("pos", "i"))
    return rows.select("book", *big("pos"), F.col("i.level").cast("bigint").alias("level"), "i.heading", "i.content")


@query(
    f"""WITH {EL}, w AS (SELECT book, page, seq, text, regexp_extract(text, '^[^ ]*') AS a FROM el WHERE seq % 5 < 4), x AS (SELECT *, substr(text, length(a) + 1) AS b FROM w),
y AS (SELECT *, {sql_trimmed("concat_ws(' ', nullif(" + sql_trimmed('a') + ", ''), nullif(" + sql_trimmed('b') + ", ''))")} AS ab FROM x WHERE {sql_trimmed('text')} <> '')
SELECT book, page, CAST(seq AS BIGINT) AS seq, CASE seq % 3 WHEN 0 THEN ab WHEN 1 THEN CASE WHEN a <> '' THEN a ELSE {sql_trimmed('b')} END ELSE text END AS content, seq % 3 = 1 AS italic FROM y"""
)
def xml_mixed_content(spark, sf_dir):
    """Lines as XML with leading, bold and italic parts, every fifth in a font that isn't specified: usable elements, and the text that is chosen of each."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    first = F.regexp_extract("text", "^[^ ]*", 0)
    a, b = esc(first), esc(F.substr(F.col("text"), F.length(first) + 1))
    body = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("<b>"), a, F.lit("</b>"), b)).when(F.col("seq") % 3 == 1, F.concat(a, F.lit("<i>"), b, F.lit("</i>"))).otherwise(esc(F.col("text")))
    one = F.concat(F.lit('<text top="0" left="0" font="'), F.when(F.col("seq") % 5 < 4, "f").otherwise("g"), F.lit('">'), body, F.lit("</text>"))
    rows = elements(spark, sf_dir)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", one.alias("t")))), lambda p: p["t"])
    files = rows.groupBy("book", "page").agg(F.concat(F.lit('<pdf2xml><page number="1"><fontspec id="f" size="9"/>'), F.array_join(parts, ""), F.lit("</page></pdf2xml>")).alias("content"))
    found = layout_xml.usable(layout_xml.elements(files.select(F.concat_ws("\t", "book", "page").alias("book"), "content")))
    key = F.split("book", "\t")
    return found.select(key[0].alias("book"), key[1].cast("bigint").alias("page"), *big("seq"), layout_xml.content_choice().alias("content"), "italic")


@query(
    f"""WITH {HD}, cut AS (SELECT book, page, seq, left(text, CAST(length(text) // 2 AS BIGINT)) AS a, substr(text, CAST(length(text) // 2 + 1 AS BIGINT)) AS b FROM el),
un AS (SELECT book, page, 2 * seq AS pos, a AS text FROM cut UNION ALL SELECT book, page, 2 * seq + 1, b FROM cut), ln AS (SELECT book, page, 2 * seq AS pos, {sql_trimmed("concat_ws(' ', nullif(a, ''), nullif(b, ''))")} AS text FROM cut),
hk AS (SELECT *, {sql_exact('heading')} AS h_e, {sql_loose('heading')} AS h_l FROM hd), uk AS (SELECT *, {sql_exact('text')} AS t_e, {sql_loose('text')} AS t_l FROM un), lk AS (SELECT *, {sql_exact('text')} AS t_e, {sql_loose('text')} AS t_l FROM ln),
h1 AS (SELECT hk.book, hk.seq, min(pos) AS hit FROM hk JOIN uk USING (book, page) WHERE t_e = h_e OR contains(t_l, h_l) GROUP BY hk.book, hk.seq),
h2 AS (SELECT hk.book, hk.seq, min(pos) AS line_hit FROM hk JOIN lk USING (book, page) WHERE t_e = h_e OR contains(t_l, h_l) GROUP BY hk.book, hk.seq)
SELECT hd.book, CAST(hd.seq AS BIGINT) AS seq, CAST(hit AS BIGINT) AS hit, CAST(CASE WHEN hit IS NULL THEN line_hit END AS BIGINT) AS line_hit FROM hd LEFT JOIN h1 USING (book, seq) LEFT JOIN h2 USING (book, seq)"""
)
def line_hits(spark, sf_dir):
    """Every line cut into two elements on one height: headings that no element contains are found by the line tier."""
    half = F.floor(F.length("text") / 2).cast("int")
    two = F.array(F.substr(F.col("text"), F.lit(1), half), F.substr(F.col("text"), half + 1))
    rows = elements(spark, sf_dir).select("book", "page", F.col("seq").alias("top"), F.posexplode(two).alias("k", "text_inline"))
    els = rows.select("book", "page", (2 * F.col("top") + F.col("k")).alias("seq"), "top", F.lit(None).cast("string").alias("text_head"), "text_inline")
    return segmentation.hits(headings(spark, sf_dir), els, both_ways=False).select("book", *big("seq", "hit", "line_hit"))

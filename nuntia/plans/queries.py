"""The operators applied to the test tables, and the same in SQL for DuckDB.

The tables hold invented words, so the queries use a lexicon of such words; a paragraph is a line there. Each query is
one function and one SQL text of the same name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nuntia.functions import dates, text
from nuntia.functions.markup import html_text
from nuntia.operators import factors, joins, match, select, windows
from nuntia.operators.classify import request_json
from nuntia.operators.lexicon import Lexicon
from nuntia.plans import sinks
from nuntia.sources import aena, boc, boe, bop, epso, eulisa, eures, sagulpa
from nuntia.sources.detect import source_column

WORDS = Lexicon(
    terms=("thtion", "att?ion", "ertion", "thanea", "eriner", "thanedble"),
    anchors=("ontion", "antion", "retion"),
    exclusions=(r"attion\s+to\s+thanedble", r"eriner\s+thanea"),
    reject_always=("widget", "^hot"),
    reject_unless_term=("small", "bolt"),
    english_terms=("anedble", "thntion", r"of\s+the\s+and"),
)
TITLE_WORDS = Lexicon(terms=("gear", "gizmo"), reject_always=WORDS.reject_always, reject_unless_term=WORDS.reject_unless_term)
HEADING = "^(The|Der|Que|De) "
REPEATED = r"attion to thanedble the"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def added(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return added


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    out = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return out.select(*columns) if columns else out


def long(c: Column | str) -> Column:
    return text.col(c).cast("long")


def document_pages(spark: SparkSession, sf_dir: str, source: Column | None = None) -> DataFrame:
    """Documents as pages. doc_id stays a number."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    return docs.select(
        "doc_id", F.lit(0).alias("ordinal"), F.lit(1).alias("page_number"), "text", F.lit("").alias("section"), F.col("source").alias("detected_organism"),
        (F.lit("BOC") if source is None else source).alias("source"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("url"), "lang",
    )


def document_lines(spark: SparkSession, sf_dir: str, fold: bool = False) -> DataFrame:
    return match.explode_paragraphs(document_pages(spark, sf_dir), "\n", fold=fold)


#: Lines that aren't blank, with their number; folded: without accents.
SQL_LINES = r"""
split AS (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS para_no FROM documents),
lines AS (SELECT doc_id, lang, source, CAST(para_no AS BIGINT) AS para_no, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS paragraph FROM split),
kept AS (SELECT *, strip_accents(paragraph) AS folded FROM lines WHERE paragraph <> '')"""
SQL_SCRUB = r"regexp_replace(regexp_replace(folded, '(?i)attion\s+to\s+thanedble', ' ', 'g'), '(?i)eriner\s+thanea', ' ', 'g')"
SQL_TERMS = "['thtion','att?ion','ertion','thanea','eriner','thanedble']"


def shown(found: DataFrame) -> DataFrame:
    return found.select("doc_id", long("para_no").alias("para_no"), "organism", "description", F.array_join("matched_keywords", "|").alias("matched"))


@query(rf"""WITH {SQL_LINES}, hits AS (SELECT *, list_filter({SQL_TERMS}, lambda p: regexp_matches({SQL_SCRUB}, '(?i)' || p)) AS m FROM kept)
SELECT doc_id, para_no, source AS organism, paragraph AS description, array_to_string(m, '|') AS matched FROM hits
WHERE len(m) > 0 AND regexp_matches(folded, '(?i)ontion|antion|retion')""")
def two_step_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, exclusions, terms, anchors."""
    return shown(match.find(document_pages(spark, sf_dir), WORDS, "\n"))


@query(rf"""WITH {SQL_LINES}, hits AS (SELECT *, CASE WHEN lang = 'en'
  THEN list_filter(['anedble','thntion','of\s+the\s+and'], lambda p: regexp_matches(paragraph, '(?i)' || p))
  ELSE list_filter({SQL_TERMS}, lambda p: regexp_matches({SQL_SCRUB}, '(?i)' || p)) END AS m FROM kept)
SELECT doc_id, para_no, source AS organism, paragraph AS description, array_to_string(m, '|') AS matched FROM hits
WHERE len(m) > 0 AND (lang = 'en' OR regexp_matches(folded, '(?i)ontion|antion|retion'))""")
def two_step_scan_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rule for some sources, another for the rest."""
    pages = document_pages(spark, sf_dir, F.when(F.col("lang") == "en", "EPSO").otherwise("BOC"))
    return shown(match.find(pages, WORDS, "\n"))


@query(rf"""WITH {SQL_LINES} SELECT doc_id, para_no, md5({SQL_SCRUB}) AS scrubbed FROM kept WHERE {SQL_SCRUB} <> folded""")
def exclusion_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_lines(spark, sf_dir, fold=True)
    rows = rows.withColumn("scrubbed", text.scrub("folded", WORDS.folded("exclusions"))).where("scrubbed != folded")
    return rows.select("doc_id", long("para_no").alias("para_no"), F.md5(F.col("scrubbed").cast("binary")).alias("scrubbed"))


@query(rf"""WITH {SQL_LINES}, hits AS (SELECT *, list_filter({SQL_TERMS}, lambda p: regexp_matches({SQL_SCRUB}, '(?i)' || p)) AS m FROM kept)
SELECT doc_id, para_no, CAST(len(m) AS BIGINT) AS n, array_to_string(m, '|') AS matched FROM hits WHERE len(m) > 0""")
def keyword_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = match.match_terms(document_lines(spark, sf_dir, fold=True), WORDS)
    return hits.select("doc_id", long("para_no").alias("para_no"), long(F.size("matched_keywords")).alias("n"), F.array_join("matched_keywords", "|").alias("matched"))


@query(rf"""WITH {SQL_LINES}, hits AS (SELECT doc_id, unnest(list_filter({SQL_TERMS}, lambda p: regexp_matches({SQL_SCRUB}, '(?i)' || p))) AS keyword FROM kept)
SELECT keyword, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM hits GROUP BY keyword""")
def keyword_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    # outer, as no list is empty and Spark would look up all terms a second time to drop empty ones
    hits = match.match_terms(document_lines(spark, sf_dir, fold=True), WORDS).select("doc_id", F.explode_outer("matched_keywords").alias("keyword"))
    return hits.groupBy("keyword").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@query(rf"""WITH {SQL_LINES}, words AS (SELECT regexp_extract_all(lower(strip_accents(text)), '[a-z0-9]+') AS w FROM documents),
patterns AS (SELECT DISTINCT w[1] AS a, w[2] AS b, w[3] AS c FROM words WHERE len(w) >= 3 AND length(w[1]) >= 6),
plain AS (SELECT doc_id, para_no, ' ' || regexp_replace(lower(folded), '[^a-z0-9]+', ' ', 'g') || ' ' AS t FROM kept),
hits AS (SELECT doc_id, para_no, a || ' ' || b || '|' || c AS name FROM plain JOIN patterns ON contains(t, ' ' || a || ' ' || b || ' ') OR contains(t, ' ' || a || ' ' || c || ' '))
SELECT doc_id, para_no, count(*) AS n, md5(string_agg(name, ',' ORDER BY name)) AS names FROM hits GROUP BY ALL""")
def lexicon_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines against a lexicon that grows with the documents: the first words of each that begins with a word of six letters or
    more, as a pattern with an alternative."""
    # the words before the first three are none, so one search finds them
    head = F.regexp_extract(F.lower(text.strip_accents("text")), "[a-z0-9]+[^a-z0-9]+[a-z0-9]+[^a-z0-9]+[a-z0-9]+", 0)
    first = read(spark, sf_dir, "documents").select(F.split(head, "[^a-z0-9]+").alias("w")).where((F.size("w") == 3) & (F.length(F.get("w", F.lit(0))) >= 6)).distinct()
    a, b, c = (F.get("w", F.lit(i)) for i in range(3))
    patterns = first.select(F.concat(a, F.lit(" "), b, F.lit("|"), c).alias("name"), F.concat(F.lit("(?<![a-z0-9])"), a, F.lit("[^a-z0-9]+(?:"), b, F.lit("|"), c, F.lit(")(?![a-z0-9])")).alias("pattern"))
    lines = document_lines(spark, sf_dir, fold=True).select("doc_id", long("para_no").alias("para_no"), "folded")
    found = factors.match_indexed(lines, ["doc_id", "para_no"], factors.indexed(patterns))
    return found.select("doc_id", "para_no", long(F.size("matched_keywords")).alias("n"), F.md5(F.array_join("matched_keywords", ",").cast("binary")).alias("names"))


@query("SELECT doc_id, md5(strip_accents(text)) AS folded FROM documents")
def accent_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(text.strip_accents("text").cast("binary")).alias("folded"))


@query("SELECT doc_id, md5(nfc_normalize(text)) AS composed FROM documents")
def unicode_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize_unicode("text").cast("binary")).alias("composed"))


@query(r"""WITH a AS (SELECT doc_id, regexp_replace(replace(text, '. ', '.' || chr(10) || chr(10) || chr(10)), '\n{3,}', chr(10) || chr(10), 'g') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(replace(replace(replace(t, chr(10) || chr(10), chr(1)), chr(10), ' '), chr(1), chr(10) || chr(10)), '[ \t]+', ' ', 'g') AS t FROM a)
SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(t, chr(10) || chr(10)), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> ''), chr(10) || chr(10))) AS clean FROM b""")
def line_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences set apart as paragraphs first, so that every rule has work."""
    apart = F.replace(F.col("text"), F.lit(". "), F.lit(".\n\n\n"))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(text.collapse_line_breaks(apart).cast("binary")).alias("clean"))


@query(rf"""WITH b AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda l: NOT regexp_matches(l, '(?i){REPEATED}')) AS l, len(string_split(text, chr(10))) AS n FROM documents)
SELECT doc_id, CAST(n - len(l) AS BIGINT) AS dropped, md5(array_to_string(list_transform(l, lambda x: CASE WHEN trim(x) = '' THEN '' ELSE x END), chr(10))) AS clean FROM b WHERE n > len(l)""")
def boilerplate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text").withColumn("clean", text.remove_boilerplate("text", (REPEATED,)))
    count = lambda c: long(F.size(F.filter(text.lines(c), lambda x: x.rlike(text.java(REPEATED)))))
    return docs.select("doc_id", count("text").alias("dropped"), F.md5(F.col("clean").cast("binary")).alias("clean")).where("dropped > 0")


@query(r"""SELECT doc_id, md5(regexp_replace(replace(text, 'tion ', 'tion- ' || chr(10) || ' '), '([\p{L}\p{M}\p{Nd}\p{Pc}]+)-\s*\n\s*([\p{L}\p{M}\p{Nd}\p{Pc}]+)', '\1\2', 'g')) AS joined FROM documents""")
def hyphenation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words broken at line ends, in documents of every language; \\w of the independent engine knows ASCII only."""
    broken = F.replace(F.col("text"), F.lit("tion "), F.lit("tion- \n "))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(text.remove_hyphenation(broken).cast("binary")).alias("joined"))


SQL_BOILERPLATE = "(?i)" + "|".join(f"(?:{p})" for p in text.BOILERPLATE)


@query(rf"""WITH a AS (SELECT doc_id, nfc_normalize(replace(replace(replace(text, 'tion ', 'tion- ' || chr(10) || ' '), 'the ', 'the' || chr(10) || 'Firmado  digitalmente por nadie' || chr(10)), 'der ', 'der' || chr(10) || chr(10) || chr(10) || '  ')) AS t FROM documents),
b AS (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(t, '\n\z', ''), chr(10)), lambda x: CASE WHEN trim(x) = '' THEN '' ELSE x END), lambda x: NOT regexp_matches(x, '{SQL_BOILERPLATE}')), chr(10)) AS t FROM a),
c AS (SELECT doc_id, regexp_replace(regexp_replace(t, '([\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]+)-\s*\n\s*([\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]+)', '\1\2', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM b),
d AS (SELECT doc_id, regexp_replace(replace(replace(replace(t, chr(10) || chr(10), chr(1)), chr(10), ' '), chr(1), chr(10) || chr(10)), '[ \t]+', ' ', 'g') AS t FROM c)
SELECT doc_id, coalesce(md5(array_to_string(list_filter(list_transform(string_split(t, chr(10) || chr(10)), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> ''), chr(10) || chr(10))), md5('')) AS clean FROM d""")
def clean_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cleaning steps, on texts with broken words, signature lines and wide gaps put in, so that every step has work."""
    worn = F.col("text")
    for old, new in (("tion ", "tion- \n "), ("the ", "the\nFirmado  digitalmente por nadie\n"), ("der ", "der\n\n\n  ")):
        worn = F.replace(worn, F.lit(old), F.lit(new))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(text.clean_text(worn).cast("binary")).alias("clean"))


@query(r"""SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(?i)widget|^hot') OR (regexp_matches(p_name, '(?i)small|bolt') AND NOT regexp_matches(p_name, '(?i)gear|gizmo'))""")
def title_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part", "p_partkey", "p_name").where(match.rejects_title("p_name", TITLE_WORDS))


@query(r"""SELECT doc_id, lang FROM documents WHERE NOT regexp_matches(strip_accents(lower(text)), 'thanedble|erction|eaux|ueza')""")
def negative_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").where(~match.rejects_words("text", ("thanedble", "erction", "eaux", "ueza"))).select("doc_id", "lang")


@query(rf"""WITH {SQL_LINES} SELECT doc_id, para_no, last_value(CASE WHEN regexp_matches(paragraph, '{HEADING}') THEN paragraph END IGNORE NULLS)
  OVER (PARTITION BY doc_id ORDER BY para_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM kept""")
def sticky_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_lines(spark, sf_dir)
    head = F.when(F.col("paragraph").rlike(HEADING), F.col("paragraph"))
    rows = rows.select("doc_id", long("para_no").alias("para_no"), head.alias("head"))
    return windows.carried(rows, {"heading": "head"}, ["doc_id"], ["para_no"]).drop("head")


@query("""SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM events""")
def sticky_event_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events", "event_id", "user_id", "event_type", "ts")
    bought = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return windows.carried(events, {"last_purchase": bought}, ["user_id"], ["ts", "event_id"]).select("event_id", "user_id", "last_purchase")


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS)
  OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS asked_at FROM conversations""")
def conversation_sticky(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = read(spark, sf_dir, "conversations", "conv_id", "turn", "role")
    return windows.carried(talk, {"asked_at": F.when(F.col("role") == "user", F.col("turn"))}, ["conv_id"], ["turn"]).select("conv_id", "turn", "asked_at")


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER w AS last_error, last_value(CASE WHEN event_type = 'purchase' THEN user_id END IGNORE NULLS) OVER w AS last_buyer
FROM events WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def sticky_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds at each event of the whole table, one group of all rows: by the segmented scan."""
    events = read(spark, sf_dir, "events", "event_id", "user_id", "event_type", "ts")
    kind = lambda k, c: F.when(F.col("event_type") == k, F.col(c))
    return windows.carried(events, {"last_error": kind("error", "event_id"), "last_buyer": kind("purchase", "user_id")}, [], ["ts", "event_id"]).select("event_id", "last_error", "last_buyer")


@query("""SELECT event_id, event_type, last_value(CASE WHEN user_id % 10 = 0 THEN event_id END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_tenth FROM events""")
def sticky_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few groups of many rows, each over many tasks."""
    events = read(spark, sf_dir, "events", "event_id", "user_id", "event_type", "ts")
    return windows.segmented(events, {"last_tenth": F.when(F.col("user_id") % 10 == 0, F.col("event_id"))}, ["event_type"], ["ts", "event_id"]).select("event_id", "event_type", "last_tenth")


@query("""WITH n AS (SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 1000 AS piece FROM documents)
SELECT source, piece, string_agg(CAST(doc_id AS VARCHAR), ', ' ORDER BY doc_id) AS joined, count(*) AS n FROM n GROUP BY ALL""")
def joined_source_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of a whole source in text, in pieces that follow each other: a source of any size."""
    return windows.joined_pieces(read(spark, sf_dir, "documents", "doc_id", "source"), "doc_id", ["source"], ["doc_id"], 1000)


@query(rf"""WITH {SQL_LINES} SELECT doc_id, para_no, row_number() OVER (PARTITION BY doc_id ORDER BY para_no) AS page_number, para_no + 1 AS row_index FROM kept WHERE regexp_matches(folded, '(?i)thanea')""")
def renumber_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of kept rows, without gaps and with them."""
    rows = document_lines(spark, sf_dir, fold=True).where(F.col("folded").rlike(text.java("thanea")))
    return rows.select("doc_id", long("para_no").alias("para_no"), long(windows.numbered(["doc_id"], ["para_no"])).alias("page_number"), (long("para_no") + 1).alias("row_index"))


@query("""WITH n AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k FROM documents)
SELECT doc_id, k // 10 AS chunk, k % 10 AS chunk_pos, k = 0 AS is_first FROM n""")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.chunked(read(spark, sf_dir, "documents", "doc_id", "source"), 10, ["source"], ["doc_id"])
    return rows.select("doc_id", long("chunk").alias("chunk"), long("chunk_pos").alias("chunk_pos"), "is_first")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS number FROM orders")
def numbered_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.numbered_overall(read(spark, sf_dir, "orders", "o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "number")


@query("SELECT event_id, event_type FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events)")
def latest_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events", "event_id", "event_type", "ts").withColumn("day", F.to_date("ts"))
    return select.latest(events, "day").select("event_id", "event_type")


@query("""SELECT o_orderstatus, max(CAST(o_orderdate AS DATE)) AS latest, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest_key
FROM orders WHERE o_orderdate <= DATE '1998-09-02' GROUP BY o_orderstatus""")
def latest_on_or_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderdate").where(F.col("o_orderdate") <= F.lit("1998-09-02").cast("date"))
    return rows.groupBy("o_orderstatus").agg(F.max(F.to_date("o_orderdate")).alias("latest"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest_key"))


@query("""WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events WHERE event_type = 'error')
SELECT max(day) AS found, CAST(coalesce(date_diff('day', max(day), DATE '2024-01-15') + 1, 7) AS BIGINT) AS probes FROM d WHERE day BETWEEN DATE '2024-01-09' AND DATE '2024-01-15'""")
def walk_back_7(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events", "event_type", "ts").where("event_type = 'error'").select(F.to_date("ts").alias("day")).distinct()
    return select.walk_back(events, "day", F.lit("2024-01-15").cast("date")).select("found", long("probes").alias("probes"))


@query("""WITH r AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'purchase'), i AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'error')
SELECT r.user_id, r.day, max(i.day) AS found, CAST(coalesce(date_diff('day', max(i.day), r.day) + 1, 7) AS BIGINT) AS probes FROM r LEFT JOIN i ON i.user_id = r.user_id AND i.day BETWEEN r.day - 6 AND r.day GROUP BY r.user_id, r.day""")
def issues_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last error of a user at each of their days with a purchase, seven days back at most."""
    events = read(spark, sf_dir, "events", "user_id", "event_type", "ts").withColumn("day", F.to_date("ts"))
    found = select.issues_asof(events.where("event_type = 'purchase'"), events.where("event_type = 'error'"), ["user_id"], "day")
    return found.select("user_id", "day", "found", long("probes").alias("probes"))


@query("""WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type FROM events), r AS (SELECT DISTINCT user_id, day, CASE user_id % 4 WHEN 0 THEN 'BOP' WHEN 1 THEN 'BOC' WHEN 2 THEN 'BOE' ELSE 'EPSO' END AS source, (user_id // 4) % 3 = 0 AS asked FROM e),
i AS (SELECT user_id, day, count(*) FILTER (event_type = 'purchase') AS items FROM e WHERE event_type IN ('error', 'purchase') GROUP BY ALL),
j AS (SELECT r.*, i.day IS NOT NULL AS there, coalesce(i.items, 0) = 0 AS void, (SELECT max(x.day) FROM i x WHERE x.user_id = r.user_id AND x.day < r.day AND x.day > r.day - 7) AS last FROM r LEFT JOIN i ON i.user_id = r.user_id AND i.day = r.day),
c AS (SELECT *, CASE WHEN ((NOT there AND source IN ('BOP', 'BOE')) OR (there AND void AND source IN ('BOC', 'BOE'))) AND NOT asked THEN 'latest' WHEN there THEN 'issue' ELSE 'none' END AS choice FROM j)
SELECT user_id, day, source, asked, choice, CASE choice WHEN 'issue' THEN day WHEN 'latest' THEN CASE WHEN source = 'BOC' THEN day ELSE coalesce(last, CASE WHEN there THEN day END) END END AS use_day FROM c""")
def chosen_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A back-fill of all users and days: users stand for regions of a source, errors and purchases for its issues."""
    events = read(spark, sf_dir, "events", "user_id", "event_type", "ts").withColumn("day", F.to_date("ts"))
    source = F.element_at(F.array(*map(F.lit, ("BOP", "BOC", "BOE", "EPSO"))), (F.col("user_id") % 4 + 1).cast("int"))
    events = events.withColumn("source", source)
    requests = events.select("user_id", "day", "source", (F.floor(F.col("user_id") / 4) % 3 == 0).alias("asked")).distinct()
    issues = events.where("event_type IN ('error', 'purchase')").select("user_id", "source", "day", F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("items"))
    return select.chosen_issues(requests, issues, ["source", "user_id"]).select("user_id", "day", "source", "asked", "choice", "use_day")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS closing FROM orders WHERE o_orderkey % 7 = 0 OR CAST(o_orderdate AS DATE) >= DATE '2000-01-01'""")
def deadline_keep_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.to_date("o_orderdate")).alias("closing"))
    return select.still_open(rows, "closing", F.lit("2000-01-01").cast("date"))


@query("""SELECT source, min(doc_id) AS doc_id, arg_min(md5(text), doc_id) AS first_text FROM documents GROUP BY source""")
def first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.first_per_key(read(spark, sf_dir, "documents"), ["source"], ["doc_id"]).select("source", "doc_id", F.md5(F.col("text").cast("binary")).alias("first_text"))


@query("""SELECT d.doc_id, coalesce(l.quality = 1, TRUE) AS kept FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def verdict_left_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("kept"))
    return joins.with_verdicts(read(spark, sf_dir, "documents", "doc_id"), labels, ["doc_id"], "kept").select("doc_id", "kept")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def verdict_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.kept_by(read(spark, sf_dir, "documents", "doc_id", "lang"), read(spark, sf_dir, "labels").where("quality = 1"), ["doc_id"])


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def seen_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.not_seen(read(spark, sf_dir, "documents", "doc_id", "lang"), read(spark, sf_dir, "labels"), ["doc_id"])


@query("""SELECT doc_id AS id, 1 AS source_rank, source AS name FROM documents UNION ALL SELECT page_id, 2, url FROM pages UNION ALL SELECT conv_id, 3, role FROM conversations""")
def union_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of several sources with the source's place in reports; duplicates are kept."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("BOP").alias("s"), F.col("source").alias("name"))
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.lit("BOC").alias("s"), F.col("url").alias("name"))
    talk = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.lit("BOE").alias("s"), F.col("role").alias("name"))
    return joins.union_all([docs, pages, talk]).select("id", select.source_rank("s").alias("source_rank"), "name")


@query("""SELECT doc_id, source FROM documents WHERE source IN ('src0','src1','src2') ORDER BY doc_id""")
def source_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group of sources and a single one, under names of the tables' own."""
    names = {f"src{i}": s for i, s in enumerate(("EPSO", "EURES", "EULISA"))}
    docs = read(spark, sf_dir, "documents", "doc_id", "source").withColumn("own", F.col("source"))
    mapped = docs.withColumn("source", F.coalesce(F.try_element_at(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*map(F.lit, names.values()))), F.col("own")), "own"))
    return select.only_sources(mapped, ["EU", "EULISA"]).select("doc_id", F.col("own").alias("source"))


@query(r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href, unnest(range(len(regexp_extract_all(html, '<a href="([^"]*)"', 1)))) AS ord FROM pages)
SELECT page_id, CAST(ord AS BIGINT) AS ord, href, CASE WHEN href LIKE '/%' THEN 'https://example.com' || href ELSE href END AS url FROM l""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    rows = read(spark, sf_dir, "pages").select("page_id", F.posexplode(links).alias("ord", "href"))
    return rows.select("page_id", long("ord").alias("ord"), "href", text.root_relative("https://example.com/", "href").alias("url"))


@query(r"""WITH l AS (SELECT page_id, list_distinct(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS u, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS a FROM pages)
SELECT page_id, CAST(len(u) AS BIGINT) AS n, md5(array_to_string(list_sort(u), ' ')) AS hrefs, len(list_filter(a, lambda h: h LIKE '/the%')) > 0 AS any_the FROM l""")
def distinct_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    rows = read(spark, sf_dir, "pages").select("page_id", links.alias("a"), F.array_distinct(links).alias("u"))
    return rows.select("page_id", long(F.size("u")).alias("n"), F.md5(F.array_join(F.array_sort("u"), " ").cast("binary")).alias("hrefs"), F.exists("a", lambda h: h.startswith("/the")).alias("any_the"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '[\s\x0b\x1c-\x1f\x{85}\x{a0}]+', ' ', 'g')) AS body FROM pages""")
def strip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", text.strip_tags("html").alias("body"))


@query(r"""SELECT page_id, regexp_extract(html, '(?is)<h1>(.*?)</h1>', 1) AS head, CAST(len(regexp_extract_all(html, '(?is)<p>(.*?)</p>', 1)) AS BIGINT) AS n, md5(array_to_string(regexp_extract_all(html, '(?is)<p>(.*?)</p>', 1), '|')) AS body FROM pages""")
def tag_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = text.tag_blocks("html", "p")
    return read(spark, sf_dir, "pages").select("page_id", F.coalesce(text.tag_block("html", "h1"), F.lit("")).alias("head"), long(F.size(blocks)).alias("n"), F.md5(F.array_join(blocks, "|").cast("binary")).alias("body"))


@query()
def html_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All text of the pages, by the parser; entity tables and tag nesting are beyond SQL."""
    return read(spark, sf_dir, "pages").select("page_id", F.md5(html_text(F.col("html")).cast("binary")).alias("body"))


@query(r"""WITH a AS (SELECT page_id, replace(replace(html, 'the', 'th&e;'), 'and', '&amp;and&#38;&#x26;') AS h FROM pages)
SELECT page_id, md5(regexp_replace(replace(h, '&', '&amp;'), '&amp;(amp|lt|gt|quot|apos|#[0-9]+|#[xX][a-fA-F0-9]+);', '&\1;', 'g')) AS sanitized FROM a""")
def ampersands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ampersands that start no entity, repaired; some of either kind are put in."""
    worn = F.replace(F.replace(F.col("html"), F.lit("the"), F.lit("th&e;")), F.lit("and"), F.lit("&amp;and&#38;&#x26;"))
    return read(spark, sf_dir, "pages").select("page_id", F.md5(text.sanitize_ampersands(worn).cast("binary")).alias("sanitized"))


@query(r"""SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g')) AS decoded FROM pages""")
def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entities decoded, by the full table of names; the independent engine knows those of the table's pages."""
    return read(spark, sf_dir, "pages").select("page_id", F.md5(text.html_unescape("html").cast("binary")).alias("decoded"))


@query(r"""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href, unnest(range(len(regexp_extract_all(html, '<a href="([^"]*)"', 1)))) AS ord FROM pages),
k AS (SELECT page_id, CAST(ord AS BIGINT) AS ord, regexp_extract(url, '^[a-z]+://[^/?#]+') AS root, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '[^/]*$', '') AS folder, href FROM l)
SELECT page_id, ord, CASE WHEN regexp_matches(href, '^[a-z]+://') THEN href ELSE root || href END AS absolute, CASE WHEN regexp_matches(href, '^[a-z]+://') THEN href ELSE root || CASE WHEN folder = '' THEN '/' ELSE folder END || ltrim(href, '/') END AS relative FROM k""")
def joined_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links resolved against their page's address: as they stand, and as if they were relative to its folder."""
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    rows = read(spark, sf_dir, "pages").select("page_id", "url", F.posexplode(links).alias("ord", "href"))
    return rows.select("page_id", long("ord").alias("ord"), text.resolve_url(F.col("url"), F.col("href")).alias("absolute"), text.resolve_url(F.col("url"), F.regexp_replace("href", "^/+", "")).alias("relative"))


@query("""SELECT page_id, replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS full_escape FROM pages""")
def markup_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", text.escape_markup("url").alias("escaped"), text.escape_html("html").alias("full_escape"))


@query("""SELECT event_id, CAST(coalesce(json_extract_string(props, '$.key'), json_extract_string(props, '$.k'), '0') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.place'), 'Europe') AS place FROM events""")
def json_alias_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.from_json("props", "key string, k string, place string")
    return read(spark, sf_dir, "events").select("event_id", F.coalesce(props["key"], props["k"], F.lit("0")).cast("long").alias("k"), F.coalesce(props["place"], F.lit("Europe")).alias("place"))


@query("""SELECT doc_id, CASE WHEN length(text) > 1500 THEN substr(text, 1, 1500) || '...' ELSE text END AS short FROM documents""")
def truncated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", text.truncated("text", 1500, "...").alias("short"))


@query("""SELECT user_id, CAST(ts AS DATE) AS day, string_agg(CAST(event_id AS VARCHAR), ', ' ORDER BY event_id) AS ids, count(*) AS n FROM events GROUP BY ALL""")
def joined_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of a user's events of a day in one text: groups that stay small as the table grows."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda i: i.cast("string")), ", ")
    events = read(spark, sf_dir, "events", "user_id", "ts", "event_id")
    return events.groupBy("user_id", F.to_date("ts").alias("day")).agg(ids.alias("ids"), F.count("*").alias("n"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS slashed, strftime(o_orderdate, '%Y%m%d') AS compact, CAST(o_orderdate AS DATE) AS from_slashed, CAST(o_orderdate AS DATE) AS from_rfc, CAST(o_orderdate AS DATE) AS from_iso,
'https://example.org/boletines/' || year(o_orderdate) || '/' || day(o_orderdate) || '-' || month(o_orderdate) || '-' || strftime(o_orderdate, '%y') || '/' || day(o_orderdate) || '-' || month(o_orderdate) || '-' || strftime(o_orderdate, '%y') || '.pdf' AS address FROM orders""")
def date_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written in four ways and read back."""
    day = F.to_date("o_orderdate")
    rows = read(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
    return rows.select(
        "o_orderkey", F.date_format(day, "dd/MM/yyyy").alias("slashed"), F.date_format(day, "yyyyMMdd").alias("compact"), dates.day_month_year(F.date_format(day, "d/M/yyyy")).alias("from_slashed"),
        dates.rfc_date(F.concat(F.date_format(day, "E, d MMM yyyy"), F.lit(" 00:00:00 +0200"))).alias("from_rfc"), dates.iso(F.concat(day.cast("string"), F.lit(" 12:00"))).alias("from_iso"),
        dates.bulletin_url("https://example.org/boletines", day).alias("address"),
    )


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) END AS spanish, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) END AS cell FROM orders""")
def date_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in words, and dates in the first cell with two slashes, which some other cell may shadow."""
    rows, day = read(spark, sf_dir, "orders", "o_orderkey", "o_orderdate"), F.to_date("o_orderdate")
    month = F.element_at(F.array(*map(F.lit, dates.MONTHS)), F.month(day))
    worded = F.concat(F.lit("hasta el "), F.dayofmonth(day).cast("string"), F.lit(" de "), F.initcap(month), F.lit(" de "), F.year(day).cast("string"), F.lit("."))
    phrase = F.when(F.col("o_orderkey") % 5 == 0, "sin fecha").when(F.col("o_orderkey") % 2 == 0, worded).otherwise(F.concat(F.lit("hasta "), F.date_format(day, "d/M/yyyy")))
    cells = F.array(F.lit("x"), F.when(F.col("o_orderkey") % 3 == 0, "A/B/C").otherwise("A"), F.date_format(day, "dd/MM/yyyy"))
    return rows.select("o_orderkey", dates.spanish_date(phrase).alias("spanish"), dates.cell_date(cells).alias("cell"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.find(document_pages(spark, sf_dir), WORDS, "\n")


SQL_FOUND = rf"""{SQL_LINES}, hits AS (SELECT *, list_filter({SQL_TERMS}, lambda p: regexp_matches({SQL_SCRUB}, '(?i)' || p)) AS m FROM kept),
found AS (SELECT *, 'doc:' || doc_id AS url FROM hits WHERE len(m) > 0 AND regexp_matches(folded, '(?i)ontion|antion|retion'))"""


@query(rf"""WITH {SQL_FOUND} SELECT doc_id, para_no, '## 📌 ' || upper(source) || ' (BOC - Item 1)' || chr(10) || chr(10) || '**Description:**' || chr(10) || paragraph || chr(10) || chr(10) || '**Keywords:** ' || array_to_string(list_transform(m, lambda k: '`' || k || '`'), ', ') || chr(10) || chr(10) || '**URL:** [Link to announcement](' || url || ')' || chr(10) || chr(10) AS block FROM found""")
def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).select("doc_id", long("para_no").alias("para_no"), sinks.markdown_block().alias("block"))


@query(rf"""WITH {SQL_FOUND}, e AS (SELECT *, replace(replace(replace(paragraph, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS d FROM found)
SELECT doc_id, para_no, '📌 <b>' || upper(source) || '</b>' || chr(10) || chr(10) || CASE WHEN length(d) > 3000 THEN substr(d, 1, 3000) || '...' ELSE d END || chr(10) || chr(10) || '🔑 <b>Keywords:</b> ' || array_to_string(list_transform(m, lambda k: '<code>' || k || '</code>'), ', ')
|| chr(10) || '🌐 <b>Source:</b> BOC (Page/Item 1)' || chr(10) || '🔗 <a href=''' || url || '''>Link to announcement</a>' AS text FROM e""")
def text_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.text_messages(findings(spark, sf_dir)).select("doc_id", long("para_no").alias("para_no"), "text")


@query(rf"""WITH {SQL_FOUND}, n AS (SELECT *, row_number() OVER (ORDER BY doc_id, para_no) - 1 AS n FROM found)
SELECT n // 2 AS message, n % 2 AS place, CASE WHEN n // 2 = 0 THEN '🚀 **New IT Job Opportunities Found!**' ELSE '' END AS content, substr('📌 ' || upper(source), 1, 256) AS title, substr(paragraph, 1, 2048) AS description, 3447003 AS color, url,
  'BOC (Page/Item 1)' AS location, substr(array_to_string(list_transform(m, lambda k: '`' || k || '`'), ', '), 1, 1024) AS keywords FROM n""")
def card_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Webhook payloads, two findings in each, taken apart again, as JSON texts differ in form between engines."""
    embed = "struct<title:string,description:string,color:bigint,url:string,fields:array<struct<name:string,value:string,inline:boolean>>>"
    sent = sinks.card_messages(findings(spark, sf_dir)).select("message", F.from_json("payload", f"content string, embeds array<{embed}>").alias("p"))
    rows = sent.select("message", "p.content", F.posexplode("p.embeds").alias("place", "e"))
    field = lambda i: F.get("e.fields", F.lit(i))["value"]
    return rows.select(long("message").alias("message"), long("place").alias("place"), "content", "e.title", "e.description", F.col("e.color").cast("int").alias("color"), "e.url", field(0).alias("location"), field(1).alias("keywords"))


SQL_ESCAPED = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#x27;')"


@query(rf"""WITH {SQL_FOUND} SELECT doc_id, para_no, '<article class="job-card"><div class="source-badge">BOC - Item 1</div><h2>' || {SQL_ESCAPED.format("upper(source)")} || '</h2><p class="description-text">' || {SQL_ESCAPED.format("paragraph")}
|| '</p><div class="keywords-list">' || array_to_string(list_transform(m, lambda k: '<span class="chip">' || {SQL_ESCAPED.format("k")} || '</span>'), '') || '</div><footer><a href="' || url || '" target="_blank" rel="noopener noreferrer">View Original Bulletin &rarr;</a></footer></article>' || chr(10) AS card FROM found""")
def html_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings as cards of the HTML report."""
    return findings(spark, sf_dir).select("doc_id", long("para_no").alias("para_no"), sinks.html_card().alias("card"))


@query()
def console_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings wrapped for the console."""
    return findings(spark, sf_dir).select("doc_id", long("para_no").alias("para_no"), sinks.console_block().alias("block"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN doc_id % 8 = 0 WHEN doc_id % 4 = 1 THEN TRUE WHEN doc_id % 4 = 2 THEN doc_id % 3 = 0 ELSE FALSE END AS target FROM documents""")
def section_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules that decide which sections are read, on section names made from ids."""
    k, i = F.col("doc_id") % 4, F.col("doc_id")
    section = F.when(k == 0, "II. Autoridades y Personal").when(k == 1, "III. Otras Resoluciones").when(k == 2, "V. Anuncios").otherwise("IV. Justicia")
    sub = F.when((k == 0) & (i % 8 == 0), "Oposiciones y Concursos").when((k == 2) & (i % 3 == 0), "Administración Local").otherwise("Otros")
    return read(spark, sf_dir, "documents", "doc_id").select("doc_id", boc.is_target(section, sub).alias("target"))


@query(rf"""WITH {SQL_LINES}, heads AS (SELECT doc_id, para_no, CASE WHEN para_no % 3 = 0 THEN CASE WHEN doc_id % 2 = 0 OR para_no % 2 = 0 THEN 'III. ADMINISTRACIÓN LOCAL' ELSE 'IV. DISPOSICIONES' END END AS section,
  CASE WHEN para_no % 5 = 1 THEN 'AYUNTAMIENTO DE PLAZA ' || chr(CAST(65 + para_no % 20 AS INTEGER)) || 'X' END AS organism FROM kept),
s AS (SELECT *, last_value(section IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY para_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sec FROM heads)
SELECT doc_id, para_no AS page, sec AS section, coalesce(last_value(organism IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY para_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'Administración Local (Desconocido)') AS organism FROM s WHERE sec LIKE 'III.%'""")
def bulletin_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as pages of a printed bulletin, with headings made from their numbers."""
    rows = document_lines(spark, sf_dir).withColumn("page_number", F.col("para_no"))
    n = F.col("para_no")
    section = F.when(n % 3 == 0, F.when((F.col("doc_id") % 2 == 0) | (n % 2 == 0), "III. ADMINISTRACIÓN LOCAL").otherwise("IV. DISPOSICIONES"))
    organism = F.when(n % 5 == 1, F.concat(F.lit("AYUNTAMIENTO DE  PLAZA "), F.char(65 + n % 20), F.lit("X")))
    raw = rows.select("doc_id", "page_number", F.concat_ws("\n", section, organism, F.lit("- texto -")).alias("raw_text"))
    return bop.pages(raw).select(long("doc_id").alias("doc_id"), long("page_number").alias("page"), "section", F.col("detected_organism").alias("organism"))


@query("""SELECT o_orderkey AS row, 'Position: ' || o_orderpriority || chr(10) || 'Institution/Agency: ' || o_orderstatus || chr(10) || 'Location: ' || o_custkey || chr(10) || 'Type of Contract: TA (AD5)' || chr(10) || 'Deadline for Applications: ' || strftime(o_orderdate, '%Y-%m-%d') || ' 12:00' AS text FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '2000-06-01'""")
def vacancy_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders under the headers of a vacancy table, with the deadline filter and the text template."""
    rows = read(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("Institution/Agency"), F.col("o_orderpriority").alias("Title"), F.col("o_custkey").cast("string").alias("Parent-Location"), F.lit("TA").alias("Type of Contract"),
        F.lit("AD5").alias("Grade"), F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" 12:00")).alias("Deadline"), F.lit("orders").alias("doc_id"), F.col("o_orderkey").alias("row"),
    )
    return epso.pages(rows, F.lit("2000-06-01").cast("date")).select(long("page_number").alias("row"), "text")


@query("""WITH t AS (SELECT p_partkey AS id, p_name AS name, p_brand AS brand, p_partkey % 4 AS kind FROM part), r AS (SELECT id, unnest([1, 2]) AS row, name, brand, kind FROM t WHERE kind <> 3)
SELECT id, CAST(row AS BIGINT) AS place, CAST(row AS BIGINT) AS number, 'Position: ' || CASE WHEN row = 2 THEN 'short' WHEN kind = 1 THEN name || chr(10) || 'two, "lines"' ELSE name END || chr(10) || 'Institution/Agency: ' || CASE WHEN row = 2 THEN '' ELSE brand END || chr(10) || 'Location: ' || CASE WHEN row = 1 AND kind <> 2 THEN 'Vigo' ELSE '' END || chr(10)
  || 'Type of Contract: ' || CASE WHEN row = 1 THEN 'TA (AD' || kind || ')' ELSE ' ()' END || chr(10) || 'Deadline for Applications: ' || CASE WHEN row = 1 THEN '2026-0' || (kind + 7) || '-01 12:00' ELSE '' END AS text, '' AS section,
  CASE WHEN row = 2 THEN '' ELSE brand END AS organism, CASE WHEN row = 1 AND kind = 0 THEN 'http://x/' || id ELSE 'https://epso.europa.eu/en/job-opportunities/open-for-application' END AS url FROM r WHERE row = 2 OR kind > 0""")
def vacancy_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as CSV files whose headers stand in other orders and have other names; some are blank, some rows short or closed."""
    form = (
        F.when(F.col("kind") == 0, "\ufeffTitle,Agency,Grade,Deadline date,Parent-Location,Contract type,Link\n{name},{brand},AD0,2026-07-01 12:00,Vigo,TA,http://x/{id}\n\nshort\n")
        .when(F.col("kind") == 1, '"title",Type of contract,grade,Location,Deadline,"Institution/Agency"\r\n"{name}\ntwo, ""lines""",TA,AD1,Vigo,2026-08-01 12:00,{brand}\r\nshort\r\n')
        .when(F.col("kind") == 2, "Agency,Institution, TITLE ,Deadline,Contract,Grade,Location\nother,{brand},{name},2026-09-01 12:00,TA,AD2\n,,short")
        .otherwise("  \n")
    )
    made = parts(spark, sf_dir)
    text_ = F.replace(F.replace(F.replace(form, F.lit("{name}"), F.col("name")), F.lit("{brand}"), F.col("brand")), F.lit("{id}"), F.col("doc_id"))
    return by_part(epso.pages(epso.vacancies(made.select("doc_id", text_.alias("text"))), F.lit("2026-08-01").cast("date")))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts, of which the sources below are made: id, name, brand, kind (id modulo 4).

    They are dealt over as many tasks as shuffles have: a part takes a few bytes in its file, but becomes a document whose
    parsing takes most of a millisecond, so the few tasks that read the file would hold all the work.
    """
    rows = read(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    return rows.select(F.col("p_partkey").cast("string").alias("doc_id"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), (F.col("p_partkey") % 4).alias("kind"))


def filled_in(form: str, **values: Column | str) -> Column:
    """A text in which {name} stands for values: columns, or names of columns."""
    return text.template(form, **{k: text.col(v).cast("string") for k, v in values.items()})


@query("""SELECT p_partkey AS id, CASE p_partkey % 16 WHEN 0 THEN 'BOP' WHEN 1 THEN 'BOP' WHEN 2 THEN 'EULISA' WHEN 3 THEN 'AENA' WHEN 4 THEN 'SAGULPA' WHEN 5 THEN 'EULISA' WHEN 6 THEN 'BOC' WHEN 7 THEN 'BOE' WHEN 8 THEN 'BOE' WHEN 9 THEN 'BOC' WHEN 10 THEN 'EURES' WHEN 11 THEN 'EURES' WHEN 12 THEN 'EPSO' WHEN 13 THEN 'EPSO' WHEN 14 THEN 'AENA' END AS source FROM part""")
def detected_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files of sixteen kinds, told apart by their names and by how they begin."""
    names = ("{id}.PDF", "{id}", "euLISA {id}.html", "aena.htm", "{id}.html", "{id}.dat", "{id}.xml", "{id}.xml", "boe-{id}.xml", "{id}.rss", "{id}.json", "{id}", "{id}.csv", "{id}.txt", "{id}", "{id}.txt")
    heads = ("x", "%PDF-1.4 {name}", "<p>", "<p>", "<p>{name}", "<html>www.eulisa.europa.eu", "<?xml?><rss>", "<sumario>{name}", "<x>", "<x>", "{", "\ufeff [{name}", "x", "a;{name}", " \n<!DOCTYPE html>{name} aena", "{name}")
    kind = (F.col("id") % 16 + 1).cast("int")
    form = lambda forms: F.replace(F.replace(F.element_at(F.array(*map(F.lit, forms)), kind), F.lit("{id}"), F.col("doc_id")), F.lit("{name}"), F.col("name"))
    files = parts(spark, sf_dir).select("id", F.concat(F.lit("store://x/a.b/"), form(names)).alias("path"), form(heads).cast("binary").alias("content"))
    return files.select("id", source_column("path", "content").alias("source"))


@query("""WITH b AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, day(o_orderdate) || '-' || month(o_orderdate) || '-' || strftime(o_orderdate, '%y') AS name, year(o_orderdate) AS y FROM orders)
SELECT CASE WHEN id % 3 = 1 THEN 'BOLETINES/' ELSE 'boletines/' END || y || '/' || name || '/' || name || '.pdf' AS path, day, day = (SELECT max(day) FROM b WHERE id % 3 <> 2) AS latest FROM b WHERE id % 3 <> 2""")
def bulletin_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as index pages that link to the bulletin of their day; some links name another file than their folder, or no day."""
    day, key = F.to_date("o_orderdate"), F.col("o_orderkey")
    name = F.concat_ws("-", F.dayofmonth(day), F.month(day), F.date_format(day, "yy"))
    folder = F.concat(F.when(key % 3 == 1, "BOLETINES/").otherwise("boletines/"), F.year(day).cast("string"), F.lit("/"), name, F.lit("/"))
    file_ = F.when(key % 3 == 2, "1-13-99").otherwise(name)
    form = "<p><a href='{folder}{file}.pdf'>x</a> boletines/2026/31-2-26/31-2-26.pdf</p>"
    index = read(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").select(filled_in(form, folder=folder, file=file_).alias("html"))
    newest = select.latest_bulletin(index).select(F.col("day").alias("newest"))
    return select.bulletins(index).join(F.broadcast(newest)).select("path", "day", (F.col("day") == F.col("newest")).alias("latest"))


@query("""WITH t AS (SELECT p_partkey AS id, p_name AS name, CASE WHEN p_partkey % 5 = 4 THEN NULL ELSE DATE '2026-05-01' + CAST(p_partkey % 9 AS INTEGER) END AS day FROM part)
SELECT id, name AS title, day, 'day' AS which FROM t WHERE day = DATE '2026-05-03' UNION ALL SELECT id, name, day, 'latest' FROM t WHERE day = (SELECT max(day) FROM t)""")
def regional_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as feeds with an item of some day: those of one day, and those of the latest."""
    form = "<rss><channel><item><title>{name}</title><pubDate>{day}</pubDate><description>x</description></item></channel></rss>"
    day = F.when(F.col("id") % 5 == 4, "soon").otherwise(F.date_format(F.date_add(F.lit("2026-05-01").cast("date"), (F.col("id") % 9).cast("int")), "E, d MMM yyyy HH:mm:ss +0100"))
    found = boc.items(parts(spark, sf_dir).select("doc_id", filled_in(form, name="name", day=day).alias("text")))
    shown = lambda rows, which: rows.select(long("doc_id").alias("id"), "title", F.col("published").alias("day"), F.lit(which).alias("which"))
    return shown(boc.on_day(found, F.lit("2026-05-03").cast("date")), "day").unionByName(shown(boc.of_latest_day(found), "latest"))


@query("""WITH t AS (SELECT p_partkey AS id, p_name AS name, p_partkey % 4 AS kind FROM part WHERE p_partkey % 4 <> 3)
SELECT id, CAST(n AS BIGINT) AS number, 'CONVOCATORIA: ' || name || chr(10) || chr(10) || 'Bases ' || id || ' ' || n AS text, 'https://empleo.aena.es/empleo/PFSrv?codigo=' || id AS url FROM (SELECT *, unnest([1, 2]) AS n FROM t WHERE kind = 0)
UNION ALL SELECT id, 1, 'CONVOCATORIA: ' || name || ' Fecha fin inscripción: 20/07/2026', 'https://empleo.aena.es/empleo/PFSrv?codigo=' || id FROM t WHERE kind = 1""")
def airport_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as airport entries with detail pages: two documents of interest, one without text, none; entries without links go."""
    made = parts(spark, sf_dir)
    url = F.concat(F.lit("https://empleo.aena.es/empleo/PFSrv?codigo="), "doc_id")
    found = made.select("doc_id", F.lit(0).alias("ordinal"), F.col("name").alias("title"), url.alias("url"), F.lit(None).cast("date").alias("published"), F.lit("2026-07-20").cast("date").alias("closing_date"))
    link = F.when(F.col("kind") == 0, '<a href="documentos?get=1-{id}">Bases de la convocatoria</a><a href="PFSrv?docId=2-{id}" title="REQUISITOS">pdf</a><a href="documentos?get=1-{id}">Bases again</a><a href="documentos?get=3-{id}">Mapa</a>').when(F.col("kind") == 1, '<a href="documentos?get=4-{id}">Bases</a>').otherwise('<a href="x.pdf">Bases</a>')
    details = made.select(url.alias("url"), F.replace(link, F.lit("{id}"), F.col("doc_id")).alias("text"))
    links = aena.document_links(details)
    n = F.regexp_extract("href", r"=(\d)-", 1)
    texts = links.select("href", F.lit(1).alias("page_number"), F.when(n != "4", F.concat(F.lit("Bases "), F.regexp_extract("href", r"-(\d+)$", 1), F.lit(" "), n)).otherwise("  ").alias("raw_text"))
    return aena.pages(found, links, texts).select(long("doc_id").alias("id"), long("page_number").alias("number"), "text", "url")


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, 'http://x/id=' || strftime(o_orderdate, '%Y%m%d') AS address FROM orders WHERE o_orderkey % 2 = 0 OR CAST(o_orderdate AS DATE) >= DATE '1997-01-01'""")
def scheduled_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as issues of which a scheduled run leaves out the stale ones, an unscheduled one none; with their addresses."""
    rows = read(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    wanted = F.lit("1997-01-01").cast("date")
    even, odd = rows.where("o_orderkey % 2 = 0"), rows.where("o_orderkey % 2 = 1")
    kept = select.stale_fallbacks_dropped(even, "day", wanted, False).unionByName(select.stale_fallbacks_dropped(odd, "day", wanted, True))
    return kept.select("o_orderkey", "day", dates.compact_url("http://x/id=", F.col("day")).alias("address"))


@query("""SELECT p_brand AS brand, CAST(to_json(list(struct_pack(id := p_partkey, text := p_name) ORDER BY p_partkey)) AS VARCHAR) AS request FROM part GROUP BY p_brand, p_partkey // 10""")
def request_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as JSON requests to a classifier, ten ids in each."""
    rows = parts(spark, sf_dir).groupBy("brand", F.floor(F.col("id") / 10)).agg(F.array_sort(F.collect_list(F.struct("id", F.col("name").alias("text")))).alias("jobs"))
    return rows.select("brand", request_json(F.col("jobs")).alias("request"))


@query(rf"""WITH {SQL_FOUND}, r AS (SELECT *, CASE lang WHEN 'en' THEN 2 WHEN 'de' THEN 1 WHEN 'fr' THEN 3 ELSE 0 END AS rank FROM found)
SELECT doc_id, para_no, row_number() OVER (ORDER BY rank, doc_id, para_no) AS number FROM r""")
def report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in the order of reports: by the place of their source, then by document and paragraph."""
    source = F.when(F.col("lang") == "en", "BOC").when(F.col("lang") == "de", "BOP").when(F.col("lang") == "fr", "BOE").otherwise("OTHER")
    rows = match.find(document_pages(spark, sf_dir, source), WORDS, "\n").withColumn("_rank", select.source_rank())
    return windows.numbered_overall(rows, sinks.ORDER).select("doc_id", long("para_no").alias("para_no"), "number")


def by_part(pages: DataFrame) -> DataFrame:
    return pages.select(long("doc_id").alias("id"), long("ordinal").alias("place"), long("page_number").alias("number"), "text", "section", F.col("detected_organism").alias("organism"), "url")


@query("""SELECT p_partkey AS id, CAST(1 AS BIGINT) AS place, CAST(1 AS BIGINT) AS number, 'Title: ' || CASE WHEN p_partkey % 4 = 3 THEN 'Job Vacancy' ELSE p_name END || chr(10) || 'Employer/Agency: ' || CASE WHEN p_partkey % 4 = 3 THEN 'EURES Employer' ELSE p_brand END || chr(10)
  || 'Location: ' || CASE WHEN p_partkey % 4 = 1 THEN 'Vigo' ELSE 'Europe' END || chr(10) || 'Description: ' || CASE p_partkey % 4 WHEN 0 THEN 'Run' || chr(10) || p_name WHEN 1 THEN p_name || ' 3 < 4' ELSE '' END AS text, '' AS section,
  CASE WHEN p_partkey % 4 = 3 THEN 'EURES Employer' ELSE p_brand END AS organism, CASE p_partkey % 4 WHEN 0 THEN 'http://x/' || p_partkey ELSE 'https://europa.eu/eures/portal/jv-se/search' END AS url FROM part""")
def mobility_vacancies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as JSON of the mobility portal, in four forms: all field names of either version, lists, missing fields."""
    form = (
        F.when(F.col("kind") == 0, '{"vacancies": [{"vacancyTitle": "{name}", "employerName": "{brand}", "applyUrl": "http://x/{id}", "description": "<p>Run</p><b>{name}</b>"}]}')
        .when(F.col("kind") == 1, '[{"title": "{name}", "employer": "{brand}", "location": "Vigo", "shortDescription": "{name} 3 < 4"}]')
        .when(F.col("kind") == 2, '{"vacancyList": [{"title": " {name} ", "employer": "{brand}"}]}')
        .otherwise('{"vacancyList": [{}]}')
    )
    docs = parts(spark, sf_dir).select("doc_id", F.replace(F.replace(F.replace(form, F.lit("{name}"), F.col("name")), F.lit("{brand}"), F.col("brand")), F.lit("{id}"), F.col("doc_id")).alias("text"))
    return by_part(eures.pages(eures.vacancies(docs)))


@query("""WITH k AS (SELECT p_partkey % 4 AS kind, count(*) AS n FROM part GROUP BY ALL), f AS (SELECT unnest([0, 0, 1, 1, 2]) AS kind, unnest(['jobTitle', 'salary', 'title', 'salary', 'it''s a "new" field']) AS field, unnest(['STRING', 'BIGINT', 'OBJECT', 'ARRAY', 'BOOLEAN']) AS type, unnest([FALSE, FALSE, TRUE, FALSE, FALSE]) AS known, unnest([1, 2, 1, 1, 1]) AS times)
SELECT field, type AS kind, known, CAST(sum(n * times) AS BIGINT) AS vacancies, CAST(sum(n) AS BIGINT) AS documents FROM f JOIN k USING (kind) GROUP BY ALL""")
def drifted_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as JSON of the mobility portal with fields that nothing reads, or of other types."""
    form = (
        F.when(F.col("kind") == 0, '{"vacancies": [{"jobTitle": "{name}", "salary": 1}, {"title": "{name}", "salary": 20000}]}')
        .when(F.col("kind") == 1, '[{"title": {"en": "{name}"}, "salary": [1, 2], "location": null}]')
        .when(F.col("kind") == 2, '{"vacancyList": [{"title": "x", "it\'s a \\"new\\" field": true}]}')
        .otherwise('{"other": [{"jobTitle": "{name}"}]}')
    )
    docs = parts(spark, sf_dir).select("doc_id", F.replace(form, F.lit("{name}"), F.col("name")).alias("text"))
    return eures.drifted_fields(docs)


@query("""WITH t AS (SELECT p_partkey AS id, p_name AS name FROM part)
SELECT id, CAST(0 AS BIGINT) AS place, CAST(1 AS BIGINT) AS number, 'Title: ' || name || chr(10) || 'Reference/Details: R/' || id || ' | ' || name || ' | 15/09/2026' || chr(10) || 'Source Portal: eu-LISA Careers' AS text, '' AS section, 'eu-LISA' AS organism, 'https://www.eulisa.europa.eu/vacancies/' || id AS url FROM t WHERE id % 4 <> 3
UNION ALL SELECT id, 1, CASE WHEN id % 4 = 3 THEN 1 ELSE 2 END, 'Title: ' || name || ' II' || chr(10) || 'Details: R ' || name || ' II until 2026-08-15' || chr(10) || 'Source Portal: eu-LISA Careers', '', 'eu-LISA', 'https://www.eulisa.europa.eu/jobs/' || id FROM t WHERE id % 4 <> 2""")
def agency_vacancies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pages of the agency: table rows, links in lists, links that repeat, noise, and closed entries."""
    form = (
        '<table><tr><th>Reference</th></tr><tr><td>R/{id}</td><td><a href="/vacancies/{id}">{name}</a></td><td>{closing}</td></tr></table>'
        '<ul><li>R <a href="/jobs/{id}">{name} II</a> until {until}</li>{again}<li><a href="/contact/job">Contact us</a></li><li><a href="/news">No news today</a></li></ul>'
    )
    closing = F.when(F.col("kind") == 3, "30/06/2026").otherwise("15/09/2026")
    until = F.when(F.col("kind") == 2, "2026-07-31").otherwise("2026-08-15")
    repeated = filled_in('<li><a href="/vacancies/{id}">{name}</a></li><li><a href="/jobs/{id}">{name} again</a> until {until}</li>', id="id", name="name", until=until)
    docs = parts(spark, sf_dir).select("doc_id", filled_in(form, id="id", name="name", closing=closing, until=until, again=F.when(F.col("kind") < 3, repeated).otherwise("")).alias("text"))
    return by_part(eulisa.pages(eulisa.entries(docs), F.lit("2026-08-01").cast("date")))


@query("""SELECT p_partkey AS id, CAST(0 AS BIGINT) AS place, p_name AS title, 'https://empleo.aena.es/empleo/PFSrv?codigo=' || p_partkey AS url, CASE WHEN p_partkey % 4 = 1 THEN NULL ELSE DATE '2026-07-20' END AS closing FROM part
WHERE p_partkey % 4 < 2 AND NOT (regexp_matches(p_name, '(?i)widget|^hot') OR (regexp_matches(p_name, '(?i)small|bolt') AND NOT regexp_matches(p_name, '(?i)gear|gizmo')))""")
def airport_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as entries of the airport board: open, without a date, closed, without a link; titles are rejected."""
    form = '<div class="th"><h3>{name}</h3><span>Fecha fin:</span> {closing} </div>{link}<span class="brkfila"></span>'
    closing = F.when(F.col("kind") == 1, "pronto").when(F.col("kind") == 2, "01/02/2026").otherwise("20/07/2026")
    link = F.when(F.col("kind") == 3, "").otherwise(filled_in('<div class="td3"><a class="x botonAvisos" href="PFSrv?codigo={id}">Ver</a></div>', id="id"))
    docs = parts(spark, sf_dir).select("doc_id", filled_in(form, name="name", closing=closing, link=link).alias("text"))
    rows = aena.listings(docs, F.lit("2026-07-15").cast("date"), TITLE_WORDS)
    return rows.select(long("doc_id").alias("id"), long("ordinal").alias("place"), "title", "url", F.col("closing_date").alias("closing"))


@query("""SELECT p_partkey AS id, CAST(0 AS BIGINT) AS place, p_name AS title, CASE WHEN p_partkey % 4 = 1 THEN '' ELSE 'https://www.sagulpa.com/ofertas-empleo/' || p_partkey END AS url, CASE WHEN p_partkey % 4 = 1 THEN DATE '2026-07-08' ELSE DATE '2026-07-01' END AS published,
  CASE WHEN p_partkey % 4 = 0 THEN DATE '2026-07-11' END AS closing, p_name || CASE WHEN p_partkey % 4 = 1 THEN ' Fecha de publicación: 08/07/2026' ELSE chr(10) || 'Fecha de publicación: 01/07/2026' || chr(10) || chr(10) || 'Se ofrece ' || p_brand || '.' END AS text FROM part WHERE p_partkey % 4 < 2""")
def company_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as entries of the company's board with their detail pages: open, without link and dates, closed, stopped."""
    form = '<ul class="fa-ul"><li><h2>{name}</h2> {published} {link} Fecha finalización de presentación de candidaturas: {closing}</li><li><a href="/ofertas-empleo/x">no heading</a></li></ul>'
    name = F.when(F.col("kind") == 3, F.concat("name", F.lit(" (CERRADO)"))).otherwise(F.col("name"))
    published = F.when(F.col("kind") == 1, "").otherwise("Fecha de publicación: 01/07/2026")
    closing = F.when(F.col("kind") == 0, "11 de julio de 2026").when(F.col("kind") == 1, "31/02/2026").otherwise("5/7/2026")
    link = F.when(F.col("kind") == 1, '<a href="javascript:x()">x</a>').otherwise(filled_in('<a href="/otra">o</a><a href="./ofertas-empleo/{id}">Ver</a>', id="id"))
    made = parts(spark, sf_dir)
    docs = made.select("doc_id", filled_in(form, name=name, published=published, link=link, closing=closing).alias("text"))
    found = sagulpa.listings(docs, F.lit("2026-07-08").cast("date"))
    body = filled_in('<body>menu<div class="margen_menu_lateral_columna"><p>Se ofrece</p><p>{brand}.</p></div></body>', brand="brand")
    details = made.select(F.concat(F.lit("https://www.sagulpa.com/ofertas-empleo/"), "doc_id").alias("url"), body.alias("text"))
    rows = sagulpa.pages(found, details, also=["title", "published", "closing_date"])
    return rows.select(long("doc_id").alias("id"), long("ordinal").alias("place"), "title", "url", "published", F.col("closing_date").alias("closing"), "text")


@query("""WITH t AS (SELECT p_partkey AS id, p_name AS name, p_brand AS brand FROM part)
SELECT id, CAST(0 AS BIGINT) AS place, CAST(1 AS BIGINT) AS number, name || ' & más' || CASE WHEN id % 4 = 0 THEN chr(10) || chr(10) || 'Bases de ' || brand ELSE '' END AS text, 'II. Autoridades y Personal -> Oposiciones y concursos' AS section, 'Consejería ' || brand AS organism, 'http://x/' || id || '?a=1&b=2' AS url FROM t WHERE id % 4 IN (0, 2)
UNION ALL SELECT id, 1, CASE WHEN id % 4 IN (0, 2) THEN 2 ELSE 1 END, 'Resolución ' || id, 'III. Otras Resoluciones -> Universidad', 'Universidad', '' FROM t WHERE id % 4 <> 3""")
def regional_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as items of regional feeds: kept and other sections, items without heading, paragraphs or description."""
    form = (
        "<rss><channel><item><title>t</title><link> http://x/{id}?a=1&b=2 </link><description>&lt;h5&gt;{section} - Oposiciones y concursos - Consejería {brand}&lt;/h5&gt;&lt;h3&gt;&lt;b&gt;{name}&lt;/b&gt; &amp;amp; más&lt;/h3&gt;{body}&lt;p&gt;CVE: x&lt;/p&gt;</description></item>"
        "<item><title>Resolución {id}</title><description>{other}</description></item><item><title>none</title><description></description></item></channel></rss>"
    )
    section = F.when(F.col("kind") % 2 == 0, "II. Autoridades y Personal").otherwise("IV. Justicia")
    body = F.when(F.col("kind") == 0, filled_in("&lt;p&gt;Bases de  {brand}&lt;/p&gt;", brand="brand")).otherwise("")
    other = F.when(F.col("kind") == 3, "no heading").otherwise("&lt;h5&gt;III. Otras Resoluciones - Universidad&lt;/h5&gt;")
    docs = parts(spark, sf_dir).select("doc_id", filled_in(form, id="id", section=section, brand="brand", name="name", body=body, other=other).alias("text"))
    return by_part(boc.pages(boc.items(docs)))


@query("""WITH t AS (SELECT p_partkey AS id, p_name AS name, p_brand AS brand FROM part),
i AS (SELECT id, 1 AS n, '[A-' || id || '0] ' || name AS text, '' AS epigraph, brand AS organism, 'http://x/h' AS url FROM t UNION ALL SELECT id, 2, '[A-' || id || '] ' || name || ' & otra', ' -> Personal laboral', brand, 'http://x/p' FROM t
UNION ALL SELECT id, 3, name || ' deep', '', brand, '' FROM t UNION ALL SELECT id, 4, '[B-' || id || '] Letras', '', 'Administración Pública (Desconocido)', '' FROM t WHERE id % 4 <> 1)
SELECT id, CAST(n AS BIGINT) AS place, CAST(n AS BIGINT) AS number, text, 'II.B. Oposiciones y concursos' || epigraph AS section, organism, url FROM i""")
def state_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as summaries of the state bulletin: departments, epigraphs, items further down, other sections, rejected words."""
    item = "<item><identificador>{i}</identificador><titulo>{t}</titulo>{u}</item>"
    one = lambda i, t, u="": item.replace("{i}", i).replace("{t}", t).replace("{u}", u)
    form = (
        "<sumario><seccion codigo='1'><departamento nombre='x'>" + one("X", "other section") + "</departamento></seccion><seccion codigo='2B'><departamento nombre='{brand}'>" + one("A-{id}0", "{name}", "<url_html>http://x/h</url_html><url_pdf>http://x/p</url_pdf>")
        + "<epigrafe nombre='Personal laboral'>" + one("A-{id}", "{name} & otra", "<url_pdf> http://x/p</url_pdf>") + "<nivel>" + one("", " {name} deep ") + "</nivel></epigrafe>" + one("N", "Plazas de Policía Local") + one("E", "") + "</departamento>"
        "<departamento>" + one("B-{id}", "{last}") + "</departamento></seccion></sumario>"
    )
    last = F.when(F.col("kind") == 1, "Cuerpo de letrados").otherwise("Letras")
    docs = parts(spark, sf_dir).select("doc_id", filled_in(form, id="id", name="name", brand="brand", last=last).alias("text"))
    return by_part(boe.pages(boe.candidates(docs)))

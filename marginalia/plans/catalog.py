"""Registered queries of the core operators and the SQL that must give the same rows.

Patterns name their character classes, as `\\w` and `\\b` mean different things to the engines.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions import dates, text as T
from marginalia.functions.spans import normalize_column
from marginalia.operators import audio, cleaning, context, duplicates, intervals, kernel, matching, metrics, segmentation
from marginalia.plans import pipeline, provenance
from marginalia.plans.tables import shared_folder
from marginalia.schema import ATTR, RANGE, attrs_of, raw_segments, snippet
from marginalia.sources import brat, exchange, terminologies

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


def _word(words: str) -> str:
    """A pattern for whole words that Python, the JVM and RE2 read alike."""
    return rf"(?:^|[^\p{{L}}\p{{N}}_])(?:{words})(?:[^\p{{L}}\p{{N}}_]|$)"


NEG, KIN, HYP = "not?|without|pas|sans|nicht|kein|sin", "mother|father|mere|frau|madre|and", "possible|if|si|wenn|that"
EMAIL, IP, NUMBER = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", r"[0-9]+"
SENTENCES_SQL = "list_filter(regexp_extract_all(text, ' *([^.;?!\\n\\r]+)', 1), lambda x: regexp_matches(x, '[\\p{L}\\p{N}_]'))"


def _rule(words: str, name: str) -> context.Rule:
    return context.Rule(_word(words).replace(r"\p{L}\p{N}_", r"\w"), (), name, unicode_sensitive=True)


def _sentences(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(segmentation.sentence_texts(F.col("text"))).alias("seq", "text"))


def _anns(rows: DataFrame, label: str, kind: str = "entity") -> DataFrame:
    """Annotation rows of (doc_id, uid, text, n_start, n_end, seq)."""
    span = F.struct(F.col("n_start").alias("start"), F.col("n_end").alias("end"), F.lit(None).cast("int").alias("length"), F.lit(None).cast(f"array<{RANGE}>").alias("replaced"))
    none = lambda t: F.lit(None).cast(t)
    attrs = F.col("attrs") if "attrs" in rows.columns else none(f"array<{ATTR}>")
    return rows.select(
        F.col("doc_id").cast("string").alias("doc_id"), F.col("uid").cast("string").alias("uid"), none("string").alias("parent_uid"), F.lit(kind).alias("kind"), F.lit(label).alias("label"), "text", F.array(span).alias("spans"),
        F.col("n_start").cast("int").alias("n_start"), F.col("n_end").cast("int").alias("n_end"), none("array<string>").alias("keys"), none("map<string, string>").alias("metadata"), F.col("seq").cast("long").alias("seq"), attrs.alias("attrs"),
    )


# Segments and context.


@query(
    rf"""WITH s AS (SELECT lang, unnest({SENTENCES_SQL}) AS s FROM documents)
SELECT lang, count(*) AS n_sentences, count(*) FILTER (WHERE regexp_matches(s, '(?i){_word(NEG)}')) AS n_negated,
       CAST(sum(len(regexp_extract_all(s, '{NUMBER}'))) AS BIGINT) AS n_entities FROM s GROUP BY lang"""
)
def flagship(spark, sf_dir):
    """Sentences, negated sentences and entities per language: nothing leaves the JVM, one partial and one final aggregate."""
    docs = _table(spark, sf_dir, "documents").select("lang", "text")
    s = docs.select("lang", F.explode(segmentation.sentence_texts(F.col("text"))).alias("text"))
    s = context.NegationDetector(rules=[_rule(NEG, "negation")]).flags(s)
    n = F.size(F.regexp_extract_all("text", F.lit(NUMBER), F.lit(0)))
    return s.groupBy("lang").agg(F.count("*").alias("n_sentences"), F.count(F.when(F.col("flag"), 1)).alias("n_negated"), F.sum(n).cast("long").alias("n_entities"))


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'RAW_TEXT' AS label, 0 AS n_start, CAST(length(text) AS INTEGER) AS n_end, substr(sha256('RAW_TEXT' || chr(0) || CAST(doc_id AS VARCHAR)), 1, 32) AS uid FROM documents")
def raw_segment(spark, sf_dir):
    return raw_segments(_docs(spark, sf_dir)).select("doc_id", "label", "n_start", "n_end", "uid")


@query(f"SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS seq, unnest(s) AS text FROM (SELECT doc_id, {SENTENCES_SQL} AS s FROM documents)")
def sentences(spark, sf_dir):
    return _sentences(_docs(spark, sf_dir))


@query(
    r"""WITH p AS (SELECT doc_id, regexp_extract_all(text, '[^.;?!\n\r]+|[.;?!\n\r]+') AS x FROM documents),
u AS (SELECT doc_id, unnest(x) AS piece, generate_subscripts(x, 1) AS i FROM p),
c AS (SELECT doc_id, piece, i, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) AS til FROM u)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(til - length(ltrim(piece, ' ')) AS INTEGER) AS n_start, CAST(til AS INTEGER) AS n_end, ltrim(piece, ' ') AS text
FROM c WHERE regexp_matches(piece, '[\p{L}\p{N}_]')"""
)
def sentences_offsets(spark, sf_dir):
    return segmentation.SentenceTokenizer().run(raw_segments(_docs(spark, sf_dir))).select("doc_id", "n_start", "n_end", "text")


@query()
def rule_sentences(spark, sf_dir):
    return segmentation.RuleSentenceTokenizer().run(raw_segments(_docs(spark, sf_dir))).select("doc_id", "n_start", "n_end", "text")


_CLAUSES = r"\n|, "


@query(
    r"""WITH m AS (SELECT doc_id, text, regexp_extract_all(text, '(?s) *(.+?)(?:\n|, |$)') AS x FROM documents),
u AS (SELECT doc_id, text, unnest(x) AS t, generate_subscripts(x, 1) AS i FROM m),
v AS (SELECT doc_id, text, i, t, length(regexp_extract(t, '(?s)^ *(.+?)(\n|, |$)', 2)) AS sep, sum(length(t)) OVER (PARTITION BY doc_id ORDER BY i) AS til FROM u),
w AS (SELECT *, til - sep AS e, coalesce(lag(til - sep) OVER (PARTITION BY doc_id ORDER BY i), length(t) - length(ltrim(t, ' '))) AS b FROM v),
c AS (SELECT doc_id, e, ltrim(substr(text, CAST(b AS BIGINT) + 1, CAST(e - b AS BIGINT)), '.;,?! ' || chr(10) || chr(13) || chr(9)) AS t FROM w),
d AS (SELECT doc_id, e - length(t) AS s, rtrim(t, ' ' || chr(10) || chr(13) || chr(9)) AS t FROM c)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(s AS INTEGER) AS n_start, CAST(s + length(t) AS INTEGER) AS n_end, t AS text FROM d WHERE t <> ''"""
)
def syntagmas(spark, sf_dir):
    """Clauses keep the point at their end: only their start loses punctuation."""
    return segmentation.SyntagmaTokenizer(_CLAUSES.split("|")).run(raw_segments(_docs(spark, sf_dir))).select("doc_id", "n_start", "n_end", "text")


@query()
def sections(spark, sf_dir):
    words = {"licence": ["License", "Licence", "Copyright"], "contact": ["Contact", "email", "Email"]}
    found = segmentation.SectionTokenizer(words).run(raw_segments(_docs(spark, sf_dir)))
    return found.select("doc_id", "n_start", "n_end", F.col("metadata")["name"].alias("name"))


def _flag_sql(words: str, limit: str = "") -> str:
    return f"""WITH s AS (SELECT doc_id, {SENTENCES_SQL} AS s FROM documents), u AS (SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS seq, unnest(s) AS t FROM s)
SELECT doc_id, seq, regexp_matches(t, '(?i){_word(words)}') AND regexp_matches(t, '(?i)[a-z]') {limit} AS flag FROM u"""


@query(_flag_sql(NEG))
def negation_flag(spark, sf_dir):
    return context.NegationDetector(rules=[_rule(NEG, "n")]).flags(_sentences(_docs(spark, sf_dir))).select("doc_id", "seq", "flag")


@query(_flag_sql(KIN))
def family_flag(spark, sf_dir):
    return context.FamilyDetector(rules=[_rule(KIN, "f")]).flags(_sentences(_docs(spark, sf_dir))).select("doc_id", "seq", "flag")


@query(_flag_sql(HYP + "|might|may", "AND length(t) <= 150"))
def hypothesis_flag(spark, sf_dir):
    found = context.HypothesisDetector(rules=[_rule(HYP, "h")], verbs={"may": ["might", "may"]}).flags(_sentences(_docs(spark, sf_dir)))
    return found.select("doc_id", "seq", "flag")


@query(f"SELECT CAST(conv_id AS VARCHAR) AS doc_id, conv_id || '-' || turn AS parent_uid, unnest({SENTENCES_SQL}) AS text, role FROM conversations")
def attrs_to_copy(spark, sf_dir):
    """Sentences of turns inherit the role of their turn."""
    turns = _table(spark, sf_dir, "conversations").withColumn("uid", F.concat_ws("-", "conv_id", "turn"))
    attr = F.struct(F.concat(F.lit("r"), "uid").alias("uid"), F.lit("Attribute").alias("attr_class"), F.lit("role").alias("label"), F.col("role").alias("value"), F.lit("string").alias("value_type"))
    full = F.array(F.from_json(F.to_json(attr), ATTR))
    rows = turns.select(F.col("conv_id").alias("doc_id"), "uid", "text", F.lit(0).alias("n_start"), F.length("text").alias("n_end"), F.col("turn").alias("seq"), full.alias("attrs"))
    parts = segmentation.SentenceTokenizer(attrs_to_copy=["role"]).run(_anns(rows, "turn", "segment"))
    return parts.select("doc_id", "parent_uid", "text", F.filter("attrs", lambda a: a.label == "role")[0].value.alias("role"))


# Cleaning.

_CHARS = {"’": "'", "é": "e", "œ": "oe", "-": " ", "ß": "ss", "_": ""}
_CHARS_SQL = "text"
for _k, _v in _CHARS.items():
    _CHARS_SQL = f"replace({_CHARS_SQL}, '{_k.replace(chr(39), chr(39) * 2)}', '{_v.replace(chr(39), chr(39) * 2)}')"


@query(f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, {_CHARS_SQL} AS text FROM documents")
def char_replace(spark, sf_dir):
    """With spans that lead back to the text."""
    return cleaning.CharReplacer("clean", _CHARS).run(raw_segments(_docs(spark, sf_dir))).select("doc_id", "text")


@query(f"SELECT doc_id, {_CHARS_SQL} AS text FROM documents")
def char_replace_native(spark, sf_dir):
    """The text alone, in the JVM."""
    return _docs(spark, sf_dir).select("doc_id", cleaning.replace_characters(F.col("text"), _CHARS).alias("text"))


@query(r"SELECT CAST(doc_id AS VARCHAR) AS doc_id, regexp_replace(regexp_replace(text, '[0-9]+', '<n>', 'g'), '[ \t]+', ' ', 'g') AS text FROM documents")
def regexp_replace(spark, sf_dir):
    return cleaning.RegexpReplacer("clean", [(r"[0-9]+", "<n>"), (r"[ \t]+", " ")]).run(raw_segments(_docs(spark, sf_dir))).select("doc_id", "text")


@query(r"SELECT doc_id, regexp_replace(regexp_replace(text, '[0-9]+', '<n>', 'g'), '[ \t]+', ' ', 'g') AS text FROM documents")
def regexp_replace_chain(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", cleaning.replace_patterns(F.col("text"), [(r"[0-9]+", "<n>"), (r"[ \t]+", " ")]).alias("text"))


@query()
def eds_clean(spark, sf_dir):
    cleaned = cleaning.EDSCleaner().run(raw_segments(_docs(spark, sf_dir)))
    return cleaned.select("doc_id", "text", "n_start", "n_end", F.size("spans").alias("n_spans"))


@query(
    r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages)
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g'), ' ') AS text FROM a"""
)
def page_text(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", cleaning.strip_tags(F.col("html")).alias("text"))


_ACCENTED = {c: d[0] for c in map(chr, range(0xC0, 0x180)) if len(d := unicodedata.normalize("NFD", c)) > 1 and d[0].isascii()}


@query(f"SELECT doc_id, translate(text, '{''.join(_ACCENTED)}', '{''.join(_ACCENTED.values())}') AS text FROM documents")
def ascii_fold(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", context.folded(F.col("text")).alias("text"))


@query("SELECT doc_id, trim(text, ' .,;?!' || chr(10)) AS text, CAST(length(text) - length(ltrim(text, ' .,;?!' || chr(10))) AS INTEGER) AS n_start FROM documents")
def strip_offsets(spark, sf_dir):
    text, start, _ = T.strip_columns(F.col("text"), F.lit(0), r" .,;?!\n")
    return _docs(spark, sf_dir).select("doc_id", text.alias("text"), start.alias("n_start"))


# Entities.


@query(
    f"""SELECT CAST(doc_id AS VARCHAR) AS doc_id, label, text, count(*) AS n FROM (
  SELECT doc_id, 'email' AS label, unnest(regexp_extract_all(text, '{EMAIL}')) AS text FROM documents UNION ALL
  SELECT doc_id, 'address', unnest(regexp_extract_all(text, '{IP}')) FROM documents) GROUP BY ALL"""
)
def entity_regexp(spark, sf_dir):
    rules = [matching.RegexpRule(EMAIL, "email"), matching.RegexpRule(IP, "address")]
    found = matching.RegexpMatcher(rules).run(raw_segments(_docs(spark, sf_dir)))
    return found.groupBy("doc_id", "label", "text").agg(F.count("*").alias("n"))


@query(
    """SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'licence' AS label, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)licen[sc]e')) FROM documents WHERE NOT regexp_matches(text, '(?i)apache')) GROUP BY doc_id"""
)
def entity_regexp_exclusion(spark, sf_dir):
    rule = matching.RegexpRule("licen[sc]e", "licence", case_sensitive=False, exclusion="apache")
    return matching.RegexpMatcher([rule]).run(raw_segments(_docs(spark, sf_dir))).groupBy("doc_id", "label").agg(F.count("*").alias("n"))


@query(f"""SELECT CAST(doc_id AS VARCHAR) AS doc_id, unnest(regexp_extract_all(text, '{IP}')) AS text, 'kinds:C01' AS value, 'C01' AS kb_id FROM documents""")
def entity_norms(spark, sf_dir):
    rule = matching.RegexpRule(IP, "address", norms=(matching.Norm("kinds", "C01"),))
    found = matching.RegexpMatcher([rule]).run(raw_segments(_docs(spark, sf_dir)))
    norms = attrs_of(found).where("norm IS NOT NULL").select("owner_id", "value", F.col("norm.kb_id").alias("kb_id"))
    return found.select("doc_id", F.col("uid").alias("owner_id"), "text").join(norms, "owner_id").drop("owner_id")


_NUMBERS_SQL = r"""p AS (SELECT doc_id, regexp_extract_all(text, '[0-9]+|[^0-9]+') AS x FROM documents),
u AS (SELECT doc_id, unnest(x) AS t, generate_subscripts(x, 1) AS i FROM p),
c AS (SELECT doc_id, t, sum(length(t)) OVER (PARTITION BY doc_id ORDER BY i) AS til FROM u),
numbers AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(til - length(t) AS INTEGER) AS n_start, CAST(til AS INTEGER) AS n_end, t AS text FROM c WHERE regexp_matches(t, '^[0-9]+$'))"""


def _numbers(spark, sf_dir):
    return matching.RegexpMatcher([matching.RegexpRule(NUMBER, "number")]).run(raw_segments(_docs(spark, sf_dir)))


@query(f"WITH {_NUMBERS_SQL} SELECT doc_id, n_start, n_end, text FROM numbers")
def kernel_chain(spark, sf_dir):
    """Five kernels in a row, the first of which changes the text: the numbers are found where the document has them."""
    anns = cleaning.CharReplacer("clean", {"’": "'", "œ": "oe", "ß": "ss"}).run(raw_segments(_docs(spark, sf_dir)))
    steps = [
        segmentation.SectionTokenizer({"licence": ["License", "Licence", "Copyright"], "contact": ["Contact", "email", "Email"]}), segmentation.SentenceTokenizer(),
        segmentation.SyntagmaTokenizer([r"\bmais\b", r"\band\b", r"\bund\b"]), matching.RegexpMatcher([matching.RegexpRule(NUMBER, "number")]),
    ]
    for step in steps:
        anns = step.run(anns)
    return anns.select("doc_id", "n_start", "n_end", "text")


@query(f"WITH {_NUMBERS_SQL} SELECT doc_id, n_start, n_end, text FROM numbers")
def entity_offsets(spark, sf_dir):
    return _numbers(spark, sf_dir).select("doc_id", "n_start", "n_end", "text")


@query()
def entity_dates(spark, sf_dir):
    found = matching.DateMatcher().run(raw_segments(_docs(spark, sf_dir)))
    return found.select("doc_id", "n_start", "n_end", "text", F.col("attrs")[0].value.alias("value"))


@query()
def entity_tnm(spark, sf_dir):
    found = matching.TNMMatcher().run(raw_segments(_docs(spark, sf_dir)))
    return found.select("doc_id", "n_start", "n_end", "text", F.col("attrs")[0].value.alias("value"))


_TERMS = ("thanthe", "tion", "verheit", "schland", "ement", "haat")


@query()
def entity_similar(spark, sf_dir):
    """Terms of a dictionary at or above a similarity, in the turns of all conversations."""
    rules = [matching.TermRule(t, "term", norms=(matching.Norm("list", str(i)),)) for i, t in enumerate(_TERMS)]
    found = matching.SimilarityMatcher(rules, threshold=0.6, max_length=15).run(_anns(_turn_rows(spark, sf_dir), "turn", "segment"))
    return found.select("doc_id", "n_start", "n_end", "text", F.col("attrs")[0].value.alias("value"))


@query()
def entity_keywords(spark, sf_dir):
    found = matching.KeywordMatcher([("the and", "pair", "K1"), ("and", "single", None)], window=3).run(raw_segments(_docs(spark, sf_dir)))
    return found.groupBy("doc_id", "label", "text").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CAST(greatest(p - 20, 0) AS INTEGER) AS n_start, substr(text, greatest(p - 20, 0) + 1, least(p + 1 + 40 - (p - greatest(p - 20, 0)), length(text)) - greatest(p - 20, 0)) AS snippet FROM (SELECT doc_id, text, strpos(text, '@') - 1 AS p FROM documents) WHERE p >= 0")
def snippets(spark, sf_dir):
    rows = _docs(spark, sf_dir).withColumn("p", F.instr("text", "@") - 1).where("p >= 0")
    return rows.select("doc_id", F.greatest(F.col("p") - 20, F.lit(0)).alias("n_start"), snippet(F.col("text"), F.col("p"), F.col("p") + 1, 40).alias("snippet"))


# Turns of conversations as sections, segments and entities.

_TURNS_SQL = """turns AS (SELECT conv_id, turn, role, text, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS n_start FROM conversations)"""


def _turns(spark, sf_dir):
    return audio.transcript_offsets(_table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


def _turn_rows(spark, sf_dir):
    return _turns(spark, sf_dir).select(F.col("conv_id").alias("doc_id"), F.concat_ws("-", "conv_id", "turn").alias("uid"), "text", "n_start", "n_end", F.col("turn").alias("seq"))


@query(f"WITH {_TURNS_SQL} SELECT conv_id, turn, n_start, CAST(n_start + length(text) AS INTEGER) AS n_end FROM turns")
def transcript_offsets(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", "n_start", "n_end")


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def transcript_texts(spark, sf_dir):
    return audio.join_transcripts(_table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query(f'WITH {_TURNS_SQL}, w AS (SELECT *, sum(length(text) + 1) OVER (PARTITION BY conv_id) AS total FROM turns) SELECT conv_id AS doc_id, n_start AS "start", CAST(coalesce(lead(n_start) OVER (PARTITION BY conv_id ORDER BY n_start), total) AS INTEGER) AS "end" FROM w')
def section_windows(spark, sf_dir):
    t = _turns(spark, sf_dir)
    rows = t.select(F.col("conv_id").alias("doc_id"), F.col("n_start").alias("start"), F.sum(F.length("text") + 1).over(Window.partitionBy("conv_id")).cast("int").alias("length"))
    return segmentation.section_bounds(rows).select("doc_id", "start", "end")


@query("SELECT conv_id AS doc_id, turn AS \"start\", CASE WHEN role = 'user' AND max(role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) THEN 'question' ELSE role END AS name FROM conversations")
def section_rename(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("start"), F.col("role").alias("name"))
    return segmentation.rename_sections(rows, segmentation.RenameRule("user", "question", ("assistant",)))


@query("SELECT CAST(conv_id AS VARCHAR) AS doc_id, source_id, target_id FROM (SELECT conv_id, conv_id || '-' || turn AS source_id, lead(conv_id || '-' || turn) OVER (PARTITION BY conv_id ORDER BY turn) AS target_id FROM conversations) WHERE target_id IS NOT NULL")
def relations_adjacent(spark, sf_dir):
    rows = _anns(_turn_rows(spark, sf_dir), "turn").withColumn("parent_uid", F.col("doc_id"))
    return intervals.adjacent_pairs(rows)


@query("SELECT conv_id AS doc_id, 'T' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) || chr(9) || 'turn ' || n_start || ' ' || (n_start + length(text)) || chr(9) || text AS line FROM turns".replace("FROM turns", "FROM (WITH " + _TURNS_SQL + " SELECT * FROM turns)").replace("SELECT conv_id AS doc_id", "SELECT CAST(conv_id AS VARCHAR) AS doc_id"))
def brat_lines(spark, sf_dir):
    return brat.entity_lines(_anns(_turn_rows(spark, sf_dir), "turn"))


@query()
def brat_files(spark, sf_dir):
    docs = audio.join_transcripts(_table(spark, sf_dir, "conversations"), "conv_id", "turn", "text").withColumnRenamed("conv_id", "doc_id")
    return brat.render(docs, _anns(_turn_rows(spark, sf_dir), "turn"))


@query(f"WITH {_TURNS_SQL}, d AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM turns GROUP BY conv_id) SELECT CAST(conv_id AS VARCHAR) AS doc_id, '{{\"text\":' || CAST(to_json(d.text) AS VARCHAR) || ',\"label\":[' || string_agg('[' || n_start || ', ' || (n_start + length(turns.text)) || ', \"turn\"]', ', ' ORDER BY turn) || ']}}' AS line FROM turns JOIN d USING (conv_id) GROUP BY conv_id, d.text")
def doccano_json(spark, sf_dir):
    docs = audio.join_transcripts(_table(spark, sf_dir, "conversations"), "conv_id", "turn", "text").withColumnRenamed("conv_id", "doc_id")
    return exchange.doccano_lines(docs, _anns(_turn_rows(spark, sf_dir), "turn"), task="sequence_labeling")


def _spoken(spark, sf_dir):
    """Turns with times: 0.05 seconds a character."""
    return _turns(spark, sf_dir).select("conv_id", "turn", F.col("role").alias("speaker"), "text", (F.col("n_start") * 0.05).alias("start"), (F.col("n_end") * 0.05).alias("end"))


_CLOCK = "printf('%02d:%02d:%02d,%03d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000)"


@query(f"WITH {_TURNS_SQL} SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS idx, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS VARCHAR) || chr(10) || {_CLOCK.format('(n_start * 50)')} || ' --> ' || {_CLOCK.format('((n_start + length(text)) * 50)')} || chr(10) || text || chr(10) AS block FROM turns")
def srt_text(spark, sf_dir):
    return exchange.subtitle_blocks(_spoken(spark, sf_dir), "conv_id")


@query(f"WITH {_TURNS_SQL} SELECT conv_id AS file_id, n_start * 0.05 AS \"start\", 'SPEAKER ' || conv_id || ' 1 ' || printf('%.3f', n_start * 0.05) || ' ' || printf('%.3f', length(text) * 0.05) || ' <NA> <NA> ' || role || ' <NA> <NA>' AS line FROM turns".replace("n_start * 0.05 AS", "round(CAST(n_start AS DOUBLE) * 0.05, 3) AS"))
def rttm_rows(spark, sf_dir):
    rows = exchange.turn_lines(_spoken(spark, sf_dir).withColumn("conv", F.col("conv_id").cast("string")), "conv")
    return rows.select(F.col("file_id").cast("long").alias("file_id"), F.round("start", 3).alias("start"), "line")


# Interval joins: chunks of 300 characters against lines.

_LINES_SQL = r"""l0 AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents),
l1 AS (SELECT doc_id, unnest(x) AS t, generate_subscripts(x, 1) AS i FROM l0),
l2 AS (SELECT doc_id, i, t, sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS til FROM l1),
lines AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, doc_id || 'L' || (i - 1) AS uid, til - 1 - length(t) AS s, til - 1 AS e FROM l2 WHERE t <> ''),
chunks AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, doc_id || 'C' || k AS uid, k * 300 AS s, least(k * 300 + 300, length(text)) AS e FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 300.0) AS BIGINT))) AS k FROM documents))"""


def _lines(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "text"))
    order = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("n_start", F.coalesce(F.sum(F.length("text") + 1).over(order), F.lit(0)).cast("int")).where("text <> ''")
    return _anns(rows.select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("L"), F.col("seq").cast("string")).alias("uid"), "text", "n_start", (F.col("n_start") + F.length("text")).alias("n_end"), "seq"), "line", "segment")


def _chunks(spark, sf_dir):
    rows = _docs(spark, sf_dir).where(F.length("text") > 0).select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.ceil(F.length("text") / 300.0).cast("int") - 1)).alias("seq"))
    attr = F.from_json(F.to_json(F.struct(F.concat(F.lit("a"), F.col("doc_id").cast("string"), F.lit("C"), F.col("seq").cast("string")).alias("uid"), F.lit("Attribute").alias("attr_class"), F.lit("chunk").alias("label"), F.col("seq").cast("string").alias("value"), F.lit("int").alias("value_type"))), ATTR)
    rows = rows.select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("C"), F.col("seq").cast("string")).alias("uid"), F.lit("").alias("text"), (F.col("seq") * 300).alias("n_start"), F.least(F.col("seq") * 300 + 300, F.length("text")).alias("n_end"), "seq", F.array(attr).alias("attrs"))
    return _anns(rows, "chunk", "segment")


@query(f"WITH {_LINES_SQL} SELECT c.doc_id, c.uid AS left_uid, l.uid AS right_uid FROM chunks c JOIN lines l ON c.doc_id = l.doc_id AND c.s < l.e AND c.e > l.s")
def overlap_join(spark, sf_dir):
    return intervals.overlap_pairs(_chunks(spark, sf_dir), _lines(spark, sf_dir)).select("doc_id", "left_uid", "right_uid")


@query(f"WITH {_LINES_SQL} SELECT c.doc_id, c.uid AS left_uid, l.uid AS right_uid FROM chunks c JOIN lines l ON c.doc_id = l.doc_id AND c.s < l.e AND c.e > l.s")
def overlap_join_binned(spark, sf_dir):
    return intervals.overlap_pairs(_chunks(spark, sf_dir), _lines(spark, sf_dir), bin_size=1000).select("doc_id", "left_uid", "right_uid")


@query(f"WITH {_LINES_SQL} SELECT c.doc_id, c.uid, CAST(count(l.uid) AS INTEGER) AS n_children FROM chunks c LEFT JOIN lines l ON c.doc_id = l.doc_id AND c.s < l.e AND c.e > l.s GROUP BY ALL")
def nested_segments(spark, sf_dir):
    return intervals.nested_segments(_chunks(spark, sf_dir), _lines(spark, sf_dir)).select("doc_id", "uid", F.size("children").alias("n_children"))


@query(f"WITH {_LINES_SQL} SELECT c.doc_id, l.uid AS owner_id, 'chunk' AS label, split_part(c.uid, 'C', 2) AS value, 'a' || c.uid AS source_uid FROM chunks c JOIN lines l ON c.doc_id = l.doc_id AND c.s < l.e AND c.e > l.s")
def attr_duplicate(spark, sf_dir):
    return intervals.duplicate_attrs(_chunks(spark, sf_dir), _lines(spark, sf_dir), ["chunk"]).select("doc_id", "owner_id", "label", "value", "source_uid")


@query()
def overlap_filter(spark, sf_dir):
    """Numbers, addresses and their like overlap; the longest stay."""
    rules = [matching.RegexpRule(NUMBER, "number"), matching.RegexpRule(r"[0-9]+[.,-][0-9]+", "pair"), matching.RegexpRule(IP, "address")]
    found = matching.RegexpMatcher(rules).run(raw_segments(_docs(spark, sf_dir)))
    return intervals.keep_longest(found).select("doc_id", "label", "n_start", "n_end")


@query("SELECT doc_id, CAST(s AS INTEGER) AS n_start, CAST(e AS INTEGER) AS n_end FROM (SELECT doc_id, length(text) // 2 AS m, length(text) AS n FROM documents WHERE length(text) >= 4) t, LATERAL (SELECT 0 AS s, m AS e UNION ALL SELECT m + 1, n) x")
def span_normalize(spark, sf_dir):
    """A plain span and one that stands for two stretches, of which one touches it."""
    rows = _docs(spark, sf_dir).where(F.length("text") >= 4).select("doc_id", (F.floor(F.length("text") / 2)).cast("int").alias("m"), F.length("text").alias("n"))
    stretch = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    plain = F.struct(F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit(None).cast("int").alias("length"), F.lit(None).cast(f"array<{RANGE}>").alias("replaced"))
    mod = F.struct(F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.lit(2).alias("length"), F.array(stretch(F.col("m") + 1, F.col("n")), stretch(F.lit(1), F.col("m"))).alias("replaced"))
    return rows.select("doc_id", F.explode(normalize_column(F.array(mod, plain))).alias("s")).select("doc_id", F.col("s.start").alias("n_start"), F.col("s.end").alias("n_end"))


# Pipelines, keys, provenance.


def _keyed(spark, sf_dir):
    long = kernel.Filter("long", F.col("n_end") > 2000)
    digits = kernel.Filter("digits", F.col("text").rlike("[0-9]"))
    steps = [pipeline.PipelineStep(long, ["raw"], ["kept"]), pipeline.PipelineStep(digits, ["raw"], ["kept"]), pipeline.PipelineStep(long, ["kept"], ["final"])]
    made = pipeline.Pipeline(steps, ["raw"], ["kept", "final"])
    made.check_sanity()
    return made.run(raw_segments(_docs(spark, sf_dir)))


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'kept' AS keys FROM documents WHERE length(text) > 2000 UNION ALL SELECT CAST(doc_id AS VARCHAR), 'kept' FROM documents WHERE regexp_matches(text, '[0-9]')")
def keys_union(spark, sf_dir):
    return _keyed(spark, sf_dir)[0].select("doc_id", F.array_join("keys", ",").alias("keys"))


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'kept,final' AS keys FROM documents WHERE length(text) > 2000 UNION ALL SELECT CAST(doc_id AS VARCHAR), 'kept,final' FROM documents WHERE length(text) > 2000 AND regexp_matches(text, '[0-9]')")
def keys_intersect(spark, sf_dir):
    return _keyed(spark, sf_dir)[1].select("doc_id", F.array_join("keys", ",").alias("keys"))


def _traced(spark, sf_dir):
    """Sentences, then numbers in them, with their provenance."""
    tokens, numbers = segmentation.SentenceTokenizer(), matching.RegexpMatcher([matching.RegexpRule(NUMBER, "number")])
    made = pipeline.Pipeline([pipeline.PipelineStep(tokens, ["raw"], ["s"]), pipeline.PipelineStep(numbers, ["s"], ["n"])], ["raw"], ["n"])
    outputs, steps = made.trace(raw_segments(_docs(spark, sf_dir)))
    return outputs, provenance.edge_table(steps)


_uid_sql = "substr(sha256({0} || chr(0) || {1} || chr(0) || {2}), 1, 32)".format
_RAW_UID = "substr(sha256('RAW_TEXT' || chr(0) || CAST(doc_id AS VARCHAR)), 1, 32)"
_SENTENCE_OP, _NUMBER_OP = segmentation.SentenceTokenizer().op_id, matching.RegexpMatcher([matching.RegexpRule(NUMBER, "number")]).op_id


@query(
    f"""WITH a AS (SELECT {_RAW_UID} AS raw, {SENTENCES_SQL} AS s FROM documents), b AS (SELECT raw, unnest(s) AS t, generate_subscripts(s, 1) - 1 AS i FROM a),
c AS (SELECT raw, t, {_uid_sql(f"'{_SENTENCE_OP}'", "raw", "i")} AS sentence FROM b), d AS (SELECT sentence, regexp_extract_all(t, '{NUMBER}') AS x FROM c), e AS (SELECT sentence, generate_subscripts(x, 1) - 1 AS i FROM d)
SELECT 'annotation' AS kind, '{_SENTENCE_OP}' AS op_id, raw AS source_uid, sentence AS item_uid FROM c UNION ALL SELECT 'annotation', '{_NUMBER_OP}', sentence, {_uid_sql(f"'{_NUMBER_OP}'", "sentence", "i")} FROM e"""
)
def prov_edges(spark, sf_dir):
    return _traced(spark, sf_dir)[1].select("kind", "op_id", "source_uid", "item_uid")


@query(f"WITH s AS (SELECT doc_id, unnest({SENTENCES_SQL}) AS s FROM documents) SELECT substr(sha256('RAW_TEXT' || chr(0) || CAST(doc_id AS VARCHAR)), 1, 32) AS root_uid, count(*) AS n FROM (SELECT doc_id, 1 FROM s UNION ALL SELECT doc_id, 2 FROM (SELECT doc_id, unnest(regexp_extract_all(s, '{NUMBER}')) FROM s)) GROUP BY doc_id")
def prov_roots(spark, sf_dir):
    return provenance.roots(_traced(spark, sf_dir)[1], 2).groupBy("root_uid").agg(F.count("*").alias("n"))


# Metrics.


def _raters(spark, sf_dir):
    labels = _table(spark, sf_dir, "labels")
    return labels.select(F.col("quality").cast("string").alias("truth"), F.col("toxic").cast("string").alias("predicted"))


_PAIRS = "pairs AS (SELECT CAST(quality AS VARCHAR) AS truth, CAST(toxic AS VARCHAR) AS predicted FROM labels)"
_COUNTS = f"""{_PAIRS}, classes AS (SELECT truth AS label FROM pairs UNION SELECT predicted FROM pairs),
counts AS (SELECT label, (SELECT count(*) FROM pairs WHERE truth = label AND predicted = label) AS tp, (SELECT count(*) FROM pairs WHERE predicted = label) AS pn, (SELECT count(*) FROM pairs WHERE truth = label) AS sn FROM classes),
scores AS (SELECT *, coalesce(tp / nullif(pn, 0), 0) AS p, coalesce(tp / nullif(sn, 0), 0) AS r FROM counts),
f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM scores)"""


@query(f"WITH {_COUNTS} SELECT 'overall' AS label, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(f), 6) AS f1, round(sum(tp) / sum(sn), 6) AS accuracy, CAST(sum(sn) AS BIGINT) AS support FROM f UNION ALL SELECT label, round(p, 6), round(r, 6), round(f, 6), NULL, sn FROM f")
def classification_report(spark, sf_dir):
    return metrics.classification_report(_raters(spark, sf_dir))


@query(f"WITH {_COUNTS} SELECT round(1 - (1 - sum(tp) / sum(sn)) / (1 - sum(pn * sn) / (sum(sn) * sum(sn))), 6) AS kappa, CAST(sum(sn) AS BIGINT) AS support FROM f")
def cohen_kappa(spark, sf_dir):
    return metrics.cohen_kappa(_raters(spark, sf_dir))


@query("""WITH r AS (SELECT doc_id AS unit, CAST(quality AS VARCHAR) AS v FROM labels UNION ALL SELECT doc_id, CAST(toxic AS VARCHAR) FROM labels),
c AS (SELECT unit, v, count(*) AS n FROM r WHERE v IS NOT NULL GROUP BY ALL), u AS (SELECT unit, sum(n) AS nu FROM c GROUP BY unit HAVING sum(n) >= 2),
o AS (SELECT sum(a.n * b.n / (nu - 1)) AS d FROM c a JOIN c b ON a.unit = b.unit AND a.v <> b.v JOIN u ON a.unit = u.unit),
t AS (SELECT v, sum(n) AS nc FROM c JOIN u USING (unit) GROUP BY v)
SELECT round(1 - (sum(nc) - 1) * any_value(d) / (sum(nc) * sum(nc) - sum(nc * nc)), 6) AS alpha, CAST(sum(nc) AS BIGINT) AS n_values, count(*) AS n_labels FROM t, o""")
def krippendorff(spark, sf_dir):
    labels = _table(spark, sf_dir, "labels")
    rated = metrics.annotator_ratings([labels.select("doc_id", F.col("quality").alias("label")), labels.select("doc_id", F.col("toxic").alias("label"))])
    return metrics.krippendorff_alpha(rated)


def _sized(numbers: DataFrame) -> DataFrame:
    return numbers.withColumn("label", F.when(F.length("text") < 3, "short").otherwise("long"))


@query(f"""WITH {_NUMBERS_SQL}, t AS (SELECT *, CASE WHEN length(text) < 3 THEN 'short' ELSE 'long' END AS label FROM numbers), q AS (SELECT * FROM t WHERE length(text) >= 2),
k AS (SELECT label, (SELECT count(*) FROM q WHERE q.label = l.label) AS tp, (SELECT count(*) FROM t WHERE t.label = l.label) AS sn FROM (SELECT DISTINCT label FROM t) l),
s AS (SELECT *, CASE WHEN tp > 0 THEN 1.0 ELSE 0 END AS pr, tp / sn AS re FROM k), f AS (SELECT *, coalesce(2 * pr * re / nullif(pr + re, 0), 0) AS f FROM s)
SELECT 'overall' AS label, round(avg(pr), 6) AS precision, round(avg(re), 6) AS recall, round(avg(f), 6) AS f1, CAST(sum(sn) AS BIGINT) AS support FROM f UNION ALL SELECT label, round(pr, 6), round(re, 6), round(f, 6), sn FROM f""")
def ner_prf(spark, sf_dir):
    truth = _sized(_numbers(spark, sf_dir))
    return metrics.entity_scores(truth, truth.where(F.length("text") >= 2))


@query(f"""WITH {_NUMBERS_SQL}, places AS (SELECT *, unnest(range(n_start, n_end)) AS pos FROM numbers)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, CASE WHEN n_end - n_start = 1 THEN 'U' WHEN pos = n_start THEN 'B' WHEN pos = n_end - 1 THEN 'L' ELSE 'I' END || '-number' AS tag FROM places""")
def bilou_tags(spark, sf_dir):
    return metrics.character_tags(_numbers(spark, sf_dir)).select("doc_id", "pos", "tag")


@query(f"WITH {_NUMBERS_SQL} SELECT doc_id, n_start, n_end, 'number' AS label FROM numbers")
def tag_chunks(spark, sf_dir):
    return metrics.chunks_of_tags(metrics.character_tags(_numbers(spark, sf_dir))).select("doc_id", "n_start", "n_end", "label")


@query(f"WITH {_NUMBERS_SQL} SELECT round(1 - (SELECT sum(length(text)) FROM numbers WHERE length(text) < 2) / (SELECT sum(length(text)) FROM documents), 6) AS accuracy, CAST((SELECT sum(length(text)) FROM documents) AS BIGINT) AS n_tags")
def tag_accuracy(spark, sf_dir):
    truth = _numbers(spark, sf_dir)
    return metrics.tag_accuracy(_docs(spark, sf_dir).select("doc_id", F.length("text").alias("length")), truth, truth.where(F.length("text") >= 2))


@query("WITH c AS (SELECT event_type, json_extract_string(props, '$.k') AS value, count(*) AS n, min(event_id) AS first FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY ALL) SELECT event_type, value, n FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, first) AS r FROM c) WHERE r <= 5")
def top_values_by_attr(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").alias("value"))
    return metrics.top_values(rows, "event_type", "value", 5, "event_id")


# Dictionaries and similarity.

_GRAMS = "list_distinct(list_transform(range(1, greatest(length({0}) - least(3, length({0})) + 1, 1) + 1), lambda i: substr({0}, i, least(3, length({0})))))"
_WORDS_SQL = r"""cand AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+'))) AS text FROM conversations), term AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+'))) AS term FROM benchmark)"""


def _distinct_words(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("w")).select(F.lower("w").alias(name)).distinct()


@query(
    f"""WITH {_WORDS_SQL}, a AS (SELECT text, translate(text, 'éèêàçùôîïäöüâûëáíóúñ', 'eeeacuoiiaouaueaioun') AS f, {_GRAMS.format("translate(text, 'éèêàçùôîïäöüâûëáíóúñ', 'eeeacuoiiaouaueaioun')")} AS g FROM cand),
b AS (SELECT term, {_GRAMS.format("translate(term, 'éèêàçùôîïäöüâûëáíóúñ', 'eeeacuoiiaouaueaioun')")} AS h FROM term),
p AS (SELECT text, term, len(list_intersect(g, h)) AS c, len(g) + len(h) AS n FROM a JOIN b ON len(g) * 0.7 <= len(h) AND len(h) * 0.7 <= len(g))
SELECT text, term, round(c / (n - c), 6) AS score FROM p WHERE round(c / (n - c), 6) >= 0.7"""
)
def fuzzy_match(spark, sf_dir):
    return matching.fuzzy_join(_distinct_words(_table(spark, sf_dir, "conversations"), "text"), _distinct_words(_table(spark, sf_dir, "benchmark"), "term"), 0.7)


@query(f"SELECT p_name AS a, p_type AS b, round(len(list_intersect(g, h)) / (len(g) + len(h) - len(list_intersect(g, h))), 6) AS score FROM (SELECT DISTINCT p_name, p_type, {_GRAMS.format('lower(p_name)')} AS g, {_GRAMS.format('lower(p_type)')} AS h FROM part)")
def trigram_jaccard(spark, sf_dir):
    pairs = _table(spark, sf_dir, "part").select("p_name", "p_type").distinct()
    score = T.similarity_column(T.ngrams_column(F.lower("p_name")), T.ngrams_column(F.lower("p_type")))
    return pairs.select(F.col("p_name").alias("a"), F.col("p_type").alias("b"), F.round(score, 6).alias("score"))


@query(r"""WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM conversations), n AS (SELECT *, unnest([1, 2, 3]) AS n FROM w)
SELECT key, n, candidate, count(*) AS times FROM (SELECT conv_id || '-' || turn AS key, CAST(n AS INTEGER) AS n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS candidate FROM n WHERE len(w) >= n) GROUP BY ALL""")
def ngram_candidates(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("key"), "text")
    return matching.ngram_candidates(rows, 3, "key").select("key", "n", "candidate", "times")


@query("""WITH e AS (SELECT p_partkey, 'C' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS cui, CASE WHEN p_partkey % 3 = 0 THEN 'FRE' ELSE 'ENG' END AS lang, p_brand || '-' || p_size AS lui, p_name AS term, p_type AS source FROM part)
SELECT lui, cui, term, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY lui ORDER BY p_partkey) AS r FROM e WHERE lang = 'ENG') WHERE r = 1""")
def umls_entries(spark, sf_dir):
    """A terminology file written from the parts, and of each lexical unit its first entry."""
    part = _table(spark, sf_dir, "part").withColumn("lang", F.when(F.col("p_partkey") % 3 == 0, "FRE").otherwise("ENG"))
    none = F.lit("")
    fields = [F.concat(F.lit("C"), F.lpad(F.col("p_partkey").cast("string"), 7, "0")), F.col("lang"), none, F.concat_ws("-", "p_brand", F.col("p_size").cast("string")), *[none] * 7, F.col("p_type"), none, none, F.col("p_name"), none]
    path = f"{shared_folder(spark)}/entries-{uuid.uuid4().hex}"
    part.repartitionByRange(1, "p_partkey").sortWithinPartitions("p_partkey").select(F.concat_ws("|", *fields).alias("value")).write.text(path)
    return terminologies.load_entries(spark, path, languages=["ENG"]).select("lui", "cui", "term", "source", "lang")


@query()
def umls_join(spark, sf_dir):
    """Words of the benchmark as a terminology, found in the turns of the conversations."""
    words = _distinct_words(_table(spark, sf_dir, "benchmark"), "term").where(F.length("term") > 6)
    entries = words.select(F.concat(F.lit("C"), F.substring(F.sha2("term", 256), 1, 7)).alias("cui"), "term", F.array(F.lit("DISO")).alias("semgroups"))
    found = matching.TerminologyJoin(0.8).run(_anns(_turn_rows(spark, sf_dir), "turn", "segment"), entries)
    return found.select("doc_id", "parent_uid", "n_start", "n_end", "text", "label", F.col("attrs")[0].value.alias("value"))


@query("SELECT p_brand, p_partkey, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part) WHERE r = 1")
def umls_first_per_lui(spark, sf_dir):
    return terminologies.first_per_key(_table(spark, sf_dir, "part"), "p_brand", "p_partkey").select("p_brand", "p_partkey", "p_name")


@query("""WITH s AS (SELECT a.vec_id AS entity_id, b.vec_id AS term_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 4) AS score FROM embeddings a, embeddings b)
SELECT entity_id, term_id, score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY score DESC, term_id) AS r FROM s) WHERE r <= 5""")
def embedding_topk(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings")
    return matching.link_embeddings(e, e, 5)


# Duplicates.


@query("SELECT doc_id, source_doc_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS source_doc_id FROM documents WHERE text IS NOT NULL) WHERE doc_id > source_doc_id")
def dup_exact(spark, sf_dir):
    return duplicates.exact_copies(_docs(spark, sf_dir))


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT line, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS first_doc FROM l WHERE length(line) >= 5 GROUP BY line HAVING count(DISTINCT doc_id) > 1")
def dup_lines(spark, sf_dir):
    lines = duplicates.line_occurrences(_docs(spark, sf_dir))
    return lines.groupBy("line").agg(F.countDistinct("doc_id").alias("n_docs"), F.min("doc_id").alias("first_doc")).where("n_docs > 1")


@query()
def dup_shingle(spark, sf_dir):
    return duplicates.first_occurrences(_docs(spark, sf_dir))


@query()
def dup_finder(spark, sf_dir):
    """What a turn shares with earlier ones of its conversation."""
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("collection_id"), F.concat_ws("-", "conv_id", "turn").alias("doc_id"), F.lpad(F.col("turn").cast("string"), 10, "0").alias("date"), "text")
    found = duplicates.DuplicateFinder(segments_to_output="both").run(turns, order_by="date")
    return found.select("doc_id", "n_start", "n_end", F.col("attrs")[0].value.alias("is_duplicate"), F.col("attrs")[0].metadata["source_doc_id"].alias("source_doc_id"))


# Signals (an embedding read as two channels of 32 samples).


def _signals(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("uid"), F.array(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)).alias("signal"), F.lit(16).alias("sample_rate"))


@query("SELECT vec_id AS uid, round(list_sum(list_transform(range(1, 33), lambda i: (CAST(embedding[i] AS DOUBLE) + CAST(embedding[i + 32] AS DOUBLE)) / 2)), 4) AS total, 32 AS n FROM embeddings")
def audio_downmix(spark, sf_dir):
    mono = audio.downmix(F.col("signal"))
    total = F.aggregate(mono[0], F.lit(0.0), lambda a, x: a + x)
    return _signals(spark, sf_dir).select("uid", F.round(total, 4).alias("total"), F.size(mono[0]).alias("n"))


@query("SELECT vec_id AS uid, round(list_aggregate(e, 'max') / (list_aggregate(e, 'stddev_pop') + 1e-12), 4) AS peak FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)")
def audio_power(spark, sf_dir):
    scaled = audio.normalize_power(F.col("signal"))
    return _signals(spark, sf_dir).select("uid", F.round(F.array_max(F.flatten(scaled)), 4).alias("peak"))


@query("SELECT vec_id AS uid, round(CAST(embedding[9] AS DOUBLE), 6) AS first_sample, 16 AS n FROM embeddings")
def audio_trim(spark, sf_dir):
    cut = audio.trim(F.col("signal"), F.col("sample_rate"), F.lit(0.5), F.lit(1.5))
    return _signals(spark, sf_dir).select("uid", F.round(cut[0][0].cast("double"), 6).alias("first_sample"), F.size(cut[0]).alias("n"))


@query()
def audio_resample(spark, sf_dir):
    return audio.Resampler(8).run(_signals(spark, sf_dir)).select("uid", "sample_rate", F.size(F.col("signal")[0]).alias("n"))


@query()
def audio_voice(spark, sf_dir):
    mono = _signals(spark, sf_dir).withColumn("signal", audio.downmix(F.col("signal")))
    return audio.VoiceDetector(frame_seconds=0.125, window_frames=4, checked_rates=None).run(mono).select("uid", "start", "end")


@query(f"WITH {_TURNS_SQL}, a AS (SELECT conv_id, turn, n_start AS s, n_start + length(text) AS e FROM turns) SELECT x.conv_id, x.turn, count(*) AS n FROM a x JOIN a y ON x.conv_id = y.conv_id AND x.s - 10 < y.e AND x.e + 10 > y.s GROUP BY ALL")
def audio_spans_of_text(spark, sf_dir):
    """Stretches of sound that a stretch of text, 10 characters wider than its turn, comes from."""
    t = _turns(spark, sf_dir).select(F.col("conv_id"), "turn", "n_start", "n_end")
    wide = t.select("conv_id", "turn", (F.col("n_start") - 10).alias("t_start"), (F.col("n_end") + 10).alias("t_end"))
    known = t.select("conv_id", F.col("n_start").alias("t_start"), F.col("n_end").alias("t_end"), (F.col("n_start") * 0.05).alias("a_start"), (F.col("n_end") * 0.05).alias("a_end"))
    return audio.audio_spans(wide, known, "conv_id").groupBy("conv_id", "turn").agg(F.count("*").alias("n"))


# Events: the batch form of the streaming plans.


@query("SELECT event_type, date_trunc('hour', ts) AS window_start, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def events_tumbling(spark, sf_dir):
    from marginalia.streaming import tumbling

    return tumbling(_table(spark, sf_dir, "events"), "1 hour")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k""")
def events_sessions(spark, sf_dir):
    from marginalia.streaming import sessions

    return sessions(_table(spark, sf_dir, "events"), "30 minutes")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') || '-??' AS shown FROM orders")
def partial_dates(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    return o.select("o_orderkey", dates.date_column(F.year("o_orderdate"), F.month("o_orderdate"), F.lit(None).cast("int")).alias("shown"))

"""Catalogue of the engine's queries, each with an oracle in DuckDB SQL where SQL can say it.

Two inputs: lines of ``documents`` (real spans, few of them) and ``talk``, a small
transcript written from every row of ``customer`` by one SQL text that both engines
run.  Where spans come from ``talk``, the oracle is arithmetic on the parts the
text was put together from, so it checks the patterns without repeating them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import spans as S
from spanloom.operators import eta, evaluate, evidence, identity, manifests, model, rank, resolve, review, rules
from spanloom.operators.detect import detect
from spanloom.policy import Policy, parse_policy
from spanloom.schemas import FINDING_COLUMNS
from spanloom.sources.segments import from_conversations, from_documents, summary

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _ORACLES[f.__name__] = sql
        return f

    return register


# --- inputs ------------------------------------------------------------------------------

FIRST_NAMES = "Anna,Boris,Clara,Doris,Emil,Frida,Gerd,Heike"
LAST_NAMES = "Albers,Brandt,Claasen,Dietz,Ehlers,Funke,Gruber,Hansen"
TALK = f"""
SELECT 'c' || CAST(k AS STRING) AS doc_id, n AS seg_no, 's00000' || CAST(n AS STRING) AS segment_id,
  CASE n WHEN 1 THEN fn || ' ' || ln || ': Guten Tag, hier spricht die Zentrale.'
         WHEN 2 THEN 'meine Kundennummer: KD-' || kk || ' und mein Depot-Nr. DP' || kk || '. Danke.'
         WHEN 3 THEN 'Kontonummer: ' || kk || ', erreichbar unter 030 ' || kp || ' ab acht.'
         WHEN 4 THEN 'IBAN ' || iban || '. Danke.'
         WHEN 5 THEN 'Ich fragte ' || fn || ' ' || ln || ' heute; Herr ' || ln || ' sagt ja.'
         ELSE 'Beleg B' || CAST(k + 1000000 AS STRING) || 'X liegt vor.' END AS text,
  k, n, fn, ln, kk, kp, iban
FROM (SELECT k, fn, ln, CAST(k + 100000 AS STRING) AS kk, lpad(CAST(k AS STRING), 7, '0') AS kp,
        'DE' || lpad(CAST(98 - k % 2 - ((bban % 97) * 27 + 62) % 97 AS STRING), 2, '0') || CAST(bban AS STRING) AS iban
      FROM (SELECT c_custkey AS k, 370400440000000000 + c_custkey * 7919 AS bban,
              split_part('{FIRST_NAMES}', ',', CAST(c_custkey % 8 + 1 AS INT)) AS fn,
              split_part('{LAST_NAMES}', ',', CAST(CAST(floor(c_custkey / 8) AS BIGINT) % 8 + 1 AS INT)) AS ln
            FROM customer) AS a) AS b
CROSS JOIN (VALUES (1), (2), (3), (4), (5), (6)) AS v(n)
"""
_TALK = f"talk AS ({TALK})"
_SEG = """seg AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, i AS seg_no, 's' || lpad(CAST(i AS VARCHAR), 6, '0') AS segment_id, lines[i] AS text
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL)))"""
ALIASES = {"p1": ["Anna Albers"], "p2": ["Doris Dietz", "Frida"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TALK.replace("FROM customer", "FROM {customer}"), customer=table(spark, sf_dir, "customer"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _longs(df: DataFrame, *columns: str) -> DataFrame:
    """Counts and offsets as longs, which is what SQL has."""
    whole = [f.name for f in df.schema.fields if f.dataType.simpleString() == "int" or f.name in columns]
    return df.select(*[F.col(c).cast("long").alias(c) if c in whole else F.col(c) for c in df.columns])


def micro(score: Column) -> Column:
    return F.round(score * 1_000_000).cast("long")


# Patterns without look-around, which both engines read alike.
SPOTS = {
    "p:email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "email", 0.99, False),
    "p:handle": (r"@[A-Za-z0-9.-]+", "username", 0.6, False),
    "p:local": (r"[A-Za-z0-9._%+-]+@", "person", 0.5, False),
    "p:ip": (r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "ip_address", 0.9, False),
    "p:number": (r"[0-9]{1,3}\.[0-9]{1,3}", "phone", 0.4, True),
}


def duck_spans(source: str, pattern: str, extra: str = "") -> str:
    """SELECT doc_id, segment_id, start, end, text of a pattern's matches in a relation's text."""
    p = pattern.replace("'", "''")
    size = lambda x: f"coalesce(list_sum(list_transform({x}, lambda y: length(y))), 0)"
    return f"""SELECT doc_id, segment_id, CAST(a AS BIGINT) AS start, CAST(a + length(t) AS BIGINT) AS "end", t AS text{extra} FROM (
      SELECT doc_id, segment_id, m[i] AS t, {size("g[1:i]")} + {size("m[1:i - 1]")} AS a FROM (
        SELECT doc_id, segment_id, m, regexp_split_to_array(text, '{p}') AS g, unnest(range(1, len(m) + 1)) AS i FROM (
          SELECT doc_id, segment_id, text, regexp_extract_all(text, '{p}') AS m FROM {source}) WHERE len(m) > 0))"""


_SPOTTED = "spotted AS (" + " UNION ALL ".join(
    duck_spans("seg", p, f", '{c}' AS category, CAST({s} AS DOUBLE) AS score, '{d}' AS detector, {str(r).lower()} AS review_only") for d, (p, c, s, r) in SPOTS.items()
) + ")"


def spotted(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = lines(spark, sf_dir)
    out = None
    for detector, (pattern, category, score, only) in SPOTS.items():
        rows = rules.pattern_findings(seg, pattern, category, score, detector).withColumn("review_only", F.lit(only))
        out = rows if out is None else out.unionByName(rows)
    return out


_SPAN = 'doc_id, segment_id, start, "end"'
_RANK = "CASE category WHEN 'person' THEN 0 WHEN 'email' THEN 1 WHEN 'phone' THEN 2 WHEN 'address' THEN 3 WHEN 'iban' THEN 4 WHEN 'account_id' THEN 5 WHEN 'customer_id' THEN 6 WHEN 'depot_id' THEN 7 ELSE 100 END"
_ISLANDS = f"""isl AS (SELECT *, sum(o) OVER (PARTITION BY doc_id, segment_id ORDER BY start, "end", category, detector ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN start >= coalesce(max("end") OVER (PARTITION BY doc_id, segment_id ORDER BY start, "end", category, detector ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS o
    FROM spotted WHERE NOT review_only)),
  comp AS (SELECT doc_id, segment_id, island, min(start) AS start, max("end") AS "end", arg_min(category, {_RANK}) AS category, max(score) AS score, count(*) AS members FROM isl GROUP BY ALL),
  sel AS (SELECT c.doc_id, c.segment_id, c.start, c."end", c.category, c.score, c.members, substring(s.text, CAST(c.start + 1 AS INT), CAST(c."end" - c.start AS INT)) AS text
    FROM comp c JOIN seg s ON c.doc_id = s.doc_id AND c.segment_id = s.segment_id)"""
_BASE = f"WITH {_SEG}, {_SPOTTED}"
_RESOLVED = f"{_BASE}, {_ISLANDS}"
_OCC = """'o' || substring(sha256('[' || chr(10) || '  "' || segment_id || '",' || chr(10) || '  ' || start || ',' || chr(10) || '  ' || "end" || ',' || chr(10) || '  "' || category || '",' || chr(10) || '  "' || text || '"' || chr(10) || ']'), 1, 20)"""
_GRP = """'g' || substring(sha256('[' || chr(10) || '  "' || category || '",' || chr(10) || '  "' || replace(lower(text), 'ß', 'ss') || '"' || chr(10) || ']'), 1, 20)"""


# --- segments ----------------------------------------------------------------------------


@query(f"WITH {_SEG} SELECT doc_id, CAST(seg_no AS BIGINT) AS seg_no, segment_id, text FROM seg")
def segments_from_documents(spark, sf_dir):
    return _longs(lines(spark, sf_dir).drop("locator"))


@query("""SELECT CAST(conv_id AS VARCHAR) AS doc_id, n AS seg_no, 's' || lpad(CAST(n AS VARCHAR), 6, '0') AS segment_id, text FROM (
  SELECT conv_id, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM conversations)""")
def segments_from_conversations(spark, sf_dir):
    return _longs(from_conversations(table(spark, sf_dir, "conversations")).drop("locator"))


@query(f"WITH {_SEG} SELECT doc_id, count(*) AS segments, CAST(sum(length(text)) AS BIGINT) AS characters FROM seg GROUP BY doc_id")
def segment_summary(spark, sf_dir):
    return summary(lines(spark, sf_dir))


@query(rf"WITH {_SEG} SELECT doc_id, segment_id, CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS words FROM seg")
def word_counts(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "segment_id", S.words(F.col("text")).alias("words"))


# --- rules -------------------------------------------------------------------------------


@query(f"WITH {_SEG} " + duck_spans("seg", r"[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9]+(?:-+[A-Za-z0-9]+)*)+"))
def email_spans(spark, sf_dir):
    return _longs(rules.pattern_findings(lines(spark, sf_dir), rules.EMAIL, "email", 0.99, "rule:email").select("doc_id", "segment_id", "start", "end", "text"))


@query(f"WITH {_BASE[5:]} SELECT d.lang AS lang, count(*) AS spans FROM spotted s JOIN documents d ON s.doc_id = CAST(d.doc_id AS VARCHAR) WHERE s.detector = 'p:email' GROUP BY d.lang")
def email_counts_by_lang(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = rules.pattern_findings(from_documents(docs.select("doc_id", "text")), SPOTS["p:email"][0], "email", 0.99, "p:email")
    return found.join(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "lang"), "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("spans"))


@query(f"WITH {_SEG} " + duck_spans("seg", SPOTS["p:ip"][0]))
def ip_spans(spark, sf_dir):
    return _longs(rules.pattern_findings(lines(spark, sf_dir), SPOTS["p:ip"][0], "ip_address", 0.9, "p:ip").select("doc_id", "segment_id", "start", "end", "text"))


def _rule(spark, sf_dir, name: str) -> DataFrame:
    policy = parse_policy({"rules": {r: r == name for r in ("email", "phone", "iban", "customer_id", "depot_id", "account_id")}})
    rows = rules.rule_findings(talk(spark, sf_dir), policy)
    return _longs(rows.select("doc_id", "segment_id", "start", "end", "text", "category", micro(F.col("score")).alias("score"), "detector"))


def _part(n: int, lead: str, value: str, category: str, score: int, where: str = "true", detector: str | None = None) -> str:
    return f"""SELECT doc_id, segment_id, CAST(length({lead}) AS BIGINT) AS start, CAST(length({lead}) + length({value}) AS BIGINT) AS "end", {value} AS text,
      '{category}' AS category, CAST({score} AS BIGINT) AS score, '{detector or 'rule:' + category}' AS detector FROM talk WHERE n = {n} AND {where}"""


_PHONE = _part(3, "'Kontonummer: ' || kk || ', erreichbar unter '", "'030 ' || kp", "phone", 940000)
_IBAN = _part(4, "'IBAN '", "iban", "iban", 1000000, "k % 2 = 0")
_CUSTOMER = _part(2, "'meine Kundennummer: '", "'KD-' || kk", "customer_id", 860000)
_DEPOT = _part(2, "'meine Kundennummer: KD-' || kk || ' und mein Depot-Nr. '", "'DP' || kk", "depot_id", 860000)
_ACCOUNT = _part(3, "'Kontonummer: '", "kk", "account_id", 840000)
_RULES = f"found AS ({' UNION ALL '.join((_PHONE, _IBAN, _CUSTOMER, _DEPOT, _ACCOUNT))})"


@query(f"WITH {_TALK} {_PHONE}")
def phone_findings(spark, sf_dir):
    return _rule(spark, sf_dir, "phone")


@query(f"WITH {_TALK} {_IBAN}")
def iban_findings(spark, sf_dir):
    return _rule(spark, sf_dir, "iban")


@query(f"WITH {_TALK} {_CUSTOMER}")
def customer_ids(spark, sf_dir):
    return _rule(spark, sf_dir, "customer_id")


@query(f"WITH {_TALK} {_DEPOT}")
def depot_ids(spark, sf_dir):
    return _rule(spark, sf_dir, "depot_id")


@query(f"WITH {_TALK} {_ACCOUNT}")
def account_ids(spark, sf_dir):
    return _rule(spark, sf_dir, "account_id")


@query(f"WITH {_TALK}, {_RULES} SELECT * FROM found")
def rule_findings(spark, sf_dir):
    rows = rules.rule_findings(talk(spark, sf_dir))
    return _longs(rows.select("doc_id", "segment_id", "start", "end", "text", "category", micro(F.col("score")).alias("score"), "detector"))


@query(f"WITH {_TALK} SELECT category, detector, count(*) AS n FROM ({_IBAN} UNION ALL {_PHONE}) GROUP BY ALL")
def rule_switches(spark, sf_dir):
    policy = parse_policy({"rules": {"email": False, "customer_id": False, "depot_id": False, "account_id": False}})
    return rules.rule_findings(talk(spark, sf_dir), policy).groupBy("category", "detector").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_TALK} SELECT doc_id, segment_id, CAST(start AS BIGINT) AS start, CAST(start + length(text) AS BIGINT) AS "end", text FROM (
  SELECT doc_id, segment_id, length('meine Kundennummer: KD-' || kk || ' und mein Depot-Nr. ') AS start, 'DP' || kk || '.' AS text FROM talk WHERE n = 2
  UNION ALL SELECT doc_id, segment_id, 5, iban || '.' FROM talk WHERE n = 4
  UNION ALL SELECT doc_id, segment_id, 6, 'B' || CAST(k + 1000000 AS STRING) || 'X' FROM talk WHERE n = 6)""")
def identifier_tokens(spark, sf_dir):
    return _longs(rules.pattern_findings(talk(spark, sf_dir), rules.IDENTIFIER_TOKEN, "token", 0.1, "token").select("doc_id", "segment_id", "start", "end", "text"))


@query(f"WITH {_TALK} SELECT doc_id, iban, k % 2 = 0 AS valid FROM talk WHERE n = 4")
def iban_checksum(spark, sf_dir):
    return talk(spark, sf_dir).where("n = 4").select("doc_id", "iban", S.iban_valid(F.col("iban")).alias("valid"))


_NAME = "fn || ' ' || ln"
_MENTIONS = f"""mention AS (SELECT doc_id, segment_id, k, fn, ln, CASE n WHEN 1 THEN 0 ELSE 11 END AS start, n FROM talk WHERE n IN (1, 5))"""


@query(f"""WITH {_TALK}, {_MENTIONS} SELECT doc_id, segment_id, CAST(start AS BIGINT) AS start, CAST(start + length(alias) AS BIGINT) AS "end", alias AS text, entity_key FROM (
  SELECT *, {_NAME} AS alias, CASE WHEN {_NAME} = 'Anna Albers' THEN 'p1' ELSE 'p2' END AS entity_key FROM mention WHERE {_NAME} IN ('Anna Albers', 'Doris Dietz')
  UNION ALL SELECT *, fn, 'p2' FROM mention WHERE fn = 'Frida')""")
def alias_matches(spark, sf_dir):
    policy = parse_policy({"aliases": ALIASES})
    rows = rules.alias_findings(talk(spark, sf_dir), policy.alias_table(spark))
    return _longs(rows.select("doc_id", "segment_id", "start", "end", "text", "entity_key"))


# --- identity ----------------------------------------------------------------------------

_KEY = f"'speaker:' || substring(sha256(lower({_NAME})), 1, 16)"


@query(f"WITH {_TALK} SELECT doc_id, segment_id, CAST(0 AS BIGINT) AS start, CAST(length({_NAME}) AS BIGINT) AS \"end\", {_NAME} AS name, {_KEY} AS entity_key FROM talk WHERE n = 1")
def speaker_labels(spark, sf_dir):
    return _longs(identity.speaker_labels(talk(spark, sf_dir)).select("doc_id", "segment_id", "start", "end", "name", "entity_key"))


@query(f"""WITH {_TALK}, {_MENTIONS} SELECT doc_id, segment_id, CAST(start AS BIGINT) AS start, CAST(start + length({_NAME}) AS BIGINT) AS "end", {_NAME} AS text,
  CASE n WHEN 1 THEN 'rule:speaker' ELSE 'rule:speaker-propagation' END AS detector, CASE n WHEN 1 THEN 970000 ELSE 780000 END::BIGINT AS score, {_KEY} AS entity_key FROM mention""")
def speaker_propagation(spark, sf_dir):
    rows = identity.speaker_findings(talk(spark, sf_dir)).where("entity_key is not null")
    return _longs(rows.select("doc_id", "segment_id", "start", "end", "text", "detector", micro(F.col("score")).alias("score"), "entity_key"))


_SURNAME = f"length('Ich fragte ' || {_NAME} || ' heute; Herr ')"


@query(f"WITH {_TALK} SELECT doc_id, segment_id, CAST({_SURNAME} AS BIGINT) AS start, CAST({_SURNAME} + length(ln) AS BIGINT) AS \"end\", ln AS text, true AS review_only FROM talk WHERE n = 5")
def surname_suggestions(spark, sf_dir):
    rows = identity.speaker_findings(talk(spark, sf_dir)).where("detector = 'rule:speaker-alias-suggestion'")
    return _longs(rows.select("doc_id", "segment_id", "start", "end", "text", "review_only"))


@query(f"WITH {_TALK} SELECT doc_id, segment_id, CAST({_SURNAME} AS BIGINT) AS start, CAST({_SURNAME} + length(ln) AS BIGINT) AS \"end\", ln AS text, {_KEY} AS entity_key FROM talk WHERE n = 5")
def document_alias_links(spark, sf_dir):
    seg = talk(spark, sf_dir)
    rows = identity.document_aliases(seg, identity.speaker_findings(seg))
    return _longs(rows.select("doc_id", "segment_id", "start", "end", "text", "entity_key"))


@query(f"""WITH {_TALK}, {_RULES} SELECT detector, count(*) AS n FROM (SELECT detector FROM found
  UNION ALL SELECT unnest(['rule:speaker', 'rule:speaker-propagation', 'rule:speaker-alias-suggestion', 'rule:document-alias']) FROM talk WHERE n = 1) GROUP BY detector""")
def detect_counts(spark, sf_dir):
    return detect(talk(spark, sf_dir)).groupBy("detector").agg(F.count(F.lit(1)).alias("n"))


# --- sets of findings --------------------------------------------------------------------


@query(f"{_BASE} SELECT doc_id, segment_id, start, \"end\", category, detector, CAST(round(max(score) * 1000000) AS BIGINT) AS score FROM spotted GROUP BY ALL")
def findings_union_dedupe(spark, sf_dir):
    once = spotted(spark, sf_dir)
    weaker = once.withColumn("score", F.col("score") - 0.1)
    rows = identity.dedupe(weaker.unionByName(once))
    return _longs(rows.select("doc_id", "segment_id", "start", "end", "category", "detector", micro(F.col("score")).alias("score")))


@query(f"""{_BASE} SELECT violation, count(*) AS n FROM (SELECT CASE WHEN "end" + 1 > length(s.text) THEN 'bad_bounds' WHEN substring(s.text, CAST(start + 2 AS INT), CAST("end" - start AS INT)) <> f.text THEN 'text_mismatch' END AS violation
  FROM spotted f JOIN seg s ON f.doc_id = s.doc_id AND f.segment_id = s.segment_id) WHERE violation IS NOT NULL GROUP BY violation""")
def finding_slice_violations(spark, sf_dir):
    moved = spotted(spark, sf_dir).withColumn("start", F.col("start") + 1).withColumn("end", F.col("end") + 1)
    return resolve.slice_violations(moved, lines(spark, sf_dir)).groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_BASE}, o AS (SELECT * FROM spotted) SELECT doc_id, segment_id, start, \"end\", category, text, {_OCC} AS id FROM o")
def occurrence_ids(spark, sf_dir):
    return _longs(resolve.with_ids(spotted(spark, sf_dir)).select("doc_id", "segment_id", "start", "end", "category", "text", "id"))


@query(f"{_BASE} SELECT DISTINCT category, text, {_GRP} AS group_id FROM spotted")
def group_ids(spark, sf_dir):
    return review.with_groups(spotted(spark, sf_dir)).select("category", "text", "group_id").distinct()


@query(f"{_RESOLVED} SELECT doc_id, segment_id, start, \"end\", category, text, CAST(round(score * 1000000) AS BIGINT) AS score, members > 1 AS merged FROM sel")
def resolve_selected(spark, sf_dir):
    selected, _ = resolve.resolve(spotted(spark, sf_dir), lines(spark, sf_dir))
    return _longs(selected.select("doc_id", "segment_id", "start", "end", "category", "text", micro(F.col("score")).alias("score"), F.col("provenance").isNotNull().alias("merged")))


@query(f"""{_RESOLVED} SELECT i.doc_id, i.segment_id, i.start, i."end", i.category, i.detector, s.start AS into_start, s."end" AS into_end
  FROM isl i JOIN sel s ON i.doc_id = s.doc_id AND i.segment_id = s.segment_id AND i.start >= s.start AND i."end" <= s."end" WHERE s.members > 1""")
def resolve_suppressed(spark, sf_dir):
    selected, suppressed = resolve.resolve(spotted(spark, sf_dir), lines(spark, sf_dir))
    into = selected.select("doc_id", F.col("id").alias("merged_into"), F.col("start").alias("into_start"), F.col("end").alias("into_end"))
    return _longs(suppressed.join(into, ["doc_id", "merged_into"]).select("doc_id", "segment_id", "start", "end", "category", "detector", "into_start", "into_end"))


@query(f"""{_RESOLVED} SELECT doc_id, segment_id, start, "end", category, text, 'union:coverage' AS detector, false AS review_only FROM sel
  UNION ALL SELECT doc_id, segment_id, start, "end", category, text, detector, true FROM spotted WHERE review_only""")
def coverage_union(spark, sf_dir):
    rows = resolve.coverage_union(spotted(spark, sf_dir), lines(spark, sf_dir))
    return _longs(rows.select("doc_id", "segment_id", "start", "end", "category", "text", "detector", "review_only"))


@query(f"""{_BASE} SELECT doc_id, segment_id, start, "end", category, detector, review_only FROM spotted WHERE category IN ('email', 'person')
  UNION ALL SELECT doc_id, segment_id, start, "end", category, detector, true FROM spotted WHERE category NOT IN ('email', 'person')""")
def combine_two_detectors(spark, sf_dir):
    found = spotted(spark, sf_dir)
    rows = resolve.combine(found.where("category in ('email', 'person')"), found, review_only=True)
    return _longs(rows.select("doc_id", "segment_id", "start", "end", "category", "detector", "review_only"))


@query(f"""WITH RECURSIVE {_BASE[5:]},
  o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, segment_id ORDER BY score DESC, "end" - start DESC, {_OCC}) AS k FROM spotted WHERE NOT review_only),
  r AS (SELECT doc_id, segment_id, k, [{{'a': start, 'b': "end"}}] AS taken, false AS clash FROM o WHERE k = 1
    UNION ALL SELECT doc_id, segment_id, k, CASE WHEN clash THEN taken ELSE list_append(taken, {{'a': start, 'b': "end"}}) END, clash FROM (
      SELECT o.doc_id, o.segment_id, o.k, o.start, o."end", r.taken, len(list_filter(r.taken, lambda x: x.a < o."end" AND o.start < x.b)) > 0 AS clash
      FROM r JOIN o ON r.doc_id = o.doc_id AND r.segment_id = o.segment_id AND o.k = r.k + 1))
  SELECT o.doc_id, o.segment_id, o.start, o."end", o.category, o.detector, CASE WHEN r.clash THEN 'overlap_priority' END AS reason
  FROM o JOIN r ON o.doc_id = r.doc_id AND o.segment_id = r.segment_id AND o.k = r.k""")
def resolve_greedy(spark, sf_dir):
    return _longs(resolve.resolve_greedy(spotted(spark, sf_dir)).select("doc_id", "segment_id", "start", "end", "category", "detector", "reason"))


@query(f"""{_BASE} SELECT {_SPAN}, category, detector FROM spotted f WHERE EXISTS (SELECT 1 FROM spotted o WHERE o.doc_id = f.doc_id AND o.segment_id = f.segment_id
  AND o.start < f."end" AND f.start < o."end" AND (o.start <> f.start OR o."end" <> f."end" OR o.category <> f.category) AND o.score >= f.score)""")
def overlap_semi(spark, sf_dir):
    found = spotted(spark, sf_dir)
    other = resolve.overlaps("f", "o") & ((F.col("f.start") != F.col("o.start")) | (F.col("f.end") != F.col("o.end")) | (F.col("f.category") != F.col("o.category")))
    rows = found.alias("f").join(found.alias("o"), other & (F.col("o.score") >= F.col("f.score")), "left_semi")
    return _longs(rows.select("doc_id", "segment_id", "start", "end", "category", "detector"))


@query(f"""{_BASE} SELECT {_SPAN}, detector FROM spotted f WHERE detector <> 'p:email' AND NOT EXISTS (SELECT 1 FROM spotted o WHERE o.detector = 'p:email'
  AND o.doc_id = f.doc_id AND o.segment_id = f.segment_id AND o.start <= f.start AND f."end" <= o."end")""")
def containment_anti(spark, sf_dir):
    found = spotted(spark, sf_dir)
    inside = (F.col("f.doc_id") == F.col("o.doc_id")) & (F.col("f.segment_id") == F.col("o.segment_id")) & (F.col("o.start") <= F.col("f.start")) & (F.col("f.end") <= F.col("o.end"))
    rows = found.where("detector != 'p:email'").alias("f").join(found.where("detector = 'p:email'").alias("o"), inside, "left_anti")
    return _longs(rows.select("doc_id", "segment_id", "start", "end", "detector"))


@query(f"""{_BASE} SELECT {_SPAN}, category, detector, EXISTS (SELECT 1 FROM spotted o WHERE o.detector = 'p:email' AND o.doc_id = f.doc_id AND o.segment_id = f.segment_id
  AND o.start <= f.start AND f."end" <= o."end") AS masked FROM spotted f""")
def masked_findings(spark, sf_dir):
    found = spotted(spark, sf_dir)
    rows = rank.masked_findings(found, found.where("detector = 'p:email'"), lines(spark, sf_dir))
    return _longs(rows.select("doc_id", "segment_id", "start", "end", "category", "detector", "masked"))


# --- review ------------------------------------------------------------------------------

_NUMBERED = f"""grp AS (SELECT *, {_GRP} AS group_id FROM sel),
  tok AS (SELECT doc_id, group_id, category, n, upper(category) || '_' || CASE WHEN k < 1000 THEN lpad(CAST(k AS VARCHAR), 3, '0') ELSE CAST(k AS VARCHAR) END AS token FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, category ORDER BY pos) AS k FROM (
      SELECT doc_id, group_id, min(category) AS category, count(*) AS n, min(segment_id || lpad(CAST(start AS VARCHAR), 9, '0')) AS pos FROM grp GROUP BY doc_id, group_id)))"""


def _reviewed(spark, sf_dir):
    seg = lines(spark, sf_dir)
    selected, _ = resolve.resolve(spotted(spark, sf_dir), seg)
    return seg, selected, review.entity_groups(selected, seg)


@query(f"{_RESOLVED}, {_NUMBERED} SELECT doc_id, group_id, category, token, n AS occurrences FROM tok")
def entity_groups(spark, sf_dir):
    groups = _reviewed(spark, sf_dir)[2]
    return _longs(groups.select("doc_id", "group_id", "category", "token", F.size("occurrence_ids").alias("occurrences")))


_RENDERED = f"""{_RESOLVED}, {_NUMBERED},
  cut AS (SELECT g.doc_id, g.segment_id, g.start, g."end", t.token, g.text FROM grp g JOIN tok t ON g.doc_id = t.doc_id AND g.group_id = t.group_id),
  ren AS (SELECT s.doc_id, s.segment_id, any_value(s.text) AS source, string_agg(substring(s.text, CAST(prev + 1 AS INT), CAST(start - prev AS INT)) || token, '' ORDER BY start) || substring(any_value(s.text), CAST(max("end") + 1 AS INT)) AS text
    FROM seg s JOIN (SELECT *, coalesce(lag("end") OVER (PARTITION BY doc_id, segment_id ORDER BY start), 0) AS prev FROM cut) c ON s.doc_id = c.doc_id AND s.segment_id = c.segment_id GROUP BY s.doc_id, s.segment_id)"""


@query(f"{_RENDERED} SELECT doc_id, segment_id, text FROM ren")
def rendered_text(spark, sf_dir):
    seg, selected, groups = _reviewed(spark, sf_dir)
    rendered = review.render(seg, review.effective(selected, groups))
    changed = selected.select("doc_id", "segment_id").distinct()
    return rendered.join(changed, ["doc_id", "segment_id"], "left_semi").select("doc_id", "segment_id", "text")


@query(f"{_RESOLVED} SELECT {_SPAN} FROM sel WHERE category <> 'ip_address'")
def masked_intervals(spark, sf_dir):
    _, selected, groups = _reviewed(spark, sf_dir)
    groups = groups.withColumn("action", F.when(F.col("category") == "ip_address", "retain").otherwise("accept"))
    return _longs(review.masked_intervals(review.effective(selected, groups)))


@query(f"""{_RESOLVED}, {_NUMBERED} SELECT doc_id, category, token, g.text AS source, CAST(n AS BIGINT) AS n FROM tok t JOIN (SELECT doc_id, group_id, arg_min(text, segment_id || lpad(CAST(start AS VARCHAR), 9, '0')) AS text FROM grp GROUP BY ALL) g USING (doc_id, group_id)""")
def group_view(spark, sf_dir):
    seg, selected, groups = _reviewed(spark, sf_dir)
    return _longs(review.group_view(groups, selected, seg).select("doc_id", "category", "token", "source", F.col("count").alias("n")))


@query(f"""{_RESOLVED}, {_NUMBERED} SELECT violation, count(*) AS n FROM (
  SELECT 'bad_action' AS violation FROM tok WHERE category = 'email' UNION ALL SELECT 'immutable_changed' FROM tok WHERE category = 'email'
  UNION ALL SELECT 'replacement_missing' FROM tok WHERE category = 'person' UNION ALL SELECT 'missing_id' FROM tok WHERE category = 'ip_address') GROUP BY violation""")
def decision_violations(spark, sf_dir):
    seg, selected, groups = _reviewed(spark, sf_dir)
    trusted = review.group_view(groups, selected, seg)
    back = trusted.where("category != 'ip_address'").withColumn("action", F.when(F.col("category") == "email", "shred").when(F.col("category") == "person", "replace").otherwise(F.col("action")))
    back = back.withColumn("token", F.when(F.col("category") == "email", "X").otherwise(F.col("token")))
    return review.decision_violations("groups", trusted, back).groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{_RESOLVED}, {_NUMBERED}, p AS (SELECT doc_id, count(*) AS passages FROM seg GROUP BY doc_id), g AS (SELECT doc_id, count(*) AS groups, sum(n)::BIGINT AS occurrences FROM tok GROUP BY doc_id)
  SELECT p.doc_id, passages, coalesce(groups, 0) AS groups, coalesce(occurrences, 0) AS occurrences, CAST(0 AS BIGINT) AS inspected FROM p LEFT JOIN g ON p.doc_id = g.doc_id""")
def review_status(spark, sf_dir):
    seg, selected, groups = _reviewed(spark, sf_dir)
    effects = review.effective(selected, groups)
    rendered = review.render(seg, effects)
    ranked = rank.rank_passages(rendered)
    rows = review.status(review.group_view(groups, selected, seg), review.occurrence_view(selected, seg), review.passage_view(seg, rendered, ranked))
    return _longs(rows.select("doc_id", "passages", "groups", "occurrences", "inspected"))


def _named(spark, sf_dir, lead: str) -> tuple[DataFrame, DataFrame]:
    """A segment a customer, ``lead`` before two names, and the names as selected findings."""
    seg = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("doc_id"), F.lit(1).alias("seg_no"), F.lit("s000001").alias("segment_id"), F.concat(F.expr(lead), F.lit("Anna Albers, Doris Dietz")).alias("text"))
    names = F.array(*[F.struct(F.lit(n).alias("text"), F.lit(i).alias("id")) for n, i in (("Anna Albers", "o1"), ("Doris Dietz", "o2"))])
    found = seg.select("doc_id", "segment_id", F.col("text").alias("whole"), F.inline(names))
    found = found.select("doc_id", "segment_id", "id", (F.length("whole") - F.when(F.col("id") == "o1", 24).otherwise(11)).alias("start"), "text", F.lit("person").alias("category"), F.lit(None).cast("string").alias("entity_key"))
    return seg, found.withColumn("end", F.col("start") + F.length("text"))


@query("""WITH u AS (SELECT 'c' || CAST(c_custkey AS VARCHAR) AS doc_id, CASE WHEN c_custkey % 2 = 0 THEN 4 WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS used FROM customer)
  SELECT doc_id, 'PERSON_' || lpad(CAST(used + i AS VARCHAR), 3, '0') AS token, CASE i WHEN 1 THEN 'Anna Albers' ELSE 'Doris Dietz' END AS alias FROM u CROSS JOIN (VALUES (1), (2)) AS v(i)""")
def token_allocation(spark, sf_dir):
    """Numbers go on from the run's counters and skip those that a text holds."""
    seg, selected = _named(spark, sf_dir, "CASE WHEN c_custkey % 3 = 0 THEN 'PERSON_001 und ' ELSE '' END")
    number = F.expr("cast(substring(doc_id, 2) as long)")
    counters = seg.where(number % 2 == 0).select("doc_id", F.lit("PERSON").alias("prefix"), F.lit(4).alias("n"))
    return review.entity_groups(selected, seg, counters).select("doc_id", "token", F.get("aliases", F.lit(0)).alias("alias"))


@query("""SELECT 'c' || CAST(c_custkey AS VARCHAR) AS doc_id, CASE WHEN c_custkey % 8 = 4 THEN 'Anna Albers' WHEN c_custkey % 4 = 0 THEN 'PERSON_001' WHEN c_custkey % 4 = 1 THEN 'Anna Albers' WHEN c_custkey % 4 = 2 THEN '' ELSE 'Jemand' END || ', PERSON_002' AS text FROM customer""")
def review_apply(spark, sf_dir):
    """A group's decision holds unless an occurrence has its own."""
    seg, selected = _named(spark, sf_dir, "''")
    number = F.expr("cast(substring(doc_id, 2) as long)")
    groups = review.entity_groups(selected, seg)
    first = F.array_contains("occurrence_ids", "o1")
    groups = groups.withColumn("action", F.when(first & (number % 4 == 1), "retain").when(first & (number % 4 == 2), "remove").when(first & (number % 4 == 3), "replace").otherwise("accept"))
    groups = groups.withColumn("replacement", F.when(F.col("action") == "replace", "Jemand").otherwise(""))
    own = seg.where(number % 8 == 4).select("doc_id", F.lit("o1").alias("id"), F.lit("retain").alias("action"), F.lit("").alias("replacement"), F.lit("").alias("note"))
    return review.render(seg, review.effective(selected, groups, own)).select("doc_id", "text")


# --- ranking -----------------------------------------------------------------------------


@query(f"WITH {_TALK} SELECT doc_id, segment_id, CAST(CASE n WHEN 2 THEN 320000 WHEN 3 THEN 570000 WHEN 4 THEN 570000 WHEN 5 THEN 220000 WHEN 6 THEN 100000 ELSE 0 END AS BIGINT) AS score FROM talk")
def rank_base(spark, sf_dir):
    return rank.rank_passages(talk(spark, sf_dir)).select("doc_id", "segment_id", micro(F.col("score")).alias("score"))


def _retained(spark, sf_dir, sample: int) -> DataFrame:
    seg = talk(spark, sf_dir).select("doc_id", "seg_no", "segment_id", "text")
    found = rules.rule_findings(seg)
    masks = found.where("category != 'phone'")
    return rank.rank_retained(seg, review.render_placeholder(seg, masks), found, masks, sample)


@query(f"WITH {_TALK} SELECT doc_id, segment_id, CAST(CASE n WHEN 2 THEN 220000 WHEN 3 THEN 962800 WHEN 4 THEN CASE WHEN k % 2 = 0 THEN 220000 ELSE 570000 END WHEN 5 THEN 220000 WHEN 6 THEN 100000 ELSE 0 END AS BIGINT) AS score FROM talk")
def rank_retained(spark, sf_dir):
    return _retained(spark, sf_dir, 0).select("doc_id", "segment_id", micro(F.col("score")).alias("score"))


@query(f"WITH {_TALK} SELECT doc_id, segment_id FROM (SELECT doc_id, segment_id, row_number() OVER (PARTITION BY doc_id ORDER BY sha256('review-remainder-v1:' || segment_id)) AS r FROM talk WHERE n IN (1, 5, 6)) WHERE r <= 2")
def remainder_sample(spark, sf_dir):
    return _retained(spark, sf_dir, 2).where(F.array_contains("reasons", "remainder_sample")).select("doc_id", "segment_id")


# --- evaluation: gold are e-mails, predictions all handles and the e-mails of even documents ----

_EVAL = f"""{_BASE}, gold AS (SELECT doc_id, segment_id, start, "end", category FROM spotted WHERE detector = 'p:email'),
  pred AS (SELECT * FROM spotted WHERE detector = 'p:handle' OR (detector = 'p:email' AND CAST(doc_id AS BIGINT) % 2 = 0)),
  exact AS (SELECT p.* FROM pred p JOIN gold g USING (doc_id, segment_id, start, "end", category)),
  part AS (SELECT p.* FROM pred p WHERE detector = 'p:handle' AND EXISTS (SELECT 1 FROM gold g WHERE g.doc_id = p.doc_id AND g.segment_id = p.segment_id AND g.start < p."end" AND p.start < g."end")),
  miss AS (SELECT * FROM gold WHERE CAST(doc_id AS BIGINT) % 2 = 1)"""


def _evaluated(spark, sf_dir):
    found = spotted(spark, sf_dir)
    gold = found.where("detector = 'p:email'").select("doc_id", "segment_id", "start", "end", "category")
    return lines(spark, sf_dir), gold, found.where("detector = 'p:handle' or (detector = 'p:email' and cast(doc_id as long) % 2 = 0)")


@query(f"{_EVAL} SELECT {_SPAN}, category FROM exact")
def exact_matches(spark, sf_dir):
    _, gold, pred = _evaluated(spark, sf_dir)
    return _longs(evaluate.matched_predictions(pred, gold).where("exact").select("doc_id", "segment_id", "start", "end", "category"))


@query(f"{_EVAL} SELECT {_SPAN}, category FROM part")
def partial_matches(spark, sf_dir):
    _, gold, pred = _evaluated(spark, sf_dir)
    return _longs(evaluate.matched_predictions(pred, gold).where("partial").select("doc_id", "segment_id", "start", "end", "category"))


@query(f"{_EVAL} SELECT {_SPAN}, category FROM miss")
def misses(spark, sf_dir):
    _, gold, pred = _evaluated(spark, sf_dir)
    return _longs(evaluate.misses(gold, pred))


@query(f"""{_EVAL}, t AS (SELECT (SELECT count(*) FROM gold) AS gold, (SELECT count(*) FROM pred) AS predictions, (SELECT count(*) FROM exact) AS tp, (SELECT count(*) FROM part) AS partial)
  SELECT gold, predictions, tp, predictions - tp AS fp, gold - tp AS fn, partial, CAST(round(tp * 1000000.0 / predictions) AS BIGINT) AS "precision", CAST(round(tp * 1000000.0 / gold) AS BIGINT) AS recall FROM t""")
def metrics_total(spark, sf_dir):
    seg, gold, pred = _evaluated(spark, sf_dir)
    m = evaluate.metrics_total(pred, gold, seg)
    return _longs(m.select("gold", "predictions", "tp", "fp", "fn", F.col("partial_overlap_predictions").alias("partial"), micro(F.col("precision")).alias("precision"), micro(F.col("recall")).alias("recall")))


@query(f"""{_EVAL} SELECT category, CAST(sum(g) AS BIGINT) AS gold, CAST(sum(t) AS BIGINT) AS tp, CAST(sum(p) - sum(t) AS BIGINT) AS fp, CAST(sum(g) - sum(t) AS BIGINT) AS fn FROM (
  SELECT category, 1 AS g, 0 AS t, 0 AS p FROM gold UNION ALL SELECT category, 0, 1, 0 FROM exact UNION ALL SELECT category, 0, 0, 1 FROM pred) GROUP BY category""")
def metrics_by_category(spark, sf_dir):
    _, gold, pred = _evaluated(spark, sf_dir)
    return _longs(evaluate.metrics_by_category(pred, gold).select("category", "gold", "tp", "fp", "fn"))


@query(f"{_EVAL} SELECT {_SPAN}, category FROM miss")
def residuals(spark, sf_dir):
    seg, gold, pred = _evaluated(spark, sf_dir)
    return _longs(evaluate.residuals(gold, resolve.resolve(pred, seg)[0], seg))


@query(f"{_EVAL} SELECT doc_id, category, count(*) AS residual FROM miss GROUP BY ALL")
def residual_categories(spark, sf_dir):
    seg, gold, pred = _evaluated(spark, sf_dir)
    return evaluate.residual_categories(evaluate.residuals(gold, resolve.resolve(pred, seg)[0], seg))


@query(f"""{_EVAL}, occ AS (SELECT p.doc_id, p.segment_id, p.start, p."end" FROM pred p WHERE NOT (detector = 'p:handle' AND EXISTS (SELECT 1 FROM exact e WHERE e.doc_id = p.doc_id AND e.segment_id = p.segment_id AND e.start <= p.start AND p."end" <= e."end"))),
  hit AS (SELECT o.*, (SELECT coalesce(sum(least(g."end", o."end") - greatest(g.start, o.start)), 0) FROM gold g WHERE g.doc_id = o.doc_id AND g.segment_id = o.segment_id AND g.start < o."end" AND o.start < g."end") AS inside FROM occ o)
  SELECT count(*) AS proposed, CAST(sum(CASE WHEN inside = 0 THEN 1 ELSE 0 END) AS BIGINT) AS wholly_false, CAST(sum("end" - start) AS BIGINT) AS masked, CAST(sum("end" - start - inside) AS BIGINT) AS unnecessary FROM hit""")
def replacement_quality(spark, sf_dir):
    seg, gold, pred = _evaluated(spark, sf_dir)
    q = evaluate.replacement_quality(gold, resolve.resolve(pred, seg)[0], seg)
    return q.select(
        F.col("proposed_occurrences").alias("proposed"), F.col("wholly_false_positive_occurrences").alias("wholly_false"),
        F.col("masked_nonwhitespace_characters").alias("masked"), F.col("non_pii_masked_characters").alias("unnecessary"),
    )


_CURVE = rf"""{_EVAL}, st AS (SELECT s.doc_id, CAST(s.seg_no AS BIGINT) AS pos, CAST(len(regexp_extract_all(s.text, '\S+')) AS BIGINT) AS w, (SELECT count(*) FROM miss m WHERE m.doc_id = s.doc_id AND m.segment_id = s.segment_id) AS n FROM seg s
    WHERE s.doc_id IN (SELECT doc_id FROM gold) UNION ALL SELECT DISTINCT doc_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM gold),
  curve AS (SELECT doc_id, pos AS inspected_passages, CAST(sum(w) OVER r AS BIGINT) AS inspected_words, CAST(sum(n) OVER r AS BIGINT) AS recovered, CAST(sum(n) OVER (PARTITION BY doc_id) - sum(n) OVER r AS BIGINT) AS residual
    FROM st WINDOW r AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING))"""


def _curve(spark, sf_dir) -> DataFrame:
    seg, gold, pred = _evaluated(spark, sf_dir)
    rest = evaluate.residuals(gold, resolve.resolve(pred, seg)[0], seg)
    seg = seg.join(gold.select("doc_id").distinct(), "doc_id", "left_semi")
    return evaluate.inspection_curve(seg.select("doc_id", "segment_id", F.col("seg_no").alias("position"), "text"), rest)


@query(f"{_CURVE} SELECT * FROM curve")
def inspection_curve(spark, sf_dir):
    return _longs(_curve(spark, sf_dir))


@query(f"""{_CURVE} SELECT doc_id, min(CASE WHEN residual = 0 THEN inspected_passages END) AS passages_to_recover_all, min(CASE WHEN residual = 0 THEN inspected_words END) AS words_to_recover_all, max(inspected_passages) AS passages,
  {", ".join(f"min(CASE WHEN inspected_passages <= {b} THEN residual END) AS residual_after_{b}" for b in evaluate.BUDGETS)} FROM curve GROUP BY doc_id""")
def effort_budgets(spark, sf_dir):
    return _longs(evaluate.effort(_curve(spark, sf_dir)))


@query(f"""{_EVAL}, v AS (SELECT 'both' AS variant, count(*) AS predictions FROM pred UNION ALL SELECT 'handles', count(*) FROM pred WHERE detector = 'p:handle')
  SELECT variant, predictions, CASE variant WHEN 'both' THEN (SELECT count(*) FROM exact) ELSE 0 END AS tp FROM v""")
def compare_variants(spark, sf_dir):
    seg, gold, pred = _evaluated(spark, sf_dir)
    rows = evaluate.compare_variants({"both": pred, "handles": pred.where("detector = 'p:handle'")}, gold, seg)
    return _longs(rows.select("variant", "predictions", "tp"))


# --- model seam --------------------------------------------------------------------------


@query("""WITH c AS (SELECT CAST(conv_id AS VARCHAR) AS doc_id, text, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS total, lag(text) OVER w AS p, lead(text) OVER w AS f
    FROM (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
  x AS (SELECT doc_id, n, list_filter([right(p, 1024), text, left(f, 1024)], lambda y: y IS NOT NULL AND y <> '') AS parts FROM c WHERE total > 1 AND n % 2 = 1 AND length(text) <= 4096)
  SELECT doc_id, 's' || lpad(CAST(n AS VARCHAR), 6, '0') AS segment_id, CAST(len(parts) AS BIGINT) AS pieces, array_to_string(parts, chr(10)) AS context FROM x WHERE len(parts) > 0""")
def context_windows(spark, sf_dir):
    rows = model.context_windows(from_conversations(table(spark, sf_dir, "conversations")))
    return _longs(rows.select("doc_id", "segment_id", F.size("pieces").alias("pieces"), "context"))


@query("""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL),
  c AS (SELECT doc_id, n, unnest(range(0, CASE WHEN n = 0 THEN 0 WHEN n <= 1000 THEN 1 ELSE CAST(ceil((n - 1000) / 900.0) AS BIGINT) + 1 END)) AS i FROM d)
  SELECT doc_id, i * 900 AS chunk_start, least(i * 900 + 1000, n) AS chunk_end FROM c""")
def char_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("s000001").alias("segment_id"), "text")
    return _longs(model.chunked(docs, 1000, 100).select("doc_id", "chunk_start", "chunk_end"))


def capital_pairs() -> model.Adapter:
    """A stand-in for a neural model: two capitalised words in a row."""
    import re

    pattern = re.compile(r"\b[A-Z][a-z]+ [A-Z][a-z]+\b")
    return lambda text, labels, threshold: [{"label": "person", "start": m.start(), "end": m.end(), "text": m[0], "score": 0.3 if m.start() % 2 else 0.8} for m in pattern.finditer(text)]


# where the pairs of the talk stand; a window's lead is even, so that a place keeps its parity there
_PAIRS = f"""pair AS (SELECT doc_id, segment_id, k, CAST(start AS BIGINT) AS start, CAST(start + length(text) AS BIGINT) AS "end", text, 'person' AS category, CASE WHEN start % 2 = 1 THEN 0.3::DOUBLE ELSE 0.8::DOUBLE END AS score,
    'model:stand-in:person' AS detector, start % 2 = 1 AS review_only FROM (
  SELECT doc_id, segment_id, k, CASE n WHEN 1 THEN 0 ELSE 11 END AS start, {_NAME} AS text FROM talk WHERE n IN (1, 5)
  UNION ALL SELECT doc_id, segment_id, k, length({_NAME}) + 2, 'Guten Tag' FROM talk WHERE n = 1
  UNION ALL SELECT doc_id, segment_id, k, {_SURNAME} - 5, 'Herr ' || ln FROM talk WHERE n = 5))"""


@query(f"WITH {_TALK}, {_PAIRS} SELECT doc_id, segment_id, start, \"end\", text, category, score, detector, NULL::VARCHAR AS entity_key, review_only FROM pair")
def model_adapter_findings(spark, sf_dir):
    rows = model.model_findings(talk(spark, sf_dir), capital_pairs, Policy(), "stand-in")
    return _longs(rows.select(*FINDING_COLUMNS))


@query(f"""WITH {_TALK}, {_PAIRS} SELECT p.doc_id, p.segment_id, p.start, p.text, CASE WHEN p.text = 'Anna Albers' THEN 'p1' WHEN p.text = 'Doris Dietz' THEN 'p2'
  WHEN p.text = t.fn || ' ' || t.ln THEN {_KEY} END AS entity_key FROM pair p JOIN talk t ON p.doc_id = t.doc_id AND t.n = 1""")
def model_links(spark, sf_dir):
    seg = talk(spark, sf_dir)
    found = model.model_findings(seg, capital_pairs, Policy(), "stand-in")
    rows = identity.link_models(found, identity.speaker_labels(seg).select("doc_id", "folded", "entity_key"), parse_policy({"aliases": ALIASES}).alias_table(spark))
    return _longs(rows.select("doc_id", "segment_id", "start", "text", "entity_key"))


#: text, value, category, outcome: each kind of evidence with cases for and against.
EVIDENCE = [
    ("Herr Meier sagt ja.", "Meier", "person", "propose"),
    ("Der Kundenberater kommt.", "Kundenberater", "person", "reject"),
    ("Herr Berater sagt ja.", "Berater", "person", "propose"),
    ("Der A. kam an.", "A.", "person", "review"),
    ("um 12:30 Uhr", "12:30", "phone", "reject"),
    ("um 12:30 Uhr", "30", "phone", "reject"),
    ("Ruf 0301230 an", "0301230", "phone", "propose"),
    ("geboren am 12.03.1980 in Kiel", "12.03.1980", "date_of_birth", "propose"),
    ("Termin am 12.03.1980 in Kiel", "12.03.1980", "date_of_birth", "reject"),
    ("Login: maxmuster", "maxmuster", "username", "propose"),
    ("Er tippt maxmuster so", "maxmuster", "username", "review"),
    ("Mail an x@y.de bitte", "x@y.de", "email", "propose"),
    ("Mail an x@y bitte", "x@y", "email", "review"),
    ("Mail an xy bitte", "xy", "email", "reject"),
    ("Er wohnt in Kiel", "Kiel", "address", "propose"),
    ("Er kennt Kiel", "Kiel", "address", "review"),
    ("Nummer 12345 ist da", "12345", "account_id", "propose"),
    ("Kontonummer ist da", "Kontonummer", "account_id", "reject"),
]
_CASES = "SELECT 'r' || CAST(r_regionkey AS STRING) AS doc_id, 's' || lpad(CAST(n AS STRING), 6, '0') AS segment_id, text, value, category, a, outcome FROM region CROSS JOIN (VALUES {}) AS v(n, text, value, category, a, outcome)".format(
    ", ".join(f"({i}, '{t}', '{v}', '{c}', {t.index(v)}, '{o}')" for i, (t, v, c, o) in enumerate(EVIDENCE, 1))
)


@query(f"SELECT doc_id, segment_id, CAST(a AS BIGINT) AS start, CAST(a + length(value) AS BIGINT) AS \"end\", category, outcome = 'review' AS review_only FROM ({_CASES}) WHERE outcome <> 'reject'")
def evidence_decisions(spark, sf_dir):
    rows = spark.sql(_CASES.replace("FROM region", "FROM {region}"), region=table(spark, sf_dir, "region"))
    found = rows.select("doc_id", "segment_id", F.col("a").alias("start"), (F.col("a") + F.length("value")).alias("end"), F.col("value").alias("text"), "category", F.lit(False).alias("review_only"))
    kept = evidence.apply_evidence(found, rows.select("doc_id", "segment_id", "text"))
    return _longs(kept.select("doc_id", "segment_id", "start", "end", "category", "review_only"))


@query()
def detect_with_model(spark, sf_dir):
    return _longs(detect(talk(spark, sf_dir), parse_policy({"aliases": ALIASES}), capital_pairs, "stand-in").select(*FINDING_COLUMNS))


# --- manifests and progress -----------------------------------------------------------------

_PATHS = "SELECT 'data/' || c_mktsegment || '/' || CAST(c_custkey AS STRING) || '.bin' AS path, c_custkey * 10 AS bytes, sha2(c_name, 256) AS sha256 FROM customer"
_PATHS_DUCK = _PATHS.replace("sha2(c_name, 256)", "sha256(c_name)")


@query(f"WITH m AS ({_PATHS_DUCK}) SELECT path, CASE WHEN bytes % 50 = 0 THEN 'removed' ELSE 'changed' END AS change FROM m WHERE bytes % 50 = 0 OR bytes % 70 = 0 UNION ALL SELECT path || '.new', 'added' FROM m WHERE bytes % 110 = 0 AND bytes % 50 <> 0")
def manifest_diff(spark, sf_dir):
    old = spark.sql(_PATHS.replace("FROM customer", "FROM {customer}"), customer=table(spark, sf_dir, "customer"))
    kept = old.where("bytes % 50 != 0")
    added = kept.where("bytes % 110 = 0").withColumn("path", F.concat("path", F.lit(".new")))
    return manifests.manifest_diff(old, kept.withColumn("bytes", F.when(F.col("bytes") % 70 == 0, F.col("bytes") + 1).otherwise(F.col("bytes"))).unionByName(added))


@query(f"WITH m AS ({_PATHS_DUCK}) SELECT violation, count(*) AS n FROM (SELECT 'unsafe_name' AS violation FROM m WHERE bytes % 30 = 0 UNION ALL SELECT 'case_clash' FROM m WHERE bytes % 70 = 0) GROUP BY violation")
def manifest_violations(spark, sf_dir):
    old = spark.sql(_PATHS.replace("FROM customer", "FROM {customer}"), customer=table(spark, sf_dir, "customer"))
    bad = old.where("bytes % 30 = 0").withColumn("path", F.concat(F.lit("../"), "path"))
    twin = old.where("bytes % 70 = 0").withColumn("path", F.upper("path"))
    return manifests.manifest_violations(old.unionByName(bad).unionByName(twin)).groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH e AS (SELECT event_type AS task, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS completed FROM events)
  SELECT task, epoch_ms(time_bucket(INTERVAL '1 hour', ts)) // 1000 AS slot, max(completed) AS completed FROM e GROUP BY ALL""")
def progress_slots(spark, sf_dir):
    rows = eta.completed_counts(table(spark, sf_dir, "events"), "event_type", "ts", "event_id")
    slots = rows.groupBy("task", F.window("ts", "1 hour").alias("w")).agg(F.max("completed").alias("completed"))
    return _longs(slots.select("task", F.unix_timestamp("w.start").alias("slot"), "completed"))


_POINTS = """e AS (SELECT event_type AS task, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS c, count(*) OVER (PARTITION BY event_type) AS total FROM events),
  nxt AS (SELECT task, c, total, greatest(5, 1 + count(*) OVER (PARTITION BY task ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL '9.999999 seconds' FOLLOWING)) AS n FROM e),
  p AS (SELECT task, 1::BIGINT AS c FROM e WHERE c = 1 AND total > 1 UNION ALL SELECT nxt.task, nxt.n FROM p JOIN nxt ON p.task = nxt.task AND p.c = nxt.c WHERE nxt.n < nxt.total),
  pt AS (SELECT e.task, e.c, e.total, epoch_us(e.ts) / 1000000.0 AS t FROM p JOIN e ON p.task = e.task AND p.c = e.c)"""


def _progress_points(spark, sf_dir):
    return eta.windowed_points(eta.completed_counts(table(spark, sf_dir, "events"), "event_type", "ts", "event_id"))


@query(f"WITH RECURSIVE {_POINTS} SELECT task, c AS completed, total FROM pt")
def progress_points(spark, sf_dir):
    return _longs(_progress_points(spark, sf_dir).select("task", "completed", "total"))


@query(f"""WITH RECURSIVE {_POINTS},
  st AS (SELECT *, lag(t) OVER w AS t0, lag(c) OVER w AS c0, first_value(t) OVER w AS t1, first_value(c) OVER w AS c1, row_number() OVER w AS k FROM pt WINDOW w AS (PARTITION BY task ORDER BY c)),
  x AS (SELECT a.task, a.c, a.total, a.t, a.t1, a.c1, b.t0, b.c0, b.k, (b.t - b.t0) / (b.c - b.c0) AS cost, (b.c - b.c0) * pow(0.8, a.k - b.k) AS w
    FROM st a JOIN st b ON a.task = b.task AND b.k BETWEEN a.k - {eta.KEPT_POINTS - 2} AND a.k WHERE a.c0 IS NOT NULL AND b.c0 IS NOT NULL),
  m AS (SELECT task, c, total, t, t1, c1, sum(cost * w) / sum(w) AS mean, arg_min(t0, k) AS t0, arg_min(c0, k) AS c0 FROM x GROUP BY ALL),
  v AS (SELECT m.*, s.var FROM m JOIN (SELECT x.task, x.c, sum(x.w * pow(x.cost - m.mean, 2)) / sum(x.w) AS var FROM x JOIN m ON x.task = m.task AND x.c = m.c GROUP BY x.task, x.c) s ON m.task = s.task AND m.c = s.c)
  SELECT task, c AS completed, CAST(round(low * (total - c)) AS BIGINT) AS low, CAST(round(greatest(low * 1.2, mean + greatest(mean * 0.2, sqrt(var))) * (total - c)) AS BIGINT) AS high
  FROM (SELECT *, greatest(mean, (t - t0) / (c - c0), (t - t1) / (c - c1)) AS low FROM v) WHERE t - t0 >= 10""")
def eta_windows(spark, sf_dir):
    rows = eta.eta_ranges(_progress_points(spark, sf_dir))
    return _longs(rows.select("task", "completed", F.round("low").cast("long").alias("low"), F.round("high").cast("long").alias("high")))


# --- entry -------------------------------------------------------------------------------


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule findings of all document lines, with their canonical ids."""
    found = resolve.with_ids(rules.rule_findings(lines(spark, sf_dir)))
    return _longs(found.select("doc_id", "segment_id", "start", "end", "category", "detector", "id"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)

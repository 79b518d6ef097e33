"""Licence scans: canonical digests of entire texts, hash-joined to those of known licences.

Everything here is DataFrame code; no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from importlib.resources import files
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from areagrade.llm.columns import Apart
from areagrade.llm.licence_texts import KNOWN

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Spellings that mean the same, as (pattern, common form); applied to lower-case text.
SPELLINGS = (
    (r"\b(sub|re|un)?licen[cs](e|es|ed|ing|ee|ees|or|ors|er|ers)\b", r"\1licens\2"),
    (r"\b(sub|re) licens", r"\1licens"),
    (r"\bnon (infring|commercial|exclusive)", r"non\1"),
    (r"\b(organi|recogni|authori|initiali|utili)s(e|es|ed|ing|ation|ations)\b", r"\1z\2"),
    (r"\b(acknowledg|judg)ement", r"\1ment"),
    (r"\b(fav|hon|lab|behavi)our", r"\1or"),
    (r"\bfulfill", r"fulfil"),
    (r"\bcopyright owners?\b", r"copyright holder"),
    (r"\bcopyright holders\b", r"copyright holder"),
    (r"\bper cent\b", r"percent"),
    (r"\bhttps? ", r"http "),
    (r"\bwilful\b", r"willful"),
    (r"\b(merchant)ibility\b", r"\1ability"),
)
# For each pattern, strings of which every match holds one; looking for these is far cheaper.
HELD = (
    ("licen",),
    (" licens",),
    ("non infring", "non commercial", "non exclusive"),
    ("organis", "recognis", "authoris", "initialis", "utilis"),
    ("acknowledgement", "judgement"),
    ("favour", "honour", "labour", "behaviour"),
    ("fulfill",),
    ("copyright owner",),
    ("copyright holders",),
    ("per cent",),
    ("https ",),  # "http " is the common form
    ("wilful",),
    ("merchantibility",),
)
# A line that only states a copyright: the word or sign with a holder or year behind it. A line that
# starts with the word as part of a wrapped sentence is none, nor is the item (c) of a list.
_PARTS = r"(?:(?:(?:some|all|certain) )?(?:portions|parts|modifications|changes|additions|contributions)(?: of this (?:software|work|file|code))?(?: are| is)?[ \t:,]+)?"
_PROSE = (
    r"(?:(?:notices?|holders?|owners?|licen[cs]es?|licen[cs]ed|laws?|statements?|interests?|rights?|protection|treat(?:y|ies)|lines?|claims?|permissions?|infringements?|disclaimers?"
    r"|and|or|in|on|of|to|is|are|as|for|that|which|also|if|under|with|from|not|may|shall|must|will|can|has|have|was|were|at|than|where|when|but)\b)"
)
_YEAR = r"(?:[0-9]{4}\b|[<\[{]?(?:19yy|yyyy|year)\b|copyright\b|\xa9)"
_HOLDER = r"[^\n]{0,60}\b(?:(?:19|20)[0-9]{2}|inc|ltd|llc|gmbh|corp|corporation|foundation|contributors|authors|team|all rights reserved)\b[^a-z0-9\n]*(?=\n|$)"
COPYRIGHT_LINE = (
    rf"(^|\n)[^a-z0-9\n]*{_PARTS}[^a-z0-9\n]*"
    rf"(?:copyright\b[ \t:,]*(?!{_PROSE})[a-z0-9(<\[{{\x80-\x{{10ffff}}]"
    rf"|\xa9[^\n]*[a-z0-9]"
    rf"|c\b\)?[ \t:,]*(?:{_YEAR}|{_HOLDER}))[^\n]*"
    r"|^[^a-z0-9]*\(c\)[ \t]+(?=[a-z0-9])[^\n]*"
)
RIGHTS_LINE = r"(^|\n)[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*"


def canonical(text: Column) -> Column:
    """Lower-case words with one blank between; lines stay apart.

    Copyright lines go, ASCII punctuation counts as white space, and equivalent spellings
    become one. A null gives the empty text.
    """
    out = F.translate(F.coalesce(text, F.lit("")), UPPER + "\r", LOWER + "\n")
    out = F.regexp_replace(out, COPYRIGHT_LINE, "\n")
    out = _where_held(out, lambda x: F.contains(x, F.lit("all rights reserved")), RIGHTS_LINE, "\n")
    out = F.regexp_replace(out, r"[\x01-\x09\x0b-\x2f\x3a-\x60\x7b-\x7f]+", " ")
    for (pattern, form), parts in zip(SPELLINGS, HELD, strict=True):
        out = _where_held(out, lambda x, parts=parts: reduce(or_, (F.contains(x, F.lit(p)) for p in parts)), pattern, form.replace("\\", "$"))
    return out


def _where_held(text: Column, held: Callable[[Column], Column], pattern: str, form: str) -> Column:
    """``pattern`` replaced in the texts that ``held`` is true of; the text itself is worked out once."""
    return F.transform(F.array(text), lambda x: F.when(held(x), F.regexp_replace(x, pattern, form)).otherwise(x))[0]


def canonical_lines(text: Column) -> Column:
    """The canonical lines that hold a word."""
    return F.filter(F.transform(F.split(canonical(text), "\n", -1), lambda x: F.trim(x)), lambda x: x != "")


def known_texts() -> dict[str, str]:
    """KNOWN and the entire texts of ``known_licences``, these also without what follows their terms."""
    out = dict(KNOWN)
    for file in sorted(files("areagrade.llm").joinpath("known_licences").iterdir(), key=lambda f: f.name):
        name, body = file.name.removesuffix(".txt"), file.read_text("utf-8")
        out[f"{name}#entire"] = body
        terms, end, _ = body.partition("END OF TERMS AND CONDITIONS")
        if end:
            out[f"{name}#terms"], out[f"{name}#terms, without end"] = terms + end, terms
    return out


def known_digests(spark: SparkSession, known: dict[str, str] | None = None) -> DataFrame:
    """(digest, licence) of known texts; spellings of the same licence share a name."""
    known = known_texts() if known is None else known
    rows = spark.createDataFrame([(name.split("#")[0], text) for name, text in known.items()], "licence string, body string")
    return rows.select(F.sha2(F.array_join(canonical_lines(F.col("body")), " "), 256).alias("digest"), "licence").distinct()


def scan_licences(docs: DataFrame, known: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``digest`` (of the canonical text), ``licences`` (of the entire text) and
    ``notices`` (licences of which the entire known text is one line of the document).

    Both are sorted arrays without repetition, empty where nothing is known. A null or empty
    text has the digest of the empty text. Rows of equal texts get equal results, repeated rows
    stay; columns of these three names are replaced.

    Only digests are joined, and each text is made canonical once. The lines that match nothing
    leave before the shuffle wherever Spark finds ``known`` small enough to broadcast; otherwise
    both sides are dealt by digest.
    """
    apart = Apart(docs, ("digest", "licences", "notices"))
    body = F.coalesce(F.col(apart.of(text)), F.lit(""))
    texts = apart.rows.select(F.sha2(body, 256).alias("text_id"), canonical_lines(body).alias("lines"))
    whole = F.struct(F.lit("licences").alias("unit"), F.sha2(F.array_join("lines", " "), 256).alias("digest"))
    one = F.transform(F.array_distinct("lines"), lambda x: F.struct(F.lit("notices").alias("unit"), F.sha2(x, 256).alias("digest")))
    units = texts.select("text_id", F.explode(F.concat(F.array(whole), one)).alias("u")).select("text_id", "u.unit", "u.digest")
    entire = F.col("unit") == "licences"
    found = units.join(known, "digest", "left").where(entire | F.col("licence").isNotNull()).groupBy("text_id").agg(
        F.max(F.when(entire, F.col("digest"))).alias("digest"),
        *(F.sort_array(F.collect_set(F.when(F.col("unit") == kind, F.col("licence")))).alias(kind) for kind in ("licences", "notices")),
    )
    return apart.rows.withColumn("text_id", F.sha2(body, 256)).join(found, "text_id").select(*apart.back(), "digest", "licences", "notices")


def op10_licence_scan(spark: SparkSession, sf: str) -> DataFrame:
    from areagrade.sources.tables import read_table

    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    found = scan_licences(docs, known_digests(spark))
    return found.select("doc_id", "digest", *(F.array_join(kind, "|").alias(kind) for kind in ("licences", "notices")))


# The SQL's own, earlier form of COPYRIGHT_LINE.
_SQL_COPYRIGHT_LINE = r"(^|\n)[^a-z0-9\n]*(copyright|c|\xa9)[ \t:,]*(\(c\)|\xa9|c |copyright|[0-9]{4}|by|the)[^\n]*"


def _sql_canonical(column: str) -> str:
    out = f"translate(coalesce({column}, ''), '{UPPER}' || chr(13), '{LOWER}' || chr(10))"
    for pattern, form in (
        (_SQL_COPYRIGHT_LINE, "\n"),
        (RIGHTS_LINE, "\n"),
        (r"[\x01-\x09\x0b-\x2f\x3a-\x60\x7b-\x7f]+", " "),
        *SPELLINGS,
    ):
        out = f"regexp_replace({out}, '{pattern}', {'chr(10)' if form == chr(10) else repr(form).replace(chr(92) * 2, chr(92))}, 'g')"
    return out


def _sql_lines(column: str) -> str:
    return f"list_filter(list_transform(string_split({_sql_canonical(column)}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


def op10_sql() -> str:
    rows = ",\n".join("('" + name.split("#")[0] + "', '" + body.replace("'", "''") + "')" for name, body in KNOWN.items())
    return f"""
WITH known_texts(licence, body) AS (VALUES {rows}),
known AS (SELECT DISTINCT sha256(array_to_string({_sql_lines('body')}, ' ')) AS digest, licence FROM known_texts),
texts AS (SELECT row_number() OVER () AS r, doc_id, {_sql_lines('text')} AS lines FROM documents),
units AS (
  SELECT r, 'licences' AS unit, sha256(array_to_string(lines, ' ')) AS digest FROM texts
  UNION ALL
  SELECT r, 'notices', sha256(line) FROM (SELECT r, unnest(list_distinct(lines)) AS line FROM texts)
),
found AS (SELECT r, unit, string_agg(DISTINCT licence, '|' ORDER BY licence) AS names FROM units JOIN known USING (digest) GROUP BY r, unit)
SELECT t.doc_id, sha256(array_to_string(t.lines, ' ')) AS digest, coalesce(a.names, '') AS licences, coalesce(b.names, '') AS notices
FROM texts t LEFT JOIN found a ON a.r = t.r AND a.unit = 'licences' LEFT JOIN found b ON b.r = t.r AND b.unit = 'notices'
"""

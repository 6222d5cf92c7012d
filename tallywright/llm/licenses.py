"""Licence scan by ordered signature rules, in Spark SQL functions only.

Each text becomes its words, joined by single spaces. The rules are hand-written regular expressions
over these words (``license_rules``), in families. A keyword prefilter, derived from the rules
themselves, skips the families none of whose rules can fit; the rules of a family that is left are one
literal pattern, tried in their order at every place. Detections are word intervals. Equal intervals
go to the rule with the smaller priority number; an interval inside a longer one is suppressed.
Phrases of the base contract are counted on their own and never suppressed.

Defined cases: a null text counts as empty; a text without words has no places, null first and
last word, empty labels and score 0; repeated rows each get their row; extra columns stay, but those
named like the results are replaced by them; all places of a very long text count.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add, or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm.license_rules import RULES, Rule, families, first_letters, keywords

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What lies between words: all ASCII but letters and digits.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: "Or later" written as a plus, which else would be lost between words; the sign that stands for it is part of a word.
PLUS, MARKED = r"((?:gpl|gfdl|public licen[sc]e)[ ,-]{0,2}(?:version |v ?)?[0-9](?:\.[0-9])?)\+", "⁺"
#: The phrases of the contract and their labels.
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
#: How sure a phrase of the contract is on its own: like a bare licence name.
PHRASE_SURE = 0.8
_FOUND = "struct<start:int,back:int,priority:int,label:string,sure:double>"
_EMPTY = f"array<{_FOUND}>"
#: Marks around a detection; both are separators, so no word holds them.
_OPEN, _SHUT = "\x01", "\x02"
#: Detections that one step of the suppression takes together.
_CHUNK = 256


def joined_words(raw: F.Column) -> F.Column:
    """The words of a text, A-Z lower-cased, with one space before, between and after them."""
    low = F.translate(raw, UPPER, LOWER)
    plus = F.contains(low, F.lit("+")) & F.rlike(low, F.lit(PLUS))
    low = F.when(plus, F.regexp_replace(low, PLUS, f"$1{MARKED}")).otherwise(low)
    words = F.trim(F.regexp_replace(low, SEPARATORS, " "))
    return F.when(words == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def _spaces(text: F.Column) -> F.Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))


def _place_count(joined: F.Column, phrase: str) -> tuple[F.Column, F.Column, F.Column]:
    """(places, first word, last word) of ``phrase``; the two words are null without a place."""
    pieces = F.split(joined, f"(?<= ){phrase}(?= )", -1)
    there = F.contains(joined, F.lit(f" {phrase} "))
    n = F.when(there, F.size(pieces) - 1).otherwise(0)
    first = F.when(there, _spaces(F.element_at(pieces, 1)) - 1)
    last = F.when(there, _spaces(joined) - 1 - phrase.count(" ") - _spaces(F.element_at(pieces, -1)))
    return n, first, last


def _gate(joined: F.Column, rules: list[Rule]) -> F.Column:
    """Whether a rule may fit; the keywords with "licen" are looked for only where that stands."""
    licen = [k for k in keywords(rules) if "licen" in k]
    other = [F.contains(joined, F.lit(k)) for k in keywords(rules) if "licen" not in k]
    named = [F.contains(joined, F.lit("licen")) & reduce(or_, [F.contains(joined, F.lit(k)) for k in licen])] if licen else []
    return reduce(or_, other + named)


def _detections(joined: F.Column, rules: list[Rule]) -> F.Column:
    """Array of the detections of one family's rules, which do not overlap each other.

    ``back`` is the negative end, so that the longest detection at a place sorts first.
    """
    first = "".join(sorted(set().union(*(first_letters(r.regex) for r in rules))))
    pattern = f"(?<= )(?=[{first}])(?:{'|'.join(r.regex for r in rules)})(?= )"
    table = F.array(*[F.struct(F.lit(r.priority).alias("priority"), F.lit(r.label).alias("label"), F.lit(r.sure).alias("sure")) for r in rules])
    # What matched is short; the first rule that fits all of it is the one that did. Each pattern is a literal, compiled once.
    which = lambda value: F.element_at(table, F.coalesce(*[F.when(F.rlike(value, F.lit(f"^(?:{r.regex})$")), F.lit(k + 1)) for k, r in enumerate(rules)]))
    at = lambda words, mark: F.filter(F.transform(words, lambda w, i: F.when(mark(w), i)), lambda i: i.isNotNull())

    def placed(marked: F.Column) -> F.Column:
        values = F.regexp_extract_all(marked, F.lit(f"{_OPEN}([^{_SHUT}]*){_SHUT}"), F.lit(1))
        words = F.split(marked, " ", -1)
        spans = _named(words, lambda w: F.zip_with(at(w, lambda x: F.startswith(x, F.lit(_OPEN))), at(w, lambda x: F.endswith(x, F.lit(_SHUT))), lambda a, b: F.struct((a - 1).alias("start"), (-b).alias("back"))))
        return F.zip_with(spans, values, lambda x, v: F.struct(x["start"], x["back"], which(v).alias("rule")))

    found = F.transform(
        # The text is searched once and the marks are read from what comes out.
        _named(F.regexp_replace(joined, pattern, f"{_OPEN}$0{_SHUT}"), placed),
        lambda x: F.struct(x["start"], x["back"], x["rule"]["priority"].alias("priority"), x["rule"]["label"].alias("label"), x["rule"]["sure"].alias("sure")),
    )
    return F.when(_gate(joined, rules), found).otherwise(F.array().cast(_EMPTY))


def _named(value: F.Column, made: Callable[[F.Column], F.Column]) -> F.Column:
    """``made`` of ``value``, which is worked out once a row."""
    return F.transform(F.array(value), made)[0]


def _kept(found: F.Column) -> F.Column:
    """Of sorted detections those that are not inside one before them.

    By start, the longest first and then the better priority: whatever ends no later than one before it lies
    inside that one, or equals it with a worse priority. Chunks keep the copying of arrays far from quadratic.
    """
    none = F.array().cast(_EMPTY)

    def one(acc: F.Column, d: F.Column) -> F.Column:
        grown = F.struct((-d["back"]).alias("reach"), F.concat(acc["out"], F.array(d)).alias("out"))
        return F.when(-d["back"] > acc["reach"], grown).otherwise(acc)

    def chunk(acc: F.Column, k: F.Column) -> F.Column:
        part = F.aggregate(F.slice(found, k * _CHUNK + 1, _CHUNK), F.struct(acc["reach"].alias("reach"), none.alias("out")), one)
        return F.transform(F.array(part), lambda p: F.struct(p["reach"].alias("reach"), F.concat(acc["outs"], F.array(p["out"])).alias("outs")))[0]

    start = F.struct(F.lit(-1).alias("reach"), F.array().cast(f"array<{_EMPTY}>").alias("outs"))
    chunks = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / _CHUNK).cast("int"))
    return F.when(F.size(found) > 0, F.flatten(F.aggregate(chunks, start, chunk)["outs"])).otherwise(none)


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels, score and detections."""
    joined, every = F.col("_joined"), range(len(PHRASES))
    df = docs.withColumn("_joined", joined_words(F.coalesce(F.col(text), F.lit(""))))
    places = [_place_count(joined, p) for p, _ in PHRASES]
    df = df.withColumns({f"_{k}_{i}": c for i, place in enumerate(places) for k, c in zip("nfl", place, strict=True)})
    df = df.withColumn("_found", F.array_sort(F.concat(*[_detections(joined, rules) for rules in families().values()])))
    df = df.withColumn("detections", _kept(F.col("_found")))
    base = F.array_compact(F.array(*[F.when(F.col(f"_n_{i}") > 0, F.lit(PHRASES[i][1])) for i in every]))
    sure = F.coalesce(F.array_max(F.transform("detections", lambda d: d["sure"])), F.lit(0.0))
    return df.withColumns(
        {
            "n_words": (_spaces(joined) - 1).cast("long"),
            "n_base": reduce(add, [F.col(f"_n_{i}") for i in every]).cast("long"),
            "first_word": F.least(*[F.col(f"_f_{i}") for i in every]).cast("long"),
            "last_word": F.greatest(*[F.col(f"_l_{i}") for i in every]).cast("long"),
            "base_labels": F.array_join(F.array_sort(F.array_distinct(base)), ","),
            "labels": F.array_join(F.array_sort(F.array_distinct(F.concat(base, F.transform("detections", lambda d: d["label"])))), ","),
            "score": F.greatest(sure, F.when(F.size(base) > 0, F.lit(PHRASE_SURE)).otherwise(F.lit(0.0))),
        }
    ).drop("_joined", "_found", *[f"_{k}_{i}" for k in "nfl" for i in every])


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ``documents`` text against the rules."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan_licenses(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _sql_regex(regex: str) -> str:
    """A rule for words that each have a space of their own on either side; SQL has no look-around."""
    return f" (?:{regex.replace('[^ ]', '@').replace(' ', '  ').replace('@', '[^ ]')}) "


_FAMILIES_SQL = ", ".join(f"('{name}', '{_sql_regex('|'.join(r.regex for r in rules))}')" for name, rules in families().items())
_RULES_SQL = ", ".join(f"('{r.family}', {r.priority}, '{r.label}', '{_sql_regex(r.regex)}', {r.sure}::DOUBLE)" for r in RULES)
_PHRASES_SQL = ", ".join(f"('{label}', '{_sql_regex(phrase)}')" for phrase, label in PHRASES)
OP10_SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{PLUS}', '\1{MARKED}', 'g'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT doc_id, ' ' || array_to_string(w, '  ') || ' ' AS t FROM w),
f(family, regex) AS (VALUES {_FAMILIES_SQL}),
h(label, regex) AS (VALUES {_PHRASES_SQL}),
r(family, priority, label, regex, sure) AS (VALUES {_RULES_SQL}),
y AS (SELECT family, NULL AS label, regex FROM f UNION ALL SELECT NULL, label, regex FROM h),
x AS (SELECT doc_id, family, label, regexp_extract_all(t, regex) AS v, list_transform(regexp_extract_all(t, regex), lambda v: (length(v) - length(replace(v, ' ', ''))) // 2) AS m,
             list_transform(regexp_split_to_array(t, regex), lambda v: (length(v) - length(replace(v, ' ', ''))) // 2) AS g FROM t, y WHERE regexp_matches(t, regex)),
s AS (SELECT doc_id, family, label, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'a': (list_sum(g[1:i]) + coalesce(list_sum(m[1:i - 1]), 0))::BIGINT,
             'b': (list_sum(g[1:i]) + list_sum(m[1:i]))::BIGINT, 'v': v[i]}})) AS p FROM x),
z AS (SELECT DISTINCT family, p.v AS v FROM s WHERE family IS NOT NULL),
n AS (SELECT z.family, z.v, min(priority) AS priority FROM z JOIN r ON r.family = z.family AND regexp_full_match(z.v, r.regex) GROUP BY z.family, z.v),
d AS (SELECT s.doc_id, s.p.a AS a, s.p.b AS b, n.priority FROM s JOIN n ON n.family = s.family AND n.v = s.p.v),
k AS (SELECT *, coalesce(max(b) OVER (PARTITION BY doc_id ORDER BY a, b DESC, priority ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS reach FROM d),
l AS (SELECT doc_id, r.label, r.sure, false AS base FROM k JOIN r USING (priority) WHERE b > reach UNION ALL SELECT doc_id, label, {PHRASE_SURE}, true FROM s WHERE family IS NULL),
o AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, max(sure) AS score FROM l GROUP BY doc_id),
b AS (SELECT doc_id, count(*) AS n_base, min(p.a) AS first_word, max(p.a) AS last_word FROM s WHERE family IS NULL GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM w LEFT JOIN o USING (doc_id) LEFT JOIN b USING (doc_id)
"""

r"""Personal data, and terms that give it away, in Spark SQL functions only.

Base: spans of e-mail addresses, IP addresses, card and phone numbers, leftmost and without overlap
per kind. The text between matches and the matches themselves alternate, so their lengths give
every position in one pass. The patterns accept what the contract's patterns do; possessive
repeats and a look-behind keep them linear on texts of any shape.

Method, information-theoretic sanitisation: every distinct base value is a protected entity e. The
words within WINDOW characters of its mentions are terms that may disclose it. Over the whole corpus,

    IC(e) = log2(N / df(e)),   PMI(t, e) = log2(N co(t, e) / (df(t) df(e)))

and a term discloses the share PMI / IC of what there is to know. From GENERALISE on a term is
replaced by a general one, from REMOVE on it goes. A term must stand beside the entity in at least
SUPPORT different contexts: one sentence, however often it is copied, is no evidence. Such terms are
marked beside the entity's mentions, where they link the reader to it.

Defined cases: a null text counts as empty and has no spans; repeated rows each get their row and
count as documents; a row is told by id and text, so ids may repeat; values at the ends of a text
have shorter windows; an empty table gives no rows; extra columns stay.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm.shared import columns_of, private, stored

#: The kinds in order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for the pattern to be worth running.
GATES = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
}
#: Characters to either side of a mention; letters of a term at least.
WINDOW, LETTERS = 60, 3
#: Different contexts that a term needs, and the shares of disclosure that call for action.
SUPPORT, GENERALISE, REMOVE = 2, 0.6, 0.9
TERM = r"\p{L}{%d,}+" % LETTERS

_SPAN = "struct<start:int,end:int,value:string>"


#: Steps that a fold takes together, and code points of a piece of a text. Folds copy what they have made at every
#: step, and a place in a text is found by counting from its start; short stretches keep both linear.
_STEPS, _PIECE = 256, 256
#: Stands for the letters of base values, so that words that reach into one are told: a letter of one old manuscript.
_MASK = "\ua66e"


def _named(value: F.Column, made: Callable[[F.Column], F.Column]) -> F.Column:
    """``made`` of ``value``; a value that only a lambda's variable stands for is worked out once a row."""
    return F.transform(F.array(value), made)[0]


def _folded(steps: F.Column, kind: str, first: F.Column, step: Callable[[F.Column, F.Column], F.Column]) -> F.Column:
    """Array of ``kind`` that ``step(at, element)``, a struct (at, out) of a number and an array, gives one after the other."""
    none = F.array().cast(f"array<{kind}>")

    def one(acc: F.Column, s: F.Column) -> F.Column:
        return F.transform(F.array(step(acc["at"], s)), lambda n: F.struct(n["at"].alias("at"), F.concat(acc["out"], n["out"]).alias("out")))[0]

    def chunk(acc: F.Column, k: F.Column, all_steps: F.Column) -> F.Column:
        part = F.aggregate(F.slice(all_steps, k * _STEPS + 1, _STEPS), F.struct(acc["at"].alias("at"), none.alias("out")), one)
        return F.transform(F.array(part), lambda p: F.struct(p["at"].alias("at"), F.concat(acc["outs"], F.array(p["out"])).alias("outs")))[0]

    def whole(given: F.Column) -> F.Column:
        start = F.struct(first.alias("at"), F.array().cast(f"array<array<{kind}>>").alias("outs"))
        chunks = F.sequence(F.lit(0), F.floor((F.size(given) - 1) / _STEPS).cast("int"))
        return F.when(F.size(given) > 0, F.flatten(F.aggregate(chunks, start, lambda acc, k: chunk(acc, k, given))["outs"])).otherwise(none)

    return _named(steps, whole)


def _placed(text: F.Column, pattern: str, at: F.Column | None = None) -> F.Column:
    """Array of (start, end, value) of all matches, in code points from ``at`` on."""
    # What lies before each match; the last piece has none behind it.
    matches, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, F.lit(pattern), -1)
    steps = F.filter(F.zip_with(matches, between, lambda m, g: F.struct(F.length(g).alias("gap"), m.alias("value"))), lambda x: x["value"].isNotNull())

    def step(at: F.Column, x: F.Column) -> F.Column:
        start, end = at + x["gap"], at + x["gap"] + F.length(x["value"])
        return F.struct(end.alias("at"), F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))).alias("out"))

    return _folded(steps, _SPAN, at if at is not None else F.lit(0), step)


def _pieces(text: F.Column) -> F.Column:
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % _PIECE), F.lit(0))


def _cut(pieces: F.Column, at: F.Column, n: F.Column) -> F.Column:
    """``n`` (at most _PIECE) code points from ``at`` on."""
    k = F.floor(at / _PIECE).cast("int")
    both = F.concat(F.coalesce(F.get(pieces, k), F.lit("")), F.coalesce(F.get(pieces, k + 1), F.lit("")))
    return F.substring(both, at % _PIECE + 1, n)


def _cut_long(pieces: F.Column, at: F.Column, end: F.Column) -> F.Column:
    """The code points from ``at`` up to ``end``, however many."""
    i, j = F.floor(at / _PIECE).cast("int"), F.floor(end / _PIECE).cast("int")
    some = lambda k: F.coalesce(F.get(pieces, k), F.lit(""))
    inside = F.substring(some(i), at % _PIECE + 1, end - at)
    across = F.concat(
        F.substring(some(i), at % _PIECE + 1, F.lit(_PIECE)), F.array_join(F.slice(pieces, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(some(j), F.lit(1), end % _PIECE)
    )
    return F.when(i == j, inside).otherwise(across)


def _digits(value: F.Column) -> F.Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: F.Column) -> F.Column:
    """Whether every second digit from the right, doubled, and the rest sum to a multiple of 10."""
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda acc, i: acc
        + F.when((n - i) % 2 == 0, F.substring(digits, i, F.lit(1)).cast("int")).otherwise(
            F.substring(digits, i, F.lit(1)).cast("int") * 2 - F.when(F.substring(digits, i, F.lit(1)) > "4", 9).otherwise(0)
        ),
    )
    return total % 10 == 0


def _fits(kind: str, value: F.Column) -> F.Column:
    if kind == "ip":
        bare = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(value, r"\."), lambda p: (F.length(bare(p)) <= 3) & (F.coalesce(bare(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        n = F.length(_digits(value))
        return n.between(13, 19) & F.when(n.between(13, 19), _luhn(_digits(value))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _fitting(kind: str) -> F.Column:
    return F.filter(f"_{kind}", lambda s: _fits(kind, s["value"]))


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one array of (start, end, value) per kind."""
    raw = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast(f"array<{_SPAN}>")
    out = docs.withColumns({f"_{k}": F.when(GATES[k](raw), _placed(raw, PATTERNS[k])).otherwise(none) for k in KINDS})
    return out.withColumns({k: _fitting(k) for k in KINDS}).drop(*[f"_{k}" for k in KINDS])


def _each(kind: str, made: Callable) -> F.Column:
    """``made`` of every span of a kind; Spark's own lambdas take no further arguments."""
    return F.transform(kind, lambda s: made(s, kind))


def _key(text: str) -> F.Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _masked(raw: F.Column, kind: str) -> F.Column:
    """Pieces of the text with the letters of the kind's spans masked; an empty array without such a span."""
    matches, between = F.regexp_extract_all(raw, F.lit(PATTERNS[kind]), F.lit(0)), F.split(raw, F.lit(PATTERNS[kind]), -1)
    hidden = lambda m: F.when(_fits(kind, m), F.regexp_replace(m, r"\p{L}", _MASK)).otherwise(m)
    text = F.array_join(F.zip_with(between, matches, lambda g, m: F.concat(g, F.coalesce(hidden(m), F.lit("")))), "")
    return F.when(F.size(kind) > 0, _pieces(text)).otherwise(F.array().cast("array<string>"))


def _windows(text: str) -> F.Column:
    """Array of (entity, context, terms) per base span; a term does not touch any base span."""
    raw = F.coalesce(F.col(text), F.lit(""))

    def around(kind: F.Column, s: F.Column, held: F.Column) -> F.Column:
        first = F.greatest(s["start"] - WINDOW, F.lit(0))
        left = _cut(held["raw"], first, s["start"] - first)
        right = _cut(held["raw"], s["end"], F.lit(WINDOW))
        # Words that the window cuts are none.
        head = F.when(first > 0, F.length(F.regexp_extract(left, r"^\p{L}*", 0))).otherwise(F.lit(0))
        whole_left = F.substring(left, head + 1, F.lit(WINDOW))
        whole_right = F.when(F.length(right) == WINDOW, F.regexp_replace(right, r"\p{L}+$", "")).otherwise(right)
        terms = F.concat(_placed(whole_left, TERM, first + head), _placed(whole_right, TERM, s["end"]))
        touches = lambda t: reduce(or_, [F.contains(_cut(held[k], t["start"], t["end"] - t["start"]), F.lit(_MASK)) for k in KINDS])
        return F.struct(
            F.xxhash64(kind, F.lower(s["value"])).alias("entity"), F.xxhash64(left, right).alias("context"), F.filter(terms, lambda t: ~touches(t)).alias("terms")
        )

    # The span that a window belongs to is masked like all others.
    held = F.struct(_pieces(raw).alias("raw"), *[_masked(raw, k).alias(k) for k in KINDS])
    spans = F.concat(*[_each(k, lambda s, kind: F.struct(F.lit(kind).alias("kind"), s.alias("s"))) for k in KINDS])

    def any_kind(x: F.Column, h: F.Column) -> F.Column:
        return around(x["kind"], x["s"], h)

    return _named(held, lambda h: F.transform(spans, lambda x: any_kind(x, h)))


def _words(text: str) -> F.Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(TERM), F.lit(0)))


def spans_of(docs: DataFrame, text: str = "text", words: bool = False) -> DataFrame:
    """(doc_id, text_key, the arrays of find(), windows), stored; no texts. ``words`` adds the terms of texts with mentions."""
    has = F.size(F.concat(*KINDS)) > 0
    more = [F.when(has, _words("text")).alias("words")] if words else []
    rows = find(docs.select("doc_id", F.col(text).alias("text")))
    return stored(rows.select("doc_id", _key("text").alias("text_key"), *KINDS, F.when(has, _windows("text")).alias("windows"), *more), "spans")


def frequency_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, df_t): in how many rows a term stands."""
    return docs.select(F.explode(_words(text)).alias("term")).groupBy("term").agg(F.count("*").alias("df_t"))


def disclosures(found: DataFrame, frequency: DataFrame) -> DataFrame:
    """(entity, term, share): terms that disclose an entity, by counts over all documents (see frequency_of)."""
    mentions = found.where(F.col("windows").isNotNull()).select("doc_id", "text_key", F.explode("windows").alias("w"))
    mentions = mentions.select("doc_id", "text_key", "w.entity", "w.context", "w.terms")
    row = F.struct("doc_id", "text_key")
    entities = mentions.groupBy("entity").agg(F.countDistinct(row).alias("df_e"))
    together = (
        mentions.select("doc_id", "text_key", "entity", "context", F.explode(F.array_distinct(F.transform("terms", lambda t: F.lower(t["value"])))).alias("term"))
        .groupBy("entity", "term")
        .agg(F.countDistinct(row).alias("co"), F.countDistinct("context").alias("support"))
        .where(F.col("support") >= SUPPORT)
    )
    n = found.count()
    known = F.log2(F.lit(float(n)) / F.col("df_e"))
    pmi = F.log2(F.lit(float(n)) * F.col("co") / (F.greatest("df_t", "co") * F.col("df_e")))
    return (
        together.join(entities.hint("merge"), "entity")
        .join(frequency.hint("merge"), "term")
        .where(F.col("df_e") < n)
        .select("entity", "term", (pmi / known).alias("share"))
        .where(F.col("share") >= GENERALISE)
    )


def term_spans(found: DataFrame, disclosed: DataFrame) -> DataFrame:
    """(doc_id, text_key, terms): sorted (start, end, share) beside the mentions, for rows that have any."""
    beside = (
        found.where(F.col("windows").isNotNull())
        .select("doc_id", "text_key", F.explode("windows").alias("w"))
        .select("doc_id", "text_key", "w.entity", F.explode("w.terms").alias("t"))
        .select("doc_id", "text_key", "entity", F.lower("t.value").alias("term"), "t.start", "t.end")
    )
    return (
        beside.join(disclosed.hint("merge"), ["entity", "term"])
        .groupBy("doc_id", "text_key", "start", "end")
        .agg(F.max("share").alias("share"))
        .groupBy("doc_id", "text_key")
        .agg(F.array_sort(F.collect_list(F.struct("start", "end", "share"))).alias("terms"))
    )


def marked(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, text_key, the arrays per kind, terms) of every row."""
    found = spans_of(docs, text)
    terms = term_spans(found, disclosures(found, frequency_of(docs, text))).withColumnsRenamed({"doc_id": "_id", "text_key": "_row"})
    # Null ids meet too; only rows with mentions have terms.
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_row"))
    return found.join(terms, same, "left").select("doc_id", "text_key", *KINDS, "terms")


def document_terms(found: DataFrame, frequency: DataFrame) -> DataFrame:
    """(doc_id, text_key, term, share): what a document's own entities disclose by terms anywhere in it, for rows with mentions.

    The context is the whole text, so a term needs SUPPORT different texts. Entities that the same rows
    mention, and terms that the same of these rows hold, behave alike: they are put into classes,
    and classes meet. A page of thousands of addresses and its copies are one class of entities
    beside one class of terms and not the product of both.
    """
    row = ["doc_id", "text_key"]
    hashes = [F.xxhash64("doc_id", "text_key"), F.xxhash64("text_key", "doc_id", F.lit("again"))]
    same_rows = [F.bit_xor(h).alias(c) for c, h in zip(("a", "b"), hashes, strict=True)]
    mentions = found.where(F.col("windows").isNotNull()).select(*row, F.explode(F.array_distinct(F.col("windows.entity"))).alias("entity")).distinct()
    # An entity of fewer texts than SUPPORT has no such term.
    entities = mentions.groupBy("entity").agg(F.count("*").alias("df_e"), F.countDistinct("text_key").alias("texts"), *same_rows).where(F.col("texts") >= SUPPORT)
    entities = entities.select("entity", "df_e", F.xxhash64("a", "b", "df_e").alias("class"))
    of_row = stored(mentions.join(entities.hint("merge"), "entity").select(*row, "class", "df_e").distinct(), "entity-classes")
    wide = found.where(F.col("words").isNotNull()).select(*row, "words")
    chosen = of_row.select(row).distinct().withColumnsRenamed({"doc_id": "_id", "text_key": "_row"})
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_row"))
    held = stored(wide.join(chosen, same, "left_semi").dropDuplicates(row).select(*row, F.explode("words").alias("term")), "words")
    # A term in fewer texts than SUPPORT discloses nothing.
    terms = held.groupBy("term").agg(F.count("*").alias("rows"), F.countDistinct("text_key").alias("texts"), *same_rows).where(F.col("texts") >= SUPPORT)
    terms = terms.join(frequency.hint("merge"), "term").select("term", "df_t", F.xxhash64("a", "b", "rows", "df_t").alias("term_class"))
    held = stored(held.join(terms.hint("merge"), "term"), "term-classes")
    classes = held.select(*row, "term_class", "df_t").distinct()
    # A class of terms stands in all rows that its terms stand in.
    met = of_row.join(classes.withColumnsRenamed({"doc_id": "_id", "text_key": "_row"}).hint("merge"), same)
    together = (
        met.groupBy("class", "df_e", "term_class", "df_t", "text_key")
        .agg(F.count("*").alias("rows"))
        .groupBy("class", "df_e", "term_class", "df_t")
        .agg(F.sum("rows").alias("co"), F.count("*").alias("support"))
        .where(F.col("support") >= SUPPORT)
    )
    n = found.count()
    known = F.log2(F.lit(float(n)) / F.col("df_e"))
    pmi = F.log2(F.lit(float(n)) * F.col("co") / (F.greatest("df_t", "co") * F.col("df_e")))
    telling = together.where(F.col("df_e") < n).select("class", "term_class", (pmi / known).alias("share")).where(F.col("share") >= GENERALISE)
    told = of_row.join(telling.hint("merge"), "class").groupBy(*row, "term_class").agg(F.max("share").alias("share")).withColumnsRenamed({"doc_id": "_id", "text_key": "_row", "term_class": "_class"})
    return held.join(told.hint("merge"), same & (F.col("term_class") == F.col("_class"))).select(*row, "term", "share")


def _without(masked: F.Column, given: F.Column) -> F.Column:
    """``masked`` text without the words of ``given`` (term, share), wherever they stand.

    The text is taken apart into kinds, words and what lies between. A word is looked for in one of many
    small buckets of terms, so the work grows with the words and not with words times terms.
    """
    # Two levels of buckets, so that making them stays far from the square of the number of terms.
    n = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(given) / 4)).cast("int"))
    slot = lambda word, n: F.pmod(F.hash(word), n)
    inner = lambda word, n: F.pmod(F.hash(word, F.lit(1)), n)
    split = lambda of, n, at: F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.filter(of, lambda g: at(g["term"], n) == k))
    pieces = F.regexp_extract_all(masked, F.lit(rf"\[(?:{'|'.join(KINDS).upper()})\]|\p{{L}}++|\[|[^\p{{L}}\[]++"), F.lit(0))

    def cleaned(b: F.Column) -> F.Column:
        def put(word: F.Column) -> F.Column:
            bucket = F.get(F.get(b["buckets"], slot(F.lower(word), b["n"])), inner(F.lower(word), b["n"]))
            held = F.filter(bucket, lambda g: g["term"] == F.lower(word))
            return F.coalesce(F.get(F.transform(held, lambda g: F.when(g["share"] >= REMOVE, F.lit("")).otherwise(F.lit("[WORD]"))), F.lit(0)), word)

        return F.array_join(F.transform(pieces, put), "")

    def two_levels(g: F.Column) -> F.Column:
        groups = split(g["given"], g["n"], slot)
        return F.struct(g["n"].alias("n"), F.transform(groups, lambda x: split(x, g["n"], inner)).alias("buckets"))

    return _named(_named(F.struct(n.alias("n"), given.alias("given")), two_levels), cleaned)


def _replaced(raw: F.Column, cuts: F.Column) -> F.Column:
    """The text with the sorted ``cuts`` (start, end, put) put in.

    A span inside the one before it is gone already; one that sticks out loses the rest.
    """
    kind = "struct<from:int,to:int,put:string>"

    def step(at: F.Column, c: F.Column) -> F.Column:
        one = F.array(F.struct(at.alias("from"), c["start"].alias("to"), c["put"].alias("put")))
        more = F.array(F.struct(at.alias("from"), at.alias("to"), F.lit("").alias("put")))
        return F.struct(F.greatest(at, c["end"]).alias("at"), F.when(c["start"] >= at, one).otherwise(more).alias("out"))

    def made(h: F.Column) -> F.Column:
        kept = F.transform(h["steps"], lambda c: F.concat(_cut_long(h["raw"], c["from"], c["to"]), c["put"]))
        last = F.array_max(F.transform(h["cuts"], lambda c: c["end"]))
        return F.concat(F.array_join(kept, ""), _cut_long(h["raw"], F.coalesce(last, F.lit(0)), h["n"]))

    return _named(F.struct(_pieces(raw).alias("raw"), _folded(cuts, kind, F.lit(0), step).alias("steps"), cuts.alias("cuts"), F.length(raw).alias("n")), made)


def sanitised(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with base values replaced by their kind and disclosing terms generalised or removed.

    Unlike op4_privacy's spans, a term that discloses an entity goes from the whole of every
    document that mentions the entity, and terms far from the mention are weighed too. ``n_chars``,
    if there, follows the text. All other columns stay as they are, whatever they are called; a null text stays null.
    """
    row = ["doc_id", "text_key"]
    read = docs.select("doc_id", F.col(text).alias("text"))
    found, frequency = spans_of(read, words=True), stored(frequency_of(read), "frequency")
    beside = found.where(F.col("windows").isNotNull()).select(*row, F.explode(F.array_distinct(F.col("windows.entity"))).alias("entity"))
    beside = beside.join(disclosures(found, frequency).hint("merge"), "entity").select(*row, "term", "share")
    i, r, given, puts, cuts, masked = (private(x) for x in ("id", "row", "given", "puts", "cuts", "masked"))
    terms = beside.unionByName(document_terms(found, frequency)).groupBy(*row, "term").agg(F.max("share").alias("share"))
    terms = terms.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_row")).agg(F.collect_list(F.struct("term", "share")).alias(given))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_row"))
    # Only rows with mentions have terms.
    rows = found.where(F.size(F.concat(*KINDS)) > 0).join(terms.hint("merge"), same, "left").drop("_id", "_row").dropDuplicates(row)
    cut = lambda s, kind: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"[{kind.upper()}]").alias("put"))
    rows = rows.select(F.col("doc_id").alias(i), F.col("text_key").alias(r), given, F.concat(*[_each(k, cut) for k in KINDS]).alias(puts))
    raw, key = F.col(f"`{text}`"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    joined = docs.join(rows, key.eqNullSafe(F.col(r)) & F.col("doc_id").eqNullSafe(F.col(i)), "left").withColumn(cuts, F.array_sort(puts))
    out = joined.withColumn(masked, F.when(F.col(cuts).isNotNull(), _replaced(raw, F.col(cuts))).otherwise(raw))
    out = out.withColumn(text, F.when(F.col(given).isNotNull(), _without(F.col(masked), F.col(given))).otherwise(F.col(masked)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(cuts).isNotNull(), F.length(text).cast("long")).otherwise(F.col("n_chars")))
    return out.select(columns_of(docs))


def op4_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and method spans of every ``documents`` text."""
    rows = marked(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    told = lambda kind: F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind if kind != "terms" else "term"), s["start"].cast("string"), s["end"].cast("string")))
    base = [told(k) for k in KINDS]
    return rows.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(F.concat(*base), ","), 256).alias("base_sha256"),
        F.array_join(F.concat(*base, F.coalesce(told("terms"), F.array().cast("array<string>"))), ",").alias("spans"),
    )


def _placed_sql(text: str, pattern: str, at: str = "0") -> str:
    """List of (s, e, v) of all matches in SQL, as _placed() makes it."""
    size = "lambda x: length(x)"
    return f"""(SELECT list_transform(range(1, len(m) + 1), lambda i: {{'s': {at} + list_sum(list_transform(g[1:i], {size})) + coalesce(list_sum(list_transform(m[1:i - 1], {size})), 0),
      'e': {at} + list_sum(list_transform(g[1:i], {size})) + coalesce(list_sum(list_transform(m[1:i], {size})), 0), 'v': m[i]}})
      FROM (SELECT regexp_extract_all({text}, '{pattern}') AS m, regexp_split_to_array({text}, '{pattern}') AS g))"""


_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_BASE_SQL = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    "ip": (
        r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "len(list_filter(string_split(v, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(ltrim(p, '0') AS INTEGER), 0) > 255)) = 0",
    ),
    "card": (
        r"[0-9]([\x20-]?[0-9])+",
        f"length({_DIGITS}) BETWEEN 13 AND 19 AND list_sum(list_transform(string_split({_DIGITS}, ''), lambda c, i: CASE WHEN (length({_DIGITS}) - i) % 2 = 0 "
        "THEN CAST(c AS INTEGER) ELSE CAST(c AS INTEGER) * 2 - CASE WHEN c > '4' THEN 9 ELSE 0 END END)) % 10 = 0",
    ),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
}
_WORD_SQL = r"\p{L}{%d,}" % LETTERS
_KINDS_SQL = " UNION ALL ".join(
    f"SELECT doc_id, t, {k} AS k, '{kind}' AS kind, x.s::BIGINT AS s, x.e::BIGINT AS e, x.v AS v FROM (SELECT doc_id, t, unnest({_placed_sql('t', pattern)}) AS x FROM d) WHERE {fits.replace('(v,', '(x.v,')}"
    for k, (kind, (pattern, fits)) in enumerate(_BASE_SQL.items())
)
OP4_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS MATERIALIZED ({_KINDS_SQL}),
w AS (SELECT *, greatest(s - {WINDOW}, 0) AS f FROM b),
l AS (SELECT *, substr(t, f + 1, s - f) AS lft, substr(t, e + 1, {WINDOW}) AS rgt FROM w),
h AS (SELECT *, CASE WHEN f > 0 THEN length(regexp_extract(lft, '^\p{{L}}*')) ELSE 0 END AS head,
             CASE WHEN length(rgt) = {WINDOW} THEN regexp_replace(rgt, '\p{{L}}+$', '') ELSE rgt END AS wr FROM l),
g AS (SELECT *, substr(lft, head + 1) AS wl FROM h),
u AS (SELECT doc_id, kind || ':' || lower(v) AS entity, lft || chr(1) || rgt AS context,
             unnest(list_concat({_placed_sql('wl', _WORD_SQL, 'f + head')}, {_placed_sql('wr', _WORD_SQL, 'e')})) AS x FROM g),
m AS MATERIALIZED (SELECT doc_id, entity, context, lower(x.v) AS term, x.s::BIGINT AS s, x.e::BIGINT AS e FROM u
      WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = u.doc_id AND x.s < b.e AND x.e > b.s)),
de AS (SELECT kind || ':' || lower(v) AS entity, count(DISTINCT doc_id) AS df_e FROM b GROUP BY ALL),
co AS (SELECT entity, term, count(DISTINCT doc_id) AS co FROM m GROUP BY ALL HAVING count(DISTINCT context) >= {SUPPORT}),
dt AS (SELECT term, count(*) AS df_t FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(t), '{_WORD_SQL}'))) AS term FROM d) GROUP BY term),
n AS (SELECT count(*)::DOUBLE AS n FROM d),
q AS (SELECT co.entity, co.term FROM co JOIN de USING (entity) JOIN dt USING (term), n
      WHERE df_e < n AND log2(n * co / (greatest(df_t, co) * df_e)) / log2(n / df_e) >= {GENERALISE}),
a AS (SELECT DISTINCT m.doc_id, m.s, m.e FROM m JOIN q USING (entity, term)),
z AS (SELECT doc_id, k, kind, s, e FROM b UNION ALL SELECT doc_id, 9, 'term', s, e FROM a),
o AS (SELECT doc_id, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s, e) AS spans,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s, e) FILTER (k < 9) AS base,
             {', '.join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in KINDS)} FROM z GROUP BY doc_id)
SELECT doc_id, {', '.join(f'coalesce(n_{kind}, 0) AS n_{kind}' for kind in KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN o USING (doc_id)
"""

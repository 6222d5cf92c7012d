"""Text functions as Column expressions: normal forms, classes by word lists, names and labels.

A null text is treated as empty where the result is a flag or a default, and gives null where the
result is something found in the text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallywright.functions import vocabulary as V


def blank_to_null(c: Column) -> Column:
    """Null for an empty string; Spark's extractors return '' where nothing matches."""
    return F.when(c != "", c)


def truthy(c: Column) -> Column:
    """Neither null nor zero."""
    return F.coalesce(c != 0, F.lit(False))


def squashed(s: Column) -> Column:
    """Lower case without white space, dots, dashes and round brackets."""
    return F.lower(F.regexp_replace(F.coalesce(s, F.lit("")), r"[\s·\-_.,()]", ""))


def evidence_key(s: Column) -> Column:
    """As squashed(), without square brackets, colons and slashes as well."""
    return F.lower(F.regexp_replace(F.coalesce(s, F.lit("")), r"[\s\[\]()·\-_.,:/]", ""))


def evidence_forms(s: Column) -> Column:
    """The key of a text, and that of its words without amounts, which wrapped labels need."""
    words = F.filter(F.split(F.coalesce(s, F.lit("")), r"\s+"), lambda w: ~w.rlike(r"^[\d,.\-+%원₩$()]+$"))
    return F.array(evidence_key(s), evidence_key(F.array_join(words, "")))


def supported(label: Column, evidence: Column) -> Column:
    """Whether the text holds the label; without evidence there is no verdict against it."""
    key = evidence_key(label)
    held = (key != "") & F.exists(evidence_forms(evidence), lambda f: F.contains(f, key))
    return F.when(F.coalesce(evidence, F.lit("")) == "", F.lit(True)).otherwise(held)


def bare_name(s: Column) -> Column:
    """Squashed, after round-bracketed remarks are dropped."""
    return squashed(F.regexp_replace(F.coalesce(s, F.lit("")), r"\(.*?\)", ""))


def script_runs(s: Column) -> Column:
    """Runs of Hangul, and of Latin letters with digits, of two characters or more."""
    runs = F.regexp_extract_all(F.coalesce(s, F.lit("")), F.lit(r"[가-힣]+|[A-Za-z][A-Za-z0-9.&]*"), F.lit(0))
    return F.filter(runs, lambda r: F.length(r) > 1)


def holds_any(s: Column, words: tuple[str, ...]) -> Column:
    """Whether the text holds one of the words."""
    text = F.coalesce(s, F.lit(""))
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def first_rule(s: Column, rules, default: str | None = None, lower: bool = False) -> Column:
    """The label of the first rule (words, label) of which the text holds a word."""
    text = F.lower(s) if lower else s
    chain = None
    for words, label in rules:
        words = (words,) if isinstance(words, str) else words
        hit = holds_any(text, tuple(w.lower() for w in words) if lower else words)
        chain = F.when(hit, label) if chain is None else chain.when(hit, label)
    return chain.otherwise(F.lit(default))


def account_type(s: Column) -> Column:
    """Account type, with the general one as default."""
    return first_rule(s, V.ACCOUNT_TYPES, V.DEFAULT_ACCOUNT_TYPE)


def known_account_type(s: Column) -> Column:
    """Account type, null when no rule fits, so that another source can fill it."""
    return first_rule(s, V.ACCOUNT_TYPES)


def asset_class(s: Column) -> Column:
    """Asset class by ordered rules, without regard to case."""
    return first_rule(s, V.ASSET_CLASSES, lower=True)


def is_cash_name(s: Column) -> Column:
    return holds_any(s, V.CASH_WORDS)


def is_category(s: Column) -> Column:
    return F.trim(F.coalesce(s, F.lit(""))).isin(*V.CATEGORIES)


def is_index_line(line: Column) -> Column:
    return holds_any(line, V.INDEX_WORDS)


def header_kind(s: Column) -> Column:
    """Kind of a column header; words for categories are none."""
    rules = [(V.HEADERS[k], k) for k in ("pnl", "rate", "cost", "value", "qty", "cost_unit", "price", "name")]
    return F.when(~holds_any(s, V.HEADER_CATEGORIES), first_rule(s, rules))


def is_header(s: Column) -> Column:
    """Exact header word, after remarks and spaces are dropped."""
    text, words = F.coalesce(s, F.lit("")), [w for words in V.HEADERS.values() for w in words]
    bare = F.regexp_replace(F.regexp_replace(text, r"\(.*?\)", ""), r"\s", "")
    return F.when(text.rlike(r"[(\s]"), bare.isin(*words)).otherwise(text.isin(*words))


def is_field_label(s: Column) -> Column:
    """Whether a row's name labels a figure of the screen instead of a holding."""
    name = F.trim(F.coalesce(s, F.lit("")))
    bare = F.trim(F.regexp_replace(name, r"\(.*?\)", ""))
    exact = F.regexp_replace(bare, " ", "").isin(*[w.replace(" ", "") for w in V.FIELD_LABELS_EXACT])
    return ~is_category(s) & (
        bare.isin(*[w for words in V.HEADERS.values() for w in words])
        | exact
        | name.rlike(r"[›»⌄˅>]\s*$")
        | name.rlike(r"\d,\d{3}|\d\.\d{2}")
        | holds_any(name, V.FIELD_LABELS)
    )


def ticker(s: Column, leading: bool | Column = False) -> Column:
    """Ticker in round brackets, or the whole name, or (if allowed) its first word."""
    name, sign = F.trim(F.coalesce(s, F.lit(""))), "[A-Z][A-Z0-9.]{0,5}"
    first = blank_to_null(F.regexp_extract(name, rf"^({sign})\s+\S", 1))
    allowed = F.lit(leading) if isinstance(leading, bool) else leading
    return F.coalesce(
        blank_to_null(F.regexp_extract(name, rf"\(({sign})\)", 1)),
        F.when(name.rlike(rf"^{sign}$"), name),
        F.when(allowed, first),
    )


def canonical_broker(s: Column) -> Column:
    """The first broker name that is not a stop word before the suffix."""
    found = F.regexp_extract_all(F.coalesce(s, F.lit("")), F.lit("([가-힣A-Za-z]{2,10})증권"), F.lit(1))
    return F.concat(F.try_element_at(F.filter(found, lambda x: ~x.isin(*V.BROKER_STOP_WORDS)), F.lit(1)), F.lit("증권"))


def is_broker_name(s: Column) -> Column:
    return F.coalesce(s.rlike("^[가-힣A-Za-z]{2,6}증권$"), F.lit(False))


def is_placeholder(s: Column) -> Column:
    key = F.lower(F.regexp_replace(F.coalesce(s, F.lit("")), r"[\s\[\]()·\-_.]", ""))
    return (key == "") | key.isin(*V.PLACEHOLDERS)


def brand_token(s: Column) -> Column:
    """Brand in a label: what stands in leading square brackets, else the label without account
    numbers; null for placeholders, sentences and account names."""
    label = F.trim(s)
    inner = F.coalesce(blank_to_null(F.trim(F.regexp_extract(label, r"^\[([^\]]+)\]", 1))), label)
    brand = F.regexp_replace(F.regexp_replace(inner, r"\d[\d\-]{5,}", " "), r"^[\[\]() ]+|[\[\]() ]+$", "")
    fits = (F.length(brand) <= 20) & (F.size(F.split(F.trim(brand), r"\s+")) <= 3) & ~brand.rlike(r"^\d[\d\-\s]+$")
    return F.when(~is_placeholder(s) & ~is_placeholder(brand) & fits & ~holds_any(brand, V.ACCOUNT_HINTS), brand)


def file_brand(s: Column) -> Column:
    """Brand in the name of a screenshot file."""
    stem = F.regexp_replace(F.coalesce(s, F.lit("")), r"\.[A-Za-z0-9]+$", "")
    spaced = F.regexp_replace(stem, r"[\d_\-]+", " ")
    left = F.trim(F.regexp_replace(spaced, r"(?i)screen[-_ ]?shot|kakaotalk|\bimg\b|\bimage\b|\bphoto\b|\bpxl\b|\bdsc\b", " "))
    return F.when((left != "") & ~is_placeholder(left), left)


def account_tokens(s: Column) -> Column:
    """Sorted account numbers and special account types in a text."""
    text = F.coalesce(s, F.lit(""))
    numbers = F.regexp_extract_all(text, F.lit(r"\d[\d-]{6,}"), F.lit(0))
    types = [F.when(F.contains(text, F.lit(n)), account_type(F.lit(n))) for n in V.ACCOUNT_NICKNAMES]
    special = F.filter(F.array_compact(F.array(*types)), lambda t: t != V.DEFAULT_ACCOUNT_TYPE)
    return F.array_sort(F.array_distinct(F.concat(numbers, special)))


def confusable_variants(s: Column) -> Column:
    """Readings one glyph away: a look-alike instead, a doubled stroke less or more.

    Only for tokens of two to six Latin letters and digits; the first MAX_VARIANTS without the token.
    """
    alike = {c: group.replace(c, "") for group in V.CONFUSABLE for c in group}
    others = F.create_map(*[x for c, rest in alike.items() for x in (F.lit(c), F.array(*map(F.lit, rest)))])
    at = lambda i: F.substring(s, i, F.lit(1))
    head = lambda n: F.substring(s, F.lit(1), n)
    tail = lambda i: F.substring(s, i, F.lit(1000))
    none = F.array().cast("array<string>")

    def around(i: Column) -> Column:
        look = F.coalesce(F.try_element_at(others, at(i)), none)
        swapped = F.transform(look, lambda o: F.concat(head(i - 1), o, tail(i + 1)))
        twin = (i > 1) & ((at(i - 1) == at(i)) & F.map_contains_key(others, at(i)) | F.array_contains(look, at(i - 1)))
        fewer = F.when(twin, F.array(F.concat(head(i - 1), tail(i + 1)))).otherwise(none)
        more = F.when(F.contains(F.lit(V.REPEATED_STROKES), at(i)), F.array(F.concat(head(i), at(i), tail(i + 1)))).otherwise(none)
        return F.concat(swapped, fewer, more)

    made = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(s)), around)))
    fits = s.rlike("^[A-Za-z][A-Za-z0-9]{1,5}$")
    return F.when(fits, F.slice(F.filter(made, lambda v: v != s), 1, V.MAX_VARIANTS)).otherwise(none)


def html_text(s: Column) -> Column:
    """Text of a page: scripts, styles and tags go, white space collapses."""
    bare = F.regexp_replace(F.coalesce(s, F.lit("")), r"(?is)<script.*?</script>|<style.*?</style>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]+>", " "), r"\s+", " "))


def source_kind(s: Column) -> Column:
    """The kind of a provenance label: what stands before its colon or bracket; null stays."""
    return F.regexp_extract(s, r"^([^:(]*)", 1)


def quantity_in_name(name: Column, qty: Column) -> Column:
    """Whether the quantity equals a whole number in the name, and so may come from it."""
    numbers = F.regexp_extract_all(F.coalesce(name, F.lit("")), F.lit(r"\d+"), F.lit(0))
    return F.coalesce(F.exists(numbers, lambda n: n.try_cast("double") == qty), F.lit(False))


def char_width(s: Column) -> Column:
    """Width of a text in half characters: East Asian ones count two."""
    return F.length(s) + F.length(F.regexp_replace(F.coalesce(s, F.lit("")), r"[^ᄀ-ᇿ⺀-퟿豈-﫿＀-｠]", ""))

"""Scalar text functions as column expressions. A null text gives null, unless a function says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, units and word lists that results depend on.
UNITS = "V|A|mA|W|kW|mm|cm|m|ms|s|Hz|kHz|MHz|fps|kg|g|N|MPa|deg|C|°C|%"
VALUE = r":\s*\S+|\b\d+(?:\.\d+)?\s?(?:v|a|ma|w|kw|mm|cm|m|ms|s|hz|khz|mhz|fps|kg|g|n|mpa|deg|c|°c|%)\b"
CODES = rf"\b[A-Z]{{1,5}}(?:-[A-Z0-9]{{1,8}})+\b|\b[A-Z]\d{{2,4}}\b|\b\d+(?:\.\d+)?\s?(?:{UNITS})\b"
MEASURES = rf"\b\d+(?:\.\d+)?\s?(?:{UNITS})\b"
PROTOCOLS = r"\b(?:ethernet/?ip|ethercat|profinet|modbus|tcp/?ip|udp|rs-232|rs-485|usb|io-link|canopen)\b"
URL = r"https?://|www\."
PAGE_MARK = r"\bpage\s+\d+\s+of\s+\d+\b"
PHONE_WORD = r"\b(?:toll free|phone|fax)\b"
ASSET = r"\.(?:gif|png|jpe?g|svg|webp|bmp)"
PHONE = r"\+?\d[\d\-\s()]{6,}\d"
VERBS = r"\b(is|are|can|does|set|check|configure|measure|connect|select|display|returns?)\b"
MENU = r"\[[^\]]+\]"
TECHNICAL = ["parameter", "setting", "protocol", "command", "version", "revision", "warning", "caution", "input", "output", "resolution", "accuracy", "tolerance", "procedure", "configuration"]
UNIT_MARKS = [" v", " a", " ma", " w", " kw", " mm", " cm", " hz", " khz", " mhz", "%"]
STOPWORDS = ["the", "and", "for", "with", "from", "that", "this"]
EVAL_STOPWORDS = ["the", "and", "for", "with", "from", "that", "this", "into", "what", "when", "where", "which", "does", "about", "manual", "guide", "datasheet", "document", "product", "section", "step", "warning", "caution", "note"]
GENERIC_ANCHORS = ["use", "used", "using", "click", "only", "one", "value", "values", "displayed", "enter", "following", "remove", "right", "left", "desired", "simply", "specified", "specifies", "shown", "show", "button", "setting", "settings", "information", "data", "output", "input"]
TECHNICAL_VERBS = ["connect", "configure", "set", "install", "select", "enable", "disable", "mount", "measure", "adjust", "trigger", "capture", "transmit", "receive", "assign", "register"]
TECHNICAL_TERMS = ["warning", "caution", "parameter", "command", "protocol", "revision", "version", "voltage", "current", "pressure", "temperature", "accuracy", "resolution", "repeatability", "tolerance", "configuration"]
BOILERPLATE = ["other than as stated herein", "no other warranties whatsoever", "all express implied and statutory warranties", "fitness for a particular purpose", "merchantability", "products/samples are provided"]
MEASURE_TOKEN = r"^\d+(?:\.\d+)?(?:v|a|ma|w|kw|mm|cm|m|ms|s|hz|khz|mhz|fps|kg|g|n|mpa|deg|c|°c|%)$"
MODEL = r"\b[A-Z]{1,5}-[A-Z0-9]{2,12}[A-Z]?\b"
SERIES = r"^([A-Z]{1,5}-[A-Z]+\d)\d*[A-Z]?$"
SPARSE_DIMENSIONS = 50_000
EMBED_CHARS = 6_000


def any_of(text: Column, parts: list[str]) -> Column:
    """Whether any of the parts is a substring."""
    found = F.lit(False)
    for part in parts:
        found = found | text.contains(part)
    return found


def trimmed(text: Column) -> Column:
    return F.trim(text)


def all_matches(text: Column, pattern: str) -> Column:
    """Every match of a pattern, in order."""
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def normalized(text: Column) -> Column:
    """No-break spaces as spaces, runs of blanks as one, three or more line ends as two, ends trimmed."""
    out = F.regexp_replace(F.replace(text, F.lit("\u00a0"), F.lit(" ")), r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def collapsed(text: Column) -> Column:
    """White space runs as one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def folded(text: Column) -> Column:
    """collapsed, in lower case."""
    return F.lower(collapsed(text))


def preview(text: Column, limit: int = 220) -> Column:
    return F.substring(collapsed(text), 1, limit)


def words(text: Column) -> Column:
    """Parts between white space; none for a blank text."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Index and query tokens: runs of letters, digits, _ - . and / of the lower-cased text, in order."""
    return all_matches(F.lower(text), r"[A-Za-z0-9_\-./]+")


def eval_tokens(text: Column) -> Column:
    """Tokens of two characters or more that begin with a letter or digit, with marks at their ends removed, in lower case."""
    found = F.transform(all_matches(F.lower(text), r"[a-zA-Z0-9][a-zA-Z0-9\-/.]+"), lambda t: F.regexp_replace(t, r"^[.,;:]+|[.,;:]+$", ""))
    return F.filter(found, lambda t: t != "")


def answer_terms(text: Column) -> Column:
    """Distinct tokens of three characters or more, without stopwords, sorted."""
    kept = F.filter(tokens(text), lambda t: (F.length(t) >= 3) & ~t.isin(STOPWORDS))
    return F.array_sort(F.array_distinct(kept))


def variants(terms: Column) -> Column:
    """Distinct terms with their forms without - / and . and, if without a digit, the parts between these; sorted."""
    clean = F.filter(F.transform(terms, lambda t: F.lower(F.trim(t))), lambda t: t != "")
    parts = lambda t: F.when(t.rlike(r"\d"), F.array().cast("array<string>")).otherwise(F.split(t, "[-/.]"))
    each = F.transform(clean, lambda t: F.concat(F.array(t, F.regexp_replace(t, "[-/.]", "")), parts(t)))
    return F.array_sort(F.array_distinct(F.filter(F.flatten(each), lambda t: t != "")))


def search_text(text: Column) -> Column:
    """The collapsed text, then its distinct tokens with their forms without -, with / or . or - as spaces, in first-seen order."""
    compact = collapsed(text)
    forms = lambda t: F.array(t, F.replace(t, F.lit("-"), F.lit("")), F.replace(t, F.lit("/"), F.lit(" ")), F.replace(t, F.lit("."), F.lit(" ")), F.replace(t, F.lit("-"), F.lit(" ")))
    every = F.transform(F.flatten(F.transform(tokens(compact), forms)), collapsed)
    listed = F.array_distinct(F.filter(every, lambda t: F.length(t) >= 2))
    return F.when(F.size(listed) > 0, F.concat(compact, F.lit("\n\nSearch terms: "), F.array_join(listed, " | "))).otherwise(compact)


def clipped(text: Column, limit: int = EMBED_CHARS) -> Column:
    """At most limit characters of a collapsed text, back to the last space if that keeps more than 70 % of them."""
    compact = collapsed(text)
    head = F.substring(compact, 1, limit)
    last = limit - F.locate(" ", F.reverse(head))  # place of the last space, from 0; limit if there is none
    spaced = (F.locate(" ", F.reverse(head)) > 0) & (last > int(limit * 0.7))
    return F.when(F.length(compact) <= limit, compact).otherwise(F.trim(F.when(spaced, F.substring(head, F.lit(1), last)).otherwise(head)))


def slot(token: Column, dimensions: int = SPARSE_DIMENSIONS) -> Column:
    """The MD5 of a token, read as one number, modulo dimensions."""
    digest, out = F.md5(token), F.lit(0).cast("long")
    for at in (1, 9, 17, 25):
        out = F.pmod(out * ((1 << 32) % dimensions) + F.conv(F.substring(digest, at, 8), 16, 10).cast("long"), F.lit(dimensions))
    return out


def keywords(text: Column) -> Column:
    """Model and error codes and measures in four forms each, and [menu] labels: sorted, distinct, the first 40."""
    forms = F.flatten(F.transform(all_matches(text, CODES), lambda m: F.array(m, F.lower(m), F.replace(m, F.lit("-"), F.lit("")), F.lower(F.replace(m, F.lit("-"), F.lit(" "))))))
    clean = F.filter(F.transform(F.concat(forms, all_matches(text, MENU)), trimmed), lambda v: v != "")
    return F.slice(F.array_sort(F.array_distinct(clean)), 1, 40)


def menu_labels(text: Column) -> Column:
    return all_matches(text, MENU)


def field_pairs(text: Column) -> Column:
    """(name, value) of every `name: value` of a text."""
    pattern = F.lit(r"([A-Za-z][A-Za-z0-9 /_()-]{1,40})\s*:\s*([^\n;]{1,80})")
    return F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(1)).alias("name"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("value"))


def first_seen(values: Column) -> Column:
    """values without blank ones and without those equal to an earlier one but for case."""

    def step(acc: Column, v: Column) -> Column:
        known = F.exists(acc, lambda a: F.lower(a) == F.lower(F.trim(v)))
        return F.when((F.trim(v) != "") & ~known, F.concat(acc, F.array(F.trim(v)))).otherwise(acc)

    return F.aggregate(values, F.array().cast("array<string>"), step)


def specific(token: Column) -> Column:
    """Whether a token can anchor a question: one with a digit, a technical term or verb, a compound, or five letters or more; no stopword or generic word."""
    plain = ~token.isin(EVAL_STOPWORDS + GENERIC_ANCHORS)
    shaped = token.rlike(r"^[a-z]{2,}\d+[a-z0-9-]*$") | token.rlike(MEASURE_TOKEN) | token.rlike(r"^[a-z]+(?:/[a-z0-9-]+)+$") | token.rlike(r"^[a-z]+-[a-z0-9-]+$")
    return plain & (((F.length(token) >= 3) & token.rlike(r"\d")) | token.isin(TECHNICAL_TERMS + TECHNICAL_VERBS) | shaped | (F.length(token) >= 5))


def high_signal(token: Column) -> Column:
    """Whether an anchor says something by itself: a digit, a technical term or verb, a menu sign, / or -."""
    return token.rlike(r"\d") | token.isin(TECHNICAL_TERMS + TECHNICAL_VERBS) | token.rlike(r"[\[/-]")


def anchors(text: Column, limit: int = 6) -> Column:
    """The first distinct specific tokens."""
    return F.slice(F.array_distinct(F.filter(eval_tokens(text), specific)), 1, limit)


def contents_line(text: Column) -> Column:
    """A line of a table of contents: dots and a page, or a procedure step with a page range."""
    return (folded(text).contains("procedure step") & folded(text).rlike(r"\d+-\d+\b")) | text.rlike(r"\.{4,}\s*\d+(?:-\d+)?\b")


def boilerplate(text: Column) -> Column:
    return any_of(folded(text), BOILERPLATE)


def models(text: Column) -> Column:
    """Distinct model names such as PX-120A, sorted."""
    return F.array_sort(F.array_distinct(F.transform(all_matches(text, MODEL), F.upper)))


def series_of(model: Column) -> Column:
    """A model's series: its letters and first digit; null for a name that is no plain model."""
    whole = F.upper(model)
    return F.when(whole.rlike(SERIES), F.regexp_extract(whole, SERIES, 1))


def title_of(filename: Column) -> Column:
    """A file name without its ending, _ as spaces."""
    return F.trim(F.replace(F.regexp_replace(filename, r"\.[^.]*$", ""), F.lit("_"), F.lit(" ")))


def source_text(filename: Column, text: Column, limit: int = 12_000) -> Column:
    return F.concat(F.lit("FILENAME:\n"), filename, F.lit("\n\nTEXT:\n"), F.substring(text, 1, limit))


def without_thoughts(text: Column) -> Column:
    """A model's output without its <think> parts."""
    return F.trim(F.regexp_replace(text, r"(?is)<think>.*?</think>", ""))


def has_value(text: Column) -> Column:
    """Whether `: something` or a number with a unit stands in the text, in either case."""
    return F.lower(text).rlike(VALUE)


def unwanted(text: Column) -> Column:
    """Whether a URL, a page mark, contact words, an asset's name or a phone number stands in the text."""
    low = F.lower(text)
    return low.rlike(URL) | low.rlike(PAGE_MARK) | low.rlike(PHONE_WORD) | low.rlike(ASSET + r"\b") | text.rlike(PHONE)


def low_information(text: Column, kind: Column, known: Column) -> Column:
    """Nodes that are better left out: blank or unwanted text, two words without a digit or keyword (known), three with one word at most.

    Tables stay unless blank, and specs are held only to the first rule.
    """
    clean = F.trim(text)
    parts = words(clean)
    lettered = F.size(F.filter(parts, lambda w: w.rlike("[A-Za-zÀ-ɏ]")))
    few = ((F.size(parts) <= 2) & ~clean.rlike(r"\d") & ~known) | ((F.size(parts) <= 3) & (lettered <= 1))
    return F.coalesce((clean == "") | ((kind != "table") & (unwanted(clean) | ((kind != "spec") & few))), F.lit(True))


def completeness(text: Column, kind: Column | None = None) -> Column:
    """How much a text says by itself: length, values, digits, sentence marks and a structured kind count for it; heading-like
    brevity, without a value or one of VERBS, against it."""
    clean = F.trim(F.coalesce(text, F.lit("")))
    n, value = F.size(words(clean)), has_value(clean)
    score = F.when(n >= 8, 0.35).when(n >= 5, 0.15).otherwise(0.0)
    score = score + F.when(value, 0.35).otherwise(0.0) + F.when(clean.rlike("[0-9]"), 0.1).otherwise(0.0) + F.when(clean.rlike("[.;:]"), 0.1).otherwise(0.0)
    if kind is not None:
        score = score + F.when(kind.isin("spec_record", "table_record", "procedure_record"), 0.15).otherwise(0.0)
    return score - F.when((n <= 6) & ~value & ~F.lower(clean).rlike(VERBS), 0.4).otherwise(0.0) - F.when(n <= 3, 0.25).otherwise(0.0)

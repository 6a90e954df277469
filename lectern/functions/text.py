"""Normalisation and tokens of titles, names and identifiers. JVM expressions; NFKC alone needs Arrow."""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words and characters that carry no retrieval signal, and the ranges of CJK characters.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "do", "does", "for",
    "from", "how", "in", "is", "it", "its", "of", "on", "or", "that", "the",
    "their", "this", "to", "was", "were", "what", "when", "which", "with",
)
CJK_STOP = "的了与和及其在为对是被把从而且或者之所以我们你他她它"
CJK = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}"

CJK_TERM = re.compile("[" + re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), CJK) + "]")


@F.arrow_udf(T.StringType())
def nfkc(text: pa.Array) -> pa.Array:
    """Compatibility composition (NFKC) of a text."""
    return pc.utf8_normalize(text, form="NFKC")


def fold(text: Column) -> Column:
    """Lower case, punctuation, symbols and white space to one space, other marks dropped; null and nothing to ''.

    Sharp s becomes ss, as case folding has it. Apply nfkc() before where compatibility forms occur."""
    lowered = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ß"), F.lit("ss"))
    spaced = F.regexp_replace(lowered, r"[\p{P}\p{S}\s]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(spaced, r"[^\p{L}\p{N} ]", ""), " +", " "))


def normalize_title(text: Column) -> Column:
    """The folded title, null if nothing is left."""
    return F.nullif(fold(text), F.lit(""))


def normalize_doi(text: Column) -> Column:
    """The DOI in a text without resolver, query, fragment and closing punctuation, lowered; null if there is none."""
    bare = F.trim(F.coalesce(F.try_url_decode(text), text))
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?i)^\s*doi\s*:\s*", ""), r"(?i)^https?://(dx\.)?doi\.org/", "")
    found = F.regexp_extract(bare, r"10\.\d{4,9}/[^?#\s]+", 0)
    return F.nullif(F.lower(F.regexp_replace(found, r"""["'.,;:，。；：)\]}>]+$""", "")), F.lit(""))


def paper_id(doi: Column, title: Column, year: Column, first_author: Column) -> Column:
    """P and 12 hexadecimal digits of what identifies a work: its DOI, else title, year and first author."""
    unknown = lambda c: F.coalesce(c, F.lit("unknown"))
    by_title = F.concat(F.lit("title:"), unknown(normalize_title(title)), F.lit("|year:"), unknown(year), F.lit("|author:"), unknown(normalize_title(first_author)))
    identity = F.coalesce(F.concat(F.lit("doi:"), normalize_doi(doi)), by_title)
    return F.concat(F.lit("P"), F.upper(F.substring(F.sha2(identity, 256), 1, 12)))


# Fixed value: names that a file must not have.
RESERVED = ("con", "prn", "aux", "nul", *(f"com{k}" for k in range(1, 10)), *(f"lpt{k}" for k in range(1, 10)))


def file_name(parts: list[Column], most: int = 180) -> Column:
    """Parts as one file name: forbidden characters to _, no dots or spaces at the ends, a reserved name with _ before it, `most` characters."""
    joined = F.concat_ws("_", *[F.nullif(F.trim(p), F.lit("")) for p in parts])
    clean = F.regexp_replace(F.substring(F.regexp_replace(F.regexp_replace(joined, r'[<>:"/\\|?*\x00-\x1f]', "_"), r"\s+", " "), 1, most), r"^[ .]+|[ .]+$", "")
    return F.when(F.lower(F.substring_index(clean, ".", 1)).isin(*RESERVED), F.concat(F.lit("_"), clean)).otherwise(F.when(clean == "", "unnamed").otherwise(clean))


def safe_name(text: Column, words: int = 10, most: int = 48) -> Column:
    """A title as a file name: forbidden characters to _, at most `words` words and `most` characters."""
    clean = F.regexp_replace(F.trim(text), r'[<>:"/\\|?*\x00-\x1f]', "_")
    short = F.concat_ws("_", F.slice(F.split(F.regexp_replace(clean, r"[\s_]+", " "), " "), 1, words))
    return F.regexp_replace(F.substring(F.regexp_replace(short, "_+", "_"), 1, most), r"^[ ._]+|[ ._]+$", "")


def stem(token: Column) -> Column:
    """The first rule that fits: ies to y; sses, ches, shes without es; ing and ers off; a plural s off."""
    n = F.length(token)
    cut = lambda k: F.substring(token, F.lit(1), n - k)
    long_ = n > 4
    return (
        F.when(long_ & token.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when(long_ & token.rlike("(sses|ches|shes)$"), cut(2))
        .when(long_ & token.rlike("(ing|ers)$"), cut(3))
        .when((n > 3) & token.endswith("s") & ~token.rlike("(ss|us|is)$"), cut(1))
        .otherwise(token)
    )


def latin_tokens(folded: Column) -> Column:
    """Words of Latin letters and digits but the stop words, each followed by its stem where that differs."""
    words = F.filter(F.regexp_extract_all(folded, F.lit(r"[0-9a-z]+"), F.lit(0)), lambda w: ~w.isin(*STOP_WORDS))
    return F.flatten(F.transform(words, lambda w: F.when(stem(w) == w, F.array(w)).otherwise(F.array(w, stem(w)))))


def cjk_tokens(folded: Column) -> Column:
    """Characters of each CJK run but the function characters, then its pairs of neighbours."""

    def of_run(run: Column) -> Column:
        n = F.length(run)
        single = F.filter(F.split(run, ""), lambda c: (c != "") & ~F.lit(CJK_STOP).contains(c))
        pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
        return F.concat(single, pairs)

    return F.flatten(F.transform(F.regexp_extract_all(folded, F.lit(f"[{CJK}]+"), F.lit(0)), of_run))


def tokens(text: Column) -> Column:
    """All tokens of a text in order: those of CJK runs, then those of Latin words."""
    folded = fold(text)
    return F.concat(cjk_tokens(folded), latin_tokens(folded))


def years(text: Column) -> Column:
    """Distinct years from 1900 to 2099 in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1)))


def topic_pairs(text: Column) -> Column:
    r"""Distinct domain\subtopic pairs of a ;-joined field, in order, as structs."""
    parts = F.filter(F.transform(F.split(text, ";"), lambda p: F.trim(p)), lambda p: p.contains("\\"))
    return F.array_distinct(F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, "\\", 1)).alias("domain"), F.trim(F.regexp_replace(p, r"^[^\\]*\\", "")).alias("subtopic"))))


def names(text: Column) -> Column:
    """Names in a query: each CJK word is one, words in other letters that follow each other are one."""
    parts = F.regexp_extract_all(F.regexp_replace(F.trim(text), r"\s+", " "), F.lit(rf"[^ {CJK}]*[{CJK}]+[^ ]*|[^ {CJK}]+(?: [^ {CJK}]+)*"), F.lit(0))
    return F.filter(F.transform(parts, fold), lambda p: p != "")


def squeeze(text: Column) -> Column:
    """White space to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def contains_word(text: Column, term: str) -> Column:
    """Whether a folded text has the folded term between characters that are neither letters nor digits; anywhere, if it has CJK characters."""
    return text.contains(term) if CJK_TERM.search(term) else F.concat(F.lit(" "), text, F.lit(" ")).contains(f" {term} ")


def sanitize_url(url: Column) -> Column:
    """Scheme, host, port and path of an http url; anything else is withheld."""
    part = lambda k: F.try_parse_url(url, F.lit(k))
    port = F.nullif(F.regexp_extract(part("AUTHORITY"), r":(\d+)$", 1), F.lit(""))
    clean = F.concat(part("PROTOCOL"), F.lit("://"), part("HOST"), F.coalesce(F.concat(F.lit(":"), port), F.lit("")), F.coalesce(part("PATH"), F.lit("")))
    return F.when(part("PROTOCOL").isin("http", "https"), F.coalesce(clean, F.lit("<REDACTED_URL>"))).otherwise("<REDACTED_URL>")


def keywords(text: Column) -> Column:
    """Keywords of a field, split at ; and the full-width comma and semicolon."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[;；，]"), lambda k: F.trim(k)), lambda k: k != "")


def label_key(text: Column) -> Column:
    """A label without any white space; apply nfkc() before where compatibility forms occur."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\x{3000}]+", "")


@F.arrow_udf(T.StringType())
def strip_accents(text: pa.Array) -> pa.Array:
    """A text in canonical decomposition without the marks that take no room."""
    return pc.replace_substring_regex(pc.utf8_normalize(text, form="NFD"), r"\p{Mn}+", "")


def topic_field(pairs: Column) -> Column:
    """The field of domain and subtopic pairs, as topic_pairs() reads it."""
    return F.array_join(F.transform(pairs, lambda p: F.concat(p["domain"], F.lit("\\"), p["subtopic"])), ";")


# Fixed value: spacing in titles with ideographs that means nothing.
IDEOGRAPH = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}"


def squeeze_title(text: Column) -> Column:
    """A title without the spaces that markup puts between ideographs, around enumeration commas and dashes, and, where it has ideographs,
    around - and +. Character references are decoded for the five of XML; apply nfkc() before where compatibility forms occur."""
    x = squeeze(F.coalesce(text, F.lit("")))
    for name, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(c))
    x = F.regexp_replace(x, rf"(?<=[{IDEOGRAPH}]) (?=[{IDEOGRAPH}])", "")
    x = F.regexp_replace(x, r" ?(、) ?", "$1")
    x = F.when(x.rlike(f"[{IDEOGRAPH}]"), F.regexp_replace(x, r" ?([-+]) ?", "$1")).otherwise(x)
    return F.regexp_replace(x, r" ?([—–]+) ?", "$1")


def spaced_dois(text: Column) -> Column:
    """Distinct DOIs of an extracted text, in which up to three spaces may stand beside their punctuation."""
    closed = F.regexp_replace(text, r"(?<=10\.\d{4,9}) {0,3}/ {0,3}", "/")
    # A space inside stands after punctuation and before a letter or digit, or before punctuation; no other DOI begins after it.
    broken = r"10\.\d{4,9}/(?:[^\s<>\"']|(?<=[._/-]) {1,3}(?=[0-9a-zA-Z])(?!10\.\d{4})| {1,3}(?=[._/-]))+"
    return F.array_distinct(F.transform(F.regexp_extract_all(closed, F.lit(broken), F.lit(0)), lambda x: normalize_doi(F.replace(x, F.lit(" "), F.lit("")))))


def controls(text: Column, as_of: int) -> Column:
    """struct(first, last, results, downloads, languages, titles, dois, reviewed) of a request in natural language.

    Years: a range, the last N years up to `as_of`, or after a year; counts are capped at 200 and 25; words against downloads make them 0. Titles
    are quoted runs of eight characters or more."""
    low = F.lower(text)
    group = lambda x, p, k: F.nullif(F.regexp_extract(x, p, k), F.lit("")).cast("int")
    span = r"(20\d{2})\s*(?:-|–|—|至|到)\s*(20\d{2})"
    recent = F.least(F.lit(25), F.greatest(F.lit(1), group(low, r"(?:近\s*|last\s+)(\d{1,2})\s*(?:年|years?)", 1)))
    recent = F.when(group(low, r"(?:近\s*|last\s+)(\d{1,2})\s*(?:年|years?)", 1).isNotNull(), recent)
    after = group(low, r"(20\d{2})\s*年?(?:以后|之后|以来|after)", 1)
    first = F.coalesce(group(text, span, 1), F.lit(as_of) - recent + 1, after)
    last = F.coalesce(group(text, span, 2), F.when(recent.isNotNull() | after.isNotNull(), as_of))
    results = F.least(F.lit(200), F.coalesce(group(text, r"最多(?:保留|候选|检索)?\s*(\d{1,3})\s*篇", 1), F.lit(30)))
    downloads = F.least(F.lit(25), F.coalesce(group(text, r"最多下载\s*(\d{1,2})\s*篇", 1), F.lit(5)))
    downloads = F.when(low.rlike("不要下载|先不下载|do not download|metadata only"), 0).otherwise(downloads)
    both = (text.contains("中文") | text.contains("中英文")) & (text.contains("英文") | text.contains("中英文"))
    languages = F.when(both, "zh,en").when(text.contains("只找中文"), "zh").when(text.contains("只找英文") | low.contains("english only"), "en").otherwise("zh,en")
    titles = F.filter(F.transform(F.regexp_extract_all(text, F.lit('["“](.+?)["”]'), F.lit(1)), lambda x: F.trim(x)), lambda x: F.length(x) >= 8)
    dois = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)10\.\d{4,9}/[^\s<>\"']+"), F.lit(0)), lambda x: F.regexp_replace(x, r"[.,;，。；)\]}]+$", ""))
    return F.struct(
        first.alias("first"), last.alias("last"), results.alias("results"), downloads.alias("downloads"), languages.alias("languages"), F.array_distinct(titles).alias("titles"), F.array_distinct(dois).alias("dois"), low.rlike("同行评议|peer[ -]reviewed").alias("reviewed"),
    )


def redact_keys(values: Column) -> Column:
    """A map of strings in which every value whose key names a secret is withheld, unless it is false or null; the others are sanitised."""
    secret = lambda k: F.lower(k).rlike(SECRET_NAMES)
    return F.transform_values(values, lambda k, v: F.when(secret(k) & v.isNotNull() & (F.lower(v) != "false"), F.lit("<REDACTED>")).otherwise(sanitize_text(v)))


def names_secret(values: Column) -> Column:
    """Whether a key of a map, at any depth of the names joined by dots, is one that no request may carry."""
    return F.exists(F.map_keys(values), lambda k: F.lower(k).rlike(SECRET_NAMES))


# Names whose value after : or = is a secret, and the three patterns of sanitize_text().
SECRET_NAMES = r"password|passwd|cookie|authorization|sessionid|token|secret|credential|signature|otp|mfa|saml(?:_?assertion)?|oauth(?:_?credential)?"


def sanitize_text(text: Column) -> Column:
    """A text with bearer tokens and named secrets withheld, and urls without user, query and fragment."""
    bearer = F.regexp_replace(text, r"(?i)\bauthorization\s*:\s*bearer\s+[^\s,;]+", "Authorization: <REDACTED>")
    named = F.regexp_replace(bearer, rf"(?i)\b({SECRET_NAMES})\b\s*[:=]\s*(?:bearer\s+)?([^\s,;&]+)", "$1=<REDACTED>")
    return F.regexp_replace(named, r"(?i)(https?://)(?:[^\s/@<>\"']*@)?([^\s?#<>\"']*)[^\s<>\"']*", "$1$2")

"""Text as columns: words, sentences, lenient casts, ids and page addresses. All JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks after which a sentence ends.
SENTENCE_ENDS = "。；！？?!\\n"
#: Han characters, and runs of other letters and digits.
_RUNS = r"[\p{IsHan}]+|[\p{L}\p{N}&&[^\p{IsHan}]]+"


def lenient_double(x: Column) -> Column:
    """A number, or null for anything that isn't one."""
    return F.trim(x.cast("string")).try_cast("double")


def lenient_int(x: Column, default: int | None = None) -> Column:
    n = F.trim(x.cast("string")).try_cast("int")
    return n if default is None else F.coalesce(n, F.lit(default))


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits. A run of Han characters gives its characters and its pairs of neighbours. A text without any is split in one step."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(_RUNS), F.lit(0))
    chars = lambda r: F.filter(F.split(r, ""), lambda c: c != "")
    pairs = lambda r: F.when(F.length(r) > 1, F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    mixed = F.flatten(F.transform(runs, lambda r: F.when(r.rlike(r"^\p{IsHan}"), F.concat(chars(r), pairs(r))).otherwise(F.array(r))))
    return F.when(text.rlike(r"\p{IsHan}"), mixed).otherwise(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def words_with_names(text: Column, names: list[str]) -> Column:
    """As words, but the given names (of 2 to 20 characters) stay whole where they stand in the text, longest first."""
    own = sorted({n.lower() for n in names if 2 <= len(n) <= 20}, key=lambda n: (-len(n), n))
    if not own:
        return words(text)
    pattern = "|".join("\\Q" + n + "\\E" for n in own)
    found = F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))
    return F.concat(found, words(F.regexp_replace(F.lower(text), pattern, " ")))


def sentences(text: Column) -> Column:
    """Trimmed sentences with their end marks; empty ones are left out."""
    return F.filter(F.transform(F.split(text, f"(?<=[{SENTENCE_ENDS}])"), strip), lambda s: s != "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def page_url(title: Column, base: str) -> Column:
    """base and the percent-encoded title. Spark encodes forms, so three characters differ from percent-encoding."""
    enc = F.replace(F.replace(F.replace(F.url_encode(title), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.concat(F.lit(base), enc)


def stable_id(*parts: Column) -> Column:
    """The MD5 of the parts, joined by bars."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def minutes_seconds(seconds: Column) -> Column:
    s = F.floor(seconds).cast("int")
    return F.format_string("%02d:%02d", F.floor(s / 60).cast("int"), F.pmod(s, F.lit(60)))


def named_in(name: Column, query: Column) -> Column:
    """Whether the query names `name` (2 characters or more). ASCII names must not go on in letters or digits."""
    quoted = F.concat(F.lit(r"(?<![0-9A-Za-z])\Q"), name, F.lit(r"\E(?![0-9A-Za-z])"))
    return (F.length(name) >= 2) & F.when(name.rlike(r"^[\x00-\x7F]+$"), F.rlike(query, quoted)).otherwise(F.contains(query, name))


def safe_name(text: Column) -> Column:
    return F.translate(text, "/:", "__")


def token_ids(text: Column, vocabulary: int = 50_000) -> Column:
    """A stable id from 10 up for each Han character, run of ASCII letters and digits, and other visible character."""
    found = F.regexp_extract_all(text, F.lit(r"[一-鿿]|[A-Za-z0-9]+|[^\s]"), F.lit(0))
    return F.transform(found, lambda t: (F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long"), F.lit(vocabulary - 10)) + 10).cast("int"))

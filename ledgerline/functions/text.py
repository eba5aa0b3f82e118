"""Scalar cleaning and keys of listing fields, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .schema import is_blank, let

WS = r"\t-\r\x1c-\x1f\x85\p{Z}"
WORDCHAR = r"\p{L}\p{N}_"

# Known provider spellings, words a sheet title adds to them, and providers that always send everything.
KNOWN_PROVIDERS = ["Business Cube", "GPE", "JLL / HK London", "Kitt's", "Knotel", "MetSpace", "UNION", "Workplace Plus"]
PURPOSE_SUFFIXES = ["availability", "availibility"]
SNAPSHOT_PROVIDERS = ["Copthall Estates"]
# Street suffixes and what they stand for.
STREET_SUFFIXES = {"st": "street", "rd": "road", "ave": "avenue", "av": "avenue", "sq": "square", "ln": "lane", "pl": "place", "ct": "court", "cres": "crescent", "gdns": "gardens", "ter": "terrace"}
# Wordings that a unit has gone.
LET_STATUS = ["let", "leased", "no longer available", "withdrawn", "under offer", "occupied"]
# Words without subject matter.
STOPWORDS = ["a", "an", "the", "and", "or", "of", "with", "from", "for", "to", "in", "on", "at", "by", "is", "are", "this", "that", "has", "have"]
#: Inclusive box around London: south, north, west, east.
LONDON_BOX = (51.28, 51.70, -0.51, 0.34)


def normalize_key(c: Column) -> Column:
    """Lower case without punctuation, white space collapsed; null gives the empty key."""
    text = F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), f"[^{WORDCHAR}{WS}]", "")
    return F.trim(F.regexp_replace(text, f"[{WS}]+", " "))


def postcode_key(c: Column) -> Column:
    return F.replace(normalize_key(c), F.lit(" "), F.lit(""))


def tolerant_text(c: Column) -> Column:
    """Lower case without white space; punctuation counts."""
    return F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), f"[{WS}]+", "")


def values_equal(old: Column, new: Column, kind: str = "str") -> Column:
    """Equal within 1e-6 for numbers, by tolerant_text otherwise. Both must be non-blank."""
    return (F.abs(old - new) < 1e-6) if kind != "str" else (tolerant_text(old) == tolerant_text(new))


def provider_key(c: Column) -> Column:
    """Key under which + and & read as words and spacing does not count."""
    text = F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("+"), F.lit(" plus ")), F.lit("&"), F.lit(" and "))
    return postcode_key(text)


def strip_purpose(c: Column, suffixes: list[str] = PURPOSE_SUFFIXES) -> Column:
    """Without a last word that names a sheet's purpose, unless that is all there is."""
    words = F.filter(F.split(c, f"[{WS}]+"), lambda w: w != "")
    strip = (F.size(words) > 1) & F.lower(F.element_at(words, -1)).isin(suffixes)
    return F.when(strip, F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " ")).otherwise(c)


def canonical_provider(c: Column, known: list[str] = KNOWN_PROVIDERS) -> Column:
    """The known spelling of a provider, or the value itself."""
    pairs = [x for p in known for x in (_plain_key(p), p)]
    return F.when(is_blank(c), c).otherwise(F.coalesce(F.create_map(*map(F.lit, pairs))[provider_key(c)], c))


def _plain_key(name: str) -> str:
    return "".join(ch for ch in name.lower().replace("+", " plus ").replace("&", " and ") if ch.isalnum() or ch == "_")


def clean_provider(c: Column) -> Column:
    return canonical_provider(strip_purpose(c))


def house_number(c: Column) -> Column:
    """Leading number of an address, such as 14a-18, in lower case; null if there is none."""
    found = F.regexp_extract(c, f"^[{WS}]*(\\d+[A-Za-z]?(?:-\\d+[A-Za-z]?)?)(?![{WORDCHAR}])", 1)
    return F.nullif(F.lower(found), F.lit(""))


def house_number_changed(old: Column, new: Column) -> Column:
    return ~house_number(old).eqNullSafe(house_number(new))


def street_key(c: Column) -> Column:
    """Key without the house number and with the last word's abbreviation written out."""
    rest = F.regexp_replace(F.coalesce(c, F.lit("")), f"^[{WS}]*\\d+[A-Za-z]?(?:-\\d+[A-Za-z]?)?(?![{WORDCHAR}])", "")
    words = F.split(normalize_key(rest), " ")
    last = F.element_at(words, -1)
    full = F.coalesce(F.create_map(*[F.lit(x) for kv in STREET_SUFFIXES.items() for x in kv])[last], last)
    return F.array_join(F.concat(F.slice(words, F.lit(1), F.size(words) - 1), F.array(full)), " ")


def name_part(c: Column) -> Column:
    """Text before the first comma and space."""
    return F.substring_index(c, ", ", 1)


def digit_free(c: Column) -> Column:
    return ~is_blank(c) & ~c.rlike(r"\p{Nd}")


def compound_split(c: Column) -> Column:
    """struct(name, address) of `Name, 12 Street` or `Name - 12 Street`; null if the value is neither."""
    out = F.lit(None).cast("struct<name:string,address:string>")
    for sep in (" - ", ", "):
        at = F.instr(c, sep)
        name, address = F.trim(F.substring(c, F.lit(1), at - 1)), F.trim(F.substring(c, at + len(sep), F.length(c)))
        ok = (at > 0) & (name != "") & ~name.rlike(r"\d") & address.rlike(r"\d")
        out = F.when(ok, F.struct(name.alias("name"), address.alias("address"))).otherwise(out)
    return out


def mentions_let_status(c: Column) -> Column:
    """Whether a text says that a unit has gone; pre-let, re-let and sub-let do not."""
    words = "|".join(w.replace(" ", r"\ ") for w in LET_STATUS if w != "let")
    edge = rf"(?<![{WORDCHAR}])"
    return F.coalesce(F.lower(c).rlike(rf"{edge}(?:(?<!pre-)(?<!re-)(?<!sub-)let|{words})(?![{WORDCHAR}])"), F.lit(False))


def row_label(building: Column, provider: Column, floor: Column) -> Column:
    return F.concat_ws(" — ", *[F.when(~is_blank(c), c) for c in (building, provider, floor)])


def significant_words(c: Column) -> Column:
    """Distinct ASCII words of three letters or more that are no stopwords."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+)"), 1)
    return F.array_except(F.array_distinct(F.filter(words, lambda w: F.length(w) > 2)), F.array(*map(F.lit, STOPWORDS)))


def detail_items(c: Column) -> Column:
    """Items of a list in text: lower case, split at semicolons and line ends, three characters or more."""
    items = F.transform(F.split(F.lower(F.coalesce(c, F.lit(""))), "[;\n]+"), lambda x: F.trim(x))
    return F.filter(items, lambda x: F.length(x) >= 3)


def words_similar(x: Column, y: Column, threshold: float = 0.5) -> Column:
    """Whether one of two sets of words holds enough of the other."""
    return (F.size(x) > 0) & (F.size(y) > 0) & (F.size(F.array_intersect(x, y)) / F.least(F.size(x), F.size(y)) >= threshold)


def items_similar(a: Column, b: Column, threshold: float = 0.5) -> Column:
    return words_similar(significant_words(a), significant_words(b), threshold)


def detail_loss(old: Column, new: Column) -> Column:
    """Whether some old item has no like among the new ones."""
    words = lambda c: F.transform(detail_items(c), significant_words)
    return let(F.struct(words(old).alias("old"), words(new).alias("new")), lambda w: F.exists(w["old"], lambda x: ~F.exists(w["new"], lambda y: words_similar(x, y))))


def richness_regression(old: Column, new: Column, ratio: float = 0.5) -> Column:
    """Whether the new text has fewer than half the old one's words."""
    count = lambda c: F.size(F.filter(F.split(F.coalesce(c, F.lit("")), f"[{WS}]+"), lambda w: w != ""))
    return (count(old) > 0) & (count(new) / count(old) < ratio)


def coerce_number(c: Column, kind: str) -> Column:
    """A number from text with thousands separators; junk, NaN and infinities give null; int rounds half to even."""
    text = F.trim(F.replace(c.cast("string"), F.lit(","), F.lit("")))
    value = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))
    value = F.when(F.abs(value) != float("inf"), value + 0.0)  # no negative zero
    return F.bround(value, 0).cast("long") if kind == "int" else value


def derive_rent(size: Column, pcm: Column, psf: Column) -> tuple[Column, Column]:
    """(pcm, psf) with the one missing computed from the size; zero counts as missing."""
    money = lambda x: F.floor(x * 100 + 0.5).cast("double") / 100
    some = lambda x: F.coalesce(x != 0, F.lit(False))
    new_pcm = F.when(some(size) & ~some(pcm) & some(psf), money(size * psf / 12)).otherwise(pcm)
    new_psf = F.when(some(size) & some(pcm) & ~some(psf), money(pcm * 12 / size)).otherwise(psf)
    return new_pcm, new_psf


def in_london(lat: Column, lng: Column) -> Column:
    s, n, w, e = LONDON_BOX
    return F.coalesce(lat.between(s, n) & lng.between(w, e), F.lit(False))


def london_time(c: Column) -> Column:
    """A UTC stamp (yyyy-MM-dd_HH-mm-ss-SSS or ISO 8601) as London time with its zone; what cannot be read passes through."""
    file_stamp = F.try_to_timestamp(c, F.lit("yyyy-MM-dd_HH-mm-ss-SSS"))
    utc = F.coalesce(file_stamp, F.when(c.rlike(r"^\d{4}-\d\d-\d\d"), c.try_cast("timestamp")))
    local = F.from_utc_timestamp(F.to_utc_timestamp(utc, F.current_timezone()), "Europe/London")
    zone = F.when(local == F.to_utc_timestamp(utc, F.current_timezone()), "GMT").otherwise("BST")
    return F.coalesce(F.concat(F.date_format(local, "yyyy-MM-dd HH:mm "), zone), c)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))

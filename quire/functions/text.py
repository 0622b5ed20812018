"""Names, numbers, keys and paths as column expressions. Patterns run with Java's (?U), so digits and blanks of any script count."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import constants as K


def natural_key(name: Column, letters_first: bool = True) -> Column:
    """Sort key of digit and letter runs (SO1): runs of digits compare as numbers of any length, of letters caselessly.

    letters_first=False keeps an empty lead run, so names that begin with digits come first (SO2).
    """
    runs = F.regexp_extract_all(F.lower(name), F.lit(r"(?U)(\d+|\D+)"), F.lit(1))
    digit = lambda p: p.rlike(r"(?U)^\d")
    bare = lambda p: F.regexp_replace(half_width(p), "^0+(?=.)", "")

    def part(p: Column) -> Column:
        is_digit = digit(p)
        return F.struct(is_digit.cast("int").alias("kind"), F.when(is_digit, F.length(bare(p))).otherwise(0).alias("size"), F.when(is_digit, bare(p)).otherwise(p).alias("text"))

    key = F.transform(runs, part)
    if letters_first:
        return key
    lead = F.array(F.struct(F.lit(0).alias("kind"), F.lit(0).alias("size"), F.lit("").alias("text")))
    return F.when(F.get(key, F.lit(0))["kind"] == 1, F.concat(lead, key)).otherwise(key)


def digit_run_key(name: Column) -> Column:
    """Sort key that compares digit runs by length, then digits, leading zeros aside (SO3)."""
    runs = F.regexp_extract_all(F.upper(name), F.lit(r"(\d+|\D+)"), F.lit(1))
    bare = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    return F.transform(runs, lambda p: F.when(p.rlike(r"^\d"), F.struct(F.length(bare(p)).alias("size"), bare(p).alias("text"), F.length(p).alias("tie"))).otherwise(F.struct(F.lit(1 << 30).alias("size"), p.alias("text"), F.lit(0).alias("tie"))))


def title_key(value: Column) -> Column:
    """Titles compare with underscores as blanks, blanks collapsed and case ignored (ST32)."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(value, "_", " "), r"(?U)\s+", " ")))


def letters_key(value: Column) -> Column:
    """Lower case without blanks and punctuation (ST48)."""
    return F.lower(F.regexp_replace(value, r"(?U)[\s\W_]+", ""))


def half_width(value: Column) -> Column:
    return F.translate(value, K.FULL_WIDTH, K.HALF_WIDTH)


def canonical_number(value: Column) -> Column:
    """A volume number without leading zeros, and without a fraction that is zero (ST15)."""
    v = half_width(value)
    whole = F.regexp_replace(F.substring_index(v, ".", 1), "^0+(?=.)", "")
    fraction = F.when(F.contains(v, F.lit(".")), F.regexp_replace(F.regexp_replace(v, r"^[^.]*\.", ""), "0+$", "")).otherwise("")
    return F.when(fraction == "", whole).otherwise(F.concat_ws(".", whole, fraction))


def padded_number(canonical: Column) -> Column:
    """The whole part with three digits at least, the fraction kept (ST15)."""
    whole = F.substring_index(canonical, ".", 1)
    wide = F.when(F.length(whole) < 3, F.lpad(whole, 3, "0")).otherwise(whole)
    return F.when(F.contains(canonical, F.lit(".")), F.concat(wide, F.regexp_replace(canonical, r"^[^.]*", ""))).otherwise(wide)


def first_number(value: Column, patterns: tuple[str, ...], guard: str | None = None) -> Column:
    """Group 1 of the first pattern that matches, skipping one whose first match is followed by `guard` (ST10, ST13)."""

    def one(pattern: str) -> Column:
        whole = F.regexp_extract(value, f"(?Uis)^(.*?)(?:{pattern})(.*)$", 0) if pattern[0] != "^" and not pattern.endswith("$") else F.lit("x")
        found = F.regexp_extract(value, f"(?Ui){pattern}", 1)
        usable = (found != "") & (whole != "")
        if guard:
            rest = F.regexp_replace(value, f"(?Uis)^.*?(?:{pattern})", "") if pattern[0] != "^" else F.regexp_replace(value, f"(?Uis){pattern}", "")
            usable = usable & ~rest.rlike(f"(?U){guard}")
        return F.when(usable, found)

    return canonical_number(F.coalesce(*[one(p) for p in patterns]))


def special_volume(name: Column) -> Column:
    return first_number(name, K.VOLUMES, K.ANNIVERSARY)


def inferred_volume(name: Column) -> Column:
    return first_number(half_width(name), K.INFERRED_VOLUMES, K.ANNIVERSARY)


def special_label(name: Column) -> Column:
    """The first special label that the name contains (ST9)."""
    words = F.array(*[F.lit(k) for k in K.SPECIALS])
    return F.get(F.filter(words, lambda k: F.contains(F.lower(name), F.lower(k))), F.lit(0))


def clean_name(raw: Column) -> Column:
    """A raw name without .kepub, leading [..] groups and a lead before (..) (ST6)."""
    steps = (r"(?i)\.kepub$", r"^(?:\[[^\]]+\])+", r"^[^\[\]]+?\([^)]*\)")
    return reduce(lambda c, p: F.trim(F.regexp_replace(c, p, "")), steps, raw)


def series_name(path: Column) -> Column:
    """The directory that holds the file, else the last bracket with a Han character, else the clean name (ST7)."""
    parts = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda p: p != "")
    parent = F.trim(F.get(parts, F.size(parts) - 2))
    base = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    brackets = F.regexp_extract_all(base, F.lit(r"\[([^\]]*[一-鿿]+[^\]]*)\]"), F.lit(1))
    own = F.when((F.size(parts) >= 2) & (parent != "") & ~parent.isin(".", ".."), parent)
    return F.coalesce(own, F.trim(F.get(brackets, F.size(brackets) - 1)), clean_name(base))


def without_regional_edition(name: Column) -> Column:
    """The name without a trailing regional edition, unless nothing would be left (ST8)."""
    short = F.trim(F.regexp_replace(name, f"(?Ui){K.REGIONAL_EDITION}", ""))
    return F.when(short != "", short).otherwise(F.trim(name))


def archive_name(path: Column, series: Column | None = None, periodical: bool = False) -> Column:
    """The archive's name for a book file (ST11), by the first rule that fits; `periodical` adds the issue rules."""
    parts = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda p: p != "")
    raw = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    cleaned = clean_name(raw)
    named = F.coalesce(F.nullif(F.trim(series), F.lit("")) if series is not None else F.lit(None).cast("string"), F.nullif(series_name(path), F.lit("")), F.nullif(cleaned, F.lit("")), F.lit("Unknown"))
    head = F.concat(without_regional_edition(named), F.lit(" - "))
    part = lambda p, g: F.regexp_extract(cleaned, f"(?Ui){p}", g)
    rules = []
    if periodical:
        td, ym, slot, several = r"^([TD])\s*(\d{1,3})(.*)$", r"(20\d{2})年(\d{1,2})月", r"(\d{1,3})\s*([一二三四五六七八九十]{1,3})月\s*(上|下|特刊)", r"第\s*(\d+)[,、~-](\d+)\s*期"
        month = F.coalesce(F.array_position(F.array(*[F.lit(m) for m in K.CHINESE_MONTHS]), part(slot, 2)).cast("string"), F.lit("0"))
        rules = [
            (td, F.concat(F.upper(part(td, 1)), F.lpad(part(td, 2).cast("int").cast("string"), 2, "0"), F.trim(part(td, 3)))),
            (ym, F.concat(part(ym, 1), F.lit("-"), F.lpad(part(ym, 2).cast("int").cast("string"), 2, "0"))),
            (slot, F.concat(F.lit("第"), padded_number(canonical_number(part(slot, 1))), F.lit("期 "), month, F.lit("月"), part(slot, 3))),
            (several, F.concat(F.lit("第"), padded_number(canonical_number(part(several, 1))), F.lit("-"), padded_number(canonical_number(part(several, 2))), F.lit("期"))),
        ]
    label, special, volume = special_label(cleaned), special_volume(cleaned), first_number(cleaned, K.VOLUMES)
    name = F.when(label.isNotNull() & special.isNotNull(), F.concat(label, F.lit(" 第"), padded_number(special), F.lit("册")))
    name = name.when(label.isNotNull(), cleaned).when(volume.isNotNull(), F.concat(F.lit("第"), padded_number(volume), F.lit("期" if periodical else "卷"))).otherwise(cleaned)
    for pattern, value in reversed(rules):
        name = F.when(cleaned.rlike(f"(?Ui){pattern}"), value).otherwise(name)
    return F.concat(head, name, F.lit(".cbz"))


def percent_decoded(value: Column) -> Column:
    """Percent-decoding that leaves + and malformed escapes alone."""
    safe = F.regexp_replace(F.regexp_replace(value, r"\+", "%2B"), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(safe), value)


def normal_path(path: Column) -> Column:
    """Percent-decoded, slashes forward, then the fragment and . segments gone, .. resolved; nothing left is "." (ST1)."""
    plain = F.regexp_replace(F.translate(percent_decoded(path), "\\", "/"), "(?s)#.*$", "")
    rooted = plain.startswith("/")
    kept = F.filter(F.split(plain, "/"), lambda p: (p != "") & (p != "."))
    none = F.array().cast("array<string>")

    def fold(acc: Column, p: Column) -> Column:
        inner = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != "..")
        up = F.when(inner, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(rooted, acc).otherwise(F.concat(acc, F.array(p)))
        return F.when(p == "..", up).otherwise(F.concat(acc, F.array(p)))

    out = F.concat(F.when(rooted, "/").otherwise(""), F.array_join(F.aggregate(kept, none, fold), "/"))
    return F.when(out == "", ".").otherwise(out)


def resolved_path(base: Column, relative: Column) -> Column:
    """A relative reference below the folder of `base` (ST2)."""
    folder = F.nullif(F.regexp_replace(base, "/?[^/]*$", ""), F.lit(""))
    return normal_path(F.concat_ws("/", folder, relative))


def wiki_title(url: Column) -> Column:
    """The title in a wiki address: ?title=, /wiki/ or a language variant's path (ST12)."""
    asked = F.regexp_extract(url, r"[?&]title=([^&#]+)", 1)
    path = F.regexp_extract(url, r"^[a-z]+://[^/]+/(?:wiki|zh(?:-[a-z]+)*)/([^?#]+)", 1)
    return F.translate(percent_decoded(F.when(asked != "", asked).when(path != "", path)), "_", " ")


def year(value: Column) -> Column:
    """The first year of 19.. or 20.. (SR2)."""
    return F.try_to_number(F.nullif(F.regexp_extract(value, r"((?:19|20)\d{2})", 1), F.lit("")), F.lit("9999")).cast("int")


def chinese_month(value: Column) -> Column:
    """1 to 12 for a month's Chinese numeral (SR1)."""
    return F.nullif(F.array_position(F.array(*[F.lit(m) for m in K.CHINESE_MONTHS]), value).cast("int"), F.lit(0))


def first_count(value: Column) -> Column:
    """The first digits, full width folded (ST29)."""
    return F.nullif(F.regexp_extract(half_width(value), r"(\d+)", 1), F.lit("")).try_cast("bigint")


def genres(values: Column) -> Column:
    """The vocabulary's genres of the values, value by value and each once; maintenance categories are passed over (ST43)."""
    table = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(f"(?i){p}").alias("pattern")) for n, p in K.GENRES])
    named = lambda v: F.transform(F.filter(table, lambda g: F.rlike(v, g["pattern"])), lambda g: g["name"])
    return F.array_distinct(F.flatten(F.transform(content_categories(values), named)))


def content_categories(values: Column) -> Column:
    """Categories that say something and don't maintain the encyclopedia (FI15)."""
    return F.filter(values, lambda v: (F.trim(v) != "") & ~F.trim(v).rlike("(?i)" + "|".join(K.MAINTENANCE_CATEGORIES)))


def required(value: Column, name: Column) -> Column:
    """The value, or an error that names what it was to be read from: for numbers that a run can't do without (ST14)."""
    return F.when(value.isNotNull(), value).otherwise(F.raise_error(F.concat(F.lit("no volume number in "), F.coalesce(name, F.lit("null")))))


def ordered_distinct(values: Column) -> Column:
    """Values in order, the first of those that are equal but for case (WI2, WI3)."""
    keys = F.transform(values, F.lower)
    return F.filter(values, lambda v, i: F.array_position(keys, F.lower(v)) == i + 1)


def display_publisher(value: Column) -> Column:
    """A publisher without the regions named before it, the last of a succession (ST41)."""
    regions = "|".join(K.REGIONS)
    bare = F.trim(F.regexp_replace(value, rf"(?iU)^\s*(?:(?:{regions})\s*[：:]\s*)+", ""))
    return F.nullif(F.trim(F.element_at(F.split(bare, rf"(?U)\s*(?:{K.SUCCESSION}|-+>)\s*"), -1)), F.lit(""))


def preferred_publisher(taiwan: Column, hongkong: Column) -> Column:
    """Taiwan's first, else Hong Kong's; Japanese publishers are never shown (ST42)."""
    return display_publisher(F.coalesce(F.get(taiwan, F.lit(0)), F.get(hongkong, F.lit(0))))


def safe_file_name(title: Column, most: int = 80) -> Column:
    return F.left(F.trim(F.regexp_replace(title, r'[\\/:*?"<>|\s]+', "_")), F.lit(most))


def snippet(value: Column, most: int = 120) -> Column:
    """Plain text of a search hit: tags gone, common entities decoded, blanks collapsed, cut (ST49, SO10)."""
    plain = F.regexp_replace(value, "<[^>]*>", "")
    for entity, char in (("&quot;", '"'), ("&#039;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return F.substring(F.trim(F.regexp_replace(plain, r"(?U)\s+", " ")), 1, most)

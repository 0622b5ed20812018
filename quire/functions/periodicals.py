"""Archive names of periodical PDF files as column expressions: issues, ranges, specials and repeated series titles (ST16-ST20)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import half_width, without_regional_edition

# The largest issue number, labels and words of specials in order of precedence, suffixes of main issues, trimmed marks.
MOST_ISSUE = 1500
SPECIAL_LABELS = ("副刊", "增刊", "特刊", "别册", "別冊")
SPECIAL_WORDS = (
    *SPECIAL_LABELS, "试刊", "試刊", "图文攻略", "圖文攻略", "攻略", "攻略本", "完全攻略", "攻略专辑", "攻略專輯", "典藏", "珍藏", "纪念", "紀念", "周年", "週年",
    "专门志", "专门誌", "專門志", "專門誌", "之书", "之書", "档案", "檔案", "大全", "特辑", "特輯", "专辑", "專輯",
)
MAIN_SUFFIXES = ("补完", "補完")
MARKS = r" .·・\-_()\[\]【】"
# Patterns, in Java syntax; the first group is the issue, the last one the rest.
SCAN_SIZES = r"\s+\d+x\d+(?:\.\d+)?\+\d+x\d+(?:\.\d+)?=\d+(?:\.\d+)?"
EMBEDDED = r"(?<![A-Za-z0-9])vol(?:ume)?\.?\s*0*(\d{1,4})(?!\d)(.*)$"
YEARLY = r"^[\s._·・-]*\d{2,4}\s*年\s*第\s*0*\d{1,2}\s*期[\s._·・-]*总\s*第\s*0*(\d{1,4})\s*期(.*)$"
NUMBERED = r"^第\s*0*(\d{1,4})\s*期(.*)$"
FOUNDING = r"^创刊号(.*)$"
RELEASE_GROUP = r"[\s_.-]*(?:full[\s_.-]*)?CRAZ\s*$"
DATED = r"^(\d{3,4}(?:\s*[~～\-–—]\s*\d{3,4})?)\s+\(?(?:19|20)\d{2}\.(?:(?:1[0-2]|0?[1-9])[A-Z]*)+\)?(.*)$"
LED_BY_NUMBER = r"^(?:(?:vol(?:ume)?\.?|v)\s*)?0*(\d{1,4})(?!\d)"
PERIODICAL = r"^(?:(?:vol(?:ume)?\.?|v)\s*)?0*(\d{1,4})(?!\d)(?:\s*[~～\-–—]\s*(?:vol(?:ume)?\.?|v)?\s*0*(\d{1,4})(?!\d))?(.*)$"
OUTPUT = r"^(.+?)\s+(v|SP)(\d+)(?:-(\d+))?(?:\s+(.+))?\.cbz$"


def _group(value: Column, pattern: str, n: int) -> Column:
    return F.regexp_extract(value, f"(?iU){pattern}", n)


def _fits(value: Column, pattern: str) -> Column:
    return value.rlike(f"(?iU){pattern}")


def _issue(value: Column, pattern: str, n: int = 1) -> Column:
    """The number in a group, null where there is none."""
    return half_width(_group(value, pattern, n)).try_cast("int")


def _three(number: Column) -> Column:
    return F.format_string("%03d", number)


def _trimmed(value: Column) -> Column:
    return F.regexp_replace(value, f"^[{MARKS}]+|[{MARKS}]+$", "")


def clean_title(name: Column) -> Column:
    """A file's title without scan sizes, blanks collapsed (ST16)."""
    return F.trim(F.regexp_replace(F.regexp_replace(name, f"(?U){SCAN_SIZES}", ""), r"(?U)\s+", " "))


def without_series(stem: Column, series: Column) -> Column:
    """The title without a leading series name, bare or in one of three kinds of brackets (ST18)."""
    out = stem
    for a, b in reversed((("", ""), ("《", "》"), ("【", "】"), ("[", "]"))):
        prefix = F.concat(F.lit(a), series, F.lit(b))
        rest = F.regexp_replace(F.substring(stem, F.length(prefix) + 1, F.length(stem)), r"^[ \-_]+", "")
        out = F.when(F.startswith(F.lower(stem), F.lower(prefix)), rest).otherwise(out)
    return out


def tidy_suffix(suffix: Column, *labels: Column | str) -> Column:
    """What follows an issue number, without labels, counters and marks around it (ST19)."""
    for label in labels:
        label = F.lit(label) if isinstance(label, str) else label
        suffix = F.replace(suffix, label, F.lit(""))
    suffix = F.regexp_replace(F.regexp_replace(suffix, "_+", " "), r"(?U)^\s*(?:辑|輯|期|册|冊)\s*", "")
    return _trimmed(F.regexp_replace(suffix, r"(?U)\s+", " "))


def without_subseries(name: Column, series: Column) -> Column:
    """The name from its embedded volume on, if the title before it is told by the series already (ST20)."""
    at = F.regexp_instr(name, F.lit(f"(?iU){EMBEDDED}"))
    letters = lambda c: F.lower(F.regexp_replace(c, r"(?U)[^\w]+", ""))
    title = letters(_trimmed(F.substring(name, F.lit(1), at - 1)))
    return F.when((at > 1) & (F.length(title) >= 3) & F.contains(letters(series), title), F.substring(name, at, F.length(name))).otherwise(name)


def _special(name: Column) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in SPECIAL_WORDS]), lambda w: F.contains(name, w))


def archive_names(df: DataFrame, path: str = "path", out: str = "archive") -> DataFrame:
    """Adds the archive's name for a PDF file in its series' folder (ST17): v for issues and ranges, SP for specials, else its own title.

    Each step is a projection of its own, as its column is used several times by the next one.
    """
    name, series, volume = F.col("__name"), F.col("__series"), F.col("__volume")
    parts = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda p: p != "")
    rows = df.withColumn("__parts", parts)
    rows = rows.withColumns({"__stem": clean_title(F.regexp_replace(F.element_at("__parts", -1), r"\.[^.]*$", "")), "__parent": F.trim(F.get("__parts", F.size("__parts") - 2))})
    rows = rows.withColumn("__series", without_regional_edition(F.col("__parent")))
    rows = rows.withColumn("__name", without_series(F.col("__stem"), series))
    rows = rows.withColumn("__name", without_subseries(name, series))
    rows = rows.withColumn("__volume", _issue(name, EMBEDDED))
    embedded = F.coalesce(volume <= MOST_ISSUE, F.lit(False))
    rows = rows.withColumn("__embedded", F.when(_special(name) & embedded, F.concat(series, F.lit(" SP"), _three(volume), F.lit(" "), tidy_suffix(name), F.lit(".cbz"))))
    rows = rows.withColumn("__name", F.regexp_replace(F.when(embedded, F.concat(_three(volume), _group(name, EMBEDDED, 2))).otherwise(name), f"(?iU){RELEASE_GROUP}", ""))
    led = F.when(_fits(name, FOUNDING), F.concat(F.lit("001"), _group(name, FOUNDING, 1))).otherwise(name)
    for pattern in (NUMBERED, YEARLY):
        led = F.when(_fits(name, pattern), F.concat(_three(_issue(name, pattern)), _group(name, pattern, 2))).otherwise(led)
    rows = rows.withColumn("__name", led)
    rows = rows.withColumn("__name", F.when(_fits(name, DATED), F.concat(_group(name, DATED, 1), _group(name, DATED, 2))).otherwise(name))
    rows = rows.withColumns(
        {
            "__special": _special(name),
            "__indexed": F.coalesce(_issue(name, LED_BY_NUMBER) <= MOST_ISSUE, F.lit(False)),
            "__first": _issue(name, PERIODICAL),
            "__last": _issue(name, PERIODICAL, 2),
            "__rest": _group(name, PERIODICAL, 3),
        }
    )
    first, last, rest, special = (F.col(f"__{c}") for c in ("first", "last", "rest", "special"))
    labels = F.filter(F.array(*[F.lit(x) for x in SPECIAL_LABELS]), lambda x: F.contains(rest, x))
    rows = rows.withColumns({"__label": F.coalesce(F.get(labels, F.lit(0)), F.lit("")), "__several": tidy_suffix(rest, "合刊"), "__plain": tidy_suffix(rest)})
    label, plain = F.col("__label"), F.col("__plain")
    rows = rows.withColumn("__labelled", F.when(label != "", tidy_suffix(rest, label)).otherwise(plain))
    blank = lambda c: F.when(c != "", F.concat(F.lit(" "), c)).otherwise("")
    within = F.coalesce((first <= MOST_ISSUE) & (last.isNull() | (last <= MOST_ISSUE)), F.lit(False))
    own = F.concat("__stem", F.lit(".cbz"))
    value = (
        F.when(F.col("__parent").isNull() | (F.col("__parent") == ""), own)
        .when(F.col("__embedded").isNotNull(), F.col("__embedded"))
        .when(special & ~F.col("__indexed"), F.concat(series, F.lit(" SP000 "), tidy_suffix(name), F.lit(".cbz")))
        .when(~within, own)
        .when(last.isNotNull(), F.concat(series, F.lit(" v"), _three(first), F.lit("-"), _three(last), F.lit(" 合刊"), blank(F.col("__several")), F.lit(".cbz")))
        .when((label != "") | special, F.concat(series, F.lit(" SP"), _three(first), blank(label), blank(F.col("__labelled")), F.lit(".cbz")))
        .otherwise(F.concat(series, F.lit(" v"), _three(first), blank(F.when(plain.isin(*MAIN_SUFFIXES), "").otherwise(plain)), F.lit(".cbz")))
    )
    return rows.withColumn("__out", value).select(*[F.col(f"`{c}`") for c in df.columns if c != out], F.col("__out").alias(out))


def record_of(path: Column, archive: Column) -> dict[str, Column]:
    """Record fields that a periodical's file and archive name give (SR12); numbers stay in the name."""
    parts = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda p: p != "")
    series = F.nullif(F.trim(F.get(parts, F.size(parts) - 2)), F.lit(""))
    source = F.trim(F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", ""))
    fits, special = _fits(archive, OUTPUT), F.lower(_group(archive, OUTPUT, 2)) == "sp"
    first, last, label = _issue(archive, OUTPUT, 3), _issue(archive, OUTPUT, 4), F.trim(_group(archive, OUTPUT, 5))
    unnumbered = special & (first == 0)
    number = F.when(last.isNotNull(), F.concat(F.lit("第"), _three(first), F.lit("-"), _three(last), F.lit("期"))).otherwise(F.concat(F.lit("第"), _three(first), F.lit("期")))
    title = F.when(unnumbered & (label != ""), label).when(label != "", F.concat(number, F.lit(" "), label)).otherwise(number)
    return {
        "title": F.when(fits, title).otherwise(source),
        "series": series,
        "localized_series": series,
        "series_sort": series,
        "format": F.when(fits & special, "Special").otherwise("Magazine"),
        "tags": F.when(fits & (label != ""), F.array(label)).otherwise(F.array().cast("array<string>")),
    }

"""Markup parsers: HTML images, OPF packages and wikitext. What isn't regular is parsed in Arrow UDFs; what follows is columns."""

from __future__ import annotations

import posixpath
import re
import unicodedata
import xml.etree.ElementTree as ET
from html.parser import HTMLParser
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quire.functions import constants as K

# Image attributes in order of preference, infobox names, equivalent field names, list delimiters.
IMAGE_ATTRIBUTES = ("src", "data-src", "data-original", "data-lazy-src", "data-original-src", "data-url", "href", "xlink:href")
HEADER_BOX, WORK_BOX = "infobox animanga/headerofja", "infobox animanga/manga"
START_FIELDS = ("開始", "开始", "開始日", "开始日", "發售日", "发售日")
END_FIELDS = ("結束", "结束", "結束日", "结束日")
PUBLISHER_FIELDS = ("出版社", "其他出版社", "其他出版商")
EDITION_LABELS = {"愛藏版": ("文庫版", "文库版"), "爱藏版": ("文庫版", "文库版"), "文庫版": ("文庫版", "文库版"), "文库版": ("文庫版", "文库版")}
COUNTRY_WORDS = {
    "japan": ("flagicon|japan", "flagicon|jpn", "flagicon|日本", "日本"),
    "taiwan": ("flagicon|taiwan", "flagicon|twn", "flagicon|roc", "flagicon|臺灣", "flagicon|台湾", "臺灣", "台湾", "台灣"),
    "hongkong": ("flagicon|hong kong", "flagicon|hkg", "flagicon|香港", "香港"),
}
LIST_DELIMITERS = r"<br\s*/?>|[、，,;；]"
ROLES = ("作者", "原作", "作畫", "作画", "漫畫", "漫画", "角色原案", "人物原案")
SILENT_TEMPLATES = ("flagicon", "flag", "ja", "zh")
STOP_WORDS = ("漫畫", "漫画", "外傳", "外传", "番外", "篇", "卷", "冊", "册")
SIDE_STORIES = ("外傳", "番外")
CLAUSE_DELIMITERS = ",，;；/／、"


def _lazy(kind: str):
    """An Arrow UDF that is made when it is called, as its type needs a session."""

    def wrap(f):
        return lambda *columns: pandas_udf(f, kind)(*columns)

    return wrap


class _Images(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in ("img", "image"):
            have = dict(attrs)
            value = next((have[name] for name in IMAGE_ATTRIBUTES if have.get(name)), None)
            if value is None and (first := (have.get("srcset") or "").split(",")[0].split()):
                value = first[0]
            if value and not value.startswith("data:"):
                self.found.append(value)

    handle_startendtag = handle_starttag


def image_sources(html: str | None) -> list[str]:
    """Image references of a page in document order, repeats kept (ST3, ST4, HP36)."""
    parser = _Images()
    parser.feed(html or "")
    return parser.found


@_lazy("array<string>")
def image_sources_udf(html: pd.Series) -> pd.Series:
    return html.map(image_sources)


def page_images(pages: DataFrame, entries: DataFrame, archive: str = "archive") -> DataFrame:
    """(archive, page, ord, name) of the images that pages (archive, name, html) show and the archive has (JN2)."""
    from quire.functions.text import resolved_path

    shown = pages.select(archive, F.col("name").alias("page"), F.posexplode(image_sources_udf("html")).alias("ord", "src"))
    shown = shown.select(archive, "page", "ord", resolved_path(F.col("page"), F.col("src")).alias("name"))
    return shown.join(entries.select(archive, "name"), [archive, "name"], "left_semi")


def parse_opf(xml: bytes | None, base: str = "") -> dict:
    """Manifest items and spine ids of a package, whatever the namespaces (SC3)."""
    items, spine = [], []
    for node in ET.fromstring(xml).iter() if xml else ():
        tag = node.tag.rpartition("}")[2]
        if tag == "item":
            href = unquote(node.get("href", ""))
            items.append({"id": node.get("id"), "href": href, "media_type": node.get("media-type"), "path": posixpath.normpath(posixpath.join(posixpath.dirname(base), href))})
        elif tag == "itemref":
            spine.append(node.get("idref"))
    return {"manifest": items, "spine": spine}


@_lazy("manifest array<struct<id: string, href: string, media_type: string, path: string>>, spine array<string>")
def parse_opf_udf(xml: pd.Series, base: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_opf(x, b or "") for x, b in zip(xml, base, strict=True)], columns=["manifest", "spine"])


def package_path(container: bytes) -> str | None:
    """The package's place, from the container record (SC2)."""
    return next((n.get("full-path") for n in ET.fromstring(container).iter() if n.tag.rpartition("}")[2] == "rootfile"), None)


def spine_pages(packages: DataFrame, entries: DataFrame) -> DataFrame:
    """(archive, pos, name): the pages of packages (archive, name, data) in spine order, the existing ones, the last of equal ids (SC4, JN1)."""
    parsed = packages.select("archive", parse_opf_udf("data", "name").alias("p"))
    spine = parsed.select("archive", F.posexplode("p.spine").alias("pos", "id"))
    items = parsed.select("archive", F.posexplode("p.manifest").alias("at", "i")).groupBy("archive", F.col("i.id").alias("id")).agg(F.max_by("i.path", "at").alias("name"))
    return spine.join(items, ["archive", "id"]).join(entries.select("archive", "name"), ["archive", "name"], "left_semi").select("archive", "pos", "name").orderBy("archive", "pos")


# --- wikitext -------------------------------------------------------------------------------------------

_BRACKETS = re.compile(r"\{\{|\}\}|\[\[|\]\]")


def _depths(text: str):
    """(position, depth before, token) of each double bracket."""
    depth = 0
    for m in _BRACKETS.finditer(text):
        yield m.start(), depth, m.group()
        depth += 1 if m.group() in ("{{", "[[") else -1


def top_level_templates(text: str) -> list[str]:
    """Whole {{..}} spans that lie in no other, up to the first that doesn't close (ST21)."""
    out, stack = [], []
    for m in re.finditer(r"\{\{|\}\}", text or ""):
        if m.group() == "{{":
            stack.append(m.start())
        elif stack:
            start = stack.pop()
            if not stack:
                out.append(text[start : m.end()])
    if stack:
        out = [t for t in out if text.find(t) < stack[0]]
    return out


def split_outside(text: str, mark: str, most: int = -1) -> list[str]:
    """Split at a mark that lies in no template and no link (ST22, ST23)."""
    cuts, last = [], 0
    levels = list(_depths(text)) + [(len(text), 0, "")]
    for at, before, _ in levels:
        if before == 0:
            k = text.find(mark, last, at)
            while k != -1 and (most < 0 or len(cuts) < most):
                cuts.append(k)
                k = text.find(mark, k + len(mark), at)
        last = at + 2
    parts, start = [], 0
    for k in cuts:
        parts.append(text[start:k])
        start = k + len(mark)
    return [*parts, text[start:]]


def template_fields(template: str) -> tuple[str, dict[str, str]]:
    """Lower-cased name and named fields of a template, the last of equal names (ST24, HP33)."""
    name, *fields = split_outside(template[2:-2], "|")
    out = {}
    for field in fields:
        key, *value = split_outside(field, "=", 1)
        if value:
            out[key.strip()] = value[0].strip()
    return re.sub(r"[\s_]+", " ", name).strip().lower(), out


def _template_text(body: str) -> str:
    """What a template without inner ones shows: nothing for flags, else its last argument (ST26)."""
    name, *args = (part.strip() for part in split_outside(body.strip(), "|"))
    shown = [a for a in args if a]
    return shown[-1] if shown and name.lower() not in SILENT_TEMPLATES else ""


# Fixed values: (pattern, what it becomes) before links and templates are resolved, and after, in their order.
_BEFORE = [(re.compile(p, f), r) for p, f, r in ((r"<!--.*?-->", re.S, ""), (r"<ref\b[^>/]*/>", re.I, ""), (r"<ref\b[^>]*>.*?</ref>", re.I | re.S, ""), (r"<br\s*/?>", re.I, ", "), (r"</?(?:small|span)[^>]*>", re.I, ""), (r"'{2,3}", 0, ""))]
_AFTER = [(re.compile(p), r) for p, r in ((r"\[https?://[^\s\]]+\s+([^\]]+)\]", r"\1"), (r"\[https?://[^\]]+\]", ""), (r"<[^>]+>", ""), (r"\s+", " "), (r"\s*[,，、]\s*$", ""))]
_LINK, _TEMPLATE = re.compile(r"\[\[([^\[\]]+)\]\]"), re.compile(r"\{\{([^{}]*)\}\}")


def clean_wikitext(value: str | None) -> str | None:
    """Plain text of a field: comments, references, templates, links, quotes and tags resolved (ST25, ST26, HP34)."""
    text = (value or "").strip()
    for pattern, shown in _BEFORE:
        text = pattern.sub(shown, text)
    inner = None
    while inner != text:
        inner = text
        text = _LINK.sub(lambda m: m.group(1).rpartition("|")[2].strip(), text)
        text = _TEMPLATE.sub(lambda m: _template_text(m.group(1)), text)
    for pattern, shown in _AFTER:
        text = pattern.sub(shown, text)
    return text.strip() or None


def clean_list(value: str | None, delimiters: str = LIST_DELIMITERS) -> list[str]:
    """Cleaned parts, the first of equals but for case (ST27)."""
    return _distinct(map(clean_wikitext, re.split(delimiters, value or "", flags=re.I)))


def _distinct(values) -> list[str]:
    """The values that aren't empty, the first of equals but for case."""
    found: dict[str, str] = {}
    for v in values:
        if v:
            found.setdefault(v.casefold(), v)
    return list(found.values())


def people_list(*values: str | None) -> list[str]:
    """People of several fields: successions and lines are separate people, leading roles go (ST28)."""
    text = re.sub(rf"(?:{K.SUCCESSION})|[\r\n]+", "<br>", "<br>".join(v for v in values if v))
    return _distinct(re.sub(rf"^(?:{'|'.join(ROLES)})\s*[：:]\s*", "", person).strip() for person in clean_list(text))


def count_of(value: str | None) -> int | None:
    """The first number of a field (ST29)."""
    found = re.search(r"\d+", _plain_digits(value))
    return int(found.group()) if found else None


def _plain_digits(value: str | None) -> str:
    return (clean_wikitext(value) or "").translate(str.maketrans(K.FULL_WIDTH[:10], K.HALF_WIDTH[:10]))


def edition_count(value: str | None, query: str | None) -> int | None:
    """The count of the edition that the query names: the nearest to its label in the label's clause (SO7)."""
    text = _plain_digits(value)
    for label in next((labels for word, labels in EDITION_LABELS.items() if word in (query or "")), ()):
        for clause in re.split(f"[{re.escape(CLAUSE_DELIMITERS)}]", text):
            for at in re.finditer(re.escape(label), clause):
                middle = at.start() + len(label) / 2
                found = [(abs((m.start() + m.end()) / 2 - middle), m.start(), int(m.group(1))) for m in re.finditer(r"(\d+)\s*[卷冊册]", clause)]
                if found:
                    return min(found)[2]
    return None


def country_of(value: str) -> str | None:
    low = value.casefold()
    return next((c for c, words in COUNTRY_WORDS.items() if any(w in low for w in words)), None)


def publishers(fields: dict[str, str]) -> dict[str, list[str]]:
    """All publishers and those of each country, in order (ST39, ST40)."""
    out: dict[str, list[str]] = {"all": [], **{c: [] for c in COUNTRY_WORDS}}
    for raw in re.split(r"(?i)<br\s*/?>", "<br>".join(fields[f] for f in PUBLISHER_FIELDS if fields.get(f))):
        if name := clean_wikitext(raw):
            for place in ("all", country_of(raw)):
                if place and name.casefold() not in (x.casefold() for x in out[place]):
                    out[place].append(name)
    return out


def match_key(value: str | None) -> str:
    """Letters and digits only, compatibility forms and case folded (ST31)."""
    return re.sub(r"[\W_]+", "", unicodedata.normalize("NFKC", clean_wikitext(value) or "")).casefold()


def categories(text: str | None) -> list[str]:
    """Category names of a page, the first of equals but for case (ST30)."""
    return _distinct(map(clean_wikitext, re.findall(r"(?i)\[\[Category:([^\]|]+)", text or "")))


def lead_summary(text: str | None) -> str | None:
    """The first paragraph before the first heading, templates dropped (ST47)."""
    lead = re.split(r"(?m)^==", text or "", maxsplit=1)[0]
    for t in top_level_templates(lead):
        lead = lead.replace(t, "")
    return next((c for c in (clean_wikitext(p) for p in re.split(r"\n\s*\n", lead)) if c), None)


WORK = "title string, original_title string, english_title string, author array<string>, penciller array<string>, publishers array<string>, taiwan_publishers array<string>, hongkong_publishers array<string>, japan_publishers array<string>, magazine array<string>, label string, start string, end string, volume_count bigint, chapter_count bigint, genre array<string>, raw_fields map<string,string>"


def works(text: str | None) -> list[dict]:
    """The work boxes of a page; a header box counts for the boxes after it (SR16, SR17)."""
    out, header = [], {}
    for name, fields in map(template_fields, top_level_templates(text or "")):
        if name == HEADER_BOX:
            header = fields
        elif name == WORK_BOX:
            own = publishers(fields)
            first = lambda names, f=fields: next((c for c in (clean_wikitext(f.get(n)) for n in names) if c), None)
            out.append(
                {
                    "title": clean_wikitext(fields.get("標題") or fields.get("title")), "original_title": clean_wikitext(header.get("japanese")), "english_title": clean_wikitext(header.get("english")),
                    "author": people_list(fields.get("作者"), fields.get("原作")), "penciller": people_list(fields.get("作畫"), fields.get("作画")),
                    "publishers": own["all"], "taiwan_publishers": own["taiwan"], "hongkong_publishers": own["hongkong"], "japan_publishers": own["japan"],
                    "magazine": clean_list(fields.get("連載雜誌")), "label": clean_wikitext(fields.get("label")), "start": first(START_FIELDS), "end": first(END_FIELDS),
                    "volume_count": count_of(fields.get("冊數")), "chapter_count": count_of(fields.get("話數")), "genre": clean_list(header.get("genre")), "raw_fields": fields,
                }
            )
    return out


def title_score(work: dict, query: str, title: str | None) -> int:
    """How well a work box fits a query: its title, side stories, words of the query, a known count (ST34)."""
    title, asked = title or "", match_key(query)
    key = match_key(title)
    score = 10 if key and key == asked else 5 if key and (key in asked or asked in key) else 0
    score += 3 * sum(word in query and word in title for word in SIDE_STORIES) + (work["volume_count"] is not None)
    words = _distinct(w for w in map(clean_wikitext, re.split(r"[\s_\-:：・,，。·《》「」『』【】\[\]()（）]+", query)) if w and len(w) > 1 and w not in STOP_WORDS)
    score += 3 * sum(bool(match_key(w)) and match_key(w) in key for w in words)
    # fixed values: hints for one series' side stories
    score += 4 * ("讓葉" in query and "讓葉" in title)
    return score + 4 * ("lc" in asked and "外傳" in query and "外傳" in title and "讓葉" not in title)


def main_work(text: str | None, query: str | None = None, page_title: str | None = None) -> dict | None:
    """The page's work box for a query, the first of the best (SO5), with the count of the edition asked for; `place` and `boxes` say where it stood."""
    found = works(text)
    if not found:
        return None
    best = 0
    if query:  # the first box often leaves out its title, which is then the page's
        titles = [w["title"] or (page_title if k == 0 else None) for k, w in enumerate(found)]
        best = max(range(len(found)), key=lambda k: (title_score(found[k], query, titles[k]), -k))
    work = dict(found[best], place=best, boxes=len(found))
    edition = edition_count(work["raw_fields"].get("冊數"), query)
    return work if edition is None else dict(work, volume_count=edition)


def titles_related(query: str, title: str | None) -> bool:
    """Equal keys, or a title of four letters or more, "the" aside, inside the query (ST36)."""
    if not title:
        return False
    asked, key = match_key(query), match_key(title)
    if asked == key:
        return True
    key = key.removeprefix("the")
    return len(key) >= 4 and key in asked


def page_strength(text: str | None, query: str, page_title: str | None) -> int:
    """3: the page has the very work, 2: a related one alone, 1: no work but a related title, 0: nothing (ST35)."""
    work = main_work(text, query, page_title)
    if work is None:
        return int(titles_related(query, page_title))
    title = work["title"] or (page_title if work["place"] == 0 else None)
    if title and match_key(title) == match_key(query):
        return 3
    return 2 * (work["boxes"] == 1 and titles_related(query, title))


@_lazy(f"array<struct<{', '.join(f.replace(' ', ': ', 1) for f in WORK.split(', '))}>>")
def works_udf(text: pd.Series) -> pd.Series:
    return text.map(works)


@_lazy(f"{WORK}, place int, boxes int")
def main_work_udf(text: pd.Series, query: pd.Series, page_title: pd.Series) -> pd.DataFrame:
    names = [f.split()[0] for f in WORK.split(", ")] + ["place", "boxes"]
    return pd.DataFrame([main_work(*row) or dict.fromkeys(names) for row in zip(text, query, page_title, strict=True)], columns=names)


@_lazy("int")
def page_strength_udf(text: pd.Series, query: pd.Series, page_title: pd.Series) -> pd.Series:
    return pd.Series([page_strength(*row) for row in zip(text, query, page_title, strict=True)], dtype="int32")


@_lazy("array<string>")
def categories_udf(text: pd.Series) -> pd.Series:
    return text.map(categories)


@_lazy("string")
def match_key_udf(value: pd.Series) -> pd.Series:
    return value.map(match_key)


@_lazy("string")
def lead_summary_udf(text: pd.Series) -> pd.Series:
    return text.map(lead_summary)


def rotate_tags(html: Column) -> Column:
    """(base name, hint) of images that carry a rotation tag (HP3)."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<img\b[^>]*>"), F.lit(0))
    tagged = F.filter(tags, lambda t: t.rlike(r"(?i)kmoetag\s*=\s*[\"'][^\"']*rotate:\d"))
    return F.transform(tagged, lambda t: F.struct(F.regexp_extract(t, r"(?i)src\s*=\s*[\"'](?:[^\"']*/)?([^\"'/]+)[\"']", 1).alias("name"), F.regexp_extract(t, r"(?i)rotate:(\d+)", 1).cast("int").alias("hint")))

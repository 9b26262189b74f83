"""Readers of documents: article XML, newswire SGML, JSON lines, identifiers in text. Files are read by Spark's own sources.

DOCUMENT is the shape that all of them give. Missing values are empty strings and lists.
"""

from __future__ import annotations

import html
import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SECTION = "struct<heading:string,paragraphs:array<string>>"
DOCUMENT = (
    f"doc_id string, title string, abstract array<string>, sections array<{SECTION}>, pmid string, doi string, journal string, year string, "
    "authors array<string>, keywords array<string>, mesh array<struct<d:string,major:boolean,q:array<string>>>, pubtypes array<string>, article_type string, "
    "source string, topics array<string>, places array<string>, split string"
)
_STRUCT = "struct<" + DOCUMENT.replace("array<struct<d:string,major:boolean,q:array<string>>>", "array<struct<d:string,major:boolean,q:array<string>>>") + ">"
_FIELDS = {"abstract", "sections", "authors", "keywords", "mesh", "pubtypes", "topics", "places"}

# Elements that hold no prose.
NO_PROSE = frozenset("table-wrap table disp-formula inline-formula tex-math ref-list fig graphic media supplementary-material fn-group".split())


def empty_document(**values: object) -> dict:
    names = re.findall(r"(\w+) (?:string|array)", DOCUMENT)
    return {n: [] if n in _FIELDS else "" for n in names} | values


def tidy(text: str) -> str:
    """Empty citation brackets out, no space before closing marks, white space made single."""
    text = re.sub(r"[\[(]\s*[,;–\-\s]*[\])]", "", text)
    return re.sub(r"\s+", " ", re.sub(r"\s+([.,;:!?)\]])", r"\1", text)).strip()


def _name(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def prose(e: ET.Element | None) -> str:
    """Text below an element without tables, formulae, references and citation marks."""
    if e is None:
        return ""
    out, stack = [], [(e, True)]
    while stack:
        x, opening = stack.pop()
        if not opening:
            out.append(x.tail or "")
            continue
        if x is not e:
            stack.append((x, False))
            if _name(x) in NO_PROSE or (_name(x) == "xref" and x.get("ref-type") == "bibr"):
                continue
        out.append(x.text or "")
        stack += [(c, True) for c in reversed(list(x))]
    return tidy("".join(out))


def _paragraphs(e: ET.Element) -> list[str]:
    """Paragraphs right below an element, list items and captions of figures and tables among them."""
    out = []
    for c in e:
        n = _name(c)
        if n == "p":
            out.append(prose(c))
        elif n in ("fig", "table-wrap"):
            out += [prose(p) for p in c.iterfind(".//caption/p")]
        elif n in ("list", "list-item", "boxed-text", "disp-quote"):
            out += _paragraphs(c)
    return [p for p in out if p]


def _sections(e: ET.Element | None) -> list[dict]:
    """Sections in order, inner ones after the paragraphs of the one they are in."""
    if e is None:
        return []
    out = []
    own = _paragraphs(e)
    if own or e.find("title") is not None:
        out.append({"heading": prose(e.find("title")), "paragraphs": own})
    for s in e.findall("sec"):
        out += _sections(s)
    return out


def article(e: ET.Element, source: str) -> dict:
    """A document of an article element. Its id is the first of pmcid, pmcaid, pmid and the file's name."""
    meta = e.find("front/article-meta")
    meta = meta if meta is not None else ET.Element("none")
    ids = {x.get("pub-id-type", ""): (x.text or "").strip() for x in meta.findall("article-id")}
    stem = re.sub(r"\.[^./]*$", "", source.rsplit("/", 1)[-1])
    doc_id = ids.get("pmcid") or (f"PMC{ids['pmcaid']}" if ids.get("pmcaid") else "") or (f"PMID{ids['pmid']}" if ids.get("pmid", "").isdigit() else ids.get("pmid", "")) or stem or "unknown"
    abstract = []
    for a in meta.findall("abstract"):
        if a.get("abstract-type") in ("graphical", "teaser"):
            continue
        abstract += _paragraphs(a)
        for s in a.findall("sec"):
            label = prose(s.find("title"))
            abstract += [f"{label}: {p}" if label else p for p in _paragraphs(s)]
    authors = []
    for c in meta.iter("contrib"):
        if c.get("contrib-type") == "author":
            name = c.find("name")
            authors.append(prose(c.find("collab")) if name is None else " ".join(filter(None, (prose(name.find("given-names")), prose(name.find("surname"))))))
    dates = {d.get("pub-type") or d.get("date-type") or "other": y.strip() for d in meta.findall("pub-date") if (y := d.findtext("year"))}
    journal = e.find("front/journal-meta")
    named = [journal.find(p) for p in ("journal-title-group/journal-title", "journal-title", "journal-id")] if journal is not None else []
    return empty_document(
        doc_id=doc_id, source=source, pmid=ids.get("pmid", ""), doi=ids.get("doi", ""), article_type=e.get("article-type", ""), title=prose(meta.find("title-group/article-title")),
        abstract=abstract, authors=[a for a in authors if a], keywords=[k for k in map(prose, meta.iter("kwd")) if k],
        year=next((dates[k] for k in ("epub", "ppub", "pub") if k in dates), next(iter(dates.values()), "")),
        journal=next((t for t in map(prose, named) if t), ""), sections=_sections(e.find("body")),
    )


def parse_xml(text: str, source: str = "") -> list[dict]:
    """Documents of an article or a set of them; raises ElementTree's ParseError."""
    root = ET.fromstring(re.sub(r"<!DOCTYPE[^>\[]*(?:\[[^\]]*\])?[^>]*>", "", text))
    return [article(e, source) for e in ([root] if _name(root) == "article" else root.iter("article"))]


def _parsed(text: Column, source: Column) -> Column:
    def run(texts: pd.Series, sources: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(texts, sources, strict=True):
            try:
                out.append(parse_xml(t, s))
            except ET.ParseError:
                out.append(None)
        return pd.Series(out)

    return F.pandas_udf(run, f"array<{_STRUCT}>")(text, source)


def read_articles(spark: SparkSession, path: str, pattern: str = "*.{xml,nxml}") -> DataFrame:
    """Documents of the XML files below path and `corrupt` (null but for a file that is not well-formed)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    parsed = files.select(F.col("path"), _parsed(F.decode("content", "UTF-8"), F.col("path")).alias("docs"))
    good = parsed.where("docs is not null").select(F.explode("docs").alias("d"), F.lit(None).cast("string").alias("corrupt")).select("d.*", "corrupt")
    bad = parsed.where("docs is null").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in good.schema.fields[:-1]], F.col("path").alias("corrupt"))
    return good.unionByName(bad)


ABSTRACT = "pmid string, title string, abstract array<string>, journal string, year string, authors array<string>, keywords array<string>, doi string, mesh array<struct<d:string,major:boolean,q:array<string>>>, pubtypes array<string>"


ABSTRACT_STRUCT = ABSTRACT.replace(" string", ":string").replace(" array", ":array")


def read_abstracts(spark: SparkSession, path: str) -> DataFrame:
    """Documents of JSON lines of abstracts; the id is PMID and the pmid, lines without one are dropped."""
    rows = spark.read.schema(ABSTRACT).json(path).where("pmid is not null")
    return with_document_columns(rows.withColumn("doc_id", F.concat(F.lit("PMID"), "pmid")).withColumn("source", F.lit(path)))


def with_document_columns(rows: DataFrame) -> DataFrame:
    """All columns of DOCUMENT, missing ones and nulls as empty."""
    from pyspark.sql.types import StructType

    out = []
    for f in StructType.fromDDL(DOCUMENT).fields:
        empty = F.array().cast(f.dataType) if f.name in _FIELDS else F.lit("")
        out.append((F.coalesce(F.col(f.name), empty) if f.name in rows.columns else empty).alias(f.name))
    return rows.select(*out)


def units(docs: DataFrame) -> DataFrame:
    """(doc_id, unit_no, field, text) of documents: title, abstract paragraphs, then headings and body paragraphs in order."""
    unit = lambda kind, x: F.struct(F.lit(kind).alias("field"), x.alias("text"))
    inner = F.flatten(F.transform("sections", lambda s: F.concat(F.array(unit("heading", s["heading"])), F.transform(s["paragraphs"], lambda p: unit("body", p)))))
    every = F.filter(F.concat(F.array(unit("title", F.col("title"))), F.transform("abstract", lambda p: unit("abstract", p)), inner), lambda u: F.length(u["text"]) > 0)
    return docs.select("doc_id", F.posexplode(every).alias("unit_no", "u")).select("doc_id", "unit_no", "u.field", "u.text")


# -- newswire --------------------------------------------------------------------------------------------------------


def unwrap(body: str | None) -> list[str]:
    """Paragraphs of a hard-wrapped body: four spaces or a blank line begin one; the agency's signature goes."""
    t = re.sub(r"[\x00-\x08\x0b-\x1f\x7f]", "", html.unescape(body or ""))
    t = re.sub(r"\s*(?:Reuter|REUTER)\s*$", "", t)
    pieces = re.split(r"\n[ \t]*\n|\n(?=    )", "\n" + t)
    return [p for p in (re.sub(r"[ \t]*\n[ \t]*|[ \t]+", " ", x).strip() for x in pieces) if p]


def _udf(f, kind: str):
    return lambda c: F.pandas_udf(lambda s: s.map(f), kind)(c)


def read_newswire(spark: SparkSession, path: str, pattern: str = "*.sgm") -> DataFrame:
    """Stories of SGML files in Latin-1: identifiers, flags, lists, title, dateline and body paragraphs."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(F.decode("content", "ISO-8859-1").alias("t"))
    rows = files.select(F.explode(F.regexp_extract_all("t", F.lit(r"(?s)<REUTERS[^>]*>.*?</REUTERS>"), F.lit(0))).alias("r"))
    head = F.regexp_extract("r", r"<REUTERS([^>]*)>", 1)
    clean = _udf(lambda s: re.sub(r"[ \t]+", " ", re.sub(r"[\x00-\x08\x0b-\x1f\x7f]", "", html.unescape(s)).strip()), "string")
    flag = lambda n: F.regexp_extract(head, rf'\b{n}="([^"]*)"', 1)
    part = lambda n: F.regexp_extract("r", rf"(?s)<{n}>(.*?)</{n}>", 1)
    items = lambda n: F.regexp_extract_all(part(n), F.lit(r"(?s)<D>(.*?)</D>"), F.lit(1))
    kind = F.regexp_extract("r", r'<TEXT\s+TYPE="([^"]+)"', 1)
    whole = F.regexp_replace(F.regexp_extract("r", r"(?s)<TEXT[^>]*>(.*?)</TEXT>", 1), r"<[^>]+>", "")
    body = F.when((part("BODY") == "") & (part("TITLE") == "") & (kind == "UNPROC"), whole).otherwise(part("BODY"))
    lists = {n.lower(): items(n) for n in ("TOPICS", "PLACES", "PEOPLE", "ORGS", "EXCHANGES", "COMPANIES")}
    return rows.select(
        F.coalesce(F.try_to_number(F.nullif(flag("NEWID"), F.lit("")), F.lit("9999999999")).cast("int"), F.lit(0)).alias("newid"),
        F.coalesce(F.try_to_number(F.nullif(flag("OLDID"), F.lit("")), F.lit("9999999999")).cast("int"), F.lit(0)).alias("oldid"),
        flag("LEWISSPLIT").alias("lewissplit"), flag("TOPICS").alias("topics_attr"), flag("CGISPLIT").alias("cgisplit"),
        F.when(kind == "", "NORM").otherwise(kind).alias("type"), clean(part("DATE")).alias("date"), *[c.alias(n) for n, c in lists.items()],
        clean(part("TITLE")).alias("title"), clean(part("DATELINE")).alias("dateline"), clean(part("AUTHOR")).alias("author"), _udf(unwrap, "array<string>")(body).alias("body"),
    )


def with_split(stories: DataFrame) -> DataFrame:
    """Stories with topics flagged, in train or test; the others are dropped."""
    split = F.when(F.col("lewissplit") == "TRAIN", "train").when(F.col("lewissplit") == "TEST", "test")
    return stories.withColumn("split", F.when(F.col("topics_attr") == "YES", split)).where("split is not null")


def write_stories(stories: DataFrame, path: str) -> None:
    """JSON lines in folders by split, so that a filter on it prunes files."""
    stories.select("newid", "oldid", "split", "type", "date", "topics", "places", "title", "dateline", "body").write.partitionBy("split").json(path)


def read_stories(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Documents of the lines that write_stories wrote, those of one split or all: the id is the story's number."""
    ddl = "newid int, oldid int, type string, date string, topics array<string>, places array<string>, title string, dateline string, body array<string>, split string"
    rows = spark.read.schema(ddl).json(path)
    if split:
        rows = rows.where(F.col("split") == split)
    year = F.regexp_extract("date", r"\b(\d{4})\b", 1)
    return with_document_columns(rows.select("*", F.concat(F.lit("R"), "newid").alias("doc_id"), F.col("body").alias("abstract"), year.alias("year"), F.lit(path).alias("source")))


# -- bibliographic records -------------------------------------------------------------------------------------------


def _text(e: ET.Element | None) -> str:
    return " ".join("".join(e.itertext()).split()) if e is not None else ""


def _record(entry: ET.Element) -> dict | None:
    cited = entry.find("MedlineCitation")
    art = cited.find("Article") if cited is not None else None
    if art is None:
        return None
    first = lambda *paths: next((t for p in paths if (t := _text((cited if p.startswith("Medline") else art).find(p)))), "")
    abstract = [(x.get("Label", "").title(), _text(x)) for x in art.findall("Abstract/AbstractText")]
    people = [_text(a.find("CollectiveName")) if a.find("LastName") is None else f"{_text(a.find('ForeName'))} {_text(a.find('LastName'))}".strip() for a in art.iter("Author")]
    headings = [(h.find("DescriptorName"), h.findall("QualifierName")) for h in cited.iter("MeshHeading")]
    return {
        "pmid": _text(cited.find("PMID")), "title": first("ArticleTitle").rstrip("."), "abstract": [f"{label}: {t}" if label else t for label, t in abstract if t],
        "journal": first("Journal/Title", "MedlineJournalInfo/MedlineTA"), "year": first("Journal/JournalIssue/PubDate/Year", "ArticleDate/Year") or first("Journal/JournalIssue/PubDate/MedlineDate")[:4],
        "authors": [a for a in people if a], "keywords": [k for k in map(_text, cited.iter("Keyword")) if k],
        "doi": next((_text(a) for a in entry.iter("ArticleId") if a.get("IdType") == "doi"), ""),
        "mesh": [{"d": _text(d), "major": any(x.get("MajorTopicYN") == "Y" for x in (d, *qs)), "q": [_text(x) for x in qs]} for d, qs in headings if d is not None],
        "pubtypes": [t for t in map(_text, art.iter("PublicationType")) if t],
    }


def parse_records(text: str) -> list[dict]:
    """Records with an abstract of a set in the bibliographic XML form; raises ElementTree's ParseError."""
    root = ET.fromstring(re.sub(r"<!DOCTYPE[^>\[]*(?:\[[^\]]*\])?[^>]*>", "", text))
    return [r for e in root.iter("PubmedArticle") if (r := _record(e)) is not None and r["abstract"]]


def read_records(spark: SparkSession, path: str, pattern: str = "*.xml") -> DataFrame:
    """Documents of files of bibliographic records, with headings and publication types; the id is PMID and the pmid."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", F.decode("content", "UTF-8").alias("t"))
    rows = files.select("path", F.explode(_udf(parse_records, f"array<struct<{ABSTRACT_STRUCT}>>")("t")).alias("r")).select("path", "r.*")
    kind = F.when(F.exists("pubtypes", lambda t: t.contains("Review")), "review-article").otherwise("research-article")
    return with_document_columns(rows.select("*", F.concat(F.lit("PMID"), "pmid").alias("doc_id"), F.col("path").alias("source"), kind.alias("article_type")))


# -- identifiers -----------------------------------------------------------------------------------------------------

_ID = re.compile(r"\bPMC\s*:?\s*0*(\d+)|\bPMID\s*:?\s*0*(\d+)|pubmed(?:\.ncbi\.nlm\.nih\.gov)?/0*(\d+)|(?<![\w./-])0*(\d{4,9})(?![\w-])", re.I)


def parse_ids(text: str | None) -> list[tuple[str, str]]:
    """(kind, number) of article identifiers, bare or in addresses, without leading zeros, each once, in order."""
    found = [("pmc", m[1]) if m[1] else ("pmid", m[2] or m[3] or m[4]) for m in _ID.finditer(text or "")]
    return list(dict.fromkeys(found))


def identifiers(text: Column | str) -> Column:
    kind = "array<struct<kind:string,number:string>>"
    return F.pandas_udf(lambda s: s.map(lambda t: [{"kind": k, "number": n} for k, n in parse_ids(t)]), kind)(text)

"""Readers on small files of our own."""

from corpuscope.sources import documents as d

XML = """<?xml version="1.0"?><!DOCTYPE article SYSTEM "x.dtd"><article article-type="research-article"><front><journal-meta><journal-title-group><journal-title>J. of Tests</journal-title></journal-title-group></journal-meta>
<article-meta><article-id pub-id-type="pmid">123</article-id><article-id pub-id-type="doi">10.1/x</article-id><title-group><article-title>On <i>nothing</i></article-title></title-group>
<contrib-group><contrib contrib-type="author"><name><surname>Doe</surname><given-names>A.</given-names></name></contrib></contrib-group><pub-date pub-type="ppub"><year>2020</year></pub-date><pub-date pub-type="epub"><year>2019</year></pub-date>
<abstract abstract-type="graphical"><p>skip</p></abstract><abstract><sec><title>Aim</title><p>We ask.</p></sec></abstract><kwd-group><kwd>void</kwd></kwd-group></article-meta></front>
<body><sec><title>Intro</title><p>Known before <xref ref-type="bibr">1</xref>, and&#xa0;more.</p><table-wrap><caption><p>A caption.</p></caption><table><tr><td>9</td></tr></table></table-wrap></sec></body></article>"""

SGML = """<REUTERS TOPICS="YES" LEWISSPLIT="TRAIN" CGISPLIT="X" OLDID="5" NEWID="1"><DATE>1-JAN</DATE><TOPICS><D>corn</D><D>wheat</D></TOPICS><PLACES></PLACES>
<TEXT>&#2;<TITLE>PRICES &amp; MORE</TITLE><DATELINE>  ROME, </DATELINE><BODY>First line
goes on.
    Second one.
 Reuter
</BODY></TEXT></REUTERS><REUTERS TOPICS="NO" LEWISSPLIT="TEST" NEWID="2"><TEXT TYPE="UNPROC">Raw text</TEXT></REUTERS>"""


def test_articles(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML)
    (tmp_path / "b.xml").write_text("<article><front>")
    rows = {r["doc_id"]: r for r in d.read_articles(spark, str(tmp_path)).collect()}
    a = rows["PMID123"]
    assert (a.title, a.abstract, a.year, a.journal, a.authors, a.keywords) == ("On nothing", ["Aim: We ask."], "2019", "J. of Tests", ["A. Doe"], ["void"])
    assert a.sections[0].heading == "Intro" and a.sections[0].paragraphs == ["Known before, and more.", "A caption."]
    assert rows[None].corrupt.endswith("b.xml")
    good = d.read_articles(spark, str(tmp_path)).where("corrupt is null")
    assert [(r.field, r.text) for r in d.units(good).orderBy("unit_no").collect()][:2] == [("title", "On nothing"), ("abstract", "Aim: We ask.")]


def test_newswire(spark, tmp_path):
    (tmp_path / "x.sgm").write_bytes(SGML.encode("latin-1"))
    rows = d.read_newswire(spark, str(tmp_path)).orderBy("newid").collect()
    assert [(r.newid, r.type, r.topics, r.title, r.dateline, r.body) for r in rows] == [(1, "NORM", ["corn", "wheat"], "PRICES & MORE", "ROME,", ["First line goes on.", "Second one."]), (2, "UNPROC", [], "", "", ["Raw text"])]
    kept = d.with_split(d.read_newswire(spark, str(tmp_path)))
    d.write_stories(kept, str(tmp_path / "out"))
    assert [(r.newid, r.split) for r in spark.read.json(str(tmp_path / "out")).collect()] == [(1, "train")]


def test_abstracts_and_ids(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"pmid": "7", "title": "T", "abstract": ["a"]}\n{"title": "no id"}\n')
    [r] = d.read_abstracts(spark, str(tmp_path / "x.jsonl")).collect()
    assert (r.doc_id, r.abstract, r.keywords, r.journal) == ("PMID7", ["a"], [], "")
    assert d.parse_ids("PMC0012, pmid: 34 https://pubmed.ncbi.nlm.nih.gov/0056/ PMC12 and 123456") == [("pmc", "12"), ("pmid", "34"), ("pmid", "56"), ("pmid", "123456")]


RECORDS = """<?xml version="1.0"?><!DOCTYPE PubmedArticleSet SYSTEM "p.dtd"><PubmedArticleSet>
<PubmedArticle><MedlineCitation><PMID>99</PMID><Article><Journal><JournalIssue><PubDate><MedlineDate>2001 Spring</MedlineDate></PubDate></JournalIssue><Title>Letters</Title></Journal>
<ArticleTitle>Of <b>mice</b>.</ArticleTitle><Abstract><AbstractText Label="METHODS">We  looked.</AbstractText><AbstractText>Then wrote.</AbstractText><AbstractText/></Abstract>
<AuthorList><Author><LastName>Poe</LastName><ForeName>E</ForeName></Author><Author><CollectiveName>The Group</CollectiveName></Author></AuthorList>
<PublicationTypeList><PublicationType>Review</PublicationType></PublicationTypeList></Article>
<MeshHeadingList><MeshHeading><DescriptorName MajorTopicYN="N">Mice</DescriptorName><QualifierName MajorTopicYN="Y">blood</QualifierName></MeshHeading><MeshHeading><DescriptorName>Rats</DescriptorName></MeshHeading></MeshHeadingList>
<KeywordList><Keyword>small</Keyword></KeywordList></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType="doi">10.9/z</ArticleId></ArticleIdList></PubmedData></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>100</PMID><Article><ArticleTitle>No abstract</ArticleTitle></Article></MedlineCitation></PubmedArticle></PubmedArticleSet>"""


def test_bibliographic_records(spark, tmp_path):
    (tmp_path / "r.xml").write_text(RECORDS)
    [r] = d.read_records(spark, str(tmp_path)).collect()
    assert (r.doc_id, r.title, r.year, r.journal, r.doi, r.article_type) == ("PMID99", "Of mice", "2001", "Letters", "10.9/z", "review-article")
    assert r.abstract == ["Methods: We looked.", "Then wrote."] and r.authors == ["E Poe", "The Group"] and r.keywords == ["small"] and r.pubtypes == ["Review"]
    assert [(m.d, m.major, m.q) for m in r.mesh] == [("Mice", True, ["blood"]), ("Rats", False, [])]


def test_stories_are_read_back(spark, tmp_path):
    (tmp_path / "x.sgm").write_bytes(SGML.encode("latin-1"))
    d.write_stories(d.with_split(d.read_newswire(spark, str(tmp_path))), str(tmp_path / "out"))
    [r] = d.read_stories(spark, str(tmp_path / "out"), "train").collect()
    assert (r.doc_id, r.title, r.abstract, r.topics, r.split) == ("R1", "PRICES & MORE", ["First line goes on.", "Second one."], ["corn", "wheat"], "train")
    assert d.read_stories(spark, str(tmp_path / "out"), "test").count() == 0


def test_manual_grades(spark, tmp_path):
    from corpuscope.sources import query_sets as q

    queries = spark.createDataFrame([("a", "one"), ("b", "two")], "qid string, text string")
    manual = q.set_grades(spark.createDataFrame([("a", 1, 1), ("b", 2, 2)], q.MANUAL), spark.createDataFrame([("a", 1, 9), ("b", 2, None), ("b", 3, -4)], q.MANUAL))
    q.save(queries, manual, str(tmp_path / "q"))
    back, grades = q.load(spark, str(tmp_path / "q"))
    assert sorted(map(tuple, back.collect())) == [("a", "one"), ("b", "two")] and sorted(map(tuple, grades.collect())) == [("a", 1, 2), ("b", 3, 0)]

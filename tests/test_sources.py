import io
import zipfile

from postmill.sources import files, html

DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"


def docx(method):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        z.writestr("word/document.xml", "<w:p>Hello <w:tab/>you</w:p>")
    return out.getvalue()


def test_files(spark):
    rows = [
        (1, "application/pdf", b"BT (Hello) Tj ET"),
        (2, "application/pdf", b"BT (BUDGET) Tj ET"),
        (3, "application/pdf", b"BT [(Hello) -20 (World)] TJ ET"),
        (4, DOCX, docx(zipfile.ZIP_STORED)),
        (5, DOCX, docx(zipfile.ZIP_DEFLATED)),
        (6, "text/plain", b"a\r\n b"),
        (7, "image/png", b"x"),
        (8, DOCX, b"junk"),
        (9, None, None),
    ]
    got = {r["id"]: r for r in files.parse_files(spark.createDataFrame(rows, "id int, mime string, content binary")).collect()}
    assert got[1]["text"] == "Hello" and "BUDGET" in got[2]["text"] and got[3]["text"] == "Hello World"
    assert got[4]["text"] == got[5]["text"] == "Hello you" and got[6]["text"] == "a\n b"
    assert got[7]["error"] and got[8]["error"] and got[9]["error"] and not got[1]["error"]


def test_read_folder(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hi")
    assert [r["text"] for r in files.read_files(spark, str(tmp_path)).collect()] == ["hi"]


LINKEDIN = """<link rel="canonical" href="https://b/jobs/view/9"><h1 class="x-job-title-y">Lead</h1>
<div class="job-card-container"><strong>No link</strong></div>
<li data-occludable-job-id="1"><a href="/jobs/view/1"><b>Dev</b></a><span class="job-card-container__primary-description">ACME</span><p class="my-insight">fast</p></li>
<li data-occludable-job-id="2"><a href="/jobs/view/1">Again</a></li><div id="job-details">A long description</div>"""
GLASSDOOR = '<li data-jobid="1"><div class="job-title">Cook</div><a href="/x">x</a></li><li data-jobid="2"><a class="job-title" href="/y">Chef</a></li>'


def test_sites(spark):
    pages = spark.createDataFrame([(1, "https://b/now", LINKEDIN), (2, "https://b/", None)], "page_id long, url string, html string")
    rows = html.extract(pages, "linkedin").orderBy("ord").collect()
    assert [(r["kind"], r["title"], r["url"], r["company"], r["description"]) for r in rows] == [("detail", "Lead", "https://b/jobs/view/9", "", "A long description"), ("card", "Dev", "https://b/jobs/view/1", "ACME", "")]
    assert [r["description"] for r in html.extract(pages, "linkedin", scan=True).filter("kind = 'card'").collect()] == ["fast"]
    other = pages.limit(1).selectExpr("page_id", "url", f"'{GLASSDOOR}' as html")
    assert [(r["title"], r["url"], r["description"]) for r in html.extract(other, "glassdoor").collect()] == [("Chef", "https://b/y", None)]


def test_first_time(spark):
    pages = spark.createDataFrame([(i, "https://b/now", LINKEDIN) for i in (1, 2)], "page_id long, url string, html string")
    assert html.first_time(html.extract(pages, "linkedin"), ["page_id", "ord"]).count() == 2


def test_selectors():
    root = html.parse('<ul class="s"><li>a</li><li class="t u">b</li></ul>')
    items = [n for n in root.walk() if n.tag == "li"]
    assert html.matches(items[1], ".s > li:nth-child(2)") and not html.matches(items[0], ".s > li:nth-child(2)")
    assert html.matches(items[1], "ul li.t.u") and not html.matches(items[1], "div li")


def test_enriched_details_have_their_own_keys(spark):
    rows = [(1, 0, "detail", "A", "u", False), (1, 1, "detail", "A", "u", True), (1, 2, "detail", "A", "u", True), (1, 3, "detail", "A", None, False), (1, 4, "card", "A", "u", False), (2, 5, "card", "A", "u", False)]
    df = spark.createDataFrame(rows, "page_id long, ord int, kind string, title string, url string, enriched boolean")
    assert sorted(r["ord"] for r in html.first_time(df, ["ord"]).collect()) == [0, 1, 3, 4]
    assert sorted(r["ord"] for r in html.first_time(df, ["ord"], "page_id").collect()) == [0, 1, 3, 4, 5]


def test_new_ids(spark):
    from pyspark.sql import functions as F

    from postmill.functions import formats

    ids = [r["i"] for r in spark.range(50).select(formats.new_id(F.lit(1_700_000_000_000)).alias("i")).collect()]
    assert len(set(ids)) == 50 and all(i.startswith("loyw3v28") and len(i) == 14 for i in ids)

"""A recorded crawl of known content: classification, rules and aggregates end to end."""

import pytest

from sitelens.plans import analysis, crawl_document

GOOD = '<html lang="es"><head><title>Una página correcta y suficiente</title>{}<link rel="canonical" href="{}"></head><body>{}<p>{}</p>{}</body></html>'


def page(url, description=True, h1=True, links="", images=""):
    meta = f'<meta name="description" content="{"Descripción bien escrita de esta página. " * 3}">' if description else ""
    return GOOD.format(meta, url, "<h1>Título</h1>" if h1 else "", f"{url} " + "palabra distinta " * 150, links + images)


@pytest.fixture(scope="module")
def tables(spark):
    site = "https://site.example"
    html = "text/html; charset=UTF-8"
    urls = {f"{site}/blog/{i}": (200, html, page(f"{site}/blog/{i}", description=i >= 6), None) for i in range(12)}
    urls |= {f"{site}/legal/{i}": (200, html, page(f"{site}/legal/{i}", h1=False), None) for i in range(2)}
    urls |= {f"{site}/up/{i}.jpg": (404 if i == 7 else 200, "image/webp" if i == 13 else None if i == 11 else "image/jpeg", None, None) for i in range(14)}
    urls |= {f"{site}/gone": (404, html, page(f"{site}/gone"), None), f"{site}/old": (301, html, None, None), f"{site}/style.css": (200, "text/css", None, None), f"{site}/down": (None, None, None, "TIMEOUT"), f"{site}/private/x": (200, html, page(f"{site}/private/x"), None)}
    anchors = "".join(f'<a href="{u}">{u}</a>' for u in urls) + '<a href="https://other.example/">out</a><a href="/nf" rel="nofollow">n</a><a href="mailto:a@b.c">m</a>'
    images = '<img src="/up/7.jpg" alt="rota"><img src="/up/1.jpg"><img src="/up/2.jpg" alt="">'
    urls[f"{site}/"] = (200, html, page(f"{site}/", links=anchors, images=images), None)
    rows = [(u, u, s, c, b, [u] if s == 301 else [], e) for u, (s, c, b, e) in urls.items()]
    responses = spark.createDataFrame(rows, "url string, final_url string, status int, content_type string, body string, redirect_chain array<string>, error_type string")
    return analysis.crawl(spark, responses, f"{site}/", exclude=["/private/"])


def codes(findings, code):
    return sorted(r["url"].split("example")[1] for r in findings.where(f"code = '{code}'").collect())


def test_crawl(spark, tables):
    pages = tables["pages"]
    assert pages.count() == 12 + 2 + 14 + 4 + 1 and pages.where("normalized_url like '%private%' or normalized_url like '%/nf'").count() == 0
    kinds = {r["normalized_url"].split("example")[1]: r["resource_type"] for r in pages.collect()}
    assert {k: kinds[k] for k in ("/", "/gone", "/old", "/down", "/up/7.jpg", "/up/11.jpg", "/up/13.jpg", "/style.css")} == {"/": "HTML_PAGE", "/gone": "ERROR", "/old": "REDIRECT", "/down": "ERROR", "/up/7.jpg": "ERROR", "/up/11.jpg": "IMAGE", "/up/13.jpg": "IMAGE", "/style.css": "CSS"}
    assert all(v != "HTML_PAGE" for k, v in kinds.items() if k.startswith("/up/"))


def check_document(spark, out):
    meta = spark.createDataFrame([("Casa", "site.example", "COMPLETED", "https://site.example/", 33, 12345, 1, 125)], "project string, domain string, status string, start_url string, crawled_urls long, discovered_urls long, failed_urls long, seconds long")
    got = {}
    for r in crawl_document.document_rows(out, meta).orderBy("section", "place").collect():
        got.setdefault(r["heading"], []).append(tuple(r["cells"]))
    facts = dict(got["Datos"])
    assert (facts["Proyecto"], facts["URLs descubiertas"], facts["Duración"], facts["Páginas HTML"], facts["Fallidas"]) == ("Casa", "12.345", "2m 5s", "15", "1")
    assert got["Resumen del rastreo"][0] == ("URL de inicio", "https://site.example/") and ("· IMAGE", "13") in got["Recursos descubiertos"]
    assert ("Sin atributo alt", "1 (33.3% de los <img> auditados)") in got["Imágenes dentro de páginas HTML"]
    counts = [int(c) for _, c in got["Códigos de estado"]]
    assert counts == sorted(counts, reverse=True) and sum(counts) == 33 and [h for h, _ in crawl_document.SECTIONS if h in got] == list(got)
    assert ("HIGH", "Error 4xx interno", "HTTP_4XX") in [c[:3] for c in got["Incidencias detectadas"]]
    assert [c[1].split("/")[1] for c in got["GEO Readiness"]] == ["15", "20", "15", "15", "10", "10", "10", "5"] and len(got["Hubs"]) == 10
    text = analysis.crawl_report("Report", out, meta)
    assert text.startswith("# Report\n\n## Datos\n\n| Dato | Valor |") and "comunidad(es) detectada(s).\n" in text
    old = crawl_document.document_rows({k: v for k, v in out.items() if k not in ("images", "clusters", "geo")}).where("section in (0, 2, 3, 9, 10)").collect()
    assert [r["cells"] for r in old if r["section"] == 2] == [[crawl_document.LEGACY]] and {r["section"] for r in old} == {0, 2}


def test_analysis(spark, tables):
    out = analysis.analyze(tables)
    f = out["findings"].cache()
    assert codes(f, "MISSING_DESCRIPTION") == [f"/blog/{i}" for i in range(6)] and codes(f, "MISSING_H1") == ["/legal/0", "/legal/1"]
    assert codes(f, "MIME_MISMATCH") == ["/up/13.jpg"] and codes(f, "BROKEN_IMAGE") == ["/"] and codes(f, "REDIRECT") == ["/old"] and codes(f, "FETCH_ERROR") == ["/down"]
    assert {r["code"] for r in f.where("url like '%/gone'").collect()} == {"HTTP_4XX"}
    assert {r["code"] for r in f.where("url like '%/up/13.jpg'").collect()} == {"MIME_MISMATCH"}
    images, totals = out["images"].first(), out["totals"].first()
    assert (images["elements"], images["missing_alt"], images["decorative_alt"], images["described_alt"]) == (3, 1, 1, 1)
    assert totals["requested_urls"] == 33 and totals["html_pages"] == 15 and out["resources"].first()["broken_images"] == 1
    check_document(spark, out)
    context = analysis.audit_context(out["pages"], tables["links"], f, tables["schemas"])
    assert context["broken"].count() == 2 and context["redirects"].count() == 1


def test_crawl_resumes(spark, tmp_path):
    """A crawl whose last tables are gone goes on from what is whole, and reads no answer of the levels that are done."""
    import shutil

    site = "https://site.example"
    pages = {f"{site}/": f'<a href="{site}/a">a</a>', f"{site}/a": f'<a href="{site}/b">b</a>', f"{site}/b": f'<a href="{site}/c">c</a>', f"{site}/c": "end"}
    schema = "url string, final_url string, status int, content_type string, body string, redirect_chain array<string>, error_type string"
    rows = [(u, u, 200, "text/html", b, [], None) for u, b in pages.items()]
    state = str(tmp_path / "state")
    whole = sorted(r["url"] for r in analysis.crawl(spark, spark.createDataFrame(rows, schema), f"{site}/", state=state)["pages"].collect())
    for gone in ("2/parsed", "2/found", "3", "4"):
        shutil.rmtree(f"{state}/{gone}", ignore_errors=True)
    rest = [r for r in rows if r[0] in (f"{site}/b", f"{site}/c")]
    again = analysis.crawl(spark, spark.createDataFrame(rest, schema), f"{site}/", state=state)["pages"]
    assert sorted(r["url"] for r in again.collect()) == whole == sorted(pages) and again.where("status_code is null").count() == 0


def test_reports(spark):
    import json

    good = {"summary": "all well", "score": 55, "recommendations": [{"priority": 2, "action": "b"}, {"priority": 1, "action": "a"}], "implementationOrder": ["x"]}
    text = analysis.audit_document("Audit", spark.createDataFrame([("{broken",), (json.dumps(good),)], "output string"))
    assert "all well" in text and text.index("| a |") < text.index("| b |") and "# Audit" in text
    assert "## Metrics" in analysis.comparison_report("C", {"metrics": spark.createDataFrame([("m", 1)], "metric string, delta int")})


def test_crawl_keeps_robots(spark):
    site = "https://r.example"
    rows = [(f"{site}/{p}", f"{site}/{p}", 200, "text/html", page(f"{site}/{p}", links="".join(f'<a href="/{q}">x</a>' for q in ("a", "no/b", "c"))), [], None) for p in ("", "a", "no/b", "c")]
    responses = spark.createDataFrame(rows, "url string, final_url string, status int, content_type string, body string, redirect_chain array<string>, error_type string")
    robots = spark.createDataFrame([(site, "User-agent: *\nDisallow: /no/\nUser-agent: good\nAllow: /")], "origin string, text string")
    found = {agent: {r["normalized_url"][len(site) :]: (r["status_code"], r["error_type"], r["indexability_reason"]) for r in analysis.crawl(spark, responses, f"{site}/", robots=robots, agent=agent)["pages"].collect()} for agent in ("some", "good/2")}
    open_ = (200, None, "INDEXABLE")
    assert found["some"] == {"/": open_, "/a": open_, "/c": open_, "/no/b": (None, "BLOCKED_ROBOTS", "BLOCKED_ROBOTS")}
    assert found["good/2"] == dict.fromkeys(("/", "/a", "/c", "/no/b"), open_)

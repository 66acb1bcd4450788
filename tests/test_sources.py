import json

import pytest
from pyspark.sql import functions as F

from jobmosaic.sources import portals as W

VAGAS = """<ul><li class="vaga odd "><h2 class="cargo"><a class="link-detalhes-vaga" data-id-vaga="77" title="Dev de Software Jr" href="/vagas/v77/dev"><mark>Dev</mark></a></h2>
<span class="emprVaga"> Casa </span><span class="nivelVaga">Pleno</span><div class="detalhes"><p>Texto: <mark>Dev</mark> Jr</p></div><div class="vaga-local"><i class="x"></i> Rio / RJ </div><span class="data-publicacao"><i></i>09/07/2026</span></li>
<li class="vaga"><a class="link-detalhes-vaga" data-id-vaga="78" href="http://a.example/78">Só <b>texto</b></a><div class="vaga-local">100% Home Office</div></li><li class="vaga"><a class="link-detalhes-vaga" title="sem id" href="/x">x</a></li><li class="vaga">sem link</li></ul>"""
THOR = """<div class="wrapper-jobs-list"><a href="/jobs/11-dev"><h3 class="y">Dev PHP</h3><div class="cell-list-content-icon"><span><i class="fas fa-plane"></i>Não</span><span><i class="fa fa-briefcase"></i>CASA - ME</span><span><i class="fas fa-map-marker-alt"></i>São Paulo  (Híbrido)</span>
<span><i class="far fa-money-bill-alt"></i>Até R$4.000</span><span><i class="far fa-chart-bar"></i>Júnior</span><span><i class="far fa-file-alt"></i>Estágio</span></div><span class="tag-list a">API</span><span class="tag-list a">PHP</span></a>
<a href="/jobs/12-x"><h3><span class="b color-red">Vencida</span> Velha</h3></a><a href="/jobs/13-y"><h3>Remota</h3><div class="cell-list-content-icon"><span><i class="fa-map-marker-alt"></i>Remoto</span></div></a><a href="/outra">z</a></div><a href="/jobs/14-fora"><h3>fora</h3></a>"""
LINKED = """<div class="base-card job" data-entity-urn="urn:li:jobPosting:4422"><a class="base-card__full-link" href="https://l.example/view/4422?position=1&amp;p=0"><span>s</span></a><h3 class="base-search-card__title"> Dev Jr </h3><h4 class="base-search-card__subtitle">ACME</h4>
<span class="job-search-card__location">Brasil (Remote)</span><time datetime="2026-08-01T00:00">1 dia</time></div><div class="base-card" data-entity-urn="urn:x"><h3 class="base-search-card__title">sem id</h3></div><div class="base-card" data-entity-urn="urn:9"></div>"""


def pages(spark, html):
    return spark.createDataFrame([("termo", 1, html), ("termo", 2, None), ("termo", 3, "<p>nada</p>")], "term string, page long, html string")


def fields(df, *columns):
    return [tuple(r) for r in df.orderBy("page", "pos").select(*columns).collect()]


def test_vagas(spark):
    got = fields(W.vagas_cards(pages(spark, VAGAS), "https://v.example"), "external_id", "title", "company", "url", "description", "location", "workplace_type", "published_date", "search_term", "seniority")
    assert got == [
        ("77", "Dev de Software Jr", "Casa", "https://v.example/vagas/v77/dev", "Texto: Dev Jr", "Rio / RJ", "Não informado", "09/07/2026", "termo", ""),
        ("78", "Só texto", "", "http://a.example/78", "", "100% Home Office", "Remoto", "", "termo", ""),
    ]


def test_programathor(spark):
    got = fields(W.programathor_cards(pages(spark, THOR), "https://p.example"), "external_id", "title", "company", "url", "description", "location", "workplace_type", "seniority")
    assert got == [
        ("11", "Dev PHP", "CASA - ME", "https://p.example/jobs/11-dev", "Tecnologias: API, PHP. Contrato: Estágio. Faixa salarial: Até R$4.000.", "São Paulo", "Híbrido", "Estágio"),
        ("13", "Remota", "", "https://p.example/jobs/13-y", "", "", "Remoto", ""),
    ]


def test_linkedin(spark):
    got = fields(W.linkedin_cards(pages(spark, LINKED)), "external_id", "title", "company", "url", "description", "location", "workplace_type", "published_date")
    assert got == [("4422", "Dev Jr", "ACME", "https://l.example/view/4422", "", "Brasil (Remote)", "Remoto", "2026-08-01")]


def landed(spark, records):
    return spark.createDataFrame([("termo", 1, i, json.dumps(r)) for i, r in enumerate(records)], "term string, page long, pos long, json string")


def test_gupy(spark):
    records = [
        {"id": 1, "name": "Dev", "careerPageName": "Casa", "jobUrl": "", "careerPageUrl": "https://c", "city": " Rio ", "state": "", "country": "Brasil", "isRemoteWork": True, "workplaceType": None, "publishedDate": "2026-07-20T1", "description": "<b>x</b>"},
        {"id": 2, "name": "Dev", "city": None, "country": " Brasil ", "workplaceType": "hybrid", "isRemoteWork": True}, {"id": None, "name": "x"}, {"id": 3, "name": ""},
    ]
    got = fields(W.gupy_json(landed(spark, records)), "external_id", "company", "url", "location", "workplace_type", "published_date", "description")
    assert got == [("1", "Casa", "https://c", "Rio", "Remoto", "2026-07-20", "<b>x</b>"), ("2", "", "", "Brasil", "Híbrido", "", "")]


def test_trampos(spark):
    records = [
        {"id": 1, "name": " Dev ", "type_name": "CLT", "type_slug": "estagio", "category_name": "TI", "salary": "Não divulgada", "home_office": None, "hybrid": False, "company": {"name": " Casa ", "description": "longa"}, "whatsapp_share_url": "https://t/o/1/share/w"},
        {"id": 2, "name": "Dev", "salary": " 2 mil ", "home_office": True, "hybrid": True, "custom_company_name": "Própria"}, {"id": 3, "name": " "},
    ]
    got = fields(W.trampos_json(landed(spark, records), "https://t"), "external_id", "title", "company", "url", "description", "workplace_type", "seniority")
    assert got == [("1", "Dev", "Casa", "https://t/o/1", "Categoria: TI. Tipo: CLT.", "Presencial", "Estágio"), ("2", "Dev", "Própria", "https://t/oportunidades/2", "Salário: 2 mil.", "Remoto", "")]


def test_union_order(spark):
    rows = W.collect_union({"gupy": landed(spark, [{"id": 5, "name": "a"}, {"id": 4, "name": "b"}]), "vagas": pages(spark, VAGAS), "outro": pages(spark, VAGAS)}, ["vagas", "gupy", "outro"], ["x", "termo"])
    assert [r.external_id for r in rows.orderBy("ord").select("external_id").collect()] == ["77", "78", "5", "4"]
    assert rows.select(F.countDistinct("ord")).first()[0] == 4


def test_union_order_of_large_pages(spark):
    at = [5, 65535, 65536, 65536 + 5, 200000]
    cards = lambda numbers: spark.createDataFrame([(t, p, VAGAS) for t in ("x", "termo") for p in numbers], "term string, page long, html string")
    rows = W.collect_union({"vagas": cards(at)}, ["vagas"], ["x", "termo"]).select("ord", "search_term", "external_id").orderBy("ord").collect()
    assert len({r.ord for r in rows}) == len(rows) == 4 * len(at) and min(r.ord for r in rows) > 0
    assert [r.search_term for r in rows] == ["x"] * 10 + ["termo"] * 10 and [r.external_id for r in rows] == ["77", "78"] * 10
    places = [(r.ord >> 16) & (1 << W.PAGE_BITS) - 1 for r in rows]
    assert places == [p for p in at for _ in range(2)] * 2
    for wrong in (-1, 1 << 31):
        with pytest.raises(Exception, match="beyond"):
            W.collect_union({"vagas": cards([wrong])}, ["vagas"], ["x", "termo"]).collect()


def test_ids_of_any_type_and_records_that_are_no_json(spark):
    rows = [("termo", 1, 0, '{"id": "0012", "name": "a", "city": " Rio  Claro ", "state": "SP"}'), ("termo", 1, 1, '{"id": 12345678901234567890, "name": "b"}'), ("termo", 1, 2, '{"id": 5, "na'), ("termo", 1, 3, ""), ("termo", 1, 4, None), ("termo", 1, 5, "[]")]
    df = spark.createDataFrame(rows, "term string, page long, pos long, json string")
    assert fields(W.gupy_json(df), "external_id", "location") == [("0012", "Rio  Claro, SP"), ("12345678901234567890", "")]
    assert fields(W.trampos_json(df), "external_id", "url") == [("0012", "https://trampos.co/oportunidades/0012"), ("12345678901234567890", "https://trampos.co/oportunidades/12345678901234567890")]


def test_deep_and_broken_pages(spark):
    deep = "<div>" * 10_000 + VAGAS
    rows = [("termo", 1, deep), ("termo", 2, "</p></div>" * 5_000 + VAGAS), ("termo", 3, '<li class="vaga"><a class="link-detalhes-vaga" data-id-vaga="9" title="x"' ), ("termo", 4, "<![CDATA[ <!-- <li class='vaga'>"), ("termo", 5, "<li class='vaga'><b>" + "<i>" * 9_000 + "fim")]
    df = spark.createDataFrame(rows, "term string, page long, html string")
    assert fields(W.vagas_cards(df), "external_id", "title") == [("77", "Dev de Software Jr"), ("78", "Só texto")] * 2
    assert W.parse(deep).text() == W.parse(VAGAS).text()


def test_plain_tags_skip_the_general_parser(monkeypatch):
    tree = lambda node: [c if isinstance(c, str) else (c.tag, c.attributes, tree(c)) for c in node.children]
    pages = ["<div><b>x</b><br>y<script>a<b>c</script><title>a<b>&amp;</title></div>", "<DIV><p >a<p/><a1>b<div", "<style><b></style><li><li>z</ul></li>&lt;b&gt;<h1-x>t</h1-x>", "<textarea><b></textarea><i>" * 2]
    fast = [tree(W.parse(p)) for p in pages]
    monkeypatch.setattr(W._Builder, "PLAIN", W.re.compile("(?!)"), raising=False)
    assert fast == [tree(W.parse(p)) for p in pages]
    monkeypatch.undo()
    monkeypatch.setattr(W.HTMLParser, "parse_starttag", None)
    assert W.parse("<div><b>x</b></div>").one("b").text() == "x"

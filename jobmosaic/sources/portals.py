"""Landed records and pages of the portals as raw postings. Parsing is narrow: no shuffle, no row leaves its task."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmosaic.functions.rules import HYBRID, ON_SITE, PORTALS, REMOTE, SEARCH_TERMS
from jobmosaic.functions.text import normalize_workplace, remote_if, squash_ws, strip_ws

GUPY = "id string, name string, description string, careerPageName string, careerPageUrl string, publishedDate string, isRemoteWork boolean, city string, state string, country string, jobUrl string, workplaceType string"
TRAMPOS = "id string, name string, type_name string, type_slug string, category_name string, home_office boolean, hybrid boolean, salary string, published_at string, custom_company_name string, company struct<name: string>, email_share_url string, whatsapp_share_url string"

#: Columns of a raw posting.
RAW = ["source", "external_id", "title", "company", "url", "description", "location", "workplace_type", "published_date", "search_term", "seniority"]
#: Bits of the packed arrival number for term, page and place on the page; the portal has what is above.
TERM_BITS, PAGE_BITS, PLACE_BITS = 12, 31, 16


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _or(*columns: Column | str) -> Column:
    """The first that isn't null or empty, else empty."""
    return F.coalesce(*[F.nullif(_text(c), F.lit("")) for c in columns], F.lit(""))


def _placed(df: DataFrame, source: str, **fields: Column) -> DataFrame:
    named = {"source": F.lit(source), "location": F.lit(""), "published_date": F.lit(""), "seniority": F.lit(""), "search_term": F.col("term")} | fields
    return df.select(*[named[c].alias(c) for c in RAW], "page", "pos")


def gupy_json(records: DataFrame) -> DataFrame:
    """records: term, page, pos, json. Those without id or name are dropped, and those that aren't JSON; an id may be of any type."""
    r = records.withColumn("r", F.from_json("json", GUPY)).filter("r.id IS NOT NULL AND coalesce(r.name, '') <> ''")
    place = F.concat_ws(", ", *[F.nullif(strip_ws(f"r.{c}"), F.lit("")) for c in ("city", "state")])
    return _placed(
        r, "gupy", external_id=F.col("r.id"), title=F.col("r.name"), company=_text("r.careerPageName"), url=_or("r.jobUrl", "r.careerPageUrl"),
        description=_text("r.description"), location=_or(place, strip_ws("r.country")),
        workplace_type=normalize_workplace(_or("r.workplaceType", F.when(F.col("r.isRemoteWork"), F.lit("remote")))), published_date=F.substring(_text("r.publishedDate"), 1, 10),
    )


def trampos_json(records: DataFrame, site: str = "https://trampos.co") -> DataFrame:
    """records: term, page, pos, json. The company's own description isn't used."""
    r = records.withColumn("r", F.from_json("json", TRAMPOS)).withColumn("title", strip_ws(F.coalesce("r.name", F.lit("")))).filter("r.id IS NOT NULL AND title <> ''")
    shared = lambda c: F.when(F.contains(_text(c), F.lit("/share/")), F.substring_index(c, "/share/", 1))
    said = lambda label, c: F.when(_text(c) != "", F.concat(F.lit(f"{label}: "), c if isinstance(c, Column) else F.col(c), F.lit(".")))
    pay = strip_ws(F.coalesce("r.salary", F.lit("")))
    salary = F.when(F.upper(pay) != "NÃO DIVULGADA", pay)
    return _placed(
        r, "trampos", external_id=F.col("r.id"), title=F.col("title"), company=_or("r.custom_company_name", strip_ws("r.company.name")),
        url=F.coalesce(shared("r.email_share_url"), shared("r.whatsapp_share_url"), F.concat(F.lit(f"{site}/oportunidades/"), F.col("r.id"))),
        description=F.concat_ws(" ", said("Categoria", "r.category_name"), said("Tipo", "r.type_name"), said("Salário", salary)),
        workplace_type=F.when(F.col("r.home_office"), F.lit(REMOTE)).when(F.col("r.hybrid"), F.lit(HYBRID)).otherwise(F.lit(ON_SITE)),
        published_date=F.substring(_text("r.published_at"), 1, 10), seniority=F.when(F.col("r.type_slug") == "estagio", F.lit("Estágio")).otherwise(F.lit("")),
    )


class Node:
    """An element: tag, attributes, and children that are nodes or strings. Pages may be nested to any depth."""

    def __init__(self, tag: str, attributes: dict[str, str | None], above: Node | None):
        self.tag, self.attributes, self.above = tag, attributes, above
        self.children: list[Node | str] = []

    def walk(self):
        """All elements below, in the order in which they begin."""
        open_ = [iter(self.children)]
        while open_:
            child = next(open_[-1], None)
            if child is None:
                open_.pop()
            elif isinstance(child, Node):
                yield child
                open_.append(iter(child.children))

    def classes(self) -> list[str]:
        return (self.attributes.get("class") or "").split()

    def all(self, tag: str | None = None, kind: str | None = None) -> list[Node]:
        return [n for n in self.walk() if (tag is None or n.tag == tag) and (kind is None or kind in n.classes())]

    def one(self, tag: str | None = None, kind: str | None = None) -> Node | None:
        return next((n for n in self.walk() if (tag is None or n.tag == tag) and (kind is None or kind in n.classes())), None)

    def text(self, without: Node | None = None) -> str:
        parts: list[str] = []
        open_ = [iter(self.children)]
        while open_:
            child = next(open_[-1], None)
            if child is None:
                open_.pop()
            elif isinstance(child, str):
                parts.append(child.strip())
            elif child is not without:
                open_.append(iter(child.children))
        return " ".join(" ".join(p for p in parts if p).split())


class _Builder(HTMLParser):
    #: A tag without attributes, but for those after which the parser reads on in its own way.
    PLAIN = re.compile(r"<(?!(?:script|style|textarea|title|iframe|noembed|noframes|noscript|xmp|plaintext)>)([a-z][a-z0-9]*)>")
    EMPTY = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.open: Counter[str] = Counter()

    def parse_starttag(self, i):
        """Most tags have no attributes and need none of the general steps."""
        if plain := self.PLAIN.match(self.rawdata, i):
            self.handle_starttag(plain[1], ())
            return plain.end()
        return super().parse_starttag(i)

    def updatepos(self, i, j):
        """Line numbers aren't asked for."""
        return j

    def handle_starttag(self, tag, attrs):
        node = Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in self.EMPTY:
            self.at = node
            self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, dict(attrs), self.at))

    def handle_endtag(self, tag):
        if not self.open[tag]:
            return  # nothing to close
        while True:
            node, self.at = self.at, self.at.above
            self.open[node.tag] -= 1
            if node.tag == tag:
                return

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def _said(node: Node | None) -> str:
    return node.text() if node else ""


def vagas_fields(root: Node) -> list[dict[str, str]]:
    found = []
    for card in root.all("li", "vaga"):
        if link := card.one("a", "link-detalhes-vaga"):
            found.append({
                "id": link.attributes.get("data-id-vaga") or "", "title": link.attributes.get("title") or link.text(), "href": link.attributes.get("href") or "",
                "company": _said(card.one("span", "emprVaga")), "description": _said(card.one("div", "detalhes")), "location": _said(card.one(None, "vaga-local")), "date": _said(card.one("span", "data-publicacao")),
            })
    return found


def programathor_fields(root: Node) -> list[dict[str, str]]:
    """Fields are told by the icon beside them, not by their place."""
    icons = {"fa-briefcase": "company", "fa-map-marker-alt": "location", "fa-building": "company_type", "fa-chart-bar": "expertise", "fa-file-alt": "contract", "fa-money-bill-alt": "salary"}
    found = []
    for page in root.all(None, "wrapper-jobs-list"):
        for card in page.all("a"):
            href, head = card.attributes.get("href") or "", card.one("h3")
            if not href.startswith("/jobs/") or head is None:
                continue
            badge = head.one("span", "color-red")
            row = {"href": href, "title": head.text(without=badge), "badge": _said(badge), "tags": ", ".join(t.text() for t in card.all(None, "tag-list"))}
            for box in card.all(None, "cell-list-content-icon"):
                for span in box.all("span"):
                    if icon := span.one("i"):
                        named = [icons[c] for c in icon.classes() if c in icons]
                        row |= {named[0]: span.text()} if named else {}
            found.append(row)
    return found


def linkedin_fields(root: Node) -> list[dict[str, str]]:
    found = []
    for card in root.all("div", "base-card"):
        link, time = card.one("a", "base-card__full-link"), card.one("time")
        found.append({
            "urn": card.attributes.get("data-entity-urn") or "", "title": _said(card.one("h3", "base-search-card__title")), "href": (link.attributes.get("href") or "") if link else "",
            "company": _said(card.one("h4", "base-search-card__subtitle")), "location": _said(card.one("span", "job-search-card__location")), "date": (time.attributes.get("datetime") or "") if time else "",
        })
    return found


#: Fields of the cards of a parsed page, in the order of the page.
Fields = Callable[[Node], list[dict[str, str]]]
CARD = "term string, page long, pos long, c map<string,string>"


def cards(pages: DataFrame, fields: Fields) -> DataFrame:
    """pages: term, page, html. One row for each card: term, page, pos and a map of its fields."""

    def run(batches):
        for batch in batches:
            rows = [(t, p, n, card) for t, p, h in zip(batch["term"], batch["page"], batch["html"], strict=True) for n, card in enumerate(fields(parse(h)))]
            yield pd.DataFrame(rows, columns=["term", "page", "pos", "c"])

    return pages.select("term", "page", "html").mapInPandas(run, CARD)


def _field(name: str) -> Column:
    return F.coalesce(F.try_element_at(F.col("c"), F.lit(name)), F.lit(""))


def vagas_postings(cards: DataFrame, site: str = "https://www.vagas.com.br") -> DataFrame:
    c = cards.filter((_field("id") != "") & (_field("title") != ""))
    url = F.when(F.startswith(_field("href"), F.lit("http")), _field("href")).otherwise(F.concat(F.lit(site), _field("href")))
    return _placed(
        c, "vagas", external_id=_field("id"), title=_field("title"), company=_field("company"), url=url, description=_field("description"),
        location=_field("location"), workplace_type=remote_if(_field("location"), "home office"), published_date=_field("date"),
    )


def programathor_postings(cards: DataFrame, site: str = "https://programathor.com.br") -> DataFrame:
    """Expired cards are dropped; a contract that begins with `est` is an internship, whatever the declared level."""
    number = F.regexp_extract(_field("href"), r"/jobs/(\d+)", 1)
    c = cards.filter((number != "") & (_field("title") != "") & ~F.contains(F.lower(_field("badge")), F.lit("vencida")))
    place, mode = squash_ws(_field("location")), r"\(([^)]+)\)\s*$"
    has_mode, bare = place.rlike(mode), normalize_workplace(place) == REMOTE
    said = lambda label, name: F.when(_field(name) != "", F.concat(F.lit(f"{label}: "), _field(name), F.lit(".")))
    return _placed(
        c, "programathor", external_id=number, title=_field("title"), company=_field("company"), url=F.concat(F.lit(site), _field("href")),
        description=F.concat_ws(" ", said("Tecnologias", "tags"), said("Contrato", "contract"), said("Empresa", "company_type"), said("Faixa salarial", "salary")),
        location=F.when(has_mode, F.trim(F.regexp_replace(place, mode, ""))).when(bare, F.lit("")).otherwise(place),
        workplace_type=F.when(has_mode, normalize_workplace(F.regexp_extract(place, mode, 1))).when(bare, F.lit(REMOTE)).otherwise(F.lit("")),
        seniority=F.when(F.startswith(F.lower(F.trim(_field("contract"))), F.lit("est")), F.lit("Estágio")).otherwise(F.trim(_field("expertise"))),
    )


def linkedin_postings(cards: DataFrame) -> DataFrame:
    number = F.regexp_extract(_field("urn"), r"(\d+)$", 1)
    c = cards.filter((number != "") & (_field("title") != ""))
    return _placed(
        c, "linkedin", external_id=number, title=_field("title"), company=_field("company"), url=F.substring_index(_field("href"), "?", 1), description=F.lit(""),
        location=_field("location"), workplace_type=remote_if(_field("location"), "remoto", "remote"), published_date=F.substring(_field("date"), 1, 10),
    )


#: Portals with pages: what is read from a page, and how cards become raw postings.
CARDS: dict[str, tuple[Fields, Callable[[DataFrame], DataFrame]]] = {
    "vagas": (vagas_fields, vagas_postings),
    "programathor": (programathor_fields, programathor_postings),
    "linkedin": (linkedin_fields, linkedin_postings),
}


def vagas_cards(pages: DataFrame, site: str = "https://www.vagas.com.br") -> DataFrame:
    return vagas_postings(cards(pages, vagas_fields), site)


def programathor_cards(pages: DataFrame, site: str = "https://programathor.com.br") -> DataFrame:
    return programathor_postings(cards(pages, programathor_fields), site)


def linkedin_cards(pages: DataFrame) -> DataFrame:
    return linkedin_postings(cards(pages, linkedin_fields))


#: Portal to the function that turns its landed table into raw postings; other portals can be added.
READERS: dict[str, Callable[[DataFrame], DataFrame]] = {"gupy": gupy_json, "vagas": vagas_cards, "programathor": programathor_cards, "trampos": trampos_json, "linkedin": linkedin_cards}


def _rank(c: str, values: list[str]) -> Column:
    place = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(c))
    return F.when(place == 0, F.lit(len(values) + 1)).otherwise(place).cast("long")


def _fitting(c: str, bits: int) -> Column:
    value = F.col(c).cast("long")
    return F.when((value < 0) | (value >= 1 << bits), F.raise_error(F.lit(f"{c} is beyond {bits} bits"))).otherwise(value)


def collect_union(landed: dict[str, DataFrame], portals: list[str] = PORTALS, terms: list[str] = SEARCH_TERMS) -> DataFrame:
    """All portals in one table, from their landed tables; portals without a reader are skipped."""
    return in_order({p: READERS[p](rows) for p, rows in landed.items() if p in READERS}, portals, terms)


def in_order(postings: dict[str, DataFrame], portals: list[str] = PORTALS, terms: list[str] = SEARCH_TERMS) -> DataFrame:
    """Raw postings of portals in one table; portals that aren't listed are skipped. ord packs portal, term, page and place: a
    total order that needs no sort, and the same in every call. A page or place beyond its bits fails."""
    if len(terms) + 1 >= 1 << TERM_BITS or len(portals) + 1 >= 1 << (63 - TERM_BITS - PAGE_BITS - PLACE_BITS):
        raise ValueError("too many portals or search terms for ord")
    rows = reduce(DataFrame.unionByName, [postings[p] for p in portals if p in postings])
    packed = _rank("source", portals)
    for value, bits in ((_rank("search_term", terms), TERM_BITS), (_fitting("page", PAGE_BITS), PAGE_BITS), (_fitting("pos", PLACE_BITS), PLACE_BITS)):
        packed = F.shiftleft(packed, bits).bitwiseOR(value)
    return rows.select(packed.alias("ord"), *RAW)

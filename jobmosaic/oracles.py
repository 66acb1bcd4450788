"""The queries again as SQL for DuckDB, written from the rules of the data and not from the Spark plans."""

from __future__ import annotations

from jobmosaic.functions.rules import COMPANY_NOISE, PORTALS, SEARCH_TERMS, WORKPLACE_ORDER, Rules
from jobmosaic.plans.adapter import REFERENCE, SNAPSHOT_FILES, adapter_sql, snapshot_sql

RULES = Rules()


def words(x: str, keep: str = "") -> str:
    return f"trim(regexp_replace(lower(strip_accents({x})), '[^a-z0-9{keep}]+', ' ', 'g'))"


def squash(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x}, ''), '[\s\p{{Z}}]+', ' ', 'g'))"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def listed(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def has(text: str, phrase: str) -> str:
    return f"contains(' ' || {text} || ' ', ' {phrase} ')"


def any_phrase(text: str, phrases) -> str:
    return f"len(list_filter({listed(dict.fromkeys(phrases))}, lambda p: contains(' ' || {text} || ' ', ' ' || p || ' '))) > 0"


def workplace(x: str) -> str:
    w = words(x)
    return f"""CASE WHEN {w} IN ('remote', 'remoto', 'home office') THEN 'Remoto' WHEN {w} IN ('hybrid', 'hibrido') THEN 'Híbrido' WHEN {w} IN ('on site', 'onsite', 'presencial') THEN 'Presencial'
  WHEN contains({w}, 'home office') OR contains({w}, 'remoto') THEN 'Remoto' WHEN contains({w}, 'hibrid') THEN 'Híbrido' WHEN contains({w}, 'presencial') THEN 'Presencial' ELSE 'Não informado' END"""


def identity(x: str) -> str:
    return f"list_sort(list_distinct(list_filter(string_split({words(x)}, ' '), lambda w: length(w) > 2 AND NOT list_contains({listed(COMPANY_NOISE)}, w))))"


def label(title: str, strict: bool = False) -> str:
    tests = " ".join(f"WHEN regexp_matches({title}, '{'|'.join(patterns)}') THEN '{name}'" for name, patterns in RULES.seniority.items())
    found = f"CASE {tests} END"
    return f"CASE WHEN NOT regexp_matches({title}, '{'|'.join(RULES.senior)}') THEN {found} END" if strict else found


def percent(n: str, t: str) -> str:
    low, rest = f"((1000 * {n}) // {t})", f"((1000 * {n}) % {t})"
    return f"(CASE WHEN {t} = 0 THEN 0.0 ELSE ({low} + CASE WHEN 2 * {rest} > {t} OR (2 * {rest} = {t} AND {low} % 2 = 1) THEN 1 ELSE 0 END) / 10.0 END)::DOUBLE"


def date_of(x: str, reference: str) -> str:
    t, low = f"trim(coalesce({x}, ''))", f"lower(trim(coalesce({x}, '')))"
    ago = r"h[aá]\s+(?:mais\s+de\s+)?(\d+)\s+"
    days, months = ago + "dias?", ago + "m[eê]s(?:es)?"
    return rf"""CASE WHEN regexp_matches({t}, '^\d{{4}}-\d{{2}}-\d{{2}}') THEN TRY_CAST(substr({t}, 1, 10) AS DATE)
  WHEN regexp_matches({t}, '^\d{{2}}/\d{{2}}/\d{{4}}$') THEN TRY_CAST(substr({t}, 7, 4) || '-' || substr({t}, 4, 2) || '-' || substr({t}, 1, 2) AS DATE)
  WHEN regexp_matches({low}, '\banteontem\b') THEN {reference} - 2 WHEN regexp_matches({low}, '\bontem\b') THEN {reference} - 1 WHEN regexp_matches({low}, '\bhoje\b') THEN {reference}
  WHEN regexp_matches({low}, '{days}') THEN {reference} - CAST(regexp_extract({low}, '{days}', 1) AS INT) WHEN regexp_matches({low}, '{months}') THEN {reference} - 30 * CAST(regexp_extract({low}, '{months}', 1) AS INT) END"""


def _scoring() -> tuple[str, str, str]:
    """Columns of title hits, of body hits, and the rows (area, score, title_score, matches) of a posting.

    A keyword is looked for after the first place of each longer keyword of its area that contains it was blanked;
    in the body only those that didn't count in the title."""
    def inside(k):
        return [j for j in RULES.keywords if j.area == k.area and (len(j.phrase), -j.rank) > (len(k.phrase), -k.rank) and f" {k.phrase} " in f" {j.phrase} "]

    number = {(k.area, k.rank): i for i, k in enumerate(RULES.keywords)}
    title, body, rows = [], [], []
    for k in RULES.keywords:
        i, text, low = number[k.area, k.rank], "(' ' || nt || ' ')", "(' ' || nb || ' ')"
        for j in inside(k):
            text = f"regexp_replace({text}, ' {j.phrase} ', ' # ')"
            low = f"CASE WHEN t{number[j.area, j.rank]} THEN {low} ELSE regexp_replace({low}, ' {j.phrase} ', ' # ') END"
        title.append(f"contains({text}, ' {k.phrase} ') AS t{i}")
        body.append(f"NOT t{i} AND contains({low}, ' {k.phrase} ') AS b{i}")
    for area in RULES.areas[:-1]:
        own = [k for k in RULES.keywords if k.area == area]
        at = [number[k.area, k.rank] for k in own]
        total = " + ".join(f"CASE WHEN t{i} THEN {3 * k.weight} WHEN b{i} THEN {k.weight} ELSE 0 END" for i, k in zip(at, own, strict=True))
        from_title = " + ".join(f"CASE WHEN t{i} THEN {3 * k.weight} ELSE 0 END" for i, k in zip(at, own, strict=True))
        names = ", ".join(f"CASE WHEN t{i} THEN '{k.keyword}(t)' WHEN b{i} THEN '{k.keyword}' END" for i, k in zip(at, own, strict=True))
        rows.append(f"{{'area': '{area}', 'score': ({total})::DOUBLE, 'title_score': ({from_title})::DOUBLE, 'matches': list_filter([{names}], lambda x: x IS NOT NULL)}}")
    return ", ".join(title), ", ".join(body), ", ".join(rows)


_TITLE, _BODY, _ROWS = _scoring()
_ALIASES = ", ".join(f"('{phrase}', '{skill}')" for phrase, skill in RULES.aliases.items())
_SKILLS = ", ".join(f"({i}, '{n}', '{g}')" for i, (n, g, _) in enumerate(RULES.skills, 1))


def classified(source: str) -> list[tuple[str, str]]:
    """CTEs that classify the rows of a CTE with ord, title, description, nt, nb; names end in the source's name."""
    s = source
    return [
        (f"t_{s}", f"SELECT ord, nt, nb, {_TITLE} FROM {s}"),
        (f"b_{s}", f"SELECT *, {_BODY} FROM t_{s}"),
        (f"scores_{s}", f"SELECT ord, unnest(list_filter([{_ROWS}], lambda r: r.score > 0)) AS r FROM b_{s}"),
        (f"best_{s}", f"SELECT ord, r, row_number() OVER (PARTITION BY ord ORDER BY r.title_score > 0 DESC, r.score DESC, r.area) AS n FROM scores_{s}"),
        (f"class_{s}", f"""SELECT x.ord, CASE WHEN r.score >= 3 THEN r.area ELSE '{RULES.fallback}' END AS area, CASE WHEN r.score >= 3 THEN r.score ELSE 0.0 END AS area_score,
          CASE WHEN r.score >= 3 THEN array_to_string(r.matches[1:12], ', ') ELSE '' END AS area_matches FROM {s} x LEFT JOIN (SELECT * FROM best_{s} WHERE n = 1) b ON b.ord = x.ord"""),
        (f"f4_{s}", f"SELECT ord, ' ' || {words("title || ' ' || description", '#+')} || ' ' AS t FROM {s}"),
        (f"skills_{s}", f"SELECT DISTINCT ord, skill FROM f4_{s}, (VALUES {_ALIASES}) a(phrase, skill) WHERE contains(t, ' ' || phrase || ' ')"),
    ]


def funnel_of(raw: str, tail: str) -> list[tuple[str, str]]:
    """CTEs of the pipeline over a raw CTE; names end in tail."""
    t = tail
    gate_title, gate_body = RULES.gate_title + RULES.strong, RULES.gate_body + RULES.strong
    family = "CASE WHEN list_contains(idn, 'minsait') THEN 'minsait' WHEN list_contains(idn, 'fei') THEN 'fei' ELSE array_to_string(idn, ' ') END"
    return [
        (f"first{t}", f"SELECT * FROM {raw} QUALIFY row_number() OVER (PARTITION BY source, external_id, search_term ORDER BY ord) = 1"),
        (f"clean{t}", f"SELECT * REPLACE ({squash('title')} AS title, {squash('company')} AS company, {squash('description')} AS description), {workplace('raw_workplace')} AS workplace_type, {words('title')} AS nt, {words('company')} AS nc, {words('description')} AS nb, {identity('company')} AS idn FROM first{t}"),
        (f"level{t}", f"SELECT * REPLACE (coalesce(nullif(seniority, ''), {label('nt')}) AS seniority) FROM clean{t} WHERE coalesce(nullif(seniority, ''), {label('nt')}) IS NOT NULL"),
        (f"r1{t}", f"SELECT *, length(description) AS size, max(length(description)) OVER (PARTITION BY source, external_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM level{t}"),
        (f"r2{t}", f"SELECT *, CASE WHEN (before IS NULL OR size > before) AND search_term <> '' THEN ord END AS rec FROM r1{t}"),
        (f"w1{t}", f"""SELECT * EXCLUDE (before, rec) REPLACE (coalesce(term, '') AS search_term) FROM (SELECT *, arg_min(search_term, rec) OVER k AS term, min(ord) OVER k AS first_ord, row_number() OVER (PARTITION BY source, external_id ORDER BY size DESC, ord) AS n
          FROM r2{t} WINDOW k AS (PARTITION BY source, external_id)) WHERE n = 1"""),
        (f"w2{t}", f"""SELECT * REPLACE (fo AS first_ord) FROM (SELECT *, min(first_ord) OVER (PARTITION BY fp) AS fo, row_number() OVER (PARTITION BY fp ORDER BY size DESC, first_ord) AS m
          FROM (SELECT *, CASE WHEN len(idn) > 0 THEN nt || '|' || nc ELSE 'ord ' || ord END AS fp FROM w1{t})) WHERE m = 1"""),
        (f"w3{t}", f"""SELECT *, min(rep_ord) OVER (PARTITION BY nt) AS title_ord FROM (SELECT *, min(first_ord) OVER (PARTITION BY nt, fam) AS rep_ord, row_number() OVER (PARTITION BY nt, fam ORDER BY size DESC, first_ord) AS q
          FROM (SELECT *, CASE WHEN len(idn) > 0 THEN {family} || regexp_extract(nc, 'g[0-9]+$') ELSE 'ord ' || ord END AS fam FROM w2{t})) WHERE q = 1"""),
        (f"gate{t}", f"SELECT *, NOT {any_phrase('nt', RULES.gate_exclude)} AND ({any_phrase('nt', gate_title)} OR {any_phrase('nb', gate_body)}) AS tech FROM w3{t}"),
        (f"kept{t}", f"SELECT * FROM gate{t} WHERE tech"),
        *classified(f"kept{t}"),
        (f"jobs{t}", f"""SELECT k.*, c.area, c.area_score, c.area_matches, coalesce(s.names, []) AS skills FROM kept{t} k JOIN class_kept{t} c USING (ord) LEFT JOIN (SELECT ord, list_sort(list(skill)) AS names FROM skills_kept{t} GROUP BY ord) s USING (ord)"""),
    ]


_KNOWN = " AND ".join(f"{strip(c)} <> ''" for c in ("source", "external_id", "title"))


def _rows_of(part: int) -> str:
    day = f"DATE '{SNAPSHOT_FILES[part][6:10]}-{SNAPSHOT_FILES[part][10:12]}-{SNAPSHOT_FILES[part][12:14]}'"
    null = lambda c: f"nullif({strip(c)}, '') AS {c}"
    known = f"(SELECT list_sort(list_distinct(list(k.nome))) FROM (SELECT unnest(string_split(skills, ',')) AS x) u JOIN tec k ON lower(trim(u.x)) = lower(k.nome))"
    return f"""SELECT ord, source, external_id, {strip('title')} AS title, coalesce(nullif(trim(area), ''), '{RULES.fallback}') AS area, {', '.join(null(c) for c in ('company', 'seniority', 'location', 'url', 'description', 'area_matches', 'search_term', 'workplace_type'))},
      {date_of('published_date', day)} AS published_date, TRY_CAST(nullif(trim(area_score), '') AS DOUBLE) AS area_score, coalesce({known}, []) AS skills FROM snap{part} WHERE {_KNOWN}"""


_COMPARED = ["title", "company", "area", "seniority", "location", "workplace_type", "published_date", "url", "description", "area_score", "area_matches", "search_term"]
_FIELDS = [*_COMPARED, "skills"]


def _imports() -> list[tuple[str, str]]:
    last = lambda n: f"SELECT *, min(ord) OVER (PARTITION BY source, external_id) AS first FROM rows{n} QUALIFY row_number() OVER (PARTITION BY source, external_id ORDER BY ord DESC) = 1"
    differs = " OR ".join(f"o.{c} IS DISTINCT FROM l.{c}" for c in _COMPARED)
    pick = ", ".join(f"CASE WHEN l.ord IS NOT NULL THEN l.{c} ELSE o.{c} END AS {c}" for c in _FIELDS)
    return [
        ("tec", f"SELECT * FROM (VALUES {_SKILLS}) t(id, nome, grupo)"),
        ("snap0", snapshot_sql("duckdb", 0)), ("snap1", snapshot_sql("duckdb", 1)),
        ("rows0", _rows_of(0)), ("rows1", _rows_of(1)), ("last0", last(0)), ("last1", last(1)),
        ("table0", f"SELECT row_number() OVER (ORDER BY first) AS id, source, external_id, {', '.join(_FIELDS)}, '2026-08-01 00:00:00' AS created_at, '2026-08-01 00:00:00' AS updated_at FROM last0"),
        ("vagas", f"""SELECT coalesce(o.id, (SELECT max(id) FROM table0) + row_number() OVER (PARTITION BY o.id IS NULL ORDER BY l.first)) AS id, coalesce(o.source, l.source) AS source, coalesce(o.external_id, l.external_id) AS external_id, {pick},
          coalesce(o.created_at, '2026-08-16 00:00:00') AS created_at, CASE WHEN o.id IS NULL OR (l.ord IS NOT NULL AND ({differs})) THEN '2026-08-16 00:00:00' ELSE o.updated_at END AS updated_at
          FROM table0 o FULL JOIN last1 l ON o.source = l.source AND o.external_id = l.external_id"""),
        ("links", "SELECT DISTINCT v.id AS vaga_id, k.id::BIGINT AS tecnologia_id FROM (SELECT id, unnest(skills) AS s FROM vagas) v JOIN tec k ON lower(v.s) = lower(k.nome)"),
        ("tcounts", "SELECT k.nome, k.grupo, count(l.vaga_id) AS vagas FROM tec k LEFT JOIN links l ON l.tecnologia_id = k.id GROUP BY ALL"),
        ("acounts", f"SELECT coalesce(a.nome, c.area) AS nome, coalesce(c.n, 0) AS vagas, {percent('coalesce(c.n, 0)', '(SELECT count(*) FROM vagas)')} AS percentual FROM (SELECT unnest({listed(RULES.areas)}) AS nome) a FULL JOIN (SELECT area, count(*) AS n FROM vagas GROUP BY area) c ON a.nome = c.area"),
    ]


_MAIN = [("raw", adapter_sql("duckdb")), *funnel_of("raw", "")]
_CLEAN = [*_MAIN[:3], *classified("clean")]
_DRIFT = [("raw", adapter_sql("duckdb")), ("raw_a", "SELECT * FROM raw WHERE ord % 3 <> 0"), ("raw_b", "SELECT * FROM raw WHERE ord % 3 <> 2"), *funnel_of("raw_a", "_a"), *funnel_of("raw_b", "_b")]
_IMPORT = _imports()


def sql(ctes: list[tuple[str, str]], final: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in ctes) + f"\n{final}"


_ANY = f"SELECT area, count(*) AS vagas FROM jobs GROUP BY area"
_RANK = f"SELECT row_number() OVER (ORDER BY vagas DESC, area) AS posicao, area, vagas, {percent('vagas', '(sum(vagas) OVER ())::BIGINT')} AS percentual FROM ({_ANY})"
_MODE = "coalesce(nullif(trim(workplace_type), ''), 'Não informado')"
_MODES = f"SELECT row_number() OVER (ORDER BY coalesce(nullif(list_position({listed(WORKPLACE_ORDER)}, modalidade), 0), 99), modalidade) AS posicao, modalidade, vagas, {percent('vagas', '(sum(vagas) OVER ())::BIGINT')} AS percentual FROM (SELECT {_MODE} AS modalidade, count(*) AS vagas FROM jobs GROUP BY 1)"
_MENTIONS = "SELECT area, unnest(skills) AS tecnologia FROM jobs"
_BY_AREA = f"SELECT area, row_number() OVER (PARTITION BY area ORDER BY vagas DESC, tecnologia) AS posicao, tecnologia, vagas FROM (SELECT area, tecnologia, count(*) AS vagas FROM ({_MENTIONS}) GROUP BY ALL)"
_BASE = "SELECT area, count(*) FILTER (len(skills) > 0) AS base, count(*) AS vagas FROM jobs GROUP BY area HAVING base > 0"
_SLIM = "SELECT id, source, external_id, title, CAST(published_date AS VARCHAR) AS published_date FROM vagas"
_BOTH = f"(SELECT *, '{SNAPSHOT_FILES[0]}' AS file_name FROM snap0 UNION ALL SELECT *, '{SNAPSHOT_FILES[1]}' FROM snap1)"
_LONG = """CASE WHEN ord % 19 = 3 THEN '"a' || chr(10) || description || chr(10) || chr(10) || '"b, c' ELSE description END"""
_HELD = "SELECT id, source, external_id, title, company, area, location, CAST(published_date AS VARCHAR) AS published_date, area_score, coalesce(array_to_string(skills, ', '), '') AS skills"
_TIDY = {c: f"coalesce({c}, '') AS {c}" for c in ("source", "external_id", "area", "seniority", "title", "company", "skills", "area_matches", "search_term")}

_WORDED = "(SELECT * REPLACE (" + ", ".join(f"CASE WHEN ord % 2 = 1 THEN {c} || ' ' || description ELSE {c} END AS {c}" for c in ("title", "company", "search_term", "raw_workplace")) + ") FROM raw)"
_raw = lambda f: sql(_MAIN[:1], f)
_jobs = lambda f: sql(_MAIN, f)
_clean = lambda f: sql(_CLEAN, f)
_imp = lambda f: sql(_IMPORT, f)

ORACLE_SQL = {
    "squash_ws": f"SELECT doc_id, md5({squash('text')}) AS value FROM documents",
    "normalize": f"SELECT doc_id, md5({words("coalesce(text, '')")}) AS value FROM documents",
    "normalize_tech": f"SELECT doc_id, md5({words("coalesce(text, '')", '#+')}) AS value FROM documents",
    "strip_html": "SELECT page_id, md5(" + squash("replace(replace(replace(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g'), '&quot;?', '\"', 'g'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')") + ") AS value FROM pages",
    "normalize_workplace": _raw(f"SELECT ord, {workplace('raw_workplace')} AS value FROM {_WORDED}"),
    "fingerprint": _raw(f"SELECT ord, sha1({words('title')} || '|' || {words('company')}) AS value FROM {_WORDED}"),
    "source_key": _raw("SELECT ord, source || ':' || external_id AS value FROM raw"),
    "searchable_text": _raw(f"SELECT ord, md5({words("title || ' ' || description")}) AS value FROM raw"),
    "slugify_term": _raw(f"SELECT ord, replace({words('search_term')}, ' ', '-') AS value FROM {_WORDED}"),
    "company_identity": _raw(f"SELECT ord, array_to_string({identity('company')}, ' ') AS value FROM {_WORDED}"),
    "parse_published_date": _raw(f"SELECT ord, CAST({date_of('published_date', f"DATE '{REFERENCE}'")} AS VARCHAR) AS value FROM raw"),
    "seniority_label": _raw(f"SELECT ord, {label(words('title'))} AS label, {label(words('title'), True)} AS strict FROM {_WORDED}"),
    "extract_skills": sql([*_MAIN[:1], *classified("raw")[-2:]], "SELECT r.ord, coalesce(s.names, '') AS skills FROM raw r LEFT JOIN (SELECT ord, array_to_string(list_sort(list(skill)), ', ') AS names FROM skills_raw GROUP BY ord) s USING (ord)"),
    "term_first_seen": sql(_MAIN[:2], "SELECT ord, source, search_term, external_id FROM first"),
    "term_yield": sql(_MAIN[:2], "SELECT source, search_term, count(*) AS vagas FROM first GROUP BY ALL"),
    "entry_level": _jobs("SELECT ord, seniority FROM level"),
    "entry_level_strict": _clean(f"SELECT ord, coalesce(nullif(seniority, ''), {label('nt', True)}) AS seniority FROM clean WHERE coalesce(nullif(seniority, ''), {label('nt', True)}) IS NOT NULL"),
    "all_levels": _clean("SELECT ord, coalesce(nullif(seniority, ''), 'Não filtrado') AS seniority FROM clean"),
    "is_tech": _clean(f"SELECT ord, NOT {any_phrase('nt', RULES.gate_exclude)} AND ({any_phrase('nt', RULES.gate_title + RULES.strong)} OR {any_phrase('nb', RULES.gate_body + RULES.strong)}) AS tech FROM clean"),
    "keyword_hits": _clean(f"SELECT DISTINCT ord, area, keyword, contains(' ' || nt || ' ', ' ' || phrase || ' ') AS in_title, contains(' ' || nb || ' ', ' ' || phrase || ' ') AS in_body FROM clean, (VALUES {', '.join(f"('{k.area}', '{k.keyword}', '{k.phrase}')" for k in RULES.keywords)}) k(area, keyword, phrase) WHERE in_title OR in_body"),
    "score_areas": _clean("SELECT ord, r.area AS area, r.score AS score, r.title_score AS title_score, array_to_string(r.matches, ', ') AS matches FROM scores_clean"),
    "classify": _clean("SELECT ord, area, area_score, area_matches FROM class_clean"),
    "dedupe_source_key": _jobs("SELECT ord, first_ord, source, external_id, search_term FROM w1"),
    "stream_source_keys": _jobs("SELECT ord, first_ord, source, external_id, search_term FROM w1"),
    "dedupe_fingerprint": _jobs("SELECT ord, first_ord, search_term FROM w2"),
    "dedupe_full": _jobs("SELECT ord, first_ord, rep_ord, title_ord FROM w3"),
    "same_company_pairs": _jobs("SELECT a.ord AS ord_a, b.ord AS ord_b FROM level a JOIN level b ON a.nt = b.nt AND a.ord < b.ord WHERE len(a.idn) > 0 AND len(b.idn) > 0 AND (list_has_all(a.idn, b.idn) OR list_has_all(b.idn, a.idn))"),
    "same_company_classes": _jobs("SELECT ord, min(ord) OVER w AS node, count(*) OVER w AS same, partners FROM (SELECT a.ord, any_value(a.nt) AS nt, any_value(a.idn) AS idn, count(b.ord) AS partners FROM level a LEFT JOIN level b ON a.nt = b.nt AND a.ord <> b.ord AND len(b.idn) > 0 AND (list_has_all(a.idn, b.idn) OR list_has_all(b.idn, a.idn)) WHERE len(a.idn) > 0 GROUP BY a.ord) WINDOW w AS (PARTITION BY nt, idn)"),
    "tech_split": _jobs("SELECT ord, CASE WHEN tech THEN 'tech' ELSE 'nao_tech' END AS lado FROM gate"),
    "pipeline_jobs": _jobs("SELECT ord, source, external_id, seniority, search_term, area, area_score, area_matches, array_to_string(skills, ', ') AS skills, rep_ord, title_ord FROM jobs"),
    "area_ranking": _jobs(_RANK),
    "rank_position": _jobs(f"SELECT area, vagas, posicao FROM ({_RANK})"),
    "workplace_ranking": _jobs(_MODES),
    "workplace_by_area": _jobs(f"SELECT j.area, count(*) FILTER (workplace_type = 'Remoto') AS remoto, count(*) FILTER (workplace_type = 'Híbrido') AS hibrido, count(*) FILTER (workplace_type = 'Presencial') AS presencial, count(*) FILTER (workplace_type = 'Não informado') AS nao_informado, any_value(r.posicao) AS posicao FROM jobs j JOIN ({_RANK}) r ON r.area = j.area GROUP BY j.area"),
    "seniority_counts": _jobs("SELECT seniority, count(*) AS vagas FROM jobs GROUP BY ALL"),
    "source_counts": _jobs("SELECT source, count(*) AS vagas FROM jobs GROUP BY ALL"),
    "top_companies": _jobs("SELECT row_number() OVER (ORDER BY vagas DESC, company) AS posicao, company, vagas FROM (SELECT company, count(*) AS vagas FROM jobs WHERE trim(company) <> '' GROUP BY ALL) QUALIFY posicao <= 15"),
    "overall_skills": _jobs(f"SELECT row_number() OVER (ORDER BY vagas DESC, tecnologia) AS posicao, tecnologia, vagas FROM (SELECT tecnologia, count(*) AS vagas FROM ({_MENTIONS}) GROUP BY ALL) QUALIFY posicao <= 20"),
    "skills_by_area": _jobs(f"SELECT * FROM ({_BY_AREA}) WHERE posicao <= 8"),
    "topn_per_group": _jobs(f"SELECT * FROM ({_BY_AREA}) WHERE posicao <= 3"),
    "skill_base_by_area": _jobs(_BASE),
    "skill_share_by_area": _jobs(f"SELECT s.area, s.posicao, s.tecnologia, s.vagas, b.base, b.vagas AS vagas_area, {percent('s.vagas', 'b.base')} AS percentual FROM ({_BY_AREA}) s JOIN (SELECT * FROM ({_BASE}) WHERE base >= 6 ORDER BY base DESC, area LIMIT 8) b ON s.area = b.area WHERE s.posicao <= 8"),
    "sample_per_area": _jobs(f"SELECT r.posicao, j.area, j.n, j.ord, j.title FROM (SELECT *, row_number() OVER (PARTITION BY area ORDER BY title_ord, rep_ord) AS n FROM (SELECT * EXCLUDE (n) FROM jobs)) j JOIN ({_RANK}) r ON r.area = j.area WHERE j.n <= 5"),
    "workplace_informed_share": _jobs(f"SELECT modalidade, vagas, percentual, CASE WHEN modalidade <> 'Não informado' THEN {percent('vagas', "(sum(vagas) FILTER (modalidade <> 'Não informado') OVER ())::BIGINT")} END AS percentual_informado FROM ({_MODES})"),
    "fallback_share_by_source": _jobs(f"SELECT source, outros, vagas, {percent('outros', 'vagas')} AS percentual FROM (SELECT source, count(*) FILTER (area = '{RULES.fallback}') AS outros, count(*) AS vagas FROM jobs GROUP BY ALL)"),
    "best_area": _jobs("SELECT ord, area, area_score FROM jobs"),
    "to_row": _jobs("SELECT source, external_id, area, title, array_to_string(skills, ', ') AS skills, length(substr(description, 1, 500)) AS size FROM jobs"),
    "funnel": _jobs("SELECT unnest(['brutas', 'senioridade', 'duplicadas', 'nao_tech', 'mantidas']) AS etapa, unnest([a, a - l, l - w, w - k, k]) AS vagas FROM (SELECT (SELECT count(*) FROM first) AS a, (SELECT count(*) FROM level) AS l, (SELECT count(*) FROM w3) AS w, (SELECT count(*) FROM kept) AS k)"),
    "snapshot_drift": sql(_DRIFT, f"SELECT coalesce(a.area, b.area) AS area, coalesce(a.vagas, 0) AS vagas_agora, coalesce(a.percentual, 0) AS percentual_agora, coalesce(b.vagas, 0) AS vagas_antes, coalesce(b.percentual, 0) AS percentual_antes FROM ({_RANK.replace('FROM jobs', 'FROM jobs_a')}) a FULL JOIN ({_RANK.replace('FROM jobs', 'FROM jobs_b')}) b ON a.area = b.area"),
    "export_jobs": _jobs(f"SELECT {', '.join(_TIDY[c] for c in _TIDY if c != 'skills')}, array_to_string(skills, ', ') AS skills, area_score, md5(substr(description, 1, 500)) AS description FROM jobs"),
    "sorted_export": _jobs("SELECT area, row_number() OVER (PARTITION BY area ORDER BY title, ord) AS posicao, title FROM jobs"),
    "export_ranking": _jobs(_RANK),
    "export_skills": _jobs(f"SELECT * FROM ({_BY_AREA}) WHERE posicao <= 15"),
    "read_snapshot": _imp(f"SELECT source, external_id, title, area, skills, area_score, published_date, url, md5({_LONG}) AS description, file_name FROM {_BOTH} WHERE {_KNOWN}"),
    "latest_snapshot": _imp(f"SELECT source, external_id, title, area, skills, area_score, published_date, url, md5({_LONG}) AS description, file_name FROM {_BOTH} WHERE {_KNOWN} AND file_name = '{SNAPSHOT_FILES[1]}'"),
    "reference_date": _imp(f"SELECT ord, file_name, CASE WHEN file_name = '{SNAPSHOT_FILES[0]}' THEN '2026-07-31' ELSE '2026-08-15' END AS value, '{REFERENCE}' AS given FROM {_BOTH}"),
    "float_or_null": _imp(f"SELECT ord, file_name, TRY_CAST(nullif(trim(area_score), '') AS DOUBLE) AS value FROM {_BOTH}"),
    "blank_to_null": _imp(f"SELECT ord, file_name, nullif(trim(area), '') AS area, nullif(trim(company), '') AS company, nullif(trim(seniority), '') AS seniority FROM {_BOTH}"),
    "parse_skills_list": _imp(f"SELECT b.ord, b.file_name, coalesce(array_to_string(list_sort(list(DISTINCT k.nome) FILTER (k.nome IS NOT NULL)), ', '), '') AS value FROM (SELECT ord, file_name, unnest(string_split(skills, ',')) AS x FROM {_BOTH}) b LEFT JOIN tec k ON lower(trim(b.x)) = lower(k.nome) GROUP BY b.ord, b.file_name"),
    "upsert_vagas": _imp("SELECT id, source, external_id, title, company, area, seniority, location, workplace_type, CAST(published_date AS VARCHAR) AS published_date, url, area_score, search_term, coalesce(array_to_string(skills, ', '), '') AS skills, created_at, updated_at FROM vagas"),
    "upsert_counters": _imp("SELECT c AS criadas, r - c AS atualizadas, s AS sem_data, t AS total FROM (SELECT (SELECT count(*) FROM vagas WHERE created_at = '2026-08-16 00:00:00') AS c, (SELECT count(*) FROM rows1) AS r, (SELECT count(*) FROM rows1 WHERE published_date IS NULL) AS s, (SELECT count(*) FROM vagas) AS t)"),
    "seed_tecnologias": _imp("""SELECT coalesce(o.id, 900 + row_number() OVER (PARTITION BY o.id IS NULL ORDER BY k.id)) AS id, coalesce(o.nome, k.nome) AS nome, coalesce(k.grupo, o.grupo) AS grupo
      FROM (SELECT row_number() OVER (ORDER BY nome) AS id, nome, 'velho' AS grupo FROM (SELECT DISTINCT unnest(skills) AS nome FROM vagas) UNION ALL SELECT 900, 'COBOL', 'velho') o FULL JOIN tec k ON k.nome = o.nome"""),
    "link_tecnologias": _imp("SELECT vaga_id, tecnologia_id FROM links"),
    "vagas_with_tech": _imp("SELECT id, external_id FROM vagas WHERE list_contains(skills, 'SQL')"),
    "list_vagas": _imp(f"{_SLIM} WHERE area = 'Data' AND source = 'gupy' AND title ILIKE '%jr%'"),
    "search_vagas": _imp(f"{_SLIM} WHERE source = 'gupy' AND title ILIKE '%mobile%j_nior%'"),
    "check_vocab": _imp(f"{_SLIM} WHERE list_contains(skills, 'Python') AND title ILIKE '%des_nv%%'"),
    "page_vagas": _imp(f"{_SLIM} ORDER BY vagas.published_date DESC NULLS LAST, id LIMIT 50 OFFSET 10"),
    "list_page": _imp(f"SELECT *, (SELECT count(*) FROM vagas WHERE title ILIKE '%jr%') AS total FROM ({_SLIM} WHERE title ILIKE '%jr%' ORDER BY vagas.published_date DESC NULLS LAST, id LIMIT 20 OFFSET 5)"),
    "stream_import": _imp(f"{_HELD}, md5(description) AS description FROM vagas"),
    "import_files": sql([(n, q.replace("substr(description, 1, 500) AS description", f"{_LONG.replace('description', 'substr(description, 1, 500)')} AS description") if n in ("snap0", "snap1") else q) for n, q in _IMPORT], f"{_HELD}, md5(description) AS description FROM vagas"),
    "filtered_total": _imp("SELECT count(*) AS total FROM vagas WHERE area = 'Backend'"),
    "table_health": _imp("SELECT count(*) AS total FROM vagas"),
    "get_vaga": _imp(f"{_SLIM} WHERE id = 7"),
    "vaga_resumo": _imp("SELECT id, title, company, area, url, coalesce(array_to_string(skills, ', '), '') AS skills FROM vagas"),
    "area_counts_vocab": _imp("SELECT * FROM acounts"),
    "count_by_area": _imp("SELECT * FROM acounts ORDER BY vagas DESC, nome"),
    "get_area": _imp("SELECT * FROM acounts WHERE lower(nome) = 'data'"),
    "tech_counts_vocab": _imp("SELECT * FROM tcounts"),
    "count_by_tecnologia": _imp("SELECT * FROM tcounts ORDER BY vagas DESC, nome"),
    "vocab_sort": _imp("SELECT * FROM tcounts ORDER BY vagas DESC, nome LIMIT 10"),
    "get_tecnologia": _imp("SELECT * FROM tcounts WHERE lower(nome) = 'python'"),
    "tech_filters": _imp("SELECT * FROM tcounts WHERE grupo = 'linguagens' AND vagas > 0"),
}


#: Of each ranking, the columns that all_rankings has as posicao, grupo, nome, vagas and valor.
_TOLD = {
    "area_ranking": "posicao, NULL, area, vagas, percentual", "workplace_ranking": "posicao, NULL, modalidade, vagas, percentual", "workplace_informed_share": "NULL, NULL, modalidade, vagas, percentual_informado",
    "workplace_by_area": "posicao, NULL, area, remoto, hibrido", "seniority_counts": "NULL, NULL, seniority, vagas, NULL", "source_counts": "NULL, NULL, source, vagas, NULL", "fallback_share_by_source": "NULL, NULL, source, outros, percentual",
    "top_companies": "posicao, NULL, company, vagas, NULL", "overall_skills": "posicao, NULL, tecnologia, vagas, NULL", "skills_by_area": "posicao, area, tecnologia, vagas, NULL", "skill_base_by_area": "NULL, NULL, area, vagas, base",
    "skill_share_by_area": "posicao, area, tecnologia, vagas, percentual",
}
_HEAD = len(_jobs(""))
ORACLE_SQL["all_rankings"] = _jobs(
    "SELECT ranking, posicao::BIGINT AS posicao, grupo::VARCHAR AS grupo, nome::VARCHAR AS nome, vagas::BIGINT AS vagas, valor::DOUBLE AS valor FROM ("
    + " UNION ALL ".join(f"SELECT '{k}', {v} FROM ({ORACLE_SQL[k][_HEAD:]})" for k, v in _TOLD.items())
    + ") t(ranking, posicao, grupo, nome, vagas, valor)"
)


def _landed(source: str, when: str, **fields: str) -> str:
    """The fields of the records that were landed for each page id; when: which of them stay."""
    term = "CASE i % 2 WHEN 0 THEN 'estagio ti' ELSE 'qa junior' END"
    columns = {"location": "''", "published_date": "''", "seniority": "''", "search_term": term} | fields
    return f"SELECT '{source}' AS source, " + ", ".join(f"{v} AS {k}" for k, v in columns.items()) + f" FROM (SELECT page_id AS i, coalesce(url, '') AS own_url, coalesce(html, '') AS own_html, regexp_extract(coalesce(html, ''), '<title>([^<]*)', 1) AS own_title FROM pages) WHERE {when}"


_PLACE = "CASE WHEN i % 4 = 0 THEN '' ELSE 'Cidade  ' || (i % 7) END"
_NAMES = r"""regexp_extract_all(own_html, '<li><a href="[^"]*">([^<]*)</a>', 1)"""
_TAGS = f"CASE WHEN list_aggregate({_NAMES}, 'string_agg', '') <> '' OR len({_NAMES}) > 1 THEN 'Tecnologias: ' || array_to_string(list_transform({_NAMES}, lambda x: {squash('x')}), ', ') || '. ' ELSE '' END"
_PORTAL_SQL = {
    "gupy_json": _landed("gupy", "i % 11 <> 5 AND i % 13 <> 7 AND i % 17 <> 9", external_id="i::VARCHAR", title="'Vaga ' || i || ' ' || own_title", company="'Empresa ' || (i % 5)", url="CASE WHEN i % 2 = 0 AND own_url <> '' THEN own_url ELSE 'https://c.example' END", description="own_html",
        location=f"CASE WHEN i % 4 = 0 THEN 'Brasil' WHEN i % 4 = 1 THEN {_PLACE} ELSE {_PLACE} || ', SP' END", workplace_type="CASE WHEN i % 5 = 0 THEN 'Híbrido' WHEN i % 3 = 0 THEN 'Remoto' ELSE 'Não informado' END", published_date="'2026-07-20'"),
    "trampos_json": _landed("trampos", "i % 11 <> 5 AND i % 13 <> 7 AND i % 17 <> 9", external_id="i::VARCHAR", title=strip("'Vaga ' || i || ' ' || own_title"), company="CASE WHEN i % 6 = 0 THEN 'Própria' ELSE 'Casa ' || (i % 9) END",
        url="CASE i % 7 WHEN 0 THEN 'https://t.example/o/' || i WHEN 1 THEN 'https://w.example/o/' || i ELSE 'https://trampos.co/oportunidades/' || i END", description="CASE WHEN own_url = '' THEN '' ELSE 'Categoria: ' || own_url || '.' END || CASE WHEN i % 3 = 0 THEN '' ELSE ' Tipo: Tipo A.' END || CASE WHEN i % 4 >= 2 THEN ' Salário: R$ 2.000.' ELSE '' END",
        workplace_type="CASE WHEN i % 5 = 0 THEN 'Remoto' WHEN i % 3 = 1 THEN 'Híbrido' ELSE 'Presencial' END", published_date="'2026-07-21'", seniority="CASE WHEN i % 2 = 0 THEN 'Estágio' ELSE '' END"),
    "vagas_cards": _landed("vagas", "i % 11 <> 5 AND i % 23 <> 6", external_id="i::VARCHAR", title="CASE WHEN i % 3 = 0 THEN 'Vaga & ' || i || ' ' || own_title ELSE " + squash("'Dev de Software ' || own_title") + " END", company="'Casa ' || (i % 9)", url="CASE WHEN i % 2 = 0 THEN 'https://www.vagas.com.br' ELSE 'https://x.example' END || '/vagas/v' || i", description=squash("'Texto: a ' || own_html"),
        location="CASE WHEN i % 4 = 0 THEN '100% Home Office' ELSE 'Rio / RJ' END", workplace_type="CASE WHEN i % 4 = 0 THEN 'Remoto' ELSE 'Não informado' END", published_date="'09/07/2026'"),
    "programathor_cards": _landed("programathor", "i % 5 <> 2 AND i % 23 <> 6", external_id="i::VARCHAR", title=squash("'Programador ' || i || ' ' || own_title"), company="'Casa ' || (i % 9)", url="'https://programathor.com.br/jobs/' || i || '-dev'",
        description=_TAGS + " || 'Contrato: ' || CASE WHEN i % 6 = 0 THEN 'Estágio' ELSE 'PJ' END || '.' || CASE WHEN i % 3 = 0 THEN ' Faixa salarial: Até R$4.000.' ELSE '' END",
        location="(['São Paulo', '', 'Recife', ''])[i % 4 + 1]", workplace_type="(['Híbrido', 'Remoto', '', ''])[i % 4 + 1]", seniority="CASE WHEN i % 6 = 0 THEN 'Estágio' ELSE 'Júnior' END"),
    "linkedin_cards": _landed("linkedin", "i % 11 <> 5 AND i % 13 <> 7 AND i % 23 <> 6", external_id="i::VARCHAR", title=squash("'Dev <' || i || '> ' || own_title"), company="'Casa ' || (i % 9)", url="split_part(own_url || '?', '?', 1)", description="''",
        location="CASE WHEN i % 4 = 0 THEN 'Brasil (Remote)' ELSE 'São Paulo' END", workplace_type="CASE WHEN i % 4 = 0 THEN 'Remoto' ELSE 'Não informado' END", published_date="'2026-08-01'"),
}
ORACLE_SQL |= _PORTAL_SQL

_IN_ORDER = ["gupy_json", "vagas_cards", "programathor_cards", "trampos_json", "linkedin_cards"]
_PACKED = f"((((list_position({listed(PORTALS)}, source)::BIGINT << 12) | list_position({listed(SEARCH_TERMS)}, search_term)) << 31 | CASE WHEN source IN ('gupy', 'trampos') THEN external_id::BIGINT // 20 ELSE external_id::BIGINT END) << 16) | CASE WHEN source IN ('gupy', 'trampos') THEN external_id::BIGINT % 20 ELSE 0 END"
ORACLE_SQL["collect_union"] = f"SELECT {_PACKED} AS ord, * FROM (" + " UNION ALL BY NAME ".join(f"({_PORTAL_SQL[k]})" for k in _IN_ORDER) + ")"
ORACLE_SQL["landed_files"] = ORACLE_SQL["collect_union"]

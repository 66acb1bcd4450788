import html
import html.entities
import random
import re

from pyspark.sql import functions as F

from jobmosaic.functions import text as T
from jobmosaic.functions.rules import Rules, plain


def values(spark, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, t string").orderBy("i").select(*columns).collect()]


def test_rule_tables():
    rules = Rules()
    assert (len(rules.keywords), len(rules.gate_title), len(rules.gate_exclude), len(rules.gate_body)) == (210, 30, 34, 11)
    assert (len(rules.skills), sum(len(a) for _, _, a in rules.skills), len(rules.aliases), len(rules.areas)) == (114, 200, 200, 10)


def test_folding_of_every_code_point(spark):
    points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    far = F.col("id") - 0x10000
    pair = F.concat(F.hex(F.shiftright(far, 10) + 0xD800), F.hex(far.bitwiseAND(F.lit(0x3FF)) + 0xDC00))
    code = F.decode(F.unhex(F.when(F.col("id") < 0x10000, F.lpad(F.hex("id"), 4, "0")).otherwise(pair)), "UTF-16BE")
    df = spark.range(0, 0x110000, 1, 8).filter("id < 55296 or id >= 57344").select(F.concat(F.lit("x"), code, F.lit("Y")).alias("t"))
    seen = 0
    for r in df.select("t", T.normalize("t").alias("a"), T.normalize_tech("t").alias("b"), T.without_marks(T.normalize_tech("t")).alias("d"), T.squash_ws("t").alias("c")).toLocalIterator():
        seen += 1
        assert (r.a, r.b, r.d, r.c) == (plain(r.t), plain(r.t, "#+"), plain(r.t), re.sub(r"\s+", " ", r.t).strip()), repr(r.t)
    assert seen == len(points)


def test_goldens(spark):
    got = values(spark, ["Desenvolvedor Júnior (Back-End)", "CI/CD", None, "C# e C++", "Node.js", "ﬁ ½"], T.normalize("t"), T.normalize_tech("t"))
    assert got == [("desenvolvedor junior back end",) * 2, ("ci cd",) * 2, ("", ""), ("c e c", "c# e c++"), ("node js",) * 2, ("fi 1 2",) * 2]


def test_texts_of_many_letters_and_no_class_that_is_slow(spark):
    """More different letters than are replaced one by one, and fewer; Java takes several times as long for a class with ^."""
    single, _, several = T.folding()
    rows = [f"aB {letters} Zé" for letters in (single, "".join(several), single[26 : 26 + T.MOST_LETTERS], single[-9:] + "ﬁ½" + "日本", "日本语" * 50)]
    got = values(spark, rows, T.normalize("t"), T.normalize_tech("t"))
    assert got == [(plain(r), plain(r, "#+")) for r in rows]
    with_classes = spark.createDataFrame([("x",)], "t string").select(T.normalize("t"), T.normalize_tech("t"))
    assert "[^a-z0-9" not in with_classes._jdf.queryExecution().analyzed().toString()


def test_words_and_marks_in_any_mix(spark):
    rng = random.Random(2)
    rows = ["".join(rng.choice("aB1é#+ \t-ﬁ") for _ in range(rng.randrange(12))) for _ in range(2000)]
    got = values(spark, rows, T.normalize("t"), T.normalize_tech("t"), T.without_marks(T.normalize_tech("t")), T.squash_ws("t"))
    assert got == [(plain(r), plain(r, "#+"), plain(r), re.sub(r"\s+", " ", r).strip()) for r in rows]


def test_entities_as_python_decodes_them(spark):
    names = sorted(html.entities.html5)
    numbers = [0, 1, 8, 9, 10, 11, 12, 13, 14, 31, 32, 65, 126, 127, 128, 129, 141, 150, 159, 160, 255, 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDCF, 0xFDD0, 0xFDEF, 0xFDF0, 0xFFFD, 0xFFFE, 0xFFFF, 0x10000, 0x1F600, 0x1FFFE, 0x2FFFF, 0x10FFFD, 0x10FFFE, 0x10FFFF, 0x110000, 10**9, 10**30]
    rows = [f"&{n}" for n in names] + [f"a&{n.rstrip(';')}x y" for n in names] + [f"{w}{n:{k}}{e}z" for n in numbers for w, k in (("&#", "d"), ("&#x", "x"), ("&#X", "X"), ("&#000", "d")) for e in ("", ";")]
    rows += ["&", "&&", "&;", "&#;", "&#x;", "&#xg;", "&amp;lt;", "&ampamp;", "& amp;", "&notit;", "&notin;", "&no", "a&b&c;d", "&#65&#66;&lt", "&\U0001f600;", "&" + "a" * 40 + ";", "&amp" + "b" * 40, None, "", "none", "&am\np;", "&#1114112;", "&g", "&gt", "&lt=3&gt;"]
    got = [r[0] for r in values(spark, rows, T.unescape("t"))]
    assert [(r, g) for r, g in zip(rows, got, strict=True) if g != (None if r is None else html.unescape(r))] == []


def test_strip_html(spark):
    rows = ["<p>Vaga  J&uacute;nior</p>", "&lt;b&gt; a", None, "", "x &amp y &notit; &#65;", "a<br>b"]
    want = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", r or "")).split()) for r in rows]
    assert [r[0] for r in values(spark, rows, T.strip_html("t"))] == want


def test_workplace(spark):
    rows = ["remote", "hybrid", "on-site", "100% Home Office", "", None, "qualquer coisa", "100% remote", "Presencial - SP", "Modelo híbrido"]
    want = ["Remoto", "Híbrido", "Presencial", "Remoto", "Não informado", "Não informado", "Não informado", "Não informado", "Presencial", "Híbrido"]
    assert [r[0] for r in values(spark, rows, T.normalize_workplace("t"))] == want


def test_identity_and_slug(spark):
    rows = ["ACME Soluções em Tecnologia LTDA", "Confidencial", "XP", "Minsait an Indra Company", None]
    assert [r[0] for r in values(spark, rows, F.array_join(T.company_identity("t"), " "))] == ["acme", "", "", "indra minsait", ""]
    assert values(spark, ["Estágio  TI"], T.slugify_term("t")) == [("estagio-ti",)]


def test_phrase_hits_against_search(spark):
    rng = random.Random(1)
    words = ["a", "b", "react", "native", "c"]
    phrases = ["a", "a b", "react", "react native", "native c", "b a b", "zz"]
    rows = [" ".join(rng.choice(words) for _ in range(rng.randrange(12))) for _ in range(300)]
    got = values(spark, rows, F.array_sort(T.phrase_hits("t", phrases)))
    assert [r[0] for r in got] == [sorted(p for p in phrases if f" {p} " in f" {t} ") for t in rows]

import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidentia.functions import identity as ident
from evidentia.functions import text as tx


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_fold_matches_python(spark):
    words = ["Citação", "SENTENÇA", "ß Æ ñ Ü", "İstanbul", "école", "naïve 12", ""]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", tx.fold("w").alias("f")).collect()
    for r in rows:
        want = "".join(c for c in unicodedata.normalize("NFD", r.w) if not "̀" <= c <= "ͯ").lower()
        assert r.f == want


@settings(max_examples=20, deadline=None)
@given(st.text(alphabet=st.sampled_from("aé ÇÃ1-./ñÖ\t"), max_size=30))
def test_tokens_model(spark, s):
    import re

    got = one(spark, tx.tokens(F.lit(s)))[0]
    assert got == re.findall(r"[^\W_]+", tx.python_fold(s))


def test_quality_cases(spark):
    good = "Este e um paragrafo normal com varias palavras e datas como 01/02/2024 e texto suficiente para leitura."
    cases = {"good": good, "garbage": "abcdefghij" * 9, "empty": "", "poor": "\\uFFFD\\u0000 ### @@ duas palavras", "null": None}
    df = spark.createDataFrame(list(cases.items()), "k string, t string").select("k", tx.text_quality("t").alias("q"))
    got = {r.k: r.q for r in df.collect()}
    assert not got["good"].needs_enrichment and got["good"].score == 1.0
    assert all(got[k].needs_enrichment for k in ("garbage", "empty", "poor", "null"))
    assert "low_space_ratio" in got["garbage"].reasons and "too_few_useful_chars" in got["empty"].reasons
    assert "gibberish_ratio_high" in got["poor"].reasons


def test_a_long_link_does_not_condemn_a_good_page(spark):
    text = "palavra " * 60 + "https://pje.example/" + "x" * 90
    assert not one(spark, tx.text_quality(F.lit(text)).alias("q")).q.needs_enrichment


def test_yield_and_excerpt(spark):
    stamp = "Num. 123 - Pág. 4 Assinado eletronicamente por: MARIA - 01/02/2024 10:11:12"
    r = one(spark, tx.page_yield(F.lit(stamp)).alias("a"), tx.page_yield(F.lit("curto")).alias("b"), tx.dense_excerpt(F.lit(stamp + " " + "conteudo da pagina " * 5)).alias("e"))
    assert r.a["yield"] == "stamp_only" and r.b["yield"] == "content" and r.e.startswith("conteudo")


def test_personal_data_order_and_names(spark):
    text = "Autos 0001234-56.2024.8.26.0001 CNPJ 12.345.678/0001-90 CPF 123.456.789-09 a.b@c.com José Sá e JOSE SA, JOÃO"
    r = one(spark, tx.strip_personal(F.lit(text), ["José Sá", "Jo"]).alias("a"), tx.strip_personal_names(F.lit(text), F.array(F.lit("José Sá"), F.lit("Jo"))).alias("b"))
    assert r.a == r.b == "Autos [processo] CNPJ [cnpj] CPF [cpf] [email] [parte] e [parte], JOÃO"


def test_secrets_literals_dates_money(spark):
    r = one(
        spark,
        tx.redact_secrets(F.lit("x?key=abc&y AIza" + "a" * 25 + " topsecret1 short"), ["topsecret1", "short"]).alias("s"),
        tx.literals(F.lit("em 01/02/2024 e 2024-02-01 pagou R$ 1.234,56 com 12,5 % em 0001234-56.2024.8.26.0001")).alias("l"),
        tx.dates(F.lit("99/99/2024 x 01/02/2023")).alias("d"),
        tx.brl(F.lit(1234.5)).alias("m"),
        tx.case_slug(F.lit("/a/b\\Ação Nº 1.PDF")).alias("c"),
        tx.case_slug(F.lit("///")).alias("e"),
        tx.json_array(F.lit("{}")).alias("j"),
    )
    assert r.s == "x?key=[REDACTED]&y [REDACTED] [REDACTED] short"
    assert r.l == ["01/02/2024", "2024-02-01", "R$ 1.234,56", "12,5 %", "0001234-56.2024.8.26.0001"]
    assert r.d == ["2024-99-99", "2023-02-01"] and r.m == "R$ 1234,50" and r.c == "acao-n-1" and r.e == "caso" and r.j == []


def test_identity(spark):
    r = one(
        spark,
        ident.evidence_id(F.lit("c"), F.lit(12), F.lit("p001")).alias("e"),
        ident.page_of(F.lit("case:c:page:12:unit:p001")).alias("p"),
        ident.sorted_evidence(F.array(*map(F.lit, ("case:c:page:10:unit:p001", "case:c:page:2:unit:p001", "case:c:page:2:unit:ocr001", "case:c:page:2:unit:p001")))).alias("s"),
        ident.display_ref(F.lit(" "), F.lit("ev"), F.lit("fl"), F.lit(3)).alias("a"),
        ident.display_ref(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(3)).alias("b"),
    )
    assert r.e == "case:c:page:12:unit:p001" and r.p == 12
    assert r.s == ["case:c:page:2:unit:ocr001", "case:c:page:2:unit:p001", "case:c:page:10:unit:p001"]
    assert r.a == "ev, fl" and r.b == "pagina 3 do PDF"


def test_character_counts_equal_regular_expressions():
    import random
    import re
    import unicodedata

    import pyarrow as pa

    from evidentia.functions import text_counts as tc

    rnd = random.Random(6)
    alphabet = "aB1é漢٣.,;%-#$\u2014\ufffd\x00\x1b\u00a0\u3000 \n\t\\uD"
    texts = ["".join(rnd.choices(alphabet, k=rnd.randint(0, 80))) for _ in range(300)] + [None, "", "x" * 44, "x" * 45, "a " + "y" * 50 + " b\\uFFFD", "\n \n", "𝒜" * 46]
    space = "[" + tc.SPACE_CHARS + "]"
    for step in (1, 4 << 20):
        got = tc.count_characters(pa.array(texts, pa.string()), step)
        for i, t in enumerate(texts):
            raw = t or ""
            norm = re.sub(space + "+", " ", raw).strip(" ")
            long = re.findall(r"[^ ]{45,}", norm)
            kinds = [unicodedata.category(c)[0] in "LN" for c in norm]
            want = (len(norm), sum(kinds), len(re.findall(r"\\u(?:FFFD|0000|0001)|[\x00-\x08\x0b\x0c\x0e-\x1f\ufffd]", raw)), norm.count(" "), len(long), sum(map(len, long)), sum(not k and c != " " and c not in tc.PLAIN_CHARS for c, k in zip(norm, kinds)))
            assert tuple(int(got[c][i]) for c in tc.COUNTS) == want, repr(t)


def test_markdown_blocks(spark):
    from evidentia.operators.markdown import markdown_blocks, parse

    text = "\n\n## Head *x*\r\n---\n| a | b |\n|---|:-:|\n| 1 | 2 |\n- one\n* two\n> said\n>more\nfirst line\nsecond\n1. numbered\ngoes on\n| no table\nlast"
    got = list(parse(text, "T"))
    assert [b[0] for b in got] == ["heading", "table", "bullet", "bullet", "quote", "paragraph", "paragraph", "paragraph"]
    assert got[0][1:3] == (2, "Head *x*") and got[1][3] == [["a", "b"], ["1", "2"]] and got[4][2] == "said more"
    assert [b[2] for b in got[5:]] == ["first line second", "1. numbered goes on", "| no table last"]
    assert [b[:3] for b in parse("### low\n", "T")] == [("title", 0, "T"), ("heading", 3, "low")]
    df = spark.createDataFrame([(1, text, "T"), (2, None, "T"), (3, "", "T")], "doc_id long, text string, t string")
    rows = markdown_blocks(df, title="t").collect()
    assert [r.kind for r in rows if r.doc_id == 1] == [b[0] for b in got] and [r.kind for r in rows if r.doc_id != 1] == ["title"]
    assert markdown_blocks(df.limit(0)).count() == 0


def test_excerpts_and_concepts_make_each_text_once(spark):
    from evidentia.functions.text import dense_excerpt
    from evidentia.operators.events import concepts
    from evidentia.operators.matrix import bundle_query

    df = spark.createDataFrame([("Num. 12 - Pág. 3 " + "ação de cobrança " * 20, "Cobrança"), ("curto", "x"), ("", ""), (None, None)], "t string, o string")
    plan = lambda c: df.select(c.alias("c"))._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan(dense_excerpt("t")).count("ssinado eletronicamente") == 1
    assert "contains(lambda" in plan(concepts(F.col("t"))) and "contains(case" not in plan(bundle_query(F.col("o"), F.col("t"), F.array("o")))
    got = df.select(dense_excerpt("t").alias("e"), concepts(F.col("t")).alias("c")).collect()
    assert got[0].e == ("ação de cobrança " * 20)[:240] + " …" and got[0].c == ["cobranca"]
    assert [r.e for r in got[1:]] == ["curto", None, None] and [r.c for r in got[1:]] == [[], [], []]

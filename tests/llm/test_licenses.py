"""License scans against every block and every template."""

import math
import random
import re

import pytest

from evidentia.llm import license_scan as ls

LOW = str.maketrans(ls.UPPER, ls.LOWER)
SCHEMA = "doc_id long, text string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def texts(seed=2, n=120):
    rnd = random.Random(seed)
    rare = ["thnd", "ouere", "ção", "Ünder", "É", "mit", "license", "the", "of", "software", "free", "public", "version", "apache", "x1"]
    make = lambda k: [rnd.choice(rare) + ("" if rnd.random() < 0.7 else str(rnd.randint(0, 99))) for _ in range(k)]
    out = []
    for i in range(n):
        w = make(rnd.randint(0, 300))
        if i % 3 == 0:
            _, notice = rnd.choice(ls.TEMPLATES)
            at, parts = rnd.randint(0, len(w)), notice.split(" ")
            for _ in range(i % 4):  # words left out, changed or moved
                k = rnd.randrange(len(parts))
                parts[k] = rnd.choice(["", "changed", parts[k - 1]])
            w[at:at] = parts if i % 2 else [p + "\n" for p in parts]
        if i % 5 == 0:
            w += rnd.choice(["MIT\nLicense", "the (Apache) license", "general-public-license", "mit licenses", "MIT MIT LICENSE license"]).split(" ")
        out.append((i, " ".join(w)))
    return out + [(n, None), (n + 1, ""), (n + 2, "!!! ?"), (n + 3, "mit"), (None, "Released under the MIT License."), (None, None), (7, "MIT license"), (7, "MIT license"), (n + 4, "nul \x00mit\x00license"), (n + 5, "Mit Lİcense mit license " + "w " * 60_000 + "apache license")]


def brute(rows, templates, threshold, phrases=ls.PHRASES):
    lists = [(label, words(x)) for label, x in templates]
    cell = max(len(w) for _, w in lists)
    out = []
    for i, t in rows:
        w = words(t)
        places = [(k, label) for p, label in phrases for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        most, labels = 0.0, {x for _, x in places}
        for b in range(max(1, math.ceil(len(w) / cell) - 1)):
            run = set(w[b * cell : (b + 2) * cell])
            for label, x in lists:
                share = len(run & set(x)) / len(set(x))
                if len(run & set(x)) >= math.ceil(threshold * len(set(x)) - 1e-9):
                    labels.add(label)
                    most = max(most, share)
        at = [k for k, _ in places]
        out.append((i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), 1.0 if at else most))
    return sorted(out, key=str)


@pytest.mark.parametrize("threshold", [0.9, 0.5, 1.0])
def test_scan(spark, threshold):
    rows = texts()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS N_WORDS", "'x' AS labels", "2 AS _h1").repartition(6)
    got = sorted((tuple(r) for r in ls.scan(df, ls.Templates(threshold=threshold)).collect()), key=str)
    assert got == brute(rows, ls.TEMPLATES, threshold)
    assert sum(bool(r[6]) for r in got) > 20


def test_blocks(spark):
    """Where a notice was found, with the words around it."""
    text = "w " * 100 + ls.TEMPLATES[2][1] + " w" * 100
    got = ls.license_blocks(spark.createDataFrame([(1, text)], SCHEMA)).collect()
    assert {r.label for r in got} == {"bsd"} and max(r.containment for r in got) == 1.0
    assert all(r.first_word <= 100 and r.end_word >= 118 for r in got if r.containment == 1.0)
    assert ls.license_blocks(spark.createDataFrame([], SCHEMA)).count() == 0


def test_every_notice_is_found(spark):
    """Planted notices, one word of ten or more changed; none in clean texts."""
    rnd, rows = random.Random(9), []
    for i, (_, t) in enumerate(ls.TEMPLATES * 4):
        parts = t.split(" ")
        if len(set(words(t))) >= 10:
            parts[rnd.randrange(len(parts))] = "other"
        rows.append((i, "some words of a text before " * rnd.randint(0, 30) + " ".join(parts) + " and others after it" * rnd.randint(0, 30)))
    got = {r.doc_id: r.labels.split(",") for r in ls.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    found = sum((ls.TEMPLATES * 4)[i][0] in got[i] for i in got)
    assert found >= 0.95 * len(rows)
    clean = [(i, "this is a text of the public version and the software is free to use in any form for a purpose " * 5) for i in range(5)]
    assert all(r.labels == "" and r.score == 0 for r in ls.scan(spark.createDataFrame(clean, SCHEMA)).collect())


def test_native(spark, tmp_path):
    spark.createDataFrame(texts(3, 20), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    plan = ls.op11_license_scan(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)


def test_templates_are_bounded():
    with pytest.raises(ValueError):
        ls.Templates((("long", "word " * 2000),))

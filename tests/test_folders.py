"""Folders of case files, some of them broken."""

import json
import os

from evidentia.sources.tables import case_folders, folder_artifact


def put(root, path, value):
    p = root / path
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")
    return p


def test_broken_artifacts_keep_their_case(spark, tmp_path):
    for c in ("um caso", "dois", "três+1", "quatro", "cinco"):
        put(tmp_path, f"{c}/case.json", {})
    put(tmp_path, "sem-caso/status.json", {"status": "done"})
    people = [{"nome": "M" * 80, "papel": "autor"}, {"nome": ""}, {"papel": "reu"}, {"nome": "Banco Y"}]
    for i, c in enumerate(("um caso", "dois", "três+1")):
        p = put(tmp_path, f"{c}/status.json", {"status": "done", "total_pages": 7 + i, "alerts": ["a", {"b": 1}] if i == 0 else []})
        os.utime(p, (1_700_000_000 + i, 1_700_000_000 + i))
    put(tmp_path, "um caso/artifacts/case_file.json", {"partes": people, "valor_causa": {"valor": "R$ 1,00"}, "caderno": {"total_documentos": 3}})
    put(tmp_path, "um caso/artifacts/dossie.json", [{"achado": 1}, 2])
    put(tmp_path, "dois/artifacts/case_file.json", '{"partes": [')
    put(tmp_path, "dois/artifacts/dossie.json", [1])
    put(tmp_path, "três+1/artifacts/dossie.json", {"no": "list"})
    put(tmp_path, "quatro/status.json", "not json at all")
    put(tmp_path, "quatro/artifacts/dossie.json", [1])
    got = case_folders(spark, str(tmp_path)).collect()
    assert [r.case_id for r in got] == ["três+1", "dois", "um caso", "cinco", "quatro"]
    by = {r.case_id: r for r in got}
    one = by["um caso"]
    assert (one.status, one.total_pages, one.alertas, one.partes, one.valor_causa, one.documentos_no_caderno, one.achados_no_dossie, one.broken) == ("done", 7, 2, ["M" * 60 + " (autor)", "Banco Y"], "R$ 1,00", 3, 2, False)
    two = by["dois"]
    assert (two.status, two.total_pages, two.alertas, two.partes, two.achados_no_dossie, two.broken) == ("done", 8, None, None, None, True)
    assert by["três+1"].achados_no_dossie is None and not by["três+1"].broken
    assert (by["quatro"].status, by["quatro"].achados_no_dossie, by["quatro"].broken) == (None, None, True) and not by["cinco"].broken
    kept = {r.case_id: (r.broken, r.raw) for r in folder_artifact(spark, str(tmp_path), "status.json").collect()}
    assert kept["quatro"] == (True, "not json at all") and kept["um caso"] == (False, None) and "sem-caso" in kept


def test_no_folders(spark, tmp_path):
    assert case_folders(spark, str(tmp_path)).count() == 0

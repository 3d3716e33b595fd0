"""Rounds of attempts: waits, ceilings, progress; artifacts of changed cases."""

import pytest

from evidentia.plans.api import Engine
from evidentia.sources.pages import TableSource
from evidentia.sources.store import Store
from evidentia.streaming.ingest import Budget, LeaseLost, attempt_rounds, enrich


def uneven(log):
    class Uneven:  # local, so that it travels to the workers by value
        name, prompt_version = "uneven", 1

        def read_attempt(self, case_id, page, attempt):
            with open(log, "a") as f:
                f.write(f"{case_id} {page} {attempt}\n")
            if page % 4 == 0 or page % 4 == 1 and attempt < 3:
                raise TimeoutError("no answer")
            return ("" if page % 4 == 2 else "texto lido da imagem " * 10), 1, 2

    return Uneven()


def calls(log):
    return [x.split() for x in open(log)]


def queue(spark, rows):
    return spark.createDataFrame(rows, "case_id string, page int, max_pages int, max_calls int")


def test_waits_are_the_drivers_and_grow(spark, tmp_path):
    log, waits, rounds = str(tmp_path / "log"), [], []
    out = attempt_rounds(queue(spark, [("a", p, None, None) for p in range(1, 9)]), uneven(log), 3, 500, 2, lambda d: rounds.append(sorted(r.page for r in d.collect())), waits.append)
    got = {r.page: (r.attempts, r.error, r.all_empty, r.tokens_in) for r in out.collect()}
    assert waits == [0.5, 1.0] and len(calls(log)) == 2 * (3 + 3 + 3 + 1)
    assert got == {p: {0: (3, "TimeoutError", False, 0), 1: (3, None, False, 1), 2: (3, "empty", True, 3), 3: (1, None, False, 1)}[p % 4] for p in range(1, 9)}
    assert rounds == [[3, 7], [], [1, 2, 4, 5, 6, 8], []]


def test_ceilings_are_never_passed(spark, tmp_path):
    log = str(tmp_path / "log")
    out = attempt_rounds(queue(spark, [(c, p, mp, mc) for c, mp, mc in (("a", None, 10), ("b", 3, None), ("c", 4, 5), ("d", None, 0)) for p in range(1, 9)]), uneven(log), 3, 0, 3, wait=lambda _: None)
    made = {c: [(int(p), int(n)) for x, p, n in calls(log) if x == c] for c in "abcd"}
    assert len(made["a"]) == 10 and len(made["c"]) == 5 and not made["d"]
    assert {p for p, _ in made["b"]} == {1, 2, 3} and {p for p, _ in made["c"]} == {1, 2, 3, 4}
    assert {(r.case_id, r.page): r.attempts for r in out.collect()} == {(c, p): max(n for q, n in made[c] if q == p) for c in "abc" for p in {p for p, _ in made[c]}}


def test_nothing_to_do(spark, tmp_path):
    assert attempt_rounds(queue(spark, []), uneven(str(tmp_path / "log"))).count() == 0


def test_progress_stays_when_the_lease_is_lost(spark, tmp_path):
    """The first round's pages are stored; nothing of the second is."""
    store, log = Store(spark, str(tmp_path / "s"), buckets=4), str(tmp_path / "log")
    store.upsert("page_ledger", spark.createDataFrame([("a", p, "ocr_needed") for p in range(1, 5)], "case_id string, page int, state string"))
    held = iter([True, True, True, False])
    with pytest.raises(LeaseLost):
        enrich(store, uneven(log), Budget(), owns=lambda: next(held), wait=lambda _: None)
    state = lambda: {r.page: r.state for r in store.read("page_ledger").collect()}
    assert state() == {1: "ocr_needed", 2: "ocr_needed", 3: "ocr_done", 4: "ocr_needed"}
    done = enrich(store, uneven(log), Budget(), wait=lambda _: None)
    assert state() == {1: "ocr_done", 2: "failed_permanent", 3: "ocr_done", 4: "failed_retryable"} and {r.page for r in done.collect()} == {1, 2, 4}
    assert store.read("evidence_units").count() == 2 and store.read("ocr_usage").groupBy().sum("tokens_in").first()[0] == 1 + 4


def test_artifacts_of_changed_cases_only(spark, tmp_path):
    text = "PETIÇÃO INICIAL. Mandado de citação cumprido em 05/03/2024 nos autos do processo, com texto bastante."
    rows = [(f"caso{i}", p, text) for i in range(3) for p in (1, 2)]
    spark.createDataFrame(rows, "case_id string, page int, text string").write.parquet(str(tmp_path / "in"))
    e = Engine(spark, str(tmp_path / "s"))
    e.store = Store(spark, str(tmp_path / "s"), buckets=8)
    e.create_case(TableSource(str(tmp_path / "in")), now="2024-05-01 00:00:00")
    assert e.write_artifacts("out") == 3 and e.write_artifacts("out") == 0
    read = lambda x: spark.read.json(f"{e.root}/out/{x}")
    files = lambda: {f for x in ("ledger", "events", "status") for f in read(x).inputFiles()}
    before = files()
    assert read("events").count() == 3 and read("ledger").count() == 6
    e.store.patch("page_ledger", spark.createDataFrame([("caso1", 2, "ocr_needed")], "case_id string, page int, state string"))
    assert e.write_artifacts("out") == 1
    assert {r.state for r in read("ledger").filter("case_id = 'caso1' AND page = 2").collect()} == {"ocr_needed"}
    assert all("case_id=caso1" in f for f in before ^ files())
    e.remove_case("caso2", "caso2")
    assert e.write_artifacts("out") == 1 and {r.case_id for r in read("ledger").select("case_id").distinct().collect()} == {"caso0", "caso1"}

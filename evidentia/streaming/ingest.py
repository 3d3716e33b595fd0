"""Incremental ingestion: pages as a stream, micro-batches, enrichment under
approval and budget, embedding, leases."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.identity import evidence_id, sha256
from evidentia.functions.text import page_yield, text_quality
from evidentia.operators.coverage import DEADLINE_MS, STALE_FACTOR, in_queue, ocr_estimate, requeue_stamp_only, skip_extracted, textual_queue, visual_queue
from evidentia.operators.events import classify
from evidentia.operators.running import numbered
from evidentia.operators.search import index_rows, retrieval_text
from evidentia.rules import PT_LEGAL, RulePack
from evidentia.schemas import PAGES
from evidentia.sources.files import Files, contained, safe_name
from evidentia.sources.shared import written
from evidentia.sources.store import Store


class Enricher(Protocol):
    """Reads a page that has no usable text.  Runs on executors.  One that wants
    to know which attempt it is has ``read_attempt(case_id, page, attempt)``."""

    name: str
    prompt_version: int

    def read(self, case_id: str, page: int) -> tuple[str, int, int]:
        """Text, tokens in, tokens out; raises on a failure worth retrying."""
        ...


class Embedder(Protocol):
    """Vectors of texts, and of pages if it has ``embed_pages(list of (case,
    page))``.  Runs on executors."""

    model: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


@dataclass(frozen=True)
class TrigramEmbedder:
    """A deterministic stand-in: hashed character trigrams of the folded text."""

    dim: int = 128
    model: str = "trigram|retrieval-v1"

    def embed(self, texts: list[str]) -> list[list[float]]:
        import zlib

        from evidentia.functions.text import python_fold

        out = []
        for t in texts:
            v = [0.0] * self.dim
            f = python_fold(t or "")
            for i in range(len(f) - 2):
                v[zlib.crc32(f[i : i + 3].encode()) % self.dim] += 1.0
            out.append(v)
        return out


# ---------------------------------------------------------------- extraction


def page_rows(pages: DataFrame, pack: RulePack = PT_LEGAL, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Evidence units and ledger rows of native pages (case_id, page, text).
    Quality, classification and state are expressions of one projection."""
    now = now if now is not None else F.current_timestamp()
    text = F.coalesce(F.col("text"), F.lit(""))
    p = pages.select("case_id", F.col("page").cast("int").alias("page"), text.alias("text")).withColumns({"hash": sha256("text"), "q": text_quality("text")})
    bad = F.col("q.needs_enrichment") | (F.length("text") < 20)
    p = p.withColumns({"bad": bad, "c": classify(F.col("text"), ~bad, pack=pack), "evidence_id": evidence_id("case_id", "page", F.lit("p001"))})
    units = p.select(
        "evidence_id", "case_id", "page", F.lit("p001").alias("unit_id"), F.lit("page_text").alias("unit_type"), F.lit(0).alias("start_offset"), F.length("text").alias("end_offset"), "hash",
        F.when(F.col("text") != "", F.col("text")).alias("text"),
    )
    ledger = p.select(
        "case_id", "page", F.col("hash").alias("page_hash"), F.when(F.col("bad"), "ocr_needed").otherwise("done").alias("state"), F.col("q.score").alias("text_quality_score"),
        F.col("q.reasons").alias("text_quality_reasons"), F.length("text").alias("native_text_chars"), F.col("hash").alias("native_text_hash"), F.col("c.piece_type").alias("piece_type"),
        F.col("c.confidence").alias("piece_confidence"), F.col("bad").alias("ocr_needed"), F.lit(0).alias("ocr_attempts"), F.array("evidence_id").alias("evidence_ids"), now.alias("updated_at"),
    )
    return units, ledger


def ingest_batch(store: Store, pages: DataFrame, pack: RulePack = PT_LEGAL) -> None:
    """One micro-batch: pages whose text is settled already are left out;
    evidence is written before the ledger, so that a ledger row always has its
    evidence; a batch that runs twice changes nothing.

    What is to be done is written down once, so that a source is read and parsed
    once; of the store only the buckets of the batch's cases are read.
    """
    rows = pages.withColumn("hash", sha256(F.coalesce(F.col("text"), F.lit("")))).dropDuplicates(["case_id", "page"])
    rows = written(rows.select("case_id", F.col("page").cast("int").alias("page"), "text", "hash"))
    todo = written(skip_extracted(rows, store.near("page_ledger", rows)).drop("hash"))
    if todo.isEmpty():
        return
    units, ledger = (written(x) for x in page_rows(todo, pack))
    old = store.near("evidence_units", units).select("evidence_id", F.col("hash").alias("_h"))
    changed = units.select("evidence_id", "case_id", "hash").join(old, "evidence_id").filter(F.col("hash") != F.col("_h")).select("evidence_id", "case_id")
    store.delete("evidence_vectors", changed, ["evidence_id"])
    store.upsert("evidence_units", units)
    index_units(store, units)
    # the ledger is still the old one here, so these rows are the same as those of the units
    store.upsert("page_ledger", ledger)


def index_units(store: Store, units: DataFrame) -> None:
    """The stored text index of new or changed units: their old postings go,
    the new ones are added beside the rest."""
    store.index(units.select("evidence_id", "case_id", "text"), lambda dealt: index_rows(dealt, "evidence_id", "text", ("_b", "case_id"), totals=True))


def ingest_stream(store: Store, path: str, checkpoint: str, fmt: str = "parquet", pack: RulePack = PT_LEGAL, files_per_batch: int = 50):
    """All files of a folder that weren't read before, in micro-batches, until
    none is left; a restart goes on from the checkpoint.  Returns the ended query."""
    stream = store.spark.readStream.format(fmt).schema(PAGES).option("maxFilesPerTrigger", files_per_batch).load(path)
    q = stream.writeStream.foreachBatch(lambda df, _: ingest_batch(store, df, pack)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


# ---------------------------------------------------------------- enrichment


@dataclass(frozen=True)
class Budget:
    max_pages: int | None = None
    max_calls: int | None = None
    retries: int = 3
    threshold: int = 25
    backoff_ms: int = 250


class LeaseLost(RuntimeError):
    """Another worker has taken the case over; nothing was stored."""


def requeue(store: Store, prompt_version: int, case_id: str | None = None) -> int:
    """Pages that gave only stamps under an older prompt go back to the queue,
    once per prompt version; the number of pages looked at."""
    ledger = store.read("page_ledger", case_id).select("case_id", "page", "state", "ocr_yield", "ocr_prompt_version")
    new = requeue_stamp_only(ledger.withColumn("_v", F.col("ocr_prompt_version")), prompt_version)
    changed = new.filter(~F.col("_v").eqNullSafe(F.col("ocr_prompt_version"))).select("case_id", "page", "state", "ocr_prompt_version")
    n = changed.count()
    if n:
        store.patch("page_ledger", changed)
    return n


RESULT = "case_id string, page int, attempt int, text string, tokens_in long, tokens_out long, error string"


def attempt_rounds(
    queue: DataFrame, enricher: Enricher, retries: int = 3, backoff_ms: int = 250, concurrency: int = 2,
    on_round: Callable[[DataFrame], None] = lambda _: None, wait: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """queue (case_id, page, max_pages, max_calls; null: no ceiling) read in
    rounds: (case_id, page, text, tokens_in, tokens_out, error, attempts,
    all_empty) of every page that was tried.

    State by page and case, written after each round: attempts, empty answers,
    calls that the case has spent.  A round tries every waiting page once, the
    first ones of a case as far as its calls go; a failed one waits for the next
    round, which begins after a backoff that grows by the round.  The driver
    waits; no task is held.  Calls of a round are made once: what follows reads
    what they gave.  ``on_round`` gets what a round has finished.
    """
    none = F.lit(2**62).cast("long")
    block = F.floor(F.col("page") / 1024)
    q = queue.select("case_id", F.col("page").cast("int").alias("page"), F.coalesce(F.col("max_pages").cast("long"), none).alias("_mp"), F.coalesce(F.col("max_calls").cast("long"), none).alias("_mc"))
    q = numbered(written(q.withColumn("_b", block)), ["case_id"], ["_b"], ["page"], "_n").filter(F.col("_n") <= F.col("_mp"))
    state = written(q.select("case_id", "page", "_b", "_mc", F.lit(0).alias("tries"), F.lit(0).alias("empties"), F.lit(False).alias("done")))
    read = getattr(enricher, "read_attempt", None) or (lambda case, page, attempt: enricher.read(case, page))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for case, page, tries in zip(pdf.case_id, pdf.page, pdf.tries):
                text, tin, tout, error = "", 0, 0, None
                try:
                    text, tin, tout = read(case, int(page), int(tries) + 1)
                    error = None if text and text.strip() else "empty"
                except Exception as e:  # noqa: BLE001 - any failure of the service counts as one
                    error = type(e).__name__
                rows.append((case, int(page), int(tries) + 1, text or "", tin, tout, error))
            yield pd.DataFrame(rows, columns=["case_id", "page", "attempt", "text", "tokens_in", "tokens_out", "error"])

    results: DataFrame | None = None
    for n in range(1, retries + 1):
        spent = state.groupBy("case_id").agg(F.sum("tries").alias("_spent"))
        waiting = numbered(state.filter(~F.col("done")).drop("empties"), ["case_id"], ["_b"], ["page"], "_n")
        now = waiting.join(spent, "case_id").filter(F.col("_n") <= F.col("_mc") - F.col("_spent"))
        if n > 1:
            wait(backoff_ms * (n - 1) / 1000)
        got = written(now.select("case_id", "page", "tries").repartition(concurrency).mapInPandas(run, RESULT))
        if got.isEmpty():
            break
        results = got if results is None else results.unionByName(got)
        new = got.select("case_id", "page", F.lit(1).alias("_one"), (F.col("error") == "empty").cast("int").alias("_e"), F.col("error").isNull().alias("_ok"))
        more = lambda c: F.coalesce(F.col(c), F.lit(0))
        state = written(state.join(new, ["case_id", "page"], "left").select("case_id", "page", "_b", "_mc", (F.col("tries") + more("_one")).alias("tries"), (F.col("empties") + more("_e")).alias("empties"), F.coalesce("_ok", "done").alias("done")))
        ended = got.filter((F.col("attempt") == retries) | F.col("error").isNull()).select("case_id", "page")
        on_round(_outcomes(results, state, retries).join(ended, ["case_id", "page"], "left_semi"))
    if results is None:
        return queue.sparkSession.createDataFrame([], OUTCOME)
    # pages whose case had no calls left for another try
    on_round(_outcomes(results, state, retries).filter(F.col("error").isNotNull() & (F.col("attempts") < retries)))
    return _outcomes(results, state, retries)


OUTCOME = "case_id string, page int, text string, tokens_in long, tokens_out long, error string, attempts int, all_empty boolean"


def _outcomes(results: DataFrame, state: DataFrame, retries: int) -> DataFrame:
    """The last result of each page, with the tokens of all its attempts."""
    tokens = results.groupBy("case_id", "page").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
    last = results.select("case_id", "page", F.col("attempt").alias("tries"), "text", "error")
    out = state.join(last, ["case_id", "page", "tries"]).join(tokens, ["case_id", "page"])
    return out.select("case_id", "page", "text", "tokens_in", "tokens_out", "error", F.col("tries").alias("attempts"), ((F.col("empties") == F.col("tries")) & (F.col("tries") == retries)).alias("all_empty"))


def outcome_state(error: Column, all_empty: Column) -> Column:
    """The ledger state that an outcome gives."""
    return F.when(error.isNull(), "ocr_done").when(all_empty, "failed_permanent").otherwise("failed_retryable")


def enrich(
    store: Store, enricher: Enricher, budget: Budget = Budget(), pack: RulePack = PT_LEGAL, concurrency: int = 2, case_id: str | None = None,
    owns: Callable[[], bool] = lambda: True, wait: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """Read the queue of pages (of one case, if given) with the enricher, as
    far as approval and budget go; returns the outcome rows.

    ``owns`` tells whether the lease is still held; it is asked before the
    calls and again before anything is stored, and raises LeaseLost if not.

    A case's ceilings hold for pages begun and calls made, retries included.
    Each round's outcomes are stored before the next begins.  A page whose text
    is empty at every attempt has failed for good; an error can be tried again.
    """
    if not owns():
        raise LeaseLost
    ledger = store.read("page_ledger", case_id)
    may = ocr_estimate(ledger, store.read("approvals", case_id), budget.threshold).filter("may_run").select("case_id", "max_pages", "max_calls")
    least = lambda c, most: F.coalesce(F.least(c, F.lit(most).cast("int")), c, F.lit(most).cast("int"))
    queue = ledger.filter(in_queue(F.col("state"))).select("case_id", "page").join(may, "case_id")
    queue = queue.select("case_id", "page", least(F.col("max_pages"), budget.max_pages).alias("max_pages"), least(F.col("max_calls"), budget.max_calls).alias("max_calls"))

    def keep(done: DataFrame) -> None:
        if not owns():
            raise LeaseLost
        _store_outcomes(store, written(done), enricher.prompt_version, pack)

    return attempt_rounds(queue, enricher, budget.retries, budget.backoff_ms, concurrency, keep, wait)


def _store_outcomes(store: Store, done: DataFrame, prompt_version: int, pack: RulePack) -> None:
    if done.isEmpty():
        return
    ok = done.filter("error IS NULL")
    eid = evidence_id("case_id", "page", F.lit("ocr001"))
    units = written(ok.select(eid.alias("evidence_id"), "case_id", "page", F.lit("ocr001").alias("unit_id"), F.lit("ocr_paragraph").alias("unit_type"), F.lit(0).alias("start_offset"), F.length("text").alias("end_offset"), sha256("text").alias("hash"), "text"))
    store.delete("evidence_vectors", done.select(eid.alias("evidence_id"), "case_id"), ["evidence_id"])
    store.upsert("evidence_units", units)
    index_units(store, units)
    y = page_yield("text")["yield"]
    c = classify(F.col("text"), F.lit(True), pack=pack)
    changes = done.select(
        "case_id", "page", outcome_state(F.col("error"), F.col("all_empty")).alias("state"), F.when(F.col("error").isNull(), y).alias("ocr_yield"), F.when(F.col("error").isNull(), c["piece_type"]).alias("piece_type"), F.col("attempts").alias("ocr_attempts"),
        F.col("error").alias("ocr_last_error_kind"), F.when(F.col("error").isNull(), F.array(evidence_id("case_id", "page", F.lit("p001")), eid)).alias("evidence_ids"),
        F.lit(prompt_version).alias("ocr_prompt_version"), F.current_timestamp().alias("updated_at"),
    )
    store.patch("page_ledger", changes)
    store.append("ocr_usage", done.select("case_id", F.current_timestamp().alias("at"), "tokens_in", "tokens_out"))


def embed(
    store: Store, embedder: Embedder, max_calls: int = 2000, batch: int = 32, visual_batch: int = 4, concurrency: int = 4, case_id: str | None = None,
    time_budget_s: float | None = None, calls_per_round: int = 64, clock: Callable[[], float] = time.monotonic,
) -> int:
    """Vectors for the units that lack one in the embedder's space: texts, and
    visual pages if the embedder has ``embed_pages``.

    At most ``max_calls`` batches are sent, in rounds of ``calls_per_round``; a
    round is stored before the next begins.  With a time budget no round begins
    after it, but one always does, so that every call makes progress.  Running
    it again when all is done does nothing.  Returns the number of vectors.
    """
    began, left, made = clock(), max_calls, 0
    while left > 0 and (not made or time_budget_s is None or clock() - began < time_budget_s):
        n, calls = _embed_round(store, embedder, min(left, calls_per_round), batch, visual_batch, concurrency, case_id)
        if not n:
            break
        made, left = made + n, left - calls
    return made


def _embed_round(store: Store, embedder: Embedder, calls: int, batch: int, visual_batch: int, concurrency: int, case_id: str | None) -> tuple[int, int]:
    """Vectors made and calls spent; texts first."""
    units, ledger, vectors = (store.read(x, case_id) for x in ("evidence_units", "page_ledger", "evidence_vectors"))
    vectors = vectors.filter(F.col("model") == embedder.model)
    todo = textual_queue(units.filter(F.col("text").isNotNull()), ledger, vectors, embedder.model).orderBy("case_id", "page", "unit_id").limit(calls * batch)
    rows = todo.select("evidence_id", "case_id", "page", retrieval_text(F.col("text"), "document").alias("t"))
    n = _store_vectors(store, rows, embedder.model, lambda p: embedder.embed(p.t.tolist()), batch, concurrency)
    spent = -(-n // batch)
    if hasattr(embedder, "embed_pages") and spent < calls:
        seen = vectors.select("case_id", F.regexp_extract("evidence_id", r":page:(\d+):", 1).cast("int").alias("page"))
        pages = visual_queue(ledger, seen).orderBy("case_id", "page").limit((calls - spent) * visual_batch)
        rows = pages.select(evidence_id("case_id", "page", F.lit("img001")).alias("evidence_id"), "case_id", "page", F.lit("").alias("t"))
        m = _store_vectors(store, rows, embedder.model, lambda p: embedder.embed_pages(list(zip(p.case_id, p.page))), visual_batch, concurrency)
        n, spent = n + m, spent - (-m // visual_batch)
    return n, spent


def _store_vectors(store: Store, rows: DataFrame, model: str, call, batch: int, concurrency: int) -> int:
    def run(batches):
        import pandas as pd

        for pdf in batches:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                vs = call(part)
                if len(vs) != len(part):
                    raise ValueError("the embedder gave another number of vectors")
                yield pd.DataFrame({"evidence_id": part.evidence_id, "case_id": part.case_id, "model": model, "dim": [len(v) for v in vs], "vector": vs})

    path = f"{store.root}/_embedded/{uuid.uuid4().hex}"
    rows.repartition(concurrency).mapInPandas(run, "evidence_id string, case_id string, model string, dim int, vector array<float>").write.parquet(path)
    made = store.spark.read.parquet(path)
    n = made.count()
    if n:
        store.upsert("evidence_vectors", made)
    return n


# ---------------------------------------------------------------- leases


class Lease:
    """One worker per case: numbered lock files, the highest of which counts.

    A file names its owner and time and is created exclusively; the owner's
    signs of life are kept beside it.  A lock whose last sign is older than
    four deadlines is taken over by creating the next number, which one taker
    only can, so a slow owner finds that the lock isn't its own any more.
    """

    def __init__(self, spark: SparkSession, root: str, case_id: str, deadline_ms: int = DEADLINE_MS):
        self.files, self.folder = Files(spark), contained(root, "_locks", safe_name(case_id))
        self.owner, self.deadline_ms = f"worker-{uuid.uuid4()}", deadline_ms

    def _numbers(self) -> list[int]:
        return sorted(int(x) for x in self.files.names(self.folder) if x.isdigit())

    def _file(self, n: int) -> str:
        return f"{self.folder}/{n:08d}"

    def _state(self) -> tuple[int, str, int]:
        """Number, owner and last sign; 0 without a lock.  A lock that can't be
        read has no owner and no sign."""
        numbers = self._numbers()
        if not numbers:
            return 0, "", 0
        said = [self.files.read(self._file(numbers[-1]) + x) or "" for x in ("", ".sign")]
        words = [x.split(" ") for x in said]
        times = [int(w[1]) for w in words if len(w) == 2 and w[1].isdigit()]
        return numbers[-1], words[0][0], max(times, default=0)

    def _said(self) -> str:
        return f"{self.owner} {int(time.time() * 1000)}"

    def acquire(self) -> bool:
        n, owner, at = self._state()
        if n and owner == self.owner:
            return self.renew()
        if n and int(time.time() * 1000) - at <= STALE_FACTOR * self.deadline_ms:
            return False
        return self.files.create(self._file(n + 1), self._said())

    def owns(self) -> bool:
        n, owner, _ = self._state()
        return n > 0 and owner == self.owner

    def renew(self) -> bool:
        n, owner, _ = self._state()
        if not n or owner != self.owner:
            return False
        self.files.write(self._file(n) + ".sign", self._said())
        return True

    def release(self) -> None:
        n, owner, _ = self._state()
        if n and owner == self.owner:
            for k in self._numbers():  # its own last: until then it counts
                if k <= n:
                    self.files.delete(self._file(k) + ".sign")
                    self.files.delete(self._file(k))


def event_counts(spark: SparkSession, path: str, checkpoint: str, out: str, schema) -> DataFrame:
    """Counts per type over a stream of event files, each micro-batch added
    as a partial count; the result is their sum."""
    s = spark.readStream.format("parquet").schema(schema).load(path)

    def batch(df: DataFrame, epoch: int) -> None:
        df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v")).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    q = s.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out).groupBy("event_type").agg(F.sum("n").alias("n_events"), F.round(F.sum("v"), 4).alias("sum_value"))


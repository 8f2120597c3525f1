"""The engine as callers see it: build once, search in batches, never raise at the edge."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import Settings
from tessera.operators import drafts, ingest, retrieve, tools
from tessera.session import materialize, ship
from tessera.sources import documents

STAGES = ("parse", "chunk", "embed", "index")
SPANS = "kind string, name string, trace string, ms double, fields map<string,string>"


class DeadlineExceeded(TimeoutError):
    """A call that ran past its deadline; its Spark jobs were cancelled."""


@dataclass
class ToolError:
    code: str
    message: str
    retryable: bool = False
    remediation: str = ""


@dataclass
class Answer:
    """Results, or an error, and the stamps that make runs comparable."""

    results: DataFrame | None
    stamps: dict[str, str]
    error: ToolError | None = None


@dataclass
class Tracer:
    """Spans as rows; of a value only its kind and length are kept, never its text."""

    trace: str = field(default_factory=lambda: uuid.uuid4().hex[:12])
    rows: list[tuple] = field(default_factory=list)

    @contextmanager
    def span(self, kind: str, name: str, **values):
        began = time.perf_counter()
        try:
            yield
        finally:
            told = {k: f"{type(v).__name__}:{len(v)}" if hasattr(v, "__len__") else type(v).__name__ for k, v in values.items()}
            self.rows.append((kind, name, self.trace, (time.perf_counter() - began) * 1000, told))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, SPANS)


def with_deadline(spark: SparkSession, seconds: float, call: Callable):
    """The call's result; past the deadline its jobs are cancelled, not left behind."""
    if seconds <= 0:
        return call()
    tag, late = f"deadline-{uuid.uuid4().hex}", threading.Event()

    def expire() -> None:
        late.set()
        spark.interruptTag(tag)

    timer = threading.Timer(seconds, expire)
    spark.addTag(tag)
    timer.start()
    try:
        out = call()
        if late.is_set():
            raise DeadlineExceeded(f"more than {seconds} s")
        return out
    except DeadlineExceeded:
        raise
    except Exception as e:
        if late.is_set():
            raise DeadlineExceeded(f"more than {seconds} s") from e
        raise
    finally:
        timer.cancel()
        spark.removeTag(tag)


class Engine:
    """Search over one corpus of chunks (chunk_id, paper_id, title, section, year, venue,
    text and so on) with vectors (chunk_id, embedding)."""

    def __init__(self, chunks: DataFrame, vectors: DataFrame | None = None, settings: Settings = Settings(), ranker: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.settings, self.ranker = chunks.sparkSession, settings, ranker
        self.chunks = chunks
        if vectors is None:
            vectors = drafts.stub_embeddings(chunks.select("chunk_id", "text"), "chunk_id")
        self.vectors = vectors
        self.index = retrieve.sparse_index(chunks, persist=True)
        self.tracer = Tracer()

    def requests(self, rows: list[dict]) -> DataFrame:
        """Requests of query_id, query and optional filters; embeddings by the stub."""
        names = ("query_id", "query", "year_min", "year_max", "sections", "venue_is")
        df = self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], "query_id string, query string, year_min int, year_max int, sections array<string>, venue_is string")
        return df.join(drafts.stub_embeddings(df.select("query_id", F.col("query").alias("text")), "query_id", "query"), "query_id")

    def search(self, requests: DataFrame, top_k: int | None = None) -> Answer:
        """Attributed results of a batch; a failure becomes an error in the answer."""
        s = self.settings
        n = s.top_k if top_k is None else top_k
        if not 1 <= n <= 50:
            return Answer(None, s.stamps(), ToolError("bad_request", "top_k has to be from 1 to 50"))
        try:
            with self.tracer.span("tool", "search", top_k=n):
                plan = lambda: materialize(self._ranked(requests, n), "results")
                found = with_deadline(self.spark, s.deadline_seconds, plan)
            if not found.limit(1).count():
                return Answer(found, s.stamps(), ToolError("no_results", "no chunk matched", True, "drop filters or use other terms"))
            return Answer(found, s.stamps())
        except DeadlineExceeded as e:
            return Answer(None, s.stamps(), ToolError("timeout", str(e), True, "try a smaller top_k"))
        except Exception as e:  # nothing crosses this edge as an exception
            return Answer(None, s.stamps(), ToolError("retrieval_failed", str(e).split("\n")[0], True, "try once more"))

    def _ranked(self, requests: DataFrame, n: int) -> DataFrame:
        s = self.settings
        found = retrieve.hybrid_search(requests, self.chunks, self.index, self.vectors, s.fusion, s.candidates_per_arm, min(200, max(20, 4 * n)) if self.ranker else n)
        if self.ranker:
            found = retrieve.top(self.ranker(found).drop("rank"), n, "rerank_score")
        return found

    def chunk(self, chunk_id: str) -> DataFrame:
        return self.chunks.where(F.col("chunk_id") == chunk_id)

    def section(self, paper_id: str, section: str) -> DataFrame:
        some = self.chunks.where((F.col("paper_id") == paper_id) & (F.lower("section") == section.lower()))
        return retrieve.section_read(some).orderBy("position")

    def cite(self, chunk_ids: list[str], style: str) -> DataFrame:
        return self.chunks.where(F.col("chunk_id").isin(chunk_ids)).select("chunk_id", tools.citation(style).alias("citation"))

    def health(self) -> DataFrame:
        return tools.readiness({"chunks": self.chunks, "postings": self.index.postings, "vectors": self.vectors})


def choose(candidates: dict[str, Callable[[], Engine]], probe: str) -> tuple[str, Engine]:
    """The first engine that can be made and answers the probe."""
    failed = {}
    for name, make in candidates.items():
        try:
            engine = make()
            answer = engine.search(engine.requests([{"query_id": "probe", "query": probe}]))
            if answer.error is None:
                return name, engine
            failed[name] = answer.error.code
        except Exception as e:
            failed[name] = str(e).split("\n")[0]
    raise RuntimeError(f"no engine answers: {failed}")


def ingest_corpus(docs: DataFrame, until: str = "index", manifest: DataFrame | None = None, settings: Settings = Settings(), dry_run: bool = False) -> dict:
    """The stages parse, chunk, embed, index up to ``until`` over (paper_id, text). Each
    stage's table is written, so that a later one can be run again on it; a dry run only
    counts."""
    if until not in STAGES:
        raise ValueError(f"unknown stage {until!r}; known: {STAGES}")
    ship(docs.sparkSession)
    keep = (lambda df, name: df) if dry_run else materialize
    wanted = STAGES[: STAGES.index(until) + 1]
    out: dict = {"records": keep(ingest.page_records(documents.text_blocks(docs)), "records")}
    out["report"] = ingest.parse_report(out["records"])
    if "chunk" in wanted:
        size = ingest.Packing(settings.chunk_target, settings.chunk_overlap, settings.chunk_least, settings.chunk_most)
        units = ingest.absorbed(ingest.islands(ingest.kept_records(out["records"], keep_thin=True)), size.least)
        out["chunks"] = keep(ingest.build_chunks(units, manifest, size), "chunks")
        out["report"] = ingest.chunk_counts(out["report"], out["chunks"])
        out["tokens"] = ingest.exclusive_quartiles(out["chunks"].select(F.col("n_tokens").cast("double").alias("v")))
        out["bounds"] = out["chunks"].agg(F.count_if(F.col("n_tokens") < size.least).alias("under"), F.count_if(F.col("n_tokens") > size.most).alias("over"))
    if "embed" in wanted:
        out["vectors"] = keep(drafts.stub_embeddings(out["chunks"].select("chunk_id", "text"), "chunk_id"), "vectors")
    if "index" in wanted:
        out["index"] = retrieve.sparse_index(out["chunks"])
    if dry_run:
        return {k: v.count() for k, v in out.items() if isinstance(v, DataFrame)}
    return out

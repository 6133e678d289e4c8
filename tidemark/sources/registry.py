"""Source jobs by name. One failing source is a row in `source_runs`, not a failed run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.schema import SOURCE_RUNS

Job = Callable[[SparkSession, str], DataFrame]
KINDS = {
    "readings": {"series", "ts", "value", "unit"},
    "headlines": {"url", "title", "domain"},
}


@dataclass(frozen=True)
class Source:
    name: str
    category: str
    kind: str
    job: Job
    priority: int
    note_when_empty: str | None = None


@dataclass
class Registry:
    sources: dict[str, Source] = field(default_factory=dict)

    def source(
        self, name: str, category: str, kind: str = "readings", note_when_empty: str | None = None
    ) -> Callable[[Job], Job]:
        """Register a job; its place in the registry is its priority."""
        if kind not in KINDS:
            raise ValueError(f"kind is one of {sorted(KINDS)}")

        def add(job: Job) -> Job:
            self.sources[name] = Source(name, category, kind, job, len(self.sources), note_when_empty)
            return job

        return add

    def run(self, spark: SparkSession, landing: str, out: str, run_id: str) -> DataFrame:
        """Write every source's rows under `out/<kind>` and return the run's outcomes.

        Each source is one write job, so what a source does wrong, at planning or at
        run time, stays with it. Rows are counted while they are written. A source
        without rows is an error unless it has a note for that case.
        """
        outcomes = []
        for s in self.sources.values():
            rows, error = 0, None
            try:
                rows = _write(s, s.job(spark, landing), f"{out}/{s.kind}", run_id)
                if rows == 0 and s.note_when_empty is None:
                    error = "returned nothing"
            except Exception as exc:  # noqa: BLE001 - any failure becomes that source's outcome
                error = f"{type(exc).__name__}: {exc}"
            readings, headlines = (rows, 0) if s.kind == "readings" else (0, rows)
            notes = int(error is None and rows == 0)
            outcomes.append(
                (run_id, s.name, error is None, error, readings, headlines, notes, datetime.now(UTC))
            )
        return spark.createDataFrame(outcomes, SOURCE_RUNS)


def _write(source: Source, df: DataFrame, path: str, run_id: str) -> int:
    missing = KINDS[source.kind] - set(df.columns)
    if missing:
        raise ValueError(f"columns missing: {', '.join(sorted(missing))}")
    key = "value" if source.kind == "readings" else "url"
    seen = Observation()
    (
        df.filter(F.col(key).isNotNull())
        .observe(seen, F.count(F.lit(1)).alias("rows"))
        .write.mode("overwrite")
        .parquet(f"{path}/run_id={run_id}/source_name={source.name}/source_priority={source.priority}")
    )
    return int(seen.get["rows"])

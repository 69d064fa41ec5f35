"""End-to-end refresh: extract -> validate (gate) -> typed reload -> models + tests -> release.

Every step is a Spark job over whole tables.  Nothing is written before the
validation gate passes.  Raw tables and models are staged in one release: each
layer is written as Parquet and read back from there, so the lineage is cut at
every layer and a lost executor only recomputes from the last written table.
All tests and the reconciliation run on the staged tables; only then one commit
makes all of them live together.  Where anything fails, readers stay on the
release before, and the staged versions are removed.
"""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tradelens.contracts import CONTRACTS, contract_for
from tradelens.operators.checks import GOLD_TESTS, SILVER_TESTS, assert_suite, run_suite
from tradelens.operators.quality import DataQualityError, gate
from tradelens.plans.models import LINEAGE, MODEL_ORDER, SILVER, SUPPORT, build_model, inputs_of, qualified, register_catalog
from tradelens.plans.reconcile import reconcile_revenue
from tradelens.session import run_concurrently, scratch_path, short_shuffles
from tradelens.sinks.releases import Release
from tradelens.sinks.reload import delete_path, stage_all
from tradelens.sources.landing import Landing
from tradelens.sources.typed import REJECTS, TYPE_REJECTED, quarantined, typed_view, validate_text, with_rejects

logger = logging.getLogger(__name__)


class ReconciliationError(AssertionError):
    """A mart's revenue total differs from the raw delivered revenue."""


@dataclass
class RefreshResult:
    raw_rows: dict[str, int] = field(default_factory=dict)
    model_rows: dict[str, int] = field(default_factory=dict)
    support_rows: dict[str, int] = field(default_factory=dict)
    tests: list[dict] = field(default_factory=list)
    warnings: list[dict] = field(default_factory=list)
    release: int = 0

    def table_rows(self) -> list[tuple[str, int]]:
        return [*self.raw_rows.items(), *self.model_rows.items()]


def validate_extracted(extracted: dict[str, DataFrame]) -> DataFrame:
    """Issues of the contract checks plus type rejects of every extracted dataset.

    One aggregate scan per dataset (plus the grouped duplicate-key count).
    """
    parts = [validate_text(df, CONTRACTS[name]) for name, df in extracted.items()]
    return reduce(DataFrame.unionByName, parts)


def _levels(names: list[str]) -> list[list[str]]:
    """Models grouped so that each group depends only on earlier groups."""
    done: set[str] = set()
    levels = []
    pending = list(names)
    while pending:
        ready = [
            n for n in pending
            if all(d.startswith("raw.") or d in done or d not in names for d in inputs_of(n))
        ]
        levels.append(ready)
        done.update(ready)
        pending = [n for n in pending if n not in ready]
    return levels


def _stage(spark: SparkSession, name: str, df: DataFrame, paths: list[str], discard: str | None = None) -> DataFrame:
    """The dataset as written text; then the ``discard`` folder it was read from goes."""
    if not df.columns:
        return df
    path = scratch_path(spark, f"stage-{name}")
    paths.append(path)
    with_rejects(df, CONTRACTS[name]).write.parquet(path)
    if discard:
        delete_path(spark, discard)
    return spark.read.parquet(path)


#: Column of the staged text that holds a record's source file.
SOURCE_FILE = "__source_file"


def _text(staged: DataFrame) -> DataFrame:
    return staged.drop(REJECTS, SOURCE_FILE)


def write_quarantine(staged: dict[str, DataFrame], folder: str) -> int:
    """Write the rejected values of staged datasets below ``folder``, one folder a table; their number."""
    rows = {n: quarantined(df, CONTRACTS[n], SOURCE_FILE) for n, df in staged.items() if REJECTS in df.columns}
    bad = reduce(DataFrame.unionByName, rows.values())
    seen = Observation(f"rejects_{uuid.uuid4().hex[:8]}")
    bad.observe(seen, F.count(F.lit(1)).alias("n")).write.partitionBy("table").parquet(folder)
    return int(seen.get["n"])


# Published tables are sorted within each file by their lookup keys (a local
# sort per task, no shuffle), so Parquet min/max statistics let a pushed key
# filter -- e.g. one seller's items -- skip row groups.
PUBLISH_SORT = {
    "order_items": ["order_id"],
    "fact_order_items": ["seller_id", "order_id"],
    "fact_orders": ["order_id"],
    "dim_customers": ["customer_id"],
    "dim_sellers": ["seller_id"],
    "dim_products": ["product_id"],
    "mart_seller_performance": ["seller_id"],
}


def publish_layer(release: Release, names: Iterable[str], env: dict[str, DataFrame], result: RefreshResult) -> None:
    """Build, stage and read back the named models, level by level.

    ``env`` maps ``raw.<table>`` and already staged models to DataFrames; it
    is extended with the staged (read-back) models.
    """
    for level in _levels(list(names)):
        frames = {name: build_model(name, env) for name in level}
        rows = run_concurrently(
            {
                n: (lambda n=n: release.write(frames[n], qualified(n), sort_within=PUBLISH_SORT.get(n)))
                for n in level
            }
        )
        for name in level:
            (result.support_rows if name in SUPPORT else result.model_rows)[qualified(name)] = rows[name]
            env[name] = release.read(qualified(name))


def _load_raw(
    release: Release, extracted: dict[str, DataFrame], result: RefreshResult, discard: Mapping[str, str]
) -> dict[str, DataFrame]:
    """Stage, validate and reload the extracted datasets; the new raw tables."""
    spark = release.spark
    # CSV is read once into columnar text, so the validation and the load below
    # scan Parquet, not the CSV again.
    staged: list[str] = []
    try:
        extracted = run_concurrently(
            {name: (lambda n=name, df=df: _stage(spark, n, df, staged, discard.get(n)))
             for name, df in extracted.items()}
        )

        logger.info("Step 3/7 — validating")
        text = {n: _text(df) for n, df in extracted.items()}
        try:
            result.warnings = gate(validate_extracted(text))
        except DataQualityError as e:
            if TYPE_REJECTED not in str(e):
                raise
            folder = f"{release.root}/_quarantine/{time.time_ns():020d}"
            n = write_quarantine(extracted, folder)
            raise DataQualityError(f"{e}; {n} rejected value(s) in {folder}") from e

        logger.info("Step 4/7 — loading raw tables")
        views = {n: typed_view(df, CONTRACTS[n]) for n, df in text.items()}
        result.raw_rows = stage_all(release, views, CONTRACTS)
    finally:  # also where a check stops the run
        for path in staged:
            delete_path(spark, path)
    return {f"raw.{n}": release.read(CONTRACTS[n].destination_table) for n in extracted}


def run_refresh(
    spark: SparkSession,
    source_dir: str,
    warehouse: str,
    *,
    datasets: Iterable[str] | None = None,
    trim_string_columns: bool = False,
    catalog: bool = False,
    discard_source: bool = False,
) -> RefreshResult:
    """Refresh everything from the CSV landing folder into the warehouse folder, as one release.

    ``catalog`` also points the catalog views ``schema.table`` at the new release.
    ``discard_source`` says that the landed files are the caller's scratch: each
    dataset's is deleted once its text is staged, whatever becomes of the run.
    """
    names = [contract_for(n).name for n in (CONTRACTS if datasets is None else datasets)]
    result = RefreshResult()
    with short_shuffles(spark), Release(spark, warehouse) as release:
        # Datasets that are not reloaded come from the warehouse; one that is missing
        # there ends the run before anything is written.
        env = {f"raw.{n}": release.read(c.destination_table) for n, c in CONTRACTS.items() if n not in names}

        logger.info("Step 1/7 — checking source files")
        landing = Landing(spark, source_dir, trim=trim_string_columns)
        landed = {c.name: landing.path(c) for c in landing.contracts(names)}

        logger.info("Step 2/7 — extracting")
        extracted = landing.read_all(names, SOURCE_FILE)

        env |= _load_raw(release, extracted, result, landed if discard_source else {})

        logger.info("Step 5/7 — silver models and tests")
        silver = [m for m in MODEL_ORDER if LINEAGE[m][0] == SILVER]
        publish_layer(release, silver, env, result)
        result.tests += assert_suite(run_suite(env, SILVER_TESTS))

        logger.info("Step 6/7 — gold models and tests")
        gold = [m for m in MODEL_ORDER if LINEAGE[m][0] != SILVER]
        publish_layer(release, [*SUPPORT, *gold], env, result)
        result.tests += assert_suite(run_suite(env, GOLD_TESTS))
        raw = {k[4:]: v for k, v in env.items() if k.startswith("raw.")}
        mismatches = [r.asDict() for r in reconcile_revenue(raw, env).collect()]
        if mismatches:
            raise ReconciliationError(f"revenue does not reconcile: {mismatches}")
        result.tests.append({"test": "reconcile_source_revenue", "n_failing": 0})

        logger.info("Step 7/7 — release")
        result.release = release.commit().number
    if catalog:
        register_catalog(spark, warehouse)
    return result

"""Typed access to the stored tables and the retail tables derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyhouse.session import scratch_dir
from tallyhouse.sources import derive
from tallyhouse.sources.schemas import STORED_SCHEMAS
from tallyhouse.sources.storage import replace_table

# Fact tables that other tables and queries read again and again: built once, written, then scanned.
FACT_TABLES = ("customer_journeys", "order_metrics", "inventory_events_keyed", "inventory_snapshots", "customer_snapshots",
               "supplier_deliveries", "simulation_scenarios")


class RetailTables:
    """``tables["customer_journeys"]`` -> DataFrame.

    Every table is a lazy plan over the parquet files. ``overrides`` supplies DataFrames to use in place
    of a derivation: fact tables that a deployment already stores, or hand-made rows in tests. With
    ``store_facts`` the first use of a fact table writes it as parquet into the shared scratch folder and
    every later use scans only the columns it needs.
    """

    def __init__(
        self,
        spark: SparkSession,
        sf_dir: str,
        overrides: dict[str, DataFrame] | None = None,
        store_facts: bool = False,
    ):
        self.spark, self.sf_dir, self.store_facts = spark, sf_dir.rstrip("/"), store_facts
        self._frames: dict[str, DataFrame] = dict(overrides or {})
        self.stored: dict[str, str] = {}  # where fact tables were written

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def __contains__(self, name: str) -> bool:
        return name in self._frames or name in STORED_SCHEMAS or name in derive.BUILDERS

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            if name in STORED_SCHEMAS:
                self._frames[name] = self.spark.read.schema(STORED_SCHEMAS[name]).parquet(self.path(name))
            else:
                built = derive.BUILDERS[name](self)
                stored = self.store_facts and name in FACT_TABLES
                if stored:
                    self.stored[name] = scratch_dir(self.spark, name)
                    built = replace_table(built, self.stored[name])
                self._frames[name] = built
        return self._frames[name]

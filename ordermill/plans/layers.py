"""The layers over the derived source, for the registered queries.

Silver and the Gold tables are Parquet tables in the shared folder, written when first
asked for and then read by every report of the session, as reports read a loaded Gold.
"""

import hashlib
import threading
import uuid

from ordermill.operators import dims, facts
from ordermill.operators.silver import (
    events_from_silver,
    newest_per_event,
    split_datetimes,
    with_load_metadata,
)
from ordermill.plans.star import Star
from ordermill.session import shared_folder
from ordermill.sources import derived
from ordermill.sources.store import clustered

_LOCK = threading.RLock()
_WRITTEN = {}


def silver_rows(spark, sf_dir):
    """Silver of the derived source, not stored."""
    bronze = derived.raw_sales(spark, sf_dir)
    return with_load_metadata(split_datetimes(newest_per_event(bronze)))


def source_events(spark, sf_dir):
    """Rebuilt events of the derived source, not stored."""
    return events_from_silver(silver_rows(spark, sf_dir))


def scratch(spark):
    """A new place in the shared folder for tables of one query."""
    return f"{shared_folder(spark)}/ordermill/runs/{uuid.uuid4().hex}"


def saved_events(spark, sf_dir):
    """The same from Silver written for one query, which reads them several times."""
    path, rows = f"{scratch(spark)}/silver", silver_rows(spark, sf_dir)
    rows.write.parquet(path, compression="zstd")
    return events_from_silver(spark.read.schema(rows.schema).parquet(path))


class Layers:
    def __init__(self, spark, sf_dir):
        self._spark, self._sf_dir = spark, sf_dir
        session = spark.sparkContext.applicationId
        place = hashlib.sha256(sf_dir.encode()).hexdigest()[:12]
        self._root = f"{shared_folder(spark)}/ordermill/{session}/{place}"

    def _table(self, name, build=None, write=None):
        """The table `name`: the frame that `build` gives, or what `write` leaves at a path."""
        with _LOCK:
            path = f"{self._root}/{name}"
            if path not in _WRITTEN:
                if write:
                    _WRITTEN[path] = write(path)
                else:
                    frame = build()
                    frame.write.mode("overwrite").parquet(path, compression="zstd")
                    _WRITTEN[path] = frame.schema
            return self._spark.read.schema(_WRITTEN[path]).parquet(path)

    def silver(self):
        return self._table("silver", lambda: silver_rows(self._spark, self._sf_dir))

    def events(self):
        return events_from_silver(self.silver())

    def dim_date(self):
        return self._table("dim_date", lambda: dims.dim_date(self.events()).coalesce(1))

    def _dim(self, name, rule, schema):
        empty = self._spark.createDataFrame([], schema)
        return self._table(name, lambda: dims.extend_dim(empty, self.events(), *rule))

    def dim_customer(self):
        return self._dim(
            "dim_customer", dims.CUSTOMER, "customer_key long, customer_id string"
        )

    def dim_product(self):
        return self._dim(
            "dim_product", dims.PRODUCT, "product_key long, product_id string, category string"
        )

    def fact_sales_events(self):
        return self._table(
            "fact_sales_events",
            write=lambda path: facts.write_event_facts(
                self.events(), self.dim_customer(), self.dim_product(), path
            ),
        )

    def order_states(self):
        return self._table(
            "order_states",
            lambda: clustered(
                facts.order_states(self.events(), self.dim_customer()), "paid_date_key"
            ),
        )

    def star(self):
        return Star.from_tables(
            self.dim_date(),
            self.dim_customer(),
            self.dim_product(),
            self.fact_sales_events(),
            self.order_states(),
        )

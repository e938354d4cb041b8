"""Price providers: a contract, a file-based one, and the gate that keeps network ones off by default."""

from __future__ import annotations

import os
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fathomline.sources.readers import price_observations, prices_between, read_rows


class ProviderDisabled(RuntimeError):
    """A network provider wasn't enabled."""


class PriceProvider(ABC):
    @abstractmethod
    def get_prices(self, permanent_id: str, start: str, end: str, as_of: str | None = None) -> DataFrame:
        """Observations from start to end, both included, known by as_of."""


class FilePriceProvider(PriceProvider):
    def __init__(self, spark: SparkSession, path: str, default_evidence: str | None = None) -> None:
        self.observations = price_observations(read_rows(spark, path), default_evidence)

    def get_prices(self, permanent_id: str, start: str, end: str, as_of: str | None = None) -> DataFrame:
        return prices_between(self.observations, permanent_id, start, end, as_of)

    get_observations = history = get_prices


class ProviderError(RuntimeError):
    """A connector's source failed; says for what."""


#: What a connector's fetch gives, for a symbol from a day up to another one that no longer counts: (day, value).
Fetch = Callable[[str, date, date], Iterable[tuple[date, float]]]


@dataclass
class Request(InputPartition):
    permanent_id: str
    symbol: str
    start: date
    end_exclusive: date


class _Requests(DataSourceReader):
    def __init__(self, fetch: Fetch, requests: list[Request], today: date, as_of: date | None) -> None:
        self.fetch, self.requests, self.today, self.as_of = fetch, requests, today, as_of

    def partitions(self) -> list[Request]:
        return [] if self.as_of is not None and self.as_of < self.today else self.requests

    def read(self, partition: Request):
        if not isinstance(partition, Request):  # no requests: Spark asks once, for nothing
            return
        try:
            for day, value in self.fetch(partition.symbol, partition.start, partition.end_exclusive):
                yield partition.permanent_id, partition.symbol, day, self.today, float(value)
        except Exception as e:
            raise ProviderError(f"{partition.symbol} from {partition.start} to before {partition.end_exclusive}: {type(e).__name__}: {e}") from e


class NetworkPriceProvider(PriceProvider):
    """The contract of an opt-in connector; connector() is for a subclass. Disabled unless asked for, by argument or environment. Prices retrieved after as_of count as unknown, and then nothing is fetched.

    Reads are a data source with a partition for each symbol and stretch of `days`, so they run in executors, side by side, and one that is lost is asked for again; no price goes through the driver. What fetch raises fails the job as a ProviderError that names symbol and days.
    """

    VARIABLE = "FATHOMLINE_ENABLE_NETWORK"
    SCHEMA = "permanent_id string, symbol string, observed_at date, evidence_available_at date, value double"

    def __init__(self, spark: SparkSession, enabled: bool | None = None, today: date | None = None, days: int = 366) -> None:
        if days < 1:
            raise ValueError("days must be positive")
        self.spark, self.today, self.days = spark, today or date.today(), days
        self.enabled = os.environ.get(self.VARIABLE, "").lower() in ("1", "true", "yes") if enabled is None else enabled

    def connector(self) -> Fetch:
        """A function that can be sent to executors, so without a session."""
        raise NotImplementedError

    def get_prices(self, permanent_id: str, start: str, end: str, as_of: str | None = None) -> DataFrame:
        return self.prices_of([permanent_id], start, end, as_of)

    def prices_of(self, permanent_ids: Sequence[str], start: str, end: str, as_of: str | None = None) -> DataFrame:
        """Prices of several ids from start to end, both included; an id that is named twice is read once."""
        if not self.enabled:
            raise ProviderDisabled(f"set {self.VARIABLE}=1 or enabled=True")
        first, stop = date.fromisoformat(start), date.fromisoformat(end) + timedelta(days=1)
        cuts = [*(first + timedelta(days=k) for k in range(0, (stop - first).days, self.days)), stop]
        requests = [Request(name, name.rpartition(":")[2].upper(), a, b) for name in dict.fromkeys(permanent_ids) for a, b in zip(cuts, cuts[1:], strict=False)]
        arguments = (self.connector(), requests, self.today, date.fromisoformat(as_of) if as_of is not None else None)
        schema = self.SCHEMA

        class Connector(DataSource):
            @classmethod
            def name(cls) -> str:
                return "fathomline_connector"

            def schema(self) -> str:
                return schema

            def reader(self, schema) -> DataSourceReader:
                return _Requests(*arguments)

        self.spark.dataSource.register(Connector)
        return self.spark.read.format("fathomline_connector").load()

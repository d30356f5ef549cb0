"""A Python data source of pages: a partition per page, Arrow batches out.

`fetch(page)` may call a REST service; here any picklable function serves."""

from __future__ import annotations

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Page(InputPartition):
    def __init__(self, number: int) -> None:
        self.number = number


class PagedReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.pages, self.size = int(options.get("pages", "1")), int(options.get("size", "100"))

    def partitions(self):
        return [Page(i) for i in range(self.pages)]

    def read(self, partition):
        import pyarrow as pa

        ids = range(partition.number * self.size, (partition.number + 1) * self.size)
        yield pa.RecordBatch.from_pydict({"order_id": pa.array(ids, pa.int64()), "amount": pa.array([i * 7 % 1000 / 10 for i in ids], pa.float64())})


class PagedOrders(DataSource):
    """format("paged_orders").option("pages", n).option("size", m)"""

    @classmethod
    def name(cls) -> str:
        return "paged_orders"

    def schema(self):
        return "order_id long, amount double"

    def reader(self, schema):
        return PagedReader(self.options)

"""Streaming source over an item store whose cursor is an item id.

Upstream numbers its items; a poll asks for the newest number and then for
every item after the last one it has seen. Here the store is a folder of
Parquet files (id, value: the item as JSON) that grows, and the cursor is the
stream's offset, kept in its checkpoint: a restart goes on after the last
committed id, with neither gap nor repeat, instead of starting again at the
newest.

    spark.dataSource.register(ItemIds)
    items = spark.readStream.format("item_ids").option("path", store).load()
    start_landing(spark, items_from_json_strings(items), root, checkpoint)

Options: ``path``; ``start``: "newest" (default, only what comes after the
first poll), "earliest", or an id; ``idsPerPartition`` (100,000): ids read by
one task. The newest id comes from the statistics in the files' footers, each
of which is opened once, so a poll costs what is new. A task reads the row
groups whose statistics meet its ids, file after file and ``BATCH_ROWS`` rows at
a time, so it holds some pages of one column chunk, not whole row groups or
files read ahead. Ids that the store does not hold are skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

BATCH_ROWS = 8192
BUFFER_BYTES = 1 << 20


class IdRange(InputPartition):
    def __init__(self, first: int, stop: int):
        super().__init__((first, stop))
        self.first, self.stop = first, stop


class ItemIds(DataSource):
    @classmethod
    def name(cls) -> str:
        return "item_ids"

    def schema(self) -> str:
        return "id bigint, value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ItemIdReader(dict(self.options))


class ItemIdReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        low = {k.lower(): v for k, v in options.items()}
        if "path" not in low:
            raise ValueError("option path is missing")
        self._path = low["path"]
        self._start = low.get("start", "newest")
        self._per = int(low.get("idsperpartition", 100_000))
        self._bounds: dict[str, tuple[int, int] | None] = {}

    def _dataset(self):
        import pyarrow.dataset as ds

        return ds.dataset(self._path, format="parquet", exclude_invalid_files=False)

    def _known(self) -> tuple[int, int]:
        """(least, greatest) id in the store; (0, -1) while it is empty."""
        try:
            fragments = list(self._dataset().get_fragments())
        except FileNotFoundError:
            return 0, -1
        for f in fragments:
            if f.path not in self._bounds:
                own = [g.statistics["id"] for g in f.row_groups if g.statistics and "id" in g.statistics]
                self._bounds[f.path] = (min(s["min"] for s in own), max(s["max"] for s in own)) if own else None
        found = [b for b in self._bounds.values() if b is not None]
        return (min(b[0] for b in found), max(b[1] for b in found)) if found else (0, -1)

    def initialOffset(self) -> dict:
        least, greatest = self._known()
        if self._start == "newest":
            return {"next": greatest + 1}
        return {"next": least if self._start == "earliest" else int(self._start)}

    def latestOffset(self) -> dict:
        return {"next": self._known()[1] + 1}

    def partitions(self, start: dict, end: dict) -> list[IdRange]:
        first, stop = int(start["next"]), int(end["next"])
        return [IdRange(a, min(a + self._per, stop)) for a in range(first, stop, self._per)]

    def read(self, partition: IdRange) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        for fragment in self._dataset().get_fragments():
            groups = [g.id for g in fragment.row_groups if _meets(g.statistics, partition)]
            if not groups:
                continue
            with fragment.open() as source:
                file = pq.ParquetFile(source, buffer_size=BUFFER_BYTES, pre_buffer=False)
                for batch in file.iter_batches(BATCH_ROWS, row_groups=groups, columns=["id", "value"], use_threads=False):
                    number = batch.column("id")
                    own = batch.filter(pc.and_(pc.greater_equal(number, partition.first), pc.less(number, partition.stop)))
                    if own.num_rows:
                        yield own
            pa.default_memory_pool().release_unused()


def _meets(statistics: dict | None, ids: IdRange) -> bool:
    """Whether a row group may hold some of these ids (one without statistics may)."""
    own = (statistics or {}).get("id")
    return own is None or (own["max"] >= ids.first and own["min"] < ids.stop)

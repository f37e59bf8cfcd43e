"""Packing as a table function, so that SQL can pack any table of items.

    register(spark)
    SELECT * FROM pack_items(TABLE(SELECT doc_id, n_chars, slice FROM ...) PARTITION BY slice ORDER BY doc_id, capacity => 8000, size => 'n_chars')
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.types import IntegralType, LongType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .packing import first_fit_decreasing


class PackItems:
    """The rows of each partition with bin and pos behind their columns, by first fit decreasing; ties keep the order of rows.

    capacity: of a bin; size: the column of sizes, whole numbers, nulls as 0; isolate: whether an item beyond the
    capacity gets a bin of its own behind the others, else it is an error. A partition is packed by one task and held
    there: cut large tables into slices.
    """

    @staticmethod
    def analyze(items: AnalyzeArgument, capacity: AnalyzeArgument, size: AnalyzeArgument | None = None, isolate: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not items.isTable:
            raise ValueError("pack_items takes a TABLE argument first")
        name = size.value if size is not None else "size"
        fields = {f.name: f for f in items.dataType.fields}
        if name not in fields or not isinstance(fields[name].dataType, IntegralType):
            raise ValueError(f"{name} is no column of whole numbers among {sorted(fields)}")
        if taken := {"bin", "pos"} & set(fields):
            raise ValueError(f"the table has columns {sorted(taken)} already")
        if not isinstance(capacity.value, int) or capacity.value < 1:
            raise ValueError("the capacity must be a whole number of 1 or more")
        return AnalyzeResult(StructType([*items.dataType.fields, StructField("bin", LongType()), StructField("pos", LongType())]))

    def __init__(self):
        self.rows: list[Row] = []
        self.options: tuple[int, str, bool] = (0, "size", False)

    def eval(self, items: Row, capacity: int, size: str = "size", isolate: bool = False) -> None:
        self.rows.append(items)
        self.options = (capacity, size, isolate)

    def terminate(self) -> Iterator[tuple]:
        capacity, size, isolate = self.options
        sizes = [r[size] or 0 for r in self.rows]
        big = [i for i, n in enumerate(sizes) if n > capacity]
        if big and not isolate:
            raise ValueError(f"items over the capacity of {capacity}: {[sizes[i] for i in big[:5]]}")
        fit = [i for i, n in enumerate(sizes) if n <= capacity]
        placed = dict(zip(fit, first_fit_decreasing([sizes[i] for i in fit], capacity), strict=True)) if fit else {}
        last = max((b for b, _ in placed.values()), default=-1)
        placed |= {i: (last + 1 + k, 0) for k, i in enumerate(big)}
        for i, row in enumerate(self.rows):
            yield (*row, *placed[i])


def register(spark: SparkSession, name: str = "pack_items") -> None:
    from pyspark.sql.functions import udtf

    spark.udtf.register(name, udtf(PackItems))

"""Tables: contingency tables as (row_id, col_id, value) rows, and what is derived from them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanloom.plans.ordinals import ranks

TYPES = ("string", "continuous", "discrete")


def _typed(kind: str) -> str:
    if kind not in TYPES:
        raise ValueError(f"a column's type must be one of {', '.join(TYPES)}")
    return kind


@dataclass(frozen=True)
class Table:
    """Cells of a table in long form: df has row_id, col_id, value.

    row_order and col_order, if df has them, place rows and columns as they were first
    seen; otherwise they are ordered by id. missing stands for cells that aren't there.
    """

    df: DataFrame
    header_row_id: str = "__col__"
    header_row_type: str = "string"
    header_col_id: str = "__row__"
    header_col_type: str = "string"
    col_types: dict[str, str] = field(default_factory=dict)
    class_col_id: str | None = None
    missing: float | str | None = None
    integer: bool = False

    def __post_init__(self):
        for k in (self.header_row_type, self.header_col_type, *self.col_types.values()):
            _typed(k)

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    def copy(self) -> Table:
        return replace(self)

    def with_df(self, df: DataFrame, **kw) -> Table:
        return replace(self, df=df, **kw)

    def _ids(self, which: str) -> list:
        order = f"{which}_order"
        first = F.min(order) if order in self.df.columns else F.lit(0)
        return [r[0] for r in self.df.groupBy(f"{which}_id").agg(first.alias("o")).orderBy("o", f"{which}_id").select(f"{which}_id").collect()]

    def row_ids(self) -> list:
        """Row ids in order. This collects them: for tables meant to be shown or exported."""
        return self._ids("row")

    def col_ids(self) -> list:
        return self._ids("col")

    def to_wide(self, cols: Sequence | None = None) -> DataFrame:
        """One row per row_id with a column per col_id, missing cells filled."""
        cols = list(cols if cols is not None else self.col_ids())
        order = [F.min("row_order").alias("_o")] if "row_order" in self.df.columns else []
        # first() instead of a sum: a cell is one row
        wide = self.df.groupBy("row_id").pivot("col_id", cols).agg(F.first("value").alias("v"), *order)
        if order:
            names = [f"{c}_v" for c in cols]
            o = F.least(*(F.col(f"`{c}__o`") for c in cols)) if len(cols) > 1 else F.col(f"`{cols[0]}__o`")
            wide = wide.orderBy(o, "row_id").select("row_id", *(F.col(f"`{n}`").alias(str(c)) for n, c in zip(names, cols, strict=True)))
        else:
            wide = wide.orderBy("row_id")
        return wide.na.fill(self.missing, [str(c) for c in cols]) if self.missing is not None and cols else wide

    def to_string(self, typed_headers: bool = False, col_delimiter: str = "\t", row_delimiter: str = "\n") -> str:
        """The table as delimited text, with three header lines of names, types and roles if typed_headers."""
        cols = self.col_ids()
        lines = [[self.header_col_id, *map(str, cols)]]
        if typed_headers:
            lines.append([self.header_col_type, *(self.col_types.get(c, "continuous") for c in cols)])
            lines.append(["", *("class" if c == self.class_col_id else ("meta" if self.col_types.get(c) == "string" else "") for c in cols)])
        for row in self.to_wide(cols).collect():
            lines.append(["" if v is None else str(v) for v in row])
        return row_delimiter.join(col_delimiter.join(x) for x in lines)

    def write_tsv(self, path: str, cols: Sequence | None = None) -> None:
        """The wide table as tab-separated files, written in parallel."""
        self.to_wide(cols).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)

    def to_ml(self) -> tuple:
        """(pandas table, {column: role}): string columns are metas, the class column last."""
        cols = self.col_ids()
        roles = {c: "class" if c == self.class_col_id else ("meta" if self.col_types.get(c) == "string" else self.col_types.get(c, "continuous")) for c in cols}
        order = sorted(cols, key=lambda c: (roles[c] == "class", roles[c] == "meta"))
        return self.to_wide(cols).select("row_id", *(F.col(f"`{c}`") for c in order)).toPandas(), roles

    def to_sorted(self, key_col=None, reverse_rows: bool = False, key_row=None, reverse_cols: bool = False) -> Table:
        """Rows by the values of a column (or by id), columns by those of a row; missing values first, ties by id."""
        df = self.df.drop("row_order", "col_order")

        def ranked(which: str, other: str, key, reverse: bool) -> DataFrame:
            v = F.max(F.when(F.col(f"{other}_id") == F.lit(key), F.col("value"))) if key is not None else F.lit(None).cast("double")
            ids = df.groupBy(f"{which}_id").agg(v.alias("v"))
            if key is not None and self.missing is not None:
                ids = ids.withColumn("v", F.coalesce("v", F.lit(self.missing)))
            keys = [F.col("v").desc_nulls_last(), F.col(f"{which}_id").desc()] if reverse else [F.col("v").asc_nulls_first(), F.col(f"{which}_id").asc()]
            return ranks(ids, *keys, name=f"{which}_order").select(f"{which}_id", f"{which}_order")

        df = df.join(ranked("row", "col", key_col, reverse_rows), "row_id")
        return self.with_df(df.join(ranked("col", "row", key_row, reverse_cols), "col_id"))


class CrossTab(Table):
    """Counts or weights of (context, unit): row_id is the context, col_id the unit."""

    @staticmethod
    def of(df: DataFrame, integer: bool = True, row: str = "__context__", col: str = "__unit__", **kw) -> CrossTab:
        return CrossTab(df, header_row_id=col, header_col_id=row, missing=0 if integer else 0.0, integer=integer, **kw)

    def unique(self, which: str) -> DataFrame:
        """Distinct row or col ids with the place where each is first seen."""
        order = f"{which}_order"
        first = F.min(order) if order in self.df.columns else F.lit(None).cast("long")
        return self.df.groupBy(f"{which}_id").agg(first.alias("first"))

    def to_transposed(self) -> CrossTab:
        swap = {"row_id": "col_id", "col_id": "row_id", "row_order": "col_order", "col_order": "row_order"}
        df = self.df.select(*(F.col(c).alias(swap.get(c, c)) for c in self.df.columns))
        return replace(self, df=df, header_row_id=self.header_col_id, header_col_id=self.header_row_id, header_row_type=self.header_col_type, header_col_type=self.header_row_type, col_types={})

    def to_weighted_flat(self) -> DataFrame:
        """(unit, context, weight) of the cells that aren't zero."""
        return self.df.where("value <> 0").select(F.col("col_id").alias("unit"), F.col("row_id").alias("context"), F.col("value").alias("weight"))

    def to_flat(self) -> DataFrame:
        """(unit, context), once per occurrence."""
        if not self.integer:
            raise ValueError("only a table of whole numbers can be made flat")
        return self.df.where("value > 0").select(F.col("col_id").alias("unit"), F.col("row_id").alias("context"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("value").cast("long"))).alias("_k")).drop("_k")

    @staticmethod
    def from_flat(flat: DataFrame) -> CrossTab:
        """Counts of (unit, context) rows."""
        return CrossTab.of(flat.groupBy(F.col("context").alias("row_id"), F.col("unit").alias("col_id")).agg(F.count(F.lit(1)).alias("value")))

    @staticmethod
    def from_weighted_flat(flat: DataFrame, integer: bool = True) -> CrossTab:
        """The table of (unit, context, weight) rows."""
        return CrossTab.of(flat.groupBy(F.col("context").alias("row_id"), F.col("unit").alias("col_id")).agg(F.sum("weight").alias("value")), integer)

    def _norm(self, by: Sequence[str], norm: str) -> Column:
        v = F.col("value").cast("double")
        size = F.sum(v) if norm == "l1" else F.sqrt(F.sum(v * v))
        return size.over(W.partitionBy(*by)) if norm == "l1" else F.sqrt(F.sum(v * v).over(W.partitionBy(*by)))

    def to_normalized(self, mode: str = "rows", norm: str = "l1") -> CrossTab:
        """rows, columns or table divided by their l1 or l2 norm; presence/absence; quotients; TF-IDF."""
        if norm not in ("l1", "l2"):
            raise ValueError("norm must be l1 or l2")
        v = F.col("value").cast("double")
        if mode in ("rows", "columns"):
            n = self._norm(["row_id" if mode == "rows" else "col_id"], norm)
            return self.with_df(self.df.withColumn("n", n).withColumn("value", F.when(F.col("n") == 0, 0.0).otherwise(v / F.col("n"))).drop("n"), integer=False, missing=0.0)
        if mode == "table":
            total = self.df.agg((F.sum(v) if norm == "l1" else F.sqrt(F.sum(v * v))).alias("n"))
            df = self.df.crossJoin(F.broadcast(total))  # one row
            return self.with_df(df.withColumn("value", F.when(F.col("n") == 0, 0.0).otherwise(v / F.col("n"))).drop("n"), integer=False, missing=0.0)
        if mode == "presence/absence":
            return self.with_df(self.df.withColumn("value", (F.col("value") > 0).cast("long")), integer=True, missing=0)
        if mode == "quotients":
            rows = self.df.groupBy("row_id").agg(F.sum(v).alias("rs"))
            cols = self.df.groupBy("col_id").agg(F.sum(v).alias("cs"))
            total = self.df.agg(F.sum(v).alias("t"))
            df = self.df.join(rows, "row_id").join(cols, "col_id").crossJoin(F.broadcast(total)).where("rs <> 0 AND cs <> 0")
            return self.with_df(df.withColumn("value", v * F.col("t") / (F.col("rs") * F.col("cs"))).drop("rs", "cs", "t"), integer=False, missing=None)
        if mode == "TF-IDF":
            n = self.df.agg(F.count_distinct("row_id").alias("r"))
            dfs = self.df.groupBy("col_id").agg(F.count_if(F.col("value") > 0).alias("d"))
            df = self.df.join(dfs, "col_id").crossJoin(F.broadcast(n))
            return self.with_df(df.withColumn("value", F.when(F.col("d") == 0, 0.0).otherwise(v * F.log(F.col("r") / F.col("d")))).drop("d", "r"), integer=False, missing=0.0)
        raise ValueError(f"unknown normalization {mode!r}")

    def to_document_frequency(self) -> CrossTab:
        """In how many contexts each unit occurs: one row, __document_frequency__."""
        df = self.df.groupBy("col_id").agg(F.count_if(F.col("value") > 0).alias("value"))
        return CrossTab.of(df.select(F.lit("__document_frequency__").alias("row_id"), "col_id", "value"))

    def to_association_matrix(self, bias: str = "none") -> CrossTab:
        """Markov associativity of the units: how likely a step by way of a shared context is.

        Exchange matrix E = F' diag(1/row sums) F / total; bias frequent gives E, none scales
        both sides by the square root of the units' weights, rare by the weights.
        """
        if bias not in ("none", "frequent", "rare"):
            raise ValueError("bias must be none, frequent or rare")
        v = F.col("value").cast("double")
        cells = self.df.where("value <> 0").select("row_id", "col_id", v.alias("f"))
        rows = cells.groupBy("row_id").agg(F.sum("f").alias("rs"))
        total = cells.agg(F.sum("f").alias("t"))
        a = cells.join(rows, "row_id")
        e = a.select("row_id", F.col("col_id").alias("x"), (F.col("f") / F.col("rs")).alias("fx")).join(cells.select("row_id", F.col("col_id").alias("y"), F.col("f").alias("fy")), "row_id")
        e = e.groupBy("x", "y").agg(F.sum(F.col("fx") * F.col("fy")).alias("e")).crossJoin(F.broadcast(total)).withColumn("e", F.col("e") / F.col("t"))
        if bias != "frequent":
            w = cells.groupBy("col_id").agg(F.sum("f").alias("w")).crossJoin(F.broadcast(total)).select("col_id", (F.col("w") / F.col("t")).alias("w"))
            scale = F.sqrt(F.col("wx") * F.col("wy")) if bias == "none" else F.col("wx") * F.col("wy")
            e = e.join(w.select(F.col("col_id").alias("x"), F.col("w").alias("wx")), "x").join(w.select(F.col("col_id").alias("y"), F.col("w").alias("wy")), "y").withColumn("e", F.col("e") / scale)
        return CrossTab.of(e.select(F.col("x").alias("row_id"), F.col("y").alias("col_id"), F.col("e").alias("value")), integer=False, row="__unit__", col="__unit2__")

    def to_numpy(self):
        """The dense matrix, rows and columns in order, missing cells 0."""
        wide = self.to_wide().toPandas().set_index("row_id")
        return wide.fillna(self.missing or 0).to_numpy()

    @staticmethod
    def from_numpy(spark: SparkSession, row_ids: Sequence, col_ids: Sequence, array, integer: bool = True) -> CrossTab:
        """The table of a dense matrix, zeros left out."""
        import numpy as np

        array = np.asarray(array)
        if integer and not np.issubdtype(array.dtype, np.integer):
            raise ValueError("a table of whole numbers needs an array of them")
        rows = [(str(row_ids[i]), str(col_ids[j]), array[i, j].item(), int(i), int(j)) for i, j in zip(*np.nonzero(array), strict=True)]
        kind = "long" if integer else "double"
        return CrossTab.of(spark.createDataFrame(rows, f"row_id string, col_id string, value {kind}, row_order long, col_order long"), integer)

    def top_units(self, n: int | None = None) -> DataFrame:
        """(unit, value) of a table with one context, by falling value."""
        d = self.df.groupBy(F.col("col_id").alias("unit")).agg(F.sum("value").alias("value")).orderBy(F.desc("value"), "unit")
        return d.limit(n) if n is not None else d

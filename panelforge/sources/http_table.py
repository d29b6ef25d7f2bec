"""Tables of a database that answers SQL over HTTP with tab-separated text, as a Spark data source.

    register(spark)
    spark.read.format("http_table").schema("ts_code string, trade_date string, close double").options(
        url=..., table=..., date="trade_date", start="20180101", end="20191231", months=3).load()

Each range of dates is a partition of its own, read by one request as the rows arrive. Columns that the schema names are asked for,
and filters that compare a column with values go along where the session lets Python sources have them. Addresses
and credentials come as options.
"""

from __future__ import annotations

import datetime
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual,
)
from pyspark.sql.types import StructType

from panelforge.sources import panel as P

#: Rows of a batch, seconds that a request may take, and how often it is tried.
BATCH, TIMEOUT, TRIES = 10_000, 120.0, 3
SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
#: How tab-separated text writes what it can't hold.
ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "0": "\0", "b": "\b", "f": "\f"}


def literal(value) -> str:
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, int | float):
        return repr(value)
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"


def condition(f: Filter) -> str | None:
    """The filter in SQL, if it is one that can be pushed."""
    if len(f.attribute if hasattr(f, "attribute") else ("", "")) != 1:
        return None
    column = f'"{f.attribute[0]}"'
    if isinstance(f, IsNotNull):
        return f"{column} IS NOT NULL"
    if isinstance(f, In):
        return f"{column} IN ({', '.join(map(literal, f.value))})" if f.value and None not in f.value else None
    sign = SIGNS.get(type(f))
    return f"{column} {sign} {literal(f.value)}" if sign and f.value is not None else None


def unescaped(cell: str) -> str | None:
    if cell == "\\N":
        return None
    if "\\" not in cell:
        return cell
    out, at = [], 0
    while (i := cell.find("\\", at)) >= 0 and i + 1 < len(cell):
        out += [cell[at:i], ESCAPES.get(cell[i + 1], cell[i + 1])]
        at = i + 2
    return "".join([*out, cell[at:]])


def ranges(start: str, end: str, months: int) -> list[tuple[str, str]]:
    """The days from ``start`` to ``end`` (yyyymmdd) as ranges of so many months, first and last day of each."""
    a, last, out = datetime.datetime.strptime(start, "%Y%m%d").date(), datetime.datetime.strptime(end, "%Y%m%d").date(), []
    while a <= last:
        n = a.year * 12 + a.month - 1 + months
        b = datetime.date(n // 12, n % 12 + 1, 1)
        out.append((a.strftime("%Y%m%d"), min(b - datetime.timedelta(1), last).strftime("%Y%m%d")))
        a = b
    return out


def answer(url: str, options: dict, sql: str) -> Iterator[str]:
    """Lines of the answer, as they arrive. What fails before the first of them is tried again."""
    login = {k: options[k] for k in ("user", "password") if k in options}
    request = urllib.request.Request(f"{url}/?{urllib.parse.urlencode(login)}", data=sql.encode(), method="POST")
    for left in range(TRIES - 1, -1, -1):
        try:
            response = urllib.request.urlopen(request, timeout=float(options.get("timeout", TIMEOUT)))
            break
        except urllib.error.HTTPError as e:
            if e.code < 500 or not left:
                raise RuntimeError(f"{e.code} from the database: {e.read(500).decode(errors='replace')}") from None
        except OSError:
            if not left:
                raise
        time.sleep(0.2 * (TRIES - left))
    with response:
        for line in response:
            yield line.decode().rstrip("\n")


@dataclass
class Dates(InputPartition):
    first: str | None
    last: str | None


class HttpTableReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options, self.pushed = schema, dict(options), []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if sql := condition(f):
                self.pushed.append(sql)
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and f.attribute == (self.options.get("date"),):
                    self._narrow(f)
            else:
                yield f

    def _narrow(self, f: Filter) -> None:
        """Dates that a filter on them leaves, so that no request is made for others."""
        day = str(f.value)
        if not (len(day) == 8 and day.isdigit()):
            return
        if not isinstance(f, LessThan | LessThanOrEqual) and day > self.options.get("start", day):
            self.options["start"] = day
        if not isinstance(f, GreaterThan | GreaterThanOrEqual) and day < self.options.get("end", day):
            self.options["end"] = day

    def partitions(self) -> list[Dates]:
        o = self.options
        if not all(k in o for k in ("date", "start", "end")):
            return [Dates(None, None)]
        found = [Dates(a, b) for a, b in ranges(o["start"], o["end"], int(o.get("months", 12)))]
        return found or [Dates("1", "0")]  # no day

    def sql(self, part: Dates) -> str:
        o = self.options
        columns = ", ".join(f'"{f.name}"' for f in self.schema.fields)
        where = [f"\"{o['date']}\" >= '{part.first}'", f"\"{o['date']}\" <= '{part.last}'"] if part.first else []
        where += ([f"({o['where']})"] if "where" in o else []) + self.pushed
        distinct = "DISTINCT " if o.get("distinct", "").lower() == "true" else ""
        return f"SELECT {distinct}{columns} FROM {o['table']}{' WHERE ' + ' AND '.join(where) if where else ''} FORMAT TSVWithNames"

    def read(self, partition: Dates) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(self.schema)
        lines = answer(self.options["url"].rstrip("/"), self.options, self.sql(partition))
        names = next(lines, "").split("\t")
        order = [names.index(f.name) for f in self.schema.fields] if names != [""] else []
        held: list[list[str | None]] = []

        def batch() -> pa.RecordBatch:
            columns = zip(*held) if held else [[] for _ in arrow]
            return pa.record_batch([self._column(pa.array(c, pa.string()), f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for line in lines:
            cells = line.split("\t")
            held.append([unescaped(cells[i]) for i in order])
            if len(held) == BATCH:
                yield batch()
                held = []
        yield batch()

    @staticmethod
    def _column(text: pa.Array, kind: pa.DataType) -> pa.Array:
        import pyarrow.compute as pc

        if pa.types.is_string(kind):
            return text
        text = pc.if_else(pc.equal(text, ""), pa.scalar(None, pa.string()), text)
        if pa.types.is_date(kind):
            plain = pc.replace_substring(text, "-", "")
            return pc.strptime(plain, "%Y%m%d", "s").cast(kind)
        return text.cast(kind)


class HttpTable(DataSource):
    """Options: url, table; user, password, timeout; date (a column of yyyymmdd), start, end and months (of a partition); where; distinct."""

    @classmethod
    def name(cls) -> str:
        return "http_table"

    def schema(self) -> str:
        raise ValueError("http_table needs a schema: the columns to ask for")

    def reader(self, schema: StructType) -> HttpTableReader:
        if missing := [k for k in ("url", "table") if k not in self.options]:
            raise ValueError(f"http_table needs the options {missing}")
        return HttpTableReader(schema, self.options)


def register(spark: SparkSession) -> None:
    """Make the source known; with it, filters may be handed to Python sources."""
    spark.dataSource.register(HttpTable)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def http_table(spark: SparkSession, table: str, schema: str, distinct: bool = False, where: str | None = None, **options: str) -> DataFrame:
    register(spark)
    more = {"distinct": str(distinct).lower()} | ({"where": where} if where else {})
    return spark.read.format("http_table").schema(schema).options(table=table, **options, **more).load()


def http_panel(
    spark: SparkSession, start: str, end: str, prices: str = "daily", returns: str | None = None, target: str = "fwd_20", index: tuple[str, str] | None = None, most: int = 800,
    least_presence: float = 0.8, sizes: str | None = None, industries: str | None = None, **options: str,
) -> DataFrame:
    """The dense panel of a database's tables from ``start`` to ``end`` (yyyymmdd).

    Instruments are the members of the snapshots in ``index`` (table, code), or else the ``most`` liquid; they are
    joined to the other tables, however many they are. ``returns``: a table with the ``target``, which becomes fwd; ``sizes``: one with
    circ_mv, which gives log_mv where it is positive; ``industries``: one of membership intervals, read without repeats.
    ``options``: of the source.
    """
    dated = dict(date="trade_date", start=start, end=end) | options
    day = lambda c: F.to_date(F.col(c), "yyyyMMdd")
    keyed = [day("trade_date").alias("date"), F.col("ts_code").alias("instrument")]
    mean = (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4
    raw = http_table(spark, prices, "ts_code string, trade_date string, open double, high double, low double, close double, vol double, amount double", **dated)
    bars = raw.select(*keyed, "open", "high", "low", "close", F.col("vol").alias("volume"), mean.alias("vwap"), "amount")
    snapshots = None
    if index:
        table, code = index
        before = (datetime.datetime.strptime(start, "%Y%m%d").replace(day=1) - datetime.timedelta(35)).replace(day=1).strftime("%Y%m%d")  # so that the first dates have one
        rows = http_table(spark, table, "index_code string, con_code string, trade_date string", **(dated | {"start": before}))
        snapshots = rows.where(F.col("index_code") == code).select(day("trade_date").alias("date"), F.col("con_code").alias("instrument")).distinct()
        names = snapshots.select("instrument").distinct()
    else:
        names = P.most_liquid(bars, most, least_presence).select("instrument")
    panel = P.dense(bars.drop("amount").join(names, "instrument", "left_semi"))
    if returns:
        fwd = http_table(spark, returns, f"ts_code string, trade_date string, {target} double", **dated).select(*keyed, P.clean(F.col(target)).alias("fwd"))
        panel = panel.join(fwd, ["date", "instrument"], "left")
    if sizes:
        mv = http_table(spark, sizes, "ts_code string, trade_date string, circ_mv double", **dated).where(F.col("circ_mv") > 0)
        panel = panel.join(mv.select(*keyed, F.ln("circ_mv").alias("log_mv")), ["date", "instrument"], "left")
    if industries:
        rows = http_table(spark, industries, "ts_code string, l1_code string, in_date string, out_date string", distinct=True, **options)
        spans = rows.join(names.withColumnRenamed("instrument", "ts_code"), "ts_code", "left_semi").select(
            F.col("ts_code").alias("instrument"), F.col("l1_code").alias("industry"), *(F.try_to_date(F.col(c), "yyyyMMdd").alias(c) for c in ("in_date", "out_date")), F.lit(0).alias("seq")
        )
        panel = P.industry_on(panel, spans)
    return P.universe_asof(panel, snapshots) if snapshots is not None else panel

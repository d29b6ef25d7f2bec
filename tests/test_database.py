"""The HTTP table source against a server in the test, and the industry table."""

import datetime
import re
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import duckdb
import pytest
from pyspark.sql import functions as F

from panelforge.sources import industry
from panelforge.sources.http_table import http_panel, http_table, literal, ranges, unescaped


class Database:
    """SQL over HTTP from an in-memory database; ``asked`` has every statement."""

    def __init__(self):
        self.db, self.asked, self.failures, self.lock = duckdb.connect(), [], 0, threading.Lock()
        days = "strftime(date '2020-01-01' + (i // 12)::int, '%Y%m%d')"
        self.db.execute(f"""create table daily as select 'n' || (i % 12) ts_code, {days} trade_date, 10 + i % 7 + 0.5 open, 12 + i % 7 high, 9 + i % 7 low, 10 + i % 7 "close",
            100.0 * (1 + i % 12) vol, 1000.0 * (1 + i % 12) amount from range(12 * 90) t(i) where i % 12 <> 3 or i < 300""")
        self.db.execute(f"create table fwd as select 'n' || (i % 12) ts_code, {days} trade_date, case when i % 50 = 0 then 'inf'::double else i / 1000.0 end fwd_20 from range(12 * 90) t(i)")
        self.db.execute(f"create table mv as select 'n' || (i % 12) ts_code, {days} trade_date, case when i % 40 = 0 then 0.0 else 1.0 + i end circ_mv from range(12 * 90) t(i)")
        self.db.execute("""create table member as select * from (values ('n0', 'A', '20190101', ''), ('n0', 'A', '20190101', ''), ('n1', 'A', '20190101', '20200201'), ('n1', 'B', '20200201', ''))
            t(ts_code, l1_code, in_date, out_date)""")
        self.db.execute("create table weights as select * from (values ('X', 'n0', '20191130'), ('X', 'n1', '20191130'), ('X', 'n1', '20200215'), ('X', 'n2', '20200215'), ('Y', 'n5', '20200101')) t(index_code, con_code, trade_date)")
        self.db.execute("create table odd as select * from (values (1, 'tab\there', null, '20200101'), (2, 'line\nand \\ and ''', 1.5, '20200102'), (3, '', -0.25, '20200103')) t(i, s, x, d)")
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):
                sql = self.rfile.read(int(self.headers["Content-Length"])).decode()
                login = parse_qs(urlparse(self.path).query)
                with outer.lock:
                    outer.asked.append(sql)
                    outer.failures -= outer.failures > 0
                    broken = outer.failures > 0
                if broken or login.get("password", ["right"]) != ["right"]:
                    self.send_error(503 if broken else 403)
                    return
                text = re.sub(r" FORMAT TSVWithNames$", "", sql)
                text = re.sub(r"'((?:[^'\\]|\\.)*)'", lambda m: "'" + re.sub(r"\\(.)", r"\1", m[1]).replace("'", "''") + "'", text)
                with outer.lock:
                    found = outer.db.execute(text)
                    names, rows = [d[0] for d in found.description], found.fetchall()
                cell = lambda v: "\\N" if v is None else str(v).replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n")
                body = "\n".join(["\t".join(names), *("\t".join(map(cell, r)) for r in rows)]) + "\n"
                self.send_response(200)
                self.end_headers()
                self.wfile.write(body.encode())

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}"

    def sent(self, run):
        self.asked.clear()
        return run(), list(self.asked)


@pytest.fixture(scope="module")
def base():
    d = Database()
    yield d
    d.server.shutdown()


def test_ranges_and_text():
    assert ranges("20191215", "20200210", 1) == [("20191215", "20191231"), ("20200101", "20200131"), ("20200201", "20200210")]
    assert ranges("20200101", "20191231", 1) == [] and ranges("20200101", "20210101", 12) == [("20200101", "20201231"), ("20210101", "20210101")]
    assert literal("it's \\") == "'it\\'s \\\\'" and literal(3) == "3" and unescaped("a\\tb\\\\n\\N") == "a\tb\\nN" and unescaped("\\N") is None


def test_a_partition_for_each_range_and_filters_pushed(spark, base):
    df = http_table(spark, "daily", "ts_code string, trade_date string, close double", url=base.url, date="trade_date", start="20200101", end="20200330", months="1")
    rows, asked = base.sent(df.where((F.col("ts_code").isin("n1", "n2")) & (F.col("trade_date") >= "20200210") & (F.col("close") > 11)).collect)
    want = base.db.execute("select count(*) from daily where ts_code in ('n1', 'n2') and trade_date >= '20200210' and \"close\" > 11").fetchall()[0][0]
    assert len(rows) == want > 0 and len(asked) == 2  # not January's
    assert all(re.search(r'"ts_code" IN \(\'n1\', \'n2\'\) .*"close" > 11', s) or re.search(r'"close" > 11', s) and "IN (" in s for s in asked)
    assert http_table(spark, "daily", "ts_code string", url=base.url).rdd.getNumPartitions() == 1
    none, asked = base.sent(df.where(F.col("trade_date") > "20210101").collect)
    assert none == [] and len(asked) <= 1


def test_text_nulls_dates_and_repeats(spark, base):
    df = http_table(spark, "odd", "i long, s string, x double, d date", url=base.url)
    assert [tuple(r) for r in df.orderBy("i").collect()] == [
        (1, "tab\there", None, datetime.date(2020, 1, 1)), (2, "line\nand \\ and '", 1.5, datetime.date(2020, 1, 2)), (3, "", -0.25, datetime.date(2020, 1, 3)),
    ]
    assert [r.i for r in df.where(F.col("s") == "line\nand \\ and '").collect()] == [2]
    plain, once = (http_table(spark, "member", "ts_code string, l1_code string", distinct=d, url=base.url).count() for d in (False, True))
    assert (plain, once) == (4, 3)
    assert http_table(spark, "odd", "i long", where="i > 99", url=base.url).count() == 0


def test_a_failing_server_is_asked_again_and_a_refusal_told(spark, base):
    base.failures = 3  # the first two requests
    assert http_table(spark, "odd", "i long", url=base.url).count() == 3
    with pytest.raises(Exception, match="403 from the database"):
        http_table(spark, "odd", "i long", url=base.url, user="u", password="wrong").count()
    with pytest.raises(Exception, match="needs the options"):
        http_table(spark, "odd", "i long").count()


def test_liquid_panel_with_target_size_and_industry(spark, base):
    p = http_panel(spark, "20200101", "20200330", "daily", "fwd", most=4, sizes="mv", industries="member", url=base.url, months="1").cache()
    assert {r.instrument for r in p.select("instrument").distinct().collect()} == {"n8", "n9", "n10", "n11"} and p.count() == 360
    row = p.where("instrument = 'n8' and date = '2020-01-02'").first()
    assert row.vwap == (row.open + row.high + row.low + row.close) / 4 and row.fwd == 0.02 and row.industry is None
    assert p.where("isnan(fwd) or abs(fwd) = 'Infinity'").count() == 0 and p.where("fwd is null").count() == len([i for i in range(0, 1080, 50) if i % 12 > 7])
    assert p.where("log_mv is null").count() == 360 - base.db.execute("select count(*) from mv where circ_mv > 0 and ts_code in ('n8', 'n9', 'n10', 'n11')").fetchall()[0][0]


def test_index_panel_follows_its_snapshots(spark, base):
    p = http_panel(spark, "20200101", "20200330", "daily", index=("weights", "X"), industries="member", url=base.url, months="1").cache()
    members = {(r.date.isoformat(), r.instrument) for r in p.where("in_universe").select("date", "instrument").collect()}
    assert {i for d, i in members if d < "2020-02-15"} == {"n0", "n1"} and {i for d, i in members if d >= "2020-02-15"} == {"n1", "n2"}
    got = {r.industry: r.n for r in p.where("instrument = 'n1'").groupBy("industry").agg(F.count("*").alias("n")).collect()}
    assert got == {"A": 31, "B": 59}


MEMBERS = "l1_code string, l3_code string, ts_code string, in_date string, out_date string"


def test_a_load_done_twice_leaves_what_it_leaves_once(spark, tmp_path):
    path = str(tmp_path / "industry")
    first = [("A", "a1", "x", "20100101", None), ("A", "a1", "y", "20120101", "20190101"), ("A", "a1", "y", "20120101", ""), ("B", "b1", "z", "20150101", "")]
    load = lambda rows: industry.write_memberships(spark.createDataFrame(rows, MEMBERS), path, "20180102")
    assert load(first) == load(first) == industry.Counts(3, "20100101", 2, 3)
    kept = spark.read.parquet(path)
    assert kept.count() == 3 and set(industry.COLUMNS) == set(kept.columns) and kept.where("l2_name <> ''").count() == 0
    assert kept.where("ts_code = 'y'").first().out_date == "20190101"
    assert load([("B", "b2", "z", "20200101", "")]) == industry.Counts(1, "20200101", 1, 0)
    assert {(r.l1_code, r.ts_code) for r in spark.read.parquet(path).collect()} == {("A", "x"), ("A", "y"), ("B", "z")}  # A's partition stays
    assert industry.write_memberships(spark.createDataFrame([], MEMBERS), path, "20180102") == industry.Counts(0, None, 0, 0)
    assert spark.read.parquet(path).count() == 3

"""Paged pulls from a server on this machine that fails now and then."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from lumicat.sources import paged


@pytest.fixture
def server():
    """Pages of items; ``fail`` says how often each page is refused first, ``seen`` counts what was asked for."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            number = int(self.path.rpartition("=")[2])
            web.seen[number] += 1
            status = 200 if web.seen[number] > web.fail.get(number, 0) else web.status
            rows = [{"id": 10 * number + k, "name": f"n{k}", "price": k, "more": {"b": [number], "a": 1}} for k in range(3)] if number != 4 else []
            body = json.dumps({"meta": {"pages": web.pages}, "data": {"items": rows}}).encode() if status == 200 else b"busy"
            self.send_response(status)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    web = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    web.pages, web.fail, web.seen, web.status = 7, {}, Counter(), 503
    threading.Thread(target=web.serve_forever, daemon=True).start()
    yield web
    web.shutdown()


def options(web, **more):
    return {"url": f"http://127.0.0.1:{web.server_port}/p?page={{page}}", "total_field": "meta.pages", "items": "data.items", "range": "2", "wait": "0.01", **more}


SCHEMA = "id long, name string, price double, more string, lacking int"


def wanted(pages):
    return sorted((10 * p + k, f"n{k}", float(k), json.dumps({"a": 1, "b": [p]}), None) for p in pages if p != 4 for k in range(3))


def test_pages_side_by_side(spark, server):
    paged.register(spark)
    server.fail = {2: 2, 5: 2}
    rows = spark.read.format("paged_json").schema(SCHEMA).options(**options(server)).load()
    assert rows.rdd.getNumPartitions() == 4
    server.seen.clear()
    assert sorted(map(tuple, rows.collect())) == wanted(range(1, 8))
    assert server.seen[5] == 3 and server.seen[6] == 1  # refused twice, then given


def test_errors_that_stay(spark, server):
    paged.register(spark)
    server.fail = {3: 10**6}
    with pytest.raises(Exception, match="503"):
        spark.read.format("paged_json").schema(SCHEMA).options(**options(server, retries="1")).load().collect()
    server.status = 404
    server.seen.clear()
    with pytest.raises(Exception, match="404"):
        spark.read.format("paged_json").schema(SCHEMA).options(**options(server, pages="3")).load().collect()
    assert server.seen[3] <= spark.sparkContext.defaultParallelism * 4  # not asked again within a task
    with pytest.raises(Exception, match="page"):
        spark.read.format("paged_json").schema(SCHEMA).options(url="http://nowhere").load().collect()


def test_no_pages(spark, server):
    paged.register(spark)
    server.pages = 0
    assert spark.read.format("paged_json").schema(SCHEMA).options(**options(server)).load().collect() == []


def test_stream_goes_on_behind_its_offset(spark, server, tmp_path):
    paged.register(spark)

    def run():
        server.seen.clear()
        stream = spark.readStream.format("paged_json").schema(SCHEMA).options(**options(server)).load()
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/offsets").trigger(availableNow=True).start().awaitTermination()
        return sorted(map(tuple, spark.read.schema(SCHEMA).parquet(f"{tmp_path}/out").collect()))

    server.pages = 3
    assert run() == wanted(range(1, 4))
    server.pages, server.fail = 6, {5: 2}
    assert run() == wanted(range(1, 7))
    assert server.seen[2] == server.seen[3] == 0 and server.seen[5] == 3  # page 1 only tells the number of pages
    assert run() == wanted(range(1, 7))

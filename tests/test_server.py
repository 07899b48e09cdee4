import json
import threading
import urllib.error
import urllib.request

import pytest

from gaugeframe.plans.server import serve


@pytest.fixture
def base(spark):
    server = serve(spark, port=0, origins=("http://ui",))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_address[1]}"
    server.shutdown()


def call(url, data=None, kind="application/json"):
    request = urllib.request.Request(url, data, {"Content-Type": kind, "Origin": "http://ui"})
    try:
        with urllib.request.urlopen(request, timeout=300) as r:
            return r.status, json.loads(r.read()), r.headers
    except urllib.error.HTTPError as e:
        return e.code, json.loads(e.read()), e.headers


def test_server(spark, base, tmp_path):
    assert call(f"{base}/health")[:2] == (200, {"status": "ok"})
    spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "text string, label string").write.parquet(str(tmp_path / "train"))
    status, report, headers = call(f"{base}/analyze/hf", json.dumps({"dataset": str(tmp_path)}).encode())
    assert status == 200 and report["meta"]["rows"] == 3 and headers["Access-Control-Allow-Origin"] == "http://ui"
    body = b'--b\r\nContent-Disposition: form-data; name="file"; filename="a.csv"\r\n\r\ntext,kind\na,x\nb,y\n\r\n--b\r\nContent-Disposition: form-data; name="label_col"\r\n\r\nkind\r\n--b--\r\n'
    status, report, _ = call(f"{base}/analyze/csv", body, "multipart/form-data; boundary=b")
    assert status == 200 and report["meta"]["loader"]["renamed_columns"] == {"kind": "label"}
    assert call(f"{base}/analyze/hf", b"{}")[0] == 400
    assert call(f"{base}/analyze/hf", json.dumps({"dataset": str(tmp_path), "text_col": "nope"}).encode())[0] == 400
    assert call(f"{base}/analyze/csv", b"x", "text/plain")[0] == 400
    assert call(f"{base}/nope")[0] == 404

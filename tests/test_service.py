"""Map service and manifest as data sources, against a server of our own."""
import json
import threading
import urllib.parse
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from pathloom.sources import paths, service

SEEN, FAILS, LOCK = [], Counter(), threading.Lock()
MANIFEST = {"planner": {"network_path": "net.json", "network_version": "p1", "background_network_path": "back.json?x=1&v=old", "background_network_version": "p2"}, "areas": [{"id": "a"}, {"id": "b", "network_path": "sub/b.json", "network_version": "b1"}]}
EDITOR = {"meta": {"route_policy_path": "../policy.json", "route_policy_digest": "d1"}, "editor": {"network_path": "ways.json", "network_version": "w1"}}


class Handler(BaseHTTPRequestHandler):
    def _say(self, status, text):
        self.send_response(status)
        self.end_headers()
        self.wfile.write(text.encode())

    def do_POST(self):
        form = urllib.parse.parse_qs(self.rfile.read(int(self.headers["Content-Length"])).decode())
        with LOCK:
            FAILS[form["data"][0]] += 1
            n = FAILS[form["data"][0]]
        if "rel(3)" in form["data"][0] or n == 1:
            return self._say(503, "busy")
        if n == 2:
            return self._say(200, "{broken")
        self._say(200, json.dumps({"elements": [], "query": form["data"][0]}))

    def do_GET(self):
        with LOCK:
            SEEN.append(self.path)
        known = {"/web/app.json": MANIFEST, "/web/editor.json": EDITOR}
        if self.path.startswith("/web/none"):
            return self._say(404, "")
        self._say(200, json.dumps(known.get(self.path, {"path": self.path})))

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def url():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_query_text():
    lines = ["[out:json][timeout:60];", "rel(7)->.rel0;", ".rel0 map_to_area->.area0;", "way(9)->.boundaryWay0;", ".boundaryWay0 map_to_area->.boundaryWayArea0;", "(", "  .rel0;", "  way(r.rel0);", "  way(area.area0);", "  .boundaryWay0;", "  way(area.boundaryWayArea0);", ");", "(._;>;);", "out body;"]
    assert service.area_query([7], [9], 60).split("\n") == lines


def test_areas(spark, url):
    areas = [{"area": "x", "relations": [1, 2]}, {"area": "y", "ways": [5]}]
    df = service.map_areas(spark, url, areas, tries=3, pause=0, timeout=20)
    assert df.rdd.getNumPartitions() == 2
    found = {r.area: json.loads(r.text)["query"] for r in df.collect()}
    assert found == {"x": service.area_query([1, 2], [], 20), "y": service.area_query([], [5], 20)}
    with pytest.raises(Exception, match="no answer after 2 tries"):
        service.map_areas(spark, url, [{"area": "z", "relations": [3]}], tries=2, pause=0).collect()


def test_manifest(spark, url):
    found = {(r.owner, r.kind): r.url for r in service.manifest_assets(spark, f"{url}/web/app.json").collect()}
    assert found == {("", "manifest"): f"{url}/web/app.json", ("a", "network"): f"{url}/web/net.json?v=p1", ("a", "background"): f"{url}/web/back.json?x=1&v=p2", ("b", "network"): f"{url}/web/sub/b.json?v=b1", ("b", "background"): f"{url}/web/back.json?x=1&v=p2"}
    assert "/web/net.json?v=p1" in SEEN
    editor = {r.kind: (r.url, r.text) for r in service.manifest_assets(spark, f"{url}/web/editor.json").collect()}
    assert editor["policy"][0] == f"{url}/policy.json?v=d1" and json.loads(editor["network"][1]) == {"path": "/web/ways.json?v=w1"}
    with pytest.raises(Exception, match="failed to load none.json: 404"):
        service.manifest_assets(spark, f"{url}/web/none.json").collect()


def test_paths(spark, tmp_path):
    (tmp_path / "raw.json").write_text("{}")
    raw, patched = f"{tmp_path}/raw.json", f"{tmp_path}/patched.json"
    assert paths.first_there(spark, patched, raw) == raw
    (tmp_path / "patched.json").write_text("{}")
    assert paths.first_there(spark, patched, raw) == patched and paths.first_there(spark, f"{tmp_path}/x", f"{tmp_path}/y") == f"{tmp_path}/y"
    assert paths.beside("/data/routes/r.json", "../graph.json") == "/data/graph.json" and paths.beside("/a/b.json", "/c.json") == "/c.json" and paths.beside("s3://k/a/b.json", "c.json") == "s3://k/a/c.json"
    assert paths.shown("/root/x/data/a.json", "/root/x") == "data/a.json" and paths.shown("/other/a.json", "/root/x") == "/other/a.json" and paths.shown("/root/xy/a", "/root/x") == "/root/xy/a"
    with pytest.raises(ValueError, match="unknown elevation provider"):
        service.provider("none", "http://x")

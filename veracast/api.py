"""The metrics over HTTP: python -m veracast.api DATA_ROOT [PORT].

GET /                                      a greeting
GET /api/healthcheck                       is it alive?
GET /metrics/info                          descriptors of metrics, by data_modalities, validation_domains, metric_categorys
GET /metrics/<modality>                    a report of the metrics of some attributes
GET /metrics/<modality>/specific-metrics   a report of the metrics named

Reports take validation_domain, reference_type, evaluation_level,
metric_category and metric_group, or metric_names; and target_data,
reference_data and annotation_file, which are paths below DATA_ROOT. Parameters may be
repeated. Answers are JSON; 404, 400, 422 and 501 say what is wrong.

One server holds one Spark session, and requests share its scheduler.
"""

from __future__ import annotations

import json
import posixpath
import sys
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from veracast import cli
from veracast.plans import registry

MODALITIES = ("image", "time_series", "tabular")
DOMAINS = {"input_val": "input_val", "synthesis_val": "synthesis_val", "input": "input_val", "synth": "synthesis_val"}
ALLOWED = {
    "data_modalities": MODALITIES, "validation_domains": tuple(DOMAINS), "metric_categorys": ("data", "feature", "annotation"), "validation_domain": tuple(DOMAINS), "reference_type": ("dataset", "instance", "none"),
    "evaluation_level": ("dataset", "instance"), "metric_category": ("data", "feature", "annotation"), "metric_group": ("quality", "privacy", "utility", "validity"),
    "metric_names": None, "target_data": None, "reference_data": None, "annotation_file": None,
}
Answer = tuple[int, dict]


class Service:
    """Answers requests from the tables, signals and pictures below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def answer(self, url: str) -> Answer:
        parts = urlsplit(url)
        asked = parse_qs(parts.query)
        refuse = lambda status, text: (status, {"msg": text, "inputs": asked, "type": "error"})
        for name, values in asked.items():
            known = ALLOWED.get(name, ())
            if known is not None and (wrong := [v for v in values if v not in known]):
                return refuse(422, f"{name}: {', '.join(wrong)} not among {', '.join(known) or 'the parameters'}")
        path = [p for p in parts.path.split("/") if p]
        try:
            if not path:
                return 200, {"message": "Welcome from the API."}
            if path == ["api", "healthcheck"]:
                return 200, {"message": "API is alive!"}
            if path == ["metrics", "info"]:
                return self._info(asked)
            if path[0] == "metrics" and len(path) in (2, 3) and path[2:] in ([], ["specific-metrics"]):
                if path[1] not in MODALITIES:
                    return refuse(422, f"no modality {path[1]}")
                return self._report(path[1], asked, named=len(path) == 3)
        except (registry.NotFound, registry.NotImplemented_, registry.BadInput) as refused:
            return refuse(refused.status, str(refused))
        return refuse(404, f"nothing at {parts.path}")

    def _info(self, asked: dict[str, list[str]]) -> Answer:
        known = registry.registry(self.spark)
        for column, values in (("modality", asked.get("data_modalities")), ("domain", [DOMAINS[d] for d in asked.get("validation_domains", [])]), ("category", asked.get("metric_categorys"))):
            if values:
                known = known.where(F.col(column).isin(values))
        found = {r["id"]: {k: v for k, v in r.asDict().items() if k != "id"} for r in registry.described(known).collect()}  # the catalogue
        if not found:
            raise registry.NotFound("no metric of these attributes")
        return 200, {k: {n: None if isinstance(v, float) and abs(v) == float("inf") else v for n, v in own.items()} for k, own in found.items()}

    def _path(self, asked: dict[str, list[str]], name: str) -> str | None:
        if name not in asked:
            return None
        below = posixpath.normpath(asked[name][0])
        if below.startswith(("/", "..")):
            raise registry.BadInput(f"{name} isn't below the folder of data")
        return f"{self.root}/{below}"

    def _report(self, modality: str, asked: dict[str, list[str]], named: bool) -> Answer:
        target = self._path(asked, "target_data")
        if target is None:
            raise registry.BadInput("target_data is needed")
        if named and not asked.get("metric_names"):
            raise registry.BadInput("metric_names is needed")
        one = lambda name: asked.get(name, [None])[0]
        out = cli.audit(
            self.spark, modality, DOMAINS[one("validation_domain") or "input_val"], target, self._path(asked, "reference_data"), asked.get("metric_names") if named else None, self._path(asked, "annotation_file"),
            one("reference_type"), asked.get("evaluation_level"), asked.get("metric_category"), asked.get("metric_group"),
        )
        return 200, out


def server(service: Service, port: int) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802, the base class calls it
            try:
                status, body = service.answer(self.path)
            except Exception as failed:  # noqa: BLE001, a request's failure isn't the server's
                status, body = 500, {"msg": f"{type(failed).__name__}: {str(failed)[:500]}", "type": "error"}
            text = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(text)))
            self.end_headers()
            self.wfile.write(text)

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)


if __name__ == "__main__":
    server(Service(SparkSession.builder.appName("veracast").getOrCreate(), sys.argv[1]), int(sys.argv[2]) if len(sys.argv) > 2 else 8000).serve_forever()

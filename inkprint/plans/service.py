"""A scorer behind HTTP, as a WSGI application: any WSGI server runs it, none is needed by the engine.

Answers are JSON.  ``POST /predict`` takes text1 and text2 and gives what
``Scorer.predict`` does; ``GET /metrics`` the test metrics that a page shows;
``GET /ping`` says that the service is up; ``GET /`` is a form.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession

from inkprint.plans.scorer import Scorer

PAGE = """<!doctype html><title>Same author?</title><form id=f><textarea name=text1></textarea><textarea name=text2></textarea><button>Compare</button></form><pre id=out></pre>
<script>f.onsubmit = async e => { e.preventDefault(); const r = await fetch('predict', {method: 'POST', body: JSON.stringify(Object.fromEntries(new FormData(f)))}); out.textContent = JSON.stringify(await r.json(), null, 2) }</script>"""


def shown_metrics(report: dict) -> dict[str, float]:
    """f1, youden_j from the counts, and auc_roc of a report's test part; what is missing counts as 0, recall stands in for no positives."""
    told = report.get("test") or {}
    tn, fp, fn, tp = (float(told.get(c, 0)) for c in ("tn", "fp", "fn", "tp"))
    recall = tp / (tp + fn) if tp + fn else float(told.get("recall", 0))
    return {"f1": float(told.get("f1", 0)), "youden_j": round(recall + (tn / (tn + fp) if tn + fp else 0.0) - 1, 5), "auc_roc": float(told.get("roc_auc", 0))}


def application(spark: SparkSession, scorer: Scorer) -> Callable[[dict, Callable], Iterable[bytes]]:
    """The WSGI application of a scorer."""

    def predict(environ: dict) -> tuple[int, dict]:
        size = int(environ.get("CONTENT_LENGTH") or 0)
        try:
            asked = json.loads(environ["wsgi.input"].read(size) or b"{}")
            texts = [str(asked.get(side) or "").strip() for side in ("text1", "text2")]
        except (ValueError, AttributeError):
            return 400, {"error": "The body must be a JSON object."}
        if not all(texts):
            return 400, {"error": "Both text fields are required."}
        return 200, scorer.predict(spark, *texts)

    routes = {
        ("GET", "/"): lambda _: (200, PAGE),
        ("GET", "/ping"): lambda _: (200, {"status": "ok"}),
        ("GET", "/metrics"): lambda _: (200, shown_metrics(scorer.report)),
        ("POST", "/predict"): predict,
    }
    names = {200: "200 OK", 400: "400 Bad Request", 404: "404 Not Found", 500: "500 Internal Server Error"}

    def answer(environ: dict, start: Callable) -> Iterable[bytes]:
        route = routes.get((environ.get("REQUEST_METHOD", "GET"), environ.get("PATH_INFO") or "/"))
        try:
            status, body = route(environ) if route else (404, {"error": "no such route"})
        except Exception as failure:  # a request that fails must not end the service
            status, body = 500, {"error": f"Inference failed: {failure}"}
        page = isinstance(body, str)
        data = (body if page else json.dumps(body, ensure_ascii=False)).encode()
        start(names[status], [("Content-Type", "text/html; charset=utf-8" if page else "application/json"), ("Content-Length", str(len(data)))])
        return [data]

    return answer

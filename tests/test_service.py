"""The HTTP adapter over a stand-in for a scorer, and small checks of loading and rounding."""

import io
import json
import sys
from types import SimpleNamespace

import pytest

from inkprint.operators import annotate, audit
from inkprint.plans import service

REPORT = {"test": {"tn": 3009, "fp": 512, "fn": 1039, "tp": 2826, "recall": 0.73118, "f1": 0.78467, "roc_auc": 0.87719}}


def _ask(app, method, path, body=b""):
    told = {}
    data = b"".join(app({"REQUEST_METHOD": method, "PATH_INFO": path, "CONTENT_LENGTH": str(len(body)), "wsgi.input": io.BytesIO(body)}, lambda status, headers: told.update(status=status, **dict(headers))))
    assert told["Content-Length"] == str(len(data))
    return told["status"][:3], data.decode() if "html" in told["Content-Type"] else json.loads(data)


def test_routes():
    def predict(spark, a, b):
        if a == "bad":
            raise RuntimeError("no model")
        return {"label": "Same author", "probability": 0.7, "texts": [a, b]}

    app = service.application(None, SimpleNamespace(predict=predict, report=REPORT))
    assert _ask(app, "GET", "/ping") == ("200", {"status": "ok"})
    assert _ask(app, "GET", "/metrics") == ("200", {"f1": 0.78467, "youden_j": 0.58576, "auc_roc": 0.87719})
    assert "<form" in _ask(app, "GET", "/")[1]
    post = lambda body: _ask(app, "POST", "/predict", json.dumps(body).encode())
    assert post({"text1": " a ", "text2": "b"}) == ("200", {"label": "Same author", "probability": 0.7, "texts": ["a", "b"]})
    assert post({"text1": " ", "text2": "b"})[0] == post({}) [0] == post([1])[0] == _ask(app, "POST", "/predict", b"{")[0] == "400"
    assert post({"text1": "bad", "text2": "b"}) == ("500", {"error": "Inference failed: no model"})
    assert _ask(app, "GET", "/predict")[0] == "404"
    assert service.shown_metrics({}) == {"f1": 0.0, "youden_j": -1.0, "auc_roc": 0.0}


def test_model_loading(monkeypatch):
    asked = []
    monkeypatch.setitem(sys.modules, "spacy", SimpleNamespace(prefer_gpu=lambda: asked.append("gpu"), load=lambda name, disable: (name, disable)))
    annotate.load_spacy.cache_clear()
    assert annotate.load_spacy("m", True, ("ner",)) == ("m", ["ner"]) and asked == ["gpu"]
    annotate.load_spacy.cache_clear()


def test_summaries_round_half_even(spark):
    rows = [(1, "train", "a b", "x", 1), (2, "train", "a b c", "x", 0), (3, "train", "a b c d e f", "x", 0), (4, "train", "a", "x y", 0), (5, "train", "a", "x", 0), (6, "train", "a", "x", 0), (7, "train", "a", "x", 0), (8, "train", "a", "x", 0)]
    pairs = spark.createDataFrame(rows, "pair_id long, split string, text1 string, text2 string, same int")
    row = audit.summary(pairs).first()
    assert (row.rows, row.label_0, row.label_1, row.label_1_ratio) == (8, 7, 1, 0.125)
    assert (row.text1_mean_word_length, row.text1_median_word_length, row.text2_mean_word_length) == (2.0, 1.0, 1.12)  # 1.125 to the even digit
    assert row.text1_std_word_length == pytest.approx(1.77) and audit.normalization_summary(pairs).first().text2_mean_word_length == 1.12

"""The HTTP interface, by its answers and over a socket."""

from __future__ import annotations

import json
import threading
import urllib.error
import urllib.request

from veracast import api


def test_answers(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n" + "".join(f"{i},{i % 7}\n" for i in range(60)))
    (tmp_path / "u.csv").write_text("a,b\n" + "".join(f"{i},{i % 5}\n" for i in range(60)))
    ask = api.Service(spark, str(tmp_path)).answer
    assert ask("/")[1] == {"message": "Welcome from the API."} and ask("/api/healthcheck")[1] == {"message": "API is alive!"}
    status, info = ask("/metrics/info?data_modalities=tabular&validation_domains=input&metric_categorys=data")
    assert status == 200 and "tabular.input_val.data.KAnonymityScore" in info and all(k.startswith("tabular.input_val.data.") for k in info)
    json.dumps(info, allow_nan=False)
    assert len(ask("/metrics/info")[1]) > len(info)
    assert ask("/metrics/info?data_modalities=tabular&metric_categorys=annotation")[0] == 404
    assert ask("/metrics/info?data_modalities=smell")[0] == 422 and ask("/metrics/smell?target_data=t.csv")[0] == 422 and ask("/metrics/info?colour=red")[0] == 422
    assert ask("/nothing")[0] == 404
    status, out = ask("/metrics/tabular?target_data=t.csv&metric_group=privacy")
    assert status == 200 and set(out["dataset_level"]["raw_data_metrics"]) == {"KAnonymityScore"}
    status, out = ask("/metrics/tabular/specific-metrics?target_data=u.csv&reference_data=t.csv&validation_domain=synth&metric_names=CoherenceScore")
    assert status == 200 and set(out["dataset_level"]["raw_data_metrics"]) == {"CoherenceScore"}
    for url, want in (
        ("/metrics/tabular", 400), ("/metrics/tabular?target_data=../t.csv", 400), ("/metrics/tabular?target_data=/t.csv", 400), ("/metrics/tabular/specific-metrics?target_data=t.csv", 400),
        ("/metrics/tabular/specific-metrics?target_data=t.csv&metric_names=None", 404), ("/metrics/tabular?target_data=t.csv&validation_domain=synth", 400), ("/metrics/tabular?target_data=t.csv&reference_type=instance", 404),
    ):
        status, body = ask(url)
        assert status == want and body["type"] == "error" and body["msg"], url


def test_over_a_socket(spark, tmp_path):
    one = api.server(api.Service(spark, str(tmp_path)), 0)
    threading.Thread(target=one.serve_forever, daemon=True).start()
    try:
        at = f"http://127.0.0.1:{one.server_address[1]}"
        with urllib.request.urlopen(f"{at}/api/healthcheck") as got:
            assert got.status == 200 and json.load(got) == {"message": "API is alive!"}
        try:
            urllib.request.urlopen(f"{at}/metrics/tabular?target_data=none.csv")
            raise AssertionError("no such table")
        except urllib.error.HTTPError as refused:
            assert refused.code in (400, 404, 500) and json.load(refused)["type"] == "error"
    finally:
        one.shutdown()

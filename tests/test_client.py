import json
import urllib.request

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import onnx
from corpusloom.operators import views
from corpusloom.plans.budget import StepTimeout, time_budget, with_retries
from corpusloom.plans.engine import Engine
from corpusloom.plans.server import AgentServer


def test_clean_html():
    raw = '<p onclick="x()">a &lt; b<script>bad("</p>")</script><a href=" JavaScript:x" title="t">l</a><br><style>s</style></p><meta charset="u">end'
    assert views.clean_html(raw) == '<p>a &lt; b<a title="t">l</a><br></p>end'


def test_links(spark):
    got = spark.range(1).select(views.linked_pages(F.lit("see [[ a/b.ts ]]"))).first()[0]
    assert got == 'see <button type="button" class="wikilink" data-node="a/b.ts">a/b.ts</button>'


def test_budget_and_retries(spark):
    with time_budget(spark, "other", 60):
        assert spark.range(5).count() == 5
    with pytest.raises(StepTimeout):
        with time_budget(spark, "other", 1):
            spark.range(1 << 40).select(F.sum(F.sha2(F.col("id").cast("string"), 256).substr(1, 2).cast("binary").isNull().cast("int"))).collect()
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError

    with_retries(flaky, pause=0)
    assert len(calls) == 3


def test_mean_pool():
    assert [round(x, 6) for x in onnx.mean_pool([[3.0, 0.0], [0.0, 4.0], [9.0, 9.0]], [1, 1, 0])] == [0.6, 0.8]
    assert not onnx.available(None) and not onnx.available("/no/model.onnx")


def test_engine_embeds_by_the_model(spark, tmp_path, monkeypatch):
    """A stub session stands for the model: texts with "grove" point one way, others another, and "broken" fails."""
    import numpy as np

    class Encoded:
        def __init__(self, text):
            self.ids, self.attention_mask, self.type_ids = [int("grove" in text)], [1], [0]

    class Tokenizer:
        def encode(self, text):
            if "broken" in text:
                raise ValueError
            return Encoded(text)

    class Input:
        name = "input_ids"

    class Session:
        def get_inputs(self):
            return [Input()]

        def run(self, _, given):
            return [np.array([[[3.0, 4.0, 0.0] if given["input_ids"][0, 0] else [0.0, 0.0, 2.0]]])]

    root, models = tmp_path / "ws", tmp_path / "model"
    for name, text in (("src/a.md", "orange grove\n"), ("src/b.md", "plain notes\n"), ("src/c.md", "broken grove\n")):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    models.mkdir()
    (models / "m.onnx").write_bytes(b"")
    (models / "tokenizer.json").write_text("{}")
    engine = Engine(spark, str(root))
    engine.set_settings(embedding_model_path=str(models / "m.onnx"))
    with monkeypatch.context() as patch:
        patch.setattr(onnx, "_session", lambda path: (Session(), Tokenizer()))
        engine.rebuild_search_index()
        held = {r["path"]: [round(x, 6) for x in r["vector"]] for r in engine.table("chunk_embeddings").collect()}
        assert held["src/a.md"] == [0.6, 0.8, 0.0] and held["src/b.md"] == [0.0, 0.0, 1.0] and len(held["src/c.md"]) == 64
        scores = {r["path"]: round(r["vector_score"], 6) for r in engine.hybrid_search("grove").collect()}
        assert scores == {"src/a.md": 1.0, "src/c.md": 0.0}
        assert [c["path"] for c in engine.ask_local("where is that grove").citations][0] == "src/a.md"
    engine.rebuild_search_index()  # the model file does not load: hashes stand in
    assert {len(r["vector"]) for r in engine.table("chunk_embeddings").collect()} == {64}


def test_server(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    server = AgentServer(engine).start()
    try:
        with urllib.request.urlopen(f"http://127.0.0.1:{server.port}/status") as said:
            assert said.status == 200 and json.load(said)["root"] == engine.root
        with pytest.raises(urllib.error.HTTPError):
            urllib.request.urlopen(f"http://127.0.0.1:{server.port}/save")
        assert server.status()["running"]
    finally:
        server.stop()

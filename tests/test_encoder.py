import uuid

import numpy as np

from tilewright.operators import encoder


def test_tokens_are_reduced_and_weights_are_loaded_once_per_worker(spark, tmp_path):
    weights = np.arange(6, dtype=np.float32).reshape(3, 2) - 2
    uri = encoder.write_weights(weights, str(tmp_path / "w" / f"{uuid.uuid4().hex}.npy"))
    loads = tmp_path / "loads"
    loads.mkdir()

    def counted(w):
        assert isinstance(w, np.memmap)
        (loads / uuid.uuid4().hex).write_text("")
        return encoder.patch_model(w)

    rows = [("s", k, 0, [float((k + i) % 5) for i in range(12)]) for k in range(200)]
    df = spark.createDataFrame(rows, "slide_name string, x int, y int, pixels array<float>").repartition(24)
    got = {r.x: r.embedding for r in encoder.token_embeddings(df, encoder.token_encoder(spark, uri, 12, counted, batch=7), 2).collect()}
    for _, x, _, v in rows:
        patches = np.array(v).reshape(4, 3) @ weights
        assert np.allclose(got[x], np.concatenate([patches.max(0), patches.mean(0)]))
    assert 1 <= len(list(loads.iterdir())) <= 8 < 24  # four workers at a time, and not one load for each of the tasks


def test_order_of_tokens():
    tokens = encoder.patch_model(np.eye(2, dtype=np.float32))(np.array([[1, 9, 5, 2]], np.float32))
    assert tokens.shape == (1, 7, 2) and tokens[0, 0].tolist() == [5, 9] and tokens[0, 5:].tolist() == [[1, 9], [5, 2]]

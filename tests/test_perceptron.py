"""The barrier-trained perceptron: gradients against differences, one result for any number of tasks, early stopping."""

from dataclasses import replace

import numpy as np

from textloom.plans import heads, perceptron
from test_trees import frame, made


def test_gradient_is_the_slope():
    s = perceptron.Settings(width=5, layers=2)
    random = np.random.default_rng(1)
    weights, x, y, w = perceptron.begun(3, s), random.normal(size=(7, 3)), random.integers(0, 2, 7), random.random(7)
    masks = [(random.random((7, 5)) > 0.3) / 0.7 for _ in range(2)]
    grads, _ = perceptron.gradient(weights, x, y, w, masks)
    for k, g in enumerate(grads):
        for at in np.ndindex(*g.shape):
            moved = [[v.copy() for v in weights] for _ in range(2)]
            moved[0][k][at] += 1e-6
            moved[1][k][at] -= 1e-6
            slope = (perceptron.gradient(moved[0], x, y, w, masks)[1] - perceptron.gradient(moved[1], x, y, w, masks)[1]) / 2e-6
            assert abs(slope - g[at]) < 1e-6


def test_any_number_of_tasks_gives_the_same_weights(spark):
    x, y = made(400, 4, 1)
    other, truth = made(200, 4, 2)
    s = perceptron.Settings(width=16, epochs=3, batch=256, rate=0.01)
    models = [perceptron.fit(frame(spark, x, y, n), s, frame(spark, other, truth, n), key="id", tasks=n) for n in (1, 4)]
    assert all((a == b).all() for a, b in zip(models[0].weights, models[1].weights)) and models[0].accuracies == models[1].accuracies
    again = perceptron.Model.from_json(models[0].to_json())
    assert (again.scores(other) == models[0].scores(other)).all()


def test_early_stopping_learns_and_stops(spark):
    x, y = made(600, 4, 3)
    other, truth = made(300, 4, 4)
    s = perceptron.Settings(width=32, epochs=40, batch=128, rate=0.02, patience=2)
    train, val = frame(spark, x, y), frame(spark, other, truth)
    model = perceptron.fit(train, s, val, key="id", tasks=2)
    n = len(model.accuracies)
    assert n < 40 and max(model.accuracies) > 0.8 and int(np.argmax(model.accuracies)) == n - 3
    p = {r.id: r.pred for r in perceptron.with_scores(model, val).collect()}
    assert abs(np.mean([p[i] == t for i, t in enumerate(truth)]) - max(model.accuracies)) < 1e-9


def test_awkward_rows_and_head(spark):
    odd = spark.createDataFrame([([1.0, None], 1, "a"), ([float("nan"), float("inf")], 0, "a"), ([1.0, 2.0], None, "b")] * 5, "features array<double>, y int, shard string")
    model = perceptron.fit(odd, perceptron.Settings(width=4, epochs=2), tasks=3)
    assert all(0 <= r.p <= 1 for r in perceptron.with_scores(model, odd).collect()) and model.accuracies == []
    assert len(perceptron.fit(odd.limit(0), replace(perceptron.Settings(), width=4, layers=1), tasks=2).weights) == 4
    x, y = made(300, 4, 5)
    fitted = heads.fit("mlp", frame(spark, x, y), params={"width": 8, "epochs": 3, "batch": 256, "rate": 0.02})
    assert heads.evaluated(heads.scored(fitted, frame(spark, x, y))).first().roc_auc > 0.5

import random

import numpy as np

from adjudica.llm import quality


def good(prose, seed):
    words = prose(seed, 40 + seed % 60)
    return ".\n".join(" ".join(words[i : i + 9]).capitalize() for i in range(0, len(words), 9)) + "."


def bad(prose, seed):
    words = prose(seed, 40)
    return "!! ".join(words).upper() if seed % 2 else " ".join([words[0]] * 30 + ["$$$" + w for w in words])


def test_statistics_by_plain_counting():
    texts = ["Ab cd. ab!\nAb cd. ab!\n\nX 12 $$", "", "é"]
    stats = dict(zip(quality.STATISTICS, quality.statistics(texts).T, strict=True))
    share = lambda part, whole: np.log((part + 0.5) / (whole - part + 0.5))
    assert np.allclose(stats["words"], np.log1p([9, 0, 1]))
    assert np.allclose(stats["upper"], [share(3, 21), 0, share(0, 1)])
    assert np.allclose(stats["digits"], [share(2, 21), 0, share(0, 1)])
    assert np.allclose(stats["symbols"], [share(2, 21), 0, share(0, 1)])
    assert np.allclose(stats["distinct_words"], [share(6, 9), 0, share(1, 1)])
    assert np.allclose(stats["top_word"], [share(2, 9), 0, share(1, 1)])
    assert np.allclose(stats["lines"], np.log1p([3, 0, 1]))
    assert np.allclose(stats["repeated_lines"], [share(1, 3), 0, share(0, 1)])
    assert np.allclose(stats["not_ascii"], [share(0, 21), 0, share(1, 1)])
    assert np.isfinite(quality.statistics(["", " ", "\n", "x" * 300_000, "!" * 9, "a " * 50_000])).all()


def test_held_out_accuracy(spark, frame, prose):
    rows = [(i, good(prose, i) if i % 3 else bad(prose, i)) for i in range(300)]
    described = quality.describe(frame(rows + [(900, None), (901, ""), (None, "x")])).cache()
    labels = spark.createDataFrame(
        [(i, int(i % 3 > 0)) for i in range(200)] + [(5, None), (None, 1), (6, 7)], "doc_id bigint, label int"
    )
    model = quality.learn(described.join(labels, "doc_id"))
    scores = {r.doc_id: r.score for r in quality.score(described, model).collect()}
    assert len(scores) == 303 and all(0 <= s <= 1 for s in scores.values())
    assert np.mean([(scores[i] >= 0.3) == (i % 3 > 0) for i in range(200, 300)]) > 0.95


def test_densities_are_those_of_the_shrunk_gaussians(spark, frame, prose):
    rows = [(i, good(prose, i) if i % 2 else bad(prose, i)) for i in range(60)]
    described = quality.describe(frame(rows)).cache()
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, label int")
    model = quality.learn(described.join(labels, "doc_id"), pooled=0.3, diagonal=0.2)
    x = np.array([r.stats for r in described.orderBy("doc_id").collect()])
    groups = [x[np.arange(60) % 2 == k] for k in (0, 1)]
    spread = [np.cov(g.T, bias=True) for g in groups]
    common = sum(s * len(g) for s, g in zip(spread, groups, strict=True)) / 60
    logs = []
    for g, s in zip(groups, spread, strict=True):
        s = 0.7 * s + 0.3 * common
        s = 0.8 * s + 0.2 * np.diag(np.maximum(np.diag(s), 1e-6)) + 1e-6 * np.eye(len(s))
        z = x - g.mean(axis=0)
        logs.append(np.log(0.5) - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(s), z) - 0.5 * np.linalg.slogdet(s)[1])
    assert np.allclose(model.log_odds(x), (logs[1] - logs[0]) / np.sqrt(x.shape[1]), rtol=1e-6, atol=1e-6)


def test_nothing_to_learn_from(spark, frame):
    described = quality.describe(frame([(1, "a"), (1, "a"), (2, None)]))
    assert described.count() == 3 and quality.describe(frame([])).count() == 0
    labels = spark.createDataFrame([(1, 1)], "doc_id bigint, label int")
    assert quality.learn(described.join(labels, "doc_id")) is None
    assert {r.score for r in quality.score(described, None).collect()} == {0.5}

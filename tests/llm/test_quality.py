import random

import numpy as np

from railyard.llm import quality as q


def made(n, seed):
    """Texts by grade: shouting, insults among ordinary words, ordinary words."""
    rnd = random.Random(seed)
    vocabulary = random.Random(0)
    words = ["".join(vocabulary.choices("aeioustnr", k=vocabulary.randint(2, 7))) for _ in range(400)]
    rows = []
    for i in range(n):
        body, grade = rnd.choices(words, k=rnd.randint(150, 500)), i % 3
        if grade == 0:
            body = [w.upper() + "!!" for w in body]
        elif grade == 1:
            body = [rnd.choice(["idiot", "scum"]) if rnd.random() < 0.05 else w for w in body] + ["idiot"]
        rows.append((i, " ".join(body), grade))
    return rows


def frames(spark, rows):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(g > 0), int(g == 1)) for i, _, g in rows], "doc_id long, quality int, toxic int")
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = frames(spark, made(900, 1))
    model = q.train(docs, labels)
    held = made(1500, 2)[900:]
    got = {r.doc_id: r for r in q.score(frames(spark, held)[0].selectExpr("*", "'x' as p_good"), model).collect()}
    assert np.mean([(got[i].p_good >= 0.5) == (g == 2) for i, _, g in held]) > 0.93
    means = [np.mean([got[i].expected_grade for i, _, k in held if k == g]) for g in range(3)]
    assert means[0] < means[1] < means[2]
    assert all(0 <= r.p_good <= 1 and r.p_good <= r.expected_grade <= 2 for r in got.values())


def test_thresholds_are_ordered_and_fit_is_deterministic():
    rows = made(300, 3)
    found, grades = [q.features(t) for _, t, _ in rows], [g for *_, g in rows]
    a, b = q.fit(found, grades), q.fit(found, grades)
    assert a.thresholds[0] < a.thresholds[1] and (a.weights == b.weights).all()


def test_odd_rows(spark):
    rows = made(60, 4)
    docs, labels = frames(spark, rows)
    odd = spark.createDataFrame([(1, None), (1, None), (None, ""), (2, "w " * 300_000)], "doc_id long, text string")
    more = spark.createDataFrame([(None, 1, 0), (3, None, 1), (0, 1, 0), (0, 0, 0)], "doc_id long, quality int, toxic int")
    model = q.train(docs.unionByName(odd), labels.unionByName(more))
    assert q.score(odd, model).count() == 4
    assert q.score(odd.limit(0), model).count() == 0


def test_without_labels(spark):
    docs, labels = frames(spark, made(6, 5))
    none = q.train(docs, labels.limit(0))
    assert all(r.p_good == 1 and r.expected_grade == 2 for r in q.score(docs, none).collect())
    good = q.train(docs, labels.filter("quality = 1 and toxic = 0"))
    assert all(r.p_good == 1 for r in q.score(docs, good).collect())


def plain_fit(rows, grades, n_grades, epochs, rate, decay, sparse):
    """The same loss and steps in plain Python, a dense list of features for each row."""
    import math

    used = sorted({int(b) for found, _ in rows for b in found})
    x = [[dict(zip(map(int, found), map(float, value))).get(b, 0.0) for b in used] for found, value in rows]
    counts = [grades.count(g) for g in range(n_grades)]
    share = [1 / (sum(c > 0 for c in counts) * counts[g]) for g in grades]
    w, seen_w = [0.0] * len(used), [1e-8] * len(used)
    free, seen_t = [-0.5] + [0.0] * (n_grades - 2), [1e-8] * (n_grades - 1)
    for _ in range(epochs):
        cuts = [free[0] + sum(math.exp(free[1 + j]) for j in range(k)) for k in range(n_grades - 1)]
        grad_w, grad_t = [decay * v for v in w], [0.0] * (n_grades - 1)
        for row, g, s in zip(x, grades, share):
            score = sum(a * b for a, b in zip(w, row))
            for k, c in enumerate(cuts):
                error = s * (1 / (1 + math.exp(c - score)) - (g >= k + 1))
                for j, v in enumerate(row):
                    grad_w[j] += error * v
                grad_t[0] -= error
                for m in range(1, k + 1):
                    grad_t[m] -= error * math.exp(free[m])
        for j, g in enumerate(grad_w):
            seen_w[j] += g * g
            pace = rate / math.sqrt(seen_w[j])
            v = w[j] - pace * g
            w[j] = math.copysign(max(abs(v) - pace * sparse, 0.0), v)
        for j, g in enumerate(grad_t):
            seen_t[j] += g * g
            free[j] -= rate * g / math.sqrt(seen_t[j])
    return dict(zip(used, w)), [free[0] + sum(math.exp(free[1 + j]) for j in range(k)) for k in range(n_grades - 1)]


def test_fit_and_scores_like_plain_python(spark):
    import math

    rnd = random.Random(9)
    words = ["alpha", "beta", "gamma", "delta", "IDIOT", "omega!!"]
    texts = [" ".join(rnd.choices(words, weights=[4, 3, 2, 2, 3 * (g == 1) + 0.1, 4 * (g == 0) + 0.2], k=rnd.randint(5, 30))) for g in [0, 1, 2, 2] * 12]
    grades = [0, 1, 2, 2] * 12
    found = [q.features(t) for t in texts]
    for n_grades, own in ((3, grades), (4, [g + (k % 8 == 3) for k, g in enumerate(grades)])):
        model = q.fit(found, own, n_grades, epochs=60, least=1)
        weights, cuts = plain_fit(found, own, n_grades, 60, 0.3, 1e-4, 1e-3)
        assert np.allclose(model.thresholds, cuts, atol=1e-5)
        assert np.allclose([model.weights[b] for b in weights], list(weights.values()), atol=1e-5)
        assert np.count_nonzero(model.weights) <= len(weights)
    model = q.fit(found, grades, 3, epochs=60, least=1)
    weights, cuts = plain_fit(found, grades, 3, 60, 0.3, 1e-4, 1e-3)
    got = {r.doc_id: r for r in q.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, (buckets, values) in enumerate(found):
        score = sum(weights[int(b)] * float(v) for b, v in zip(buckets, values))
        tails = [1 / (1 + math.exp(c - score)) for c in cuts]
        assert abs(got[i].expected_grade - sum(tails)) < 1e-4 and abs(got[i].p_good - tails[-1]) < 1e-4

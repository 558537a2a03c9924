"""The classifiers' models against plain loops: EM of the label model, statistics, rules and the lasso's optimum."""

import math

import numpy as np

from phasegrid.llm import quality, toxicity


def plain_parents(votes, toxic, posterior, correlated):
    """Maximum spanning tree over all pairs, largest first, hung on voter 0."""
    n, k = len(votes), len(votes[0])
    rest = []
    for j in range(k):
        means = []
        for m in (posterior, [1 - p for p in posterior]):
            means.append(sum(w for w, v in zip(m, votes, strict=True) if v[j]) / max(sum(m), 1e-9))
        rest.append([v[j] - (p * means[0] + (1 - p) * means[1]) for p, v in zip(posterior, votes, strict=True)])
    sd = [math.sqrt(sum((x - sum(r) / n) ** 2 for x in r) / n) + 1e-9 for r in rest]
    strength = {(a, b): abs(sum(x * y for x, y in zip(rest[a], rest[b], strict=True)) / n / (sd[a] * sd[b])) for a in range(k) for b in range(a + 1, k) if toxic[a] and toxic[b]}
    group, near = list(range(k)), {j: [] for j in range(k)}
    for a, b in sorted(strength, key=strength.get, reverse=True):
        if group[a] != group[b]:
            group = [group[a] if g == group[b] else g for g in group]
            near[a].append(b)
            near[b].append(a)
    parent, queue = {0: -1}, [0]
    while queue:
        a = queue.pop()
        for b in near[a]:
            if b not in parent:
                parent[b] = a
                queue.append(b)
    return [p if (p := parent.get(j, -1)) >= 0 and strength[min(j, p), max(j, p)] >= correlated else -1 for j in range(k)]


def plain_label_model(votes, toxic, balance, rounds=40, correlated=0.05):
    n, k = len(votes), len(votes[0])
    posterior = [0.9 if any(v[j] for j in range(k) if toxic[j]) else 0.02 for v in votes]

    def rate(mass, seen, fires, before, weight):
        rows = [i for i in range(n) if seen(i)]
        x = (sum(mass[i] for i in rows if fires(i)) + weight * before) / (sum(mass[i] for i in rows) + weight)
        return min(max(x, 1e-5), 0.9999)

    for _ in range(2):
        parent = plain_parents(votes, toxic, posterior, correlated)
        for _ in range(rounds):
            mass = posterior, [1 - p for p in posterior]
            on, off, weight = [], [], []
            for j in range(k):
                a, b = (rate(m, lambda i: True, lambda i: votes[i][j], x, 1.0) for m, x in zip(mass, (0.05, 0.001), strict=True))
                a = max(a, 1.5 * b) if toxic[j] else min(a, b / 1.1)
                on.append(min(max(a, 1e-5), 0.9999))
                off.append(b)
                if parent[j] < 0:
                    weight.append([math.log(on[j] / off[j])] * 2)
                else:
                    given = [[rate(m, lambda i: votes[i][parent[j]] == up, lambda i: votes[i][j], r, 2.0) for m, r in zip(mass, (on[j], off[j]), strict=True)] for up in (0, 1)]
                    weight.append([math.log(a / b) for a, b in given])
            z = [math.log(balance / (1 - balance)) + sum(weight[j][int(parent[j] >= 0 and v[parent[j]])] for j in range(k) if v[j]) for v in votes]
            last, posterior = posterior, [1 / (1 + math.exp(-min(max(x, -30), 30))) for x in z]
            if max(abs(a - b) for a, b in zip(last, posterior, strict=True)) < 1e-4:
                break
    return posterior, on, off, parent


def test_label_model_equals_plain_loops():
    rnd = np.random.default_rng(11)
    for trial in range(4):
        truth = rnd.random(400) < 0.25
        k = 4 + trial
        votes = (rnd.random((400, k)) < np.where(truth[:, None], rnd.uniform(0.3, 0.8, k), rnd.uniform(0.005, 0.05, k))).astype(int)
        votes[:, 1] = np.where(rnd.random(400) < 0.9, votes[:, 0], votes[:, 1])  # hangs on the first
        votes = np.column_stack([votes, 1 - votes.any(axis=1)])
        toxic = [True] * k + [False]
        got = toxicity.label_model(votes.astype(float), np.array(toxic), 0.25)
        want = plain_label_model(votes.tolist(), toxic, 0.25)
        assert got[3].tolist() == want[3]
        for g, w in zip(got[:3], want[:3], strict=True):
            assert np.abs(g - np.array(w)).max() < 1e-6


def test_regression_is_at_its_optimum():
    """No step from the weights lowers the penalised loss on soft labels."""
    rnd = np.random.default_rng(2)
    x = (rnd.random((300, 6)) < 0.3).astype(float)
    y = 1 / (1 + np.exp(-(x @ rnd.normal(0, 2, 6) - 0.5)))
    w, b = toxicity.logistic(x, y)

    def loss(w, b):
        z = x @ w + b
        return float((np.log1p(np.exp(z)) - y * z).sum() + 0.05 * (w @ w) + 0.0005 * b * b)

    for _ in range(200):
        d = rnd.normal(0, 0.01, 7)
        assert loss(w, b) <= loss(w + d[:6], b + d[6])


def plain_statistics(text):
    data, words, lines = text.encode(), text.split(), text.split("\n")
    share = [sum(c in chars for c in data) / max(1, len(data)) for chars in (bytes(range(65, 91)), b"0123456789", b"#$%&*+<=>@\\^_`{}~/[]", b"!", b"|", b".,;:?", b"\n")]
    n = max(1, len(words))
    return dict(zip(quality.FEATURES, [math.log(1 + len(data)), min(100.0, len(data) / n), *share, len(set(words)) / n if words else 1.0, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, len(set(lines)) / len(lines)], strict=True))


def test_quality_equals_a_plain_evaluation(spark, sf_dir):
    """Scores of the whole table from plain statistics and rules; the weights leave the lasso no way down."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels)
    texts = {r["doc_id"]: plain_statistics(r["text"] or "") for r in docs.collect()}

    def row(stats):
        return [all(stats[f] <= t if op == "<=" else stats[f] > t for f, op, t in rule) for rule, _ in model.rules]

    def score(stats):
        return 1 / (1 + math.exp(-(model.bias + sum(w for (_, w), on in zip(model.rules, row(stats), strict=True) if on))))

    got = {r["doc_id"]: r["quality_score"] for r in quality.scored(docs, model).collect()}
    assert len(got) == len(texts) and model.rules
    assert all(abs(got[d] - score(s)) < 1e-9 for d, s in texts.items())
    rows = toxicity.training_rows(docs, labels, "quality", 12_000).select("doc_id", "label").collect()
    x, y = np.array([row(texts[r["doc_id"]]) for r in rows], float), np.array([r["label"] for r in rows], float)
    left = np.array([score(texts[r["doc_id"]]) for r in rows]) - y
    assert abs(left.mean()) < 1e-3
    assert np.abs(x.T @ left / len(y) + 0.002 * np.sign([w for _, w in model.rules])).max() < 1e-3

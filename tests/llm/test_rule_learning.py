"""The learned decision list against plain sequential covering over the same feature values."""

import math
import random

from tidebook.llm import quality_rules

SETTINGS = {"most_rules": 5, "most_conditions": 2, "precision": 0.85, "support": 4}


def holds(condition, values):
    feature, above, bound = condition
    return (values[feature] > bound) == above


def covers(rule, values):
    return all(holds(c, values) for c in rule)


def plain_bounds(rows, feature):
    seen = set()
    for kind in (0, 1):
        own = sorted(values[feature] for values, bad, _ in rows if bad == kind)
        seen |= {own[max(math.ceil(i / 40 * len(own)) - 1, 0)] for i in range(41)} if own else set()
    seen = sorted(seen)
    return [(a + b) / 2 for a, b in zip(seen, seen[1:])]


def plain_rules(rows, most_rules, most_conditions, precision, support):
    """rows: (values, bad, whether it grows rules)."""
    bounds = {f: plain_bounds(rows, f) for f in quality_rules.FEATURES}
    rules = []
    while len(rules) < most_rules:
        left = [r for r in rows if not any(covers(rule, r[0]) for rule in rules)]
        rule = []
        while len(rule) < most_conditions:
            inside = [(values, bad) for values, bad, grows in left if grows and covers(rule, values)]
            whole = sum(bad for _, bad in inside)
            found, most = None, 0.0
            for feature in bounds if whole else ():
                for bound in bounds[feature]:
                    for above in (True, False):
                        taken = [bad for values, bad in inside if holds((feature, above, bound), values)]
                        if sum(taken) and len(taken) < len(inside):
                            gain = sum(taken) * (math.log2(sum(taken) / len(taken)) - math.log2(whole / len(inside)))
                            if gain > most + 1e-9:
                                found, most = (feature, above, bound), gain
            if found is None:
                break
            rule.append(found)
        scored = []
        for k in range(1, len(rule) + 1):
            taken = [bad for values, bad, grows in left if not grows and covers(rule[:k], values)]
            if sum(taken) >= support:
                scored.append((round(sum(taken) / len(taken), 6), -k))
        if not scored or max(scored)[0] < precision:
            return rules
        rules.append(rule[: -max(scored)[1]])
    return rules


def corpus():
    random.seed(8)
    docs, labels = [], []
    for i in range(420):
        words = [random.choice(["word", "other", "thing", "Place"]) + str(random.randrange(40)) * (random.random() < 0.2) for _ in range(random.randint(22, 60))]
        cause = random.choice(["", "", "", "signs", "digits", "loud"])
        if cause == "signs":
            words += ["| # |"] * random.randint(4, 12)
        elif cause == "digits":
            words = [str(random.randrange(10**6)) if random.random() < 0.5 else w for w in words]
        elif cause == "loud":
            words = [w.upper() for w in words]
        docs.append((i, " ".join(words)))
        labels.append((i, int((cause == "") != (random.random() < 0.03))))
    return docs, labels


def test_rules_are_those_of_plain_covering(spark):
    docs, labels = corpus()
    # Repeated rows count twice, the worst label of an id counts, ids without a text or label don't.
    frame = spark.createDataFrame([*docs, docs[0], (900, None), (901, "short"), (None, docs[1][1])], "doc_id bigint, text string")
    judges = spark.createDataFrame([*labels, (3, 1), (3, None), (None, 0), (777, 0)], "doc_id bigint, quality int")
    stats = quality_rules.statistics(frame)
    learned = quality_rules.learn(stats, judges, **SETTINGS)
    values = stats.withColumn("passes", ~quality_rules.base_failed()).selectExpr(
        "doc_id", "passes", "pmod(xxhash64(doc_id), 3) > 0 AS grows", *[f"CAST({e} AS DOUBLE) AS {n}" for n, e in quality_rules.FEATURES.items()]
    )
    rows = [r.asDict() for r in values.collect()]
    worst = dict(labels)
    usable = [(r, int(worst[r["doc_id"]] == 0), r["grows"]) for r in rows if r["passes"] and r["doc_id"] in worst]
    wanted = plain_rules(usable, **SETTINGS)
    assert len(wanted) >= 2 and [[(c.feature, c.above, c.bound) for c in rule] for rule in learned] == wanted

    by_id = {r["doc_id"]: r for r in rows}
    for row in quality_rules.judged(frame, judges, **SETTINGS).collect():
        own = by_id[row.doc_id]
        fired = next((i for i, rule in enumerate(wanted, 1) if row.n_words and covers(rule, own)), None)
        assert row.base_failed == (not own["passes"]) and row.kept == (own["passes"] and fired is None)
        assert row.rule == fired or not row.n_words
